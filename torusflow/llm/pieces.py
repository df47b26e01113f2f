"""SentencePiece BPE encoding and decoding by backtracking (operator 2).

A merge-type encoding is the one sequence of pieces in which every piece re-merges to
itself and every two neighbours re-merge to the same two pieces. ``Encoder`` finds it
without running the merges over the text: an Aho-Corasick automaton lists the pieces
that start at each character; the longest is tried first; a neighbour check (the merges
of the two strings, kept per pair) accepts it, a shorter one is tried next, and a bit
field remembers positions from which no valid tail exists.

Texts are cut where no piece of the vocabulary spans, so each part is encoded on its
own and kept in a bounded table. This is exact: no merge crosses such a place.

Edge cases: null reads as the empty text, which gives the end id only; characters
outside the vocabulary become their UTF-8 byte pieces; extra columns are ignored;
repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Blanks are kept as such here; the library marks them.
SPACE, MARK = " ", "▁"
#: Kept parts a worker, and kept neighbour checks.
PARTS, PAIRS = 200_000, 300_000
#: A vocabulary beyond this is refused rather than broadcast.
MODEL_BYTES = 64 << 20


class Encoder:
    """Encoding and decoding with one model."""

    def __init__(self, model: bytes):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.end = p.eos_id()
        self.text, self.score, self.byte, byte_of = {}, {}, {}, {}
        for i in range(p.get_piece_size()):
            piece = p.id_to_piece(i)
            if p.is_byte(i):
                byte_of[int(piece[1:-1], 16)] = i
                self.byte[i] = int(piece[1:-1], 16)
            elif not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i)):
                self.text[i] = piece.replace(MARK, SPACE)
                self.score[self.text[i]] = p.get_score(i)
        self.unknown = p.unk_id()
        self.bytes = byte_of if len(byte_of) == 256 else None
        self.number = [str(i) for i in range(p.get_piece_size())]
        self.id = {t: i for i, t in self.text.items()}
        known = {c for t in self.id for c in t}
        if any(SPACE in t.strip(SPACE) for t in self.id) or "\n" in known or any(t[-1] == SPACE and t.strip(SPACE) for t in self.id):
            raise ValueError("pieces that span a blank aren't supported")
        ties = [s for t, s in self.score.items() if t.strip(SPACE) and len(t) > 1]
        if len(ties) != len(set(ties)):
            raise ValueError("two pieces of equal score: the neighbour check would not be exact")
        self.single = known
        self.auto = ahocorasick.Automaton()
        for t, i in self.id.items():
            if len(t) == 1 or self.merge(t) == [t]:
                self.auto.add_word(t, (len(t), i))
        self.auto.make_automaton()
        # A part also ends between a letter and a mark that no piece joins to a letter. A few
        # odd letters that pieces do join to such marks count among the other characters.
        joined: dict[str, set[str]] = {c: set() for c in known if not c.isalnum() and c != SPACE}
        for t in self.id:
            for a, b in zip(t, t[1:]):
                if b in joined and a.isalnum():
                    joined[b].add(a)
        odd = set().union(*(x for x in joined.values() if len(x) <= 3))
        free = re.escape("".join(sorted(c for c, x in joined.items() if x <= odd)))
        odd = "".join(sorted(odd))
        letters = "" if re.search("[a-zA-ZÀ-ÖØ-öø-ÿ]", odd) else "[a-zA-ZÀ-ÖØ-öø-ÿ]+"
        plain = "".join(c for c in ".,!?|$%&*#" if c in free)
        other = f"[\\W_{odd}]"
        quick = f"{SPACE}?{letters}(?![^{SPACE}\\n{plain}])|" if letters and plain else ""  # most parts are words
        self.cut = re.compile(f"{quick}\\n|(?!\\Z){SPACE}*(?:(?![{SPACE}\\n]){other})*(?:[^\\W_{odd}]+(?:(?![{SPACE}\\n{free}]){other}(?:(?![{SPACE}\\n]){other})*)?)*")
        self.pairs: dict[tuple[int, int], bool] = {}
        self.parts: dict[str, tuple[str, str]] = {}

    def merge(self, text: str) -> list[str]:
        """The pieces after all merges: best score first, then leftmost."""
        at = list(text)
        before, after = [*range(-1, len(at) - 1)], [*range(1, len(at) + 1)]
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(at) and (score := self.score.get(both := at[i] + at[j])) is not None:
                heapq.heappush(heap, (-score, i, j, both))

        for i in range(len(at) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if not at[i] or not at[j] or at[i] + at[j] != both:
                continue
            at[i], at[j] = both, ""
            after[i] = after[j]
            if after[j] < len(at):
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [x for x in at if x]

    def adjacent(self, a: int, b: int) -> bool:
        """Whether the two pieces stay apart when their strings are merged together."""
        if a < 0 or b < 0:
            return True
        if (known := self.pairs.get((a, b))) is None:
            known = self.merge(self.text[a] + self.text[b]) == [self.text[a], self.text[b]]
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[a, b] = known
        return known

    def ids(self, part: str) -> list[int]:
        """The ids of a part, found by backtracking."""
        n, pairs = len(part), self.pairs
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, match in self.auto.iter(part):
            starts[end + 1 - match[0]].append(match)  # in order of length
        failed, some = bytearray(n // 8 + 1), False  # a bit for each position without a valid tail, and whether any is set
        out: list[int] = []
        path: list[tuple[int, int]] = []  # the position and the choice taken there
        at, choice, last = 0, -2, None
        while at < n:
            options = starts[at]
            if choice == -2:
                if not options:  # not in the vocabulary
                    options.append((1, -1 - ord(part[at])))
                choice = len(options) - 1
            while choice >= 0:
                size, piece = options[choice]
                if not some or not failed[(at + size) >> 3] >> ((at + size) & 7) & 1:
                    if last is None:
                        break
                    if (fits := pairs.get((last, piece))) is None:
                        fits = self.adjacent(last, piece)
                    if fits:
                        break
                choice -= 1
            else:
                # No piece fits here. The valid encoding of a prefix is unique, so no other
                # way to reach this position can succeed: it is closed for good.
                if not path:
                    raise ValueError("no valid encoding")
                failed[at >> 3] |= 1 << (at & 7)
                some = True
                at, choice = path.pop()
                out.pop()
                last = out[-1] if out else None
                choice -= 1
                continue
            path.append((at, choice))
            out.append(piece)
            last = piece
            at += size
            choice = -2
        if min(out, default=0) >= 0:
            return out
        flat: list[int] = []
        for i in out:
            if i >= 0:
                flat.append(i)
            elif self.bytes:
                flat.extend(self.bytes[b] for b in chr(-1 - i).encode())
            else:
                flat.append(self.unknown)
        return flat

    def plain(self, ids: list[int]) -> str:
        """The characters of ids, with the leading blank; control ids have none."""
        try:
            return "".join([self.text[i] for i in ids])
        except KeyError:
            out, held = [], bytearray()
        for i in ids:
            if i in self.byte:
                held.append(self.byte[i])
                continue
            if held:
                out.append(held.decode(errors="replace"))
                held.clear()
            if i == self.unknown:
                out.append(" ⁇ ")
            elif i in self.text:
                out.append(self.text[i])
        return "".join(out) + held.decode(errors="replace")

    def decode(self, ids: list[int]) -> str:
        """The text of ids: blanks restored, the leading one dropped."""
        text = self.plain(ids)
        return text[1:] if text.startswith(SPACE) else text

    def part(self, part: str) -> tuple[str, str]:
        """Of a part: its ids joined by blanks, and their characters."""
        got = self.parts.get(part)
        if got is None:
            ids = self.ids(part)
            plain = self.plain(ids)
            got = " ".join([self.number[i] for i in ids]), part if plain == part else plain  # one string for both
            if len(part) <= 64:
                if len(self.parts) >= PARTS:
                    self.parts.clear()
                self.parts[part] = got
        return got

    def run(self, text: str | None) -> tuple[str, int, str]:
        """Of a text: its ids with the end id joined by blanks, their number, and the decoded text."""
        if not text:
            return str(self.end), 1, ""
        get = self.parts.get
        found = [get(x) or self.part(x) for x in self.cut.findall(SPACE + text.replace(MARK, SPACE))]
        ids = " ".join([x[0] for x in found])
        return f"{ids} {self.end}", ids.count(" ") + 2, "".join([x[1] for x in found])[1:]


_encoders: dict[str, Encoder] = {}


def encoder(model: bytes) -> Encoder:
    """One encoder a worker and model."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(model)
    return _encoders[key]


def encode(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), texts: bool = False) -> DataFrame:
    """Per row: the id, n_tokens, ids_sha256 and decoded_sha256; with texts also ids and decoded.

    The model file is read on the driver and broadcast; it may have MODEL_BYTES at most.
    """
    with open(model_path, "rb") as f:
        model = f.read(MODEL_BYTES + 1)
    if len(model) > MODEL_BYTES:
        raise ValueError("the model is too large to broadcast")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col), *[F.col(c) for c in keep if c != text_col], F.col(text_col).alias("__text"))
    fields = [x for x in rows.schema.fields if x.name != "__text"]
    fields += [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    fields += [T.StructField("ids", T.StringType()), T.StructField("decoded", T.StringType())] * texts

    def work(batches):
        own = encoder(shared.value)
        gc.disable()  # the kept parts hold no cycles and are costly to scan
        try:
            for batch in batches:
                yield one(own, batch)
        finally:
            gc.enable()

    def one(own, batch):
        n, ids, decoded, more = [], [], [], []
        for x in batch.column(batch.num_columns - 1):
            a, b, c = own.run(x.as_py())
            n.append(b)
            ids.append(hashlib.sha256(a.encode()).hexdigest())
            decoded.append(hashlib.sha256(c.encode()).hexdigest())
            if texts:
                more.append((a, c))
        columns = [*batch.columns[:-1], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
        columns += [pa.array([m[0] for m in more], pa.string()), pa.array([m[1] for m in more], pa.string())] * texts
        return pa.RecordBatch.from_arrays(columns, [x.name for x in fields])

    return rows.mapInArrow(work, T.StructType(fields))


def model_path() -> str:
    """The public model's place, known from the installed package of vocabularies."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, model_path()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
