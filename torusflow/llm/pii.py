"""Personal data by patterns, checksums and context (operator 5, built-in functions only).

For each kind a regular expression proposes spans, a validator (Luhn, mod 97, number of
digits, range of parts) confirms them, and words nearby move the score. The base kinds
(email, ip, card, phone) are decided by pattern and validator alone; the further kinds
(iban, national, ssn, secret) need a score of ``accept`` as well, which context can give
or take away.

A pattern's matches are marked in the text and the text is split at the marks, which
gives positions in code points without any code outside the JVM. The patterns are
written with possessive loops and a look behind, so they take time in proportion to the
text and no stack, however long a run of digits or letters is, and the spans are put
together in nearly linear time, however many there are; they find the same spans
as the plain forms in ``BASE``.

Edge cases: null reads as empty and has no spans; spans of one kind never overlap, spans
of different kinds may; U+0001 and U+0002 in a text count as a character that no pattern
takes; extra columns are kept, and stand in nobody's way; repeated rows give repeated results; an empty table
gives an empty result. Texts are read whole. An IBAN of a country that ``LENGTHS``
lacks is lost where capitals or digits follow after a space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The plain forms, for reference and for tests.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Signs after the country and check digits of an IBAN in the registry's countries and most that use IBANs beside it.
LENGTHS = {
    11: "NO", 12: "BE", 14: "DK FI FO GL FK SD NL", 15: "MK SI", 16: "AT BA EE KZ LT LU XK MN", 17: "HR CH LI LV", 18: "BG BH CR DE GB GE IE ME RS VA",
    19: "AE GI IL IQ OM SO TL", 20: "AD CZ ES MD PK RO SA SE SK TN VG", 21: "PT ST LY AO CV GW MZ", 22: "IS TR IR", 23: "FR GR IT MC MR SM BI DJ CF CG CM GA GQ KM MG TD", 24: "AL AZ BY CY DO GT HN HU LB NI PL SV BJ CI MA ML NE SN TG",
    25: "BR EG PS QA UA", 26: "JO KW MU YE", 27: "MT SC", 28: "LC", 29: "RU",
}
_LISTED = f"(?:{'|'.join(' '.join(LENGTHS.values()).split())})[0-9]{{2}}"
#: A listed country's IBAN ends by its length; any other's takes what can follow, but not the start of a listed one.
_IBAN = "|".join(rf"(?:{'|'.join(c.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n}}}+" for n, c in LENGTHS.items()) + rf"|(?!{_LISTED})[A-Z]{{2}}[0-9]{{2}}(?:\x20?(?!(?<=\x20){_LISTED})[A-Z0-9]){{11,30}}+"
#: kind: (a cheap test of the whole text, the pattern, the score without context).
KINDS = {
    "email": (None, r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9),
    "ip": (r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.7),
    "card": (r"[0-9](?:[\x20-]?[0-9]){15}", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])", 0.8),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", 0.6),
    "iban": (r"[A-Z]{2}[0-9]{2}", rf"(?<![A-Za-z0-9])(?:{_IBAN})(?![A-Za-z0-9])", 0.7),
    "national": (r"[0-9]{3}[ .-][0-9]{4}", r"(?<![0-9+(.-])(?<!\+[0-9]\x20)(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])", 0.4),
    "ssn": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.45),
    "secret": (r"[0-9A-Fa-f]{32}", r"(?<![0-9A-Za-z_-])[0-9A-Fa-f]{32,128}+(?![0-9A-Za-z_-])", 0.4),
}
#: kind: (words that speak for it, words that speak against it) within REACH characters.
CONTEXT = {
    "email": ("mail|contact|write|reply", "regex|pattern"),
    "ip": ("ip|address|host|server|client", "version|release|section|chapter"),
    "card": ("card|visa|master|credit|debit|pay", "order|serial|isbn|tracking"),
    "phone": ("phone|tel|call|mobile|cell|fax", "version|order"),
    "iban": ("iban|bank|account|konto|compte|cuenta", "serial|part"),
    "national": ("phone|tel|call|mobile|cell|fax|contact", "version|order|serial|isbn"),
    "ssn": ("ssn|social|security|tax", "part|serial|order"),
    "secret": ("token|secret|key|password|passwd|auth|bearer", "commit|sha|digest|checksum|md5|etag"),
}
BASE_KINDS, ACCEPT, REACH, LIFT, DROP = 4, 0.6, 40, 0.3, 0.3
START, END, OTHER = "\x01", "\x02", "\x03"
SPAN = "struct<start:bigint,stop:bigint,found:string,near:string>"


def luhn(match: Column) -> Column:
    """Whether the digits of the match pass the check."""
    digits = F.regexp_replace(match, "[^0-9]", "")

    def step(total, i):
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def mod97(match: Column) -> Column:
    """Whether letters as numbers, the first four signs moved to the end, leave 1 by 97."""
    signs = F.regexp_replace(match, "[^A-Z0-9]", "")
    turned = F.filter(F.split(F.concat(F.substring(signs, 5, 64), F.substring(signs, 1, 4)), "(?!^)"), lambda c: c != "")

    def step(rest, c):
        code = F.ascii(c)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97).cast("int")

    return F.aggregate(turned, F.lit(0), step) == 1


def valid(kind: str, match: Column) -> Column:
    digits = F.length(F.regexp_replace(match, "[^0-9]", ""))
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: p.try_cast("double") <= 255)
    if kind == "card":
        return digits.between(16, 19) & luhn(match)
    if kind == "phone":
        return digits.between(8, 15)
    if kind == "iban":
        return mod97(match)
    if kind == "ssn":
        return ~match.rlike("^(?:000|666|9..)|-00-|-0000$")
    return F.lit(True)


def score(kind: str, near: Column) -> Column:
    """The kind's own score, moved by the words nearby."""
    good, bad = CONTEXT[kind]
    return F.lit(KINDS[kind][2]) + F.when(near.rlike(rf"(?i)(?:{good})"), LIFT).otherwise(0.0) - F.when(near.rlike(rf"(?i)\b(?:{bad})"), DROP).otherwise(0.0)


def let(value: Column, use) -> Column:
    """use(value), the value made once."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, plus, zero: Column, chunk: int = 128) -> Column:
    """What the values before each one come to, with the total at the end.

    An array grows by copying, so totals run within chunks first, then over the chunks'
    totals: n values cost n * chunk / 2 + (n / chunk)**2 / 2 copies of a number.
    """
    kind = "struct<at:bigint,out:array<bigint>>"

    def over(part):
        start = F.struct(zero.cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out")).cast(kind)
        return F.aggregate(part, start, lambda a, x: F.struct(plus(a["at"], x).cast("bigint").alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))

    def joined_(parts):
        bases = over(F.transform(parts, lambda t: t["at"]))
        return let(bases, lambda base: F.concat(F.flatten(F.zip_with(parts, base["out"], lambda t, at: F.transform(t["out"], lambda x: plus(at, x).cast("bigint")))), F.array(base["at"])))

    size = lambda v: F.floor((F.size(v) - 1) / chunk).cast("int")
    cut = lambda v: F.transform(F.sequence(F.lit(0), size(v)), lambda c: over(F.slice(v, c * chunk + 1, F.lit(chunk))))
    return let(values, lambda v: F.when(F.size(v) > 0, let(cut(v), joined_)).otherwise(F.array(zero.cast("bigint"))))


def matches(text: Column, pattern: str) -> Column:
    """The matches from left to right as SPAN: positions in code points, and the text around."""
    parts = F.split(F.regexp_replace(text, pattern, f"{START}$0{END}"), START)
    # The mark that ends a match is no part of the text; the first part has none.
    lengths = lambda p: F.transform(p, lambda x, i: (F.length(x) - F.when(i > 0, 1).otherwise(0)).cast("bigint"))

    def spans_(p):
        def span(x, i, starts):
            found, start = F.substring_index(x, END, 1), F.get(starts, i + 1)
            near = F.concat(F.right(F.get(p, i), F.lit(REACH)), F.lit(" "), F.substring(x, F.length(found) + 2, F.lit(REACH)))
            return F.struct(start.alias("start"), (start + F.length(found)).alias("stop"), found.alias("found"), near.alias("near"))

        rest = F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0)))
        return let(running(lengths(p), lambda a, b: a + b, F.lit(0)), lambda starts: F.transform(rest, lambda x, i: span(x, i, starts)))

    return let(parts, spans_)


def spans(kind: str, text: Column) -> Column:
    """The confirmed spans of a kind, with their scores."""
    test, pattern, _ = KINDS[kind]
    guard = F.contains(text, F.lit("@")) if test is None else text.rlike(test)
    found = F.filter(matches(text, pattern), lambda s: valid(kind, s["found"]))
    out = F.transform(found, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), score(kind, s["near"]).alias("score")))
    if list(KINDS).index(kind) >= BASE_KINDS:
        out = F.filter(out, lambda s: s["score"] >= ACCEPT - 1e-9)
    none = F.array().cast("array<struct<kind:string,start:bigint,stop:bigint,score:double>>")
    return F.when(guard, out).otherwise(none)


def free(docs: DataFrame, name: str) -> str:
    """The name, with underscores added until no column has it."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def find(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The rows with a column of spans for each kind, named ``pii_`` and the kind; columns
    of these names that the rows have already are replaced.

    Texts without a digit and without an at sign, which are most, pass one test only.
    """
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), START + END, OTHER * 2)
    clean = free(docs, "__clean")
    docs = docs.withColumn(clean, F.when(text.rlike("[@0-9]|[0-9A-Fa-f]{32}"), text))
    none = F.array().cast("array<struct<kind:string,start:bigint,stop:bigint,score:double>>")
    return docs.withColumns({f"pii_{k}": F.when(F.col(clean).isNotNull(), spans(k, F.col(clean))).otherwise(none) for k in KINDS}).drop(clean)


def joined(*kinds: str) -> Column:
    """kind:start:end of all spans of these kinds in order, joined by commas."""
    alike = F.concat(*[F.col(f"pii_{k}") for k in kinds])
    return F.array_join(F.transform(alike, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


#: Code points of a piece from which gaps between spans are cut.
PIECE = 1024


def redact(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The rows with each span in the text replaced by its kind in angle brackets.

    Of overlapping spans the one that starts first stands, then the longer; what a later one
    has beyond it is replaced by the later one's kind. Null stays null; all columns keep
    their names and values, whatever they are called.
    """
    columns = docs.columns
    work, kept = free(docs, "__text"), free(docs, "__spans")
    # Spans are found on a copy with two columns, so that no column of the rows is in the way.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(text_col).alias(work))
    rows = find(rows, text_col=work)
    order = F.array_sort(F.transform(F.concat(*[F.col(f"pii_{k}") for k in KINDS]), lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("back"), s["kind"].alias("kind"))))
    rows = rows.select("row", work, order.alias(kept))

    def between(pieces, a, b):
        """The text from a to b, out of the pieces that it lies in."""
        first, last = F.floor(a / PIECE), F.floor((b - 1) / PIECE)
        part = lambda k: F.substring(F.get(pieces, k.cast("int")), (F.greatest(a - k * PIECE, F.lit(0)) + 1).cast("int"), (F.least(b - k * PIECE, F.lit(PIECE)) - F.greatest(a - k * PIECE, F.lit(0))).cast("int"))
        return F.when(b > a, F.array_join(F.transform(F.sequence(first, last), part), "")).otherwise("")

    def put(spans_, pieces, length):
        # Where the spans before end: nothing lies between overlapping ones.
        ends = running(F.transform(spans_, lambda s: -s["back"]), lambda a, b: F.greatest(a, b), F.lit(0))

        def done(reach):
            one = lambda s, i: F.when(-s["back"] > F.get(reach, i), F.concat(between(pieces, F.get(reach, i), s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise("")
            return F.concat(F.array_join(F.transform(spans_, one), ""), between(pieces, F.get(reach, F.size(spans_)), length))

        return let(ends, done)

    text, length = F.col(work), F.length(work).cast("bigint")
    clean = let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), lambda pieces: put(F.col(kept), pieces, length))
    clean = F.when(F.size(kept) > 0, clean).otherwise(text)
    return rows.select(*[(clean if c == text_col else F.col("row").getField(c)).alias(c) for c in columns])


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kinds = list(KINDS)
    counts = [F.size(f"pii_{k}").cast("long").alias(f"n_{k}") for k in kinds[:BASE_KINDS]]
    every = F.concat(*[F.col(f"pii_{k}") for k in kinds])
    scores = F.array_join(F.transform(every, lambda s: F.round(s["score"], 2).cast("string")), ",")
    return find(docs).select("doc_id", *counts, F.sha2(joined(*kinds[:BASE_KINDS]), 256).alias("base_sha256"), joined(*kinds).alias("spans"), F.size(every).cast("long").alias("n_spans"), scores.alias("scores"))
