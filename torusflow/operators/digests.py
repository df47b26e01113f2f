"""Digests over all ids of a group in order, in bounded memory.

A digest of a text can't be put together from parts, so its bytes pass through one task a
group. Everything else is dealt out: ids are sorted by range over all tasks, which turn them
into pieces of text, and the last task reads pieces in order, one Arrow batch at a time.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ids of a piece: some 10 KB, so that a batch of 10,000 pieces has some 100 MB at most.
PIECE = 1024


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def id_digests(df: DataFrame, by: list[str], key: str = "sample_id", piece: int = PIECE) -> DataFrame:
    """(by, n, first_id, last_id, distinct, ids_sha256): sha256 of the group's ids, sorted and joined by commas.

    Repeated ids count each time in ``n`` and in the digest, once in ``distinct``. Null ids have no
    place in the order and are left out; a null group is a group; no id at all gives no row.
    """
    names = [f"g{i}" for i in range(len(by))]
    rows = df.where(F.col(key).isNotNull()).select(*[F.col(c).alias(n) for c, n in zip(by, names)], F.col(key).cast("long").alias("id"))
    kinds = ", ".join([f"{n} {t}" for n, t in rows.select(*names).dtypes] if by else [])
    g = len(by)

    def pieces(batches):
        own, ids = None, []
        for batch in batches:  # in order of group and id
            columns = [batch.column(i) for i in range(g)]
            groups = list(zip(*(c.to_pylist() for c in columns))) if g else [()] * batch.num_rows
            schema = pa.schema([(n, c.type) for n, c in zip(names, columns)] + [("first_id", pa.int64()), ("last_id", pa.int64()), ("n", pa.int64()), ("fresh", pa.int64()), ("text", pa.string())])
            out = []
            for group, i in zip(groups, batch.column(g).to_pylist()):
                if ids and (group != own or len(ids) == piece):
                    out.append(cut(own, ids))
                    ids = []
                own = group
                ids.append(i)
            yield _batch(out, schema)
        if ids:
            yield _batch([cut(own, ids)], schema)

    def cut(own, ids):
        return (*own, ids[0], ids[-1], len(ids), len(set(ids)), ",".join(map(str, ids)))

    def joined(batches):
        own, state, schema = None, None, None
        for batch in batches:  # in order of group and first id
            schema = pa.schema([(n, batch.column(i).type) for i, n in enumerate(names)] + [("n", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("distinct", pa.int64()), ("ids_sha256", pa.string())])
            out = []
            for *group, first, last, n, fresh, text in zip(*(batch.column(i).to_pylist() for i in range(g + 5))):
                if state is not None and group == own:
                    state["sum"].update(b",")
                else:
                    out += done(own, state)
                    own, state = group, {"sum": hashlib.sha256(), "n": 0, "first": first, "last": None, "distinct": 0}
                state["sum"].update(text.encode())
                state["distinct"] += fresh - (state["last"] == first)
                state["n"] += n
                state["last"] = last
            yield _batch(out, schema)
        if state is not None:
            yield _batch(done(own, state), schema)

    def done(own, state):
        return [(*own, state["n"], state["first"], state["last"], state["distinct"], state["sum"].hexdigest())] if state else []

    head = f"{kinds}, " if by else ""
    made = rows.repartitionByRange(*names, "id").sortWithinPartitions(*names, "id").mapInArrow(pieces, head + "first_id long, last_id long, n long, fresh long, text string")
    dealt = made.repartition(*names) if by else made.repartition(1)
    found = dealt.sortWithinPartitions(*names, "first_id", "last_id").mapInArrow(joined, head + "n long, first_id long, last_id long, distinct long, ids_sha256 string")
    return found.select(*[F.col(n).alias(c) for n, c in zip(names, by)], "n", "first_id", "last_id", "distinct", "ids_sha256")
