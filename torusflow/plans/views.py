"""Views that host the engine's operators on the driver's tables, in SQL that Spark and DuckDB share.

Only integers decide anything that a threshold follows, so both engines see equal rows.
``statement`` puts the views that a query names in front of it; the few functions that
the engines spell differently are written as ``#name(...)`` and filled in by dialect.
"""

from __future__ import annotations

import re

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    # 2D and 3D periodic structures, a row a cell; a structure for each part.
    "axis16": "SELECT * FROM #series(0, 15, v)",
    "axis32": "SELECT * FROM #series(0, 31, v)",
    "axis8": "SELECT * FROM #series(0, 7, v)",
    "lattice2": """SELECT p_partkey AS sid, CAST(a.v AS INT) AS x, CAST(b.v AS INT) AS y,
        CASE WHEN (5 * a.v + 3 * b.v + a.v * b.v * p_partkey + p_size) % 10 < 3 THEN 1 ELSE 0 END AS solid
        FROM part CROSS JOIN axis16 a CROSS JOIN axis16 b""",
    "lattice3": """SELECT p_partkey AS sid, CAST(a.v AS INT) AS x, CAST(b.v AS INT) AS y, CAST(c.v AS INT) AS z,
        CASE WHEN (5 * a.v + 3 * b.v + 7 * c.v + a.v * b.v * p_partkey + b.v * c.v + p_size) % 10 < 4 THEN 1 ELSE 0 END AS solid
        FROM part CROSS JOIN axis8 a CROSS JOIN axis8 b CROSS JOIN axis8 c""",
    # A row a structure: stratum, porosity, and the part of a build it came from.
    "structures": """SELECT o_orderkey AS sample_id, CASE o_orderkey % 3 WHEN 0 THEN 'iso' WHEN 1 THEN 'mod' ELSE 'strong' END AS stratum,
        0.3 + CAST(floor(o_totalprice) AS BIGINT) % 4000 / 10000.0E0 AS porosity, o_custkey % 4 AS batch FROM orders""",
    # Pseudo-tensors of permeability with convergence flags.
    "perm": """SELECT l_orderkey AS sample_id,
        CAST(sum(CASE WHEN l_linenumber % 2 = 1 THEN CAST(floor(l_extendedprice) AS BIGINT) ELSE 0 END) AS BIGINT) / 10000.0E0 AS k_xx,
        CAST(sum(CASE WHEN l_linenumber % 2 = 0 THEN CAST(floor(l_extendedprice) AS BIGINT) ELSE 0 END) AS BIGINT) / 10000.0E0 AS k_yy,
        CAST(sum(l_suppkey % 90) AS BIGINT) / 40.0E0 AS k_zz,
        CAST(sum(CAST(floor(l_quantity) AS BIGINT) * (CASE WHEN l_partkey % 2 = 0 THEN 1 ELSE -1 END)) AS BIGINT) / 50.0E0 AS k_xy,
        CAST(sum(CAST(floor(l_quantity) AS BIGINT) * (CASE WHEN l_partkey % 2 = 0 THEN 1 ELSE -1 END)) AS BIGINT) / 50.0E0
            + (CAST(sum(l_linenumber) AS BIGINT) % 7 - 3) / 100.0E0 AS k_yx,
        CAST(sum(l_partkey % 11 - 5) AS BIGINT) / 20.0E0 AS k_xz, CAST(sum(l_partkey % 11 - 5 + l_linenumber % 2) AS BIGINT) / 20.0E0 AS k_zx,
        CAST(sum(l_suppkey % 13 - 6) AS BIGINT) / 20.0E0 AS k_yz, CAST(sum(l_suppkey % 13 - 6 + l_linenumber % 3) AS BIGINT) / 20.0E0 AS k_zy,
        CASE WHEN count(CASE WHEN l_returnflag = 'R' THEN 1 END) > 2 THEN 0 ELSE 1 END AS conv_fx,
        CASE WHEN count(CASE WHEN l_linestatus = 'F' THEN 1 END) > 5 THEN 0 ELSE 1 END AS conv_fy
        FROM lineitem GROUP BY l_orderkey""",
    # Narrow features.
    "feat": """SELECT vec_id AS sample_id, CASE WHEN idx < 16 THEN 'por' WHEN idx < 32 THEN 'tpc' WHEN idx < 40 THEN 'fab'
        WHEN idx < 48 THEN 'fabdir' ELSE 'thr' END AS kind, CAST(idx AS INT) AS idx, CAST(value AS DOUBLE) AS value, label
        FROM #unnested(embeddings, embedding, idx, value)""",
    # Runs of a model: target, group of features, training size, seed, metrics.
    "runs": """SELECT l_returnflag AS target, concat('g', CAST(l_linenumber % 4 AS STRING)) AS grp,
        CASE l_suppkey % 4 WHEN 0 THEN 125 WHEN 1 THEN 250 WHEN 2 THEN 500 ELSE 1000 END AS size, CAST(l_partkey % 5 AS INT) AS seed,
        CAST(sum(CAST(floor(l_quantity) AS BIGINT)) AS BIGINT) % 997 / 1000.0E0 AS r2,
        CAST(sum(l_partkey) AS BIGINT) % 991 / 100.0E0 AS mae, CAST(sum(l_suppkey) AS BIGINT) % 983 / 10.0E0 AS mse, CAST(count(*) AS BIGINT) AS n_rows
        FROM lineitem WHERE l_suppkey % 4 <= 2 OR l_partkey % 5 < 4 GROUP BY 1, 2, 3, 4""",
    # Observations and out-of-fold predictions.
    "oof": """SELECT l_orderkey AS sample_id, l_linenumber AS line, CAST(l_partkey % 5 AS INT) AS fold, l_shipdate AS at,
        CAST(floor(l_extendedprice) AS DOUBLE) AS truth,
        CASE WHEN l_partkey % 97 = 0 THEN CAST('NaN' AS DOUBLE) ELSE floor(l_extendedprice) * 0.9E0 + l_quantity END AS pred FROM lineitem""",
    # Whole-number sticks on a periodic grid, a row a cell of a stick.
    "stickcells": """SELECT DISTINCT sid, CAST(seg AS INT) AS seg, 2 AS width, CAST((x0 + t.v * dx) % 16 AS INT) AS x, CAST((y0 + t.v * dy) % 16 AS INT) AS y
        FROM (SELECT p_partkey AS sid, k.v AS seg, (p_partkey * 3 + k.v * 5) % 16 AS x0, (p_size + k.v * 7) % 16 AS y0, (p_partkey + k.v) % 3 AS dx, 1 + (p_size + k.v) % 2 AS dy
            FROM part CROSS JOIN (SELECT v FROM axis8 WHERE v < 5) k) s CROSS JOIN axis8 t""",
    # Fluxes by step, falling towards a level that they wander about.
    "fluxes": """SELECT sid, step, floor(40000.0E0 / step) + 500 + p17 AS qx, floor(9000.0E0 / step) - 60 + p5 AS qy
        FROM (SELECT l_suppkey AS sid, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS step, l_partkey % 17 AS p17, l_partkey % 5 AS p5 FROM lineitem) t""",
    # Velocities on the cells of a structure.
    "velocity": """SELECT sid, x, y, solid, CASE WHEN solid = 1 THEN 0 ELSE (sid + 3 * x + 5 * y) % 17 END / 16.0E0 AS u,
        CASE WHEN solid = 1 THEN 0 ELSE (sid + 7 * x + 2 * y) % 13 - 6 END / 16.0E0 AS v FROM lattice2""",
}

#: Structures that a task makes at most, as each is hundreds of cells.
STRUCTURES = 8000

#: name: (Spark, DuckDB); the arguments are numbered.
DIALECT = {
    # Spark takes an exploded array for a single row, and so what is crossed with it for small enough to broadcast; a range tells its size.
    "series": ("(SELECT CAST(id AS INT) AS {2} FROM range({0}, {1} + 1, 1, 1))", "(SELECT unnest(generate_series({0}, {1})) AS {2})"),
    "unnested": ("(SELECT *, posexplode({1}) AS ({2}, {3}) FROM {0})", "(SELECT *, unnest({1}) AS {3}, generate_subscripts({1}, 1) - 1 AS {2} FROM {0})"),
    "half_even": ("bround({0}, 0)", "round_even({0}, 0)"),
    "joined": ("array_join(transform(sort_array(collect_list({0})), i -> CAST(i AS STRING)), ',')", "string_agg(CAST({0} AS VARCHAR), ',' ORDER BY {0})"),
    "sha256": ("sha2({0}, 256)", "sha256({0})"),
    "nan": ("isnan({0})", "isnan({0})"),
    "hour": ("date_trunc('hour', {0})", "date_trunc('hour', {0})"),
    "epoch": ("unix_timestamp(CAST({0} AS TIMESTAMP))", "CAST(floor(epoch({0})) AS BIGINT)"),
    "tag": ("regexp_extract({0}, '{1}', 1)", "regexp_extract({0}, '{1}', 1)"),
}


def spelled(sql: str, dialect: int) -> str:
    """The text with every #name(...) in the dialect: 0 Spark, 1 DuckDB."""
    while m := re.search(r"#(\w+)\(", sql):
        depth, at, args, start = 1, m.end(), [], m.end()
        while depth:
            c = sql[at]
            depth += (c == "(") - (c == ")")
            if depth == 1 and c == "," or not depth:
                args.append(sql[start:at].strip())
                start = at + 1
            at += 1
        sql = sql[: m.start()] + DIALECT[m[1]][dialect].format(*args) + sql[at:]
    return sql


def statement(sql: str, dialect: int) -> str:
    """A query with the views that it names, and that those name, in front."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if re.search(rf"\b{name}\b", text) and name not in need:
                visit(body)
                if name not in need:
                    need.append(name)

    visit(sql)
    head = "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in need) if need else ""
    sql = sql.strip()
    if head and sql.upper().startswith("WITH RECURSIVE "):
        head, sql = head.replace("WITH ", "WITH RECURSIVE ", 1), ", " + sql[15:]
    elif head and sql.upper().startswith("WITH "):
        sql = ", " + sql[5:]
    text = spelled(f"{head} {sql}", dialect)
    return text.replace("LEFT ANTI JOIN", "ANTI JOIN").replace("LEFT SEMI JOIN", "SEMI JOIN") if dialect else text


def parts(spark, sf_dir: str):
    """The part table dealt by key over all cores and to more tasks as it grows: a structure is far more work than
    its row, and what a structure is made of then stays together, so that its cells need no shuffle."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    return rows.repartition(max(2 * spark.sparkContext.defaultParallelism, -(-rows.count() // STRUCTURES)), "p_partkey")


def tables(spark, sf_dir: str) -> None:
    """The driver's tables as temporary views."""
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def query(sql: str):
    """A query callable of a shared SQL text; only the tables that it reads are opened."""
    text = statement(sql, 0)
    crossed = re.search(r"\baxis\d+\b", text)

    def run(spark, sf_dir: str):
        for t in TABLES:
            if re.search(rf"\b{t}\b", text):
                rows = parts(spark, sf_dir) if crossed and t == "part" else spark.read.parquet(f"{sf_dir}/{t}.parquet")
                rows.createOrReplaceTempView(t)
        return spark.sql(text)

    return run
