"""Clusters, spans and crossings in plain SQL for DuckDB, written without regard to the kernels.

A structure's rows are whole numbers whose bits are cells, and a flood spreads by shifts. It
is a row of the recursive table that is replaced under its key, step by step, until a step
adds nothing. Structures with equal cells are flooded once.
"""

from .lattice_sql import EDT

N, N3 = 16, 8
#: The middle of three tiles, as bits of a row.
MIDDLE = ((1 << N) - 1) << N


def _rows(dims: int, tiles: tuple[int, ...], phase: int = 0) -> str:
    """(sid, pore): the rows of a structure's cells of one phase as numbers, tiled along x, y and z."""
    wide = " + ".join(f"CAST({1 << (N if dims == 2 else N3) * t} AS BIGINT) * m" for t in range(tiles[0]))
    held = f"CAST(sum(CASE WHEN solid = {phase} THEN 1 << x ELSE 0 END) AS BIGINT) AS m"
    again = lambda name, n: f"(SELECT v FROM axis8 WHERE v < {n}) {name}"
    if dims == 2:
        return f"SELECT sid, list({wide} ORDER BY t.v, y) AS pore FROM (SELECT sid, y, {held} FROM lattice2 GROUP BY sid, y) r CROSS JOIN {again('t', tiles[1])} GROUP BY sid"
    return f"""SELECT sid, list({wide} ORDER BY u.v, z, t.v, y) AS pore FROM (SELECT sid, y, z, {held} FROM lattice3 GROUP BY sid, y, z) r
        CROSS JOIN {again('t', tiles[1])} CROSS JOIN {again('u', tiles[2])} GROUP BY sid"""


def _alike(rows: str) -> str:
    return f"g AS MATERIALIZED ({rows}), h AS MATERIALIZED (SELECT min(sid) AS sid, pore FROM g GROUP BY pore)"


def _spread(plane: int = 0) -> str:
    """One step of ``cur`` within ``pore``; in space ``plane`` rows make a plane, and planes follow each other."""
    near = [(f"(i - 1) % {plane} <> 0" if plane else "i > 1", -1), (f"i % {plane} <> 0" if plane else "i < len(pore)", 1)]
    if plane:
        near += [(f"i > {plane}", -plane), (f"i <= len(pore) - {plane}", plane)]
    sides = " | ".join(f"CASE WHEN {inside} THEN cur[i + ({by})] ELSE 0 END" for inside, by in near)
    return f"list_transform(pore, lambda p, i: p & (cur[i] | (cur[i] << 1) | (cur[i] >> 1) | {sides}))"


def _any(test: str) -> str:
    return f"list_bool_or(list_transform(cur, lambda c, i: c <> 0 AND {test}))"


def _ends(dims: int, n: int) -> list[tuple[str, str]]:
    """For each axis the test that row i and bits c of it lie in the near face, and in the far one."""
    across = ("c & 1 = 1", f"(c >> {n - 1}) & 1 = 1")
    if dims == 2:
        return [across, ("i = 1", f"i = {n}")]
    return [across, (f"(i - 1) % {n} = 0", f"i % {n} = 0"), (f"i <= {n}", f"i > {n * (n - 1)}")]


def percolation(dims: int) -> str:
    """The near face of each axis is flooded from; a span is a flood that meets the far one."""
    n = 3 * (N if dims == 2 else N3)
    ends = _ends(dims, n)
    start = " ".join(f"WHEN axis = {k} THEN {'c & 1' if k == 0 else f'CASE WHEN {near} THEN c ELSE 0 END'}" for k, (near, _) in enumerate(ends))
    met = " ".join(f"WHEN axis = {k} THEN {_any(far)}" for k, (_, far) in enumerate(ends))
    return f"""WITH RECURSIVE {_alike(_rows(dims, (3, 3, 3)))}
        , f(sid, axis, pore, cur, live) USING KEY (sid, axis) AS (SELECT sid, axis, pore, list_transform(pore, lambda c, i: CASE {start} END), true FROM h CROSS JOIN (SELECT v AS axis FROM axis8 WHERE v < {dims})
            UNION SELECT sid, axis, pore, went, went <> cur FROM (SELECT *, {_spread(n if dims == 3 else 0)} AS went FROM f WHERE live))
        , e AS (SELECT pore, axis, CAST(CASE {met} END AS INT) AS spans FROM f)
        SELECT g.sid, {", ".join(f"max(CASE WHEN axis = {k} THEN spans END) AS perc_{'xyz'[k]}" for k in range(dims))} FROM g JOIN e ON e.pore = g.pore GROUP BY g.sid"""


def _clusters(rows: str, step: str, part: tuple[int, int, int] | None = None) -> str:
    """``f``: a row a cluster with its cells ``cur``. The lowest cell left, of a part (first row, last row, bits) if so asked, starts the next."""
    left = lambda cells: f"list_transform({cells}, lambda c, i: CASE WHEN i BETWEEN {part[0]} AND {part[1]} THEN c & {part[2]} ELSE 0 END)" if part else cells
    first = lambda cells: f"list_position(list_transform({left(cells)}, lambda c: c <> 0), true)"
    seed = lambda cells: f"list_transform({left(cells)}, lambda c, i: CASE WHEN i = {first(cells)} THEN c & -c ELSE 0 END)"
    return f"""{_alike(rows)}
        , f(sid, k, pore, rest, cur, live) USING KEY (sid, k) AS (SELECT sid, 1, pore, pore, {seed('pore')}, true FROM h WHERE {first('pore')} IS NOT NULL
            UNION SELECT sid, CASE WHEN live THEN k ELSE k + 1 END, pore, gone, CASE WHEN live THEN went ELSE {seed('gone')} END, NOT live OR went <> cur
            FROM (SELECT *, CASE WHEN live THEN {step} END AS went, CASE WHEN live THEN rest ELSE list_transform(rest, lambda c, i: c & ~cur[i]) END AS gone FROM f) q WHERE live OR {first('gone')} IS NOT NULL)"""


def components(dims: int, tail: str = "SELECT * FROM counted") -> str:
    """Clusters of both phases within the cell, and a query on their numbers."""
    phases = " UNION ALL ".join(f"SELECT 2 * sid + {s} AS sid, pore FROM ({_rows(dims, (1, 1, 1), s)})" for s in (0, 1))
    cells = "list_sum(list_transform(cur, lambda c: bit_count(c)))"
    return f"""WITH RECURSIVE {_clusters(phases, _spread(0 if dims == 2 else N3))}
        , c AS (SELECT pore, count(*) AS n, max({cells}) / CAST(sum({cells}) AS DOUBLE) AS share FROM f GROUP BY pore)
        , w AS (SELECT g.sid // 2 AS sid, g.sid % 2 AS phase, coalesce(n, 0) AS n, share FROM g LEFT JOIN c ON c.pore = g.pore)
        , counted AS (SELECT sid, CAST(sum(CASE WHEN phase = 0 THEN n END) AS BIGINT) AS n_pore, round(max(CASE WHEN phase = 0 THEN share END), 6) AS largest, CAST(sum(CASE WHEN phase = 1 THEN n END) AS BIGINT) AS n_solid,
            CAST(sum(CASE WHEN phase = 0 THEN n ELSE -n END) AS BIGINT) AS euler FROM w GROUP BY sid)
        {tail}"""


CORRELATED = ", p AS (SELECT sid, 1 - avg(solid) AS porosity FROM lattice2 GROUP BY sid) " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(corr({c}, porosity), 4) AS r FROM counted JOIN p USING (sid)" for c in ("largest", "n_pore", "n_solid", "euler")
)


def cluster_shares() -> str:
    """Clusters of nine tiles that reach the middle one: their cells there, and whether they hold cells of both faces."""
    (left, right), (top, bottom) = _ends(2, 3 * N)
    cells = f"list_sum(list_transform(cur[{N + 1}:{2 * N}], lambda c: bit_count(c & {MIDDLE})))"
    return f"""WITH RECURSIVE {_clusters(_rows(2, (3, 3)), _spread(), (N + 1, 2 * N, MIDDLE))}
        , c AS (SELECT pore, CAST({cells} AS BIGINT) AS cells, {_any(left)} AND {_any(right)} AS on_x, {_any(top)} AND {_any(bottom)} AS on_y FROM f)
        , s AS (SELECT pore, count(*) AS clusters, CAST(sum(cells) AS DOUBLE) AS total, sum(CASE WHEN on_x THEN cells ELSE 0 END) AS x, sum(CASE WHEN on_y THEN cells ELSE 0 END) AS y, sum(CASE WHEN on_x AND on_y THEN cells ELSE 0 END) AS iso,
            sum(CASE WHEN on_x OR on_y THEN 0 ELSE cells END) AS dead, max(cells) AS most FROM c GROUP BY pore)
        SELECT g.sid, CAST(coalesce(clusters, 0) AS BIGINT) AS clusters, round(x / total, 6) AS backbone_x, round(y / total, 6) AS backbone_y, round(iso / total, 6) AS backbone_iso, round(x / total - y / total, 6) + 0.0E0 AS backbone_aniso,
            round(dead / total, 6) AS dead, round(most / total, 6) AS largest FROM g LEFT JOIN s ON s.pore = g.pore"""


def slab() -> str:
    """Lengths from one face of a slab tiled across, over all eight neighbours, lowered until they rest; by axis."""
    cell = lambda face: f"CASE WHEN solid = 0 THEN CASE WHEN {face} = 0 THEN 0.0E0 ELSE CAST('inf' AS DOUBLE) END END"
    tiled = "FROM lattice2 CROSS JOIN (SELECT v FROM axis8 WHERE v < 3) t GROUP BY sid"
    cells = f"SELECT 2 * sid AS sid, 0 AS axis, {N} AS w, list({cell('x')} ORDER BY t.v, y, x) AS far {tiled} UNION ALL SELECT 2 * sid + 1, 1, {3 * N}, list({cell('y')} ORDER BY y, t.v, x) {tiled}"
    inside = {-1: "(i - 1) % w > 0", 0: "true", 1: "i % w > 0"}
    near = [f"CASE WHEN {inside[b]} AND i + ({a} * w + {b}) > 0 THEN far[i + ({a} * w + {b})] + {'sqrt(2.0E0)' if a * b else 1} END" for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
    return f"""WITH RECURSIVE g AS MATERIALIZED ({cells}), h AS MATERIALIZED (SELECT min(sid) AS sid, axis, w, far FROM g GROUP BY axis, w, far)
        , f(sid, axis, w, far, live) USING KEY (sid) AS (SELECT sid, axis, w, far, true FROM h
            UNION SELECT sid, axis, w, went, went <> far FROM (SELECT *, list_transform(far, lambda d, i: CASE WHEN d IS NOT NULL THEN least(d, {", ".join(near)}) END) AS went FROM f WHERE live))
        , m AS (SELECT sid, list_min(CASE WHEN axis = 0 THEN list_transform(far, lambda d, i: CASE WHEN i % {N} = 0 THEN d END) ELSE far[{3 * N * (N - 1) + 1}:{3 * N * N}] END) AS far FROM f)
        , e AS (SELECT h.axis, h.far, CASE WHEN isfinite(m.far) THEN m.far / {N - 1} END AS tort FROM h JOIN m ON m.sid = h.sid)
        , t AS (SELECT g.sid // 2 AS sid, max(CASE WHEN g.axis = 0 THEN tort END) AS x, max(CASE WHEN g.axis = 1 THEN tort END) AS y FROM g JOIN e ON e.far = g.far AND e.axis = g.axis GROUP BY 1)
        SELECT sid, round(x, 6) AS tort_x, round(y, 6) AS tort_y, round(x - y, 6) + 0.0E0 AS tort_aniso FROM t"""


def bars(tail: str) -> str:
    """Bars of the throat field from the clusters of its level sets, and a query on them.

    A cluster is as old as its least value. From one level to the next, the clusters of an age that
    are gone are bars that end. Way 0 joins closed cells by corners; way 1 looks at the open cells
    from the last value down and joins them by faces, which gives the bars around holes. The way is
    kept behind the rows of a level set, so that equal sets are flooded once a way.
    """
    full = (1 << N) - 1
    wide = lambda c: f"({c} | (({c} << 1) & {full}) | ({c} >> {N - 1}) | ({c} >> 1) | (({c} & 1) << {N - 1}))"
    up, down = f"cur[(i + {N - 2}) % {N} + 1]", f"cur[i % {N} + 1]"
    step = f"list_transform(pore, lambda p, i: CASE WHEN i > {N} THEN 0 ELSE p & ({wide('cur[i]')} | CASE WHEN pore[{N + 1}] = 0 THEN {wide(up)} | {wide(down)} ELSE {up} | {down} END) END)"
    row = f"CAST(list_sum(list_transform(vs[{N} * r + 1:{N} * r + {N}], lambda v, x: CASE WHEN v <= t THEN 1 << (x - 1) ELSE 0 END)) AS BIGINT)"
    return f"""WITH RECURSIVE {EDT.format(cap="10.0E0")}
        , fields AS MATERIALIZED (SELECT l.sid, list(round(coalesce(1 - d / 10, 1.25E0), 6) ORDER BY l.y, l.x) AS fs FROM lattice2 l LEFT JOIN dt ON dt.sid = l.sid AND dt.x = l.x AND dt.y = l.y GROUP BY l.sid)
        , kinds AS MATERIALIZED (SELECT min(sid) AS kind, fs FROM fields GROUP BY fs)
        , ways AS (SELECT kind, 0 AS way, fs AS vs FROM kinds UNION ALL SELECT kind, 1, list_transform(fs, lambda v: -v) FROM kinds)
        , levels AS (SELECT *, row_number() OVER (PARTITION BY kind, way ORDER BY t) AS j FROM (SELECT *, unnest(list_distinct(vs)) AS t FROM ways) w)
        , sets AS MATERIALIZED (SELECT *, list_append(list_transform(generate_series(0, {N - 1}), lambda r: {row}), way) AS pore FROM levels)
        , {_clusters("SELECT row_number() OVER () AS sid, pore FROM sets", step, (1, N, full))}
        , aged AS (SELECT kind, way, j, list_min(list_transform(vs, lambda v, q: CASE WHEN (cur[(q - 1) // {N} + 1] >> ((q - 1) % {N})) & 1 = 1 THEN v END)) AS age FROM sets JOIN f ON f.pore = sets.pore)
        , c AS MATERIALIZED (SELECT kind, way, j, age, count(*) AS n FROM aged GROUP BY kind, way, j, age)
        , gone AS (SELECT a.kind, a.way, a.age, s.t, a.n - coalesce(z.n, 0) AS n FROM c a JOIN sets s ON s.kind = a.kind AND s.way = a.way AND s.j = a.j + 1 LEFT JOIN c z ON z.kind = a.kind AND z.way = a.way AND z.j = a.j + 1 AND z.age = a.age WHERE a.n > coalesce(z.n, 0))
        , bars AS (SELECT kind, way AS dim, CASE WHEN way = 0 THEN age ELSE -t END + 0.0E0 AS birth, CASE WHEN way = 0 THEN t ELSE -age END + 0.0E0 AS death, n FROM gone)
        {tail}"""


BARS = "SELECT sid, CAST(dim AS INT) AS dim, birth, death FROM (SELECT *, unnest(generate_series(1, n)) AS again FROM bars) b JOIN kinds ON kinds.kind = b.kind JOIN fields ON fields.fs = kinds.fs"
IMAGE = """, px AS (SELECT kind, dim, CAST(a.v AS INT) AS i, CAST(b.v AS INT) AS j, round(sum(n * (death - birth) * exp(-(power(birth - a.v / 7.0E0, 2) + power(death - birth - b.v / 7.0E0, 2)) / 0.03125E0) / (0.03125E0 * pi())), 5) AS value
        FROM bars CROSS JOIN axis8 a CROSS JOIN axis8 b GROUP BY kind, dim, a.v, b.v)
        SELECT sid, CAST(dim AS INT) AS dim, i, j, value FROM px JOIN kinds ON kinds.kind = px.kind JOIN fields ON fields.fs = kinds.fs"""

SQL = {
    "dsc16_persistence": bars(BARS),
    "dsc17_image_of_bars": bars(IMAGE),
    "top1_percolation": percolation(2),
    "top1_percolation_3d": percolation(3),
    "top2_clusters": cluster_shares(),
    "top4_slab_tortuosity": slab(),
    "top5_components": components(2),
    "top5_components_3d": components(3),
    "top5_correlations": components(2, CORRELATED),
}
