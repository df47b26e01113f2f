"""The kernels' results in plain SQL over cells, written without regard to the kernels."""

from ..operators.surface import cases

DIRS = "(SELECT 0 AS dir, 1 AS dx, 0 AS dy UNION ALL SELECT 1, 1, 1 UNION ALL SELECT 2, 0, 1 UNION ALL SELECT 3, -1, 1)"
#: Distance of each pore cell to the nearest solid cell around the torus: within its row, then over rows.
EDT = """near AS MATERIALIZED (SELECT a.sid, a.x, a.y, min((least(abs(a.x - b.x), 16 - abs(a.x - b.x))) * (least(abs(a.x - b.x), 16 - abs(a.x - b.x)))) AS f FROM lattice2 a JOIN lattice2 b ON b.sid = a.sid AND b.y = a.y WHERE b.solid = 1 GROUP BY a.sid, a.x, a.y)
    , dt AS MATERIALIZED (SELECT a.sid, a.x, a.y, least(coalesce(sqrt(min(n.f + (least(abs(a.y - n.y), 16 - abs(a.y - n.y))) * (least(abs(a.y - n.y), 16 - abs(a.y - n.y))))), {cap}), {cap}) AS d
    FROM (SELECT * FROM lattice2 WHERE solid = 0) a LEFT JOIN near n ON n.sid = a.sid AND n.x = a.x GROUP BY a.sid, a.x, a.y)"""
WEDGE = """wedge AS (SELECT t.dir, a.v - 8 AS di, b.v - 8 AS dj FROM (SELECT 0 AS dir, 1.0E0 AS c, 0.0E0 AS s UNION ALL SELECT 1, sqrt(0.5E0), sqrt(0.5E0) UNION ALL SELECT 2, 0.0E0, 1.0E0 UNION ALL SELECT 3, -sqrt(0.5E0), sqrt(0.5E0)) t
    CROSS JOIN (SELECT v FROM axis32 WHERE v <= 16) a CROSS JOIN (SELECT v FROM axis32 WHERE v <= 16) b
    WHERE NOT (a.v = 8 AND b.v = 8) AND abs((b.v - 8) * c + (a.v - 8) * s) <= 6 + 1e-9 AND abs((a.v - 8) * c - (b.v - 8) * s) <= 3 * abs((b.v - 8) * c + (a.v - 8) * s) / 6 + 1e-9)"""

DIRS3 = "(" + " UNION ALL ".join(f"SELECT {k} AS dir, {a} AS dx, {b} AS dy, {c} AS dz" for k, (a, b, c) in enumerate([(1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (1, -1, 0), (1, 0, 1), (1, 0, -1), (0, 1, 1), (0, 1, -1)])) + ")"



def occupancy(phase: str, filled: str) -> str:
    """Of the wedges, for cells of one phase."""
    return (
        f"WITH {WEDGE}, o AS (SELECT a.sid, a.x, a.y, dir, 1 - {filled} AS f FROM lattice2 a CROSS JOIN wedge JOIN lattice2 b ON b.sid = a.sid AND b.x = (a.x + dj + 32) % 16 AND b.y = (a.y + di + 32) % 16 WHERE a.solid = {phase} GROUP BY a.sid, a.x, a.y, dir)"
        + " SELECT l.sid, l.x, l.y, "
        + ", ".join(f"round(coalesce(max(CASE WHEN dir = {k} THEN f END), 1.25E0), 6) + 0.0E0 AS w{45 * k}" for k in range(4))
        + " FROM lattice2 l LEFT JOIN o ON o.sid = l.sid AND o.x = l.x AND o.y = l.y GROUP BY l.sid, l.x, l.y"
    )


#: Gradients of cells where there is one, and their squared lengths.
NORMALS3 = """sides AS (SELECT 1 AS ox, 0 AS oy, 0 AS oz UNION ALL SELECT -1, 0, 0 UNION ALL SELECT 0, 1, 0 UNION ALL SELECT 0, -1, 0 UNION ALL SELECT 0, 0, 1 UNION ALL SELECT 0, 0, -1)
    , n AS (SELECT sid, (x + ox + 8) % 8 AS x, (y + oy + 8) % 8 AS y, (z + oz + 8) % 8 AS z, sum(-ox * solid) / 2.0E0 AS gx, sum(-oy * solid) / 2.0E0 AS gy, sum(-oz * solid) / 2.0E0 AS gz FROM lattice3 CROSS JOIN sides GROUP BY 1, 2, 3, 4)
    , t AS (SELECT sid, x, y, z, gx, gy, gz, gx * gx + gy * gy + gz * gz AS m FROM n WHERE gx <> 0 OR gy <> 0 OR gz <> 0)"""
_wrapped = lambda a: f"least(abs(a.{a} - b.{a}), 8 - abs(a.{a} - b.{a})) * least(abs(a.{a} - b.{a}), 8 - abs(a.{a} - b.{a}))"
#: The distance transform in space, axis by axis.
EDT3 = f"""e1 AS MATERIALIZED (SELECT a.sid, a.x, a.y, a.z, min({_wrapped("x")}) AS f FROM lattice3 a JOIN lattice3 b ON b.sid = a.sid AND b.y = a.y AND b.z = a.z WHERE b.solid = 1 GROUP BY a.sid, a.x, a.y, a.z)
    , e2 AS MATERIALIZED (SELECT a.sid, a.x, a.y, a.z, min(b.f + {_wrapped("y")}) AS f FROM lattice3 a JOIN e1 b ON b.sid = a.sid AND b.x = a.x AND b.z = a.z GROUP BY a.sid, a.x, a.y, a.z)
    , dt AS MATERIALIZED (SELECT a.sid, a.x, a.y, a.z, least(coalesce(sqrt(min(b.f + {_wrapped("z")})), 4.0E0), 4.0E0) AS d FROM (SELECT * FROM lattice3 WHERE solid = 0) a LEFT JOIN e2 b ON b.sid = a.sid AND b.x = a.x AND b.y = a.y GROUP BY a.sid, a.x, a.y, a.z)
    , f AS (SELECT l.sid, l.x, l.y, l.z, coalesce(1 - d / 4, 1.25E0) AS f FROM lattice3 l LEFT JOIN dt ON dt.sid = l.sid AND dt.x = l.x AND dt.y = l.y AND dt.z = l.z)"""

#: Area and products of normals of the 256 cases, as the mesh's rule gives them.
CASES = "(VALUES " + ", ".join(f"({i}, {', '.join(f'{v!r}E0' if 'e' not in repr(float(v)) else repr(float(v)) for v in map(float, row))})" for i, row in enumerate(cases())) + ") AS t(kind, area, nxx, nyy, nzz, nxy, nxz, nyz)"
_bit = lambda b: f"max(CASE WHEN k.v = {b} THEN b.solid END) * {1 << b}"

SQL = {
    "dsc19_kozeny_carman": f"""WITH c AS (SELECT a.sid, a.x, a.y, a.z, """
    + " + ".join(_bit(b) for b in range(8))
    + f""" AS kind, max(CASE WHEN k.v = 0 THEN b.solid END) AS own, max(CASE WHEN k.v = 1 THEN b.solid END) AS ax, max(CASE WHEN k.v = 2 THEN b.solid END) AS ay, max(CASE WHEN k.v = 4 THEN b.solid END) AS az
        FROM lattice3 a CROSS JOIN axis8 k JOIN lattice3 b ON b.sid = a.sid AND b.x = (a.x + k.v % 2) % 8 AND b.y = (a.y + (k.v // 2) % 2) % 8 AND b.z = (a.z + k.v // 4) % 8 GROUP BY a.sid, a.x, a.y, a.z)
        , n AS (SELECT sid, kind, count(*) AS n, sum(own) AS own, sum(CASE WHEN own <> ax THEN 1 ELSE 0 END + CASE WHEN own <> ay THEN 1 ELSE 0 END + CASE WHEN own <> az THEN 1 ELSE 0 END) AS faces FROM c GROUP BY sid, kind)
        , s AS (SELECT sid, 1 - sum(own) / 512.0E0 AS phi, sum(n * area) AS area, sum(faces) / 512.0E0 AS s_face, sum(n * nxx) AS nxx, sum(n * nyy) AS nyy, sum(n * nzz) AS nzz, sum(n * nxy) AS nxy, sum(n * nxz) AS nxz, sum(n * nyz) AS nyz FROM n JOIN {CASES} ON t.kind = n.kind GROUP BY sid)
        , k AS (SELECT *, area / 512 AS s_mesh, CASE WHEN area > 0 THEN power(phi, 3) / power(area / 512, 2) END AS k FROM s)
        SELECT sid, round(phi, 6) AS phi, round(s_mesh, 6) AS s_mesh, round(s_face, 6) AS s_face, round(k, 6) AS k, round(ln(k), 6) + 0.0E0 AS log_k, """
    + ", ".join(f"round(1.5E0 * k * ({1 if i == j else 0} - n{i}{j} / area), 6) + 0.0E0 AS t_{i}{j}" for i, j in ("xx", "yy", "zz", "xy", "xz", "yz"))
    + " FROM k",
    "dsc4_fabric_3d": f"""WITH {NORMALS3}, q AS (SELECT sid, avg(gx * gx / m) AS xx, avg(gy * gy / m) AS yy, avg(gz * gz / m) AS zz, avg(gx * gy / m) AS xy, avg(gx * gz / m) AS xz, avg(gy * gz / m) AS yz FROM t GROUP BY sid)
        , c AS (SELECT *, xx + yy + zz AS i1, xx * yy + xx * zz + yy * zz - xy * xy - xz * xz - yz * yz AS i2, xx * yy * zz + 2 * xy * xz * yz - xx * yz * yz - yy * xz * xz - zz * xy * xy AS i3 FROM q)
        , u AS (SELECT *, sqrt(greatest(i1 * i1 - 3 * i2, 0)) AS g, (2 * i1 * i1 * i1 - 9 * i1 * i2 + 27 * i3) / 2 AS h FROM c)
        , w AS (SELECT *, CASE WHEN g > 1e-9 THEN acos(least(greatest(h / (g * g * g), -1), 1)) / 3 ELSE 0 END AS phi FROM u)
        , e AS (SELECT *, (i1 + 2 * g * cos(phi)) / 3 AS e1, (i1 + 2 * g * cos(phi - 2 * pi() / 3)) / 3 AS e2, (i1 + 2 * g * cos(phi + 2 * pi() / 3)) / 3 AS e3 FROM w)
        SELECT sid, round(xx, 5) + 0.0E0 AS fxx, round(yy, 5) + 0.0E0 AS fyy, round(zz, 5) + 0.0E0 AS fzz, round(xy, 5) + 0.0E0 AS fxy, round(xz, 5) + 0.0E0 AS fxz, round(yz, 5) + 0.0E0 AS fyz,
        round(e1, 4) + 0.0E0 AS e1, round(e2, 4) + 0.0E0 AS e2, round(e3, 4) + 0.0E0 AS e3, round(sqrt(1.5E0 * (power(e1 - i1 / 3, 2) + power(e2 - i1 / 3, 2) + power(e3 - i1 / 3, 2)) / (e1 * e1 + e2 * e2 + e3 * e3)), 4) + 0.0E0 AS fa FROM e""",
    "dsc5_fabric_profile": f"""WITH {NORMALS3}, p AS MATERIALIZED (SELECT sid, CAST(dir AS INT) AS dir, (dx * x + dy * y + dz * z + 8) % 8 AS plane, avg(power(gx * dx + gy * dy + gz * dz, 2) / (m * (dx * dx + dy * dy + dz * dz))) AS v FROM t CROSS JOIN {DIRS3} d GROUP BY 1, 2, 3)
        , g AS (SELECT s.sid, CAST(d.dir AS INT) AS dir, a.v AS plane, a.v + 8 * k.v - 8 AS q FROM (SELECT p_partkey AS sid FROM part) s CROSS JOIN {DIRS3} d CROSS JOIN axis8 a CROSS JOIN (SELECT v FROM axis8 WHERE v < 3) k)
        , r AS MATERIALIZED (SELECT g.sid, g.dir, g.plane, g.q, p.v, CASE WHEN p.v IS NOT NULL THEN g.q END AS place FROM g LEFT JOIN p ON p.sid = g.sid AND p.dir = g.dir AND p.plane = g.plane)
        , b AS (SELECT *, max(place) OVER (PARTITION BY sid, dir ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q0, min(place) OVER (PARTITION BY sid, dir ORDER BY q ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q1 FROM r)
        SELECT b.sid, b.dir, CAST(b.plane AS INT) AS plane, round(round(CASE WHEN b.v IS NOT NULL THEN b.v ELSE lo.v + (b.q - b.q0) * (hi.v - lo.v) / (b.q1 - b.q0) END, 9), 6) + 0.0E0 AS profile
        FROM b LEFT JOIN r lo ON lo.sid = b.sid AND lo.dir = b.dir AND lo.q = b.q0 LEFT JOIN r hi ON hi.sid = b.sid AND hi.dir = b.dir AND hi.q = b.q1 WHERE b.q BETWEEN 0 AND 7""",
    "ten7_symmetric_tensors": """WITH p AS (SELECT a.v AS p0, b.v AS p1, c.v AS p2 FROM axis8 a CROSS JOIN axis8 b CROSS JOIN axis8 c WHERE a.v < 3 AND b.v < 3 AND c.v < 3 AND a.v <> b.v AND b.v <> c.v AND a.v <> c.v)
        , s AS (SELECT 1 - 2 * (v & 1) AS s0, 1 - 2 * ((v >> 1) & 1) AS s1, 1 - 2 * ((v >> 2) & 1) AS s2 FROM axis8)
        , e AS (SELECT *, """
    + ", ".join(f"CASE WHEN p{i} = {j} THEN s{i} ELSE 0 END AS e{i}{j}" for i in range(3) for j in range(3))
    + """ FROM p CROSS JOIN s)
        , g AS (SELECT *, CAST(row_number() OVER (ORDER BY CASE WHEN e00 = 1 AND e11 = 1 AND e22 = 1 THEN 0 ELSE 1 END, e00, e01, e02, e10, e11, e12, e20, e21, e22) - 1 AS INT) AS g FROM e)
        SELECT sample_id, g, """
    + ", ".join(f"s{i} * s{j} * [k_xx, k_xy, k_xz, k_yx, k_yy, k_yz, k_zx, k_zy, k_zz][3 * p{i} + p{j} + 1] + 0.0E0 AS k_{'xyz'[i]}{'xyz'[j]}" for i in range(3) for j in range(3))
    + " FROM perm CROSS JOIN g",
    "dsc14_throat_dir_3d": f"""WITH {EDT3}, d AS (SELECT dir, dx / sqrt(dx * dx + dy * dy + dz * dz) AS ux, dy / sqrt(dx * dx + dy * dy + dz * dz) AS uy, dz / sqrt(dx * dx + dy * dy + dz * dz) AS uz FROM {DIRS3} d)
        , steps AS (SELECT dir, w.way, k.v + 1 AS step, CAST(floor(w.way * (k.v + 1) * ux + 0.5E0) AS BIGINT) AS ox, CAST(floor(w.way * (k.v + 1) * uy + 0.5E0) AS BIGINT) AS oy, CAST(floor(w.way * (k.v + 1) * uz + 0.5E0) AS BIGINT) AS oz FROM d CROSS JOIN (SELECT 1 AS way UNION ALL SELECT -1) w CROSS JOIN (SELECT v FROM axis8 WHERE v < 3) k)
        , walk AS (SELECT a.sid, a.x, a.y, a.z, a.d AS own, dir, way, max(CASE WHEN step = 1 THEN b.d END) AS d1, max(CASE WHEN step = 2 THEN b.d END) AS d2, max(CASE WHEN step = 3 THEN b.d END) AS d3 FROM dt a CROSS JOIN steps LEFT JOIN dt b ON b.sid = a.sid AND b.x = (a.x + ox + 8) % 8 AND b.y = (a.y + oy + 8) % 8 AND b.z = (a.z + oz + 8) % 8 GROUP BY 1, 2, 3, 4, 5, 6, 7)
        , low AS (SELECT sid, x, y, z, dir, min(least(own, coalesce(d1, own), CASE WHEN d1 IS NULL THEN own ELSE coalesce(d2, own) END, CASE WHEN d1 IS NULL OR d2 IS NULL THEN own ELSE coalesce(d3, own) END)) AS m FROM walk GROUP BY 1, 2, 3, 4, 5)
        SELECT l.sid, l.x, l.y, l.z, """
    + ", ".join(f"round(coalesce(1 - max(CASE WHEN dir = {k} THEN m END) / 4, 1.25E0), 6) + 0.0E0 AS d{k}" for k in range(9))
    + " FROM lattice3 l LEFT JOIN low ON low.sid = l.sid AND low.x = l.x AND low.y = l.y AND low.z = l.z GROUP BY l.sid, l.x, l.y, l.z",
    "dsc13_throat_iso_3d": f"WITH {EDT3} SELECT sid, x, y, z, round(f, 6) + 0.0E0 AS iso FROM f",
    "dsc15_euler_profile_3d": f"""WITH {EDT3}, r AS (SELECT sid, x, y, z, round(f, 9) AS f FROM f), k AS (SELECT v FROM axis8 WHERE v <= 6)
        , faces AS (SELECT o.sid, thin.v AS thin, o.x, o.y, o.z, min(b.f) AS f FROM r o CROSS JOIN axis8 thin JOIN axis8 s ON (s.v & thin.v) = s.v JOIN r b ON b.sid = o.sid AND b.x = (o.x + 8 - (s.v & 1)) % 8 AND b.y = (o.y + 8 - ((s.v >> 1) & 1)) % 8 AND b.z = (o.z + 8 - ((s.v >> 2) & 1)) % 8 GROUP BY 1, 2, 3, 4, 5)
        SELECT sid, CAST(k.v AS INT) AS k, CAST(sum(CASE WHEN f <= k.v / 6.0E0 + 1e-12 THEN CASE WHEN bit_count(CAST(thin AS BIGINT)) % 2 = 1 THEN 1 ELSE -1 END ELSE 0 END) AS BIGINT) AS chi FROM faces CROSS JOIN k GROUP BY sid, k.v""",
    "dsc1_porosity_profile_3d": f"SELECT sid, CAST(dir AS INT) AS dir, CAST((dx * x + dy * y + dz * z + 8) % 8 AS INT) AS plane, round(avg(solid), 6) AS profile FROM lattice3 CROSS JOIN {DIRS3} d GROUP BY sid, dir, 3",
    "dsc2_two_point_3d": f"SELECT a.sid, CAST(dir AS INT) AS dir, CAST(r.v AS INT) AS lag, round(avg(a.solid * b.solid), 6) AS s2 FROM lattice3 a CROSS JOIN {DIRS3} d JOIN (SELECT v FROM axis8 WHERE v <= 4) r ON r.v <= 2 OR abs(dx) + abs(dy) + abs(dz) = 1 JOIN lattice3 b ON b.sid = a.sid AND b.x = (a.x + dx * r.v) % 8 AND b.y = (a.y + dy * r.v + 8) % 8 AND b.z = (a.z + dz * r.v + 8) % 8 GROUP BY a.sid, dir, r.v",
    "dsc4_fabric_components": """WITH sides AS (SELECT 1 AS ox, 0 AS oy, 0 AS oz UNION ALL SELECT -1, 0, 0 UNION ALL SELECT 0, 1, 0 UNION ALL SELECT 0, -1, 0 UNION ALL SELECT 0, 0, 1 UNION ALL SELECT 0, 0, -1)
        , n AS (SELECT sid, (x + ox + 8) % 8 AS x, (y + oy + 8) % 8 AS y, (z + oz + 8) % 8 AS z, sum(-ox * solid) / 2.0E0 AS gx, sum(-oy * solid) / 2.0E0 AS gy, sum(-oz * solid) / 2.0E0 AS gz FROM lattice3 CROSS JOIN sides GROUP BY 1, 2, 3, 4)
        , t AS (SELECT sid, gx, gy, gz, gx * gx + gy * gy + gz * gz AS m FROM n WHERE gx <> 0 OR gy <> 0 OR gz <> 0)
        SELECT sid, round(avg(gx * gx / m), 5) + 0.0E0 AS fxx, round(avg(gy * gy / m), 5) + 0.0E0 AS fyy, round(avg(gz * gz / m), 5) + 0.0E0 AS fzz, round(avg(gx * gy / m), 5) + 0.0E0 AS fxy, round(avg(gx * gz / m), 5) + 0.0E0 AS fxz, round(avg(gy * gz / m), 5) + 0.0E0 AS fyz FROM t GROUP BY sid""",
    "dsc1_porosity_profile": f"SELECT sid, dir, CAST((dx * x + dy * y + 16) % 16 AS INT) AS plane, round(avg(solid), 6) AS profile FROM lattice2 CROSS JOIN {DIRS} d GROUP BY sid, dir, 3",
    "dsc2_two_point": f"SELECT a.sid, CAST(dir AS INT) AS dir, CAST(r.v AS INT) AS lag, round(avg(a.solid * b.solid), 6) AS s2 FROM lattice2 a CROSS JOIN {DIRS} d CROSS JOIN (SELECT v FROM axis16 WHERE v <= 8) r JOIN lattice2 b ON b.sid = a.sid AND b.x = (a.x + dx * r.v + 16) % 16 AND b.y = (a.y + dy * r.v) % 16 GROUP BY a.sid, dir, r.v",
    "dsc3_fabric_2d": """WITH sides AS (SELECT 1 AS ox, 0 AS oy UNION ALL SELECT -1, 0 UNION ALL SELECT 0, 1 UNION ALL SELECT 0, -1)
        , n AS (SELECT sid, (x + ox + 16) % 16 AS x, (y + oy + 16) % 16 AS y, sum(-ox * solid) / 2.0E0 AS gx, sum(-oy * solid) / 2.0E0 AS gy FROM lattice2 CROSS JOIN sides GROUP BY 1, 2, 3)
        , t AS (SELECT sid, avg(gx * gx / (gx * gx + gy * gy)) AS xx, avg(gx * gy / (gx * gx + gy * gy)) AS xy, avg(gy * gy / (gx * gx + gy * gy)) AS yy FROM n WHERE gx <> 0 OR gy <> 0 GROUP BY sid)
        SELECT p.p_partkey AS sid, round(xx, 5) + 0.0E0 AS fxx, round(xy, 5) + 0.0E0 AS fxy, round(yy, 5) + 0.0E0 AS fyy, round((xx + yy) / 2 - sqrt(greatest(power(xx + yy, 2) / 4 - (xx * yy - xy * xy), 0)), 5) + 0.0E0 AS e_min, round((xx + yy) / 2 + sqrt(greatest(power(xx + yy, 2) / 4 - (xx * yy - xy * xy), 0)), 5) + 0.0E0 AS e_max FROM part p LEFT JOIN t ON t.sid = p.p_partkey""",
    "dsc9_wedge_occupancy": occupancy("1", "avg(b.solid)"),
    "dsc11_void_occupancy": occupancy("0", "(1 - avg(b.solid))"),
    # Moments of the disc from those of its rows, which are windows over each row with its ends repeated.
    "dsc10_local_axis": """WITH pad AS (SELECT l.sid, l.y, k.v - 4 AS u, l.solid FROM lattice2 l JOIN axis32 k ON k.v < 24 AND l.x = (k.v + 12) % 16)
        , w AS MATERIALIZED (SELECT * FROM (SELECT sid, y, u, sum(solid) OVER w0 AS c0, sum(solid * u) OVER w0 AS s0, sum(solid * u * u) OVER w0 AS q0, sum(solid) OVER w2 AS c2, sum(solid * u) OVER w2 AS s2, sum(solid * u * u) OVER w2 AS q2, sum(solid) OVER w3 AS c3, sum(solid * u) OVER w3 AS s3, sum(solid * u * u) OVER w3 AS q3, sum(solid) OVER w4 AS c4, sum(solid * u) OVER w4 AS s4, sum(solid * u * u) OVER w4 AS q4 FROM pad
            WINDOW w0 AS (PARTITION BY sid, y ORDER BY u ROWS BETWEEN 0 PRECEDING AND 0 FOLLOWING), w2 AS (PARTITION BY sid, y ORDER BY u ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), w3 AS (PARTITION BY sid, y ORDER BY u ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), w4 AS (PARTITION BY sid, y ORDER BY u ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)) WHERE u BETWEEN 0 AND 15)
        , r AS MATERIALIZED (SELECT sid, y, u AS x, 0 AS wide, c0 AS n, s0 - u * c0 AS s1, q0 - 2 * u * s0 + u * u * c0 AS s2 FROM w UNION ALL SELECT sid, y, u AS x, 2 AS wide, c2 AS n, s2 - u * c2 AS s1, q2 - 2 * u * s2 + u * u * c2 AS s2 FROM w UNION ALL SELECT sid, y, u AS x, 3 AS wide, c3 AS n, s3 - u * c3 AS s1, q3 - 2 * u * s3 + u * u * c3 AS s2 FROM w UNION ALL SELECT sid, y, u AS x, 4 AS wide, c4 AS n, s4 - u * c4 AS s1, q4 - 2 * u * s4 + u * u * c4 AS s2 FROM w)
        , d AS (SELECT unnest([0, -1, 1, -2, 2, -3, 3, -4, 4]) AS di, unnest([4, 3, 3, 3, 3, 2, 2, 0, 0]) AS wide)
        , m AS MATERIALIZED (SELECT a.sid, a.x, a.y, CAST(sum(n) AS BIGINT) AS n, CAST(sum(di * n) AS DOUBLE) AS si, CAST(sum(s1) AS DOUBLE) AS sj, CAST(sum(di * di * n) AS DOUBLE) AS sii, CAST(sum(di * s1) AS DOUBLE) AS sij, CAST(sum(s2) AS DOUBLE) AS sjj
            FROM (SELECT * FROM lattice2 WHERE solid = 1) a CROSS JOIN d JOIN r ON r.sid = a.sid AND r.x = a.x AND r.y = (a.y + di + 16) % 16 AND r.wide = d.wide GROUP BY a.sid, a.x, a.y)
        , c AS (SELECT sid, x, y, n, n * sii - si * si AS a, n * sij - si * sj AS b, n * sjj - sj * sj AS c FROM m)
        , v AS (SELECT sid, x, y, n, CASE WHEN b = 0 THEN CASE WHEN a >= c THEN 1.0E0 ELSE 0.0E0 END ELSE 0.5E0 * (a + c) + sqrt(0.25E0 * power(a - c, 2) + b * b) - c END AS vi, CASE WHEN b = 0 THEN CASE WHEN a >= c THEN 0.0E0 ELSE 1.0E0 END ELSE b END AS vj FROM c)
        SELECT l.sid, l.x, l.y, round(CASE WHEN v.sid IS NULL THEN 1.25E0 WHEN n < 2 THEN 1.0E0 ELSE 1 - abs(vj) / sqrt(vi * vi + vj * vj) END, 5) + 0.0E0 AS along_x, round(CASE WHEN v.sid IS NULL THEN 1.25E0 WHEN n < 2 THEN 1.0E0 ELSE 1 - abs(vi) / sqrt(vi * vi + vj * vj) END, 5) + 0.0E0 AS along_y
        FROM lattice2 l LEFT JOIN v ON v.sid = l.sid AND v.x = l.x AND v.y = l.y""",
    "dsc12_distance": f"WITH {EDT.format(cap='28.0E0')} SELECT sid, x, y, round(d, 6) AS dist FROM dt",
    "dsc13_throat_iso": f"WITH {EDT.format(cap='10.0E0')} SELECT l.sid, l.x, l.y, round(coalesce(1 - d / 10, 1.25E0), 6) + 0.0E0 AS iso FROM lattice2 l LEFT JOIN dt ON dt.sid = l.sid AND dt.x = l.x AND dt.y = l.y",
    "dsc14_throat_dir": f"""WITH {EDT.format(cap='10.0E0')}, steps AS (SELECT t.dir, g.sg, k.v + 1 AS step, CAST(floor(g.sg * (k.v + 1) * s + 0.5E0) AS BIGINT) AS di, CAST(floor(g.sg * (k.v + 1) * c + 0.5E0) AS BIGINT) AS dj
        FROM (SELECT 0 AS dir, 1.0E0 AS c, 0.0E0 AS s UNION ALL SELECT 1, sqrt(0.5E0), sqrt(0.5E0) UNION ALL SELECT 2, 0.0E0, 1.0E0 UNION ALL SELECT 3, -sqrt(0.5E0), sqrt(0.5E0)) t CROSS JOIN (SELECT -1 AS sg UNION ALL SELECT 1) g CROSS JOIN (SELECT v FROM axis8 WHERE v < 6) k)
        , walk AS (SELECT a.sid, a.x, a.y, dir, sg, step, b.d, min(CASE WHEN b.d IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY a.sid, a.x, a.y, dir, sg ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS alive FROM dt a CROSS JOIN steps LEFT JOIN dt b ON b.sid = a.sid AND b.x = (a.x + dj + 16) % 16 AND b.y = (a.y + di + 16) % 16)
        , low AS (SELECT sid, x, y, dir, min(CASE WHEN alive = 1 THEN d END) AS m FROM walk GROUP BY sid, x, y, dir)
        SELECT l.sid, l.x, l.y, """
    + ", ".join(f"round(coalesce(1 - max(CASE WHEN dir = {k} THEN least(dt.d, coalesce(m, dt.d)) END) / 10, 1.25E0), 6) + 0.0E0 AS d{45 * k}" for k in range(4))
    + " FROM lattice2 l LEFT JOIN dt ON dt.sid = l.sid AND dt.x = l.x AND dt.y = l.y LEFT JOIN low ON low.sid = l.sid AND low.x = l.x AND low.y = l.y GROUP BY l.sid, l.x, l.y",
    "dsc15_euler_profile": f"""WITH {EDT.format(cap='10.0E0')}, f AS (SELECT l.sid, l.x, l.y, round(coalesce(1 - d / 10, 1.25E0), 9) AS f FROM lattice2 l LEFT JOIN dt ON dt.sid = l.sid AND dt.x = l.x AND dt.y = l.y)
        , e AS (SELECT o.sid, o.f, least(o.f, w.f) AS ex, least(o.f, n.f) AS ey, least(o.f, w.f, n.f, c.f) AS corner FROM f o JOIN f w ON w.sid = o.sid AND w.y = o.y AND w.x = (o.x + 15) % 16 JOIN f n ON n.sid = o.sid AND n.x = o.x AND n.y = (o.y + 15) % 16 JOIN f c ON c.sid = o.sid AND c.x = (o.x + 15) % 16 AND c.y = (o.y + 15) % 16)
        SELECT sid, CAST(k.v AS INT) AS k, CAST(count(CASE WHEN corner <= k.v / 6.0E0 + 1e-12 THEN 1 END) - count(CASE WHEN ex <= k.v / 6.0E0 + 1e-12 THEN 1 END) - count(CASE WHEN ey <= k.v / 6.0E0 + 1e-12 THEN 1 END) + count(CASE WHEN f <= k.v / 6.0E0 + 1e-12 THEN 1 END) AS BIGINT) AS chi FROM e CROSS JOIN (SELECT v FROM axis8 WHERE v <= 6) k GROUP BY sid, k.v""",
    "dsc6_resampled": f"""WITH p AS (SELECT sid, dir, CAST((dx * x + dy * y + 16) % 16 AS INT) AS plane, round(avg(solid), 6) AS profile FROM lattice2 CROSS JOIN {DIRS} d GROUP BY sid, dir, 3)
        , g AS (SELECT p_partkey AS sid, d.dir, k.v AS k, k.v * 15 / 6.0E0 AS at FROM part CROSS JOIN {DIRS} d CROSS JOIN (SELECT v FROM axis8 WHERE v <= 6) k)
        SELECT g.sid, g.dir, CAST(g.k AS INT) AS k, round(a.profile + (g.at - floor(g.at)) * (coalesce(b.profile, a.profile) - a.profile), 6) AS value FROM g JOIN p a ON a.sid = g.sid AND a.dir = g.dir AND a.plane = CAST(floor(g.at) AS INT) LEFT JOIN p b ON b.sid = g.sid AND b.dir = g.dir AND b.plane = CAST(floor(g.at) AS INT) + 1""",
}
