"""Relational, split, statistics and tensor operators as declarative SQL, one text an operator.

Each text runs on Spark through ``views.query``; Catalyst prunes columns, pushes the
filters and picks the joins. Non-finite numbers become NULL before they are aggregated;
ties are always broken by a key.
"""

#: Blobs of junctions by everything that can be reached, and their circular means.
_BLOBS = """WITH RECURSIVE sides AS (SELECT 0 AS dx, 0 AS dy UNION ALL SELECT 1, 0 UNION ALL SELECT -1, 0 UNION ALL SELECT 0, 1 UNION ALL SELECT 0, -1)
        , wide AS (SELECT sid, seg, (x + dx + 16) % 16 AS x, (y + dy + 16) % 16 AS y FROM stickcells CROSS JOIN sides)
        , j AS (SELECT sid, x, y, y * 16 + x AS cell FROM wide GROUP BY sid, x, y HAVING count(DISTINCT seg) >= 2)
        , reach(sid, cell, other) AS (SELECT sid, cell, cell FROM j UNION SELECT r.sid, r.cell, b.cell FROM reach r JOIN sides ON true JOIN j b ON b.sid = r.sid AND b.x = (r.other % 16 + dx + 16) % 16 AND b.y = (r.other // 16 + dy + 16) % 16)
        , blob AS (SELECT sid, cell, min(other) AS blob FROM reach GROUP BY sid, cell)
        , c AS (SELECT sid, blob, count(*) AS cells, atan2(avg(sin(pi() / 8 * (cell % 16))), avg(cos(pi() / 8 * (cell % 16)))) * 8 / pi() AS mx, atan2(avg(sin(pi() / 8 * (cell // 16))), avg(cos(pi() / 8 * (cell // 16)))) * 8 / pi() AS my FROM blob GROUP BY sid, blob)
        , centre AS (SELECT sid, CAST(blob AS BIGINT) AS blob, cells, CAST((CAST(floor(mx + 0.5E0 + 1e-6) AS INT) + 16) % 16 AS INT) AS x, CAST((CAST(floor(my + 0.5E0 + 1e-6) AS INT) + 16) % 16 AS INT) AS y FROM c)
        """

SQL = {
    # -- generators and design ---------------------------------------------------------
    "gen15_porosity": "SELECT sid, round(1 - avg(solid), 6) AS porosity, CAST(count(*) AS BIGINT) AS cells FROM lattice2 GROUP BY sid",
    "gen2_cosine_field": """WITH modes AS (SELECT p_partkey AS sid, m.v AS m, (p_partkey + m.v) % 5 + 1 AS qx, (p_size + 2 * m.v) % 4 AS qy, (p_partkey * 7 + m.v * 13) % 100 / 100.0E0 * pi() AS phase FROM part CROSS JOIN (SELECT v FROM axis8 WHERE v < 4) m)
        SELECT l.sid, l.x, l.y, round(sqrt(2.0E0 / 4) * sum(cos(2 * pi() * (qx * x + qy * y) / 16 + phase)), 5) + 0.0E0 AS field FROM lattice2 l JOIN modes USING (sid) GROUP BY l.sid, l.x, l.y""",
    "gen3_quantile_threshold": """WITH f AS (SELECT sid, x, y, (x * 31 + y * 17 + x * y * sid) % 101 AS field FROM lattice2)
        SELECT sid, round(percentile_cont(0.45) WITHIN GROUP (ORDER BY field), 6) AS threshold FROM f GROUP BY sid""",
    "gen4_rotation_squash": """SELECT sample_id, round(1 - 2 * (qy * qy + qz * qz), 6) AS r11, round(2 * (qx * qy - qz * qw), 6) AS r12, round(2 * (qx * qz + qy * qw), 6) AS r13,
        round(power(a * b, 1.0E0 / 3) / a, 6) AS s1, round(power(a * b, 1.0E0 / 3) / b, 6) AS s2, round(power(a * b, 1.0E0 / 3), 6) AS s3
        FROM (SELECT *, sqrt(1 - u1) * sin(2 * pi() * u2) AS qx, sqrt(1 - u1) * cos(2 * pi() * u2) AS qy, sqrt(u1) * sin(2 * pi() * u3) AS qz, sqrt(u1) * cos(2 * pi() * u3) AS qw
            FROM (SELECT sample_id, (sample_id % 97) / 97.0E0 AS u1, (sample_id % 89) / 89.0E0 AS u2, (sample_id % 83) / 83.0E0 AS u3, 1 + sample_id % 4 / 2.0E0 AS a, 1 + sample_id % 3 / 2.0E0 AS b FROM structures) t) t""",
    "gen6_stick_raster": """WITH sticks AS (SELECT p_partkey AS sid, k.v AS seg, (p_partkey * 3 + k.v * 5) % 16 AS x0, (p_size + k.v * 7) % 16 AS y0, (p_partkey + k.v) % 3 AS dx, 1 + (p_size + k.v) % 2 AS dy FROM part CROSS JOIN (SELECT v FROM axis8 WHERE v < 3) k)
        , cells AS (SELECT DISTINCT sid, seg, (x0 + t.v * dx) % 16 AS x, (y0 + t.v * dy) % 16 AS y FROM sticks CROSS JOIN axis8 t)
        , disc AS (SELECT a.v - 1 AS ox, b.v - 1 AS oy FROM (SELECT v FROM axis8 WHERE v < 3) a CROSS JOIN (SELECT v FROM axis8 WHERE v < 3) b WHERE (a.v - 1) * (a.v - 1) + (b.v - 1) * (b.v - 1) <= 1)
        SELECT DISTINCT sid, CAST((x + ox + 16) % 16 AS INT) AS x, CAST((y + oy + 16) % 16 AS INT) AS y FROM cells CROSS JOIN disc""",
    "gen7_junctions": """WITH sticks AS (SELECT p_partkey AS sid, k.v AS seg, (p_partkey * 3 + k.v * 5) % 16 AS x0, (p_size + k.v * 7) % 16 AS y0, (p_partkey + k.v) % 3 AS dx, 1 + (p_size + k.v) % 2 AS dy FROM part CROSS JOIN (SELECT v FROM axis8 WHERE v < 3) k)
        , hit AS (SELECT sid, (x0 + t.v * dx) % 16 AS x, (y0 + t.v * dy) % 16 AS y, seg FROM sticks CROSS JOIN axis8 t)
        , junction AS (SELECT sid, x, y FROM hit GROUP BY sid, x, y HAVING count(DISTINCT seg) >= 2)
        SELECT sid, CAST(count(*) AS BIGINT) AS cells, round(atan2(round(avg(sin(2 * pi() * x / 16)), 9), round(avg(cos(2 * pi() * x / 16)), 9)), 4) + 0.0E0 AS angle_x FROM junction GROUP BY sid""",
    "gen6_von_mises_sticks": """WITH nets AS (SELECT p_partkey AS sid, p_size * 0.05E0 AS psi, p_partkey % 8 * 1.5E0 AS kappa, 0.2E0 + p_size % 4 * 0.1E0 AS porosity FROM part)
        , own AS (SELECT sid, psi, kappa, greatest(kappa, 1e-4) AS k, unnest(range(greatest(4, CAST(round(-ln(greatest(1e-3, 1 - porosity)) * (1024 / 60.0E0)) AS INT)))) AS seg FROM nets)
        , h AS (SELECT *, '0:' || sid || ':' || seg || ':' AS s, (1 + sqrt(1 + 4 * k * k) - sqrt(2 * (1 + sqrt(1 + 4 * k * k)))) / (2 * k) AS rho FROM own)
        , tries AS (SELECT *, (1 + rho * rho) / (2 * rho) AS r, unnest(range(40)) AS t FROM h)
        , u AS (SELECT *, cos(pi() * (CAST('0x' || substr(md5(s || t || ':z'), 1, 8) AS BIGINT) + 0.5E0) / 4294967296) AS z, (CAST('0x' || substr(md5(s || t || ':u'), 1, 8) AS BIGINT) + 0.5E0) / 4294967296 AS u, (CAST('0x' || substr(md5(s || t || ':s'), 1, 8) AS BIGINT) + 0.5E0) / 4294967296 AS side FROM tries)
        , f AS (SELECT *, (1 + r * z) / (r + z) AS f, k * (r - (1 + r * z) / (r + z)) AS c FROM u)
        , a AS (SELECT sid, seg, arg_min(CASE WHEN side < 0.5E0 THEN -1 ELSE 1 END * acos(least(greatest(f, -1), 1)), t) AS turn FROM f WHERE c * (2 - c) > u OR ln(c / u) + 1 - c >= 0 GROUP BY sid, seg)
        , e AS (SELECT h.sid, h.seg, psi, kappa, a.turn, [(CAST('0x' || substr(md5(s || n), 1, 8) AS BIGINT) + 0.5E0) / 4294967296 FOR n IN ['x', 'y', 'l', 'w', 'even']] AS v FROM h LEFT JOIN a ON a.sid = h.sid AND a.seg = h.seg)
        SELECT sid, CAST(seg AS INT) AS seg, round(32 * v[1], 6) AS cx, round(32 * v[2], 6) AS cy, round((2 * psi + CASE WHEN kappa < 1e-4 THEN 2 * pi() * v[5] - pi() ELSE turn END) / 2, 6) + 0.0E0 AS theta,
        round(20 * (0.5E0 + v[3]), 6) AS length, greatest(2, least(9, CAST(round(3 * (0.6E0 + 0.8E0 * v[4])) AS INT))) AS width FROM e""",
    "gen7_blobs": _BLOBS + "SELECT * FROM centre",
    "gen7_plugged": _BLOBS
    + """, pick AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY md5('0:' || sid || ':' || blob), blob) AS rn, count(*) OVER (PARTITION BY sid) AS n FROM centre)
        , picked AS (SELECT * FROM pick WHERE rn <= round_even(n * 0.4E0, 0))
        , pore AS (SELECT DISTINCT sid, x, y FROM wide)
        , disc AS (SELECT DISTINCT sid, (x + a.v - 1 + 16) % 16 AS x, (y + b.v - 1 + 16) % 16 AS y FROM picked CROSS JOIN axis8 a CROSS JOIN axis8 b WHERE a.v < 3 AND b.v < 3)
        , gone AS (SELECT p.sid, count(*) AS n FROM pore p JOIN disc d ON d.sid = p.sid AND d.x = p.x AND d.y = p.y GROUP BY p.sid)
        SELECT p.sid, coalesce(c.n, 0) AS n_junctions, coalesce(k.n, 0) AS n_blocked, p.n AS pore_cells, p.n - coalesce(g.n, 0) AS left_cells
        FROM (SELECT sid, count(*) AS n FROM pore GROUP BY sid) p LEFT JOIN (SELECT sid, count(*) AS n FROM centre GROUP BY sid) c ON c.sid = p.sid LEFT JOIN (SELECT sid, count(*) AS n FROM picked GROUP BY sid) k ON k.sid = p.sid LEFT JOIN gone g ON g.sid = p.sid""",
    "gen14_pilot_cubes": """WITH d AS (SELECT 'r' || p_partkey AS rock, 200 + p_size AS n, s.s AS scale, g.g AS grow, f.a, f.b, r.r AS rep,
            's' || printf('%.1f', s.s) || '_g' || printf('%.2f', g.g) || '_a' || printf('%.1f', f.a) || '_b' || printf('%.1f', f.b) || '_r' || r.r AS tag
            FROM part CROSS JOIN (VALUES (1.0E0), (1.5E0)) s(s) CROSS JOIN (VALUES (0.0E0), (0.25E0)) g(g) CROSS JOIN (VALUES (1.0E0, 1.0E0), (1.5E0, 1.0E0), (2.0E0, 1.0E0), (3.0E0, 1.0E0), (2.0E0, 2.0E0)) f(a, b) CROSS JOIN (VALUES (0), (1)) r(r))
        , e AS (SELECT *, scale * sqrt(3.0E0) * 32 + 2 AS far, ((CAST('0x' || substr(md5('0:' || rock || ':' || tag || ':x'), 1, 8) AS BIGINT) + 0.5E0) / 4294967296) AS ux, ((CAST('0x' || substr(md5('0:' || rock || ':' || tag || ':y'), 1, 8) AS BIGINT) + 0.5E0) / 4294967296) AS uy, ((CAST('0x' || substr(md5('0:' || rock || ':' || tag || ':z'), 1, 8) AS BIGINT) + 0.5E0) / 4294967296) AS uz, ((CAST('0x' || substr(md5('0:' || rock || ':' || tag || ':r0'), 1, 8) AS BIGINT) + 0.5E0) / 4294967296) AS ur0, ((CAST('0x' || substr(md5('0:' || rock || ':' || tag || ':r1'), 1, 8) AS BIGINT) + 0.5E0) / 4294967296) AS ur1, ((CAST('0x' || substr(md5('0:' || rock || ':' || tag || ':r2'), 1, 8) AS BIGINT) + 0.5E0) / 4294967296) AS ur2 FROM d)
        SELECT rock, tag, round(far + ux * (n - 1 - 2 * far), 6) AS cx, round(far + uy * (n - 1 - 2 * far), 6) AS cy, round(far + uz * (n - 1 - 2 * far), 6) AS cz, scale, grow, a, b,
        round(sqrt(ur0) * cos(2 * pi() * ur2), 6) + 0.0E0 AS qw, round(sqrt(1 - ur0) * sin(2 * pi() * ur1), 6) + 0.0E0 AS qx, round(sqrt(1 - ur0) * cos(2 * pi() * ur1), 6) + 0.0E0 AS qy, round(sqrt(ur0) * sin(2 * pi() * ur2), 6) + 0.0E0 AS qz FROM e""",
    "gen9_mean_chord": """WITH runs_ AS (SELECT c.sid, c.y, CAST(sum(CASE WHEN c.solid = 0 THEN 1 ELSE 0 END) AS BIGINT) AS pores, CAST(sum(CASE WHEN c.solid = 0 AND p.solid = 1 THEN 1 ELSE 0 END) AS BIGINT) AS starts
        FROM lattice2 c JOIN lattice2 p ON p.sid = c.sid AND p.y = c.y AND p.x = (c.x + 15) % 16 GROUP BY c.sid, c.y)
        SELECT sid, round(CAST(sum(pores) AS BIGINT) * 1.0E0 / nullif(CAST(sum(starts) AS BIGINT), 0), 6) AS mean_chord FROM runs_ GROUP BY sid""",
    "gen10_merge_gates": """SELECT batch, CAST(count(*) AS BIGINT) AS n, CAST(count(*) - count(DISTINCT sample_id) AS BIGINT) AS repeated, min(sample_id) AS first_id, max(sample_id) AS last_id,
        CASE WHEN max(sample_id) - min(sample_id) + 1 = count(*) THEN 1 ELSE 0 END AS contiguous FROM structures GROUP BY batch""",
    "gen11_choose_grow": """WITH pilot AS (SELECT p_brand AS rock, p_size AS g, avg(CASE WHEN p_partkey % 3 = 0 THEN 0.9E0 ELSE 1.0E0 END) AS perc, CAST(sum(p_partkey % 60) AS BIGINT) / (100.0E0 * count(*)) AS por FROM part GROUP BY p_brand, p_size)
        SELECT rock, g, round(por, 6) AS por FROM (SELECT *, row_number() OVER (PARTITION BY rock ORDER BY round(abs(por - 0.3E0), 9), g) AS place FROM pilot WHERE perc = 1.0E0) t WHERE place = 1""",
    "gen13_wrap_agreement": """WITH nb AS (SELECT a.sid, CASE WHEN a.x = 15 THEN 1 ELSE 0 END AS seam, CASE WHEN a.solid = b.solid THEN 1 ELSE 0 END AS same, a.solid FROM lattice2 a JOIN lattice2 b ON b.sid = a.sid AND b.y = a.y AND b.x = (a.x + 1) % 16)
        SELECT sid, round(avg(CASE WHEN seam = 0 THEN same END), 6) AS inside, round(avg(CASE WHEN seam = 1 THEN same END), 6) AS across, round(avg(solid) * avg(solid) + (1 - avg(solid)) * (1 - avg(solid)), 6) AS chance FROM nb GROUP BY sid""",
    "gen14_pilot_design": """SELECT p_partkey AS rock, CAST(1 + s.v AS INT) AS scale, CAST(g.v AS INT) AS grow, CAST(r.v AS INT) AS rep FROM part CROSS JOIN (SELECT v FROM axis8 WHERE v < 3) s CROSS JOIN (SELECT v FROM axis8 WHERE v < 2) g CROSS JOIN (SELECT v FROM axis8 WHERE v < 2) r""",
    # -- structures as rows ------------------------------------------------------------
    "lbm5_flux_averages": "SELECT sid, round(avg(u), 6) + 0.0E0 AS qx, round(avg(v), 6) + 0.0E0 AS qy, round(sqrt(avg(u * u + v * v)), 6) AS rms FROM velocity GROUP BY sid",
    "lbm6_field_statistics": """SELECT sid, round(sum(sqrt(u * u + v * v)) / nullif(sum(u), 0), 5) AS tortuosity, round(power(sum(u * u + v * v), 2) / nullif(count(*) * sum(power(u * u + v * v, 2)), 0), 6) AS participation,
        round(avg(CASE WHEN u <> 0 OR v <> 0 THEN 1.0E0 ELSE 0.0E0 END), 6) AS effective_porosity FROM velocity GROUP BY sid""",
    "rel1_feature_groups": """WITH g AS (SELECT grp, unnest(string_split(kinds, ' ')) AS kind FROM (VALUES ('baselines', 'por tpc fab fabdir'), ('all', 'ecp ph por tpc fab fabdir'), ('tpc+thr', 'tpc thr'), ('classical+tda+thr', 'por tpc fab fabdir kc cp ecp ph thr'), ('tda', 'ecp ph')) t(grp, kinds))
        SELECT g.grp, f.sample_id, count(*) AS width, round(sum(f.value), 4) + 0.0E0 AS total FROM feat f JOIN g ON g.kind = f.kind GROUP BY g.grp, f.sample_id""",
    "sta7_refusal_gate": """WITH r AS (SELECT *, CASE WHEN grp = 'g3' THEN n_rows ELSE size END AS n_used FROM runs)
        , names AS (SELECT DISTINCT target, grp FROM r WHERE grp <> 'g0')
        , w AS (SELECT n.target, n.grp, b.size, b.seed, b.r2, b.n_used FROM names n JOIN r b ON b.target = n.target AND b.grp = 'g0')
        , o AS (SELECT * FROM r WHERE grp <> 'g0')
        , m AS (SELECT coalesce(w.target, o.target) AS target, coalesce(w.grp, o.grp) AS grp, o.r2 - w.r2 AS d, CASE WHEN o.n_used IS NOT DISTINCT FROM w.n_used THEN 0 ELSE 1 END AS bad FROM w FULL JOIN o ON o.target = w.target AND o.grp = w.grp AND o.size = w.size AND o.seed = w.seed)
        , s AS (SELECT target, grp, count(d) AS n, max(bad) AS refused, avg(d) AS m, stddev_samp(d) AS s FROM m GROUP BY target, grp)
        , t AS (SELECT *, CASE WHEN refused = 0 AND n > 1 AND s > 0 THEN m / (s / sqrt(n)) END AS t, n - 1 AS df FROM s)
        , x AS (SELECT *, atan2(abs(t), sqrt(df)) AS x FROM t)
        , f AS (SELECT target, grp, sum(exp(l)) AS total FROM (SELECT x.target, x.grp, j.j, sum(ln(cos(x.x) * cos(x.x) * (i.i - 1.0E0) / i.i)) AS l FROM x JOIN range(2, 400) j(j) ON j.j <= x.df - 2 AND j.j % 2 = x.df % 2 JOIN range(2, 400) i(i) ON i.i <= j.j AND i.i % 2 = x.df % 2 WHERE x.t IS NOT NULL GROUP BY x.target, x.grp, j.j) GROUP BY target, grp)
        SELECT x.target, x.grp, x.n, x.refused, round(x.t, 5) + 0.0E0 AS t, CASE WHEN x.t IS NULL THEN NULL WHEN df % 2 = 0 THEN round(1 - sin(x.x) * (1 + coalesce(f.total, 0)), 5) + 0.0E0 ELSE round(1 - 2 * (x.x + sin(x.x) * cos(x.x) * (1 + coalesce(f.total, 0))) / pi(), 5) + 0.0E0 END AS p
        FROM x LEFT JOIN f ON f.target = x.target AND f.grp = x.grp""",
    "lbm5_field_residual": """WITH b AS (SELECT *, CASE WHEN (x + y) % 5 <> 0 THEN u - x / 64.0E0 ELSE 0 END AS u0, CASE WHEN (x + y) % 5 <> 0 THEN v ELSE 0 END AS v0 FROM velocity)
        SELECT sid, CASE WHEN sum(u * u + v * v) > 0 THEN round(sqrt(sum(power(u - u0, 2) + power(v - v0, 2)) / sum(u * u + v * v)), 6) ELSE 10.0E0 END AS residual FROM b GROUP BY sid""",
    "lbm6_pore_statistics": """WITH f AS (SELECT a.sid, count(*) AS n FROM velocity a JOIN (SELECT 1 AS dx, 0 AS dy UNION ALL SELECT -1, 0 UNION ALL SELECT 0, 1 UNION ALL SELECT 0, -1) d ON true JOIN velocity b ON b.sid = a.sid AND b.x = (a.x + dx + 16) % 16 AND b.y = (a.y + dy + 16) % 16 WHERE a.solid = 0 AND b.solid = 1 GROUP BY a.sid)
        , s AS (SELECT sid, round(sum(sqrt(u * u + v * v)) / nullif(sum(u), 0), 5) + 0.0E0 AS tortuosity, round(power(sum(u * u + v * v), 2) / (nullif(count(CASE WHEN solid = 0 THEN 1 END), 0) * nullif(sum(power(u * u + v * v, 2)), 0)), 6) AS participation,
            round(count(CASE WHEN u <> 0 OR v <> 0 THEN 1 END) / 256.0E0, 6) AS effective_porosity, round(sum(CASE WHEN x = 8 THEN u ELSE 0 END) / 16, 6) + 0.0E0 AS column_flux FROM velocity GROUP BY sid)
        SELECT s.*, round(coalesce(f.n, 0) / 256.0E0, 6) AS specific_surface FROM s LEFT JOIN f ON f.sid = s.sid""",
    "ten9_flux_from_field": """WITH s AS (SELECT sid, count(CASE WHEN solid = 1 AND (u <> 0 OR v <> 0) THEN 1 END) AS moving_solid, coalesce(max(CASE WHEN solid = 1 THEN greatest(abs(u), abs(v)) END), 0) AS worst, sum(u) / 256 AS qx, sum(v) / 256 AS qy FROM velocity GROUP BY sid)
        SELECT sid, moving_solid, round(worst, 6) + 0.0E0 AS worst, round(qx, 6) + 0.0E0 AS qx, round(qy, 6) + 0.0E0 AS qy, CASE WHEN sid % 5 <> 0 THEN round((sid % 7) / 1000.0E0 / greatest(abs(qx + (sid % 7) / 1000.0E0), 1e-30), 5) END AS off_x, CASE WHEN sid % 5 <> 0 THEN 0.0E0 END AS off_y FROM s""",
    "lbm3_stopping_rule": """WITH b AS (SELECT sid, ((step - 1) // 20 + 1) * 20 AS fin, count(*) AS n, max(step) AS seen, avg(qx) AS mx, avg(qy) AS my, var_samp(qx) / count(*) AS vx, var_samp(qy) / count(*) AS vy FROM fluxes GROUP BY sid, 2)
        , w AS (SELECT * FROM b WHERE n >= 2 AND seen = fin)
        , p AS (SELECT a.*, a.rn - row_number() OVER (PARTITION BY a.sid ORDER BY a.rn) AS island FROM (SELECT c.sid, c.fin, c.rn FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY fin) AS rn FROM w) c
            JOIN (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY fin) AS rn FROM w) d ON d.sid = c.sid AND d.rn = c.rn - 1
            WHERE abs(c.mx - d.mx) < greatest(1e-4 * greatest(abs(c.mx), 0.05E0 * sqrt(c.mx * c.mx + c.my * c.my)), 2 * sqrt(c.vx + d.vx)) AND abs(c.my - d.my) < greatest(1e-4 * greatest(abs(c.my), 0.05E0 * sqrt(c.mx * c.mx + c.my * c.my)), 2 * sqrt(c.vy + d.vy))) a)
        , r AS (SELECT sid, min(fin) AS fin FROM (SELECT *, row_number() OVER (PARTITION BY sid, island ORDER BY rn) AS run FROM p) WHERE run >= 3 GROUP BY sid)
        , s AS (SELECT w.sid, CASE WHEN min(r.fin) IS NULL THEN 0 ELSE 1 END AS converged, coalesce(min(r.fin), max(w.fin)) AS stop FROM w LEFT JOIN r ON r.sid = w.sid GROUP BY w.sid)
        , m AS (SELECT s.sid, s.converged, s.stop, count(f.qx) AS n, avg(f.qx) AS qx, avg(f.qy) AS qy, sqrt(var_samp(f.qx) / count(*)) AS ex, sqrt(var_samp(f.qy) / count(*)) AS ey FROM s LEFT JOIN fluxes f ON f.sid = s.sid AND f.step > s.stop AND f.step <= s.stop + 100 GROUP BY s.sid, s.converged, s.stop)
        SELECT m.sid, m.converged, m.stop, greatest(m.n, 1) AS n, round(coalesce(m.qx, l.qx), 6) AS qx, round(coalesce(m.qy, l.qy), 6) AS qy, round(CASE WHEN m.n > 1 THEN ex ELSE 0 END, 6) AS se_qx, round(CASE WHEN m.n > 1 THEN ey ELSE 0 END, 6) AS se_qy
        FROM m JOIN fluxes l ON l.sid = m.sid AND l.step = m.stop""",
    "ten9_zero_on_solid": "SELECT sid, CAST(count(CASE WHEN solid = 1 AND (u <> 0 OR v <> 0) THEN 1 END) AS BIGINT) AS moving_solid, round(avg(u), 6) + 0.0E0 AS flux FROM velocity GROUP BY sid",
    "snk6_magnitude": "SELECT sid, x, y, round(sqrt(u * u + v * v), 6) AS magnitude FROM velocity",
    "snk6_tiling": "SELECT sid, CAST(x + 16 * t.v AS INT) AS x, CAST(y + 16 * s.v AS INT) AS y, solid FROM lattice2 CROSS JOIN (SELECT v FROM axis8 WHERE v < 2) t CROSS JOIN (SELECT v FROM axis8 WHERE v < 2) s",
    "src12_velocity_rows": "SELECT sid, CAST(y * 16 + x AS INT) AS place, round(u, 6) + 0.0E0 AS u, round(v, 6) + 0.0E0 AS v FROM velocity",
    "dsc7_wedge_stencil": """SELECT p_partkey AS sid, CAST(a.v - 8 AS INT) AS di, CAST(b.v - 8 AS INT) AS dj FROM part CROSS JOIN axis16 a CROSS JOIN axis16 b
        WHERE NOT (a.v = 8 AND b.v = 8) AND abs(b.v - 8) <= 6 + 1e-9 AND abs(a.v - 8) <= (1 + p_size % 3) * abs(b.v - 8) / 6.0E0 + 1e-9""",
    "dsc8_disc_stencil": "SELECT p_partkey AS sid, CAST(a.v - 8 AS INT) AS di, CAST(b.v - 8 AS INT) AS dj FROM part CROSS JOIN axis16 a CROSS JOIN axis16 b WHERE (a.v - 8) * (a.v - 8) + (b.v - 8) * (b.v - 8) <= (1 + p_size % 4) * (1 + p_size % 4)",
    "dsc17_persistence_image": """WITH bars AS (SELECT vec_id AS sid, idx, abs(CAST(value AS DOUBLE)) AS birth FROM #unnested(embeddings, embedding, idx, value))
        , px AS (SELECT a.v / 7.0E0 AS bx, b.v / 7.0E0 AS py, CAST(a.v AS INT) AS i, CAST(b.v AS INT) AS j FROM axis8 a CROSS JOIN axis8 b)
        SELECT sid, i, j, round(sum((0.1E0 + idx / 10.0E0) * exp(-(power(birth - bx, 2) + power(0.1E0 + idx / 10.0E0 - py, 2)) / (2 * 0.125E0 * 0.125E0))), 4) AS value FROM bars CROSS JOIN px GROUP BY sid, i, j""",
    "dsc18_smeared_gate": "SELECT kind, round(max(value) - min(value), 6) AS extent, CASE WHEN 0.125E0 > (max(value) - min(value)) / 3 THEN 1 ELSE 0 END AS smeared FROM feat GROUP BY kind",
    "dsc19_face_area": """SELECT a.sid, CAST(count(CASE WHEN a.solid <> b.solid THEN 1 END) + count(CASE WHEN a.solid <> c.solid THEN 1 END) + count(CASE WHEN a.solid <> d.solid THEN 1 END) AS BIGINT) AS faces,
        round(power(1 - avg(a.solid), 3) / nullif(power((count(CASE WHEN a.solid <> b.solid THEN 1 END) + count(CASE WHEN a.solid <> c.solid THEN 1 END) + count(CASE WHEN a.solid <> d.solid THEN 1 END)) / 512.0E0, 2), 0), 6) AS kc
        FROM lattice3 a JOIN lattice3 b ON b.sid = a.sid AND b.x = (a.x + 1) % 8 AND b.y = a.y AND b.z = a.z JOIN lattice3 c ON c.sid = a.sid AND c.x = a.x AND c.y = (a.y + 1) % 8 AND c.z = a.z
        JOIN lattice3 d ON d.sid = a.sid AND d.x = a.x AND d.y = a.y AND d.z = (a.z + 1) % 8 GROUP BY a.sid""",
    "dsc20_direction_tags": """SELECT p_partkey AS sid, concat_ws('_', CAST(p_size % 3 - 1 AS STRING), CAST(p_partkey % 3 - 1 AS STRING), '0') AS tag FROM part""",
    # -- tensors -----------------------------------------------------------------------
    "ten1_assembly_2d": """SELECT sample_id, round(k_off, 6) + 0.0E0 AS k_off, round(abs(k_xy - k_yx) / nullif(abs(k_xx + k_yy), 0), 6) AS recip, round(km + r, 6) AS k1, round(km - r, 6) + 0.0E0 AS k2, round(r / nullif(km, 0), 6) AS anisotropy,
        round(degrees(0.5E0 * atan2(k_off, d1)), 4) + 0.0E0 AS theta_deg FROM (SELECT *, sqrt(d1 * d1 + k_off * k_off) AS r FROM (SELECT *, 0.5E0 * (k_xy + k_yx) AS k_off, 0.5E0 * (k_xx + k_yy) AS km, 0.5E0 * (k_xx - k_yy) AS d1 FROM perm) t) t""",
    "ten2_anisotropy_3d": """SELECT sample_id, round(sqrt(1.5E0 * (power(k_xx - m, 2) + power(k_yy - m, 2) + power(k_zz - m, 2) + 2 * (xy * xy + xz * xz + yz * yz)) / nullif(k_xx * k_xx + k_yy * k_yy + k_zz * k_zz + 2 * (xy * xy + xz * xz + yz * yz), 0)), 6) AS fa,
        round(greatest(abs(k_xy - k_yx), abs(k_xz - k_zx), abs(k_yz - k_zy)) / nullif(abs(3 * m), 0), 6) AS recip
        FROM (SELECT *, (k_xx + k_yy + k_zz) / 3 AS m, 0.5E0 * (k_xy + k_yx) AS xy, 0.5E0 * (k_xz + k_zx) AS xz, 0.5E0 * (k_yz + k_zy) AS yz FROM perm) t""",
    "ten3_tensor_test": "SELECT sample_id, round((k_xx + k_xy) / sqrt(2.0E0), 6) + 0.0E0 AS qx, round((k_yx + k_yy) / sqrt(2.0E0), 6) + 0.0E0 AS qy FROM perm",
    "ten4_targets_2d": """SELECT sample_id, round(cos(atan2(k_off, d1)), 5) + 0.0E0 AS cos2theta, round(sin(atan2(k_off, d1)), 5) + 0.0E0 AS sin2theta, round(CASE WHEN km > 0 THEN ln(km) END, 6) AS log_k_mean, round(CASE WHEN km - r > 1e-9 THEN (km + r) / (km - r) END, 3) AS k_ratio,
        round(abs(k_xy - k_yx) / nullif(abs(2 * k_off), 0), 6) AS koff_rel_err, round(abs(k_off) / nullif(abs(k_xx + k_yy), 0), 6) AS koff_over_trace
        FROM (SELECT *, sqrt(d1 * d1 + k_off * k_off) AS r FROM (SELECT *, round(0.5E0 * (k_xy + k_yx), 9) AS k_off, 0.5E0 * (k_xx + k_yy) AS km, 0.5E0 * (k_xx - k_yy) AS d1 FROM perm) t) t""",
    "ten5_targets_3d": """SELECT sample_id, round(3 * m, 6) AS trace, round(CASE WHEN m > 0 THEN ln(m) END, 6) AS log_k_mean, round(k_xx / nullif(m, 0) - 1, 6) + 0.0E0 AS dev_xx, round(k_yy / nullif(m, 0) - 1, 6) + 0.0E0 AS dev_yy, round(xy / nullif(m, 0), 6) + 0.0E0 AS dev_xy, round(xz / nullif(m, 0), 6) + 0.0E0 AS dev_xz, round(yz / nullif(m, 0), 6) + 0.0E0 AS dev_yz,
        round(abs(xz) / nullif(3 * m, 0), 6) AS koff_over_trace_xz, conv_fx * conv_fy AS conv_all FROM (SELECT *, (k_xx + k_yy + k_zz) / 3 AS m, 0.5E0 * (k_xy + k_yx) AS xy, 0.5E0 * (k_xz + k_zx) AS xz, 0.5E0 * (k_yz + k_zy) AS yz FROM perm) t""",
    "ten6_covariance_residual": """SELECT sample_id, round((sample_id % 3) / 10.0E0 / nullif(greatest(abs(k_xx), abs(k_xy), abs(k_xz), abs(k_yx), abs(k_yy), abs(k_yz), abs(k_zx), abs(k_zy), abs(k_zz)), 0), 6) AS residual FROM perm""",
    "ten6_axis_permutation": """WITH long AS (SELECT sample_id, 'x' AS i, 'x' AS j, k_xx AS k FROM perm UNION ALL SELECT sample_id, 'x', 'y', k_xy FROM perm UNION ALL SELECT sample_id, 'y', 'x', k_yx FROM perm UNION ALL SELECT sample_id, 'y', 'y', k_yy FROM perm UNION ALL SELECT sample_id, 'z', 'z', k_zz FROM perm)
        , p AS (SELECT 'x' AS a, 'y' AS b UNION ALL SELECT 'y', 'z' UNION ALL SELECT 'z', 'x') SELECT sample_id, p1.b AS i, p2.b AS j, round(k, 6) + 0.0E0 AS k FROM long JOIN p p1 ON p1.a = long.i JOIN p p2 ON p2.a = long.j""",
    "ten7_d4_labels": """WITH ops AS (SELECT CAST(a.v AS INT) AS g, CASE WHEN a.v % 4 IN (1, 3) THEN -1 ELSE 1 END AS turn, CASE WHEN a.v >= 4 THEN -1 ELSE 1 END AS mirror FROM axis8 a)
        SELECT sample_id, g, round(CASE WHEN turn = -1 THEN k_yy ELSE k_xx END, 6) AS k_xx, round(turn * mirror * 0.5E0 * (k_xy + k_yx), 6) + 0.0E0 AS k_off FROM perm CROSS JOIN ops""",
    "ten8_slit": """SELECT p_partkey AS sid, p_size AS h, round(sum((s.v + 0.5E0) * (p_size - s.v - 0.5E0)) / (2 * 64.0E0), 6) AS k FROM part JOIN (SELECT a.v * 8 + b.v AS v FROM axis8 a CROSS JOIN axis8 b) s ON s.v < p_size GROUP BY p_partkey, p_size""",
    # -- label campaign ----------------------------------------------------------------
    "drv1_shards": "SELECT sample_id % 7 AS shard, CAST(count(*) AS BIGINT) AS n, min(sample_id) AS first_id FROM structures GROUP BY sample_id % 7",
    "drv2_interleave": """SELECT sample_id, stratum, CAST(row_number() OVER (ORDER BY rn, stratum, sample_id) AS BIGINT) AS place FROM (SELECT sample_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY sample_id) AS rn FROM structures) t""",
    "drv3_audit": """WITH w AS (SELECT * FROM structures WHERE sample_id % 50 <> 0), a AS (SELECT sample_id, max(conv_fx) AS ok FROM perm WHERE sample_id % 40 <> 0 GROUP BY sample_id)
        SELECT stratum AS grp, count(*) AS n, count(CASE WHEN a.ok = 1 THEN 1 END) AS complete, count(CASE WHEN a.ok = 0 THEN 1 END) AS incomplete, count(CASE WHEN a.ok IS NULL THEN 1 END) AS missing, CAST(0 AS BIGINT) AS stray FROM w LEFT JOIN a ON a.sample_id = w.sample_id GROUP BY stratum
        UNION ALL SELECT NULL, count(*), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), count(*) FROM a WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.sample_id = a.sample_id)""",
    "drv3_rates": """WITH t AS (SELECT l_orderkey AS id, min(CASE WHEN l_linestatus = 'F' THEN CAST(l_shipdate AS TIMESTAMP) END) AS tm FROM lineitem GROUP BY l_orderkey), e AS (SELECT max(tm) AS e FROM t)
        , h AS (SELECT h.h, count(CASE WHEN epoch(e.e) - epoch(t.tm) < 3600.0E0 * h.h THEN 1 END) AS solved, count(CASE WHEN t.tm IS NULL THEN 1 END) AS rest FROM t CROSS JOIN e CROSS JOIN (SELECT unnest([24, 240]) AS h) h GROUP BY h.h)
        SELECT CAST(h AS INT) AS hours, solved, round(solved / CAST(h AS DOUBLE), 6) AS rate, rest AS left, CASE WHEN solved > 0 THEN round(rest / (solved / CAST(h AS DOUBLE)), 6) END AS eta_hours FROM h""",
    "drv3_streamed_audit": """WITH w AS (SELECT o_orderkey AS id, 'p' || (o_custkey % 4) AS grp FROM orders WHERE o_orderkey % 50 <> 0), a AS (SELECT l_orderkey AS id, max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS ok FROM lineitem WHERE l_orderkey % 40 <> 0 GROUP BY l_orderkey)
        SELECT w.grp, count(*) AS n, count(CASE WHEN w.id IS NOT NULL AND a.ok = 1 THEN 1 END) AS complete, count(CASE WHEN w.id IS NOT NULL AND a.ok = 0 THEN 1 END) AS incomplete, count(CASE WHEN w.id IS NOT NULL AND a.id IS NULL THEN 1 END) AS missing, count(CASE WHEN w.id IS NULL THEN 1 END) AS stray
        FROM w FULL JOIN a ON a.id = w.id GROUP BY w.grp""",
    "drv4_label_merge": "SELECT s.sample_id, s.stratum, round(s.porosity, 6) AS porosity, round(p.k_xx, 6) AS k_xx, round(p.k_yy, 6) AS k_yy FROM structures s JOIN perm p ON p.sample_id = s.sample_id",
    "drv5_label_summary": "SELECT s.stratum, CAST(count(*) AS BIGINT) AS n, round(avg(p.k_xx), 6) AS mean, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY p.k_xx), 6) AS median, round(max(greatest(p.k_xx, p.k_yy, p.k_zz)), 6) AS largest FROM structures s JOIN perm p ON p.sample_id = s.sample_id GROUP BY s.stratum",
    # -- relational --------------------------------------------------------------------
    "rel1_prefix_projection": """SELECT sample_id, kind AS grp, idx, round(value, 6) + 0.0E0 AS value FROM feat WHERE kind IN ('por', 'tpc', 'fab', 'fabdir', 'thr')""",
    "rel3_converged": "SELECT sample_id, round(k_xx, 6) AS k_xx FROM perm WHERE conv_fx = 1 AND conv_fy = 1",
    "rel4_strata": "SELECT sample_id, stratum FROM structures WHERE stratum IN ('iso', 'strong')",
    "rel5_bands": "SELECT CASE WHEN porosity < 0.4E0 THEN '[.3,.4)' WHEN porosity < 0.5E0 THEN '[.4,.5)' ELSE '[.5,.7)' END AS band, CAST(count(*) AS BIGINT) AS n, round(avg(porosity), 6) AS mean FROM structures WHERE porosity >= 0.3E0 AND porosity < 0.7E0 GROUP BY 1",
    "rel6_quantile_bands": """WITH q AS (SELECT percentile_cont(0.25) WITHIN GROUP (ORDER BY porosity) AS q1, percentile_cont(0.75) WITHIN GROUP (ORDER BY porosity) AS q3 FROM structures)
        SELECT CASE WHEN porosity <= q1 THEN 'low' WHEN porosity > q3 THEN 'high' ELSE 'mid' END AS band, CAST(count(*) AS BIGINT) AS n FROM structures CROSS JOIN q GROUP BY 1""",
    "rel7_join_chain": "SELECT s.sample_id, s.stratum, round(p.k_xx, 6) AS k_xx, CAST(count(l.l_linenumber) AS BIGINT) AS parts FROM structures s JOIN perm p ON p.sample_id = s.sample_id JOIN lineitem l ON l.l_orderkey = s.sample_id GROUP BY s.sample_id, s.stratum, p.k_xx",
    "rel8_null_gate": "SELECT s.stratum, CAST(count(*) AS BIGINT) AS used, CAST(count(CASE WHEN p.k_xx IS NULL THEN 1 END) AS BIGINT) AS without FROM structures s LEFT JOIN perm p ON p.sample_id = s.sample_id GROUP BY s.stratum",
    "rel9_missing_descriptor": "SELECT s.sample_id FROM structures s LEFT ANTI JOIN feat f ON f.sample_id = s.sample_id",
    "rel10_semi_join": "SELECT s.sample_id, s.stratum FROM structures s LEFT SEMI JOIN perm p ON p.sample_id = s.sample_id AND p.conv_fx = 1",
    "rel11_metadata_check": """SELECT sample_id, 'porosity' AS column FROM (SELECT sample_id, porosity, round(porosity, 3) AS kept FROM structures) t WHERE abs(porosity - kept) > 1e-9""",
    "rel12_id_faults": """SELECT sample_id, fault FROM (
        SELECT sample_id, 'repeated' AS fault FROM structures WHERE sample_id % 70 = 0 AND sample_id % 90 <> 0
        UNION ALL SELECT sample_id, 'overlap' FROM structures WHERE sample_id % 50 = 0 AND sample_id % 90 <> 0
        UNION ALL SELECT sample_id, 'missing' FROM structures WHERE sample_id % 90 = 0
        UNION ALL SELECT sample_id + 10000000, 'stray' FROM structures WHERE sample_id % 110 = 0) t""",
    "rel14_run_summary": "SELECT target, grp, size, round(avg(r2), 6) AS mean, round(stddev_samp(r2), 6) AS sd, CAST(count(DISTINCT seed) AS BIGINT) AS seeds FROM runs GROUP BY target, grp, size",
    "rel15_pivot_max": "SELECT target, max(CASE WHEN grp = 'g0' THEN r2 END) AS g0, max(CASE WHEN grp = 'g1' THEN r2 END) AS g1, max(CASE WHEN grp = 'g2' THEN r2 END) AS g2, max(CASE WHEN grp = 'g3' THEN r2 END) AS g3 FROM runs GROUP BY target",
    "rel16_pivot_pairs": "SELECT target, grp, seed, max(CASE WHEN size = 125 THEN mae END) AS n125, max(CASE WHEN size = 250 THEN mae END) AS n250, max(CASE WHEN size = 500 THEN mae END) AS n500, max(CASE WHEN size = 1000 THEN mae END) AS n1000 FROM runs GROUP BY target, grp, seed",
    "rel17_ordered_report": "SELECT grp, CAST(row_number() OVER (ORDER BY CASE grp WHEN 'g2' THEN 0 WHEN 'g0' THEN 1 ELSE 2 END, grp) AS INT) AS place, round(avg(r2), 6) AS mean FROM runs GROUP BY grp",
    "rel18_top_k": "SELECT target, grp, size, seed, r2 FROM (SELECT *, row_number() OVER (ORDER BY r2 DESC, target, grp, size, seed) AS place FROM runs) t WHERE place <= 12",
    "rel19_contrast": "SELECT target, size, max(CASE WHEN grp IN ('g0', 'g1') THEN r2 END) AS best_a, max(CASE WHEN grp IN ('g2', 'g3') THEN r2 END) AS best_b, round(max(CASE WHEN grp IN ('g0', 'g1') THEN r2 END) - max(CASE WHEN grp IN ('g2', 'g3') THEN r2 END), 6) + 0.0E0 AS gap FROM runs GROUP BY target, size",
    "rel20_row_slice": "SELECT sample_id, CAST(rn AS BIGINT) AS rn FROM (SELECT sample_id, row_number() OVER (PARTITION BY stratum ORDER BY sample_id) AS rn FROM structures) t WHERE rn > 10 AND rn <= 60",
    "rel21_counts": "SELECT b.batch, t.stratum, CAST(coalesce(count(s.sample_id), 0) AS BIGINT) AS n FROM (SELECT DISTINCT batch FROM structures) b CROSS JOIN (SELECT DISTINCT stratum FROM structures) t LEFT JOIN structures s ON s.batch = b.batch AND s.stratum = t.stratum GROUP BY b.batch, t.stratum",
    "rel22_describe": "SELECT kind, CAST(count(value) AS BIGINT) AS n, round(avg(value), 5) + 0.0E0 AS mean, round(stddev_samp(value), 5) AS sd, round(min(value), 6) AS low, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY value), 5) + 0.0E0 AS q1, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY value), 5) + 0.0E0 AS median, round(percentile_cont(0.75) WITHIN GROUP (ORDER BY value), 5) + 0.0E0 AS q3, round(max(value), 6) AS high FROM feat GROUP BY kind",
    "rel23_nan_gate": "SELECT fold, CAST(count(CASE WHEN #nan(pred) OR abs(pred) > 1e300 THEN 1 END) AS BIGINT) AS bad, CAST(count(*) AS BIGINT) AS n FROM oof GROUP BY fold",
    "rel24_row_reductions": "SELECT sample_id, round(greatest(abs(k_xy - k_yx), abs(k_xz - k_zx), abs(k_yz - k_zy)), 6) AS worst, CASE WHEN conv_fx = 1 AND conv_fy = 1 THEN 1 ELSE 0 END AS all_ok FROM perm",
    "rel26_matched_sample": "SELECT sample_id, stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(concat(CAST(sample_id AS STRING), ':7')), sample_id) AS rn, min(n) OVER () AS least FROM (SELECT *, count(*) OVER (PARTITION BY stratum) AS n FROM structures) t) t WHERE rn <= least / 2",
    "rel28_row_count_gate": "SELECT 'structures' AS tab, CAST(count(*) AS BIGINT) AS n FROM structures UNION ALL SELECT 'perm', CAST(count(*) AS BIGINT) FROM perm UNION ALL SELECT 'feat', CAST(count(*) AS BIGINT) FROM feat",
    "rel29_audit": "SELECT kind, CAST(count(DISTINCT sample_id) AS BIGINT) AS n_rows, CAST(count(CASE WHEN #nan(value) THEN 1 END) AS BIGINT) AS nan_values FROM feat GROUP BY kind",
    "rel30_experiment_grid": "SELECT t.target, g.grp, z.size, s.seed FROM (SELECT DISTINCT target FROM runs) t CROSS JOIN (SELECT DISTINCT grp FROM runs) g CROSS JOIN (SELECT DISTINCT size FROM runs) z CROSS JOIN (SELECT DISTINCT seed FROM runs) s LEFT ANTI JOIN runs r ON r.target = t.target AND r.grp = g.grp AND r.size = z.size AND r.seed = s.seed AND r.n_rows > 20",
    "rel31_root_join": "SELECT f.sample_id, f.idx, f.label, round(f.value * s.porosity, 6) + 0.0E0 AS product FROM feat f JOIN structures s ON s.sample_id = f.sample_id",
    "src6_feature_blocks": "SELECT kind, sample_id, CAST(count(*) AS BIGINT) AS width, round(sum(value), 5) + 0.0E0 AS total FROM feat GROUP BY kind, sample_id",
    "snk5_manifest": "SELECT stratum, CAST(count(*) AS BIGINT) AS n, min(sample_id) AS first_id, max(sample_id) AS last_id, max(sample_id) - min(sample_id) + 1 = count(DISTINCT sample_id) AS contiguous, #sha256(#joined(sample_id)) AS ids_sha256 FROM structures GROUP BY stratum",
    # -- windows and splits ------------------------------------------------------------
    "win1_nested_order": "SELECT sample_id, stratum, CAST(row_number() OVER (ORDER BY rn, stratum, sample_id) AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(concat(CAST(sample_id AS STRING), ':1')) DESC, sample_id) AS rn FROM structures) t",
    "win2_golden_split": """SELECT sample_id, stratum, CASE WHEN rn <= #half_even(n * 1.0E0 * grp_n / total) THEN 'golden' ELSE 'pool' END AS split FROM (SELECT *, 999 AS n, count(*) OVER (PARTITION BY stratum) AS grp_n, count(*) OVER () AS total, row_number() OVER (PARTITION BY stratum ORDER BY md5(concat(CAST(sample_id AS STRING), ':12345')), sample_id) AS rn FROM structures) t""",
    "win3_golden_hash": "SELECT batch, #sha256(#joined(sample_id)) AS ids_sha256 FROM structures GROUP BY batch",
    "win4_kfold": "SELECT sample_id, CAST((row_number() OVER (ORDER BY md5(concat(CAST(sample_id AS STRING), ':0')), sample_id) - 1) % 5 AS INT) AS fold FROM structures",
    "win5_group_folds": "SELECT sample_id, CAST(dense_rank() OVER (ORDER BY stratum) - 1 AS INT) AS fold FROM structures",
    "win6_part_seams": "SELECT batch, coalesce(lead(batch) OVER (ORDER BY first_id, batch), -1) AS next_batch, n FROM (SELECT batch, min(sample_id) AS first_id, CAST(count(*) AS BIGINT) AS n FROM structures GROUP BY batch) t",
    "win7_paired_difference": "SELECT r.target, r.grp, r.size, round(avg(r.r2 - b.r2), 6) + 0.0E0 AS mean, round(stddev_samp(r.r2 - b.r2), 6) AS sd, CAST(count(CASE WHEN r.r2 > b.r2 THEN 1 END) AS BIGINT) AS wins, CAST(count(*) AS BIGINT) AS n FROM runs r JOIN runs b ON b.target = r.target AND b.size = r.size AND b.seed = r.seed AND b.grp = 'g0' WHERE r.grp <> 'g0' GROUP BY r.target, r.grp, r.size",
    "win8_n_to_reach": """WITH m AS (SELECT target, grp, size, avg(r2) AS r FROM runs GROUP BY target, grp, size), w AS (SELECT *, lag(size) OVER (PARTITION BY target, grp ORDER BY size) AS n0, lag(r) OVER (PARTITION BY target, grp ORDER BY size) AS r0 FROM m), f AS (SELECT *, row_number() OVER (PARTITION BY target, grp ORDER BY size) AS place FROM w WHERE r >= 0.5E0)
        SELECT a.target, a.grp, CASE WHEN f.size IS NULL THEN concat('>', CAST(a.top AS STRING)) WHEN f.n0 IS NULL THEN concat('<=', CAST(f.size AS STRING)) ELSE CAST(CAST(round(exp(ln(n0) + (0.5E0 - r0) / (r - r0) * (ln(f.size) - ln(n0)))) AS BIGINT) AS STRING) END AS reached
        FROM (SELECT target, grp, max(size) AS top FROM runs GROUP BY target, grp) a LEFT JOIN f ON f.target = a.target AND f.grp = a.grp AND f.place = 1""",
    "win9_incomplete_cells": "SELECT target, grp, size, seeds, CASE WHEN seeds < max(seeds) OVER () THEN 1 ELSE 0 END AS incomplete FROM (SELECT target, grp, size, CAST(count(DISTINCT seed) AS BIGINT) AS seeds FROM runs GROUP BY target, grp, size) t",
    "win10_resume": """SELECT DISTINCT w.target, w.grp, w.size, w.seed FROM (SELECT target, grp, size, seed + 1 AS seed FROM runs) w LEFT ANTI JOIN runs r ON r.target = w.target AND r.grp = w.grp AND r.size = w.size AND r.seed = w.seed""",
    "win11_fold_delta": "SELECT r.target, r.grp, r.size, CAST(count(*) AS BIGINT) AS folds, round(avg(r.r2 - b.r2), 6) + 0.0E0 AS delta, CAST(count(CASE WHEN r.r2 > b.r2 THEN 1 END) AS BIGINT) AS wins FROM runs r JOIN runs b ON b.target = r.target AND b.seed = r.seed AND b.size = r.size AND b.grp = 'g1' WHERE r.grp <> 'g1' GROUP BY r.target, r.grp, r.size",
    # -- statistics --------------------------------------------------------------------
    "sta1_fold_metrics": """WITH p AS (SELECT fold, truth, pred FROM oof WHERE NOT #nan(pred)), m AS (SELECT fold, avg(truth) AS mean FROM p GROUP BY fold)
        SELECT p.fold, CAST(count(*) AS BIGINT) AS n, round(1 - sum(power(truth - pred, 2)) / nullif(sum(power(truth - mean, 2)), 0), 6) AS r2, round(avg(abs(truth - pred)), 4) AS mae, round(avg(power(truth - pred, 2)), 1) AS mse FROM p JOIN m ON m.fold = p.fold GROUP BY p.fold""",
    "sta2_summary": "SELECT target, grp, round(avg(r2), 6) AS r2_mean, round(coalesce(stddev_samp(r2), 0), 6) AS r2_std FROM runs GROUP BY target, grp",
    "sta3_pooled": """WITH p AS (SELECT truth, pred FROM oof WHERE NOT #nan(pred)), m AS (SELECT avg(truth) AS mean FROM p) SELECT CAST(count(*) AS BIGINT) AS n, round(1 - sum(power(truth - pred, 2)) / sum(power(truth - mean, 2)), 6) AS r2 FROM p CROSS JOIN m""",
    "sta4_noise_ceiling": "SELECT conv_fx, round(greatest(0, 1 - avg(power(abs(k_xy - k_yx) / 2, 2)) / nullif(var_samp(0.5E0 * (k_xy + k_yx)), 0)), 6) AS ceiling FROM perm GROUP BY conv_fx",
    "sta5_ceilings_3d": "SELECT round(1 - avg(power((k_xy - k_yx) / 2, 2)) / var_samp((k_xy + k_yx) / 2), 6) AS xy, round(1 - avg(power((k_xz - k_zx) / 2, 2)) / var_samp((k_xz + k_zx) / 2), 6) AS xz, round(1 - avg(power((k_yz - k_zy) / 2, 2)) / var_samp((k_yz + k_zy) / 2), 6) AS yz FROM perm",
    "sta6_seam_z": """WITH s AS (SELECT idx, avg(CASE WHEN label < 5 THEN value END) AS ma, avg(CASE WHEN label >= 5 THEN value END) AS mb, var_samp(CASE WHEN label < 5 THEN value END) AS va, var_samp(CASE WHEN label >= 5 THEN value END) AS vb, count(CASE WHEN label < 5 THEN 1 END) AS na, count(CASE WHEN label >= 5 THEN 1 END) AS nb FROM feat GROUP BY idx)
        SELECT idx, round(CASE WHEN va + vb > 0 THEN (mb - ma) / sqrt((va + vb) / 2) / sqrt(1.0E0 / na + 1.0E0 / nb) ELSE 0 END, 4) + 0.0E0 AS z, CASE WHEN va + vb = 0 AND ma <> mb THEN 1 ELSE 0 END AS frozen FROM s""",
    "rel25_worst_features": """WITH s AS (SELECT idx, round(abs(avg(CASE WHEN label < 5 THEN value END) - avg(CASE WHEN label >= 5 THEN value END)), 6) AS gap FROM feat GROUP BY idx)
        SELECT idx, gap FROM (SELECT *, row_number() OVER (ORDER BY gap DESC, idx) AS place FROM s) t WHERE place <= 5""",
    "sta7_paired_t": """WITH d AS (SELECT r.target, r.grp, r.r2 - b.r2 AS d FROM runs r JOIN runs b ON b.target = r.target AND b.size = r.size AND b.seed = r.seed AND b.grp = 'g0' WHERE r.grp <> 'g0')
        SELECT target, grp, CAST(count(*) AS BIGINT) AS n, round(CASE WHEN stddev_samp(d) > 0 THEN avg(d) / (stddev_samp(d) / sqrt(count(*))) ELSE 0 END, 5) + 0.0E0 AS t FROM d GROUP BY target, grp""",
    "sta8_scale_targets": "SELECT p.sample_id, round((k_xx - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 5) + 0.0E0 AS z FROM perm p CROSS JOIN (SELECT avg(k_xx) AS m, stddev_pop(k_xx) AS s FROM perm WHERE sample_id % 5 <> 0) t",
    "sta15_correlations": "SELECT kind, idx, round(corr(value, label), 5) + 0.0E0 AS r FROM feat GROUP BY kind, idx",
    "sta17_circular_shift": "SELECT sid, CAST((x + sid) % 16 AS INT) AS x, CAST((y + 2 * sid) % 16 AS INT) AS y, solid FROM lattice2",
    # -- arrivals ----------------------------------------------------------------------
    "stream_hourly_rate": "SELECT event_type, CAST(floor(#epoch(ts) / 3600) AS BIGINT) AS hour, CAST(count(DISTINCT event_id) AS BIGINT) AS n FROM events WHERE value IS NOT NULL AND isfinite(value) GROUP BY event_type, 2",
}
