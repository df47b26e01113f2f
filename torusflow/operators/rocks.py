"""Cubes cut out of scanned rocks: turned, stretched, scaled and grown, a row a cube.

A volume lies in rows of planes. A cube needs a box of it, so each plane sends a cube its
window alone, and what meets in a task is one box of bounded size, never a volume.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lattice import kernel, labels_of, rounded
from .sticks import uniform
from .topology import spans


def frame(quaternion, a: float, b: float) -> np.ndarray:
    """The stretch (x, y, z) of a cube: by a and b along the first two axes of a turned frame, not at all along the third."""
    w, x, y, z = np.array(quaternion, float) / np.linalg.norm(quaternion)
    turn = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
    return turn @ np.diag([a, b, 1.0]) @ turn.T


#: The pairs of stretches of a pilot.
STRETCHES = ((1.0, 1.0), (1.5, 1.0), (2.0, 1.0), (3.0, 1.0), (2.0, 2.0))


def pilot(volumes: DataFrame, scales: list[float], grows: list[float], reps: int, side: int = 80, seed: int = 0) -> DataFrame:
    """The design that ``cubes`` takes, of every rock (rock, n) with each scale, grow, pair of stretches and repeat.

    Rotations are even (by Shoemake's quaternion) and centres lie where the cube's samples
    stay in the rock; both are hashes of the seed and the row, so a design is the same on any
    layout. ``tag`` names the row. A rock too small for a scale raises.
    """
    # The design of a rock is a constant, its tags too: they are spelled once, not by the row.
    places = lambda v, digits: F.format_string(f"%.{digits}f", F.lit(float(v)))
    tag = lambda s, g, a, b, r: F.concat(F.lit("s"), places(s, 1), F.lit("_g"), places(g, 2), F.lit("_a"), places(a, 1), F.lit("_b"), places(b, 1), F.lit(f"_r{r}"))
    every = [F.struct(*[F.lit(float(v)).alias(c) for c, v in zip(("scale", "grow", "a", "b"), (s, g, a, b))], tag(s, g, a, b, r).alias("tag")) for s in scales for g in grows for a, b in STRETCHES for r in range(reps)]
    rows = volumes.select("rock", "n", F.explode(F.array(*every)).alias("d")).select("rock", "n", "d.*")
    u = lambda name: uniform(seed, F.col("rock"), F.col("tag"), name)
    # The samples of a cube lie within a ball of this radius, as stretches only draw them nearer.
    far = F.col("scale") * (float(np.sqrt(3.0)) * side / 2) + 2
    far = F.when(F.col("n") - 1 - 2 * far > 0, far).otherwise(F.raise_error(F.concat(F.lit("a cube doesn't fit into "), F.col("rock"))).cast("double"))
    centre = [(far + u(c) * (F.col("n") - 1 - 2 * far)).alias(f"c{c}") for c in "xyz"]
    turn = lambda name: 2 * np.pi * u(name)
    low, high = F.sqrt(1 - u("r0")), F.sqrt(u("r0"))
    quaternion = [(high * F.cos(turn("r2"))).alias("qw"), (low * F.sin(turn("r1"))).alias("qx"), (low * F.cos(turn("r1"))).alias("qy"), (high * F.sin(turn("r2"))).alias("qz")]
    sid = F.xxhash64("rock", "tag").alias("sid")
    return rows.select(sid, "rock", "tag", *centre, "scale", "grow", "a", "b", *quaternion)


def reach(side: int, scale: float, stretch: np.ndarray) -> float:
    """How far from its centre a cube's samples lie in the rock, along any axis."""
    return float(scale * np.abs(np.linalg.inv(stretch)).sum(1).max() * (side - 1) / 2)


def signed_distance(solid: np.ndarray, cap: float) -> np.ndarray:
    """Distance to the surface between the phases, half a cell from the centres on both sides of it:
    positive in the pore and negative in the solid, up to the cap; no wrap."""

    def away(phase):
        far = 4 * np.ceil(cap) ** 2 + 1
        best = np.where(phase, far, 0.0)
        for axis in range(3):
            out = best.copy()
            for step in range(1, min(int(np.ceil(cap)), best.shape[axis] - 1) + 1):
                ahead, behind = [slice(None)] * 3, [slice(None)] * 3
                ahead[axis], behind[axis] = slice(step, None), slice(None, -step)
                for to, of in ((ahead, behind), (behind, ahead)):
                    np.minimum(out[tuple(to)], best[tuple(of)] + step * step, out=out[tuple(to)])
            best = out
        return np.minimum(np.sqrt(best) - 0.5, cap)

    return np.where(solid == 0, away(solid == 0), -away(solid != 0))


def sampled(field: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Trilinear values of a [z, y, x] field at points (x, y, z)."""
    at = at[:, ::-1]
    low = np.clip(np.floor(at).astype(int), 0, np.array(field.shape) - 2)
    part = at - low
    out = np.zeros(len(at))
    for corner in np.ndindex(2, 2, 2):
        weight = np.prod(np.where(corner, part, 1 - part), axis=1)
        out += weight * field[tuple((low + corner).T)]
    return out


def cube(box: np.ndarray, origin: np.ndarray, centre, side: int, scale: float, stretch: np.ndarray, grow: float) -> np.ndarray:
    """The cube's cells, 1 where solid is left: the field at centre + scale * stretch^-1 * (cell - middle).

    grow widens the pore: that many of the rock's cells are shaved off every grain (put on, if negative).
    """
    z, y, x = np.mgrid[0:side, 0:side, 0:side]
    cells = np.stack([x.ravel(), y.ravel(), z.ravel()], 1) - (side - 1) / 2
    at = np.array(centre, float) + scale * cells @ np.linalg.inv(stretch).T - origin
    # Exact near the threshold: corners of a voxel differ by less than 2 from what lies between them.
    field = signed_distance(box, abs(grow) + 3)
    return (sampled(field, at) <= -grow).astype(np.int8).reshape(side, side, side)


def cubes(planes: DataFrame, design: DataFrame, side: int = 80) -> DataFrame:
    """(sid, rock, grid) of a design (sid, rock, cx, cy, cz, scale, grow, a, b, qw, qx, qy, qz) over planes
    (rock, n, z, plane). A cube whose samples leave the rock has a null grid; what distances need
    beyond the samples ends at the rock's faces."""
    fields = ["cx", "cy", "cz", "scale", "grow", "a", "b", "qw", "qx", "qy", "qz"]

    def boxes(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                r["far"] = reach(side, r["scale"], frame([r[q] for q in ("qw", "qx", "qy", "qz")], r["a"], r["b"]))
                far = r["far"] + abs(r["grow"]) + 5
                for c in "xyz":
                    r[f"{c}0"], r[f"{c}1"] = int(np.floor(r[f"c{c}"] - far)), int(np.ceil(r[f"c{c}"] + far))
            yield pa.RecordBatch.from_pylist(rows, boxed)

    own = design.select("sid", "rock", *[F.col(c).cast("double").alias(c) for c in fields])
    boxed = pa.schema([("sid", pa.int64()), ("rock", pa.string()), *[(c, pa.float64()) for c in (*fields, "far")], *[(f"{c}{e}", pa.int64()) for c in "xyz" for e in (0, 1)]])
    ddl = "sid long, rock string, " + ", ".join(f"{c} double" for c in (*fields, "far")) + ", " + ", ".join(f"{c}{e} long" for c in "xyz" for e in (0, 1))
    wanted = own.mapInArrow(boxes, ddl)

    def box_of(r: dict) -> list[tuple[int, int]]:
        """The box by z, y and x, cut at the rock's faces."""
        return [(max(r[f"{c}0"], 0), min(r[f"{c}1"], r["n"] - 1)) for c in "zyx"]

    def windows(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                n = r["n"]
                flat = np.frombuffer(r["plane"], np.uint8).reshape(n, n)
                inside = all(r["far"] <= r[f"c{c}"] <= n - 1 - r["far"] for c in "xyz")
                _, (y0, y1), (x0, x1) = box_of(r)
                r["window"] = flat[y0 : y1 + 1, x0 : x1 + 1].tobytes() if inside else None
            yield pa.RecordBatch.from_pylist([{k: v for k, v in r.items() if k != "plane"} for r in rows], pa.schema([*boxed, ("z", pa.int64()), ("n", pa.int64()), ("window", pa.binary())]))

    asked = wanted.withColumn("z", F.explode(F.sequence("z0", "z1")))
    met = asked.join(planes.select("rock", "z", "n", "plane"), ["rock", "z"]).select(*boxed.names, "z", "n", "plane")
    cut = met.mapInArrow(windows, f"{ddl}, z long, n long, window binary")

    def made(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["z"])
        r = rows[0]
        ends = box_of(r)
        shape = [b - a + 1 for a, b in ends]
        grid = None
        if len(rows) == shape[0] and all(q["window"] is not None for q in rows):
            box = np.stack([np.frombuffer(q["window"], np.uint8).reshape(shape[1:]) for q in rows])
            stretch = frame([r[q] for q in ("qw", "qx", "qy", "qz")], r["a"], r["b"])
            grid = cube(box, np.array([a for a, _ in ends[::-1]]), (r["cx"], r["cy"], r["cz"]), side, r["scale"], stretch, r["grow"]).ravel().tolist()
        return pa.table({"sid": pa.array([r["sid"]], pa.int64()), "grid": pa.array([grid], pa.list_(pa.int8()))})

    found = cut.groupBy("sid").applyInArrow(made, "sid long, grid array<tinyint>")
    return own.select("sid", "rock").join(found, "sid", "left")


def mean_chord(pore: np.ndarray, axis: int) -> float:
    """Mean length of the runs of pore along an axis, cut at the faces."""
    lines = np.moveaxis(pore, axis, 0)
    starts = lines[0].sum() + (lines[1:] & ~lines[:-1]).sum()
    return pore.sum() / starts if starts else np.nan


def elongation(field: np.ndarray) -> np.ndarray:
    """(x, y, z) of the axis along which the distance field varies least: of the mean products of
    its gradient the eigenvector of the smallest eigenvalue, its first component that counts positive."""
    slope = np.stack([d.ravel() for d in np.gradient(field)[::-1]])
    axis = np.linalg.eigh(slope @ slope.T / slope.shape[1])[1][:, 0]
    return axis * np.sign(axis[np.flatnonzero(np.abs(axis) > 1e-6)[0]])


def metrics(packed: DataFrame, cap: float = 28.0) -> DataFrame:
    """Of each cube: porosity, percentiles of the pore's distance to the surface, mean chords, the
    largest cluster's share, the axis of its elongation, and whether it percolates."""

    def work(ids, g):
        rows = []
        for one, along in zip(g, spans(g == 0)):
            pore = one == 0
            field = signed_distance(one, cap)
            wide, chords = field[pore], [mean_chord(pore, axis) for axis in (2, 1, 0)]
            along_axis = elongation(field) if min(one.shape) > 1 else [np.nan] * 3
            lab = labels_of(pore[None], False)[0]
            sizes = np.unique(lab[lab > 0], return_counts=True)[1]
            tenths = np.percentile(wide, [10, 50, 90]) if len(wide) else [np.nan] * 3
            rows.append((pore.mean(), *tenths, *chords, sizes.max() / sizes.sum() if len(sizes) else np.nan, *along_axis, *along.astype(int)))
        columns = list(zip(*rows))
        return (ids, *(rounded(np.array(c, float), 6) for c in columns[:11]), *columns[11:])

    return kernel(packed, 3, work, "sid long, porosity double, dt_p10 double, dt_p50 double, dt_p90 double, chord_x double, chord_y double, chord_z double, largest double, axis_x double, axis_y double, axis_z double, perc_x int, perc_y int, perc_z int")
