"""Tables of structures, labels, features and runs: gates, joins, bands, reports, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import quantiles

#: Named groups of features by the prefixes of their columns (a column is prefix, direction tag and number).
GROUPS = {
    "ecp": ("ecp",),
    "ph": ("ph",),
    "tda": ("ecp", "ph"),
    "por": ("por",),
    "tpc": ("tpc",),
    "fab": ("fab",),
    "fabdir": ("fabdir",),
    "conn": ("conn",),
    "thr": ("thr",),
    "baselines": ("por", "tpc", "fab", "fabdir"),
    "all": ("ecp", "ph", "por", "tpc", "fab", "fabdir"),
    "baselines+conn": ("por", "tpc", "fab", "fabdir", "conn"),
    "tda+conn": ("ecp", "ph", "conn"),
    "all+conn": ("ecp", "ph", "por", "tpc", "fab", "fabdir", "conn"),
    "tpc+thr": ("tpc", "thr"),
    "baselines+thr": ("por", "tpc", "fab", "fabdir", "thr"),
    "tda+thr": ("ecp", "ph", "thr"),
    "all+thr": ("ecp", "ph", "por", "tpc", "fab", "fabdir", "thr"),
    "kc": ("kc",),
    "cp": ("cp",),
    "phys": ("kc", "cp"),
    "phys+thr": ("kc", "cp", "thr"),
    "classical": ("por", "tpc", "fab", "fabdir", "kc", "cp"),
    "classical+thr": ("por", "tpc", "fab", "fabdir", "kc", "cp", "thr"),
    "classical+tda": ("por", "tpc", "fab", "fabdir", "kc", "cp", "ecp", "ph"),
    "classical+tda+thr": ("por", "tpc", "fab", "fabdir", "kc", "cp", "ecp", "ph", "thr"),
}
#: Columns that describe a structure rather than measure it.
METADATA = ("sample_id", "filename", "stratum")


def r6(c: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


# -- columns and gates -----------------------------------------------------------------


def feature_columns(df: DataFrame, key: str = "sample_id", metadata: tuple[str, ...] = METADATA) -> list[str]:
    """All columns but the key and the metadata; without the key it raises."""
    if key not in df.columns:
        raise ValueError(f"no column {key}")
    return [c for c in df.columns if c != key and c not in metadata]


def group_prefixes(name: str) -> tuple[str, ...]:
    """The prefixes of a named group; an unknown name raises."""
    if name not in GROUPS:
        raise ValueError(f"no group {name}: {', '.join(GROUPS)}")
    return GROUPS[name]


def group_columns(df: DataFrame, name: str) -> list[str]:
    """The columns of a named group in a wide table, in its order; ``porosity`` is a group of its own."""
    return ["porosity"] if name == "porosity" else [c for c in df.columns if c.split("_")[0] in group_prefixes(name) and "_" in c]


def group_rows(narrow: DataFrame, names: list[str], kind: str = "kind") -> DataFrame:
    """The rows of a narrow table in each of the named groups, with the group as ``grp``; a row is in every group that has its kind."""
    pairs = F.array(*[F.struct(F.lit(n).alias("grp"), F.lit(p).alias("__kind")) for n in names for p in group_prefixes(n)])
    mine = F.filter(pairs, lambda g: g["__kind"] == F.col(kind))
    return narrow.select("*", F.explode(F.transform(mine, lambda g: g["grp"])).alias("grp"))


def read_part(df: DataFrame, key: str = "sample_id") -> DataFrame:
    """The part, if it has the key, a feature and a row."""
    if not feature_columns(df, key):
        raise ValueError("a part without features")
    if df.isEmpty():
        raise ValueError("an empty part")
    return df


def column_differences(base: DataFrame, other: DataFrame) -> dict[str, list[str]]:
    """Columns that either lacks, and those that both have in another order."""
    both = [c for c in base.columns if c in other.columns]
    order = [c for c in other.columns if c in base.columns]
    return {"missing": [c for c in base.columns if c not in other.columns], "extra": [c for c in other.columns if c not in base.columns], "moved": [a for a, b in zip(both, order) if a != b]}


def expanded_targets(asked: list[str], groups: dict[str, list[str]], columns: list[str]) -> list[str]:
    """Names of groups replaced by their targets, each target once, in order; unknown ones raise."""
    out = dict.fromkeys(t for a in asked for t in groups.get(a, [a]))
    lost = [t for t in out if t not in columns]
    if lost:
        raise ValueError(f"no columns {', '.join(lost)}")
    return list(out)


def id_faults(parts: DataFrame, wanted: DataFrame, part: str = "part", key: str = "sample_id") -> DataFrame:
    """(key, fault): an id twice in a part, in several parts, wanted but absent, or present but not wanted."""
    seen = parts.groupBy(key).agg(F.count("*").alias("rows"), F.count_distinct(part).alias("parts"))
    both = seen.join(wanted.select(key).distinct().withColumn("wanted", F.lit(True)), key, "full")
    faults = F.array(
        F.when(F.col("rows") > F.col("parts"), "repeated"), F.when(F.col("parts") > 1, "overlap"), F.when(F.col("rows").isNull(), "missing"), F.when(F.col("wanted").isNull(), "stray")
    )
    return both.select(key, F.explode(F.filter(faults, lambda f: f.isNotNull())).alias("fault"))


def metadata_faults(parts: DataFrame, structures: DataFrame, numbers: list[str], texts: list[str], key: str = "sample_id", tolerance: float = 1e-9) -> DataFrame:
    """(key, column) where a part's metadata differ from the structure's: numbers beyond the tolerance, texts at all."""
    two = parts.alias("p").join(structures.alias("s"), key)
    wrong = [F.when(F.abs(F.col(f"p.{c}") - F.col(f"s.{c}")) > tolerance, c) for c in numbers] + [F.when(~F.col(f"p.{c}").eqNullSafe(F.col(f"s.{c}")), c) for c in texts]
    return two.select(key, F.explode(F.filter(F.array(*wrong), lambda c: c.isNotNull())).alias("column"))


def not_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, bad): how many values of each column are null, NaN or infinite."""
    bad = [F.sum(F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")), 1).otherwise(0)).alias(c) for c in columns]
    return df.agg(*bad).unpivot([], columns, "column", "bad")


def merged(parts: list[DataFrame], structures: DataFrame, *, key: str = "sample_id", numbers: list[str] = ["porosity"], texts: list[str] = ["stratum"]) -> DataFrame:
    """The union of parts in order of the key, behind its gates: readable parts, equal columns in
    equal order, no id twice or in two parts, none missing or stray, metadata as in the
    structures, finite features. The first gate that fails raises and names what it found."""
    parts = [read_part(p, key) for p in parts]
    for p in parts[1:]:
        found = column_differences(parts[0], p)
        if any(found.values()):
            raise ValueError(f"columns differ: {found}")
    every = parts[0].withColumn("__part", F.lit(0))
    for n, p in enumerate(parts[1:], 1):
        every = every.unionByName(p.withColumn("__part", F.lit(n)))
    rows = every.drop("__part")
    features = [c for c in feature_columns(rows, key) if c not in numbers]
    gates = {
        "ids": id_faults(every, structures, "__part", key),
        "metadata": metadata_faults(rows, structures, [c for c in numbers if c in rows.columns], [c for c in texts if c in rows.columns], key),
        "values": not_finite(rows, features).where("bad > 0"),
    }
    for name, faults in gates.items():
        some = faults.limit(10).collect()
        if some:
            raise ValueError(f"{name}: {[tuple(r) for r in some]}")
    return rows.orderBy(key)


def converged(df: DataFrame, flags: tuple[str, ...] = ("conv_fx", "conv_fy", "conv_fz")) -> DataFrame:
    """Rows for which all the convergence flags that exist are set."""
    have = [c for c in flags if c in df.columns]
    for c in have:
        df = df.where(F.col(c) == 1)
    return df


def counts_of(tables: dict[str, DataFrame]) -> DataFrame:
    """(tab, n) of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("tab"), "n")
        out = one if out is None else out.unionByName(one)
    return out


# -- bands, counts and reports ---------------------------------------------------------


def banded(df: DataFrame, column: str, edges: list[tuple[float, float, str]]) -> DataFrame:
    """The rows in a half-open band [low, high), with its name as ``band``."""
    name = F.coalesce(*[F.when((F.col(column) >= lo) & (F.col(column) < hi), F.lit(label)) for lo, hi, label in edges])
    return df.withColumn("band", name).where("band is not null")


def quantile_bands(df: DataFrame, column: str, low: float = 0.25, high: float = 0.75) -> DataFrame:
    """The rows as low (up to the one quantile), high (above the other) or mid; quantiles are exact."""
    q = quantiles(df, column, [low, high]).select("q").scalar()
    return df.withColumn("__q", q).withColumn("band", F.when(F.col(column) <= F.col("__q")[0], "low").when(F.col(column) > F.col("__q")[1], "high").otherwise("mid")).drop("__q")


def zero_filled(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) for every pair of values that either column has."""
    sets = df.agg(F.collect_set(a).alias("x"), F.collect_set(b).alias("y")).select(F.explode("x").alias(a), "y").select(a, F.explode("y").alias(b))
    return sets.join(df.groupBy(a, b).agg(F.count("*").alias("n")), [a, b], "left").select(a, b, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def described(df: DataFrame, by: str, value: str) -> DataFrame:
    """Count, mean, deviation, least, quartiles and largest of each group; quartiles are exact."""
    quarters = quantiles(df, value, [0.25, 0.5, 0.75], [by]).select(F.col(by).alias("__of"), "q")
    out = df.groupBy(by).agg(F.count(value).alias("n"), r6(F.avg(value), 5).alias("mean"), F.round(F.stddev_samp(value), 5).alias("sd"), F.round(F.min(value), 6).alias("low"), F.round(F.max(value), 6).alias("high"))
    out = out.join(quarters, F.col(by).eqNullSafe(F.col("__of")), "left")
    return out.select(by, "n", "mean", "sd", "low", *[r6(F.col("q")[i], 5).alias(c) for i, c in enumerate(("q1", "median", "q3"))], "high")


def top_k(df: DataFrame, k: int, order: list[Column], columns: list[str]) -> DataFrame:
    return df.orderBy(*order).limit(k).select(*columns)


def ordered_report(df: DataFrame, by: str, known: list[str], value: str) -> DataFrame:
    """(by, place, mean): known names first, in their order, then the others by name."""
    small = df.groupBy(by).agg(r6(F.avg(value)).alias("mean"))
    rank = F.coalesce(*[F.when(F.col(by) == k, F.lit(i)) for i, k in enumerate(known)], F.lit(len(known)))
    names = small.agg(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), F.col(by).alias("g")))), lambda s: s["g"])).scalar()
    return small.withColumn("__names", names).select(by, F.array_position("__names", F.col(by)).cast("int").alias("place"), "mean")


def contrast(runs: DataFrame, keys: list[str], group: str, a: list[str], b: list[str], value: str = "r2") -> DataFrame:
    """The best of one family of groups, of another, and how far they are apart."""
    best = lambda names: F.max(F.when(F.col(group).isin(names), F.col(value)))
    return runs.groupBy(*keys).agg(best(a).alias("best_a"), best(b).alias("best_b"), r6(best(a) - best(b)).alias("gap"))


def pivoted(runs: DataFrame, keys: list[str], by: str, names: dict, value: str) -> DataFrame:
    """A column for each value named, with the largest of its values."""
    return runs.groupBy(*keys).pivot(by, list(names)).agg(F.max(value)).select(*keys, *[F.col(str(k)).alias(v) for k, v in names.items()])


def missing_experiments(runs: DataFrame, keys: list[str], done: Column) -> DataFrame:
    """The cells of the grid of all keys' values that no finished run fills."""
    sets = runs.agg(*[F.collect_set(k).alias(k) for k in keys])
    for k in keys:
        sets = sets.withColumn(k, F.explode(k))
    return sets.join(runs.where(done), keys, "left_anti").select(*keys)


def resumed(wanted: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """The wanted runs that have no row yet."""
    return wanted.select(*keys).distinct().join(runs.select(*keys), keys, "left_anti")


# -- runs and scores -------------------------------------------------------------------


def paired(runs: DataFrame, base: str, match: list[str], group: str = "grp", value: str = "r2") -> DataFrame:
    """(match, group, d): each run's value less that of the base group's run of the same match."""
    ref = runs.where(F.col(group) == base).select(*match, F.col(value).alias("__b"))
    return runs.where(F.col(group) != base).join(ref, match).select(*match, group, (F.col(value) - F.col("__b")).alias("d"))


def paired_summary(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Mean, deviation and wins of paired differences, and how many there are."""
    return pairs.groupBy(*by).agg(r6(F.avg("d")).alias("mean"), F.round(F.stddev_samp("d"), 6).alias("sd"), F.count(F.when(F.col("d") > 0, 1)).alias("wins"), F.count("*").alias("n"))


def paired_t(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Student's t of paired differences; 0 if they don't vary."""
    sd = F.stddev_samp("d")
    return pairs.groupBy(*by).agg(F.count("*").alias("n"), r6(F.when(sd > 0, F.avg("d") / (sd / F.sqrt(F.count("*")))).otherwise(0.0), 5).alias("t"))


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t with whole degrees of freedom, by its finite series."""
    x = F.atan2(F.abs(t), F.sqrt(df))
    s, c2 = F.sin(x), F.cos(x) * F.cos(x)
    odd = df % 2 == 1
    # Factors (j - 1) / j of the cosine's square: j = 3, 5, ... for odd df, 2, 4, ... for even.
    first = F.when(odd, 3).otherwise(2)
    steps = F.when(df - 2 >= first, F.sequence(first, (df - 2).cast("int"), F.lit(2))).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(a, j):
        term = a["term"] * c2 * (j - 1) / j
        return F.struct(term.alias("term"), (a["total"] + term).alias("total"))

    series = F.aggregate(steps, start, add)["total"]
    p = F.when(df == 1, 1 - 2 * x / F.pi()).when(odd, 1 - 2 * (x + s * F.cos(x) * series) / F.pi()).otherwise(1 - s * series)
    return F.greatest(F.lit(0.0), p)


def paired_test(runs: DataFrame, base: str, keys: list[str], fold: list[str], size: str = "n_rows", group: str = "grp", value: str = "r2") -> DataFrame:
    """(keys, group, n, refused, t, p) of each group's runs against the base group's, fold by fold.

    Runs can only be compared if both have the same folds with as many rows in each; else
    refused is 1 and there is neither t nor p. Differences that don't vary give t 0 and p 1 if they are
    nil, and no t but p 0 if not; a single pair has neither.
    """
    names = runs.select(*keys, group).distinct().where(F.col(group) != base)
    ref = runs.where(F.col(group) == base).select(*keys, *fold, F.col(value).alias("__b"), F.col(size).alias("__nb"))
    wanted = names.join(ref, keys, "left")  # a group's wanted folds are the base's
    own = runs.where(F.col(group) != base).select(*keys, group, *fold, F.col(value).alias("__a"), F.col(size).alias("__na"))
    both = wanted.where(F.col("__nb").isNotNull()).join(own, [*keys, group, *fold], "full")
    d = F.col("__a") - F.col("__b")
    sd, n = F.stddev_samp(d), F.count(d)
    out = both.groupBy(*keys, group).agg(n.alias("n"), F.max(F.when(F.col("__na").eqNullSafe(F.col("__nb")), 0).otherwise(1)).alias("refused"), F.avg(d).alias("__m"), sd.alias("__s"))
    t = F.when(F.col("__s") > 0, F.col("__m") / (F.col("__s") / F.sqrt("n"))).when((F.col("__s") == 0) & (F.col("__m") == 0), 0.0)
    fine = (F.col("refused") == 0) & (F.col("n") > 1)
    p = F.when(F.col("__t").isNotNull(), student_p(F.col("__t"), F.col("n") - 1)).otherwise(0.0)
    return out.withColumn("__t", t).select(*keys, group, "n", "refused", F.when(fine, F.col("__t")).alias("t"), F.when(fine, p).alias("p"))


def reached(runs: DataFrame, goal: float, keys: list[str] = ["target", "grp"], size: str = "size", value: str = "r2") -> DataFrame:
    """(keys, reached): the first size whose mean reaches the goal, interpolated in the size's
    logarithm from the one before; ``<=`` the smallest, or ``>`` the largest if none does."""
    mean = runs.groupBy(*keys, size).agg(F.avg(value).alias("m"))
    curve = mean.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(size).alias("n"), "m"))).alias("c"))  # a few sizes
    at = F.array_position(F.transform("c", lambda p: p["m"] >= goal), True)
    low, high = F.get("c", (F.col("at") - 2).cast("int")), F.get("c", (F.col("at") - 1).cast("int"))
    between = F.exp(F.ln(low["n"]) + (goal - low["m"]) / (high["m"] - low["m"]) * (F.ln(high["n"]) - F.ln(low["n"])))
    text = F.when(F.col("at") == 0, F.concat(F.lit(">"), F.array_max(F.transform("c", lambda p: p["n"])).cast("string")))
    text = text.when(F.col("at") == 1, F.concat(F.lit("<="), high["n"].cast("string"))).otherwise(F.round(between).cast("long").cast("string"))
    return curve.withColumn("at", at).select(*keys, text.alias("reached"))


def incomplete_cells(runs: DataFrame, keys: list[str], seed: str = "seed") -> DataFrame:
    """(keys, seeds, incomplete): cells with fewer seeds than the fullest one."""
    cells = runs.groupBy(*keys).agg(F.count_distinct(seed).alias("seeds"))
    return cells.withColumn("__most", cells.agg(F.max("seeds")).scalar()).select(*keys, "seeds", F.when(F.col("seeds") < F.col("__most"), 1).otherwise(0).alias("incomplete"))


def fold_metrics(oof: DataFrame, by: list[str]) -> DataFrame:
    """n, r2, mae and mse of predictions that are numbers; one pass, by sums of squares about a first value."""
    good = oof.where(~F.isnan("pred") & F.col("pred").isNotNull() & F.col("truth").isNotNull())
    error = F.col("truth") - F.col("pred")
    sst = F.var_pop("truth") * F.count("*")
    return good.groupBy(*by).agg(F.count("*").alias("n"), F.round(1 - F.sum(error * error) / F.nullif(sst, F.lit(0.0)), 6).alias("r2"), F.round(F.avg(F.abs(error)), 4).alias("mae"), F.round(F.avg(error * error), 1).alias("mse"))


def seam_z(feat: DataFrame, first: Column, key: str = "idx", value: str = "value") -> DataFrame:
    """(key, z, frozen): how far a feature's means on both sides of a seam lie apart in standard
    errors; frozen where neither side varies and yet the means differ."""
    a, b = F.when(first, F.col(value)), F.when(~first, F.col(value))
    s = feat.groupBy(key).agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"), F.count(a).alias("na"), F.count(b).alias("nb"))
    z = (F.col("mb") - F.col("ma")) / F.sqrt((F.col("va") + F.col("vb")) / 2) / F.sqrt(1 / F.col("na") + 1 / F.col("nb"))
    still = F.col("va") + F.col("vb")
    return s.select(key, r6(F.when(still > 0, z).otherwise(0.0), 4).alias("z"), F.when((still == 0) & (F.col("ma") != F.col("mb")), 1).otherwise(0).alias("frozen"))


def noise_ceiling(perm: DataFrame, by: list[str], a: str = "k_xy", b: str = "k_yx", clamp: bool = True) -> DataFrame:
    """The r2 that the labels' own disagreement leaves: 1 less its variance over the mean's."""
    c = 1 - F.avg(F.pow(F.abs(F.col(a) - F.col(b)) / 2, 2)) / F.nullif(F.var_samp((F.col(a) + F.col(b)) / 2), F.lit(0.0))
    return perm.groupBy(*by).agg(F.round(F.greatest(F.lit(0.0), c) if clamp else c, 6).alias("ceiling"))


def scaled_target(perm: DataFrame, train: Column, target: str, key: str = "sample_id") -> DataFrame:
    """(key, z): the target less the training rows' mean over their deviation (1 if they don't vary)."""
    s = perm.where(train).agg(F.struct(F.avg(target).alias("m"), F.stddev_pop(target).alias("s"))).scalar()
    return perm.withColumn("__s", s).select(key, r6((F.col(target) - F.col("__s.m")) / F.when(F.col("__s.s") == 0, 1.0).otherwise(F.col("__s.s")), 5).alias("z"))


def unscaled(z: DataFrame, mean: float, deviation: float, column: str = "z") -> DataFrame:
    """The inverse of ``scaled_target``."""
    return z.withColumn(column, F.col(column) * (deviation or 1.0) + mean)


# -- tensors ---------------------------------------------------------------------------


def tensor_2d(perm: DataFrame, key: str = "sample_id") -> DataFrame:
    """Symmetric off-diagonal, reciprocity, principal values, anisotropy and the angle of a 2D permeability."""
    off, mean, half = (F.col("k_xy") + F.col("k_yx")) / 2, (F.col("k_xx") + F.col("k_yy")) / 2, (F.col("k_xx") - F.col("k_yy")) / 2
    reach = F.sqrt(half * half + off * off)
    recip = F.abs(F.col("k_xy") - F.col("k_yx")) / F.nullif(F.abs(F.col("k_xx") + F.col("k_yy")), F.lit(0.0))
    return perm.select(key, r6(off).alias("k_off"), F.round(recip, 6).alias("recip"), F.round(mean + reach, 6).alias("k1"), r6(mean - reach).alias("k2"), F.round(reach / F.nullif(mean, F.lit(0.0)), 6).alias("anisotropy"), r6(F.degrees(F.atan2(off, half) / 2), 4).alias("theta_deg"))


def fractional_anisotropy(perm: DataFrame, key: str = "sample_id") -> DataFrame:
    """(key, fa, recip) of a 3D permeability, from its deviator and the largest disagreement of a pair."""
    mean = (F.col("k_xx") + F.col("k_yy") + F.col("k_zz")) / 3
    offs = [(F.col(f"k_{a}{b}") + F.col(f"k_{b}{a}")) / 2 for a, b in ("xy", "xz", "yz")]
    square = lambda parts: sum((p * p for p in parts[1:]), parts[0] * parts[0])
    diag = [F.col(f"k_{c}{c}") for c in "xyz"]
    fa = F.sqrt(1.5 * (square([d - mean for d in diag]) + 2 * square(offs)) / F.nullif(square(diag) + 2 * square(offs), F.lit(0.0)))
    worst = F.greatest(*[F.abs(F.col(f"k_{a}{b}") - F.col(f"k_{b}{a}")) for a, b in ("xy", "xz", "yz")])
    return perm.select(key, F.round(fa, 6).alias("fa"), F.round(worst / F.nullif(F.abs(3 * mean), F.lit(0.0)), 6).alias("recip"))


def targets_2d(perm: DataFrame, key: str = "sample_id") -> DataFrame:
    """What models of a 2D permeability learn beside its components: the axis as cos and sin of the doubled
    angle, the mean's logarithm (null unless positive), the ratio of principal values (null unless the lesser is
    positive), and the labels' disagreement over the off-diagonal and of that over the trace."""
    c = F.col
    off, mean, half = F.round((c("k_xy") + c("k_yx")) / 2, 9), (c("k_xx") + c("k_yy")) / 2, (c("k_xx") - c("k_yy")) / 2
    t = perm.select(key, off.alias("o"), mean.alias("m"), half.alias("h"), F.abs(c("k_xy") - c("k_yx")).alias("gap"))
    t = t.withColumns({"r": F.sqrt(c("h") * c("h") + c("o") * c("o")), "angle": F.atan2("o", "h")})
    nz = lambda x: F.nullif(F.abs(x), F.lit(0.0))
    return t.select(
        key, r6(F.cos("angle"), 5).alias("cos2theta"), r6(F.sin("angle"), 5).alias("sin2theta"), F.round(F.when(c("m") > 0, F.ln("m")), 6).alias("log_k_mean"),
        F.round(F.when(c("m") - c("r") > 1e-9, (c("m") + c("r")) / (c("m") - c("r"))), 3).alias("k_ratio"), F.round(c("gap") / nz(2 * c("o")), 6).alias("koff_rel_err"), F.round(F.abs("o") / nz(2 * c("m")), 6).alias("koff_over_trace"),
    )


def targets_3d(perm: DataFrame, key: str = "sample_id") -> DataFrame:
    """Trace, logarithm of the mean, relative deviations from it, an off-diagonal over the trace, and whether both flags are set."""
    mean = (F.col("k_xx") + F.col("k_yy") + F.col("k_zz")) / 3
    off = lambda a, b: (F.col(f"k_{a}{b}") + F.col(f"k_{b}{a}")) / 2
    t = perm.select("*", mean.alias("m"), F.nullif(mean, F.lit(0.0)).alias("z"))
    over = lambda x: x / F.col("z")
    return t.select(
        key, F.round(3 * F.col("m"), 6).alias("trace"), F.round(F.when(F.col("m") > 0, F.ln("m")), 6).alias("log_k_mean"), *[r6(over(F.col(f"k_{a}{a}")) - 1).alias(f"dev_{a}{a}") for a in "xy"],
        *[r6(over(off(a, b))).alias(f"dev_{a}{b}") for a, b in ("xy", "xz", "yz")], F.round(F.abs(off("x", "z")) / F.nullif(3 * F.col("m"), F.lit(0.0)), 6).alias("koff_over_trace_xz"), (F.col("conv_fx") * F.col("conv_fy")).alias("conv_all"),
    )


def permuted(perm: DataFrame, order: str = "zxy", axes: str = "xyz") -> DataFrame:
    """The tensor after its axes are renamed: axis i of the result is axis order[i] of the given one."""
    name = dict(zip(axes, order))
    return perm.select("sample_id", *[F.col(f"k_{name[a]}{name[b]}").alias(f"k_{a}{b}") for a in axes for b in axes])


def covariance_residual(turned: DataFrame, base: DataFrame, order: str = "zxy", axes: str = "xyz") -> DataFrame:
    """(sample_id, residual): how far the tensor of a turned structure is from the turned tensor of the
    structure, the largest component's difference over the largest component; null for a nil tensor."""
    want = permuted(base, order, axes).select("sample_id", *[F.col(f"k_{a}{b}").alias(f"__{a}{b}") for a in axes for b in axes])
    both = turned.join(want, "sample_id")
    apart = F.greatest(*[F.abs(F.col(f"k_{a}{b}") - F.col(f"__{a}{b}")) for a in axes for b in axes])
    size = F.greatest(*[F.abs(F.col(f"__{a}{b}")) for a in axes for b in axes])
    return both.select("sample_id", (apart / F.nullif(size, F.lit(0.0))).alias("residual"))


def part_gates(rows: DataFrame, part: str = "batch", key: str = "sample_id") -> DataFrame:
    """(part, n, repeated, first_id, last_id, contiguous) of each part."""
    one = rows.groupBy(part, key).agg(F.count("*").alias("c"))
    out = one.groupBy(part).agg(F.sum("c").alias("n"), F.sum(F.when(F.col(key).isNull(), F.col("c")).otherwise(F.col("c") - 1)).alias("repeated"), F.min(key).alias("first_id"), F.max(key).alias("last_id"))
    return out.select(part, "n", "repeated", "first_id", "last_id", F.when(F.col("last_id") - F.col("first_id") + 1 == F.col("n"), 1).otherwise(0).alias("contiguous"))


def chosen_grow(pilot: DataFrame, target: float) -> DataFrame:
    """(rock, g, por): of each rock's settings (rock, g, perc, por) whose cubes all percolate, that with the
    porosity nearest to the target, the smaller g on a tie."""
    fine = pilot.where("perc = 1").groupBy("rock").agg(F.min(F.struct(F.round(F.abs(F.col("por") - target), 9).alias("off"), "g", "por")).alias("b"))
    return fine.select("rock", "b.g", F.round("b.por", 6).alias("por"))


# -- reports ---------------------------------------------------------------------------


def markdown(rows: DataFrame, limit: int = 1000, digits: int = 4) -> str:
    """A report as a markdown table; more rows than the limit raise, as a report isn't a table of data."""
    got = rows.limit(limit + 1).collect()
    if len(got) > limit:
        raise ValueError(f"more than {limit} rows")
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "-|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in got])
