"""Bootstrap and permutation inference without moving rows through one task.

Values are counted, cut into ranges, and the resample is drawn in two exact
stages: how many draws fall into each range, then which values inside the range
(one task per range).  The first stage runs down a tree over the ranges: a node
deals its draws to its children, for a block of replicates at a time, so neither
a row nor a task holds all ranges for all replicates.  For the bootstrap a node's
draws are multinomial, for the permutation multivariate hypergeometric, and the
result has the same distribution as resampling the whole column.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statweave.functions.columns import col, text_list
from statweave.operators.groups import Y, group_moments, grouped, outcome, side_by_side, two_groups
from statweave.plans.quantiles import exact_quantiles
from statweave.plans.ranks import RANGE, cut_points, with_range
from statweave.plans.tables import attach, cut, failing, null_safe
from statweave.result import StatResult

# Distinct values per resampling task.
VALUES_PER_TASK = 50_000
# Children of a node of the tree over the ranges, and replicates dealt at a time.
FAN_OUT = 64
BLOCK = 250
# Up to here the generator's own hypergeometric draws are exact.
GENERATOR_LIMIT = 1_000_000_000


def _generator(seed: int, key: tuple) -> np.random.Generator:
    digest = sum((i + 1) * b for i, b in enumerate(repr(key).encode())) % (1 << 32)
    return np.random.default_rng([seed, digest, len(repr(key))])


_SMALL = np.array([math.lgamma(k + 1.0) for k in range(64)])


def _log_factorial_ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log(a! / b!), without the cancellation that two large logarithms would suffer."""
    small = (a < 32) | (b < 32)
    p, q = np.where(small, 64.0, a), np.where(small, 64.0, b)
    series = lambda x: 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    out = (p - q) * (np.log(q) - 1) + (p + 0.5) * np.log1p((p - q) / q) + series(p) - series(q)
    if small.any():
        whole = lambda x: np.array([_SMALL[int(v)] if v < 64 else math.lgamma(v + 1.0) for v in x])
        out[small] = whole(a[small]) - whole(b[small])
    return out


def _by_ratio_of_uniforms(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, take: np.ndarray) -> np.ndarray:
    """Hypergeometric draws of any size: points under the square root of the density, in a box that holds all of it.

    The box is the table mountain hat for densities that are concave in the
    logarithm; rejection makes the draws exact, whatever the hat.
    """
    g, b, m = (x.astype(float) for x in (good, bad, take))
    total = g + b
    low, high = np.maximum(0.0, m - b), np.minimum(g, m)
    mode = np.clip(np.floor((m + 1) * (g + 1) / (total + 2)), low, high)
    middle = m * g / total + 0.5
    spread = np.sqrt(np.maximum(m * (g / total) * (b / total) * (total - m) / np.maximum(total - 1, 1), 0.0) + 0.5)
    width = 2 * np.sqrt(2 / math.e) * spread + (3 - 2 * np.sqrt(3 / math.e))
    out, open_ = np.zeros(len(g)), np.arange(len(g))
    while len(open_):
        u, v = 1.0 - rng.random(len(open_)), rng.random(len(open_))
        x = np.floor(middle[open_] + width[open_] * (v - 0.5) / u)
        inside = (x >= low[open_]) & (x <= high[open_])
        at, x, u = open_[inside], x[inside], u[inside]
        k, gg, bb, mm = mode[at], g[at], b[at], m[at]
        log = -(_log_factorial_ratio(x, k) + _log_factorial_ratio(gg - x, gg - k) + _log_factorial_ratio(mm - x, mm - k) + _log_factorial_ratio(bb - mm + x, bb - mm + k))
        taken = 2 * np.log(u) <= log
        out[at[taken]] = x[taken]
        left = np.ones(len(open_), dtype=bool)
        left[np.flatnonzero(inside)[taken]] = False
        open_ = open_[left]
    return out.astype(np.int64)


def _hypergeometric(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, take: np.ndarray) -> np.ndarray:
    """Exact hypergeometric draws: by the generator within its range, by ratio of uniforms beyond."""
    small = good + bad < GENERATOR_LIMIT
    out = np.zeros(len(take), np.int64)
    if small.any():
        out[small] = rng.hypergeometric(good[small], bad[small], take[small])
    if (~small).any():
        out[~small] = _by_ratio_of_uniforms(rng, good[~small], bad[~small], take[~small])
    return out


def _split_without_replacement(rng: np.random.Generator, sizes: np.ndarray, take: np.ndarray) -> np.ndarray:
    """take[r] draws split over sizes, for every replicate r: array (replicates, sizes)."""
    out = np.zeros((len(take), len(sizes)), np.int64)
    left = take.astype(np.int64).copy()
    rest = int(sizes.sum())
    for i, size in enumerate(sizes):
        rest -= int(size)
        out[:, i] = _hypergeometric(rng, np.full(len(left), size, np.int64), np.full(len(left), rest, np.int64), left)
        left -= out[:, i]
    return out


def _ranges(counts: DataFrame, by: list[str]) -> DataFrame:
    return with_range(counts, "_v", cut_points(counts, "_v", VALUES_PER_TASK))


def _draws(ranged: DataFrame, by: list[str], reps: int, seed: int, take: str | None) -> DataFrame:
    """Per (segment, range, block of replicates): how many draws each replicate has in the range, and in those before it."""
    extra = [take] if take else []
    sizes = cut(ranged.groupBy(*by, RANGE).agg(F.sum("_c").alias("_size"), *[F.max(t).alias(t) for t in extra]))
    depth, ranges = 1, sizes.agg(F.max(RANGE)).first()[0] or 0
    while FAN_OUT**depth <= ranges:
        depth += 1
    keys = [ranged.schema[b] for b in by]
    node = [T.StructField("_node", T.LongType()), T.StructField("_block", T.IntegerType())]
    arrays = [T.StructField("_before", T.ArrayType(T.LongType())), T.StructField("_m", T.ArrayType(T.LongType()))]
    schema = T.StructType([*keys, *node, *arrays])

    def deal(level: int):
        def run(children: pd.DataFrame, parents: pd.DataFrame) -> pd.DataFrame:
            children = children.sort_values("_node")
            n = children["_size"].to_numpy(np.int64)
            key = tuple(children[by].iloc[0]) if by else ()
            rows = []
            for block, before, m in zip(parents["_block"], parents["_before"], parents["_m"], strict=True):
                rng = _generator(seed, (*key, level, int(children["_node"].iloc[0]) // FAN_OUT, int(block)))
                m = np.asarray(m, np.int64)
                split = _split_without_replacement(rng, n, m) if take else np.array([rng.multinomial(int(k), n / n.sum()) for k in m])
                earlier = np.cumsum(split, axis=1) - split + np.asarray(before, np.int64)[:, None]
                rows += [(int(c), int(block), earlier[:, i].tolist(), split[:, i].tolist()) for i, c in enumerate(children["_node"])]
            out = pd.DataFrame(rows, columns=["_node", "_block", "_before", "_m"])
            for name in by:
                out[name] = [children[name].iloc[0]] * len(out)
            return out[schema.names]

        return run

    blocks = [(k, min(BLOCK, reps - k * BLOCK)) for k in range(-(-reps // BLOCK))]
    per_block = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(size).alias("size")) for k, size in blocks])).alias("_b")
    total = F.max(take) if take else F.sum("_size")
    root = sizes.groupBy(*by).agg(total.cast("long").alias("_total")).select(*by, "_total", per_block)
    zero = F.lit(0).cast("long")
    dealt = root.select(*by, zero.alias("_node"), F.col("_b.k").alias("_block"), F.array_repeat(zero, F.col("_b.size")).alias("_before"), F.array_repeat("_total", F.col("_b.size")).alias("_m"))
    for level in range(1, depth + 1):
        at = F.floor(F.col(RANGE) / float(FAN_OUT ** (depth - level))).cast("long")
        nodes = sizes.groupBy(*by, at.alias("_node")).agg(F.sum("_size").alias("_size")).withColumn("_parent", F.floor(F.col("_node") / FAN_OUT))
        dealt = nodes.groupBy(*by, "_parent").cogroup(dealt.withColumn("_parent", F.col("_node")).groupBy(*by, "_parent")).applyInPandas(deal(level), schema)
    return dealt.withColumn(RANGE, F.col("_node").cast("int")).drop("_node")


def _per_range(ranged: DataFrame, draws: DataFrame, by: list[str], fn, fields: list[T.StructField]) -> DataFrame:
    schema = T.StructType([ranged.schema[b] for b in by] + fields)
    keys = [*by, RANGE]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("_v"), right.sort_values("_block")
        key = tuple(right[by].iloc[0]) if by else ()
        # The blocks of replicates one behind the other.
        split = right.iloc[0].copy()
        for name in ("_before", "_m"):
            split[name] = np.concatenate([np.asarray(x, np.int64) for x in right[name]])
        out = fn(left, split, (*key, int(split[RANGE])))
        # Keys are repeated from the input, which keeps their type when nothing was drawn here.
        keys = right[by].iloc[np.zeros(len(out), int)].reset_index(drop=True)
        return pd.concat([keys, out.reset_index(drop=True)], axis=1)[schema.names]

    return ranged.groupBy(*keys).cogroup(draws.groupBy(*keys)).applyInPandas(run, schema)


def bootstrap_ci(df: DataFrame, column: str, stat: str = "mean", n_boot: int = 2000, seed: int = 0, by: Sequence[str] = ()) -> StatResult:
    """Percentile interval of the mean, median or standard deviation."""
    if stat not in ("mean", "median", "std"):
        raise ValueError(f"Unknown statistic '{stat}'.")
    by = list(by)
    data = outcome(df, column, by)
    counts = data.groupBy(*by, col(Y).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    ranged = _ranges(counts, by)
    draws = _draws(ranged, by, n_boot, seed, None)
    base = data.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(Y).alias("mean"), F.stddev_samp(Y).alias("std"))
    base = cut(side_by_side(base, exact_quantiles(data, [Y], [0.5], by).select(*by, F.col("q")[0].alias("median")), by))
    if stat == "median":
        reps = _bootstrap_medians(ranged, draws, by, n_boot, seed)
    else:
        reps = _bootstrap_moments(ranged, draws, by, n_boot, seed, stat)
    bounds = reps.groupBy(*by).agg(F.percentile("_stat", F.array(F.lit(0.025), F.lit(0.975))).alias("_q"))
    joined = side_by_side(base, bounds, by)
    stats = joined.select(
        *by,
        failing(by, F.col("n") > 0, F.col(stat), f"'{column}' holds no numbers.").alias("estimate"),
        F.col("_q")[0].alias("ci95_low"),
        F.col("_q")[1].alias("ci95_high"),
        F.lit(n_boot).cast("long").alias("n_boot"),
        "n",
        F.lit(stat).alias("stat"),
        text_list().alias("warnings"),
    )
    return StatResult("bootstrap_ci", f"Bootstrap 95% CI ({stat})", stats, by=by)


def _bootstrap_moments(ranged: DataFrame, draws: DataFrame, by: list[str], reps: int, seed: int, stat: str) -> DataFrame:
    def resample(values: pd.DataFrame, split: pd.Series, key: tuple) -> pd.DataFrame:
        rng = _generator(seed + 1, key)
        v, c = values["_v"].to_numpy(float), values["_c"].to_numpy(float)
        middle = float(np.average(v, weights=c))
        s1, s2 = np.empty(reps), np.empty(reps)
        for r, m in enumerate(split["_m"]):
            k = rng.multinomial(int(m), c / c.sum())
            d = v - middle
            s1[r], s2[r] = k @ d, k @ (d * d)
        return pd.DataFrame({"_rep": np.arange(reps), "_k": np.asarray(split["_m"], np.int64), "_mid": middle, "_s1": s1, "_s2": s2})

    fields = [T.StructField("_rep", T.IntegerType()), T.StructField("_k", T.LongType()), *[T.StructField(f, T.DoubleType()) for f in ("_mid", "_s1", "_s2")]]
    parts = _per_range(ranged, draws, by, resample, fields).where("_k > 0")
    # Merge the ranges: each carries its count, mean and sum of squares about its own middle.
    mean = F.col("_mid") + F.col("_s1") / F.col("_k")
    inner = F.col("_s2") - F.col("_s1") * F.col("_s1") / F.col("_k")
    merged = parts.select(*by, "_rep", "_k", mean.alias("_mean"), inner.alias("_inner"))
    total = merged.groupBy(*by, "_rep").agg(F.sum("_k").alias("_n"), (F.sum(F.col("_k") * F.col("_mean")) / F.sum("_k")).alias("_stat"), F.sum("_inner").alias("_in"))
    if stat == "mean":
        return total
    both = null_safe(merged.select(*by, "_rep", "_k", "_mean"), total, [*by, "_rep"])
    gap = F.col("_mean") - F.col("_stat")
    spread = both.groupBy(*by, "_rep").agg(F.max("_n").alias("_n"), (F.max("_in") + F.sum(F.col("_k") * gap * gap)).alias("_ss"))
    return spread.withColumn("_stat", F.sqrt(F.col("_ss") / (F.col("_n") - 1)))


def _bootstrap_medians(ranged: DataFrame, draws: DataFrame, by: list[str], reps: int, seed: int) -> DataFrame:
    """The split tells which range holds a replicate's middle ranks; only there are values drawn."""
    sizes = ranged.groupBy(*by).agg(F.sum("_c").alias("_n"))
    sized = attach(draws, sizes, by)

    def resample(values: pd.DataFrame, split: pd.Series, key: tuple) -> pd.DataFrame:
        rng = _generator(seed + 1, key)
        v, c = values["_v"].to_numpy(float), values["_c"].to_numpy(float)
        n = int(split["_n"])
        reps_held, drawn = [], []
        for r, (m, before) in enumerate(zip(split["_m"], split["_before"])):
            wanted = [k - before for k in ((n - 1) // 2, n // 2) if before <= k < before + m]
            if not wanted:
                continue
            upto = np.cumsum(rng.multinomial(int(m), c / c.sum()))
            reps_held += [r] * len(wanted)
            drawn += [float(v[np.searchsorted(upto, w, side="right")]) for w in wanted]
        return pd.DataFrame({"_rep": np.array(reps_held, np.int32), "_x": np.array(drawn, float)})

    fields = [T.StructField("_rep", T.IntegerType()), T.StructField("_x", T.DoubleType())]
    return _per_range(ranged, sized, by, resample, fields).groupBy(*by, "_rep").agg(F.avg("_x").alias("_stat"))


def permutation_test(df: DataFrame, y: str, x: str, levels: Sequence[str] | None = None, n_perm: int = 2000, seed: int = 0, by: Sequence[str] = ()) -> StatResult:
    """Two-group mean difference under random relabelling."""
    by = list(by)
    data = grouped(df, y, x, by, levels)
    pair = cut(two_groups(group_moments(data, by), by))
    ok = F.col("n_groups") == 2
    if not by:
        first = pair.first()
        if first is None or first["n_groups"] != 2:
            raise ValueError("Needs two groups.")
    usable = pair.where(ok)
    counts = data.groupBy(*by, col(Y).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    counts = attach(counts, usable.select(*by, F.col("n_1").alias("_take")), by)
    ranged = _ranges(counts, by)
    draws = _draws(ranged, by, n_perm, seed, "_take")

    def relabel(values: pd.DataFrame, split: pd.Series, key: tuple) -> pd.DataFrame:
        rng = _generator(seed + 1, key)
        v, c = values["_v"].to_numpy(float), values["_c"].to_numpy(np.int64)
        middle = float(np.average(v, weights=c))
        take = np.asarray(split["_m"], np.int64)
        total = int(c.sum())
        sums = np.empty(n_perm)
        if total <= 4 * len(c):
            owner = np.repeat(v - middle, c)
            for r, m in enumerate(take):
                sums[r] = owner[rng.choice(total, int(m), replace=False, shuffle=False)].sum() if m else 0.0
        else:
            sums = _split_without_replacement(rng, c, take) @ (v - middle)
        return pd.DataFrame({"_rep": np.arange(n_perm), "_k": take, "_mid": middle, "_s": sums})

    fields = [T.StructField("_rep", T.IntegerType()), T.StructField("_k", T.LongType()), T.StructField("_mid", T.DoubleType()), T.StructField("_s", T.DoubleType())]
    parts = _per_range(ranged, draws, by, relabel, fields)
    facts = usable.select(*by, "n_1", "n_2", (F.col("mean_1") - F.col("mean_2")).alias("_obs"), ((F.col("n_1") * F.col("mean_1") + F.col("n_2") * F.col("mean_2")) / (F.col("n_1") + F.col("n_2"))).alias("_grand"))
    shifted = attach(parts, facts, by)
    reps = shifted.groupBy(*by, "_rep").agg(
        F.sum(F.col("_s") + F.col("_k") * (F.col("_mid") - F.col("_grand"))).alias("_sum"), *[F.max(c).alias(c) for c in ("n_1", "n_2", "_obs")]
    )
    # With the grand mean removed, the second group's sum is the first one's with the sign turned.
    gap = F.col("_sum") / F.col("n_1") + F.col("_sum") / F.col("n_2")
    close = F.abs(gap) >= F.abs("_obs") * (1 - 1e-12)
    hits = reps.groupBy(*by).agg(F.count_if(close).alias("_hits"))
    joined = side_by_side(pair, hits, by)
    stats = joined.select(
        *by,
        F.when(ok, F.col("mean_1") - F.col("mean_2")).alias("mean_diff"),
        F.when(ok, (F.col("_hits") + 1) / F.lit(float(n_perm + 1))).alias("p_value"),
        F.lit(n_perm).cast("long").alias("n_perm"),
        "group_1",
        "group_2",
        "n_1",
        "n_2",
        (F.col("n_1") + F.col("n_2")).alias("n"),
        text_list(F.when(~ok, F.lit("requires exactly 2 groups"))).alias("warnings"),
    )
    return StatResult("permutation_test", "Two-group permutation test (mean difference)", stats, formula="share of relabelled mean differences at least as large as the one seen", by=by)
