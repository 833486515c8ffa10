"""PCA, factor analysis, k-means, MANOVA and linear discriminant analysis."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statweave.functions import dist
from statweave.functions.columns import col, drop_missing, known, num, numeric_columns, present, raw_label, require, text_list
from statweave.plans.gram import Moments, dot, gram, solve
from statweave.plans.tables import attach, cut, per_segment
from statweave.result import StatResult


def complete(df: DataFrame, columns: Sequence[str], by: Sequence[str], keep: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    require(df, *columns, *by, *keep)
    names = [f"_c{i}" for i in range(len(columns))]
    rows = df.where(present(df, *columns))
    return rows.select(*[col(b) for b in by], *[col(k) for k in keep], *[num(df, c).alias(n) for c, n in zip(columns, names)]), names


def _correlation(m: Moments) -> tuple[np.ndarray, np.ndarray]:
    """Correlation matrix and population deviations (a constant column keeps deviation 1)."""
    sd = np.sqrt(np.clip(np.diag(m.cross) / m.n, 0, None))
    sd = np.where(sd > 0, sd, 1.0)
    return m.cross / m.n / np.outer(sd, sd), sd


def _upright(vectors: np.ndarray) -> np.ndarray:
    """Turn every component so that its largest loading is positive."""
    top = np.argmax(np.abs(vectors), axis=0)
    signs = np.sign(vectors[top, np.arange(vectors.shape[1])])
    return vectors * np.where(signs == 0, 1.0, signs)


def pca(df: DataFrame, columns: Sequence[str] | None = None, n_components: int | None = None, by: Sequence[str] = (), keep: Sequence[str] = ()) -> StatResult:
    """Components of the standardised columns, from one cross-product pass."""
    by, columns = list(by), list(columns or numeric_columns(df, by))
    if len(columns) < 2:
        raise ValueError("Needs two numeric columns or more.")
    k = int(n_components or min(5, len(columns)))
    rows, names = complete(df, columns, by, keep)
    table = cut(gram(rows, names, by))

    def decompose(r):
        m = Moments(r)
        if not m.ok or m.n < 2:
            return None
        corr, sd = _correlation(m)
        values, vectors = np.linalg.eigh(corr)
        order = np.argsort(values)[::-1]
        return m, sd, np.clip(values[order], 0, None), _upright(vectors[:, order])

    def variance_rows(r):
        got = decompose(r)
        if got:
            m, _, values, _ = got
            share = values / values.sum()
            for i in range(k):
                yield {"component": f"PC{i + 1}", "eigenvalue": values[i] * m.n / (m.n - 1), "var_pct": share[i] * 100, "cum_pct": share[: i + 1].sum() * 100}

    def loading_rows(r):
        got = decompose(r)
        if got:
            for j, c in enumerate(columns):
                yield {"variable": c, **{f"PC{i + 1}": got[3][j, i] for i in range(k)}}

    def weight_row(r):
        got = decompose(r)
        if got:
            m, sd, _, vectors = got
            yield {"_m": m.mean.tolist(), "_v": (vectors / sd[:, None])[:, : min(3, k)].T.ravel().tolist()}

    shown = min(3, k)
    weights = per_segment(table, by, [("_m", "array<double>"), ("_v", "array<double>")], weight_row)
    stats = table.select(*by, "n", F.lit(len(columns)).cast("long").alias("p"), F.lit(k).cast("long").alias("n_components"), text_list().alias("warnings"))
    tables = {
        "variance": per_segment(table, by, [("component", "string"), ("eigenvalue", "double"), ("var_pct", "double"), ("cum_pct", "double")], variance_rows),
        "loadings": per_segment(table, by, [("variable", "string"), *[(f"PC{i + 1}", "double") for i in range(k)]], loading_rows),
    }
    if by or not weights.isEmpty():
        scored = attach(rows, weights, by)
        p = len(names)
        centred = [col(n) - F.col("_m")[j] for j, n in enumerate(names)]
        tables["scores"] = scored.select(*by, *keep, *[dot(centred, [F.col("_v")[i * p + j] for j in range(p)]).alias(f"PC{i + 1}") for i in range(shown)])
    return StatResult("pca", "Principal component analysis", stats, tables, by=by)


def factor_analysis(df: DataFrame, columns: Sequence[str] | None = None, n_factors: int | None = None, by: Sequence[str] = (), tol: float = 0.01, max_iter: int = 1000) -> StatResult:
    """Maximum-likelihood factors of the correlation matrix, unrotated."""
    by, columns = list(by), list(columns or numeric_columns(df, by))
    k = int(n_factors or min(3, max(1, len(columns) // 2)))
    rows, names = complete(df, columns, by)
    table = cut(gram(rows, names, by))

    def fit(r):
        m = Moments(r)
        if not m.ok or m.n < 2:
            return None
        corr, _ = _correlation(m)
        p = len(columns)
        noise, previous = np.ones(p), -math.inf
        loadings = np.zeros((p, k))
        for _ in range(max_iter):
            root = np.sqrt(noise) + 1e-12
            values, vectors = np.linalg.eigh(corr / np.outer(root, root))
            values, vectors = np.clip(values[::-1], 0, None), vectors[:, ::-1]
            loadings = vectors[:, :k] * np.sqrt(np.maximum(values[:k] - 1, 0)) * root[:, None]
            fitted = np.sum(np.log(np.maximum(values[:k], 1e-300))) + values[k:].sum() + np.sum(np.log(noise))
            likelihood = -m.n / 2 * (p * math.log(2 * math.pi) + k + fitted)
            if likelihood - previous < tol:
                break
            previous = likelihood
            noise = np.maximum(np.diag(corr) - np.sum(loadings**2, axis=1), 1e-12)
        return _upright(loadings), noise

    def loading_rows(r):
        got = fit(r)
        if got:
            for j, c in enumerate(columns):
                yield {"variable": c, **{f"F{i + 1}": got[0][j, i] for i in range(k)}}

    def noise_rows(r):
        got = fit(r)
        if got:
            for j, c in enumerate(columns):
                yield {"variable": c, "noise_variance": got[1][j]}

    stats = table.select(*by, "n", F.lit(k).cast("long").alias("n_factors"), text_list().alias("warnings"))
    tables = {
        "loadings": per_segment(table, by, [("variable", "string"), *[(f"F{i + 1}", "double") for i in range(k)]], loading_rows),
        "noise": per_segment(table, by, [("variable", "string"), ("noise_variance", "double")], noise_rows),
    }
    return StatResult("factor_analysis", "Exploratory factor analysis", stats, tables, by=by)


# Distances to centres are column expressions up to so many terms, and computed per Arrow batch beyond.
EXPRESSION_TERMS = 256


def kmeans(df: DataFrame, columns: Sequence[str] | None = None, k: int = 3, seed: int = 0, n_init: int = 1) -> StatResult:
    """Clusters of the standardised columns; the silhouette uses squared distances.

    Start centres come from Spark's k-means||; each round after it is one pass of sums per task over the numbers alone.
    """
    columns = list(columns or numeric_columns(df))
    rows, names = complete(df, columns, [])
    facts = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(n).alias(f"m{n}") for n in names], *[F.stddev_pop(n).alias(f"s{n}") for n in names]).first()
    if not facts["n"]:
        raise ValueError("No complete rows.")
    scaled = rows.select(*[((col(n) - facts[f"m{n}"]) / (facts[f"s{n}"] or 1.0)).alias(n) for n in names])
    # Every round reads the rows again, so they are kept.
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(scaled).persist()
    points = vectors.select(*names)
    starts = [np.array(KMeans(k=int(k), seed=seed + i, maxIter=0).fit(vectors).clusterCenters()) for i in range(n_init)]
    centers, _ = min((_moved(points, s, max_iter=300, tol=1e-4) for s in starts), key=lambda found: found[1])
    spark = df.sparkSession
    table = cut(_assigned(points, centers))
    sizes = table.select("cluster", "n", "_off")
    silhouette = None
    if len(centers) > 1 and facts["n"] > len(centers):
        silhouette = _silhouette(points, centers, table.collect(), facts["n"])
    vectors.unpersist()
    stats = sizes.agg(F.sum("_off").alias("inertia"), F.sum("n").alias("n")).select(
        F.lit(int(k)).cast("long").alias("k"), "inertia", F.lit(silhouette).cast("double").alias("silhouette"), "n", text_list().alias("warnings")
    )
    schema = "cluster int, " + ", ".join(f"`{c}` double" for c in columns)
    table = spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(centers)], schema)
    return StatResult("kmeans", f"K-means clustering (k={k})", stats, {"centers": table, "sizes": sizes.drop("_off")})


def _nearest(batch: pa.RecordBatch, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of a batch, their nearest centres (ties: the first) and squared distances."""
    x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
    nearest, off = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
    for i, c in enumerate(centers):
        d = ((x - c) ** 2).sum(axis=1)
        closer = d < off
        nearest[closer], off[closer] = i, d[closer]
    return x, nearest, off


def _assigned(points: DataFrame, centers: np.ndarray) -> DataFrame:
    """Of each cluster that has rows: cluster, n, sums of the columns and of squares, summed squared distances."""
    k, p = centers.shape
    if k * p <= EXPRESSION_TERMS:
        x = [col(c) for c in points.columns]
        square = lambda c: reduce(add, [(v - float(m)) * (v - float(m)) for v, m in zip(x, c)])
        away = [F.col(f"_d{i}") for i in range(k)]
        measured = points.select(*x, *[square(c).alias(f"_d{i}") for i, c in enumerate(centers)])
        measured = measured.withColumn("_off", F.least(*away) if k > 1 else away[0])
        nearest = F.coalesce(*[F.when(d == F.col("_off"), F.lit(i)) for i, d in enumerate(away)])
        return measured.groupBy(nearest.alias("cluster")).agg(
            F.count(F.lit(1)).alias("n"), F.array(*[F.sum(v) for v in x]).alias("_sums"), F.sum(reduce(add, [v * v for v in x])).alias("_squares"), F.sum("_off").alias("_off")
        )

    def run(batches):
        n, sums, squares, offs = np.zeros(k, np.int64), np.zeros((k, p)), np.zeros(k), np.zeros(k)
        for batch in batches:
            x, nearest, off = _nearest(batch, centers)
            n += np.bincount(nearest, minlength=k)
            for j in range(p):
                sums[:, j] += np.bincount(nearest, x[:, j], minlength=k)
            squares += np.bincount(nearest, (x * x).sum(axis=1), minlength=k)
            offs += np.bincount(nearest, off, minlength=k)
        some = np.flatnonzero(n)
        parts = [some.astype(np.int32), n[some], sums[some].tolist(), squares[some], offs[some]]
        types = [pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(parts, types)], ["cluster", "n", "_sums", "_squares", "_off"])

    found = points.mapInArrow(run, "cluster int, n long, _sums array<double>, _squares double, _off double")
    return found.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("_sums")[j]) for j in range(p)]).alias("_sums"), F.sum("_squares").alias("_squares"), F.sum("_off").alias("_off"))


def _moved(points: DataFrame, centers: np.ndarray, max_iter: int, tol: float) -> tuple[np.ndarray, float]:
    """Centres moved to the means of their rows until none moves farther than ``tol``, and the summed squared distances before the last move."""
    cost = math.inf
    for _ in range(max_iter):
        found = _assigned(points, centers).collect()
        moved = centers.copy()
        for r in found:
            moved[r["cluster"]] = np.array(r["_sums"]) / r["n"]
        cost = sum(r["_off"] for r in found)
        far = ((moved - centers) ** 2).sum(axis=1).max()
        centers = moved
        if far <= tol * tol:
            break
    return centers, cost


def _silhouette(points: DataFrame, centers: np.ndarray, clusters: list, n: int) -> float | None:
    """Mean silhouette under squared distances; a row's summed distance to a cluster follows from the cluster's sums."""
    if len(clusters) < 2:
        return None
    place = {r["cluster"]: i for i, r in enumerate(clusters)}
    own = np.array([place.get(i, -1) for i in range(len(centers))])
    size, sums, squares = (np.array([r[c] for r in clusters], float) for c in ("n", "_sums", "_squares"))

    def run(batches):
        total = 0.0
        for batch in batches:
            x, nearest, _ = _nearest(batch, centers)
            mine, every = own[nearest], np.arange(len(x))
            mean = (x * x).sum(axis=1)[:, None] + squares / size - 2 * x @ (sums / size[:, None]).T
            lone = size[mine] == 1
            a = mean[every, mine] * size[mine] / np.where(lone, 1, size[mine] - 1)
            mean[every, mine] = np.inf
            b = mean.min(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                s = np.where(a < b, 1 - a / b, np.where(a > b, b / a - 1, 0.0))
            total += float(np.where(lone, 0.0, s).sum())
        yield pa.RecordBatch.from_arrays([pa.array([total])], ["s"])

    return float(points.mapInArrow(run, "s double").agg(F.sum("s")).first()[0]) / n


MANOVA_FIELDS = [("statistic", "string"), ("value", "double"), ("num_df", "double"), ("den_df", "double"), ("F", "double"), ("p_value", "double")]


def manova(df: DataFrame, dvs: Sequence[str], group: str, by: Sequence[str] = ()) -> StatResult:
    """Wilks, Pillai, Hotelling–Lawley and Roy from the within and total cross products."""
    by, dvs = list(by), list(dvs or [])
    if not dvs or not group:
        raise ValueError("Needs outcome columns and a group.")
    require(df, *dvs, group, *by)
    names = [f"_c{i}" for i in range(len(dvs))]
    rows = drop_missing(df.select(*[col(b) for b in by], raw_label(known(df, group)).alias("_g"), *[num(df, d).alias(n) for d, n in zip(dvs, names)]), ["_g", *names])
    within = gram(rows, names, [*by, "_g"])
    p = len(dvs)

    def one_group(r):
        m = Moments(r)
        yield {"n": m.n, "m": m.mean.tolist(), "e": m.cross.ravel().tolist()}

    groups = per_segment(within, [*by, "_g"], [("n", "long"), ("m", "array<double>"), ("e", "array<double>")], one_group)
    # Within products add up over groups; between products need the weighted means.
    listed = groups.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("k"),
        F.array(*[F.sum(F.col("e")[i]) for i in range(p * p)]).alias("e"),
        F.array(*[F.sum(F.col("n") * F.col("m")[i]) for i in range(p)]).alias("s"),
        F.collect_list(F.struct("n", "m")).alias("groups"),
    )

    def finish(r):
        n, k = r["n"], r["k"]
        if k < 2 or n <= k:
            return
        e = np.array(r["e"], float).reshape(p, p)
        grand = np.array(r["s"], float) / n
        h = np.zeros((p, p))
        for g in r["groups"]:
            d = np.array(g["m"], float) - grand
            h += g["n"] * np.outer(d, d)
        roots = np.clip(np.real(np.linalg.eigvals(solve(e) @ h)), 0, None)
        yield from manova_rows(np.sort(roots)[::-1], p, k - 1, n - k)

    stats = listed.select(*by, "n", F.lit(p).cast("long").alias("p"), text_list().alias("warnings"))
    return StatResult("manova", "MANOVA", stats, {"mv_test": per_segment(listed, by, MANOVA_FIELDS, finish)}, by=by)


def manova_rows(roots: np.ndarray, p: int, q: int, v: int):
    """The four statistics with their F approximations (p outcomes, q hypothesis df, v error df)."""
    s = min(p, q)
    m, n = (abs(p - q) - 1) / 2, (v - p - 1) / 2
    wilks, pillai, hotelling, roy = float(np.prod(1 / (1 + roots))), float(np.sum(roots / (1 + roots))), float(roots.sum()), float(roots.max())

    t = math.sqrt((p * p * q * q - 4) / (p * p + q * q - 5)) if p * p + q * q - 5 > 0 else 1.0
    df2 = (v - (p - q + 1) / 2) * t - (p * q - 2) / 2
    root = wilks ** (1 / t)
    yield _manova_row("Wilks' lambda", wilks, p * q, df2, (1 - root) / root * df2 / (p * q) if root > 0 else math.inf)

    df1, df2 = s * (2 * m + s + 1), s * (2 * n + s + 1)
    yield _manova_row("Pillai's trace", pillai, df1, df2, df2 / df1 * pillai / (s - pillai) if s > pillai else math.inf)

    if n > 0:
        b = (p + 2 * n) * (q + 2 * n) / (2 * (2 * n + 1) * (n - 1)) if n != 1 else math.inf
        df1, df2 = p * q, 4 + (p * q + 2) / (b - 1)
        f = df2 / df1 * hotelling * 2 * n / (df2 - 2)
    else:
        df1, df2 = s * (2 * m + s + 1), 2 * (s * n + 1)
        f = df2 / df1 / s * hotelling
    yield _manova_row("Hotelling-Lawley trace", hotelling, df1, df2, f)

    df1 = max(p, q)
    df2 = v - df1 + q
    yield _manova_row("Roy's greatest root", roy, df1, df2, df2 / df1 * roy)


def _manova_row(name: str, value: float, df1: float, df2: float, f: float) -> dict:
    return {"statistic": name, "value": value, "num_df": df1, "den_df": df2, "F": f, "p_value": dist.f_sf(f, df1, df2)}


def lda(df: DataFrame, y: str, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> StatResult:
    """Linear discriminant classes with their in-sample accuracy."""
    by = list(by)
    columns = list(columns or numeric_columns(df, [*by, y]))
    require(df, y, *columns, *by)
    names = [f"_c{i}" for i in range(len(columns))]
    rows = drop_missing(df.select(*[col(b) for b in by], raw_label(known(df, y)).alias("_g"), *[num(df, c).alias(n) for c, n in zip(columns, names)]), ["_g", *names])
    p = len(columns)

    def one_class(r):
        m = Moments(r)
        yield {"n": m.n, "m": m.mean.tolist(), "e": m.cross.ravel().tolist()}

    classes = cut(per_segment(gram(rows, names, [*by, "_g"]), [*by, "_g"], [("n", "long"), ("m", "array<double>"), ("e", "array<double>")], one_class))
    pooled = classes.groupBy(*by).agg(
        F.array(*[F.sum(F.col("e")[i]) for i in range(p * p)]).alias("e"), F.array_sort(F.collect_list(F.struct("_g", "n", "m"))).alias("classes")
    )

    def discriminants(r):
        total = sum(c["n"] for c in r["classes"])
        k = len(r["classes"])
        inverse = solve(np.array(r["e"], float).reshape(p, p) / max(total - k, 1))
        out = []
        for c in r["classes"]:
            mean = np.array(c["m"], float)
            w = inverse @ mean
            out.append({"label": c["_g"], "bias": float(-0.5 * mean @ w + math.log(c["n"] / total)), "w": w.tolist()})
        yield {"_classes": out}

    rules = per_segment(pooled, by, [("_classes", "array<struct<label: string, bias: double, w: array<double>>>")], discriminants)
    joined = attach(rows.select(*by, "_g", F.array(*names).alias("_x")), rules, by)
    score = lambda c: c["bias"] + F.aggregate(F.zip_with("_x", c["w"], lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    best = F.array_max(F.transform("_classes", lambda c: F.struct(score(c).alias("score"), c["label"].alias("label"))))["label"]
    stats = joined.select(*by, (best == F.col("_g")).cast("double").alias("_hit"), F.size("_classes").alias("_k")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_hit").alias("accuracy_in_sample"), F.max("_k").cast("long").alias("n_classes")
    )
    stats = stats.withColumn("warnings", text_list(F.lit("Accuracy is measured on the rows used for fitting.")))
    sizes = classes.groupBy(*by).agg(F.sum("n").alias("_all"))
    table = attach(classes.select(*by, F.col("_g").alias("class"), "n"), sizes, by).select(*by, "class", "n", (F.col("n") / F.col("_all")).alias("prior"))
    return StatResult("lda", "Linear discriminant analysis", stats, {"classes": table}, by=by)
