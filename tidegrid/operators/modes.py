"""Linear modes: principal components, encode, decode, ablate, align, recurse.

Modes of a field are a loadings table (one weight per mode and cell). Where a mode is left out
or replaced, variances follow from two small matrices (covariance of the series, products of
the loadings), so no ablated field is ever written out to be measured.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions.kernels import draw_positions
from tidegrid.functions.sizing import checked_side
from tidegrid.functions.stats import pearson
from tidegrid.operators.gram import correlation_table, covariances, gram_matrix, mode_vectors
from tidegrid.operators.series_kernels import array_kernel, heavy, pack_series
from tidegrid.session import cut_lineage

GRID = ["lat_i", "lon_i"]

#: Times of an axis whose matrix of pairs (128 MB) one task holds.
MOST_TIMES = 4000


def _array_of(df: DataFrame, keys: list[str], modes: list, value: str, name: str) -> DataFrame:
    """Values of the listed modes side by side, one array per key; a mode that is not there is NULL."""
    return mode_vectors(df, keys, modes, value, complete=False).withColumnRenamed("vec", name)


def _dot(a: str, b: str, n: int, skip: int | None = None) -> Column:
    """Sum of products; a mode without weight adds nothing, one without a value makes the sum NULL."""
    terms = [F.when(F.element_at(a, i + 1).isNull(), F.lit(0.0)).otherwise(F.element_at(a, i + 1) * F.element_at(b, i + 1)) for i in range(n) if i != skip]
    out = terms[0]
    for term in terms[1:]:
        out = out + term
    return out


# -- encode and decode -------------------------------------------------------------------------


def encode(field: DataFrame, loadings: DataFrame, modes: list, by: list[str], cell: list[str] = GRID) -> DataFrame:
    """Mode series: per group and month the sum of weight times value over the cells.

    All modes are summed side by side, so field rows are not multiplied by the modes. A cell counts for the modes that it has a weight
    for; a month without a value in any cell of a mode is NULL.
    """
    w = checked_side(_array_of(loadings, cell, modes, "w", "_w"))
    z = field.join(w, cell)
    sums = [F.sum(F.element_at("_w", i + 1) * F.col("value")).alias(f"_z{i}") for i in range(len(modes))]
    wide = z.groupBy(*by, "month_idx").agg(*sums)
    rows = F.array(*[F.struct(F.lit(m).alias("mode"), F.col(f"_z{i}").alias("value")) for i, m in enumerate(modes)])
    return wide.select(*by, "month_idx", F.explode(rows).alias("r")).select(*by, "month_idx", "r.*")


def _with_modes(target: DataFrame, series: DataFrame, loadings: DataFrame, modes: list, by: list[str], cell: list[str]) -> DataFrame:
    w = checked_side(_array_of(loadings, cell, modes, "w", "_w"))
    z = checked_side(_array_of(series, [*by, "month_idx"], modes, "value", "_z"))
    return target.join(w, cell).join(z, [*by, "month_idx"], "left")


def decode(target: DataFrame, series: DataFrame, loadings: DataFrame, modes: list, by: list[str], cell: list[str] = GRID) -> DataFrame:
    """Adds ``decoded`` to the rows of ``target``: sum over modes of weight times series; NULL where a mode of the cell is not known."""
    z = _with_modes(target, series, loadings, modes, by, cell)
    return z.withColumn("decoded", _dot("_w", "_z", len(modes))).drop("_w", "_z")


def decode_without(target: DataFrame, series: DataFrame, loadings: DataFrame, modes: list, by: list[str], cell: list[str] = GRID) -> DataFrame:
    """Decoding with one mode set to zero, for each mode: rows ``(..., without, decoded)``."""
    z = _with_modes(target, series, loadings, modes, by, cell)
    parts = F.array(*[F.struct(F.lit(m).alias("without"), _dot("_w", "_z", len(modes), skip=i).alias("decoded")) for i, m in enumerate(modes)])
    keep = [c for c in target.columns]
    return z.select(*keep, F.explode(parts).alias("p")).select(*keep, "p.*")


def keep_first(series: DataFrame, order: list, k: int, by: list[str]) -> DataFrame:
    """Only the first ``k`` modes of ``order`` vary; the others stay at their mean."""
    mean = F.avg("value").over(Window.partitionBy(*by, "mode"))
    return series.withColumn("value", F.when(F.col("mode").isin(list(order[:k])), F.col("value")).otherwise(mean))


def remove_modes(field: DataFrame, series: DataFrame, loadings: DataFrame, modes: list, by: list[str], cell: list[str] = GRID) -> DataFrame:
    """Residual for the next recursion: the field minus its decoding."""
    out = decode(field, series, loadings, modes, by, cell)
    return out.withColumn("value", F.col("value") - F.col("decoded")).drop("decoded")


# -- variance shares ---------------------------------------------------------------------------


def loading_products(loadings: DataFrame, modes: list, cell: list[str] = GRID) -> DataFrame:
    """Sums over cells of products of loadings, ``(i, j, p)``, and of the loadings, in row ``i = size``."""
    whole = _array_of(loadings, cell, modes, "w", "vec").withColumn("vec", F.transform("vec", lambda w: F.coalesce(w, F.lit(0.0))))
    g = gram_matrix(whole, "vec")
    width = F.col("size") + 1
    return g.select("size", F.posexplode("gram").alias("at", "p"), width.alias("_k")).select(
        F.floor(F.col("at") / F.col("_k")).cast("int").alias("i"), (F.col("at") % F.col("_k")).cast("int").alias("j"), "p", "size"
    )


def variance_shares(series: DataFrame, loadings: DataFrame, modes: list, by: list[str], data_variance: DataFrame | None = None, cell: list[str] = GRID) -> DataFrame:
    """Share of decoded variance lost when a mode stays at its mean, per group and mode.

    ``share`` sums to 1 over the modes; with ``data_variance(by, variance)`` also ``absolute``,
    the share times decoded over data variance.
    """
    cov = covariances(mode_vectors(series, [*by, "month_idx"], modes), "vec", by)
    prod = loading_products(loadings, modes, cell).filter((F.col("i") < F.col("size")) & (F.col("j") < F.col("size"))).drop("size")
    z = cov.join(checked_side(prod), ["i", "j"]).withColumn("v", F.col("cov") * F.col("p"))
    full = F.sum("v")
    lost = [F.abs(F.try_divide(F.sum(F.when((F.col("i") == m) | (F.col("j") == m), F.col("v")).otherwise(0.0)), full)) for m in range(len(modes))]
    wide = z.groupBy(*by).agg(full.alias("_full"), F.array(*lost).alias("_lost"))
    total = F.aggregate("_lost", F.lit(0.0), lambda a, x: a + x)
    rows = F.arrays_zip(F.lit(list(modes)).alias("mode"), F.transform("_lost", lambda x: F.try_divide(x, total)).alias("share"))
    out = wide.select(*by, "_full", F.explode(rows).alias("r")).select(*by, "r.mode", "r.share", "_full")
    if data_variance is not None:
        out = out.join(data_variance, by).withColumn("absolute", F.try_divide(F.col("share") * F.col("_full"), "variance")).drop("variance")
    return out.withColumnRenamed("_full", "decoded_variance")


def salient_shares(loadings: DataFrame, modes: list, decoded_variance: DataFrame, data_variance: DataFrame, by: list[str], cell: list[str] = GRID) -> DataFrame:
    """Variance split by the sensitivity of the decoding to each mode, |sum of its loadings|.

    ``decoded_variance`` holds population variances summed over cells, ``data_variance`` sample ones.
    """
    sens = loadings.groupBy("mode").agg(F.abs(F.sum("w")).alias("_s"))
    sens = sens.filter(F.col("mode").isin(list(modes)))
    total = sens.agg(F.sum("_s").alias("t")).scalar()
    rows = sens.agg(F.collect_list(F.struct("mode", "_s")).alias("r")).scalar()
    groups = decoded_variance.withColumnRenamed("variance", "_dec").join(data_variance.withColumnRenamed("variance", "_dat"), by)
    out = groups.select(*by, "_dec", "_dat", F.explode(rows).alias("m"))
    share = F.try_divide(F.col("m._s"), total)
    return out.select(*by, F.col("m.mode").alias("mode"), share.alias("share"), F.try_divide(share * F.col("_dec"), "_dat").alias("absolute"))


def effective_modes(shares: DataFrame, by: list[str], rank_by: str = "share") -> DataFrame:
    """Sum of rank times share, the modes ranked by ``rank_by``, such as the variance lost next to salient shares."""
    w = Window.partitionBy(*by).orderBy(F.col(rank_by).desc(), "mode")
    return shares.withColumn("rank", F.row_number().over(w)).groupBy(*by).agg(F.sum(F.col("rank") * F.col("share")).alias("effective"))


def loading_correlations(loadings: DataFrame, modes: list, cell: list[str] = GRID) -> DataFrame:
    """Correlation over cells between the loadings of each mode pair."""
    return correlation_table(loadings, cell, modes, value="w")


# -- sign --------------------------------------------------------------------------------------


def sign_table(series: DataFrame, reference: DataFrame, by: list[str]) -> DataFrame:
    """-1 where a mode runs against the reference series, else 1."""
    z = series.join(reference.select(*by, "month_idx", F.col("value").alias("_r")), [*by, "month_idx"])
    return z.groupBy(*by, "mode").agg(F.when(pearson("value", "_r") < 0, -1.0).otherwise(1.0).alias("sign"))


def apply_signs(df: DataFrame, signs: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    return df.join(checked_side(signs), [*by, "mode"]).withColumn(value, F.col(value) * F.col("sign")).drop("sign")


# -- principal components ----------------------------------------------------------------------


def _principal(g: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Scores (k, T), variances and total variance of a centred T x T Gram matrix."""
    n = len(g)
    lam, vec = np.linalg.eigh(g)
    top = np.argsort(lam)[::-1][:k]
    lam_k = np.maximum(lam[top], 0.0)
    return _upright((vec[:, top] * np.sqrt(lam_k)).T), lam_k / (n - 1), float(np.trace(g)) / (n - 1)


def _principal_of_cells(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The same from the centred series (cells, T): products of cells have the same eigenvalues, and the rest of the ``k`` are zero."""
    n = x.shape[1]
    g = x @ x.T
    lam, vec = np.linalg.eigh(g)
    top = np.argsort(lam)[::-1][:k]
    lam_k, scores = np.zeros(min(k, n)), np.zeros((min(k, n), n))
    lam_k[: len(top)] = np.maximum(lam[top], 0.0)[: len(lam_k)]
    scores[: len(top)] = (vec[:, top].T @ x)[: len(lam_k)]
    return _upright(np.where(lam_k[:, None] > 0, scores, 0.0)), lam_k / (n - 1), float(np.trace(g)) / (n - 1)


def _upright(scores: np.ndarray) -> np.ndarray:
    """The largest score of a component is positive."""
    peak = np.take_along_axis(scores, np.abs(scores).argmax(axis=1)[:, None], axis=1)
    return scores * np.where(peak < 0, -1.0, 1.0)


@dataclass
class PrincipalComponents:
    """Scores per month, weights per cell, variance per component.

    ``weights`` has one row per cell: the ``mean`` that was removed and ``w``, the weights of all
    modes side by side. It is stored once.
    """

    by: list[str]
    cell: list[str]
    modes: list[str]
    scores: DataFrame
    weights: DataFrame
    variance: DataFrame

    @property
    def loadings(self) -> DataFrame:
        """Long form: rows ``(*by, *cell, mode, w)``."""
        rows = F.arrays_zip(F.lit(self.modes).alias("mode"), "w")
        return self.weights.select(*self.by, *self.cell, F.explode(rows).alias("r")).select(*self.by, *self.cell, "r.*")

    def transform(self, df: DataFrame, by: list[str] | None = None, whole: bool = False) -> DataFrame:
        """Series of another field on the same modes; the fitted cell means are removed.

        With ``whole``, a month that lacks the value of a fitted cell has NULL instead of a sum over the others.
        """
        by = self.by if by is None else by
        z = df.join(self.weights, [*self.by, *self.cell])
        sums = [F.sum(F.element_at("w", i + 1) * (F.col("value") - F.col("mean"))) for i in range(len(self.modes))]
        out = z.groupBy(*by, "month_idx").agg(F.array(*sums).alias("r"), F.count("value").alias("_have"))
        if whole:
            size = checked_side(self.weights.groupBy(*self.by).agg(F.count("*").alias("_cells")))
            out = out.join(size, self.by) if self.by else out.withColumn("_cells", size.select("_cells").scalar())
            none = F.array(*[F.lit(None).cast("double")] * len(self.modes))
            out = out.withColumn("r", F.when(F.col("_have") == F.col("_cells"), F.col("r")).otherwise(none))
        rows = F.array(*[F.struct(F.lit(m).alias("mode"), F.element_at("r", i + 1).alias("value")) for i, m in enumerate(self.modes)])
        return out.select(*by, "month_idx", F.explode(rows).alias("r")).select(*by, "month_idx", "r.*")

    def reconstruct(self, target: DataFrame, series: DataFrame, by: list[str] | None = None, parts: bool = False) -> DataFrame:
        """Adds ``decoded`` to the rows of ``target``: cell mean plus weights times series.

        With ``parts`` also each mode's share of it, and rows of months whose series is NULL or not there are kept, with NULL.
        """
        by = self.by if by is None else by
        z = mode_vectors(series, [*by, "month_idx"], self.modes).withColumnRenamed("vec", "_z")
        out = target.join(self.weights, [*self.by, *self.cell]).join(checked_side(z), [*by, "month_idx"], "left" if parts else "inner")
        if parts:
            out = out.withColumn("parts", F.zip_with("w", "_z", lambda a, b: a * b))
        return out.withColumn("decoded", F.col("mean") + _dot("w", "_z", len(self.modes))).drop("w", "_z", "mean")


_EIGEN = T.StructType(
    [
        T.StructField("scores", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("variance", T.ArrayType(T.DoubleType())),
        T.StructField("total", T.DoubleType()),
    ]
)


def _on_axis(packed: DataFrame, times: DataFrame, by: list[str]) -> DataFrame:
    """Series of cells that have every time of their group; the others become NULL and take no part."""
    whole = packed.join(times, by) if by else packed.withColumn("_axis", times.select("_axis").scalar())
    return whole.withColumn("vs", F.when(F.col("ts") == F.col("_axis"), F.col("vs"))).drop("_axis")


def _eigen_of_times(centred: DataFrame, by: list[str], k: int) -> DataFrame:
    """Per group ``e``, the components by products of times, which are summed over partitions."""

    @heavy
    @F.pandas_udf(_EIGEN)
    def solve(gram: pd.Series) -> pd.DataFrame:
        rows = []
        for flat in gram:
            n = int(round(np.sqrt(len(flat))))
            scores, var, total = _principal(np.asarray(flat, dtype=float).reshape(n, n)[:-1, :-1], k)
            rows.append(([list(s) for s in scores], list(var), total))
        return pd.DataFrame(rows, columns=["scores", "variance", "total"])

    return gram_matrix(centred, "vs", by).select(*by, solve("gram").alias("e"))


def _eigen_of_cells(centred: DataFrame, by: list[str], k: int) -> DataFrame:
    """The same by products of cells, of which no group has more than times; series are exchanged, and a task holds those of one group."""
    schema = T.StructType([centred.schema[c] for c in by] + list(_EIGEN))

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.vstack([np.asarray(v, dtype=float) for v in pdf["vs"]])
        scores, var, total = _principal_of_cells(x[np.isfinite(x).all(axis=1)], k)
        return pd.DataFrame({c: [v] for c, v in zip(by, key)} | {"scores": [list(scores)], "variance": [var], "total": [total]})

    out = centred.select(*by, "vs").filter(F.col("vs").isNotNull()).groupBy(*by).applyInPandas(solve, schema)
    return out.select(*by, F.struct(*_EIGEN.names).alias("e"))


def principal_components(df: DataFrame, by: list[str], cell: list[str] = GRID, k: int = 3, t: str = "month_idx") -> PrincipalComponents:
    """Principal components over time of gap-free cells.

    A cell that lacks a time of its group, or a value there, takes no part and gets no loading.

    The Gram matrix of the time steps is summed over partitions; its size is the length of the
    time axis squared and does not depend on the number of cells. A group that has no more rows than
    its matrix has values is solved from its series instead, so many small groups send no matrix each. The eigenproblem
    of a group is solved in one task, loadings follow from one more pass with map-side sums.
    """
    modes = [f"pc{i + 1}" for i in range(k)]
    axis = F.sort_array(F.collect_set(t))
    times = checked_side(df.groupBy(*by).agg(axis.alias("_axis"), (F.count(F.lit(1)) <= F.size(axis).cast("long") * F.size(axis)).alias("_few")))
    eig = None
    for few in [row["_few"] for row in times.select("_few").distinct().collect()] or [True]:
        alike = times.filter(F.col("_few") == few).drop("_few")
        packed = _on_axis(pack_series(df, [*by, *cell], t), alike, by)
        centred = packed.withColumn("vs", array_kernel(lambda x: x - x.mean(axis=1, keepdims=True))("vs"))
        part = (_eigen_of_cells if few else _eigen_of_times)(centred, by, k)
        eig = part if eig is None else eig.unionByName(part)
    times = times.select(*by, F.col("_axis").alias("ts"))
    eig = cut_lineage(eig.join(times, by) if by else eig.withColumn("ts", times.select("ts").scalar()))
    scores = (
        eig.select(*by, "ts", F.posexplode("e.scores").alias("c", "s"))
        .select(*by, "c", F.explode(F.arrays_zip(F.col("ts").alias("t"), F.col("s").alias("v"))).alias("z"))
        .select(*by, F.element_at(F.lit(modes), F.col("c") + 1).alias("mode"), F.col("z.t").alias(t), F.col("z.v").alias("value"))
    )
    variance = eig.select(*by, F.posexplode("e.variance").alias("c", "variance"), F.col("e.total").alias("total")).select(
        *by, F.element_at(F.lit(modes), F.col("c") + 1).alias("mode"), "variance", F.try_divide("variance", "total").alias("share")
    )
    # weight of a cell = sum over time of value * score / (variance * (T - 1)); scores have mean zero
    per_mode = eig.select(*by, F.posexplode("e.variance").alias("c", "_v"), F.size("ts").alias("_n"))
    per_mode = per_mode.select(*by, F.element_at(F.lit(modes), F.col("c") + 1).alias("mode"), (F.col("_v") * (F.col("_n") - 1)).alias("_scale"))
    scaled = scores.join(per_mode, [*by, "mode"]).withColumn("value", F.coalesce(F.try_divide("value", "_scale"), F.lit(0.0)))
    wide = mode_vectors(scaled, [*by, t], modes)
    z = df.join(checked_side(wide), [*by, t])
    w = F.array(*[F.sum(F.col("value") * F.element_at("vec", i + 1)) for i in range(k)])
    weights = z.groupBy(*by, *cell).agg(F.avg("value").alias("mean"), w.alias("w"), F.count("value").alias("_m"))
    length = eig.select(*by, F.size("ts").alias("_n"))
    weights = weights.join(length, by) if by else weights.withColumn("_n", length.select("_n").scalar())
    weights = checked_side(weights.filter("_m >= _n").drop("_m", "_n"))
    return PrincipalComponents(by, cell, modes, scores, weights, variance)


def fit_ensemble(df: DataFrame, fits: DataFrame, cell: list[str] = GRID, k: int = 3, n_folds: int = 5) -> DataFrame:
    """Components of many resampled fits from a single pass over the field.

    ``fits`` has ``(seed, split)``: a fit leaves out every ``n_folds``-th time (its split) and
    draws as many of the others with replacement. Each is an eigenproblem on rows and columns of
    the same Gram matrix, which is as large as the time axis squared, at most `MOST_TIMES`. Rows: ``(seed, split, mode, variance, share)``.
    """
    axis = checked_side(df.agg(F.sort_array(F.collect_set("month_idx")).alias("_axis")))
    length = axis.select(F.size("_axis")).first()[0]
    if length > MOST_TIMES:
        raise ValueError(f"{length} times are too many for a matrix of their pairs; see long_components")
    gram = cut_lineage(gram_matrix(_on_axis(pack_series(df, cell), axis, []), "vs").select("gram"))

    def fit(parts: pd.DataFrame, matrix: pd.DataFrame) -> pd.DataFrame:
        out = []
        flat = np.asarray(matrix["gram"].iloc[0] if len(matrix) and len(parts) else [0.0], dtype=float)
        n = int(round(np.sqrt(len(flat))))
        whole = flat.reshape(n, n)[:-1, :-1]
        for seed, split in zip(parts["seed"], parts["split"]) if len(whole) else ():
            train = np.flatnonzero(np.arange(len(whole)) % n_folds != split)
            picked = train[draw_positions(1, len(train), len(train), int(seed) * 104729 + int(split))[0]]
            g = whole[np.ix_(picked, picked)]
            g = g - g.mean(axis=0, keepdims=True)
            g = g - g.mean(axis=1, keepdims=True)
            _, var, total = _principal(g, k)
            out += [(seed, split, f"pc{i + 1}", v, v / total) for i, v in enumerate(var)]
        return pd.DataFrame(out, columns=["seed", "split", "mode", "variance", "share"])

    # few small rows but much work each: they are dealt to as many parts as there are shuffle partitions, and the matrix goes to each part once
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = fits.select("seed", "split", F.pmod(F.xxhash64("seed", "split"), F.lit(n)).alias("part"))
    spread = gram.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return dealt.groupBy("part").cogroup(spread.groupBy("part")).applyInPandas(fit, "seed int, split int, mode string, variance double, share double")


def separated_modes(df: DataFrame, bands: dict[str, Callable[[DataFrame], DataFrame]], by: list[str], cell: list[str] = GRID, k: int = 1) -> PrincipalComponents:
    """Modes of separate time scales: each band's filter runs per cell, then components per band."""
    parts = None
    for name, run in bands.items():
        part = run(df).withColumn("band", F.lit(name))
        parts = part if parts is None else parts.unionByName(part)
    return principal_components(parts, [*by, "band"], cell, k)


# -- recursion and batch scoring ---------------------------------------------------------------


def recurse(field: DataFrame, fit: Callable[[DataFrame], tuple[DataFrame, list]], by: list[str], steps: int = 3, cell: list[str] = GRID) -> DataFrame:
    """Encodings of ``steps`` recursions, each fitted on what the earlier ones left over.

    ``fit`` returns loadings and mode names. The residual of a step is checkpointed, so the
    plan does not grow and a lost executor costs one step at most.
    """
    rows, residual = None, field
    for step in range(steps):
        loadings, modes = fit(residual)
        loadings = cut_lineage(loadings)
        series = cut_lineage(encode(residual, loadings, modes, by, cell))
        part = series.withColumn("recursion", F.lit(step))
        rows = part if rows is None else rows.unionByName(part)
        if step + 1 < steps:
            residual = cut_lineage(remove_modes(residual, series, loadings, modes, by, cell))
    return rows


ACTIVATIONS = {"tanh": np.tanh, "sigmoid": lambda x: 1 / (1 + np.exp(-x)), "identity": lambda x: x}


def score_mlp(df: DataFrame, vector: str, layers: list[tuple[np.ndarray, np.ndarray]], activation: str = "tanh", out: str = "encoded") -> DataFrame:
    """Batch scoring of a given dense network; the last layer is linear."""
    act = ACTIVATIONS[activation]

    def forward(x: np.ndarray) -> np.ndarray:
        for i, (w, b) in enumerate(layers):
            x = x @ w.T + b
            if i + 1 < len(layers):
                x = act(x)
        return x

    return df.withColumn(out, array_kernel(forward)(vector))
