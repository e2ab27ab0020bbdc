"""Gram matrices of vectors, without pairing rows.

Every partition multiplies its own block, so one pass over the data yields all pairwise
products. What is exchanged is one matrix per partition and group, cut into rows that are summed
in parallel; no task holds more than one matrix of a group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.operators.series_kernels import heavy


#: Sums that a task holds at most, unless those of one group are larger.
FLUSH_BYTES = 64 * 1024 * 1024


def gram_matrix(df: DataFrame, vector: str, by: list[str] | None = None) -> DataFrame:
    """Per group: ``size`` and ``gram``, the flattened products of the vectors extended by a constant 1.

    The last row and column therefore hold the sums and the number of vectors. All vectors of
    a group have the same length; incomplete ones are skipped.
    """
    by = by or []
    schema = T.StructType(
        [df.schema[k] for k in by] + [T.StructField("i", T.IntegerType()), T.StructField("row", T.ArrayType(T.DoubleType()))]
    )

    def partial(batches):
        total: dict[tuple, np.ndarray] = {}
        held = 0
        for pdf in batches:
            groups = pdf.groupby(by, sort=False, dropna=False) if by else [((), pdf)]
            for key, part in groups:
                rows = [np.append(np.asarray(v, dtype=float), 1.0) for v in part[vector] if v is not None]
                if not rows:
                    continue
                block = np.vstack(rows)
                block = block[np.isfinite(block).all(axis=1)]
                key = key if isinstance(key, tuple) else (key,)
                g = block.T @ block
                if key in total:
                    total[key] += g
                else:
                    total[key], held = g, held + g.nbytes
                if held > FLUSH_BYTES:
                    # many groups, often in one batch: hand the sums on early instead of holding them all
                    yield from (frame(key, np.arange(len(g)), list(g)) for key, g in total.items())
                    total, held = {}, 0
        yield from (frame(key, np.arange(len(g)), list(g)) for key, g in total.items())

    def frame(key: tuple, i, rows: list) -> pd.DataFrame:
        out = pd.DataFrame({"i": np.asarray(i, dtype=np.int32), "row": rows})
        for name, k in zip(by, key):
            out[name] = k
        return out[[*by, "i", "row"]]

    def merge(batches):
        # rows come sorted: a sum is complete when the key changes, and a batch of them is handed on
        last, total, done = None, None, []
        for pdf in batches:
            for *key, row in zip(*[pdf[k].astype(object).where(pdf[k].notna(), None) for k in by], pdf["i"], pdf["row"]):
                at, row = tuple(key), np.asarray(row, dtype=float)
                if at == last:
                    total = total + row
                    continue
                if last is not None:
                    done.append((last, total))
                last, total = at, row
            if sum(row.nbytes for _, row in done) > FLUSH_BYTES // 4:
                yield table(done)
                done = []
        if last is not None:
            yield table([*done, (last, total)])

    def table(done: list) -> pd.DataFrame:
        keys = list(zip(*[at for at, _ in done]))
        out = {name: pd.Series(list(k), dtype=object) for name, k in zip(by, keys)}
        return pd.DataFrame(out | {"i": np.asarray(keys[-1], dtype=np.int32), "row": [row for _, row in done]})

    parts = df.select(*by, vector).mapInPandas(partial, schema)
    rows = parts.repartition(*by, "i").sortWithinPartitions(*by, "i").mapInPandas(merge, schema)
    whole = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("i", F.col("row").alias("g")))).alias("m"))
    return whole.filter(F.size("m") > 0).select(*by, (F.size("m") - 1).alias("size"), F.flatten(F.col("m.g")).alias("gram"))


@heavy
@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _correlation(gram: pd.Series) -> pd.Series:
    out = []
    for flat in gram:
        k = int(round(np.sqrt(len(flat))))
        g = np.asarray(flat, dtype=float).reshape(k, k)
        n, s = g[-1, -1], g[:-1, -1]
        cov = g[:-1, :-1] - np.outer(s, s) / n
        sd = np.sqrt(np.diag(cov))
        with np.errstate(invalid="ignore", divide="ignore"):
            out.append((cov / np.outer(sd, sd)).ravel())
    return pd.Series(out)


@heavy
@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _covariance(gram: pd.Series) -> pd.Series:
    out = []
    for flat in gram:
        k = int(round(np.sqrt(len(flat))))
        g = np.asarray(flat, dtype=float).reshape(k, k)
        n, s = g[-1, -1], g[:-1, -1]
        out.append(((g[:-1, :-1] - np.outer(s, s) / n) / (n - 1)).ravel())
    return pd.Series(out)


def _long(df: DataFrame, by: list[str], flat: Column, name: str) -> DataFrame:
    cells = df.select(*by, "size", F.posexplode(flat).alias("p", name))
    return cells.select(
        *by, F.floor(F.col("p") / F.col("size")).cast("int").alias("i"), (F.col("p") % F.col("size")).cast("int").alias("j"), name
    )


def correlations(df: DataFrame, vector: str, by: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair of vector positions: rows ``(*by, i, j, r)``."""
    return _long(gram_matrix(df, vector, by), by or [], _correlation("gram"), "r")


def covariances(df: DataFrame, vector: str, by: list[str] | None = None) -> DataFrame:
    """Sample covariance (ddof 1) of every pair of vector positions."""
    return _long(gram_matrix(df, vector, by), by or [], _covariance("gram"), "cov")


def mode_vectors(df: DataFrame, keys: list[str], modes: list[str], value: str = "value", mode: str = "mode", complete: bool = True) -> DataFrame:
    """One row per key with the values of the listed modes as an array; keys that lack one are dropped unless ``complete`` is false."""
    cols = [F.max(F.when(F.col(mode) == m, F.col(value))) for m in modes]
    out = df.filter(F.col(mode).isin(list(modes))).groupBy(*keys).agg(F.array(*cols).alias("vec"))
    return out.filter(~F.exists("vec", lambda v: v.isNull())) if complete else out


def correlation_table(df: DataFrame, keys: list[str], modes: list[str], by: list[str] | None = None, value: str = "value") -> DataFrame:
    """Correlation matrix of labelled series: rows ``(*by, mode_a, mode_b, r)``."""
    by = by or []
    out = correlations(mode_vectors(df, [*by, *keys], modes, value), "vec", by)
    names = F.lit(list(modes))
    return out.select(*by, names[F.col("i")].alias("mode_a"), names[F.col("j")].alias("mode_b"), "r")
