"""Principal components of a long time axis, without a matrix of all pairs of times.

The field is cut into tiles: a block of times by a chunk of cells. A random block of series is multiplied with the tiles, back and
forth, and the products span a growing basis over the cells (block Lanczos with full orthogonalization). Orthogonalization needs the triangular
factor of a tall matrix only, which comes from a tree of small QR factorizations; no row holds more than a block of times for all basis
vectors, and what the driver sees is as large as the basis squared. Steps end when the singular values stand still, or when
the basis spans the field, where the result is that of a full decomposition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions.sizing import checked_side
from tidegrid.operators.modes import PrincipalComponents
from tidegrid.session import cut_lineage
from tidegrid.sources.layout import store_by_cell

#: Times of a block and cells of a chunk: a tile is 16 MB.
BLOCK, CHUNK = 4096, 512

#: Triangular factors that one task of the tree takes together.
FAN = 16

#: Steps end when no wanted singular value has changed by more, relative to the first one.
TOLERANCE = 1e-13

_LIST = T.ArrayType(T.DoubleType())


def _matrix(column: pa.ChunkedArray | pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column as one matrix, or all of its values in rows of ``width``."""
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(rows.flatten(), np.float64).reshape(-1, width) if width else np.asarray(rows.flatten(), np.float64).reshape(len(rows), -1)


def _lists(values: np.ndarray) -> pa.Array:
    """One list per row of a matrix."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel()))


def tall_factor(df: DataFrame, column: str, width: int) -> np.ndarray:
    """Triangular factor of the matrix whose rows of ``width`` are in a list column; one factorization per partition, then a tree."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.empty((0, width))
        for b in batches:
            rows = _matrix(b.column(0), width)
            for i in range(0, len(rows), 1 << 16):
                r = np.linalg.qr(np.vstack([r, rows[i : i + (1 << 16)]]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), _lists(r.reshape(1, -1))], ["part", "r"])

    def merge(rows: pa.Table) -> pa.Table:
        r = np.linalg.qr(_matrix(rows.column("r"), width), mode="r")
        return pa.Table.from_arrays([pa.array([rows.column("at")[0].as_py()], pa.int64()), _lists(r.reshape(1, -1))], ["part", "r"])

    parts = cut_lineage(df.select(column).mapInArrow(partial, "part long, r array<double>"))
    while parts.count() > FAN:
        parts = cut_lineage(parts.withColumn("at", F.floor(F.col("part") / FAN)).groupBy("at").applyInArrow(merge, "part long, r array<double>"))
    found = [np.asarray(row.r).reshape(-1, width) for row in parts.orderBy("part").collect()]
    return np.linalg.qr(np.vstack(found), mode="r") if found else np.zeros((0, width))


def _times_tiles(tiles: DataFrame, blocks: DataFrame, cell: list[str], chunks: int, width: int) -> DataFrame:
    """Field times series: per cell the products with ``width`` series, which are given by block (``z``, times by series)."""

    def run(tile: pa.Table, block: pa.Table) -> pa.Table:
        keys = tile.select(cell)
        if not tile.num_rows or not block.num_rows:
            return keys.slice(0, 0).append_column("y", pa.array([], pa.list_(pa.float64())))
        return keys.append_column("y", _lists(_matrix(tile.column("vs")) @ _matrix(block.column("z"), width)))

    schema = T.StructType([*[tiles.schema[c] for c in cell], T.StructField("y", _LIST)])
    spread = blocks.select("block", "z", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"))
    parts = tiles.groupBy("block", "chunk").cogroup(spread.groupBy("block", "chunk")).applyInArrow(run, schema)
    return parts.groupBy(*cell).agg(F.array(*[F.sum(F.element_at("y", i + 1)) for i in range(width)]).alias("y"))


def _tiles_times(tiles: DataFrame, vectors: DataFrame, cell: list[str], width: int) -> DataFrame:
    """Transposed field times ``width`` vectors over the cells (``y``): rows ``(block, z)``, summed over the chunks one after another."""

    def run(tile: pa.Table, part: pa.Table) -> pa.Table:
        if not tile.num_rows or not part.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), "z": pa.array([], pa.list_(pa.float64()))})
        order = [(c, "ascending") for c in cell]
        z = _matrix(tile.sort_by(order).column("vs")).T @ _matrix(part.sort_by(order).column("y"))
        return pa.table({"block": tile.column("block").slice(0, 1), "z": _lists(z.reshape(1, -1))})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, None
        for b in batches:
            for block, z in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                values = z.values.to_numpy()
                if block == last:
                    total = total + values
                    continue
                if last is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), _lists(total.reshape(1, -1))], ["block", "z"])
                last, total = block, values
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), _lists(total.reshape(1, -1))], ["block", "z"])

    axis = tiles.agg(F.collect_set("block").alias("b")).scalar()
    spread = vectors.select(*cell, "y", "chunk", F.explode(axis).alias("block"))
    parts = tiles.groupBy("block", "chunk").cogroup(spread.groupBy("block", "chunk")).applyInArrow(run, "block long, z array<double>")
    return parts.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block long, z array<double>")


def _mapped(df: DataFrame, column: str, matrix: np.ndarray, name: str, width: int) -> DataFrame:
    """Rows of ``width`` in a list column, times a matrix."""

    @F.pandas_udf(_LIST)
    def run(values):
        import pandas as pd

        return pd.Series([(np.asarray(v).reshape(-1, width) @ matrix).ravel() for v in values], dtype=object)

    return df.withColumn(name, run.asNondeterministic()(column))


def _orthogonal(basis: DataFrame | None, new: DataFrame, cell: list[str], have: int, width: int) -> tuple[DataFrame | None, int]:
    """New directions of ``new`` outside of an orthonormal basis, orthonormal themselves: cell, ``y``; and their number.

    It is done twice, since the first pass leaves rounding errors where little is new.
    """
    scale = None
    for _ in range(2):
        both = new if basis is None else basis.join(new, cell).withColumn("_q", F.concat("q", "y"))
        r = tall_factor(both, "y" if basis is None else "_q", have + width)
        if len(r) < have + width:
            r = np.vstack([r, np.zeros((have + width - len(r), have + width))])
        inside = np.sign(np.diag(r)[:have])[:, None] * r[:have, have:]
        _, s, vt = np.linalg.svd(r[have:, have:])
        scale = np.abs(r[:, have:]).max() if scale is None else scale
        keep = s > 1e-11 * max(scale, 1e-300)
        if not keep.any():
            return None, 0
        turn = vt[keep].T / s[keep]
        matrix = turn if basis is None else np.vstack([-inside @ turn, turn])
        out = _mapped(both, "y" if basis is None else "_q", matrix, "_y", have + width)
        new, width, scale = cut_lineage(out.select(*cell, F.col("_y").alias("y"), *(["chunk"] if "chunk" in out.columns else []))), int(keep.sum()), 1.0
    return new, width


def long_axis_components(df: DataFrame, cell: list[str], k: int = 3, t: str = "month_idx", block: int = BLOCK, width: int | None = None, steps: int = 40, seed: int = 1) -> PrincipalComponents:
    """Principal components over time of gap-free cells, for axes too long to be squared.

    ``df`` is unique per cell and time, and times are integers. Cells that lack a time that any cell has, or a value there, take no part. Scores, weights and variances are as
    those of :func:`tidegrid.operators.modes.principal_components`; with fewer independent cells than ``k`` the rest are zero. ``width`` series are multiplied at once.
    """
    spark = df.sparkSession
    width = width or max(2 * k + 10, 24)
    rows = df.select(*cell, F.col(t).cast("long").alias("_t"), F.col("value").cast("double").alias("value")).withColumn("block", F.floor(F.col("_t") / block))
    axis = checked_side(rows.groupBy("block").agg(F.sort_array(F.collect_set("_t")).alias("ts")))
    length = axis.agg(F.coalesce(F.sum(F.size("ts")), F.lit(0))).first()[0]
    series = F.sort_array(F.collect_list(F.struct(F.col("_t").alias("t"), F.col("value").alias("v"))))
    packed = rows.filter("value is not null and not isnan(value)").groupBy(*cell, "block").agg(series.alias("_s"), F.sum("value").alias("_sum"))
    whole = Window.partitionBy(*cell)  # one row per block
    packed = packed.withColumns({"_n": F.sum(F.size("_s")).over(whole), "mean": F.sum("_sum").over(whole) / length if length else F.lit(0.0)}).filter(F.col("_n") == length)
    centred = cut_lineage(packed.select(*cell, "block", "mean", F.transform("_s.v", lambda x: x - F.col("mean")).alias("vs")))
    cells = centred.select(*cell, "mean").distinct()
    n_cells = cells.count()
    chunks = max(1, -(-n_cells // CHUNK))
    number = F.pmod(F.xxhash64(*cell), F.lit(chunks))
    tiles = store_by_cell(centred.withColumn("chunk", number), ["block", "chunk"], t="block")
    total = centred.agg(F.coalesce(F.sum(F.aggregate("vs", F.lit(0.0), lambda a, x: a + x * x)), F.lit(0.0))).first()[0]

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                z = np.random.Generator(np.random.Philox(key=[seed, at % (1 << 63)])).normal(size=(size, width))
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), _lists(z.reshape(1, -1))], ["block", "z"])

    z = axis.select("block", F.size("ts")).mapInArrow(start, "block long, z array<double>")
    basis, products, have, new = None, None, 0, width
    values = np.zeros(k)
    mix = np.zeros((0, k))
    for _ in range(steps):
        if not n_cells:
            break
        y = cut_lineage(_times_tiles(tiles, z, cell, chunks, new).withColumn("chunk", number))
        y, new = _orthogonal(basis, y if basis is None else y.drop("chunk"), cell, have, new)
        if y is None:
            break
        y = y if "chunk" in y.columns else y.withColumn("chunk", number)
        z = cut_lineage(_tiles_times(tiles, y, cell, new))
        if basis is None:
            basis, products = y.select(*cell, F.col("y").alias("q")), z.withColumnRenamed("z", "w")
        else:
            basis = cut_lineage(basis.join(y, cell).select(*cell, F.concat("q", "y").alias("q")))
            products = cut_lineage(_beside(products.join(z, "block"), have, new))
        have += new
        _, s, vt = np.linalg.svd(tall_factor(products, "w", have), full_matrices=False)
        found = np.zeros(k)
        found[: min(k, len(s))] = s[:k]
        mix = np.zeros((have, k))
        mix[:, : min(k, len(s))] = vt[:k].T
        still, values = np.abs(found - values).max() <= TOLERANCE * max(found[0], 1e-300), found
        if still or have >= n_cells:
            break
    return _as_components(spark, cells, axis, basis, products, mix, values, cell, t, have, float(total), int(length))


def _beside(df: DataFrame, have: int, new: int) -> DataFrame:
    """Columns of two blocks of series next to each other."""

    @F.pandas_udf(_LIST)
    def run(w, z):
        import pandas as pd

        return pd.Series([np.hstack([np.asarray(a).reshape(-1, have), np.asarray(b).reshape(-1, new)]).ravel() for a, b in zip(w, z, strict=True)], dtype=object)

    return df.select("block", run.asNondeterministic()("w", "z").alias("w"))


def _as_components(spark, cells: DataFrame, axis: DataFrame, basis, products, mix: np.ndarray, values: np.ndarray, cell: list[str], t: str, have: int, total: float, length: int) -> PrincipalComponents:
    """Scores, weights and variances from the basis, the products and the small decomposition; the largest score is positive."""
    k = len(values)
    modes = [f"pc{i + 1}" for i in range(k)]
    nothing = T.StructType([*[cells.schema[c] for c in cell], T.StructField("mean", T.DoubleType()), T.StructField("w", _LIST)])
    if basis is None:
        scores = spark.createDataFrame([], f"mode string, {t} long, value double")
        return PrincipalComponents([], cell, modes, scores, spark.createDataFrame([], nothing), spark.createDataFrame([], "mode string, variance double, share double"))
    wide = _mapped(products, "w", mix, "s", have).select("block", "s")
    long = axis.join(wide, "block").select(F.posexplode("ts").alias("at", t), "s").select(t, F.slice("s", F.col("at") * k + 1, k).alias("s"))
    long = cut_lineage(long)
    peaks = long.agg(*[F.max_by(F.element_at("s", i + 1), F.abs(F.element_at("s", i + 1))).alias(f"p{i}") for i in range(k)]).first()
    sign = [-1.0 if (p or 0.0) < 0 else 1.0 for p in peaks]
    pairs = F.array(*[F.struct(F.lit(m).alias("mode"), (F.element_at("s", i + 1) * sign[i]).alias("value")) for i, m in enumerate(modes)])
    scores = long.select(t, F.explode(pairs).alias("r")).select("r.mode", t, "r.value")
    weights = _mapped(basis, "q", mix * sign, "w", have).select(*cell, "w")
    weights = checked_side(cells.join(weights, cell).select(*cell, "mean", "w"))
    kept = [(m, float(s * s / (length - 1)), float(s * s / total) if total else None) for m, s in zip(modes, values, strict=True)] if length > 1 else []
    return PrincipalComponents([], cell, modes, scores, weights, spark.createDataFrame(kept, "mode string, variance double, share double"))
