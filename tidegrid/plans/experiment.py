"""Cross-validated recursive decomposition: every split, period and member in one job.

Loops over initializations, splits and members are key columns. Only the recursions follow one another, and
each hands its residual on through a stored table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions.calendar import month_of
from tidegrid.functions.sizing import calendar_side, checked_side
from tidegrid.operators.anomaly import anomalies, area_mean, box_mean, global_detrend
from tidegrid.operators.modes import apply_signs, principal_components, sign_table
from tidegrid.operators.select import box as coordinate_box
from tidegrid.operators.spectrum import order_by_period, power_spectrum, spectral_summary
from tidegrid.schema import mode_labels
from tidegrid.session import cut_lineage
from tidegrid.sources import commits
from tidegrid.sources.layout import buckets_for, store_by_cell


def _split_trends(months: DataFrame, n_folds: int, deg: int) -> tuple[float, float, np.ndarray]:
    """Polynomial of the area mean per split: centre and half width of the training axis, and coefficients, one row a split.

    ``months`` has one row per month: ``value`` and ``fold``. Power sums are taken per fold, a few numbers each; a split is the total
    minus its own fold. Coefficients are NaN where a split has too few months.
    """
    every = Window.partitionBy(F.lit(0))  # one row per month of the calendar
    known = months.filter(F.col("fold").isNotNull()).withColumns(
        {
            "centre": (F.max("month_idx").over(every) + F.min("month_idx").over(every)) / 2,
            "half": F.greatest(F.lit(1.0), (F.max("month_idx").over(every) - F.min("month_idx").over(every)) / 2),
            "mean": F.avg("value").over(every),
        }
    )
    u, has = (F.col("month_idx") - F.col("centre")) / F.col("half"), F.col("value").isNotNull()
    powers = [F.sum(F.when(has, F.pow(u, F.lit(i)))) for i in range(2 * deg + 1)]
    mixed = [F.sum(F.pow(u, F.lit(i)) * (F.col("value") - F.col("mean"))) for i in range(deg + 1)]
    sums = known.groupBy("fold", "centre", "half", "mean").agg(F.array(*powers).alias("s"), F.array(*mixed).alias("t")).collect()
    s, t = np.zeros((n_folds, 2 * deg + 1)), np.zeros((n_folds, deg + 1))
    for row in sums:
        s[row.fold], t[row.fold] = [x or 0.0 for x in row.s], [x or 0.0 for x in row.t]
    s, t = s.sum(axis=0) - s, t.sum(axis=0) - t
    coefs = np.full((n_folds, deg + 1), np.nan)
    for split in range(n_folds):
        normal = s[split][np.add.outer(np.arange(deg + 1), np.arange(deg + 1))]
        if np.linalg.matrix_rank(normal) > deg:
            coefs[split] = np.linalg.solve(normal, t[split])
            coefs[split, 0] += sums[0].mean
    return (float(sums[0].centre), float(sums[0].half), coefs) if sums else (0.0, 1.0, coefs)


def split_anomalies(field: DataFrame, test_from: int, cell: list[str], n_folds: int = 5, deg: int = 2) -> DataFrame:
    """Anomalies of every split side by side: ``(*cell, month_idx, fold, values)``, ``values`` by split; ``fold`` is NULL from ``test_from`` on.

    ``field`` is unique per cell and month (see :func:`tidegrid.operators.anomaly.monthly`). A sample that leaves a fold out is the total
    minus that fold: counts, values and powers of time are summed per cell, calendar month and fold in one window, and each
    split's climatology is put together from them. The field is never copied, and exchanged at most once; stored by cell (see
    :mod:`tidegrid.sources.layout`), not at all.
    """
    mean = area_mean(field, ["month_idx"])
    order = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("month_idx")) - 1  # one row per month of the calendar
    axis = mean.filter(F.col("month_idx") < test_from).select("month_idx", "value", (order % n_folds).cast("int").alias("fold"))
    months = calendar_side(axis.unionByName(mean.filter(F.col("month_idx") >= test_from).withColumn("fold", F.lit(None).cast("int"))))
    centre, half, coefs = _split_trends(months, n_folds, deg)
    rows = field.select(*cell, "month_idx", "value").join(months.select("month_idx", "fold"), "month_idx")
    rows = rows.withColumn("_u", (F.col("month_idx") - centre) / half)
    same = Window.partitionBy(*cell, month_of(F.col("month_idx")))
    has = F.col("value").isNotNull()
    terms = {"v": F.col("value")} | {f"u{i}": F.when(has, F.pow("_u", F.lit(i))) for i in range(deg + 1)}
    sums = {f"_{n}{f}": F.coalesce(F.sum(F.when(F.col("fold") == f, x)).over(same), F.lit(0.0)) for n, x in terms.items() for f in range(n_folds)}
    rows = rows.withColumns(sums)
    total = {n: sum((F.col(f"_{n}{f}") for f in range(1, n_folds)), F.col(f"_{n}0")) for n in terms}

    def anomaly(split: int) -> Column:
        left = {n: total[n] - F.col(f"_{n}{split}") for n in terms}
        b = [F.lit(None).cast("double") if np.isnan(x) else F.lit(float(x)) for x in coefs[split]]
        # what is left of the sample after its trend, over its count; counts are sums of ones, so a sample without rows is exactly 0
        clim = F.try_divide(left["v"] - sum((b[i] * left[f"u{i}"] for i in range(1, deg + 1)), b[0] * left["u0"]), left["u0"])
        trend = sum((b[i] * F.pow("_u", F.lit(i)) for i in range(1, deg + 1)), b[0])
        return F.col("value") - trend - clim

    return rows.select(*cell, "month_idx", "fold", F.array(*[anomaly(s) for s in range(n_folds)]).alias("values"))


def fold_anomalies(field: DataFrame, test_from: int, cell: list[str], n_folds: int = 5, deg: int = 2) -> DataFrame:
    """Anomalies of training, held-out fold and test period of each split.

    Trend and climatology come from the training months of the split alone; rows carry
    ``(split, kind)`` with kind train, val or test.
    """
    rows = split_anomalies(field, test_from, cell, n_folds, deg).select(*cell, "month_idx", "fold", F.posexplode("values").alias("split", "value"))
    kind = F.when(F.col("fold").isNull(), "test").when(F.col("split") == F.col("fold"), "val").otherwise("train")
    return rows.select("split", kind.alias("kind"), *cell, "month_idx", "value")


def resampled_months(months: DataFrame, fits: DataFrame, n_folds: int = 5) -> DataFrame:
    """Training sample of each fit ``(initialization, split)``: rows ``(initialization, split, pos, month_idx)``.

    ``months`` has ``(month_idx, fold)``. Initialization 0 has every training month once; any other draws as many with
    replacement, by a fixed hash of the fit and the position, so a lost executor changes nothing.
    """
    order = Window.partitionBy("split").orderBy("month_idx")
    sample = months.filter("fold is not null").select("month_idx", "fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))).alias("split")).filter("split <> fold")
    sample = sample.select("split", "month_idx", (F.row_number().over(order) - 1).alias("rank"))
    lengths = sample.groupBy("split").agg(F.count("*").cast("int").alias("_n"))
    places = fits.join(lengths, "split").withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    drawn = F.pmod(F.xxhash64("initialization", "split", "pos"), F.col("_n")).cast("int")
    places = places.withColumn("rank", F.when(F.col("initialization") == 0, F.col("pos")).otherwise(drawn))
    return places.join(sample, ["split", "rank"]).select("initialization", "split", "pos", "month_idx")


def member_anomalies(members: DataFrame, cell: list[str], deg: int = 2) -> DataFrame:
    """Each member without the trend of its own area mean and its own climatology."""
    keys = ["member", *cell]
    return anomalies(global_detrend(members, ["member"], deg), keys).select(*keys, "month_idx", "value")


@dataclass
class Fits:
    """What an experiment puts out, per fit ``(initialization, split)`` and recursion.

    ``encodings`` are rows ``(kind, member, mode, month_idx, value)``; ``decodings`` are rows ``(kind, member, without, *cell, month_idx,
    value)`` of the data and of their decodings with all modes (``without`` NULL) and, for the held-out fold, without each.
    """

    encodings: DataFrame
    decodings: DataFrame


FIT = ["initialization", "split"]


def decodings_schema(field: DataFrame, cell: list[str]) -> T.StructType:
    """Layout of the decodings of a field, for a table that may have no fit yet."""
    head = "initialization int, split int, recursion int, kind string, member int, without string"
    return T.StructType([*T._parse_datatype_string(head).fields, *[field.schema[c] for c in cell], *T._parse_datatype_string("month_idx int, value double").fields])


def run_fits(
    field: DataFrame,
    test_from: int,
    cell: list[str],
    nodes: DataFrame,
    sign_box: dict[str, tuple[float, float]],
    fits: DataFrame,
    members: DataFrame | None = None,
    n_folds: int = 5,
    steps: int = 3,
    k: int = 5,
    smooth: int = 7,
) -> Fits:
    """The whole experiment for the fits of a table ``(initialization, split)``.

    Each recursion fits components per fit on what is left of its training sample, orders them by spectral peak (longest first), gives them the
    sign of their correlation with the decoded mean of a box, encodes and decodes all periods and members, and subtracts the decoding.
    Members are fields of other datasets: kind member, with their number; they don't enter a fit. A month that lacks a cell of the
    fit has NULL. ``field`` has gap-free cells, ``nodes`` their coordinates. Where ``member`` is itself a key of the cells, no members can be
    given, and decodings have the cell's.
    """
    keys = [*FIT, "kind", "_member"]
    split = cut_lineage(split_anomalies(field, test_from, cell, n_folds))
    months = checked_side(split.select("month_idx", "fold").distinct())
    draws = checked_side(resampled_months(months, fits, n_folds))
    kind = F.when(F.col("fold").isNull(), "test").when(F.col("split") == F.col("fold"), "val").otherwise("train")
    wanted = checked_side(fits.select(*FIT).distinct())
    by_split = split.select(*cell, "month_idx", "fold", F.posexplode("values").alias("split", "value"))
    rows_of_a_fit = split.count()
    data = by_split.join(wanted, "split").select(*FIT, kind.alias("kind"), F.lit(-1).alias("_member"), *cell, "month_idx", "value")
    if members is not None:
        others = cut_lineage(member_anomalies(members, cell))
        rows_of_a_fit += others.count()
        others = others.withColumn("_fits", wanted.agg(F.collect_list(F.struct(*FIT)).alias("f")).scalar())
        others = others.select("*", F.explode("_fits").alias("_f")).select("_f.*", F.lit("member").alias("kind"), F.col("member").alias("_member"), *cell, "month_idx", "value")
        data = data.unionByName(others)
    buckets = buckets_for(field.sparkSession, rows_of_a_fit * wanted.count())
    data = store_by_cell(data, [*FIT, *cell], buckets=buckets)
    labels = mode_labels(k)
    in_box = checked_side(coordinate_box(nodes, **sign_box))
    encodings = decodings = None
    for step in range(steps):
        sample = data.filter(F.col("kind") == "train").join(draws, [*FIT, "month_idx"])
        pcs = principal_components(sample, FIT, cell, k, t="pos")
        series = cut_lineage(pcs.transform(data, keys, whole=True))
        learned = series.filter(F.col("kind").isin("train", "val")).select(*FIT, "mode", "month_idx", "value")
        peaks = spectral_summary(power_spectrum(learned, [*FIT, "mode"], smooth=smooth), [*FIT, "mode"])
        order = checked_side(order_by_period(peaks, FIT, labels).select(*FIT, "mode", "label"))
        decoded = store_by_cell(pcs.reconstruct(data, series, keys, parts=True), [*FIT, *cell], buckets=buckets)
        inside = decoded.filter(F.col("kind").isin("train", "val")).join(in_box, [c for c in cell if c in nodes.columns])
        reference = box_mean(inside.withColumn("value", F.col("decoded")), [*FIT, "month_idx"])
        signed = apply_signs(series, sign_table(learned, reference, FIT), FIT)
        stamp = [F.lit(step).alias("recursion"), "kind", F.when(F.col("_member") >= 0, F.col("_member")).alias("member")]
        part = signed.join(order, [*FIT, "mode"]).select(*FIT, *stamp, F.col("label").alias("mode"), "month_idx", "value")
        encodings = part if encodings is None else encodings.unionByName(part)
        # a mode set to zero takes its own part away
        names = order.groupBy(*FIT).agg(F.map_from_entries(F.collect_list(F.struct("mode", "label"))).alias("_label"))
        ablated = F.arrays_zip(F.lit(pcs.modes).alias("m"), F.transform("parts", lambda x: F.col("decoded") - x).alias("v"))
        full = F.array(F.struct(F.lit(None).cast("string").alias("m"), F.col("decoded").alias("v")))
        rows = F.when(F.col("kind") == "val", F.concat(full, ablated)).otherwise(full)
        long = decoded.withColumn("_r", F.explode(rows)).join(names, FIT)
        part = long.select(*FIT, *[c for c in stamp if "member" not in cell or c is not stamp[-1]], F.try_element_at("_label", F.col("_r.m")).alias("without"), *cell, "month_idx", F.col("_r.v").alias("value"))
        decodings = part if decodings is None else decodings.unionByName(part)
        data = decoded.withColumn("value", F.col("value") - F.col("decoded")).drop("decoded", "parts")
    return Fits(encodings, decodings)


def run_experiment(field: DataFrame, test_from: int, cell: list[str], nodes: DataFrame, sign_box: dict[str, tuple[float, float]], n_folds: int = 5, steps: int = 3, k: int = 5, smooth: int = 7) -> DataFrame:
    """Encodings ``(split, recursion, kind, mode, month_idx, value)`` of one fit per split (see :func:`run_fits`)."""
    fits = field.sparkSession.range(n_folds).select(F.lit(0).alias("initialization"), F.col("id").cast("int").alias("split"))
    out = run_fits(field, test_from, cell, nodes, sign_box, fits, None, n_folds, steps, k, smooth).encodings
    return out.select("split", "recursion", "kind", "mode", "month_idx", "value")


def write_experiment(work: DataFrame, run: Callable[[DataFrame], Fits], path: str, at_once: int = 5) -> int:
    """Run the fits ``(initialization, split)`` that are not committed yet and write their outputs; returns how many there were.

    Encodings and decodings are tables of keys ``initialization=/split=/`` below ``path``. A fit counts as done when its encodings are,
    which are committed last.
    """
    todo = commits.missing_keys(work.select(*FIT).distinct(), f"{path}/encodings", FIT).orderBy(*FIT).collect()
    spark = work.sparkSession
    for i in range(0, len(todo), at_once):
        out = run(spark.createDataFrame(todo[i : i + at_once], "initialization int, split int"))
        commits.write_keys(out.decodings, f"{path}/decodings", FIT)
        commits.write_keys(out.encodings, f"{path}/encodings", FIT)
    return len(todo)
