"""Month selectors, composites and their bootstrap significance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions.kernels import DRAW_PRIME, DRAW_STEP, ITEM_STEP, MIX_A, MIX_B, draw_counts
from tidegrid.functions.quantiles import array_quantile, bounded_quantile
from tidegrid.functions.sizing import calendar_side, constant_side
from tidegrid.operators.series_kernels import BLOCK_VALUES, heavy, pack_series

# Nine panels: y falls from top to bottom, x rises from left to right (fixed values).
# "any" leaves a mode unconstrained: in the tercile layout the middle row constrains x only.
PANELS = [(f"{y}{x}", y, x) for y in "+.-" for x in "-.+"]
TERCILE_PANELS = [("+-", "+", "-"), ("+.", "+", "."), ("++", "+", "+"), (".-", "any", "-"), ("..", "any", "."), (".+", "any", "+"), ("--", "-", "-"), ("-.", "-", "."), ("-+", "-", "+")]
CORNERS = [("--", "-", "-"), ("-+", "-", "+"), ("+-", "+", "-"), ("++", "+", "+")]


# -- states of a month -----------------------------------------------------------------------


def _state(value: Column, low: Column, high: Column) -> Column:
    """'+' above, '-' below, '.' strictly between; a value on a bound has no state."""
    return F.when(value > high, "+").when(value < low, "-").when((value > low) & (value < high), ".")


def sigma_states(series: DataFrame, by: list[str] | None = None, n_sigma: float = 1.0) -> DataFrame:
    """State of each mode and month against plus and minus one population deviation."""
    sd = F.stddev_pop("value").over(Window.partitionBy(*(by or []), "mode")) * n_sigma
    return series.withColumn("state", _state(F.col("value"), -sd, sd))


def quantile_states(series: DataFrame, q: float, by: list[str] | None = None) -> DataFrame:
    """State against the ``1 - q`` and ``q`` quantiles over time (one value per month and mode)."""
    keys = [*(by or []), "mode"]
    bounds = series.groupBy(*keys).agg(bounded_quantile("value", 1 - q).alias("_lo"), bounded_quantile("value", q).alias("_hi"))
    return series.join(bounds, keys).withColumn("state", _state(F.col("value"), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def band_states(band: DataFrame, low: float, high: float, bounds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """State of an ensemble band: '+' wholly above ``high``, '-' wholly below ``low``, '.' otherwise.

    ``bounds`` gives modes a pair ``(low, high)`` of their own.
    """
    below, above = F.lit(low), F.lit(high)
    for name, (lo, hi) in (bounds or {}).items():
        below, above = F.when(F.col("mode") == name, lo).otherwise(below), F.when(F.col("mode") == name, hi).otherwise(above)
    return band.withColumn("state", F.when(F.col("lower") > above, "+").when(F.col("upper") < below, "-").otherwise("."))


def _wide(states: DataFrame, modes: list[str], by: list[str]) -> DataFrame:
    cols = [F.max(F.when(F.col("mode") == m, F.col("state"))).alias(f"s{i}") for i, m in enumerate(modes)]
    return states.filter(F.col("mode").isin(list(modes))).groupBy(*by, "month_idx").agg(*cols)


def pure_phases(states: DataFrame, modes: list[str], by: list[str] | None = None) -> DataFrame:
    """Months in which one mode is outside its bounds and all others inside: rows (mode, phase, month)."""
    by = by or []
    wide = _wide(states, modes, by)
    hits = []
    for i, m in enumerate(modes):
        calm = [F.col(f"s{j}") == "." for j in range(len(modes)) if j != i]
        alone = calm[0]
        for c in calm[1:]:
            alone = alone & c
        hits.append(F.when(alone & F.col(f"s{i}").isin("+", "-"), F.struct(F.lit(m).alias("mode"), F.col(f"s{i}").alias("phase"))))
    out = wide.select(*by, "month_idx", F.explode(F.array_compact(F.array(*hits))).alias("h"))
    return out.select(*by, F.col("h.mode").alias("mode"), F.col("h.phase").alias("phase"), "month_idx")


def panel_months(
    states: DataFrame, y: str, x: str, rules: list[tuple[str, str, str]], z: str | None = None, by: list[str] | None = None
) -> DataFrame:
    """Months of each panel of a rule table; ``z``, where given, must be in its neutral state."""
    by = by or []
    wide = _wide(states, [y, x] + ([z] if z else []), by)
    if z:
        wide = wide.filter(F.col("s2") == ".")

    def holds(column, wanted):
        return F.lit(True) if wanted == "any" else F.col(column) == wanted

    hits = [F.when(holds("s0", sy) & holds("s1", sx), F.lit(name)) for name, sy, sx in rules]
    return wide.select(*by, F.explode(F.array_compact(F.array(*hits))).alias("panel"), "month_idx")


def sample_share(selection: DataFrame, n_times: Column, by: list[str]) -> DataFrame:
    """Number of selected months and their share of all months."""
    return selection.groupBy(*by).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / n_times)


def shift_selection(selection: DataFrame, months: int) -> DataFrame:
    """The selected months moved along the calendar."""
    return selection.withColumn("month_idx", F.col("month_idx") + months)


# -- composites --------------------------------------------------------------------------------


def composite_mean(field: DataFrame, selection: DataFrame, keys: list[str], panel: list[str]) -> DataFrame:
    """Mean over the selected months of each panel.

    The selection is folded to one row per month (an array of panels), so the field meets a
    calendar-sized side once, whatever the number of panels.
    """
    labels = F.struct(*panel)
    side = calendar_side(selection.groupBy("month_idx").agg(F.collect_set(labels).alias("_p")))
    hit = field.join(side, "month_idx").select(*keys, "month_idx", "value", F.explode("_p").alias("_p")).select(*keys, "value", "_p.*")
    return hit.groupBy(*panel, *keys).agg(F.avg("value").alias("mean"), F.count("value").alias("n"))


_SIG = T.ArrayType(
    T.StructType(
        [
            T.StructField("label", T.StringType()),
            T.StructField("mean", T.DoubleType()),
            T.StructField("n", T.LongType()),
            T.StructField("lower", T.DoubleType()),
            T.StructField("upper", T.DoubleType()),
        ]
    )
)


def _row_quantiles(draws: np.ndarray, alpha: float) -> np.ndarray:
    """Lower and upper quantile of each row; the slow form for missing draws only where there are any."""
    out = np.full((2, len(draws)), np.nan)
    missing = np.isnan(draws)
    whole, some = ~missing.any(axis=1), missing.any(axis=1) & ~missing.all(axis=1)
    if whole.any():
        out[:, whole] = np.quantile(draws[whole], [alpha, 1 - alpha], axis=1)
    if some.any():
        out[:, some] = np.nanquantile(draws[some], [alpha, 1 - alpha], axis=1)
    return out


def composites(
    field: DataFrame, selection: DataFrame, keys: list[str], label: str = "panel", n_draws: int = 1000, alpha: float = 0.05, seed: int = 0
) -> DataFrame:
    """Composite of each panel with the range of means of as many randomly drawn months.

    One exchange of the field: a cell is packed into one row, and a kernel forms the composites
    and all draws of all panels as matrix products. The months of the panels and the time axis
    (both no longer than the calendar) reach every row as a scalar subquery. Missing values are
    left out of each mean.
    """
    panels = selection.groupBy(label).agg(F.sort_array(F.collect_set("month_idx")).alias("months")).agg(
        F.sort_array(F.collect_list(F.struct(F.col(label).cast("string").alias("label"), "months"))).alias("p")
    )
    axis = field.agg(F.sort_array(F.collect_set("month_idx")).alias("a"))
    cached: dict = {}

    @heavy
    @F.pandas_udf(_SIG)
    def resample(ts: pd.Series, vs: pd.Series, labels: pd.Series, months: pd.Series, times: pd.Series) -> pd.Series:
        if not len(ts):
            return pd.Series([], dtype=object)
        time = np.asarray(times.iloc[0])
        names, chosen = list(labels.iloc[0]), [np.asarray(m) for m in months.iloc[0]]
        step = max(1, BLOCK_VALUES // max(len(time), n_draws))
        parts = (block(ts[s : s + step], vs[s : s + step], time, names, chosen) for s in range(0, len(ts), step))
        return pd.Series([row for part in parts for row in part])

    def block(ts, vs, time, names, chosen) -> list:
        x = np.full((len(ts), len(time)), np.nan)
        for i, (t, v) in enumerate(zip(ts, vs)):
            x[i, np.searchsorted(time, np.asarray(t))] = np.asarray(v, dtype=float)
        there = np.isfinite(x)
        filled = np.where(there, x, 0.0)
        out: list[list] = [[] for _ in range(len(ts))]
        with np.errstate(invalid="ignore", divide="ignore"):
            for name, picked in zip(names, chosen):
                hot = np.isin(time, picked).astype(float)
                n = int(hot.sum())
                count = there @ hot
                mean = (filled @ hot) / count
                key = (n, len(time))
                if key not in cached:
                    cached[key] = draw_counts(n_draws, n, len(time), seed)
                draws = (filled @ cached[key].T) / (there @ cached[key].T)
                lower, upper = _row_quantiles(draws, alpha)
                for i in range(len(ts)):
                    out[i].append(
                        {"label": name, "mean": None if count[i] == 0 else mean[i], "n": int(count[i]), "lower": lower[i], "upper": upper[i]}
                    )
        return out

    packed = pack_series(field, keys).withColumns({"_p": panels.scalar(), "_a": axis.scalar()})
    rows = packed.select(*keys, F.explode(resample("ts", "vs", F.col("_p.label"), F.col("_p.months"), F.col("_a"))).alias("r"))
    out = rows.select(F.col("r.label").alias(label), *keys, "r.mean", "r.n", "r.lower", "r.upper")
    return out.withColumn("significant", (F.col("mean") > F.col("upper")) | (F.col("mean") < F.col("lower")))


def draw_table(sizes: DataFrame, n_draws: int, n_times: Column, seed: int = 0) -> DataFrame:
    """The same draws as rows ``(panel, draw, pos, mult)``, for joins on a small grid."""
    d = F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))).alias("draw")
    rows = sizes.select("panel", "n", d).select("panel", "draw", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("item"))
    x = (F.col("draw").cast("long") * DRAW_STEP + F.col("item").cast("long") * ITEM_STEP + seed + 1) % DRAW_PRIME
    for mix in (MIX_A, MIX_B):
        x = (x * x + mix) % DRAW_PRIME
    return rows.withColumn("pos", (x % n_times).cast("int")).groupBy("panel", "draw", "pos").agg(F.count("*").alias("mult"))


def bootstrap_by_join(field: DataFrame, draws: DataFrame, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """Draw means as a join of cells and panels.

    A cell is one row, with sums and counts by place on the time axis, and meets one row per panel with all its draws. So draws are
    neither exchanged nor grouped, and rows don't grow with them.
    """
    axis = calendar_side(field.select("month_idx").distinct().select("month_idx", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("month_idx")) - 1).alias("pos")))
    known = field.filter(F.col("value").isNotNull()).join(axis, "month_idx").groupBy(*keys, "pos").agg(F.sum("value").alias("s"), F.count("*").alias("c"))
    cells = known.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("pos", F.struct("s", "c")))).alias("_m"))
    cells = cells.withColumn("_at", F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys("_m"))), lambda p: F.element_at("_m", p)))
    drawn = draws.groupBy("panel", "draw").agg(F.sort_array(F.collect_list(F.struct("pos", "mult"))).alias("d"))
    panels = drawn.groupBy("panel").agg(F.collect_list("d").alias("draws")).agg(F.collect_list(F.struct("panel", "draws")).alias("p"))

    def mean(draw: Column) -> Column:
        def add(total: Column, x: Column) -> Column:
            at = F.get("_at", x["pos"])
            return F.struct(
                (total["s"] + F.coalesce(at["s"] * x["mult"], F.lit(0.0))).alias("s"), (total["c"] + F.coalesce(at["c"] * x["mult"], F.lit(0).cast("long"))).alias("c")
            )

        start = F.struct(F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("c"))
        return F.aggregate(draw, start, add, lambda t: F.when(t["c"] > 0, t["s"] / t["c"]))

    rows = cells.withColumn("_p", panels.scalar()).select(*keys, "_at", F.explode("_p").alias("_p"))
    rows = rows.select(F.col("_p.panel").alias("panel"), *keys, F.sort_array(F.filter(F.transform("_p.draws", mean), lambda m: m.isNotNull())).alias("_m"))
    return rows.filter(F.size("_m") > 0).select("panel", *keys, array_quantile("_m", alpha).alias("lower"), array_quantile("_m", 1 - alpha).alias("upper"))
def responses(comp: DataFrame, keys: list[str], phase: str = "phase", half: bool = False) -> DataFrame:
    """Linear (positive minus negative) and nonlinear (sum) response of paired composites."""
    def pick(side, column):
        return F.max(F.when(F.col(phase) == side, F.col(column)))

    factor = 0.5 if half else 1.0
    cols = [((pick("+", "mean") - pick("-", "mean")) * factor).alias("linear"), ((pick("+", "mean") + pick("-", "mean")) * factor).alias("nonlinear")]
    if "significant" in comp.columns:
        cols += [
            (pick("+", "significant") | pick("-", "significant")).alias("significant_any"),
            (pick("+", "significant") & pick("-", "significant")).alias("significant_both"),
        ]
    return comp.groupBy(*keys).agg(*cols)


def rule_table(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    """The panel rules as a literal table."""
    return constant_side(spark.createDataFrame(rules, "panel string, y_state string, x_state string"))
