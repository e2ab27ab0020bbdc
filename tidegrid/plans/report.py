"""Tables behind the figures: phase composites, responses, lag correlation of filtered indices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.anomaly import anomalies, global_detrend
from tidegrid.operators.composite import composites, panel_months, pure_phases, quantile_states, responses, sigma_states
from tidegrid.operators.filters import low_pass
from tidegrid.operators.lagcorr import cross_correlation_by_month, significant
from tidegrid.operators.select import n_months


def basin_anomalies(field: DataFrame, by: list[str], cell: list[str]) -> DataFrame:
    """Area-mean trend and climatology removed."""
    return anomalies(global_detrend(field, by), cell)


def phase_report(field: DataFrame, indices: DataFrame, modes: list[str], by: list[str], cell: list[str], n_draws: int = 1000, alpha: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Composites of both phases of each mode with significance, and their responses."""
    picked = pure_phases(sigma_states(indices), modes).withColumn("panel", F.concat_ws("|", "mode", "phase"))
    comp = composites(basin_anomalies(field, by, cell), picked, cell, "panel", n_draws, alpha)
    comp = comp.withColumns({"mode": F.split("panel", "\\|")[0], "phase": F.split("panel", "\\|")[1]}).drop("panel")
    return comp, responses(comp, ["mode", *cell])


def panel_report(
    field: DataFrame, indices: DataFrame, y: str, x: str, rules: list[tuple[str, str, str]], by: list[str], cell: list[str], q: float = 0.67, n_draws: int = 1000, alpha: float = 0.05
) -> DataFrame:
    """Panels of a rule table on quantile states: composite, its range under resampling, and the share of months."""
    picked = panel_months(quantile_states(indices, q), y, x, rules)
    comp = composites(basin_anomalies(field, by, cell), picked, cell, "panel", n_draws, alpha)
    return comp.withColumn("share", F.max("n").over(Window.partitionBy("panel", *cell)) / n_months(indices))


def lag_report(x: DataFrame, y: DataFrame, keys: list[str], period: float | None = None, max_lag: int = 36, alpha: float = 0.05) -> DataFrame:
    """Lag correlation by calendar month, optionally with both series low-passed first."""
    if period is not None:
        x, y = low_pass(x, keys, period), low_pass(y, keys, period)
    return significant(cross_correlation_by_month(x, y, keys, max_lag), alpha)
