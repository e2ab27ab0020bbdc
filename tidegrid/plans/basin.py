"""From raw gridded files to a masked basin dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.regrid import apply_weights
from tidegrid.operators.select import drop_empty_axes, mask_cells
from tidegrid.schema import missing_to_null, normalize_columns


def build_basin(
    raw: DataFrame,
    weights: DataFrame,
    mask: DataFrame,
    by: list[str],
    relabel: Column | None = None,
    skip_months: tuple[int, ...] = (),
    sentinel: float | None = -999.0,
) -> DataFrame:
    """Rename, clean, regrid, mask, drop empty rows and columns, and re-label longitudes.

    One lazy plan: months to skip are filtered at the scan, and the field is exchanged once, as
    partial sums on the target grid. ``relabel`` is an expression on ``lon``.
    """
    df = normalize_columns(raw).withColumn("value", missing_to_null(F.col("value"), sentinel))
    if skip_months:
        df = df.filter(~F.col("month_idx").isin(*skip_months))
    out = apply_weights(df, weights, by).withColumnsRenamed({"dst_lat_i": "lat_i", "dst_lon_i": "lon_i"})
    out = drop_empty_axes(mask_cells(out, mask))
    if relabel is not None:
        nodes = mask.select("lat_i", "lon_i", "lat", relabel.alias("lon")).distinct()
        out = out.join(nodes, ["lat_i", "lon_i"])
    return out
