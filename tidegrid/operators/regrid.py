"""Interpolation weights, their application, and one-dimensional interpolation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.sizing import checked_side


@dataclass(frozen=True)
class Axis:
    """Evenly spaced coordinate ``start + step * i`` for ``i`` below ``size``."""

    start: float
    step: float
    size: int

    def position(self, coord: Column) -> Column:
        return (coord - F.lit(float(self.start))) / F.lit(float(self.step))

    def coordinate(self, index: Column) -> Column:
        return F.lit(float(self.start)) + index * F.lit(float(self.step))


def linspace_axis(low: float, high: float, size: int) -> Axis:
    return Axis(low, (high - low) / (size - 1), size)


def _bracket(pos: Column, size: int, periodic: bool) -> tuple[Column, Column, Column]:
    """Lower index, upper index and share of the upper one; NULL outside an open axis."""
    if periodic:
        pos = F.pmod(pos, F.lit(float(size)))
        low = F.floor(pos).cast("int")
        return low, F.pmod(low + 1, F.lit(size)), pos - low
    inside = (pos >= 0) & (pos <= size - 1)
    low = F.least(F.floor(pos).cast("int"), F.lit(max(size - 2, 0)))
    return F.when(inside, low), F.when(inside, low + 1), pos - low


def bilinear_weights(dst: DataFrame, lat: Axis, lon: Axis, periodic: bool = True) -> DataFrame:
    """Weights from a rectilinear source to the nodes ``(dst_lat_i, dst_lon_i, lat, lon)``.

    Four corners per node by arithmetic on the coordinates; corners without weight are left out
    and ``corners`` says how many remain. Nodes outside the source get no weights.
    """
    y0, y1, ty = _bracket(lat.position(F.col("lat")), lat.size, False)
    x0, x1, tx = _bracket(lon.position(F.col("lon")), lon.size, periodic)
    nodes = dst.select("dst_lat_i", "dst_lon_i", y0.alias("y0"), y1.alias("y1"), ty.alias("ty"), x0.alias("x0"), x1.alias("x1"), tx.alias("tx"))
    # lower and upper side of an axis, as (name of the index, share)
    sides_y, sides_x = (("y0", 1 - F.col("ty")), ("y1", F.col("ty"))), (("x0", 1 - F.col("tx")), ("x1", F.col("tx")))
    corner = [F.struct(F.col(y).alias("lat_i"), F.col(x).alias("lon_i"), (wy * wx).alias("w")) for y, wy in sides_y for x, wx in sides_x]
    n = sum((F.when((wy * wx) > 0, 1).otherwise(0) for _, wy in sides_y for _, wx in sides_x), F.lit(0))
    rows = nodes.filter(F.col("y0").isNotNull() & F.col("x0").isNotNull()).select(
        "dst_lat_i", "dst_lon_i", n.alias("corners"), F.explode_outer(F.array(*corner)).alias("c")
    )
    return rows.select("dst_lat_i", "dst_lon_i", "corners", "c.lat_i", "c.lon_i", "c.w").filter("w > 0")


def apply_weights(df: DataFrame, weights: DataFrame, by: list[str]) -> DataFrame:
    """Weighted sums on the target grid; a node is NULL when any source corner is missing.

    The weights are broadcast when counted as small, so that the field is reduced before its
    only exchange.
    """
    hit = df.join(checked_side(weights), ["lat_i", "lon_i"])
    sums = hit.groupBy(*by, "dst_lat_i", "dst_lon_i").agg(
        F.sum(F.col("w") * F.col("value")).alias("value"), F.count("value").alias("_have"), F.first("corners").alias("_need")
    )
    return sums.withColumn("value", F.when(F.col("_have") == F.col("_need"), F.col("value"))).drop("_have", "_need")


def interpolate_onto(samples: DataFrame, targets: DataFrame, keys: list[str], x: str = "x", value: str = "value") -> DataFrame:
    """Linear interpolation of samples at target positions, constant beyond the ends.

    Samples and targets are merged and ordered, so no range join is needed.
    """
    both = samples.filter(F.col(value).isNotNull()).select(*keys, x, F.struct(F.col(x).cast("double").alias("x"), F.col(value).alias("v")).alias("_s"), F.lit(False).alias("_t"))
    both = both.unionByName(targets.select(*keys, x).withColumns({"_s": F.lit(None), "_t": F.lit(True)}))
    order = Window.partitionBy(*keys).orderBy(x)
    both = both.withColumns(
        {
            "_l": F.last("_s", True).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)),
            "_r": F.first("_s", True).over(order.rangeBetween(Window.currentRow, Window.unboundedFollowing)),
        }
    )
    share = F.try_divide(F.col(x) - F.col("_l.x"), F.col("_r.x") - F.col("_l.x"))
    blend = F.when(F.col("_r.x") > F.col("_l.x"), F.col("_l.v") + share * (F.col("_r.v") - F.col("_l.v")))
    return both.filter("_t").select(*keys, x, F.coalesce(blend, F.col("_l.v"), F.col("_r.v")).alias(value))


def nearest_state(states: DataFrame, probes: Column, by: list[str], axes: tuple[str, str], label: str) -> DataFrame:
    """State closest to each probe in two latent axes, the lowest label on ties.

    ``probes`` is an array of ``struct(probe, x, y)`` of fixed length. Each state meets the
    probes in its own map task and only the best per task and probe is exchanged.
    """
    z = states.select(*by, label, *axes, F.explode(probes).alias("p"))
    dist = F.sqrt(F.pow(F.col(axes[0]) - F.col("p.x"), 2) + F.pow(F.col(axes[1]) - F.col("p.y"), 2))
    z = z.select(*by, F.col("p.probe").alias("probe"), F.col("p.x").alias("x"), F.col("p.y").alias("y"), label, dist.alias("distance"))
    best = F.min(F.struct("distance", label))
    return z.groupBy(*by, "probe", "x", "y").agg(best.alias("b")).select(*by, "probe", "x", "y", f"b.{label}", "b.distance")
