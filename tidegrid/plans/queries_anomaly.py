"""Queries on climatologies, trends, area means and held-out anomalies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.functions.calendar import month_of
from tidegrid.operators import anomaly as A
from tidegrid.operators import select as S
from tidegrid.plans import fixtures as X
from tidegrid.plans.registry import query, rnd, rounded

# months 1999-01 and later are held out (fixed value)
HELD_OUT = 1999 * 12
BASE = (1995 * 12, 1998 * 12 + 11)


@query(
    "area_mean_anomaly",
    "SRC1 PRJ23 AGG4 AGG5 AGG7 JN2",
    f"""with {X.FIELD_SQL},
c as (select member, lat_i, lon_i, month_idx % 12 as m, sum(value*n)/sum(n) as clim from f group by 1, 2, 3, 4),
a as (select f.member, f.month_idx, f.lat_i, f.value - c.clim as anom from f join c on f.member = c.member and f.lat_i = c.lat_i
      and f.lon_i = c.lon_i and f.month_idx % 12 = c.m)
select member, month_idx, {rnd("sum(cos(radians(10.0*lat_i - 45.0))*anom)/sum(cos(radians(10.0*lat_i - 45.0)))")} as value
from a group by 1, 2""",
)
def area_mean_anomaly(spark, sf):
    anom = A.anomalies(X.field(spark, sf), A.CELL)
    return A.area_mean(anom, ["member", "month_idx"]).withColumn("value", rounded("value"))


@query(
    "climatology_baseline",
    "AGG4 PRJ9",
    f"""with {X.ENSEMBLE_SQL}
select member, lat_i, lon_i, cast(month_idx % 12 + 1 as int) as month, {rnd("sum(value*n)/sum(n)")} as clim
from g where month_idx between {BASE[0]} and {BASE[1]} group by 1, 2, 3, 4""",
)
def climatology_baseline(spark, sf):
    return A.climatology(X.ensemble_field(spark, sf), A.CELL, BASE).withColumn("clim", rounded("clim"))


@query(
    "anomaly_raw_baseline",
    "AGG5 AGG4 JN2",
    f"""with {X.RAW_SQL},
c as (select member, lat_i, lon_i, month_idx % 12 as m, avg(value) as clim from raw where month_idx between {BASE[0]} and {BASE[1]} group by 1, 2, 3, 4),
y as (select member, lat_i, lon_i, month_idx, avg(value) as value from raw group by 1, 2, 3, 4)
select y.member, y.lat_i, y.lon_i, y.month_idx, {rnd("y.value - c.clim")} as value
from y left join c on y.member = c.member and y.lat_i = c.lat_i and y.lon_i = c.lon_i and y.month_idx % 12 = c.m""",
)
def anomaly_raw_baseline(spark, sf):
    flat = A.monthly(X.raw_field(spark, sf), A.CELL)
    return A.anomalies(flat, A.CELL, BASE).select(*A.CELL, "month_idx", rounded("value").alias("value"))


@query(
    "area_mean_raw",
    "AGG7",
    f"""with {X.RAW_SQL}
select member, month_idx, {rnd("sum(cos(radians(lat))*value)/sum(cos(radians(lat)))")} as value from raw group by 1, 2""",
)
def area_mean_raw(spark, sf):
    return A.area_mean(X.raw_field(spark, sf), ["member", "month_idx"]).withColumn("value", rounded("value"))


@query(
    "box_mean_index",
    "AGG12 PRJ10 AGG1",
    f"""with {X.FIELD_SQL},
b as (select member, month_idx, lon_i, avg(value) as value from f where 10.0*lat_i - 45.0 between -15 and 15 and 30.0*lon_i between 60 and 180 group by 1, 2, 3)
select member, month_idx, {rnd("avg(value)")} as value from b group by 1, 2""",
)
def box_mean_index(spark, sf):
    inside = S.box(X.field(spark, sf), lat=(-15, 15), lon=(60, 180))
    return A.box_mean(inside, ["member", "month_idx"]).withColumn("value", rounded("value"))


# quadratic through power sums of a centred time; the same normal equations as text
_POLY2 = """
z as (select *, (month_idx - c0)/h0 as u from (select *, (max(month_idx) over (partition by {k}) + min(month_idx) over (partition by {k}))/2.0 as c0,
      greatest(1.0, (max(month_idx) over (partition by {k}) - min(month_idx) over (partition by {k}))/2.0) as h0 from {src}) q),
p as (select {k}, any_value(c0) as c0, any_value(h0) as h0, cast(count(*) as double) as a, sum(u) as b, sum(u*u) as c, sum(u*u*u) as d, sum(u*u*u*u) as e,
      sum(value) as t0, sum(u*value) as t1, sum(u*u*value) as t2 from z group by {k}),
q2 as (select *, a*(c*e - d*d) - b*(b*e - d*c) + c*(b*d - c*c) as det from p),
k2 as (select {k}, c0, h0, (t0*(c*e - d*d) - b*(t1*e - d*t2) + c*(t1*d - c*t2))/det as b0,
      (a*(t1*e - d*t2) - t0*(b*e - d*c) + c*(b*t2 - t1*c))/det as b1,
      (a*(c*t2 - d*t1) - b*(b*t2 - t1*c) + t0*(b*d - c*c))/det as b2 from q2)"""


@query(
    "detrend_cells_quadratic",
    "AGG8 AGG9 AGG10",
    f"""with {X.ENSEMBLE_SQL}, {_POLY2.format(k="member, lat_i, lon_i", src="g")}
select member, lat_i, lon_i, month_idx, {rnd("value - (b0 + b1*u + b2*u*u)", 5)} as value from
(select z.*, k2.b0, k2.b1, k2.b2 from z join k2 using (member, lat_i, lon_i)) j""",
)
def detrend_cells_quadratic(spark, sf):
    out = A.detrend_cells(X.ensemble_field(spark, sf), A.CELL, 2)
    return out.select(*A.CELL, "month_idx", rounded("value", 5).alias("value"))


@query(
    "trend_slope_linear",
    "AGG8 AGG10",
    f"""with {X.ENSEMBLE_SQL}
select member, lat_i, lon_i, {rnd("regr_slope(value, month_idx)")} as slope from g group by 1, 2, 3""",
)
def trend_slope_linear(spark, sf):
    out = A.detrend_cells(X.ensemble_field(spark, sf), A.CELL, 1)
    return out.groupBy(*A.CELL).agg(rounded(F.first("slope")).alias("slope"))


_AREA = f"""
w as (select member, month_idx, sum(cos(radians(20.0*lat_i - 40.0))*value)/sum(cos(radians(20.0*lat_i - 40.0))) as value from {{src}} group by 1, 2)"""


@query(
    "global_detrend_field",
    "AGG11 AGG7 AGG8 AGG9 JN3",
    f"""with {X.ENSEMBLE_SQL}, {_AREA.format(src="g")}, {_POLY2.format(k="member", src="w")}
select g.member, lat_i, lon_i, month_idx, {rnd("value - (b0 + b1*(month_idx - c0)/h0 + b2*((month_idx - c0)/h0)*((month_idx - c0)/h0))", 5)} as value
from g join k2 on g.member = k2.member""",
)
def global_detrend_field(spark, sf):
    out = A.global_detrend(X.ensemble_field(spark, sf), ["member"], 2)
    return out.select(*A.CELL, "month_idx", rounded("value", 5).alias("value"))


@query(
    "global_detrend_parts",
    "AGG11 AGG9",
    f"""with {X.ENSEMBLE_SQL}, {_AREA.format(src="g")}, {_POLY2.format(k="member", src="w")}
select w.member, month_idx, {rnd("value", 5)} as area_mean, {rnd("b0 + b1*(month_idx - c0)/h0 + b2*((month_idx - c0)/h0)*((month_idx - c0)/h0)", 5)} as fit
from w join k2 on w.member = k2.member""",
)
def global_detrend_parts(spark, sf):
    trend = A.global_trend(X.ensemble_field(spark, sf), ["member"], 2)
    return trend.mean.join(trend.fit_at(trend.mean.drop("value")), ["member", "month_idx"]).select(
        "member", "month_idx", rounded("value", 5).alias("area_mean"), rounded("fit", 5).alias("fit")
    )


@query(
    "heldout_anomaly",
    "AGG6 JN2 JN3 SET2",
    f"""with {X.ENSEMBLE_SQL}, tr as (select * from g where month_idx < {HELD_OUT}), {_AREA.format(src="tr")}, {_POLY2.format(k="member", src="w")},
dt as (select g.member, lat_i, lon_i, month_idx, n, value - (b0 + b1*(month_idx - c0)/h0 + b2*((month_idx - c0)/h0)*((month_idx - c0)/h0)) as value
       from g join k2 on g.member = k2.member),
cl as (select member, lat_i, lon_i, month_idx % 12 as m, sum(value*n)/sum(n) as clim from dt where month_idx < {HELD_OUT} group by 1, 2, 3, 4)
select dt.member, dt.lat_i, dt.lon_i, dt.month_idx, {rnd("dt.value - cl.clim", 5)} as value from dt left join cl
on dt.member = cl.member and dt.lat_i = cl.lat_i and dt.lon_i = cl.lon_i and dt.month_idx % 12 = cl.m where dt.month_idx >= {HELD_OUT}""",
)
def heldout_anomaly(spark, sf):
    field = X.ensemble_field(spark, sf)
    model = A.AnomalyModel.fit(S.time_range(field, last=HELD_OUT - 1), ["member"], A.CELL)
    out = model.transform(S.time_range(field, first=HELD_OUT))
    return out.withColumn("value", rounded("value", 5))


@query(
    "subtract_area_mean",
    "JN3 AGG7",
    f"""with {X.FIELD_SQL}, s as (select month_idx, avg(value) as mean from f group by 1)
select member, lat_i, lon_i, f.month_idx, {rnd("value - mean")} as value from f join s on f.month_idx = s.month_idx""",
)
def subtract_area_mean(spark, sf):
    field = X.field(spark, sf)
    mean = field.groupBy("month_idx").agg(F.avg("value").alias("mean"))
    return A.subtract_monthly(field, mean, "mean").select(*A.CELL, "month_idx", rounded("value").alias("value"))


@query(
    "month_filter",
    "PRJ23 AGG1",
    f"""with {X.ENSEMBLE_SQL}
select member, lat_i, lon_i, {rnd("avg(value)")} as value, cast(count(*) as bigint) as n from g where month_idx % 12 + 1 in (12, 1, 2) group by 1, 2, 3""",
)
def month_filter(spark, sf):
    winter = X.ensemble_field(spark, sf).filter(month_of(F.col("month_idx")).isin(12, 1, 2))
    return winter.groupBy(*A.CELL).agg(rounded(F.avg("value")).alias("value"), F.count("*").alias("n"))
