"""Queries on series, ensembles, folds and correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.operators import anomaly as A
from tidegrid.operators import gram as M
from tidegrid.operators import lagcorr as L
from tidegrid.operators import series as Q
from tidegrid.operators.select import time_range
from tidegrid.plans import fixtures as X
from tidegrid.plans.registry import query, rnd, rounded

_MODES_SQL = "(" + ", ".join(f"'{m}'" for m in X.MODES) + ")"


def p_value_sql(t: str, df: str) -> str:
    """Two-sided Student probability for whole degrees of freedom, as a finite trigonometric sum."""
    theta = f"atan(abs({t})/sqrt({df}))"
    even = f"sin({theta})*list_sum(list_transform(range(0, greatest(1, cast({df} as int)//2)), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1.0))/sqrt(pi())*pow(cos({theta}), 2*k)))"
    odd = (
        f"2/pi()*({theta} + case when {df} = 1 then 0 else sin({theta})*cos({theta})*list_sum(list_transform(range(0, greatest(1, (cast({df} as int) - 1)//2)), "
        f"lambda k: sqrt(pi())/2*exp(lgamma(k + 1.0) - lgamma(k + 1.5))*pow(cos({theta}), 2*k))) end)"
    )
    return f"(1 - case when cast({df} as int) % 2 = 0 then {even} else {odd} end)"


@query(
    "centred_rolling_mean",
    "WIN1",
    f"""with {X.FIELD_SQL}, s as (select member, month_idx, avg(value) as value from f group by 1, 2)
select member, month_idx, case when count(*) over w = 3 then {rnd("avg(value) over w")} end as value from s
window w as (partition by member order by month_idx range between 1 preceding and 1 following)""",
)
def centred_rolling_mean(spark, sf):
    s = X.field(spark, sf).groupBy("member", "month_idx").agg(F.avg("value").alias("value"))
    return Q.centred_mean(s, ["member"], 3).withColumn("value", rounded("value"))


@query(
    "trailing_sum_24",
    "WIN2",
    f"""with {X.ENSEMBLE_SQL}, s as (select member, lat_i, lon_i, month_idx, value from g)
select * from (select member, lat_i, lon_i, month_idx, case when count(*) over w = 24 then {rnd("sum(value) over w")} end as value from s
window w as (partition by member, lat_i, lon_i order by month_idx range between 23 preceding and current row)) q where value is not null""",
)
def trailing_sum_24(spark, sf):
    out = Q.trailing_sum(X.ensemble_field(spark, sf), A.CELL, 24).filter(F.col("value").isNotNull())
    return out.select(*A.CELL, "month_idx", rounded("value").alias("value"))


@query(
    "zonal_rolling_mean",
    "WIN3",
    f"""with {X.FIELD_SQL}, s as (select member, lat_i, lon_i, avg(value) as value from f group by 1, 2, 3)
select member, lat_i, lon_i, case when count(*) over w = 3 then {rnd("avg(value) over w")} end as value from s
window w as (partition by member, lat_i order by lon_i range between 1 preceding and 1 following)""",
)
def zonal_rolling_mean(spark, sf):
    s = X.field(spark, sf).groupBy(*A.CELL).agg(F.avg("value").alias("value"))
    return Q.centred_mean(s, ["member", "lat_i"], 3, "lon_i").withColumn("value", rounded("value"))


@query(
    "fill_gaps_latitude",
    "WIN4",
    f"""with {X.ENSEMBLE_SQL}, s as (select member, month_idx, lon_i, 20.0*lat_i - 40.0 as lat, case when n > 1 then value end as value from g),
b as (select *, last_value(case when value is not null then lat end ignore nulls) over wa as x0, last_value(value ignore nulls) over wa as v0,
      first_value(case when value is not null then lat end ignore nulls) over wb as x1, first_value(value ignore nulls) over wb as v1 from s
      window wa as (partition by member, month_idx, lon_i order by lat rows between unbounded preceding and current row),
             wb as (partition by member, month_idx, lon_i order by lat rows between current row and unbounded following))
select member, month_idx, lon_i, cast(lat as double) as lat, {rnd("coalesce(value, v0 + (lat - x0)/(x1 - x0)*(v1 - v0))")} as value from b""",
)
def fill_gaps_latitude(spark, sf):
    gappy = X.ensemble_field(spark, sf).withColumn("value", F.when(F.col("n") > 1, F.col("value")))
    out = Q.fill_gaps(gappy, ["member", "month_idx", "lon_i"], "lat")
    return out.select("member", "month_idx", "lon_i", "lat", rounded("value").alias("value"))


@query(
    "zonal_gradient",
    "WIN5",
    f"""with {X.FIELD_SQL}, s as (select member, lat_i, month_idx, 30.0*lon_i as lon, value from f),
b as (select *, lag(value) over w as vb, lead(value) over w as va, lon - lag(lon) over w as hs, lead(lon) over w - lon as hd from s window w as (partition by member, lat_i, month_idx order by lon))
select member, lat_i, month_idx, cast(lon as double) as lon, {rnd("case when hs is null then (va - value)/hd when hd is null then (value - vb)/hs else (hs*hs*va + (hd*hd - hs*hs)*value - hd*hd*vb)/(hs*hd*(hs + hd)) end")} as gradient from b""",
)
def zonal_gradient(spark, sf):
    out = Q.gradient(X.field(spark, sf), ["member", "lat_i", "month_idx"], "lon")
    return out.select("member", "lat_i", "month_idx", "lon", rounded("gradient").alias("gradient"))


@query(
    "band_difference",
    "WIN6",
    f"""with {X.FIELD_SQL}, s as (select member, month_idx, lon_i, 10.0*lat_i - 45.0 as lat, value from f)
select member, month_idx, lon_i, {rnd("avg(case when lat between -30 and -5 then value end) - avg(case when lat between 5 and 30 then value end)")} as difference from s group by 1, 2, 3""",
)
def band_difference(spark, sf):
    return Q.band_difference(X.field(spark, sf), ["member", "month_idx", "lon_i"], (-30, -5), (5, 30)).withColumn("difference", rounded("difference"))


_FOLDS = """
ax as (select month_idx, cast((row_number() over (order by month_idx) - 1) % 5 as int) as fold from (select distinct month_idx from {src}) q)"""


@query(
    "fold_assignment",
    "WIN8 WIN9 SET2",
    f"""with {X.FIELD_SQL}, {_FOLDS.format(src="f")},
tr as (select s.split, ax.month_idx, cast((row_number() over (partition by s.split order by ax.month_idx) - 1) % 4 as int) as batch
       from ax cross join (select unnest(range(0, 5)) as split) s where s.split <> ax.fold)
select cast(tr.split as int) as split, tr.batch, ax.fold, f.month_idx, cast(count(*) as bigint) as n, {rnd("avg(value)")} as value
from f join ax on f.month_idx = ax.month_idx join tr on tr.month_idx = f.month_idx group by 1, 2, 3, 4""",
)
def fold_assignment(spark, sf):
    rows = Q.resplit_training(Q.training_folds(Q.assign_folds(X.field(spark, sf), 5), 5), 4)
    return rows.groupBy("split", "batch", "fold", "month_idx").agg(F.count("*").alias("n"), rounded(F.avg("value")).alias("value"))


@query(
    "ensemble_band",
    "AGG14 AGG15",
    f"""with {X.ENCODINGS_SQL} select mode, month_idx, {rnd("avg(value)")} as mean, {rnd("quantile_cont(value, 0.025)")} as lower, {rnd("quantile_cont(value, 0.975)")} as upper from e group by 1, 2""",
)
def ensemble_band(spark, sf):
    out = Q.ensemble_band(X.encodings(spark, sf), ["mode", "month_idx"], 0.05)
    return out.select("mode", "month_idx", *[rounded(c).alias(c) for c in ("mean", "lower", "upper")])


@query(
    "crossvalidation_stitch",
    "AGG16 WIN9 SET1",
    f"""with {X.ENCODINGS_SQL}, r as (select cast(initialization // 5 as int) as run, initialization % 5 as split, mode, month_idx, value from e)
select run, mode, month_idx, {rnd("avg(value)")} as value from r where month_idx >= {1999 * 12} group by 1, 2, 3
union all select run, mode, month_idx, {rnd("value")} from r where month_idx < {1999 * 12} and split = month_idx % 5""",
)
def crossvalidation_stitch(spark, sf):
    """Five initializations play the splits of a run: each fold of the first years comes from one of them."""
    e = X.encodings(spark, sf).withColumns({"run": F.floor(F.col("initialization") / 5).cast("int"), "split": F.col("initialization") % 5})
    val = time_range(e, last=1999 * 12 - 1).filter(F.col("split") == F.col("month_idx") % 5)
    return Q.stitch_folds(val, time_range(e, first=1999 * 12), ["run", "mode"]).withColumn("value", rounded("value"))


@query(
    "running_ensemble_mean",
    "AGG17 AGG1",
    f"""with {X.ENSEMBLE_SQL} select lat_i, lon_i, month_idx, {rnd("avg(value)")} as value from g group by 1, 2, 3""",
)
def running_ensemble_mean(spark, sf):
    return Q.ensemble_mean(X.ensemble_field(spark, sf), ["lat_i", "lon_i", "month_idx"]).withColumn("value", rounded("value"))


@query(
    "population_spread",
    "AGG2 AGG3 AGG24",
    f"""with {X.ENSEMBLE_SQL}, s as (select member, lat_i, lon_i, stddev_pop(value) as sd, var_pop(value) as v, var_samp(value) as vs from g group by 1, 2, 3)
select member, {rnd("sum(sd)")} as spread, {rnd("sum(v)")} as total_variance, {rnd("sum(vs)")} as sample_variance from s group by 1""",
)
def population_spread(spark, sf):
    cells = X.ensemble_field(spark, sf).groupBy(*A.CELL).agg(
        F.stddev_pop("value").alias("sd"), F.var_pop("value").alias("v"), F.var_samp("value").alias("vs")
    )
    return cells.groupBy("member").agg(
        rounded(F.sum("sd")).alias("spread"), rounded(F.sum("v")).alias("total_variance"), rounded(F.sum("vs")).alias("sample_variance")
    )


@query(
    "series_correlation",
    "AGG18 JN1",
    f"""with {X.ENSEMBLE_SQL}, r as (select month_idx, lat_i, lon_i, avg(value) as ref from g group by 1, 2, 3)
select g.member, {rnd("corr(g.value, r.ref)")} as r, cast(count(*) as bigint) as n from g join r on g.month_idx = r.month_idx and g.lat_i = r.lat_i and g.lon_i = r.lon_i group by 1""",
)
def series_correlation(spark, sf):
    g = X.ensemble_field(spark, sf)
    ref = g.groupBy("month_idx", "lat_i", "lon_i").agg(F.avg("value").alias("ref"))
    return Q.correlation(g.join(ref, ["month_idx", "lat_i", "lon_i"]), ["member"], "value", "ref").withColumn("r", rounded("r"))


@query(
    "mode_correlations",
    "AGG19 AGG41",
    f"""with {X.ENCODINGS_SQL}, ok as (select initialization, month_idx from e group by 1, 2 having count(*) = 5),
k as (select e.* from e join ok on e.initialization = ok.initialization and e.month_idx = ok.month_idx)
select a.initialization, a.mode as mode_a, b.mode as mode_b, {rnd("corr(a.value, b.value)")} as r
from k a join k b on a.initialization = b.initialization and a.month_idx = b.month_idx group by 1, 2, 3""",
)
def mode_correlations(spark, sf):
    out = M.correlation_table(X.encodings(spark, sf), ["month_idx"], list(X.MODES), ["initialization"])
    return out.withColumn("r", rounded("r"))


@query(
    "vector_correlations",
    "AGG41",
    f"""with {X.VECTORS_SQL}, d as (select vec_id, cast(dim as int) as dim, value from v),
s as (select dim, avg(value) as mu, stddev_pop(value) as sd from d group by 1)
select a.dim as i, b.dim as j, {rnd("corr(a.value, b.value)")} as r from d a join d b on a.vec_id = b.vec_id group by 1, 2""",
)
def vector_correlations(spark, sf):
    emb = X.table(spark, sf, "embeddings").select(F.col("embedding").cast("array<double>").alias("vec"))
    return M.correlations(emb, "vec").withColumn("r", rounded("r"))


_LAG_SQL = f"""with {X.ENCODINGS_SQL},
p as (select a.initialization, a.month_idx, l.lag, a.value as x, b.value as y from e a cross join (select unnest(range(-{{L}}, {{L}} + 1)) as lag) l
      join e b on a.initialization = b.initialization and b.month_idx = a.month_idx + l.lag where a.mode = '2-HIGH' and b.mode = '1-URGENT'),
c as (select initialization{{m}}, cast(lag as int) as lag, corr(x, y) as r, cast(count(*) as bigint) as n from p group by all)"""


def _urgent_high(spark, sf):
    e = X.encodings(spark, sf)
    return e.filter("mode = '2-HIGH'"), e.filter("mode = '1-URGENT'")


@query(
    "lag_correlation_by_month",
    "AGG20 JN5 PRJ20 PRJ23",
    _LAG_SQL.format(L=12, m=", cast(month_idx % 12 + 1 as int) as month")
    + f""" select initialization, month, lag, n, case when n > 2 then {rnd("r")} end as r, case when n > 2 then {rnd(p_value_sql("(r*sqrt((n - 2)/(1 - r*r)))", "(n - 2)"))} end as p_value,
case when n > 2 and {p_value_sql("(r*sqrt((n - 2)/(1 - r*r)))", "(n - 2)")} <= 0.05 then {rnd("r")} end as r_significant from c""",
)
def lag_correlation_by_month(spark, sf):
    x, y = _urgent_high(spark, sf)
    out = L.significant(L.cross_correlation_by_month(x, y, ["initialization"], 12))
    # two pairs always lie on a line
    return out.select("initialization", "month", "lag", "n", *[F.when(F.col("n") > 2, rounded(c)).alias(c) for c in ("r", "p_value", "r_significant")])


@query(
    "lag_correlation",
    "AGG21 JN5",
    _LAG_SQL.format(L=36, m="") + f" select initialization, lag, n, {rnd('r')} as r, {rnd(p_value_sql('(r*sqrt((n - 2)/(1 - r*r)))', '(n - 2)'))} as p_value from c",
)
def lag_correlation(spark, sf):
    x, y = _urgent_high(spark, sf)
    out = L.cross_correlation(x, y, ["initialization"], 36)
    return out.select("initialization", "lag", "n", rounded("r").alias("r"), rounded("p_value").alias("p_value"))


@query(
    "lagged_pairs",
    "JN5",
    f"""with {X.ENCODINGS_SQL}
select a.initialization, a.month_idx, cast(l.lag as int) as lag, {rnd("a.value")} as x, {rnd("b.value")} as y from e a cross join (select unnest(range(-6, 7)) as lag) l
join e b on a.initialization = b.initialization and b.month_idx = a.month_idx + 2*l.lag where a.mode = '2-HIGH' and b.mode = '1-URGENT'""",
)
def lagged_pairs(spark, sf):
    x, y = _urgent_high(spark, sf)
    out = L.lagged_pairs(x, y, ["initialization"], 6, 2)
    return out.select("initialization", "month_idx", "lag", rounded("x").alias("x"), rounded("y").alias("y"))


@query(
    "benchmark_indices",
    "SEL8 WIN2 AGG1 SET1",
    f"""with {X.INDEX_SQL}, s as (select month_idx, case when count(*) over w = 24 then sum(value) over w end as value from x where mode = '5-LOW' window w as (order by month_idx range between 23 preceding and current row)),
u as (select 'Decadal' as mode, month_idx, avg(value) as value from x where mode in ('1-URGENT', '3-MEDIUM') group by 2 union all
      select 'Interannual', month_idx, value from x where mode = '2-HIGH' union all select 'Quasibiennial', month_idx, value from s where value is not null)
select mode, month_idx, {rnd("value - avg(value) over (partition by mode)")} as value from u""",
)
def benchmark_indices(spark, sf):
    x = X.index_series(spark, sf)
    parts = {
        "Decadal": Q.ensemble_mean(x.filter(F.col("mode").isin("1-URGENT", "3-MEDIUM")), ["month_idx"]),
        "Interannual": x.filter("mode = '2-HIGH'"),
        "Quasibiennial": Q.trailing_sum(x.filter("mode = '5-LOW'"), ["mode"], 24),
    }
    return Q.centred_indices(parts).withColumn("value", rounded("value"))


@query(
    "distribution_summary",
    "AGG32",
    f"""with {X.ENCODINGS_SQL} select mode, {rnd("avg(value)")} as mean, {rnd("min(value)")} as low, {rnd("max(value)")} as high, {rnd("quantile_cont(value, 0.5)")} as median from e group by 1""",
)
def distribution_summary(spark, sf):
    out = Q.distribution(X.encodings(spark, sf), ["mode"])
    return out.select("mode", *[rounded(c).alias(c) for c in ("mean", "low", "high", "median")])


@query(
    "symmetric_limits",
    "AGG37",
    f"""with {X.FIELD_SQL}, a as (select member, lat_i, value - avg(value) over (partition by member, lat_i, lon_i) as v from f)
select member, lat_i, {rnd("greatest(abs(min(v)), abs(max(v)))")} as "limit" from a group by 1, 2""",
)
def symmetric_limits(spark, sf):
    from pyspark.sql import Window

    centred = X.field(spark, sf).withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy(*A.CELL)))
    return Q.symmetric_range(centred, ["member", "lat_i"]).withColumn("limit", rounded("limit"))


_METRIC_SQL = """m as (select cast(l_linenumber as int) as fit, cast(year(l_shipdate)*12 + month(l_shipdate) - 1 as int) as epoch, avg(l_extendedprice)/997.0 as value from lineitem group by 1, 2)"""


def _metrics(spark, sf):
    from tidegrid.functions.calendar import month_index

    li = X.table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_linenumber").cast("int").alias("fit"), month_index(F.col("l_shipdate")).alias("epoch")).agg(
        (F.avg("l_extendedprice") / 997.0).alias("value")
    )


@query(
    "plateau_test",
    "AGG45",
    f"""with {_METRIC_SQL}, a as (select fit, epoch, avg(value) over (partition by fit order by epoch rows between current row and 9 following) as mm, row_number() over (partition by fit order by epoch desc) as k from m),
c as (select fit, regr_slope(mm, 20 - k) as slope, corr(mm, 20 - k) as r, cast(count(*) as bigint) as n from a where k between 11 and 20 group by 1)
select fit, n, {rnd("slope")} as slope, {rnd(p_value_sql("(r*sqrt((n - 2)/(1 - r*r)))", "(n - 2)"))} as p_value from c""",
)
def plateau_test(spark, sf):
    out = Q.plateau_test(_metrics(spark, sf), ["fit"], 10)
    return out.select("fit", "n", rounded("slope").alias("slope"), rounded("p_value").alias("p_value"))


@query(
    "best_epoch",
    "ORD3 ORD2",
    f"""with {_METRIC_SQL} select fit, arg_min(epoch, value) as epoch, {rnd("min(value)")} as value from m group by 1""",
)
def best_epoch(spark, sf):
    return Q.best_step(_metrics(spark, sf), ["fit"]).withColumn("value", rounded("value"))
