"""Queries that run whole workflows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.functions.coords import shift_longitude
from tidegrid.operators import anomaly as A
from tidegrid.operators import composite as P
from tidegrid.operators import regrid as I
from tidegrid.operators import select as S
from tidegrid.operators import series as Q
from tidegrid.plans import fixtures as X
from tidegrid.plans.basin import build_basin
from tidegrid.plans.experiment import FIT, decodings_schema, fold_anomalies, run_experiment, run_fits, write_experiment
from tidegrid.plans.queries_anomaly import _POLY2, HELD_OUT
from tidegrid.plans.queries_composite import TRIO
from tidegrid.plans.queries_grid import _WEIGHTS, LAT, LON, target_nodes
from tidegrid.plans.queries_select import scratch
from tidegrid.plans.queries_series import _FOLDS
from tidegrid.plans.registry import query, rnd, rounded
from tidegrid.plans.report import lag_report, panel_report, phase_report
from tidegrid.session import cut_lineage
from tidegrid.sources import commits

BAD_MONTH = 1996 * 12 + 1


@query(
    "basin_dataset",
    "PRJ1 PRJ2 PRJ5 PRJ14 PRJ22 INT2 INT3 JN6",
    f"""with {_WEIGHTS}, r as (select member, month_idx, dst_lat_i as lat_i, dst_lon_i as lon_i, case when count(case when n <> 2 then value end) = 4 then sum(w*value) end as value
from f join w on f.lat_i = w.lat_i and f.lon_i = w.lon_i where month_idx <> {BAD_MONTH} group by 1, 2, 3, 4), b as (select * from r where (lat_i + lon_i) % 4 <> 0)
select member, month_idx, lat_i, lon_i, 10e0*lat_i - 40 as lat, 30e0*lon_i + 10 - 180 as lon, {rnd("value")} as value from b
where lat_i in (select lat_i from b where value is not null) and lon_i in (select lon_i from b where value is not null)""",
)
def basin_dataset(spark, sf):
    """Observations counted twice are marked missing with the sentinel, as a source file would."""
    field = X.field(spark, sf)
    raw = field.select("member", "month_idx", "lat_i", "lon_i", F.when(F.col("n") == 2, -999.0).otherwise(F.col("value")).alias("__xarray_dataarray_variable__"), F.lit(1).alias("expver"))
    nodes = target_nodes(field)
    mask = nodes.withColumnsRenamed({"dst_lat_i": "lat_i", "dst_lon_i": "lon_i"}).filter((F.col("lat_i") + F.col("lon_i")) % 4 != 0)
    out = build_basin(raw, I.bilinear_weights(nodes, LAT, LON), mask, ["member", "month_idx"], shift_longitude(F.col("lon"), -180.0), (BAD_MONTH,))
    return out.select("member", "month_idx", "lat_i", "lon_i", "lat", "lon", rounded("value").alias("value"))


_FOLD_ANOMALIES = f"""with {X.FIELD_SQL}, pre as (select * from f where month_idx < {HELD_OUT}), {_FOLDS.format(src="pre")}, sp as (select cast(unnest(range(0, 5)) as int) as split),
tr as (select split, pre.*, fold from pre join ax on pre.month_idx = ax.month_idx cross join sp where split <> fold),
w as (select split, month_idx, sum(cos(radians(10.0*lat_i - 45.0))*value)/sum(cos(radians(10.0*lat_i - 45.0))) as value from tr group by 1, 2), {_POLY2.format(k="split", src="w")},
ct as (select tr.split, member, lat_i, lon_i, month_idx % 12 as m, avg(value - (b0 + b1*(month_idx - c0)/h0 + b2*((month_idx - c0)/h0)*((month_idx - c0)/h0))) as clim from tr join k2 on tr.split = k2.split group by 1, 2, 3, 4, 5),
al as (select split, member, lat_i, lon_i, f.month_idx, value, case when f.month_idx >= {HELD_OUT} then 'test' when split = fold then 'val' else 'train' end as kind from f left join ax on f.month_idx = ax.month_idx cross join sp)
select al.split, kind, al.member, al.lat_i, al.lon_i, al.month_idx, {rnd("value - (b0 + b1*(month_idx - c0)/h0 + b2*((month_idx - c0)/h0)*((month_idx - c0)/h0)) - clim", 5)} as value
from al join k2 on al.split = k2.split left join ct on ct.split = al.split and ct.member = al.member and ct.lat_i = al.lat_i and ct.lon_i = al.lon_i and ct.m = al.month_idx % 12"""


@query("fold_anomalies", "AGG6 AGG11 WIN8 SET2 WIN9", _FOLD_ANOMALIES)
def fold_anomalies_query(spark, sf):
    out = fold_anomalies(X.field(spark, sf), HELD_OUT, A.CELL)
    return out.select("split", "kind", *A.CELL, "month_idx", rounded("value", 5).alias("value"))


@query("recursive_experiment", "MOD7 MOD8 MOD9 AGG6 AGG39 AGG43 AGG44 AGG16", None)
def recursive_experiment(spark, sf):
    # the basin dataset is a stored table: the experiment passes over it several times
    field = cut_lineage(S.complete_cells(X.field(spark, sf), A.CELL))
    nodes = field.select(*A.CELL, "lat", "lon").distinct()
    out = run_experiment(field, HELD_OUT, A.CELL, nodes, {"lat": (-15, 15), "lon": (60, 180)}, steps=3, k=3)
    return out.withColumn("value", rounded("value", 4))


BOX = {"lat": (-15, 15), "lon": (60, 180)}
GRID = ["lat_i", "lon_i"]
N_INIT, N_STEPS = 2, 2


def _observed(spark, sf):
    """Gap-free cells of the mean over all members, the members themselves, and the nodes."""
    members = cut_lineage(X.field(spark, sf))
    mean = members.groupBy("month_idx", *GRID, "lat", "lon").agg(F.avg("value").alias("value"))
    field = cut_lineage(S.complete_cells(mean, GRID))
    return field, members.select("member", "month_idx", *GRID, "lat", "value"), field.select(*GRID, "lat", "lon").distinct()


def _fits(spark):
    """Fits of two initializations and five splits."""
    at = F.col("id").cast("int")
    return spark.range(N_INIT * 5).select(F.floor(at / 5).cast("int").alias("initialization"), (at % 5).alias("split"))


def _run(spark, sf, members=True):
    field, others, nodes = _observed(spark, sf)
    return lambda fits: run_fits(field, HELD_OUT, GRID, nodes, BOX, fits, others if members else None, steps=N_STEPS, k=2)


# rows of the experiment that follow from the tables alone: which periods, members and months every fit encodes
_EXPERIMENT_ROWS = f"""with {X.FIELD_SQL}, ob as (select month_idx, lat_i, lon_i, avg(value) as value from f group by 1, 2, 3),
cc as (select lat_i, lon_i from ob group by 1, 2 having count(value) = (select count(distinct month_idx) from ob)),
pre as (select distinct month_idx from ob where month_idx < {HELD_OUT}), {_FOLDS.format(src="pre")},
fi as (select cast(i as int) as initialization, cast(s as int) as split, cast(r as int) as recursion from (select unnest(range(0, {N_INIT})) as i) cross join (select unnest(range(0, 5)) as s) cross join (select unnest(range(0, {N_STEPS})) as r)),
mo as (select distinct month_idx from ob), kd as (select fi.*, case when mo.month_idx >= {HELD_OUT} then 'test' when split = fold then 'val' else 'train' end as kind, cast(null as int) as member, mo.month_idx, true as there
       from fi cross join mo left join ax on mo.month_idx = ax.month_idx),
mm as (select member, month_idx, count(cc.lat_i) = (select count(*) from cc) as there from f left join cc on f.lat_i = cc.lat_i and f.lon_i = cc.lon_i group by 1, 2),
al as (select * from (select * from kd union all select fi.*, 'member', member, month_idx, there from fi cross join mm) q where exists (select 1 from cc))"""


@query(
    "experiment_members",
    "MOD7 MOD8 MOD9 AGG6 AGG39 AGG43 AGG44 SET2",
    _EXPERIMENT_ROWS
    + """ select initialization, split, recursion, kind, member, u.mode, cast(count(case when there then 1 end) as bigint) as n, cast(count(*) as bigint) as months,
min(month_idx) as first_month, max(month_idx) as last_month, case when initialization = 0 and kind = 'train' then true end as centred, case when initialization = 0 and kind = 'train' then true end as uncorrelated
from al cross join (select unnest(['Decadal', 'Interannual']) as mode) u group by 1, 2, 3, 4, 5, 6""",
)
def experiment_members(spark, sf):
    """Which months every fit encodes, and what must hold for components whatever solver found them.

    On the sample that a fit has learned (initialization 0 has each month once) the series of the modes have mean zero and
    don't correlate.
    """
    rows = cut_lineage(_run(spark, sf)(_fits(spark)).encodings)
    keys = [*FIT, "recursion", "kind", "member"]
    learned = rows.filter("initialization = 0 and kind = 'train'")
    wide = learned.groupBy(*keys, "month_idx").agg(*[F.max(F.when(F.col("mode") == m, F.col("value"))).alias(f"_{m}") for m in ("Decadal", "Interannual")])
    r = wide.groupBy(*FIT, "recursion", "kind").agg((F.abs(F.corr("_Decadal", "_Interannual")) < 1e-6).alias("uncorrelated"))
    got = rows.groupBy(*keys, "mode").agg(
        F.count("value").alias("n"), F.count("*").alias("months"), F.min("month_idx").alias("first_month"), F.max("month_idx").alias("last_month"),
        F.when((F.first("initialization") == 0) & (F.first("kind") == "train"), F.abs(F.avg("value")) < 1e-6 * F.stddev_pop("value")).alias("centred"),
    )
    return got.join(r, [*FIT, "recursion", "kind"], "left")


@query(
    "experiment_outputs",
    "MOD4 MOD7 MOD8 SNK1 SNK2 SNK3 SRC5",
    _EXPERIMENT_ROWS
    + """, w as (select *, case when kind = 'val' then ['', 'Decadal', 'Interannual'] else [''] end as ws from al), v as (select * exclude (ws), unnest(ws) as without from w)
select initialization, split, recursion, kind, nullif(without, '') as without, cast(count(*) as bigint) * (select count(*) from cc) as n, true as consistent
from v where kind <> 'member' group by 1, 2, 3, 4, 5""",
)
def experiment_outputs(spark, sf):
    """Decodings of all periods, and of the held-out fold without each mode, read back from the committed fits.

    The first run does the first split only and the second one the rest. Consistent: the parts that the modes take away add up to the
    decoding, up to the cell's mean, which does not depend on the month.
    """
    path = scratch(spark, "experiment")
    run, fits = _run(spark, sf, members=False), _fits(spark)
    write_experiment(fits.filter("split = 0"), run, path, at_once=N_INIT)
    write_experiment(fits, run, path, at_once=N_INIT * 5)
    rows = cut_lineage(commits.read_done(spark, f"{path}/decodings", FIT, decodings_schema(X.field(spark, sf), GRID)))
    cell = [*FIT, "recursion", "kind", *GRID]
    parts = rows.groupBy(*cell, "month_idx").agg(F.max(F.when(F.col("without").isNull(), F.col("value"))).alias("all"), F.sum(F.when(F.col("without").isNotNull(), F.col("value"))).alias("others"))
    # with two modes: others = 2 * all - (all - mean), so others - all is the mean of the cell
    steady = parts.filter("kind = 'val'").groupBy(*cell).agg((F.max(F.col("others") - F.col("all")) - F.min(F.col("others") - F.col("all")) < 1e-6).alias("ok"))
    good = steady.groupBy(*FIT, "recursion").agg(F.every("ok").alias("consistent"))
    got = rows.groupBy(*FIT, "recursion", "kind", "without").agg(F.count("value").alias("n"))
    return got.join(good, [*FIT, "recursion"])


def _indices(spark, sf):
    x = X.index_series(spark, sf)
    return Q.centred_indices({m: x.filter(F.col("mode") == m) for m in TRIO})


@query("phase_report", "AGG33 AGG34 AGG35 AGG13 SEL1 SEL2", None)
def phase_report_query(spark, sf):
    _, out = phase_report(X.field(spark, sf), _indices(spark, sf), TRIO, ["member"], A.CELL, 1000, 0.05)
    return out.select("mode", *A.CELL, rounded("linear", 5).alias("linear"), rounded("nonlinear", 5).alias("nonlinear"), "significant_any", "significant_both")


@query("nine_panel_report", "SEL4 SEL9 AGG13 AGG33 PRJ19", None)
def nine_panel_report(spark, sf):
    out = panel_report(X.field(spark, sf), _indices(spark, sf), TRIO[0], TRIO[1], P.TERCILE_PANELS, ["member"], A.CELL)
    masked = S.where("mean", F.col("significant"))
    return out.select("panel", *A.CELL, "n", rounded(masked, 5).alias("mean"), rounded("share").alias("share"))


@query("filtered_lag_report", "AGG20 FIL2 PRJ20 AGG14", None)
def filtered_lag_report(spark, sf):
    """Index series with a complete time axis are smoothed before they are correlated."""
    x = X.index_series(spark, sf)
    out = lag_report(x.filter(F.col("mode") == TRIO[1]).drop("mode").withColumn("pair", F.lit(1)), x.filter(F.col("mode") == TRIO[0]).drop("mode").withColumn("pair", F.lit(1)), ["pair"], 12, 36)
    return out.select("month", "lag", "n", *[rounded(c, 5).alias(c) for c in ("r", "p_value", "r_significant")])
