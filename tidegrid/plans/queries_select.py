"""Queries on sources, sinks, slices, masks and coordinates."""

from __future__ import annotations

import uuid

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidegrid.functions import calendar as C
from tidegrid.functions import coords as G
from tidegrid.functions.quantiles import counted_quantiles
from tidegrid.operators import anomaly as A
from tidegrid.operators import select as S
from tidegrid.plans import fixtures as X
from tidegrid.plans.registry import query, rnd, rounded
from tidegrid.schema import cell_id, missing_to_null, normalize_columns
from tidegrid.session import cut_lineage, run_folder
from tidegrid.sources import commits as M
from tidegrid.sources import readers as R
from tidegrid.sources import writers as W


def scratch(spark, name: str) -> str:
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


# -- sources ---------------------------------------------------------------------------------


@query(
    "period_tag",
    "SRC4",
    "select 'lineitem' as period, cast(count(*) as bigint) as n, max(cast(year(l_shipdate) as int)) as last_year from lineitem",
)
def period_tag(spark, sf):
    tagged = R.with_period_tag(X.table(spark, sf, "lineitem"))
    return tagged.groupBy("period").agg(F.count("*").alias("n"), F.max(F.year("l_shipdate")).alias("last_year"))


@query(
    "stream_routing",
    "SRC3",
    """with t as (select o_orderdate as ts from orders union all select ts from events)
select 'monthly_' || lpad(cast(year(ts) as varchar), 4, '0') || lpad(cast(month(ts) as varchar), 2, '0') || '_' ||
       case when year(ts) >= 2015 then 'OPER' else 'CONS' end as file, cast(count(*) as bigint) as n from t group by 1""",
)
def stream_routing(spark, sf):
    times = X.table(spark, sf, "orders").select(F.col("o_orderdate").alias("ts")).unionByName(X.table(spark, sf, "events").select("ts"))
    name = R.manifest_name("monthly_", F.year("ts"), F.month("ts"))
    return times.groupBy(name.alias("file")).agg(F.count("*").alias("n"))


@query(
    "encodings_roundtrip",
    "SRC2 SRC5 SNK1 ORD1",
    f"""with {X.ENCODINGS_SQL}
select initialization, cast(month_idx % 5 as int) as split, mode, month_idx, {rnd("value")} as value from e""",
)
def encodings_roundtrip(spark, sf):
    path = scratch(spark, "encodings")
    rows = X.encodings(spark, sf).withColumns({"split": (F.col("month_idx") % 5).cast("int"), "kind": F.lit("val")})
    W.write_table(rows, path, ["initialization", "split"])
    back = R.read_encodings(spark, path, "val")
    return back.select("initialization", "split", "mode", "month_idx", rounded("value").alias("value")).orderBy("month_idx")


@query(
    "member_outputs",
    "SRC6 AGG1",
    f"""with {X.ENCODINGS_SQL}
select initialization as member, mode, {rnd("avg(value)")} as mean, cast(count(*) as bigint) as n from e group by 1, 2""",
)
def member_outputs(spark, sf):
    path = scratch(spark, "members")
    rows = X.encodings(spark, sf).withColumnRenamed("initialization", "member").withColumn("kind", F.lit("model"))
    W.write_table(rows, path, ["member"])
    back = R.read_encodings(spark, path, "model")
    return back.groupBy("member", "mode").agg(rounded(F.avg("value")).alias("mean"), F.count("*").alias("n"))


@query(
    "index_text",
    "SRC7 SRC9 PRJ25 SET1",
    f"""with {X.INDEX_SQL}, yr as (select distinct mode, month_idx // 12 as y from x),
kept as (select mode, y, row_number() over (partition by mode order by y) as k from yr),
sp as (select mode, y, cast(u.m as int) as m from kept cross join (select unnest(range(0, 12)) as m) u where k <= 5)
select sp.mode as dataset, cast(sp.y*12 + sp.m as int) as month_idx, {rnd("x.value", 4)} as value
from sp left join x on x.mode = sp.mode and x.month_idx = sp.y*12 + sp.m""",
)
def index_text(spark, sf):
    """Series are printed as index text (year and 12 values, -999 where missing) and read back."""
    x = X.index_series(spark, sf).withColumn("year", C.year_of(F.col("month_idx")))
    values = F.map_from_entries(F.collect_list(F.struct(F.col("month_idx") % 12, F.col("value"))))
    cells = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda m: F.coalesce(F.col("v")[m].cast("string"), F.lit("-999")))
    lines = x.groupBy("mode", "year").agg(values.alias("v")).select(
        F.col("mode").alias("dataset"), F.concat_ws("  ", F.col("year").cast("string"), F.array_join(cells, "  ")).alias("value")
    )
    return R.parse_index_lines(lines, n_years=5, by=("dataset",)).withColumn("value", rounded("value", 4))


@query(
    "index_ready",
    "SRC8 JN4",
    f"""with {X.INDEX_SQL}
select month_idx, {rnd("value")} as value from x where mode = '2-HIGH' and month_idx in (select month_idx from x where mode = '1-URGENT' and value > 2.5)""",
)
def index_ready(spark, sf):
    path = scratch(spark, "series")
    W.write_table(X.index_series(spark, sf).withColumnRenamed("mode", "series_id"), path, ["series_id"])
    high = R.read_series(spark, path, "2-HIGH")
    at = R.read_series(spark, path, "1-URGENT").filter(F.col("value") > 2.5)
    return S.at_months(high, at).select("month_idx", rounded("value").alias("value"))


@query(
    "source_merge",
    "SRC9 SET1",
    f"""with {X.INDEX_SQL}, {X.FIELD_SQL}
select 'orders' as dataset, month_idx, {rnd("avg(value)")} as value from x group by 2
union all select 'lineitem', month_idx, {rnd("avg(value)")} from f group by 2""",
)
def source_merge(spark, sf):
    def mean(df):
        return df.groupBy("month_idx").agg(rounded(F.avg("value")).alias("value"))

    return R.stack_sources({"orders": mean(X.index_series(spark, sf)), "lineitem": mean(X.field(spark, sf))})


@query(
    "write_missing_only",
    "SNK2 JN10",
    f"""with {X.ENCODINGS_SQL}
select initialization, cast(count(*) as bigint) as n, {rnd("sum(case when initialization < 2 then value + 1 else value end)")} as total from e group by 1""",
)
def write_missing_only(spark, sf):
    """The first two initializations exist already, with other values, and are kept."""
    path = scratch(spark, "skip")
    enc = X.encodings(spark, sf).select("initialization", "mode", "month_idx", "value")
    W.write_table(enc.filter("initialization < 2").withColumn("value", F.col("value") + 1), path, ["initialization"])
    W.write_missing(enc, path, ["initialization"])
    return spark.read.parquet(path).groupBy("initialization").agg(F.count("*").alias("n"), rounded(F.sum("value")).alias("total"))


@query(
    "resume_after_failure",
    "SNK1 SNK2 SNK3",
    f"""with {X.ENCODINGS_SQL}
select initialization, cast(count(*) as bigint) as n, {rnd("sum(case when initialization < 2 then value + 1 else value end)")} as total from e group by 1""",
)
def resume_after_failure(spark, sf):
    """Two initializations a job, more after each that succeeds; the second job breaks at its second one, and the next run completes what is not committed.

    The first run adds one to its values, so the sums show whose rows are there.
    """
    path = scratch(spark, "resume")
    enc = cut_lineage(X.encodings(spark, sf).select("initialization", "mode", "month_idx", "value"))
    work = enc.select("initialization").distinct()

    def breaking(keys):
        stop = F.when(F.col("initialization") < 3, F.col("value") + 1).otherwise(F.raise_error(F.lit("the run breaks here")).cast("double"))
        return enc.join(keys, "initialization").withColumn("value", stop)

    try:
        M.run_missing(work, breaking, path, ["initialization"], at_once=2)
    except PySparkException as err:
        if "the run breaks here" not in str(err):
            raise
    M.run_missing(work, lambda keys: enc.join(keys, "initialization"), path, ["initialization"], at_once=2)
    return M.read_done(spark, path, ["initialization"]).groupBy("initialization").agg(F.count("*").alias("n"), rounded(F.sum("value")).alias("total"))


@query(
    "resume_pending",
    "SNK3 JN10 SET4",
    f"""with {X.ENCODINGS_SQL}, pl as (select distinct initialization, cast(month_idx // 12 as int) as year from e)
select initialization, year from pl where not (initialization % 2 = 0 and year < 1998)""",
)
def resume_pending(spark, sf):
    plan = X.encodings(spark, sf).select("initialization", C.year_of(F.col("month_idx")).alias("year")).distinct()
    done = plan.filter("initialization % 2 = 0 and year < 1998")
    return W.pending(plan, done, ["initialization", "year"])


# -- projections -----------------------------------------------------------------------------


@query(
    "normalized_names",
    "PRJ1 PRJ2",
    f"""with {X.FIELD_SQL} select member, month_idx as time, 10e0*lat_i - 45 as lat, 30e0*lon_i as lon, {rnd("value")} as value from f""",
)
def normalized_names(spark, sf):
    foreign = X.field(spark, sf).select(
        "member",
        F.col("month_idx").alias("time_counter"),
        F.col("lat").alias("latitude"),
        F.col("lon").alias("ULONG"),
        F.col("value").alias("__xarray_dataarray_variable__"),
        F.lit(0).alias("number"),
        F.lit("x").alias("expver"),
    )
    return normalize_columns(foreign).withColumn("value", rounded("value"))


@query(
    "longitude_conventions",
    "PRJ3 PRJ4 PRJ5 PRJ6",
    f"""with {X.FIELD_SQL}, b as (select member, 30e0*lon_i as lon, sum(n) as n from f group by 1, 2),
s as (select *, case when lon >= 180 then lon - 360 else lon end as wrapped from b)
select member, lon, wrapped, case when lon > 180 then lon - 360 else lon end as wrapped_strict,
       case when wrapped <= 0 then wrapped + 180 else wrapped - 180 end as recentred, lon - 180 as shifted, cast(n as bigint) as n from s""",
)
def longitude_conventions(spark, sf):
    b = X.field(spark, sf).groupBy("member", "lon").agg(F.sum("n").alias("n"))
    b = b.withColumns(
        {
            "wrapped": G.wrap_longitude(F.col("lon")),
            "wrapped_strict": G.wrap_longitude(F.col("lon"), strict=True),
            "shifted": G.shift_longitude(F.col("lon")),
        }
    )
    return b.withColumn("recentred", G.recentre_longitude(F.col("wrapped"))).orderBy("wrapped")


@query(
    "integer_dates",
    "PRJ7 PRJ8",
    """with d as (select o_orderkey, year(o_orderdate) as y, month(o_orderdate) as m, day(o_orderdate) as dd from orders)
select make_date(y, m, dd) as parsed, case when not (m = 2 and dd = 29) or ((1700 + y % 100) % 4 = 0 and y % 100 <> 0) then make_date(1700 + y % 100, m, least(dd, case when m = 2 and not ((1700 + y % 100) % 4 = 0 and y % 100 <> 0) then 28 else 31 end)) end as folded,
cast(count(*) as bigint) as n from d group by 1, 2""",
)
def integer_dates(spark, sf):
    o = X.table(spark, sf, "orders").select(
        F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.dayofmonth("o_orderdate").alias("d")
    )
    # a leap day that the folded year does not have is NULL there
    number = F.col("y") * 10000 + F.col("m") * 100 + F.col("d")
    return o.groupBy(
        C.parse_yyyymmdd(number).alias("parsed"), C.rebuild_date(F.col("y"), F.col("m"), F.col("d"), 1700).alias("folded")
    ).agg(F.count("*").alias("n"))


@query(
    "time_slice",
    "PRJ9",
    f"""with {X.FIELD_SQL} select member, lat_i, lon_i, month_idx, {rnd("value")} as value from f where month_idx between {1996 * 12} and {1997 * 12 + 5}""",
)
def time_slice(spark, sf):
    return S.time_range(X.field(spark, sf), 1996 * 12, 1997 * 12 + 5).select(*A.CELL, "month_idx", rounded("value").alias("value"))


@query(
    "stride_box",
    "PRJ10 PRJ11",
    f"""with {X.FIELD_SQL} select member, lat_i, lon_i, {rnd("avg(value)")} as value from f
where 10.0*lat_i - 45.0 between -35 and 35 and lat_i % 3 = 0 and lon_i % 3 = 0 group by 1, 2, 3""",
)
def stride_box(spark, sf):
    kept = S.stride(S.box(X.field(spark, sf), lat=(-35, 35)), 3)
    return kept.groupBy(*A.CELL).agg(rounded(F.avg("value")).alias("value"))


@query(
    "depth_layer",
    "PRJ10 PRJ12 AGG36",
    f"""select cast(l_linenumber as int) as level, cast(year(l_shipdate)*12 + month(l_shipdate) - 1 as int) as month_idx,
{rnd("avg(case when l_quantity between 10 and 30 then l_extendedprice/997.0 end)")} as layer_mean from lineitem where l_linenumber in (1, 4) group by 1, 2""",
)
def depth_layer(spark, sf):
    """The line number stands for the model level, the quantity for the depth."""
    li = X.table(spark, sf, "lineitem").select(
        F.col("l_linenumber").cast("int").alias("level"),
        C.month_index(F.col("l_shipdate")).alias("month_idx"),
        F.col("l_quantity").alias("depth"),
        (F.col("l_extendedprice") / 997.0).alias("value"),
    )
    inside = S.where("value", F.col("depth").between(10, 30))
    return S.levels(li, [1, 4]).groupBy("level", "month_idx").agg(rounded(F.avg(inside)).alias("layer_mean"))


@query(
    "mode_selection",
    "PRJ13 SEL7",
    f"""with {X.ENCODINGS_SQL} select mode, month_idx, {rnd("value")} as value from e where (initialization = 2 and mode = '1-URGENT') or (initialization = 0 and mode in ('2-HIGH', '5-LOW'))""",
)
def mode_selection(spark, sf):
    e = X.encodings(spark, sf).drop("n")
    one, rest = S.modes(e, ["1-URGENT"], initialization=2), S.modes(e, ["2-HIGH", "5-LOW"], initialization=0)
    return one.unionByName(rest).withColumn("value", rounded("value"))


@query(
    "basin_mask",
    "PRJ14 JN8",
    f"""with {X.FIELD_SQL}, {X.MASK_SQL} select member, lat_i, lon_i, {rnd("avg(value)")} as value, cast(count(*) as bigint) as n
from f where exists (select 1 from m where m.lat_i = f.lat_i and m.lon_i = f.lon_i) group by 1, 2, 3""",
)
def basin_mask(spark, sf):
    field = X.field(spark, sf)
    kept = S.drop_empty_axes(S.mask_cells(field, X.mask(field)))
    return kept.groupBy(*A.CELL).agg(rounded(F.avg("value")).alias("value"), F.count("*").alias("n"))


@query(
    "mask_from_data",
    "PRJ15",
    f"""with {X.ENSEMBLE_SQL}, b as (select member, lat_i, lon_i, avg(case when n > 3 then value end) as v from g group by 1, 2, 3)
select member, lat_i, lon_i, case when v <> 0 then 1.0::double end as mask from b""",
)
def mask_from_data(spark, sf):
    sparse = X.ensemble_field(spark, sf).withColumn("value", S.where("value", F.col("n") > 3))
    return S.mask_from_data(sparse, A.CELL)


@query(
    "complete_features",
    "PRJ16 PRJ17",
    f"""with {X.FIELD_SQL}, t as (select count(distinct month_idx) as k from f), ok as (select member, lat_i, lon_i from f group by 1, 2, 3 having count(value) = (select k from t))
select f.member, f.lat_i, f.lon_i, f.lat_i*12 + f.lon_i as feature, f.month_idx, {rnd("value")} as value
from f join ok on f.member = ok.member and f.lat_i = ok.lat_i and f.lon_i = ok.lon_i""",
)
def complete_features(spark, sf):
    kept = S.complete_cells(X.field(spark, sf), A.CELL).withColumn("feature", cell_id(X.N_LON))
    return kept.select(*A.CELL, "feature", "month_idx", rounded("value").alias("value"))


@query(
    "unstacked_features",
    "PRJ17",
    f"""with {X.FIELD_SQL}, t as (select count(distinct month_idx) as k from f), ok as (select member, lat_i, lon_i from f group by 1, 2, 3 having count(value) = (select k from t))
select f.member, f.lat_i, f.lon_i, f.month_idx, {rnd("value")} as value from f join ok on f.member = ok.member and f.lat_i = ok.lat_i and f.lon_i = ok.lon_i""",
)
def unstacked_features(spark, sf):
    """Features without coordinates, put back on the grid through the table of cells."""
    field = X.field(spark, sf)
    stacked = S.complete_cells(field, A.CELL).select("member", cell_id(X.N_LON).alias("feature"), "month_idx", rounded("value").alias("value"))
    cells = field.select(cell_id(X.N_LON).alias("feature"), "lat_i", "lon_i").distinct()
    return S.unstack(stacked, cells).select(*A.CELL, "month_idx", "value")


@query(
    "stored_field",
    "SRC1",
    f"""with {X.FIELD_SQL} select member, lat_i, lon_i, month_idx, {rnd("value")} as value from f""",
)
def stored_field(spark, sf):
    """One variable of a stored table with several: the others are pruned as partitions."""
    field = X.field(spark, sf)
    count = field.withColumn("value", F.col("n").cast("double"))
    both = R.stack_sources({"sst": field, "count": count}, "variable").select("variable", *A.CELL, "month_idx", "value")
    out = scratch(spark, "field")
    W.write_table(both, out, ["variable"])
    return R.read_field(spark, out, variable="sst").select(*A.CELL, "month_idx", rounded("value").alias("value"))


@query(
    "feature_matrix",
    "PRJ18",
    f"""with {X.FIELD_SQL}, r as (select member, lat_i*12 + lon_i as feature, month_idx, value from f)
select member, feature, cast(count(*) as int) as n_times, {rnd("sum(value * month_idx)/1000.0")} as checksum, min(month_idx) as first_month from r group by 1, 2""",
)
def feature_matrix(spark, sf):
    """One array per cell ordered by month; the checksum ties every value to its month."""
    packed = (
        X.field(spark, sf)
        .groupBy("member", cell_id(X.N_LON).alias("feature"))
        .agg(F.sort_array(F.collect_list(F.struct("month_idx", "value"))).alias("s"))
    )
    check = F.aggregate("s", F.lit(0.0), lambda acc, p: acc + p["value"] * p["month_idx"]) / 1000.0
    return packed.select(
        "member", "feature", F.size("s").alias("n_times"), rounded(check).alias("checksum"), F.col("s")[0]["month_idx"].alias("first_month")
    )


@query(
    "value_masking",
    "PRJ19 PRJ20 PRJ21 PRJ25",
    f"""with {X.FIELD_SQL} select member, lat_i, lon_i, month_idx, case when n > 3 then {rnd("value")} end as masked,
{rnd("value*4.26")} as transport, {rnd("value*(4.26/111000^2*86400*365)*1e4")} as divergence, case when n = 5 then null else n end as cleaned from f""",
)
def value_masking(spark, sf):
    f = X.field(spark, sf)
    return f.select(
        *A.CELL,
        "month_idx",
        rounded(S.where("value", F.col("n") > 3)).alias("masked"),
        rounded(G.scale(F.col("value"), "transport")).alias("transport"),
        rounded(G.scale(F.col("value"), "transport_divergence_m_per_year") * 1e4).alias("divergence"),
        missing_to_null(F.col("n"), 5.0).cast("long").alias("cleaned"),
    )


@query(
    "month_spine",
    "PRJ24 PRJ22 JN10",
    """with b as (select date_trunc('month', min(o_orderdate)) as a, date_trunc('month', max(o_orderdate)) as z from orders),
s as (select cast(unnest(generate_series(a, z, interval 1 month)) as date) as date from b),
c as (select cast(year(o_orderdate)*12 + month(o_orderdate) - 1 as int) as month_idx, count(*) as n from orders group by 1)
select date, cast(year(date)*12 + month(date) - 1 as int) as month_idx, cast(coalesce(n, 0) as bigint) as n
from s left join c on c.month_idx = year(date)*12 + month(date) - 1 where date <> date '1996-02-01'""",
)
def month_spine(spark, sf):
    o = X.table(spark, sf, "orders").select(F.col("o_orderdate").alias("ts"))
    first, last = F.trunc(F.min("ts"), "month"), F.trunc(F.max("ts"), "month")
    spine = o.agg(F.explode(F.sequence(first, last, F.expr("interval 1 month"))).alias("date"))
    spine = spine.filter(F.col("date") != F.to_date(F.lit("1996-02-01"))).withColumn("month_idx", C.month_index(F.col("date")))
    counts = o.groupBy(C.month_index(F.col("ts")).alias("month_idx")).agg(F.count("*").alias("n"))
    return spine.join(counts, "month_idx", "left").select("date", "month_idx", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "first_years",
    "ORD4 ORD1 SET4",
    f"""with {X.INDEX_SQL}, y as (select distinct month_idx // 12 as year from x order by 1 limit 4)
select mode, month_idx, {rnd("value")} as value from x where month_idx // 12 in (select year from y)""",
)
def first_years(spark, sf):
    x = X.index_series(spark, sf)
    years = x.select(C.year_of(F.col("month_idx")).alias("year")).distinct().orderBy("year").limit(4)
    return x.withColumn("year", C.year_of(F.col("month_idx"))).join(years, "year", "left_semi").select("mode", "month_idx", rounded("value").alias("value"))


@query(
    "whole_table_quantiles",
    "AGG15 AGG38",
    f"""select cast(l_linenumber as int) as level, p.p as prob, {rnd("case p.p when 0.1 then quantile_cont(l_extendedprice/997.0, 0.1) when 0.5 then quantile_cont(l_extendedprice/997.0, 0.5) else quantile_cont(l_extendedprice/997.0, 0.975) end", 4)} as quantile
from lineitem cross join (select unnest([0.1::double, 0.5::double, 0.975::double]) as p) p group by 1, 2""",
)
def whole_table_quantiles(spark, sf):
    li = X.table(spark, sf, "lineitem").select(F.col("l_linenumber").cast("int").alias("level"), (F.col("l_extendedprice") / 997.0).alias("value"))
    return counted_quantiles(li, ["level"], "value", [0.1, 0.5, 0.975]).withColumn("quantile", rounded("quantile", 4))
