"""Queries on series cut into blocks: windows with halo rows, carried sums, split transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.operators import lagcorr as L
from tidegrid.operators import long_series as B
from tidegrid.plans import fixtures as X
from tidegrid.plans.queries_series import p_value_sql
from tidegrid.plans.queries_spectral import _DFT, SERIES
from tidegrid.plans.registry import query, rnd, rounded

# events per type and minute of the month: a few series that hold all rows of the table
MINUTES_SQL = """
mi as (select event_type as mode, cast((day(ts)-1)*1440 + hour(ts)*60 + minute(ts) as int) as t, cast(count(*) as double) as n, avg(value)/9.97 as value from events group by 1, 2)"""


def minutes(spark, sf):
    t = ((F.dayofmonth("ts") - 1) * 1440 + F.hour("ts") * 60 + F.minute("ts")).cast("int")
    rows = X.table(spark, sf, "events").groupBy(F.col("event_type").alias("mode"), t.alias("t"))
    return rows.agg(F.count("*").cast("double").alias("n"), (F.avg("value") / 9.97).alias("value"))


@query(
    "rolling_blocks",
    "WIN1 WIN2",
    f"""with {X.HOURLY_SQL}, s as (select member, mode, t, case when count(*) over a = 25 then {rnd("avg(value) over a")} end as centred, case when count(*) over b = 24 then {rnd("sum(value) over b")} end as trailing from h
window a as (partition by member, mode order by t range between 12 preceding and 12 following), b as (partition by member, mode order by t range between 23 preceding and current row)) select * from s""",
)
def rolling_blocks(spark, sf):
    """A day around each hour and the day before it, in blocks of a hundred hours."""
    h = X.hourly(spark, sf).withColumn("trailing", F.col("value"))
    centred = B.centred_mean_blocks(h, SERIES, 25, "t", "value", 100)
    both = B.trailing_sum_blocks(centred, SERIES, 24, "t", "trailing", 100)
    return both.select(*SERIES, "t", rounded("value").alias("centred"), rounded("trailing").alias("trailing"))


@query(
    "cumulative_blocks",
    "WIN7",
    f"""with {MINUTES_SQL} select mode, t, {rnd("sum(n) over (partition by mode order by t rows between unbounded preceding and current row)")} as cumulative from mi""",
)
def cumulative_blocks(spark, sf):
    """Events of a type up to each minute, in blocks of half a day."""
    out = B.cumulative_sum_blocks(minutes(spark, sf), ["mode"], "t", "n", size=720)
    return out.select("mode", "t", rounded("cumulative").alias("cumulative"))


@query(
    "fill_gaps_blocks",
    "WIN4",
    f"""with {MINUTES_SQL}, s as (select mode, t, case when t % 7 < 3 then value end as value from mi),
b as (select *, last_value(case when value is not null then t end ignore nulls) over wa as x0, last_value(value ignore nulls) over wa as v0,
      first_value(case when value is not null then t end ignore nulls) over wb as x1, first_value(value ignore nulls) over wb as v1 from s
      window wa as (partition by mode order by t rows between unbounded preceding and current row), wb as (partition by mode order by t rows between current row and unbounded following))
select mode, t, {rnd("coalesce(value, v0 + (t - x0)*1.0/(x1 - x0)*(v1 - v0))", 5)} as value from b""",
)
def fill_gaps_blocks(spark, sf):
    """Four of seven minutes are taken away and filled from their neighbours, in blocks of half a day."""
    gappy = minutes(spark, sf).select("mode", "t", F.when(F.col("t") % 7 < 3, F.col("value")).alias("value"))
    return B.fill_gaps_blocks(gappy, ["mode"], "t", size=720).select("mode", "t", rounded("value", 5).alias("value"))


@query("spectrum_split", "SPC1 SPC2 FIL1", f"""with {_DFT} select member, mode, k, {rnd("f")} as freq, {rnd("p")} as power from pw""")
def spectrum_split(spark, sf):
    """The power spectrum in tasks of 24 and 30 values."""
    out = B.power_spectrum_blocks(X.hourly(spark, sf), SERIES, X.SERIES_HOURS, block=24)
    return out.withColumns({"freq": rounded("freq"), "power": rounded("power")})


@query(
    "lag_correlation_long",
    "AGG21 JN5",
    f"""with {MINUTES_SQL}, ty as (select distinct mode from mi), p as (select a.mode, b.t - a.t as lag, a.value as x, b.value as y from mi a join mi b on b.t - a.t between -10000 and 10000 where b.mode = (select max(mode) from ty)),
c as (select mode, cast(lag as int) as lag, corr(x, y) as r, cast(count(*) as bigint) as n from p group by all)
select mode, lag, n, case when n > 2 then {rnd("r", 5)} end as r, case when n > 9 then case when abs(r) >= 0.999999 then 0.0 else {rnd(p_value_sql("(r*sqrt((n - 2)/(1 - r*r)))", "(n - 2)"), 5)} end end as p_value from c where abs(r) < 0.999999 or n > 9""",
)
def lag_correlation_long(spark, sf):
    """Ten thousand minutes back and ahead, each type of event next to the last one of the list; minutes without events are gaps."""
    rows = minutes(spark, sf).select("mode", F.col("t").alias("month_idx"), "value")
    last = rows.agg(F.max("mode").alias("m")).scalar()
    types = rows.agg(F.collect_set("mode").alias("m")).scalar()
    y = rows.filter(F.col("mode") == last).withColumn("mode", F.explode(types))
    out = L.cross_correlation(rows, y, ["mode"], 10_000)
    out = out.filter((F.col("n") > 0) & ((F.abs("r") < 0.999999) | (F.col("n") > 9)))
    return out.select("mode", "lag", "n", F.when(F.col("n") > 2, rounded("r", 5)).alias("r"), F.when(F.col("n") > 9, rounded("p_value", 5)).alias("p_value"))
