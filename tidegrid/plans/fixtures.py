"""Fields, series and encodings derived from the given tables.

Each one has a DataFrame builder and the ANSI-SQL text of the same derivation (``*_SQL``, a
list of CTEs). Member and initialization numbers grow with the tables, while the length of a
series and the density of the grid stay the same, so work grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.calendar import month_index

N_LAT, N_LON = 10, 12
SERIES_HOURS = 720


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _div(col: str, by: int) -> Column:
    return F.floor(F.col(col) / by).cast("int")


# -- F: field on a 10 x 12 grid, one member per hundred suppliers ---------------------------

FIELD_SQL = """
f as (select cast(l_suppkey // 100 as int) as member, cast(year(l_shipdate)*12 + month(l_shipdate) - 1 as int) as month_idx,
             cast(l_suppkey % 10 as int) as lat_i, cast(l_partkey % 12 as int) as lon_i,
             avg(l_extendedprice)/997.0 as value, count(*) as n
      from lineitem group by 1, 2, 3, 4)"""


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return (
        li.groupBy(
            _div("l_suppkey", 100).alias("member"),
            month_index(F.col("l_shipdate")).alias("month_idx"),
            (F.col("l_suppkey") % N_LAT).cast("int").alias("lat_i"),
            (F.col("l_partkey") % N_LON).cast("int").alias("lon_i"),
        )
        .agg((F.avg("l_extendedprice") / 997.0).alias("value"), F.count("*").alias("n"))
        .withColumns({"lat": F.col("lat_i") * 10.0 - 45.0, "lon": F.col("lon_i") * 30.0})
    )


# -- G: ensemble field on a 5 x 6 grid, one member per ten suppliers, with gaps -------------

ENSEMBLE_SQL = """
g as (select cast(l_suppkey // 10 as int) as member, cast(year(l_shipdate)*12 + month(l_shipdate) - 1 as int) as month_idx,
             cast(l_suppkey % 5 as int) as lat_i, cast(l_partkey % 6 as int) as lon_i,
             avg(l_extendedprice)/997.0 as value, count(*) as n
      from lineitem group by 1, 2, 3, 4)"""


def ensemble_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return (
        li.groupBy(
            _div("l_suppkey", 10).alias("member"),
            month_index(F.col("l_shipdate")).alias("month_idx"),
            (F.col("l_suppkey") % 5).cast("int").alias("lat_i"),
            (F.col("l_partkey") % 6).cast("int").alias("lon_i"),
        )
        .agg((F.avg("l_extendedprice") / 997.0).alias("value"), F.count("*").alias("n"))
        .withColumns({"lat": F.col("lat_i") * 20.0 - 40.0, "lon": F.col("lon_i") * 60.0})
    )


# -- raw observations: many rows per cell and month ----------------------------------------

RAW_SQL = """
raw as (select cast(l_suppkey // 10 as int) as member, cast(year(l_shipdate)*12 + month(l_shipdate) - 1 as int) as month_idx,
               cast(l_suppkey % 5 as int) as lat_i, cast(l_partkey % 6 as int) as lon_i, l_extendedprice/997.0 as value,
               cast(l_suppkey % 5 as int)*20.0 - 40.0 as lat
        from lineitem)"""


def raw_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        _div("l_suppkey", 10).alias("member"),
        month_index(F.col("l_shipdate")).alias("month_idx"),
        (F.col("l_suppkey") % 5).cast("int").alias("lat_i"),
        (F.col("l_partkey") % 6).cast("int").alias("lon_i"),
        (F.col("l_extendedprice") / 997.0).alias("value"),
        ((F.col("l_suppkey") % 5).cast("int") * 20.0 - 40.0).alias("lat"),
    )


# -- E: encodings, one initialization per three hundred customers --------------------------

ENCODINGS_SQL = """
e as (select cast(o_custkey // 300 as int) as initialization, o_orderpriority as mode,
             cast(year(o_orderdate)*12 + month(o_orderdate) - 1 as int) as month_idx,
             avg(o_totalprice)/99700.0 as value, count(*) as n
      from orders group by 1, 2, 3)"""

# fixed values: mode names of the encodings fixture, in place of the five latent labels
MODES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(
        _div("o_custkey", 300).alias("initialization"),
        F.col("o_orderpriority").alias("mode"),
        month_index(F.col("o_orderdate")).alias("month_idx"),
    ).agg((F.avg("o_totalprice") / 99700.0).alias("value"), F.count("*").alias("n"))


# mode series: mean over the initializations
INDEX_SQL = ENCODINGS_SQL + """,
x as (select mode, month_idx, avg(value) as value from e group by 1, 2)"""


def index_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encodings(spark, sf_dir).groupBy("mode", "month_idx").agg(F.avg("value").alias("value"))


# -- H: hourly counts, zero where nothing happened; one member per 150 users ---------------

HOURLY_SQL = """
h0 as (select cast(user_id // 150 as int) as member, event_type as mode, cast((day(ts)-1)*24 + hour(ts) as int) as t, count(*) as n
       from events group by 1, 2, 3),
h as (select s.member, s.mode, cast(u.t as int) as t, cast(coalesce(h0.n, 0) as double) as value
      from (select distinct member, mode from h0) s cross join (select unnest(range(0, 720)) as t) u
      left join h0 on h0.member = s.member and h0.mode = s.mode and h0.t = u.t)"""


#: Rows of a task of the hourly fixtures, zeros included, and hours of the longest month.
TASK_ROWS, MONTH_HOURS = 1_000_000, 744
SERIES = ["member", "mode"]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = ((F.dayofmonth("ts") - 1) * 24 + F.hour("ts")).cast("int")
    lon = (F.col("user_id") % N_LON).cast("int")
    return table(spark, sf_dir, "events").select(_div("user_id", 150).alias("member"), F.col("event_type").alias("mode"), lon.alias("lon_i"), hour.alias("t"))


def hourly_tasks(spark: SparkSession, sf_dir: str, size: int) -> int:
    """Tasks for the hourly fixtures: as many as there are shuffle partitions, more if their rows (``size`` for a series) need them."""
    series = _events(spark, sf_dir).select(*SERIES).distinct().count()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-series * size // TASK_ROWS))


def _zero_filled(counts: DataFrame, tasks: int, place: Column, places: Column, steps: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """``counts``, unique per series and place, and a zero at each of ``places`` that a series lacks.

    ``place`` numbers the steps of a series, and ``steps`` turns a number back into their columns. Few counts become many rows, so the series are dealt to
    as many tasks as their rows need; what is absent is found within a series, so zeros are neither summed nor exchanged.
    """
    have = F.collect_list(F.struct(place.alias("p"), F.struct(*steps, F.col("n").cast("double").alias("value")).alias("r"))).alias("_have")
    packed = counts.repartition(tasks, *SERIES).groupBy(*SERIES).agg(have)
    zeros = F.transform(F.array_except(places, F.col("_have.p")), lambda p: F.struct(*[f(p).alias(c) for c, f in steps.items()], F.lit(0.0).alias("value")))
    return packed.select(*SERIES, F.explode(F.concat(F.col("_have.r"), zeros)).alias("_r")).select(*SERIES, "_r.*")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _events(spark, sf_dir).groupBy(*SERIES, "t").agg(F.count("*").alias("n"))
    hours = F.sequence(F.lit(0), F.lit(SERIES_HOURS - 1))
    return _zero_filled(counts, hourly_tasks(spark, sf_dir, SERIES_HOURS), F.col("t"), hours, {"t": lambda p: p})


# -- Z: hourly counts on twelve longitudes, zero where nothing happened --------------------

ZONAL_SQL = """
z0 as (select cast(user_id // 150 as int) as member, event_type as mode, cast(user_id % 12 as int) as lon_i, cast((day(ts)-1)*24 + hour(ts) as int) as t, count(*) as n
       from events group by 1, 2, 3, 4),
zh as (select s.member, s.mode, x.lon_i, cast(u.t as int) as t, cast(coalesce(z0.n, 0) as double) as value
       from (select distinct member, mode from z0) s cross join (select cast(unnest(range(0, 12)) as int) as lon_i) x cross join (select unnest(range(0, 720)) as t) u
       left join z0 on z0.member = s.member and z0.mode = s.mode and z0.lon_i = x.lon_i and z0.t = u.t)"""


def zonal_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _events(spark, sf_dir).groupBy(*SERIES, "lon_i", "t").agg(F.count("*").alias("n"))
    # hours of a 31st, which lie beyond the axis, have numbers of their own
    places = F.filter(F.sequence(F.lit(0), F.lit(N_LON * MONTH_HOURS - 1)), lambda p: p % MONTH_HOURS < SERIES_HOURS)
    steps = {"lon_i": lambda p: F.floor(p / MONTH_HOURS).cast("int"), "t": lambda p: p % MONTH_HOURS}
    return _zero_filled(counts, hourly_tasks(spark, sf_dir, N_LON * SERIES_HOURS), F.col("lon_i") * MONTH_HOURS + F.col("t"), places, steps)


# -- M: basin mask; L: closed-form loadings; W: bilinear weights ---------------------------

MASK_SQL = """
m as (select distinct lat_i, lon_i from f where (lat_i + lon_i) % 4 <> 0)"""

LOADINGS_SQL = """
l as (select md.mode, c.lat_i, c.lon_i, cos(2*pi()*md.mode*c.lon_i/12.0)*cos(radians(10.0*c.lat_i - 45.0)) as w
      from (select distinct lat_i, lon_i from f) c cross join (select unnest(range(1, 6)) as mode) md)"""


def grid_cells(df: DataFrame) -> DataFrame:
    return df.select("lat_i", "lon_i").distinct()


def mask(df: DataFrame) -> DataFrame:
    return grid_cells(df).filter((F.col("lat_i") + F.col("lon_i")) % 4 != 0)


def loadings(df: DataFrame, n_modes: int = 5) -> DataFrame:
    """Linear modes in closed form, one weight per mode and cell."""
    mode = F.explode(F.sequence(F.lit(1), F.lit(n_modes)))
    w = F.cos(2 * F.pi() * F.col("mode") * F.col("lon_i") / 12.0) * F.cos(F.radians(10.0 * F.col("lat_i") - 45.0))
    return grid_cells(df).withColumn("mode", mode).withColumn("w", w)


# -- V: labelled vectors -------------------------------------------------------------------

VECTORS_SQL = """
v as (select vec_id, label, generate_subscripts(embedding, 1) - 1 as dim, cast(unnest(embedding) as double) as value from embeddings)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return emb.select("vec_id", "label", F.posexplode("embedding").alias("dim", "value")).withColumn(
        "value", F.col("value").cast("double")
    )
