"""Queries on selectors, composites and bootstrap significance."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.operators import anomaly as A
from tidegrid.operators import composite as P
from tidegrid.operators import select as S
from tidegrid.operators.series import ensemble_band, ensemble_mean
from tidegrid.plans import fixtures as X
from tidegrid.plans.registry import query, rnd, rounded

TRIO = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
Y, XX, Z = TRIO

_SIGMA = f"""{X.INDEX_SQL}, sd as (select mode, stddev_pop(value - mu) as sd, any_value(mu) as mu from (select *, avg(value) over (partition by mode) as mu from x) q group by 1),
st as (select x.mode, x.month_idx, case when x.value - mu > sd then '+' when x.value - mu < -sd then '-' when abs(x.value - mu) < sd then '.' end as state from x join sd on x.mode = sd.mode),
wd as (select month_idx, max(case when mode = '{Y}' then state end) as y, max(case when mode = '{XX}' then state end) as x, max(case when mode = '{Z}' then state end) as z from st group by 1)"""


def _centred(spark, sf):
    from pyspark.sql import Window

    x = X.index_series(spark, sf)
    return x.withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy("mode")))


@query(
    "pure_phases",
    "SEL1 SEL2 AGG2 SET3",
    f"""with {_SIGMA}
select '{Y}' as mode, y as phase, month_idx from wd where y in ('+', '-') and x = '.' and z = '.' union all
select '{XX}', x, month_idx from wd where x in ('+', '-') and y = '.' and z = '.' union all
select '{Z}', z, month_idx from wd where z in ('+', '-') and y = '.' and x = '.'""",
)
def pure_phases(spark, sf):
    return P.pure_phases(P.sigma_states(_centred(spark, sf)), TRIO)


_QUANT = f"""{X.INDEX_SQL}, qt as (select mode, quantile_cont(value, 1 - 0.67::double) as lo, quantile_cont(value, 0.67::double) as hi from x group by 1),
st as (select x.mode, x.month_idx, case when value > hi then '+' when value < lo then '-' when value > lo and value < hi then '.' end as state from x join qt on x.mode = qt.mode),
wd as (select month_idx, max(case when mode = '{Y}' then state end) as y, max(case when mode = '{XX}' then state end) as x from st group by 1)"""


@query(
    "quantile_corners",
    "SEL3 SEL9",
    f"""with {_QUANT}, t as (select count(distinct month_idx) as k from x), c as (select y || x as panel from wd where y <> '.' and x <> '.')
select panel, cast(count(*) as bigint) as n, {rnd("count(*)/any_value(k)::double")} as share from c cross join t group by 1""",
)
def quantile_corners(spark, sf):
    x = X.index_series(spark, sf)
    picked = P.panel_months(P.quantile_states(x, 0.67), Y, XX, P.CORNERS)
    return P.sample_share(picked, S.n_months(x), ["panel"]).withColumn("share", rounded("share"))


@query(
    "tercile_panels",
    "SEL4",
    f"""with {_QUANT}, rl(panel, ry, rx) as (values {", ".join(str(r) for r in P.TERCILE_PANELS)})
select panel, month_idx from wd join rl on (ry = 'any' or ry = y) and rx = x""",
)
def tercile_panels(spark, sf):
    return P.panel_months(P.quantile_states(X.index_series(spark, sf), 0.67), Y, XX, P.TERCILE_PANELS)


@query(
    "sigma_panels",
    "SEL5",
    f"""with {_SIGMA} select y || x as panel, month_idx from wd where z = '.' and y is not null and x is not null""",
)
def sigma_panels(spark, sf):
    return P.panel_months(P.sigma_states(_centred(spark, sf)), Y, XX, P.PANELS, z=Z)


@query(
    "confidence_panels",
    "SEL6 AGG15 SEL9",
    f"""with {X.ENCODINGS_SQL}, b as (select mode, month_idx, quantile_cont(value, 0.025) as lower, quantile_cont(value, 0.975) as upper from e group by 1, 2),
wd as (select month_idx, max(case when mode = '{Y}' then case when lower > 2.3 then '+' when upper < 2.7 then '-' else '.' end end) as y,
       max(case when mode = '{XX}' then case when lower > 2.3 then '+' when upper < 2.7 then '-' else '.' end end) as x,
       max(case when mode = '{Z}' then case when lower > 2.3 then '+' when upper < 2.7 then '-' else '.' end end) as z from b group by 1)
select y || x as panel, month_idx from wd where z = '.' and y is not null and x is not null""",
)
def confidence_panels(spark, sf):
    band = ensemble_band(X.encodings(spark, sf), ["mode", "month_idx"], 0.05)
    return P.panel_months(P.band_states(band, 2.7, 2.3), Y, XX, P.PANELS, z=Z)


@query(
    "confidence_panels_by_mode",
    "SEL6",
    f"""with {X.ENCODINGS_SQL}, b as (select mode, month_idx, quantile_cont(value, 0.025) as lower, quantile_cont(value, 0.975) as upper from e group by 1, 2),
wd as (select month_idx, max(case when mode = '{Y}' then case when lower > 2.3 then '+' when upper < 2.7 then '-' else '.' end end) as y,
       max(case when mode = '{XX}' then case when lower > 2.3 then '+' when upper < 2.7 then '-' else '.' end end) as x,
       max(case when mode = '{Z}' then case when lower > 2.45 then '+' when upper < 2.55 then '-' else '.' end end) as z from b group by 1)
select y || x as panel, month_idx from wd where z = '.' and y is not null and x is not null""",
)
def confidence_panels_by_mode(spark, sf):
    """The neutral mode has bounds of its own."""
    band = ensemble_band(X.encodings(spark, sf), ["mode", "month_idx"], 0.05)
    return P.panel_months(P.band_states(band, 2.7, 2.3, {Z: (2.55, 2.45)}), Y, XX, P.PANELS, z=Z)


_PURE = f"""{_SIGMA},
sel as (select '{Y}' as mode, y as phase, month_idx from wd where y in ('+', '-') and x = '.' and z = '.' union all
        select '{XX}', x, month_idx from wd where x in ('+', '-') and y = '.' and z = '.' union all
        select '{Z}', z, month_idx from wd where z in ('+', '-') and y = '.' and x = '.')"""


@query(
    "phase_composites",
    "AGG33 JN8 SEL1 SEL2 PRJ13",
    f"""with {_PURE}, {X.FIELD_SQL}, a as (select member, lat_i, lon_i, month_idx, value - avg(value) over (partition by member, lat_i, lon_i) as v from f)
select mode, phase, member, lat_i, lon_i, {rnd("avg(v)")} as mean, cast(count(v) as bigint) as n from a join sel on a.month_idx = sel.month_idx group by 1, 2, 3, 4, 5""",
)
def phase_composites(spark, sf):
    from pyspark.sql import Window

    field = X.field(spark, sf).withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy(*A.CELL)))
    picked = P.pure_phases(P.sigma_states(_centred(spark, sf)), TRIO)
    return P.composite_mean(field, picked, A.CELL, ["mode", "phase"]).withColumn("mean", rounded("mean"))


DRAWS = 40
_BOOT = f"""with {_QUANT}, {X.FIELD_SQL}, ax as (select month_idx, row_number() over (order by month_idx) - 1 as pos, count(*) over () as k from (select distinct month_idx from f) q),
sel as (select y || x as panel, month_idx from wd where y <> '.' and x <> '.'), sz as (select panel, count(*) as n from sel group by 1),
d0 as (select panel, d.d, j.j, (d.d*1000003 + j.j*7919 + 1) % 2147483647 as x0 from sz cross join (select unnest(range(0, {DRAWS})) as d) d cross join (select unnest(range(0, 200)) as j) j where j.j < n),
d1 as (select *, (x0*x0 + 12345) % 2147483647 as x1 from d0), d2 as (select *, (x1*x1 + 678910) % 2147483647 as x2 from d1),
d3 as (select panel, d, ax.month_idx from d2 join ax on ax.pos = x2 % k),
bm as (select panel, d, member, lat_i, lon_i, avg(value) as m from d3 join f on f.month_idx = d3.month_idx group by 1, 2, 3, 4, 5),
bq as (select panel, member, lat_i, lon_i, quantile_cont(m, 0.05) as lower, quantile_cont(m, 0.95) as upper from bm group by 1, 2, 3, 4),
cm as (select panel, member, lat_i, lon_i, avg(value) as mean, count(*) as n from f join sel on f.month_idx = sel.month_idx group by 1, 2, 3, 4)"""


def _corner_inputs(spark, sf):
    picked = P.panel_months(P.quantile_states(X.index_series(spark, sf), 0.67), Y, XX, P.CORNERS)
    return X.field(spark, sf), picked


@query(
    "bootstrap_composites",
    "AGG13 AGG33 JN9 PRJ19",
    _BOOT
    + f""" select bq.panel, bq.member, bq.lat_i, bq.lon_i, {rnd("mean")} as mean, cast(coalesce(n, 0) as bigint) as n, {rnd("lower")} as lower, {rnd("upper")} as upper,
mean > upper or mean < lower as significant, case when mean > upper or mean < lower then {rnd("mean")} end as masked
from bq left join cm on bq.panel = cm.panel and bq.member = cm.member and bq.lat_i = cm.lat_i and bq.lon_i = cm.lon_i""",
)
def bootstrap_composites(spark, sf):
    field, picked = _corner_inputs(spark, sf)
    out = P.composites(field, picked, A.CELL, "panel", DRAWS, 0.05)
    out = out.withColumn("masked", S.where("mean", F.col("significant")))
    return out.select("panel", *A.CELL, "n", "significant", *[rounded(c).alias(c) for c in ("mean", "lower", "upper", "masked")])


@query(
    "bootstrap_by_join",
    "JN9 AGG13",
    _BOOT
    + f""" select panel, member, lat_i, lon_i, {rnd("lower")} as lower, {rnd("upper")} as upper from bq""",
)
def bootstrap_by_join(spark, sf):
    field, picked = _corner_inputs(spark, sf)
    sizes = picked.groupBy("panel").agg(F.count("*").cast("int").alias("n"))
    draws = P.draw_table(sizes, DRAWS, S.n_months(field))
    out = P.bootstrap_by_join(field, draws, A.CELL)
    return out.select("panel", *A.CELL, rounded("lower").alias("lower"), rounded("upper").alias("upper"))


@query(
    "phase_responses",
    "AGG34 AGG35",
    f"""with {_PURE}, {X.FIELD_SQL}, c as (select mode, member, lat_i, lon_i, avg(case when phase = '+' then value end) as p, avg(case when phase = '-' then value end) as m
from f join sel on f.month_idx = sel.month_idx group by 1, 2, 3, 4)
select mode, member, lat_i, lon_i, {rnd("p - m")} as linear, {rnd("p + m")} as nonlinear, {rnd("(p - m)/2")} as linear_half, {rnd("(p + m)/2")} as nonlinear_half from c""",
)
def phase_responses(spark, sf):
    picked = P.pure_phases(P.sigma_states(_centred(spark, sf)), TRIO)
    keys = ["mode", *A.CELL]
    comp = P.composite_mean(X.field(spark, sf), picked, A.CELL, ["mode", "phase"])
    full, half = P.responses(comp, keys), P.responses(comp, keys, half=True)
    both = full.join(half.withColumnsRenamed({"linear": "linear_half", "nonlinear": "nonlinear_half"}), keys)
    return both.select(*keys, *[rounded(c).alias(c) for c in ("linear", "nonlinear", "linear_half", "nonlinear_half")])


@query(
    "response_significance",
    "AGG34 AGG35 AGG13",
    _BOOT
    + f""", g2 as (select panel, bq.member, bq.lat_i, bq.lon_i, mean, coalesce(mean > upper or mean < lower, false) as s from bq left join cm using (panel, member, lat_i, lon_i))
select case when panel in ('++', '--') then 'same' else 'opposed' end as signs, member, lat_i, lon_i, {rnd("max(case when panel like '+%' then mean end) - max(case when panel like '-%' then mean end)")} as linear,
case when count(*) = 2 or bool_or(s) then bool_or(s) end as significant_any, case when count(*) = 2 or not bool_and(s) then bool_and(s) end as significant_both from g2 group by 1, 2, 3, 4""",
)
def response_significance(spark, sf):
    field, picked = _corner_inputs(spark, sf)
    out = P.composites(field, picked, A.CELL, "panel", DRAWS, 0.05)
    signs = F.when(F.col("panel").isin("++", "--"), "same").otherwise("opposed")
    out = out.withColumns({"signs": signs, "phase": F.substring("panel", 1, 1), "significant": F.coalesce("significant", F.lit(False))})
    return P.responses(out, ["signs", *A.CELL]).select("signs", *A.CELL, rounded("linear").alias("linear"), "significant_any", "significant_both")


@query(
    "shifted_selection",
    "WIN12 JN8",
    f"""with {_QUANT}, {X.FIELD_SQL} select member, lat_i, {rnd("avg(value)")} as value, cast(count(*) as bigint) as n
from f where month_idx in (select month_idx + 12 from wd where y = '+') group by 1, 2""",
)
def shifted_selection(spark, sf):
    months = P.quantile_states(X.index_series(spark, sf), 0.67).filter((F.col("mode") == Y) & (F.col("state") == "+"))
    hit = S.at_months(X.field(spark, sf), P.shift_selection(months, 12))
    return hit.groupBy("member", "lat_i").agg(rounded(F.avg("value")).alias("value"), F.count("*").alias("n"))


@query(
    "selection_algebra",
    "SET3 AGG14",
    f"""with {X.INDEX_SQL}, p as (select month_idx from x where mode = '{Y}' and value > 2.5), r as (select month_idx from x where mode = '{XX}' and value > 2.5)
select 'both' as "rule", month_idx from (select * from p intersect select * from r) a union all select 'either', month_idx from (select * from p union select * from r) b
union all select 'first_only', month_idx from (select * from p except select * from r) c""",
)
def selection_algebra(spark, sf):
    x = ensemble_mean(X.encodings(spark, sf), ["mode", "month_idx"]).filter("value > 2.5")
    p, r = x.filter(F.col("mode") == Y).select("month_idx"), x.filter(F.col("mode") == XX).select("month_idx")
    parts = {"both": p.intersect(r), "either": p.union(r).distinct(), "first_only": p.exceptAll(r)}
    rows = [df.select(F.lit(k).alias("rule"), "month_idx") for k, df in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])
