"""Queries on fields stored by cell, on values far from zero and on long axes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.operators import anomaly as A
from tidegrid.operators import regression as R
from tidegrid.operators.gram import mode_vectors
from tidegrid.operators.long_components import long_axis_components
from tidegrid.plans import fixtures as X
from tidegrid.plans.queries_anomaly import _POLY2
from tidegrid.plans.queries_grid import FIT2, NAMES, PREDICTORS_SQL, predictor_months
from tidegrid.plans.queries_series import p_value_sql
from tidegrid.plans.registry import query, rnd, rounded
from tidegrid.session import cut_lineage
from tidegrid.sources.layout import store_by_cell

OFFSET = 1e9

_CHAIN = f"""with {PREDICTORS_SQL}, {X.ENSEMBLE_SQL},
cl as (select member, lat_i, lon_i, month_idx % 12 as m, sum(value*n)/sum(n) as clim from g group by 1, 2, 3, 4),
a as (select g.member, g.lat_i, g.lon_i, g.month_idx, value - clim as value from g join cl on g.member = cl.member and g.lat_i = cl.lat_i and g.lon_i = cl.lon_i and g.month_idx % 12 = cl.m),
{_POLY2.format(k="member, lat_i, lon_i", src="a")},
d as (select j0.member, j0.lat_i, j0.lon_i, j0.month_idx, j0.value - (b0 + b1*u + b2*u*u) as value from (select z.*, k2.b0, k2.b1, k2.b2 from z join k2 using (member, lat_i, lon_i)) j0),
j as (select d.*, d.value as y, p1, p2 from d join pr on d.month_idx = pr.month_idx where p1 is not null and p2 is not null),
{FIT2}
select j.member, j.lat_i, j.lon_i, j.month_idx, {rnd("y", 5)} as anomaly, {rnd("y - (b0 + b1*p1 + b2*p2)", 5)} as residual
from j join k on j.member = k.member and j.lat_i = k.lat_i and j.lon_i = k.lon_i"""


def chain(layout, predictors, names):
    """Anomaly, own trend removed, regression and its residual of a field stored by cell: no exchange of the field."""
    flat = A.detrend_cells(A.anomalies(layout, A.CELL), A.CELL, 2)
    fit = R.ols(flat, predictors, names, A.CELL, drop_missing=True)
    left = R.residuals(flat, predictors, fit, names, A.CELL, keep=True)
    return left.select(*A.CELL, "month_idx", rounded("value", 5).alias("anomaly"), rounded("residual", 5).alias("residual"))


@query("field_chain", "JN1 JN2 JN3 JN4 AGG4 AGG5 AGG8 AGG9 AGG10 AGG22", _CHAIN)
def field_chain(spark, sf):
    layout = store_by_cell(X.ensemble_field(spark, sf), A.CELL)
    return chain(layout, predictor_months(spark, sf), NAMES)


@query(
    "regression_offset",
    "AGG22 AGG8 AGG18",
    f"""with {PREDICTORS_SQL}, {X.ENSEMBLE_SQL}, j as (select g.member, lat_i, lon_i, g.month_idx, value*1000 + {OFFSET} as y, p1*1000 + {OFFSET} as p1, p2*1000 + {OFFSET} as p2 from g join pr on g.month_idx = pr.month_idx where p1 is not null and p2 is not null),
{FIT2}
select member, lat_i, lon_i, n, {rnd("1 - sse/cyy", 5)} as r2, u.mode, {rnd("case u.mode when 'p1' then b1 else b2 end", 3)} as coef,
{rnd("case u.mode when 'p1' then " + p_value_sql("(b1/e1)", "(n - 3)") + " else " + p_value_sql("(b2/e2)", "(n - 3)") + " end", 5)} as p_value
from k cross join (select unnest(['p1', 'p2']) as mode) u""",
)
def regression_offset(spark, sf):
    """Values and predictors, in thousandths, lie a billion from zero."""
    field = X.ensemble_field(spark, sf).withColumn("value", F.col("value") * 1000 + OFFSET)
    predictors = predictor_months(spark, sf).withColumns({p: F.col(p) * 1000 + OFFSET for p in NAMES})
    fit = R.ols(field, predictors, NAMES, A.CELL, drop_missing=True)
    long = R.coefficients(fit, NAMES, [*A.CELL, "n", "r2"]).filter("mode <> 'intercept'")
    return long.select(*A.CELL, "n", "mode", rounded("r2", 5).alias("r2"), rounded("coef", 3).alias("coef"), rounded("p_value", 5).alias("p_value"))


@query(
    "components_long_axis",
    "AGG39 AGG40 MOD9 MOD10",
    f"""with {X.HOURLY_SQL}, c as (select member, mode as series, count(*) as n, var_samp(value) as v from h group by 1, 2), a as (select count(*) as n_cells, max(n) as n_times, sum(v) as total from c)
select u.mode, n_times, n_cells, {rnd("total")} as total, true as projects, true as regresses, true as falls from a cross join (select unnest(['pc1', 'pc2', 'pc3']) as mode) u""",
)
def components_long_axis(spark, sf):
    """What must hold for components whatever solver found them, on the hourly axis.

    Projects: a score is the field times the weights. Regresses: a weight is the regression of the cell on the score. Falls: variances
    don't rise from one component to the next.
    """
    field = cut_lineage(X.hourly(spark, sf).withColumnRenamed("mode", "series"))
    cell, modes = ["member", "series"], ["pc1", "pc2", "pc3"]
    found = long_axis_components(field, cell, 3, t="t")
    scores = cut_lineage(mode_vectors(found.scores, ["t"], modes).withColumnRenamed("vec", "s"))
    a = F.col("value") - F.col("mean")
    rows = field.join(found.weights, cell).join(scores, "t")

    def each(make):
        return [make(i).alias(f"_{i}") for i in range(3)]

    power = scores.agg(F.array(*each(lambda i: F.sum(F.pow(F.element_at("s", i + 1), 2)))).alias("p")).scalar()
    made = rows.groupBy("t").agg(F.first("s").alias("s"), *each(lambda i: F.sum(a * F.element_at("w", i + 1))))
    off = made.agg(*each(lambda i: F.sum(F.pow(F.col(f"_{i}") - F.element_at("s", i + 1), 2)) < 1e-12 * F.element_at(power, i + 1)))
    fit = rows.groupBy(*cell).agg(F.first("w").alias("w"), *each(lambda i: F.sum(a * F.element_at("s", i + 1))))
    bent = fit.agg(*each(lambda i: F.sum(F.pow(F.col(f"_{i}") / F.element_at(power, i + 1) - F.element_at("w", i + 1), 2)) < 1e-12))
    total = F.element_at(F.collect_list(F.col("variance") / F.col("share")), 1)
    falls = found.variance.agg(F.array_sort(F.collect_list(F.struct("mode", "variance"))).alias("v"), rounded(total).alias("total"))
    facts = falls.select((F.array_sort("v.variance") == F.reverse("v.variance")).alias("falls"), "total")
    size = field.agg(F.count_distinct("t").alias("n_times"), F.count_distinct(*cell).alias("n_cells"))
    checks = [F.array(*[F.col(f"_{i}") for i in range(3)]).alias("c")]
    joined = size.select("*", off.select(*checks).scalar().alias("p"), bent.select(*checks).scalar().alias("r"), facts.select(F.struct("*").alias("f")).scalar().alias("f"))
    out = joined.select("*", F.posexplode(F.lit(modes)).alias("at", "mode"))
    return out.select("mode", "n_times", "n_cells", F.col("f.total").alias("total"), F.col("p")[F.col("at")].alias("projects"), F.col("r")[F.col("at")].alias("regresses"), F.col("f.falls").alias("falls"))
