"""Queries on linear modes: encode, decode, ablate, align, components, recursion, scoring."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tidegrid.functions.kernels import butterworth
from tidegrid.operators import anomaly as A
from tidegrid.operators import filters as B
from tidegrid.operators import modes as M
from tidegrid.operators import select as S
from tidegrid.operators import skill as K
from tidegrid.operators.gram import mode_vectors
from tidegrid.plans import fixtures as X
from tidegrid.plans.queries_anomaly import _AREA, _POLY2
from tidegrid.plans.queries_spectral import zero_phase_sql
from tidegrid.plans.registry import query, rnd, rounded

MODES = [1, 2, 3, 4, 5]

_BASE = f"""{X.FIELD_SQL}, {X.LOADINGS_SQL}"""
_ENC = _BASE + ", ez as (select member, month_idx, mode, sum(w*value) as z from f join l on f.lat_i = l.lat_i and f.lon_i = l.lon_i group by 1, 2, 3)"


def _field_modes(spark, sf):
    field = X.field(spark, sf)
    loadings = X.loadings(field)
    return field, loadings, M.encode(field, loadings, MODES, ["member"])


@query("encode", "MOD1", f"""with {_ENC} select member, month_idx, cast(mode as int) as mode, {rnd("z", 4)} as value from ez""")
def encode(spark, sf):
    return _field_modes(spark, sf)[2].withColumn("value", rounded("value", 4))


@query(
    "decode",
    "MOD2",
    f"""with {_ENC} select f.member, f.lat_i, f.lon_i, f.month_idx, {rnd("sum(w*z)", 4)} as value from f join l on f.lat_i = l.lat_i and f.lon_i = l.lon_i
join ez on ez.member = f.member and ez.month_idx = f.month_idx and ez.mode = l.mode group by 1, 2, 3, 4""",
)
def decode(spark, sf):
    field, loadings, series = _field_modes(spark, sf)
    out = M.decode(field, series, loadings, MODES, ["member"])
    return out.select(*A.CELL, "month_idx", rounded("decoded", 4).alias("value"))


@query(
    "encode_partial_loadings",
    "MOD1 MOD2",
    f"""with {_BASE}, pl as (select * from l where not (mode = 2 and lon_i < 3) and not (mode = 4 and lat_i = 1)), ez as (select member, month_idx, mode, sum(w*value) as z from f join pl on f.lat_i = pl.lat_i and f.lon_i = pl.lon_i group by 1, 2, 3),
gz as (select *, case when mode <> 3 or month_idx % 10 <> 0 then z end as zz from ez)
select f.member, f.lat_i, f.lon_i, f.month_idx, case when count(*) = count(zz) then {rnd("sum(w*zz)", 4)} end as value from f join pl on f.lat_i = pl.lat_i and f.lon_i = pl.lon_i
join gz on gz.member = f.member and gz.month_idx = f.month_idx and gz.mode = pl.mode group by 1, 2, 3, 4""",
)
def encode_partial_loadings(spark, sf):
    """Some cells have no part in a mode, and a mode is not known in some months: the others keep their sums, those months have NULL."""
    field = X.field(spark, sf)
    loadings = X.loadings(field).filter("not (mode = 2 and lon_i < 3) and not (mode = 4 and lat_i = 1)")
    series = M.encode(field, loadings, MODES, ["member"]).filter("mode <> 3 or month_idx % 10 <> 0")
    out = M.decode(field, series, loadings, MODES, ["member"])
    return out.select(*A.CELL, "month_idx", rounded("decoded", 4).alias("value"))


@query(
    "keep_leading_modes",
    "MOD3",
    f"""with {_ENC}, kz as (select member, month_idx, mode, case when mode in (3, 1) then z else avg(z) over (partition by member, mode) end as z from ez)
select f.member, f.lat_i, f.lon_i, f.month_idx, {rnd("sum(w*z)", 4)} as value from f join l on f.lat_i = l.lat_i and f.lon_i = l.lon_i
join kz on kz.member = f.member and kz.month_idx = f.month_idx and kz.mode = l.mode group by 1, 2, 3, 4""",
)
def keep_leading_modes(spark, sf):
    field, loadings, series = _field_modes(spark, sf)
    kept = M.keep_first(series, [3, 1, 2, 4, 5], 2, ["member"])
    out = M.decode(field, kept, loadings, MODES, ["member"])
    return out.select(*A.CELL, "month_idx", rounded("decoded", 4).alias("value"))


@query(
    "decode_without_mode",
    "MOD4",
    f"""with {_ENC}, om as (select unnest(range(1, 6)) as o) select cast(o as int) as without, f.member, f.lat_i, f.lon_i, f.month_idx, {rnd("sum(case when l.mode = o then 0 else w*z end)", 4)} as value
from f join l on f.lat_i = l.lat_i and f.lon_i = l.lon_i join ez on ez.member = f.member and ez.month_idx = f.month_idx and ez.mode = l.mode cross join om group by 1, 2, 3, 4, 5""",
)
def decode_without_mode(spark, sf):
    field, loadings, series = _field_modes(spark, sf)
    out = M.decode_without(field.select(*A.CELL, "month_idx"), series, loadings, MODES, ["member"])
    return out.select("without", *A.CELL, "month_idx", rounded("decoded", 4).alias("value"))


# brute force: every ablated field is written out and its variance taken cell by cell
_VARIANCE = (
    _ENC
    + """, mz as (select member, month_idx, mode, z, avg(z) over (partition by member, mode) as mu from ez), om as (select unnest(range(0, 6)) as o),
df as (select o, member, month_idx, lat_i, lon_i, sum(w*case when l.mode = o then mu else z end) as v from mz join l on l.mode = mz.mode cross join om group by 1, 2, 3, 4, 5),
dv as (select o, member, sum(v) as v from (select o, member, lat_i, lon_i, var_samp(v) as v from df group by 1, 2, 3, 4) q group by 1, 2),
tv as (select member, sum(v) as tv from (select member, lat_i, lon_i, var_samp(value) as v from f group by 1, 2, 3) q group by 1),
ls as (select a.member, a.o as mode, abs(1 - a.v/b.v) as lost, b.v as full_v from dv a join dv b on a.member = b.member and b.o = 0 where a.o > 0)"""
)


def _data_variance(field, ddof: int = 1):
    fn = F.var_samp if ddof else F.var_pop
    return field.groupBy(*A.CELL).agg(fn("value").alias("v")).groupBy("member").agg(F.sum("v").alias("variance"))


@query(
    "variance_shares",
    "MOD5 AGG3 AGG24 WIN11",
    f"""with {_VARIANCE} select ls.member, cast(mode as int) as mode, {rnd("lost/sum(lost) over (partition by ls.member)")} as share, {rnd("lost/sum(lost) over (partition by ls.member)*full_v/tv", 4)} as absolute
from ls join tv on tv.member = ls.member""",
)
def variance_shares(spark, sf):
    field, loadings, series = _field_modes(spark, sf)
    out = M.variance_shares(series, loadings, MODES, ["member"], _data_variance(field))
    return out.select("member", "mode", rounded("share").alias("share"), rounded("absolute", 4).alias("absolute"))


@query(
    "effective_modes",
    "AGG42 MOD5 WIN11",
    f"""with {_VARIANCE}, sh as (select member, mode, lost/sum(lost) over (partition by member) as share from ls), rk as (select *, row_number() over (partition by member order by share desc) as r from sh)
select member, {rnd("sum(r*share)")} as effective from rk group by 1""",
)
def effective_modes(spark, sf):
    _, loadings, series = _field_modes(spark, sf)
    shares = M.variance_shares(series, loadings, MODES, ["member"])
    return M.effective_modes(shares, ["member"]).withColumn("effective", rounded("effective"))


_SALIENT = _VARIANCE.replace("df as", "lm as (select mode, lat_i, lon_i, w + 0.01*mode as w from l), df as").replace("join l on l.mode = mz.mode", "join lm on lm.mode = mz.mode").replace(
    "case when l.mode = o", "case when lm.mode = o"
)


@query(
    "effective_salient_modes",
    "AGG42 MOD6",
    f"""with {_SALIENT}, se as (select mode, abs(sum(w)) as s from lm group by 1), rk as (select member, mode, row_number() over (partition by member order by lost desc, mode) as r from ls)
select rk.member, {rnd("sum(r*s)/(select sum(s) from se)", 4)} as effective from rk join se on se.mode = rk.mode group by 1""",
)
def effective_salient_modes(spark, sf):
    """Salient shares in the order of the variance that a mode's ablation loses."""
    field, loadings, series = _field_modes(spark, sf)
    loadings = loadings.withColumn("w", F.col("w") + 0.01 * F.col("mode"))
    lost = M.variance_shares(series, loadings, MODES, ["member"]).select("member", "mode", F.col("share").alias("lost"))
    salient = M.salient_shares(loadings, MODES, _data_variance(field, 0), _data_variance(field), ["member"])
    return M.effective_modes(salient.join(lost, ["member", "mode"]), ["member"], "lost").withColumn("effective", rounded("effective", 4))


@query(
    "salient_shares",
    "MOD6",
    f"""with {_VARIANCE.replace("df as", "lm as (select mode, lat_i, lon_i, w + 0.01*mode as w from l), df as").replace("join l on l.mode = mz.mode", "join lm on lm.mode = mz.mode").replace("case when l.mode = o", "case when lm.mode = o")}, se as (select mode, abs(sum(w)) as s from lm group by 1),
dp as (select member, sum(v) as v from (select member, lat_i, lon_i, var_pop(v) as v from df where o = 0 group by 1, 2, 3) q group by 1)
select dp.member, cast(se.mode as int) as mode, {rnd("s/(select sum(s) from se)", 4)} as share, {rnd("s/(select sum(s) from se)*dp.v/tv", 3)} as absolute from dp join tv on tv.member = dp.member cross join se""",
)
def salient_shares(spark, sf):
    field, loadings, series = _field_modes(spark, sf)
    # with wave-like loadings every sensitivity is rounding noise, so a constant is added to each
    loadings = loadings.withColumn("w", F.col("w") + 0.01 * F.col("mode"))
    target = field.select("member", "month_idx").distinct().join(field.select(*A.CELL).distinct(), "member")
    decoded = M.decode(target, series, loadings, MODES, ["member"]).withColumnRenamed("decoded", "value")
    out = M.salient_shares(loadings, MODES, _data_variance(decoded, 0), _data_variance(field), ["member"])
    return out.select("member", "mode", rounded("share", 4).alias("share"), rounded("absolute", 3).alias("absolute"))


@query(
    "sign_alignment",
    "AGG44 AGG12",
    f"""with {_ENC}, b as (select member, month_idx, avg(v) as r from (select member, month_idx, lon_i, avg(value) as v from f where 10.0*lat_i - 45.0 between -15 and 15 and 30.0*lon_i between 60 and 180 group by 1, 2, 3) q group by 1, 2),
s as (select ez.member, mode, case when corr(z, r) < 0 then -1.0::double else 1.0::double end as sign from ez join b on ez.member = b.member and ez.month_idx = b.month_idx group by 1, 2)
select ez.member, ez.month_idx, cast(ez.mode as int) as mode, {rnd("z*sign", 4)} as value from ez join s on s.member = ez.member and s.mode = ez.mode""",
)
def sign_alignment(spark, sf):
    field, _, series = _field_modes(spark, sf)
    box = A.box_mean(S.box(field, lat=(-15, 15), lon=(60, 180)), ["member", "month_idx"])
    out = M.apply_signs(series, M.sign_table(series, box, ["member"]), ["member"])
    return out.select("member", "month_idx", "mode", rounded("value", 4).alias("value"))


_NORMED = "ln as (select l.mode, lat_i, lon_i, w/sqrt(nn) as w from l join (select mode, sum(w*w) as nn from l group by 1) q on l.mode = q.mode where l.mode <= 3)"


def _recursion_sql(steps: int) -> str:
    parts, prev = [], "f"
    for s in range(steps):
        parts.append(f"z{s} as (select member, month_idx, mode, sum(w*value) as z from {prev} r join ln on r.lat_i = ln.lat_i and r.lon_i = ln.lon_i group by 1, 2, 3)")
        parts.append(
            f"d{s} as (select r.member, r.month_idx, r.lat_i, r.lon_i, any_value(r.value) - sum(w*z) as value from {prev} r join ln on r.lat_i = ln.lat_i and r.lon_i = ln.lon_i "
            f"join z{s} on z{s}.member = r.member and z{s}.month_idx = r.month_idx and z{s}.mode = ln.mode group by 1, 2, 3, 4)"
        )
        prev = f"d{s}"
    union = " union all ".join(f"select {s} as recursion, member, month_idx, cast(mode as int) as mode, {rnd('z', 4)} as value from z{s}" for s in range(steps))
    return f"with {_BASE}, {_NORMED}, {', '.join(parts)} {union}"


@query("recursive_residuals", "MOD7 SET1 JN1", _recursion_sql(3))
def recursive_residuals(spark, sf):
    field = X.field(spark, sf).select(*A.CELL, "month_idx", "value")

    def fixed_modes(residual):
        base = X.loadings(residual, 3)
        norm = base.groupBy("mode").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_n"))
        return base.join(norm, "mode").withColumn("w", F.col("w") / F.col("_n")).drop("_n"), [1, 2, 3]

    out = M.recurse(field, fixed_modes, ["member"], 3)
    return out.select("recursion", "member", "month_idx", "mode", rounded("value", 4).alias("value"))


_G_LOADINGS = "lg as (select md.mode, c.lat_i, c.lon_i, cos(2*pi()*md.mode*c.lon_i/6.0)*cos(radians(20.0*c.lat_i - 40.0)) as w from (select distinct lat_i, lon_i from g) c cross join (select unnest(range(1, 4)) as mode) md)"


@query(
    "members_on_fitted_modes",
    "MOD8 AGG11 AGG5 MOD1",
    f"""with {X.ENSEMBLE_SQL}, {_AREA.format(src="g")}, {_POLY2.format(k="member", src="w")}, {_G_LOADINGS},
dt as (select g.member, lat_i, lon_i, month_idx, n, value - (b0 + b1*(month_idx - c0)/h0 + b2*((month_idx - c0)/h0)*((month_idx - c0)/h0)) as value from g join k2 on g.member = k2.member),
cl as (select member, lat_i, lon_i, month_idx % 12 as m, sum(value*n)/sum(n) as clim from dt group by 1, 2, 3, 4),
an as (select dt.member, dt.lat_i, dt.lon_i, dt.month_idx, value - clim as value from dt join cl on dt.member = cl.member and dt.lat_i = cl.lat_i and dt.lon_i = cl.lon_i and dt.month_idx % 12 = m)
select member, month_idx, cast(mode as int) as mode, {rnd("sum(w*value)", 4)} as value from an join lg on an.lat_i = lg.lat_i and an.lon_i = lg.lon_i group by 1, 2, 3""",
)
def members_on_fitted_modes(spark, sf):
    """Each member has its own trend and climatology; all are encoded in one job."""
    g = X.ensemble_field(spark, sf)
    mode = F.explode(F.sequence(F.lit(1), F.lit(3)))
    grid = X.grid_cells(g).withColumn("mode", mode)
    loadings = grid.withColumn("w", F.cos(2 * F.pi() * F.col("mode") * F.col("lon_i") / 6.0) * F.cos(F.radians(20.0 * F.col("lat_i") - 40.0)))
    anom = A.anomalies(A.global_detrend(g, ["member"]), A.CELL)
    return M.encode(anom, loadings, [1, 2, 3], ["member"]).withColumn("value", rounded("value", 4))


# -- principal components ----------------------------------------------------------------------

_TWO = f"""{X.ENCODINGS_SQL}, tw as (select initialization, month_idx, avg(case when mode in ('1-URGENT', '3-MEDIUM', '5-LOW') then value end) as u, avg(case when mode not in ('1-URGENT', '3-MEDIUM', '5-LOW') then value end) as v from e group by 1, 2),
cv as (select initialization, var_samp(u) as a, covar_samp(u, v) as b, var_samp(v) as c from tw where u is not null and v is not null group by 1),
ev as (select *, (a + c)/2 + sqrt(pow((a - c)/2, 2) + b*b) as l1, (a + c)/2 - sqrt(pow((a - c)/2, 2) + b*b) as l2 from cv)"""


@query(
    "components_of_two_series",
    "AGG39",
    f"""with {_TWO} select initialization, 'pc1' as mode, {rnd("l1")} as variance, {rnd("l1/(a + c)")} as share from ev union all select initialization, 'pc2', {rnd("l2")}, {rnd("l2/(a + c)")} from ev""",
)
def components_of_two_series(spark, sf):
    """The means of the odd and the even modes stand for two cells, where the eigenvalues have a closed form."""
    half = F.when(F.col("mode").isin("1-URGENT", "3-MEDIUM", "5-LOW"), "odd").otherwise("even")
    e = X.encodings(spark, sf).groupBy("initialization", "month_idx", half.alias("mode")).agg(F.avg("value").alias("value"))
    both = mode_vectors(e, ["initialization", "month_idx"], ["odd", "even"])
    cells = both.select("initialization", "month_idx", F.posexplode("vec").alias("cell", "value"))
    pcs = M.principal_components(cells, ["initialization"], ["cell"], 2)
    return pcs.variance.select("initialization", "mode", rounded("variance").alias("variance"), rounded("share").alias("share"))


def _gap_free(spark, sf):
    return S.complete_cells(X.field(spark, sf), A.CELL).select(*A.CELL, "month_idx", "value")


@query("principal_components", "AGG39", None)
def principal_components(spark, sf):
    """Three components of the gap-free cells of all members; scores per month."""
    pcs = M.principal_components(_gap_free(spark, sf), [], A.CELL, 3)
    return pcs.scores.join(pcs.variance, "mode").select("mode", "month_idx", rounded("value", 5).alias("value"), rounded("share").alias("share"))


@query("components_projection", "AGG39 AGG40 FIL2", None)
def components_projection(spark, sf):
    """Modes of the low-passed field, and the unfiltered field projected on them."""
    raw = _gap_free(spark, sf)
    pcs = M.principal_components(B.low_pass(raw, A.CELL, 24), [], A.CELL, 3)
    return pcs.transform(raw).select("mode", "month_idx", rounded("value", 5).alias("value"))


@query("separated_modes", "MOD10 FIL2 FIL4 FIL3", None)
def separated_modes(spark, sf):
    bands = {
        "slow": lambda d: B.low_pass(d, A.CELL, 40),
        "middle": lambda d: B.band_pass(d, A.CELL, 40, 12),
        "fast": lambda d: B.high_pass(d, A.CELL, 12),
    }
    pcs = M.separated_modes(_gap_free(spark, sf), bands, [], A.CELL, 1)
    return pcs.scores.select("band", "mode", "month_idx", rounded("value", 4).alias("value"))


@query("ensemble_of_fits", "MOD9", None)
def ensemble_of_fits(spark, sf):
    """Fifty seeds and five splits from one Gram matrix."""
    fits = spark.range(50).select(F.col("id").cast("int").alias("seed"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("split"))
    out = M.fit_ensemble(_gap_free(spark, sf), fits, A.CELL, 3)
    return out.select("seed", "split", "mode", rounded("variance").alias("variance"), rounded("share").alias("share"))


# -- components with a closed form: two event series stand for two cells -------------------------

_PAIR_H = f"""{X.HOURLY_SQL}, h2 as (select member, case when mode in ('click', 'error', 'purchase') then 'click' else 'view' end as mode, t, sum(value) as value from h group by 1, 2, 3)"""


def _two_cells(spark, sf):
    """All types of events, in two groups that are named after a type of each."""
    group = F.when(F.col("mode").isin("click", "error", "purchase"), "click").otherwise("view")
    h = X.hourly(spark, sf).groupBy("member", group.alias("cell"), F.col("t").alias("month_idx"))
    return h.agg(F.sum("value").alias("value"))


def _eigen_sql(tag: str) -> str:
    """Eigenvalues of the covariance of the two filtered series of a member."""
    return (
        f"tw{tag} as (select member, i, max(case when mode = 'click' then y end) as u, max(case when mode = 'view' then y end) as v from zp{tag} group by 1, 2), "
        f"cv{tag} as (select member, var_samp(u) as a, covar_samp(u, v) as b, var_samp(v) as c, avg(u) as mu, avg(v) as mv from tw{tag} group by 1), "
        f"ev{tag} as (select *, (a + c)/2 + sqrt(pow((a - c)/2, 2) + b*b) as l1, sqrt(b*b + pow((a + c)/2 + sqrt(pow((a - c)/2, 2) + b*b) - a, 2)) as nn from cv{tag})"
    )


@query(
    "low_passed_projection",
    "AGG40 FIL2 AGG39",
    f"""with recursive {_PAIR_H}, {zero_phase_sql("h2", "member, mode", "t", *butterworth(4, 2 / 24, "low"))}, {_eigen_sql("")},
sg as (select tw.member, sign(arg_max(((u - mu)*b + (v - mv)*(l1 - a))/nn, abs(((u - mu)*b + (v - mv)*(l1 - a))/nn))) as s from tw join ev on tw.member = ev.member group by 1),
rw as (select member, t, max(case when mode = 'click' then value end) as u, max(case when mode = 'view' then value end) as v from h2 group by 1, 2)
select rw.member, t as month_idx, 'pc1' as mode, {rnd("s*((u - mu)*b + (v - mv)*(l1 - a))/nn", 5)} as value from rw join ev on rw.member = ev.member join sg on sg.member = rw.member""",
)
def low_passed_projection(spark, sf):
    """Leading mode of the low-passed pair of each member, and the unfiltered pair projected on it."""
    raw = _two_cells(spark, sf)
    pcs = M.principal_components(B.low_pass(raw, ["member", "cell"], 24), ["member"], ["cell"], 1)
    return pcs.transform(raw).withColumn("value", rounded("value", 5))


_BANDS = {"slow": ("low", [2 / 48]), "middle": ("band", [2 / 48, 2 / 12]), "fast": ("high", [2 / 12])}


@query(
    "separated_pair",
    "MOD10 FIL2 FIL3 FIL4",
    f"with recursive {_PAIR_H}, "
    + ", ".join(zero_phase_sql("h2", "member, mode", "t", *butterworth(4, cut, kind), name) + ", " + _eigen_sql(name) for name, (kind, cut) in _BANDS.items())
    + " "
    + " union all ".join(f"select member, '{name}' as band, {rnd('l1', 5)} as variance, {rnd('l1/(a + c)', 5)} as share from ev{name}" for name in _BANDS),
)
def separated_pair(spark, sf):
    """One mode per band of periods, from bands filtered apart first."""
    key = ["member", "cell"]
    bands = {
        "slow": lambda d: B.low_pass(d, key, 48),
        "middle": lambda d: B.band_pass(d, key, 48, 12),
        "fast": lambda d: B.high_pass(d, key, 12),
    }
    pcs = M.separated_modes(_two_cells(spark, sf), bands, ["member"], ["cell"], 1)
    return pcs.variance.select("member", "band", rounded("variance", 5).alias("variance"), rounded("share", 5).alias("share"))


@query(
    "ensemble_of_pair_fits",
    "MOD9",
    f"""with {_PAIR_H}, rw as (select t, sum(case when mode = 'click' then value end) as u, sum(case when mode = 'view' then value end) as v from h2 group by 1),
ft as (select seed, split from (select cast(unnest(range(0, 50)) as int) as seed) a cross join (select cast(unnest(range(0, 5)) as int) as split) b),
tr as (select split, t, row_number() over (partition by split order by t) - 1 as pos, count(*) over (partition by split) as n from (select distinct split from ft) s cross join rw where t % 5 <> split),
d0 as (select seed, split, (j*7919 + seed*104729 + split + 1) % 2147483647 as x from ft cross join (select unnest(range(0, 576)) as j) q),
d1 as (select seed, split, (x*x + 12345) % 2147483647 as x from d0), d2 as (select seed, split, (x*x + 678910) % 2147483647 as x from d1),
sm as (select seed, d2.split, u, v from d2 join tr on tr.split = d2.split and tr.pos = x % n join rw on rw.t = tr.t),
cv as (select seed, split, var_samp(u) as a, covar_samp(u, v) as b, var_samp(v) as c from sm group by 1, 2)
select seed, split, {rnd("(a + c)/2 + sqrt(pow((a - c)/2, 2) + b*b)", 5)} as variance, {rnd("((a + c)/2 + sqrt(pow((a - c)/2, 2) + b*b))/(a + c)", 5)} as share from cv""",
)
def ensemble_of_pair_fits(spark, sf):
    """Fifty resampled fits of each split on the pair summed over members."""
    pair = _two_cells(spark, sf).groupBy("cell", "month_idx").agg(F.sum("value").alias("value"))
    fits = spark.range(50).select(F.col("id").cast("int").alias("seed"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("split"))
    out = M.fit_ensemble(pair, fits, ["cell"], 1)
    return out.select("seed", "split", rounded("variance", 5).alias("variance"), rounded("share", 5).alias("share"))


# -- batch scoring -----------------------------------------------------------------------------


def _layer(rows: int, cols: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights by rule: sin(row + 2 col) / 2 and bias cos(row) / 4, counted from 1."""
    w = [[math.sin(r + 2 * c) / 2 for c in range(1, cols + 1)] for r in range(1, rows + 1)]
    return np.array(w), np.array([math.cos(r) / 4 for r in range(1, rows + 1)])


def _dense(name: str, src: str, rows: int, act: str) -> str:
    return (
        f"{name} as (select initialization, month_idx, o.r as c, {act}(sum(sin(o.r + 2*{src}.c)/2*{src}.v) + cos(o.r)/4) as v "
        f"from {src} cross join (select unnest(range(1, {rows + 1})) as r) o group by 1, 2, 3)"
    )


@query(
    "mlp_scoring",
    "MOD11",
    f"""with {X.ENCODINGS_SQL}, ok as (select initialization, month_idx from e group by 1, 2 having count(*) = 5),
i0 as (select e.initialization, e.month_idx, rank() over (partition by e.initialization, e.month_idx order by mode) as c, value as v from e join ok on e.initialization = ok.initialization and e.month_idx = ok.month_idx),
{_dense("i1", "i0", 8, "tanh")}, {_dense("i2", "i1", 6, "tanh")}, {_dense("i3", "i2", 3, "")}
select initialization, month_idx, cast(c as int) as node, {rnd("v")} as value from i3""",
)
def mlp_scoring(spark, sf):
    x = mode_vectors(X.encodings(spark, sf), ["initialization", "month_idx"], list(X.MODES))
    out = M.score_mlp(x, "vec", [_layer(8, 5), _layer(6, 8), _layer(3, 6)], "tanh")
    return out.select("initialization", "month_idx", F.posexplode("encoded").alias("p", "v")).select(
        "initialization", "month_idx", (F.col("p") + 1).alias("node"), rounded("v").alias("value")
    )


@query(
    "decoding_error",
    "AGG26 MOD2 JN1",
    f"""with {_BASE}, {_NORMED}, z as (select member, month_idx, mode, sum(w*value) as z from f join ln on f.lat_i = ln.lat_i and f.lon_i = ln.lon_i group by 1, 2, 3),
d as (select f.member, f.month_idx, f.lat_i, f.lon_i, any_value(value) as v, sum(w*z) as p from f join ln on f.lat_i = ln.lat_i and f.lon_i = ln.lon_i join z on z.member = f.member and z.month_idx = f.month_idx and z.mode = ln.mode group by 1, 2, 3, 4)
select member, {rnd("avg((v - p)*(v - p))", 4)} as mse from d group by 1""",
)
def decoding_error(spark, sf):
    field = X.field(spark, sf)
    base = X.loadings(field, 3)
    norm = base.groupBy("mode").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_n"))
    loadings = base.join(norm, "mode").withColumn("w", F.col("w") / F.col("_n")).drop("_n")
    series = M.encode(field, loadings, [1, 2, 3], ["member"])
    decoded = M.decode(field, series, loadings, [1, 2, 3], ["member"]).select(*A.CELL, "month_idx", F.col("decoded").alias("value"))
    return K.mean_squared_error(field, decoded, [*A.CELL, "month_idx"], ["member"]).withColumn("mse", rounded("mse", 4))
