"""Queries on spectra and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.functions.kernels import butterworth
from tidegrid.operators import anomaly as A
from tidegrid.operators import filters as B
from tidegrid.operators import modes as M
from tidegrid.operators import select as S
from tidegrid.operators import spectrum as P
from tidegrid.operators.gram import correlation_table
from tidegrid.plans import fixtures as X
from tidegrid.plans.registry import query, rnd, rounded
from tidegrid.sources.layout import store_by_cell

EVENTS = ["click", "error", "purchase", "signup", "view"]
SERIES = ["member", "mode"]

_DFT = f"""{X.HOURLY_SQL}, hc as (select member, mode, t, value - avg(value) over (partition by member, mode) as v from h),
ft as (select member, mode, k, sum(v*cos(2*pi()*k*t/720.0)) as re, sum(v*sin(2*pi()*k*t/720.0)) as im from hc cross join (select cast(unnest(range(0, 361)) as int) as k) q group by 1, 2, 3),
pw as (select member, mode, k, (re*re + im*im)/sum(re*re + im*im) over (partition by member, mode) as p, k/720.0 as f from ft)"""

# moving mean of seven with reflected ends, over power and frequency
_SMOOTH = (
    _DFT
    + """, kw as (select j - 3 as o, exp(-0.5*pow(-2 + 4*j/6.0, 2)) as w from (select unnest(range(0, 7)) as j) q), kn as (select o, w/(select sum(w) from kw) as w from kw),
ix as (select k, case when k + o < 0 then -(k + o) when k + o > 360 then 720 - (k + o) else k + o end as src, w from (select unnest(range(0, 361)) as k) q cross join kn),
s0 as (select member, mode, cast(ix.k as int) as k, sum(w*p) as p, sum(w*f) as freq from pw join ix on pw.k = ix.src group by 1, 2, 3),
sp as (select member, mode, k, freq, p/sum(p) over (partition by member, mode) as power from s0)"""
)


def _spec(spark, sf, smooth=7):
    return P.power_spectrum(X.hourly(spark, sf), SERIES, "t", "value", 1.0, smooth)


@query("power_spectrum", "SPC1 SPC2", f"""with {_DFT} select member, mode, k, {rnd("f")} as freq, {rnd("p")} as power from pw""")
def power_spectrum(spark, sf):
    return _spec(spark, sf, 0).withColumns({"freq": rounded("freq"), "power": rounded("power")})


@query(
    "fourier_sums",
    "SPC1",
    f"""with {X.HOURLY_SQL} select member, mode, k, {rnd("sum(value*cos(2*pi()*k*t/720.0))", 4)} as re, {rnd("sum(value*sin(2*pi()*k*t/720.0))", 4)} as im
from h cross join (select cast(unnest(range(1, 361)) as int) as k) q group by 1, 2, 3""",
)
def fourier_sums(spark, sf):
    out = P.fourier_power(X.hourly(spark, sf), SERIES, X.SERIES_HOURS)
    return out.select(*SERIES, "k", rounded("re", 4).alias("re"), rounded("im", 4).alias("im"))


@query("smoothed_spectrum", "SPC3 SPC2", f"""with {_SMOOTH} select member, mode, k, {rnd("freq")} as freq, {rnd("power")} as power from sp""")
def smoothed_spectrum(spark, sf):
    return _spec(spark, sf).withColumns({"freq": rounded("freq"), "power": rounded("power")})


@query(
    "spectral_summary",
    "SPC4 ORD2 WIN7",
    f"""with {_SMOOTH}, u as (select member, mode, arg_max(freq, power) as pk, sum(freq*power) as m, sum(freq*freq*power) as m2 from sp group by 1, 2)
select member, mode, {rnd("1/pk/12")} as peak_period, {rnd("1/m/12")} as mean_period, {rnd("sqrt(greatest(0.0, m2 - m*m))")} as spread from u""",
)
def spectral_summary(spark, sf):
    out = P.spectral_summary(_spec(spark, sf), SERIES)
    return out.select(*SERIES, *[rounded(c).alias(c) for c in ("peak_period", "mean_period", "spread")])


@query(
    "mode_order",
    "AGG43 WIN11 SPC4",
    f"""with {_SMOOTH}, u as (select member, mode, {rnd("1/arg_max(freq, power)/12")} as peak_period from sp group by 1, 2),
r as (select *, cast(row_number() over (partition by member order by peak_period desc, mode) as int) as rank from u)
select member, mode, peak_period, rank, ['Decadal', 'Interannual', 'Quasibiennial', 'HF1', 'HF2'][rank] as label from r""",
)
def mode_order(spark, sf):
    from tidegrid.schema import MODE_LABELS

    summary = P.spectral_summary(_spec(spark, sf), SERIES).select(*SERIES, rounded("peak_period").alias("peak_period"))
    return P.order_by_period(summary, ["member"], MODE_LABELS)


@query(
    "cumulative_spectrum",
    "WIN7",
    f"""with {_SMOOTH} select member, mode, k, {rnd("sum(power) over (partition by member, mode order by k)")} as cumulative from sp""",
)
def cumulative_spectrum(spark, sf):
    return P.cumulative_power(_spec(spark, sf), SERIES).select(*SERIES, "k", rounded("cumulative").alias("cumulative"))


_OVERLAP = (
    _SMOOTH
    + """, ov as (select a.member, a.mode as mode_a, b.mode as mode_b, sum(least(a.power, b.power)*case when a.k in (0, 360) then 0.5 else 1 end)/sum(greatest(a.power, b.power)*case when a.k in (0, 360) then 0.5 else 1 end) as overlap
from sp a join sp b on a.member = b.member and a.k = b.k group by 1, 2, 3)"""
)


@query("spectral_overlap", "SPC5", f"""with {_OVERLAP} select member, mode_a, mode_b, {rnd("overlap")} as overlap from ov""")
def spectral_overlap(spark, sf):
    return P.spectral_overlap(_spec(spark, sf), ["member"], EVENTS).withColumn("overlap", rounded("overlap"))


_SHARES = """, vs as (select member, mode, var_samp(value) as v from h group by 1, 2), sh as (select member, mode, v/sum(v) over (partition by member) as share from vs)"""
_NAMED = f""", {X.FIELD_SQL}, {X.LOADINGS_SQL}, ln as (select ['click', 'error', 'purchase', 'signup', 'view'][mode] as mode, lat_i, lon_i, w from l),
lc as (select a.mode as mode_a, b.mode as mode_b, case when a.mode = b.mode then 0 else abs(corr(a.w, b.w)) end + 1e-8 as r from ln a join ln b on a.lat_i = b.lat_i and a.lon_i = b.lon_i group by 1, 2)"""


def _shares(spark, sf):
    from pyspark.sql import Window

    v = X.hourly(spark, sf).groupBy(*SERIES).agg(F.var_samp("value").alias("v"))
    return v.select(*SERIES, (F.col("v") / F.sum("v").over(Window.partitionBy("member"))).alias("share"))


def _named_loadings(spark, sf):
    return X.loadings(X.field(spark, sf)).withColumn("mode", F.element_at(F.lit(EVENTS), F.col("mode")))


@query(
    "overlap_score",
    "SPC6 SPC5 SPC8",
    f"""with {_OVERLAP}{_SHARES}{_NAMED}, w0 as (select a.member, a.mode as mode_a, b.mode as mode_b, case when a.mode = b.mode then 0 else sqrt(a.share)*sqrt(b.share) end as w from sh a join sh b on a.member = b.member),
w1 as (select *, w/sum(w) over (partition by member) as wn from w0)
select ov.member, {rnd("sum(wn*overlap*(1 + lc.r))")} as score from ov join w1 on ov.member = w1.member and ov.mode_a = w1.mode_a and ov.mode_b = w1.mode_b join lc on lc.mode_a = ov.mode_a and lc.mode_b = ov.mode_b group by 1""",
)
def overlap_score(spark, sf):
    overlap = P.spectral_overlap(_spec(spark, sf), ["member"], EVENTS)
    alike = M.loading_correlations(_named_loadings(spark, sf), EVENTS)
    out = P.overlap_score(overlap, P.pair_weights(_shares(spark, sf), ["member"]), alike, ["member"])
    return out.withColumn("score", rounded("score"))


@query("loading_correlations", "SPC8 AGG19", f"""with {X.HOURLY_SQL}{_NAMED} select mode_a, mode_b, {rnd("r")} as r from lc""")
def loading_correlations(spark, sf):
    return P.off_diagonal(M.loading_correlations(_named_loadings(spark, sf), EVENTS)).withColumn("r", rounded("r"))


@query(
    "correlation_penalty",
    "SPC9 AGG19",
    f"""with {X.HOURLY_SQL}{_SHARES}, c as (select a.member, a.mode as mode_a, b.mode as mode_b, case when a.mode = b.mode then 0 else abs(corr(a.value, b.value)) end + 1e-8 as r from h a join h b on a.member = b.member and a.t = b.t group by 1, 2, 3)
select c.member, {rnd("sum(r*sa.share*sb.share)/sum(case when mode_a <> mode_b then sa.share*sb.share end)")} as penalty
from c join sh sa on sa.member = c.member and sa.mode = mode_a join sh sb on sb.member = c.member and sb.mode = mode_b group by 1""",
)
def correlation_penalty(spark, sf):
    corr = correlation_table(X.hourly(spark, sf), ["t"], EVENTS, ["member"])
    return P.correlation_penalty(corr, _shares(spark, sf), ["member"]).withColumn("penalty", rounded("penalty"))


@query(
    "centring_penalty",
    "SPC10",
    f"""with {X.HOURLY_SQL}, m as (select member, mode, avg(value) as m from h group by 1, 2) select member, {rnd("avg(abs(m))")} as penalty from m group by 1""",
)
def centring_penalty(spark, sf):
    return P.centring_penalty(X.hourly(spark, sf), ["member"], ["mode"]).withColumn("penalty", rounded("penalty"))


@query(
    "logistic_misfit",
    "SPC7 WIN7",
    f"""with {_SMOOTH}, cu as (select *, sum(power) over (partition by member, mode order by k)*(1 - 1e-5) as b, -5 + 10*k/360.0 as x from sp),
lg as (select member, mode, regr_slope(ln(b/(1 - b)), x) as s, regr_intercept(ln(b/(1 - b)), x) as i from cu group by 1, 2),
fi as (select cu.*, 1/(1 + exp(-(i + s*x))) as g from cu join lg on cu.member = lg.member and cu.mode = lg.mode),
bl as (select *, g*(1 - g)/sum(g*(1 - g)) over (partition by member, mode) as bell from fi), mf as (select member, mode, sum(abs(power - bell)) as misfit from bl group by 1, 2)
select member, {rnd("avg(misfit)")} as misfit from mf group by 1""",
)
def logistic_misfit(spark, sf):
    per_mode = P.logistic_misfit(_spec(spark, sf), SERIES, 2)
    return per_mode.groupBy("member").agg(rounded(F.avg("misfit")).alias("misfit"))


def _window_rows() -> str:
    cuts, width = [], 360
    while width > 10:
        cuts += [(s, width) for s in range(0, 720 - width - 1, width)] + [(720 - width - 1, width + 1)]
        width //= 2
    return ", ".join(f"({i}, {s}, {w})" for i, (s, w) in enumerate(cuts))


@query(
    "windowed_spectrum",
    "SPC11 WIN10 INT4",
    f"""with {X.HOURLY_SQL}, hc as (select member, mode, t, value - avg(value) over (partition by member, mode) as v from h), wn(id, s, w) as (values {_window_rows()}),
wf as (select member, mode, id, w, k, sum(v*cos(2*pi()*k*(t - s)/w)) as re, sum(v*sin(2*pi()*k*(t - s)/w)) as im from wn join hc on t >= s and t < s + w cross join (select unnest(range(0, 182)) as k) q where k <= w // 2 group by 1, 2, 3, 4, 5),
wp as (select member, mode, id, w, k, re*re + im*im as p from wf),
ax as (select id, w, a, least(a*w/720.0, w // 2) as pos from wn cross join (select unnest(range(0, 361)) as a) q),
ip as (select lo.member, lo.mode, ax.id, a, lo.p + (pos - floor(pos))*(coalesce(hi.p, lo.p) - lo.p) as y from ax join wp lo on lo.id = ax.id and lo.k = cast(floor(pos) as bigint) left join wp hi on hi.id = ax.id and hi.k = lo.k + 1 and hi.member = lo.member and hi.mode = lo.mode),
nm as (select *, y/max(y) over (partition by member, mode, id) as z from ip)
select member, mode, {rnd("avg(z)")} as measure from nm group by 1, 2""",
)
def windowed_spectrum(spark, sf):
    out = P.windowed_spectrum_mean(X.hourly(spark, sf), SERIES, "t")
    return out.withColumn("measure", rounded("measure"))


# -- filters -----------------------------------------------------------------------------------


def zero_phase_sql(src: str, keys: str, t: str, b, a, tag: str = "") -> str:
    """Both passes of the filter as recursive SQL on series held in lists; the result is ``zp<tag>(keys, i, y)``."""
    n, pad = len(a) - 1, 3 * len(a)
    level = sum(b) / sum(a)
    start = [sum(b[j] - a[j] * level for j in range(i + 1, n + 1)) for i in range(n)]
    num = repr

    def step(prev: str, x: str) -> str:
        y = f"({num(float(b[0]))}*{x} + {prev.format(i=1)})"
        z = [f"{num(float(b[i]))}*{x} - {num(float(a[i]))}*y" + (f" + {prev.format(i=i + 1)}" if i < n else "") for i in range(1, n + 1)]
        return y, ", ".join(f"{e} as z{i + 1}" for i, e in enumerate(z))

    def run(name: str, source: str) -> str:
        y0 = f"({num(float(b[0]))}*x[1] + {num(float(start[0]))}*x[1])"
        z0 = ", ".join(
            f"{num(float(b[i]))}*x[1] - {num(float(a[i]))}*{y0}" + (f" + {num(float(start[i]))}*x[1]" if i < n else "") + f" as z{i}" for i in range(1, n + 1)
        )
        y, zs = step("z{i}", "xt")
        cols = ", ".join(f"z{i}" for i in range(1, n + 1))
        return (
            f"{name}({keys}, i, y, {cols}) as (select {keys}, 1, {y0}, {z0} from {source} union all select {keys}, i, y, {zs} from "
            f"(select *, {y} as y from (select r.{keys.replace(', ', ', r.')}, r.i + 1 as i, {', '.join('r.z%d' % k for k in range(1, n + 1))}, s.x[r.i + 1] as xt "
            f"from {name} r join {source} s using ({keys}) where r.i < len(s.x)) q0) q1)"
        )

    return (
        f"sr{tag} as (select {keys}, list(value order by {t}) as v from {src} group by {keys}), "
        f"se{tag} as (select {keys}, list_concat(list_transform(range({pad}, 0, -1), lambda k: 2*v[1] - v[1 + k]), v, list_transform(range(1, {pad + 1}), lambda k: 2*v[len(v)] - v[len(v) - k])) as x from sr{tag}), "
        + run(f"fw{tag}", f"se{tag}")
        + f", sb{tag} as (select {keys}, list(y order by i desc) as x from fw{tag} group by {keys}), "
        + run(f"bw{tag}", f"sb{tag}")
        + f", zl{tag} as (select {keys}, list(y order by i desc) as x from bw{tag} group by {keys}), "
        f"zp{tag} as (select {keys}, unnest(range(0, len(x) - {2 * pad})) as i, unnest(x[{pad + 1}:len(x) - {pad}]) as y from zl{tag})"
    )


def _filter_sql(kind: str, cutoff) -> str:
    b, a = butterworth(4, cutoff, kind)
    return f"""with recursive {X.HOURLY_SQL}, {zero_phase_sql("h", "member, mode", "t", b, a)} select member, mode, cast(i as int) as t, {rnd("y", 5)} as value from zp"""


@query("low_pass", "FIL2", _filter_sql("low", 2 / 84))
def low_pass(spark, sf):
    return B.low_pass(X.hourly(spark, sf), SERIES, 84, "t").withColumn("value", rounded("value", 5))


@query("high_pass", "FIL3", _filter_sql("high", 2 / 36))
def high_pass(spark, sf):
    return B.high_pass(X.hourly(spark, sf), SERIES, 36, "t").withColumn("value", rounded("value", 5))


@query("band_pass", "FIL4", _filter_sql("band", [2 / 24, 2 / 6]))
def band_pass(spark, sf):
    return B.band_pass(X.hourly(spark, sf), SERIES, 24, 6, "t").withColumn("value", rounded("value", 5))


@query(
    "spectral_box",
    "FIL1",
    f"""with {_DFT}, kp as (select * from ft where k/720.0 <= 1/84.0 and k > 0)
select h.member, h.mode, h.t, {rnd("sum(re*cos(2*pi()*k*h.t/720.0) + im*sin(2*pi()*k*h.t/720.0))*2/720.0", 5)} as value from h join kp on h.member = kp.member and h.mode = kp.mode group by 1, 2, 3""",
)
def spectral_box(spark, sf):
    return B.low_pass(X.hourly(spark, sf), SERIES, 84, "t", method="fft").withColumn("value", rounded("value", 5))


@query("low_pass_cells", "FIL2 UDF1 PRJ16", None)
def low_pass_cells(spark, sf):
    """Every gap-free cell of the field, filtered as its own series."""
    whole = S.complete_cells(X.field(spark, sf), A.CELL)
    return B.low_pass(whole, A.CELL, 24).withColumn("value", rounded("value", 5))


# 720 hourly steps on 12 longitudes: the Kelvin preset keeps frequencies 2..12 and, on the mirrored
# wavenumber axis, columns 1..6, which are wavenumbers 5..10 of the transform
_WAVE = f"""{X.ZONAL_SQL}, kj as (select k, j from (select unnest(range(5, 11)) as k) a cross join (select unnest(range(2, 13)) as j) b),
wf as (select member, mode, k, j, sum(value*cos(2*pi()*(k*lon_i/12.0 + j*t/720.0))) as re, -sum(value*sin(2*pi()*(k*lon_i/12.0 + j*t/720.0))) as im from zh cross join kj group by 1, 2, 3, 4),
wy as (select zh.member, zh.mode, zh.lon_i, zh.t, sum(re*cos(2*pi()*(k*lon_i/12.0 + j*t/720.0)) - im*sin(2*pi()*(k*lon_i/12.0 + j*t/720.0)))*2/(12*720.0) as value
       from zh join wf on zh.member = wf.member and zh.mode = wf.mode group by 1, 2, 3, 4)"""


@query("wave_filter", "FIL5 FIL6", f"""with {_WAVE} select member, mode, lon_i, t, {rnd("value", 5)} as value from wy""")
def wave_filter(spark, sf):
    out = B.wave_band(X.zonal_hourly(spark, sf), SERIES, "kelvin", obs_per_day=24)
    return out.withColumn("value", rounded("value", 5))


@query(
    "wave_events",
    "FIL8 FIL5",
    f"""with {_WAVE}, th as (select member, mode, quantile_cont(abs(value), 0.9) as threshold from wy where abs(value) > 0 group by 1, 2)
select wy.member, wy.mode, lon_i, t, {rnd("threshold", 5)} as threshold, case when abs(value) > threshold then 1 else 0 end as event from wy join th on wy.member = th.member and wy.mode = th.mode""",
)
def wave_events(spark, sf):
    out = B.wave_band(X.zonal_hourly(spark, sf), SERIES, "kelvin", obs_per_day=24)
    return B.event_mask(out, SERIES, 0.9).select(*SERIES, "lon_i", "t", rounded("threshold", 5).alias("threshold"), "event")


# dispersion curve of the Kelvin preset on the mirrored axis i (wavenumber 11 - i of the transform), after
# Gaussian smoothing of one grid step along longitude with mirrored ends
_DISPERSION = f"""{X.ZONAL_SQL}, gw as (select o, exp(-0.5*o*o)/sum(exp(-0.5*o*o)) over () as w from (select unnest(range(-4, 5)) as o) q),
gi as (select lon_i, case when lon_i + o < 0 then -1 - (lon_i + o) when lon_i + o >= 12 then 23 - (lon_i + o) else lon_i + o end as src, w from (select unnest(range(0, 12)) as lon_i) q cross join gw),
zs as (select zh.member, zh.mode, cast(gi.lon_i as int) as lon_i, zh.t, sum(w*value) as value from zh join gi on zh.lon_i = gi.src group by 1, 2, 3, 4),
ij as (select i, j, case when i < 6 then i else i - 12 end/6.371008e6*(24*3600.0/(2*pi()*24))*720 as q from (select unnest(range(1, 7)) as i) a cross join (select unnest(range(2, 13)) as j) b),
kj as (select 11 - i as k, j from ij where j >= floor(q*sqrt(9.80665*8)) and j <= greatest(ceil(q*sqrt(9.80665*90)), 0)),
wf as (select member, mode, k, j, sum(value*cos(2*pi()*(k*lon_i/12.0 + j*t/720.0))) as re, -sum(value*sin(2*pi()*(k*lon_i/12.0 + j*t/720.0))) as im from zs cross join kj group by 1, 2, 3, 4)"""


@query(
    "wave_dispersion",
    "FIL5 FIL6 FIL7",
    f"""with {_DISPERSION} select zs.member, zs.mode, zs.lon_i, zs.t, {rnd("sum(re*cos(2*pi()*(k*lon_i/12.0 + j*t/720.0)) - im*sin(2*pi()*(k*lon_i/12.0 + j*t/720.0)))*2/(12*720.0)", 5)} as value
from zs join wf on zs.member = wf.member and zs.mode = wf.mode group by 1, 2, 3, 4""",
)
def wave_dispersion(spark, sf):
    """The preset with its dispersion curve, after smoothing along longitude."""
    out = B.wave_band(X.zonal_hourly(spark, sf), SERIES, "kelvin", obs_per_day=24, smooth=1.0, dispersion=True)
    return out.withColumn("value", rounded("value", 5))


# what is filtered: the presets, and the curves of equatorial waves in boxes of their own (days, wavenumbers, equivalent depths)
LANES = {
    "er": ("er", None),
    "mrg": ("mrg", None),
    "ig1": ("ig1", None),
    "mjo": ("mjo", None),
    "kelvin": ("kelvin", None),
    "mrg_curve": ("mrg", (2, 6, -250, 250, 8, 90)),
    "ig0_curve": ("ig0", (1.5, 6, 1, 14, 8, 90)),
    "ig2_curve": ("ig2", (0.8, 2, -15, -1, 12, 90)),
}
# the same boxes as rows of frequencies 0..360 and columns of the mirrored axis 0..11, and the curves as text
_LANES_SQL = """
lanes (wave, j0, j1, i0, i1, h0, h1, curve) as (values ('er', 1, 3, 6, 11, 8, 90, 'er'), ('mrg', 5, 15, 0, 11, null, null, 'mrg'), ('ig1', 12, 25, 6, 11, 12, 90, 'ig1'), ('mjo', 0, 1, 0, 6, null, null, 'mjo'),
 ('kelvin', 2, 12, 1, 6, 8, 90, 'kelvin'), ('mrg_curve', 5, 15, 0, 11, 8, 90, 'mrg'), ('ig0_curve', 5, 20, 1, 6, 8, 90, 'ig0'), ('ig2_curve', 15, 38, 6, 11, 12, 90, 'ig2')),
cells as (select lanes.*, cast(i as int) as i, cast(j as int) as j, case when i < 6 then i else i - 12 end/6.371008e6 as q, 2*7.292e-05/6.371008e6 as beta from lanes, (select unnest(range(0, 12)) as i) a, (select unnest(range(0, 361)) as j) b
 where j between j0 and j1 and i between i0 and i1),
bounds as (select *, unnest([0, 1]) as side, sqrt(9.80665*unnest([h0, h1])) as c from cells),
curves as (select *, case when curve = 'kelvin' then q*c when curve = 'er' then -beta*q/(q*q + 3*beta/c) when curve in ('mrg', 'ig0') and q = 0 then sqrt(beta*c)
 when curve in ('mrg', 'ig0') and q > 0 then q*c*(0.5 + 0.5*sqrt(1 + 4*beta/(q*q*c))) when curve in ('mrg', 'ig0') then q*c*(0.5 - 0.5*sqrt(1 + 4*beta/(q*q*c)))
 when curve = 'ig1' then sqrt(3*beta*c + q*q*c*c) when curve = 'ig2' then sqrt(5*beta*c + q*q*c*c) end*(24*3600.0/(2*pi()*24))*720 as row from bounds),
kj as (select wave, 11 - i as k, j from curves group by wave, i, j having max(case when side = 0 then row end) is null
 or (j >= least(floor(max(case when side = 0 then row end)), 361) and j <= greatest(ceil(max(case when side = 1 then row end)), 0)))"""


@query(
    "wave_presets",
    "FIL5 FIL6",
    f"""with {X.ZONAL_SQL}, {_LANES_SQL},
wf as (select wave, member, mode, k, j, sum(value*cos(2*pi()*(k*lon_i/12.0 + j*t/720.0))) as re, -sum(value*sin(2*pi()*(k*lon_i/12.0 + j*t/720.0))) as im from zh cross join kj group by 1, 2, 3, 4, 5),
wy as (select wave, zh.member, zh.mode, zh.lon_i, zh.t, sum((re*cos(2*pi()*(k*lon_i/12.0 + j*t/720.0)) - im*sin(2*pi()*(k*lon_i/12.0 + j*t/720.0)))*case when j = 0 then 1 else 2 end)/(12*720.0) as value
       from zh join wf on zh.member = wf.member and zh.mode = wf.mode group by 1, 2, 3, 4, 5),
ls as (select wave, member, mode from lanes cross join (select distinct member, mode from zh) s)
select wave, member, mode, {rnd("coalesce(variance, 0.0)")} as variance, cast(8640 as bigint) as n from ls left join (select wave, member, mode, var_pop(value) as variance from wy group by 1, 2, 3) v using (wave, member, mode)""",
)
def wave_presets(spark, sf):
    """Variance that each wave keeps within its box and its dispersion curve."""
    out, zonal = None, store_by_cell(X.zonal_hourly(spark, sf), SERIES, "t", X.hourly_tasks(spark, sf, X.N_LON * X.SERIES_HOURS))
    for name, (wave, box) in LANES.items():
        part = B.wave_band(zonal, SERIES, wave, obs_per_day=24, dispersion=True, box=box)
        part = part.groupBy(*SERIES).agg(rounded(F.var_pop("value")).alias("variance"), F.count("value").alias("n")).withColumn("wave", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "wave_filter_absent_step",
    "FIL5 FIL7 FIL8",
    f"""with {_WAVE}, hole as (select wy.*, member % 2 = 0 and mode = 'view' as gap from wy)
select member, mode, cast(lon_i as int) as lon_i, t, case when not gap then {rnd("value", 5)} end as value from hole
union all select member, 'none', lon_i, t, null from zh where mode = 'view'""",
)
def wave_filter_absent_step(spark, sf):
    """Slices that lack a step of the declared axis have NULL at every step: one lacks an hour, one a longitude, one all but its first hour."""
    zonal = X.zonal_hourly(spark, sf)
    gap = (F.col("member") % 2 == 0) & (F.col("mode") == "view")
    some = zonal.filter(~(gap & ((F.col("t") == 30) | (F.col("lon_i") == 11))))
    short = zonal.filter("mode = 'view' and t = 0").withColumn("mode", F.lit("none"))
    axes = {"times": B.Axis(0, 1, X.SERIES_HOURS), "longitudes": B.Axis(0, 1, X.N_LON)}
    out = B.wave_band(some.unionByName(short), SERIES, "kelvin", obs_per_day=24, **axes)
    return out.withColumn("value", rounded("value", 5))
