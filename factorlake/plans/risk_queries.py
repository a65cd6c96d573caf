"""Queries over returns, portfolios and forecasts: regressions, covariance, specific risk, state, scoring, analytics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorlake.config import RiskConfig, decay
from factorlake.functions.scalar import rounded, safe_ln
from factorlake.functions.timeseries import over
from factorlake.operators import baselines, covariance, regression, risk, specific, state, validation
from factorlake.plans.panel_queries import duck
from factorlake.sources.fixtures import filings, long_exposures, panel_q, panel_w, ports, table, vecx

#: Half-lives in weeks and limits at the scale of the sample tables.
CFG = RiskConfig(vol_half_life=26.0, corr_half_life=52.0, specific_half_life=26.0, vra_half_life=13.0, vra_names=5)
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# -- inputs ---------------------------------------------------------------------------------------------


def cross_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly returns (date, asset, r, x, industry, cap): log return on the quarter before, log volume."""
    rows = panel_q(spark, sf_dir).withColumn("r", F.ln(F.col("close") / F.lag("close").over(over("asset", "date"))))
    return rows.where("r is not null and volume > 0").select("date", "asset", "r", safe_ln(F.col("volume")).alias("x"), "industry", "cap")


def log_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel_w(spark, sf_dir)
    return p.select("asset", "date", (F.ln(F.col("close") / F.lag("close").over(over("asset", "date"))) / 10).alias("r")).where("r is not null")


def factor_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, factor, f): mean returns of five groups of suppliers."""
    return log_returns(spark, sf_dir).groupBy("date", F.concat(F.lit("f"), (F.col("asset") % 5).cast("string")).alias("factor")).agg(F.avg("r").alias("f"))


def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_returns(spark, sf_dir).withColumn("eps", F.col("r") - F.avg("r").over(Window.partitionBy("date"))).select("asset", "date", "eps")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, portfolio, realized_ret, forecast_vol_ann, realized_vol_ann, z): suppliers as portfolios."""
    vol = F.sqrt(52 * F.avg(F.col("r") ** 2).over(over("asset", "date").rowsBetween(-12, -1)))
    rows = log_returns(spark, sf_dir).withColumn("forecast_vol_ann", vol).where("forecast_vol_ann > 0")
    return rows.select("date", F.col("asset").cast("string").alias("portfolio"), F.col("r").alias("realized_ret"), "forecast_vol_ann", (F.sqrt(F.lit(52.0)) * F.abs("r")).alias("realized_vol_ann"), (F.col("r") / (F.col("forecast_vol_ann") / F.sqrt(F.lit(52.0)))).alias("z"))


DIMS = [f"x{i}" for i in range(10)]


def _ols(source: str, y: str, xs: list[str], by: str, centre: str) -> str:
    """DuckDB tables o0, o1, ... that regress y on xs with an intercept for each `centre`, one fit for each `by`: ols (by, n, b0, b1, ..., sse).

    Each regressor in turn is taken out of the later ones and of y; back substitution gives the slopes.
    """
    k = len(xs)
    out = [f"o0 as (select *, {y} - avg({y}) over (partition by {centre}) y_0, " + ", ".join(f"{x} - avg({x}) over (partition by {centre}) x{i}_0" for i, x in enumerate(xs)) + f" from {source})"]
    for j in range(k):
        over_x = f"over (partition by {by}) / nullif(sum(x{j}_{j} ** 2) over (partition by {by}), 0)"
        out.append(f"g{j} as (select *, coalesce(sum(x{j}_{j} * y_{j}) {over_x}, 0) c{j}" + "".join(f", coalesce(sum(x{j}_{j} * x{i}_{j}) {over_x}, 0) g{j}_{i}" for i in range(j + 1, k)) + f" from o{j})")
        out.append(f"o{j + 1} as (select *, y_{j} - c{j} * x{j}_{j} y_{j + 1}" + "".join(f", x{i}_{j} - g{j}_{i} * x{j}_{j} x{i}_{j + 1}" for i in range(j + 1, k)) + f" from g{j})")
    firsts = "".join(f", any_value(c{j}) c{j}" + "".join(f", any_value(g{j}_{i}) g{j}_{i}" for i in range(j + 1, k)) for j in range(k))
    out.append(f"oc as (select {by}, count(*) n, sum(y_{k} ** 2) sse{firsts} from o{k} group by {by})")
    slopes = "".join(f", c{j}" + "".join(f" - g{j}_{i} * b{i}" for i in range(j + 1, k)) + f" b{j}" for j in reversed(range(k)))
    out.append(f"ols as (select {by}, n, sse{slopes} from oc)")
    return ",\n".join(out)


_XS = """-- more
xs as (select date, asset, r, ln(volume) x, industry, cap from (select *, ln(close / lag(close) over (partition by asset order by date)) r from panel_q) where r is not null and volume > 0)"""
_LR = """-- more
lr as (select asset, date, r from (select asset, date, ln(close / lag(close) over (partition by asset order by date)) / 10 r from panel_w) where r is not null)"""
_FR = _LR + ",\nfr as (select date, 'f' || (asset % 5) factor, avg(r) f from lr group by all)"
_RES = _LR + ",\nres as (select asset, date, r - avg(r) over (partition by date) eps from lr)"
_SC = _LR + """,
v as (select *, sqrt(52 * avg(r ** 2) over (partition by asset order by date rows between 12 preceding and 1 preceding)) fv from lr),
sc as (select date, asset::varchar portfolio, r realized_ret, fv forecast_vol_ann, sqrt(52.0::double) * abs(r) realized_vol_ann, r / (fv / sqrt(52.0::double)) z from v where fv > 0)"""
_UNPIVOT = "ex as (select asset, 'x' || i factor, embedding[i + 1]::double x from (select vec_id asset, embedding from embeddings), range(0, 10) t(i))"
_COV = "cov as (select 'x' || i f1, 'x' || j f2, (0.04 * pow(0.5::double, abs(i - j)))::double cov from range(0, 10) a(i), range(0, 10) b(j))"
_SPEC = "spec as (select vec_id asset, 0.1 + (vec_id % 7) / 50.0::double vol from embeddings)"
_VPORTS = """vp as (select 'p' || p portfolio, vec_id asset, ((vec_id * 7 + p) % 11 - 4) / 100.0::double w from embeddings, range(0, 8) t(p) where (vec_id + p) % 3 = 0)"""


def model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Weights of eight portfolios, exposures, a covariance and specific volatilities over the embeddings."""
    wide = vecx(spark, sf_dir)
    cov = covariance.to_long(spark, np.array([[0.04 * 0.5 ** abs(i - j) for j in range(10)] for i in range(10)]), DIMS)
    spec = wide.select("asset", (0.1 + (F.col("asset") % 7) / 50.0).alias("vol"))
    weights = wide.select("asset", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("p")).where("(asset + p) % 3 = 0")
    weights = weights.select(F.concat(F.lit("p"), F.col("p").cast("string")).alias("portfolio"), "asset", (((F.col("asset") * 7 + F.col("p")) % 11 - 4) / 100.0).alias("w"))
    return weights, long_exposures(wide, DIMS), cov, spec


# -- regressions ----------------------------------------------------------------------------------------

_WLS = _XS + """,
mn as (select date, industry, sum(cap) c, sum(sqrt(cap) * r) / sum(sqrt(cap)) rb, sum(sqrt(cap) * x) / sum(sqrt(cap)) xb from xs group by all),
sl as (select date, sum(sqrt(cap) * (x - xb) * (r - rb)) / nullif(sum(sqrt(cap) * (x - xb) * (x - xb)), 0) f from xs join mn using (date, industry) group by date),
al as (select mn.date, industry, c, rb - coalesce(f, 0) * xb a, f, sum(c * (rb - coalesce(f, 0) * xb)) over (partition by mn.date) / sum(c) over (partition by mn.date) m from mn join sl using (date))"""


@query(duck("panel_q", body=_WLS + "\nselect date, 'ind_' || industry as key, round(a - m, 6) + 0.0 as value from al union all select date, 'market', round(max(m), 6) + 0.0 from al group by date union all select date, 'x', round(max(f), 6) + 0.0 from al group by date"))
def wls_industry_style(spark, sf_dir):
    out = regression.industry_style(cross_section(spark, sf_dir), "r", "x", "industry", "cap")
    return out.select("date", "key", rounded(F.col("value")).alias("value"))


@query(duck("panel_q", body=_WLS + """,
e as (select xs.date, sqrt(cap) w, r, r - m - coalesce(f, 0) * x - (a - m) e from xs join al using (date, industry)),
d as (select *, r - sum(w * r) over (partition by date) / sum(w) over (partition by date) d from e)
select date, round(1 - sum(w * e * e) / sum(w * d * d), 6) r2, count(*) n from d group by date"""))
def wls_r2(spark, sf_dir):
    xs = cross_section(spark, sf_dir)
    rows, r2 = regression.residuals_r2(xs, regression.industry_style(xs, "r", "x", "industry", "cap"), "r", "x", "industry", "cap")
    return r2.join(rows.groupBy("date").agg(F.count("*").alias("n")), "date").select("date", rounded(F.col("r2")).alias("r2"), "n")


@query()
def wls_full_k(spark, sf_dir):
    xs = cross_section(spark, sf_dir).withColumn("x2", F.ln("cap"))
    return regression.fit_dates(xs, ["x", "x2"]).where("kind <> 'residual'").withColumn("value", rounded(F.col("value")))


# -- covariance -----------------------------------------------------------------------------------------

_DAYS = """,
days as (select date, 0.5::double ** ((row_number() over (order by date desc) - 1) / 52.0::double) w from (select distinct date from fr)),
mo as (select a.factor f1, b.factor f2, sum(w * a.f * b.f) / sum(w) moment from fr a join fr b using (date) join days using (date) group by all)"""


@query(duck("panel_w", body=_FR + _DAYS + "\nselect f1, f2, round(moment * 10000, 6) + 0.0 moment from mo"))
def ewma_cov_batch(spark, sf_dir):
    m = covariance.ewma_moments(factor_returns(spark, sf_dir), 52.0)
    return m.select("f1", "f2", rounded(F.col("moment") * 10000).alias("moment"))


@query(duck("panel_w", body=_FR + _DAYS + """
select m.f1, m.f2, round(case when m.f1 = m.f2 then 1 else greatest(least(m.moment / sqrt(a.moment * b.moment), 1), -1) end, 6) + 0.0 corr from mo m join mo a on a.f1 = m.f1 and a.f2 = m.f1 join mo b on b.f1 = m.f2 and b.f2 = m.f2"""))
def ewma_corr(spark, sf_dir):
    c = covariance.correlation(covariance.ewma_moments(factor_returns(spark, sf_dir), 52.0))
    return c.select("f1", "f2", rounded(F.col("corr")).alias("corr"))


def _newey(source: str, key: str, value: str, lags: int) -> str:
    lag = ", ".join(f"{value} * lag({value}, {i}) over (partition by {key} order by date) p{i}" for i in range(1, lags + 1))
    sums = ", ".join(f"sum(w * p{i}) s{i}" for i in range(1, lags + 1))
    total = " + ".join(f"{2 * (1 - i / (lags + 1))}::double * coalesce(s{i}, 0) / w0" for i in range(1, lags + 1))
    return f""",
k as (select *, 0.5::double ** ((row_number() over (partition by {key} order by date desc) - 1) / 26.0::double) w, {lag} from {source} where {value} is not null),
s as (select {key}, sum(w * {value} ** 2) / sum(w) raw, sum(w) w0, count(*) n, {sums} from k group by {key}),
nw as (select {key}, raw, n, raw * greatest(least((raw + {total}) / raw, 2), 0.5) adjusted from s)"""


@query(duck("panel_w", body=_FR + _newey("fr", "factor", "f", 5) + "\nselect factor, round(raw * 10000, 6) raw, round(adjusted * 10000, 6) adjusted, n from nw"))
def newey_west_var(spark, sf_dir):
    nw = covariance.newey_west(factor_returns(spark, sf_dir), 26.0, 5)
    return nw.select("factor", rounded(F.col("raw") * 10000).alias("raw"), rounded(F.col("adjusted") * 10000).alias("adjusted"), "n")


@query(duck("panel_w", body=_FR + _DAYS + """,
c as (select m.f1, m.f2, m.moment / sqrt(a.moment * b.moment) corr from mo m join mo a on a.f1 = m.f1 and a.f2 = m.f1 join mo b on b.f1 = m.f2 and b.f2 = m.f2)
select f1, round(avg(abs(corr)), 6) mean_abs, round(max(corr), 6) largest from c where f1 <> f2 group by f1"""))
def factor_correlation(spark, sf_dir):
    c = covariance.correlation(covariance.ewma_moments(factor_returns(spark, sf_dir), 52.0)).where("f1 <> f2")
    return c.groupBy("f1").agg(rounded(F.avg(F.abs("corr"))).alias("mean_abs"), rounded(F.max("corr")).alias("largest"))


def _factors(fr: DataFrame) -> list[str]:
    names = [r[0] for r in fr.select("factor").distinct().orderBy("factor").limit(covariance.MOST_FACTORS + 1).collect()]
    if len(names) > covariance.MOST_FACTORS:
        raise ValueError(f"more than {covariance.MOST_FACTORS} factors")
    return names


@query()
def pca_blend_psd(spark, sf_dir):
    fr = factor_returns(spark, sf_dir)
    names = _factors(fr)
    return covariance.to_long(spark, covariance.factor_covariance(fr, names, CFG), names).withColumn("cov", rounded(F.col("cov")))


@query()
def eigen_bias(spark, sf_dir):
    fr = factor_returns(spark, sf_dir)
    names = _factors(fr)
    return covariance.to_long(spark, covariance.factor_covariance(fr, names, CFG, mode="eigen"), names).withColumn("cov", rounded(F.col("cov")))


# -- specific risk --------------------------------------------------------------------------------------

_SPECIFIC = _RES + _newey("res", "asset", "eps", 1) + """,
sv as (select asset, case when n >= 63 then sqrt(adjusted * 252) end ts_vol, n n_obs from nw)"""


@query(duck("panel_w", body=_SPECIFIC + "\nselect asset, round(ts_vol, 6) ts_vol, n_obs from sv"))
def specific_ewma(spark, sf_dir):
    return specific.ewma_volatility(residuals(spark, sf_dir), CFG).select("asset", rounded(F.col("ts_vol")).alias("ts_vol"), "n_obs")


@query(duck("panel_w", body=_SPECIFIC + """,
b as (select *, 1.5 + (asset % 5) / 10.0::double st, case when ts_vol is null or asset % 9 = 0 then 0 else n_obs / (n_obs + 126.0::double) end w from sv)
select asset, round(w, 6) blend_weight, round(case when ts_vol is null or asset % 9 = 0 then st else w * ts_vol + (1 - w) * st end, 6) vol from b"""))
def specific_blend(spark, sf_dir):
    own = specific.ewma_volatility(residuals(spark, sf_dir), CFG).withColumn("ts_vol", F.when(F.col("asset") % 9 != 0, F.col("ts_vol"))).withColumn("structural", 1.5 + (F.col("asset") % 5) / 10.0)
    return specific.blended(own, CFG).select("asset", rounded(F.col("blend_weight")).alias("blend_weight"), rounded(F.col("vol")).alias("vol"))


@query(duck("panel_q", body="""-- more
v as (select asset, date, ln(close) / 10 vol, ln(cap) size from panel_q where volume > 0),
k as (select *, row_number() over (partition by date order by size, asset) k, count(*) over (partition by date) n from v),
b as (select *, least(floor(k * 10 / n), 9) b from k), m as (select *, avg(vol) over (partition by date, b) m, stddev_pop(vol) over (partition by date, b) d from b),
f as (select *, 0.1::double * abs(vol - m) / (d + 0.1::double * abs(vol - m)) f from m)
select asset, date, round(case when n >= 50 and d > 0 then f * m + (1 - f) * vol else vol end, 6) vol from f"""))
def bayes_shrink(spark, sf_dir):
    rows = panel_q(spark, sf_dir).where("volume > 0").select("asset", "date", (F.ln("close") / 10).alias("vol"), F.ln("cap").alias("size"))
    return specific.shrink(rows, CFG, by=["date"]).select("asset", "date", rounded(F.col("vol")).alias("vol"))


@query(duck("panel_w", "vecx", body=_SPECIFIC + """,
wd as (select v.asset, industry::varchar industry, x0 size, x1 volatility, x2 liquidity, ts_vol, 1 fit from vecx v left join sv using (asset)),
fit as (select *, ln(ts_vol) y from wd where ts_vol > 0),
""" + _ols("fit", "y", ["size", "volatility", "liquidity"], "fit", "industry") + """,
mi as (select industry, avg(y) my, avg(size) m0, avg(volatility) m1, avg(liquidity) m2 from fit group by industry),
mo as (select avg(y) my, avg(size) m0, avg(volatility) m1, avg(liquidity) m2, count(*) n from fit),
gs as (select wd.*, exp(coalesce(mi.my, mo.my) + b0 * (size - coalesce(mi.m0, mo.m0)) + b1 * (volatility - coalesce(mi.m1, mo.m1)) + b2 * (liquidity - coalesce(mi.m2, mo.m2))) guess
  from wd left join mi using (industry) cross join mo cross join ols where mo.n >= 5),
bd as (select avg(ts_vol / guess) smear, quantile_cont(ts_vol, 0.01) low, quantile_cont(ts_vol, 0.99) high from gs where ts_vol > 0)
select asset, round(least(greatest(guess * smear, low), 1.5 * high), 6) structural, round(ts_vol, 6) ts_vol from gs, bd"""))
def structural_prior(spark, sf_dir):
    own = specific.ewma_volatility(residuals(spark, sf_dir), CFG)
    wide = vecx(spark, sf_dir).select("asset", F.col("industry").cast("string").alias("industry"), F.col("x0").alias("size"), F.col("x1").alias("volatility"), F.col("x2").alias("liquidity"))
    return specific.structural(wide.join(own, "asset", "left"), RiskConfig(least_structural=5)).select("asset", rounded(F.col("structural")).alias("structural"), rounded(F.col("ts_vol")).alias("ts_vol"))


# -- state ----------------------------------------------------------------------------------------------

_K26, _K13 = f"{decay(26.0)!r}::double", f"{decay(13.0)!r}::double"


@query(duck("panel_w", body=_FR + f""",
n as (select *, row_number() over (partition by factor order by date) i from fr),
v as (select *, (1 - {_K26}) * {_K26} ** (i - 1) * sum(f ** 2 * {_K26} ** (-i)) over (partition by factor order by date rows between unbounded preceding and 1 preceding) v from n),
b as (select date, avg(least(f ** 2 / v, 6.25)) b from v where i > 26 and v > 0 group by date),
m as (select *, row_number() over (order by date) j from b),
s as (select date, b, {_K13} ** j + (1 - {_K13}) * {_K13} ** j * sum(b * {_K13} ** (-j)) over (order by date) state from m)
select date, round(b, 6) b, round(greatest(least(sqrt(state), 2), 0.5), 6) multiplier from s"""))
def vra_multiplier(spark, sf_dir):
    return state.vra_factor(factor_returns(spark, sf_dir), CFG).select("date", rounded(F.col("b")).alias("b"), rounded(F.col("multiplier")).alias("multiplier"))


@query(duck("panel_w", body=_RES + f""",
n as (select *, row_number() over (partition by asset order by date) i from res),
v as (select asset, date, i n, {_K26} ** i * sum(case when i = 1 then 1 else 1 - {_K26} end * eps ** 2 * {_K26} ** (-i)) over (partition by asset order by date) v from n)
select asset, date, n, round(v, 6) v from v"""))
def asset_state(spark, sf_dir):
    return state.asset_variance(residuals(spark, sf_dir), CFG).select("asset", "date", "n", rounded(F.col("var")).alias("v"))


@query(duck("panel_w", body=_FR + """,
rs as (select asset, date, r - avg(r) over (partition by date) eps from lr),
ex as (select distinct asset, date_trunc('month', date)::date mo, 'f' || g factor, ((asset * 3 + g) % 7 - 3) / 5.0::double x from lr, range(0, 5) t(g)),
dy as (select ex.asset, mo, fr.date, sum(x * f) s from ex join fr on ex.factor = fr.factor and date_trunc('month', fr.date) = mo group by all)
select mo as month, dy.asset, round(product(1 + s + eps) - 1, 6) + 0.0 r from dy join rs using (asset, date) group by all"""))
def weekly_reconstruct(spark, sf_dir):
    lr = log_returns(spark, sf_dir)
    held = lr.select("asset", F.trunc("date", "month").alias("week")).distinct().withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(4))))
    ex = held.select("asset", "week", F.concat(F.lit("f"), F.col("g").cast("string")).alias("factor"), (((F.col("asset") * 3 + F.col("g")) % 7 - 3) / 5.0).alias("x"))
    days = lr.select("date").distinct().withColumn("week", F.trunc("date", "month"))
    out = state.weekly_returns(ex, factor_returns(spark, sf_dir), residuals(spark, sf_dir), days)
    return out.select(F.col("week").alias("month"), "asset", rounded(F.col("r")).alias("r"))


# -- portfolios -----------------------------------------------------------------------------------------

_MODEL = "with " + ",\n".join([_UNPIVOT, _COV, _SPEC, _VPORTS])
_X = """,
px as (select portfolio, factor, sum(w * x) x from vp join ex using (asset) group by all),
pm as (select a.portfolio, a.factor, a.x, sum(cov * b.x) g from px a join cov on f1 = a.factor join px b on b.portfolio = a.portfolio and b.factor = f2 group by all)"""
_RISK = _X + """,
fv as (select portfolio, sum(x * g) fv from pm group by portfolio), sv as (select portfolio, sum(w ** 2 * vol ** 2) sv from vp join spec using (asset) group by portfolio)"""


@query(duck("ports", "vecx", body="""-- more
e as (select asset, 'x' || i factor, case i when 0 then x0 when 1 then x1 else x2 end x from vecx, range(0, 3) t(i))
select portfolio, factor, round(sum(w * x), 6) + 0.0 x from ports join e using (asset) group by all"""))
def factor_exposures(spark, sf_dir):
    x = risk.factor_exposures(ports(spark, sf_dir), long_exposures(vecx(spark, sf_dir, 3), ["x0", "x1", "x2"]))
    return x.select("portfolio", "factor", rounded(F.col("x")).alias("x"))


@query(_MODEL + _RISK + "\nselect portfolio, round(fv, 6) factor_var, round(sv, 6) specific_var, round(sqrt(fv + sv), 6) total_vol, round(fv / (fv + sv), 6) factor_share from fv join sv using (portfolio)")
def portfolio_risk(spark, sf_dir):
    r = risk.risk(*model(spark, sf_dir))
    return r.select("portfolio", *[rounded(F.col(c)).alias(c) for c in r.columns[1:]])


@query(_MODEL + _X + """,
k as (select *, row_number() over (partition by portfolio order by abs(x * g) desc, factor) k from pm)
select portfolio, factor, round(x, 6) + 0.0 x, round(x * g, 6) + 0.0 contribution, k::int rank from k where k <= 5""")
def factor_contributions(spark, sf_dir):
    weights, exposures, cov, _ = model(spark, sf_dir)
    rows = risk.top(risk.factor_contributions(weights, exposures, cov), "contribution", 5, "factor")
    return rows.select("portfolio", "factor", rounded(F.col("x")).alias("x"), rounded(F.col("contribution")).alias("contribution"), "rank")


@query(_MODEL + _RISK + """,
ac as (select vp.portfolio, asset, w, w * (sum(ex.x * g) + any_value(vol) ** 2 * w) c from vp join ex using (asset) join pm using (portfolio, factor) join spec using (asset) group by vp.portfolio, asset, w),
t as (select *, c / sqrt(sum(c) over (partition by portfolio)) contribution from ac)
select portfolio, asset, round(w, 6) + 0.0 w, round(contribution, 6) + 0.0 contribution from t""")
def asset_contributions(spark, sf_dir):
    rows = risk.asset_contributions(*model(spark, sf_dir))
    return rows.select("portfolio", "asset", rounded(F.col("w")).alias("w"), rounded(F.col("contribution")).alias("contribution"))


@query(duck("ports", body="""
select portfolio, count(*) n, count(p_partkey) n_covered, round(sum(abs(w)), 6) gross, round(1 - sum(case when p_partkey is null then abs(w) else 0 end) / sum(abs(w)), 6) + 0.0 coverage
from ports left join (select p_partkey from part where p_size > 10) on p_partkey = asset group by portfolio"""))
def coverage_ratio(spark, sf_dir):
    known = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("asset"))
    return risk.coverage(ports(spark, sf_dir), known).select("portfolio", "n", "n_covered", rounded(F.col("gross")).alias("gross"), rounded(F.col("coverage")).alias("coverage"))


@query(_MODEL + _X + """,
sh as (select * from (values ('crash', 'x0', -0.2), ('crash', 'x3', 0.1), ('calm', 'x1', 0.05)) t(scenario, factor, shock))
select scenario, portfolio, round(sum(x * shock), 6) + 0.0 impact from px join sh using (factor) group by all""")
def stress_test(spark, sf_dir):
    weights, exposures, _, _ = model(spark, sf_dir)
    shocks = spark.createDataFrame([("crash", "x0", -0.2), ("crash", "x3", 0.1), ("calm", "x1", 0.05)], "scenario string, factor string, shock double")
    return risk.stress(weights, exposures, shocks).select("scenario", "portfolio", rounded(F.col("impact")).alias("impact"))


@query(_MODEL + """,
av as (select a.asset, sum(a.x * cov * b.x) v from ex a join cov on f1 = a.factor join ex b on b.asset = a.asset and b.factor = f2 group by a.asset)
select asset, round(sqrt(v), 6) factor_vol, round(vol, 6) specific_vol, round(sqrt(v + vol ** 2), 6) total_vol from av join spec using (asset)""")
def asset_risk(spark, sf_dir):
    _, exposures, cov, spec = model(spark, sf_dir)
    rows = risk.asset_risk(exposures, cov, spec)
    return rows.select("asset", *[rounded(F.col(c)).alias(c) for c in rows.columns[1:]])


@query(duck("panel_q", body="""-- more
c as (select *, ln(close) x, count(*) over (partition by date) n from panel_q where cap > 0),
q as (select date, quantile_cont(x, 0.2) lo, quantile_cont(x, 0.8) hi from c where n >= 100 group by date),
s as (select c.date, asset, case when x >= hi then 1 when x <= lo then -1 end side from c join q using (date) where n >= 100),
k as (select *, count(*) over (partition by date, side) n from s where side is not null)
select date, 'style_price' portfolio, asset, round(side / n, 8) w from k where n >= 10"""))
def test_portfolios_style(spark, sf_dir):
    rows = panel_q(spark, sf_dir).withColumn("price", F.ln("close"))
    return validation.style_portfolios(rows, ["price"]).select("date", "portfolio", "asset", F.round("w", 8).alias("w"))


@query(duck("panel_q", body="""-- more
c as (select *, count(*) over (partition by date) n, count(*) over (partition by date, industry) k from panel_q where cap > 0)
select date, 'market' portfolio, asset, round(cap / sum(cap) over (partition by date), 8) w from c where n >= 100
union all select date, 'equal_weight', asset, round(1.0 / n, 8) from c where n >= 100
union all select date, 'industry_' || industry, asset, round(cap / sum(cap) over (partition by date, industry), 8) from c where k >= 15"""))
def test_portfolios_simple(spark, sf_dir):
    rows = panel_q(spark, sf_dir)
    out = validation.simple_portfolios(rows).unionByName(validation.industry_portfolios(rows))
    return out.select("date", "portfolio", "asset", F.round("w", 8).alias("w"))


@query(duck("panel_q", body="""-- more
k as (select date, i, asset, row_number() over (partition by date, i order by md5(i || ':' || date || ':' || asset), asset) k from panel_q, range(1, 4) t(i)),
b as (select *, count(*) over (partition by date, i) n from k where k <= 50)
select date, 'random_' || i portfolio, asset, round(1.0 / n, 8) w from b"""))
def random_baskets(spark, sf_dir):
    return validation.random_baskets(panel_q(spark, sf_dir), 3, 50).select("date", "portfolio", "asset", F.round("w", 8).alias("w"))


@query()
def minvar_weights(spark, sf_dir):
    wide = vecx(spark, sf_dir).withColumns({"cap": F.lit(1.0) + F.col("asset") % 13, "var": (0.1 + (F.col("asset") % 7) / 50.0) ** 2, "alpha": F.lit(1.0)})
    w = validation.minimum_risk(wide, DIMS, np.array([[0.04 * 0.5 ** abs(i - j) for j in range(10)] for i in range(10)]))
    return w.select("asset", rounded(F.col("w"), 8).alias("w"))


# -- scoring and baselines ------------------------------------------------------------------------------


@query(duck("panel_w", body=_LR + """,
wt as (select distinct date_trunc('quarter', date)::date as week, (asset % 4)::varchar portfolio, asset from lr), wn as (select *, 1.0::double / count(*) over (partition by week, portfolio) w from wt),
d as (select wn.week, portfolio, lr.date, sum(w * r) rp from wn join lr on lr.asset = wn.asset and date_trunc('quarter', lr.date) = week group by all)
select week::date as quarter, portfolio, round(case when count(*) >= 3 then sqrt(52 * sum(rp ** 2)) end, 6) realized_vol_ann from d group by all"""))
def realized_vol(spark, sf_dir):
    lr = log_returns(spark, sf_dir).withColumn("week", F.trunc("date", "quarter"))
    held = lr.select("week", (F.col("asset") % 4).cast("string").alias("portfolio"), "asset").distinct()
    held = held.withColumn("w", 1.0 / F.count("*").over(Window.partitionBy("week", "portfolio")))
    out = validation.realized_volatility(held, lr, ["week", "portfolio"])
    return out.select(F.col("week").alias("quarter"), "portfolio", rounded(F.col("realized_vol_ann")).alias("realized_vol_ann"))


@query(_MODEL + _RISK + """,
rr as (select vp.portfolio, sum(w * ((asset % 17) - 8) / 100.0::double) r from vp group by portfolio)
select portfolio, 'p' || right(portfolio, 1) as "group", date '2024-01-05' date, round(sqrt(252 * (fv + sv)), 6) forecast_vol_ann, round(r, 6) + 0.0 realized_ret, round(r / sqrt(5 * (fv + sv)), 6) + 0.0 z from fv join sv using (portfolio) join rr using (portfolio)""")
def score_z(spark, sf_dir):
    weights, exposures, cov, spec = model(spark, sf_dir)
    day = F.lit("2024-01-05").cast("date")
    returns = spec.select("asset", ((F.col("asset") % 17 - 8) / 100.0).alias("r"), day.alias("date"))
    own = spec.select("asset", (F.col("vol") ** 2).alias("var"), day.alias("date"))
    out = validation.score(weights.withColumn("date", day), exposures.withColumn("date", day), cov, own, returns, CFG)
    return out.select("portfolio", "group", "date", *[rounded(F.col(c)).alias(c) for c in ("forecast_vol_ann", "realized_ret", "z")])


@query(duck("panel_w", body=_SC + """
select portfolio, count(z) n, round(stddev_samp(z), 6) bias, round(avg((abs(z) > 1.96)::int), 6) exceed, round(avg(forecast_vol_ann), 6) mean_forecast, round(avg(realized_vol_ann), 6) mean_realized,
 round(sqrt(avg(realized_vol_ann ** 2)) / sqrt(avg(forecast_vol_ann ** 2)), 6) vol_ratio from sc group by portfolio having count(z) >= 30"""))
def bias_summary(spark, sf_dir):
    s = validation.summary(scores(spark, sf_dir))
    return s.select("portfolio", "n", *[rounded(F.col(c)).alias(c) for c in ("bias", "exceed", "mean_forecast", "mean_realized", "vol_ratio")])


_EWMA = """,
i as (select *, row_number() over (partition by portfolio order by date) i from sc),
ew as (select *, 0.94::double ** (i - 1) * sum(case when i = 1 then 1 else 0.06::double end * realized_ret ** 2 * 0.94::double ** (-i)) over p v1, 0.94::double ** (i - 1) * sum(case when i = 1 then 1 else 0.06::double end * realized_vol_ann ** 2 / 52 * 0.94::double ** (-i)) over p v2,
 avg(realized_ret ** 2) over q t1 from i window p as (partition by portfolio order by date rows between unbounded preceding and 1 preceding), q as (partition by portfolio order by date rows between 26 preceding and 1 preceding)),
fc as (select date, portfolio, realized_ret, realized_vol_ann, forecast_vol_ann, case when i > 26 then sqrt(52 * v1) end ewma, case when i > 26 then sqrt(52 * t1) end as "trailing", case when i > 26 then sqrt(52 * v2) end realized_ewma from ew)"""


@query(duck("panel_w", body=_SC + _EWMA + "\nselect date, portfolio, round(ewma, 6) ewma, round(realized_ewma, 6) realized_ewma from fc"))
def baseline_ewma(spark, sf_dir):
    rows = baselines.baseline_forecasts(scores(spark, sf_dir), CFG)
    return rows.select("date", "portfolio", rounded(F.col("ewma")).alias("ewma"), rounded(F.col("realized_ewma")).alias("realized_ewma"))


@query(duck("panel_w", body=_SC + _EWMA + '\nselect date, portfolio, round("trailing", 6) as "trailing" from fc'))
def baseline_trailing(spark, sf_dir):
    return baselines.trailing_volatility(scores(spark, sf_dir), "realized_ret", "trailing", CFG).select("date", "portfolio", rounded(F.col("trailing")).alias("trailing"))


@query(duck("panel_w", body=_SC + _EWMA + """,
u as (select m model, case m when 'forecast_vol_ann' then forecast_vol_ann when 'ewma' then ewma else "trailing" end fc, realized_ret r, realized_vol_ann rv from fc, (values ('forecast_vol_ann'), ('ewma'), ('trailing')) t(m) where ewma is not null and "trailing" is not null)
select model, count(*) n, round(stddev_samp(r / (fc / sqrt(52.0::double))), 6) bias, round(avg((abs(r / (fc / sqrt(52.0::double))) > 1.96)::int), 6) exceed, round(sqrt(avg(rv ** 2) / avg(fc ** 2)), 6) vol_ratio,
 round(regr_slope(rv ** 2, fc ** 2), 5) mz_slope, round(regr_r2(rv ** 2, fc ** 2), 6) mz_r2, round(avg(ln(fc ** 2) + rv ** 2 / fc ** 2), 6) qlike, round(sqrt(avg((fc - rv) ** 2)), 6) rmse from u group by model"""))
def harness_stats(spark, sf_dir):
    rows = baselines.harness(baselines.baseline_forecasts(scores(spark, sf_dir), CFG), ["forecast_vol_ann", "ewma", "trailing"])
    return rows.select("model", "n", *[rounded(F.col(c), 5 if c == "mz_slope" else 6).alias(c) for c in rows.columns[2:]])


_MONTHLY = _SC + """,
m as (select portfolio, date_trunc('month', date)::date mo, product(1 + realized_ret) - 1 ret, arg_min(forecast_vol_ann, date) / sqrt(52.0::double) vol, count(*) as weeks from sc group by all),
t as (select *, min(mo) over (partition by portfolio) a, max(mo) over (partition by portfolio) z from m), b as (select portfolio, mo, ret / (vol * sqrt(weeks)) b from t where mo > a and mo < z),
rb as (select portfolio, mo, b, case when count(b) over w = 12 and date_diff('month', first_value(mo) over w, mo) = 11 then stddev_samp(b) over w end rolling_bias from b window w as (partition by portfolio order by mo rows 11 preceding))"""


@query(duck("panel_w", body=_MONTHLY + "\nselect portfolio, mo as month, round(b, 6) + 0.0 b, round(rolling_bias, 6) rolling_bias from rb"))
def monthly_rolling_bias(spark, sf_dir):
    rows = baselines.monthly_bias(scores(spark, sf_dir))
    return rows.select("portfolio", "month", rounded(F.col("b")).alias("b"), rounded(F.col("rolling_bias")).alias("rolling_bias"))


@query(duck("panel_w", body=_MONTHLY + ",\ne as (select *, count(*) over (partition by portfolio) n from rb)\nselect count(distinct mo) n_months, count(rolling_bias) n_windows, round(avg(rolling_bias), 6) mean_bias, round(avg(abs(rolling_bias - 1)), 6) mrad from e where n >= 13"))
def rolling_protocol(spark, sf_dir):
    rows = baselines.rolling_protocol(scores(spark, sf_dir))
    return rows.select("n_months", "n_windows", rounded(F.col("mean_bias")).alias("mean_bias"), rounded(F.col("mrad")).alias("mrad"))


@query(duck("panel_w", body=_SC + """,
s as (select portfolio, count(z) n, stddev_samp(z) bias from sc group by portfolio having count(z) >= 30)
select portfolio, n, round(bias, 6) bias, round(1 - 1.96 / sqrt(2.0::double * n), 6) low, round(1 + 1.96 / sqrt(2.0::double * n), 6) high, abs(bias - 1) <= 1.96 / sqrt(2.0::double * n) inside from s"""))
def ci_bands(spark, sf_dir):
    rows = baselines.bias_bands(scores(spark, sf_dir))
    return rows.select("portfolio", "n", *[rounded(F.col(c)).alias(c) for c in ("bias", "low", "high")], "inside")


@query(duck("panel_w", body=_FR + ",\nt as (select factor, f / nullif(stddev_samp(f) over (partition by factor order by date rows 12 preceding), 0) t from fr)\nselect factor, count(*) n, round(avg((abs(t) > 2)::int), 6) share, round(avg(abs(t)), 6) mean_abs_t from t where t is not null group by factor"))
def factor_significance(spark, sf_dir):
    t = F.try_divide(F.col("f"), F.stddev_samp("f").over(over("factor", "date").rowsBetween(-12, 0)))
    rows = baselines.factor_significance(factor_returns(spark, sf_dir).withColumn("t", t))
    return rows.select("factor", "n", rounded(F.col("share")).alias("share"), rounded(F.col("mean_abs_t")).alias("mean_abs_t"))


_WIDE = ",\nwf as (select date, " + ", ".join(f"max(f) filter (factor = 'f{i}') f{i}" for i in range(5)) + " from fr group by date)"


@query(duck("panel_w", body=_FR + _WIDE + f""",
jt as (select asset::varchar ticker, lr.r, wf.*, row_number() over (partition by asset order by date desc) k from lr join wf using (date) where {" and ".join(f"f{i} is not null" for i in range(5))}),
rc as (select * from jt where k <= {CFG.returns_window}),
""" + _ols("rc", "r", [f"f{i}" for i in range(5)], "ticker", "ticker") + f"""
select ticker, 'f' || i factor, round(case i when 0 then b0 when 1 then b1 when 2 then b2 when 3 then b3 else b4 end, 6) + 0.0 beta, n from ols, range(0, 5) t(i) where n >= {CFG.least_returns}"""))
def rbsa_exposures(spark, sf_dir):
    wide = factor_returns(spark, sf_dir).groupBy("date").pivot("factor", [f"f{i}" for i in range(5)]).agg(F.first("f"))
    funds = log_returns(spark, sf_dir).select("date", F.col("asset").cast("string").alias("ticker"), "r")
    out = baselines.returns_based_exposures(wide, funds, [f"f{i}" for i in range(5)], CFG)
    return out.withColumn("beta", rounded(F.col("beta")))


@query(duck("panel_w", body=_SC + ",\nfr as (select date, 'f' || (asset % 5) factor, avg(r) f from lr group by all)" + _WIDE + f""",
jn as (select portfolio, realized_ret, wf.*, row_number() over (partition by portfolio order by date) i from sc join wf using (date) where {" and ".join(f"f{i} is not null" for i in range(5))}),
cv as (select *, {", ".join(f"sum(f{a} * f{b} * {CFG.riskmetrics_decay}::double ** (-i)) over p / sum({CFG.riskmetrics_decay}::double ** (-i)) over p v{a}{b}" for a in range(5) for b in range(a, 5))}
  from jn window p as (partition by portfolio order by date rows between unbounded preceding and 1 preceding)),
wn as (select a.portfolio || '|' || a.i win, b.realized_ret, b.f0, b.f1, b.f2, b.f3, b.f4 from jn a join jn b on a.portfolio = b.portfolio and b.i between a.i - {CFG.french_window} and a.i - 1 where a.i > {CFG.french_window}),
""" + _ols("wn", "realized_ret", [f"f{i}" for i in range(5)], "win", "win") + f"""
select portfolio, date, round(sqrt({CFG.weeks_per_year} * greatest({" + ".join(f"{1 if a == b else 2} * b{a} * b{b} * v{a}{b}" for a in range(5) for b in range(a, 5))} + sse / {CFG.french_window - 6}, 0)), 6) ff
from cv join ols on ols.win = portfolio || '|' || i"""))
def ff_rolling(spark, sf_dir):
    wide = factor_returns(spark, sf_dir).groupBy("date").pivot("factor", [f"f{i}" for i in range(5)]).agg(F.first("f"))
    return baselines.french_forecasts(scores(spark, sf_dir), wide, CFG).withColumn("ff", rounded(F.col("ff")))


@query(duck("filings", body="""-- more
f as (select asset filer, filed::date filed, "end", case when field = 'purchase' then val end equity from filings),
s as (select filer, min(filed) first_filed, max(filed) last_filed, arg_max(equity, struct_pack(a := "end", b := filed, c := equity)) filter (equity is not null) last_equity from f group by filer)
select filer, first_filed, last_filed, round(last_equity, 4) last_equity, case when date_diff('day', last_filed, (select max(filed) from f)) <= 2 then 'active' when last_filed >= date '2024-01-10' then 'ceased' else 'before' end status from s"""))
def survivorship_audit(spark, sf_dir):
    f = filings(spark, sf_dir).select(F.col("asset").alias("filer"), F.col("filed").cast("date").alias("filed"), "end", F.when(F.col("field") == "purchase", F.col("val")).alias("equity"))
    rows = baselines.survivorship(f, "2024-01-10", 2)
    return rows.select("filer", "first_filed", "last_filed", rounded(F.col("last_equity"), 4).alias("last_equity"), "status")

