"""Queries over the model's larger parts: price features, styles, recursions of any length, replayed scores, snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorlake.config import STYLES, RiskConfig, decay
from factorlake.functions.scalar import rounded
from factorlake.functions.timeseries import Ewma, with_ewmas
from factorlake.operators import baselines, covariance, risk, specific, styles
from factorlake.plans import report, revalidation, risk_queries, snapshots
from factorlake.plans.panel_queries import _DENSE, duck
from factorlake.plans.risk_queries import _FR, _MODEL, _RISK, _SC, _XS, _ols, cross_section
from factorlake.sources.fixtures import panel_w, table
from factorlake.streaming.state_stream import work_folder

#: Windows in weeks at the scale of the sample tables.
CFG = RiskConfig(momentum_skip=4, momentum_window=52, beta_window=52, liquidity_window=8, periods_per_year=52)
#: A formation date every so many weeks.
EVERY = 13
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# -- recursions of any length ---------------------------------------------------------------------------


@query(duck("panel_w", body="""-- more
n as (select *, row_number() over (partition by asset order by date) i, close / 1e3 c from panel_w),
t as (select a.asset, a.date, a.i, b.i j, b.c from n a join n b on a.asset = b.asset and b.i between a.i - 40 and a.i)
select asset, date, round(sum((1 - 0.0625) * c * 0.0625 ** (i - j)), 6) state, round(sum(case when j = 1 then 1 else 1 - 0.0625 end * c * 0.0625 ** (i - j)), 6) seeded,
  round(sum(case when j < i then (1 - 0.0625) * c * 0.0625 ** (i - 1 - j) end), 6) as before from t group by all"""))
def ewma_blocked(spark, sf_dir):
    """Four half-lives a row, so that a history of 358 rows takes three blocks."""
    c = F.col("close") / 1e3
    rows = with_ewmas(panel_w(spark, sf_dir), "asset", "date", 2.0**-4, {"state": Ewma(c), "seeded": Ewma(c, seeded=True), "before": Ewma(c, before=True)})
    return rows.select("asset", "date", *[rounded(F.col(x)).alias(x) for x in ("state", "seeded", "before")])


# -- styles ---------------------------------------------------------------------------------------------

_FEATURES = _DENSE + """,
dn as (select date, row_number() over (order by date) day_no from cal),
px as (select *, filled / lag(filled) over w - 1 r, lag(filled, 4) over w / lag(filled, 56) over w - 1 momentum,
    median(close * volume) over (partition by asset order by date rows between 7 preceding and current row) dollar_median from f join dn using (date) window w as (partition by asset order by date))"""


@query(duck("panel_w", body=_FEATURES + "\nselect asset, date, day_no, round(filled, 5) filled, round(momentum, 6) + 0.0 momentum, round(dollar_median, 4) dollar_median, round(r, 6) + 0.0 r from px"))
def price_features(spark, sf_dir):
    rows = styles.price_features(panel_w(spark, sf_dir), CFG)
    return rows.select("asset", "date", "day_no", rounded(F.col("filled"), 5).alias("filled"), rounded(F.col("momentum")).alias("momentum"), rounded(F.col("dollar_median"), 4).alias("dollar_median"), rounded(F.col("r")).alias("r"))


def _keep(spark: SparkSession) -> Callable[[DataFrame, str], DataFrame]:
    """Writes a table that several steps read, in a shared folder of its own."""
    work = work_folder(spark)

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{work}/{name}")
        return spark.read.parquet(f"{work}/{name}")

    return keep


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' balances as fundamentals, known every EVERY weeks: (as_of, asset, fields..., sales_growth)."""
    prices = panel_w(spark, sf_dir)
    day = prices.select("date").distinct().withColumn("day_no", F.row_number().over(Window.orderBy("date"))).where(F.col("day_no") % EVERY == 0)
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("asset"), F.col("s_acctbal").alias("bal"))
    rows = prices.join(day, "date").join(own, "asset").withColumnRenamed("date", "as_of")
    of = lambda m, c: F.when(F.col("asset") % m != 0, c)
    rows = rows.withColumn("total_assets", 5000 + F.abs("bal") + F.col("volume")).withColumn("net_income", F.col("bal") * 0.1 - (F.col("asset") % 7) * 20).withColumn("revenues", 1000 + F.col("volume") * 30)
    return rows.select(
        "as_of", "asset", F.col("bal").alias("book_equity"), "total_assets", (F.col("total_assets") - F.col("bal")).alias("total_liabilities"), "net_income", (1000.0 + F.col("asset") * 10).alias("shares_out"),
        of(5, F.col("net_income") + F.col("volume")).alias("op_cashflow"), "revenues", F.when(F.col("asset") % 3 == 0, F.col("revenues") * 0.4).alias("gross_profit"),
        of(4, F.col("revenues") * 0.7 + F.col("asset") % 11).alias("cost_of_revenue"), of(6, (F.col("asset") % 13 - 6) / 20.0).alias("sales_growth"))


def industries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("asset"), F.concat(F.lit("n"), (F.col("s_nationkey") % 5).cast("string")).alias("industry"))


def fit_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("asset")).where("asset % 10 <> 0")


_FORMED = _FEATURES + f""",
fu as (select date as_of, asset, s_acctbal book_equity, 5000 + abs(s_acctbal) + volume total_assets, 5000 + abs(s_acctbal) + volume - s_acctbal total_liabilities, s_acctbal * 0.1 - (asset % 7) * 20 net_income,
    1000.0 + asset * 10 shares_out, case when asset % 5 <> 0 then s_acctbal * 0.1 - (asset % 7) * 20 + volume end op_cashflow, 1000 + volume * 30 revenues, case when asset % 3 = 0 then (1000 + volume * 30) * 0.4 end gross_profit,
    case when asset % 4 <> 0 then (1000 + volume * 30) * 0.7 + asset % 11 end cost_of_revenue, case when asset % 6 <> 0 then (asset % 13 - 6) / 20.0 end sales_growth, 'n' || (s_nationkey % 5) industry
  from panel_w join dn using (date) join supplier on s_suppkey = asset where day_no % {EVERY} = 0),
fo as (select fu.*, day_no, filled * shares_out cap, momentum, dollar_median, asset % 10 <> 0 in_fit from fu join px using (asset) where px.date = as_of and filled * shares_out > 0),
mk as (select as_of, p.day_no, sum(cap * r) / sum(cap) m from fo join px p on p.asset = fo.asset and p.day_no between fo.day_no - 51 and fo.day_no where in_fit and r is not null group by all),
bs as (select fo.as_of, fo.asset, count(*) n, regr_slope(r, m) b, regr_syy(r, m) syy, regr_sxy(r, m) sxy from fo join px p on p.asset = fo.asset and p.day_no between fo.day_no - 51 and fo.day_no join mk on mk.as_of = fo.as_of and mk.day_no = p.day_no
  where r is not null and m is not null group by all),
bv as (select as_of, asset, case when n >= 26 then b end beta, case when n >= 26 then sqrt(greatest(syy - b * sxy, 0) / n * 52) end volatility from bs)"""


@query(duck("panel_w", body=_FORMED + "\nselect as_of, asset, round(beta, 5) + 0.0 beta, round(volatility, 5) + 0.0 volatility from bv"))
def beta_volatility(spark, sf_dir):
    keep = _keep(spark)
    panel = keep(styles.price_features(panel_w(spark, sf_dir), CFG).select("date", "asset", "day_no", "filled", "r"), "price-features")
    caps = fundamentals(spark, sf_dir).select("as_of", "asset", "shares_out").join(panel.select(F.col("date").alias("as_of"), "asset", "filled"), ["as_of", "asset"])
    formed = caps.select("as_of", "asset", (F.col("filled") * F.col("shares_out")).alias("cap"), (F.col("asset") % 10 != 0).alias("in_fit"))
    return styles.beta_volatility(panel, keep(formed, "formed"), CFG).select("as_of", "asset", rounded(F.col("beta"), 5).alias("beta"), rounded(F.col("volatility"), 5).alias("volatility"))


def _clipped(source: str, to: str, columns: list[str]) -> str:
    stats = ", ".join(f"avg({c}) filter (in_fit) over w m_{c}, stddev_samp({c}) filter (in_fit) over w s_{c}" for c in columns)
    made = ", ".join(f"case when s_{c} > 0 and {c} is not null then greatest(least({c}, m_{c} + 3 * s_{c}), m_{c} - 3 * s_{c}) else {c} end as {c}" for c in columns)
    return f"{to} as (select * exclude ({', '.join(f'm_{c}, s_{c}' for c in columns)}) replace ({made}) from (select *, {stats} from {source} window w as (partition by as_of)))"


def _scored(source: str, to: str, columns: list[str]) -> str:
    ok = {c: f"filter ({c} is not null and cap > 0 and in_fit) over w" for c in columns}
    stats = ", ".join(f"count({c}) {ok[c]} n_{c}, sum({c} * cap) {ok[c]} / sum(cap) {ok[c]} m_{c}, stddev_samp({c}) {ok[c]} s_{c}" for c in columns)
    made = ", ".join(f"case when n_{c} >= 2 and s_{c} > 0 then ({c} - m_{c}) / s_{c} end as {c}" for c in columns)
    return f"{to} as (select * exclude ({', '.join(f'n_{c}, m_{c}, s_{c}' for c in columns)}) replace ({made}) from (select *, {stats} from {source} window w as (partition by as_of)))"


_PARTS = [d for ds in styles.DESCRIPTORS.values() for d in ds]
_mean = lambda cs: f"({' + '.join(f'coalesce({c}, 0)' for c in cs)}) / nullif({' + '.join(f'({c} is not null)::int' for c in cs)}, 0)"
_STYLED = _FORMED + """,
d0 as (select fo.*, beta, volatility, ln(cap) size, case when dollar_median / cap > 0 then ln(dollar_median / cap) end liquidity, sales_growth growth,
    case when book_equity > 0 then book_equity end be, case when revenues > 0 then revenues end rev, coalesce(gross_profit, revenues - cost_of_revenue) gross from fo left join bv using (as_of, asset)),
d1 as (select *, be / cap book_to_price, net_income / cap earnings_to_price, op_cashflow / cap cashflow_to_price, rev / cap sales_to_price, net_income / be return_on_equity, net_income / nullif(total_assets, 0) return_on_assets,
    op_cashflow / nullif(total_assets, 0) cashflow_to_assets, gross / rev gross_margin, total_liabilities / nullif(total_assets, 0) debt_to_assets, total_liabilities / be debt_to_equity, total_liabilities / nullif(total_liabilities + cap, 0) market_leverage from d0),
d2 as (select * replace (""" + ", ".join(f"coalesce({c}, median({c}) over w) as {c}" for c in [*_PARTS, "growth"]) + """) from d1 window w as (partition by as_of, industry)),
""" + ",\n".join([_clipped("d2", "d3", _PARTS), _clipped("d3", "d4", _PARTS), _scored("d4", "d5", _PARTS)]) + """,
e0 as (select *, """ + ", ".join(f"{_mean(ds)} {name}" for name, ds in styles.DESCRIPTORS.items()) + """ from d5),
""" + ",\n".join([_clipped("e0", "e1", list(STYLES)), _clipped("e1", "e2", list(STYLES)), _scored("e2", "e3", list(STYLES))]) + """,
e4 as (select * replace (""" + ", ".join(f"coalesce({c}, 0) as {c}" for c in STYLES) + """) from e3),
o0 as (select *, volatility y, var_pop(beta) filter (in_fit) over w v, volatility - regr_intercept(volatility, beta) filter (in_fit) over w - regr_slope(volatility, beta) filter (in_fit) over w * beta e from e4 window w as (partition by as_of)),
""" + _scored("o0", "o1", ["e"]) + """
select as_of date, asset, round(cap, 2) cap, industry, in_fit, """ + ", ".join(f"round({c}, 4) + 0.0 {c}" for c in STYLES if c != "volatility") + ", round(case when v > 0 then coalesce(e, 0) else y end, 4) + 0.0 volatility from o1"


@query(duck("panel_w", body=_STYLED))
def style_exposures(spark, sf_dir):
    rows = styles.style_exposures(panel_w(spark, sf_dir), fundamentals(spark, sf_dir), industries(spark, sf_dir), CFG, fit_universe(spark, sf_dir), _keep(spark))
    return rows.select("date", "asset", F.round("cap", 2).alias("cap"), "industry", "in_fit", *[rounded(F.col(c), 4).alias(c) for c in STYLES])


# -- replayed scores ------------------------------------------------------------------------------------

#: Quarters as days, two to a week; the regime is held at 1, so that SQL can follow.
REPLAY = RiskConfig(covariance_mode="none", vra_clip=(1.0, 1.0), vol_half_life=4.0, corr_half_life=8.0, specific_half_life=4.0, least_specific_obs=4, warm_up=6)


def history_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Quarterly returns of parts as a model folder's tables: market, size and industry factors, residuals, snapshots of every second quarter."""
    xs = cross_section(spark, sf_dir).withColumn("r", F.col("r") / 10).withColumn("industry", F.concat(F.lit("g"), (F.substring("industry", 7, 1).cast("int") % 3).cast("string")))
    # Read by everything below; days and industries are summed, and what rows need of them comes as a row for each.
    xs = _keep(spark)(xs, "cross-section")
    days = xs.groupBy("date").agg(F.avg("r").alias("m"), F.avg("x").alias("mean_x"), F.stddev_samp("x").alias("dev_x")).withColumnRenamed("date", "day")
    xs = xs.join(F.broadcast(days), F.col("date").eqNullSafe(F.col("day"))).drop("day")
    groups = xs.groupBy(F.struct("date", "industry").alias("at")).agg(F.avg(F.col("r") - F.col("m")).alias("i"))
    xs = xs.withColumn("at", F.struct("date", "industry")).join(F.broadcast(groups), "at").drop("at")
    returns = xs.groupBy("date").agg(F.avg("r").alias("market"), F.regr_slope("r", "x").alias("size")).select("date", F.expr("stack(2, 'market', market, 'size', size) as (factor, f)"))
    returns = returns.unionByName(xs.groupBy("date", F.concat(F.lit("ind_"), "industry").alias("factor")).agg(F.avg(F.col("r") - F.col("m")).alias("f"))).where("f is not null")
    nth = xs.select("date").distinct().withColumn("k", F.row_number().over(Window.orderBy("date"))).where("k % 2 = 0")
    size = (F.col("x") - F.col("mean_x")) / F.col("dev_x")
    snapshots = xs.join(F.broadcast(nth), "date").select("date", "asset", "cap", "industry", size.alias("size"), *[F.lit(0.0).alias(s) for s in STYLES if s != "size"])
    return {"factor_returns": returns, "residuals": xs.select("date", "asset", (F.col("r") - F.col("m") - F.col("i")).alias("eps")), "exposure_history": snapshots}


_HISTORY = _XS + f""",
ra as (select date, asset, r / 10 r, x, 'g' || (industry[7:7]::int % 3) industry, cap from xs),
rm as (select *, avg(r) over (partition by date) m from ra),
fr as (select date, 'market' factor, avg(r) f from ra group by date union all select date, 'size', regr_slope(r, x) from ra group by date union all select date, 'ind_' || industry, avg(r - m) from rm group by date, industry),
rs as (select date, asset, r - m - avg(r - m) over (partition by date, industry) eps from rm),
eh as (select date, asset, cap, industry, size from (select *, (x - avg(x) over (partition by date)) / stddev_samp(x) over (partition by date) size, dense_rank() over (order by date) k from ra) where k % 2 = 0),
wk as (select * from (select date, lead(date) over (order by date) as until from (select distinct date from eh)) where until is not null),
wr as (select wk.* from wk where (select count(distinct fr.date) from fr where fr.date <= wk.date) >= 6),
dy as (select wr.date, d.date as day from wr join (select distinct date from fr) d on d.date > wr.date and d.date <= wr.until),
tn as (select dy.date, asset from dy join rs on rs.date = dy.day group by all having count(*) = any_value((select count(*) from dy e where e.date = dy.date))),
sn as (select eh.* from eh join wr using (date) join tn using (date, asset)),
pr as (select a.date, a.factor f1, b.factor f2, a.f * b.f p, row_number() over (partition by a.factor, b.factor order by a.date) i from fr a join fr b using (date)),
mo as (select w.date, f1, f2, sum(p * 0.5 ** ((n - i) / 8.0::double)) / sum(0.5 ** ((n - i) / 8.0::double)) m from (select wr.date, f1, f2, p, i, max(i) over (partition by wr.date, f1, f2) n from wr join pr on pr.date <= wr.date) w group by all),
fl as (select *, row_number() over w i, """ + ", ".join(f"coalesce(f * lag(f, {i}) over w, 0) p{i}" for i in range(1, 6)) + """ from fr window w as (partition by factor order by date)),
fs as (select date, factor, sum(k * f * f) s0, sum(k) w0, """ + " + ".join(f"{2 * (1 - i / 6)}::double * sum(k * p{i})" for i in range(1, 6)) + """ + sum(k * f * f) t
  from (select wr.date, l.* exclude (date), 0.5 ** ((max(i) over (partition by wr.date, factor) - i) / 4.0::double) k from wr join fl l on l.date <= wr.date) group by all),
fv as (select date, factor, s0 / w0 * greatest(least(t / s0, 2), 0.5) v from fs),
co as (select m.date, m.f1, m.f2, case when m.f1 = m.f2 then 1 else greatest(least(m.m / sqrt(a.m * b.m), 1), -1) end * sqrt(v1.v * v2.v) cov from mo m join mo a on a.date = m.date and a.f1 = m.f1 and a.f2 = m.f1 join mo b on b.date = m.date and b.f1 = m.f2 and b.f2 = m.f2
  join fv v1 on v1.date = m.date and v1.factor = m.f1 join fv v2 on v2.date = m.date and v2.factor = m.f2)"""
_REPLAYED = _HISTORY + """,
sl as (select *, row_number() over w i, coalesce(eps * lag(eps) over w, 0) p from rs window w as (partition by asset order by date)),
sv as (select date, asset, max(i) n, sum(k * case when i = 1 then 1 else d end * eps * eps) v, sum(k * d * p) g
  from (select wr.date, l.* exclude (date), 0.5 ** ((max(i) over (partition by wr.date, asset) - i) / 4.0::double) k, 1 - 0.5 ** (1 / 4.0::double) d from wr join sl l on l.date <= wr.date) group by all),
so as (select sn.*, case when n >= 4 then v * greatest(least((v + g) / v, 2), 0.5) end v from sn left join sv using (date, asset)),
sm as (select date, asset, size, sqrt(coalesce(v, median(v) over (partition by date))) vol from so),
sk as (select *, least(floor(row_number() over (partition by date, vol is null order by size, asset) * 10 / count(*) over (partition by date, vol is null)), 9) b, count(*) over (partition by date, vol is null) n from sm),
sb as (select *, avg(vol) over (partition by date, vol is null, b) m, stddev_pop(vol) over (partition by date, vol is null, b) d from sk),
sp as (select date, asset, case when n >= 50 and d > 0 then (0.1::double * abs(vol - m) / (d + 0.1::double * abs(vol - m))) * m + (1 - 0.1::double * abs(vol - m) / (d + 0.1::double * abs(vol - m))) * vol else vol end ** 2 as var from sb),
nn as (select *, count(*) over (partition by date) n from sn where cap > 0),
st as (select *, quantile_cont(size, 0.2) over (partition by date) lo, quantile_cont(size, 0.8) over (partition by date) hi from nn where n >= 100),
si as (select *, count(*) over (partition by date, industry) ni from sn where cap > 0),
rb as (select date, i, asset, row_number() over (partition by date, i order by md5(i || ':' || date || ':' || asset), asset) k from sn, range(1, 4) t(i)),
po as (select date, 'market' portfolio, asset, cap / sum(cap) over (partition by date) w from nn where n >= 100 union all select date, 'equal_weight', asset, 1.0::double / n from nn where n >= 100
  union all select date, 'style_size', asset, case when size <= lo then -1.0::double / count_if(size <= lo) over (partition by date) when size >= hi then 1.0::double / count_if(size >= hi) over (partition by date) end from st
  union all select date, 'style_' || s, asset, -1.0::double / n from nn, unnest([""" + ", ".join(f"'{s}'" for s in STYLES if s != "size") + """]) u(s) where n >= 100
  union all select date, 'industry_' || industry, asset, cap / sum(cap) over (partition by date, industry) from si where ni >= 15 and industry <> 'Other'
  union all select date, 'random_' || i, asset, 1.0::double / count(*) over (partition by date, i) from rb where k <= 50),
ex as (select date, asset, 'market' factor, 1.0::double x from sn union all select date, asset, 'size', size from sn union all select date, asset, 'ind_' || industry, 1.0 from sn),
dr as (select dy.date, dy.day, ex.asset, sum(x * f) s from dy join ex using (date) join fr on fr.date = dy.day and fr.factor = ex.factor group by all),
wt as (select dr.date, dr.asset, product(1 + s + eps) - 1 r from dr join rs on rs.date = dr.day and rs.asset = dr.asset group by all),
px as (select date, portfolio, factor, sum(w * x) x from po join ex using (date, asset) where w is not null group by all),
pf as (select a.date, a.portfolio, sum(a.x * cov * b.x) v from px a join px b using (date, portfolio) join co on co.date = a.date and f1 = a.factor and f2 = b.factor group by all),
ps as (select date, portfolio, sum(w * w * var) v, sum(w * r) ret from po join sp using (date, asset) join wt using (date, asset) where w is not null group by all)
select wr.until as date, portfolio, round(sqrt(252 * (pf.v + ps.v)), 5) forecast_vol_ann, round(ret, 6) + 0.0 realized_ret, round(ret / sqrt(5 * (pf.v + ps.v)), 4) + 0.0 z from pf join ps using (date, portfolio) join wr using (date)"""


@query(duck("panel_q", body=_HISTORY + "\nselect date, f1, f2, round(cov * 1e4, 5) + 0.0 cov from co"))
def covariances_asof(spark, sf_dir):
    own = history_tables(spark, sf_dir)
    weeks = revalidation.formation_weeks(own, REPLAY)
    none = weeks.select("date", F.lit(1.0).alias("multiplier")).limit(0)
    return covariance.covariances_at(own["factor_returns"], weeks, REPLAY, none).select("date", "f1", "f2", rounded(F.col("cov") * 1e4, 5).alias("cov"))


@query(duck("panel_q", body=_REPLAYED))
def revalidation_scores(spark, sf_dir):
    """Every week's test portfolios with the model of its date; optimised portfolios are left out, which SQL can't solve."""
    scored = revalidation.scores(history_tables(spark, sf_dir), REPLAY, work_folder(spark))
    return scored.where("portfolio not like 'opt%'").select("date", "portfolio", rounded(F.col("forecast_vol_ann"), 5).alias("forecast_vol_ann"), rounded(F.col("realized_ret")).alias("realized_ret"), rounded(F.col("z"), 4).alias("z"))


# -- weekly snapshots -----------------------------------------------------------------------------------

_SPECIFIC = """,
sl as (select *, row_number() over w i, coalesce(eps * lag(eps) over w, 0) p from rs window w as (partition by asset order by date)),
sv as (select date, asset, max(i) n, sum(k * case when i = 1 then 1 else d end * eps * eps) v, sum(k * d * p) g
  from (select wr.date, l.* exclude (date), 0.5 ** ((max(i) over (partition by wr.date, asset) - i) / 4.0::double) k, 1 - 0.5 ** (1 / 4.0::double) d from wr join sl l on l.date <= wr.date) group by all)"""
_SNAPSHOT = _HISTORY + _SPECIFIC + """,
al as (select eh.*, wr.until from eh join wr using (date)),
so as (select al.*, case when n >= 4 then v * greatest(least((v + g) / v, 2), 0.5) end v from al left join sv using (date, asset)),
ex as (select date, asset, 'market' factor, 1.0::double x from al union all select date, asset, 'size', size from al union all select date, asset, 'ind_' || industry, 1.0 from al),
dr as (select dy.date, dy.day, ex.asset, sum(x * f) s from dy join ex using (date) join fr on fr.date = dy.day and fr.factor = ex.factor group by all),
re as (select dr.date, dr.asset, product(1 + s + eps) - 1 - sum(s) resid from dr join rs on rs.date = dr.day and rs.asset = dr.asset join tn on tn.date = dr.date and tn.asset = dr.asset group by all),
mk as (select dy.date, sum(f) f from dy join fr on fr.date = dy.day where factor = 'market' group by all)
select so.date, so.asset, industry, round(size, 3) + 0.0 size, round(sqrt(252 * coalesce(v, median(v) over (partition by so.date))), 4) spec, round(resid, 5) + 0.0 resid, until next_date, round(mk.f, 6) + 0.0 f_market, round(252 * co.cov, 8) + 0.0 var_market
from so left join re using (date, asset) join mk using (date) join co on co.date = so.date and co.f1 = 'market' and co.f2 = 'market'"""


@query(duck("panel_q", body=_SNAPSHOT))
def weekly_snapshots(spark, sf_dir):
    """The documents, written by date and read back, a row for each name."""
    to = f"{work_folder(spark)}/history"
    snapshots.write(history_tables(spark, sf_dir), REPLAY, to)
    docs = snapshots.read(spark, to)
    market = docs.select("date", F.col("next.f")[0].alias("f"), F.col("fcov")[0][0].alias("v"))
    rows = snapshots.exploded(docs).join(market, "date")
    return rows.select(
        "date", F.col("asset").cast("long").alias("asset"), "industry", (F.col("styles")[0] + 0.0).alias("size"), "spec", (F.col("resid") + 0.0).alias("resid"), "next_date",
        (F.col("f") + 0.0).alias("f_market"), (F.col("v") + 0.0).alias("var_market"))


# -- specific risk of all dates -------------------------------------------------------------------------

_STRUCTURAL = _HISTORY + """,
sl as (select *, row_number() over w i, coalesce(eps * lag(eps) over w, 0) p from rs window w as (partition by asset order by date)),
sv as (select date, asset, max(i) n, sum(k * eps * eps) s0, sum(k) w0, sum(k * p) s1
  from (select d.date, l.* exclude (date), 0.5 ** ((max(i) over (partition by d.date, asset) - i) / 4.0::double) k from (select distinct date from eh) d join sl l on l.date <= d.date) group by all),
wd as (select eh.date, eh.asset, industry, size, ln(cap) / 10 volatility, (eh.asset % 17) / 10.0::double liquidity, case when n >= 4 then sqrt(252 * s0 / w0 * greatest(least((s0 + s1) / s0, 2), 0.5)) end ts_vol, coalesce(n, 0) n_obs from eh left join sv using (date, asset)),
fit as (select *, ln(ts_vol) y from wd where ts_vol > 0),
""" + _ols("fit", "y", ["size", "volatility", "liquidity"], "date", "date, industry") + """,
mi as (select date, industry, avg(y) my, avg(size) m0, avg(volatility) m1, avg(liquidity) m2 from fit group by all),
ms as (select date, avg(y) my, avg(size) m0, avg(volatility) m1, avg(liquidity) m2, count(*) n from fit group by date),
gs as (select wd.*, exp(coalesce(mi.my, ms.my) + b0 * (size - coalesce(mi.m0, ms.m0)) + b1 * (volatility - coalesce(mi.m1, ms.m1)) + b2 * (liquidity - coalesce(mi.m2, ms.m2))) guess
  from wd left join mi using (date, industry) left join ms on ms.date = wd.date and ms.n >= 30 left join ols on ols.date = ms.date),
bd as (select *, case when guess is not null then least(greatest(guess * avg(ts_vol / guess) filter (ts_vol > 0) over w, quantile_cont(ts_vol, 0.01) filter (ts_vol > 0) over w), 1.5 * quantile_cont(ts_vol, 0.99) filter (ts_vol > 0) over w) end structural from gs window w as (partition by date)),
bl as (select *, case when ts_vol is null then 0 else n_obs / (n_obs + 126.0::double) end bw from bd),
bv as (select *, case when ts_vol is null then structural when structural is null then ts_vol else bw * ts_vol + (1 - bw) * structural end v from bl),
bk as (select *, row_number() over (partition by date, v is null order by size, asset) k, count(*) over (partition by date, v is null) n from bv),
bb as (select *, least(floor(k * 10 / n), 9) b from bk), bm as (select *, avg(v) over w m, stddev_pop(v) over w d from bb window w as (partition by date, v is null, b)),
bf as (select *, 0.1::double * abs(v - m) / (d + 0.1::double * abs(v - m)) f from bm)
select date, asset, round(case when n >= 50 and d > 0 then f * m + (1 - f) * v else v end, 5) vol, round(ts_vol, 5) ts_vol, round(structural, 5) structural, round(bw, 6) blend_weight, n_obs from bf"""


@query(duck("panel_q", body=_STRUCTURAL))
def specific_risk_asof(spark, sf_dir):
    """The whole specific-risk chain as of every snapshot's date."""
    own = history_tables(spark, sf_dir)
    rows = own["exposure_history"].select("date", "asset", "industry", "size", (F.ln("cap") / 10).alias("volatility"), ((F.col("asset") % 17) / 10.0).alias("liquidity"))
    out = specific.specific_risk_at(own["residuals"], rows, REPLAY, keep=_keep(spark))
    return out.select("date", "asset", *[rounded(F.col(c), 5).alias(c) for c in ("vol", "ts_vol", "structural")], rounded(F.col("blend_weight")).alias("blend_weight"), "n_obs")


# -- reports and portfolio analytics --------------------------------------------------------------------


@query(duck("panel_w", body=_FR + """,
c as (select *, product(1 + f / 10) over (partition by factor order by date) - 1 c from fr)
select date as week, factor, round(c, 5) + 0.0 as value from c"""))
def explorer_cumulative(spark, sf_dir):
    returns = risk_queries.factor_returns(spark, sf_dir).withColumn("f", F.col("f") / 10)
    return report.cumulative(returns).select("week", "factor", (F.col("value") + 0.0).alias("value"))


@query(duck("panel_w", body=_SC + """
select round(regr_slope(realized_vol_ann ** 2, forecast_vol_ann ** 2), 5) slope, round(regr_intercept(realized_vol_ann ** 2, forecast_vol_ann ** 2), 4) intercept, round(regr_r2(realized_vol_ann ** 2, forecast_vol_ann ** 2), 6) r2 from sc"""))
def validation_fit(spark, sf_dir):
    """The fit in the validation payload, over all portfolios and weeks."""
    fit = report.validation_tables(risk_queries.scores(spark, sf_dir), CFG)["fit"]
    return fit.select(rounded(F.col("slope"), 5).alias("slope"), rounded(F.col("intercept"), 4).alias("intercept"), rounded(F.col("r2")).alias("r2"))


_SHEPARD = f"(1 / (1 - 10 / ((1 + {decay(84.0)!r}::double) / (1 - {decay(84.0)!r}::double))))"


@query(_MODEL + _RISK + f"\nselect portfolio, round((fv + sv) * {_SHEPARD} ** 2, 6) total_var, round(sqrt(fv + sv) * {_SHEPARD}, 6) total_vol, round(fv / (fv + sv), 6) factor_share from fv join sv using (portfolio)")
def optimized_risk(spark, sf_dir):
    """Risk of portfolios that were optimised against the model: ten factors, 84 days' half-life."""
    weights, exposures, cov, spec = risk_queries.model(spark, sf_dir)
    own = risk.risk(weights, exposures, cov, spec, risk.shepard_multiplier(10, RiskConfig()))
    return own.select("portfolio", rounded(F.col("factor_var") + F.col("specific_var")).alias("total_var"), rounded(F.col("total_vol")).alias("total_vol"), rounded(F.col("factor_share")).alias("factor_share"))


_BOUND = risk_queries.ORACLES["survivorship_audit"].replace("\nselect filer, first_filed", ",\na as (select filer, first_filed") + """)
select status, count(*) n, round(sum(greatest(last_equity, 0)), 3) equity, round(sum(greatest(last_equity, 0)) / sum(sum(greatest(last_equity, 0))) over (), 6) equity_share from a where status <> 'before' group by status"""


@query(_BOUND)
def survivorship_bound(spark, sf_dir):
    """How much equity the filers had that ceased."""
    rows = risk_queries.survivorship_audit(spark, sf_dir)
    out = baselines.survivorship_bound(rows)
    return out.select("status", "n", rounded(F.col("equity"), 3).alias("equity"), rounded(F.col("equity_share")).alias("equity_share"))


@query("""select c_custkey asset, c_custkey % 3 = 0 and exists (select * from orders where o_custkey = c_custkey) covered from customer""")
def covered_names(spark, sf_dir):
    """Which customers have orders, of those whose number 3 divides."""
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("asset"))
    return risk.split_coverage(names, table(spark, sf_dir, "orders").where("o_custkey % 3 = 0").select(F.col("o_custkey").alias("asset")))
