"""Queries over the panels: transforms, series, screens, look-ups, aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorlake.config import RiskConfig
from factorlake.functions.scalar import dotless, finite, friday, rounded, safe_ln
from factorlake.functions.timeseries import compounded, ewma_weight, forward_fill, over, simple_return, trailing, with_ewma
from factorlake.operators import history, industry, pit, styles, transforms, universe
from factorlake.plans import report
from factorlake.sources import store
from factorlake.sources.fixtures import DUCK, filings, panel_q, panel_w, table

CFG = RiskConfig()
#: The screens' limits at the scale of the sample tables.
SCREEN = RiskConfig(least_history_rows=40, least_dollar_volume=1e5, volume_rows=21, coverage_stale_days=45)
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def duck(*views: str, body: str) -> str:
    return "with " + ",\n".join(DUCK[v] for v in views) + ("," if body.lstrip().startswith("-- more") else "") + body.replace("-- more", "", 1)


def _score_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel_q(spark, sf_dir).withColumn("x", safe_ln(F.col("close"))).withColumn("in_fit", F.col("volume") >= 50)


# One winsorising pass in DuckDB: bounds from the fit rows (f), applied to all.
def _pass(name: str, source: str, by: str = "date", fit: str = "in_fit") -> str:
    return f"""{name} as (select * exclude (x, m, s), case when s > 0 and x is not null then greatest(least(x, m + 3 * s), m - 3 * s) else x end x
 from (select *, avg(x) filter ({fit}) over (partition by {by}) m, stddev_samp(x) filter ({fit}) over (partition by {by}) s from {source}))"""


_WINSOR = "-- more\np0 as (select *, ln(close) x, volume >= 50 in_fit from panel_q),\n" + _pass("p1", "p0") + ",\n" + _pass("p2", "p1")
_STANDARD = """,
z as (select *, case when count(x) filter (in_fit and cap > 0) over w >= 2 and stddev_samp(x) filter (in_fit and cap > 0) over w > 0
 then (x - sum(x * cap) filter (in_fit and cap > 0) over w / sum(cap) filter (in_fit and cap > 0) over w) / stddev_samp(x) filter (in_fit and cap > 0) over w end z
 from p2 window w as (partition by date))"""


@query(duck("panel_q", body=_WINSOR + "\nselect asset, date, round(x, 6) x from p2"))
def winsorize_panel(spark, sf_dir):
    return transforms.winsorize(_score_panel(spark, sf_dir), "x", "date", "in_fit").select("asset", "date", rounded(F.col("x")).alias("x"))


@query(duck("panel_q", body=_WINSOR + _STANDARD + "\nselect asset, date, round(z, 6) + 0.0 x from z"))
def standardize_panel(spark, sf_dir):
    df = transforms.winsorize(_score_panel(spark, sf_dir), "x", "date", "in_fit")
    return transforms.standardize(df, "x", "cap", "date", "in_fit").select("asset", "date", rounded(F.col("x")).alias("x"))


@query(duck("panel_q", body=_WINSOR.replace("ln(close) x", "case when volume > 3 then ln(close) end x") + _STANDARD + "\nselect asset, date, round(coalesce(z, 0), 6) + 0.0 x from z"))
def process_exposure(spark, sf_dir):
    df = _score_panel(spark, sf_dir).withColumn("x", F.when(F.col("volume") > 3, F.col("x")))
    return transforms.process(df, "x", "cap", "date", "in_fit").select("asset", "date", rounded(F.col("x")).alias("x"))


def _one_score(name: str, value: str) -> str:
    return f"""{name}0 as (select *, {value} x, true in_fit from panel_q), {_pass(name + "1", name + "0")}, {_pass(name + "2", name + "1")},
{name} as (select asset, date, case when count(x) over w >= 2 and stddev_samp(x) over w > 0 then (x - sum(x * cap) over w / sum(case when x is not null then cap end) over w) / stddev_samp(x) over w end z from {name}2 window w as (partition by date))"""


@query(duck("panel_q", body="-- more\n" + _one_score("a", "ln(close)") + ",\n" + _one_score("b", "case when volume > 10 then ln(volume) end") + """
select a.asset, a.date, round(case when b.z is null then a.z when a.z is null then b.z else (a.z + b.z) / 2 end, 6) + 0.0 score from a join b on a.asset = b.asset and a.date = b.date"""))
def composite_score(spark, sf_dir):
    df = panel_q(spark, sf_dir).withColumn("price", safe_ln(F.col("close"))).withColumn("turnover", F.when(F.col("volume") > 10, F.ln("volume")))
    return transforms.composite(df, ["price", "turnover"], "score", "cap", "date").select("asset", "date", rounded(F.col("score")).alias("score"))


@query(duck("panel_q", body="""-- more
p as (select *, ln(close) y, ln(volume) x from panel_q where volume > 0),
r as (select *, y - regr_intercept(y, x) over w - regr_slope(y, x) over w * x e, var_pop(x) over w v from p window w as (partition by date)),
z as (select *, (e - sum(e * cap) over w / sum(cap) over w) / nullif(stddev_samp(e) over w, 0) z from r window w as (partition by date))
select asset, date, round(case when v > 0 then coalesce(z, 0) else y end, 5) + 0.0 y from z"""))
def orthogonalize(spark, sf_dir):
    df = panel_q(spark, sf_dir).where("volume > 0").withColumn("y", safe_ln(F.col("close"))).withColumn("x", safe_ln(F.col("volume")))
    return transforms.orthogonalize(df, "y", "x", "cap", "date").select("asset", "date", rounded(F.col("y"), 5).alias("y"))


@query(duck("panel_q", body="\nselect asset, date, round(ln(coalesce(case when volume > 20 then close end, median(case when volume > 20 then close end) over (partition by date, industry))), 6) x from panel_q"))
def impute_group_median(spark, sf_dir):
    df = panel_q(spark, sf_dir).withColumn("x", F.when(F.col("volume") > 20, F.col("close")))
    return transforms.impute_group_median(df, "x", "industry", "date").select("asset", "date", rounded(F.ln("x")).alias("x"))


@query(duck("panel_w", body="\nselect asset, date, round(close / lag(close) over (partition by asset order by date) - 1, 6) + 0.0 r from panel_w"))
def simple_returns(spark, sf_dir):
    return panel_w(spark, sf_dir).select("asset", "date", rounded(simple_return(F.col("close"), "asset", "date")).alias("r"))


_DENSE = """-- more
cal as (select distinct date from panel_w), span as (select asset, min(date) a, max(date) z from panel_w group by asset),
grid as (select asset, cal.date, close, volume from span join cal on cal.date between a and z left join panel_w using (asset, date)),
f as (select *, last_value(close ignore nulls) over (partition by asset order by date) filled from grid)"""


def _dense(spark, sf_dir):
    from factorlake.functions.timeseries import dense_calendar

    return dense_calendar(panel_w(spark, sf_dir)).withColumn("filled", forward_fill(F.col("close"), "asset", "date"))


@query(duck("panel_w", body=_DENSE + "\nselect asset, date, round(ln(filled), 6) filled, round(filled / lag(filled) over (partition by asset order by date) - 1, 6) + 0.0 r from f"))
def ffill_returns(spark, sf_dir):
    return _dense(spark, sf_dir).select("asset", "date", rounded(F.ln("filled")).alias("filled"), rounded(simple_return(F.col("filled"), "asset", "date")).alias("r"))


@query(duck("panel_w", body=_DENSE + "\nselect asset, date, round(lag(filled, 4) over w / lag(filled, 56) over w - 1, 6) + 0.0 momentum from f window w as (partition by asset order by date)"))
def momentum_skip(spark, sf_dir):
    rows = styles.price_features(panel_w(spark, sf_dir), RiskConfig(momentum_skip=4, momentum_window=52))
    return rows.select("asset", "date", rounded(F.col("momentum")).alias("momentum"))


_RETURNS = "-- more\nr as (select *, close / lag(close) over (partition by asset order by date) - 1 r from panel_q)"


def _returns(spark, sf_dir):
    return panel_q(spark, sf_dir).withColumn("r", simple_return(F.col("close"), "asset", "date"))


@query(duck("panel_q", body=_RETURNS + "\nselect date, round(sum(cap * r) / sum(case when r is not null then cap end), 6) + 0.0 market from r group by date"))
def market_return(spark, sf_dir):
    own = _returns(spark, sf_dir).groupBy("date").agg((F.sum(F.col("cap") * F.col("r")) / F.sum(F.when(F.col("r").isNotNull(), F.col("cap")))).alias("m"))
    return own.select("date", rounded(F.col("m")).alias("market"))


@query(duck("panel_w", body="""-- more
r as (select *, close / lag(close) over (partition by asset order by date) - 1 r from panel_w),
m as (select date, avg(r) m from r group by date), b as (select r.asset, r.date, r.r, m.m from r join m using (date) where r.r is not null and m.m is not null),
s as (select asset, date, count(*) over w n, regr_slope(r, m) over w b, regr_syy(r, m) over w syy, regr_sxy(r, m) over w sxy from b window w as (partition by asset order by date rows 51 preceding))
select asset, date, round(case when n >= 26 then b end, 5) + 0.0 beta, round(case when n >= 26 then sqrt(greatest(syy - b * sxy, 0) / n * 52) end, 5) + 0.0 volatility from s"""))
def rolling_beta_rvol(spark, sf_dir):
    rows = panel_w(spark, sf_dir).withColumn("r", simple_return(F.col("close"), "asset", "date"))
    both = rows.join(rows.groupBy("date").agg(F.avg("r").alias("m")), "date").where("r is not null and m is not null")
    w = trailing("asset", "date", 52)
    s = both.select("asset", "date", F.count("*").over(w).alias("n"), F.regr_slope("r", "m").over(w).alias("b"), F.regr_syy("r", "m").over(w).alias("syy"), F.regr_sxy("r", "m").over(w).alias("sxy"))
    vol = F.sqrt(F.greatest(F.col("syy") - F.col("b") * F.col("sxy"), F.lit(0.0)) / F.col("n") * 52)
    return s.select("asset", "date", rounded(F.when(F.col("n") >= 26, F.col("b")), 5).alias("beta"), rounded(F.when(F.col("n") >= 26, vol), 5).alias("volatility"))


@query(duck("panel_w", body="""-- more
k as (select *, row_number() over (partition by asset order by date desc) k from panel_w),
s as (select asset, max(date) last_date, arg_max(close, date) p, count(*) n_obs, median(close * volume) filter (k <= 21) v from k group by asset)
select asset, last_date, n_obs, round(ln(p), 6) last_price, round(ln(v), 6) dollar_volume, p >= 2 and n_obs >= 40 and v >= 1e5 passes from s"""))
def adv_screen(spark, sf_dir):
    df = universe.liquidity_screen(panel_w(spark, sf_dir), SCREEN)
    return df.select("asset", "last_date", "n_obs", rounded(F.ln("last_price")).alias("last_price"), rounded(F.ln("dollar_volume")).alias("dollar_volume"), "passes")


@query(duck("panel_q", body="""-- more
s as (select asset, max(date) last_date, arg_max(close, date) p from panel_q group by asset)
select asset, last_date, round(ln(p), 6) last_price, p >= 1 and date_diff('day', last_date, (select max(date) from panel_q)) <= 45 covered from s"""))
def coverage_screen(spark, sf_dir):
    df = universe.coverage_screen(panel_q(spark, sf_dir), SCREEN)
    return df.select("asset", "last_date", rounded(F.ln("last_price")).alias("last_price"), "covered")


_TICKERS = """with t as (select p_partkey ord, upper(trim(replace(translate(p_name, '0123456789 _', ''), '.', '-')))[1:4] || case when p_partkey % 11 = 0 then '9' else '' end ticker, p_partkey % 97 cik, p_name title from part)"""


@query(_TICKERS + "\nselect arg_min(ord, ord) ord, arg_min(ticker, ord) ticker, cik, arg_min(title, ord) title from t where regexp_full_match(ticker, '[A-Z]{1,5}(-[A-Z])?') group by cik")
def candidate_dedup(spark, sf_dir):
    ticker = F.concat(F.substring(dotless(F.translate("p_name", "0123456789 _", "")), 1, 4), F.when(F.col("p_partkey") % 11 == 0, "9").otherwise(""))
    registry = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), ticker.alias("ticker"), (F.col("p_partkey") % 97).alias("cik"), F.col("p_name").alias("title"))
    return universe.candidates(registry)


#: Thirty industries by rule: blocks of 330 codes with gaps, and a second layer that overlaps the first.
RANGES = [(f"g{k:02d}", 100 + 330 * k, 100 + 330 * k + 250) for k in range(24)] + [(f"g{k:02d}", 200 + 1000 * (k - 24), 700 + 1000 * (k - 24)) for k in range(24, 30)]
_SIC = "(100 + (37 * p_partkey) % 8900)::int"


@query("with rng(ord, industry, lo, hi) as (values " + ", ".join(f"({i}, '{n}', {a}, {b})" for i, (n, a, b) in enumerate(RANGES)) + f"""),
p as (select p_partkey asset, {_SIC} sic from part)
select asset, sic, coalesce((select arg_min(industry, ord) from rng where sic between lo and hi), 'Other') industry from p""")
def sic_range_join(spark, sf_dir):
    assets = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("asset"), (100 + (37 * F.col("p_partkey")) % 8900).cast("int").alias("sic"))
    return industry.classify(assets, industry.code_table(spark, RANGES)).select("asset", "sic", "industry")


_BRANDS = [f"Brand#{a}{b}" for a in range(1, 6) for b in range(1, 6)]


@query("select p_partkey asset, " + ", ".join(f"(p_brand = '{b}')::int as \"ind_{b.replace('#', '')}\"" for b in _BRANDS) + " from part")
def one_hot(spark, sf_dir):
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("asset"), F.replace("p_brand", F.lit("#"), F.lit("")).alias("industry"))
    return transforms.one_hot(df, "industry", [b.replace("#", "") for b in _BRANDS]).drop("industry")


AS_OF = ["2024-01-08", "2024-01-15", "2024-01-22", "2024-01-29"]
_DATES = "-- more\ndates(as_of) as (select unnest([" + ", ".join(f"timestamp '{d}'" for d in AS_OF) + "]))"


def _dates(spark):
    return spark.createDataFrame([(d,) for d in AS_OF], "d string").select(F.col("d").cast("timestamp_ntz").alias("date"))


@query(duck("filings", body=_DATES + """
select as_of::date as_of, asset, field, round(arg_max(val, struct_pack(e := "end", f := filed)), 6) val, max("end") "end" from filings join dates on filed <= as_of group by all"""))
def asof_bitemporal(spark, sf_dir):
    df = pit.latest(filings(spark, sf_dir), _dates(spark))
    return df.select(F.col("as_of").cast("date").alias("as_of"), "asset", "field", rounded(F.col("val")).alias("val"), "end")


@query(ORACLES["asof_bitemporal"])
def store_asof(spark, sf_dir):
    """The same from the nested store, half of the filings appended to it."""
    rows = filings(spark, sf_dir)
    held = store.appended(store.to_store(rows.where("asset % 2 = 0 or day(filed) <= 15")), rows.where("asset % 2 = 1 and day(filed) > 15"))
    df = store.asof(held, _dates(spark))
    return df.select(F.col("as_of").cast("date").alias("as_of"), "asset", "field", rounded(F.col("val")).alias("val"), "end")


@query(duck("filings", body='\nselect distinct asset, field, "end", filed, val from filings'))
def store_round_trip(spark, sf_dir):
    return store.from_store(store.to_store(filings(spark, sf_dir)))


_HISTORY = _DATES + """,
h as (select as_of, asset, field, "end", arg_max(val, filed) val from filings join dates on filed <= as_of group by all),
k as (select *, row_number() over (partition by as_of, asset, field order by "end" desc) k from h),
p as (select *, count(*) over (partition by as_of, asset, field) - k period from k where k <= 5)"""


@query(duck("filings", body=_HISTORY + '\nselect as_of::date as_of, asset, field, "end", round(val, 6) val, period::int period from p'))
def asof_history5(spark, sf_dir):
    df = pit.history(filings(spark, sf_dir), _dates(spark))
    return df.select(F.col("as_of").cast("date").alias("as_of"), "asset", "field", "end", rounded(F.col("val")).alias("val"), "period")


@query(duck("filings", body=_HISTORY + """
select as_of::date as_of, asset, field, round(case when count(val) >= 3 and avg(abs(val)) > 0 then regr_slope(val, period) / avg(abs(val)) end, 6) + 0.0 growth from p group by all"""))
def growth_slope(spark, sf_dir):
    df = pit.growth(pit.history(filings(spark, sf_dir), _dates(spark)))
    return df.select(F.col("as_of").cast("date").alias("as_of"), "asset", "field", rounded(F.col("growth")).alias("growth"))


@query(duck("filings", body=_DATES + """,
v as (select as_of, asset, field, arg_max(val, struct_pack(e := "end", f := filed)) val from filings join dates on filed <= as_of group by all)
select as_of::date as_of, asset, round(max(val) filter (field = 'click'), 6) click, round(max(val) filter (field = 'view'), 6) as view from v group by as_of, asset"""))
def asof_pivot(spark, sf_dir):
    df = pit.wide(pit.latest(filings(spark, sf_dir), _dates(spark)), ["click", "view"])
    return df.select(F.col("as_of").cast("date").alias("as_of"), "asset", rounded(F.col("click")).alias("click"), rounded(F.col("view")).alias("view"))


@query(duck("filings", body="""-- more
q as (select *, case field when 'purchase' then 0 when 'click' then 1 else 2 end priority, asset % 3 = 0 and field = 'purchase' drop_it from filings),
m as (select *, min(priority) over (partition by asset) p from q where not drop_it)
select asset, priority, count(*) n, round(sum(val), 4) total from m where priority = p group by all"""))
def concept_fallback(spark, sf_dir):
    f = filings(spark, sf_dir).where("not (asset % 3 = 0 and field = 'purchase')").withColumn("priority", F.when(F.col("field") == "purchase", 0).when(F.col("field") == "click", 1).otherwise(2))
    kept = pit.first_concept(f.withColumn("field", F.lit("any")))
    return kept.groupBy("asset", "priority").agg(F.count("*").alias("n"), rounded(F.sum("val"), 4).alias("total"))


@query("select c_custkey asset, c_nationkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 200000)")
def semi_members(spark, sf_dir):
    big = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(big, "c_custkey", "left_semi").select(F.col("c_custkey").alias("asset"), "c_nationkey")


_UPSERT = """-- more
m as (select asset, date, close, 1 source from panel_w where date < date '2001-09-01'), n as (select asset, date, close * 2 as close, 2 source from panel_w where date >= date '2001-08-01' and asset % 2 = 0),
u as (select * from m where (asset, date) not in (select asset, date from n) union all select * from n)"""


def _merge(spark, sf_dir, cap=None, key=("asset", "date")):
    p = panel_w(spark, sf_dir).select("asset", "date", "close")
    prior = p.where("date < date '2001-09-01'").withColumn("source", F.lit(1))
    new = p.where("date >= date '2001-08-01' and asset % 2 = 0").withColumn("close", F.col("close") * 2).withColumn("source", F.lit(2))
    return history.upsert(prior, new, list(key), cap)


@query(duck("panel_w", body=_UPSERT + "\nselect asset, date, round(ln(close), 6) as close, source from u"))
def anti_merge(spark, sf_dir):
    return _merge(spark, sf_dir).select("asset", "date", rounded(F.ln("close")).alias("close"), "source")


@query(duck("panel_w", body="""-- more
m as (select asset, date, close, 1 source from panel_w where date < date '2001-09-01'), n as (select asset, date, close * 2 as close, 2 source from panel_w where date >= date '2001-08-01' and asset % 2 = 0),
u as (select * from m where date not in (select date from n) union all select * from n)
select asset, date, round(ln(close), 6) as close, source from u where date in (select distinct date from u order by date desc limit 26)"""))
def history_cap(spark, sf_dir):
    return _merge(spark, sf_dir, 26, ("date",)).select("asset", "date", rounded(F.ln("close")).alias("close"), "source")


@query("""select l_suppkey asset, l_shipdate::date + ((12 - isodow(l_shipdate)) % 7)::int as week, max(l_shipdate::date) last_day, round(arg_max(l_extendedprice, struct_pack(a := l_shipdate::date, b := l_extendedprice)), 2) last_price, round(sum(l_quantity), 2) volume from lineitem group by all""")
def weekly_last(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").withColumn("day", F.col("l_shipdate").cast("date"))
    own = line.groupBy(F.col("l_suppkey").alias("asset"), friday(F.col("day")).alias("week"))
    return own.agg(F.max("day").alias("last_day"), rounded(F.max_by("l_extendedprice", F.struct("day", "l_extendedprice")), 2).alias("last_price"), rounded(F.sum("l_quantity"), 2).alias("volume"))


@query("""with d as (select l_suppkey asset, l_shipdate::date as day, avg(l_discount) r from lineitem group by all)
select asset, day + ((12 - isodow(day)) % 7)::int as week, round(ln(product(1 + r)), 6) + 0.0 log_r from d group by all""")
def weekly_compound(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("asset"), F.col("l_shipdate").cast("date").alias("day")).agg(F.avg("l_discount").alias("r"))
    return d.groupBy("asset", friday(F.col("day")).alias("week")).agg(rounded(F.ln(compounded(F.col("r")) + 1)).alias("log_r"))


@query("select event_id, (props->>'k')::int k, event_type from events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), "event_type")


@query(duck("panel_w", body="""-- more
r as (select asset, date, least(greatest(close / lag(close) over (partition by asset order by date) - 1, -1), 3) r from panel_w),
c as (select asset, date, product(1 + r / 10) over (partition by asset order by date) - 1 c from r where r is not null)
select asset, date, round(ln(1 + c), 6) + 0.0 log_growth from c"""))
def cumulative_returns(spark, sf_dir):
    r = panel_w(spark, sf_dir).withColumn("r", F.least(F.greatest(simple_return(F.col("close"), "asset", "date"), F.lit(-1.0)), F.lit(3.0))).where("r is not null")
    run = over("asset", "date").rowsBetween(Window.unboundedPreceding, 0)
    return r.withColumn("c", F.product(1 + F.col("r") / 10).over(run) - 1).select("asset", "date", rounded(F.log1p("c")).alias("log_growth"))


@query("select ts::date + ((12 - isodow(ts)) % 7)::int as week, event_type, count(*) n, count(distinct user_id) users, round(sum(value), 4) total from events group by all")
def week_bucket(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(friday(F.col("ts").cast("date")).alias("week"), "event_type")
    return e.agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), rounded(F.sum("value"), 4).alias("total"))


@query(duck("panel_q", body=_RETURNS + """,
z as (select (r - avg(r) over (partition by date)) / nullif(stddev_samp(r) over (partition by date), 0) z from r where r is not null),
b as (select least(greatest(floor((least(greatest(z, -3.875), 3.875) + 4) / 0.25) + 1, 1), 32)::bigint bin from z where z is not null)
select bin, count(*) n, round(count(*) / (sum(count(*)) over () * 0.25), 6) density from b group by bin"""))
def z_histogram(spark, sf_dir):
    w = Window.partitionBy("date")
    z = _returns(spark, sf_dir).where("r is not null").select(F.try_divide(F.col("r") - F.avg("r").over(w), F.stddev_samp("r").over(w)).alias("z")).where("z is not null")
    return report.histogram(z).select("bin", "n", rounded(F.col("density")).alias("density"))


@query(duck("panel_w", body="""-- more
l as (select asset, max(date) d, arg_max(close, date) p from panel_w where date < date '1998-06-01' or asset % 3 <> 0 group by asset),
w as (select date, lead(date) over (order by date) nxt from (select distinct date from panel_w))
select asset, nxt date, case when p < 4500 then -0.3 else 0.0 end::double r from l join w on d = w.date where nxt is not null"""))
def delist_impute(spark, sf_dir):
    p = panel_w(spark, sf_dir)
    weeks = p.select("date", F.col("date").alias("week")).distinct()
    return history.delisting_returns(p.where("date < date '1998-06-01' or asset % 3 <> 0"), weeks, RiskConfig(delist_price=4500.0))


@query(duck("panel_q", body="""-- more
k as (select industry, asset, date, cap, row_number() over (partition by date order by cap desc, asset) k, row_number() over (partition by date order by asset) o from panel_q)
select asset, date, k::int rank, round(ln(cap), 6) cap from k where k <= 20"""))
def largest_by_cap(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("date").orderBy(F.col("cap").desc(), "asset"))
    return panel_q(spark, sf_dir).withColumn("rank", rank).where("rank <= 20").select("asset", "date", "rank", rounded(F.ln("cap")).alias("cap"))


@query(duck("panel_q", body="\nselect industry, count(*) n, count(distinct asset) assets, round(stddev_pop(ln(close)), 6) spread, round(ln(quantile_cont(close, 0.99)), 6) q99, round(corr(ln(close), ln(volume)), 6) corr from panel_q where volume > 0 group by industry"))
def group_statistics(spark, sf_dir):
    p = panel_q(spark, sf_dir).where("volume > 0")
    return p.groupBy("industry").agg(F.count("*").alias("n"), F.count_distinct("asset").alias("assets"), rounded(F.stddev_pop(F.ln("close"))).alias("spread"), rounded(F.ln(F.percentile("close", F.lit(0.99)))).alias("q99"), rounded(F.corr(F.ln("close"), F.ln("volume"))).alias("corr"))


@query("""with a as (select distinct l_partkey asset from lineitem where l_quantity >= 45), b as (select distinct l_partkey asset from lineitem where l_discount >= 0.09)
select 'both' side, count(*) n from (select * from a intersect select * from b) union all select 'either', count(*) from (select * from a union select * from b) union all select 'first', count(*) from (select * from a except select * from b)""")
def set_operations(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    a, b = line.where("l_quantity >= 45").select(F.col("l_partkey").alias("asset")), line.where("l_discount >= 0.09").select(F.col("l_partkey").alias("asset"))
    sides = {"both": a.intersect(b), "either": a.union(b).distinct(), "first": a.subtract(b)}
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("side"), "n") for k, df in sides.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(duck("panel_w", body="""-- more
n as (select *, row_number() over (partition by asset order by date) i from panel_w),
e as (select *, (1 - 0.5::double ** (1 / 26::double)) * 0.5::double ** (i / 26::double) * sum((close / 1e4) ** 2 * 0.5::double ** (-i / 26::double)) over (partition by asset order by date) v from n)
select asset, date, round(v, 6) v from e"""))
def state_var_recursive(spark, sf_dir):
    return with_ewma(panel_w(spark, sf_dir), (F.col("close") / 1e4) ** 2, "v", "asset", "date", 0.5 ** (1 / 26), seeded=False).select("asset", "date", rounded(F.col("v")).alias("v"))


@query(duck("panel_w", body="""-- more
n as (select *, row_number() over (partition by asset order by date desc) - 1 age from panel_w)
select asset, round(sum(0.5::double ** (age / 26::double) * (close / 1e4) ** 2) / sum(0.5::double ** (age / 26::double)), 6) v from n group by asset"""))
def ewma_batch_variance(spark, sf_dir):
    rows = panel_w(spark, sf_dir).withColumn("k", ewma_weight("asset", "date", 26.0))
    return rows.groupBy("asset").agg(rounded(F.sum(F.col("k") * (F.col("close") / 1e4) ** 2) / F.sum("k")).alias("v"))


@query("""select distinct on (c_custkey) c_custkey asset, round(c_acctbal, 2) acct, round(case when c_acctbal > 0 then ln(c_acctbal) end, 6) ln_acct, upper(c_mktsegment) segment,
lpad(c_custkey::varchar, 10, '0') as key, round(case when c_nationkey > 0 then c_acctbal / c_nationkey end, 4) + 0.0 per_nation, round(sqrt(greatest(c_acctbal, 0)), 5) root, date_add(date '1970-01-01', (c_custkey * 3)::int) as day from customer""")
def scalar_functions(spark, sf_dir):
    from factorlake.functions.scalar import cik_key, ratio, safe_sqrt, unix_date

    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("asset"), rounded(finite(F.col("c_acctbal")), 2).alias("acct"), rounded(safe_ln(F.col("c_acctbal"))).alias("ln_acct"), F.upper("c_mktsegment").alias("segment"), cik_key(F.col("c_custkey")).alias("key"), rounded(ratio(F.col("c_acctbal"), F.when(F.col("c_nationkey") > 0, F.col("c_nationkey"))), 4).alias("per_nation"), rounded(safe_sqrt(F.col("c_acctbal")), 5).alias("root"), unix_date(F.col("c_custkey") * 3 * 86400).alias("day"))



