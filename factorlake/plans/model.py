"""The whole model: tables in, tables out. One lazy plan up to the regressions; K x K algebra on the driver."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorlake.config import FUNDAMENTALS, STYLES, RiskConfig
from factorlake.functions.scalar import friday
from factorlake.functions.timeseries import simple_return
from factorlake.operators import covariance, history, pit, regression, risk, specific, state, styles, universe, validation
from factorlake.plans import revalidation
from factorlake.sources import artifacts

MARKET = "market"


@dataclass
class RiskModel:
    """exposures (asset, factor, x) long, covariance (f1, f2, cov), specific (asset, vol), with the tables they came from."""

    spark: SparkSession
    exposures: DataFrame
    covariance: DataFrame
    specific: DataFrame
    factors: list[str]
    meta: dict
    cfg: RiskConfig

    def portfolio_risk(self, weights: DataFrame, optimized: bool = False) -> DataFrame:
        m = risk.shepard_multiplier(len(self.factors), self.cfg) if optimized and self.cfg.shepard else 1.0
        own = risk.normalised(weights)
        return risk.risk(own, self.exposures, self.covariance, self.specific, m).join(risk.coverage(own, self.exposures), "portfolio")

    def factor_exposures(self, weights: DataFrame) -> DataFrame:
        return risk.factor_exposures(risk.normalised(weights), self.exposures)

    def top_factors(self, weights: DataFrame, n: int = 10) -> DataFrame:
        return risk.top(risk.factor_contributions(risk.normalised(weights), self.exposures, self.covariance), "contribution", n, "factor")

    def top_assets(self, weights: DataFrame, n: int = 10) -> DataFrame:
        return risk.top(risk.asset_contributions(risk.normalised(weights), self.exposures, self.covariance, self.specific), "contribution", n, "asset")

    def stress_test(self, weights: DataFrame, shocks: DataFrame) -> DataFrame:
        return risk.stress(risk.normalised(weights), self.exposures, shocks)

    def asset_risk(self, ticker: str) -> DataFrame:
        own = self.exposures.where(F.col("asset") == ticker.upper())
        if own.isEmpty():
            raise KeyError(ticker)
        return risk.asset_risk(own, self.covariance, self.specific)

    def estimation_quality(self, ticker: str) -> DataFrame:
        return self.specific.where(F.col("asset") == ticker.upper())

    def check_coverage(self, names: DataFrame) -> DataFrame:
        return risk.split_coverage(names, self.exposures)

    def model_info(self) -> dict:
        return self.meta | {"factors": self.factors}


def full_exposures(snapshot: DataFrame, industries: list[str]) -> DataFrame:
    """(asset, factor, x) with market 1, the styles and industry memberships."""
    styled = F.array(F.struct(F.lit(MARKET).alias("factor"), F.lit(1.0).alias("x")), *[F.struct(F.lit(s).alias("factor"), F.col(s).cast("double").alias("x")) for s in STYLES])
    rows = snapshot.select("asset", F.explode(styled).alias("p")).select("asset", "p.factor", "p.x")
    member = snapshot.where(F.col("industry").isin(industries)).select("asset", F.concat(F.lit("ind_"), "industry").alias("factor"), F.lit(1.0).alias("x"))
    return rows.unionByName(member)


def formation_dates(prices: DataFrame) -> DataFrame:
    """(date): the last trading day of each Friday week."""
    return prices.select("date").distinct().groupBy(friday(F.col("date")).alias("week")).agg(F.max("date").alias("date")).select("date")


def build(spark: SparkSession, prices: DataFrame, filings: DataFrame, industries: DataFrame, cfg: RiskConfig, path: str, prior: str | None = None, first_date: str | None = None, registry: DataFrame | None = None) -> RiskModel:
    """prices (date, asset, close, volume), filings (asset, field, end, filed, val), industries (asset, industry).

    prior: an earlier run's folder; its weeks before the last one are kept, only newer weeks are estimated again. If the folder's version
    is neither this one nor a compatible one, its exposures and regressions mean something else and all weeks are estimated.
    registry (asset, ord): only the first cfg.pool names in its order are candidates for the estimation; coverage takes all.
    """
    old = artifacts.load(spark, prior) if prior else None
    if old and old["meta"].get("version") not in (cfg.version, *cfg.compatible_versions):
        old = None
    candidates = prices
    if registry is not None:
        pool = universe.estimation_pool(registry, cfg.pool)
        candidates = prices.join(F.broadcast(pool.select("asset")), "asset", "left_semi")  # cfg.pool names
    screened = universe.liquidity_screen(candidates, cfg).where("passes")
    covered = universe.coverage_screen(prices, cfg).where("covered")
    dates = formation_dates(prices)
    if old:
        resume = old["exposure_history"].agg(F.max("date")).first()[0]
        dates = dates.where(F.col("date") >= F.lit(resume))
    if first_date:
        dates = dates.where(F.col("date") >= F.lit(first_date).cast("date"))
    known = pit.wide(pit.latest(filings, dates), [f for f in FUNDAMENTALS if f != "sales_growth"])
    growth = pit.growth(pit.history(filings.where("field = 'revenues'"), dates, cfg.growth_periods), cfg.least_growth_periods)
    fund = known.join(growth.select("as_of", "asset", F.col("growth").alias("sales_growth")), ["as_of", "asset"], "left")
    base = f"{path}/work"
    # The plans before and after are deep enough each.
    fund.write.mode("overwrite").parquet(f"{base}/fundamentals")
    fund = spark.read.parquet(f"{base}/fundamentals")
    # read by the regressions and by the last snapshot
    styles.style_exposures(prices, fund, industries, cfg, screened).write.mode("overwrite").parquet(f"{base}/exposures")
    exposures = spark.read.parquet(f"{base}/exposures")

    returns = prices.select("date", "asset", simple_return(F.col("close"), "asset", "date").alias("r")).where("r is not null")
    weeks = prices.select("date").distinct().withColumn("week", friday(F.col("date")))
    gone = history.delisting_returns(prices, weeks, cfg)
    returns = returns.unionByName(gone.select("date", "asset", "r"))
    # the week after a formation date belongs to it: days join it by their own week's predecessor
    order = dates.withColumn("week", friday(F.col("date"))).select(F.col("date").alias("formed"), F.date_add("week", 7).alias("week"))
    days = returns.withColumn("week", friday(F.col("date"))).join(order, "week").select("date", "asset", "r", "formed")
    rows = days.join(exposures.where("in_fit").withColumnRenamed("date", "formed"), ["formed", "asset"])
    regression.fit_dates(rows, list(STYLES), cfg.least_assets).write.mode("overwrite").parquet(f"{base}/regressions")
    fits = spark.read.parquet(f"{base}/regressions")
    tables = {
        "factor_returns": fits.where("kind = 'factor'").select("date", F.col("key").alias("factor"), F.col("value").alias("f")),
        "residuals": fits.where("kind = 'residual'").select("date", F.col("key").alias("asset"), F.col("value").alias("eps")),
        "t_stats": fits.where("kind = 't'").select("date", F.col("key").alias("factor"), F.col("value").alias("t")),
        "exposure_history": exposures,
    }
    if old:
        for name in tables:
            if old[name] is not None:
                tables[name] = history.upsert(old[name], tables[name], ["date"], cfg.history_weeks if name == "exposure_history" else cfg.history_days)
    for name in tables:
        tables[name].write.mode("overwrite").parquet(f"{base}/{name}")
        tables[name] = spark.read.parquet(f"{base}/{name}")
    out = _finish(spark, tables, covered, industries, cfg, path)
    artifacts.remove(spark, base)  # all of it is saved by now
    return out


def _latest(df: DataFrame, column: str, otherwise: float = 1.0) -> float:
    row = df.agg(F.max_by(column, "date")).first()
    return otherwise if row is None or row[0] is None else float(row[0])


def _finish(spark: SparkSession, tables: dict[str, DataFrame], covered: DataFrame | None, industries: DataFrame, cfg: RiskConfig, path: str) -> RiskModel:
    """Covariance, specific risk and the snapshot from the estimated histories; saved and returned."""
    returns, residuals, past = tables["factor_returns"], tables["residuals"], tables["exposure_history"]
    names = [r[0] for r in returns.select("factor").distinct().orderBy("factor").limit(covariance.MOST_FACTORS + 1).collect()]
    cov = covariance.factor_covariance(returns, names, cfg, _latest(state.vra_factor(returns, cfg), "multiplier"))
    last = past.agg(F.max("date")).first()[0]
    snapshot = past.where(F.col("date") == F.lit(last))
    if covered is not None:
        snapshot = snapshot.join(covered.select("asset"), "asset", "left_semi")
    own = specific.specific_risk(residuals, snapshot.select("asset", "industry", "size", "volatility", "liquidity"), cfg, _latest(state.vra_specific(residuals, cfg), "multiplier"))
    meta = {"as_of": str(last), "version": cfg.version, "n_factors": len(names), "config": cfg.to_dict()}
    out = {"exposures": snapshot, "covariance": covariance.to_long(spark, cov, names), "specific": own, "industries": industries} | tables
    artifacts.save(out, meta, spark, path)
    return load(spark, path, cfg)


def load(spark: SparkSession, path: str, cfg: RiskConfig | None = None) -> RiskModel:
    own = artifacts.load(spark, path)
    cfg = cfg or RiskConfig()
    factors = [r[0] for r in own["covariance"].select("f1").distinct().orderBy("f1").collect()]
    x = full_exposures(own["exposures"], [f.removeprefix("ind_") for f in factors if f.startswith("ind_")])
    return RiskModel(spark, x, own["covariance"], own["specific"].select("asset", "vol"), factors, own["meta"], cfg)


def variant(spark: SparkSession, path: str, to: str, cfg: RiskConfig) -> RiskModel:
    """Another horizon from the same histories: covariance and specific risk again, no new regressions."""
    own = artifacts.load(spark, path)
    tables = {k: own[k] for k in ("factor_returns", "residuals", "t_stats", "exposure_history") if own[k] is not None}
    return _finish(spark, tables, own["exposures"].select("asset"), own["industries"], cfg, to)


def available_dates(spark: SparkSession, path: str) -> DataFrame:
    return artifacts.load(spark, path)["exposure_history"].select("date").distinct().orderBy("date")


def as_of(spark: SparkSession, path: str, date: str, cfg: RiskConfig) -> RiskModel:
    """The model as it stood on a formation date: only rows up to it are read; a date without a snapshot is an error."""
    own = artifacts.load(spark, path)
    day = F.lit(date).cast("date")
    snapshot = own["exposure_history"].where(F.col("date") == day)
    if snapshot.isEmpty():
        raise ValueError(f"no exposures on {date}")
    returns, residuals = own["factor_returns"].where(F.col("date") <= day), own["residuals"].where(F.col("date") <= day)
    names = [r[0] for r in returns.select("factor").distinct().orderBy("factor").limit(covariance.MOST_FACTORS + 1).collect()]
    cov = covariance.factor_covariance(returns, names, cfg, _latest(state.vra_factor(returns, cfg), "multiplier"))
    var = state.fill_median(state.specific_variance_asof(residuals, date, cfg, _latest(state.vra_specific(residuals, cfg), "multiplier")), snapshot)
    vols = specific.shrink(var.join(snapshot.select("asset", "size"), "asset").withColumn("vol", F.sqrt(F.col("var") * cfg.periods_per_year)), cfg)
    x = full_exposures(snapshot, [n.removeprefix("ind_") for n in names if n.startswith("ind_")])
    return RiskModel(spark, x, covariance.to_long(spark, cov, names), vols.select("asset", "vol"), names, {"as_of": date}, cfg)


def revalidate(spark: SparkSession, path: str, cfg: RiskConfig, etfs: DataFrame | None = None, last_weeks: int | None = None) -> DataFrame:
    """Scores of test portfolios formed on past dates against the week that followed, each with the model of its date: every week, or the last ones."""
    return revalidation.scores(artifacts.load(spark, path), cfg, f"{path}/work/revalidation-{uuid.uuid4().hex}", etfs, last_weeks)
