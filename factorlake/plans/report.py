"""What a model publishes: explorer tables, a validation summary, weekly snapshots, a Markdown card."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorlake.config import RiskConfig
from factorlake.functions.scalar import bin_of, friday, rounded
from factorlake.functions.timeseries import through_here
from factorlake.operators import baselines, risk, validation
from factorlake.plans import snapshots
from factorlake.plans.model import RiskModel
from factorlake.sources import artifacts


def cumulative(returns: DataFrame, places: int = 5) -> DataFrame:
    """(week, factor, value): compounded factor returns at the end of each week."""
    run = returns.withColumn("c", F.product(1 + F.col("f")).over(through_here("factor", "date")) - 1)
    return run.groupBy(friday(F.col("date")).alias("week"), "factor").agg(F.round(F.max_by("c", "date"), places).alias("value"))


def assets(model: RiskModel, places: int = 4) -> DataFrame:
    """(asset, industry, factor_vol, specific_vol, total_vol): the industry is the one membership an asset has."""
    member = model.exposures.where("factor like 'ind_%'").groupBy("asset").agg(F.max_by(F.expr("substr(factor, 5)"), "x").alias("industry"))
    vols = risk.asset_risk(model.exposures, model.covariance, model.specific)
    return vols.join(member, "asset", "left").select("asset", "industry", *[F.round(c, places).alias(c) for c in ("factor_vol", "specific_vol", "total_vol")])


def histogram(scores: DataFrame, bins: int = 32, reach: float = 4.0) -> DataFrame:
    """(bin, n, density) of z."""
    n = scores.where("z is not null").groupBy(bin_of(F.col("z"), -reach, reach, bins).alias("bin")).agg(F.count("*").alias("n"))
    return n.withColumn("density", F.col("n") / (F.sum("n").over(Window.partitionBy()) * (2 * reach / bins)))


def forecast_fit(scores: DataFrame) -> DataFrame:
    """(slope, intercept, r2) of realised on forecast variance, over all portfolios."""
    f2, r2 = F.col("forecast_vol_ann") ** 2, F.col("realized_vol_ann") ** 2
    return scores.agg(F.regr_slope(r2, f2).alias("slope"), F.regr_intercept(r2, f2).alias("intercept"), F.regr_r2(r2, f2).alias("r2"))


def scatter_sample(scores: DataFrame, n: int) -> DataFrame:
    """n rows in hash order, the same in every run."""
    return scores.orderBy(F.md5(F.concat_ws(":", F.col("portfolio"), F.col("date").cast("string")).cast("binary")), "portfolio", "date").limit(n)


def validation_tables(scores: DataFrame, cfg: RiskConfig) -> dict[str, DataFrame]:
    return {"summary": validation.summary(scores), "histogram": histogram(scores), "fit": forecast_fit(scores), "scatter": scatter_sample(scores, 400), "bands": baselines.bias_bands(scores), "protocol": baselines.rolling_protocol(scores)}


def export(model: RiskModel, spark: SparkSession, path: str, to: str) -> None:
    """Explorer JSON: one folder of JSON lines per table, and weekly snapshots by date with their index."""
    own = artifacts.load(spark, path)
    for name, df in {"cumulative": cumulative(own["factor_returns"]), "assets": assets(model), "covariance": model.covariance}.items():
        df.write.mode("overwrite").json(f"{to}/{name}")
    if own["exposure_history"] is not None and own["residuals"] is not None:
        snapshots.write(own, model.cfg, f"{to}/history")


def card(model: RiskModel, scores: DataFrame | None = None) -> str:
    """A Markdown page on the model; tables of a row per factor or portfolio, so they are small."""
    diagonal = model.covariance.where("f1 = f2").select("f1", rounded(F.sqrt("cov"), 4)).orderBy("f1").collect()
    lines = ["# Equity factor risk model", "", f"As of {model.meta.get('as_of')}: {len(model.factors)} factors.", "", "| factor | annual volatility |", "|---|---|", *[f"| {f} | {v:.2%} |" for f, v in diagonal]]
    if scores is not None:
        lines += ["", "| portfolio | n | bias | beyond 1.96 |", "|---|---|---|---|"]
        lines += [f"| {r['portfolio']} | {r['n']} | {r['bias']:.2f} | {r['exceed']:.1%} |" for r in validation.summary(scores).orderBy("portfolio").collect()]
    return "\n".join(lines) + "\n"
