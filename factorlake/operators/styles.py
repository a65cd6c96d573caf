"""Nine style exposures for all formation dates in one plan."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorlake.config import STYLES, RiskConfig
from factorlake.functions.scalar import positive, ratio, safe_ln
from factorlake.functions.timeseries import dense_calendar, forward_fill, over, trailing
from factorlake.operators.transforms import composite, impute_group_median, orthogonalize, process

# Descriptors of the composite styles.
DESCRIPTORS = {
    "value": ["book_to_price", "earnings_to_price", "cashflow_to_price", "sales_to_price"],
    "quality": ["return_on_equity", "return_on_assets", "cashflow_to_assets", "gross_margin"],
    "leverage": ["debt_to_assets", "debt_to_equity", "market_leverage"],
}


def price_features(prices: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Per asset and calendar day: filled close, momentum, median dollar volume, padded return, day number."""
    day = prices.select("date").distinct().withColumn("day_no", F.row_number().over(Window.orderBy("date")))
    panel = dense_calendar(prices).join(day, "date")
    w = over("asset", "date")
    panel = panel.withColumn("filled", forward_fill(F.col("close"), "asset", "date"))
    panel = panel.withColumn("momentum", ratio(F.lag("filled", cfg.momentum_skip).over(w), F.lag("filled", cfg.momentum_skip + cfg.momentum_window).over(w)) - 1)
    panel = panel.withColumn("dollar_median", F.percentile(F.col("close") * F.col("volume"), F.lit(0.5)).over(trailing("asset", "date", cfg.liquidity_window)))
    return panel.withColumn("r", ratio(F.col("filled"), F.lag("filled").over(w)) - 1)


#: Blocks of names that beta_volatility() multiplies at once. A task holds one block's returns over two windows.
NAME_BLOCKS = 16


def _matrix(rows: pd.DataFrame, at: pd.Index, days: np.ndarray, key: str, value: str) -> np.ndarray:
    """Rows (key, day_no, value) as a matrix over `at` and `days`, NaN where there is none."""
    out = np.full((len(at), len(days)), np.nan)
    if len(rows):
        out[at.get_indexer(rows[key]), np.searchsorted(days, rows["day_no"])] = rows[value]
    return out


def beta_volatility(panel: DataFrame, formation: DataFrame, cfg: RiskConfig) -> DataFrame:
    """(as_of, asset, beta, volatility) over the trailing window of each formation date.

    formation: (as_of, asset, cap, in_fit). The market is weighted by the caps of the formation date over the names present each
    day. Both the market (caps x returns) and the sums behind betas (returns x market) are products of matrices, so they are made block
    by block: names by hash, formation dates by spans as long as the window. A return goes to the two spans that can need it, not to each
    of the formation dates whose window holds it.
    """
    span = cfg.beta_window
    block = F.pmod(F.xxhash64("asset"), F.lit(NAME_BLOCKS)).cast("int").alias("block")
    numbers = panel.select(F.col("date").alias("as_of"), F.col("day_no").cast("int").alias("at")).distinct()
    formed = formation.join(numbers, "as_of").select(block, F.floor(F.col("at") / span).cast("int").alias("span"), "as_of", "at", "asset", F.col("cap").cast("double").alias("cap"), "in_fit")
    each = F.explode(F.sequence(F.floor(F.col("day_no") / span).cast("int"), F.floor((F.col("day_no") + cfg.beta_window - 1) / span).cast("int"))).alias("span")
    returns = panel.where("r is not null").select(block, each, "asset", F.col("day_no").cast("int").alias("day_no"), "r")
    used = formed.select("block", "span").distinct()
    returns = returns.join(used, ["block", "span"])

    def windows(ats: np.ndarray, days: np.ndarray) -> np.ndarray:
        return (days[None, :] <= ats[:, None]) & (days[None, :] > ats[:, None] - cfg.beta_window)

    def weigh(f: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        """One block's part in the market of each formation date and day."""
        if not len(f) or not len(r):
            return pd.DataFrame({"span": [], "at": [], "day_no": [], "num": [], "den": []}, dtype=object)
        names, days, ats = pd.Index(r["asset"].unique()), np.unique(r["day_no"]), np.unique(f["at"])
        x = _matrix(r, names, days, "asset", "r")
        caps = np.zeros((len(ats), len(names)))
        held = f[f["in_fit"].fillna(False).astype(bool) & (f["cap"] > 0) & f["asset"].isin(names)]
        caps[np.searchsorted(ats, held["at"]), names.get_indexer(held["asset"])] = held["cap"]
        there = ~np.isnan(x)
        num, den = caps @ np.nan_to_num(x), caps @ there
        i, j = np.nonzero(windows(ats, days) & (den > 0))
        return pd.DataFrame({"span": f["span"].iloc[0], "at": ats[i], "day_no": days[j], "num": num[i, j], "den": den[i, j]})

    keys = ["block", "span"]
    parts = formed.groupBy(*keys).cogroup(returns.groupBy(*keys)).applyInPandas(weigh, "span int, at int, day_no int, num double, den double")
    market = parts.groupBy("span", "at", "day_no").agg((F.sum("num") / F.sum("den")).alias("m"))
    # A market's days are rows beside the returns, with their date's number: columns of arrays would be null in every return.
    right = used.join(market, "span").select("block", "span", F.lit(None).cast(formation.schema["asset"].dataType).alias("asset"), "at", "day_no", F.col("m").alias("r"))
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of its own: cogroup takes no others
    right = right.unionByName(returns.select("block", "span", "asset", F.lit(None).cast("int").alias("at"), "day_no", "r"))

    def fit(f: pd.DataFrame, both: pd.DataFrame) -> pd.DataFrame:
        m, r = both[both["at"].notna()], both[both["at"].isna()]
        if not len(f) or not len(m) or not len(r):
            return pd.DataFrame({"as_of": [], "asset": [], "beta": [], "volatility": []}, dtype=object)
        names, days, ats = pd.Index(r["asset"].unique()), np.unique(r["day_no"].astype(int)), np.unique(m["at"].astype(int))
        x = _matrix(r, names, days, "asset", "r")
        y = np.full((len(ats), len(days)), np.nan)
        m = m[m["day_no"].isin(days)]  # days on which none of this block's names has a return don't count here
        y[np.searchsorted(ats, m["at"].astype(int)), np.searchsorted(days, m["day_no"].astype(int))] = m["r"]
        p, q = (~np.isnan(x)).astype(float), (~np.isnan(y)).astype(float)
        x, y = np.nan_to_num(x), np.nan_to_num(y)
        f = f[f["asset"].isin(names) & f["at"].isin(ats)]
        i, j = names.get_indexer(f["asset"]), np.searchsorted(ats, f["at"])
        n, sx, sy, sxx, sxy, syy = ((a @ b.T)[i, j] for a, b in ((p, q), (x, q), (p, y), (x**2, q), (x, y), (p, y**2)))
        with np.errstate(divide="ignore", invalid="ignore"):
            cross, own, along = sxy - sx * sy / n, sxx - sx**2 / n, syy - sy**2 / n
            beta = np.where(along > 0, cross / along, np.nan)
            noise = np.sqrt(np.maximum(own - beta * cross, 0) / n * cfg.periods_per_year)
        enough = n >= cfg.beta_window // 2
        return pd.DataFrame({"as_of": f["as_of"], "asset": f["asset"], "beta": np.where(enough, beta, np.nan), "volatility": np.where(enough, noise, np.nan)})

    kinds = {x.name: x.dataType.simpleString() for x in formation.schema}
    return formed.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(fit, f"as_of {kinds['as_of']}, asset {kinds['asset']}, beta double, volatility double")


def descriptors(df: DataFrame) -> DataFrame:
    """Adds the fundamental ratios; df has the fundamentals and cap. Ratios to equity need positive equity."""
    be, rev, cap = positive(F.col("book_equity")), positive(F.col("revenues")), F.col("cap")
    gross = F.coalesce(F.col("gross_profit"), F.col("revenues") - F.col("cost_of_revenue"))
    return df.withColumns({
        "book_to_price": ratio(be, cap), "earnings_to_price": ratio(F.col("net_income"), cap), "cashflow_to_price": ratio(F.col("op_cashflow"), cap), "sales_to_price": ratio(rev, cap),
        "return_on_equity": ratio(F.col("net_income"), be), "return_on_assets": ratio(F.col("net_income"), F.col("total_assets")), "cashflow_to_assets": ratio(F.col("op_cashflow"), F.col("total_assets")), "gross_margin": ratio(gross, rev),
        "debt_to_assets": ratio(F.col("total_liabilities"), F.col("total_assets")), "debt_to_equity": ratio(F.col("total_liabilities"), be), "market_leverage": ratio(F.col("total_liabilities"), F.col("total_liabilities") + cap),
        "growth": F.col("sales_growth"),
    })


def style_exposures(prices: DataFrame, fundamentals: DataFrame, industries: DataFrame, cfg: RiskConfig, fit: DataFrame | None = None, keep: Callable[[DataFrame, str], DataFrame] = lambda df, _: df) -> DataFrame:
    """(date, asset, cap, industry, in_fit, nine styles).

    prices (date, asset, close, volume); fundamentals (as_of, asset, fields..., sales_growth): its dates are
    the formation dates; industries (asset, industry); fit (asset): the estimation universe, all if None. keep writes a table that several
    steps read: the price features, which are the most of the work, and the formation dates' names.
    """
    panel = keep(price_features(prices, cfg).select("date", "asset", "day_no", "filled", "momentum", "dollar_median", "r"), "price-features")
    rows = fundamentals.join(panel.select(F.col("date").alias("as_of"), "asset", "filled", "momentum", "dollar_median"), ["as_of", "asset"])
    rows = rows.join(industries, "asset", "left").withColumn("industry", F.coalesce("industry", F.lit("Other")))
    rows = rows.withColumn("cap", positive(F.col("filled") * F.col("shares_out"))).where("cap is not null")
    member = F.lit(True) if fit is None else F.col("_member").isNotNull()
    if fit is not None:
        rows = rows.join(fit.select("asset").distinct().withColumn("_member", F.lit(1)), "asset", "left")
    rows = keep(rows.withColumn("in_fit", member).drop("_member"), "formed")
    rows = rows.join(beta_volatility(panel, rows.select("as_of", "asset", "cap", "in_fit"), cfg), ["as_of", "asset"], "left")
    rows = rows.withColumn("size", safe_ln(F.col("cap"))).withColumn("liquidity", safe_ln(ratio(F.col("dollar_median"), F.col("cap"))))
    rows = descriptors(rows)
    rows = impute_group_median(rows, [d for ds in DESCRIPTORS.values() for d in ds] + ["growth"], "industry", "as_of")
    for name, parts in DESCRIPTORS.items():
        rows = composite(rows, parts, name, "cap", "as_of", "in_fit")
    rows = process(rows, list(STYLES), "cap", "as_of", "in_fit", cfg.winsor_z, cfg.winsor_passes)
    rows = orthogonalize(rows, "volatility", "beta", "cap", "as_of", "in_fit")
    return rows.select(F.col("as_of").alias("date"), "asset", "cap", "industry", "in_fit", *STYLES)
