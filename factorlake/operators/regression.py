"""Constrained cross-sectional regressions, one per date, all dates in parallel.

Model of a date: r = market + styles + industry, weights sqrt(cap), with the cap-weighted industry returns
summing to zero. `industry_style` is the closed form for one style in SQL; `fit_dates` takes any number of
styles and solves one small least-squares problem per date in an Arrow-fed task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RESULT = "date date, kind string, key string, value double"


def industry_style(df: DataFrame, ret: str, style: str, industry: str, cap: str, by: str = "date") -> DataFrame:
    """(date, key, value): returns of the market, the style and each industry, by partialling the industries out.

    Within-industry weighted deviations give the style's return; industry intercepts follow, and their
    cap-weighted mean is the market's.
    """
    rows = df.where(f"{ret} is not null and {style} is not null and {cap} > 0").withColumn("_w", F.sqrt(cap))
    w = F.col("_w")
    means = rows.groupBy(by, industry).agg(F.sum(cap).alias("_c"), (F.sum(w * F.col(ret)) / F.sum(w)).alias("_r"), (F.sum(w * F.col(style)) / F.sum(w)).alias("_x"))
    both = rows.join(means, [by, industry])
    dx = F.col(style) - F.col("_x")
    slope = both.groupBy(by).agg((F.sum(w * dx * (F.col(ret) - F.col("_r"))) / F.nullif(F.sum(w * dx * dx), F.lit(0.0))).alias("_f"))
    alphas = means.join(slope, by).withColumn("_a", F.col("_r") - F.coalesce("_f", F.lit(0.0)) * F.col("_x"))
    market = F.sum(F.col("_c") * F.col("_a")).over(Window.partitionBy(by)) / F.sum("_c").over(Window.partitionBy(by))
    alphas = alphas.withColumn("_m", market)
    per_industry = alphas.select(by, F.concat(F.lit("ind_"), F.col(industry).cast("string")).alias("key"), (F.col("_a") - F.col("_m")).alias("value"))
    whole = alphas.groupBy(by).agg(F.max("_m").alias("market"), F.max("_f").alias(style))
    return per_industry.unionByName(whole.select(by, F.lit("market").alias("key"), F.col("market").alias("value"))).unionByName(whole.select(by, F.lit(style).alias("key"), F.col(style).alias("value")))


def _solved(sums: np.ndarray, cap: np.ndarray, n: np.ndarray, least: int) -> dict | None:
    """One date's returns from its industries' sums; None with fewer than `least` rows.

    sums: for each industry the products of (1, styles, r) weighted by sqrt(cap), as matrices. The restriction is met by writing the industry
    returns as combinations orthogonal to the cap shares, with the largest industry's column folded into the others. Rank-deficient designs get
    the minimum-norm solution and no t statistics.
    """
    rows, size, k = int(n.sum()), len(cap), sums.shape[1] - 1
    if rows < least:
        return None
    share = cap / cap.sum()
    big = int(share.argmax())
    rest = [j for j in range(size) if j != big]
    back = np.zeros((k + size, k + size - 1))
    back[:k, :k] = np.eye(k)
    for at, j in enumerate(rest):
        back[k + j, k + at] = 1.0
        back[k + big, k + at] = -share[j] / share[big]
    full, y = np.zeros((k + size, k + size)), np.zeros(k + size)
    whole = sums.sum(axis=0)
    full[:k, :k], y[:k] = whole[:-1, :-1], whole[:-1, -1]
    full[k:, :k], y[k:] = sums[:, 0, :-1], sums[:, 0, -1]
    full[:k, k:], full[k:, k:] = full[k:, :k].T, np.diag(sums[:, 0, 0])
    mean = whole[0, 0] / rows
    gram, right = back.T @ full @ back / mean, back.T @ y / mean
    scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    values, vectors = np.linalg.eigh(gram / np.outer(scale, scale))
    known = bool(values[0] > 1e-12 * values[-1])
    b = vectors @ (vectors.T @ (right / scale) / values) / scale if known else np.linalg.pinv(gram, rcond=1e-12, hermitian=True) @ right
    left = max(whole[-1, -1] / mean - 2 * b @ right + b @ gram @ b, 0.0)
    spread = float(whole[-1, -1] - whole[0, -1] ** 2 / whole[0, 0])
    out = {"f": back @ b, "r2": 1 - left * mean / spread if spread > 0 else None, "t": None}
    if known and rows > len(gram):
        inverse = vectors / values @ vectors.T / np.outer(scale, scale)
        se = np.sqrt(np.maximum(np.diag(back @ inverse @ back.T) * left / (rows - len(gram)), 0))
        out["t"] = np.divide(out["f"], se, out=np.full(len(se), np.nan), where=se > 0)
    return out


def solve_date(r: np.ndarray, x: np.ndarray, industry: np.ndarray, cap: np.ndarray, styles: list[str], least: int = 50) -> dict | None:
    """One date in numpy: factor returns, residuals, weighted R2 and t statistics; None with fewer than `least` usable rows."""
    ok = np.isfinite(r) & np.isfinite(x).all(axis=1) & np.isfinite(cap) & (cap > 0)
    if ok.sum() < least:
        return None
    r, x, industry, cap = r[ok], x[ok], industry[ok], cap[ok]
    names, of = np.unique(industry, return_inverse=True)
    terms, w = np.column_stack([np.ones(len(r)), x, r]), np.sqrt(cap)
    sums = np.stack([(terms[of == j] * w[of == j, None]).T @ terms[of == j] for j in range(len(names))])
    out = _solved(sums, np.bincount(of, cap), np.bincount(of), least)
    k = 1 + len(styles)
    e = r - terms[:, :-1] @ out["f"][:k] - out["f"][k:][of]
    return out | {"keys": ["market", *styles, *[f"ind_{n}" for n in names]], "ok": ok, "e": e}


def fit_dates(df: DataFrame, styles: list[str], least: int = 50) -> DataFrame:
    """df (date, asset, r, industry, cap, styles...) to long results: kind factor, t, r2 or residual (key: the asset).

    Spark sums the products of each date's industries; those few rows a date are what Python solves. Residuals are made row by row
    from the date's returns, one array a date and industry, so that no task holds a cross-section.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    own = df.select("date", "asset", *[F.col(c).cast("double").alias(c) for c in ("r", "cap", *styles)], F.coalesce(F.col("industry").cast("string"), F.lit("None")).alias("industry"))
    for c in ("r", "cap", *styles):
        own = own.where(finite(c))
    own = own.where("cap > 0")
    terms, size = [F.lit(1.0), *[F.col(c) for c in (*styles, "r")]], len(styles) + 2
    products = [F.sum(F.sqrt("cap") * a * b) for i, a in enumerate(terms) for b in terms[i:]]
    sums = own.groupBy("date", "industry").agg(F.sum("cap").alias("cap"), F.count("*").alias("n"), F.array(*products).alias("sums"))
    i, j = np.triu_indices(size)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("industry")
        full = np.zeros((len(pdf), size, size))
        full[:, i, j] = full[:, j, i] = np.stack(pdf["sums"].to_numpy())
        s = _solved(full, pdf["cap"].to_numpy(), pdf["n"].to_numpy(), least)
        if s is None:
            return pd.DataFrame({"date": [], "kind": [], "key": [], "value": []})
        day, keys = pdf["date"].iloc[0], ["market", *styles, *[f"ind_{n}" for n in pdf["industry"]]]
        parts = [("factor", keys, s["f"]), ("r2", ["r2"], [s["r2"]])]
        if s["t"] is not None:
            parts.append(("t", keys, s["t"]))
        return pd.concat([pd.DataFrame({"date": day, "kind": k, "key": key, "value": np.asarray(v, float)}) for k, key, v in parts])

    solved = sums.groupBy("date").applyInPandas(one, RESULT)
    of = solved.where("kind = 'factor'").groupBy("date").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("_f"))
    # a row a date, of as many numbers as it has factors
    rows = own.join(F.broadcast(of), "date")
    fitted = F.col("_f")["market"] + F.col("_f")[F.concat(F.lit("ind_"), "industry")]
    for s in styles:
        fitted = fitted + F.col("_f")[s] * F.col(s)
    return solved.unionByName(rows.select("date", F.lit("residual").alias("kind"), F.col("asset").cast("string").alias("key"), (F.col("r") - fitted).alias("value")))


def residuals_r2(df: DataFrame, factors: DataFrame, ret: str, style: str, industry: str, cap: str, by: str = "date") -> tuple[DataFrame, DataFrame]:
    """For the one-style model: (residual per row, weighted R2 per date)."""
    f = factors.groupBy(by).agg(F.max(F.when(F.col("key") == "market", F.col("value"))).alias("_m"), F.max(F.when(F.col("key") == style, F.col("value"))).alias("_f"))
    own = factors.where("key like 'ind_%'").select(by, F.expr("substr(key, 5)").alias("_i"), F.col("value").alias("_v"))
    rows = df.where(f"{ret} is not null and {style} is not null and {cap} > 0").join(f, by)
    rows = rows.join(own, (rows[by] == own[by]) & (rows[industry].cast("string") == own["_i"])).drop(own[by])
    rows = rows.withColumn("eps", F.col(ret) - F.col("_m") - F.coalesce("_f", F.lit(0.0)) * F.col(style) - F.col("_v")).withColumn("_w", F.sqrt(cap))
    centre = F.sum(F.col("_w") * F.col(ret)).over(Window.partitionBy(by)) / F.sum("_w").over(Window.partitionBy(by))
    around = rows.withColumn("_d", F.col(ret) - centre)
    r2 = around.groupBy(by).agg((1 - F.sum(F.col("_w") * F.col("eps") ** 2) / F.sum(F.col("_w") * F.col("_d") ** 2)).alias("r2"))
    return rows.drop("_m", "_f", "_i", "_v", "_w"), r2

