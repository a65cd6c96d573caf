"""Identities, known truths and absence of look-ahead, on simulated inputs."""

from __future__ import annotations

import datetime as dt
import json
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from factorlake.config import STYLES, RiskConfig, decay
from factorlake.functions.timeseries import Ewma, with_ewma, with_ewmas
from factorlake.operators.styles import style_exposures as styles_of
from factorlake.operators import baselines, covariance, history, industry, pit, regression, risk, rolling, specific, state, transforms, universe, validation

CFG = RiskConfig()


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_standardised_fit_rows_have_mean_zero_and_unit_deviation(spark):
    rng = np.random.default_rng(1)
    rows = [("d", f"a{i}", 50.0 if i >= 100 else float(rng.normal()), float(rng.lognormal()), i < 100) for i in range(120)]
    df = transforms.standardize(transforms.winsorize(frame(spark, rows, "date string, asset string, s double, cap double, fit boolean"), "s", "date", "fit"), "s", "cap", "date", "fit").toPandas()
    own = df[df.fit]
    assert abs((own.s * own.cap).sum() / own.cap.sum()) < 1e-10 and abs(own.s.std() - 1) < 1e-10
    assert df.s.abs().max() < 6


def test_transforms_define_every_odd_case(spark):
    rows = [("d", "a", None, 1.0), ("d", "b", float("nan"), 1.0), ("d", "c", float("inf"), 2.0), ("e", "a", 1.0, 1.0), ("f", "a", 2.0, 1.0), ("f", "b", 2.0, 3.0)]
    df = transforms.process(frame(spark, rows, "date string, asset string, s double, cap double"), "s", "cap", "date").toPandas()
    assert len(df) == 6 and (df.s == 0).all()


def test_orthogonalised_is_uncorrelated(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=200)
    rows = [("d", i, float(0.7 * x[i] + rng.normal()), float(x[i]), 1.0 + i % 3) for i in range(200)]
    df = transforms.orthogonalize(frame(spark, rows, "date string, asset long, y double, x double, cap double"), "y", "x", "cap", "date").toPandas()
    assert abs(np.corrcoef(df.y, df.x)[0, 1]) < 1e-9


def simulated(n=600, k=9, seed=0):
    rng = np.random.default_rng(seed)
    x, cap, ind = rng.normal(size=(n, k)), rng.lognormal(3, 1, n), np.array([f"i{j}" for j in rng.integers(0, 4, n)])
    f, share = rng.normal(0, 0.01, k), None
    own = {f"i{j}": v for j, v in enumerate(rng.normal(0, 0.01, 4))}
    share = {j: cap[ind == j].sum() / cap.sum() for j in own}
    centre = sum(own[j] * share[j] for j in own)
    own = {j: v - centre for j, v in own.items()}
    r = 0.002 + x @ f + np.array([own[j] for j in ind]) + rng.normal(0, 1e-4, n)
    return r, x, ind, cap, f, own, share


def test_regression_recovers_known_returns():
    r, x, ind, cap, f, own, share = simulated()
    out = regression.solve_date(r, x, ind, cap, [f"s{i}" for i in range(9)])
    got = dict(zip(out["keys"], out["f"], strict=True))
    assert abs(got["market"] - 0.002) < 1e-3 and np.abs(out["f"][1:10] - f).max() < 1e-3 and out["r2"] > 0.95
    assert abs(sum(share[j] * got[f"ind_{j}"] for j in own)) < 1e-12
    assert out["t"] is not None and len(out["t"]) == 14


def test_regression_of_deficient_designs_and_few_rows():
    r, x, ind, cap, *_ = simulated(80, 2)
    x[:, 1] = 0
    out = regression.solve_date(r, x, ind, cap, ["a", "b"])
    assert out["t"] is None and abs(out["f"][2]) < 1e-12
    assert regression.solve_date(r[:40], x[:40], ind[:40], cap[:40], ["a", "b"]) is None


def test_closed_form_equals_the_solver(spark):
    r, x, ind, cap, *_ = simulated(150, 1, 3)
    day = dt.date(2024, 1, 5)
    df = frame(spark, [(day, i, float(r[i]), float(x[i, 0]), str(ind[i]), float(cap[i])) for i in range(150)], "date date, asset long, r double, x double, industry string, cap double")
    got = {q["key"]: q["value"] for q in regression.industry_style(df, "r", "x", "industry", "cap").collect()}
    out = regression.solve_date(r, x, ind, cap, ["x"])
    assert all(abs(got[k] - v) < 1e-12 for k, v in zip(out["keys"], out["f"], strict=True))
    parallel = {q["key"]: q["value"] for q in regression.fit_dates(df, ["x"]).where("kind = 'factor'").collect()}
    assert all(abs(got[k] - parallel[k]) < 1e-12 for k in got)


def factor_table(spark, f, start=dt.date(2023, 1, 2)):
    return frame(spark, [(start + dt.timedelta(i), f"f{j}", float(f[i, j])) for i in range(len(f)) for j in range(f.shape[1])], "date date, factor string, f double")


def test_covariance_scale_and_psd_in_every_mode(spark):
    rng = np.random.default_rng(4)
    f = rng.normal(0, 0.003, (300, 6))
    fr = factor_table(spark, f)
    for mode in ("none", "blend", "eigen"):
        cov = covariance.factor_covariance(fr, [f"f{j}" for j in range(6)], CFG, mode=mode)
        assert np.linalg.eigvalsh(cov).min() >= 0 and np.abs(cov - cov.T).max() < 1e-15
    vol = np.sqrt(np.diag(covariance.factor_covariance(fr, [f"f{j}" for j in range(6)], CFG)))
    assert (np.abs(vol / (0.003 * np.sqrt(252)) - 1) < 0.5).all()


def test_ewma_moments_against_numpy(spark):
    f = np.random.default_rng(5).normal(0, 0.01, (40, 3))
    got = covariance.matrix(covariance.ewma_moments(factor_table(spark, f), 10.0), "moment", ["f0", "f1", "f2"])
    w = 0.5 ** (np.arange(39, -1, -1) / 10)
    assert np.abs(got - (f * w[:, None]).T @ f / w.sum()).max() < 1e-15


def test_state_windows_equal_the_daily_fold(spark):
    f = np.random.default_rng(6).normal(0, 0.01, (60, 2))
    rows = state.factor_variance(factor_table(spark, f), RiskConfig(vol_half_life=20.0)).toPandas()
    last = rows[rows.date == rows.date.max()].set_index("factor")["var"]
    assert np.abs(last.to_numpy() - np.diag(state.replay(f, 20.0))).max() < 1e-15
    k, v = decay(20.0), 0.0
    for i, r in enumerate(rows[rows.factor == "f0"].sort_values("date").itertuples()):
        assert (np.isnan(r.var_before) if i == 0 else abs(r.var_before - v) < 1e-15)
        v = k * v + (1 - k) * r.f**2


def test_seeded_ewma_and_gaps(spark):
    df = frame(spark, [("a", i, float(i + 1)) for i in range(5)], "asset string, date int, eps double")
    got = [r["v"] for r in with_ewma(df, F.col("eps") ** 2, "v", "asset", "date", 0.9, seeded=True).orderBy("date").collect()]
    v = 1.0
    for i in range(1, 5):
        v = 0.9 * v + 0.1 * (i + 1) ** 2
    assert got[0] == pytest.approx(1.0) and got[-1] == pytest.approx(v)


def test_future_shocks_change_no_past_state(spark):
    f = np.random.default_rng(7).normal(0, 0.01, (80, 3))
    g = f.copy()
    g[60:] *= 50
    cfg = RiskConfig(vol_half_life=10.0, vra_half_life=5.0)
    a, b = (state.vra_factor(factor_table(spark, x), cfg).toPandas().sort_values("date").head(45)["multiplier"].to_numpy() for x in (f, g))
    assert np.array_equal(a, b)


def test_blend_weight_and_shrinkage(spark):
    rows = frame(spark, [("a", 0.3, 63, 0.2), ("b", None, 10, 0.2), ("c", 0.4, 126, None)], "asset string, ts_vol double, n_obs int, structural double")
    got = {r["asset"]: r for r in specific.blended(rows, CFG).collect()}
    assert got["a"]["blend_weight"] == pytest.approx(63 / 189) and got["b"]["vol"] == 0.2 and got["c"]["vol"] == 0.4
    many = frame(spark, [(f"a{i:03d}", 0.2 + (i % 7) / 50, float(i)) for i in range(100)], "asset string, vol double, size double")
    out = specific.shrink(many, CFG).toPandas().set_index("asset").vol
    before = many.toPandas().set_index("asset").vol
    assert (out - 0.26).abs().mean() < (before - 0.26).abs().mean() and len(out) == 100


def test_ranks_and_percentiles_by_cells_are_those_of_whole_groups(spark):
    rng = np.random.default_rng(5)
    odd = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 1e-300, -1e300]
    rows = [(None if i % 3 == 0 else f"d{i % 3}", i, odd[i % 8] if i % 11 == 0 else float(round(rng.normal(), 2))) for i in range(3000)]
    df = frame(spark, rows, "date string, asset int, v double")
    w = Window.partitionBy("date")
    got = specific.ranked(df, ["date"], "v", "asset").withColumn("rank", F.row_number().over(w.orderBy("v", "asset"))).withColumn("n", F.count("*").over(w))
    assert got.count() == 3000 and got.where("_rank <> rank or _n <> n").isEmpty()
    # a task sorts a cell, not a group
    _, cells = specific._cells(df, ["date"], "v")
    assert cells.agg(F.max("_c")).first()[0] < 100
    finite = df.where("v is not null and not isnan(v) and abs(v) < 10")
    own = specific.percentiles(finite, ["date"], "v", {"low": 0.01, "mid": 0.5, "high": 0.99})
    want = finite.groupBy("date").agg(*[F.percentile("v", F.lit(p)).alias(n) for n, p in (("low", 0.01), ("mid", 0.5), ("high", 0.99))])
    a, b = ({r["date"]: r for r in x.collect()} for x in (own, want))
    assert set(a) == set(b) and all(a[d][c] == pytest.approx(b[d][c], abs=1e-12) for d in b for c in ("low", "mid", "high"))


def test_shrinkage_gathers_no_date_in_a_task(spark):
    rows = frame(spark, [(f"d{i % 2}", i, 0.2 + (i % 7) / 50, float(i % 97)) for i in range(400)], "date string, asset int, vol double, size double")
    plan = specific.shrink(rows, CFG, by=["date"])._jdf.queryExecution().optimizedPlan().toString()
    assert not any("row_number" in line and "_at" not in line for line in plan.splitlines() if line.lstrip(" +-:").startswith("Window"))


def test_structural_recovers_size_effect(spark):
    rng = np.random.default_rng(8)
    size = rng.normal(size=200)
    rows = [(f"a{i}", float(np.exp(-1.5 - 0.4 * size[i] + rng.normal(0, 0.01))) if i < 150 else None, f"i{i % 3}", float(size[i]), 0.0, 0.0) for i in range(200)]
    df = frame(spark, rows, "asset string, ts_vol double, industry string, size double, volatility double, liquidity double")
    out = specific.structural(df, CFG).toPandas()
    new = out[out.ts_vol.isna()]
    want = np.exp(-1.5 - 0.4 * new["size"])
    inside = (want > out.structural.min()) & (want < out.structural.max())
    assert (np.abs(new.structural / want - 1)[inside] < 0.05).all()


def small_model(spark):
    x = np.array([[1, 0.5, -0.2], [1, -1.0, 0.3], [1, 0.2, 1.5], [1, 0.0, -1.0]])
    cov = np.array([[0.03, 0.002, 0.0], [0.002, 0.01, -0.001], [0.0, -0.001, 0.02]])
    names, vols = ["AAPL", "MSFT", "XOM", "JPM"], [0.25, 0.2, 0.22, 0.3]
    exposures = frame(spark, [(a, f"f{k}", float(x[i, k])) for i, a in enumerate(names) for k in range(3)], "asset string, factor string, x double")
    return x, cov, np.array(vols), exposures, covariance.to_long(spark, cov, ["f0", "f1", "f2"]), frame(spark, list(zip(names, vols, strict=True)), "asset string, vol double")


def test_portfolio_identities(spark):
    x, cov, vols, exposures, long_cov, spec = small_model(spark)
    w = np.array([0.5, 0.3, -0.2, 0.4])
    weights = frame(spark, [("p", a, float(v)) for a, v in zip(["aapl ", "MSFT", "XOM", "JPM"], w, strict=True)] + [("p", "ZZZ", 0.6)], "portfolio string, asset string, w double")
    own = risk.normalised(weights)
    r = risk.risk(own, exposures, long_cov, spec).first()
    full = x @ cov @ x.T + np.diag(vols**2)
    assert r["total_vol"] == pytest.approx(np.sqrt(w @ full @ w)) and r["factor_var"] + r["specific_var"] == pytest.approx(r["total_vol"] ** 2)
    parts = risk.asset_contributions(own, exposures, long_cov, spec).toPandas()
    assert parts.contribution.sum() == pytest.approx(r["total_vol"])
    assert risk.coverage(own, exposures).first()["coverage"] == pytest.approx(1 - 0.6 / 2.0)
    shock = lambda s: {q["scenario"]: q["impact"] for q in risk.stress(own, exposures, frame(spark, s, "scenario string, factor string, shock double")).collect()}
    one, two = shock([("a", "f1", -0.1)])["a"], shock([("a", "f1", -0.2)])["a"]
    assert two == pytest.approx(2 * one) and one == pytest.approx(-0.1 * float(w @ x[:, 1]))
    with pytest.raises(ValueError, match="unknown"):
        risk.stress(own, exposures, frame(spark, [("a", "nope", 1.0)], "scenario string, factor string, shock double"))
    alone = risk.asset_risk(exposures, long_cov, spec).where("asset = 'XOM'").first()
    assert alone["total_vol"] == pytest.approx(np.sqrt(full[2, 2]))
    assert risk.shepard_multiplier(0, CFG) == 1.0 and risk.shepard_multiplier(10_000, CFG) == 2.0


def test_minimum_risk_equals_the_dense_solve(spark):
    rng = np.random.default_rng(9)
    x, cov, var = rng.normal(size=(120, 3)), np.diag([0.02, 0.01, 0.03]), rng.uniform(0.01, 0.1, 120)
    rows = frame(spark, [(i, 1.0 + i, float(var[i]), 1.0, *map(float, x[i])) for i in range(120)], "asset long, cap double, var double, alpha double, f0 double, f1 double, f2 double")
    got = validation.minimum_risk(rows, ["f0", "f1", "f2"], cov).toPandas().set_index("asset").w.sort_index().to_numpy()
    want = np.linalg.solve(x @ cov @ x.T + np.diag(var), np.ones(120))
    assert np.allclose(got, want / np.abs(want).sum(), atol=1e-8) and np.abs(got).sum() == pytest.approx(1)


def test_restatements_are_invisible_before_they_are_filed(spark):
    d = dt.date
    filings = frame(spark, [("a", "revenues", d(2020 + i, 12, 31), d(2021 + i, 2, 1), 100.0 + 20 * i) for i in range(4)] + [("a", "revenues", d(2022, 12, 31), d(2024, 6, 1), 999.0)], "asset string, field string, end date, filed date, val double")
    dates = frame(spark, [(d(2024, 3, 1),), (d(2024, 7, 1),), (d(2020, 1, 1),)], "date date")
    past = {r["as_of"]: r["growth"] for r in pit.growth(pit.history(filings, dates)).collect()}
    assert past[d(2024, 3, 1)] == pytest.approx(20 / 130) and past[d(2024, 7, 1)] != past[d(2024, 3, 1)] and d(2020, 1, 1) not in past
    last = {r["as_of"]: r["val"] for r in pit.latest(filings, dates).collect()}
    assert last == {d(2024, 3, 1): 160.0, d(2024, 7, 1): 160.0}


def test_history_upsert_counts(spark):
    d = lambda i: dt.date(2024, 1, 5) + dt.timedelta(7 * i)
    prior, new = frame(spark, [(d(i), 1.0, 2.0) for i in range(10)], "date date, a double, b double"), frame(spark, [(d(i), 5.0, 7.0) for i in range(9, 13)], "date date, a double, c double")
    out = history.upsert(prior, new, ["date"])
    assert out.count() == 13 and out.where("a = 5").count() == 4 and set(out.columns) == {"date", "a", "b", "c"}
    assert history.upsert(prior, new, ["date"], 5).agg(F.min("date")).first()[0] == d(8)


def test_universe_and_industries(spark):
    reg = frame(spark, [(0, "AAA", 1, "a"), (1, "AAA-B", 1, "a2"), (2, "toolong", 2, "b"), (3, "ZZ", 3, "c")], "ord long, ticker string, cik long, title string")
    assert [r["ticker"] for r in universe.candidates(reg, 5).orderBy("ord").collect()] == ["AAA", "ZZ"]
    ranges = industry.parse_ranges(" 1 Food  Food Products\n   0100-0199 Agriculture\n   0150-0160 Twice\n 2 Beer  Beer\n   0150-0300 Brewers\n")
    assert ranges == [("Food", 100, 199), ("Food", 150, 160), ("Beer", 150, 300)]
    got = {r["asset"]: r["industry"] for r in industry.classify(frame(spark, [("x", 155), ("y", 250), ("z", None), ("q", 9000)], "asset string, sic int"), industry.code_table(spark, ranges)).collect()}
    assert got == {"x": "Food", "y": "Beer", "z": "Other", "q": "Other"}


def test_calibrated_forecasts_have_unit_bias(spark):
    rng = np.random.default_rng(10)
    rows = [(dt.date(2020, 1, 3) + dt.timedelta(7 * i), p, 0.02 * np.sqrt(52), float(rng.normal(0, 0.02)), float(0.02 * np.sqrt(52 * rng.chisquare(5) / 5))) for i in range(140) for p in ("market", "SPY")]
    df = frame(spark, [(a, b, float(c), d, e, d / 0.02) for a, b, c, d, e in rows], "date date, portfolio string, forecast_vol_ann double, realized_ret double, realized_vol_ann double, z double")
    s = validation.summary(df).toPandas()
    assert s.bias.between(0.85, 1.15).all() and len(s) == 2
    h = baselines.harness(baselines.baseline_forecasts(df, CFG), ["forecast_vol_ann", "ewma", "trailing"]).toPandas().set_index("model")
    assert h.loc["forecast_vol_ann", "qlike"] <= h.qlike.min() + 1e-9 and (h.n == h.n.iloc[0]).all()
    french = frame(spark, [(dt.date(2020, 1, 3) + dt.timedelta(7 * i), float(rng.normal(0, 0.015))) for i in range(140)], "date date, mkt double")
    ff = baselines.french_forecasts(df, french, CFG).toPandas()
    assert ff.ff.between(0.08, 0.25).all() and len(ff) == 2 * 88


def test_sources_read_their_formats(spark, tmp_path):
    from factorlake.sources import companies, prices

    (tmp_path / "reg.json").write_text(json.dumps({"0": {"cik_str": 7, "ticker": "aa", "title": "A"}, "1": {"cik_str": 8, "ticker": "B-C", "title": "B"}}))
    assert [(r["ord"], r["ticker"], r["cik"]) for r in companies.registry(spark, str(tmp_path / "reg.json")).orderBy("ord").collect()] == [(0, "AA", 7), (1, "B-C", 8)]
    unit = lambda v, end, filed, start=None, fp="FY": {"end": end, "filed": filed, "val": v, "fp": fp, "start": start}
    doc = {"cik": 7, "facts": {"us-gaap": {"Assets": {"units": {"USD": [unit(5, "2023-12-31", "2024-02-01"), unit(5, "2023-12-31", "2024-02-01")]}}, "Revenues": {"units": {"USD": [unit(9, "2023-12-31", "2024-02-01", "2023-01-01"), unit(2, "2023-03-31", "2023-05-01", "2023-01-01", "Q1")]}}}}}
    with zipfile.ZipFile(tmp_path / "facts.zip", "w") as z:
        z.writestr("CIK0000000007.json", json.dumps(doc))
        z.writestr("CIK0000000009.json", json.dumps(doc | {"cik": 9}))
    files = companies.zipped_members(spark, str(tmp_path / "facts.zip"), frame(spark, [(7,)], "cik long"))
    got = {(r["asset"], r["field"]): r["val"] for r in companies.fundamentals(companies.facts(files)).collect()}
    assert got == {(7, "total_assets"): 5.0, (7, "revenues"): 9.0}
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv/brk.b.us.csv").write_text("Date,Open,High,Low,Close\n2024-01-02,1,1,1,2.5\n2024-01-03,1,1,1,\n")
    bars = prices.load_panel(spark, str(tmp_path / "csv"), "csv", "2024-01-01", "2024-12-31").collect()
    assert [(b["ticker"], b["close"], b["volume"]) for b in bars] == [("BRK-B", 2.5, None)]
    chart = {"chart": {"result": [{"meta": {"symbol": "X"}, "timestamp": [1704153600, 1704240000], "indicators": {"quote": [{"close": [1.0, 2.0], "volume": [5, 6]}], "adjclose": [{"adjclose": [0.5, None]}]}}]}}
    (tmp_path / "x.json").write_text(json.dumps(chart))
    assert [(b["date"], b["close"]) for b in prices.chart_json(spark, str(tmp_path / "x.json")).collect()] == [(dt.date(2024, 1, 2), 0.5)]
    (tmp_path / "ff.csv").write_text("preamble\n\n,Mkt-RF,SMB,HML,RMW,CMA,RF\n20240102, 1.0,0,0,0,0,0.01\n20240103, 2.0,0,0,0,0,0.01\n\nCopyright\n")
    weekly = prices.french_weekly(prices.french_daily(spark, str(tmp_path / "ff.csv"))).collect()
    assert len(weekly) == 1 and weekly[0]["mkt_rf"] == pytest.approx(1.01 * 1.02 - 1)
    with pytest.raises(ValueError, match="provider"):
        prices.load_panel(spark, "x", "nope", "2024-01-01", "2024-01-02")


def _revalidated(spark, path, cfg, rng):
    """Every ready week is scored; one week's forecasts again from the single-date operators, its returns and volatilities by numpy."""
    from factorlake.operators import covariance, state
    from factorlake.plans import model, report, revalidation
    from factorlake.sources import artifacts

    own = artifacts.load(spark, path)
    market = own["factor_returns"].where("factor = 'market'").toPandas()
    etfs = spark.createDataFrame(pd.DataFrame({"date": market["date"], "ticker": "ETF", "r": 1.1 * market["f"] + rng.normal(0, 0.002, len(market))}))
    small = RiskConfig(**{**cfg.to_dict(), "least_returns": 20, "returns_window": 40, "optimized_names": 110})
    scores = model.revalidate(spark, path, small, etfs).toPandas()
    dates = sorted(r[0] for r in own["exposure_history"].select("date").distinct().collect())
    days = sorted(r[0] for r in own["factor_returns"].select("date").distinct().collect())
    ready = [(a, b) for a, b in zip(dates, dates[1:], strict=False) if sum(d <= a for d in days) >= max(cfg.warm_up, cfg.vol_half_life)]
    assert len(ready) > 3 and set(scores[scores["portfolio"] == "market"]["date"]) == {b for _, b in ready}
    assert {"market", "equal_weight", "style_size", "industry_g0", "random_1", "opt_minvar", "opt_alpha1", "ETF"} <= set(scores["portfolio"])
    assert scores["forecast_vol_ann"].gt(0).all() and scores["realized_vol_ann"].notna().all() and not scores.duplicated(["date", "portfolio"]).any()
    t, until = ready[-2]
    past = lambda df: df.where(F.col("date") <= F.lit(t))
    returns, residuals = past(own["factor_returns"]), past(own["residuals"])
    names = sorted(r[0] for r in returns.select("factor").distinct().collect())
    cov = covariance.factor_covariance(returns, names, small, model._latest(state.vra_factor(returns, small), "multiplier")) / 252
    week = [d for d in days if t < d <= until]
    whole = own["residuals"].where(F.col("date").isin(week)).groupBy("asset").agg(F.count("eps").alias("n")).where(F.col("n") == len(week))
    everyone = own["exposure_history"].where(F.col("date") == F.lit(t))
    snap = everyone.join(whole, "asset", "left_semi")
    assert 0 < snap.count() < everyone.count()  # one name isn't traded on a day of the week
    multiplier = model._latest(state.vra_specific(residuals, small), "multiplier")
    var = state.fill_median(state.specific_variance_asof(own["residuals"], str(t), small), snap).toPandas().set_index("asset")["var"]
    drawn, size = np.sqrt(var).to_numpy(), snap.toPandas().set_index("asset")["size"].reindex(var.index)
    bucket = np.minimum((size.rank(method="first") / len(size) * 10).astype(int), 9).to_numpy()
    for b in range(10):
        own_vols = np.sqrt(var).to_numpy()[bucket == b]
        far = 0.1 * np.abs(own_vols - own_vols.mean())
        share = far / (own_vols.std() + far)
        drawn[bucket == b] = share * own_vols.mean() + (1 - share) * own_vols
    var = pd.Series(drawn**2 * multiplier**2, index=var.index)
    x = revalidation.exposures_of(snap).toPandas().pivot(index="asset", columns="factor", values="x").reindex(columns=names).fillna(0.0)
    caps = snap.toPandas().set_index("asset")["cap"].reindex(x.index)
    w = (caps / caps.sum()).to_numpy()
    got = scores[(scores["date"] == until)].set_index("portfolio")
    e = x.to_numpy().T @ w
    want = np.sqrt(252 * (e @ cov @ e + (w**2 * var.reindex(x.index)).sum()))
    assert got.loc["market", "forecast_vol_ann"] == pytest.approx(want, rel=1e-6)
    full = x.to_numpy() @ cov @ x.to_numpy().T + np.diag(var.reindex(x.index))
    largest = caps.sort_values(ascending=False, kind="stable").index[:110]
    at = [x.index.get_loc(a) for a in largest]
    solved = np.linalg.solve(full[np.ix_(at, at)], np.ones(len(at)))
    solved /= np.abs(solved).sum()
    assert got.loc["opt_minvar", "forecast_vol_ann"] == pytest.approx(np.sqrt(252 * solved @ full[np.ix_(at, at)] @ solved), rel=1e-5)
    f = own["factor_returns"].toPandas().pivot(index="date", columns="factor", values="f").reindex(columns=names)
    eps = own["residuals"].toPandas().pivot(index="date", columns="asset", values="eps").reindex(columns=x.index)
    daily = np.array([x.to_numpy() @ f.loc[d].fillna(0.0).to_numpy() + eps.loc[d].to_numpy() for d in week])
    assert got.loc["market", "realized_ret"] == pytest.approx(np.nansum(w * (np.prod(1 + daily, axis=0) - 1)), abs=1e-9)
    assert got.loc["market", "realized_vol_ann"] == pytest.approx(np.sqrt(52 * (np.nansum(daily * w, axis=1) ** 2).sum()), rel=1e-6)
    assert 0.7 * got.loc["market", "forecast_vol_ann"] < got.loc["ETF", "forecast_vol_ann"] < 1.6 * got.loc["market", "forecast_vol_ann"]
    tables = report.validation_tables(spark.createDataFrame(scores), small)
    assert tables["fit"].first()["slope"] is not None and tables["histogram"].count() > 3
    last = model.revalidate(spark, path, small, last_weeks=2)
    assert last.select("date").distinct().count() == 2


def test_model_end_to_end(spark, tmp_path):
    """A simulated market of 120 names: build, load, as-of replay, variant, analytics; an as-of model ignores the future."""
    from factorlake.plans import model, report
    from factorlake.sources import artifacts

    rng = np.random.default_rng(11)
    days = pd.bdate_range("2022-01-03", periods=340)
    n = 120
    shocks = rng.normal(0, 0.01, 340)[:, None] * rng.uniform(0.5, 1.5, n) + rng.normal(0, 0.015, (340, n))
    close = 50 * np.exp(np.cumsum(shocks, axis=0))
    prices = spark.createDataFrame(pd.DataFrame({"date": np.repeat(days.date, n), "asset": np.tile([f"T{i:03d}" for i in range(n)], 340), "close": close.ravel(), "volume": rng.uniform(1e5, 1e6, 340 * n)}))
    fields = {"book_equity": 1e9, "total_assets": 3e9, "total_liabilities": 2e9, "net_income": 1e8, "shares_out": 1e8, "op_cashflow": 2e8, "revenues": 1e9, "gross_profit": 4e8}
    filings = spark.createDataFrame(pd.DataFrame([(f"T{i:03d}", f, dt.date(2018 + y, 12, 31), dt.date(2019 + y, 2, 15), v * (0.5 + rng.random())) for i in range(n) for f, v in fields.items() for y in range(3)], columns=["asset", "field", "end", "filed", "val"]))
    inds = spark.createDataFrame([(f"T{i:03d}", f"g{i % 4}") for i in range(n)], "asset string, industry string")
    cfg = RiskConfig(least_specific_obs=20, momentum_window=200, beta_window=120, vol_half_life=20.0, vra_half_life=10.0, warm_up=30)
    built = model.build(spark, prices, filings, inds, cfg, str(tmp_path / "m"), first_date="2022-11-15")
    assert {"market", *STYLES, "ind_g0"} <= set(built.factors)
    weights = spark.createDataFrame([("p", f"T{i:03d}", 0.05) for i in range(20)], "portfolio string, asset string, w double")
    r = built.portfolio_risk(weights).first()
    assert 0.05 < r["total_vol"] < 0.6 and r["coverage"] == 1.0 and built.portfolio_risk(weights, True).first()["total_vol"] > r["total_vol"]
    assert built.top_assets(weights, 5).count() == 5 and built.top_factors(weights, 3).count() == 3
    assert built.asset_risk("t001").first()["total_vol"] > 0
    with pytest.raises(KeyError):
        built.asset_risk("NOPE")
    t = artifacts.load(spark, str(tmp_path / "m"))
    day = str(t["exposure_history"].select("date").distinct().orderBy(F.col("date").desc()).limit(2).collect()[1][0])
    asof = model.as_of(spark, str(tmp_path / "m"), day, cfg)
    assert asof.asset_risk("T001").first()["total_vol"] > 0
    fast = model.variant(spark, str(tmp_path / "m"), str(tmp_path / "v"), cfg.short_horizon())
    assert fast.factors == built.factors
    folder, dates = str(tmp_path / "m"), sorted(r[0] for r in t["exposure_history"].select("date").distinct().collect())
    missed = t["residuals"].where(F.col("date") > F.lit(dates[-3])).agg(F.min("date")).first()[0]
    t["residuals"].where((F.col("date") != F.lit(missed)) | (F.col("asset") != "T007")).write.parquet(f"{folder}-residuals")
    spark.read.parquet(f"{folder}-residuals").write.mode("overwrite").parquet(f"{folder}/residuals.parquet" if (tmp_path / "m/residuals.parquet").exists() else f"{folder}/residuals")
    _revalidated(spark, folder, cfg, rng)
    assert "As of" in report.card(built)
    assert report.assets(built).where("industry is null").count() == 0
    report.export(built, spark, str(tmp_path / "m"), str(tmp_path / "site"))
    with pytest.raises(ValueError, match="no exposures"):
        model.as_of(spark, str(tmp_path / "m"), "1999-01-01", cfg)


def test_stream_upsert_keeps_one_row_per_key(spark, tmp_path):
    from factorlake.streaming.state_stream import compact, current, upserted

    path = str(tmp_path / "t")
    sizes = []
    for k, rows in enumerate([[(i, "a") for i in range(2000)], [(2, "b"), (3, "b")], [(3, "c"), (3, "d"), (None, "n")], [(5000, "e")], [(None, "m"), (7, "e")]]):
        spark.createDataFrame(rows, "id int, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id int, v string").parquet(str(tmp_path / "in"))
        upserted(stream, path, ["id"], 3).awaitTermination()
        sizes.append(sum(f.stat().st_size for f in (tmp_path / f"t/delta/_batch={k}").rglob("*.parquet")) if (tmp_path / f"t/delta/_batch={k}").exists() else 0)
        got = {}
        for r in current(spark, path, ["id"]).collect():
            got.setdefault(r["id"], []).append(r["v"])
        want = {i: ["a"] for i in range(2000)}
        for own in [{2: ["b"], 3: ["b"]}, {3: ["c", "d"], None: ["n"]}, {5000: ["e"]}, {None: ["m"], 7: ["e"]}][:k]:
            want |= own
        assert {x: sorted(v) for x, v in got.items()} == want, k
    assert max(sizes[1:]) < sizes[0] / 5  # a batch writes what it has
    whole = sorted(map(str, current(spark, path, ["id"]).collect()))
    batch = spark.createDataFrame([(2, "b"), (3, "b")], "id int, v string")
    from factorlake.streaming.state_stream import _bucket

    batch.withColumn("_bucket", _bucket(["id"])).write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/delta/_batch=1")
    compact(spark, path, ["id"], 2)
    assert sorted(map(str, current(spark, path, ["id"]).collect())) == whole  # a batch and a compaction that are repeated
    compact(spark, path, ["id"], 4)
    assert sorted(map(str, current(spark, path, ["id"]).collect())) == whole


def test_ordered_variance_folds_keys_by_buckets(spark, tmp_path, monkeypatch):
    """F8: calls of the state processor don't grow with the keys; late, null and unknown rows fare as before."""
    from factorlake.streaming import state_stream as ss

    monkeypatch.setattr(ss, "KEY_BUCKETS", 4, raising=False)
    rows = [(i % 300 if i % 300 else None, f"2024-01-0{1 + i % 5} 00:00:{i % 60:02d}", None if i % 7 == 0 else float(i % 11)) for i in range(3000)] + [(1, "2024-02-01 00:00:00", 1.0)]
    frame = spark.createDataFrame(rows, "asset long, ts string, val double").withColumn("ts", F.to_timestamp("ts"))
    frame.write.parquet(f"{tmp_path}/in")
    out = ss.variance_in_order(spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in"), 0.9)
    assert "bucket" in out._jdf.queryExecution().analyzed().toString()
    got = {r["asset"]: (r["n"], r["var"]) for r in ss.latest_per_key(ss.replay(out, f"{tmp_path}/out", "update"), "asset").collect()}
    want = {}
    for asset, _, v in sorted((x for x in rows[:-1] if x[2] is not None), key=lambda x: (x[1], x[2])):
        n, var = want.get(asset, (0, 0.0))
        want[asset] = n + 1, v * v if n == 0 else 0.9 * var + (1 - 0.9) * v * v
    assert got.keys() == want.keys() and all(got[a][0] == want[a][0] and abs(got[a][1] - want[a][1]) < 1e-9 for a in want)


def test_variance_is_folded_in_event_time(spark, tmp_path):
    """Rows in shuffled files, a file a batch, with less disorder than the watermark allows, give the fold of the sorted rows."""
    from factorlake.streaming.state_stream import latest_per_key, replay, variance_in_order

    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(1, 4)), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=37 * i), float(rng.normal())) for i in range(200)]
    shuffled = sorted(range(200), key=lambda i: i + rng.uniform(0, 25))
    for k in range(5):
        spark.createDataFrame([rows[i] for i in shuffled[40 * k : 40 * k + 40]], "asset long, ts timestamp, val double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("asset long, ts timestamp, val double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r["asset"]: (r["n"], r["var"]) for r in latest_per_key(replay(variance_in_order(stream, 0.9, "1 day"), str(tmp_path / "out"), "update"), "asset").collect()}
    until = rows[-1][1] - dt.timedelta(days=1)
    for asset in (1, 2, 3):
        n, var = 0, 0.0
        for a, ts, v in rows:
            if a == asset and ts < until:
                n, var = n + 1, v * v if n == 0 else 0.9 * var + 0.1 * v * v
        assert got[asset] == (n, pytest.approx(var))


# -- recursions and regressions over long histories -----------------------------------------------------


def test_ewma_over_ten_thousand_half_lives(spark):
    """A fold of 100,000 rows at half-life 10, in 20 blocks, with missing values."""
    rng = np.random.default_rng(1)
    c = rng.standard_normal(100_000) ** 2
    gone = rng.random(100_000) < 0.01
    gone[0] = False
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(100_000), "c": np.where(gone, np.nan, c)})).withColumn("c", F.nanvl("c", F.lit(None).cast("double"))).withColumn("key", F.lit(1))
    k = 0.5**0.1
    got = with_ewmas(df, "key", "i", k, {"zero": Ewma(F.col("c")), "seeded": Ewma(F.col("c"), seeded=True), "before": Ewma(F.col("c"), before=True)}).orderBy("i").toPandas()
    zero = seeded = 0.0
    want = []
    for i, x in enumerate(np.where(gone, 0.0, c)):
        before = zero
        zero, seeded = k * zero + (1 - k) * x, k * seeded + (1 - k if i else 1) * x
        want.append((zero, seeded, before if i else np.nan))
    assert np.allclose(got[["zero", "seeded", "before"]].to_numpy(), np.array(want), rtol=1e-9, equal_nan=True)


def test_rolling_regressions_by_prefix_sums(spark):
    """Against least squares on each window, with a factor that is another's double and short first windows."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((150, 3)) * [1, 1e-3, 50]
    pdf = pd.DataFrame({"key": np.repeat(["a", "b", "c"], 50), "i": np.tile(np.arange(50), 3), "y": x @ [0.5, -20, 0.01] + rng.standard_normal(150), "p": x[:, 0], "q": x[:, 1], "s": x[:, 2]})
    pdf.loc[pdf["key"] == "c", "q"] = 2 * pdf["p"]
    rows = rolling.with_gram(spark.createDataFrame(pdf), ["p", "q", "s"], "y", "key", "i", 20, 1).orderBy("key", "i").toPandas()
    rows = rows[rows["i"] >= 20]
    beta, left = rolling.solved(rolling.stacked(rows["gram"]))
    for (key, i), b, sse in zip(rows[["key", "i"]].itertuples(index=False), beta, left, strict=True):
        own = pdf[(pdf["key"] == key) & (pdf["i"] < i) & (pdf["i"] >= i - 20)]
        design = np.column_stack([np.ones(20), own[["p", "q", "s"]]])
        want = np.linalg.lstsq(design, own["y"], rcond=None)[0]
        fitted = design @ b
        assert fitted == pytest.approx(design @ want, abs=1e-7) and sse == pytest.approx(((own["y"] - fitted) ** 2).sum(), abs=1e-7)
        assert key == "c" or b == pytest.approx(want, rel=1e-6, abs=1e-9)


def test_simulated_samples_are_estimated_like_the_real_one(spark):
    cfg = RiskConfig(corr_half_life=40.0, vol_half_life=20.0)
    f = np.random.default_rng(4).normal(0, 0.01, (90, 3)) @ np.array([[1, 0.4, 0], [0, 1, 0.3], [0, 0, 1]])
    want = covariance.factor_covariance(factor_table(spark, f), ["f0", "f1", "f2"], cfg, mode="none") / cfg.periods_per_year
    assert np.abs(covariance.estimate(f, cfg) - want).max() < 1e-12


def test_eigen_profiles_are_refreshed_and_carried_on(spark):
    """A fold over 300 days that asks for a covariance each week and simulates again when 60 days have passed."""
    cfg = RiskConfig(covariance_mode="eigen", eigen_sims=30, eigen_refresh=60, corr_half_life=60.0, vol_half_life=30.0, history_days=200)
    f = np.random.default_rng(8).normal(0, 0.01, (300, 3)) @ np.array([[1, 0.6, 0.2], [0, 1, 0.5], [0, 0, 0.3]])
    returns = factor_table(spark, f)
    days = sorted(r[0] for r in returns.select("date").distinct().collect())
    asked = [n for n in range(1, 301) if n % 5 == 0 and n >= 100]
    dates = spark.createDataFrame([(days[n - 1],) for n in asked], "date date")
    regime = spark.createDataFrame([(days[n - 1], 1.0 + n / 1000) for n in asked[::2]], "date date, multiplier double")
    got = covariance.covariances_at(returns, dates, cfg, regime).toPandas()
    held, scale, simulated = None, None, 0
    for n in asked:
        cov = covariance.estimate(f[:n], cfg)
        if held is None or n - held >= 60:
            held, simulated = n, simulated + 1
            total = sum(covariance._misjudged(cov, min(n, 200), [k], cfg, n) for k in range(30))
            scale = np.clip(1.4 * (np.sqrt(total / 30) - 1) + 1, 0.5, 3.0)
        values, vectors = np.linalg.eigh(cov)
        want = (vectors * (values * scale**2)) @ vectors.T * (1.0 + n / 1000 if n in asked[::2] else 1.0) ** 2
        own = got[got["date"] == days[n - 1]].pivot(index="f1", columns="f2", values="cov").to_numpy()
        assert np.abs(own - want).max() < 1e-9 * np.abs(want).max() + 1e-12, n
    assert simulated == 4


def test_archives_are_read_by_ranges_of_members(spark, tmp_path):
    """Stored and deflated members beyond 4 GB, other names, keys pushed to the plan, and a damaged member that nobody asks for."""
    from factorlake.sources import archives, companies

    path = str(tmp_path / "bulk.zip")
    with open(path, "wb") as f:
        f.truncate(5 << 30)  # a hole: zip64 offsets without the bytes
    docs = {k: json.dumps({"cik": k, "pad": "x" * (k % 700)}) for k in range(1, 121)}
    with zipfile.ZipFile(path, "a") as z:
        for k, text in docs.items():
            z.writestr(f"a/CIK{k:010d}.json", text, zipfile.ZIP_DEFLATED if k % 2 else zipfile.ZIP_STORED)
        z.writestr("CIKnone.json", "{}")
        z.writestr("readme.txt", "no key")
    got = archives.members(spark, path, range_bytes=500)
    assert {r["key"]: r["value"] for r in got.collect()} == docs and got.rdd.getNumPartitions() > 5
    few = archives.members(spark, path, range_bytes=2000).where(F.col("key").isin(3, 4, 999))
    assert {r["key"] for r in few.collect()} == {3, 4} and few.rdd.getNumPartitions() == 1
    with zipfile.ZipFile(path) as z:
        at = z.getinfo(f"a/CIK{7:010d}.json").header_offset
    with open(path, "r+b") as f:
        f.seek(at + 60)
        f.write(b"\xff" * 8)
    assert archives.members(spark, path, payload=False).where("key = 7").first()["size"] == len(docs[7])
    wanted = frame(spark, [(k,) for k in (3, 3, 8, 9, 500, None)], "cik long")
    assert {r["cik"]: r["value"] for r in companies.zipped_members(spark, path, wanted).collect()} == {k: docs[k] for k in (3, 8, 9)}
    with pytest.raises(Exception, match="damaged|decompress"):
        archives.members(spark, path).where("key = 7").collect()
    cached = frame(spark, [(3, "kept"), (77, "other")], "cik long, value string")
    names = wanted.where("cik is not null")
    assert {r["cik"]: r["value"] for r in companies.with_prefetch(spark, cached, path, names, 2).collect()} == {3: "kept", 8: docs[8], 9: docs[9]}
    assert [r["value"] for r in companies.with_prefetch(spark, cached, "/no/such/archive", names, 4).collect()] == ["kept"]


def test_nested_store_keeps_filings_and_answers_as_of(spark):
    from factorlake.sources import store

    rng = np.random.default_rng(6)
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(int(n))
    rows = [(f"A{rng.integers(6)}", rng.choice(["x", "y"]).item(), day(30 * rng.integers(12)), day(rng.integers(400)), float(rng.integers(5))) for _ in range(300)]
    rows += rows[:5] + [("Z", "x", day(3), None, 1.0), ("A0", "x", None, day(9), 2.0)]
    filings = frame(spark, rows, "asset string, field string, end date, filed date, val double")
    dates = frame(spark, [(day(n),) for n in (-5, 0, 17, 100, 399, 900)], "date date")
    kept = store.to_store(filings)
    assert kept.where("asset = 'Z'").isEmpty() and kept.count() == 6
    flat = lambda df: sorted(map(str, df.collect()))
    assert flat(store.from_store(kept)) == flat(filings.where("filed is not null").select("asset", "field", "end", "filed", "val").distinct())
    want = flat(pit.latest(filings, dates).select("as_of", "asset", "field", "val", "end", "filed"))
    assert flat(store.asof(kept, dates)) == want
    first, more = filings.where("filed < '2020-06-01'"), filings.where("filed >= '2020-06-01'")
    assert flat(store.asof(store.appended(store.to_store(first), more), dates)) == want
    assert store.to_store(filings.limit(0)).isEmpty() and store.asof(kept.limit(0), dates).isEmpty()


def test_history_takes_the_last_periods_known(spark):
    rng = np.random.default_rng(7)
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(int(n))
    rows = {(f"A{rng.integers(3)}", "r", day(30 * rng.integers(15)), day(rng.integers(500)), float(rng.integers(50))) for _ in range(120)}
    asked = [day(n) for n in (0, 50, 200, 350, 600)]
    got = pit.history(frame(spark, sorted(rows), "asset string, field string, end date, filed date, val double"), frame(spark, [(d,) for d in asked], "date date"), 4).collect()
    want = {}
    for d in asked:
        for asset in ("A0", "A1", "A2"):
            last = {}
            for _, _, end, filed, val in sorted((r for r in rows if r[0] == asset and r[3] <= d), key=lambda r: (r[3], r[4])):
                last[end] = val
            for k, end in enumerate(sorted(last)[-4:]):
                want[d, asset, k] = (end, last[end])
    assert {(r["as_of"], r["asset"], r["period"]): (r["end"], r["val"]) for r in got} == want and len(got) == len(want)


def test_price_cache_reads_stale_tickers_only(spark, tmp_path):
    from factorlake.sources import prices

    def bars(ticker, close):
        (tmp_path / f"{ticker}.us.csv").write_text("Date,Open,High,Low,Close,Volume\n" + "".join(f"2024-01-0{d},1,1,1,{close + d},5\n" for d in (2, 3, 4)))

    def load(names, now):
        rows = prices.cached_panel(spark, str(tmp_path / "cache"), str(tmp_path / "{ticker}.us.csv"), "csv", "2024-01-03", "2024-01-31", frame(spark, [(n,) for n in names], "ticker string"), now)
        return {(r["ticker"], r["date"].day): r["close"] for r in rows.collect()}

    bars("AA", 10)
    bars("BB", 20)
    assert load(["NONE"], "2024-02-01 00:00:00") == {}
    assert load(["AA"], "2024-02-01 00:00:00") == {("AA", 3): 13, ("AA", 4): 14}
    assert load(["AA", "BB", "NONE"], "2024-02-03 00:00:00") == {("AA", 3): 13, ("AA", 4): 14, ("BB", 3): 23, ("BB", 4): 24}
    bars("AA", 100)
    bars("BB", 200)
    bars("NONE", 300)
    there = {f: f.stat().st_mtime_ns for f in (tmp_path / "cache/bars/ticker=BB").iterdir()}
    assert load(["AA", "BB"], "2024-02-03 12:00:00") == {("AA", 3): 13, ("AA", 4): 14, ("BB", 3): 23, ("BB", 4): 24}
    assert load(["AA", "BB", "NONE"], "2024-02-05 00:00:00") == {("AA", 3): 103, ("AA", 4): 104, ("BB", 3): 23, ("BB", 4): 24, ("NONE", 3): 303, ("NONE", 4): 304}
    assert {f: f.stat().st_mtime_ns for f in (tmp_path / "cache/bars/ticker=BB").iterdir()} == there
    (tmp_path / "AA.us.csv").unlink()
    assert load(["AA", "BB"], "2024-02-08 12:00:00") == {("BB", 3): 203, ("BB", 4): 204}


# -- plans that stay narrow -----------------------------------------------------------------------------


def physical(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_regressions_give_python_sums_instead_of_cross_sections(spark):
    """what reaches Python of a date are the sums of its industries; results are those of one dense problem."""
    r, x, ind, cap, *_ = simulated(300, 1, 6)
    x2, day = np.log(cap) + 5, dt.date(2024, 1, 5)
    rows = [(day, i, float(r[i]), float(x[i, 0]), float(x2[i]), str(ind[i]), float(cap[i])) for i in range(300)] + [(day, 900, None, 1.0, 1.0, "0", 1.0), (day, 901, 0.1, float("nan"), 1.0, "0", 1.0), (day, 902, 0.1, 1.0, 1.0, "9", 0.0)]
    out = regression.fit_dates(frame(spark, rows, "date date, asset long, r double, a double, b double, industry string, cap double"), ["a", "b"])
    plan = physical(out.where("kind <> 'residual'"))
    assert "HashAggregate" in plan[plan.index("FlatMapGroupsInPandas") :]
    got = {(q["kind"], q["key"]): q["value"] for q in out.collect()}
    names = np.unique(ind)
    share = np.array([cap[ind == j].sum() for j in names]) / cap.sum()
    design = np.column_stack([np.ones(300), x[:, 0], x2, *[(ind == j).astype(float) for j in names]])
    basis = np.linalg.svd(np.r_[np.zeros(3), share][None, :])[2][1:].T
    root = cap**0.25
    b = basis @ np.linalg.lstsq(design @ basis * root[:, None], r * root, rcond=None)[0]
    e = r - design @ b
    inverse = basis @ np.linalg.inv(basis.T @ (design.T * root**2) @ design @ basis) @ basis.T
    t = b / np.sqrt(np.diag(inverse) * (root**2 * e**2).sum() / (300 - basis.shape[1]))
    keys = ["market", "a", "b", *[f"ind_{j}" for j in names]]
    assert [got["factor", k] for k in keys] == pytest.approx(list(b), abs=1e-9) and [got["t", k] for k in keys] == pytest.approx(list(t), rel=1e-6)
    assert len([k for k in got if k[0] == "residual"]) == 300 and [got["residual", str(i)] for i in range(300)] == pytest.approx(list(e), abs=1e-9)
    centre = np.average(r, weights=root**2)
    assert got["r2", "r2"] == pytest.approx(1 - (root**2 * e**2).sum() / (root**2 * (r - centre) ** 2).sum(), abs=1e-9)


def test_recursions_sort_rows_once_and_carry_over_batches(spark):
    """one sort, of rows without what is made of them; series that go on in the next batch, and several in one."""
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"key": np.repeat([1, 2, 3, 4], [25, 1, 40, 3]), "i": np.concatenate([np.arange(n) for n in (25, 1, 40, 3)]), "c": rng.standard_normal(69)})
    df = spark.createDataFrame(pdf).withColumn("c", F.when(~((F.col("key") == 3) & F.col("i").isin(0, 1, 7)), F.col("c")))
    out = with_ewmas(df, "key", "i", 0.9, {"a": Ewma(F.col("c")), "b": Ewma(F.col("c"), seeded=True, before=True)})
    assert physical(out).count("Window [") == 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = out.orderBy("key", "i").toPandas()
        grams = rolling.with_gram(df.na.fill(0.0), ["c"], "i", "key", "i", 5, 2).orderBy("key", "i").toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for _, own in got.groupby("key"):
        a = b = 0.0
        seen = False
        for at, row in enumerate(own.itertuples()):
            x = 0.0 if np.isnan(row.c) else row.c
            assert np.isnan(row.b) if not seen else row.b == pytest.approx(b)
            a, b, seen = 0.9 * a + 0.1 * x, 0.9 * b + (0.1 if at else 1.0) * x, seen or not np.isnan(row.c)
            assert np.isnan(row.a) if not seen else row.a == pytest.approx(a)
    for _, own in grams.groupby("key"):
        for at, row in enumerate(own.itertuples()):
            past = own.iloc[max(0, at - 6) : max(0, at - 1)]
            assert row.gram[1] == pytest.approx(past["c"].sum(), abs=1e-9) and row.gram[0] == len(past) and row.gram[4] == pytest.approx((past["c"] * past["i"]).sum(), abs=1e-9)


def test_baselines_and_french_forecasts_sort_once(spark):
    """all recursions of a portfolio ride on one pass over its weeks."""
    df = frame(spark, [(dt.date(2024, 1, 5) + dt.timedelta(7 * i), "p", 0.1, 0.01 * i, 0.1) for i in range(60)], "date date, portfolio string, forecast_vol_ann double, realized_ret double, realized_vol_ann double")
    french = df.select("date", F.sin("realized_ret").alias("a"), F.cos("realized_ret").alias("b"))
    assert physical(baselines.baseline_forecasts(df, CFG)).count("MapInArrow") == 1
    assert physical(baselines.french_forecasts(df, french, CFG)).count("Window [") == 1


def test_random_baskets_sort_only_what_can_be_first(spark):
    """the names are those of a full sort by hash, but rows beyond the first cells are dropped before it."""
    import hashlib

    day = dt.date(2024, 1, 5)
    df = frame(spark, [(day, i) for i in range(3000)] + [(dt.date(2024, 1, 12), i) for i in range(7)], "date date, asset long")
    out = validation.random_baskets(df, 2, 50)
    got = {(str(r["date"]), r["portfolio"], r["asset"]) for r in out.collect()}
    want = set()
    for d, n in (("2024-01-05", 3000), ("2024-01-12", 7)):
        for k in (1, 2):
            want |= {(d, f"random_{k}", a) for a in sorted(range(n), key=lambda a: (hashlib.md5(f"{k}:{d}:{a}".encode()).hexdigest(), a))[:50]}  # noqa: B023
    assert got == want and "_last" in physical(out)


def test_returns_and_exposures_without_a_row_for_each_factor(spark):
    """names aren't multiplied by factors; the sums are those of long exposures."""
    from factorlake.plans import revalidation

    day, styled = dt.date(2024, 1, 5), ", ".join(f"{s} double" for s in STYLES)
    shots = frame(spark, [(day, i, ["a", "b", None][i % 3], *[float((i * (j + 3)) % 7 - 3) for j in range(len(STYLES))]) for i in range(12)], f"date date, asset long, industry string, {styled}")
    moves = frame(spark, [(day, day + dt.timedelta(d), f, 0.01 * (d + len(f))) for d in (1, 2) for f in ("market", "size", "beta", "ind_a")], "date date, day date, factor string, f double")
    x = revalidation.exposures_of(shots)
    made = revalidation.explained(shots, moves, ["date", "day"])
    want = {(r["day"], r["asset"]): r["s"] for r in x.join(moves, ["date", "factor"]).groupBy("day", "asset").agg(F.sum(F.col("x") * F.col("f")).alias("s")).collect()}
    assert {(r["day"], r["asset"]): r["s"] for r in made.collect()} == {k: pytest.approx(v) for k, v in want.items()} and "Generate" not in physical(made)
    ports = shots.select("date", F.concat(F.lit("p"), (F.col("asset") % 2).cast("string")).alias("portfolio"), "asset", (F.col("asset") / 10).alias("w"))
    own = {(r["portfolio"], r["factor"]): r["x"] for r in revalidation.portfolio_exposures(ports, shots).collect()}
    long = ports.join(x.where("factor is not null"), ["date", "asset"]).groupBy("portfolio", "factor").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
    assert own == {(r["portfolio"], r["factor"]): pytest.approx(r["x"]) for r in long.collect()}


def test_betas_bring_no_arrays_to_python(spark):
    """the price features are written once, and the market's days come to a block as plain rows."""
    from conftest import SF
    from factorlake.plans import model_queries
    from factorlake.plans import panel_queries

    kept = []
    panel, none = panel_queries.panel_w(spark, SF), model_queries.fit_universe(spark, SF)
    out = styles_of(panel, model_queries.fundamentals(spark, SF), model_queries.industries(spark, SF), model_queries.CFG, none, lambda df, name: kept.append(name) or df)
    plan = physical(out)
    assert kept == ["price-features", "formed"] and "collect_list" not in plan and "FlatMapCoGroupsInPandas" in plan
