"""Every query of the engine against its DuckDB SQL, and rows-only ones for rows and a stable schema."""

from __future__ import annotations

import numpy as np
import pytest
from compare import differences, views
from conftest import SF

from factorlake.plans import catalogue


@pytest.fixture(scope="module")
def con():
    return views(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_sql(spark, con, name):
    assert not differences(catalogue.QUERIES[name](spark, SF), con, catalogue.ORACLES[name])


def test_queries_without_sql_are_those_checked_below():
    assert catalogue.QUERIES.keys() - catalogue.ORACLES.keys() == {"wls_full_k", "pca_blend_psd", "eigen_bias", "minvar_weights"}


def test_least_squares_of_each_date(spark):
    """Factor returns of wls_full_k by numpy: weighted regression with the cap-weighted sum of industries held at 0."""
    from factorlake.plans import risk_queries

    xs = risk_queries.cross_section(spark, SF).toPandas()
    got = catalogue.QUERIES["wls_full_k"](spark, SF).toPandas()
    checked = 0
    for date, g in xs.groupby("date"):
        own = got[got["date"] == date].query("kind == 'factor'").set_index("key")["value"] if "factor" in set(got["kind"]) else got[(got["date"] == date) & got["key"].isin(["market", "x", "x2"])].set_index("key")["value"]
        names = sorted(g["industry"].unique())
        if len(own) == 0:
            continue
        dummies = np.array([[float(i == n) for n in names] for i in g["industry"]])
        caps = dummies.T @ g["cap"].to_numpy()
        design = np.column_stack([np.ones(len(g)), g["x"], np.log(g["cap"]), dummies])
        w = np.sqrt(g["cap"].to_numpy())
        # The constraint as one heavy row, scaled.
        free = np.zeros((1, design.shape[1]))
        free[0, 3:] = caps / caps.sum()
        basis = np.linalg.svd(free)[2][1:].T
        b = basis @ np.linalg.lstsq((design @ basis) * np.sqrt(w)[:, None], g["r"].to_numpy() * np.sqrt(w), rcond=None)[0]
        for key, value in zip(["market", "x", "x2"], b, strict=False):
            if key in own.index:
                assert own[key] == pytest.approx(value, abs=2e-5), (date, key)
                checked += 1
    assert checked > 30


def test_covariances_are_those_of_numpy(spark):
    """Both modes again from the panel's factor returns: estimate, then the blend or the simulated scale of the eigenvalues."""
    from factorlake.operators import covariance
    from factorlake.plans import risk_queries

    wide = risk_queries.factor_returns(spark, SF).toPandas().pivot(index="date", columns="factor", values="f").sort_index()
    f, cfg = wide.to_numpy(), risk_queries.CFG
    there, weight = ~np.isnan(f), 0.5 ** (np.arange(len(f) - 1, -1, -1) / cfg.corr_half_life)
    filled = np.nan_to_num(f)
    moments = (filled * weight[:, None]).T @ filled / ((there * weight[:, None]).T @ there)
    corr = moments / np.sqrt(np.outer(np.diag(moments), np.diag(moments)))
    vol = np.sqrt([covariance.estimate(f[own, k][:, None], cfg)[0, 0] for k, own in enumerate(there.T)])
    plain = corr * np.outer(vol, vol)
    values, vectors = np.linalg.eigh(corr)
    lead = (vectors[:, -2:] * values[-2:]) @ vectors[:, -2:].T
    mixed = 0.8 * corr + 0.2 * (lead + np.diag(1 - np.diag(lead)))
    want = {"pca_blend_psd": mixed / np.sqrt(np.outer(np.diag(mixed), np.diag(mixed))) * np.outer(vol, vol)}
    total = sum(covariance._misjudged(plain, len(f), [k], cfg, 0) for k in range(cfg.eigen_sims))
    scale = np.clip(cfg.eigen_scale * (np.sqrt(total / cfg.eigen_sims) - 1) + 1, *cfg.eigen_clip)
    values, vectors = np.linalg.eigh(plain)
    want["eigen_bias"] = (vectors * (values * scale**2)) @ vectors.T
    for name, m in want.items():
        rows = catalogue.QUERIES[name](spark, SF).toPandas()
        got = rows.pivot(index="f1", columns="f2", values="cov").loc[wide.columns, wide.columns].to_numpy()
        assert np.allclose(got, 252 * m, atol=2e-6, rtol=1e-5) and np.linalg.eigvalsh(got).min() > -1e-5, name



def test_minimum_risk_weights_solve_the_dense_system(spark):
    from factorlake.plans import risk_queries
    from factorlake.sources.fixtures import vecx

    larger = SF.replace("sf0.001", "sf0.01")
    wide = vecx(spark, larger).toPandas().sort_values("asset")
    got = catalogue.QUERIES["minvar_weights"](spark, larger).toPandas().set_index("asset")["w"]
    cap = 1.0 + wide["asset"] % 13
    held = wide[wide["asset"].isin(got.index)]
    assert len(held) == min(len(wide), risk_queries.CFG.optimized_names) and cap[held.index].min() >= cap.drop(held.index).max() if len(held) < len(wide) else True
    x = held[risk_queries.DIMS].to_numpy(float)
    cov = np.array([[0.04 * 0.5 ** abs(i - j) for j in range(10)] for i in range(10)])
    full = x @ cov @ x.T + np.diag((0.1 + (held["asset"] % 7) / 50.0) ** 2)
    w = np.linalg.solve(full, np.ones(len(held)))
    ratio = got[held["asset"]].to_numpy() / w
    assert np.allclose(ratio, ratio[0], rtol=1e-3)


def test_series_of_every_asset_are_there(spark):
    from factorlake.plans.panel_queries import panel_w

    n = panel_w(spark, SF).count()
    assert catalogue.QUERIES["state_var_recursive"](spark, SF).count() == n


def test_returns_based_exposures_of_every_fund(spark):
    """sf0.01 has 100 suppliers, sf0.001 only 10."""
    from factorlake.plans import risk_queries

    larger = SF.replace("sf0.001", "sf0.01")
    funds = {str(r[0]) for r in risk_queries.log_returns(spark, larger).groupBy("asset").count().where(f"count >= {risk_queries.CFG.least_returns}").collect()}
    got = {r["ticker"] for r in catalogue.QUERIES["rbsa_exposures"](spark, larger).select("ticker").distinct().collect()}
    assert got == funds and len(funds) > 20
