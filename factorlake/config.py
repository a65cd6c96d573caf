"""Parameters of the risk model. One frozen record; every operator takes the values it needs from here."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

# The factor vocabularies.
STYLES = ("size", "value", "growth", "momentum", "beta", "volatility", "liquidity", "quality", "leverage")
FUNDAMENTALS = ("book_equity", "total_assets", "total_liabilities", "net_income", "shares_out", "op_cashflow", "revenues", "gross_profit", "cost_of_revenue", "dividends_paid", "sales_growth")


@dataclass(frozen=True)
class RiskConfig:
    #: Changes with the definitions of exposures and regressions; histories of these other versions can be carried on.
    version: str = "1"
    compatible_versions: tuple[str, ...] = ()
    periods_per_year: int = 252
    days_per_week: int = 5
    weeks_per_year: int = 52
    # covariance
    corr_half_life: float = 252.0
    vol_half_life: float = 84.0
    specific_half_life: float = 84.0
    eigen_floor: float = 1e-10
    covariance_mode: str = "blend"
    eigen_sims: int = 200
    eigen_scale: float = 1.4
    eigen_clip: tuple[float, float] = (0.5, 3.0)
    eigen_refresh: int = 126
    blend_weight: float = 0.8
    blend_fraction: float = 0.25
    factor_lags: int = 5
    specific_lags: int = 1
    ratio_clip: tuple[float, float] = (0.5, 2.0)
    # volatility regime
    vra_half_life: float = 42.0
    vra_clip: tuple[float, float] = (0.5, 2.0)
    vra_cap: float = 6.25
    vra_names: int = 30
    # specific risk
    shrink: float = 0.1
    shrink_buckets: int = 10
    least_specific_obs: int = 63
    structural_obs: int = 126
    least_structural: int = 30
    warm_up: int = 126
    # exposures
    winsor_z: float = 3.0
    winsor_passes: int = 2
    momentum_skip: int = 21
    momentum_window: int = 252
    beta_window: int = 252
    liquidity_window: int = 63
    growth_periods: int = 5
    least_growth_periods: int = 3
    # universes
    least_price: float = 2.0
    least_dollar_volume: float = 1e6
    least_history_rows: int = 130
    volume_rows: int = 21
    pool: int = 3000
    coverage_price: float = 1.0
    coverage_stale_days: int = 10
    # history
    history_days: int = 780
    history_weeks: int = 156
    delist_price: float = 5.0
    delist_return: float = -0.30
    least_assets: int = 50
    # portfolios
    shepard: bool = True
    shepard_cap: float = 2.0
    optimized_names: int = 500
    random_alphas: int = 3
    random_baskets: int = 3
    basket_names: int = 50
    # baselines
    riskmetrics_decay: float = 0.94
    trailing_weeks: int = 26
    returns_window: int = 252
    least_returns: int = 126
    french_window: int = 52

    def short_horizon(self) -> RiskConfig:
        """The faster variant: half of each half-life."""
        return replace(self, vol_half_life=self.vol_half_life / 2, corr_half_life=self.corr_half_life / 2, specific_half_life=self.specific_half_life / 2, vra_half_life=self.vra_half_life / 2)

    def to_dict(self) -> dict:
        return asdict(self)


def decay(half_life: float) -> float:
    return 0.5 ** (1.0 / half_life)
