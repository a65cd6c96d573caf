"""Cross-sectional transforms, for all groups (dates) of a table in one plan.

`fit` marks the rows that statistics come from; the transform then applies to all rows.
All windows share one partitioning, so chained transforms shuffle once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorlake.functions.scalar import clip, finite, mean_of

Keys = str | list[str]


def _among(fit: str | None, c: Column) -> Column:
    return c if fit is None else F.when(F.col(fit), c)


def _list(columns: Keys) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def winsorize(df: DataFrame, columns: Keys, by: Keys, fit: str | None = None, z: float = 3.0, passes: int = 2) -> DataFrame:
    """Clips each column to mean +- z standard deviations of the fit rows, again on the clipped values at each further pass."""
    w, own = Window.partitionBy(by), _list(columns)
    df = df.withColumns({c: finite(F.col(c).cast("double")) for c in own})
    for _ in range(passes):
        df = df.withColumns({f"_m_{c}": F.avg(_among(fit, F.col(c))).over(w) for c in own} | {f"_s_{c}": F.stddev_samp(_among(fit, F.col(c))).over(w) for c in own})
        df = df.withColumns({c: F.when(F.col(f"_s_{c}") > 0, clip(F.col(c), F.col(f"_m_{c}") - z * F.col(f"_s_{c}"), F.col(f"_m_{c}") + z * F.col(f"_s_{c}"))).otherwise(F.col(c)) for c in own})
    return df.drop(*[f"_{x}_{c}" for x in "ms" for c in own])


def standardize(df: DataFrame, columns: Keys, cap: str, by: Keys, fit: str | None = None) -> DataFrame:
    """(value - cap-weighted mean) / sample deviation of the fit rows; NULL without two values or any spread."""
    w, weight, own = Window.partitionBy(by), F.col(cap), _list(columns)
    made = {}
    for c in own:
        valid = F.col(c).isNotNull() & (weight > 0) & (F.lit(True) if fit is None else F.coalesce(F.col(fit), F.lit(False)))
        made[f"_n_{c}"] = F.count(F.when(valid, F.col(c))).over(w)
        made[f"_m_{c}"] = F.sum(F.when(valid, F.col(c) * weight)).over(w) / F.sum(F.when(valid, weight)).over(w)
        made[f"_s_{c}"] = F.stddev_samp(F.when(valid, F.col(c))).over(w)
    df = df.withColumns(made)
    return df.withColumns({c: F.when((F.col(f"_n_{c}") >= 2) & (F.col(f"_s_{c}") > 0), (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")) for c in own}).drop(*made)


def process(df: DataFrame, columns: Keys, cap: str, by: Keys, fit: str | None = None, z: float = 3.0, passes: int = 2) -> DataFrame:
    """Winsorised, standardised, missing to 0; many columns take as many windows as one."""
    df = standardize(winsorize(df, columns, by, fit, z, passes), columns, cap, by, fit)
    return df.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in _list(columns)})


def composite(df: DataFrame, columns: list[str], name: str, cap: str, by: Keys, fit: str | None = None) -> DataFrame:
    """Mean of the descriptors' scores that a row has, as `name`."""
    own = [f"_{c}" for c in columns]
    df = df.withColumns({f"_{c}": F.col(c) for c in columns})
    df = standardize(winsorize(df, own, by, fit), own, cap, by, fit)
    return df.withColumn(name, mean_of(*[F.col(c) for c in own])).drop(*own)


def orthogonalize(df: DataFrame, y: str, x: str, cap: str, by: Keys, fit: str | None = None) -> DataFrame:
    """y less its regression on x over the fit rows, standardised, missing to 0; y itself where x has no spread."""
    w = Window.partitionBy(by)
    yc, xc = F.col(y), F.col(x)
    both = yc.isNotNull() & xc.isNotNull()
    yf, xf = _among(fit, F.when(both, yc)), _among(fit, F.when(both, xc))
    df = df.withColumn("_b", F.regr_slope(yf, xf).over(w)).withColumn("_a", F.regr_intercept(yf, xf).over(w)).withColumn("_v", F.var_pop(xf).over(w))
    df = df.withColumn("_y", yc).withColumn("_use", F.coalesce(F.col("_v") > 0, F.lit(False)))
    df = df.withColumn("_r", yc - F.col("_a") - F.col("_b") * xc)
    df = standardize(df, "_r", cap, by, fit)
    return df.withColumn(y, F.when(F.col("_use"), F.coalesce("_r", F.lit(0.0))).otherwise(F.col("_y"))).drop("_a", "_b", "_v", "_y", "_r", "_use")


def impute_group_median(df: DataFrame, columns: Keys, group: str, by: Keys) -> DataFrame:
    """Missing values to the median of the row's group (industry) on its date."""
    w = Window.partitionBy(*_list(by), group)
    return df.withColumns({c: F.coalesce(F.col(c), F.median(c).over(w)) for c in _list(columns)})


def one_hot(df: DataFrame, column: str, values: list[str], prefix: str = "ind_") -> DataFrame:
    return df.select("*", *[F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{prefix}{v}") for v in values])
