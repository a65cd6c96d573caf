"""Window expressions over ordered series. All take the partition and order columns; none loops over dates."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorlake.config import decay

Keys = str | list[str]
FIRST, LAST, HERE = Window.unboundedPreceding, Window.unboundedFollowing, Window.currentRow


def over(by: Keys, order: Keys) -> WindowSpec:
    return Window.partitionBy(by).orderBy(order)


def through_here(by: Keys, order: Keys) -> WindowSpec:
    return over(by, order).rowsBetween(FIRST, HERE)


def trailing(by: Keys, order: Keys, rows: int, end: int = 0) -> WindowSpec:
    """`rows` rows that end `end` rows before the current one (0: with it)."""
    return over(by, order).rowsBetween(-(rows - 1) - end, -end)


def forward_fill(c: Column, by: Keys, order: Keys) -> Column:
    return F.last(c, ignorenulls=True).over(through_here(by, order))


def simple_return(c: Column, by: Keys, order: Keys) -> Column:
    """c / previous row's c - 1; missing on either side gives NULL."""
    return F.try_divide(c, F.lag(c).over(over(by, order))) - 1


def compounded(c: Column) -> Column:
    """Aggregate: product of (1 + c), less 1."""
    return F.product(1 + c) - 1


def ewma_weight(by: Keys, order: str, half_life: float) -> Column:
    """Weight of each row, 1 for the latest: the batch form's weights before normalising."""
    age = F.row_number().over(Window.partitionBy(by).orderBy(F.col(order).desc())) - 1
    return F.pow(F.lit(decay(half_life)), age)


@dataclass(frozen=True)
class Ewma:
    """s = k s + (1 - k) c, from 0 or (seeded) from the first c; before: as the row found it, NULL on the first row."""

    c: Column
    seeded: bool = False
    before: bool = False


def running(x: np.ndarray, first: np.ndarray, k: float, carried: np.ndarray | None = None) -> np.ndarray:
    """s = k s + x down each series of a batch; first marks the first row of a series, carried is the last row of the batch before.

    All series of the batch advance together, a row each at a step.
    """
    begin = np.flatnonzero(first)
    goes_on = not len(begin) or begin[0] > 0
    begin = np.r_[0, begin] if goes_on else begin
    length = np.diff(np.r_[begin, len(x)])
    order = np.argsort(-length, kind="stable")
    begin, shorter, s, out = begin[order], -length[order], np.zeros((len(begin), x.shape[1])), np.empty_like(x)
    if goes_on and carried is not None:
        s[order == 0] = carried
    for step in range(-shorter[0]):
        still = np.searchsorted(shorter, -step)
        at = begin[:still] + step
        s[:still] = k * s[:still] + x[at]
        out[at] = s[:still]
    return out


def shifted(x: np.ndarray, carried: np.ndarray | None) -> np.ndarray:
    """Each row's predecessor; carried is that of the batch's first row."""
    out = np.empty_like(x)
    out[1:], out[0] = x[:-1], 0 if carried is None else carried
    return out


def scanned(df: DataFrame, by: Keys, order: Keys, values: dict[str, Column], make: Callable, fields: dict[str, str]) -> DataFrame:
    """df with further columns (fields: name to type) that Python makes of each series in its order, a batch of rows at a time.

    make() runs once in a task and gives the function from (number of the row in its series, values with 0 for missing ones, which are there)
    to the new columns. A series may go on in the next batch: the function keeps what it carries, so memory doesn't grow with the series or the
    partition. Rows come sorted from the window that numbers them, and only they and the values are sorted, not what is made of them.
    """
    keys, orders = ([x] if isinstance(x, str) else list(x) for x in (by, order))
    rows = df.withColumns({f"_v_{n}": c.cast("double") for n, c in values.items()}).withColumn("_row", F.row_number().over(over(keys, orders)))
    rows = rows.select(*df.columns, "_row", *[f"_v_{n}" for n in values]).sortWithinPartitions(*keys, *orders)
    new = T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in fields.items()))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in (*df.schema, *new)])
    names, old = schema.names, len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if batch.num_rows:
                own = batch.columns[old + 1 :]
                x = np.column_stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in own])
                there = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in own])
                yield pa.RecordBatch.from_arrays([*batch.columns[:old], *each(batch.column(old).to_numpy(), x, there)], names=names)

    return rows.mapInArrow(run, schema)


def with_ewmas(df: DataFrame, by: Keys, order: Keys, k: float, recursions: dict[str, Ewma]) -> DataFrame:
    """Adds each recursion under its name, for histories of any length: a scan that carries one row of running values.

    Missing c count as 0, a row before the first c gives NULL.
    """
    seeded, before = (np.array([getattr(r, x) for r in recursions.values()]) for x in ("seeded", "before"))

    def make() -> Callable:
        carried = {}

        def each(number: np.ndarray, c: np.ndarray, there: np.ndarray) -> list[pa.Array]:
            first = number == 1
            share = np.where(first[:, None] & seeded[None, :], 1.0, 1 - k)
            s, n = running(c * share, first, k, carried.get("s")), running(there.astype(float), first, 1.0, carried.get("n"))
            s_before, n_before = shifted(s, carried.get("s")), shifted(n, carried.get("n"))
            n_before[first] = 0
            carried.update(s=s[-1], n=n[-1])
            return [pa.array((s_before if b else s)[:, j], mask=(n_before if b else n)[:, j] == 0) for j, b in enumerate(before)]

        return each

    return scanned(df, by, order, {n: r.c for n, r in recursions.items()}, make, dict.fromkeys(recursions, "double"))


def with_ewma(df: DataFrame, c: Column, name: str, by: Keys, order: Keys, k: float, seeded: bool, before: bool = False) -> DataFrame:
    """with_ewmas() for one recursion."""
    return with_ewmas(df, by, order, k, {name: Ewma(c, seeded, before)})


def dense_calendar(prices: DataFrame, asset: str = "asset", day: str = "date") -> DataFrame:
    """A row for each asset on each day of the calendar from its first to its last: lags then count calendar rows.

    The calendar has one row per day, so the join with it is bounded by assets times days.
    """
    days = prices.select(day).distinct()
    spans = prices.groupBy(asset).agg(F.min(day).alias("_from"), F.max(day).alias("_to"))
    grid = spans.join(days, (F.col(day) >= F.col("_from")) & (F.col(day) <= F.col("_to"))).drop("_from", "_to")
    return grid.join(prices, [asset, day], "left")


def last_distinct(df: DataFrame, day: str, n: int) -> DataFrame:
    """The rows of the last n distinct days."""
    days = df.select(day).distinct().orderBy(F.col(day).desc()).limit(n)
    return df.join(F.broadcast(days), day, "left_semi")
