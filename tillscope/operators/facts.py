"""How the fact table meets a dimension.

Additive measures take one of two plans, chosen from Catalyst's size estimate of the dimension:

* small dimension: join first. Catalyst broadcasts it, so the fact is never shuffled and the partial
  aggregate sends one row per group and task;
* large dimension: aggregate the fact by the join key first. The partial aggregate folds a key that
  holds a third of the fact into one row per task before anything is shuffled, so the join that
  follows sees each key once and cannot be skewed by the fact.

Distinct counts cannot be summed up, so they use a plain join (`sold_lines`); there a hot key is left
to adaptive execution, which splits skewed partitions of the fact side.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from enum import Enum
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.filters import SalesFilter, conjunction
from tillscope.functions.money import money_or_zero, money_sum
from tillscope.model import MONEY_SUM, Star


class Kind(Enum):
    MONEY = "money"
    UNITS = "units"
    COUNT = "count"
    ROWS = "rows"


@dataclass(frozen=True)
class Measure:
    """A sum or count over a fact column that may be computed in two steps.

    `stored` is the column that holds the first step in a table of stored sums (`sources.daily`).
    """

    name: str
    column: str
    kind: Kind
    stored: str

    def source(self, fact: DataFrame) -> str:
        """The column of a fact, or of stored sums of it, that the measure reads."""
        return self.stored if self.stored in fact.columns else self.column

    def first_step(self, fact: DataFrame) -> Column:
        if self.stored in fact.columns:
            total = F.sum(self.stored)
            return (total.cast(MONEY_SUM) if self.kind is Kind.MONEY else total).alias(self.name)
        aggregates = {Kind.MONEY: money_sum, Kind.UNITS: F.sum, Kind.COUNT: F.count, Kind.ROWS: lambda _: rows()}
        return aggregates[self.kind](F.col(self.column)).alias(self.name)

    def next_step(self) -> Column:
        return F.sum(self.name).alias(self.name)

    def result(self) -> Column:
        total = F.col(self.name)
        if self.kind is Kind.MONEY:
            return money_or_zero(total).alias(self.name)
        return F.coalesce(total, F.lit(0)).cast("bigint").alias(self.name)

    def named(self, name: str) -> Measure:
        return replace(self, name=name)


REVENUE = Measure("revenue", "total_amount", Kind.MONEY, "daily_revenue")
UNITS = Measure("units_sold", "quantity", Kind.UNITS, "daily_units")
LINES = Measure("order_count", "sale_id", Kind.COUNT, "daily_lines")
AMOUNTS = Measure("amounts", "total_amount", Kind.COUNT, "daily_amounts")
ROWS = Measure("row_count", "sale_id", Kind.ROWS, "daily_rows")
ADDITIVE = (REVENUE, UNITS, LINES, AMOUNTS, ROWS)


def rows() -> Column:
    """Number of rows."""
    return F.count(F.lit(1))


_SIZE_UNITS = {"": 0, "k": 1, "m": 2, "g": 3, "t": 4, "p": 5}


def _broadcast_limit(df: DataFrame) -> int:
    text = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10m").strip().lower()
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", text).groups()
    return int(number) * 1024 ** _SIZE_UNITS[unit]


def fits_broadcast(df: DataFrame) -> bool:
    """Whether Catalyst's estimate puts df under the session's broadcast threshold. Runs no job.

    Where the estimate cannot be read (a remote session), the answer is no, which is the safe plan.
    """
    try:
        estimate = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    except AttributeError:
        return False
    return estimate <= _broadcast_limit(df)


def aggregate(
    df: DataFrame, measures: Sequence[Measure], keys: Mapping[str, Column]
) -> DataFrame:
    """Measures of the fact alone, or of stored sums of it, grouped by named expressions."""
    grouped = df.groupBy(*[expr.alias(name) for name, expr in keys.items()])
    return grouped.agg(*[m.first_step(df) for m in measures]).select(
        *keys, *[m.result() for m in measures]
    )


def together(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def folded(parts: Sequence[DataFrame], key: str, measures: Sequence[Measure], derived: Sequence[Column] = ()) -> list[DataFrame]:
    """First steps of the measures by `key`, part by part: each key is in one part, and lines that lie by key stay there."""
    return [part.groupBy(key, *derived).agg(*[m.first_step(part) for m in measures]) for part in parts]


def rollup(
    fact: DataFrame | Sequence[DataFrame],
    dim: DataFrame,
    key: str,
    measures: Sequence[Measure],
    fact_keys: Mapping[str, Column] | None = None,
    dim_keys: Sequence[str] = (),
) -> DataFrame:
    """Measures over fact INNER JOIN dim, grouped by fact expressions and dimension columns.

    A fact in parts (`Star.parts`) is joined part by part, so that lines and dimension rows that lie in the same buckets
    meet where they are.
    """
    parts = [fact] if isinstance(fact, DataFrame) else list(fact)
    fact_keys = fact_keys or {}
    groups = [*fact_keys, *dim_keys]
    dim = dim.select(key, *dim_keys)
    derived = [expr.alias(name) for name, expr in fact_keys.items()]
    if fits_broadcast(dim):
        needed = dict.fromkeys(m.source(parts[0]) for m in measures if m.source(parts[0]) != key)
        lines = together([part.select(key, *needed, *derived) for part in parts])
        totals = lines.join(dim, key).groupBy(*groups).agg(*[m.first_step(lines) for m in measures])
    else:
        met = [part.join(dim, key) for part in folded(parts, key, measures, derived)]
        totals = together(met).groupBy(*groups).agg(*[m.next_step() for m in measures])
    return totals.select(*groups, *[m.result() for m in measures])


def by_product(
    star: Star,
    measures: Sequence[Measure],
    flt: SalesFilter = SalesFilter(),
    fact_keys: Mapping[str, Column] | None = None,
    product_keys: Sequence[str] = (),
    dated: Sequence[Column] = (),
) -> DataFrame:
    """Measures over sales of known products under a filter and further predicates on the date."""
    return rollup(
        [flt.on_sales(part).where(conjunction(dated)) for part in star.summed_parts("product_id")],
        flt.on_products(star.products),
        "product_id",
        measures,
        fact_keys,
        product_keys,
    )


def sold_lines(star: Star, flt: SalesFilter, *columns: str) -> DataFrame:
    """Single sales lines of known products under a filter, for measures that cannot be pre-summed."""
    products = flt.on_products(star.products).select("product_id")
    return together([flt.on_sales(part).join(products, "product_id").select(*columns) for part in star.parts("product_id")])


def grand_total(df: DataFrame, *columns: str) -> Column:
    """Sums of the given columns over the whole of df, as a struct-valued scalar subquery.

    Naming all measures of df keeps the subquery's aggregation identical to the outer one, so that
    Spark reuses its exchange and the fact is scanned once.
    """
    return df.agg(F.struct(*[F.sum(c).alias(c) for c in columns]).alias("total")).scalar()
