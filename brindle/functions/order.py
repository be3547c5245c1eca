"""Row order as data. A DataFrame is a bag, so a dataset whose order can be seen carries it in hidden columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the names of hidden columns begin with.
HIDDEN = "__brindle_"


@dataclass(frozen=True)
class Order:
    """One hidden column that rows are ordered by."""

    name: str
    ascending: bool = True

    def column(self) -> Column:
        return F.col(self.name).asc() if self.ascending else F.col(self.name).desc()


def fresh(df: DataFrame, what: str) -> str:
    """A hidden name that df doesn't have."""
    k = 0
    while f"{HIDDEN}{what}{k}" in df.columns:
        k += 1
    return f"{HIDDEN}{what}{k}"


def quoted(name: str) -> Column:
    """A column by its name alone, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(df: DataFrame) -> tuple[DataFrame, tuple[Order, ...]]:
    """df with its rows numbered as they lie: by partition, then by place. Narrow, and stable as long as the layout is."""
    name = fresh(df, "ord")
    return df.withColumn(name, F.monotonically_increasing_id()), (Order(name),)


def columns_of(order: tuple[Order, ...]) -> list[Column]:
    return [o.column() for o in order]


def visible(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith(HIDDEN)]
