"""Single-column predicates: all rows, equality, inclusive ranges. Only numbers match; null never does."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Predicate:
    kind: str = "all"
    column: str = ""
    low: float | None = None
    high: float | None = None

    @classmethod
    def eq(cls, column: str, value: float) -> Predicate:
        return cls("eq", column, value, value)

    @classmethod
    def between(cls, column: str, low: float, high: float) -> Predicate:
        return cls("range", column, low, high)

    def condition(self) -> Column:
        if self.kind == "all":
            return F.lit(True)
        return F.col(self.column) == self.low if self.kind == "eq" else F.col(self.column).between(self.low, self.high)

    def matches(self, value: object) -> bool:
        if self.kind == "all":
            return True
        return isinstance(value, (int, float)) and not isinstance(value, bool) and self.low <= value <= self.high

    def describe(self) -> str:
        if self.kind == "all":
            return ""
        return f"{self.column} = {self.low}" if self.kind == "eq" else f"{self.column} BETWEEN {self.low} AND {self.high}"

    def to_sql(self, table: str, columns: list[str] | None = None) -> str:
        where = f" WHERE {self.describe()}" if self.kind != "all" else ""
        return f"SELECT {', '.join(columns) if columns else '*'} FROM {table}{where}"


def select(df: DataFrame, predicate: Predicate, columns: list[str] | None = None) -> DataFrame:
    """Filter and projection; both reach the scan. Unknown columns are dropped."""
    if predicate.kind != "all":
        df = df.where(predicate.condition())
    return df.select(*[c for c in columns if c in df.columns]) if columns else df


def needed_columns(predicate: Predicate, columns: list[str] | None, known: list[str]) -> list[str]:
    """What a column store has to read."""
    wanted = set(columns or known) | ({predicate.column} if predicate.kind != "all" else set())
    return [c for c in known if c in wanted]
