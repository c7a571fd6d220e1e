"""Python functions over Arrow batches, for the surface that built-in functions do not cover."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType, TimestampNTZType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SelectedColumn


@F.pandas_udf(DoubleType())
def with_tax(price: pd.Series, tax: pd.Series) -> pd.Series:
    return price * (1 + tax)


@F.udf(DoubleType())
def with_tax_by_row(price: float, tax: float) -> float:
    """A plain function, called for each row; null for nulls."""
    return None if price is None or tax is None else price * (1 + tax)


@F.arrow_udf(DoubleType())
def with_tax_arrow(price: pa.Array, tax: pa.Array) -> pa.Array:
    return pc.multiply(price, pc.add(tax, 1.0))


@F.pandas_udf(DoubleType())
def spread(values: pd.Series) -> float:
    """A user-defined aggregate: the largest less the smallest value."""
    return float(values.max() - values.min()) if len(values) else 0.0


def share_of_group(rows: pd.DataFrame) -> pd.DataFrame:
    """Each value's share of its group's sum, for applyInPandas."""
    return rows.assign(share=rows["value"] / rows["value"].sum())[["user_id", "event_id", "share"]]


@F.udtf(returnType="word string, place int")
class Words:
    """A table function: the words of a name with their places."""

    def eval(self, name: str):
        for place, word in enumerate((name or "").split(" ")):
            yield word, place


@F.udtf
class Sessions:
    """A table function over a table: its rows come by key and time, and each stretch without a gap of `minutes` is one row.

    `analyze` names the key and time columns, so the caller needs no PARTITION BY, and sees only these columns of the table. State is a
    few values, whatever the size of a key. Rows without a time are left out.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, time: AnalyzeArgument, minutes: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or None in (key.value, time.value, minutes.value):
            raise ValueError("a table, the names of its key and time columns and a number of minutes are needed")
        kinds = {f.name: f.dataType for f in rows.dataType.fields}
        if missing := {key.value, time.value} - set(kinds):
            raise ValueError(f"the table has no column {sorted(missing)}")
        schema = StructType([StructField(key.value, kinds[key.value]), StructField("start", TimestampNTZType()), StructField("n", LongType())])
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn(key.value)], orderBy=[OrderingColumn(time.value)], select=[SelectedColumn(key.value), SelectedColumn(time.value)])

    def __init__(self):
        self.now = None

    def eval(self, rows, key: str, time: str, minutes: int):
        at = rows[time]
        if at is None:
            return
        if self.now and (at - self.now[2]).total_seconds() < 60 * minutes:
            self.now[2], self.now[3] = at, self.now[3] + 1
            return
        if self.now:
            yield self.now[0], self.now[1], self.now[3]
        self.now = [rows[key], at, at, 1]

    def terminate(self):
        if self.now:
            yield self.now[0], self.now[1], self.now[3]
