"""Order-free equality of DataFrames: commutative fingerprints of their rows, without collecting or sorting any.

A row becomes one text by its columns' places, not names: numbers by their value (1, 1.0 and true are one), other values with
their kind, each with its length before it, so different rows have different texts. The text's 128-bit digest is split into
two numbers, and a frame's fingerprint is the rows' number and the digests' sums modulo 2^64, which no order changes. Sums are
made where the rows are; as sets, digests are first made distinct, which shuffles 16 bytes a row, after partial aggregation.

Defined results: null equals null and NaN equals NaN; -0.0 equals 0.0; dates and times equal their ISO texts; real numbers
without a fraction equal whole ones below 10^37; decimals with a fraction are compared as doubles; structs are compared by
their fields in order, maps by their sorted entries. Frames without rows are equal, whatever their columns.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORD = Decimal(2**64)
_EXACT = 1e37  # doubles below it fit a decimal of 38 digits


def _sized(text: Column) -> Column:
    return F.concat(F.length(text).cast("string"), F.lit(":"), text)


def canonical(value: Column, kind: T.DataType) -> Column:
    """A value as text; equal values of whatever type have equal texts."""
    if isinstance(kind, T.NullType):
        return F.lit("-")
    return F.coalesce(_known(value, kind), F.lit("-"))


def _known(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        return F.concat(F.lit("n"), value.cast("int").cast("string"))
    if isinstance(kind, T.IntegralType):
        return F.concat(F.lit("n"), value.cast("string"))
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        real = value.cast("double") + F.lit(0.0)  # no negative zero
        whole = (real == F.floor(F.when(F.abs(real) < 9e18, real).otherwise(0.0))) | (F.abs(real) >= 9e18)
        exact = value.cast("decimal(38,0)") if isinstance(kind, T.DecimalType) else real.try_cast("decimal(38,0)")
        fits = ~F.isnan(real) & (F.abs(real) < _EXACT) & whole
        return F.concat(F.lit("n"), F.when(fits, exact.cast("string")).otherwise(real.cast("string")))
    if isinstance(kind, T.ArrayType):
        return F.concat(F.lit("l"), F.array_join(F.transform(value, lambda x: _sized(canonical(x, kind.elementType))), ""))
    if isinstance(kind, T.StructType):
        parts = [_sized(canonical(value[f.name], f.dataType)) for f in kind.fields]
        return F.when(value.isNotNull(), F.concat(F.lit("s"), *parts))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(value), lambda x: F.concat(_sized(canonical(x["key"], kind.keyType)), _sized(canonical(x["value"], kind.valueType))))
        return F.concat(F.lit("m"), F.array_join(F.transform(F.array_sort(entries), _sized), ""))
    if isinstance(kind, T.BinaryType):
        return F.concat(F.lit("b"), F.hex(value))
    return F.concat(F.lit("t"), value.cast("string"))


def digests(df: DataFrame) -> DataFrame:
    """Two numbers, each of 64 bits, for each row."""
    texts = [_sized(canonical(F.col(f"`{c}`"), f.dataType)) for c, f in zip(_distinct_names(df), df.schema.fields, strict=True)]
    row = F.md5(F.concat(F.lit(f"{len(texts)}|"), *texts))
    half = lambda start: F.conv(F.substring(row, start, 16), 16, 10).cast("decimal(20,0)")
    return df.toDF(*_distinct_names(df)).select(half(1).alias("high"), half(17).alias("low"))


def _distinct_names(df: DataFrame) -> list[str]:
    return [f"c{k}" for k in range(len(df.columns))]


def fingerprint(df: DataFrame, as_set: bool = True) -> DataFrame:
    """One row: n, high and low; equal for frames of the same rows, as sets or with their numbers of repeats."""
    rows = digests(df)
    rows = rows.distinct() if as_set else rows
    total = lambda c: F.coalesce(F.sum(F.col(c).cast("decimal(28,0)")), F.lit(0)) % F.lit(_WORD)
    return rows.agg(F.count(F.lit(1)).alias("n"), total("high").cast("decimal(20,0)").alias("high"), total("low").cast("decimal(20,0)").alias("low"))


def same_rows(a: DataFrame, b: DataFrame, as_set: bool = True) -> DataFrame:
    """One row: `equal`, and the rows of both that count."""
    both = fingerprint(a, as_set).withColumn("side", F.lit(0)).unionByName(fingerprint(b, as_set).withColumn("side", F.lit(1)))
    equal = (F.min("n") == F.max("n")) & (F.min("high") == F.max("high")) & (F.min("low") == F.max("low"))
    return both.agg(equal.alias("equal"), F.max(F.when(F.col("side") == 0, F.col("n"))).alias("n_left"), F.max(F.when(F.col("side") == 1, F.col("n"))).alias("n_right"))
