"""Execution grading on the empty typed graph, and the bundle of row scorers.

Grades: 0.0 no query or one that can't be parsed, 0.3 fails otherwise, 0.7 runs, 1.0 runs and gives the gold query's set of
rows. Repeated (schema, pred, gold) are judged once a Python worker, from a bounded cache; no text is shuffled.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querylens.functions import text as X
from querylens.operators import pattern
from querylens.operators.schema import GraphSchema, read_schema
from querylens.plans import empty_graph
from querylens.plans.syntax import QueryError

PARSE, RUNTIME, RAN, SAME = 0.0, 0.3, 0.7, 1.0
BACKENDS = ("typed", "schemaless")
RESULT = T.StructType(
    [T.StructField("success", T.BooleanType()), T.StructField("rows", T.ArrayType(T.StringType())), T.StructField("error", T.StringType()), T.StructField("error_kind", T.StringType())]
)


def get_backend(name: str = "typed") -> str:
    name = name.strip().lower()
    if name not in BACKENDS:
        raise ValueError(f"unknown backend {name!r}; there are {', '.join(BACKENDS)}")
    return name


@lru_cache(maxsize=1024)
def _schema(text: str | None) -> GraphSchema:
    return read_schema(text)


def execute(schema_text: str | None, query: str | None, backend: str = "typed") -> tuple[bool, list[str] | None, str | None, str | None]:
    """(success, rows as a set, error, error_kind) of a query on the schema's empty graph."""
    try:
        return True, empty_graph.row_set(empty_graph.execute(query or "", _schema(schema_text) if backend == "typed" else None)), None, None
    except QueryError as problem:
        return False, None, str(problem)[:300], problem.kind
    except (RecursionError, ArithmeticError, MemoryError, TypeError, ValueError, LookupError, AttributeError) as problem:
        # queries come from models: what the evaluator can't do with their values is the query's error
        return False, None, str(problem)[:300], "runtime"


@lru_cache(maxsize=1024)  # in each Python worker
def _executed(schema_text: str | None, query: str | None, backend: str):
    return execute(schema_text, query, backend)


def grade(success: bool, error_kind: str | None) -> float:
    return RAN if success else PARSE if error_kind == "parse" else RUNTIME


@lru_cache(maxsize=4096)
def judge_one(pred: str | None, gold: str | None, schema_text: str | None, backend: str = "typed") -> float:
    """`pred` is an extracted query; `gold` is taken as it is."""
    if not pred:
        return PARSE
    ran, rows, _, kind = execute(schema_text, pred, backend)
    if not ran:
        return grade(ran, kind)
    gold_ran, gold_rows, _, _ = execute(schema_text, gold, backend)
    return SAME if gold_ran and rows == gold_rows else RAN


def execution_column(query: Column, schema: Column, backend: str = "typed") -> Column:
    """Struct of RESULT for each row."""

    @F.pandas_udf(RESULT)
    def run(queries: pd.Series, schemas: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_executed(s, q, backend) for q, s in zip(queries, schemas, strict=True)], columns=RESULT.names)

    return run(query, schema)


def judge_column(df: DataFrame, pred: str, gold: str = "cypher", schema: str = "schema", out: str = "grade", backend: str = "typed") -> DataFrame:
    """Add the grade of each row; missing columns give 0.0."""
    backend = get_backend(backend)
    if not {gold, schema} <= set(df.columns):
        return df.withColumn(out, F.lit(0.0))

    @F.pandas_udf(T.DoubleType())
    def run(preds: pd.Series, golds: pd.Series, schemas: pd.Series) -> pd.Series:
        return pd.Series([judge_one(p, g, s, backend) for p, g, s in zip(preds, golds, schemas, strict=True)], dtype=float)

    return df.withColumn(out, run(*[F.coalesce(F.col(c), F.lit("")) for c in (pred, gold, schema)]))


def rowset_equal(a: Column, b: Column) -> Column:
    """Of two arrays of canonical rows."""
    return F.array_sort(F.array_distinct(F.coalesce(a, F.array()))) == F.array_sort(F.array_distinct(F.coalesce(b, F.array())))


def composite(df: DataFrame, completion: str = "completion", gold: str = "cypher", schema: str = "schema", n_tokens: str | None = "n_tokens", weights: tuple[float, ...] = (1, 1, 1, 1), backend: str = "typed") -> DataFrame:
    """Add pred, r_judge, r_string, r_ged, r_length and their weighted sum `reward`. The query is extracted once."""
    df = df.withColumn("pred", X.extract_query(F.col(completion)))
    df = judge_column(df, "pred", gold, schema, "r_judge", backend)
    there = gold in df.columns
    df = df.withColumns(
        {
            "r_string": pattern.ratio_column("pred", gold) if there else F.lit(0.0),
            "r_ged": pattern.ged_column("pred", gold) if there else F.lit(0.0),
            "r_length": X.length_penalty(F.col(n_tokens)) if n_tokens in df.columns else F.lit(0.0),
        }
    )
    parts = ("r_judge", "r_string", "r_ged", "r_length")
    return df.withColumn("reward", sum((F.col(c) * w for c, w in zip(parts, weights, strict=True)), F.lit(0.0)))
