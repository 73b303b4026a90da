"""Evaluation and scoring of natural-language-to-graph-query systems on Spark."""

from querylens.functions.text import exact_match, extract_query, length_penalty
from querylens.operators.evaluate import evaluate, generator, rollup, row_metrics, write_report
from querylens.operators.judge import composite, execution_column, get_backend, judge_column
from querylens.operators.pattern import ged_column, ged_struct, graph_column, pattern_graph, ratio_column
from querylens.operators.schema import compile_schema, parse_rate
from querylens.operators.schema_native import compile_column
from querylens.plans.frames import ExecutionResult, GraphSession, PropertyGraph
from querylens.plans.syntax import QueryError

__all__ = [
    "ExecutionResult", "GraphSession", "PropertyGraph", "QueryError", "compile_column", "compile_schema", "composite", "evaluate", "exact_match", "execution_column", "extract_query", "ged_column",
    "ged_struct", "generator", "get_backend", "graph_column", "judge_column", "length_penalty", "parse_rate", "pattern_graph", "ratio_column", "rollup", "row_metrics", "write_report",
]
