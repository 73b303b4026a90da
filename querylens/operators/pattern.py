"""Pattern graphs of queries, and scores that compare them.

The patterns of MATCH, CREATE and MERGE clauses are found by regular expressions, blind spots included: an arrow to the left
counts as undirected, bare arrows are not seen, stop words end a clause wherever they stand.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querylens.functions.text import STRING_LITERAL

# fixed values: what clauses, nodes and relationships look like
CLAUSE = r"\b(?:MATCH|OPTIONAL\s+MATCH|CREATE|MERGE)\b\s*(.+?)(?=\b(?:WHERE|RETURN|WITH|MATCH|OPTIONAL\s+MATCH|CREATE|MERGE|DELETE|SET|REMOVE|UNWIND|UNION|CALL|FOREACH|ORDER\s+BY|LIMIT|SKIP|$)\b)"
NODE = r"\(\s*([A-Za-z_][A-Za-z0-9_]*)?\s*(?::\s*([A-Za-z_][A-Za-z0-9_]*(?:\s*\|\s*[A-Za-z_][A-Za-z0-9_]*)*))?\s*(\{[^}]*\})?\s*\)"
RELATIONSHIP = r"-\s*\[\s*([A-Za-z_][A-Za-z0-9_]*)?\s*(?::\s*([A-Za-z_][A-Za-z0-9_]*(?:\s*\|\s*[A-Za-z_][A-Za-z0-9_]*)*))?\s*(\*[^]]*)?\s*(\{[^}]*\})?\s*\]\s*(-?\>?)"
UNLABELED = "_unlabeled_"
MAX_SIZE = 20
BUDGET = 10_000  # expansions of one edit distance, about three seconds
LONG_BUDGET = 100_000  # where exact answers are worth half a minute

GRAPH = T.StructType(
    [
        T.StructField("nodes", T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("label", T.StringType())]))),
        T.StructField("edges", T.ArrayType(T.StructType([T.StructField("src", T.StringType()), T.StructField("dst", T.StringType()), T.StructField("type", T.StringType())]))),
    ]
)


def top_level_pieces(text: str) -> list[str]:
    """The text cut at commas that are in no bracket; an empty last piece is dropped."""
    pieces, depth = [""], 0
    for ch in text:
        if ch == "," and not depth:
            pieces.append("")
            continue
        depth = max(0, depth + (ch in "([{") - (ch in ")]}"))
        pieces[-1] += ch
    return pieces if pieces[-1] else pieces[:-1]


@lru_cache(maxsize=4096)
def pattern_graph(query: str | None) -> tuple[tuple[str, ...], tuple[tuple[int, int, str], ...]]:
    """Labels of the nodes n0, n1, ... and (src, dst, type) of the edges."""
    labels: list[str] = []
    edges: list[tuple[int, int, str]] = []
    bound: dict[str, int] = {}
    first = lambda names: names.split("|")[0].strip() or UNLABELED
    bodies = re.findall(CLAUSE, re.sub(STRING_LITERAL, "''", query or ""), re.I | re.S)
    for piece in (p for body in bodies if re.search(NODE, body) for p in top_level_pieces(body)):
        ends = []
        for var, names, _ in re.findall(NODE, piece):
            if var not in bound or not var:
                labels.append(first(names))
                bound[var] = len(labels) - 1
            ends.append(bound[var])
        for (_, names, _, _, arrow), src, dst in zip(re.findall(RELATIONSHIP, piece, re.S), ends, ends[1:], strict=False):
            edges.append((src, dst, first(names)))
            if ">" not in arrow:
                edges.append((dst, src, first(names)))
    return tuple(labels), tuple(edges)


@F.pandas_udf(GRAPH)
def graph_column(queries: pd.Series) -> pd.DataFrame:
    rows = [pattern_graph(q) for q in queries]
    return pd.DataFrame(
        {
            "nodes": [[{"id": f"n{i}", "label": x} for i, x in enumerate(labels)] for labels, _ in rows],
            "edges": [[{"src": f"n{a}", "dst": f"n{b}", "type": t} for a, b, t in edges] for _, edges in rows],
        }
    )


def node_labels(body: Column) -> Column:
    """First label of each node pattern in a clause body, natively; without a label UNLABELED."""
    return F.transform(F.regexp_extract_all(body, F.lit(NODE), 2), lambda s: F.when(s == "", UNLABELED).otherwise(F.trim(F.get(F.split(s, r"\|"), F.lit(0)))))


def relationship_types(body: Column) -> Column:
    return F.transform(F.regexp_extract_all(body, F.lit("(?s)" + RELATIONSHIP), 2), lambda s: F.when(s == "", UNLABELED).otherwise(F.trim(F.get(F.split(s, r"\|"), F.lit(0)))))


def clause_bodies(query: Column) -> Column:
    return F.regexp_extract_all(query, F.lit("(?is)" + CLAUSE), 1)


def graph_size(graph: Column) -> Column:
    return F.size(graph["nodes"]) + F.size(graph["edges"])


def label_overlap(pred: Column, gold: Column) -> Column:
    """Half the share of the gold labels, as a set, that `pred` has; both are arrays."""
    return 0.5 * F.size(F.array_intersect(pred, gold)) / F.greatest(F.size(F.array_distinct(gold)), F.lit(1))


def edit_distance(a: tuple, b: tuple, budget: int | None = None) -> tuple[float, bool]:
    """Least number of node and edge insertions, deletions and relabelings between two pattern graphs, and if it is exact.

    Branch and bound over node assignments: what is left costs at least what the multisets of labels and of types of the
    nodes and edges left differ in. Without a budget the search ends by itself and is exact; when a budget of expansions
    runs out, the best distance found so far is given, which is never below the exact one.
    """
    (la, ea), (lb, eb) = a, b

    def between(edges):
        out: dict[tuple[int, int], Counter] = {}
        for s, d, t in edges:
            out.setdefault((s, d), Counter())[t] += 1
        return out

    wa, wb = between(ea), between(eb)
    none = Counter()
    unlike = lambda x, y: max(x.total(), y.total()) - (x & y).total()
    best, left = len(la) + len(lb) + len(ea) + len(eb), float("inf") if budget is None else budget
    # of the edges of a, the types of those that end at node i or later
    after_a = [Counter(t for s, d, t in ea if max(s, d) >= i) for i in range(len(la) + 1)]

    def edge_cost(done: tuple, i: int, j: int | None) -> int:
        """Of the edges between node i, mapped to j, and the nodes mapped before, and of its loops."""
        cost = 0
        for k, m in [*enumerate(done), (i, j)]:
            for p, q in {((i, k), (j, m)), ((k, i), (m, j))}:
                x = wa.get(p, none)
                y = wb.get(q, none) if None not in q else none
                cost += unlike(x, y)
        return cost

    def bound(done: tuple) -> int:
        used = {j for j in done if j is not None}
        nodes = unlike(Counter(la[len(done) :]), Counter(x for j, x in enumerate(lb) if j not in used))
        return nodes + unlike(after_a[len(done)], Counter(t for s, d, t in eb if s not in used or d not in used))

    todo: list[tuple[int, tuple]] = [(0, ())]
    while todo:
        cost, done = todo.pop()
        if cost + bound(done) >= best:
            continue
        if left <= 0:
            return float(best), False
        left -= 1
        i = len(done)
        if i == len(la):
            best = cost + bound(done)  # all that is left is insertions
            continue
        options = [(edge_cost(done, i, j) + (la[i] != lb[j]), j) for j in range(len(lb)) if j not in done]
        options.append((edge_cost(done, i, None) + 1, None))
        todo += [(cost + extra, (*done, j)) for extra, j in sorted(options, key=lambda o: (o[0], o[1] is None), reverse=True)]
    return float(best), True


def ged_score(pred: str | None, gold: str | None, budget: int | None = BUDGET) -> tuple[float, bool]:
    """Of two queries, after extraction of `pred`: 1 - distance / larger size; label overlap for large graphs; 0 for empty ones.

    The second value tells if the score is exact, that is if the budget was enough; without a budget it always is.
    """
    if not pred or not gold:
        return 0.0, True
    a, b = pattern_graph(pred), pattern_graph(gold)
    size = [len(g[0]) + len(g[1]) for g in (a, b)]
    if not all(size):
        return 0.0, True
    if max(size) > MAX_SIZE:
        return 0.5 * len({*a[0]} & {*b[0]}) / max(len({*b[0]}), 1), True
    distance, exact = edit_distance(a, b, budget)
    return max(0.0, 1 - distance / max(size)), exact


def string_ratio(pred: str | None, gold: str | None) -> float:
    """Matching-block ratio of the stripped texts, gold first; 0 if either is empty."""
    return difflib.SequenceMatcher(None, gold.strip(), pred.strip()).ratio() if pred and gold else 0.0


GED = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("exact", T.BooleanType())])


def ged_struct(pred: str | Column, gold: str | Column, budget: int | None = BUDGET) -> Column:
    """Struct (score, exact) of each row; with no budget every score is exact, however long that takes."""

    @F.pandas_udf(GED)
    def run(preds: pd.Series, golds: pd.Series) -> pd.DataFrame:
        cached = lru_cache(maxsize=4096)(lambda p, g: ged_score(p, g, budget))
        return pd.DataFrame([cached(p, g) for p, g in zip(preds, golds, strict=True)], columns=GED.names)

    return run(pred, gold)


def ged_column(pred: str | Column, gold: str | Column, budget: int | None = BUDGET) -> Column:
    return ged_struct(pred, gold, budget)["score"]


@F.pandas_udf(T.DoubleType())
def ratio_column(pred: pd.Series, gold: pd.Series) -> pd.Series:
    return pd.Series([string_ratio(p, g) for p, g in zip(pred, gold, strict=True)], dtype=float)
