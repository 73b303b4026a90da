"""Compiles queries to DataFrames over a property graph; Catalyst plans the joins.

A graph holds one DataFrame per label (with `id`) and, per relationship type, one DataFrame for each pair of end labels (with
`src` and `dst`, and `eid` if two edges can have equal ends). A variable v is held as columns: `v:label`, `v:id` and `v:<property>`
for nodes, `v:type`, `v:from:id`, `v:to:id`, `v:eid` and properties for relationships, and a column `v` for values. Only columns
the query names are read, and a path's end node is not joined when just its id or label is asked for.
"""

from __future__ import annotations

import itertools
import threading
import uuid
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querylens.plans import syntax as S
from querylens.plans import types as Y
from querylens.plans.binder import Binder, Catalog
from querylens.plans.checkpoints import checkpointed

SEEN_PARTS = 16  # rounds of a growing frontier whose results are one checkpoint again
SHARED_FROM = 16  # seeds from which on what a pivot reaches is held once for all that reach the pivot
PIVOTS = 2
BROADCAST_NODES = 200_000
PAIRS_A_TASK = 16_000_000
LAZY_HOPS = 8  # paths that can be longer grow round by round, each checkpointed, until a round adds none
ROW_CAP = 10_001
RUN_ERRORS = (PySparkException, Py4JJavaError)  # the second where several stages fail at once


@dataclass
class PropertyGraph:
    """nodes: label -> DataFrame with id; rels: type -> [(start label, end label, DataFrame with src and dst)]."""

    nodes: dict[str, DataFrame] = field(default_factory=dict)
    rels: dict[str, list[tuple[str, str, DataFrame]]] = field(default_factory=dict)

    def catalog(self) -> Catalog:
        ends = {k: ({(a, b) for a, b, _ in v}, {c for _, _, d in v for c in d.columns} - {"src", "dst", "eid"}) for k, v in self.rels.items()}
        return Catalog({k: set(d.columns) for k, d in self.nodes.items()}, ends)


@dataclass
class ExecutionResult:
    success: bool
    rows: list[tuple] | None = None
    error: str | None = None
    error_kind: str | None = None

    def grade(self) -> float:
        return 0.7 if self.success else 0.0 if self.error_kind == "parse" else 0.3


class GraphSession:
    """Runs queries over a graph. mode "typed": unknown names fail; "schemaless": unknown labels and types match nothing.

    max_hops: an upper bound for variable-length relationships that have none of their own; by default paths grow until
    none can.
    """

    def __init__(self, spark: SparkSession, graph: PropertyGraph, mode: str = "typed", max_hops: int | None = None):
        self.spark, self.graph, self.mode, self.max_hops = spark, graph, mode, max_hops
        self.counts: dict[int, tuple[DataFrame, int]] = {}

    def rows_of(self, labels: list[str]) -> int:
        """Rows of the labels' tables (of all, without); each table is counted once, files by their footers alone."""
        total = 0
        for label in labels or self.graph.nodes:
            d = self.graph.nodes.get(label)
            if d is not None:
                if id(d) not in self.counts:
                    self.counts[id(d)] = d, d.count()
                total += self.counts[id(d)][1]
        return total

    def execute(self, query: str) -> DataFrame:
        """The query's result, lazily; raises QueryError. Updates change the session's graph by making new DataFrames."""
        parsed = S.parse(query)
        Binder(self.graph.catalog() if self.mode == "typed" else None).query(parsed)
        try:
            frames = [_Part(self).run(clauses) for clauses in parsed.parts]
            out = frames[0]
            for frame, keep_all in zip(frames[1:], parsed.keep_all, strict=True):
                out = out.union(frame)
                out = out if keep_all else out.distinct()
            return out
        except (AnalysisException, RecursionError) as problem:
            raise S.BindProblem(str(problem)[:300]) from problem

    def run(self, query: str, timeout_s: float | None = None) -> ExecutionResult:
        """Rows (ROW_CAP at most) or a classified error; a query over its time is cancelled."""
        with deadline(self.spark, timeout_s) as late:
            try:
                frame = self.execute(query).limit(ROW_CAP)
                return ExecutionResult(True, [tuple(r) for r in frame.collect()])
            except S.QueryError as problem:
                return ExecutionResult(False, None, str(problem)[:300], "timeout" if late.is_set() else problem.kind)
            except RUN_ERRORS as problem:
                return ExecutionResult(False, None, str(problem)[:300], "timeout" if late.is_set() else "runtime")
            except Exception as problem:
                if not late.is_set():
                    raise
                return ExecutionResult(False, None, str(problem)[:300], "timeout")


@contextmanager
def deadline(spark: SparkSession, seconds: float | None):
    """Jobs that this thread starts inside are one group, cancelled when the time is over, as are those it starts after that.

    Gives an event that tells whether the time was over.
    """
    group, late, done, sc = f"query-{uuid.uuid4()}", threading.Event(), threading.Event(), spark.sparkContext

    def watch() -> None:
        left = seconds
        while not done.wait(left):
            late.set()
            sc.cancelJobGroup(group)
            left = 0.5

    sc.setJobGroup(group, "query", interruptOnCancel=True)
    watcher = threading.Thread(target=watch, daemon=True)
    if seconds:
        watcher.start()
    try:
        yield late
    finally:
        done.set()
        if seconds:
            watcher.join()
        sc.setLocalProperty("spark.jobGroup.id", None)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def mentioned(clauses: list) -> dict[str, set[str]]:
    """For each variable the properties that the clauses name; "*" where it is used whole."""
    out: dict[str, set[str]] = {}

    def expression(e) -> None:
        if not isinstance(e, tuple) or not e:
            return
        if e[0] == "prop" and e[1][0] == "var":
            out.setdefault(e[1][1], set()).add(e[2])
        elif e[0] == "call" and e[1] in ("id", "labels", "label", "type", "count") and e[3] and e[3][0][0] == "var":
            out.setdefault(e[3][0][1], set())
        elif e[0] == "null" and e[1][0] == "var":
            out.setdefault(e[1][1], set())
        elif e[0] == "var":
            out.setdefault(e[1], set()).add("*")
        elif e[0] == "exists":
            paths(e[1])
            expression(e[2])
        else:
            for x in S.children(e):
                expression(x)
            if e[0] == "each":
                for x in e[2:]:
                    expression(x)

    def paths(some: list[S.Path]) -> None:
        for p in some:
            for item in (*p.nodes, *p.rels):
                for key, value in item.props:
                    if item.var:
                        out.setdefault(item.var, set()).add(key)
                    expression(value)

    for c in clauses:
        if isinstance(c, S.Match):
            paths(c.paths)
            expression(c.where)
        elif isinstance(c, S.Create):
            paths(c.paths)
            for item in (x for _, items in c.on for x in items if x[0] == "assign"):
                expression(item[1])
                expression(item[2])
        elif isinstance(c, S.Unwind):
            expression(c.value)
        elif isinstance(c, S.Projection):
            # a node that is only handed on keeps what later clauses name
            for e, name in c.items:
                if not (e[0] == "var" and not c.final and name == e[1]):
                    expression(e)
            for e, _ in c.order:
                expression(e)
            expression(c.where)
        elif isinstance(c, S.Change):
            for item in c.items:
                for e in item[1:] if item[0] == "assign" else [item]:
                    if e[0] == "var":
                        out.setdefault(e[1], set())
                    else:
                        expression(e)
    return out


def conjuncts(e: tuple | None) -> list[tuple]:
    return [] if e is None else conjuncts(e[2]) + conjuncts(e[3]) if e[:2] == ("bin", "AND") else [e]


def simple(e) -> bool:
    """Nothing in it needs more than the variables it names: no subquery, label test or list projection."""
    return not isinstance(e, (tuple, list)) or (not e or e[0] not in ("exists", "has", "each")) and all(map(simple, e))


def repeats_dont_count(clauses: list) -> list[bool]:
    """For each clause whether rows may come more or less often without changing the result: a projection soon makes them distinct."""
    out, later = [], False
    for c in reversed(clauses):
        if isinstance(c, S.Projection):
            said = [e for e, _ in (*c.items, *c.order)]
            later = all(map(_set_aggregates, said)) if any(map(S.has_aggregate, said)) else c.distinct
        elif not isinstance(c, (S.Match, S.Unwind)):
            later = False
        out.append(later)
    return out[::-1]


def _set_aggregates(e: tuple) -> bool:
    """Every aggregate in it gives the same for a row that comes twice."""
    if e[0] == "call" and e[1] in S.AGGREGATES:
        return e[1] in ("min", "max") or e[2] and e[1] != "count_rows"
    return all(map(_set_aggregates, S.children(e)))


def turned(path: S.Path) -> S.Path:
    """The same pattern, written from its other end."""
    flipped = {"out": "in", "in": "out", "both": "both"}
    return S.Path(path.var, path.nodes[::-1], [replace(r, direction=flipped[r.direction]) for r in path.rels[::-1]])


class _Part:
    def __init__(self, session: GraphSession):
        self.session, self.graph = session, session.graph
        self.kinds: dict[str, str] = {}  # variable -> node, rel, value
        self.anonymous = itertools.count()
        self.one = session.spark.range(1).select()
        self.df: DataFrame | None = None
        self.once: tuple[DataFrame | None, set[str]] = None, set()  # a frame whose rows differ in these nodes' ids

    def run(self, clauses: list) -> DataFrame:
        self.named = mentioned(clauses)
        as_sets = repeats_dont_count(clauses)
        for k, (clause, self.as_set) in enumerate(zip(clauses, as_sets, strict=True), 1):
            self.later = mentioned(clauses[k:])
            if isinstance(clause, S.Match):
                self.match(clause)
            elif isinstance(clause, S.Unwind):
                self.unwind(clause)
            elif isinstance(clause, S.Projection):
                out = self.project(clause)
                if clause.final:
                    return out
            elif isinstance(clause, S.Create):
                self.create(clause)
            elif isinstance(clause, S.Change):
                self.change(clause)
            elif isinstance(clause, S.Foreach):
                self.foreach(clause)
        return self.session.spark.createDataFrame([], "done boolean")

    def unwind(self, clause: S.Unwind) -> None:
        """A row for each item; none for null, one for a value that is no list."""
        df = self.frame()
        kind, items = self.typer(self.kinds, df).of(clause.value), self.value(clause.value, df=df)
        if Y.is_list(kind):
            self.df = df.withColumn(clause.var, F.explode(items))
        else:
            self.df = df.withColumn(clause.var, items).filter(F.col(f"`{clause.var}`").isNotNull())
        self.kinds[clause.var] = "value"

    def frame(self) -> DataFrame:
        return self.one if self.df is None else self.df

    # --- patterns
    def nodes_of(self, var: str, labels: list[str], props: set[str]) -> DataFrame:
        """All nodes of the labels (of any, without) as the columns of `var`."""
        found = []
        for label in labels or sorted(self.graph.nodes):
            if label in self.graph.nodes:
                d = self.graph.nodes[label]
                keep = [c for c in d.columns if c != "id" and ("*" in props or c in props)]
                found.append(d.select(F.lit(label).alias(f"{var}:label"), F.col("id").alias(f"{var}:id"), *[F.col(c).alias(f"{var}:{c}") for c in keep]))
        return _union(found) if found else self.session.spark.createDataFrame([], f"`{var}:label` string, `{var}:id` long")

    def edges_of(self, var: str, rel: S.Rel, props: set[str]) -> DataFrame:
        """All edges of the types as `var` columns, in the pattern's direction: from `var.from` to `var.to`."""
        found = []
        for kind in rel.types or sorted(self.graph.rels):
            for start, end, d in self.graph.rels.get(kind, []):
                keep = [c for c in d.columns if c not in ("src", "dst", "eid") and ("*" in props or c in props)]
                whole = d.select(
                    F.lit(kind).alias(f"{var}:type"), F.lit(start).alias("a:label"), F.col("src").alias("a:id"), F.lit(end).alias("b:label"), F.col("dst").alias("b:id"),
                    self.edge_key(kind, start, end, d).alias(f"{var}:eid"), *[F.col(c).alias(f"{var}:{c}") for c in keep],
                )
                found.append(whole)
        if not found:
            return self.session.spark.createDataFrame([], ", ".join(f"`{var}:{c}` {t}" for c, t in (("type", "string"), ("from:label", "string"), ("from:id", "long"), ("to:label", "string"), ("to:id", "long"), ("eid", "string"))))
        d = _union(found)
        ways = []
        if rel.direction in ("out", "both"):
            ways.append(("a", "b"))
        if rel.direction in ("in", "both"):
            ways.append(("b", "a"))
        rest = [F.col(f"`{c}`") for c in d.columns if c[:2] not in ("a:", "b:") or c.startswith(f"{var}:")]
        turned = [d.select(*rest, *[F.col(f"`{x}:{c}`").alias(f"{var}:{n}:{c}") for x, n in zip(way, ("from", "to"), strict=True) for c in ("label", "id")]) for way in ways]
        if len(turned) == 2:  # a loop is met once
            turned[1] = turned[1].filter((F.col(f"`{var}:from:id`") != F.col(f"`{var}:to:id`")) | (F.col(f"`{var}:from:label`") != F.col(f"`{var}:to:label`")))
        return _union(turned)

    @staticmethod
    def edge_key(kind: str, start: str, end: str, d: DataFrame) -> Column:
        """What tells an edge from all others: its type with its eid, or with its ends where it has none."""
        ends = F.concat_ws(">", F.lit(start), "src", F.lit(end), "dst")
        return F.concat(F.lit(kind + ":"), F.coalesce(F.col("eid").cast("string"), ends) if "eid" in d.columns else ends)

    def reached(self, var: str, rel: S.Rel, seeds: DataFrame) -> DataFrame:
        """Pairs of seeds and the nodes that a path leads to, each once.

        A walk between two nodes holds a path without a repeated edge, so none is kept. Without a bound, many seeds mostly
        reach the same nodes: what a pivot reaches is found once, and every seed that reaches the pivot has all of it and what
        it reaches outside; their pairs are a product that is not written. Other seeds are taken with the next pivot, or walk.
        """
        low, high = rel.hops
        bounds = [x for x in (self.session.max_hops if high is None else high, self.most_hops(rel)) if x is not None]
        most = min(bounds) if bounds else None
        step = self.edges_of("s", S.Rel(None, rel.types, rel.direction), set())
        step = checkpointed(step.select(*[F.col(f"`s:{c}`").alias(f"s:{c}") for c in ("from:label", "from:id", "to:label", "to:id")]).distinct())
        start = checkpointed(seeds.select(*[F.col(c).alias(f"{var}:{e}:{c}") for e in ("from", "to") for c in ("label", "id")]))
        found = []
        while most is None and len(found) < 2 * PIVOTS and start.limit(SHARED_FROM).count() == SHARED_FROM:
            parts, rest, step = self.by_pivot(var, low, start, step)
            if not parts:
                break
            found, start = found + parts, rest
        return _union([*found, self.walk(var, low, most, start, step)]).withColumn(f"{var}:eids", F.array().cast("array<string>"))

    @staticmethod
    def walk(var: str, low: int, most: int | None, start: DataFrame, step: DataFrame) -> DataFrame:
        """A frontier that grows by nodes not seen before. Each round meets the edges with the last round's new pairs only,
        and ends when there are none; what is written is every pair once. Edges with `s:way` are for seeds of that label.
        """
        pair = [f"{var}:{e}:{c}" for e in ("from", "to") for c in ("label", "id")]
        frontier, k = checkpointed(start), 0
        seen, n_new = None if low else frontier, frontier.count()
        on = (F.col(f"`{var}:to:id`") == F.col("`s:from:id`")) & (F.col(f"`{var}:to:label`") == F.col("`s:from:label`"))
        if "s:way" in step.columns:
            on &= F.col(f"`{var}:from:label`") == F.col("`s:way`")
        while n_new and (most is None or k < most):
            k += 1
            near = F.broadcast(frontier) if n_new <= BROADCAST_NODES else frontier
            new = step.join(near, on).select(*[F.col(f"`{c}`") for c in pair[:2]], *[F.col(f"`s:to:{c}`").alias(f"{var}:to:{c}") for c in ("label", "id")]).distinct()
            frontier = checkpointed(new if seen is None else new.join(seen, pair, "left_anti"))
            if not (n_new := frontier.count()):
                break
            seen = frontier if seen is None else seen.union(frontier)
            if k % SEEN_PARTS == 0:  # a plan of few parts
                seen = checkpointed(seen)
        return start.limit(0) if seen is None else seen

    def by_pivot(self, var: str, low: int, start: DataFrame, step: DataFrame) -> tuple[list[DataFrame], DataFrame, DataFrame]:
        """Pairs of the seeds that reach the pivot, the other seeds, and the edges that these may meet; no pairs where none reach it.

        What the pivot reaches is closed: a path that enters it doesn't leave. So beyond it, seeds walk on edges that don't
        lead into it; and none of the others reaches a node that reaches the pivot.
        """
        at = lambda e: [F.col(f"`s:{e}:{c}`").alias(c) for c in ("label", "id")]
        named = lambda e: [F.col(c).alias(f"{var}:{e}:{c}") for c in ("label", "id")]
        counts = [step.select(*at(e)).groupBy("label", "id").agg(F.count(F.lit(1)).alias(e)) for e in ("from", "to")]
        best = counts[0].join(counts[1], ["label", "id"]).orderBy(F.desc(F.least("from", "to")), F.desc(F.greatest("from", "to")), "label", "id").first()
        if best is None:
            return [], start, step
        turned = step.select(*[F.col(f"`s:{a}:{c}`").alias(f"s:{b}:{c}") for a, b in (("to", "from"), ("from", "to")) for c in ("label", "id")])
        both = step.withColumn("s:way", F.lit("out")).unionByName(turned.withColumn("s:way", F.lit("in")))
        ways = self.session.spark.createDataFrame([("out",), ("in",)], "way string")
        pivot = ways.select(F.col("way").alias(f"{var}:from:label"), F.lit(best["id"]).alias(f"{var}:from:id"), F.lit(best["label"]).alias(f"{var}:to:label"), F.lit(best["id"]).alias(f"{var}:to:id"))
        met = checkpointed(self.walk(var, 1, None, pivot, both))
        ends = met.select(F.col(f"`{var}:from:label`").alias("way"), *[F.col(f"`{var}:to:{c}`").alias(c) for c in ("label", "id")])
        before = ends.filter("way = 'in'").drop("way")
        own = self.session.spark.createDataFrame([(best["label"], best["id"])], before.schema)
        closed = checkpointed(ends.filter("way = 'out'").drop("way").union(own).distinct())

        def among(d: DataFrame, nodes: DataFrame, names: list[str], how: str) -> DataFrame:
            return d.join(nodes.select(*[F.col(c).alias(f"__{c}") for c in ("label", "id")]), (F.col(f"`{names[0]}`") == F.col("__label")) & (F.col(f"`{names[1]}`") == F.col("__id")), how)

        seed, to = [f"{var}:from:label", f"{var}:from:id"], ["s:to:label", "s:to:id"]
        taken, rest = checkpointed(among(start, before, seed, "left_semi")), checkpointed(among(start, before, seed, "left_anti"))
        n_taken, n_closed = taken.count(), closed.count()
        if not n_taken:
            return [], start, step
        tasks = max(self.session.spark.sparkContext.defaultParallelism, min(n_closed, n_taken * n_closed // PAIRS_A_TASK))
        left, right = taken.select(*[F.col(f"`{c}`") for c in seed]), closed.select(*named("to"))
        if min(n_taken, n_closed) > BROADCAST_NODES:
            product = left.crossJoin(right)
        elif n_taken < n_closed:
            product = right.repartition(tasks).crossJoin(F.broadcast(left)).select(*left.columns, *right.columns)
        else:
            product = left.repartition(tasks).crossJoin(F.broadcast(right))
        outside = self.walk(var, low, None, among(taken, closed, seed, "left_anti"), checkpointed(among(step, closed, to, "left_anti")))
        return [product, outside], rest, checkpointed(among(step, before, ["s:from:label", "s:from:id"], "left_anti"))

    def ends_suffice(self, clause: S.Match) -> bool:
        """Whether the clause is one relationship of any length, of which later clauses ask for the ids of its ends alone."""
        if clause.optional or not self.as_set or self.df is not None or self.kinds or len(clause.paths) != 1 or len(clause.paths[0].nodes) != 2:
            return False
        path = clause.paths[0]
        (a, b), (rel,) = path.nodes, path.rels
        if not rel.hops or rel.var or rel.props or path.var in self.named or rel.hops[0] > (rel.direction != "both") or a.also or b.also or b.props or a.var and a.var == b.var:
            return False
        return all(self.later.get(n.var, set()) <= {"id"} for n in (a, b)) and all(simple(e) and set(mentioned([S.Match([], e, False)])) <= {a.var} for e in conjuncts(clause.where))

    def match_ends(self, clause: S.Match) -> None:
        """The pairs of ends as they are reached, with no join for what only the clause's own conditions ask."""
        path = clause.paths[0]
        first, last = [replace(n, var=n.var or f"_n{next(self.anonymous)}") for n in path.nodes]
        kinds: dict[str, str] = {}
        df, tests = self.pattern(None, [S.Path(None, [first], [])], kinds, None, True)
        for t in tests:
            df = df.filter(t)
        df = self.where(df, clause.where, kinds)
        r = f"_r{next(self.anonymous)}"
        seeds = df.select(*[F.col(f"`{first.var}:{c}`").alias(c) for c in ("label", "id")]).filter(F.col("id").isNotNull()).distinct()
        df = self.reached(r, path.rels[0], seeds).select(*[F.col(f"`{r}:{e}:{c}`").alias(f"{n.var}:{c}") for e, n in (("from", first), ("to", last)) for c in ("label", "id")])
        self.df = df.filter(F.col(f"`{last.var}:label`").isin(last.labels)) if last.labels else df
        self.kinds = {first.var: "node", last.var: "node"}
        if len(first.labels) == len(last.labels) == 1:
            self.once = self.df, {first.var, last.var}

    def most_hops(self, rel: S.Rel) -> int | None:
        """How long a path can be by the labels of its ends; None where these form a cycle."""
        ends = {(a, b) for kind in rel.types or self.graph.rels for a, b, _ in self.graph.rels.get(kind, [])}
        if rel.direction == "both":
            return None if ends else 0
        n = 0
        while ends:  # edges into labels that no edge leaves
            starts = {a for a, _ in ends}
            rest = {e for e in ends if e[1] in starts}
            if rest == ends:
                return None
            ends, n = rest, n + 1
        return n

    def hops_of(self, var: str, rel: S.Rel, seeds: DataFrame, keep_nodes: bool = False) -> DataFrame:
        """Paths of the asked lengths from the seeds (label, id) as one edge each; no edge twice in a path.

        keep_nodes: with the nodes after the first, for a path that has a name.

        Without an upper bound, paths grow until none can. Labels may say after how many hops that is; else, and where it
        is late, each round is checkpointed and the first that adds nothing is the last.
        """
        low, high = rel.hops
        bounds = [x for x in (self.session.max_hops if high is None else high, self.most_hops(rel)) if x is not None]
        most = min(bounds) if bounds else None
        ends = ("from:label", "from:id", "to:label", "to:id")
        step = self.edges_of("s", S.Rel(None, rel.types, rel.direction), set())
        step = step.select(*[F.col(f"`s:{c}`").alias(f"s:{c}") for c in ends], F.col("`s:eid`").alias("s:eid"))
        start = [F.col(c).alias(f"{var}:{e}:{c}") for e in ("from", "to") for c in ("label", "id")]
        path = seeds.select(*start, F.array().cast("array<string>").alias(f"{var}:eids"), *([F.array().cast(T.ArrayType(Y.ELEMENT)).alias(f"{var}:nodes")] if keep_nodes else []))
        reached = F.struct(F.col("`s:to:label`").alias("label"), F.col("`s:to:id`").cast("long").alias("id"))
        found, k = [path] if low == 0 else [], 0
        on = (F.col(f"`{var}:to:id`") == F.col("`s:from:id`")) & (F.col(f"`{var}:to:label`") == F.col("`s:from:label`"))
        while most is None or k < most:
            k += 1
            path = path.join(step, on).filter(~F.array_contains(f"`{var}:eids`", F.col("`s:eid`")))
            path = path.select(
                *[F.col(f"`{var}:from:{c}`") for c in ("label", "id")], *[F.col(f"`s:to:{c}`").alias(f"{var}:to:{c}") for c in ("label", "id")], F.concat(f"`{var}:eids`", F.array("`s:eid`")).alias(f"{var}:eids"),
                *([F.concat(f"`{var}:nodes`", F.array(reached)).alias(f"{var}:nodes")] if keep_nodes else []),
            )
            if most is None or most > LAZY_HOPS:
                path = checkpointed(path)
                if path.isEmpty():
                    break
            if k >= low:
                found.append(path)
        return _union(found) if found else path.limit(0)

    @staticmethod
    def open_start(paths: list[S.Path], where: tuple | None, kinds: dict[str, str]) -> str | None:
        """The one variable from outside, where a pattern starts at it and asks for nothing but its id and label.

        Such a pattern is matched by itself, from its first relationship on, and joined by that id; the outer rows need not
        be read for it.
        """
        path = paths[0]
        first = path.nodes[0].var
        if len(paths) > 1 or not path.rels or path.rels[0].hops or kinds.get(first) != "node" or not simple(where):
            return None
        said = mentioned([S.Match(paths, where, False)])
        others = [x.var for x in (*path.nodes[1:], *path.rels)] + [v for v in said if v != first]
        return None if said.get(first, set()) - {"id"} or any(v in kinds for v in others) else first

    def anchored(self, paths: list[S.Path], where: tuple | None, kinds: dict[str, str]) -> list[S.Path]:
        """The paths, each from its best place: a node that is there already, else the one that fewest rows are expected of.

        A path that starts in its middle becomes two. Paths that a name holds stay as they are.
        """
        out, known = [], set(kinds)
        for path in paths:
            at = 0
            if path.rels and path.var not in self.named:
                held = [k for k, n in enumerate(path.nodes) if n.var in known]
                tested = self.tested(where)
                if held:
                    at = held[0]
                elif any(n.props or tested.get(n.var) for n in path.nodes):
                    at = min(range(len(path.nodes)), key=lambda k: self.expected(path.nodes[k], tested))
            if 0 < at < len(path.nodes) - 1 and path.nodes[at].var is None:
                hidden = replace(path.nodes[at], var=f"_a{next(self.anonymous)}")
                path = replace(path, nodes=[*path.nodes[:at], hidden, *path.nodes[at + 1 :]])
            if at < len(path.nodes) - 1 or not at:
                out.append(S.Path(path.var, path.nodes[at:], path.rels[at:]))
            if at:
                first = path.nodes[at] if at == len(path.nodes) - 1 else S.Node(path.nodes[at].var)
                out.append(turned(S.Path(path.var, [*path.nodes[:at], first], path.rels[:at])))
            known |= {n.var for n in path.nodes if n.var}
        return out

    @staticmethod
    def tested(where: tuple | None) -> dict[str, list[tuple[str, str]]]:
        """For each variable the properties that a condition holds against a constant, with the comparison."""
        out: dict[str, list[tuple[str, str]]] = {}
        for e in conjuncts(where):
            if e[0] == "bin" and e[1] in ("=", "IN", "<", "<=", ">", ">=", "STARTS"):
                for a, b in ((e[2], e[3]), (e[3], e[2])):
                    if a[0] == "prop" and a[1][0] == "var" and not mentioned([S.Match([], b, False)]):
                        out.setdefault(a[1][1], []).append((e[1], a[2]))
        return out

    def expected(self, node: S.Node, tested: dict[str, list[tuple[str, str]]]) -> float:
        """Rows that a node is expected to leave: an id one, an equality a hundredth, a range a third."""
        rows = float(self.session.rows_of(node.labels))
        for op, key in [*(("=", key) for key, _ in node.props), *tested.get(node.var, [])]:
            rows = min(rows, 1.0) if (op, key) == ("=", "id") else rows / (100 if op in ("=", "IN") else 3)
        return rows

    def pattern(self, df: DataFrame | None, paths: list[S.Path], kinds: dict[str, str], where: tuple | None = None, as_set: bool = False) -> tuple[DataFrame, list[Column]]:
        """Extend df by the paths. kinds gets the new variables; inline conditions on old ones are returned.

        as_set: the caller needs each row once only.

        Without df, a first node in kinds is taken from its relationship (see open_start). What `where` says of the variables before a variable-length relationship is applied before that grows paths; the
        caller applies all of it in the end.
        """
        used: list[tuple[str, bool]] = []  # relationships of this clause, for uniqueness
        tests: list[Column] = []
        for path in paths:
            names = [n.var or f"_n{next(self.anonymous)}" for n in path.nodes]
            rels: list[tuple[str, bool]] = []
            for k, node in enumerate(path.nodes):
                need = self.named.get(node.var, set()) | {key for key, _ in node.props}
                rel = path.rels[k - 1] if k else None
                var = names[k]
                if rel is None:
                    if var not in kinds:
                        scan = self.nodes_of(var, node.labels, need)
                        df = scan if df is None else df.crossJoin(scan)
                else:
                    r = rel.var or f"_r{next(self.anonymous)}"
                    if rel.hops:
                        for t in tests:
                            df = df.filter(t)
                        tests.clear()
                        for e in conjuncts(where):
                            if simple(e) and set(mentioned([S.Match([], e, False)])) <= set(kinds):
                                df = df.filter(self.value(e, kinds, df))
                        seeds = df.select(*[F.col(f"`{names[k - 1]}:{c}`").alias(c) for c in ("label", "id")]).distinct()
                    alone = as_set and rel.hops and not rel.var and path.var not in self.named and sum(len(p.rels) for p in paths) == 1 and rel.hops[0] <= (rel.direction != "both")
                    edges = self.reached(r, rel, seeds) if alone else self.hops_of(r, rel, seeds, path.var in self.named) if rel.hops else self.edges_of(r, rel, self.named.get(rel.var, set()) | {key for key, _ in rel.props})
                    before = names[k - 1]
                    on = [(f"{before}:id", f"{r}:from:id"), (f"{before}:label", f"{r}:from:label")]
                    if var in kinds:
                        on += [(f"{var}:id", f"{r}:to:id"), (f"{var}:label", f"{r}:to:label")]
                    if df is None:
                        df = edges.withColumns({a: F.col(f"`{b}`") for a, b in on})
                    else:
                        df = df.join(edges, reduce(lambda a, b: a & b, [F.col(f"`{a}`") == F.col(f"`{b}`") for a, b in on]))
                    if var not in kinds:
                        wanted = need - {"id"}
                        to_label, to_id = F.col(f"`{r}:to:label`"), F.col(f"`{r}:to:id`")
                        if wanted:
                            scan = self.nodes_of(var, node.labels, need)
                            df = df.join(scan, (F.col(f"`{var}:id`") == to_id) & (F.col(f"`{var}:label`") == to_label))
                        else:  # the edge tells all that is asked of its end
                            df = df.withColumns({f"{var}:label": to_label, f"{var}:id": to_id})
                            if node.labels:
                                df = df.filter(to_label.isin(node.labels))
                    for other, many in used:
                        df = df.filter(self.apart(other, many, r, bool(rel.hops)))
                    used.append((r, bool(rel.hops)))
                    rels.append((r, bool(rel.hops)))
                    kinds[r] = "hops" if rel.hops else "rel"
                    for key, value in rel.props:
                        df = df.filter(self.column(r, key) == self.value(value, kinds, df))
                if var in kinds and node.labels:
                    tests.append(F.col(f"`{var}:label`").isin(node.labels))
                kinds[var] = "node"
                for group in node.also:
                    tests.append(F.col(f"`{var}:label`").isin(group))
                for key, value in node.props:
                    tests.append(self.property(df, var, key) == self.value(value, kinds, df))
            if path.var in self.named:
                df = df.withColumns(self.path_columns(path.var, names, rels))
                kinds[path.var] = "path"
        return df, tests

    @staticmethod
    def path_columns(var: str, nodes: list[str], rels: list[tuple[str, bool]]) -> dict[str, Column]:
        """A path as its number of hops, its relationships' keys and its nodes, for the names of its parts."""
        eids = [F.col(f"`{r}:eids`") if many else F.array(f"`{r}:eid`") for r, many in rels]
        node = lambda label, key: F.struct(F.col(f"`{label}`").alias("label"), F.col(f"`{key}`").cast("long").alias("id"))
        inner = [F.col(f"`{r}:nodes`") if many else F.array(node(f"{n}:label", f"{n}:id")) for (r, many), n in zip(rels, nodes[1:], strict=True)]
        whole = F.concat(F.array(node(f"{nodes[0]}:label", f"{nodes[0]}:id")), *inner)
        keys = F.concat(*eids) if eids else F.array().cast("array<string>")
        return {f"{var}:hops": F.size(keys).cast("long"), f"{var}:eids": keys, f"{var}:nodes": whole}

    @staticmethod
    def apart(a: str, a_many: bool, b: str, b_many: bool) -> Column:
        """No edge in both of two relationships."""
        left, right = (F.col(f"`{v}:eids`") if many else F.array(f"`{v}:eid`") for v, many in ((a, a_many), (b, b_many)))
        return ~F.arrays_overlap(left, right)

    def match(self, clause: S.Match) -> None:
        clause = S.Match(self.anchored(clause.paths, clause.where, self.kinds), clause.where, clause.optional)
        if self.ends_suffice(clause):
            self.match_ends(clause)
            return
        if not clause.optional:
            df, tests = self.pattern(self.df, clause.paths, self.kinds, clause.where, self.as_set)
            for t in tests:
                df = df.filter(t)
            self.df = self.where(df, clause.where, self.kinds)
            return
        base, old = self.frame(), dict(self.kinds)
        inner = dict(self.kinds)
        shared = [v for v in {n.var for p in clause.paths for n in p.nodes} if v in old]
        outer_used = [v for v in old if v not in shared and clause.where and v in mentioned([S.Match([], clause.where, False)])]
        seeds = base.columns if outer_used or any(old[v] != "node" for v in shared) else [f"{v}:{c}" for v in shared for c in self.held(base, v)]
        # matches are found for distinct keys and joined back, so rows of the base keep their number
        keys = base.select(*[F.col(f"`{c}`") for c in seeds]).distinct() if seeds else None
        if start := self.open_start(clause.paths, clause.where, old):
            seeds, keys = [f"{start}:label", f"{start}:id"], None
        df, tests = self.pattern(keys, clause.paths, inner, clause.where, self.as_set)
        for t in tests:
            df = df.filter(t)
        df = self.where(df, clause.where, inner)
        if not seeds:
            self.df = base.join(df, how="left", on=F.lit(True)) if self.df is not None else self.one.join(df, F.lit(True), "left")
        else:
            fresh = [c for c in df.columns if c not in base.columns]
            right = df.select(*[F.col(f"`{c}`").alias(f"key {c}") for c in seeds], *[F.col(f"`{c}`") for c in fresh])
            on = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"`key {c}`")) for c in seeds])
            self.df = base.join(right, on, "left").drop(*[f"key {c}" for c in seeds])
        self.kinds = inner

    @staticmethod
    def held(df: DataFrame, var: str) -> list[str]:
        return [c[len(var) + 1 :] for c in df.columns if c.startswith(f"{var}:")]

    def where(self, df: DataFrame, e: tuple | None, kinds: dict[str, str]) -> DataFrame:
        """Filter; EXISTS as a condition of its own becomes a semi or an anti join, inside of others a flag."""
        if e is None:
            return df
        if e[0] == "bin" and e[1] == "AND":
            return self.where(self.where(df, e[2], kinds), e[3], kinds)
        if e[0] == "exists":
            return self.exists(df, e, kinds, "left_semi")
        if e[0] == "not" and e[1][0] == "exists":
            return self.exists(df, e[1], kinds, "left_anti")
        held = df.columns
        flags: dict[int, str] = {}
        for inner in self.nested_exists(e):
            flags[id(inner)] = flag = f"_flag{next(self.anonymous)}"
            df = self.exists(df, inner, kinds, flag)
        self.typer(kinds, df).truth(e)
        return df.filter(self.value(e, kinds, df, flags)).select(*[F.col(f"`{c}`") for c in held])

    def nested_exists(self, e: tuple) -> list[tuple]:
        return [e] if e[0] == "exists" else [x for c in S.children(e) for x in self.nested_exists(c)]

    def exists(self, df: DataFrame, e: tuple, kinds: dict[str, str], how: str) -> DataFrame:
        """how: a kind of join, or the name of a flag column to add."""
        e = (*e[:1], self.anchored(e[1], e[2], kinds), *e[2:])
        inside = mentioned([S.Match(e[1], e[2], False)])
        shared = sorted({v for v in (*(n.var for p in e[1] for n in p.nodes), *inside) if v in kinds})
        seeds = [c for v in shared for c in ([v] if kinds[v] == "value" else [f"{v}:label", f"{v}:id", *(f"{v}:{p}" for p in self.held(df, v) if p in inside.get(v, ()))])]
        seeds = list(dict.fromkeys(c for c in seeds if c in df.columns))
        inner_kinds = {v: kinds[v] for v in shared}
        keys = df.select(*[F.col(f"`{c}`") for c in seeds]).distinct() if seeds else None
        if start := self.open_start(e[1], e[2], kinds):
            seeds, keys = [f"{start}:label", f"{start}:id"], None
        found, tests = self.pattern(keys, e[1], inner_kinds, e[2], as_set=True)
        for t in tests:
            found = found.filter(t)
        found = self.where(found, e[2], inner_kinds)
        found = found.select(*[F.col(f"`{c}`").alias(f"key {c}") for c in seeds])
        on = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"`key {c}`")) for c in seeds], F.lit(True))
        if how.startswith("left_"):
            return df.join(found, on, how)
        flagged = found.distinct().withColumn(how, F.lit(True))
        return df.join(flagged, on, "left").withColumn(how, F.coalesce(how, F.lit(False))).drop(*[f"key {c}" for c in seeds])

    # --- expressions
    def typer(self, kinds: dict[str, str], df: DataFrame | None) -> Y.Typer:
        fields = {f.name: f.dataType for f in df.schema.fields} if df is not None else {}

        def leaf(var: str, key: str | None) -> T.DataType | None:
            kind = kinds.get(var, "value")
            if key is not None:
                return None if kind == "value" else fields.get(f"{var}:{key}", Y.NULL)
            return fields.get(var) if kind == "value" else T.ArrayType(Y.TEXT) if kind == "hops" else Y.ELEMENT

        return Y.Typer(leaf)

    def column(self, var: str, key: str) -> Column:
        return F.col(f"`{var}:{key}`")

    def property(self, df: DataFrame | None, var: str, key: str) -> Column:
        """A property no table has (schemaless) is null."""
        return self.column(var, key) if df is None or f"{var}:{key}" in df.columns else F.lit(None)

    def value(self, e: tuple, kinds: dict[str, str] | None = None, df: DataFrame | None = None, flags: dict | None = None) -> Column:
        kinds = self.kinds if kinds is None else kinds
        df = self.df if df is None else df
        go = lambda x: self.value(x, kinds, df, flags)
        what = e[0]
        if what == "lit":
            return F.lit(e[1])
        if what == "exists":
            return F.col(flags[id(e)])
        if what == "var":
            if kinds.get(e[1], "value") == "value":
                return F.col(f"`{e[1]}`")
            whole = [F.col(f"`{c}`").alias(c[len(e[1]) + 1 :]) for c in df.columns if c.startswith(f"{e[1]}:")]
            return F.when(self.identity(e[1], kinds).isNotNull(), F.struct(*whole))
        if what == "prop":
            if e[1][0] == "var" and kinds.get(e[1][1], "value") != "value":
                return self.property(df, e[1][1], e[2])
            kind = self.typer(kinds, df).of(e[1])
            if Y.family(kind) == "time":
                return {"year": F.year, "month": F.month, "day": F.dayofmonth}[e[2]](go(e[1])).cast("long")
            return go(e[1])[e[2]] if isinstance(kind, T.StructType) and e[2] in kind.names else F.lit(None)
        if what == "list":
            typer = self.typer(kinds, df)
            item = typer.of(e).elementType
            alike = all(typer.of(x) in (item, Y.NULL) for x in e[1])
            return F.array(*[go(x) if alike else go(x).cast(item) for x in e[1]])
        if what == "map":
            return F.struct(*[go(v).alias(k) for k, v in e[1]])
        if what in ("not", "neg"):
            self.typer(kinds, df).of(e)  # fails where it doesn't fit
            return ~go(e[1]).cast("boolean") if what == "not" else -go(e[1])
        if what == "null":
            x = self.identity(e[1][1], kinds) if e[1][0] == "var" and kinds.get(e[1][1], "value") != "value" else go(e[1])
            return x.isNull() if e[2] else x.isNotNull()
        if what == "has":
            return F.col(f"`{e[1]}:label`").isin(e[2])
        if what == "case":
            out = None
            for test, then in e[2]:
                hit = go(test) if e[1] is None else go(e[1]) == go(test)
                out = F.when(hit, go(then)) if out is None else out.when(hit, go(then))
            return out.otherwise(go(e[3]))
        if what == "index":
            k, owner = go(e[2]), go(e[1])
            return F.get(owner, F.when(k < 0, F.size(owner) + k).otherwise(k).cast("int"))
        if what == "slice":
            owner = go(e[1])
            low = go(e[2]) if e[2] else F.lit(0)
            high = go(e[3]) if e[3] else F.size(owner)
            return F.slice(owner, (low + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int"))
        if what == "each":
            item = self.typer(kinds, df).items(e[2])
            inner = lambda x: lambda c: self.value(Y.put(x, e[1], ("column", c, item)), kinds, df, flags)
            out = go(e[2])
            out = F.filter(out, inner(e[3])) if e[3] else out
            return F.transform(out, inner(e[4])) if e[4] else out
        if what == "call":
            return self.aggregate(e, kinds, df, flags) if e[1] in S.AGGREGATES else self.call(e, kinds, df, flags)
        if what == "column":
            return e[1]
        return self.binary(e, kinds, df, flags)

    def identity(self, var: str, kinds: dict[str, str]) -> Column:
        return F.col(f"`{var}:{ {'node': 'id', 'rel': 'eid', 'hops': 'eids', 'path': 'hops'}[kinds[var]] }`") if kinds.get(var) in ("node", "rel", "hops", "path") else F.col(f"`{var}`")

    def binary(self, e: tuple, kinds: dict[str, str], df: DataFrame | None, flags: dict | None) -> Column:
        """The operation that the operands' types ask for."""
        op, typer = e[1], self.typer(kinds, df)
        typer.of(e)  # fails where no operation fits
        left, right = typer.of(e[2]), typer.of(e[3])
        a, b = self.value(e[2], kinds, df, flags), self.value(e[3], kinds, df, flags)
        known = a.isNotNull() & b.isNotNull()
        if op == "IN":
            return self.contained(a, b, left, right, e)
        if op in ("=", "<>"):
            return (a == b if op == "=" else a != b) if Y.comparable(left, right) else F.when(known, F.lit(op == "<>"))
        if op in ("<", "<=", ">", ">="):
            return {"<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b}[op]() if Y.comparable(left, right) else F.lit(None).cast("boolean")
        if op in ("STARTS", "ENDS", "CONTAINS", "=~"):
            if not (Y.is_text(left) and Y.is_text(right)):
                return F.lit(None).cast("boolean")
            a, b = a.cast("string"), b.cast("string")
            return {"STARTS": lambda: a.startswith(b), "ENDS": lambda: a.endswith(b), "CONTAINS": lambda: a.contains(b), "=~": lambda: F.regexp_like(a, F.concat(F.lit("^(?:"), b, F.lit(")$")))}[op]()
        if op in ("AND", "OR", "XOR"):
            a, b = a.cast("boolean"), b.cast("boolean")
            return {"AND": lambda: a & b, "OR": lambda: a | b, "XOR": lambda: a != b}[op]()
        if op == "+" and (Y.is_list(left) or Y.is_list(right)):
            whole = typer.of(e)
            sides = [x if Y.is_list(t) else F.array(x) for x, t in ((a, left), (b, right))]
            return F.when(known, F.concat(*[x if Y.is_null(whole.elementType) else x.cast(whole) for x in sides]))
        if op == "+" and Y.TEXT in (left, right):
            return F.concat(a.cast("string"), b.cast("string"))
        if isinstance(left, T.DateType):
            return (F.date_add if op == "+" else F.date_sub)(a, b.cast("int"))
        if op in ("/", "%") and not all(Y.is_whole(t) or Y.is_null(t) for t in (left, right)):
            a, b = a.cast("double"), b.cast("double")
            if op == "/":  # as the binary floating-point standard has it
                by_zero = F.when((a == 0) | F.isnan(a), float("nan")).when(a > 0, float("inf")).otherwise(float("-inf"))
                return F.when(known, F.when(b == 0, by_zero).otherwise(a / b))
        made = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.call_function("div", a, b), "%": lambda: a % b, "^": lambda: F.pow(a, b)}
        return made[op]()

    @staticmethod
    def contained(a: Column, b: Column, left: T.DataType, right: T.DataType, e: tuple) -> Column:
        item = right.elementType if Y.is_list(right) else Y.NULL
        if Y.is_null(item):  # an empty list, one of nulls, or null
            return F.when(F.size(b) == 0, F.lit(False)) if Y.is_list(right) else F.lit(None).cast("boolean")
        if not Y.comparable(left, item):
            return F.when(a.isNotNull() & b.isNotNull(), F.lit(False))
        if e[3][0] == "list" and all(x[0] == "lit" and x[1] is not None for x in e[3][1]):
            return a.isin([x[1] for x in e[3][1]])
        wide = Y.common([left, item]) if Y.family(left) == Y.family(item) else item
        return F.array_contains(b.cast(T.ArrayType(wide)), a.cast(wide))

    def call(self, e: tuple, kinds, df, flags) -> Column:
        name, args = e[1], e[3]
        kind = self.typer(kinds, df)
        kind.of(e)  # fails where the arguments don't fit
        if name in ("nodes", "relationships", "length", "size") and args[0][0] == "var" and kinds.get(args[0][1]) == "path":
            return F.col(f"`{args[0][1]}:{ {'nodes': 'nodes', 'relationships': 'eids'}.get(name, 'hops') }`")
        if name in ("nodes", "relationships"):
            raise Y.mismatch(f"{name} needs a path")
        if name in ("id", "labels", "label", "type"):
            if args[0][0] != "var":
                raise Y.mismatch(f"{name} needs a node or relationship")
            var = args[0][1]
            if name == "id":
                return self.identity(var, kinds)
            label = F.col(f"`{var}:{'type' if name == 'type' else 'label'}`")
            return F.array(label) if name == "labels" else label
        c = [self.value(x, kinds, df, flags) for x in args]
        if name in ("date", "datetime") and not c:
            return F.current_date() if name == "date" else F.current_timestamp()
        text = lambda x: x.cast("string")
        made = {
            "date": lambda: F.to_date(c[0]), "datetime": lambda: F.to_timestamp_ntz(c[0]), "tolower": lambda: F.lower(c[0]), "lower": lambda: F.lower(c[0]), "toupper": lambda: F.upper(c[0]), "upper": lambda: F.upper(c[0]),
            "trim": lambda: F.trim(c[0]), "tostring": lambda: text(c[0]), "tointeger": lambda: c[0].try_cast("long"), "tofloat": lambda: c[0].try_cast("double"), "coalesce": lambda: F.coalesce(*c),
            "abs": lambda: F.abs(c[0]), "round": lambda: F.round(*c[:1], args[1][1] if len(c) > 1 else 0), "floor": lambda: F.floor(c[0]), "ceil": lambda: F.ceil(c[0]), "sqrt": lambda: F.sqrt(c[0]), "range": lambda: self.steps(*c),
            "substring": lambda: c[0].substr(c[1] + 1, c[2] if len(c) > 2 else F.length(c[0])), "replace": lambda: F.replace(*c), "split": lambda: F.split(c[0], F.concat(F.lit("\\Q"), c[1], F.lit("\\E"))),
            "head": lambda: F.get(c[0], F.lit(0)), "last": lambda: F.get(c[0], F.size(c[0]) - 1), "left": lambda: F.left(c[0], c[1]), "right": lambda: F.right(c[0], c[1]),
        }
        if name in ("size", "length"):
            if args[0][0] == "var" and kinds.get(args[0][1]) == "hops":
                return F.size(f"`{args[0][1]}:eids`")
            return F.array_size(c[0]) if Y.is_list(kind.of(args[0])) else F.length(c[0].cast("string"))
        return made[name]()

    @staticmethod
    def steps(low: Column, high: Column, step: Column | None = None) -> Column:
        """Whole numbers from low to high, none where the step leads away from it."""
        low, high, step = low.cast("long"), high.cast("long"), F.lit(1).cast("long") if step is None else step.cast("long")
        onward = ((step > 0) & (low <= high)) | ((step < 0) & (low >= high))
        return F.when(onward, F.sequence(low, high, F.when(onward, step).otherwise(1))).when(step.isNotNull() & low.isNotNull() & high.isNotNull(), F.array().cast("array<bigint>"))

    def aggregate(self, e: tuple, kinds, df, flags) -> Column:
        name = e[1]
        if name == "count_rows":
            return F.count(F.lit(1))
        arg = e[3][0]
        self.typer(kinds, df).of(e)  # fails where the argument doesn't fit
        whole = arg[0] == "var" and kinds.get(arg[1], "value") != "value"
        x = (F.when(self.identity(arg[1], kinds).isNotNull(), F.struct(*[F.col(f"`{arg[1]}:{c}`") for c in (("label", "id") if kinds[arg[1]] == "node" else ("eid",))])) if name == "count" else self.value(arg, kinds, df, flags)) if whole else self.value(arg, kinds, df, flags)
        if name == "count":
            return F.count_distinct(x) if e[2] else F.count(x)
        if name == "collect":
            return F.collect_set(x) if e[2] else F.collect_list(x)
        if name == "sum":
            return F.coalesce(F.sum_distinct(x) if e[2] else F.sum(x), F.lit(0))
        if name == "avg":
            return F.avg(x) if not e[2] else F.sum_distinct(x) / F.count_distinct(x)
        return {"min": F.min, "max": F.max}[name](x)

    # --- projections
    def project(self, p: S.Projection) -> DataFrame:
        df, kinds = self.frame(), self.kinds
        items = ([(("var", v), v) for v in kinds if not v.startswith("_")] if p.everything else []) + p.items
        kept = {name: e[1] for e, name in items if e[0] == "var" and kinds.get(e[1], "value") != "value" and not p.final}
        grouped = any(S.has_aggregate(e) for e, _ in items)

        def columns(e, name) -> list[Column]:
            """A node or relationship is handed on with its columns; at the end it is a struct."""
            if name in kept:
                return [F.col(f"`{c}`").alias(name + c[len(kept[name]) :]) for c in df.columns if c.startswith(f"{kept[name]}:")]
            return [self.value(e, kinds, df).alias(name)]

        order_extra: list[Column] = []
        if grouped:
            keys = [c for e, name in items if not S.has_aggregate(e) for c in columns(e, name)]
            made = {name: self.value(e, kinds, df).alias(name) for e, name in items if S.has_aggregate(e)}
            same = {repr(e): name for e, name in items}
            extra = {f"_order{k}": self.value(e, kinds, df).alias(f"_order{k}") for k, (e, _) in enumerate(p.order) if S.has_aggregate(e) and repr(e) not in same}
            df = df.groupBy(*keys).agg(*made.values(), *extra.values())
            names = [c for e, name in items for c in ([name] if name not in kept else [x for x in df.columns if x.startswith(f"{name}:")])]
        else:
            chosen = [c for e, name in items for c in columns(e, name)]
            names = [c for e, name in items for c in ([name] if name not in kept else [name + x[len(kept[name]) :] for x in df.columns if x.startswith(f"{kept[name]}:")])]
            same = {repr(e): name for e, name in items}
            outputs = {name for _, name in items}
            for k, (e, _) in enumerate(p.order):
                if repr(e) not in same and not (e[0] == "var" and e[1] in outputs) and not p.distinct:
                    order_extra.append(self.value(self.inline(e, items), kinds, df).alias(f"_order{k}"))
            df_before, df = df, df.select(*chosen, *order_extra)
            differ = df_before is self.once[0] and self.once[1] <= {e[1][1] for e, _ in items if e[0] == "prop" and e[1][0] == "var" and e[2] == "id"}
            df = df.distinct() if p.distinct and not differ else df
        new_kinds = {name: kinds[kept[name]] if name in kept else "value" for _, name in items}
        if p.order:
            keys = []
            for k, (e, up) in enumerate(p.order):
                if f"_order{k}" in df.columns:
                    c = F.col(f"_order{k}")
                elif repr(e) in same and same[repr(e)] in df.columns:
                    c = F.col(f"`{same[repr(e)]}`")
                else:
                    c = self.value(e, new_kinds, df)
                keys.append(c.asc_nulls_last() if up else c.desc_nulls_first())
            df = df.orderBy(*keys)
        if p.skip:
            df = df.offset(self.whole(p.skip))
        if p.limit:
            df = df.limit(self.whole(p.limit))
        if grouped and p.distinct:
            df = df.distinct()
        df = df.select(*[F.col(f"`{c}`") for c in names])
        self.kinds, self.df = new_kinds, df
        if p.where:
            self.df = self.where(df, p.where, new_kinds)
        return self.df

    def inline(self, e: tuple, items) -> tuple:
        """Aliases of the projection put in place inside a sort key."""
        named = {name: x for x, name in items}

        def put(y):
            if isinstance(y, tuple):
                return named[y[1]] if y[0] == "var" and y[1] in named and y[1] not in self.kinds else tuple(map(put, y))
            return [put(z) for z in y] if isinstance(y, list) else y

        return put(e)

    @staticmethod
    def whole(e: tuple) -> int:
        if e[0] != "lit" or not isinstance(e[1], int):
            raise S.BindProblem("SKIP and LIMIT need whole numbers")
        return e[1]

    # --- updates: each makes new DataFrames for the session's graph
    def create(self, clause: S.Create) -> None:
        """MERGE finds or makes each node by its label and properties, then each relationship by its ends, type and properties."""
        if clause.on:
            self.df = self.frame().withColumn("_made", F.lit(False))
        for path in clause.paths:
            ends = [self.made_node(n, clause) for n in path.nodes]
            for r, a, b in zip(path.rels, ends, ends[1:], strict=False):
                self.made_edge(r, *((b, a) if r.direction == "in" else (a, b)), clause)
        for when, items in clause.on:
            self.change(S.Change("set", items), F.col("_made") == F.lit(when == "create"))
        if clause.on:
            self.df = self.df.drop("_made")

    def given(self, item: S.Node | S.Rel) -> dict[str, str]:
        """Adds a column for each inline property's value; the columns by property."""
        rows, names = self.frame(), {key: f"_given{next(self.anonymous)}" for key, _ in item.props}
        self.df = rows.withColumns({names[key]: self.value(v, self.kinds, rows) for key, v in item.props})
        return names

    def made_node(self, n: S.Node, clause: S.Create) -> str:
        var = n.var or f"_n{next(self.anonymous)}"
        if var in self.kinds:
            return var
        label = n.labels[0] if n.labels else "Any"
        known, given = self.graph.nodes.get(label), self.given(n)
        need = self.named.get(var, set()) | set(given)
        wanted = self.df
        if clause.merge:
            wanted = wanted.select(F.lit(1).alias("_one"), *given.values()).distinct()
            if known is not None and set(given) <= set(known.columns):
                same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(key)) for key, c in given.items()], F.lit(True))
                wanted = wanted.join(known.select(*given), same, "left_anti") if given else wanted.filter(F.lit(known.isEmpty()))
        new_id = f"_id{next(self.anonymous)}"
        if "id" in given:
            made = wanted.withColumn(new_id, F.col(given["id"]))
        else:  # rows are checkpointed with their ids, which are not the same when made again
            least = (known.agg(F.max("id")).first()[0] or 0) + 1 if known is not None else 1
            made = checkpointed(wanted.withColumn(new_id, F.lit(least) + F.monotonically_increasing_id()))
        new = made.select(F.col(new_id).alias("id"), *[F.col(c).alias(key) for key, c in given.items() if key != "id"])
        self.graph.nodes[label] = new if known is None else known.unionByName(new, allowMissingColumns=True)
        if clause.merge:
            nodes = self.nodes_of(var, [label], need)
            same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"`{var}:{key}`")) for key, c in given.items()], F.lit(True))
            rows = self.df.join(nodes, same)
            if clause.on:
                fresh = new.select(F.col("id").alias(new_id)).distinct().withColumn("_fresh", F.lit(True))
                rows = rows.join(fresh, F.col(f"`{var}:id`") == F.col(new_id), "left").withColumn("_made", F.col("_made") | F.coalesce("_fresh", F.lit(False))).drop(new_id, "_fresh")
        else:
            rows = made.withColumns({f"{var}:label": F.lit(label), f"{var}:id": F.col(new_id), **{f"{var}:{key}": F.col(c) for key, c in given.items() if key != "id"}})
        self.df, self.kinds[var] = rows.drop(new_id, *given.values()), "node"
        return var

    def made_edge(self, r: S.Rel, a: str, b: str, clause: S.Create) -> None:
        var, kind = r.var or f"_r{next(self.anonymous)}", r.types[0]
        given = self.given(r)
        ends = [f"{x}:{c}" for x in (a, b) for c in ("label", "id")]
        need = self.named.get(var, set()) | set(given)
        way = S.Rel(None, [kind], "both" if r.direction == "both" else "out")

        def joined(edges: DataFrame) -> Column:
            tests = [F.col(f"`{x}`") == F.col(f"`{var}:{y}`") for x, y in zip(ends, ("from:label", "from:id", "to:label", "to:id"), strict=True)]
            return reduce(lambda p, q: p & q, [*tests, *[F.col(c).eqNullSafe(F.col(f"`{var}:{key}`")) if f"{var}:{key}" in edges.columns else F.lit(False) for key, c in given.items()]])

        wanted = self.df
        if clause.merge:
            there = self.edges_of(var, way, need)
            wanted = wanted.select(*[F.col(f"`{c}`") for c in ends], *given.values()).distinct().join(there, joined(there), "left_anti")
        new_id = f"_id{next(self.anonymous)}"
        made = checkpointed(wanted.withColumn(new_id, F.concat(F.lit(f"{uuid.uuid4().hex}:"), F.monotonically_increasing_id().cast("string"))))
        for start, end in made.select(F.col(f"`{a}:label`"), F.col(f"`{b}:label`")).distinct().collect():  # pairs of labels
            part = made.filter((F.col(f"`{a}:label`") == start) & (F.col(f"`{b}:label`") == end))
            self.add_edges(kind, start, end, part.select(F.col(f"`{a}:id`").alias("src"), F.col(f"`{b}:id`").alias("dst"), F.col(new_id).alias("eid"), *[F.col(c).alias(key) for key, c in given.items()]))
        if clause.merge:
            edges = self.edges_of(var, way, need)
            rows = self.df.join(edges, joined(edges))
            if clause.on:
                fresh = made.select(F.concat(F.lit(kind + ":"), new_id).alias(new_id), F.lit(True).alias("_fresh"))
                rows = rows.join(fresh, F.col(f"`{var}:eid`") == F.col(new_id), "left").withColumn("_made", F.col("_made") | F.coalesce("_fresh", F.lit(False))).drop(new_id, "_fresh")
        else:
            froms = {f"{var}:{y}": F.col(f"`{x}`") for x, y in zip(ends, ("from:label", "from:id", "to:label", "to:id"), strict=True)}
            rows = made.withColumns({f"{var}:type": F.lit(kind), **froms, f"{var}:eid": F.concat(F.lit(kind + ":"), F.col(new_id)), **{f"{var}:{key}": F.col(c) for key, c in given.items()}})
        self.df, self.kinds[var] = rows.drop(new_id, *given.values()), "rel"

    def add_edges(self, kind: str, start: str, end: str, new: DataFrame) -> None:
        held = self.graph.rels.setdefault(kind, [])
        for k, (a, b, d) in enumerate(held):
            if (a, b) == (start, end):
                d = d.withColumn("eid", F.col("eid").cast("string")) if "eid" in d.columns else d
                held[k] = (a, b, d.unionByName(new, allowMissingColumns=True))
                return
        held.append((start, end, new))

    def change(self, clause: S.Change, only: Column | None = None) -> None:
        """SET, REMOVE and DELETE, for the rows where `only` holds."""
        for item in clause.items:
            target = item[1] if item[0] == "assign" else item
            if target[0] not in ("prop", "var"):
                raise S.BindProblem("labels can't be changed on a typed graph")
            if target[0] == "var" and clause.kind in ("set", "remove"):
                raise S.BindProblem("properties are set one by one")
            var = target[1][1] if target[0] == "prop" else target[1]
            if self.kinds.get(var) not in ("node", "rel"):
                raise S.BindProblem(f"variable {var} is no node or relationship")
            rows = self.frame()
            some = rows if only is None else rows.filter(only)
            if clause.kind in ("delete", "detach"):
                (self.delete_edges if self.kinds[var] == "rel" else self.delete_nodes)(some, var, clause.kind == "detach")
                continue
            key, new = target[2], self.value(item[2], self.kinds, rows) if clause.kind == "set" else F.lit(None)
            own = "id" if self.kinds[var] == "node" else "eid"
            changed = some.groupBy(F.col(f"`{var}:{'label' if own == 'id' else 'type'}`").alias("__kind"), F.col(f"`{var}:{own}`").alias("__own")).agg(F.last(new).alias("__new"), F.lit(True).alias("__hit"))
            for kind in self.kinds_of(some, var):
                hit = changed.filter(F.col("__kind") == kind).drop("__kind")
                if own == "id":
                    self.graph.nodes[kind] = self.updated(self.graph.nodes[kind], F.col("id"), hit, key)
                else:
                    self.graph.rels[kind] = [(a, b, self.updated(d, self.edge_key(kind, a, b, d), hit, key)) for a, b, d in self.graph.rels[kind]]
            held = f"{var}:{key}"
            old = F.col(f"`{held}`") if held in rows.columns else F.lit(None)
            self.df = rows.withColumn(held, new if only is None else F.when(only, new).otherwise(old))

    def kinds_of(self, rows: DataFrame, var: str) -> list[str]:
        """The labels or types that a variable has; as many as the graph's tables at most."""
        return [r[0] for r in rows.select(F.col(f"`{var}:{'label' if self.kinds[var] == 'node' else 'type'}`")).distinct().collect() if r[0]]

    @staticmethod
    def updated(table: DataFrame, own: Column, changed: DataFrame, key: str) -> DataFrame:
        kept = F.col(key) if key in table.columns else F.lit(None)
        joined = table.withColumn("__id", own).join(changed, F.col("__id") == F.col("__own"), "left")
        return joined.withColumn(key, F.when(F.col("__hit"), F.col("__new")).otherwise(kept)).drop("__id", "__own", "__new", "__hit")

    def delete_nodes(self, rows: DataFrame, var: str, detach: bool) -> None:
        for label in self.kinds_of(rows, var):
            gone = rows.filter(F.col(f"`{var}:label`") == label).select(F.col(f"`{var}:id`").alias("id")).distinct()
            for kind, held in self.graph.rels.items():
                for k, (a, b, d) in enumerate(held):
                    for end in [e for e, x in (("src", a), ("dst", b)) if x == label]:
                        there = gone.withColumnRenamed("id", end)
                        if not detach and not d.join(there, end, "left_semi").isEmpty():
                            raise S.BindProblem(f"a node of {label} has relationships; DETACH DELETE deletes these too")
                        d = d.join(there, end, "left_anti")
                    self.graph.rels[kind][k] = (a, b, d)
            self.graph.nodes[label] = self.graph.nodes[label].join(gone, "id", "left_anti")

    def delete_edges(self, rows: DataFrame, var: str, detach: bool) -> None:
        gone = rows.select(F.col(f"`{var}:eid`").alias("__gone")).distinct()
        for kind in self.kinds_of(rows, var):
            self.graph.rels[kind] = [(a, b, d.join(gone, self.edge_key(kind, a, b, d) == F.col("__gone"), "left_anti")) for a, b, d in self.graph.rels[kind]]

    def foreach(self, clause: S.Foreach) -> None:
        before, kinds = self.df, dict(self.kinds)
        self.df = self.frame().withColumn(clause.var, F.explode(self.value(clause.value)))
        self.kinds[clause.var] = "value"
        for c in clause.clauses:
            self.create(c) if isinstance(c, S.Create) else self.change(c)
        self.df, self.kinds = before, kinds
