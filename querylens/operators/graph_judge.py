"""Execution grading on a graph that has rows.

Grades are those of the judge: 0.0 no query or one that can't be parsed, 0.3 fails otherwise, 0.7 runs, 1.0 runs and gives the
gold query's set of rows. Every distinct query text runs once, however many rows hold it. Queries run in batches, some at
once; the graph tables that several queries of a batch read are cached while it runs. Each query has a job group and a
deadline of its own, so it fails or is late by itself. Results stay on the executors: what comes back of a query is its
fingerprint, three numbers.

The distinct texts come to the driver in batches (they are compiled there), the outcomes go to the shared folder and are
joined to the rows by digest and text.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylens.operators.judge import PARSE, RAN, RUNTIME, SAME
from querylens.operators.rowsets import fingerprint
from querylens.plans import syntax as S
from querylens.plans.checkpoints import checkpoint_folder
from querylens.plans.frames import RUN_ERRORS, GraphSession, PropertyGraph, deadline

BATCH = 256
AT_ONCE = 8
OUTCOME = "text string, success boolean, error_kind string, n long, high decimal(20,0), low decimal(20,0)"
Outcome = tuple[str, bool, str | None, int | None, object, object]




def tables_read(query: S.Query, graph: PropertyGraph) -> set[str]:
    """Labels and types that a query's patterns name, or all where one names none."""
    out: set[str] = set()

    def paths(some: list[S.Path]) -> None:
        for p in some:
            for r in p.rels:
                out.update(r.types or graph.rels)
            for k, n in enumerate(p.nodes):
                # an end of a relationship is known by it, so it is read only if it has a label of its own
                out.update(n.labels or ([] if p.rels and k else graph.nodes))

    def expression(e) -> None:
        if isinstance(e, tuple) and e:
            if e[0] == "exists":
                paths(e[1])
                expression(e[2])
            else:
                for x in S.children(e):
                    expression(x)

    for clauses in query.parts:
        for c in clauses:
            if isinstance(c, S.Match):
                paths(c.paths)
                expression(c.where)
            elif isinstance(c, S.Projection):
                for e, _ in c.items:
                    expression(e)
                expression(c.where)
    return out


def writes(query: S.Query) -> bool:
    return any(isinstance(c, (S.Create, S.Change, S.Foreach)) for clauses in query.parts for c in clauses)


class GraphJudge:
    """Runs distinct queries over one graph. Updates run on a copy of the session, so no query sees another's."""

    def __init__(self, session: GraphSession, timeout_s: float | None = 60.0, batch: int = BATCH, at_once: int = AT_ONCE, cache: bool = True):
        self.session, self.timeout_s, self.batch, self.at_once, self.cache = session, timeout_s, batch, at_once, cache

    def compiled(self, graph: PropertyGraph, text: str) -> DataFrame:
        own = GraphSession(self.session.spark, PropertyGraph(dict(graph.nodes), {k: list(v) for k, v in graph.rels.items()}), self.session.mode, self.session.max_hops)
        return fingerprint(own.execute(text))

    @contextmanager
    def shared_tables(self, texts: list[str]):
        """The session's graph with the tables cached that at least two of the queries read."""
        graph, used = self.session.graph, Counter()
        for text in texts:
            try:
                used.update(tables_read(S.parse(text), graph))
            except S.QueryError:
                continue
        many = {name for name, n in used.items() if n > 1} if self.cache else set()
        nodes = {k: d.persist(StorageLevel.MEMORY_AND_DISK) if k in many else d for k, d in graph.nodes.items()}
        rels = {k: [(a, b, d.persist(StorageLevel.MEMORY_AND_DISK) if k in many else d) for a, b, d in v] for k, v in graph.rels.items()}
        try:
            yield PropertyGraph(nodes, rels)
        finally:
            for name in many:
                for d in [nodes[name]] if name in nodes else [d for _, _, d in rels.get(name, [])]:
                    d.unpersist()

    def outcomes(self, texts: list[str]) -> Iterator[Outcome]:
        """Of the queries of one batch, `at_once` of them at a time."""
        with self.shared_tables(texts) as graph, ThreadPoolExecutor(self.at_once) as pool:
            yield from pool.map(lambda text: self.outcome(graph, text), texts)

    def outcome(self, graph: PropertyGraph, text: str) -> Outcome:
        with deadline(self.session.spark, self.timeout_s) as late:
            try:
                found = self.compiled(graph, text).first()  # paths of open length run rounds while they are compiled
                return text, True, None, found.n, found.high, found.low
            except S.QueryError as problem:
                kind = problem.kind
            except RUN_ERRORS:
                kind = "runtime"
            return text, False, "timeout" if late.is_set() else kind, None, None, None

    def results(self, queries: DataFrame, text: str = "text") -> DataFrame:
        """The outcome of each distinct query, written to the shared folder a batch at a time."""
        spark = self.session.spark
        folder = f"{checkpoint_folder(spark)}/judged-{uuid.uuid4()}"
        spark.createDataFrame([], OUTCOME).write.parquet(folder)
        waiting: list[str] = []

        def flush() -> None:
            spark.createDataFrame(list(self.outcomes(waiting)), OUTCOME).coalesce(1).write.mode("append").parquet(folder)
            waiting.clear()

        for (one,) in queries.select(F.col(text)).filter(F.col(text).isNotNull()).distinct().toLocalIterator():
            waiting.append(one)
            if len(waiting) == self.batch:
                flush()
        if waiting:
            flush()
        return spark.read.parquet(folder)

    def grade(self, rows: DataFrame, pred: str = "pred", gold: str = "cypher", out: str = "grade") -> DataFrame:
        """The rows with a grade for each; `pred` is an extracted query, `gold` is taken as it is. Null or empty preds get 0.0."""
        wanted = rows.select(F.nullif(F.col(pred), F.lit("")).alias("text")).union(rows.filter(F.coalesce(F.col(pred), F.lit("")) != "").select(gold))
        results = self.results(wanted)

        def joined(df: DataFrame, by: str, name: str) -> DataFrame:
            side = results.select(F.xxhash64("text").alias(f"{name}_key"), F.struct("text", "success", "error_kind", "n", "high", "low").alias(name))
            keyed = df.withColumn(f"{name}_own", F.xxhash64(F.col(by)))
            return keyed.join(side, (F.col(f"{name}_own") == F.col(f"{name}_key")) & (F.col(by) == F.col(f"{name}.text")), "left").drop(f"{name}_key", f"{name}_own")

        both = joined(joined(rows, pred, "__pred"), gold, "__gold")
        p, g = F.col("__pred"), F.col("__gold")
        same = g["success"] & (p["n"] == g["n"]) & (p["high"] == g["high"]) & (p["low"] == g["low"])
        grade = (
            F.when(F.coalesce(F.col(pred), F.lit("")) == "", PARSE)
            .when(p["success"], F.when(same, SAME).otherwise(RAN))
            .otherwise(F.when(p["error_kind"] == "parse", PARSE).otherwise(RUNTIME))
        )
        return both.withColumn(out, grade).drop("__pred", "__gold")
