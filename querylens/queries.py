"""Registered queries for the library's own operators, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import functools
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querylens.functions import text as X
from querylens.operators import evaluate as ev
from querylens.operators import graph_judge as gj
from querylens.operators import judge, pattern
from querylens.operators import rowsets as rs
from querylens.operators import schema as sc
from querylens.operators import schema_native as sn
from querylens.plans.checkpoints import checkpoint_folder
from querylens.plans.frames import GraphSession, PropertyGraph
from querylens import streaming as stream
from querylens.sources import adapters as ad

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


# --- text functions in SQL
def q_strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


_FENCE = "'(?is)```(?:cypher)?\\s*(.+?)```'"
_KEYWORD = "'(?is)\\b(?:MATCH|OPTIONAL\\s+MATCH|CREATE|MERGE|CALL|RETURN|WITH)\\b.*'"


def q_fenced(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, {_FENCE}) THEN {q_strip(f'regexp_extract({x}, {_FENCE}, 1)')} END"


def q_keyword(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, {_KEYWORD}) THEN {q_strip(f'regexp_extract({x}, {_KEYWORD}, 0)')} END"


def q_extract(x: str) -> str:
    return f"coalesce({q_fenced(x)}, {q_keyword(x)}, {q_strip(x)}, '')"


def q_normal(x: str) -> str:
    bare = q_strip(f"regexp_replace({q_strip(x)}, ';+$', '')")
    return f"lower(regexp_replace({bare}, '\\s+', ' ', 'g'))"


def q_penalty(n: str) -> str:
    return f"CASE WHEN coalesce({n}, 0) <= 256 THEN 0.0::DOUBLE ELSE -0.5::DOUBLE * least(({n} - 256) / 256.0::DOUBLE, 1.0::DOUBLE) END"


def q_bleu(source: str, gold: str, pred: str, keep: str) -> str:
    """CTEs that end in `bleu`: the kept columns and bleu, over a CTE `source`."""
    split = lambda x: f"CASE WHEN {q_strip(x)} = '' THEN []::VARCHAR[] ELSE regexp_split_to_array({q_strip(x)}, '\\s+') END"
    grams = lambda t, n: f"list_transform(range(1, greatest(len({t}) - {n} + 2, 1)), lambda i: array_to_string({t}[i:i + {n - 1}], chr(1)))"
    hits = ", ".join(f"coalesce(list_sum(list_transform(list_distinct(h{n}), lambda g: least(len(list_filter(h{n}, lambda x: x = g)), len(list_filter(r{n}, lambda x: x = g)))))::DOUBLE, 0) AS m{n}" for n in range(1, 5))
    logs = " + ".join(f"ln(CASE WHEN m{n} = 0 THEN 0.1::DOUBLE ELSE m{n} END / greatest(1, len(hyp) - {n - 1}))" for n in range(1, 5))
    return f"""bleu_words AS (SELECT *, {split(gold)} AS ref, {split(pred)} AS hyp FROM {source}),
bleu_grams AS (SELECT *, {", ".join(f"{grams('hyp', n)} AS h{n}, {grams('ref', n)} AS r{n}" for n in range(1, 5))} FROM bleu_words),
bleu_hits AS (SELECT *, {hits} FROM bleu_grams),
bleu AS (SELECT {keep}, CASE WHEN len(hyp) = 0 OR m1 = 0 THEN 0.0::DOUBLE ELSE
  (CASE WHEN len(hyp) > len(ref) THEN 1.0::DOUBLE ELSE exp(1 - len(ref) / len(hyp)::DOUBLE) END) * exp(({logs}) / 4) END AS bleu FROM bleu_hits)"""


_T2C = f"WITH {ad.T2C_SQL}"
_PRED = q_extract("completion")
# what grading must give for the completions of the adapter, by their kind and schema
_NO_SCHEMA = f"(row_id // {ad.KINDS}) % {len(ad.SCHEMAS)} = {len(ad.SCHEMAS) - 1}"
_GRADE = f"""CASE WHEN row_id % 8 >= 6 THEN 0.0 WHEN row_id % 8 = 3 THEN 0.7 WHEN {_NO_SCHEMA} OR row_id % 8 = 1 THEN 0.3 WHEN row_id % 8 = 5 THEN 0.7 ELSE 1.0 END::DOUBLE"""
_EXEC = f"(NOT {_NO_SCHEMA} AND row_id % 8 IN (0, 2, 4))::INT"
_ROWS = f"{_T2C}, predicted AS (SELECT *, {_PRED} AS pred, {_EXEC} AS exec FROM t2c), {q_bleu('predicted', 'cypher', 'pred', '*')}, scored AS (SELECT *, ({q_normal('pred')} = {q_normal('cypher')})::INT AS em FROM bleu)"


def _t2c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.t2c(spark, sf_dir)


def _pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t2c(spark, sf_dir).withColumn("pred", X.extract_query(F.col("completion")))


# --- projections, samples, predicates
@query(f"""{_T2C} SELECT row_id, {"'" + X.PROMPT.replace("'", "''").replace("{schema}", "' || schema || '").replace("{question}", "' || question || '") + "'"} AS prompt FROM t2c""")
def prompt_projection(spark, sf_dir):
    return _t2c(spark, sf_dir).select("row_id", X.prompt(F.col("schema"), F.col("question")).alias("prompt"))


@query(f"{_T2C} SELECT cypher, schema, question, data_source FROM t2c")
def column_pruning(spark, sf_dir):
    return _t2c(spark, sf_dir).select("cypher", "schema", "question", "data_source")


@query(f"{_T2C} SELECT row_id, schema FROM (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS k, count(*) OVER () AS n FROM t2c) WHERE k % greatest(1, n // 200) = 0")
def strided_sample(spark, sf_dir):
    return ad.strided_sample(_t2c(spark, sf_dir), "row_id").select("row_id", "schema")


@query(f"{_T2C} SELECT row_id, question, cypher AS gold, {_PRED} AS pred FROM t2c ORDER BY row_id LIMIT 5")
def first_k_samples(spark, sf_dir):
    return ev.first_rows(_t2c(spark, sf_dir), 5, "row_id").select("row_id", "question", F.col("cypher").alias("gold"), X.extract_query(F.col("completion")).alias("pred"))


@query("SELECT o_orderkey AS row_id FROM orders ORDER BY o_orderkey LIMIT 10001")
def row_cap(spark, sf_dir):
    return ev.first_rows(ad.read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id")), 10_001, "row_id")


# --- extraction
_ALL = f"{_T2C}, turns AS (SELECT conv_id AS a, turn AS b, text FROM conversations UNION ALL SELECT -1 - row_id, row_id % 8, completion FROM t2c)"


def _turns(spark, sf_dir):
    made = _t2c(spark, sf_dir).select((-1 - F.col("row_id")).alias("a"), (F.col("row_id") % 8).alias("b"), F.col("completion").alias("text"))
    return ad.read_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("a"), F.col("turn").alias("b"), "text").union(made)


@query(f"{_ALL} SELECT a, b, {q_fenced('text')} AS found FROM turns")
def extract_fenced(spark, sf_dir):
    return _turns(spark, sf_dir).select("a", "b", X.extract_fenced(F.col("text")).alias("found"))


@query(f"{_ALL} SELECT a, b, {q_keyword('text')} AS found FROM turns")
def extract_keyword(spark, sf_dir):
    return _turns(spark, sf_dir).select("a", "b", X.extract_keyword(F.col("text")).alias("found"))


@query(f"{_ALL} SELECT a, b, {q_extract('text')} AS found FROM turns")
def extract_full(spark, sf_dir):
    return _turns(spark, sf_dir).select("a", "b", X.extract_query(F.col("text")).alias("found"))


@query(f"{_ALL}, once AS (SELECT a, b, {q_extract('text')} AS found FROM turns) SELECT a, b, {q_extract('found')} AS found FROM once")
def extract_twice(spark, sf_dir):
    once = _turns(spark, sf_dir).select("a", "b", X.extract_query(F.col("text")).alias("once"))
    return once.select("a", "b", X.extract_query(F.col("once")).alias("found"))


# --- text metrics
@query(f"{_ALL} SELECT a, b, {q_normal('text')} AS normal FROM turns")
def em_normalized(spark, sf_dir):
    return _turns(spark, sf_dir).select("a", "b", X.normalize_query(F.col("text")).alias("normal"))


@query(f"{_T2C} SELECT data_source, count(*) AS n, round(avg(({q_normal(_PRED)} = {q_normal('cypher')})::INT), 9) AS em FROM t2c GROUP BY data_source")
def exact_match_rate(spark, sf_dir):
    d = _pred(spark, sf_dir).withColumn("em", X.exact_match(F.col("pred"), F.col("cypher")))
    return d.groupBy("data_source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("em"), 9).alias("em"))


@query(f"{_T2C}, p AS (SELECT *, {_PRED} AS pred FROM t2c), {q_bleu('p', 'cypher', 'pred', 'row_id')} SELECT row_id, round(bleu, 9) AS bleu FROM bleu")
def bleu4_rows(spark, sf_dir):
    return _pred(spark, sf_dir).select("row_id", F.round(X.bleu4(F.col("cypher"), F.col("pred")), 9).alias("bleu"))


@query(f"WITH p AS (SELECT a.conv_id, a.turn, a.text AS gold, b.text AS pred FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1), {q_bleu('p', 'gold', 'pred', 'conv_id, turn')} SELECT conv_id, turn, round(bleu, 9) AS bleu FROM bleu")
def bleu4_conversations(spark, sf_dir):
    c = ad.read_table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = c.select("conv_id", "turn", F.col("text").alias("gold"), F.lead("text").over(w).alias("pred"), F.lead("turn").over(w).alias("after")).filter("after = turn + 1")
    return pairs.select("conv_id", "turn", F.round(X.bleu4(F.col("gold"), F.col("pred")), 9).alias("bleu"))


@query(f"{_T2C}, p AS (SELECT *, {_PRED} AS pred FROM t2c), {q_bleu('p', 'cypher', 'pred', 'data_source')} SELECT data_source, round(avg(bleu), 9) AS bleu, count(*) AS n FROM bleu GROUP BY data_source")
def bleu4_by_source(spark, sf_dir):
    d = _pred(spark, sf_dir).withColumn("bleu", X.bleu4(F.col("cypher"), F.col("pred")))
    return d.groupBy("data_source").agg(F.round(F.avg("bleu"), 9).alias("bleu"), F.count(F.lit(1)).alias("n"))


@query(f"{_T2C} SELECT row_id, n_tokens, {q_penalty('n_tokens')} AS penalty FROM t2c")
def length_penalty(spark, sf_dir):
    return _t2c(spark, sf_dir).select("row_id", "n_tokens", X.length_penalty(F.col("n_tokens")).alias("penalty"))


@query()
def string_ratio(spark, sf_dir):
    return _pred(spark, sf_dir).select("row_id", F.round(pattern.ratio_column("pred", "cypher"), 9).alias("ratio"))


# --- evaluation
_MEANS = "round(coalesce(avg(bleu), 0), 9) AS bleu, round(coalesce(avg(em), 0), 9) AS em, round(coalesce(avg(exec), 0), 9) AS exec, count(*) AS n"


@query(f"{_ROWS} SELECT grouping(data_source)::INT AS is_total, data_source, {_MEANS} FROM scored GROUP BY ROLLUP (data_source)")
def eval_rollup(spark, sf_dir):
    d = ev.rollup(ev.row_metrics(_t2c(spark, sf_dir)))
    return d.select("is_total", "data_source", *[F.round(c, 9).alias(c) for c in ev.METRICS], "n")


@query(f"{_ROWS} SELECT is_total, source, n, {', '.join(f'round({c}, 6) AS {c}' for c in ('bleu', 'em', 'execution_accuracy'))} FROM (SELECT grouping(data_source)::INT AS is_total, CASE WHEN grouping(data_source) = 1 THEN NULL ELSE coalesce(data_source, 'null') END AS source, count(*) AS n, avg(bleu) AS bleu, avg(em) AS em, avg(exec) AS execution_accuracy FROM scored GROUP BY ROLLUP (data_source))")
def eval_report(spark, sf_dir):
    """The JSON report, written to the shared folder and read again."""
    path = f"{checkpoint_folder(spark)}/report-{uuid.uuid4()}"
    ev.evaluate(_t2c(spark, sf_dir), output_path=path)
    entry = "struct<bleu: double, em: double, execution_accuracy: double, n: long>"
    report = spark.read.text(path, wholetext=True).select(F.from_json("value", f"struct<overall: {entry}, per_source: map<string, {entry}>>").alias("r"))
    lines = report.select(F.lit(1).alias("is_total"), F.lit(None).cast("string").alias("source"), "r.overall").union(report.select(F.lit(0), F.explode("r.per_source")).toDF("is_total", "source", "overall"))
    return lines.select("is_total", "source", "overall.n", *[F.round(F.col(f"overall.{c}"), 6).alias(c) for c in ("bleu", "em", "execution_accuracy")])


@query(f"{_T2C}, p AS (SELECT *, {_PRED} AS pred FROM t2c) SELECT row_id, ({q_normal('pred')} = {q_normal('cypher')})::INT AS em, {q_penalty('n_tokens')} AS r_length FROM p")
def stream_scores(spark, sf_dir):
    """The scorers over a stream of files, until all that is there is read."""
    folder = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4()}"
    _t2c(spark, sf_dir).write.parquet(f"{folder}/in")
    rows = spark.read.parquet(f"{folder}/in")
    stream.write_scores(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("row_id", "em", "r_length")


@query(f"{_ROWS} SELECT grouping(data_source)::INT AS is_total, data_source, {_MEANS} FROM scored GROUP BY ROLLUP (data_source)")
def stream_rollup(spark, sf_dir):
    """The roll-up kept by a stream that is stopped when it has read some of its files, and started again when all are there."""
    folder = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4()}"
    rows = _t2c(spark, sf_dir).repartition(4, "row_id")
    part = F.pmod(F.xxhash64("row_id"), F.lit(3))
    for which in (part == 0, part > 0):  # the second start finds the rest
        rows.filter(which).write.mode("append").parquet(f"{folder}/in")
        files = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 3).parquet(f"{folder}/in")
        stream.write_rollup(files, f"{folder}/out", f"{folder}/state").awaitTermination()
    d = stream.read_rollup(spark, f"{folder}/out")
    return d.select("is_total", "data_source", *[F.round(c, 9).alias(c) for c in ev.METRICS], "n")


def _answering_model():
    """Stands for a language model: answers from the question alone, and fails on whole batches that hold a certain name."""
    asked = re.compile("What did (.*?) order")

    def model(prompts: list[str]) -> list[str]:
        names = [asked.search(p)[1] for p in prompts]
        if any(name.endswith("13") for name in names):
            raise RuntimeError("out of memory")
        return ["RETURN 1" if name.endswith("7") else f"```cypher\nMATCH (c:Customer {{name: '{name}'}})-[:PLACED]->(o:Orders) RETURN o.total AS total\n```" for name in names]

    return model


_ANSWERED = f"SELECT row_id, CASE WHEN n LIKE '%13' THEN '' WHEN n LIKE '%7' THEN 'RETURN 1' ELSE cypher END AS pred, (n NOT LIKE '%13' AND n NOT LIKE '%7')::INT AS em FROM (SELECT *, regexp_extract(question, 'What did (.*) order', 1) AS n FROM t2c)"


@query(f"{_T2C} {_ANSWERED}")
def batch_completions(spark, sf_dir):
    """Completions by a model that answers batches of prompts, loaded once a worker."""
    d = ev.with_completions(_t2c(spark, sf_dir), generate=ev.batch_generator(_answering_model, 32))
    d = d.withColumn("pred", X.extract_query(F.col("completion")))
    return d.select("row_id", "pred", X.exact_match(F.col("pred"), F.col("cypher")).alias("em"))


@query(f"{_ROWS} SELECT 0 AS is_total, NULL::VARCHAR AS data_source, {_MEANS} FROM scored WHERE data_source IS NULL")
def null_source_group(spark, sf_dir):
    return eval_rollup(spark, sf_dir).filter("is_total = 0 AND data_source IS NULL")


@query(f"{_T2C}, s AS (SELECT row_id, ({q_normal(_PRED)} = {q_normal('cypher')})::INT AS em FROM t2c) SELECT row_id, round(running, 9) AS running FROM (SELECT row_id, avg(em) OVER (ORDER BY row_id) AS running FROM s) WHERE (row_id + 1) % 50 = 0")
def eval_running_mean(spark, sf_dir):
    d = _pred(spark, sf_dir).withColumn("em", X.exact_match(F.col("pred"), F.col("cypher")))
    return ev.running_mean(d, "em", "row_id").select("row_id", F.round("running", 9).alias("running"))


@query(f"{_T2C} SELECT row_id, round(CASE WHEN s > 0 THEN (g - m) / s ELSE 0 END, 9) AS advantage FROM (SELECT row_id, g, avg(g) OVER w AS m, coalesce(stddev_samp(g) OVER w, 0) AS s FROM (SELECT row_id, row_id // 4 AS p, {_GRADE} AS g FROM t2c) WINDOW w AS (PARTITION BY p))")
def group_advantage(spark, sf_dir):
    """Extension: four rollouts a prompt."""
    d = judge.judge_column(_pred(spark, sf_dir), "pred", out="reward").withColumn("prompt_id", F.floor(F.col("row_id") / 4))
    return ev.group_advantage(d).select("row_id", F.round("advantage", 9).alias("advantage"))


# --- schema compiler
def _schemas(spark, sf_dir):
    return _t2c(spark, sf_dir).select("schema").distinct()


# a schema text of its own for each customer, in one of the three formats; labels, properties and their kinds differ
_VARIED = [("name", "STRING"), ("size", "INTEGER"), ("price", "FLOAT"), ("born", "DATE"), ("tags", "LIST")]


def _varied(spark, sf_dir):
    key = F.col("c_custkey")
    k = key.cast("string")
    props = F.slice(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(t).alias("t")) for n, t in _VARIED]), F.lit(1), (key % 6).cast("int"))
    joined = lambda f, by: F.array_join(F.transform(props, f), by)
    markdown = F.concat(F.lit("Node properties:\n- **L"), k, F.lit("**\n"), joined(lambda p: F.concat(F.lit("  - `"), p.n, F.lit("`: "), p.t, F.lit("\n")), ""), F.lit("Relationships:\n(:L"), k, F.lit(")-[:R"), k, F.lit("]->(:M"), k, F.lit(")"))
    inner = joined(lambda p: F.concat(F.lit('"'), p.n, F.lit('": {"type": "'), p.t, F.lit('"}')), ", ")
    json = F.concat(F.lit('{"L'), k, F.lit('": {"type": "node", "properties": {'), inner, F.lit('}}, "R'), k, F.lit('": {"type": "relationship", "from": ["L'), k, F.lit('"], "to": ["M'), k, F.lit('"]}}'))
    blocks = F.concat(F.lit("L"), k, F.lit(" {"), joined(lambda p: F.concat(p.n, F.lit(": "), p.t), ", "), F.lit("}\n{'start': L"), k, F.lit(", 'type': R"), k, F.lit(", 'end': M"), k, F.lit("}"))
    text = F.when(key % 3 == 0, markdown).when(key % 3 == 1, json).otherwise(blocks)
    return ad.read_table(spark, sf_dir, "customer").select("c_custkey", text.alias("schema"))


@query(f"SELECT c_custkey, 'CREATE NODE TABLE L' || c_custkey || '(id INT64, ' || array_to_string([{', '.join(ad._text(f'{n} {sc.TYPES.get(t, chr(83) + 'TRING')}, ') for n, t in _VARIED)}][1:c_custkey % 6], '') || 'PRIMARY KEY (id));' || chr(10) || 'CREATE NODE TABLE M' || c_custkey || '(id INT64, PRIMARY KEY (id));' || chr(10) || 'CREATE REL TABLE R' || c_custkey || '(FROM L' || c_custkey || ' TO M' || c_custkey || ');' AS ddl FROM customer")
def schema_compile_varied(spark, sf_dir):
    return sn.compile_column(_varied(spark, sf_dir)).select("c_custkey", "ddl")


@query(f"{_T2C}, r AS (SELECT DISTINCT schema, unnest(regexp_extract_all(schema, {ad._text(sc.ARROW)})) AS hit FROM t2c) SELECT schema, regexp_extract(hit, {ad._text(sc.ARROW)}, 2) AS type, regexp_extract(hit, {ad._text(sc.ARROW)}, 1) AS src, regexp_extract(hit, {ad._text(sc.ARROW)}, 3) AS dst FROM r")
def schema_rels_arrow(spark, sf_dir):
    return _schemas(spark, sf_dir).select("schema", F.explode(sc.arrow_relationships(F.col("schema"))).alias("r")).select("schema", "r.*")


@query("SELECT c_custkey, coalesce(nullif(regexp_replace(trim(' ' || c_name || ' '), '[^A-Za-z0-9_]', '_', 'g'), ''), 'Any') AS label FROM customer UNION ALL SELECT -1, 'Any'")
def label_clean(spark, sf_dir):
    c = ad.read_table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit(" "), "c_name", F.lit(" ")).alias("name"))
    c = c.union(spark.createDataFrame([(-1, "  ")], c.schema))
    return c.select("c_custkey", sc.clean_label_column(F.col("name")).alias("label"))


_KINDS_SQL = "CASE p_partkey % 6 WHEN 0 THEN 'integer' WHEN 1 THEN 'Float' WHEN 2 THEN 'DATETIME' WHEN 3 THEN 'LIST' WHEN 4 THEN 'POINT' ELSE 'bool' END"


def _kind():
    k = F.col("p_partkey") % 6
    return F.when(k == 0, "integer").when(k == 1, "Float").when(k == 2, "DATETIME").when(k == 3, "LIST").when(k == 4, "POINT").otherwise("bool")


_TYPE_SQL = "CASE upper(kind) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in sc.TYPES.items()) + " ELSE 'STRING' END"


@query(f"SELECT p_partkey, {_TYPE_SQL} AS type FROM (SELECT p_partkey, {_KINDS_SQL} AS kind FROM part)")
def type_map(spark, sf_dir):
    return ad.read_table(spark, sf_dir, "part").select("p_partkey", sc.backend_type(_kind()).alias("type"))


@query(f"SELECT p_brand, 'CREATE NODE TABLE ' || replace(p_brand, '#', '_') || '(id INT64, ' || string_agg('p' || p_partkey || ' ' || {_TYPE_SQL}, ', ' ORDER BY p_partkey) || ', PRIMARY KEY (id));' AS ddl FROM (SELECT *, {_KINDS_SQL} AS kind FROM part) GROUP BY p_brand")
def ddl_emit(spark, sf_dir):
    facts = ad.read_table(spark, sf_dir, "part").select("p_brand", F.struct(F.col("p_partkey").alias("k"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"), _kind().alias("type")).alias("p"))
    props = facts.groupBy("p_brand").agg(F.array_sort(F.collect_list("p")).alias("props"))
    return props.select("p_brand", sc.emit_node_ddl(sc.clean_label_column(F.col("p_brand")), F.col("props")).alias("ddl"))


@query(f"SELECT p_brand AS label, p_size AS name, arg_max(kind, p_partkey) AS kind FROM (SELECT *, {_KINDS_SQL} AS kind FROM part) GROUP BY p_brand, p_size")
def schema_merge(spark, sf_dir):
    facts = ad.read_table(spark, sf_dir, "part").select(F.col("p_brand").alias("label"), F.col("p_size").alias("name"), _kind().alias("kind"), F.col("p_partkey").alias("at"))
    return sc.merge_properties(facts, "label", "name", "kind", "at")


@query("SELECT l_returnflag AS type, l_linestatus AS src, l_linenumber AS dst, min(l_orderkey * 100 + l_linenumber) AS at FROM lineitem GROUP BY ALL")
def schema_merge_rels(spark, sf_dir):
    facts = ad.read_table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("type"), F.col("l_linestatus").alias("src"), F.col("l_linenumber").alias("dst"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("at"))
    return sc.merge_relationships(facts, "at")


_EXPECTED = [
    "CREATE NODE TABLE Customer(id INT64, name STRING, balance DOUBLE, PRIMARY KEY (id));\nCREATE NODE TABLE Orders(id INT64, total DOUBLE, PRIMARY KEY (id));\nCREATE REL TABLE PLACED(FROM Customer TO Orders);",
] * 3 + [sc.TRIVIAL_DDL]


@query(f"{_T2C}, expected(k, ddl) AS (VALUES {', '.join(f'({k}, {ad._text(d)})' for k, d in enumerate(_EXPECTED))}) SELECT row_id, ddl FROM t2c JOIN expected ON k = (row_id // {ad.KINDS}) % {len(ad.SCHEMAS)}")
def schema_compile(spark, sf_dir):
    return sn.compile_column(_t2c(spark, sf_dir).select("row_id", "schema")).select("row_id", "ddl")


@query(f"{_T2C} SELECT count(*) AS total, count(*) FILTER ({_NO_SCHEMA}) AS trivial, round(count(*) FILTER (NOT {_NO_SCHEMA}) / greatest(count(*), 1), 9) AS non_trivial_rate FROM t2c")
def parse_rate(spark, sf_dir):
    return sc.parse_rate(sn.compile_column(_t2c(spark, sf_dir).select("schema"))).withColumn("non_trivial_rate", F.round("non_trivial_rate", 9))


@query(f"{_T2C}, expected(k, ddl) AS (VALUES {', '.join(f'({k}, {ad._text(d)})' for k, d in enumerate(_EXPECTED))}) SELECT row_id, statement FROM (SELECT row_id, trim(u, chr(10) || ' ') AS statement FROM (SELECT row_id, unnest(string_split(ddl, ';')) AS u FROM t2c JOIN expected ON k = (row_id // {ad.KINDS}) % {len(ad.SCHEMAS)})) WHERE statement <> ''")
def statement_split(spark, sf_dir):
    return schema_compile(spark, sf_dir).select("row_id", F.explode(sc.statements(F.col("ddl"))).alias("statement"))


# --- pattern graphs
_BODY = "'(c:Customer {name: ''' || c_name || '''})-[:PLACED]->(o:Orders|Old), (c)-[r:IN|OF*1..2]-(n {x: 1}), (:Region)'"
_NODE_SQL, _REL_SQL = ad._text(pattern.NODE), ad._text("(?s)" + pattern.RELATIONSHIP.replace("[^]]", "[^\\]]"))


def _bodies(spark, sf_dir):
    body = F.concat(F.lit("(c:Customer {name: '"), "c_name", F.lit("'})-[:PLACED]->(o:Orders|Old), (c)-[r:IN|OF*1..2]-(n {x: 1}), (:Region)"))
    return ad.read_table(spark, sf_dir, "customer").select("c_custkey", body.alias("body"))


def _first(x: str) -> str:
    return f"coalesce(nullif(trim(string_split({x}, '|')[1]), ''), '{pattern.UNLABELED}')"


@query(f"SELECT c_custkey, {_first('label')} AS label FROM (SELECT c_custkey, unnest(regexp_extract_all({_BODY}, {_NODE_SQL}, 2)) AS label FROM customer)")
def pattern_nodes(spark, sf_dir):
    return _bodies(spark, sf_dir).select("c_custkey", F.explode(pattern.node_labels(F.col("body"))).alias("label"))


@query(f"SELECT c_custkey, {_first('type')} AS type FROM (SELECT c_custkey, unnest(regexp_extract_all({_BODY}, {_REL_SQL}, 2)) AS type FROM customer)")
def pattern_rels(spark, sf_dir):
    return _bodies(spark, sf_dir).select("c_custkey", F.explode(pattern.relationship_types(F.col("body"))).alias("type"))


@query(f"{_T2C} SELECT row_id, CASE WHEN row_id % 8 IN (0, 1, 2, 4) THEN 3 WHEN row_id % 8 = 5 THEN 1 ELSE 0 END AS size FROM t2c")
def graph_size(spark, sf_dir):
    return _pred(spark, sf_dir).select("row_id", pattern.graph_size(pattern.graph_column("pred")).alias("size"))


@query(f"{_T2C} SELECT row_id, CASE WHEN row_id % 8 IN (0, 2, 4) THEN 0.5 WHEN row_id % 8 = 5 THEN 0.25 ELSE 0.0 END::DOUBLE AS overlap FROM t2c")
def label_overlap(spark, sf_dir):
    d = _pred(spark, sf_dir).select("row_id", pattern.graph_column("pred").alias("p"), pattern.graph_column("cypher").alias("g"))
    return d.select("row_id", pattern.label_overlap(F.col("p.nodes.label"), F.col("g.nodes.label")).alias("overlap"))


@query(f"SELECT c_custkey, regexp_replace({_BODY}, {ad._text(X.STRING_LITERAL.replace(chr(92) + chr(34), chr(34)))}, '''''', 'g') AS blanked FROM customer")
def blank_strings(spark, sf_dir):
    return _bodies(spark, sf_dir).select("c_custkey", X.blank_strings(F.col("body")).alias("blanked"))


@query("SELECT c_custkey, unnest(['(c:Customer {name: ''' || c_name || '''})-[:PLACED]->(o:Orders|Old)', ' (c)-[r:IN|OF*1..2]-(n {x: 1})', ' (:Region)']) AS piece FROM customer")
def top_level_commas(spark, sf_dir):
    return _bodies(spark, sf_dir).select("c_custkey", F.explode(X.top_level_pieces(F.col("body"))).alias("piece"))


@query(f"{_T2C} SELECT row_id, (row_id % 8 IN (0, 1, 2, 4)) AS oversize FROM t2c")
def oversize(spark, sf_dir):
    """The size gate, at 2 elements here so that both outcomes are met."""
    return graph_size(spark, sf_dir).select("row_id", (F.col("size") > 2).alias("oversize"))


@query()
def ged_score(spark, sf_dir):
    return _pred(spark, sf_dir).select("row_id", F.round(pattern.ged_column("pred", "cypher"), 9).alias("ged"))


@query()
def ged_exact(spark, sf_dir):
    """The score with ten times the budget, whether it is exact, and whether the usual budget would have cut it."""
    d = _pred(spark, sf_dir)
    d = d.select("row_id", pattern.ged_struct("pred", "cypher", pattern.LONG_BUDGET).alias("long"), pattern.ged_struct("pred", "cypher")["exact"].alias("within_budget"))
    return d.select("row_id", F.round("long.score", 9).alias("ged"), "long.exact", "within_budget")


# patterns of three arrows, by key: the types differ, each way of the arrow is met, and a comma starts a new path
_ARROW_SQL = "CASE s_suppkey % 3 WHEN 0 THEN '-[:T' || s_suppkey || ']->' WHEN 1 THEN '-[x:T' || s_suppkey || '|Z]-' ELSE '<-[:T' || s_suppkey || ' {k: 1}]-' END"


def _arrows(spark, sf_dir):
    k = F.col("s_suppkey").cast("string")
    way = F.col("s_suppkey") % 3
    arrow = F.when(way == 0, F.concat(F.lit("-[:T"), k, F.lit("]->"))).when(way == 1, F.concat(F.lit("-[x:T"), k, F.lit("|Z]-"))).otherwise(F.concat(F.lit("<-[:T"), k, F.lit(" {k: 1}]-")))
    text = F.concat(F.lit("MATCH (a:A)"), arrow, F.lit("(b:B)-[:S]->(c), (c)"), arrow, F.lit("(a) WHERE a.x = '(z)-[:No]->(y)' OPTIONAL MATCH (a)-[:U]->(:D) RETURN a"))
    return ad.read_table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("text"))


@query(
    "WITH e(src, dst, type, way) AS (VALUES ('n0', 'n1', 'T', 0), ('n1', 'n0', 'T', 1), ('n1', 'n2', 'S', 0), ('n2', 'n0', 'T', 0), ('n0', 'n2', 'T', 1), ('n0', 'n3', 'U', 0)) "
    "SELECT s_suppkey, src, dst, CASE type WHEN 'T' THEN 'T' || s_suppkey ELSE type END AS type FROM supplier, e WHERE way = 0 OR s_suppkey % 3 <> 0"
)
def graph_edges(spark, sf_dir):
    d = _arrows(spark, sf_dir).select("s_suppkey", F.explode(pattern.graph_column("text")["edges"]).alias("e"))
    return d.select("s_suppkey", "e.src", "e.dst", "e.type")


@query(
    f"SELECT s_suppkey, unnest(['(a:A)' || {_ARROW_SQL} || '(b:B)-[:S]->(c), (c)' || {_ARROW_SQL} || '(a) ', '(a)-[:U]->(:D) ']) AS body FROM supplier"
)
def clause_segments(spark, sf_dir):
    return _arrows(spark, sf_dir).select("s_suppkey", F.explode(pattern.clause_bodies(F.col("text"))).alias("body"))


# --- judging
@query(f"{_T2C} SELECT row_id, {_GRADE} AS grade FROM t2c")
def judge_grades(spark, sf_dir):
    return judge.judge_column(_pred(spark, sf_dir), "pred").select("row_id", "grade")


@query(f"{_T2C} SELECT data_source, round(avg({_EXEC}), 9) AS accuracy FROM t2c GROUP BY data_source")
def exec_accuracy(spark, sf_dir):
    return ev.row_metrics(_t2c(spark, sf_dir)).groupBy("data_source").agg(F.round(F.avg("exec"), 9).alias("accuracy"))


@query(f"{_T2C} SELECT row_id, CASE WHEN row_id % 8 >= 6 THEN 'parse' WHEN row_id % 8 = 3 THEN NULL WHEN {_NO_SCHEMA} OR row_id % 8 = 1 THEN 'runtime' END AS error_kind FROM t2c")
def error_kind(spark, sf_dir):
    d = _pred(spark, sf_dir).select("row_id", judge.execution_column(F.col("pred"), F.col("schema")).alias("r"))
    return d.select("row_id", "r.error_kind")


@query(f"{_T2C} SELECT row_id, CASE WHEN row_id % 8 >= 6 THEN 'parse' END AS error_kind FROM t2c")
def error_kind_schemaless(spark, sf_dir):
    d = _pred(spark, sf_dir).select("row_id", judge.execution_column(F.col("pred"), F.col("schema"), "schemaless").alias("r"))
    return d.select("row_id", "r.error_kind")


_HOSTILE = [
    ("UNWIND range(1, 1000000000) AS x RETURN x", "timeout"),
    ("UNWIND range(1, 1000) AS x UNWIND range(1, 1000) AS y UNWIND range(1, 1000) AS z RETURN x", "timeout"),
    ("WITH 7 AS x " + "WITH x * x AS x " * 9 + "RETURN x", "runtime"),
    ("RETURN " + "(" * 2000 + "1", "runtime"),
    ("CALL db.labels() YIELD label RETURN label", "runtime"),
    ("RETURN size(range(1, 1000000000)) AS n", None),
    ("RETURN " + "[" * 9, "parse"),
]


@query(f"WITH h(k, kind) AS (VALUES {', '.join(f'({k}, {ad._text(kind) if kind else chr(78) + chr(85) + chr(76) + chr(76)})' for k, (_, kind) in enumerate(_HOSTILE))}) SELECT c_custkey, kind AS error_kind, CASE kind WHEN 'parse' THEN 0.0 WHEN 'timeout' THEN 0.3 WHEN 'runtime' THEN 0.3 ELSE 0.7 END::DOUBLE AS grade FROM customer JOIN h ON k = c_custkey % {len(_HOSTILE)}")
def judge_hostile(spark, sf_dir):
    """Completions made to break a judge: each ends within its budget, with a grade."""
    key = F.col("c_custkey")
    text = F.get(F.array(*[F.lit(q) for q, _ in _HOSTILE]), (key % len(_HOSTILE)).cast("int"))
    d = ad.read_table(spark, sf_dir, "customer").select("c_custkey", text.alias("pred"), F.lit("MATCH (c:Customer) RETURN c").alias("cypher"), F.lit(ad.SCHEMAS[0]).alias("schema"))
    d = judge.judge_column(d, "pred").withColumn("r", judge.execution_column(F.col("pred"), F.col("schema")))
    return d.select("c_custkey", "r.error_kind", "grade")


@query("SELECT a.o_custkey AS k, (SELECT list(DISTINCT o_orderstatus ORDER BY o_orderstatus) FROM orders x WHERE x.o_custkey = a.o_custkey) = (SELECT list(DISTINCT o_orderstatus ORDER BY o_orderstatus) FROM orders y WHERE y.o_custkey = a.o_custkey + 1) AS same FROM (SELECT DISTINCT o_custkey FROM orders) a WHERE EXISTS (SELECT 1 FROM orders z WHERE z.o_custkey = a.o_custkey + 1)")
def rowset_equal(spark, sf_dir):
    rows = ad.read_table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_list("o_orderstatus").alias("r"))
    after = rows.select((F.col("k") - 1).alias("k"), F.col("r").alias("s"))
    return rows.join(after, "k").select("k", judge.rowset_equal(F.col("r"), F.col("s")).alias("same"))


@query(f"{_T2C} SELECT row_id, round({_GRADE} + {q_penalty('n_tokens')}, 9) AS reward FROM t2c")
def composite_reward(spark, sf_dir):
    """Weights 1, 0, 0, 1: the components SQL can say."""
    d = judge.composite(_t2c(spark, sf_dir), weights=(1, 0, 0, 1))
    return d.select("row_id", F.round("reward", 9).alias("reward"))


@query(f"{_T2C} SELECT row_id, 0.0::DOUBLE AS r_judge, 0.0::DOUBLE AS r_string, 0.0::DOUBLE AS r_ged, 0.0::DOUBLE AS r_length, 0.0::DOUBLE AS reward FROM t2c")
def missing_inputs(spark, sf_dir):
    """Scores of rows that have neither gold, schema nor token counts."""
    d = judge.composite(_t2c(spark, sf_dir).select("row_id", "completion"))
    return d.select("row_id", "r_judge", "r_string", "r_ged", "r_length", "reward")


@query()
def composite_reward_full(spark, sf_dir):
    d = judge.composite(_t2c(spark, sf_dir))
    return d.select("row_id", *[F.round(c, 9).alias(c) for c in ("r_judge", "r_string", "r_ged", "r_length", "reward")])


@query(f"SELECT doc_id, substring(text, 1, 300) AS message FROM documents")
def error_truncation(spark, sf_dir):
    return ad.read_table(spark, sf_dir, "documents").select("doc_id", X.short_error(F.col("text")).alias("message"))


# --- graph queries over the star schema, against hand-written SQL
GRAPH_QUERIES = {
    "cy_scan_filter": ("MATCH (c:Customer) WHERE c.acctbal > 5000 AND c.mktsegment <> 'BUILDING' RETURN c.name AS name, c.acctbal AS bal", "SELECT c_name AS name, c_acctbal AS bal FROM customer WHERE c_acctbal > 5000 AND c_mktsegment <> 'BUILDING'"),
    "cy_inline_props": ("MATCH (c:Customer {mktsegment: 'BUILDING'}) RETURN c.id AS id, c.name AS name", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "cy_one_hop": ("MATCH (c:Customer)-[:PLACED]->(o:Orders) WHERE o.totalprice > 300000 RETURN c.name AS name, o.id AS o", "SELECT c_name AS name, o_orderkey AS o FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 300000"),
    "cy_two_hop": ("MATCH (c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS r, n.name AS n, count(*) AS k", "SELECT r_name AS r, n_name AS n, count(*) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"),
    "cy_edge_props": ("MATCH (o:Orders)-[x:CONTAINS]->(p:Part) WHERE x.quantity > 45 AND p.size < 10 RETURN p.brand AS brand, sum(x.quantity) AS q, count(DISTINCT o.id) AS k", "SELECT p_brand AS brand, sum(l_quantity) AS q, count(DISTINCT l_orderkey) AS k FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 45 AND p_size < 10 GROUP BY p_brand"),
    "cy_left_arrow": ("MATCH (o:Orders)<-[:PLACED]-(c:Customer) WHERE o.orderstatus = 'F' RETURN c.id AS c, count(o) AS k", "SELECT o_custkey AS c, count(*) AS k FROM orders WHERE o_orderstatus = 'F' GROUP BY 1"),
    "cy_undirected": ("MATCH (a:Region)-[:IN_REGION]-(b) RETURN a.name AS a, b.name AS b", "SELECT r_name AS a, n_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "cy_alternation": ("MATCH (x:Customer|Supplier)-[:IN_NATION]->(n:Nation) RETURN n.name AS n, label(x) AS l, count(*) AS k", "SELECT n_name AS n, 'Customer' AS l, count(*) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name UNION ALL SELECT n_name, 'Supplier', count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name"),
    "cy_comma_cross": ("MATCH (a:Region), (b:Region) WHERE a.id < b.id RETURN a.name AS a, b.name AS b", "SELECT a.r_name AS a, b.r_name AS b FROM region a, region b WHERE a.r_regionkey < b.r_regionkey"),
    "cy_comma_shared": ("MATCH (c:Customer)-[:IN_NATION]->(n:Nation), (s:Supplier)-[:IN_NATION]->(n) WHERE c.acctbal > 9500 RETURN c.id AS c, s.id AS s", "SELECT c_custkey AS c, s_suppkey AS s FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_acctbal > 9500"),
    "cy_optional": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Orders) WHERE o.totalprice > 400000 RETURN c.id AS c, coalesce(o.id, -1) AS o, coalesce(o.totalprice, 0.0) AS t", "SELECT c_custkey AS c, coalesce(o_orderkey, -1) AS o, coalesce(o_totalprice, 0.0) AS t FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000"),
    "cy_exists": ("MATCH (c:Customer) WHERE EXISTS { MATCH (c)-[:PLACED]->(o:Orders) WHERE o.totalprice > 400000 } RETURN c.id AS c", "SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)"),
    "cy_not_exists": ("MATCH (c:Customer) WHERE NOT EXISTS { (c)-[:PLACED]->(o:Orders) WHERE o.orderstatus = 'P' AND o.totalprice > c.acctbal * 20 } RETURN c.id AS c", "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > c_acctbal * 20)"),
    "cy_exists_or": ("MATCH (c:Customer) WHERE c.acctbal < 0 OR (c)-[:IN_NATION]->(:Nation {name: 'NATION_3'}) RETURN c.id AS c", "SELECT c_custkey AS c FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < 0 OR n_name = 'NATION_3'"),
    "cy_date_literal": ("MATCH (o:Orders) WHERE o.orderdate >= date('1998-01-01') AND o.orderdate < date('1998-03-01') RETURN count(*) AS n", "SELECT count(*) AS n FROM orders WHERE o_orderdate >= date '1998-01-01' AND o_orderdate < date '1998-03-01'"),
    "cy_with_having": ("MATCH (c:Customer)-[:PLACED]->(o:Orders) WITH c, count(o) AS k, sum(o.totalprice) AS t WHERE k > 12 RETURN c.name AS name, k, round(t, 2) AS t", "SELECT c_name AS name, count(*) AS k, round(sum(o_totalprice), 2) AS t FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name HAVING count(*) > 12"),
    "cy_with_chain": ("MATCH (c:Customer) WITH c ORDER BY c.acctbal DESC, c.id LIMIT 10 MATCH (c)-[:PLACED]->(o:Orders) RETURN c.id AS c, count(*) AS k", "SELECT c_custkey AS c, count(*) AS k FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10) JOIN orders ON o_custkey = c_custkey GROUP BY 1"),
    "cy_return_distinct": ("MATCH (c:Customer)-[:IN_NATION]->(n:Nation) RETURN DISTINCT c.mktsegment AS s, n.name AS n", "SELECT DISTINCT c_mktsegment AS s, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "cy_group_agg": ("MATCH (o:Orders) RETURN o.orderstatus AS s, count(*) AS n, round(avg(o.totalprice), 4) AS a, min(o.id) AS lo, max(o.id) AS hi", "SELECT o_orderstatus AS s, count(*) AS n, round(avg(o_totalprice), 4) AS a, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders GROUP BY 1"),
    "cy_global_agg": ("MATCH (c:Customer) WHERE c.acctbal > 1000000 RETURN count(*) AS n, sum(c.id) AS s, coalesce(max(c.id), -1) AS m", "SELECT count(*) AS n, coalesce(sum(c_custkey), 0)::BIGINT AS s, coalesce(max(c_custkey), -1) AS m FROM customer WHERE c_acctbal > 1000000"),
    "cy_collect_distinct": ("MATCH (c:Customer) RETURN size(collect(DISTINCT c.mktsegment)) AS n, count(DISTINCT c.mktsegment) AS m", "SELECT count(DISTINCT c_mktsegment) AS n, count(DISTINCT c_mktsegment) AS m FROM customer"),
    "cy_order_skip_limit": ("MATCH (c:Customer) RETURN c.name AS name ORDER BY c.acctbal DESC, c.id SKIP 5 LIMIT 7", "SELECT c_name AS name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 7 OFFSET 5"),
    "cy_union": ("MATCH (c:Customer) RETURN c.mktsegment AS x UNION MATCH (r:Region) RETURN r.name AS x", "SELECT c_mktsegment AS x FROM customer UNION SELECT r_name FROM region"),
    "cy_union_all": ("MATCH (n:Nation) RETURN n.regionkey AS x UNION ALL MATCH (r:Region) RETURN r.id AS x", "SELECT n_regionkey::BIGINT AS x FROM nation UNION ALL SELECT r_regionkey::BIGINT FROM region"),
    "cy_unwind": ("UNWIND [3, 1, 2] AS x MATCH (r:Region) WHERE r.id = x RETURN x, r.name AS name", "SELECT x::INT AS x, r_name AS name FROM (SELECT unnest([3, 1, 2]) AS x) JOIN region ON r_regionkey = x"),
    "cy_list_ops": ("MATCH (p:Part) WITH p.id AS id, p.size % 4 + 1 AS x RETURN id, size([y IN [1, 2, 3, 4] WHERE y > x]) AS n, coalesce(head([y IN [1, 2, 3, 4] WHERE y > x | y * 10]), -1) AS h, x IN [2, 4] AS even, size(range(1, x)) + size(range(4, x)) AS r", "SELECT p_partkey AS id, (4 - x)::INT AS n, CASE WHEN x < 4 THEN (x + 1) * 10 ELSE -1 END::INT AS h, x IN (2, 4) AS even, (x + (x = 4)::INT)::INT AS r FROM (SELECT p_partkey, p_size % 4 + 1 AS x FROM part)"),
    "cy_int_division": ("MATCH (p:Part) RETURN p.id AS id, p.size / 7 AS a, (p.size + 0.5) / 2 AS b, (10 - p.size) / 4 AS c, (10 - p.size) % 4 AS m, p.size / 4.0 AS d", "SELECT p_partkey AS id, (p_size // 7)::BIGINT AS a, (p_size + 0.5::DOUBLE) / 2 AS b, trunc((10 - p_size) / 4)::BIGINT AS c, (10 - p_size) % 4 AS m, p_size / 4.0::DOUBLE AS d FROM part"),
    "cy_string_concat": ("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.name + r.name AS a, n.name + '-' + r.name AS b, n.name + n.id AS c, size(n.name + r.name) AS k", "SELECT n_name || r_name AS a, n_name || '-' || r_name AS b, n_name || n_nationkey AS c, length(n_name || r_name)::INT AS k FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "cy_list_concat": ("MATCH (c:Customer) WITH c.id AS id, [c.id, c.nationkey] + [3] + c.id AS xs, [] + [c.name] AS ys RETURN id, size(xs) AS k, last(xs) AS l, xs[2] AS t, c_in IN xs AS i, head(ys) AS n".replace("c_in", "id"), "SELECT c_custkey AS id, 4::INT AS k, c_custkey AS l, 3::BIGINT AS t, true AS i, c_name AS n FROM customer"),
    "cy_size_of_collected": ("MATCH (c:Customer)-[:IN_NATION]->(n:Nation) WITH n, collect(c.name) AS xs, collect(DISTINCT c.mktsegment) AS ys RETURN n.name AS n, size(xs) AS k, size(ys) AS m", "SELECT n_name AS n, count(*)::INT AS k, count(DISTINCT c_mktsegment)::INT AS m FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name"),
    "cy_unwind_null": ("MATCH (c:Customer) UNWIND null AS x RETURN count(x) AS k, count(*) AS n UNION ALL MATCH (c:Customer) WITH CASE WHEN c.acctbal < 0 THEN null ELSE [c.id, null, c.nationkey] END AS xs UNWIND xs AS x RETURN count(x) AS k, count(*) AS n", "SELECT 0::BIGINT AS k, 0::BIGINT AS n UNION ALL SELECT count(*) * 2, count(*) * 3 FROM customer WHERE c_acctbal >= 0"),
    "cy_named_path": ("MATCH p = (c:Customer)-[:IN_NATION|IN_REGION*1..2]->(x) RETURN length(p) AS k, label(x) AS l, last(nodes(p)).id AS x, count(*) AS n", "SELECT 1::BIGINT AS k, 'Nation' AS l, n_nationkey::BIGINT AS x, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 3 UNION ALL SELECT 2, 'Region', n_regionkey::BIGINT, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 3"),
    "cy_named_path_fixed": ("MATCH p = (c:Customer)-[:IN_NATION]->(n:Nation)<-[:IN_NATION]-(s:Supplier) WHERE c.acctbal > 9000 RETURN c.id AS c, nodes(p)[2].id AS s, length(p) + size(relationships(p)) AS k", "SELECT c_custkey AS c, s_suppkey::BIGINT AS s, 4::BIGINT AS k FROM customer JOIN supplier ON s_nationkey = c_nationkey WHERE c_acctbal > 9000"),
    "cy_mixed_types": ("MATCH (c:Customer) RETURN c.id AS id, c.name = c.id AS e, c.name <> c.id AS d, c.name IN [c.id] AS i, coalesce(c.name < c.id, false) AS l, [c.id] = [c.id * 1.0] AS x", "SELECT c_custkey AS id, false AS e, true AS d, false AS i, false AS l, true AS x FROM customer"),
    "cy_anchor_last": ("MATCH (c:Customer)-[:PLACED]->(o:Orders)-[:CONTAINS]->(p:Part) WHERE p.name = 'red widget' AND p.size < 5 RETURN c.id AS c, count(*) AS k", "SELECT o_custkey AS c, count(*) AS k FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_name = 'red widget' AND p_size < 5 GROUP BY 1"),
    "cy_anchor_middle": ("MATCH (c:Customer)-[:PLACED]->(:Orders {id: 7})-[x:CONTAINS]->(p:Part) RETURN c.id AS c, p.id AS p, x.quantity AS q", "SELECT o_custkey AS c, l_partkey AS p, l_quantity AS q FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey = 7"),
    "cy_optional_turned": ("MATCH (o:Orders) WHERE o.totalprice > 300000 OPTIONAL MATCH (c:Customer)-[:PLACED]->(o) WHERE c.acctbal < 0 RETURN o.id AS o, coalesce(c.id, -1) AS c", "SELECT o_orderkey AS o, coalesce(c_custkey, -1) AS c FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal < 0 WHERE o_totalprice > 300000"),
    "cy_case": ("MATCH (o:Orders) RETURN CASE WHEN o.totalprice > 300000 THEN 'high' WHEN o.totalprice > 100000 THEN 'mid' ELSE 'low' END AS c, count(*) AS n", "SELECT CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS c, count(*) AS n FROM orders GROUP BY 1"),
    "cy_strings": ("MATCH (p:Part) WHERE p.name STARTS WITH 'P' OR p.type CONTAINS 'STEEL' OR p.brand ENDS WITH '1' RETURN p.id AS id, toLower(p.brand) + '!' AS b, substring(p.type, 0, 3) AS t", "SELECT p_partkey AS id, lower(p_brand) || '!' AS b, substring(p_type, 1, 3) AS t FROM part WHERE starts_with(p_name, 'P') OR contains(p_type, 'STEEL') OR ends_with(p_brand, '1')"),
    "cy_null_logic": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Orders) WHERE o.totalprice > 450000 WITH c, o WHERE o IS NULL AND NOT c.acctbal < 0 RETURN count(c) AS n", "SELECT count(*) AS n FROM customer WHERE NOT c_acctbal < 0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)"),
    "cy_var_length": ("MATCH (c:Customer)-[:IN_NATION|IN_REGION*1..2]->(x) RETURN label(x) AS l, x.name AS n, count(*) AS k", "SELECT 'Nation' AS l, n_name AS n, count(*) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name UNION ALL SELECT 'Region', r_name, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"),
    "cy_unlabeled": ("MATCH (n) WHERE n.name = 'ASIA' OR n.name = 'NATION_2' RETURN label(n) AS l, n.id AS id", "SELECT 'Region' AS l, r_regionkey::BIGINT AS id FROM region WHERE r_name IN ('ASIA', 'NATION_2') UNION ALL SELECT 'Nation', n_nationkey FROM nation WHERE n_name IN ('ASIA', 'NATION_2')"),
    "cy_edge_unique": ("MATCH (a:Orders)<-[:PLACED]-(c:Customer)-[:PLACED]->(b:Orders) WHERE a.totalprice > 300000 AND b.totalprice > 300000 RETURN c.id AS c, count(*) AS k", "SELECT a.o_custkey AS c, count(*) AS k FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey WHERE a.o_totalprice > 300000 AND b.o_totalprice > 300000 GROUP BY 1"),
}


def _graph_query(text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return GraphSession(spark, ad.star_graph(spark, sf_dir)).execute(text)

    return run


for _name, (_text_, _sql) in GRAPH_QUERIES.items():
    QUERIES[_name] = _graph_query(_text_)
    ORACLES[_name] = _sql


@query("SELECT count(*) AS n, sum((c_mktsegment = 'BUILDING')::INT)::BIGINT AS k FROM (SELECT c_mktsegment FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT 'BUILDING')")
def cy_updates(spark, sf_dir):
    """CREATE and DELETE on a session of its own: the graph's tables are replaced, the files are not touched."""
    g = GraphSession(spark, ad.star_graph(spark, sf_dir))
    g.execute("CREATE (c:Customer {id: -1, name: 'new', acctbal: 1.0, mktsegment: 'none'})")
    g.execute("MATCH (c:Customer {id: -1}) SET c.mktsegment = 'BUILDING'")
    g.execute("MATCH (c:Customer) WHERE c.acctbal < 0 DETACH DELETE c")
    return g.execute("MATCH (c:Customer) RETURN count(*) AS n, sum(CASE WHEN c.mktsegment = 'BUILDING' THEN 1 ELSE 0 END) AS k")


def _changed(text: str, reading: str):
    """A query after an update, on a session of its own: the graph's tables are replaced, the files are not touched."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = GraphSession(spark, ad.star_graph(spark, sf_dir))
        g.execute(text)
        return g.execute(reading)

    return run


_REGIONS = "MATCH (n:Nation)-[r:IN_REGION]->(x:Region) RETURN n.id AS n, x.id AS x"
UPDATES = {
    "cy_merge": ("MATCH (n:Nation) WHERE n.id < 9 MERGE (x:Region {name: n.name}) MERGE (n)-[:IN_REGION]->(x) MERGE (y:Region {id: n.regionkey}) MERGE (n)-[:IN_REGION]->(y)", "MATCH (n:Nation)-[:IN_REGION]->(x:Region) RETURN n.id AS n, x.name AS x",
                 "SELECT n_nationkey AS n, r_name AS x FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 9"),
    "cy_delete_rel": ("MATCH (n:Nation)-[r:IN_REGION]->(x:Region) WHERE n.id > x.id + 3 DELETE r", _REGIONS, "SELECT n_nationkey AS n, n_regionkey AS x FROM nation WHERE n_nationkey <= n_regionkey + 3"),
    "cy_set_rel": ("MATCH (o:Orders)-[r:CONTAINS]->(p:Part) WHERE r.quantity > 40 SET r.discount = r.quantity", "MATCH (o:Orders)-[r:CONTAINS]->(p:Part) RETURN r.returnflag AS f, count(*) AS n, round(sum(r.discount), 4) AS d",
                   "SELECT l_returnflag AS f, count(*) AS n, round(sum(CASE WHEN l_quantity > 40 THEN l_quantity ELSE l_discount END), 4) AS d FROM lineitem GROUP BY 1"),
}
for _name, (_update, _reading, _sql) in UPDATES.items():
    QUERIES[_name] = _changed(_update, _reading)
    ORACLES[_name] = _sql


@query("WITH RECURSIVE walk(a, b, n) AS (SELECT n_nationkey, n_nationkey + 1, 1 FROM nation WHERE n_nationkey = 0 UNION ALL SELECT a, b + 1, n + 1 FROM walk WHERE b < (SELECT max(n_nationkey) FROM nation)) SELECT b::BIGINT AS b, n FROM walk")
def cy_var_unbounded(spark, sf_dir):
    """Nations in a row: paths from the first are as long as the row, with no bound in the query."""
    nation = ad.read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    row = nation.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).join(nation.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
    g = GraphSession(spark, PropertyGraph({"N": nation}, {"NEXT": [("N", "N", row)]}))
    return g.execute("MATCH (a:N {id: 0})-[p:NEXT*]->(b) RETURN b.id AS b, size(p) AS n")


# customers in a graph with cycles: each order leads from its customer to another one
_NEXT_SQL = "e AS (SELECT DISTINCT o_custkey AS src, (o_orderkey * 31 + o_custkey) % (SELECT count(*) FROM customer) AS dst FROM orders)"


def _customer_graph(spark, sf_dir) -> GraphSession:
    star = ad.star_graph(spark, sf_dir)
    n = star.nodes["Customer"].agg(F.count(F.lit(1)).alias("n"))
    orders = ad.read_table(spark, sf_dir, "orders").crossJoin(F.broadcast(n))  # one row
    edges = orders.select(F.col("o_custkey").alias("src"), ((F.col("o_orderkey") * 31 + F.col("o_custkey")) % F.col("n")).alias("dst")).distinct()
    return GraphSession(spark, PropertyGraph({"Customer": star.nodes["Customer"]}, {"NEXT": [("Customer", "Customer", edges)]}))


@query(f"WITH RECURSIVE {_NEXT_SQL}, r(a, b) AS (SELECT c_custkey, dst FROM customer JOIN e ON src = c_custkey WHERE c_acctbal > 9950 UNION SELECT a, dst FROM r JOIN e ON src = b) SELECT a, b::BIGINT AS b FROM r")
def cy_reachable(spark, sf_dir):
    """Who can be reached from the richest customers, along any number of orders."""
    return _customer_graph(spark, sf_dir).execute("MATCH (a:Customer)-[:NEXT*]->(b:Customer) WHERE a.acctbal > 9950 RETURN DISTINCT a.id AS a, b.id AS b")


@query(f"WITH RECURSIVE {_NEXT_SQL}, t(c, n) AS (SELECT c_custkey, 0 FROM customer WHERE c_acctbal > 9900 UNION SELECT src, n + 1 FROM t JOIN e ON dst = c WHERE n < 2) SELECT c_custkey AS c FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey NOT IN (SELECT c FROM t WHERE n > 0)")
def cy_reachable_not(spark, sf_dir):
    """Who can't reach a rich customer in two steps: an anti join with pairs that are found once."""
    return _customer_graph(spark, sf_dir).execute("MATCH (a:Customer {mktsegment: 'BUILDING'}) WHERE NOT EXISTS { (a)-[:NEXT*1..2]->(b:Customer) WHERE b.acctbal > 9900 } RETURN a.id AS c")


# --- results of queries compared as frames
_HALF = "o_totalprice > 100000"
_SIDES = [  # name, the two sides as SQL, and as frames over orders
    ("turned round", f"SELECT o_orderkey, o_custkey FROM orders WHERE {_HALF}", f"SELECT o_orderkey, o_custkey FROM orders WHERE {_HALF} ORDER BY o_custkey DESC"),
    ("other types", f"SELECT o_orderkey, o_custkey FROM orders WHERE {_HALF}", f"SELECT o_orderkey::DOUBLE, o_custkey::DECIMAL(20, 2) FROM orders WHERE {_HALF}"),
    ("repeated", "SELECT o_orderstatus FROM orders", "SELECT DISTINCT o_orderstatus FROM orders"),
    ("one row less", "SELECT o_orderkey FROM orders", "SELECT o_orderkey FROM orders WHERE o_orderkey <> (SELECT max(o_orderkey) FROM orders)"),
    ("columns exchanged", "SELECT o_orderkey, o_custkey FROM orders", "SELECT o_custkey, o_orderkey FROM orders"),
    ("truth as number", f"SELECT o_custkey, {_HALF} FROM orders", f"SELECT o_custkey, ({_HALF})::INT FROM orders"),
    ("nulls", "SELECT nullif(o_custkey % 5, 0), o_orderstatus FROM orders", "SELECT CASE WHEN o_custkey % 5 > 0 THEN o_custkey % 5 END, o_orderstatus FROM orders ORDER BY 2"),
    ("nothing", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey < 0", "SELECT o_orderkey FROM orders WHERE o_orderkey < -1"),
    ("a cent more", "SELECT o_orderkey, o_totalprice FROM orders", "SELECT o_orderkey, CASE WHEN o_orderkey = 5 THEN o_totalprice + 0.01 ELSE o_totalprice END FROM orders"),
]


def _sides_sql() -> str:
    parts = []
    for name, a, b in _SIDES:
        if name == "nothing":  # sets without rows, of other widths
            parts.append(f"SELECT '{name}' AS pair, NOT EXISTS ({a}) AND NOT EXISTS ({b}) AS equal, 0::BIGINT AS n_left, 0::BIGINT AS n_right")
        else:
            parts.append(f"SELECT '{name}' AS pair, NOT EXISTS (({a}) EXCEPT ({b})) AND NOT EXISTS (({b}) EXCEPT ({a})) AS equal, (SELECT count(*) FROM (SELECT DISTINCT * FROM ({a}))) AS n_left, (SELECT count(*) FROM (SELECT DISTINCT * FROM ({b}))) AS n_right")
    return " UNION ALL ".join(parts)


@query(_sides_sql())
def rowset_frames(spark, sf_dir):
    """Two results compared as sets of rows: reordered, of other types, repeated, and with small differences."""
    o = ad.read_table(spark, sf_dir, "orders")
    key, cust, status, price = (F.col(f"o_{c}") for c in ("orderkey", "custkey", "orderstatus", "totalprice"))
    half = o.filter(price > 100000)
    sides = {
        "turned round": (half.select(key, cust), half.repartition(7).select(key.alias("x"), cust.alias("x")).sortWithinPartitions(F.rand(1))),
        "other types": (half.select(key, cust), half.select(key.cast("double"), cust.cast("decimal(20,2)"))),
        "repeated": (o.select(status), o.select(status).distinct()),
        "one row less": (o.select(key), o.select(key).join(F.broadcast(o.agg(F.max(key).alias("o_orderkey"))), "o_orderkey", "left_anti")),
        "columns exchanged": (o.select(key, cust), o.select(cust, key)),
        "truth as number": (o.select(cust, price > 100000), o.select(cust, (price > 100000).cast("int"))),
        "nulls": (o.select(F.nullif(cust % 5, F.lit(0)), status), o.select(F.when(cust % 5 > 0, cust % 5), status)),
        "nothing": (o.filter(key < 0).select(key, cust), o.filter(key < -1).select(key)),
        "a cent more": (o.select(key, price), o.select(key, F.when(key == 5, price + 0.01).otherwise(price))),
    }
    found = [rs.same_rows(a, b).select(F.lit(name).alias("pair"), "equal", "n_left", "n_right") for name, (a, b) in sides.items()]
    return functools.reduce(DataFrame.union, found)


# --- predictions run over the graph's rows: the gold query and what a model may answer, with the same as SQL
_GOLD_PATH = "MATCH (c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region {name: '@'})"
_PEOPLE = "SELECT n_name AS a, count(*) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = g.region"
_PREDICTIONS = [  # the answer, and the grade or SQL for its rows
    (f"{_GOLD_PATH} RETURN n.name, count(*)", f"{_PEOPLE} GROUP BY 1"),
    ("MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:IN_NATION]-(c:Customer) WHERE r.name = '@' RETURN n.name AS x, count(c) * 1.0 AS y ORDER BY y", f"{_PEOPLE} GROUP BY 1"),
    (f"{_GOLD_PATH} RETURN n.name AS a, count(*) AS k UNION ALL {_GOLD_PATH} RETURN n.name AS a, count(*) AS k", f"{_PEOPLE} GROUP BY 1"),
    (_GOLD_PATH.replace("Customer", "Supplier") + " RETURN n.name, count(*)", f"{_PEOPLE} GROUP BY 1".replace("customer", "supplier").replace("c_nationkey", "s_nationkey")),
    (f"{_GOLD_PATH} WHERE c.acctbal > -500 RETURN n.name, count(*)", f"{_PEOPLE} AND c_acctbal > -500 GROUP BY 1"),
    (f"{_GOLD_PATH} WHERE c.acctbal > -2000 RETURN n.name, count(DISTINCT c)", f"{_PEOPLE} AND c_acctbal > -2000 GROUP BY 1"),
    (f"{_GOLD_PATH} WHERE EXISTS {{ (c)-[:PLACED]->(:Orders) }} RETURN n.name, count(*)", f"{_PEOPLE} AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY 1"),
    (f"{_GOLD_PATH} RETURN count(*), n.name", f"SELECT k, a FROM ({_PEOPLE} GROUP BY 1)"),
    (f"{_GOLD_PATH} WITH n, collect(c.id) AS xs RETURN n.name, size(xs)", f"{_PEOPLE} GROUP BY 1"),
    ("MATCH (c:Customer)-[:IN_NATION|IN_REGION*2..2]->(r:Region {name: '@'}), (c)-[:IN_NATION]->(n:Nation) RETURN n.name, count(*)", f"{_PEOPLE} AND false GROUP BY 1"),  # no relationship twice in one MATCH
    (f"{_GOLD_PATH} RETURN n.name, count(*) LIMIT 1", None),
    (f"{_GOLD_PATH} RETURN n.name, count(*) / (count(*) - count(c))", 0.3),
    ("MATCH (c:Client)-[:IN_NATION]->(n) RETURN n.name, count(*)", 0.3),
    (f"{_GOLD_PATH} RETURN n.nome, count(*)", 0.3),
    (f"{_GOLD_PATH} RETURN n.name - 1, count(*)", 0.3),
    ("MATCH (c:Customer RETURN '@'", 0.0),
    ("", 0.0),
]


def _exec_sql() -> str:
    parts = []
    for k, (_, rows) in enumerate(_PREDICTIONS):
        if isinstance(rows, float):
            grade = str(rows)
        elif rows is None:  # one of several rows; all of them where there is one nation
            grade = f"CASE WHEN (SELECT count(*) FROM ({_PEOPLE} GROUP BY 1)) <= 1 THEN 1.0 ELSE 0.7 END"
        else:
            gold = f"SELECT a::VARCHAR, k::VARCHAR FROM ({_PEOPLE} GROUP BY 1)"
            pred = f"SELECT COLUMNS(*)::VARCHAR FROM ({rows})"
            grade = f"CASE WHEN NOT EXISTS (({gold}) EXCEPT ({pred})) AND NOT EXISTS (({pred}) EXCEPT ({gold})) THEN 1.0 ELSE 0.7 END"
        parts.append(f"SELECT g.region, {k} AS answer, ({grade})::DOUBLE AS grade FROM (SELECT r_name AS region FROM region) g")
    return " UNION ALL ".join(parts)


@query(_exec_sql())
def exec_on_graph(spark, sf_dir):
    """Answers to one question for each region, graded by what they and the gold query give over the star graph."""
    answers = F.array(*[F.struct(F.lit(k).alias("answer"), F.lit(text).alias("text")) for k, (text, _) in enumerate(_PREDICTIONS)])
    rows = ad.read_table(spark, sf_dir, "region").select(F.col("r_name").alias("region"), F.explode(answers).alias("x"))
    filled = lambda c: F.replace(c, F.lit("@"), F.col("region"))
    rows = rows.select("region", "x.answer", filled(F.col("x.text")).alias("pred"), filled(F.lit(_PREDICTIONS[0][0])).alias("cypher"))
    graded = gj.GraphJudge(GraphSession(spark, ad.star_graph(spark, sf_dir)), timeout_s=120).grade(rows)
    return graded.select("region", "answer", "grade")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation from completions to the report's rows."""
    return eval_rollup(spark, sf_dir)
