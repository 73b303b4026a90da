"""Inputs: evaluation rows and a property graph over the star-schema tables, dataset scans and samples.

The rows come from `customer` by a fixed rule that SQL can say as well (see T2C_SQL), so every scorer has an oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querylens.plans.checkpoints import checkpointed
from querylens.plans.frames import PropertyGraph

# one schema text of each format, and one that is none
SCHEMAS = [
    "Node properties:\n- **Customer**\n  - `name`: STRING\n  - `balance`: FLOAT\n- **Orders**\n  - `total`: FLOAT\nRelationships:\n(:Customer)-[:PLACED]->(:Orders)",
    '{"Customer":{"type":"node","properties":{"name":{"type":"STRING"},"balance":{"type":"DOUBLE"}}},"Orders":{"type":"node","properties":{"total":{"type":"FLOAT"}}},"PLACED":{"type":"relationship","from":["Customer"],"to":["Orders"]}}',
    "Customer {name: STRING, balance: DOUBLE}\nOrders {total: FLOAT}\n{'start': Customer, 'type': PLACED, 'end': Orders}",
    "no schema here",
]
KINDS = 8  # of completions


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_dataset(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """A dataset of question, schema, cypher and perhaps data_source, as Parquet or JSON lines."""
    return spark.read.format(kind).load(path)


def t2c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (row_id, data_source, question, schema, cypher, completion, n_tokens); the completion's kind goes by row_id % 8."""
    c = read_table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    gold = F.concat(F.lit("MATCH (c:Customer {name: '"), F.col("c_name"), F.lit("'})-[:PLACED]->(o:Orders) RETURN o.total AS total"))
    made = [
        gold,
        F.concat(F.lit("  "), F.upper(gold), F.lit(" ;\n")),
        F.concat(F.lit("```cypher\n"), gold, F.lit("\n```")),
        F.concat(F.lit("```\nUNWIND [1] AS x RETURN x, "), key.cast("string"), F.lit(" AS k\n```")),
        F.concat(F.lit("Here is the query: "), gold),
        F.concat(F.lit("MATCH (c:Customer {name: '"), F.col("c_name"), F.lit("'}) RETURN count(c) AS total")),
        F.concat(F.lit("MATCH (c:Customer RETURN "), key.cast("string")),
        F.lit(""),
    ]
    completion: Column = made[-1]
    for k in range(KINDS - 1):
        completion = F.when(key % KINDS == k, made[k]).otherwise(completion)
    schema: Column = F.lit(SCHEMAS[-1])
    for k in range(len(SCHEMAS) - 1):
        schema = F.when(F.floor(key / KINDS) % len(SCHEMAS) == k, F.lit(SCHEMAS[k])).otherwise(schema)
    return c.select(
        key.alias("row_id"),
        F.when(key % 11 != 0, F.col("c_mktsegment")).alias("data_source"),
        F.concat(F.lit("What did "), F.col("c_name"), F.lit(" order?")).alias("question"),
        schema.alias("schema"),
        gold.alias("cypher"),
        completion.alias("completion"),
        (key * 37 % 700).cast("int").alias("n_tokens"),
    )


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_GOLD = "'MATCH (c:Customer {name: ''' || c_name || '''})-[:PLACED]->(o:Orders) RETURN o.total AS total'"
T2C_SQL = f"""t2c AS (
  SELECT c_custkey AS row_id, CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment END AS data_source, 'What did ' || c_name || ' order?' AS question,
    CASE (c_custkey // {KINDS}) % {len(SCHEMAS)} {" ".join(f"WHEN {k} THEN {_text(s)}" for k, s in enumerate(SCHEMAS[:-1]))} ELSE {_text(SCHEMAS[-1])} END AS schema,
    {_GOLD} AS cypher,
    CASE c_custkey % {KINDS} WHEN 0 THEN {_GOLD} WHEN 1 THEN '  ' || upper({_GOLD}) || ' ;' || chr(10) WHEN 2 THEN '```cypher' || chr(10) || {_GOLD} || chr(10) || '```'
      WHEN 3 THEN '```' || chr(10) || 'UNWIND [1] AS x RETURN x, ' || c_custkey || ' AS k' || chr(10) || '```' WHEN 4 THEN 'Here is the query: ' || {_GOLD}
      WHEN 5 THEN 'MATCH (c:Customer {{name: ''' || c_name || '''}}) RETURN count(c) AS total' WHEN 6 THEN 'MATCH (c:Customer RETURN ' || c_custkey ELSE '' END AS completion,
    (c_custkey * 37 % 700)::INT AS n_tokens
  FROM customer
)"""


def strided_sample(df: DataFrame, order: str, about: int = 200, parts: int = 256) -> DataFrame:
    """Every k-th row in the order of a unique column, k chosen for at least `about` rows (all, if there are fewer).

    Ranks come from range partitions of that column alone: each numbers its own rows and goes on from the counts of those
    before it. The partitions are checkpointed once, so both steps see the same ones. Rows are read again for the chosen
    values, of which there are fewer than 2 * about + 1, or n of them where n < 2 * about.
    """
    keys = df.select(F.col(order).alias("__key")).repartitionByRange(parts, "__key").withColumn("__part", F.spark_partition_id())
    keys = checkpointed(keys)
    counts = keys.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")  # a row for each partition
    step = max(1, keys.count() // about)
    inside = Window.partitionBy("__part").orderBy("__key")
    ranked = keys.withColumn("__k", F.row_number().over(inside) - 1).join(F.broadcast(starts), "__part")
    chosen = ranked.filter((F.col("__start") + F.col("__k")) % step == 0).select("__key")
    return df.join(F.broadcast(chosen), F.col(order).eqNullSafe(F.col("__key")), "left_semi")


def star_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Region, Nation, Customer, Supplier, Part and Orders with IN_REGION, IN_NATION, PLACED, CONTAINS and SUPPLIED_BY."""
    t = {n: read_table(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}

    def renamed(name: str, prefix: str, key: str) -> DataFrame:
        d = t[name]
        return d.select(F.col(key).cast("long").alias("id"), *[F.col(c).alias(c.removeprefix(prefix)) for c in d.columns if c != key])

    def edge(name: str, src: str, dst: str, *props: str) -> DataFrame:
        return t[name].select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"), *[F.col(p).alias(p.removeprefix("l_")) for p in props])

    items = t["lineitem"]
    contains = items.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.xxhash64(*items.columns).alias("eid"), *[F.col(f"l_{p}").alias(p) for p in ("quantity", "extendedprice", "discount", "returnflag", "shipdate")])
    return PropertyGraph(
        nodes={
            "Region": renamed("region", "r_", "r_regionkey"), "Nation": renamed("nation", "n_", "n_nationkey"), "Customer": renamed("customer", "c_", "c_custkey"),
            "Supplier": renamed("supplier", "s_", "s_suppkey"), "Part": renamed("part", "p_", "p_partkey"), "Orders": renamed("orders", "o_", "o_orderkey"),
        },
        rels={
            "IN_REGION": [("Nation", "Region", edge("nation", "n_nationkey", "n_regionkey"))],
            "IN_NATION": [("Customer", "Nation", edge("customer", "c_custkey", "c_nationkey")), ("Supplier", "Nation", edge("supplier", "s_suppkey", "s_nationkey"))],
            "PLACED": [("Customer", "Orders", edge("orders", "o_custkey", "o_orderkey"))],
            "CONTAINS": [("Orders", "Part", contains)],
            "SUPPLIED_BY": [("Part", "Supplier", edge("lineitem", "l_partkey", "l_suppkey").distinct())],
        },
    )
