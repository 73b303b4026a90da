"""URL filters: host-suffix and path-prefix expressions, joined to the rules on short digest prefixes.

Each distinct (host, path) is expanded into `host suffix + path prefix` expressions. A rule is one such expression, so a
lookup is an equi-join: first on PREFIX_HEX hex digits of the digest, then the full digest decides. The shapes (labels of
the host, characters of the path) that the rules have say which expressions are worth making; every other one can't match.
They are one array of numbers, so the plan stays as small with thousands of rules.
The longest matching rule wins; of equally long ones, the one with the longer host.

Distinct pairs are judged once and the verdicts joined back, so a host that holds a third of all pages costs its distinct
paths only. A rule table of at most BROADCAST_RULES rows is broadcast; a longer one is joined by key.

Defined results: a null url or one without `://` has empty host and path and no rule; the verdict without a rule is
`allow`. Repeated rows keep their number, extra columns are kept by `judge_urls`, but for those named like a result (host,
path, rule, verdict), which the result replaces; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylens.llm._shared import checkpointed, table

PREFIX_HEX = 8
BROADCAST_RULES = 50_000
DEFAULT = "allow"
# verdict, host, path
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def split_url(df: DataFrame, url: str) -> DataFrame:
    """Add host and path."""
    address = F.col(f"`{url}`")
    rest = F.coalesce(F.when(F.instr(address, "://") > 0, F.substr(address, F.instr(address, "://") + 3)), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return df.withColumns({"host": host, "path": F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)})


def judge_urls(df: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """Add host, path, rule and verdict. `rules` has verdict, host and path."""
    rules = rules.filter(F.col("host").isNotNull() & F.col("path").isNotNull()).select(
        F.col("verdict").alias("rule_verdict"),
        F.concat("host", "path").alias("rule"),
        F.size(F.split("host", r"\.")).alias("labels"),
        F.length("path").alias("chars"),
        F.length("host").alias("host_chars"),
        F.sha2(F.concat_ws(" ", "host", "path"), 256).alias("digest"),
    )
    rules = checkpointed(rules.groupBy("digest").agg(*[F.min(c).alias(c) for c in ("rule_verdict", "rule", "labels", "chars", "host_chars")]).withColumn("short", F.substring("digest", 1, PREFIX_HEX)))
    n_rules = rules.count()
    shapes = [r[0] << 32 | r[1] for r in rules.select("labels", "chars").distinct().collect()]  # at most labels x path lengths
    pages = split_url(df, url).drop("rule", "verdict")
    pairs = pages.select("host", "path").distinct().withColumn("labels", F.split("host", r"\."))
    n, k = (lambda x: F.shiftright(x, 32).cast("int")), (lambda x: x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int"))
    fitting = F.filter(F.lit(sorted(shapes)).cast("array<long>"), lambda x: (n(x) <= F.size("labels")) & (k(x) <= F.length("path")) & (F.col("host") != ""))
    made = F.transform(fitting, lambda x: F.concat_ws(" ", F.array_join(F.slice("labels", -n(x), n(x)), "."), F.substr("path", F.lit(1), k(x))))
    tried = pairs.select("host", "path", F.explode(made).alias("expression"))
    tried = tried.withColumn("full", F.sha2("expression", 256)).withColumn("short", F.substring("full", 1, PREFIX_HEX))
    hits = tried.join(F.broadcast(rules) if n_rules <= BROADCAST_RULES else rules, "short").filter(F.col("full") == F.col("digest"))
    best = F.max(F.struct(F.length("rule"), "host_chars", "rule", "rule_verdict"))
    verdicts = checkpointed(hits.groupBy("host", "path").agg(best.alias("best")).select("host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict")))
    judged = pages.join(verdicts, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
    return judged.select(*[F.col(f"`{c}`") for c in pages.columns], "rule", "verdict")


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = f"""
WITH rules(rule_verdict, rule_host, rule_path) AS (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}),
rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), split AS (
  SELECT page_id, row_number() OVER () AS row_id, translate(regexp_extract(r, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '(?s)^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), best AS (
  SELECT row_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(rule_verdict, length(rule_host || rule_path)) AS rule_verdict
  FROM split JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY row_id
)
SELECT page_id, host, path, rule, coalesce(rule_verdict, '{DEFAULT}') AS verdict FROM split LEFT JOIN best USING (row_id)
"""
