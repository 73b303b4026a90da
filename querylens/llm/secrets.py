"""Secret scans with multipart credential linking; column expressions only.

Base spans stand for themselves: assignments to a name like `password`, access key ids, long hexadecimal runs. Weak
candidates do not: short assigned values, key ids of other kinds or lengths, logins, long mixed runs, endpoints. A
credential has three parts (an access identifier, a secret, an endpoint), so a weak candidate is reported only if within
SCOPE code points of it there stands

* for an identifier or a secret: a base span of the other of these two, or any candidates for both other parts;
* for an endpoint: an identifier and a secret, each of any strength.

Candidates inside a base span are part of it and not reported. The interval join of parts and scopes is a sweep: among the
parts that start no later than a candidate the greatest end decides whether one reaches into its scope, among those that
start no earlier the least start does. So each candidate meets two running values for each part, never all parts around it.

Matches come as lists of matched and unmatched pieces, whose running lengths are the positions; they are explode'd, so a text
with very many spans makes rows, not growing arrays. Texts are not shuffled.

Defined results: null and empty texts have no spans, '' for `spans` and the digest of ''; repeated rows are judged each on
their own; positions are code points, ends exclusive; an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querylens.llm._shared import let, table

SCOPE = 200


def either_case(words: str) -> str:
    """The pattern with ASCII letters in either case; engines differ on what else (?i) folds."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


_VALUE = r"[A-Za-z0-9+/_.=-]+"
ASSIGN = rf"""({either_case("password|passwd|secret|token|api_?key")})["']?\x20*[:=]\x20*["']?({_VALUE})"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
KEY_ID = r"(?:AKIA|ASIA|AIDA|AROA)[A-Z0-9]{4,}"
LOGIN = rf"""(?:{either_case("user_?name|user_?id|user|login|client_?id|access_?key_?id|account")})["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{{3,}}"""
MIXED = r"[A-Za-z0-9+/_-]{20,}"
ENDPOINT = r"(?:https?|ftps?|s3|postgres|postgresql|mysql|mongodb|redis|amqp|jdbc:[a-z]+)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+"
BASE = ("assign", "access", "hex")
# kinds in their order: pattern, part of a credential, least and greatest number of characters that count
KINDS = {
    "assign": (ASSIGN, "secret", 8, None),
    "access": (ACCESS, "identifier", 16, None),
    "hex": (HEX, "secret", 32, None),
    "short": (ASSIGN, "secret", 4, 7),
    "key_id": (KEY_ID, "identifier", 8, None),
    "login": (LOGIN, "identifier", 1, None),
    "mixed": (MIXED, "secret", 20, None),
    "endpoint": (ENDPOINT, "endpoint", 1, None),
}
MIXED_CLASSES = ("[A-Z]", "[a-z]", "[0-9]")


def _pieces(text: Column, pattern: str, kinds: list[str], scan: int) -> Column:
    """All matches of a pattern in order: how long the text before each is, its own length, and the kind it is (or null)."""
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(2 if pattern == ASSIGN else 0))

    def kind(match: Column, value: Column) -> Column:
        out = F.lit(None).cast("int")
        for name in kinds:
            _, _, least, most = KINDS[name]
            fits = F.length(value) >= least
            if most:
                fits &= F.length(value) <= most
            if name == "key_id":  # not a base span
                fits &= ~(match.startswith("AKIA") & (F.length(match) >= KINDS["access"][2]))
            if name == "mixed":
                for c in MIXED_CLASSES:
                    fits &= match.rlike(c)
            out = F.when(fits, list(KINDS).index(name)).otherwise(out)
        return out

    def entries(matches: Column) -> Column:
        def with_gaps(parts: Column) -> Column:
            gaps, values = parts["gaps"], parts["values"]
            return F.transform(matches, lambda m, i: F.struct(F.lit(scan).alias("scan"), i.alias("at"), F.length(F.get(gaps, i)).alias("gap"), F.length(m).alias("size"), kind(m, F.get(values, i)).alias("kind")))

        split = F.struct(F.split(text, pattern, -1).alias("gaps"), (counted if pattern == ASSIGN else matches).alias("values"))
        return F.when(F.size(matches) > 0, let(split, with_gaps)).otherwise(F.array().cast("array<struct<scan:int,at:int,gap:int,size:int,kind:int>>"))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), entries)


def spans(docs: DataFrame) -> DataFrame:
    """Base and reported spans: row (a number of the row), doc_id, kind, start, end; rows without any have one of nulls."""
    text = F.coalesce("text", F.lit(""))
    patterns: dict[str, list[str]] = {}
    for name, (pattern, *_) in KINDS.items():
        patterns.setdefault(pattern, []).append(name)
    found = F.concat(*[_pieces(text, p, kinds, k) for k, (p, kinds) in enumerate(patterns.items())])
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))  # before a text makes many rows
    rows = numbered.select("doc_id", "row", F.inline_outer(found)).repartition("row")
    run = Window.partitionBy("row", "scan").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(run)).withColumn("start", F.col("end") - F.col("size"))
    names = F.array(*map(F.lit, KINDS))
    parts = F.array(*[F.lit(part) for _, part, _, _ in KINDS.values()])
    rows = rows.withColumns({"base": F.col("kind") < len(BASE), "part": F.get(parts, F.col("kind")), "name": F.get(names, F.col("kind"))})
    # equal starts count on both sides: the default frame takes the rows that order alike
    before, after = Window.partitionBy("row").orderBy("start"), Window.partitionBy("row").orderBy(F.col("start").desc())
    rows = rows.withColumn("inside", F.max(F.when(F.col("base"), F.col("end"))).over(before) >= F.col("end"))
    rows = rows.withColumn("counts", F.col("kind").isNotNull() & (F.col("base") | ~F.coalesce("inside", F.lit(False))))

    def near(part: str, base: bool) -> Column:
        which = F.col("counts") & (F.col("part") == part) & (F.col("base") if base else F.lit(True))
        reaches = F.max(F.when(which, F.col("end"))).over(before) >= F.col("start") - SCOPE
        begins = F.min(F.when(which, F.col("start"))).over(after) <= F.col("end") + SCOPE
        return F.coalesce(reaches, F.lit(False)) | F.coalesce(begins, F.lit(False))

    rows = rows.withColumns({"by_id": near("identifier", True), "by_secret": near("secret", True), "any_id": near("identifier", False), "any_secret": near("secret", False), "any_end": near("endpoint", False)})
    linked = (
        F.when(F.col("part") == "identifier", F.col("by_secret") | (F.col("any_secret") & F.col("any_end")))
        .when(F.col("part") == "secret", F.col("by_id") | (F.col("any_id") & F.col("any_end")))
        .otherwise(F.col("any_id") & F.col("any_secret"))
    )
    reported = F.col("counts") & (F.col("base") | linked)
    return rows.select("row", "doc_id", *[F.when(reported, F.col(c)).alias(c) for c in ("kind", "name", "start", "end", "base")])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row for each document: counts of base spans, the digest of their places, and the places of all reported spans."""
    label = F.concat_ws(":", "name", "start", "end")

    def places(which: Column) -> Column:
        entries = F.collect_list(F.when(which, F.struct("start", "kind", label.alias("label"))))
        return F.array_join(F.transform(F.sort_array(entries), lambda x: x["label"]), ",")

    counts = [F.count_if(F.col("name") == name).alias(f"n_{name}") for name in BASE]
    by_row = spans(docs).groupBy("row", "doc_id").agg(*counts, places(F.col("base")).alias("places"), places(F.col("kind").isNotNull()).alias("spans"))
    return by_row.select("doc_id", *[f"n_{name}" for name in BASE], F.sha2(F.col("places").cast("binary"), 256).alias("base_sha256"), "spans")


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def _sql() -> str:
    quoted = lambda s: s.replace("'", "''")
    found = []
    for k, (name, (pattern, part, least, most)) in enumerate(KINDS.items()):
        fits = f"length(value) >= {least}" + (f" AND length(value) <= {most}" if most else "")
        fits += f" AND NOT (starts_with(match, 'AKIA') AND length(match) >= {KINDS['access'][2]})" if name == "key_id" else ""
        fits += "".join(f" AND regexp_matches(match, '{c}')" for c in MIXED_CLASSES) if name == "mixed" else ""
        found.append(f"""
  SELECT r, {k} AS kind, '{name}' AS name, '{part}' AS part, {str(name in BASE).lower()} AS base, "end" - length(match) AS start, "end" FROM (
    SELECT r, match, value, sum(length(gap) + length(match)) OVER (PARTITION BY r ORDER BY nth) AS "end" FROM (
      SELECT r, unnest(m) AS match, unnest(v) AS value, unnest(g[:len(m)]) AS gap, unnest(range(len(m))) AS nth FROM (
        SELECT r, regexp_extract_all(text, '{quoted(pattern)}') AS m, regexp_extract_all(text, '{quoted(pattern)}', {2 if pattern == ASSIGN else 0}) AS v,
          string_split_regex(text, '{quoted(pattern)}') AS g FROM d)))
  WHERE {fits}""")
    near = lambda part, base=False: f"""EXISTS (FROM parts x WHERE x.r = p.r AND x.part = '{part}'{" AND x.base" if base else ""} AND x."end" >= p.start - {SCOPE} AND x.start <= p."end" + {SCOPE})"""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(found)}
), parts AS (
  SELECT * FROM found f WHERE base OR NOT EXISTS (FROM found x WHERE x.r = f.r AND x.base AND x.start <= f.start AND x."end" >= f."end")
), reported AS (
  SELECT r, kind, name, start, base, name || ':' || start || ':' || "end" AS label FROM parts p WHERE base OR CASE part
    WHEN 'identifier' THEN {near("secret", True)} OR ({near("secret")} AND {near("endpoint")})
    WHEN 'secret' THEN {near("identifier", True)} OR ({near("identifier")} AND {near("endpoint")})
    ELSE {near("identifier")} AND {near("secret")} END
), rows AS (
  SELECT r, {", ".join(f"count(*) FILTER (name = '{n}') AS n_{n}" for n in BASE)},
    string_agg(label, ',' ORDER BY start, kind) FILTER (base) AS places, string_agg(label, ',' ORDER BY start, kind) AS spans
  FROM reported GROUP BY r
)
SELECT doc_id, {", ".join(f"coalesce(n_{n}, 0) AS n_{n}" for n in BASE)}, sha256(coalesce(places, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN rows USING (r)
"""


OP12_SQL = _sql()
