"""The schema compiler as column expressions: a schema text to its DDL without a Python worker.

Each of the three readers turns a text into arrays of facts, in the text's order: nodes (label, properties) and relationships
(type, start, end, properties). Folding them in order gives the DDL: a property keeps the place where it came first and the
type that came last, a relationship the properties of its first fact. A schema text is small, so its facts are arrays of its
row and nothing is shuffled.

It gives what `schema.compile_schema` gives, which tests hold it against. JSON is read by Spark's reader: of a key that comes twice in
one object the last entry counts there as well; of several objects in a row the first is read; endpoints that are neither
strings nor numbers are named by their JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylens.functions.text import strip
from querylens.operators import schema as sc
from querylens.plans.checkpoints import checkpointed

BROADCAST_TEXTS, BROADCAST_CHARS = 20_000, 32_000_000  # of the compiled texts that are broadcast
PROPS = "array<struct<name:string,type:string>>"
NODES = f"array<struct<label:string,props:{PROPS}>>"
RELS = f"array<struct<type:string,src:string,dst:string,props:{PROPS}>>"
_UNICODE = "(?U)"  # white space is that of Unicode


def _all(text: Column, pattern: str, *groups: int) -> list[Column]:
    return [F.regexp_extract_all(text, F.lit(_UNICODE + pattern), F.lit(g)) for g in groups]


def _let(value: Column, body) -> Column:
    """body(value) with the value worked out once."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda known, _: known, body)


def _pairs(text: Column, pattern: str) -> Column:
    names, types = _all(text, pattern, 1, 2)
    return F.transform(F.arrays_zip(names.alias("name"), types.alias("type")), lambda p: F.struct(p["name"].alias("name"), p["type"].alias("type")))


def _object(text: Column) -> Column:
    """Keys and raw values of a JSON object in order; null if it is none."""
    return F.when(strip(text).startswith("{"), F.map_entries(F.from_json(text, "map<string,string>", {"mode": "PERMISSIVE"})))


def _last_of_key(entries: Column) -> Column:
    """A key keeps its first place and its last value."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"].alias("value")))


def _json_properties(text: Column) -> Column:
    entries = F.filter(_let(F.coalesce(_object(text), F.array().cast("array<struct<key:string,value:string>>")), _last_of_key), lambda e: strip(e["value"]).startswith("{"))
    return F.transform(entries, lambda e: F.struct(e["key"].alias("name"), F.coalesce(F.get_json_object(e["value"], "$.type"), F.lit("STRING")).alias("type")))


def _endpoint(info: Column, first: str, second: str) -> Column:
    """The first item of the last of two keys that holds a list."""
    items = [F.when(strip(info[k]).startswith("["), F.get(F.from_json(info[k], "array<string>"), F.lit(0))) for k in (second, first)]
    return F.coalesce(*[sc.clean_label_column(x) for x in items], F.lit("Any"))


def json_facts(text: Column) -> tuple[Column, Column]:
    """Nodes and relationships of a JSON schema; of two keys that give one label, the later entry counts alone."""
    looks = text.startswith("{") & text.endswith("}")
    fields = "type string, `from` string, start string, `to` string, `end` string, properties string"
    entries = F.when(looks, _object(text))
    known = F.transform(
        F.filter(F.coalesce(_let(entries, _last_of_key), F.array().cast("array<struct<key:string,value:string>>")), lambda e: strip(e["value"]).startswith("{")),
        lambda e: F.struct(sc.clean_label_column(e["key"]).alias("label"), F.from_json(e["value"], fields).alias("info")),
    )
    relationship = lambda e: F.coalesce(e["info"]["type"], F.lit("node")) == "relationship"
    nodes = F.transform(F.filter(known, lambda e: ~relationship(e)), lambda e: F.struct(e["label"].alias("label"), _json_properties(e["info"]["properties"]).alias("props")))
    places = lambda all_: F.transform(F.array_distinct(F.transform(all_, lambda n: n["label"])), lambda x: F.element_at(F.filter(all_, lambda n: n["label"] == x), -1))
    rels = F.transform(
        F.filter(known, relationship),
        lambda e: F.struct(e["label"].alias("type"), _endpoint(e["info"], "from", "start").alias("src"), _endpoint(e["info"], "to", "end").alias("dst"), _json_properties(e["info"]["properties"]).alias("props")),
    )
    return _let(nodes, places), rels


def markdown_facts(text: Column) -> tuple[Column, Column]:
    (labels,) = _all(text, sc.BOLD_LABEL, 1)
    bodies = F.split(text, sc.BOLD_LABEL, -1)
    listed = lambda b: _pairs(F.get(F.split(b, _UNICODE + sc.RELATIONSHIP_HEADER, 2), F.lit(0)), sc.TICKED_PROPERTY)
    nodes = _let(F.struct(labels.alias("labels"), bodies.alias("bodies")), lambda m: F.transform(m["labels"], lambda x, i: F.struct(x.alias("label"), listed(F.get(m["bodies"], i + 1)).alias("props"))))
    starts, kinds, ends = _all(text, sc.ARROW, 1, 2, 3)
    named = lambda c: F.when(c == "", "Any").otherwise(c)
    arrows = F.arrays_zip(kinds.alias("type"), starts.alias("src"), ends.alias("dst"))
    return nodes, F.transform(arrows, lambda a: F.struct(a["type"].alias("type"), named(a["src"]).alias("src"), named(a["dst"]).alias("dst"), F.array().cast(PROPS).alias("props")))


def block_facts(text: Column) -> tuple[Column, Column]:
    """Blocks named like a relationship's type give its properties, others are nodes if they have any."""
    starts, kinds, ends = _all(text, sc.BLOCK_RELATION, 1, 2, 3)
    labels, bodies = _all(text, "(?md)" + sc.BLOCK, 1, 2)
    blocks = F.transform(F.arrays_zip(labels.alias("label"), bodies.alias("body")), lambda b: F.struct(b["label"].alias("label"), _pairs(b["body"], sc.BLOCK_PROPERTY).alias("props")))

    def split(x: Column) -> Column:
        nodes = F.filter(x["blocks"], lambda b: ~F.array_contains(x["kinds"], b["label"]) & (F.size(b["props"]) > 0))
        zipped = F.arrays_zip(x["kinds"].alias("type"), x["starts"].alias("src"), x["ends"].alias("dst"))
        mine = lambda kind: F.flatten(F.transform(F.filter(x["blocks"], lambda b: b["label"] == kind), lambda b: b["props"]))
        return F.struct(nodes.alias("nodes"), F.transform(zipped, lambda r: F.struct(r["type"].alias("type"), r["src"].alias("src"), r["dst"].alias("dst"), mine(r["type"]).alias("props"))).alias("rels"))

    both = _let(F.struct(blocks.alias("blocks"), kinds.alias("kinds"), starts.alias("starts"), ends.alias("ends")), split)
    return both["nodes"], both["rels"]


def _columns(props: Column) -> Column:
    """`name TYPE` of each property: where it came first, as it was typed last."""

    def fold(all_: Column) -> Column:
        names = F.array_distinct(F.transform(all_, lambda p: p["name"]))
        return F.transform(names, lambda n: F.concat(n, F.lit(" "), sc.backend_type(F.element_at(F.filter(all_, lambda p: p["name"] == n), -1)["type"])))

    return _let(props, fold)


def ddl_of(text: Column) -> Column:
    """The DDL of a schema text; the trivial one where nothing can be read from it, or for null."""

    def folded(facts: Column) -> Column:
        nodes, rels = facts["nodes"], facts["rels"]
        named = F.array_sort(F.array_distinct(F.concat(_field(nodes, "label"), _field(rels, "src"), _field(rels, "dst"))))
        labels = F.when(F.size(named) > 0, named).otherwise(F.array(F.lit("Any")))
        of = lambda label: F.flatten(F.transform(F.filter(nodes, lambda n: n["label"] == label), lambda n: n["props"]))
        tables = F.transform(labels, lambda x: F.concat(F.lit("CREATE NODE TABLE "), x, F.lit("("), F.array_join(F.concat(F.array(F.lit("id INT64")), _columns(of(x)), F.array(F.lit("PRIMARY KEY (id)"))), ", "), F.lit(");")))
        keys = F.array_distinct(F.transform(rels, lambda r: F.struct(r["type"].alias("type"), r["src"].alias("src"), r["dst"].alias("dst"))))
        first = lambda k: F.get(F.filter(rels, lambda r: (r["type"] == k["type"]) & (r["src"] == k["src"]) & (r["dst"] == k["dst"])), F.lit(0))["props"]
        ends = lambda k: F.array(F.concat(F.lit("FROM "), k["src"], F.lit(" TO "), k["dst"]))
        edges = F.transform(keys, lambda k: F.concat(F.lit("CREATE REL TABLE "), k["type"], F.lit("("), F.array_join(F.concat(ends(k), _columns(first(k))), ", "), F.lit(");")))
        return F.array_join(F.concat(tables, edges), "\n")

    def read(t: Column) -> Column:
        parts = [json_facts(t), markdown_facts(t), block_facts(t)]
        nodes = F.concat(*[F.coalesce(n.cast(NODES), F.array().cast(NODES)) for n, _ in parts])
        rels = F.concat(*[F.coalesce(r.cast(RELS), F.array().cast(RELS)) for _, r in parts])
        return _let(F.struct(nodes.alias("nodes"), rels.alias("rels")), folded)

    return _let(strip(F.coalesce(text, F.lit(""))), read)


def _field(items: Column, name: str) -> Column:
    return F.transform(items, lambda x: x[name])


def compile_column(df: DataFrame, schema: str = "schema", out: str = "ddl") -> DataFrame:
    """Add the DDL of each row's schema text, compiling each distinct text once. A null text gives the trivial DDL.

    Rows meet the compiled texts by a digest and the text; few texts are broadcast, so that a text that most rows share
    gathers no rows in a task.
    """
    text = F.coalesce(F.col(schema), F.lit(""))
    texts = df.select(text.alias("__text")).distinct()
    compiled = checkpointed(texts.select(F.xxhash64("__text").alias("__key"), "__text", ddl_of(F.col("__text")).alias(out)))
    size = compiled.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("__text") + F.length(out)).alias("chars")).first()
    side = F.broadcast(compiled) if size.n <= BROADCAST_TEXTS and (size.chars or 0) <= BROADCAST_CHARS else compiled
    return df.join(side, (F.xxhash64(text) == F.col("__key")) & (text == F.col("__text")), "left").drop("__key", "__text")
