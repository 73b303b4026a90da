"""Schema compiler: textual graph schemas in three formats to typed property-graph definitions.

The text is read by all three readers (JSON only where it looks like JSON); each gives facts, and folding the facts in order
gives the schema. This module reads one text at a time, for the judge; `schema_native` says the same as column expressions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: types, the DDL of a schema without content, and what the formats look like
TYPES = {
    "STRING": "STRING",
    "INTEGER": "INT64",
    "INT": "INT64",
    "INT64": "INT64",
    "FLOAT": "DOUBLE",
    "DOUBLE": "DOUBLE",
    "BOOLEAN": "BOOL",
    "BOOL": "BOOL",
    "DATE": "DATE",
    "DATETIME": "TIMESTAMP",
    "LIST": "STRING",
}
TRIVIAL_DDL = "CREATE NODE TABLE Any(id INT64, PRIMARY KEY (id));"
BOLD_LABEL = r"\*\*([A-Za-z_][A-Za-z0-9_]*)\*\*"
TICKED_PROPERTY = r"`([A-Za-z_][A-Za-z0-9_]*)`\s*[:\-]\s*([A-Z]+)"
RELATIONSHIP_HEADER = r"(?i)relationships?:|relationship properties:"
ARROW = r"\(\s*:?\s*([A-Za-z_][A-Za-z0-9_]*)?\s*\)\s*-\s*\[\s*:?\s*([A-Za-z_][A-Za-z0-9_]*)\s*\]\s*-\s*>?\s*\(\s*:?\s*([A-Za-z_][A-Za-z0-9_]*)?\s*\)"
BLOCK = r"^\s*([A-Za-z_][A-Za-z0-9_]*)\s*\{([^}]+)\}\s*$"
BLOCK_PROPERTY = r"([A-Za-z_][A-Za-z0-9_]*)\s*:\s*([A-Za-z_]+)"
BLOCK_RELATION = (
    r"\{\s*['\"]?start['\"]?\s*:\s*([A-Za-z_][A-Za-z0-9_]*)\s*,\s*['\"]?type['\"]?\s*:\s*([A-Za-z_][A-Za-z0-9_]*)\s*,\s*['\"]?end['\"]?\s*:\s*([A-Za-z_][A-Za-z0-9_]*)\s*\}"
)


class GraphSchema:
    """Node labels with their properties, and relationships by (type, start, end); both in order of appearance."""

    def __init__(self):
        self.nodes: dict[str, dict[str, str]] = {}
        self.rels: dict[tuple[str, str, str], dict[str, str]] = {}

    def labels(self) -> list[str]:
        return sorted({*self.nodes, *(end for key in self.rels for end in key[1:])}) or ["Any"]

    def ddl(self) -> str:
        typed = lambda props: [f"{name} {TYPES.get(kind.upper(), 'STRING')}" for name, kind in props.items()]
        made = [f"CREATE NODE TABLE {label}({', '.join(['id INT64', *typed(self.nodes.get(label, {})), 'PRIMARY KEY (id)'])});" for label in self.labels()]
        made += [f"CREATE REL TABLE {kind}({', '.join([f'FROM {start} TO {end}', *typed(props)])});" for (kind, start, end), props in self.rels.items()]
        return "\n".join(made)


def clean_label(text: str) -> str:
    return re.sub(r"[^A-Za-z0-9_]", "_", text.strip()) or "Any"


def _properties(info: dict) -> dict[str, str]:
    props = info.get("properties")
    return {name: str(p.get("type", "STRING")) for name, p in props.items() if isinstance(p, dict)} if isinstance(props, dict) else {}


def _endpoint(info: dict, *keys: str) -> str:
    """The first item of the last of the keys that holds a list."""
    found = [info[k][0] for k in keys if isinstance(info.get(k), list) and info[k]]
    return clean_label(str(found[-1])) if found else "Any"


def _from_json(text: str) -> Iterator[tuple]:
    if not (text.startswith("{") and text.endswith("}")):
        return
    try:
        entries = json.loads(text)
    except ValueError:
        return
    nodes = {}  # of two keys that give one label, the later entry counts alone
    for key, info in entries.items():
        if not isinstance(info, dict):
            continue
        if info.get("type", "node") == "relationship":
            yield "rel", (clean_label(key), _endpoint(info, "from", "start"), _endpoint(info, "to", "end")), _properties(info)
        else:
            nodes[clean_label(key)] = _properties(info)
    for label, props in nodes.items():
        yield "node", label, props


def _from_markdown(text: str) -> Iterator[tuple]:
    marks = list(re.finditer(BOLD_LABEL, text))
    ends = [m.start() for m in marks[1:]] + [len(text)]
    for mark, end in zip(marks, ends, strict=False):
        body = re.split(RELATIONSHIP_HEADER, text[mark.end() : end], maxsplit=1)[0]
        yield "node", mark[1], dict(re.findall(TICKED_PROPERTY, body))
    for start, kind, end in re.findall(ARROW, text):
        yield "rel", (kind, start or "Any", end or "Any"), {}


def _from_blocks(text: str) -> Iterator[tuple]:
    rels = [(kind, start, end) for start, kind, end in re.findall(BLOCK_RELATION, text)]
    of_rel: dict[str, dict[str, str]] = {kind: {} for kind, _, _ in rels}
    for label, body in re.findall(BLOCK, text, re.M):
        props = dict(re.findall(BLOCK_PROPERTY, body))
        if label in of_rel:
            of_rel[label].update(props)
        elif props:
            yield "node", label, props
    for key in rels:
        yield "rel", key, of_rel[key[0]]


def read_schema(text: str | None) -> GraphSchema:
    schema = GraphSchema()
    text = text.strip() if isinstance(text, str) else ""
    for reader in (_from_json, _from_markdown, _from_blocks):
        for what, key, props in reader(text):
            if what == "node":
                schema.nodes.setdefault(key, {}).update(props)
            else:
                schema.rels.setdefault(key, props)
    return schema


def compile_schema(text: str | None) -> str:
    """The DDL of one schema text; TRIVIAL_DDL where nothing can be read from it."""
    return read_schema(text).ddl()


def is_trivial(ddl: Column) -> Column:
    return F.trim(ddl) == F.lit(TRIVIAL_DDL)


def parse_rate(ddl: DataFrame, column: str = "ddl") -> DataFrame:
    """total, trivial and non_trivial_rate of a column of DDLs."""
    n, trivial = F.count(F.lit(1)), F.count_if(is_trivial(F.col(column)))
    return ddl.agg(n.alias("total"), trivial.alias("trivial"), ((n - trivial) / F.greatest(n, F.lit(1))).alias("non_trivial_rate"))


# --- the parts that column expressions can say


def arrow_relationships(text: Column) -> Column:
    """Array of (type, src, dst) of the arrows in a text."""
    part = lambda k: F.regexp_extract_all(text, F.lit(ARROW), k)
    named = lambda c: F.when(c == "", "Any").otherwise(c)
    return F.transform(F.arrays_zip(part(2).alias("type"), part(1).alias("src"), part(3).alias("dst")), lambda r: F.struct(r["type"].alias("type"), named(r["src"]).alias("src"), named(r["dst"]).alias("dst")))


def clean_label_column(text: Column) -> Column:
    from querylens.functions.text import strip

    cleaned = F.regexp_replace(strip(text), "[^A-Za-z0-9_]", "_")
    return F.when(cleaned == "", "Any").otherwise(cleaned)


def backend_type(kind: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    return F.coalesce(F.element_at(known, F.upper(kind)), F.lit("STRING"))


def emit_node_ddl(label: Column, props: Column) -> Column:
    """DDL of a node table from its label and an array of (name, type)."""
    columns = F.transform(props, lambda p: F.concat(p["name"], F.lit(" "), backend_type(p["type"])))
    return F.concat(F.lit("CREATE NODE TABLE "), label, F.lit("("), F.array_join(F.concat(F.array(F.lit("id INT64")), columns, F.array(F.lit("PRIMARY KEY (id)"))), ", "), F.lit(");"))


def merge_properties(facts: DataFrame, label: str, name: str, kind: str, order: str) -> DataFrame:
    """One row per label and property name: the type of the last fact."""
    return facts.groupBy(label, name).agg(F.max_by(kind, order).alias(kind))


def merge_relationships(facts: DataFrame, order: str) -> DataFrame:
    """One row per (type, src, dst): the first fact's row."""
    rest = [c for c in facts.columns if c not in ("type", "src", "dst")]
    return facts.groupBy("type", "src", "dst").agg(*[F.min_by(c, order).alias(c) for c in rest])


def statements(ddl: Column) -> Column:
    """The statements of a DDL: cut at semicolons, stripped, empty ones dropped."""
    return F.filter(F.transform(F.split(ddl, ";"), lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+$", ""))), lambda s: s != "")
