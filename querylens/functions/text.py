"""Row scorers and text helpers as column expressions: query extraction, exact match, BLEU-4, penalties, prompts.

White space means what Python's str.strip() and \\s mean for text, spelled out because Java's \\s knows ASCII only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# fixed values: the block that holds a query, the words a query can start with, and the prompt
FENCE = rf"(?is)```(?:cypher)?[{SPACE}]*(.+?)```"
KEYWORD = rf"(?is)\b(?:MATCH|OPTIONAL[{SPACE}]+MATCH|CREATE|MERGE|CALL|RETURN|WITH)\b.*"
PROMPT = "You are a Cypher expert. Given the schema and question, return only the Cypher query.\n\nSchema:\n{schema}\n\nQuestion: {question}\n\nCypher:\n"
STRING_LITERAL = r"'[^']*'|\"[^\"]*\""
NO_MATCH_COUNT = 0.1  # what an n-gram order without a match counts as


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def extract_fenced(completion: Column) -> Column:
    """The first fenced block, stripped; null where there is none."""
    return F.when(completion.rlike(FENCE), strip(F.regexp_extract(completion, FENCE, 1)))


def extract_keyword(completion: Column) -> Column:
    """From the first word that can start a query to the end, stripped; null where there is none."""
    return F.when(completion.rlike(KEYWORD), strip(F.regexp_extract(completion, KEYWORD, 0)))


def extract_query(completion: Column) -> Column:
    """Fenced block, else from the first keyword, else the whole text; a null is the empty string."""
    text = F.coalesce(completion, F.lit(""))
    return F.coalesce(extract_fenced(text), extract_keyword(text), strip(text))


def normalize_query(query: Column) -> Column:
    """For exact match: stripped, one run of trailing semicolons dropped, single spaces, all in lower case."""
    bare = strip(F.regexp_replace(strip(F.coalesce(query, F.lit(""))), ";+$", ""))
    return F.lower(F.regexp_replace(bare, rf"[{SPACE}]+", " "))


def exact_match(pred: Column, gold: Column) -> Column:
    return (normalize_query(pred) == normalize_query(gold)).cast("int")


def words(text: Column) -> Column:
    bare = strip(F.coalesce(text, F.lit("")))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, rf"[{SPACE}]+"))


def bleu4(gold: Column, pred: Column) -> Column:
    """Sentence BLEU-4 over white-space words, equal weights, NO_MATCH_COUNT for orders without a match, brevity penalty.

    0 without words in `pred` or without a common word.
    """
    return let(F.struct(words(gold).alias("ref"), words(pred).alias("hyp")), _bleu4_of_words)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _numbered_grams(w: Column, n: int) -> Column:
    """The n-grams of an array of words, each with the number of equal ones before it, so that they form a set."""
    some = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), "\x01"))
    grams = F.when(F.size(w) >= n, F.array_sort(some)).otherwise(F.array().cast("array<string>"))
    return let(grams, lambda a: F.transform(a, lambda g, i: F.concat(g, F.lit("\x02"), (i - F.array_position(a, g)).cast("string"))))


def _bleu4_of_words(s: Column) -> Column:
    n_ref, n_hyp = F.size(s["ref"]), F.size(s["hyp"])
    # equal grams meet in pairs, so the common set has the clipped number of matches
    hits = F.struct(*[F.size(F.array_intersect(_numbered_grams(s["hyp"], n), _numbered_grams(s["ref"], n))).cast("double").alias(f"m{n}") for n in range(1, 5)])

    def score(m: Column) -> Column:
        logs = [F.ln(F.when(m[f"m{n}"] == 0, F.lit(NO_MATCH_COUNT)).otherwise(m[f"m{n}"]) / F.greatest(F.lit(1), n_hyp - n + 1)) for n in range(1, 5)]
        penalty = F.when(n_hyp > n_ref, 1.0).otherwise(F.exp(1 - n_ref / n_hyp))
        return F.when((n_hyp == 0) | (m["m1"] == 0), 0.0).otherwise(penalty * F.exp(sum(logs[1:], logs[0]) / 4))

    return let(hits, score)


def length_penalty(n_tokens: Column, target: int = 256) -> Column:
    """0 up to the target, then falling to -0.5 at twice the target; a null counts as no tokens."""
    n = F.coalesce(n_tokens, F.lit(0))
    return F.when(n <= target, 0.0).otherwise(-0.5 * F.least((n - target) / F.lit(float(max(target, 1))), F.lit(1.0)))


def prompt(schema: Column, question: Column, template: str = PROMPT) -> Column:
    """The template with both values put in; braces inside the values stay as they are."""
    marks = [(template.index(m), m, c) for m, c in (("{schema}", schema), ("{question}", question)) if m in template]
    parts, at = [], 0
    for start, mark, value in sorted(marks, key=lambda x: x[0]):
        parts += [F.lit(template[at:start]), F.coalesce(value, F.lit("None"))]
        at = start + len(mark)
    return F.concat(*parts, F.lit(template[at:]))


def blank_strings(query: Column) -> Column:
    return F.regexp_replace(query, STRING_LITERAL, "''")


def short_error(message: Column) -> Column:
    return F.substring(message, 1, 300)


def top_level_pieces(text: Column) -> Column:
    """The text cut at commas that are in no bracket; an empty last piece is dropped."""
    zero = F.struct(F.lit(0).alias("depth"), F.lit("").alias("now"), F.array().cast("array<string>").alias("done"))

    def step(acc: Column, ch: Column) -> Column:
        cut = (ch == ",") & (acc["depth"] == 0)
        depth = F.when(ch.isin("(", "[", "{"), acc["depth"] + 1).when(ch.isin(")", "]", "}"), F.greatest(acc["depth"] - 1, F.lit(0))).otherwise(acc["depth"])
        return F.struct(depth.alias("depth"), F.when(cut, F.lit("")).otherwise(F.concat(acc["now"], ch)).alias("now"), F.when(cut, F.array_append(acc["done"], acc["now"])).otherwise(acc["done"]).alias("done"))

    return F.aggregate(F.split(F.coalesce(text, F.lit("")), ""), zero, step, lambda acc: F.when(acc["now"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["now"])))
