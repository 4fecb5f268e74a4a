"""Finding terms of a vocabulary without scanning it: by one edit, or by a pattern.

A vocabulary is (field, term, ...). Two key tables are made of it once and stored beside it, in key order: the strings that a
term leaves when one character is taken out (and the term itself), and its runs of GRAM characters between end marks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3
#: Marks before and after a term in its grams; no token holds them.
HEAD, TAIL = "\u0002", "\u0003"


def without_one(term: Column) -> Column:
    """array<string>: the term, and what it leaves when one character is taken out, each once."""
    cut = lambda i: F.concat(F.substring(term, F.lit(1), i - 1), F.substring(term, i + 1, F.length(term)))
    places = F.sequence(F.lit(1), F.greatest(F.length(term), F.lit(1)))
    return F.array_distinct(F.array_append(F.transform(places, cut), term))


def deletions(vocabulary: DataFrame, longest: int | None = None) -> DataFrame:
    """(field, key, term) for the terms of at most `longest` characters."""
    short = vocabulary.where(F.length("term") <= longest) if longest else vocabulary
    return short.select("field", F.explode(without_one(F.col("term"))).alias("key"), "term")


def near_terms(terms: DataFrame, keys: DataFrame, prefix: int = 1) -> DataFrame:
    """terms (field, term) -> (field, asked, term): the vocabulary's terms at edit distance 0 or 1 that share the first `prefix`
    characters. Terms one edit apart have a key in common, so this is an equi-join on keys, which are spread as evenly as the
    terms are; the distance is then held against each pair."""
    t = terms.select("field", F.col("term").alias("asked"), F.explode(without_one(F.col("term"))).alias("key"))
    ok = F.levenshtein("asked", "term", 1).between(0, 1)
    if prefix:
        ok = ok & (F.substring("asked", 1, prefix) == F.substring("term", 1, prefix))
    return t.join(keys, ["field", "key"]).where(ok).select("field", "asked", "term").distinct()


def grams(vocabulary: DataFrame) -> DataFrame:
    """(field, gram, term): each gram of a term once."""
    whole = F.concat(F.lit(HEAD), F.col("term"), F.lit(TAIL))
    starts = F.sequence(F.lit(1), F.greatest(F.length("term") + 3 - GRAM, F.lit(1)))
    return vocabulary.select("field", "term", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(whole, i, F.lit(GRAM))))).alias("gram")).select("field", "gram", "term")


def grams_of(pattern: str) -> list[str]:
    """The grams that every term of a pattern (* any characters, ? one) has."""
    parts = re.split(r"[*?]+", HEAD + pattern + TAIL)
    return sorted({p[i : i + GRAM] for p in parts for i in range(len(p) - GRAM + 1)})


def matching(pattern: str) -> Column:
    """Whether the term as a whole fits the pattern."""
    each = {"*": ".*", "?": "."}
    return F.col("term").rlike("(?s)^" + "".join(each.get(c) or re.sub(r"([^\w])", r"\\\1", c) for c in pattern) + "$")


def pattern_terms(pattern: str, vocabulary: DataFrame, gram_table: DataFrame | None = None, fields: list[str] | None = None) -> DataFrame:
    """(field, term) of the vocabulary that fit a pattern: those with all of its grams, looked up by gram, then held against the
    pattern. A pattern that is only a beginning is a range of terms; one without any gram, as *a*, is held against all terms."""
    inside = (lambda df: df.where(F.col("field").isin(fields))) if fields else lambda df: df
    found = grams_of(pattern)
    if re.fullmatch(r"[^*?]+\*", pattern):
        return inside(vocabulary).where(F.col("term").startswith(pattern[:-1])).select("field", "term")
    if gram_table is None or not found:
        return inside(vocabulary).where(matching(pattern)).select("field", "term")
    rows = inside(gram_table).where(F.col("gram").isin(found)).groupBy("field", "term").agg(F.count("*").alias("n"))
    return rows.where((F.col("n") == len(found)) & matching(pattern)).select("field", "term")
