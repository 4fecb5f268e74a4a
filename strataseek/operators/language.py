"""The language of direct searches, and its evaluation as joins.

    fire damage            both, in any searched field
    fire OR flood          either; OR and AND join their neighbours, AND before OR, all else is required
    NOT theft   -theft     without
    "fire damage"          one after the other, in one field
    title:fire             in this field; also title:"..." and title:(...)
    fire^2   (a OR b)^0.5  scores times the number
    thef*  *ance  in?r     patterns: * any characters, ? one
    (...)                  groups, nested

Words are read by the analyzer of the index; a word of several tokens is looked for as a phrase (pairs
of characters side by side may also come from two runs, one ending as the next begins). A word without tokens asks for
nothing, a name before a colon that is no searched field is a word, and brackets left open end with the query."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataseek.functions.analysis import query_tokens, tokens
from strataseek.functions.local import local_rows
from strataseek.operators.vocabulary import pattern_terms


@dataclass(frozen=True)
class Leaf:
    """Tokens one after the other, or a pattern, in one field or in any."""

    tokens: tuple[str, ...] = ()
    pattern: str | None = None
    field: str | None = None
    boost: float = 1.0


@dataclass(frozen=True)
class Node:
    op: str  # and, or, not
    parts: tuple[Node | Leaf, ...]


_LEX = re.compile(r'\s*(?:(?P<open>\()|(?P<close>\))|\^(?P<boost>\d+(?:\.\d+)?)|"(?P<quoted>[^"]*)"?|(?P<field>\w+):(?=[^\s)])|(?P<minus>-)(?=[\w"(*?])|(?P<word>[^\s()"^]+)|(?P<stray>\S))')


def analyzed(spark: SparkSession, words: list[str], analyze=tokens) -> list[list[str]]:
    """The tokens of each word, by the index's analyzer."""
    if not words:
        return []
    rows = local_rows(spark, list(enumerate(words)), "i int, w string").select("i", query_tokens(F.col("w"), analyze).alias("t")).collect()  # the words of one query
    by_place = {r["i"]: r["t"] for r in rows}
    return [list(by_place[i] or []) for i in range(len(words))]


class _Reader:
    def __init__(self, text: str, fields: list[str] | None, read: Callable[[list[str]], list[list[str]]]):
        self.items = [(m.lastgroup, m[m.lastgroup]) for m in _LEX.finditer(text) if m.lastgroup not in (None, "stray")]
        if fields is not None:  # a name that is no field is part of the word after it
            known: list[tuple[str, str]] = []
            for kind, x in self.items:
                if kind == "field" and x not in fields:
                    kind = "word"
                known.append((kind, x))
            self.items = known
        plain = list(dict.fromkeys(x for kind, x in self.items if kind == "quoted" or kind == "word" and not re.search(r"[*?]", x)))
        self.tokens = dict(zip(plain, read(plain), strict=True))
        self.at = 0

    def peek(self) -> tuple[str, str] | tuple[None, None]:
        return self.items[self.at] if self.at < len(self.items) else (None, None)

    def take(self, kind: str, *words: str) -> str | None:
        k, x = self.peek()
        if k == kind and (not words or x in words):
            self.at += 1
            return x
        return None

    def sequence(self, field: str | None) -> Node | Leaf | None:
        """Chains side by side, up to a closing bracket or the end; all are required."""
        parts = []
        while self.peek()[0] not in (None, "close"):
            parts.append(self.chain(field))
        return _joined("and", parts)

    def chain(self, field: str | None) -> Node | Leaf | None:
        return self._row(field, "OR", "or", lambda: self._row(field, "AND", "and", lambda: self.item(field)))

    def _row(self, field: str | None, word: str, op: str, read) -> Node | Leaf | None:
        parts = [read()]
        while self.take("word", word):
            parts.append(read())
        return _joined(op, parts)

    def item(self, field: str | None) -> Node | Leaf | None:
        if self.take("word", "NOT") or self.take("minus"):
            inner = self.item(field)
            return inner and Node("not", (inner,))
        found: Node | Leaf | None = None
        if own := self.take("field"):
            found = self.item(own)
        elif self.take("open"):
            found = self.sequence(field)
            self.take("close")
        else:
            kind, x = self.peek()
            if kind in (None, "close"):
                return None
            self.at += 1
            if kind == "word" and re.search(r"[*?]", x):
                found = Leaf(pattern=x.lower(), field=field)
            elif (kind == "quoted" or kind == "word" and x not in ("AND", "OR")) and self.tokens.get(x):
                found = Leaf(tuple(self.tokens[x]), field=field)
        if boost := self.take("boost"):
            found = _boosted(found, float(boost))
        return found


def _joined(op: str, parts: list) -> Node | Leaf | None:
    parts = [p for p in parts if p is not None]
    return Node(op, tuple(parts)) if len(parts) > 1 else parts[0] if parts else None


def _boosted(tree: Node | Leaf | None, by: float) -> Node | Leaf | None:
    if isinstance(tree, Leaf):
        return replace(tree, boost=tree.boost * by)
    return tree and Node(tree.op, tuple(_boosted(p, by) for p in tree.parts))


def parse(text: str, spark: SparkSession, fields: list[str] | None = None, analyze=tokens) -> Node | Leaf | None:
    """The tree of a query; None if it asks for nothing. fields: names that may stand before a colon."""
    reader = _Reader(text, fields, lambda words: analyzed(spark, words, analyze))
    parts = []
    while reader.peek()[0] is not None:
        parts.append(reader.sequence(None))
        reader.take("close")  # one too many
    return _joined("and", parts)


def leaves(tree: Node | Leaf | None, wanted: bool = True) -> list[tuple[Leaf, bool]]:
    """The leaves from left to right, and whether each is wanted rather than excluded."""
    if tree is None:
        return []
    if isinstance(tree, Leaf):
        return [(tree, wanted)]
    return [x for p in tree.parts for x in leaves(p, wanted != (tree.op == "not"))]


def _condition(tree: Node | Leaf, flags: list) -> Column | bool:
    """The tree over its leaves' flags, which are used up from the left; columns or plain truth values."""
    if isinstance(tree, Leaf):
        return flags.pop(0)
    parts = [_condition(p, flags) for p in tree.parts]
    if tree.op == "not":
        return ~parts[0] if isinstance(parts[0], Column) else not parts[0]
    if isinstance(parts[0], Column):
        return reduce((lambda a, b: a & b) if tree.op == "and" else (lambda a, b: a | b), parts)
    return all(parts) if tree.op == "and" else any(parts)


def needs_places(tree: Node | Leaf | None) -> bool:
    return any(len(leaf.tokens) > 1 for leaf, _ in leaves(tree))


def asked_terms(tree: Node | Leaf | None, fields: list[str], vocabulary: DataFrame, gram_table: DataFrame | None = None) -> DataFrame:
    """(leaf, field, term, boost, wanted, phrase): the terms of each leaf in each of its fields, patterns as the vocabulary's terms."""
    spark = vocabulary.sparkSession
    every = list(enumerate(leaves(tree)))
    rows = [(i, f, t, leaf.boost, wanted, len(leaf.tokens) > 1) for i, (leaf, wanted) in every for f in ([leaf.field] if leaf.field else fields) for t in dict.fromkeys(leaf.tokens)]
    out = local_rows(spark, rows, "leaf int, field string, term string, boost double, wanted boolean, phrase boolean")
    for i, (leaf, wanted) in every:
        if leaf.pattern is not None:
            found = pattern_terms(leaf.pattern, vocabulary, gram_table, [leaf.field] if leaf.field else fields)
            out = out.unionByName(found.select(F.lit(i).alias("leaf"), "field", "term", F.lit(leaf.boost).alias("boost"), F.lit(wanted).alias("wanted"), F.lit(False).alias("phrase")))
    return out


def phrase_units(places: DataFrame, phrase: tuple[str, ...]) -> DataFrame:
    """places (field, unit, term, positions) -> unit, field that hold the tokens one after the other: each place, less the
    token's place in the phrase, is a start; a start that every token has is a match. Token order in the text decides."""
    at = F.create_map(*[F.lit(x) for t in dict.fromkeys(phrase) for x in (t, ",".join(str(i) for i, u in enumerate(phrase) if u == t))])
    hits = places.where(F.col("term").isin(*set(phrase))).withColumn("i", F.explode(F.split(at[F.col("term")], ","))).withColumn("p", F.explode("positions"))
    starts = hits.groupBy("field", "unit", (F.col("p") - F.col("i").cast("int")).alias("start")).agg(F.countDistinct("i").alias("n"))
    return starts.where(F.col("n") == len(phrase)).select("unit", "field").distinct()


def satisfying(tree: Node | Leaf | None, terms: DataFrame, post: DataFrame, every: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """(unit, n_hits): the units that satisfy the tree; n_hits counts its wanted leaves found. terms: as asked_terms; post and
    places: of the asked terms; every (unit): all units, read only where a unit without any leaf satisfies the tree, as for NOT.

    Each leaf's hits carry its number; one aggregation by unit turns them to flags, over which the tree is a condition. Without
    places, a phrase asks for all of its words."""
    own = leaves(tree)
    if tree is None:
        return every.select("unit", F.lit(0).alias("n_hits"))
    phrases = [(i, leaf) for i, (leaf, _) in enumerate(own) if len(leaf.tokens) > 1]
    single = terms.where("not phrase").select("leaf", "field", "term")
    if all(leaf.pattern is None for leaf, _ in own):
        single = F.broadcast(single)  # the words of one query; a pattern may stand for any number of terms
    hits = post.join(single, ["field", "term"]).select("unit", "leaf")
    for i, leaf in phrases:
        if places is not None:
            at = phrase_units(places.where(F.col("field") == leaf.field) if leaf.field else places, leaf.tokens)
        else:
            some = post.where(F.col("field") == leaf.field) if leaf.field else post
            at = some.where(F.col("term").isin(*leaf.tokens)).groupBy("unit").agg(F.countDistinct("term").alias("n")).where(F.col("n") == len(set(leaf.tokens)))
        hits = hits.unionByName(at.select("unit", F.lit(i).alias("leaf")))
    if _condition(tree, [False] * len(own)):
        hits = hits.unionByName(every.select("unit", F.lit(-1).alias("leaf")))
    flags = hits.groupBy("unit").agg(*[F.max(F.col("leaf") == i).alias(f"h{i}") for i in range(len(own))])
    found = flags.where(_condition(tree, [F.col(f"h{i}") for i in range(len(own))]))
    n = reduce(lambda a, b: a + b, [F.col(f"h{i}").cast("int") for i, (_, wanted) in enumerate(own) if wanted], F.lit(0))
    return found.select("unit", n.alias("n_hits"))
