"""Query algebra over postings: terms, fuzzy terms, match methods, filters, BM25, channels, fusion, neighbours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataseek.functions.analysis import query_tokens, tokens
from strataseek.functions.local import local_rows
from strataseek.operators import language
from strataseek.operators.vocabulary import deletions, near_terms

# Scoring parameters, boosts, limits and the fields of each channel.
K1, B = 1.2, 0.75
FUZZY_BOOST = {"exact_then_fuzzy": 0.6, "fuzzy": 0.5}
FUZZY_LENGTH, FREE_TEXT_BOOST, LEAST_SCORE = 4, 0.3, 0.01
CHANNEL_FIELDS = {"title": ["section_title", "section_path"], "content": ["content"], "entity": ["name", "desc"], "relation": ["subject", "predicate", "object"], "meta": ["insurer", "contract_name"]}
CHANNEL_LIMIT = {"title": 20, "content": 20, "entity": 10000, "relation": 10000, "meta": 10000}
#: Up to so many distinct asked terms, postings are read by term (pushed to the files); beyond, they are joined.
MOST_TERMS = 2000
#: Up to so many asked terms, each query's own, with their statistics go to every task that reads postings; beyond, they are joined.
MOST_ASKED = 200_000
#: Matches (a query's term in a unit) that one task scores, about.
MATCHES = 2_000_000
#: Names that schemas use for channel fields, followed only on request.
ALIASES = {"entity_name": "name", "entity_names": "name", "relation_predicates": "predicate"}


def field_terms(fields: DataFrame, alias_targets: bool = False, analyze=tokens) -> DataFrame:
    """fields (query_id, value, target, match_method, weight) -> (query_id, channel, field, term, kind, boost).

    Null values and targets outside every channel fall out; each token is an exact term at its weight, and for the fuzzy
    methods, up to FUZZY_LENGTH characters, a fuzzy one as well."""
    spark = fields.sparkSession
    if alias_targets:
        fields = fields.replace(ALIASES, subset=["target"])
    places = local_rows(spark, [(c, f) for c, fs in CHANNEL_FIELDS.items() for f in fs], "channel string, field string")
    t = fields.where("value is not null").join(F.broadcast(places), F.col("target") == F.col("field")).withColumn("term", F.explode(query_tokens(F.col("value"), analyze)))
    fuzzy = reduce(lambda c, m: c.when(F.col("match_method") == m[0], m[1]), FUZZY_BOOST.items(), F.when(F.lit(False), 0.0))
    kinds = F.array_compact(F.array(F.struct(F.lit("term").alias("kind"), F.lit(1.0).alias("x")), F.when(fuzzy.isNotNull() & (F.length("term") <= FUZZY_LENGTH), F.struct(F.lit("fuzzy").alias("kind"), fuzzy.alias("x")))))
    return t.withColumn("k", F.explode(kinds)).select("query_id", "channel", "field", "term", "k.kind", (F.col("weight") * F.col("k.x")).alias("boost"))


def free_text_terms(texts: DataFrame, boost: float = FREE_TEXT_BOOST, analyze=tokens) -> DataFrame:
    """texts (query_id, text): each token a content term."""
    return texts.select("query_id", F.lit("content").alias("channel"), F.lit("content").alias("field"), F.explode(query_tokens(F.col("text"), analyze)).alias("term"), F.lit("term").alias("kind"), F.lit(boost).alias("boost"))


def fuzzy_terms(terms: DataFrame, vocabulary: DataFrame, prefix: int = 1, keys: DataFrame | None = None, words: list[str] | None = None) -> DataFrame:
    """Fuzzy terms (field, term, ...) as the vocabulary's terms at edit distance 0 or 1 that share the first `prefix`
    characters, by vocabulary.near_terms; the asked term stays as `asked`. keys: the vocabulary's stored deletions; words:
    the asked terms where they are known and few, whose own deletions are then looked up in the sorted keys."""
    if keys is not None and words is not None and len(words) <= MOST_TERMS:
        keys = keys.where(F.col("key").isin(sorted({w[:i] + w[i + 1 :] for w in words for i in range(len(w))} | set(words))))
    near = near_terms(terms.select("field", "term").distinct(), deletions(vocabulary) if keys is None else keys, prefix)
    return terms.withColumnRenamed("term", "asked").join(near, ["field", "asked"])


def asked_only(terms: DataFrame, *tables: DataFrame, words: list[str] | None = None) -> list[DataFrame]:
    """Each table's rows of the asked terms: by a filter that reaches sorted files, or by a semi join if there are many. words:
    the asked terms, where they are known."""
    if words is None:
        words = [r["term"] for r in terms.select("term").distinct().limit(MOST_TERMS + 1).collect()]
    if len(words) <= MOST_TERMS:
        return [t.where(F.col("term").isin(words)) for t in tables]
    return [t.join(terms.select("field", "term").distinct(), ["field", "term"], "left_semi") for t in tables]


def inside(hits: DataFrame, docs: DataFrame, limited: DataFrame | None = None) -> DataFrame:
    """The hits (query_id, and what docs have) that lie in their query's docs. Every query is restricted, also one without docs,
    which has no hits then; with limited (query_id) only the queries named there are."""
    on = ["query_id", *[c for c in docs.columns if c != "query_id"]]
    if limited is None:
        return hits.join(docs, on, "left_semi")
    marked = hits.join(limited.select("query_id").distinct().withColumn("_limited", F.lit(True)), "query_id", "left")
    found = marked.join(docs.select(*on).distinct().withColumn("_in", F.lit(True)), on, "left")
    return found.where("_limited is null or _in").drop("_limited", "_in")


def bm25(terms: DataFrame, post: DataFrame, by_term: DataFrame, by_field: DataFrame, docs: DataFrame | None = None, limited: DataFrame | None = None, cut: bool = True, words: list[str] | None = None, limits: dict[str, int] | None = None) -> DataFrame:
    """terms (query_id, channel, field, term, kind, boost) -> (query_id, channel, unit, score), with the chunk_id and doc_id that
    postings may have. A fuzzy match scores its boost; the statistics are those of the whole index. docs (query_id and unit or
    doc_id) and limited: as for inside(). cut: false if postings and statistics are those of the asked terms already; words: as for
    asked_only(). limits: where only so many best by channel are wanted of each query; what is given holds these.

    Postings and statistics are first cut to the asked terms, hits then to the documents. The asked terms' document frequencies
    tell how many matches there are: many are dealt by unit before the queries meet them, so that what is shuffled is a posting for
    all queries, a unit's scores are summed where they arise, and no task holds more than its share however many units there are.
    With limits they are summed in blocks (operators.blocks), which give out their best only."""
    every = post
    if cut:
        post, by_term = asked_only(terms, post, by_term, words=words)
    asked = with_statistics(terms, by_term, by_field)
    rows, boosts, matches = asked.agg(F.count("*"), F.count("boost"), F.sum("df")).first()
    few = rows <= MOST_ASKED
    if docs is None and few and (matches or 0) > MATCHES:
        if limits is not None and boosts == rows:
            from strataseek.operators import blocks  # it imports this module

            return blocks.best(every, asked, matches, limits)
        post = post.repartition(max(-(-matches // MATCHES), post.sparkSession.sparkContext.defaultParallelism), "unit")
    asked = asked.drop("df")
    hits = post.drop("positions").join(F.broadcast(asked) if few else asked, ["field", "term"])
    if docs is not None:
        hits = inside(hits, docs, limited)
    return summed(hits)


def with_statistics(terms: DataFrame, by_term: DataFrame, by_field: DataFrame) -> DataFrame:
    """Asked terms with df, idf and avgdl; those that no unit holds fall out."""
    return terms.join(by_term.select("field", "term", "df", "idf"), ["field", "term"]).join(F.broadcast(by_field.select("field", "avgdl")), "field")  # a row for each field


def matched(boost: Column | str, tf: Column | str, dl: Column | str) -> Column:
    """What a match adds to the score: its boost if it is fuzzy, else that times BM25 of the term, by idf and avgdl."""
    boost, tf, dl = (F.col(c) if isinstance(c, str) else c for c in (boost, tf, dl))
    weight = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avgdl")))
    return F.when(F.col("kind") == "fuzzy", boost).otherwise(boost * weight)


def summed(hits: DataFrame) -> DataFrame:
    """Hits with their term's statistics -> (query_id, channel, unit, score), with the chunk_id and doc_id they may have."""
    own = [c for c in ("chunk_id", "doc_id") if c in hits.columns]
    return hits.groupBy("query_id", "channel", "unit", *own).agg(F.sum(matched("boost", "tf", "dl")).alias("score"))


def every(units: DataFrame, queries: DataFrame, channel: str = "content") -> DataFrame:
    """units (unit) x queries (query_id): every unit matches with score 1. For questions whose free text has no tokens."""
    return queries.select("query_id").crossJoin(units.select("unit")).select("query_id", F.lit(channel).alias("channel"), "unit", F.lit(1.0).alias("score"))


def tokenless(texts: DataFrame, analyze=tokens) -> DataFrame:
    """texts (query_id, text) -> query_id of those without tokens."""
    return texts.where(F.coalesce(F.size(query_tokens(F.col("text"), analyze)), F.lit(0)) <= 0).select("query_id")


def ranked(hits: DataFrame, by: list[str], k: int | Column, tie: str = "unit", score: str = "score") -> DataFrame:
    """The k best of each group, by rounded score and then by id."""
    w = Window.partitionBy(*by).orderBy(F.round(score, 6).desc(), F.col(tie))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_per_chunk(hits: DataFrame, owner: DataFrame) -> DataFrame:
    """Entity and relation hits -> their chunk's best; owner (unit, chunk_id)."""
    return hits.join(owner, "unit").groupBy("query_id", "channel", "chunk_id").agg(F.max("score").alias("score"))


def normalized(scores: DataFrame) -> DataFrame:
    """Min-max within query and channel; equal scores give 1."""
    w = Window.partitionBy("query_id", "channel")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return scores.withColumns({"lo": lo, "hi": hi}).withColumn("score", F.when(F.col("hi") == F.col("lo"), 1.0).otherwise(F.try_divide(F.col("score") - F.col("lo"), F.col("hi") - F.col("lo")))).drop("lo", "hi")


def fused(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted sum over channels; weights (channel, weight), or each query's own with query_id, are divided by the sum over the
    query's active channels."""
    each = ["query_id", "channel"] if "query_id" in weights.columns else ["channel"]
    w = weights if len(each) > 1 else F.broadcast(weights)  # a row for each channel
    active = F.array_sort(F.collect_set(F.struct("channel", "weight")).over(Window.partitionBy("query_id")))  # a few channels
    s = scores.join(w, each).withColumn("all", F.aggregate(active, F.lit(0.0), lambda n, c: n + c["weight"]))
    return s.groupBy("query_id", "chunk_id").agg(F.sum(F.col("weight") / F.when(F.col("all") == 0, 1.0).otherwise(F.col("all")) * F.col("score")).alias("score"))


def top(fusion: DataFrame, k: int, least: float = LEAST_SCORE) -> DataFrame:
    """The k best of each query, then those that reach `least`."""
    return ranked(fusion, ["query_id"], k, "chunk_id").withColumn("score", F.round("score", 6)).where(F.col("score") >= least)


def meta_documents(hits: DataFrame, per_filter: int = 2) -> DataFrame:
    """hits (query_id, filter_ix, unit, score) -> distinct (query_id, unit): the best documents of each filter."""
    return ranked(hits, ["query_id", "filter_ix"], per_filter).select("query_id", "unit").distinct()


def neighbours(chunks: DataFrame, n: int) -> DataFrame:
    """chunks (doc_id, chunk_index, chunk_id) -> adds prev_ids and next_ids, nearest first."""
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    ids = lambda f: F.array_compact(F.array(*[f("chunk_id", i).over(w) for i in range(1, n + 1)])) if n else F.array().cast("array<string>")
    return chunks.withColumns({"prev_ids": ids(F.lag), "next_ids": ids(F.lead)})


def linked_neighbours(hits: DataFrame, chunks: DataFrame, n: int, pointer: str, out: str) -> DataFrame:
    """The chain along a pointer column, up to n hops, ending at a missing id: n joins on the chunk id."""
    at = hits.withColumn("_at", F.col(pointer))
    links = chunks.select(F.col("chunk_id").alias("_id"), F.col(pointer).alias("_to"))
    names = []
    for i in range(n):
        at = at.join(links, F.col("_at") == F.col("_id"), "left").withColumn(f"_h{i}", F.col("_id")).withColumn("_at", F.col("_to")).drop("_id", "_to")
        names.append(F.col(f"_h{i}"))
    return at.withColumn(out, F.array_compact(F.array(*names)) if n else F.array().cast("array<string>")).drop("_at", *[f"_h{i}" for i in range(n)])


def parsed_search(post: DataFrame, text: str, places: DataFrame | None = None, analyze=tokens) -> DataFrame:
    """(unit, n_hits): units that satisfy a query of operators.language in any field; n_hits counts the wanted parts found.
    Phrases are looked up in places (field, unit, term, positions); without it, a phrase asks for all of its words. A query that
    asks for nothing has every unit with postings."""
    fields = [r["field"] for r in post.select("field").distinct().collect()]  # a row for each field
    tree = language.parse(text, post.sparkSession, fields, analyze)
    terms = language.asked_terms(tree, fields, post.select("field", "term").distinct())
    own = post
    if all(leaf.pattern is None for leaf, _ in language.leaves(tree)):  # a query's own words, by a filter that reaches the files
        own = post.where(F.col("term").isin(sorted({t for leaf, _ in language.leaves(tree) for t in leaf.tokens})))
    return language.satisfying(tree, terms, own, post.select("unit").distinct(), places)


def direct_search(text: str, fields: list[str], post: DataFrame, by_term: DataFrame, by_field: DataFrame, limit: int = 10, places: DataFrame | None = None, analyze=tokens, grams: DataFrame | None = None, every: DataFrame | None = None, docs: list[str] | None = None) -> DataFrame:
    """(unit, score, rank): a query of operators.language over several fields, BM25 of its wanted terms, the `limit` best by
    score and id. analyze: the index's analyzer; grams: the vocabulary's, for patterns; every (unit): all units, else those with
    postings; docs: only units of these documents (none if it is empty), where postings have doc_id. Phrases are looked up in
    places, or in postings that have positions."""
    spark = post.sparkSession
    tree = language.parse(text, spark, fields, analyze)
    post = post.where(F.col("field").isin(fields))
    if docs is not None:
        post = post.where(F.col("doc_id").isin(docs))
        every = every.where(F.col("doc_id").isin(docs)) if every is not None else None
    terms = language.asked_terms(tree, fields, by_term, grams)
    if any(leaf.pattern is not None for leaf, _ in language.leaves(tree)):
        own, stats = asked_only(terms, post, by_term)
    else:  # a query's own words
        words = sorted({t for leaf, _ in language.leaves(tree) for t in leaf.tokens})
        own, stats = post.where(F.col("term").isin(words)), by_term.where(F.col("term").isin(words))
    places = places if places is not None else own if "positions" in own.columns else None
    found = language.satisfying(tree, terms, own, post.select("unit").distinct() if every is None else every, places)
    wanted = terms.where("wanted").groupBy("field", "term").agg(F.sum("boost").alias("boost")).select(F.lit(0).cast("long").alias("query_id"), F.lit("direct").alias("channel"), "field", "term", F.lit("term").alias("kind"), "boost")
    scores = bm25(wanted, own, stats, by_field, cut=False).select("unit", F.round("score", 6).alias("score"))
    hits = found.select("unit").join(scores, "unit", "left").fillna(0.0, ["score"])
    return hits.orderBy(F.col("score").desc(), "unit").limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "unit")))  # limit rows
