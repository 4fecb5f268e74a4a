"""The k best by bounds: postings packed in ranges of units, of which only those are opened that can reach the k-th score.

A range holds units of nearly equal length. A packed list is a term's postings within a range, with the most occurrences and the
least length among them; BM25 grows with the one and falls with the other, so the two bound every score in the list, whatever the
statistics are by then. As lengths within a range hardly differ, the bound is close.

A search sums the bounds of each query's lists by range, opens the few ranges with the highest, takes the k-th score found there
as what is to be reached, and opens the ranges whose bound reaches it. No hit among the k best is lost: deletions and document
filters only lower what a range holds, and where fewer than k hits are found first, all ranges are opened."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from strataseek.functions.local import local_rows
from strataseek.operators import blocks, units
from strataseek.operators import search as S

#: Units in a range, about; steps of length within a doubling; ranges opened first for each hit wanted. With 10,000 documents and
#: a question of four frequent words, which 6,014 documents hold, the 10 best take opening ranges with some 430 of these; were
#: only one range opened first for each hit wanted, some 3,500.
UNITS, STEPS, FIRST = 16, 16, 4
#: Ranks go by scores of six places, so bounds are held against the k-th score less this.
SLACK = 2e-6


def ranges(post: DataFrame, salt: str = "") -> DataFrame:
    """postings (field, unit, dl, ...) -> (unit, range). Units of one step of length are dealt by a hash to ranges of about UNITS;
    the numbers of units by step are a few hundred rows. salt keeps ranges of separate tables apart."""
    own = post.groupBy("unit").agg(F.collect_set(F.struct("field", "dl")).alias("f"))  # one for each field
    length = F.aggregate("f", F.lit(0).cast("long"), lambda n, x: n + x["dl"])
    own = own.select("unit", F.floor(STEPS * F.log2(length)).alias("step"))
    n = own.groupBy("step").agg(F.ceil(F.count("*") / UNITS).alias("n"))
    dealt = own.join(F.broadcast(n), "step").withColumn("at", F.pmod(F.xxhash64("unit"), F.col("n")))
    return dealt.select("unit", F.xxhash64(F.lit(salt), "step", "at").alias("range"))


def packed(post: DataFrame, salt: str = "") -> DataFrame:
    """postings -> (field, term, range, most_tf, least_dl, hits), hits being the list of (unit, chunk_id and doc_id if postings
    have them, tf, dl). Positions stay with the postings. A list holds a range's units at most, so no term makes a long one."""
    own = [c for c in ("unit", "chunk_id", "doc_id", "tf", "dl") if c in post.columns]
    lists = post.join(ranges(post, salt), "unit").groupBy("field", "term", "range")
    return lists.agg(F.max("tf").alias("most_tf"), F.min("dl").alias("least_dl"), F.collect_list(F.struct(*own)).alias("hits"))


def packed_units(table: DataFrame, unit: str, fields: list[str], parts: int) -> DataFrame:
    """Units -> lists, as packed() makes them of their postings, in order of field, term and range; what moves is the text, once. A
    part's units in order of their texts' lengths make its ranges; repeated units lie in one."""
    whole = Window.partitionBy("part", unit)
    size = sum((F.coalesce(F.octet_length(F.col(f)), F.lit(0)).cast("long") for f in fields), F.lit(0).cast("long"))
    t = table.select(unit, *fields).withColumn("part", F.pmod(F.xxhash64(unit), F.lit(parts))).repartition(parts, "part")
    t = t.withColumn("_size", F.sum(size).over(whole))
    at = F.floor((F.dense_rank().over(Window.partitionBy("part").orderBy("_size", unit)) - 1) / UNITS)
    post = units.postings(t.withColumn("range", F.xxhash64("part", at)), unit, fields, own=("part", "range"))
    lists = post.groupBy("part", "field", "term", "range").agg(F.max("tf").alias("most_tf"), F.min("dl").alias("least_dl"), F.collect_list(F.struct("unit", "tf", "dl")).alias("hits"))
    return lists.drop("part").sortWithinPartitions("field", "term", "range")


def statistics(lists: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """units.statistics() of the lists' postings."""
    own = lists.select("field", "term", F.size("hits").cast("long").alias("df"), F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["tf"]).alias("tf"))
    terms = own.groupBy("field", "term").agg(F.sum("df").alias("df")).withColumn("idf", F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    return terms, own.groupBy("field").agg((F.sum("tf") / F.lit(n)).alias("avgdl"))


def _opened(t: pa.Table, starts: np.ndarray, query: np.ndarray, boost: np.ndarray, k: int) -> pa.Table:
    """Lists of whole ranges (range, key, bound, hits) -> (unit, ..., query, score): the k best of each query, of ranges that can
    reach them."""
    hits = t["hits"].combine_chunks()
    size = pc.list_value_length(hits).to_numpy()
    flat = hits.flatten()
    told = flat.field("unit").dictionary_encode("encode")
    place = np.empty(len(told.dictionary), np.int64)
    place[pc.array_sort_indices(told.dictionary, null_placement="at_start").to_numpy()] = np.arange(len(place))
    unit, weight = place[told.indices.to_numpy()], flat.field("weight").to_numpy()
    spread = lambda n: np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    key, begin = t["key"].to_numpy(), np.cumsum(size) - size
    n = starts[key + 1] - starts[key]
    asks = spread(n) + np.repeat(starts[key], n)
    row = np.repeat(np.arange(len(key)), n)
    _, ranges_ = np.unique(t["range"].to_numpy(), return_inverse=True)
    cells, of = np.unique(query[asks] * (int(ranges_.max()) + 1) + ranges_[row], return_inverse=True)
    bound = np.bincount(of, np.maximum(boost[asks], 0.0) * t["bound"].to_numpy()[row])
    whose = cells // (int(ranges_.max()) + 1)

    def scored(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, unit, score) of the chosen cells' hits."""
        pair = np.flatnonzero(chosen[of])
        m = size[row[pair]]
        hit = spread(m) + np.repeat(begin[row[pair]], m)
        found, at = np.unique(np.repeat(query[asks[pair]], m) * len(place) + unit[hit], return_inverse=True)
        return found // len(place), found % len(place), np.bincount(at, np.repeat(boost[asks[pair]], m) * weight[hit], len(found))

    def ranks(q: np.ndarray, *by: np.ndarray) -> np.ndarray:
        """Each one's place within its query, by `by`."""
        order, out = np.lexsort((*by[::-1], q)), np.empty(len(q), np.int64)
        out[order] = np.arange(len(q)) - np.searchsorted(q[order], q[order])
        return out

    first = ranks(whose, -bound) < FIRST * k
    q, u, score = scored(first)
    last = ranks(q, -blocks.rounded(score), u) == k - 1
    least = np.full(int(query.max()) + 1, -np.inf)
    least[q[last]] = score[last]
    q, u, score = (np.concatenate(x) for x in zip((q, u, score), scored(~first & (bound >= least[whose] - SLACK)), strict=True))
    kept = np.flatnonzero(ranks(q, -blocks.rounded(score), u) < k)
    one = np.empty(len(place), np.int64)
    one[unit] = np.arange(len(unit))  # a hit of each unit
    own = flat.take(pa.array(one[u[kept]]))
    names = [f.name for f in flat.type if f.name != "weight"]
    return pa.table([own.field(c) for c in names] + [pa.array(q[kept], pa.int32()), pa.array(score[kept])], names=[*names, "query", "score"])


def _best(lists: DataFrame, asked: DataFrame, matches: int, k: int) -> DataFrame:
    """reaching() for asked terms few enough for every task: lists are dealt by range, each once for all queries that ask for it, and
    a task opens of its ranges those that can reach the k best that it holds. So only lists and each task's best move."""
    spark, most = lists.sparkSession, S.MATCHES
    queries, keys, starts, query, boost = blocks.numbered(asked)
    told = local_rows(spark, [(*x, n) for x, n in keys.items()], blocks.KEYS)
    kinds = lists.schema["hits"].dataType.elementType
    own = [c for c in ("unit", "chunk_id", "doc_id") if c in kinds.names]
    hits = F.transform("hits", lambda h: F.struct(*[h[c].alias(c) for c in own], S.matched(F.lit(1.0), h["tf"], h["dl"]).alias("weight")))
    met = lists.join(F.broadcast(told), ["field", "term"]).select("range", "key", S.matched(F.lit(1.0), "most_tf", "least_dl").alias("bound"), hits.alias("hits"))
    dealt = met.repartition(max(-(-matches // (most * blocks.BLOCKS)), spark.sparkContext.defaultParallelism), "range").sortWithinPartitions("range")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        count = lambda b: int(((starts[b["key"].to_numpy() + 1] - starts[b["key"].to_numpy()]) * pc.list_value_length(b["hits"]).to_numpy()).sum())
        for b in batches:
            held.append(b)
            n += count(b)
            if n >= most:
                t = pa.Table.from_batches(held)
                whole = int(np.searchsorted(t["range"].to_numpy(), t["range"][-1].as_py()))  # the last range may go on
                if whole:
                    yield from _opened(t.slice(0, whole), starts, query, boost, k).to_batches()
                    held = t.slice(whole).to_batches()
                    n = sum(map(count, held))
        if held:
            yield from _opened(pa.Table.from_batches(held), starts, query, boost, k).to_batches()

    schema = StructType([*[kinds[c] for c in own], StructField("query", IntegerType()), StructField("score", DoubleType())])
    return dealt.mapInArrow(run, schema).join(F.broadcast(blocks.named(asked, queries)), "query").select("query_id", "channel", *own, "score")


def reaching(terms: DataFrame, lists: DataFrame, by_term: DataFrame, by_field: DataFrame, k: int, docs: DataFrame | None = None, limited: DataFrame | None = None, words: list[str] | None = None, dead: DataFrame | None = None) -> DataFrame:
    """As search.bm25() over packed lists, without hits that lie in ranges out of reach of the k best of their query and channel;
    what is given holds these k whole. dead (doc_id, _segment): documents taken out since lists with a _segment were packed."""
    by = ["query_id", "channel"]
    lists, by_term = S.asked_only(terms, lists, by_term, words=words)
    asked = S.with_statistics(terms, by_term, by_field)
    rows, queries, boosts, matches = asked.agg(F.count("*"), F.countDistinct(*by), F.count("boost"), F.sum("df")).first()
    if docs is None and dead is None and 0 < rows <= S.MOST_ASKED and boosts == rows:
        return _best(lists, asked, matches, k)
    asked = asked.drop("df")
    # few asked terms go to the lists: joined by term, a frequent term's lists would meet in one task
    heads = lists.drop("hits").join(F.broadcast(asked) if rows <= S.MOST_ASKED else asked, ["field", "term"])
    little = lambda df, n: F.broadcast(df) if n * queries <= S.MOST_ASKED else df
    # what speaks against a unit may be lacking in its neighbours
    bound = F.sum(S.matched(F.greatest("boost", F.lit(0.0)), F.col("most_tf"), F.col("least_dl")))
    bounds = heads.groupBy(*by, "range").agg(bound.alias("bound"))

    def opened(chosen: DataFrame) -> DataFrame:
        # the chosen lists' keys meet the lists, so a list moves once, however many queries ask for it
        keys = heads.drop("most_tf", "least_dl").join(chosen.select(*by, "range"), [*by, "range"])
        hits = keys.join(lists.drop("most_tf", "least_dl"), [c for c in ("field", "term", "range", "_segment") if c in lists.columns])
        hits = hits.select(*[c for c in hits.columns if c != "hits"], F.inline("hits"))
        if dead is not None:
            hits = hits.join(dead, ["doc_id", "_segment"], "left_anti")
        if docs is not None:
            hits = S.inside(hits, docs, limited)
        return S.summed(hits)

    first = little(S.ranked(bounds, by, FIRST * k, "range", "bound").select(*by, "range"), FIRST * k)
    reach = S.ranked(opened(first), by, k).groupBy(*by).agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
    return opened(bounds.join(little(reach, 1), by, "left").where(f"least is null or bound >= least - {SLACK}"))
