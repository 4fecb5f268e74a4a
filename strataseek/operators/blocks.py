"""Scores of many matches: postings dealt by unit, and blocks of whole units scored against all queries at once.

A match (a query's term in a unit) is no row of its own here: a posting is shuffled once for all queries that ask for it, its matches
are summed in columns, and of a block's hits only each query's best leave the task."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from strataseek.functions.local import local_rows
from strataseek.operators import search as S

#: Blocks that one task scores, about.
BLOCKS = 8
#: Up to so many cells (a query in a unit) for each match, a block's sums stand in an array of all of them.
DENSE = 4
#: A number that equal units share, by which they are sorted.
PLACE = F.xxhash64


def rounded(scores: np.ndarray) -> np.ndarray:
    """In millionths, halves away from zero as Spark rounds the decimal digits of a double."""
    x = scores * 1e6
    out = np.floor(x + 0.5)
    for i in np.flatnonzero(np.abs(x - np.floor(x) - 0.5) < 1e-6):
        out[i] = int((Decimal(repr(float(scores[i]))) * 10**6).to_integral_value(ROUND_HALF_UP))
    return out


def _units(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(each row's unit, as its place among the table's units in Spark's order; the rows by unit and key)."""
    told = table["unit"].combine_chunks().dictionary_encode("encode")
    place = np.empty(len(told.dictionary), np.int64)
    place[pc.array_sort_indices(told.dictionary, null_placement="at_start").to_numpy()] = np.arange(len(place))
    unit = place[told.indices.to_numpy()]
    return unit, np.lexsort((table["key"].to_numpy(), unit))


def _summed(cell: np.ndarray, gain: np.ndarray, units: int, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matches by cell (query * units + unit) -> cells that are hit, with the sums of their gains, in order; of dense blocks only
    cells that may be among their query's `most` best. Where cells are no more than a few for each match, the sums stand in an
    array of all cells and no match is sorted."""
    size = len(most) * units
    if size > DENSE * len(cell):
        found, hit = np.unique(cell, return_inverse=True)
        return found, np.bincount(hit, weights=gain, minlength=len(found))
    sums, hit = np.bincount(cell, weights=gain, minlength=size), np.zeros(size, bool)
    hit[cell] = True
    ranks = np.where(hit, rounded(sums), -np.inf).reshape(len(most), units)
    least = np.full(len(most), -np.inf)
    for k in np.unique(most[most < units]):
        least[most == k] = np.partition(ranks[most == k], units - k, axis=1)[:, units - k]
    found = np.flatnonzero(hit & ~(ranks < least[:, None]).ravel())
    return found, sums[found]


def _block_best(table: pa.Table, starts: np.ndarray, query: np.ndarray, boost: np.ndarray, most: np.ndarray) -> pa.Table:
    """table (unit, ..., key, weight) of whole units -> (unit, ..., query, score): each query's best units in the block. A key's
    queries and boosts lie from starts[key] to starts[key + 1]; most: how many of each query."""
    unit, by = _units(table)
    unit, key, weight = unit[by], table["key"].to_numpy()[by], table["weight"].to_numpy()[by]
    n = starts[key + 1] - starts[key]
    at = np.arange(int(n.sum())) + np.repeat(starts[key] - np.cumsum(n) + n, n)
    units = int(unit[-1]) + 1
    found, score = _summed(query[at] * units + np.repeat(unit, n), boost[at] * np.repeat(weight, n), units, most)
    q, u = np.divmod(found, units)
    order = np.lexsort((u, -rounded(score), q))
    kept = order[np.arange(len(q)) - np.searchsorted(q, q) < most[q]]
    first = by[np.flatnonzero(np.diff(unit, prepend=-1))]  # of each unit
    out = table.drop_columns(["key", "weight"]).take(pa.array(first[u[kept]]))
    return out.append_column("query", pa.array(q[kept], pa.int32())).append_column("score", pa.array(score[kept]))


KEYS = "field string, term string, kind string, idf double, avgdl double, key int"


def numbered(asked: DataFrame) -> tuple[dict, dict, np.ndarray, np.ndarray, np.ndarray]:
    """Asked terms with their statistics, collected -> numbers of queries (query_id, channel) and of keys (as KEYS), and each key's
    queries and boosts, from starts[key] to starts[key + 1]."""
    queries, keys, boosts = {}, {}, {}
    for r in asked.collect():
        q = queries.setdefault((r["query_id"], r["channel"]), len(queries))
        k = keys.setdefault((r["field"], r["term"], r["kind"], r["idf"], r["avgdl"]), len(keys))
        boosts[k, q] = boosts.get((k, q), 0.0) + r["boost"]
    pairs = sorted(boosts)
    starts = np.searchsorted(np.array([k for k, _ in pairs]), np.arange(len(keys) + 1))
    return queries, keys, starts, np.array([q for _, q in pairs], np.int64), np.array([boosts[p] for p in pairs])


def named(asked: DataFrame, queries: dict) -> DataFrame:
    plain = lambda x: x.asDict(True) if isinstance(x, Row) else x
    return local_rows(asked.sparkSession, [(n, plain(q), c) for (q, c), n in queries.items()], f"query int, query_id {asked.schema['query_id'].dataType.simpleString()}, channel string")


def best(post: DataFrame, asked: DataFrame, matches: int, limits: dict[str, int]) -> DataFrame:
    """Postings, of any terms, and asked terms with their statistics, few enough for every task -> (query_id, channel, unit, score), with the
    chunk_id and doc_id that postings may have: hits that hold the best of each query and channel, as many as limits say by
    channel, by score of six places and then by unit."""
    spark, size = post.sparkSession, S.MATCHES
    queries, keys, starts, query, boost = numbered(asked)
    most = np.array([limits[channel] for _, channel in queries])

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            key = b["key"].to_numpy()
            held.append(b)
            n += int((starts[key + 1] - starts[key]).sum())
            if n >= size:
                t = pa.Table.from_batches(held)
                place = t["at"].to_numpy()
                whole = int(np.searchsorted(place, place[-1]))  # the last units may go on
                if whole:
                    yield from _block_best(t.slice(0, whole).drop_columns(["at"]), starts, query, boost, most).to_batches()
                    held, key = t.slice(whole).to_batches(), t["key"].to_numpy()[whole:]
                    n = int((starts[key + 1] - starts[key]).sum())
        if n:
            yield from _block_best(pa.Table.from_batches(held).drop_columns(["at"]), starts, query, boost, most).to_batches()

    told = local_rows(spark, [(*k, n) for k, n in keys.items()], KEYS)
    own = ["unit", *[c for c in ("chunk_id", "doc_id") if c in post.columns]]
    words = sorted({k[1] for k in keys})
    if len(words) <= S.MOST_TERMS:  # a filter that reaches the files; of more words the join alone tells the asked postings
        post = post.where(F.col("term").isin(words))
    met = post.join(F.broadcast(told), ["field", "term"]).select(*own, "key", S.matched(F.lit(1.0), "tf", "dl").alias("weight"))
    dealt = met.repartition(max(-(-matches // (size * BLOCKS)), spark.sparkContext.defaultParallelism), "unit")
    # by one number: Spark sorts it without comparing rows, and equal units have equal ones
    dealt = dealt.withColumn("at", PLACE(F.col("unit"))).sortWithinPartitions("at")
    kinds = StructType([*[post.schema[c] for c in own], StructField("query", IntegerType()), StructField("score", DoubleType())])
    return dealt.mapInArrow(scored, kinds).join(F.broadcast(named(asked, queries)), "query").select("query_id", "channel", *own, "score")
