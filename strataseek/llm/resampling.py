"""Importance resampling towards a target by hashed n-gram features, with a dictionary of distinct features.

A document's features are its runs of 1 to `width` words, counted in the task that reads it. The counts are written once. Over
them, the distinct feature strings of the corpus are counted, each is hashed to its bucket once, and buckets are summed, as are
the target's; a bucket's gain follows from its sums. Gains go back to the documents' counts by feature: features that make up
over one part in HEAVY of the corpus, at most HEAVY of them, are broadcast, so no feature left for the join is frequent; the
weights are then summed by document.

Scores add to each weight a Gumbel number made of the doc_id, so that the highest scores are a draw without replacement in
proportion to the weights. Ranks come from a range sort: places in a partition, plus the sizes of those before (a row for each
partition).

A null text has no words, a null doc_id draws as an empty text and comes last of equals. Rows that share a doc_id are
documents each, with ranks of their own. With an empty target or corpus the
counts are 0 and the formula still holds. An empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frugal, lean, saved

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 10, 2024
#: Features above one part in HEAVY of the corpus are broadcast: there can't be more than HEAVY.
HEAVY = 50_000
#: Bytes as words see them: A-Z in lower case, ASCII other than letters and digits as spaces.
_SEEN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def _features(text: bytes | None, width: int) -> tuple[int, Counter]:
    """(number of words, features with their counts)."""
    words = (text or b"").translate(_SEEN).split(b" ")
    words = [w for w in words if w]
    found = Counter(words)
    for n in range(2, width + 1):
        found.update(b" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
    return len(words), found


def _counts(width: int):
    """Rows (doc_id, text) -> for each a row without feature, with its doc_id and the number of its words, and one for each
    feature; `row` numbers the rows of docs."""

    def run(batches):
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            for doc, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words, found = _features(text, width)
                rest = [None] * len(found)
                cols = [pa.array([row] * (1 + len(found)), pa.int64()), pa.array([doc, *rest], pa.int64()), pa.array([None, *found], pa.binary()), pa.array([words, *found.values()], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["row", "doc_id", "feature", "n"])
                row += 1

    return lean(_merged(run))


def _merged(run, rows: int = 50_000):
    """run, whose small batches are put together to about `rows` rows."""

    def over(batches):
        held, n = [], 0
        for b in run(batches):
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return over


def feature_counts(docs: DataFrame, width: int = 1) -> DataFrame:
    """docs (doc_id, text, ...) -> (row, doc_id, feature, n): for each row of docs one without feature, where n counts its words,
    and one for each distinct feature, without doc_id. Rows are numbered by partition: save the table before it is read twice."""
    d = frugal(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    out = d.mapInArrow(_counts(width), "row long, doc_id long, feature binary, n long")
    return out.withColumn("feature", F.col("feature").cast("string"))


def dictionary(counts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """counts (feature, n) -> (feature, n, bucket): each distinct feature once, with its count in the corpus."""
    d = counts.where("feature is not null").groupBy("feature").agg(F.sum("n").alias("n"))
    return d.withColumn("bucket", F.crc32(F.col("feature").cast("binary")) % buckets)


def gains(own: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Two dictionaries -> (bucket, gain) for every bucket."""
    sums = lambda d, name: d.groupBy("bucket").agg(F.sum("n").alias(name))
    b = own.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(sums(own, "s"), "bucket", "left").join(sums(target, "t"), "bucket", "left").fillna(0)
    both = b.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))  # one row
    whole = lambda c: F.col(c).cast("double")
    odds = (whole("t") + 1) * (whole("all_s") + buckets) / ((whole("s") + 1) * (whole("all_t") + buckets))
    return b.crossJoin(F.broadcast(both)).select("bucket", F.floor(1000 * F.ln(odds)).alias("gain"))


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """A long for each doc_id: -1000 ln(-ln u), u from the first 8 hex digits of a hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def weighted(docs: DataFrame, target: DataFrame, width: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """docs (doc_id, text, ...) and target (text, ...) -> (doc_id, n_words, n_features, weight) for each row of docs."""
    counts = saved(feature_counts(docs, width), "features")
    own = saved(dictionary(counts, buckets), "dictionary")
    gain = F.broadcast(gains(own, dictionary(feature_counts(target.select(F.lit(None).alias("doc_id"), "text"), width), buckets), buckets))  # a row for each bucket
    priced = own.join(gain, "bucket").select("feature", "gain", "n")
    total = own.agg(F.sum("n").alias("n")).first()["n"] or 0
    heavy = priced.where(F.col("n") * HEAVY > total).select("feature", F.col("gain").alias("heavy"))
    light = priced.where(F.col("n") * HEAVY <= total).select("feature", F.col("gain").alias("light"))
    c = counts.join(F.broadcast(heavy), "feature", "left")  # HEAVY rows at most
    mark = F.col("feature").isNull()
    own = lambda x: F.when(mark, F.col(x))
    here = c.where(mark | F.col("heavy").isNotNull()).select("row", own("doc_id").alias("doc_id"), own("n").alias("words"), F.when(mark, 0).otherwise(F.col("n")).alias("features"), F.when(mark, 0).otherwise(F.col("n") * F.col("heavy")).alias("weight"))
    there = c.where(~mark & F.col("heavy").isNull()).select("feature", "row", "n").join(light.hint("shuffle_hash"), "feature")
    none = F.lit(None).cast("long")
    there = there.select("row", none.alias("doc_id"), none.alias("words"), F.col("n").alias("features"), (F.col("n") * F.col("light")).alias("weight"))
    d = here.unionByName(there).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("words").alias("n_words"), F.sum("features").alias("n_features"), F.sum("weight").alias("weight"))
    return d.drop("row")


def resampled(docs: DataFrame, target: DataFrame, width: int = 1, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """-> doc_id, n_features, weight, score, rank for each row of docs; rank counts the drawn ones from 1, the highest scores
    among the documents of at least `least_words` words, `percent` of those (rounded down); it is null for the others."""
    spark = docs.sparkSession
    w = weighted(docs, target, width, buckets).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).withColumn("fits", F.col("n_words") >= least_words)
    order = [F.col("fits").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    s = saved(w.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "ranked")
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = s.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if("fits").alias("fit")).orderBy("part").collect()  # a row for each partition
    most, before, at = math.floor(percent * sum(r["fit"] for r in sizes) / 100), [], 0
    for r in sizes:
        before.append((r["part"], at))
        at += r["n"]
    starts = F.broadcast(spark.createDataFrame(before, "part long, before long"))
    rank = F.col("before") + within + 1
    return s.withColumn("part", part).join(starts, "part").select("doc_id", "n_features", "weight", "score", F.when(F.col("fits") & (rank <= most), rank).alias("rank"))


#: CRC-32 of a list of bytes, by crc_table of the one row of crc: the table by rule, then a fold.
CRC = "xor(list_reduce(list_prepend(4294967295::ubigint, {}), lambda c, b: xor(crc_table[((xor(c, b) & 255) + 1)::bigint], c >> 8)), 4294967295::ubigint)"
CRC_TABLE = "crc as materialized (select list(c order by i) as crc_table from (select i, list_reduce(list_prepend(i::ubigint, range(8)::ubigint[]), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end) as c from range(256) r(i)))"
_BYTES = "list_transform(range(0, octet_length(encode({0}))), lambda i: ('0x' || substr(hex(encode({0})), (2 * i + 1)::bigint, 2))::ubigint)"
_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = f"""with {CRC_TABLE},
d as (select row_number() over () as k, doc_id, coalesce({_WORDS.format("text")}, []) as w from documents),
f as (select k, feature, count(*) as n from (select k, unnest(w) as feature from d) group by k, feature),
b as (select feature, count(*) as n from (select unnest({_WORDS.format("text")}) as feature from benchmark) group by feature),
own as (select feature, sum(n)::bigint as n from f group by feature),
hashed as (select feature, ({CRC.format(_BYTES.format("feature"))} % 10000)::bigint as bucket from (select feature from own union select feature from b), crc),
s as (select bucket, sum(n)::bigint as s from own join hashed using (feature) group by bucket),
t as (select bucket, sum(n)::bigint as t from b join hashed using (feature) group by bucket),
g as (select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select coalesce(sum(n), 0) from own) + 10000)::double / ((coalesce(s, 0) + 1)::double * ((select coalesce(sum(n), 0) from b) + 10000)::double)))::bigint as gain from s full join t using (bucket)),
w as (select k, sum(n * gain)::bigint as weight from f join hashed using (feature) join g using (bucket) group by k),
x as (select k, doc_id, len(w)::bigint as n_features, coalesce(weight, 0) as weight, ('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as h from d left join w using (k)),
y as (select k, doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint as score from x),
r as (select k, row_number() over (order by score desc, doc_id) as rank from y where n_features >= 20 qualify rank <= (select count(*) * 10 // 100 from y where n_features >= 20))
select doc_id, n_features, weight, score, rank from y left join r using (k)"""
