"""Mixing sources to target weights by hash-threshold histograms. DataFrame operations only.

Sizes are words: runs of characters other than space and \\x09-\\x0D (null text: 0). Sources stand by code point, null
last; their weights repeat WEIGHTS. The hash is of doc_id (null: empty) and text, so rows with one id or without one are
spread by their texts; rows alike in both share a hash and are taken together. A source without words takes nothing. An
empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

WEIGHTS = (3, 1, 2)
#: The budget is PER / OF of all words; no document is taken more than MOST times.
PER, OF, MOST = 3, 2, 2
#: A hash has HASH_BITS bits; each histogram resolves STEP of them.
HASH_BITS, STEP = 48, 12


def _words(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _hash(doc_id: F.Column, text: F.Column) -> F.Column:
    """48 bits of an md5, the same in any engine."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def _placed(sources: DataFrame) -> DataFrame:
    """Adds pos, each source's place by code point with null last: ranges are numbered each by themselves and moved by
    the count of what stands before, so no task sees all sources."""
    null_last = [F.col("source").isNull(), F.col("source")]
    ranged = saved(sources.repartitionByRange(*null_last).withColumn("range", F.spark_partition_id()), "sources")
    before = ranged.groupBy("range").agg(F.count("*").alias("k")).withColumn("before", F.sum("k").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)))
    own = F.row_number().over(Window.partitionBy("range").orderBy(*null_last)) - 1
    return ranged.withColumn("own", own).join(before, "range").select("source", "source_size", (F.col("own") + F.coalesce("before", F.lit(0))).alias("pos"))


def _exact(n: F.Column) -> F.Column:
    return n.cast("decimal(19,0)")


def _targets(sources: DataFrame) -> DataFrame:
    """source, source_size -> target: shares by weight, held to MOST times the source's size; the excess goes to the
    others by weight until none is above. Each round is one aggregate to a single row; sums are exact integers, products
    are decimals of 38 digits, so they can't overflow."""
    weight = F.get(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("pos") % len(WEIGHTS)).cast("int"))
    t = saved(_placed(sources).select("source", "source_size", weight.cast("long").alias("w")), "weights")
    total = t.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    full, left, weights = F.lit(False), PER * total, None  # left: the budget of the sources not yet full, times OF
    while True:
        over = _exact(F.col("source_size")) * _exact(F.lit(OF * MOST * (weights or 0))) < _exact(F.lit(str(left))) * F.col("w").cast("decimal(2,0)")
        now = full if weights is None else full | over
        row = t.agg(F.sum(F.when(now, F.col("source_size"))).alias("s"), F.sum(F.when(~now, F.col("w"))).alias("w"), F.count(F.when(now, 1)).alias("k")).first()
        if weights is not None and row["k"] == count:  # noqa: F821
            break
        left, weights, count, full = PER * total - OF * MOST * (row["s"] or 0), row["w"] or 0, row["k"], now
        if not weights:
            break
    share = F.lit(float(left)) * F.col("w") / F.lit(float(OF * max(weights, 1)))
    return t.withColumn("target", F.when(full, F.col("source_size") * F.lit(float(MOST))).otherwise(share))


def _sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, hash of each row: what the mix is decided by, read from the texts once."""
    text = F.col("text")
    return saved(docs.select(F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), _words(text).alias("size"), _hash(F.col("doc_id"), text).alias("hash")), "sizes")


def _plan(slim: DataFrame) -> DataFrame:
    """slim (source, size, hash) -> a row for each source: _source, _source_size, _target, _whole, _low.

    Each document is taken floor(target / source_size) = _whole times; what then is missing comes from the documents whose
    hash lies under the source's threshold _low. A histogram by source and leading hash bits finds the bucket in which the
    cumulated size crosses the budget; only that bucket is resolved by the next bits, down to single hashes."""
    # a hot source is summed within each task first, so its rows never meet
    sources = _targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")))
    sources = saved(sources.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "targets")

    # bound: hashes under `low` are in; those of the bucket that starts at `low` are still open, with `rest` words to go
    bound = sources.select("source", F.lit(0).cast("long").alias("low"), "rest")
    for level in range(1, HASH_BITS // STEP + 1):
        width = 1 << (HASH_BITS - level * STEP)
        inside = slim.join(F.broadcast(bound) if _small(bound) else bound, slim["source"].eqNullSafe(bound["source"])).where((F.col("hash") >= F.col("low")) & (F.col("hash") < F.col("low") + F.lit(width << STEP))).select(slim["source"], "size", F.floor(F.col("hash") / width).alias("bucket"))
        hist = inside.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))  # 2**STEP rows a source at most
        hist = hist.withColumn("upto", upto).withColumnRenamed("source", "s")
        last = level * STEP == HASH_BITS
        # the first bucket not wholly within the budget; at the last level a hash is taken if that comes nearer
        out = F.col("upto") > F.col("rest") if not last else 2 * F.col("upto") - F.col("words") > 2 * F.col("rest")
        cut = hist.join(bound, F.col("s").eqNullSafe(F.col("source"))).where(out).groupBy("source", "rest").agg(F.min(F.struct("bucket", "upto", "words")).alias("cut"))
        cut = cut.select(F.col("source").alias("s"), (F.col("cut.bucket") * width).alias("at"), (F.col("rest") - F.col("cut.upto") + F.col("cut.words")).alias("left"))
        end = F.col("low") + F.lit(width << STEP)
        bound = saved(bound.join(cut, F.col("s").eqNullSafe(F.col("source")), "left").select("source", F.coalesce("at", end).alias("low"), F.coalesce("left", F.lit(0.0)).alias("rest")), "bound")
    plan = sources.select("source", "source_size", "target", "whole").join(bound.select(F.col("source").alias("s"), "low"), F.col("source").eqNullSafe(F.col("s"))).select(*[F.col(c).alias(f"_{c}") for c in ("source", "source_size", "target", "whole", "low")])
    return saved(plan, "plan")


def _copies(rows: DataFrame, source: str, hash_: str, plan: DataFrame) -> DataFrame:
    """rows with their source's plan and _copies, the times that the mix takes each."""
    copies = (F.col("_whole") + F.when(F.col(hash_) < F.col("_low"), 1).otherwise(0)).cast("long")
    return rows.join(F.broadcast(plan) if _small(plan) else plan, F.col(source).eqNullSafe(F.col("_source"))).withColumn("_copies", F.least(copies, F.lit(MOST)))


#: A table of a row for each source is broadcast up to this many rows; above, Spark joins by the key.
BROADCAST_ROWS = 100_000


def _small(df: DataFrame) -> bool:
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes, repeats counted)."""
    slim = _sizes(docs)
    return _copies(slim, "source", "hash", _plan(slim)).select("doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("size") * F.col("_copies")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them: a row for each copy, none for those not taken, with the columns of docs."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")).withColumn("_hash", _hash(F.col("_row.doc_id"), F.col("_row.text")))
    taken = _copies(rows, "_row.source", "_hash", _plan(_sizes(docs)))
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"), F.lit(1)))).where("_copies > 0").select("_row.*")


#: What mix_report gives, sorted instead of thresholded.
ORACLE = r"""
with d as (
  select doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')), 1, 12))::bigint as h
  from documents
), s as (
  select source, sum(size)::bigint as source_size,
         [3, 1, 2][1 + ((row_number() over (order by source nulls last) - 1) % 3)::int] as w
  from d group by source
), r as (
  select *, sum(w) over (order by 2.0 * source_size / w, source nulls last rows between current row and unbounded following) as w_open,
         coalesce(sum(2 * source_size) over (order by 2.0 * source_size / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as c_full,
         sum(source_size) over () as total
  from s
), level as (
  select min(case when (1.5 * total - c_full) * w <= 2.0 * source_size * w_open then (3 * total - 2 * c_full)::double end) as rest2,
         max(case when (1.5 * total - c_full) * w <= 2.0 * source_size * w_open then w_open end)::double as w_open
  from (select *, row_number() over (order by 2.0 * source_size / w, source nulls last) as k from r)
  where k = (select min(k) from (select row_number() over (order by 2.0 * source_size / w, source nulls last) as k, * from r)
             where (1.5 * total - c_full) * w <= 2.0 * source_size * w_open)
), t as (
  select source, source_size,
         case when w * (select rest2 from level) / (2 * (select w_open from level)) < 2.0 * source_size
              then (select rest2 from level) * w / (2 * (select w_open from level)) else 2.0 * source_size end as target
  from s
), c as (
  select d.*, t.source_size, t.target,
         case when t.source_size > 0 then floor(t.target / t.source_size) else 0 end::bigint as whole,
         sum(size) over (partition by d.source order by h) as upto,
         sum(size) over (partition by d.source, h) as own
  from d join t on d.source is not distinct from t.source
)
select doc_id, size, source_size, target::double as target,
       (size * (whole + case when 2 * upto - own <= 2 * (target - whole * source_size) then 1 else 0 end))::bigint as taken
from c
"""
