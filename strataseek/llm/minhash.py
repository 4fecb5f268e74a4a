"""Near-duplicate documents: many universal hash minima, banding, signature and full-set verification, components.

Rows sharing a doc_id are one document, linked by any of its texts; a null doc_id or a text without words links with nothing and is kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, dropped, frugal, lean, mix, saved
from .components import components

BANDS, ROWS = 25, 5
#: A pair at the threshold falls short of the share of equal minima asked for in about 1 of 4,000 cases (3.5 deviations).
SLACK = 3.5
#: Bits of the filter on ids in pairs. Its size is fixed: with more ids it lets more pass, and a join still decides.
FILTER_BITS = 1 << 22
#: Pairs of two components that one square proposes before the rest of its pairs is looked at.
BEST = 4
#: Minima, a byte each, of the sharper signatures by which the last pass chooses what to hold against full sets.
SHARP = 1024
#: Members of one bucket are compared in squares of this side.
SIDE = 1024

_rng = np.random.default_rng(20240607)


def _hashes(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and summands of n universal hashes."""
    return (_rng.integers(0, 2**63, n, dtype=np.uint64) << np.uint64(1)) | np.uint64(1), _rng.integers(0, 2**63, n, dtype=np.uint64)


_HASHES, _SHARP_HASHES = _hashes(BANDS * ROWS), _hashes(SHARP)


def _least(share: float, n: int) -> float:
    """The share of n equal minima that a pair of similarity `share` reaches, but for SLACK deviations."""
    return share - SLACK * np.sqrt(share * (1 - share) / n)


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer than width words make one shingle, none make none."""
    words = Words()
    rows = [words.numbers(t) for t in texts]
    h = words.hashes()
    out = []
    for row in rows:
        if not len(row):
            out.append(np.zeros(0, np.uint64))
            continue
        x, n = h[row], min(width, len(row))
        key = np.full(len(row) - n + 1, n, np.uint64)
        for k in range(n):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + x[k : len(row) - n + 1 + k])
        out.append(np.unique(key))
    return out


def minima(shingles: np.ndarray, hashes: tuple[np.ndarray, np.ndarray] = _HASHES) -> np.ndarray:
    """Multiply-shift universal hashes' minima, 32 bits each."""
    a, b = hashes
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    step = (1 << 19) // len(a)
    for i in range(0, len(shingles), step):
        part = shingles[None, i : i + step]
        np.minimum(least, (part * a[:, None] + b[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """Rows of minima -> rows of the keys of their bands."""
    band = np.broadcast_to(mix(np.arange(BANDS, dtype=np.uint64)), (len(sig), BANDS))
    for k in range(ROWS):
        band = mix(band * np.uint64(0x9E3779B97F4A7C15) + sig[:, k::ROWS].astype(np.uint64))
    return band.view(np.int64)


def _prints(width: int):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = {"doc_id": [], "n": [], "fp": [], "bands": [], "sig": []}
            for at in range(0, len(ids), 256):
                for doc_id, s in zip(ids[at : at + 256], shingle_sets(texts[at : at + 256], width), strict=True):
                    rows["doc_id"].append(doc_id)
                    rows["n"].append(len(s))
                    if not len(s):
                        for k in ("fp", "bands", "sig"):
                            rows[k].append(None)
                        continue
                    sig = minima(s)
                    rows["fp"].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    rows["bands"].append(band_keys(sig[None])[0])
                    rows["sig"].append(sig.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows["doc_id"], pa.int64()), pa.array(rows["n"], pa.int64()), pa.array(rows["fp"], pa.binary()), pa.array(rows["bands"], pa.list_(pa.int64())), pa.array(rows["sig"], pa.binary())], names=list(rows))

    return run


def _sets(width: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in shingle_sets(part.column(1).to_pylist(), width)], pa.binary())], names=["doc_id", "shingles"])

    return run


def _sharp(width: int):
    """The low bytes of SHARP minima: unlike minima agree in one case of 256, which only lets a few more pairs pass."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = shingle_sets(part.column(1).to_pylist(), width)
                sigs = [minima(s, _SHARP_HASHES).astype(np.uint8).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sigs, pa.binary())], names=["doc_id", "sig"])

    return run


def _alike(least: float):
    """Keeps pairs whose signatures agree in a share of at least `least` of the minima."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
                yield batch.filter(pa.array((a == b).mean(axis=1) >= least)).select(["a", "b"])

    return run


def _linked(per: int, of: int):
    """Keeps pairs whose full sets have of * intersection >= per * union."""

    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(of * both >= per * (len(x) + len(y) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


def _across(least: float, best: int | None):
    """In one square of a bucket, the pairs of unlike components whose signatures, the sharper ones where given, agree enough;
    with best, only that many of two components, those that agree most. A pair comes from the first bucket that it shares."""
    size = 4 * BANDS * ROWS

    def run(t: pa.Table) -> pa.Table:
        ids, comp, side = (t.column(c).to_numpy() for c in ("doc_id", "c", "side"))
        rows = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(len(ids), -1)
        sig = np.ascontiguousarray(rows[:, :size]).view(np.uint32)
        keys = band_keys(sig)
        earlier = keys[:, : (keys[0] == t.column("key")[0].as_py()).argmax()]
        if rows.shape[1] > size:
            sig = rows[:, size:]
        left, right = (np.flatnonzero((side == 0) | (side == 2)), np.flatnonzero((side == 1) | (side == 2)))
        out = [np.zeros((3, 0))]
        for i in left:
            j = right[comp[right] != comp[i]]
            j = j[j > i] if side[i] == 2 else j
            share = (sig[j] == sig[i]).mean(axis=1)
            j, share = j[share >= least], share[share >= least]
            new = ~(earlier[j] == earlier[i]).any(axis=1)
            out.append(np.array([np.full(len(j), i), j, share])[:, new])
        i, j, share = np.concatenate(out, axis=1)
        i, j = i.astype(np.int64), j.astype(np.int64)
        if best and len(i):
            lo, hi = np.minimum(comp[i], comp[j]), np.maximum(comp[i], comp[j])
            by = np.lexsort((-share, hi, lo))
            lo, hi = lo[by], hi[by]
            head = np.flatnonzero(np.append(True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])))
            place = np.arange(len(by)) - np.repeat(head, np.diff(np.append(head, len(by))))
            i, j = i[by][place < best], j[by][place < best]
        return pa.table({"a": pa.array(np.minimum(ids[i], ids[j]), pa.int64()), "b": pa.array(np.maximum(ids[i], ids[j]), pa.int64())})

    return run


def _only(df: DataFrame, ids: DataFrame) -> DataFrame:
    """df's rows whose doc_id is in ids, and few others: a bitmap of FILTER_BITS bits is made of ids, whatever their number,
    and broadcast as 64-bit words, so that df needn't be shuffled to be thinned out."""
    place = F.pmod(F.xxhash64("doc_id", F.lit("filter")), F.lit(FILTER_BITS))
    words = ids.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("_bits"))
    words = saved(words, "bitmap")  # FILTER_BITS / 64 rows at most
    return df.join(F.broadcast(words), F.shiftright(place, 6) == F.col("_word")).where(F.expr("shiftright(_bits, cast(pmod(xxhash64(doc_id, 'filter'), 64L) as int)) & 1 = 1")).select(df.columns)


def near_duplicates(docs: DataFrame, width: int = 5, per: int = 80, of: int = 100) -> DataFrame:
    """docs (doc_id, text, ...) -> one row per input row: doc_id, n_shingles, component_id, kept.

    1. Documents with equal shingle sets fold into classes; the smallest doc_id stands for its class from here on.
    2. Bands make buckets. In each bucket two centres (smallest doc_id, and one by hash) are paired with every member:
       pairs grow with the members, not with their square. Pairs pass the signature check, then the full sets.
    3. Components of these links. Buckets that still hold several components are compared in squares of SIDE members,
       only across components: first the pairs that agree best, then all whose sharper signatures agree enough; so no link
       between components is lost but by SLACK, while pairs within one, which can't change it, aren't made.
    An empty table gives an empty one; extra columns are ignored."""
    least = _least(per / of, BANDS * ROWS)
    docs = frugal(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    prints = saved(docs.mapInArrow(lean(_prints(width)), "doc_id long, n long, fp binary, bands array<long>, sig binary"), "prints")
    live = prints.where("fp is not null and doc_id is not null")
    classes = saved(live.groupBy("fp").agg(F.min(F.struct("doc_id", "n", "bands")).alias("x")).select("fp", F.col("x.doc_id").alias("rep"), "x.n", "x.bands"), "classes")

    rows = classes.select(F.col("rep").alias("doc_id"), "n", F.explode("bands").alias("key"))
    order = F.xxhash64("doc_id", F.lit("centre"))
    hubs = rows.groupBy("key").agg(F.min(F.struct("doc_id", "n")).alias("x"), F.min(F.struct(order.alias("o"), "doc_id", "n")).alias("y"), F.max("doc_id").alias("z")).where("x.doc_id <> z")
    members = saved(rows.join(hubs.select("key", F.col("x.doc_id").alias("c1"), F.col("x.n").alias("n1"), F.col("y.doc_id").alias("c2"), F.col("y.n").alias("n2")), "key"), "members")
    met = members.select("doc_id").distinct()
    sigs = saved(_only(live.select("doc_id", "sig"), met).distinct(), "sigs")  # each text's, where rows share a doc_id

    def pairs(c: str, n: str) -> DataFrame:
        sizes = F.lit(of) * F.least("n", n) >= F.lit(per) * F.greatest("n", n)
        return members.where((F.col(c) != F.col("doc_id")) & sizes).select(F.least(c, "doc_id").alias("a"), F.greatest(c, "doc_id").alias("b"))

    def with_both(p: DataFrame, own: DataFrame, value: str) -> DataFrame:
        one, two = (own.select(F.col("doc_id").alias(k), F.col(value).alias(s)) for k, s in (("a", "sa"), ("b", "sb")))
        return p.join(one, "a").join(two, "b")

    def confirmed(p: DataFrame) -> DataFrame:
        ids = p.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        texts = _only(docs, ids).join(ids, "doc_id", "left_semi")
        sets = saved(texts.mapInArrow(lean(_sets(width)), "doc_id long, shingles binary"), "sets")
        out = saved(with_both(p, sets, "shingles").select("a", "b", "sa", "sb").mapInArrow(_linked(per, of), "a long, b long").distinct(), "links")
        dropped(sets)
        return out

    near = with_both(pairs("c1", "n1").unionByName(pairs("c2", "n2")).distinct(), sigs, "sig").select("a", "b", "sa", "sb").mapInArrow(_alike(least), "a long, b long")
    links = confirmed(saved(near, "pairs"))
    found = saved(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "found")

    tried = None
    for best in (BEST, None):
        at = members.select("key", "doc_id").join(found.select(F.col("node").alias("doc_id"), F.col("component_id").alias("c")), "doc_id", "left").select("key", "doc_id", F.coalesce("c", "doc_id").alias("c"))
        at = saved(at, "at")
        split = at.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("k")).where("lo <> hi").select("key", F.ceil(F.col("k") / SIDE).cast("int").alias("g"))
        rest = at.join(split, "key")
        if best:
            own, enough = sigs, least
        else:
            ids = saved(rest.select("doc_id").distinct(), "ids")
            texts = _only(docs, ids).join(ids, "doc_id", "left_semi").mapInArrow(lean(_sharp(width)), "doc_id long, sig binary")
            sharp = texts.where("sig is not null").select("doc_id", F.col("sig").alias("sharp")).distinct()
            own, enough = sigs.join(sharp, "doc_id").select("doc_id", F.concat("sig", "sharp").alias("sig")), _least(per / of, SHARP)
        rest = rest.join(own, "doc_id").withColumn("p", F.pmod(F.xxhash64("doc_id"), F.col("g")).cast("int"))
        squares = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda q: F.struct(F.least("p", q).alias("i"), F.greatest("p", q).alias("j"), F.when(q == F.col("p"), 2).when(F.col("p") < q, 0).otherwise(1).alias("side")))
        rest = rest.withColumn("s", F.explode(squares)).select("key", "doc_id", "c", "sig", F.col("s.i").alias("i"), F.col("s.j").alias("j"), F.col("s.side").alias("side"))
        more = rest.groupBy("key", "i", "j").applyInArrow(_across(enough, best), "a long, b long").where("a <> b").distinct()
        more = saved(more if tried is None else more.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = more
        dropped(at)
        if not more.isEmpty():
            links = links.unionByName(confirmed(more))
            found = saved(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "found")

    for used in (members, sigs, links):
        dropped(used)
    whole = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    # texts without words have no fp; a key of their own keeps them from meeting in one task
    own = prints.withColumn("fp", F.coalesce("fp", F.concat(F.lit("-"), F.coalesce(F.col("doc_id"), F.lit(0)).cast("string")).cast("binary")))
    out = own.join(whole, "fp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def kept_documents(docs: DataFrame, width: int = 5, per: int = 80, of: int = 100) -> DataFrame:
    """docs without the near-duplicates: of each component the document with the smallest doc_id stays, with all its columns."""
    gone = near_duplicates(docs, width, per, of).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))  # no name of docs clashes
    return rows.join(gone, F.col("_row.doc_id") == F.col("_gone"), "left_anti").select("_row.*")
