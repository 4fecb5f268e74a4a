"""Removal of repeated byte strings by a sparse suffix array over the whole corpus.

Every string of LENGTH bytes has a least GRAM-byte gram (by hash), a property of the string alone. Consecutive strings of
a document with the same least gram make a run. So equal strings lie in runs of equal grams, and one suffix for each run,
not one for each byte, has to travel.

1. Blocks of documents send the distinct least grams they hold to shards; a shard says which occur in several documents.
2. A run on such a gram stands for the suffix that starts at its gram. Suffixes are range-partitioned by their own leading
   8 bytes at sampled splitters. A splitter that repeats marks heavy leading bytes: suffixes with these go on as single
   strings, dealt by the strings' hashes among the buckets that the splitter spans, so no one of them gets a heavy suffix
   whole. Equal runs of a block travel once, with the smallest doc_id, so a passage that a third of all documents hold
   reaches a bucket once a block.
3. A bucket folds equal runs of all blocks into one and sorts the strings of its suffixes by multikey quicksort over 8-byte
   symbols, in pieces that end between unlike first symbols, compares neighbours, and answers each run with the smallest
   doc_id of each of its strings. Strings that are equal have equal grams, so they never lie on both sides of a bucket's or a
   piece's boundary; what lies next to one need not be compared across it, and strings of a gram that only one run is left
   with need no sorting.
4. Blocks mark what their documents repeat from a smaller doc_id.

Null texts are empty. A null doc_id stands after all others. Rows with equal doc_id don't repeat each other.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, Route, block_count, blocked, frugal, mix, pack, pack_bytes, unpack, unpack_bytes

#: String length in bytes, gram length, text bytes in a block, text bytes hashed at a time, documents sampled for splitters.
LENGTH, GRAM, BLOCK_BYTES, PIECE, SAMPLE = 50, 20, 8 << 20, 1 << 18, 2000
#: Strings in one run at most; longer stretches of one gram (as in "aaaa...") continue in a further run.
RUN = 256

_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_U = np.uint64


@lru_cache(4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=_U)


def _power(base: np.uint64, n: int) -> np.ndarray:
    """The first n powers; tables of a few sizes are remembered."""
    return _powers(int(base), 1 << max(18, (n - 1).bit_length()))[:n]


def symbols(data: np.ndarray) -> np.ndarray:
    """At each place the 8 bytes from there on, as a number that sorts like the bytes; zeros follow the end."""
    padded = np.append(data, np.zeros(7, np.uint8))
    return np.ndarray(len(data), ">u8", padded, strides=(1,)).astype(_U)


def leads(data: np.ndarray, at: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """The first 8 bytes of the gram (by its hash) in the string at each place; it is there, or the place doesn't matter."""
    out = np.zeros(len(at), _U)
    width = LENGTH - GRAM + 1
    for lo in range(0, len(at), 1 << 14):
        rows = data[at[lo : lo + (1 << 14), None] + np.arange(LENGTH)]
        sums = np.zeros((len(rows), LENGTH + 1), _U)
        np.cumsum(_BYTE[rows] * _power(_BASE, LENGTH), axis=1, out=sums[:, 1:])
        grams = mix((sums[:, GRAM:] - sums[:, :-GRAM]) * _power(_BACK, width))
        place = (grams == gram[lo : lo + (1 << 14), None]).argmax(1)
        for k in range(8):
            out[lo : lo + (1 << 14)] |= rows[np.arange(len(rows)), place + k].astype(_U) << _U(56 - 8 * k)
    return out


def runs(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The runs of the texts: doc (place in texts), start and n (the strings start .. start + n - 1), gram (hash), same
    (hash of gram and bytes)."""
    out = {k: [] for k in ("doc", "start", "n", "gram", "same")}
    group, size = [], 0
    for i, text in enumerate(texts):
        if len(text) >= LENGTH:
            group.append(i)
            size += len(text)
        if group and (size >= PIECE or i + 1 == len(texts)):
            _runs(group, texts, out)
            group, size = [], 0
    if group:
        _runs(group, texts, out)
    return {k: np.concatenate(v) if v else np.zeros(0, _U if k in ("gram", "same") else np.int64) for k, v in out.items()}


def _runs(group: list[int], texts: list[bytes], out: dict) -> None:
    data = np.frombuffer(b"".join(texts[i] for i in group), np.uint8)
    sizes = np.array([len(texts[i]) for i in group])
    begin = np.cumsum(sizes) - sizes
    back = _power(_BACK, len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=sums[1:])
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * back[: len(data) - GRAM + 1])
    width, least, upto = LENGTH - GRAM + 1, grams, 1
    while upto < width:
        step = min(upto, width - upto)
        least = np.minimum(least[:-step], least[step:])
        upto += step
    edge = np.zeros(len(data) + 1, np.int8)  # strings within one document
    edge[begin] = 1
    edge[begin + sizes - LENGTH + 1] -= 1
    valid = np.cumsum(edge[: len(least)], dtype=np.int8) > 0
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
    at = np.flatnonzero(new & valid)
    ends = np.flatnonzero(valid & np.append(new[1:] | ~valid[1:], True)) + 1
    n = ends - at
    if len(n) and n.max() > RUN:
        parts = -(-n // RUN)
        first = np.repeat(np.cumsum(parts) - parts, parts)
        k = np.arange(len(first)) - first
        at, left = np.repeat(at, parts) + k * RUN, np.repeat(n, parts) - k * RUN
        n = np.minimum(left, RUN)
    doc = np.searchsorted(begin, at, "right") - 1
    own = mix((sums[at + n + LENGTH - 1] - sums[at]) * back[at])
    for k, v in (("doc", np.array(group)[doc]), ("start", at - begin[doc]), ("n", n), ("gram", least[at]), ("same", mix(own + least[at] + n.astype(_U)))):
        out[k].append(v)


def _texts(t: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    """Ids and texts of a block by id and text: the same order each time, however its rows arrive."""
    rows = sorted(zip([NO_ID if x is None else x for x in t.column("doc_id").to_pylist()], [x or b"" for x in t.column("text").to_pylist()], strict=True))
    return np.array([r[0] for r in rows], np.int64), [r[1] for r in rows]


def _ask_grams(shards: int):
    def run(t: pa.Table) -> pa.Table:
        ids, texts = _texts(t)
        r = runs(texts)
        keys, at = np.unique(r["gram"], return_inverse=True)
        lo, hi = np.full(len(keys), NO_ID), np.full(len(keys), np.iinfo(np.int64).min)
        np.minimum.at(lo, at, ids[r["doc"]])
        np.maximum.at(hi, at, ids[r["doc"]])
        several = (lo != hi).astype(np.uint8)
        cut = np.append(np.searchsorted(keys, np.array([(s << 64) // shards for s in range(shards)], _U)), len(keys))
        some = [s for s in range(shards) if cut[s + 1] > cut[s]]
        return pa.table({"_b": pa.array([t.column("_b")[0].as_py()] * len(some), pa.int64()), "shard": pa.array(some, pa.int32()), "keys": pa.array([pack(keys[cut[s] : cut[s + 1]], delta=True) for s in some], pa.binary()), "several": pa.array([pack(several[cut[s] : cut[s + 1]]) for s in some], pa.binary())})

    return run


def _answer_grams(t: pa.Table) -> pa.Table:
    rows = t.to_pylist()
    keys = [unpack(r["keys"], np.uint64, delta=True) for r in rows]
    several = np.concatenate([unpack(r["several"], np.uint8) for r in rows])
    _, at, blocks = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    shared = blocks > 1
    shared[at[several > 0]] = True
    out, ends = shared[at], np.cumsum([len(x) for x in keys])
    bits = [np.packbits(out[e - len(x) : e]) for e, x in zip(ends, keys, strict=True)]
    return pa.table({"_b": pa.array([r["_b"] for r in rows], pa.int64()), "shard": pa.array([r["shard"] for r in rows], pa.int32()), "n": pa.array([len(x) for x in keys], pa.int64()), "bits": pa.array([pack(x) for x in bits], pa.binary())})


def _singled(r: dict, heavy: np.ndarray, lo: np.ndarray, hi: np.ndarray, whole: np.ndarray, begin: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
    """The runs with the heavy ones as single strings, by document and start; lo and hi, the buckets of each, go along."""
    n = np.where(heavy, r["n"], 1)
    of = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    out = {c: v[of] for c, v in r.items()}
    out["start"] = out["start"] + k
    one = heavy[of]
    out["n"] = np.where(one, 1, out["n"])
    at = begin[out["doc"][one]] + out["start"][one]
    out["same"][one] = np.concatenate([mix((_BYTE[whole[at[i : i + (1 << 14), None] + np.arange(LENGTH)]] * _power(_BASE, LENGTH)).sum(1, dtype=_U)) for i in range(0, len(at), 1 << 14)])
    return out, lo[of], hi[of]


def _ask_runs(splitters: np.ndarray):
    def run(t: pa.Table, bits: pa.Table) -> pa.Table:
        ids, texts = _texts(t)
        r = runs(texts)
        keys, at = np.unique(r["gram"], return_inverse=True)
        said = sorted(bits.to_pylist(), key=lambda x: x["shard"])
        shared = np.concatenate([np.unpackbits(unpack(x["bits"], np.uint8), count=x["n"]) for x in said]) > 0 if said else np.zeros(0, bool)
        hot = np.flatnonzero(shared[at])
        r = {k: v[hot] for k, v in r.items()}
        begin = np.cumsum([0, *map(len, texts)])
        whole = np.frombuffer(b"".join(texts), np.uint8)
        # equal runs travel once, with their smallest doc_id
        _, rep, at = np.unique(r["same"], return_index=True, return_inverse=True)
        lead = leads(whole, begin[r["doc"][rep]] + r["start"][rep] + r["n"][rep] - 1, r["gram"][rep])  # it is in the last string
        lo, hi = (np.searchsorted(splitters, lead, side) for side in ("left", "right"))
        if (hi > lo).any():
            r, lo, hi = _singled(r, (hi > lo)[at], lo[at], hi[at], whole, begin)
            _, rep, at = np.unique(r["same"], return_index=True, return_inverse=True)
            lo, hi = lo[rep], hi[rep]
        least = np.full(len(rep), NO_ID)
        np.minimum.at(least, at, ids[r["doc"]])
        bucket = lo + (r["same"][rep] % (hi - lo + 1).astype(_U)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        home = np.empty(len(rep), np.int64)
        home[order] = np.arange(len(rep))
        mine = home[at]  # of each hot run: its place among the runs as sent
        out = {"bucket": [], "at": [], "n": [], "doc": [], "data": [], "hot": []}
        for b in np.unique(bucket):
            part = order[slice(*np.searchsorted(bucket[order], [b, b + 1]))]
            j = rep[part]
            data = b"".join(texts[d][s : s + n + LENGTH - 1] for d, s, n in zip(r["doc"][j].tolist(), r["start"][j].tolist(), r["n"][j].tolist(), strict=True))
            for c, v in zip(out, (b, int(home[part[0]]), pack(r["n"][j].astype(np.uint16)), pack(least[part]), pack_bytes(data), None), strict=True):
                out[c].append(v)
        if out["bucket"]:  # which runs were sent, for the last step: goes with the first bucket's rows and back
            parts = [pack(r["doc"].astype(np.int64), delta=True), pack(r["start"].astype(np.uint32)), pack(r["n"].astype(np.uint16)), pack(mine.astype(np.uint32))]
            out["hot"][0] = b"".join(len(x).to_bytes(8, "little") + x for x in parts)
        n = len(out["bucket"])
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.table({"_b": pa.array([t.column("_b")[0].as_py()] * n, pa.int64())} | {c: pa.array(v, kind) for (c, v), kind in zip(out.items(), kinds, strict=True)})

    return run


def multikey_groups(symbol: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The places `at` in order of the `length` bytes from each on, and the first sorted place of each one's equals.

    Multikey quicksort with symbols of 8 bytes: what ties on one symbol is sorted by the next. A group whose members all
    equal its first one is settled as a whole, as are single ones."""
    order = np.argsort(symbol[at])
    first = symbol[at[order]]
    steps = [*range(8, length - 7, 8), *([length - 8] if length % 8 else [])]
    head = np.flatnonzero(np.append(True, first[1:] != first[:-1])) if len(at) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(at)))
    group = np.repeat(head, size)
    todo = np.flatnonzero(np.repeat(size > 1, size))  # sorted places that may still move
    for i, k in enumerate(steps):
        if not len(todo):
            break
        same, own, first = np.ones(len(todo), bool), at[order[todo]], at[order[group[todo]]]
        for j in steps[i:]:
            same &= symbol[own + j] == symbol[first + j]
        heads = np.flatnonzero(np.append(True, group[todo][1:] != group[todo][:-1]))
        mixed = ~np.logical_and.reduceat(same, heads)
        todo = todo[np.repeat(mixed, np.diff(np.append(heads, len(todo))))]
        if not len(todo):
            break
        value = symbol[at[order[todo]] + k]
        by = np.lexsort((value, group[todo]))
        order[todo], value, own = order[todo][by], value[by], group[todo]
        heads = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (value[1:] != value[:-1])))
        size = np.diff(np.append(heads, len(todo)))
        group[todo] = np.repeat(todo[heads], size)
        todo = todo[np.repeat(size > 1, size)]
    return order, group


def _equal_runs(symbol: np.ndarray, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of one run of each content, and of each run its place among these. The first and the last string together hold
    all bytes of a run of up to LENGTH + 1 strings; longer ones stay apart."""
    ends = []
    for at in (begin, begin + n - 1):
        order, group = multikey_groups(symbol, at, LENGTH)
        ends.append(np.empty(len(at), np.int64))
        ends[-1][order] = group
    long = n > LENGTH + 1
    key = [np.where(long, np.arange(len(n)), ends[0]), np.where(long, -1, ends[1]), n]
    order = np.lexsort(key)
    new = np.append(True, np.any([k[order[1:]] != k[order[:-1]] for k in key], 0)) if len(n) else np.zeros(0, bool)
    of = np.empty(len(n), np.int64)
    of[order] = np.cumsum(new) - 1
    return order[new], of


def _least_grams(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The hash of the least gram of the string at each place."""
    out = np.empty(len(at), _U)
    for lo in range(0, len(at), 1 << 12):
        rows = data[at[lo : lo + (1 << 12), None] + np.arange(LENGTH)]
        sums = np.zeros((len(rows), LENGTH + 1), _U)
        np.cumsum(_BYTE[rows] * _power(_BASE, LENGTH), axis=1, out=sums[:, 1:])
        out[lo : lo + (1 << 12)] = mix((sums[:, GRAM:] - sums[:, :-GRAM]) * _power(_BACK, LENGTH - GRAM + 1)).min(1)
    return out


#: Bytes of runs for each piece that a bucket sorts at a time.
SORT_BYTES = 8 << 20


def _answer_runs(t: pa.Table) -> pa.Table:
    rows = t.to_pylist()
    n = [unpack(r["n"], np.uint16).astype(np.int64) for r in rows]
    counts, doc = np.concatenate(n), np.concatenate([unpack(r["doc"], np.int64) for r in rows])
    data = np.frombuffer(b"".join(unpack_bytes(r["data"]) for r in rows), np.uint8)
    begin = np.cumsum(counts + LENGTH - 1) - (counts + LENGTH - 1)
    symbol = symbols(data)
    # equal runs of all blocks are one
    rep, of = _equal_runs(symbol, begin, counts)
    doc, low = doc[rep], doc
    np.minimum.at(doc, of, low)
    begin, own = begin[rep], counts[rep]
    first = np.cumsum(own) - own
    least = np.repeat(doc, own)
    # strings of a gram that no other content has are nowhere else, the others are sorted
    _, gram, contents = np.unique(_least_grams(data, begin), return_inverse=True, return_counts=True)
    several = np.flatnonzero(contents[gram] > 1)
    some = own[several]
    place = np.repeat(first[several] - (np.cumsum(some) - some), some) + np.arange(some.sum())
    at = np.repeat(begin[several] - first[several], some) + place
    # pieces are ranges of the first symbol: equal strings fall in the same piece
    pieces = max(1, -(-int((some + LENGTH - 1).sum()) // SORT_BYTES))
    edges = np.sort(symbol[at[:: max(1, len(at) // (256 * pieces))]]) if pieces > 1 else symbol[:0]
    edges = np.unique(edges[(np.arange(1, pieces) * len(edges)) // pieces])
    piece = np.searchsorted(edges, symbol[at], "right") if len(edges) else np.zeros(len(at), np.int64)
    for p in range(len(edges) + 1):
        own = np.flatnonzero(piece == p)
        if len(own):
            order, group = multikey_groups(symbol, at[own], LENGTH)
            head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            sorted_ = place[own[order]]
            least[sorted_] = np.repeat(np.minimum.reduceat(least[sorted_], head), np.diff(np.append(head, len(own))))
    # each run gets its strings' answers, which differ little from string to string
    least = least[np.repeat(first[of] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
    ends = np.cumsum([x.sum() for x in n])
    answers = [pack(least[e - x.sum() : e], delta=True) for e, x in zip(ends, n, strict=True)]
    return pa.table({"_b": pa.array([r["_b"] for r in rows], pa.int64()), "bucket": pa.array([r["bucket"] for r in rows], pa.int32()), "at": pa.array([r["at"] for r in rows], pa.int64()), "n": pa.array([r["n"] for r in rows], pa.binary()), "least": pa.array(answers, pa.binary()), "hot": pa.array([r["hot"] for r in rows], pa.binary())})


def _apply(with_text: bool):
    def run(t: pa.Table, answers: pa.Table) -> pa.Table:
        ids, texts = _texts(t)
        gone: dict[int, np.ndarray] = {}
        said = sorted(answers.to_pylist(), key=lambda x: x["at"])
        if said:
            sent, own = next(x["hot"] for x in said if x["hot"]), []
            while sent:
                size = 8 + int.from_bytes(sent[:8], "little")
                own.append(sent[8:size])
                sent = sent[size:]
            at, first_string, count, mine = unpack(own[0], np.int64, delta=True), *(unpack(x, kind).astype(np.int64) for x, kind in zip(own[1:], (np.uint32, np.uint16, np.uint32), strict=True))
            n = np.concatenate([unpack(x["n"], np.uint16).astype(np.int64) for x in said])
            least = np.concatenate([unpack(x["least"], np.int64, delta=True) for x in said])
            first = np.cumsum(n) - n
            whose = np.repeat(np.arange(len(at)), count)
            k = np.arange(len(whose)) - np.repeat(np.cumsum(count) - count, count)
            doc = at[whose]
            hit = least[first[mine[whose]] + k] < ids[doc]
            doc, start = doc[hit], (first_string[whose] + k)[hit]  # by document, as the runs are
            head = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
            gone = {int(doc[a]): start[a:b] for a, b in zip(head, np.append(head, len(doc))[1:], strict=True)}
        out = {"doc_id": [None if i == NO_ID else i for i in ids.tolist()], "n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
        for i, text in enumerate(texts):
            kept, spans = text, 0
            if i in gone:
                edge = np.zeros(len(text) + 1, np.int32)
                edge[gone[i]] = 1  # each string's place comes once
                edge[gone[i] + LENGTH] -= 1
                covered = np.cumsum(edge[:-1]) > 0
                kept = np.frombuffer(text, np.uint8)[~covered].tobytes()
                spans = int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum())
            for c, v in (("n_bytes", len(text)), ("n_removed", len(text) - len(kept)), ("n_spans", spans), ("kept", kept if with_text else hashlib.sha256(kept).hexdigest())):
                out[c].append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary() if with_text else pa.string())
        return pa.table({c: pa.array(v, kind) for (c, v), kind in zip(out.items(), kinds, strict=True)})

    return run


def _leads(batches):
    for batch in batches:
        texts = [x or b"" for x in batch.column(0).to_pylist()]
        r = runs(texts)
        own = np.arange(0, len(r["n"]), max(1, len(r["n"]) // (64 * max(1, batch.num_rows))))
        begin = np.cumsum([0, *map(len, texts)])
        pick = leads(np.frombuffer(b"".join(texts), np.uint8), begin[r["doc"][own]] + r["start"][own] + r["n"][own] - 1, r["gram"][own])
        yield pa.RecordBatch.from_arrays([pa.array(pick.view(np.int64), pa.int64())], names=["lead"])


def without_repeats(docs: DataFrame, with_text: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_bytes, n_removed, n_spans, kept: each byte goes that a string of LENGTH bytes
    covers which also starts in a document with a smaller doc_id, judged on the input. kept: the remaining bytes, or the
    hex sha256 of them. Splitters come from about SAMPLE documents, 64 grams each; they steer the load, not the result.
    An empty table gives an empty one; extra columns are ignored."""
    spark = docs.sparkSession
    docs = frugal(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    n = block_count(docs, "text", block_bytes)
    count = docs.count()
    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("splitters")), F.lit(max(1, count // SAMPLE))) == 0)
    # gathered in one pass; a limit that is collected reads a part of the table after another
    found = np.sort(np.array(some.select("text").mapInArrow(_leads, "lead long").limit(128 * SAMPLE).agg(F.collect_list("lead")).first()[0], np.int64).view(_U))
    splitters = found[(np.arange(1, n) * len(found)) // n] if len(found) else found
    shared = spark.sparkContext.broadcast(splitters)  # n numbers
    dealt = blocked(docs, n)
    route = Route(n)
    grams = route.send(dealt.groupBy("_b"), _ask_grams(n), "_b long, shard int, keys binary, several binary", "_b", "shard")
    bits = route.send(grams.groupBy("shard"), route.open(_answer_grams), "_b long, shard int, n long, bits binary", "shard", "_b")
    runs_asked = route.send(dealt.groupBy("_b").cogroup(bits.groupBy("_b")), route.open(lambda t, b: _ask_runs(shared.value)(t, b)), "_b long, bucket int, at long, n binary, doc binary, data binary, hot binary", "_b", "bucket")
    # buckets are small as packed and long to sort, so they are not put together by size
    answers = route.send(runs_asked.repartition(n, "bucket").groupBy("bucket"), route.open(_answer_runs), "_b long, bucket int, at long, n binary, least binary, hot binary", "bucket", "_b")
    return dealt.groupBy("_b").cogroup(answers.groupBy("_b")).applyInArrow(route.open(_apply(with_text)), f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {'binary' if with_text else 'string'}")
