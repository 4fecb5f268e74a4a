"""Near-duplicate vectors by collision counting over sorted one-dimensional projections.

Equal vectors fold into classes. Each class is projected on many random lines. A table orders the classes by the signs of a
few lines (each a window open to one side) and then by the value on one more; a query-centred window of half width WIDTH on
that value collides with its neighbours of the same signs. A pair's collisions are counted over all tables, and no single one
selects a pair: it has to reach a count, COUNT or more, calibrated for RECALL at the threshold. Then it is verified in double
precision.

The signs grow with the logarithm of the number of classes, so a cell keeps about CELL of unrelated ones, and the tables grow
to keep the recall. A cell that a large group fills is dealt in squares of SIDE members, each a task's size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, give_back, lean, mix, pack, partitions, saved, unpack
from .components import components

RECALL, STRAY, COUNT, CELL, WIDTH, SIDE = 0.995, 0.01, 4, 48, 0.75, 2048


def calibrated(classes: int, cosine: float) -> tuple[int, int, int]:
    """(signs, tables, count): the fewest tables, and the largest count, for which a pair at the threshold reaches the count
    with RECALL while a pair at right angles reaches it with STRAY at most."""
    signs = max(0, math.ceil(math.log2(max(1, classes) / CELL)))
    collide = lambda c: (1 - math.acos(c) / math.pi) ** signs * math.erf(WIDTH / math.sqrt(2 - 2 * c) / math.sqrt(2))
    below = lambda m, c, p: sum(math.comb(m, k) * p**k * (1 - p) ** (m - k) for k in range(c))
    near, far, tables, count = collide(cosine), collide(0.0), COUNT, 0
    while True:
        while below(tables, count + 1, near) <= 1 - RECALL:
            count += 1
        if count >= COUNT and 1 - below(tables, count, far) <= STRAY:
            return signs, tables, count
        tables += 1


#: Vectors projected at a time.
SLICE = 512


def _unit(column) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cells(signs: int, tables: int):
    def run(batches):
        lines = None
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                x = _unit(batch.column("embedding"))
                if lines is None:
                    lines = np.random.default_rng(20240229).standard_normal((x.shape[1], tables * (signs + 1)))
                v = (x @ lines).reshape(len(x), tables, signs + 1)
                cell = ((v[:, :, 1:] > 0) * (1 << np.arange(signs, dtype=np.int64))).sum(2) if signs else np.zeros(v.shape[:2], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("vec_id").to_numpy(), tables)), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(x))), pa.array(cell.ravel()), pa.array(v[:, :, 0].ravel())], names=["vec_id", "t", "cell", "value"])

    return lean(run)


def _collide(parts: int):
    """The colliding pairs of a group of cells, or of one square of a large cell, packed by the part that counts them."""

    def run(t: pa.Table) -> pa.Table:
        ids, cell, value, side = (t.column(c).to_numpy() for c in ("vec_id", "cell", "value", "side"))
        rank = np.unique(cell, return_inverse=True)[1]
        span = float(value.max() - value.min()) + 4 * WIDTH + 1
        key = rank * span + value
        order = np.argsort(key, kind="stable")
        ids, key, side = ids[order], key[order], side[order]
        n = np.searchsorted(key, key + WIDTH, "right") - np.arange(len(key)) - 1
        i = np.repeat(np.arange(len(key)), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        ok = (side[i] != side[j]) | (side[i] == 2)  # in a square off the diagonal, across its sides only
        a, b = np.minimum(ids[i], ids[j])[ok], np.maximum(ids[i], ids[j])[ok]
        part = (mix(a.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        a, b, part = a[by], b[by], part[by]
        own = np.unique(part)
        cut = np.append(np.searchsorted(part, own), len(part))
        return pa.table({"part": pa.array(own, pa.int64()), "a": pa.array([pack(a[x:y]) for x, y in zip(cut, cut[1:])], pa.binary()), "b": pa.array([pack(b[x:y]) for x, y in zip(cut, cut[1:])], pa.binary())})

    return run


def _count(least: int):
    def run(t: pa.Table) -> pa.Table:
        a, b = (np.concatenate([unpack(x, np.int64) for x in t.column(c).to_pylist()]) for c in "ab")
        by = np.lexsort((b, a))
        a, b = a[by], b[by]
        head = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        keep = head[np.diff(np.append(head, len(a))) >= least]
        give_back()
        return pa.table({"a": pa.array(a[keep]), "b": pa.array(b[keep])})

    return run


def _verified(cosine: float):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array((_unit(batch.column("xa")) * _unit(batch.column("xb"))).sum(1) >= cosine)).select(["a", "b"])

    return lean(run)


def near_vectors(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """vectors (vec_id, embedding, ...) -> vec_id, n_links, component_id, kept, one row each.

    Vectors that are null or zero, hold null or non-finite numbers, or have a null vec_id link with nothing. Only vectors of
    one length compare. Rows with equal vectors are copies of each other; rows that share a vec_id are one vector, linked by any
    of its rows. An empty table gives an empty one; extra columns are ignored."""
    spark = vectors.sparkSession
    rows = frugal(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.size("embedding") > 0
    fine &= F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull())
    classes = saved(rows.where("fine").groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")), "classes")
    links = None
    for size in [r["n"] for r in classes.select(F.size("embedding").alias("n")).distinct().collect()]:  # vectors' lengths: one, as a rule
        found = _pairs(classes.where(F.size("embedding") == size), cosine)
        links = found if links is None else links.unionByName(found)
    if links is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = saved(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "found")
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(classes.select(F.col("vec_id").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("near"))
    whole = classes.join(near, F.col("a") == F.col("vec_id"), "left").join(found, F.col("node") == F.col("vec_id"), "left")
    whole = whole.select(F.col("embedding").alias("e"), (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n"), F.coalesce("component_id", "vec_id").alias("c"))
    out = rows.join(whole, F.col("fine") & (F.col("embedding") == F.col("e")), "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _pairs(classes: DataFrame, cosine: float) -> DataFrame:
    parts = partitions(classes.sparkSession)
    signs, tables, count = calibrated(classes.count(), cosine)
    low = max(0, signs - 5)  # cells go to tasks in groups of 2**low
    rows = saved(classes.select("vec_id", "embedding").mapInArrow(_cells(signs, tables), "vec_id long, t int, cell long, value double"), "cells")
    large = rows.groupBy("t", "cell").agg(F.count("*").alias("k")).where(F.col("k") > SIDE // 4).select("t", "cell", F.ceil(F.col("k") / (SIDE // 4)).cast("int").alias("g"))
    at = rows.join(large, ["t", "cell"], "left")
    group = F.shiftright("cell", low) if low else F.col("cell")
    mine = F.pmod(F.xxhash64("vec_id"), F.col("g")).cast("int")
    squares = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda q: F.struct(F.concat_ws(":", "cell", F.least("p", q), F.greatest("p", q)).alias("group"), F.when(q == F.col("p"), 2).when(F.col("p") < q, 0).otherwise(1).alias("side")))
    one = F.array(F.struct(group.cast("string").alias("group"), F.lit(2).alias("side")))
    at = at.withColumn("p", mine).withColumn("s", F.explode(F.when(F.col("g").isNull(), one).otherwise(squares)))
    packed = at.select("t", F.col("s.group").alias("group"), "vec_id", "cell", "value", F.col("s.side").alias("side")).groupBy("t", "group").applyInArrow(_collide(parts), "part long, a binary, b binary")
    pairs = packed.groupBy("part").applyInArrow(_count(count), "a long, b long")
    x, y = (classes.select(F.col("vec_id").alias(k), F.col("embedding").alias(f"x{k}")) for k in "ab")
    return saved(pairs.join(x, "a").join(y, "b").select("a", "b", "xa", "xb").mapInArrow(_verified(cosine), "a long, b long"), "links")
