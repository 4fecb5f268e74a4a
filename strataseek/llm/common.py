"""What the operators of this package share: tables in the shared folder, document blocks, packed columns of numbers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import inspect
import math
import re
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands in for a null doc_id where ids are compared; larger than any id.
NO_ID = np.iinfo(np.int64).max


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one, but only if Spark runs in this process, as in
    tests: the machines of a cluster wouldn't see each other's."""
    path = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="strataseek-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read again: its lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes the files of a table made by saved() that nothing will read again."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended: whoever owns the folder clears it
        pass


#: Rows, and bytes of rows, that go to a Python worker at a time.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def frugal(df: DataFrame) -> DataFrame:
    """df; from here on its session sends at most BATCH_ROWS rows and BATCH_BYTES bytes (or one row) a batch to Python, which
    bounds both sides' memory. Spark reads these settings when a query runs, so they stay; lower ones are left alone."""
    for name, most in (("Records", BATCH_ROWS), ("Bytes", BATCH_BYTES)):
        conf = f"spark.sql.execution.arrow.max{name}PerBatch"
        now = re.fullmatch(r"(-?\d+)[bB]?", str(df.sparkSession.conf.get(conf)))  # one with a unit was set by hand
        if now and not 0 < int(now[1]) <= most:
            df.sparkSession.conf.set(conf, most)
    return df


def same_columns(docs: DataFrame, run) -> DataFrame:
    """docs.mapInArrow(run) with the columns that docs have, whatever their names hold; run sees them by place."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def lean(run):
    """run, an iterator function; afterwards the worker, which Spark keeps for later stages, gives its free
    memory back to the system."""

    def over_batches(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return over_batches


def give_back() -> None:
    """This process's free memory goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def block_count(docs: DataFrame, column: str, block_bytes: int) -> int:
    """Blocks of about block_bytes each, and at least as many as shuffle partitions; grows with the input."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(column))), F.lit(0)).alias("n")).first()["n"]
    return max(partitions(docs.sparkSession), math.ceil(total / block_bytes), 1)


#: Blocks that get a name each.
NAMED = 4096


def blocked(docs: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """docs dealt to n blocks by a hash of key; column _b names the block.

    Up to NAMED blocks, the values of _b are chosen so that Spark's own hash sends each to another partition. Beyond, they are
    plain numbers, of which a partition gets one or a few: so many tasks even out, and no plan holds a literal a block."""
    spark = docs.sparkSession
    if n > NAMED:
        return docs.withColumn("_b", F.pmod(F.xxhash64(F.col(key), F.lit("block")), F.lit(n))).repartition(n, "_b")
    place = F.pmod(F.hash(F.col("id")), F.lit(n))
    names, upto = {}, 0
    while len(names) < n:
        lo, upto = upto, max(upto * 2, 16 * n)
        for r in spark.range(lo, upto, 1, 1).groupBy(place.alias("p")).agg(F.min("id").alias("id")).collect():  # n rows at most
            names.setdefault(r["p"], r["id"])
    ids = F.array(*[F.lit(names[i]).cast("long") for i in range(n)])
    slot = F.pmod(F.xxhash64(F.col(key), F.lit("block")), F.lit(n)).cast("int")
    return docs.withColumn("_b", F.get(ids, slot)).repartition(n, "_b")


class Route:
    """How n blocks and as many shards write to each other. Every block has something for nearly every shard, n * n parcels. Up
    to NAMED blocks they go as rows. Beyond, a block's parcels for a lane of FAN neighbouring shards go as one row; the rows of
    FAN neighbouring blocks for a lane meet and are repacked as one row for each of its shards. So n * n / FAN rows travel, twice,
    and a row keeps its size however many blocks there are, as FAN grows with the root of n."""

    def __init__(self, n: int):
        self.fan = math.isqrt(n - 1) + 1 if n > NAMED else 0

    def send(self, groups, run, schema: str, sender: str, receiver: str) -> DataFrame:
        """groups (grouped, or cogrouped, by sender) with run applied, whose rows name sender and receiver by numbers below
        n -> rows by receiver, for open()."""
        if not self.fan:
            return groups.applyInArrow(run, schema)
        fan = self.fan

        def bundled(t: pa.Table) -> pa.Table:
            lane = np.asarray(t.column(receiver)) // fan
            own = np.unique(lane)
            whose = t.column(sender)[0].as_py() // fan if len(own) else 0
            return pa.table({"lane": pa.array(own, pa.int64()), "part": pa.array([whose] * len(own), pa.int64()), "data": pa.array([_written(t.filter(pa.array(lane == x))) for x in own], pa.binary())})

        def repacked(t: pa.Table) -> pa.Table:
            rows = pa.concat_tables([_read(x) for x in t.column("data").to_pylist()])
            to = np.asarray(rows.column(receiver))
            own = np.unique(to)
            return pa.table({receiver: pa.array(own, pa.int64()), "data": pa.array([_written(rows.filter(pa.array(to == x))) for x in own], pa.binary())})

        first = groups.applyInArrow((lambda t: bundled(run(t))) if _arguments(run) == 1 else (lambda t, u: bundled(run(t, u))), "lane long, part long, data binary")
        return first.groupBy("lane", "part").applyInArrow(lambda t: repacked(t), f"{receiver} long, data binary")

    def open(self, run):
        """run, whose last argument is a table of rows that send() gave."""
        if not self.fan:
            return run
        if _arguments(run) == 1:
            return lambda t: run(_unpacked(t))
        return lambda t, u: run(t, _unpacked(u))


def _arguments(run) -> int:
    return len(inspect.signature(run).parameters)


def _written(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def _read(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _unpacked(t: pa.Table) -> pa.Table:
    """The rows of the parcels; a receiver without parcels gets no rows and no columns."""
    return pa.concat_tables([_read(x) for x in t.column("data").to_pylist()]) if t.num_rows else pa.table({})


# Packed columns: numbers as byte planes under zstd. Sorted 64-bit hashes take about 5 bytes each, small counts a fraction of one.


def pack(values: np.ndarray, delta: bool = False) -> bytes:
    values = np.ascontiguousarray(values)
    if delta and len(values):
        values = np.diff(values, prepend=values.dtype.type(0))
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()  # much faster than of the view
    return len(values).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def unpack(data: bytes, dtype, delta: bool = False) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(dtype).itemsize
    if not n:
        return np.zeros(0, dtype)
    planes = np.frombuffer(pa.decompress(data[8:], n * size, codec="zstd"), np.uint8)
    values = np.ascontiguousarray(planes.reshape(size, n).T).view(dtype).reshape(n)
    return np.cumsum(values, dtype=dtype) if delta else values


def pack_bytes(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + (pa.compress(data, codec="zstd", asbytes=True) if data else b"")


def unpack_bytes(data: bytes) -> bytes:
    n = int.from_bytes(data[:8], "little")
    return pa.decompress(data[8:], n, codec="zstd", asbytes=True) if n else b""


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Slots:
    """Vectorised lookup of whole numbers from 0 on by 63-bit keys: an open-addressed table, at most half full."""

    def __init__(self, n: int):
        self.used = 0
        self._make(max(4, (2 * n).bit_length()))

    def _make(self, bits: int) -> None:
        self.bits, self.keys, self.values = bits, np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """keys: distinct, none there yet."""
        self.used += len(keys)
        if 2 * self.used > len(self.keys):
            old = self.keys >= 0
            keys, values = np.concatenate([self.keys[old], keys]), np.concatenate([self.values[old], values])
            self._make((2 * self.used).bit_length())
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]
            won = self.keys[slot] == keys
            self.values[slot[won]] = values[won]
            keys, values, slot = keys[~won], values[~won], (slot[~won] + 1) & (len(self.keys) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        slot = self._slot(keys)
        there, out = self.keys[slot], self.values[slot]
        at = np.flatnonzero((there != keys) & (there >= 0))
        while len(at):
            slot[at] = (slot[at] + 1) & (len(self.keys) - 1)
            there = self.keys[slot[at]]
            out[at] = self.values[slot[at]]
            at = at[(there != keys[at]) & (there >= 0)]
        return out


def crc_mod(doc_id: int | None, mod: int) -> int:
    """crc32 of the id's text, mod; a null id counts as the empty text (0)."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % mod


class Words(dict):
    """word -> local number, given in order of first sight; words as ASCII-lower-cased UTF-8 bytes between ASCII white space."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n

    def numbers(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").lower().split()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def hashes(self) -> np.ndarray:
        import xxhash

        return np.fromiter(map(xxhash.xxh3_64_intdigest, self), np.uint64, len(self))
