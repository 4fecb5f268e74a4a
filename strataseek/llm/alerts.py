"""Alerts for follow-ups that didn't come: a client's error clicks open an obligation that a sale within a day cancels.

Rows arrive in batches, which feed one stateful streaming query in order; it starts anew for each batch on one checkpoint. State
is kept by bucket of clients, not by client. Each batch brings every bucket a tick row with the exact watermark of that batch,
also where the bucket has no events, so deadlines pass without traffic. A bucket keeps a dictionary of its clients' open
obligations and one heap that orders buffered events and deadlines together. Events before the watermark are late; the others
wait in the heap until the watermark has passed them, since a later batch may still bring an earlier one. A deadline whose
obligation was cancelled stays in the heap and is passed over when it comes up. With the last batch comes a second
tick, at the end of time, which empties all buckets.

The rows of a bucket travel as packed numbers, one row for a bucket and an Arrow batch, so a client with a third of all events is
a few rows. Watermarks are maxima by batch, a row for each; nothing else goes to the driver and nothing is broadcast.

Times are wall-clock microseconds since 1970, whatever the session's zone. Rows with a null client or time are no events. Error
clicks that are equal in all of clicks' own columns count once: they come in one batch to one bucket, which tells rows of one
client and time apart by a 64-bit hash of these columns. Sales that are equal count each, which matters to late counts only. A null arrival, or one beyond the span, falls into the last batch, one before the start into the first; a null id is hashed
as the empty text. Other columns are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, shared_folder
from .resampling import CRC, CRC_TABLE

HOUR = 3_600_000_000
CLICK, SALE, DEADLINE, TICK = 0, 1, 2, 3
#: Beyond every time; four times it still is a long.
NEVER = 1 << 60
CLICKS = ["click_id", "ts", "arrived_at", "client_id", "kind", "value", "props"]
#: A tick's client_id is its batch and its time the watermark.
EVENTS = "bucket long, client_id long, time_us long, kind int, row_hash long, batch int"
ALERTS = "batch int, client_id long, opened_us long, due_us long, n_rows long"


def wall_micros(c: Column) -> Column:
    """Microseconds since 1970 of a timestamp as it is written, for timestamps with and without a zone."""
    minutes = F.unix_date(F.to_date(c)).cast("long") * 1440 + F.hour(c) * 60 + F.minute(c)
    return minutes * 60_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


def batch_number(arrived: Column, row_id: Column, batches: int, start_us: int, span_hours: int, delay_hours: int) -> Column:
    hours = F.floor((wall_micros(arrived) - start_us) / F.lit(HOUR)) + delay_hours * (F.crc32(F.coalesce(row_id.cast("string"), F.lit("")).cast("binary")) % 4)
    return F.greatest(F.lit(0), F.least(F.lit(batches - 1), F.floor(hours * batches / span_hours))).cast("int")


def events(clicks: DataFrame, sales: DataFrame, batches: int, start_us: int, span_hours: int, delay_hours: int) -> DataFrame:
    """(client_id, time_us, kind, row_hash, batch) of error clicks and sales; equal clicks have equal hashes."""
    number = lambda i: batch_number(F.col("arrived_at"), F.col(i), batches, start_us, span_hours, delay_hours)
    c = clicks.where("kind = 'error' and client_id is not null and ts is not null")
    s = sales.where("client_id is not null and sold_at is not null")
    c = c.select("client_id", wall_micros(F.col("ts")).alias("time_us"), F.lit(CLICK).alias("kind"), F.xxhash64(*CLICKS).alias("row_hash"), number("click_id").alias("batch"))
    return c.unionByName(s.select("client_id", wall_micros(F.col("sold_at")).alias("time_us"), F.lit(SALE).alias("kind"), F.lit(0).cast("long").alias("row_hash"), number("sale_id").alias("batch")))


class Bucket:
    """What a bucket of clients keeps: open obligations (client -> [opened, clicks]), and a heap of (4 * time + kind, client)."""

    def __init__(self, window_us: int, state: tuple[bytes, bytes] | None = None):
        self.window, self.open, self.heap = window_us, {}, []
        if state:
            kept, heap = (np.frombuffer(x, np.int64).reshape(-1, n).tolist() for x, n in zip(state, (3, 2), strict=True))
            self.open, self.heap = {c: [t, n] for c, t, n in kept}, [(k, c) for k, c in heap]

    def state(self) -> tuple[bytes, bytes]:
        """Deadlines of obligations that are no longer open are left behind. A sorted list is a heap."""
        live = sorted((k, c) for k, c in self.heap if k % 4 != DEADLINE or self._due(c) == k // 4)
        return np.array([(c, t, n) for c, (t, n) in self.open.items()], np.int64).tobytes(), np.array(live, np.int64).tobytes()

    def _due(self, client: int) -> int | None:
        return self.open[client][0] + self.window if client in self.open else None

    def step(self, batch: int, watermark: int, client: np.ndarray, key: np.ndarray) -> list[tuple]:
        """Takes in a batch's events, keys being 4 * time + kind -> rows (batch, client, opened, due, n), late ones first."""
        late = key < 4 * watermark
        out = [(batch, c, -1, -1, n) for c, n in zip(*(x.tolist() for x in np.unique(client[late], return_counts=True)), strict=True)]
        self.heap += zip(key[~late].tolist(), client[~late].tolist(), strict=True)
        heapq.heapify(self.heap)
        while self.heap and self.heap[0][0] < 4 * watermark:
            key_, c = heapq.heappop(self.heap)
            time, kind = divmod(key_, 4)
            held = self.open.get(c)
            if kind == CLICK and held:  # its deadline, had it passed, would have come up before
                held[1] += 1
            elif kind == CLICK:
                self.open[c] = [time, 1]
                heapq.heappush(self.heap, (4 * (time + self.window) + DEADLINE, c))
            elif kind == SALE:
                self.open.pop(c, None)
            elif held and self._due(c) == time:
                out.append((batch, c, held[0], time, held[1]))
                del self.open[c]
        return out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """EVENTS without batch -> for each bucket in an Arrow batch: its rows as client, key and hash, end to end."""
    for b in batches:
        bucket, client, time, kind, row_hash = (c.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns)
        order = np.argsort(bucket, kind="stable")
        own, first = np.unique(bucket[order], return_index=True)
        rows = np.stack([client, time * 4 + kind, row_hash])[:, order]
        data = [x.tobytes() for x in np.split(rows, first[1:], axis=1)] if len(own) else []
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(data, pa.binary())], names=["bucket", "data"])


def _once(client: np.ndarray, key: np.ndarray, row_hash: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without repeats of clicks that are equal in client, time and hash."""
    order = np.lexsort((row_hash, key, client))
    client, key, row_hash = client[order], key[order], row_hash[order]
    same = (client[1:] == client[:-1]) & (key[1:] == key[:-1]) & (row_hash[1:] == row_hash[:-1]) & (key[1:] % 4 == CLICK)
    new = np.append(True, ~same) if len(key) else np.zeros(0, bool)
    return client[new], key[new]


def _stepped(window_us: int):
    def run(key, frames, state):
        parts = [np.frombuffer(x, np.int64).reshape(3, -1) for f in frames for x in f["data"]]
        client, keys, row_hash = np.concatenate(parts, axis=1)
        tick = keys % 4 == TICK
        client_, keys_ = _once(client[~tick], keys[~tick], row_hash[~tick])
        bucket, out = Bucket(window_us, tuple(bytes(x) for x in state.get) if state.exists else None), []
        for batch, watermark in sorted(zip(client[tick].tolist(), (keys[tick] // 4).tolist(), strict=True)):  # the last batch brings two
            out += bucket.step(batch, watermark, client_, keys_)
            client_, keys_ = client_[:0], keys_[:0]
        state.update(bucket.state())
        if out:
            yield pd.DataFrame(out, columns=["batch", "client_id", "opened_us", "due_us", "n_rows"])

    return run


def missing_follow_ups(clicks: DataFrame, sales: DataFrame, batches: int = 8, start: str = "2024-01-01", span_hours: int = 3648, delay_hours: int = 80, slack_hours: int = 96, window_hours: int = 24, buckets: int | None = None) -> DataFrame:
    """clicks and sales, as the shop's tables -> batch, client_id, opened_us, due_us, n_rows: an alert for each obligation that
    no sale cancelled, in the batch whose watermark passed its deadline (`batches` for those left at the end), with its clicks;
    and for each batch and client with late events one row with times of -1 and their number.

    An obligation opens with a click and holds its client's clicks through its deadline, window_hours later; a sale through then
    cancels it; at one time clicks come first. A batch's watermark is the latest event time of the batches before it less
    slack_hours. A row's batch follows from its arrival, in hours since start, later by delay_hours times its hash modulo 4.
    buckets: by default four for each shuffle partition. Every call writes to a new folder in the shared one."""
    spark = clicks.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/follow-ups-{uuid.uuid4().hex}"
    buckets = buckets or 4 * partitions(spark)
    start_us = int(np.datetime64(start, "us").astype(np.int64))
    e = events(clicks, sales, batches, start_us, span_hours, delay_hours).withColumn("bucket", F.pmod(F.xxhash64("client_id"), F.lit(buckets)))
    columns = [x.split()[0] for x in EVENTS.split(", ")]
    e.select(columns).write.partitionBy("batch").parquet(f"{folder}/cut")
    cut = spark.read.schema(EVENTS).parquet(f"{folder}/cut")
    latest = {r["batch"]: r["t"] for r in cut.groupBy("batch").agg(F.max("time_us").alias("t")).collect()}  # a row for each batch
    marks, seen = [], -NEVER
    for b in range(batches):
        marks.append((b, b, seen))
        seen = max(seen, latest[b] - slack_hours * HOUR) if b in latest else seen
    marks.append((batches - 1, batches, NEVER))
    each = F.array(*[F.struct(*[F.lit(x).cast("long").alias(n) for x, n in zip(m, ("batch", "client_id", "time_us"), strict=True)]) for m in marks])
    ticks = spark.range(0, buckets, 1, -(-buckets // 10_000)).select(F.col("id").alias("bucket"), F.inline(each))
    ticks = ticks.select("bucket", "client_id", "time_us", F.lit(TICK).alias("kind"), F.lit(0).cast("long").alias("row_hash"), F.col("batch").cast("int"))
    ticks.write.mode("append").partitionBy("batch").parquet(f"{folder}/cut")

    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(f"{folder}/feed"))
    for b in range(batches):  # a whole batch comes in by one rename
        fs.rename(path(f"{folder}/cut/batch={b}"), path(f"{folder}/feed/batch={b}"))
        feed = spark.readStream.schema(EVENTS).parquet(f"{folder}/feed").select(columns[:-1])
        rows = feed.mapInArrow(_packed, "bucket long, data binary")
        found = rows.groupBy("bucket").applyInPandasWithState(_stepped(window_hours * HOUR), ALERTS, "open binary, heap binary", "append", "NoTimeout")
        found = found.coalesce(spark.sparkContext.defaultParallelism)  # state stays in its partitions; a task for each core writes
        query = found.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/alerts").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(ALERTS).parquet(f"{folder}/alerts")


_NUMBER = f"least(7, ((epoch_us(arrived_at) - epoch_us(timestamp '2024-01-01')) // {HOUR} + 80 * ({CRC.format("list_transform(string_split(coalesce({}::varchar, ''), ''), lambda x: ascii(x)::ubigint)")} % 4)::bigint) * 8 // 3648)::int as batch"

#: Obligations by chasing pointers: from a client's first click to the first click after what ended its obligation, and so on.
ORACLE = f"""with recursive {CRC_TABLE},
e as materialized (select client_id, epoch_us(ts) as t, 0 as kind, {_NUMBER.format("click_id")} from (select distinct {", ".join(CLICKS)} from clicks where kind = 'error' and client_id is not null and ts is not null), crc
union all select client_id, epoch_us(sold_at), 1, {_NUMBER.format("sale_id")} from sales, crc where client_id is not null and sold_at is not null),
w as (select b::int as b, (select max(t) from e where batch < b) - {96 * HOUR} as w from range(8) r(b)),
x as materialized (select e.*, coalesce(t < w, false) as late from e join w on b = batch),
c as materialized (select client_id, t, count(*) as n from x where kind = 0 and not late group by client_id, t),
s as (select distinct client_id, t from x where kind = 1 and not late),
p as (select c.client_id, c.t, c.t + {24 * HOUR} as due, s.t as sale from c asof left join s on c.client_id = s.client_id and c.t <= s.t),
q as (select *, coalesce(sale <= due, false) as cancelled, case when sale <= due then sale else due end as ended from p),
z as materialized (select q.*, c.t as after from q asof left join c on q.client_id = c.client_id and q.ended < c.t),
o(client_id, t) as (select client_id, min(t) from c group by client_id union all select z.client_id, z.after from o join z on z.client_id = o.client_id and z.t = o.t where z.after is not null),
a as (select client_id, t, due from o join z using (client_id, t) where not cancelled)
select coalesce((select min(b) from w where w > due), 8)::int as batch, a.client_id, a.t as opened_us, due as due_us, sum(n)::bigint as n_rows from a join c on c.client_id = a.client_id and c.t between a.t and due group by all
union all select batch, client_id, -1, -1, count(*) from x where late group by batch, client_id"""
