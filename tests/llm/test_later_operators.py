"""Packing, importance resampling and follow-up alerts against brute force, edge cases included."""

import collections
import datetime
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataseek.llm import alerts, packing, resampling
from strataseek.llm.queries import piece_model

SCHEMA = "doc_id long, text string, n long, feature string, _b int"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    word = lambda: r.choice(["The", "of", "and", "a1b2", "Straße", "日本", "x"] + [f"w{k}" for k in range(300)])
    out = [(i, " ".join(word() for _ in range(r.choice([3, 25, 90, 700])))) for i in range(70)]
    out += [(100, None), (101, ""), (102, " \t\n "), (103, "one"), (103, "one"), (103, "two"), (None, "null id " * 9), (None, "null id " * 9), (104, "w1 " * 30_000)]
    out += [(105, "a  b   c\n\n d \n e's it's  "), (106, "say <|endoftext|> here"), (107, "\0 nul \0\0"), (108, "é x ́ \U0001f600 1½ ٣ Ᲊ"), (109, "z" * 5000), (110, "a  b  c \x1c d")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "f", 2) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(piece_model("byte_bpe_50k.json"))
    for most_open in (packing.MOST_OPEN, 3):
        got = packing.packed(docs, piece_model("byte_bpe_50k.json"), most_open=most_open).collect()
        assert collections.Counter(r["doc_id"] for r in got).keys() == {i for i, _ in rows}
        wanted = collections.Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids) + (1,)) for i, t in rows)
        sequences = collections.defaultdict(list)
        for r in got:
            assert len(r["ids"]) == 4 * r["length"] > 0
            sequences[r["sequence_id"]].append(r)
        by_doc = collections.defaultdict(list)
        for s in sequences.values():
            s.sort(key=lambda r: r["offset"])
            n = sum(r["length"] for r in s)
            assert [r["offset"] for r in s] == np.cumsum([0, *(r["length"] for r in s)])[:-1].tolist()
            assert n == 2048 or n < 2048 and n & n - 1 == 0  # nothing is padded
            for r in s:
                by_doc[r["doc_id"], r["doc_tokens"]].append(r)
        for (i, n), pieces in by_doc.items():
            docs_ = [ids for (d, ids), k in wanted.items() for _ in range(k) if d == i and len(ids) == n]
            pieces.sort(key=lambda r: r["start"])
            assert sum(r["length"] for r in pieces) == n * len(docs_)
            for r in pieces:
                assert tuple(np.frombuffer(r["ids"], "<u4")) in {ids[r["start"] : r["start"] + r["length"]] for ids in docs_}
            covered = collections.Counter(k for r in pieces for k in range(r["start"], r["start"] + r["length"]))
            assert covered == {k: len(docs_) for k in range(n)}
    assert packing.packed(empty, piece_model("byte_bpe_50k.json")).collect() == []


def test_packing_minimises_sum_of_squares():
    r, p = random.Random(1), packing.Packer(24)
    for k in range(3000):
        n = r.choice([*range(1, 13), 23]) if k < 100 else r.randint(1, 12)
        levels = p.levels.tolist()

        def after(h, n=n, levels=levels):
            x = list(levels)
            if h:
                x[h] -= 1
            if h + n < p.size:
                x[h + n] += 1
            return sum(v * v for v in x)

        best = min(after(h) for h in range(p.size - n + 1) if not h or levels[h])
        assert after(p.choose(n)) == best
        p.add(k, np.zeros(n, np.uint32))
        assert sum(p.levels) == p.open == sum(map(len, p.at))
    assert p.open < 60  # of some 800 sequences


def test_resampling(spark, docs, rows, empty):
    target_texts = ["the w1 w2 w3 日本", None, "w5 w6 " * 20, "Straße of"]
    target = spark.createDataFrame([(k, t, "x") for k, t in enumerate(target_texts)], "item_id long, text string, doc_id string")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for width in (1, 2):

        def features(t, width=width):
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
            return w, [" ".join(w[i : i + n]) for n in range(1, width + 1) for i in range(len(w) - n + 1)]

        bucket = lambda f: zlib.crc32(f.encode()) % 10000
        s, t = (collections.Counter(bucket(f) for x in xs for f in features(x)[1]) for xs in ([x for _, x in rows], target_texts))
        S, T = sum(s.values()), sum(t.values())
        gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))  # noqa: E731, B023
        want = []
        for i, x in rows:
            w, f = features(x)
            h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
            weight = sum(gain(bucket(y)) for y in f)
            want.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w) >= 20])
        fit = sorted((x for x in want if x[5]), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
        for k, x in enumerate(fit[: 30 * len(fit) // 100], 1):
            x[4] = k
        got = resampling.resampled(docs, target, width, percent=30)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(str(tuple(x[:5])) for x in want)
    assert resampling.resampled(empty, target).collect() == []
    assert resampling.resampled(docs, empty).count() == len(rows)


def brute_alerts(clicks, sales):
    """The contract's words, event by event."""
    epoch = datetime.datetime(1970, 1, 1)
    us = lambda t: (t - epoch) // datetime.timedelta(microseconds=1)
    hour, start = 3600 * 10**6, us(datetime.datetime(2024, 1, 1))
    number = lambda a, i: 7 if a is None else max(0, min(7, ((us(a) - start) // hour + 80 * (zlib.crc32(b"" if i is None else str(i).encode()) % 4)) * 8 // 3648))
    e = [(number(r[2], r[0]), us(r[1]), 0, r[3]) for r in set(clicks) if r[4] == "error" and r[3] is not None and r[1] is not None]
    e += [(number(r[3], r[0]), us(r[2]), 1, r[1]) for r in sales if r[1] is not None and r[2] is not None]
    marks = [max((x[1] for x in e if x[0] < b), default=-(10**18)) - 96 * hour for b in range(8)]
    late, kept = collections.Counter(), collections.defaultdict(list)
    for b, t, kind, client in e:
        if t < marks[b]:
            late[b, client] += 1
        else:
            kept[client].append((t, kind))
    out = [(b, c, -1, -1, n) for (b, c), n in late.items()]
    told = lambda c, o: out.append((next((b for b in range(8) if marks[b] > o[0] + 24 * hour), 8), c, o[0], o[0] + 24 * hour, o[1]))
    for client, seen in kept.items():
        held = None
        for t, kind in sorted(seen):
            if held and t > held[0] + 24 * hour:
                told(client, held)
                held = None
            held = ((held[0], held[1] + 1) if held else (t, 1)) if kind == 0 else None
        if held:
            told(client, held)
    return sorted(out)


CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, bucket string"
SALES = "sale_id long, client_id long, sold_at timestamp_ntz, arrived_at timestamp_ntz, kind string"


def test_alerts(spark):
    r, day = random.Random(8), datetime.datetime(2024, 1, 1)
    at = lambda h: day + datetime.timedelta(hours=h, microseconds=r.choice([0, 0, 1, 999_999]))
    clicks, sales = [], []
    for i in range(900):
        h, c = r.randrange(3500), r.choice([0, 0, 0, 1, 2, 3, 4, None])
        clicks.append((i, r.choice([at(h)] * 20 + [None]), at(h + r.choice([0, 0, 1, 150])), c, r.choice(["error"] * 4 + ["view", None]), r.choice([1.0, None]), "{}"))
        if i % 3 == 0:
            h, c = r.choice([h, h + r.choice([0, 5, 24, 25])]), c if r.random() < 0.7 else 2
            sales.append((i, c, at(h), at(h + r.choice([0, 30, 300]))))
    clicks += clicks[:40] + [(5000, at(10), None, 9, "error", 0.0, None), (None, at(20), at(20), 9, "error", None, None), (5001, at(30), datetime.datetime(2023, 12, 1), 10, "error", None, None)]
    sales += sales[:40] + [(6000, 9, at(20), at(9000))]
    c, s = spark.createDataFrame([(*x, "b") for x in clicks], CLICKS), spark.createDataFrame([(*x, "k") for x in sales], SALES)
    got = alerts.missing_follow_ups(c.repartition(3), s.repartition(2), buckets=5)
    assert got.columns == ["batch", "client_id", "opened_us", "due_us", "n_rows"]
    want = brute_alerts(clicks, sales)
    assert {x[0] for x in want} >= {2, 5, 8} and any(x[2] < 0 for x in want)
    assert sorted(tuple(x) for x in got.collect()) == want


def test_alerts_of_empty_tables(spark):
    got = alerts.missing_follow_ups(spark.createDataFrame([], CLICKS), spark.createDataFrame([], SALES), buckets=2)
    assert got.collect() == []


def test_stages_keep_columns_of_any_name(spark, docs):
    """A name with a dot, and one that needs quotes, pass through the stages that rewrite whole rows."""
    from strataseek.llm import pii, toxicity

    d = docs.limit(20).withColumnsRenamed({"n": "x.y", "feature": "a `b"}).withColumn("text", F.coalesce(F.col("text"), F.lit("call +49 30 1234567 now")))
    labels = spark.createDataFrame([(i, 0) for i in range(70)], "doc_id long, toxic int")
    for out in (toxicity.clean_documents(d, labels), pii.masked_documents(d)):
        assert out.columns == d.columns and out.select("`x.y`").first()[0] == 1
