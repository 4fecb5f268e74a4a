"""What is shuffled and held as tables grow: by the plan of small tables."""

import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataseek.operators import blocks, bounds
from strataseek.operators import search as S
from strataseek.operators import units
from strataseek.plans import catalog
from strataseek.plans.engine import structured_search
from strataseek.sources import documents as D


def _units(spark, n=400):
    r = random.Random(4)
    word = lambda: r.choice(["the", "of", "sea", "salt", "fish", "boat"])
    rows = [(i, " ".join(word() for _ in range(r.randrange(12)))) for i in range(n)]
    return spark.createDataFrame([*rows, rows[3], (n, None)], "unit long, content string")  # a repeated unit, and one without text


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _asked(spark, n=30):
    rows = [(q, "content", "content", w, "term", 1.0) for q in range(n) for w in ("the", "sea", "fish")]
    return spark.createDataFrame(rows, "query_id long, channel string, field string, term string, kind string, boost double")


def test_postings_do_not_move(spark, tmp_path):
    """Only the texts are shuffled; repeated units are counted together, as when postings were."""
    u = _units(spark)
    u.write.parquet(str(tmp_path / "units"))
    u = spark.read.parquet(str(tmp_path / "units"))
    dealt = units.postings(u.repartition(D._parts(u), "unit"), "unit", ["content"])
    assert _plan(dealt.sortWithinPartitions("field", "term", "unit")).count("Exchange") == 1
    written = []
    kept, D.stored_index = D.stored_index, lambda s, p, tables, rebuild=False: (written.extend(tables.values()), kept(s, p, tables, rebuild))[1]
    try:
        post, _, _ = D.stored_postings(spark, str(tmp_path / "index"), "u", u, "unit", ["content"])
    finally:
        D.stored_index = kept
    assert _plan(written[0]).count("Exchange") == 1
    assert _rows(post) == _rows(units.postings(u, "unit", ["content"]).select(*post.columns))


def test_many_matches_are_dealt_by_unit(spark, monkeypatch):
    """Scores are the same, and hits are summed where they arise: between the dealt postings and the sum is no shuffle of hits."""
    post = units.postings(_units(spark), "unit", ["content"])
    stats = units.statistics(post, 401)
    want = S.bm25(_asked(spark), post, *stats).select("query_id", "unit", F.round("score", 6))
    monkeypatch.setattr(S, "MATCHES", 100)
    h = S.bm25(_asked(spark), post, *stats)
    assert "REPARTITION_BY_NUM" in _plan(h) and "hashpartitioning(query_id" not in _plan(h)
    assert _rows(h.select("query_id", "unit", F.round("score", 6))) == _rows(want)


def test_blocks_give_their_best(spark, monkeypatch):
    """Of many matches each block gives the best of each query and channel: by their limits, with ties, repeated and fuzzy terms,
    composed query ids, and the columns that postings have."""
    u = _units(spark)
    post = units.postings(u, "unit", ["content"]).withColumn("chunk_id", F.concat(F.lit("c"), "unit")).withColumn("doc_id", F.col("unit") % 7)
    stats = units.statistics(post, 401)
    asked = _asked(spark).unionByName(_asked(spark, 3)).unionByName(_asked(spark, 9).withColumn("kind", F.lit("fuzzy")))
    asked = asked.unionByName(_asked(spark).withColumn("channel", F.lit("title")).withColumn("boost", F.col("query_id") * 0.3))
    asked = asked.withColumn("query_id", F.struct(F.col("query_id").alias("qid"), F.lit(0).alias("seq")))
    limits = {"content": 5, "title": 3}
    cut = lambda h: S.ranked(h.withColumn("score", F.round("score", 6)), ["query_id", "channel"], F.when(F.col("channel") == "content", 5).otherwise(3))
    own = ["query_id", "channel", "unit", "chunk_id", "doc_id", "score", "rank"]
    all_hits = S.bm25(asked, post, *stats)
    want, n = _rows(cut(all_hits).select(*own)), all_hits.count()
    for matches in (100, 3000):
        monkeypatch.setattr(S, "MATCHES", matches)
        h = S.bm25(asked, post, *stats, limits=limits)
        assert "MapInArrow" in _plan(h) and h.count() < n
        assert _rows(cut(h).select(*own)) == want
    assert blocks.rounded(np.array([0.1234565, 2.5e-6, -0.1234565, 1.0])).tolist() == [123457, 3, -123457, 1000000]


@pytest.mark.parametrize("dense", [0, 10**9])
def test_dense_blocks_sort_no_match(monkeypatch, dense):
    """Both ways of summing a block give each query's best, with ties by unit; where cells are few, matches are not sorted."""
    r = np.random.default_rng(5)
    got = {(int(u), int(k)): float(w) for u, k, w in zip(r.integers(0, 60, 900), r.integers(0, 9, 900), r.integers(1, 4, 900), strict=True)}
    rows = [(f"u{u}", k, w) for (u, k), w in got.items()]  # in no order
    asks = [sorted({int(q) for q in r.integers(0, 7, 3)}) for _ in range(9)]
    starts, query = np.cumsum([0, *map(len, asks)]), np.array([q for a in asks for q in a])
    boost, most = r.integers(1, 3, len(query)).astype(float), np.array([1, 2, 3, 5, 59, 60, 1000])
    want, sums = [], {}
    for u, k, w in rows:
        for i in range(starts[k], starts[k + 1]):
            sums[int(query[i]), u] = sums.get((int(query[i]), u), 0.0) + boost[i] * w
    for q in range(7):
        want += sorted(((q, u, x) for (p, u), x in sums.items() if p == q), key=lambda t: (-t[2], t[1]))[: most[q]]
    monkeypatch.setattr(blocks, "DENSE", dense)
    sizes, unique = [], np.unique
    monkeypatch.setattr(blocks.np, "unique", lambda x, **how: (sizes.append(len(x)), unique(x, **how))[1])
    unit, key, weight = zip(*rows, strict=True)
    out = blocks._block_best(pa.table({"unit": unit, "key": pa.array(key, pa.int32()), "weight": weight}), starts, query, boost, most)
    assert sorted(zip(*(out[c].to_pylist() for c in ("query", "unit", "score")), strict=True)) == sorted(want)
    assert max(sizes) <= 7 if dense else max(sizes) > 900


def test_asked_postings_meet_once(spark, monkeypatch):
    """Beyond the terms that a filter takes, postings meet the asked ones in one join, not in a semi join before it too."""
    post = units.postings(_units(spark), "unit", ["content"])
    stats = units.statistics(post, 401)
    want = _rows(S.ranked(S.bm25(_asked(spark), post, *stats), ["query_id"], 5).select("query_id", "unit", F.round("score", 6)))
    monkeypatch.setattr(S, "MATCHES", 100)
    assert "Filter" in _plan(S.bm25(_asked(spark), post, *stats, limits={"content": 5}))
    monkeypatch.setattr(S, "MOST_TERMS", 1)
    h = S.bm25(_asked(spark), post, *stats, limits={"content": 5})
    assert "MapInArrow" in _plan(h) and "LeftSemi" not in _plan(h)
    assert _rows(S.ranked(h, ["query_id"], 5).select("query_id", "unit", F.round("score", 6))) == want


def test_postings_are_in_order_of_terms(spark, tmp_path):
    """Terms tell rows apart by their first bytes, fields don't; and a term's postings of all fields lie together."""
    u = _units(spark).withColumn("title", F.col("content"))
    post, _, _ = D.stored_postings(spark, str(tmp_path / "index"), "u", u, "unit", ["content", "title"])
    rows = [tuple(r) for r in post.select("term", "field", "unit").collect()]
    assert len(list((tmp_path / "index" / "u_postings").glob("part-*"))) == 1 and rows == sorted(rows)


def test_blocks_sort_one_number(spark, monkeypatch):
    """Postings are put by units through a number, and units of one number stay in one block."""
    post = units.postings(_units(spark), "unit", ["content"])
    stats = units.statistics(post, 401)
    best = lambda h: _rows(S.ranked(h, ["query_id"], 5).select("query_id", "unit", F.round("score", 6)))
    want = best(S.bm25(_asked(spark), post, *stats))
    monkeypatch.setattr(S, "MATCHES", 100)
    h = S.bm25(_asked(spark), post, *stats, limits={"content": 5})
    assert re.search(r"Sort \[at#\d+L ASC NULLS FIRST\]", _plan(h)) and best(h) == want
    monkeypatch.setattr(blocks, "PLACE", lambda unit: F.pmod(F.hash(unit), F.lit(3)).cast("long"))
    assert best(S.bm25(_asked(spark), post, *stats, limits={"content": 5})) == want


def test_parts_follow_the_text(spark, tmp_path):
    """Repeated texts take little room in files, but as much work and memory as others."""
    spark.range(3000).select("id", F.repeat(F.lit("sea salt "), 1000).alias("content")).write.parquet(str(tmp_path / "units"))
    u = spark.read.parquet(str(tmp_path / "units"))
    assert D._parts(u.select("content")) == -(-3000 * 9000 // D.PART_BYTES)


def test_limits_cut_before_the_shuffle(spark):
    """Channels of different limits each keep theirs, and Spark cuts those of few hits within the tasks."""
    u = _units(spark)
    post = units.postings(u, "unit", ["content"])
    terms, fields = units.statistics(post, 401)
    index = {"postings": post, "terms": terms, "fields": fields, "owner": u.select("unit", F.col("unit").alias("chunk_id"), F.col("unit").alias("doc_id")).distinct()}
    both = _asked(spark).unionByName(_asked(spark).withColumn("channel", F.lit("entity")))
    weights = spark.createDataFrame([("content", 0.5), ("entity", 0.5)], "channel string, weight double")
    found = structured_search(both, index, weights, 100, least=0.0)
    assert "WindowGroupLimit" in _plan(found)
    h = S.bm25(both, post, terms, fields).withColumn("score", F.round("score", 6))
    kept = S.ranked(h, ["query_id", "channel"], F.when(F.col("channel") == "content", 20).otherwise(10000))
    want = S.top(S.fused(S.normalized(kept.withColumnRenamed("unit", "chunk_id").groupBy("query_id", "channel", "chunk_id").agg(F.max("score").alias("score"))), weights), 100, 0.0)
    assert _rows(found.select("query_id", "chunk_id", "score", "rank")) == _rows(want.select("query_id", "chunk_id", "score", "rank"))


def test_lists_of_a_term_do_not_meet(spark):
    """Asked terms go to the packed lists, which are not shuffled by term; the best are those of plain BM25."""
    post = units.postings(_units(spark), "unit", ["content"])
    stats = units.statistics(post, 401)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        h = bounds.reaching(_asked(spark), bounds.packed(post), *stats, 5)
        best = lambda x: _rows(S.ranked(x, ["query_id"], 5).select("query_id", "unit", F.round("score", 6)))
        assert re.search(r"BroadcastHashJoin \[field#\d+, term#\d+\]", _plan(h)) and best(h) == best(S.bm25(_asked(spark), post, *stats))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lists_move_once(spark, monkeypatch):
    """Lists are packed where their texts are dealt, and asked lists are dealt by range: neither postings nor hits are shuffled.
    Blocks of any size, a repeated unit included, give what plain BM25 gives, and bounds save hits."""
    u = _units(spark)
    made = bounds.packed_units(u, "unit", ["content"], 3)
    assert _plan(made).count("Exchange") == 1
    post = units.postings(u, "unit", ["content"])
    stats = units.statistics(post, 401)
    each = made.select("field", "term", F.inline("hits"))
    assert _rows(each.select("field", "unit", "term", "dl", "tf")) == _rows(post.select("field", "unit", "term", "dl", "tf"))
    assert each.join(made.select("term", "range", F.explode("hits.unit").alias("unit")), ["term", "unit"]).groupBy("unit").agg(F.countDistinct("range").alias("n")).where("n > 1").count() == 0
    assert made.groupBy("range").agg(F.countDistinct("term")).count() >= 401 / bounds.UNITS / 2 and made.select(F.max(F.size("hits"))).first()[0] <= bounds.UNITS + 1
    asked = _asked(spark).unionByName(_asked(spark).limit(2).withColumn("boost", F.lit(-0.5)))
    h = bounds.reaching(asked, made, *stats, 3)
    assert "Exchange hashpartitioning(query_id" not in _plan(h) and len(re.findall(r"Exchange hashpartitioning\(range", _plan(h))) == 1
    best = lambda x: _rows(S.ranked(x, ["query_id", "channel"], 3).select("query_id", "channel", "unit", F.round("score", 6), "rank"))
    want = best(S.bm25(asked, post, *stats))
    assert best(h) == want
    monkeypatch.setattr(S, "MATCHES", 500)
    monkeypatch.setattr(bounds, "FIRST", 1)
    assert best(bounds.reaching(asked, made, *stats, 3)) == want


def test_lists_need_no_postings(spark, tmp_path):
    """Statistics of the lists are those of the postings, and each finds what the other has stored."""
    u = _units(spark)
    _, terms, fields = D.stored_lists(spark, str(tmp_path / "a"), "u", u, "unit", ["content"])
    assert not (tmp_path / "a" / "u_postings").exists()
    _, *want = D.stored_postings(spark, str(tmp_path / "b"), "u", u, "unit", ["content"])
    assert [_rows(terms), _rows(fields)] == [_rows(x) for x in want] and [x.dtypes for x in want] == [terms.dtypes, fields.dtypes]
    _, *again = D.stored_postings(spark, str(tmp_path / "a"), "u", u, "unit", ["content"])
    assert [_rows(x) for x in again] == [_rows(x) for x in want]


def test_bounded_row_equals_its_sql(spark, monkeypatch):
    at = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for t in ("benchmark", "documents"):
        duck.sql(f"create view {t} as select * from '{at}/{t}.parquet'")
    monkeypatch.setattr(S, "MATCHES", 1000)
    got, want = catalog.QUERIES["bounded_topk"](spark, at), duck.sql(catalog.ORACLES["bounded_topk"])
    assert "MapInArrow" in _plan(got)
    assert _rows(got.select(*want.columns)) == sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize("name", ["score_cut", "minmax_normalize", "weighted_fusion", "dedupe_first", "structured_search", "top1_per_doc"])
def test_rows_go_by_blocks(spark, monkeypatch, name):
    """Where matches are many, the rows that share the step score them in blocks, and still equal their SQL."""
    at = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for t in ("benchmark", "conversations"):
        duck.sql(f"create view {t} as select * from '{at}/{t}.parquet'")
    monkeypatch.setattr(S, "MATCHES", 1000)
    got, want = catalog.QUERIES[name](spark, at), duck.sql(catalog.ORACLES[name])
    assert "MapInArrow" in _plan(got)
    assert _rows(got.select(*want.columns)) == sorted(want.fetchall(), key=repr)
