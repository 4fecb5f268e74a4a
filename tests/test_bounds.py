"""The k best by bounds equal the k best of all hits, and score fewer."""

import json
import random

import pytest
from conftest import document
from pyspark.sql import functions as F

from strataseek.operators import bounds, units
from strataseek.operators import search as S
from strataseek.plans.engine import Retriever, RetrieveOptions
from strataseek.sources import documents as D

WORDS = [f"w{i}" for i in range(40)]


@pytest.fixture(scope="module")
def made(spark):
    """Units of two fields, from none to some 400 words, many of them equal; postings, statistics, lists."""
    r = random.Random(7)
    pick = lambda n: " ".join(WORDS[min(39, int(r.expovariate(0.2)))] for _ in range(n))
    rows = [(i, pick(int(r.lognormvariate(3, 1))), pick(r.randrange(4))) for i in range(1500)]
    rows += [(2000 + i, "w1 w2 w1", "w1") for i in range(60)] + [(3000, None, None), (3001, "", "")]
    t = spark.createDataFrame(rows, "unit long, content string, section_title string")
    post = units.postings(t, "unit", ["content", "section_title"]).withColumn("doc_id", F.col("unit") % 50).cache()
    return post, *units.statistics(post, t.count()), bounds.packed(post).cache()


def asked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, channel string, field string, term string, kind string, boost double")


QUERIES = [(1, "content", "content", "w1", "term", 1.0), (1, "content", "content", "w9", "term", 2.0), (2, "content", "content", "w0", "term", 1.0), (2, "title", "content", "w0", "term", 1.0), (2, "title", "section_title", "w1", "term", 3.0), (3, "content", "content", "w39", "term", 1.0), (3, "content", "content", "w2", "fuzzy", 0.5), (4, "content", "content", "absent", "term", 1.0), (5, "content", "content", "w1", "term", 1.0), (5, "content", "content", "w1", "term", 1.0), (5, "content", "content", "w3", "term", -1.0)]
best = lambda hits, k: sorted((r.query_id, r.channel, r.unit, round(r.score, 6), r["rank"]) for r in S.ranked(hits, ["query_id", "channel"], k).collect())


@pytest.mark.parametrize("k", [1, 7, 5000])
def test_equals_all_hits(spark, made, k):
    post, terms, fields, lists = made
    q = asked(spark, QUERIES)
    assert best(bounds.reaching(q, lists, terms, fields, k), k) == best(S.bm25(q, post, terms, fields), k)


def test_filters_deletions_and_ties(spark, made):
    post, terms, fields, lists = made
    q = asked(spark, QUERIES)
    docs = spark.createDataFrame([(1, 3), (1, 4), (9, 1)], "query_id long, doc_id long")
    limited = spark.createDataFrame([(1,), (5,)], "query_id long")
    assert best(bounds.reaching(q, lists, terms, fields, 4, docs, limited), 4) == best(S.bm25(q, post, terms, fields, docs, limited), 4)
    dead = spark.range(0, 50).where("id % 5 <> 2").select(F.col("id").alias("doc_id"), F.lit("s").alias("_segment"))
    left = post.join(dead, "doc_id", "left_anti")
    got = bounds.reaching(q, lists.withColumn("_segment", F.lit("s")), terms, fields, 6, dead=dead)
    assert best(got, 6) == best(S.bm25(q, left, terms, fields), 6)


def test_fewer_hits_and_bounded_lists(spark, made):
    post, terms, fields, lists = made
    q = asked(spark, QUERIES[:2])
    assert bounds.reaching(q, lists, terms, fields, 3).count() < 0.5 * S.bm25(q, post, terms, fields).count()
    assert lists.select(F.sum(F.size("hits"))).first()[0] == post.count() and lists.select(F.max(F.size("hits"))).first()[0] < 6 * bounds.UNITS
    assert bounds.packed(post.limit(0)).count() == 0 and bounds.reaching(q, lists.limit(0), terms, fields, 3).count() == 0
    assert bounds.reaching(q.limit(0), lists, terms, fields, 3).count() == 0


def test_bounded_index_answers_alike(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    for i in range(12):
        (tmp_path / "docs" / f"{i}.json").write_text(json.dumps(document(i, " ".join(["flood", "damage", "fire", "theft"][: 1 + i % 4]))))
    r = Retriever(spark, str(tmp_path / "docs"), str(tmp_path / "index"), bounded=True)
    more = tmp_path / "more"
    more.mkdir()
    (more / "x.json").write_text(json.dumps(document(3, "theft theft") | {"version_ts": 5}))
    r.store.upsert(D.json_documents(spark, str(more)))  # a second segment and a replaced document
    r.refresh()
    assert "dead" in r.index
    q = spark.createDataFrame([(0, "flood theft"), (1, "fire section"), (2, "nothing known")], "query_id long, text string")
    rows = lambda: sorted((x.query_id, x.chunk_id, x.score, x["rank"]) for x in r.retrieve_many(q, RetrieveOptions(top_k=20)).collect())
    got = rows()
    del r.index["lists"]  # then all hits are scored
    assert got and got == rows()
