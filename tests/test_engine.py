import json

import pytest
from conftest import document
from pyspark.sql import functions as F

from strataseek.functions import analysis
from strataseek.operators import questions as Q
from strataseek.operators import search as S
from strataseek.plans.engine import Retriever, RetrieveOptions
from strataseek.sources import documents as D
from strataseek.streaming.incremental import index_stream


def scores(spark, rows):
    return spark.createDataFrame(rows, "query_id long, channel string, chunk_id string, score double")


def test_normalization_edges(spark):
    rows = [(1, "a", "x", 3.0), (2, "a", "x", 2.0), (2, "a", "y", 2.0), (3, "a", "x", 1.0), (3, "a", "y", 5.0)]
    got = {(r.query_id, r.chunk_id): r.score for r in S.normalized(scores(spark, rows)).collect()}
    assert got == {(1, "x"): 1.0, (2, "x"): 1.0, (2, "y"): 1.0, (3, "x"): 0.0, (3, "y"): 1.0}


def test_fusion_uses_active_channels_and_threshold_follows_top(spark):
    w = spark.createDataFrame([("a", 0.4), ("b", 0.1), ("c", 0.5)], "channel string, weight double")
    f = S.fused(scores(spark, [(1, "a", "x", 1.0), (1, "b", "y", 1.0), (1, "b", "z", 0.0)]), w)
    assert [(r.chunk_id, r.score) for r in S.top(f, 3).orderBy("rank").collect()] == [("x", 0.8), ("y", 0.2)]
    assert S.top(f, 1).count() == 1


def test_zero_weights(spark):
    w = spark.createDataFrame([("a", 0.0)], "channel string, weight double")
    assert S.fused(scores(spark, [(1, "a", "x", 1.0)]), w).first().score == 0.0


@pytest.mark.parametrize("raw, n", [('{"query": {"a": "1"}, "filter": {"doc_ids": []}}', 1), ('x [{"query": {"a": "1"}, "filter": {"doc_ids": ["d"]}}] y', 1), ('{"query": {"a": "1"}}', None), ("nothing", None), (None, None)])
def test_answers(spark, raw, n):
    got = spark.createDataFrame([(raw,)], "raw string").select(Q.parsed_answers(F.col("raw")).alias("g")).first().g
    assert (None if got is None else len(got)) == n


def test_cjk_pairs(spark):
    assert spark.createDataFrame([("保险合同 ab 保",)], "t string").select(analysis.cjk_tokens(F.col("t")).alias("x")).first().x == ["保险", "险合", "合同", "ab", "保"]


def test_options_and_config():
    with pytest.raises(ValueError):
        RetrieveOptions(top_k=0)
    assert [c["id"] for c in D.categories()] == ["growth", "money", "policy", "general"]
    assert D.categories("categories:\n  - {id: x}\n") == [] and set(D.schemas()) == {"growth", "money", "policy", "general"}


def test_documents(spark, folder):
    assert {r.doc_id for r in D.json_documents(spark, str(folder / "docs")).collect()} == {"d0", "d1", "d2"}
    assert D.insurance_documents(spark, str(folder / "docs")).count() == 3
    assert D.json_documents(spark, str(folder / "none")).count() == 0


def test_retriever(spark, folder):
    r = Retriever(spark, str(folder / "docs"), str(folder / "index"), "insurance")
    got = r.retrieve("fire damage part 1", RetrieveOptions(top_k=5), "Policies").orderBy("rank").collect()
    assert got[0].chunk_id == "d1_chunk_1_v1" and got[0].prev_ids == ["d1_chunk_0_v1"] and got[0].warning
    only = r.retrieve("damage part", RetrieveOptions(doc_ids=["d0"]), "General").collect()
    assert {x.doc_id for x in only} == {"d0"}
    assert r.tables["relations"].count() == 3 * 9 and r.classify("the market") == "growth"
    with pytest.raises(ValueError):
        r.category("unknown")


def test_metadata_filter(spark, folder):
    asked = []

    def model(question, prompt):
        asked.append(prompt)
        if "contract_name" not in prompt:
            return '[{"query": {"clause": "Section 1"}, "filter": {"doc_ids": []}}]'
        return json.dumps([{"query": {"insurer": None, "contract_name": x}, "filter": {"doc_ids": []}} for x in names])

    r = Retriever(spark, str(folder / "docs"), str(folder / "index"), "insurance", model)
    for names, want in ((["theft"], {"d2"}), (["theft", "flood"], {"d0", "d2"}), (["flooo"], {"d0", "d1", "d2"}), ([], {"d0", "d1", "d2"}), (["thef"], {"d2"})):
        asked.clear()
        got = r.retrieve("damage part 1", RetrieveOptions(top_k=50), "Policies").collect()
        assert len(asked) == 2 and {x.doc_id for x in got} == want and not any(x.warning for x in got)


def test_chinese(spark, tmp_path):
    for i, text in enumerate(["本保险合同承担火灾损失责任", "本公司负责赔偿盗窃事故"]):
        (tmp_path / f"d{i}.json").write_text(json.dumps(document(i, text), ensure_ascii=False))
    r = Retriever(spark, str(tmp_path), str(tmp_path / "index"), "insurance")
    asked = "请问火灾损失怎么赔?"
    got = r.retrieve(asked, RetrieveOptions(top_k=50), "General").collect()
    assert {x.doc_id for x in got} == {"d0"}
    assert Retriever(spark, str(tmp_path), str(tmp_path / "index"), "insurance", analyzer="words").retrieve(asked, None, "General").count() == 0
    r.extractor = lambda question, prompt: json.dumps([{"query": {"contract_name": "盗窃事故"}, "filter": {"doc_ids": []}}])
    assert {x.doc_id for x in r.retrieve("本公司保险合同", RetrieveOptions(top_k=50), "Policies").collect()} == {"d1"}
    keywords = [{"id": "fire", "classification": {"method": "keyword", "keywords": [{"words": ["火灾损失", "ESG报告"], "weight": 1.0}, {"words": ["ESG"], "weight": 1.0}]}}]
    q = spark.createDataFrame([(0, asked), (1, "看ESG报告吗"), (2, "火灾的损失")], "query_id long, text string")
    scores = {x.query_id: x.score for x in Q.keyword_scores(q, D.keyword_table(spark, keywords), analysis.cjk_tokens).collect()}
    assert scores == {0: 0.5, 1: 1.5}
    r.categories = keywords + [c for c in r.categories if c["id"] == "general"]
    assert r.classify(asked) == "fire" and r.classify("火灾的损失") == "general"


def test_stream_takes_what_a_scan_takes(spark, folder):
    """No latest copies, versions, broken files, documents without chunks or without a tree."""
    (folder / "docs/d0/versions").mkdir()
    (folder / "docs/d0/versions/d0_v0.json").write_text(json.dumps(document(0, "old")))
    bare = document(7, "no tree")
    bare["chunks"][0]["doc_tree"] = None
    (folder / "docs/bare.json").write_text(json.dumps(bare))
    index_stream(spark, str(folder / "docs"), str(folder / "live"), str(folder / "cp")).awaitTermination(120)
    chunks = Retriever(spark, str(folder / "docs"), str(folder / "live")).tables["chunks"]
    assert chunks.count() == chunks.select("chunk_id").distinct().count() == 9


def test_direct_search(spark, folder):
    r = Retriever(spark, str(folder / "docs"), str(folder / "index"), "insurance")
    ids = lambda df: [x.unit for x in df.collect()]
    assert ids(r.search_chunks("fire part 2")) == ["d1_chunk_2_v1"] and len(ids(r.search_chunks("part", 4))) == 4
    assert len(ids(r.search_chunks('"fire damage"'))) == 3 and ids(r.search_chunks('"damage fire"')) == []
    assert ids(r.search_chunks("flood OR theft -damage", 20)) == [f"d2_chunk_{k}_v1" for k in range(3)]
    assert len(ids(r.search_entities("firm 1"))) == 3 and {x.object for x in r.search_relations("covers thef*").collect()} >= {"theft"}
    assert [x.score for x in r.search_chunks("part").collect()] == sorted([x.score for x in r.search_chunks("part").collect()], reverse=True)
    assert "subject" in r.schema("relations").names and r.schema("none") is None


def test_every_and_response(spark, folder):
    r = Retriever(spark, str(folder / "docs"), str(folder / "index"), "insurance")
    assert r.retrieve("?!", RetrieveOptions(top_k=50), "General").count() == 9
    assert {x.doc_id for x in r.retrieve("...", RetrieveOptions(top_k=50, doc_ids=["d2"]), "General").collect()} == {"d2"}
    got = r.respond("fire damage", RetrieveOptions(top_k=2), "General")
    assert got["total"] == got["returned"] == len(got["groups"][0]["results"]) == 2 and got["warning"] and got["category"] == "general"
    assert got["groups"][0]["extracted_fields"] == {"query_text": "fire damage"} and len(got["request_id"]) == 36

    def broken(question, prompt):
        raise TimeoutError("no answer in 30 s")

    r.extractor = broken
    assert "TimeoutError: no answer in 30 s" in r.retrieve("fire damage", None, "General").first().warning


def test_batch(spark, folder):
    from strataseek.plans import batch

    r = Retriever(spark, str(folder / "docs"), str(folder / "index"), "insurance")
    rows = [("ins_1", "Is fire covered?", {"A": "part 1", "B": "part 2"}, "multi", ["Fire"]), ("ins_2", "Is theft?", {"A": "yes", "B": "no"}, "tf", ["Theft", "Fire"]), ("ins_0", "Skipped", {"A": "x"}, "mcq", ["Fire"])]
    q = spark.createDataFrame(rows, "qid string, question string, options map<string,string>, answer_format string, doc_ids array<string>")
    names = spark.createDataFrame([("Fire", "d1"), ("Theft", "d2"), ("Flood", "d0")], "name string, doc_id string")
    asked = {x.qid: x.prompt for x in batch.prompts(r, q, names, "General", skip=1).collect()}
    assert set(asked) == {"ins_1", "ins_2"} and "# Fire\n\n## A / 1" in asked["ins_1"] and asked["ins_1"].count("fire damage part 1") == 1
    assert "# Theft" in asked["ins_2"] and "insurance" in asked["ins_1"] and '{"Fire":"d1"}' in asked["ins_1"] and "Flood" not in asked["ins_2"]

    def model(prompt):
        if "Is theft?" in prompt:
            raise ConnectionError("down")
        return 'So: {"think": "t", "answer": "AB", "usage": 7}'

    got = {x.qid: x for x in batch.answer_questions(r, q, names, "General", model, str(folder / "out"), skip=1).collect()}
    assert got["ins_1"].answer == "AB" and got["ins_1"].usage == 7 and got["ins_2"].answer is None and "down" in got["ins_2"].error
    with pytest.raises(KeyError, match="Nowhere"):
        Q.require_names(Q.named_documents(q.limit(1).withColumn("doc_ids", F.array(F.lit("Nowhere"))), names))


def test_own_configuration(spark, folder):
    c = folder / "config"
    (c / "schemas").mkdir(parents=True)
    (c / "categories.yaml").write_text("categories:\n  - {id: own, name: Own, schema_file: own.json, classification: {method: keyword, threshold: 0.5, keywords: [{words: [zebra], weight: 1.0}]}}\n  - {id: rest, name: Rest, schema_file: rest.json, classification: {method: default}}\n")
    rest = {"fields": [], "default_channel_weights": dict.fromkeys(("entity_channel", "relation_channel", "title_channel", "content_channel"), 1.0)}
    (c / "schemas/rest.json").write_text(json.dumps(rest))
    r = Retriever(spark, str(folder / "docs"), str(folder / "plain"), config=str(c))
    assert r.classify("a zebra") == "own" and r.classify("none") == "rest" and r.schema_of("own") == rest


def test_reversed_map(spark):
    m = spark.createDataFrame([({"a": "x", "b": "y", "c": "x"},), ({},)], "m map<string,string>").select(Q.reversed_map(F.col("m")).alias("r")).collect()
    assert m[0].r == {"x": "c", "y": "b"} and m[1].r == {}


def test_many_terms(spark, monkeypatch):
    """Beyond MOST_TERMS, postings are joined; the result is the same."""
    from strataseek.operators import units

    u = spark.createDataFrame([(k, f"a b{k % 7} c{k % 3}") for k in range(40)], "id long, t string")
    post = units.postings(u, "id", ["t"])
    stats = units.statistics(post, 40)
    terms = spark.createDataFrame([(0, "x", "t", w, "term", 1.0) for w in ("a", "b1", "b2", "c0", "no")], "query_id long, channel string, field string, term string, kind string, boost double")
    one = sorted(map(tuple, S.bm25(terms, post, *stats).collect()))
    monkeypatch.setattr(S, "MOST_TERMS", 2)
    assert sorted(map(tuple, S.bm25(terms, post, *stats).collect())) == one and len(one) == 40
