"""The stored index: direct searches by its analyzer, filters that hold, generations, segments, batches."""

import json

import pytest
from conftest import document
from pyspark.sql import functions as F

from strataseek.functions import analysis
from strataseek.operators import language as L
from strataseek.operators import questions as Q
from strataseek.plans import batch
from strataseek.plans.engine import Retriever, RetrieveOptions
from strataseek.sources import documents as D
from strataseek.sources import store as store_module
from strataseek.sources.store import Store
from strataseek.streaming.incremental import index_stream


def put(folder, docs):
    folder.mkdir(parents=True, exist_ok=True)
    for i, d in enumerate(docs):
        (folder / f"{i}-{d['doc_id']}.json").write_text(json.dumps(d, ensure_ascii=False))
    return str(folder)


ids = lambda df: [x.unit for x in df.collect()]


def test_direct_search_by_the_analyzer(spark, tmp_path):
    docs = [document(0, "等待期九十天 flood_damage"), document(1, "本合同无等候期 ABC公司"), document(2, "没有关系")]
    docs[1]["chunks"][0]["entities"] = [{"name": "等待期条款", "desc": None}]
    r = Retriever(spark, put(tmp_path / "docs", docs), str(tmp_path / "index"))
    assert ids(r.search_chunks("等待期")) == [f"d0_chunk_{k}_v1" for k in range(3)]
    assert ids(r.search_chunks('"等待期九十天 flood"')) == ids(r.search_chunks("等待期"))[:3] and ids(r.search_chunks('"九十天等待期"')) == []
    assert ids(r.search_entities("等待期")) == ["d1_chunk_0_v1_entity_0"] and len(ids(r.search_relations("object:等待期", 20))) == 3
    assert len(ids(r.search_chunks("ABC公司"))) == len(ids(r.search_chunks("flood_damage"))) == 3
    assert len(ids(r.search_chunks("等待期 OR ABC公司"))) == 6 and len(ids(r.search_chunks("NOT (等待期 OR 公司)"))) == 3
    assert ids(r.search_chunks("等?期 part 1")) == [] and len(ids(r.search_chunks("fl*d* OR *amage"))) == 3
    assert ids(r.search_chunks("等待期", doc_ids=["d1"])) == ids(r.search_chunks("等待期", doc_ids=[])) == []
    assert len(ids(r.search_chunks("part", 20, ["d1", "nope"]))) == 3 and len(ids(r.search_chunks("-等待期", 20, ["d0"]))) == 0


def test_dictionary(spark, tmp_path):
    words = {"等待期": 20, "九十天": 8, "等待": 10, "保险合同": 2, "保险": 50, "合同": 40}
    a = analysis.DictionaryTokens(words)
    assert a.path("保险合同等待期九十天") in (["保险", "合同", "等待期", "九十天"], ["保险合同", "等待期", "九十天"])
    assert analysis.DictionaryTokens(words | {"保险合同": 500}).path("保险合同等待期")[0] == "保险合同"  # user words win by frequency
    assert a.path("等候期") == ["等", "候", "期"] and a.path("") == []
    with pytest.raises(ValueError):
        Retriever(spark, "none", str(tmp_path / "index"), analyzer="dictionary")
    (tmp_path / "words.txt").write_text("等待期 20 n\n九十天 8\n等待 10\n\n期九\n", encoding="utf-8")
    docs = put(tmp_path / "docs", [document(0, "等待期九十天"), document(1, "等待很久")])
    r = Retriever(spark, docs, str(tmp_path / "index"), analyzer="dictionary", dictionary=str(tmp_path / "words.txt"))
    assert {x.term for x in r.index["terms"].where("field = 'content'").collect()} >= {"等待期", "九十天", "等待", "很", "久"}
    assert {x.doc_id for x in r.search_chunks("等待期").collect()} == {"d0"} and {x.doc_id for x in r.search_chunks("等待").collect()} == {"d1"}
    assert {x.doc_id for x in r.retrieve("等待期多长", RetrieveOptions(top_k=20), "General").collect()} == {"d0"}


def test_filters_hold(spark, folder):
    r = Retriever(spark, str(folder / "docs"), str(folder / "index"), "insurance")
    docs = lambda *given: {x.doc_id for x in r.retrieve("damage part", RetrieveOptions(top_k=50, doc_ids=list(given)), "Policies").collect()}
    assert docs() == {"d0", "d1"} and docs("nope") == set() and docs("d1", "nope") == {"d1"}
    r.extractor = lambda question, prompt: json.dumps([{"query": {"contract_name": "theft"}, "filter": {"doc_ids": []}}])
    assert docs() == {"d2"} and docs("d1") == set() and docs("d1", "d2") == {"d2"}
    assert r.retrieve("?!", RetrieveOptions(doc_ids=["nope"]), "General").count() == 0


def test_unreadable_answers(spark, folder):
    asked = []

    def model(question, prompt):
        asked.append(1)
        return answers[(len(asked) - 1) % len(answers)]

    r = Retriever(spark, str(folder / "docs"), str(folder / "plain"), "default", model)
    good = '{"query": {"query_text": 5}, "filter": {"doc_ids": []}}'
    for answers, calls, fails in ((["no idea", f"so: {good}"], 2, False), (["no idea"], 2, True), (['{"query": {}}', None], 2, True), ([good], 1, False), ([f"[{good}] and {good}"], 2, True)):
        asked.clear()
        got = r.retrieve("fire damage", None, "General").first()
        assert len(asked) == calls and ("Error: " in (got.warning or "")) == fails, answers
        assert json.loads(got.extracted_fields) == {"query_text": "fire damage" if fails else "5"}


def test_batch_equals_each_question(spark, folder):
    def model(question, prompt):
        if "broken" in question:
            return "nothing to say"
        if "contract_name" in prompt:
            return json.dumps([{"query": {"contract_name": "theft" if "theft" in question else None}, "filter": {"doc_ids": []}}])
        return json.dumps([{"query": {"clause": "Section 1", "query_text": question}, "filter": {"doc_ids": []}}, {"query": {"clause": None}, "filter": {"doc_ids": []}}])

    r = Retriever(spark, str(folder / "docs"), str(folder / "index"), "insurance", model)
    asked = [("fire damage part 1", None), ("broken: flood", None), ("theft part", ["d2", "d1"]), ("the market of theft", None), ("part 2", ["nope"]), ("??", None)]
    for category, asked, found in ((None, asked, {0, 1, 2, 3, 5}), ("Policies", asked[2:3], {0})):
        q = spark.createDataFrame([(k, t, d) for k, (t, d) in enumerate(asked)], "query_id long, text string, doc_ids array<string>")
        got = [tuple(x) for x in r.retrieve_many(q, RetrieveOptions(top_k=3), category).select("query_id", "group_ix", "rank", "chunk_id", "score", "category", "warning", "extracted_fields").collect()]
        want = []
        for k, (text, d) in enumerate(asked):
            one = r.retrieve(text, RetrieveOptions(top_k=3, doc_ids=d or []), category)
            want += [(k, *x) for x in one.select("query_id", "rank", "chunk_id", "score", "category", "warning", "extracted_fields").collect()]
        assert sorted(map(str, got)) == sorted(map(str, want)) and {x[0] for x in got} == found


def test_failed_build_leaves_the_old_index(spark, folder, monkeypatch):
    at = (spark, str(folder / "docs"), str(folder / "index"), "insurance")
    before = ids(Retriever(*at).search_chunks("part", 20))
    put(folder / "docs" / "new", [document(8, "hail damage")])

    def broken(*a):
        raise OSError("disk full")

    with monkeypatch.context() as m:
        m.setattr(store_module.vocabulary, "grams", broken)
        with pytest.raises(OSError):
            Retriever(*at, rebuild=True)
    r = Retriever(*at)
    assert ids(r.search_chunks("part", 20)) == before and ids(r.search_chunks("hail")) == []
    r.rebuild_index()
    assert len(ids(r.search_chunks("hail"))) == 3
    r.store.vacuum()
    assert len(list((folder / "index" / "cjk" / "segments").iterdir())) == 1 and len(ids(Retriever(*at).search_chunks("hail"))) == 3
    with pytest.raises(RuntimeError):  # whose number is taken
        told = r.store.manifest()
        r.store._commit(told | {"number": told["number"] - 1})


def test_stream_equals_rebuild(spark, tmp_path):
    """Documents in three deliveries, two replaced by later versions, one stale; searches answer as from an index built anew."""
    version = lambda d, n: d | {"version_ts": n}
    first = [document(0, "flood damage"), document(1, "fire damage"), document(2, "theft of 等待期")]
    second = [version(document(1, "hail damage and more"), 2), document(3, "storm damage")]
    third = [version(document(1, "stale words"), 1), version(document(0, "fluid damage"), 5), document(4, "theft")]
    source, index, checkpoint = tmp_path / "in", str(tmp_path / "live"), str(tmp_path / "cp")
    for k, docs in enumerate((first, second, third)):
        put(source / str(k), docs)
        index_stream(spark, str(source), index, checkpoint, "insurance").awaitTermination(300)
    live = Retriever(spark, str(source), index, "insurance")
    assert len(live.store.manifest()["segments"]) == 3
    now = [third[1], second[0], first[2], second[1], third[2]]
    built = Retriever(spark, put(tmp_path / "all", now), str(tmp_path / "built"), "insurance")

    def same():
        for name in ("terms", "fields"):
            rows = lambda r: sorted(str(tuple(x)) for x in r.index[name].select(sorted(r.index[name].columns)).collect())  # noqa: E731, B023
            assert rows(live) == rows(built)
        for text in ("damage", "等待期", "flood", "*amage -hail", '"damage and more"'):
            hits = lambda r: [(x.unit, x.score) for x in r.search_chunks(text, 20).collect()]  # noqa: E731, B023
            assert hits(live) == hits(built), text
        hits = lambda r: [(x.chunk_id, x.score) for x in r.retrieve("fluid damage part", RetrieveOptions(top_k=50), "Policies").orderBy("rank").collect()]
        assert hits(live) == hits(built) and hits(built)

    same()
    live.store.upsert(D.insurance_documents(spark, str(source / "1")), checkpoint, 1)  # a batch taken before
    live.store.compact()
    live.refresh()
    told = live.store.manifest()
    assert len(told["segments"]) == 1 and told["deletes"] == [] and told["streams"] == {checkpoint: 2}
    same()
    live.store.delete(spark.createDataFrame([("d4",), ("d9",)], "doc_id string"))
    live.refresh()
    assert {x.doc_id for x in live.search_chunks("theft", 20).collect()} == {"d2"} and live.tables["chunks"].count() == 12


def test_store_of_nothing(spark, tmp_path):
    r = Retriever(spark, str(tmp_path / "none"), str(tmp_path / "index"))
    assert ids(r.search_chunks("a")) == [] and r.retrieve("a word", None, "General").count() == 0
    assert Store(spark, str(tmp_path / "other")).tables()["chunks"].count() == 0


def test_deep_trees(spark, tmp_path):
    node = {"title": "level 10", "chunk_id_start": "c", "children": None}
    for k in range(9, 0, -1):
        node = {"title": f"level {k}", "children": [node, {"title": f"side {k}"}]}
    d = document(0, "x")
    d["chunks"][0]["doc_tree"] = node
    got = D.sections(D.json_documents(spark, put(tmp_path, [d]))).collect()
    deepest = max(got, key=lambda x: x.level)
    assert len(got) == 19 and deepest.path == [f"level {k}" for k in range(1, 11)] and deepest.chunk_id_start == "c"
    odd = spark.createDataFrame([("a", ["{", None, "3", "[]"]), ("b", None)], "doc_id string, doc_tree array<string>")
    assert D.sections(odd).collect() == []


def test_language(spark):
    fields = ["title", "name"]
    shape = lambda t: (t.tokens or t.pattern, t.field, t.boost) if isinstance(t, L.Leaf) else t and (t.op, *map(shape, t.parts))
    read = lambda text: shape(L.parse(text, spark, fields))
    a, b, c = (((x,), None, 1.0) for x in "abc")
    assert read("a b OR c") == ("and", a, ("or", b, c)) and read("a AND b OR c") == ("or", ("and", a, b), c)
    assert read("a -b") == read("a NOT b") == read("(a) NOT (b") == ("and", a, ("not", b))
    assert read("title:(a b)^2") == ("and", (("a",), "title", 2.0), (("b",), "title", 2.0)) and read("other:a") == ("and", (("other",), None, 1.0), a)
    assert read('"A b"') == (("a", "b"), None, 1.0) and read("a*b?") == ("a*b?", None, 1.0)
    assert read("") is read("!!! ()") is read("OR") is read(")") is None


def test_skipped(spark):
    df = spark.createDataFrame([(x, k) for k, x in enumerate(["b", "a", "c", "a", None, "d"])], "qid string, k int")
    assert sorted(x.qid for x in Q.skipped(df, 3).collect()) == ["b", "c", "d"] and Q.skipped(df, 0).count() == 6 and Q.skipped(df, 9).count() == 0
    assert sorted(x.qid for x in Q.skipped(df, 2).collect()) == ["a", "b", "c", "d"]


def test_answers_of_a_batch_are_its_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(batch, "prompts", lambda r, questions, *rest: questions.select("qid", F.lit("asked").alias("prompt")))
    out = str(tmp_path / "out")
    for i in ("ins_1", "ins_2"):
        q = spark.createDataFrame([(i,)], "qid string")
        got = batch.answer_questions(None, q, None, "General", lambda p: '{"answer": "A"}', out).collect()
        assert [(x.qid, x.answer) for x in got] == [(i, "A")]
    assert spark.read.json(out).count() == 2
