"""Answering a batch of questions in one call: fan-out, retrieval, evidence, prompt, model, result lines."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataseek.operators import questions as Q
from strataseek.plans.engine import Retriever, RetrieveOptions
from strataseek.sources import documents as D


def found(retriever: Retriever, asked: DataFrame, documents: DataFrame, category: str | None, top_k: int = 5) -> DataFrame:
    """asked (qid, seq, query) and documents (qid, doc_id) -> (qid, seq, rank, chunk_id, ...): all queries in one plan, each as
    Retriever.retrieve_many takes it, with the model's fields and filters, within its question's documents. A query's groups
    follow one another in rank."""
    inside = documents.where("doc_id is not null").groupBy("qid").agg(F.collect_set("doc_id").alias("doc_ids"))
    q = asked.join(inside, "qid", "left").select(F.struct("qid", "seq").alias("query_id"), F.col("query").alias("text"), "doc_ids")
    hits = retriever.retrieve_many(q, RetrieveOptions(top_k=top_k), category)
    rank = (F.col("group_ix") * top_k + F.col("rank")).cast("int")
    return hits.withColumn("rank", rank).select("query_id.qid", "query_id.seq", *[c for c in hits.columns if c != "query_id"])


def _with_documents(asked: DataFrame, named: DataFrame) -> DataFrame:
    """Each query with its question's documents, by name, as the question that is retrieved for."""
    ids = named.groupBy("qid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "doc_id")))).alias("names"))
    with_ids = F.concat_ws("\n\n", "query", F.concat(F.lit("Documents: "), F.to_json("names")))
    return asked.join(ids, "qid", "left").select("qid", "seq", with_ids.alias("query"))


def prompts(retriever: Retriever, questions: DataFrame, names: DataFrame, category: str, skip: int = 0, top_k: int = 5, guide: str = Q.READING_GUIDE) -> DataFrame:
    """questions (as sources.documents.questions) x names (name, doc_id) -> (qid, prompt): each question's options fan out,
    their hits lose reading guides and repeats, are grouped by document in order of first sight, and rendered before the
    question. A question without evidence is asked with an empty one."""
    questions = Q.skipped(questions, skip) if skip else questions
    named = Q.require_names(Q.named_documents(questions, names))
    hits = found(retriever, _with_documents(Q.fanned_out(questions), named), named, category, top_k)
    hits = Q.first_hits(Q.without_title(hits, guide))
    seen = hits.groupBy("qid", "doc_id").agg(F.min(F.struct("seq", "rank", "chunk_id")).alias("doc_seq"))
    hits = Q.with_names(hits.join(seen, ["qid", "doc_id"]), names)
    text = Q.evidence(hits.select("qid", "doc_seq", "name", "section_path", "chunk_index", "content"))
    each = F.transform(F.array_sort(F.map_entries("options")), lambda e: F.concat(e["key"], F.lit(". "), e["value"]))
    asked = Q.question_prompt(F.col("question"), F.array_join(each, "\n"), F.col("names"))
    ids = named.groupBy("qid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "doc_id")))).alias("names"))
    whole = questions.join(ids, "qid", "left").join(text, "qid", "left")
    return whole.select("qid", Q.answer_prompt(F.col("qid"), F.col("answer_format"), asked, F.coalesce("text", F.lit(""))).alias("prompt"))


def answered(asked: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """asked (qid, prompt) -> (qid, raw, error, think, answer, usage): the model is called once a row, on the executors; what
    it raises is kept as error and the answer is null."""

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for p in b["prompt"]:
                try:
                    out.append((model(p), None))
                except Exception as e:  # whatever the model's client raises
                    out.append((None, f"{type(e).__name__}: {e}"))
            b["raw"], b["error"] = [x for x, _ in out], [x for _, x in out]
            yield b[["qid", "raw", "error"]]

    got = asked.mapInPandas(run, "qid string, raw string, error string")
    return got.withColumn("r", Q.parsed_reply(F.col("raw"))).select("qid", "raw", "error", "r.*")


def answer_questions(retriever: Retriever, questions: DataFrame, names: DataFrame, category: str | None, model: Callable[[str], str], path: str, skip: int = 0, top_k: int = 5) -> DataFrame:
    """The whole batch: answers are appended to path as JSON lines, a line for each question. -> this batch's answers, as
    written; the model is asked once."""
    mark = uuid.uuid4().hex
    out = answered(prompts(retriever, questions, names, category, skip, top_k), model).withColumn("batch", F.lit(mark))
    D.append_lines(out, path)
    return out.sparkSession.read.schema(out.schema).json(path).where(F.col("batch") == mark)
