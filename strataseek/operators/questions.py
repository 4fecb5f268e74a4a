"""Classification, extraction results, question fan-out and the rendering of evidence."""

from __future__ import annotations

import json
import re
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataseek.functions.analysis import HAN_RUNS, DictionaryTokens, cjk_tokens, tokens


def contained(texts: DataFrame, words: list[str]) -> DataFrame:
    """texts (query_id, text) -> (query_id, word): which of the words each text contains, each once. An automaton of all words
    (Aho-Corasick) reads each text once, however many words there are; it is made once a task."""

    def run(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for w in words:
            automaton.add_word(w, w)
        automaton.make_automaton()
        for b in batches:
            found = [(i, w) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for w in {w for _, w in automaton.iter(t or "")}]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], b.schema.field(0).type), pa.array([w for _, w in found], pa.string())], names=["query_id", "word"])

    kind = texts.schema["query_id"].dataType.simpleString()
    return texts.select("query_id", "text").mapInArrow(run, f"query_id {kind}, word string")


def keyword_scores(questions: DataFrame, keywords: DataFrame, analyze=tokens) -> DataFrame:
    """questions (query_id, text) -> (query_id, category_id, priority, threshold, score): over groups, weight times the
    share of listed words found; a one-character word is looked for among characters. Case counts. Words meet tokens in
    an equi-join; keywords are configuration and broadcast. With cjk_tokens, Han characters don't join the words beside them
    and a word with Han characters is found wherever the text contains it; with a dictionary, words are its tokens."""
    cjk = analyze is cjk_tokens
    own = analyze.words(F.col("text")) if isinstance(analyze, DictionaryTokens) else F.regexp_extract_all(F.col("text"), F.lit(HAN_RUNS if cjk else r"([\p{L}\p{N}]+)"), F.lit(1))
    bits = questions.select("query_id", F.explode(F.array_distinct(F.concat(own, F.filter(F.split("text", ""), lambda c: c != "")))).alias("word"))
    inside = F.col("word").rlike(r"\p{IsHan}") & (F.length("word") > 1)
    hits = bits.join(F.broadcast(keywords.where(~inside) if cjk else keywords), "word")
    if cjk and (words := [r["word"] for r in keywords.where(inside).select("word").distinct().collect()]):  # configuration
        hits = hits.unionByName(contained(questions, words).join(F.broadcast(keywords), "word").select(hits.columns))
    return hits.groupBy("query_id", "category_id", "priority", "threshold").agg(F.round(F.sum(F.col("weight") / F.col("group_size")), 6).alias("score"))


def classified(questions: DataFrame, keywords: DataFrame, default: str, analyze=tokens) -> DataFrame:
    """The best category that reaches its threshold (the earliest of equals; a score of 0 never wins), else the default."""
    s = keyword_scores(questions, keywords, analyze).where("score >= threshold and score > 0")
    best = s.groupBy("query_id").agg(F.min_by(F.struct("category_id", "score"), F.struct(-F.col("score"), F.col("priority"))).alias("b"))
    return questions.join(best, "query_id", "left").select("query_id", F.coalesce("b.category_id", F.lit(default)).alias("category_id"), F.coalesce("b.score", F.lit(0.0)).alias("score"))


class Extractor(Protocol):
    """Fills a schema's fields: (question, prompt) -> the raw answer of a model."""

    def __call__(self, question: str, prompt: str) -> str: ...


def extraction_prompt(schema: dict, question: str) -> str:
    fields = "\n".join(f"- {f['field_name']} ({f['field_type']}, {'required' if f.get('required') else 'optional'}): {f['description']}" for f in schema["fields"])
    example = ", ".join(f'"{f["field_name"]}": null' for f in schema["fields"])
    return f"Fill these fields from the question; use null where it says nothing.\n{fields}\n\nQuestion: {question}\nAnswer as JSON: [{{\"query\": {{{example}}}, \"filter\": {{\"doc_ids\": []}}}}]"


class Failed(Exception):
    """Every attempt to extract failed; says how the last one did."""


def read_answer(raw: str) -> str:
    """A model's answer as the JSON that parsed_answers takes: a list of records with query (field -> text or null) and
    filter.doc_ids. The answer is JSON, or holds JSON from its first brace to its last; one object is a list of one. ValueError
    if it can't be read or a record lacks one of them."""
    try:
        got = json.loads(raw)
    except ValueError:
        inner = re.search(r"[{][\s\S]*[}]", raw)
        if not inner:
            raise ValueError(f"no JSON in the answer: {raw[:200]}") from None
        try:
            got = json.loads(inner[0])
        except ValueError:
            got = json.loads(f"[{inner[0]}]")
    out = []
    for record in got if isinstance(got, list) else [got]:
        try:
            ids, query = record["filter"]["doc_ids"], record["query"].items()
        except (KeyError, TypeError, AttributeError):
            raise ValueError(f"a record lacks its query or filter: {str(record)[:200]}") from None
        out.append({"query": {str(k): None if v is None else str(v) for k, v in query}, "filter": {"doc_ids": [str(i) for i in ids or []]}})
    return json.dumps(out, ensure_ascii=False)


def extracted(extractor: Extractor, schema: dict, question: str, attempts: int = 2) -> str:
    """The answer as read_answer gives it; an answer that can't be read counts as a failed attempt. Failed once every attempt has
    failed, which the caller turns into a warning and free text."""
    last: Exception | None = None
    for _ in range(attempts):
        try:
            return read_answer(extractor(question, extraction_prompt(schema, question)) or "")
        except Exception as e:  # whatever the model's client raises
            last = e
    raise Failed(f"{type(last).__name__}: {last}")


def extracted_batch(questions: DataFrame, extractor: Extractor, schemas: dict[str, dict], attempts: int = 2) -> DataFrame:
    """questions (query_id, text, schema_id) -> (query_id, fields, filters, fields_error, filters_error): both answers of each
    question, or how they failed. The model is asked on the executors, once for each schema that has filters and once for the
    fields; a failure stays with its question."""

    def asked(text: str, schema: dict, key: str) -> tuple[str | None, str | None]:
        try:
            return extracted(extractor, schema | {"fields": schema[key]}, text, attempts), None
        except Failed as e:
            return None, str(e)

    def run(batches):
        for b in batches:
            out = []
            for i, text, name in b[["query_id", "text", "schema_id"]].itertuples(index=False):
                schema = schemas[name]
                fields, failed = asked(text or "", schema, "fields")
                filters, unfiltered = asked(text or "", schema, "filters") if schema.get("filters") else (None, None)
                out.append((i, fields, filters, failed, unfiltered))
            yield pd.DataFrame(out, columns=["query_id", "fields", "filters", "fields_error", "filters_error"])

    kind = questions.schema["query_id"].dataType.simpleString()
    return questions.select("query_id", "text", "schema_id").mapInPandas(run, f"query_id {kind}, fields string, filters string, fields_error string, filters_error string")


def parsed_answers(raw: F.Column) -> F.Column:
    """array<struct<query map, filter struct<doc_ids>>>: the answer as JSON, or the JSON from its first brace to its last;
    one object counts as a list of one; null if neither parses or a record lacks its query or filter."""
    kind = "array<struct<query:map<string,string>,filter:struct<doc_ids:array<string>>>>"
    def read(x):
        boxed = F.when(F.ltrim(x).startswith("["), x).otherwise(F.concat(F.lit("["), x, F.lit("]")))
        got = F.from_json(boxed, kind, {"mode": "PERMISSIVE"})
        return F.when((F.size(got) > 0) & F.forall(got, lambda r: r["query"].isNotNull() & r["filter"].isNotNull()), got)
    return F.coalesce(read(raw), read(F.nullif(F.regexp_extract(raw, r"[{][\s\S]*[}]", 0), F.lit(""))))


def with_fallback(fields: F.Column, question: F.Column) -> F.Column:
    """The extracted map, or the question as free text where there is none."""
    return F.coalesce(fields, F.create_map(F.lit("query_text"), question))


def _with_schema_fields(df: DataFrame, schema_fields: DataFrame) -> DataFrame:
    """Each row with the fields of its schema_id, or with all where df has none; schemas are configuration."""
    small = F.broadcast(schema_fields)
    return df.join(small, "schema_id") if "schema_id" in df.columns else df.crossJoin(small)


def query_fields(extracted: DataFrame, schema_fields: DataFrame) -> DataFrame:
    """extracted (query_id, fields map, perhaps schema_id) x schema_fields -> a row for each field with its value. A query
    without any value gets one placeholder on content instead."""
    f = _with_schema_fields(extracted, schema_fields).withColumn("value", F.expr("try_element_at(fields, field_name)"))
    f = f.withColumn("some", F.max(F.col("value").isNotNull()).over(Window.partitionBy("query_id")))
    f = f.select("query_id", F.when(F.col("some"), F.col("field_name")).otherwise("query_text").alias("field_name"), F.when(F.col("some"), F.col("value")).otherwise("PLACEHOLDER").alias("value"), F.when(F.col("some"), F.col("target")).otherwise("content").alias("target"), F.when(F.col("some"), F.col("match_method")).otherwise("substring").alias("match_method"), F.when(F.col("some"), F.col("weight")).otherwise(1.0).alias("weight"), (~F.col("some")).alias("placeholder"))
    return f.where("not placeholder").unionByName(f.where("placeholder").distinct())


def fanned_out(questions: DataFrame) -> DataFrame:
    """questions (qid, question, options map, answer_format) -> (qid, seq, query): a true-false question asks once with all
    options, the others once for each option."""
    option = lambda e: F.concat(e["key"], F.lit(". "), e["value"])
    each = F.transform(F.array_sort(F.map_entries("options")), option)
    queries = F.when(F.col("answer_format") == "tf", F.array(F.concat_ws("\n", "question", F.array_join(each, "\n")))).otherwise(F.transform(each, lambda o: F.concat_ws("\n", F.col("question"), o)))
    return questions.select("qid", F.posexplode(queries).alias("seq", "query"))


def first_hits(hits: DataFrame, by: str = "qid") -> DataFrame:
    """hits (qid, seq, rank, chunk_id, ...): each chunk once, where it came first."""
    w = Window.partitionBy(by, "chunk_id").orderBy("seq", "rank")
    return hits.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def best_per_document(hits: DataFrame) -> DataFrame:
    return ranked_first(hits, ["query_id", "doc_id"])


def ranked_first(hits: DataFrame, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.round("score", 6).desc(), "chunk_id")
    return hits.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def cut_with_rescue(hits: DataFrame, least: float = 0.2) -> DataFrame:
    """Scores above `least`, and each document's best in any case."""
    w = Window.partitionBy("query_id", "doc_id").orderBy(F.round("score", 6).desc(), "chunk_id")
    return hits.withColumn("n", F.row_number().over(w)).where((F.col("score") > least) | (F.col("n") == 1)).drop("n")


#: Fixed value: the section title of a reading guide, left out of the evidence.
READING_GUIDE = "阅读指引"


def without_title(hits: DataFrame, marker: str = READING_GUIDE) -> DataFrame:
    return hits.where(~F.contains(F.replace(F.col("section_title"), F.lit(" "), F.lit("")), F.lit(marker)))


def evidence(hits: DataFrame) -> DataFrame:
    """hits (qid, doc_seq, name, section_path, chunk_index, content) -> (qid, text): documents in order of first sight,
    chunks by index, a section's heading where it comes first in the question."""
    w = Window.partitionBy("qid", "section_path").orderBy("doc_seq", "chunk_index")
    h = hits.withColumn("head", F.when(F.row_number().over(w) == 1, F.concat(F.lit("## "), "section_path")))
    part = F.concat_ws("\n\n", "head", "content")
    doc = h.groupBy("qid", "doc_seq", "name").agg(F.array_sort(F.collect_list(F.struct("chunk_index", part.alias("t")))).alias("parts"))
    doc = doc.withColumn("t", F.concat(F.lit("# "), "name", F.lit("\n\n"), F.array_join(F.transform("parts", lambda p: p["t"]), "\n\n")))
    return doc.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("doc_seq", "t"))).alias("docs")).select("qid", F.array_join(F.transform("docs", lambda d: d["t"]), "\n\n").alias("text"))


# The domains by question-id prefix.
DOMAINS = {"res": "research", "fc": "financial contracts", "reg": "regulation", "fin": "financial reports", "ins": "insurance"}


def answer_prompt(qid: F.Column, kind: F.Column, question: F.Column, text: F.Column) -> F.Column:
    """The answering instructions for the domain of the question's id and its kind."""
    domain = F.create_map(*[F.lit(x) for kv in DOMAINS.items() for x in kv])
    what = F.when(kind == "multi", "multiple choice").otherwise("single choice")
    return F.concat(F.lit("You answer "), F.coalesce(domain[F.split_part(qid, F.lit("_"), F.lit(1))], F.lit("general")), F.lit(" questions ("), what, F.lit(").\n\n"), text, F.lit("\n\n"), question)


def filter_groups(answers: DataFrame, filters: DataFrame) -> DataFrame:
    """answers (query_id, raw, perhaps schema_id) x the schemas' filters -> (query_id, filter_ix, field_name, value, target,
    match_method, weight): a group for each object in the model's answer, with the filters that it fills."""
    own = ["query_id", *[c for c in answers.columns if c == "schema_id"]]
    groups = answers.select(*own, F.posexplode(parsed_answers(F.col("raw")).getField("query")).alias("filter_ix", "fields"))
    f = _with_schema_fields(groups, filters).withColumn("value", F.expr("try_element_at(fields, field_name)"))
    return f.where("value is not null").select("query_id", "filter_ix", "field_name", "value", "target", "match_method", "weight")


def field_map(fields: DataFrame) -> DataFrame:
    """(query_id, field_name, value, ...) -> (query_id, fields): each query's values by field name, as JSON in name order."""
    pairs = F.array_sort(F.collect_list(F.struct("field_name", "value")))
    return fields.where("value is not null").groupBy("query_id").agg(F.to_json(F.map_from_entries(pairs)).alias("fields"))


def responses(questions: DataFrame, hits: DataFrame, limit: int | None = None) -> DataFrame:
    """questions (query_id, question, category, fields, warning) and hits (query_id, rank, chunk_id, score) -> a record each:
    total (hits found), returned (at most `limit`) and results, best first; questions without hits have an empty list."""
    h = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "score"))).alias("all"))
    some = F.coalesce("all", F.array().cast("array<struct<rank:int,chunk_id:string,score:double>>"))
    cut = F.slice(some, 1, limit) if limit else some
    out = questions.join(h, "query_id", "left").withColumns({"total": F.size(some).cast("long"), "results": cut})
    return out.withColumn("returned", F.size("results").cast("long")).drop("all")


def with_schema(categories: DataFrame, schemas: DataFrame, default: str) -> DataFrame:
    """categories (query_id, category_id) -> adds schema_id: the category's own schema, else the default's."""
    have = schemas.select(F.col("category_id").alias("schema_id")).distinct()
    return categories.join(F.broadcast(have), F.col("category_id") == F.col("schema_id"), "left").withColumn("schema_id", F.coalesce("schema_id", F.lit(default)))


def named_documents(questions: DataFrame, names: DataFrame) -> DataFrame:
    """questions (qid, doc_ids: document names) x names (name, doc_id) -> (qid, seq, name, doc_id); doc_id is null for a name
    that isn't there."""
    q = questions.select("qid", F.posexplode("doc_ids").alias("seq", "name"))
    return q.join(names, "name", "left").select("qid", "seq", "name", "doc_id")


def require_names(named: DataFrame) -> DataFrame:
    """named, or a KeyError that lists unknown names (the first hundred)."""
    lost = [r["name"] for r in named.where("doc_id is null").select("name").distinct().orderBy("name").limit(100).collect()]
    if lost:
        raise KeyError(f"no document is named {', '.join(lost)}")
    return named


def with_names(hits: DataFrame, names: DataFrame) -> DataFrame:
    """hits (doc_id, ...) -> those of named documents, with their name; of several names the last one."""
    return hits.join(names.groupBy("doc_id").agg(F.max("name").alias("name")), "doc_id")


def question_prompt(question: F.Column, options: F.Column, names: F.Column) -> F.Column:
    """The question to retrieve for: the question, its options, and the documents' ids by name as JSON."""
    return F.concat_ws("\n\n", question, options, F.concat(F.lit("Documents: "), F.to_json(names)))


def reversed_map(m: F.Column) -> F.Column:
    """value -> key; of equal values the last key."""
    swapped = F.transform(F.map_entries(m), lambda e: F.struct(e["value"].alias("key"), e["key"].alias("value")))
    last = F.filter(swapped, lambda e, i: ~F.exists(F.slice(swapped, i + 2, F.greatest(F.size(swapped) - i - 1, F.lit(0))), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(last)


def parsed_reply(raw: F.Column) -> F.Column:
    """struct<think, answer, usage>: an answering model's JSON, or the JSON from its first brace to its last; null if neither
    parses or there is no answer."""
    kind = "think string, answer string, usage long"
    read = lambda x: F.when(F.from_json(x, kind)["answer"].isNotNull(), F.from_json(x, kind))
    return F.coalesce(read(raw), read(F.nullif(F.regexp_extract(raw, r"[{][\s\S]*[}]", 0), F.lit(""))))


def skipped(df: DataFrame, n: int, by: str = "qid") -> DataFrame:
    """df without the first n rows by `by`; a row's place is the number of those before it. Only the n rows to leave out are
    gathered (the n least, kept by each task as it sorts), the others stay where they are."""
    if n <= 0:
        return df
    least = df.select(by).orderBy(F.col(by).asc_nulls_first()).limit(n)
    last = least.groupBy(by).agg(F.count("*").alias("_gone"))
    w = Window.partitionBy(by).orderBy(F.lit(1))
    numbered = df.withColumn("_nth", F.row_number().over(w))
    kept = numbered.join(F.broadcast(last).withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by")), "left")
    return kept.where("_gone is null or _nth > _gone").drop("_nth", "_by", "_gone")
