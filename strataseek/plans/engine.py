"""The retriever: classification, extraction, structured search in batch, and one question as a batch of one."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strataseek.functions.local import brought_here, local_rows
from strataseek.operators import bounds
from strataseek.operators import questions as Q
from strataseek.operators import search as S
from strataseek.sources import documents as D
from strataseek.sources.store import SEARCHED, Store


@dataclass
class RetrieveOptions:
    top_k: int = 10
    min_score: float = 0.01
    include_adjacent: bool = True
    adjacent_count: int = 1
    doc_ids: list[str] = field(default_factory=list)
    alias_targets: bool = False

    def __post_init__(self):
        if not 1 <= self.top_k <= 100 or not 0 <= self.min_score <= 1 or not 0 <= self.adjacent_count <= 5:
            raise ValueError("top_k is 1 to 100, min_score 0 to 1, adjacent_count 0 to 5")


def structured_search(terms: DataFrame, index: dict[str, DataFrame], weights: DataFrame, top_k: int, docs: DataFrame | None = None, least: float = S.LEAST_SCORE, tokenless: DataFrame | None = None, limited: DataFrame | None = None, words: list[str] | None = None) -> DataFrame:
    """terms as of search.field_terms; index: postings (field, unit, term, tf, dl), terms, fields, and owner (unit, chunk_id,
    doc_id) unless postings have chunk_id and doc_id themselves. Hits are limited in each channel, folded to chunks, normalized,
    fused, and cut. tokenless (query_id): queries whose free text has no tokens; every chunk matches their content. docs
    (query_id, doc_id) restrict all queries, or with limited (query_id) those named there; a restricted query without docs finds
    nothing. weights: as for search.fused; words: as for search.asked_only. With packed lists in the index (operators.bounds),
    channels of few hits open only the ranges that can reach these."""
    own = "chunk_id" in index["postings"].columns
    owner = None if own else index["owner"]
    post = index["postings"] if own or docs is None else index["postings"].join(owner.select("unit", "doc_id"), "unit")
    few = F.col("channel").isin([c for c, n in S.CHANNEL_LIMIT.items() if n == S.CHANNEL_LIMIT["content"]])
    hits = S.bm25(terms.where(~few) if "lists" in index else terms, post, index["terms"], index["fields"], docs, limited, words=words, limits=S.CHANNEL_LIMIT)
    if "lists" in index:
        hits = hits.unionByName(bounds.reaching(terms.where(few), index["lists"], index["terms"], index["fields"], S.CHANNEL_LIMIT["content"], docs, limited, words, index.get("dead")))
    hits = hits.select("query_id", "channel", "unit", *(["chunk_id"] if own else []), "score")
    if tokenless is not None:
        chunks = index["chunks"] if own else owner.where("unit = chunk_id").select("chunk_id", "doc_id")
        free = tokenless.select("query_id")
        found = []
        if docs is not None:  # a restricted one meets the chunks of its own documents only
            found.append(docs.join(free, "query_id", "left_semi").join(chunks.select("chunk_id", "doc_id"), "doc_id").select("query_id", F.lit("content").alias("channel"), F.col("chunk_id").alias("unit"), F.lit(1.0).alias("score")))
            free = free.join(limited, "query_id", "left_anti") if limited is not None else None
        if free is not None:  # equal scores rank by id, so more than the limit can't count
            found.append(S.every(chunks.select(F.col("chunk_id").alias("unit")).orderBy("unit").limit(S.CHANNEL_LIMIT["content"]), free))
        for f in found:
            hits = hits.unionByName(f.withColumn("chunk_id", F.col("unit")) if own else f)
    # channels of one limit together: a limit that is a number cuts hits before they are shuffled
    asked = {r["channel"] for r in terms.select("channel").distinct().collect()} | ({"content"} if tokenless is not None else set())
    limits = sorted({n for c, n in S.CHANNEL_LIMIT.items() if c in asked}) or [0]
    hits, parts = hits.withColumn("score", F.round("score", 6)), []
    for n in limits:
        some = hits.where(F.col("channel").isin([c for c, m in S.CHANNEL_LIMIT.items() if m == n])) if len(limits) > 1 else hits
        parts.append(S.ranked(some, ["query_id", "channel"], n))
    hits = reduce(DataFrame.unionByName, parts)
    best = hits.groupBy("query_id", "channel", "chunk_id").agg(F.max("score").alias("score")) if own else S.best_per_chunk(hits, owner.select("unit", "chunk_id"))
    return S.top(S.fused(S.normalized(best), weights), top_k, least)


_FIELD_ROWS = "schema_id string, field_name string, target string, match_method string, weight double"


class Retriever:
    """Over a folder of JSON documents, indexed under index_path (sources.store). kind: default or insurance (with metadata).
    analyzer: cjk, which reads Chinese as pairs of characters and other text as words, words, or dictionary, which segments
    Chinese by `dictionary` (word -> frequency, or the path of a file as of sources.documents.dictionary); each has an index of
    its own, and so has each dictionary. config: a folder with categories.yaml and schemas, else the package's. bounded: an index built now
    has packed lists too, by which batches of short questions score a part of the chunks that hold their words."""

    def __init__(self, spark: SparkSession, documents: str, index_path: str, kind: str = "default", extractor: Q.Extractor | None = None, rebuild: bool = False, analyzer: str = "cjk", config: str | None = None, dictionary: dict[str, int] | str | None = None, bounded: bool = False):
        self.spark, self.documents, self.kind, self.extractor = spark, documents, kind, extractor
        self.index_path, self.analyze = D.index_folder(spark, index_path, analyzer, dictionary)
        self.categories = D.categories(folder=config)
        self.schemas = D.schemas(self.categories, config)
        self.store = Store(spark, self.index_path, kind, self.analyze, bounded)
        self.rebuild_index() if rebuild or self.store.manifest() is None else self.refresh()

    def rebuild_index(self) -> None:
        """All tables, metadata included, anew from the documents. The index before serves until the new one is whole."""
        self.store.rebuild((D.insurance_documents if self.kind == "insurance" else D.json_documents)(self.spark, self.documents))
        self.refresh()

    def refresh(self) -> None:
        """Reads the index as it is now, with what streams have added."""
        self.tables = self.store.tables()
        self.index = self.store.index() | {"chunks": self.tables["chunks"]}

    def schema(self, name: str) -> StructType | None:
        """The columns of a stored table: chunks, entities, relations, or metas where there are any."""
        return self.tables[name].schema if name in self.tables else None

    def direct(self, name: str, text: str, limit: int = 10, doc_ids: list[str] | None = None) -> DataFrame:
        """The units of a stored table that satisfy a query of operators.language in any field, with unit, score and rank, best
        first; doc_ids: of these documents only."""
        unit, fields = SEARCHED[name]
        own = self.tables[name].select(F.col(unit).alias("unit"), "doc_id")
        hits = S.direct_search(text, fields, self.index["postings"], self.index["terms"], self.index["fields"], limit, None, self.analyze, self.index["grams"], own, doc_ids)
        found = self.tables[name].withColumnRenamed(unit, "unit") if unit != "unit" else self.tables[name]
        return found.join(F.broadcast(hits), "unit").orderBy("rank")  # limit rows

    def search_chunks(self, text: str, limit: int = 10, doc_ids: list[str] | None = None) -> DataFrame:
        return self.direct("chunks", text, limit, doc_ids)

    def search_entities(self, text: str, limit: int = 10, doc_ids: list[str] | None = None) -> DataFrame:
        return self.direct("entities", text, limit, doc_ids)

    def search_relations(self, text: str, limit: int = 10, doc_ids: list[str] | None = None) -> DataFrame:
        return self.direct("relations", text, limit, doc_ids)

    @property
    def default_category(self) -> str:
        return next(c["id"] for c in self.categories if c["classification"]["method"] == "default")

    def classify(self, question: str) -> str:
        q = local_rows(self.spark, [(0, question)], "query_id long, text string")
        return Q.classified(q, D.keyword_table(self.spark, self.categories), self.default_category, self.analyze).first()["category_id"]

    def category(self, name: str) -> dict:
        found = next((c for c in self.categories if name in (c["name"], c["id"])), None)
        if found is None:
            raise ValueError(f"no category {name!r}; there are {[c['name'] for c in self.categories]}")
        return found

    def extract(self, question: str, category: str, key: str = "fields") -> str | None:
        """The model's answer for the schema's fields, or for its filters; None without a model."""
        schema = self.schema_of(category)
        return Q.extracted(self.extractor, schema | {"fields": schema[key]}, question) if self.extractor else None

    def schema_of(self, category: str) -> dict:
        """The category's field schema, or the default category's where it has none."""
        return self.schemas.get(self.category(category)["id"]) or self.schemas[self.default_category]

    def _rows(self, key: str) -> DataFrame:
        """(schema_id, field_name, target, match_method, weight) of all schemas' fields or filters."""
        return local_rows(self.spark, [(i, f["field_name"], f["target_index_field"], f["match_method"], float(f["weight"])) for i, schema in self.schemas.items() for f in schema.get(key) or []], _FIELD_ROWS)

    def _asked(self, question: str, category: str, key: str) -> tuple[str | None, str | None]:
        """(the model's answer, how it failed)."""
        try:
            return self.extract(question, category, key), None
        except Q.Failed as e:
            return None, str(e)

    def filter_documents(self, groups: DataFrame, alias_targets: bool = False, small: bool = False) -> DataFrame:
        """groups as of questions.filter_groups -> (query_id, doc_id): the best documents of each filter group, by metadata."""
        groups = groups.withColumn("query_id", F.struct("query_id", "filter_ix"))
        terms, words = self._terms(S.field_terms(groups, alias_targets, self.analyze).where("channel = 'meta'"), small)
        hits = S.bm25(terms, self.index["postings"], self.index["terms"], self.index["fields"], words=words)
        hits = hits.select("query_id.query_id", "query_id.filter_ix", "unit", "score")
        return S.meta_documents(hits).select("query_id", F.col("unit").alias("doc_id"))

    def _terms(self, terms: DataFrame, small: bool) -> tuple[DataFrame, list[str] | None]:
        """Exact terms as they are, fuzzy ones as the vocabulary's terms near them; with small, also all terms as a list."""
        asked = None
        if small:
            terms = brought_here(terms)
            asked = sorted({r["term"] for r in terms.where("kind = 'fuzzy'").select("term").collect()})
        exact, fuzzy = terms.where("kind = 'term'"), terms.where("kind = 'fuzzy'")
        if asked == []:
            found = exact
        else:
            found = exact.unionByName(S.fuzzy_terms(fuzzy, self.index["terms"], keys=self.index["keys"], words=asked).select(exact.columns))
        if not small:
            return found, None
        found = brought_here(found)
        words = {r["term"] for r in found.select("term").collect()}
        return found, sorted(words) if len(words) <= S.MOST_TERMS else None

    def answers(self, questions: DataFrame) -> DataFrame:
        """questions (query_id, text, schema_id) -> both answers of the model, which is asked on the executors, or how it failed;
        a table of nulls without a model."""
        if self.extractor:
            return Q.extracted_batch(questions, self.extractor, self.schemas)
        none = F.lit(None).cast("string")
        return questions.select("query_id", *[none.alias(c) for c in ("fields", "filters", "fields_error", "filters_error")])

    def retrieve_many(self, questions: DataFrame, options: RetrieveOptions | None = None, category_name: str | None = None, answers: DataFrame | None = None, small: bool = False) -> DataFrame:
        """questions (query_id, text, and perhaps doc_ids array and category_id) -> query_id, group_ix, chunk_id, score, rank,
        the chunk and its neighbours' ids, extracted_fields, category and warning, for all questions in one plan.

        Each question has its own category, by name, by column or by its words, and that category's schema; the model's answers
        are made on the executors, or given (as of answers()). Each group of an answer searches on its own. The documents of all
        filter groups restrict their question if there are any; doc_ids always do, also if they name no document. small: the
        questions are so few that their terms may go through the driver, which saves jobs."""
        o, spark = options or RetrieveOptions(), self.spark
        own_ids = F.col("doc_ids") if "doc_ids" in questions.columns else F.lit(None).cast("array<string>")
        q = questions.select("query_id", "text", F.when(F.size(own_ids) > 0, own_ids).alias("doc_ids"), *[c for c in questions.columns if c == "category_id"])
        if category_name:
            q = q.withColumn("category_id", F.lit(self.category(category_name)["id"]))
        elif "category_id" not in q.columns:
            found = Q.classified(q.select("query_id", "text"), D.keyword_table(spark, self.categories), self.default_category, self.analyze)
            q = q.join(found.select("query_id", "category_id"), "query_id")
        have = local_rows(spark, [(i,) for i in self.schemas], "category_id string")
        q = Q.with_schema(q, have, self.default_category)
        a = (answers if answers is not None else self.answers(q)).withColumnRenamed("fields", "raw")
        q = q.join(a, "query_id", "left")
        if small:
            q = brought_here(q)
        # a failed extraction falls back to free text under the default schema
        q = q.withColumn("schema_id", F.when(F.col("fields_error").isNotNull(), F.lit(self.default_category)).otherwise(F.col("schema_id")))
        none = F.array(F.lit(None).cast("map<string,string>"))
        g = q.withColumn("got", F.coalesce(Q.parsed_answers(F.col("raw")).getField("query"), none)).select("*", F.posexplode("got").alias("group_ix", "answer"))
        g = g.select(F.struct("query_id", "group_ix").alias("key"), "query_id", "group_ix", "schema_id", "text", Q.with_fallback(F.col("answer"), F.col("text")).alias("fields"))
        g = brought_here(g) if small else g
        of_key = g.select(F.col("key").alias("query_id"), "schema_id", "text", "fields")
        terms, words = self._terms(S.field_terms(Q.query_fields(of_key, self._rows("fields")), o.alias_targets, self.analyze).unionByName(S.free_text_terms(of_key, analyze=self.analyze)), small)

        allowed = F.col("doc_ids")
        if "metas" in self.tables and any(s.get("filters") for s in self.schemas.values()):
            groups = Q.filter_groups(q.select("query_id", "schema_id", F.col("filters").alias("raw")), self._rows("filters"))
            metas = self.filter_documents(groups, o.alias_targets, small).groupBy("query_id").agg(F.collect_set("doc_id").alias("by_meta"))  # two a filter group
            q = q.join(brought_here(metas) if small else metas, "query_id", "left")
            allowed = F.when(allowed.isNull(), F.col("by_meta")).when(F.col("by_meta").isNull(), allowed).otherwise(F.array_intersect(allowed, F.col("by_meta")))
        inside = g.select("query_id", "key").join(q.select("query_id", allowed.alias("allowed")).where("allowed is not null"), "query_id")
        docs, limited = inside.select(F.col("key").alias("query_id"), F.explode("allowed").alias("doc_id")).distinct(), inside.select(F.col("key").alias("query_id"))
        channels = ("entity", "relation", "title", "content")
        w = local_rows(spark, [(i, c, float(s["default_channel_weights"][f"{c}_channel"])) for i, s in self.schemas.items() for c in channels], "schema_id string, channel string, weight double")
        weights = of_key.select("query_id", "schema_id").join(F.broadcast(w), "schema_id").drop("schema_id")
        index = {n: df for n, df in self.index.items() if n != "lists"} if small else self.index  # bounds save rows, and cost stages
        hits = structured_search(terms, index, weights, o.top_k, docs, o.min_score, S.tokenless(of_key, self.analyze), limited, words)

        near, n = hits.withColumnRenamed("query_id", "key").join(self.tables["chunks"], "chunk_id"), o.adjacent_count if o.include_adjacent else 0
        for pointer, out in (("prev_chunk_id", "prev_ids"), ("next_chunk_id", "next_ids")):
            near = S.linked_neighbours(near, self.tables["chunks"], n, pointer, out)
        why = lambda c: F.coalesce(F.concat(F.lit(" ("), c, F.lit(")")), F.lit(""))
        warning = F.when(F.col("raw").isNull(), F.concat(F.lit("no extraction: searched by free text"), why(F.col("fields_error")))).when(F.col("filters_error").isNotNull(), F.concat(F.lit("no filter extraction: searched all documents"), why(F.col("filters_error"))))
        told = g.select("key", "query_id", F.to_json("fields").alias("extracted_fields")).join(q.select("query_id", F.col("category_id").alias("category"), warning.alias("warning")), "query_id").drop("query_id")
        out = near.join(told, "key")
        return out.select("key.query_id", F.col("key.group_ix").cast("long").alias("group_ix"), *[c for c in out.columns if c != "key"])

    def retrieve(self, question: str, options: RetrieveOptions | None = None, category_name: str | None = None) -> DataFrame:
        """retrieve_many() for one question, whose model is asked here, and whose groups are the query_id."""
        if not 1 <= len(question) <= 500:
            raise ValueError("a question has 1 to 500 characters")
        o = options or RetrieveOptions()
        cid = self.category(category_name)["id"] if category_name else self.classify(question)
        fields, failed = self._asked(question, cid, "fields")
        filters, unfiltered = self._asked(question, cid, "filters") if "metas" in self.tables and self.schema_of(cid).get("filters") else (None, None)
        told = local_rows(self.spark, [(0, fields, filters, failed, unfiltered)], "query_id long, fields string, filters string, fields_error string, filters_error string")
        q = local_rows(self.spark, [(0, question, o.doc_ids or None, cid)], "query_id long, text string, doc_ids array<string>, category_id string")
        return self.retrieve_many(q, o, None, told, small=True).withColumn("query_id", F.col("group_ix")).drop("group_ix")

    def respond(self, question: str, options: RetrieveOptions | None = None, category_name: str | None = None) -> dict:
        """retrieve() as one record: request_id, question, category, warning, and for each extracted group its fields, results
        (top_k at most), total and returned."""
        rows = self.retrieve(question, options, category_name).orderBy("query_id", "rank").collect()  # top_k rows a group
        groups: dict[int, list] = {}
        for r in rows:
            groups.setdefault(r["query_id"], []).append(r.asDict(recursive=True))
        out = [{"extracted_fields": json.loads(g[0]["extracted_fields"]), "results": g, "total": len(g), "returned": len(g)} for g in groups.values()]
        category = rows[0]["category"] if rows else (self.category(category_name)["id"] if category_name else self.classify(question))
        return {"request_id": str(uuid.uuid4()), "question": question, "category": category, "groups": out, "total": sum(g["total"] for g in out), "returned": sum(g["returned"] for g in out), "warning": rows[0]["warning"] if rows else "nothing found"}
