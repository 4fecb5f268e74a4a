"""A stored index of documents: immutable segments, and numbered manifests that say which segments make up the index.

A segment holds its documents' tables and postings. A change writes new segments first and a new manifest last, under the next
number, by one rename; who reads takes the highest number. So a build that fails leaves the old index whole, tables of unlike
builds never meet, and readers of an older manifest keep its files until vacuum(). There is one writer at a time: a second one
finds its number taken and fails.

Documents are replaced and deleted by rows that name them and their segment, which leave live reads by an anti join. Each such
change also stores what the documents had added to the statistics, so statistics are sums over segments less these, and equal
those of an index built anew. compact() writes the live rows as one segment."""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataseek.functions.analysis import tokens
from strataseek.operators import bounds, units, vocabulary
from strataseek.operators.search import FUZZY_LENGTH

#: The fields of each stored unit, as searches look through them, by table.
SEARCHED = {"chunks": ("chunk_id", ["content", "section_title", "section_path"]), "entities": ("entity_id", ["name", "desc", "entity_type"]), "relations": ("unit", ["subject", "predicate", "object"]), "metas": ("doc_id", ["insurer", "contract_name"])}
UNITS = "chunk_id string, doc_id string, section_title string, section_path string, content string, chunk_index int, prev_chunk_id string, next_chunk_id string"
#: Columns of a segment's tables.
TABLES = {
    "docs": "doc_id string, version_ts long, chunks long, entities long, relations long, metas long",
    "chunks": UNITS,
    "entities": "entity_id string, name string, desc string, entity_type string, chunk_id string, doc_id string",
    "relations": "relation_id string, subject string, predicate string, object string, chunk_id string, doc_id string, unit string",
    "metas": "doc_id string, contract_name string, insurer string",
    "postings": "field string, unit string, chunk_id string, doc_id string, term string, tf long, dl long, positions array<int>",
    "terms": "field string, term string, df long",
    "fields": "field string, units long, total long",
    "keys": "field string, key string, term string",
    "grams": "field string, gram string, term string",
    "lists": "field string, term string, range long, most_tf long, least_dl long, hits array<struct<unit:string,chunk_id:string,doc_id:string,tf:long,dl:long>>",
    "dead": "doc_id string, segment string",
}
_EMPTY = {"segments": [], "deletes": [], "streams": {}, "metas": False, "bounded": False}


class Store:
    """kind insurance also has metas. analyze: how fields are read, the same for all segments of a path. bounded: an index built
    anew also has packed lists (operators.bounds); one that is there keeps what it has."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "default", analyze=tokens, bounded: bool = False):
        self.spark, self.path, self.kind, self.analyze, self.bounded = spark, path.rstrip("/"), kind, analyze, bounded
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # Manifests

    def _manifests(self) -> list[str]:
        at = self._path(f"{self.path}/manifests")
        return sorted(n for f in self._fs.listStatus(at) if (n := f.getPath().getName()).endswith(".json")) if self._fs.exists(at) else []

    def manifest(self) -> dict | None:
        """The one with the highest number; None if there is no index."""
        names = self._manifests()
        if not names:
            return None
        stream = self._fs.open(self._path(f"{self.path}/manifests/{names[-1]}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, before: dict | None, **changes) -> None:
        told = (before or _EMPTY) | changes
        told["number"] = (before or {"number": 0})["number"] + 1
        to, aside = self._path(f"{self.path}/manifests/{told['number']:012d}.json"), self._path(f"{self.path}/manifests/{uuid.uuid4().hex}.part")
        out = self._fs.create(aside)
        out.write(bytearray(json.dumps(told).encode()))
        out.close()
        if self._fs.exists(to) or not self._fs.rename(aside, to):
            self._fs.delete(aside, False)
            raise RuntimeError(f"another writer has changed the index under {self.path}")

    # Writing

    def _put(self, df: DataFrame, where: str, *by: str) -> None:
        if by:
            df = df.repartitionByRange(*by).sortWithinPartitions(*by)
        df.write.parquet(f"{self.path}/{where}")

    def _put_all(self, *puts: tuple) -> None:
        """Several tables at once, as their jobs don't wait for each other."""
        with ThreadPoolExecutor(len(puts)) as pool:
            for done in [pool.submit(inheritable_thread_target(self.spark)(self._put), *p) for p in puts]:
                done.result()

    def _segment(self, tables: dict[str, DataFrame], bounded: bool, postings: DataFrame | None = None) -> str:
        """A new segment of unit tables and their postings, by default read from the tables as they were written. Postings are
        kept while they are sampled for ranges and written."""
        name = f"segments/{uuid.uuid4().hex}"
        self._put_all(*[(df, f"{name}/{kind}") for kind, df in tables.items()])
        if postings is None:
            read = {kind: self._read(kind, [name]) for kind in tables if kind in SEARCHED}
            postings = reduce(lambda a, b: a.unionByName(b), [units.indexed(df, *SEARCHED[kind], self.analyze) for kind, df in read.items()])
        postings = postings.persist()
        try:
            self._put(postings, f"{name}/postings", "field", "term", "unit")
        finally:
            postings.unpersist()
        post, docs = self._read("postings", [name]), self._read("docs", [name])
        self._put_all((post.groupBy("field", "term").agg(F.count("*").alias("df")), f"{name}/terms", "field", "term"), (self._field_sums(docs, post), f"{name}/fields"))
        terms = self._read("terms", [name])
        lists = [(bounds.packed(post, name), f"{name}/lists", "field", "term", "range")] if bounded else []
        self._put_all((vocabulary.deletions(terms, FUZZY_LENGTH + 1), f"{name}/keys", "key"), (vocabulary.grams(terms), f"{name}/grams", "gram"), *lists)
        return name

    def _field_sums(self, docs: DataFrame, post: DataFrame) -> DataFrame:
        """(field, units, total): the units that have the field, and the tokens in it."""
        kinds = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(kind, F.lit(0)).alias("n")) for kind, (_, fields) in SEARCHED.items() for f in fields])
        n = docs.select(F.inline(kinds)).groupBy("field").agg(F.sum("n").alias("units"))
        return n.join(post.groupBy("field").agg(F.sum("tf").alias("total")), "field", "left").select("field", "units", F.coalesce("total", F.lit(0)).alias("total"))

    def _tables(self, docs: DataFrame) -> dict[str, DataFrame]:
        size = lambda c: F.aggregate("chunks", F.lit(0).cast("long"), lambda n, x: n + F.coalesce(F.size(x[c]), F.lit(0)))
        metas = F.lit(1 if self.kind == "insurance" else 0).cast("long").alias("metas")
        out = {
            "docs": docs.select("doc_id", "version_ts", F.size("chunks").cast("long").alias("chunks"), size("entities").alias("entities"), (3 * size("relations")).alias("relations"), metas),
            "chunks": units.chunks(docs),
            "entities": units.entities(docs),
            "relations": units.relations(docs).withColumn("unit", F.concat("relation_id", F.lit("#"), F.monotonically_increasing_id())),
        }
        return out | ({"metas": units.metas(docs)} if self.kind == "insurance" else {})

    def rebuild(self, docs: DataFrame) -> None:
        """An index of these documents alone; streams keep their places."""
        before = self.manifest()
        self._commit(before, segments=[self._segment(self._tables(docs), self.bounded)], deletes=[], metas=self.kind == "insurance", bounded=self.bounded)

    def upsert(self, docs: DataFrame, stream: str | None = None, number: int = 0) -> None:
        """Adds documents. One that is there is replaced, unless it has a later version; of several with one id the latest
        version counts. A stream's batch that was taken before changes nothing."""
        before = self.manifest() or _EMPTY | {"number": 0, "bounded": self.bounded}
        if stream is not None and before["streams"].get(stream, -1) >= number:
            return
        w = Window.partitionBy("doc_id").orderBy(F.col("version_ts").desc_nulls_last(), F.xxhash64(F.to_json("chunks")))
        docs = docs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
        live = self._live("docs", before).select("doc_id", F.col("version_ts").alias("_version"), F.col("_segment").alias("segment")) if before["segments"] else None
        docs = docs.persist()
        try:
            if live is not None:
                old = live.join(docs.select("doc_id", "version_ts"), "doc_id")
                dead = old.where("_version is null or version_ts >= _version").select("doc_id", "segment")
                kept = old.where("not coalesce(_version is null or version_ts >= _version, false)").select("doc_id")
                removed = self._removed(dead, before)
                segment = self._segment(self._tables(docs.join(kept, "doc_id", "left_anti")), before.get("bounded", False))
                changes = {"deletes": [*before["deletes"], removed]}
            else:
                segment, changes = self._segment(self._tables(docs), before.get("bounded", False)), {}
        finally:
            docs.unpersist()
        streams = before["streams"] | ({stream: number} if stream is not None else {})
        self._commit(before, segments=[*before["segments"], segment], streams=streams, metas=before["metas"] or self.kind == "insurance", **changes)

    def delete(self, doc_ids: DataFrame) -> None:
        """Takes out the documents named in doc_ids (doc_id)."""
        before = self.manifest()
        if before and before["segments"]:
            live = self._live("docs", before).select("doc_id", F.col("_segment").alias("segment"))
            dead = live.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
            self._commit(before, deletes=[*before["deletes"], self._removed(dead, before)])

    def _removed(self, dead: DataFrame, before: dict) -> str:
        """Stores documents (doc_id, segment) as dead, and what they had added to the statistics, negated."""
        name = f"deletes/{uuid.uuid4().hex}"
        self._put(dead.select("doc_id", "segment"), f"{name}/dead")
        dead = self._read("dead", [name])
        gone = lambda table: self._live(table, before).join(dead.withColumnRenamed("segment", "_segment"), ["doc_id", "_segment"], "left_semi")
        post = gone("postings")
        self._put(post.groupBy("field", "term").agg((-F.count("*")).alias("df")), f"{name}/terms", "field", "term")
        sums = self._field_sums(gone("docs"), post)
        self._put(sums.select("field", (-F.col("units")).alias("units"), (-F.col("total")).alias("total")), f"{name}/fields")
        return name

    def compact(self) -> None:
        """The live rows as one segment, without reading any text anew."""
        before = self.manifest()
        if before and len(before["segments"]) + len(before["deletes"]) > 1:
            names = [n for n in ("docs", *SEARCHED) if n != "metas" or before["metas"]]
            tables = {n: self._live(n, before).drop("_segment") for n in names}
            segment = self._segment(tables, before.get("bounded", False), self._live("postings", before).drop("_segment"))
            self._commit(before, segments=[segment], deletes=[])

    def vacuum(self) -> None:
        """Removes what the newest manifest doesn't name: older segments, and what failed builds left."""
        told = self.manifest() or _EMPTY
        kept = {*told["segments"], *told["deletes"]}
        for top in ("segments", "deletes"):
            at = self._path(f"{self.path}/{top}")
            for f in self._fs.listStatus(at) if self._fs.exists(at) else []:
                if f"{top}/{f.getPath().getName()}" not in kept:
                    self._fs.delete(f.getPath(), True)
        for name in self._manifests()[:-1]:
            self._fs.delete(self._path(f"{self.path}/manifests/{name}"), False)

    # Reading

    def _read(self, table: str, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(*[f"{self.path}/{n}/{table}" for n in names])

    def _live(self, table: str, told: dict) -> DataFrame:
        """A table of all segments, without dead documents, with the _segment of each row."""
        if not told["segments"]:
            return self._read(table, []).withColumn("_segment", F.lit(""))
        df = self._read(table, told["segments"]).withColumn("_segment", F.regexp_extract(F.col("_metadata.file_path"), r"/(segments/[^/]+)/[^/]+/[^/]+$", 1))
        if told["deletes"]:
            df = df.join(self._read("dead", told["deletes"]).withColumnRenamed("segment", "_segment"), ["doc_id", "_segment"], "left_anti")
        return df

    def tables(self) -> dict[str, DataFrame]:
        told = self.manifest() or _EMPTY
        names = [n for n in SEARCHED if n != "metas" or told["metas"]]
        return {n: self._live(n, told).drop("_segment").select([x.split()[0] for x in TABLES[n].split(", ")]) for n in names}

    def index(self) -> dict[str, DataFrame]:
        """postings, terms (field, term, df, idf), fields (field, units, total, avgdl), the vocabulary's keys and grams. Of a bounded
        index also lists with their _segment, and the dead documents that these still hold, if there are any."""
        told = self.manifest() or _EMPTY
        parts = [*told["segments"], *told["deletes"]]
        terms, fields = self._read("terms", parts), self._read("fields", parts)
        if len(parts) > 1:
            terms = terms.groupBy("field", "term").agg(F.sum("df").alias("df")).where("df > 0")
            fields = fields.groupBy("field").agg(F.sum("units").alias("units"), F.sum("total").alias("total"))
        lists = {"lists": self._live("lists", told | {"deletes": []})} if told.get("bounded") else {}
        if lists and told["deletes"]:
            lists["dead"] = self._read("dead", told["deletes"]).withColumnRenamed("segment", "_segment")
        return lists | {
            "postings": self._live("postings", told).drop("_segment"),
            "terms": units.with_idf(terms, fields),
            "fields": fields.withColumn("avgdl", F.try_divide(F.col("total").cast("double"), "units")),
            "keys": self._read("keys", told["segments"]).distinct() if len(told["segments"]) > 1 else self._read("keys", told["segments"]),
            "grams": self._read("grams", told["segments"]).distinct() if len(told["segments"]) > 1 else self._read("grams", told["segments"]),
        }
