"""Sources and sinks: nested JSON documents, questions, configuration, name maps, stored indexes, result lines."""

from __future__ import annotations

import atexit
import hashlib
import json
import re
import tempfile
import uuid
from functools import reduce
from importlib import resources
from pathlib import Path

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataseek.functions.analysis import ANALYZERS, MOST_WORDS, DictionaryTokens, tokens
from strataseek.functions.local import local_rows
from strataseek.operators import bounds, units

_s = T.StringType()


def _struct(*names: str, **kinds) -> T.StructType:
    return T.StructType([T.StructField(n, _s) for n in names] + [T.StructField(n, k) for n, k in kinds.items()])


ENTITY = _struct("name", "desc", "entity_type")
RELATION = _struct("subject", "predicate", "object")
CHUNK = _struct("chunk_id", "doc_id", "section_title", "section_path", "content", chunk_index=T.IntegerType(), prev_chunk_id=_s, next_chunk_id=_s, entities=T.ArrayType(ENTITY), relations=T.ArrayType(RELATION), doc_tree=_s)  # the tree as its JSON text, of any depth
DOCUMENT = _struct("doc_id", "doc_type", version_ts=T.LongType(), structured_data=T.MapType(_s, _s), chunks=T.ArrayType(CHUNK), _corrupt_record=_s)
QUESTION = _struct("qid", "domain", "split", "question", options=T.MapType(_s, _s), answer_format=_s, type=_s, doc_ids=T.ArrayType(_s))


def accepted(df: DataFrame) -> DataFrame:
    """Of documents as read from files: no `latest` copies, nothing in `versions` folders, none that don't parse, have no
    chunks or whose first chunk has no tree."""
    file = F.col("_metadata.file_path")
    df = df.where(~file.rlike(r"/latest\.json$") & ~file.rlike(r"/versions/[^/]+$"))
    return df.where("_corrupt_record is null and doc_id is not null and size(chunks) > 0 and chunks[0].doc_tree is not null")


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every document below path but `latest` copies and `versions` folders. Files that don't parse, documents without
    chunks and ones whose first chunk has no tree are left out; a missing path gives an empty table."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], T.StructType([f for f in DOCUMENT if f.name != "_corrupt_record"]).add("doc_tree", T.ArrayType(_s)))
    df = spark.read.schema(DOCUMENT).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    return accepted(df).withColumn("doc_tree", F.array(F.expr("try_element_at(chunks, 1).doc_tree"))).drop("_corrupt_record")


SECTION = "path array<string>, level int, title string, chunk_id_start string, chunk_id_end string"


def _walked(text: str | None) -> list[dict] | None:
    """The sections of a tree's JSON, parents before children; an explicit stack, so depth doesn't matter."""
    try:
        top = json.loads(text) if text else None
    except (ValueError, RecursionError):
        return None
    out, stack = [], [(top, [])]
    while stack:
        node, above = stack.pop()
        if isinstance(node, list):
            stack += [(x, above) for x in reversed(node)]
        elif isinstance(node, dict):
            title = node.get("title")
            path = [*above, "" if title is None else str(title)]
            told = {k: None if node.get(k) is None else str(node[k]) for k in ("title", "chunk_id_start", "chunk_id_end")}
            out.append({"path": path, "level": len(path), **told})
            stack += [(x, path) for x in reversed(node.get("children") or [])]
    return out


def _walked_all(texts: pd.Series) -> pd.Series:
    return texts.map(_walked)


def sections(docs: DataFrame) -> DataFrame:
    """docs (doc_id, doc_tree array of JSON texts) -> (doc_id, path, level, title, chunk_id_start, chunk_id_end): each section
    of each tree with the titles from the root to it, whatever its depth. A text that isn't JSON has no sections."""
    walk = F.pandas_udf(_walked_all, f"array<struct<{SECTION.replace(' ', ':').replace(',:', ',')}>>")
    trees = docs.select("doc_id", F.explode("doc_tree").alias("tree"))
    return trees.select("doc_id", walk("tree").alias("s")).select("doc_id", F.inline("s"))


def insurance_documents(spark: SparkSession, path: str) -> DataFrame:
    """As json_documents, with_meta."""
    return with_meta(json_documents(spark, path))


def with_meta(docs: DataFrame) -> DataFrame:
    """docs with meta; a document whose structured data lacks either key is left out, a null value is not."""
    keys = F.map_keys("structured_data")
    docs = docs.where(F.array_contains(keys, "contract_name") & F.array_contains(keys, "insurer"))
    return docs.withColumn("meta", F.struct(F.col("structured_data")["contract_name"].alias("contract_name"), F.col("structured_data")["insurer"].alias("insurer")))


def questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUESTION).option("multiLine", True).json(path)


def name_map(spark: SparkSession, path: str) -> DataFrame:
    """(name, doc_id): the stem of each status file's file_path; of equal names the id of the last status file by path."""
    df = spark.read.schema("file_path string, doc_id string").option("multiLine", True).json(path)
    return last_ids(df.select(stem(F.col("file_path")).alias("name"), "doc_id", F.col("_metadata.file_path").alias("file")), "file")


def last_ids(rows: DataFrame, order: str) -> DataFrame:
    """rows (name, doc_id, order) -> (name, doc_id): of each name the id that comes last."""
    return rows.groupBy("name").agg(F.max_by("doc_id", order).alias("doc_id"))


def stem(path: F.Column) -> F.Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def _config(folder: str | None):
    return Path(folder) if folder else resources.files("strataseek").joinpath("config")


def categories(text: str | None = None, folder: str | None = None) -> list[dict]:
    """Category configuration in file order, from `folder` or the package; entries without id, name, schema file or a known
    method are skipped."""
    text = text or _config(folder).joinpath("categories.yaml").read_text(encoding="utf-8")
    found = (yaml.safe_load(text) or {}).get("categories") or []
    return [c for c in found if isinstance(c, dict) and {"id", "name", "schema_file"} <= c.keys() and (c.get("classification") or {}).get("method") in ("keyword", "llm", "default")]


def schemas(found: list[dict] | None = None, folder: str | None = None) -> dict[str, dict]:
    """Field schemas by category id, from the folder's or the package's `schemas`; missing or invalid files are skipped."""
    out = {}
    for c in found or categories(folder=folder):
        try:
            out[c["id"]] = json.loads(_config(folder).joinpath("schemas", Path(c["schema_file"]).name).read_text(encoding="utf-8"))
        except (OSError, ValueError):
            continue
    return out


def keyword_table(spark: SparkSession, found: list[dict] | None = None) -> DataFrame:
    """A row for each keyword: category_id, priority, group_ix, group_size, weight, word, threshold."""
    rows = [(c["id"], i, g, len(k["words"]), float(k.get("weight", 1.0)), str(w), float(c["classification"].get("threshold") or 0.0)) for i, c in enumerate(found or categories()) if c["classification"]["method"] == "keyword" for g, k in enumerate(c["classification"].get("keywords") or []) for w in k["words"]]
    return local_rows(spark, rows, "category_id string, priority int, group_ix int, group_size int, weight double, word string, threshold double")


def dictionary(spark: SparkSession, path: str, user_words: dict[str, int] | None = None) -> dict[str, int]:
    """word -> frequency, from text files of lines "word frequency ..." (a word alone has frequency 1); of equal words the
    highest. User words replace what the files say."""
    part = F.split("value", r"\s+")
    rows = spark.read.text(path).where("trim(value) <> ''").select(F.get(part, 0).alias("w"), F.coalesce(F.try_to_number(F.get(part, 1), F.lit("999999999999")).cast("long"), F.lit(1)).alias("f"))
    found = rows.groupBy("w").agg(F.max("f").alias("f")).limit(MOST_WORDS + 1).collect()  # configuration; more words are refused
    return {r["w"]: r["f"] for r in found} | (user_words or {})


def index_folder(spark: SparkSession, path: str, analyzer: str, words: dict[str, int] | str | None = None):
    """(folder, analyzer function): an index's own folder below path. Each dictionary has its own, named by its contents."""
    if analyzer != "dictionary":
        return f"{path}/{analyzer}", ANALYZERS[analyzer]
    if words is None:
        raise ValueError("the dictionary analyzer needs a dictionary")
    words = dictionary(spark, words) if isinstance(words, str) else words
    told = hashlib.sha256(json.dumps(sorted(words.items()), ensure_ascii=False).encode()).hexdigest()[:16]
    return f"{path}/dictionary-{told}", DictionaryTokens(words)


def _stored(spark: SparkSession, path: str) -> bool:
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def stored_index(spark: SparkSession, path: str, tables: dict[str, DataFrame], rebuild: bool = False) -> dict[str, DataFrame]:
    """The tables under path; each is built where it isn't there whole yet, or again with rebuild."""
    for name, df in tables.items():
        if rebuild or not _stored(spark, f"{path}/{name}"):
            df.write.mode("overwrite").parquet(f"{path}/{name}")
            spark.catalog.refreshByPath(f"{path}/{name}")
    return {name: spark.read.schema(df.schema).parquet(f"{path}/{name}") for name, df in tables.items()}


#: Bytes of a table's texts whose postings make a file, about.
PART_BYTES = 4 << 20


def _parts(df: DataFrame) -> int:
    """Into how many parts a table is dealt, by the bytes of its values, as files hold repeated texts in little room; small tables
    by the cores there are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    long = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)).cast("long") for c in df.columns]
    size = df.agg(F.sum(reduce(Column.__add__, long))).first()[0] or 0
    return max(-(-size // PART_BYTES), min(cores, -(-size // (1 << 20))), 1)


def stored_postings(spark: SparkSession, path: str, name: str, table: DataFrame, unit: str, fields: list[str], analyze=tokens, rebuild: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings, terms with df and idf, fields with avgdl) of a table's units, stored under path.

    The units are dealt by a hash to parts of about PART_BYTES of text, and each part's postings are counted and
    sorted by term and field where it is read: what moves is the text, once, and not its postings. A filter on terms skips the
    other pages of each file; a term that most units hold spreads over all files."""
    parts = _parts(table.select(*fields)) if rebuild or not _stored(spark, f"{path}/{name}_postings") else 1
    dealt = table.select(unit, *fields).repartition(parts, unit)
    raw = units.postings(dealt, unit, fields, analyze).sortWithinPartitions("term", "field", "unit")
    post = stored_index(spark, path, {f"{name}_postings": raw}, rebuild)[f"{name}_postings"]
    terms, by_field = units.statistics(post, table.count() if rebuild or not _stored(spark, f"{path}/{name}_fields") else 0)
    stats = stored_index(spark, path, {f"{name}_terms": terms.sortWithinPartitions("field", "term"), f"{name}_fields": by_field}, rebuild)
    return post, stats[f"{name}_terms"], stats[f"{name}_fields"]


def stored_lists(spark: SparkSession, path: str, name: str, table: DataFrame, unit: str, fields: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(packed lists (operators.bounds), terms with df and idf, fields with avgdl) of a table's units, stored under path in parts as
    stored_postings() makes them. Statistics are those of its postings, which are not needed here, so either finds the other's."""
    parts = 1 if _stored(spark, f"{path}/{name}_lists") else _parts(table.select(*fields))
    lists = stored_index(spark, path, {f"{name}_lists": bounds.packed_units(table, unit, fields, parts)})[f"{name}_lists"]
    terms, by_field = bounds.statistics(lists, 0 if _stored(spark, f"{path}/{name}_fields") else table.count())
    stats = stored_index(spark, path, {f"{name}_terms": terms.sortWithinPartitions("field", "term"), f"{name}_fields": by_field})
    return lists, stats[f"{name}_terms"], stats[f"{name}_fields"]


_scratch: dict[tuple[str, str, str], str] = {}


def scratch(spark: SparkSession, key: str, source: DataFrame | None = None) -> str:
    """A folder of this session for key, and for the files of source as they are now, below spark.checkpoint.dir, or where Spark
    runs in this process and that is unset, a temporary one. It is removed at exit."""
    at = (spark.sparkContext.applicationId, key, _state_of(source) if source is not None else "")
    if at not in _scratch:
        root = spark.conf.get("spark.checkpoint.dir", "") or ""
        if not root:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = "file://" + tempfile.gettempdir()
        _scratch[at] = f"{root.rstrip('/')}/strataseek-index-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _scratch[at])
    return _scratch[at]


def _state_of(df: DataFrame) -> str:
    """Names the files that df reads and their states, so that a table written anew has another name."""
    spark, seen = df.sparkSession, []
    for f in sorted(df.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        seen.append((f, status.getLen(), status.getModificationTime()))
    return hashlib.sha256(repr(seen).encode()).hexdigest()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    except Exception:  # the session has ended: whoever owns the folder clears it
        pass


def append_lines(results: DataFrame, path: str) -> None:
    results.write.mode("append").json(path)


def write_text(df: DataFrame, path: str) -> None:
    """A one-column table as text."""
    df.write.mode("overwrite").text(path)
