"""Index units: chunks, entities, relations and their three readings, metadata; postings, lengths, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataseek.functions.analysis import tokens


def _or_blank(c: str) -> F.Column:
    return F.coalesce(F.col(c), F.lit("")).alias(c.rpartition(".")[2])


def chunks(docs: DataFrame) -> DataFrame:
    c = docs.select(F.col("doc_id").alias("d"), F.explode("chunks").alias("c"))
    return c.select("c.chunk_id", F.col("d").alias("doc_id"), *[_or_blank(f"c.{x}") for x in ("section_title", "section_path", "content")], F.coalesce("c.chunk_index", F.lit(0)).alias("chunk_index"), _or_blank("c.prev_chunk_id"), _or_blank("c.next_chunk_id"))


def entities(docs: DataFrame) -> DataFrame:
    e = docs.select("doc_id", F.explode("chunks").alias("c")).select("doc_id", F.col("c.chunk_id").alias("chunk_id"), F.posexplode("c.entities").alias("i", "e"))
    return e.select(F.concat("chunk_id", F.lit("_entity_"), "i").alias("entity_id"), "e.name", _or_blank("e.desc"), _or_blank("e.entity_type"), "chunk_id", "doc_id")


def relations(docs: DataFrame) -> DataFrame:
    r = docs.select("doc_id", F.explode("chunks").alias("c")).select("doc_id", F.col("c.chunk_id").alias("chunk_id"), F.posexplode("c.relations").alias("i", "r"))
    return augmented(r.select(F.concat("chunk_id", F.lit("_relation_"), "i").alias("relation_id"), _or_blank("r.subject"), "r.predicate", "r.object", "chunk_id", "doc_id"))


def augmented(relations: DataFrame) -> DataFrame:
    """Three rows for each relation, under its id: as it is; reversed; and with object and predicate as subject, the
    predicate and the subject after it, or, where that is empty, the predicate after a space."""
    s, p, o = F.col("subject"), F.col("predicate"), F.col("object")
    row = lambda a, b, c: F.struct(a.alias("subject"), b.alias("predicate"), c.alias("object"))
    third = row(F.concat(o, F.lit(" "), p), p, F.when(s == "", F.concat(F.lit(" "), p)).otherwise(s))
    other = [c for c in relations.columns if c not in ("subject", "predicate", "object")]
    return relations.select(*other, F.explode(F.array(row(s, p, o), row(o, p, s), third)).alias("t")).select(*other, "t.*")


def metas(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", _or_blank("meta.contract_name"), _or_blank("meta.insurer"))


def postings(units: DataFrame, unit: str, fields: list[str], analyze=tokens, own: tuple[str, ...] = ()) -> DataFrame:
    """(field, unit, term, tf, dl): one pass over the units. Where they are partitioned by unit, no posting is shuffled. own: further
    columns, which a unit determines; those by which the units are partitioned do as well as the unit."""
    each = [F.struct(F.lit(f).alias("field"), analyze(F.col(f)).alias("words")) for f in fields]
    t = units.select(F.col(unit).alias("unit"), *own, F.inline(F.array(*each)))
    return t.select("field", "unit", *own, F.explode("words").alias("term"), F.size("words").cast("long").alias("dl")).groupBy("field", "unit", *own, "term", "dl").agg(F.count("*").alias("tf"))


def places(units: DataFrame, unit: str, fields: list[str], analyze=tokens) -> DataFrame:
    """(field, unit, term, positions): where in a field each term stands, counted in tokens, for phrases."""
    each = [F.struct(F.lit(f).alias("field"), analyze(F.col(f)).alias("words")) for f in fields]
    t = units.select(F.col(unit).alias("unit"), F.inline(F.array(*each)))
    return t.select("field", "unit", F.posexplode("words").alias("p", "term")).groupBy("field", "unit", "term").agg(F.array_sort(F.collect_list("p")).alias("positions"))


def indexed(units: DataFrame, unit: str, fields: list[str], analyze=tokens) -> DataFrame:
    """(field, unit, chunk_id, doc_id, term, tf, dl, positions): postings that say where they are. Units have a doc_id, and a
    chunk_id unless they are documents."""
    each = [F.struct(F.lit(f).alias("field"), analyze(F.col(f)).alias("words")) for f in fields]
    chunk = F.col("chunk_id") if "chunk_id" in units.columns else F.lit(None).cast("string")
    t = units.select(F.col(unit).alias("unit"), chunk.alias("chunk_id"), "doc_id", F.inline(F.array(*each)))
    own = ["field", "unit", "chunk_id", "doc_id"]
    t = t.select(*own, F.size("words").cast("long").alias("dl"), F.posexplode("words").alias("p", "term"))
    p = t.groupBy(*own, "term", "dl").agg(F.array_sort(F.collect_list("p")).alias("positions"))
    return p.select(*own, "term", F.size("positions").cast("long").alias("tf"), "dl", "positions")


def with_idf(terms: DataFrame, fields: DataFrame) -> DataFrame:
    """terms (field, term, df) and fields (field, units, total) -> (field, term, df, idf)."""
    n, df = F.col("units"), F.col("df")
    return terms.join(F.broadcast(fields.select("field", "units")), "field").select("field", "term", "df", F.log(1 + (n - df + 0.5) / (df + 0.5)).alias("idf"))  # a row for each field


def statistics(post: DataFrame, units: int | F.Column) -> tuple[DataFrame, DataFrame]:
    """(by term: field, term, df, idf), (by field: field, avgdl)."""
    n = units if isinstance(units, F.Column) else F.lit(units)
    terms = post.groupBy("field", "term").agg(F.count("*").alias("df")).withColumn("idf", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    return terms, post.groupBy("field").agg((F.sum("tf") / n).alias("avgdl"))
