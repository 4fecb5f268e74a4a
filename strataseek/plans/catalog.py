"""The registered queries of the retrieval engine and their SQL, over the driver's tables.

documents, conversations, part, customer and supplier stand for documents, chunks, entities, relations and metadata;
benchmark holds the questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataseek.functions import analysis
from strataseek.functions.local import local_rows
from strataseek.operators import bounds, vocabulary
from strataseek.operators import questions as Q
from strataseek.operators import search as S
from strataseek.operators import units
from strataseek.plans.engine import structured_search as _search
from strataseek.sources import documents as D

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Tables in the shape of the data model.


def _chunks(spark, sf_dir):
    """Lines of documents: id, place, first line as title."""
    d = table(spark, sf_dir, "documents").withColumn("lines", F.split("text", "\n", -1))
    d = d.select("doc_id", F.get("lines", 0).alias("section_title"), F.posexplode("lines").alias("chunk_index", "content"))
    return d.select(F.concat("doc_id", F.lit("_chunk_"), "chunk_index").alias("chunk_id"), "doc_id", "section_title", "content", "chunk_index")


def _turns(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    return t.select(F.concat("conv_id", F.lit("_chunk_"), "turn").alias("chunk_id"), F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), F.coalesce(F.get(F.split("text", "\n"), 0), F.lit("")).alias("section_title"), F.coalesce("text", F.lit("")).alias("content"))


def _entities(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("unit"), F.col("p_name").alias("name"), F.col("p_brand").alias("desc"), F.col("p_type").alias("entity_type"), F.col("p_partkey").alias("chunk_id"))


def _relations(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.concat(F.col("c_custkey"), F.lit("_relation_0")).alias("relation_id"), F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.col("c_name")).alias("subject"), F.col("c_mktsegment").alias("predicate"), F.col("n_name").alias("object"))


def _metas(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(F.col("s_suppkey").alias("unit"), F.col("s_name").alias("contract_name"), F.col("n_name").alias("insurer"))


def _questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _index(units_df, unit, fields, sf_dir, name):
    """(postings, terms, fields) of a table, stored once for the session and read again by every later query."""
    return D.stored_postings(units_df.sparkSession, D.scratch(units_df.sparkSession, f"{sf_dir}/{name}", units_df), name, units_df, unit, fields)


def _documents(spark, sf_dir):
    return _index(table(spark, sf_dir, "documents"), "doc_id", ["text"], sf_dir, "documents")


def _lists(spark, sf_dir):
    """The documents' packed lists and statistics, stored once for the session, each file in order of field, term and range: made of the
    texts, as postings would be shuffled twice, and a table as large as the lists."""
    docs = table(spark, sf_dir, "documents")
    return D.stored_lists(spark, D.scratch(spark, f"{sf_dir}/documents", docs), "documents", docs, "doc_id", ["text"])


_TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
_CHUNKS = r"""chunks as (
  select doc_id || '_chunk_' || (i - 1) as chunk_id, doc_id, l[1] as section_title, l[i] as content, (i - 1)::int as chunk_index
  from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from (select doc_id, string_split(text, chr(10)) as l from documents)))"""
_TURNS = "turns as (select conv_id || '_chunk_' || turn as chunk_id, conv_id as doc_id, turn as chunk_index, coalesce(string_split(text, chr(10))[1], '') as section_title, coalesce(text, '') as content from conversations)"
_RELATIONS = "rel as (select c_custkey || '_relation_0' as relation_id, case when c_custkey % 7 = 0 then '' else c_name end as subject, c_mktsegment as predicate, n_name as object from customer join nation on c_nationkey = n_nationkey)"
_METAS = "metas as (select s_suppkey as unit, s_name as contract_name, n_name as insurer from supplier join nation on s_nationkey = n_nationkey)"


def _post_sql(source: str, unit: str, fields: list[str]) -> str:
    each = " union all ".join(f"select '{f}' as field, {unit} as unit, {_TOK.format(f)} as words from {source}" for f in fields)
    return f"""words as ({each}),
post as (select field, unit, term, count(*) as tf, dl from (select field, unit, len(words) as dl, unnest(words) as term from words) group by field, unit, term, dl),
n as (select count(*) as n from {source}),
by_term as (select field, term, count(*) as df, ln(1 + ((select n from n) - count(*) + 0.5) / (count(*) + 0.5)) as idf from post group by field, term),
by_field as (select field, sum(tf) / (select n from n) as avgdl from post group by field)"""


_BM25 = "idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))"


# Units


@query(f"with {_CHUNKS} select chunk_id, doc_id, section_title, content, chunk_index from chunks")
def chunk_flatten(spark, sf_dir):
    """Documents as nested records with their chunks inside, flattened."""
    blank = F.lit(None).cast("string")
    chunk = F.struct("chunk_id", "section_title", blank.alias("section_path"), "content", "chunk_index", blank.alias("prev_chunk_id"), blank.alias("next_chunk_id"))
    docs = _chunks(spark, sf_dir).groupBy("doc_id").agg(F.collect_list(chunk).alias("chunks"))
    return units.chunks(docs).select("chunk_id", "doc_id", "section_title", "content", "chunk_index")


@query("select conv_id || '_chunk_' || turn as chunk_id, coalesce(lag(conv_id || '_chunk_' || turn) over w, '') as prev_chunk_id, coalesce(lead(conv_id || '_chunk_' || turn) over w, '') as next_chunk_id from conversations window w as (partition by conv_id order by turn)")
def chunk_links(spark, sf_dir):
    t = S.neighbours(_turns(spark, sf_dir), 1)
    one = lambda c: F.coalesce(F.get(c, 0), F.lit(""))
    return t.select("chunk_id", one("prev_ids").alias("prev_chunk_id"), one("next_ids").alias("next_chunk_id"))


@query("select p_partkey || '_entity_' || 0 as entity_id, p_name as name, coalesce(p_brand, '') as desc_, coalesce(p_type, '') as entity_type, p_partkey as chunk_id from part")
def entity_flatten(spark, sf_dir):
    e = _entities(spark, sf_dir).groupBy("chunk_id").agg(F.collect_list(F.struct("name", "desc", "entity_type")).alias("entities"))
    docs = e.select(F.lit("d").alias("doc_id"), F.array(F.struct("chunk_id", "entities")).alias("chunks"))
    return units.entities(docs).select("entity_id", "name", F.col("desc").alias("desc_"), "entity_type", "chunk_id")


@query(f"with {_RELATIONS} select relation_id, subject, predicate, object from rel union all select relation_id, object, predicate, subject from rel union all select relation_id, object || ' ' || predicate, predicate, case when subject = '' then ' ' || predicate else subject end from rel")
def relation_augment(spark, sf_dir):
    return units.augmented(_relations(spark, sf_dir))


@query(f"with {_METAS} select unit as doc_id, coalesce(contract_name, '') as contract_name, coalesce(insurer, '') as insurer from metas")
def meta_project(spark, sf_dir):
    return units.metas(_metas(spark, sf_dir).select(F.col("unit").alias("doc_id"), F.struct("contract_name", "insurer").alias("meta")))


# Analysis and statistics


@query(f"select doc_id, term, count(*) as tf from (select doc_id, unnest({_TOK.format('text')}) as term from documents) group by doc_id, term")
def tokenize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(analysis.tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


@query(f"select doc_id, count(*) as n_tokens from (select doc_id, unnest({_TOK.format('text')}) as term from documents) where length(term) >= 2 and term not in ({', '.join(repr(w) for w in analysis.STOP_WORDS)}) group by doc_id")
def stop_filtered_tokens(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.size(analysis.without_stop_words(analysis.tokens(F.col("text")))).cast("long").alias("n_tokens"))
    return d.where("n_tokens > 0")


@query(f"with {_post_sql('documents', 'doc_id', ['text'])} select (select n from n) as n_units, count(distinct unit) as n_nonempty, count(*) as n_postings, count(distinct term) as n_terms, sum(tf)::bigint as n_tokens from post")
def corpus_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    p = _documents(spark, sf_dir)[0].agg(F.countDistinct("unit").alias("n_nonempty"), F.count("*").alias("n_postings"), F.countDistinct("term").alias("n_terms"), F.sum("tf").alias("n_tokens"))
    return d.agg(F.count("*").alias("n_units")).crossJoin(p)


@query(f"with {_post_sql('documents', 'doc_id', ['text'])} select term, df, round(idf, 6) as idf from by_term")
def term_stats(spark, sf_dir):
    _, t, _ = _documents(spark, sf_dir)
    return t.select("term", "df", F.round("idf", 6).alias("idf"))


# Searches

_ASK = ["the", "of", "and", "thing"]
_DOCS = f"with {_post_sql('documents', 'doc_id', ['text'])}, q as (select unnest({_ASK!r}) as term), hits as (select unit, round(sum({_BM25}), 6) as score from q join post using (term) join by_term using (field, term) join by_field using (field) group by unit)"


def _ask(spark, channel="content", field="text", words=None):
    return spark.createDataFrame([(0, channel, field, w, "term", 1.0) for w in words or _ASK], "query_id long, channel string, field string, term string, kind string, boost double")


@query(f"with {_post_sql('documents', 'doc_id', ['text'])} select unit as doc_id, round({_BM25}, 6) as score from post join by_term using (field, term) join by_field using (field) where term = 'the'")
def term_search(spark, sf_dir):
    h = S.bm25(_ask(spark, words=["the"]), *_documents(spark, sf_dir))
    return h.select(F.col("unit").alias("doc_id"), F.round("score", 6).alias("score"))


@query(_DOCS + " select unit as doc_id, score from hits")
def multi_term_or(spark, sf_dir):
    h = S.bm25(_ask(spark), *_documents(spark, sf_dir))
    return h.select(F.col("unit").alias("doc_id"), F.round("score", 6).alias("score"))


@query(_DOCS + " select unit as doc_id, score, row_number() over (order by score desc, unit)::int as rank from hits qualify rank <= 10")
def bm25_topk(spark, sf_dir):
    h = S.bm25(_ask(spark), *_documents(spark, sf_dir))
    return S.ranked(h, ["query_id"], 10).select(F.col("unit").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query(f"with {_post_sql('documents', 'doc_id', ['text'])}, q as (select item_id as query_id, unnest({_TOK.format('text')}) as term from benchmark), hits as (select query_id, unit, round(sum({_BM25}), 6) as score from q join post using (term) join by_term using (field, term) join by_field using (field) group by query_id, unit) select query_id, unit as doc_id, score, row_number() over (partition by query_id order by score desc, unit)::int as rank from hits qualify rank <= 10")
def bounded_topk(spark, sf_dir):
    """All questions' 10 best documents, by ranges that can reach them."""
    q = _questions(spark, sf_dir)
    ask = S.free_text_terms(q, 1.0).withColumn("field", F.lit("text"))
    h = bounds.reaching(ask, *_lists(spark, sf_dir), 10)
    return S.ranked(h, ["query_id"], 10).select("query_id", F.col("unit").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query(_DOCS + " select unit as doc_id, score, row_number() over (order by score desc, unit)::int as rank from hits where unit in (select doc_id from documents where lang = 'de') qualify rank <= 10")
def bm25_doc_filtered(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    inside = d.where("lang = 'de'").select(F.lit(0).cast("long").alias("query_id"), F.col("doc_id").alias("unit"))
    h = S.bm25(_ask(spark), *_documents(spark, sf_dir), docs=inside)
    return S.ranked(h, ["query_id"], 10).select(F.col("unit").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query(r"""with w as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as t from documents)
select doc_id as unit, 2 + (list_contains(t, 'of'))::int as n_hits from w where list_contains(t, 'the') and len(list_filter(t, lambda x: x[1:3] = 'thi')) > 0 and not list_contains(t, 'der')""")
def parser_and(spark, sf_dir):
    p = _documents(spark, sf_dir)[0]
    h = S.parsed_search(p, "the thi* NOT der")
    of = p.where("term = 'of'").select("unit", F.lit(1).alias("of"))
    return h.join(of, "unit", "left").select("unit", (F.col("n_hits") + F.coalesce("of", F.lit(0))).cast("int").alias("n_hits"))


_NAMES = ["gree", "blu", "lac", "red", "rose", "ivor"]
_FUZZY = f"""with vocab as (select distinct unnest({_TOK.format('p_name')}) as term from part), q as (select unnest({_NAMES!r}) as asked),
near as (select asked, term from q join vocab on term[1] = asked[1] and abs(length(term) - length(asked)) <= 1 and levenshtein(asked, term) <= 1 where regexp_matches(term, '^[a-z0-9]+$'))"""


def _near(spark, sf_dir):
    p, t, _ = _index(_entities(spark, sf_dir), "unit", ["name"], sf_dir, "names")
    v = t.where(F.col("term").rlike("^[a-z0-9]+$"))
    return p, S.fuzzy_terms(_ask(spark, "entity", "name", _NAMES).withColumn("kind", F.lit("fuzzy")), v)


@query(_FUZZY + " select asked, term from near")
def fuzzy_vocab(spark, sf_dir):
    return _near(spark, sf_dir)[1].select("asked", "term")


@query(_FUZZY + f", post as (select distinct p_partkey::varchar as unit, unnest({_TOK.format('p_name')}) as term from part) select unit, count(*)::double as score from near join post using (term) group by unit")
def fuzzy_search(spark, sf_dir):
    p, near = _near(spark, sf_dir)
    _, t, f = _index(_entities(spark, sf_dir), "unit", ["name"], sf_dir, "names")
    return S.bm25(near.select("query_id", "channel", "field", "term", "kind", "boost"), p, t, f).select("unit", "score")


_FIELDS = [("topic", "Long insured Title", "section_title", "exact_then_fuzzy", 1.0), ("body", "some TEXT", "content", "substring", 0.5), ("who", "Ann B", "name", "fuzzy", 0.8), ("none", None, "content", "fuzzy", 1.0), ("lost", "words", "entity_names", "fuzzy", 1.0)]


@query("""select * from (values ('title','section_title','long','term',1.0::double),('title','section_title','long','fuzzy',0.6),('title','section_title','insured','term',1.0),('title','section_title','title','term',1.0),
('content','content','some','term',0.5),('content','content','text','term',0.5),('entity','name','ann','term',0.8),('entity','name','ann','fuzzy',0.4),('entity','name','b','term',0.8),('entity','name','b','fuzzy',0.4)) t(channel, field, term, kind, boost)""")
def match_dispatch(spark, sf_dir):
    f = spark.createDataFrame([(0, *r[1:]) for r in _FIELDS], "query_id long, value string, target string, match_method string, weight double")
    return S.field_terms(f).select("channel", "field", "term", "kind", F.round("boost", 6).alias("boost"))


_FREE = f"with {_TURNS}, {_post_sql('turns', 'chunk_id', ['content', 'section_title'])}, q as (select item_id as query_id, unnest({_TOK.format('text')}) as term from benchmark)"
_CHANNELS = f"""{_FREE}, hits as (select query_id, case field when 'content' then 'content' else 'title' end as channel, unit, round(sum(case field when 'content' then 0.3 else 1.0 end * {_BM25}), 6) as score
from q join post using (term) join by_term using (field, term) join by_field using (field) group by query_id, channel, unit),
cut as (select *, row_number() over (partition by query_id, channel order by score desc, unit)::int as rank from hits qualify rank <= 20)"""


def _turn_index(spark, sf_dir):
    t = _turns(spark, sf_dir)
    p, a, b = _index(t, "chunk_id", ["content", "section_title"], sf_dir, "turns")
    return {"postings": p, "terms": a, "fields": b, "owner": t.select(F.col("chunk_id").alias("unit"), "chunk_id", "doc_id")}


def _turn_terms(spark, sf_dir):
    q = _questions(spark, sf_dir)
    title = S.field_terms(q.select("query_id", F.col("text").alias("value"), F.lit("section_title").alias("target"), F.lit("substring").alias("match_method"), F.lit(1.0).alias("weight")))
    return title.unionByName(S.free_text_terms(q))


def _cut(spark, sf_dir, channel=None):
    i, terms = _turn_index(spark, sf_dir), _turn_terms(spark, sf_dir)
    h = S.bm25(terms.where(F.col("channel") == channel) if channel else terms, i["postings"], i["terms"], i["fields"], limits=S.CHANNEL_LIMIT).withColumn("score", F.round("score", 6))
    return S.ranked(h, ["query_id", "channel"], 20)


@query(f"{_CHANNELS} select query_id, unit, score, rank from cut where channel = 'content'")
def content_channel(spark, sf_dir):
    return _cut(spark, sf_dir, "content").select("query_id", "unit", "score", "rank")


@query(f"{_CHANNELS} select query_id, unit, score, rank from cut where channel = 'title'")
def title_channel(spark, sf_dir):
    return _cut(spark, sf_dir, "title").select("query_id", "unit", "score", "rank")


@query(f"{_FREE} select query_id, count(*)::bigint as n_terms, round(0.3 * count(*), 6)::double as boost from q group by query_id")
def free_text_fallback(spark, sf_dir):
    return S.free_text_terms(_questions(spark, sf_dir)).groupBy("query_id").agg(F.count("*").alias("n_terms"), F.round(F.sum("boost"), 6).alias("boost"))


@query("select item_id as query_id, conv_id || '_chunk_' || turn as unit, 1.0::double as score from benchmark, conversations where item_id % 10 = 0")
def every_query(spark, sf_dir):
    """Every tenth question without a token in its text: all units match."""
    q = _questions(spark, sf_dir).withColumn("text", F.when(F.col("query_id") % 10 == 0, "?! ...").otherwise(F.concat(F.lit("a "), "text")))
    units_ = _turns(spark, sf_dir).select(F.col("chunk_id").alias("unit"))
    return S.every(units_, S.tokenless(q)).select("query_id", "unit", "score")


_NORM = f"{_CHANNELS}, norm as (select query_id, channel, unit as chunk_id, case when max(score) over w = min(score) over w then 1.0 else (score - min(score) over w) / (max(score) over w - min(score) over w) end as score from cut window w as (partition by query_id, channel))"


@query(f"{_NORM} select query_id, channel, chunk_id, round(score, 6) as score from norm")
def minmax_normalize(spark, sf_dir):
    both = _cut(spark, sf_dir)
    return S.normalized(both.withColumnRenamed("unit", "chunk_id")).select("query_id", "channel", "chunk_id", F.round("score", 6).alias("score"))


_FUSED = f"""{_NORM}, weighted as (select query_id, chunk_id, score, w, sum(w) over (partition by query_id, chunk_id, channel) as x, channel from norm join (values ('content', 0.1::double), ('title', 0.2)) c(channel, w) using (channel)),
active as (select query_id, sum(w) as all_ from (select distinct query_id, channel, w from weighted) group by query_id),
fused as (select query_id, chunk_id, round(sum(w / all_ * score), 6) as score from weighted join active using (query_id) group by query_id, chunk_id)"""


@query(f"{_FUSED} select query_id, chunk_id, score from fused")
def weighted_fusion(spark, sf_dir):
    both = _cut(spark, sf_dir)
    w = local_rows(spark, [("content", 0.1), ("title", 0.2)], "channel string, weight double")
    return S.fused(S.normalized(both.withColumnRenamed("unit", "chunk_id")), w).withColumn("score", F.round("score", 6))


_FOUND = f"{_FUSED}, best as (select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id)::int as rank from fused qualify rank <= 10), found as (select * from best where score >= 0.01)"


def _found(spark, sf_dir):
    w = local_rows(spark, [("entity", 0.4), ("relation", 0.3), ("title", 0.2), ("content", 0.1)], "channel string, weight double")
    return _search(_turn_terms(spark, sf_dir), _turn_index(spark, sf_dir), w, 10)


@query(f"{_FOUND} select query_id, chunk_id, score, rank, doc_id, coalesce(prev, '') as prev_chunk_id, coalesce(next, '') as next_chunk_id from found join (select chunk_id, doc_id, lag(chunk_id) over w as prev, lead(chunk_id) over w as next from turns window w as (partition by doc_id order by chunk_index)) using (chunk_id)")
def structured_search(spark, sf_dir):
    """All questions at once: title and content channels, fusion, top 10, threshold, neighbours."""
    turns, hits = _turns(spark, sf_dir), _found(spark, sf_dir)
    own = hits.join(turns.select("chunk_id", "doc_id"), "chunk_id")
    near = S.neighbours(turns.join(own.select("doc_id").distinct(), "doc_id", "left_semi"), 1)  # of the hits' documents only
    h = hits.join(near, "chunk_id")
    one = lambda c: F.coalesce(F.get(c, 0), F.lit(""))
    return h.select("query_id", "chunk_id", "score", "rank", "doc_id", one("prev_ids").alias("prev_chunk_id"), one("next_ids").alias("next_chunk_id"))


def _unit_hits_sql(cte: str, source: str, unit: str, fields: list[str], words: list[str], owner: str) -> str:
    return f"with {cte}{_post_sql(source, unit, fields)}, q as (select unnest({words!r}) as term), hits as (select unit, round(sum({_BM25}), 6) as score from q join post using (term) join by_term using (field, term) join by_field using (field) group by unit) select {owner} as chunk_id, max(score) as score from hits group by 1"


@query(_unit_hits_sql("u as (select p_partkey::varchar as unit, p_name as name, p_brand as \"desc\" from part), ", "u", "unit", ["name", '"desc"'], ["green", "brand", "12"], "unit::bigint").replace("""'"desc"' as field""", "'desc' as field"))
def entity_channel_max(spark, sf_dir):
    e = _entities(spark, sf_dir)
    ask = _ask(spark, "entity", "name", ["green", "brand", "12"]).unionByName(_ask(spark, "entity", "desc", ["green", "brand", "12"]))
    h = S.bm25(ask, *_index(e, "unit", ["name", "desc"], sf_dir, "entities")).withColumn("score", F.round("score", 6))
    return S.best_per_chunk(S.ranked(h, ["query_id", "channel"], 10**9), e.select("unit", "chunk_id")).select("chunk_id", "score")


@query(_unit_hits_sql(f"{_RELATIONS}, u as (select relation_id || '#' || k as unit, s as subject, p as predicate, o as object from (select relation_id, 0 as k, subject as s, predicate as p, object as o from rel union all select relation_id, 1, object, predicate, subject from rel union all select relation_id, 2, object || ' ' || predicate, predicate, case when subject = '' then ' ' || predicate else subject end from rel)), ", "u", "unit", ["subject", "predicate", "object"], ["building", "france", "machinery"], "string_split(unit, '_')[1]::bigint"))
def relation_channel_max(spark, sf_dir):
    r = units.augmented(_relations(spark, sf_dir))
    # the three readings of a relation are units of their own
    from pyspark.sql import Window

    w = Window.partitionBy("relation_id").orderBy("subject", "predicate", "object")
    r = r.withColumn("unit", F.concat("relation_id", F.lit("#"), F.row_number().over(w))).withColumn("chunk_id", F.split_part("relation_id", F.lit("_"), F.lit(1)).cast("long"))
    ask = None
    for f in ("subject", "predicate", "object"):
        a = _ask(spark, "relation", f, ["building", "france", "machinery"])
        ask = a if ask is None else ask.unionByName(a)
    h = S.bm25(ask, *_index(r, "unit", ["subject", "predicate", "object"], sf_dir, "relations")).withColumn("score", F.round("score", 6))
    return S.best_per_chunk(h, r.select("unit", "chunk_id")).select("chunk_id", "score")


@query(f"with {_METAS}, {_post_sql('metas', 'unit', ['insurer', 'contract_name'])}, q(filter_ix, term) as (values (0, 'france'), (1, 'germany'), (1, 'supplier')), hits as (select filter_ix, unit, round(sum({_BM25}), 6) as score from q join post using (term) join by_term using (field, term) join by_field using (field) group by filter_ix, unit), top as (select filter_ix, unit, row_number() over (partition by filter_ix order by score desc, unit) as r from hits) select distinct unit as doc_id from top where r <= 2")
def meta_top2_filter(spark, sf_dir):
    ask = spark.createDataFrame([(i, "meta", f, w, "term", 1.0) for i, w in ((0, "france"), (1, "germany"), (1, "supplier")) for f in ("insurer", "contract_name")], "query_id long, channel string, field string, term string, kind string, boost double")
    h = S.bm25(ask, *_index(_metas(spark, sf_dir), "unit", ["insurer", "contract_name"], sf_dir, "metas"))
    return S.meta_documents(h.withColumn("filter_ix", F.col("query_id")).withColumn("query_id", F.lit(0))).select(F.col("unit").alias("doc_id"))


@query("select chunk_id, coalesce(prev, '') as prev_ids, coalesce(next, '') as next_ids from (select conv_id || '_chunk_' || turn as chunk_id, lag(conv_id || '_chunk_' || turn) over w as prev, lead(conv_id || '_chunk_' || turn) over w as next from conversations window w as (partition by conv_id order by turn))")
def adjacency_1(spark, sf_dir):
    return S.neighbours(_turns(spark, sf_dir), 1).select("chunk_id", F.array_join("prev_ids", ",").alias("prev_ids"), F.array_join("next_ids", ",").alias("next_ids"))


@query("select conv_id || '_chunk_' || turn as chunk_id, concat_ws(',', lag(k, 1) over w, lag(k, 2) over w, lag(k, 3) over w) as prev_ids from (select *, conv_id || '_chunk_' || turn as k from conversations) window w as (partition by conv_id order by turn)")
def adjacency_n(spark, sf_dir):
    """By pointers, as stored documents have them."""
    t = S.neighbours(_turns(spark, sf_dir), 1).select("chunk_id", F.get("prev_ids", 0).alias("prev_chunk_id"))
    return S.linked_neighbours(t, t, 3, "prev_chunk_id", "ids").select("chunk_id", F.array_join("ids", ",").alias("prev_ids"))


# Questions

_KEYS = D.keyword_table
_WORDS = ", ".join(f"('{c['id']}', {i}, {g}, {len(k['words'])}, {float(k['weight'])}::double, '{w}', {float(c['classification'].get('threshold') or 0)}::double)" for i, c in enumerate(D.categories()) if c["classification"]["method"] == "keyword" for g, k in enumerate(c["classification"]["keywords"]) for w in k["words"])
_CLASSIFY = rf"""with k(category_id, priority, group_ix, group_size, weight, word, threshold) as (values {_WORDS}),
w as (select {{id}} as query_id, unnest(list_distinct(list_concat(regexp_extract_all(text, '[\p{{{{L}}}}\p{{{{N}}}}]+'), string_split(text, '')))) as word from {{src}}),
s as (select query_id, category_id, priority, threshold, round(sum(weight / group_size), 6) as score from w join k using (word) group by all),
b as (select *, row_number() over (partition by query_id order by score desc, priority) as r from s where score >= threshold and score > 0)
select q.{{id}} as query_id, coalesce(category_id, 'policy') as category_id, coalesce(score, 0.0)::double as score from {{src}} q left join b on b.query_id = q.{{id}} and r = 1""".replace("{{{{", "{{").replace("}}}}", "}}")


@query(_CLASSIFY.format(id="item_id", src="benchmark"))
def classify_keyword(spark, sf_dir):
    return Q.classified(_questions(spark, sf_dir), D.keyword_table(spark), "policy")


@query(_CLASSIFY.format(id="doc_id", src="documents"))
def classify_default(spark, sf_dir):
    return Q.classified(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), "text"), D.keyword_table(spark), "policy")


@query("select event_id, (props::json->>'k')::bigint as k from events")
def llm_json_parse(spark, sf_dir):
    """Answers that are JSON as asked for."""
    raw = F.concat(F.lit('[{"query": '), F.col("props"), F.lit(', "filter": {"doc_ids": []}}]'))
    return table(spark, sf_dir, "events").select("event_id", F.get(Q.parsed_answers(raw), 0)["query"]["k"].cast("long").alias("k"))


@query("select event_id, (props::json->>'k') as k from events")
def json_rescue(spark, sf_dir):
    """Answers wrapped in talk: the JSON between the first and the last brace."""
    raw = F.concat(F.lit('Here it is: {"query": '), F.col("props"), F.lit(', "filter": {"doc_ids": []}} - done'))
    return table(spark, sf_dir, "events").select("event_id", F.get(Q.parsed_answers(raw), 0)["query"]["k"].alias("k"))


@query("select item_id as query_id, case when item_id % 2 = 0 then 'given' else text end as query_text from benchmark")
def fallback_query(spark, sf_dir):
    q = _questions(spark, sf_dir)
    got = F.when(F.col("query_id") % 2 == 0, F.create_map(F.lit("query_text"), F.lit("given")))
    return q.select("query_id", Q.with_fallback(got, F.col("text"))["query_text"].alias("query_text"))


@query("select item_id as query_id, 'query_text' as field_name, case when item_id % 3 = 0 then 'PLACEHOLDER' else text end as value, 'content' as target from benchmark union all select item_id, 'topic', null, 'section_title' from benchmark where item_id % 3 <> 0")
def placeholder_query(spark, sf_dir):
    q = _questions(spark, sf_dir).select("query_id", F.create_map(F.lit("query_text"), F.when(F.col("query_id") % 3 != 0, F.col("text"))).alias("fields"))
    s = spark.createDataFrame([("topic", "section_title", "fuzzy", 1.0), ("query_text", "content", "substring", 1.0)], "field_name string, target string, match_method string, weight double")
    return Q.query_fields(q, s).select("query_id", "field_name", "value", "target")


@query("""select 'q' || item_id as qid, 0 as seq, text || chr(10) || 'A. yes' || chr(10) || 'B. no' as query from benchmark where item_id % 2 = 0
union all select 'q' || item_id, 0, text || chr(10) || 'A. yes' from benchmark where item_id % 2 = 1 union all select 'q' || item_id, 1, text || chr(10) || 'B. no' from benchmark where item_id % 2 = 1""")
def option_fanout(spark, sf_dir):
    q = _questions(spark, sf_dir)
    return Q.fanned_out(q.select(F.concat(F.lit("q"), "query_id").alias("qid"), F.col("text").alias("question"), F.create_map(F.lit("B"), F.lit("no"), F.lit("A"), F.lit("yes")).alias("options"), F.when(F.col("query_id") % 2 == 0, "tf").otherwise("multi").alias("answer_format")))


def _asked(spark, sf_dir):
    """Hits of pairs of questions, as of one question's two options."""
    h = _found(spark, sf_dir)
    return h.select(F.floor(F.col("query_id") / 2).cast("long").alias("qid"), (F.col("query_id") % 2).alias("seq"), "rank", "chunk_id", "score")


@query(f"{_FOUND} select query_id // 2 as qid, query_id % 2 as seq, rank, chunk_id, score from found qualify row_number() over (partition by query_id // 2, chunk_id order by query_id % 2, rank) = 1")
def dedupe_first(spark, sf_dir):
    return Q.first_hits(_asked(spark, sf_dir))


@query(f"{_FOUND} select query_id, doc_id, chunk_id, score from found join turns using (chunk_id) qualify row_number() over (partition by query_id, doc_id order by score desc, chunk_id) = 1")
def top1_per_doc(spark, sf_dir):
    h = _found(spark, sf_dir).join(_turns(spark, sf_dir).select("chunk_id", "doc_id"), "chunk_id")
    return Q.best_per_document(h).select("query_id", "doc_id", "chunk_id", "score")


@query(f"{_FOUND}, n as materialized (select query_id, doc_id, chunk_id, score, row_number() over (partition by query_id, doc_id order by score desc, chunk_id) as n from found join turns using (chunk_id)) select query_id, doc_id, chunk_id, score from n where score > 0.2 or n = 1".replace(", n as materialized", ", nn as materialized").replace("from n where score", "from nn where score"))
def score_cut(spark, sf_dir):
    h = _found(spark, sf_dir).join(_turns(spark, sf_dir).select("chunk_id", "doc_id"), "chunk_id")
    return Q.cut_with_rescue(h).select("query_id", "doc_id", "chunk_id", "score")


@query(f"with {_TURNS} select chunk_id from turns where not contains(replace(section_title, ' ', ''), 'ofthe')")
def exclude_title(spark, sf_dir):
    return Q.without_title(_turns(spark, sf_dir), "ofthe").select("chunk_id")


_RENDER = """with h as (select conv_id, turn, role, coalesce(text, '') as content, row_number() over (partition by conv_id, role order by turn) as n from conversations),
p as (select conv_id, turn, case when n = 1 then '## ' || role || chr(10) || chr(10) else '' end || content as t from h)
select conv_id as qid, '# talk ' || conv_id || chr(10) || chr(10) || string_agg(t, chr(10) || chr(10) order by turn) as text from p group by conv_id"""


@query(_RENDER)
def group_order_render(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    return Q.evidence(t.select(F.col("conv_id").alias("qid"), F.lit(0).alias("doc_seq"), F.concat(F.lit("talk "), "conv_id").alias("name"), F.col("role").alias("section_path"), F.col("turn").alias("chunk_index"), F.coalesce("text", F.lit("")).alias("content")))


@query("select conv_id, role, min(turn) as turn from conversations group by conv_id, role")
def heading_once(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", F.lit(0.0).alias("score"), F.format_string("%020d", "turn").alias("chunk_id"))
    return Q.ranked_first(t, ["conv_id", "role"]).select("conv_id", "role", "turn")


@query(r"select name, max(page_id) as doc_id from (select page_id, regexp_replace(regexp_extract(url, '[^/]+$'), '\.[^./]*$', '') as name from pages) where name <> '' group by name")
def name_to_id_map(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(D.stem(F.col("url")).alias("name"), "page_id")
    return D.last_ids(p.where("name <> ''").select("name", F.col("page_id").alias("doc_id")), "doc_id")


@query("select item_id as query_id, 'You answer ' || case item_id % 3 when 0 then 'research' when 1 then 'insurance' else 'general' end || ' questions (' || case when item_id % 2 = 0 then 'multiple choice' else 'single choice' end || ').' || chr(10) || chr(10) || 'evidence' || chr(10) || chr(10) || text as prompt from benchmark")
def answer_prompt_route(spark, sf_dir):
    q = _questions(spark, sf_dir)
    qid = F.concat(F.when(F.col("query_id") % 3 == 0, "res").when(F.col("query_id") % 3 == 1, "ins").otherwise("xyz"), F.lit("_a_"), "query_id")
    return q.select("query_id", Q.answer_prompt(qid, F.when(F.col("query_id") % 2 == 0, "multi").otherwise("mcq"), F.col("text"), F.lit("evidence")).alias("prompt"))


# Chinese: the tables hold none, so letters are put for characters, the same in both engines.

_HAN = ("abcdefghij", "保险合同等待期九十天")
_HAN_SQL = f"translate(lower(text), '{_HAN[0]}', '{_HAN[1]}')"
_HAN_WORDS = r"regexp_extract_all(regexp_replace(t, '(\p{Han}+)', ' \1 ', 'g'), '[\p{L}\p{N}]+')"
_PAIRS = f"""h as (select item_id, {_HAN_SQL} as t from benchmark), hw as (select item_id, t, unnest({_HAN_WORDS}) as w from h),
pairs as (select item_id, t, case when regexp_matches(w, '^\\p{{Han}}{{2,}}$') then substr(w, i, 2) else w end as term
from (select item_id, t, w, unnest(case when regexp_matches(w, '^\\p{{Han}}{{2,}}$') then range(1, length(w)) else [1::bigint] end) as i from hw))""".replace("\\\\", "\\")


def _chinese(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.translate(F.lower("text"), *_HAN).alias("text"))


@query(f"with {_PAIRS} select item_id as query_id, term, count(*) as tf from pairs group by item_id, term")
def cjk_tokens(spark, sf_dir):
    return _chinese(spark, sf_dir).select("query_id", F.explode(analysis.cjk_tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("tf"))


_ASK_HAN = "等待期九"


@query(f"""with {_PAIRS}, post as (select item_id as unit, term, count(*) as tf from pairs group by item_id, term), dl as (select unit, sum(tf) as dl from post group by unit),
n as (select count(*) as n from benchmark), a as (select sum(dl) / (select n from n) as avgdl from dl), df as (select term, count(*) as df from post group by term), q as (select unnest(['等待', '待期', '期九']) as term)
select unit as query_id, round(sum(0.3 * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) as score from q join post using (term) join dl using (unit) join df using (term), n, a group by unit""")
def cjk_search(spark, sf_dir):
    """A phrase inside longer runs of characters, by pairs."""
    t = _chinese(spark, sf_dir)
    where = D.scratch(spark, f"{sf_dir}/chinese", t)
    post = D.stored_postings(spark, where, "chinese", t.withColumnRenamed("text", "content"), "query_id", ["content"], analysis.cjk_tokens)
    ask = S.free_text_terms(spark.createDataFrame([(0, _ASK_HAN)], "query_id long, text string"), analyze=analysis.cjk_tokens)
    return S.bm25(ask, *post).select(F.col("unit").alias("query_id"), F.round("score", 6).alias("score"))


_HAN_KEYS = [{"id": "term", "classification": {"method": "keyword", "threshold": 0.5, "keywords": [{"words": ["等待", "九十"], "weight": 1.0}]}}, {"id": "cover", "classification": {"method": "keyword", "threshold": 0.25, "keywords": [{"words": ["保险", "合同", "天"], "weight": 1.0}]}}]


@query(f"""with h as (select item_id as query_id, {_HAN_SQL} as t from benchmark),
k(category_id, priority, threshold, size, word) as (values ('term', 0, 0.5, 2, '等待'), ('term', 0, 0.5, 2, '九十'), ('cover', 1, 0.25, 3, '保险'), ('cover', 1, 0.25, 3, '合同'), ('cover', 1, 0.25, 3, '天')),
s as (select query_id, category_id, priority, threshold, round(sum(1.0 / size), 6) as score from h join k on contains(t, word) group by all),
b as (select * from s where score >= threshold qualify row_number() over (partition by query_id order by score desc, priority) = 1)
select query_id, coalesce(category_id, 'none') as category_id, coalesce(score, 0.0)::double as score from h left join b using (query_id)""")
def cjk_classify(spark, sf_dir):
    return Q.classified(_chinese(spark, sf_dir), D.keyword_table(spark, _HAN_KEYS), "none", analysis.cjk_tokens)


# Direct searches, phrases, limits


@query(f"with {_TURNS}, {_post_sql('turns', 'chunk_id', ['content', 'section_title'])}, q as (select unnest(['the', 'of']) as term), inside as (select unit from q join post using (term) group by unit having count(distinct term) = 2), hits as (select unit, round(sum({_BM25}), 6) as score from q join post using (term) join by_term using (field, term) join by_field using (field) where unit in (select unit from inside) group by unit) select unit, score, row_number() over (order by score desc, unit)::int as rank from hits qualify rank <= 10")
def direct_search(spark, sf_dir):
    """Both words required, each in any field; the ten best."""
    i = _turn_index(spark, sf_dir)
    return S.direct_search("the of", ["content", "section_title"], i["postings"], i["terms"], i["fields"], 10)


@query(f"with p as (select doc_id, ' ' || array_to_string({_TOK.format('text')}, ' ') || ' ' as t from documents) select doc_id as unit, 1 + contains(t, ' to ')::int as n_hits from p where contains(t, ' of the ') and contains(t, ' to ')")
def phrase_search(spark, sf_dir):
    """A phrase by token positions, and a word besides."""
    d = table(spark, sf_dir, "documents")
    return S.parsed_search(_documents(spark, sf_dir)[0], '"of the" to', units.places(d, "doc_id", ["text"])).select("unit", F.col("n_hits").cast("int").alias("n_hits"))


@query(f"select doc_id, term, string_agg(i - 1, ',' order by i) as positions from (select doc_id, w[i] as term, i from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from (select doc_id, {_TOK.format('text')} as w from documents))) where term in ('the', 'der') group by doc_id, term")
def token_positions(spark, sf_dir):
    p = units.places(table(spark, sf_dir, "documents"), "doc_id", ["text"])
    return p.where(F.col("term").isin("the", "der")).select(F.col("unit").alias("doc_id"), "term", F.array_join("positions", ",").alias("positions"))


@query(f"with u as (select o_orderkey as unit, o_orderstatus as name from orders), {_post_sql('u', 'unit', ['name'])}, hits as (select unit, round(sum({_BM25}), 6) as score from post join by_term using (field, term) join by_field using (field) where term in ('o', 'f', 'p') group by unit) select unit, score, row_number() over (order by score desc, unit)::int as rank from hits qualify rank <= 10000")
def entity_channel_limit(spark, sf_dir):
    """More hits than the entity channel keeps."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("unit"), F.col("o_orderstatus").alias("name"))
    h = S.bm25(_ask(spark, "entity", "name", ["o", "f", "p"]), *_index(o, "unit", ["name"], sf_dir, "orders")).withColumn("score", F.round("score", 6))
    return S.ranked(h, ["query_id", "channel"], S.CHANNEL_LIMIT["entity"]).select("unit", "score", "rank")


# Filters, responses, names


@query("select item_id as query_id, 0 as filter_ix, 'insurer' as field_name, 'Acme ' || item_id as value, 0.5::double as weight from benchmark union all select item_id, 1, 'contract_name', 'Plan', 1.0 from benchmark union all select item_id, 1, 'insurer', 'Bond', 0.5 from benchmark")
def filter_groups(spark, sf_dir):
    """Two groups in each answer, the first with one filter, the second with both."""
    raw = F.concat(F.lit('[{"query": {"insurer": "Acme '), "item_id", F.lit('", "contract_name": null}, "filter": {"doc_ids": []}}, {"query": {"insurer": "Bond", "contract_name": "Plan"}, "filter": {"doc_ids": []}}]'))
    filters = spark.createDataFrame([("insurer", "insurer", "fuzzy", 0.5), ("contract_name", "contract_name", "fuzzy", 1.0)], "field_name string, target string, match_method string, weight double")
    return Q.filter_groups(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), raw.alias("raw")), filters).select("query_id", "filter_ix", "field_name", "value", "weight")


@query("select conv_id as query_id, '{' || string_agg('\"' || role || '\":\"' || n || '\"', ',' order by role) || '}' as fields from (select conv_id, role, count(*) as n from conversations group by conv_id, role) group by conv_id")
def extracted_field_map(spark, sf_dir):
    f = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("query_id"), F.col("role").alias("field_name")).agg(F.count("*").cast("string").alias("value"))
    return Q.field_map(f)


@query(f"{_FOUND} select item_id as query_id, text as question, coalesce(total, 0) as total, coalesce(returned, 0) as returned, coalesce(chunks, '') as chunks from benchmark left join (select query_id, count(*) as total, count(*) filter (where rank <= 5) as returned, string_agg(chunk_id, ',' order by rank) filter (where rank <= 5) as chunks from found group by query_id) on query_id = item_id")
def response_record(spark, sf_dir):
    q = _questions(spark, sf_dir).select("query_id", F.col("text").alias("question"))
    r = Q.responses(q, _found(spark, sf_dir), 5)
    return r.select("query_id", "question", "total", "returned", F.array_join(F.transform("results", lambda x: x["chunk_id"]), ",").alias("chunks"))


_NAMED = "names as (select 'doc ' || n_nationkey as name, n_nationkey as doc_id from nation), asked as (select item_id as qid, unnest([0, 1])::int as seq, 'doc ' || (item_id % 30 + unnest([0, 1])) as name from benchmark)"


def _names(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("doc "), "n_nationkey").alias("name"), F.col("n_nationkey").alias("doc_id"))


def _naming(spark, sf_dir):
    """Questions that name two documents each; some names are unknown."""
    i = F.col("item_id") % 30
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.array(F.concat(F.lit("doc "), i), F.concat(F.lit("doc "), i + 1)).alias("doc_ids"))
    return Q.named_documents(q, _names(spark, sf_dir))


@query(f"with {_NAMED} select qid, seq, name, doc_id from asked left join names using (name)")
def names_to_ids(spark, sf_dir):
    return _naming(spark, sf_dir)


@query(f"with {_NAMED} select distinct name from asked where name not in (select name from names)")
def unknown_names(spark, sf_dir):
    return _naming(spark, sf_dir).where("doc_id is null").select("name").distinct()


@query(f"with {_NAMED} select c_custkey, name from customer join names on c_nationkey = doc_id")
def ids_to_names(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("doc_id"))
    return Q.with_names(c, _names(spark, sf_dir)).select("c_custkey", "name")


@query("select conv_id as query_id, turn, role as category_id, case when role = 'user' then 'user' else 'general' end as schema_id from conversations")
def category_schema(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), "turn", F.col("role").alias("category_id"))
    return Q.with_schema(c, spark.createDataFrame([("user",), ("general",)], "category_id string"), "general")


@query("select item_id as qid, text from benchmark order by item_id offset 7")
def skip_first(spark, sf_dir):
    return Q.skipped(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text"), 7)


@query("select item_id as query_id, text || chr(10) || chr(10) || 'A. yes' || chr(10) || chr(10) || 'Documents: {\"first\":\"' || item_id || '\",\"second\":\"x\"}' as prompt from benchmark")
def question_prompt(spark, sf_dir):
    names = F.create_map(F.lit("first"), F.col("query_id").cast("string"), F.lit("second"), F.lit("x"))
    return _questions(spark, sf_dir).select("query_id", Q.question_prompt(F.col("text"), F.lit("A. yes"), names).alias("prompt"))


@query("select event_id, case event_id % 3 when 2 then null else event_type end as answer, case event_id % 3 when 2 then null else event_id end as usage from events")
def answer_parse(spark, sf_dir):
    """Replies as JSON, as JSON within talk, and without JSON."""
    reply = F.concat(F.lit('{"think": "so", "answer": "'), "event_type", F.lit('", "usage": '), "event_id", F.lit("}"))
    raw = F.when(F.col("event_id") % 3 == 0, reply).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Well: "), reply, F.lit(" I think"))).otherwise("no idea")
    return table(spark, sf_dir, "events").withColumn("r", Q.parsed_reply(raw)).select("event_id", "r.answer", "r.usage")


@query("select n_regionkey as region, sum(n_nationkey)::bigint as usage, count(*) as answers from nation group by n_regionkey")
def token_usage(spark, sf_dir):
    """Tokens that the answers of each question used."""
    raw = F.concat(F.lit('{"answer": "A", "usage": '), "n_nationkey", F.lit("}"))
    r = table(spark, sf_dir, "nation").withColumn("r", Q.parsed_reply(raw))
    return r.groupBy(F.col("n_regionkey").alias("region")).agg(F.sum("r.usage").alias("usage"), F.count("r.answer").alias("answers"))


@query("select n_regionkey as region, '{' || string_agg('\"' || n_nationkey || '\":\"' || n_name || '\"', ',' order by n_nationkey::varchar) || '}' as names from nation group by n_regionkey")
def reverse_map(spark, sf_dir):
    """name -> id turned to id -> name, as JSON."""
    n = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.map_from_entries(F.collect_list(F.struct("n_name", F.col("n_nationkey").cast("string")))).alias("m"))
    back = Q.reversed_map(F.col("m"))
    return n.select("region", F.to_json(F.map_from_entries(F.array_sort(F.map_entries(back)))).alias("names"))


# The query language, filters that hold, vocabularies, dictionaries, extraction on executors, trees


@query(f"""with {_PAIRS}, rows as (select item_id as unit, flatten(list_transform({_HAN_WORDS}, lambda w: case when regexp_matches(w, '^\\p{{Han}}{{2,}}$') then list_transform(range(1, length(w)), lambda i: substr(w, i, 2)) else [w] end)) as words from h),
docs as (select unit from rows where contains(' ' || array_to_string(words, ' ') || ' ', ' 九等 等保 ')),
post as (select item_id as unit, term, count(*) as tf from pairs group by item_id, term), dl as (select unit, sum(tf) as dl from post group by unit),
n as (select count(*) as n from benchmark), a as (select sum(dl) / (select n from n) as avgdl from dl), df as (select term, count(*) as df from post group by term),
hits as (select unit, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) as score from docs join post using (unit) join dl using (unit) join df using (term), n, a where term in ('九等', '等保') group by unit)
select unit, score, row_number() over (order by score desc, unit)::int as rank from hits qualify rank <= 10""")
def direct_search_chinese(spark, sf_dir):
    """A word of three characters, which the index holds as two pairs: they are looked for side by side (which two runs of
    characters, one after the other, may be as well)."""
    t = _chinese(spark, sf_dir).withColumnRenamed("text", "content")
    post = D.stored_postings(spark, D.scratch(spark, f"{sf_dir}/chinese", t), "chinese", t, "query_id", ["content"], analysis.cjk_tokens)
    return S.direct_search("九等保", ["content"], *post, 10, units.places(t, "query_id", ["content"], analysis.cjk_tokens), analysis.cjk_tokens)


@query(f"""with {_TURNS}, {_post_sql('turns', 'chunk_id', ['content', 'section_title'])},
f as (select unit, bool_or(term = 'the') as a, bool_or(term = 'of') as b, bool_or(field = 'section_title' and term = 'to') as c, bool_or(field = 'section_title' and term = 'and') as d, bool_or(starts_with(term, 'der')) as e from post group by unit),
p as (select distinct unit from (select chunk_id as unit, ' ' || array_to_string({_TOK.format('content')}, ' ') || ' ' as t from turns union all select chunk_id, ' ' || array_to_string({_TOK.format('section_title')}, ' ') || ' ' from turns) where contains(t, ' of the ')),
inside as (select unit from f left join (select unit, true as ph from p) using (unit) where ((a and b) or coalesce(ph, false)) and (c or d) and not e),
q(field, term, boost) as (select field, term, boost from (values ('the', 3.0), ('of', 3.0)) x(term, boost), (values ('content'), ('section_title')) y(field) union all values ('section_title', 'to', 1.0), ('section_title', 'and', 1.0)),
hits as (select unit, round(sum(boost * {_BM25}), 6) as score from q join post using (field, term) join by_term using (field, term) join by_field using (field) where unit in (select unit from inside) group by unit)
select unit, score, row_number() over (order by score desc, unit)::int as rank from hits qualify rank <= 20""")
def nested_query(spark, sf_dir):
    """Groups, a phrase, boosts, a field and a pattern left out, nested."""
    t, i = _turns(spark, sf_dir), _turn_index(spark, sf_dir)
    places = units.places(t, "chunk_id", ["content", "section_title"])
    return S.direct_search('((the AND of) OR "of the"^2) section_title:(to OR and) -der*', ["content", "section_title"], i["postings"], i["terms"], i["fields"], 20, places)


@query(f"with {_post_sql('documents', 'doc_id', ['text'])}, hits as (select unit from post where term = 'the') select 0::bigint as query_id, count(*) as n from hits having n > 0 union all select 1, count(*) from hits join documents on doc_id = unit where lang = 'de' having count(*) > 0")
def filtered_queries(spark, sf_dir):
    """One query without a filter, one restricted to some documents, one to documents that aren't there, which finds nothing."""
    ask = spark.range(3).select(F.col("id").alias("query_id"), F.lit("content").alias("channel"), F.lit("text").alias("field"), F.lit("the").alias("term"), F.lit("term").alias("kind"), F.lit(1.0).alias("boost"))
    d = table(spark, sf_dir, "documents").where("lang = 'de'").select(F.lit(1).cast("long").alias("query_id"), F.col("doc_id").alias("unit"))
    docs = d.unionByName(spark.createDataFrame([(2, -1)], "query_id long, unit long"))
    limited = spark.createDataFrame([(1,), (2,)], "query_id long")
    return S.bm25(ask, *_documents(spark, sf_dir), docs=docs, limited=limited).groupBy("query_id").agg(F.count("*").alias("n"))


# by characters, which the engine's own edit distance doesn't count
_WITHOUT = "list_contains(list_transform(range(1, length({0}) + 1), lambda i: substr({0}, 1, i - 1) || substr({0}, i + 1)), {1})"
_ONE_EDIT = f"case length(asked) - length(term) when 0 then len(list_filter(range(1, length(term) + 1), lambda i: substr(asked, i, 1) <> substr(term, i, 1))) <= 1 when 1 then {_WITHOUT.format('asked', 'term')} when -1 then {_WITHOUT.format('term', 'asked')} else false end"


@query(f"with v as (select distinct unnest({_TOK.format('text')}) as term from documents), q as (select distinct term as asked from (select unnest({_TOK.format('text')}) as term from benchmark) where length(term) <= 4) select asked, term from q, v where {_ONE_EDIT}")
def fuzzy_any_start(spark, sf_dir):
    """Terms one edit away, whatever their first characters."""
    ask = _questions(spark, sf_dir).select(F.lit("text").alias("field"), F.explode(analysis.tokens(F.col("text"))).alias("term")).where("length(term) <= 4").distinct()
    keys = vocabulary.deletions(_documents(spark, sf_dir)[1], S.FUZZY_LENGTH + 1)
    return vocabulary.near_terms(ask, keys, prefix=0).select("asked", "term")


_PATTERNS = {"*ance": "^.*ance$", "in*r": "^in.*r$", "?a?e*": "^.a.e.*$", "*o*": "^.*o.*$", "qu*": "^qu.*$"}


@query(f"with v as (select distinct unnest({_TOK.format('text')}) as term from documents), q(pattern, r) as (values {', '.join(map(repr, _PATTERNS.items()))}) select pattern, count(*) as n, min(term) as first, max(term) as last from q, v where regexp_matches(term, r) group by pattern")
def pattern_terms(spark, sf_dir):
    """Terms by beginnings, ends and what lies within, looked up by their grams."""
    terms = _documents(spark, sf_dir)[1]
    where = D.scratch(spark, f"{sf_dir}/documents", table(spark, sf_dir, "documents"))
    grams = D.stored_index(spark, where, {"documents_grams": vocabulary.grams(terms).repartitionByRange("gram").sortWithinPartitions("gram")})["documents_grams"]
    out = None
    for p in _PATTERNS:
        found = vocabulary.pattern_terms(p, terms, grams).groupBy().agg(F.count("*").alias("n"), F.min("term").alias("first"), F.max("term").alias("last")).select(F.lit(p).alias("pattern"), "*")
        out = found if out is None else out.unionByName(found)
    return out.where("n > 0")


_DICT = {"保险": 50, "合同": 40, "保险合同": 3, "等待": 10, "等待期": 20, "期九": 2, "九十": 15, "九十天": 8, "十天": 9, "同等": 5, "九等": 12, "等保": 9, "九等保": 3, "保九": 4}
_DICT_COSTS = analysis.word_costs(_DICT)
_SEGMENTED = f"""h as (select item_id, {_HAN_SQL} as t from benchmark), hr as (select row_number() over () as r, item_id, w from (select item_id, unnest({_HAN_WORDS}) as w from h)),
m as (select map([{', '.join(repr(w) for w in _DICT_COSTS if w)}], [{', '.join(str(c) for w, c in _DICT_COSTS.items() if w)}]) as m),
path(r, w, i, costs, ends) as (
  select r, w, length(w), [0::bigint], [0::bigint] from hr where regexp_matches(w, '^\\p{{Han}}+$')
  union all
  select r, w, i - 1, list_prepend(best[1], costs), list_prepend(-best[2], ends) from (
    select r, w, i, costs, ends, list_min(list_filter(list_transform(range(i, least(length(w), i + {max(map(len, _DICT_COSTS)) - 1}) + 1),
      lambda j: [coalesce(m[substr(w, i, j - i + 1)]::bigint, case when j = i then {_DICT_COSTS[""]}::bigint end) + costs[j - i + 1], -j]), lambda x: x[1] is not null)) as best
    from path, m where i > 0)),
words(r, w, i, ends, term) as (
  select r, w, 1::bigint, ends, null::varchar from path where i = 0
  union all
  select r, w, ends[i] + 1, ends, substr(w, i, ends[i] - i + 1) from words where i <= length(w)),
terms as (select item_id, term from words join hr using (r) where term is not null union all select item_id, w from hr where not regexp_matches(w, '^\\p{{Han}}+$'))""".replace("\\\\", "\\")


@query(f"with recursive {_SEGMENTED} select item_id as query_id, term, count(*) as tf from terms group by item_id, term")
def dictionary_tokens(spark, sf_dir):
    """Segmentation by a dictionary: the cheapest path of each run's lattice."""
    analyze = analysis.DictionaryTokens(_DICT)
    return _chinese(spark, sf_dir).select("query_id", F.explode(analyze(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("tf"))


@query(f"with recursive {_SEGMENTED}, k(category_id, priority, threshold, size, word) as (values ('term', 0, 0.5, 2, '等待期'), ('term', 0, 0.5, 2, '九十天'), ('cover', 1, 0.25, 3, '保险'), ('cover', 1, 0.25, 3, '合同'), ('cover', 1, 0.25, 3, '天')), hit as (select distinct item_id, word from (select item_id, term as word from terms union all select item_id, unnest(string_split(t, '')) from h)), s as (select item_id, category_id, priority, threshold, round(sum(1.0 / size), 6) as score from hit join k using (word) group by all), b as (select * from s where score >= threshold qualify row_number() over (partition by item_id order by score desc, priority) = 1) select h.item_id as query_id, coalesce(category_id, 'none') as category_id, coalesce(score, 0.0)::double as score from h left join b using (item_id)")
def dictionary_classify(spark, sf_dir):
    keys = [{"id": "term", "classification": {"method": "keyword", "threshold": 0.5, "keywords": [{"words": ["等待期", "九十天"], "weight": 1.0}]}}, _HAN_KEYS[1]]
    return Q.classified(_chinese(spark, sf_dir), D.keyword_table(spark, keys), "none", analysis.DictionaryTokens(_DICT))


_LOOKED_FOR = ["the", "of the", "an", "er d", "nothing like this", "a"]


@query(f"with k as (select unnest({_LOOKED_FOR!r}) as word) select doc_id as query_id, word from documents, k where contains(text, word)")
def contained_words(spark, sf_dir):
    """Which of a list's words each document contains, by one automaton."""
    d = table(spark, sf_dir, "documents")
    return Q.contained(d.select(F.col("doc_id").alias("query_id"), "text"), _LOOKED_FOR)


def _model(question, prompt):
    """Answers by the question's length: no JSON, JSON in talk, JSON, a record without its filter."""
    answer = '{"query": {"query_text": "%d", "topic": null}, "filter": {"doc_ids": []}}' % len(question)
    return ("no idea", f"It is {answer}.", f"[{answer}, {answer}]", '{"query": {}}')[len(question) % 4]


@query("select item_id as query_id, case length(text) % 4 when 0 then 0 when 1 then 1 when 2 then 2 else 0 end::int as n_groups, case when length(text) % 4 in (1, 2) then length(text)::varchar end as first_text, length(text) % 4 in (0, 3) as failed from benchmark")
def batch_extraction(spark, sf_dir):
    """All questions' answers from a model, read on the executors; ones that can't be read are asked again, then kept as failed."""
    schemas = {"s": {"fields": [{"field_name": "query_text", "field_type": "string", "description": "words"}]}}
    q = _questions(spark, sf_dir).withColumn("schema_id", F.lit("s"))
    got = Q.extracted_batch(q, _model, schemas).withColumn("g", F.coalesce(Q.parsed_answers(F.col("fields")), F.array()))
    return got.select("query_id", F.size("g").alias("n_groups"), F.get("g", 0)["query"]["query_text"].alias("first_text"), F.col("fields_error").isNotNull().alias("failed"))


@query(f"""with v as (select item_id as query_id, unnest(list_distinct({_TOK.format('text')}[1:6])) as term, item_id % 4 as m from benchmark),
t as (select query_id, term, 'term' as kind, 0.5::double as boost, m from v union all select query_id, term, 'fuzzy', case m when 0 then 0.3 else 0.25 end, m from v where m in (0, 1) and length(term) <= 4)
select query_id, case m when 3 then 'content' else 'title' end as channel, case m when 3 then 'content' else 'section_title' end as field, term, kind, boost from t""")
def match_methods(spark, sf_dir):
    """Each question's first words by one of the match methods."""
    m = F.col("query_id") % 4
    value = F.array_join(F.array_distinct(F.slice(analysis.tokens(F.col("text")), 1, 6)), " ")
    f = _questions(spark, sf_dir).select("query_id", value.alias("value"), F.when(m == 3, "content").otherwise("section_title").alias("target"), F.when(m == 0, "exact_then_fuzzy").when(m == 1, "fuzzy").when(m == 2, "substring").otherwise("other").alias("match_method"), F.lit(0.5).alias("weight"))
    return S.field_terms(f).select("query_id", "channel", "field", "term", "kind", F.round("boost", 6).alias("boost"))


@query("with s as (select r_name, n_name, s_name from region join nation on n_regionkey = r_regionkey join supplier on s_nationkey = n_nationkey) select distinct 'world' as path, 1 as level from s union all select distinct 'world/' || r_name, 2 from s union all select distinct 'world/' || r_name || '/' || n_name, 3 from s union all select 'world/' || r_name || '/' || n_name || '/' || s_name, 4 from s")
def tree_sections(spark, sf_dir):
    """Trees as JSON text, to their sections by path."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n = s.groupBy("r_name", "n_name").agg(F.collect_list(F.struct(F.col("s_name").alias("title"))).alias("children"))
    r = n.groupBy("r_name").agg(F.collect_list(F.struct(F.col("n_name").alias("title"), "children")).alias("children"))
    w = r.agg(F.collect_list(F.struct(F.col("r_name").alias("title"), "children")).alias("children"))
    d = w.where(F.size("children") > 0).select(F.lit("d").alias("doc_id"), F.array(F.to_json(F.struct(F.lit("world").alias("title"), "children"))).alias("doc_tree"))
    return D.sections(d).select(F.array_join("path", "/").alias("path"), "level")
