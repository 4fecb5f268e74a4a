"""Toxicity by a weighted finite-state pattern grammar.

A lexicon transducer reads a word's letters and writes its class: INSULT, THREAT, TARGET, NEGATION, REPORT or nothing, with
a weight. A clause transducer reads the classes and writes patterns: an insult alone or aimed at a target, a threat at a
target, either of them negated or reported. The two are composed; each clause (up to . ! ? ; : or a line's end) is read from
the start state, and of each pattern the clause's best match counts, once: what is scored are matched clauses, not words.

A logistic layer turns a document's sums over clauses into a score. Its signs are the grammar's: an insult asserted of a
target weighs at least as much as one alone, threats never speak against toxicity, and what is negated or reported never for
it. Where labels say nothing of a pattern, its weight stays at the grammar's own.

The classes' general words are given for the four languages of the texts; insults are learned besides, as words or word
beginnings, from labelled documents, on a sample bounded by SAMPLE rows of which near copies count once. Labels, language,
source and id are no input of a score. Null and empty texts match nothing and get the lowest score. Unlabelled tables
leave the general words and the grammar's own weights.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, lean, same_columns, saved

#: Labelled rows learned from, least share of toxic documents and least odds of a learned insult, word beginnings' lengths,
#: words in the shingles by which near copies are told. ODDS: of 5 to 50, what cross-validation on training rows found best.
SAMPLE, SHARE, ODDS, STEM, SHINGLE = 20_000, 0.004, 12.0, range(4, 11), 5

# General words of each class in English, German, Spanish and French.
INSULTS = (
    "idiot moron stupid scum loser trash pathetic worthless disgusting imbecile cretin dumbass bastard vermin "
    "dummkopf abschaum arschloch schwachkopf idiota imbécil estúpido basura escoria imbécile crétin ordure connard"
).split()
THREATS = (
    "kill murder hurt destroy shoot stab strangle beat burn hang "
    "töten töte umbringen erschießen erschieße verprügeln erwürgen matar mataré golpear estrangular apuñalar tuer tuerai frapper étrangler poignarder"
).split()
TARGETS = (
    "you your yours u ur he she they them his her their him this these those all everyone people "
    "du dich dir dein deine ihr euch euer ihm ihnen diese dieser alle tú tu usted ustedes ellos ellas él ella todos toi vous ton votre ils elles cette ces tous"
).split()
NEGATIONS = (
    "not no never isn't aren't wasn't don't doesn't didn't won't cannot can't without hardly "
    "nicht kein keine keinen nie niemals ohne nunca jamás sin ni pas jamais aucun aucune sans"
).split()
REPORTS = (
    "said says say called calls claimed claims wrote writes quoted quote reported reports told according "
    "sagte sagt nannte nennt behauptete schrieb zitierte laut dijo dice llamó afirmó escribió según dit disait appelé affirmé écrit selon"
).split()

INSULT, THREAT, TARGET, NEGATION, REPORT = range(1, 6)
PATTERNS = ("insult", "insult_aimed", "insult_negated", "insult_reported", "threat_aimed", "threat_negated")
#: The layer's inputs are logs of sums of patterns: asserted insults, of these the aimed ones, insults that aren't asserted,
#: threats, negated threats; 1 for the intercept. Then the grammar's own weights, and their signs.
INPUTS = np.array([[1, 1, 0, 0, 0, 0], [0, 1, 0, 0, 0, 0], [0, 0, 1, 1, 0, 0], [0, 0, 0, 0, 1, 0], [0, 0, 0, 0, 0, 1]], float)
DEFAULT = np.array([1.2, 1.1, -0.5, 2.0, -0.5, -2.0])
SIGN = np.array([1, 1, -1, 1, -1])
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n]")


class Lexicon:
    """A trie over letters; final states carry (class, weight); an open final state also accepts every longer word."""

    def __init__(self, cues: dict[str, float] | None):
        self.arcs: list[dict[str, int]] = [{}]
        self.final: dict[int, tuple[int, float]] = {}
        self.open: dict[int, tuple[int, float]] = {}
        for kind, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
            for w in words:
                self.add(w, kind, 3.0 if kind == THREAT else 1.0)
        for w in INSULTS if cues is None else ():
            self.add(w, INSULT, 3.0)
        for w, weight in (cues or {}).items():
            self.add(w.rstrip("*"), INSULT, weight, w.endswith("*"))

    def add(self, word: str, kind: int, weight: float, longer: bool = False) -> None:
        s = 0
        for c in word:
            if c not in self.arcs[s]:
                self.arcs.append({})
                self.arcs[s][c] = len(self.arcs) - 1
            s = self.arcs[s][c]
        (self.open if longer else self.final)[s] = (kind, weight)

    def read(self, word: str) -> tuple[int, float]:
        s, best = 0, (0, 0.0)
        for c in word:
            if (s := self.arcs[s].get(c, -1)) < 0:
                return best
            best = self.open.get(s, best)
        return self.final.get(s, best)


#: How many words a target, a negation or a report reaches over within its clause.
REACH = {TARGET: 6, NEGATION: 3, REPORT: 8}


def clause_machine() -> dict[tuple, tuple]:
    """(state, class) -> (state, patterns written). A state holds how far target, negation and report still reach, and
    whether an insult or a threat waits for a target that may follow."""
    start, arcs, open_ = (0, 0, 0, 0), {}, [(0, 0, 0, 0)]
    seen = {start}
    while open_:
        t, n, r, wait = state = open_.pop()
        for kind in range(6):
            t2, n2, r2 = (REACH[k] if kind == k else max(0, x - 1) for k, x in ((TARGET, t), (NEGATION, n), (REPORT, r)))
            out, w2 = [], max(0, abs(wait) - 1) * (1 if wait > 0 else -1)
            if kind == INSULT:
                out.append("insult_negated" if n else "insult_reported" if r else "insult_aimed" if t else "insult")
                w2 = 0 if n or r or t else 4
            elif kind == THREAT:
                if n:
                    out.append("threat_negated")
                elif t and not r:
                    out.append("threat_aimed")
                w2 = 0 if n or r or t else -4
            elif kind == TARGET and wait:
                out.append("insult_aimed" if wait > 0 else "threat_aimed")
                w2 = 0
            new = (t2, n2, r2, w2)
            arcs[state, kind] = (new, tuple(out))
            if new not in seen:
                seen.add(new)
                open_.append(new)
    return arcs


class Grammar:
    """The composition of lexicon and clause machine; words already read keep their class in a bounded memory."""

    START = (0, 0, 0, 0)

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.arcs, self.known = lexicon, clause_machine(), {}

    def patterns(self, text: str) -> np.ndarray:
        sums, known = np.zeros(len(PATTERNS)), self.known
        words = _TOKEN.findall(text.lower())
        if len(known) > 500_000:
            known.clear()
        kinds = set()
        for w in set(words):
            if w not in known:
                known[w] = self.lexicon.read(w) if w[0] not in ".!?;:\n" else (-1, 0.0)
            kinds.add(known[w][0])
        if INSULT not in kinds and THREAT not in kinds:
            return sums  # no accepting path
        state, held, best = self.START, 0.0, {}
        for w in words:
            kind, weight = known[w]
            if kind < 0:
                for p, x in best.items():
                    sums[PATTERNS.index(p)] += x
                state, best = self.START, {}
                continue
            state, out = self.arcs[state, kind]
            if kind in (INSULT, THREAT):
                held = weight
            for p in out:
                best[p] = max(best.get(p, 0.0), held if kind == TARGET else weight)
        for p, x in best.items():
            sums[PATTERNS.index(p)] += x
        return sums


def _stems(text: str) -> set[str]:
    out = set()
    for w in set(_TOKEN.findall(text.lower())):
        if len(w) >= STEM[0]:
            out.add(w)
            out.update(w[:k] + "*" for k in STEM if k < len(w))
    return out


def _decoded(column) -> list[str]:
    return [(x or b"").decode(errors="replace") for x in column.to_pylist()]


def _count_stems(batches):
    """Documents that hold each stem, summed within the batch."""
    for batch in batches:
        n = Counter()
        for text in _decoded(batch.column("text")):
            n.update(_stems(text))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["stem", "n"])


def stem_odds(rows: DataFrame, bad: int, good: int) -> DataFrame:
    """rows (text, toxic) -> stem, hits, odds, strong: each stem of enough toxic texts, with the odds that it speaks for
    toxic; strong ones reach ODDS and hardly pass by chance. Counts meet in a join; no stem is left out for its frequency."""
    least = max(3, math.ceil(SHARE * bad))
    count = lambda toxic, n: rows.where(F.col("toxic") == toxic).mapInArrow(_count_stems, "stem string, n long").groupBy("stem").agg(F.sum("n").alias(n))
    both = saved(count(1, "hits").where(F.col("hits") >= least).join(count(0, "misses"), "stem", "left").fillna(0, ["misses"]), "stems")
    tried = max(2, both.count())
    odds = ((F.col("hits") + 0.5) / (bad + 1)) / ((F.col("misses") + 0.5) / (good + 1))
    # of the stems tried, were they without bearing on the label, about one passes by chance (a likelihood-ratio bound)
    share, all_ = bad / (bad + good), F.col("hits") + F.col("misses")
    part = lambda k, p: F.when(k > 0, k * F.log(k / (all_ * p))).otherwise(0.0)
    sure = part(F.col("hits"), share) + part(F.col("misses"), 1 - share) >= math.log(tried)
    return both.select("stem", "hits", odds.alias("odds"), ((odds >= ODDS) & sure).alias("strong"))


def chosen(hits: dict[str, int], odds: dict[str, float], strong: set[str]) -> dict[str, float]:
    """Learned insults with weights: of forms that begin alike, the longest that keeps nearly all of its beginning's
    documents; of the rest, those under no other. General words are added unless the labels say otherwise."""
    fuller: dict[str, int] = {}  # a beginning -> the most documents of a longer strong form
    for t in strong:
        word = t.rstrip("*")
        for k in STEM:
            if k < len(word) or k == len(word) and not t.endswith("*"):
                fuller[word[:k]] = max(fuller.get(word[:k], 0), hits[t])
    cues: dict[str, float] = {}
    for s in sorted(strong, key=lambda s: (-hits[s], len(s.rstrip("*")), s)):
        word = s.rstrip("*")
        if s.endswith("*") and fuller.get(word, 0) >= 0.9 * hits[s] or any(f"{word[:k]}*" in cues for k in STEM if k <= len(word)):
            continue
        cues[s] = min(8.0, math.log(odds[s]))
    return cues | {w: 3.0 for w in INSULTS if w not in cues and odds.get(w, 2.0) >= 2.0}


def _keyed(batches):
    """Rows with a key that most near copies share: the least hash of the text's shingles."""
    import xxhash

    for batch in batches:
        keys = []
        for text in batch.column("text").to_pylist():
            w = text.lower().split()
            keys.append(min(xxhash.xxh3_64_intdigest(b" ".join(w[k : k + SHINGLE])) for k in range(max(1, len(w) - SHINGLE + 1))) >> 1)
        yield batch.append_column("key", pa.array(keys, pa.int64()))


def _sums(lexicon_cues):
    def run(batches):
        g = Grammar(Lexicon(lexicon_cues))
        for batch in batches:
            x = [g.patterns(t).tolist() for t in _decoded(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

    return run


def _features(sums: np.ndarray) -> np.ndarray:
    return np.column_stack([np.log1p(sums @ INPUTS.T), np.ones(len(sums))])


def fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton steps, held near the grammar's own weights by a ridge and to their signs."""
    w = DEFAULT.copy()
    ridge = np.append(np.full(x.shape[1] - 1, 0.05), 1e-3)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * (w - DEFAULT))
        step *= min(1, 2 / (np.abs(step).max() + 1e-12))
        new = w + step
        new[:-1] = np.where(new[:-1] * SIGN > 0, new[:-1], 0)
        w, moved = new, np.abs(new - w).max()
        if moved < 1e-6:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float] | None, np.ndarray]:
    """Insults with weights, and the logistic layer, from labelled documents with crc32(doc_id) mod 5 != 0.

    The sample's ids (SAMPLE or a few more, by a hash) are broadcast, so no text is moved to be joined; of rows that share
    their least shingle and their label, one is learned from."""
    spark = docs.sparkSession
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marks = marks.where("toxic is not null and doc_id is not null and crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    every = max(1, math.ceil(marks.count() / SAMPLE))
    marks = marks.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(every)) == 0)
    rows = frugal(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).where("text is not null")
    rows = rows.join(F.broadcast(marks), "doc_id").select("text", "toxic").mapInArrow(_keyed, "text binary, toxic int, key long")
    rows = saved(rows.groupBy("key", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "toxic"), "labelled")
    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = size.get(1, 0), size.get(0, 0)
    if not bad or not good:
        return None, DEFAULT
    found = stem_odds(rows, bad, good).where(F.col("strong") | F.col("stem").isin(sorted(INSULTS))).collect()
    cues = chosen({r["stem"]: r["hits"] for r in found}, {r["stem"]: r["odds"] for r in found}, {r["stem"] for r in found if r["strong"]})
    shared = spark.sparkContext.broadcast(cues)
    got = rows.mapInArrow(lambda b: _sums(shared.value)(b), "toxic int, x array<double>").collect()  # SAMPLE rows, or nearly
    x, y = _features(np.array([r["x"] for r in got])), np.array([r["toxic"] for r in got], float)
    return cues, fit_logistic(x, y)


def _score(cues, weights):
    def run(batches):
        g = Grammar(Lexicon(cues))
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 1024):
                part = batch.slice(at, 1024)
                sums = np.array([g.patterns(t) for t in _decoded(part.column("text"))]).reshape(part.num_rows, len(PATTERNS))
                score = 1 / (1 + np.exp(-np.clip(_features(sums) @ weights, -500, 500)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return run


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, held_out, score, predicted, one row for each of docs; a null doc_id counts as
    an empty text in held_out's remainder. An empty table gives an empty one; extra columns are ignored."""
    cues, weights = learn(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast((cues, weights))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    out = rows.mapInArrow(lean(lambda b: _score(*shared.value)(b)), "doc_id long, score double")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those scored 0.5 or more, with all their columns. Each row is judged by its own text."""
    cues, weights = learn(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast((cues, weights))

    text_at = docs.columns.index("text")

    def run(batches):
        cues, weights = shared.value
        g = Grammar(Lexicon(cues))
        for batch in batches:
            texts = [x or "" for x in batch.column(text_at).to_pylist()]
            sums = np.array([g.patterns(t) for t in texts]).reshape(batch.num_rows, len(PATTERNS))
            yield batch.filter(pa.array(_features(sums) @ weights < 0))

    return same_columns(docs, lean(run))
