"""Language-model scoring by a weighted backoff automaton over the whole corpus's n-grams.

Model: states are the histories seen in training; an arc reads a word with the smoothed probability of history and word;
a failure arc leads to the next shorter history and weighs mu / (c(history) + mu). With Dirichlet smoothing
P(w | h) = (c(h w) + mu P(w | shorter h)) / (c(h) + mu) the arcs and the failure arc of each state sum to one.
The empty history reads a word with (c + 0.1) / (N + 0.1 (V + 1)).

Distribution: documents are dealt to blocks by a hash of their id. Each block sends its distinct n-grams, as sorted packed
64-bit hashes with their training counts, to shards by hash range; a shard adds up and answers each block, in the order it
asked, with what the other blocks add to its counts and whether another block holds it. So an n-gram crosses the network once
for each block that holds it, however often it occurs, and no task or the driver holds the corpus's counts. Orders above two
are asked for one after the other, and only n-grams whose two shorter ones other blocks hold too: no other can occur there.

A block then takes its documents in parts of about PART tokens, builds for each part what of the automaton it can reach -
every state and arc - and runs it, left to right, over each document, many at a time: each carries its state, reads a token by an arc or, where the state has none, goes
on from the state behind its failure arc, and adds up the logarithms of the weights. A long document is read in stretches of
STRETCH tokens; a stretch first reads the order - 1 tokens before it from the empty history, unscored, which leads to the
state that the document has there, as a state is the longest known history.

Null and empty texts hold the end token only. A null doc_id is held out. Rows that share a doc_id are scored each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Route, Slots, Words, block_count, blocked, crc_mod, frugal, give_back, mix, pack, unpack

#: Longest n-gram, the Dirichlet weight of each order from 2 on, text bytes in a block.
ORDER, MU, BLOCK_BYTES = 3, (40.0, 20.0), 16 << 20
HOLD_OUT = 10
#: Tokens that are read one after the other; tokens, in whole documents, that an automaton is built for.
STRETCH, PART = 256, 1 << 19
_START, _END = b" ", b""  # no word equals these


class Grams:
    """A block's documents as token numbers, and its n-grams' sorted distinct hashes."""

    def __init__(self, t: pa.Table, order: int):
        self.ids = t.column("doc_id").to_pylist()
        words = Words()
        start, end = words[_START], words[_END]
        rows = []
        for chunk in t.column("text").chunks:
            for x in chunk:
                rows += [[start], words.numbers(x.as_py()), [end]]
        tokens = np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32)
        del rows
        self.first = tokens == start
        self.begin = np.flatnonzero(self.first)
        self.train = np.array([crc_mod(i, HOLD_OUT) != 0 for i in self.ids], bool)
        of = np.cumsum(self.first) - 1
        h = mix(words.hashes())
        self.start_key = h[start]
        trained = self.train[of] if len(of) else np.zeros(0, bool)
        self.at, self.keys, self.counts = [], [], []  # by order: each position's place in keys, keys, training counts
        key, valid = h[tokens], np.ones(len(tokens), bool)
        for k in range(1, order + 1):
            if k > 1:
                shorter = key
                key = np.zeros_like(key)
                key[1:] = mix(shorter[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[tokens[1:]])
                before = valid
                valid = np.zeros_like(valid)
                valid[1:] = before[:-1] & ~self.first[1:]
            own, at = np.unique(key[valid], return_inverse=True)
            place = np.full(len(key), -1, np.int32)
            place[valid] = at
            self.at.append(place)
            self.keys.append(own)
            self.counts.append(np.bincount(at[trained[valid]], minlength=len(own)).astype(np.uint32))

    def asked(self, k: int, shared: np.ndarray | None) -> np.ndarray:
        """Which keys of order k+1 are asked for; shared: which of order k other blocks hold."""
        if k < 2:
            return np.ones(len(self.keys[k]), bool)
        where = np.flatnonzero(self.at[k] >= 0)
        both = shared[self.at[k - 1][where - 1]] & shared[self.at[k - 1][where]]
        out = np.zeros(len(self.keys[k]), bool)
        out[self.at[k][where[both]]] = True
        return out

    def answered(self, rows: list[dict], upto: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """By order, for each key: what other blocks add to its count, and whether another block holds it."""
        others, shared = [], []
        for k in range(upto):
            ask = self.asked(k, shared[-1] if shared else None)
            own = sorted((r for r in rows if r["k"] == k), key=lambda r: r["shard"])
            o, s = np.zeros(len(ask), np.int64), np.zeros(len(ask), bool)
            if own:
                o[ask] = np.concatenate([unpack(r["others"], np.int64) for r in own])
                s[ask] = np.concatenate([np.unpackbits(unpack(r["shared"], np.uint8), count=int.from_bytes(r["others"][:8], "little")) for r in own]) > 0
            others.append(o)
            shared.append(s)
        return others, shared


def _ask(orders: range, shards: int):
    """Asks for n-grams of these lengths, less one; answers: those to the shorter ones, if any."""

    def run(t: pa.Table, answers: pa.Table | None) -> pa.Table:
        g, out = Grams(t, orders.stop), {"shard": [], "k": [], "keys": [], "counts": []}
        shared = g.answered(answers.to_pylist(), orders.start)[1][-1] if answers is not None else None
        edges = np.array([(s << 64) // shards for s in range(shards)], np.uint64)  # shards are equal ranges of the hash
        for k in orders:
            ask = g.asked(k, shared)
            keys, counts = g.keys[k][ask], g.counts[k][ask]
            cut = np.append(np.searchsorted(keys, edges), len(keys))
            for s in range(shards):
                lo, hi = cut[s], cut[s + 1]
                if k == 0 or hi > lo:  # every shard hears of every block, so that N and V reach it
                    for c, v in zip(out, (s, k, pack(keys[lo:hi], delta=True), pack(counts[lo:hi])), strict=True):
                        out[c].append(v)
        n = len(out["shard"])
        del g
        give_back()
        return pa.table({"_b": pa.array([t.column("_b")[0].as_py()] * n, pa.int64()), "shard": pa.array(out["shard"], pa.int32()), "k": pa.array(out["k"], pa.int32()), "keys": pa.array(out["keys"], pa.binary()), "counts": pa.array(out["counts"], pa.binary())})

    return run


def _of_one(run):
    """run without answers yet; Spark goes by the number of arguments."""
    return lambda t: run(t, None)


def _answer(start_key: int):
    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        out = {"_b": [], "shard": [], "k": [], "n": [], "v": [], "others": [], "shared": []}
        for k in sorted({r["k"] for r in rows}):
            own = [r for r in rows if r["k"] == k]
            keys = [unpack(r["keys"], np.uint64, delta=True) for r in own]
            counts = np.concatenate([unpack(r["counts"], np.uint32) for r in own])
            distinct, at, blocks = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
            totals = np.bincount(at, weights=counts, minlength=len(distinct)).astype(np.int64)
            others, shared = totals[at] - counts, blocks[at] > 1
            words = distinct != np.uint64(start_key)
            n, v = (int(totals[words].sum()), int((totals[words] > 0).sum())) if k == 0 else (0, 0)
            ends = np.cumsum([len(x) for x in keys])
            for r, end, x in zip(own, ends, keys, strict=True):
                for c, y in zip(out, (r["_b"], r["shard"], k, n, v, pack(others[end - len(x) : end]), pack(np.packbits(shared[end - len(x) : end]))), strict=True):
                    out[c].append(y)
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.table({c: pa.array(v, kind) for (c, v), kind in zip(out.items(), kinds, strict=True)})

    return run


class Automaton:
    """States are the histories seen in training, by order; 0 is the empty history."""

    def __init__(self, places: list[np.ndarray], counts: list[np.ndarray], mu: tuple[float, ...], n: int, v: int):
        """places: by order, the key that ends at each token, or -1; counts: of each order's keys in all training documents."""
        order, self.words = len(counts), len(counts[0])
        seen = [c > 0 for c in counts]
        base = 1
        state = []  # of each key: its state, or -1
        for k in range(order - 1):
            state.append(np.where(seen[k], base + np.cumsum(seen[k]) - 1, -1))
            base += int(seen[k].sum())
        weight = (counts[0] + 0.1) / (n + 0.1 * (v + 1))
        self.known, self.read_log = seen[0], np.log10(weight)  # what the empty history reads
        self.read_to = np.maximum(state[0], 0) if order > 1 else np.zeros(self.words, np.int64)
        self.fail_log, self.fail_to = np.zeros(base), np.zeros(base, np.int64)
        keys, logs, to = [], [], []
        for k in range(1, order):
            where = np.flatnonzero(places[k] >= 0)
            first = np.zeros(len(counts[k]), np.int64)
            first[places[k][where]] = where  # one of the tokens at which each key ends
            history, word, suffix = places[k - 1][first - 1], places[0][first], places[k - 1][first]
            c = counts[k - 1][history]
            weight = (counts[k] + mu[k - 1] * weight[suffix]) / (c + mu[k - 1])
            arc = seen[k]
            keys.append(state[k - 1][history[arc]] * self.words + word[arc])
            logs.append(np.log10(weight[arc]))
            to.append(state[k][arc] if k < order - 1 else state[k - 1][suffix[arc]])
            own = state[k - 1] >= 0  # histories of order k, and where they fail to: their own suffixes
            self.fail_log[state[k - 1][own]] = np.log10(mu[k - 1] / (counts[k - 1][own] + mu[k - 1]))
            if k < order - 1:
                self.fail_to[state[k][arc]] = state[k - 1][suffix[arc]]
        self.arcs = Slots(sum(map(len, keys)))
        self.arc_log, self.arc_to = (np.concatenate(x) if x else np.zeros(0) for x in (logs, to))
        if keys:
            self.arcs.put(np.concatenate(keys), np.arange(len(self.arc_log)))

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each state reads a word -> the next states and the logarithms of the weights on the way."""
        log, to = self.read_log[word], self.read_to[word]
        at = np.flatnonzero(state > 0)
        failed = np.zeros(len(state))
        while len(at):
            arc = self.arcs.get(state[at] * self.words + word[at])
            hit = arc >= 0
            log[at[hit]], to[at[hit]] = self.arc_log[arc[hit]], self.arc_to[arc[hit]]
            at = at[~hit]
            failed[at] += self.fail_log[state[at]]
            state[at] = self.fail_to[state[at]]
            at = at[state[at] > 0]
        return to, log + failed

    def read(self, word: np.ndarray, begin: np.ndarray, end: np.ndarray, back: int) -> np.ndarray:
        """word: tokens; documents from begin (their start token, unscored) to end -> the sum of logarithms of each."""
        parts = -(-(end - begin - 1) // STRETCH)
        doc = np.repeat(np.arange(len(begin)), parts)
        lo = begin[doc] + 1 + STRETCH * (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts))
        hi = np.minimum(lo + STRETCH, end[doc])
        at = np.maximum(lo - back, begin[doc])
        by = np.argsort(at - hi, kind="stable")  # the longest first, so that those still reading stand in front
        lo, hi, at, doc = lo[by], hi[by], at[by], doc[by]
        state, total, still = np.zeros(len(doc), np.int64), np.zeros(len(doc)), len(doc)
        while still:
            new, log = self.step(state[:still], word[at[:still]])
            state[:still] = new
            total[:still] += np.where(at[:still] >= lo[:still], log, 0.0)
            at += 1
            while still and at[still - 1] >= hi[still - 1]:
                still = int(np.searchsorted(-(hi - at)[:still], 0, "left"))
        return np.bincount(doc, total, len(begin))


def _reached(places: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """places with the keys they hold numbered anew, in the same order, and those keys' counts."""
    used = np.zeros(len(counts) + 1, bool)
    used[places] = True  # -1 marks the last
    used[-1] = False
    number = np.append(np.cumsum(used[:-1], dtype=np.int32) - 1, np.int32(-1))
    return number[places], counts[used[:-1]]


def _score(order: int, mu: tuple[float, ...]):
    def run(t: pa.Table, answers: pa.Table) -> pa.Table:
        g = Grams(t, order)
        rows = answers.to_pylist()
        n, v = sum(r["n"] for r in rows), sum(r["v"] for r in rows)
        counts = [c + o for c, o in zip(g.counts, g.answered(rows, order)[0], strict=True)]
        begin = g.begin
        end = np.append(begin[1:], len(g.first))[: len(begin)]
        score, base, known = np.zeros(len(begin)), np.zeros(len(begin)), np.zeros(len(begin), np.int64)
        lo = 0
        while lo < len(begin):  # whole documents
            hi = max(lo + 1, int(np.searchsorted(end, begin[lo] + PART, "right")))
            span = slice(begin[lo], end[hi - 1])
            places, own = zip(*(_reached(g.at[k][span], counts[k]) for k in range(order)), strict=True)
            a, first = Automaton(places, own, mu, n, v), begin[lo:hi] - begin[lo]
            score[lo:hi] = a.read(places[0], first, end[lo:hi] - begin[lo], order - 1)
            read = ~g.first[span]
            base[lo:hi] = np.add.reduceat(np.where(read, a.read_log[places[0]], 0.0), first)
            known[lo:hi] = np.add.reduceat((read & a.known[places[0]]).astype(np.int64), first)
            lo = hi
        size = end - begin - 1
        give_back()
        return pa.table({"doc_id": pa.array(g.ids, pa.int64()), "held_out": pa.array(~g.train), "n_tokens": pa.array(size.astype(np.int64)), "n_known": pa.array(known), "train_tokens": pa.array(np.full(len(size), n, np.int64)), "base_score": pa.array(base), "score": pa.array(score)})

    return run


def lm_scores(docs: DataFrame, order: int = ORDER, mu: tuple[float, ...] = MU, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, one row each.

    mu: the Dirichlet weight of orders 2 to `order`. An empty table gives an empty one; extra columns are ignored."""
    if len(mu) != order - 1:
        raise ValueError("mu needs a weight for each order from 2 on")
    docs = frugal(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    n = block_count(docs, "text", block_bytes)
    dealt = blocked(docs, n)
    words = Words()
    words[_START]
    answer, kinds = _answer(int(mix(words.hashes())[0])), "_b long, shard int, k int, n long, v long, others binary, shared binary"
    answers, route = None, Route(n)
    for orders in [range(0, min(order, 2)), *(range(k, k + 1) for k in range(2, order))]:
        blocks, ask, asks = dealt.groupBy("_b"), _ask(orders, n), "_b long, shard int, k int, keys binary, counts binary"
        if answers is None:
            asked = route.send(blocks, _of_one(ask), asks, "_b", "shard")
        else:
            asked = route.send(blocks.cogroup(answers.groupBy("_b")), route.open(ask), asks, "_b", "shard")
        got = route.send(asked.groupBy("shard"), route.open(answer), kinds, "shard", "_b")
        answers = got if answers is None else answers.unionByName(got)
    return dealt.groupBy("_b").cogroup(answers.groupBy("_b")).applyInArrow(route.open(_score(order, mu)), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
