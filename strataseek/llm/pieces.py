"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies by a score-ordered agenda.

A text's spaces become U+2581, one is put before it, and adjacent symbol pairs whose join is a piece are merged, the best
score first, of equal scores the leftmost. Joins never reach over a character pair that no piece holds, so a text falls
into stretches that are encoded apart and remembered. A batch's new stretches are encoded together: their agendas are one
column, and each round makes the next join of every stretch. Characters without a piece become byte pieces.

All of it works on columns of numbers: a batch is one array of characters, a stretch is known by the 64-bit hash of its
characters, and what is remembered are a table of hashes and one array of ids, bounded by MEMORY stretches and ids.

Each Arrow batch is also encoded and decoded by the sentencepiece library; `checked` says whether both agree. A text that
differs (two stretches with one hash would do that) is encoded again alone, stretch by stretch, without what is remembered.
Null texts are empty and have no ids. Rows that share a doc_id are encoded each.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Slots, frugal, lean, mix

SPACE = "▁"
#: Stretches remembered, and ids of them.
MEMORY, MEMORY_IDS = 300_000, 4_000_000
#: Stretches of more symbols have an agenda of their own, a heap.
JOINT = 40
#: Characters encoded at a time; a longer text is cut before spaces.
CHARACTERS = 1 << 20
NEVER = 1 << 40


class Encoder:
    def __init__(self, model_file: str):
        import sentencepiece

        self.library = s = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.pieces = [s.id_to_piece(i) for i in range(s.get_piece_size())]
        special = [s.is_control(i) or s.is_unknown(i) or s.is_byte(i) or s.is_unused(i) for i in range(len(self.pieces))]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.bytes = {i: int(self.pieces[i][3:-1], 16) for i in range(len(self.pieces)) if s.is_byte(i)}
        self.byte_ids = {v: k for k, v in self.bytes.items()}
        self.silent = {i for i in range(len(self.pieces)) if s.is_control(i)}
        self.unknown = s.unk_id()
        joined = [p for p in self.ids if len(p) > 1]
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in joined)  # no join reaches over a space after another character
        # symbols are numbered: pieces by id, then characters that only occur inside pieces
        number = dict(self.ids)
        inner = sorted({c for p in joined for c in p})
        for c in inner:
            number.setdefault(c, len(self.pieces) + len(number))
        self.characters = {p: i for p, i in number.items() if len(p) == 1}
        ranks = {x: k for k, x in enumerate(sorted({-s.get_score(self.ids[p]) for p in joined}))}
        #: two adjacent symbols -> the rank of their join's score, and the join
        self.joins = {number[p[:k]] << 20 | number[p[k:]]: ranks[-s.get_score(self.ids[p])] << 20 | self.ids[p] for p in joined for k in range(1, len(p)) if p[:k] in number and p[k:] in number}
        self.table = Slots(len(self.joins))
        self.table.put(*(np.fromiter(x, np.int64, len(self.joins)) for x in (self.joins.keys(), self.joins.values())))
        self.letters = {i: c for c, i in self.characters.items()}
        codes = {ord(c): i for c, i in self.characters.items()}
        self.codes = np.full(max(codes, default=0) + 2, -1, np.int64)  # the last stands for what lies beyond
        self.codes[list(codes)] = list(codes.values())
        # character pairs that some piece holds, by the characters' places among those inside pieces (0: another one)
        self.inner = np.zeros(len(self.codes), np.int32)
        self.inner[[ord(c) for c in inner]] = np.arange(1, len(inner) + 1)
        self.pairs = np.zeros((len(inner) + 1, len(inner) + 1), bool)
        for p in joined:
            at = self.inner[[ord(c) for c in p]]
            self.pairs[at[:-1], at[1:]] = True
        self.plain = [p.replace(SPACE, " ") for p in self.pieces]
        self.names = pa.array([str(i) for i in range(len(self.pieces))])
        self.shown = pa.array([chr(self.bytes[i]) if self.bytes.get(i, 128) < 128 else p for i, p in enumerate(self.plain)])
        self.apart_ids = np.zeros(len(self.pieces), bool)  # need more than their own text to be decoded
        self.apart_ids[[*(i for i, b in self.bytes.items() if b > 127), *self.silent]] = True
        self._forget()

    def _forget(self) -> None:
        """What is remembered: hash -> place, and by place the start and number of its ids."""
        self.known, self.start, self.count, self.flat = Slots(1 << 14), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def agenda(self, text: str) -> list[int]:
        """The agenda holds rank and left place of each proposed join in one number; the smallest is the next to be made. A
        proposal is void if the symbols that are now at its place don't join at its rank."""
        symbols, joins = [self.characters.get(c, -1) for c in text], self.joins.get
        n = len(symbols)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(v >> 20) << 32 | i for i in range(n - 1) if (v := joins(symbols[i] << 20 | symbols[i + 1])) is not None]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            proposal = pop(heap)
            i = proposal & 0xFFFFFFFF
            j = after[i]
            if j < 0 or symbols[i] < 0 or (v := joins(symbols[i] << 20 | symbols[j])) is None or v >> 20 != proposal >> 32:
                continue
            symbols[i], symbols[j] = v & 0xFFFFF, -2
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (v := joins(symbols[i] << 20 | symbols[k])) is not None:
                    push(heap, (v >> 20) << 32 | i)
            k = before[i]
            if k >= 0 and (v := joins(symbols[k] << 20 | symbols[i])) is not None:
                push(heap, (v >> 20) << 32 | k)
        out: list[int] = []
        for i, x in enumerate(symbols):
            if 0 <= x < len(self.pieces):
                out.append(x)
            elif x != -2:
                out += self.apart(text[i])
        return out

    def apart(self, character: str) -> list[int]:
        """The ids of a character without a piece."""
        return [self.byte_ids[b] for b in character.encode()] if self.byte_ids else [self.unknown]

    def joined(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, join) of each pair of symbols; rank NEVER where they don't join."""
        rank, join = np.full(len(left), NEVER, np.int64), np.zeros(len(left), np.int64)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        v = self.table.get(left[at] << 20 | right[at])
        at, v = at[v >= 0], v[v >= 0]
        rank[at], join[at] = v >> 20, v & 0xFFFFF
        return rank, join

    def agendas(self, code: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters of stretches end to end and the stretches' sizes, none 0 -> ids end to end and their numbers.

        Column rank holds every proposed join; each round makes the best of each stretch, the leftmost of equal ones, and
        proposes its two neighbours anew. Stretches without proposals leave the columns."""
        symbol = self.codes[np.minimum(code, len(self.codes) - 1)]
        symbol = np.where(symbol < 0, -1 - code.astype(np.int64), symbol)
        own, n = np.arange(len(size)), len(size)
        last = np.cumsum(size) - 1
        rank, join = self.joined(symbol, np.append(symbol[1:], -1))
        rank[last] = NEVER
        done: list[tuple] = []
        while len(own):
            first = last - size + 1
            least = np.minimum.reduceat(rank, first)
            over = least == NEVER
            if over.any():
                gone = np.repeat(over, size)
                done.append((own[over], size[over], symbol[gone]))
                symbol, rank, join = symbol[~gone], rank[~gone], join[~gone]
                own, size, least = own[~over], size[~over], least[~over]
                if not len(own):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, size))
            text = np.repeat(np.arange(len(own)), size)[hit]
            i = hit[np.append(True, text[1:] != text[:-1])]
            symbol[i] = join[i]
            rest = np.ones(len(symbol), bool)
            rest[i + 1] = False
            symbol, rank, join = symbol[rest], rank[rest], join[rest]
            size = size - 1
            last = np.cumsum(size) - 1
            i = i - np.arange(len(i))
            rank[i] = NEVER
            to_right, to_left = i[i < last], i[i > last - size + 1]
            left = np.concatenate([to_right, to_left - 1])
            rank[left], join[left] = self.joined(symbol[left], symbol[left + 1])
        if not n:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        own, size, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        by = np.argsort(own)
        ids, size = _taken(ids, np.cumsum(size) - size, size, by), size[by]
        odd = np.flatnonzero((ids < 0) | (ids >= len(self.pieces)))
        if len(odd):  # characters without a piece
            spelled = [self.apart(chr(-1 - x) if x < 0 else self.letters[x]) for x in ids[odd].tolist()]
            more = np.ones(len(ids), np.int64)
            more[odd] = [len(x) for x in spelled]
            first = np.cumsum(size) - size
            ids = np.repeat(ids, more)
            ids[np.repeat(np.isin(np.arange(len(more)), odd), more)] = list(chain.from_iterable(spelled))
            size = np.add.reduceat(more, first)
        return ids.astype(np.int32), size

    def _stretches(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The characters of the texts end to end, a space before each; where the stretches start; in which texts."""
        code = np.frombuffer("".join(SPACE + x.replace(" ", SPACE) for x in texts).encode("utf-32-le"), np.uint32)
        size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        inner = self.inner[np.minimum(code, len(self.inner) - 1)]
        new = np.ones(len(code), bool)
        new[1:] = ~self.pairs[inner[:-1], inner[1:]]
        first = np.cumsum(size) - size
        new[first] = True
        start = np.flatnonzero(new)
        return code, start, np.searchsorted(first, start, "right") - 1

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, none empty, end to end, and their numbers."""
        code, start, text = self._stretches(texts)
        size = np.diff(np.append(start, len(code)))
        place = (np.arange(len(code)) - np.repeat(start, size)).astype(np.uint64)
        key = np.add.reduceat(mix(code.astype(np.uint64) | (place + np.uint64(1)) << np.uint64(32)), start)
        key = (mix(key + size.astype(np.uint64)) >> np.uint64(1)).astype(np.int64)
        if len(self.start) > MEMORY or len(self.flat) > MEMORY_IDS:
            self._forget()
        slot = self.known.get(key)
        new, where = np.unique(key[slot < 0], return_index=True)
        if len(new):
            at = np.flatnonzero(slot < 0)[where]
            own = size[at]
            joint = own <= JOINT
            ids, count = self.agendas(_taken(code, start, size, at[joint]), own[joint])
            alone = [self.agenda(code[a : a + n].tobytes().decode("utf-32-le")) for a, n in zip(start[at[~joint]].tolist(), own[~joint].tolist(), strict=True)]
            counts = np.concatenate([count, np.array([len(x) for x in alone], np.int64)])
            self.known.put(np.concatenate([new[joint], new[~joint]]), len(self.start) + np.arange(len(new)))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(counts) - counts])
            self.count = np.concatenate([self.count, counts])
            self.flat = np.concatenate([self.flat, ids, np.array(list(chain.from_iterable(alone)), np.int32)])
            slot = self.known.get(key)
        return _taken(self.flat, self.start, self.count, slot), np.bincount(text, self.count[slot], len(texts)).astype(np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts end to end, and their numbers."""
        some = [(i, part) for i, x in enumerate(texts) if x for part in (cut(x) if self.cuts else [x])]
        out, count, at = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64), 0
        while at < len(some):
            to, n = at + 1, len(some[at][1])
            while to < len(some) and n + len(some[to][1]) <= CHARACTERS:
                n += len(some[to][1])
                to += 1
            ids, own = self._encoded([x for _, x in some[at:to]])
            out.append(ids)
            np.add.at(count, [i for i, _ in some[at:to]], own)
            at = to
        return np.concatenate(out), count

    def encode_alone(self, text: str) -> list[int]:
        """Stretch by stretch by the heap, nothing remembered."""
        if not text:
            return []
        code, start, _ = self._stretches([text])
        return [i for a, b in zip(start, [*start[1:], len(code)], strict=True) for i in self.agenda(code[a:b].tobytes().decode("utf-32-le"))]

    def decoded(self, ids: np.ndarray, count: np.ndarray) -> list[str]:
        """The text of each run of ids."""
        upto = np.append(0, np.cumsum(count))
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), self.shown.take(pa.array(ids))), "").to_pylist()
        odd = np.diff(np.append(0, np.cumsum(self.apart_ids[ids]))[upto]) > 0
        first = self.pieces
        return [self.decode(ids[a:b].tolist()) if x else t[1:] if a < b and t[:1] == " " and first[ids[a]][:1] == SPACE else t for t, x, a, b in zip(texts, odd.tolist(), upto[:-1].tolist(), upto[1:].tolist(), strict=True)]

    def decode(self, ids: list[int]) -> str:
        if self.bytes.keys().isdisjoint(ids) and self.silent.isdisjoint(ids):
            text = "".join(map(self.plain.__getitem__, ids))
        else:
            out, run = [], bytearray()
            for i in [*ids, None]:
                if i in self.bytes:
                    run.append(self.bytes[i])
                    continue
                if run:
                    out.append(run.decode(errors="replace"))
                    run.clear()
                if i is not None and i not in self.silent:
                    out.append(self.plain[i])
            text = "".join(out)
        return text[1:] if text[:1] == " " and ids and self.pieces[ids[0]][:1] == SPACE else text


def cut(text: str) -> list[str]:
    """A text of over CHARACTERS characters in parts, cut at a space after another character. Each part but the first had a
    space before it, which encoding puts back."""
    out, at = [], 0
    while len(text) - at > CHARACTERS:
        to = at + CHARACTERS
        while (to := text.find(" ", to)) >= 0 and text[to - 1] in (" ", SPACE):
            to += 1
        if to < 0:
            break
        out.append(text[at:to])
        at = to + 1
    return [*out, text[at:]]


def _taken(flat: np.ndarray, start: np.ndarray, count: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of runs in flat, those at the places `at`, end to end."""
    n = count[at]
    return flat[np.repeat(start[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]


@lru_cache(2)
def encoder(model_file: str) -> Encoder:
    """One for each Python worker; its memory of stretches is bounded and lasts for a task."""
    return Encoder(model_file)


def _run(model_file: str, digests: bool):
    sha = lambda s: hashlib.sha256(s.encode(errors="replace")).hexdigest()

    def some(e: Encoder, batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [(x or b"").decode(errors="replace") for x in batch.column(1).to_pylist()]
        theirs = e.library.encode(texts, num_threads=1)
        ids, count = e.encode(texts)
        upto = np.append(0, np.cumsum(count))
        same = [len(x) == n and np.array_equal(np.fromiter(x, np.int32, n), ids[a : a + n]) for x, a, n in zip(theirs, upto[:-1].tolist(), count.tolist(), strict=True)]
        if not all(same):
            rows = [ids[a : a + n].tolist() if ok else e.encode_alone(x) for x, ok, a, n in zip(texts, same, upto[:-1].tolist(), count.tolist(), strict=True)]
            same = [x == y for x, y in zip(rows, theirs, strict=True)]
            ids, count = np.array(list(chain.from_iterable(rows)), np.int32), np.array([len(x) for x in rows], np.int64)
            upto = np.append(0, np.cumsum(count))
        back = e.decoded(ids, count)
        checked = [x and y == z for x, y, z in zip(same, back, e.library.decode(theirs), strict=True)]
        if digests:
            offsets = pa.array(upto, pa.int32())
            written = pc.binary_join(pa.ListArray.from_arrays(offsets, e.names.take(pa.array(ids))), ",")
            cols = [pa.array([sha(x) for x in written.to_pylist()], pa.string()), pa.array([sha(x) for x in back], pa.string())]
        else:
            cols = [pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(ids, pa.int32())), pa.array(back, pa.string())]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), *cols, pa.array(checked, pa.bool_())], names=["doc_id", "n_tokens", "ids_sha256" if digests else "ids", "decoded_sha256" if digests else "decoded", "checked"])

    def run(batches):
        e = encoder(model_file)
        e._forget()  # what an earlier task learned
        for whole in batches:
            size = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(whole.column(1)), 0).to_numpy(zero_copy_only=False)))
            at = 0
            while at < whole.num_rows:  # about CHARACTERS bytes, a row at least
                to = max(at + 1, int(np.searchsorted(size, size[at] + CHARACTERS, "right")) - 1)
                yield some(e, whole.slice(at, to - at))
                at = to
        e._forget()

    return lean(run)


def encoded(docs: DataFrame, model_file: str, digests: bool = False) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_tokens, ids, decoded, checked; with digests, the sha256 of the ids as decimal
    text joined by commas and of the decoded text instead. An empty table gives an empty one; extra columns are ignored."""
    docs = frugal(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    kinds = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return docs.mapInArrow(_run(model_file, digests), f"doc_id long, n_tokens long, {kinds}, checked boolean")
