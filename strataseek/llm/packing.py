"""Packing of tokenized documents into sequences of a fixed size, by the sum of squares.

A document is its ids and one end id. What is longer than a sequence fills whole sequences first; the rest is placed online: of
the open sequences, it goes to the fill level (or to a new one) that leaves the sum over all levels of the squared number of
open sequences there least. An array by level holds these numbers; of equal choices the fullest level wins, and a new sequence
comes last. A sequence that is full is given out.

At the end, and whenever MOST_OPEN sequences are open, the open ones fill each other up: pieces of the emptiest are cut to fill
the fullest. What is left at the end is less than one sequence and is cut to lengths that are powers of two, which need no
padding. So nothing is padded, and a task holds at most MOST_OPEN sequences of ids besides its batch.

The packing runs where the documents are read: a partition is packed by itself and nothing is shuffled. A sequence's number
holds its partition's, so numbers are unique, and a partition that is read again in the same order gives the same pieces.

The tokenizer sees each distinct stretch of CHARACTERS of text once: a text may be cut before any space that a visible character
follows, since no token reaches from a visible character into a space.

Null texts are empty and have the end id alone. Rows that share a doc_id are packed each. An empty table gives no pieces; other
columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, lean

SIZE, END = 2048, 1
#: Open sequences that a task holds; more are first filled up from one another.
MOST_OPEN = 4096
#: Bytes of text encoded at a time, or one text.
CHARACTERS = 16 << 20
#: Sequences of a partition are numbered below this.
LOCAL = 1 << 33
#: How byte-level tokenizers split text: contractions, letters, numbers, other visible characters, white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_MARK = "\0"
#: A space that a visible character follows.
_BEFORE = re.compile(r" (?=\S)")
_ODD = re.compile(r" (?:\s|$)")


class Encoder:
    """A byte-level BPE tokenizer that encodes each distinct stretch of some texts once.

    Stretches are joined, encoded at once by tiktoken with the tokenizer's own vocabulary, and told apart by the lengths of the
    ids' bytes. Ones with characters outside SETTLED, on whose classes the libraries' Unicode tables could differ, and texts with
    special strings are encoded by the tokenizers library, as are all where the vocabulary isn't in merge order."""

    #: A space, a visible character, and what else has a settled class: Latin, Greek, Cyrillic, punctuation, kana, Han.
    SETTLED = r"^ [^\s\x{1c}-\x{1f}\x{85}\x{a0}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}\x{3000}][\x{0}-\x{52f}\x{2010}-\x{2027}\x{2030}-\x{205e}\x{20a0}-\x{20ac}\x{3040}-\x{30ff}\x{4e00}-\x{9fa5}]*$"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.fast = _by_ranks(path)
        if self.fast:
            self.widths = np.array([len(self.fast.decode_single_token_bytes(i)) for i in range(self.fast.n_vocab)], np.int64)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _joined(self, stretches: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids, ids end to end) of settled stretches."""
        size = pc.binary_length(stretches.cast(pa.large_binary())).to_numpy()
        text = stretches.buffers()[2].to_pybytes()[: int(size.sum())].decode()  # their bytes end to end: they were just made
        ids = np.asarray(self.fast.encode_to_numpy(text), np.uint32)
        upto = np.searchsorted(np.cumsum(self.widths[ids]), np.cumsum(size)) + 1
        return np.diff(upto, prepend=0), ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        odd = {i for i, t in enumerate(texts) if _MARK in t or any(s in t for s in self.special)}
        marked = ["" if i in odd else _BEFORE.sub(_MARK + " ", t) if _ODD.search(t) else t.replace(" ", _MARK + " ") for i, t in enumerate(texts)]
        lists = pc.split_pattern(pa.array(marked, pa.large_string()), _MARK)
        coded = lists.flatten().dictionary_encode()
        distinct, start = coded.dictionary, np.zeros(len(coded.dictionary), np.int64)
        count, parts, upto = start.copy(), [np.zeros(0, np.uint32)], 0
        settled = pc.match_substring_regex(distinct, self.SETTLED).to_numpy(zero_copy_only=False) if self.fast else np.zeros(len(distinct), bool)
        if settled.any():
            n, ids = self._joined(distinct.filter(pa.array(settled)))
            count[settled], start[settled], upto = n, np.cumsum(n) - n, len(ids)
            parts.append(ids)
        rest = np.flatnonzero(~settled)
        for i, t in zip(rest.tolist(), distinct.take(pa.array(rest)).to_pylist(), strict=True):
            parts.append(self.whole(t))
            count[i], start[i] = len(parts[-1]), upto
            upto += len(parts[-1])
        place = coded.indices.to_numpy()
        n = count[place]
        ends = np.append(0, np.cumsum(n))
        flat = np.concatenate(parts)[np.repeat(start[place] - ends[:-1], n) + np.arange(ends[-1])]
        ends = ends[lists.offsets.to_numpy()]
        return [self.whole(texts[i]) if i in odd else flat[a:b] for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))]


def _by_ranks(path: str):
    """A tiktoken encoding of the tokenizer's vocabulary; None if merges aren't in the order of ids, or text is split another
    way than by this library's byte-level pattern."""
    import json
    from pathlib import Path

    import tiktoken

    told = json.loads(Path(path).read_text(encoding="utf-8"))
    model, split = told["model"], told["pre_tokenizer"] or {}
    if model["type"] != "BPE" or told["normalizer"] or told["post_processor"] or model.get("ignore_merges") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return None
    joins = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    if any(a >= b for a, b in zip(joins, joins[1:], strict=False)):
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes shown as themselves; the rest follow 255
    letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t["content"] for t in told["added_tokens"]}
    ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    return tiktoken.Encoding("byte level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path)


class Packer:
    """Places documents; full sequences are lists of pieces (doc, start, ids), in order, in `full`."""

    def __init__(self, size: int = SIZE, most_open: int = MOST_OPEN):
        self.size, self.most_open = size, most_open
        self.levels = np.zeros(size + 1, np.int64)  # open sequences by fill level
        self.at: list[list[list[tuple]]] = [[] for _ in range(size + 1)]
        self.open, self.full = 0, []

    def choose(self, n: int) -> int:
        """The fill level for n ids, 0 for a new sequence: the least sum of squares afterwards."""
        levels = self.levels
        to = levels[n + 1 : self.size + 1].copy()  # what stands where levels 1 to size - n would go
        here = levels[1 : self.size - n + 1]
        change = 2 * (to - here) + 2
        change[-1:] = 1 - 2 * here[-1:]  # full: it leaves the levels
        change[here == 0] = np.iinfo(np.int64).max
        new = 2 * int(levels[n]) + 1
        if not len(change):
            return 0
        best = len(change) - 1 - int(np.argmin(change[::-1]))
        return best + 1 if change[best] <= new else 0

    def add(self, doc, ids: np.ndarray) -> None:
        heads = len(ids) // self.size * self.size
        self.full += [[(doc, s, ids[s : s + self.size])] for s in range(0, heads, self.size)]
        if heads < len(ids):
            self._place([(doc, heads, ids[heads:])], len(ids) - heads)
            if self.open > self.most_open:
                self._place(*self._filled_up())

    def _place(self, pieces: list[tuple], n: int) -> None:
        if not n:
            return
        level = self.choose(n)
        window = []
        if level:
            window = self.at[level].pop()
            self.levels[level] -= 1
            self.open -= 1
        window += pieces
        if level + n == self.size:
            self.full.append(window)
        else:
            self.at[level + n].append(window)
            self.levels[level + n] += 1
            self.open += 1

    def _filled_up(self) -> tuple[list[tuple], int]:
        """Empties all levels: the fullest are filled with what the emptiest hold. -> what is left, less than a sequence."""
        rest = [(n, w) for n in range(self.size - 1, 0, -1) for w in self.at[n]]
        self.levels[:], self.at, self.open = 0, [[] for _ in range(self.size + 1)], 0
        first, last = 0, len(rest) - 1
        filled = rest[0][0] if rest else 0
        while first < last:
            gap, (doc, start, ids) = self.size - filled, rest[last][1].pop()
            if len(ids) > gap:
                rest[last][1].append((doc, start, ids[:-gap]))
                start, ids = start + len(ids) - gap, ids[-gap:]
            rest[first][1].append((doc, start, ids))
            filled += len(ids)
            if not rest[last][1]:
                last -= 1
            if filled == self.size:
                self.full.append(rest[first][1])
                first += 1
                filled = sum(len(ids) for _, _, ids in rest[first][1]) if first <= last else 0
        left = rest[first][1] if first <= last else []
        return left, sum(len(ids) for _, _, ids in left)

    def finish(self) -> None:
        """Closes all open sequences; the last ones have lengths that are powers of two."""
        pieces, n = self._filled_up()
        while n:
            room = 1 << n.bit_length() - 1
            n -= room
            window = []
            while room:
                doc, start, ids = pieces.pop(0)
                window.append((doc, start, ids[:room]))
                if len(ids) > room:
                    pieces.insert(0, (doc, start + room, ids[room:]))
                room -= len(window[-1][2])
            self.full.append(window)


SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_ARROW = pa.schema([*((n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")), ("ids", pa.binary())])


def _run(path: str, size: int, end: int, most_open: int):
    def given_out(packer: Packer, number: int) -> pa.RecordBatch:
        out: list[tuple] = []
        for k, window in enumerate(packer.full, number):
            offset = 0
            for (doc, total), start, ids in window:
                out.append((doc, start, len(ids), total, k, offset, ids.astype("<u4").tobytes()))
                offset += len(ids)
        cols = zip(*out, strict=True) if out else [[]] * len(_ARROW)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW, strict=True)], schema=_ARROW)

    def gathered(batches):
        """(ids, texts) of about CHARACTERS bytes."""
        docs, texts, n = [], [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if texts and n + len(text or b"") > CHARACTERS:
                    yield docs, texts
                    docs, texts, n = [], [], 0
                docs.append(doc)
                texts.append((text or b"").decode(errors="replace"))
                n += len(text or b"")
        yield docs, texts

    def run(batches):
        e, packer, number = encoder(path), Packer(size, most_open), TaskContext.get().partitionId() * LOCAL
        for docs, texts in gathered(batches):
            for doc, ids in zip(docs, e.encode(texts), strict=True):
                packer.add((doc, len(ids) + 1), np.append(ids, np.uint32(end)))
            yield given_out(packer, number)
            number += len(packer.full)
            packer.full = []
        packer.finish()
        yield given_out(packer, number)

    return lean(run)


def packed(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END, most_open: int = MOST_OPEN) -> DataFrame:
    """docs (doc_id, text, ...) -> a row for each piece: doc_id, start (the document's ids before it), length, doc_tokens (the
    document's ids, the end included), sequence_id, offset in the sequence, ids as little-endian unsigned 32-bit numbers."""
    docs = frugal(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return docs.mapInArrow(_run(tokenizer, size, end, most_open), SCHEMA)
