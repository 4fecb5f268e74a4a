"""Text analysis: tokens, stop words, positions."""

from __future__ import annotations

import math
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# English stop words left out of an index by default.
STOP_WORDS = "a an and are as at be by can for from have if in is it may not of on or tbd that the this to us we when will with yet you your".split()


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


#: Runs of Han characters, and runs of other letters and digits.
HAN_RUNS = r"(\p{IsHan}+|[\p{L}\p{N}&&[^\p{IsHan}]]+)"


def cjk_tokens(text: Column) -> Column:
    """As tokens(), with runs of Han characters as overlapping pairs (a single one as itself)."""
    def pairs(t: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(2)))
        return F.when(t.rlike(r"^\p{IsHan}+$"), cut).otherwise(F.array(t))

    runs = F.regexp_extract_all(F.lower(text), F.lit(HAN_RUNS), F.lit(1))
    return F.flatten(F.transform(runs, pairs))


def without_stop_words(words: Column, stop: list[str] = STOP_WORDS, least: int = 2) -> Column:
    """Index side: stop words and tokens shorter than `least` go."""
    return F.filter(words, lambda t: ~t.isin(stop) & (F.length(t) >= least))


def query_tokens(text: Column, analyze=tokens) -> Column:
    """Query side: trimmed, blanks dropped, no stop filter."""
    return F.filter(F.transform(analyze(text), F.trim), lambda t: t != "")


#: Words that a dictionary may have; it travels with the tasks.
MOST_WORDS = 2_000_000


def word_costs(frequencies: Mapping[str, int]) -> dict[str, int]:
    """word -> its cost in a path, a thousand times the log of all frequencies over its own, rounded; "" has the cost of a
    character that is no word, as of frequency 1. Words that don't occur (frequency 0 or less) are left out."""
    if len(frequencies) > MOST_WORDS:
        raise ValueError(f"a dictionary has at most {MOST_WORDS} words, not {len(frequencies)}")
    kept = {w.lower(): f for w, f in frequencies.items() if w and f > 0}
    total = math.log(max(sum(kept.values()), 1))
    return {"": round(1000 * total)} | {w: round(1000 * (total - math.log(f))) for w, f in kept.items()}


class DictionaryTokens:
    """An analyzer that segments runs of Han characters by a dictionary of words with frequencies; other text is read as cjk
    does. The rows go through Arrow, where each distinct run of a batch is segmented once.

    Each run is a lattice of the dictionary's words and of single characters; the path of the least cost is found from its end,
    and of equal paths the one whose first word is longest. User words come with the frequencies that they should have."""

    def __init__(self, frequencies: Mapping[str, int]):
        self.costs = word_costs(frequencies)
        self.longest = max(map(len, self.costs), default=1)

    def path(self, run: str) -> list[str]:
        n, costs, lower = len(run), self.costs, run.lower()
        best, to = [0] * (n + 1), [n] * (n + 1)
        for i in range(n - 1, -1, -1):
            least = None
            for j in range(min(n, i + self.longest), i, -1):
                own = costs.get(lower[i:j], costs[""] if j == i + 1 else None)
                if own is not None and (least is None or own + best[j] < least):
                    least, to[i] = own + best[j], j
            best[i] = least
        out, i = [], 0
        while i < n:
            out.append(run[i : to[i]])
            i = to[i]
        return out

    def words(self, text: Column) -> Column:
        """Tokens with their case."""
        return self._udf()(text)

    def __call__(self, text: Column) -> Column:
        return self._udf()(F.lower(text))

    def _udf(self):
        path = self.path

        def cut_all(texts: pd.Series) -> pd.Series:
            import regex

            runs, known = regex.compile(r"\p{Han}+|[[\p{L}\p{N}]--\p{Han}]+", regex.V1), {}
            han = regex.compile(r"\p{Han}")

            def tokens_of(run: str) -> list[str]:
                if run not in known:
                    known[run] = path(run) if han.match(run) else [run]
                return known[run]

            return texts.map(lambda t: [x for run in runs.findall(t) for x in tokens_of(run)], na_action="ignore")

        return F.pandas_udf(cut_all, "array<string>")


#: cjk gives the same as words where no Han character occurs, but for words of Han and other letters.
ANALYZERS = {"words": tokens, "cjk": cjk_tokens}
