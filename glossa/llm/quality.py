"""Quality rules from a suffix array over each text's words.

The suffix array of the words is built by prefix doubling, many texts at once; the longest common prefixes of
neighbouring suffixes bound the intervals of suffixes that share a beginning. A word position's longest repeat is the
larger prefix it shares with its two neighbours. Repeats that no equal word to the left extends are maximal; the union
of their spans is the repeated part of the text.

Defined cases: null and empty texts have no words and are rejected (base_failed); texts are judged whole, one by one, so
copies of a text get equal verdicts; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.llm.arrays import Words, grams, mix, slices, words

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
BLANKS = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class RepeatLimits:
    """least: words of a repeat that counts; covered: largest share of words in repeats; longest: most words of one repeat."""

    least: int = 6
    covered: float = 0.30
    longest: int = 200


def suffix_ranks(w: Words) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The suffix array (suffixes of a text stand together) and for each doubled length the suffixes' ranks by that many words."""
    n = len(w.hashes)
    text = w.text_of
    order = np.lexsort((w.hashes, text))
    new = np.ones(n, bool)
    new[1:] = (text[order][1:] != text[order][:-1]) | (w.hashes[order][1:] != w.hashes[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels = [(1, rank.astype(np.int32))]
    end = np.repeat(w.first[1:], w.counts)
    width = 1
    while True:
        # Only suffixes that still share their rank are ordered again; a group's ranks start at its first place.
        size = np.diff(np.append(np.flatnonzero(new), n))
        tied = np.repeat(size > 1, size)
        if not tied.any():
            return order, levels
        places = np.flatnonzero(tied)
        some = order[places]
        later = some + width
        inside = later < end[some]
        second = np.where(inside, rank[np.minimum(later, n - 1)] + 1, 0)
        sub = np.lexsort((second, rank[some]))
        some, second, first = some[sub], second[sub], rank[some][sub]
        order[places] = some
        change = np.ones(len(some), bool)
        change[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        new[places] |= change
        rank[some] = places[np.maximum.accumulate(np.where(change, np.arange(len(some)), 0))]
        width *= 2
        levels.append((width, rank.astype(np.int32)))


def common_prefixes(w: Words, order: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """For each place of the suffix array but the first: words that its suffix shares with the one before (0 in another text)."""
    a, b = order[:-1], order[1:]
    pairs = np.flatnonzero(levels[0][1][a] == levels[0][1][b])
    a, b = a[pairs], b[pairs]
    end = np.repeat(w.first[1:], w.counts)
    stop, have = end[a], np.zeros(len(a), np.int64)
    for width, rank in reversed(levels):
        x, y = a + have, b + have
        inside = np.maximum(x, y) + width <= stop
        equal = inside & (rank[np.where(inside, x, 0)] == rank[np.where(inside, y, 0)])
        have += np.where(equal, width, 0)
    out = np.zeros(max(len(order) - 1, 0), np.int64)
    out[pairs] = have
    return out


def repeats(w: Words, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal repeats of at least `least` words: their first words' positions, their lengths, and words covered by any, per word."""
    n = len(w.hashes)
    longest = np.zeros(n, np.int64)
    if n > 1:
        order, levels = suffix_ranks(w)
        shared = common_prefixes(w, order, levels)
        np.maximum.at(longest, order[1:], shared)
        np.maximum.at(longest, order[:-1], shared)
    longest[longest < least] = 0
    extended = np.zeros(n, bool)  # by an equal word to the left
    extended[1:] = (longest[:-1] == longest[1:] + 1) & (longest[1:] > 0)
    at = np.flatnonzero((longest > 0) & ~extended)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + longest[at], -1)
    return at, longest[at], np.cumsum(edge)[:n] > 0


def _per_text(w: Words, flags: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[w.first[1:]] - total[w.first[:-1]]


def repeated_words(w: Words, n: int = 3) -> np.ndarray:
    """Per text: words in windows of n that occur twice or more in it, the first occurrence included."""
    whole = grams(w.hashes, n)
    inside = np.flatnonzero(w.room()[: len(whole)] >= n)
    keys = mix(whole[inside] + w.text_of[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, back, count = np.unique(keys, return_inverse=True, return_counts=True)
    at = inside[count[back] > 1]
    edge = np.zeros(len(w.hashes) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return _per_text(w, np.cumsum(edge)[:-1] > 0)


def measured(texts: list[str], limits: RepeatLimits) -> dict[str, list]:
    """The measures and verdicts of some texts."""
    w = words([t.encode() for t in texts])
    dup_lines, symbols, chars = [], [], []
    for t in texts:
        chars.append(len(t) - sum(map(t.count, BLANKS)))
        symbols.append(sum(map(t.count, SYMBOLS)))
        lines = [x for x in t.split("\n") if x.strip(BLANKS)]
        dup_lines.append(len(lines) - len(set(lines)))
    repeat_words = repeated_words(w)
    at, lengths, cover = repeats(w, limits.least)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, np.searchsorted(w.first, at, "right") - 1, lengths)
    covered = _per_text(w, cover)
    n = w.counts
    failed = (n < MIN_WORDS) | (100 * repeat_words > MAX_REPEAT_PERCENT * n)
    kept = ~failed & (covered <= limits.covered * n) & (longest <= limits.longest)
    return {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat_words, "n_covered": covered, "longest_repeat": longest, "base_failed": failed, "kept": kept}


MEASURES = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "n_covered": pa.int64(), "longest_repeat": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_()}


def judged(docs: DataFrame, limits: RepeatLimits = RepeatLimits(), text: str = "text") -> DataFrame:
    """docs with the measures of `MEASURES`; columns of docs named so are replaced."""
    kept = [c for c in docs.columns if c not in MEASURES]
    place = kept.index(text)
    chosen = docs.select(*[F.col(f"`{c}`") for c in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            texts = [t or "" for t in big.column(place).to_pylist()]
            for a, z in slices([4 * len(t) for t in texts]):
                found = measured(texts[a:z], limits)
                yield pa.RecordBatch.from_arrays([*big.slice(a, z - a).columns, *[pa.array(found[k], kind) for k, kind in MEASURES.items()]], names=[*kept, *MEASURES])

    schema = T.StructType(list(chosen.schema))
    for k, kind in MEASURES.items():
        schema = schema.add(k, T.BooleanType() if kind == pa.bool_() else T.LongType())
    return chosen.mapInArrow(run, schema)
