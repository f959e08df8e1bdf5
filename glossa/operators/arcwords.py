"""Feature tables of arcs counted by what stands in them: a head's word, its modifier's word, both or neither, with a few tags.

A task makes one record of each different pair of words (or word, or none) and code of tags in a slice of text. Records are dealt
out by both words, so equal ones meet in one part, which counts different values of each template: features are never strings, and
a frequent head's modifiers are spread over all parts. Words travel as they are, sorted and compressed; nothing is hashed but a
record's part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.operators import flat
from glossa.operators.slots import CODES, SIZE

#: Bytes of a part's share of the documents, as they are stored.
PART = 8 << 20
WORDS = ("hw", "w")
#: Columns of codes in records with these words.
_COLUMNS = {("w",): ("t", "ht"), ("hw",): ("ht", "t"), ("hw", "w"): ("ht", "t", "dir")}
_TAG = "|".join(flat.TAGS)
#: How features with two words, side by side or with a tag between, are read back where words have colons: at the first place where
#: they can be parted, so that equal features are equal records.
_BESIDE, _BETWEEN = r"(?s)^(?P<a>[^:]*):(?P<b>.*)$", rf"(?s)^(?P<a>.*?):(?P<tag>{_TAG}):(?P<b>.*)$"


def _words(cols: list[str]) -> tuple[str, ...]:
    """The words of a template."""
    words = tuple(c for c in cols if c in WORDS)
    rest = set(cols) - set(words)
    known = words in (*_COLUMNS, ()) and (not words or rest <= set(_COLUMNS[words]))
    if len(words) == 2:
        known = known and (cols[cols.index("hw") + 1 : cols.index("w")] == ["ht"] and rest <= {"ht", "t"} or cols.index("w") - cols.index("hw") == 1 and rest <= {"dir"})
    if not known:
        raise ValueError(f"no records have the columns {cols}")
    return words


def _layout(table: list[tuple[str, list[str]]]) -> list[tuple[tuple[str, ...], tuple[str, ...], int]]:
    """Of each sort of records: its words, the columns that its codes hold, and its first code. Templates without words have sorts of
    their own."""
    sorts = [(k, c) for k, c in _COLUMNS.items() if any(_words(cols) == k for _, cols in table)]
    sorts += [((), tuple(cols)) for _, cols in table if not _words(cols)]
    sizes = [int(np.prod([len(CODES[c][0]) for c in cols])) for _, cols in sorts]
    return [(*s, int(x)) for s, x in zip(sorts, np.cumsum([0, *sizes[:-1]]), strict=True)]


def _coded(cols: tuple[str, ...], codes: dict[str, np.ndarray], many: int) -> np.ndarray:
    x, base = np.zeros(many, np.int64), 1
    for c in cols:
        x, base = x + codes[c] * base, base * len(CODES[c][0])
    return x


def _column(cols: tuple[str, ...], x: np.ndarray, name: str) -> np.ndarray:
    """A column's codes out of those of all columns."""
    for c in cols:
        if c == name:
            return x % len(CODES[c][0])
        x = x // len(CODES[c][0])
    raise KeyError(name)


def _hashed(words: pa.Array) -> np.ndarray:
    """A number for each word that is the same in every task."""
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].astype(np.uint64)
    ends = ends - ends[0]
    place = np.arange(len(data)) - np.repeat(ends[:-1], np.diff(ends))
    mixed = (data + np.uint64(1)) * (2 * place + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    sums = np.append(np.uint64(0), np.cumsum(mixed, dtype=np.uint64))
    return sums[ends[1:]] - sums[ends[:-1]]


def _different(x: np.ndarray) -> np.ndarray:
    """The different numbers, in order; faster than numpy's own, which hashes them."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _packed(words: pa.Array) -> bytes:
    """Words (which have no line feeds) as compressed lines, behind their length."""
    text = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words.cast(pa.string())), "\n")[0].as_buffer()
    return len(text).to_bytes(8, "little") + pa.compress(text, "zstd", asbytes=True)


def _unpacked(packed: bytes) -> pa.Array:
    size = int.from_bytes(packed[:8], "little")
    text = np.frombuffer(pa.decompress(packed[8:], size, "zstd", asbytes=True) + b"\n", np.uint8)
    ends = np.flatnonzero(text == 10)
    offsets = np.append(0, ends - np.arange(len(ends)))
    return pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(text[text != 10]))


def _read(words: pa.Array, a: np.ndarray, b: np.ndarray, x: np.ndarray) -> list[tuple[pa.Array, pa.Array, np.ndarray]]:
    """Records of two words of which one has a colon, as their features are read: those of words side by side, and with a tag between."""
    cols, tags = _COLUMNS["hw", "w"], pa.array(flat.TAGS).cast(words.type)
    code = {c: _column(cols, x, c) for c in cols}
    left, right, colon = words.take(pa.array(a)), words.take(pa.array(b)), pa.scalar(":", words.type)
    beside = pc.extract_regex(pc.binary_join_element_wise(left, right, colon), _BESIDE)
    between = pc.extract_regex(pc.binary_join_element_wise(left, tags.take(pa.array(code["ht"])), right, colon), _BETWEEN)
    tag = pc.index_in(between.field("tag"), tags).to_numpy().astype(np.int64)
    none = {"ht": np.full(len(x), len(flat.TAGS)), "t": np.zeros(len(x), np.int64), "dir": np.zeros(len(x), np.int64)}
    return [
        (beside.field("a"), beside.field("b"), _coded(cols, none | {"dir": code["dir"]}, len(x))),
        (between.field("a"), between.field("b"), _coded(cols, none | {"ht": tag, "t": code["t"]}, len(x))),
    ]


def records(t: flat.Tokens, layout: list) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Words in order, and the different records of some tokens: places of two words among them (an empty one for none), codes."""
    codes = {c: CODES[c][1](t) for c in {c for _, cols, _ in layout for c in cols}}
    found = t.form.dictionary_encode()
    words, word = found.dictionary, found.indices.to_numpy().astype(np.int64)
    many, low = len(words), t.parent >= 0
    head = np.where(low, word[t.parent], 0)
    colon = np.append(pc.match_substring(words, ":").to_numpy(zero_copy_only=False), False)
    out, read = [], []
    for kind, cols, first in layout:
        here = low if "hw" in kind else np.logical_and.reduce([np.ones(len(word), bool), *[codes[c] != CODES[c][0].index(None) for c in cols if not kind and None in CODES[c][0]]])
        a, b, x = (head if "hw" in kind else 0), (word if "w" in kind else 0), _coded(cols, codes, len(word))
        width, size = (many if "w" in kind else 1), int(np.prod([len(CODES[c][0]) for c in cols]))
        key = _different(((a * width + b) * size + x)[here]) if kind else np.flatnonzero(np.bincount(x[here]))
        a, b, x = (key // size // width if "hw" in kind else np.full(len(key), many)), (key // size % width if "w" in kind else np.full(len(key), many)), key % size
        odd = colon[a] & (len(kind) == 2) | colon[b] & (len(kind) == 2)
        if odd.any():
            read += [(p, q, y + first) for p, q, y in _read(words, a[odd], b[odd], x[odd])]
        out.append((a[~odd], b[~odd], x[~odd] + first))
    named = pa.concat_arrays([words, pa.array([""], words.type), *[v.cast(words.type) for p, q, _ in read for v in (p, q)]]).dictionary_encode()
    order = pc.sort_indices(named.dictionary).to_numpy().astype(np.int64)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    place = place[named.indices.to_numpy()]
    at = many + 1
    for p, _, y in read:
        out.append((np.arange(at, at + len(p)), np.arange(at + len(p), at + 2 * len(p)), y))
        at += 2 * len(p)
    a, b, x = (np.concatenate([v[i] for v in out]) for i in range(3))
    return named.dictionary.take(pa.array(order)), place[a], place[b], x


def distinct(a: np.ndarray, b: np.ndarray, x: np.ndarray, table: list[tuple[str, list[str]]], layout: list) -> list[int]:
    """Of each template: its different values in records of numbered words."""
    pair = a.astype(np.int64) * (int(b.max(initial=0)) + 1) + b
    sort = np.searchsorted([first for *_, first in layout], x, side="right") - 1
    of = {(words, cols if not words else ()): k for k, (words, cols, _) in enumerate(layout)}
    out, rows = [], [np.flatnonzero(sort == k) for k in range(len(layout))]
    for _, cols in table:
        words = _words(cols)
        k = of[words, tuple(cols) if not words else ()]
        has, code, key = layout[k][1], x[rows[k]] - layout[k][2], pair[rows[k]]
        here = np.ones(len(key), bool)
        if len(words) == 2 and "ht" not in cols:  # records that only stand for words with a tag between have no side
            here = _column(has, code, "dir") > 0
        for c in cols:
            if c in has:
                value = _column(has, code, c)
                if None in CODES[c][0]:
                    here = here & (value != CODES[c][0].index(None))
                key = key * len(CODES[c][0]) + value
        out.append(len(_different(key[here])))
    return out


def counted(docs: DataFrame, table: list[tuple[str, list[str]]]) -> DataFrame:
    """template, n, n_distinct: `templates.counted` of a table whose templates join words of an arc (hw, w) and tags."""
    layout = _layout(table)
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    spark = docs.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, size // PART + 1) if size < 1 << 60 else 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    lacks = sorted({c for _, cols in table for c in cols if c in CODES and None in CODES[c][0]})
    names = ["part", "a", "b", "x", "n"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for _, t in flat.slices(big, SIZE):
                if not len(t.at):
                    continue
                there = {c: CODES[c][1](t) != CODES[c][0].index(None) for c in lacks} | {"hw": t.parent >= 0}
                n = [int(np.logical_and.reduce([np.ones(len(t.at), bool), *[there[c] for c in cols if c in there]]).sum()) for _, cols in table]
                words, a, b, x = records(t, layout)
                own = _hashed(words)
                of = own[a] * np.uint64(0xD6E8FEB86659FD93) + own[b] * np.uint64(0x9E3779B97F4A7C15)
                none = (a == 0) & (b == 0)  # the empty word is the first
                of[none] = x[none].astype(np.uint64)
                part = ((of ^ (of >> np.uint64(32))) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part * len(words) + a)
                a, b, x, part = a[order], b[order], x[order], part[order]
                starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                rows = []
                for i, (s, e) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), len(part)], strict=True)):
                    rows.append((int(part[s]), _packed(words.take(pa.array(a[s:e]))), _packed(words.take(pa.array(b[s:e]))), x[s:e].astype("<u2").tobytes(), [] if i else n))
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())), strict=True)], names=names)

    def summed(key: tuple, group: pa.Table) -> pa.Table:
        coded = []
        for c in ("a", "b"):
            coded.append(pa.concat_arrays([_unpacked(v.as_py()) for v in group[c]]).dictionary_encode().indices.to_numpy())
        x = np.frombuffer(b"".join(group["x"].to_pylist()), "<u2").astype(np.int64)
        n = np.array([v for v in group["n"].to_pylist() if v], np.int64).reshape(-1, len(table)).sum(0)
        return pa.table([pa.array([name for name, _ in table]), pa.array(n), pa.array(distinct(*coded, x, table, layout), pa.int64())], names=["template", "n", "n_distinct"])

    found = docs.select("doc_id", "text").mapInArrow(each, "part int, a binary, b binary, x binary, n array<bigint>")
    sums = found.groupBy("part").applyInArrow(summed, "template string, n bigint, n_distinct bigint")
    return sums.groupBy("template").agg(F.sum("n").alias("n"), F.sum("n_distinct").alias("n_distinct")).where("n > 0")
