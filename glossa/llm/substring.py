"""Exact substring deduplication by fixed-block anchors.

1. Index and probes. Every document is cut into non-overlapping blocks of `window // 2` words, the anchors; every rolling
   window of as many words of every document probes them. Any repeat of `window` words holds a whole block of its one
   document, so a probe meets it in the other. Tasks collect the probes of about a million words, keep one for each
   distinct fingerprint (a document of the collection stands for the others, which are hits among themselves), and
   send them as packed, sorted numbers to ranges of the fingerprint. A passage in a third of all documents is one entry
   for each collection.
2. Extension. Round its hits a document's windows of full length are candidates. They are hashed whole (64 bits) and
   sent in the same packed way; in a range, all but the smallest doc_id of a hash have the window as a repeat. Neighbouring
   windows of one repeat form the maximal repeat, whose words are removed.

Defined cases: a null text has no words; texts of fewer than `window` words lose nothing; texts are taken whole; rows
that share a doc_id are one document in comparisons, so they lose nothing to each other; rows with a null doc_id
neither lose words nor take any from others; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.arrays import grams, slices, utf8, words
from glossa.llm.session import drop_folder, input_bytes, new_folder, ranges, release

WINDOW = 50
#: Bits of a document's place in a collection, and of a key that name its range.
PLACE, NAMES = 12, 20
#: Of folded keys: the first, their number, low bits of each.
_HEAD = struct.Struct("<QIB")
CHUNK_WORDS, CHUNK_DOCS = 1_000_000, 1 << PLACE
#: A collection's rows for a range, or (told) an answer that the collection gives itself; home: the collection's first document.
_PACKED = pa.schema([("range", pa.int32()), ("told", pa.bool_()), ("home", pa.int64()), ("docs", pa.binary()), ("keys", pa.binary()), ("more", pa.binary())])
_SQL = "range int, told boolean, home bigint, docs binary, keys binary, more binary"
#: An answer: keys and, for each, the place of its document among docs.
_ANSWER = pa.schema([("home", pa.int64()), ("docs", pa.binary()), ("keys", pa.binary()), ("places", pa.binary())])
_ANSWER_SQL = "home bigint, docs binary, keys binary, places binary"
_HITS = "doc_id bigint, found binary"


def print_bits(size: int) -> int:
    """Bits of an anchor's fingerprint for an input of so many bytes, so that one probe in some 16,000 meets an indexed block by
    chance, at every size: 16 more than the bits of the number of blocks. Chance hits cost time and change no result."""
    return min(52, max(36, (size // 128).bit_length() + 14))


def _bytes(x: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


def _folded(keys: np.ndarray) -> bytes:
    """Sorted numbers in two bits more than the logarithm of their mean step: low bits as they are, high ones as places of set bits."""
    n, x = len(keys), keys - keys[0]
    low = max(int(x[-1]).bit_length() - n.bit_length(), 0)
    high = (x >> np.uint64(low)).astype(np.int64) + np.arange(n)
    marks = np.zeros(int(high[-1]) + 1, np.uint8)
    marks[high] = 1
    lows = np.unpackbits(x.astype(">u8").view(np.uint8).reshape(n, 8), axis=1)[:, 64 - low :]
    return _HEAD.pack(int(keys[0]), n, low) + np.packbits(marks).tobytes() + np.packbits(lows.ravel()).tobytes()


def _unfolded(data: bytes) -> np.ndarray:
    first, n, low = _HEAD.unpack_from(data)
    tail = (n * low + 7) // 8
    body = np.frombuffer(data, np.uint8, offset=_HEAD.size)
    bits = np.zeros((n, 64), np.uint8)
    bits[:, 64 - low :] = np.unpackbits(body[len(body) - tail :], count=n * low).reshape(n, low)
    high = np.flatnonzero(np.unpackbits(body[: len(body) - tail])) - np.arange(n)
    return (high.astype(np.uint64) << np.uint64(low)) + np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64) + np.uint64(first)


class _Collection:
    """Numbers with their documents, until there are enough; then packed rows for the ranges."""

    def __init__(self, count: int):
        self.count = count
        self.clear()

    def clear(self) -> None:
        self.ids: list[int] = []
        self.keys: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.extra: list[np.ndarray] = []
        self.words = 0

    def full(self) -> bool:
        return self.words >= CHUNK_WORDS or len(self.ids) + 1 >= CHUNK_DOCS

    def rows(self, shift: int) -> Iterator[pa.RecordBatch]:
        """shift: bits of a key below those that name its range."""
        if not self.keys:
            return
        # Documents get their places in the order of their ids, so the first of equal keys is the smallest doc_id's.
        docs, rank = np.unique(np.array(self.ids, np.int64), return_inverse=True)
        keys, places = np.concatenate(self.keys), rank[np.concatenate(self.places)].astype(np.int64)
        order = np.lexsort((places, keys))
        keys, places = keys[order], places[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        group = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        last = places[np.append(at[1:], len(keys)) - 1]
        yield from self.local(docs, keys, places, group, places[at], last)
        keys, places = keys[at], places[at]
        of = ((keys >> np.uint64(shift)) * np.uint64(self.count) >> np.uint64(NAMES)).astype(np.int64)
        extra = np.unique(np.concatenate(self.extra)) if self.extra else np.zeros(0, np.uint64)
        extra_of = ((extra >> np.uint64(shift)) * np.uint64(self.count) >> np.uint64(NAMES)).astype(np.int64)
        out = []
        for r, a, z in zip(*_runs(of), strict=True):
            here, back = np.unique(places[a:z], return_inverse=True)
            x, y = np.searchsorted(extra_of, [r, r + 1])
            out.append((r, False, self.ids[0], _bytes(docs[here], "<i8"), *self.packed(keys[a:z], back, extra[x:y])))
            if len(out) == 16:
                yield _batch(out)
                out = []
        yield _batch(out)
        self.clear()

    def local(self, docs, keys, places, group, first, last) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError

    def packed(self, keys, places, extra) -> tuple[bytes, bytes]:
        raise NotImplementedError

    def answers(self, docs: np.ndarray, keys: np.ndarray, places: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Keys for the collection's own documents, a row that a range passes on."""
        if len(keys):
            yield _batch([(self.ids[0] % self.count, True, self.ids[0], _bytes(docs, "<i8"), _bytes(keys, "<u8"), _bytes(places, "<u2"))])


class _Probes(_Collection):
    def local(self, docs, keys, places, group, first, last):
        shared = (first != last)[group]
        return self.answers(docs, keys[shared], places[shared])

    def packed(self, keys, places, extra):
        return _folded(keys << np.uint64(PLACE) | places.astype(np.uint64)), _bytes(extra, "<u8")


class _Windows(_Collection):
    def local(self, docs, keys, places, group, first, last):
        later = places != first[group]
        return self.answers(docs, keys[later], places[later])

    def packed(self, keys, places, extra):
        return _bytes(keys, "<u8"), _bytes(places, "<u2")


def _runs(x: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Values, starts and ends of the runs of equal entries."""
    at = np.flatnonzero(np.diff(x, prepend=x[0] - 1)) if len(x) else np.zeros(0, int)
    return x[at].tolist(), at.tolist(), [*at[1:].tolist(), len(x)][: len(at)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_PACKED.types)], schema=_PACKED)


def _rows(t: pa.Table) -> tuple[list[tuple], list[tuple[int, np.ndarray, bytes, bytes]]]:
    """Answers that collections gave themselves, and collections' rows."""
    told, rows = [], []
    for own, home, docs, keys, more in zip(*[t[c].to_pylist() for c in ("told", "home", "docs", "keys", "more")], strict=True):
        told.append((home, docs, keys, more)) if own else rows.append((home, np.frombuffer(docs, "<i8"), keys, more))
    return told, rows


def _answer(home: int, docs: np.ndarray, keys: np.ndarray, places: np.ndarray) -> list[tuple]:
    return [(home, _bytes(docs, "<i8"), _bytes(keys, "<u8"), _bytes(places, "<u2"))] if len(keys) else []


def _answers(found: list[tuple]) -> pa.Table:
    return pa.table([pa.array([f[i] for f in found], t) for i, t in enumerate(_ANSWER.types)], schema=_ANSWER)


def _by_document(t: pa.Table) -> pa.Table:
    """Of one collection: the keys found for each document."""
    keys = np.concatenate([np.frombuffer(k, "<u8") for k in t["keys"].to_pylist()])
    ids = np.concatenate([np.frombuffer(d, "<i8")[np.frombuffer(p, "<u2")] for d, p in zip(t["docs"].to_pylist(), t["places"].to_pylist(), strict=True)])
    order = np.argsort(ids, kind="stable")
    keys, ids = keys[order], ids[order]
    docs, starts, ends = _runs(ids)
    return pa.table({"doc_id": pa.array(docs, pa.int64()), "found": pa.array([_bytes(keys[a:z], "<u8") for a, z in zip(starts, ends, strict=True)], pa.binary())})


def _members(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted array."""
    if not len(among):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(among, x), len(among) - 1)
    return among[at] == x


def _met(t: pa.Table) -> pa.Table:
    """Of one range: probes that an indexed block and another collection have."""
    told, rows = _rows(t)
    if rows:
        keys = [_unfolded(k) for _, _, k, _ in rows]
        prints = [k >> np.uint64(PLACE) for k in keys]
        blocks = np.unique(np.concatenate([np.frombuffer(m, "<u8") for *_, m in rows]))
        value, count = np.unique(np.concatenate(prints), return_counts=True)
        shared = value[(count > 1) & _members(value, blocks)]
        for (home, docs, _, _), k, p in zip(rows, keys, prints, strict=True):
            hit = _members(p, shared)
            told += _answer(home, docs, p[hit], k[hit] & np.uint64((1 << PLACE) - 1))
    return _answers(told)


def _later(t: pa.Table) -> pa.Table:
    """Of one range: windows of all documents but the smallest that has them."""
    told, rows = _rows(t)
    if rows:
        keys = [np.frombuffer(k, "<u8") for _, _, k, _ in rows]
        ids = [docs[np.frombuffer(m, "<u2")] for _, docs, _, m in rows]
        every, all_ids = np.concatenate(keys), np.concatenate(ids)
        order = np.lexsort((all_ids, every))
        at = np.ones(len(order), bool)
        at[1:] = every[order][1:] != every[order][:-1]
        value, least = every[order][at], all_ids[order][at]
        for (home, docs, _, m), k, d in zip(rows, keys, ids, strict=True):
            gone = least[np.searchsorted(value, k)] != d
            told += _answer(home, docs, k[gone], np.frombuffer(m, "<u2")[gone])
    return _answers(told)


def _spread(at: np.ndarray, before: int, after: int, n: int) -> np.ndarray:
    """Flags of the n places from `before` ahead of to `after` behind (exclusive) any of the places at."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.clip(at - before, 0, n), 1)
    np.add.at(edge, np.clip(at + after, 0, n), -1)
    return np.cumsum(edge)[:n] > 0


def _found(lists: list[bytes] | None) -> np.ndarray:
    return np.unique(np.concatenate([np.frombuffer(b, "<u8") for b in lists])) if lists else np.zeros(0, np.uint64)


def _sha(kept: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(kept)).hexdigest()


def _probed(docs: DataFrame, window: int, count: int, bits: int) -> DataFrame:
    block = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _Probes(count)
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), utf8(b.column("text"))
            for a, z in slices([len(t) for t in texts]):
                w = words(texts[a:z])
                prints = grams(w.hashes, block) >> np.uint64(64 - bits)
                long = np.repeat(w.counts >= window, w.counts)
                at = np.flatnonzero((w.room() >= block) & long)
                at = at[at < len(prints)]
                text, inside = w.text_of[at], at - w.first[w.text_of[at]]
                known = np.array([ids[i] is not None for i in range(a, z)])
                for x, y in slices(w.counts.tolist(), CHUNK_WORDS // 4):
                    if c.full() or len(c.ids) + (y - x) >= CHUNK_DOCS:
                        yield from c.rows(bits - NAMES)
                    for x2 in range(x, y, CHUNK_DOCS // 2):
                        y2 = min(y, x2 + CHUNK_DOCS // 2)
                        if len(c.ids) + (y2 - x2) >= CHUNK_DOCS:
                            yield from c.rows(bits - NAMES)
                        some = (text >= x2) & (text < y2) & known[text]
                        if some.any():
                            c.keys.append(prints[at[some]])
                            c.places.append(text[some] - x2 + len(c.ids))
                            c.extra.append(prints[at[some & (inside % block == 0)]])
                            c.words += int(some.sum())
                            c.ids += [i if i is not None else 0 for i in ids[a + x2 : a + y2]]
        yield from c.rows(bits - NAMES)

    return docs.mapInArrow(run, _SQL)


_STATE = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string()), ("starts", pa.binary())])
_STATE_SQL = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, text string, starts binary"


def _candidates(joined: DataFrame, window: int, bits: int) -> DataFrame:
    """Documents without a hit with their results; others with their text and the candidate windows' first words, bit-packed."""
    block = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for start in range(0, big.num_rows, 500):
                b = big.slice(start, 500)
                out = []
                for doc, text, lists in zip(*[b.column(c).to_pylist() for c in ("doc_id", "text", "found")], strict=True):
                    raw = (text or "").encode()
                    hits = _found(lists)
                    flags = np.zeros(0, bool)
                    if len(hits):
                        w = words([raw])
                        n = len(w.hashes)
                        at = np.flatnonzero(_members(grams(w.hashes, block) >> np.uint64(64 - bits), hits))
                        flags = _spread(at, window - block, 1, max(n - window + 1, 0)) if n >= window else flags
                    if flags.any():
                        out.append((doc, n, None, None, text, np.packbits(flags).tobytes()))
                    else:
                        ws = raw.split()
                        out.append((doc, len(ws), 0, _sha(ws), None, None))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(_STATE.types)], schema=_STATE)

    return joined.mapInArrow(run, _STATE_SQL)


def _window_hashes(text: str, starts: bytes, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    w = words([text.encode()])
    n = len(w.hashes)
    at = np.flatnonzero(np.unpackbits(np.frombuffer(starts, np.uint8), count=n - window + 1))
    return at, grams(w.hashes, window)[at], n


def _extended(state: DataFrame, window: int, count: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _Windows(count)
        for b in batches:
            for doc, text, starts in zip(*[b.column(k).to_pylist() for k in ("doc_id", "text", "starts")], strict=True):
                _, found, _ = _window_hashes(text, starts, window)
                if c.full():
                    yield from c.rows(64 - NAMES)
                c.keys.append(found)
                c.places.append(np.full(len(found), len(c.ids)))
                c.words += len(found)
                c.ids.append(doc)
        yield from c.rows(64 - NAMES)

    return state.mapInArrow(run, _SQL)


def _removed(joined: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text, starts, lists in zip(*[b.column(k).to_pylist() for k in ("doc_id", "text", "starts", "found")], strict=True):
                at, found, n = _window_hashes(text, starts, window)
                gone = _spread(at[_members(found, _found(lists))], 0, window, n)
                kept = [w for w, g in zip(text.encode().split(), gone.tolist(), strict=True) if not g]
                out.append((doc, n, int(gone.sum()), _sha(kept), " ".join([k.decode() for k in kept])))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return joined.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string")


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept: the kept words joined by blanks; kept is null where nothing is removed.

    A word goes if a window of `window` words that covers it also starts in a document with a smaller doc_id.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    count, bits = min(ranges(docs, 8 << 20), 1 << NAMES), print_bits(input_bytes(docs))
    state_at, hits_at = new_folder(spark, "substring-state"), new_folder(spark, "substring-hits")
    # A collection's answers come together again, and each document gets its own.
    by_document = lambda packed, of_range: packed.groupBy("range").applyInArrow(of_range, _ANSWER_SQL).groupBy("home").applyInArrow(_by_document, _HITS)
    hits = by_document(_probed(docs, window, count, bits), _met)
    hits.write.option("compression", "zstd").parquet(hits_at)
    release(spark)
    gathered = lambda h: h.groupBy("doc_id").agg(F.collect_list("found").alias("found"))
    hits = gathered(spark.read.schema(_HITS).parquet(hits_at))
    _candidates(docs.join(hits, "doc_id", "left").select("doc_id", "text", "found"), window, bits).write.option("compression", "zstd").parquet(state_at)
    drop_folder(spark, hits_at)
    release(spark)
    state = spark.read.schema(_STATE_SQL).parquet(state_at)
    open_ = state.where("starts is not null").select("doc_id", "text", "starts")
    gone = gathered(by_document(_extended(open_, window, count), _later))
    cleaned = _removed(open_.join(gone, "doc_id", "left"), window)
    return state.where("starts is null").select("doc_id", "n_words", "n_removed", "kept_sha256", F.lit(None).cast("string").alias("kept")).unionByName(cleaned)
