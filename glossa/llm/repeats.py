"""Exact repeats of bytes within and across documents, by suffix arrays of shards that hold all that could match.

1. Pieces. Of the 32-byte strings in a window of `window` bytes the one of the least hash is its anchor. Successive windows of one
   anchor are a piece. Equal windows have equal anchors, so a repeat lies within pieces of one anchor, however its surroundings
   differ. Equal pieces are settled by hash: tasks keep one of a collection of documents, ranges of anchors one of all.
2. Shards. Of anchors that have different pieces one of each is fetched, and a shard (a share of the anchors) sorts all suffixes of
   its pieces by external induced sorting (`suffixes`), on disk where it exceeds memory. Neighbours whose common prefix reaches
   `window` are one string; all its places but the first are removed.
3. Anchors with very many different pieces (a line that a third of all documents has, each time between other words) would make
   one shard large. They are found by counts; windows of their pieces are settled by hash (128 bits) like pieces, each for itself.

Defined cases: a null text is empty; texts are taken whole as UTF-8 bytes; places are ordered by (doc_id, start), and equal ones
(of rows that share a doc_id) don't remove each other; rows with a null doc_id neither lose bytes nor take any from others; an
empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm import suffixes
from glossa.llm.arrays import mix, slices, utf8
from glossa.llm.session import drop_folder, input_bytes, release, written

WINDOW, GRAM = 100, 32
#: Bytes hashed at once; pieces that a collection gathers; so many of one anchor in a collection are reported.
CHUNK, COLLECTION, MANY = 2 << 20, 1_000_000, 16
#: Kinds of rows: a piece; a run of windows that start earlier elsewhere; how many pieces of an anchor a collection has; a piece to be
#: sorted; a piece whose windows are settled one by one.
PIECE, GONE, COUNT, SORT, EACH = range(5)
_ROWS = pa.schema([("kind", pa.int32()), ("m", pa.int64()), ("s", pa.int64()), ("doc", pa.int64()), ("row", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])
_ROWS_SQL = "kind int, m bigint, s bigint, doc bigint, row bigint, start int, n int"
_MASK = np.uint64(0xFFFFFF)


@lru_cache(maxsize=2)
def _tables(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a polynomial hash: a number for each byte; powers of an odd factor, and of its inverse."""
    rng = np.random.Generator(np.random.PCG64(seed))
    table = rng.integers(1, 2**64, 256, dtype=np.uint64)
    odd = int(rng.integers(0, 2**63)) * 2 + 1
    powers = []
    for factor in (odd, pow(odd, -1, 1 << 64)):
        p = np.full(CHUNK + 2 * WINDOW + 2, factor, np.uint64)
        p[0] = 1
        powers.append(np.cumprod(p, dtype=np.uint64))
    return table, *powers


def _sums(data: np.ndarray, seed: int) -> np.ndarray:
    table, powers, _ = _tables(seed)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * powers[: len(data)], out=out[1:])
    return out


def _hash(sums: np.ndarray, first: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    return mix((sums[end] - sums[first]) * _tables(seed)[2][first])


def pieces(data: np.ndarray, ends: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Of texts that stand one after another (ends: where each ends): place and number of windows, anchor's and piece's hash of each piece."""
    wide = window - GRAM + 1
    for a in range(0, max(len(data) - window + 1, 0), CHUNK):
        part = data[a : a + CHUNK + window - 1]
        n = len(part) - window + 1
        sums = _sums(part, 1)
        at = np.arange(len(part) - GRAM + 1)
        grams = mix((sums[GRAM:] - sums[:-GRAM]) * _tables(1)[2][: len(at)])
        least, width = (grams & ~_MASK) | at.astype(np.uint64), 1
        while 2 * width <= wide:
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
        anchor = (np.minimum(least[:n], least[wide - width : wide - width + n]) & _MASK).astype(np.int64)
        room = np.full(n + 1, False)
        edge = np.concatenate([[0], ends - a])
        for x, z in zip(edge[:-1], edge[1:], strict=True):  # windows that lie in one text
            room[max(x, 0) : max(min(z - window + 1, n), 0)] = True
        valid = np.flatnonzero(room)
        if len(valid):
            cut = np.append(True, (np.diff(valid) != 1) | (np.diff(anchor[valid]) != 0))
            first = valid[cut]
            count = np.diff(np.append(np.flatnonzero(cut), len(valid)))
            yield first + a, count, grams[anchor[first]], _hash(sums, first, first + count + window - 1, 1)


def _merged(doc: np.ndarray, row: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows, touching ones of one document as one."""
    order = np.lexsort((start, row, doc))
    doc, row, start, n = doc[order], row[order], start[order], n[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (start[1:] > start[:-1] + n[:-1]))[: len(doc)]
    at = np.flatnonzero(new)
    return doc[at], row[at], start[at], (np.maximum.reduceat(start + n, at) - start[at]) if len(at) else n


def _batch(kind: int, doc, row, start, n, m=None, s=None) -> pa.RecordBatch:
    zero = np.zeros(len(doc), np.int64)
    cols = [np.full(len(doc), kind), zero if m is None else m.view(np.int64), zero if s is None else s.view(np.int64), doc, row, start, n]
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c).astype(t.to_pandas_dtype(), copy=False)) for c, t in zip(cols, _ROWS.types, strict=True)], schema=_ROWS)


class _Collection:
    """Pieces until there are enough; of equal ones the first goes on, the others are gone."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, m, s, doc, row, start, n) -> Iterator[pa.RecordBatch]:
        self.parts.append((m, s, doc, row, start, n))
        self.size += len(m)
        if self.size >= COLLECTION:
            yield from self.rows()

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        m, s, doc, row, start, n = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        self.parts, self.size = [], 0
        order = np.lexsort((start, doc, s, m))
        m, s, doc, row, start, n = (v[order] for v in (m, s, doc, row, start, n))
        new = np.append(True, (m[1:] != m[:-1]) | (s[1:] != s[:-1]))
        of, at = np.cumsum(new) - 1, np.flatnonzero(new)
        gone = (doc != doc[at][of]) | (start != start[at][of])
        if gone.any():
            yield _batch(GONE, *_merged(doc[gone], row[gone], start[gone], n[gone]))
        m, s, doc, row, start, n = (v[~gone] for v in (m, s, doc, row, start, n))
        anchors, counts = np.unique(m, return_counts=True)
        many = counts >= MANY
        if many.any():
            none = np.zeros(int(many.sum()), np.int64)
            yield _batch(COUNT, none, none, none, counts[many], anchors[many])
        for a in range(0, len(m), 1 << 16):
            z = a + (1 << 16)
            yield _batch(PIECE, doc[a:z], row[a:z], start[a:z], n[a:z], m[a:z], s[a:z])


def _collected(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _Collection()
        for b in batches:
            ids, rows, texts = b.column("doc_id").to_numpy(), b.column("row").to_numpy(), utf8(b.column("text"))
            for a, z in slices([len(t) for t in texts]):
                ends = np.cumsum([len(t) for t in texts[a:z]])
                begin = np.append(0, ends[:-1])
                for at, n, m, s in pieces(np.frombuffer(b"".join(texts[a:z]), np.uint8), ends, window):
                    of = np.searchsorted(ends, at, side="right")
                    yield from c.add(m, s, ids[a:z][of], rows[a:z][of], at - begin[of], n)
        yield from c.rows()

    return run


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over pieces sorted by anchor, piece, doc_id and start: later copies (GONE), and one of each where an anchor has several (SORT)."""
    last, first, kinds, held = (None, None), (0, 0), 0, []
    for b in batches:
        m, s, doc, row, start, n = (b.column(c).to_numpy() for c in ("m", "s", "doc", "row", "start", "n"))
        if not len(m):
            continue
        new_m = np.append(m[0] != last[0], m[1:] != m[:-1])
        new_s = new_m | np.append(s[0] != last[1], s[1:] != s[:-1])
        of = np.cumsum(new_s)
        firsts = [np.append(f, v[new_s])[of] for f, v in zip(first, (doc, start), strict=True)]
        gone = (doc != firsts[0]) | (start != firsts[1])
        group = np.cumsum(new_m)
        count = np.bincount(group, new_s, int(group[-1]) + 1)
        count[0] += kinds
        if gone.any():
            yield _batch(GONE, doc[gone], row[gone], start[gone], n[gone])
        sort = ~gone & (count[group] > 1)
        if count[0] > 1 and held:
            yield from held
            held = []
        if sort.any():
            yield _batch(SORT, doc[sort], row[sort], start[sort], n[sort], m[sort])
        wait = ~gone & (group == group[-1]) & (count[group[-1]] == 1)
        held = held if group[-1] == 0 else []
        if wait.any():
            held.append(_batch(SORT, doc[wait], row[wait], start[wait], n[wait], m[wait]))
        last, first, kinds = (m[-1], s[-1]), (firsts[0][-1], firsts[1][-1]), int(count[group[-1]])


_FETCHED = pa.schema([*_ROWS, ("piece", pa.binary())])


def _fetched(window: int):
    """Of documents with what is asked of them: pieces with their bytes (SORT), windows' hashes (PIECE, GONE)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _Collection()
        wider = lambda b, data=None: pa.RecordBatch.from_arrays([*b.columns, pa.nulls(b.num_rows, pa.binary()) if data is None else pa.array(data, pa.binary())], schema=_FETCHED)
        for big in batches:
            for k in range(0, big.num_rows, 256):
                b = big.slice(k, 256)
                out: list[tuple] = []
                for doc, row, text, asked in zip(*[b.column(x).to_pylist() for x in ("doc_id", "row", "text", "asked")], strict=True):
                    raw = text.encode()
                    for q in asked:
                        start, n = q["start"], q["n"]
                        data = raw[start : start + n + window - 1]
                        if q["kind"] == SORT:
                            out.append((doc, row, start, n, q["m"], data))
                            continue
                        x, at = np.frombuffer(data, np.uint8), np.arange(n)
                        m, s = (_hash(_sums(x, seed), at, at + window, seed) for seed in (1, 2))
                        full = lambda v: np.full(n, v, np.int64)  # noqa: B023, E731
                        yield from map(wider, c.add(m, s, full(doc), full(row), start + at, np.ones(n, np.int64)))
                if out:
                    doc, row, start, n, m, data = zip(*out, strict=True)
                    yield wider(_batch(SORT, np.array(doc), np.array(row), np.array(start), np.array(n), np.array(m)), data)
        yield from map(wider, c.rows())

    return run


def _repeated(window: int, memory: int):
    """Over the pieces of a shard: runs of windows that start earlier elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryFile() as text, tempfile.TemporaryFile() as about:
            size, end = 0, 0
            for b in batches:
                data = b.column("piece").to_pylist()
                x = np.frombuffer(b"".join([d + b"\0" for d in data]), np.uint8).astype(np.uint16) + np.uint16(2)
                lengths = np.array([len(d) + 1 for d in data])
                x[np.cumsum(lengths) - 1] = 1
                text.write(x.tobytes())
                starts = end + np.cumsum(lengths) - lengths
                about.write(np.stack([starts, *(b.column(c).to_numpy().astype(np.int64) for c in ("doc", "row", "start"))], axis=1).tobytes())
                size, end = size + len(data), end + len(x)
            if not size:
                return
            text.write(np.uint16(0).tobytes())
            for f in (text, about):
                f.flush()
            x, piece = np.memmap(text, np.uint16, "r"), np.memmap(about, np.int64, "r", shape=(size, 4))
            order, common = suffixes.by_induction(x if end > memory else np.array(x), memory)
            gone, starts = suffixes.scratch(end + 1, bool, memory), np.array(piece[:, 0])
            a = 0
            while a <= end:
                z = min(a + memory, end + 1)
                while z <= end and common[z] >= window:
                    z += 1
                long = np.append(common[a:z] >= window, False)
                long[0] = False
                one = np.flatnonzero(long[:-1] | long[1:])
                if len(one):
                    place, group = np.asarray(order[a:z])[one], np.cumsum(~long[one])
                    own = np.searchsorted(starts, place, side="right") - 1
                    doc, at = piece[own, 1], piece[own, 3] + place - starts[own]
                    by = np.lexsort((at, doc, group))
                    first = by[np.append(True, np.diff(group[by]) > 0)]
                    later = (doc != doc[first][group - 1]) | (at != at[first][group - 1])
                    # A common prefix that runs on into the next piece is none.
                    gone[place[later & (place + window < np.append(starts[1:], end)[own])]] = True
                a = z
            for a in range(0, end, memory):
                flags = gone[a : a + memory]
                edge = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
                if len(edge):
                    at, n = edge[::2] + a, edge[1::2] - edge[::2]
                    own = np.searchsorted(starts, at, side="right") - 1
                    yield _batch(GONE, piece[own, 1], piece[own, 2], piece[own, 3] + at - starts[own], n)

    return run


_CLEANED = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def _cleaned(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for k in range(0, big.num_rows, 256):
                b = big.slice(k, 256)
                out = []
                for doc, text, gone in zip(*[b.column(x).to_pylist() for x in ("doc_id", "text", "gone")], strict=True):
                    raw = (text or "").encode()
                    kept, removed, spans = raw, 0, 0
                    if gone:
                        edge = np.zeros(len(raw) + 1, np.int64)
                        for g in gone:
                            edge[g["start"]] += 1
                            edge[g["start"] + g["n"] + window - 1] -= 1
                        covered = np.cumsum(edge)[:-1] > 0
                        kept, removed = np.frombuffer(raw, np.uint8)[~covered].tobytes(), int(covered.sum())
                        spans = int((np.diff(covered.astype(np.int8), prepend=0) == 1).sum())
                    out.append((doc, len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), kept if removed else None))
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def deduplicated(docs: DataFrame, window: int = WINDOW, memory: int = suffixes.MEMORY, crowd: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes; null where nothing is removed).

    A byte goes if a string of `window` bytes that covers it also starts earlier: at a smaller doc_id, or in the same document before.
    memory: symbols that a task sorts in memory; crowd: different pieces from which an anchor's windows are settled one by one, if
    they are also one in 2^15 of all (so the anchors that tasks are told are at most some 2^16).
    """
    if window < 2 * GRAM:
        raise ValueError(f"window must be at least {2 * GRAM} bytes")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.xxhash64("text"))
    known = docs.where("doc_id is not null")
    size = input_bytes(docs)
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // (32 << 20) + 1)
    rows, rows_at = written(known.mapInArrow(_collected(window), _ROWS_SQL), "repeats-pieces")
    crowded = F.broadcast(rows.where(F.col("kind") == COUNT).groupBy("m").agg(F.sum("n").alias("all")).where(F.col("all") >= max(crowd, size // 32 >> 15)).select("m"))
    own = rows.where(F.col("kind") == PIECE)
    sort_by = ("m", "s", "doc", "start")
    settled = own.join(crowded, "m", "left_anti").select(*_ROWS.names).repartition(count, "m").sortWithinPartitions(*sort_by).mapInArrow(_settled, _ROWS_SQL)
    each = own.join(crowded, "m", "left_semi").withColumn("kind", F.lit(EACH)).select(*_ROWS.names)
    found, found_at = written(settled.unionByName(each).unionByName(rows.where(F.col("kind") == GONE)), "repeats-found")
    drop_folder(spark, rows_at)
    release(spark)
    asked = found.where(F.col("kind").isin(SORT, EACH)).groupBy(F.col("doc").alias("doc_id"), "row").agg(F.collect_list(F.struct("kind", "m", "start", "n")).alias("asked"))
    fetched, fetched_at = written(known.join(asked, ["doc_id", "row"]).select("doc_id", "row", "text", "asked").mapInArrow(_fetched(window), _ROWS_SQL + ", piece binary"), "repeats-fetched")
    release(spark)
    windows = fetched.where(F.col("kind") == PIECE).select(*_ROWS.names).repartition(count, "m").sortWithinPartitions(*sort_by).mapInArrow(_settled, _ROWS_SQL)
    sorted_ = fetched.where(F.col("kind") == SORT).select("m", "doc", "row", "start", "piece").repartition(count, "m").mapInArrow(_repeated(window, memory), _ROWS_SQL)
    gone = found.unionByName(fetched.select(*_ROWS.names)).unionByName(windows).unionByName(sorted_).where(F.col("kind") == GONE)
    listed, listed_at = written(gone.groupBy(F.col("doc").alias("doc_id"), "row").agg(F.collect_list(F.struct("start", "n")).alias("gone")), "repeats-gone")
    for path in (found_at, fetched_at):
        drop_folder(spark, path)
    release(spark)
    return docs.join(listed, ["doc_id", "row"], "left").select("doc_id", "text", "gone").mapInArrow(_cleaned(window), _CLEANED)
