"""Document fingerprints by a randomised edit embedding.

All texts share one random walk over characters: at step j the walk emits the character it stands on, and a random bit
for (step, character) says whether it moves on. Texts at small edit distance fall back into step after an edit, so
their emitted strings have a small Hamming distance. The walk is taken once per character: a table has, for each
character class and step, how many steps the walk stays. A fingerprint samples SLOTS steps of the emitted string, the
same steps for all texts of about one length (each slot takes the step with the smallest hash of those below the
walk's length), and keeps 8 bits of the characters there.

A walk that falls out of step early stays out for long, and a shift by a sentence is never made up. So the bands that find near
copies take WALKS short walks of a text, which start where the hash of a GRAM-character string is least (a place that an edit
elsewhere doesn't move) and go over STRETCH characters. A band samples BAND_SLOTS slots of different walks, so texts that
share one passage, and with it a few walks, seldom share a band. Candidates are verified by the edit distance of the whole texts
(`near_classes`). Of the pairs of sf0.01 with an edit similarity of 0.8 or more at least 0.9 share a band (test_fingerprint).

Defined cases: a null text counts as empty; empty texts share one fingerprint; texts are walked whole; equal texts have
equal fingerprints; repeated rows get equal rows; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.llm.arrays import mix
from glossa.llm.neardup import grouped, keyed_texts
from glossa.llm.session import ranges, written

SLOTS = 128
#: Walks of the bands, the strings at whose least hash they start, and the characters that they go over.
WALKS, GRAM, STRETCH = 16, 12, 96
#: Bands of sampled slots, and the edit similarity that links two texts.
BANDS, BAND_SLOTS, SIMILARITY = 48, 4, 0.8
CELLS = 16
CLASSES, PERIOD = 64, 1024
MASK = PERIOD - 1


def _stays() -> np.ndarray:
    """stays[step mod PERIOD, class]: steps until the walk moves on (1 if it does at once), from random bits."""
    bits = np.random.Generator(np.random.PCG64(7)).integers(0, 2, (PERIOD, CLASSES), dtype=np.uint8)
    out = np.zeros((PERIOD, CLASSES), np.int32)
    ahead = np.full(CLASSES, 1, np.int32)
    for step in [*range(PERIOD - 1, -1, -1)] * 2:
        ahead = np.where(bits[step] == 1, 1, ahead + 1).astype(np.int32)
        out[step] = ahead
    return out


def _records(slots: int) -> list[np.ndarray]:
    """For each slot the steps at which a stream of random hashes reaches a new smallest value, as far as 2**40."""
    rng, out = np.random.Generator(np.random.PCG64(11)), []
    for _ in range(slots):
        steps, at = [0], 1.0
        while at < 2**40:
            at = np.floor(at / (1 - rng.random())) + 1
            steps.append(int(at) - 1)
        out.append(np.array(steps, np.int64))
    return out


_STAYS, _RECORDS = [row.tobytes() for row in _stays().astype(np.uint8).T], _records(SLOTS)
_WIDTH = max(map(len, _RECORDS))
_TABLE = np.full((SLOTS, _WIDTH), 1 << 62, np.int64)
for _i, _r in enumerate(_RECORDS):
    _TABLE[_i, : len(_r)] = _r


_DRAW = np.random.Generator(np.random.PCG64(100))
#: The walk and the slot of each of a band's samples; a band's walks differ.
_BAND_WALKS = np.stack([_DRAW.choice(WALKS, BAND_SLOTS, replace=False) for _ in range(BANDS)])
_BAND_PLACES = _DRAW.integers(0, SLOTS, (BANDS, BAND_SLOTS))
_STARTS = _DRAW.integers(1, 2**63, WALKS, dtype=np.uint64)


def classes_of(text: np.ndarray) -> np.ndarray:
    return ((text * np.uint32(2654435761)) >> np.uint32(26)).astype(np.uint8)


def walk(text: np.ndarray, start: int = 0) -> np.ndarray:
    """The steps at which the walk reaches each character of the text (code points) and, last, its end, from a first step on."""
    classes = classes_of(text).tobytes()
    at = start
    return np.array(array("q", [at, *[at := at + stays[at & MASK] for stays in map(_STAYS.__getitem__, classes)]]))


def _sample(text: np.ndarray, steps: np.ndarray) -> bytes:
    """The fingerprint of a text whose walk reached its characters at these steps."""
    if not len(text):
        return bytes(SLOTS)
    taken = _TABLE[np.arange(SLOTS), (_TABLE < int(steps[-1])).sum(1) - 1]
    at = np.searchsorted(steps, taken, "right") - 1
    symbols = np.zeros(SLOTS, np.uint64)
    for k in range(3):  # a character and the two after it, so that common letters alone don't make texts alike
        symbols = symbols * np.uint64(0x110001) + np.where(at + k < len(text), text[np.minimum(at + k, len(text) - 1)] + np.uint64(1), 0).astype(np.uint64)
    return (mix(symbols) >> np.uint64(56)).astype(np.uint8).tobytes()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def fingerprints(texts: list[str]) -> list[bytes]:
    return [_sample(p, walk(p)) for p in map(code_points, texts)]


def likeness(a: bytes, b: bytes) -> float:
    """Share of slots in which two fingerprints agree."""
    return float((np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).mean())


def band_keys(text: np.ndarray) -> np.ndarray:
    """BANDS 64-bit keys of a text (code points), from slots of its short walks."""
    grams = np.zeros(max(len(text) - GRAM + 1, 1), np.uint64)
    for k in range(min(GRAM, len(text))):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + text[k : k + len(grams)].astype(np.uint64)
    starts = [int(mix(grams + seed).argmin()) for seed in _STARTS]
    parts = [text[a : a + STRETCH] for a in starts]
    slots = np.stack([np.frombuffer(_sample(p, walk(p)), np.uint8) for p in parts])[_BAND_WALKS, _BAND_PLACES].astype(np.uint64)
    out = np.arange(BANDS, dtype=np.uint64)
    for k in range(BAND_SLOTS):
        out = mix(out * np.uint64(256) + slots[:, k] + np.uint64(1))
    return out


def edit_distance(a: str, b: str, most: int | None = None) -> int:
    """The least number of inserted, deleted and replaced characters, by bit vectors over the shorter text; any number above
    `most` if it is more, found as soon as the rest of the longer text can't make up for it."""
    if len(a) > len(b):
        a, b = b, a
    start = len(commonprefix([a, b]))
    a, b = a[start:], b[start:]
    end = len(commonprefix([a[::-1], b[::-1]]))
    a, b = a[: len(a) - end], b[: len(b) - end]
    if not a:
        return len(b)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)  # vertical steps of +1 and -1 of the current column
    for left_over, c in zip(range(len(b) - 1, -1, -1), b, strict=True):
        if most is not None and distance - left_over - 1 > most:
            return distance
        match = places.get(c, 0)
        zero = (((match & up) + up) ^ up) | match | down
        right, left = down | (full & ~(zero | up)), up & zero  # horizontal steps
        if right & top:
            distance += 1
        elif left & top:
            distance -= 1
        right = (right << 1 | 1) & full
        left = (left << 1) & full
        up, down = left | (full & ~(zero | right)), right & zero
    return distance


def edit_similarity(a: str, b: str, least: float = 0.0) -> float:
    """1 less the edit distance by the longer length; 0 if it is below `least`; 1 for two empty texts."""
    longer = max(len(a), len(b))
    if a == b:
        return 1.0
    if min(len(a), len(b)) < least * longer:
        return 0.0
    found = 1 - edit_distance(a, b, int((1 - least) * longer) + 1) / longer
    return found if found >= least else 0.0


def edited(text: str, other: str) -> str:
    """text with its last half (rounded down) replaced by as many code points from the start of other, or all that it has."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def fingerprinted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with fingerprint (hex string) of each whole text; a column of that name is replaced. No shuffle."""
    kept = [c for c in docs.columns if c != "fingerprint"]
    place, chosen = kept.index(text), docs.select(*[F.col(f"`{c}`") for c in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for start in range(0, big.num_rows, 2000):
                b = big.slice(start, 2000)
                found = fingerprints([t or "" for t in b.column(place).to_pylist()])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([f.hex() for f in found], pa.string())], names=[*kept, "fingerprint"])

    return chosen.mapInArrow(run, T.StructType([*chosen.schema, T.StructField("fingerprint", T.StringType())]))


RESULT = T.StructType([T.StructField(n, t) for n, t in (("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()), ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType()))])
_KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


class _Comparer:
    """Results of a text and the text after it; the last walk is kept, as the next row asks for it again."""

    def __init__(self):
        self.last: tuple | None = None

    def walked(self, text: str) -> tuple:
        if self.last is None or self.last[0] is not text:
            points = code_points(text)
            steps = walk(points)
            self.last = (text, points, steps, _sample(points, steps))
        return self.last[1:]

    def row(self, text: str, after: str) -> tuple:
        points, steps, own = self.walked(text)
        next_points, _, next_own = self.walked(after)
        half = len(points) // 2
        tail, split = next_points[:half], len(points) - half
        # Up to the split the edited text's walk is the text's own.
        new = _sample(np.concatenate([points[:split], tail]), np.concatenate([steps[:split], walk(tail, int(steps[split]))]))
        digest = hashlib.sha256(edited(text, after).encode()).hexdigest()
        return len(points), digest, own.hex(), new.hex(), likeness(own, new), likeness(own, next_own)


def compared(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Each document is compared with the next: that of the next smaller doc_id, after the last one the first; rows of equal
    doc_id stand in the order of their texts' hashes, null doc_ids last. A single document is its own next.
    Rows are sorted by ranges of doc_id, whose number follows the input's size. A range's last row meets its next in a
    second step that reads one first and one last row a range.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text").asc()]
    rows = docs.select("doc_id", "text").repartitionByRange(ranges(docs, 32 << 20), *order).sortWithinPartitions(*order, "text")
    names = ["doc_id", *RESULT.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compare, before, first, id_type = _Comparer(), None, None, None
        part = TaskContext.get().partitionId()

        def batch(out: list[tuple], edge: tuple | None) -> pa.RecordBatch:
            columns = [pa.array([r[j] for r in out], t) for j, t in enumerate([id_type, *_KINDS])]
            edges = [pa.array([v] * len(out), t) for v, t in zip(edge or (None, None, None), (pa.int32(), pa.string(), pa.string()), strict=True)]
            return pa.RecordBatch.from_arrays([*columns, *edges], names=[*names, "part", "first_text", "last_text"])

        for big in batches:
            id_type = big.schema.field("doc_id").type
            for start in range(0, big.num_rows, 1500):
                b, out = big.slice(start, 1500), []
                for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    text = text or ""
                    if before is None:
                        first = text
                    else:
                        out.append((before[0], *compare.row(before[1], text)))
                    before = (doc, text)
                if out:
                    yield batch(out, None)
        if before is not None:
            yield batch([(before[0], *[None] * len(_KINDS))], (part, first, before[1]))

    schema = T.StructType([T.StructField("doc_id", kind), *RESULT, T.StructField("part", T.IntegerType()), T.StructField("first_text", T.StringType()), T.StructField("last_text", T.StringType())])
    done, _ = written(rows.mapInArrow(run, schema), "fingerprints")
    edges = done.where("part is not null")
    # Which range follows which: only the ranges' numbers meet.
    parts = edges.select("part").withColumn("then", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.lit(-1)))
    head = edges.agg(F.min("part").alias("head"))
    follows = parts.crossJoin(F.broadcast(head)).select("part", F.when(F.col("then") < 0, F.col("head")).otherwise(F.col("then")).alias("then"))
    ends = edges.select("part", "doc_id", "last_text").join(follows, "part").join(edges.select(F.col("part").alias("then"), F.col("first_text").alias("after")), "then").select("doc_id", "last_text", "after")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            compare = _Comparer()
            out = [compare.row(x, y) for x, y in zip(b.column("last_text").to_pylist(), b.column("after").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array([r[j] for r in out], t) for j, t in enumerate(_KINDS)]], names=names)

    last = ends.mapInArrow(finish, T.StructType([T.StructField("doc_id", kind), *RESULT]))
    return done.where("part is null").select(*names).unionByName(last)


def _described(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, k1, k2) with the bucket keys of their fingerprints."""
    names = ["doc_id", "k1", "k2", *[f"b{k}" for k in range(BANDS)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for start in range(0, big.num_rows, 1500):
                b = big.slice(start, 1500)
                keys = np.stack([band_keys(code_points(t or "")) for t in b.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names[:3]], *map(pa.array, np.ascontiguousarray(keys.T).view(np.int64))], names=names)

    return docs.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def near_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class), one row per row of docs: classes of texts linked by edit similarity.

    Texts that share a band of sampled slots are candidates; pairs whose lengths or numbers of characters by class already
    rule the similarity out are spared, all others of different classes verified by the edit distance of the whole texts.
    """
    keyed = keyed_texts(docs)
    cells = [f"c{k}" for k in range(CELLS)]

    def describe(texts: DataFrame, kept) -> tuple[DataFrame, DataFrame]:
        table = kept(texts, "texts")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                points = [code_points(t or "") for t in b.column("text").to_pylist()]
                counts = np.stack([np.bincount(classes_of(p) % CELLS, minlength=CELLS) for p in points]).astype(np.float64)
                yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(counts.sum(1)), pa.array(np.zeros(len(points))), *map(pa.array, np.ascontiguousarray(counts.T))], names=["node", "total", "alone", *cells])

        return table, kept(table.mapInArrow(run, "node bigint, total double, alone double, " + ", ".join(f"{c} double" for c in cells)), "counts")

    def verified(pairs: DataFrame, table: DataFrame) -> DataFrame:
        names = pairs.columns
        side = lambda c: table.select(F.col("node").alias(c), F.col("text").alias(f"t_{c}"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = zip(b.column("t_a").to_pylist(), b.column("t_b").to_pylist(), strict=True)
                near = pa.array([edit_similarity(x or "", y or "", similarity) >= similarity for x, y in texts], pa.bool_())
                yield b.select(names).filter(near)

        return pairs.join(side("a"), "a").join(side("b"), "b").select(*names, "t_a", "t_b").mapInArrow(run, pairs.schema)

    needed = lambda a, b: F.greatest(a, b) * similarity
    return grouped(keyed, _described(keyed), [f"b{k}" for k in range(BANDS)], describe, verified, needed, similarity).select("doc_id", "class_id")
