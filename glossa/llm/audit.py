"""What filters of documents do to each other: for every order of the filters, what each one removes.

1. Duplicates by sorting. Rows are range-sorted by (fingerprint of the text, doc_id) and within a range by (fingerprint, text,
   doc_id); a row is compared with its predecessor, so a group of copies of any size spreads over as many ranges as it
   needs. Ranges meet only inside one fingerprint: a range leaves the rows of its first fingerprint that no row before
   them in the range decides, and the smallest doc_id of each text of its last fingerprint; these few rows are settled
   by text digest afterwards. Texts are compared whole, equal fingerprints of different texts included.
2. Each row's failures are a mask of one bit for each filter. Counts by part and mask are additive and bounded (2^filters a
   part); every order's counters are sums over masks, so no order reads documents again.

Defined cases: a null text is the empty text; a null source counts as the empty string; a row with a null doc_id is neither a
duplicate nor makes others one, and has no labels; of repeated rows of one doc_id none makes another a duplicate (a smaller
doc_id does); of several label rows of a doc_id one that says 1 suffices; an empty table gives an empty one; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.session import input_bytes, release, written

#: The filters of the registered query by letter; each takes the text and its words. DUPLICATE is the filter of copies.
FILTERS: Mapping[str, Callable[[Column, Column], Column]] = {
    "A": lambda text, words: F.size(words) < 200,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
    "C": lambda text, words: 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
    "D": lambda text, words: text.rlike("[#$%&*|]"),
}
DUPLICATE = "E"
_NEVER = np.iinfo(np.int64).max
_OUT = pa.schema([("doc_id", pa.int64()), ("salt", pa.int32()), ("part", pa.string()), ("mask", pa.int32()), ("open", pa.string()), ("low", pa.int64()), ("n", pa.int64())])
_OUT_SQL = "doc_id bigint, salt int, part string, mask int, open string, low bigint, n bigint"


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _compared(duplicate: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over a sorted range: rows with the duplicate bit set where the range decides it; open: digest of the text where it doesn't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, text, low = None, None, None, _NEVER  # fingerprints; the last row's text and its run's smallest doc_id
        ends: dict[str, int] = {}  # of the last fingerprint: texts' digests and smallest doc_ids
        for b in (x for whole in batches for x in (whole.slice(i, 4096) for i in range(0, whole.num_rows, 4096))):
            prints, texts = b.column("fp").to_numpy(), b.column("text")
            ids = pc.fill_null(b.column("doc_id"), _NEVER).to_numpy(zero_copy_only=False)
            known = ids != _NEVER
            new = np.ones(b.num_rows, bool)
            new[1:] = ~pc.equal(texts.slice(1), texts.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
            new[0] = text is None or texts[0].as_py() != text
            starts = np.flatnonzero(new) if new[0] else np.concatenate([[0], np.flatnonzero(new)])
            lows = np.minimum.reduceat(ids, starts)
            lows[0] = lows[0] if new[0] else min(low, lows[0])
            of = np.searchsorted(starts, np.arange(b.num_rows), side="right") - 1
            first = prints[0] if first is None else first
            later = known & (ids > lows[of])
            waits = known & ~later & (prints == first)
            digests: list[str | None] = [None] * b.num_rows
            for i in np.flatnonzero(waits).tolist():
                digests[i] = _digest(texts[i].as_py())
            ends = {} if last is None or prints[-1] != last else ends
            last, text, low = prints[-1], texts[b.num_rows - 1].as_py(), int(lows[-1])
            for r in np.flatnonzero(prints[starts] == last).tolist():
                if lows[r] != _NEVER:
                    ends[_digest(texts[int(starts[r])].as_py())] = int(lows[r])
            mask = b.column("mask").to_numpy() | (later * duplicate).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.where(known, 0, np.arange(b.num_rows)), pa.int32()), b.column("part"), pa.array(mask, pa.int32()), pa.array(digests, pa.string()), pa.array(ids, pa.int64(), mask=~waits), pa.array(np.ones(b.num_rows, np.int64))], schema=_OUT)
        if ends:
            none = lambda kind: pa.nulls(len(ends), kind)
            yield pa.RecordBatch.from_arrays([none(pa.int64()), pa.array(range(len(ends)), pa.int32()), none(pa.string()), none(pa.int32()), pa.array(list(ends), pa.string()), pa.array(list(ends.values()), pa.int64()), pa.array([0] * len(ends), pa.int64())], schema=_OUT)

    return run


def masks(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Callable[[Column, Column], Column]] = FILTERS, duplicate: str = DUPLICATE, fingerprint: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """part, mask, n, good, toxic: documents of a part that fail just the filters of the mask (bit i: the i-th, the last is `duplicate`)."""
    spark = docs.sparkSession
    bit = 1 << len(filters)
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("part")).withColumn("fp", fingerprint(F.col("text")))
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), input_bytes(docs) // (64 << 20) + 1)
    ranged = wanted.repartitionByRange(count, "fp", "doc_id").sortWithinPartitions("fp", "text", "doc_id")
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    each = lambda ws: sum((F.when(fails(F.col("text"), ws), 1 << i).otherwise(0) for i, fails in enumerate(filters.values())), F.lit(0))
    mask = F.get(F.transform(F.array(words), each), F.lit(0)).cast("int").alias("mask")
    rows = ranged.select("fp", "text", "doc_id", "part", mask).mapInArrow(_compared(bit), _OUT_SQL)
    told = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(told("quality"), told("toxic")).withColumn("salt", F.lit(0))
    counted = (F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("quality", F.lit(0))).alias("good"), F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))
    small, _ = written(rows.join(said, ["doc_id", "salt"], "left").groupBy("part", "mask", "open", "low").agg(*counted), "audit")
    release(spark)
    waiting = small.where("open is not null")
    least = waiting.groupBy("open").agg(F.min("low").alias("least"))
    settled = waiting.where("part is not null").join(least, "open").withColumn("mask", F.when(F.col("low") > F.col("least"), F.col("mask").bitwiseOR(bit)).otherwise(F.col("mask")))
    some = ("part", "mask", "n", "good", "toxic")
    return small.where("open is null").select(*some).unionByName(settled.select(*some)).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in some[2:]])


def audited(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Callable[[Column, Column], Column]] = FILTERS, duplicate: str = DUPLICATE, fingerprint: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row for each part, order of the filters and step: part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley (all counts of documents within the part).

    removed: by this step's filter; redundant: fail it but were removed before; unique_fails: fail it alone; shapley: removed by
    this filter, summed over all orders.
    """
    letters = [*filters, duplicate]
    k, size = len(letters), 1 << len(letters)
    vectors = lambda c: F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)) for m in range(size)]).alias(c)
    parts = masks(docs, labels, filters, duplicate, fingerprint).groupBy("part").agg(vectors("n"), vectors("good"), vectors("toxic"))
    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(letters)])).alias("filter_order")
    steps = parts.select("*", orders).select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    bits = lambda s: F.aggregate(F.split(s, ""), F.lit(0), lambda acc, x: acc + F.coalesce(F.element_at(bit_of, x), F.lit(0)))
    bit_of = F.create_map(*[F.lit(x) for i, letter in enumerate([*letters, ""]) for x in (letter, (1 << i) % size)])
    steps = steps.withColumn("before", bits(F.expr("substring(filter_order, 1, step - 1)"))).withColumn("own", bits(F.expr("substring(filter_order, step, 1)")))
    has = lambda m, c: F.col(c).bitwiseAND(m) != 0
    over = lambda c, chosen, value=lambda m, n: n: F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), F.lit(0).cast("long"), lambda acc, m: acc + F.when(chosen(m), value(m, F.get(F.col(c), m))).otherwise(F.lit(0).cast("long")))
    removed = lambda m: has(m, "own") & ~has(m, "before")
    return steps.select(
        "part", "filter_order", "step",
        over("n", lambda m: ~has(m, "own") & ~has(m, "before")).alias("kept"),
        over("n", removed).alias("removed"),
        over("n", lambda m: has(m, "own") & has(m, "before")).alias("redundant"),
        over("n", lambda m: m == F.col("own")).alias("unique_fails"),
        over("good", removed).alias("good_lost"),
        over("toxic", removed).alias("toxic_lost"),
        over("n", lambda m: has(m, "own"), lambda m, n: (n * factorial(k) / F.bit_count(m)).cast("long")).alias("shapley"),
    )
