"""Mixing sources to target weights by weighted fair queueing.

The copies of a source's documents stand in a shuffled queue, a second pass over the source after the first. A copy is
served in packets of at most QUANTUM words, so that a long document doesn't keep its source from coming near its target.
A packet's virtual finish time is the source's words up to its end, divided by the source's target. The mix takes packets
of all sources in the order of their finish times, by a range sort, until the budget, the sum of the targets, is spent;
only the packet at the budget is taken in part. A source is off its target by about a packet's words.

Both running sums are taken in two steps, so that no task sees a whole source or the whole mix: sums by small buckets
(runs of the uniform shuffle key, then of the finish time), the buckets' offsets, then the rows inside each bucket. The
order is that of the keys, whatever the number of buckets.

Defined cases: a null text has size 0; a null source is a source of its own, ordered last; documents of size 0 take
nothing; null doc_ids take part, and repeated rows and doc_ids are documents of their own; an empty table gives an empty
one; columns of the input that bear the names of added columns are replaced in `mixed` and kept in `remixed`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.session import positional, written

WORD = r"[^\x20\x09-\x0D]+"
QUANTUM = 128


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """source, source_size, weight, target, budget (all targets) from one row (source, source_size) a source.

    Weights go round over the sources by code point, null last. The targets sum to share times all sizes; a source is
    filled up to most times its size, and what it can't take goes to the others by weight: sources in order of
    capacity by weight are full as long as their capacity is below the level of the rest.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy(F.col("capacity") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("place", F.row_number().over(by_name)).withColumn("weight", weight).withColumn("capacity", F.col("source_size") * F.lit(float(most)))
    rows = rows.withColumn("left", F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("capacity").over(by_level), F.lit(0.0)))
    rows = rows.withColumn("level", F.col("left") / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_level), F.lit(0.0))))
    # up to the first source that isn't full the level rises, after it it falls: the largest is the right one
    rows = rows.withColumn("level", F.max("level").over(everything))
    target = F.when(F.col("capacity") / F.col("weight") <= F.col("level"), F.col("capacity")).otherwise(F.col("weight") * F.col("level"))
    return rows.select("source", "source_size", "weight", target.alias("target"), F.sum(target).over(everything).alias("budget"))


def mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 17) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken (long, words), copies (int).

    A document is taken at most `most` times. copies counts the copies of which at least half is taken.
    """
    keyed = _keyed(docs.select("doc_id", "source", "text"), seed).drop("text")
    return _taken(written(keyed, "mix-rows")[0], weights, share, most).drop("row")


def remixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 17) -> DataFrame:
    """docs as the mix takes it: a document that is taken twice stands there twice, one that isn't taken goes."""
    columns = docs.columns
    named = {c: F.col(f"_{columns.index(c)}") for c in ("doc_id", "source", "text")}
    rows, _ = written(_keyed(positional(docs).withColumns(named), seed).drop("text"), "mix-documents")
    chosen = _taken(rows.select("row", "doc_id", "source", "size", "key"), weights, share, most).where("copies > 0").select("row", "copies")
    found = rows.join(chosen.withColumnRenamed("row", "of"), F.col("row") == F.col("of")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return found.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(columns)])


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    """docs with row, size, and a uniform key that is equal for equal rows; to be written, as row numbers hold only there."""
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    return docs.withColumns({"row": F.monotonically_increasing_id(), "size": size_of(F.col("text")), "key": key})


#: Buckets of a running sum as a power of 2, at most; a bucket's rows are sorted with spilling, so it may hold millions.
MOST_BITS, BUCKET_ROWS = 14, 2000
#: How far past 1 the mix's last finish time may lie; the first of these that is proven to hold spares the packets after it.
_PAST = (0.01, 0.1, 1.0)


def _bits(rows: float) -> int:
    return max(0, min(MOST_BITS, int(rows // BUCKET_ROWS).bit_length()))


def _last_time(sources: DataFrame, most: int) -> float:
    """A time by which the budget is spent: sources that serve all but a packet of what they owe then have served enough."""
    ends = [F.sum(F.greatest(F.lit(0.0), F.least(F.col("target") * (1 + e), F.col("source_size") * most) - QUANTUM)) for e in _PAST]
    spent, *served, longest = sources.agg(F.first("budget"), *ends, F.max(F.try_divide(F.col("source_size") * most, F.col("target")))).first()
    return next((1 + e for e, s in zip(_PAST, served, strict=True) if s is not None and s >= spent), longest or 1.0)


def _taken(keyed: DataFrame, weights: Sequence[float], share: float, most: int) -> DataFrame:
    sources, _ = written(targets(keyed.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "mix-sources")
    last = _last_time(sources, most)
    bits = _bits(most * keyed.count())
    joined = keyed.join(sources, keyed["source"].eqNullSafe(sources["source"])).select("row", keyed["doc_id"], keyed["source"], "size", "key", "source_size", "target", "budget")
    copies = joined.where("size > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("turn", F.xxhash64("key", "copy"))
    copies = copies.withColumn("bucket", F.shiftright("turn", 64 - bits) if bits else F.lit(0).cast("long"))
    # Sums before a copy: of earlier passes and buckets (a small table), then of earlier rows of its own bucket.
    groups = ["source", "copy", "bucket"]
    sums = copies.groupBy(*groups).agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source", "copy").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*groups, F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*groups).orderBy("turn", "key", "row").rowsBetween(Window.unboundedPreceding, 0)
    local = copies.withColumn("words", F.sum("size").over(inside))
    a, b = local.alias("a"), offsets.alias("b")
    on = F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.copy") == F.col("b.copy")) & (F.col("a.bucket") == F.col("b.bucket"))
    start = F.col("b.before") + F.col("a.words") + F.col("a.copy") * F.col("a.source_size") - F.col("a.size")
    queued = a.join(b, on).select("a.row", "a.copy", "a.turn", "a.size", "a.target", "a.budget", start.alias("start")).where(F.col("start") < F.col("target") * last)
    # Packets with their finish times, in ranges of the time.
    packets = queued.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(QUANTUM).cast("long"))))
    packets = packets.withColumn("words", F.least(F.lit(QUANTUM), F.col("size") - F.col("at"))).withColumn("finish", (F.col("start") + F.col("at") + F.col("words")) / F.col("target"))
    buckets = 1 << MOST_BITS
    packets = packets.select("row", "copy", "turn", "at", "words", "finish", "budget", F.least(F.floor(F.col("finish") * (buckets / last)), F.lit(buckets)).alias("bucket"))
    packets, _ = written(packets, "mix-packets")
    sums = packets.groupBy("bucket").agg(F.sum("words").alias("all"))
    offsets = sums.select("bucket", F.coalesce(F.sum("all").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("bucket").orderBy("finish", "turn", "row", "copy", "at").rowsBetween(Window.unboundedPreceding, 0)
    ended = packets.withColumn("end", F.sum("words").over(inside)).join(offsets, "bucket")
    beyond = F.col("end") + F.col("before") - F.floor(F.col("budget") + 1e-6)
    served = ended.withColumn("took", F.col("words") - F.greatest(F.lit(0), beyond)).where("took > 0")
    passes = [F.sum(F.when(F.col("copy") == k, F.col("took")).otherwise(0)).alias(f"took_{k}") for k in range(most)]
    of_row = served.groupBy(F.col("row").alias("of")).agg(*passes)
    everyone = joined.join(of_row, F.col("row") == F.col("of"), "left")
    took = [F.coalesce(f"took_{k}", F.lit(0)) for k in range(most)]
    half = [((t > 0) & (t * 2 >= F.col("size"))).cast("int") for t in took]
    return everyone.select("row", "doc_id", "source", "size", "source_size", "target", sum(took[1:], took[0]).cast("long").alias("taken"), sum(half[1:], half[0]).cast("int").alias("copies"))
