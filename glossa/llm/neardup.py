"""Near-duplicates by improved consistent weighted sampling over TF-IDF word shingles.

1. Document frequencies of words, exact, by one shuffle of partial counts. A shingle of five words weighs its count in the
   text times its words' mean inverse document frequency 1 + ln(documents / frequency), which is cut off at RAREST: only
   words in more than one of RAREST documents need a table, of at most RAREST times the mean distinct words of a document,
   however many documents there are. (By its own frequency a shingle of a large group of copies would count less than
   the copies' differences, and large groups would fall apart.)
2. Each distinct text is sampled SAMPLES times; two texts agree in a sample with the probability of their weighted Jaccard
   similarity. BANDS bands of ROWS samples each (every sample is in two bands) make buckets of candidates.
3. Exact bounds spare comparisons. A shingle that only one candidate text has is shared with none, so the weights without
   such shingles, summed in CELLS cells of the shingle's hash, bound what two texts share: the sum of the cells' smaller
   values. In PIVOT_ROUNDS rounds each bucket compares its members with its most central text (least weight in shingles of
   its own), which joins most members to classes; then all pairs of different classes in a bucket that pass the bounds.
   No pair of a bucket is left out unless it is in one class already or can't reach the similarity.
4. Pairs are verified by the weighted Jaccard similarity of their whole texts. All that pass are edges; the connected parts
   are found once, at the end. Pairs are of distinct texts; copies of a text share its class by its 128-bit hash.

A pair of similarity 0.8 meets in a band with probability 0.97, of 0.85 0.995, of 0.9 0.9995 (test_neardup measures it).

Defined cases: texts without words (null and empty ones too) are one class; texts of one to four words are one shingle;
texts are taken whole; repeated rows share a class; a null doc_id takes part, and class_id is null only where the whole class
has no doc_id; rows are judged by their texts, so rows of one doc_id with different texts may be of different classes; an
empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.arrays import Words, grams, mix, slices, utf8, words
from glossa.llm.session import drop_folder, positional, release, written

SHINGLE, SIMILARITY = 5, 0.8
ROWS, BANDS, SAMPLES = 5, 12, 30
#: Words rarer than one document in RAREST weigh as if they were so frequent.
RAREST = 4096
CELLS, PIVOT_ROUNDS = 32, 2
#: Values of Gamma(2, 1) at the middles of 65,536 equal shares, by Newton's method on its distribution function.
_SHARES = (np.arange(65536) + 0.5) / 65536


def _gamma() -> np.ndarray:
    x = np.maximum(np.sqrt(2 * _SHARES), -np.log1p(-_SHARES))
    for _ in range(60):
        x = np.maximum(x - (1 - np.exp(-x) * (1 + x) - _SHARES) / np.maximum(x * np.exp(-x), 1e-12), x / 4)
    return x


_R = _gamma().astype(np.float32)
_LN_C = np.log(_gamma()).astype(np.float32)
_SEEDS = np.random.Generator(np.random.PCG64(5)).integers(1, 2**63, SAMPLES, dtype=np.uint64)
_PLACES = np.uint64(0xC2B2AE3D27D4EB4F)
#: The samples of each band: two shuffles of all samples, cut into bands.
_BAND_SAMPLES = np.concatenate([np.random.Generator(np.random.PCG64(k)).permutation(SAMPLES).reshape(-1, ROWS) for k in (21, 22)])


class Rarity:
    """Inverse document frequencies by word hash."""

    def __init__(self, hashes: np.ndarray, documents: np.ndarray, total: int):
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.values = (1 + np.log(total / np.maximum(documents[order], total / RAREST))).astype(np.float32)
        self.top = np.float32(1 + np.log(RAREST))

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(hashes), self.top)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.values[at], self.top)


def word_frequencies(docs: DataFrame) -> Rarity:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = utf8(b.column("text"))
            for a, z in slices([len(t) for t in texts]):
                w = words(texts[a:z])
                order = np.lexsort((w.text_of, w.hashes))
                h, t = w.hashes[order], w.text_of[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
                h = h[new]
                at = np.flatnonzero(np.diff(h, prepend=~h[:1])) if len(h) else np.zeros(0, int)
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(np.diff(np.append(at, len(h))))], names=["word", "documents"])

    total = docs.count()
    rows = docs.select("text").mapInArrow(run, "word bigint, documents bigint").groupBy("word").agg(F.sum("documents").alias("documents")).where(F.col("documents") * RAREST > total).toArrow()
    return Rarity(np.asarray(rows["word"]).view(np.uint64), np.asarray(rows["documents"]).astype(np.float64), total)


def shingles(w: Words, rarity: Rarity) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and weight of each text's distinct shingles, in the order of texts and hashes."""
    rare = rarity.of(w.hashes).astype(np.float64)
    whole = grams(w.hashes, SHINGLE)
    at = np.flatnonzero(w.room()[: len(whole)] >= SHINGLE)
    # Added in the words' order, so that equal shingles weigh the same to the last bit wherever they stand.
    text, hashes, weight = w.text_of[at], whole[at], sum(rare[at + k] for k in range(SHINGLE)) / SHINGLE
    for i in np.flatnonzero((w.counts > 0) & (w.counts < SHINGLE)):
        own = w.hashes[w.first[i] : w.first[i + 1]]
        text, hashes = np.append(text, i), np.append(hashes, grams(own, len(own)))
        weight = np.append(weight, rare[w.first[i] : w.first[i + 1]].mean())
    order = np.lexsort((hashes, text))
    text, hashes, weight = text[order], hashes[order], weight[order]
    new = np.ones(len(order), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(order)))
    return text[first], hashes[first], weight[first] * times


def samples(text: np.ndarray, hashes: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """n x SAMPLES consistent weighted samples as 32-bit numbers; 0 for texts without shingles."""
    out = np.zeros((n, SAMPLES), np.uint32)
    if not len(text):
        return out
    first = np.flatnonzero(np.diff(text, prepend=-1))
    ln = np.log(weight).astype(np.float32)
    low, half = np.uint64(0xFFFF), np.uint64(32)
    for k, seed in enumerate(_SEEDS):
        x = mix(hashes + seed)
        r = _R[(x & low).astype(np.uint16)]
        beta = ((x >> np.uint64(16)) & low).astype(np.float32) * np.float32(1 / 65536)
        t = np.floor(ln / r + beta)
        a = _LN_C[((x >> half) & low).astype(np.uint16)] - r * (t - beta + 1)
        # The sample is the shingle of the smallest a with its t: a in the upper half of a number, both hashed in the lower.
        order = np.clip((a + np.float32(512)) * np.float32(2**21), 0, 2**32 - 1).astype(np.uint64)
        name = ((x >> half) + (t.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B1))) & np.uint64(0xFFFFFFFF)
        out[text[first], k] = (np.minimum.reduceat(order << half | name, first) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return out


def bands(found: np.ndarray) -> np.ndarray:
    """n x BANDS keys of buckets from n x SAMPLES samples."""
    out = np.zeros((len(found), BANDS), np.uint64)
    for k, chosen in enumerate(_BAND_SAMPLES):
        out[:, k] = k
        for s in chosen:
            out[:, k] = mix(out[:, k] * _PLACES + found[:, s].astype(np.uint64))
    return out


def keyed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text and a 128-bit hash of the text in k1 and k2."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.lit(1), text).alias("k1"), F.xxhash64(F.lit(2), text).alias("k2"))


def _signed(keyed: DataFrame, rarity) -> DataFrame:
    names = ["doc_id", "k1", "k2", *[f"b{k}" for k in range(BANDS)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = utf8(b.column("text"))
            for a, z in slices([len(t) for t in texts], 1 << 20):
                keys = bands(samples(*shingles(words(texts[a:z]), rarity.value), z - a)).view(np.int64)
                yield pa.RecordBatch.from_arrays([*[b.column(c).slice(a, z - a) for c in names[:3]], *map(pa.array, np.ascontiguousarray(keys.T))], names=names)

    return keyed.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def _weighed(texts: DataFrame, rarity) -> DataFrame:
    """node, total weight, the shingles' sorted hashes and weights, and the weights' sums by cell, from (node, text)."""
    cells = [f"c{k}" for k in range(CELLS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = utf8(b.column("text"))
            for a, z in slices([len(t) for t in every], 1 << 20):
                text, hashes, weight = shingles(words(every[a:z]), rarity.value)
                weight = weight.astype(np.float32).astype(np.float64)
                at = pa.array(np.searchsorted(text, np.arange(z - a + 1)).astype(np.int32))
                sums = np.bincount(text * CELLS + cell_of(hashes), weight, minlength=(z - a) * CELLS).astype(np.float64).reshape(-1, CELLS)
                lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (hashes.view(np.int64), weight.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([b.column("node").slice(a, z - a), pa.array(sums.sum(1)), *lists, *map(pa.array, np.ascontiguousarray(sums.T))], names=["node", "total", "hashes", "weights", *cells])

    return texts.mapInArrow(run, "node bigint, total double, hashes array<bigint>, weights array<float>, " + ", ".join(f"{c} double" for c in cells))


def cell_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(CELLS - 1)).astype(np.int64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two texts' distinct shingle hashes and weights; texts without shingles are equal."""
    (x, u), (y, v) = a, b
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    u, v = u.astype(np.float64), v.astype(np.float64)
    shared = float(np.minimum(u[i], v[j]).sum())
    every = float(u.sum() + v.sum()) - shared
    return shared / every if every else 1.0


def _verified(pairs: DataFrame, weighed: DataFrame, similarity: float) -> DataFrame:
    """The rows of pairs (a, b, and other columns) whose texts have at least the similarity."""
    side = lambda c: weighed.select(F.col("node").alias(c), F.col("hashes").alias(f"h_{c}"), F.col("weights").alias(f"w_{c}"))
    names = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists(b: pa.RecordBatch, c: str) -> list[np.ndarray]:
            column = b.column(c)
            at, values = column.offsets.to_numpy(), column.values.to_numpy()
            return [values[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]

        for b in batches:
            sides = [list(zip(lists(b, f"h_{c}"), lists(b, f"w_{c}"), strict=True)) for c in ("a", "b")]
            near = pa.array([weighted_jaccard(p, q) >= similarity for p, q in zip(*sides, strict=True)], pa.bool_())
            yield b.select(names).filter(near)

    return pairs.join(side("a"), "a").join(side("b"), "b").select(*names, "h_a", "w_a", "h_b", "w_b").mapInArrow(run, pairs.schema)


def components(edges: DataFrame) -> DataFrame:
    """node, label from edges (one, other): the smallest node of each connected part, by least neighbours and jumps."""
    spark = edges.sparkSession
    both, both_at = written(edges.unionByName(edges.select(F.col("other").alias("one"), F.col("one").alias("other"))).distinct(), "parts-edges")
    labels, labels_at = written(both.groupBy("one").agg(F.least(F.min("other"), F.col("one")).alias("label")).withColumnRenamed("one", "node"), "parts-labels")
    while True:
        near, near_at = written(both.join(labels, both["other"] == labels["node"]).groupBy("one").agg(F.min("label").alias("least")), "parts-near")
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("beyond"))
        new = labels.join(near, labels["node"] == near["one"]).join(jump, labels["label"] == jump["at"])
        new, new_at = written(new.select("node", F.col("label").alias("old"), F.least("label", "least", "beyond").alias("label")), "parts-labels")
        for path in (near_at, labels_at):
            drop_folder(spark, path)
        labels, labels_at = new.drop("old"), new_at
        if not new.where("old <> label").limit(1).count():
            drop_folder(spark, both_at)
            return labels


def linked(members: DataFrame, profile: DataFrame, verify: Callable[[DataFrame], DataFrame], needed: Callable[[Column, Column], Column], similarity: float, kept: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Edges (one, other) that join all verified pairs of a bucket, from members (key, node) and profile (node, total, alone, c0, ...).

    What two nodes share is at most the sum of the smaller values of their cells, c0 and so on, and at most total less
    alone of either. A pair can only be verified if that is at least needed(total, total), which is at least similarity
    times either total and grows with both. verify gives the rows of pairs (a, b, and others) that hold; kept writes tables.
    """
    cells = [c for c in profile.columns if c[0] == "c" and c[1:].isdigit()]
    slack = 1 - 1e-6
    off = F.coalesce(F.try_divide("alone", "total"), F.lit(0.0))
    first = profile.select("node", "total", (F.col("total") - F.col("alone")).alias("common"), off.alias("off"))
    rest = kept(members.join(first, "node").withColumns({"class": F.col("node"), "class_off": F.col("off")}), "rest")
    links = []
    for _ in range(PIVOT_ROUNDS):
        central = F.min(F.struct("off", "node", "total", "common", "class", "class_off")).alias("p")
        buckets = rest.groupBy("key").agg(F.min("class").alias("least"), F.max("class").alias("most"), F.min("total").alias("low"), F.max("total").alias("high"), central).where("least <> most")
        buckets = kept(buckets.select("key", "low", "high", F.col("p.off").alias("p_off"), F.col("p.node").alias("a"), F.col("p.total").alias("a_total"), F.col("p.common").alias("a_common"), F.col("p.class").alias("one"), F.col("p.class_off").alias("one_off")), "buckets")
        # A partner's total is at least the share of this one's, and at most what this one's common weight still allows.
        least = F.col("total") * similarity * slack
        possible = (F.col("common") >= least) & (F.col("high") >= least) & (F.col("common") >= needed(F.col("total"), F.col("low")) * slack)
        rest = kept(rest.join(buckets, "key").where(possible & (F.col("node") != F.col("a"))), "rest")
        bound = F.least("common", "a_common") >= needed(F.col("total"), F.col("a_total")) * slack
        pairs = rest.where(bound & (F.col("class") != F.col("one"))).select("a", F.col("node").alias("b"), "one", "one_off", F.col("class").alias("other"), F.col("class_off").alias("other_off")).distinct()
        found = kept(verify(pairs), "links")
        links += [found.select("one", "other"), found.select(F.col("a").alias("one"), F.col("b").alias("other"))]
        # Classes take the name of the most central class that they are linked to, and once more of that one's: this only
        # spares comparisons, the links say what is joined.
        turned = found.select(F.col("other").alias("one"), F.col("other_off").alias("one_off"), F.col("one").alias("other"), F.col("one_off").alias("other_off"))
        up = found.select(*turned.columns).unionByName(turned).where(F.struct("one_off", "one") < F.struct("other_off", "other"))
        up = kept(up.groupBy("other").agg(F.min(F.struct("one_off", "one")).alias("p")).select("other", F.col("p.one").alias("near"), F.col("p.one_off").alias("near_off")), "up")
        far = up.select(F.col("other").alias("near"), F.col("near").alias("far"), F.col("near_off").alias("far_off"))
        names = kept(up.join(far, "near", "left").select("other", F.coalesce("far", "near").alias("name"), F.coalesce("far_off", "near_off").alias("name_off")), "names")
        rest = rest.select("key", "node", "total", "common", "off", "class", "class_off").join(names, F.col("class") == names["other"], "left")
        rest = kept(rest.select("key", "node", "total", "common", "off", F.coalesce("name", "class").alias("class"), F.coalesce("name_off", "class_off").alias("class_off")), "rest")
    release(members.sparkSession)
    # All pairs of different classes that the bounds allow.
    several = kept(rest.groupBy("key").agg(F.min("class").alias("least"), F.max("class").alias("most")).where("least <> most").select("key"), "several")
    full = kept(rest.join(several, "key", "left_semi").select("key", "node", "class").join(profile.drop("alone"), "node"), "full")
    x, y = [full.select("key", *[F.col(c).alias(f"{side}_{c}") for c in ("node", "class", "total", *cells)]) for side in "xy"]
    together = sum((F.least(f"x_{c}", f"y_{c}") for c in cells[1:]), F.least(f"x_{cells[0]}", f"y_{cells[0]}"))
    on = (x["key"] == y["key"]) & (F.col("x_node") < F.col("y_node")) & (F.col("x_class") != F.col("y_class")) & (together >= needed(F.col("x_total"), F.col("y_total")) * slack)
    pairs = x.join(y, on).select(F.col("x_node").alias("a"), F.col("y_node").alias("b")).distinct()
    edges = kept(verify(pairs), "links").select(F.col("a").alias("one"), F.col("b").alias("other"))
    for more in links:
        edges = edges.unionByName(more)
    return edges.where("one <> other")


def grouped(keyed: DataFrame, signed: DataFrame, keys: list[str], describe: Callable[[DataFrame, Callable], tuple[DataFrame, DataFrame]], verified: Callable[[DataFrame, DataFrame], DataFrame], needed: Callable[[Column, Column], Column], similarity: float) -> DataFrame:
    """One row per row of keyed (doc_id, text, k1, k2): doc_id, k1, k2, label (of its class, a long) and class_id.

    signed has doc_id, k1, k2 and bucket keys; describe gives of (node, text) the table that verified (pairs, table) reads
    and the profile that `linked` reads.
    """
    spark, folders = keyed.sparkSession, []

    def kept(df: DataFrame, kind: str) -> DataFrame:
        out, path = written(df, f"near-{kind}")
        folders.append(path)
        return out

    signed = kept(signed, "signed")
    nodes = signed.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), *[F.min(b).alias(b) for b in keys])
    nodes = kept(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    named = nodes.select("node", F.explode(F.array(*keys)).alias("key"))
    shared = kept(named.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "keys")
    members = kept(named.join(shared, "key"), "members")
    # The text of each member, once.
    known = ["k1", "k2", "id", "no_id"]
    with_id = lambda df, c: df.withColumns({"id": F.coalesce(c, F.lit(0)), "no_id": F.col(c).isNull()})
    wanted = kept(with_id(members.select("node").distinct().join(nodes, "node"), "first").select("node", *known), "wanted")
    # Never by broadcast, as the members grow with the input.
    texts = with_id(keyed, "doc_id").select("text", *known).join(wanted.hint("merge"), known).dropDuplicates(known).select("node", "text")
    table, profile = describe(texts, kept)
    release(spark)
    parts = components(linked(members, profile, lambda pairs: verified(pairs, table), needed, similarity, kept))
    firsts = kept(parts.join(nodes.select("node", "first"), "node"), "parts")
    least = kept(firsts.groupBy("label").agg(F.min("first").alias("class_id")), "least")
    of_part = firsts.select("node", "label").join(least, "label").withColumn("joined", F.lit(True))
    named = nodes.select("node", "k1", "k2", "first").join(of_part, "node", "left")
    named = named.select("k1", "k2", F.coalesce("label", "node").alias("label"), F.when(F.col("joined"), F.col("class_id")).otherwise(F.col("first")).alias("class_id"))
    out, _ = written(signed.select("doc_id", "k1", "k2").join(named, ["k1", "k2"]), "near-classes")
    for path in folders:
        drop_folder(spark, path)
    release(spark)
    return out.select("doc_id", "k1", "k2", "label", "class_id")


def labelled(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of docs: doc_id, k1, k2 (the text's hash), label (of its class, a long) and class_id."""
    keyed = keyed_texts(docs)
    rarity = docs.sparkSession.sparkContext.broadcast(word_frequencies(keyed))
    release(docs.sparkSession)

    def describe(texts: DataFrame, kept: Callable) -> tuple[DataFrame, DataFrame]:
        """Shingles of the texts; what each text has alone, in all and by cell."""
        weighed = kept(_weighed(texts, rarity), "weights")
        cells = [f"c{k}" for k in range(CELLS)]
        each = weighed.select("node", F.explode(F.arrays_zip("hashes", "weights")).alias("s")).select("node", "s.hashes", F.col("s.weights").cast("double").alias("weight"))
        own = each.groupBy("hashes").agg(F.count("*").alias("n"), F.min("node").alias("node"), F.min("weight").alias("weight")).where("n = 1")
        cell = F.col("hashes").bitwiseAND(F.lit(CELLS - 1))
        own = own.groupBy("node").agg(F.sum("weight").alias("alone"), *[F.sum(F.when(cell == k, F.col("weight")).otherwise(0.0)).alias(f"o{k}") for k in range(CELLS)])
        less = [F.greatest(F.lit(0.0), F.col(c) - F.coalesce(f"o{k}", F.lit(0.0))).alias(c) for k, c in enumerate(cells)]
        profile = weighed.drop("hashes", "weights").join(own, "node", "left").select("node", "total", F.coalesce("alone", F.lit(0.0)).alias("alone"), *less)
        return weighed, kept(profile, "profile")

    keys = [f"b{k}" for k in range(BANDS)]
    needed = lambda a, b: (a + b) * (similarity / (1 + similarity))
    return grouped(keyed, _signed(keyed, rarity), keys, describe, lambda pairs, table: _verified(pairs, table, similarity), needed, similarity)


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the document's class), one row per row of docs."""
    return labelled(docs, similarity).select("doc_id", "class_id")


def distinct_documents(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs without near-duplicates: of each class one row stays, that of the smallest doc_id (a null one only if there is no other)."""
    columns = docs.columns
    key = ["k1", "k2", "id", "no_id"]
    rows = labelled(docs, similarity).select("label", F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "k1", "k2")
    chosen, _ = written(rows.groupBy("label").agg(F.min(F.struct("no_id", "id", "k1", "k2")).alias("p")).select("p.*"), "near-chosen")
    text = F.coalesce(F.col(f"_{columns.index('text')}").cast("string"), F.lit(""))
    doc_id = F.col(f"_{columns.index('doc_id')}").cast("long")
    with_key = positional(docs).withColumns({"k1": F.xxhash64(F.lit(1), text), "k2": F.xxhash64(F.lit(2), text), "id": F.coalesce(doc_id, F.lit(0)), "no_id": doc_id.isNull()})
    one = with_key.join(chosen, key, "left_semi").dropDuplicates(key)
    return one.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(columns)])
