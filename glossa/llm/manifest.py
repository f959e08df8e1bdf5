"""A Merkle manifest of a corpus: a tree of digests for each language, one over the languages, and every document's proof.

1. Ranks without a global sort. A leaf's path is its doc_id in hexadecimal (order-preserving) and its digest. Histograms of paths'
   prefixes, from two digits on and by three digits more each time, give how many leaves come before a prefix among its
   siblings (at most 16^3); summed along the prefixes that is the exact rank of the first leaf of the longest prefix, of
   which a few hundred leaves share one. Only these are sorted, each prefix for itself. Prefixes grow until none has more
   than BUCKET different leaves; equal leaves (repeated rows) count as one with a multiplicity.
2. The trie of ranks. A leaf's rank in base `FANOUT` names its nodes. Leaves that share all but the last three digits of their
   rank are one row, whose three levels of nodes are computed in place; the rows' top digests are the leaves of the next round.
3. Proofs come down the same rounds: each row gets the runs above it and hands its leaves theirs.

Defined cases: a null or empty text, source, language or number has the digest of its own kind ('-' for null); languages: null
is the first; leaves of equal doc_id stand in the order of their digests, a null doc_id before all others (with the smallest
number of 64 bits); repeated rows are leaves of their own; an empty table gives an empty one; other columns are not read.
The subroots are ranked in one window: one row for each language, not for each document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.session import drop_folder, release, written

FANOUT, LEVELS = 8, 3
BLOCK = FANOUT**LEVELS
#: Different leaves that one prefix may have at most; digits of the first prefix and of each longer one; digits of a path.
BUCKET, FIRST, MORE, DIGITS = 4096, 2, 3, 80
#: Digits with which to begin: prefixes of 256 successive ids.
BEGIN = 14


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _field(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """tree (the language, null before all others), doc_id, leaf, bent (the leaf of the tampered text; null: not tampered), path, m: how many such rows."""
    upper = "".join(map(chr, range(65, 91)))
    head = [_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    lower = F.translate("text", upper, upper.lower())
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-")).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        hashed(*head, _field(F.col("text"))).alias("leaf"),
        F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, hashed(*head, _field(lower))).alias("bent"),
    )
    number = F.coalesce(F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63))), F.lit(0))
    return rows.groupBy("tree", "doc_id", "leaf").agg(F.first("bent").alias("bent"), F.count(F.lit(1)).alias("m")).withColumn("path", F.concat(F.lpad(F.lower(F.hex(number)), 16, "0"), "leaf"))


def _prefix(length: int, column: str = "path") -> Column:
    return F.substring(column, 1, length)


def _before(n: str, parent: list, order: str) -> Column:
    return F.coalesce(F.sum(n).over(Window.partitionBy(*parent).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))


def ranked(rows: DataFrame, begin: int = BEGIN, bucket: int = BUCKET) -> tuple[DataFrame, int, str]:
    """rows with start (the rank of the first of its m leaves in its tree) and size (the tree's leaves); the largest tree's size; a folder to drop."""
    length = begin
    while True:
        counts, path = written(rows.groupBy("tree", _prefix(length).alias("prefix")).agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("d")), "manifest-counts")
        if (counts.agg(F.max("d")).first()[0] or 0) <= bucket or length >= DIGITS:
            break
        drop_folder(rows.sparkSession, path)
        length += MORE
    base, cut = None, None
    for digits in [d for d in range(FIRST, length, MORE)] + [length]:
        level = counts.groupBy("tree", _prefix(digits, "prefix").alias("p")).agg(F.sum("n").alias("n"))
        if base is None:
            level = level.withColumn("size", F.sum("n").over(Window.partitionBy("tree"))).withColumn("base", _before("n", ["tree"], "p"))
        else:
            level = level.withColumn("up", _prefix(cut, "p")).withColumn("inner", _before("n", ["tree", "up"], "p"))
            level = level.join(base.select("tree", F.col("p").alias("up"), F.col("base").alias("upper"), "size"), ["tree", "up"]).withColumn("base", F.col("upper") + F.col("inner"))
        base, cut = level.select("tree", "p", "base", "size"), digits
    most = counts.groupBy("tree").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    joined = rows.withColumn("p", _prefix(length)).join(base, ["tree", "p"])
    return joined.withColumn("start", F.col("base") + _before("m", ["tree", "p"], "path")), most, path


def _nodes(items: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / FANOUT).cast("int")), lambda i: F.sha2(F.concat_ws("", F.slice(items, i * FANOUT + 1, FANOUT)), 256))


def _with_levels(blocks: DataFrame, turn: int) -> DataFrame:
    """blocks (of round `turn`) with the nodes of their levels; a level is null where the tree has one node below it."""
    more = lambda level: F.col("size") > FANOUT ** (LEVELS * turn + level)
    out = blocks.withColumn("one", F.when(more(0), _nodes(F.col("items"))))
    out = out.withColumn("two", F.when(more(1), _nodes(F.col("one"))))
    return out.withColumn("top", F.get(F.when(more(2), _nodes(F.col("two"))).otherwise(F.coalesce("two", "one", "items")), F.lit(0)))


def _grouped(nodes: DataFrame) -> DataFrame:
    """nodes: tree, idx, hash, size -> tree, block, size, items."""
    of = F.collect_list(F.struct(F.col("idx"), F.col("hash")))
    grouped = nodes.groupBy("tree", F.floor(F.col("idx") / BLOCK).alias("block")).agg(F.max("size").alias("size"), F.sort_array(of).alias("pairs"))
    return grouped.select("tree", "block", "size", F.col("pairs.hash").alias("items"))


def _grown(first: DataFrame, most: int, kind: str) -> list[tuple[DataFrame, str]]:
    """Tables of blocks and their folders, round after round until each tree is one block; most: the largest tree's leaves."""
    tables = [written(_with_levels(first, 0), kind)]
    while most > BLOCK ** len(tables):
        nodes = tables[-1][0].select("tree", F.col("block").alias("idx"), F.col("top").alias("hash"), "size")
        tables.append(written(_with_levels(_grouped(nodes), len(tables)), kind))
    return tables


def _runs(i: Column, above: Column) -> Column:
    """Of the item at place i of a block: its run at each level up to the root, with its place there."""
    at = lambda c, step, run: F.when(F.col(c).isNotNull(), F.struct((F.floor(i / step) % FANOUT).cast("int").alias("pos"), run.alias("run")))
    slice_ = lambda c, step: F.slice(F.col(c), (F.floor(i / (step * FANOUT)) * FANOUT + 1).cast("int"), FANOUT)
    last = F.when(F.col("size") > F.col("third"), F.struct((F.floor(i / FANOUT**2) % FANOUT).cast("int").alias("pos"), F.col("two").alias("run")))
    return F.concat(F.filter(F.array(at("one", 1, slice_("items", 1)), at("two", FANOUT, slice_("one", FANOUT)), last), lambda r: r.isNotNull()), above)


def _down(table: DataFrame, above: DataFrame, turn: int) -> DataFrame:
    """above: tree, block, runs, subroot, root -> the same for this table's items (block: the item's place in its tree)."""
    joined = table.join(above, ["tree", "block"]).withColumn("third", F.lit(FANOUT ** (LEVELS * turn + 2)))
    each = F.transform("items", lambda _, i: F.struct((F.col("block") * BLOCK + i).alias("idx"), _runs(i, F.col("runs")).alias("path")))
    return joined.select("tree", "subroot", "root", F.inline(each)).select("tree", F.col("idx").alias("block"), F.col("path").alias("runs"), "subroot", "root")


_NO_RUNS = "cast(array() as array<struct<pos:int,run:array<string>>>)"


def _proved(table: DataFrame, above: DataFrame) -> DataFrame:
    fold = lambda leaf, runs: F.aggregate(runs, leaf, lambda acc, r: F.sha2(F.concat_ws("", F.transform(r["run"], lambda x, i: F.when(i == r["pos"], acc).otherwise(x))), 256))
    others = lambda runs: F.flatten(F.transform(runs, lambda r: F.filter(r["run"], lambda x, i: i != r["pos"])))

    def row(d: Column, i: Column) -> Column:
        leaf = F.get(F.col("items"), i)
        bind = lambda runs: F.struct(d["doc_id"].alias("doc_id"), leaf.alias("leaf"), F.sha2(F.concat_ws("", others(runs)), 256).alias("proof_sha256"), fold(F.coalesce(d["bent"], leaf), runs).alias("folded_root"))
        return F.get(F.transform(F.array(_runs(i, F.col("runs"))), bind), F.lit(0))

    joined = table.join(above, ["tree", "block"]).withColumn("third", F.lit(FANOUT**2))
    out = joined.select("subroot", "root", F.inline(F.transform("docs", row)))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def manifest(docs: DataFrame, begin: int = BEGIN, bucket: int = BUCKET) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 (of the untampered corpus), folded_root (from the tampered leaf, else the original
    one, and the proof's siblings), verified (whether that is the root). One row for each row of docs."""
    spark = docs.sparkSession
    rows, rows_at = written(leaves(docs), "manifest-leaves")
    ranks, most, counts_at = ranked(rows, begin, bucket)
    # A leaf of many equal rows fills the rest of its block and as many more as it needs.
    pieces = ranks.withColumn("block", F.explode(F.expr(f"sequence(start div {BLOCK}, (start + m - 1) div {BLOCK})")))
    pieces = pieces.withColumn("from", F.greatest("start", F.col("block") * BLOCK)).withColumn("n", F.least(F.col("start") + F.col("m"), (F.col("block") + 1) * BLOCK) - F.col("from"))
    grouped = pieces.groupBy("tree", "block").agg(F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("from", "doc_id", "leaf", "bent", "n"))).alias("each"))
    repeat = lambda value: F.flatten(F.transform("each", lambda e: F.array_repeat(value(e), e["n"].cast("int"))))
    first = grouped.select("tree", "block", "size", repeat(lambda e: e["leaf"]).alias("items"), repeat(lambda e: F.struct(e["doc_id"].alias("doc_id"), e["bent"].alias("bent"))).alias("docs"))
    tables = _grown(first, most, "manifest-blocks")
    for path in (rows_at, counts_at):
        drop_folder(spark, path)
    release(spark)
    # The tree over the languages is grown and walked in the same way.
    order = Window.orderBy("tree")
    tops = tables[-1][0].select(F.col("tree").alias("of"), F.col("top").alias("subroot"), (F.row_number().over(order) - 1).cast("long").alias("idx"))
    langs, _ = written(tops.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy())), "manifest-subroots")
    upper = _grown(_grouped(langs.select(F.lit("").alias("tree"), "idx", F.col("subroot").alias("hash"), "size")), langs.count(), "manifest-root")
    above = upper[-1][0].select("tree", "block", F.expr(_NO_RUNS).alias("runs"), F.lit("").alias("subroot"), F.col("top").alias("root"))
    for turn in reversed(range(len(upper))):
        above = _down(upper[turn][0], above, turn)
    above = above.join(langs, F.col("block") == F.col("idx")).select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("block"), "runs", langs["subroot"], "root")
    for turn in reversed(range(1, len(tables))):
        above = _down(tables[turn][0], above, turn)
    return _proved(tables[0][0], above)
