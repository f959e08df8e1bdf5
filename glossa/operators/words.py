"""What documents say of their words (how often with which tag, where), added up over the corpus and given back to each bucket of
documents: a bucket counts its own words, equal words of several buckets meet in one shuffle, and only their sums travel back. A word
that one bucket alone has is counted there already.

No table of all words is ever sent to all tasks: each bucket gets rows of its own words.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from glossa.operators import flat
from glossa.operators.corpus import START, STOP
from glossa.operators.learn import NO_CAPITALS, TAGGER

#: Bytes of a bucket, as they are stored.
BUCKET = 6 << 20
#: The counts of a bucket's words: names of words, and a matrix with a row for each.
Counts = tuple[pa.Array, np.ndarray]


def bucketed(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, text and their bucket by doc_id; how many buckets there are (eight for each shuffle partition where the size isn't known)."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    spark = docs.sparkSession
    n = max(spark.sparkContext.defaultParallelism, size // BUCKET + 1) if size < 1 << 60 else 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("bucket")), n


def _tokens(table: pa.Table) -> flat.Tokens:
    table = table.combine_chunks()
    column = lambda c, kind: table[c].chunk(0) if table[c].num_chunks else pa.array([], kind)
    return flat.annotated(column("text", pa.string()), column("doc_id", pa.int64()))


def _packed(rows: np.ndarray) -> pa.Array:
    """Rows of counts as bytes: how many aren't 0; the place of each with the code of its size (1, 2, 4 or 8 bytes); their bytes."""
    if rows.shape[1] > 64:
        raise ValueError("a table has at most 64 counts a word")
    row, col = np.nonzero(rows)
    value = rows[row, col].astype("<i8")
    code = np.searchsorted([1 << 8, 1 << 16, 1 << 32], value, side="right")
    many, size = np.bincount(row, minlength=len(rows)), 1 << code
    ends = np.append(0, np.cumsum(1 + many + np.bincount(row, size, len(rows)).astype(np.int64)))
    out = np.zeros(ends[-1], np.uint8)
    out[ends[:-1]] = many
    first = np.cumsum(many) - many
    out[ends[row] + 1 + np.arange(len(row)) - first[row]] = col * 4 + code
    at = np.append(0, np.cumsum(size))[:-1]
    if len(row):
        at = ends[row] + 1 + many[row] + at - at[np.minimum(first, len(row) - 1)][row]
    raw = value.view(np.uint8).reshape(-1, 8)
    for c in range(4):
        some = np.flatnonzero(code == c)
        out[at[some, None] + np.arange(1 << c)] = raw[some, : 1 << c]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out)])


def _counts(column: pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """The counts of `_packed`; without a width as many columns as are used."""
    values = column.combine_chunks().cast(pa.large_binary())
    begin = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values)]
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)
    many = data[begin].astype(np.int64)
    row, first = np.repeat(np.arange(len(begin)), many), np.cumsum(many) - many
    head = data[begin[row] + 1 + np.arange(len(row)) - first[row]].astype(np.int64)
    code, col = head & 3, head >> 2
    at = np.append(0, np.cumsum(1 << code))[:-1]
    if len(row):
        at = begin[row] + 1 + many[row] + at - at[np.minimum(first, len(row) - 1)][row]
    raw = np.zeros((len(row), 8), np.uint8)
    for c in range(4):
        some = np.flatnonzero(code == c)
        raw[some, : 1 << c] = data[at[some, None] + np.arange(1 << c)]
    out = np.zeros((len(begin), width or int(col.max(initial=0)) + 1), np.int64)
    out[row, col] = raw.view("<i8")[:, 0]
    return out


def with_sums(docs: DataFrame, tables: Callable[[flat.Tokens], tuple[list[Counts], object]], finish: Callable[[flat.Tokens, list[Counts], object], list], schema: str) -> DataFrame:
    """Rows that finish(tokens, tables, more) makes of each bucket of documents, as columns in the order of the schema.

    tables(tokens) gives tables of counts and what else finish needs; finish gets the same tables with the counts of the whole corpus.
    """
    rows, n = bucketed(docs)
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    kinds = to_arrow_schema(T.StructType.fromDDL(schema))

    def own(key: tuple, table: pa.Table) -> pa.Table:
        found, _ = tables(_tokens(table))
        out = [pa.table([pa.array(np.full(len(words), k), pa.int32()), words.cast(pa.string()), pa.array(np.full(len(words), key[0].as_py()), pa.int32()), _packed(counts).cast(pa.binary())], names=["kind", "word", "bucket", "v"]) for k, (words, counts) in enumerate(found)]
        return pa.concat_tables(out)

    def summed(key: tuple, table: pa.Table) -> pa.Table:
        """Sums of the words that more than one bucket has, a row for each of these."""
        table = table.combine_chunks()
        kind, out = table["kind"].to_numpy(), []
        for k in np.unique(kind).tolist():
            part = table.filter(pa.array(kind == k)).combine_chunks()
            codes = part["word"].combine_chunks().dictionary_encode()
            code = codes.indices.to_numpy().astype(np.int64)
            many = np.flatnonzero((np.bincount(code) > 1)[code])
            if not len(many):
                continue
            order = many[np.argsort(code[many], kind="stable")]
            part = part.take(pa.array(order))
            code = code[order]
            first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            sums = _packed(np.add.reduceat(_counts(part["v"]), first, axis=0))
            whole = sums.take(pa.array(np.repeat(np.arange(len(first)), np.diff(np.append(first, len(code))))))
            out.append(pa.table([part["kind"], part["word"], part["bucket"], whole.cast(pa.binary())], names=["kind", "word", "bucket", "v"]))
        return pa.concat_tables(out) if out else table.slice(0, 0).select(["kind", "word", "bucket", "v"])

    def end(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return kinds.empty_table()
        t = _tokens(left)
        found, more = tables(t)
        kind = right["kind"].to_numpy() if right.num_rows else np.zeros(0, np.int32)
        for k, (words, counts) in enumerate(found):
            found[k] = (words, counts.astype(np.int64))
            part = right.filter(pa.array(kind == k))
            if part.num_rows:
                at = pc.index_in(part["word"].combine_chunks().cast(words.type), words).to_numpy()
                found[k][1][at] = _counts(part["v"], counts.shape[1])
        return pa.table([c if isinstance(c, pa.Array) else pa.array(c) for c in finish(t, found, more)], names=names).cast(kinds)

    local = rows.groupBy("bucket").applyInArrow(own, "kind int, word string, bucket int, v binary")
    part = local.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(n)).cast("int"))
    sums = part.groupBy("part").applyInArrow(summed, "kind int, word string, bucket int, v binary")
    return rows.groupBy("bucket").cogroup(sums.groupBy("bucket")).applyInArrow(end, schema)


# --- tags of words --------------------------------------------------------------------------------------------------


def _tag_counts(t: flat.Tokens) -> tuple[list[Counts], np.ndarray]:
    """How often each word has each tag; the word of each token."""
    words = t.form.dictionary_encode()
    word, k = words.indices.to_numpy().astype(np.int64), len(flat.TAGS)
    return [(words.dictionary, np.bincount(word * k + t.tag, minlength=len(words.dictionary) * k).reshape(-1, k))], word


def tag_parts(docs: DataFrame, order: int) -> DataFrame:
    """t1, t2 (and t3, if order is 3), n, n_gold: parts of neighbouring tags, boundaries included, of which each token may have all that
    its word has anywhere; gold: the tokens' own. Three of them stand in sentences of more than one token only.

    Parts are never rows: a place has a row of zeros and ones, and products of neighbouring rows add up to the counts.
    """
    names = [*flat.TAGS, START, STOP]
    size = len(names)

    def finish(t: flat.Tokens, tables: list[Counts], word: np.ndarray) -> list:
        n = np.diff(t.offset)
        at = np.arange(len(t.at)) + 2 * t.sent + 1  # marks before and after each sentence
        first = t.offset[:-1] + 2 * np.arange(len(n))
        places = len(t.at) + 2 * len(n)
        may, gold, sent = np.zeros((places, size)), np.zeros(places, np.int64), np.repeat(np.arange(len(n)), n + 2)
        may[at, : len(flat.TAGS)] = (tables[0][1] > 0)[word]
        gold[at] = t.tag
        for place, mark in ((first, size - 2), (first + n + 1, size - 1)):
            may[place, mark], gold[place] = 1, mark
        here = np.flatnonzero(sent[: places - order + 1] == sent[order - 1 :])
        if order == 3:
            here = here[n[sent[here]] > 1]
        sums, right = np.zeros(size**order, np.int64), np.zeros(size**order, np.int64)
        for a in range(0, len(here), 1 << 15):
            some = here[a : a + (1 << 15)]
            left, own = may[some], gold[some]
            for k in range(1, order - 1):
                left = (left[:, :, None] * may[some + k][:, None]).reshape(len(some), -1)
            for k in range(1, order):
                own = own * size + gold[some + k]
            sums += np.rint(left.T @ may[some + order - 1]).astype(np.int64).ravel()
            right += np.bincount(own, minlength=size**order)
        there = np.flatnonzero(sums)
        tags = pa.array(names)
        return [*[tags.take(pa.array(there // size ** (order - 1 - k) % size)) for k in range(order)], sums[there], right[there]]

    keys = [f"t{k}" for k in range(1, order + 1)]
    found = with_sums(docs, _tag_counts, finish, ", ".join([*[f"{k} string" for k in keys], "n bigint", "n_gold bigint"]))
    return found.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("n_gold").alias("n_gold"))


def bigram_rows(docs: DataFrame) -> DataFrame:
    """doc_id, sent_id, tok_id, t1, t2, gold: `corpus.bigram_parts` of all tags that words have anywhere; none of a null doc_id, which
    no join would meet. A token's parts leave the task as one list of codes."""
    k = len(flat.TAGS)

    def finish(t: flat.Tokens, tables: list[Counts], word: np.ndarray) -> list:
        may = tables[0][1] > 0
        code = np.where(may.any(1), may @ (1 << np.arange(k)), 0)[word]  # the word's tags as bits
        sets, there = np.unique(np.stack([code[:-1], code[1:]], 1) if len(code) else np.zeros((0, 2), np.int64), axis=0, return_inverse=True)
        bits = (sets[:, :, None] >> np.arange(k)) & 1
        both = [np.flatnonzero(np.outer(a, b)) for a, b in bits]  # parts of two sets of tags, as tag before x k + tag
        size = np.array([len(x) for x in both], np.int64)
        parts, start = np.concatenate([*both, np.zeros(0, np.int64)]).astype(np.int32), np.cumsum(size) - size
        token = np.flatnonzero((t.at > 1) & ~t.ids.is_null().to_numpy(zero_copy_only=False)[t.sent])
        of = there.reshape(-1)[token - 1]
        ends = np.append(0, np.cumsum(size[of]))
        flatly = parts[np.arange(ends[-1]) + np.repeat(start[of] - ends[:-1], size[of])]
        own = np.repeat(t.tag[token - 1].astype(np.int32) * k + t.tag[token], size[of])
        codes = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(flatly * 2 + (flatly == own), pa.int32()))
        sent = t.sent[token]
        return [t.ids.take(pa.array(sent)), pa.array(t.sent_id[sent], pa.int32()), pa.array(t.at[token], pa.int32()), codes]

    found = with_sums(docs, _tag_counts, finish, "doc_id bigint, sent_id int, tok_id int, codes array<int>")
    tags = F.array(*[F.lit(x) for x in flat.TAGS])
    rows = found.select("doc_id", "sent_id", "tok_id", F.explode("codes").alias("x"))
    part = F.shiftright("x", 1)
    return rows.select("doc_id", "sent_id", "tok_id", F.get(tags, F.floor(part / k).cast("int")).alias("t1"), F.get(tags, part % k).alias("t2"), F.col("x").bitwiseAND(F.lit(1)).alias("gold"))


# --- scores of the tagger's features by counts ----------------------------------------------------------------------


def flag_bits(words: pa.Array) -> np.ndarray:
    """`functions.text.flag_bits` of words."""
    has = lambda pattern: pc.match_substring_regex(words, pattern).to_numpy(zero_copy_only=False)
    upper = has("[A-Z]")
    tests = [has("[0-9]"), has("^[0-9]+$"), upper, has("^[A-Z]+$"), has("^[A-Z]"), upper & has("[a-z]"), has("-"), has(r"\."), has(r"^\p{P}+$")]
    return sum(x.astype(np.int64) << i for i, x in enumerate(tests))


def affixes(words: pa.Array, most: int = 4) -> list[tuple[str, pa.Array]]:
    """Templates and values of prefixes and suffixes of 1 to most code points; null where a word is shorter."""
    length = pc.utf8_length(words)
    out = []
    for name, cut in (("p", lambda n: pc.utf8_slice_codeunits(words, 0, n)), ("s", lambda n: pc.utf8_slice_codeunits(words, -n))):
        out += [(f"{name}{n}", pc.if_else(pc.greater_equal(length, n), cut(n), None)) for n in range(1, most + 1)]
    return out


_STEPS = (-1, 1, -2, 2)


def _feature_counts(t: flat.Tokens) -> tuple[list[Counts], tuple]:
    """Tags of the tokens that have a word themselves (elsewhere than first, first) or beside them, and of those with other features."""
    k = len(flat.TAGS)
    words = t.form.dictionary_encode()
    forms = pa.concat_arrays([words.dictionary, pa.array([START, STOP], words.dictionary.type)])
    coded = forms.dictionary_encode()  # a word may look like a mark
    forms, same = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    word = same[words.indices.to_numpy()]
    tag, n = t.tag.astype(np.int64), np.repeat(np.diff(t.offset), np.diff(t.offset))
    near = [word]
    for step in _STEPS:
        there = np.clip(np.arange(len(word)) + step, 0, max(len(word) - 1, 0))
        near.append(np.where(t.at + step < 1, same[-2], np.where(t.at + step > n, same[-1], word[there])))
    first = t.at == 1
    count = lambda w, tags: np.bincount(w * k + tags, minlength=len(forms) * k).reshape(-1, k)
    own = [count(word[~first], tag[~first]), count(word[first], tag[first])]
    counts = np.concatenate([*own, *[count(w, tag) for w in near[1:]]], axis=1)
    # Features of a word that many words share: with each, the words' rows.
    bits = flag_bits(forms)
    values = [*affixes(forms), ("flags", pa.array(bits).cast(forms.type)), ("flags", pa.array(bits & NO_CAPITALS).cast(forms.type)), ("bias", pa.array([""] * len(forms), forms.type))]
    named = pa.concat_arrays([pc.binary_join_element_wise(pa.scalar(name, forms.type), v, pa.scalar(":", forms.type)) for name, v in values]).dictionary_encode()
    place = pc.fill_null(named.indices, -1).to_numpy().astype(np.int64).reshape(len(values), len(forms))
    shared = np.zeros((len(named.dictionary) + 1, k), np.int64)
    sides = [own[0] + own[1]] * 8 + [own[0], own[1], own[0] + own[1]]
    for at, side in zip(place, sides, strict=True):
        for j in range(k):
            shared[:, j] += np.bincount(np.where(at < 0, len(shared) - 1, at), side[:, j], len(shared)).astype(np.int64)
    return [(forms, counts), (named.dictionary, shared[:-1])], (near, place, first)


def count_scores(docs: DataFrame) -> DataFrame:
    """doc_id, sent_id, tok_id, label, score: each token's best tag by how often its features (`learn.TAGGER`) had the tag in the corpus;
    of equal ones the first."""
    k = len(flat.TAGS)
    if [x for x, _ in TAGGER] != ["bias", "w", "w-1", "w+1", "w-2", "w+2", *[f"p{n}" for n in range(1, 5)], *[f"s{n}" for n in range(1, 5)], "flags"]:
        raise ValueError("the tagger has other templates")

    def finish(t: flat.Tokens, tables: list[Counts], more: tuple) -> list:
        (_, counts), (_, shared) = tables
        near, place, first = more
        shared = np.append(shared, np.zeros((1, k), np.int64), axis=0)  # the last row is that of features a word lacks
        own = counts[:, :k] + counts[:, k : 2 * k] + sum(shared[p] for p in [*place[:8], place[10]])
        sides = np.stack([own + shared[place[8]], own + shared[place[9]]])
        score = sides[first.astype(np.int64), near[0]]
        for j, w in enumerate(near[1:], 2):
            score += counts[:, j * k : (j + 1) * k][w]
        label = score.argmax(1)
        return [t.ids.take(pa.array(t.sent)), pa.array(t.sent_id[t.sent], pa.int32()), pa.array(t.at, pa.int32()), pa.array(flat.TAGS).take(pa.array(label)), score[np.arange(len(label)), label]]

    return with_sums(docs, _feature_counts, finish, "doc_id bigint, sent_id int, tok_id int, label string, score bigint")
