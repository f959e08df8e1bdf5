"""Antecedents inside document rows: every mention meets all mentions before it, and pairs are scored in blocks, never rows.

`rows` are document rows (`document_rows`): doc_id and arrays over its mentions in order. A mention takes its best antecedent or none
and entities are the chains; with gold entities a log-linear model learns from all antecedents of the same entity at once (they
are latent), with costs for each kind of mistake added to wrong choices while it learns.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs that are scored at once.
PAIRS = 1 << 18
BITS = 16


@dataclass
class Mentions:
    """A document's mentions; columns by name, numbers as arrays and others as lists."""

    doc_id: int | None
    columns: dict[str, np.ndarray]
    #: What `Pairs` has found out of all mentions.
    known: tuple | None = None

    def __len__(self) -> int:
        return len(next(iter(self.columns.values())))

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """k, j and a mask of those j before k: matrices of some mentions k with all up to the last of them."""
        n, a = len(self), 0
        while a < n:
            z = min(n, a + max(1, PAIRS // max(a, 1)) if a else min(n, 512))
            k, j = np.arange(a, z)[:, None], np.arange(z)[None]
            yield k, j, j < k
            a = z


#: The scores of pairs j before k (matrices of places), and of having no antecedent by place.
PairScore = Callable[[Mentions, np.ndarray, np.ndarray], np.ndarray]
NewScore = Callable[[Mentions], np.ndarray]


def silver_pair(d: Mentions, j: np.ndarray, k: np.ndarray) -> np.ndarray:
    """A rule over positions: whole numbers, exact in any engine."""
    start = d.columns["start"]
    return ((start[j] * 7 + start[k] * 13 + (d.doc_id or 0)) % 17 - np.minimum(10, k - j)).astype(np.float64)


def silver_new(d: Mentions) -> np.ndarray:
    return np.full(len(d), 4.0)


def document_rows(mentions: DataFrame, *columns: str) -> DataFrame:
    """doc_id, and arrays sent_id, start and the columns of its mentions in the order of ord."""
    names = ["sent_id", "start", *columns]
    packed = mentions.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", *names))).alias("m"))
    return packed.select("doc_id", *[F.col(f"m.{c}").alias(c) for c in names])


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[Mentions]:
    for b in batches:
        ids = b.column("doc_id").to_pylist()
        lists = {c: b.column(c) for c in b.schema.names if c != "doc_id"}
        for i, doc in enumerate(ids):
            values = {c: v[i].values for c, v in lists.items()}
            yield Mentions(doc, {c: v.to_numpy().astype(np.int64) if pa.types.is_integer(v.type) else np.array(v.to_pylist(), object) for c, v in values.items()})


def chosen(d: Mentions, pair: PairScore, new: NewScore) -> np.ndarray:
    """Each mention's best antecedent as a place, -1 for none; of equal ones the nearest, and any before none."""
    out, alone = np.full(len(d), -1), new(d)
    for k, j, before in d.blocks():
        s = np.where(before, pair(d, j, k), -np.inf)
        last = s.shape[1] - 1 - s[:, ::-1].argmax(1)
        at = k[:, 0]
        out[at] = np.where(s[np.arange(len(s)), last] >= alone[at], last, -1)
    return out


def chain_starts(antecedent: np.ndarray) -> np.ndarray:
    """The first mention of each mention's chain, by jumps of doubling length."""
    at = np.where(antecedent < 0, np.arange(len(antecedent)), antecedent)
    while (at[at] != at).any():
        at = at[at]
    return at


def entity_clusters(rows: DataFrame, pair: PairScore = silver_pair, new: NewScore = silver_new) -> DataFrame:
    """doc_id, k, antecedent (0: none), entity: mentions by their number, their antecedents and the first of their chains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d in _documents(batches):
            best = chosen(d, pair, new)
            n = len(best)
            yield pa.RecordBatch.from_arrays([pa.array([d.doc_id] * n, pa.int64()), *[pa.array(v.astype(np.int32)) for v in (np.arange(1, n + 1), best + 1, chain_starts(best) + 1)]], names=["doc_id", "k", "antecedent", "entity"])

    return rows.mapInArrow(run, "doc_id bigint, k int, antecedent int, entity int")


def right_antecedents(rows: DataFrame, pair: PairScore = silver_pair, new: NewScore = silver_new) -> DataFrame:
    """doc_id, n, n_right: mentions, and those whose antecedent is of their entity or that have none and start their entity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d in _documents(batches):
            best = chosen(d, pair, new)
            _, first, entity = np.unique(d.columns["entity"], return_index=True, return_inverse=True)
            right = np.where(best < 0, first[entity] == np.arange(len(best)), entity[best] == entity)
            yield pa.RecordBatch.from_arrays([pa.array([d.doc_id], pa.int64()), *[pa.array([int(x)], pa.int64()) for x in (len(best), right.sum())]], names=["doc_id", "n", "n_right"])

    return rows.mapInArrow(run, "doc_id bigint, n bigint, n_right bigint")


def pair_distances(rows: DataFrame, pair: PairScore = silver_pair, new: NewScore = silver_new, most: int = 10) -> DataFrame:
    """mentions, sentences (both at most `most`; 0 and 0 for no antecedent), n, score: all pairs of mentions by their distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = (np.zeros((most + 1) ** 2, kind) for kind in (np.int64, np.float64))
        for d in _documents(batches):
            counts[0] += len(d)
            sums[0] += new(d).sum()
            for k, j, before in d.blocks():
                sent = d.columns["sent_id"]
                code = (np.minimum(most, k - j) * (most + 1) + np.minimum(most, sent[k] - sent[j]))[before]
                counts += np.bincount(code, minlength=len(counts))
                sums += np.bincount(code, pair(d, j, k)[before], len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([*[pa.array(v.astype(np.int32)) for v in np.divmod(at, most + 1)], pa.array(counts[at]), pa.array(sums[at])], names=["mentions", "sentences", "n", "score"])

    parts = rows.mapInArrow(run, "mentions int, sentences int, n bigint, score double")
    return parts.groupBy("mentions", "sentences").agg(F.sum("n").alias("n"), F.sum("score").cast("long").alias("score"))


# --- latent antecedents ---------------------------------------------------------------------------------------------

#: Costs of choices while learning: a link of a mention that starts an entity, none for one that doesn't, a link to another entity.
COSTS = {"false link": 0.2, "false new": 3.0, "wrong link": 1.0}
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _code(d: Mentions, name: str) -> np.ndarray:
    values = d.columns[name]
    return values.astype(np.uint64) if values.dtype != object else np.array([zlib.crc32(str(v).encode()) for v in values], np.uint64)


def _row(*codes: np.ndarray | int, bits: int) -> np.ndarray:
    x = np.uint64(0)
    for c in codes:
        x = (x ^ np.asarray(c, np.uint64)) * _ODD
        x = x ^ (x >> np.uint64(29))
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def pair_features(d: Mentions, j: np.ndarray, k: np.ndarray, bits: int = BITS) -> np.ndarray:
    """[..., features]: rows of a model for pairs of places; columns head (the last form) and kind must be there."""
    head, kind, sent = _code(d, "head"), _code(d, "kind"), d.columns["sent_id"]
    far = np.searchsorted([1, 2, 3, 4, 6, 10, 20], k - j, side="right")
    apart = np.searchsorted([0, 1, 2, 5, 10], sent[k] - sent[j], side="right")
    same, kinds = (head[j] == head[k]).astype(np.uint64), kind[j] * np.uint64(31) + kind[k]
    with np.errstate(over="ignore"):
        found = [(1, same), (2, far), (3, apart), (4, kinds), (5, same, far), (6, same, kinds), (7, head[j], head[k]), (8, head[k], far)]
        return np.stack([np.broadcast_to(_row(*f, bits=bits), np.broadcast_shapes(j.shape, k.shape)) for f in found], -1)


def new_features(d: Mentions, bits: int = BITS) -> np.ndarray:
    """[mentions, features] of having no antecedent."""
    head, kind, at = _code(d, "head"), _code(d, "kind"), np.arange(len(d))
    first = np.searchsorted([1, 2, 5, 20], at, side="right")
    with np.errstate(over="ignore"):
        return np.stack([np.broadcast_to(_row(*f, bits=bits), at.shape) for f in ((11, 0), (12, kind), (13, head), (14, first))], -1)


class Pairs:
    """The features of a matrix of pairs (`pair_features`) by what they depend on: a code of few values (the first six), the two
    heads, and the later head with the distance. Rows of the model are made once for each value, not for each pair."""

    def __init__(self, d: Mentions, j: np.ndarray, k: np.ndarray, bits: int = BITS):
        """k: a column of places, j: a row of places."""
        if d.known is None:
            heads, head = np.unique(_code(d, "head"), return_inverse=True)
            kinds, kind = np.unique(_code(d, "kind"), return_inverse=True)
            d.known = heads, head, kinds, kind, np.searchsorted([1, 2, 3, 4, 6, 10, 20], np.arange(len(d)), side="right")
        heads, head, kinds, kind, far_of = d.known
        k, j, sent, n = k[:, 0], j[0], d.columns["sent_id"], len(kinds)
        far = np.where(k[:, None] > j, far_of[np.abs(k[:, None] - j)], 0)
        apart = np.searchsorted([0, 1, 2, 5, 10], sent[k][:, None] - sent[j], side="right")
        same = head[j] == head[k][:, None]
        self.code = ((same * 8 + far) * 6 + apart) * (n * n) + (kind[j] * n + kind[k][:, None])
        same, far_, apart, kind = np.unravel_index(np.arange(2 * 8 * 6 * n * n), (2, 8, 6, n * n))
        some, own = np.unique(head[k], return_inverse=True)
        self.heads = own[:, None] * len(heads) + head[j]
        self.late = np.arange(len(k))[:, None] * 8 + far
        with np.errstate(over="ignore"):
            kind = kinds[kind // n] * np.uint64(31) + kinds[kind % n]
            same = same.astype(np.uint64)
            found = [(1, same), (2, far_), (3, apart), (4, kind), (5, same, far_), (6, same, kind)]
            self.by_code = [_row(*f, bits=bits) for f in found]
            self.by_heads = _row(7, heads[None], heads[some][:, None], bits=bits).ravel()
            self.by_late = _row(8, heads[head[k]][:, None], np.arange(8)[None], bits=bits).ravel()

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Sums of the pairs' weights, in the order that numpy adds up eight numbers."""
        w = [weights[x] for x in self.by_code]
        out = (w[4] + w[5])[self.code] + (weights[self.by_heads][self.heads] + weights[self.by_late][self.late])
        return ((w[0] + w[1]) + (w[2] + w[3]))[self.code] + out

    def add(self, slope: np.ndarray, used: np.ndarray, gap: np.ndarray) -> None:
        """Adds the gaps of used pairs to the slope of their features."""
        gap = gap[used]
        for at, rows in ((self.code, self.by_code), (self.heads, [self.by_heads]), (self.late, [self.by_late])):
            sums = np.bincount(at[used], gap, len(rows[0]))
            some = np.flatnonzero(sums)
            for row in rows:
                np.add.at(slope, row[some], sums[some])


def loss_and_slope(weights: np.ndarray, d: Mentions, bits: int = BITS, costs: dict[str, float] = COSTS) -> tuple[float, np.ndarray]:
    """Of a document with gold entities (column entity): log of all choices' weight, wrong ones raised by their costs, less that of the
    right ones (earlier mentions of the entity, or none if there are none); and its slope by weights."""
    entity, slope, loss = _code(d, "entity"), np.zeros_like(weights), 0.0
    none = new_features(d, bits)
    alone = weights[none].sum(1)
    for k, j, before in d.blocks():
        at = k[:, 0]
        pairs = Pairs(d, j, k, bits)
        s = np.where(before, pairs.scores(weights), -np.inf)
        right = before & (entity[j] == entity[k])
        old = right.any(1)
        cost = np.where(right, 0.0, np.where(old[:, None], costs["wrong link"], costs["false link"]))
        every = np.concatenate([(alone[at] + np.where(old, costs["false new"], 0.0))[:, None], s + cost], axis=1)
        gold = np.concatenate([np.where(old, -np.inf, alone[at])[:, None], np.where(right, s, -np.inf)], axis=1)
        share = []
        for x, sign in ((every, 1), (gold, -1)):
            top = x.max(1, keepdims=True)
            e = np.exp(x - top)
            loss += sign * float((top[:, 0] + np.log(e.sum(1))).sum())
            share.append(e / e.sum(1, keepdims=True))
        gap = share[0] - share[1]
        used = np.abs(gap[:, 1:]) > 1e-12
        pairs.add(slope, used, gap[:, 1:])
        np.add.at(slope, none[at], gap[:, :1])
    return loss, slope


def trained(rows: DataFrame, rounds: int = 2, learners: int | None = None, rate: float = 0.5, bits: int = BITS, costs: dict[str, float] = COSTS) -> np.ndarray:
    """Weights by iterative mixing over documents with columns head, kind and entity; each learner takes its documents in order."""
    spark = rows.sparkSession
    parts = learners or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "doc_id").sortWithinPartitions("doc_id")
    weights = np.zeros(1 << bits)
    for _ in range(rounds):
        start = spark.sparkContext.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            w, seen, squares = start.value.copy(), 0, np.full(1 << bits, 1e-2)
            for d in _documents(batches):
                _, slope = loss_and_slope(w, d, bits, costs)
                squares += slope**2
                w -= rate * slope / np.sqrt(squares)
                seen += 1
            if seen:
                used = np.flatnonzero(w)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1).astype(np.int32)), pa.array(np.append(w[used], 1.0))], names=["row", "w"])

        sums = dealt.mapInArrow(run, "row int, w double").groupBy("row").agg(F.sum("w").alias("w")).toArrow()  # at most 2^bits rows and one
        row, values = sums["row"].to_numpy(), sums["w"].to_numpy()
        start.destroy()
        if not len(row):
            return weights
        weights = np.zeros(1 << bits)
        weights[row[row >= 0]] = values[row >= 0] / values[row == -1][0]
    return weights


def scorers(rows: DataFrame, weights: np.ndarray) -> tuple[PairScore, NewScore]:
    """Scores by a model, which is sent once."""
    model, bits = rows.sparkSession.sparkContext.broadcast(weights), int(len(weights)).bit_length() - 1
    return (lambda d, j, k: Pairs(d, j, k, bits).scores(model.value)), (lambda d: model.value[new_features(d, bits)].sum(1))
