"""Several online learners of sequence taggers in step: each sees its own sentences in order, and what they do with their next
sentences is done at once. Each learns what a `learn.SequenceLearner` of its own learns, but for the order of sums.
"""

from __future__ import annotations

import numpy as np

from glossa.operators.decode import sequence_marginals, viterbi
from glossa.operators.learn import BITS, SequenceLearner


class Step:
    """Tokens of some sentences, longest first, place after place: those of a place are neighbours, in the order of sentences."""

    def __init__(self, sizes: np.ndarray, of: np.ndarray):
        """of: each token's sentence."""
        self.many, self.n, self.of, self.sizes = len(sizes), len(of), of, sizes
        self.active = np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left")
        start = np.cumsum(self.active) - self.active
        self.last = start[sizes - 1] + np.arange(self.many)
        #: The token before each token but the first ones.
        self.before = np.arange(self.many, self.n) - np.repeat(self.active[:-1], self.active[1:])
        self.starts, self.active = start.tolist(), self.active.tolist()
        #: The first place that only the longest sentence has.
        self.alone = next((i for i, m in enumerate(self.active) if m == 1), len(self.active))

    def tail(self, place: int) -> slice:
        """Tokens of the longest sentence from a place on that only it has."""
        return slice(self.starts[place], self.n)


def best_tags(s: Step, scores: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`decode.viterbi` of each sentence, with pair[sentences, k, k]: tags of the tokens, and the sentences' scores."""
    k = scores.shape[1]
    into, steps, best, tags = np.ascontiguousarray(pair.swapaxes(1, 2)), np.empty((s.n, k, k)), scores.copy(), np.empty(s.n, np.int64)
    stop = max(s.alone, 1)
    score = best[: s.many]
    for i in range(1, min(stop, len(s.active))):
        m, a = s.active[i], s.starts[i]
        np.add(into[:m], score[:m, None, :], out=steps[a : a + m])
        score = best[a : a + m]
        score += np.maximum.reduce(steps[a : a + m], 2)
    value = best[s.last]
    tags[s.last] = value.argmax(1)
    value = value.max(1)
    if stop < len(s.active):
        at = s.starts[stop - 1]
        path, value[0] = viterbi(np.concatenate([best[at : at + 1], scores[s.tail(stop)]]), pair[0])
        tags[s.tail(stop)], tags[at] = path[1:], path[0]
    end = s.starts[stop] if stop < len(s.active) else s.n
    back = steps[s.many : end].argmax(2)
    for i in range(min(stop, len(s.active)) - 1, 0, -1):
        m, a, b = s.active[i], s.starts[i], s.starts[i - 1]
        tags[b : b + m] = back[np.arange(a - s.many, a - s.many + m), tags[a : a + m]]
    return tags, value


def marginals(s: Step, scores: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`decode.sequence_marginals` of each sentence, with pair[sentences, k, k]."""
    top, most = scores.max(1), pair.max((1, 2))
    spread, wide = float((top - scores.min(1)).max()), float((most - pair.min((1, 2))).max())
    k = scores.shape[1]
    if not spread + wide < 300:
        node, edge, logz = np.empty(scores.shape), np.empty(pair.shape), np.empty(s.many)
        for j in range(s.many):
            own = np.flatnonzero(s.of == j)
            node[own], edge[j], logz[j] = sequence_marginals(scores[own], pair[j])
        return node, edge, logz
    every = max(1, int((600 - spread - wide) / (wide + 3)))
    logz = np.bincount(s.of, top, s.many) + (s.sizes - 1) * most
    u = np.exp(scores - top[:, None])
    arcs = np.exp(pair - most[:, None, None])[s.of[s.many :]] * u[s.many :, None, :]
    ahead, behind = u.copy(), np.ones((s.n, k))
    v = ahead[: s.many]
    for i in range(1, len(s.active)):
        m, a, b = s.active[i], s.starts[i], s.starts[i] - s.many
        v = v[0].dot(arcs[b])[None] if m == 1 else np.matmul(v[:m, None, :], arcs[b : b + m])[:, 0]
        if i % every == 0:
            size = v.sum(1)
            logz[:m] += np.log(size)
            v = v / size[:, None]
        ahead[a : a + m] = v
    for i in range(len(s.active) - 2, -1, -1):
        m, a, b, c = s.active[i + 1], s.starts[i], s.starts[i + 1] - s.many, s.starts[i + 1]
        v = arcs[b].dot(behind[c])[None] if m == 1 else np.matmul(arcs[b : b + m], behind[c : c + m, :, None])[:, :, 0]
        if i % every == 0:
            v = v / v.sum(1, keepdims=True)
        behind[a : a + m] = v
    logz += np.log(ahead[s.last].sum(1))
    node = ahead * behind
    node /= node.sum(1, keepdims=True)
    both = arcs * (ahead[s.before][:, :, None] * behind[s.many :, None, :])
    both /= both.sum((1, 2), keepdims=True)
    edge = np.zeros(pair.shape)
    if len(both):
        order = s.of[s.many :].argsort(kind="stable")
        count = s.sizes[s.sizes > 1] - 1
        edge[: len(count)] = np.add.reduceat(both[order], np.cumsum(count) - count, axis=0)
    return node, edge, logz


class Lockstep:
    """Learners with the options of `SequenceLearner`, whose models are w[learner x 2^bits + row] and pair[learner]."""

    def __init__(self, learners: int, k: int, algorithm: str = "perceptron", bits: int = BITS, **how):
        self.how = SequenceLearner(k, algorithm, bits=0, **how)
        self.learners, self.k, self.bits = learners, k, bits
        self.w, self.pair = np.zeros((learners << bits, k)), np.zeros((learners, k, k))
        averaged = self.how.step != "sgd"
        self.sums, self.pair_sum = np.zeros(self.w.shape if averaged else (0, k)), np.zeros(self.pair.shape)
        self.scale, self.t = np.ones(learners), np.zeros(learners, np.int64)

    def start(self, weights: np.ndarray, pair: np.ndarray) -> None:
        """All start from one model."""
        self.w.reshape(self.learners, *weights.shape)[:], self.pair[:] = weights, pair

    def fit(self, ids: np.ndarray, gold: np.ndarray, offset: np.ndarray, who: np.ndarray) -> None:
        """Steps on sentences, who's learner by learner in their order. ids[tokens, templates]: -1 for a feature that a token lacks."""
        n = np.diff(offset)
        if not len(n):
            return
        by = who.argsort(kind="stable")
        count = np.bincount(who, minlength=self.learners)
        step = np.empty(len(n), np.int64)
        step[by] = np.arange(len(n)) - np.repeat(np.cumsum(count) - count, count)
        order = np.lexsort((-n, step))
        step, n, who = step[order], n[order], who[order]
        seq = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(seq)) - np.repeat(np.cumsum(n) - n, n)
        at = np.lexsort((seq, place, step[seq]))
        tokens = (offset[order][seq] + place)[at]
        seq, ids, gold = seq[at], ids[tokens], gold[tokens]
        real = ids >= 0
        flatly, counts = (ids + (who[seq] << self.bits)[:, None])[real], real.sum(1)
        ends = np.append(0, np.cumsum(counts))
        firsts = np.searchsorted(step, np.arange(int(step[-1]) + 2))
        bounds = np.append(0, np.cumsum(n))[firsts].tolist()
        for p, q, a, z in zip(firsts[:-1].tolist(), firsts[1:].tolist(), bounds[:-1], bounds[1:], strict=True):
            self._update(Step(n[p:q], seq[a:z] - p), who[p:q], flatly[ends[a] : ends[z]], counts[a:z], ends[a:z] - ends[a], gold[a:z])

    def _update(self, s: Step, who: np.ndarray, ids: np.ndarray, counts: np.ndarray, first: np.ndarray, gold: np.ndarray) -> None:
        k, how, of, later = self.k, self.how, s.of, s.of[s.many :]
        if counts.all():
            unary = np.add.reduceat(self.w.take(ids, 0), first, axis=0)
        else:
            unary = np.zeros((s.n, k))
            np.add.at(unary, np.repeat(np.arange(s.n), counts), self.w[ids])
        pair, places = self.pair[who], np.arange(s.n)
        if how.step == "sgd":
            unary, pair = unary * self.scale[who][of, None], pair * self.scale[who][:, None, None]
        scores = unary
        if how.costs:
            scores = unary + 0.5
            scores[places, gold] = unary[places, gold] - 0.5
        pairs = lambda tags: np.bincount((later * k + tags[s.before]) * k + tags[s.many :], minlength=s.many * k * k).reshape(s.many, k, k).astype(np.float64)
        right = pairs(gold)
        if how.guess == "marginals":
            node, edge, value = marginals(s, scores, pair)
            node, edge = -node, right - edge
        else:
            tags, value = best_tags(s, scores, pair)
            node, edge = np.zeros((s.n, k)), right - pairs(tags)
            node[places, tags] = -1
        node[places, gold] += 1
        eta = np.ones(s.many)
        if how.step == "sgd":
            eta = how.rate * how.schedule(self.t[who].astype(float), how.sentences)
            eta = np.full(s.many, eta) if np.ndim(eta) == 0 else eta
            if (eta * how.decay >= 1).any():
                raise ValueError("the rate times the decay must stay below 1")
            self.scale[who] *= 1 - eta * how.decay
            for g in who[self.scale[who] < 1e-9]:
                self.w[g << self.bits : (g + 1) << self.bits] *= self.scale[g]
                self.pair[g] *= self.scale[g]
                self.scale[g] = 1.0
        self.t[who] += 1
        wrong = node.any(1)  # features of right guesses keep their weights
        if not wrong.any():
            return
        own = np.repeat(places, counts)
        if not wrong.all():
            some = wrong[own]
            ids, own = ids[some], own[some]
        if how.step == "mira":
            loss = value + (0.5 * s.sizes if how.costs else 0.0) - np.bincount(of, unary[places, gold], s.many) - (right * pair).sum((1, 2))
            norm = (edge**2).sum((1, 2))
            if len(ids):
                order = ids.argsort()
                rows = ids[order]
                begin = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
                delta = np.add.reduceat(node[own[order]], begin, axis=0)
                norm += np.bincount(of[own[order[begin]]], (delta**2).sum(1), s.many)
            some = (norm > 1e-9) & (loss > 1e-9)
            eta = np.where(some, np.minimum(how.c, loss / np.where(some, norm, 1.0)), 0.0)
        eta = eta / self.scale[who]
        at, parts = (ids[:, None] * k + np.arange(k)).ravel(), (eta[of, None] * node).take(own, 0)
        np.add.at(self.w.reshape(-1), at, parts.ravel())
        edge = eta[:, None, None] * edge
        self.pair[who] += edge
        if how.step != "sgd":
            np.add.at(self.sums.reshape(-1), at, (self.t[who][of][own][:, None] * parts).ravel())
            self.pair_sum[who] += self.t[who][:, None, None] * edge

    def totals(self) -> tuple[np.ndarray, np.ndarray, int]:
        """Sums of the models (`SequenceLearner.result`) of the learners that saw a sentence, and their number."""
        weights, pair = np.zeros((1 << self.bits, self.k)), np.zeros((self.k, self.k))
        for g in np.flatnonzero(self.t).tolist():
            of = slice(g << self.bits, (g + 1) << self.bits)
            weights += self.w[of] * self.scale[g] - (self.sums[of] / (self.t[g] + 1) if len(self.sums) else 0.0)
            pair += self.pair[g] * self.scale[g] - (self.pair_sum[g] / (self.t[g] + 1) if len(self.sums) else 0.0)
        return weights, pair, int((self.t > 0).sum())
