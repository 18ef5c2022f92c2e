"""Masked pseudo-likelihood scores from a bidirectional window network trained in numpy.

Tokens are words hashed to BUCKETS numbers. Each has one of CLASSES classes: the most frequent numbers have one of their
own. The others share the rest by use: each number sums random signs of its neighbours over the whole corpus, SIGNS of the
one before and SIGNS of the one after, and the numbers are halved again and again by equal shares of the tokens, across the
main axis of their means. A token's conditional probability is
    p(token | both sides) = p(class | two tokens before, two after) * p(token | class).
The first factor is a network: the sum of one embedding a place, tanh, a softmax over the classes; the token itself is
masked. The second comes from the counts of all tokens of the corpus (add-one). A document's score is the sum of the
conditional log-probabilities of every token, and its mean.

Counts are gathered from every token of every document. The network is trained by parameter averaging: each task trains
a copy of the same first weights on every token of all its documents, in order, and the copies are averaged
by their numbers of tokens; both gather more as the corpus grows, while the driver gets a fixed size: BUCKETS
rows of a count and 2 * SIGNS sums (18 MB), and the averaged weights. Sums are over integers (weights in fixed point), so their order changes nothing.

Defined results: a null text, or one without words, has n_tokens 0, logp 0 and a null mean. Equal texts have equal
scores. Rows that repeat count each time. An empty table gives an empty result. An added column whose name is
taken has an underscore put after it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MULT, added_fields, map_arrow, mix64, slices, text_buffer, words_of

BUCKETS = 1 << 17
CLASSES = 256
OWN = 128
SIGNS = 8
#: A number's mean is drawn to the corpus mean as if that had been seen so often.
PRIOR = 4
HIDDEN = 24
PLACES = (-2, -1, 1, 2)
BATCH = 256
RATE = 0.5
_FIXED = float(1 << 24)
PAD = CLASSES  # the class of the places outside a text


@dataclass
class Vocabulary:
    class_of: np.ndarray  # bucket -> class
    logp_in_class: np.ndarray  # bucket -> log p(token | class)
    class_logp: np.ndarray  # log share of each class


def halved(x: np.ndarray, weight: np.ndarray, parts: int) -> np.ndarray:
    """Labels 0 to parts - 1 (a power of two) of the rows of x: halves of equal weight across the main axis, again and again."""
    label = np.zeros(len(x), np.int64)
    if parts < 2 or not len(x):
        return label
    off = x - np.average(x, axis=0, weights=weight)
    axis = np.linalg.eigh((off * weight[:, None]).T @ off)[1][:, -1]
    axis *= np.sign(axis[np.argmax(np.abs(axis))])
    order = np.argsort(off @ axis, kind="stable")
    total = np.cumsum(weight[order])
    cut = int(np.searchsorted(total, total[-1] / 2)) + 1
    for k, at in enumerate((order[:cut], order[cut:])):
        at = np.sort(at)
        label[at] = k * parts // 2 + halved(x[at], weight[at], parts // 2)
    return label


def vocabulary(counts: np.ndarray, near: np.ndarray) -> Vocabulary:
    """near: of each bucket the sums of its neighbours' signs."""
    top = np.lexsort((np.arange(BUCKETS), -counts))[:OWN]
    rest = np.setdiff1d(np.arange(BUCKETS), top)
    mean = near.sum(0) / max(int(counts.sum()), 1)
    cls = np.empty(BUCKETS, np.int16)
    cls[top] = np.arange(OWN)
    cls[rest] = OWN + halved((near[rest] + PRIOR * mean) / (counts[rest, None] + PRIOR), counts[rest] + 1.0, CLASSES - OWN)
    c = counts + 1.0
    per = np.bincount(cls, c, CLASSES)
    return Vocabulary(cls, np.log(c / per[cls]).astype(np.float32), np.log(per / per.sum()).astype(np.float32))


@dataclass
class Network:
    emb: np.ndarray  # places x (classes + pad) x hidden
    out: np.ndarray  # hidden x classes
    bias: np.ndarray

    @staticmethod
    def first(class_logp: np.ndarray, seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        return Network(rng.normal(0, 0.3, (len(PLACES), CLASSES + 1, HIDDEN)).astype(np.float32), rng.normal(0, 0.1, (HIDDEN, CLASSES)).astype(np.float32), class_logp.copy())

    def flat(self) -> np.ndarray:
        return np.concatenate([self.emb.ravel(), self.out.ravel(), self.bias])

    @staticmethod
    def of(flat: np.ndarray) -> Network:
        a = len(PLACES) * (CLASSES + 1) * HIDDEN
        b = a + HIDDEN * CLASSES
        f = flat.astype(np.float32)
        return Network(f[:a].reshape(len(PLACES), CLASSES + 1, HIDDEN), f[a:b].reshape(HIDDEN, CLASSES), f[b:])

    def hidden(self, ctx: np.ndarray) -> np.ndarray:
        h = self.emb[0][ctx[:, 0]]
        for k in range(1, len(PLACES)):
            h += self.emb[k][ctx[:, k]]
        return np.tanh(h, out=h)

    def log_probs(self, ctx: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log p(target class | context), in blocks."""
        out = np.empty(len(target), np.float32)
        for i in range(0, len(target), 4096):
            t = target[i : i + 4096]
            z = self.hidden(ctx[i : i + 4096]) @ self.out
            z += self.bias
            own = z[np.arange(len(t)), t].copy()
            # |logit| <= HIDDEN * 1.5 + 14 by tanh and the clipped weights, so the sum of exp can't overflow
            np.exp(z, out=z)
            out[i : i + 4096] = own - np.log(z.sum(1))
        return out

    def train(self, ctx: np.ndarray, target: np.ndarray, rate: float = RATE) -> None:
        """One pass of minibatch gradient steps in the given order."""
        emb = self.emb.reshape(-1, HIDDEN)  # a view: all places in one
        top = np.vstack([self.out, self.bias])  # the bias is the weight of a hidden unit that is always 1
        at = ctx + np.arange(len(PLACES), dtype=np.int16) * np.int16(CLASSES + 1)
        ones = np.ones(CLASSES, np.float32)
        for i in range(0, len(target), BATCH):
            c, t = at[i : i + BATCH].T, target[i : i + BATCH]
            m = len(t)
            h = np.ones((m, HIDDEN + 1), np.float32)
            np.tanh(sum(emb.take(x, 0) for x in c), out=h[:, :-1])
            z = h @ top
            e = np.exp(z - z.max())
            total = e @ ones
            if total.min() < 1e-30:  # a row far below the largest logit
                e = np.exp(z - z.max(1, keepdims=True))
                total = e @ ones
            # the gradient by logit is e * step, a row each; it is not formed
            e[np.arange(m), t] -= total
            step = ((rate / m) / total)[:, None]
            back = (e @ top[:-1].T) * (step * 4) * (1 - h[:, :-1] * h[:, :-1])
            top -= (h * step).T @ e
            # rows of an embedding are summed in its order, then subtracted once
            flat = c.ravel()
            order = np.argsort(flat, kind="stable")
            flat = flat[order]
            first = np.flatnonzero(np.diff(flat, prepend=-1))
            emb[flat[first]] -= np.add.reduceat(back.take(order % m, 0), first)
        self.out[:], self.bias[:] = top[:-1], top[-1]
        np.clip(self.emb, -31, 31, out=self.emb)
        np.clip(self.out, -1.5, 1.5, out=self.out)
        np.clip(self.bias, -14, 14, out=self.bias)


def contexts(cls: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The classes at PLACES around each token; PAD outside its text."""
    n = len(cls)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = np.full((n, len(PLACES)), PAD, np.int16)
    for k, d in enumerate(PLACES):
        m = n - abs(d)
        if m <= 0:
            continue
        here, there = (slice(abs(d), None), slice(0, m)) if d < 0 else (slice(0, m), slice(d, None))
        same = row[here] == row[there]
        out[here, k] = np.where(same, cls[there], PAD)
    return out


def buckets_of(buf, offs, lo, hi) -> tuple[np.ndarray, np.ndarray]:
    h, first = words_of(buf, offs, lo, hi)
    return (h >> np.uint64(64 - 17)).astype(np.int64), first


def signs_of() -> np.ndarray:
    """SIGNS random signs of each bucket, a row a sign."""
    h = mix64(np.arange(BUCKETS, dtype=np.uint64) * MULT[3] + MULT[4])
    return np.stack([1.0 - 2.0 * (h >> np.uint64(k) & np.uint64(1)) for k in range(SIGNS)])


def count_buckets(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Counts of all tokens of all documents, and the sums of the signs of those before (SIGNS columns) and after them."""
    names = ["n", *[f"s{k}" for k in range(2 * SIGNS)]]

    def run(batches):
        signs = signs_of()
        total = np.zeros((1 + 2 * SIGNS, BUCKETS), np.int64)
        for b in batches:
            buf, offs, _ = text_buffer(b.column(0))
            for lo, hi in slices(offs):
                at, first = buckets_of(buf, offs, lo, hi)
                total[0] += np.bincount(at, minlength=BUCKETS)
                # pairs of neighbours; none crosses the end of a text
                same = np.ones(max(len(at) - 1, 0), bool)
                ends = first[1:-1]
                same[ends[(ends > 0) & (ends < len(at))] - 1] = False
                one, two = at[:-1][same], at[1:][same]
                for k in range(SIGNS):
                    total[1 + k] += np.bincount(two, signs[k][one], BUCKETS).astype(np.int64)
                    total[1 + SIGNS + k] += np.bincount(one, signs[k][two], BUCKETS).astype(np.int64)
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *[pa.array(t[at]) for t in total]], names=["bucket", *names])

    rows = map_arrow(docs.select(text_col), run, "bucket long, " + ", ".join(f"{c} long" for c in names)).groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names])
    got = rows.toArrow()  # BUCKETS rows at most
    out = np.zeros((BUCKETS, 1 + 2 * SIGNS), np.int64)
    out[got["bucket"].to_numpy()] = np.stack([got[c].to_numpy() for c in names], 1)
    return out[:, 0], out[:, 1:]


def train(docs: DataFrame, text_col: str = "text", stride: int = 1) -> tuple[Vocabulary, Network]:
    sc = docs.sparkSession.sparkContext
    vocab = vocabulary(*count_buckets(docs, text_col))
    shared = sc.broadcast(vocab)

    def run(batches):
        v = shared.value
        net, seen = Network.first(v.class_logp), 0
        for b in batches:
            buf, offs, _ = text_buffer(b.column(0))
            for lo, hi in slices(offs):
                at, first = buckets_of(buf, offs, lo, hi)
                cls = v.class_of[at]
                # every stride-th token; the offset goes on from slice to slice
                pick = np.arange(-seen % stride, len(cls), stride)
                seen += len(cls)
                if len(pick):
                    net.train(contexts(cls, first)[pick], cls[pick])
        if seen:
            w = np.rint(net.flat().astype(np.float64) * _FIXED).astype(np.int64)
            share = max(1, seen // 1024)
            yield pa.RecordBatch.from_pydict({"k": pa.array(np.arange(len(w)), pa.int64()), "w": pa.array(w * share, pa.int64()), "m": pa.array(np.full(len(w), share), pa.int64())})

    # an average in fixed point: w is below 2 ** 29, so 2 ** 34 shares (2 ** 44 tokens) fit
    rows = map_arrow(docs.select(text_col), run, "k long, w long, m long").groupBy("k").agg(F.sum("w").alias("w"), F.sum("m").alias("m"))
    got = rows.toPandas().sort_values("k")  # a row per weight
    if not len(got):
        return vocab, Network.first(vocab.class_logp)
    return vocab, Network.of(got["w"].to_numpy() / got["m"].to_numpy() / _FIXED)


SCORE = "n_tokens long, logp double, mean_logp double"


def score(docs: DataFrame, vocab: Vocabulary, net: Network, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns of `keep` with n_tokens, logp (the sum over all tokens, natural logarithm) and its mean."""
    held = docs.select(*[F.col(c) for c in keep], F.col(text_col).alias("__text"))
    schema = added_fields(SCORE, held.drop("__text").schema)
    shared = docs.sparkSession.sparkContext.broadcast((vocab, net))

    def run(batches):
        v, model = shared.value
        for b in batches:
            buf, offs, _ = text_buffer(b.column(b.num_columns - 1))
            count, total = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            for lo, hi in slices(offs):
                at, first = buckets_of(buf, offs, lo, hi)
                if len(at):
                    cls = v.class_of[at]
                    lp = (model.log_probs(contexts(cls, first), cls) + v.logp_in_class[at]).astype(np.float64)
                    # each row's own sum, so that equal texts get equal scores wherever they stand
                    for i in np.flatnonzero(np.diff(first)).tolist():
                        total[lo + i] = lp[first[i] : first[i + 1]].sum()
                    count[lo:hi] = np.diff(first)
            mean = pa.array(total / np.maximum(count, 1), pa.float64(), mask=count == 0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(count), pa.array(total), mean], names=schema.names)

    return map_arrow(held, run, schema)
