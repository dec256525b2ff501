"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoolwave.llm.common import map_batches, plain, spread, text_col

#: Bounds of the training sample: documents, and lines of them in all. All lines of a sampled document take part; a document that
#: would go over the lines is left out.
TRAIN_DOCS = 4000
TRAIN_LINES = 1_000_000
#: What a label says of a document's lines: good ones hold at least the first share of its length in good documents, at most the
#: second in bad ones.
GOOD_SHARE, BAD_SHARE = 0.95, 0.3
THRESHOLD = 0.3
FOLDS = 5
SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
PUNCTUATION = b".,;:!?\"'()-"
_ENDS = frozenset(b".!?:;\"')")
N_OWN = 15


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS == 0


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of every line that has a word, and the lines' lengths in words' bytes.

    A feature looks at its line and at what of the document came before it (an equal line, repeated word triples); the
    neighbours' features are added by `with_neighbours`.
    """
    rows, sizes = [], []
    seen_lines: set[bytes] = set()
    seen: dict[tuple, bool] = {}
    for line in text.encode("utf-8").split(b"\n"):
        words = line.split()
        n = len(words)
        if not n:
            continue
        size, body = len(line), len(line.translate(None, SPACES))
        count = lambda chars, line=line, size=size: size - len(line.translate(None, chars))
        triples = list(zip(words, words[1:], words[2:]))
        own = set(triples)
        again = sum(t in seen for t in own)
        seen.update(dict.fromkeys(own, True))
        rows.append(
            (
                min(np.log1p(n) / 5.0, 2.0),
                min(count(SYMBOLS) / n, 2.0),
                count(UPPER) / body,
                min(line.count(b"!") / n, 1.0),
                min(line.count(b"|") / n, 1.0),
                count(DIGITS) / body,
                float(line in seen_lines),
                1.0 - len(set(words)) / n,
                1.0 - len(own) / len(triples) if triples else 0.0,
                again / len(own) if own else 0.0,
                min(body / n / 10.0, 3.0),
                float(words[-1][-1] in _ENDS),
                float(n < 4),
                min(count(PUNCTUATION) / n, 2.0),
                1.0,
            )
        )
        sizes.append(body)
        seen_lines.add(line)
    return np.array(rows, np.float64).reshape(-1, N_OWN), np.array(sizes, np.float64)


def with_neighbours(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """[own, previous line, next line] for the lines of many documents; starts marks each document's first line."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    if len(x):
        before[1:], after[:-1] = x[:-1], x[1:]
        before[starts] = 0.0
        last = np.append(starts[1:], len(x)) - 1
        after[last] = 0.0
    return np.hstack([x, before, after])


def marginals(scores: np.ndarray, trans: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over many chains at once.

    scores[line, 2] are log potentials of lines laid end to end, lengths > 0. Returns each line's state probabilities, the
    summed probabilities of the four transitions, and the summed log partition. Chains are walked in step, longest first.
    """
    order = np.argsort(-lengths, kind="stable")
    start = np.concatenate(([0], np.cumsum(lengths)[:-1]))[order]
    size = lengths[order]
    steps = int(size[0])
    active = np.searchsorted(-size, -np.arange(steps), side="left")
    e = np.exp(trans)
    peak = scores.max(axis=1, keepdims=True)
    pot = np.exp(scores - peak)
    alpha, scale = np.empty_like(pot), np.empty(len(pot))
    for t in range(steps):
        at = start[: active[t]] + t
        a = pot[at] if t == 0 else (alpha[at - 1] @ e) * pot[at]
        s = a.sum(axis=1)
        alpha[at], scale[at] = a / s[:, None], s
    beta = np.ones_like(pot)
    pair = np.zeros((2, 2))
    for t in range(steps - 1, 0, -1):
        at = start[: active[t]] + t
        w = pot[at] * beta[at] / scale[at][:, None]
        beta[at - 1] = w @ e.T
        pair += e * (alpha[at - 1].T @ w)
    return alpha * beta, pair, float(np.log(scale).sum() + peak.sum())


@dataclass
class Model:
    weights: np.ndarray  # [3 * N_OWN, 2]
    trans: np.ndarray  # [2, 2]
    slope: float
    shift: float

    def goodness(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Length-weighted mean of the lines' probabilities of being good; NaN for documents without a line."""
        out = np.full(len(parts), np.nan)
        lengths = np.array([len(s) for _, s in parts], np.int64)
        some = np.flatnonzero(lengths)
        if len(some):
            n = lengths[some]
            starts = np.concatenate(([0], np.cumsum(n)[:-1]))
            x = with_neighbours(np.vstack([parts[i][0] for i in some]), starts)
            p, _, _ = marginals(x @ self.weights, self.trans, n)
            size = np.concatenate([parts[i][1] for i in some])
            out[some] = np.add.reduceat(p[:, 1] * size, starts) / np.add.reduceat(size, starts)
        return out

    def score(self, goodness: np.ndarray) -> np.ndarray:
        """Probability of label 1 by logistic scaling of the goodness; a document without a line scores 0."""
        z = _logit(np.nan_to_num(goodness, nan=0.5))
        return np.where(np.isnan(goodness), 0.0, 1.0 / (1.0 + np.exp(-(self.slope * z + self.shift))))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p) - np.log1p(-p)


def constrained(scores: np.ndarray, trans: np.ndarray, n: np.ndarray, starts: np.ndarray, weight: np.ndarray, labels: np.ndarray, halvings: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Line and transition probabilities of the chains nearest to the model's that keep what the labels say.

    The expected length-weighted share of good lines is held at GOOD_SHARE or more in good documents, at BAD_SHARE or less in bad
    ones. The nearest distribution (in relative entropy) adds a multiple of a line's weight to its good score; the multiple of a
    document that keeps its bound is 0, that of any other is found by halving.
    """
    p, pair, _ = marginals(scores, trans, n)
    share = np.add.reduceat(p[:, 1] * weight, starts)
    bound = np.where(labels == 1, GOOD_SHARE, BAD_SHARE)
    sign = np.where(labels == 1, 1.0, -1.0)
    off = sign * (share - bound) < 0
    if not off.any():
        return p, pair
    # weights sum to 1 in a document, so a line's tilt is in units of its mean weight
    unit = weight * np.repeat(n, n)
    low, high = np.zeros(len(n)), np.where(off, 30.0, 0.0)
    for _ in range(halvings):
        mid = (low + high) / 2
        tilted = scores.copy()
        tilted[:, 1] += np.repeat(sign * mid, n) * unit
        p, pair, _ = marginals(tilted, trans, n)
        short = sign * (np.add.reduceat(p[:, 1] * weight, starts) - bound) < 0
        low, high = np.where(off & short, mid, low), np.where(off & ~short, mid, high)
    return p, pair


def fit(parts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rounds: int = 200, every: int = 20, ridge: float = 1e-3) -> Model:
    """Expectation-maximisation with latent lines: a label bounds the share of a document's good lines and says nothing of any one.

    Lines begin with their document's label. After `every` rounds their probabilities are taken from the model again, held to the
    labels' bounds by `constrained`, so that a bad document may have good lines and chains change state. Between, the conditional
    likelihood of these probabilities rises by full-batch Adam from a fixed start: reruns agree. The logistic scale comes from the
    sample's labels, and its shift puts the threshold where the labels part best.
    """
    use = [i for i, (x, _) in enumerate(parts) if len(x)]
    x = [parts[i][0] for i in use]
    n = np.array([len(a) for a in x], np.int64)
    if not use or len({int(labels[i]) for i in use}) < 2:
        return Model(np.zeros((3 * N_OWN, 2)), np.zeros((2, 2)), 1.0, 2.0)
    starts = np.concatenate(([0], np.cumsum(n)[:-1]))
    data = with_neighbours(np.vstack(x), starts)
    known = labels[use].astype(np.int64)
    size = np.concatenate([parts[i][1] for i in use])
    weight = size / np.repeat(np.add.reduceat(size, starts), n)
    y = np.repeat(known, n)
    gold = np.zeros((len(y), 2))
    gold[np.arange(len(y)), y] = 1.0
    inner = np.ones(len(y), bool)
    inner[starts] = False
    steps = np.flatnonzero(inner)
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (y[steps - 1], y[steps]), 1.0)
    w, t = np.zeros((data.shape[1], 2)), np.zeros((2, 2))
    mw, vw, mt, vt = np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)
    for k in range(1, rounds + 1):
        scores = data @ w
        if k > every and k % every == 1:
            gold, pairs = constrained(scores, t, n, starts, weight, known)
        p, pair, _ = marginals(scores, t, n)
        gw = data.T @ (p - gold) / len(y) + ridge * w
        gt = (pair - pairs) / len(y) + ridge * t
        for v, g, m, s in ((w, gw, mw, vw), (t, gt, mt, vt)):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v -= 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-8)
    model = Model(w, t, 1.0, 0.0)
    z, good = _logit(model.goodness([parts[i] for i in use])), labels[use].astype(float)
    a, b = 1.0, 0.0
    for _ in range(400):
        err = 1.0 / (1.0 + np.exp(-(a * z + b))) - good
        a, b = a - 0.05 * float((err * z).mean()), b - 0.5 * float(err.mean())
    a = max(a, 1e-3)
    return Model(w, t, a, float(_logit(np.array(THRESHOLD))) - a * _cut(z, good))


def _cut(z: np.ndarray, good: np.ndarray) -> float:
    """The point that parts the two labels with the fewest errors, in the middle between its neighbours."""
    order = np.argsort(z, kind="stable")
    z, good = z[order], good[order]
    errors = np.concatenate(([0.0], np.cumsum(good))) + np.concatenate((np.cumsum((1 - good)[::-1])[::-1], [0.0]))
    best = np.flatnonzero(errors == errors.min())
    low, high = best[0], best[-1]
    return float((z[max(low - 1, 0)] + z[min(high, len(z) - 1)]) / 2)


def train(docs: DataFrame, labels: DataFrame, sample: int = TRAIN_DOCS, lines: int = TRAIN_LINES) -> Model:
    """Fit on at most `sample` labelled documents whose fold is not held out, those of the least digest of their id, and of these on
    the first whose lines are at most `lines` in all.

    Labels outside 0 and 1, null labels and null ids are left out; of repeated labels the least counts. Only line features
    of that sample reach the driver. Without labels of both kinds, the model scores every text alike.
    """
    docs, labels = plain(docs, "doc_id", "text"), plain(labels, "doc_id", "quality")
    picked = (
        labels.where("doc_id is not null and quality in (0, 1)")
        .groupBy(F.col("doc_id").alias("_label_id"))
        .agg(F.min("quality").alias("_label"))
        .where(F.crc32(F.col("_label_id").cast("string")) % FOLDS != 0)
        .orderBy(F.xxhash64("_label_id"), "_label_id")
        .limit(sample)
    )
    rows = docs.select(F.col("doc_id").alias("_id"), text_col().alias("_text")).join(F.broadcast(picked), F.col("_id") == F.col("_label_id")).select("_id", "_label", "_text")
    # a row per sampled document, so the running sum sees no more rows than the sample has
    so_far = F.sum(F.size(F.split("_text", "\n"))).over(Window.orderBy(F.xxhash64("_id"), "_id", F.xxhash64("_text")))
    rows = rows.withColumn("_lines", so_far).where(F.col("_lines") <= lines).drop("_lines").repartition(min(sample, docs.sparkSession.sparkContext.defaultParallelism * 4))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [line_features(t) for t in batch.column(2).to_pylist()]
        flat = [x.astype(np.float32).tobytes() for x, _ in parts]
        sizes = [s.astype(np.float32).tobytes() for _, s in parts]
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.int32()), pa.array(flat, pa.binary()), pa.array(sizes, pa.binary())], names=["id", "label", "x", "s"])

    got = map_batches(rows, run, "id bigint, label int, x binary, s binary").collect()
    got.sort(key=lambda r: (r.id, bytes(r.x)))
    parts = [(np.frombuffer(r.x, np.float32).astype(float).reshape(-1, N_OWN), np.frombuffer(r.s, np.float32).astype(float)) for r in got]
    return fit(parts, np.array([r.label for r in got], np.int64))


def line_states(model: Model, text: str) -> np.ndarray:
    """The probability of being good of every line that has a word."""
    x, _ = line_features(text)
    if not len(x):
        return np.empty(0)
    return marginals(with_neighbours(x, np.array([0])) @ model.weights, model.trans, np.array([len(x)]))[0][:, 1]


def score_texts(model: Model, texts: list[str]) -> np.ndarray:
    out = []
    for i in range(0, len(texts), 512):
        out.append(model.score(model.goodness([line_features(t) for t in texts[i : i + 512]])))
    return np.concatenate(out) if out else np.empty(0)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row; every whole text is scored by its lines alone.

    Null text is empty; an empty text scores 0. A null doc_id is kept (held_out false). Repeated rows score alike. An empty
    table gives an empty result.
    """
    model = train(docs, labels)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(0).cast(pa.int64())
        score = score_texts(model, batch.column(1).to_pylist())
        out = [i is not None and held_out(i) for i in ids.to_pylist()]
        return pa.RecordBatch.from_arrays([ids, pa.array(out, pa.bool_()), pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    docs = plain(docs, "doc_id", "text")
    return map_batches(spread(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_col().alias("text"))), run, "doc_id bigint, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the classifier rejects; columns and their order unchanged.

    A null or empty text scores 0 and goes. Ids play no part: rows of one id, or of none, are judged by their texts. Without labels
    of both kinds nothing but rows without a line goes. An empty table stays empty.
    """
    model, names = train(docs, labels), docs.columns
    docs = plain(docs, "doc_id", "text")
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = score_texts(model, [t or "" for t in batch.column(at).to_pylist()])
        return batch.filter(pa.array(score >= THRESHOLD))

    return map_batches(docs, run, docs.schema).toDF(*names)
