"""Quality by attention-based multiple-instance learning: a document is a bag of passages, each of them encoded; gated
attention, learned from document labels alone, weighs the passages, and the weighted sum of their encodings is scored."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_slices, mix64, mixer
from .sampling import labelled_texts, settled

#: Words in a passage; the last of a text may have fewer.
PASSAGE = 40
#: Labelled documents to learn from, at most, and the characters that one of them may have.
SAMPLE, SAMPLE_CHARS = 2400, 20_000
HIDDEN, ATTENTION = 12, 6

#: Kinds of bytes that the features tell apart.
_KINDS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".", ",;:", "!?", "'\"()-", "#$%&*@^~_=+", "|<>[]{}\\/")
_KIND = np.full(256, len(_KINDS) + 1, np.int64)
for _k, _chars in enumerate(_KINDS):
    _KIND[np.frombuffer(_chars.encode(), np.uint8)] = _k
_KIND[128:] = len(_KINDS)
KINDS = len(_KINDS) + 2
OTHERS = 5
DIM = KINDS * KINDS + OTHERS

_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, DIM) features of all passages of whole texts, and the number of passages of each text (one even of none).

    A row depends on its own text alone. Its features: square roots of the shares of pairs of kinds of adjacent bytes; the shares of words that equal
    the one or the second before them, and of distinct words; word length and the passage's length.
    """
    parts = [b" " + t.encode("utf-8", "surrogatepass") + b" " if t else b"  " for t in texts]
    data = np.frombuffer(b"".join(parts), np.uint8)
    begins = np.cumsum([0, *map(len, parts)])
    blank = _SPACE[data]
    edge = np.flatnonzero(np.diff(blank.astype(np.int8), prepend=1))
    start, end = edge[::2], edge[1::2]
    first = np.searchsorted(start, begins)  # of each text's words
    words = np.diff(first)
    count = np.maximum(1, -(-words // PASSAGE))
    base = np.concatenate([[0], np.cumsum(count)])
    text_of = np.repeat(np.arange(len(texts)), words)
    of_word = base[text_of] + (np.arange(len(start)) - first[text_of]) // PASSAGE
    rows = int(base[-1])
    if not len(start):
        return np.zeros((rows, DIM), np.float32), count
    # bytes of a passage: from its first word (a text's first passage: from the text's start) to the next one's
    own = np.zeros(len(data), np.int32)
    own[start[np.flatnonzero(np.diff(of_word, prepend=-1))]] = 1
    own[start[first[:-1][words > 0]]] = 0
    own[begins[:-1]] = 1
    own = np.cumsum(own, dtype=np.int32) - 1
    kind = _KIND[data]
    pair = own[:-1] * np.int64(KINDS * KINDS) + kind[:-1] * KINDS + kind[1:]
    pair = np.delete(pair, begins[1:-1] - 1)  # what stands on either side of a text's end is no pair
    pairs = np.bincount(pair, minlength=rows * KINDS * KINDS).reshape(rows, -1)
    out = np.zeros((rows, DIM), np.float32)
    out[:, :-OTHERS] = np.sqrt(pairs / np.maximum(1, pairs.sum(1, keepdims=True)))
    size = end - start
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    power = np.cumprod(np.full(int(size.max()), 0xC2B2AE3D27D4EB4F, np.uint64))
    cut = np.concatenate([[0], np.cumsum(size)[:-1]])
    h = mix64(np.add.reduceat(mixer(8)[data[~blank]] * power[place], cut))
    n = np.maximum(1, np.bincount(of_word, minlength=rows))
    for k, back in enumerate((1, 2)):
        same = (h[back:] == h[:-back]) & (of_word[back:] == of_word[:-back])
        out[:, -OTHERS + k] = np.bincount(of_word[back:][same], minlength=rows) / n
    order = np.lexsort((h, of_word))
    fresh = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])])
    out[:, -3] = np.bincount(of_word[order][fresh], minlength=rows) / n
    out[:, -2] = np.minimum(np.bincount(of_word, size, rows) / n, 40) / 10
    out[:, -1] = np.log1p(n) / 4
    out[base[:-1][words == 0]] = 0  # as for a text alone
    return out, count


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: list[np.ndarray]  # encoder and its bias; the two sides of the gate; attention; output and its bias


def _start(dim: int, seed: int) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    normal = lambda *s: rng.normal(0, s[0] ** -0.5, s)
    return [normal(dim, HIDDEN), np.zeros(HIDDEN), normal(HIDDEN, ATTENTION), normal(HIDDEN, ATTENTION), normal(ATTENTION, 1), normal(HIDDEN, 1), np.zeros(1)]


def _forward(w: list[np.ndarray], x: np.ndarray, count: np.ndarray) -> dict[str, np.ndarray]:
    """Attention, pooled encodings and logit of each bag; rows of x belong to bags of `count` rows in turn."""
    at, bag = np.cumsum(count) - count, np.repeat(np.arange(len(count)), count)
    h = np.tanh(x @ w[0] + w[1])
    a, g = np.tanh(h @ w[2]), 1 / (1 + np.exp(-(h @ w[3])))
    e = ((a * g) @ w[4])[:, 0]
    e = np.exp(e - np.maximum.reduceat(e, at)[bag])
    share = e / np.add.reduceat(e, at)[bag]
    z = np.add.reduceat(h * share[:, None], at)
    return {"h": h, "a": a, "g": g, "share": share, "z": z, "bag": bag, "at": at, "logit": (z @ w[5] + w[6])[:, 0]}


def _gradients(w: list[np.ndarray], x: np.ndarray, f: dict[str, np.ndarray], off: np.ndarray) -> list[np.ndarray]:
    """Of a loss whose derivative by the bags' logits is `off`."""
    h, a, g, share, bag, at = (f[k] for k in ("h", "a", "g", "share", "bag", "at"))
    dz = off[:, None] * w[5][:, 0]
    dshare = (dz[bag] * h).sum(1)
    de = share * (dshare - np.add.reduceat(share * dshare, at)[bag])
    dag = de[:, None] * w[4][:, 0]
    da, dg = dag * g * (1 - a * a), dag * a * g * (1 - g)
    dh = (share[:, None] * dz[bag] + da @ w[2].T + dg @ w[3].T) * (1 - h * h)
    return [x.T @ dh, dh.sum(0), h.T @ da, h.T @ dg, (a * g).T @ de[:, None], f["z"].T @ off[:, None], off.sum(keepdims=True)]


def fit(x: np.ndarray, count: np.ndarray, y: np.ndarray, epochs: int = 250, rate: float = 0.02, decay: float = 1e-3, seed: int = 5) -> Model:
    """Full-batch Adam on the cross-entropy of documents; both labels weigh the same."""
    mean, spread = x.mean(0), np.maximum(x.std(0), 0.02)
    x = np.clip((x - mean) / spread, -6, 6).astype(np.float64)
    w = _start(x.shape[1], seed)
    one, two = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for step in range(1, epochs + 1):
        f = _forward(w, x, count)
        off = (1 / (1 + np.exp(-np.clip(f["logit"], -30, 30))) - y) * weight
        for p, g, m, v in zip(w, _gradients(w, x, f, off), one, two, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) + decay * p)
    return Model(mean, spread, w)


def score_bags(model: Model, x: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Scores of bags, each computed by itself: the same to the last bit whatever bags stand beside it."""
    x, ends = np.clip((x - model.mean) / model.spread, -6, 6), np.cumsum(count)
    logit = np.array([_forward(model.weights, x[e - c : e], np.array([c]))["logit"][0] for e, c in zip(ends, count, strict=True)])
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", learn: Column | None = None, sample: int = SAMPLE) -> Model | None:
    """Model fitted on at most `sample` labelled documents of at most SAMPLE_CHARS characters; None without any.

    Both labels get equal shares, chosen by hash of doc_id among rows where `learn` (a condition on doc_id) holds; of
    rows that repeat an id, the first in text order counts. Executors turn texts into passages' features; at most
    SPARE * sample * SAMPLE_CHARS / (2 * PASSAGE) rows of DIM numbers reach the driver.
    """
    share, keys, texts = labelled_texts(docs, labels, label, learn, sample, SAMPLE_CHARS)
    if texts is None:
        return None

    def make():
        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            x, count = passages(batch.column("text").to_pylist())
            ends = np.cumsum(count)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[e - c : e].astype(np.float16).tobytes() for e, c in zip(ends, count, strict=True)], pa.binary())], ["doc_id", "x"])

        return fn

    rows = {r["doc_id"]: r["x"] for r in map_slices(texts, make, "doc_id long, x binary").collect()}
    label_of = settled(share, keys, set(rows))
    if not label_of:
        return None
    ids = sorted(label_of)
    bags = [np.frombuffer(rows[k], np.float16).reshape(-1, DIM).astype(np.float32) for k in ids]
    return fit(np.concatenate(bags), np.array([len(b) for b in bags]), np.array([label_of[k] for k in ids], float))


def score_quality(docs: DataFrame, model: Model | None, threshold: float = 0.3) -> DataFrame:
    """Every row of `docs` with score double (0 to 1) and predicted int (1 from `threshold` on) added.

    Null, empty and blank texts are one passage without features. Without a model all score 0. Whole texts are read,
    however long. Rows that repeat get equal scores. Columns named score or predicted are replaced. Nothing is shuffled.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*kept).schema)

    def make():
        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            score = np.zeros(batch.num_rows)
            if model is not None:
                score = score_bags(model, *passages(batch.column("text").to_pylist()))
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], [*kept, "score", "predicted"])

        return fn

    return map_slices(docs.select(*kept, *(() if "text" in kept else ("text",))), make, f"{schema}score double, predicted int")
