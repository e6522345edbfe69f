"""Toxicity: words as bags of hashed subwords, their embeddings averaged into a linear softmax, all trained jointly in numpy.

A misspelling that was never seen shares character n-grams with words that were. A document is judged by its windows of
consecutive words: the average of each goes through the softmax, and the most toxic window speaks for the document.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_slices, mix64, mixer
from .sampling import labelled_texts, settled

BUCKETS, DIM = 1 << 20, 6
GRAMS = (3, 4, 5, 6)
#: Words in a window, an even number. Chosen with DAMP and SURE by cross-validation inside the learning rows: see the README.
WINDOW = 16
#: Labelled documents to learn from, at most, and the characters that one of them may have.
SAMPLE, SAMPLE_CHARS = 3200, 12_000
#: Standard errors by which a subword's shares of toxic and clean documents must differ for it to have an embedding.
SURE = 4.0
#: A word's vector is the sum of its subwords' embeddings over their number and DAMP; those that stand for nothing are left out.
DAMP = 12
#: Score at the place that tells the labels apart best; weight of a clean document flagged against a toxic one missed.
CUT, FALSE = 0.3, 2.0
#: Distinct words that a task remembers; beyond that it forgets those that its slice at hand has not.
REMEMBERED = 200_000

#: ASCII bytes that are neither letters nor digits are left out at a word's ends.
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def tokens(text: str) -> list[str]:
    return text.lower().split()


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' n-grams (bytes of `<word>`) and of the words themselves; where each word's begin, and the end."""
    parts = [b"<" + (w.strip(_EDGE) or w).encode("utf-8", "surrogatepass") + b">" for w in words]
    data = np.frombuffer(b"".join(parts), np.uint8)
    size = np.array([len(p) for p in parts], np.int64)
    owner = np.repeat(np.arange(len(parts)), size)
    who, what = [], []
    table, h = mixer(21), np.zeros(len(data), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        m = len(data) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + table[data[n - 1 :]]
        if n in GRAMS:
            inside = owner[:m] == owner[n - 1 :]
            who.append(owner[:m][inside])
            what.append(mix64(h[inside] + np.uint64(n)))
    ends = np.cumsum(size)
    power = np.cumprod(np.full(int(size.max(initial=1)), 0xC2B2AE3D27D4EB4F, np.uint64))
    place = np.arange(len(data)) - np.repeat(ends - size, size)
    who.append(np.arange(len(parts)))
    what.append(mix64(np.add.reduceat(table[data] * power[place], ends - size)) if len(parts) else np.zeros(0, np.uint64))
    owners, hashes = np.concatenate(who), np.concatenate(what)
    order = np.argsort(owners, kind="stable")
    return (hashes[order] & np.uint64(BUCKETS - 1)).astype(np.int64), np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(parts)))])


@dataclass
class Model:
    bucket_logit: np.ndarray  # (BUCKETS,): embedding . (toxic - clean row of the softmax)
    bias: float
    scale: float  # from a window's logit to the document's
    shift: float


def _windows(n: int) -> np.ndarray:
    """Starts of half-overlapping windows over n words; one even of no words."""
    return np.arange(0, max(1, n - WINDOW // 2), WINDOW // 2)


def _learn(docs: list[list[str]], y: np.ndarray, epochs: int, rate: float, seed: int) -> tuple[np.ndarray, float]:
    vocab: dict[str, int] = {}
    ids = [np.array([vocab.setdefault(w, len(vocab)) for w in d], np.int64) for d in docs]
    grams, starts = subwords(list(vocab))
    per = np.diff(starts)
    # a subword that toxic and clean documents show alike, as far as chance goes, stands for nothing
    seen = np.zeros((2, BUCKETS))
    for d, c in zip(ids, y, strict=True):
        own = np.unique(d)
        inside = np.repeat(starts[own], per[own]) + np.arange(per[own].sum()) - np.repeat(np.cumsum(per[own]) - per[own], per[own])
        seen[int(c), np.unique(grams[inside])] += 1
    size = np.array([[(y == 0).sum()], [(y == 1).sum()]])
    shown = seen / size
    both = seen.sum(0) / size.sum()
    z = (shown[1] - shown[0]) / np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / size).sum())
    word_of_gram = np.repeat(np.arange(len(per)), per)
    keep = (np.abs(z) >= SURE)[grams]
    grams, word_of_gram = grams[keep], word_of_gram[keep]
    used, grams = np.unique(grams, return_inverse=True)
    alive = np.zeros(len(per), bool)
    alive[word_of_gram] = True
    # windows without a subword that counts all have the zero vector: one stands for a document's, with their number
    cells, win, doc_of, times, divisor = [], [], [], [], []
    for k, d in enumerate(ids):
        on = alive[d]
        at = _windows(len(d))
        some = np.add.reduceat(np.append(on, False), at) > 0 if len(d) else np.zeros(1, bool)
        for s in at[some].tolist():
            part = d[s : s + WINDOW]
            divisor.append(max(1, len(part)))
            part = part[alive[part]]
            cells.append(part)
            win.append(np.full(len(part), len(doc_of)))
            doc_of.append(k)
            times.append(1)
        if not some.all():
            doc_of.append(k)
            times.append(1)
            divisor.append(1)
    empty = [np.zeros(0, np.int64)]
    cell, win, doc_of, times = np.concatenate(cells or empty), np.concatenate(win or empty), np.array(doc_of), np.array(times)
    n_win, share = len(doc_of), 1.0 / np.array(divisor)
    words_used, cell = np.unique(cell, return_inverse=True)
    place = np.full(len(per), -1)
    place[words_used] = np.arange(len(words_used))
    inside = place[word_of_gram] >= 0
    grams, word_of_gram = grams[inside], place[word_of_gram[inside]]
    per = np.bincount(word_of_gram, minlength=len(words_used)) + DAMP
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.3, (len(used), DIM)).astype(np.float32)
    w = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32)
    b = np.zeros(2, np.float32)
    moments = [np.zeros_like(p) for p in (e, w, b)], [np.zeros_like(p) for p in (e, w, b)]
    label, first = y[doc_of], np.flatnonzero(np.concatenate([[True], doc_of[1:] != doc_of[:-1]]))
    on = times.astype(np.float64)
    for epoch in range(epochs):
        words = np.stack([np.bincount(word_of_gram, e[grams, k], len(per)) for k in range(DIM)], 1) / per[:, None]
        mean = np.stack([np.bincount(win, words[cell, k], n_win) for k in range(DIM)], 1) * share[:, None]
        logit = mean @ w + b
        p = 1 / (1 + np.exp(-np.clip(logit[:, 1] - logit[:, 0], -30, 30)))
        if epoch >= epochs // 3:  # of a toxic document, only its most toxic windows are held to be so
            top = np.maximum.reduceat(p, first)[doc_of]
            on = np.where((label == 1) & (p < 0.7 * top), 0, times)
        weight = on * np.where(label == 1, 0.5 / max(1, (on * (label == 1)).sum()), 0.5 / max(1, (on * (label == 0)).sum()))
        g = ((p - label) * weight)[:, None] * np.array([-1.0, 1.0])
        gw, gb, gm = mean.T @ g, g.sum(0), (g @ w.T) * share[:, None]
        gword = np.stack([np.bincount(cell, gm[win, k], len(per)) for k in range(DIM)], 1) / per[:, None]
        ge = np.stack([np.bincount(grams, gword[word_of_gram, k], len(used)) for k in range(DIM)], 1)
        for p_, g_, m1, m2 in zip((e, w, b), (ge, gw, gb), *moments, strict=True):
            m1 += 0.1 * (g_ - m1)
            m2 += 0.01 * (g_**2 - m2)
            step = (m1 / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(m2 / (1 - 0.99 ** (epoch + 1))) + 1e-7)
            p_ -= rate * (step + 0.01 * p_)
    full = np.zeros(BUCKETS, np.float32)  # the zero vector for all other subwords
    full[used] = e @ (w[:, 1] - w[:, 0])
    return full, float(b[1] - b[0])


def word_logits(model_logits: np.ndarray, words: list[str]) -> np.ndarray:
    grams, starts = subwords(words)
    if not words:
        return np.zeros(0)
    found = model_logits[grams].astype(np.float64)
    # each word is summed up by itself: its logit is the same whatever words stand beside it
    return np.add.reduceat(found, starts[:-1]) / (np.add.reduceat((found != 0).astype(np.int64), starts[:-1]) + DAMP)


def worst_window(logits: np.ndarray) -> float:
    """Largest average over any WINDOW consecutive words; over all words of a shorter text; 0 without words."""
    if len(logits) <= WINDOW:
        return float(logits.mean()) if len(logits) else 0.0
    s = np.concatenate([[0.0], np.cumsum(logits)])
    return float((s[WINDOW:] - s[:-WINDOW]).max() / WINDOW)


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic curve through (x, y) that is CUT where the two labels are told apart best.

    The scale (0 at least) is that of a logistic regression, a little drawn towards 0. The place is the one at which the
    share of toxic documents below and FALSE times the share of clean ones above are least together; of places alike,
    the middle of the widest stretch without documents.
    """
    a, b = 1.0, 0.0
    mid, spread = x.mean(), max(1e-6, x.std())
    z, weight = (x - mid) / spread, np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    for _ in range(500):
        g = (1 / (1 + np.exp(-np.clip(a * z + b, -30, 30))) - y) * weight
        a, b = a - 1.0 * ((g * z).sum() + 2e-3 * a), b - 1.0 * (g.sum() + 2e-3 * b)
    a = max(0.0, a) / spread
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    ends = np.concatenate([[x[0] - spread], x, [x[-1] + spread]])
    lost = np.concatenate([[0], np.cumsum(y)]) / max(1, y.sum())  # with so many documents below
    flagged = 1 - np.concatenate([[0], np.cumsum(1 - y)]) / max(1, (1 - y).sum())
    cost, room = lost + FALSE * flagged, ends[1:] - ends[:-1]
    best = np.flatnonzero(cost <= cost.min() + 1e-9)
    at = best[room[best].argmax()]
    return a, np.log(CUT / (1 - CUT)) - a * (ends[at] + ends[at + 1]) / 2


def fit(texts: list[str], labels: list[int], epochs: int = 100, rate: float = 0.05, seed: int = 7) -> Model | None:
    """Four fifths of the documents train the embeddings, the others set the scale of the score."""
    y = np.array(labels, float)
    if not len(y):
        return None
    docs = [tokens(t) for t in texts]
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    logits, bias = _learn([d for d, h in zip(docs, held, strict=True) if not h], y[~held], epochs, rate, seed)
    among = held if held.any() else ~held
    worst = np.array([worst_window(word_logits(logits, d)) if d else 0.0 for d, h in zip(docs, among, strict=True) if h])
    return Model(logits, bias, *_calibrate(worst + bias, y[among]))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", learn: Column | None = None, sample: int = SAMPLE) -> Model | None:
    """Model fitted on at most `sample` labelled documents of at most SAMPLE_CHARS characters; None without any.

    Both classes get equal shares, chosen by hash of doc_id among rows where `learn` (a condition on doc_id) holds.
    At most SPARE x sample x SAMPLE_CHARS characters reach the driver.
    """
    share, keys, texts = labelled_texts(docs, labels, label, learn, sample, SAMPLE_CHARS)
    if texts is None:
        return None
    rows = {r["doc_id"]: r["text"] for r in texts.collect()}
    label_of = settled(share, keys, set(rows))
    order = sorted(label_of, key=lambda k: zlib.crc32(str(k).encode() + b"."))  # classes mixed, the same on every run
    return fit([rows[k] for k in order], [label_of[k] for k in order])


def score_toxicity(docs: DataFrame, model: Model | None, threshold: float = CUT) -> DataFrame:
    """Every row of `docs` with score double (0 to 1) and predicted int (1 from `threshold` on) added.

    Null, empty and blank texts have no toxic window and score what an average of 0 scores; without a model all score 0.
    Whole texts are read, however long. Columns named score or predicted are replaced. The model has a fixed size and
    goes to the tasks with the function; nothing is shuffled.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*kept).schema)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m, known = sent.value, {}

        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            score = []
            if m is not None:
                rows = [tokens(t or "") for t in batch.column("text").to_pylist()]
                wanted = set().union(*rows)
                if len(known) + len(wanted) > REMEMBERED:
                    for w in known.keys() - wanted:
                        del known[w]
                new = list(wanted.difference(known))
                known.update(zip(new, word_logits(m.bucket_logit, new).tolist() if new else (), strict=True))
                worst = np.array([worst_window(np.fromiter(map(known.__getitem__, r), np.float64, len(r))) for r in rows])
                score = 1 / (1 + np.exp(-np.clip(m.scale * (worst + m.bias) + m.shift, -30, 30)))
            else:
                score = np.zeros(batch.num_rows)
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], [*kept, "score", "predicted"])

        return fn

    return map_slices(docs.select(*dict.fromkeys([*kept, "text"])), make, f"{schema}score double, predicted int")
