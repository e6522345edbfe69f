"""Language identification in two steps: the family first, then one-versus-one linear SVMs between its languages."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_slices, mix64, mixer
from .sampling import candidates, chosen

DIM = 1 << 13
ORDERS = (1, 2, 3)
#: Labelled documents that the model is fitted on, at most.
SAMPLE = 1600
#: Bytes whose n-grams are hashed at once, and texts whose feature rows a task holds.
PIECE, ROWS = 1 << 17, 128

#: Language -> family. A language that is not listed is a family of its own.
FAMILIES = {
    "da": "germanic", "de": "germanic", "en": "germanic", "nl": "germanic", "no": "germanic", "sv": "germanic",
    "ca": "romance", "es": "romance", "fr": "romance", "it": "romance", "pt": "romance", "ro": "romance",
    "bg": "slavic", "cs": "slavic", "pl": "slavic", "ru": "slavic", "sk": "slavic", "uk": "slavic",
    "et": "uralic", "fi": "uralic", "hu": "uralic",
}

#: Bytes of a lower-cased text that count: a-z and all beyond ASCII; the others are word borders.
_KEEP = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


@dataclass
class Model:
    families: list[str]
    members: list[list[str]]  # languages of each family
    family_w: np.ndarray  # (DIM + 1, families)
    pairs: list[list[tuple[int, int]]]  # of each family's members
    pair_w: list[np.ndarray]  # (DIM + 1, pairs) of each family


def features(texts: list[str | None]) -> np.ndarray:
    """Unit vectors of square-rooted counts of hashed byte n-grams; one row a text, over its whole length.

    A row depends on its own text alone. Texts are gone through in pieces of PIECE bytes, so memory grows with their
    bytes by a small factor only.
    """
    parts = [(" " + t.lower() + " ").encode("utf-8", "surrogatepass") if t else b" " for t in texts]
    data = _KEEP[np.frombuffer(b"".join(parts), np.uint8)]
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
    keep = np.ones(len(data), bool)  # runs of borders count once, but each text has its own
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32) | (owner[1:] != owner[:-1])
    data, owner = data[keep], owner[keep]
    table, counts, longest = mixer(3), np.zeros(len(parts) * DIM, np.float32), max(ORDERS)
    for at in range(0, len(data), PIECE):
        d, o = data[at : at + PIECE + longest - 1], owner[at : at + PIECE + longest - 1]
        first = int(o[0])
        h = np.zeros(len(d), np.uint64)
        for n in range(1, longest + 1):
            m = len(d) - n + 1
            if m <= 0:
                break
            h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + table[d[n - 1 :]]
            if n in ORDERS:
                here = min(m, PIECE)  # n-grams that begin in this piece
                inside = o[:here] == o[n - 1 : n - 1 + here]
                slot = (mix64(h[:here][inside] + np.uint64(n)) & np.uint64(DIM - 1)).astype(np.int64) + (o[:here][inside] - first).astype(np.int64) * DIM
                found = np.bincount(slot)
                counts[first * DIM : first * DIM + len(found)] += found
    x = np.sqrt(counts).reshape(len(parts), DIM)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _svm(x: np.ndarray, y: np.ndarray, epochs: int = 120, c: float = 30.0) -> np.ndarray:
    """Weights and, last, bias of a linear SVM with squared hinge loss; y is 1 or -1; classes weigh the same."""
    n, (w, b) = len(y), (np.zeros(x.shape[1], np.float32), 0.0)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    vw, vb, rate = np.zeros_like(w), 0.0, 0.5 / (1 + 2 * c)
    for _ in range(epochs if n else 0):
        slack = np.maximum(0, 1 - y * (x @ w + b)) * weight * y
        vw = 0.9 * vw + rate * (2 * c * (slack @ x) - w)
        vb = 0.9 * vb + rate * 2 * c * slack.sum()
        w, b = w + vw, b + vb
    return np.append(w, np.float32(b))


def fit(x: np.ndarray, langs: list[str], families: dict[str, str] = FAMILIES) -> Model:
    y = np.array(langs)
    groups: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        groups.setdefault(families.get(lang, lang), []).append(lang)
    names, of = sorted(groups), np.array([families.get(v, v) for v in langs])
    family_w = np.stack([_svm(x, np.where(of == f, 1, -1).astype(np.float32)) for f in names], 1)
    pairs, pair_w = [], []
    for f in names:
        pairs.append(list(itertools.combinations(range(len(groups[f])), 2)))
        made = []
        for a, b in pairs[-1]:
            among = (y == groups[f][a]) | (y == groups[f][b])
            made.append(_svm(x[among], np.where(y[among] == groups[f][a], 1, -1).astype(np.float32)))
        pair_w.append(np.stack(made, 1) if made else np.zeros((x.shape[1] + 1, 0), np.float32))
    return Model(names, [groups[f] for f in names], family_w, pairs, pair_w)


def _sure(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-3.0 * np.clip(margin, -20, 20)))


def predict(model: Model, x: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Languages and scores of rows of features. Equal votes go to the larger sum of margins, then to text order.

    Each row is multiplied by itself, so that its result is the same to the last bit whatever rows stand beside it.
    """

    def margins(rows: np.ndarray, w: np.ndarray) -> np.ndarray:
        return np.stack([r @ w[:-1] + w[-1] for r in rows])

    margin = margins(x, model.family_w)
    fam = margin.argmax(1)
    score = _sure(margin[np.arange(len(x)), fam]) if len(model.families) > 1 else np.ones(len(x))
    out = [""] * len(x)
    for f in np.unique(fam):
        rows, names = np.flatnonzero(fam == f), model.members[f]
        m = margins(x[rows], model.pair_w[f])
        votes = np.zeros((len(rows), len(names)))
        least = np.full((len(rows), len(names)), np.inf)
        for k, (a, b) in enumerate(model.pairs[f]):
            for who, v in ((a, m[:, k]), (b, -m[:, k])):
                votes[:, who] += (v > 0) + 1e-3 * np.tanh(v)
                least[:, who] = np.minimum(least[:, who], v)
        best = votes.argmax(1)
        if len(names) > 1:
            score[rows] *= _sure(least[np.arange(len(rows)), best])
        for r, k in zip(rows, best, strict=True):
            out[r] = names[k]
    return out, score


def train(docs: DataFrame, learn: Column | None = None, sample: int = SAMPLE, families: dict[str, str] = FAMILIES) -> Model | None:
    """Model fitted on at most `sample` documents with a language, equal shares a language; None where there are none.

    Every language is learned: of many, each keeps sampling.FLOOR documents beyond `sample`; of more than
    sampling.MAX_CLASSES, a ValueError is raised.
    The sample is chosen by hash of doc_id among rows where `learn` holds. Executors turn whole texts into feature
    rows of fixed width, so what the driver receives is bounded whatever the texts' lengths. Of rows that repeat an id
    in one language, the least text counts; null texts count nowhere.
    """
    pool = docs.where(learn) if learn is not None else docs
    share, keys = candidates(pool, "doc_id", "lang", sample)
    if not keys:
        return None

    def make():
        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = features(batch.column("text").to_pylist()).astype(np.float16)
            columns = [pa.array([batch.column(n).to_pylist()], kind) for n, kind in (("doc_id", pa.list_(pa.int64())), ("lang", pa.list_(pa.string())))]
            return pa.RecordBatch.from_arrays([*columns, pa.array([x.tobytes()], pa.binary())], ["ids", "langs", "x"])

        return fn

    texts = pool.select("doc_id", "text", "lang").where(F.col("text").isNotNull()).join(chosen(docs.sparkSession, keys, "doc_id"), "doc_id", "left_semi")
    texts = texts.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    at, parts = {}, []  # each slice's rows are one block of numbers
    for r in map_slices(texts, make, "ids array<long>, langs array<string>, x binary", rows=ROWS).collect():
        at |= {who: (len(parts), i) for i, who in enumerate(zip(r["ids"], r["langs"], strict=True))}
        parts.append(np.frombuffer(r["x"], np.float16).reshape(-1, DIM))
    picked = [(k, c) for c, ks in sorted(keys.items()) for k in [k for k in ks if (k, c) in at][:share]]
    if not picked:
        return None
    x = np.empty((len(picked), DIM), np.float32)
    for i, who in enumerate(picked):
        x[i] = parts[at[who][0]][at[who][1]]
    del parts
    return fit(x, [c for _, c in picked], families)


def identify_language(docs: DataFrame, model: Model | None) -> DataFrame:
    """Every row of `docs` with lang_pred and score added.

    Texts that are null or have no letter, and all texts where no model could be learned, get `und` and score 0.
    Rows that repeat get the same answer each; columns of the input named lang_pred or score are replaced.
    The model has a fixed width (hashed features times languages) and goes to the tasks with the function. No shuffle.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema] + ["lang_pred string", "score double"])

    def make():
        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column("text").to_pylist()
            some = [i for i, t in enumerate(texts) if model is not None and t and any(map(str.isalpha, t))]
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            if some:
                names, sure = predict(model, features([texts[i] for i in some]))
                for i, n, s in zip(some, names, sure.tolist(), strict=True):
                    lang[i], score[i] = n, s
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*kept, "lang_pred", "score"])

        return fn

    return map_slices(docs.select(*dict.fromkeys([*kept, "text"])), make, schema, rows=ROWS)
