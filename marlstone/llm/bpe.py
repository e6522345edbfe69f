"""Byte-level BPE as a contiguous rank array: a word is its part boundaries with the rank of each adjacent pair beside
them; the least rank is looked for again and again, its boundary deleted, and the two neighbouring ranks refreshed.

Short words of equal length are merged side by side as rows of numpy arrays; a word too long for that scan keeps the
same state in a heap. Each distinct word of a task is merged once.
"""

from __future__ import annotations

import functools
import heapq
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_slices

#: Bytes of a word up to which the plain scan is used.
SHORT = 64
#: Rows and bytes that a task encodes at once: enough for words of equal length to fill an array.
ROWS, BYTES = 1024, 1 << 21
#: Distinct words that a task remembers; beyond that it forgets those that its slice at hand has not.
REMEMBERED = 300_000
_NONE = np.iinfo(np.int32).max
#: Marks before units; lone surrogates, which no UTF-8 text has.
_WHOLE, _SPECIAL = "\ud800", "\ud801"

#: The published byte-level split pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in plain}
    names |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return names


class ByteBpe:
    """Encoder and decoder of a vocabulary file: byte-level pre-tokens, ranked merges, special tokens split off first."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        name, vocab = _byte_names(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        pieces = [b""] * self.size
        for token, i in vocab.items():
            pieces[i] = bytes(name[c] for c in token)
        for token, i in self.special.items():
            pieces[i] = token.encode()
        self.byte_id = np.array([vocab[c] for c, _ in sorted(name.items(), key=lambda x: x[1])], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        # a table of open addresses: pair of ids -> rank; rank -> id of the merged part
        self.merged = np.array([vocab[a + b] for a, b in merges] + [0], np.int32)
        key = left * self.size + right
        self.mask = (1 << (len(key) * 4 - 1).bit_length()) - 1
        self.table, self.rank = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, _NONE, np.int32)
        todo, slot = np.arange(len(key)), self._slot(key)
        self.probes = 0
        while len(todo):
            free = self.table[slot[todo]] == -1
            _, first = np.unique(slot[todo][free], return_index=True)
            put = todo[free][first]
            self.table[slot[put]], self.rank[slot[put]] = key[put], put
            todo = np.setdiff1d(todo, put)
            slot[todo] = (slot[todo] + 1) & self.mask
            self.probes += 1
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.split = regex.compile(PATTERN)
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)).astype(np.int64) & self.mask

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each adjacent pair of part ids; the largest number where they do not merge (or an id is negative)."""
        key = a.astype(np.int64) * self.size + b
        slot = self._slot(key)
        out = np.full(key.shape, _NONE, np.int32)
        open_ = np.flatnonzero((a.ravel() >= 0) & (b.ravel() >= 0))
        flat, k, s = out.ravel(), key.ravel(), slot.ravel()
        for i in range(self.probes):
            at = (s[open_] + i) & self.mask
            held = self.table[at]
            hit = held == k[open_]
            flat[open_[hit]] = self.rank[at[hit]]
            open_ = open_[~hit & (held != -1)]
            if not len(open_):
                break
        return flat.reshape(out.shape)

    def _merge_short(self, words: list[bytes]) -> list[bytes]:
        """Words of at most SHORT bytes. Row by row: the id of the part that begins at each byte, and its rank with the next.

        A boundary that is deleted leaves its place empty (-1, no rank), so nothing moves: parts stay in the order of bytes.
        """
        n = np.array([len(w) for w in words])
        m, widest = len(words), int(n.max())
        # an empty place on either side stands for what does not merge
        part = np.full((m, widest + 2), -1, np.int32)
        part[:, 1:-1][np.arange(widest) < n[:, None]] = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        rank = np.full(part.shape, _NONE, np.int32)
        rank[:, 1:-1] = self.ranks(part[:, 1:-1], part[:, 2:])
        place = np.arange(widest + 2, dtype=np.int16)
        before, after = np.tile(place - 1, (m, 1)), np.tile(place + 1, (m, 1))
        live = np.arange(m)
        while len(live):
            r = rank[live]
            at = r.argmin(1)  # the leftmost of equal ranks
            low = r[np.arange(len(live)), at]
            on = low != _NONE
            live, at, low = live[on], at[on], low[on]
            gone = after[live, at]
            new, left, right = self.merged[low], before[live, at], after[live, gone]
            part[live, at], part[live, gone], rank[live, gone] = new, -1, _NONE
            after[live, at], before[live, right] = right, at
            both = self.ranks(np.concatenate([part[live, left], new]), np.concatenate([new, part[live, right]]))
            rank[live, left], rank[live, at] = both[: len(live)], both[len(live) :]
        held = part >= 0
        raw, ends = part[held].tobytes(), (4 * np.cumsum(held.sum(1))).tolist()
        return [raw[i:j] for i, j in zip([0, *ends], ends, strict=False)]

    def _merge_long(self, word: bytes) -> np.ndarray:
        """The same merges in the same order, with the pairs in a heap: n log n for a word of n bytes."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)]
        rank = self.ranks(ids[:-1], ids[1:])
        part = ids.tolist()
        after, before, n = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1)), len(part)
        heap = [(int(rank[i]), i, part[i], part[i + 1]) for i in np.flatnonzero(rank != _NONE).tolist()]
        heapq.heapify(heap)

        def push(i: int) -> None:
            j = after[i]
            if j < n:
                r = int(self.ranks(np.array([part[i]]), np.array([part[j]]))[0])
                if r != _NONE:
                    heapq.heappush(heap, (r, i, part[i], part[j]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j >= n or part[j] != b:
                continue
            part[i], part[j], after[i] = int(self.merged[r]), -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return np.array([p for p in part if p >= 0], np.int32)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each pre-token as little-endian int32 bytes."""
        out, by_length = [b""] * len(words), {}
        for i, w in enumerate(words):
            by_length.setdefault(min((len(w) + 3) // 4, SHORT // 4 + 1), []).append(i)  # lengths of a row differ by 3 at most
        for band, group in by_length.items():
            if 4 * band > SHORT:
                for i in group:
                    out[i] = self._merge_long(words[i]).tobytes()
            elif band:
                for i, ids in zip(group, self._merge_short([words[i] for i in group]), strict=True):
                    out[i] = ids
        return out

    def _learn(self, units: list[str]) -> None:
        """Put the ids of units into the cache: see _units for what a unit stands for."""
        find = self.split.findall
        cut = []
        for u in units:
            if u.isalpha():
                cut.append((" " + u,))
            elif u[0] != _WHOLE:
                cut.append(find(u if u[0] == "\n" else " " + u))
            else:
                cut.append(find(u[2:]) if u[1] == _WHOLE else (u[1:],))
        words = list({w for c in cut for w in c})
        ids = dict(zip(words, self.merge([w.encode() for w in words]), strict=True))
        for u, c in zip(units, cut, strict=True):
            self.cache[u] = ids[c[0]] if len(c) == 1 else b"".join([ids[w] for w in c])

    def _units(self, text: str) -> list[str]:
        """Units of a text, each of them encoded by itself.

        The pattern always cuts before a blank or line feed that follows a non-blank character and precedes another,
        and after such a line feed. A unit is what stands behind such a blank, or such a line feed with what follows
        it; the text's start is marked _WHOLE twice. Texts with other white space are cut by the pattern itself; each
        of its pre-tokens, marked _WHOLE once, is a unit.
        """
        if not text:
            return []
        if text.split() != text.replace("\n", " ").split(" "):
            return [_WHOLE + w for w in self.split.findall(text)]
        units = text.replace("\n", " \n").split(" ")
        units[0] = _WHOLE + _WHOLE + units[0]
        return units

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts as little-endian int32 bytes; a null text has none."""
        made = []
        for t in texts:
            if t and self.special_split and any(s in t for s in self.special):
                units = []
                for s in self.special_split.split(t):
                    units += [_SPECIAL + s] if s in self.special else self._units(s)
                made.append(units)
            else:
                made.append(self._units(t or ""))
        cache, wanted = self.cache, set().union(*made)
        if len(cache) + len(wanted) > REMEMBERED:  # what is in use just now is what comes again soonest
            cache = self.cache = {u: cache[u] for u in wanted if u in cache}
        new = wanted.difference(cache)
        for u in [u for u in new if u[0] == _SPECIAL]:
            cache[u] = np.int32(self.special[u[1:]]).tobytes()
            new.remove(u)
        self._learn(list(new))
        return [b"".join(map(cache.__getitem__, units)) for units in made]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a sequence of ids, each id's stretch of the byte table copied in turn. Unknown ids raise."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        if not len(ids) or not ends[-1]:
            return b""
        return self.bytes[np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - n), n)].tobytes()


@functools.cache
def load(path: str) -> ByteBpe:
    """One a Python worker; its tasks share the memory of words."""
    return ByteBpe(path)


def _others(docs: DataFrame, added: tuple[str, ...]) -> tuple[list[str], str]:
    kept = [c for c in docs.columns if c not in added]
    return kept, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*kept).schema)


def _text(coder: ByteBpe, ids: np.ndarray) -> str:
    return coder.decode(ids).decode("utf-8", "replace")


def encode(docs: DataFrame, vocabulary: str | None = None, keep_text: bool = True, decoded: bool = False) -> DataFrame:
    """`docs` with token_ids array<int> and n_tokens long. The file is read on the executors: it stands on each of them.

    With `decoded`, the ids are decoded again in the same pass and stand as text in a column of this name, as `decode`
    gives it. Null and empty texts have no tokens. Very long texts and words are encoded whole. Columns of these names
    are replaced; keep_text=False leaves `text` out. No shuffle; rows that repeat are encoded each.
    """
    path = vocabulary or default_vocabulary()
    added = ("token_ids", "n_tokens") + (("decoded",) if decoded else ())
    kept, schema = _others(docs if keep_text else docs.drop("text"), added)

    def make():
        bpe = load(path)

        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = bpe.encode(batch.column("text").to_pylist())
            ends = np.cumsum([0, *[len(r) // 4 for r in rows]])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(rows), np.int32)))
            made = [ids, pa.array(np.diff(ends), pa.int64())]
            if decoded:
                made.append(pa.array([_text(bpe, np.frombuffer(r, np.int32)) for r in rows], pa.string()))
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], [*kept, *added])

        return fn

    schema += "token_ids array<int>, n_tokens long" + (", decoded string" if decoded else "")
    return map_slices(docs.select(*kept, *(["text"] if "text" not in kept else [])), make, schema, rows=ROWS, limit=BYTES)


def decode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """`docs` with decoded string: its token_ids back as text, special tokens included; bytes that are no UTF-8 become U+FFFD.

    Null or empty token_ids decode to the empty text. A column named decoded is replaced. No shuffle.
    """
    path = vocabulary or default_vocabulary()
    kept, schema = _others(docs, ("decoded",))

    def make():
        bpe = load(path)

        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists = batch.column("token_ids")
            text = [_text(bpe, lists[i].values.to_numpy(zero_copy_only=False)) if lists[i].is_valid else "" for i in range(len(lists))]
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(text, pa.string())], [*kept, "decoded"])

        return fn

    return map_slices(docs, make, f"{schema}decoded string", limit=BYTES)
