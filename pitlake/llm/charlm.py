"""Character n-gram models with interpolated modified Kneser-Ney smoothing, in sorted hash arrays.

A symbol is a lower-case code point (16 bits; code points beyond U+FFFF share the 2,048 surrogates by a hash), so that
an n-gram of up to ORDER symbols is one 64-bit number and no script is folded together. Tasks count n-grams in sorted
arrays, Spark sums them by n-gram, and a language's distinct n-grams are fitted together. A model holds, for each
order, the hashes of its n-grams in sorted order with their log probabilities, and those of its contexts with what
they leave to the next order. A model grows with the distinct n-grams of its language only.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, mix64, release, slices

ORDER, BITS = 4, 16
SYMBOLS = 1 << BITS
GAP, DIGIT = 0, ord("0")
#: Code points whose n-grams are looked up at once.
STEP = 1 << 19
#: Distinct n-grams that a task holds before it sends them, and those not yet merged.
HELD, LOOSE = 4_000_000, 2_000_000
#: Bytes of packed models that one pass over texts sends to the tasks, and of unpacked ones that a task keeps.
PASS_BYTES, KEPT_BYTES = 64 << 20, 256 << 20

_MASK = [np.uint64((1 << BITS * k) - 1) for k in range(ORDER + 1)]
_16 = np.uint64(BITS)
_LATIN = re.compile("[A-Za-z]")


@cache
def folding(marks: bool) -> np.ndarray:
    """Code point to symbol: letters and combining marks without case; with `marks`, digits are one symbol, and
    punctuation and signs are themselves; all else is a gap."""
    table = np.zeros(0x110000, dtype=np.uint16)
    for cp in (*range(0x33000), *range(0xE0100, 0xE01F0)):  # nothing beyond has a letter or sign
        c = chr(cp)
        kind = unicodedata.category(c)[0]
        if kind in "LM":
            low = ord(c.lower()[0])
        elif marks and kind in "NPS":
            low = DIGIT if kind == "N" else cp
        else:
            continue
        table[cp] = low if low < 0x10000 else 0xD800 + (low * 2654435761 >> 9) % 2048
    return table


@cache
def letters() -> np.ndarray:
    out = np.zeros(0x110000, dtype=bool)
    out[:0x33000] = np.fromiter((unicodedata.category(chr(cp))[0] == "L" for cp in range(0x33000)), dtype=bool, count=0x33000)
    return out


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def has_letter(text: str) -> bool:
    return _LATIN.search(text) is not None or any(letters()[points(text[i : i + STEP])].any() for i in range(0, len(text), STEP))


def _packed(s: np.ndarray) -> np.ndarray:
    """n-grams of symbols of which the first ORDER - 1 are context."""
    n = len(s) - ORDER + 1
    s = s.astype(np.uint64)
    out = s[ORDER - 1 :].copy()
    for j in range(1, ORDER):
        out |= s[ORDER - 1 - j : ORDER - 1 - j + n] << np.uint64(BITS * j)
    return out


def grams(texts: list[str], marks: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(n-grams, numbers of their texts) of texts in steps of about STEP: one for each symbol and a last gap. Runs
    of gaps are one; a text without symbols has none. What stands before a text's beginning is gaps."""
    table, at = folding(marks), 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (size + len(texts[to]) <= STEP or to == at):
            size += len(texts[to])
            to += 1
        if size <= STEP:
            own = texts[at:to]
            s = table[points("\n".join(own) + "\n")]
            owner = np.repeat(np.arange(at, to), np.fromiter(map(len, own), dtype=np.int64, count=to - at) + 1)
            keep = s != GAP
            keep[1:] |= (s[:-1] != GAP) & (owner[1:] == owner[:-1])
            s, owner = s[keep], owner[keep]
            if len(s):
                keys = _packed(np.concatenate([np.zeros(ORDER - 1, np.uint16), s]))
                begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                for j in range(1, ORDER):  # what stands before belongs to another text
                    at = begin[np.append(begin[1:], len(s)) - begin >= j] + (j - 1)
                    keys[at] &= _MASK[j]
                yield keys, owner
        else:  # one long text
            before = np.zeros(ORDER - 1, np.uint16)
            for k in range(0, size, STEP):
                s = table[points(texts[at][k : k + STEP])]
                if k + STEP >= size:
                    s = np.append(s, np.uint16(GAP))
                keep = s != GAP
                keep[1:] |= s[:-1] != GAP
                keep[:1] |= before[-1] != GAP
                s = np.concatenate([before, s[keep]])
                before = s[len(s) - ORDER + 1 :]
                if len(s) >= ORDER:
                    yield _packed(s), np.full(len(s) - ORDER + 1, at)
        at = to


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[at], np.add.reduceat(counts, at)


def _count(marks: bool):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}
        loose = 0

        def merge() -> None:
            for name, parts in found.items():
                if len(parts) > 1:
                    found[name] = [_merged(parts)]

        def send() -> Iterator[pa.RecordBatch]:
            merge()
            for name, ((keys, counts),) in found.items():
                langs = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(keys), np.int32)), [name]).cast(pa.string())
                yield pa.RecordBatch.from_arrays([langs, pa.array(keys.view(np.int64)), pa.array(counts)], names=["lang", "gram", "c"])
            found.clear()

        for part in slices(batches, most=4 << 20):
            by_name: dict[str, list[str]] = {}
            for name, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                if text:
                    by_name.setdefault(name, []).append(text)
            for name, texts in by_name.items():
                for keys, _ in grams(texts, marks):
                    own = np.unique(keys, return_counts=True)
                    found.setdefault(name, []).append(own)
                    loose += len(own[0])
                    if loose > LOOSE:
                        merge()
                        loose = 0
                        if sum(len(p[0]) for parts in found.values() for p in parts) > HELD:
                            yield from send()
        yield from send()

    return run


def count(docs: DataFrame, marks: bool) -> DataFrame:
    """lang, gram, c: the n-grams of each language in docs (lang, not null; text). Each task counts its own texts and
    sends an n-gram once, so a frequent language or n-gram is no hot key. Null and empty texts add nothing."""
    sent = docs.select("lang", "text").mapInArrow(_count(marks), "lang string, gram long, c long")
    return sent.groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def kneser_ney(keys: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """A model from sorted distinct n-grams and their counts, as arrays: for each order, the lowest first, n-grams, log2
    of their probabilities, contexts, and log2 of what these leave to the order below.

    Modified Kneser-Ney: three discounts per order from counts of counts; lower orders use continuation counts;
    every order is interpolated with the next and the last with the uniform distribution over all symbols.
    """
    levels = [(keys, counts.astype(np.float64))]
    for k in range(ORDER - 1, 0, -1):
        lower, n = np.unique(levels[0][0] & _MASK[k], return_counts=True)
        levels.insert(0, (lower, n.astype(np.float64)))
    out: list[np.ndarray] = []
    below_keys, below = np.zeros(1, np.uint64), np.array([1.0 / SYMBOLS])
    for k, (own, c) in enumerate(levels):
        n = [int((c == i).sum()) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        d = [min(i, max(0.1, i - (i + 1) * y * n[i] / n[i - 1])) if n[i - 1] and n[i] else 0.5 * i for i in (1, 2, 3)]
        cut = np.where(c >= 3, d[2], np.where(c == 2, d[1], d[0]))
        context = own >> _16
        at = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
        size = np.diff(np.append(at, len(own)))
        total, left = np.add.reduceat(c, at), np.add.reduceat(cut, at)
        p = below[np.searchsorted(below_keys, own & _MASK[k])] if k else below[0]
        p = (c - cut) / np.repeat(total, size) + np.repeat(left / total, size) * p
        out += [own, np.log2(p).astype(np.float32), context[at], np.log2(left / total).astype(np.float32)]
        below_keys, below = own, p
    return out


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays of n-grams and of values by turns; n-grams as differences."""
    parts = [np.diff(a, prepend=np.zeros(1, a.dtype)) if i % 2 == 0 else a for i, a in enumerate(arrays)]
    head = np.array([len(parts), *map(len, parts)], dtype="<i8").tobytes()
    return zstandard.ZstdCompressor(3).compress(head + b"".join(a.tobytes() for a in parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    at, out = 8 * (n + 1), []
    for i, size in enumerate(np.frombuffer(raw, "<i8", n, 8).tolist()):
        kind = "<u8" if i % 2 == 0 else "<f4"
        a = np.frombuffer(raw, kind, size, at)
        at += a.nbytes
        out.append(np.cumsum(a, dtype=np.uint64) if i % 2 == 0 else a)
    return out


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    keys = rows["gram"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    counts = rows["c"].to_numpy()[order]
    blob = pack(kneser_ney(keys[order], counts))
    out = pd.DataFrame({"lang": [rows["lang"].iloc[0]], "ngrams": [len(keys)], "total": [int(counts.sum())], "model": [blob]})
    release()
    return out


def fit(counts: DataFrame) -> DataFrame:
    """Models by language from lang, gram, c: lang, ngrams, total, model. A task holds the distinct n-grams of a language."""
    return counts.groupBy("lang").applyInPandas(_fit, "lang string, ngrams long, total long, model binary")


class HashArray:
    """Numbers in the order of their hashes, found by the hash's first bits and a step or two from there."""

    def __init__(self, keys: np.ndarray):
        h = mix64(keys)
        self.order = np.argsort(h)
        self.hashes = np.append(h[self.order], np.uint64(0))
        bits = max(1, min(26, len(keys).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(self.hashes[:-1], np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int64)
        self.start = np.append(self.start, len(keys))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places in the order of hashes, -1 for none."""
        h = mix64(keys)
        bucket = (h >> self.shift).astype(np.int64)
        out = self.start[bucket]
        miss = np.flatnonzero(self.hashes[out] != h)
        out[miss] += 1
        end = self.start[bucket[miss] + 1]
        while len(miss):
            over = out[miss] >= end
            out[miss[over]] = -1
            miss, end = miss[~over], end[~over]
            go = self.hashes[out[miss]] != h[miss]
            miss, end = miss[go], end[go]
            out[miss] += 1
        if len(self.hashes) == 1:
            out[:] = -1
        return out

    @property
    def nbytes(self) -> int:
        return self.hashes.nbytes + self.start.nbytes


class Model:
    """log2 probabilities of n-grams' last symbols, given those before."""

    def __init__(self, blob: bytes):
        arrays = unpack(blob)
        self.levels = []
        for k in range(0, len(arrays), 4):
            own, left = HashArray(arrays[k]), HashArray(arrays[k + 2])
            self.levels.append((own, arrays[k + 1][own.order], left, arrays[k + 3][left.order]))
            own.order = left.order = None
        self.keys = arrays[-4]
        self.nbytes = self.keys.nbytes + sum(a.nbytes + p.nbytes + b.nbytes + q.nbytes for a, p, b, q in self.levels)

    def logs(self, keys: np.ndarray) -> np.ndarray:
        out, open_, rest = np.zeros(len(keys), dtype=np.float32), np.arange(len(keys)), keys
        for k in range(ORDER, 0, -1):
            own, p, left, q = self.levels[k - 1]
            at = own.find(rest & _MASK[k] if k < ORDER else rest)
            hit = at >= 0
            out[open_[hit]] += p[at[hit]]
            if hit.all():
                return out
            open_, rest = open_[~hit], rest[~hit]
            at = left.find((rest & _MASK[k]) >> _16)
            seen = at >= 0
            out[open_[seen]] += q[at[seen]]
        out[open_] -= BITS
        return out


class Joint:
    """Several models: the n-grams that any of them has are in one array with a row of all their values."""

    def __init__(self, models: list[Model]):
        self.models = models
        keys = np.unique(np.concatenate([m.keys for m in models]))
        self.array = HashArray(keys)
        keys = keys[self.array.order]
        self.values = np.stack([m.logs(keys) for m in models], axis=1) if len(keys) else np.zeros((0, len(models)), np.float32)

    def logs(self, keys: np.ndarray) -> np.ndarray:
        """A row for each n-gram, a column for each model."""
        at = self.array.find(keys)
        miss = np.flatnonzero(at < 0)
        out = self.values[at] if len(self.values) else np.zeros((len(keys), len(self.models)), np.float32)
        if len(miss):
            some, back = np.unique(keys[miss], return_inverse=True)
            out[miss] = np.stack([m.logs(some) for m in self.models], axis=1)[back]
        return out


def passes(models: DataFrame, most: int = PASS_BYTES) -> Iterator[dict[str, bytes]]:
    """Packed models by name, in parts of at most `most` bytes each; a larger model is a part of its own. Names go
    by their order."""
    part: dict[str, bytes] = {}
    for r in models.select("lang", "model").orderBy("lang").toLocalIterator():
        if part and sum(map(len, part.values())) + len(r.model) > most:
            yield part
            part = {}
        part[r.lang] = bytes(r.model)
    if part:
        yield part


class Kept:
    """Models by name, unpacked when they are asked for; the longest unused go when they take too much room."""

    def __init__(self, blobs: dict[str, bytes]):
        self.blobs, self.held = blobs, {}

    def __getitem__(self, name: str) -> Model:
        model = self.held.pop(name, None) or Model(self.blobs[name])
        while self.held and model.nbytes + sum(m.nbytes for m in self.held.values()) > KEPT_BYTES:
            self.held.pop(next(iter(self.held)))
        self.held[name] = model
        return model
