"""Removal of repeated passages: exact counts of word windows in super-k-mer buckets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import frugal, mix64, parts_for, save, slices, small_batches, text_bytes

#: Words of a window, and of a minimiser.
WINDOW, MINIMISER = 50, 4
#: Windows of one super-k-mer at most; a longer run is cut into several.
LONGEST = 256
#: Text bytes whose super-k-mers are packed together, and packed bytes of a bucket.
CHUNK_BYTES, BUCKET_BYTES = 16 << 20, 8 << 20
#: Bytes of a bucket from which on its windows are dealt by their own hashes, and documents of the sample that tells which
#: minimisers have as many, whose windows are from the start.
SPLIT_BYTES, SAMPLE = 48 << 20, 20_000
#: Parts into which equal windows are dealt where their smallest doc_id is looked for.
SALTS = 16
#: Bytes whose hashes are computed at once.
STEP = 1 << 19
#: Stands for a null doc_id: larger than any other.
LAST = np.iinfo(np.int64).max

_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)


@cache
def _bytes_table() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD[2]))


_held: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of an odd number and of its inverse modulo 2 ** 64; the longest made are kept."""

    def run(b: int, m: int) -> np.ndarray:
        a = np.full(m, b, dtype=np.uint64)
        a[0] = 1
        return np.multiply.accumulate(a)

    if base not in _held or len(_held[base][0]) < n:
        m = 1 << max(10, n.bit_length())
        _held[base] = run(base, m), run(pow(base, -1, 1 << 64), m)
    return _held[base]


def _ranges_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hashes of values[start:end], the same wherever the values stand."""
    up, down = _powers(base, len(values) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)])
    return mix64((sums[ends] - sums[starts]) * down[starts])


class Words:
    """Words of several texts, joined by one space: bytes, places and hashes."""

    def __init__(self, parts: list[bytes]):
        """parts: texts whose words are joined by one space already; an empty one has no words."""
        self.counts = np.fromiter((p.count(b" ") + 1 if p else 0 for p in parts), dtype=np.int64, count=len(parts))
        self.joined = b" ".join([p for p in parts if p])
        raw = np.frombuffer(self.joined, dtype=np.uint8)
        gaps = np.flatnonzero(raw == 32)
        full = len(raw) > 0
        self.starts = np.concatenate([np.zeros(1, np.int64), gaps + 1]) if full else np.zeros(0, np.int64)
        self.ends = np.concatenate([gaps, np.array([len(raw)])]) if full else np.zeros(0, np.int64)
        self.hashes = np.empty(len(self.starts), dtype=np.uint64)
        at, n = 0, len(self.starts)
        while at < n:
            base = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, base + STEP)))
            if to == at + 1 and self.ends[at] - base > STEP:  # one huge word
                self.hashes[at] = int.from_bytes(hashlib.blake2b(self.joined[base : self.ends[at]], digest_size=8).digest(), "little")
            else:
                values = _bytes_table()[raw[base : self.ends[to - 1]]]
                self.hashes[at:to] = _ranges_hash(values, self.starts[at:to] - base, self.ends[at:to] - base, _ODD[0])
            at = to

    def sequences(self, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
        """Hashes of runs of words; computed in steps that overlap by the longest run."""
        out = np.empty(len(starts), dtype=np.uint64)
        step = STEP // 8
        for at in range(0, len(self.hashes), step):
            own = np.flatnonzero((starts >= at) & (starts < at + step))
            if len(own):
                to = int(ends[own].max())
                out[own] = _ranges_hash(self.hashes[at:to], starts[own] - at, ends[own] - at, base)
        return out


def super_kmers(words: Words, window: int = WINDOW, m: int = MINIMISER) -> tuple[np.ndarray, ...]:
    """Runs of windows that share a minimiser: first window, number of windows, minimiser, two hashes of the run's words, and the text's number."""
    n = len(words.hashes)
    text = np.repeat(np.arange(len(words.counts)), words.counts)
    count = n - window + 1
    if count <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.int64, np.int64, np.int64))
    at = np.arange(n - m + 1)
    small = words.sequences(at, at + m, _ODD[1])
    span, width = window - m + 1, 1
    while 2 * width <= span:
        small = np.minimum(small[: len(small) - width], small[width:])
        width *= 2
    low = np.minimum(small[:count], small[span - width : span - width + count])
    valid = text[:count] == text[window - 1 :]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (low[1:] != low[:-1])
    first = np.flatnonzero(new)
    last = np.flatnonzero(valid & np.append(new[1:] | ~valid[1:], True))
    size = last - first + 1
    cuts = -(-size // LONGEST)
    if len(cuts) and cuts.max() > 1:
        part = np.arange(int(cuts.sum())) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        first, whole = np.repeat(first, cuts) + part * LONGEST, np.repeat(size, cuts)
        size = np.minimum(LONGEST, whole - part * LONGEST)
    ends = first + size + window - 1
    one, two = (words.sequences(first, ends, b).view(np.int64) for b in (_ODD[1], _ODD[2]))
    return first, size, low[first], one, two, text[first]


def _ids(column: pa.Array) -> np.ndarray:
    return np.asarray(pa.compute.fill_null(column, LAST), dtype=np.int64)


def _words_of(part: pa.RecordBatch) -> Words:
    return Words([b" ".join(t.split()) for t in part.column("text").cast(pa.binary()).to_pylist()])


def _minimisers(window: int):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=2 << 20):
            _, _, low, one, _, _ = super_kmers(_words_of(part), window)
            yield pa.RecordBatch.from_arrays([pa.array(low.view(np.int64)), pa.array(one)], names=["low", "one"])

    return run


def _hot_minimisers(docs: DataFrame, window: int, packed_bytes: int) -> np.ndarray:
    """Minimisers whose different super-k-mers would take SPLIT_BYTES and more, by their share in a sample; at most as many
    as packed_bytes has room for. They only say how windows travel, never which are counted."""
    n = docs.count()
    some = docs.sample(min(1.0, SAMPLE / n), seed=1) if n else docs
    found = some.mapInArrow(_minimisers(window), "low long, one long").distinct()
    share = F.lit(SPLIT_BYTES / max(packed_bytes, 1))
    sizes = found.groupBy("low").agg(F.count(F.lit(1)).alias("n")).where("n > 50")
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return np.sort(np.array([r.low for r in sizes.crossJoin(F.broadcast(total)).where(F.col("n") >= F.col("total") * share).select("low").collect()], dtype=np.int64).view(np.uint64))


def _pack_chunks(window: int, buckets: int, hot: np.ndarray):
    """Distinct super-k-mers of each chunk of texts, packed for their buckets with the smallest doc_id that has them. Those of
    a hot minimiser go to buckets by their own hashes, which have numbers below 0."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list] = {}
        held = 0

        def send() -> Iterator[pa.RecordBatch]:
            dealt: dict[int, list] = {}
            for (one, two), (bucket, doc, several, packed) in found.items():
                dealt.setdefault(bucket, []).append((one, two, doc, several, packed))
            found.clear()
            squeeze = zstandard.ZstdCompressor(5)
            blobs = []
            for rows in dealt.values():
                one, two, doc, several, packed = zip(*rows, strict=True)
                head = np.array([one, two, doc, several, list(map(len, packed))], dtype="<i8")
                blobs.append(squeeze.compress(np.array([len(rows)], "<i8").tobytes() + head.tobytes() + b"".join(packed)))
            yield pa.RecordBatch.from_arrays([pa.array(list(dealt), pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "packed"])

        for part in slices(batches, most=2 << 20):
            words, docs = _words_of(part), _ids(part.column("doc_id"))
            first, size, low, one, two, text = super_kmers(words, window)
            begin, end = words.starts[first].tolist(), words.ends[first + size + window - 2].tolist()
            bucket = (low % np.uint64(buckets)).astype(np.int64)
            if len(hot):
                own = hot[np.minimum(np.searchsorted(hot, low), len(hot) - 1)] == low
                bucket[own] = -1 - (one[own].view(np.uint64) % np.uint64(buckets)).astype(np.int64)
            for b, e, k, key, doc in zip(begin, end, bucket.tolist(), zip(one.tolist(), two.tolist(), strict=True), docs[text].tolist(), strict=True):
                if key in found:
                    old = found[key]
                    _check_same(old[3], words.joined[b:e])
                    if doc != old[1]:
                        old[1], old[2] = min(doc, old[1]), 1
                else:
                    found[key] = [k, doc, 0, words.joined[b:e]]
                    held += e - b
            if held > 3 * CHUNK_BYTES:
                yield from send()
                held = 0
        yield from send()

    return run


def _check_same(a: bytes, b: bytes) -> None:
    """Strings with one 128-bit hash must be equal, since places of words are joined by it."""
    if a != b:
        raise ValueError("two different passages have the same 128-bit hash; change _ODD")


def _same(words: Words, window: int, order: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Where the sorted windows differ from the one before. Neighbours with equal fingerprints are compared whole."""
    new = np.ones(len(order), dtype=bool)
    new[1:] = prints[order[1:]] != prints[order[:-1]]
    joined, starts, ends = words.joined, words.starts, words.ends
    for k in np.flatnonzero(~new).tolist():
        i, j = order[k - 1], order[k]
        new[k] = joined[starts[i] : ends[i + window - 1]] != joined[starts[j] : ends[j + window - 1]]
    return new


def _read(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Words]:
    """Two hashes, smallest doc_id and whether there are several, and the words, of the distinct super-k-mers of blobs."""
    heads, texts = [], []
    for blob in blobs:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        head = np.frombuffer(raw, "<i8", 5 * n, 8).reshape(5, n)
        heads.append(head)
        at = 8 + 40 * n
        for size in head[4].tolist():
            texts.append(raw[at : at + size])
            at += size
    one, two, doc, several, _ = np.concatenate(heads, axis=1)
    order = np.lexsort((doc, two, one))
    one, two, doc, several = (x[order] for x in (one, two, doc, several))
    new = np.ones(len(one), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    for k in np.flatnonzero(~new).tolist():
        _check_same(texts[order[k - 1]], texts[order[k]])
    at = np.flatnonzero(new)
    several = (np.maximum.reduceat(several, at) > 0) | (np.maximum.reduceat(doc, at) != doc[at])
    return one[at], two[at], doc[at], several, Words([texts[i] for i in order[at].tolist()])


def _windows_of(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Super-k-mer and first word of each window."""
    base = np.cumsum(words.counts) - words.counts
    size = words.counts - window + 1
    run = np.repeat(np.arange(len(size)), size)
    return run, base[run] + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


def _count_bucket(blobs: list[bytes], window: int) -> tuple[list, list, list, list, list]:
    """For each super-k-mer that some document has after another: runs of its windows with the smallest doc_id of each."""
    one, two, doc, several, words = _read(blobs)
    run, start = _windows_of(words, window)
    size = words.counts - window + 1
    prints = words.sequences(start, start + window, _ODD[0])
    full = np.zeros(len(words.hashes), dtype=np.uint64)
    full[start] = prints
    # equal windows lie next to each other, and of different windows with one fingerprint the text decides
    sorted_ = start[np.argsort(prints, kind="stable")]
    differs = _same(words, window, sorted_, full)
    owner = np.zeros(len(words.hashes), dtype=np.int64)
    owner[start] = doc[run]
    if (differs[1:] & (full[sorted_[1:]] == full[sorted_[:-1]])).any():
        texts_at = [words.joined[words.starts[i] : words.ends[i + window - 1]] for i in sorted_.tolist()]
        again = np.array(sorted(range(len(texts_at)), key=texts_at.__getitem__))
        sorted_, differs = sorted_[again], np.array([True, *(texts_at[a] != texts_at[b] for a, b in zip(again, again[1:], strict=False))])
    groups = np.flatnonzero(differs)
    least = np.zeros(len(words.hashes), dtype=np.int64)
    if len(groups):
        least[sorted_] = np.repeat(np.minimum.reduceat(owner[sorted_], groups), np.diff(np.append(groups, len(sorted_))))
    least = least[start]
    hit = np.zeros(len(one), dtype=bool)
    np.logical_or.at(hit, run, least < doc[run])
    out: tuple[list, list, list, list, list] = ([], [], [], [], [])
    ends = np.cumsum(size)
    for s in np.flatnonzero(hit | several).tolist():
        own = least[ends[s] - size[s] : ends[s]]
        cut = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        for column, value in zip(out, (int(one[s]), int(two[s]), cut.tolist(), np.diff(np.append(cut, len(own))).tolist(), own[cut].tolist()), strict=True):
            column.append(value)
    return out


def _prints(blobs: list[bytes], window: int) -> tuple[list, list, list, list, list, list]:
    """For each super-k-mer: its hashes, smallest doc_id and whether there are several, and two hashes of each window."""
    one, two, doc, several, words = _read(blobs)
    _, start = _windows_of(words, window)
    hashes = [words.sequences(start, start + window, b).view(np.int64) for b in (_ODD[0], _ODD[2])]
    ends = np.cumsum(words.counts - window + 1)[:-1]
    return one.tolist(), two.tolist(), doc.tolist(), several.tolist(), *([x.tolist() for x in np.split(h, ends)] for h in hashes)


_COUNTED = "one long, two long, place array<int>, size array<int>, least array<long>, doc long, several boolean, p array<long>, q array<long>"


def _count_windows(window: int):
    """Rows come sorted by bucket. A bucket is counted in itself; if it is of a hot minimiser, or larger than SPLIT_BYTES, its
    super-k-mers come back in parts with hashes of all their windows, to be counted together with all others."""
    kinds = [pa.int64(), pa.int64(), *[pa.list_(t) for t in (pa.int32(), pa.int32(), pa.int64())], pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = [f.split()[0] for f in _COUNTED.split(", ")]

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs, held, split = None, [], 0, False

        def send() -> Iterator[pa.RecordBatch]:
            if blobs and not split:
                found = _count_bucket(blobs, window)
                none = [None] * len(found[0])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((*found, none, none, none, none), kinds, strict=True)], names=names)
            elif blobs:
                one, two, doc, several, p, q = _prints(blobs, window)
                none = [None] * len(one)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((one, two, none, none, none, doc, several, p, q), kinds, strict=True)], names=names)

        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                if bucket != now:
                    yield from send()
                    now, blobs, held, split = bucket, [], 0, bucket < 0
                elif held > (SPLIT_BYTES >> 4 if split else SPLIT_BYTES >> 2):  # compressed to about a quarter
                    split = True
                    yield from send()
                    blobs, held = [], 0
                blobs.append(blob)
                held += len(blob)
        yield from send()

    return run


def _least_of_windows(split: DataFrame) -> DataFrame:
    """one, two, place, size, least of super-k-mers that came back with hashes of their windows. Equal windows are dealt
    over SALTS parts, whose smallest doc_ids are merged, so a window that many documents have is in no single task."""
    each = split.select("one", "two", "doc", "several", F.posexplode(F.arrays_zip("p", "q")).alias("at", "w"))
    each = each.select("one", "two", "doc", "several", "at", "w.p", "w.q", F.pmod("one", F.lit(SALTS)).cast("int").alias("salt"))
    parts = each.groupBy("p", "q", "salt").agg(F.min("doc").alias("low"))
    least = parts.select("p", "q", "salt", F.min("low").over(Window.partitionBy("p", "q")).alias("low"))
    found = each.join(least, ["p", "q", "salt"]).where("low < doc OR several")
    return found.select("one", "two", F.array("at").alias("place"), F.array(F.lit(1)).alias("size"), F.array("low").alias("least"))


def _find_runs(window: int):
    """Where each text has its super-k-mers."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=2 << 20):
            words = _words_of(part)
            first, _, _, one, two, text = super_kmers(words, window)
            base = np.cumsum(words.counts) - words.counts
            yield pa.RecordBatch.from_arrays(
                [pa.array(one), pa.array(two), part.column("doc_id").take(pa.array(text)), part.column("row").take(pa.array(text)), pa.array((first - base[text]).astype(np.int32))],
                names=["one", "two", "doc_id", "row", "first"],
            )

    return run


def repeated_ranges(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Runs of words that a document with a smaller doc_id has too: doc_id, row (xxhash64 of the text), first, end.

    Consecutive windows that share a minimiser travel as one packed string to the minimiser's bucket, each string
    once a chunk, so a passage or a text that many documents share is no hot key. A bucket sorts its windows,
    compares neighbours whole and notes for each window the smallest doc_id. Where different contexts of one
    minimiser are many, as a sample or the bucket's own size shows, windows are dealt by 128-bit hashes of their own instead.
    The super-k-mers that matter are joined to their places in the documents, by 128-bit hashes of theirs; strings that
    share one are compared wherever they meet. That join may be split where one of them is frequent.
    """
    total = text_bytes(docs)
    buckets = parts_for(int(3.1 * total), BUCKET_BYTES)
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("row"))
    hot = _hot_minimisers(texts.select("text"), window, int(3.1 * total))
    packed = texts.select("doc_id", "text").mapInArrow(_pack_chunks(window, buckets, hot), "bucket long, packed binary")
    counted = save(packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_count_windows(window), _COUNTED), "windows")
    counted = counted.where("p IS NULL").select("one", "two", "place", "size", "least").unionByName(_least_of_windows(counted.where("p IS NOT NULL")))
    places = texts.mapInArrow(_find_runs(window), "one long, two long, doc_id long, row long, first int")
    return (
        places.join(counted, ["one", "two"])
        .select("doc_id", "row", "first", F.explode(F.arrays_zip("place", "size", "least")).alias("w"))
        .where(F.col("w.least") < F.coalesce("doc_id", F.lit(int(LAST))))
        .select("doc_id", "row", (F.col("first") + F.col("w.place")).alias("first"), (F.col("first") + F.col("w.place") + F.col("w.size") + (window - 1)).alias("end"))
    )


_CUT = "doc_id long, n_words long, n_removed long, kept string"


def _cut(digest: bool):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=2 << 20):
            rows = []
            for doc_id, text, first, end in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "first", "end")), strict=True):
                words = text.encode().split()
                n = len(words)
                if first:
                    cover = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(cover, np.array(first), 1)
                    np.add.at(cover, np.array(end), -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]
                kept = b" ".join(words)
                rows.append((doc_id, n, n - len(words), hashlib.sha256(kept).hexdigest() if digest else kept.decode()))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, digest: bool = False) -> DataFrame:
    """A row per document: doc_id, n_words, n_removed and kept, the words left joined by one space (or their SHA-256).

    A word goes if a window of `window` words that covers it also starts in a document with a smaller doc_id;
    windows are judged on the input. A null text has no words; a text shorter than the window keeps all. A null
    doc_id counts as the largest. Rows that share a doc_id are not before one another, and repeated rows come
    out alike. Long texts are read whole; other columns of docs are left behind.
    """
    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    texts = texts.withColumn("row", F.xxhash64("text"))
    ranges = repeated_ranges(docs, window).groupBy("doc_id", "row").agg(F.collect_set(F.struct("first", "end")).alias("r"))
    ranges = ranges.select(F.col("doc_id").alias("_doc"), F.col("row").alias("_row"), F.col("r.first").alias("first"), F.col("r.end").alias("end"))
    joined = texts.join(ranges, texts.doc_id.eqNullSafe(ranges._doc) & (texts.row == ranges._row), "left")
    return joined.select("doc_id", "text", "first", "end").mapInArrow(_cut(digest), _CUT)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words in all documents that a smaller doc_id has. A null or empty text has no words; long ones are read
    whole; repeated rows come out alike."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True).withColumnRenamed("kept", "kept_sha256")
