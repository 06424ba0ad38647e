"""Byte-level BPE over a global shuffle of distinct words, and decoding."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, parts_for, release, slices, small_batches, text_bytes

#: Text bytes of a chunk, and of all texts by bucket of words; code points from which on a text's words are not held
#: together, and words that a text takes up at once.
CHUNK_BYTES, BUCKET_BYTES, LONG, STEP = 32 << 20, 16 << 20, 1 << 20, 1 << 18

# The White_Space property, as the tokenizer library has it; Python's \s has U+001C to U+001F besides.
_SPACE = r"\t-\r \x85\xa0  -     　"
# Texts of these characters only: letters, digits and spaces are the same to the standard library.
_PLAIN = re.compile("[\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]*")
_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")


class PreTokenizer:
    """Matches of a pattern in order; together they are the text."""

    def __init__(self, pattern: str, plain: bool = True):
        import regex

        exact = pattern.replace(r"[^\s", "[^" + _SPACE).replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]")
        self.exact, self.plain = regex.compile(exact), plain

    def split(self, text: str) -> list[str]:
        return list(self.words(text))

    def words(self, text: str) -> Iterable[str]:
        """Matches one after the other; those of a long text are not held together."""
        pattern = _FAST if self.plain and _PLAIN.fullmatch(text) else self.exact
        return pattern.findall(text) if len(text) < LONG else map(itemgetter(0), pattern.finditer(text))


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


#: Numbers up to here are one byte in a squeezed array; larger ones are two bytes more, behind it.
_SHORT = 192


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers below 2 ** 22 as one compressed string; a larger number makes its array's bytes stand as they are."""
    head, body = [len(arrays)], []
    for a in arrays:
        a = a.astype(np.uint32)
        short = a < _SHORT
        wide = int(len(a) > 0 and a.max() >= (256 - _SHORT) << 16)
        rest = a[~short]
        head += [wide, len(a), len(rest)]
        if wide:
            body.append(a.astype("<u4").view(np.uint8).reshape(-1, 4).T)
        else:
            body += [np.where(short, a, _SHORT + (a >> 16)).astype(np.uint8), (rest & 0xFFFF).astype("<u2").view(np.uint8).reshape(-1, 2).T]
    return zstandard.ZstdCompressor(3).compress(np.array(head, "<u4").tobytes() + b"".join(np.ascontiguousarray(x).tobytes() for x in body))


def _expand(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    at, out = 4 * (3 * n + 1), []
    for wide, size, rest in np.frombuffer(raw, "<u4", 3 * n, 4).reshape(n, 3).tolist():
        if wide:
            out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * size, at).reshape(4, size).T).view("<u4").reshape(-1))
            at += 4 * size
            continue
        a = np.frombuffer(raw, np.uint8, size, at).astype(np.uint32)
        low = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 2 * rest, at + size).reshape(2, rest).T).view("<u2").reshape(-1)
        long = a >= _SHORT
        a[long] = (a[long] - _SHORT) << 16 | low
        out.append(a)
        at += size + 2 * rest
    return out


def _pack(parts: list[bytes]) -> bytes:
    """Byte strings as one compressed string."""
    sizes = np.fromiter(map(len, parts), dtype="<u4", count=len(parts))
    return zstandard.ZstdCompressor(3).compress(np.uint32(len(parts)).tobytes() + sizes.tobytes() + b"".join(parts))


def _unpack(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = np.concatenate([[0], np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64)]) + 4 * (n + 1)
    at = ends.tolist()
    return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]


class _Numbers(dict):
    """Numbers of words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


#: bucket: that of `words`, or -1 for the chunk's documents: `ids` are theirs, and `words` the numbers of all their words in
#: order, with the ends of the documents and the numbers of the words of all buckets.
_SPLIT = "chunk long, bucket int, ids array<long>, words binary"


def _split(pattern: str, plain: bool, chunk_bytes: int, buckets: int):
    """Chunks, which are runs of documents of about `chunk_bytes`: the positions of their words by number, and their distinct
    words dealt to buckets by a hash of the word."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre, chunk = PreTokenizer(pattern, plain), TaskContext.get().partitionId() << 32
        numbers, ids, texts, held = _Numbers(), [], [], 0

        def send() -> Iterator[pa.RecordBatch]:
            dealt: dict[int, list[tuple[bytes, int]]] = {}
            for word, n in numbers.items():
                b = word.encode()
                dealt.setdefault(zlib.crc32(b) % buckets, []).append((b, n))
            keys, packed, places = sorted(dealt), [], []
            for k in keys:
                words, own = zip(*sorted(dealt.pop(k)), strict=True)
                packed.append(_pack(list(words)))
                places += own
            docs = _squeeze(np.concatenate(texts), np.array([len(x) for x in texts]), np.array(places))
            n = len(keys)
            lists = pa.array([None] * n + [ids], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk] * (n + 1), pa.int64()), pa.array([*keys, -1], pa.int32()), lists, pa.array([*packed, docs], pa.binary())], names=[f.split()[0] for f in _SPLIT.split(", ")]
            )

        for part in slices(batches, most=4 << 20):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append(np.fromiter(map(numbers.__getitem__, pre.words(text)), dtype=np.uint32))
                held += len(text)
                if held >= chunk_bytes:
                    yield from send()
                    numbers, ids, texts, held, chunk = _Numbers(), [], [], 0, chunk + 1
        if ids:
            yield from send()

    return run


def _encode_words(ranks_path: str, pattern: str):
    """Encode each distinct word of a bucket once, for all chunks that have it. Rows come sorted by bucket; ids go back as
    their numbers by word and all of them. Rows of documents go through."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={}).encode_ordinary
        ids: dict[bytes, list[int]] = {}
        now = None
        for batch in batches:
            out = []
            for bucket, words in zip(batch.column("bucket").to_pylist(), batch.column("words").to_pylist(), strict=True):
                if bucket < 0:
                    out.append(words)
                    continue
                if bucket != now:
                    now, ids = bucket, {}
                found = []
                for w in _unpack(words):
                    own = ids.get(w)
                    if own is None:
                        own = ids[w] = encode(w.decode())
                    found.append(own)
                out.append(_squeeze(np.fromiter(map(len, found), dtype=np.uint32, count=len(found)), np.fromiter(chain.from_iterable(found), dtype=np.uint32)))
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("bucket"), batch.column("ids"), pa.array(out, pa.binary())], names=batch.schema.names)

    return run


def _taken(flat: np.ndarray, size: np.ndarray, start: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs flat[start:start + size] of the places, one after the other."""
    n = size[at]
    return flat[np.repeat(start[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


class TokenTable:
    """Bytes of tokens by id."""

    def __init__(self, ranks_path: str):
        ranks = read_ranks(ranks_path)
        tokens = [b""] * (1 + max(ranks.values()))
        for token, i in ranks.items():
            tokens[i] = token
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        self.start = np.cumsum(self.size) - self.size

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids one after the other: a join with the table, by id."""
        return _taken(self.flat, self.size, self.start, ids)


@cache
def token_table(ranks_path: str) -> TokenTable:
    return TokenTable(ranks_path)


def _assemble(ranks_path: str, each: Callable | None, fields: str, decode: bool):
    """The documents of a chunk from the ids of its words, by position."""
    names = [f.split()[0] for f in fields.split(", ")]
    kinds = {"binary": pa.binary(), "string": pa.string(), "long": pa.int64()}

    def run(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("bucket").to_numpy()).tolist()  # the documents' row is the first
        numbers, lengths, places = _expand(rows.column("words")[order[0]].as_py())
        parts = [_expand(rows.column("words")[k].as_py()) for k in order[1:]]
        empty = np.zeros(0, np.uint32)
        size, flat = (np.concatenate([p[i] for p in parts] or [empty]) for i in (0, 1))
        size = size.astype(np.int64)
        at = np.empty(len(places), dtype=np.int64)
        at[places] = np.arange(len(places))  # where each number's word is
        tables = [(flat, size, np.cumsum(size) - size)]
        if decode:
            table = token_table(ranks_path)
            length = np.concatenate([[0], np.cumsum(table.size[flat])])
            start = length[np.cumsum(size) - size]
            tables.append((table.decode(flat), length[np.cumsum(size)] - start, start))
        out, begin = [], 0
        for end in np.cumsum(lengths, dtype=np.int64).tolist():
            row = [b"".join(_taken(*t, at[numbers[i : min(end, i + STEP)]]).tobytes() for i in range(begin, end, STEP)) for t in tables]
            out.append(each(*row) if each else tuple(row))
            begin = end
        cols = list(zip(*out, strict=True)) or [[]] * len(names)
        found = pa.table({"doc_id": rows.column("ids")[order[0]].values} | {k: pa.array(c, kinds[f.split()[1]]) for k, c, f in zip(names, cols, fields.split(", "), strict=True)})
        release()
        return found

    return run


def encode_documents(
    docs: DataFrame, ranks_path: str, pattern: str, each: Callable | None = None, fields: str = "ids binary", decode: bool = False, chunk_bytes: int = CHUNK_BYTES, plain: bool = True
) -> DataFrame:
    """Each document's token ids (little-endian unsigned 32-bit, `ids`), or what `each(ids)` makes of them, as `fields`.

    Texts are split once. A chunk, a run of documents, notes its words in the order of their positions by number, and
    sends its distinct words to buckets by word, packed. A bucket encodes each of its words once for all chunks
    and sends the ids back, and the chunk's documents take them up by position. With `decode` they are decoded again
    by way of the table of tokens, and it is each(ids, bytes). A frequent word is there once a chunk, a hot source is
    many chunks. A null text counts as empty; long texts are read whole, one being a chunk at most; repeated rows are
    encoded each; other columns of docs are left behind. `plain`: the pattern is the one that the standard library's
    fast form equals.
    """
    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    total = text_bytes(docs)
    buckets = parts_for(total, BUCKET_BYTES)
    parts = texts.mapInArrow(_split(pattern, plain, chunk_bytes, buckets), _SPLIT)
    target = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("chunk"), F.lit(buckets))).otherwise(F.col("bucket"))  # one shuffle for both kinds
    encoded = parts.repartition(buckets, target).sortWithinPartitions("bucket").mapInArrow(_encode_words(ranks_path, pattern), _SPLIT)
    return encoded.repartition(parts_for(total, chunk_bytes), "chunk").groupBy("chunk").applyInArrow(_assemble(ranks_path, each, fields, decode), "doc_id long, " + fields)


def decode_documents(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and text of encoded documents: ids are joined with the table of tokens, which has the vocabulary's size. Null
    ids: an empty text."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_table(ranks_path)
        for part in slices(batches, "ids"):
            texts = [table.decode(np.frombuffer(x or b"", "<u4")).tobytes().decode("utf-8", "replace") for x in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, and their texts again, as digests. A null or empty text has no ids; long ones are read
    whole; repeated rows come out alike."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    def digest(ids: bytes, decoded: bytes) -> tuple:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, path, public_tokenizers.PATTERN, digest, "n_tokens long, ids_sha256 string, decoded_sha256 string", decode=True)
