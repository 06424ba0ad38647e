"""Best-fit packing of token sequences with certified bin counts."""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, numbered, save, slices, small_batches

CAPACITY = 2048
#: Pieces that one group packs in the first round, and at most, give or take chance.
GROUP_PIECES, MOST_PIECES = 4096, 65536
#: Words, and runs of characters between white space, whose ids a worker keeps at least.
CACHE_WORDS = 200_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

# Texts of these characters only: NFC leaves them alone and lower-casing maps one to one,
# so that the tokenizer's split can be done by the standard library. Others go to the tokenizer whole.
_PLAIN = re.compile("[\x00-\x1b\x20-\x84\x86-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ɏ]*")
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


class _Ids(dict):
    """Ids by text; what is missing is made and kept. A full table becomes the older one, from which texts that are
    asked for again move over, so that frequent ones stay."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make, self.older = make, {}

    def __missing__(self, text: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(text)
        if ids is None:
            ids = self.make(text)
        self[text] = ids
        return ids

    def forget(self) -> None:
        self.clear()
        self.older = {}


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 is itself, others follow U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


#: The set-up of a file whose split into words _WORDS is.
_KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class WordTokenizer:
    """Ids of texts as little-endian unsigned 32-bit integers. Each distinct word is encoded once.

    No token holds white space, so the ids of a run without white space are kept as well as those of its words. A
    file whose normaliser or split is another than _KNOWN is left to the library. `special`: texts that have the name
    of a special token in them give its id; else it is ordinary text.
    """

    def __init__(self, path: str, special: bool = False):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        model, letters = self.tokenizer.model, _byte_letters()
        setup = json.loads(self.tokenizer.to_str())
        self.known = all(setup[k] == v for k, v in _KNOWN.items()) and setup["model"]["type"] == "BPE" and not any(setup[k] for k in ("truncation", "padding", "post_processor"))
        self.names = re.compile("|".join(re.escape(t["content"]) for t in setup["added_tokens"] if special or not t["special"]) or r"(?!)", re.I)

        def word(w: str) -> bytes:
            own = w if w.isascii() and w.isprintable() else "".join([letters[b] for b in w.encode()])
            return array("I", [t.id for t in model.tokenize(own)]).tobytes()

        words = self.words = _Ids(word)
        self.runs = _Ids(lambda run: b"".join([words[w] for w in _WORDS.findall(run)]))

    def forget(self) -> None:
        self.words.forget()
        self.runs.forget()

    def whole(self, texts: list[str]) -> list[bytes]:
        """By the library alone."""
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, text: str) -> bool:
        return self.known and _PLAIN.fullmatch(text) is not None and self.names.search(text) is None

    def encode(self, texts: list[str]) -> list[bytes]:
        get = self.runs.__getitem__
        return [b"".join(map(get, t.lower().split())) if self._plain(t) else self.whole([t])[0] for t in texts]


_tokenizers: dict[tuple[str, bool], WordTokenizer] = {}


def _tokenizer(path: str, special: bool) -> WordTokenizer:
    if (path, special) not in _tokenizers:
        _tokenizers[path, special] = WordTokenizer(path, special)
    return _tokenizers[path, special]


def tokenize_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, special: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32. A document's ids end with `end_id`; only a longer one is cut."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = _tokenizer(path, special), np.array([end_id], dtype="<u4").tobytes()
        for part in slices(batches, most=4 << 20):
            rows: list[tuple] = []
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), tok.encode(part.column("text").to_pylist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(own) // 4, zlib.crc32(own)))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        tok.forget()

    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.mapInArrow(run, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, by dual feasible functions.

    u(x; k) takes x > c - k as a whole bin, k <= x <= c - k in proportion and smaller x as nothing, for every k
    up to c / 2; with U(x; k) = floor((k + 1) x / c) / k for x not a multiple, for k up to 20.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    n_upto, s_upto = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    best = -(-int(s_upto[-1]) // capacity)
    for k in range(1, capacity // 2 + 1):
        whole = int(n_upto[-1] - n_upto[capacity - k])
        middle = int(s_upto[capacity - k] - s_upto[k - 1])
        best = max(best, whole + -(-middle // capacity))
    sizes = np.flatnonzero(count)
    for k in range(1, 21):
        scaled = (k + 1) * sizes
        value = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)  # times k * capacity
        best = max(best, -(-int((value * count[sizes]).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and place of each item, and the number of bins. Bins with room are found by a bit per room left."""
    order = np.argsort(-lengths, kind="stable")
    bins, places = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, n = 0, 0
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = mask >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            own = room[left].pop()
            if not room[left]:
                mask ^= 1 << left
        else:
            left, own, n = capacity, n, n + 1
        bins[i], places[i] = own, capacity - left
        left -= size
        if left:
            room[left].append(own)
            mask |= 1 << left
    return bins, places, n


def _repack(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        lengths = rows["length"].to_numpy()
        bins, places, n = best_fit_decreasing(lengths, capacity)
        least, group = lower_bound(lengths, capacity), int(rows["new_group"].iloc[0])
        before = rows.loc[rows["seq"] >= 0, ["old_group", "seq"]].drop_duplicates() if (rows["seq"] >= 0).all() else None
        if before is not None and len(before) <= n:  # the exchange has not helped
            code = rows["old_group"].to_numpy() * (1 << 40) + rows["seq"].to_numpy()
            bins, places, n = np.unique(code, return_inverse=True)[1], rows["place"].to_numpy(), len(before)
        return rows.assign(seq=bins, place=places, old_group=group, gap=n - least)

    return run


_PACKED = PIECES + ", new_group long, old_group long, seq long, place long, gap long"


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, most_pieces: int = MOST_PIECES) -> DataFrame:
    """Pieces with sequence_id and offset, in as few sequences as best fit finds.

    Pieces are dealt by hash to groups, equal rows to different ones. Each group is packed by best fit decreasing, and
    a lower bound from dual feasible functions certifies its number of bins or shows a gap. The groups with a
    gap are numbered anew, each two exchange their documents and are packed again as one, until no gap is left or
    groups have `most_pieces`; a result that is no better is not taken. Pieces of one length go by doc_id and piece.
    """
    saved = save(pieces, "pieces")
    n = saved.count()
    groups = max(1, -(-n // group_pieces))
    dealt = saved.withColumn("at", F.monotonically_increasing_id())  # of files as they were written: always the same
    dealt = dealt.withColumns(
        {
            "new_group": F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "at"), F.lit(groups)),
            "old_group": F.lit(-1).cast("long"),
            "seq": F.lit(-1).cast("long"),
            "place": F.lit(-1).cast("long"),
            "gap": F.lit(0).cast("long"),
        }
    ).drop("at")
    open_, done, k, size = dealt, None, 0, group_pieces
    while True:
        packed = save(open_.groupBy("new_group").applyInPandas(_repack(capacity), _PACKED), "packed")
        left = packed.where("gap > 0").select("old_group").distinct().count() if groups > 1 and 2 * size <= most_pieces else 0
        last = left < 2
        # ids of finished groups: the round and the group make them unique
        closed = (packed if last else packed.where("gap <= 0")).withColumn("round", F.lit(k))
        done = closed if done is None else done.unionByName(closed)
        if last:
            break
        pairs = numbered(packed.where("gap > 0"), "old_group", "number").select("old_group", F.shiftright("number", 1).alias("pair"))
        open_ = packed.where("gap > 0").join(pairs, "old_group").withColumn("new_group", F.col("pair")).drop("pair")
        groups, size, k = left, 2 * size, k + 1
    sequence = (F.col("round").cast("long") * (1 << 58)) + F.shiftleft(F.col("old_group"), 26) + F.col("seq")
    return done.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), F.col("place").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, special: bool = False) -> DataFrame:
    """Pack documents (null text: empty, so its end id alone) into sequences of at most `capacity` tokens.

    A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Long texts are cut into pieces and
    nothing is left out; repeated rows are packed each; ties in length go by doc_id, piece and ids. Names of special tokens
    in a text are ordinary text, unless `special`. Other columns of docs are left behind.
    """
    small_batches(docs.sparkSession)
    return pack_pieces(tokenize_pieces(docs, tokenizer_path, capacity, special=special), capacity)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2,048 tokens. A null or empty text is its end id; long ones are cut; repeated rows
    are packed each."""
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
