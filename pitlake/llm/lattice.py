"""Language-model scores: words marginalised over all their segmentations into subword pieces."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, gather, mix64, save, slices, small_batches
from .langid import crc_of_id

#: Words, and bytes of words, whose counts a task holds before it sends them, and words whose scores each worker holds.
HELD_WORDS, HELD_BYTES, FREQUENT = 300_000, 32 << 20, 200_000
#: Chance that a word ends after a piece, if it is written in pieces.
STOP = 0.3
#: Words and bytes of a batch in the forward recursion, and characters of a word that goes through it by itself, in slices.
BATCH, BATCH_BYTES, LONG = 20_000, 4 << 20, 20_000
START = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def read_vocabulary(path: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Pieces of a sentencepiece file, their scores and the place of each byte's piece (-1: none).

    Scores that are ranks, as merge vocabularies have them, become probabilities by Zipf's law.
    """
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, scores, of_byte = [], [], np.full(256, -1)
    for i in range(p.get_piece_size()):
        if p.is_control(i) or p.is_unknown(i):
            continue
        if p.is_byte(i):
            of_byte[int(p.id_to_piece(i)[3:-1], 16)] = len(pieces)
            pieces.append("")
        else:
            pieces.append(p.id_to_piece(i))
        scores.append(p.get_score(i))
    raw = np.array(scores)
    texts = np.array([bool(x) for x in pieces])
    if len(raw) and (raw[texts] == np.round(raw[texts])).all():
        order = np.argsort(np.argsort(-raw, kind="stable"), kind="stable")
        order[~texts] = len(raw)
        raw = -np.log(10.0 + order)
    logs = raw - np.log(np.exp(raw - raw.max()).sum()) - raw.max()
    return pieces, logs, of_byte


class Lattice:
    """The forward recursion, in log space, over all ways to write words in pieces. A word starts with START.

    A word is written piece by piece, each by the vocabulary's probabilities, and ends after one with probability
    `stop`: the probabilities of all words together are at most 1.
    """

    def __init__(self, pieces: list[str], logs: np.ndarray, of_byte: np.ndarray, stop: float = STOP):
        self.logs, self.of_byte = np.asarray(logs, dtype=np.float64) + np.log(1 - stop), of_byte
        self.last = np.log(stop / (1 - stop))
        self.longest = max(map(len, pieces), default=1)
        keys = np.array([self._hash(p) for p in pieces if p], dtype=np.uint64)
        places = np.array([i for i, p in enumerate(pieces) if p], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.places = keys[order], places[order]
        self.maybe = np.zeros(1 << 22, dtype=bool)
        self.maybe[(self.keys >> np.uint64(42)).astype(np.int64)] = True

    @staticmethod
    def _hash(piece: str) -> int:
        h = np.zeros(1, dtype=np.uint64)
        for c in piece:
            h = h * _BASE + np.uint64(ord(c))
        return int(mix64(h)[0])

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Places of pieces by the hashes of texts, -1 for none."""
        out = np.full(h.shape, -1, dtype=np.int64)
        h = mix64(h)
        at = np.nonzero(self.maybe[(h >> np.uint64(42)).astype(np.int64)])
        some = h[at]
        k = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
        out[at] = np.where(self.keys[k] == some, self.places[k], -1)
        return out

    def _edges(self, chars: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """By length: log probabilities of the pieces from each start."""
        n, size = chars.shape
        h, out = np.zeros(chars.shape, dtype=np.uint64), []
        for k in range(1, min(self.longest, size) + 1):
            h = h[:, : size - k + 1] * _BASE + chars[:, k - 1 :]
            found = self._find(h)
            if (found >= 0).any():
                out.append((k, np.where(found >= 0, self.logs[found], -np.inf)))
        return out

    def _bytes(self, chars: np.ndarray) -> np.ndarray:
        """Log probability of each character by its bytes."""
        kinds, back = np.unique(chars, return_inverse=True)
        own = [sum(self.logs[self.of_byte[b]] if self.of_byte[b] >= 0 else -np.inf for b in chr(int(c)).encode()) for c in kinds]
        return np.array(own)[back].reshape(chars.shape)

    @staticmethod
    def _batches(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        for k in np.unique(size).tolist():
            at = np.flatnonzero(size == k)
            step = max(1, BATCH * 8 // (k + 1))
            for i in range(0, len(at), step):
                own = at[i : i + step]
                flat = np.frombuffer("".join(START + words[j] for j in own.tolist()).encode("utf-32-le"), dtype="<u4")
                yield own, flat.reshape(len(own), k + 1).astype(np.uint64)

    @staticmethod
    def _forward(edges: list, spelled: np.ndarray) -> np.ndarray:
        n, size = spelled.shape
        a = np.full((size + 1, n), -np.inf)
        a[0] = 0.0
        with np.errstate(invalid="ignore"):
            for t in range(1, size + 1):
                total = a[t - 1] + spelled[:, t - 1]
                for k, p in edges:
                    if k <= t:
                        total = np.logaddexp(total, a[t - k] + p[:, t - k])
                a[t] = total
        return a

    def log_marginals(self, words: list[str]) -> np.ndarray:
        """Natural log of the probability of each word, summed over its segmentations."""
        out = np.zeros(len(words))
        usual = [i for i, w in enumerate(words) if len(w) < LONG]
        for own, chars in self._batches([words[i] for i in usual]):
            out[np.array(usual)[own]] = self._forward(self._edges(chars), self._bytes(chars))[-1] + self.last
        for i, w in enumerate(words):
            if len(w) >= LONG:
                out[i] = self._long(w) + self.last
        return out

    def _long(self, word: str) -> float:
        """The recursion over one long word, of which a slice and the ends of the longest pieces are held."""
        ends = [0.0]  # log probabilities of the last places, up to the one reached
        word, keep = START + word, self.longest
        for at in range(0, len(word), LONG):
            before = min(at, keep - 1)
            chars = np.frombuffer(word[at - before : at + LONG].encode("utf-32-le"), dtype="<u4").astype(np.uint64)[None, :]
            size, spelled = chars.shape[1], self._bytes(chars)[0].tolist()
            into: list[list] = [[] for _ in range(size + 1)]
            for k, p in self._edges(chars):
                for start in np.flatnonzero(p[0] > -np.inf).tolist():
                    into[start + k].append((k, float(p[0][start])))
            a = ends[-1 - before :]
            for t in range(before + 1, size + 1):
                from_ = [a[t - 1] + spelled[t - 1], *(a[t - k] + p for k, p in into[t])]
                top = max(from_)
                a.append(top + math.log(sum(math.exp(x - top) for x in from_)) if top > -math.inf else top)
            ends = a[-keep:]
        return ends[-1]


@frugal
def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[bytes, int] = {}
    size = 0

    def send() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])
        held.clear()
        return out

    for part in slices(batches):
        for learn, text in zip(part.column("learn").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
            for w, n in Counter(text.lower().split()).items():
                if w not in held:
                    size += len(w)
                    held[w] = 0
                if learn:
                    held[w] += n
            if len(held) > HELD_WORDS or size > HELD_BYTES:
                yield send()
                size = 0
    yield send()


def _score(frequent: object):
    """For each text the sums over its frequent words, as a row whose word no text has, and a row for each other word."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, table = frequent.value
        at = {w: i for i, w in enumerate(words)}
        names = ["word", "doc_id", "row", "times", "n_tokens", "known", "base", "score"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        for part in slices(batches, most=4 << 20):
            rows: list[tuple] = []
            for doc_id, row, text in zip(part.column("doc_id").to_pylist(), part.column("row").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                own = text.lower().split()
                i = np.fromiter(map(at.get, own, repeat(-1)), dtype=np.int64, count=len(own))
                sums = table[i[i >= 0]].sum(axis=0)
                rows.append((f"\n{doc_id} {row}", doc_id, row, 1, len(own), int(sums[0]), sums[1], sums[2]))
                rows.extend((w.decode(), doc_id, row, n, 0, 0, 0.0, 0.0) for w, n in Counter([own[k] for k in np.flatnonzero(i < 0).tolist()]).items())
            cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return run


def commonest(words: DataFrame, most: int) -> int:
    """The least count from which on there are at most `most` words, on a scale of eight steps an octave."""
    step = F.floor(8 * F.log2("c")).cast("int")
    hist = words.where("c > 0").groupBy(step.alias("k")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("k")).collect()
    total, least = 0, None
    for r in hist:
        total += r.n
        if total > most:
            break
        least = r.k
    return 1 << 62 if least is None else int(np.ceil(2 ** (least / 8) - 1e-9))


def score_texts(docs: DataFrame, learn: Column, vocabulary_path: str, frequent: int = FREQUENT) -> DataFrame:
    """A row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words of the text with A-Z in lower case, and one end. Counts are learned from the documents
    where `learn` holds. base_score sums log10((c + 1) / (N + V + 1)). score sums log10((c - D) / N + w (1 - e) q):
    the lattice of a word has all segmentations into pieces of the vocabulary, weighted by its own scores, whose
    probabilities q sums, and one arc more, the word as a whole with its share of the training tokens, less a discount D
    from counts of counts. What the discounts leave, w = D V / N, weighs the lattice of pieces against whole words; of
    it the end of the text has the share e that it has among the tokens, so that the model's probabilities sum to
    no more than 1. A null text counts as empty, so it is its end alone. The `frequent` commonest words are sent to
    every task; all others are joined. Long texts and words are read whole, in slices; equal counts are treated alike;
    rows that repeat doc_id and text come out alike; other columns of docs are left behind.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(learn, F.lit(True)).alias("learn"))
    counted = texts.select("text", "learn").mapInArrow(_count_words, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))
    counts = save(counted, "words")
    pieces, logs, of_byte = read_vocabulary(vocabulary_path)

    @frugal
    def marginal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces, logs, of_byte)
        for whole in gather(batches, BATCH, BATCH_BYTES):
            for batch in slices(iter([whole]), "word", BATCH_BYTES):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lattice.log_marginals(batch.column("word").to_pylist()) / np.log(10))], names=["word", "c", "q"])

    found = save(counts.mapInArrow(marginal, "word string, c long, q double"), "marginals")
    sums = found.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), *(F.count_if(x).alias(k) for k, x in (("v", F.col("c") > 0), ("n1", F.col("c") == 1), ("n2", F.col("c") == 2)))).first()
    ends = texts.where("learn").count()
    n, v = sums.n + ends, sums.v + (1 if ends else 0)
    cut = min(0.9, max(0.1, sums.n1 / (sums.n1 + 2 * sums.n2))) if sums.n1 else 0.5
    left, end_share = (cut * v / n, ends / n) if n else (1.0, 0.5)

    def model(c: Column, q: Column) -> Column:
        new = F.lit(float(np.log10(left))) + q
        return F.when(c > 0, F.log10((c - cut) / F.lit(float(n)) + left * F.pow(F.lit(10.0), q))).otherwise(new)

    def base(c: Column) -> Column:
        return F.log10((c + 1) / F.lit(float(n + v + 1)))

    known = (F.col("c") > 0).cast("long")
    pieced = F.col("q") + F.lit(math.log10(1 - end_share) if end_share < 1 else -400.0)
    scored = found.select("word", known.alias("k"), base(F.col("c")).alias("b"), model(F.col("c"), pieced).alias("s"))
    top = found.where(F.col("c") >= commonest(found, frequent)).select("word", known.alias("k"), base(F.col("c")).alias("b"), model(F.col("c"), pieced).alias("s")).toPandas()
    sent = spark.sparkContext.broadcast(([w.encode() for w in top["word"]], top[["k", "b", "s"]].to_numpy(dtype=np.float64)))
    rows = texts.select("doc_id", "text", F.xxhash64("text").alias("row")).mapInArrow(_score(sent), "word string, doc_id long, row long, times long, n_tokens long, known long, base double, score double")
    doc = F.col("word").startswith("\n")
    joined = rows.join(scored.withColumnRenamed("word", "w"), F.col("word") == F.col("w"), "left").select(
        "doc_id",
        "row",
        F.when(doc, 1).otherwise(0).cast("long").alias("copies"),
        "n_tokens",
        F.when(doc, F.col("known")).otherwise(F.col("times") * F.col("k")).alias("known"),
        F.when(doc, F.col("base")).otherwise(F.col("times") * F.col("b")).alias("base"),
        F.when(doc, F.col("score")).otherwise(F.col("times") * F.col("s")).alias("score"),
    )
    by_doc = joined.groupBy("doc_id", "row").agg(*(F.sum(c).alias(c) for c in ("copies", "n_tokens", "known", "base", "score")))
    end = float(ends)
    one = spark.range(1).select(base(F.lit(end)).alias("b"), model(F.lit(end), F.lit(math.log10(end_share) if ends else -400.0)).alias("s")).first()
    return by_doc.select(
        "doc_id",
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
        (F.col("n_tokens") / F.col("copies") + 1).cast("long").alias("n_tokens"),
        (F.col("known") / F.col("copies") + (1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("copies") + F.lit(one.b)).alias("base_score"),
        (F.col("score") / F.col("copies") + F.lit(one.s)).alias("score"),
    ).drop("copy")


def op2_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from those not held out. A null or empty text is its end alone; long ones are read
    whole; repeated rows come out alike."""
    import public_tokenizers

    held = F.pmod(crc_of_id(), F.lit(7)) == 2
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score_texts(docs, ~held, public_tokenizers.path("piece_bpe_32k.model"))
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
