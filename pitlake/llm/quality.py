"""Quality rules: simple counts, and perplexity bands under language-specific Kneser-Ney models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import charlm
from .common import frugal, histogram_median, mix64, save, slices, small_batches

#: Words of a window whose repeats count.
WINDOW = 8
#: Bands: so many robust standard deviations, and at least so many bits a symbol, around the language's median.
BAND_SD, BAND_BITS = 5.0, 0.22
#: Models whose names are sent to every task.
MANY = 100_000
#: The group of documents without a language, and what parts a language from the half of its texts.
NO_LANGUAGE, FOLD = "", "\x01"


def n_repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that the text has twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = mix64(np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64))
    w = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        w = w * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    _, back, count = np.unique(mix64(w), return_inverse=True, return_counts=True)
    twice = count[back] > 1
    if not twice.any():
        return 0
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(cover, np.flatnonzero(twice), 1)
    np.add.at(cover, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def counts_of(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = text.encode().split()
    space = sum(map(text.count, " \t\n\v\f\r"))
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(" \t\n\v\f\r"):
            seen.add(line)
    return len(words), len(text) - space, sum(map(text.count, "#*$%&|<>")), dup, n_repeat_words(words)


_MEASURED = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, bits double, symbols long"


def _measure(blobs: Broadcast):
    """Counts of texts, and their cross-entropy under the model that the column `own` names."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = charlm.Kept(blobs.value)
        for part in slices(batches, most=4 << 20):
            n = part.num_rows
            texts = [t or "" for t in part.column("text").to_pylist()]
            sums, size, by_model = np.zeros(n), np.zeros(n, np.int64), {}
            for i, own in enumerate(part.column("own").to_pylist()):
                if own in models.blobs:
                    by_model.setdefault(own, []).append(i)
            for own, rows in by_model.items():
                places = np.array(rows)
                for keys, owner in charlm.grams([texts[i] for i in rows], True):
                    at = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                    sums[places[owner[at]]] -= np.add.reduceat(models[own].logs(keys), at, dtype=np.float64)
                    size[places[owner[at]]] += np.diff(np.append(at, len(owner)))
            counted = [np.array(c, dtype=np.int64) for c in zip(*map(counts_of, texts), strict=True)] or [np.zeros(0, np.int64)] * 5
            bits = pa.array(sums / np.maximum(size, 1), mask=size == 0)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), *map(pa.array, counted), bits, pa.array(size)], names=[f.split()[0] for f in _MEASURED.split(", ")])

    return run


def quality_rules(docs: DataFrame, min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """A row per document: doc_id, lang, the counts, bits, base_failed and kept.

    Models are learned from all texts of each language (a null language is one of its own), one from either half of
    them by a hash of the text, and a text is measured by the half that it and its copies are not in, since a model
    knows what it has been taught (a language with one half has no other). A document whose
    base counts fail is not kept; another is kept if its cross-entropy a symbol (the logarithm of its perplexity)
    lies in its language's band, around the median, with a width that allows for its length. A text on the band's
    edge is kept. A language whose spread cannot be told (one text) rejects nothing. A null text counts as empty, and
    fails. Long texts are read whole, in steps; repeated rows come out alike. Models go to the tasks in parts of
    charlm.PASS_BYTES, and each text is read with the part that its model is in.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce(F.col("lang"), F.lit(NO_LANGUAGE)).alias("lang"), F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("fold"), "text")
    models = save(charlm.fit(charlm.count(rows.select(F.concat("lang", F.lit(FOLD), "fold").alias("lang"), "text"), True)), "perplexity")
    halves = models.groupBy(F.expr("substr(lang, 1, length(lang) - 2)").alias("_lang")).agg(F.max(F.expr("substr(lang, -1)")).alias("_top"), F.count(F.lit(1)).alias("_halves"))
    other = F.when(F.col("_halves") == 2, (1 - F.col("fold")).cast("string")).otherwise(F.col("_top"))
    parts = list(charlm.passes(models))
    few = sum(map(len, parts)) <= MANY  # a row a language; a join splits a frequent one where they are many
    named = rows.join(F.broadcast(halves) if few else halves, F.col("lang") == F.col("_lang"), "left").select("doc_id", "lang", "text", F.concat("lang", F.lit(FOLD), other).alias("own"))
    spark = docs.sparkSession
    measured = None
    for i, part in enumerate(parts or [{}]):
        mine = named
        if len(parts) > 1:
            mine = named.where(F.col("own").isin(list(part)) if i else F.col("own").isin(list(part)) | F.col("own").isNull())
        out = mine.mapInArrow(_measure(spark.sparkContext.broadcast(part)), _MEASURED)
        measured = out if measured is None else measured.unionByName(out)
    measured = save(measured, "measured")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    sound = measured.where(~failed & F.col("bits").isNotNull())
    middle = histogram_median(sound, "lang", F.col("bits"), "median")
    off = sound.join(F.broadcast(middle), "lang").select("lang", F.abs(F.col("bits") - F.col("median")).alias("whole"), (F.abs(F.col("bits") - F.col("median")) * F.sqrt("symbols")).alias("each"))
    spread = middle.join(histogram_median(off, "lang", F.col("each"), "each"), "lang").join(histogram_median(off, "lang", F.col("whole"), "whole"), "lang")
    wide = F.greatest(F.lit(BAND_BITS), BAND_SD * 1.4826 * F.greatest(F.col("each") / F.sqrt(F.greatest("symbols", F.lit(1))), F.col("whole")))
    verdict = F.coalesce(F.abs(F.col("bits") - F.col("median")) <= wide, F.lit(True))
    return (
        measured.join(F.broadcast(save(spread, "bands")), "lang", "left")
        .withColumn("base_failed", failed)
        .select("doc_id", F.nullif("lang", F.lit(NO_LANGUAGE)).alias("lang"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & verdict).alias("kept"), "bits")
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents. A null or empty text fails the base counts; long texts are read whole; repeated
    rows come out alike."""
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("lang", "bits")
