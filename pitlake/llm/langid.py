"""Language identification by character n-gram cross-entropy."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import charlm
from .common import frugal, histogram_median, save, slices, small_batches

UNKNOWN = "und"
#: Rejection: robust standard deviations, and bits a symbol, above what texts of the language have.
REJECT_SD, REJECT_BITS = 8.0, 0.6
#: Languages whose models one pass over the texts holds side by side.
PASS_MODELS = 24


@dataclass(frozen=True)
class LanguageModels:
    """Models (lang, model), and what was learned on texts that those of the other half were measured on: the score's
    calibration odds = exp(offset) * (1 + lead) ** slope, and by language the cross-entropy that texts have."""

    table: DataFrame
    offset: float = 0.0
    slope: float = 1.0
    usual: tuple[tuple[str, float, float], ...] = ()


_FOUND = T.StructType().add("_li_lang", "string").add("_li_bits", "double").add("_li_second", "double").add("_li_size", "long").add("_li_has", "boolean")


def _scores(models: Broadcast, carry: bool) -> Callable:
    """Best and second best of the models of this pass and of the passes before."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, joint = list(models.value), None
        for part in slices(batches, most=4 << 20):
            n = part.num_rows
            lang, bits, second, size = np.full(n, None, dtype=object), np.full(n, np.inf), np.full(n, np.inf), np.zeros(n, np.int64)
            texts = part.column("text").to_pylist()
            if carry:
                lang = np.array(part.column("_li_lang").to_pylist(), dtype=object)
                bits, second = (part.column(c).to_numpy(zero_copy_only=False).copy() for c in ("_li_bits", "_li_second"))
                has = np.array(part.column("_li_has").to_pylist(), dtype=bool)
            else:
                has = np.array([bool(t) and charlm.has_letter(t) for t in texts], dtype=bool)
            joint = joint or charlm.Joint([charlm.Model(m) for m in models.value.values()])
            sums = np.zeros((n, len(langs)))
            for keys, owner in charlm.grams([t if h else "" for t, h in zip(texts, has, strict=True)], False):
                at = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                sums[owner[at]] += np.add.reduceat(joint.logs(keys), at, axis=0, dtype=np.float64)
                size[owner[at]] += np.diff(np.append(at, len(owner)))
            own = -sums / np.maximum(size, 1)[:, None]
            for k, name in enumerate(langs):
                better = has & (own[:, k] < bits)
                second = np.where(better, bits, np.where(has, np.minimum(second, own[:, k]), second))
                bits = np.where(better, own[:, k], bits)
                lang[better] = name
            cols = [part.column(j) for j in range(part.num_columns - (len(_FOUND) if carry else 0))]
            names = part.schema.names[: len(cols)]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(lang.tolist(), pa.string()), pa.array(bits), pa.array(second), pa.array(size), pa.array(has)], names=[*names, *_FOUND.names]
            )

    return run


def _found(docs: DataFrame, table: DataFrame) -> DataFrame | None:
    """docs with the columns of _FOUND; None if there is no model."""
    out, spark, fields = None, docs.sparkSession, T.StructType([*docs.schema.fields, *_FOUND])
    for part in charlm.passes(table):
        names = list(part)
        for i in range(0, len(names), PASS_MODELS):
            blobs = spark.sparkContext.broadcast({k: part[k] for k in names[i : i + PASS_MODELS]})
            out = (docs if out is None else out).mapInArrow(_scores(blobs, out is not None), fields)
    return out


def _lead() -> Column:
    """How much likelier the text is under the best model than under the second, in nats."""
    return (F.col("_li_second") - F.col("_li_bits")) * F.col("_li_size") * float(np.log(2))


def _platt(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Offset and slope of a logistic curve through (x, right, all), by Newton's method with one right and one wrong
    case of prior weight in the middle."""
    if not bins:
        return 0.0, 1.0
    x, right, n = (np.array(c, dtype=np.float64) for c in zip(*bins, strict=True))
    x, right, n = np.append(x, [x.mean()] * 2), np.append(right, [1.0, 0.0]), np.append(n, [1.0, 1.0])
    w = np.array([0.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(w[0] + w[1] * x, -30, 30)))
        d = n * p * (1 - p) + 1e-9
        grad = np.array([(right - n * p).sum(), ((right - n * p) * x).sum() - 1e-3 * (w[1] - 1)])
        hess = np.array([[d.sum(), (d * x).sum()], [(d * x).sum(), (d * x * x).sum() + 1e-3]])
        w = w + np.clip(np.linalg.solve(hess, grad), -2, 2)
    return float(w[0]), float(max(0.0, w[1]))


def train_languages(docs: DataFrame) -> LanguageModels:
    """Models of the languages in docs (lang, text); rows without either add nothing. Tables are saved in the shared folder.

    The models are learned from all rows. Models of half of them (by a hash of the text, so copies are in one half)
    are measured on the other half, which gives the calibration: how often the best model is right by its lead, and
    the usual cross-entropy and its spread by language, for rejection.
    """
    small_batches(docs.sparkSession)
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", F.pmod(F.xxhash64("text"), F.lit(2)).cast("string").alias("half"), "text")
    counts = save(charlm.count(rows.select(F.concat("half", "lang").alias("lang"), "text"), False), "counts")
    plain = counts.withColumn("lang", F.expr("substr(lang, 2)"))
    table = save(charlm.fit(plain.groupBy("lang", "gram").agg(F.sum("c").alias("c"))), "languages")
    half = save(charlm.fit(plain.where(counts.lang.startswith("0"))), "half_languages")
    measured = _found(rows.where("half = '1'").select("lang", "text"), half)
    if measured is None:
        return LanguageModels(table)
    measured = save(measured.where("_li_has").select("lang", "_li_lang", "_li_bits", "_li_second", "_li_size"), "calibration")
    lead = F.log1p(F.greatest(_lead(), F.lit(0.0)))
    bins = measured.where("_li_second < double('inf')").groupBy(F.floor(lead * 8).alias("k")).agg(F.avg(lead).alias("x"), F.count_if(F.col("lang") == F.col("_li_lang")).alias("right"), F.count(F.lit(1)).alias("n")).orderBy("k")
    offset, slope = _platt([(r.x, r.right, r.n) for r in bins.collect()])
    sound = measured.where("lang = _li_lang")
    middle = histogram_median(sound, "lang", F.col("_li_bits"), "middle")
    off = sound.join(F.broadcast(middle), "lang").select("lang", (F.abs(F.col("_li_bits") - F.col("middle")) * F.sqrt("_li_size")).alias("off"))
    spread = histogram_median(off, "lang", F.col("off"), "spread")
    usual = middle.join(spread, "lang").orderBy("lang").collect()
    return LanguageModels(table, offset, slope, tuple((r.lang, r.middle, 1.4826 * r.spread) for r in usual))


def identify(docs: DataFrame, models: LanguageModels, prefix: str = "") -> DataFrame:
    """docs with lang_pred, score, bits (cross-entropy a symbol under the best model), symbols and accepted, named with `prefix`.

    The lowest length-normalised cross-entropy wins; equal ones go to the first language by name. `score` is the
    calibrated chance that the best model is right, from its lead over the second (1 if there is but one). A null text and one
    without letters is `und`, with score 0; so is every text if there is no model. `accepted` is false for `und` and
    for a cross-entropy beyond what texts of its language and length have. Texts are read whole, long ones in steps.
    Columns of docs stay, but for former ones of these names; text must be among them.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    named = [prefix + c for c in ("lang_pred", "score", "bits", "symbols", "accepted")]
    docs = docs.drop(*[c for c in named if c != "text"], *_FOUND.names)
    kept, out = docs.columns, _found(docs, models.table)
    if out is None:
        return docs.withColumns(dict(zip(named, (F.lit(UNKNOWN), F.lit(0.0), F.lit(None).cast("double"), F.lit(0).cast("long"), F.lit(False)), strict=True)))
    got = F.col("_li_has") & F.col("_li_lang").isNotNull()
    chance = 1 / (1 + F.exp(-(F.lit(models.offset) + F.lit(models.slope) * F.log1p(F.greatest(_lead(), F.lit(0.0))))))
    usual = spark.createDataFrame([*models.usual], "_li_name string, _li_middle double, _li_spread double")  # a row a language
    limit = F.col("_li_middle") + REJECT_BITS + REJECT_SD * F.col("_li_spread") / F.sqrt(F.greatest("_li_size", F.lit(1)))
    return out.join(F.broadcast(usual), F.col("_li_lang") == F.col("_li_name"), "left").select(
        *kept,
        F.when(got, F.col("_li_lang")).otherwise(UNKNOWN).alias(named[0]),
        F.when(got & (F.col("_li_second") == float("inf")), 1.0).when(got, chance).otherwise(0.0).alias(named[1]),
        F.when(got, F.col("_li_bits")).alias(named[2]),
        F.when(got, F.col("_li_size")).otherwise(0).cast("long").alias(named[3]),
        (got & F.coalesce(F.col("_li_bits") <= limit, F.lit(True))).alias(named[4]),
    )


def crc_of_id(c: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those not held out. Null and letterless texts are `und`; long ones are
    read whole; repeated rows come out alike; ties go to the first language by name."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = (F.pmod(crc_of_id(), F.lit(3)) == 1).alias("held_out")
    models = train_languages(docs.where(~held))
    return identify(docs.select("doc_id", "text", held), models).select("doc_id", "held_out", "lang_pred", "score", "accepted")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of docs in a language that the corpus has: models are learned from their lang column, and a text
    is rejected if it is `und` or if its cross-entropy lies beyond what texts of its language and length have."""
    return identify(docs, train_languages(docs), "_ki_").where("_ki_accepted").select(*docs.columns)
