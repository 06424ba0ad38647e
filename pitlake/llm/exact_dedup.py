"""Exact duplicates by content sort, with DataFrame operators only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lower_ascii, parts_for, text_bytes, text_of

#: Parts into which the copies of one text are dealt before they are merged.
SALTS = 64


def exact_classes(docs: DataFrame, keep: str = "smallest", salts: int = SALTS) -> DataFrame:
    """Classes of texts that are equal after lower-casing A-Z: (norm_sha256, keep_id, group_size), a row per text.

    Sampled splitters (the text's beginning and a hash) range-partition the normalised texts, each range is sorted
    externally, and each row's whole text is compared with its neighbour's. Copies of one text are dealt over `salts` sub-ranges, which
    sort next to each other, so no group lies in one task; the at most `salts` heads of a text are then compared
    whole once more. `keep` says which doc_id stays: "smallest" or "largest".

    A null text counts as empty. Null doc_ids never stay if the group has another. Repeated rows each count.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    rows = docs.select("doc_id", lower_ascii(text_of()).alias("norm"))
    # splitters are of bounded size: the text's beginning, and a hash where many texts begin alike
    place = {"begin": F.substring("norm", 1, 24), "h": F.xxhash64("norm"), "salt": F.pmod(F.xxhash64("doc_id"), F.lit(salts))}
    n = parts_for(text_bytes(docs))
    ranged = rows.withColumns(place).repartitionByRange(n, *place)
    near = Window.partitionBy(*place, "norm")
    heads = (
        ranged.withColumn("head", F.row_number().over(near.orderBy("doc_id")))
        .withColumns({"best": best("doc_id").over(near), "n": F.count(F.lit(1)).over(near)})
        .where("head = 1")
        .select("norm", "best", "n")
    )
    whole = Window.partitionBy("norm")
    return (
        heads.withColumn("first", F.row_number().over(whole.orderBy("best")))
        .withColumns({"keep_id": best("best").over(whole), "group_size": F.sum("n").over(whole)})
        .where("first = 1")
        .select(F.sha2("norm", 256).alias("norm_sha256"), "keep_id", "group_size")
    )


def exact_dedup(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """A row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Of rows that repeat both doc_id and text, all are marked alike.
    """
    rows = docs.select("doc_id", F.sha2(lower_ascii(text_of()), 256).alias("text_sha256"))
    classes = exact_classes(docs, keep)
    return (
        rows.join(classes, rows.text_sha256 == classes.norm_sha256)
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    )


def drop_exact_copies(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The rows of docs whose text no row with a better doc_id has; every column of docs; rows that repeat the kept doc_id and text stay."""
    sha = F.sha2(lower_ascii(text_of()), 256)
    best = exact_classes(docs, keep).select(F.col("norm_sha256").alias("_xd_sha"), F.col("keep_id").alias("_xd_keep"))
    kept = docs.join(best, (sha == best._xd_sha) & docs.doc_id.eqNullSafe(best._xd_keep), "left_semi")
    return kept


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
      FROM documents)
WINDOW w AS (PARTITION BY norm)
"""


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="largest")
