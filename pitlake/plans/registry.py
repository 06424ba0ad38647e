"""The named queries of the library and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlake.operators import pit
from pitlake.plans import q_forward, q_fundamental, q_lake, q_more, q_price, q_research, q_sources, q_support, q_timing
from pitlake.plans import standins as S

MODULES = (q_lake, q_price, q_fundamental, q_research, q_timing, q_sources, q_more, q_support, q_forward)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was known of each tag on a date, over the securities that were members on it."""
    known = pit.latest_visible(S.facts(spark, sf_dir), "1998-06-15")
    members = pit.universe_asof(S.intervals(spark, sf_dir), "1998-06-15").select("security_id")
    return known.join(members, "security_id", "left_semi").groupBy("tag").agg(F.count(F.lit(1)).alias("facts"), F.countDistinct("security_id").alias("securities"), F.round(F.sum("value"), 2).alias("total"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in m.SQL.items()}
