"""Queries over parsers, streams, learned scores and the genetic search."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from pitlake.functions.exprs import rank_pct
from pitlake.operators import evolve, learned
from pitlake.plans import standins as S
from pitlake.plans.oracle import sql
from pitlake.plans.q_lake import day, r
from pitlake.sources import parse
from pitlake.streaming import ingest

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(text: str | None = None, *ctes: str):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = sql(text, *ctes)
        return f

    return add


@_add("SELECT security_id AS cik, tag, strftime(period_end, '%Y-%m-%d') AS period_end, value, strftime(filed_date, '%Y-%m-%d') AS filed_date, CAST(accession AS VARCHAR) AS accession FROM facts WHERE accession % 10 <> 3", "facts")
def source_nested_facts(spark, d):
    """Payloads put together from the facts, and flattened again; observations without a filing date are left out."""
    f = S.facts(spark, d)
    obs = F.struct(day("period_end").alias("end"), F.col("value").alias("val"), F.when(F.col("accession") % 10 != 3, day("filed_date")).alias("filed"), F.col("accession").cast("string").alias("accn"))
    tags = f.groupBy("security_id", "tag").agg(F.collect_list(obs).alias("o"))
    units = F.struct(F.create_map(F.lit("USD"), F.col("o")).alias("units"))
    body = tags.groupBy("security_id").agg(F.map_from_entries(F.collect_list(F.struct("tag", units))).alias("t"))
    payload = body.select(F.col("security_id").alias("cik"), F.to_json(F.struct(F.format_string("entity %d", "security_id").alias("entityName"), F.create_map(F.lit("gaap"), F.col("t")).alias("facts"))).alias("json"))
    return parse.flatten_facts(payload).select("cik", "tag", "period_end", "value", "filed_date", "accession")


@_add("SELECT event_type AS series_id, strftime(ts, '%Y-%m-%d') AS date, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events WHERE event_id % 11 <> 0 AND event_type = 'click'")
def source_series_csv(spark, d):
    e = S.table(spark, d, "events").where("event_type = 'click'")
    date = F.when(F.col("event_id") % 11 == 0, F.lit("no date")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    lines = e.select(F.concat_ws(",", date, F.when(F.col("event_id") % 7 == 0, F.lit(".")).otherwise(F.col("value").cast("string"))).alias("value"))
    return parse.series_csv(lines, "click").select("series_id", day("date").alias("date"), "value")


@_add("SELECT n_nationkey AS cik, n_name AS name, n_regionkey AS region FROM nation")
def source_columnar_json(spark, d):
    n = S.table(spark, d, "nation")
    rows = n.agg(F.collect_list(F.array(F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string"))).alias("data"))
    payload = rows.select(F.to_json(F.struct(F.array(F.lit("cik"), F.lit("name"), F.lit("region")).alias("fields"), "data")).alias("json"))
    return parse.columnar_json(payload, {"cik": "int", "name": "string", "region": "int"})


@_add("SELECT CAST(security_id AS VARCHAR) AS ticker, strftime(date, '%Y-%m-%d') AS date, open, close FROM bars WHERE security_id IN (1, 2, 3)", "bars")
def source_wide_bars(spark, d):
    b = S.bars(spark, d).where("security_id IN (1, 2, 3)")
    wide = b.groupBy("date").pivot("security_id", [1, 2, 3]).agg(F.first("open").alias("Open"), F.first("close").alias("Close"))
    wide = wide.select("date", *[F.col(f"{i}_{c}").alias(f"{c}|{i}") for i in (1, 2, 3) for c in ("Open", "Close")])
    return parse.wide_to_long(wide).select("ticker", day("date").alias("date"), "open", "close")


@_add("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def source_json_props(spark, d):
    return S.table(spark, d, "events").select(F.from_json("props", "k long").getField("k").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@_add("SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windowed_counts(spark, d):
    """The events as a stream, read up to its end: counts by window and type, each event once."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "false").parquet(d)
    name = f"counts_{uuid.uuid4().hex}"
    query = ingest.windowed_counts(events, "1 day", "60 days").writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n", r("total", 4).alias("total"))


_XS = """x AS (SELECT security_id, date, session_index, in_index, close / avg(close) OVER w - 1 AS f1, volume / avg(volume) OVER w - 1 AS f2,
  max(open) OVER (PARTITION BY security_id ORDER BY session_index RANGE BETWEEN 22 FOLLOWING AND 22 FOLLOWING) / max(open) OVER (PARTITION BY security_id ORDER BY session_index RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) - 1 AS fwd
  FROM dense WINDOW w AS (PARTITION BY security_id ORDER BY session_index RANGE BETWEEN 19 PRECEDING AND CURRENT ROW))"""


def _xs(spark, d):
    p = learned.forward_return(S.dense_panel(spark, d), 21)
    w = Window.partitionBy("security_id").orderBy("session_index").rangeBetween(-19, 0)
    return p.select("security_id", "date", "session_index", "in_index", "is_month_end", (F.col("close") / F.avg("close").over(w) - 1).alias("f1"), (F.col("volume") / F.avg("volume").over(w) - 1).alias("f2"), "fwd")


@_add(f"WITH {_XS} SELECT session_index::INT AS session_index, count(*) AS n, round(sum(f1 * f2), 4) AS xx_1_2, round(sum(f1 * fwd), 4) AS xy_1 FROM x WHERE f1 IS NOT NULL AND f2 IS NOT NULL AND fwd IS NOT NULL GROUP BY session_index", "dense")
def ridge_moments(spark, d):
    return learned.moments(_xs(spark, d), ["f1", "f2"], "fwd").select("session_index", "n", r("xx_1_2", 4).alias("xx_1_2"), r("xy_1", 4).alias("xy_1"))


@_add(f"""WITH {_XS}, m AS (SELECT c.session_index AS t, regr_count(fwd, f1) AS n, regr_slope(fwd, f1) AS slope, regr_intercept(fwd, f1) AS icept FROM cal c JOIN x ON x.session_index <= c.session_index - 22 AND x.session_index > c.session_index - 22 - 250
  WHERE c.is_year_end GROUP BY c.session_index) SELECT t::INT AS session_index, round(icept, 4) AS intercept, round(slope, 4) AS slope FROM m WHERE n >= 50""", "dense", "cal")
def rolling_ridge(spark, d):
    """Without a penalty the ridge is least squares."""
    at = S.calendar(spark, d).where("is_year_end").select("session_index")
    fits = learned.rolling_ridge(_xs(spark, d), ["f1"], "fwd", at, 250, 22, 0.0)
    return fits.select("session_index", r(F.col("coef")[0], 4).alias("intercept"), r(F.col("coef")[1], 4).alias("slope"))


@_add()
def ridge_strategy(spark, d):
    x = _xs(spark, d)
    at = S.calendar(spark, d).where("is_month_end").select("session_index")
    fits = learned.rolling_ridge(x, ["f1", "f2"], "fwd", at, 250, 22, 1.0)
    return learned.ridge_scores(x, ["f1", "f2"], fits).select("security_id", day("date").alias("date"), r("score", 4).alias("score"))


@_add()
def mlp_strategy(spark, d):
    x = learned.standardised(_xs(spark, d).where("is_month_end"), ["f1", "f2"])
    return learned.mlp_scores(x.select("date", "security_id", "f1", "f2", "fwd"), ["f1", "f2"], "fwd", seeds=2, epochs=5).select(day("date").alias("date"), "security_id", r("score", 4).alias("score"))


def _ranked(spark, d):
    x = _xs(spark, d).where("is_month_end AND in_index AND fwd IS NOT NULL")
    return x.select("date", "security_id", "fwd", rank_pct(F.col("f1"), ["date"]).alias("f1"), rank_pct(F.col("f2"), ["date"]).alias("f2"))


_RK = "CASE WHEN count({c}) OVER (PARTITION BY date) >= 3 THEN (rank() OVER (PARTITION BY date ORDER BY {c}) - 1 + (count(*) OVER (PARTITION BY date, {c}) - 1) / 2) / (count({c}) OVER (PARTITION BY date) - 1) END"


@_add(f"""WITH {_XS}, k AS (SELECT date, security_id, fwd, {_RK.format(c='f1')} AS r1, {_RK.format(c='f2')} AS r2 FROM x JOIN cal USING (date) WHERE is_month_end AND in_index AND fwd IS NOT NULL),
  s AS (SELECT g.genome, k.*, (r1 * g.a + r2 * g.b) / (abs(g.a) + abs(g.b)) AS score FROM k CROSS JOIN (VALUES (0, 1.0, 0.0), (1, -0.5, 0.25), (2, 0.3, 0.9)) g(genome, a, b) WHERE r1 IS NOT NULL AND r2 IS NOT NULL),
  t AS (SELECT *, row_number() OVER (PARTITION BY genome, date ORDER BY score DESC, md5(CAST(security_id AS VARCHAR))) AS n FROM s)
  SELECT genome::BIGINT AS genome, strftime(date, '%Y-%m-%d') AS date, round(avg(fwd), 5) AS ret FROM t WHERE n <= 3 GROUP BY genome, date""", "dense", "cal")
def genome_evaluation(spark, d):
    g = evolve.genomes_frame(spark, [np.array([1.0, 0.0]), np.array([-0.5, 0.25]), np.array([0.3, 0.9])])
    return evolve.evaluate(g, _ranked(spark, d), ["f1", "f2"], 3).select("genome", day("date").alias("date"), r("ret", 5).alias("ret"))


@_add()
def genetic_search(spark, d):
    """Generations of a small seeded search."""
    ranked = _ranked(spark, d).cache()
    folds = evolve.contiguous_folds("1995-06-01", "2001-06-01", 3)
    _, history = evolve.evolve(ranked, evolve.box(["f1", "f2"]), folds, generations=2, top=3, how=evolve.Search(size=6, fresh=1))
    ranked.unpersist()
    return spark.createDataFrame([(h["generation"], float(h["best"]), h["distinct"]) for h in history], "generation int, best double, distinct int")


@_add()
def genome_population(spark, d):
    """The fitness of 256 genomes in one plan."""
    rng = np.random.default_rng(11)
    g = evolve.genomes_frame(spark, [rng.uniform(-1, 1, 2) for _ in range(256)])
    found = evolve.objective(evolve.evaluate(g, _ranked(spark, d), ["f1", "f2"], 3), evolve.contiguous_folds("1995-06-01", "2001-06-01", 3))
    return found.select("genome", r("fitness", 5).alias("fitness"), "folds")
