"""Queries over the smaller operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitlake.operators import catalog, metrics, support
from pitlake.plans import standins as S
from pitlake.plans.oracle import sql
from pitlake.plans.q_lake import day, r

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(text: str | None = None, *ctes: str):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = sql(text, *ctes)
        return f

    return add


@_add("SELECT strftime(date, '%Y-%m-%d') AS date, max(close) FILTER (security_id = 1) AS s1, max(close) FILTER (security_id = 2) AS s2 FROM dense WHERE is_month_end GROUP BY date", "dense")
def feature_frame(spark, d):
    return support.pivot_frame(S.dense_panel(spark, d).where("is_month_end"), "close", [1, 2]).withColumn("date", day("date"))


@_add("WITH f AS (SELECT date, count(dollar_volume) / count(*) AS share FROM dense GROUP BY date), y AS (SELECT year(date) AS year, avg(share) AS share FROM f GROUP BY 1) SELECT arg_min(year, (share, year))::INT AS year, round(min(share), 6) AS share FROM y", "dense")
def worst_year(spark, d):
    f = S.dense_panel(spark, d).groupBy("date").agg((F.count("dollar_volume") / F.count(F.lit(1))).alias("share"))
    return support.worst_year(f).select("year", r("share").alias("share"))


@_add("SELECT security_id, session_index::INT AS session_index, last_value(v IGNORE NULLS) OVER (PARTITION BY security_id ORDER BY session_index) AS last_v FROM (SELECT *, CASE WHEN session_index % 3 = 0 THEN close END AS v FROM dense)", "dense")
def last_known_price(spark, d):
    p = S.dense_panel(spark, d).withColumn("v", F.when(F.col("session_index") % 3 == 0, F.col("close")))
    return support.last_known(p, "v", "last_v").select("security_id", "session_index", "last_v")


@_add("WITH c AS (SELECT run_id, date, CASE WHEN date BETWEEN DATE '1996-02-03' AND DATE '1999-05-06' AND day(date) > 2 THEN nav END AS nav FROM curves), b AS (SELECT run_id, min(date) FILTER (nav IS NOT NULL) AS a, max(date) FILTER (nav IS NOT NULL) AS z FROM c GROUP BY 1) SELECT c.run_id, count(*) AS n, count(nav) AS known FROM c JOIN b ON c.run_id = b.run_id AND date BETWEEN a AND z GROUP BY c.run_id", "curves")
def trimmed_curves(spark, d):
    c = S.curves(spark, d).withColumn("nav", F.when(F.col("date").between("1996-02-03", "1999-05-06") & (F.dayofmonth("date") > 2), F.col("nav")))
    return support.trimmed(c, "nav").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.count("nav").alias("known"))


@_add("SELECT run_id, count(*) AS n FROM curves WHERE date >= DATE '1997-03-01' AND date <= DATE '1998-02-28' GROUP BY run_id", "curves")
def sliced_curves(spark, d):
    return support.slice_curve(S.curves(spark, d), "1997-03-01", "1998-02-28").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


@_add("""WITH m AS (SELECT run_id, max(date) AS date, arg_max(nav, date) AS nav FROM curves GROUP BY run_id, last_day(date)), a AS (SELECT run_id, min(date) AS date, arg_min(nav, date) AS nav FROM curves GROUP BY run_id), b AS (SELECT * FROM m UNION SELECT * FROM a)
  SELECT run_id, strftime(date, '%Y-%m-%d') AS date, round(nav / first_value(nav) OVER (PARTITION BY run_id ORDER BY date), 6) AS value FROM b""", "curves")
def curve_block(spark, d):
    return support.curve_block(S.curves(spark, d)).withColumn("date", day("date"))


@_add("SELECT strftime(date, '%Y-%m-%d') AS date, row_number() OVER (PARTITION BY date_trunc('month', date) ORDER BY date)::INT AS from_start, row_number() OVER (PARTITION BY date_trunc('month', date) ORDER BY date DESC)::INT AS from_end FROM cal", "cal")
def month_positions(spark, d):
    return S.calendar(spark, d).withColumns(support.month_positions()).select(day("date").alias("date"), "from_start", "from_end")


_IND = "ind AS (SELECT vec_id, label AS generation, vec_id % 3 AS study, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS genes, CAST(embedding[1] AS DOUBLE) AS fitness FROM embeddings)"


def _individuals(spark, d):
    return S.table(spark, d, "embeddings").select("vec_id", F.col("label").alias("generation"), (F.col("vec_id") % 3).alias("study"), F.transform("embedding", lambda x: x.cast("double")).alias("genes"), F.col("embedding")[0].cast("double").alias("fitness"))


@_add(f"WITH {_IND}, g AS (SELECT generation, generate_subscripts(genes, 1) AS k, unnest(genes) AS x FROM ind), v AS (SELECT generation, avg(s) / 2 AS diversity FROM (SELECT generation, k, stddev_pop(x) AS s FROM g GROUP BY ALL) GROUP BY generation) SELECT i.generation, count(*) AS size, round(max(fitness), 6) AS best, round(avg(fitness), 6) AS mean, round(quantile_cont(fitness, 0.5), 6) AS median, round(any_value(diversity), 6) AS diversity FROM ind i JOIN v USING (generation) GROUP BY i.generation")
def generation_stats(spark, d):
    g = support.generation_stats(_individuals(spark, d))
    return g.select("generation", "size", *[r(c).alias(c) for c in ("best", "mean", "median", "diversity")])


@_add(f"WITH {_IND} SELECT study, vec_id FROM ind i WHERE generation = (SELECT max(generation) FROM ind j WHERE j.study = i.study)")
def last_generation(spark, d):
    return support.last_generation(_individuals(spark, d)).select("study", "vec_id")


@_add("""WITH f AS (SELECT * FROM (VALUES (0, DATE '1995-06-01', DATE '1996-12-31'), (1, DATE '1998-01-01', DATE '1998-01-20'), (2, DATE '1999-01-01', DATE '2000-06-30')) t(fold, s, e)), x AS (SELECT run_id, fold, nav / lag(nav) OVER (PARTITION BY run_id, fold ORDER BY date) - 1 AS ret FROM curves JOIN f ON date BETWEEN s AND e)
  SELECT run_id, fold, count(*) AS n, round(avg(ret) / stddev_samp(ret), 6) AS sharpe FROM x GROUP BY ALL HAVING count(*) >= 40""", "curves")
def fold_metrics(spark, d):
    folds = spark.createDataFrame([(0, "1995-06-01", "1996-12-31"), (1, "1998-01-01", "1998-01-20"), (2, "1999-01-01", "2000-06-30")], "fold int, s string, e string")
    return support.fold_metric(S.curves(spark, d), folds.select("fold", F.col("s").cast("date").alias("s"), F.col("e").cast("date").alias("e"))).withColumn("sharpe", r("sharpe"))


@_add("SELECT study, CASE WHEN count(*) < 24 THEN '-inf' ELSE CAST(round(avg(sharpe) - 0.5 * stddev_samp(sharpe), 3) AS VARCHAR) END AS fitness FROM (SELECT study, round(sharpe, 1) AS sharpe FROM runs WHERE study < 5 OR run_id % 50 = 0) GROUP BY study HAVING count(*) < 24", "runs")
def fitness_rejects(spark, d):
    """Too few periods give minus infinity."""
    x = S.runs(spark, d).where("study < 5 OR run_id % 50 = 0").groupBy("study").agg(F.count(F.lit(1)).alias("n"), F.avg("sharpe").alias("s"), F.stddev_samp("sharpe").alias("t"))
    f = x.withColumn("f", support.fitness(F.col("s"), F.col("t"), F.col("n"), 0.5)).where("f = double('-Infinity')")
    return f.select("study", F.lit("-inf").alias("fitness"))


@_add("""WITH g AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN abs(CAST(x AS DOUBLE)) >= 0.05 THEN CAST(x AS DOUBLE) ELSE 0 END) AS g FROM embeddings), u AS (SELECT vec_id, unnest(g) AS x, generate_subscripts(g, 1) AS i FROM g), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(x) DESC, i) AS n FROM u)
  SELECT vec_id, count(*) FILTER (n <= 8 AND x <> 0) AS live, round(sum(x) FILTER (n <= 8), 6) AS total FROM k GROUP BY vec_id""")
def effective_genes(spark, d):
    g = S.table(spark, d, "embeddings").select("vec_id", support.effective_genes(F.transform("embedding", lambda x: x.cast("double")), 0.05, 8).alias("g"))
    return g.select("vec_id", F.size(F.filter("g", lambda x: x != 0)).cast("long").alias("live"), r(F.aggregate("g", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@_add("SELECT DISTINCT trim(regexp_replace(p_name, '\\[\\w+\\]', '', 'g')) AS cell FROM part WHERE trim(p_name) <> ''")
def clean_cells(spark, d):
    p = S.table(spark, d, "part").select(F.concat("p_name", F.lit("[a]")).alias("c")).unionByName(spark.createDataFrame([("—",), ("N/A",), ("",)], "c string"))
    return p.select(support.clean_cell(F.col("c")).alias("cell")).where("cell IS NOT NULL").distinct()


@_add("WITH a AS (SELECT date, close AS x FROM bench WHERE day(date) % 2 = 0), b AS (SELECT date, close AS y FROM bench WHERE day(date) % 3 = 0) SELECT strftime(date, '%Y-%m-%d') AS date, round(x, 6) AS x, round(y, 6) AS y FROM a FULL JOIN b USING (date)", "bench")
def merged_factors(spark, d):
    b = S.benchmark(spark, d)
    m = support.merge_factors(b.where("day(date) % 2 = 0").select("date", F.col("close").alias("x")), b.where("day(date) % 3 = 0").select("date", F.col("close").alias("y")))
    return m.select(day("date").alias("date"), r("x").alias("x"), r("y").alias("y"))


@_add("SELECT strftime(date, '%Y-%m-%d') AS date, security_id, volume AS weight FROM dense WHERE date = (SELECT max(date) FROM dense) ORDER BY weight DESC, security_id LIMIT 3", "dense")
def holdings_snapshot(spark, d):
    w = S.dense_panel(spark, d).select("date", "security_id", F.col("volume").alias("weight"))
    return support.holdings_snapshot(w, 3).withColumn("date", day("date"))


@_add("SELECT run_id, study AS research_study, sharpe AS research_sharpe FROM runs", "runs")
def flattened_legs(spark, d):
    x = S.runs(spark, d).select("run_id", F.struct("study", "sharpe").alias("research"))
    return support.flatten_legs(x, "research")


@_add("SELECT DISTINCT study FROM runs WHERE study NOT IN (SELECT study FROM runs WHERE fingerprint = 'click' AND sharpe > 90)", "runs")
def studies_without_record(spark, d):
    x = S.runs(spark, d)
    return x.select("study").distinct().join(x.where("fingerprint = 'click' AND sharpe > 90").select("study"), "study", "left_anti")


@_add("SELECT study, max(sharpe) AS best FROM runs GROUP BY study ORDER BY best DESC, study LIMIT 3", "runs")
def best_searches(spark, d):
    return S.runs(spark, d).groupBy("study").agg(F.max("sharpe").alias("best")).orderBy(F.desc("best"), "study").limit(3)


@_add("SELECT 79::BIGINT AS features, 11::BIGINT AS families")
def feature_catalogue(spark, d):
    return catalog.describe(spark).agg(F.count(F.lit(1)).alias("features"), F.countDistinct("family").alias("families"))


@_add("WITH m AS (SELECT last_day(date) AS month, arg_max(close, date) AS nav FROM bench WHERE date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' GROUP BY 1), r AS (SELECT nav / lag(nav) OVER (ORDER BY month) - 1 AS ret FROM m) SELECT count(ret) AS n, round(avg(ret) / stddev_samp(ret), 6) AS sharpe FROM r", "bench")
def benchmark_window(spark, d):
    b = S.benchmark(spark, d).where("date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'").select(F.lit(0).alias("run_id"), "date", F.col("close").alias("nav"))
    return metrics.monthly_stats(b).select("n", r("sharpe").alias("sharpe"))
