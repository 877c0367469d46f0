"""The recording operators as queries on the test tables, each beside the SQL that must give the same rows.

A recording is a user, an order or a part; a frame is an event or a line; a measurement is a value or a quantity.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars
from .operators import evaluation, joins, selection, statistics, tracks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if name == "events" else df


# ---------------------------------------------------------------- which rows of a group


@query("""
SELECT l_partkey, l_orderkey, l_linenumber, l_quantity FROM (
  SELECT *, MAX(l_quantity) OVER (PARTITION BY l_partkey) AS m FROM lineitem WHERE l_discount > 0.02) WHERE l_quantity = m""")
def argmax_ties(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return selection.argmax_ties(rows, ["l_partkey"], "l_quantity", F.col("l_discount") > 0.02).drop("l_discount")


@query("""
SELECT user_id, event_id, value FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events) WHERE n = 1""")
def argmax_single(spark, sf):
    return selection.argmax_single(table(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], "value", ["event_id"])


@query("""
SELECT user_id, event_id, value FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events WHERE event_type = 'click') WHERE n = 1""")
def first_matching(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", "value", "event_type")
    return selection.argmax_single(rows, ["user_id"], "value", ["event_id"], F.col("event_type") == "click").drop("event_type")


@query("""
SELECT l_orderkey, MAX(l_quantity) AS widest FROM lineitem WHERE l_quantity < 40 GROUP BY l_orderkey""")
def widest_below_bound(spark, sf):
    return table(spark, sf, "lineitem").where("l_quantity < 40").groupBy("l_orderkey").agg(F.max("l_quantity").alias("widest"))


@query("""
SELECT l_orderkey, label, mincol, maxcol FROM (
  SELECT l_orderkey, l_linenumber AS label, l_discount AS mincol, l_discount + l_quantity AS maxcol,
         ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY maxcol - mincol DESC, l_linenumber, mincol DESC) AS n FROM lineitem WHERE maxcol - mincol < 40) WHERE n = 1""")
def widest_region_below_bound(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("label"), F.col("l_discount").alias("mincol"), (F.col("l_discount") + F.col("l_quantity")).alias("maxcol"))
    return selection.widest_region(rows, 40, ("l_orderkey",))


@query("SELECT l.l_orderkey, l.l_linenumber, l.l_quantity FROM lineitem l JOIN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING COUNT(*) > 4) b USING (l_orderkey)")
def group_min_rows(spark, sf):
    return selection.at_least(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey"], 4)


@query("""
SELECT e.event_id, e.value FROM events e, (SELECT AVG(value) AS m, STDDEV_POP(value) AS s FROM events WHERE value IS NOT NULL) WHERE ABS(e.value - m) < 1.5 * s""")
def clip_sigma(spark, sf):
    return selection.clip_sigma(table(spark, sf, "events").select("event_id", "value"), "value", sigmas=1.5)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 44")
def first_rows(spark, sf):
    return selection.first_rows(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 44)


@query("""
SELECT user_id, event_id, value, nth::INTEGER AS nth FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS nth FROM events) WHERE nth <= 2""")
def top_two(spark, sf):
    return selection.top_k(table(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], [F.col("value").desc(), "event_id"], 2)


@query("""
SELECT user_id, event_id FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY md5('7|' || event_id::VARCHAR), event_id) AS n FROM events) WHERE n <= 20""")
def sample_per_group(spark, sf):
    return selection.sample(table(spark, sf, "events").select("user_id", "event_id"), ["user_id"], "event_id", 20, seed=7)


@query("""
SELECT e.user_id, e.event_id, e.k FROM (SELECT user_id, event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, COUNT(*) OVER (PARTITION BY user_id) AS n FROM events) e
WHERE e.k < 16 * CEIL(GREATEST(e.n - 16, 0) / 16.0)""")
def whole_batches(spark, sf):
    from pyspark.sql import Window

    rows = table(spark, sf, "events").select("user_id", "event_id").withColumn("k", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long"))
    return selection.whole_batches(rows, ["user_id"], "k", 16)


@query("""
SELECT event_id, value <= 100 AS at_most, value > 50 AS above, value BETWEEN 60 AND 70 AS between_, event_type <> 'error' AND event_type <> 'purchase' AS kept_kind
FROM events WHERE value > 0 AND (value <= 100 OR value > 150 OR value BETWEEN 120 AND 130) AND NOT (value > 190 AND event_type = 'error')""")
def bounded_values(spark, sf):
    """Fixed bounds, ranges with both ends, and conditions together; a null value is in none."""
    v, kind = F.col("value"), F.col("event_type")
    rows = table(spark, sf, "events").where(v > 0).where((v <= 100) | (v > 150) | v.between(120, 130)).where(~((v > 190) & (kind == "error")))
    return rows.select("event_id", (v <= 100).alias("at_most"), (v > 50).alias("above"), v.between(60, 70).alias("between_"), ((kind != "error") & (kind != "purchase")).alias("kept_kind"))


@query("""
WITH RECURSIVE span AS (SELECT MIN(value) AS lo, MAX(value) AS hi FROM events),
counts AS (SELECT LEAST(FLOOR((value - lo) / ((hi - lo) / 256)), 255)::INT AS b, COUNT(*) AS n FROM events, span WHERE value IS NOT NULL GROUP BY 1),
bins AS (SELECT k::INT AS b, COALESCE(n, 0) AS n, lo + (k + 0.5::DOUBLE) * (hi - lo) / 256 AS m FROM range(256) t(k) LEFT JOIN counts ON b = k, span),
sums AS (
  SELECT b, m, LEAD(m) OVER o AS next, SUM(n) OVER o AS low, SUM(n) OVER () - SUM(n) OVER o AS high, SUM(n * m) OVER o AS lows, SUM(n * m) OVER () - SUM(n * m) OVER o AS highs FROM bins WINDOW o AS (ORDER BY b)),
cut AS (SELECT MIN(m) FILTER (low > 0 AND high > 0 AND m <= (lows / low + highs / high) / 2 AND (lows / low + highs / high) / 2 < next) AS t FROM sums)
SELECT event_id, value FROM events, cut WHERE value >= t""")
def above_isodata(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "value")
    return rows.where(F.col("value") >= selection.isodata_threshold(rows, "value"))


@query(r"""
SELECT o_orderkey, path FROM (
  SELECT o_orderkey, 'moth' || (o_custkey % 7) || CASE o_orderkey % 5 WHEN 0 THEN '_delta' WHEN 1 THEN '_Delta' WHEN 2 THEN '_unsuitable' WHEN 3 THEN '_dead' ELSE '' END || '.cine' AS path FROM orders)
WHERE NOT contains(path, 'delta') AND NOT contains(path, 'Delta') AND NOT contains(path, 'unsuitable')""")
def usable_recordings(spark, sf):
    from .plans import feeding

    k = F.col("o_orderkey") % 5
    mark = F.when(k == 0, "_delta").when(k == 1, "_Delta").when(k == 2, "_unsuitable").when(k == 3, "_dead").otherwise("")
    rows = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("moth"), (F.col("o_custkey") % 7).cast("string"), mark, F.lit(".cine")).alias("filename"))
    return feeding.usable(rows).withColumnRenamed("filename", "path")


# ---------------------------------------------------------------- ordered by frame


@query("SELECT o_orderkey, o_totalprice, (ROW_NUMBER() OVER (ORDER BY o_totalprice, o_orderkey) - 1)::BIGINT AS place FROM orders")
def sorted_rows(spark, sf):
    """Rows with their place in a global order, which no task sorts alone."""
    return tracks.numbered(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [], ["o_totalprice", "o_orderkey"], "place")


@query("SELECT user_id, event_id, value, (ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY value, event_id) - 1)::BIGINT AS place FROM events")
def sorted_in_groups(spark, sf):
    return tracks.numbered(table(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], ["value", "event_id"], "place")


@query("""
SELECT user_id, event_id, (nv - value) / (ne - event_id) AS derivative FROM (
  SELECT *, LEAD(value) OVER w AS nv, LEAD(event_id) OVER w AS ne FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE nv IS NOT NULL""")
def forward_derivative(spark, sf):
    return tracks.forward_derivative(table(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value").drop("value")


@query("""
SELECT user_id, event_id, (value - pv) / (event_id - pe) AS derivative FROM (
  SELECT *, LAG(value) OVER w AS pv, LAG(event_id) OVER w AS pe FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE pv IS NOT NULL""")
def backward_derivative(spark, sf):
    return tracks.backward_derivative(table(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value").drop("value")


@query("SELECT event_id, value - MIN(value) OVER (PARTITION BY user_id) AS above FROM events")
def rebase(spark, sf):
    return tracks.rebase(table(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], "value", "above").select("event_id", "above")


@query("SELECT event_id, (event_id - MIN(event_id) OVER (PARTITION BY user_id)) / 30.0::DOUBLE AS elapsed_time FROM events")
def elapsed(spark, sf):
    return tracks.elapsed(table(spark, sf, "events").select("user_id", "event_id"), ["user_id"], "event_id", F.lit(30)).select("event_id", "elapsed_time")


@query("SELECT n_nationkey, n_name, (DENSE_RANK() OVER (ORDER BY n_name) - 1)::INTEGER AS name_id FROM nation")
def factorize(spark, sf):
    return tracks.factorize(table(spark, sf, "nation").select("n_nationkey", "n_name"), "n_name", "name_id")


@query("SELECT l_orderkey, l_linenumber, l_quantity, RANK() OVER (ORDER BY l_quantity) + (COUNT(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS avg_rank FROM lineitem")
def average_rank(spark, sf):
    return tracks.average_rank(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity")


@query("SELECT event_id, ROUND(VAR_POP(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING), 6) AS variance FROM events")
def rolling_variance(spark, sf):
    out = tracks.rolling_variance(table(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value")
    return out.select("event_id", F.round("variance", 6).alias("variance"))


@query("SELECT event_id, ROUND(REGR_SLOPE(value, event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 6) AS slope FROM events")
def local_slope(spark, sf):
    out = tracks.local_slope(table(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value")
    return out.select("event_id", F.round("slope", 6).alias("slope"))


@query("SELECT user_id, MIN(CAST(ts AS DATE))::VARCHAR AS first_day, MAX(CAST(ts AS DATE))::VARCHAR AS last_day FROM events GROUP BY 1")
def first_day(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.min(F.to_date("ts")).cast("string").alias("first_day"), F.max(F.to_date("ts")).cast("string").alias("last_day"))


@query("SELECT o_orderkey, DATE_DIFF('day', MIN(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey), CAST(o_orderdate AS DATE))::INTEGER AS days FROM orders")
def days_past(spark, sf):
    from pyspark.sql import Window

    day = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", F.datediff(day, F.min(day).over(Window.partitionBy("o_custkey"))).alias("days"))


# Smoothing and forests have no SQL form; they are tested on known curves and planted outliers.


@query()
def loess(spark, sf):
    return tracks.smoothed(table(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value")


@query()
def isolation_forest(spark, sf):
    from .operators import outliers

    rows = table(spark, sf, "lineitem").select("l_suppkey", F.monotonically_increasing_id().alias("row"), "l_quantity", "l_extendedprice", "l_discount")
    return outliers.isolated(rows, ["l_suppkey"], ["l_quantity", "l_extendedprice", "l_discount"], "row", components=2)


@query("""
WITH p AS (
  SELECT a.user_id, a.event_id AS a, b.event_id AS b, SQRT(POW((a.event_id - b.event_id)::DOUBLE, 2) + POW(a.value - b.value, 2)) AS d
  FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id <> b.event_id),
near AS (SELECT * FROM p QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id, a ORDER BY d, b) <= 30),
radius AS (SELECT user_id, a AS b, MAX(d) AS r FROM near GROUP BY 1, 2),
density AS (SELECT user_id, a, 1 / (AVG(GREATEST(d, r)) + 1e-10::DOUBLE) AS density FROM near JOIN radius USING (user_id, b) GROUP BY 1, 2),
factor AS (SELECT n.user_id, n.a AS event_id, AVG(o.density) / ANY_VALUE(d.density) AS f FROM near n JOIN density o ON o.user_id = n.user_id AND o.a = n.b JOIN density d ON d.user_id = n.user_id AND d.a = n.a GROUP BY 1, 2),
scored AS (SELECT user_id, event_id, COALESCE(f, 1.0::DOUBLE) AS f FROM events LEFT JOIN factor USING (user_id, event_id)),
bound AS (SELECT user_id, QUANTILE_CONT(f, 0.9) AS bound FROM scored GROUP BY 1)
SELECT user_id, event_id, ROUND(f, 6) AS anomaly, f <= bound * (1 + 1e-9::DOUBLE) AS inlier FROM scored JOIN bound USING (user_id)""")
def local_outlier_factor(spark, sf):
    from .operators import outliers

    out = outliers.local_outliers(table(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], ["event_id", "value"], "event_id")
    return out.withColumn("anomaly", F.round("anomaly", 6))


@query()
def support_vector(spark, sf):
    return tracks.support_fit(table(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value")


# ---------------------------------------------------------------- statistics


@query("SELECT event_type, MEDIAN(event_id)::DOUBLE AS event_id, MEDIAN(value) AS value FROM events GROUP BY 1")
def median_per_group(spark, sf):
    return statistics.medians(table(spark, sf, "events").select("event_type", "event_id", "value"), ["event_type"])


@query("SELECT user_id, (MAX(value) - MIN(value)) * 0.1::DOUBLE AS intake FROM events GROUP BY 1")
def range_per_group(spark, sf):
    return statistics.ranges(table(spark, sf, "events").select("user_id", "value"), ["user_id"], "value", F.lit(0.1), "intake")


@query("SELECT event_type, COUNT(*) AS n, COUNT(DISTINCT user_id) AS users, AVG(CASE WHEN value < 50 THEN 1.0::DOUBLE ELSE 0 END) AS share FROM events GROUP BY 1")
def proportions(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), statistics.share(F.col("value") < 50).alias("share"))


@query("SELECT SUM((value < 10)::INT)::BIGINT AS below, SUM((value <= 10)::INT)::BIGINT AS at_most, SUM((value < 10 AND user_id < 20)::INT)::BIGINT AS both_below FROM events")
def diagnostics(spark, sf):
    return table(spark, sf, "events").agg(F.count_if(F.col("value") < 10).alias("below"), F.count_if(F.col("value") <= 10).alias("at_most"), F.count_if((F.col("value") < 10) & (F.col("user_id") < 20)).alias("both_below"))


@query("SELECT event_type, ROUND(CORR(event_id, value), 9) AS r FROM events GROUP BY 1")
def correlation(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.corr("event_id", "value"), 9).alias("r"))


@query("""
WITH s AS (SELECT event_type, REGR_COUNT(value, event_id)::BIGINT AS n, REGR_SLOPE(value, event_id) AS a, REGR_INTERCEPT(value, event_id) AS b, CORR(value, event_id) AS r,
  REGR_SXX(value, event_id) AS sxx, REGR_SYY(value, event_id) AS syy, AVG(event_id) AS m FROM events GROUP BY 1)
SELECT event_type, n, ROUND(a, 9) AS slope, ROUND(b, 6) AS intercept, ROUND(r, 9) AS r, ROUND(SQRT((syy - a * a * sxx) / ((n - 2) * sxx)), 9) AS stderr,
  ROUND(SQRT((syy - a * a * sxx) / ((n - 2) * sxx)) * SQRT(sxx / n + m * m), 6) AS intercept_stderr FROM s""")
def regression(spark, sf):
    digits = {"slope": 9, "intercept": 6, "r": 9, "stderr": 9, "intercept_stderr": 6}
    out = statistics.regression(table(spark, sf, "events"), "event_id", "value", ["event_type"])
    return out.select("event_type", "n", *[F.round(c, d).alias(c) for c, d in digits.items()])


@query("SELECT l_orderkey, l_linenumber, ROUND(l_extendedprice - (b + a * l_quantity), 4) AS residual FROM lineitem, (SELECT REGR_SLOPE(l_extendedprice, l_quantity) AS a, REGR_INTERCEPT(l_extendedprice, l_quantity) AS b FROM lineitem)")
def residuals(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("q"), F.col("l_extendedprice").cast("double").alias("p"))
    return statistics.residuals(rows, "q", "p").select("l_orderkey", "l_linenumber", F.round("residual", 4).alias("residual"))


@query("""
WITH t AS (SELECT l_returnflag, l_quantity FROM lineitem WHERE l_returnflag IN ('A', 'R')),
r AS (SELECT *, RANK() OVER (ORDER BY l_quantity) + (COUNT(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS k FROM t),
ties AS (SELECT SUM(c * c * c - c)::BIGINT AS ties FROM (SELECT COUNT(*) AS c FROM t GROUP BY l_quantity))
SELECT l_returnflag, COUNT(*) AS n, SUM(k) - COUNT(*) * (COUNT(*) + 1) / 2.0::DOUBLE AS u, ANY_VALUE(ties) AS ties FROM r, ties GROUP BY 1""")
def rank_sums(spark, sf):
    rows = table(spark, sf, "lineitem").where(F.col("l_returnflag").isin("A", "R")).select("l_returnflag", "l_quantity")
    return statistics.rank_sums(rows, "l_returnflag", "l_quantity")


@query("""
WITH q AS (SELECT event_type, QUANTILE_CONT(value, 0.25) AS q1, QUANTILE_CONT(value, 0.5) AS q2, QUANTILE_CONT(value, 0.75) AS q3 FROM events GROUP BY 1)
SELECT event_type, q1, q2, q3, MIN(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS low, MAX(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS high,
  COUNT(*) FILTER (NOT value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS fliers
FROM events JOIN q USING (event_type) GROUP BY 1, 2, 3, 4""")
def box_stats(spark, sf):
    return statistics.quartiles(table(spark, sf, "events").select("event_type", "value"), ["event_type"], "value")


@query("SELECT event_type, LEAST(FLOOR(value * 20 / 200), 19)::INTEGER AS bin, COUNT(*) AS n FROM events WHERE value BETWEEN 0 AND 200 GROUP BY 1, 2")
def hist_bins(spark, sf):
    return statistics.histogram(table(spark, sf, "events"), "value", 0, 200, 20, ["event_type"])


@query("SELECT user_id, FLOOR(value / 10)::BIGINT AS bin, ROUND(SUM(value), 6) AS weight FROM events GROUP BY 1, 2")
def weighted_histogram(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", F.floor(F.col("value") / 10).alias("bin")).agg(F.round(F.sum("value"), 6).alias("weight"))


@query("""
SELECT l_suppkey, MAX(CASE WHEN k = (n + 1) // 2 + 1 THEN q END)::INTEGER AS median FROM (
  SELECT l_suppkey, l_quantity::INTEGER AS q, ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS k, COUNT(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) GROUP BY 1""")
def hist_median(spark, sf):
    return statistics.biased_median(table(spark, sf, "lineitem").select("l_suppkey", F.col("l_quantity").cast("int").alias("q")), ["l_suppkey"], "q")


@query("SELECT CAST(ts AS DATE)::VARCHAR AS day, event_type, ROUND(AVG(value), 9) AS mean FROM events GROUP BY 1, 2")
def per_day_mean(spark, sf):
    return table(spark, sf, "events").groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.round(F.avg("value"), 9).alias("mean"))


@query("SELECT event_id, (m - value) / (m - l) AS rescaled FROM (SELECT event_id, value, MAX(value) OVER (PARTITION BY user_id) AS m, MIN(value) OVER (PARTITION BY user_id) AS l FROM events)")
def rescaled_radius(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id")
    return table(spark, sf, "events").select("event_id", F.try_divide(F.max("value").over(w) - F.col("value"), F.max("value").over(w) - F.min("value").over(w)).alias("rescaled"))


@query("""
WITH RECURSIVE w AS (
  SELECT event_type, value / 10 / (2 * PI()) AS turn, user_id + 1.0::DOUBLE AS weight FROM events),
sums AS (SELECT event_type, LEAST(FLOOR((turn - FLOOR(turn)) * 36), 35)::INTEGER AS bin, SUM(weight) AS weight FROM w GROUP BY 1, 2),
grid AS (SELECT event_type, list(COALESCE(weight, 0) ORDER BY bin) AS bins FROM (SELECT DISTINCT event_type FROM sums) CROSS JOIN (SELECT k::INTEGER AS bin FROM range(36) t(k)) LEFT JOIN sums USING (event_type, bin) GROUP BY 1),
rounds AS (
  SELECT event_type, bins, 0 AS n FROM grid
  UNION ALL
  SELECT event_type, [(bins[(i + 34) % 36 + 1] + bins[i] + bins[i % 36 + 1]) / 3 FOR i IN range(1, 37)], n + 1 FROM rounds WHERE n < 6)
SELECT event_type, (i - 1)::INTEGER AS bin, ROUND(bins[i], 4) AS weight, bins[i] > bins[(i + 34) % 36 + 1] AND bins[i] > bins[i % 36 + 1] AS peak FROM rounds, range(1, 37) t(i) WHERE n = 6""")
def circular_smoothing(spark, sf):
    rows = table(spark, sf, "events").select("event_type", (F.col("value") / 10).alias("angle"), (F.col("user_id") + 1.0).alias("weight"))
    smooth = statistics.circular_histogram(rows, ["event_type"], "angle", "weight").select("event_type", statistics.circular_smooth(F.col("bins")).alias("bins"))
    out = smooth.select("event_type", statistics.circular_peaks(F.col("bins")).alias("peaks"), F.posexplode("bins").alias("bin", "weight"))
    return out.select("event_type", "bin", F.round("weight", 4).alias("weight"), F.array_contains("peaks", F.col("bin")).alias("peak"))


@query(f"""
WITH drawn AS (
  SELECT CAST(ts AS DATE)::VARCHAR AS day, event_type, value, block * 8 + k AS r,
         list_count(list_filter({statistics.poisson_steps()}, lambda s: s <= ('0x' || md5('11|' || event_id || '|' || block)[4 * k + 1:4 * k + 4])::INT)) AS w
  FROM events, range(25) b(block), range(8) d(k) WHERE value IS NOT NULL),
means AS (SELECT day, event_type, r, SUM(w * value) / SUM(w) AS m FROM drawn GROUP BY 1, 2, 3 HAVING SUM(w) > 0)
SELECT e.day, e.event_type, ROUND(mean, 9) AS mean, ROUND(QUANTILE_CONT(m, 0.025), 9) AS low, ROUND(QUANTILE_CONT(m, 0.975), 9) AS high
FROM (SELECT CAST(ts AS DATE)::VARCHAR AS day, event_type, AVG(value) AS mean FROM events WHERE value IS NOT NULL GROUP BY 1, 2) e JOIN means USING (day, event_type) GROUP BY 1, 2, 3""")
def bootstrap_band(spark, sf):
    rows = table(spark, sf, "events").select(F.to_date("ts").cast("string").alias("day"), "event_type", "value", "event_id")
    out = statistics.bootstrap_band(rows, ["day", "event_type"], "value", "event_id", seed=11)
    return out.select("day", "event_type", *[F.round(c, 9).alias(c) for c in ("mean", "low", "high")])


# ---------------------------------------------------------------- joins and sets


@query("SELECT a.l_orderkey, a.l_linenumber, a.l_quantity AS top, b.l_discount AS bottom FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber")
def inner_composite(spark, sf):
    rows = table(spark, sf, "lineitem")
    key = ["l_orderkey", "l_linenumber"]
    return joins.tracks(rows.select(*key, F.col("l_quantity").alias("top")), rows.select(*key, F.col("l_discount").alias("bottom")), key)


@query("""
SELECT o_custkey, day::VARCHAR AS day, price, qty FROM (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, ROUND(SUM(o_totalprice), 2) AS price FROM orders GROUP BY 1, 2)
JOIN (SELECT o_custkey, CAST(l_shipdate AS DATE) AS day, SUM(l_quantity) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) USING (o_custkey, day)""")
def sum_join(spark, sf):
    orders = table(spark, sf, "orders")
    shipped = table(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", F.to_date("l_shipdate").alias("day"), "l_quantity")
    return joins.sums(orders.select("o_custkey", F.to_date("o_orderdate").alias("day"), "o_totalprice"), shipped, ["o_custkey", "day"], F.round(F.sum("o_totalprice"), 2).alias("price"), F.sum("l_quantity").alias("qty")).withColumn("day", F.col("day").cast("string"))


@query("""
SELECT c_custkey, large, COALESCE(large, 0) AS large_or_none FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, COUNT(*) AS large FROM orders WHERE o_totalprice > 300000 GROUP BY 1) USING (c_custkey)""")
def left_posture(spark, sf):
    large = table(spark, sf, "orders").where("o_totalprice > 300000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("large"))
    out = joins.attributes(table(spark, sf, "customer").select("c_custkey"), large, "c_custkey")
    return out.withColumn("large_or_none", F.coalesce("large", F.lit(0)))


@query("""
SELECT c_custkey, c_name, name, k FROM (SELECT c_custkey, c_name, s.name, s.k, ROW_NUMBER() OVER (PARTITION BY c_name, c_custkey ORDER BY s.k) AS n
  FROM customer JOIN (SELECT n_nationkey AS k, n_nationkey::VARCHAR AS name FROM nation) s ON suffix(c_name, s.name)) WHERE n = 1""")
def suffix_lookup(spark, sf):
    names = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_nationkey").cast("string").alias("name"))
    return joins.by_suffix(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_name", names, "name", "k")


@query("SELECT p_partkey, COALESCE(NULLIF(p_size, 1)::DOUBLE, AVG(NULLIF(p_size, 1)) OVER ()) AS size FROM part")
def null_mean_fill(spark, sf):
    return joins.fill_with_mean(table(spark, sf, "part").select("p_partkey", F.nullif("p_size", F.lit(1)).alias("s")), "s", "size").drop("s")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def set_difference(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").exceptAll(table(spark, sf, "orders").where("o_totalprice > 300000").select("o_custkey").distinct())


@query("SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def set_intersection(spark, sf):
    rows = table(spark, sf, "lineitem")
    return rows.where("l_returnflag = 'A'").select("l_partkey").intersect(rows.where("l_returnflag = 'R'").select("l_partkey"))


@query("SELECT DISTINCT l_partkey AS k FROM lineitem UNION SELECT p_partkey FROM part")
def distinct_union(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("k")).union(table(spark, sf, "part").select("p_partkey")).distinct()


@query("""
SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 200000""")
def three_way(spark, sf):
    rows = table(spark, sf, "orders").where("o_totalprice > 200000").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name")


@query("SELECT s_suppkey, s_name FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49.5 AND l_discount > 0.08)")
def unmatched_attributes(spark, sf):
    used = table(spark, sf, "lineitem").where("l_quantity > 49.5 and l_discount > 0.08").select(F.col("l_suppkey").alias("s_suppkey"))
    return joins.unmatched(table(spark, sf, "supplier").select("s_suppkey", "s_name"), used, "s_suppkey")


@query("""
SELECT user_id, k, a.value AS net, b.value AS cls FROM (SELECT user_id, value, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id)::INTEGER AS k FROM events WHERE event_type = 'click') a
JOIN (SELECT user_id, value, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id)::INTEGER AS k FROM events WHERE event_type <> 'click') b USING (user_id, k)""")
def positional_zip(spark, sf):
    from pyspark.sql import Window

    rows = table(spark, sf, "events")
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    side = lambda where, name: rows.where(where).select("user_id", nth.alias("k"), F.col("value").alias(name))
    return joins.zipped(side("event_type = 'click'", "net"), side("event_type <> 'click'", "cls"), ["user_id"], "k")


@query("""
SELECT label, t.vec_id AS t, f.vec_id AS f, SQRT(POW(t.embedding[1]::DOUBLE - f.embedding[1]::DOUBLE, 2) + POW(t.embedding[2]::DOUBLE - f.embedding[2]::DOUBLE, 2)) AS distance
FROM embeddings t JOIN embeddings f USING (label) WHERE t.vec_id % 100 = 0""")
def centroid_distances(spark, sf):
    rows = table(spark, sf, "embeddings").select("label", "vec_id", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    truth = rows.where("vec_id % 100 = 0").select("label", F.col("vec_id").alias("t"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    found = rows.select("label", F.col("vec_id").alias("f"), F.col("x").alias("fx"), F.col("y").alias("fy"))
    return joins.paired_distances(truth, found, "label").select("label", "t", "f", "distance")


_DISTANCES = """
WITH p AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: POW(x[1]::DOUBLE - x[2]::DOUBLE, 2))) AS d
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)"""


def _descriptors(spark, sf):
    rows = table(spark, sf, "embeddings").select("label", F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return rows.where("id % 100 = 0"), rows  # the stated searches against all rows


@query(_DISTANCES + """
SELECT label, a, b, ROUND(d, 6) AS d FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY label, a ORDER BY d, b) AS n, ROW_NUMBER() OVER (PARTITION BY label, b ORDER BY d, a) AS m FROM p) WHERE n = 1 AND m = 1""")
def mutual_nearest(spark, sf):
    return joins.mutual_nearest(*_descriptors(spark, sf), "label", apart=True).select("label", "a", "b", F.round("d", 6).alias("d"))


@query(_DISTANCES + """
SELECT label, a, b, ROUND(d1, 6) AS d1, ROUND(d2, 6) AS d2 FROM (SELECT label, a, b, SQRT(d) AS d1, SQRT(LEAD(d) OVER w) AS d2, ROW_NUMBER() OVER w AS n FROM p WINDOW w AS (PARTITION BY label, a ORDER BY d, b)) WHERE n = 1 AND d1 < 0.95 * d2""")
def ratio_matches(spark, sf):
    return joins.ratio_matches(*_descriptors(spark, sf), "label", 0.95, apart=True).select("label", "a", "b", F.round("d1", 6).alias("d1"), F.round("d2", 6).alias("d2"))


@query("""
WITH p AS (SELECT a.event_type, a.event_id AS a, b.event_id AS b, POW(a.value - b.value, 2) + POW((a.user_id - b.user_id)::DOUBLE, 2) AS d
  FROM events a JOIN events b ON a.event_type = b.event_type AND a.event_id <> b.event_id)
SELECT event_type, a, nth::INTEGER AS nth, b, ROUND(d, 6) AS d FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY event_type, a ORDER BY d, b) AS nth FROM p) WHERE nth <= 2""")
def nearest_two(spark, sf):
    """For every event the two of the same type nearest in value and user."""
    from .operators.neighbours import search

    rows = table(spark, sf, "events").select("event_type", F.col("event_id").alias("id"), F.array("value", F.col("user_id").cast("double")).alias("v"))
    return search(rows, rows, "event_type", 2, apart=True).withColumn("d", F.round("d", 6))


@query("""
WITH m AS (
  SELECT label AS pair, vec_id AS id, embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y,
         CASE WHEN vec_id % 2 = 0 THEN COS(0.3::DOUBLE) * x - SIN(0.3::DOUBLE) * y + 5 + embedding[3]::DOUBLE * 0.4 ELSE embedding[3]::DOUBLE * 100 END AS u,
         CASE WHEN vec_id % 2 = 0 THEN SIN(0.3::DOUBLE) * x + COS(0.3::DOUBLE) * y - 7 + embedding[4]::DOUBLE * 0.4 ELSE embedding[4]::DOUBLE * 100 END AS v FROM embeddings),
matches AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY pair ORDER BY md5('3|' || pair || '|' || id), id, x, y, u, v) - 1 AS nth, COUNT(*) OVER (PARTITION BY pair) AS n FROM m),
asked AS (
  SELECT pair, trial, LEAST(FLOOR((k + ('0x' || md5('3|' || pair || '|' || trial || '|' || k)[1:8])::BIGINT / 4294967296.0::DOUBLE) * n / 4)::INT, n - 1) AS nth
  FROM (SELECT DISTINCT pair, n FROM matches WHERE n >= 4), range(250) t(trial), range(4) s(k)),
fits AS (
  SELECT pair, trial, COVAR_POP(x, u) + COVAR_POP(y, v) AS a, COVAR_POP(x, v) - COVAR_POP(y, u) AS b, AVG(x) AS mx, AVG(y) AS my, AVG(u) AS mu, AVG(v) AS mv
  FROM asked JOIN matches USING (pair, nth) GROUP BY 1, 2),
guesses AS (SELECT pair, trial, a / SQRT(a * a + b * b) AS c, b / SQRT(a * a + b * b) AS s, mu - (c * mx - s * my) AS tx, mv - (s * mx + c * my) AS ty FROM fits WHERE a * a + b * b > 0),
tried AS (SELECT pair, trial, c, s, tx, ty, x, y, u, v, POW(c * x - s * y + tx - u, 2) + POW(s * x + c * y + ty - v, 2) AS e FROM guesses JOIN matches USING (pair)),
votes AS (SELECT pair, trial, COUNT(*) FILTER (e < 0.25) AS inliers, SUM(e) AS total FROM tried GROUP BY 1, 2),
best AS (SELECT pair, trial, inliers FROM votes WHERE inliers > 0 QUALIFY ROW_NUMBER() OVER (PARTITION BY pair ORDER BY inliers DESC, total, trial) = 1),
fitted AS (
  SELECT pair, ANY_VALUE(inliers) AS inliers, COVAR_POP(x, u) + COVAR_POP(y, v) AS a, COVAR_POP(x, v) - COVAR_POP(y, u) AS b, AVG(x) AS mx, AVG(y) AS my, AVG(u) AS mu, AVG(v) AS mv
  FROM tried JOIN best USING (pair, trial) WHERE e < 0.25 GROUP BY 1),
moved AS (SELECT *, a / SQRT(a * a + b * b) AS c, b / SQRT(a * a + b * b) AS s FROM fitted)
SELECT pair AS label, n, COALESCE(inliers, 0) AS inliers, ROUND(ATAN2(s, c), 6) AS angle, ROUND(mu - (c * mx - s * my), 5) AS tx, ROUND(mv - (s * mx + c * my), 5) AS ty
FROM (SELECT DISTINCT pair, n FROM matches) LEFT JOIN moved USING (pair)""")
def rigid_motion(spark, sf):
    """Half the points of each label moved by one rotation and translation, the others anywhere."""
    from .operators import alignment

    e = lambda k: F.get("embedding", F.lit(k)).cast("double")
    c, s, moves = F.cos(F.lit(0.3)), F.sin(F.lit(0.3)), F.col("vec_id") % 2 == 0
    rows = table(spark, sf, "embeddings").select("label", "vec_id", (e(0) * 100).alias("x"), (e(1) * 100).alias("y"), e(2).alias("p"), e(3).alias("q"))
    u = F.when(moves, c * F.col("x") - s * F.col("y") + 5 + F.col("p") * 0.4).otherwise(F.col("p") * 100)
    v = F.when(moves, s * F.col("x") + c * F.col("y") - 7 + F.col("q") * 0.4).otherwise(F.col("q") * 100)
    out = alignment.rigid_motions(rows.withColumns({"u": u, "v": v}), "label", "vec_id", seed=3)
    return out.select("label", "n", "inliers", F.round("angle", 6).alias("angle"), F.round("tx", 5).alias("tx"), F.round("ty", 5).alias("ty"))


@query("""
WITH px AS (SELECT vec_id, ((i - 1) // 8)::INT AS r, ((i - 1) % 8)::INT AS c, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) t(i)),
line AS (
  SELECT scale, s, k, g / SUM(g) OVER (PARTITION BY scale) AS g
  FROM (SELECT scale, s, k, EXP(-0.5::DOUBLE * POW(k / s, 2)) AS g FROM (VALUES (0, 1.0::DOUBLE), (1, 1.5::DOUBLE), (2, 2.0::DOUBLE)) z(scale, s), range(-8, 9) t(k) WHERE ABS(k) <= FLOOR(4 * s + 0.5))),
kernel AS (
  SELECT scale, a.s, a.k AS dr, b.k AS dc, -(a.s * a.s) * a.g * b.g * ((a.k * a.k + b.k * b.k) / POW(a.s, 4) - 2 / (a.s * a.s)) AS w FROM line a JOIN line b USING (scale)),
folded AS (SELECT scale, k, pos, LEAST((pos + k + 32) % 16, 15 - (pos + k + 32) % 16) AS at_ FROM (SELECT DISTINCT scale, k FROM line), range(8) t(pos)),
taps AS (SELECT kernel.scale, a.pos AS r, b.pos AS c, a.at_ AS r2, b.at_ AS c2, SUM(w) AS w FROM kernel JOIN folded a ON a.scale = kernel.scale AND a.k = dr JOIN folded b ON b.scale = kernel.scale AND b.k = dc GROUP BY ALL),
found AS (SELECT px.vec_id, taps.scale, taps.r, taps.c, SUM(w * v) AS response FROM px JOIN taps ON px.r = taps.r2 AND px.c = taps.c2 GROUP BY ALL)
SELECT vec_id, scale::INTEGER AS scale, r::INTEGER AS "row", c::INTEGER AS col, ROUND(response, 6) AS response FROM found f
WHERE response > 0.1 AND NOT EXISTS (SELECT 1 FROM found o WHERE o.vec_id = f.vec_id AND ABS(o.scale - f.scale) <= 1 AND ABS(o.r - f.r) <= 1 AND ABS(o.c - f.c) <= 1 AND o.response > f.response)""")
def scale_blobs(spark, sf):
    """Each embedding as an 8 x 8 image: its blobs at three scales."""
    from .operators.blobs import grid_blobs

    images = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return grid_blobs(images, ["vec_id"], "embedding", 8, [1.0, 1.5, 2.0], threshold=0.1, overlap=None).select("vec_id", "scale", "row", "col", F.round("response", 6).alias("response"))


@query("""
SELECT o.o_orderkey::VARCHAR AS order_key, c_name AS customer, o_totalprice AS price, 5.5::DOUBLE AS tube_mm, LPAD(c_custkey::VARCHAR, 6, '0') AS id FROM orders o JOIN customer ON o_custkey::VARCHAR = c_custkey::VARCHAR""")
def renamed_and_cast(spark, sf):
    """Columns renamed, dropped, bound as constants; keys of different types joined as text."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice").toDF("order_key", "key", "price")
    customers = table(spark, sf, "customer").withColumnRenamed("c_name", "customer").drop("c_address", "c_phone", "c_acctbal", "c_mktsegment", "c_nationkey").withColumn("key", F.col("c_custkey").cast("string"))
    both = orders.withColumn("key", F.col("key").cast("int").cast("string")).join(customers, "key")
    return both.select(F.col("order_key").cast("string").alias("order_key"), "customer", "price", F.lit(scalars.TUBE_MM).alias("tube_mm"), F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("id"))


# ---------------------------------------------------------------- evaluation


@query("""
SELECT l_suppkey, l_partkey, MAX(l_quantity) AS l_quantity FROM (
  SELECT l_suppkey, l_partkey, l_quantity, l_discount, l_tax, ROW_NUMBER() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS k FROM lineitem)
WHERE l_discount * 10 > 0.2 AND l_tax - 0.05 < 0 GROUP BY 1, 2""")
def best_by_frame(spark, sf):
    """Regions paired by place with those of a second track; of each frame's sure and darker ones the largest."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("l_suppkey", "l_partkey").orderBy("l_orderkey", "l_linenumber", "l_extendedprice"))
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_quantity", "l_discount", "l_tax", nth.alias("k"))
    net = rows.select("l_suppkey", "l_partkey", "k", "l_quantity", (F.col("l_discount") * 10).alias("intensity_mean"))
    cls = rows.select("l_suppkey", "l_partkey", "k", (F.col("l_tax") - 0.05).alias("intensity_mean"))
    return evaluation.best_by_frame(net.withColumn("frame", F.col("l_partkey")), cls, ["l_suppkey", "l_partkey"], "k", "frame", "l_quantity", 0.2).drop("frame")


@query("""
SELECT l_suppkey, COUNT(*) FILTER (t AND f) AS common, COUNT(*) AS either, COUNT(*) FILTER (t AND f) / COUNT(*) AS iou FROM (
  SELECT l_suppkey, l_partkey, BOOL_OR(l_returnflag = 'A') AS t, BOOL_OR(l_returnflag = 'R') AS f FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2) GROUP BY 1""")
def set_iou(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag")
    return evaluation.overlap(rows.where("l_returnflag = 'A'"), rows.where("l_returnflag = 'R'"), ["l_suppkey"], "l_partkey")


@query("""
SELECT CASE WHEN t = f THEN 'correct' WHEN t > f THEN 'missed' ELSE 'false' END AS outcome, COUNT(*) AS n FROM (
  SELECT l_suppkey, COUNT(*) FILTER (l_returnflag = 'A') AS t, COUNT(*) FILTER (l_returnflag = 'R') AS f FROM lineitem GROUP BY 1) GROUP BY 1""")
def outcome_counts(spark, sf):
    counts = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "A").alias("t"), F.count_if(F.col("l_returnflag") == "R").alias("f"))
    return evaluation.outcomes(counts, "t", "f")


@query("""
SELECT o_orderkey, t - COALESCE(f, -10) AS error FROM (SELECT l_orderkey AS o_orderkey, MAX(l_quantity)::DOUBLE AS t FROM lineitem GROUP BY 1)
LEFT JOIN (SELECT l_orderkey AS o_orderkey, MAX(l_quantity)::DOUBLE AS f FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) USING (o_orderkey)""")
def tip_error(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").cast("double").alias("q"), "l_returnflag")
    return evaluation.tip_error(rows, rows.where("l_returnflag = 'R'"), "o_orderkey", "q")


# ---------------------------------------------------------------- scalars


@query(r"""
SELECT page_id, NULLIF(regexp_extract(url, '([^/]+)$', 1), '') AS last_part, regexp_extract(url, '([^/]+)\.[^./]*$', 1) AS stem FROM pages""")
def path_parts(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.nullif(F.regexp_extract("url", r"([^/]+)$", 1), F.lit("")).alias("last_part"), scalars.stem(F.col("url")).alias("stem"))


_PATH = "'data2/moth' || (o_custkey % 90 + 10) || '_' || replace(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), '-', CASE WHEN o_orderkey % 2 = 0 THEN '-' ELSE '_' END) || '_Cine1.cine'"


def _paths(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    name = F.concat(F.lit("data2/moth"), (F.col("o_custkey") % 90 + 10).cast("string"), F.lit("_"), F.when(F.col("o_orderkey") % 2 == 0, day).otherwise(F.translate(day, "-", "_")), F.lit("_Cine1.cine"))
    return table(spark, sf, "orders").select("o_orderkey", name.alias("path"))


@query(f"""
SELECT o_orderkey, regexp_extract(p, '(moth[^_]*)_', 1) AS animal, regexp_extract(p, '(?i)moth([^_]*)_', 1) AS id, NULLIF(regexp_extract(p, 'moth[0-9]{{2}}|mothM[0-9]|mothDelta[0-9]', 0), '') AS code,
  regexp_extract(p, '([^/]+)[.][^./]*$', 1) AS stem FROM (SELECT o_orderkey, {_PATH} AS p FROM orders)""")
def names_from_paths(spark, sf):
    p = F.col("path")
    return _paths(spark, sf).select("o_orderkey", scalars.animal_name(p).alias("animal"), scalars.animal_id(p).alias("id"), scalars.animal_code(p).alias("code"), scalars.stem(p).alias("stem"))


@query(f"""
SELECT o_orderkey, CAST(replace(regexp_extract(p, '[0-9]{{4}}.[0-9]{{2}}.[0-9]{{2}}', 0), '_', '-') AS DATE)::VARCHAR AS day,
  COALESCE(NULLIF(regexp_extract(p, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}', 0), ''), replace(regexp_extract(p, '[0-9]{{4}}_[0-9]{{2}}_[0-9]{{2}}', 0), '_', '-')) AS strict FROM (SELECT o_orderkey, {_PATH} AS p FROM orders)""")
def dates_from_paths(spark, sf):
    return _paths(spark, sf).select("o_orderkey", scalars.recording_date(F.col("path")).cast("string").alias("day"), scalars.recording_date_strict(F.col("path")).alias("strict"))


@query(f"""
SELECT o_orderkey, array_to_string(list_slice(parts, 1, len(parts) - 1), ' ') AS words FROM (
  SELECT o_orderkey, regexp_split_to_array(regexp_extract(p, '[^/]*$', 0), '[_.-]') AS parts FROM (SELECT o_orderkey, {_PATH} AS p FROM orders))""")
def path_words(spark, sf):
    return _paths(spark, sf).select("o_orderkey", scalars.words_but_last(F.col("path")).alias("words"))


@query(f"""
SELECT o_orderkey, p AS path FROM (SELECT o_orderkey, {_PATH} AS p FROM orders) WHERE NOT contains(p, 'moth1') AND NOT contains(p, 'delta') AND NOT contains(p, '_1995')""")
def name_exclusion(spark, sf):
    p = F.col("path")
    return _paths(spark, sf).where(~p.contains("moth1") & ~p.contains("delta") & ~p.contains("_1995"))


@query("SELECT p_partkey, 5.5::DOUBLE / NULLIF(p_size, 1) AS lin, 0.1::DOUBLE / NULLIF(p_size, 1) AS vol FROM part")
def unit_scales(spark, sf):
    px = F.nullif("p_size", F.lit(1)).cast("double")
    return table(spark, sf, "part").select("p_partkey", scalars.lin_scale(px).alias("lin"), scalars.vol_scale(px).alias("vol"))


@query("SELECT event_type, round_even(AVG(CASE WHEN value < 50 THEN 1.0::DOUBLE ELSE 0 END) * 100, 1) AS pct FROM events GROUP BY 1")
def percent_rounded(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(scalars.percent(statistics.share(F.col("value") < 50)).alias("pct"))


@query("""
SELECT c_custkey, (contains(c_mktsegment, 'U')::INT + (c_mktsegment = 'BUILDING')::INT)::INTEGER AS category, NOT contains(c_mktsegment, 'U') AS flying, 'data2/' || c_name AS filename FROM customer""")
def posture_category(spark, sf):
    perched, curling = F.col("c_mktsegment").contains("U"), F.col("c_mktsegment") == "BUILDING"
    return table(spark, sf, "customer").select("c_custkey", scalars.category(curling, perched).alias("category"), (~perched).alias("flying"), F.concat(F.lit("data2/"), "c_name").alias("filename"))


@query("""
SELECT event_id, len(string_split(p, ';')) AS n, string_split(string_split(p, ';')[1], ',')[1]::DOUBLE AS x0, string_split(string_split(p, ';')[2], ',')[2]::DOUBLE AS y1, string_split(string_split(p, ';')[3], ',')[1]::DOUBLE AS x2 FROM (
  SELECT event_id, event_id || ',' || user_id || ';' || user_id || ',' || event_id || ';0.5,1' AS p FROM events)""")
def coord_parse(spark, sf):
    packed = F.concat_ws(";", F.concat_ws(",", "event_id", "user_id"), F.concat_ws(",", "user_id", "event_id"), F.lit("0.5,1"))
    p = F.col("p")
    return table(spark, sf, "events").select("event_id", scalars.points(packed).alias("p")).select("event_id", F.size(p).cast("long").alias("n"), p[0]["x"].alias("x0"), p[1]["y"].alias("y1"), p[2]["x"].alias("x2"))


@query("""
SELECT l_orderkey, l_linenumber, GREATEST(0, LEAST(round_even(l_quantity, 0)::INT - 5, 40))::INTEGER AS minrow, GREATEST(0, LEAST(round_even(l_linenumber * 1.5, 0)::INT - 20, 30))::INTEGER AS mincol,
  GREATEST(0, LEAST(round_even(l_quantity, 0)::INT + 5, 40))::INTEGER AS maxrow, GREATEST(0, LEAST(round_even(l_linenumber * 1.5, 0)::INT + 20, 30))::INTEGER AS maxcol FROM lineitem""")
def clamped_boxes(spark, sf):
    rows = table(spark, sf, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", scalars.box_around(F.col("l_quantity"), F.col("l_linenumber") * F.lit(1.5), 40, 30).alias("b")).select("l_orderkey", "l_linenumber", "b.*")


@query("SELECT vec_id, embedding[1]::DOUBLE AS minrow, embedding[2]::DOUBLE AS mincol, embedding[3]::DOUBLE AS maxrow, embedding[4]::DOUBLE AS maxcol, embedding[3]::DOUBLE - embedding[1]::DOUBLE AS height FROM embeddings")
def box_columns(spark, sf):
    at = lambda k: F.get("embedding", F.lit(k)).cast("double")
    return table(spark, sf, "embeddings").select("vec_id", at(0).alias("minrow"), at(1).alias("mincol"), at(2).alias("maxrow"), at(3).alias("maxcol"), (at(2) - at(0)).alias("height"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice::DOUBLE / l_quantity AS ratio, ROUND(COS(l_discount) * l_quantity, 9) AS reach, ROUND(DEGREES(l_discount), 9) AS degrees FROM lineitem")
def axis_expressions(spark, sf):
    q, d = F.col("l_quantity").cast("double"), F.col("l_discount").cast("double")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", scalars.axis_ratio(F.col("l_extendedprice").cast("double"), q).alias("ratio"), F.round(scalars.reach(d, q), 9).alias("reach"), F.round(F.degrees(d), 9).alias("degrees"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) < DATE '1996-06-01' AS early FROM orders WHERE CAST(o_orderdate AS DATE) <> DATE '1996-06-01'")
def date_split(spark, sf):
    day, cut = F.to_date("o_orderdate"), F.lit("1996-06-01").cast("date")
    return table(spark, sf, "orders").where(day != cut).select("o_orderkey", (day < cut).alias("early"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.page') AS page FROM events")
def json_extract(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.page").alias("page"))


_PIXELS_OF = """
WITH px AS (
  SELECT label::VARCHAR AS filename, vec_id::INTEGER AS frame_num, (i - 1)::INTEGER AS pixel, LEAST(GREATEST(FLOOR(embedding[i]::DOUBLE * 64) + 128, 0), 255)::INTEGER AS v FROM embeddings, range(1, 65) t(i))
"""


# ---------------------------------------------------------------- stores: written by Spark from the tables, and read again


def _place(spark, name):
    from .storage import new_place

    return new_place(spark, name)


@query("SELECT user_id::VARCHAR AS filename, COUNT(*) AS frames, SUM(event_id)::BIGINT AS places, ROUND(SUM(value), 6) AS total FROM events GROUP BY 1")
def text_tracks(spark, sf):
    """A text file for each user, in two writes of which the second appends, read again."""
    from .sources import measurements, sinks

    place = _place(spark, "tracks")
    rows = table(spark, sf, "events").select(F.concat(F.lit("data2/"), F.col("user_id").cast("string"), F.lit(".cine")).alias("filename"), F.col("event_id").alias("frame_num"), "value", "event_type")
    sinks.write_tracks(rows.where("event_type = 'click'"), place)
    sinks.write_tracks(rows.where("event_type <> 'click'"), place)
    back = measurements.read_tracks(spark, place, "frame_num long, value double, event_type string", sep="\t")
    name = F.regexp_extract("filename", r"([^/]+)\.tsv$", 1).alias("filename")
    return back.groupBy(name).agg(F.count("*").alias("frames"), F.sum("frame_num").alias("places"), F.round(F.sum("value"), 6).alias("total"))


@query("SELECT l_suppkey::VARCHAR AS filename, l_orderkey AS frame_num, l_quantity AS a, l_extendedprice AS b FROM lineitem")
def stored_maps(spark, sf):
    """Maps from a supplier to its rows, positional, written a line each and read again."""
    from .sources import measurements

    place, names = _place(spark, "maps"), ("frame_num", "a", "b")
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("filename"), F.col("l_orderkey").alias("frame_num"), F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"))
    measurements.write_map(rows, place, names)
    return measurements.read_lines(spark, place, names)


@query("SELECT c_name AS filename, c_acctbal::DOUBLE AS px, 5.5::DOUBLE / NULLIF(c_acctbal::DOUBLE, 0) AS lin FROM customer")
def delimited_table(spark, sf):
    """A headered table with units, written as text and read by its schema."""
    from .schemas import UNITS
    from .sources import measurements

    place = _place(spark, "units")
    table(spark, sf, "customer").select(F.col("c_name").alias("filename"), F.col("c_acctbal").cast("double").alias("distance(pixels)"), F.lit(5.5).alias("distance(mm)"), F.lit(0.02).alias("error"), F.lit(None).cast("double").alias("ratio")).write.csv(place, header=True)
    return measurements.read_table(spark, place, UNITS).select("filename", "px", scalars.lin_scale(F.col("px")).alias("lin"))


@query(_PIXELS_OF + "SELECT frame_num, 8 AS height, 8 AS width, SUM(v)::BIGINT AS total, SUM(v * (pixel + 1))::BIGINT AS weighted FROM px GROUP BY 1")
def png_frames(spark, sf):
    """Each embedding as a PNG file, read again from the folder."""
    from .sources import images

    place = _place(spark, "images")
    images.register(spark)
    _images(spark, sf).write.format("png").mode("append").save(place)
    back = images.as_frames(spark.read.format("png").load(place))
    total = back.select("frame_num", "height", "width", F.posexplode(scalars.pixel_shares(F.col("pixels"))).alias("at", "p")).withColumn("v", F.round(F.col("p") * 255).cast("long"))
    return total.groupBy("frame_num", "height", "width").agg(F.sum("v").alias("total"), F.sum(F.col("v") * (F.col("at") + 1)).alias("weighted"))


@query("""
SELECT o_custkey::VARCHAR AS filename, COUNT(*) AS frames, MEDIAN(derivative) AS derivative, MEDIAN(rate) AS rate FROM (
  SELECT o_custkey, (LEAD(o_totalprice) OVER w - o_totalprice) / (LEAD(o_orderkey) OVER w - o_orderkey) AS derivative, o_totalprice * 2 AS rate FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
WHERE derivative IS NOT NULL GROUP BY 1""")
def bucketed_recordings(spark, sf):
    """Two tracks in tables that share one layout: joined, differentiated and grouped without moving a row."""
    from .sources import buckets

    orders = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("filename"), F.col("o_orderkey").alias("frame_num"), "o_totalprice")
    both = buckets.paired(orders.withColumnRenamed("o_totalprice", "value"), orders.select("filename", "frame_num", (F.col("o_totalprice") * 2).alias("rate")))
    moving = tracks.forward_derivative(both, ["filename"], "frame_num", "value")
    return moving.groupBy("filename").agg(F.count("*").alias("frames"), F.median("derivative").alias("derivative"), F.median("rate").alias("rate"))


# ---------------------------------------------------------------- composed


@query("""
WITH lowest AS (SELECT user_id, event_id, value FROM events WHERE event_type <> 'error'),
moving AS (SELECT user_id, event_id, (LEAD(value) OVER w - value) / (LEAD(event_id) OVER w - event_id) AS derivative FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
scaled AS (SELECT c_custkey AS user_id, 5.5::DOUBLE / (c_nationkey + 1) AS lin FROM customer),
rows AS (SELECT l.user_id, l.value * s.lin AS submergence, m.derivative * s.lin * 30 AS rate FROM lowest l JOIN moving m USING (user_id, event_id) JOIN scaled s USING (user_id) WHERE m.derivative IS NOT NULL)
SELECT user_id, ROUND(MEDIAN(submergence), 9) AS submergence, ROUND(MEDIAN(rate), 9) AS rate FROM rows WHERE submergence >= 0 AND rate >= 0 GROUP BY 1""")
def median_per_recording(spark, sf):
    """The recordings' plan in small: filter, derivative, join of two tracks, units, filter, medians."""
    events = table(spark, sf, "events").select("user_id", "event_id", "value", "event_type")
    moving = tracks.forward_derivative(events.drop("event_type"), ["user_id"], "event_id", "value").drop("value")
    rows = joins.tracks(events.where("event_type <> 'error'").drop("event_type"), moving, ["user_id", "event_id"])
    scales = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), scalars.lin_scale((F.col("c_nationkey") + 1).cast("double")).alias("lin"))
    rows = rows.join(scales, "user_id").select("user_id", (F.col("value") * F.col("lin")).alias("submergence"), (F.col("derivative") * F.col("lin") * 30).alias("rate"))
    out = statistics.medians(rows.where("submergence >= 0 and rate >= 0"), ["user_id"])
    return out.select("user_id", F.round("submergence", 9).alias("submergence"), F.round("rate", 9).alias("rate"))


def _images(spark, sf):
    """Each embedding of 64 numbers as a frame of 8 x 8 bytes; its label is the recording. Other lengths make other widths."""
    byte = F.transform("embedding", lambda x: F.lpad(F.hex(F.least(F.greatest(F.floor(x * 64) + 128, F.lit(0)), F.lit(255))), 2, "0"))
    wide = F.ceil(F.size("embedding") / 8).cast("int")
    filled = F.rpad(F.array_join(byte, ""), wide * 16, F.lit("0"))
    return table(spark, sf, "embeddings").where(F.size("embedding") > 0).select(F.col("label").cast("string").alias("filename"), F.col("vec_id").cast("int").alias("frame_num"), F.lit(8).alias("height"), wide.alias("width"), F.unhex(filled).alias("pixels"))


_PIXELS = _PIXELS_OF.rstrip() + """,
medians AS (
  SELECT filename, pixel, CASE WHEN ANY_VALUE(n) > 1 THEN COALESCE(MAX(CASE WHEN k = (n + 1) // 2 + 1 THEN v END), 255) ELSE 255 END::INTEGER AS median FROM (
    SELECT filename, pixel, v, ROW_NUMBER() OVER (PARTITION BY filename, pixel ORDER BY v) AS k, COUNT(*) OVER (PARTITION BY filename, pixel) AS n FROM px) GROUP BY 1, 2)
"""


@query(_PIXELS + "SELECT filename, pixel, median FROM medians")
def frame_median(spark, sf):
    from .operators import frames

    return frames.temporal_median(_images(spark, sf))


@query(_PIXELS + "SELECT filename, frame_num, pixel, v - median AS difference FROM px JOIN medians USING (filename, pixel)")
def frame_difference(spark, sf):
    from .operators import frames

    images = _images(spark, sf)
    return frames.difference(images, frames.temporal_median(images))


@query("SELECT vec_id::INTEGER AS frame_num, (i - 1)::INTEGER AS pixel, ROUND(LEAST(GREATEST(FLOOR(embedding[i]::DOUBLE * 64) + 128, 0), 255) / 255.0::DOUBLE, 9) AS share FROM embeddings, range(1, 65) t(i)")
def normalised_pixels(spark, sf):
    return _images(spark, sf).select("frame_num", F.posexplode(scalars.pixel_shares(F.col("pixels"))).alias("pixel", "share")).withColumn("share", F.round("share", 9))


@query(_PIXELS + """, sums AS (SELECT filename, frame_num, SUM(v) AS total, COUNT(*) FILTER (v > 127.5) AS marked FROM px GROUP BY 1, 2)
SELECT filename, frame_num, total::BIGINT AS total, marked FROM sums WHERE marked > 0""")
def marked_frames(spark, sf):
    """Frames thresholded at one half, those with any marked pixel."""
    from .operators import frames

    images = _images(spark, sf)
    shares = scalars.pixel_shares(F.col("pixels"))
    mask = F.unhex(F.array_join(F.transform(shares, lambda p: F.when(p > 0.5, "01").otherwise("00")), ""))
    kept = frames.labelled_only(images.withColumn("raw", F.col("pixels")).withColumn("pixels", mask))
    total = F.aggregate(scalars.pixel_shares(F.col("raw")), F.lit(0.0), lambda acc, p: acc + p)
    marked = F.size(F.filter(scalars.pixel_shares(F.col("pixels")), lambda p: p > 0))
    return kept.select("filename", "frame_num", F.round(total * 255).cast("long").alias("total"), marked.cast("long").alias("marked"))


_REGIONS = _PIXELS.replace("WITH px", "WITH RECURSIVE px") + """,
inside AS (SELECT filename, frame_num, pixel, pixel // 8 AS r, pixel % 8 AS c, v FROM px WHERE v / 255.0::DOUBLE > 0.5),
touch AS (SELECT a.frame_num, a.pixel AS a, b.pixel AS b FROM inside a JOIN inside b ON a.frame_num = b.frame_num AND ABS(a.r - b.r) <= 1 AND ABS(a.c - b.c) <= 1),
reach AS (SELECT frame_num, pixel AS a, pixel AS b FROM inside UNION SELECT reach.frame_num, reach.a, touch.b FROM reach JOIN touch ON touch.frame_num = reach.frame_num AND touch.a = reach.b),
home AS (SELECT frame_num, a AS pixel, MIN(b) AS root FROM reach GROUP BY 1, 2),
named AS (SELECT *, DENSE_RANK() OVER (PARTITION BY frame_num ORDER BY root)::INTEGER AS label FROM home)
"""


@query(_REGIONS + """
SELECT filename, frame_num, label, ROUND(AVG(r), 9) AS centroid_row, ROUND(AVG(c), 9) AS centroid_col, MIN(r)::INTEGER AS minrow, MIN(c)::INTEGER AS mincol, MAX(r)::INTEGER + 1 AS maxrow, MAX(c)::INTEGER + 1 AS maxcol,
  COUNT(*)::DOUBLE AS area, ROUND(AVG(v / 255.0::DOUBLE), 9) AS intensity_mean, ROUND(MAX(v / 255.0::DOUBLE), 9) AS intensity_max, ROUND(MIN(v / 255.0::DOUBLE), 9) AS intensity_min,
  ROUND(2 * SQRT(COUNT(*) / PI()), 9) AS equivalent_diameter, ROUND(COUNT(*)::DOUBLE / ((MAX(r) + 1 - MIN(r)) * (MAX(c) + 1 - MIN(c))), 9) AS extent,
  ROUND(4 * SQRT((VAR_POP(r) + VAR_POP(c) + 1 / 6.0::DOUBLE) / 2 + SQRT(POW((VAR_POP(r) - VAR_POP(c)) / 2, 2) + POW(COVAR_POP(r, c), 2))), 6) AS major_axis
FROM inside JOIN named USING (frame_num, pixel) GROUP BY 1, 2, 3""")
def region_rows(spark, sf):
    """Each embedding as an image: place, size and intensity of each connected region above one half."""
    from .operators import frames

    found = frames.regions(_images(spark, sf), lambda stack: stack / 255.0)
    rounded = {"centroid_row": 9, "centroid_col": 9, "intensity_mean": 9, "intensity_max": 9, "intensity_min": 9, "equivalent_diameter": 9, "extent": 9, "major_axis": 6}
    columns = ["filename", "frame_num", "label", "minrow", "mincol", "maxrow", "maxcol", "area"]
    return found.select(*columns, *[F.round(c, d).alias(c) for c, d in rounded.items()])


@query(_REGIONS + """
SELECT filename, frame_num, label, area FROM (
  SELECT filename, frame_num, label, COUNT(*)::DOUBLE AS area, ROW_NUMBER() OVER (PARTITION BY frame_num ORDER BY COUNT(*) DESC, label) AS n FROM inside JOIN named USING (frame_num, pixel) GROUP BY 1, 2, 3) WHERE n = 1""")
def largest_region(spark, sf):
    from .operators import frames

    return frames.largest(frames.regions(_images(spark, sf), lambda stack: stack / 255.0)).select("filename", "frame_num", "label", "area")


@query("""
WITH e AS (SELECT vec_id, embedding[1]::DOUBLE * 40 + 20 AS x, embedding[2]::DOUBLE * 40 + 15 AS y, embedding[3]::DOUBLE * 40 + 20 AS x2, embedding[4]::DOUBLE * 40 + 15 AS y2 FROM embeddings),
ends AS (SELECT vec_id, GREATEST(0, LEAST(x, 39.0::DOUBLE)) AS x0, GREATEST(0, LEAST(y, 29.0::DOUBLE)) AS y0, GREATEST(0, LEAST(x2, 39.0::DOUBLE)) AS x1, GREATEST(0, LEAST(y2, 29.0::DOUBLE)) AS y1 FROM e),
steps AS (SELECT *, GREATEST(CEIL(GREATEST(ABS(x1 - x0), ABS(y1 - y0))), 1)::BIGINT AS n FROM ends),
spots AS (SELECT vec_id, round_even(y0 + (k / n) * (y1 - y0), 0)::INT AS r, round_even(x0 + (k / n) * (x1 - x0), 0)::INT AS c FROM (SELECT *, unnest(range(0, n + 1)) AS k FROM steps))
SELECT DISTINCT vec_id::VARCHAR AS image, r + dr AS "row", c + dc AS col FROM spots, (VALUES (-1), (0), (1)) a(dr), (VALUES (-1), (0), (1)) b(dc) WHERE r + dr BETWEEN 0 AND 29 AND c + dc BETWEEN 0 AND 39""")
def line_pixels(spark, sf):
    """A line for each embedding, drawn three pixels wide into an image of 30 x 40."""
    from .sources import annotations

    at = lambda k, mid: F.get("embedding", F.lit(k)).cast("double") * 40 + mid
    lines = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("image"), F.array(F.struct(at(0, 20).alias("x"), at(1, 15).alias("y")), F.struct(at(2, 20).alias("x"), at(3, 15).alias("y"))).alias("points"))
    return annotations.line_pixels(lines, 30, 40, 1)


@query()
def frame_regions(spark, sf):
    """Each embedding as an image: connected regions of its positive pixels."""
    from .operators import frames

    return frames.regions_or_reasons(_images(spark, sf), lambda stack: stack / 255.0)
