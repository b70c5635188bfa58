"""Queries of accuracy, agreement and services: metrics, limits, queues and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import metrics
from tidemark.session import materialise, shared_dir, table
from tidemark.streaming import limits


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with a truth and a prediction of three classes, by language."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    l = table(spark, sf_dir, "labels")
    truth = F.when(F.col("doc_id") % 13 == 0, 255).otherwise(F.col("quality") + F.col("toxic"))
    guess = F.when(F.col("n_chars") > 3000, 2).when(F.col("n_chars") > 900, 1).otherwise(0)
    return l.join(d, "doc_id").select("doc_id", "lang", truth.alias("y"), guess.alias("p"), "n_chars", "quality")


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(judged(spark, sf_dir), "y", "p", 3)


def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.confusion(judged(spark, sf_dir), "y", "p", 3, "lang")
    s = metrics.class_scores(m, "y", "p", ["none", "permanent", "flood"], "lang")
    return s.select("lang", *[F.round(c, 6).alias(c) for c in s.columns if c != "lang"])


def per_group_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language, and all together as a row of NULL."""
    j = judged(spark, sf_dir)
    t, p = F.col("y") == 1, F.col("p") == 1
    return j.rollup("lang").agg(F.count("*").alias("n"), F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))


def binary_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = metrics.binary_scores(judged(spark, sf_dir), F.col("quality") == 1, F.col("n_chars") > 1200, "lang")
    return s.select("lang", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "iou")])


def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.roc_auc(judged(spark, sf_dir), "n_chars", F.col("quality") == 1).select(F.round("auc", 6).alias("auc"))


def percentile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    q = F.percentile("value", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    s = e.groupBy("event_type").agg(q.alias("q"), F.avg((F.col("value") <= 5).cast("int")).alias("within_5"), F.max("value").alias("top"))
    return s.select("event_type", *[F.round(F.get("q", F.lit(k)), 6).alias(n) for k, n in enumerate(("p50", "p90", "p99"))], F.round("within_5", 6).alias("within_5"), F.round("top", 6).alias("top"))


def crosstab_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = judged(spark, sf_dir).select(F.col("quality").alias("a"), F.least("p", F.lit(1)).alias("b"))
    return metrics.crosstab(j, "a", "b").withColumn("agreement", F.round("agreement", 6))


def agreement_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of two masks pixel by pixel, cropped to the domain and 2 pixels around it."""
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") % 40).alias("x"), F.floor(F.col("p_partkey") / 40).alias("y"), (F.col("p_size") <= 20).alias("a"), (F.col("p_size") % 3 == 0).alias("b"), F.col("p_partkey").between(45, 150).alias("inside"))
    box = p.where("inside").agg(*[f(c).alias(f"{c}{n}") for c in ("x", "y") for n, f in (("0", F.min), ("1", F.max))])
    kind = F.when(~F.col("inside"), "outside").when(F.col("a") & F.col("b"), "tp").when(F.col("b"), "fp").when(F.col("a"), "fn").otherwise("tn")
    met = p.crossJoin(F.broadcast(box)).where("x between x0 - 2 and x1 + 2 and y between y0 - 2 and y1 + 2")
    return met.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def comparison_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two methods' F1 by language, one row each: wide to long."""
    j = judged(spark, sf_dir)
    rule = metrics.binary_scores(j, F.col("quality") == 1, F.col("n_chars") > 1200, "lang").select("lang", F.col("f1").alias("rule"))
    model = metrics.binary_scores(j, F.col("quality") == 1, F.col("n_chars") > 400, "lang").select("lang", F.col("f1").alias("model"))
    long = rule.join(model, "lang").unpivot(["lang"], ["rule", "model"], "method", "f1")
    return long.select("lang", "method", F.round("f1", 6).alias("f1"))


def box_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 8 x 2 box of the lattice that holds most flooded pixels, of those with enough domain."""
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") % 40).cast("int").alias("x"), F.floor(F.col("p_partkey") / 40).cast("int").alias("y"), (F.col("p_size") <= 10).cast("int").alias("wet"), (F.col("p_partkey") % 7 < 5).cast("int").alias("dom"))
    places = p.select(F.explode(F.sequence(F.greatest(F.col("x") - 7, F.lit(0)), F.col("x"))).alias("bx"), "x", "y", "wet", "dom")
    boxes = places.select("bx", F.explode(F.sequence(F.greatest(F.col("y") - 1, F.lit(0)), F.col("y"))).alias("by"), "wet", "dom")
    sums = boxes.groupBy("bx", "by").agg(F.sum("wet").alias("wet"), F.sum("dom").alias("dom")).where("dom >= 0.3 * 16")
    best = F.max_by(F.struct(F.col("bx").alias("box_x"), F.col("by").alias("box_y"), "wet"), F.struct("wet", (-F.col("by")).alias("r"), (-F.col("bx")).alias("c")))
    return sums.agg(best.alias("b")).select("b.*")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double")
    return e.select(F.col("event_id").alias("id"), F.when(F.col("user_id") % 7 != 0, F.col("user_id") % 4).alias("visitor"), seconds.alias("at"))


def rate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = requests(spark, sf_dir).where("visitor is not null").withColumn("at", F.col("at").cast("long"))
    return limits.window_counts(r, 3600).select("id", "n_recent")


def rate_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact admission with feedback: rejected requests are not recorded."""
    return limits.limit_batch(requests(spark, sf_dir))


def job_queue_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.get(F.array(F.lit("done"), F.lit("queued"), F.lit("done"), F.lit("error"), F.lit("done")), (F.col("event_id") % 5).cast("int"))
    jobs = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created"), state.alias("state"))
    return limits.queue_places(jobs)


def progress_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.col("event_type").alias("message"), (F.col("value") / 100).alias("share"))
    return limits.latest_progress(log).select("job", "message", F.round("share", 6).alias("share"), "n")


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events read as a stream of files, counted in day windows under a watermark, and written out."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    source.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(source.schema).parquet(f"{folder}/in")
    counts = limits.tumbling_counts(stream, "ts", "event_type").select("window.start", "event_type", "n", "total")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    done = spark.read.parquet(f"{folder}/out")
    last = done.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("v"))
    return materialise(last.select(F.to_date("start").alias("day"), "event_type", "v.n", F.round("v.total", 4).alias("total")), "windows")


QUERIES = {
    f.__name__: f
    for f in (
        confusion_matrix, class_scores, per_group_total, binary_scores, roc_auc, percentile_summary, crosstab_agreement, agreement_map, comparison_table,
        box_lattice, rate_window, rate_limiter, job_queue_positions, progress_latest, stream_windows,
    )
}

_JUDGED = """WITH j AS (SELECT doc_id, lang, CASE WHEN doc_id % 13 = 0 THEN 255 ELSE quality + toxic END AS y, CASE WHEN n_chars > 3000 THEN 2 WHEN n_chars > 900 THEN 1 ELSE 0 END AS p, n_chars, quality
FROM labels JOIN documents USING (doc_id))"""
_F1 = "2 * {p} * {r} / greatest({p} + {r}, 1e-9)"


def _binary(limit: int) -> str:
    tp, fp, fn = f"count(*) FILTER (quality = 1 AND n_chars > {limit})", f"count(*) FILTER (quality <> 1 AND n_chars > {limit})", f"count(*) FILTER (quality = 1 AND n_chars <= {limit})"
    return f"SELECT lang, {tp} / greatest({tp} + {fp}, 1) AS pr, {tp} / greatest({tp} + {fn}, 1) AS re, {tp} / greatest({tp} + {fp} + {fn}, 1) AS iou FROM j GROUP BY lang"


def _score(c: int, name: str) -> str:
    tp, fp, fn = f"count(*) FILTER (y = {c} AND p = {c})", f"count(*) FILTER (y <> {c} AND p = {c})", f"count(*) FILTER (y = {c} AND p <> {c})"
    return f"round({tp} / greatest({tp} + {fp} + {fn}, 1), 6) AS {name}_iou, round(2 * {tp} / greatest(2 * {tp} + {fp} + {fn}, 1), 6) AS {name}_f1"


SQL = {
    "confusion_matrix": _JUDGED
    + " SELECT t.y AS y, q.p AS p, count(j.doc_id) AS n FROM (VALUES (0), (1), (2)) t(y) CROSS JOIN (VALUES (0), (1), (2)) q(p) LEFT JOIN j ON j.y = t.y AND j.p = q.p GROUP BY t.y, q.p",
    "class_scores": _JUDGED
    + f" SELECT lang, {_score(0, 'none')}, {_score(1, 'permanent')}, {_score(2, 'flood')}, round(count(*) FILTER (y > 0 AND p > 0) / greatest(count(*) FILTER (y > 0 OR p > 0), 1), 6) AS any_iou FROM j WHERE y <> 255 GROUP BY lang",
    "per_group_total": _JUDGED
    + " SELECT lang, count(*) AS n, count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y <> 1 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p <> 1) AS fn FROM j GROUP BY ROLLUP (lang)",
    "binary_scores": _JUDGED + f", b AS ({_binary(1200)}) SELECT lang, round(pr, 6) AS precision, round(re, 6) AS recall, round({_F1.format(p='pr', r='re')}, 6) AS f1, round(iou, 6) AS iou FROM b",
    "roc_auc": _JUDGED
    + """, r AS (SELECT quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0::DOUBLE AS r FROM j),
s AS (SELECT sum(r) FILTER (quality = 1) AS ranks, count(*) FILTER (quality = 1) AS pos, count(*) FILTER (quality <> 1) AS neg FROM r)
SELECT round((ranks - pos * (pos + 1) / 2) / (pos * neg), 6) AS auc FROM s""",
    "percentile_summary": """SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99,
round(avg(CASE WHEN value <= 5 THEN 1.0 ELSE 0.0 END), 6) AS within_5, round(max(value), 6) AS top FROM events GROUP BY event_type""",
    "crosstab_agreement": _JUDGED
    + ", c AS (SELECT quality AS a, least(p, 1) AS b, count(*) AS n FROM j GROUP BY ALL) SELECT a, b, n, round((SELECT sum(n) FILTER (a = b) / sum(n) FROM c), 6) AS agreement FROM c",
    "agreement_map": """WITH p AS (SELECT p_partkey % 40 AS x, p_partkey // 40 AS y, p_size <= 20 AS a, p_size % 3 = 0 AS b, p_partkey BETWEEN 45 AND 150 AS i FROM part),
q AS (SELECT min(x) - 2 AS x0, max(x) + 2 AS x1, min(y) - 2 AS y0, max(y) + 2 AS y1 FROM p WHERE i)
SELECT CASE WHEN NOT i THEN 'outside' WHEN a AND b THEN 'tp' WHEN b THEN 'fp' WHEN a THEN 'fn' ELSE 'tn' END AS kind, count(*) AS n FROM p, q WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY 1""",
    "comparison_table": _JUDGED
    + f", a AS ({_binary(1200)}), b AS ({_binary(400)}) SELECT lang, 'rule' AS method, round({_F1.format(p='pr', r='re')}, 6) AS f1 FROM a UNION ALL SELECT lang, 'model', round({_F1.format(p='pr', r='re')}, 6) FROM b",
    "box_lattice": """WITH p AS (SELECT p_partkey % 40 AS x, p_partkey // 40 AS y, p_size <= 10 AS wet, p_partkey % 7 < 5 AS dom FROM part),
s AS (SELECT b.x AS box_x, b.y AS box_y, count(*) FILTER (p.wet) AS wet, count(*) FILTER (p.dom) AS dom FROM p b JOIN p ON p.x BETWEEN b.x AND b.x + 7 AND p.y BETWEEN b.y AND b.y + 1 GROUP BY b.x, b.y)
SELECT CAST(box_x AS INTEGER) AS box_x, CAST(box_y AS INTEGER) AS box_y, wet FROM s WHERE dom >= 0.3 * 16 ORDER BY wet DESC, box_y, box_x LIMIT 1""",
    "rate_window": """WITH r AS (SELECT event_id AS id, user_id % 4 AS visitor, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events WHERE user_id % 7 <> 0)
SELECT id, count(*) OVER (PARTITION BY visitor ORDER BY sec RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS n_recent FROM r""",
    "job_queue_positions": "SELECT event_id AS id, 'queued' AS state, row_number() OVER (ORDER BY ts, event_id) - 1 AS ahead FROM events WHERE event_id % 5 = 1",
    "progress_latest": "SELECT user_id AS job, arg_max(event_type, (ts, event_id)) AS message, round(max(value / 100), 6) AS share, count(*) AS n FROM events GROUP BY user_id",
    "stream_windows": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
