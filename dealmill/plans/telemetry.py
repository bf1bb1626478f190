"""Operations telemetry over events: volumes, latency, buckets, sessions, rate limits, status history, retries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dealmill.domain import EVENTS_AS_OF, Domain, with_domain
from dealmill.operators.quantiles import described, same_keys
from dealmill.operators.topk import first_per_key

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir, f=f: f(Domain(spark, sf_dir))
        if sql:
            SQL[f.__name__] = with_domain(sql)
        return f

    return put


def _latency(rows: DataFrame, key: str) -> DataFrame:
    """Counts, means and latencies of groups that may hold any number of events."""
    return described(rows, [key], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, lambda c: F.round(c, 4))


_LATENCY = "round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99"


@query(f"SELECT event_type AS route, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 4) AS mean, {_LATENCY} FROM events GROUP BY 1")
def telemetry_by_route(d: Domain) -> DataFrame:
    rows = d.t("events").withColumnRenamed("event_type", "route")
    told = _latency(rows, "route").select("route", F.col("rows").alias("n"), F.round("mean", 4).alias("mean"), "p50", "p95", "p99")
    return same_keys(told, rows.groupBy("route").agg(F.countDistinct("user_id").alias("users")), ["route"])


@query(f"SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, {_LATENCY} FROM events GROUP BY 1")
def telemetry_hourly(d: Domain) -> DataFrame:
    hour = F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH")
    rows = d.t("events").withColumn("hour", hour)
    told = _latency(rows, "hour").select("hour", F.col("rows").alias("n"), "p50", "p95", "p99")
    return same_keys(told, rows.groupBy("hour").agg(F.count_if(F.col("event_type") == "error").alias("errors")), ["hour"])


@query("""SELECT user_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute, count(*) AS n, count(*) > 1 AS limited FROM events GROUP BY ALL""")
def rate_limit_minutes(d: Domain, limit: int = 1) -> DataFrame:
    minute = F.date_format(F.date_trunc("minute", "ts"), "yyyy-MM-dd HH:mm")
    return d.t("events").groupBy("user_id", minute.alias("minute")).agg(F.count(F.lit(1)).alias("n")).withColumn("limited", F.col("n") > limit)


@query("""WITH g AS (SELECT user_id, ts, value, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS fresh FROM events))
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS opened, count(*) AS n, round(sum(value), 2) AS total FROM g GROUP BY user_id, s""")
def user_sessions(d: Domain) -> DataFrame:
    """Sessions end after four hours of silence."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    fresh = F.when(F.col("ts") - F.lag("ts").over(w) < F.expr("INTERVAL 4 HOUR"), 0).otherwise(1)
    rows = d.t("events").withColumn("fresh", fresh).withColumn("s", F.sum("fresh").over(w))
    by = rows.groupBy("user_id", "s").agg(F.min("ts").alias("at"), F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return by.select("user_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("opened"), "n", "total")


@query("""SELECT DISTINCT ON (user_id) user_id, event_id, event_type AS status FROM events ORDER BY user_id, ts DESC NULLS LAST, event_id DESC""")
def latest_status(d: Domain) -> DataFrame:
    rows = d.t("events").select("user_id", "event_id", "ts", F.col("event_type").alias("status"))
    return first_per_key(rows, ["user_id"], [F.col("ts").desc_nulls_last(), F.desc("event_id")]).drop("ts")


_SEVERITY = "CASE WHEN hours IS NULL THEN 'never_run' WHEN hours > 12 THEN 'critical' WHEN hours > 4 THEN 'warning' ELSE 'healthy' END"


@query(f"""SELECT user_id, {_SEVERITY} AS severity, failures, least(15 * power(2, least(greatest(failures - 1, 0), 5)), 360)::BIGINT AS retry_minutes FROM (
 SELECT user_id, date_diff('second', max(ts) FILTER (WHERE event_type = 'signup'), TIMESTAMP '{EVENTS_AS_OF}') / 3600 AS hours, count(*) FILTER (WHERE event_type = 'error') AS failures FROM events GROUP BY 1)""")
def source_severity(d: Domain) -> DataFrame:
    """Severity by hours since the last success, and the next retry: 15 minutes doubled with each failure, at most six hours."""
    last = F.max(F.when(F.col("event_type") == "signup", F.col("ts")))
    by = d.t("events").groupBy("user_id").agg(last.alias("last"), F.count_if(F.col("event_type") == "error").alias("failures"))
    hours = F.timestamp_diff("SECOND", F.col("last"), F.lit(EVENTS_AS_OF).cast("timestamp_ntz")) / 3600
    severity = F.when(F.col("last").isNull(), "never_run").when(hours > 12, "critical").when(hours > 4, "warning").otherwise("healthy")
    retry = F.least(15 * F.pow(F.lit(2), F.least(F.greatest(F.col("failures") - 1, F.lit(0)), F.lit(5))), F.lit(360)).cast("long")
    return by.select("user_id", severity.alias("severity"), "failures", retry.alias("retry_minutes"))


@query("""SELECT event_id, user_id FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id, sha256(event_type || ':' || props) ORDER BY ts, event_id) = 1""")
def first_alerts(d: Domain) -> DataFrame:
    """One alert for each (user, content digest): repeats of the same content stay silent."""
    rows = d.t("events").where(F.col("event_type") == "purchase").withColumn("digest", F.sha2(F.concat("event_type", F.lit(":"), "props").cast("binary"), 256))
    return first_per_key(rows.select("event_id", "user_id", "ts", "digest"), ["user_id", "digest"], [F.col("ts"), F.col("event_id")]).select("event_id", "user_id")


@query("""SELECT 'created' AS change, count(*) AS n FROM documents WHERE doc_id % 10 = 3 UNION ALL SELECT 'updated', count(*) FROM documents WHERE doc_id % 10 = 5 AND lower(text) <> text
UNION ALL SELECT 'unchanged', count(*) FROM documents WHERE NOT (doc_id % 10 = 3) AND NOT (doc_id % 10 = 5 AND lower(text) <> text)""")
def content_changes(d: Domain) -> DataFrame:
    """Created, updated and unchanged rows by content digests against an earlier state; texts are not shuffled."""
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    now = d.t("documents").select("doc_id", digest(F.col("text")).alias("sha"))
    older = F.when(F.col("doc_id") % 10 == 5, F.lower("text")).otherwise(F.col("text"))
    before = d.t("documents").where(F.col("doc_id") % 10 != 3).select("doc_id", digest(older).alias("old"))
    change = F.when(F.col("old").isNull(), "created").when(F.col("old") != F.col("sha"), "updated").otherwise("unchanged")
    return now.join(before, "doc_id", "left").groupBy(change.alias("change")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) OR doc_id % 7 = 0""")
def extraction_backlog(d: Domain) -> DataFrame:
    """Work still to do: never extracted, or extracted by an older parser version."""
    done = d.spark.read.parquet(f"{d.dir}/labels.parquet").where(F.col("quality") == 1).select("doc_id").distinct()
    done = done.withColumn("version", F.when(F.col("doc_id") % 7 == 0, 1).otherwise(2))
    return d.t("documents").select("doc_id").join(done.where(F.col("version") == 2).select("doc_id"), "doc_id", "left_anti")
