"""Relational shapes: filters, joins, aggregations, windows, pages and sets, each as one query over the domain."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dealmill.domain import Domain, with_domain
from dealmill.operators.filters import Dates, Money, Related, Scalar
from dealmill.operators.quantiles import at_rank, quantiles, ranked
from dealmill.operators.topk import Cursor, after, first_per_key, interleave, keyset_page, ordered
from dealmill.plans.market import since, today

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir, f=f: f(Domain(spark, sf_dir))
        if sql:
            SQL[f.__name__] = with_domain(sql)
        return f

    return put


# --- filters -----------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, p_name, p_type FROM part WHERE p_type ILIKE '%mall%' OR p_type ILIKE '%promo%'""")
def filter_contains_any(d: Domain) -> DataFrame:
    return d.t("part").where(Scalar(include=("mall", "promo")).on(F.col("p_type"))).select("p_partkey", "p_name", "p_type")


@query("""SELECT o_orderkey, o_orderpriority FROM orders WHERE coalesce(o_orderstatus, '') NOT ILIKE '%f%' AND coalesce(o_orderstatus, '') NOT ILIKE '%p%'""")
def filter_contains_none(d: Domain) -> DataFrame:
    status = F.coalesce("o_orderstatus", F.lit(""))
    return d.t("orders").where(~status.ilike("%f%") & ~status.ilike("%p%")).select("o_orderkey", "o_orderpriority")


@query("""SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery') AND (c_name IS NULL OR c_name NOT ILIKE '%7%')""")
def filter_include_exclude(d: Domain) -> DataFrame:
    keep = Scalar(include=("Building", "MACHINERY"), exact=True).on(F.col("c_mktsegment")) & Scalar(exclude=("7",)).on(F.col("c_name"))
    return d.t("customer").where(keep).select("c_custkey", "c_mktsegment")


_FLAGS = "SELECT deal_id FROM deals WHERE {}"
_HAS = "deal_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = '{}')"


@query(_FLAGS.format("(" + _HAS.format("R") + " OR " + _HAS.format("A") + ") AND " + _HAS.format("N") + " AND NOT " + _HAS.format("A")))
def filter_related(d: Domain) -> DataFrame:
    bridge = d.t("lineitem").select(F.col("l_orderkey").alias("deal_id"), "l_returnflag")
    return Related(any=("R", "A"), all=("N",), exclude=("A",)).apply(d.deals(), bridge, "deal_id", "l_returnflag").select("deal_id")


@query("""SELECT deal_id, date_start FROM deals WHERE date_start >= TIMESTAMP '1997-03-01' AND date_start < TIMESTAMP '1997-06-30' + INTERVAL 1 DAY""")
def filter_date_range(d: Domain) -> DataFrame:
    return d.deals().where(Dates(dt.date(1997, 3, 1), dt.date(1997, 6, 30)).on(F.col("date_start"))).select("deal_id", "date_start")


_ACTIVE = "(SELECT l_orderkey AS deal_id, min(l_shipdate) AS opens, CASE WHEN bool_or(l_returnflag = 'N') THEN NULL ELSE max(l_shipdate) END AS closes FROM lineitem GROUP BY 1)"


@query(f"SELECT deal_id FROM {_ACTIVE} WHERE opens < TIMESTAMP '1996-02-01' AND (closes IS NULL OR closes >= TIMESTAMP '1996-01-15')")
def filter_active_during(d: Domain) -> DataFrame:
    spans = d.t("lineitem").groupBy(F.col("l_orderkey").alias("deal_id")).agg(
        F.min("l_shipdate").alias("opens"), F.when(~F.bool_or(F.col("l_returnflag") == "N"), F.max("l_shipdate")).alias("closes")
    )
    return spans.where(Dates(dt.date(1996, 1, 15), dt.date(1996, 1, 31)).overlaps(F.col("opens"), F.col("closes"))).select("deal_id")


@query("""SELECT deal_id, total_value FROM deals WHERE (total_value / 1000 BETWEEN 100 AND 150) OR total_value IS NULL""")
def filter_money_unknown(d: Domain) -> DataFrame:
    keep = Money(gte=100, lte=150, missing="include_as_unknown").on(F.col("total_value"), F.lit("Thousand"), F.lit("USD"))
    return d.deals().where(keep).select("deal_id", "total_value")


@query("""SELECT l_orderkey AS deal_id, max(greatest(l_discount, l_tax)) AS rate FROM lineitem GROUP BY 1 HAVING max(greatest(l_discount, l_tax)) BETWEEN 0.02 AND 0.06""")
def filter_term_range(d: Domain) -> DataFrame:
    rate = F.max(F.greatest("l_discount", "l_tax")).alias("rate")
    return d.t("lineitem").groupBy(F.col("l_orderkey").alias("deal_id")).agg(rate).where(F.col("rate").between(0.02, 0.06))


@query("""SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events WHERE regexp_matches(props, '"k": [1-4][0-9]\\b') AND event_type IS DISTINCT FROM 'view'""")
def filter_json_regex(d: Domain) -> DataFrame:
    keep = F.col("props").rlike(r'"k": [1-4][0-9]\b') & ~F.col("event_type").eqNullSafe("view")
    return d.t("events").where(keep).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""SELECT deal_id FROM deals WHERE agreement_type ILIKE '%urgent%'
UNION SELECT deal_id FROM deals JOIN companies ON company_id = principal_id WHERE company_type ILIKE '%furni%'
UNION SELECT deal_id FROM deal_assets JOIN part ON p_partkey = asset_id WHERE p_name ILIKE '%blue%ring%'""")
def filter_topic(d: Domain) -> DataFrame:
    hits = d.deals().where(F.col("agreement_type").ilike("%urgent%")).select("deal_id")
    firms = d.companies().where(F.col("company_type").ilike("%furni%")).select(F.col("company_id").alias("principal_id"))
    assets = d.t("part").where(F.col("p_name").ilike("%blue%ring%")).select(F.col("p_partkey").alias("asset_id"))
    return hits.unionByName(d.deals().join(firms, "principal_id").select("deal_id")).unionByName(d.deal_assets().join(assets, "asset_id").select("deal_id")).distinct()


# --- joins -------------------------------------------------------------------------------------------------


@query("""SELECT c.company_id, count(d.deal_id) AS deals, round(sum(d.total_value), 2) AS value FROM companies c
LEFT JOIN deals d ON d.principal_id = c.company_id AND d.status = 'F' AND d.total_value > 50000 GROUP BY 1""")
def join_left_on_predicates(d: Domain) -> DataFrame:
    right = d.deals().where((F.col("status") == "F") & (F.col("total_value") > 50000)).select("deal_id", "principal_id", "total_value")
    both = d.companies().join(right, F.col("company_id") == F.col("principal_id"), "left")
    return both.groupBy("company_id").agg(F.count("deal_id").alias("deals"), F.round(F.sum("total_value"), 2).alias("value"))


@query("""SELECT a.partner_id AS a, b.partner_id AS b, count(*) AS deals FROM deal_partners a JOIN deal_partners b ON a.deal_id = b.deal_id AND a.partner_id < b.partner_id
GROUP BY ALL HAVING count(*) >= 3""")
def join_ordered_pairs(d: Domain) -> DataFrame:
    a, b = d.deal_partners(), d.deal_partners().withColumnRenamed("partner_id", "other")
    pairs = a.join(b, "deal_id").where(F.col("partner_id") < F.col("other"))
    return pairs.groupBy(F.col("partner_id").alias("a"), F.col("other").alias("b")).agg(F.count(F.lit(1)).alias("deals")).where(F.col("deals") >= 3)


@query("""SELECT company_id, name FROM companies c WHERE EXISTS (SELECT 1 FROM deals d WHERE d.principal_id = c.company_id AND d.status = 'P')
AND NOT EXISTS (SELECT 1 FROM deals d WHERE d.principal_id = c.company_id AND d.category = '1')""")
def join_semi_anti(d: Domain) -> DataFrame:
    some = d.deals().where(F.col("status") == "P").select(F.col("principal_id").alias("company_id"))
    none = d.deals().where(F.col("category") == "1").select(F.col("principal_id").alias("company_id"))
    return d.companies().join(some, "company_id", "left_semi").join(none, "company_id", "left_anti").select("company_id", "name")


@query("""SELECT company_id FROM companies c WHERE EXISTS (SELECT 1 FROM deals d WHERE d.principal_id = c.company_id AND d.total_value > 400000)
OR EXISTS (SELECT 1 FROM areas a WHERE a.nation_id = c.nation_id AND a.area = 'ASIA')""")
def join_exists_or(d: Domain) -> DataFrame:
    rich = d.deals().where(F.col("total_value") > 400000).select(F.col("principal_id").alias("company_id"))
    asia = d.companies().join(d.areas().where(F.col("area") == "ASIA"), "nation_id").select("company_id")
    return rich.unionByName(asia).distinct().join(d.companies(), "company_id", "left_semi")


@query("""SELECT deal_id, event_id, days, round(greatest(0.3, 1 - 0.5 * days / 30), 4) AS confidence FROM (
  SELECT deal_id, event_id, abs(date_diff('day', date_start::DATE, filed)) AS days,
         row_number() OVER (PARTITION BY deal_id ORDER BY abs(date_diff('day', date_start::DATE, filed)), filed, event_id) AS k
  FROM deals JOIN (SELECT l_orderkey * 10 + l_linenumber AS event_id, l_suppkey AS company, l_shipdate::DATE AS filed FROM lineitem) f
    ON f.company = principal_id % 100 + 1 AND abs(date_diff('day', date_start::DATE, filed)) <= 30) WHERE k <= 10""")
def join_interval_nearest(d: Domain) -> DataFrame:
    """Deals with at most ten filings of the same company within 30 days, nearest first.

    Both sides are cut into 31-day buckets; a deal, of which there are fewer, goes to its own and both neighbouring
    buckets, so the join is on company and bucket and a busy company is spread over time.
    """
    width = 31
    filings = d.t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event_id"), F.col("l_suppkey").alias("company"), F.to_date("l_shipdate").alias("filed"))
    filings = filings.withColumn("bucket", F.floor(F.unix_date("filed") / width))
    deals = d.deals().select("deal_id", (F.col("principal_id") % 100 + 1).alias("company"), F.to_date("date_start").alias("day"))
    deals = deals.withColumn("bucket", F.explode(F.array(*[F.floor(F.unix_date("day") / width) + k for k in (-1, 0, 1)])))
    near = deals.join(filings, ["company", "bucket"]).withColumn("days", F.abs(F.datediff("day", "filed")).cast("long")).where(F.col("days") <= 30)
    best = first_per_key(near, ["deal_id"], [F.col("days"), F.col("filed"), F.col("event_id")], 10)
    return best.select("deal_id", "event_id", "days", F.round(F.greatest(F.lit(0.3), 1 - 0.5 * F.col("days") / 30), 4).alias("confidence"))


@query("""SELECT e.event_id, p.event_id AS purchase_id, p.value FROM events e ASOF JOIN (SELECT * FROM events WHERE event_type = 'purchase') p
ON e.user_id = p.user_id AND e.ts >= p.ts WHERE e.event_type = 'error'""")
def join_as_of(d: Domain) -> DataFrame:
    """The latest purchase at or before each error of a user: one sort by user and time for both sides."""
    e = d.t("events").where(F.col("event_type").isin("error", "purchase"))
    last = W.partitionBy("user_id").orderBy("ts").rangeBetween(W.unboundedPreceding, W.currentRow)
    bought = F.when(F.col("event_type") == "purchase", F.struct("event_id", "value"))
    seen = e.withColumn("p", F.last(bought, ignorenulls=True).over(last))
    return seen.where((F.col("event_type") == "error") & F.col("p").isNotNull()).select("event_id", F.col("p.event_id").alias("purchase_id"), F.col("p.value").alias("value"))


@query("""SELECT c.company_id, t.deal_id, t.total_value FROM companies c, LATERAL (
  SELECT deal_id, total_value FROM deals WHERE principal_id = c.company_id ORDER BY total_value DESC NULLS LAST, deal_id LIMIT 2) t""")
def join_lateral_top(d: Domain) -> DataFrame:
    best = first_per_key(d.deals().select("principal_id", "deal_id", "total_value"), ["principal_id"], [F.col("total_value").desc_nulls_last(), F.col("deal_id")], 2)
    return d.companies().join(best, F.col("company_id") == F.col("principal_id")).select("company_id", "deal_id", "total_value")


PATTERNS = (("holds_the", "(^|[^A-Za-z])the([^A-Za-z]|$)"), ("holds_number", "[0-9]+"), ("holds_und", "(^|[^A-Za-z])und([^A-Za-z]|$)"))


@query("SELECT doc_id, kind FROM documents, (VALUES " + ", ".join(f"('{k}', '{p}')" for k, p in PATTERNS) + ") t(kind, pattern) WHERE regexp_matches(text, pattern)")
def join_patterns(d: Domain) -> DataFrame:
    """Every document by a fixed list of patterns: one pass over the texts, no join."""
    hits = F.filter(F.array(*[F.when(F.col("text").rlike(p), F.lit(k)) for k, p in PATTERNS]), lambda k: k.isNotNull())
    return d.t("documents").select("doc_id", F.explode(hits).alias("kind"))


@query("""SELECT lpad(company_id::VARCHAR, 10, '0') AS filer, c.name, p.partner FROM companies c JOIN partners p ON ltrim(lpad(c.company_id::VARCHAR, 10, '0'), '0') = p.partner_id::VARCHAR""")
def join_normalised_key(d: Domain) -> DataFrame:
    left = d.companies().select(F.lpad(F.col("company_id").cast("string"), 10, "0").alias("filer"), "name")
    right = d.partners().select(F.col("partner_id").cast("string").alias("_k"), "partner")
    return left.join(right, F.ltrim("filer", F.lit("0")) == F.col("_k")).select("filer", "name", "partner")


# --- aggregations ------------------------------------------------------------------------------------------


@query("""SELECT area, count(*) AS n, count(total_value) AS known, round(sum(total_value), 2) AS total, round(avg(total_value), 4) AS mean, min(total_value) AS low, max(total_value) AS high FROM deal_areas GROUP BY 1""")
def agg_basic(d: Domain) -> DataFrame:
    v = F.col("total_value")
    return d.deal_areas().groupBy("area").agg(F.count(F.lit(1)).alias("n"), F.count(v).alias("known"), F.round(F.sum(v), 2).alias("total"), F.round(F.avg(v), 4).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"))


@query("""SELECT company_type, count(DISTINCT nation) AS nations, count(DISTINCT (nation, status)) AS pairs FROM deal_areas GROUP BY 1""")
def agg_distinct(d: Domain) -> DataFrame:
    return d.deal_areas().groupBy("company_type").agg(F.countDistinct("nation").alias("nations"), F.countDistinct(F.struct("nation", "status")).alias("pairs"))


@query("""SELECT category, count(*) FILTER (WHERE status = 'F') AS closed, round(sum(total_value) FILTER (WHERE status <> 'F'), 2) AS open_value,
 count(DISTINCT principal_id) FILTER (WHERE total_value > 200000) AS big, sum(CASE WHEN status = 'P' THEN 1 ELSE 0 END)::BIGINT AS pending FROM deals GROUP BY 1 HAVING count(*) > 10""")
def agg_filtered(d: Domain) -> DataFrame:
    return d.deals().groupBy("category").agg(
        F.count_if(F.col("status") == "F").alias("closed"), F.round(F.sum(F.when(F.col("status") != "F", F.col("total_value"))), 2).alias("open_value"),
        F.countDistinct(F.when(F.col("total_value") > 200000, F.col("principal_id"))).alias("big"),
        F.sum(F.when(F.col("status") == "P", 1).otherwise(0)).alias("pending"), F.count(F.lit(1)).alias("_n"),
    ).where(F.col("_n") > 10).drop("_n")


@query("""SELECT status, round(quantile_cont(o_totalprice, 0.25), 4) AS p25, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.75), 4) AS p75,
 round(quantile_cont(o_totalprice, 0.95), 4) AS p95, round(quantile_cont(o_totalprice, 0.99), 4) AS p99 FROM (SELECT o_orderstatus AS status, o_totalprice FROM orders) GROUP BY 1""")
def agg_percentiles(d: Domain) -> DataFrame:
    """Exact, by ranks over ranges of values: a status may hold any number of orders."""
    rows = d.t("orders").select(F.col("o_orderstatus").alias("status"), "o_totalprice")
    return quantiles(rows, ["status"], "o_totalprice", {f"p{int(q * 100)}": q for q in (0.25, 0.5, 0.75, 0.95, 0.99)}, lambda c: F.round(c, 4))


@query("""SELECT principal_id, array_to_string((list_sort(list(DISTINCT category)))[1:3], ',') AS categories, string_agg(DISTINCT status, '; ' ORDER BY status) AS statuses FROM deals GROUP BY 1""")
def agg_arrays(d: Domain) -> DataFrame:
    return d.deals().groupBy("principal_id").agg(
        F.array_join(F.slice(F.sort_array(F.collect_set("category")), 1, 3), ",").alias("categories"), F.array_join(F.sort_array(F.collect_set("status")), "; ").alias("statuses")
    )


@query("""SELECT principal_id, to_json(list({'id': deal_id, 'status': status} ORDER BY deal_id)) AS deals FROM deals GROUP BY 1""")
def agg_json(d: Domain) -> DataFrame:
    items = F.sort_array(F.collect_list(F.struct(F.col("deal_id").alias("id"), "status")))
    return d.deals().groupBy("principal_id").agg(F.to_json(items).cast("string").alias("deals"))


@query("""SELECT DISTINCT ON (nation) nation, category AS mode, n FROM (SELECT nation, category, count(*) AS n FROM deal_areas GROUP BY ALL) ORDER BY nation, n DESC, category""")
def agg_mode(d: Domain) -> DataFrame:
    counts = d.deal_areas().groupBy("nation", "category").agg(F.count(F.lit(1)).alias("n"))
    return first_per_key(counts, ["nation"], [F.desc("n"), F.col("category")]).select("nation", F.col("category").alias("mode"), "n")


@query("""WITH per AS (SELECT l_orderkey, max(l_extendedprice) AS best FROM lineitem GROUP BY 1)
SELECT o_orderstatus AS status, count(*) AS eligible, count(best) AS with_terms, round(quantile_cont(best, 0.5), 4) AS median FROM orders LEFT JOIN per ON l_orderkey = o_orderkey GROUP BY 1""")
def agg_two_levels(d: Domain) -> DataFrame:
    per = d.t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_extendedprice").alias("best"))
    both = d.t("orders").join(per, "o_orderkey", "left").select(F.col("o_orderstatus").alias("status"), "best")
    counts = both.groupBy("status").agg(F.count(F.lit(1)).alias("eligible"), F.count("best").alias("with_terms"))
    return counts.join(quantiles(both, ["status"], "best", {"median": 0.5}, lambda c: F.round(c, 4)), "status", "left")


@query("""SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) FILTER (WHERE l_tax > 0) <= 1 THEN max(l_extendedprice) END AS top FROM lineitem GROUP BY 1""")
def agg_single_currency(d: Domain) -> DataFrame:
    one = F.countDistinct(F.when(F.col("l_tax") > 0, F.col("l_returnflag"))) <= 1
    return d.t("lineitem").groupBy("l_orderkey").agg(F.when(one, F.max("l_extendedprice")).alias("top"))


@query("""WITH s AS (SELECT status, list_sort(list(total_value)) AS v FROM deals WHERE total_value IS NOT NULL GROUP BY 1)
SELECT status, len(v) AS n, round(list_avg(v), 1) AS mean, CASE WHEN len(v) >= 4 THEN v[len(v) // 4 + 1] ELSE v[1] END AS q1, CASE WHEN len(v) >= 4 THEN v[3 * len(v) // 4 + 1] ELSE v[len(v)] END AS q3 FROM s""")
def agg_rank_quartiles(d: Domain) -> DataFrame:
    """Quartiles by position (n // 4), not interpolated."""
    known = d.deals().where(F.col("total_value").isNotNull()).select("status", "total_value")
    small = F.col("n") < 4
    return ranked(known, ["status"], "total_value").groupBy("status", "n").agg(
        F.round(F.sum(F.col("total_value") * F.col("count")) / F.max("n"), 1).alias("mean"),
        at_rank("total_value", F.when(small, 1).otherwise(F.floor(F.col("n") / 4) + 1)).alias("q1"), at_rank("total_value", F.when(small, F.col("n")).otherwise(F.floor(3 * F.col("n") / 4) + 1)).alias("q3"),
    )


@query("""SELECT user_id, bool_or(coalesce(value > 90, false)) AS ever_slow, bool_and(event_type <> 'error') AS never_failed FROM events GROUP BY 1""")
def agg_bool(d: Domain) -> DataFrame:
    return d.t("events").groupBy("user_id").agg(F.bool_or(F.coalesce(F.col("value") > 90, F.lit(False))).alias("ever_slow"), F.bool_and(F.col("event_type") != "error").alias("never_failed"))


@query("""SELECT c_nationkey, c_mktsegment, count(DISTINCT c_custkey) AS ids FROM customer GROUP BY ALL HAVING count(DISTINCT c_custkey) > 1""")
def agg_ambiguous_keys(d: Domain) -> DataFrame:
    return d.t("customer").groupBy("c_nationkey", "c_mktsegment").agg(F.countDistinct("c_custkey").alias("ids")).where(F.col("ids") > 1)


@query("""SELECT nation, count(*) FILTER (WHERE year(date_start) = 1996) AS y1996, count(*) FILTER (WHERE year(date_start) = 1998) AS y1998, count(*) FILTER (WHERE year(date_start) = 2000) AS y2000 FROM deal_areas GROUP BY 1""")
def agg_pivot(d: Domain) -> DataFrame:
    wide = d.deal_areas().withColumn("_y", F.year("date_start")).groupBy("nation").pivot("_y", [1996, 1998, 2000])
    counted = wide.agg(F.count(F.lit(1)))
    return counted.select("nation", *[F.coalesce(F.col(f"`{y}`"), F.lit(0)).alias(f"y{y}") for y in (1996, 1998, 2000)])


# --- windows -----------------------------------------------------------------------------------------------


@query("""SELECT event_id, user_id, was, event_type FROM (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id) AS was FROM events)
WHERE was IS NOT NULL AND was IS DISTINCT FROM event_type""")
def window_transitions(d: Domain) -> DataFrame:
    was = F.lag("event_type").over(W.partitionBy("user_id").orderBy(F.col("ts").asc_nulls_first(), "event_id"))
    return d.t("events").select("event_id", "user_id", was.alias("was"), "event_type").where(F.col("was").isNotNull() & ~F.col("was").eqNullSafe(F.col("event_type")))


@query("""SELECT principal_id, deal_id, date_start::DATE AS day FROM deals QUALIFY row_number() OVER (PARTITION BY principal_id ORDER BY date_start DESC NULLS LAST, deal_id) <= 5""")
def window_recent_five(d: Domain) -> DataFrame:
    rows = d.deals().select("principal_id", "deal_id", "date_start")
    return first_per_key(rows, ["principal_id"], [F.col("date_start").desc_nulls_last(), F.col("deal_id")], 5).select("principal_id", "deal_id", F.to_date("date_start").alias("day"))


@query("""SELECT nation, status, deal_id FROM deal_areas QUALIFY row_number() OVER (PARTITION BY nation, status ORDER BY md5(deal_id || ':' || status), deal_id) <= 3""")
def window_stratified_sample(d: Domain) -> DataFrame:
    draw = F.md5(F.concat_ws(":", F.col("deal_id").cast("string"), "status").cast("binary"))
    rows = d.deal_areas().select("nation", "status", "deal_id", draw.alias("draw"))
    return first_per_key(rows, ["nation", "status"], [F.col("draw"), F.col("deal_id")], 3).drop("draw")


@query("""SELECT area, count(DISTINCT principal_id) AS firms, round(100 * count(DISTINCT principal_id) / sum(count(DISTINCT principal_id)) OVER (), 2) AS share FROM deal_areas GROUP BY 1""")
def window_share(d: Domain) -> DataFrame:
    by = d.deal_areas().groupBy("area").agg(F.countDistinct("principal_id").alias("firms"))
    total = by.agg(F.sum("firms").alias("_all"))
    return by.crossJoin(total).select("area", "firms", F.round(100 * F.col("firms") / F.col("_all"), 2).alias("share"))


@query("""SELECT deal_id, total_value, (SELECT count(*) FROM deals WHERE total_value > 450000) AS total_rows FROM deals WHERE total_value > 450000 ORDER BY total_value DESC, deal_id LIMIT 20""")
def window_total_rows(d: Domain) -> DataFrame:
    hits = d.deals().where(F.col("total_value") > 450000).select("deal_id", "total_value")
    return hits.orderBy(F.desc("total_value"), "deal_id").limit(20).crossJoin(hits.agg(F.count(F.lit(1)).alias("total_rows")))


# --- pages, sets -------------------------------------------------------------------------------------------


@query("""SELECT deal_id, status, (SELECT count(*) FROM deals WHERE deal_id > 1000) > 50 AS has_more FROM deals WHERE deal_id > 1000 ORDER BY deal_id LIMIT 50""")
def page_keyset(d: Domain) -> DataFrame:
    return keyset_page(d.deals().select("deal_id", "status"), "deal_id", 1000, 50)


@query("""SELECT deal_id, total_value FROM deals ORDER BY total_value DESC NULLS LAST, deal_id LIMIT 25 OFFSET 25""")
def page_cursor(d: Domain) -> DataFrame:
    """The second page: the cursor holds the place of the first page's last row."""
    keys, request = [("total_value", False)], "deals:by-value"
    rows = d.deals().select("deal_id", "total_value")
    last = rows.orderBy(*ordered(keys, "deal_id")).limit(25).orderBy(F.col("total_value").asc_nulls_first(), F.desc("deal_id")).limit(1).collect()
    if not last:
        return rows.limit(0)
    values, row_id = Cursor.decode(Cursor.encode(request, [last[0]["total_value"]], last[0]["deal_id"]), request)
    return rows.where(after(keys, values, "deal_id", row_id)).orderBy(*ordered(keys, "deal_id")).limit(25)


@query("""SELECT deal_id, date_start FROM deals ORDER BY date_start DESC, deal_id LIMIT 20 OFFSET 40""")
def page_offset(d: Domain) -> DataFrame:
    return d.deals().select("deal_id", "date_start").orderBy(F.desc("date_start"), "deal_id").offset(40).limit(20)


@query("""WITH a AS (SELECT 0 AS source, company_id AS id, row_number() OVER (ORDER BY company_id % 97 DESC, company_id) AS turn FROM companies),
b AS (SELECT 1, partner_id, row_number() OVER (ORDER BY partner_id % 7 DESC, partner_id) FROM partners)
SELECT source, id, turn::INT AS turn FROM (FROM a UNION ALL FROM b) ORDER BY turn, source LIMIT 40""")
def rank_interleave(d: Domain) -> DataFrame:
    a = d.companies().select(F.col("company_id").alias("id"), (F.col("company_id") % 97).alias("score"))
    b = d.partners().select(F.col("partner_id").alias("id"), (F.col("partner_id") % 7).alias("score"))
    top = lambda df: df.orderBy(F.desc("score"), "id").limit(40)  # noqa: E731  no source gives more than the limit
    return interleave([top(a), top(b)], 40)


@query("""SELECT 'missing' AS side, count(*) AS n FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem) UNION ALL
SELECT 'extra', count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders) UNION ALL
SELECT 'common', count(*) FROM (SELECT o_orderkey FROM orders INTERSECT SELECT l_orderkey FROM lineitem)""")
def set_coverage(d: Domain) -> DataFrame:
    a, b = d.t("orders").select(F.col("o_orderkey").alias("id")), d.t("lineitem").select(F.col("l_orderkey").alias("id")).distinct()
    both = a.select("id", F.lit(1).alias("a")).join(b.select("id", F.lit(1).alias("b")), "id", "full")
    counts = both.agg(F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("a").isNull()).alias("extra"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("common"))
    return counts.select(F.expr("stack(3, 'missing', missing, 'extra', extra, 'common', common) AS (side, n)"))


@query("""SELECT DISTINCT deal_id, CASE WHEN company = 'C2' THEN 'C1' ELSE company END AS company, role FROM deal_roles""")
def merge_entities(d: Domain) -> DataFrame:
    """Company C2 merged into C1: its links move over, links that are then double fall together."""
    return d.deal_roles().withColumn("company", F.when(F.col("company") == "C2", "C1").otherwise(F.col("company"))).distinct()


@query("""SELECT company_id, CASE WHEN company_id % 3 = 0 THEN upper(company_type) ELSE company_type END AS company_type, false AS is_new FROM companies
UNION ALL SELECT company_id + 1000000000, company_type, true FROM companies WHERE company_id % 50 = 0""")
def upsert_companies(d: Domain) -> DataFrame:
    """Rows updated on their key, rows of new keys inserted, others kept."""
    old = d.companies().select("company_id", "company_type")
    changed = old.where(F.col("company_id") % 3 == 0).withColumn("company_type", F.upper("company_type"))
    new = old.where(F.col("company_id") % 50 == 0).withColumn("company_id", F.col("company_id") + 1000000000)
    return upsert(old, changed.unionByName(new), "company_id")


def upsert(old: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """One full join on the key; fresh values win; ``is_new`` tells inserted rows."""
    cols = [c for c in old.columns if c != key]
    right = fresh.select(F.col(key).alias("_k"), F.lit(True).alias("_new"), *[F.col(c).alias(f"_n_{c}") for c in cols])
    both = old.join(right, F.col(key) == F.col("_k"), "full")
    pick = [F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in cols]
    return both.select(F.coalesce(key, "_k").alias(key), *pick, F.col(key).isNull().alias("is_new"))


@query("""SELECT area, years, deal_count FROM (SELECT area, array_to_string(list_sort(list(DISTINCT year(date_start)::INT)), ',') AS years, count(*) AS deal_count FROM deal_areas, as_of WHERE date_start >= today - INTERVAL 4 YEAR GROUP BY 1)""")
def array_years(d: Domain) -> DataFrame:
    return d.deal_areas().where(since(4)).groupBy("area").agg(F.array_join(F.transform(F.sort_array(F.collect_set(F.year("date_start"))), lambda y: y.cast("string")), ",").alias("years"), F.count(F.lit(1)).alias("deal_count"))


@query("""SELECT deal_id, date_diff('day', date_start::DATE, today::DATE) AS age_days, date_trunc('year', date_start)::DATE AS year_start, (date_start + INTERVAL 1 MONTH)::DATE AS next_month,
 quarter(date_start)::INT AS q FROM deals, as_of WHERE date_start >= today - INTERVAL 1 YEAR""")
def date_functions(d: Domain) -> DataFrame:
    return d.deals().where(since(1)).select(
        "deal_id", F.datediff(F.to_date(today()), F.to_date("date_start")).cast("long").alias("age_days"), F.to_date(F.trunc("date_start", "year")).alias("year_start"),
        F.to_date(F.add_months(F.to_date("date_start"), 1)).alias("next_month"), F.quarter("date_start").alias("q"),
    )


