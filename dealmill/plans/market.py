"""Market analytics over deals: trends, valuations, rankings, distributions, growth, dashboard."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dealmill.domain import AS_OF, Domain, with_domain
from dealmill.operators.quantiles import described
from dealmill.operators.topk import first_per_key

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a plan under its function's name, with its oracle."""

    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir, f=f: f(Domain(spark, sf_dir))
        if sql:
            SQL[f.__name__] = with_domain(sql)
        return f

    return put


def today() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def since(years: int) -> Column:
    return F.col("date_start") >= today() - F.expr(f"INTERVAL {years} YEAR")


def n_of(col: str = "deal_id") -> Column:
    return F.count(col).cast("long")


def values() -> list[Column]:
    """Counts and money of a group; undisclosed deals are counted beside it."""
    v = F.col("total_value")
    return [F.count(F.lit(1)).alias("deal_count"), F.count(v).alias("disclosed_count"), F.round(F.sum(v), 2).alias("sum_value"), F.round(F.avg(v), 4).alias("avg_value")]


def with_quartiles(deals: DataFrame, *keys: str) -> DataFrame:
    """values() of groups, with extremes and interpolated quartiles of the disclosed values; a group may hold any number of deals."""
    rows = described(deals, keys, "total_value", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, lambda c: F.round(c, 4))
    return rows.select(
        *keys, F.col("rows").alias("deal_count"), F.col("known").alias("disclosed_count"), F.round("total", 2).alias("sum_value"), F.round("mean", 4).alias("avg_value"),
        F.col("least").alias("min_value"), F.col("most").alias("max_value"), "p25", "p50", "p75",
    )


VALUES_SQL = "count(*) AS deal_count, count(total_value) AS disclosed_count, round(sum(total_value), 2) AS sum_value, round(avg(total_value), 4) AS avg_value"
QUARTILES_SQL = "round(quantile_cont(total_value, 0.25), 4) AS p25, round(quantile_cont(total_value, 0.5), 4) AS p50, round(quantile_cont(total_value, 0.75), 4) AS p75"


@query(f"SELECT year(date_start)::INT AS year, {VALUES_SQL} FROM deals, as_of WHERE date_start >= today - INTERVAL 10 YEAR GROUP BY 1")
def market_trends_year(d: Domain) -> DataFrame:
    return d.deals().where(since(10)).groupBy(F.year("date_start").alias("year")).agg(*values()).orderBy(F.desc("year"))


@query(f"""SELECT year(date_start) || '-Q' || quarter(date_start) AS period, {VALUES_SQL}
FROM deal_areas, as_of WHERE date_start >= today - INTERVAL 5 YEAR AND area ILIKE '%europe%' GROUP BY 1""")
def market_trends_quarter_area(d: Domain) -> DataFrame:
    period = F.concat(F.year("date_start"), F.lit("-Q"), F.quarter("date_start"))
    return d.deal_areas().where(since(5) & F.col("area").ilike("%europe%")).groupBy(period.alias("period")).agg(*values())


@query(f"""WITH first_stage AS (
  SELECT DISTINCT ON (l_orderkey) l_orderkey AS deal_id, split_part(p_type, ' ', 1) AS phase FROM lineitem JOIN part ON p_partkey = l_partkey
  ORDER BY l_orderkey, l_shipdate, l_linenumber, p_partkey)
SELECT phase, {VALUES_SQL}, min(total_value) AS min_value, max(total_value) AS max_value, {QUARTILES_SQL}
FROM deals JOIN first_stage USING (deal_id), as_of WHERE date_start >= today - INTERVAL 10 YEAR GROUP BY phase""")
def valuations_by_phase(d: Domain) -> DataFrame:
    stages = d.t("lineitem").join(d.t("part"), F.col("l_partkey") == F.col("p_partkey"))
    first = first_per_key(stages.select("l_orderkey", "l_shipdate", "l_linenumber", "p_partkey", "p_type"), ["l_orderkey"], [F.col("l_shipdate").asc_nulls_last(), F.col("l_linenumber"), F.col("p_partkey")])
    first = first.select(F.col("l_orderkey").alias("deal_id"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("phase"))
    return d.deals().where(since(10)).join(first, "deal_id").transform(with_quartiles, "phase")


@query(f"""SELECT p_brand AS indication, {VALUES_SQL}, {QUARTILES_SQL} FROM (
  SELECT DISTINCT deal_id, p_brand, total_value FROM deals JOIN deal_assets USING (deal_id) JOIN part ON p_partkey = asset_id, as_of WHERE date_start >= today - INTERVAL 10 YEAR)
GROUP BY 1 HAVING count(total_value) >= 5 ORDER BY avg_value DESC NULLS LAST, indication LIMIT 20""")
def valuations_by_indication(d: Domain) -> DataFrame:
    bridge = d.deal_assets().join(d.t("part").select(F.col("p_partkey").alias("asset_id"), F.col("p_brand").alias("indication")), "asset_id").select("deal_id", "indication").distinct()
    return (
        d.deals().where(since(10)).join(bridge, "deal_id").transform(with_quartiles, "indication").drop("min_value", "max_value")
        .where(F.col("disclosed_count") >= 5).orderBy(F.desc_nulls_last("avg_value"), "indication").limit(20)
    )


@query(f"SELECT coalesce(nullif(agreement_type, ''), 'Unknown') AS deal_type, {VALUES_SQL}, {QUARTILES_SQL} FROM deals GROUP BY 1")
def valuations_by_type(d: Domain) -> DataFrame:
    return d.deals().withColumn("deal_type", F.coalesce(F.nullif("agreement_type", F.lit("")), F.lit("Unknown"))).transform(with_quartiles, "deal_type").drop("min_value", "max_value")


@query("""SELECT d.deal_id, d.total_value, d.date_start, c.name AS principal, (
  SELECT min(partner) FROM deal_partners b JOIN partners p ON p.partner_id = b.partner_id WHERE b.deal_id = d.deal_id) AS partner
FROM deals d JOIN companies c ON c.company_id = d.principal_id, as_of WHERE total_value IS NOT NULL AND date_start >= today - INTERVAL 5 YEAR
ORDER BY total_value DESC, d.deal_id LIMIT 20""")
def top_deals(d: Domain) -> DataFrame:
    best = d.deals().where(since(5) & F.col("total_value").isNotNull()).orderBy(F.desc("total_value"), "deal_id").limit(20)
    named = d.deal_partners().join(best.select("deal_id"), "deal_id").join(d.partners(), "partner_id").groupBy("deal_id").agg(F.min("partner").alias("partner"))
    principals = d.companies().select(F.col("company_id").alias("principal_id"), F.col("name").alias("principal"))
    return best.join(principals, "principal_id").join(named, "deal_id", "left").select("deal_id", "total_value", "date_start", "principal", "partner")


@query("""SELECT partner_id, partner, count(DISTINCT deal_id) AS deal_count, round(sum(total_value), 2) AS sum_value, max(date_start) AS last_deal
FROM deals JOIN deal_partners USING (deal_id) JOIN partners USING (partner_id), as_of WHERE date_start >= today - INTERVAL 3 YEAR
GROUP BY ALL ORDER BY deal_count DESC, partner_id LIMIT 25""")
def top_acquirers(d: Domain) -> DataFrame:
    by = d.deals().where(since(3)).join(d.deal_partners(), "deal_id").groupBy("partner_id")
    best = by.agg(F.countDistinct("deal_id").alias("deal_count"), F.round(F.sum("total_value"), 2).alias("sum_value"), F.max("date_start").alias("last_deal"))
    return best.orderBy(F.desc("deal_count"), "partner_id").limit(25).join(d.partners().select("partner_id", "partner"), "partner_id")


@query("""SELECT count(*) AS deals, count(total_value) AS disclosed, round(100 * count(total_value) / count(*), 1) AS disclosed_rate,
  count(*) FILTER (WHERE status = 'F') AS closed, count(*) FILTER (WHERE date_start >= today - INTERVAL 1 YEAR) AS last_year, count(DISTINCT principal_id) AS principals,
  (SELECT count(*) FROM companies) AS companies, (SELECT count(*) FROM partners) AS all_partners, (SELECT count(*) FROM part) AS assets FROM deals, as_of""")
def deal_activity_summary(d: Domain) -> DataFrame:
    own = d.deals().agg(
        F.count(F.lit(1)).alias("deals"), F.count("total_value").alias("disclosed"), F.round(100 * F.count("total_value") / F.count(F.lit(1)), 1).alias("disclosed_rate"),
        F.count_if(F.col("status") == "F").alias("closed"), F.count_if(since(1)).alias("last_year"), F.countDistinct("principal_id").alias("principals"),
    )
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return own.crossJoin(one(d.companies(), "companies")).crossJoin(one(d.partners(), "all_partners")).crossJoin(one(d.t("part"), "assets"))


@query(f"SELECT nation, area, {VALUES_SQL} FROM deal_areas, as_of WHERE date_start >= today - INTERVAL 5 YEAR GROUP BY ALL ORDER BY deal_count DESC, nation LIMIT 30")
def geographic_distribution(d: Domain) -> DataFrame:
    return d.deal_areas().where(since(5)).groupBy("nation", "area").agg(*values()).orderBy(F.desc("deal_count"), "nation").limit(30)


@query("""SELECT category, agreement_type, count(*) AS deal_count, sum(count(*)) OVER (PARTITION BY category)::BIGINT AS category_count,
  round(100 * count(*) / sum(count(*)) OVER (), 2) AS share FROM deals, as_of WHERE date_start >= today - INTERVAL 5 YEAR GROUP BY category, agreement_type""")
def agreement_distribution(d: Domain) -> DataFrame:
    by_type = d.deals().where(since(5)).groupBy("category", "agreement_type").agg(F.count(F.lit(1)).alias("deal_count"))
    total = by_type.agg(F.sum("deal_count").alias("_all"))
    return by_type.crossJoin(total).select(
        "category", "agreement_type", "deal_count", F.sum("deal_count").over(W.partitionBy("category")).alias("category_count"), F.round(100 * F.col("deal_count") / F.col("_all"), 2).alias("share")
    )


@query("""SELECT CASE status WHEN 'O' THEN 1 WHEN 'P' THEN 2 WHEN 'F' THEN 3 ELSE 4 END AS stage, status, year(date_start)::INT AS year, count(*) AS deal_count
FROM deals, as_of WHERE date_start >= today - INTERVAL 5 YEAR GROUP BY ALL""")
def deal_status_funnel(d: Domain) -> DataFrame:
    stage = F.when(F.col("status") == "O", 1).when(F.col("status") == "P", 2).when(F.col("status") == "F", 3).otherwise(4)
    return d.deals().where(since(5)).groupBy(stage.alias("stage"), "status", F.year("date_start").alias("year")).agg(F.count(F.lit(1)).alias("deal_count")).orderBy("stage", "year")


@query("""WITH recent AS (SELECT nation AS area, year(date_start)::INT AS year FROM deal_areas, as_of WHERE date_start >= today - INTERVAL 10 YEAR),
top AS (SELECT area, count(*) AS total FROM recent GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15)
SELECT area, y.year, count(r.area) AS deal_count, total FROM top CROSS JOIN (SELECT DISTINCT year FROM recent) y LEFT JOIN recent r USING (area, year) GROUP BY area, y.year, total""")
def therapy_area_heatmap(d: Domain) -> DataFrame:
    cells = d.deal_areas().where(since(10)).groupBy(F.col("nation").alias("area"), F.year("date_start").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    top = cells.groupBy("area").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "area").limit(15)
    grid = top.crossJoin(cells.select("year").distinct())  # at most 15 areas by the years of the window
    return grid.join(cells, ["area", "year"], "left").select("area", "year", F.coalesce("n", F.lit(0)).alias("deal_count"), "total")


@query("""WITH y AS (SELECT year(date_start)::INT AS year, count(*) AS deal_count,
    count(*) FILTER (WHERE dayofyear(date_start) <= dayofyear(today)) AS to_date, round(sum(total_value), 2) AS sum_value FROM deals, as_of GROUP BY ALL)
SELECT year, deal_count, sum_value, CASE WHEN year = 2001 THEN lag(to_date) OVER w ELSE lag(deal_count) OVER w END AS compared,
  round(100 * (deal_count - CASE WHEN year = 2001 THEN lag(to_date) OVER w ELSE lag(deal_count) OVER w END)
    / nullif(CASE WHEN year = 2001 THEN lag(to_date) OVER w ELSE lag(deal_count) OVER w END, 0), 1) AS growth FROM y WINDOW w AS (ORDER BY year)""")
def yoy_growth(d: Domain) -> DataFrame:
    year = F.year("date_start")
    by = d.deals().groupBy(year.alias("year")).agg(
        F.count(F.lit(1)).alias("deal_count"), F.count_if(F.dayofyear("date_start") <= F.dayofyear(today())).alias("to_date"), F.round(F.sum("total_value"), 2).alias("sum_value")
    )
    w = W.orderBy("year")  # one row a year
    prior = F.when(F.col("year") == int(AS_OF[:4]), F.lag("to_date").over(w)).otherwise(F.lag("deal_count").over(w))
    return by.withColumn("compared", prior).select(
        "year", "deal_count", "sum_value", "compared", F.round(100 * (F.col("deal_count") - F.col("compared")) / F.nullif("compared", F.lit(0)), 1).alias("growth")
    )


@query("""SELECT count(*) FILTER (WHERE date_start >= today - INTERVAL 30 DAY) AS last_30, count(*) FILTER (WHERE date_start >= today - INTERVAL 60 DAY AND date_start < today - INTERVAL 30 DAY) AS before_30,
  round(avg(total_value) FILTER (WHERE date_start >= today - INTERVAL 30 DAY), 4) AS avg_30, count(*) FILTER (WHERE total_value >= 400000 AND date_start >= today - INTERVAL 60 DAY) AS notable_60 FROM deals, as_of""")
def executive_dashboard(d: Domain) -> DataFrame:
    back = lambda days: F.col("date_start") >= today() - F.expr(f"INTERVAL {days} DAY")
    return d.deals().where(back(60)).agg(
        F.count_if(back(30)).alias("last_30"), F.count_if(~back(30)).alias("before_30"), F.round(F.avg(F.when(back(30), F.col("total_value"))), 4).alias("avg_30"),
        F.count_if(F.col("total_value") >= 400000).alias("notable_60"),
    )


@query("""SELECT date_trunc('month', date_start)::TIMESTAMP AS month, count(*) AS deal_count, round(sum(total_value), 2) AS sum_value
FROM deals, as_of WHERE date_start >= date_trunc('month', today) - INTERVAL 12 MONTH GROUP BY 1""")
def monthly_trend(d: Domain) -> DataFrame:
    month = F.date_trunc("month", "date_start").cast("timestamp_ntz")
    recent = F.col("date_start") >= F.date_trunc("month", today()).cast("timestamp_ntz") - F.expr("INTERVAL 12 MONTH")
    return d.deals().where(recent).groupBy(month.alias("month")).agg(F.count(F.lit(1)).alias("deal_count"), F.round(F.sum("total_value"), 2).alias("sum_value"))


@query("""SELECT principal_id AS company_id, category, count(*) AS deal_count, count(DISTINCT year(date_start)) AS years, round(sum(total_value), 2) AS sum_value
FROM deals WHERE principal_id IN (1, 2, 4, 5, 7) GROUP BY ALL""")
def company_comparison(d: Domain, ids: tuple[int, ...] = (1, 2, 4, 5, 7)) -> DataFrame:
    return d.deals().where(F.col("principal_id").isin(*ids)).groupBy(F.col("principal_id").alias("company_id"), "category").agg(
        F.count(F.lit(1)).alias("deal_count"), F.countDistinct(F.year("date_start")).alias("years"), F.round(F.sum("total_value"), 2).alias("sum_value")
    )


METRICS = (
    ("deal_count", "deals", "All deals of the window, whether or not a value is known"),
    ("disclosed_count", "deals", "Deals with a headline value in comparable money"),
    ("disclosed_rate", "percent", "disclosed_count of deal_count"),
    ("sum_value", "money", "Sum of disclosed headline values"),
    ("avg_value", "money", "Mean of disclosed headline values"),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in METRICS) + ") t(metric, unit, meaning)")
def metric_definitions(d: Domain) -> DataFrame:
    return d.spark.createDataFrame(METRICS, "metric string, unit string, meaning string")
