"""Reports: mergers, timelines, territories, calendars, coverage, health, digests, templates and browse lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dealmill.domain import Domain, with_domain
from dealmill.operators.quantiles import described
from dealmill.operators.topk import first_per_key, keyset_page
from dealmill.plans.market import VALUES_SQL, since, today, values

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir, f=f: f(Domain(spark, sf_dir))
        if sql:
            SQL[f.__name__] = with_domain(sql)
        return f

    return put


@query("""SELECT year(date_start)::INT AS year, count(*) AS deals, round(avg(100 * (day30 - day1) / nullif(day1, 0)), 4) AS premium, round(avg(total_value / nullif(revenue, 0)), 4) AS multiple FROM deals JOIN (
 SELECT l_orderkey AS deal_id, min(l_extendedprice) AS day1, max(l_extendedprice) AS day30, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem GROUP BY 1) m USING (deal_id) WHERE category IN ('1', '2') GROUP BY 1""")
def merger_analytics(d: Domain) -> DataFrame:
    """Premium of the highest over the lowest price and value over revenue; zero prices are skipped."""
    m = d.t("lineitem").groupBy(F.col("l_orderkey").alias("deal_id")).agg(
        F.min("l_extendedprice").alias("day1"), F.max("l_extendedprice").alias("day30"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue")
    )
    rows = d.deals().where(F.col("category").isin("1", "2")).join(m, "deal_id")
    return rows.groupBy(F.year("date_start").alias("year")).agg(
        F.count(F.lit(1)).alias("deals"), F.round(F.avg(F.try_divide(100 * (F.col("day30") - F.col("day1")), F.col("day1"))), 4).alias("premium"),
        F.round(F.avg(F.try_divide(F.col("total_value"), F.col("revenue"))), 4).alias("multiple"),
    )


@query("""SELECT deal_id, kind, strftime(happened, '%Y-%m-%d') AS day, detail FROM (
 SELECT deal_id, 'signed' AS kind, date_start AS happened, status AS detail FROM deals WHERE principal_id = 1
 UNION ALL SELECT l_orderkey, CASE l_returnflag WHEN 'R' THEN 'returned' WHEN 'A' THEN 'accepted' ELSE 'shipped' END, l_shipdate, l_linenumber::VARCHAR FROM lineitem WHERE l_orderkey IN (SELECT deal_id FROM deals WHERE principal_id = 1))""")
def evidence_timeline(d: Domain) -> DataFrame:
    mine = d.deals().where(F.col("principal_id") == 1)
    signed = mine.select("deal_id", F.lit("signed").alias("kind"), F.col("date_start").alias("at"), F.col("status").alias("detail"))
    kind = F.when(F.col("l_returnflag") == "R", "returned").when(F.col("l_returnflag") == "A", "accepted").otherwise("shipped")
    moved = d.t("lineitem").join(mine.select(F.col("deal_id").alias("l_orderkey")), "l_orderkey", "left_semi")
    moved = moved.select(F.col("l_orderkey").alias("deal_id"), kind.alias("kind"), F.col("l_shipdate").alias("at"), F.col("l_linenumber").cast("string").alias("detail"))
    return signed.unionByName(moved).select("deal_id", "kind", F.date_format("at", "yyyy-MM-dd").alias("day"), "detail").orderBy("day", "deal_id", "kind", "detail")


@query("""SELECT asset_id, nation, CASE WHEN bool_or(status = 'F') THEN 'granted' WHEN bool_or(status = 'P') THEN 'pending' ELSE 'open' END AS scope, count(DISTINCT deal_id) AS evidence FROM deal_areas JOIN deal_assets USING (deal_id) WHERE asset_id <= 50 GROUP BY ALL""")
def territory_map(d: Domain) -> DataFrame:
    rows = d.deal_areas().join(d.deal_assets().where(F.col("asset_id") <= 50), "deal_id")
    scope = F.when(F.bool_or(F.col("status") == "F"), "granted").when(F.bool_or(F.col("status") == "P"), "pending").otherwise("open")
    return rows.groupBy("asset_id", "nation").agg(scope.alias("scope"), F.countDistinct("deal_id").alias("evidence"))


@query("""SELECT deal_id, date_start::DATE::VARCHAR AS day, n_partners, names FROM deals JOIN (SELECT deal_id, count(*) AS n_partners, string_agg(partner, '; ' ORDER BY partner) AS names FROM deal_partners JOIN partners USING (partner_id) GROUP BY 1) USING (deal_id), as_of
 WHERE status IN ('O', 'P') AND date_start >= today - INTERVAL 60 DAY""")
def catalyst_calendar(d: Domain) -> DataFrame:
    near = d.deals().where(F.col("status").isin("O", "P") & (F.col("date_start") >= today() - F.expr("INTERVAL 60 DAY")))
    names = d.deal_partners().join(near.select("deal_id"), "deal_id", "left_semi").join(d.partners(), "partner_id").groupBy("deal_id").agg(
        F.count(F.lit(1)).alias("n_partners"), F.array_join(F.sort_array(F.collect_list("partner")), "; ").alias("names")
    )
    return near.join(names, "deal_id").select("deal_id", F.to_date("date_start").cast("string").alias("day"), "n_partners", "names")


@query("""SELECT strftime(date_trunc('month', date_start), '%Y-%m') AS month, count(*) AS events, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM deal_assets a WHERE a.deal_id = d.deal_id AND a.asset_id % 10 = 0)) AS with_lead_asset FROM deals d GROUP BY 1""")
def calendar_summary(d: Domain) -> DataFrame:
    lead = d.deal_assets().where(F.col("asset_id") % 10 == 0).select("deal_id").distinct().withColumn("lead", F.lit(True))
    rows = d.deals().join(lead, "deal_id", "left")
    return rows.groupBy(F.date_format("date_start", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("events"), F.count_if(F.coalesce("lead", F.lit(False))).alias("with_lead_asset"))


@query("""SELECT a.deal_id AS a, b.deal_id AS b, a.category = b.category AS same_category, a.status = b.status AS same_status, round(abs(a.total_value - b.total_value), 2) AS gap,
 (SELECT count(*) FROM deal_partners x JOIN deal_partners y USING (partner_id) WHERE x.deal_id = a.deal_id AND y.deal_id = b.deal_id) AS common_partners FROM deals a JOIN deals b ON a.principal_id = b.principal_id AND a.deal_id < b.deal_id WHERE a.principal_id <= 20""")
def term_comparison(d: Domain) -> DataFrame:
    mine = d.deals().where(F.col("principal_id") <= 20)
    partners = d.deal_partners().groupBy("deal_id").agg(F.collect_set("partner_id").alias("p"))
    a = mine.join(partners, "deal_id", "left").select("principal_id", F.col("deal_id").alias("a"), F.col("category").alias("ca"), F.col("status").alias("sa"), F.col("total_value").alias("va"), F.col("p").alias("pa"))
    b = mine.join(partners, "deal_id", "left").select("principal_id", F.col("deal_id").alias("b"), F.col("category").alias("cb"), F.col("status").alias("sb"), F.col("total_value").alias("vb"), F.col("p").alias("pb"))
    pairs = a.join(b, "principal_id").where(F.col("a") < F.col("b"))
    common = F.coalesce(F.size(F.array_intersect("pa", "pb")), F.lit(0)).cast("long")
    return pairs.select("a", "b", (F.col("ca") == F.col("cb")).alias("same_category"), (F.col("sa") == F.col("sb")).alias("same_status"), F.round(F.abs(F.col("va") - F.col("vb")), 2).alias("gap"), common.alias("common_partners"))


@query("""SELECT area, count(*) AS n, count(total_value) AS with_value, round(100 * count(total_value) / count(*), 1) AS value_coverage, count(DISTINCT principal_id) AS companies,
 count(*) FILTER (WHERE deal_id NOT IN (SELECT l_orderkey FROM lineitem)) AS without_assets FROM deal_areas GROUP BY 1""")
def coverage_rollup(d: Domain) -> DataFrame:
    has = d.t("lineitem").select(F.col("l_orderkey").alias("deal_id")).distinct().withColumn("has", F.lit(True))
    return d.deal_areas().join(has, "deal_id", "left").groupBy("area").agg(
        F.count(F.lit(1)).alias("n"), F.count("total_value").alias("with_value"), F.round(100 * F.count("total_value") / F.count(F.lit(1)), 1).alias("value_coverage"),
        F.countDistinct("principal_id").alias("companies"), F.count_if(F.col("has").isNull()).alias("without_assets"),
    )


@query("""SELECT round(0.4 * disclosed + 0.3 * linked + 0.3 * (100 - orphans), 2) AS score, disclosed, linked, orphans FROM (
 SELECT round(100 * count(total_value) / count(*), 2) AS disclosed, round(100 * count(*) FILTER (WHERE deal_id IN (SELECT l_orderkey FROM lineitem)) / count(*), 2) AS linked,
 round(100 * count(*) FILTER (WHERE principal_id NOT IN (SELECT company_id FROM companies)) / count(*), 2) AS orphans FROM deals)""")
def data_health(d: Domain) -> DataFrame:
    has = d.t("lineitem").select(F.col("l_orderkey").alias("deal_id")).distinct().withColumn("has", F.lit(True))
    known = d.companies().select(F.col("company_id").alias("principal_id"), F.lit(True).alias("known"))
    share = lambda c: F.round(100 * F.count_if(c) / F.count(F.lit(1)), 2)
    one = d.deals().join(has, "deal_id", "left").join(known, "principal_id", "left").agg(
        share(F.col("total_value").isNotNull()).alias("disclosed"), share(F.col("has").isNotNull()).alias("linked"), share(F.col("known").isNull()).alias("orphans")
    )
    return one.select(F.round(0.4 * F.col("disclosed") + 0.3 * F.col("linked") + 0.3 * (100 - F.col("orphans")), 2).alias("score"), "disclosed", "linked", "orphans")


@query("""SELECT c.company_id, d.deal_id, d.total_value, n.total AS matching FROM companies c JOIN (SELECT *, row_number() OVER (PARTITION BY principal_id ORDER BY total_value DESC NULLS LAST, deal_id) AS k FROM deals WHERE category IN ('1', '3')) d ON d.principal_id = c.company_id AND k <= 15
 JOIN (SELECT principal_id, count(*) AS total FROM deals WHERE category IN ('1', '3') GROUP BY 1) n ON n.principal_id = c.company_id""")
def user_digest(d: Domain) -> DataFrame:
    """Each user's wanted categories come as a JSON list; fifteen best deals and the exact count."""
    wanted = d.companies().select("company_id", F.explode(F.from_json(F.lit('["1", "3"]'), "array<string>")).alias("category"))
    hits = d.deals().withColumnRenamed("principal_id", "company_id").join(wanted, ["company_id", "category"], "left_semi")
    total = hits.groupBy("company_id").agg(F.count(F.lit(1)).alias("matching"))
    best = first_per_key(hits.select("company_id", "deal_id", "total_value"), ["company_id"], [F.col("total_value").desc_nulls_last(), F.col("deal_id")], 15)
    return best.join(total, "company_id")


@query("""SELECT p_brand AS area, count(DISTINCT deal_id) AS eligible, count(DISTINCT deal_id) FILTER (WHERE top IS NOT NULL) AS with_terms, round(median(top), 4) AS median_top FROM (
 SELECT p_brand, l_orderkey AS deal_id, max(l_extendedprice) FILTER (WHERE l_tax > 0.02) AS top FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL) GROUP BY 1""")
def milestone_benchmarks(d: Domain) -> DataFrame:
    """Largest milestone of each deal first, then the median over deals, beside how many were eligible."""
    parts = d.t("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("area"))
    per = d.t("lineitem").join(parts, "l_partkey").groupBy("area", F.col("l_orderkey").alias("deal_id")).agg(F.max(F.when(F.col("l_tax") > 0.02, F.col("l_extendedprice"))).alias("top"))
    rows = described(per, ["area"], "top", {"median_top": 0.5}, lambda c: F.round(c, 4))
    return rows.select("area", F.col("rows").alias("eligible"), F.col("known").alias("with_terms"), "median_top")


@query(f"SELECT status, {VALUES_SQL} FROM deal_areas, as_of WHERE area = 'ASIA' AND date_start >= TIMESTAMP '1998-01-01' AND date_start < TIMESTAMP '1999-01-01' GROUP BY 1")
def template_year_share(d: Domain) -> DataFrame:
    rows = d.deal_areas().where((F.col("area") == "ASIA") & (F.year("date_start") == 1998))
    return rows.groupBy("status").agg(*values())


@query("""SELECT partner_id, count(DISTINCT deal_id) AS deals, round(sum(total_value), 2) AS value FROM deal_areas JOIN deal_partners USING (deal_id), as_of WHERE area = 'EUROPE' AND date_start >= today - INTERVAL 3 YEAR GROUP BY 1 ORDER BY value DESC NULLS LAST, partner_id LIMIT 10""")
def template_ranked_acquirers(d: Domain) -> DataFrame:
    rows = d.deal_areas().where((F.col("area") == "EUROPE") & since(3)).join(d.deal_partners(), "deal_id")
    by = rows.groupBy("partner_id").agg(F.countDistinct("deal_id").alias("deals"), F.round(F.sum("total_value"), 2).alias("value"))
    return by.orderBy(F.desc_nulls_last("value"), "partner_id").limit(10)


@query("""SELECT company_id, name, company_type, deals, (SELECT count(*) FROM companies WHERE company_id > 700) > 40 AS has_more FROM companies c LEFT JOIN (SELECT principal_id, count(*) AS deals FROM deals GROUP BY 1) d ON d.principal_id = c.company_id WHERE company_id > 700 ORDER BY company_id LIMIT 40""")
def browse_companies(d: Domain) -> DataFrame:
    page = keyset_page(d.companies().select("company_id", "name", "company_type"), "company_id", 700, 40)
    counts = d.deals().join(page.select(F.col("company_id").alias("principal_id")), "principal_id", "left_semi").groupBy("principal_id").agg(F.count(F.lit(1)).alias("deals"))
    return page.join(counts, F.col("company_id") == F.col("principal_id"), "left").select("company_id", "name", "company_type", "deals", "has_more")


@query("""SELECT user_id, tag, count(*) AS n FROM (SELECT user_id, unnest(['k' || ((props::JSON->>'k')::INT // 20), event_type]) AS tag FROM events) WHERE user_id <= 40 GROUP BY ALL""")
def watchlist_tags(d: Domain) -> DataFrame:
    bucket = F.concat(F.lit("k"), F.floor(F.get_json_object("props", "$.k").cast("int") / 20).cast("string"))
    tags = d.t("events").where(F.col("user_id") <= 40).select("user_id", F.explode(F.array(bucket, "event_type")).alias("tag"))
    return tags.groupBy("user_id", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT user_id FROM (SELECT user_id, list(DISTINCT event_type) AS kinds FROM events WHERE value > 150 GROUP BY 1) WHERE list_contains(kinds, 'error') AND list_has_any(kinds, ['signup', 'click'])""")
def array_membership(d: Domain) -> DataFrame:
    kinds = d.t("events").where(F.col("value") > 150).groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))
    return kinds.where(F.array_contains("kinds", "error") & F.arrays_overlap("kinds", F.array(F.lit("signup"), F.lit("click")))).select("user_id")


@query("""SELECT 'negative_value' AS rule, count(*) FILTER (WHERE total_value < 0) AS failed FROM deals UNION ALL SELECT 'orphan_principal', count(*) FROM deals WHERE principal_id NOT IN (SELECT company_id FROM companies)
UNION ALL SELECT 'orphan_asset', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT 'repeated_deal', count(*) - count(DISTINCT deal_id) FROM deals""")
def integrity_checks(d: Domain) -> DataFrame:
    deals = d.deals()
    count = lambda df, rule: df.agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("failed"))
    orphans = deals.join(d.companies().select(F.col("company_id").alias("principal_id")), "principal_id", "left_anti")
    lost = d.t("lineitem").join(d.t("part").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_anti")
    repeated = deals.agg(F.lit("repeated_deal").alias("rule"), (F.count(F.lit(1)) - F.countDistinct("deal_id")).alias("failed"))
    return count(deals.where(F.col("total_value") < 0), "negative_value").unionByName(count(orphans, "orphan_principal")).unionByName(count(lost, "orphan_asset")).unionByName(repeated)


@query("""SELECT deal_id, sha256(deal_id || '|' || status || '|' || category) AS fingerprint FROM deals QUALIFY row_number() OVER (PARTITION BY status ORDER BY md5(deal_id::VARCHAR), deal_id) <= 100""")
def replay_sample(d: Domain) -> DataFrame:
    """A fixed stratified sample with the fingerprints that a replay has to give again."""
    rows = d.deals().select("deal_id", "status", "category", F.md5(F.col("deal_id").cast("string").cast("binary")).alias("draw"))
    best = first_per_key(rows, ["status"], [F.col("draw"), F.col("deal_id")], 100)
    return best.select("deal_id", F.sha2(F.concat_ws("|", F.col("deal_id").cast("string"), "status", "category").cast("binary"), 256).alias("fingerprint"))


@query("""SELECT company, string_agg(DISTINCT role, ',' ORDER BY role) AS roles, count(*) AS n FROM (SELECT nation AS company, 'home' AS role FROM areas JOIN companies USING (nation_id) UNION ALL SELECT nation, 'partner' FROM areas JOIN partners USING (nation_id)) GROUP BY 1 HAVING count(DISTINCT role) > 1""")
def role_overlap(d: Domain) -> DataFrame:
    a, c, p = d.areas(), d.companies(), d.partners()
    rows = a.join(c, "nation_id").select(F.col("nation").alias("company"), F.lit("home").alias("role")).unionByName(a.join(p, "nation_id").select("nation", F.lit("partner").alias("role")).withColumnRenamed("nation", "company"))
    by = rows.groupBy("company").agg(F.sort_array(F.collect_set("role")).alias("r"), F.count(F.lit(1)).alias("n"))
    return by.where(F.size("r") > 1).select("company", F.array_join("r", ",").alias("roles"), "n")


@query("""SELECT c.company_id, c.name, (SELECT count(*) FROM deals d WHERE d.principal_id = c.company_id) AS deals, rank() OVER (ORDER BY (SELECT count(*) FROM deals d WHERE d.principal_id = c.company_id) DESC) AS place FROM companies c QUALIFY place <= 20""")
def ranked_companies(d: Domain) -> DataFrame:
    counts = d.deals().groupBy(F.col("principal_id").alias("company_id")).agg(F.count(F.lit(1)).alias("deals"))
    both = d.companies().join(counts, "company_id", "left").select("company_id", "name", F.coalesce("deals", F.lit(0)).alias("deals"))
    # the place of a number of deals is one more than the companies that have more: one small row for each number
    numbers = both.groupBy("deals").agg(F.count(F.lit(1)).alias("_c")).orderBy(F.desc("deals")).limit(20)
    more = F.coalesce(F.sum("_c").over(W.orderBy(F.desc("deals")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    places = numbers.select("deals", (more + 1).alias("place")).where(F.col("place") <= 20)
    return both.join(places, "deals").select("company_id", "name", "deals", "place")
