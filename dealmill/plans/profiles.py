"""Profiles, comparisons, mergers and question templates in sections: one query for each section of an answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealmill.domain import Domain, with_domain
from dealmill.operators.quantiles import quantiles
from dealmill.operators.topk import first_per_key
from dealmill.plans.market import since

QUERIES, SQL = {}, {}
#: The company, the asset and the companies that the registered queries ask for.
COMPANY, ASSET, COMPARED = "S1", 1, ("S1", "S2", "C1")


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir, f=f: f(Domain(spark, sf_dir))
        if sql:
            SQL[f.__name__] = with_domain(sql)
        return f

    return put


def money(value: str = "total_value") -> list:
    """How many values are known, their sum and mean."""
    return [F.count(value).alias("disclosed"), F.round(F.sum(value), 2).alias("sum_value"), F.round(F.avg(value), 2).alias("avg_value")]


_MONEY = "count(total_value) AS disclosed, round(sum(total_value), 2) AS sum_value, round(avg(total_value), 2) AS avg_value"
_MINE = f"mine AS (SELECT DISTINCT d.* FROM deals d JOIN deal_roles r ON r.deal_id = d.deal_id WHERE r.company = '{COMPANY}')"


def deals_of(d: Domain, company: str) -> DataFrame:
    """The deals that a company takes part in, once each."""
    return d.deals().join(d.deal_roles().where(F.col("company") == company).select("deal_id"), "deal_id", "left_semi")


def parts(d: Domain) -> DataFrame:
    """deal_id, asset_id and the asset's name, indication (brand) and technology (type)."""
    p = d.t("part").select(F.col("p_partkey").alias("asset_id"), F.col("p_name").alias("asset"), F.col("p_brand").alias("indication"), F.col("p_type").alias("technology"))
    return d.deal_assets().join(p, "asset_id")


_PARTS = "parts AS (SELECT deal_id, asset_id, p_name AS asset, p_brand AS indication, p_type AS technology FROM deal_assets JOIN part ON p_partkey = asset_id)"

# --- a company ---------------------------------------------------------------------------------------------


@query(f"SELECT count(DISTINCT deal_id) AS deals, count(DISTINCT deal_id) FILTER (WHERE role = 'Principal') AS as_principal, count(DISTINCT deal_id) FILTER (WHERE role = 'Partner') AS as_partner FROM deal_roles WHERE company = '{COMPANY}'")
def company_roles(d: Domain, company: str = COMPANY) -> DataFrame:
    of = lambda role: F.countDistinct(F.when(F.col("role") == role, F.col("deal_id")))
    return d.deal_roles().where(F.col("company") == company).agg(F.countDistinct("deal_id").alias("deals"), of("Principal").alias("as_principal"), of("Partner").alias("as_partner"))


@query(f"WITH {_MINE} SELECT {_MONEY} FROM mine")
def company_value(d: Domain, company: str = COMPANY) -> DataFrame:
    return deals_of(d, company).agg(*money())


@query(f"WITH {_MINE} SELECT year(date_start)::INT AS year, count(*) AS deals, round(sum(total_value), 2) AS sum_value FROM mine WHERE date_start IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 20")
def company_years(d: Domain, company: str = COMPANY) -> DataFrame:
    by = deals_of(d, company).where(F.col("date_start").isNotNull()).groupBy(F.year("date_start").alias("year"))
    return by.agg(F.count(F.lit(1)).alias("deals"), F.round(F.sum("total_value"), 2).alias("sum_value")).orderBy(F.desc("year")).limit(20)


@query(f"WITH {_MINE} SELECT r.company AS partner, count(*) AS deals, round(sum(total_value), 2) AS sum_value FROM mine JOIN (SELECT DISTINCT deal_id, company FROM deal_roles) r USING (deal_id) WHERE r.company <> '{COMPANY}' GROUP BY 1 ORDER BY deals DESC, partner LIMIT 10")
def company_partners(d: Domain, company: str = COMPANY) -> DataFrame:
    others = d.deal_roles().where(F.col("company") != company).select("deal_id", F.col("company").alias("partner")).distinct()
    by = deals_of(d, company).join(others, "deal_id").groupBy("partner")
    return by.agg(F.count(F.lit(1)).alias("deals"), F.round(F.sum("total_value"), 2).alias("sum_value")).orderBy(F.desc("deals"), "partner").limit(10)


@query(f"WITH {_MINE}, {_PARTS} SELECT indication, count(DISTINCT deal_id) AS deals FROM mine JOIN parts USING (deal_id) GROUP BY 1 ORDER BY deals DESC, indication LIMIT 15")
def company_indications(d: Domain, company: str = COMPANY) -> DataFrame:
    by = deals_of(d, company).join(parts(d), "deal_id").groupBy("indication").agg(F.countDistinct("deal_id").alias("deals"))
    return by.orderBy(F.desc("deals"), "indication").limit(15)


@query(f"WITH {_MINE} SELECT deal_id, status, agreement_type, date_start::DATE::VARCHAR AS day, total_value FROM mine, as_of WHERE date_start >= today - INTERVAL 1 YEAR ORDER BY date_start DESC, deal_id LIMIT 20")
def company_recent(d: Domain, company: str = COMPANY) -> DataFrame:
    page = deals_of(d, company).where(since(1)).orderBy(F.desc("date_start"), "deal_id").limit(20)
    return page.select("deal_id", "status", "agreement_type", F.to_date("date_start").cast("string").alias("day"), "total_value")


@query(f"WITH {_MINE}, {_PARTS} SELECT asset_id, asset, technology, count(DISTINCT deal_id) AS deals FROM mine JOIN parts USING (deal_id) GROUP BY ALL ORDER BY deals DESC, asset_id LIMIT 20")
def company_assets(d: Domain, company: str = COMPANY) -> DataFrame:
    by = deals_of(d, company).join(parts(d), "deal_id").groupBy("asset_id", "asset", "technology").agg(F.countDistinct("deal_id").alias("deals"))
    return by.orderBy(F.desc("deals"), "asset_id").limit(20)


# --- an asset ----------------------------------------------------------------------------------------------

_HELD = f"held AS (SELECT d.* FROM deal_areas d JOIN deal_assets a ON a.deal_id = d.deal_id WHERE asset_id = {ASSET})"


def deals_with(d: Domain, asset: int) -> DataFrame:
    return d.deal_areas().join(d.deal_assets().where(F.col("asset_id") == asset).select("deal_id"), "deal_id", "left_semi")


@query(f"WITH {_HELD} SELECT count(*) AS deals, {_MONEY} FROM held")
def asset_value(d: Domain, asset: int = ASSET) -> DataFrame:
    return deals_with(d, asset).agg(F.count(F.lit(1)).alias("deals"), *money())


@query(f"WITH {_HELD} SELECT year(date_start)::INT AS year, count(*) AS deals, round(sum(total_value), 2) AS sum_value FROM held WHERE date_start IS NOT NULL GROUP BY 1")
def asset_years(d: Domain, asset: int = ASSET) -> DataFrame:
    by = deals_with(d, asset).where(F.col("date_start").isNotNull()).groupBy(F.year("date_start").alias("year"))
    return by.agg(F.count(F.lit(1)).alias("deals"), F.round(F.sum("total_value"), 2).alias("sum_value"))


@query(f"""WITH {_HELD}, last AS (SELECT * FROM held QUALIFY row_number() OVER (PARTITION BY nation, company_type ORDER BY date_start DESC NULLS LAST, deal_id DESC) = 1 ORDER BY nation, company_type LIMIT 50)
SELECT nation, company_type AS scope, status, deal_id, (SELECT string_agg(company || ' (' || role || ')', '; ' ORDER BY role, company) FROM deal_roles r WHERE r.deal_id = l.deal_id) AS participants FROM last l""")
def asset_territories(d: Domain, asset: int = ASSET) -> DataFrame:
    """The latest deal of each territory and scope with who takes part: evidence of scope, not of who owns the rights now."""
    last = first_per_key(deals_with(d, asset), ["nation", "company_type"], [F.col("date_start").desc_nulls_last(), F.desc("deal_id")]).orderBy("nation", "company_type").limit(50)
    who = d.deal_roles().join(last.select("deal_id"), "deal_id", "left_semi").groupBy("deal_id").agg(F.sort_array(F.collect_list(F.struct("role", "company"))).alias("w"))
    named = F.array_join(F.transform("w", lambda x: F.concat(x["company"], F.lit(" ("), x["role"], F.lit(")"))), "; ")
    return last.join(who, "deal_id", "left").select("nation", F.col("company_type").alias("scope"), "status", "deal_id", named.alias("participants"))


@query(f"""WITH {_HELD}, {_PARTS}, page AS (SELECT * FROM held ORDER BY date_start DESC NULLS LAST, deal_id LIMIT 100)
SELECT deal_id, status, total_value, principal_id, (SELECT min(partner_id) FROM deal_partners b WHERE b.deal_id = page.deal_id) AS partner_id, (SELECT string_agg(DISTINCT indication, '; ' ORDER BY indication) FROM parts p WHERE p.deal_id = page.deal_id) AS indications FROM page""")
def asset_deals(d: Domain, asset: int = ASSET) -> DataFrame:
    """The page first; partners and indications are looked up for its deals only."""
    page = deals_with(d, asset).orderBy(F.col("date_start").desc_nulls_last(), "deal_id").limit(100).select("deal_id", "status", "total_value", "principal_id")
    ids = page.select("deal_id")
    partner = d.deal_partners().join(ids, "deal_id", "left_semi").groupBy("deal_id").agg(F.min("partner_id").alias("partner_id"))
    named = parts(d).join(ids, "deal_id", "left_semi").groupBy("deal_id").agg(F.array_join(F.sort_array(F.collect_set("indication")), "; ").alias("indications"))
    return page.join(partner, "deal_id", "left").join(named, "deal_id", "left")


@query(f"WITH {_HELD}, {_PARTS} SELECT DISTINCT 'indication' AS kind, indication AS name FROM held JOIN parts USING (deal_id) UNION SELECT 'technology', technology FROM held JOIN parts USING (deal_id)")
def asset_topics(d: Domain, asset: int = ASSET) -> DataFrame:
    rows = deals_with(d, asset).select("deal_id").join(parts(d), "deal_id")
    return rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("name")) for k in ("indication", "technology")])).alias("t")).select("t.*").distinct()


@query(f"""WITH {_PARTS}, hit AS (SELECT asset_id, asset, indication, technology, count(DISTINCT deal_id) AS deals, max(date_start) AS last FROM parts JOIN deals USING (deal_id) WHERE technology ILIKE '%a%' AND date_start >= TIMESTAMP '1997-01-01' GROUP BY ALL HAVING count(DISTINCT deal_id) >= 2
 ORDER BY deals DESC, asset_id LIMIT 25)
SELECT h.asset_id, asset, indication, h.deals, last::DATE::VARCHAR AS last_deal, (SELECT string_agg(DISTINCT r.company, '; ' ORDER BY r.company) FROM deal_assets a JOIN deal_roles r ON r.deal_id = a.deal_id AND r.role = 'Partner' WHERE a.asset_id = h.asset_id) AS partners FROM hit h""")
def asset_search(d: Domain) -> DataFrame:
    """Assets by technology and the dates of their deals: the page is cut first, then filled in with partners."""
    rows = parts(d).where(F.col("technology").ilike("%a%")).join(d.deals().where(F.year("date_start") >= 1997).select("deal_id", "date_start"), "deal_id")
    by = rows.groupBy("asset_id", "asset", "indication", "technology").agg(F.countDistinct("deal_id").alias("deals"), F.max("date_start").alias("last"))
    page = by.where(F.col("deals") >= 2).orderBy(F.desc("deals"), "asset_id").limit(25)
    mine = d.deal_assets().join(page.select("asset_id"), "asset_id", "left_semi").join(d.deal_roles().where(F.col("role") == "Partner"), "deal_id")
    partners = mine.groupBy("asset_id").agg(F.array_join(F.sort_array(F.collect_set("company")), "; ").alias("partners"))
    return page.join(partners, "asset_id", "left").select("asset_id", "asset", "indication", "deals", F.to_date("last").cast("string").alias("last_deal"), "partners")


# --- companies side by side --------------------------------------------------------------------------------

_SIDE = f"side AS (SELECT r.company, r.role, d.* FROM deal_roles r JOIN deals d ON d.deal_id = r.deal_id, as_of WHERE r.company IN {COMPARED} AND date_start >= today - INTERVAL 5 YEAR)"


def side_by_side(d: Domain, companies: tuple[str, ...] = COMPARED, years: int = 5) -> DataFrame:
    return d.deal_roles().where(F.col("company").isin(*companies)).join(d.deals().where(since(years)), "deal_id")


@query(f"WITH {_SIDE} SELECT company, role, count(DISTINCT deal_id) AS deals, {_MONEY}, count(DISTINCT year(date_start)) AS active_years FROM side GROUP BY ALL")
def comparison_by_role(d: Domain) -> DataFrame:
    return side_by_side(d).groupBy("company", "role").agg(F.countDistinct("deal_id").alias("deals"), *money(), F.countDistinct(F.year("date_start")).alias("active_years"))


@query(f"WITH {_SIDE}, {_PARTS} SELECT company, indication, count(*) AS deals FROM side JOIN parts USING (deal_id) GROUP BY company, indication QUALIFY row_number() OVER (PARTITION BY company ORDER BY count(*) DESC, indication) <= 5")
def comparison_indications(d: Domain) -> DataFrame:
    by = side_by_side(d).join(parts(d), "deal_id").groupBy("company", "indication").agg(F.count(F.lit(1)).alias("deals"))
    return first_per_key(by, ["company"], [F.desc("deals"), F.col("indication")], 5)


@query(f"WITH {_SIDE} SELECT s.company, count(DISTINCT o.company) AS partners FROM side s JOIN deal_roles o ON o.deal_id = s.deal_id AND o.company <> s.company GROUP BY 1")
def comparison_partners(d: Domain) -> DataFrame:
    others = d.deal_roles().select("deal_id", F.col("company").alias("other"))
    return side_by_side(d).join(others, "deal_id").where(F.col("other") != F.col("company")).groupBy("company").agg(F.countDistinct("other").alias("partners"))


@query(f"WITH {_SIDE} SELECT company, year(date_start)::INT AS year, count(*) AS deals, round(sum(total_value), 2) AS sum_value FROM side GROUP BY ALL")
def comparison_trend(d: Domain) -> DataFrame:
    return side_by_side(d).groupBy("company", F.year("date_start").alias("year")).agg(F.count(F.lit(1)).alias("deals"), F.round(F.sum("total_value"), 2).alias("sum_value"))


# --- mergers -----------------------------------------------------------------------------------------------

_MERGERS = """price AS (SELECT l_orderkey AS deal_id, max(l_extendedprice) AS per_share, min(l_extendedprice) AS day1, avg(l_extendedprice) AS day30, sum(l_quantity) AS revenue, min(l_returnflag) AS attitude FROM lineitem GROUP BY 1),
mergers AS (SELECT d.*, p.* EXCLUDE deal_id FROM deals d JOIN price p USING (deal_id), as_of WHERE category IN ('1', '2') AND date_start >= today - INTERVAL 10 YEAR)"""


def mergers(d: Domain, years: int = 10) -> DataFrame:
    """Deals of the merger kinds with prices around their announcement."""
    price = d.t("lineitem").groupBy(F.col("l_orderkey").alias("deal_id")).agg(
        F.max("l_extendedprice").alias("per_share"), F.min("l_extendedprice").alias("day1"), F.avg("l_extendedprice").alias("day30"), F.sum("l_quantity").alias("revenue"), F.min("l_returnflag").alias("attitude")
    )
    return d.deals().where(F.col("category").isin("1", "2") & since(years)).join(price, "deal_id")


@query(f"WITH {_MERGERS} SELECT count(*) AS deals, {_MONEY}, round(median(total_value), 2) AS median_value FROM mergers WHERE total_value IS NOT NULL")
def merger_summary(d: Domain) -> DataFrame:
    known = mergers(d).where(F.col("total_value").isNotNull())
    median = quantiles(known.withColumn("_all", F.lit(1)), ["_all"], "total_value", {"median_value": 0.5}, lambda c: F.round(c, 2))
    totals = known.agg(F.lit(1).alias("_all"), F.count(F.lit(1)).alias("deals"), *money())
    return totals.join(median, "_all", "left").drop("_all")


@query(f"""WITH {_MERGERS}, top AS (SELECT * FROM mergers WHERE per_share IS NOT NULL OR total_value IS NOT NULL ORDER BY total_value DESC NULLS LAST, deal_id LIMIT 30)
SELECT deal_id, total_value, attitude, round(CASE WHEN day1 <> 0 THEN (per_share - day1) / day1 * 100 END, 1) AS day1_premium, round(CASE WHEN day30 <> 0 THEN (per_share - day30) / day30 * 100 END, 1) AS day30_premium,
 round(CASE WHEN total_value <> 0 AND revenue > 0 THEN total_value / revenue END, 1) AS multiple, principal_id AS target_id, (SELECT min(partner_id) FROM deal_partners b WHERE b.deal_id = top.deal_id) AS acquirer_id FROM top""")
def merger_top(d: Domain) -> DataFrame:
    """The largest mergers with their premiums; a zero or missing price gives none."""
    top = mergers(d).where(F.col("per_share").isNotNull() | F.col("total_value").isNotNull()).orderBy(F.col("total_value").desc_nulls_last(), "deal_id").limit(30)
    premium = lambda day: F.round(F.when(F.col(day) != 0, (F.col("per_share") - F.col(day)) / F.col(day) * 100), 1).alias(f"{day}_premium")
    multiple = F.round(F.when((F.col("total_value") != 0) & (F.col("revenue") > 0), F.col("total_value") / F.col("revenue")), 1)
    acquirer = d.deal_partners().join(top.select("deal_id"), "deal_id", "left_semi").groupBy("deal_id").agg(F.min("partner_id").alias("acquirer_id"))
    return top.join(acquirer, "deal_id", "left").select("deal_id", "total_value", "attitude", premium("day1"), premium("day30"), multiple.alias("multiple"), F.col("principal_id").alias("target_id"), "acquirer_id")


@query(f"WITH {_MERGERS} SELECT year(date_start)::INT AS year, count(*) AS deals, {_MONEY} FROM mergers GROUP BY 1")
def merger_years(d: Domain) -> DataFrame:
    return mergers(d).groupBy(F.year("date_start").alias("year")).agg(F.count(F.lit(1)).alias("deals"), *money())


@query(f"WITH {_MERGERS} SELECT coalesce(attitude, 'Not Specified') AS attitude, count(*) AS deals, round(avg(total_value), 2) AS avg_value FROM mergers GROUP BY 1")
def merger_attitudes(d: Domain) -> DataFrame:
    return mergers(d).groupBy(F.coalesce("attitude", F.lit("Not Specified")).alias("attitude")).agg(F.count(F.lit(1)).alias("deals"), F.round(F.avg("total_value"), 2).alias("avg_value"))


# --- peers -------------------------------------------------------------------------------------------------

_DIMENSIONS = ("indication", "technology", "nation")


@query(f"""WITH {_PARTS}, f AS (SELECT DISTINCT company, unnest([{{'dim': 'indication', 'v': indication}}, {{'dim': 'technology', 'v': technology}}, {{'dim': 'nation', 'v': nation}}]) AS x FROM deal_roles JOIN deal_areas USING (deal_id) JOIN parts USING (deal_id)),
e AS (SELECT company, x.dim AS dim, x.v AS v FROM f WHERE company LIKE 'S%'), sizes AS (SELECT company, dim, count(*) AS n FROM e GROUP BY ALL), own AS (SELECT dim, n FROM sizes WHERE company = '{COMPANY}'),
common AS (SELECT b.company, b.dim, count(*) AS c FROM e a JOIN e b ON a.dim = b.dim AND a.v = b.v WHERE a.company = '{COMPANY}' AND b.company <> '{COMPANY}' GROUP BY ALL),
pool AS (SELECT company, sum(c) AS shared FROM common GROUP BY 1 ORDER BY shared DESC, company LIMIT 200)
SELECT p.company, p.shared::BIGINT AS shared, round(sum(coalesce(c.c, 0) / (coalesce(s.n, 0) + o.n - coalesce(c.c, 0))::DOUBLE) / count(*) * 100, 2) AS overlap
FROM pool p CROSS JOIN own o LEFT JOIN sizes s ON s.company = p.company AND s.dim = o.dim LEFT JOIN common c ON c.company = p.company AND c.dim = o.dim GROUP BY ALL""")
def peers_over_dimensions(d: Domain, company: str = COMPANY) -> DataFrame:
    """The 200 partners that share most with a company, by the mean Jaccard overlap over its active dimensions, in percent."""
    rows = d.deal_roles().where(F.col("company").startswith("S")).join(d.deal_areas(), "deal_id").join(parts(d), "deal_id")
    values = rows.select("company", F.explode(F.array(*[F.struct(F.lit(k).alias("dim"), F.col(k).alias("v")) for k in _DIMENSIONS])).alias("x")).select("company", "x.dim", "x.v").distinct()
    sizes = values.groupBy("company", "dim").agg(F.count(F.lit(1)).alias("n"))
    mine = values.where(F.col("company") == company).select("dim", "v")
    common = values.where(F.col("company") != company).join(mine, ["dim", "v"]).groupBy("company", "dim").agg(F.count(F.lit(1)).alias("c"))
    pool = common.groupBy("company").agg(F.sum("c").alias("shared")).orderBy(F.desc("shared"), "company").limit(200)
    own = sizes.where(F.col("company") == company).select("dim", F.col("n").alias("own"))  # a row for each dimension
    both = pool.crossJoin(own).join(sizes, ["company", "dim"], "left").join(common, ["company", "dim"], "left")
    c, n = F.coalesce("c", F.lit(0)), F.coalesce("n", F.lit(0))
    return both.groupBy("company", "shared").agg(F.round(F.sum(c / (n + F.col("own") - c)) / F.count(F.lit(1)) * 100, 2).alias("overlap"))


# --- templates ---------------------------------------------------------------------------------------------


@query(f"WITH {_MINE} SELECT '{COMPANY}' AS company, count(*) AS deals, count(total_value) AS disclosed, min(date_start)::DATE::VARCHAR AS first_deal, max(date_start)::DATE::VARCHAR AS last_deal FROM mine")
def template_company(d: Domain, company: str = COMPANY) -> DataFrame:
    day = lambda f: F.to_date(f("date_start")).cast("string")
    return deals_of(d, company).agg(F.lit(company).alias("company"), F.count(F.lit(1)).alias("deals"), F.count("total_value").alias("disclosed"), day(F.min).alias("first_deal"), day(F.max).alias("last_deal"))


@query(f"""WITH {_PARTS}, eligible AS (SELECT DISTINCT deal_id FROM parts WHERE technology ILIKE '%promo%'), known AS (SELECT d.* FROM deals d JOIN eligible USING (deal_id) WHERE total_value IS NOT NULL)
SELECT k.deal_id, total_value, status, (SELECT string_agg(DISTINCT technology, '; ' ORDER BY technology) FROM parts p WHERE p.deal_id = k.deal_id AND technology ILIKE '%promo%') AS technologies,
 (SELECT count(*) FROM eligible) AS eligible, (SELECT count(*) FROM known) AS with_value FROM known k ORDER BY total_value DESC, k.deal_id LIMIT 20""")
def template_ranked_technology(d: Domain) -> DataFrame:
    """Deals of a technology by value, beside how many were eligible and how many of them have a value."""
    of_kind = parts(d).where(F.col("technology").ilike("%promo%")).select("deal_id", "technology")
    rows = d.deals().join(of_kind.groupBy("deal_id").agg(F.array_join(F.sort_array(F.collect_set("technology")), "; ").alias("technologies")), "deal_id")
    coverage = rows.agg(F.count(F.lit(1)).alias("eligible"), F.count("total_value").alias("with_value"))
    top = rows.where(F.col("total_value").isNotNull()).orderBy(F.desc("total_value"), "deal_id").limit(20)
    return top.select("deal_id", "total_value", "status", "technologies").crossJoin(coverage)


@query("SELECT principal_id AS company_id, count(DISTINCT deal_id) AS deals FROM deals, as_of WHERE category = '1' AND date_start >= today - INTERVAL 3 YEAR GROUP BY 1 ORDER BY deals DESC, company_id LIMIT 20")
def template_active_acquirers(d: Domain) -> DataFrame:
    by = d.deals().where((F.col("category") == "1") & since(3)).groupBy(F.col("principal_id").alias("company_id")).agg(F.countDistinct("deal_id").alias("deals"))
    return by.orderBy(F.desc("deals"), "company_id").limit(20)


@query("""SELECT round(quantile_cont(total_value, 0.25), 4) AS p25, round(quantile_cont(total_value, 0.5), 4) AS median, round(quantile_cont(total_value, 0.75), 4) AS p75, round(min(total_value), 4) AS low, round(max(total_value), 4) AS high,
 round(avg(total_value), 2) AS mean, count(*) AS eligible, count(total_value) AS with_value FROM deal_areas WHERE area = 'ASIA' AND status = 'F'""")
def template_value_range(d: Domain) -> DataFrame:
    rows = d.deal_areas().where((F.col("area") == "ASIA") & (F.col("status") == "F"))
    spread = quantiles(rows, ["area"], "total_value", {"p25": 0.25, "median": 0.5, "p75": 0.75}, lambda c: F.round(c, 4))
    v = F.col("total_value")
    totals = rows.groupBy("area").agg(F.round(F.min(v), 4).alias("low"), F.round(F.max(v), 4).alias("high"), F.round(F.avg(v), 2).alias("mean"), F.count(F.lit(1)).alias("eligible"), F.count(v).alias("with_value"))
    return totals.join(spread, "area", "left").drop("area")


@query("SELECT year(date_start)::INT AS year, count(*) AS deals, count(total_value) AS with_value, round(avg(total_value), 2) AS mean FROM deals, as_of WHERE date_start >= today - INTERVAL 5 YEAR GROUP BY 1")
def template_five_years(d: Domain) -> DataFrame:
    by = d.deals().where(since(5)).groupBy(F.year("date_start").alias("year"))
    return by.agg(F.count(F.lit(1)).alias("deals"), F.count("total_value").alias("with_value"), F.round(F.avg("total_value"), 2).alias("mean"))


@query("""WITH c AS (SELECT CASE WHEN category = '1' THEN 'merger' WHEN category IN ('2', '3') THEN 'license' END AS kind FROM deals WHERE year(date_start) = 1998), n AS (SELECT kind, count(*) AS deals FROM c WHERE kind IS NOT NULL GROUP BY 1)
SELECT kind, deals, round(100 * deals / (SELECT sum(deals) FROM n)::DOUBLE, 1) AS share FROM n""")
def template_kind_share(d: Domain) -> DataFrame:
    kind = F.when(F.col("category") == "1", "merger").when(F.col("category").isin("2", "3"), "license")
    n = d.deals().where(F.year("date_start") == 1998).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("deals")).where(F.col("kind").isNotNull())
    return n.crossJoin(n.agg(F.sum("deals").alias("_all"))).select("kind", "deals", F.round(100 * F.col("deals") / F.col("_all"), 1).alias("share"))


@query("SELECT area, nation, count(DISTINCT deal_id) AS deals FROM deal_areas GROUP BY ALL ORDER BY deals DESC, nation LIMIT 20")
def template_areas(d: Domain) -> DataFrame:
    return d.deal_areas().groupBy("area", "nation").agg(F.countDistinct("deal_id").alias("deals")).orderBy(F.desc("deals"), "nation").limit(20)


@query("SELECT coalesce(agreement_type, 'Unknown') AS agreement_type, count(*) AS deals, min(date_start)::DATE::VARCHAR AS first_deal, max(date_start)::DATE::VARCHAR AS last_deal, count(total_value) AS with_value FROM deals WHERE principal_id <= 50 GROUP BY 1")
def template_agreements(d: Domain) -> DataFrame:
    by = d.deals().where(F.col("principal_id") <= 50).groupBy(F.coalesce("agreement_type", F.lit("Unknown")).alias("agreement_type"))
    day = lambda f: F.to_date(f("date_start")).cast("string")
    return by.agg(F.count(F.lit(1)).alias("deals"), day(F.min).alias("first_deal"), day(F.max).alias("last_deal"), F.count("total_value").alias("with_value"))


@query(f"WITH {_MINE} SELECT count(DISTINCT deal_id) AS deals FROM mine WHERE year(date_start) = 1997")
def template_company_year(d: Domain, company: str = COMPANY) -> DataFrame:
    return deals_of(d, company).where(F.year("date_start") == 1997).agg(F.countDistinct("deal_id").alias("deals"))


_TERMS = "SELECT p_brand AS area, l_orderkey AS deal_id, max(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS upfront, max(100 * l_tax) FILTER (WHERE l_tax > 0) AS rate_high, min(100 * l_tax) FILTER (WHERE l_tax > 0) AS rate_low FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL"


def _terms(d: Domain) -> DataFrame:
    """One row for each deal of an area: its largest upfront payment and its band of rates."""
    brands = d.t("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("area"))
    rate = F.when(F.col("l_tax") > 0, 100 * F.col("l_tax"))
    return d.t("lineitem").join(brands, "l_partkey").groupBy("area", F.col("l_orderkey").alias("deal_id")).agg(
        F.max(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice"))).alias("upfront"), F.max(rate).alias("rate_high"), F.min(rate).alias("rate_low")
    )


@query(f"SELECT area, count(*) AS eligible, count(upfront) AS with_terms, round(median(upfront), 4) AS median, round(max(upfront), 4) AS high FROM ({_TERMS}) GROUP BY 1")
def template_upfront(d: Domain) -> DataFrame:
    terms = _terms(d)
    counts = terms.groupBy("area").agg(F.count(F.lit(1)).alias("eligible"), F.count("upfront").alias("with_terms"), F.round(F.max("upfront"), 4).alias("high"))
    return counts.join(quantiles(terms, ["area"], "upfront", {"median": 0.5}, lambda c: F.round(c, 4)), "area", "left")


@query(f"SELECT area, count(*) AS eligible, count(rate_high) AS with_terms, round(min(rate_low), 4) AS low, round(max(rate_high), 4) AS high, round(median(rate_high), 4) AS median_high FROM ({_TERMS}) GROUP BY 1")
def template_royalties(d: Domain) -> DataFrame:
    terms = _terms(d)
    counts = terms.groupBy("area").agg(F.count(F.lit(1)).alias("eligible"), F.count("rate_high").alias("with_terms"), F.round(F.min("rate_low"), 4).alias("low"), F.round(F.max("rate_high"), 4).alias("high"))
    return counts.join(quantiles(terms, ["area"], "rate_high", {"median_high": 0.5}, lambda c: F.round(c, 4)), "area", "left")
