"""The partnership graph as vertex and edge DataFrames: partners, paths, networks, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealmill.domain import Domain, with_domain
from dealmill.operators.paths import distances, induced, shortest_chains
from dealmill.operators.topk import first_per_key

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir, f=f: f(Domain(spark, sf_dir))
        if sql:
            SQL[f.__name__] = with_domain(sql)
        return f

    return put


_REL = "CASE role WHEN 'Principal' THEN 'LICENSES_OUT' WHEN 'Partner' THEN 'LICENSES_IN' ELSE 'PARTICIPATES_IN' END"


@query(f"SELECT company AS src, 'D' || deal_id AS dst, {_REL} AS rel FROM deal_roles")
def graph_edges(d: Domain) -> DataFrame:
    """src, dst, rel: company to deal, the relation by role."""
    rel = F.when(F.col("role") == "Principal", "LICENSES_OUT").when(F.col("role") == "Partner", "LICENSES_IN").otherwise("PARTICIPATES_IN")
    return d.deal_roles().select(F.col("company").alias("src"), F.concat(F.lit("D"), F.col("deal_id").cast("string")).alias("dst"), rel.alias("rel"))


@query("""SELECT 'Company' AS kind, count(*) AS n FROM (SELECT DISTINCT company FROM deal_roles) UNION ALL SELECT 'Deal', count(*) FROM deals
UNION ALL SELECT 'rel:' || role, count(*) FROM deal_roles GROUP BY role""")
def graph_stats(d: Domain) -> DataFrame:
    roles = d.deal_roles()
    companies = roles.select("company").distinct().agg(F.lit("Company").alias("kind"), F.count(F.lit(1)).alias("n"))
    deals = d.deals().agg(F.lit("Deal").alias("kind"), F.count(F.lit(1)).alias("n"))
    return companies.unionByName(deals).unionByName(roles.groupBy(F.concat(F.lit("rel:"), "role").alias("kind")).agg(F.count(F.lit(1)).alias("n")))


@query("""SELECT company, count(DISTINCT deal_id) AS deals, count(DISTINCT other) AS partners FROM (
 SELECT a.company, b.company AS other, a.deal_id FROM deal_roles a JOIN deal_roles b ON a.deal_id = b.deal_id AND a.company <> b.company) GROUP BY 1 ORDER BY deals DESC, company LIMIT 50""")
def graph_top_connected(d: Domain) -> DataFrame:
    a, b = d.deal_roles(), d.deal_roles().select("deal_id", F.col("company").alias("other"))
    both = a.join(b, "deal_id").where(F.col("company") != F.col("other"))
    return both.groupBy("company").agg(F.countDistinct("deal_id").alias("deals"), F.countDistinct("other").alias("partners")).orderBy(F.desc("deals"), "company").limit(50)


@query("""SELECT other AS partner, count(DISTINCT deal_id) AS deals, min(date_start)::DATE::VARCHAR AS first_deal, max(date_start)::DATE::VARCHAR AS last_deal, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM (
 SELECT b.company AS other, b.deal_id, date_start, category FROM deal_roles a JOIN deal_roles b ON a.deal_id = b.deal_id AND a.company <> b.company JOIN deals d ON d.deal_id = a.deal_id WHERE a.company = 'C1') GROUP BY 1""")
def graph_partner_summary(d: Domain) -> DataFrame:
    mine = d.deal_roles().where(F.col("company") == "C1").select("deal_id")
    others = d.deal_roles().where(F.col("company") != "C1").join(mine, "deal_id").join(d.deals().select("deal_id", "date_start", "category"), "deal_id")
    return others.groupBy(F.col("company").alias("partner")).agg(
        F.countDistinct("deal_id").alias("deals"), F.to_date(F.min("date_start")).cast("string").alias("first_deal"), F.to_date(F.max("date_start")).cast("string").alias("last_deal"),
        F.array_join(F.sort_array(F.collect_set("category")), ",").alias("categories"),
    )


@query("""SELECT a.deal_id FROM deal_roles a JOIN deal_roles b USING (deal_id) WHERE a.company = 'S1' AND b.company = 'S2'""")
def graph_deals_between(d: Domain) -> DataFrame:
    of = lambda c: d.deal_roles().where(F.col("company") == c).select("deal_id")
    return of("S1").join(of("S2"), "deal_id")


@query("""WITH pair AS (SELECT a.partner_id AS a, b.partner_id AS b, count(*) AS deals, round(sum(total_value), 2) AS value FROM deal_partners a JOIN deal_partners b ON a.deal_id = b.deal_id AND a.partner_id < b.partner_id
 JOIN deal_areas d ON d.deal_id = a.deal_id WHERE area ILIKE '%asia%' GROUP BY ALL HAVING count(*) >= 2) SELECT a, b, deals, value FROM pair ORDER BY deals DESC, a, b LIMIT 100""")
def graph_industry_network(d: Domain) -> DataFrame:
    asia = d.deal_areas().where(F.col("area").ilike("%asia%")).select("deal_id", "total_value")
    a = d.deal_partners().join(asia, "deal_id").withColumnRenamed("partner_id", "a")
    pairs = a.join(d.deal_partners().withColumnRenamed("partner_id", "b"), "deal_id").where(F.col("a") < F.col("b"))
    by = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("deals"), F.round(F.sum("total_value"), 2).alias("value"))
    return by.where(F.col("deals") >= 2).orderBy(F.desc("deals"), "a", "b").limit(100)


@query("""WITH first AS (SELECT b.company AS other, count(DISTINCT a.deal_id) AS deals FROM deal_roles a JOIN deal_roles b ON a.deal_id = b.deal_id AND a.company <> b.company WHERE a.company = 'C1' GROUP BY 1)
SELECT other AS src, b.company AS dst, count(DISTINCT a.deal_id) AS deals FROM first JOIN deal_roles a ON a.company = other JOIN deal_roles b ON a.deal_id = b.deal_id AND b.company <> other AND b.company <> 'C1'
GROUP BY ALL ORDER BY deals DESC, src, dst LIMIT 50""")
def graph_second_degree(d: Domain) -> DataFrame:
    roles = d.deal_roles().select("deal_id", "company")
    mine = roles.where(F.col("company") == "C1").select("deal_id")
    first = roles.join(mine, "deal_id", "left_semi").where(F.col("company") != "C1").select(F.col("company").alias("src")).distinct()
    out = first.join(roles.withColumnRenamed("company", "src"), "src").join(roles.withColumnRenamed("company", "dst"), "deal_id")
    out = out.where((F.col("dst") != F.col("src")) & (F.col("dst") != "C1"))
    return out.groupBy("src", "dst").agg(F.countDistinct("deal_id").alias("deals")).orderBy(F.desc("deals"), "src", "dst").limit(50)


_NEAR = "(SELECT DISTINCT a.company AS x, b.company AS y FROM deal_roles a JOIN deal_roles b ON a.deal_id = b.deal_id AND a.company <> b.company)"


@query(f"""WITH e AS {_NEAR}, h1 AS (SELECT DISTINCT y AS company FROM e WHERE x = 'C1'), h2 AS (SELECT DISTINCT y AS company FROM e JOIN h1 ON x = h1.company WHERE y <> 'C1' AND y NOT IN (SELECT company FROM h1))
SELECT 'C1' AS company, 0 AS hops UNION ALL SELECT company, 1 FROM h1 UNION ALL SELECT company, 2 FROM h2""")
def graph_distances(d: Domain) -> DataFrame:
    """Companies within two partnerships of C1, by frontier search over company-deal edges (four edge steps)."""
    roles = d.deal_roles()
    edges = roles.select(F.col("company").alias("src"), F.concat(F.lit("D"), F.col("deal_id").cast("string")).alias("dst"))
    found = distances(edges, ["C1"], 4)
    return found.where(~F.col("id").startswith("D")).select(F.col("id").alias("company"), (F.col("hops") / 2).cast("int").alias("hops"))


@query("""SELECT DISTINCT ON (company) company, deal_id, category FROM deal_roles JOIN deals USING (deal_id) ORDER BY company, date_start DESC NULLS LAST, deal_id""")
def graph_latest_deal(d: Domain) -> DataFrame:
    rows = d.deal_roles().join(d.deals().select("deal_id", "date_start", "category"), "deal_id")
    return first_per_key(rows.select("company", "deal_id", "date_start", "category"), ["company"], [F.col("date_start").desc_nulls_last(), F.col("deal_id")]).select("company", "deal_id", "category")


_PAIR = "(SELECT a.company AS x, b.company AS y, a.deal_id FROM deal_roles a JOIN deal_roles b ON a.deal_id = b.deal_id AND a.company <> b.company)"


@query(f"""WITH e AS (SELECT DISTINCT x, y FROM {_PAIR}),
p1 AS (SELECT x, y FROM e WHERE x = 'C1'), direct AS (SELECT ['C1', 'C2'] AS path FROM p1 WHERE y = 'C2'),
p2 AS (SELECT ['C1', p1.y, e.y] AS path FROM p1 JOIN e ON e.x = p1.y WHERE e.y = 'C2' AND NOT EXISTS (FROM direct)),
p3 AS (SELECT DISTINCT ['C1', p1.y, a.y, b.y] AS path FROM p1 JOIN e a ON a.x = p1.y AND a.y <> 'C1' JOIN e b ON b.x = a.y AND b.y = 'C2' WHERE NOT EXISTS (FROM direct) AND NOT EXISTS (FROM p2))
SELECT array_to_string(path, '>') AS path FROM (FROM direct UNION ALL FROM p2 UNION ALL FROM p3) ORDER BY len(path), 1 LIMIT 5""")
def graph_shortest_paths(d: Domain) -> DataFrame:
    """Up to five shortest chains of partnerships between C1 and C2, of three steps at most."""
    members = d.deal_roles().select(F.col("deal_id").alias("group"), F.col("company").alias("id"))
    return shortest_chains(members, "C1", "C2", 3).select(F.array_join("path", ">").alias("path"))


@query(f"""WITH ego AS (SELECT y AS company, count(DISTINCT p.deal_id) AS deals, round(sum(total_value), 2) AS value FROM (SELECT DISTINCT * FROM {_PAIR}) p JOIN deals d ON d.deal_id = p.deal_id WHERE x = 'C1' GROUP BY 1 HAVING count(DISTINCT p.deal_id) >= 1),
among AS (SELECT x, y, count(DISTINCT p.deal_id) AS deals, round(sum(total_value), 2) AS value FROM (SELECT DISTINCT * FROM {_PAIR}) p JOIN deals d ON d.deal_id = p.deal_id WHERE x < y AND x IN (SELECT company FROM ego) AND y IN (SELECT company FROM ego) GROUP BY ALL HAVING count(DISTINCT p.deal_id) >= 2)
SELECT 'C1' AS src, company AS dst, deals, value FROM ego UNION ALL SELECT x, y, deals, value FROM among""")
def graph_ego_network(d: Domain) -> DataFrame:
    """C1 with its partners, and its partners among themselves (two deals at least): deals and summed value of each edge."""
    roles, value = d.deal_roles().select("deal_id", "company").distinct(), d.deals().select("deal_id", "total_value")
    mine = roles.where(F.col("company") == "C1").select("deal_id")
    total = [F.countDistinct("deal_id").alias("deals"), F.round(F.sum("total_value"), 2).alias("value")]
    ego = roles.join(mine, "deal_id").where(F.col("company") != "C1").join(value, "deal_id").groupBy(F.col("company").alias("dst")).agg(*total)
    inside = roles.join(ego.select(F.col("dst").alias("company")), "company", "left_semi")
    a, b = inside.withColumnRenamed("company", "src"), inside.withColumnRenamed("company", "dst")
    among = a.join(b, "deal_id").where(F.col("src") < F.col("dst")).join(value, "deal_id").groupBy("src", "dst").agg(*total).where(F.col("deals") >= 2)
    return ego.select(F.lit("C1").alias("src"), "dst", "deals", "value").unionByName(among)


@query(f"""WITH e AS (SELECT company AS src, 'D' || deal_id AS dst FROM deal_roles), v0 AS (SELECT 'C1' AS id), v1 AS (SELECT dst AS id FROM e WHERE src = 'C1'), v2 AS (SELECT DISTINCT src AS id FROM e WHERE dst IN (SELECT id FROM v1)),
v AS (FROM v0 UNION FROM v1 UNION FROM v2) SELECT src, dst FROM e WHERE src IN (SELECT id FROM v) AND dst IN (SELECT id FROM v)""")
def graph_subgraph(d: Domain) -> DataFrame:
    """All edges between the vertices within two steps of C1."""
    edges = d.deal_roles().select(F.col("company").alias("src"), F.concat(F.lit("D"), F.col("deal_id").cast("string")).alias("dst"))
    return induced(edges, ["C1"], 2)
