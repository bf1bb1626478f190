"""Asset intelligence: portfolios, rights and territories with their evidence, dossiers; merged and replaced rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealmill.domain import Domain, with_domain
from dealmill.operators.mentions import linked, mentions
from dealmill.operators.merges import carried, merged
from dealmill.operators.scopes import ancestry, dossiers, evidence_sets, scopes
from dealmill.session import scratch
from dealmill.sources.children import Children

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir, f=f: f(Domain(spark, sf_dir))
        if sql:
            SQL[f.__name__] = with_domain(sql)
        return f

    return put


#: Kinds of agreement that are read as licences, options among them and exclusive ones.
LICENCES, OPTIONS, EXCLUSIVE = ("1", "2", "3"), ("2",), ("1",)


def asset_links(d: Domain) -> DataFrame:
    """Lines of deals with the deal, the asset and the partner."""
    lines = d.t("lineitem").select(
        F.col("l_orderkey").alias("deal_id"), F.col("l_partkey").alias("asset_id"), F.col("l_suppkey").alias("partner_id"), (F.col("l_returnflag") == "R").alias("returned"),
        F.col("l_shipdate").alias("shipped"),
    )
    return lines.join(d.deals(), "deal_id")


_LINKS = """links AS (SELECT l_orderkey AS deal_id, l_partkey AS asset_id, l_suppkey AS partner_id, l_returnflag = 'R' AS returned, l_shipdate AS shipped, principal_id, status, date_start, category, total_value
  FROM lineitem JOIN deals ON deal_id = l_orderkey)"""


@query(f"""WITH {_LINKS}, tags AS (
  SELECT DISTINCT principal_id AS company_id, asset_id, kind, tag, deal_id FROM (
    SELECT l.*, unnest(['modality', 'indication']) AS kind, unnest([split_part(p_type, ' ', 1), p_brand]) AS tag FROM links l JOIN part ON p_partkey = asset_id) WHERE tag <> '')
SELECT company_id, asset_id, kind, tag, count(*) AS n_evidence, array_to_string((list_sort(list(deal_id)))[1:20], ',') AS evidence FROM tags GROUP BY ALL""")
def asset_portfolio(d: Domain) -> DataFrame:
    """Assets that a company's deals refer to, with the deals that speak for each modality and indication."""
    parts = d.t("part").select(F.col("p_partkey").alias("asset_id"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("modality"), F.col("p_brand").alias("indication"))
    rows = asset_links(d).select(F.col("principal_id").alias("company_id"), "asset_id", "deal_id").distinct().join(parts, "asset_id")
    tags = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("tag")) for k in ("modality", "indication")])
    tagged = rows.select("company_id", "asset_id", "deal_id", F.explode(tags).alias("t")).select("company_id", "asset_id", "deal_id", "t.*").where("tag <> ''")
    told = evidence_sets(tagged, ["company_id", "asset_id", "kind", "tag"], "deal_id")
    return told.withColumn("evidence", F.array_join(F.transform("evidence", lambda i: i.cast("string")), ","))


@query(f"""WITH {_LINKS}, roles AS (
  SELECT DISTINCT 'C' || principal_id AS company, 'principal' AS role, asset_id, deal_id, category, returned FROM links
  UNION SELECT DISTINCT 'S' || partner_id, 'partner', asset_id, deal_id, category, returned FROM links)
SELECT company, asset_id, count(DISTINCT deal_id) AS licences, count(DISTINCT deal_id) FILTER (WHERE role = 'principal') AS as_principal, bool_or(category = '2') AS option_seen, bool_or(category = '1') AS exclusive_seen,
 bool_or(returned) AS reversion_seen, min(CASE WHEN returned THEN 'explicitly_observed' WHEN category = '2' THEN 'option_not_exercise_verified' WHEN role = 'principal' THEN 'principal_direction_not_explicit' ELSE 'not_observed' END) AS out_licence
FROM roles WHERE category IN ('1', '2', '3') GROUP BY ALL""")
def asset_rights(d: Domain) -> DataFrame:
    """What licence deals show of a company's rights in an asset: role, options, exclusivity, reversions. Ownership is never inferred."""
    links = asset_links(d).where(F.col("category").isin(*LICENCES))
    side = lambda p, c, role: F.struct(F.concat(F.lit(p), F.col(c).cast("string")).alias("company"), F.lit(role).alias("role"))
    rows = links.select("asset_id", "deal_id", "category", "returned", F.explode(F.array(side("C", "principal_id", "principal"), side("S", "partner_id", "partner"))).alias("s")).select("s.*", "asset_id", "deal_id", "category", "returned")
    option, exclusive = F.col("category").isin(*OPTIONS), F.col("category").isin(*EXCLUSIVE)
    status = F.when(F.col("returned"), "explicitly_observed").when(option, "option_not_exercise_verified").when(F.col("role") == "principal", "principal_direction_not_explicit").otherwise("not_observed")
    return rows.groupBy("company", "asset_id").agg(
        F.countDistinct("deal_id").alias("licences"), F.countDistinct(F.when(F.col("role") == "principal", F.col("deal_id"))).alias("as_principal"), F.bool_or(option).alias("option_seen"),
        F.bool_or(exclusive).alias("exclusive_seen"), F.bool_or("returned").alias("reversion_seen"), F.min(status).alias("out_licence"),
    )


@query(f"""WITH {_LINKS}, said AS (
  SELECT asset_id AS claim, returned AS excluded, deal_id, CASE category WHEN '1' THEN 'World' WHEN '2' THEN area ELSE nation END AS via
  FROM links l JOIN companies c ON c.company_id = l.principal_id JOIN areas USING (nation_id)
), up AS (SELECT nation AS place, nation AS via, 0 AS steps FROM areas UNION ALL SELECT nation, area, 1 FROM areas UNION ALL SELECT nation, 'World', 2 FROM areas
), spread AS (SELECT claim, place, via, steps, excluded FROM (SELECT DISTINCT claim, via, excluded FROM said) JOIN up USING (via)
), decided AS (SELECT *, count(DISTINCT excluded) OVER (PARTITION BY claim, place) > 1 AS conflict FROM spread QUALIFY row_number() OVER (PARTITION BY claim, place ORDER BY steps, excluded DESC) = 1
), proof AS (SELECT claim, via, excluded, count(*) AS n_evidence, (list_sort(list(deal_id)))[1:20] AS evidence FROM (SELECT DISTINCT claim, via, excluded, deal_id FROM said) GROUP BY ALL)
SELECT claim AS asset_id, place AS nation, CASE WHEN steps = 0 THEN 'explicitly_' || word ELSE word || '_via_' || lower(via) END AS scope, via, conflict, n_evidence, array_to_string(evidence, ',') AS evidence
FROM (SELECT *, CASE WHEN excluded THEN 'excluded' ELSE 'included' END AS word FROM decided) JOIN proof USING (claim, via, excluded)""")
def territory_rights(d: Domain) -> DataFrame:
    """What deals say about an asset in each nation: the nearest of nation, area and world decides, exclusions first."""
    areas = d.areas()
    home = d.companies().join(areas, "nation_id").select(F.col("company_id").alias("principal_id"), "nation", "area")
    place = F.when(F.col("category") == "1", "World").when(F.col("category") == "2", F.col("area")).otherwise(F.col("nation"))
    claims = asset_links(d).join(home, "principal_id").select(F.col("asset_id").alias("claim"), place.alias("place"), F.col("returned").alias("excluded"), F.col("deal_id").alias("evidence"))
    tree = areas.select(F.col("nation").alias("place"), F.col("area").alias("within")).unionByName(areas.select(F.col("area").alias("place"), F.lit("World").alias("within")))
    told = scopes(claims, areas.select(F.col("nation").alias("place")), ancestry(tree))
    evidence = F.array_join(F.transform("evidence", lambda i: i.cast("string")), ",")
    return told.select(F.col("claim").alias("asset_id"), F.col("place").alias("nation"), "scope", "via", "conflict", "n_evidence", evidence.alias("evidence"))


_DOSSIER = """, summed AS (SELECT subject, section, id, count(*) AS links, max(moment) AS last FROM entries WHERE id IS NOT NULL AND subject IS NOT NULL GROUP BY ALL)
SELECT subject, section, row_number() OVER w AS place, id, links, strftime(last, '%Y-%m-%d') AS last, count(*) OVER (PARTITION BY subject, section) AS "of"
FROM summed WINDOW w AS (PARTITION BY subject, section ORDER BY last DESC NULLS LAST, id) QUALIFY place <= {limit}"""


def _dated(rows: DataFrame) -> DataFrame:
    return rows.select("subject", "section", F.col("place").cast("long").alias("place"), "id", "links", F.date_format("last", "yyyy-MM-dd").alias("last"), "of")


@query(f"""WITH {_LINKS}, entries AS (
  SELECT principal_id AS subject, unnest(['deal', 'asset', 'partner', 'returned']) AS section, unnest([deal_id::VARCHAR, asset_id::VARCHAR, partner_id::VARCHAR, CASE WHEN returned THEN asset_id::VARCHAR END]) AS id,
         unnest([date_start, date_start, date_start, shipped]) AS moment FROM links)""" + _DOSSIER.format(limit=25))
def company_dossiers(d: Domain) -> DataFrame:
    """Deals, assets, partners and returned assets of every company, the newest of each section and how many there are."""
    always = F.lit(True)
    sections = {
        "deal": (F.col("deal_id"), F.col("date_start"), always), "asset": (F.col("asset_id"), F.col("date_start"), always), "partner": (F.col("partner_id"), F.col("date_start"), always),
        "returned": (F.col("asset_id"), F.col("shipped"), F.col("returned")),
    }
    return _dated(dossiers(asset_links(d), "principal_id", sections, 25))


@query(f"""WITH {_LINKS}, entries AS (
  SELECT asset_id AS subject, unnest(['deal', 'principal', 'partner', 'disclosed']) AS section, unnest([deal_id::VARCHAR, principal_id::VARCHAR, partner_id::VARCHAR, CASE WHEN total_value IS NOT NULL THEN deal_id::VARCHAR END]) AS id,
         unnest([date_start, date_start, date_start, date_start]) AS moment FROM links)""" + _DOSSIER.format(limit=10))
def asset_dossiers(d: Domain) -> DataFrame:
    """Deals, principals, partners and disclosed deals of every asset."""
    at, always = F.col("date_start"), F.lit(True)
    sections = {"deal": (F.col("deal_id"), at, always), "principal": (F.col("principal_id"), at, always), "partner": (F.col("partner_id"), at, always), "disclosed": (F.col("deal_id"), at, F.col("total_value").isNotNull())}
    return _dated(dossiers(asset_links(d), "asset_id", sections, 10))


def chained(d: Domain) -> DataFrame:
    """Companies in chains of four: each goes into the one before it."""
    return d.companies().where(F.col("company_id") % 4 > 0).select(F.col("company_id").alias("id"), (F.col("company_id") - 1).alias("into"))


@query("""WITH e AS (SELECT company_id, CASE WHEN company_id % 8 <> 0 THEN name END AS name, CASE WHEN company_id % 4 > 1 THEN company_type END AS company_type, nation_id FROM companies)
SELECT company_id - company_id % 4 AS company_id, arg_min(name, company_id) FILTER (WHERE name IS NOT NULL) AS name, arg_min(company_type, company_id) FILTER (WHERE company_type IS NOT NULL) AS company_type,
 arg_min(nation_id, company_id) AS nation_id FROM e GROUP BY 1""")
def merge_chains(d: Domain) -> DataFrame:
    """Companies merged over chains of redirects; what the one that stays does not know comes from the nearest that went."""
    known = d.companies().select(
        "company_id", F.when(F.col("company_id") % 8 != 0, F.col("name")).alias("name"), F.when(F.col("company_id") % 4 > 1, F.col("company_type")).alias("company_type"), "nation_id"
    )
    return merged(known, chained(d), "company_id", ["name", "company_type", "nation_id"])


@query("""SELECT DISTINCT deal_id, principal_id - principal_id % 4 AS principal_id, category FROM deals""")
def merge_chains_links(d: Domain) -> DataFrame:
    return carried(d.deals().select("deal_id", "principal_id", "category"), chained(d), "principal_id")


@query("""SELECT l_orderkey, l_linenumber, l_quantity, l_tax, 1 AS version FROM lineitem WHERE l_orderkey % 5 <> 0 AND l_shipdate >= TIMESTAMP '1996-01-01'
UNION ALL SELECT l_orderkey, l_linenumber, l_quantity * 2, l_tax, 2 FROM lineitem WHERE l_orderkey % 5 = 0 AND l_tax > 0.01 AND l_shipdate >= TIMESTAMP '1996-01-01'
UNION ALL SELECT l_orderkey, l_linenumber, l_quantity, l_tax, 1 FROM lineitem l WHERE l_orderkey % 5 = 0 AND l_shipdate >= TIMESTAMP '1996-01-01' AND NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = l.l_orderkey AND x.l_tax > 0.01)""")
def replace_children(d: Domain) -> DataFrame:
    """Lines of deals loaded, replaced for every fifth deal by checked newer ones, not replaced by older ones, and purged by age."""
    lines = d.t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_shipdate", F.lit(1).alias("version"))
    store = Children(d.spark, scratch(d.spark, "children"), lines.schema, "l_orderkey", 16)
    store.replace(lines)
    fifth = lines.where(F.col("l_orderkey") % 5 == 0)
    store.store(fifth.withColumn("l_quantity", F.col("l_quantity") * 2).withColumn("version", F.lit(2)), {"taxed": F.col("l_tax") > 0.01}, "version")
    store.replace(fifth.withColumn("l_quantity", F.lit(0.0)), "version")  # older than what most of these deals hold
    store.purge(F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz"))
    store.drop_older()
    return store.read().drop("l_shipdate")


_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"


@query(f"""WITH RECURSIVE b AS (SELECT item_id AS entity, {_WORDS} AS w FROM benchmark
), named AS (
  SELECT entity, array_to_string(w[1:4], ' ') AS alias, least(len(w), 4) AS len, true AS canonical FROM b WHERE len(w) > 0
  UNION SELECT entity, array_to_string(w[5:6], ' '), least(len(w) - 4, 2), false FROM b WHERE len(w) > 4
), told AS (
  SELECT alias, any_value(len) AS len, count(*) AS n, count(*) FILTER (WHERE own) AS n_own, min(entity) AS other, min(entity) FILTER (WHERE own) AS own
  FROM (SELECT alias, len, entity, bool_or(canonical) AS own FROM named GROUP BY ALL) GROUP BY alias
), d AS (SELECT doc_id, row_number() OVER () AS rid, {_WORDS} AS w FROM documents
), p AS (SELECT doc_id, rid, w, unnest(range(len(w))) AS pos FROM d
), hit AS (SELECT doc_id, rid, pos, t.len, t.alias FROM (SELECT *, unnest(range(1, 5)) AS n FROM p) q JOIN told t ON t.len = q.n AND t.alias = array_to_string(w[pos + 1:pos + q.n], ' ') WHERE pos + q.n <= len(w)
), longest AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY rid, pos ORDER BY len DESC) = 1
), walk AS (
  SELECT rid, 0::BIGINT AS fin, NULL::BIGINT AS pos, NULL::VARCHAR AS alias, NULL::BIGINT AS doc_id FROM (SELECT DISTINCT rid FROM longest)
  UNION ALL SELECT m.rid, (m.pos + m.len)::BIGINT, m.pos, m.alias, m.doc_id FROM walk w JOIN longest m ON m.rid = w.rid AND m.pos >= w.fin
  WHERE NOT EXISTS (SELECT 1 FROM longest x WHERE x.rid = w.rid AND x.pos >= w.fin AND x.pos < m.pos)
)
SELECT doc_id, pos AS at_word, alias, CASE WHEN n_own = 1 THEN 'exact' WHEN n = 1 THEN 'plausible' ELSE 'ambiguous' END AS status, CASE WHEN n_own = 1 THEN own WHEN n = 1 THEN other END AS entity,
 CASE WHEN n_own = 1 OR n = 1 THEN 1 ELSE n END AS entities FROM walk JOIN told USING (alias) WHERE pos IS NOT NULL""")
def entity_mentions(d: Domain) -> DataFrame:
    """Subjects named in documents: each has the first four words of its text as its name, the next two as another."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    rows = d.spark.read.parquet(f"{d.dir}/benchmark.parquet").select("item_id", words.alias("w"))
    part = lambda start, size, own: rows.select(F.col("item_id").alias("entity"), F.array_join(F.slice("w", start, size), " ").alias("alias"), F.lit(own).alias("canonical"))
    return mentions(d.t("documents"), part(1, 4, True).unionByName(part(5, 2, False)), "doc_id", "text").withColumnRenamed("at", "at_word")


@query("""WITH names AS (
  SELECT DISTINCT l_orderkey AS subject, 'asset' AS role, upper(p_name) || ' ' || p_size AS name FROM lineitem JOIN part ON p_partkey = l_partkey
  UNION SELECT o_orderkey, 'sponsor', replace(c_name, '#', ' No. ') FROM orders JOIN customer ON c_custkey = o_custkey
  UNION SELECT deal_id, 'area', lower(area) || '.' FROM deal_areas
), aliases AS (
  SELECT 'asset' AS role, p_partkey AS entity, p_name || '-' || p_size AS alias, CASE WHEN p_partkey % 3 = 0 THEN 0.6 ELSE 0.9 END AS confidence FROM part
  UNION ALL SELECT 'sponsor', c_custkey, 'Customer no ' || right(c_name, 9), 0.8 FROM customer UNION ALL SELECT 'area', r_regionkey, r_name, 1.0 FROM region
), keyed AS (
  SELECT role, entity, regexp_replace(lower(alias), '[^a-z0-9]+', '', 'g') AS k, arg_min(alias, alias) AS alias, max(confidence)::DOUBLE AS confidence FROM aliases
  WHERE confidence >= CASE role WHEN 'asset' THEN 0.7 ELSE 0.8 END GROUP BY ALL
)
SELECT subject, n.role, name, entity, alias, confidence FROM names n
JOIN (SELECT *, count(*) OVER (PARTITION BY role, k) AS n_entities FROM keyed) a ON a.role = n.role AND a.k = regexp_replace(lower(name), '[^a-z0-9]+', '', 'g')
WHERE n.role <> 'asset' OR n_entities = 1""")
def trial_links(d: Domain) -> DataFrame:
    """Assets (clear ones only), sponsors and areas that deals name, linked to entities in three steps."""
    part, c = d.t("part"), d.companies()
    name = F.concat(F.upper("p_name"), F.lit(" "), "p_size")
    assets = d.t("lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("subject"), F.lit("asset").alias("role"), name.alias("name"))
    own = part.select(F.col("p_partkey").alias("entity"), F.concat_ws("-", "p_name", "p_size").alias("alias"), F.when(F.col("p_partkey") % 3 == 0, 0.6).otherwise(0.9).alias("confidence"))
    sponsors = d.deals().join(c, F.col("principal_id") == F.col("company_id")).select(F.col("deal_id").alias("subject"), F.lit("sponsor").alias("role"), F.replace("name", F.lit("#"), F.lit(" No. ")).alias("name"))
    companies = c.select(F.col("company_id").alias("entity"), F.concat(F.lit("Customer no "), F.right("name", F.lit(9))).alias("alias"), F.lit(0.8).alias("confidence"))
    areas = d.deal_areas().select(F.col("deal_id").alias("subject"), F.lit("area").alias("role"), F.concat(F.lower("area"), F.lit(".")).alias("name"))
    regions = d.t("region").select(F.col("r_regionkey").cast("long").alias("entity"), F.col("r_name").alias("alias"), F.lit(1.0).alias("confidence"))
    return linked(assets, own, 0.7, True).unionByName(linked(sponsors, companies, 0.8, False)).unionByName(linked(areas, regions, 0.8, False))
