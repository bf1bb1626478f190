"""The lists of the data access surface, each a page behind a cursor, and search over groups under a policy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealmill.domain import Domain, with_domain
from dealmill.operators.filters import any_of, contains
from dealmill.operators.listing import Group, Listing, grouped_search

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir, f=f: f(Domain(spark, sf_dir))
        if sql:
            SQL[f.__name__] = with_domain(sql)
        return f

    return put


def holds(*columns: str):
    """A filter: one of the columns contains the text."""
    return lambda rows, v: rows.where(any_of([F.coalesce(contains(F.col(c), v), F.lit(False)) for c in columns]))


def equal(column: str):
    return lambda rows, v: rows.where(F.col(column) == F.lit(v))


def linked(links: DataFrame, key: str, column: str):
    """A filter: a link of the row has the value."""
    return lambda rows, v: rows.join(links.where(F.col(column) == F.lit(v)).select(key), key, "left_semi")


def counted(links: DataFrame, key: str, other: str, name: str):
    """Details: how many different others a row is linked with. Links are cut to the page before they are counted."""

    def fill(page: DataFrame) -> DataFrame:
        n = links.join(F.broadcast(page.select(key)), key, "left_semi").groupBy(key).agg(F.countDistinct(other).alias(name))  # a page has 100 rows at most
        return page.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))

    return fill


def deals(d: Domain) -> Listing:
    roles = d.deal_roles()
    paid = d.t("lineitem").select(F.col("l_orderkey").alias("deal_id"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"))

    def finance(page: DataFrame) -> DataFrame:
        sums = paid.join(F.broadcast(page.select("deal_id")), "deal_id", "left_semi").groupBy("deal_id").agg(F.sum("amount").cast("double").alias("paid"))
        return page.join(sums, "deal_id", "left")

    return Listing(
        d.deals().select("deal_id", "status", "agreement_type", "date_start", "total_value"), ("deal_id",),
        {"query": holds("agreement_type", "status"), "company": linked(roles, "deal_id", "company"), "asset_id": linked(d.deal_assets(), "deal_id", "asset_id"),
         "area": linked(d.deal_areas(), "deal_id", "area")}, finance,
    )


def terms(d: Domain) -> Listing:
    """Payments in the order of their deal; a deal's lines can share a number, so the rest of a row is part of its place."""
    rows = d.t("lineitem").select(
        F.col("l_orderkey").alias("deal_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("asset_id"), F.col("l_suppkey").alias("partner_id"),
        F.col("l_extendedprice").alias("amount"), F.col("l_returnflag").alias("kind"), F.greatest("l_discount", "l_tax").alias("rate"),
    )
    at_least = lambda c: lambda rows, v: rows.where(F.col(c) >= F.lit(v))
    titles = d.deals().select("deal_id", F.col("agreement_type").alias("title"))
    return Listing(
        rows, ("deal_id", "line", "asset_id", "partner_id", "amount"), {"deal_id": equal("deal_id"), "kind": equal("kind"), "min_amount": at_least("amount"), "min_rate": at_least("rate")},
        lambda page: F.broadcast(page).join(titles, "deal_id"),
    )


def companies(d: Domain) -> Listing:
    links = d.deals().select(F.col("principal_id").alias("company_id"), "deal_id")
    count = counted(links, "company_id", "deal_id", "deal_count")
    ids = lambda page: page.withColumn("identifiers", F.array(F.struct(F.lit("filer").alias("type"), F.lpad(F.col("company_id").cast("string"), 10, "0").alias("value"))))
    return Listing(d.companies().select("company_id", "name", "company_type"), ("company_id",), {"query": holds("name")}, lambda page: ids(count(page)))


def drugs(d: Domain) -> Listing:
    rows = d.t("part").select(F.col("p_partkey").alias("asset_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("alias"), F.col("p_size").alias("phase"))
    return Listing(rows, ("asset_id",), {"query": holds("name", "alias")}, counted(d.deal_assets(), "asset_id", "deal_id", "deal_count"))


def trials(d: Domain) -> Listing:
    """Telemetry's events as trial records: an id of text, a status, a sponsor."""
    number = F.concat(F.lit("NCT"), F.lpad(F.col("event_id").cast("string"), 8, "0"))
    rows = d.t("events").select(number.alias("nct_id"), F.upper("event_type").alias("status"), F.col("user_id").alias("company_id"), "ts")
    return Listing(rows, ("nct_id",), {"status": lambda r, v: r.where(F.col("status") == v.upper()), "company_id": equal("company_id")})


def _concepts(d: Domain, symbol) -> tuple[DataFrame, DataFrame]:
    links = d.t("part").select(symbol.alias("concept"), F.col("p_partkey").alias("asset_id")).where(F.col("concept").isNotNull() & (F.col("concept") != ""))
    return links.select("concept").distinct(), links


def targets(d: Domain) -> Listing:
    rows, links = _concepts(d, F.split_part("p_name", F.lit(" "), F.lit(2)))
    return Listing(rows, ("concept",), {"query": holds("concept")}, counted(links, "concept", "asset_id", "linked_drugs"))


def diseases(d: Domain) -> Listing:
    rows, links = _concepts(d, F.col("p_type"))
    return Listing(rows, ("concept",), {"query": holds("concept")}, counted(links, "concept", "asset_id", "linked_drugs"))


def documents(d: Domain) -> Listing:
    """Metadata alone: no text is read."""
    return Listing(d.t("documents").select("doc_id", "lang", "source", "n_chars"), ("doc_id",), {"source": equal("source"), "lang": equal("lang")})


@query("""WITH q AS (SELECT * FROM deals WHERE deal_id > 100 AND (agreement_type ILIKE '%urgent%' OR status ILIKE '%urgent%') AND deal_id IN (SELECT deal_id FROM deal_areas WHERE area = 'ASIA'))
SELECT deal_id, status, agreement_type, date_start, total_value, (SELECT sum(l_extendedprice::DECIMAL(18,2))::DOUBLE FROM lineitem WHERE l_orderkey = deal_id) AS paid, (SELECT count(*) FROM q) > 30 AS has_more
FROM q ORDER BY deal_id LIMIT 30""")
def list_deals(d: Domain) -> DataFrame:
    return deals(d).page(30, [100], query="urgent", area="ASIA")


@query("""WITH q AS (SELECT l_orderkey AS deal_id, l_linenumber AS line, l_partkey AS asset_id, l_suppkey AS partner_id, l_extendedprice AS amount, l_returnflag AS kind, greatest(l_discount, l_tax) AS rate FROM lineitem
 WHERE l_returnflag = 'R' AND l_extendedprice >= 20000 AND greatest(l_discount, l_tax) >= 0.04 AND (l_orderkey > 300 OR l_orderkey = 300 AND l_linenumber > 2))
SELECT q.*, agreement_type AS title, (SELECT count(*) FROM q) > 100 AS has_more FROM q JOIN deals USING (deal_id) ORDER BY deal_id, line, asset_id, partner_id, amount LIMIT 100""")
def list_terms(d: Domain) -> DataFrame:
    """Behind every row of deal 300 whose line is 2: the highest place that such a row can have."""
    end = 2**62
    return terms(d).page(100, [300, 2, end, end, float("inf")], kind="R", min_amount=20000.0, min_rate=0.04)


@query("""WITH q AS (SELECT * FROM companies WHERE company_id > 40 AND name ILIKE '%7%')
SELECT company_id, name, company_type, (SELECT count(*) FROM deals WHERE principal_id = company_id) AS deal_count, lpad(company_id::VARCHAR, 10, '0') AS filer, (SELECT count(*) FROM q) > 50 AS has_more FROM q ORDER BY 1 LIMIT 50""")
def list_companies(d: Domain) -> DataFrame:
    return companies(d).page(50, [40], query="7").withColumn("filer", F.col("identifiers")[0]["value"]).drop("identifiers")


@query("""WITH q AS (SELECT p_partkey AS asset_id, p_name AS name, p_brand AS alias, p_size AS phase FROM part WHERE p_partkey > 10 AND (p_name ILIKE '%blue%' OR p_brand ILIKE '%blue%'))
SELECT q.*, (SELECT count(DISTINCT deal_id) FROM deal_assets a WHERE a.asset_id = q.asset_id) AS deal_count, (SELECT count(*) FROM q) > 40 AS has_more FROM q ORDER BY asset_id LIMIT 40""")
def list_drugs(d: Domain) -> DataFrame:
    return drugs(d).page(40, [10], query="blue")


@query("""WITH q AS (SELECT 'NCT' || lpad(event_id::VARCHAR, 8, '0') AS nct_id, upper(event_type) AS status, user_id AS company_id, ts FROM events WHERE event_type = 'error' AND event_id > 200)
SELECT q.*, (SELECT count(*) FROM q) > 50 AS has_more FROM q ORDER BY nct_id LIMIT 50""")
def list_trials(d: Domain) -> DataFrame:
    return trials(d).page(50, ["NCT00000200"], status="error")


@query("""WITH q AS (SELECT split_part(p_name, ' ', 2) AS concept, count(*) AS linked_drugs FROM part WHERE split_part(p_name, ' ', 2) > 'b' GROUP BY 1)
SELECT q.*, (SELECT count(*) FROM q) > 3 AS has_more FROM q ORDER BY concept LIMIT 3""")
def list_targets(d: Domain) -> DataFrame:
    return targets(d).page(3, ["b"])


@query("""WITH q AS (SELECT p_type AS concept, count(*) AS linked_drugs FROM part WHERE p_type ILIKE '%o%' GROUP BY 1) SELECT q.*, (SELECT count(*) FROM q) > 2 AS has_more FROM q ORDER BY concept LIMIT 2""")
def list_diseases(d: Domain) -> DataFrame:
    return diseases(d).page(2, query="o")


@query("""WITH q AS (SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'en' AND doc_id > 20) SELECT q.*, (SELECT count(*) FROM q) > 100 AS has_more FROM q ORDER BY doc_id LIMIT 100""")
def list_documents(d: Domain) -> DataFrame:
    return documents(d).page(100, [20], lang="en")


@query("""SELECT event_type AS source_key, max(ts) AS last_success_at, count(*) AS records, CASE WHEN max(ts) < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR THEN 'stale' ELSE 'ok' END AS status FROM events GROUP BY 1""")
def list_status(d: Domain) -> DataFrame:
    """The state of each source: partial sums a task, then a window over one row a source."""
    by = d.t("events").groupBy(F.col("event_type").alias("source_key")).agg(F.max("ts").alias("last_success_at"), F.count(F.lit(1)).alias("records"))
    newest = by.agg(F.max("last_success_at").alias("newest"))
    late = F.col("last_success_at") < F.col("newest") - F.expr("INTERVAL 1 HOUR")
    return by.crossJoin(newest).select("source_key", "last_success_at", "records", F.when(late, "stale").otherwise("ok").alias("status"))


def groups(d: Domain) -> dict[str, Group]:
    firms = d.companies().select(F.col("company_id").alias("id"), "name").unionByName(d.partners().select((-F.col("partner_id") - 1).alias("id"), F.col("partner").alias("name")))
    concept = lambda listing: listing.rows.select(F.col("concept").alias("id"), F.col("concept").alias("name"))
    return {
        "deals": Group(d.deals().select(F.col("deal_id").alias("id"), F.concat_ws(" ", "agreement_type", "status", F.col("deal_id").cast("string")).alias("name")), "deals"),
        "assets": Group(d.t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("alias")), "deals", ("alias",)),
        "companies": Group(firms, "companies"),
        "targets": Group(concept(targets(d)), "public"),
        "diseases": Group(concept(diseases(d)), "public"),
    }


_GROUPS = """WITH g(dataset, policy, granted) AS (VALUES ('deals', 'deals', true), ('assets', 'deals', true), ('companies', 'companies', false), ('targets', 'public', true), ('diseases', 'public', true)),
r AS (SELECT 'deals' AS dataset, deal_id::VARCHAR AS id, deal_id AS n, concat_ws(' ', agreement_type, status, deal_id) AS name, NULL AS alias FROM deals
 UNION ALL SELECT 'assets', p_partkey::VARCHAR, p_partkey, p_name, p_brand FROM part
 UNION ALL SELECT DISTINCT 'targets', split_part(p_name, ' ', 2), 0, split_part(p_name, ' ', 2), NULL FROM part UNION ALL SELECT DISTINCT 'diseases', p_type, 0, p_type, NULL FROM part),
h AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY CASE WHEN lower(name) = 'ri' THEN 0 WHEN starts_with(lower(name), 'ri') THEN 1 ELSE 2 END, length(name), name, n) AS place FROM r WHERE contains(lower(name), 'ri') OR contains(lower(alias), 'ri')),
t AS (SELECT *, count(*) OVER (PARTITION BY dataset) AS k FROM h WHERE place <= 10)
SELECT dataset, policy, granted, coalesce(k, 0) AS returned, place::INT AS place, id, name FROM g LEFT JOIN t USING (dataset)"""


@query(_GROUPS)
def federated_groups(d: Domain) -> DataFrame:
    """Five groups in order of fit; the caller has no grant for companies, so that table isn't read."""
    return grouped_search(d.spark, groups(d), "ri", ("deals", "public"))
