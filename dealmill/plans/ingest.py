"""Ingestion and export operators over records built from the tables at hand, so that an oracle can follow them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealmill.domain import Domain, with_domain
from dealmill.functions import phases
from dealmill.functions.finance import explode_clauses, explode_terms
from dealmill.functions.finance import finance_details as details_of
from dealmill.functions.text import bare_filer_id, canonical_date, domain_name, filer_id
from dealmill.session import delete, scratch, written
from dealmill.sources.archive import KEYS, Archive
from dealmill.sources.readers import item_sections, submission_documents, trial_citations
from dealmill.sources.sinks import calendar_events, csv_ready

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir, f=f: f(Domain(spark, sf_dir))
        if sql:
            SQL[f.__name__] = with_domain(sql)
        return f

    return put


def _contract_lines(d: Domain) -> DataFrame:
    return d.t("lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").cast("int").alias("q"),
        F.floor(100 * F.col("l_discount") + 0.5).cast("int").alias("low"), F.floor(100 * F.col("l_tax") + 10.5).cast("int").alias("high"),
    )


_INTS = "SELECT l_orderkey * 8 + l_linenumber AS id, l_quantity::INT AS q, floor(100 * l_discount + 0.5)::INT AS low, floor(100 * l_tax + 10.5)::INT AS high FROM lineitem"


@query(f"""WITH x AS ({_INTS}) SELECT id, 'upfront' AS kind, q::DOUBLE AS amount, NULL::DOUBLE AS rate_low, NULL::DOUBLE AS rate_high, false AS tiered FROM x
UNION ALL SELECT id, 'royalty', NULL, (CASE WHEN low > 0 THEN least(low, high) ELSE high END)::DOUBLE, greatest(low, high)::DOUBLE, low > 0 AND low <> high FROM x""")
def contract_clauses(d: Domain) -> DataFrame:
    """Clauses of contracts written out from line items: each wording is read once, and told of all contracts that have it."""
    x, wording = _contract_lines(d), ["q", "low", "high"]
    text = F.concat(F.lit("The upfront payment is USD "), F.col("q").cast("string"), F.lit(" million.\n\nRoyalties of "), F.col("low").cast("string"), F.lit("% to "), F.col("high").cast("string"), F.lit("% of net sales."))
    texts = x.select(*wording).distinct().select(F.lit(0).alias("id"), *wording, text.alias("text"))
    clauses = explode_clauses(texts, "id", "text", keep=tuple(wording)).drop("id")
    return x.join(clauses, wording).select("id", "kind", "amount", "rate_low", "rate_high", "tiered")


#: Payloads with what is expected of each of their payments, worked out by hand: term, amount in millions, in USD, rate bounds, confidence, breakdown.
PAYLOADS = (
    (
        """{"PaymentsToPrincipal":{"PaymentsPaid":{"PaymentsGeneral":{"Payment":{"Type":"Upfront Payment","Values":{"@attributes":{"disclosureStatus":"Known"},"ValueReported":{"@text":"1,200","@attributes":{"unit":"Thousand","currency":"EUR"}},"ValueConvertedToUSD":{"@text":"1.5","@attributes":{"unit":"Million"}}},"PaymentBreakdown":{"Payment":[{"Type":"Milestone","Values":{"ValueReported":{"@text":"2","@attributes":{"unit":"Billion"}}}}]}}}}}}""",
        (("upfront_payment", 1.2, 1.5, None, None, 1.0, False), ("milestone_component", 2000.0, None, None, None, 0.5, True)),
    ),
    (
        """{"PaymentsToPartner":{"PaymentsProjectedSigning":{"PaymentsPercentage":{"Payment":[{"Type":"Royalty (%)","Values":{"@attributes":{"accuracy":">=","disclosureStatus":"Known"},"ValueReported":{"@text":"5","@attributes":{"unit":"%"}}}},{"Type":"Transfer Price (%)","Note":"between 3% and more, 12% - 15% later"}]}}}}""",
        (("royalty_rate", None, None, 5.0, None, 1.0, False), ("transfer_price_rate", None, None, 12.0, 15.0, 0.5, False)),
    ),
    (
        """{"PaymentsToPrincipal":{"PaymentsProjectedCurrent":{"PaymentsGeneral":{"Payment":[{"Type":"Up front","Values":{"@attributes":{"disclosureStatus":"Known"},"ValueReported":{"@text":"200","@attributes":{"unit":"%"}},"ValueConvertedToUSD":{"@text":"200","@attributes":{"unit":"Million"}}}},{"Type":"Royalty (%)","Values":{"@attributes":{"accuracy":"=<"},"ValueReported":{"@text":"200","@attributes":{"unit":"%"}}}},{"Type":"Sales Milestones","Values":{"ValueReported":{"@text":"3","@attributes":{"unit":"Trillion"}}}},{"Type":null,"Values":{"ValueReported":{"@text":"soon"}}}]}}}}""",
        (("upfront_payment", 200.0, 200.0, None, None, 1.0, False), ("royalty_rate", None, None, None, 200.0, 0.5, False), ("commercial_milestone", 3e6, None, None, None, 0.5, False), ("unspecified", None, None, None, None, 0.5, False)),
    ),
)
_sql = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"{v}::DOUBLE"
_EXPECTED = ", ".join(f"({k}, {i}, {', '.join(map(_sql, row))})" for k, (_, rows) in enumerate(PAYLOADS) for i, row in enumerate(rows))


@query(f"""WITH e(k, i, term, amount, amount_usd, rate_low, rate_high, confidence, breakdown) AS (VALUES {_EXPECTED})
SELECT l_orderkey * 8 + l_linenumber AS id, term, amount::DOUBLE AS amount, amount_usd::DOUBLE AS amount_usd, rate_low::DOUBLE AS rate_low, rate_high::DOUBLE AS rate_high, confidence, breakdown
FROM lineitem JOIN e ON k = (l_orderkey * 8 + l_linenumber) % {len(PAYLOADS)}""")
def payload_terms(d: Domain) -> DataFrame:
    """Terms of nested finance payloads, one of the literal payloads for each line."""
    id_ = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    payload = F.element_at(F.array(*[F.lit(p) for p, _ in PAYLOADS]), (id_ % len(PAYLOADS) + 1).cast("int"))
    return explode_terms(d.t("lineitem").select(id_.alias("id"), payload.alias("payload")), "id", "payload").select(
        "id", "term", "amount", "amount_usd", "rate_low", "rate_high", "confidence", "breakdown"
    )


@query(f"""WITH x AS ({_INTS}) SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE q::DOUBLE END AS upfront, CASE WHEN id % 3 = 1 THEN 1000.0 * high WHEN id % 3 = 2 THEN high::DOUBLE END AS regulatory,
 CASE WHEN id % 3 = 2 THEN q + 0.5::DOUBLE END AS development, CASE WHEN id % 3 = 0 THEN NULL ELSE low::DOUBLE END AS rate_low, CASE WHEN id % 3 = 1 THEN high::DOUBLE WHEN id % 3 = 2 THEN low::DOUBLE END AS rate_high, id % 3 = 0 AS undisclosed FROM x""")
def finance_details(d: Domain) -> DataFrame:
    """What lines of prose say of money: three wordings, one of which tells nothing."""
    q, low, high = (F.col(c).cast("string") for c in ("q", "low", "high"))
    one = F.concat(F.lit("An upfront payment of $"), q, F.lit(" million, up to €"), high, F.lit(" billion in regulatory milestones and royalties of "), low, F.lit("% to "), high, F.lit("% are due."))
    two = F.concat(F.lit("$"), q, F.lit("M upfront; $"), q, F.lit(".5M in development and commercial milestones; regulatory milestones of up to $"), high, F.lit(" million; "), low, F.lit("% on net sales"))
    told = F.when(F.col("id") % 3 == 0, F.lit("Financial terms not disclosed, though $9 million upfront is said.")).when(F.col("id") % 3 == 1, one).otherwise(two)
    return details_of(_contract_lines(d).select("id", told.alias("text")), "id", "text").select("id", "upfront", "regulatory", "development", "rate_low", "rate_high", "undisclosed")


@query("""SELECT event_id AS id, 'NCT' || lpad(event_id::VARCHAR, 8, '0') AS nct_id, (length(event_type) + 1)::BIGINT AS start FROM events""")
def cited_trials(d: Domain) -> DataFrame:
    text = F.concat("event_type", F.lit(" NCT"), F.lpad(F.col("event_id").cast("string"), 8, "0"), F.lit(", not NCT12"))
    return trial_citations(d.t("events").select(F.col("event_id").alias("id"), text.alias("text")), "id", "text").select("id", "nct_id", "start")


@query("""SELECT o_orderkey AS id, unnest([0, 1]) AS position, unnest(['8-K', 'EX-' || o_orderstatus]) AS type, unnest(['f' || o_orderkey || '.htm', NULL]) AS filename, unnest([o_orderpriority, 'exhibit']) AS content FROM orders""")
def submission_blocks(d: Domain) -> DataFrame:
    text = F.concat(
        F.lit("<SEC-HEADER>\n<DOCUMENT>\n<TYPE>8-K\n<FILENAME>f"), F.col("o_orderkey").cast("string"), F.lit(".htm\n<TEXT>"), "o_orderpriority",
        F.lit("</TEXT>\n</DOCUMENT>\n<DOCUMENT>\n<TYPE>EX-"), "o_orderstatus", F.lit("\n<TEXT>exhibit</TEXT></DOCUMENT>"),
    )
    return submission_documents(d.t("orders").select(F.col("o_orderkey").alias("id"), text.alias("text")), "id", "text")


@query("""SELECT p_partkey AS id, unnest([0, 1]) AS position, unnest(['1.01', '9.' || lpad((p_size % 100)::VARCHAR, 2, '0')]) AS item FROM part WHERE p_partkey % 5 <> 0 UNION ALL SELECT p_partkey, 0, NULL FROM part WHERE p_partkey % 5 = 0""")
def filing_sections(d: Domain) -> DataFrame:
    both = F.concat(F.lit("Item 1.01 Entry\n"), "p_name", F.lit("\nItem 9."), F.lpad((F.col("p_size") % 100).cast("string"), 2, "0"), F.lit(" Exhibits\n"), "p_brand")
    text = F.when(F.col("p_partkey") % 5 == 0, F.col("p_name")).otherwise(both)
    return item_sections(d.t("part").select(F.col("p_partkey").alias("id"), text.alias("text")), "id", "text").select("id", "position", "item")


@query("""SELECT principal_id::VARCHAR AS principal_id, string_agg(DISTINCT status, '; ' ORDER BY status) AS statuses, strftime(max(date_start), '%Y-%m-%dT%H:%M:%S') AS last_deal FROM deals GROUP BY 1""")
def csv_export(d: Domain) -> DataFrame:
    """The frame that a CSV sink writes: array cells joined, times as text."""
    by = d.deals().groupBy(F.col("principal_id").cast("string").alias("principal_id")).agg(F.sort_array(F.collect_set("status")).alias("statuses"), F.max("date_start").alias("last_deal"))
    return csv_ready(by)


@query("""SELECT 'BEGIN:VEVENT' || chr(10) || 'UID:' || deal_id || chr(10) || 'DTSTART;VALUE=DATE:' || strftime(date_start, '%Y%m%d') || chr(10) || 'DTEND;VALUE=DATE:' || strftime(date_start + INTERVAL 1 DAY, '%Y%m%d') || chr(10) || 'SUMMARY:' || agreement_type || '\\, ' || status || chr(10) || 'DESCRIPTION:' || status || chr(10) || 'END:VEVENT' AS event FROM deals""")
def calendar_export(d: Domain) -> DataFrame:
    rows = d.deals().select("deal_id", "date_start", F.concat("agreement_type", F.lit(", "), "status").alias("title"), "status")
    return calendar_events(rows, "deal_id", "date_start", "title", "status")


_PHASE_ROWS = ", ".join(f"({i}, '{n}', '{c}', {r})" for i, (n, c, r) in enumerate(phases.PHASES))
_PHASES_SQL = f"""ph(i, name, code, rank) AS (VALUES {_PHASE_ROWS}),
drug AS (SELECT l_orderkey AS deal_id, l_orderkey * 8 + l_linenumber AS drug_id, a.name AS start_name, a.code AS start_id, a.rank AS start_rank, b.name AS now, b.rank AS now_rank
 FROM lineitem JOIN ph a ON a.i = l_partkey % {len(phases.PHASES)} JOIN ph b ON b.i = (l_partkey + l_linenumber) % {len(phases.PHASES)})"""


def _phase_records(d: Domain) -> DataFrame:
    """deal_id, xml: one expanded record for each deal; the phase at the start carries its id, the current one only its name."""
    pick = lambda i, field: F.element_at(F.array(*[F.lit(p[field]) for p in phases.PHASES]), (i % len(phases.PHASES) + 1).cast("int"))
    part, line = F.col("l_partkey"), F.col("l_linenumber")
    drug = F.concat(
        F.lit('<Drug id="'), (F.col("l_orderkey") * 8 + line).cast("string"), F.lit('"><DrugNameDisplay>x</DrugNameDisplay><PhaseHighestStart id="'), pick(part, 1), F.lit('"> '), pick(part, 0),
        F.lit(" </PhaseHighestStart><PhaseHighestNow>"), pick(part + line, 0), F.lit("</PhaseHighestNow></Drug>"),
    )
    rows = d.t("lineitem").groupBy(F.col("l_orderkey").alias("deal_id")).agg(F.sort_array(F.collect_list(drug)).alias("drugs"))
    return rows.select("deal_id", F.concat(F.lit("<Deal><Drugs>"), F.array_join("drugs", ""), F.lit("</Drugs></Deal>")).alias("xml"))


@query(f"WITH {_PHASES_SQL} SELECT deal_id, max_by(start_name, (start_rank, start_name)) AS at_start, max_by(now, (now_rank, now)) AS now FROM drug GROUP BY 1")
def deal_phases(d: Domain) -> DataFrame:
    """A deal's highest phases, read from its archived XML record; of equal ranks the last by name."""
    return phases.deal_phases(phases.drug_phases(_phase_records(d), "deal_id", "xml"), "deal_id")


@query(f"WITH {_PHASES_SQL} SELECT deal_id, drug_id, start_name AS start, start_id, now, NULL::VARCHAR AS now_id FROM drug")
def drug_phases(d: Domain) -> DataFrame:
    return phases.drug_phases(_phase_records(d), "deal_id", "xml").drop("name")


@query("""SELECT c_custkey AS id, lpad(c_custkey::VARCHAR, 10, '0') AS filer, c_custkey::VARCHAR AS bare, lower(replace(c_name, '#', '-')) || '.com' AS host, make_date(1990 + (c_custkey % 30)::INT, (1 + c_custkey % 12)::INT, 1)::VARCHAR AS day FROM customer WHERE c_custkey > 0""")
def normalised_identifiers(d: Domain) -> DataFrame:
    c = d.t("customer").where(F.col("c_custkey") > 0)
    key = F.col("c_custkey").cast("string")
    url = F.concat(F.lit("https://www."), F.replace("c_name", F.lit("#"), F.lit("-")), F.lit(".COM:443/a?b#c"))
    raw = F.concat((1990 + F.col("c_custkey") % 30).cast("string"), F.lit("-"), F.lpad((1 + F.col("c_custkey") % 12).cast("string"), 2, "0"))
    return c.select(F.col("c_custkey").alias("id"), filer_id(F.concat(F.lit("CIK "), key)).alias("filer"), bare_filer_id(F.lpad(key, 10, "0")).alias("bare"), domain_name(url).alias("host"), canonical_date(raw).cast("string").alias("day"))


@query("""SELECT page_id, count(*) AS kept FROM (SELECT DISTINCT page_id % 50 AS page_id, sha256(html) AS sha FROM pages) GROUP BY 1""")
def raw_archive(d: Domain) -> DataFrame:
    """Distinct contents for each archived record; digests are compared, bodies are not shuffled."""
    rows = d.t("pages").select((F.col("page_id") % 50).alias("page_id"), F.sha2(F.col("html").cast("binary"), 256).alias("sha"))
    return rows.distinct().groupBy("page_id").agg(F.count(F.lit(1)).alias("kept"))


@query("""WITH r AS (SELECT 'web' AS source, (page_id % 40)::VARCHAR AS id, sha256(html) AS sha256, TIMESTAMP '2024-01-01' + to_days((page_id // 40)::INTEGER) AS t FROM pages
 UNION ALL SELECT 'web', (page_id % 40)::VARCHAR, sha256(html), TIMESTAMP '2024-03-01' FROM pages WHERE page_id % 3 = 0
 UNION ALL SELECT 'web', (page_id % 40)::VARCHAR, sha256(upper(url)), TIMESTAMP '2024-03-02' FROM pages WHERE page_id < 5),
c AS (SELECT source, id, sha256, min(t) AS first_fetched, max(t) AS last_fetched, count(DISTINCT t) AS fetches FROM r GROUP BY ALL),
n AS (SELECT DISTINCT ON (source, id) source, id, sha256 FROM r ORDER BY source, id, t DESC, sha256 DESC)
SELECT c.*, n.sha256 IS NOT NULL AS newest FROM c LEFT JOIN n USING (source, id, sha256)""")
def archive_fetches(d: Domain) -> DataFrame:
    """Three runs over the pages: all of them, a third again as they were, a few with another content; then each content's times."""
    archive = Archive(d.spark, scratch(d.spark, "archive"))
    pages = d.t("pages").withColumns({"source": F.lit("web"), "id": F.col("page_id") % 40})
    day = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.floor(F.col("page_id") / 40).cast("int"))
    at = lambda text: F.lit(text).cast("timestamp_ntz")
    archive.add(pages.select("source", "id", F.col("html").alias("body"), day.alias("fetched_at")))
    archive.add(pages.where(F.col("page_id") % 3 == 0).select("source", "id", F.col("html").alias("body"), at("2024-03-01").alias("fetched_at")))
    archive.add(pages.where(F.col("page_id") < 5).select("source", "id", F.upper("url").alias("body"), at("2024-03-02").alias("fetched_at")))
    newest = archive.current().select(*KEYS, F.lit(True).alias("newest"))
    out = written(archive.contents().join(newest, KEYS, "left").withColumn("newest", F.coalesce("newest", F.lit(False))), "archive-contents")
    delete(d.spark, archive.folder)
    return out
