"""Deal search by evidence: aliases, modalities, concepts, territories, child events and terms, and a page's details."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealmill.domain import Domain, with_domain
from dealmill.operators.evidence import Between, Child, Companies, Criterion, During, Evidence, Named, satisfying, told_by
from dealmill.operators.filters import Dates, Scalar

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir, f=f: f(Domain(spark, sf_dir))
        if sql:
            SQL[f.__name__] = with_domain(sql)
        return f

    return put


def flags(d: Domain) -> DataFrame:
    """Deals with their own switches: open ones are optional, halted ones leave it open; those above 250,000 need approval, those without a value leave it open."""
    return d.deals().withColumns({
        "is_optional": F.when(F.col("status") == "O", True).when(F.col("status") == "F", False),
        "needs_approval": F.col("total_value") > 250000,
    })


@dataclass(frozen=True)
class Switches:
    """Tri-state: None asks nothing, True and False ask for exactly that; unknown is neither."""

    is_optional: bool | None = None
    needs_approval: bool | None = None

    def on(self, deals: DataFrame) -> DataFrame:
        for name, asked in (("is_optional", self.is_optional), ("needs_approval", self.needs_approval)):
            if asked is not None:
                deals = deals.where(F.col(name).eqNullSafe(F.lit(asked)))
        return deals


def children(d: Domain) -> list[Child]:
    """What the tables tell of deals.

    Lines with their part: the asset (its name, the brand as the deal's alias, the type as a public one), its modality
    (the line's status by the deal, the type in public), its target (the name's last word in public, with the name's
    first word as action), dates, royalties and discounts. Companies: name and short name, with role and place. The
    deal itself: title, target by the deal, summary, therapy area.
    """
    c = F.col
    part = d.t("part").select(c("p_partkey").alias("asset_id"), "p_name", "p_brand", "p_type")
    lines = d.t("lineitem").select(
        c("l_orderkey").alias("deal_id"), c("l_partkey").alias("asset_id"), "l_linestatus", "l_returnflag", "l_discount", "l_tax", "l_extendedprice", "l_shipdate",
        F.when(c("l_linenumber") != 1, c("l_shipdate")).alias("signed"),
    )
    rows = lines.join(part, "asset_id", "left")
    of_lines = (
        Evidence("asset", "deal", (c("p_name"), c("p_brand")), c("asset_id").cast("string")),
        Evidence("asset", "public", (c("p_type"),)),
        Evidence("modality", "deal", (c("l_linestatus"),)),
        Evidence("modality", "public", (c("p_type"),)),
        Evidence("target", "public", (F.split_part("p_name", F.lit(" "), F.lit(2)),), refinement=F.split_part("p_name", F.lit(" "), F.lit(1))),
        Evidence("asset_name", "deal", (c("p_name"),)),
        Evidence("asset_alias", "deal", (c("p_brand"),)),
        Evidence("event", "deal", at=c("l_shipdate")),
        Evidence("contract", "deal", at=F.coalesce(c("signed"), c("l_shipdate") + F.expr("INTERVAL 3 DAYS"))),
        Evidence("royalty", "deal", number=F.greatest("l_discount", "l_tax"), where=c("l_returnflag") == "R"),
        Evidence("milestone", "deal", number=c("l_extendedprice"), where=c("l_returnflag") == "A"),
    )
    firm = lambda rows, prefix, role: rows.select(
        "deal_id", c("name"), F.concat(F.lit(prefix), c("company_id").cast("string")).alias("company"), F.lit(role).alias("role"), "nation", "area", c("nation_id").cast("string").alias("place"))
    principals = firm(d.deals().select("deal_id", c("principal_id").alias("company_id")).join(d.companies(), "company_id").join(d.areas(), "nation_id"), "C", "Principal")
    partners = d.partners().select(c("partner_id").alias("company_id"), c("partner").alias("name"), "nation_id")
    partners = firm(d.deal_partners().withColumnRenamed("partner_id", "company_id").join(partners, "company_id").join(d.areas(), "nation_id"), "S", "Partner")
    of_firms = (
        Evidence("company", "deal", (c("name"), c("company")), c("company"), refinement=c("role")),
        Evidence("territory", "deal", (c("nation"),), c("place")),
        Evidence("therapy_area", "deal", (c("area"),), where=c("role") == "Principal"),
    )
    of_deals = (
        Evidence("title", "deal", (c("agreement_type"),)),
        Evidence("summary", "deal", (F.concat_ws(" ", c("category"), c("status")),)),
        Evidence("target", "deal", (c("agreement_type"),), refinement=c("status")),
    )
    return [Child(rows, of_lines), Child(principals.unionByName(partners), of_firms), Child(d.deals(), of_deals)]


def search(d: Domain, criteria: list[Criterion], switches: Switches | None = None) -> DataFrame:
    deals = flags(d)
    return satisfying(switches.on(deals) if switches else deals, "deal_id", children(d), criteria)


_LINES = "(SELECT l_orderkey AS deal_id, l_linestatus, l_returnflag, l_discount, l_tax, l_extendedprice, l_shipdate, l_linenumber, l_partkey, p_name, p_brand, p_type FROM lineitem LEFT JOIN part ON p_partkey = l_partkey)"
_FIRMS = """(SELECT deal_id, 'C' || company_id AS company, name, 'Principal' AS role, nation_id, nation, area FROM deals JOIN companies ON company_id = principal_id JOIN areas USING (nation_id)
 UNION ALL SELECT deal_id, 'S' || partner_id, partner, 'Partner', nation_id, nation, area FROM deal_partners JOIN partners USING (partner_id) JOIN areas USING (nation_id))"""
_SOME = "EXISTS (SELECT 1 FROM {rows} x WHERE x.deal_id = d.deal_id AND ({test}))"


def _some(test: str, rows: str = _LINES) -> str:
    return _SOME.format(rows=rows, test=test)


@query(f"SELECT deal_id FROM deals d WHERE {_some("p_name ILIKE '%widget%' OR p_brand ILIKE '%widget%'")} AND {_some("p_name ILIKE '%brand#1%' OR p_brand ILIKE '%brand#1%'")} AND NOT ({_some("p_name ILIKE '%red%' OR p_brand ILIKE '%red%'")})")
def evidence_assets(d: Domain) -> DataFrame:
    """Assets by name or by the deal's aliases: any, all, none; public aliases are not allowed."""
    return search(d, [Named("asset", ("deal",), any=("widget",), all=("brand#1",), exclude=("red",))]).select("deal_id")


@query(f"""SELECT 'deal' AS how, deal_id FROM deals d WHERE {_some("l_linestatus ILIKE '%o%'")}
UNION ALL SELECT 'public', deal_id FROM deals d WHERE {_some("p_type ILIKE '%o%'")}
UNION ALL SELECT 'without', deal_id FROM deals d WHERE NOT ({_some("l_linestatus ILIKE '%o%' OR p_type ILIKE '%promo%' OR p_type ILIKE '%o%' OR l_linestatus ILIKE '%promo%'")})""")
def evidence_modality(d: Domain) -> DataFrame:
    """Modality by who says so; without any allowed source nothing is found ("nobody" adds no row)."""
    told = lambda how, c: search(d, [c]).select(F.lit(how).alias("how"), "deal_id")
    out = told("deal", Named("modality", ("deal",), any=("o",))).unionByName(told("public", Named("modality", ("public",), any=("o",))))
    return out.unionByName(told("without", Named("modality", exclude=("promo", "o")))).unionByName(told("nobody", Named("modality", (), any=("o",))))


@query(f"""SELECT deal_id FROM deals d WHERE ({_some("split_part(p_name, ' ', 2) ILIKE '%ring%' AND split_part(p_name, ' ', 1) ILIKE '%blue%'")}
 OR agreement_type ILIKE '%ring%' AND status ILIKE '%blue%') AND is_optional IS TRUE AND (total_value > 250000) IS NOT TRUE AND total_value IS NOT NULL""".replace("is_optional", "(CASE status WHEN 'O' THEN true WHEN 'F' THEN false END)"))
def evidence_concept(d: Domain) -> DataFrame:
    """A target with its action in one row, by public or by the deal's evidence, in optional deals that need no approval."""
    return search(d, [Named("target", any=("ring",), refinement=Scalar(include=("blue",)))], Switches(is_optional=True, needs_approval=False)).select("deal_id")


@query(f"""SELECT deal_id FROM deals d WHERE {_some("(name ILIKE '%supplier#000000001%' OR company ILIKE '%supplier#000000001%') AND role IN ('Partner')", _FIRMS)}
 AND {_some("nation_id = 7 OR nation ILIKE '%nation_1%'", _FIRMS)} AND NOT ({_some("nation ILIKE '%nation_2%'", _FIRMS)})
UNION ALL SELECT deal_id FROM deals d WHERE {_some("company = 'S5'", _FIRMS)} AND {_some("name ILIKE '%c1%' OR company ILIKE '%c1%'", _FIRMS)}""")
def evidence_companies(d: Domain) -> DataFrame:
    """Companies by id or by name and short name, with roles; places by id or name."""
    first = search(d, [Companies("company", several=((None, "supplier#000000001", ("Partner",)),)), Named("territory", any=("nation_1",), ids=("7",), exclude=("nation_2",))])
    return first.select("deal_id").unionByName(search(d, [Companies("company", several=(("S5", None, ()), (None, "c1", ())))]).select("deal_id"))


@query(f"""SELECT deal_id FROM deals d WHERE {_some("l_shipdate >= TIMESTAMP '1996-05-01' AND l_shipdate < TIMESTAMP '1996-06-01'")}
 AND {_some("coalesce(CASE WHEN l_linenumber <> 1 THEN l_shipdate END, l_shipdate + INTERVAL 3 DAY) >= TIMESTAMP '1998-01-01'")}""")
def evidence_dates(d: Domain) -> DataFrame:
    """An event of the timeline in a month, and a contract (its date, else its filing's) from a day on."""
    return search(d, [During("event", days=Dates(dt.date(1996, 5, 1), dt.date(1996, 5, 31))), During("contract", days=Dates(gte=dt.date(1998, 1, 1)))]).select("deal_id")


@query(f"""SELECT deal_id FROM deals d WHERE ({_some("l_returnflag = 'R' AND greatest(l_discount, l_tax) BETWEEN 0.07 AND 0.09")} OR NOT {_some("l_returnflag = 'R'")})
 AND {_some("l_returnflag = 'A' AND l_extendedprice >= 60000")}""")
def evidence_terms(d: Domain) -> DataFrame:
    """A royalty in a range, or none told at all, and a milestone from an amount on."""
    return search(d, [Between("royalty", gte=0.07, lte=0.09, unknown=True), Between("milestone", gte=60000.0)]).select("deal_id")


#: What a topic may stand in: the deal's title and summary, its companies, places, assets with their aliases, area and modality.
TOPIC = ("title", "summary", "company", "territory", "asset_name", "asset_alias", "therapy_area", "modality")
_TOLD = " UNION ALL ".join([
    "SELECT deal_id, 'title' AS s FROM deals WHERE agreement_type ILIKE '%um%'", "SELECT deal_id, 'summary' FROM deals WHERE concat_ws(' ', category, status) ILIKE '%um%'",
    f"SELECT deal_id, 'company' FROM {_FIRMS} WHERE name ILIKE '%um%' OR company ILIKE '%um%'", f"SELECT deal_id, 'territory' FROM {_FIRMS} WHERE nation ILIKE '%um%'",
    f"SELECT deal_id, 'therapy_area' FROM {_FIRMS} WHERE role = 'Principal' AND area ILIKE '%um%'", f"SELECT deal_id, 'asset_name' FROM {_LINES} WHERE p_name ILIKE '%um%'",
    f"SELECT deal_id, 'asset_alias' FROM {_LINES} WHERE p_brand ILIKE '%um%'", f"SELECT deal_id, 'modality' FROM {_LINES} WHERE l_linestatus ILIKE '%um%' OR p_type ILIKE '%um%'",
])


@query(f"SELECT deal_id, string_agg(DISTINCT s, ',' ORDER BY s) AS told FROM ({_TOLD}) GROUP BY 1")
def topic_evidence(d: Domain) -> DataFrame:
    """Deals on a topic, with where it was found: one aggregation over three kinds of child rows."""
    return told_by("deal_id", children(d), {k: Named(k, any=("um",)) for k in TOPIC}).select("deal_id", F.array_join("told", ",").alias("told"))


def detail(d: Domain, deals: DataFrame) -> DataFrame:
    """A page of deals filled in: parties by role, assets, places, timeline and payments, as arrays of structs.

    The page is cut before: its few keys reach each table as a semi join, and no child is read per deal.
    """
    keys = deals.select("deal_id")
    firms = d.deal_roles().join(keys, "deal_id", "left_semi").groupBy("deal_id").agg(F.sort_array(F.collect_set(F.struct("role", "company"))).alias("parties"))
    lines = d.t("lineitem").withColumnRenamed("l_orderkey", "deal_id").join(keys, "deal_id", "left_semi")
    lines = lines.join(d.t("part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey", "left")
    lines = lines.groupBy("deal_id").agg(
        F.sort_array(F.collect_set(F.struct(F.col("l_partkey").alias("asset_id"), F.col("p_name").alias("name")))).alias("assets"),
        F.sort_array(F.collect_list(F.struct(F.to_date("l_shipdate").alias("day"), F.col("l_linenumber").alias("line")))).alias("timeline"),
        F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("kind"), F.col("l_extendedprice").alias("amount")))).alias("terms"),
    )
    place = d.deal_areas().join(keys, "deal_id", "left_semi").select("deal_id", "nation", "area")
    return deals.join(firms, "deal_id", "left").join(lines, "deal_id", "left").join(place, "deal_id", "left")


@query(f"""WITH p AS (SELECT * FROM deals d WHERE {_some("l_shipdate >= TIMESTAMP '1996-05-01' AND l_shipdate < TIMESTAMP '1996-06-01'")} ORDER BY total_value DESC NULLS LAST, deal_id LIMIT 20)
SELECT deal_id, status, nation, area,
 (SELECT string_agg(role || ':' || company, ';' ORDER BY role, company) FROM (SELECT DISTINCT role, company FROM deal_roles r WHERE r.deal_id = p.deal_id)) AS parties,
 (SELECT string_agg(asset_id || ' ' || p_name, ';' ORDER BY asset_id) FROM (SELECT DISTINCT l_partkey AS asset_id, p_name FROM {_LINES} x WHERE x.deal_id = p.deal_id)) AS assets,
 (SELECT string_agg(l_shipdate::DATE::VARCHAR, ';' ORDER BY l_shipdate, l_linenumber) FROM lineitem WHERE l_orderkey = p.deal_id) AS timeline,
 (SELECT count(*) FROM lineitem WHERE l_orderkey = p.deal_id) AS n_terms
FROM p LEFT JOIN (SELECT deal_id, nation, area FROM deal_areas) USING (deal_id)""")
def deal_details(d: Domain) -> DataFrame:
    cut = search(d, [During("event", days=Dates(dt.date(1996, 5, 1), dt.date(1996, 5, 31)))]).orderBy(F.col("total_value").desc_nulls_last(), "deal_id").limit(20)
    line = lambda col, one: F.array_join(F.transform(col, one), ";").alias(col)
    return detail(d, cut.select("deal_id", "status")).select(
        "deal_id", "status", "nation", "area", line("parties", lambda x: F.concat(x["role"], F.lit(":"), x["company"])),
        line("assets", lambda x: F.concat(x["asset_id"].cast("string"), F.lit(" "), x["name"])), line("timeline", lambda x: x["day"].cast("string")), F.size("terms").cast("long").alias("n_terms"),
    )
