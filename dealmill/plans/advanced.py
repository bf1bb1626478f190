"""Typed deal search: a validated request becomes predicates; a page is cut first and only it is filled in."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealmill.domain import Domain, with_domain
from dealmill.operators.filters import Dates, Money, Related, Scalar, any_of, contains
from dealmill.operators.topk import Cursor, after, ordered

QUERIES, SQL = {}, {}
SORTS = {"date": ("date_start", False), "value": ("total_value", False), "id": ("deal_id", True), "status": ("status", True)}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir, f=f: f(Domain(spark, sf_dir))
        if sql:
            SQL[f.__name__] = with_domain(sql)
        return f

    return put


@dataclass(frozen=True)
class DealRequest:
    """A deal search. Unknown fields are rejected by construction; limits and sorts are checked here."""

    text: str | None = None
    status: Scalar = field(default_factory=Scalar)
    agreement: Scalar = field(default_factory=Scalar)
    area: Scalar = field(default_factory=Scalar)
    company_ids: tuple[int, ...] = ()
    company_name: str | None = None
    roles: tuple[str, ...] = ()
    assets: Related = field(default_factory=Related)
    dates: Dates = field(default_factory=Dates)
    value: Money | None = None
    sort: str = "date"
    limit: int = 20
    cursor: str | None = None

    def __post_init__(self):
        if self.sort not in SORTS:
            raise ValueError(f"sort must be one of {sorted(SORTS)}")
        if not 1 <= self.limit <= 200:
            raise ValueError("limit must be 1 to 200")
        if self.company_ids and self.company_name:
            raise ValueError("give company ids or a name, not both")
        if self.sort == "value" and self.value is not None and len(self.value.currencies) != 1:
            raise ValueError("sorting by value needs one currency")

    def digest(self) -> str:
        """Binds cursors to the request: all of it but the cursor itself."""
        body = {k: v for k, v in asdict(self).items() if k != "cursor"}
        return hashlib.sha256(json.dumps(body, sort_keys=True, default=str).encode()).hexdigest()[:24]


def matching(d: Domain, r: DealRequest) -> DataFrame:
    """The matching deals with the columns that sorts need."""
    deals = d.deal_areas()
    keep = r.status.on(F.col("status")) & r.agreement.on(F.col("agreement_type")) & r.area.on(F.col("area")) & r.dates.on(F.col("date_start"))
    if r.value is not None:
        keep = keep & r.value.on(F.col("total_value"), F.lit("Million"), F.lit("USD"))
    deals = deals.where(keep)
    if r.company_ids or r.company_name or r.roles:
        roles = d.deal_roles()
        if r.roles:
            roles = roles.where(F.col("role").isin(*r.roles))
        if r.company_ids:
            roles = roles.where(F.col("company").isin(*[f"C{i}" for i in r.company_ids], *[f"S{i}" for i in r.company_ids]))
        if r.company_name:
            names = d.companies().where(contains(F.col("name"), r.company_name)).select(F.concat(F.lit("C"), F.col("company_id").cast("string")).alias("company"))
            names = names.unionByName(d.partners().where(contains(F.col("partner"), r.company_name)).select(F.concat(F.lit("S"), F.col("partner_id").cast("string")).alias("company")))
            roles = roles.join(names, "company", "left_semi")
        deals = deals.join(roles.select("deal_id"), "deal_id", "left_semi")
    bridge = d.deal_assets().join(d.t("part").select(F.col("p_partkey").alias("asset_id"), F.col("p_brand").alias("asset")), "asset_id")
    deals = r.assets.apply(deals, bridge, "deal_id", "asset")
    if r.text:
        hit = any_of([contains(F.col(c), r.text) for c in ("agreement_type", "nation", "company_type")])
        deals = deals.where(F.coalesce(hit, F.lit(False)))
    return deals.select("deal_id", "status", "agreement_type", "area", "date_start", "total_value", "principal_id")


def count_matching(d: Domain, r: DealRequest) -> DataFrame:
    """The count alone: neither sorted nor filled in."""
    return matching(d, r).agg(F.count(F.lit(1)).alias("total"))


def page(d: Domain, r: DealRequest) -> DataFrame:
    """One page, filled in with names, partners and assets of its deals only."""
    name, ascending = SORTS[r.sort]
    keys = [] if name == "deal_id" else [(name, ascending)]
    rows = matching(d, r)
    if r.cursor:
        values, row_id = Cursor.decode(r.cursor, r.digest())
        if name == "date_start" and values[0] is not None:
            values = [dt.datetime.fromisoformat(values[0])]
        rows = rows.where(after(keys, values, "deal_id", row_id))
    cut = rows.orderBy(*ordered(keys, "deal_id")).limit(r.limit)
    partners = d.deal_partners().join(cut.select("deal_id"), "deal_id").join(d.partners(), "partner_id").groupBy("deal_id").agg(F.array_join(F.sort_array(F.collect_set("partner")), "; ").alias("partners"))
    assets = d.deal_assets().join(cut.select("deal_id"), "deal_id").groupBy("deal_id").agg(F.count(F.lit(1)).alias("n_assets"))
    names = d.companies().select(F.col("company_id").alias("principal_id"), F.col("name").alias("principal"))
    filled = cut.join(names, "principal_id", "left").join(partners, "deal_id", "left").join(assets, "deal_id", "left")
    return filled.select("deal_id", "status", "area", "total_value", "principal", F.coalesce("partners", F.lit("")).alias("partners"), F.coalesce("n_assets", F.lit(0)).alias("n_assets"))


def next_cursor(r: DealRequest, last: dict) -> str:
    """The cursor behind the last row of a page (deal_id and the sort column)."""
    name, _ = SORTS[r.sort]
    value = last.get(name)
    return Cursor.encode(r.digest(), [] if name == "deal_id" else [value.isoformat() if isinstance(value, dt.datetime) else value], last["deal_id"])


_FILL = """SELECT c.deal_id, c.status, c.area, c.total_value, k.name AS principal,
 coalesce((SELECT string_agg(DISTINCT partner, '; ' ORDER BY partner) FROM deal_partners b JOIN partners p USING (partner_id) WHERE b.deal_id = c.deal_id), '') AS partners,
 (SELECT count(*) FROM deal_assets a WHERE a.deal_id = c.deal_id) AS n_assets FROM c LEFT JOIN companies k ON k.company_id = c.principal_id"""


@query(f"""WITH c AS (SELECT * FROM deal_areas d WHERE lower(status) IN ('f', 'o') AND area ILIKE '%as%' AND date_start >= TIMESTAMP '1996-01-01' AND date_start < TIMESTAMP '1999-01-01' AND total_value BETWEEN 100000 AND 300000
 AND EXISTS (SELECT 1 FROM deal_assets a JOIN part ON p_partkey = a.asset_id WHERE a.deal_id = d.deal_id AND lower(p_brand) IN ('brand#12', 'brand#13'))
 AND NOT EXISTS (SELECT 1 FROM deal_assets a JOIN part ON p_partkey = a.asset_id WHERE a.deal_id = d.deal_id AND lower(p_brand) = 'brand#11') ORDER BY total_value DESC NULLS LAST, deal_id LIMIT 25) {_FILL}""")
def advanced_deal_search(d: Domain) -> DataFrame:
    return page(d, DealRequest(
        status=Scalar(include=("F", "O"), exact=True), area=Scalar(include=("as",)), dates=Dates(dt.date(1996, 1, 1), dt.date(1998, 12, 31)), value=Money(gte=100000, lte=300000),
        assets=Related(any=("Brand#12", "Brand#13"), exclude=("Brand#11",)), sort="value", limit=25,
    ))


@query(f"WITH c AS (SELECT * FROM deal_areas d WHERE deal_id IN (SELECT deal_id FROM deal_roles WHERE role = 'Partner' AND company IN ('S1', 'S2', 'S3')) ORDER BY date_start DESC NULLS LAST, deal_id LIMIT 20 OFFSET 20) {_FILL}")
def advanced_second_page(d: Domain) -> DataFrame:
    """The second page by cursor: the place of the first page's last row is all that reaches the driver."""
    first = DealRequest(company_ids=(1, 2, 3), roles=("Partner",))
    last = matching(d, first).orderBy(*ordered([("date_start", False)], "deal_id")).limit(first.limit).orderBy("date_start", F.desc("deal_id")).limit(1).collect()
    if not last:
        return page(d, first)
    return page(d, DealRequest(company_ids=(1, 2, 3), roles=("Partner",), cursor=next_cursor(first, last[0].asDict())))


@query("SELECT count(*) AS total FROM deal_areas WHERE agreement_type ILIKE '%urgent%' OR nation ILIKE '%urgent%' OR company_type ILIKE '%urgent%'")
def advanced_count(d: Domain) -> DataFrame:
    return count_matching(d, DealRequest(text="urgent"))
