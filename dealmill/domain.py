"""The deal domain over the tables at hand, as DataFrames and as the same SQL text for the oracle.

deals = orders; principals = customers; partners = suppliers (through lineitem); assets = parts; therapy areas =
regions of the principal; territories = nations; headline values are undisclosed for priority 5-LOW. "Today" is
fixed, so that results do not move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealmill.catalog import table

AS_OF = "2001-08-02"
EVENTS_AS_OF = "2024-01-31 00:00:00"


class Domain:
    """The domain's DataFrames for one input folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def t(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    def deals(self) -> DataFrame:
        """deal_id, principal_id, status, total_value (null if undisclosed), date_start, agreement_type, category."""
        o = self.t("orders")
        return o.select(
            F.col("o_orderkey").alias("deal_id"),
            F.col("o_custkey").alias("principal_id"),
            F.col("o_orderstatus").alias("status"),
            F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")).alias("total_value"),
            F.col("o_orderdate").alias("date_start"),
            F.col("o_orderpriority").alias("agreement_type"),
            F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).alias("category"),
        )

    def areas(self) -> DataFrame:
        """nation_id, nation, area: small dimension of territories and therapy areas."""
        n, r = self.t("nation"), self.t("region")
        return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(
            F.col("n_nationkey").alias("nation_id"), F.col("n_name").alias("nation"), F.col("r_name").alias("area")
        )

    def companies(self) -> DataFrame:
        """company_id, name, company_type, nation_id: principals."""
        return self.t("customer").select(
            F.col("c_custkey").alias("company_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("company_type"), F.col("c_nationkey").alias("nation_id")
        )

    def partners(self) -> DataFrame:
        return self.t("supplier").select(F.col("s_suppkey").alias("partner_id"), F.col("s_name").alias("partner"), F.col("s_nationkey").alias("nation_id"))

    def deal_areas(self) -> DataFrame:
        """deals with nation and area of the principal."""
        c = self.companies().join(self.areas(), "nation_id").select(F.col("company_id").alias("principal_id"), "company_type", "nation", "area")
        return self.deals().join(c, "principal_id")

    def deal_partners(self) -> DataFrame:
        """deal_id, partner_id, once each."""
        return self.t("lineitem").select(F.col("l_orderkey").alias("deal_id"), F.col("l_suppkey").alias("partner_id")).distinct()

    def deal_assets(self) -> DataFrame:
        return self.t("lineitem").select(F.col("l_orderkey").alias("deal_id"), F.col("l_partkey").alias("asset_id")).distinct()

    def deal_roles(self) -> DataFrame:
        """deal_id, company ('C' principals, 'S' partners, with their number), role."""
        principal = self.deals().select("deal_id", F.concat(F.lit("C"), F.col("principal_id").cast("string")).alias("company"), F.lit("Principal").alias("role"))
        partner = self.deal_partners().select("deal_id", F.concat(F.lit("S"), F.col("partner_id").cast("string")).alias("company"), F.lit("Partner").alias("role"))
        return principal.unionByName(partner)


#: The same as SQL: prefixed to every oracle query that uses these names.
CTES = f"""
deals AS (
  SELECT o_orderkey AS deal_id, o_custkey AS principal_id, o_orderstatus AS status,
         CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END AS total_value, o_orderdate AS date_start,
         o_orderpriority AS agreement_type, split_part(o_orderpriority, '-', 1) AS category FROM orders),
areas AS (SELECT n_nationkey AS nation_id, n_name AS nation, r_name AS area FROM nation JOIN region ON n_regionkey = r_regionkey),
companies AS (SELECT c_custkey AS company_id, c_name AS name, c_mktsegment AS company_type, c_nationkey AS nation_id FROM customer),
partners AS (SELECT s_suppkey AS partner_id, s_name AS partner, s_nationkey AS nation_id FROM supplier),
deal_areas AS (
  SELECT d.*, c.company_type, a.nation, a.area FROM deals d JOIN companies c ON c.company_id = d.principal_id JOIN areas a ON a.nation_id = c.nation_id),
deal_partners AS (SELECT DISTINCT l_orderkey AS deal_id, l_suppkey AS partner_id FROM lineitem),
deal_assets AS (SELECT DISTINCT l_orderkey AS deal_id, l_partkey AS asset_id FROM lineitem),
deal_roles AS (
  SELECT deal_id, 'C' || principal_id AS company, 'Principal' AS role FROM deals
  UNION ALL SELECT deal_id, 'S' || partner_id, 'Partner' FROM deal_partners),
as_of AS (SELECT TIMESTAMP '{AS_OF}' AS today)
"""


def with_domain(sql: str) -> str:
    """The oracle text with the domain's common table expressions in front."""
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {CTES}, {body[15:]}"
    return f"WITH {CTES}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {CTES} {body}"
