"""Companies, assets and comparable deals: profiles, overlap, momentum, similarity, entity matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealmill.domain import Domain, with_domain
from dealmill.functions.text import company_key, trigram_similarity, trigrams
from dealmill.operators.topk import first_per_key
from dealmill.plans.market import QUARTILES_SQL, VALUES_SQL, since, today, values, with_quartiles

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir, f=f: f(Domain(spark, sf_dir))
        if sql:
            SQL[f.__name__] = with_domain(sql)
        return f

    return put


@query(f"""SELECT c.company_id, c.name, count(DISTINCT deal_id) AS deals, count(total_value) AS disclosed, round(sum(total_value), 2) AS sum_value, min(date_start) AS first_deal, max(date_start) AS last_deal,
 count(*) FILTER (WHERE date_start >= today - INTERVAL 1 YEAR) AS last_year FROM companies c JOIN deals d ON d.principal_id = c.company_id, as_of GROUP BY ALL""")
def company_profile(d: Domain) -> DataFrame:
    both = d.companies().join(d.deals(), F.col("company_id") == F.col("principal_id"))
    return both.groupBy("company_id", "name").agg(
        F.countDistinct("deal_id").alias("deals"), F.count("total_value").alias("disclosed"), F.round(F.sum("total_value"), 2).alias("sum_value"),
        F.min("date_start").alias("first_deal"), F.max("date_start").alias("last_deal"), F.count_if(since(1)).alias("last_year"),
    )


@query("""SELECT asset_id, p_name AS asset, count(*) AS deals, count(DISTINCT principal_id) AS companies, round(max(total_value), 2) AS best, string_agg(DISTINCT status, ',' ORDER BY status) AS statuses
FROM deal_assets JOIN deals USING (deal_id) JOIN part ON p_partkey = asset_id GROUP BY ALL""")
def asset_profile(d: Domain) -> DataFrame:
    parts = d.t("part").select(F.col("p_partkey").alias("asset_id"), F.col("p_name").alias("asset"))
    return d.deal_assets().join(d.deals(), "deal_id").join(parts, "asset_id").groupBy("asset_id", "asset").agg(
        F.count(F.lit(1)).alias("deals"), F.countDistinct("principal_id").alias("companies"), F.round(F.max("total_value"), 2).alias("best"),
        F.array_join(F.sort_array(F.collect_set("status")), ",").alias("statuses"),
    )


_MOMENTUM_SQL = "CASE WHEN prior = 0 AND recent = 0 THEN 'inactive' WHEN prior = 0 THEN 'new' WHEN recent >= 1.25 * prior THEN 'accelerating' WHEN recent <= 0.75 * prior THEN 'slowing' ELSE 'steady' END"


def momentum(recent: Column, prior: Column) -> Column:
    """A quarter more or less than before makes the difference."""
    return (
        F.when((prior == 0) & (recent == 0), "inactive").when(prior == 0, "new").when(recent >= 1.25 * prior, "accelerating").when(recent <= 0.75 * prior, "slowing").otherwise("steady")
    )


@query(f"""SELECT *, {_MOMENTUM_SQL} AS momentum FROM (SELECT principal_id AS company_id, count(*) FILTER (WHERE date_start >= today - INTERVAL 1 YEAR) AS recent,
  count(*) FILTER (WHERE date_start < today - INTERVAL 1 YEAR AND date_start >= today - INTERVAL 2 YEAR) AS prior FROM deals, as_of GROUP BY 1)""")
def company_momentum(d: Domain) -> DataFrame:
    counts = d.deals().groupBy(F.col("principal_id").alias("company_id")).agg(F.count_if(since(1)).alias("recent"), F.count_if(since(2) & ~since(1)).alias("prior"))
    return counts.withColumn("momentum", momentum(F.col("recent"), F.col("prior")))


_FOCUS = "SELECT principal_id AS company_id, p_brand AS focus, count(DISTINCT deal_id) AS n, min(deal_id) AS evidence FROM deals JOIN deal_assets USING (deal_id) JOIN part ON p_partkey = asset_id GROUP BY 1, 2"


def _focus(d: Domain) -> DataFrame:
    parts = d.t("part").select(F.col("p_partkey").alias("asset_id"), F.col("p_brand").alias("focus"))
    both = d.deals().join(d.deal_assets(), "deal_id").join(parts, "asset_id")
    return both.groupBy(F.col("principal_id").alias("company_id"), "focus").agg(F.countDistinct("deal_id").alias("n"), F.min("deal_id").alias("evidence"))


@query(f"SELECT company_id, focus, n, evidence FROM ({_FOCUS}) QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY n DESC, focus) <= 10")
def company_focus(d: Domain) -> DataFrame:
    return first_per_key(_focus(d), ["company_id"], [F.desc("n"), F.col("focus")], 10)


@query("""WITH f AS (SELECT DISTINCT principal_id AS id, p_brand AS x FROM deals JOIN deal_assets USING (deal_id) JOIN part ON p_partkey = asset_id),
s AS (SELECT id, count(*) AS size FROM f GROUP BY 1), me AS (SELECT x FROM f WHERE id = 1),
hit AS (SELECT f.id, count(*) AS common FROM f JOIN me USING (x) WHERE f.id <> 1 GROUP BY 1)
SELECT h.id AS company_id, common, round(100 * common / (s.size + (SELECT count(*) FROM me) - common), 2) AS overlap FROM hit h JOIN s USING (id)
ORDER BY overlap DESC, company_id LIMIT 200""")
def competitive_peers(d: Domain) -> DataFrame:
    """Jaccard overlap of focus areas with company 1; only companies that share an area are met."""
    f = _focus(d).select(F.col("company_id"), "focus")
    mine = f.where(F.col("company_id") == 1).select("focus")
    hits = f.where(F.col("company_id") != 1).join(mine, "focus").groupBy("company_id").agg(F.count(F.lit(1)).alias("common"))
    sizes = f.groupBy("company_id").agg(F.count(F.lit(1)).alias("size"))
    own = mine.agg(F.count(F.lit(1)).alias("own"))
    overlap = F.round(100 * F.col("common") / (F.col("size") + F.col("own") - F.col("common")), 2)
    return hits.join(sizes, "company_id").crossJoin(own).select("company_id", "common", overlap.alias("overlap")).orderBy(F.desc("overlap"), "company_id").limit(200)


@query("""WITH f AS (SELECT principal_id AS company_id, p_brand AS focus, min(date_start) AS entered FROM deals JOIN deal_assets USING (deal_id) JOIN part ON p_partkey = asset_id GROUP BY ALL)
SELECT company_id, focus, entered::DATE::VARCHAR AS entered FROM f, as_of WHERE entered >= today - INTERVAL 180 DAY QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY entered, focus) <= 3""")
def new_entrants(d: Domain) -> DataFrame:
    parts = d.t("part").select(F.col("p_partkey").alias("asset_id"), F.col("p_brand").alias("focus"))
    first = d.deals().join(d.deal_assets(), "deal_id").join(parts, "asset_id").groupBy(F.col("principal_id").alias("company_id"), "focus").agg(F.min("date_start").alias("entered"))
    late = first.where(F.col("entered") >= today() - F.expr("INTERVAL 180 DAY"))
    return first_per_key(late, ["company_id"], [F.col("entered"), F.col("focus")], 3).withColumn("entered", F.to_date("entered").cast("string"))


# --- comparable deals --------------------------------------------------------------------------------------

CRITERIA = {"category": ("1", 0.35), "status": ("F", 0.25), "nation": ("CHINA", 0.25), "company_type": ("BUILD", 0.15)}


def score_similarity(criteria: dict[str, tuple[str, float]]) -> Column:
    """Weighted: equal 1, one within the other .5; criteria that are not asked for leave the denominator."""
    asked = {k: v for k, v in criteria.items() if v[0]}
    total = sum(w for _, w in asked.values())
    if not total:
        return F.lit(0.0)
    parts = F.lit(0.0)
    for name, (value, weight) in asked.items():
        got, want = F.lower(F.trim(F.col(name))), value.strip().lower()
        one = F.when(got == want, 1.0).when((got != "") & (got.contains(want) | F.lit(want).contains(got)), 0.5).otherwise(0.0)
        parts = parts + weight * F.coalesce(one, F.lit(0.0))
    return F.round(parts / total, 4)


def _similarity_sql() -> str:
    one = lambda n, v: f"CASE WHEN lower(trim({n})) = '{v}' THEN 1.0 WHEN contains(lower(trim({n})), '{v}') OR contains('{v}', lower(trim({n}))) THEN 0.5 ELSE 0.0 END"
    return "round((" + " + ".join(f"{w}::DOUBLE * {one(n, v.lower())}" for n, (v, w) in CRITERIA.items()) + ") / 1.0::DOUBLE, 4)"


@query(f"""WITH c AS (SELECT deal_id, total_value, category, status, nation, company_type FROM deal_areas WHERE category = '1' OR status = 'F' ORDER BY total_value DESC NULLS LAST, deal_id LIMIT 100)
SELECT deal_id, total_value, {_similarity_sql()} AS score FROM c ORDER BY score DESC, deal_id LIMIT 50""")
def comparable_deals(d: Domain) -> DataFrame:
    pool = d.deal_areas().where((F.col("category") == "1") | (F.col("status") == "F")).orderBy(F.desc_nulls_last("total_value"), "deal_id").limit(100)
    return pool.select("deal_id", "total_value", score_similarity(CRITERIA).alias("score")).orderBy(F.desc("score"), "deal_id").limit(50)


@query("""WITH mine AS (SELECT * FROM deal_areas WHERE principal_id = 7),
mode AS (SELECT (SELECT category FROM mine GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS category, (SELECT area FROM mine GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS area,
  (SELECT status FROM mine GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS status)
SELECT d.deal_id, 4 * (d.category = m.category)::INT + 3 * (d.area = m.area)::INT + 2 * (d.status = m.status)::INT AS score,
  concat_ws('; ', CASE WHEN d.category = m.category THEN 'same category' END, CASE WHEN d.area = m.area THEN 'same area' END, CASE WHEN d.status = m.status THEN 'same status' END) AS reasons
FROM deal_areas d, mode m WHERE d.principal_id <> 7 AND (d.category = m.category OR d.area = m.area OR d.status = m.status) ORDER BY score DESC, d.total_value DESC NULLS LAST, d.deal_id LIMIT 100""")
def diligence_comparables(d: Domain) -> DataFrame:
    mine, mode = d.deal_areas().where(F.col("principal_id") == 7), None
    for name in ("category", "area", "status"):
        one = mine.groupBy(name).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), name).limit(1).select(F.col(name).alias(f"m_{name}"))
        mode = one if mode is None else mode.crossJoin(one)
    others = d.deal_areas().where(F.col("principal_id") != 7).crossJoin(mode)
    same = {n: F.col(n) == F.col(f"m_{n}") for n in ("category", "area", "status")}
    score = 4 * same["category"].cast("int") + 3 * same["area"].cast("int") + 2 * same["status"].cast("int")
    why = F.concat_ws("; ", *[F.when(c, F.lit(f"same {n}")) for n, c in same.items()])
    hits = others.select("deal_id", "total_value", score.alias("score"), why.alias("reasons")).where(F.col("score") > 0)
    return hits.orderBy(F.desc("score"), F.desc_nulls_last("total_value"), "deal_id").limit(100).select("deal_id", "score", "reasons")


@query("""SELECT principal_id AS company_id, count(*) AS deals, count(*) FILTER (WHERE status = 'P') > 0.3 * count(*) AS many_pending,
 max(n_type) > 0.5 * count(*) AS concentrated, count(*) < 3 AS few_deals FROM (SELECT *, count(*) OVER (PARTITION BY principal_id, category) AS n_type FROM deals) GROUP BY 1""")
def risk_flags(d: Domain) -> DataFrame:
    by = d.deals().groupBy("principal_id", "category").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "P").alias("pending"))
    return by.groupBy(F.col("principal_id").alias("company_id")).agg(
        F.sum("n").alias("deals"), (F.sum("pending") > 0.3 * F.sum("n")).alias("many_pending"), (F.max("n") > 0.5 * F.sum("n")).alias("concentrated"), (F.sum("n") < 3).alias("few_deals")
    )


@query("""SELECT deal_id, total_value, concat_ws('; ', CASE WHEN total_value > 400000 THEN 'large' END, CASE WHEN category = '1' THEN 'urgent' END, CASE WHEN area = 'ASIA' THEN 'growth area' END) AS reasons
FROM deal_areas, as_of WHERE date_start >= today - INTERVAL 90 DAY AND coalesce(status, '') NOT ILIKE '%f%' ORDER BY total_value DESC NULLS LAST, deal_id LIMIT 20""")
def recommendations(d: Domain) -> DataFrame:
    recent = d.deal_areas().where((F.col("date_start") >= today() - F.expr("INTERVAL 90 DAY")) & ~F.coalesce("status", F.lit("")).ilike("%f%"))
    why = F.concat_ws("; ", F.when(F.col("total_value") > 400000, "large"), F.when(F.col("category") == "1", "urgent"), F.when(F.col("area") == "ASIA", "growth area"))
    return recent.orderBy(F.desc_nulls_last("total_value"), "deal_id").limit(20).select("deal_id", "total_value", why.alias("reasons"))


@query(f"SELECT area, category, {VALUES_SQL}, {QUARTILES_SQL} FROM deal_areas, as_of WHERE date_start >= today - INTERVAL 3 YEAR GROUP BY ALL")
def topic_briefing(d: Domain) -> DataFrame:
    return d.deal_areas().where(since(3)).transform(with_quartiles, "area", "category").drop("min_value", "max_value")


@query("""SELECT count(*) AS deals, count(*) FILTER (WHERE p.nation_id <> c.nation_id) AS cross_border, round(avg(total_value) FILTER (WHERE p.nation_id <> c.nation_id), 4) AS avg_cross
FROM deals d JOIN companies c ON c.company_id = d.principal_id JOIN deal_partners b USING (deal_id) JOIN partners p USING (partner_id)""")
def cross_border_deals(d: Domain) -> DataFrame:
    c = d.companies().select(F.col("company_id").alias("principal_id"), F.col("nation_id").alias("home"))
    both = d.deals().join(c, "principal_id").join(d.deal_partners(), "deal_id").join(d.partners(), "partner_id")
    far = F.col("nation_id") != F.col("home")
    return both.agg(F.count(F.lit(1)).alias("deals"), F.count_if(far).alias("cross_border"), F.round(F.avg(F.when(far, F.col("total_value"))), 4).alias("avg_cross"))


# --- entity matching ---------------------------------------------------------------------------------------

_GRAMS_SQL = """(SELECT {id} AS id, unnest(list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({name}), '[^a-z0-9]+'), lambda w: w <> ''),
  lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))) AS g FROM {table})"""


#: Grams that a key is made of, at most, and keys of a name, at most: the more grams, the fewer names meet that are not alike.
KEY_GRAMS, KEYS = 3, 128


def _subsets(codes: Column, n: int) -> Column:
    """All choices of n of the codes, each in their order."""
    if n == 1:
        return F.transform(codes, lambda g: F.array(g))
    rest = lambda i: F.slice(codes, i + 2, F.greatest(F.size(codes) - i - 1, F.lit(0)))
    return F.flatten(F.transform(codes, lambda g, i: F.transform(_subsets(rest(i), n - 1), lambda s: F.concat(F.array(g), s))))


def _fewest_shared(size: Column, least: Column, threshold: float) -> Column:
    """How many grams a name must share with any that it is like, if the others have ``least`` at least: more than t / (1 + t) of both together."""
    other = F.greatest(least, F.ceil(F.lit(threshold) * size - F.lit(1e-9)))
    return (F.floor(F.lit(threshold / (1 + threshold)) * (size + other) - F.lit(1e-9)) + 1).cast("int")


def similarity_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """id_a, id_b, score: names (id, name) with trigram similarity over the threshold.

    Each spelling is compared once, however many rows have it. Grams of one side alone can't be shared: they only
    count in a name's size. Of its other grams a name that must share o with any that it is like takes the rarest,
    all but o - n of them: two such names have n of these in common, the first n of all that they share. So names
    meet by each choice of n = 3 of these grams (fewer, where a name would have more than ``KEYS`` choices or must
    share fewer; a pair goes by the lesser n of its two). Those that meet are scored on all grams at once.
    """
    point = lambda g, i: F.ascii(F.substring(g, i, 1)).cast("long")
    code = lambda g: point(g, 1) * 2**42 + point(g, 2) * 2**21 + point(g, 3)
    spelled = lambda df: df.select(F.lower("name").alias("name")).where("name IS NOT NULL").distinct()
    grams = [spelled(df).select("name", F.transform(trigrams(F.col("name")), code).alias("grams")).where(F.size("grams") > 0) for df in (left, right)]
    often = [df.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n")) for df in grams]
    both = often[0].join(often[1].withColumnRenamed("n", "m"), "g").select("g", (F.col("n") + F.col("m")).alias("n"))
    least = [df.agg(F.min(F.size("grams")).alias("least")) for df in grams]

    def sharing(df: DataFrame, others: DataFrame) -> DataFrame:
        """name, size, codes (those of both sides, rarest first), must (how many it must share), most (grams of its keys)."""
        rows = df.select("name", F.size("grams").alias("size"), F.explode("grams").alias("g")).join(both, "g")
        rows = rows.groupBy("name", "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "g"))), lambda r: r["g"]).alias("codes"))
        rows = rows.crossJoin(F.broadcast(others)).withColumn("must", _fewest_shared(F.col("size"), F.col("least"), threshold)).where(F.size("codes") >= F.col("must"))
        spare, choices, most = F.size("codes") - F.col("must"), F.lit(1.0), F.lit(1)
        for n in range(1, KEY_GRAMS + 1):
            choices = choices * (spare + n) / n
            most = F.when((choices <= KEYS) & (F.col("must") >= n), n).otherwise(most) if n > 1 else most
        return rows.select("name", "size", "codes", "must", most.alias("most"))

    a, b = sharing(grams[0], least[1]), sharing(grams[1], least[0])

    def keyed(df: DataFrame, others: DataFrame, side: str) -> DataFrame:
        asked = others.agg(F.collect_set("most").alias("asked"))
        rows = df.crossJoin(F.broadcast(asked))
        wanted = F.transform("asked", lambda n: F.least(n, F.col("most")))
        first = lambda n: F.slice("codes", 1, F.size("codes") - F.col("must") + n)
        keys = F.concat(*[F.when(F.array_contains(wanted, n), F.transform(_subsets(first(n), n), lambda s: F.xxhash64(s))).otherwise(F.array().cast("array<long>")) for n in range(1, KEY_GRAMS + 1)])
        return rows.select(F.explode(keys).alias("key"), *[F.col(c).alias(f"{c}_{side}") for c in ("name", "size", "codes")])

    shared = F.size(F.array_intersect("codes_a", "codes_b"))
    score = shared / (F.col("size_a") + F.col("size_b") - shared)
    alike = keyed(a, b, "a").join(keyed(b, a, "b"), "key").where(score > threshold).select("name_a", "name_b", score.alias("score")).distinct()
    named = lambda df, side: df.select(F.col("id").alias(f"id_{side}"), F.lower("name").alias(f"name_{side}"))
    found = alike.join(named(left, "a"), "name_a").join(named(right, "b"), "name_b")
    return found.select("id_a", "id_b", F.round("score", 4).alias("score"))


@query(f"""WITH a AS {_GRAMS_SQL.format(id="c_custkey", name="c_name", table="customer")}, b AS {_GRAMS_SQL.format(id="s_suppkey", name="s_name", table="supplier")},
na AS (SELECT id, count(*) AS n FROM a GROUP BY 1), nb AS (SELECT id, count(*) AS n FROM b GROUP BY 1),
m AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM a JOIN b USING (g) GROUP BY ALL)
SELECT id_a, id_b, round(c / (na.n + nb.n - c), 4) AS score FROM m JOIN na ON na.id = id_a JOIN nb ON nb.id = id_b WHERE c / (na.n + nb.n - c) > 0.3""")
def fuzzy_name_pairs(d: Domain) -> DataFrame:
    a = d.t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    b = d.t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return similarity_pairs(a, b, 0.3)


@query(f"""WITH b AS {_GRAMS_SQL.format(id="c_custkey", name="c_name", table="customer")},
q AS (SELECT DISTINCT unnest(flatten(list_transform(['customer', '000000123'], lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS g),
n AS (SELECT id, count(*) AS n FROM b GROUP BY 1), m AS (SELECT id, count(*) AS c FROM b JOIN q USING (g) GROUP BY 1)
SELECT id AS company_id, round(c / (n + (SELECT count(*) FROM q) - c), 4) AS score FROM m JOIN n USING (id) ORDER BY score DESC, company_id LIMIT 10""")
def fuzzy_company_search(d: Domain) -> DataFrame:
    score = F.round(trigram_similarity(F.col("name"), F.lit("customer 000000123")), 4)
    return d.companies().select("company_id", score.alias("score")).orderBy(F.desc("score"), "company_id").limit(10)


@query("""SELECT c.company_id, p.partner_id, 'number' AS method FROM companies c JOIN partners p ON p.partner_id = c.company_id AND p.nation_id = c.nation_id
UNION ALL SELECT company_id, partner_id, 'name' FROM (
  SELECT company_id, replace(replace(lower(name), 'customer#', ''), '#', ' ') AS k FROM companies c WHERE NOT EXISTS (SELECT 1 FROM partners p WHERE p.partner_id = c.company_id AND p.nation_id = c.nation_id)) x
 JOIN (SELECT partner_id, replace(replace(lower(partner), 'supplier#', ''), '#', ' ') AS k FROM partners p WHERE NOT EXISTS (SELECT 1 FROM companies c WHERE p.partner_id = c.company_id AND p.nation_id = c.nation_id)) y USING (k)""")
def match_cascade(d: Domain) -> DataFrame:
    """Matching in stages; a stage takes both its sides out of the next."""
    c, p = d.companies(), d.partners()
    right = p.withColumnRenamed("nation_id", "p_nation")
    exact = c.join(right, (F.col("company_id") == F.col("partner_id")) & (F.col("nation_id") == F.col("p_nation"))).select("company_id", "partner_id", F.lit("number").alias("method"))
    key = lambda name: company_key(F.regexp_replace(name, r"^(Customer|Supplier)#", ""))
    left_c = c.join(exact.select("company_id"), "company_id", "left_anti").select("company_id", key(F.col("name")).alias("k"))
    left_p = p.join(exact.select("partner_id"), "partner_id", "left_anti").select("partner_id", key(F.col("partner")).alias("k"))
    return exact.unionByName(left_c.join(left_p, "k").select("company_id", "partner_id", F.lit("name").alias("method")))


@query("""SELECT alias, min(p_partkey) AS asset_id FROM (SELECT p_name AS alias, p_partkey FROM part UNION SELECT split_part(p_name, ' ', 2) || '-' || p_size, p_partkey FROM part) GROUP BY 1 HAVING count(DISTINCT p_partkey) = 1""")
def unique_aliases(d: Domain) -> DataFrame:
    part = d.t("part")
    aliases = part.select(F.col("p_name").alias("alias"), "p_partkey").unionByName(part.select(F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit("-"), "p_size").alias("alias"), "p_partkey"))
    return aliases.groupBy("alias").agg(F.min("p_partkey").alias("asset_id"), F.countDistinct("p_partkey").alias("n")).where(F.col("n") == 1).drop("n")
