"""Search over a stored inverted index: BM25, filters, excerpts; exact vector search, hybrid fusion, federated groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dealmill.domain import Domain, with_domain
from dealmill.functions.vector import cosine
from dealmill.operators.filters import any_of, contains
from dealmill.operators.text_index import STOP_WORDS, TextIndex, Words, excerpt
from dealmill.operators.topk import first_per_key, interleave, reciprocal_ranks

QUERIES, SQL = {}, {}
TERMS = ("the", "und", "que")


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir, f=f: f(Domain(spark, sf_dir))
        if sql:
            SQL[f.__name__] = with_domain(sql)
        return f

    return put


def documents_index(d: Domain) -> TextIndex:
    return TextIndex.of(d.t("documents"), f"{d.dir}/documents.parquet", columns=("source", "lang"))


_BM25_SQL = """c AS (SELECT doc_id, source, lang, text, len(w) AS size, {tfs} FROM (
  SELECT doc_id, source, lang, text, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents)),
st AS (SELECT count(*) AS n, avg(size) AS mean_size, {dfs} FROM c),
scored AS (SELECT doc_id, source, lang, text, round({score}, 6) AS score FROM c, st WHERE {keep})"""


def _bm25_sql(terms: tuple[str, ...], every: bool) -> str:
    one = "ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean_size))"
    r = range(len(terms))
    return _BM25_SQL.format(
        tfs=", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(terms)),
        dfs=", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in r),
        score=" + ".join(one.format(i=i) for i in r), keep=(" AND " if every else " OR ").join(f"tf{i} > 0" for i in r),
    )


@query(f"WITH {_bm25_sql(TERMS[:1], True)} SELECT doc_id, source, score FROM scored QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) = 1")
def search_best_per_source(d: Domain) -> DataFrame:
    index = documents_index(d)
    hits = index.search(TERMS[:1]).join(index.documents.select("doc_id", "source"), "doc_id")
    return first_per_key(hits, ["source"], [F.desc("score"), F.col("doc_id")]).select("doc_id", "source", "score")


@query(f"WITH {_bm25_sql(('the', 'and'), True)} SELECT doc_id, score FROM scored WHERE lang = 'en' ORDER BY score DESC, doc_id LIMIT 100")
def search_full_text(d: Domain) -> DataFrame:
    return documents_index(d).search(("the", "and"), where=F.col("lang") == "en").orderBy(F.desc("score"), "doc_id").limit(100)


@query(f"WITH {_bm25_sql(('die', 'que'), False)} SELECT doc_id, score FROM scored WHERE source IN (SELECT DISTINCT source FROM documents ORDER BY source LIMIT 2) AND lang <> 'en' AND NOT list_contains(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), 'und') ORDER BY score DESC, doc_id LIMIT 50")
def search_any_without(d: Domain) -> DataFrame:
    """Any of two terms, without a third, in two sources and not in one language."""
    index = documents_index(d)
    two = [r.source for r in index.documents.select("source").where(F.col("source").isNotNull()).distinct().orderBy("source").limit(2).collect()]  # names of two sources
    keep = F.col("source").isin(*two) & (F.col("lang") != "en")
    return index.search(("die", "que"), every=False, without=("und",), where=keep).orderBy(F.desc("score"), "doc_id").limit(50)


_AT = "len(regexp_extract(lower(text), '(?s)^(.*?)(?:^|[^\\p{L}\\p{N}])(?:the|and)(?:$|[^\\p{L}\\p{N}])', 1))"


@query(f"WITH {_bm25_sql(('the', 'and'), True)}, top AS (SELECT * FROM scored WHERE lang = 'en' ORDER BY score DESC, doc_id LIMIT 20) SELECT doc_id, source, score, substr(text, greatest(1, CASE WHEN regexp_matches(lower(text), '^(the|and)($|[^\\p{{L}}\\p{{N}}])') THEN 1 ELSE {_AT} + 2 END - 40), 160) AS excerpt FROM top")
def search_excerpts(d: Domain) -> DataFrame:
    """The best page with excerpts: only the texts of the page are read."""
    index = documents_index(d)
    top = index.search(("the", "and"), where=F.col("lang") == "en").orderBy(F.desc("score"), "doc_id").limit(20)
    texts = d.t("documents").select("doc_id", "source", "text")
    return texts.join(top, "doc_id").select("doc_id", "source", "score", excerpt(F.col("text"), ("the", "and")).alias("excerpt"))


@query("""SELECT term, count(*) AS docs, sum(tf)::BIGINT AS n FROM (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term FROM documents) GROUP BY ALL) GROUP BY 1""")
def index_terms(d: Domain) -> DataFrame:
    return documents_index(d).postings.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("tf").alias("n"))


@query("""SELECT doc_id, substr(text, greatest(1, strpos(lower(text), 'license') - 40), 120) AS snippet FROM documents WHERE contains(lower(text), 'license') ORDER BY doc_id OFFSET 5 LIMIT 20""")
def search_snippets(d: Domain) -> DataFrame:
    at = F.instr(F.lower("text"), "license")
    hits = d.t("documents").where(F.lower("text").contains("license")).orderBy("doc_id").offset(5).limit(20)
    return hits.select("doc_id", F.substring("text", F.greatest(F.lit(1), at - 40), F.lit(120)).alias("snippet"))


def query_vector(d: Domain, vec_id: int = 0) -> DataFrame:
    return d.t("embeddings").where(F.col("vec_id") == vec_id).select(F.col("embedding").alias("asked")).limit(1)


_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


@query(f"SELECT e.vec_id, round({_COS}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND e.vec_id <> 0 ORDER BY score DESC, e.vec_id LIMIT 20")
def vector_top(d: Domain) -> DataFrame:
    """Exact cosine search: the query vector is one row; a top-k sort keeps 20 rows a task."""
    scored = d.t("embeddings").where(F.col("vec_id") != 0).crossJoin(query_vector(d)).select("vec_id", F.round(cosine(F.col("embedding"), F.col("asked")), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "vec_id").limit(20)


@query(f"SELECT e.vec_id, e.label, round({_COS}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND e.label IN (0, 2) AND {_COS} >= 0.1")
def vector_filtered(d: Domain) -> DataFrame:
    rows = d.t("embeddings").where(F.col("label").isin(0, 2)).crossJoin(query_vector(d))
    scored = rows.select("vec_id", "label", cosine(F.col("embedding"), F.col("asked")).alias("s")).where(F.col("s") >= 0.1)
    return scored.select("vec_id", "label", F.round("s", 6).alias("score"))


@query(f"""WITH {_bm25_sql(('the',), True)}, lexical AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored ORDER BY rank LIMIT 50),
near AS (SELECT vec_id AS id, row_number() OVER (ORDER BY s DESC, vec_id) AS rank FROM (SELECT e.vec_id, round({_COS}, 6) AS s FROM embeddings e, embeddings q WHERE q.vec_id = 0) ORDER BY rank LIMIT 50)
SELECT id, round(sum(1 / (60 + rank)), 8) AS score FROM (FROM lexical UNION ALL FROM near) GROUP BY 1 ORDER BY score DESC, id LIMIT 30""")
def hybrid_search(d: Domain) -> DataFrame:
    ranked = lambda df, key: df.orderBy(F.desc("score"), key).limit(50).select(F.col(key).alias("id"), F.row_number().over(W.orderBy(F.desc("score"), key)).alias("rank"))
    near = d.t("embeddings").crossJoin(query_vector(d)).select("vec_id", F.round(cosine(F.col("embedding"), F.col("asked")), 6).alias("score"))
    return reciprocal_ranks([ranked(documents_index(d).search(("the",)), "doc_id"), ranked(near, "vec_id")], 30)


@query("""SELECT dataset, id, name FROM (
 SELECT 'companies' AS dataset, company_id AS id, name, row_number() OVER (ORDER BY company_id) AS k FROM companies WHERE name ILIKE '%12%'
 UNION ALL SELECT 'partners', partner_id, partner, row_number() OVER (ORDER BY partner_id) FROM partners WHERE partner ILIKE '%12%'
 UNION ALL SELECT 'assets', p_partkey, p_name, row_number() OVER (ORDER BY p_partkey) FROM part WHERE p_name ILIKE '%12%' OR p_brand ILIKE '%12%') WHERE k <= 10""")
def federated_search(d: Domain) -> DataFrame:
    """Groups by dataset, ten rows each: every branch is a top-k of its own."""
    top = lambda df: df.orderBy("id").limit(10)
    c = d.companies().where(F.col("name").ilike("%12%")).select(F.lit("companies").alias("dataset"), F.col("company_id").alias("id"), "name")
    p = d.partners().where(F.col("partner").ilike("%12%")).select(F.lit("partners").alias("dataset"), F.col("partner_id").alias("id"), F.col("partner").alias("name"))
    a = d.t("part").where(F.col("p_name").ilike("%12%") | F.col("p_brand").ilike("%12%")).select(F.lit("assets").alias("dataset"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return top(c).unionByName(top(p)).unionByName(top(a))


@query(f"""WITH {_bm25_sql(('the',), True)}, a AS (SELECT 0 AS source, doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS turn FROM scored),
b AS (SELECT 1 AS source, page_id AS id, row_number() OVER (ORDER BY length(html) DESC, page_id) AS turn FROM pages WHERE contains(lower(html), 'the'))
SELECT source, id, turn::INT AS turn FROM (FROM a UNION ALL FROM b) ORDER BY turn, source LIMIT 20""")
def unified_search(d: Domain) -> DataFrame:
    docs = documents_index(d).search(("the",)).select(F.col("doc_id").alias("id"), "score").orderBy(F.desc("score"), "id").limit(20)
    pages = d.t("pages").where(F.lower("html").contains("the")).select(F.col("page_id").alias("id"), F.char_length("html").alias("score")).orderBy(F.desc("score"), "id").limit(20)
    return interleave([docs, pages], 20)


@query("""SELECT name FROM companies WHERE name ILIKE '%00000000%' ORDER BY CASE WHEN name ILIKE 'customer#00000000%' THEN 0 ELSE 1 END, length(name), name LIMIT 8""")
def autocomplete(d: Domain) -> DataFrame:
    first = F.when(F.col("name").ilike("customer#00000000%"), 0).otherwise(1)
    return d.companies().where(F.col("name").ilike("%00000000%")).orderBy(first, F.char_length("name"), "name").limit(8).select("name")


@query(f"WITH {_bm25_sql(('the',), True)} SELECT doc_id AS id, round(1 / (60 + row_number() OVER (ORDER BY score DESC, doc_id)), 8) AS score FROM scored ORDER BY score DESC, id LIMIT 30")
def hybrid_without_vector(d: Domain) -> DataFrame:
    """Hybrid search whose query has no vector: the text ranking stands alone."""
    asked = query_vector(d, -1)
    text = documents_index(d).search(("the",)).orderBy(F.desc("score"), "doc_id").limit(50)
    ranked = text.select(F.col("doc_id").alias("id"), F.row_number().over(W.orderBy(F.desc("score"), "doc_id")).alias("rank"))
    near = d.t("embeddings").crossJoin(asked).select("vec_id", F.round(cosine(F.col("embedding"), F.col("asked")), 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(50)
    near = near.select(F.col("vec_id").alias("id"), F.row_number().over(W.orderBy(F.desc("score"), "vec_id")).alias("rank"))
    return reciprocal_ranks([ranked, near], 30)


@query(f"""WITH s AS (SELECT e.vec_id, e.label, {_COS} AS s FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND e.vec_id <> 0), best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) = 1)
SELECT vec_id, label, round(s, 6) AS score FROM best ORDER BY s DESC, vec_id LIMIT 20""")
def vector_diverse(d: Domain) -> DataFrame:
    """The nearest vector of each label, then the nearest of those: no label comes twice."""
    rows = d.t("embeddings").where(F.col("vec_id") != 0).crossJoin(query_vector(d)).select("vec_id", "label", cosine(F.col("embedding"), F.col("asked")).alias("s"))
    best = first_per_key(rows, ["label"], [F.desc("s"), F.col("vec_id")])
    return best.orderBy(F.desc("s"), "vec_id").limit(20).select("vec_id", "label", F.round("s", 6).alias("score"))


def optional_search(rows: DataFrame, columns: tuple[str, ...], asked: str | None, order: list, limit: int) -> DataFrame:
    """Rows that hold ``asked`` in one of the columns, those where the first column starts with it first; all rows without it."""
    if asked:
        rows = rows.where(F.coalesce(any_of([contains(F.col(c), asked) for c in columns]), F.lit(False)))
        order = [F.when(F.lower(columns[0]).startswith(asked.lower()), 0).otherwise(1), *order]
    return rows.orderBy(*order).limit(limit)


@query("""SELECT 'asked' AS how, p_partkey AS id FROM (SELECT * FROM part WHERE p_name ILIKE '%12%' OR p_brand ILIKE '%12%' ORDER BY CASE WHEN starts_with(lower(p_name), '12') THEN 0 ELSE 1 END, p_retailprice DESC, p_partkey LIMIT 25)
UNION ALL SELECT 'open', p_partkey FROM (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25)""")
def search_optional_query(d: Domain) -> DataFrame:
    """The same list with and without a query."""
    page = lambda asked, how: optional_search(d.t("part"), ("p_name", "p_brand"), asked, [F.desc("p_retailprice"), F.col("p_partkey")], 25).select(F.lit(how).alias("how"), F.col("p_partkey").alias("id"))
    return page("12", "asked").unionByName(page(None, "open"))


_W = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"


@query(f"""WITH {_bm25_sql(('of', 'the', 'die', 'der'), False)} SELECT doc_id, score FROM (
  SELECT s.*, ' ' || array_to_string({_W}, ' ') || ' ' AS line FROM scored s)
WHERE contains(line, ' of the ') AND NOT contains(line, ' to the ') OR contains(line, ' die ') AND contains(line, ' der ') AND NOT contains(line, ' von ')""")
def search_web_question(d: Domain) -> DataFrame:
    """Phrases, alternatives and exclusions in one question, answered from positional postings."""
    return documents_index(d).ask('"of the" -"to the" OR die der -von')


_STEM = """CASE WHEN w LIKE '%ies' AND w NOT LIKE '%eies' AND w NOT LIKE '%aies' THEN w[:-4] || 'y' WHEN w LIKE '%es' AND w NOT LIKE '%aes' AND w NOT LIKE '%ees' AND w NOT LIKE '%oes' THEN w[:-2]
 WHEN w LIKE '%s' AND w NOT LIKE '%us' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END"""


@query(f"""WITH t AS (SELECT doc_id, lang, i, {_STEM} AS term FROM (SELECT doc_id, lang, unnest({_W}) AS w, unnest(range(len({_W}))) AS i FROM documents)
  WHERE w NOT IN ({", ".join(f"'{w}'" for w in STOP_WORDS)}))
SELECT a.lang, count(DISTINCT a.doc_id) AS n FROM t a JOIN t b ON b.doc_id = a.doc_id AND b.i = a.i + 2 WHERE a.term = 'right' AND b.term = 'license'
 OR a.term = 'ing' AND b.term = 'ing' GROUP BY 1""")
def search_english_phrases(d: Domain) -> DataFrame:
    """Stemmed words with stop words between them: 'rights of license' finds 'right a licenses' as well."""
    index = TextIndex.of(d.t("documents"), f"{d.dir}/documents.parquet", columns=("lang",), words=Words(english=True))
    hits = index.ask('"rights the licenses" OR "ing of ing"')
    return hits.join(index.documents, "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
