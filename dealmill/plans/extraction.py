"""Text extraction over documents and pages: chunks, language, fingerprints, citations, titles, plain text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealmill.domain import Domain, with_domain
from dealmill.functions.text import ENGLISH, looks_english, sql_fingerprint
from dealmill.sources.html import clean_contracts, plain_text

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir, f=f: f(Domain(spark, sf_dir))
        if sql:
            SQL[f.__name__] = with_domain(sql)
        return f

    return put


def chunks(documents: DataFrame, size: int = 100, overlap: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, chunk, first, n_words, content: windows of ``size`` words that overlap by ``overlap``; every word is covered."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    rows = documents.select(key, words.alias("w")).where(F.size("w") > 0)
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.size("w") - overlap) / step).cast("int") - 1, F.lit(0)))
    cut = rows.select(key, F.posexplode(F.transform(starts, lambda i: F.slice("w", i * step + 1, F.lit(size)))).alias("chunk", "words"))
    return cut.select(key, "chunk", (F.col("chunk") * step).alias("first"), F.size("words").alias("n_words"), F.array_join("words", " ").alias("content"))


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, w, unnest(range(greatest(ceil((len(w) - 20) / 80)::INT, 1))) AS chunk FROM w WHERE len(w) > 0)
SELECT doc_id, chunk::INT AS chunk, (chunk * 80)::INT AS first, len(w[chunk * 80 + 1:chunk * 80 + 100])::INT AS n_words, md5(array_to_string(w[chunk * 80 + 1:chunk * 80 + 100], ' ')) AS content FROM c""")
def document_chunks(d: Domain) -> DataFrame:
    return chunks(d.t("documents")).withColumn("content", F.md5(F.col("content").cast("binary")))


_WORDS = "list_slice(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z]+')), 1, 200)"
_FREQUENT = ", ".join(f"'{w}'" for w in ENGLISH)


@query(f"SELECT doc_id, len({_WORDS}) > 0 AND len(list_filter({_WORDS}, lambda x: x IN ({_FREQUENT}))) > 0.1 * len({_WORDS}) AS english FROM documents")
def language_heuristic(d: Domain) -> DataFrame:
    return d.t("documents").select("doc_id", looks_english(F.col("text")).alias("english"))


@query("""SELECT fingerprint, count(*) AS n, round(avg(value), 4) AS mean FROM (
 SELECT sha256('select * from t_' || event_type || ' where k = ? and note = ?') AS fingerprint, value FROM events) GROUP BY 1""")
def statement_fingerprints(d: Domain) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    statement = F.concat(F.lit("SELECT *  FROM t_"), "event_type", F.lit(" /* by user */ WHERE k = "), k, F.lit(" AND note = 'n"), k, F.lit("' -- end"))
    return d.t("events").select(sql_fingerprint(statement).alias("fingerprint"), "value").groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@query("""SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '<a href=')) AS links,
 regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang FROM pages""")
def page_outline(d: Domain) -> DataFrame:
    return d.t("pages").select(
        "page_id", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<a href=")).cast("long").alias("links"),
        F.regexp_extract("html", r'<html lang="([a-z]+)"', 1).alias("lang"),
    )


_LEFT_OUT = ("script", "style", "head", "nav", "footer", "noscript")
_BARE = "regexp_replace(html, '<!--.*?-->', '', 'gs')"
for _tag in _LEFT_OUT:
    _BARE = f"regexp_replace({_BARE}, '<{_tag}[^a-z].*?</{_tag}>', ' ', 'gs')"
_BARE = f"regexp_replace({_BARE}, '<(footer|nav)[^a-z].*$', ' ', 'gs')"
for _ref, _char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("nbsp", " "), ("copy", "©"), ("middot", "·"), ("amp", "&")):
    _BARE = f"replace({_BARE if _ref != 'lt' else f"regexp_replace({_BARE}, '<[^>]*>', ' ', 'g')"}, '&{_ref};', '{_char}')"


@query(f"""SELECT page_id, trim(regexp_replace({_BARE}, '\\s+', ' ', 'g')) AS content FROM pages""")
def page_text(d: Domain) -> DataFrame:
    return plain_text(d.t("pages"), "page_id", "html")


_PIECES = r"(?s)\S+\s*|^\s+"


def snapped_chunks(documents: DataFrame, size: int = 800, overlap: int = 125, keep: tuple[str, ...] = ("doc_id",), text: str = "text", at_least: float = 0.7) -> DataFrame:
    """*keep, chunk, content: windows of ``size`` words that overlap by ``overlap``, in the text's own spacing.

    A window before the last ends at its last paragraph break, else at its last end of a sentence, if that lies
    behind ``at_least`` of it. Blank texts give no chunk; a text of one window is given as it is. ``keep`` may name a
    section, whose chunks are then numbered by themselves.
    """
    rows = documents.where(F.col(text).rlike(r"\S")).select(*keep, F.col(text).alias("_text"), F.regexp_extract_all(text, F.lit(_PIECES), 0).alias("_p"))
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.size("_p") - size) / step).cast("int"), F.lit(0)))
    cut = rows.select(*keep, "_text", F.size("_p").alias("_n"), F.posexplode(F.transform(starts, lambda i: F.array_join(F.slice("_p", i * step + 1, F.lit(size)), ""))).alias("chunk", "_c"))
    behind = lambda at: at > at_least * F.char_length("_c")
    paragraph = F.regexp_extract("_c", r"(?s)^(.*)\n\n", 1)
    sentence = F.regexp_extract("_c", r"(?s)^(.*[.!?])[ \n]", 1)
    snapped = F.when(F.col("_c").contains("\n\n") & behind(F.char_length(paragraph)), paragraph).when((sentence != "") & behind(F.char_length(sentence) - 1), sentence).otherwise(F.col("_c"))
    last = F.col("chunk") * step + size >= F.col("_n")
    return cut.select(*keep, "chunk", F.when(F.col("_n") <= size, F.col("_text")).when(last, F.col("_c")).otherwise(F.regexp_replace(snapped, r"\s+$", "")).alias("content"))


@query(r"""WITH w AS (SELECT doc_id, lang, text, regexp_extract_all(text, '(?s)\S+\s*|^\s+') AS p FROM documents WHERE regexp_matches(text, '\S')),
c AS (SELECT doc_id, lang, text, len(p) AS n, chunk, array_to_string(p[chunk * 45 + 1:chunk * 45 + 60], '') AS c FROM (SELECT *, unnest(range(greatest(ceil((len(p) - 60) / 45)::INT, 0) + 1)) AS chunk FROM w)),
s AS (SELECT *, regexp_extract(c, '(?s)^(.*)\n\n', 1) AS para, regexp_extract(c, '(?s)^(.*[.!?])[ \n]', 1) AS sent FROM c)
SELECT doc_id, lang AS section, chunk::INT AS chunk, md5(CASE WHEN n <= 60 THEN text WHEN chunk * 45 + 60 >= n THEN c ELSE regexp_replace(
 CASE WHEN contains(c, chr(10) || chr(10)) AND length(para) > 0.7::DOUBLE * length(c) THEN para WHEN sent <> '' AND length(sent) - 1 > 0.7::DOUBLE * length(c) THEN sent ELSE c END, '\s+$', '') END) AS content FROM s""")
def section_chunks(d: Domain) -> DataFrame:
    """Chunks that end where a paragraph or sentence ends, with the section they are of."""
    rows = d.t("documents").withColumnRenamed("lang", "section")
    return snapped_chunks(rows, 60, 15, ("doc_id", "section")).withColumn("content", F.md5(F.col("content").cast("binary")))


@query(r"""WITH t AS (SELECT doc_id, '<b>A &amp; B</b><br/>' || doc_id || '.  FINANCIAL TERMS' || chr(10) || '- 41 -' || '<para>' || doc_id || '.1   Upfront &#39;Payment&#39;.</para><i>  ' || lang || ' </i>' AS raw FROM documents)
SELECT doc_id, 'A & B' || chr(10) || '## ' || doc_id || '. FINANCIAL TERMS' || chr(10) || chr(10) || '### ' || doc_id || '.1 Upfront ''Payment''.' || chr(10) || chr(10) || lang AS cleaned FROM t JOIN documents USING (doc_id)""")
def cleaned_contracts(d: Domain) -> DataFrame:
    """Tagged contract texts as plain text with headings."""
    id_ = F.col("doc_id").cast("string")
    raw = F.concat(F.lit("<b>A &amp; B</b><br/>"), id_, F.lit(".  FINANCIAL TERMS\n- 41 -<para>"), id_, F.lit(".1   Upfront &#39;Payment&#39;.</para><i>  "), "lang", F.lit(" </i>"))
    return clean_contracts(d.t("documents").select("doc_id", raw.alias("raw")), "raw", "cleaned").select("doc_id", "cleaned")


@query("""SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, sum(length(coalesce(text, '')))::BIGINT AS chars, max(turn) AS last_turn FROM conversations GROUP BY 1""")
def conversation_roles(d: Domain) -> DataFrame:
    return d.t("conversations").groupBy("role").agg(
        F.count(F.lit(1)).alias("turns"), F.countDistinct("conv_id").alias("conversations"), F.sum(F.char_length(F.coalesce("text", F.lit("")))).alias("chars"), F.max("turn").alias("last_turn")
    )
