"""Source divergence audit: how far the word use of each source of a language stands from every other source.

Tasks count words in batches; Spark sums the counts. The kept terms of a language are dealt to blocks, its sources to
bands, and a task gets one block for two bands: a dense int64 matrix of smoothed shares, sources by terms, for each
band. It sets every source of one band against all of the other by broadcasting, which gives a partial matrix of
pairs, and keeps the highest terms of each source in a heap. Partial matrices are summed, heaps are merged. A task's
memory is bounded by block and bands, whatever the number of terms, sources and documents.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dealmill.llm.common import in_slices, materialize, settled

SCALE = 1_000_000_000
#: Bytes of words stay, A-Z as a-z; all others become spaces. Bytes above 0x7F are parts of characters beyond ASCII.
_TO_WORDS = bytes(c | 0x20 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


@dataclass(frozen=True)
class AuditParams:
    #: A term is kept where so many documents of the language have it.
    min_docs: int = 3
    #: Highest terms given for each source.
    terms: int = 200
    #: Terms of a block and sources of a band, about; a digest deals them.
    block: int = 2_048
    band: int = 128
    #: Distinct terms that a task holds before it hands its counts on.
    held: int = 200_000


def words(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters and characters beyond ASCII, A-Z lower-cased."""
    return text.translate(_TO_WORDS).split()


def _counted(held: int):
    """(lang, source, term, count, docs), summed over the rows of a task; a null term stands for the source itself."""
    names = ["lang", "source", "term", "count", "docs"]

    def told(counts: dict, seen: dict) -> pa.RecordBatch:
        rows = [(lang, source, term, n, seen[lang, source][term]) for (lang, source), c in counts.items() for term, n in c.items()]
        rows += [(lang, source, None, 0, 0) for lang, source in counts]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        types = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, size = {}, {}, 0
        for batch in in_slices(batches):
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own, docs = counts.setdefault((lang, source), Counter()), seen.setdefault((lang, source), Counter())
                found, before = words(text), len(own)
                own.update(found)
                docs.update(set(found))
                size += len(own) - before
                if size > held:
                    yield told(counts, seen)
                    counts, seen, size = {}, {}, 0
        yield told(counts, seen)

    return run


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total) in int64, three digits at a time, so that nothing overflows."""
    q, r = np.divmod(counts + 1, total)
    for _ in range(3):
        digit, r = np.divmod(r * 1000, total)
        q = q * 1000 + digit
    return q + 1


def _tile(terms_kept: int):
    """One block of terms for two bands of sources: partial values of pairs, and the highest terms of each source."""
    names = ["lang", "source", "part", "item", "value"]

    def run(tile: pa.Table) -> pa.Table:
        lang, left, right = (tile.column(c)[0].as_py() for c in ("lang", "i", "j"))
        heads = tile.filter(pc.is_null(tile.column("term")))
        rows = tile.filter(pc.is_valid(tile.column("term")))
        sources, bands = heads.column("source").to_pylist(), heads.column("band").to_numpy()
        place = {s: k for k, s in enumerate(sources)}
        totals, block_terms = heads.column("total").to_numpy(), heads.column("block_terms")[0].as_py()
        coded = pa.concat_arrays(rows.column("term").chunks or [pa.array([], pa.binary())]).dictionary_encode()
        terms, column = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        counts = np.zeros((len(sources), len(terms)), np.int64)
        at = np.array([place[s] for s in rows.column("source").to_pylist()], np.int64)
        counts[at, column] = rows.column("count").to_numpy()
        p, absent = shares(counts, totals[:, None]), shares(np.zeros(len(sources), np.int64), totals)
        mine, others = np.nonzero(bands == left)[0], np.nonzero(bands == right)[0]
        out = []
        for g in mine:
            d = p[g][None, :] - p[others]
            values = (d * d // p[others]).sum(1)
            # terms of the block that neither band has: the same share each
            d = absent[g] - absent[others]
            values += (block_terms - len(terms)) * (d * d // absent[others])
            out += [(lang, sources[g], "pair", sources[h].encode(), int(v)) for h, v in zip(others, values, strict=True) if h != g]
        if left == right and len(terms):
            whole = np.zeros(len(terms), np.int64)
            whole[column] = rows.column("lang_count").to_numpy()
            q = shares(whole, heads.column("lang_total").to_numpy()[0])
            for g in mine:
                d = p[g] - q
                high = np.nonzero((counts[g] > 0) & (d > 0))[0]
                values = d[high] * d[high] // q[high]
                best = heapq.nsmallest(terms_kept, zip((-values).tolist(), [terms[k] for k in high], strict=True))
                out += [(lang, sources[g], "term", term, -v) for v, term in best]
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        types = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


def _dealt(key: Column, parts: Column) -> Column:
    return F.pmod(F.xxhash64(key), parts).cast("int")


def source_divergence(documents: DataFrame, params: AuditParams | None = None) -> DataFrame:
    """lang, source, part, item, value, rank: other sources of the language by divergence, and the terms that set a source apart.

    ``documents`` has text, lang and source; other columns are ignored, each row is a document, so repeated rows
    count each. Nulls are read as ''. A source without kept terms still stands against all others of its language; a
    language of one source has no pairs; an empty table gives no rows. Equal values go by the item's UTF-8 bytes. A
    language may hold up to 9 * 10^15 words; beyond that shares would leave int64.
    """
    p = params or AuditParams()
    plain = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    seen = plain.mapInArrow(_counted(p.held), "lang string, source string, term binary, count long, docs long")
    counts = materialize(seen.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")), "term-counts")
    kept = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("lang_count"))
    kept = materialize(kept.where(F.col("docs") >= p.min_docs).drop("docs"), "kept-terms")
    langs = (
        counts.where("term IS NULL").groupBy("lang").agg(F.count("*").alias("n_sources"))
        .join(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_count").alias("n")), "lang", "left").na.fill(0)
        .select("lang", "n_sources", "v", (F.col("n") + F.col("v")).alias("lang_total"), F.greatest(F.lit(1), F.ceil(F.col("v") / p.block)).cast("int").alias("blocks"), F.ceil(F.col("n_sources") / p.band).cast("int").alias("bands"))
    )
    langs = materialize(langs, "languages")
    used = materialize(counts.where("term IS NOT NULL").join(kept, ["lang", "term"]).select("lang", "source", "term", "count", "lang_count"), "used-counts")
    totals = used.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    heads = counts.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang")
    sized = kept.join(langs, "lang").groupBy("lang", _dealt(F.col("term"), F.col("blocks")).alias("b")).agg(F.count("*").alias("block_terms"))
    # a language without words has no shares: its total of 1 only keeps divisions whole
    heads = heads.select("lang", "source", "bands", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), F.greatest(F.coalesce("n", F.lit(0)) + F.col("v"), F.lit(1)).alias("total"), "lang_total")
    heads = heads.join(sized, ["lang", "b"], "left").select(
        "lang", "b", "source", "bands", F.lit(None).cast("binary").alias("term"), F.lit(0).cast("long").alias("count"), F.lit(0).cast("long").alias("lang_count"), "total", "lang_total", F.coalesce("block_terms", F.lit(0)).alias("block_terms")
    )
    nothing = F.lit(0).cast("long")
    rows = used.join(langs, "lang").select("lang", _dealt(F.col("term"), F.col("blocks")).alias("b"), "source", "bands", "term", "count", "lang_count", nothing.alias("total"), "lang_total", nothing.alias("block_terms"))
    every = F.sequence(F.lit(0), F.col("bands") - 1)
    mine = heads.unionByName(rows).withColumn("band", _dealt(F.col("source"), F.col("bands")))
    pairs = F.array_distinct(F.concat(F.transform(every, lambda x: F.struct(F.col("band").alias("i"), x.alias("j"))), F.transform(every, lambda x: F.struct(x.alias("i"), F.col("band").alias("j")))))
    tiles = mine.withColumn("at", F.explode(pairs)).select("lang", "b", "at.i", "at.j", "band", "source", "term", "count", "lang_count", "total", "lang_total", "block_terms")
    told = tiles.groupBy("lang", "b", "i", "j").applyInArrow(_tile(p.terms), "lang string, source string, part string, item binary, value long")
    told = materialize(told, "tiles")
    summed = told.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = summed.withColumn("rank", F.row_number().over(order))
    merged = told.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.terms)
    return ranked.unionByName(merged).select("lang", "source", "part", F.col("item").cast("string").alias("item"), "value", "rank")


@settled
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents
), c AS (
  SELECT rid, lang, source, term, count(*) AS n FROM (SELECT rid, lang, source, unnest(words) AS term FROM d) GROUP BY ALL
), kept AS (
  SELECT lang, term, sum(n)::HUGEINT AS lang_count FROM c GROUP BY lang, term HAVING count(*) >= 3
), g AS (
  SELECT DISTINCT lang, source FROM d
), cells AS (
  SELECT g.lang, g.source, k.term, k.lang_count, coalesce(n, 0)::HUGEINT AS n
  FROM g JOIN kept k USING (lang) LEFT JOIN (SELECT lang, source, term, sum(n) AS n FROM c GROUP BY ALL) s
    ON s.lang = g.lang AND s.source = g.source AND s.term = k.term
), p AS (
  SELECT lang, source, term, n, 1 + 1000000000 * (n + 1) // (sum(n) OVER w + count(*) OVER w)::HUGEINT AS p,
         1 + 1000000000 * (lang_count + 1) // (sum(lang_count) OVER w + count(*) OVER w)::HUGEINT AS q
  FROM cells WINDOW w AS (PARTITION BY lang, source)
), pair AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM (FROM pairs UNION ALL FROM terms) QUALIFY part = 'pair' OR rank <= 200
"""
