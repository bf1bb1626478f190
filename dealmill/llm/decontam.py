r"""Benchmark decontamination over a distributed positional inverted index, with DataFrame expressions only.

``build_index`` stores, as Parquet in the shared folder, one posting (rid, doc_id, term_id, pos) for every
occurrence in the training texts of a term of the test items, whole corpus, whole texts, and one closing row per
document (term_id 0) whose pos is its number of words. ``exact_matches`` takes the rarest terms of each window
by the index's own counts, turns their postings into start positions (pos - offset) and intersects those lists;
from the second list on, only the postings of documents that still have a start are read, to keep the starts at
which every term of the window has a posting at its offset. ``proximity_matches`` finds windows all of whose terms
lie close together, in any order. Texts are matched with the terms as strings; 64-bit digests name terms and
windows of the tests only, and are checked to be distinct.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dealmill.llm.common import lower_ascii, materialize, settled

WINDOW = 10
#: Words are runs of 0-9, a-z and characters beyond ASCII, after lower-casing A-Z.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_CLOSING = "."  # no word, for it holds no word character
#: A vocabulary of at most so many bytes (texts of its terms and 32 for each) is sent to all executors; a larger one is
#: left to Spark, whose own threshold is lower.
BROADCAST_BYTES = 32 << 20
#: Parts that the postings of one term are dealt to where they are joined by term.
PARTS = 16


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), _BETWEEN), "")


@dataclass
class TestWindows:
    """The tests: terms (term, term_id), windows (win, len, ids: array of term_id), items (win, item_id)."""

    terms: DataFrame
    windows: DataFrame
    items: DataFrame
    term_bytes: int


def test_windows(items: DataFrame, window: int = WINDOW) -> TestWindows:
    """All windows of ``window`` consecutive words of each item; an item with fewer words, but not none, is one.

    ``items`` has item_id and text. Null and wordless texts give no window; repeated items and texts share
    windows.
    """
    worded = items.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (window - 1), F.lit(1)))
    cut = worded.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("words", s, F.lit(window)))).alias("words"))
    cut = materialize(cut.select("item_id", "words", F.xxhash64(F.array_join("words", " ")).alias("win")).distinct(), "bench-windows")
    terms = materialize(cut.select(F.explode("words").alias("term")).distinct().select("term", F.xxhash64("term").alias("term_id")), "bench-terms")
    windows = cut.dropDuplicates(["win"]).select("win", F.size("words").alias("len"), F.transform("words", lambda w: F.xxhash64(w)).alias("ids"))
    size, n, n_ids, n_zero = terms.agg(F.sum(F.octet_length("term") + 32), F.count(F.lit(1)), F.count_distinct("term_id"), F.count_if(F.col("term_id") == 0)).first()
    n_words, n_wins = cut.agg(F.count_distinct("words"), F.count_distinct("win")).first()
    if n != n_ids or n_zero or n_words != n_wins:
        raise ValueError("two terms or windows of the tests have one digest")
    return TestWindows(terms, materialize(windows, "bench-ids"), cut.select("win", "item_id").distinct(), size or 0)


def build_index(documents: DataFrame, tests: TestWindows) -> DataFrame:
    """The postings of the tests' terms in all documents, plus one closing row for each document.

    ``documents`` has doc_id and text. ``rid`` numbers the rows, so repeated and null ids stay apart; it is fixed
    here once, by being written.
    """
    closing = documents.sparkSession.createDataFrame([(_CLOSING, 0)], "term string, term_id long")
    known = tests.terms.unionByName(closing)
    if tests.term_bytes <= BROADCAST_BYTES:
        known = F.broadcast(known)
    numbered = documents.select("doc_id", F.monotonically_increasing_id().alias("rid"), F.array_append(words_of(F.col("text")), F.lit(_CLOSING)).alias("words"))
    postings = numbered.select("rid", "doc_id", F.posexplode("words").alias("pos", "term"))
    return materialize(postings.join(known, "term").select("rid", "doc_id", "term_id", "pos"), "postings")


def _rarest(index: DataFrame, tests: TestWindows, lists: int) -> DataFrame:
    """win, len, rank, term_id, off, n: the ``lists`` rarest terms of each window, by their number of postings."""
    frequency = index.where(F.col("term_id") != 0).groupBy("term_id").agg(F.count(F.lit(1)).alias("n"))
    places = tests.windows.select("win", "len", F.posexplode("ids").alias("off", "term_id"))
    places = places.groupBy("win", "len", "term_id").agg(F.min("off").alias("off"))
    ranked = places.join(frequency, "term_id", "left").withColumn(
        "rank", F.row_number().over(W.partitionBy("win").orderBy(F.coalesce("n", F.lit(0)), "off"))
    )
    return ranked.where(F.col("rank") <= lists).select("win", "len", "rank", "term_id", "off", F.coalesce("n", F.lit(0)).alias("n"))


def _at_terms(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """postings joined with ``terms`` (some rows for each term_id, of the tests' size) by term; a hot term is dealt to parts."""
    copies = terms.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return postings.withColumn("part", F.pmod(F.xxhash64("rid"), F.lit(PARTS)).cast("int")).join(copies, ["term_id", "part"]).drop("part")


def exact_matches(index: DataFrame, tests: TestWindows, lists: int = 3) -> DataFrame:
    """rid, win, start, len: every occurrence of every window."""
    anchors = materialize(_rarest(index, tests, lists), "anchors")
    postings = index.where(F.col("term_id") != 0).select("rid", "term_id", "pos")
    starts, within = None, postings
    for rank in range(1, lists + 1):  # from the rarest list on, each further list only confirms starts
        at_rank = anchors.where(F.col("rank") == rank).select("win", "term_id", "off")
        listed = _at_terms(within, at_rank).select("rid", "win", (F.col("pos") - F.col("off")).alias("start")).where(F.col("start") >= 0)
        if rank > 1:
            alone = starts.join(at_rank.select("win"), "win", "left_anti")  # windows with fewer different terms
            listed = starts.join(listed, ["rid", "win", "start"]).unionByName(alone)
        starts = materialize(listed, "starts")
        if rank == min(2, lists):
            within = materialize(postings.join(materialize(starts.select("rid").distinct(), "start-rids"), "rid", "left_semi"), "postings-at-starts")
    sought = starts.join(tests.windows, "win").select("rid", "win", "start", "len", F.posexplode("ids").alias("off", "term_id"))
    sought = sought.select("rid", "win", "start", "len", "term_id", (F.col("start") + F.col("off")).alias("pos"))
    return (
        sought.join(within, ["rid", "pos", "term_id"])
        .groupBy("rid", "win", "start", "len").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") == F.col("len")).drop("n")
    )


def proximity_matches(index: DataFrame, tests: TestWindows, slop: int = 5, lists: int = 3) -> DataFrame:
    """rid, win, at: places of a window's rarest term with all its terms within len + slop words, any order.

    The span runs from the first to the last word of the match and holds the rarest term's posting. Positions are
    dealt to stretches as long as the widest span, and a place is held against its own stretch and the two beside it
    only, so a word that a document repeats costs each place a bounded number of postings. Places without a next
    rarer term near them are left out before the other terms are read.
    """
    ranked = materialize(_rarest(index, tests, lists), "near-anchors")
    rare = ranked.where(F.col("rank") == 1).select("win", "len", "term_id")
    postings = index.where(F.col("term_id") != 0).select("rid", "term_id", "pos")
    at = _at_terms(postings, rare).select("rid", "win", "len", F.col("pos").alias("at"))
    widest = (tests.windows.agg(F.coalesce(F.max("len"), F.lit(1))).first()[0] or 1) + slop
    stretch = lambda pos: F.floor(pos / widest).cast("int")

    def near(at: DataFrame, terms: DataFrame, among: DataFrame) -> DataFrame:
        """Postings (pos) of ``terms`` (win, term_id), from ``among``, in reach of each place."""
        own = stretch(F.col("at"))
        asked = at.join(terms, "win").withColumn("part", F.explode(F.array(own - 1, own, own + 1)))
        return asked.join(among.withColumn("part", stretch(F.col("pos"))), ["rid", "term_id", "part"]).where(F.abs(F.col("pos") - F.col("at")) < F.col("len") + slop)

    for rank in range(2, lists + 1):
        next_rare = ranked.where(F.col("rank") == rank).select("win", "term_id")
        alone = at.join(next_rare.select("win"), "win", "left_anti")  # windows with fewer different terms
        listed = postings.join(next_rare.select("term_id").distinct(), "term_id", "left_semi")  # of the tests' size
        at = materialize(near(at, next_rare, listed).select("rid", "win", "len", "at").distinct().unionByName(alone), "near-places")
    terms = tests.windows.select("win", F.explode(F.array_distinct("ids")).alias("term_id"), F.size(F.array_distinct("ids")).alias("n_terms"))
    # each place in reach opens a span of len + slop words; one that holds the anchor and all terms is a match
    # written, so that Spark knows their size before it decides whether all postings have to be shuffled
    within = postings.join(materialize(at.select("rid").distinct(), "near-rids"), "rid", "left_semi")
    spans = near(at, terms, within).groupBy("rid", "win", "at", "len", "n_terms").agg(F.collect_set(F.struct("pos", "term_id")).alias("p"))
    width = F.col("len") + slop
    fits = F.exists(
        "p",
        lambda first: (first["pos"] <= F.col("at")) & (first["pos"] + width > F.col("at"))
        & (F.size(F.array_distinct(F.transform(F.filter("p", lambda q: (q["pos"] >= first["pos"]) & (q["pos"] < first["pos"] + width)), lambda q: q["term_id"]))) == F.col("n_terms")),
    )
    return spans.where(fits).select("rid", "win", "at")


def _named_items(found: DataFrame, tests: TestWindows, name: str) -> DataFrame:
    """rid, ``name``: the ids of the items of a document's windows, as sorted strings without null."""
    by_item = found.select("rid", "win").distinct().join(tests.items, "win").select("rid", F.col("item_id").cast("string").alias("item")).distinct()
    return by_item.groupBy("rid").agg(F.sort_array(F.collect_list("item")).alias(name))


def decontaminate(documents: DataFrame, items: DataFrame, window: int = WINDOW, slop: int | None = 5) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, spans, items, contaminated, and of its proximity matches n_near, near_items.

    ``documents`` has doc_id and text, ``items`` item_id and text; other columns are ignored. Null texts have no
    words and no hits; null and repeated doc_ids keep a row each; empty tables give no rows, or no hits.
    ``spans`` are the merged stretches [from, to) of hit words, ``items`` the ids of the items found, as sorted
    strings (a null id is left out). ``n_near`` is the number of proximity matches, ``near_items`` names their items
    in the same way; exact matches are among them. Without ``slop`` these two columns are not made. Only exact
    matches contaminate.
    """
    tests = test_windows(items, window)
    index = build_index(documents, tests)
    found = materialize(exact_matches(index, tests), "matches")
    stretches = found.groupBy("rid", "start").agg(F.max("len").alias("len"))
    before = W.partitionBy("rid").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    joined = stretches.withColumn("reach", F.max(F.col("start") + F.col("len")).over(before))
    opened = joined.withColumn("part", F.sum(F.when(F.col("reach") >= F.col("start"), 0).otherwise(1)).over(W.partitionBy("rid").orderBy("start")))
    merged = opened.groupBy("rid", "part").agg(F.min("start").alias("from"), F.max(F.col("start") + F.col("len")).alias("to"))
    hits = merged.groupBy("rid").agg(
        F.sum(F.col("to") - F.col("from")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("from", "to"))).alias("spans")
    )
    named = _named_items(found, tests, "items")
    rows = index.where(F.col("term_id") == 0).select("rid", "doc_id", F.col("pos").cast("long").alias("n_words"))
    judged, near = rows.join(hits.join(named, "rid", "left"), "rid", "left"), []
    if slop is not None:
        close = materialize(proximity_matches(index, tests, slop), "near")
        places = close.groupBy("rid").agg(F.count(F.lit(1)).alias("n_near"))
        judged = judged.join(places.join(_named_items(close, tests, "near_items"), "rid", "left"), "rid", "left")
        near = [F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.coalesce("near_items", F.array().cast("array<string>")).alias("near_items")]
    return judged.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        "spans",
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        *near,
    )


@settled
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate(docs, items).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
        "n_near",
    )


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM benchmark
), win AS (
  SELECT DISTINCT item_id, phrase, len FROM (
    SELECT item_id, unnest(list_transform(range(1, greatest(len(words) - 9, 1) + 1), lambda i: array_to_string(words[i:i + 9], ' '))) AS phrase,
           least(len(words), 10) AS len FROM b WHERE len(words) > 0)
), lens AS (SELECT DISTINCT len FROM win
), grams AS (
  SELECT rid, len, s, array_to_string(words[s:s + len - 1], ' ') AS phrase
  FROM (SELECT rid, words, l.len, unnest(range(1, len(words) - l.len + 2)) AS s FROM d, lens l WHERE len(words) >= l.len)
), hit AS (
  SELECT DISTINCT g.rid, g.s, g.len, w.item_id FROM grams g JOIN win w ON w.phrase = g.phrase AND w.len = g.len
), hit_words AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + len)) AS p FROM hit) GROUP BY rid
), hit_items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY rid
), wins AS (SELECT DISTINCT phrase, len FROM win
), win_terms AS (
  SELECT phrase, len, term, min(off) AS off FROM (SELECT phrase, len, unnest(string_split(phrase, ' ')) AS term, unnest(range(1, len + 1)) AS off FROM wins) GROUP BY ALL
), occ AS (
  SELECT rid, pos, term FROM (SELECT rid, unnest(words) AS term, unnest(range(1, len(words) + 1)) AS pos FROM d) WHERE term IN (SELECT term FROM win_terms)
), rare AS (
  SELECT phrase, len, t.term, count(*) OVER (PARTITION BY phrase) AS n_terms FROM win_terms t LEFT JOIN (SELECT term, count(*) AS n FROM occ GROUP BY 1) c ON c.term = t.term
  QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY coalesce(n, 0), off) = 1
), around AS (
  SELECT r.phrase, r.len, r.n_terms, a.rid, a.pos AS anchor, o.pos, o.term FROM rare r JOIN occ a ON a.term = r.term JOIN occ o ON o.rid = a.rid AND abs(o.pos - a.pos) < r.len + 5
  WHERE EXISTS (SELECT 1 FROM win_terms t WHERE t.phrase = r.phrase AND t.term = o.term)
), near AS (
  SELECT rid, count(*) AS n_near FROM (
    SELECT DISTINCT phrase, rid, anchor FROM (
      SELECT f.phrase, f.rid, f.anchor FROM around f JOIN around q ON q.phrase = f.phrase AND q.rid = f.rid AND q.anchor = f.anchor AND q.pos >= f.pos AND q.pos < f.pos + f.len + 5
      WHERE f.pos <= f.anchor AND f.pos + f.len + 5 > f.anchor GROUP BY f.phrase, f.rid, f.anchor, f.pos HAVING count(DISTINCT q.term) = any_value(f.n_terms))) GROUP BY rid
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN hit_words USING (rid) LEFT JOIN hit_items USING (rid) LEFT JOIN near USING (rid)
"""
