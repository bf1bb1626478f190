"""A stored positional index over a table of texts: phrases, alternatives and exclusions, ranked by BM25.

The index is built once for a state of the table: postings (term, key, tf, size, positions), dealt by ranges of
(term, key) and sorted, so that a search reads only the row groups of its terms and a frequent term is spread over
many files; and the documents without their texts, with sizes and the columns that filters use. It lies below
spark.checkpoint.dir, which driver and executors share, under digests of everything it depends on: the table's files,
the frame that is indexed, key, text, columns and the rules for words.
"""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: Goes up when words are cut or stored in another way.
VERSION = 2
#: English words that say nothing by themselves.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "if", "in", "into", "is", "it", "its", "no", "not", "of", "on", "or", "such", "that", "the",
    "their", "then", "there", "these", "they", "this", "to", "was", "were", "which", "will", "with",
)


@dataclass(frozen=True)
class Words:
    """How texts and questions are cut into words: runs of letters and digits, lower-cased.

    With ``english``, stop words are left out (they keep their places in phrases) and plurals lose their ending, by
    the published S-stemmer's three rules.
    """

    english: bool = False

    def stem(self, word: Column) -> Column:
        if not self.english:
            return word
        ends = word.endswith
        ies = ends("ies") & ~ends("eies") & ~ends("aies")
        es = ends("es") & ~ends("aes") & ~ends("ees") & ~ends("oes")
        s = ends("s") & ~ends("us") & ~ends("ss")
        cut = lambda n, more="": F.concat(F.left(word, F.char_length(word) - n), F.lit(more))
        return F.when(ies, cut(3, "y")).when(es, cut(1)).when(s, cut(1)).otherwise(word)

    def placed(self, text: Column) -> Column:
        """(place, term) of each word of a text, places counted from 0 over all words."""
        words = F.transform(tokens(text), lambda w, i: F.struct(i.alias("place"), self.stem(w).alias("term"), w.alias("word")))
        if self.english:
            words = F.filter(words, lambda w: ~w["word"].isin(*STOP_WORDS))
        return F.transform(words, lambda w: F.struct(w["place"].alias("place"), w["term"].alias("term")))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def inverted_index(documents: DataFrame, key: str = "doc_id", text: str = "text", words: Words = Words()) -> DataFrame:
    """term, key, size, tf, positions: one row for each term of each document; made in the task that read it."""
    cut = documents.select(key, F.size(tokens(F.col(text))).cast("long").alias("size"), words.placed(F.col(text)).alias("words"))
    found = cut.select(key, "size", F.explode("words").alias("w"))  # sizes are taken below: above, each word would cost its whole text
    by = found.groupBy(F.col("w.term").alias("term"), key, "size")
    return by.agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("w.place")).alias("positions"))


#: A question: words, "phrases", -excluded ones, and OR between alternatives; OR binds less than standing side by side.
_PART = re.compile(r'(-?)(?:"([^"]*)"?|(\S+))')


def alternatives(question: str) -> list[list[tuple[bool, str]]]:
    """The question as alternatives, each a list of (wanted, words) that must all hold."""
    out: list[list[tuple[bool, str]]] = [[]]
    for minus, phrase, word in _PART.findall(question):
        if word.lower() == "or" and not minus:
            out.append([])
        elif phrase or word:
            out[-1].append((not minus, phrase or word))
    return [a for a in out if a]


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _digest(*parts: object) -> str:
    return hashlib.sha256("\n".join(map(str, parts)).encode()).hexdigest()[:24]


def _state(spark: SparkSession, table: str) -> str:
    """Digest of the names, lengths and times of a table's files."""
    p, fs = _fs(spark, table)
    files, seen = fs.listFiles(p, True), []
    while files.hasNext():
        f = files.next()
        seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return _digest(*sorted(seen))


def _plan(df: DataFrame) -> str:
    """What a frame computes, without the numbers that differ from call to call."""
    return re.sub(r"#\d+L?", "", df._jdf.queryExecution().analyzed().toString())


@dataclass
class TextIndex:
    postings: DataFrame
    documents: DataFrame
    key: str
    n: int
    mean_size: float
    words: Words

    @classmethod
    def of(cls, documents: DataFrame, table: str, key: str = "doc_id", text: str = "text", columns: Sequence[str] = (), words: Words = Words()) -> TextIndex:
        """The index of ``documents``, read from the files of ``table``; built where it is not stored yet.

        Two builders may work at a time: each writes beside, and the first to end gives its files the name. Indexes of
        earlier states of the table stay readable until drop_older() is called.
        """
        spark = documents.sparkSession
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = os.path.join(tempfile.gettempdir(), "checkpoints")
        what = _digest(VERSION, table, _plan(documents), documents.schema.json(), key, text, list(columns), words)
        folder = f"{base.rstrip('/')}/text-index/{what}/{_state(spark, table)}"
        place, fs = _fs(spark, folder)
        if not fs.exists(place):
            beside = f"{base.rstrip('/')}/text-index/_building-{uuid.uuid4().hex}"
            postings = inverted_index(documents, key, text, words)
            postings.repartitionByRange("term", key).sortWithinPartitions("term", key).write.parquet(f"{beside}/postings")
            sized = documents.select(key, F.size(tokens(F.col(text))).cast("long").alias("size"), *columns)
            sized.write.parquet(f"{beside}/documents")
            stats = spark.read.parquet(f"{beside}/documents").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("size"), F.lit(1.0)).alias("mean_size"))
            stats.write.parquet(f"{beside}/stats")
            fs.mkdirs(place.getParent())
            built = _fs(spark, beside)[0]
            if fs.exists(place) or not fs.rename(built, place):
                fs.delete(built, True)
            inside = _fs(spark, f"{folder}/{built.getName()}")[0]  # where another builder was first by a moment
            if fs.exists(inside):
                fs.delete(inside, True)
        n, mean_size = spark.read.schema("n long, mean_size double").parquet(f"{folder}/stats").first()
        kept = {f.name: f.dataType.simpleString() for f in documents.schema.fields}
        doc_schema = ", ".join([f"{key} {kept[key]}", "size long", *[f"{c} {kept[c]}" for c in columns]])
        postings = spark.read.schema(f"term string, {key} {kept[key]}, size long, tf long, positions array<int>").parquet(f"{folder}/postings")
        return cls(postings, spark.read.schema(doc_schema).parquet(f"{folder}/documents"), key, n, mean_size, words)

    @staticmethod
    def drop_older(spark: SparkSession, table: str) -> None:
        """Removes stored indexes of earlier states of ``table``, once no query reads them."""
        base = spark.conf.get("spark.checkpoint.dir", None) or os.path.join(tempfile.gettempdir(), "checkpoints")
        place, fs = _fs(spark, f"{base.rstrip('/')}/text-index")
        now = _state(spark, table)
        for what in fs.listStatus(place) if fs.exists(place) else ():
            states = [s.getPath() for s in fs.listStatus(what.getPath())]
            if any(s.getName() == now for s in states):
                for s in states:
                    if s.getName() != now:
                        fs.delete(s, True)

    def _weight(self, hits: DataFrame) -> DataFrame:
        counts = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a row for each asked term
        idf = F.log(1 + (F.lit(self.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.lit(self.mean_size)))
        return hits.join(counts, "term").withColumn("_w", weight)

    def search(self, terms: Sequence[str], every: bool = True, without: Sequence[str] = (), where: Column | None = None) -> DataFrame:
        """key, score (BM25) of the documents that hold all (or any) of the terms and none of ``without``.

        ``where`` is a condition on the documents' columns; it doesn't change the score. Reads the terms' postings,
        without positions.
        """
        asked = sorted(set(terms))
        hits = self._weight(self.postings.where(F.col("term").isin(*asked)).drop("positions"))
        found = hits.groupBy(self.key).agg(F.sum("_w").alias("_s"), F.count(F.lit(1)).alias("_n"))
        if every:
            found = found.where(F.col("_n") == len(asked))
        if without:
            found = found.join(self.postings.where(F.col("term").isin(*without)).select(self.key), self.key, "left_anti")
        return self._told(found, where)

    def _told(self, found: DataFrame, where: Column | None) -> DataFrame:
        if where is not None:
            found = found.join(self.documents.where(where).select(self.key), self.key, "left_semi")
        return found.select(self.key, F.round("_s", 6).alias("score"))

    def _terms(self, text: str) -> list[tuple[int, str]]:
        """(place, term) of the words of a question that are stored."""
        spark = self.postings.sparkSession
        return [tuple(w) for w in spark.range(1).select(self.words.placed(F.lit(text)).alias("w")).first()["w"]]

    def ask(self, question: str, where: Column | None = None) -> DataFrame:
        """key, score of the documents that answer a question: words side by side must all hold, "words in quotes" in
        that order next to each other, -words not at all; OR parts alternatives.

        The score is BM25 over the wanted terms that a document holds. A part of stop words alone asks nothing; an
        alternative that wants nothing finds nothing, for it would ask for all documents.
        """
        asked = [[(want, self._terms(part)) for want, part in a] for a in alternatives(question)]
        asked = [[(want, terms) for want, terms in a if terms] for a in asked]
        asked = [a for a in asked if any(want for want, _ in a)]
        if not asked:
            return self._told(self.postings.limit(0).select(self.key, F.lit(0.0).alias("_s")), where)
        wanted = sorted({t for a in asked for want, terms in a if want for _, t in terms})
        read = sorted({t for a in asked for _, terms in a for _, t in terms})
        hits = self._weight(self.postings.where(F.col("term").isin(*read)))
        # at most a row for each asked term meets in a document
        by = hits.groupBy(self.key).agg(F.sum(F.when(F.col("term").isin(*wanted), F.col("_w"))).alias("_s"), F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))

        def holds(terms: list[tuple[int, str]]) -> Column:
            both = shifted(terms[0][1], terms[0][0])
            for place, t in terms[1:]:
                both = F.array_intersect(both, shifted(t, place))
            return F.coalesce(F.size(both) > 0, F.lit(False))

        def shifted(term: str, place: int) -> Column:
            return F.transform(F.col("at")[term], lambda p: p - place)

        found = F.lit(False)
        for a in asked:
            each = F.lit(True)
            for want, terms in a:
                each = each & (holds(terms) if want else ~holds(terms))
            found = found | each
        return self._told(by.where(found), where)


def excerpt(text: Column, terms: Sequence[str], before: int = 40, size: int = 160) -> Column:
    """The part of a text around the first of the terms that it holds, as whole words."""
    at = F.regexp_instr(F.lower(text), F.lit(r"(?<![\p{L}\p{N}])(?:" + "|".join(sorted(terms)) + r")(?![\p{L}\p{N}])"))
    return F.substring(text, F.greatest(F.lit(1), at - before), F.lit(size))
