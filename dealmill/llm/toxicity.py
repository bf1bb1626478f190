"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded text.

Folding undoes the usual disguises: full-width and accented forms, look-alike letters of other scripts, digits
and signs inside words, zero-width characters. ``l`` and ``i`` fold to one letter, since ``1`` stands for both.
Lexicon and text are folded alike. A match counts at word boundaries only and not inside an exception phrase.

The lexicon starts from a short seed list and learns weights, as smoothed log odds of a word's document
frequencies, from labelled rows. Exception phrases (a term with a neighbour) are those that come up in clean
labelled rows and not in toxic ones. The sum of weights is normalised by text length and turned into a
probability by a logistic curve fitted on the same rows. Labels, language, source and id never enter a score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from dealmill.llm.common import in_slices, materialize, scratch

# Common insults, and phrases in which one of them is harmless.
SEED_TERMS = (
    "idiot", "moron", "imbecile", "stupid", "dumb", "fool", "loser", "scum", "trash", "garbage", "pathetic", "worthless", "disgusting",
    "clown", "jerk", "creep", "vermin", "filth", "freak", "coward",
)
SEED_EXCEPTIONS = ("idiot proof", "trash can", "trash bin", "garbage collection", "garbage collector", "garbage can", "clown fish", "class clown", "control freak", "sore loser")
# Look-alikes of Latin letters in Cyrillic and Greek, and digits and signs used as letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t",
    "у": "y", "х": "x", "ԁ": "d", "ɡ": "g", "ո": "n", "ԝ": "w", "ѵ": "v", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɩ": "i", "ł": "l", "ø": "o", "đ": "d", "ӏ": "l", "ƅ": "b", "ʟ": "l",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "€": "e"}
_ZERO_WIDTH = dict.fromkeys(map(ord, "­​‌‍⁠﻿"))
_TABLE = {ord(k): v for k, v in LOOKALIKES.items()} | {ord("l"): "i"}
_WITH_DIGIT = re.compile(r"[^\W_]*\d[^\W_]*")
_SIGN_IN_WORD = re.compile(r"(?<=\w)[@$€](?=\w)|(?<!\S)[@$](?=[^\W\d_]{2})")
_WORD = re.compile(r"[^\W\d_]+")


def _letters(m: re.Match) -> str:
    """Digits read as letters in a word that has two letters or more; numbers stay."""
    word = m[0]
    return "".join(DIGITS.get(c, c) for c in word) if sum(map(str.isalpha, word)) >= 2 else word


def fold(text: str) -> str:
    """The text as it is matched: one string of folded characters, other characters left as they are."""
    low = text.lower()
    if not low.isascii():
        low = unicodedata.normalize("NFKD", low).translate(_ZERO_WIDTH)
        low = "".join(c for c in low if not unicodedata.combining(c)) if any(map(unicodedata.combining, set(low))) else low
    low = _SIGN_IN_WORD.sub(lambda m: SIGNS[m[0]], low)
    low = _WITH_DIGIT.sub(_letters, low)
    return low.translate(_TABLE) if not low.isascii() else low.replace("l", "i")


@dataclass
class ToxicityModel:
    """What scoring needs. Its size is bounded by the labelled rows it was fitted on, not by the corpus."""

    weights: dict[str, float]
    exceptions: set[str] = field(default_factory=set)
    bias: float = -2.5
    slope: float = 1.5
    per_words: float = 1000.0

    def matcher(self):
        """text -> (folded text, word count, [(term, start, end)] outside exceptions)."""
        import ahocorasick

        machine = ahocorasick.Automaton()
        for phrase in self.exceptions:
            machine.add_word(phrase, (phrase, True))
        for term in self.weights:
            machine.add_word(term, (term, False))
        if len(machine):
            machine.make_automaton()

        def edges(text: str, a: int, b: int) -> bool:
            return not (a and text[a - 1].isalpha()) and not (b < len(text) and text[b].isalpha())

        def match(text: str):
            folded = fold(text)
            words = len(_WORD.findall(folded))
            hits, spared = [], []
            if len(machine):
                for end, (term, harmless) in machine.iter(folded):
                    a, b = end - len(term) + 1, end + 1
                    if edges(folded, a, b):
                        (spared if harmless else hits).append((term, a, b))
            return folded, words, [h for h in hits if not any(a <= h[1] and h[2] <= b for _, a, b in spared)]

        return match

    def feature(self, words: int, hits: list[tuple[str, int, int]]) -> float:
        """Sum of weights, normalised by length."""
        return sum(self.weights[t] for t, _, _ in hits) / math.sqrt(1 + words / self.per_words)

    def probability(self, x: float) -> float:
        z = self.bias + self.slope * x
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of folded words by label, summed over each batch."""
    for batch in in_slices(batches):
        toxic, clean = Counter(), Counter()
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            (toxic if label else clean).update(set(_WORD.findall(fold(text or ""))))
        terms = list(toxic.keys() | clean.keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string()), pa.array([toxic[t] for t in terms], pa.int64()), pa.array([clean[t] for t in terms], pa.int64())], ["term", "toxic", "clean"]
        )


def phrases_around(folded: str, hits: list[tuple[str, int, int]]) -> set[str]:
    """The matched terms with either neighbour: whole words that one space parts from them."""
    spans = [m.span() for m in _WORD.finditer(folded)] if hits else []
    starts, ends, out = [a for a, _ in spans], [b for _, b in spans], set()
    for term, a, b in hits:
        k = bisect_left(ends, a - 1)
        if k < len(ends) and ends[k] == a - 1 and folded[a - 1] == " ":
            out.add(f"{folded[starts[k] : ends[k]]} {term}")
        k = bisect_left(starts, b + 1)
        if k < len(starts) and starts[k] == b + 1 and folded[b] == " ":
            out.add(f"{term} {folded[starts[k] : ends[k]]}")
    return out


def _contexts(model: ToxicityModel):
    """For each labelled text: its feature, and its matched terms with either neighbour."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = model.matcher()
        for batch in in_slices(batches):
            xs, phrases = [], []
            for text in batch.column("text").to_pylist():
                folded, words, hits = match(text or "")
                xs.append(model.feature(words, hits))
                phrases.append(sorted(phrases_around(folded, hits)))
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.float64()), pa.array(phrases, pa.list_(pa.string())), batch.column("label")], ["x", "phrases", "label"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Newton's method for one feature, with a small ridge; the slope stays positive."""
    design, beta = np.stack([np.ones_like(x), x], 1), np.array([-2.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (y - p) - ridge * beta
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + (ridge + 1e-9) * np.eye(2), grad)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(max(beta[1], 0.05))


def fit_toxicity(documents: DataFrame, labels: DataFrame, sample: int = 20_000, min_docs: int = 8, min_z: float = 7.0) -> ToxicityModel:
    """Fits on at most ``sample`` labelled documents, drawn by a digest of doc_id, which bounds the model as well.

    All terms and exception phrases that pass the thresholds are kept. ``labels`` has doc_id and toxic (0/1) of the rows that may be learned from. Null labels and ids are left
    out; of repeated labels the largest counts, of repeated documents one. Without any, the seeds stand.
    """
    drawn = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    texts = documents.where(F.col("text").isNotNull()).select("doc_id", "text")
    rows = materialize(texts.join(F.broadcast(drawn), "doc_id").dropDuplicates(["doc_id"]).select("text", "label"), "toxicity-sample")
    seen = {int(r["label"] > 0): r["count"] for r in rows.groupBy("label").count().collect()}
    n_toxic, n_clean = seen.get(1, 0), seen.get(0, 0)
    terms = rows.mapInArrow(_term_counts, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    rate = n_toxic / max(1, n_toxic + n_clean)
    seen_in = F.col("toxic") + F.col("clean")
    z = (F.col("toxic") - seen_in * rate) / F.sqrt(seen_in * max(rate * (1 - rate), 1e-9))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    seeds = sorted({fold(t) for t in SEED_TERMS})
    learned = terms.where(((F.col("toxic") >= min_docs) & (z >= min_z) & (odds > math.log(4)) & (F.char_length("term") >= 3)) | F.col("term").isin(seeds))
    found = learned.collect()  # bounded by the sample
    weights = {t: 2.0 for t in seeds}
    for r in found:  # a seed counts as seen in one toxic text more
        own = r["toxic"] + (r["term"] in weights)
        weights[r["term"]] = math.log((own + 0.5) / (n_toxic + 1)) - math.log((r["clean"] + 0.5) / (n_clean + 1))
    model = ToxicityModel({t: min(w, 8.0) for t, w in weights.items() if w > 0.5}, {fold(p) for p in SEED_EXCEPTIONS})
    if n_toxic and n_clean:
        around = materialize(rows.mapInArrow(_contexts(model), "x double, phrases array<string>, label int"), "toxicity-contexts")
        harmless = around.select(F.explode("phrases").alias("phrase"), "label").groupBy("phrase").agg(F.sum(F.when(F.col("label") > 0, 1).otherwise(0)).alias("toxic"), F.count("*").alias("n"))
        harmless = harmless.where((F.col("toxic") == 0) & (F.col("n") >= 5))
        model.exceptions |= {r["phrase"] for r in harmless.collect()}
        fitted = rows.mapInArrow(_contexts(model), "x double, phrases array<string>, label int").select("x", "label").toPandas()  # at most ``sample`` rows
        model.bias, model.slope = _logistic(fitted["x"].to_numpy(), (fitted["label"] > 0).to_numpy(float))
    return model


def score_toxicity(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """The documents, whole texts scored, with columns ``score`` (0 to 1) and ``predicted`` (score >= 0.5) set last.

    Null and empty texts score as texts without matches. Every row keeps its other columns; columns of the input
    named like the two are replaced. An empty table gives no rows.
    """
    kept = [c for c in documents.columns if c not in ("score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = model.matcher()
        for batch in in_slices(batches):
            scores = []
            for text in batch.column("text").to_pylist():
                _, words, hits = match(text or "")
                scores.append(model.probability(model.feature(words, hits)))
            extra = [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "score", "predicted"])

    source = documents.select(*[F.col(f"`{c}`") for c in kept])
    schema = StructType(list(source.schema.fields)).add("score", DoubleType()).add("predicted", IntegerType())
    return source.mapInArrow(run, schema)


def keep_harmless(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows whose text scores below 0.5, with all their columns, whole texts scored.

    Null and empty texts score as texts without matches and stay; repeated rows stay each; an empty table stays
    empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = model.matcher()
        for batch in in_slices(batches):
            fine = []
            for text in batch.column("text").to_pylist():
                _, words, hits = match(text or "")
                fine.append(model.probability(model.feature(words, hits)) < 0.5)
            yield batch.filter(pa.array(fine, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def held_out_fold():
    """crc32 of the id as text, mod 5, is 0: rows whose labels are never learned from."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def fitted_model(documents: DataFrame, sf_dir: str) -> ToxicityModel:
    labels = documents.sparkSession.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    with scratch(documents.sparkSession):
        return fit_toxicity(documents, labels.where(~held_out_fold()))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score_toxicity(docs, fitted_model(docs, sf_dir))
    return scored.select("doc_id", held_out_fold().alias("held_out"), "score", "predicted")
