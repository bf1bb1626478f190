"""Token counts behind a digest cache.

A text is counted once per tokenizer version: counts are stored by the digest of the normalised content and the
digest of the tokenizer file. Only distinct contents without a stored count are encoded; their counts are
appended to the cache, and every document takes its count from there.

Normalising replaces each run of ASCII white space by one space and trims the ends. The tokenizer drops white
space, so this never changes a count; letters are left alone, for lower-casing before composition can.

Where the tokenizer's file shows that nothing in it reaches over a space, a text's count is the sum of the counts of
its stretches between spaces. Those are remembered by each Python worker, so a word is encoded once in a worker and not
once for each time it occurs.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealmill.llm.common import join_spread, materialize, settled, shared_dir

CACHE_SCHEMA = "content binary, tokenizer string, n_tokens long"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))


def tokenizer_version(path: str) -> str:
    """Digest of the library's name and the file's bytes."""
    kind = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as f:
        return hashlib.sha256(kind.encode() + b"\0" + f.read()).hexdigest()


#: Pre-tokenizers whose pieces hold no white space, with no look beyond a piece.
_SPACELESS = {r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
#: Normalizers that change a character by itself; NFC composes nothing with a space.
_BY_CHARACTER = ({"type": "NFC"}, {"type": "Lowercase"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "})


def ends_at_spaces(spec: dict) -> bool:
    """Whether a tokenizer (its file's JSON) is known to encode what lies between spaces apart from all else."""
    parts = lambda x, inside: x[inside] if x and x["type"] == "Sequence" else [x] if x else []
    first, *rest = parts(spec["pre_tokenizer"], "pretokenizers") or [{}]
    return (
        all(x in _BY_CHARACTER for x in parts(spec["normalizer"], "normalizers"))
        and first.get("type") == "Split"
        and first["behavior"] == "Removed"
        and first["invert"] is True
        and first["pattern"].get("Regex") in _SPACELESS
        and all(x["type"] == "ByteLevel" and not x["add_prefix_space"] and not x["use_regex"] for x in rest)
        and all(not x["lstrip"] and not x["rstrip"] and not x["single_word"] and not x["normalized"] and " " not in x["content"] for x in spec["added_tokens"])
        and not spec["model"].get("dropout")
    )


def by_stretches(count: Callable[[list[str]], list[int]], most: int = 1 << 18, longest: int = 64) -> Callable[[list[str]], list[int]]:
    """The same counts, as sums over the stretches between spaces.

    What is met for the first time is counted with the rest of its text; what is met again, up to ``longest``
    characters, is counted by itself and remembered. With more than ``most`` of either, they are forgotten.
    """
    once: set[str] = set()
    known: dict[str, int] = {}

    def run(texts: list[str]) -> list[int]:
        split = [t.split(" ") for t in texts]
        fresh = set(itertools.chain.from_iterable(split)).difference(known)
        again = list(fresh & once)
        known.update(zip(again, count(again), strict=True))
        fresh.difference_update(again)
        rest = count([" ".join([x for x in s if x in fresh]) for s in split])
        out = [r + sum(map(known.get, s, itertools.repeat(0))) for r, s in zip(rest, split, strict=True)]
        once.difference_update(again)
        once.update(x for x in fresh if len(x) <= longest)
        for held in (once, known):
            if len(held) > most:
                held.clear()
        return out

    return run


@functools.cache
def _encoder(path: str):
    """texts -> counts, by the library that the file belongs to."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    whole = lambda texts: [len(x.ids) for x in tok.encode_batch_fast(texts, add_special_tokens=False)]
    with open(path, encoding="utf-8") as f:
        return by_stretches(whole) if ends_at_spaces(json.load(f)) else whole


def _count_batches(path: str, version: str, chars: int = 1 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _encoder(path)
        for batch in batches:
            texts, counts, lo = batch.column("text").to_pylist(), [], 0
            while lo < len(texts):  # a bounded number of characters at a time
                hi, seen = lo, 0
                while hi < len(texts) and (hi == lo or seen + len(texts[hi]) <= chars):
                    seen += len(texts[hi])
                    hi += 1
                counts += count(texts[lo:hi])
                lo = hi
            yield pa.RecordBatch.from_arrays(
                [batch.column("content"), pa.array([version] * len(texts), pa.string()), pa.array(counts, pa.int64())], ["content", "tokenizer", "n_tokens"]
            )

    return run


def _stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """content, n_tokens of this tokenizer; nothing if no cache was written yet. Appends of rival runs agree."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache) if there else spark.createDataFrame([], CACHE_SCHEMA)
    return rows.where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(documents: DataFrame, tokenizer_path: str, cache: str, limit: int = 2048) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit.

    ``documents`` has doc_id and text; other columns are ignored. Null texts count as empty (0 bytes, 0 tokens);
    null and repeated doc_ids and repeated texts keep a row each; an empty table gives no rows. ``cache`` is a
    folder that all executors share; it grows by the new distinct contents. Texts are encoded whole. Copies meet
    before the shuffle (partial aggregation), so a hot text is sent once per task; its documents are dealt to many
    parts when they take their count.
    """
    spark, version = documents.sparkSession, tokenizer_version(tokenizer_path)
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.unhex(F.md5(normalised(text).cast("binary")))
    rows = materialize(documents.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), digest.alias("content")), "token-digests")
    distinct = documents.select(digest.alias("content"), normalised(text).alias("text")).groupBy("content").agg(F.first("text").alias("text"))
    misses = distinct.join(_stored(spark, cache, version), "content", "left_anti")
    misses.select("content", "text").mapInArrow(_count_batches(tokenizer_path, version), CACHE_SCHEMA).write.mode("append").parquet(cache)
    return join_spread(rows, _stored(spark, cache, version), "content", ["doc_id", "n_bytes"], "left").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


@settled
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), shared_dir(spark, "token-cache"))
