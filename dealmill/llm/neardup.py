"""MinHash near-duplicate detection with tensored banding, candidates verified on full sets.

A text is its set of distinct five-word shingles (64-bit digests). Two small collections of ``m`` half keys, of
four minhashes each, are computed; a table key is a pair (A_i, B_j), so 8m minhashes serve m * m tables of eight
concatenated minhashes. Two texts share a table exactly if they share some A_i and some B_j; the B_j are therefore
looked at only for texts that share some A_i, half keys that nobody shares are dropped before pairs are formed, and
keys that the same texts have count as one, none of which loses a pair. At similarity s a pair shares a
table with probability (1 - (1 - s^4)^m)^2: for m = 24 it is missed at 0.75 with probability 0.0002, and met at
0.3 with probability 0.03.

Exact copies (equal word sequences) are represented by their smallest doc_id. Texts that share tables fall into
coarse groups. Members of a group are compared first by all minhashes, where only pairs that may reach the
threshold join the texts into finer groups, then on the full shingle sets. A group of more than one block is
first held against a few heads of its own; those linked with the most popular head are one bulk already, and only
the rest is compared, with itself and with the bulk, two blocks in a task. Each comparison gives out a spanning
forest of the links it found, never all pairs, so a group of any size has output in proportion to its members.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dealmill.llm.common import drop_written, in_slices, join_spread, materialize, scratch, settled
from dealmill.llm.components import connected_components

SHINGLE = 5
#: Minhashes of a half key.
ROWS = 4
_ODD = np.uint64(0x9E3779B97F4A7C15)  # fixed value: 2^64 over the golden ratio


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """A random number for each byte, and an odd one for each of the first places in a word."""
    rng = np.random.default_rng(17)
    return rng.integers(0, 2**64, 256, dtype=np.uint64), rng.integers(0, 2**64, 4096, dtype=np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD
    return x ^ (x >> np.uint64(29))


def word_digests(raw: bytes) -> np.ndarray:
    """Digests of the words of lower-cased bytes, in their order: sums over a word's bytes, each by its place."""
    by_byte, by_place = _tables()
    b = np.frombuffer(raw, np.uint8)
    gap = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
    size = edge[1::2] - edge[0::2]
    if not len(size):
        return np.empty(0, np.uint64)
    first = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(first, size)
    factor = by_place[place & 4095] if size.max() <= 4096 else by_place[place & 4095] * (_mixed((place >> 12).astype(np.uint64)) | np.uint64(1))
    return _mixed(np.add.reduceat(by_byte[b[~gap]] * factor, first) + size.astype(np.uint64))


def text_digests(text: str | None, piece: int = 1 << 20) -> np.ndarray:
    """Digests of a text's words; a long text is cut at white space and gone through in pieces.

    bytes.lower() works on ASCII alone, as the definition of words asks.
    """
    raw, out, lo = (text or "").encode().lower(), [], 0
    while lo < len(raw):
        hi = lo + piece
        while hi < len(raw) and raw[hi] not in b" \t\n\x0b\x0c\r":
            hi += 1
        out.append(word_digests(raw[lo:hi]))
        lo = hi
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingle_hashes(ids: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct digests of the k-word shingles; of the whole sequence if it has fewer words; else empty."""
    if not len(ids):
        return np.empty(0, np.uint64)
    size = min(k, len(ids))
    h = np.full(len(ids) - size + 1, size, np.uint64)
    for i in range(size):
        h = (h ^ ids[i : len(ids) - size + 1 + i]) * _ODD
        h ^= h >> np.uint64(29)
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


@functools.cache
def _permutations(n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None], rng.integers(0, 2**32, n, dtype=np.uint32)[:, None]


def minhashes(shingles: np.ndarray, n: int) -> np.ndarray:
    """n minhashes of 32 bits; a long set is gone through in pieces."""
    factor, shift = _permutations(n)
    x, best = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32), np.full(n, np.iinfo(np.uint32).max, np.uint32)
    for lo in range(0, len(x), 2048):
        best = np.minimum(best, (x[None, lo : lo + 2048] * factor + shift).min(1))
    return best


SIGNED = "doc_id long, words binary, n_shingles long, sig binary"


def _sign(n_hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            words, sizes, sigs = [], [], []
            for text in batch.column("text").to_pylist():
                ids = text_digests(text)
                shingles = shingle_hashes(ids)
                words.append(xxhash.xxh3_128_digest(ids.tobytes()))
                sizes.append(len(shingles))
                sigs.append(minhashes(shingles, n_hashes).tobytes() if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(words, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())], ["doc_id", "words", "n_shingles", "sig"]
            )

    return run


def _half_keys(m: int, side: int):
    """doc_id to its m half keys of a collection (0: A, 1: B), each of ROWS minhashes and its own place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 4096):
            n = batch.num_rows
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(n, 2, m, ROWS)[:, side].astype(np.uint64)
            keys = np.broadcast_to(np.arange(side * m, (side + 1) * m, dtype=np.uint64), (n, m))
            for i in range(ROWS):
                keys = _mixed(keys ^ (sig[:, :, i] << np.uint64(16)))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column("doc_id")), m)), pa.array(keys.reshape(-1).view(np.int64))], ["doc_id", "key"])

    return run


def _shared(rows: DataFrame, name: str) -> DataFrame:
    """doc_id, key: the keys that more than one row has; keys that the same documents have become one.

    ``rows`` has each doc_id and key once. The keys are written, so that the rows of a hot key can be split.
    """
    held = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("by"))
    often = materialize(held.where(F.col("n") > 1).select("key", F.xxhash64("n", "by").alias("named")), name)
    return rows.join(often, "key").select("doc_id", F.col("named").alias("key")).distinct()


def shared_halves(signed: DataFrame, m: int, side: int) -> DataFrame:
    """doc_id, key: the shared half keys of a collection. All half keys are removed once these are written."""
    with scratch(signed.sparkSession):
        halves = materialize(signed.select("doc_id", "sig").mapInArrow(_half_keys(m, side), "doc_id long, key long"), "halves")
        return materialize(_shared(halves, "often"), "shared-halves", outer=True)


def table_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    """doc_id, key: the shared keys of the tables, from the shared half keys of both collections."""
    with scratch(a.sparkSession):
        pairs = a.join(b.withColumnRenamed("key", "other"), "doc_id").select("doc_id", F.xxhash64("key", "other").alias("key"))
        return materialize(_shared(materialize(pairs, "tables"), "often"), "shared-tables", outer=True)


def _stars(keyed: DataFrame) -> DataFrame:
    """Edges a, b that connect all documents with a common key, about one for each document.

    A document is tied to the smallest head (smallest id of a key) among its keys; then, for each key, the heads
    that its members are tied to are tied to the smallest of them. Members of a large group mostly have one head
    in common, so a group of any size adds few edges beyond one for each member. Heads are written before they are
    joined, so that the rows of a hot key can be split.
    """
    heads = materialize(keyed.groupBy("key").agg(F.min("doc_id").alias("head")), "heads")
    tied = materialize(keyed.join(heads, "key").groupBy("doc_id").agg(F.min("head").alias("head")), "tied")
    by_key = materialize(keyed.join(tied, "doc_id").select("key", "head").distinct(), "heads-by-key")
    tops = by_key.groupBy("key").agg(F.min("head").alias("top"))
    between = by_key.join(tops, "key").where(F.col("head") != F.col("top")).select(F.col("top").alias("a"), F.col("head").alias("b")).distinct()
    return tied.select(F.col("head").alias("a"), F.col("doc_id").alias("b")).unionByName(between)


def _forest(n: int, pairs: Iterator[tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
    """Spanning forest of the links (i, each of js) between n things."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, js in pairs:
        for j in map(int, js):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((i, j))
    return out


class Signatures:
    """Compares packed minhashes: a pair is linked if at least ``least`` of them agree."""

    def __init__(self, n_hashes: int, least: int):
        self.n_hashes, self.least = n_hashes, least

    def __call__(self, data: list[bytes], right: np.ndarray):
        """links(i, from): which of right[from:] are linked with i; numbers are places in ``data``."""
        sigs = np.frombuffer(b"".join(data), np.uint32).reshape(len(data), self.n_hashes)
        other = sigs[right]
        return lambda i, at: (other[at:] == sigs[i]).sum(1) >= self.least


class Sets:
    """Compares packed shingle sets: linked if 100 * intersection >= percent * union."""

    def __init__(self, percent: int):
        self.percent = percent

    def __call__(self, data: list[bytes], right: np.ndarray):
        sets = [np.frombuffer(x, np.uint64) for x in data]
        sizes = np.array([len(x) for x in sets], int)
        # intersection sizes of one set with all others at once, by the members that hold each shingle
        members = np.repeat(np.arange(len(right)), sizes[right]) if len(right) else np.empty(0, int)
        held = np.concatenate([sets[k] for k in right]) if len(right) else np.empty(0, np.uint64)
        order = np.argsort(held, kind="stable")
        held, members = held[order], members[order]

        def linked(i: int, at: int) -> np.ndarray:
            a, b = np.searchsorted(held, sets[i], "left"), np.searchsorted(held, sets[i], "right")
            n = b - a
            where = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            common = np.bincount(members[where], minlength=len(right))[at:]
            return 100 * common >= self.percent * (sizes[i] + sizes[right[at:]] - common)

        return linked


def _comparisons(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Table]]:
    """lo, hi and the rows of each comparison (grp, lo, hi), whose rows lie next to one another, one at a time."""
    rows, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("grp", "lo", "hi")], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), batch.num_rows]
        for at, end in zip(cuts, cuts[1:]):  # noqa: B905
            key = tuple(keys[at].tolist())
            if rows and key != last:
                yield last[1], last[2], pa.Table.from_batches(rows)
                rows = []
            rows.append(batch.slice(at, end - at))
            last = key
    if rows:
        yield last[1], last[2], pa.Table.from_batches(rows)


def _between(measure):
    """Rows of comparisons of one or two blocks, in order: edges a, b of a spanning forest of each one's links."""

    def forest(lo: int, hi: int, rows: pa.Table) -> tuple[np.ndarray, list[tuple[int, int]]]:
        ids, blocks = rows.column("doc_id").to_numpy(), rows.column("block").to_numpy()
        fresh = np.concatenate(([True], ids[1:] != ids[:-1]))
        data = [x for x, new in zip(rows.column("data").to_pylist(), fresh, strict=True) if new]
        ids, blocks = ids[fresh], blocks[fresh]
        left = np.flatnonzero(blocks == lo)
        right = left if lo == hi else np.flatnonzero(blocks == hi)
        links = measure(data, right)

        def pairs():
            for k, i in enumerate(left):
                at = k + 1 if lo == hi else 0
                if at < len(right):
                    yield i, right[at:][links(i, at)]

        return ids, _forest(len(ids), pairs())

    def edges(a: list[int], b: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for lo, hi, rows in _comparisons(batches):
            ids, found = forest(lo, hi, rows)
            a += [int(ids[i]) for i, _ in found]
            b += [int(ids[j]) for _, j in found]
            if len(a) >= 4096:
                yield edges(a, b)
                a, b = [], []
        yield edges(a, b)

    return run


def _compared(rows: DataFrame, measure) -> DataFrame:
    """Edges a, b of the comparisons (grp, lo, hi) of rows (doc_id, block, data).

    Each comparison's rows are brought together and in order by Spark and go through Arrow as a stream: most
    comparisons are of a few rows, and a call of its own for each would cost more than the comparison.
    """
    ordered = rows.repartition("grp", "lo", "hi").sortWithinPartitions("grp", "lo", "hi", "block", "doc_id")
    return ordered.mapInArrow(_between(measure), "a long, b long")


def _to_heads(measure):
    """A block of members and the group's heads: doc_id with its first head that it is linked with, or null."""

    def run(key, members: pd.DataFrame, heads: pd.DataFrame) -> pd.DataFrame:
        members, heads = members.drop_duplicates(["doc_id"]), heads.sort_values("doc_id")
        ids, first = members["doc_id"].to_numpy(), np.full(len(members), -1)
        links = measure([*members["data"], *heads["data"]], np.arange(len(members)))
        for k in range(len(heads)):
            hit = links(len(members) + k, 0)
            first[hit & (first < 0)] = k
        names = heads["doc_id"].to_numpy()
        return pd.DataFrame({"grp": int(key[0]), "doc_id": ids, "head": pd.array([int(names[k]) if k >= 0 else None for k in first], dtype="Int64")})

    return run


def _group_sizes(rows: DataFrame) -> DataFrame:
    """The rows with ``n``, their group's size. A hot group's rows meet nowhere: they are counted part by part."""
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(512)))
    counts = dealt.groupBy("grp", "_part").agg(F.count(F.lit(1)).alias("c"))
    counts = counts.select("grp", "_part", F.sum("c").over(W.partitionBy("grp")).alias("n"))
    return dealt.join(counts, ["grp", "_part"]).drop("_part")


def links_in_groups(rows: DataFrame, measure, block: int, n_heads: int = 8) -> DataFrame:
    """Edges a, b that connect what ``measure`` links among rows (grp, doc_id, data), inside groups.

    Groups of one block are compared in a task. In a larger one, blocks of members are held against ``n_heads``
    members drawn by a digest; all linked with the head that has most of them are the bulk. What is left (the rest)
    is compared with itself and with the bulk, pair of blocks by pair of blocks, so no link between two texts that
    are not yet connected is lost. The work on a group is its size times its rest; only a group most of whose
    members are linked with no head costs the square of its size.
    """
    sized = materialize(_group_sizes(rows), "grouped")
    whole = sized.where(F.col("n") <= block).select("grp", F.lit(0).alias("lo"), F.lit(0).alias("hi"), "doc_id", F.lit(0).alias("block"), "data")
    small = _compared(whole, measure)
    large = sized.where(F.col("n") > block).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    if not large.limit(1).count():
        return small
    drawn = W.partitionBy("grp").orderBy(F.xxhash64("doc_id"), "doc_id")
    heads = large.select("grp", "doc_id", "blocks", F.row_number().over(drawn).alias("k")).where(F.col("k") <= n_heads).drop("k")
    heads = materialize(heads.join(large.select("doc_id", "data"), "doc_id"), "group-heads")
    every = heads.select("grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "doc_id", "data")
    dealt = large.select("grp", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("block"), "doc_id", "data")
    tied = dealt.groupBy("grp", "block").cogroup(every.groupBy("grp", "block")).applyInPandas(_to_heads(measure), "grp long, doc_id long, head long")
    tied = materialize(tied, "tied-to-heads")
    by_head = tied.groupBy("grp", "head").agg(F.count(F.lit(1)).alias("c"))
    top = F.max_by("head", F.when(F.col("head").isNotNull(), F.struct("c", -F.col("head"))))
    bulks = by_head.groupBy("grp").agg(top.alias("bulk"), F.sum("c").alias("n"), F.max(F.when(F.col("head").isNotNull(), F.col("c"))).alias("in_bulk"))
    bulks = bulks.select(
        "grp", "bulk", F.ceil((F.col("n") - F.coalesce("in_bulk", F.lit(0))) / block).cast("int").alias("rest_blocks"), F.ceil(F.coalesce("in_bulk", F.lit(0)) / block).cast("int").alias("bulk_blocks")
    )
    bulks = materialize(bulks.where(F.col("rest_blocks") > 0), "bulks")
    open_rows = join_spread(tied, bulks, "grp", ["doc_id"]).join(large.select("doc_id", "data"), "doc_id")
    in_bulk = F.col("head").eqNullSafe(F.col("bulk")) & F.col("bulk").isNotNull()
    # blocks of the rest come first, those of the bulk behind them; a pair has one block of the rest at least
    place = F.when(in_bulk, F.col("rest_blocks") + F.pmod(F.xxhash64("doc_id"), F.col("bulk_blocks"))).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("rest_blocks"))).cast("int")
    last = F.when(in_bulk, F.col("rest_blocks")).otherwise(F.col("rest_blocks") + F.col("bulk_blocks")) - 1
    pairs = open_rows.withColumn("block", place).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    pairs = pairs.select("grp", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "doc_id", "block", "data")
    rest = _compared(pairs, measure)
    stars = tied.where(F.col("head").isNotNull()).select(F.col("head").alias("a"), F.col("doc_id").alias("b"))
    return small.unionByName(stars).unionByName(rest)


def near_duplicates(documents: DataFrame, percent: int = 75, m: int = 24, block: int = 512) -> DataFrame:
    """Per document: doc_id, n_shingles, class_id, component_id, kept.

    ``documents`` has doc_id (unique, not null: an input without such ids has to be numbered first; of
    the different texts that have one id for their smallest, that with the smallest digest of its words stands for it;
    each row gets a row)
    and text; other columns are ignored. Null and wordless texts have empty sets and link with nothing, not even
    with one another. ``class_id`` is the smallest id with the same words, ``component_id`` the smallest id
    reachable over links. An empty table gives no rows. Long texts are read whole, in pieces.
    """
    n_hashes = 2 * m * ROWS
    signed = materialize(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sign(n_hashes), SIGNED), "signed")
    ids = materialize(signed.drop("sig"), "ids")
    worded = ids.where(F.col("n_shingles") > 0)
    # the same words have the same minhashes: those go through one shuffle, and copies meet before it
    signs = signed.where(F.col("n_shingles") > 0).groupBy("words").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"))
    signs = materialize(signs, "signs")
    drop_written(signed)
    classes = materialize(signs.select("words", F.col("doc_id").alias("class_id")), "classes")
    repeated = classes.groupBy("class_id").agg(F.min("words").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    others = materialize(classes.join(materialize(repeated.drop("n"), "repeated"), "class_id").where(F.col("words") != F.col("least")).select("words"), "others")
    first = signs.where(F.col("doc_id").isNotNull()).join(others, "words", "left_anti")

    a = shared_halves(first, m, 0)
    near = materialize(first.join(a.select("doc_id").distinct(), "doc_id", "left_semi"), "near")
    drop_written(signs)
    keyed = table_keys(a, shared_halves(near, m, 1))
    coarse = connected_components(_stars(keyed))
    rows = coarse.join(near, coarse["id"] == near["doc_id"]).select(F.col("component").alias("grp"), "doc_id", F.col("sig").alias("data"))
    # 4.2 standard deviations below the expected agreement of a pair at the threshold
    p = percent / 100
    least = int(n_hashes * p - 4.2 * (n_hashes * p * (1 - p)) ** 0.5)
    fine = connected_components(links_in_groups(rows, Signatures(n_hashes, least), 4 * block))

    # a shuffle at any size: the ids grow with the corpus, so a broadcast would only hold for small inputs
    chosen = fine.join(near.select(F.col("doc_id").alias("id"), "words"), "id")
    texts = documents.select(F.col("doc_id").cast("long").alias("id"), "text").join(chosen.hint("merge"), "id").select("component", "id", "words", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            ids = [text_digests(t) for t in batch.column("text").to_pylist()]
            same = pa.array([xxhash.xxh3_128_digest(x.tobytes()) == w for x, w in zip(ids, batch.column("words").to_pylist(), strict=True)], pa.bool_())
            data = pa.array([shingle_hashes(x).tobytes() for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("component"), batch.column("id"), data], ["grp", "doc_id", "data"]).filter(same)

    full = materialize(texts.mapInArrow(sets, "grp long, doc_id long, data binary"), "sets")
    linked = connected_components(links_in_groups(full, Sets(percent), block)).withColumnRenamed("id", "class_id")
    named = classes.join(linked, "class_id", "left").select("words", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    judged = join_spread(worded.select("doc_id", "n_shingles", "words"), named, "words", ["doc_id"]).drop("words")
    bare = ids.where(F.col("n_shingles") == 0).select("doc_id", "n_shingles", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    return judged.select(*bare.columns).unionByName(bare).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


@settled
def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(words) - 4, 1) + 1), lambda i: hash(array_to_string(words[i:i + 4], ' ')))) AS grams
  FROM w WHERE len(words) > 0
), n AS (SELECT doc_id, len(grams) AS size FROM s
), g AS (SELECT doc_id, unnest(grams) AS gram FROM s
), often AS (SELECT gram FROM g GROUP BY gram HAVING count(*) > 1
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM (g SEMI JOIN often USING (gram)) a JOIN (g SEMI JOIN often USING (gram)) b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.size + y.size - shared)
), edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
  SELECT a AS id, a AS node FROM edge
  UNION SELECT r.id, e.b FROM reach r JOIN edge e ON e.a = r.node
), comp AS (SELECT id, min(node) AS component_id FROM reach GROUP BY id)
SELECT w.doc_id, coalesce(n.size, 0)::BIGINT AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id,
       coalesce(c.component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN comp c ON c.id = w.doc_id
"""
