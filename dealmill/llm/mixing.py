r"""Mixing sources to target weights by Sainte-Laguë apportionment, with DataFrame expressions only.

Sources get target shares of all tokens; a target above ``max_repeats`` times its source's size stops there and
the excess is shared out again by weight until no target is above. Blocks of ``block`` tokens (one, unless asked
otherwise) are then given to sources by the highest quotients target / (2k + 1). A source is cut into shards of
about ``shard_docs`` documents by a seeded digest; its quota is given by the same rule to groups of shards, about
as many as a group has shards, and a group's quota to its shards. Inside a shard the documents form one stream in
seeded order. A quota of q blocks of a stream with n blocks takes every block q // n times and q % n more, spread
evenly over the stream from a seeded start.

The highest quotients are found without listing all blocks: for S parties and N blocks the divisor
T / (N - S/2) never gives more than N and T / (N + S/2) never fewer. The upper bound is taken wider, at N + 4S,
since parties can also reach their caps, so only about 5S blocks between the two are ranked by quotient. Ties go
to the party that comes first. No window holds all sources, and none more than a group of shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dealmill.llm.common import count_spaced_words, join_spread, materialize, settled

WEIGHTS = (5, 2, 1)
_BIG = "decimal(19,0)"


def _placed(by_source: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Adds position (from 1, by code point, null last) and weight; sources are numbered range by range."""
    ranged = materialize(by_source.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_range", F.spark_partition_id()), "mix-ranges")
    counts, before = sorted((r["_range"], r["count"]) for r in ranged.groupBy("_range").count().collect()), {}  # a row for each partition
    for k, (at, _) in enumerate(counts):
        before[at] = sum(n for _, n in counts[:k])
    offset = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("_range")) if before else F.lit(0)
    placed = ranged.withColumn("position", F.row_number().over(W.partitionBy("_range").orderBy(F.col("source").asc_nulls_last())).cast("long") + offset)
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((F.col("position") - 1) % len(weights) + 1).cast("int"))
    return placed.drop("_range").withColumn("weight", weight)


def target_shares(sizes: DataFrame, max_repeats: int = 3) -> DataFrame:
    """Adds ``target`` to one row for each source with source_size and weight.

    Round by round, sources whose share of what is left is over their cap are capped, and what they leave is shared
    again, until none is over. A round is one sum over the sources. Sums are of whole numbers, so that reruns agree
    to the last bit.
    """
    cap = F.lit(max_repeats).cast("long") * F.col("source_size")
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    rest, free, capped = total, None, F.lit(False)
    while True:
        left = sizes.agg(F.sum(F.when(capped, cap)).alias("cap"), F.sum(F.when(~capped, F.col("weight"))).alias("weight"), F.count(F.when(~capped, 1)).alias("n")).first()
        rest, free, before = total - (left["cap"] or 0), left["weight"] or 0, free
        if free in (before, 0):  # sources are only ever added to the capped ones
            break
        capped = capped | (F.col("weight").cast(_BIG) * F.lit(rest).cast(_BIG) > cap.cast(_BIG) * F.lit(free).cast(_BIG))
    share = (F.col("weight") * F.lit(rest).cast("long")).cast("double") / F.lit(float(free or 1))
    return sizes.withColumn("target", F.when(capped, cap.cast("double")).otherwise(share))


def sainte_lague(parties: DataFrame, within: list[str], claim: str, seats: str, cap: str, order: list[str]) -> DataFrame:
    """Adds ``quota``: ``seats`` (equal in each group of ``within``) given by highest quotients of ``claim``.

    No party gets more than ``cap``; caps are far above what their claims earn except for rounding. Groups of
    ``within`` have to be of bounded size; without it, all parties are one group, which is summed and not gathered.
    """

    def at(seats_then: Column) -> Column:
        earned = F.floor(F.col(claim) * seats_then / F.col("_t") + F.lit(0.5))
        return F.when((F.col("_t") > 0) & (seats_then > 0), F.least(earned.cast("long"), F.col(cap))).otherwise(F.lit(0)).cast("long")

    def bounded(base: DataFrame) -> DataFrame:
        low = base.withColumn("_low", at(F.col(seats) - F.col("_s") / 2 - 1))
        return low.withColumn("_high", F.least(F.greatest(at(F.col(seats) + 4 * F.col("_s") + 4), F.col("_low")), F.col(cap)))

    keys = [*within, *order]
    quotient = [F.desc(F.col(claim) / (2 * F.col("_k") + 1)), *order, "_k"]
    candidates = lambda b, *more: b.where(F.col("_high") > F.col("_low")).select(*keys, claim, "_low", *more, F.explode(F.sequence(F.col("_low"), F.col("_high") - 1)).alias("_k"))
    if within:
        group = W.partitionBy(*within)
        bounds = bounded(parties.withColumn("_t", F.sum(claim).over(group)).withColumn("_s", F.count(F.lit(1)).over(group)))
        bounds = bounds.withColumn("_open", F.col(seats) - F.sum("_low").over(group))
        ranked = candidates(bounds, "_open").withColumn("_rank", F.row_number().over(group.orderBy(*quotient))).where(F.col("_rank") <= F.col("_open"))
    else:
        all_claims, n, given = parties.agg(F.sum(claim), F.count(F.lit(1)), F.max(seats)).first()
        bounds = bounded(parties.withColumn("_t", F.lit(all_claims)).withColumn("_s", F.lit(n)))
        low = bounds.agg(F.sum("_low")).first()[0] or 0
        ranked = candidates(bounds).orderBy(*quotient).limit(max(0, int(given or 0) - low))
    more = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_more"))
    return bounds.join(more, keys, "left").withColumn("quota", F.col("_low") + F.coalesce("_more", F.lit(0))).drop("_t", "_s", "_low", "_high", "_open", "_more")


def _source_key() -> Column:
    """The source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))


def mix_sources(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = 3, block: int = 1, shard_docs: int = 512, seed: int = 7) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken.

    ``documents`` has doc_id, text, source; other columns are ignored. Size is the number of words of the whole
    text, however long; null and empty texts have size 0 and nothing is taken of them. Sources go by code point,
    null last, and a null source is a source. Repeated rows are rows of their own; rows with equal doc_id meet in
    one shard, and those of equal size are interchangeable. Without rows, or without words, nothing is taken
    (targets 0). ``taken`` counts repeats and is at most ``max_repeats`` * size. A hot source has as many shards as
    its rows ask for, so no task holds a source.
    """
    hexed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    sized = materialize(documents.select("doc_id", "source", count_spaced_words(F.col("text")).alias("size"), hexed.alias("draw")), "mix-sizes")
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    placed = materialize(_placed(by_source, weights), "mix-sources")
    targets = target_shares(placed, max_repeats)
    all_words = placed.agg(F.sum("source_size")).first()[0] or 0
    n_blocks = lambda size: F.ceil(size / block).cast("long")
    quotas = sainte_lague(
        targets.withColumn("seats", F.lit(round(all_words / block)).cast("long")).withColumn("cap", max_repeats * n_blocks(F.col("source_size"))), [], "target", "seats", "cap", ["position"]
    )
    shards = F.greatest(F.ceil(F.col("n_docs") / shard_docs), F.lit(1)).cast("long")
    quotas = materialize(
        quotas.select(_source_key().alias("key"), "position", "source_size", "target", F.col("quota").alias("source_quota"), shards.alias("shards"), F.ceil(F.sqrt(shards)).cast("long").alias("groups")),
        "mix-quotas",
    )

    head = F.conv(F.substring("draw", 1, 8), 16, 10).cast("long")
    sharded = join_spread(sized.withColumn("key", _source_key()), quotas.select("key", "position", "shards"), "key", ["draw"])
    sharded = sharded.select("doc_id", "source", "position", "size", "draw", F.pmod(head, F.col("shards")).alias("shard"))
    # about docs / shard_docs rows: shards of a source are given their quotas group by group
    by_shard = sharded.groupBy("position", "shard").agg(F.sum("size").alias("shard_size"))
    by_shard = join_spread(by_shard, quotas, "position", ["shard"]).withColumn("part", F.pmod("shard", "groups")).withColumn("cap", max_repeats * n_blocks(F.col("shard_size")))
    by_shard = materialize(by_shard, "mix-shards")
    by_part = by_shard.groupBy("position", "part").agg(F.sum("shard_size").alias("part_size"), F.sum("cap").alias("cap"), F.max("source_quota").alias("seats"))
    part_quotas = sainte_lague(by_part, ["position"], "part_size", "seats", "cap", ["part"]).select("position", "part", F.col("quota").alias("part_quota"))
    shard_quotas = sainte_lague(by_shard.join(part_quotas, ["position", "part"]), ["position", "part"], "shard_size", "part_quota", "cap", ["shard"])
    shard_quotas = shard_quotas.select("position", "shard", "shard_size", "source_size", "target", "quota")

    div = lambda a, b: F.call_function("div", a, b)
    stream = W.partitionBy("position", "shard").orderBy("draw", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    laid = (
        sharded.withColumn("ends", F.sum("size").over(stream))
        .join(shard_quotas, ["position", "shard"])
        .withColumn("starts", F.col("ends") - F.col("size"))
        .withColumn("n_blocks", F.greatest(n_blocks(F.col("shard_size")), F.lit(1)))
        .withColumn("more", F.col("quota") % F.col("n_blocks"))
        .withColumn("turn", F.pmod(F.lit(seed) * 7919 + F.col("position") * 31 + F.col("shard") * 17, F.col("n_blocks")))
    )

    def chosen_before(at: Column) -> Column:
        """Words at stream places below ``at`` that lie in the blocks taken once more."""
        b = div(at, F.lit(block).cast("long"))
        upto = lambda x: div((x + F.col("turn")) * F.col("more"), F.col("n_blocks"))
        return (upto(b) - upto(F.lit(0))) * block + (upto(b + 1) - upto(b)) * (at - b * block)

    once_more = chosen_before(F.col("ends")) - chosen_before(F.col("starts"))
    return laid.select("doc_id", "source", "size", "source_size", "target", (div(F.col("quota"), F.col("n_blocks")) * F.col("size") + once_more).alias("taken"))


@settled
def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def mix_sql(documents: str = "documents", weights: tuple[int, ...] = WEIGHTS, repeats: int = 3, block: int = 1, shard_docs: int = 512, seed: int = 7) -> str:
    """The same mix as DuckDB SQL; here every block is listed and ranked by its quotient."""
    return f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0)::BIGINT AS size,
         md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null')) AS draw
  FROM {documents}
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs,
         row_number() OVER (ORDER BY source ASC NULLS LAST) AS position
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, ([{', '.join(map(str, weights))}])[((position - 1) % {len(weights)} + 1)::INT]::BIGINT AS weight, (SELECT sum(source_size)::BIGINT FROM src) AS total FROM src
), filled AS (
  SELECT 0 AS round, [0]::BIGINT[] AS capped
  UNION ALL
  SELECT round + 1, found FROM (
    SELECT f.round, f.capped, (
      SELECT list_sort(list(w.position::BIGINT) || [0]::BIGINT[]) FROM weighed w,
        (SELECT coalesce(sum(x.total) FILTER (WHERE x.position = 1), 0) - coalesce(sum({repeats} * x.source_size) FILTER (WHERE list_contains(f.capped, x.position)), 0) AS rest,
                coalesce(sum(x.weight) FILTER (WHERE NOT list_contains(f.capped, x.position)), 0) AS free FROM weighed x) g
      WHERE list_contains(f.capped, w.position) OR w.weight * g.rest > {repeats} * w.source_size * g.free) AS found
    FROM filled f) WHERE len(found) > len(capped)
), last AS (SELECT capped FROM filled ORDER BY round DESC LIMIT 1
), rest AS (
  SELECT (coalesce(max(total), 0) - coalesce(sum({repeats} * source_size) FILTER (WHERE list_contains(capped, position)), 0))::BIGINT AS free_left,
         coalesce(sum(weight) FILTER (WHERE NOT list_contains(capped, position)), 0)::BIGINT AS free_weight
  FROM weighed, last
), targets AS (
  SELECT w.*, CASE WHEN list_contains(capped, position) THEN ({repeats} * source_size)::DOUBLE
              ELSE (weight * free_left)::DOUBLE / free_weight::DOUBLE END AS target,
         {repeats} * ceil(source_size / {block})::BIGINT AS cap
  FROM weighed w, last, rest
), source_quota AS (
  SELECT position, count(*) AS quota FROM (
    SELECT position, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, position, k) AS place
    FROM (SELECT position, target, cap, unnest(range(cap)) AS k FROM targets))
  WHERE place <= (SELECT round(sum(source_size) / {block})::BIGINT FROM src) GROUP BY position
), sharded AS (
  SELECT s.*, t.position, t.source_size, t.target, coalesce(q.quota, 0) AS source_quota,
         greatest(ceil(t.n_docs / {shard_docs}), 1)::BIGINT AS shards, ('0x' || substr(draw, 1, 8))::BIGINT % greatest(ceil(t.n_docs / {shard_docs}), 1)::BIGINT AS shard
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN source_quota q ON q.position = t.position
), shards AS (
  SELECT position, shard, shard % ceil(sqrt(max(shards)))::BIGINT AS part, sum(size)::BIGINT AS shard_size, {repeats} * ceil(sum(size) / {block})::BIGINT AS cap,
         max(source_quota) AS source_quota FROM sharded GROUP BY position, shard
), parts AS (SELECT position, part, sum(shard_size)::BIGINT AS part_size, sum(cap)::BIGINT AS cap, max(source_quota) AS source_quota FROM shards GROUP BY position, part
), part_quota AS (
  SELECT position, part, count(*) AS quota FROM (
    SELECT position, part, source_quota, row_number() OVER (PARTITION BY position ORDER BY part_size / (2 * k + 1) DESC, part, k) AS place
    FROM (SELECT *, unnest(range(cap)) AS k FROM parts))
  WHERE place <= source_quota GROUP BY ALL
), shard_quota AS (
  SELECT position, shard, count(*) AS quota FROM (
    SELECT position, shard, part_quota, row_number() OVER (PARTITION BY position, part ORDER BY shard_size / (2 * k + 1) DESC, shard, k) AS place
    FROM (SELECT s.*, coalesce(q.quota, 0) AS part_quota, unnest(range(s.cap)) AS k FROM shards s LEFT JOIN part_quota q ON q.position = s.position AND q.part = s.part))
  WHERE place <= part_quota GROUP BY ALL
), laid AS (
  SELECT d.*, (sum(d.size) OVER (PARTITION BY d.position, d.shard ORDER BY draw, doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING))::BIGINT AS ends,
         coalesce(q.quota, 0) AS quota, greatest(ceil(h.shard_size / {block}), 1)::BIGINT AS n_blocks
  FROM sharded d JOIN shards h ON h.position = d.position AND h.shard = d.shard
  LEFT JOIN shard_quota q ON q.position = d.position AND q.shard = d.shard
), marks AS (
  SELECT *, ends - size AS starts, quota % n_blocks AS more, ({seed} * 7919 + position * 31 + shard * 17) % n_blocks AS turn FROM laid
), cut AS (
  SELECT *, ends // {block} AS b1, starts // {block} AS b0, turn * more // n_blocks AS u FROM marks
)
SELECT doc_id, size, source_size, target,
       ((quota // n_blocks) * size
        + (((b1 + turn) * more // n_blocks - u) * {block} + ((b1 + 1 + turn) * more // n_blocks - (b1 + turn) * more // n_blocks) * (ends - b1 * {block}))
        - (((b0 + turn) * more // n_blocks - u) * {block} + ((b0 + 1 + turn) * more // n_blocks - (b0 + turn) * more // n_blocks) * (starts - b0 * {block})))::BIGINT AS taken
FROM cut
"""
