"""URL filtering: host and path rules, and trust propagated over the host graph, with DataFrame expressions only.

Pages that a rule allows give trust to their host, pages that a rule blocks give distrust, each as a share of
all pages. Trust flows along links (a trusted host vouches for what it links to), distrust against them (who
links to a blocked host is suspect), as personalised PageRank: a host keeps 1 - damping of its seed and receives
damping times what its neighbours pass on; a host that passes nothing on keeps its mass. A host is blocked if
its distrust less its trust is over ``threshold`` of its own share of the pages. A page takes the verdict of the
longest rule that fits, else that of its host.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealmill.llm.common import drop_written, join_spread, lower_ascii, materialize, settled

#: (verdict, host and path)
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Links count in anchors outside comments and scripts, by the attribute href itself.
_LINK = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""
_NO_LINKS = r"(?is)<!--.*?-->|<script\b.*?</script\s*>"
#: Parts that the links of a hub are dealt to.
PARTS = 256


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct<rule, verdict> of the longest rule that fits, else null; of equally long ones the last by text."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at, _, rest = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: links from pages of one host to another host, repeated links of a page counted once."""
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.regexp_replace(F.coalesce("html", F.lit("")), _NO_LINKS, " "), F.lit(_LINK), 1))).alias("link"))
    ends = links.select("src", host_of(F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), "link")).otherwise(F.col("link"))).alias("dst"))
    return ends.where((F.col("src") != F.col("dst")) & (F.col("src") != "") & (F.col("dst") != "")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int | None = None, tolerance: float = 1e-9, guard: int = 1000) -> DataFrame:
    """host, trust, distrust. ``seeds``: host, trust, distrust; ``edges``: src, dst, n.

    Rounds go on until no host's mass can be off by more than ``tolerance``, and raise after ``guard`` of them; with
    ``rounds``, it is just so many. A round shrinks the sum of all changes by ``damping`` at least, so what all
    further rounds can change is bounded by the sum of the last one's.
    """
    edges = materialize(edges, "host-edges")
    if edges.limit(1).count() == 0:  # without links every host keeps its seeds
        return seeds
    flows = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("from"), F.col("dst").alias("to"), "n").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("from"), F.col("src").alias("to"), "n")
    )
    outs = flows.groupBy("kind", "from").agg(F.sum("n").alias("out"))
    flows = join_spread(flows, outs, ["kind", "from"], ["to"], parts=PARTS)
    flows = materialize(flows.select("kind", "from", "to", F.pmod(F.xxhash64("to"), F.lit(PARTS)).alias("part"), (F.col("n") / F.col("out")).alias("share")), "host-flows")
    seats = materialize(flows.select("kind", "from", "part").distinct(), "host-seats")
    hosts = flows.select("kind", F.col("from").alias("host")).union(flows.select("kind", "to")).union(
        seeds.select(F.explode(F.array(F.lit("trust"), F.lit("distrust"))).alias("kind"), "host")
    ).distinct()
    seed = seeds.select("host", F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.col("trust").alias("seed")), F.struct(F.lit("distrust").alias("kind"), F.col("distrust").alias("seed")))).alias("s"))
    start = hosts.join(seed.select("s.kind", "host", "s.seed"), ["kind", "host"], "left").join(
        flows.select("kind", F.col("from").alias("host"), F.lit(True).alias("passes")).distinct(), ["kind", "host"], "left"
    )
    start = materialize(start.select("kind", "host", F.coalesce("seed", F.lit(0.0)).alias("seed"), F.coalesce("passes", F.lit(False)).alias("passes")), "host-seeds")
    rank = start.withColumn("mass", F.col("seed"))
    for done in range(1, (guard if rounds is None else rounds) + 1):
        told = seats.join(rank.select("kind", F.col("host").alias("from"), "mass"), ["kind", "from"])  # a hub's mass, once for each part of its links
        passed = flows.join(told, ["kind", "from", "part"]).groupBy("kind", F.col("to").alias("host")).agg(F.sum(F.col("mass") * F.col("share")).alias("got"))
        kept = F.when(F.col("passes"), 0.0).otherwise(F.col("mass"))
        mass = (1 - damping) * F.col("seed") + damping * (F.coalesce("got", F.lit(0.0)) + kept)
        after = rank.join(passed, ["kind", "host"], "left").withColumn("change", F.abs(mass - F.col("mass"))).withColumn("mass", mass).drop("got")
        before, written = rank, materialize(after, "host-rank")
        rank = written.drop("change")
        if done > 1:
            drop_written(before)
        if rounds is None:
            left = max(r[1] for r in written.groupBy("kind").agg(F.sum("change")).collect()) * damping / (1 - damping)
            if left <= tolerance:
                break
    else:
        if rounds is None:
            raise RuntimeError(f"trust has not settled after {guard} rounds: hosts may be off by {left}, over {tolerance}")
    mass = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("mass")).otherwise(0.0)).alias(kind)
    return rank.groupBy("host").agg(mass("trust"), mass("distrust"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, threshold: float = 0.5, damping: float = 0.85, rounds: int | None = None) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, trust, distrust.

    ``pages`` has page_id, url, html; other columns are ignored. A null url, or one without ``://``, has empty
    host and path, no rule, and is allowed (nothing speaks against it). Null html has no links. Repeated pages
    count as often as they occur. An empty table gives no rows. Trust is propagated until it has settled well
    below the threshold of any host, or for just ``rounds`` rounds. Hosts are aggregated before they are joined, so
    a hot host is one row of the graph; its pages, and the links of a hub, are dealt to parts. Pages are read whole.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    judged = parsed.select("*", _longest_rule(F.col("host"), F.col("path"), rules).alias("found"))
    count_if = lambda v: F.count(F.when(F.col("found.verdict") == v, 1))
    hosts = judged.where(F.col("host") != "").groupBy("host").agg(F.count(F.lit(1)).alias("n"), count_if("allow").alias("allow"), count_if("block").alias("block"))
    hosts = materialize(hosts, "hosts")
    total = hosts.agg(F.sum("n")).first()[0] or 1
    seeds = hosts.select("host", (F.col("allow") / total).alias("trust"), (F.col("block") / total).alias("distrust"))
    # a thousandth of the threshold of a host with one page, but not below what sums of doubles can tell
    ranks = propagate(seeds, host_edges(pages), damping, rounds, max(1e-3 * abs(threshold) / total, 1e-14))
    scored = hosts.join(ranks, "host").select(
        "host", "trust", "distrust", (F.col("distrust") - F.col("trust") > threshold * F.col("n") / total).alias("bad")
    )
    return join_spread(judged, scored, "host", ["page_id", "path"], "left").select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce(F.col("found.verdict"), F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )


@settled
def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def urls_sql(rules: Sequence[tuple[str, str]] = RULES, threshold: float = 0.5, damping: float = 0.85, rounds: int = 15) -> str:
    """The same in DuckDB SQL with just ``rounds`` rounds of propagation, written out one after the other."""
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = lambda url: f"coalesce({lower.format(f"regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1)")}, '')"
    values = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in rules)
    steps = "".join(
        f"""
, r{i} AS MATERIALIZED (
  SELECT s.kind, s.host, s.seed, s.passes,
         {1 - damping} * s.seed + {damping} * (coalesce(g.got, 0) + CASE WHEN s.passes THEN 0 ELSE s.mass END) AS mass
  FROM r{i - 1} s LEFT JOIN (SELECT f.kind, f.dst, sum(r.mass * f.share) AS got FROM r{i - 1} r JOIN flow f ON f.kind = r.kind AND f.src = r.host GROUP BY ALL) g
    ON g.kind = s.kind AND g.dst = s.host)"""
        for i in range(1, rounds + 1)
    )
    link, no_links = _LINK.replace("'", "''").replace("(?i)", ""), _NO_LINKS.replace("(?is)", "")
    return f"""
WITH rules(verdict, rule, rule_host, rule_path) AS (VALUES {values}
), p AS (
  SELECT page_id, {host("url")} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, html, row_number() OVER () AS k FROM pages
), fit AS (
  SELECT p.k, max_by(struct_pack(rule := r.rule, verdict := r.verdict), (length(r.rule), r.rule)) AS found
  FROM p JOIN rules r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path) GROUP BY p.k
), judged AS (SELECT p.*, found.rule AS rule, found.verdict AS said FROM p LEFT JOIN fit USING (k)
), hosts AS (
  SELECT host, count(*) AS n, count(*) FILTER (WHERE said = 'allow') AS allow, count(*) FILTER (WHERE said = 'block') AS block,
         sum(count(*)) OVER () AS total FROM judged WHERE host <> '' GROUP BY host
), link AS (
  SELECT k, host AS src, unnest(list_distinct(regexp_extract_all(regexp_replace(coalesce(html, ''), '{no_links}', ' ', 'gis'), '{link}', 1, 'i'))) AS url FROM p
), edge AS (
  SELECT src, dst, count(*) AS n FROM (
    SELECT src, {host("CASE WHEN starts_with(url, '//') THEN 'x:' || url ELSE url END")} AS dst FROM link) WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY ALL
), ways AS (SELECT 'trust' AS kind, src, dst, n FROM edge UNION ALL SELECT 'distrust', dst, src, n FROM edge
), flow AS (SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS share FROM ways
), known AS (
  SELECT kind, src AS host FROM flow UNION SELECT kind, dst FROM flow UNION SELECT unnest(['trust', 'distrust']), host FROM hosts
), r0 AS MATERIALIZED (
  SELECT k.kind, k.host, coalesce(CASE WHEN k.kind = 'trust' THEN h.allow / h.total ELSE h.block / h.total END, 0) AS seed,
         EXISTS (SELECT 1 FROM flow f WHERE f.kind = k.kind AND f.src = k.host) AS passes,
         coalesce(CASE WHEN k.kind = 'trust' THEN h.allow / h.total ELSE h.block / h.total END, 0) AS mass
  FROM known k LEFT JOIN hosts h ON h.host = k.host
){steps}
, bad AS (
  SELECT h.host FROM hosts h JOIN r{rounds} t ON t.host = h.host AND t.kind = 'trust' JOIN r{rounds} d ON d.host = h.host AND d.kind = 'distrust'
  WHERE d.mass - t.mass > {threshold} * h.n / h.total
)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM judged
"""
