"""Hard negatives, source divergence and quality against brute force, and their edges."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA, same_rows
from pyspark.sql import functions as F

from dealmill.llm import divergence, negatives, quality

# --- hard negatives


def mined(rows, is_anchor, positives=5, negatives_=10):
    """All pairs, one after the other, in whole numbers."""
    own = {}
    for i, label, x in rows:
        if i is not None and label is not None and x is not None and all(v is not None and np.isfinite(v) for v in x):
            own.setdefault(i, (label, [int(np.floor(256 * float(v))) for v in x]))
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=True))
    out = set()
    for a in (i for i in own if is_anchor(i)):
        scored = sorted((-dot(own[a][1], own[b][1]), b) for b in own if b != a)
        for s, b in [x for x in scored if own[x[1]][0] == own[a][0]][:positives]:
            inside = [(t, c) for t, c in scored if own[c][0] != own[a][0] and 30 * -s <= 100 * -t <= 90 * -s]
            out |= {(a, b, n, c, -s, -t) for n, (t, c) in enumerate(inside[:negatives_], 1)}
    return out


def got(df):
    return {tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()}


def embedded(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, label int, embedding array<{kind}>")


def test_hard_negatives_equal_sql(spark, duck):
    same_rows(negatives.op11_hard_negatives(spark, DATA), duck.execute(negatives.OP11_SQL).df())


@pytest.mark.parametrize("longest", [1, 40])
def test_hard_negatives_over_many_regions_and_parts(spark, longest):
    r = np.random.default_rng(4)
    x = (r.standard_normal((1500, 6)) + 3 * r.standard_normal((5, 6))[r.integers(0, 5, 1500)]).astype(np.float32)
    x[::50] *= longest
    x[100:500] = x[100]  # many equal vectors, most of one label
    label = np.where(np.arange(1500) < 480, 1, r.integers(0, 4, 1500))
    rows = [(i, int(label[i]), x[i].tolist()) for i in range(1500)]
    p = negatives.MiningParams(part=100, sample=400, leaf=8)
    found = negatives.hard_negatives(embedded(spark, rows).withColumn("vec", F.lit(1)).withColumn("region", F.lit("a")), F.col("vec_id") % 20 == 0, p)
    assert got(found) == mined(rows, lambda i: i % 20 == 0)


def test_hard_negatives_edges(spark):
    rows = [
        (0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 1, [1.0, 0.0]), (3, 1, [0.0, 1.0]), (4, 2, [0.5, 0.0]), (5, 2, [0.5, 0.0]), (4, 2, [0.5, 0.0]),
        (6, 2, [0.9, 0.1]), (7, 3, [-1.0, 0.0]), (8, None, [0.5, 0.5]), (9, 2, None), (10, 2, [0.5, float("nan")]), (11, 2, [0.5, None]),
        (12, 2, [float("inf"), 0.0]), (None, 2, [0.6, 0.0]), (20, 4, [0.0, 0.0]), (40, 4, [0.0, 0.0]), (60, 5, [1.0, 1.0]),
    ]
    found = negatives.hard_negatives(embedded(spark, rows), F.col("vec_id") % 20 == 0)
    assert got(found) == mined(rows, lambda i: i % 20 == 0) and found.count() > 0
    assert negatives.hard_negatives(embedded(spark, []), F.col("vec_id") > 0).count() == 0
    assert negatives.hard_negatives(embedded(spark, rows[:4] + [(5, 2, [0.5, 0.0, 0.0])]), F.col("vec_id") == 0).count() == 0  # of another length


def test_hard_negatives_beyond_doubles(spark):
    r = np.random.default_rng(9)
    rows = [(i, i % 2, (r.standard_normal(4) * 2.0**20).tolist()) for i in range(60)]
    found = negatives.hard_negatives(embedded(spark, rows, "double"), F.col("vec_id") % 20 == 0)
    assert got(found) == mined(rows, lambda i: i % 20 == 0) and found.count() > 0


def test_most_of_the_rows_are_left_out_where_distances_tell(spark):
    """Clusters far apart: a search looks at few leaves of the tree."""
    import pyarrow as pa

    r = np.random.default_rng(2)
    x = np.floor(256 * (r.standard_normal((64, 8)) * 20)[np.repeat(np.arange(64), 64)] + r.standard_normal((4096, 8)) * 20)
    table = pa.table({"vec_id": np.arange(4096), "label": np.arange(4096) % 2, "vec": pa.array([v.tobytes() for v in x], pa.binary())})
    block, looked = negatives._Block(table, 8, float((x**2).sum(1).max()), 32), []
    scores = block.scores
    block.scores = lambda lo, hi, a: looked.append(hi - lo) or scores(lo, hi, a)
    (_, ids, found), = block.search(x[7], 1, np.array([(0, negatives.LEAST, negatives.MOST, negatives.LEAST)]), 5, True)
    s = np.where(np.arange(4096) % 2 == 1, x @ x[7], -np.inf)
    assert found.tolist() == sorted(s, reverse=True)[:5] and sum(looked) < 1000


# --- source divergence


def audited(rows, terms=200, least=3):
    """One pair and one term at a time, in whole numbers."""
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        ws = [w.decode() for w in divergence.words((text or "").encode())]
        groups.add((lang, source))
        count[lang, source].update(ws)
        docs[lang].update(set(ws))
    out = set()
    share = lambda n, total: 1 + 10**9 * (n + 1) // total
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = [s for g, s in groups if g == lang]
        whole = {t: sum(count[lang, s][t] for s in sources) for t in kept}
        p = {s: {t: share(count[lang, s][t], sum(count[lang, s][u] for u in kept) + len(kept)) for t in kept} for s in sources}
        q = {t: share(whole[t], sum(whole.values()) + len(kept)) for t in kept}
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in sources if o != s]
            best = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(best)[:terms])):
                out |= {(lang, s, part, item.decode(), -v, n) for n, (v, item) in enumerate(items, 1)}
    return out


def test_divergence_equals_sql(spark, duck):
    same_rows(divergence.op12_source_divergence(spark, DATA), duck.execute(divergence.OP12_SQL).df())


@pytest.mark.parametrize("params", [divergence.AuditParams(), divergence.AuditParams(block=7, band=2, held=20, terms=5)])
def test_divergence_in_blocks_and_bands(spark, params):
    r = np.random.default_rng(6)
    vocabulary = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)] + ["Ärger", "ärger", "naïve", "x"]
    text = lambda: " ".join(r.choice(vocabulary, int(r.integers(0, 30))))
    rows = [(text(), str(r.choice(["en", "de"])), f"s{int(min(r.integers(0, 12), r.integers(0, 12)))}") for _ in range(120)]
    rows += [(None, "en", "s1"), ("x x", None, None), ("Wa;waa", None, "s"), ("", "fr", "only"), ("a b", "it", "p"), ("a b", "it", "r"), ("Waa\x00WAA_waa9waa", "en", "s2")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("term", F.lit("clash")).withColumn("band", F.lit(1))
    found = divergence.source_divergence(df, params).collect()
    assert {tuple(x[c] for c in ("lang", "source", "part", "item", "value", "rank")) for x in found} == audited(rows, params.terms)
    assert len(found) == len(set(found))


def test_divergence_of_nothing(spark):
    assert divergence.source_divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_shares_do_not_overflow():
    n, total = np.array([9 * 10**14, 0]), np.array([9 * 10**15, 7])
    assert divergence.shares(n, total).tolist() == [1 + 10**9 * (9 * 10**14 + 1) // (9 * 10**15), 1 + 10**9 // 7]


# --- quality


def texts(n, seed):
    r = np.random.default_rng(seed)
    word = lambda: "".join(r.choice(list("aeinorst"), int(r.integers(2, 8))))
    out = []
    for i in range(n):
        good = i % 4 > 0
        ws = [word() for _ in range(int(r.integers(5, 300)))]
        if not good:
            at = int(r.integers(0, len(ws)))
            ws[at:] = [w.upper() + "!!" for w in ws[at:]]
        out.append((i, " ".join(ws), int(good)))
    return out


def test_chunks_cover_a_text_and_overlap_by_a_filter():
    p = quality.QualityParams()
    for n in (0, 1, p.width, p.chunk, p.chunk + 1, 5 * p.chunk + 3):
        text = np.random.default_rng(n).integers(0, 256, n).astype(np.uint8).tobytes()
        chunks = quality.chunks_of(text, p)
        windows = {bytes(c[k : k + p.width].astype(np.uint8)) for c in chunks for k in range(p.chunk - p.width + 1)}
        assert len(chunks) >= 1 and all(text[k : k + p.width] in windows for k in range(n - p.width + 1))


def test_gradients_are_those_of_the_loss():
    p, r = quality.QualityParams(filters=4, hidden=5), np.random.default_rng(1)
    model = quality.QualityModel(p)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    chunks = [quality.chunks_of(bytes(r.integers(60, 120, int(r.integers(5, 900))).astype(np.uint8)), p) for _ in range(6)]
    good = np.array([1, 0, 1, 1, 0, 0], float)
    _, slopes = model.gradients(chunks, good)
    for name, w in model.weights.items():
        at = np.unravel_index(np.abs(slopes[name]).argmax(), w.shape)
        was, loss = w[at], []
        for step in (1e-5, -1e-5):
            w[at] = was + step
            loss.append(model.gradients(chunks, good)[0])
        w[at] = was
        assert abs((loss[0] - loss[1]) / 2e-5 - slopes[name][at]) < 1e-4


def test_quality_on_texts_not_learned_from(spark):
    rows = texts(500, 3)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, g) for i, _, g in rows if i < 400], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels, quality.QualityParams(filters=16, hidden=8, rounds=8, batch=16))
    scored = {r.doc_id: (r.score, r.predicted) for r in quality.score_quality(docs, model).collect()}
    told = [(scored[i], g) for i, _, g in rows if i >= 400]
    assert sum(p == g for (_, p), g in told) >= 95
    good, bad = [s for (s, _), g in told if g], [s for (s, _), g in told if not g]
    assert np.mean([[b < g for b in bad] for g in good]) > 0.95
    assert all(p == int(s >= 0.3) for s, p in scored.values())


def test_quality_is_the_same_however_texts_meet(spark):
    model, rows = quality.QualityModel(), [t.encode() for _, t, _ in texts(40, 8)] + [b"", b"x" * 40_000]
    together = model.probabilities(rows, 7)
    assert np.allclose(together, [model.probabilities([t])[0] for t in rows], atol=1e-6)


def test_quality_edges(spark):
    model = quality.QualityModel()
    rows = [(1, None, "a"), (1, "", "b"), (None, "x" * 100_000, None), (2, "\U0001f600 é", "c"), (2, "\U0001f600 é", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string").withColumn("predicted", F.lit("no"))
    out = quality.score_quality(df, model).collect()
    assert len(out) == 5 and out[0].score == out[1].score and out[3].score == out[4].score and all(0 <= r.score <= 1 for r in out)
    assert quality.score_quality(df.limit(0), model).count() == 0
    nothing = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score_quality(df, quality.fit_quality(df, nothing)).first().score == pytest.approx(0.5)
    one = spark.createDataFrame([(1, 1), (1, None), (None, 0)], "doc_id long, quality int")
    assert quality.score_quality(df, quality.fit_quality(df, one)).first().predicted == 1


def test_op13_scores_every_document_and_holds_a_fold_out(spark):
    out = quality.op13_quality(spark, DATA).toPandas()
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert len(out) == docs.count() and out["score"].between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(out["doc_id"], out["held_out"], strict=True))


def test_visits_of_many_regions_come_in_small_batches(spark, monkeypatch):
    import hashlib

    rng = np.random.default_rng(2)
    x = rng.integers(-50, 50, (600, 4)).astype("f8")
    longest2 = float((x**2).sum(1).max())
    tree = negatives.VantageTree(negatives._lift(x, longest2), longest2, 4)
    everything = [{"tag": 0, "lo": negatives.LEAST, "hi": negatives.MOST, "need": negatives.LEAST}]
    window = pa.list_(pa.struct([(k, pa.int64()) for k in ("tag", "lo", "hi", "need")]))
    asks = pa.RecordBatch.from_arrays([pa.array([bytes([i]) for i in range(100)]), pa.array([v.tobytes() for v in x[:100]]), pa.array([everything] * 100, window)], ["vh", "vec", "windows"])
    visits = lambda: list(negatives._visits(tree, 4, longest2, False)(iter([asks])))
    whole = pa.Table.from_batches(visits())
    monkeypatch.setattr(negatives, "VISIT_BYTES", 288 * 50)
    parts = visits()
    assert whole.num_rows == 100 * (len(tree.leaves()) - 1) and max(b.num_rows for b in parts) <= 50 and pa.Table.from_batches(parts).equals(whole)

    posts = spark.createDataFrame([(bytearray(hashlib.md5(str(i // 2).encode()).digest()), i) for i in range(2000)], "vh binary, vec_id long")
    want = [r.vec_id for r in posts.orderBy("vh", "vec_id").limit(50).collect()]
    low = negatives._lowest(posts, 2000, 50)
    assert sorted(r.vec_id for r in low.collect()) == sorted(want) and "vh" in low._jdf.queryExecution().optimizedPlan().toString().split("Filter")[1]
