"""Near duplicates, mixing, nearest neighbours, decontamination and the pipeline: edge cases and brute force."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re

import numpy as np
import pytest
from conftest import DATA, same_rows
from pyspark.sql import functions as F

import corpus_pipeline
from dealmill.llm import ann, components, decontam, mixing, neardup, queries
from dealmill.llm.queries import SQL


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def _shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute_near(rows):
    """id -> (set size, component) by comparing all pairs."""
    sets = {i: _shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both, every = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if every and sets[a] and sets[b] and 100 * both >= 75 * every:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def _near_corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=4))
    rows, i = [], 0
    for size in (0, 1, 3, 5, 30, 120, 120):
        base = [word() for _ in range(size)]
        for copy in range(14):
            text = list(base)
            for _ in range(copy // 2):
                if text:
                    text[rng.randrange(len(text))] = word()
            rows.append((i, "  ".join(text).upper() if copy == 1 else " \n".join(text)))
            i += 1
    return [*rows, (i, None), (i + 1, "same five words here now"), (i + 2, "Same FIVE words here now")]


def test_near_duplicates_against_brute_force(spark):
    rows = _near_corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sig", F.lit("clash")).withColumn("key", F.lit(1))
    for block in (512, 4):  # the second puts every group through many blocks
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, block=block).collect()}
        assert got == brute_near(rows)


def test_near_duplicates_at_exactly_the_threshold(spark):
    """400 pairs that share 60 of 80 shingles, the least that links them, and 400 that share 59 of 79."""
    rng, rows = random.Random(8), []
    for pair in range(800):
        base = [f"{rng.getrandbits(40):x}" for _ in range(74 if pair < 400 else 73)]
        rows += [(2 * pair, " ".join(base)), (2 * pair + 1, " ".join(base[:64 if pair < 400 else 63] + [f"{rng.getrandbits(40):x}" for _ in range(10)]))]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * p + 1] == 2 * p for p in range(400)) >= 398
    assert all(got[2 * p + 1] == 2 * p + 1 for p in range(400, 800))


def test_near_duplicates_of_one_large_group(spark):
    """Near copies of one text, of another that is chained to it, and texts that share half of it, in one coarse group."""
    rng = random.Random(6)
    word = lambda: f"{rng.getrandbits(40):x}"
    one = [word() for _ in range(60)]
    other = one[:52] + [word() for _ in range(8)]
    rows = []
    for i in range(240):
        text = list(one if i < 150 else other if i < 190 else one[:30] + [word() for _ in range(30)])
        text[rng.randrange(20, 50)] = word()
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_near(rows)
    for block in (512, 16):
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, block=block).collect()} == want


def test_word_digests_follow_the_words():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choices(["a", "B", "é", "bc", " ", "\t", "\n\x0b", "\x1f", "\u00a0", "x" * 5000], k=rng.randint(0, 40)))
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        ids = neardup.text_digests(text, piece=rng.choice([3, 1 << 20]))
        assert len(ids) == len(words) and len(set(zip(ids.tolist(), words))) == len(set(words)) == len(set(ids.tolist()))


def test_comparisons_reach_over_batches_and_hold_repeated_rows():
    import numpy as np
    import pyarrow as pa

    from dealmill.llm.neardup import Sets, _between

    def packed(*members):
        return np.array(members, np.uint64).tobytes()

    # grp, lo, hi, doc_id, block, data: a group whose rows come in three batches, one of two blocks, one of one row
    rows = [
        (1, 0, 0, 1, 0, packed(1, 2, 3, 4)), (1, 0, 0, 2, 0, packed(1, 2, 3, 4)), (1, 0, 0, 2, 0, packed(1, 2, 3, 4)), (1, 0, 0, 3, 0, packed(9)),
        (1, 0, 0, 4, 0, packed(2, 3, 4)), (2, 0, 1, 5, 0, packed(7, 8)), (2, 0, 1, 6, 0, packed(7, 8)), (2, 0, 1, 7, 1, packed(7, 8)), (3, 0, 0, 8, 0, packed(1)),
    ]
    names = ["grp", "lo", "hi", "doc_id", "block", "data"]
    table = pa.table(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))
    for size in (1, 2, 3, 100):
        batches = [pa.RecordBatch.from_pylist([], schema=table.schema), *table.to_batches(max_chunksize=size)]
        found = [e for out in _between(Sets(75))(iter(batches)) for e in zip(*out.to_pydict().values(), strict=True)]
        # 5 and 6 are of one block and are not compared here
        assert sorted(tuple(sorted(e)) for e in found) == [(1, 2), (1, 4), (5, 7), (6, 7)]
    assert [out.num_rows for out in _between(Sets(75))(iter([]))] == [0]


def test_near_duplicates_edge_tables(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, " \t"), (4, "x"), (5, "x"), (5, "x"), (None, "x")], "doc_id long, text string")
    rows = neardup.near_duplicates(df).collect()
    assert len(rows) == 7 and {(r.doc_id, r.component_id) for r in rows} == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (None, 4)}
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_minhash_estimates_similarity():
    a, b = {f"w{i}" for i in range(400)}, {f"w{i}" for i in range(100, 500)}
    h = lambda s: np.array([int(hashlib.md5(x.encode()).hexdigest()[:16], 16) for x in s], np.uint64)
    same = (neardup.minhashes(h(a), 1024) == neardup.minhashes(h(b), 1024)).mean()
    assert abs(same - 0.6) < 0.06


@pytest.mark.parametrize("name", ["op2_near_duplicates", "op5_mix", "op8_decontaminate"])
def test_query_equals_oracle(spark, duck, name):
    same_rows(queries.QUERIES[name](spark, DATA), duck.execute(SQL[name]).df())


def _targets(sizes, weights=(5, 2, 1), cap=3):
    """Targets by capping and resharing round after round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = sum(weight[s] for s in names if s not in capped)
        rest = total - sum(cap * sizes[s] for s in capped)
        over = {s for s in names if s not in capped and weight[s] * rest > cap * sizes[s] * free}
        if not over:
            return {s: cap * sizes[s] if s in capped else weight[s] * rest / free for s in names}
        capped |= over


def _mix_docs(spark, seed=1):
    rng = random.Random(seed)
    rows = [(i, "w " * rng.randint(0, 90), rng.choice(["a", "b", None, "hot", "hot", "hot", "ü"])) for i in range(1500)]
    rows += [(1500, "tiny one", "small"), (None, "x " * 40, "a"), (3, "y " * 40, "a"), (3, "y " * 40, "a"), (1501, None, "b"), (1502, "v " * 30000, "long")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("position", F.lit(0))


def test_mix_targets_and_takes(spark):
    rows, df = _mix_docs(spark)
    got = mixing.mix_sources(df).collect()
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = _targets(sizes)
    taken = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert len(got) == len(rows)
    for s, t in taken.items():
        assert abs(t - want[s]) <= 33 * max(1, math.ceil(len(rows) / 512)) + 0.01 * want[s], (s, t, want[s])
    again = mixing.mix_sources(df.repartition(7)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.source or "", r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mix_edge_tables(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix_sources(spark.createDataFrame([], schema)).count() == 0
    empty = mixing.mix_sources(spark.createDataFrame([(1, None, "a"), (2, "", None)], schema)).collect()
    assert [(r.size, r.taken) for r in empty] == [(0, 0), (0, 0)]


def test_sainte_lague_by_quotients(spark):
    claims, seats = [530, 240, 120, 70, 40, 3, 0], 57
    df = spark.createDataFrame([(i, float(c), seats, 1000) for i, c in enumerate(claims)], "p int, claim double, seats long, cap long")
    got = {r.p: r.quota for r in mixing.sainte_lague(df, [], "claim", "seats", "cap", ["p"]).collect()}
    quotients = sorted(((-c / (2 * k + 1), i) for i, c in enumerate(claims) for k in range(seats)))[:seats]
    assert got == {i: sum(j == i for _, j in quotients) for i in range(len(claims))}


def _embeddings(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    x = np.concatenate([centres[rng.integers(0, 12, 900)] + 0.3 * rng.normal(size=(900, 16)), rng.normal(size=(300, 16)), np.tile(rng.normal(size=16), (400, 1))]).astype(np.float32)
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)]
    odd = [(2000, None, 1), (2020, [0.0] * 16, 1), (2040, [float("nan")] * 16, 1), (2060, [None] * 16, 1), (2080, [1.0, 2.0], 1), (None, [1.0] * 16, 1), (2100, [float("inf")] * 16, 1)]
    return x, spark.createDataFrame([*rows, *odd, rows[7]], "vec_id long, embedding array<float>, vec int")


def test_nearest_recall_ranks_and_ties(spark):
    x, df = _embeddings(spark)
    small = ann.AnnParams(list_size=20, centroids=80, probes=40, part=64)
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, 20, small).toPandas()
    y, found = x.astype(float), 0
    for q, own in got.groupby("query_id"):
        own = own.sort_values("rank")
        assert list(own["rank"]) == list(range(1, 21)) and q not in set(own.vec_id)
        assert own.score.to_numpy() == pytest.approx(y[own.vec_id.to_numpy()] @ y[q], abs=1e-9)
        order = sorted(zip(-own.score, own.vec_id))
        assert [v for _, v in order] == list(own.vec_id)
        s = y @ y[q]
        want = [j for j in np.lexsort((np.arange(len(y)), -s)) if j != q][:20]
        found += len(set(want) & set(own.vec_id))
        if q >= 1200:  # the hot vector: its copies with the smallest ids
            assert list(own.vec_id) == want
    assert got.query_id.nunique() == 80 and found >= 0.9 * 20 * 80


def test_nearest_small_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 2.0])], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 1, 0.5), (0, 2, 20, 0.0), (20, 1, 1, 1.0), (20, 2, 0, 0.0)]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_nearest_recall_on_the_table(spark):
    import pandas as pd

    got = queries.QUERIES["op7_nearest"](spark, "/root/testdata/sf0.1").toPandas().groupby("query_id").vec_id.apply(set)
    table = pd.read_parquet("/root/testdata/sf0.1/embeddings.parquet")
    y, ids = np.stack(table.embedding).astype(float), table.vec_id.to_numpy()
    recall = []
    for q in np.flatnonzero(ids % 20 == 0):
        s = y @ y[q]
        s[q] = -np.inf
        recall.append(len(got[ids[q]] & set(ids[np.lexsort((ids, -s))[:20]])) / 20)
    assert np.mean(recall) >= 0.9


def _recall(got, x, queries_at, k=20):
    found = got.groupby("query_id").vec_id.apply(set)
    share = []
    for q in queries_at:
        s = x @ x[q]
        s[q] = -np.inf
        share.append(len(found[q] & set(np.lexsort((np.arange(len(x)), -s))[:k])) / k)
    return np.mean(share)


def test_nearest_recall_at_two_sizes_with_cells_and_exact(spark):
    """Regions of several cells at both sizes; reading all lists gives all neighbours, of doubles beyond floats too."""
    rng = np.random.default_rng(12)
    for n in (2_000, 8_000):
        centres = rng.normal(size=(40, 24))
        x = centres[rng.integers(0, 40, n)] + 0.5 * rng.normal(size=(n, 24))
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        small = ann.AnnParams(list_size=16, centroids=32, cells=16)
        got = ann.nearest(df, F.col("vec_id") % 20 == 0, 20, small).toPandas()
        assert _recall(got, x, range(0, n, 20)) >= 0.9
        assert got.score.to_numpy() == pytest.approx((x[got.query_id] * x[got.vec_id]).sum(1), abs=1e-12)
    far = spark.createDataFrame([(i, (v * 1e100).tolist()) for i, v in enumerate(x[:1_000])], "vec_id long, embedding array<double>")
    got = ann.nearest(far, F.col("vec_id") % 20 == 0, 20, ann.AnnParams(list_size=16, centroids=32, cells=16, probes=None)).toPandas()
    assert _recall(got, x[:1_000], range(0, 1_000, 20)) == 1.0


def test_centroid_graph_finds_the_nearest():
    rng = np.random.default_rng(3)
    points, asked = rng.normal(size=(700, 12)).astype(np.float32), rng.normal(size=(50, 12)).astype(np.float32)
    ids, d = ann.CentroidGraph(points).search(asked, 10)
    every = ((asked[:, None, :] - points[None, :, :]) ** 2).sum(2)
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids, np.argsort(every, axis=1)[:, :10])]) > 0.97
    assert d == pytest.approx(np.take_along_axis(every, ids, 1), abs=1e-3) and all(len(set(row)) == 10 for row in ids)


def _words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def brute_contamination(docs, items):
    out = []
    for i, text in docs:
        words, hit, named = _words(text), set(), set()
        for item, t in items:
            own = _words(t)
            for s in range(max(len(own) - 9, 1) if own else 0):
                window = own[s : s + 10]
                for at in range(len(words) - len(window) + 1):
                    if words[at : at + len(window)] == window:
                        hit |= set(range(at, at + len(window)))
                        named.add(str(item))
        out.append((i, len(words), len(hit), sorted(named)))
    return out


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "the the the the the the the the the the the"), (30, "Short É item"), (4, None), (5, "..."), (6, "Short é item"), (6, "short É ITEM")]


def test_decontamination_against_brute_force(spark):
    rng = random.Random(5)
    pool = "one two three four five six seven eight nine ten eleven twelve the short É é item filler".split()
    docs = [(i, " ".join(rng.choices(pool, k=rng.randint(0, 60)))) for i in range(60)]
    docs += [(60, "x one, two. THREE-four five six seven eight nine ten eleven twelve y"), (61, "the " * 300), (62, None), (63, ""), (64, "short É item short É item"), (64, "a short É item"), (None, "Short É item")]
    docs += [(65, "w " * 20000 + "two three four five six seven eight nine ten eleven")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rid", F.lit(1)).withColumn("pos", F.lit(1))
    got = decontam.decontaminate(df, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted([(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got], key=key) == sorted(brute_contamination(docs, ITEMS), key=key)
    assert all(r.contaminated == (r.n_hit > 0) and sum(s["to"] - s["from"] for s in r.spans or []) == r.n_hit for r in got)


def test_decontamination_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontam.decontaminate(docs.limit(0), items).count() == 0
    assert [(r.n_words, r.contaminated) for r in decontam.decontaminate(docs, items.limit(0)).collect()] == [(2, False)]


def test_proximity_matches(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "gamma x beta y alpha"), (2, "alpha" + " x" * 30 + " beta gamma"), (3, "alpha beta")], "doc_id long, text string")
    tests = decontam.test_windows(items)
    index = decontam.build_index(docs, tests)
    ids = {r.rid: r.doc_id for r in index.where("term_id = 0").collect()}
    assert {ids[r.rid] for r in decontam.proximity_matches(index, tests).collect()} == {1}


def brute_proximity(docs, items, slop=5):
    """(doc_id, window, place): each place of the window's rarest word from which a span holds all its words."""
    cut = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) if w]
    windows = {tuple(ws[i : i + 10]) for _, t in items for ws in [cut(t)] if ws for i in range(max(len(ws) - 9, 1))}
    texts = {i: cut(t) for i, t in docs}
    count = {w: sum(ws.count(w) for ws in texts.values()) for win in windows for w in win}
    out = set()
    for win in windows:
        rare, width = min(dict.fromkeys(win), key=lambda w: (count[w], win.index(w))), len(win) + slop
        for i, ws in texts.items():
            for at in (k for k, w in enumerate(ws) if w == rare):
                if any(set(win) <= set(ws[s : s + width]) and ws[s] in win for s in range(max(0, at - width + 1), at + 1)):
                    out.add((i, win, at))
    return out


def test_proximity_against_brute_force(spark):
    r = random.Random(8)
    vocabulary = [f"w{k}" for k in range(9)]
    items = [(k, " ".join(r.choices(vocabulary, k=r.choice([1, 2, 4, 12])))) for k in range(12)]
    docs = [(k, " ".join(r.choices([*vocabulary, "x", "y", "z"], k=r.randint(0, 90)))) for k in range(25)] + [(900, None)]
    got = decontam.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute_proximity(docs, items)
    assert {x.doc_id: x.n_near for x in got} == {i: sum(d == i for d, _, _ in want) for i, _ in docs} and len(want) > 100


def test_proximity_of_a_word_repeated_ten_thousand_times(spark):
    items = [(1, "alpha beta gamma"), (2, "alpha alpha"), (3, "alpha delta")]
    docs = [(1, "alpha " * 10_000 + "x beta gamma"), (2, "delta " + "alpha " * 10_000), (3, "alpha " * 10_000 + "y " * 40 + "beta gamma")]
    got = decontam.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute_proximity(docs, items)
    assert {x.doc_id: x.n_near for x in got} == {i: sum(d == i for d, _, _ in want) for i, _ in docs}


def test_decontamination_returns_proximity_matches(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta"), (None, "beta gamma")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "gamma x beta y alpha"), (2, "alpha" + " x" * 30 + " beta"), (3, "alpha beta gamma delta"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: (r.contaminated, r["items"], r.n_near, r.near_items) for r in decontam.decontaminate(docs, items).collect()}
    assert got == {1: (False, [], 2, ["1"]), 2: (False, [], 0, []), 3: (True, ["1", "2"], 3, ["1", "2"]), 4: (False, [], 0, [])}
    assert decontam.decontaminate(docs, items, slop=None).columns == ["doc_id", "n_words", "n_hit", "spans", "items", "contaminated"]


def _pipeline_by_hand(spark, docs):
    """The first three stages on plain Python rows (doc_id unique)."""
    from dealmill.llm.toxicity import fitted_model

    model = fitted_model(spark.read.parquet(f"{DATA}/documents.parquet"), DATA)
    match = model.matcher()
    kept = [d for d in docs if model.probability(model.feature(*match(d[1] or "")[1:])) < 0.5]
    near = brute_near([(d[0], d[1]) for d in kept])
    kept = [d for d in kept if near[d[0]][1] == d[0]]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    leaks = {i for i, _, n, _ in brute_contamination([(d[0], d[1]) for d in kept], items) if n}
    return [d for d in kept if d[0] not in leaks]


def test_pipeline_against_brute_force(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    kept = _pipeline_by_hand(spark, docs)
    assert 0 < len(kept) < len(docs)
    got = corpus_pipeline.run(spark, DATA).collect()
    want = mixing.mix_sources(spark.createDataFrame(kept, "doc_id long, text string, source string")).where("taken > 0").collect()
    key = lambda r: (r.doc_id, r.source, r.size, r.source_size, round(r.target, 6), r.taken)
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_queries_and_pipeline_leave_nothing_but_their_rows(spark):
    from dealmill.llm.common import drop_scratch

    base = spark.conf.get("spark.checkpoint.dir")
    left = lambda: [f for f in os.listdir(base) if not f.count("-") == 4 or "." in f]  # noqa: E731 (the session's own folder aside)
    drop_scratch(spark)
    before = set(left())
    for name in ("op3_token_counts", "op8_decontaminate"):
        queries.QUERIES[name](spark, DATA)
    new = sorted(f.rsplit("-", 1)[0] for f in set(left()) - before)
    assert new == ["op3_token_counts", "op8_decontaminate"]
    corpus_pipeline.run(spark, DATA)
    assert {f.rsplit("-", 1)[0] for f in set(left()) - before} == {*new, "stage-mixing"}
    drop_scratch(spark)
    assert set(left()) == before


def test_pipeline_stages_keep_columns_and_odd_rows(spark):
    rows = [(None, "some plain words that nobody repeats at all", "en", None, 1, "k"), (None, None, None, "s", None, "k"), (5, "", "en", "s", 0, None), (5, "same text of five words", "en", "s", 0, "k"), (5, "same text of five words", "en", "s", 0, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row string")
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, DATA)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), DATA).count() == 0
    assert sorted(str(r.text) for r in out.collect()) == ["", "None", "same text of five words", rows[0][1]]
    assert corpus_pipeline.mixing(spark, out, DATA).count() >= 1
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicate", "decontamination", "mixing"]


def _shuffle_files(spark) -> int:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return sum("shuffle_" in f for f in files.split("\n"))


def test_shuffle_files_go_with_the_write_that_made_them(spark):
    from dealmill.llm.common import materialize

    counts = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held, before = spark.conf.get(setting), _shuffle_files(spark)
    assert materialize(counts, "counts").count() == 7 and materialize(counts, "counts").agg(F.sum("count")).first()[0] == 1000
    assert _shuffle_files(spark) <= before + 4 and spark.conf.get(setting) == held  # the two reads' own files at most


def test_shared_keys_join_the_same_documents_and_equal_ones_are_one(spark):
    rng = random.Random(5)
    keys = {k: rng.sample(range(40), rng.choice([1, 1, 2, 3, 9])) for k in range(300)} | {k: [50, 51] for k in range(1000, 1024)} | {2000: [60]}
    rows = spark.createDataFrame([(d, k) for k, held in keys.items() for d in held], "doc_id long, key long")
    together = lambda by: {(a, b) for held in by.values() for a in held for b in held if a < b}
    got: dict[int, list[int]] = {}
    for r in neardup._shared(rows, "often").collect():
        got.setdefault(r.key, []).append(r.doc_id)
    assert together(got) == together(keys)
    assert len(got) == len({frozenset(held) for held in keys.values() if len(held) > 1})


def test_near_duplicates_with_repeated_ids(spark):
    words = [f"w{i}" for i in range(60)]
    x, y, z = " ".join(words), " ".join([*words[:59], "other"]), " ".join(f"v{i}" for i in range(60))
    df = spark.createDataFrame([(1, x), (2, y), (2, y), (3, z), (3, z.upper()), (4, z), (5, None), (None, "a b")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in neardup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (2, 1), (3, 3), (3, 3), (4, 3), (5, 5), (None, None)], key=str)
