"""Chat formatting, token counts, toxicity, licenses, URLs, HTML: edge cases and brute force."""

from __future__ import annotations

import functools
import hashlib
import random
import re

import public_tokenizers
import pytest
from conftest import DATA, same_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dealmill.llm import chat, html_extract, licenses, tokens, toxicity, urls
from dealmill.llm.queries import SQL
from dealmill.llm import queries

TURNS = "conv_id long, turn long, role string, text string, turns string, formatted int"


def test_chat_round_trip_of_hard_texts(spark):
    hard = ["\\### Assistant: </turn> ok", "\n</turn>\n### user\nx", "</turn>", "\\\\### ", "ends with \\", "", None, "### ", "#### a", "é\u2028\r\n</turn>\n"]
    rows = [(i, t, role, text, "x", 1) for i, text in enumerate(hard) for t, role in ((0, "user"), (1, "assistant"), (1, "a\\nb\n\\"), (None, None))]
    out = chat.format_conversations(spark.createDataFrame(rows, TURNS))
    got = {r.conv_id: r for r in chat.digest_rows(out).collect()}
    assert len(got) == len(hard) and all(r.round_trip for r in got.values())
    for i, text in enumerate(hard):
        text = text or ""
        turns = [("", text), ("user", text), ("a\\nb\n\\", text), ("assistant", text)]
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        assert got[i].turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[i].n_turns == 4
        assert got[i].loss_sha256 == hashlib.sha256(text.encode()).hexdigest() and got[i].loss_chars == len(text)


def test_chat_escapes_only_what_conflicts(spark):
    rows = spark.createDataFrame([(1, 0, "user", "plain", "", 0), (2, 0, "user", "a </turn> b", "", 0)], TURNS)
    got = {r.conv_id: r.formatted for r in chat.format_conversations(rows).collect()}
    assert got == {1: "### user\nplain\n</turn>\n", 2: "### user\na \\</turn> b\n</turn>\n"}


def test_chat_repeated_rows_and_empty_table(spark):
    rows = spark.createDataFrame([(None, 0, "assistant", "x", "", 0)] * 2, TURNS)
    row = chat.digest_rows(chat.format_conversations(rows)).first()
    assert row.n_turns == 2 and row.loss_chars == 2
    assert chat.digest_rows(chat.format_conversations(rows.limit(0))).count() == 0


def test_tokens_equal_the_library_and_cache_is_used(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["A  b\n c", "a b c", "", None, "<|endoftext|> x <|ENDOFTEXT|>", "J\u030c ẖ É́ 日本 \u00a0 x", "  lead", "don't 12345 ???", "long " * 3000]
    df = spark.createDataFrame([(i if i else None, t, "n") for i, t in enumerate([*texts, *texts])], "doc_id long, text string, n_tokens string")
    got = tokens.count_tokens(df, path, str(tmp_path / "cache")).collect()
    tok = Tokenizer.from_file(path)
    want = sorted(len(tok.encode(t or "", add_special_tokens=False).ids) for t in [*texts, *texts])
    assert sorted(r.n_tokens for r in got) == want and sum(r.over_limit for r in got) == 2
    stored = spark.read.parquet(str(tmp_path / "cache")).count()
    assert stored == spark.read.parquet(str(tmp_path / "cache")).select("content").distinct().count()
    tokens.count_tokens(df, path, str(tmp_path / "cache")).collect()
    assert spark.read.parquet(str(tmp_path / "cache")).count() == stored  # no new misses
    assert tokens.count_tokens(df.limit(0), path, str(tmp_path / "empty")).count() == 0


def test_tokens_sentencepiece(spark, tmp_path):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    got = tokens.count_tokens(spark.createDataFrame([(1, "Hello  world"), (2, "")], "doc_id long, text string"), path, str(tmp_path / "c")).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == [len(sentencepiece.SentencePieceProcessor(model_file=path).encode("Hello world")), 0]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aJ<|endoftx>' \t\n\u0301\u030c12é日?!")), max_size=40))
def test_normalising_never_changes_a_count(text):
    encode = tokens._encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert encode([text]) == encode([re.sub(r"[ \t\n\x0b\f\r]+", " ", text).strip(" ")])


def test_words_met_before_are_not_encoded_again():
    seen = []
    encode = tokens.by_stretches(lambda texts: seen.extend(texts) or [sum(map(len, t.split())) for t in texts], most=50)
    texts = ["alpha beta gamma alpha", "beta " * 1000, "", "x" * 100, "alpha  beta delta"]
    for _ in range(3):
        assert encode(texts) == [len(t.replace(" ", "")) for t in texts]
    met, seen[:] = len(seen), []
    assert encode(texts) == [len(t.replace(" ", "")) for t in texts]
    assert met and [t for t in seen if t.strip()] == ["x" * 100]  # too long to be remembered
    for lo in range(0, 400, 40):  # more than are remembered
        assert encode([f"w{i} w{i - 20}" for i in range(lo, lo + 40)]) == [len(f"w{i}w{i - 20}") for i in range(lo, lo + 40)]


def test_only_known_tokenizers_are_counted_by_stretches():
    import json

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    assert tokens.ends_at_spaces(spec)
    spaced = {"id": 9, "content": "a b", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}
    byte_level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    for change in ({"added_tokens": [spaced]}, {"added_tokens": [spaced | {"content": "a", "lstrip": True}]}, {"pre_tokenizer": None}, {"pre_tokenizer": byte_level}, {"normalizer": {"type": "Strip"}}):
        assert not tokens.ends_at_spaces(spec | change)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aJ<|endoftx>' \t\u0301\u030c\u0345\u00a0Σςİé日한\u11a8?!2")), max_size=40), max_size=5))
def test_counts_by_stretches_equal_the_library(texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, encode = _library(path), tokens._encoder(path)
    for _ in range(2):
        assert encode(texts) == [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]


@functools.cache
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def test_toxicity_folding_and_exceptions():
    m = toxicity.ToxicityModel({toxicity.fold("idiot"): 4.0, toxicity.fold("clown"): 4.0, toxicity.fold("trash"): 4.0}, {toxicity.fold("trash can")})
    match = m.matcher()
    hits = lambda t: len(match(t)[2])
    for text in ("you idiot!", "1D1OT", "c1own", "іdіоt", "ïdïot", "i\u200bdiot", "ｉｄｉｏｔ", "idiot$$$", "tr@sh"):
        assert hits(text) == 1, text
    for text in ("idiotic", "a trash can", "clowns", "", "12345 100%"):
        assert hits(text) == 0, text


def test_toxicity_scores_edge_rows_and_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (None, None), (3, ""), (3, "fine words"), (4, "word " * 50000 + "idiot")], "doc_id long, text string").withColumn("score", F.lit("old")).withColumn("x", F.lit(1))
    model = toxicity.fit_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    got = toxicity.score_toxicity(docs, model)
    assert set(got.columns) == {"doc_id", "text", "x", "score", "predicted"}
    rows = got.collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert [r.predicted for r in rows if r.doc_id == 1] == [1] and all(r.predicted == 0 for r in rows if not r.text)
    assert toxicity.keep_harmless(docs, model).columns == docs.columns
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def _naive_hits(model, text):
    """Places of terms in the folded text, found one by one, outside exception phrases."""
    folded = toxicity.fold(text or "")

    def places(term):
        for a in range(len(folded) - len(term) + 1):
            b = a + len(term)
            if folded[a:b] == term and not folded[a - 1 : a].isalpha() and not folded[b : b + 1].isalpha():
                yield a, b

    spared = [p for e in model.exceptions for p in places(e)]
    return folded, sorted((t, a, b) for t in model.weights for a, b in places(t) if not any(x <= a and b <= y for x, y in spared))


def test_toxicity_matches_against_brute_force():
    rng, model = random.Random(4), toxicity.ToxicityModel({toxicity.fold(t): 1.0 for t in toxicity.SEED_TERMS}, {toxicity.fold(t) for t in toxicity.SEED_EXCEPTIONS})
    pieces = [*toxicity.SEED_TERMS, *toxicity.SEED_EXCEPTIONS, "1d10t", "tr@sh", "can", "y" * 60, "é", "x-", "_", "."]
    match = model.matcher()
    for _ in range(300):
        text = "".join(rng.choice(pieces) + rng.choice([" ", " ", "  ", "", "\n"]) for _ in range(rng.randint(0, 25)))
        folded, hits = _naive_hits(model, text)
        assert match(text)[0] == folded and sorted(match(text)[2]) == hits
        want = {f"{w} {t}" for t, a, _ in hits for w in toxicity._WORD.findall(folded[:a])[-1:] if folded[:a].endswith(f"{w} ")}
        want |= {f"{t} {w}" for t, _, b in hits for w in toxicity._WORD.findall(folded[b:])[:1] if folded[b:].startswith(f" {w}")}
        assert toxicity.phrases_around(folded, hits) == want


def test_toxicity_query_against_brute_force(spark):
    import math

    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    model = toxicity.fitted_model(docs, DATA)
    got = {r.doc_id: (r.score, r.predicted) for r in queries.QUERIES["op4_toxicity"](spark, DATA).collect()}
    for r in docs.collect():
        folded, hits = _naive_hits(model, r.text)
        x = sum(model.weights[t] for t, _, _ in hits) / math.sqrt(1 + len(toxicity._WORD.findall(folded)) / model.per_words)
        score = 1 / (1 + math.exp(-(model.bias + model.slope * x)))
        assert got[r.doc_id] == (pytest.approx(score), int(score >= 0.5))


def test_toxicity_held_out_accuracy(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = queries.QUERIES["op4_toxicity"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").toPandas()
    assert len(got) > 40 and (got.predicted == got.toxic).mean() >= 0.9 and got.predicted[got.toxic == 0].mean() <= 0.05


def _longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_license_alignment_against_brute_force():
    rng = random.Random(1)
    words = licenses._WORD.findall(licenses.TEMPLATES["ISC"].lower())
    for _ in range(40):
        cut = [w for w in words if rng.random() > 0.1]
        pairs = licenses.align(cut, words)
        assert all(cut[i] == words[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) >= 0.95 * _longest_common(cut, words)


def test_license_scan(spark):
    isc = licenses.TEMPLATES["ISC"]
    texts = ["x Released under the MIT License. y Released under the MIT License.", "", None, "no licence here", "a " * 30000 + isc.replace("hereby ", "").upper(), "released the MIT code under a new License"]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, start int")
    got = licenses.scan_licenses(df).collect()
    assert [(r.license, r.coverage) for r in got if r.doc_id == 0] == [("MIT-notice", 1.0)] * 2
    assert texts[0][got[0].start : got[0].end] == "Released under the MIT License"
    assert {r.license for r in got if r.doc_id == 4} == {"ISC"} and not [r for r in got if r.doc_id in (1, 2, 3, 5)]
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_license_whole_notices_are_found_behind_their_own_words():
    scanner, rng = licenses.Scanner(), random.Random(7)
    end = "this X a Y the This work is licensed under the GNU General Public License, version 3."
    assert [(m.license, m.matched, end[m.start : m.start + 9]) for m in scanner.scan(end)] == [("GPL-3.0-notice", 12, "This work")]
    for name, words in scanner.templates.items():
        for strays in (["this", "x", "y", "z", "the"], words, [*words, *["x", "y"] * len(words)]):
            for _ in range(15):
                parts = [[rng.choice(strays) for _ in range(rng.randint(0, 2 * len(words)))] for _ in range(3)]
                text = " ".join([*parts[0], *words, *parts[1], *words, *parts[2]])
                got = {m.start for m in scanner.scan(text) if m.license == name and m.matched == len(words)}
                at = len(" ".join([*parts[0], ""])), len(" ".join([*parts[0], *words, *parts[1], ""]))
                assert got.issuperset(at), (name, text)


def test_license_scan_against_all_stretches():
    """Every stretch that holds enough of a template, densely, meets a match; whole notices side by side are found each."""
    rng, template = random.Random(11), "alpha beta gamma delta beta epsilon zeta eta theta iota".split()
    scanner, missed, n = licenses.Scanner({"T": " ".join(template)}), 0, 0
    for _ in range(150):
        words = []
        for _ in range(rng.randint(1, 4)):
            words += [w for w in template if rng.random() > rng.choice([0, 0, 0.1, 0.3])] + rng.choices([*template, "x", "y"], k=rng.choice([0, 0, 3, 15]))
        text = " ".join(words)
        at_word = [len(" ".join(words[:a])) + (a > 0) for a in range(len(words))]
        got = [(m.start, m.end) for m in scanner.scan(text)]
        for a in range(len(words)):
            for b in range(a + 8, min(len(words), a + 12) + 1):
                common = _longest_common(words[a:b], template)
                if common >= 8 and common >= 0.8 * (b - a):
                    n, at = n + 1, (at_word[a], len(" ".join(words[:b])))
                    missed += not any(x < at[1] and at[0] < y for x, y in got)
    assert n > 500 and missed <= 0.01 * n
    for name, own in {**scanner.templates, **licenses.Scanner().templates}.items():
        one, k = licenses.Scanner() if name != "T" else scanner, rng.randint(2, 4)
        for between in ([], ["w"] * 25, rng.choices("license the software this of and".split(), k=25)):
            assert sum(m.matched == len(own) for m in one.scan(" ".join([*own, *between] * k)) if m.license == name) == k, name


def test_license_scan_tells_licenses_apart():
    found = lambda text: {m.license for m in licenses.Scanner().scan(text)}
    gpl, cc = "This work is licensed under the GNU General Public License", "This work is licensed under a Creative Commons Attribution"
    long = licenses.TEMPLATES["GPL-3.0-or-later"]
    for text in (
        "Released under the BSD License.", f"{gpl}, version 2.", f"{gpl}, version 2. All 3 parts", "Licensed under CC BY 4.0.", "Licensed under CC BY-NC-SA 4.0.", "Licensed under the Apache License, Version 1.1.",
        gpl.replace("General", "Lesser General") + ", version 3.", f"{cc}-NonCommercial 4.0 International License.", f"{cc} 3.0 International License.",
        long.replace("version 3", "version 2"), long.replace("General", "Lesser General"),
    ):
        assert not found(text), text
    assert found(f"{cc} 4.0 International License.") == {"CC-BY-4.0"} and found(f"{cc}-ShareAlike 4.0 International License.") == {"CC-BY-SA-4.0"}
    assert found(f"{gpl}, version 2. {gpl}, version 3.") == found(f"{gpl} v3") == {"GPL-3.0-notice"} and found(long.replace("program", "library")) == {"GPL-3.0-or-later"}
    assert found("Licensed under the Apache License, Version 2.") == {"Apache-2.0-notice"} and found("Released under the MIT") == {"MIT-notice"}
    bsd = licenses.TEMPLATES["BSD"].replace("met: ", "met: 1. ").replace("source code", "source code (c) 2024")
    assert found(bsd) == {"BSD"} and all(name in found(text) for name, text in licenses.TEMPLATES.items())


def test_license_query_finds_every_notice(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").toPandas()
    got = {(r.doc_id, r.license) for r in queries.QUERIES["op6_licenses"](spark, DATA).collect()}
    for name in ("MIT-notice", "Apache-2.0-notice", "GPL-3.0-notice", "CC-BY-NC-4.0-notice"):
        assert {i for i, k in got if k == name} == set(docs.doc_id[docs.text.str.contains(licenses.TEMPLATES[name], regex=False)])


@pytest.mark.parametrize("name", ["op1_chat_format", "op9_urls"])
def test_query_equals_oracle(spark, duck, name):
    same_rows(queries.QUERIES[name](spark, DATA), duck.execute(SQL[name]).df())


URLS = [
    (1, "https://A.Example.COM/en/7x?q#f", None), (2, "http://b.example.com/en/5", ""), (3, "x.net/de/8", "h"), (4, None, None), (5, "http://n.example.net/de/81", ""),
    (6, "http://n.example.net/de/7", ""), (7, "http://com?x", ""), (8, "http://wexample.net/de/", ""), (9, "ftp://É.ORG/es/", ""), (9, "ftp://É.ORG/es/", ""),
]


def test_urls_rules_and_parts(spark):
    df = spark.createDataFrame(URLS, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("n", F.lit(0))
    got = {r.page_id: r for r in urls.judge_urls(df).collect()}
    want = {1: ("a.example.com", "/en/7x", "example.com/en/7", "allow"), 2: ("b.example.com", "/en/5", "com/en/", "block"), 3: ("", "", None, "allow"), 4: ("", "", None, "allow"),
            5: ("n.example.net", "/de/81", "example.net/de/8", "block"), 6: ("n.example.net", "/de/7", "net/de/", "allow"), 7: ("com", "", None, "allow"),
            8: ("wexample.net", "/de/", "net/de/", "allow"), 9: ("É.org", "/es/", "org/es/", "block")}
    assert {k: (r.host, r.path, r.rule, r.verdict) for k, r in got.items()} == want
    assert urls.judge_urls(df).count() == len(URLS) and urls.judge_urls(df.limit(0)).count() == 0


def _propagate(seeds, edges, damping, rounds):
    hosts = {h for h, _, _ in seeds} | {h for e in edges for h in e[:2]}
    out = {}
    for kind, at in (("trust", 1), ("distrust", 2)):
        flow = [(a, b, n) if kind == "trust" else (b, a, n) for a, b, n in edges]
        total = {h: sum(n for a, _, n in flow if a == h) for h in hosts}
        seed = {h: 0.0 for h in hosts} | {s[0]: s[at] for s in seeds}
        mass = dict(seed)
        for _ in range(rounds):
            mass = {h: (1 - damping) * seed[h] + damping * (sum(mass[a] * n / total[a] for a, b, n in flow if b == h) + (0 if total[h] else mass[h])) for h in hosts}
        out[kind] = mass
    return {h: (out["trust"][h], out["distrust"][h]) for h in hosts}


def test_urls_propagation_against_brute_force(spark):
    seeds, edges = [("a", 0.6, 0.0), ("b", 0.0, 0.4), ("c", 0.0, 0.0)], [("a", "c", 2), ("c", "b", 1), ("c", "d", 3), ("e", "b", 5)]
    got = {r.host: (r.trust, r.distrust) for r in urls.propagate(spark.createDataFrame(seeds, "host string, trust double, distrust double"), spark.createDataFrame(edges, "src string, dst string, n long"), rounds=6).collect()}
    want = _propagate(seeds, edges, 0.85, 6)
    assert got.keys() == want.keys() and all(got[h] == pytest.approx(want[h]) for h in want)


def test_urls_links_spread_distrust(spark):
    rows = [(i, "http://bad.org/es/x", "") for i in range(5)] + [(9, "http://friend.io/", '<a class=x href="//bad.org/y">a</a><a href=http://bad.org/z>b</a>'), (10, "http://fine.io/", '<a href="/own">x</a>')]
    got = {r.page_id: r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), threshold=0.3).collect()}
    assert got[9].distrust > 0 and got[9].verdict == "block" and got[10].verdict == "allow"


def test_urls_propagation_goes_on_until_settled(spark):
    hosts = [f"h{i:02}" for i in range(23)]
    seeds, edges = [(hosts[0], 0.9, 0.0), (hosts[-1], 0.0, 0.1)], [(a, b, 1) for a, b in zip(hosts, hosts[1:])]
    edges += [("x", "y", 1), ("y", "x", 1)]
    seeds.append(("x", 0.5, 0.0))
    frames = spark.createDataFrame(seeds, "host string, trust double, distrust double"), spark.createDataFrame(edges, "src string, dst string, n long")
    got = {r.host: (r.trust, r.distrust) for r in urls.propagate(*frames, tolerance=1e-4).collect()}
    want = _propagate(seeds, edges, 0.85, 400)
    assert got.keys() == want.keys() and all(got[h] == pytest.approx(want[h], abs=1e-4) for h in want)
    assert got[hosts[20]][0] > 0 and got["x"][0] == pytest.approx(0.5 / 1.85, abs=1e-4)
    with pytest.raises(RuntimeError, match="not settled after 2 rounds"):
        urls.propagate(*frames, guard=2)


PAGE = """<html><head><title>no</title><style>x</style></head><body><header><p>Site name</p></header><nav><ul><li><a href=/a>Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies.</div><article><h1>The  title &amp; more</h1><p>First <b>bold</b>
 text&nbsp;here.<p>Second &lt;p&gt; paragraph, with more words in it.<script>var a = "</p>";</script><div class="ad">Buy now</div><ul><li>one point made<li>two points made</ul></article>
<aside>Related things</aside><form><label>Mail</label><button>Go</button></form><section class="comments"><p>A reader said this.</p></section><footer>&copy; x</footer>"""


def test_html_article_text():
    assert html_extract.extract(PAGE, html_extract.default_model()) == "The title & more\nFirst bold text here.\nSecond <p> paragraph, with more words in it.\none point made\ntwo points made"


SAID = ["The council met on Tuesday to discuss the new bridge.", "It will cost ninety million and open in four years, said the mayor of the town.", "Critics doubt that figure.", "Work begins in May."]
LONG = "The council met on Tuesday evening to discuss the new bridge over the river, which is to cost ninety million and open in May."
LINKS = '<div><a href="/a">Home</a> <a href="/b">News</a> <a href="/c">Sports today</a></div>'
SIMPLE = {
    "one paragraph": (f"<html><body><article><p>{LONG}</p></article></body></html>", [LONG]),
    "divs beside a link box": (f"<html><body>{LINKS}<div>{''.join(f'<div>{x}</div>' for x in [LONG, LONG, *SAID[:2]])}</div></body></html>", [LONG, LONG, *SAID[:2]]),
    "divs of the body": (f"<html><body>{LINKS}{''.join(f'<div>{x}</div>' for x in [LONG, LONG, *SAID[:2]])}</body></html>", [LONG, LONG, *SAID[:2]]),
    "hidden paragraph": (f"<article><h1>New bridge</h1><p>{SAID[0]}</p><p hidden>Not shown at all.</p><p>{SAID[2]}</p></article>", ["New bridge", SAID[0], SAID[2]]),
    "hidden in line": ('<article><p>The bridge <span aria-hidden="true">XX</span>opens in the month of <span style="display: none">no</span>May.</p></article>', ["The bridge opens in the month of May."]),
    "attributes that hide nothing": (f'<article><p data-hidden="1" title="the hidden truth" data-class="nav">{SAID[0]}</p></article>', [SAID[0]]),
    "no body": (f"<p>{SAID[0]}</p><p>{SAID[1]}</p>", SAID[:2]),
    "no tags": (LONG, [LONG]),
    "deep divs": (f"<div><div><div><h2>Bridge</h2><div><div>{SAID[0]}</div><div>{SAID[1]}</div></div></div></div><div><ul><li><a href=/x>One more</a></li><li><a href=/y>Two more</a></li></ul></div></div>", ["Bridge", *SAID[:2]]),
    "main and frame": (f"<header><a href=/>Site</a></header><main><h1>Bridge</h1><p>{SAID[3]}</p></main><footer>(c) 2020 Site</footer>", ["Bridge", SAID[3]]),
    "header of the article": (f"<article><header><h1>Bridge news</h1></header><p>{SAID[0]} {SAID[1]}</p><footer><a href=/s>Share</a></footer></article>", ["Bridge news", f"{SAID[0]} {SAID[1]}"]),
    "comments as articles": (f'<nav><a href=/>Home</a></nav><div id=content><h1>Bridge</h1><p>{SAID[0]}</p></div><div class="comments"><h3>Comments</h3><article><p>I think this is a great idea.</p></article></div><footer><p>Copyright 2020.</p></footer>', ["Bridge", SAID[0]]),
    "table layout": (f"<table><tr><td><a href=/1>Home</a><br><a href=/2>Shop</a></td><td><h1>Bridge</h1><p>{SAID[0]}</p><p>{SAID[1]}</p></td></tr></table>", ["Bridge", *SAID[:2]]),
    "notice and side": (f'<div class="cookie-banner"><p>We use cookies to improve our site.</p></div><article><p>{SAID[0]}</p></article><aside><p>Read this other story of ours today.</p></aside>', [SAID[0]]),
    "script in a paragraph": ("<article><p>Hello there my <script>var x</script> friend, this is a test of it.</p></article>", ["Hello there my friend, this is a test of it."]),
    "list": ("<article><h1>Steps</h1><ol><li>Open it.</li><li>Close it.</li></ol></article>", ["Steps", "Open it.", "Close it."]),
    "menu only": ("<nav><ul><li><a href=/>Home</a></li></ul></nav>", []),
    "names that say nothing": (f'<div class="zq"><a href=/1>Alpha</a><a href=/2>Beta</a></div><div class="kk"><h1>Bridge</h1>{"".join(f"<p>{x}</p>" for x in SAID)}</div><div class="pp">&copy; 2021 Alpha Media. All rights reserved.</div>', ["Bridge", *SAID]),
    "section and form": (f"<section><h2>Bridge</h2><p>{SAID[0]}</p></section><form><label>Search</label><input><button>Go</button></form>", ["Bridge", SAID[0]]),
}


A, B = f'<a href="/a">{SAID[1]}</a>', f'<a href="/b">{SAID[0]}</a>'
#: What belongs to an article though it is linked, and what does not though it stands in it.
SIMPLE |= {
    "comments in the article": (f'<article><h1>Bridge</h1><p>{SAID[0]}</p><div class="comments"><p>I think this is a great idea for all of us.</p></div></article>', ["Bridge", SAID[0]]),
    "three comments in the article": (f'<article><h1>Bridge</h1><p>{SAID[0]}</p><p>{SAID[1]}</p><div class="comments"><p>I think this is great.</p><p>No, it is far too expensive for us.</p><p>Why not a ferry?</p></div></article>', ["Bridge", *SAID[:2]]),
    "list of comments in the article": (f'<article><h1>Bridge</h1><p>{SAID[0]}</p><ul id="comments"><li>I think this is a great idea.</li><li>No, it is too expensive.</li></ul></article>', ["Bridge", SAID[0]]),
    "section of comments in the article": (f'<article><h1>Bridge</h1><p>{SAID[0]}</p><section class="comments"><h3>Comments</h3><p>I think this is a great idea.</p></section></article><footer>&copy; x</footer>', ["Bridge", SAID[0]]),
    "footer in the article": (f"<article><h1>Bridge</h1><p>{SAID[0]}</p><p>{SAID[1]}</p><footer>Posted by Ann Smith. Share this.</footer></article>", ["Bridge", *SAID[:2]]),
    "footer in the article of a page": (f"<nav><a href=/>Home</a></nav><article><h1>Bridge</h1><p>{SAID[0]}</p><footer><p>Posted by Ann Smith.</p></footer></article><footer>&copy; 2020 x</footer>", ["Bridge", SAID[0]]),
    "one linked sentence": (f"<article><h1>Note</h1><p>{A}</p></article>", ["Note", SAID[1]]),
    "paragraph of two links": (f"<article><h1>Note</h1><p>{A} {B}</p></article>", ["Note", f"{SAID[1]} {SAID[0]}"]),
    "links and a list of links": (f"<article><h1>Note</h1><p>{A} {B}</p><ul><li>{A}</li><li>{B}</li></ul></article>", ["Note", f"{SAID[1]} {SAID[0]}", SAID[1], SAID[0]]),
    "reading list": (f"<nav><a href=/>Home</a></nav><article><h1>Books on bridges</h1><p>{SAID[0]}</p><ul><li><a href=/1>The great bridges</a></li><li><a href=/2>On arches</a></li><li><a href=/3>Rivers</a></li></ul></article>", ["Books on bridges", SAID[0], "The great bridges", "On arches", "Rivers"]),
    "a lead and its list": (f"<article><h1>Bridge</h1><p>{SAID[0]}</p><p>Read more</p><ul><li><a href=/1>The great bridges</a></li><li><a href=/2>On arches</a></li></ul></article>", ["Bridge", SAID[0], "Read more", "The great bridges", "On arches"]),
    "related box in the article": (f'<article><h1>Bridge</h1><p>{SAID[0]}</p><div class="related"><p>Read more</p><ul><li><a href=/1>The great bridges</a></li><li><a href=/2>On arches</a></li></ul></div></article>', ["Bridge", SAID[0]]),
    "cues of the whole page": (f'<body class="has-sidebar cookie-ok"><article><h1>Bridge</h1><p>{SAID[0]}</p></article></body>', ["Bridge", SAID[0]]),
}


@pytest.mark.parametrize("name", SIMPLE)
def test_html_simple_pages(name):
    page, want = SIMPLE[name]
    assert html_extract.extract(page, html_extract.default_model()).split("\n") == (want or [""])


def _unlike_pages(count, seed):
    """Pages with their main text, of real words and without any of the cue words the model knows; parts may be hidden."""
    rng = random.Random(seed)
    lexicon = "river bridge council engine market paper winter garden number morning window doctor season letter summer village silver copper report teacher".split()
    sentence = lambda: (" ".join(rng.choices(lexicon, k=rng.randint(5, 16))).capitalize() + rng.choice("..?!"))
    label = lambda: " ".join(rng.choices(lexicon, k=rng.randint(1, 2))).title()
    name = lambda: rng.choice(["", ' class="q7"', ' id="z1"', ' class="col wide"'])
    for _ in range(count):
        said = [" ".join(sentence() for _ in range(rng.choice([1, 1, 2, 4]))) for _ in range(rng.randint(1, 6))]
        title, tag, wrap = label(), rng.choice(["p", "p", "div"]), rng.choice(["article", "main", "div", "section"])
        story = f"<{wrap}{name()}><h1>{title}</h1>" + "".join(f"<{tag}>{x}</{tag}>" + rng.choice(["", "", "", "<p hidden>Unseen words of it.</p>"]) for x in said) + f"</{wrap}>"
        links = lambda: "".join(f'<li><a href="/{i}">{label()}</a></li>' for i in range(rng.randint(2, 8)))
        head = rng.choice(["", f"<nav><ul>{links()}</ul></nav>", f"<div{name()}><ul>{links()}</ul></div>", f"<header><a href=/>{label()}</a></header>"])
        tail = rng.choice(["", f"<footer>&copy; 2024 {label()}</footer>", f"<footer><a href=/t>{label()}</a> | <a href=/p>{label()}</a></footer>", f"<aside><h3>{label()}</h3><ul>{links()}</ul></aside>"])
        yield f"<html><body>{head}{story}{tail}</body></html>", "\n".join([title, *said])


def test_html_text_of_unlike_pages():
    pages = list(_unlike_pages(300, 9))
    assert sum(html_extract.extract(page, html_extract.default_model()) == want for page, want in pages) >= 0.95 * len(pages)


def _rich_pages(count, seed):
    """Articles with linked sentences and lists, footers and comments of their own, in real words, with their main text."""
    rng = random.Random(seed)
    lexicon = "river bridge council engine market paper winter garden number morning window doctor season letter summer village silver copper report teacher".split()
    sentence = lambda: " ".join(rng.choices(lexicon, k=rng.randint(5, 14))).capitalize() + "."
    label = lambda: " ".join(rng.choices(lexicon, k=rng.randint(1, 3))).capitalize()
    for _ in range(count):
        parts, said = [], []
        for _ in range(rng.randint(1, 5)):
            kind = rng.choice(["p", "p", "p", "linked", "list", "points"])
            if kind in ("p", "linked"):
                said.append(sentence())
                parts.append(f"<p>{said[-1]}</p>" if kind == "p" else f'<p><a href="/x">{said[-1]}</a></p>')
            else:
                items = [label() if kind == "list" else sentence() for _ in range(rng.randint(2, 5))]
                said += items
                parts.append("<ul>" + "".join(f'<li><a href="/y">{x}</a></li>' if kind == "list" else f"<li>{x}</li>" for x in items) + "</ul>")
        title, first = label(), sentence()
        footer = rng.choice(["", f"<footer>Posted by {label()}. Share this.</footer>", f"<footer><p>{sentence()}</p></footer>"])
        box, item = rng.choice([("div", "p"), ("section", "p"), ("ul", "li"), ("ol", "li"), ("div", "div")])
        comments = rng.choice(["", f'<{box} {rng.choice(["class", "id"])}="{rng.choice(["comments", "replies", "discussion"])}">' + "".join(f"<{item}>{sentence()}</{item}>" for _ in range(rng.randint(1, 4))) + f"</{box}>"])
        wrap = rng.choice(["article", "main"])
        nav = rng.choice(["", f'<nav><ul><li><a href="/">{label()}</a></li><li><a href="/n">{label()}</a></li></ul></nav>'])
        yield f"<html><body>{nav}<{wrap}><h1>{title}</h1><p>{first}</p>{''.join(parts)}{footer}{comments}</{wrap}><footer>&copy; 2024 {label()}</footer></body></html>", "\n".join([title, first, *said])


def test_html_articles_with_links_footers_and_comments():
    pages = list(_rich_pages(300, 4))
    assert sum(html_extract.extract(page, html_extract.default_model()) == want for page, want in pages) >= 0.95 * len(pages)


def test_html_query_returns_the_articles_of_the_table(spark):
    """Pages of the table hold one article each: its runs of text, whole, and nothing else."""
    html = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = {r.page_id: (r.text, r.n_chars) for r in queries.QUERIES["op10_extract"](spark, DATA).collect()}
    want = {i: "\n".join(n.text for n in html_extract.parse(h) if n.text is not None and n.inside) for i, h in html.items()}
    assert got == {i: (t, len(t)) for i, t in want.items()}


def test_html_formulas_drawings_and_fallbacks_are_text():
    page = lambda body: f"<html><body><nav><a href=/a>Home</a></nav><article><p>Some words stand before all of this text.</p>{body}<p>Some words stand behind all of it.</p></article></body>"
    said = lambda body: html_extract.extract(page(body), html_extract.default_model()).split("\n")[1:-1]
    math = '<math><semantics><mrow><mi>E</mi><mspace width="1em"/><mo>=</mo><msup><mi>m</mi><mn>2</mn></msup></mrow><annotation>E=m^2</annotation></semantics></math>'
    assert said(f"<p>We know that {math} holds for all of the given values.</p>") == ["We know that E=m2 holds for all of the given values."]
    assert said(f'<p>We know <span class="katex"><span class="katex-mathml">{math}</span><span class="katex-html" aria-hidden="true">E=m2</span></span> to hold here.</p>') == ["We know E=m2 to hold here."]
    svg = '<svg><title>no</title><style>.a{}</style><path d="M0"/><g><text>inner</text><text>outer <tspan>wall</tspan></text></g></svg>'
    assert said(f"<p>The drawing {svg} shows the parts of the house.</p>") == ["The drawing inner outer wall shows the parts of the house."]
    assert [n.text for n in html_extract.parse("<desc>a tag unknown here</desc>") if n.text] == ["a tag unknown here"]
    assert said('<p>First part of it.</p><object data="x.pdf"><param name=a><p>The report says that sales rose in this year.</p></object>') == ["First part of it.", "The report says that sales rose in this year."]


def test_html_edge_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article><p>" + "Some words. " * 20000 + "</article>"), (4, "u", "<p"), (4, "u", "a < b"), (5, "u", "<nav><a href=x>y</a></nav>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_extract.extract_pages(df).collect()
    assert len(got) == 6 and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got][:2] == ["", ""] and got[2].n_chars == 12 * 20000 - 1 and got[5].text == ""
    assert html_extract.extract_pages(df.limit(0)).count() == 0


def test_html_marginals_against_enumeration():
    import itertools
    import math

    nodes = html_extract.parse("<div><p>a b c.</p><ul><li><a href=x>z</a></ul></div>")
    unary, coupling = html_extract.default_model()
    own = [sum(unary[k] * v for k, v in html_extract._features(n).items()) for n in nodes]
    at = {id(n): i for i, n in enumerate(nodes)}
    total, on = 0.0, [0.0] * len(nodes)
    for s in itertools.product((-1, 1), repeat=len(nodes)):
        e = sum(z * x for z, x in zip(own, s)) + sum(coupling[html_extract._kind(n)] * s[i] * s[at[id(n.parent)]] for i, n in enumerate(nodes) if n.parent is not None)
        w = math.exp(e / 2)
        total += w
        on = [o + w * (x > 0) for o, x in zip(on, s)]
    assert html_extract.marginals(nodes, unary, coupling) == pytest.approx([o / total for o in on], abs=1e-9)


def test_html_held_out_accuracy():
    model, right, n = html_extract.default_model(), 0, 0
    for page in html_extract.labelled_pages(60, seed=101):
        nodes = html_extract.parse(page)
        for node, p in zip(nodes, html_extract.marginals(nodes, *model)):
            if node.text is not None and node.truth is not None:
                n, right = n + 1, right + ((p >= 0.5) == node.truth)
    assert n > 500 and right / n >= 0.97
