from __future__ import annotations

import datetime as dt
import xml.etree.ElementTree as ET

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dealmill.functions import finance, text
from dealmill.functions.phases import highest_phase
from dealmill.operators.filters import Dates, Money
from dealmill.operators.paths import distances, shortest_paths
from dealmill.operators.topk import Cursor, after, ordered
from dealmill.sources import readers, sinks


def told(spark, texts, *columns):
    """One tuple a text, in order."""
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return [tuple(r) for r in finance.finance_details(df, "id", "text").orderBy("id").select(*columns).collect()]


def test_amounts_and_rates(spark):
    sums = ["$25 million", "EUR 1.5 billion", "GBP 2,500,000", "€1.2bn", "$30M", "12 million", "¥5k"]
    row = spark.range(1).select(*[F.struct(finance.millions(F.lit(x)), finance.currency(F.lit(x))) for x in sums]).first()
    assert [tuple(x) for x in row] == [(25.0, "USD"), (1500.0, "EUR"), (2.5, "GBP"), (1200.0, "EUR"), (30.0, "USD"), (12.0, "USD"), (0.005, "JPY")]
    texts = ["royalties of 5% to 12% of net sales", "an 8% royalty", "8% of staff", "3 % on net sales, 9%", "4% – 6%, later 7% to 9%", "between 3% and more, 12% - 15% later", None, ""]
    assert told(spark, texts, "rate_low", "rate_high") == [(5.0, 12.0), (8.0, 8.0), (None, None), (3.0, 3.0), (4.0, 6.0), (12.0, 15.0), (None, None), (None, None)]


def test_prose_details(spark):
    whole = "Upfront payment of $50 million, €1.2 billion in clinical milestones, regulatory milestones of up to $30M, tiered royalties of 5% to 12%, total value of approximately $2 billion."
    columns = [c for k in finance.AMOUNTS for c in (k, f"{k}_currency")] + ["rate_low", "rate_high", "undisclosed"]
    assert told(spark, [whole], *columns) == [(50.0, "USD", 1200.0, "EUR", 30.0, "USD", None, None, 2000.0, "USD", 5.0, 12.0, False)]
    texts = [
        "$20 million in milestones", "$20 million in development and commercial milestones", "$5 million upfront and $9 million in sales milestones", "an up-front fee of $5 million and regulatory milestones of $9 million",
        "for the clinical development of a drug it paid $5 million", "in 2019 with 12 people", "an initial payment of $1,300,000",
    ]
    none = (None, None, None, None)
    assert told(spark, texts, "upfront", "development", "regulatory", "commercial") == [(None, 20.0, None, None), (None, 20.0, None, None), (5.0, None, None, 9.0), (5.0, None, 9.0, None), none, none, (1.3, None, None, None)]
    untold = ["No financial terms disclosed; $5 million upfront", "terms were not disclosed", "Undisclosed financial terms, $3M upfront"]
    assert told(spark, untold, "upfront", "undisclosed") == [(None, True)] * 3


def test_payload_terms(spark):
    """Rows of the literal payloads: nested breakdowns, accuracy marks, money labelled as a percentage, thousands and trillions."""
    from dealmill.plans.ingest import PAYLOADS

    deep = '{"PaymentsToPartner":{"PaymentsPaid":{"PaymentsGeneral":{"Payment":{"Type":"Dev/Reg Milestones","PaymentBreakdown":{"Payment":{"Type":"Equity Purchase!","PaymentBreakdown":{"Payment":[{"Type":"Royalty"}, 7, {}]}}}}}}}}'
    odd = [None, "", "no json", "[]", '{"PaymentsToPrincipal": {"PaymentsPaid": null}}', '{"PaymentsToPrincipal": {"PaymentsPaid": {"PaymentsGeneral": {"Payment": "text"}}}}']
    df = spark.createDataFrame(list(enumerate([*[p for p, _ in PAYLOADS], deep, *odd])), "id long, payload string")
    rows = [r.asDict() for r in finance.explode_terms(df, "id", "payload").orderBy("id", "path").collect()]
    got = lambda k: [(r["term"], r["amount"], r["amount_usd"], r["rate_low"], r["rate_high"], r["confidence"], r["breakdown"]) for r in rows if r["id"] == k]
    for k, (_, want) in enumerate(PAYLOADS):
        assert got(k) == list(want)
    assert [r["path"] for r in rows if r["id"] == 0] == ["PaymentsToPrincipal.PaymentsPaid.PaymentsGeneral.Payment[0]", "PaymentsToPrincipal.PaymentsPaid.PaymentsGeneral.Payment[0].PaymentBreakdown.Payment[0]"]
    assert [r["term"] for r in rows if r["id"] == 3] == ["development_regulatory_milestone", "equity_purchase", "royalty_payment", "unspecified"] and max(r["id"] for r in rows) == 3


def test_clauses(spark):
    contract = "<para>The upfront payment is $20 million.</para><para>Royalties are 4% to 8% of net sales, tiered.</para><para>Interest of 9% applies.</para>"
    far = "The upfront fee is due.\n\nArticle 2 Payments\n\nIt is EUR 3 million."
    paid = "A milestone of $7 million is due. It is to reimburse costs of $99 million.\n\nMore of it: 5 million."
    df = spark.createDataFrame(list(enumerate([contract, "A royalty is due, the rate is redacted.", far, paid, None, ""])), "id long, text string")
    rows = finance.explode_clauses(df, "id", "text").collect()
    found = {(r.id, r.kind): r for r in rows}
    assert len(rows) == 3 and set(found) == {(0, "upfront"), (0, "royalty"), (3, "milestone")}
    assert found[0, "upfront"].amount == 20.0 and found[3, "milestone"].amount == 7.0 and found[3, "milestone"].currency == "USD"
    assert (found[0, "royalty"].rate_low, found[0, "royalty"].rate_high, found[0, "royalty"].tiered) == (4.0, 8.0, True)


def test_contract_titles(spark):
    from dealmill.sources.html import clean_contracts, plain_text

    raw = '7. GRANT OF RIGHTS, "OTHER"<br>7.1  Grant of&nbsp;Rights<br/>8. Not Shouted<br>9. 2020<para>A &lt;b</para>- 12 -<br><br><br><br>end'
    df = spark.createDataFrame([(1, raw), (2, None), (3, "<p>a<script>x</script></p><p>b &amp; c</p><footer>left out")], "id long, t string")
    assert {r.id: r.c for r in clean_contracts(df.where("id < 3"), "t", "c").collect()} == {1: '## 7. GRANT OF RIGHTS, "OTHER"\n### 7.1 Grant of Rights\n8. Not Shouted\n9. 2020\n\nA <b\n\nend', 2: ""}
    assert {r.id: r.content for r in plain_text(df.where("id > 1"), "id", "t").collect()} == {2: "", 3: "a b & c"}


def test_text_expressions(spark):
    row = spark.range(1).select(
        text.company_key(F.lit("Acme Holdings, Inc.")).alias("name"), text.filer_id(F.lit("CIK 320193")).alias("cik"), text.domain_name(F.lit("https://www.Example.com:8080/a?b")).alias("host"),
        text.trigram_similarity(F.lit("word"), F.lit("word")).alias("same"), text.trigram_similarity(F.lit(""), F.lit("a")).alias("none"),
        text.canonical_date(F.lit("2020-05")).alias("day"), text.canonical_date(F.lit("soon")).alias("no_day"),
        (text.sql_fingerprint(F.lit("select 1 -- x")) == text.sql_fingerprint(F.lit("SELECT  22"))).alias("equal"),
    ).first()
    assert row.name == "acme" and row.cik == "0000320193" and row.host == "example.com"
    assert row.same == 1.0 and row.none == 0.0 and row.day == dt.date(2020, 5, 1) and row.no_day is None and row.equal


def test_phases(spark):
    df = spark.createDataFrame([(1, "Phase 2"), (1, "Launched"), (1, "Discontinued"), (2, "Discontinued"), (2, "odd")], "id int, p string")
    assert {r.id: r.h for r in df.groupBy("id").agg(highest_phase(F.col("p")).alias("h")).collect()} == {1: "Launched", 2: "Discontinued"}


def test_phases_go_by_id_then_name_and_the_last_of_equal_ranks(spark):
    rows = [(1, "odd", "C3"), (1, "Phase 2 Clinical", None), (2, "Suspended", None), (2, "withdrawn", "W"), (3, "", "L"), (4, "NDR?", "ndr")]
    got = spark.createDataFrame(rows, "id int, p string, c string").groupBy("id").agg(highest_phase(F.col("p"), F.col("c")).alias("h"))
    assert {r.id: r.h for r in got.collect()} == {1: "odd", 2: "withdrawn", 3: None, 4: "NDR?"}


def test_filters(spark):
    df = spark.createDataFrame([(1, 2.0, "Billion", "USD"), (2, 500.0, "Million", "EUR"), (3, None, "Million", "USD")], "id int, a double, u string, c string")
    ids = lambda m: [r.id for r in df.where(m.on(F.col("a"), F.col("u"), F.col("c"))).orderBy("id").collect()]
    assert ids(Money(gte=1000)) == [1] and ids(Money(gte=1000, missing="include_as_unknown")) == [1, 2, 3] and ids(Money(missing="require_known")) == [1]
    with pytest.raises(ValueError):
        Dates(dt.date(2020, 1, 2), dt.date(2020, 1, 1))


def test_cursor_pages_make_the_whole(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else float(i % 3)) for i in range(23)], "id int, v double").cache()
    keys, seen, place = [("v", False)], [], None
    while True:
        rows = (df.where(after(keys, place[0], "id", place[1])) if place else df).orderBy(*ordered(keys, "id")).limit(4).collect()
        if not rows:
            break
        seen += [r.id for r in rows]
        place = Cursor.decode(Cursor.encode("q", [rows[-1].v], rows[-1].id), "q")
    assert seen == [r.id for r in df.orderBy(*ordered(keys, "id")).collect()]
    with pytest.raises(ValueError):
        Cursor.decode(Cursor.encode("q", [], 1), "other")


def test_paths(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d"), ("d", "c"), ("c", "e")], "src string, dst string")
    assert {r.id: r.hops for r in distances(edges, ["a"], 2).collect()} == {"a": 0, "b": 1, "d": 1, "c": 2}
    assert [r.path for r in shortest_paths(edges, "a", "e", 4).collect()] == [["a", "b", "c", "e"], ["a", "d", "c", "e"]]


def test_read_only_guard(spark):
    from dealmill.operators.guard import is_read_only, keeps_ids, run_read_only

    for good in ("select 1", "WITH a AS (SELECT 'drop table x' AS t) SELECT * FROM a", "SELECT 1 UNION SELECT 2"):
        assert is_read_only(spark, good), good
    for bad in ("DROP TABLE x", "INSERT INTO t VALUES (1)", "CREATE TABLE t AS SELECT 1", "SELECT 1; DELETE FROM t", "SET a=1", "no sql"):
        assert not is_read_only(spark, bad), bad
    assert run_read_only(spark, "SELECT 1 AS x").first().x == 1
    assert keeps_ids("WHERE id IN (12, 7)", [12, 7]) and not keeps_ids("WHERE id = 127", [12])


def test_request_is_checked():
    from dealmill.plans.advanced import DealRequest, next_cursor

    for wrong in ({"sort": "name"}, {"limit": 0}, {"company_ids": (1,), "company_name": "x"}, {"sort": "value", "value": Money(currencies=("USD", "EUR"))}):
        with pytest.raises(ValueError):
            DealRequest(**wrong)
    cursor = next_cursor(DealRequest(sort="value"), {"deal_id": 3, "total_value": None})
    with pytest.raises(ValueError):
        Cursor.decode(cursor, DealRequest(sort="value", limit=5).digest())


def test_upsert_keeps_the_newest(spark, tmp_path):
    from dealmill.streaming.operators import upsert_batches

    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([(1, "a", 1), (2, "b", 1)], [(1, "c", 2), (3, "d", 1), (2, "late", 0)]):
        spark.createDataFrame(rows, "id long, v string, n long").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id long, v string, n long").parquet(source)
        upsert_batches(stream, target, "id", "n").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert {(r.id, r.v) for r in spark.read.parquet(f"{target}/gen=1").collect()} == {(1, "c"), (2, "b"), (3, "d")}


def test_readers(spark, tmp_path):
    (tmp_path / "idx.txt").write_text("CIK|Company|Form|Date|File\n----\n320193|ACME|8-K|2020-01-05|edgar/1.txt\n")
    assert [(r.cik, r.filed) for r in readers.read_master_index(spark, str(tmp_path / "idx.txt")).collect()] == [("320193", dt.date(2020, 1, 5))]
    sub = spark.createDataFrame([(1, "<DOCUMENT>\n<TYPE>8-K\n<FILENAME>a.htm\n<TEXT>one</TEXT></DOCUMENT><DOCUMENT><TYPE>EX-10\n<TEXT>two</DOCUMENT>")], "id long, t string")
    assert [(r.type, r.filename, r.content) for r in readers.submission_documents(sub, "id", "t").orderBy("position").collect()] == [("8-K", "a.htm", "one"), ("EX-10", None, "two")]
    items = spark.createDataFrame([(1, "head\nItem 1.01 Entry\nx\nItem 9.01 Exhibits\ny"), (2, "plain")], "id long, t string")
    assert [(r.id, r.item) for r in readers.item_sections(items, "id", "t").orderBy("id", "position").collect()] == [(1, None), (1, "1.01"), (1, "9.01"), (2, None)]
    assert readers.element_dict(ET.fromstring('<d a="1"><x>2</x><x>3</x><y>t</y></d>')) == {"@attributes": {"a": "1"}, "x": ["2", "3"], "y": "t"}
    cited = readers.trial_citations(spark.createDataFrame([(1, "see NCT01234567 and NCT7")], "id long, t string"), "id", "t").collect()
    assert [(c.nct_id, c.start) for c in cited] == [("NCT01234567", 4)]
    raw = spark.createDataFrame([("s", "1", "body"), ("s", "1", "body"), ("s", "2", "b")], "source string, id string, body string")
    for _ in range(2):
        readers.append_archive(raw, str(tmp_path / "archive"))
    assert spark.read.parquet(str(tmp_path / "archive")).count() == 2
    (tmp_path / "r.xml").write_text("<all><Deal id='1'><T>x</T></Deal><Deal id='2'/></all>")
    got = readers.read_xml(spark, str(tmp_path / "r.xml"), "Deal", "_id string, T string")
    assert sorted((r._id, r.T) for r in got.collect()) == [("1", "x"), ("2", None)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, dt.date(2024, 2, 28), "a, b; c", ["x", "y"])], "id int, day date, name string, tags array<string>")
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().tags == "x; y"
    event = sinks.calendar_events(df, "id", "day", "name", "name").first().event
    assert "DTEND;VALUE=DATE:20240229" in event and r"SUMMARY:a\, b\; c" in event
    assert sinks.calendar_text([event], "t").endswith("END:VCALENDAR\r\n")


@given(st.text(max_size=300).filter(lambda t: not {"\r", "\n"} & set(t)))
def test_folded_lines_are_short_and_whole(line):
    folded = sinks.fold_line(line).split("\r\n")
    assert all(len(x.encode()) <= 75 for x in folded)
    assert folded[0] + "".join(x[1:] for x in folded[1:]) == line


def test_quantiles_of_skewed_groups(spark):
    from dealmill.operators.quantiles import quantiles

    rows = [("hot", float(i * 7 % 1000)) for i in range(1000)] + [("one", 3.0), ("two", 1.0), ("two", 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    got = {r.k: (r.a, r.b) for r in quantiles(df, ["k"], "v", {"a": 0.25, "b": 0.5}).collect()}
    assert got == {"hot": (249.75, 499.5), "one": (3.0, 3.0), "two": (1.25, 1.5)}


def test_text_index_is_stored_once(spark, tmp_path):
    from dealmill.operators.text_index import TextIndex

    path = str(tmp_path / "docs")
    df = spark.createDataFrame([(1, "Red red fish", "a"), (2, "blue fish", "a"), (3, None, "b"), (4, "", "b")], "doc_id long, text string, source string")
    df.write.parquet(path)
    index = TextIndex.of(spark.read.parquet(path), path, columns=("source",))
    again = TextIndex.of(spark.read.parquet(path), path, columns=("source",))
    assert index.postings.inputFiles() == again.postings.inputFiles() and index.n == 4
    ids = lambda **k: sorted(r.doc_id for r in index.search(**k).collect())
    assert ids(terms=("fish",)) == [1, 2] and ids(terms=("fish", "red")) == [1] and ids(terms=("blue", "red"), every=False) == [1, 2]
    assert ids(terms=("fish",), without=("blue",)) == [1] and ids(terms=("fish",), where=F.col("source") == "b") == []
    df.write.mode("append").parquet(path)
    assert TextIndex.of(spark.read.parquet(path), path, columns=("source",)).n == 8


def test_text_index_is_named_by_all_it_depends_on(spark, tmp_path):
    from dealmill.operators.text_index import TextIndex, Words

    path = str(tmp_path / "docs")
    rows = [(k, f"word{k} fish", f"s{k % 3}", f"l{k % 2}", "other text") for k in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, note string").write.parquet(path)
    docs = spark.read.parquet(path)
    by_lang, by_source = TextIndex.of(docs, path, columns=("lang",)), TextIndex.of(docs, path, columns=("source",))
    assert by_lang.documents.where("lang IS NULL").count() == 0 and by_source.documents.where("source IS NULL").count() == 0
    part = TextIndex.of(docs.where("doc_id < 5"), path, columns=("lang",))
    assert part.n == 5 and part.search(("fish",)).count() == 5 and TextIndex.of(docs.where("doc_id < 6"), path, columns=("lang",)).n == 6
    assert TextIndex.of(docs, path, text="note").search(("other",)).count() == 12
    assert TextIndex.of(docs, path, words=Words(english=True)).postings.inputFiles() != TextIndex.of(docs, path).postings.inputFiles()
    assert TextIndex.of(docs, path, columns=("lang",)).postings.inputFiles() == by_lang.postings.inputFiles()
    docs.limit(1).write.mode("append").parquet(path)
    again = TextIndex.of(spark.read.parquet(path), path, columns=("lang",))
    TextIndex.drop_older(spark, path)
    assert again.n == 13 and again.search(("fish",)).count() == 12
    with pytest.raises(Exception, match="(?i)exist"):
        spark.read.parquet(by_lang.postings.inputFiles()[0])


def test_questions_against_brute_force(spark, tmp_path):
    import random
    import re

    from dealmill.operators.text_index import STOP_WORDS, TextIndex, Words, alternatives

    assert alternatives('"a b" c -d or -"e f" OR or') == [[(True, "a b"), (True, "c"), (False, "d")], [(False, "e f")]]
    r = random.Random(3)
    vocabulary = ["red", "fish", "fishes", "cities", "city", "the", "of", "glass", "bus", "x1"]
    texts = [None, ""] + [" ".join(r.choices(vocabulary, k=r.randint(1, 12))) for _ in range(150)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)

    def stem(w):
        if w.endswith("ies") and not w.endswith(("eies", "aies")):
            return w[:-3] + "y"
        if w.endswith("es") and not w.endswith(("aes", "ees", "oes")):
            return w[:-1]
        return w[:-1] if w.endswith("s") and not w.endswith(("us", "ss")) else w

    for english in (False, True):
        cut = lambda t: [(i, stem(w) if english else w) for i, w in enumerate(re.findall(r"\w+", (t or "").lower())) if not english or w not in STOP_WORDS]
        index = TextIndex.of(spark.read.parquet(path), path, words=Words(english))
        for question in ("red", '"red fish"', 'red -"red fish"', '"fish of the city" OR glass -bus', '"city city" OR x1 red bus', '-red', "the", '"the" red', "nowhere OR bus", ""):
            asked = [[(want, cut(part)) for want, part in a] for a in alternatives(question)]
            asked = [[(want, ws) for want, ws in a if ws] for a in asked]

            def holds(text, ws):
                own = set(cut(text))
                return any(all((s - ws[0][0] + i, w) in own for i, w in ws) for s, _ in own)

            want = {i for i, t in enumerate(texts) if any(any(w for w, _ in a) and all(holds(t, ws) == w for w, ws in a) for a in asked)}
            assert {x.doc_id for x in index.ask(question).collect()} == want, (english, question)


def test_snapped_chunks(spark):
    from dealmill.plans.extraction import snapped_chunks

    text = "One two three four. Five six seven\n\neight nine ten eleven twelve"  # 34 of 42 characters: behind 0.7 of the window
    df = spark.createDataFrame([(1, text), (2, "  "), (3, None), (4, " few words ")], "doc_id long, text string")
    got = {(r.doc_id, r.chunk): r.content for r in snapped_chunks(df, 8, 2).collect()}
    assert got == {(1, 0): "One two three four. Five six seven", (1, 1): "seven\n\neight nine ten eleven twelve", (4, 0): " few words "}
    early = spark.createDataFrame([(1, "One two. Three four five six seven eight nine ten")], "doc_id long, text string")
    assert [r.content for r in snapped_chunks(early, 8, 2).orderBy("chunk").collect()] == ["One two. Three four five six seven eight", "seven eight nine ten"]


def test_references_without_a_semicolon_stay(spark):
    from dealmill.sources.html import plain_text

    df = spark.createDataFrame([(1, "<h1>a&amp;&amp;&amp</h1>b &quo c"), (2, "<p>&lt;i&gt; &#233;&#xE9;&semi;&nbsp;&amp;lt; x&ampy; &copy"), (3, "<p>&nowhere; &eacute;")], "id long, t string")
    assert {r.id: r.content for r in plain_text(df, "id", "t").collect()} == {1: "a&&&amp b &quo c", 2: "<i> éé; &lt; x&ampy; &copy", 3: "&nowhere; é"}


def test_each_wording_of_contracts_is_read_once(spark):
    import re

    from conftest import DATA

    from dealmill.plans import QUERIES

    text = QUERIES["contract_clauses"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"HashAggregate\(keys=\[q#\d+, low#\d+, high#\d+\]", text) and text.count("Generate explode([upfront,milestone,royalty])") == 1
    df = spark.createDataFrame([(1, "a", "A signing fee of $20 million is due."), (2, None, "A signing fee of $20 million is due.")], "id long, k string, text string")
    assert {(r.id, r.k, r.kind, r.amount) for r in finance.explode_clauses(df, "id", "text", keep=("k",)).collect()} == {(1, "a", "upfront", 20.0), (2, None, "upfront", 20.0)}


def test_similar_names_equal_all_pairs(spark):
    import random
    import re

    from conftest import DATA

    from dealmill.plans import QUERIES
    from dealmill.plans.companies import similarity_pairs

    r = random.Random(5)
    word = lambda: "".join(r.choice("aabcé") for _ in range(r.randint(1, 7)))
    base = [" ".join(word() for _ in range(r.randint(1, 5))) for _ in range(150)]
    names = lambda: [(i, r.choice([r.choice(base), r.choice(base).upper(), r.choice(base) + word(), word(), "Inc. " + r.choice(base) + " of a long and telling name", None, "", "--"])) for i in range(250)]

    def grams(name):
        words = [w for w in re.split(r"[^a-zé0-9]+", (name or "").lower()) if w]
        return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}

    left, right = names(), names()
    frame = lambda rows: spark.createDataFrame(rows, "id long, name string")
    for threshold in (0.3, 0.5, 0.75):
        want = {}
        for i, a in left:
            for k, b in right:
                x, y = grams(a), grams(b)
                if x | y and len(x & y) / len(x | y) > threshold:
                    want[i, k] = len(x & y) / len(x | y)
        got = similarity_pairs(frame(left), frame(right), threshold).collect()
        assert len(got) == len(want) > 50 and {(x.id_a, x.id_b): x.score for x in got} == pytest.approx(want, abs=6e-5)
    text = QUERIES["fuzzy_name_pairs"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"(?:SortMergeJoin|BroadcastHashJoin).*array_intersect", text)  # names that meet are scored before they are told apart
