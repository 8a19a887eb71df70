import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.operators import chunks as C
from lodestone.operators import facts as X
from lodestone.operators.html import feature_blocks, html_events, links, register_html, sku_variants, spec_rows, spec_violations, validate_spec_items
from lodestone.operators import ordinals
from lodestone.operators.ordinals import with_ordinals
from lodestone.plans.retrieval import build_corpora, build_corpus
from lodestone.queries import ALL

SPEC = """<html><script>var x = "</ul><ul class='spec-item-list'>";</script>
<div class="spec-item-list"><li class="spec-title">No</li></div>
<ul class="x spec-item-list"><li class="spec-title">CPU</li><li class="spec-desc">Intel&nbsp; Core Ultra 9 Processor 275HX<br>24 cores, 24 threads
 up to 5.4 GHz, 36MB cache<p style="FONT-size: 80%">* a note</p><p>see <a href="http://a/b">here</a></p></li></ul>
<ul class="spec-item-list"><li class="spec-desc">no title</li></ul>
<ul class="spec-item-list"><li class="spec-title">old<br>I/O Port</li><li class="spec-desc">Left Side:<br/>1 x HDMI 2.1<br>2 x USB Type-C, Thunderbolt™5<br>RIGHT side: <br>1 x RJ-45<br>odd line</li></ul>
<ul class="spec-item-list"><li class="spec-title">Display</li><li class="spec-desc">16" 16:10 OLED (2560x1600) 240Hz, 1,000,000:1, <a href="u">u</a></li></ul></html>"""


def pages(spark, *html):
    return spark.createDataFrame(list(enumerate(html)), "page_id int, html string")


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_spec_rows(spark):
    got = rows(spec_rows(html_events(pages(spark, SPEC, None, ""))), "page_id", "idx")
    assert got == [
        (0, 0, "CPU", ["Intel Core Ultra 9 Processor 275HX", "24 cores, 24 threads\n up to 5.4 GHz, 36MB cache", "see here (http://a/b)"], ["* a note"]),
        (0, 1, "I/O Port", ["Left Side:", "1 x HDMI 2.1", "2 x USB Type-C, Thunderbolt™5", "RIGHT side:", "1 x RJ-45", "odd line"], []),
        (0, 2, "Display", ['16" 16:10 OLED (2560x1600) 240Hz, 1,000,000:1, u'], []),
    ]


def test_validation(spark):
    items = spec_rows(html_events(pages(spark, SPEC)))
    assert spec_violations(items, 3).count() == 0
    with pytest.raises(ValueError, match="expected 17"):
        validate_spec_items(items)
    with pytest.raises(ValueError, match="OLED"):
        validate_spec_items(items, 3, ("OLED",))


def test_facts(spark):
    items = spec_rows(html_events(pages(spark, SPEC)))
    got = {r.fact_id: r.value for r in X.extract_facts(items, items).collect()}
    assert got == {
        "cpu.model": "Intel Core Ultra 9 Processor 275HX", "cpu.cache": "36MB", "cpu.max_frequency": "5.4 GHz", "cpu.cores": "24 cores", "cpu.threads": "24 threads",
        "display.size": "16 inch", "display.aspect_ratio": "16:10", "display.panel": "OLED", "display.resolution": "2560x1600", "display.refresh_rate": "240Hz", "display.contrast": "1,000,000:1",
        "io.port.0": "1 x HDMI 2.1", "io.port.1": "2 x USB Type-C, Thunderbolt™5", "io.port.2": "1 x RJ-45",
        "io.count.usb_c": "2", "io.count.thunderbolt": "2", "io.count.hdmi": "1",
        "io.side.thunderbolt5": "左側 / Left side", "io.side.hdmi": "左側 / Left side", "io.side.rj45": "右側 / Right side",
    }
    with pytest.raises(ValueError, match="rows"):
        X.extract_facts(items, items.filter("idx > 0"))


def test_ports_without_a_side(spark):
    df = spark.createDataFrame([(0, ["3 x A", "left side: here", "x", "2x B"])], "page_id int, lines array<string>")
    assert rows(X.ports(df), "pos") == [(0, 0, "Unknown", 3, "A"), (0, 1, "Left", 2, "B")]


FEATURE = """<p>outside the container, quite long</p><div class="my-key-features-section"><p>in the root, more than twenty characters</p>
<section id="cool"><h2>Cooling <b>fans</b></h2><p>First paragraph of cooling, long enough.</p><svg><p>drawn</p></svg>
<div class="a section-deep"><h3>Deeper</h3></div><div><p>Second paragraph of cooling, long enough.</p></div><p>after a plain div's end: back in the root</p></section>
<section class="section-x"><p>short</p></section><section><h2>Named by number</h2></section>
</section><p>behind the container, quite long too</p></div>"""


def test_feature_blocks(spark):
    got = rows(feature_blocks(html_events(pages(spark, FEATURE))), "page_id", "ord")
    # The plain div's end closes `cool`, and </section> then the container.
    assert got == [
        (0, 0, "section-deep", ["Deeper"], []),
        (0, 1, "cool", ["Cooling fans"], ["First paragraph of cooling, long enough.", "Second paragraph of cooling, long enough."]),
        (0, 2, "root", [], ["in the root, more than twenty characters", "after a plain div's end: back in the root"]),
    ]


def test_unnamed_sections_are_numbered(spark):
    html = "<div class='key-features'><section><h2>First one</h2></section><section><h2>Second one</h2></section></div>"
    assert [(r.block_id, r.headings) for r in feature_blocks(html_events(pages(spark, html))).orderBy("ord").collect()] == [("block0", ["First one"]), ("block1", ["Second one"])]


def test_links(spark):
    html = "<a href='x'>1</a><script>'<a href=y>'</script><a>2</a></script></script><a href='z'/>"
    assert [r.href for r in links(html_events(pages(spark, html))).orderBy("seq").collect()] == ["x", "z"]


SKU = '<div class="model-base-info-subtitle">Pro 16 AAA / Pro 16 BBB &amp; more</div>' + "".join(f'<div class="spec-item-list" data-spec-row="{r}">{c}</div>' for r, c in [(0, "same"), (0, "same"), (1, "x<br/> <b>1</b> &lt;"), (1, "y")])


def test_sku_variants(spark):
    got = rows(sku_variants(pages(spark, SKU, SKU + '<div class="spec-item-list" data-spec-row="0">third</div>', SKU.replace("Pro", "Con")), "Pro 16"), "col")
    assert got == [(0, 0, "AAA", "Pro 16 AAA", 1, "x; 1 <"), (0, 1, "BBB", "Pro 16 BBB", 1, "y")]


def test_corpus(spark):
    spec, prose = pages(spark, SPEC + SKU), pages(spark, FEATURE)
    corpus = build_corpus(spec, spec, "Pro 16", prose, prose, validate=False).orderBy("ord").collect()
    assert [r.ord for r in corpus] == list(range(len(corpus)))
    ids = [r.chunk_id for r in corpus]
    assert ids[:2] == ["fact.cpu.model", "fact.cpu.cache"]
    assert ids.index("spec.cpu#row") < ids.index("spec.cpu#L0") < ids.index("spec.cpu#note0") < ids.index("spec.io_port#row") < ids.index("sku.overview") < ids.index("feature.zh.cool.0.0")
    text = {r.chunk_id: r.text for r in corpus}
    assert text["spec.io_port#L1"] == "I/O Port: 1 x HDMI 2.1" and "spec.io_port#L0" not in text and "spec.io_port#L3" not in text
    assert text["sku.aaa.1"] == "Pro 16 AAA 的I/O Port / I/O Port: x; 1 <"
    assert text["feature.zh.cool.1.0"] == "Cooling fans: Second paragraph of cooling, long enough."
    assert text["feature.zh.root.0.0"].startswith("Pro 16 產品特色 / product feature: in the root")
    assert "feature.en.cool.0.0" not in text  # the same text as in zh
    again = C.dedupe(spark.createDataFrame(corpus))
    assert again.count() == len(corpus)


def test_dedupe_keeps_the_first(spark):
    df = spark.createDataFrame([(2, "A  b"), (1, "a b "), (3, "c"), (4, None), (5, None)], "ord int, text string")
    assert sorted(r.ord for r in C.dedupe(df).collect()) == [1, 3, 4]
    assert sorted(r.ord for r in C.dedupe(df.repartition(7)).collect()) == [1, 3, 4]


def test_rules_are_data(spark):
    assert len(X.RULES) == 39 and len({r.fact_id for r in X.RULES}) == 39
    rule = [X.Rule("a", "K", "", "", r"(\d+)x", r"<\1>"), X.Rule("a", "K", "", "", r"(\w)", r"\1")]
    pairs = spark.createDataFrame([(0, 0, "k", "K", ["q", "９x 1x"], "q\n９x 1x")], "page_id int, idx int, key_zh string, key_en string, lines array<string>, value string")
    assert [(r.value) for r in X.rule_facts(pairs, X.rules_table(spark, rule)).collect()] == ["<９>"]
    first_line = X.rule_facts(pairs.withColumn("value", F.lit("a\rb\nc")), X.rules_table(spark, [X.Rule("a", "K", "", "", "^(.+)$", r"\1")])).first()
    assert first_line.value == "a\rb"


def test_many_products_at_once(spark):
    """Each product's chunks are those of a build of its own, in their order, whatever the others are."""
    own = {1: ("Pro 16", SPEC + SKU, FEATURE), 2: ("Air 9", SPEC.replace("240Hz", "120Hz") + SKU.replace("Pro 16", "Air 9"), FEATURE.replace("Cooling", "Silent")), 3: ("Pro 16", SPEC, FEATURE)}
    spec = spark.createDataFrame([(k, v[1]) for k, v in own.items()], "page_id bigint, html string")
    prose = spark.createDataFrame([(k, v[2]) for k, v in own.items()], "page_id bigint, html string")
    products = spark.createDataFrame([(k, v[0]) for k, v in own.items()], "page_id bigint, product string")
    got = build_corpora(spec, spec, products, prose, prose, validate=False).orderBy("ord").collect()
    assert [r.ord for r in got] == list(range(len(got))) and [r.page_id for r in got] == sorted(r.page_id for r in got)
    assert len({(r.page_id, r.chunk_id) for r in got}) == len(got) > len({r.chunk_id for r in got})
    for k, (name, html, text) in own.items():
        alone = build_corpus(pages(spark, html), pages(spark, html), name, pages(spark, text), pages(spark, text), validate=False).orderBy("ord").collect()
        assert [(r.chunk_id, r.text) for r in got if r.page_id == k] == [(r.chunk_id, r.text) for r in alone]


def test_places_in_an_order(spark, monkeypatch):
    """Ranges of rows are numbered from the sums of the counts before them; ties get places of their own."""
    monkeypatch.setattr(ordinals, "RANGE_ROWS", 20)
    df = spark.createDataFrame([(i * 37 % 500 if i % 3 else 250, f"r{i}") for i in range(500)] + [(None, "none")], "k int, name string").repartition(6)
    got = with_ordinals(df, [F.col("k")]).orderBy("ord").collect()
    assert [r.ord for r in got] == list(range(501)) and got[0].name == "none"
    assert [r.k for r in got[1:]] == sorted(r.k for r in got[1:])
    assert with_ordinals(df.limit(0), [F.col("k")]).count() == 0
    starts = ordinals.range_starts(ordinals.ranges(df, [F.col("k")]), ["k"]).collect()
    assert sum(r.total for r in starts if r["first"] == 0) == 501


def test_pages_are_parsed_once(spark):
    """Sections come from stored events: no Python is left in their plan, and SQL can use the parser too."""
    df = pages(spark, FEATURE)
    assert "Python" not in (plan := feature_blocks(html_events(df))._jdf.queryExecution().executedPlan().toString()) and "MapInPandas" not in plan
    register_html(spark)
    rows = spark.sql("SELECT seq, ev, tag FROM {pages}, LATERAL html_events(html) ORDER BY seq", pages=df).collect()
    assert [(r.seq, r.ev, r.tag) for r in rows] == [(r.seq, r.ev, r.tag) for r in html_events(df).orderBy("seq").collect()]


def test_pages_are_held_a_few_at_a_time(spark):
    """However many pages a batch has, events leave by the thousand; and with tags only their start and end tags are made, with the
    places that they have among all events.
    """
    import pyarrow as pa

    from lodestone.operators import html as H

    schema = pa.schema([("page_id", pa.int64()), ("seq", pa.int32()), *((c, pa.string()) for c in ("ev", "tag", "cls", "id", "style", "href", "data"))])
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(5000)), "html": ["<p>a<a href=x>b</a></p>"] * 4999 + [None]})
    out = list(H.event_batches(None, schema)(iter([batch])))
    assert sum(b.num_rows for b in out) == 4999 * 6 and max(b.num_rows for b in out) < H.EVENT_ROWS + 6
    some = next(H.event_batches(frozenset(["a"]), schema)(iter([batch.slice(0, 1)]))).to_pylist()
    assert [(r["seq"], r["ev"], r["tag"], r["href"]) for r in some] == [(2, "start", "a", "x"), (4, "end", "a", None)]


def test_references_that_are_cut_off(spark, tmp_path):
    """A title that ends within a reference reads as the query's SQL has it: only &amp is a character without its semicolon."""
    cut = ["&", "&a", "&amp", "&amp;", "&l", "&lt", "&lt;", "&gt", "&quo", "&quot", "&quot;", "&#", "&#x", "&#x2", "&#x27", "&#x27;", "&amp;quot", "&amp&lt", "&copy", "&copy;", "&ampx", "&quotx"]
    df = pages(spark, *[f"<article><h1>A title of {c}</h1><p>text &quot;{c}&amp; more</p><p>{c}</p></article>" for c in cut], None).withColumn("page_id", F.col("page_id").cast("long"))
    df.write.parquet(f"{tmp_path}/pages.parquet")
    query, sql = ALL["html_blocks"]
    got = [tuple(r) for r in query(spark, str(tmp_path)).orderBy("page_id").collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert got == con.execute(f"SELECT * FROM ({sql}) ORDER BY page_id").fetchall()
    assert len(got) == len(cut) and [r[3] for r in got[9:11]] == ["A title of &quot", 'A title of "']
