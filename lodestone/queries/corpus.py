"""Queries of corpus building: pages, specifications and models rendered from the table of parts, and what is made of them.

A part is a page whose rows, sections and models say what its columns hold, so that what parsing and chunking must give
back follows from the columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunks as C
from ..operators import facts as X
from ..operators.dense import ModelEmbedder, build_embedder, embed_corpus
from ..operators.generation import count_tokens, sse_pieces
from ..operators.html import feature_blocks, html_events, sku_cell_text, sku_variants, spec_rows, spec_violations
from ..operators.prompt import build_plain_prompts, build_prompts, with_thinking_switch
from ..sources.shared import ready, shared_dir
from ..sources.tables import check_index, load_index, not_cached, read_corpus, read_pages, read_questions, save_index, save_results, write_corpus
from .common import collapse_sql, table, tokens_sql
from .structure import LINES, io_pairs
from .text import PACK, SENTENCES

SPEC_PAGE = """concat('<html><script>var x = "<ul class=\\'spec-item-list\\'>";</script><div class="spec-item-list"><li class="spec-title">No</li></div>',
 '<ul class="x spec-item-list"><li class="spec-title">old<br>Brand</li><li class="spec-desc">', p_brand, '&nbsp; &amp; co</li></ul>',
 '<ul class="spec-item-list"><li class="spec-desc">no title</li></ul>',
 '<ul class="spec-item-list"><li class="spec-title">Name</li><li class="spec-desc">', p_name, '<br>', p_type, '<p style="FONT-size: 80%">size ', p_size,
 '</p><p>see <a href="http://a/', p_partkey, '">here</a></p></li></ul></html>')"""
FEATURE_PAGE = """concat('<p>outside of the container, and long</p><div class="my-key-features x"><p>', p_name, ' opens this paragraph</p><section id="about"><h2>', p_brand,
 ' at <b>a</b> glance</h2><svg><p>drawn</p></svg><p>Type ', p_type, ', in a size of ', p_size, '.</p></section><section><h3>More on ', p_type, '</h3></section></section><p>behind the container, and long</p></div>')"""
CELL = """'<div class="spec-item-list" data-spec-row="{}">', {}, '</div>'"""
CELLS = [(0, "p_brand"), (0, "p_brand"), (1, "p_name, '<br/> <b>x</b> &lt;'"), (1, "p_type"), (2, "p_size"), (2, "p_size + p_size % 2")]
SKU_PAGE = f"""concat('<div class="model-base-info-subtitle">Pro 16 A', p_partkey, ' / Pro 16 B', p_partkey, ' &amp; more</div>', {", ".join(CELL.format(*c) for c in CELLS)},
 if(p_size % 11 = 0, concat({CELL.format(0, "p_brand")}), ''))"""


def rendered(spark, sf, page: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), F.expr(page).alias("html"))


def joined(c: str):
    return F.array_join(c, "|").alias(c)


def specifications(spark, sf) -> DataFrame:
    return spec_rows(html_events(rendered(spark, sf, SPEC_PAGE))).select("page_id", "idx", "key", joined("lines"), joined("footnotes"))


def features(spark, sf) -> DataFrame:
    return feature_blocks(html_events(rendered(spark, sf, FEATURE_PAGE))).select("page_id", "ord", "block_id", joined("headings"), joined("paragraphs"))


def violations(spark, sf) -> DataFrame:
    """Rows without a key or a value, pages with too few rows, and a marker that must not appear."""
    rows = F.expr("""filter(array(struct(0 AS idx, if(p_size % 7 = 0, '', 'Brand') AS key, array(p_brand) AS lines), struct(1 AS idx, 'Name' AS key, if(p_size % 5 = 0, array(), array(p_name)) AS lines)),
      x -> x.idx = 0 OR p_size % 3 <> 0)""")
    return spec_violations(table(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), F.inline(rows)), 2, ("red",))


def cells(spark, sf) -> DataFrame:
    raw = F.expr("concat(' ', p_name, '&nbsp;<br> <BR/><br/><b>', p_type, '</b>\t &amp;amp; <i>', p_size, '</i>')")
    return table(spark, sf, "part").select("p_partkey", sku_cell_text(raw).alias("text"))


def models(spark, sf) -> DataFrame:
    return sku_variants(rendered(spark, sf, SKU_PAGE), "Pro 16")


def nation_items(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Nations of a region as rows of a page in two languages; of the Chinese ones only the first four."""
    n = table(spark, sf, "nation")
    earlier = n.select(F.col("n_regionkey").alias("page_id"), F.col("n_nationkey").alias("before"))
    idx = n.join(earlier, (F.col("page_id") == F.col("n_regionkey")) & (F.col("before") < F.col("n_nationkey")), "left").groupBy("n_nationkey", "n_regionkey", "n_name").agg(F.count("before").cast("int").alias("idx"))
    rows = idx.select(F.col("n_regionkey").alias("page_id"), "idx", "n_name", (F.col("n_nationkey") % 3).alias("k"))
    zh = rows.filter("idx < 4").select("page_id", "idx", F.concat(F.lit("zh "), "n_name").alias("key"))
    return zh, rows.select("page_id", "idx", F.concat(F.lit("K"), F.col("k").cast("string")).alias("key"), F.array("n_name", F.lit("x")).alias("lines"))


def positional_pairs(spark, sf) -> DataFrame:
    return X.paired_rows(*nation_items(spark, sf)).select("page_id", "idx", "key_zh", "key_en", "value")


def port_facts(spark, sf) -> DataFrame:
    found = X.port_facts(io_pairs(spark, sf)).filter("fact_id LIKE 'io.port.%'")
    return found.select("page_id", "fact_id", "label_zh", "label_en", "value", F.col("extra")["side"].alias("side"), F.col("extra")["count"].alias("n"))


#: A value for each key, in which every rule finds something; {n} is the part's size.
RULE_VALUES = {
    "CPU": "Intel Core Ultra {n} Processor {n}HX (x)\n{n}1 cores, {n}2 threads, up to {n}.5 GHz, {n}MB cache",
    "Video Graphics": "NVIDIA brand GeForce RTX {n}0 Laptop GPU\n{n}GB GDDR7, {n}5W Maximum Graphics Power, AI Boost: {n}00 MHz",
    "Display": '{n}" 16:10 Mini LED (2560×1600) {n}0Hz {n}ms DCI-3 {n}% {n}00nits (peak) 1,000,000:1',
    "System Memory": "Up to {n}GB DDR5 5600MHz, {n}x SO-DIMM",
    "Storage": "Up to {n}TB PCIe NVMe™ M.2 SSD, {n}x PCIe Gen5 M.2 slot, {n}x PCIe Gen4x4 M.2 slot",
    "Keyboard Type": "per-key{n} RGB Backlit Keyboard, Up to {n}.7mm Key-travel",
    "Audio": "{n}x 2W speakers",
    "Communications": "WIFI 7 (no. {n})\nBluetooth v5.{n}\nLAN: {n}G",
    "Webcam": "FHD (1080p) IR Webcam",
    "Battery": "{n}Wh Li-ion",
    "Adapter": "{n}W",
    "Dimensions (W x D x H)": "{n}.1 x 2{n} x 1.{n}~2 mm",
    "Weight": "~{n}.5 kg",
    "Color": "Grey {n}\nsecond line",
}
#: What the group of each rule's pattern holds in these values.
RULE_GROUPS = {
    "cpu.model": "Intel Core Ultra {n} Processor {n}HX", "cpu.cache": "{n}MB", "cpu.max_frequency": "{n}.5 GHz", "cpu.cores": "{n}1", "cpu.threads": "{n}2",
    "gpu.model": "NVIDIA brand GeForce RTX {n}0 Laptop GPU", "gpu.vram": "{n}GB GDDR7", "gpu.max_graphics_power": "{n}5W", "gpu.boost_clock": "{n}00 MHz",
    "display.size": "{n}", "display.aspect_ratio": "16:10", "display.panel": "Mini LED", "display.resolution": "2560×1600", "display.refresh_rate": "{n}0", "display.response_time": "{n}",
    "display.color_gamut": "DCI-3 {n}%", "display.brightness": "{n}00", "display.contrast": "1,000,000:1",
    "memory.max_capacity": "{n}GB", "memory.type": "DDR5", "memory.speed": "5600MHz", "memory.slots": "{n}",
    "storage.max_capacity": "{n}TB", "storage.gen5_slot": "{n}", "storage.gen4_slot": "{n}", "storage.interface": "PCIe NVMe™ M.2 SSD",
    "keyboard.backlight": "per-key{n} RGB Backlit Keyboard", "keyboard.key_travel": "{n}.7mm", "audio.speakers": "{n}x 2W speakers",
    "wireless.wifi": "WIFI 7 (no. {n})", "wireless.bluetooth": "v5.{n}", "network.lan": "{n}G", "webcam.resolution": "FHD (1080p) IR Webcam",
    "battery.capacity": "{n}Wh", "battery.type": "Li-ion", "adapter.power": "{n}W", "dimensions.mm": "{n}.1 x 2{n} x 1.{n}~2 mm", "weight.kg": "{n}.5 kg", "color.name": "Grey {n}",
}


def rule_facts(spark, sf) -> DataFrame:
    values = F.array(*[F.struct(F.lit(k).alias("key_en"), F.replace(F.lit(v), F.lit("{n}"), F.col("p_size").cast("string")).alias("value")) for k, v in RULE_VALUES.items()])
    pairs = table(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), F.inline(values)).withColumn("key_zh", F.lit("鍵"))
    return X.rule_facts(pairs, X.rules_table(spark))


def all_rules(spark, sf) -> DataFrame:
    return rule_facts(spark, sf).select("page_id", "fact_id", "value", "source_key_en")


SHOWN = ["chunk_id", "doc_id", "kind", "text", "key_zh", "key_en", "lang"]


def shown(chunks: DataFrame) -> DataFrame:
    return chunks.select(*SHOWN, F.to_json("meta").alias("meta"))


def fact_chunks(spark, sf) -> DataFrame:
    return shown(C.fact_chunks(rule_facts(spark, sf)))


def part_items(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Three rows for each part, one of them with a structural line and a footnote."""
    rows = """array(struct(0 AS idx, '{0}' AS key, array(p_brand) AS lines, CAST(array() AS array<string>) AS footnotes), struct(1 AS idx, 'I/O' AS key, array('Left side :', p_name, p_type) AS lines, array(concat('size ', p_size)) AS footnotes),
      struct(2 AS idx, '{1}' AS key, array('z') AS lines, CAST(array() AS array<string>) AS footnotes))"""
    page = table(spark, sf, "part").withColumn("page_id", F.col("p_partkey"))
    return tuple(page.select("page_id", F.inline(F.expr(rows.format(*keys)))) for keys in (("品牌", "重量"), ("Brand Name/x.1", "Weight!")))


def spec_chunks(spark, sf) -> DataFrame:
    return shown(C.spec_chunks(*part_items(spark, sf)))


def sku_chunks(spark, sf) -> DataFrame:
    return shown(C.sku_chunks(models(spark, sf), *part_items(spark, sf), "Pro 16"))


def prose_chunks(spark, sf) -> DataFrame:
    """Documents as blocks of one paragraph; every second one has a heading of its own."""
    docs = table(spark, sf, "documents")
    heading = F.when(F.col("doc_id") % 2 == 0, F.array(F.concat(F.lit("On "), "source"))).otherwise(F.array().cast("array<string>"))
    blocks = docs.select(F.lit(0).alias("ord"), F.concat(F.lit("b"), F.col("doc_id").cast("string")).alias("block_id"), heading.alias("headings"), F.array("text").alias("paragraphs"))
    return C.feature_chunks(blocks, "en", "Pro 16").select("chunk_id", "doc_id", F.md5("text").alias("text_md5"), "key_zh", "key_en")


def corpus_order(spark, sf) -> DataFrame:
    """Two stages in order, numbered; numbered again after some are gone."""
    part = table(spark, sf, "part")
    none = F.create_map().cast("map<string,string>")

    def stage(name: str, *place):
        key = F.concat(F.lit(name), F.col("p_partkey").cast("string"))
        return part.select(*C.chunk(F.array(F.col("p_partkey").cast("int"), *place), key, key, "fact", F.col("p_size").cast("string"), F.lit(""), F.lit(""), none))

    numbered = C.in_order(stage("a"), stage("b", F.lit(1)))
    return C.renumbered(numbered.filter("text::int % 3 <> 0")).select("ord", "chunk_id")


def prompts(spark, sf) -> DataFrame:
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")
    hits = table(spark, sf, "conversations").select(F.col("conv_id").alias("qid"), F.col("turn").alias("rank"), "text")
    made = build_prompts(asked, hits, {"zh": "Z", "en": "Be brief."}, 900)
    switched = with_thinking_switch(F.col("messages"), "/no_think")
    roles = F.array_join(F.transform("messages", lambda m: m["role"]), ",")
    return made.select("qid", "lang", "n_used", "context_chars", roles.alias("roles"), switched[0]["content"].alias("system"), F.md5(F.col("messages")[1]["content"]).alias("user_md5"))


def plain_prompts(spark, sf) -> DataFrame:
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")
    made = build_plain_prompts(asked, {"zh": "Z", "en": "Be brief."})
    return made.select("qid", F.to_json("messages").alias("messages"))


def pieces_of_log(spark, sf) -> DataFrame:
    """Events as lines of a log of server-sent events."""
    e = table(spark, sf, "events")
    kind, number = F.col("event_type"), F.col("event_id").cast("string")
    line = (
        F.when(kind == "view", F.concat(F.lit('data: {"choices":[{"delta":{"content":"v'), number, F.lit('"}}]}')))
        .when(kind == "click", F.concat(F.lit(": comment "), number)).when(kind == "signup", F.lit("data: not JSON"))
        .when(kind == "error", F.lit("data: [DONE]")).otherwise(F.lit('data:{"choices":[{"delta":{}}]}'))
    )
    return sse_pieces(e.select(F.col("user_id").alias("req_id"), F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), line.alias("line"))).select("req_id", "seq", "piece")


def token_counts(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", count_tokens(F.col("text")).alias("n_tokens"))


def vowels_and_length():
    """A toy model: a text's length, its number of e, and 1."""
    return lambda batch: [[len(t), t.count("e"), 1.0] for t in batch]


def model_embedder(spark, sf) -> DataFrame:
    """The hook for models, with its prefixes for passages and queries."""
    ready(spark)
    model = ModelEmbedder("toy", 3, vowels_and_length, "query: ", "p ")
    made = table(spark, sf, "documents").select("doc_id", model.encode(F.col("text")).alias("p"), model.encode(F.col("text"), is_query=True).alias("q"))
    return made.select("doc_id", *[F.round(F.col(c)[k], 6).alias(f"{c}{k}") for c in "pq" for k in range(2)])


def own_folder(spark) -> str:
    return f"{shared_dir(spark)}/lodestone-{uuid.uuid4().hex}"


def embedded_index(spark, sf) -> DataFrame:
    """Documents embedded by a registered embedder, saved as an index and loaded again."""
    path, embedder = own_folder(spark), build_embedder("MD5")
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("ord"), "text")
    save_index(embed_corpus(asked, embedder), path, embedder.name, embedder.dim)
    back = load_index(spark, path, "md5")
    check_index(back, asked)
    return back.select(F.col("ord").alias("item_id"), F.posexplode("v").alias("dim", "x")).select("item_id", "dim", F.round("x", 6).alias("x"))


def corpus_files(spark, sf) -> DataFrame:
    """Chunks written as JSON lines and read back."""
    path = own_folder(spark)
    key = F.col("doc_id").cast("string")
    none = F.create_map().cast("map<string,string>")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), *C.chunk(F.array(F.lit(0)), key, F.col("source"), "feature", F.col("text"), F.lit(""), F.col("lang"), none)[1:])
    write_corpus(docs, path)
    return read_corpus(spark, path).select("ord", "chunk_id", "doc_id", F.md5("text").alias("text_md5"), "key_en", "lang", F.size("meta").alias("n_meta"))


def question_files(spark, sf) -> DataFrame:
    """Items written as questions in JSON lines, with texts and lists of texts to include, and read back."""
    path = own_folder(spark)
    include = F.when(F.col("item_id") % 2 == 0, F.lit('["a",["b","c"]]')).otherwise(F.lit("[]"))
    fields = F.concat(F.lit('{"id":"q'), F.col("item_id").cast("string"), F.lit('","question":'), F.expr("replace(to_json(array(text)), '\\u2028', '')"), F.lit(',"type":"fact","gold_docs":["d1"],"must_include":'), include, F.lit("}"))
    line = F.replace(F.replace(fields, F.lit('"question":['), F.lit('"question":')), F.lit('],"type"'), F.lit(',"type"'))
    table(spark, sf, "benchmark").select(line.alias("value")).write.text(path)
    back = read_questions(spark, path)
    return back.select("qid", F.md5("text").alias("text_md5"), "type", F.size("gold_docs").alias("n_gold"), F.array_join(F.transform("must_include", lambda g: F.array_join(g, "+")), "&").alias("include"), "must_refuse")


def result_files(spark, sf) -> DataFrame:
    path = own_folder(spark)
    save_results(table(spark, sf, "nation"), path)
    return spark.read.schema("n_nationkey int, n_name string, n_regionkey int").json(path)


def pages_left(spark, sf) -> DataFrame:
    """Pages still to be fetched, where those that a label has the id of are cached."""
    cached = table(spark, sf, "labels").select(F.col("doc_id").alias("page_id"))
    return not_cached(read_pages(spark, f"{sf}/pages.parquet"), cached).select("page_id", "url", F.length("html").alias("n_chars"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def of_size(text: str) -> str:
    return f"replace({quoted(text)}, '{{n}}', p_size::VARCHAR)"


TEMPLATES = {r.fact_id: r for r in X.RULES}
FACTS = " UNION ALL ".join(
    f"SELECT p_partkey, p_size, {quoted(f)} AS fact_id, {of_size(TEMPLATES[f].template.replace(chr(92) + '1', g))} AS value, {quoted(TEMPLATES[f].key_en)} AS key_en, {quoted(TEMPLATES[f].label_zh)} AS zh, {quoted(TEMPLATES[f].label_en)} AS en FROM part"
    for f, g in RULE_GROUPS.items()
)
ROWS = """rows AS (SELECT p_partkey AS p, 0 AS idx, '品牌' AS zh, 'Brand Name/x.1' AS en, 'spec.brand_namex.1' AS doc, [p_brand] AS lines, []::VARCHAR[] AS notes FROM part
 UNION ALL SELECT p_partkey, 1, 'I/O', 'I/O', 'spec.io', ['Left side :', p_name, p_type], ['size ' || p_size] FROM part UNION ALL SELECT p_partkey, 2, '重量', 'Weight!', 'spec.weight', ['z'], []::VARCHAR[] FROM part),
k AS (SELECT *, CASE WHEN zh = en THEN zh ELSE zh || ' / ' || en END || ': ' AS head FROM rows)"""
MODELS = """m AS (SELECT p_partkey AS page_id, unnest([{'col': 0, 'code': 'A' || p_partkey, 'row': 1, 'value': p_name || '; x <'}, {'col': 1, 'code': 'B' || p_partkey, 'row': 1, 'value': p_type}]
 || CASE WHEN p_size % 2 = 1 THEN [{'col': 0, 'code': 'A' || p_partkey, 'row': 2, 'value': p_size::VARCHAR}, {'col': 1, 'code': 'B' || p_partkey, 'row': 2, 'value': (p_size + 1)::VARCHAR}] ELSE [] END, recursive := true) FROM part WHERE p_size % 11 <> 0)"""
WINDOWS = f"SELECT doc_id, source, (i - 1)::INT AS wi, w[i] AS win FROM (SELECT doc_id, source, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, source, CASE WHEN length(n) <= 240 THEN [n] ELSE string_split({PACK}, chr(30)) END AS w FROM (SELECT doc_id, source, {collapse_sql('text')} AS n, {SENTENCES} AS ss FROM documents)))"
MD5 = f"h AS (SELECT item_id, md5(t) AS m FROM (SELECT item_id, unnest({tokens_sql('text')}) AS t FROM benchmark)), s AS (SELECT item_id, (('0x' || substr(m, 1, 7))::BIGINT % 64)::INT AS dim, sum(CASE WHEN substr(m, 8, 1) >= '8' THEN 1.0::DOUBLE ELSE -1.0 END) AS x FROM h GROUP BY ALL), n AS (SELECT item_id, sqrt(sum(x * x)) AS norm FROM s GROUP BY item_id)"
QUERIES = {
    "spec_rows": (
        specifications,
        "SELECT p_partkey AS page_id, 0 AS idx, 'Brand' AS key, p_brand || ' & co' AS lines, '' AS footnotes FROM part UNION ALL SELECT p_partkey, 1, 'Name', p_name || '|' || p_type || '|see here (http://a/' || p_partkey || ')', 'size ' || p_size FROM part",
    ),
    "feature_blocks": (
        features,
        "SELECT p_partkey AS page_id, 0 AS ord, 'about' AS block_id, p_brand || ' at a glance' AS headings, 'Type ' || p_type || ', in a size of ' || p_size || '.' AS paragraphs FROM part UNION ALL SELECT p_partkey, 1, 'block1', 'More on ' || p_type, '' FROM part UNION ALL SELECT p_partkey, 2, 'root', '', p_name || ' opens this paragraph' FROM part",
    ),
    "spec_violations": (
        violations,
        """SELECT p_partkey AS page_id, NULL::INT AS idx, 'expected 2 rows, got 1' AS problem FROM part WHERE p_size % 3 = 0 UNION ALL SELECT p_partkey, 0, 'no key' FROM part WHERE p_size % 7 = 0
UNION ALL SELECT p_partkey, 1, CASE WHEN p_size % 5 = 0 THEN 'no value' ELSE 'holds red' END FROM part WHERE p_size % 3 <> 0 AND (p_size % 5 = 0 OR contains(p_name, 'red'))""",
    ),
    "sku_cell_text": (cells, "SELECT p_partkey, p_name || '; ' || p_type || ' &amp; ' || p_size AS text FROM part"),
    "sku_variants": (models, f"WITH {MODELS} SELECT page_id, col, code, 'Pro 16 ' || code AS full_name, row, value FROM m"),
    "positional_pairs": (
        positional_pairs,
        """WITH r AS (SELECT n_regionkey AS page_id, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS idx, n_name, 'K' || n_nationkey % 3 AS key_en FROM nation)
SELECT page_id, idx, 'zh ' || n_name AS key_zh, key_en, n_name || chr(10) || 'x' AS value FROM r WHERE idx < 4 QUALIFY row_number() OVER (PARTITION BY page_id, key_en ORDER BY idx DESC) = 1""",
    ),
    "port_facts": (
        port_facts,
        f"WITH {LINES}, z AS (SELECT *, CASE side WHEN 'Left' THEN '左側' WHEN 'Right' THEN '右側' ELSE side END AS zh FROM ports) SELECT page_id, 'io.port.' || pos AS fact_id, '連接埠（' || zh || '）' AS label_zh, 'I/O port (' || side || ' side)' AS label_en, count || ' x ' || description AS value, side, count::VARCHAR AS n FROM z",
    ),
    "all_rules": (all_rules, f"SELECT p_partkey AS page_id, fact_id, value, key_en AS source_key_en FROM ({FACTS})"),
    "fact_chunks": (
        fact_chunks,
        f"SELECT 'fact.' || fact_id AS chunk_id, 'fact.' || split_part(fact_id, '.', 1) AS doc_id, 'fact' AS kind, zh || ' / ' || en || ': ' || value AS text, zh AS key_zh, en AS key_en, 'bi' AS lang, '{{\"fact_id\":\"' || fact_id || '\",\"spec_key\":\"' || key_en || '\"}}' AS meta FROM ({FACTS})",
    ),
    "spec_chunks": (
        spec_chunks,
        f"""WITH {ROWS}, c AS (SELECT doc || '#row' AS chunk_id, doc, 'spec_row' AS kind, head || array_to_string(lines, '; ') AS text, zh, en, '{{"line_count":"' || len(lines) || '"}}' AS meta FROM k
UNION ALL SELECT doc || '#L' || i, doc, 'spec_line', head || lines[i + 1], zh, en, '{{"line_index":"' || i || '"}}' FROM k, (SELECT unnest([1, 2]) AS i) WHERE len(lines) > 1
UNION ALL SELECT doc || '#note0', doc, 'footnote', head || '[註 / note] ' || notes[1], zh, en, '{{"footnote_index":"0"}}' FROM k WHERE len(notes) > 0)
SELECT chunk_id, doc AS doc_id, kind, text, zh AS key_zh, en AS key_en, 'bi' AS lang, meta FROM c""",
    ),
    "sku_chunks": (
        sku_chunks,
        f"""WITH {MODELS}, k(row, zh, en) AS (VALUES (0, '品牌', 'Brand Name/x.1'), (1, 'I/O', 'I/O'), (2, '重量', 'Weight!')),
d AS (SELECT p_partkey AS p, p_size % 2 = 1 AS two FROM part WHERE p_size % 11 <> 0)
SELECT 'sku.' || lower(code) || '.' || row AS chunk_id, 'sku.' || lower(code) AS doc_id, 'sku' AS kind, 'Pro 16 ' || code || ' 的' || zh || ' / ' || en || ': ' || value AS text, code || ' ' || zh AS key_zh, code || ' ' || en AS key_en, 'bi' AS lang,
       '{{"sku":"' || code || '","spec_key":"' || en || '"}}' AS meta FROM m JOIN k USING (row)
UNION ALL SELECT 'sku.overview', 'sku', 'sku', '機型比較 / Comparison of models: Pro 16，2 款 / models: A' || p || '、B' || p || '。不同項目 / Rows that differ: ' || CASE WHEN two THEN 'I/O、重量 / I/O, Weight!' ELSE 'I/O / I/O' END
       || '。相同項目數 / Rows that are the same: ' || CASE WHEN two THEN 1 ELSE 2 END, '機型版本', 'Model variants', 'bi', '{{"skus":"A' || p || ',B' || p || '","differing_keys":"' || CASE WHEN two THEN 'I/O,Weight!' ELSE 'I/O' END || '"}}' FROM d""",
    ),
    "feature_chunks": (
        prose_chunks,
        f"""WITH w AS ({WINDOWS}), h AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'On ' || source ELSE 'Pro 16 產品特色 / product feature' END AS head FROM w WHERE length(win) >= 12)
SELECT 'feature.en.b' || doc_id || '.0.' || wi AS chunk_id, 'feature.en.b' || doc_id AS doc_id, md5(head || ': ' || win) AS text_md5, '' AS key_zh, head AS key_en FROM h""",
    ),
    "corpus_order": (
        corpus_order,
        "SELECT row_number() OVER (ORDER BY stage, p_partkey) - 1 AS ord, stage || p_partkey AS chunk_id FROM part, (SELECT unnest(['a', 'b']) AS stage) WHERE p_size % 3 <> 0",
    ),
    "prompt_messages": (
        prompts,
        """WITH l AS (SELECT conv_id AS qid, turn, '[' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) || '] ' || text AS line FROM conversations),
u AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY qid ORDER BY turn) - 1 AS upto FROM l), c AS (SELECT qid, count(*) AS n, string_agg(line, chr(10) ORDER BY turn) AS context FROM u WHERE upto <= 900 GROUP BY qid)
SELECT item_id AS qid, 'en' AS lang, coalesce(n, 0) AS n_used, length(coalesce(context, ''))::INT AS context_chars, 'system,user' AS roles, 'Be brief. /no_think' AS system,
       md5('Reference:' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || 'Question:' || text) AS user_md5 FROM benchmark LEFT JOIN c ON c.qid = item_id""",
    ),
    "plain_messages": (plain_prompts, """SELECT item_id AS qid, '[{"role":"system","content":"Be brief."},{"role":"user","content":' || to_json(text) || '}]' AS messages FROM benchmark"""),
    "sse_pieces": (
        pieces_of_log,
        "SELECT user_id AS req_id, event_id AS seq, 'v' || event_id AS piece FROM events LEFT JOIN (SELECT user_id, min(event_id) AS done FROM events WHERE event_type = 'error' GROUP BY 1) USING (user_id) WHERE event_type = 'view' AND (done IS NULL OR event_id < done)",
    ),
    "count_tokens": (token_counts, f"SELECT doc_id, len({tokens_sql('text')})::INT AS n_tokens FROM documents"),
    "model_embedder": (
        model_embedder,
        "WITH p AS (SELECT doc_id, length(text) + 2 AS n, (length(text) - length(replace(text, 'e', '')))::DOUBLE AS e FROM documents), "
        "s AS (SELECT doc_id, n, e, n + 5 AS m, e + 1 AS f FROM p) SELECT doc_id, round(n / sqrt(n * n + e * e + 1), 6) AS p0, round(e / sqrt(n * n + e * e + 1), 6) AS p1, round(m / sqrt(m * m + f * f + 1), 6) AS q0, round(f / sqrt(m * m + f * f + 1), 6) AS q1 FROM s",
    ),
    "index_files": (
        embedded_index,
        f"WITH {MD5} SELECT b.item_id, d.dim::INT AS dim, round(coalesce(s.x, 0.0) / greatest(coalesce(n.norm, 0.0), 1e-12), 6) AS x FROM benchmark b CROSS JOIN (SELECT unnest(range(64)) AS dim) d LEFT JOIN s ON s.item_id = b.item_id AND s.dim = d.dim LEFT JOIN n ON n.item_id = b.item_id",
    ),
    "corpus_files": (corpus_files, "SELECT doc_id AS ord, doc_id::VARCHAR AS chunk_id, source AS doc_id, md5(text) AS text_md5, lang AS key_en, 'bi' AS lang, 0 AS n_meta FROM documents"),
    "question_files": (
        question_files,
        "SELECT 'q' || item_id AS qid, md5(text) AS text_md5, 'fact' AS type, 1 AS n_gold, CASE WHEN item_id % 2 = 0 THEN 'a&b+c' ELSE '' END AS include, false AS must_refuse FROM benchmark",
    ),
    "result_files": (result_files, "SELECT n_nationkey, n_name, n_regionkey FROM nation"),
    "pages_left": (pages_left, "SELECT page_id, url, length(html)::INT AS n_chars FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels)"),
}
