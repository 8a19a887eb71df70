"""HTML to rows: one table function makes events, windows over them do the rest.

All results are per page. Selectors are parameters.
"""

from __future__ import annotations

import html as html_lib
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.text import clean
from ..sources.shared import dropped, ready, stored

#: The class names and style that the pages use.
SPEC_LIST, SPEC_TITLE, SPEC_DESC = "spec-item-list", "spec-title", "spec-desc"
FOOTNOTE_STYLE = r"(?i)font-size:\s*80%"
CONTAINER, SECTION_PREFIX = "key-features", "section-"
SPEC_ROWS = 17
TEXT_TAGS = ["h1", "h2", "h3", "h4", "h5", "h6", "p"]
#: Pages that are made Python strings at once, and events that leave Python at once, and those of one page more.
PAGE_ROWS, EVENT_ROWS = 64, 8_000
EVENTS = "seq int, ev string, tag string, cls string, id string, style string, href string, data string"


class _Events(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple] = []

    def put(self, ev: str, tag: str = "", attrs=(), data: str = "") -> None:
        if not attrs:
            self.rows.append((len(self.rows), ev, tag, "", "", "", None, data))
            return
        at = {k: v or "" for k, v in attrs}
        self.rows.append((len(self.rows), ev, tag, at.get("class", ""), at.get("id", ""), at.get("style", ""), at.get("href"), data))

    def handle_starttag(self, tag, attrs):
        self.put("start", tag, attrs)

    def handle_endtag(self, tag):
        self.put("end", tag)

    def handle_data(self, data):
        self.put("data", data=data)


def events_of(page: str | None) -> list[tuple]:
    parser = _Events()
    parser.feed(page or "")
    parser.close()
    return parser.rows


@F.udtf(returnType=EVENTS)
class HtmlEvents:
    """Events of a page as a table function: SELECT ... FROM pages, LATERAL html_events(html)."""

    def eval(self, html: str):
        yield from events_of(html)


def register_html(spark: SparkSession) -> None:
    """Make html_events(html) known to SQL."""
    ready(spark)
    spark.udtf.register("html_events", HtmlEvents)


def html_events(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", tags: tuple[str, ...] | None = None) -> DataFrame:
    """(page_id, seq, ev, tag, cls, id, style, href, data): a row for each start tag, end tag and text of each page; with tags, only
    for the start and end tags of these, and for texts if one of them is empty.

    Null pages have no events. Pages are parsed one by one, in Arrow batches.
    """
    ready(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))
    schema = f"page_id {rows.schema['page_id'].dataType.simpleString()}, {EVENTS}"
    return rows.mapInArrow(event_batches(None if tags is None else frozenset(tags), to_arrow_schema(StructType.fromDDL(schema))), schema)


def event_batches(tags: frozenset[str] | None, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of schema for the events of pages (page_id, html): some pages are held as strings at a time, and some thousand events."""

    def made(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in (big.slice(k, PAGE_ROWS) for big in batches for k in range(0, big.num_rows, PAGE_ROWS)):
            for page, text in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist(), strict=True):
                held += [(page, *event) for event in events_of(text) if tags is None or event[2] in tags]
                if len(held) >= EVENT_ROWS:
                    yield made(held)
                    held = []
        if held:
            yield made(held)

    return run


def in_page(*more: str) -> Window:
    return Window.partitionBy("page_id", *more).orderBy("seq")


def start(*tags: str) -> Column:
    return (F.col("ev") == "start") & F.col("tag").isin(*tags)


def end(*tags: str) -> Column:
    return (F.col("ev") == "end") & F.col("tag").isin(*tags)


def carried(value: Column, window: Window, before: bool = False) -> Column:
    """The last value that isn't null, up to here or to the row before."""
    return F.last(value, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, -1 if before else 0))


def outside(events: DataFrame, *tags: str) -> DataFrame:
    """Events that are not inside these elements, nor their tags. A depth never falls below 0: an end tag too many
    counts for nothing.
    """
    step = F.when(start(*tags), 1).when(end(*tags), -1).otherwise(0)
    walk = events.withColumn("_s", F.sum(step).over(in_page()))
    floor = F.least(F.lit(0), F.min("_s").over(in_page()))
    return walk.withColumn("_d", F.col("_s") - floor).filter((F.col("_d") == 0) & ~F.col("tag").isin(*tags)).drop("_s", "_d")


def has_class(name: str) -> Column:
    return F.array_contains(F.split(F.trim(F.regexp_replace("cls", r"\s+", " ")), " "), name)


def spec_rows(events: DataFrame, list_class: str = SPEC_LIST, title_class: str = SPEC_TITLE, desc_class: str = SPEC_DESC) -> DataFrame:
    """(page_id, idx, key, lines, footnotes): the titled rows of `ul` lists of this class.

    Lines end at li, p and br. Text of a paragraph in small print is a footnote. Link targets follow the text of
    their link unless it has them. The last title of a row counts, and rows without one are left out.
    """
    e = outside(events, "script", "style")
    opens, closes = start("ul") & has_class(list_class), end("ul")
    e = e.withColumn("inside", F.coalesce(carried(F.when(opens, True).when(closes, False), in_page(), before=True), F.lit(False)))
    e = e.withColumn("item", F.sum(opens.cast("int")).over(in_page())).filter(F.col("inside") | opens)
    cut = F.col("inside") & (start("li", "br", "p") | end("p", "li", "ul"))
    mode = F.when(start("li") & has_class(title_class), "title").when(start("li") & has_class(desc_class), "desc").when(start("li") | end("li", "ul"), "")
    note = F.when(start("p"), F.col("style").rlike(FOOTNOTE_STYLE)).when(end("p", "ul"), False)
    link = F.when(start("a"), F.coalesce("href", F.lit(""))).when(end("a"), "")
    e = (
        e.filter(~opens | F.col("inside"))
        .withColumn("mode", F.coalesce(carried(mode, in_page(), before=True), F.lit("")))
        .withColumn("note", F.coalesce(carried(note, in_page(), before=True), F.lit(False)))
        .withColumn("link", F.coalesce(carried(link, in_page(), before=True), F.lit("")))
        .withColumn("line", F.coalesce(F.sum(cut.cast("int")).over(in_page().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    )
    linked = end("a") & (F.col("link") != "")
    # What a line says, in order: its text, and the target of a link unless the line has it already.
    part = F.when((F.col("ev") == "data") & (F.col("mode") != ""), F.struct("seq", F.lit("").alias("link"), F.col("data").alias("text"))).when(linked, F.struct("seq", "link", F.concat(F.lit(" ("), F.col("link"), F.lit(")")).alias("text")))
    said = F.aggregate(F.array_sort(F.collect_list(part)), F.lit(""), lambda line, p: F.when((p["link"] != "") & F.contains(line, p["link"]), line).otherwise(F.concat(line, p["text"])))
    lines = e.groupBy("page_id", "item", "line").agg(
        said.alias("raw"),
        F.first("mode").alias("mode"),
        F.first("note").alias("note"),
        F.max(closes).alias("closed"),
    )
    lines = lines.withColumn("text", clean(F.col("raw"))).withColumn("text", F.when(F.col("text") != "", F.col("text")))
    placed = F.struct("line", "text")

    def texts_where(condition: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(condition & F.col("text").isNotNull(), placed))), lambda x: x["text"])

    title = F.col("mode") == "title"
    items = lines.groupBy("page_id", "item").agg(
        F.max_by("text", F.when(title & F.col("text").isNotNull(), F.col("line"))).alias("key"),
        texts_where(~title & ~F.col("note")).alias("lines"),
        texts_where(~title & F.col("note")).alias("footnotes"),
        F.max("closed").alias("closed"),
    )
    kept = items.filter(F.col("closed") & F.col("key").isNotNull())
    return kept.select("page_id", (F.row_number().over(Window.partitionBy("page_id").orderBy("item")) - 1).alias("idx"), "key", "lines", "footnotes")


#: What feature_blocks() needs of a page besides its container: `` stands for texts.
BLOCK_TAGS = ("", "script", "style", "svg", "noscript", "section", "div", *TEXT_TAGS)


def feature_blocks(events: DataFrame, container: str = CONTAINER, section_prefix: str = SECTION_PREFIX, container_tag: str | None = None) -> DataFrame:
    """(page_id, ord, block_id, headings, paragraphs): prose of the sections inside the first container of each page.

    The container is the first element whose class contains `container` (or the first `container_tag`). Sections are
    `section` elements and `div`s whose class contains `section_prefix`; any `div` or `section` end closes the
    innermost one, and a `section` end with none open closes the container. A container that is never closed so has no
    block of its own. Blocks are in the order in which they close; those without a paragraph of more than 20
    characters or a heading of more than 4 are left out.
    """
    e = outside(events, "script", "style", "svg", "noscript")
    opens = (F.col("ev") == "start") & (F.col("tag") == container_tag if container_tag else F.contains("cls", F.lit(container)))
    e = e.withColumn("root", F.min(F.when(opens, F.col("seq"))).over(Window.partitionBy("page_id"))).filter(F.col("seq") >= F.col("root"))
    inner = (F.col("seq") > F.col("root")) & (start("section") | (start("div") & F.contains("cls", F.lit(section_prefix))))
    shut = end("section", "div") if not container_tag else end("section", "div", container_tag)
    # The depth is 1 in the container and doesn't fall below that while it is open.
    e = e.withColumn("_s", F.sum(F.when(inner, 1).when(shut, -1).otherwise(0)).over(in_page()))
    e = e.withColumn("depth", 1 + F.col("_s") - F.least(F.lit(0), F.min("_s").over(in_page())))
    e = e.withColumn("was", F.coalesce(F.lag("depth").over(in_page()), F.lit(1)))
    last = (end(container_tag) if container_tag else end("section")) & (F.col("was") == 1)
    e = e.withColumn("over", F.min(F.when(last, F.col("seq"))).over(Window.partitionBy("page_id")))
    e = e.filter(F.col("over").isNull() | (F.col("seq") <= F.col("over")))
    is_root = F.col("seq") == F.col("root")
    level = F.when(is_root, 1).when(inner, F.col("depth")).when(shut, F.col("was")).otherwise(F.col("depth"))
    closing = shut & ((F.col("was") > 1) | last)
    e = e.withColumn("level", level)
    by_level = in_page("level")
    e = e.withColumn("closes", F.first(F.when(closing, F.col("seq")), ignorenulls=True).over(by_level.rowsBetween(1, Window.unboundedFollowing)))
    named = F.when(F.col("id") != "", F.col("id")).otherwise(F.get(F.filter(F.split("cls", r"\s+"), lambda c: F.startswith(c, F.lit(section_prefix))), F.lit(0)))
    begun = F.when(is_root | inner, F.struct(F.col("seq").alias("block"), "closes", F.when(is_root, "root").otherwise(named).alias("name")))
    # Only texts and their tags matter from here on; end tags carry their block.
    e = e.withColumn("within", F.when(end(*TEXT_TAGS), carried(begun, by_level))).filter(start(*TEXT_TAGS) | end(*TEXT_TAGS) | (F.col("ev") == "data"))
    texts = stored(e.select("page_id", "seq", "ev", "tag", "data", ((F.col("seq") > F.col("root")) & start(*TEXT_TAGS)).alias("opens"), "within"), "zstd")

    e = texts.withColumn("piece", F.sum(F.col("opens").cast("int")).over(in_page())).filter("piece > 0").drop("opens")
    per_piece = Window.partitionBy("page_id", "piece")
    e = e.withColumn("opened", F.first("tag").over(in_page("piece")))
    e = e.withColumn("done", F.min(F.when((F.col("ev") == "end") & (F.col("tag") == F.col("opened")), F.col("seq"))).over(per_piece))
    pieces = e.filter(F.col("seq") <= F.col("done")).groupBy("page_id", "piece").agg(
        F.first("opened").alias("tag"),
        F.max_by("within", F.when(F.col("seq") == F.col("done"), 1)).alias("within"),
        clean(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("ev") == "data", F.struct("seq", "data")))), lambda p: p["data"]), "")).alias("text"),
    )
    pieces = pieces.filter("text <> '' AND within.closes IS NOT NULL").select("page_id", "within.*", "piece", "tag", "text")
    placed = F.struct("piece", "text")

    def texts_where(condition: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(condition, placed))), lambda x: x["text"])

    closed = stored(pieces.groupBy("page_id", "block", "closes", "name").agg(texts_where(F.col("tag") != "p").alias("headings"), texts_where(F.col("tag") == "p").alias("paragraphs")), "zstd")
    dropped(texts)
    # A section without a name is called by the number of blocks that were closed before it began.
    ends = closed.select("page_id", F.col("closes").alias("at"), F.lit(1).alias("n"), F.lit(None).cast("int").alias("block"))
    begins = closed.filter("name IS NULL").select("page_id", F.col("block").alias("at"), F.lit(0).alias("n"), "block")
    so_far = F.sum("n").over(Window.partitionBy("page_id").orderBy("at"))
    numbers = ends.unionByName(begins).withColumn("n", so_far).filter("block IS NOT NULL").select("page_id", "block", "n")
    useful = F.exists("paragraphs", lambda p: F.length(p) > 20) | F.exists("headings", lambda h: F.length(h) > 4)
    order = F.row_number().over(Window.partitionBy("page_id").orderBy("closes")) - 1
    # Names and places are found without the texts, which are shuffled once.
    marks = closed.filter(useful).select("page_id", "block", "closes", "name").join(numbers, ["page_id", "block"], "left")
    marks = marks.select("page_id", "block", order.alias("ord"), F.coalesce("name", F.concat(F.lit("block"), F.col("n").cast("string"))).alias("block_id"))
    return closed.select("page_id", "block", "headings", "paragraphs").join(marks, ["page_id", "block"]).select("page_id", "ord", "block_id", "headings", "paragraphs")


#: What links() needs of a page.
LINK_TAGS = ("script", "style", "a")


def links(events: DataFrame) -> DataFrame:
    """(page_id, seq, href) of links outside scripts and styles."""
    return outside(events, "script", "style").filter(start("a") & (F.coalesce("href", F.lit("")) != "")).select("page_id", "seq", "href")


def spec_violations(items: DataFrame, expected: int = SPEC_ROWS, markers: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, idx, problem) of tables with another number of rows, rows without key or value, or with a marker that
    must not appear.
    """
    counts = items.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") != expected)
    wrong = counts.select("page_id", F.lit(None).cast("int").alias("idx"), F.format_string(f"expected {expected} rows, got %d", "n").alias("problem"))
    value = F.array_join("lines", "\n")
    leak = F.lit(None).cast("string")
    for marker in reversed(markers):
        leak = F.when(F.contains(value, F.lit(marker)), F.lit(f"holds {marker}")).otherwise(leak)
    problem = F.when(F.coalesce("key", F.lit("")) == "", "no key").when(F.size("lines") <= 0, "no value").otherwise(leak)
    return wrong.unionByName(items.select("page_id", "idx", problem.alias("problem")).filter("problem IS NOT NULL"))


def validate_spec_items(items: DataFrame, expected: int = SPEC_ROWS, markers: tuple[str, ...] = ()) -> None:
    if first := spec_violations(items, expected, markers).orderBy("page_id", "idx").first():
        raise ValueError(f"page {first.page_id}, row {first.idx}: {first.problem}")


def unescape(c: Column) -> Column:
    def run(cells: pd.Series) -> pd.Series:
        return cells.map(lambda x: None if x is None else html_lib.unescape(x))

    return F.pandas_udf(run, "string")(c)


def sku_cell_text(raw: Column) -> Column:
    """Text of a cell: lines between br tags, cleaned, joined by `; `."""
    plain = unescape(F.regexp_replace(F.regexp_replace(raw, r"<br\s*/?>", "\n"), r"<[^>]+>", " "))
    return F.array_join(F.filter(F.transform(F.split(plain, "\n"), clean), lambda x: x != ""), "; ")


#: The comparison table's markup.
SKU_NAMES = r'(?s)<div class="model-base-info-subtitle">(.*?)</div>'
SKU_CELL = r'(?s)<div class="spec-item-list" data-spec-row="(\d+)">(.*?)</div>'


def sku_variants(pages: DataFrame, product: str | Column, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, col, code, full_name, row, value) of the rows in which a page's models differ.

    Models are called `product` (a name, or a column of the pages) and a code, in the order of the cells of each row. A page with a row that has not one
    cell for each model gives nothing at all.
    """
    name = product if isinstance(product, Column) else F.lit(product)
    page = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"), name.alias("product"))
    names = unescape(F.regexp_extract("html", SKU_NAMES, 1))
    code = F.regexp_extract_all(names, F.concat(F.lit(r"\Q"), F.col("product"), F.lit(r"\E ([A-Z0-9]+)")), F.lit(1))
    page = page.withColumn("codes", code).filter(F.size("codes") > 0)
    cells = page.select("page_id", F.size("codes").alias("n"), F.posexplode(F.arrays_zip(F.regexp_extract_all("html", F.lit(SKU_CELL), F.lit(1)).alias("row"), F.regexp_extract_all("html", F.lit(SKU_CELL), F.lit(2)).alias("raw"))).alias("at", "cell"))
    cells = cells.select("page_id", "n", "at", F.col("cell.row").cast("int").alias("row"), sku_cell_text(F.col("cell.raw")).alias("value"))
    rows = cells.groupBy("page_id", "row", "n").agg(F.count(F.lit(1)).alias("held"), F.count_distinct("value").alias("kinds"))
    sound = rows.groupBy("page_id").agg(F.bool_and(F.col("held") == F.col("n")).alias("sound")).filter("sound").select("page_id")
    differing = rows.filter("kinds > 1").select("page_id", "row").join(sound, "page_id")
    col = F.row_number().over(Window.partitionBy("page_id", "row").orderBy("at")) - 1
    values = cells.withColumn("col", col).join(differing, ["page_id", "row"])
    models = page.select("page_id", "product", F.posexplode("codes").alias("col", "code"))
    return values.join(models, ["page_id", "col"]).select("page_id", "col", "code", F.concat("product", F.lit(" "), "code").alias("full_name"), "row", "value")
