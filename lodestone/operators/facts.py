"""Facts from rows of a specification: rules with one pattern each, and ports with their sides."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip


class Rule(NamedTuple):
    fact_id: str
    key_en: str
    label_zh: str
    label_en: str
    pattern: str
    template: str


#: Fact, key of the row, labels, pattern, and what is made of its group.
RULES = [
    Rule("cpu.model", "CPU", "處理器型號", "CPU model", r"(Intel[^()]*?Ultra\s+\d+\s+Processor\s+\w+)", r"\1"),
    Rule("cpu.cache", "CPU", "處理器快取", "CPU cache", r"(\d+MB)\s+cache", r"\1"),
    Rule("cpu.max_frequency", "CPU", "處理器最高時脈", "CPU max frequency", r"up to ([\d.]+ GHz)", r"\1"),
    Rule("cpu.cores", "CPU", "處理器核心數", "CPU cores", r"(\d+)\s+cores", r"\1 cores"),
    Rule("cpu.threads", "CPU", "處理器執行緒數", "CPU threads", r"(\d+)\s+threads", r"\1 threads"),
    Rule("gpu.model", "Video Graphics", "顯示晶片型號", "GPU model", r"(NVIDIA[^\n]*?GeForce RTX[^\n]*?Laptop GPU)", r"\1"),
    Rule("gpu.vram", "Video Graphics", "顯示記憶體", "GPU memory", r"(\d+GB\s+GDDR\d+)", r"\1"),
    Rule("gpu.max_graphics_power", "Video Graphics", "顯示晶片最大功耗", "GPU max graphics power", r"(\d+W)\s+Maximum Graphics Power", r"\1 (with Dynamic Boost)"),
    Rule("gpu.boost_clock", "Video Graphics", "顯示晶片boost時脈", "GPU boost clock", r"AI Boost\s*:\s*(\d+ MHz)", r"\1 (AI Boost)"),
    Rule("display.size", "Display", "螢幕尺寸", "Display size", r'(\d+)"', r"\1 inch"),
    Rule("display.aspect_ratio", "Display", "螢幕比例", "Display aspect ratio", r"(\d+:\d+)\b", r"\1"),
    Rule("display.panel", "Display", "面板類型", "Display panel type", r"\b(OLED|IPS|Mini LED)\b", r"\1"),
    Rule("display.resolution", "Display", "螢幕解析度", "Display resolution", r"\((\d{3,4}\s*[x×]\s*\d{3,4})\)", r"\1"),
    Rule("display.refresh_rate", "Display", "螢幕更新率", "Display refresh rate", r"(\d+)Hz", r"\1Hz"),
    Rule("display.response_time", "Display", "螢幕反應時間", "Display response time", r"(\d+)ms", r"\1ms"),
    Rule("display.color_gamut", "Display", "色域覆蓋", "Display colour gamut", r"(DCI?P?-?3\s*\d+%)", r"\1"),
    Rule("display.brightness", "Display", "螢幕亮度", "Display brightness", r"(\d+)nits \(peak\)", r"\1 nits (peak)"),
    Rule("display.contrast", "Display", "對比度", "Display contrast ratio", r"(\d{1,3}(?:,\d{3})+:1)", r"\1"),
    Rule("memory.max_capacity", "System Memory", "最大記憶體容量", "Maximum system memory", r"Up to (\d+GB)", r"\1"),
    Rule("memory.type", "System Memory", "記憶體型號", "Memory type", r"\b(DDR\d)\b", r"\1"),
    Rule("memory.speed", "System Memory", "記憶體時脈", "Memory speed", r"(\d{4}MHz)", r"\1"),
    Rule("memory.slots", "System Memory", "記憶體插槽", "Memory slots", r"(\d+)x SO-DIMM", r"\1 x SO-DIMM"),
    Rule("storage.max_capacity", "Storage", "最大儲存容量", "Maximum storage", r"Up to (\d+TB)", r"\1"),
    Rule("storage.gen5_slot", "Storage", "PCIe Gen5 M.2 插槽", "PCIe Gen5 M.2 slot", r"(\d+)x PCIe Gen5 M\.2 slot", r"\1 x PCIe Gen5 M.2"),
    Rule("storage.gen4_slot", "Storage", "PCIe Gen4 M.2 插槽", "PCIe Gen4 M.2 slot", r"(\d+)x PCIe Gen4x4 M\.2 slot", r"\1 x PCIe Gen4x4 M.2"),
    Rule("storage.interface", "Storage", "儲存介面", "Storage interface", "(PCIe NVMe™? M\\.2 SSD)", r"\1"),
    Rule("keyboard.backlight", "Keyboard Type", "鍵盤背光", "Keyboard backlight", r"([\w-]+ RGB Backlit Keyboard)", r"\1"),
    Rule("keyboard.key_travel", "Keyboard Type", "鍵程", "Key travel", r"Up to ([\d.]+mm) Key-travel", r"\1"),
    Rule("audio.speakers", "Audio", "喇叭配置", "Speakers", r"(\d+x \d+W speakers)", r"\1"),
    Rule("wireless.wifi", "Communications", "無線網路", "Wi-Fi", r"(WIFI \d[^\n]*)", r"\1"),
    Rule("wireless.bluetooth", "Communications", "藍牙版本", "Bluetooth", r"Bluetooth (v[\d.]+)", r"\1"),
    Rule("network.lan", "Communications", "有線網路", "Wired LAN", r"LAN:\s*(\w+)", r"\1"),
    Rule("webcam.resolution", "Webcam", "視訊鏡頭", "Webcam", r"(FHD \(1080p\) IR Webcam)", r"\1"),
    Rule("battery.capacity", "Battery", "電池容量", "Battery capacity", r"(\d+Wh)", r"\1"),
    Rule("battery.type", "Battery", "電池類型", "Battery type", r"\b(Li-ion)\b", r"\1"),
    Rule("adapter.power", "Adapter", "變壓器功率", "Adapter power", r"(\d+W)", r"\1"),
    Rule("dimensions.mm", "Dimensions (W x D x H)", "機身尺寸", "Dimensions", r"([\d.]+ x [\d.]+ x [\d.~]+ mm)", r"\1"),
    Rule("weight.kg", "Weight", "機身重量", "Weight", r"~?([\d.]+ kg)", r"\1"),
    Rule("color.name", "Color", "機身顏色", "Colour", r"^(.+)$", r"\1"),
]
IO_KEY = "I/O Port"
SIDE_LINE, PORT_LINE = r"(?i)^(Left|Right)\s+Side:", r"(?U)^(\d+)\s*x\s*(.+)$"
SIDE_ZH = {"Left": "左側", "Right": "右側"}
#: Fact, labels and the word that a port's description must have.
PORT_COUNTS = [
    ("io.count.usb_c", "Type-C 連接埠數量", "USB Type-C port count", "Type-C"),
    ("io.count.usb_a", "Type-A 連接埠數量", "USB Type-A port count", "Type-A"),
    ("io.count.thunderbolt", "Thunderbolt 連接埠數量", "Thunderbolt port count", "Thunderbolt"),
    ("io.count.hdmi", "HDMI 連接埠數量", "HDMI port count", "HDMI"),
]
PORT_SIDES = [
    ("io.side.thunderbolt5", "Thunderbolt 5 位置", "Thunderbolt 5 location", "Thunderbolt™5"),
    ("io.side.thunderbolt4", "Thunderbolt 4 位置", "Thunderbolt 4 location", "Thunderbolt™4"),
    ("io.side.hdmi", "HDMI 位置", "HDMI location", "HDMI"),
    ("io.side.rj45", "RJ-45 網路孔位置", "RJ-45 location", "RJ-45"),
    ("io.side.microsd", "MicroSD 讀卡機位置", "MicroSD reader location", "MicroSD"),
]
FACT_COLUMNS = ["page_id", "ord", "fact_id", "label_zh", "label_en", "value", "source_key_zh", "source_key_en", "extra"]


def rules_table(spark: SparkSession, rules: list[Rule] = RULES) -> DataFrame:
    rows = [(n, *r) for n, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule int, fact_id string, key_en string, label_zh string, label_en string, pattern string, template string")


def first_match(text: Column, pattern: Column | str, flags: str = "(?dmU)") -> Column:
    """The first group of a pattern's first match; null without one. Line ends are \\n only, as `^` and `$` see them."""
    p = F.concat(F.lit(flags), pattern) if isinstance(pattern, Column) else F.lit(flags + pattern)
    found = F.regexp_extract_all(text, p, F.lit(1))
    return F.get(found, F.lit(0))


def paired_rows(items_zh: DataFrame, items_en: DataFrame) -> DataFrame:
    """(page_id, idx, key_zh, key_en, lines, value): rows of both languages by place; of equal English keys the last."""
    zh = items_zh.select("page_id", "idx", F.col("key").alias("key_zh"))
    pairs = items_en.select("page_id", "idx", F.col("key").alias("key_en"), "lines").join(zh, ["page_id", "idx"])
    last = F.row_number().over(Window.partitionBy("page_id", "key_en").orderBy(F.desc("idx")))
    return pairs.withColumn("n", last).filter("n = 1").select("page_id", "idx", "key_zh", "key_en", "lines", F.array_join("lines", "\n").alias("value"))


def rule_facts(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """Facts of the rules whose key a row has and whose pattern matches; of one fact_id the first rule that does."""
    hit = pairs.join(F.broadcast(rules), "key_en").withColumn("got", first_match(F.col("value"), F.col("pattern")))
    value = strip(F.replace("template", F.lit("\\1"), F.col("got")))
    made = hit.filter("got IS NOT NULL").withColumn("value", value).filter("value <> ''")
    first = F.row_number().over(Window.partitionBy("page_id", "fact_id").orderBy("rule"))
    kept = made.withColumn("n", first).filter("n = 1")
    return kept.select("page_id", F.col("rule").alias("ord"), "fact_id", "label_zh", "label_en", "value", F.col("key_zh").alias("source_key_zh"), F.col("key_en").alias("source_key_en"), F.lit(None).cast("map<string,string>").alias("extra"))


def ports(rows: DataFrame) -> DataFrame:
    """(page_id, pos, side, count, description) of rows (page_id, lines): a side holds until the next one is named."""
    lines = rows.select("page_id", F.posexplode("lines").alias("pos", "line"))
    side = F.regexp_extract("line", SIDE_LINE, 1)
    named = F.when(side != "", F.initcap(side))
    above = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    tagged = lines.withColumn("named", named).withColumn("side", F.coalesce(F.last("named", ignorenulls=True).over(above), F.lit("Unknown")))
    count = F.regexp_extract("line", PORT_LINE, 1)
    found = tagged.filter(F.col("named").isNull()).withColumn("n", count).filter("n <> ''")
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("pos")) - 1
    return found.select("page_id", place.alias("pos"), "side", F.col("n").cast("int").alias("count"), strip(F.regexp_extract("line", PORT_LINE, 2)).alias("description"))


def port_facts(pairs: DataFrame) -> DataFrame:
    """A fact for each port, sums of ports by kind (none are left out), and the side of the first port of a kind."""
    io = pairs.filter(F.col("key_en") == IO_KEY)
    found = ports(io)
    side_zh = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SIDE_ZH.items() for x in kv]), F.col("side")), F.col("side"))
    no_extra = F.lit(None).cast("map<string,string>")
    single = found.select(
        "page_id",
        (1000 + F.col("pos")).alias("ord"),
        F.concat(F.lit("io.port."), F.col("pos").cast("string")).alias("fact_id"),
        F.concat(F.lit("連接埠（"), side_zh, F.lit("）")).alias("label_zh"),
        F.concat(F.lit("I/O port ("), F.col("side"), F.lit(" side)")).alias("label_en"),
        F.concat(F.col("count").cast("string"), F.lit(" x "), F.col("description")).alias("value"),
        F.create_map(F.lit("side"), F.col("side"), F.lit("count"), F.col("count").cast("string")).alias("extra"),
    )
    has = lambda word: F.contains("description", F.lit(word))
    sums = found.groupBy("page_id").agg(
        *[F.sum(F.when(has(word), F.col("count"))).alias(f"c{n}") for n, (_, _, _, word) in enumerate(PORT_COUNTS)],
        *[F.min_by("side", F.when(has(word), F.col("pos"))).alias(f"s{n}") for n, (_, _, _, word) in enumerate(PORT_SIDES)],
    )
    made = []
    for n, (fact, zh, en, _) in enumerate(PORT_COUNTS):
        made.append(F.struct(F.lit(2000 + n).alias("ord"), F.lit(fact).alias("fact_id"), F.lit(zh).alias("label_zh"), F.lit(en).alias("label_en"), F.nullif(F.col(f"c{n}"), F.lit(0)).cast("string").alias("value"), no_extra.alias("extra")))
    for n, (fact, zh, en, _) in enumerate(PORT_SIDES):
        side = F.col(f"s{n}")
        zh_side = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SIDE_ZH.items() for x in kv]), side), side)
        made.append(F.struct(F.lit(3000 + n).alias("ord"), F.lit(fact).alias("fact_id"), F.lit(zh).alias("label_zh"), F.lit(en).alias("label_en"), F.concat(zh_side, F.lit(" / "), side, F.lit(" side")).alias("value"), F.create_map(F.lit("side"), side).alias("extra")))
    totals = sums.select("page_id", F.inline(F.array(*made))).filter("value IS NOT NULL")
    keys = io.select("page_id", F.col("key_zh").alias("source_key_zh"), F.col("key_en").alias("source_key_en"))
    return single.unionByName(totals).join(keys, "page_id").select(*FACT_COLUMNS)


def extract_facts(items_zh: DataFrame, items_en: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """All facts of pages with rows in both languages; raises if their numbers of rows differ."""
    n_zh, n_en = (x.groupBy("page_id").agg(F.count(F.lit(1)).alias(n)) for x, n in ((items_zh, "zh"), (items_en, "en")))
    uneven = n_zh.join(n_en, "page_id", "full").filter(~F.col("zh").eqNullSafe(F.col("en"))).first()
    if uneven:
        raise ValueError(f"page {uneven.page_id} has {uneven.zh} and {uneven.en} rows in its two languages")
    pairs = paired_rows(items_zh, items_en)
    return rule_facts(pairs, rules_table(items_zh.sparkSession, rules)).unionByName(port_facts(pairs))

