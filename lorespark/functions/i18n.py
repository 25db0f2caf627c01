"""Interface strings by language, tab and key. Any language but the Chinese one reads English."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions.templates import CHINESE

_TEXT = {
    ("app", "title"): ("Literature workbench", "文献工作台"),
    ("app", "language"): ("Language", "语言"),
    ("library", "chunking"): ("Chunking method", "分块方式"),
    ("library", "by_page"): ("By Page", "按页"),
    ("library", "by_sentence"): ("By Sentence", "按句子"),
    ("library", "by_paragraph"): ("By Paragraph", "按段落"),
    ("library", "by_length"): ("Fixed Length", "固定长度"),
    ("library", "progress"): ("Embedded share", "嵌入进度"),
    ("library", "no_chunks"): ("No chunks for: ", "没有分块的文件："),
    ("review", "not_found"): ("[Not found]", "未找到"),
    ("review", "unknown"): ("unknown", "未知"),
    ("review", "question"): ("Question", "问题"),
    ("cards", "qa"): ("Q&A", "问答"),
    ("cards", "cloze"): ("Cloze", "填空"),
    ("cards", "export"): ("Export", "导出"),
}
# The choices that the interface offers.
MODELS = ["gpt-4o", "gpt-4o-mini", "qwen-max", "qwen-plus", "qwen-turbo"]
CARD_TYPES = {"en": ["q&a", "cloze"], CHINESE: ["问答", "填空"]}
TOP_K_DEFAULTS = {"review": 15, "cards": 10, "legacy": 5}


def get_text(lang: str, tab: str, key: str) -> str:
    return _TEXT[tab, key][lang == CHINESE]


def strings(spark: SparkSession) -> DataFrame:
    """All strings as (lang, tab, key, value)."""
    rows = [(lang, tab, key, values[i]) for (tab, key), values in _TEXT.items() for i, lang in enumerate(("en", CHINESE))]
    return spark.createDataFrame(rows, "lang string, tab string, key string, value string")


def lookup(requests: DataFrame) -> DataFrame:
    """``requests`` (lang, tab, key) with ``value``; null for an unknown key. The strings are a small fixed table."""
    known = F.broadcast(strings(requests.sparkSession).withColumnRenamed("lang", "of"))
    of = F.when(F.col("lang") == CHINESE, F.lit(CHINESE)).otherwise("en")
    return requests.withColumn("of", of).join(known, ["of", "tab", "key"], "left").select(*requests.columns, "value")
