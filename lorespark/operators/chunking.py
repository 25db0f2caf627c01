"""Splitting pages into chunks: by page, sentence, paragraph, or fixed length.

All four are expressions and generators over (file, doc_ix, text, metadata);
no shuffle, except for the running index of ids over a whole file.
"""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.text import blank, col, stem, strip, suffix
from lorespark.operators.boundaries import Boundaries
from lorespark.sources.loaders import SPREADSHEETS

SEPARATOR = "\n\n"
MARK = "\x01"
#: Words before a full stop that do not end a sentence.
ABBREVIATIONS = ("Mr", "Mrs", "Ms", "Dr", "Prof", "St", "Fig", "Eq", "No", "vs", "cf", "al", "e.g", "i.e")


class Method(Enum):
    PAGE = "page"
    SENTENCE = "sentence"
    PARAGRAPH = "paragraph"
    FIXED = "fixed"

    @classmethod
    def of(cls, name: str, compat: bool = False) -> Method:
        """By name or interface label. With ``compat`` only the Chinese labels mean what they say, all else is fixed length."""
        chinese = {"按页": cls.PAGE, "按句子": cls.SENTENCE, "按段落": cls.PARAGRAPH}
        english = {"by page": cls.PAGE, "by sentence": cls.SENTENCE, "by paragraph": cls.PARAGRAPH} | {m.value: m for m in cls}
        return chinese.get(name, cls.FIXED if compat else english.get(name.lower(), cls.FIXED))


def preclean_pdf(text: Column | str) -> Column:
    """Bullets go, words broken at line ends are joined, white space runs become one space."""
    t = F.regexp_replace(F.replace(col(text), F.lit("•"), F.lit("")), r"(?U)-\s*\n", "")
    return F.regexp_replace(t, r"(?U)\s+", " ")


def preclean_markdown(text: Column | str) -> Column:
    return F.regexp_replace(col(text), "\n{3,}", "\n\n")


def preclean(text: Column | str, ext: Column | str) -> Column:
    e = col(ext)
    return F.when(e == ".pdf", preclean_pdf(text)).when(e.isin(".md", ".markdown"), preclean_markdown(text)).otherwise(col(text))


def sentences(text: Column | str, guard: bool = True) -> Column:
    """Sentences end at . ! or ? before white space, unless ``guard`` knows the word before as an abbreviation."""
    before = "".join(rf"(?<!\b{a.replace('.', chr(92) + '.')})" for a in ABBREVIATIONS) if guard else ""
    marked = F.regexp_replace(col(text), rf"(?U){before}([.!?])\s+", f"$1{MARK}")
    return F.filter(F.split(marked, MARK, -1), lambda s: ~blank(s))


def paragraphs(text: Column | str, ext: Column | str | None = None) -> Column:
    """(index before blank ones went, stripped text) of each paragraph; spreadsheets are split by line."""
    parts = F.split(col(text), SEPARATOR, -1)
    if ext is not None:
        parts = F.when(col(ext).isin(*SPREADSHEETS), F.split(col(text), "\n", -1)).otherwise(parts)
    numbered = F.transform(parts, lambda p, i: F.struct(i.alias("i"), strip(p).alias("text")))
    return F.filter(numbered, lambda p: p["text"] != "")


def fixed_length(text: Column | str, size: int = 400, overlap: int = 50, separator: str = SEPARATOR) -> Column:
    """Pieces between separators merged to at most ``size`` characters; a longer piece stays whole.

    When the next piece does not fit, the chunk is emitted and pieces leave on
    the left until what stays is at most ``overlap`` long and leaves room for
    it. The state keeps the width of what is held, so a step costs what leaves.
    """
    pieces = F.filter(F.split(col(text), separator, -1), lambda p: p != "")
    gap = len(separator)
    none = F.array().cast("array<string>")

    def step(s: Column, p: Column) -> Column:
        held, size_of = s["cur"], F.length(p)
        fits = (F.size(held) == 0) | (s["width"] + gap + size_of <= size)
        joined = F.struct(s["out"].alias("out"), F.array_append(held, p).alias("cur"), F.when(F.size(held) == 0, size_of).otherwise(s["width"] + gap + size_of).alias("width"))

        def leave(t: Column, h: Column) -> Column:
            stays = (t["width"] <= overlap) & ((t["n"] == 0) | (t["width"] + gap + size_of <= size))
            rest = F.when(t["n"] == 1, 0).otherwise(t["width"] - F.length(h) - gap)
            return F.when(stays, t).otherwise(F.struct(rest.alias("width"), (t["n"] - 1).alias("n")))

        def emitted(t: Column) -> Column:
            kept = F.slice(held, F.size(held) - t["n"] + 1, t["n"])
            out = F.array_append(s["out"], F.array_join(held, separator))
            return F.struct(out.alias("out"), F.array_append(kept, p).alias("cur"), F.when(t["n"] == 0, size_of).otherwise(t["width"] + gap + size_of).alias("width"))

        left = F.aggregate(held, F.struct(s["width"].alias("width"), F.size(held).alias("n")), leave)
        return F.when(fits, joined).otherwise(F.element_at(F.transform(F.array(left), emitted), 1))

    begin = F.struct(none.alias("out"), none.alias("cur"), F.lit(0).alias("width"))
    merged = F.aggregate(pieces, begin, step, lambda s: F.when(F.size(s["cur"]) > 0, F.array_append(s["out"], F.array_join(s["cur"], separator))).otherwise(s["out"]))
    return F.filter(F.transform(merged, strip), lambda c: c != "")


def merge_metadata(metadata: Column, chunk_id: Column) -> Column:
    """The page's metadata with the chunk's id, which wins over one that was there."""
    rest = F.map_filter(F.coalesce(metadata, F.create_map().cast("map<string,string>")), lambda k, _: k != "chunk_id")
    return F.map_concat(rest, F.create_map(F.lit("chunk_id"), chunk_id))


def count_parts(method: Method, text: Column | str = "text", ext: Column | str = "ext", size: int = 400, overlap: int = 50, guard: bool = True) -> Column:
    """How many chunks a page gives; null text gives none."""
    parts = {Method.PAGE: F.array(col(text)), Method.SENTENCE: sentences(text, guard), Method.PARAGRAPH: paragraphs(text, ext), Method.FIXED: fixed_length(text, size, overlap)}[method]
    return F.when(col(text).isNull(), 0).otherwise(F.size(parts))


def chunk(pages: DataFrame, method: Method = Method.SENTENCE, size: int = 400, overlap: int = 50, compat_ids: bool = False, guard: bool = True, boundaries: Boundaries | None = None) -> DataFrame:
    """``pages`` (file, doc_ix, text, metadata) as chunks: file, stem, doc_ix, pos, chunk_id, chunk_text, metadata.

    Ids of sentences and paragraphs count within a page. Pages after the first
    name theirs, so that ids do not collide in a file of several pages;
    ``compat_ids`` leaves that out. Null text gives no chunk. Sentences end where
    ``boundaries`` that were learned say, else by the fixed rule.
    """
    name = stem("file")
    page = F.lit("") if compat_ids else F.when(F.col("doc_ix") > 0, F.concat(F.lit("_p"), F.col("doc_ix"))).otherwise("")
    base = pages.filter("text is not null").withColumn("ext", suffix("file"))
    if method is Method.PARAGRAPH:
        split = base.select("*", F.inline(paragraphs("text", "ext")).alias("pos", "chunk_text"))
    else:
        parts = {Method.PAGE: F.array("text"), Method.SENTENCE: boundaries.sentences("text") if boundaries else sentences("text", guard), Method.FIXED: fixed_length("text", size, overlap)}[method]
        split = base.select("*", F.posexplode(parts).alias("pos", "chunk_text"))
    kind = {Method.SENTENCE: "_sent", Method.PARAGRAPH: "_para"}.get(method)
    if kind:
        own = F.concat(name, page, F.lit(kind), F.col("pos"))
        split = split.withColumn("chunk_id", own).withColumn("metadata", merge_metadata(F.col("metadata"), own))
    else:
        split = split.withColumn("chunk_id", F.try_element_at("metadata", F.lit("chunk_id")))
    split = split.withColumn("stem", name)
    return back_fill(split) if not kind else split.select("file", "stem", "doc_ix", "pos", "chunk_id", "chunk_text", "metadata")


def back_fill(chunks: DataFrame) -> DataFrame:
    """Chunks without an id get ``{stem}_chunk{i}``, i running over the whole file."""
    place = F.row_number().over(Window.partitionBy("file").orderBy("doc_ix", "pos")) - 1
    own = F.when(blank("chunk_id"), F.concat(F.col("stem"), F.lit("_chunk"), place)).otherwise(F.col("chunk_id"))
    filled = chunks.withColumn("chunk_id", own)
    return filled.withColumn("metadata", merge_metadata(F.col("metadata"), F.col("chunk_id"))).select("file", "stem", "doc_ix", "pos", "chunk_id", "chunk_text", "metadata")
