"""Deep cleaning of extracted text, as expressions on one text column.

The steps run in the order of ``clean_text``. Step 3 of ``normalize_whitespace``
joins single line breaks before step 4 looks for broken words, so a word broken
over one line end keeps its hyphen; that is part of the contract.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorespark.functions.text import blank, col, join_lines, lines, squeeze, strip

# The characters that count as odd spaces.
WIDE_SPACES = "\u3000\u00a0" + "".join(map(chr, range(0x2002, 0x200B)))
CONTROL_SPACES = "\t\x0b\x0c\u2028\u2029"

# Lines with which the body of a paper begins, by priority.
BODY_STARTS = (r"(?U)\A\s*前言\b|\A\s*目\s*录\b", r"(?iuU)\bAbstract\b|\b摘要\b|\bINTRODUCTION\b")

# What a line of a list of references begins with.
REFERENCE_LINES = (
    r"\[\d+\]",
    r"\[J\]\.?",
    r"\[M\]\.?",
    r"\d{1,4}[\.）]\s+",
    r"\d{4}(?:年|;)\s*\d+",
    r"\d{4}[:,]\d{1,4}",
    r"doi[:：]\S+",
    r"https?://\S+",
    r"[A-Za-z]{2,}(?:[A-Za-z0-9\-,']+),",
    r"[A-Z][A-Za-z0-9\-\’&, ]{10,}\.\s+[A-Z]",
    r"[\u4e00-\u9fa5]{2,}(?:,|，|、).{5,}?[\.。]\s*[\u4e00-\u9fa5A-Za-z]",
    r".+?,\s*\d{4},\s*\d{1,4}:\d{1,5}(?:-\d{1,5})?",
)
MIN_REFERENCES, MAX_OTHERS = 2, 7


def unify_spaces(text: Column | str) -> Column:
    """Odd spaces and control white space become plain spaces, runs of them one; newlines stay."""
    odd = WIDE_SPACES + CONTROL_SPACES
    return squeeze(F.translate(col(text), odd, " " * len(odd)))


def normalize_whitespace(text: Column | str) -> Column:
    wide = F.contains(col(text), F.lit("\u3000")) | F.contains(col(text), F.lit("\u200b"))
    t = F.when(wide, F.translate(col(text), "\u3000\u200b", " ")).otherwise(col(text))
    t = F.regexp_replace(t, "\n{3,}", "\n\n")
    t = F.regexp_replace(t, "\n(?<!\n\n)(?<![。！？.!?]\n)(?!\n)", " ")  # the newline first: it is what is rare
    t = F.when(F.contains(t, F.lit("-")), F.regexp_replace(t, r"(?U)(?<!\w)(\w++)-\s*\n\s*(\w+)", "$1$2")).otherwise(t)
    return join_lines(F.transform(lines(t), lambda x: squeeze(strip(x))))


#: Lower-case parts of those words, one of which a line must hold to match: cheaper to look for than the patterns.
BODY_PARTS = (("前言", "目"), ("tract", "摘要", "ntroduct"))


def body_start(text: Column | str) -> Column:
    """Drops the lines before the first one that begins the body; text without such a line stays."""
    all_lines = lines(text)

    def place(pattern: str, parts: tuple[str, ...]) -> Column:
        def begins(x: Column) -> Column:
            some = reduce(Column.__or__, [F.contains(F.lower(x), F.lit(w)) for w in parts])
            return F.when(some, x.rlike(pattern)).otherwise(False)

        return F.nullif(F.array_position(F.transform(all_lines, begins), F.lit(True)), F.lit(0).cast("long"))

    def rest(at: Column) -> Column:
        return F.when(at.isNull(), col(text)).otherwise(join_lines(F.slice(all_lines, at.cast("int"), F.size(all_lines))))

    # the place is bound once, else each use of it would look for it again
    return F.element_at(F.transform(F.array(F.coalesce(*map(place, BODY_STARTS, BODY_PARTS))), rest), 1)


def is_reference(line: Column) -> Column:
    return line.rlike(r"(?isuU)\A\s*(?:" + "|".join(REFERENCE_LINES) + ")")


def drop_references(text: Column | str, min_references: int = 1, max_others: int = MAX_OTHERS) -> Column:
    """Cuts the list of references at the text's end.

    One pass from the last line up keeps the index of the topmost reference
    seen once there are ``min_references``; ``max_others`` other lines in a row
    end it. Everything from that index on goes.
    """
    all_lines = lines(text)
    n = F.size(all_lines)
    numbered = F.reverse(F.transform(all_lines, lambda x, i: F.struct(x.alias("line"), i.alias("i"))))
    begin = F.struct(F.lit(0).alias("seen"), F.lit(0).alias("others"), n.alias("cut"), F.lit(False).alias("done"))

    def step(s: Column, x: Column) -> Column:
        def moved(ref: Column) -> Column:
            seen = s["seen"] + F.when(ref, 1).otherwise(0)
            others = F.when(ref, 0).when(s["seen"] >= min_references, s["others"] + 1).otherwise(s["others"])
            cut = F.when(ref & (seen >= min_references), x["i"]).otherwise(s["cut"])
            return F.struct(seen.alias("seen"), others.alias("others"), cut.alias("cut"), (others >= max_others).alias("done"))

        # a line is tested once, and not at all after the end of the list was found
        return F.when(s["done"], s).otherwise(F.element_at(F.transform(F.array(is_reference(x["line"])), moved), 1))

    def kept(s: Column) -> Column:
        return F.when(s["cut"] < n, join_lines(F.slice(all_lines, F.lit(1), s["cut"]))).otherwise(col(text))

    return F.aggregate(numbered, begin, step, kept)


def drop_brackets(text: Column | str) -> Column:
    """Citation marks ``[n]`` and ``( n )``."""
    return F.regexp_replace(F.regexp_replace(col(text), r"(?U)\[\d+\]", ""), r"(?U)\(\s*\d+\s*\)", "")


def drop_footnote(text: Column | str) -> Column:
    """A footnote mark of one or two digits at the end of the whole text."""
    return F.regexp_replace(col(text), r"(?Ud)(?<=\S)\s+\d{1,2}(?=[.,]?$)", "")


def drop_page_numbers(text: Column | str) -> Column:
    """Lines that only hold a page number become empty."""
    return F.regexp_replace(col(text), r"(?Umd)^\s*(?:Page\s*\d+|第\s*\d+\s*页|\d+)\s*$", "")


def drop_blank_lines(text: Column | str) -> Column:
    return strip(join_lines(F.filter(lines(text), lambda x: ~blank(x))))


def clean_text(text: Column | str) -> Column:
    """All steps in order; null stays null."""
    t = body_start(normalize_whitespace(unify_spaces(text)))
    t = drop_references(t, MIN_REFERENCES, MAX_OTHERS)
    return drop_blank_lines(drop_page_numbers(drop_footnote(drop_brackets(t))))


def clean_stages(df, text: str = "text"):
    """``df`` with ``cleaned``, ``lines_before`` and ``lines_after`` (around the cut of references).

    One projection per step, so that no step's expression is repeated inside the next.
    """
    df = df.withColumn("__t", unify_spaces(text)).withColumn("__t", normalize_whitespace("__t")).withColumn("__t", body_start("__t"))
    df = df.withColumn("lines_before", F.size(lines("__t"))).withColumn("__t", drop_references("__t", MIN_REFERENCES, MAX_OTHERS)).withColumn("lines_after", F.size(lines("__t")))
    for step in (drop_brackets, drop_footnote, drop_page_numbers, drop_blank_lines):
        df = df.withColumn("__t", step("__t"))
    return df.withColumnRenamed("__t", "cleaned")
