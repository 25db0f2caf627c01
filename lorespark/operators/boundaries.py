"""Sentence boundaries learned from the texts themselves, without labels.

What a full stop means is told by counts (Kiss and Strunk, "Unsupervised
multilingual sentence boundary detection", 2006). A word is an abbreviation if
it comes with a full stop more surely than chance allows: a log-likelihood
ratio, scaled by how short it is, its inner stops, and how often it comes
without. Words that follow certain sentence ends more often than chance are
starters; pairs of a number or an initial and the next word that hold together
across a full stop are collocations.

Training is counting: words are split, counted with map-side combining, and
judged by expressions; what is kept is a small table of types that passed a
test, written once. Splitting is an expression over that table's words. Counts
do not depend on the order of rows, so a retry learns the same table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.functions.text import blank, col

#: Scores from which on a type is an abbreviation, a starter, a collocation (the published values).
ABBREVIATION, STARTER, COLLOCATION = 0.3, 30.0, 7.88
#: How surely an abbreviation has its full stop.
SURE = 0.99
#: Types of each kind that a splitter holds; the surest are taken.
HELD = 5_000
MARK = "\x01"
#: Runs of Unicode's white space, by name: faster than ``(?U)\\s+``.
SPACES = r"[\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
NUMBER = "##number##"
LEARNED = "kind string, first string, second string, score double"


def _trimmed(word: Column) -> Column:
    """A word without marks around it, its full stop kept."""
    return F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.]+$", "")


def _type(word: Column) -> Column:
    """What a word counts as: lower case, without its last full stop; numbers are one type."""
    bare = F.lower(F.regexp_replace(_trimmed(word), r"\.$", ""))
    return F.when(bare.rlike(r"^[0-9][0-9.,-]*$"), NUMBER).otherwise(bare)


def _stopped(word: Column) -> Column:
    t = _trimmed(word)
    return t.endswith(".") & ~t.endswith("..")


def words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(type, stopped, next, upper) of every word: its type, whether a full stop ends it, the next word's type in the same text and whether that begins with a capital."""
    told = F.transform(F.split(text, SPACES, -1), lambda w: F.struct(_type(w).alias("type"), _stopped(w).alias("stopped"), _trimmed(w).rlike(r"^\p{Lu}").alias("upper")))
    parts = F.filter(told, lambda w: w["type"] != "")
    following = lambda i: F.get(F.col("parts"), i + 1)
    seen = F.transform(F.col("parts"), lambda w, i: F.struct(w["type"].alias("type"), w["stopped"].alias("stopped"), following(i)["type"].alias("next"), following(i)["upper"].alias("upper")))
    return docs.filter(F.col(text).isNotNull()).select(parts.alias("parts")).select(F.explode(seen).alias("w")).select("w.*")


def type_counts(seen: DataFrame) -> DataFrame:
    """(type, with_stop, without_stop)."""
    return seen.groupBy("type").agg(F.count_if("stopped").alias("with_stop"), F.count_if(~F.col("stopped")).alias("without_stop"))


def count_types(docs: DataFrame, text: str = "text") -> DataFrame:
    """``type_counts`` of all words of the texts: equal words are counted first, so that each is looked at once."""
    each = docs.filter(F.col(text).isNotNull()).select(F.explode(F.split(text, SPACES, -1)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    typed = each.select(_type(F.col("word")).alias("type"), _stopped(F.col("word")).alias("stopped"), "n").filter("type <> ''")
    return typed.groupBy("type").agg(F.sum(F.when(F.col("stopped"), F.col("n")).otherwise(0)).alias("with_stop"), F.sum(F.when(F.col("stopped"), 0).otherwise(F.col("n"))).alias("without_stop"))


def abbreviations(counts: DataFrame) -> DataFrame:
    """(type, score) of every type that is an abbreviation by its counts."""
    total = counts.agg(F.sum(F.col("with_stop") + F.col("without_stop")).alias("n"), F.sum("with_stop").alias("stops"))
    a, b, p = F.col("with_stop"), F.col("without_stop"), F.col("stops") / F.col("n")
    chance = a * F.log(p) + b * F.log(1 - p)
    surely = a * F.log(F.lit(SURE)) + b * F.log(F.lit(1 - SURE))
    inner = F.length("type") - F.length(F.replace("type", F.lit("."), F.lit("")))
    size = F.length("type") - inner
    score = -2 * (chance - surely) * F.exp(-size) * (inner + 1) * F.pow(size, -b)
    fit = counts.filter((a > 0) & F.col("type").rlike(r"\p{L}") & (F.col("type") != NUMBER)).join(F.broadcast(total), F.lit(True))  # one row of totals
    return fit.filter((F.col("stops") < F.col("n")) & (p < SURE)).select("type", score.alias("score")).filter(F.col("score") >= ABBREVIATION)


def _ratio(ab: Column, a: Column, b: Column, n: Column) -> Column:
    """Dunning's log-likelihood ratio of two events that met ``ab`` times."""
    part = lambda k, m, p: F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(m - k > 0, (m - k) * F.log(1 - p)).otherwise(0.0)
    p, p1, p2 = b / n, ab / a, F.when(n > a, (b - ab) / (n - a)).otherwise(0.0)
    return -2 * (part(ab, a, p) + part(b - ab, n - a, p) - part(ab, a, p1) - part(b - ab, n - a, p2))


def learn(docs: DataFrame, text: str = "text") -> DataFrame:
    """The table of what was learned (``LEARNED``): abbreviations, starters and collocations with their scores."""
    seen = words(docs, text)
    counts = count_types(docs, text)
    short = abbreviations(counts)
    total = F.broadcast(counts.agg(F.sum(F.col("with_stop") + F.col("without_stop")).cast("double").alias("n")))
    single = F.col("type").rlike(r"^\p{L}$")
    often = counts.select(F.col("type").alias("word"), (F.col("with_stop") + F.col("without_stop")).cast("double").alias("b"))
    after = seen.filter("stopped and next is not null")
    # a full stop ends a sentence for certain where nothing speaks against it
    ends = after.filter(~single & (F.col("type") != NUMBER)).join(short.select(F.col("type").alias("short")), F.col("type") == F.col("short"), "left_anti")
    breaks = F.broadcast(ends.agg(F.count(F.lit(1)).cast("double").alias("a")))
    begun = ends.filter("upper").groupBy("next").agg(F.count(F.lit(1)).cast("double").alias("ab"))
    starters = begun.join(often, F.col("next") == F.col("word")).join(breaks, F.lit(True)).join(total, F.lit(True))
    starters = starters.filter((F.col("next") != NUMBER) & (F.col("ab") / F.col("a") > F.col("b") / F.col("n"))).select("next", _ratio(F.col("ab"), F.col("a"), F.col("b"), F.col("n")).alias("score")).filter(F.col("score") >= STARTER)
    met = after.filter(single | (F.col("type") == NUMBER)).groupBy("type", "next").agg(F.count(F.lit(1)).cast("double").alias("ab")).filter("ab > 1")
    firsts = counts.select(F.col("type").alias("left"), (F.col("with_stop") + F.col("without_stop")).cast("double").alias("a"))
    pairs = met.join(firsts, F.col("type") == F.col("left")).join(often, F.col("next") == F.col("word")).join(total, F.lit(True))
    pairs = pairs.filter(F.col("ab") / F.col("a") > F.col("b") / F.col("n")).select("type", "next", _ratio(F.col("ab"), F.col("a"), F.col("b"), F.col("n")).alias("score")).filter(F.col("score") >= COLLOCATION)
    none = F.lit(None).cast("string")
    rows = short.select(F.lit("abbreviation").alias("kind"), F.col("type").alias("first"), none.alias("second"), "score")
    rows = rows.unionByName(starters.select(F.lit("starter").alias("kind"), F.col("next").alias("first"), none.alias("second"), "score"))
    return rows.unionByName(pairs.select(F.lit("collocation").alias("kind"), F.col("type").alias("first"), F.col("next").alias("second"), "score"))


@dataclass(frozen=True)
class Boundaries:
    """What a splitter knows."""

    abbreviations: tuple[str, ...] = ()
    starters: tuple[str, ...] = ()
    collocations: tuple[str, ...] = field(default=())

    @classmethod
    def of(cls, learned: DataFrame, held: int = HELD) -> Boundaries:
        """From a table of ``learn``; of each kind the ``held`` surest."""
        kinds = {kind: [] for kind in ("abbreviation", "starter", "collocation")}
        for kind, found in kinds.items():
            top = learned.filter(F.col("kind") == kind).orderBy(F.col("score").desc(), "first", "second").limit(held)
            found += [r.first if r.second is None else f"{r.first} {r.second}" for r in top.collect()]
        return cls(*map(tuple, kinds.values()))

    def sentences(self, text: Column | str) -> Column:
        """The sentences of a text: they end at . ! or ? before white space, unless what was learned says otherwise."""
        pieces = F.split(col(text), r"(?U)(?<=[.!?])(?=\s)", -1)
        among = lambda x, known: x.isin(*known) if known else F.lit(False)
        last = lambda p: F.element_at(F.split(p, r"(?U)\s+", -1), -1)
        first = lambda p: F.regexp_extract(p, r"(?U)^\s*(\S+)", 1)

        def held(before: Column, after: Column) -> Column:
            """Whether the full stop between two pieces ends no sentence."""
            word, following = _type(last(before)), _type(first(after))
            initial = word.rlike(r"^\p{L}$")
            opens = among(following, self.starters) & _trimmed(first(after)).rlike(r"^\p{Lu}")
            small = _trimmed(first(after)).rlike(r"^\p{Ll}")
            short = among(word, self.abbreviations) | initial
            return _stopped(last(before)) & (among(F.concat_ws(" ", word, following), self.collocations) | (short & ~opens) | ((word == NUMBER) & small))

        joined = F.transform(pieces, lambda p, i: F.when(i == 0, p).when(held(F.get(pieces, i - 1), p), p).otherwise(F.concat(F.lit(MARK), F.regexp_replace(p, r"(?U)^\s+", ""))))
        return F.filter(F.split(F.array_join(joined, ""), MARK, -1), lambda s: ~blank(s))
