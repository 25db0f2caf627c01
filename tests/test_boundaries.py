"""Learned sentence boundaries."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lorespark.operators import boundaries
from lorespark.operators.boundaries import Boundaries


@pytest.fixture(scope="module")
def corpus():
    """Texts with made-up abbreviations that no list has, and the sentences they were made of."""
    rng = random.Random(5)
    plain = ["".join(rng.choices("bdfgklmnprst", k=1)) + "".join(rng.choices("aeioulnrst", k=rng.randint(3, 8))) for _ in range(400)]
    texts = []
    for _ in range(300):
        said = []
        for _ in range(rng.randint(2, 6)):
            words = rng.choices(plain, k=rng.randint(4, 10))
            if rng.random() < 0.5:
                words.insert(rng.randint(1, len(words) - 1), rng.choice(["zq.", "kv.x.", "Xyd."]))
            start = rng.choice(["The", "Thus", words[0].capitalize()])
            said.append(" ".join([start, *words]) + rng.choice([".", ".", ".", "?", "!"]))
        texts.append(said)
    return texts


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame([(i, " ".join(s)) for i, s in enumerate(corpus)] + [(-1, None), (-2, ""), (-3, " . ")], "doc_id long, text string")


def test_made_up_abbreviations_are_learned(spark, docs, corpus):
    learned = boundaries.learn(docs)
    table = Boundaries.of(learned)
    assert set(table.abbreviations) == {"zq", "kv.x", "xyd"} and "the" in table.starters and "thus" in table.starters
    again = Boundaries.of(boundaries.learn(docs.repartition(7)))
    assert (set(again.abbreviations), set(again.starters)) == (set(table.abbreviations), set(table.starters))
    got = {r.doc_id: r.s for r in docs.select("doc_id", table.sentences("text").alias("s")).collect()}
    assert got[-1] is None and got[-2] == []
    right = sum(got[i] == said for i, said in enumerate(corpus))
    assert right >= 0.97 * len(corpus)
    fixed = {r.doc_id: r.s for r in docs.select("doc_id", boundaries.Boundaries().sentences("text").alias("s")).collect()}
    assert sum(fixed[i] == said for i, said in enumerate(corpus)) < 0.4 * len(corpus)


def test_scores_are_the_published_ones(spark):
    counts = Counter({("ab", True): 8, ("ab", False): 1, ("c.d", True): 3, ("long", True): 5, ("long", False): 60, ("word", False): 123})
    rows = [(w, n if s else 0, 0 if s else n) for (w, s), n in counts.items()]
    table = spark.createDataFrame(rows, "type string, with_stop long, without_stop long").groupBy("type").agg(F.sum("with_stop").alias("with_stop"), F.sum("without_stop").alias("without_stop"))
    n, stops = sum(counts.values()), sum(v for (_, s), v in counts.items() if s)
    p = stops / n

    def score(w):
        a, b, dots = counts[w, True], counts[w, False], w.count(".")
        ratio = -2 * (a * math.log(p) + b * math.log(1 - p) - a * math.log(0.99) - b * math.log(0.01))
        return ratio * math.exp(-(len(w) - dots)) * (dots + 1) * (len(w) - dots) ** -b

    want = {w: score(w) for w in ("ab", "c.d", "long") if score(w) >= 0.3}
    assert {r.type: pytest.approx(r.score) for r in boundaries.abbreviations(table).collect()} == want and want


def test_numbers_initials_and_white_space(spark):
    table = Boundaries(("dr",), ("the",), ("3 mai",))
    rows = [("Dr. Who came. The end.",), ("It was Dr. The end.",), ("J. R. Smith\n\tleft.  Then.",), ("On the 3. of May. 4. Then.",), ("Why?! No...  Yes.",), ("no end",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(table.sentences("t")).collect()]
    assert got == [["Dr. Who came.", "The end."], ["It was Dr.", "The end."], ["J. R. Smith\n\tleft.", "Then."], ["On the 3. of May.", "4.", "Then."], ["Why?!", "No...", "Yes."], ["no end"]]


def test_empty_corpus(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert boundaries.learn(none).count() == 0 and Boundaries.of(boundaries.learn(none)) == Boundaries()


def test_types_are_counted_by_distinct_words(spark, docs):
    """The same counts as word by word, white space of all kinds included."""
    odd = spark.createDataFrame([(1, "Dr. Who came.　 12. 3,4 ... x.y. DR dr. (dr.) \u0085end.. ᠎a​b"), (2, None), (3, ""), (4, " \t\n")], "doc_id long, text string")
    for some in (odd, docs):
        by_word = {tuple(r) for r in boundaries.type_counts(boundaries.words(some)).collect()}
        assert {tuple(r) for r in boundaries.count_types(some).collect()} == by_word and by_word
    spaces = spark.range(0x10000).filter("id < 55296 or id > 57343").selectExpr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE') as c")
    assert spaces.filter(F.col("c").rlike(r"(?U)\s") != F.col("c").rlike(boundaries.SPACES)).count() == 0 and spaces.filter(F.col("c").rlike(boundaries.SPACES)).count() == 25
