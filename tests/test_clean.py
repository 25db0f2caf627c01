"""Cleaning and text functions against small Python versions of the same rules."""

from __future__ import annotations

import random
import re
from pathlib import PurePosixPath

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorespark.functions import clean, text


def apply(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").repartition(2)
    return [r.o for r in df.select("i", expression("t").alias("o")).orderBy("i").collect()]


SAMPLES = ["", " ", "a", "a  b\t c", "　x y ", "co-\nop", "para-\n\nnext", "a\nb.\nc\n\n\n\nd", "​z​", "ends。\nnext", "\x1c\x1dq\x1e", "tab\x0bv\x0cf l"]


def test_strip_and_blank(spark):
    assert apply(spark, SAMPLES, text.strip) == [s.strip() for s in SAMPLES]
    assert apply(spark, [*SAMPLES, None], text.blank) == [not s.strip() for s in SAMPLES] + [True]


def test_stem_and_suffix(spark):
    names = ["a.pdf", "a.tar.GZ", ".hidden", "noext", "a.b.", "x y.MD", "..a", "文.txt"]
    assert apply(spark, names, text.stem) == [PurePosixPath(n).stem for n in names]
    assert apply(spark, names, text.suffix) == [PurePosixPath(n).suffix.lower() for n in names]


def test_unify_spaces(spark):
    def plain(s):
        return re.sub(" {2,}", " ", re.sub("[　  - \t\x0b\x0c  ]", " ", s))

    assert apply(spark, SAMPLES, clean.unify_spaces) == [plain(s) for s in SAMPLES]


def plain_normal(s):
    s = re.sub("\n{3,}", "\n\n", s.replace("　", " ").replace("​", ""))
    s = re.sub("(?<!\n)(?<![。！？.!?])\n(?!\n)", " ", s)
    s = re.sub(r"(\w+)-\s*\n\s*(\w+)", r"\1\2", s)
    return "\n".join(re.sub(" {2,}", " ", x.strip()) for x in s.split("\n"))


def test_normalize_whitespace(spark):
    assert apply(spark, SAMPLES, clean.normalize_whitespace) == [plain_normal(s) for s in SAMPLES]
    assert apply(spark, ["co-\nop", "para-\n\nnext"], clean.normalize_whitespace) == ["co- op", "paranext"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab-. \n\t　。", max_size=25), min_size=40, max_size=40))
def test_normalize_whitespace_random(spark, values):
    assert apply(spark, values, clean.normalize_whitespace) == [plain_normal(v) for v in values]


def test_body_start(spark):
    cases = {"x\n前言\ny": "前言\ny", "x\n 目 录\ny": " 目 录\ny", "x\nan ABSTRACT here\n前言": "前言", "x\nan ABSTRACT here\ny": "an ABSTRACT here\ny", "x\n前言部分\ny": "x\n前言部分\ny", "abstracted": "abstracted", "": ""}
    assert apply(spark, list(cases), clean.body_start) == list(cases.values())


def test_reference_lines(spark):
    yes = ["[1] x", " [J].", "[m]", "12. Title", "3） x", "2020年 3", "2020;22", "2015:1234", "doi:10.1/x", "http://a.b", "However, so", "Sprint Research Group. Random", "王继光,谢良地,牟建军,等.独特", "Some Journal, 2019, 12:34-56"]
    no = ["So, then", "1) x", "plain words", "", "12.x", "ab"]
    assert apply(spark, yes + no, lambda c: clean.is_reference(F.col(c))) == [True] * len(yes) + [False] * len(no)


@pytest.mark.parametrize(("least", "most"), [(1, 7), (2, 7), (2, 3)])
def test_drop_references_random(spark, least, most):
    def plain(flags):
        seen = others = 0
        cut = len(flags)
        for i in range(len(flags) - 1, -1, -1):
            if flags[i]:
                seen, others = seen + 1, 0
                cut = i if seen >= least else cut
            elif seen >= least:
                others += 1
                if others >= most:
                    break
        return cut

    rng = random.Random(least * 10 + most)
    flags = [[rng.random() < rng.choice([0.1, 0.4]) for _ in range(rng.randint(1, 30))] for _ in range(300)]
    texts = ["\n".join(f"[{i}] ref" if f else f"line {i}" for i, f in enumerate(fs)) for fs in flags]
    want = ["\n".join(t.split("\n")[: plain(fs)]) for t, fs in zip(texts, flags)]
    assert apply(spark, texts, lambda c: clean.drop_references(c, least, most)) == want


def test_marks_and_numbers(spark):
    assert apply(spark, ["a [12] b (3) ( 4 ) (x)"], clean.drop_brackets) == ["a  b   (x)"]
    assert apply(spark, ["end 12.", "end 123.", "a 1\nb", "end 7", "end 7,"], clean.drop_footnote) == ["end.", "end 123.", "a 1\nb", "end", "end,"]
    assert apply(spark, ["a\nPage 3\nb\n 第 4 页\n12\npage 3\nc 5"], lambda c: clean.drop_blank_lines(clean.drop_page_numbers(c))) == ["a\nb\npage 3\nc 5"]
    assert apply(spark, [None, "\n \n"], clean.clean_text) == [None, ""]


def test_fill_is_one_pass(spark):
    df = spark.createDataFrame([("{b}", "x", "{{ {a}/{b} }}")], "a string, b string, t string")
    values = {"a": F.col("a"), "b": F.col("b")}
    row = df.select(text.fill("{{k}} {a}-{b}", values).alias("s"), text.fill(F.col("t"), values).alias("c"), text.fill("", values).alias("e")).first()
    assert (row.s, row.c, row.e) == ("{k} {b}-x", "{ {b}/x }", "")
