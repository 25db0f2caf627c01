from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lorespark.operators import chunking
from lorespark.operators.chunking import Method

PAGES = "file string, doc_ix int, text string, metadata map<string,string>"


def chunks(spark, pages, method, **how):
    out = chunking.chunk(spark.createDataFrame(pages, PAGES), method, **how).orderBy("file", "doc_ix", "pos")
    return [(r.chunk_id, r.chunk_text) for r in out.collect()]


def test_methods_by_label():
    assert Method.of("按段落") is Method.PARAGRAPH and Method.of("By Paragraph") is Method.PARAGRAPH
    assert Method.of("By Paragraph", compat=True) is Method.FIXED and Method.of("anything") is Method.FIXED


def test_paragraph_gaps_and_ids(spark):
    pages = [("a.pdf", 0, "\n\nx\n\n\n\ny ", {"source": "s", "chunk_id": "old"}), ("a.pdf", 1, "z", None), ("t.xlsx", 0, "r1\n\nr2", {})]
    assert chunks(spark, pages, Method.PARAGRAPH) == [("a_para1", "x"), ("a_para3", "y"), ("a_p1_para0", "z"), ("t_para0", "r1"), ("t_para2", "r2")]
    assert chunks(spark, pages[:2], Method.PARAGRAPH, compat_ids=True)[2] == ("a_para0", "z")
    meta = chunking.chunk(spark.createDataFrame(pages[:1], PAGES), Method.PARAGRAPH).first().metadata
    assert meta == {"source": "s", "chunk_id": "a_para1"}


def test_page_ids_run_over_the_file(spark):
    pages = [("a.txt", 0, "one", {"chunk_id": " "}), ("a.txt", 1, "two", {}), ("b.txt", 0, None, {}), ("c.txt", 0, "own", {"chunk_id": "mine"})]
    assert chunks(spark, pages, Method.PAGE) == [("a_chunk0", "one"), ("a_chunk1", "two"), ("mine", "own")]


def test_sentences_guard(spark):
    pages = [("a.txt", 0, "Dr. Who came. He left! Why?  See Fig. 2.\nEnd", {})]
    assert [t for _, t in chunks(spark, pages, Method.SENTENCE)] == ["Dr. Who came.", "He left!", "Why?", "See Fig. 2.", "End"]
    assert len(chunks(spark, pages, Method.SENTENCE, guard=False)) == 7


def plain_fixed(text, size, overlap):
    out, cur = [], []
    width = lambda p: sum(map(len, p)) + 2 * max(0, len(p) - 1)
    for piece in (p for p in text.split("\n\n") if p):
        if cur and width(cur) + 2 + len(piece) > size:
            out.append("\n\n".join(cur))
            while cur and (width(cur) > overlap or width(cur) + 2 + len(piece) > size):
                cur.pop(0)
        cur.append(piece)
    if cur:
        out.append("\n\n".join(cur))
    return [c.strip() for c in out if c.strip()]


@pytest.mark.parametrize("size", [5, 12, 30])
def test_fixed_length_random(spark, size):
    rng = random.Random(size)
    texts = ["\n\n".join("x" * rng.randint(0, 14) for _ in range(rng.randint(0, 12))) for _ in range(120)]
    for overlap in (0, 4, size):
        df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
        got = [r.o for r in df.select("i", chunking.fixed_length("t", size, overlap).alias("o")).orderBy("i").collect()]
        assert got == [plain_fixed(t, size, overlap) for t in texts]


def test_preclean(spark):
    df = spark.createDataFrame([(".pdf", "• a-\n b  c"), (".md", "a\n\n\n\nb"), (".txt", "•-\n")], "e string, t string")
    assert [r.o for r in df.select(chunking.preclean("t", F.col("e")).alias("o")).collect()] == [" a b c", "a\n\nb", "•-\n"]
