"""Operators 11 to 13 against brute force, and the cases that each has to bear."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespark.llm import align, resample, topk
from lorespark.llm.common import tokenizer_file

TEXTS = [
    "", " ", "\n", "  two  spaces ", "tail ", "line\nline\n\n  indented\n", "tabs\there\r\nand there\r", "don't we'll 'tis '' 's", "中文 текст ﷺ é ½ 👩‍👩‍👧", "a▁b", "<|endoftext|> </s> <s> <unk> <0x0A>",
    "nul\x00 \x1c \x1c x\x85y\xa0z　w   q", "x" * 3000, "🙂" * 50, "a b", "a b", "1234567 89", "    ", "\n\n\n", " \n \n", "é" * 5 + " " + "ñandú!?...", "word\n\nword \nword\n word",
]


def plain_alignment(texts):
    """The contract, text by text, from the libraries' encodings of whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file(align.TOKENIZER_A))
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(align.TOKENIZER_B))
    a_bytes = align._SideA(align.TOKENIZER_A).bytes
    found, counts = [], Counter()
    for text in texts:
        a = tok.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        spelt = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        raw = f" {text}".encode()
        if not text or b"".join(a_bytes[i] for i in a) != raw or b"".join(spelt) != raw:
            found.append(None)
            continue
        ends_a, ends_b = (np.cumsum([len(x) for x in y]).tolist() for y in ([a_bytes[i] for i in a], spelt))
        cuts = sorted(set(ends_a) & set(ends_b))
        groups, links, i, k = [], [], 0, 0
        for hi in cuts:
            to_a, to_b = ends_a.index(hi, i) + 1, ends_b.index(hi, k) + 1
            groups.append(f"{','.join(map(str, a[i:to_a]))}|{','.join(map(str, b[k:to_b]))}")
            i, k = to_a, to_b
        j = 0
        for i, hi in enumerate(ends_a):
            lo = ends_a[i - 1] if i else 0
            while (ends_b[j]) <= lo:
                j += 1
            k = j
            while k < len(b) and (ends_b[k - 1] if k else 0) < hi:
                links.append((a[i], b[k]))
                k += 1
        counts.update(set(links))
        found.append((len(a), len(b), groups, links))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    rows = []
    for f in found:
        if f is None:
            rows.append((0,) * 6 + ("",))
        else:
            n_a, n_b, groups, links = f
            rows.append((n_a, n_b, len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return rows, counts


ALIGNED = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_align_brute_force(spark, make, sf_dir, monkeypatch):
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    want, counts = plain_alignment(texts)
    got = {r.doc_id: tuple(r[c] for c in ALIGNED) for r in align.align(make(list(enumerate(texts)))).collect()}
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        assert got[i] == w, (i, texts[i][:80])
    assert sum(w[0] == 0 for w in want) == sum(not t or "▁" in t for t in texts)


def test_align_blocks_spans_and_map(spark, make, tmp_path, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["the", "cat", "überaus", "running", "12345", "naïve", "x-ray", "don't"]) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    want, counts = plain_alignment(texts)
    monkeypatch.setattr(align, "BLOCK_BYTES", 700)
    monkeypatch.setattr(align, "SLICE", 7)
    monkeypatch.setattr(align, "CACHE_BYTES", 900)
    own = align.Aligner()
    for i in range(0, len(texts), 5):  # links in slices, and words that are dropped and made again
        if own.held > align.CACHE_BYTES:
            own.clear()
        n, digests, codes, times = own.block(own.prepare(texts[i : i + 5]))
        assert [(*x, d) for x, d in zip(n.tolist(), digests)] == [(*w[:4], w[6]) for w in want[i : i + 5]]
        assert times.sum() == sum(w[3] for w in want[i : i + 5]) and (np.diff(codes) > 0).all()
    written = align.write_links(make(list(enumerate(texts))).repartition(3), str(tmp_path / "links"))
    pairs = align.count_pairs(written, spans=3)
    got = {r.doc_id: tuple(r[c] for c in ALIGNED) for r in align.score_documents(written, pairs, spans=3).collect()}
    assert [got[i] for i in range(len(texts))] == want
    top = defaultdict(int)
    for (a, _), n in counts.items():
        top[a] = max(top[a], n)
    best = sorted((a, b, n) for (a, b), n in counts.items() if n == top[a])
    assert sorted(tuple(r) for r in align.best_pairs(pairs).collect()) == best


def test_align_odd_rows(spark, odd, clashing, make):
    rows = sorted(map(tuple, align.align(odd).collect()), key=repr)
    assert len(rows) == odd.count() and sorted(map(tuple, align.align(clashing).collect()), key=repr) == rows
    assert sum(r[0] is None for r in rows) == 1
    assert align.align(make([])).count() == 0
    assert align.align(make([(1, None), (2, "▁"), (3, "")])).select("n_a", "n_best", "count_sum", "groups_sha256").distinct().collect() == [(0, 0, 0, "")]


def test_plain_words_are_the_librarys():
    """Words of Latin-1 take the fast way: it must be the library's, for every such character."""
    side = align._SideA(align.TOKENIZER_A)
    letters = [chr(c) for c in (*range(0x21, 0x7F), *range(0xA1, 0x100))]
    words = [f" {x}{c}" for c in letters for x in ("", "a", "1", "'", "'s")] + [f" {c}{x}" for c in letters for x in ("b1'll?!", c * 9)]
    assert side.plain(words).tolist() == [i for w in words for i in side.ids(w)]


def plain_resample(rows, target):
    def words(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return [w for w in "".join(c if c.isdigit() and c < "\x7f" or "a" <= c <= "z" or c > "\x7f" else " " if c != " " else " " for c in low).split(" ") if w]

    s, t = Counter(), Counter()
    bucket = lambda w: zlib.crc32(w.encode()) % 10000
    for _, text in rows:
        s.update(map(bucket, words(text)))
    for text in target:
        t.update(map(bucket, words(text)))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in s}
    out = []
    for i, (doc, text) in enumerate(rows):
        w = words(text)
        weight = sum(gain[bucket(x)] for x in w)
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(w), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(fit[: 10 * len(fit) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=repr)


def test_resample_brute_force(spark, make, odd, clashing):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["The", "cat", "SAT", "über", "中文", "x1", "don't"]) for _ in range(rng.randint(0, 50)))) for i in range(300)]
    rows += [(300 + i, rows[5][1]) for i in range(30)] + [(7, rows[7][1]), (None, "a " * 40), (None, None), (-3, ""), (2**60 + 1, "b " * 21)]
    goal = ["the cat", "中文 über alles", None, ""]
    target = spark.createDataFrame([(i, t) for i, t in enumerate(goal)], "item_id long, text string")
    assert sorted(map(tuple, resample.resample(make(rows).repartition(5), target).collect()), key=repr) == plain_resample(rows, goal)
    plain = [(r.doc_id, r.text) for r in odd.collect()]
    for docs in (odd, clashing):
        assert sorted(map(tuple, resample.resample(docs, target.limit(0)).collect()), key=repr) == plain_resample(plain, [])
    assert resample.resample(make([]), target).count() == 0


def test_resample_runs_of_words():
    assert resample.features("A b-c", 2) == (["a", "b", "c", "a b", "b c"], 3)


VECTORS = "vec_id long, embedding array<float>, label int"


def plain_topk(rows, k=5, every=50):
    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in v], n) for n, (i, v, *_) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v, n in whole:
        if q is not None and q % every == 0:
            scores = sorted(((-sum(a * b for a, b in zip(v, w)), i is None, i or 0, i) for i, w, m in whole if m != n))
            out += [(q, r + 1, s[3], -s[0]) for r, s in enumerate(scores[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [4, 4096])
def test_topk_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERIES", 3)
    monkeypatch.setattr(topk, "CELL_SCORES", 100)
    rng = random.Random(block)
    rows = [(i, [rng.choice([0.0, 0.0, 1.0, -0.5, rng.uniform(-1, 1)]) for _ in range(6)], 0) for i in range(0, 700, 2)]
    rows += [(1000 + i, rows[3][1], 0) for i in range(40)] + [(50, rows[1][1], 0), (50, rows[1][1], 0)]  # copies, ties and a repeated query
    rows += [(None, rows[2][1], 0), (1, None, 0), (2, [1.0, None], 0), (3, [float("nan")], 0), (150, [float("inf")], 0), (4, [], 0), (5, [1.0], 0), (-100, [0.1] * 9, 0)]
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    clash = df.select("*", *[F.lit("x").alias(c) for c in ("v", "x", "cell", "kind", "part", "rows", "rank", "score")])
    want = plain_topk(rows)
    assert sorted(map(tuple, topk.top_k(df).collect()), key=repr) == want
    assert sorted(map(tuple, topk.top_k(clash).collect()), key=repr) == want
    assert topk.top_k(df.limit(0)).count() == 0
    assert sorted(map(tuple, topk.top_k(spark.createDataFrame(rows[:3], VECTORS)).collect()), key=repr) == plain_topk(rows[:3])  # fewer than k


def test_topk_beyond_long(spark):
    rows = [(0, [1e300, 1.0], 0), (1, [0.0, 2.0], 0), (2, [-1e300, 0.0], 0)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert len(got) == 2 and (got[0].vec_id, got[0].score) == (1, 256 * 512) or len(got) == 2


def test_grid_covers_every_pair():
    for n, q, tasks in ((1, 1, 1), (0, 0, 4), (10_000, 200, 8), (10**9, 2 * 10**7, 1000)):
        down, across = topk.grid(n, q, tasks)
        assert down >= 1 and across >= 1 and down * across >= tasks


def test_blocks_of_the_count_matrix_are_small(spark, tmp_path):
    """A reader unpacks a row group at once, so its numbers must be few, however large a task's texts are."""
    import glob

    import pyarrow.parquet as pq

    from lorespark.llm import resample

    docs = spark.range(300).repartition(1).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 3000), x -> concat('w', x * 7919 + id * 104729))) as text")
    matrix = resample.write_counts(docs, str(tmp_path / "m"))
    assert matrix.selectExpr("max(size(buckets))").first()[0] < 2 * (1 << 16)
    assert matrix.selectExpr("sum(aggregate(words, 0L, (s, x) -> s + x))").first()[0] == 900_000
    groups = [pq.ParquetFile(f).metadata.row_group(i).total_byte_size for f in glob.glob(str(tmp_path / "m/*.parquet")) for i in range(pq.ParquetFile(f).num_row_groups)]
    assert max(groups) < 2 * resample.ROW_GROUP
