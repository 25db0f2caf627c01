"""Every operator against a plain version of itself, and its defined results for odd input."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import unicodedata
import zlib

import numpy as np
import pytest
import xxhash

from .conftest import LONG, ODD


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# --- 1: exact dedup ------------------------------------------------------------


def test_golomb_round_trip():
    from lorespark.llm import golomb

    rng = np.random.default_rng(1)
    for n, top in itertools.product((0, 1, 7, 900), (0, 1, 2**40, 2**64 - 1)):
        values = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
        assert (golomb.decode(golomb.encode(values)) == values).all()
        if n:
            base = int(values[0])
            assert (golomb.decode(golomb.encode(values, base)) == values).all()


def plain_exact(data):
    groups: dict[str, list] = {}
    for r in data:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), []).append(r[0])
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def test_exact_dedup(odd, clashing):
    from lorespark.llm.exact_dedup import exact_dedup

    columns = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert rows(exact_dedup(odd), *columns) == plain_exact(ODD)
    assert rows(exact_dedup(clashing.repartition(3)), *columns) == plain_exact(ODD)


def test_exact_dedup_large_ids(make):
    """Ids beyond 2^53 beside null ones, in one partition."""
    from lorespark.llm.exact_dedup import exact_dedup, keep_first

    data = [(None, "a b"), (2**53 + 1, "c d"), (2**53 + 3, "c  d"), (None, "unique"), (-(2**62) - 1, "e"), (2**62 + 1, "e")]
    docs = make(data).coalesce(1)
    assert rows(exact_dedup(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == plain_exact(data)
    assert sorted((r.doc_id or 0) for r in keep_first(docs).collect()) == [-(2**62) - 1, 0, 0, 2**53 + 1]


def test_exact_dedup_empty(make):
    from lorespark.llm.exact_dedup import exact_dedup, keep_first

    assert exact_dedup(make([])).count() == 0
    assert keep_first(make([])).count() == 0


# --- 2: SimHash ----------------------------------------------------------------


def plain_fingerprint(text, width=3, seed=42):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, near):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(values)), 2):
        if near(values[i], values[j]):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("budget", [0, 1, 2, 3, 6])
def test_trie_forest(budget):
    from lorespark.llm.simhash import trie_forest

    rng = random.Random(budget)
    for _ in range(20):
        values = set()
        for _ in range(4):
            base = rng.getrandbits(64)
            for _ in range(rng.randint(1, 40)):
                x = base
                for _ in range(rng.randint(0, budget + 3)):
                    x ^= 1 << rng.randrange(64)
                values.add(x)
        fp = sorted(values)
        found = trie_forest(np.array(fp, np.uint64), np.array([0]), np.array([len(fp)]), budget)
        near = lambda a, b: bin(a ^ b).count("1") <= budget
        assert found.roots().tolist() == plain_components(fp, near)
        assert all(near(fp[i], fp[j]) for i, j in found.links) and len(found.links) == len(fp) - len(set(found.roots().tolist()))


@pytest.mark.parametrize("rows_", [10, 10**6, 10**9])
def test_choices_hold_every_pair(rows_):
    from lorespark.llm.simhash import _choices

    rng = random.Random(0)
    for budget in (2, 6):
        masks = _choices(budget, rows_)
        for _ in range(300):
            diff = sum(1 << b for b in rng.sample(range(64), budget))
            assert any(diff & m == 0 for m in masks)


def test_simhash_components(spark, sf_dir, make):
    from lorespark.llm.simhash import simhash_components

    data = [(r.doc_id, r.text) for r in documents(spark, sf_dir).collect()]
    rng = random.Random(3)
    for d, t in data[:60]:  # longer near copies: a word or two changed
        words = (t * 8).split()
        data.append((10_000 + d, " ".join(words)))
        words[rng.randrange(len(words))] = "changed"
        data.append((20_000 + d, " ".join(words)))
    data += [r[:2] for r in ODD if r[0] is not None and r[1] != LONG]
    order = sorted(range(len(data)), key=lambda i: data[i][0])
    prints = [plain_fingerprint(data[i][1]) for i in order]
    roots = plain_components(prints, lambda a, b: bin(a ^ b).count("1") <= 2)
    want = sorted(((data[i][0], f"{p:016x}", data[order[r]][0]) for i, p, r in zip(order, prints, roots)), key=repr)
    assert rows(simhash_components(make(data)), "doc_id", "fingerprint", "component_id") == want


def test_simhash_odd(clashing, make):
    from lorespark.llm.simhash import keep_one, near_duplicates, simhash_components

    assert simhash_components(clashing).count() == len(ODD)
    assert simhash_components(make([])).count() == 0
    assert near_duplicates(make([])).count() == 0
    assert keep_one(clashing).columns == clashing.columns


def test_near_duplicates(make):
    from lorespark.llm.simhash import near_duplicates

    rng = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    base = [[rng.choice(words) for _ in range(400)] for _ in range(6)]
    data = []
    for k, b in enumerate(base):
        data.append((k * 10, " ".join(b)))
        one = b.copy()
        one[200] = "edited"
        data.append((k * 10 + 1, " ".join(one)))
        far = [w if rng.random() > 0.1 else "other" for w in b]
        data.append((k * 10 + 2, " ".join(far)))
    assert dropped(near_duplicates(make(data))) == [(k * 10 + 1, k * 10) for k in range(6)]


def dropped(judged):
    """(doc_id, keep_id) of the rows that do not stay."""
    from lorespark.llm.common import ROW

    return rows(judged.filter("not stays"), ROW[0], "keep_id")


def plain_near(data):
    """(doc_id, keep_id) of every document dropped, all pairs held against each other."""
    from lorespark.llm.simhash import SHINGLE, SIMILARITY, WIDE_BUDGET, candidate_prints, shingle_hashes

    data = sorted(data)
    prints = [candidate_prints(t.encode()).view(np.uint64).tolist() for _, t in data]
    sets = [set(shingle_hashes(t.encode(), SHINGLE)) for _, t in data]

    def linked(i, j):
        close = any((a ^ b).bit_count() <= WIDE_BUDGET for a, b in zip(prints[i], prints[j]))
        return close and len(sets[i] & sets[j]) >= SIMILARITY * len(sets[i] | sets[j])

    roots = plain_components(list(range(len(data))), linked)
    return [(data[i][0], data[r][0]) for i, r in enumerate(roots) if i != r]


def test_near_duplicates_many_variants(make):
    from lorespark.llm.simhash import near_duplicates

    rng = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    base = [rng.choice(words) for _ in range(300)]
    data = [(1000, " ".join(base))]
    for k in range(250):
        one = base.copy()
        for at in rng.sample(range(300), 5):
            one[at] = rng.choice(words)
        data.append((k, " ".join(one)))
    assert dropped(near_duplicates(make(data))) == sorted(plain_near(data), key=repr)


def test_near_duplicates_one_fingerprint(make):
    """Segments between one word in another order: the same words and two-word shingles, other five-word ones."""
    from lorespark.llm.simhash import candidate_prints, near_duplicates

    rng = random.Random(4)
    words = [f"w{i}" for i in range(5000)]
    data = []
    for k in range(6):
        parts = [" ".join(rng.choices(words, k=7)) for _ in range(40)]
        y = rng.sample(parts, 40)
        z = y[:-2] + [y[-1], y[-2]]
        data += [(10 * k + i, "q " + " q ".join(order) + " q") for i, order in enumerate((parts, y, z))]
    assert all(len({candidate_prints(t.encode()).tobytes() for _, t in data[i : i + 3]}) == 1 for i in range(0, 18, 3))
    want = plain_near(data)
    assert want == [(10 * k + 2, 10 * k + 1) for k in range(6)]
    assert dropped(near_duplicates(make(data))) == sorted(want, key=repr)


def test_near_duplicates_recall(spark):
    """At least 0.9 of all alike pairs of the corpus are in one group; a prefix filter over rare shingles finds them all."""
    from collections import Counter, defaultdict

    from lorespark.llm.exact_dedup import keep_first
    from lorespark.llm.simhash import near_duplicates, shingle_hashes

    docs = keep_first(documents(spark, "/root/testdata/sf0.1"))
    sets = {r.doc_id: set(shingle_hashes((r.text or "").encode(), 5)) for r in docs.select("doc_id", "text").collect()}
    often = Counter(x for s in sets.values() for x in s)
    held, pairs = defaultdict(list), set()
    for i, s in sets.items():
        rare = sorted(s, key=lambda x: (often[x], x))
        for x in rare[: len(rare) - -(-8 * len(rare) // 10) + 1]:
            pairs |= {(j, i) for j in held[x]}
            held[x].append(i)
    alike = [(i, j) for i, j in pairs if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    keep = dict(dropped(near_duplicates(docs)))
    found = sum(keep.get(i, i) == keep.get(j, j) for i, j in alike)
    assert len(alike) > 30 and found >= 0.9 * len(alike)


IDLESS = [(None, "a b"), (1, "a b"), (None, "unique text"), (5, "a b"), (5, "other unique"), (7, "A b"), (7, "A b"), (8, "z"), (None, None), (None, ""), (5, "a  b")]


def test_rows_are_told_apart_by_id_and_text(make):
    from lorespark.llm.exact_dedup import keep_first
    from lorespark.llm.simhash import keep_one

    left = rows(keep_first(make(IDLESS)), "doc_id", "text")
    assert left == sorted([(1, "a b"), (None, "unique text"), (5, "other unique"), (7, "A b"), (8, "z"), *[r for r in left if not r[1]]], key=repr) and len(left) == 6
    rng = random.Random(1)
    words = [f"w{i}" for i in range(900)]
    long_ = [" ".join(rng.choices(words, k=200)) for _ in range(4)]
    near = [x + " more" for x in long_]
    data = [(None, long_[0]), (None, near[0]), (3, long_[1]), (3, near[1]), (3, long_[2]), (2, near[2]), (None, long_[3]), (3, long_[3]), (3, long_[3])]
    left = rows(keep_one(make(data)), "doc_id", "text")
    assert len(left) == 4 and (2, near[2]) in left and (3, long_[3]) in left
    assert {t.removesuffix(" more") for _, t in left} == set(long_)


def test_no_unique_text_is_lost(make):
    """Whatever the ids, every text that repeats nothing stays."""
    from lorespark.llm.exact_dedup import keep_first

    rng = random.Random(2)
    for _ in range(3):
        data = [(rng.choice([None, 1, 2, 3]), " ".join(rng.choices("abc", k=rng.randint(1, 3)))) for _ in range(25)]
        assert rows(keep_first(make(data)), "text") == sorted({(t,) for _, t in data}, key=repr)


def test_components_long_path(spark):
    from lorespark.llm.common import materialize
    from lorespark.llm.graph import components

    edges = materialize(spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long"))
    assert rows(components(edges), "node", "root") == sorted([(i, 0) for i in range(1, 41)] + [(101, 100)], key=repr)
    assert components(materialize(spark.createDataFrame([], "u long, v long"))).count() == 0


# --- 3: HTML -------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href=/a>Home</a></li></ul></nav><div class="ad">Buy now, really.</div>
<article><h1>A  title</h1><p>One &amp; two,<br>three.<p><b>Bold</b> text &lt;x&gt;<div class="comments"><p>nice, thanks</div><form>f</form></article>
<aside>side</aside><footer>&copy; foot</footer></body></html>"""


def test_extract_marked():
    from lorespark.llm.html_extract import extract

    assert extract(PAGE) == "A title\n\nOne & two, three.\n\nBold text <x>"
    for odd in (None, "", "   ", "<p", "<script>never closed", "<!-- open", "<a href='x"):
        assert extract(odd) == ""
    assert extract("<article><p>cut off <b>in a ta</") == "cut off in a ta"


def test_extract_open_head_and_state_classes():
    from lorespark.llm.html_extract import extract

    want = "One, two.\n\nThree."
    body = "<article><p>One, two.</p><p>Three.</p></article>"
    for start in ("<html><head><title>x</title><body>", "<head><meta charset=u><link href=x>", "<body class='page no-sidebar'>", "<html class=has-nav><body id=menu>", "<div class='x comments-open'>", "<body><svg class=i /><object data=x></object>"):
        assert extract(start + body) == want
    assert extract("<article class='post comments-open'><p>One, two.</p><p>Three.</p><div class='comments'>no</div></article>") == want
    assert extract("<main class=search><svg><text>no</text></svg><noscript>no</noscript><p>One, two.</p><p>Three.</p></main>") == want


def test_extract_by_ratio():
    from lorespark.llm.html_extract import extract

    body = "".join(f"<p>Sentence number {i}, with some length and punctuation; it goes on for a while.</p>" for i in range(6))
    links = "".join(f"<li><a href=/{i}>l{i}</a></li>" for i in range(20))
    assert extract(f"<body><ul>{links}</ul><div id=x><h2>Head</h2>{body}</div><p><a href=y>more</a></p></body>").count("Sentence") == 6
    assert "l3" not in extract(f"<body><ul>{links}</ul><div id=x>{body}</div></body>")


SENTENCES = "".join(f"<p>Sentence number {i}, with some length and punctuation; it goes on for a while, as they do.</p>" for i in range(6))


def test_extract_weighs_marks():
    """article and main weigh on the ratios; they neither shut out nor let in on their own."""
    from lorespark.llm.html_extract import extract

    teasers = "".join(f"<article><a href=/{i}>Other story {i}</a></article>" for i in range(5))
    got = extract(f"<body>{teasers}<div id=story><h1>Head</h1>{SENTENCES}</div></body>")
    assert got.startswith("Head\n\nSentence number 0") and got.count("Sentence") == 6 and "Other" not in got
    got = extract(f"<body><article>{SENTENCES}</article><div id=rest>{SENTENCES}</div></body>")
    assert got.count("Sentence") == 12  # the text goes on outside
    links = "".join(f"<li><a href=/{i}>linked title {i}</a></li>" for i in range(20))
    items = "<ul><li>a short item</li><li>one more</li></ul>"
    got = extract(f"<article><h1>Head</h1>{SENTENCES}{items}<ul class=x>{links}</ul></article><div><p>Tail line</p></div>")
    assert got.endswith("a short item\n\none more") and "linked" not in got and "Tail" not in got
    assert extract("<article><h1>T</h1><p>Short.</p></article>") == "T\n\nShort."


@pytest.mark.parametrize("piece", ["<a", "<div>", "<div><b>", "<p class='x y'>", "</zz>", "<li>", "<!--", "&amp;", "<a ", "< ", "<b><dd>", "<td>", "x</p>", "<![", "<script>", "<" * 9 + "a"])
def test_extract_hostile(piece):
    """A megabyte of one construct takes a moment, and memory in proportion."""
    import time
    import tracemalloc

    from lorespark.llm.html_extract import extract

    page = "<body><article><p>Text.</p>" + piece * (1_000_000 // len(piece))
    tracemalloc.start()
    extract(page[: len(page) // 10])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    began = time.process_time()
    extract(page)
    assert time.process_time() - began < 10 and peak < 400 * len(page) // 10


def test_extract_long_names():
    import time

    from lorespark.llm.html_extract import extract

    began = time.process_time()
    assert extract("<article><p>Text.</p><" + "a" * 1_000_000) == "Text."
    assert extract("<article><p>Text.</p>" + "<a x=\"" * 100_001) == "Text."
    assert time.process_time() - began < 2


LONG_PARAGRAPH = "<p>" + "This is a long paragraph of the article, with commas, stops and words. " * 6 + "</p>"


def extracted(page):
    from lorespark.llm.html_extract import extract

    return extract(page).split("\n\n")


@pytest.mark.parametrize("around", ["<article>{}</article>", "<main>{}</main>", "<div class='text'>{}</div>", "{}"])
def test_extract_lists_tables_and_code(around):
    """Short parts of an article stay, menus beside it go."""
    inner = LONG_PARAGRAPH + "<ul><li>x</li><li>y <b>z</b></li></ul><p>Ok.</p><table><caption>Cap</caption><tr><th>a<th>b<tr><td>1</td><td>3</td></table><dl><dt>term<dd>def</dl>" + LONG_PARAGRAPH
    inner += "<pre>code here</pre><blockquote><p>quoted</p></blockquote><figure><img src=x><figcaption>shown</figcaption></figure><ol><li>one<li>two</ol>"
    menu = "<ul class='links'>" + "".join(f"<li><a href=/{i}>Entry {i}</a></li>" for i in range(6)) + "</ul>"
    page = f"<html><body><nav><ul><li>Home</li></ul></nav>{menu}{around.format(inner)}<footer>legal</footer></body></html>"
    long = " ".join(LONG_PARAGRAPH[3:-4].split())
    assert extracted(page) == [long, "x", "y z", "Ok.", "Cap", "a", "b", "1", "3", "term", "def", long, "code here", "quoted", "shown", "one", "two"]


def test_extract_anchors_and_names():
    kept = "<p id='notice-period'>Notice of a month.</p><h2 id='related-work'>Related work</h2><section id='social-impact'><p>Impact.</p></section><p class='search-box-text'>Search.</p><div class='related-work'><p>Other work.</p></div>"
    gone = "<div class='related-posts'><p>More posts.</p></div><div id='cookie-banner-2'>We set some.</div><p class='advert'>Buy.</p><div class='site-sidebar__inner'>Side.</div><section class='comments'><p>First!</p></section><div role='search'>Find</div><ul class='share-buttons'><li>Mail</li></ul>"
    text = extracted(f"<article>{LONG_PARAGRAPH}{kept}{gone}{LONG_PARAGRAPH}</article>")
    assert text[1:-1] == ["Notice of a month.", "Related work", "Impact.", "Search.", "Other work."]
    assert extracted(f"<body><div class='content-sidebar'>{LONG_PARAGRAPH * 3}</div><p>Some other.</p></body>")[0].startswith("This is a long")
    assert extracted(f"<body><div class='ad'>{LONG_PARAGRAPH}</div><article><p>Short one.</p></article></body>") == ["Short one."]


def test_extract_void_tags():
    body = "super<wbr>cali a<img src=x>b c<input>d one<br>two<br/>three<hr>four"
    assert extracted(f"<article>{LONG_PARAGRAPH}<p>{body}</p></article>")[1:] == ["supercali ab cd one two three", "four"]


def test_extract_hostile_pages_are_linear():
    import time

    for page in ("<dl><dd><ul>" + "<b>" * 20000 + "<dd></dd>" * 20000, "<dl>" + "<div>" * 20000 + "<dd></dd>" * 20000, "<p>" * 30000 + "<b>" * 30000 + "<div></div>" * 20000, "<ul><li>" * 20000 + "</li>" * 20000):
        began = time.process_time()
        extracted(page)
        assert time.process_time() - began < 3


def test_extract_clashing_names(spark):
    from pyspark.sql import functions as F

    from lorespark.llm.html_extract import main_text

    pages = spark.createDataFrame([(1, "u", "<article><p>Text.</p>")], "page_id long, url string, html string")
    got = main_text(pages.select("*", F.lit("x").alias("text"), F.lit(3).alias("n_chars"), F.lit(None).alias("block"))).collect()
    assert [tuple(r) for r in got] == [(1, "u", "Text.", 5)]


def duckdb_pages():
    import duckdb

    return [x for (x,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.1/pages.parquet'").fetchall()]


def test_extract_pages(spark, sf_dir):
    import html

    from lorespark.llm.html_extract import main_text

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")

    def plain(page):
        inner = re.sub(r"<[^>]*$", "", re.split("</article>|<footer>", page.split("<article>", 1)[1])[0])
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:h1|p)>", inner)]
        return "\n\n".join(p for p in parts if p)

    want = {r.page_id: plain(r.html) for r in pages.collect()}
    got = main_text(pages).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)
    big = duckdb_pages()
    from lorespark.llm.html_extract import extract

    assert all(extract(x) == plain(x) for x in big)
    odd = spark.createDataFrame([(1, None, None), (None, "u", "<p>x"), (1, None, None)], "page_id long, url string, html string")
    assert main_text(odd).count() == 3 and main_text(odd.limit(0)).count() == 0


# --- 4: fingerprints -----------------------------------------------------------


def test_fingerprint_edits(make, spark, clashing):
    from lorespark.llm.fingerprint import fingerprint_edits

    def canon(t):
        return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()).split())

    def digest(t):
        return xxhash.xxh3_128_hexdigest(canon(t).encode())

    for parts, data in ((1, ODD), (5, ODD), (7, [(i, f"text {i} ß Ｘ " * (i % 4)) for i in range(50)]), (2, [(1, "x")])):
        plain = sorted(((r[0], r[1] or "") for r in data), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
        want = []
        for i, (d, t) in enumerate(plain):
            n = plain[(i + 1) % len(plain)][1]
            half = len(t) // 2
            e = t[: len(t) - half] + n[:half]
            want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), digest(t), digest(e), float(canon(t) == canon(e)), float(canon(t) == canon(n))))
        got = rows(fingerprint_edits(make(data).repartition(parts)), "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
        assert got == sorted(want, key=repr)
    assert fingerprint_edits(make([])).count() == 0
    assert fingerprint_edits(clashing).count() == len(ODD)


def plain_classes(data):
    groups = {}
    for d, t in data:
        groups.setdefault(" ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold()).split()), []).append(d)
    return sorted(((d, min((x for x in ids if x is not None), default=None), len(ids)) for ids in groups.values() for d in ids), key=repr)


def test_equal_classes(make, clashing):
    from lorespark.llm.fingerprint import equal_classes

    data = [(3, "Straße  X"), (1, "STRASSE x"), (2, "other"), (5, "ﬁn"), (4, " fin ")]
    assert rows(equal_classes(make(data)), "doc_id", "class_id", "class_size") == [(1, 1, 2), (2, 2, 1), (3, 1, 2), (4, 4, 2), (5, 4, 2)]
    from lorespark.llm.fingerprint import fingerprint_edits

    for data in ([(r[0], r[1]) for r in ODD], IDLESS):
        for result in (equal_classes(make(data)), fingerprint_edits(make(data).repartition(3))):
            assert rows(result, "doc_id", "class_id", "class_size") == plain_classes(data)
    assert equal_classes(clashing).count() == len(ODD)


# --- 5: substring dedup --------------------------------------------------------


def test_gear_is_rolling():
    from lorespark.llm.substring import _GEAR, gear

    data = np.random.default_rng(2).integers(0, 256, 300).astype(np.uint8)
    h, want = 0, []
    for b in data:
        h = ((h << 1) + int(_GEAR[b])) & 0xFFFF
        want.append(h)
    assert gear(data).tolist() == want


def test_chunks_cover_and_resist_shifts():
    from lorespark.llm.substring import cuts

    rng = random.Random(1)
    text = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(2000)).encode()
    ends, words = cuts(text)
    assert ends[-1] == len(text) and ends == sorted(set(ends)) and words[-1] == 2000
    shifted = b"inserted words here " + text
    a = {text[x:y] for x, y in zip([0, *ends], ends)}
    other, _ = cuts(shifted)
    b = {shifted[x:y] for x, y in zip([0, *other], other)}
    assert len(a - b) <= 2
    bare = "".join(rng.choices("中文字符没有空格", k=5000)).encode()
    found, _ = cuts(bare)
    assert len(found) > 5 and all(bare[x:y].decode() for x, y in zip([0, *found], found))


def test_repeats(make):
    from lorespark.llm.substring import remove_repeats, repeated_spans

    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(n))
    passage, licence = words(60), words(8)
    data = [(i, words(100) + "\n" + licence) for i in range(20)]
    data += [(100 + i, f"{words(40)} {passage} {words(30)}") for i in range(5)] + [(200, passage), (None, words(50)), (300, None), (301, "")]
    spans = repeated_spans(make(data)).collect()
    assert {s.doc_id for s in spans} == {101, 102, 103, 104, 200} and {s.first_doc_id for s in spans} == {100}
    by_id = dict(data)
    for s in spans:
        piece = by_id[s.doc_id].encode()[s.start : s.stop].decode().strip()
        assert piece in passage + " " + by_id[s.doc_id] and s.n_words >= 16
    left = {r.doc_id: r for r in remove_repeats(make(data)).collect()}
    assert all(left[i].text == by_id[i] for i in [*range(20), 100, None, 300, 301])
    assert all(len(left[i].text.split()) < 110 for i in range(101, 105)) and left[101].n_chars == len(left[101].text)


def test_repeats_without_white_space(make):
    from lorespark.llm.substring import remove_repeats, repeated_spans

    rng = random.Random(6)
    points = lambda a, b, n: "".join(chr(rng.randint(a, b)) for _ in range(n))
    for k, alphabet in enumerate([(0x4E00, 0x9FA5), (0x3041, 0x3096), (0x0E01, 0x0E2E)]):
        passage = points(*alphabet, 150)
        data = [(1, points(*alphabet, 300) + passage), (2, passage + points(*alphabet, 300)), (3, "\n".join(points(*alphabet, 12) for _ in range(40)))]
        data += [(4, "x\n" + data[2][1]), (5, points(*alphabet, 500))]
        spans = {s.doc_id: s for s in repeated_spans(make(data)).collect()}
        assert set(spans) == {2, 4} and spans[2].first_doc_id == 1 and spans[4].first_doc_id == 3
        left = {r.doc_id: r.text for r in remove_repeats(make(data)).collect()}
        assert all(left[i] == t for i, t in data if i in (1, 3, 5)) and len(left[2]) < 400 and len(left.get(4, "")) < 100
    whole = points(97, 122, 20_000)
    left = {r.doc_id: r.text for r in remove_repeats(make([(1, whole), (2, "prefix" + whole)])).collect()}
    assert left[1] == whole and len(left.get(2, "")) < 5000


def plain_spans(data):
    """Every repeated span, from a dictionary of all chunks."""
    from lorespark.llm.substring import MIN_WORDS, cuts

    order = lambda r: (r[0] is None, r[0] or 0, hashes[r])
    data = list(dict.fromkeys((d, t) for d, t in data if t))
    hashes = {r: i for i, r in enumerate(data)}
    seen, parts = {}, []
    for r in data:
        ends, words = cuts(r[1].encode())
        for a, b, n in zip([0, *ends[:-1]], ends, np.diff(words, prepend=0).tolist()):
            parts.append((r, a, b, n, r[1].encode()[a:b]))
            seen.setdefault(parts[-1][4], []).append((order(r), a, r[0]))
    first = {k: min(v, key=lambda x: x[:2]) for k, v in seen.items()}
    spans, run = [], None
    for r, a, b, n, piece in parts:
        if (order(r), a) <= first[piece][:2]:
            run = None
            continue
        if run is not None and run[0] == r and run[2] == a:
            run[2], run[3] = b, run[3] + n
            run[4].append(first[piece][2])
        else:
            run = [r, a, b, n, [first[piece][2]]]
            spans.append(run)
    return sorted(((r[0], a, b, n, min((f for f in of if f is not None), default=None)) for r, a, b, n, of in spans if n >= MIN_WORDS), key=repr)


def test_repeats_brute_force(spark, sf_dir, make, monkeypatch):
    from lorespark.llm import substring

    data = [(r.doc_id, r.text) for r in documents(spark, sf_dir).select("doc_id", "text").collect()]
    want = plain_spans(data)
    assert len(want) > 20
    for size in (substring.BLOCK_BYTES, 10_000):
        monkeypatch.setattr(substring, "BLOCK_BYTES", size)
        got = rows(substring.repeated_spans(make(data).repartition(3)), "doc_id", "start", "stop", "n_words", "first_doc_id")
        assert got == want


def test_repeats_of_null_and_repeated_ids(make):
    """A span of one row is never cut from another row of its id."""
    from lorespark.llm.substring import remove_repeats

    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(n))
    passage, unique = words(80), [words(150) for _ in range(2)]
    for one, two in ((None, 7), (2, 2)):
        data = [(1, words(50) + " " + passage), (one, words(20) + " " + passage + " " + words(20)), (one, unique[0]), (two, unique[1]), (None, None)]
        left = {r.text for r in remove_repeats(make(data)).collect()}
        assert {data[0][1], *unique, None} <= left and len(left) == 5 and data[1][1] not in left


def test_repeats_odd(clashing, make):
    from lorespark.llm.substring import remove_repeats, repeated_spans

    assert repeated_spans(make([])).count() == 0 and remove_repeats(make([])).count() == 0
    assert remove_repeats(clashing).columns == clashing.columns


# --- 6: SentencePiece ----------------------------------------------------------


def test_nbest_brute_force():
    from lorespark.llm import sp_nbest
    from lorespark.llm.sp_nbest import segment

    search = sp_nbest.parts_of().lattice

    def every(text):
        s, found = search.normalize(text), []

        def go(i, score, ids):
            if i == len(s):
                found.append((score, tuple(ids)))
                return
            for b in range(i + 1, len(s) + 1):
                if (p := search.pieces.get(s[i:b])) is not None:
                    go(b, score + p[1], [*ids, p[0]])
            if s[i] not in search.pieces:
                go(i + 1, score + search.missing, [*ids, *(search.bytes[x] for x in s[i].encode())])

        go(0, 0.0, [])
        return sorted(found, key=lambda x: -x[0])

    for text in ("the cat", "a  b", "on\nin", "€ 𝄞", "abc, de.", "   ", "\n\n", "x"):
        want, got = every(text), segment(text, 5)
        known = {ids: s for s, ids in want}
        assert [round(s, 6) for s, _ in got] == [round(s, 6) for s, _ in want[:5]]
        assert len({i for _, i in got}) == len(got)
        assert all(abs(known[tuple(np.frombuffer(i, "<u4").tolist())] - s) < 1e-9 for s, i in got)
        assert all(search.decode(i) == text for _, i in got)
    assert segment("", 4) == [(0.0, b"")] == segment(None, 4)
    assert segment("aaaa " * 3, 4) == segment("aaaa " * 3, 4)  # ties: a fixed order


def test_scores_are_log_probabilities():
    from lorespark.llm.sp_nbest import Lattice

    scores = [s for _, s in Lattice().pieces.values()]
    assert abs(sum(np.exp(scores)) - 1) < 1e-6
    assert Lattice._scores([-1.5, -2.25]) == [-1.5, -2.25]  # a unigram model's own


def test_segmentations(spark, sf_dir, clashing, make):
    from lorespark.llm.sp_nbest import parts_of, segmentations

    docs = documents(spark, sf_dir)
    got = segmentations(docs, with_ids=True).collect()
    assert all(r.decodes and len(r.nbest) == 4 for r in got)
    assert all([x.score for x in r.nbest] == sorted((x.score for x in r.nbest), reverse=True) for r in got)
    assert all(len(r.ids) == r.n_pieces and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    library, texts = parts_of().lattice.sp, {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        ids = library.encode(texts[r.doc_id] or "")
        assert (r.library_n_pieces, r.library_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    out = segmentations(clashing)
    assert out.count() == len(ODD) and out.filter("decodes").count() == len(ODD)
    assert segmentations(make([])).count() == 0


# --- 7: language ---------------------------------------------------------------


def test_viterbi_brute_force():
    from lorespark.llm.langid import viterbi

    rng = np.random.default_rng(0)
    for _ in range(100):
        lengths = rng.integers(0, 6, 4)
        emit = (rng.normal(size=(lengths.sum(), 3)) * 3).astype(np.float32)
        labels, at = viterbi(emit, lengths, 1.5), 0
        for n in lengths.tolist():
            x = emit[at : at + n]
            score = lambda p: sum(x[i][p[i]] for i in range(len(p))) - 1.5 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
            if n:
                assert abs(score(labels[at : at + n]) - max(map(score, itertools.product(range(3), repeat=n)))) < 1e-3
            at += n


def test_language_held_out(spark):
    from lorespark.llm.langid import evaluate, spans, train

    docs = documents(spark, "/root/testdata/sf0.01")
    got = evaluate(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) > 0.98 * len(got) > 0
    model = train(docs)
    texts = {r.lang: r.text for r in docs.filter("length(text) > 400 and text not like '%!!%'").dropDuplicates(["lang"]).collect()}
    mixed = texts["en"][:200] + " " + texts["de"][:200]
    assert {s[2] for s in spans(mixed, model)} >= {"en", "de"}


def test_words_are_letters_only():
    """A word's characters have one of Unicode's letter categories, and all of those are words."""
    import unicodedata

    from lorespark.llm.langid import words_of

    assert words_of("½ ② ² Ⅷ ٣ x² 一二 é") == ["x", "一二", "é"]
    for c in map(chr, [*range(0x3000), *range(0x1F000, 0x1F800)]):
        assert bool(words_of(c)) == any(unicodedata.category(x)[0] == "L" for x in c.lower()), c


def test_numerals_have_no_language(make):
    from lorespark.llm.langid import evaluate

    data = [(i, "the cat sat on the mat and the dog", "en") for i in range(9)] + [(i, "der hund und die katze sind im haus", "de") for i in range(9, 18)] + [(20, "½ ② ²", "en"), (21, "12 345 !", "en"), (22, None, "de")]
    out = {r.doc_id: (r.lang_pred, r.score) for r in evaluate(make(data)).collect()}
    assert out[20] == out[21] == out[22] == ("und", 0.0) and out[0][0] == "en" and out[9][0] == "de"


def test_language_odd(clashing, make):
    from lorespark.llm.langid import Model, evaluate, predict

    out = {r.doc_id: r for r in evaluate(clashing).collect()}
    assert out[3].lang_pred == out[4].lang_pred == "und" and out[3].score == 0.0
    assert evaluate(make([])).count() == 0
    assert {r.lang_pred for r in predict(make([(1, "words")]), Model([], {}, {})).collect()} == {"und"}


# --- 8: token counts -----------------------------------------------------------


def test_rollup(spark, tmp_path):
    from lorespark.llm.token_rollup import CHANGE, TokenRollup

    rollup = TokenRollup(spark, str(tmp_path / "rollup"))
    change = lambda *r: spark.createDataFrame(list(r), CHANGE)
    ins = lambda s, n: ("insert", s, "en", "v1", n, None, None, None, None)
    assert rollup.totals().count() == 0
    assert rollup.commit("b/1", change(ins("a", 10), ins("a", 5), ins("b", 7), ins(None, None)))
    assert not rollup.commit("b/1", change(ins("a", 1000)))
    assert rollup.commit("2", change(("revise", "a", "en", "v2", 8, "a", "en", "v1", 10), ("DELETE", None, None, None, None, "b", "en", "v1", 7)))
    assert rollup.commit("3", change())
    assert rows(rollup.totals(), "source", "tokenizer_version", "n_docs", "n_tokens") == [("a", "v1", 1, 5), ("a", "v2", 1, 8), (None, "v1", 1, 0)]
    with pytest.raises(Exception, match="unknown operation"):
        rollup.commit("4", change(("upsert", "a", "en", "v1", 1, None, None, None, None)))
    assert rollup.batches() == ["2", "3", "b/1"]
    # a batch whose marker is missing does not count, and can be committed
    TokenRollup(spark, rollup.path)._exists("markers")
    (tmp_path / "rollup" / "markers" / "batch=2" / "_SUCCESS").unlink()
    assert rollup.commit("2", change(("revise", "a", "en", "v2", 8, "a", "en", "v1", 10)))
    assert ("b", "v1", 1, 7) in rows(rollup.totals(), "source", "tokenizer_version", "n_docs", "n_tokens")


def test_corpus_totals(spark, sf_dir, clashing, make):
    from tokenizers import Tokenizer

    from lorespark.llm.common import tokenizer_file
    from lorespark.llm.token_rollup import corpus_totals

    tok = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    want: dict[tuple, list[int]] = {}
    docs = documents(spark, sf_dir).unionByName(make([(9001, None), (9002, ""), (9003, " \n"), (9004, "x")]))
    for r in docs.collect():
        if n := len(tok.encode(r.text or "", add_special_tokens=False).ids):
            t = want.setdefault((r.source, r.lang, "word_bpe_49k.json+end"), [0, 0])
            t[0] += 1
            t[1] += n + 1
    got = rows(corpus_totals(docs), "source", "lang", "tokenizer_version", "n_docs", "n_tokens")
    assert got == sorted(((*k, *v) for k, v in want.items()), key=repr)
    assert corpus_totals(clashing).agg({"n_docs": "sum"}).first()[0] == sum(bool((r[1] or "").strip()) for r in ODD)
    assert corpus_totals(make([])).count() == 0


# --- 9: quality ----------------------------------------------------------------


def test_kneser_ney_against_plain(make):
    """Bits of n-grams, looked up by joins, against the textbook recursion on dictionaries."""
    from collections import Counter

    from lorespark.llm.common import materialize
    from lorespark.llm.quality_kn import AGAIN, END, ORDER, START, look_up, train, units

    texts = ["the cat sat on the mat.", "the dog sat, the the cat ran", "a cat and a dog; a mat ß中", "", None]
    docs = make(list(enumerate(texts)))
    model = train(docs)
    assert units("a a  a\nb " + "x" * 40) == ["a", AGAIN, AGAIN, "b", "x" * 32, "x" * 8]
    counted = [Counter() for _ in range(ORDER + 1)]
    for t in texts:
        for u in units(t):
            s = START * (ORDER - 1) + u + END
            counted[ORDER].update(s[i : i + ORDER] for i in range(len(u) + 1))
    for k in range(ORDER - 1, 0, -1):
        counted[k].update(g[1:] for g in counted[k + 1])

    def discounts(counts):
        n = [0] + [sum(v == k for v in counts.values()) for k in (1, 2, 3, 4)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.0
        return [min(max(k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.5, 0.05), k - 0.05) for k in (1, 2, 3)]

    cut = [None, *map(discounts, counted[1:])]
    contexts = [None] + [{} for _ in range(ORDER)]
    for k in range(1, ORDER + 1):
        for g, c in counted[k].items():
            t = contexts[k].setdefault(g[:-1], [0, 0.0])
            t[0] += c
            t[1] += cut[k][min(c, 3) - 1]

    def p(g):
        k = len(g)
        lower = p(g[1:]) if k > 1 else 1 / (len(counted[1]) + 1)
        if g[:-1] not in contexts[k]:
            return lower
        total, spare = contexts[k][g[:-1]]
        c = counted[k].get(g, 0)
        return (max(c - cut[k][min(c, 3) - 1], 0) if c else 0) / total + spare / total * lower

    rng = random.Random(0)
    picks = {"".join(rng.choices("thecasondmr. ,ß中z", k=ORDER)) for _ in range(200)} | set(counted[ORDER])
    asked = materialize(docs.sparkSession.createDataFrame([(g,) for g in picks], "gram string"))
    got = {r.gram: r.bits for r in look_up(asked, model).collect()}
    assert got.keys() == picks and all(abs(got[g] + np.log2(p(g))) < 1e-9 for g in picks)


def test_bits_are_sums(make, monkeypatch):
    """A document's bits are those of its n-grams, in blocks of any size."""
    from lorespark.llm import quality_kn as q
    from lorespark.llm.common import ROW, materialize

    texts = ["the cat sat on the mat.", "the dog sat, the the the cat ran", "", None, "中文 " + "z" * 70, "a b c " * 300]
    docs = make(list(enumerate(texts)))
    model = q.train(docs.filter("doc_id < 3"))
    grams = [["".join(s[i : i + q.ORDER]) for u in q.units(t) for s in [q.START * (q.ORDER - 1) + u + q.END] for i in range(len(u) + 1)] for t in texts]
    asked = materialize(docs.sparkSession.createDataFrame([(g,) for g in set(sum(grams, []))], "gram string"))
    steps = {r.gram: round(r.bits * q.STEPS) for r in q.look_up(asked, model).collect()}
    want = [(i, len(g) - units.count(q.AGAIN), sum(min(255, steps[x]) for x in g)) for i, (g, units) in enumerate(zip(grams, map(q.units, texts)))]
    for size in (q.BLOCK_CHARS, 20):
        monkeypatch.setattr(q, "BLOCK_CHARS", size)
        got = [(r[ROW[0]], r.n_symbols, round(r.bits * q.STEPS)) for r in q.bits(docs.repartition(2), model).collect()]
        assert sorted(got) == want


def test_blocks_are_small(spark):
    """A block's rows say the same in less room: 0.30 bytes a code point on these tables, 0.37 before n-grams were sorted and packed by columns."""
    from lorespark.llm import quality_kn as q
    from lorespark.llm.common import lean, row_key

    joined, ends, _, _ = q.windows(["the", "that", "中文", "ﷺ", q.AGAIN, "😀z"])
    parts = q._sharded(joined, ends, 3)
    got = [q._split(q._joint(joined, ends[part])) for _, part in parts]
    assert got == [sorted(x) for x in got] and sorted(sum(got, [])) == sorted(q.grams(joined, ends)) and q._unpack(q._pack(b"")) == b""
    docs = documents(spark, "/root/testdata/sf0.1").coalesce(1)
    rows = docs.select(*row_key(), "lang", "text").mapInArrow(lean(q._blocks(16)), q._BLOCKS)
    held = rows.selectExpr("sum(length(units) + coalesce(length(docs), 0)) AS n").first().n
    assert held <= 0.33 * docs.selectExpr("sum(length(text)) AS n").first().n


def test_shuffles_of_the_model_go(make):
    """What training shuffled is gone when the model is there."""
    import time

    from lorespark.llm.common import tidy
    from lorespark.llm.quality_kn import train

    docs = make([(i, f"the cat {i} sat on the mat") for i in range(50)])
    shuffles = docs.sparkSession.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses()
    tidy(docs.sparkSession)
    time.sleep(2)
    before = shuffles.size()
    model = train(docs)
    until = time.time() + 20
    while shuffles.size() > before and time.time() < until:
        time.sleep(0.5)
    assert shuffles.size() <= before and model[0]


def test_quality(spark):
    from lorespark.llm.quality_kn import classify

    sf = "/root/testdata/sf0.01"
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    got = classify(docs, labels).join(labels, "doc_id").collect()
    good, bad = [r for r in got if r.quality == 1], [r for r in got if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.97 * len(good) and sum(r.kept for r in bad) <= 0.15 * len(bad)


def test_quality_odd(spark, clashing, make):
    from lorespark.llm.quality_kn import classify

    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (2, None, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    out = classify(clashing, labels)
    assert out.count() == len(ODD) and out.filter("doc_id in (3, 4) and not kept").count() == 0
    none = classify(clashing, labels.limit(0))
    assert none.filter("kept").count() == len(ODD)
    assert classify(make([]), labels).count() == 0


# --- 10: packing ---------------------------------------------------------------


def check_packing(got, ids_of):
    pieces: dict = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    assert {d: sorted((r.start, r.length) for r in p) for d, p in pieces.items()}.keys() == ids_of.keys()
    for d, p in pieces.items():
        at = 0
        for r in sorted(p, key=lambda r: r.start):
            ids = np.array(ids_of[d][r.start : r.start + r.length], "<u4")
            assert r.start == at and len(ids) == r.length and zlib.crc32(ids.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids_of[d])
            at += r.length
        assert at == len(ids_of[d])
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at == 4096 or (at < 4096 and at & (at - 1) == 0)
    return sequences


def test_packing(spark, make):
    from tokenizers import Tokenizer

    from lorespark.llm.common import tokenizer_file
    from lorespark.llm.packing import pack

    tok = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    data = [(r.doc_id, r.text) for r in documents(spark, "/root/testdata/sf0.01").collect()]
    data += [(10**6, None), (10**6 + 1, ""), (10**6 + 2, LONG), (10**6 + 3, "it's  İ <|endoftext|>x 中文 ﬁ a½2 ''s \x1c")]
    ids_of = {d: tok.encode(t or "", add_special_tokens=False).ids + [2] for d, t in data}
    for block in (2_097_152, 40_000):
        check_packing(pack(make(data).repartition(3), block_tokens=block).collect(), ids_of)


def test_packing_odd(clashing, make):
    from lorespark.llm.packing import pack

    assert pack(make([])).count() == 0
    null = pack(clashing).filter("doc_id is null").collect()
    assert sum(r.length for r in null) == null[0].doc_tokens == 3


def test_packing_balances_cost():
    from lorespark.llm.packing import Packer, cost

    rng = random.Random(1)
    items = [(i, 0, rng.randint(1, 3000)) for i in range(400)]
    placed, left = Packer().block(items, last=True)
    assert not left
    load: dict = {}
    for _, _, n, s, _ in placed:
        load.setdefault(s, []).append(n)
    full = [sum(map(cost, v)) for v in load.values() if sum(v) == 4096]
    assert max(full) <= 1.6 * min(full)


def test_encoder_equals_tokenizer(spark):
    from lorespark.llm.word_encoder import WordEncoder

    encode = WordEncoder("word_bpe_49k.json")
    texts = [r.text for r in documents(spark, "/root/testdata/sf0.01").limit(300).collect()]
    texts += ["don't I'LL ''re we've", "naïve façade ÀÉÎ ß ÿ ª º µ ² ½ ×÷", "a\r\nb\tc\x0bd\x85e", "<|startoftext|> <| |>", "Σίσυφος ΣΑΣ ǅ İ", "é ́x"]
    want = [np.array(e.ids, "<u4").tobytes() for e in encode._tok.encode_batch(texts, add_special_tokens=False)]
    assert encode.encode(texts) == want


def test_words_are_split_in_time(make):
    """Numerals cost no pass over all their ranges at every character."""
    import time

    from lorespark.llm.langid import words_of

    text = "où été 12 x² " * 40_000
    began = time.process_time()
    assert len(words_of(text)) == 120_000
    assert time.process_time() - began < 0.35


@pytest.mark.parametrize("piece", [1_000_000, 7])
def test_links_are_contracted_before_rounds(spark, monkeypatch, piece):
    import random

    from lorespark.llm import graph
    from lorespark.llm.common import materialize

    monkeypatch.setattr(graph, "PIECE", piece)
    rounds = []
    own = graph._round
    monkeypatch.setattr(graph, "_round", lambda edges: rounds.append(1) or own(edges))
    rng = random.Random(3)
    pairs = [(rng.randrange(-40, 40), rng.randrange(-40, 40)) for _ in range(45)]
    pairs = [(a, b) for a, b in pairs if a != b]
    least = {x: x for p in pairs for x in p}
    while (fresh := {x: min([least[x]] + [least[b if a == x else a] for a, b in pairs if x in (a, b)]) for x in least}) != least:
        least = fresh
    got = graph.components(materialize(spark.createDataFrame(pairs, "u long, v long").repartition(3)))
    assert rows(got, "node", "root") == sorted([(x, r) for x, r in least.items() if x != r], key=repr)
    assert bool(rounds) == (piece == 7)
