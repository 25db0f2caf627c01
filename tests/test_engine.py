"""Loaders, stores, flows and joins on small inputs."""

from __future__ import annotations

import io
import json
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespark import schemas
from lorespark.functions.i18n import get_text
from lorespark.operators import cards, dashboard, dedup, manifest, retrieval, vectors
from lorespark.operators.chunking import Method
from lorespark.plans import ingest, study
from lorespark.providers import Answer, EchoChat, HashEmbedder, endpoint, provider_of
from lorespark.sources import loaders, stores
from lorespark.streaming import ingest as streaming
from lorespark.streaming.ingest import watch


def docx(*paragraphs):
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    return zipped({"word/document.xml": f'<w:document xmlns:w="{space}"><w:body>{body}</w:body></w:document>'})


def xlsx():
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {space}><sheetData><row><c t="s"><v>0</v></c><c><v>4</v></c></row><row><c t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>'
    return zipped({"xl/sharedStrings.xml": f"<sst {space}><si><t>shared</t></si></sst>", "xl/worksheets/sheet1.xml": sheet})


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in files.items():
            z.writestr(name, content)
    return out.getvalue()


@pytest.fixture
def project(spark, tmp_path):
    p = stores.Project(spark, str(tmp_path), "demo").create().create()
    put(p, "notes one.txt", "First sentence. Second one.")
    put(p, "page.HTML", "<html><head><style>p{}</style></head><body><p>Hello &amp; all.</p><script>x</script><p>More+1.</p></body></html>")
    put(p, "sheet.xlsx", xlsx())
    put(p, "word.docx", docx("Para one.", "Para two."))
    put(p, "readme.md", "# Head\n\n\n\n**bold** [link](http://x)\n")
    put(p, "broken.docx", "not a zip")
    put(p, "picture.png", "x")
    put(p, "empty.txt", "")
    return p


def put(p, name, content):
    from pathlib import Path

    Path(p.raw, name).write_bytes(content if isinstance(content, bytes) else content.encode())


def test_ingest_incrementally(project):
    report = ingest.process(project, Method.PARAGRAPH).first()
    assert tuple(report) == (8, 6, 1, 1)
    chunks = {r.chunk_id: r.chunk_text for r in stores.read_chunks(project.spark, project.chunks).collect()}
    assert chunks["notes one_para0"] == "First sentence. Second one." and chunks["page_para0"] == "Hello & all." and chunks["page_para1"] == "More+1."
    assert chunks["sheet_para0"] == "shared\t4" and chunks["sheet_para1"] == "in" and chunks["word_para1"] == "Para two." and chunks["readme_para1"] == "bold link"
    entries = {r.file: r for r in project.manifest.read().collect()}
    assert entries["empty.txt"].n_chunks == 0 and entries["word.docx"].n_chunks == 2 and "broken.docx" not in entries
    assert [r.file for r in manifest.without_chunks(project.manifest.read()).collect()] == ["empty.txt"]
    again = ingest.process(project, Method.PARAGRAPH).first()
    assert (again.processed, again.skipped, again.failed) == (0, 7, 1)
    put(project, "notes one.txt", "Changed.")
    assert ingest.process(project, Method.PARAGRAPH).first().processed == 1
    assert stores.read_chunks(project.spark, project.chunks).filter("stem = 'notes one'").first().chunk_text == "Changed."
    ingest.embed_chunks(project)
    n = project.vectors.read().count()
    assert n == stores.read_chunks(project.spark, project.chunks).count() and project.ready()
    put(project, "word.docx", docx("Only one."))
    ingest.process(project, Method.PARAGRAPH)
    ingest.embed_chunks(project, only=project.spark.createDataFrame([("word",)], "stem string"))
    assert project.vectors.read().count() == n
    ingest.embed_chunks(project, prune=True)
    assert project.vectors.read().count() == n - 1
    counts = dashboard.counts(stores.read_chunks(project.spark, project.chunks), project.vectors.read()).first()
    assert counts.progress == 1.0
    hits, stats = study.search(project.vectors.read(), "shared 4", 3)
    assert hits.first().chunk_id == "sheet_para0" and stats.first().min_distance < 1e-6
    assert ingest.process(project, Method.SENTENCE, force=True).first().processed == 6
    assert [r.project for r in stores.projects(project.spark, project.path.rsplit("/", 1)[0]).collect()] == ["demo"]


def test_a_file_that_becomes_empty_loses_its_chunks(project):
    ingest.process(project, Method.SENTENCE)
    put(project, "notes one.txt", " ")
    assert ingest.process(project, Method.SENTENCE).first().processed == 1
    chunks = stores.read_chunks(project.spark, project.chunks)
    assert chunks.filter("file = 'notes one.txt'").isEmpty() and chunks.filter("file = 'word.docx'").count() > 0
    assert project.manifest.read().filter("file = 'notes one.txt'").first().n_chunks == 0


def test_rewrite_and_upload(project):
    rows = [("a.txt", "a", 0, 0, "a0", "x", {}), ("a.txt", "a", 0, 1, " ", "y", {}), ("a.txt", "a", 0, 2, None, "y", {}), ("b.txt", "b", 0, 0, "", "z", {}), ("c.txt", "c", 0, 0, "c0", "z", {})]
    from lorespark import schemas

    chunks = project.spark.createDataFrame(rows, schemas.CHUNK_ROW)
    stores.replace_chunks(chunks, chunks.select("file"), project.chunks)
    assert stores.rewrite_without_empty_ids(project) == 1 and stores.rewrite_without_empty_ids(project) == 0
    assert sorted((r.file, r.chunk_id) for r in stores.read_chunks(project.spark, project.chunks).collect()) == [("a.txt", "a0"), ("b.txt", ""), ("c.txt", "c0")]
    got = stores.upload(project, {"new.md": b"# New", "word.docx": b"other", "tool.exe": b"x", "../up.txt": b"x"}).collect()
    assert [r.outcome for r in got] == ["stored", "exists", "unsupported", "unsupported"]
    from pathlib import Path

    assert Path(project.raw, "new.md").read_bytes() == b"# New" and Path(project.raw, "word.docx").read_bytes() != b"other"


def test_long_cells_and_exported_cards(spark, tmp_path):
    from lorespark.operators import cards

    long_ = "x" * 200_000
    answers = spark.createDataFrame([(1, f'a,"{long_}",c\n\n'), (2, "a\x00b"), (3, None)], "id long, text string")
    got = {(r.id, r.row): r.cells for r in cards.parse(answers).collect()}
    assert got[1, 0] == ["a", long_, "c"] and (3, 0) not in got
    path = cards.export(spark, 'f1,"b, 1",e1\n\nf2,b2\n', str(tmp_path))
    read = sorted(tuple(r) for r in cards.read_export(spark, path).collect())
    assert [r[1:] for r in read] == [("f1", "b, 1", "e1"), ("f2", "b2", None)]


def stream(project, checkpoint, **how):
    query = watch(project, checkpoint, **how)
    query.awaitTermination(180)
    assert query.exception() is None


def known(rows):
    return sorted((r.file, r.hash, r.n_chunks, r.chunk_method) for r in rows.collect())


def held(project):
    return sorted((r.file, r.doc_ix, r.pos, r.chunk_id, r.chunk_text) for r in stores.read_chunks(project.spark, project.chunks).collect())


@pytest.mark.parametrize("method", [Method.SENTENCE, Method.FIXED])
def test_stream_state_is_the_manifest(project, tmp_path, method):
    """Restart, repeat, change and failure: the state stays what a batch run would have written, and so do the chunks."""
    from pathlib import Path

    spark, landing, point = project.spark, tmp_path / "landing", str(tmp_path / "checkpoint")
    other = stores.Project(spark, str(tmp_path / "batch"), "p").create()

    def deliver(name, files):
        (landing / name).mkdir(parents=True)
        for f, content in files.items():
            (landing / name / f).write_bytes(content)
            if content:
                Path(other.raw, f).write_bytes(content)

    how = {"method": method, "size": 40, "overlap": 5, "landing": str(landing)}
    contents = {f.name: f.read_bytes() for f in Path(project.raw).iterdir()}
    deliver("monday", contents)
    stream(project, point, files_per_batch=2, **how)
    ingest.process(other, method, 40, 5)
    assert known(streaming.manifest_of(project, point)) == known(other.manifest.read())
    assert held(project) == held(other) and "broken.docx" not in {x[0] for x in known(streaming.state(spark, point))}
    before = {r.file: r.last_processed for r in streaming.state(spark, point).collect()}
    deliver("tuesday", {"notes one.txt": b"Never seen. By anybody."})
    time.sleep(0.02)  # two versions in one batch: the later one counts
    deliver("wednesday", {"page.HTML": contents["page.HTML"], "notes one.txt": b"All new. Two of them.", "late.txt": b"Late.", "word.docx": b"broken now"})
    stream(project, point, **how)  # a restart
    ingest.process(other, method, 40, 5)
    assert known(streaming.manifest_of(project, point)) == known(other.manifest.read())
    after = {r.file: r.last_processed for r in streaming.state(spark, point).collect()}
    assert {f for f in after if after[f] != before.get(f)} == {"notes one.txt", "late.txt"}
    assert held(project) == held(other) and any(x[0] == "word.docx" for x in held(project))
    streaming.settle(project, point)
    assert known(project.manifest.read()) == known(streaming.state(spark, point))


def test_stream_knows_what_a_batch_run_did(project, tmp_path):
    ingest.process(project, Method.SENTENCE)
    before = held(project)
    stream(project, str(tmp_path / "checkpoint"))
    assert streaming.state(project.spark, str(tmp_path / "checkpoint")).count() == 0 and held(project) == before


def test_texts(project, tmp_path):
    failures = ingest.extract_texts(project.spark, project.raw, str(tmp_path / "texts"))
    assert [r.file for r in failures.collect()] == ["broken.docx"]
    texts = {r.stem: r.value for r in project.spark.read.text(str(tmp_path / "texts"), wholetext=True).collect()}
    assert texts["word"].strip() == "Para one.\nPara two."


def test_chunk_files_and_manifest_json(spark, tmp_path):
    for stem, ids in (("a", ["x", ""]), ("b", ["x", "y"])):
        entries = [{"chunk_id": i, "chunk_text": stem + i, "metadata": {"source": "s", "page": 3, "none": None}} for i in ids]
        (tmp_path / f"{stem}_chunks.json").write_text(json.dumps(entries, indent=2), encoding="utf-8")
    (tmp_path / "other.json").write_text("[]")
    read = stores.read_chunk_files(spark, str(tmp_path))
    assert read.count() == 4 and read.filter("stem = 'a' and pos = 0").first().metadata["page"] == "3"
    assert stores.read_chunk_files(spark, str(tmp_path), spark.createDataFrame([("b",)], "stem string")).count() == 2
    first = dedup.keep_first(read, "chunk_id", ("stem", "pos")).collect()
    assert {r.chunk_id: r.stem for r in first} == {"x": "a", "": "a", "y": "b"}
    assert [tuple(r) for r in dedup.repeated_keys(read).collect()] == [("x", 2)]
    assert stores.drop_empty_ids(read).count() == 3
    row = stores.manifest_from_json(json.dumps({"f.md": {"hash": "h", "n_chunks": 2, "last_processed": "2025-05-17T20:25:33.123456"}}), spark).first()
    assert (row.file, row.n_chunks, row.chunk_method, str(row.last_processed)) == ("f.md", 2, None, "2025-05-17 20:25:33.123456")
    assert stores.legacy_metadata('[{"source": "a", "source_file": "b"}, {"source": "a", "source_file": "b"}]', spark).count() == 2


def test_retrieval_edges(spark):
    ranked = spark.createDataFrame([(1, "a", {"source_file": "f", "source": "s"}, 0.1), (2, None, {}, 0.2), (3, "b", {"source": "s"}, 0.2), (4, "miss", {}, 0.3)], "rank int, chunk_id string, metadata map<string,string>, distance double")
    hits = retrieval.hits(ranked)
    assert [tuple(r)[:3] for r in hits.orderBy("rank").collect()] == [(1, "a", "f"), (3, "b", "s"), (4, "miss", "unknown")]
    chunks = spark.createDataFrame([("f1", 0, "a", "text a", {"title": "T", "doi": ""}), ("f2", 0, "a", "later", {}), ("f1", 1, "b", "", {"text": "from meta"})], "file string, pos int, chunk_id string, chunk_text string, metadata map<string,string>")
    assert [r.chunk_text for r in retrieval.lookup(hits, chunks).collect()] == ["text a"]
    context = retrieval.context_chunks(hits, chunks)
    assert [r.chunk_text for r in context.orderBy("rank").collect()] == ["text a", "from meta", "[Not found]"]
    assert retrieval.context_block(context).first().context == "Chunk 1: text a\n[Title: T; Source: unknown]\n\nChunk 2: from meta\n[Source: unknown]"
    chinese = retrieval.context_chunks(hits, chunks.limit(0), missing="未找到", unknown="未知")
    assert retrieval.context_block(chinese).first().context is None
    assert tuple(study.summarize(chinese, "q").first()) == (None, None, None)
    done = study.summarize(context, "q {context}").first()
    assert done.tokens > 0 and done.processing_time.count(".") == 1 and "q {context}" in done.summary


class FailingChat:
    def __call__(self, *_):
        raise OSError("down")


def test_model_calls(spark, monkeypatch):
    asked = spark.createDataFrame([("find x",), ("",), (None,)], "user_query string")
    assert [r.std_query for r in study.rewrite(asked, make=FailingChat).collect()] == ["find x", "", ""]
    assert "find x" in study.rewrite(asked, make=EchoChat).first().std_query
    models = spark.createDataFrame([("gpt-4o",), ("qwen-max",), ("claude-3",), ("x",)], "m string")
    assert [r.p for r in models.select(provider_of(F.col("m")).alias("p")).collect()] == ["openai", "qwen", "openai", "openai"]
    monkeypatch.setenv("QWEN_API_BASE", "http://own")
    assert endpoint("qwen", "k") == ("k", "http://own") and endpoint("qwen", None, "http://arg")[1] == "http://arg"
    assert Answer(True, "x", 1).error is None and len(HashEmbedder(8)(["a b"])[0]) == 8
    assert get_text("中文", "review", "not_found") == "未找到" and get_text("de", "review", "not_found") == "[Not found]"


def test_make_cards(spark):
    chunks = spark.createDataFrame([("f", 0, "c1", "some material on cells", {"source": "s"})], "file string, pos int, chunk_id string, chunk_text string, metadata map<string,string>")
    from lorespark.providers import embed

    stored = embed(chunks.select("chunk_id", "chunk_text", "metadata"), "chunk_text")
    got = study.make_cards(spark, "cells", stored, chunks, num_cards=2, lang="中文").first().answer
    assert got.ok and "some material on cells" in got.text
    with pytest.raises(ValueError, match="no relevant"):
        study.make_cards(spark, "cells", stored, chunks.limit(0))


def test_cards(spark, tmp_path):
    text = 'a, "b,c",d\n\n  ,\n"multi\nline",x\none\n'
    answers = spark.createDataFrame([(1, text), (2, None)], "id long, text string")
    got = cards.parse(answers).orderBy("id", "row").collect()
    assert [r.cells for r in got] == [["a", ' "b', 'c"', "d"], ["multi\nline", "x"], ["one"]]
    typed = cards.typed(cards.parse(answers)).orderBy("row").collect()
    assert (typed[1].front, typed[1].back, typed[1].extra) == ("multi\nline", "x", None)
    path = cards.export(spark, 'q,"a, b"\n\nx,y\n', str(tmp_path), F.lit("2025-05-17 20:25:33").cast("timestamp"))
    assert path.endswith("anki_cards_20250517_202533.csv")
    assert (tmp_path / "anki_cards_20250517_202533.csv").read_bytes() == b'q,"a, b"\r\n\r\nx,y\r\n'
    with pytest.raises(ValueError, match="no cards"):
        cards.export(spark, " \n", str(tmp_path))


def test_vectors(spark):
    rows = [("a", [1.0, 0.0], 1), ("b", [0.0, 1.0], 2), ("c", [1.0, 0.0], 3)]
    stored = spark.createDataFrame(rows, "chunk_id string, vector array<float>, v int")
    assert [(r.rank, r.chunk_id, r.distance) for r in vectors.top_k(stored, [1.0, 0.0], 2).orderBy("rank").collect()] == [(1, "a", 0.0), (2, "c", 0.0)]
    assert vectors.top_k(stored, [1.0, 0.0], 3, max_distance=0.5).count() == 2
    for metric in ("cosine", "inner_product"):
        assert vectors.top_k(stored, [0.0, 1.0], 1, metric).first().chunk_id == "b"
    with pytest.raises(ValueError, match="metric"):
        vectors.top_k(stored, [1.0, 0.0], 1, "x")
    new = spark.createDataFrame([("a", [0.0, 0.0], 9), ("z", [0.0, 0.0], 9)], stored.schema)
    assert {r.chunk_id: r.v for r in vectors.upsert(stored, new).collect()} == {"a": 9, "b": 2, "c": 3, "z": 9}
    assert vectors.distance_stats(vectors.top_k(stored.limit(0), [1.0, 0.0], 2)).first().min_distance is None


def test_knn_join_is_exact(spark, sf_dir):
    import numpy as np

    stored = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    queries = stored.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    got = {(r.query_id, r["rank"]): r.vec_id for r in vectors.knn_join(stored.repartition(5), queries, 4).collect()}
    table = {r.vec_id: np.array(r.embedding) for r in stored.collect()}
    for q in (i for i in table if i % 100 == 0):
        order = sorted(table, key=lambda v: (((table[v] - table[q]) ** 2).sum(), v))[:4]
        assert [got[q, k] for k in (1, 2, 3, 4)] == order
    blocks = {(r.query_id, r["rank"]): r.vec_id for r in vectors.knn_join(stored, queries, 4, block=2).collect()}
    assert blocks == got


def test_files_are_read_once_and_counters_agree(project):
    """One scan of the folder's contents; the observed counters are the manifest's."""
    reads = project.spark.sparkContext.accumulator(0)

    def counting(content):
        reads.add(1)
        return loaders.load_text(content)

    files = loaders.scan(project.spark, project.raw).filter("ext = '.txt'")
    before = dict(loaders.LOADERS)
    try:
        loaders.LOADERS[".txt"] = counting
        report = ingest.process(project, Method.SENTENCE, files=files).first()
    finally:
        loaders.LOADERS.update(before)
    assert tuple(report) == (2, 2, 0, 0) and reads.value == 2
    assert project.manifest.read().count() == report.processed
    assert not stores.Files(project.spark, f"{project.path}/staging").folders()
    assert tuple(ingest.process(project, Method.SENTENCE, files=files).first()) == (2, 0, 2, 0)
    assert tuple(ingest.process(project, Method.SENTENCE, files=files.limit(0)).first()) == (0, 0, 0, 0)


def test_versioned_table(spark, tmp_path):
    t = stores.VersionedTable(spark, str(tmp_path / "t"), schemas.MANIFEST)
    assert t.read().count() == 0
    for n in range(4):
        t.replace(manifest.upsert(t.read(), spark.createDataFrame([(f"f{n}", "h", n, None, "m")], schemas.MANIFEST)))
    assert t.read().count() == 4 and len(t.files.folders()) == 2


def test_run_report_adds_up(spark):
    outcome = spark.createDataFrame([("changed", None), ("changed", True), ("unchanged", None), ("unsupported", None)], "state string, failed boolean")
    assert tuple(manifest.counters(outcome).first()) == (4, 1, 2, 1)
    assert loaders.load(spark.createDataFrame([("x.doc", ".doc", bytearray(b"x"))], "file string, ext string, content binary")).first().error.startswith("BadFile")


def test_embedding_of_words_that_cancel_out(spark, tmp_path):
    """As the query's SQL says: a text with an ASCII word has length 1, all others, null ones too, 0."""
    import duckdb

    from lorespark.plans.oracle import ORACLE_SQL
    from lorespark.plans.queries import QUERIES

    opposite = next(f"w{i}" for i in range(10_000) if np.allclose(HashEmbedder()([f"w{i}"])[0], -np.array(HashEmbedder()(["word"])[0])))
    texts = [f"word {opposite}", None, "", " ... ", "été", "é", "漢字", "İ", "K", "a_1", "_", "two words"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = duckdb.sql(ORACLE_SQL["embed_stub"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    assert sorted(map(tuple, QUERIES["embed_stub"](spark, str(tmp_path)).collect())) == sorted(want)
    assert abs(np.linalg.norm(HashEmbedder()([texts[0]])[0]) - 1) < 1e-6 and any(HashEmbedder()(["é"])[0])


def test_embedder_keeps_words():
    """Each word is hashed once."""
    import hashlib
    from unittest import mock

    with mock.patch("lorespark.providers.hashlib.md5", wraps=hashlib.md5) as hashed:
        HashEmbedder()(["a b a", "b a c"] * 100)
    assert hashed.call_count == 3


def test_cards_search_once(spark):
    """The vectors are gone through once, though both lookup and context use the hits."""
    from lorespark.plans.study import make_cards
    from lorespark.providers import embed

    chunks = spark.createDataFrame([("a", 0, str(i), f"word {i}", {"source": "a"}) for i in range(30)], "file string, pos int, chunk_id string, chunk_text string, metadata map<string,string>")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    stored = embed(chunks.select("chunk_id", "chunk_text", "metadata"), "chunk_text")
    stored = stored.mapInArrow(counted, stored.schema)
    assert make_cards(spark, "word 3", stored, chunks).first().answer.ok and seen.value == 30
