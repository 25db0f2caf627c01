"""Loading document files: a folder of binary files in, one row per page or file out.

A loader takes a file's bytes and gives its pages. Loaders run per Arrow batch
on executors; a file that fails gives one row with ``error`` set and fails
nothing else. Formats are told by suffix, and a registry may be extended.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions.text import suffix
from lorespark.schemas import PAGE
from lorespark.sources.compound import load_doc, load_xls
from lorespark.sources.pdf import load_pdf

Pages = list[str]

#: Files are taken up a few at a time; a batch holds their whole contents.
FILES_PER_BATCH = 16


def load_text(content: bytes) -> Pages:
    return [content.decode("utf-8-sig")]


class _Visible(HTMLParser):
    """Text outside scripts and styles; block elements part lines."""

    HIDDEN = {"script", "style", "noscript", "template", "head"}
    BLOCKS = {"p", "div", "br", "li", "ul", "ol", "tr", "table", "section", "article", "header", "footer", "nav", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in self.HIDDEN
        if tag in self.BLOCKS:
            self.parts.append("\n\n")

    def handle_endtag(self, tag):
        self.hidden = max(0, self.hidden - (tag in self.HIDDEN))
        if tag in self.BLOCKS:
            self.parts.append("\n\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(re.sub(r"\s+", " ", data))


def visible_text(page: str) -> str:
    """Readable text of an HTML page: blocks parted by an empty line."""
    reader = _Visible()
    reader.feed(page)
    reader.close()
    blocks = [" ".join(b.split()) for b in "".join(reader.parts).split("\n\n")]
    return "\n\n".join(b for b in blocks if b)


def load_html(content: bytes) -> Pages:
    return [visible_text(content.decode("utf-8", "replace"))]


_MARKS = [(re.compile(p, re.M), r) for p, r in ((r"^#{1,6}\s+", ""), (r"^\s*```.*$", ""), (r"^>\s?", ""), (r"!\[([^\]]*)\]\([^)]*\)", r"\1"), (r"\[([^\]]*)\]\([^)]*\)", r"\1"), (r"(\*\*|__)(.+?)\1", r"\2"), (r"`([^`\n]*)`", r"\1"))]


def load_markdown(content: bytes) -> Pages:
    """Markdown without its marks; paragraphs stay parted by empty lines."""
    text = content.decode("utf-8-sig").replace("\r\n", "\n")
    for pattern, plain in _MARKS:
        text = pattern.sub(plain, text)
    return [text]


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(archive.read(name))


def load_docx(content: bytes) -> Pages:
    """Paragraphs of a Word document, parted by empty lines."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = _xml(archive, "word/document.xml")
    found = []
    for paragraph in body.iter(f"{space}p"):
        runs = [{f"{space}t": x.text or "", f"{space}tab": "\t", f"{space}br": "\n"}.get(x.tag, "") for x in paragraph.iter()]
        found.append("".join(runs))
    return ["\n\n".join(p for p in found if p.strip())]


def load_xlsx(content: bytes) -> Pages:
    """Rows of all sheets, one line each, cells parted by tabs."""
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = archive.namelist()
        shared = [] if "xl/sharedStrings.xml" not in names else ["".join(t.text or "" for t in s.iter(f"{space}t")) for s in _xml(archive, "xl/sharedStrings.xml").iter(f"{space}si")]
        rows = []
        for name in sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1])):
            for row in _xml(archive, name).iter(f"{space}row"):
                cells = []
                for cell in row.iter(f"{space}c"):
                    value = cell.find(f"{space}v")
                    if cell.get("t") == "inlineStr":
                        cells.append("".join(t.text or "" for t in cell.iter(f"{space}t")))
                    elif value is not None and value.text is not None:
                        cells.append(shared[int(value.text)] if cell.get("t") == "s" else value.text)
                if cells:
                    rows.append("\t".join(cells))
    return ["\n".join(rows)]


LOADERS: dict[str, Callable[[bytes], Pages]] = {
    ".pdf": load_pdf, ".txt": load_text, ".text": load_text, ".docx": load_docx, ".doc": load_doc, ".xlsx": load_xlsx, ".xls": load_xls,
    ".html": load_html, ".htm": load_html, ".md": load_markdown, ".markdown": load_markdown,
}
SPREADSHEETS = [".xls", ".xlsx"]


def scan(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """The files of one folder, not of those below it: file, ext, length, content. Spark's reader passes over empty files; they are added by name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(f"{folder.rstrip('/')}/*")
    found = files.select(file_name("path").alias("file"), "length", "content")
    glob = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{pattern}")
    listed = glob.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(glob) or []
    empty = [(s.getPath().getName(), 0, bytearray()) for s in listed if s.isFile() and s.getLen() == 0]
    if empty:
        found = found.unionByName(spark.createDataFrame(empty, "file string, length long, content binary"))
    return found.withColumn("ext", suffix("file"))


def file_name(path: Column | str) -> Column:
    """The last part of a file's address, as it was named."""
    last = F.element_at(F.split(path, "/"), -1)
    return F.url_decode(F.replace(last, F.lit("+"), F.lit("%2B")))


def supported(ext: Column | str, loaders: dict | None = None) -> Column:
    return (F.col(ext) if isinstance(ext, str) else ext).isin(*(loaders or LOADERS))


def load(files: DataFrame, loaders: dict[str, Callable[[bytes], Pages]] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``files`` (file, ext, content) as pages: file, doc_ix, text, metadata, error, and the string columns in ``keep``.

    Unsupported files are to be filtered out before; metadata holds ``source``
    and, for files of several pages, ``page``.
    """
    registry = loaders or LOADERS

    def read(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, FILES_PER_BATCH):
                rows = []
                for name, ext, content, *kept in zip(*(c.to_pylist() for c in batch.slice(lo, FILES_PER_BATCH).columns)):
                    try:
                        pages = registry[ext](content or b"") or [None]  # a file without pages is a row, too
                    except Exception as e:  # noqa: BLE001 - one bad file is a row, not the end of the job
                        rows.append((name, 0, None, None, f"{type(e).__name__}: {e}", *kept))
                        continue
                    for i, text in enumerate(pages):
                        rows.append((name, i, text, [("source", name)] + ([("page", str(i))] if len(pages) > 1 else []), None, *kept))
                columns = list(zip(*rows)) or [[]] * (5 + len(keep))
                kinds = (pa.string(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), *[pa.string()] * len(keep))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "doc_ix", "text", "metadata", "error", *keep])

    return files.select("file", "ext", "content", *keep).mapInArrow(read, PAGE + "".join(f", {c} string" for c in keep))


def html_text(html: Column | str) -> Column:
    """A JVM-only variant for well-formed pages: scripts, styles, comments and tags go, white space is folded."""
    h = F.col(html) if isinstance(html, str) else html
    h = F.regexp_replace(h, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    h = F.regexp_replace(h, "<[^>]*>", " ")
    for reference, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        h = F.replace(h, F.lit(reference), F.lit(char))
    return F.trim(F.regexp_replace(h, r"\s+", " "))
