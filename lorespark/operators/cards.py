"""Study cards: CSV text to rows and back."""

from __future__ import annotations

import csv
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from lorespark.functions.text import strip
from lorespark.sources.stores import Files


csv.field_size_limit(2**31 - 1)  # an answer may be one long cell


def parse_csv(text: str | None) -> list[list[str]]:
    """Rows of default-dialect CSV with a cell that is not blank; a text that is no CSV is one cell."""
    try:
        rows = list(csv.reader(io.StringIO(text or "")))
    except csv.Error:
        rows = [[text or ""]]
    return [row for row in rows if any(cell.strip() for cell in row)]


def parse(answers: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, row, cells) of each answer's CSV, line breaks inside quotes included; rows may differ in length."""
    kind = dict(answers.dtypes)[key]

    def parsed(batches):
        for batch in batches:
            ids, rows, cells = [], [], []
            for one, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i, row in enumerate(parse_csv(body)):
                    ids.append(one)
                    rows.append(i)
                    cells.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(rows, pa.int32()), pa.array(cells, pa.list_(pa.string()))], [key, "row", "cells"])

    return answers.select(key, text).mapInArrow(parsed, f"{key} {kind}, row int, cells array<string>")


COLUMNS = ("front", "back", "extra")


@F.udtf
class CardTable:
    """A table function for SQL: ``SELECT id, c.* FROM answers, LATERAL cards(text, 3) c``.

    Columns are ``row`` and, as many as the constant second argument says (3
    if it is left out), front, back, extra and further ``c3``, ``c4`` ...
    """

    @staticmethod
    def analyze(text: AnalyzeArgument, fields: AnalyzeArgument | None = None) -> AnalyzeResult:
        many = 3 if fields is None else fields.value
        if text.dataType.typeName() not in ("string", "void") or not isinstance(many, int) or many < 1 or (fields is not None and not fields.isConstantExpression):
            raise ValueError("cards(text STRING [, fields INT]): fields is a constant of at least 1")
        schema = StructType().add("row", IntegerType())
        for i in range(many):
            schema = schema.add(COLUMNS[i] if i < len(COLUMNS) else f"c{i}", StringType())
        return AnalyzeResult(schema)

    def eval(self, text: str, fields: int = 3):
        for i, cells in enumerate(parse_csv(text)):
            yield (i, *(cells + [None] * fields)[:fields])


def register(spark: SparkSession) -> None:
    """Makes ``cards`` known to the session's SQL."""
    spark.udtf.register("cards", CardTable)


def parse_lines(answers: DataFrame, key: str = "id", text: str = "text", fields: int = 3) -> DataFrame:
    """JVM-only for answers whose rows are single lines: (key, line, c0, c1, ...), blank rows dropped."""
    schema = ", ".join(f"c{i} string" for i in range(fields))
    lined = answers.select(key, F.posexplode(F.split(text, "\r?\n", -1)).alias("line", "__line")).filter(strip("__line") != "")
    rows = lined.select(key, "line", F.from_csv("__line", schema, {"quote": '"', "escape": '"'}).alias("c")).select(key, "line", "c.*")
    cells = F.array(*[F.col(f"c{i}") for i in range(fields)])
    return rows.filter(F.exists(cells, lambda c: F.coalesce(strip(c), F.lit("")) != ""))


def typed(cards: DataFrame) -> DataFrame:
    """``cells`` as front, back and extra; null where a row is shorter."""
    return cards.select(*[c for c in cards.columns if c != "cells"], *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(COLUMNS)])


def export_name(now: Column | None = None) -> Column:
    stamp = F.date_format(F.current_timestamp() if now is None else now, "yyyyMMdd_HHmmss")
    return F.concat(F.lit("anki_cards_"), stamp, F.lit(".csv"))


def to_csv_text(text: str) -> str:
    """An answer parsed and written again in the default dialect; its blank rows stay."""
    out = io.StringIO(newline="")
    csv.writer(out).writerows(csv.reader(io.StringIO(text)))
    return out.getvalue()


def read_export(spark, path: str) -> DataFrame:
    """(row, front, back, extra) of an exported file."""
    answer = spark.read.text(path, wholetext=True).select(F.lit(0).alias("id"), F.col("value").alias("text"))
    return typed(parse(answer)).drop("id")


def export(spark, text: str, folder: str, now=None) -> str:
    """Writes one answer's cards to a stamped file in ``folder`` and gives its path."""
    if not (text or "").strip():
        raise ValueError("there are no cards to export")
    name = spark.range(1).select(export_name(now).alias("name")).first().name
    Files(spark, folder).write(name, to_csv_text(text))
    return f"{folder.rstrip('/')}/{name}"
