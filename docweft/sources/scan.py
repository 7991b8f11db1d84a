"""Folder scan and document import. What can't be read becomes a row with an error, never an exception."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType, TimestampType

from ..functions import text as T
from ..functions import values as X
from ..operators.retrieval import import_warnings, wants_ocr
from .pdf import image_pages, text_layer

# What can be imported, and what is taken as a template.
SOURCES, TEMPLATES = [".pdf", ".doc", ".docx", ".txt"], [".md"]
FILE = StructType([StructField("path", StringType()), StructField("modificationTime", TimestampType()), StructField("length", LongType()), StructField("content", BinaryType())])


def files(spark: SparkSession, folder: str, extensions: list[str] = SOURCES) -> DataFrame:
    """path, name, extension, size of the files of a folder, not of its folders, in natural order. Contents aren't read."""
    found = spark.read.format("binaryFile").schema(FILE).load(folder).select("path", "length", "modificationTime")
    named = found.select("path", X.base_name(F.col("path")).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return named.withColumn("extension", X.extension(F.col("name"))).filter(F.col("extension").isin(extensions)).orderBy(X.natural_key(F.col("name")), "path")


def docx_text(data: bytes) -> str:
    """The raw text of a Word document: runs of a paragraph joined, paragraphs two line ends apart."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        xml = z.read("word/document.xml").decode("utf-8")
    parts = re.findall(r"<w:p[ >].*?</w:p>|<w:p>.*?</w:p>", xml, re.S)
    one = lambda p: "".join({"tab": "\t", "br": "\n"}.get(mark) or unescape(t, {"&quot;": '"', "&apos;": "'"}) for t, mark in re.findall(r"<w:t(?: [^>]*)?>([^<]*)</w:t>|<w:(tab|br)/>", p))
    return "\n\n".join(one(p) for p in parts)


def docx_bytes(text: str) -> bytes:
    """A minimal Word document with a paragraph for each line."""
    from xml.sax.saxutils import escape

    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in text.split("\n"))
    space = "http://schemas.openxmlformats.org"
    named = {
        "[Content_Types].xml": f'<?xml version="1.0"?><Types xmlns="{space}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": f'<?xml version="1.0"?><Relationships xmlns="{space}/package/2006/relationships"><Relationship Id="r1" Type="{space}/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'<?xml version="1.0"?><w:document xmlns:w="{space}/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, xml in named.items():
            z.writestr(zipfile.ZipInfo(name), xml)
    return out.getvalue()


def _decoded(extension: str, data: bytes) -> tuple[str, str | None, int, int]:
    """Text, error, and for PDF files the number of pages that show images and of all pages."""
    if extension in (".txt", ".md"):
        return data.decode("utf-8", "replace"), None, 0, 0
    if extension == ".docx":
        return docx_text(data), None, 0, 0
    if extension == ".pdf":
        return text_layer(data), None, *image_pages(data)
    return "", f"{extension or 'a file without extension'} needs a converter that is not part of this engine", 0, 0


def decoded(path: str, extension: str, size: int, data: bytes, extensions: list[str]) -> tuple:
    """path, extension, size, text, error, images, pages of one file; whatever is wrong with it is its error."""
    try:
        text, error, images, pages = _decoded(extension, data) if extension in extensions else ("", "Unsupported file type.", 0, 0)
    except Exception as e:  # noqa: BLE001
        text, error, images, pages = "", f"{type(e).__name__}: {e}", 0, 0
    return path, extension, size, text, error, images, pages


READ = "path string, extension string, size bigint, text string, error string, images int, pages int"


def documents(spark: SparkSession, folder: str, extensions: list[str] = SOURCES) -> DataFrame:
    """The files of a folder with text, preview, warnings, status and error. Unsupported files are rows with an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [decoded(*row, extensions) for row in zip(b["path"], b["extension"], b["size"], b["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "extension", "size", "text", "error", "images", "pages"])

    raw = spark.read.format("binaryFile").schema(FILE).load(folder)
    raw = raw.select("path", X.extension(F.col("path")).alias("extension"), F.col("length").alias("size"), "content")
    # a batch holds whole files; Spark bounds its bytes (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB)
    return finished(raw.mapInPandas(run, READ))


def finished(got: DataFrame) -> DataFrame:
    """Rows as they were read, with name, preview, warnings and status."""
    normal = T.normalise_whitespace(F.col("text"))
    thin = F.coalesce(wants_ocr(F.col("text"), F.col("images"), F.col("pages")), F.lit(False))
    noted = F.when(F.col("error").isNull(), import_warnings(normal, F.col("extension"), weak_image=thin)).otherwise(F.array().cast("array<string>"))
    out = got.select("path", X.base_name(F.col("path")).alias("name"), "extension", "size", "text", "error", T.import_preview(F.col("text")).alias("preview"), noted.alias("warnings"))
    return out.withColumn("status", F.when(F.col("error").isNotNull(), "error").when(F.size("warnings") > 0, "warning").otherwise("ready"))


def templates(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder, TEMPLATES)


def word_reports(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``document``, the bytes of a Word file of the text."""

    @F.pandas_udf("binary")
    def made(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(docx_bytes)

    return df.withColumn("document", made(F.col(text)))
