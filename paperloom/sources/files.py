"""Readers of documents from files: one row per page, with the loader type and what went wrong.

Files are scanned with `binaryFile`; office formats are zip archives of XML and are opened with the standard library.
PDF and images need libraries and models that are optional: without them a row says so in `error` instead of inventing
a text.
"""

from __future__ import annotations

import csv
import html
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.constants import FILE_TYPES
from paperloom.operators.text import assemble, file_type
from paperloom.session import map_batches

PAGES = "path string, file_type string, page_no int, text string, error string"
_hidden = re.compile(r"(?is)<(script|style|head|noscript)\b.*?</\1\s*>|<!--.*?-->")
_block = re.compile(r"(?i)</?(?:p|div|br|li|tr|h[1-6]|table|ul|ol|section|article|header|footer|blockquote|pre)\b[^>]*>")
_any_tag = re.compile(r"<[^>]+>")


def decode(content: bytes) -> str:
    """UTF-8, else Latin-1."""
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def html_text(source: str) -> str:
    """The visible text of a page, a line for each block."""
    text = _any_tag.sub("", _block.sub("\n", _hidden.sub(" ", source)))
    lines = (" ".join(x.split()) for x in html.unescape(text).split("\n"))
    return "\n".join(x for x in lines if x)


def csv_pages(content: bytes) -> list[str]:
    """A page for each row: "column: value" lines."""
    return ["\n".join(f"{k}: {v}" for k, v in row.items() if k is not None) for row in csv.DictReader(io.StringIO(decode(content), newline=""))]


def _xml_text(data: bytes, paragraph: str, run: str) -> str:
    root = ElementTree.fromstring(data)
    lines = ["".join(t.text or "" for t in p.iter() if t.tag.endswith(f"}}{run}")) for p in root.iter() if p.tag.endswith(f"}}{paragraph}")]
    return "\n".join(x for x in lines if x)


def _numbered(names: list[str], pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in names if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def docx_pages(content: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return [_xml_text(z.read("word/document.xml"), "p", "t")]


def pptx_pages(content: bytes) -> list[str]:
    """A page for each slide."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return [_xml_text(z.read(n), "p", "t") for n in _numbered(z.namelist(), r"ppt/slides/slide(\d+)\.xml")]


def xlsx_pages(content: bytes) -> list[str]:
    """A page for each sheet, cells divided by tabs."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter() if t.tag.endswith("}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        pages = []
        for name in _numbered(z.namelist(), r"xl/worksheets/sheet(\d+)\.xml"):
            rows = []
            for row in (r for r in ElementTree.fromstring(z.read(name)).iter() if r.tag.endswith("}row")):
                cells = []
                for cell in (c for c in row if c.tag.endswith("}c")):
                    value = next((v.text or "" for v in cell.iter() if v.tag.endswith("}v") or v.tag.endswith("}t")), "")
                    cells.append(shared[int(value)] if cell.get("t") == "s" and value else value)
                rows.append("\t".join(cells))
            pages.append("\n".join(rows))
        return pages


READERS = {
    "text": lambda b: [decode(b)], "markdown": lambda b: [decode(b)], "html": lambda b: [html_text(decode(b))], "unknown": lambda b: [html_text(decode(b))],
    "csv": csv_pages, "docx": docx_pages, "pptx": pptx_pages, "xlsx": xlsx_pages,
}


def read_pages(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = True) -> DataFrame:
    """PAGES of all files below a path (any Hadoop file system), a row with `error` for a file that can't be read.

    page_no counts from 0; files without a known extension are read as HTML or text. Nothing is sorted or collected.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for where, kind, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
                read = READERS.get(kind)
                try:
                    if read is None:
                        raise ValueError(f"no reader for {kind} is installed")
                    rows += [(where, kind, i, text, None) for i, text in enumerate(read(content))]
                except Exception as e:  # a broken file is a row, not a failed job
                    rows.append((where, kind, None, None, f"{type(e).__name__}: {e}"))
            columns = list(zip(*rows)) if rows else [[]] * 5
            types = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["path", "file_type", "page_no", "text", "error"])

    files = reader.load(path).select("path", file_type(F.col("path")).alias("file_type"), "content")
    return map_batches(files, run, PAGES)


def documents(pages: DataFrame) -> DataFrame:
    """path, file_type, text, error: the pages of each file joined (a file's pages fit one row, as its content did)."""
    ordered = F.transform(F.array_sort(F.collect_list(F.when(F.col("error").isNull(), F.struct("page_no", "text")))), lambda p: F.coalesce(p["text"], F.lit("")))
    return pages.groupBy("path", "file_type").agg(F.first("error", ignorenulls=True).alias("error"), ordered.alias("_pages")).select("path", "file_type", assemble(F.col("_pages")).alias("text"), "error")


def evaluation_csv(spark: SparkSession, path: str) -> DataFrame:
    """The evaluation set: quoted texts over several lines, JSON in two columns."""
    columns = "document_id string, document_text string, ground_truth_class string, ground_truth_fields string, ground_truth_pii string, notes string"
    return spark.read.csv(path, schema=columns, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")


def schema_entries(spark: SparkSession, path: str) -> DataFrame:
    """doc_type, required_fields, json_schema (text), notes of a JSON list of profiles; nothing for other JSON."""
    item = "array<struct<doc_type:string,required_fields:array<string>,json_schema:variant,notes:string>>"
    whole = spark.read.text(path, wholetext=True).where(F.col("value").rlike(r"^\s*\["))
    return whole.select(F.inline(F.from_json("value", item))).withColumn("json_schema", F.to_json("json_schema"))


def recent_reports(spark: SparkSession, path: str, n: int = 10) -> DataFrame:
    """path, modified, report (text) of the newest JSON files; the limit is the feature."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").load(path)
    newest = files.orderBy(F.desc("modificationTime"), F.desc("path")).limit(n)
    return newest.select("path", F.col("modificationTime").alias("modified"), F.col("content").cast("string").alias("report"))


def known_extension(path: Column) -> Column:
    return F.lower(path).rlike("(" + "|".join(re.escape(e) for e in FILE_TYPES) + ")$")
