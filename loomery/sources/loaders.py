"""Loaders: files, pages and data sets become documents ``id, content, source, file_name, mime_type, ...``."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.errors import MissingDependencyError, UnsupportedFileTypeError
from loomery.operators.splitters import html_to_text

#: Suffixes and their media types.
TEXT_TYPES = {".txt": "text/plain", ".md": "text/markdown", ".markdown": "text/markdown"}
DOCX_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
BINARY_TYPES = {".docx": DOCX_TYPE, ".pdf": "application/pdf"}


def from_text(spark: SparkSession, text: str, id: str | None = None, metadata: dict[str, str] | None = None) -> DataFrame:
    return spark.createDataFrame([(id, text, metadata or {})], "id string, content string, metadata map<string,string>")


def _path(column: str):
    return F.regexp_replace(F.url_decode(F.regexp_replace(F.col(column), r"\+", "%2B")), "^file:/+", "/")


def _suffix(column):
    return F.lower(F.regexp_extract(column, r"(\.[^./]+)$", 1))


def files(spark: SparkSession, path: str, pattern: str = "*", ignore_unsupported: bool = True, metadata: dict[str, str] | None = None, encoding: str = "utf-8") -> DataFrame:
    """All supported files under ``path`` as ``id, content, metadata``, ordered by path. Text files are one document;
    so are docx files; pdf files are one for each page. Metadata: what the caller gives wins over ``source`` and
    ``file_name``, ``directory`` wins over the caller's."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    rows = raw.select(_path("path").alias("source"), "content").withColumn("suffix", _suffix(F.col("source")))
    known = [*TEXT_TYPES, *BINARY_TYPES]
    if not ignore_unsupported:
        bad = rows.where(~F.col("suffix").isin(known)).select("source", "suffix").head()
        if bad is not None:
            raise UnsupportedFileTypeError(f"unsupported file type {bad['suffix']}", path=bad["source"], suffix=bad["suffix"])
    texts = rows.where(F.col("suffix").isin(list(TEXT_TYPES))).select("source", "suffix", F.decode("content", encoding).alias("content"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("int").alias("total_pages"))
    words = rows.where(F.col("suffix") == ".docx").select("source", "suffix", docx_text(F.col("content")).alias("content"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("int").alias("total_pages"))
    out = texts.unionByName(words)
    pdfs = rows.where(F.col("suffix") == ".pdf")
    if _has_pdf():
        out = out.unionByName(pdf_pages(pdfs))
    elif (one := pdfs.select("source").head()) is not None:
        raise MissingDependencyError("reading pdf needs pypdf", path=one["source"])
    mime = F.create_map(*[F.lit(x) for pair in (TEXT_TYPES | BINARY_TYPES).items() for x in pair])
    base = F.create_map(F.lit("source"), F.col("source"), F.lit("file_name"), F.element_at(F.split("source", "/"), -1), F.lit("mime_type"), F.try_element_at(mime, F.col("suffix")))
    given = F.create_map(*[F.lit(x) for pair in (metadata or {}).items() for x in pair]).cast("map<string,string>")
    pages = F.when(F.col("page").isNotNull(), F.create_map(F.lit("page"), F.col("page").cast("string"), F.lit("total_pages"), F.col("total_pages").cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    merged = _merged(base, pages, given, F.create_map(F.lit("directory"), F.lit(path)))
    id_ = F.when(F.col("page").isNotNull(), F.concat("source", F.lit("#page_"), F.col("page").cast("string"))).otherwise(F.col("source"))
    return out.select(id_.alias("id"), "content", merged.alias("metadata")).orderBy("id")


def _merged(*maps):
    """Later maps win, whatever the session's policy for repeated keys."""

    def both(out, later):
        return F.map_concat(F.map_filter(out, lambda k, _: ~F.map_contains_key(later, k)), later)

    return reduce(both, maps)


def docx_text(content):
    """The paragraphs of a docx file, stripped, empty ones left out, a line each; null when it can't be read."""

    @F.pandas_udf("string")
    def run(files: pd.Series) -> pd.Series:
        import zipfile
        from xml.etree import ElementTree

        w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

        def one(data: bytes | None) -> str | None:
            try:
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    root = ElementTree.fromstring(z.read("word/document.xml"))
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, TypeError):
                return None
            lines = ("".join(t.text or "" for t in p.iter(f"{w}t")).strip() for p in root.iter(f"{w}p"))
            return "\n".join(line for line in lines if line)

        return files.map(one)

    return run(content)


def _has_pdf() -> bool:
    try:
        import pypdf  # noqa: F401
    except ImportError:
        return False
    return True


def pdf_pages(rows: DataFrame) -> DataFrame:
    """A row for each page of pdf files (``source, suffix, content BINARY``); needs pypdf."""
    if not _has_pdf():
        raise MissingDependencyError("reading pdf files needs pypdf", package="pypdf")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pypdf import PdfReader

        for pdf in batches:
            out = []
            for source, suffix, data in zip(pdf["source"], pdf["suffix"], pdf["content"]):
                pages = PdfReader(io.BytesIO(data)).pages
                out += [(source, suffix, p.extract_text() or "", i + 1, len(pages)) for i, p in enumerate(pages)]
            yield pd.DataFrame(out, columns=["source", "suffix", "content", "page", "total_pages"])

    return rows.select("source", "suffix", "content").mapInPandas(run, "source string, suffix string, content string, page int, total_pages int")


def pages(urls: DataFrame, fetch: Callable[[str], tuple[bytes, str]]) -> DataFrame:
    """``url`` rows as documents of visible text. ``fetch`` gives the body and the content type of an address; bytes that
    are not in the named character set are replaced."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        for pdf in batches:
            out = []
            for url in pdf["url"]:
                body, kind = fetch(url)
                named = re.search(r"charset=[\"']?([\w-]+)", kind or "", re.I)
                out.append((url, body.decode(named[1] if named else "utf-8", errors="replace"), (kind or "").split(";")[0].strip()))
            yield pd.DataFrame(out, columns=["url", "html", "mime_type"])

    got = urls.select("url").mapInPandas(run, "url string, html string, mime_type string")
    return got.select(F.col("url").alias("id"), html_to_text(F.col("html")).alias("content"), "url", "mime_type")


def eval_dataset(spark: SparkSession, path: str) -> DataFrame:
    """The cases of JSON data sets: ``dataset_name, dataset_version, id, question, reference, context, expected_tools,
    expected_tool_calls, metadata``."""
    call = "struct<name:string,args:map<string,string>>"
    case = f"struct<id:string,question:string,reference:string,context:string,expected_tools:array<string>,expected_tool_calls:array<{call}>,metadata:map<string,string>>"
    rows = spark.read.schema(f"name string, version string, cases array<{case}>").json(path, multiLine=True)
    return rows.select(F.col("name").alias("dataset_name"), F.coalesce("version", F.lit("v0")).alias("dataset_version"), F.inline("cases"))
