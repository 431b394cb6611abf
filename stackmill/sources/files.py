"""Files of a corpus as DataFrames: walks, texts, code, HTML, e-books and converted PDFs; failures are rows, not errors."""

from __future__ import annotations

import io
import re
import shlex
import subprocess
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackmill.functions import identity as ids
from stackmill.functions import text as t
from stackmill.functions.cleaning import clean_markdown

SPAN = "source_id string, span_index bigint, kind string, text string, error string"


def corpus_files(spark: SparkSession, folder: str, root: str, mode: str = "text") -> DataFrame:
    """source_id, source_hash, path, content and error of the files below `folder`.

    mode 'code' takes code paths only, 'html' and 'ebook' their extensions, 'text' and 'pdf' every file. A file outside
    of the corpus root is a row with an error.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    path = F.regexp_replace("path", "^file:/*", "/")
    rows = rows.select(path.alias("path"), "content")
    if mode == "code":
        rows = rows.where(t.is_code_path(F.col("path")))
    elif mode in ("html", "ebook"):
        rows = rows.where(t.kind_of(F.col("path")) == mode)
    source = ids.canonical_source_id(F.col("path"), root)
    return rows.select(source.alias("source_id"), ids.source_hash(F.col("content")).alias("source_hash"), "path", "content", F.when(source.isNull(), "not below the corpus root").alias("error"))


def text_spans(files: DataFrame, kind: str = "Paragraph") -> DataFrame:
    """One span for each file, its bytes read as UTF-8; other bytes give an error and no text."""
    good = F.is_valid_utf8("content")
    return files.select("source_id", F.lit(0).cast("bigint").alias("span_index"), F.lit(kind).alias("kind"), F.when(good, F.decode("content", "UTF-8")).alias("text"), F.coalesce("error", F.when(~good, "not UTF-8")).alias("error"))


class _Markdown(HTMLParser):
    """A small HTML reader: headings, paragraphs, lists, code and tables; scripts, styles and navigation are dropped."""

    DROPPED, BLOCKS = {"script", "style", "nav", "head", "template"}, {"p", "div", "section", "ul", "ol", "table", "blockquote", "article", "main", "header", "footer"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip, self.pre = 0, False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.DROPPED:
            self.skip += 1
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag == "pre":
            self.pre = True
            self.out.append("\n\n```\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "br":
            self.out.append("\n")
        elif tag == "tr":
            self.out.append("\n|")
        elif tag in self.BLOCKS:
            self.out.append("\n\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.DROPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == "pre":
            self.pre = False
            self.out.append("\n```\n\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag in ("td", "th"):
            self.out.append("|")
        elif tag in self.BLOCKS or re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n")

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def html_to_markdown(page: str) -> str:
    reader = _Markdown()
    reader.feed(page)
    reader.close()
    lines = [s.rstrip() for s in "".join(reader.out).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def epub_to_markdown(content: bytes) -> str:
    """The chapters of an EPUB in the order of its spine."""
    book = zipfile.ZipFile(io.BytesIO(content))
    root = ElementTree.fromstring(book.read("META-INF/container.xml"))
    opf = next(e.get("full-path") for e in root.iter() if e.tag.endswith("rootfile"))
    package = ElementTree.fromstring(book.read(opf))
    folder = opf.rsplit("/", 1)[0] + "/" if "/" in opf else ""
    items = {e.get("id"): e.get("href") for e in package.iter() if e.tag.endswith("}item")}
    chapters = [items[e.get("idref")] for e in package.iter() if e.tag.endswith("}itemref") and e.get("idref") in items]
    return "\n\n".join(html_to_markdown(book.read(folder + c).decode("utf-8", "replace")) for c in chapters)


def _converted(files: DataFrame, convert) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = []
            for source, path, content, error in zip(pdf["source_id"], pdf["path"], pdf["content"], pdf["error"]):
                text = None
                if error is None:
                    try:
                        text = convert(path, bytes(content))
                        error = None if text.strip() else "empty"
                    except Exception as e:  # noqa: BLE001  one bad file is one failed row
                        error = f"{type(e).__name__}: {e}"[:500]
                got.append((source, 0, "Paragraph", text if error is None else None, error))
            yield pd.DataFrame(got, columns=["source_id", "span_index", "kind", "text", "error"])

    out = files.select("source_id", "path", "content", "error").mapInPandas(work, SPAN)
    return out.withColumn("text", clean_markdown(F.col("text")))


def html_spans(files: DataFrame) -> DataFrame:
    """One Markdown span for each HTML file, cleaned; an empty page is an error."""
    return _converted(files, lambda path, content: html_to_markdown(content.decode("utf-8", "replace")))


def ebook_spans(files: DataFrame, to_epub: str | None = None) -> DataFrame:
    """One Markdown span for each e-book. Other formats than EPUB need `to_epub`, a command that reads such a file on
    its standard input and writes an EPUB to its standard output; without one they are errors."""
    def convert(path: str, content: bytes) -> str:
        if not path.lower().endswith(".epub"):
            if to_epub is None:
                raise ValueError("no converter for this format")
            content = subprocess.run(shlex.split(to_epub), input=content, capture_output=True, check=True).stdout
        return epub_to_markdown(content)

    return _converted(files, convert)


def pdf_spans(files: DataFrame, to_markdown: str, made: DataFrame | None = None) -> DataFrame:
    """One span for each PDF, by a command that reads it on standard input and writes Markdown; the last lines of its
    messages are the error of a failure. Sources in `made` (earlier output) are taken from there and not converted again."""
    def convert(path: str, content: bytes) -> str:
        run = subprocess.run(shlex.split(to_markdown), input=content, capture_output=True)
        if run.returncode:
            raise RuntimeError("\n".join(run.stderr.decode("utf-8", "replace").splitlines()[-8:]))
        return run.stdout.decode("utf-8")

    if made is None:
        return _converted(files, convert)
    return _converted(files.join(made.select("source_id"), "source_id", "left_anti"), convert).unionByName(made.select("source_id", "span_index", "kind", "text", F.lit(None).cast("string").alias("error")))


def json_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON under a schema; blank and broken lines are left out, unknown fields are ignored, absent ones are null."""
    rows = spark.read.schema(f"{schema}, _bad string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
    return rows.where(F.col("_bad").isNull()).drop("_bad")


