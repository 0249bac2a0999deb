"""Text from pages and attachments: formats by their first bytes, HTML, XML, ZIP-based office files, plain text."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of an extracted text, and members and bytes of an archive, that are read at most: a limit of the feature, for hostile files.
MOST_CHARS, MOST_FILES, MOST_BYTES = 2_000_000, 32, 25 << 20
SILENT = {"script", "style", "noscript", "template"}
BREAKS = {"p", "br", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "footer", "nav", "ul", "table"}


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.title, self.silent, self.in_title = [], [], 0, False

    def handle_starttag(self, tag, attrs):
        self.silent += tag in SILENT
        self.in_title |= tag == "title"
        if tag in BREAKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.silent = max(0, self.silent - (tag in SILENT))
        if tag == "title":
            self.in_title = False
        if tag in BREAKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.silent:
            (self.title if self.in_title else self.out).append(data)


def tidy(text: str) -> str:
    text = re.sub(r"[^\S\n]+", " ", text.replace("\xa0", " ").replace("\r", "\n"))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", text)).strip()


def from_html(html: str) -> tuple[str, str]:
    p = _Text()
    p.feed(html or "")
    p.close()
    return tidy("".join(p.title)), tidy("".join(p.out))


def decoded(raw: bytes) -> str:
    """UTF-8, or GB18030 if that leaves many characters unread."""
    text = raw.decode("utf-8", "replace")
    if text.count("�") > max(3, len(text) // 200):
        return raw.decode("gb18030", "replace")
    return text


def sniff(raw: bytes, name: str = "", mime: str = "") -> str:
    """A file's format by its first bytes, else its media type, else its name."""
    head = raw[:512]
    if head[:5] == b"%PDF-":
        return "pdf"
    if head[:4] == b"PK\x03\x04":
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            names = set(z.namelist())
        for kind, mark in (("docx", "word/document.xml"), ("xlsx", "xl/workbook.xml"), ("pptx", "ppt/presentation.xml"), ("ofd", "OFD.xml")):
            if mark in names:
                return kind
        return "zip"
    if re.match(rb"\s*(<!doctype html|<html)", head, re.I):
        return "html"
    if re.match(rb"\s*<\?xml", head):
        return "xml"
    for kind in ("html", "json", "csv", "xml", "pdf"):
        if kind in mime:
            return kind
    end = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    return end if end in {"txt", "csv", "json", "html", "xml"} else "txt" if mime.startswith("text/") else "unknown"


def from_bytes(raw: bytes, name: str = "", mime: str = "") -> tuple[str, str, str]:
    """Format, status and text. PDF needs a library that isn't here, so it is kept for manual review, as are unknown formats."""
    try:
        kind = sniff(raw, name, mime)
        if kind == "html":
            return kind, "extracted", from_html(decoded(raw))[1][:MOST_CHARS]
        if kind == "xml":
            return kind, "extracted", tidy(re.sub(r"<[^>]+>", " ", decoded(raw)))[:MOST_CHARS]
        if kind in {"txt", "csv", "json"}:
            return kind, "extracted", tidy(decoded(raw))[:MOST_CHARS]
        if kind in {"docx", "xlsx", "pptx", "ofd", "zip"}:
            out = []
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                files = [i for i in z.infolist() if not i.is_dir() and i.file_size <= MOST_BYTES][: MOST_FILES * 8]
                wanted = {"docx": r"word/document\.xml", "xlsx": r"xl/(sharedStrings|worksheets/.*)\.xml", "pptx": r"ppt/slides/slide\d+\.xml", "ofd": r".*Content.*\.xml"}.get(kind)
                for i in sorted(files, key=lambda i: i.filename):
                    if wanted and re.fullmatch(wanted, i.filename):
                        out.append(tidy(re.sub(r"<[^>]+>", "", re.sub(r"</(w:p|a:p|row|si)>", "\n", decoded(z.read(i))))))
                    elif not wanted and len(out) < MOST_FILES and not i.filename.lower().endswith(".zip"):
                        out.append(from_bytes(z.read(i), i.filename)[2])
            text = "\n".join(x for x in out if x)[:MOST_CHARS]
            return kind, "extracted" if text else "empty", text
        return kind, "manual_review", ""
    except Exception as e:  # a damaged file is a row with a status, not a failed job
        return "damaged", f"failed: {type(e).__name__}", ""


def html_text(pages: DataFrame) -> DataFrame:
    """page_id, title, text of each page's html, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [from_html(h) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "title": [f[0] for f in found], "text": [f[1] for f in found]})

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, title string, text string")


def attachments(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, format, status, sha256 and text of all files of a folder, by Spark's binary reader."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [from_bytes(bytes(c), p) for p, c in zip(b["path"], b["content"], strict=True)]
            yield pd.DataFrame({"path": b["path"], "sha256": b["sha256"], "format": [f[0] for f in found], "status": [f[1] for f in found], "text": [f[2] for f in found]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select("path", "content", F.sha2("content", 256).alias("sha256")).mapInPandas(run, "path string, sha256 string, format string, status string, text string")
