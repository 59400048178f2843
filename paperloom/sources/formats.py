"""Parsers of document formats into pages of text, and the tables that hold them.

Only the standard library is used. Image and PDF text come from a provider that is plugged in.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from email import message_from_bytes, policy
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The formats, their first bytes and the limits.
EXTENSIONS = ("pdf", "docx", "txt", "md", "csv", "eml", "html", "htm", "mhtml", "xml", "xlsx", "png", "jpg", "jpeg", "tif", "tiff")
MAGIC = {"pdf": (b"%PDF",), "png": (b"\x89PNG\r\n\x1a\n",), "jpg": (b"\xff\xd8\xff",), "jpeg": (b"\xff\xd8\xff",), "tif": (b"II*\x00", b"MM\x00*"), "tiff": (b"II*\x00", b"MM\x00*")}
MOST_BYTES, PAGE_BYTES = 40 * 1024 * 1024, 7_000
UNPRINTABLE = re.compile("[\x00-\x09\x0b-\x1f\x7f-\x9f\ue000-\uf8ff\ufff0-\U0010ffff]")
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


@dataclass
class Limits:
    """How much of a file is read; `hit` tells afterwards whether something was left out. 0 means no limit."""

    text: int = 2_000_000
    csv_rows: int = 50_000
    sheet_rows: int = 10_000
    cells: int = 200
    cell: int = 500
    attribute: int = 300
    xml_lines: int = 100_000
    hit: bool = False

    def cut(self, value, name: str):
        """The first part of a text or list, as long as the limit allows."""
        most = getattr(self, name)
        if most and len(value) > most:
            self.hit = True
            return value[:most]
        return value


def tidy(text: str, limits: Limits | None = None) -> str:
    """Plain line ends, printable characters, at most two line ends in a run, no line more than three times in a row."""
    text = (limits or Limits()).cut(text.encode(), "text").decode(errors="ignore").replace("\r", "\n").replace("\t", " ")
    lines = [line.strip() for line in re.sub(r"\n{3,}", "\n\n", UNPRINTABLE.sub("", text)).split("\n")]
    kept = [x for i, x in enumerate(lines) if not x or i < 3 or not x == lines[i - 1] == lines[i - 2] == lines[i - 3]]
    return "\n".join(kept).strip()


def paginate(text: str, most: int = PAGE_BYTES) -> list[str]:
    """Pages of at most `most` bytes, cut at the last line end of the second half where there is one."""
    data, at, out = text.encode(), 0, []
    if len(data) <= most:
        return [text] if text.strip() else []
    while at < len(data):
        end = min(at + most, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        if end < len(data):
            line = data.rfind(b"\n", at, end)
            if line > at + most // 2:
                end = line
        page = data[at:end].decode().strip()
        if page:
            out.append(page)
        at = end
    return out


class _Text(HTMLParser):
    SKIP = {"script", "style", "nav", "footer", "aside"}
    BREAK = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "table", "section", "article", "ul", "ol", "blockquote"}

    def __init__(self) -> None:
        super().__init__()
        self.out: list[str] = []
        self.skipping = 0

    def handle_starttag(self, tag, attrs):
        self.skipping += tag in self.SKIP
        if tag in self.BREAK:
            self.out.append("\n")
        if tag == "li":
            self.out.append("* ")

    def handle_endtag(self, tag):
        if tag in self.SKIP and self.skipping:
            self.skipping -= 1
        if tag in self.BREAK:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skipping:
            self.out.append(re.sub(r"\s+", " ", data))


def html_text(html: str) -> str:
    parser = _Text()
    parser.feed(html)
    return "\n".join(line.strip() for line in "".join(parser.out).split("\n"))


def markdown_text(text: str) -> str:
    return re.sub(r"(?m)^\s{0,3}(?:[#>\-*+]\s+|`{3,}.*$)", "", text)


def csv_lines(text: str, limits: Limits | None = None) -> list[str]:
    limits = limits or Limits()
    rows = list(csv.reader(io.StringIO(text)))
    head = [h.strip() for h in rows[0]] if rows else []
    out = []
    for n, row in enumerate(limits.cut(rows[1:], "csv_rows"), 1):
        cells = [f"{head[k] if k < len(head) else f'col_{k + 1}'}: {limits.cut(v.strip(), 'cell')}" for k, v in enumerate(limits.cut(row, "cells")) if v.strip()]
        if cells:
            out.append(f"Row {n} | " + " | ".join(cells))
    return out


def mail_text(data: bytes, prefer_html: bool = False) -> str:
    mail = message_from_bytes(data, policy=policy.default)
    plain = [p.get_content() for p in mail.walk() if p.get_content_type() == "text/plain"]
    html = [html_text(p.get_content()) for p in mail.walk() if p.get_content_type() == "text/html"]
    body = "\n\n".join((html or plain) if prefer_html else (plain or html))
    if prefer_html:
        return body
    head = [f"{h}: {str(mail[h]).strip()}" for h in ("Subject", "From", "To", "Cc", "Date") if mail[h]]
    return "\n".join(head) + "\n\n" + (f"Email Body:\n{body}" if body else "")


def xml_lines(text: str, limits: Limits | None = None) -> list[str]:
    limits = limits or Limits()
    if re.search(r"(?i)<!(doctype|entity)", text):
        raise ValueError("declarations of types and entities are not allowed")
    out: list[str] = []

    def walk(node, path: str) -> None:
        path = f"{path}/{node.tag.split('}')[-1]}".lstrip("/")
        if (node.text or "").strip():
            out.append(f"{path}: {limits.cut(node.text.strip(), 'cell')}")
        out.extend(f"{path}@{k.split('}')[-1]}: {limits.cut(v.strip(), 'attribute')}" for k, v in node.attrib.items() if v.strip())
        for child in node:
            walk(child, path)

    walk(ElementTree.fromstring(text), "")
    return limits.cut(out, "xml_lines")


def docx_pages(data: bytes) -> list[str]:
    """Paragraphs; headings get # marks, page breaks begin a page."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    pages: list[list[str]] = [[]]
    for p in body.iter(f"{W}p"):
        if any(b.get(f"{W}type") == "page" for b in p.iter(f"{W}br")) or p.find(f".//{W}lastRenderedPageBreak") is not None:
            pages.append([])
        parts = []
        for node in p.iter():
            if node.tag == f"{W}t":
                parts.append(node.text or "")
            elif node.tag == f"{W}tab":
                parts.append("\t")
            elif node.tag == f"{W}br" and node.get(f"{W}type") != "page":
                parts.append("\n")
        style = p.find(f"{W}pPr/{W}pStyle")
        name = style.get(f"{W}val", "") if style is not None else ""
        outline = p.find(f"{W}pPr/{W}outlineLvl")
        heading = re.fullmatch(r"(?i)heading\s?(\d)", name)
        level = 1 if name == "Title" else 2 if name == "Subtitle" else int(heading[1]) if heading else int(outline.get(f"{W}val", "0")) + 1 if outline is not None else 0
        text = "".join(parts).strip()
        if text:
            pages[-1].append("#" * level + " " * bool(level) + text)
    return ["\n".join(p) for p in pages if p]


def xlsx_lines(data: bytes, limits: Limits | None = None) -> list[str]:
    limits = limits or Limits()
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        titles = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{S}sheet")]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))
        for title, sheet in zip(titles, sheets):
            head: list[str] = []
            for n, row in enumerate(limits.cut(list(ElementTree.fromstring(z.read(sheet)).iter(f"{S}row")), "sheet_rows"), 1):
                values: list[str] = []
                for c in row.iter(f"{S}c"):
                    at = 0
                    for ch in re.match(r"[A-Z]*", c.get("r", ""))[0]:
                        at = at * 26 + ord(ch) - 64
                    values += [""] * (at - 1 - len(values))
                    v = c.find(f"{S}v")
                    text = "".join(t.text or "" for t in c.iter(f"{S}t")) if c.get("t") == "inlineStr" else (v.text or "") if v is not None else ""
                    values.append((shared[int(text)] if c.get("t") == "s" and text else text).strip())
                if not any(values):
                    continue
                if not head:
                    head = values
                    continue
                cells = [f"{head[k] if k < len(head) and head[k] else f'col_{k + 1}'}: {limits.cut(v, 'cell')}" for k, v in enumerate(limits.cut(values, "cells")) if v]
                if cells:
                    out.append(f"Sheet {title} | Row {n} | " + " | ".join(cells))
    return out


def parse(data: bytes, extension: str, provider: Callable[[bytes, str], list[str]] | None = None, limits: Limits | None = None) -> list[str]:
    """Pages of a file; raises ValueError where there is no text to be had."""
    limits = limits or Limits()
    text = lambda: data.decode(errors="replace")
    if extension == "docx":
        pages = [tidy(p, limits) for p in docx_pages(data)]
    elif extension in ("pdf", "png", "jpg", "jpeg", "tif", "tiff"):
        if provider is None:
            raise ValueError(f"no provider of text for {extension}")
        pages = [tidy(p, limits) for p in provider(data, extension)]
    else:
        whole = {
            "txt": text, "md": lambda: markdown_text(text()), "csv": lambda: "\n".join(csv_lines(text(), limits)), "html": lambda: html_text(text()), "htm": lambda: html_text(text()),
            "eml": lambda: mail_text(data), "mhtml": lambda: mail_text(data, prefer_html=True), "xml": lambda: "\n".join(xml_lines(text(), limits)), "xlsx": lambda: "\n".join(xlsx_lines(data, limits)),
        }
        pages = paginate(tidy(whole[extension](), limits))
    pages = [p for p in pages if p.strip()]
    if not pages:
        raise ValueError("no text")
    return pages


def extension_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def problem(content: Column, extension: Column, length: Column) -> Column:
    """Why a file is refused; null if it is not."""
    head = F.substring(content, 1, 8)
    bad = F.lit(False)
    for ext, starts in MAGIC.items():
        right = F.lit(False)
        for s in starts:
            right = right | (F.substring(head, 1, len(s)) == F.lit(s))
        bad = bad | ((extension == ext) & ~right)
    return F.when(~extension.isin(*EXTENSIONS), "unsupported type").when(length == 0, "empty").when(length > MOST_BYTES, "too large").when(bad, "content is not of this type")


def load_files(spark: SparkSession, folder: str, provider: Callable[[bytes, str], list[str]] | None = None, limits: Limits | None = None) -> DataFrame:
    """doc_id, file_path, file_name, content_hash, page_number, text, truncated, parse_error of the files in a folder.

    `truncated` tells that the limits left something of the file out.

    A file that can't be read gives one row with its error; others go on (files of no bytes at all are
    passed over by the reader). The id is a hash of path and
    content, so that loading again gives the same ids.
    """
    raw = spark.read.format("binaryFile").load(folder).select("path", "length", "content")
    ext = extension_of(F.col("path"))
    rows = raw.select(
        F.sha2(F.concat(F.encode("path", "UTF-8"), F.col("content")), 256).alias("doc_id"), F.col("path").alias("file_path"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"),
        F.sha2("content", 256).alias("content_hash"), ext.alias("extension"), problem(F.col("content"), ext, F.col("length")).alias("parse_error"), "content",
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                error, pages, own = r.parse_error, [], replace(limits or Limits(), hit=False)
                if error is None:
                    try:
                        pages = parse(r.content, r.extension, provider, own)
                    except Exception as e:  # noqa: BLE001  (a bad file must not stop the others)
                        error = f"{type(e).__name__}: {e}"
                for n, page in enumerate(pages, 1):
                    out.append((r.doc_id, r.file_path, r.file_name, r.content_hash, n, page, own.hit, None))
                if error is not None:
                    out.append((r.doc_id, r.file_path, r.file_name, r.content_hash, None, None, own.hit, error))
            yield pd.DataFrame(out, columns=["doc_id", "file_path", "file_name", "content_hash", "page_number", "text", "truncated", "parse_error"]).astype({"page_number": "Int32"})

    return rows.mapInPandas(run, "doc_id string, file_path string, file_name string, content_hash string, page_number int, text string, truncated boolean, parse_error string")
