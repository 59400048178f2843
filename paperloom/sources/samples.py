"""Small files of every format that can be written with the standard library, to try the parsers on."""

from __future__ import annotations

import csv
import html
import io
import zipfile
from collections.abc import Callable, Iterator
from email.message import EmailMessage

import pandas as pd
from pyspark.sql import DataFrame

from paperloom.sources import formats


def lines_of(text: str) -> list[str]:
    """Lines with only what XML may hold."""
    return [" ".join("".join(c for c in line if c.isprintable()).split()) for line in text.splitlines()]


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in parts.items():
            z.writestr(name, content)
    return out.getvalue()


def docx(text: str) -> bytes:
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{html.escape(line)}</w:t></w:r></w:p>' for line in lines_of(text))
    return _zip({"word/document.xml": f'<w:document xmlns:w="{formats.W[1:-1]}"><w:body>{body}</w:body></w:document>'})


def xlsx(text: str) -> bytes:
    rows = "".join(f'<row><c r="A{n}" t="inlineStr"><is><t>{html.escape(line)}</t></is></c></row>' for n, line in enumerate(["line", *lines_of(text)], 1))
    sheet = f'<worksheet xmlns="{formats.S[1:-1]}"><sheetData>{rows}</sheetData></worksheet>'
    return _zip({"xl/workbook.xml": f'<workbook xmlns="{formats.S[1:-1]}"><sheets><sheet name="One"/></sheets></workbook>', "xl/worksheets/sheet1.xml": sheet})


def csv_file(text: str) -> bytes:
    out = io.StringIO()
    csv.writer(out).writerows([["line"], *([line] for line in lines_of(text))])
    return out.getvalue().encode()


def page(text: str) -> str:
    return "<html><head><style>p {}</style></head><body>" + "".join(f"<p>{html.escape(line)}</p>" for line in lines_of(text)) + "</body></html>"


def mail(text: str, kind: str = "plain") -> bytes:
    m = EmailMessage()
    m["Subject"], m["From"], m["To"] = "page", "a@b.example", "c@d.example"
    m.set_content("\n".join(lines_of(text)) if kind == "plain" else page(text), subtype=kind)
    return m.as_bytes()


# The first bytes of formats whose text comes from a provider; here it stands behind them.
PNG, PDF = b"\x89PNG\r\n\x1a\n", b"%PDF-1.7\n"
MAKERS: dict[str, Callable[[str], bytes]] = {
    "txt": lambda t: "\n".join(lines_of(t)).encode(),
    "md": lambda t: ("# Page\n\n" + "\n".join(lines_of(t))).encode(),
    "csv": csv_file,
    "html": lambda t: page(t).encode(),
    "xml": lambda t: ("<page>" + "".join(f"<line>{html.escape(line)}</line>" for line in lines_of(t)) + "</page>").encode(),
    "eml": mail,
    "mhtml": lambda t: mail(t, "html"),
    "docx": docx,
    "xlsx": xlsx,
    "pdf": lambda t: PDF + "\n".join(lines_of(t)).encode(),
    "png": lambda t: PNG + "\n".join(lines_of(t)).encode(),
}


def provided(data: bytes, extension: str) -> list[str]:
    """The stand-in for OCR and PDF text: what stands behind the first bytes."""
    return [data[len(PDF if extension == "pdf" else PNG) :].decode(errors="replace")]


def in_order(text: str, found: str) -> bool:
    """Whether the signs of a text come in this order among those found; blanks do not count, as pages may end within a word."""
    rest = iter(found)
    return all(c in rest for c in text if not c.isspace())


def round_trip(pages: DataFrame) -> DataFrame:
    """doc_id, page_number, extension, pages, whole: what each format gives back of each page. A text without words
    has no pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for d, n, t in zip(batch["doc_id"], batch["page_number"], batch["text"]):
                for extension, make in MAKERS.items():
                    try:
                        got = formats.parse(make(t or ""), extension, provided, formats.Limits(0, 0, 0, 0, 0, 0, 0))
                    except ValueError:
                        got = []
                    # lines that come more than three times in a row, and list marks, are not given back
                    clean = formats.markdown_text if extension == "md" else str
                    rows.append((d, n, extension, len(got), in_order(formats.tidy(clean("\n".join(lines_of(t or "")))), " ".join(got))))
            yield pd.DataFrame(rows, columns=["doc_id", "page_number", "extension", "pages", "whole"])

    return pages.select("doc_id", "page_number", "text").mapInPandas(run, "doc_id string, page_number int, extension string, pages int, whole boolean")
