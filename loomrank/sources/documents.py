"""Texts of uploaded documents: Markdown, DOCX by the standard library, PDF where a reader is installed."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Namespaces of the format, bounds of a document, the length under which a text is suspicious.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
CHOICE = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
MAX_PARTS, MAX_BYTES, MAX_DEPTH, MAX_PAGES, LITTLE = 2000, 64 << 20, 100, 20, 150


class BadDocument(ValueError):
    """The file can't or mustn't be read."""


def part(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    raw = archive.read(name)
    if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw:
        raise BadDocument("declarations are refused")
    return ElementTree.fromstring(raw)


def text_of(node: ElementTree.Element, out: list[str], depth: int = 0) -> None:
    """Shown text below a node: deleted and hidden runs and field codes are not, of alternatives the first is."""
    if depth > MAX_DEPTH:
        raise BadDocument("nested too deep")
    if node.tag in (WORD + "del", WORD + "moveFrom", WORD + "instrText"):
        return
    if node.tag == WORD + "r" and node.find(f"{WORD}rPr/{WORD}vanish") is not None:
        return
    if node.tag == WORD + "t":
        out.append(node.text or "")
    elif node.tag in (WORD + "tab", WORD + "br", WORD + "cr"):
        out.append("\t" if node.tag == WORD + "tab" else "\n")
    children = list(node)
    if node.tag == CHOICE + "AlternateContent":
        children = children[:1]
    for child in children:
        text_of(child, out, depth + 1)
    if node.tag == WORD + "p":
        out.append("\n")
    elif node.tag == WORD + "tc":
        out.append("\t")


def docx_text(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        entries = archive.infolist()
        if len(entries) > MAX_PARTS or sum(e.file_size for e in entries) > MAX_BYTES:
            raise BadDocument("too large when unpacked")
        names = {e.filename for e in entries}
        if any(n.endswith("vbaProject.bin") for n in names):
            raise BadDocument("macros are refused")
        if "word/document.xml" not in names:
            raise BadDocument("no document inside")
        body = part(archive, "word/document.xml")
        linked = {}
        if "word/_rels/document.xml.rels" in names:
            linked = {r.get("Id"): "word/" + (r.get("Target") or "") for r in part(archive, "word/_rels/document.xml.rels")}
        out: list[str] = []
        for kind in ("headerReference", "footerReference"):
            used = {linked.get(r.get(RELATION + "id")) for r in body.iter(WORD + kind)}
            pieces: list[str] = []
            for name in sorted(n for n in used if n in names):
                text_of(part(archive, name), pieces)
            if kind == "headerReference":
                out += pieces
                text_of(body, out)
            else:
                out += pieces
    return re.sub(r"\n{3,}", "\n\n", "".join(out)).strip()


def pdf_text(data: bytes) -> str:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise BadDocument("no PDF reader is installed") from e
    reader = PdfReader(io.BytesIO(data))
    if reader.is_encrypted or not 1 <= len(reader.pages) <= MAX_PAGES:
        raise BadDocument("encrypted, or of too many pages")
    pages = []
    for page in reader.pages:
        try:
            text = page.extract_text(extraction_mode="layout")
        except Exception:  # noqa: BLE001  a page that has no layout is read plainly
            text = page.extract_text()
        pages.append(re.sub(r"[ \t]{2,}", " ", text or ""))
    return "\n".join(pages).strip()


def document_text(name: str, data: bytes) -> tuple[str, list[str]]:
    """Text and warnings of a file: its name tells Markdown, its first bytes the others."""
    if name.lower().endswith((".md", ".markdown")):
        text = data.decode("utf-8", "replace")
    elif data[:2] == b"PK":
        text = docx_text(data)
    elif data[:5] == b"%PDF-":
        text = pdf_text(data)
    else:
        raise BadDocument("neither Markdown nor DOCX nor PDF")
    return text, ["very little text"] * (len(text.strip()) < LITTLE) + ["characters that can't be read"] * ("�" in text)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``path, text, warnings, error`` of each file below the path; a file that can't be read has an error and no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    text, warnings = document_text(name, data)
                    rows.append((name, text, warnings, ""))
                except (BadDocument, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows.append((name, None, [], str(e) or "broken"))
            kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["path", "text", "warnings", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, text string, warnings array<string>, error string")
