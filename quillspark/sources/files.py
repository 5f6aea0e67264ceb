"""Files as tables: Markdown, plain text, Word and PDF by their extension, read in parallel from any folder Spark can list."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T

WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
BAD_SHARE = 0.05


def docx_text(content: bytes) -> str:
    """The paragraphs of a Word file, a blank line between them."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    marks = {WORD + "tab": "\t", WORD + "br": "\n"}
    return "\n\n".join("".join((n.text or "") if n.tag == WORD + "t" else marks.get(n.tag, "") for n in p.iter()) for p in root.iter(WORD + "p"))


class Pdf:
    """The objects of a PDF file: plain ones and those packed in object streams."""

    def __init__(self, content: bytes):
        self.objects = {int(m[1]): m[2] for m in re.finditer(rb"(?:^|\s)(\d+) \d+ obj\b(.*?)endobj", content, re.S)}
        for body in list(self.objects.values()):
            if b"/ObjStm" in body:
                data, first = self.stream(body) or b"", re.search(rb"/First\s+(\d+)", body)
                at = int(first[1]) if first else 0
                numbers = [int(x) for x in data[:at].split()]
                places = [*numbers[1::2], len(data) - at]
                for number, low, high in zip(numbers[::2], places, places[1:]):
                    self.objects.setdefault(number, data[at + low : at + high])
        loose = [] if self.objects else [m[0] for m in re.finditer(rb"stream\r?\n.*?endstream", content, re.S)]
        self.streams = [d for d in map(self.stream, [*self.objects.values(), *loose]) if d]
        self.fonts = {name: self.letters(ref) for body in [*self.objects.values()] for name, ref in re.findall(rb"/([A-Za-z0-9+._-]+)\s+(\d+)\s+\d+\s+R", body) if b"/ToUnicode" in self.objects.get(int(ref), b"")}

    @staticmethod
    def stream(body: bytes) -> bytes | None:
        m = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.S)
        if not m:
            return None
        try:
            return zlib.decompressobj().decompress(m[1])
        except zlib.error:
            return m[1]

    def letters(self, font: bytes) -> tuple[int, dict[int, str]]:
        """(bytes of a code, letters of each code) by a font's table."""
        ref = re.search(rb"/ToUnicode\s+(\d+)", self.objects[int(font)])
        table = self.stream(self.objects.get(int(ref[1]), b"")) if ref else None
        out, size = {}, 1
        text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
        for block in re.findall(rb"beginbfchar(.*?)endbfchar", table or b"", re.S):
            for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                out[int(a, 16)], size = text(b), max(size, len(a) // 2)
        for block in re.findall(rb"beginbfrange(.*?)endbfrange", table or b"", re.S):
            for a, b, c, d in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[(.*?)\])", block, re.S):
                size = max(size, len(a) // 2)
                many = [text(x) for x in re.findall(rb"<([0-9A-Fa-f]+)>", d)] if d else None
                for i, code in enumerate(range(int(a, 16), int(b, 16) + 1)):
                    start = text(c) if c else ""
                    out[code] = many[i] if many and i < len(many) else start[:-1] + chr(ord(start[-1]) + i) if start else ""
        return size, out


#: Escapes within a string of a PDF.
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: Names of fonts, strings, spaces between parts of a line, and moves to another line.
SHOWN = re.compile(rb"/([A-Za-z0-9+._-]+)\s+[\d.]+\s+Tf|\(((?:\\.|[^()\\]|\((?:\\.|[^()\\])*\))*)\)|<([0-9A-Fa-f\s]*)>|\](?=\s*TJ)|(-\d{3,}(?:\.\d+)?)(?=\s*[(<\]])|(-?[\d.]+\s+-?[\d.]*[1-9][\d.]*\s+T[dD]\b|T\*|'(?=\s))", re.S)


def pdf_text(content: bytes) -> str:
    """The text shown by a PDF's (deflated or plain) content streams, by the fonts' tables of letters where they have one, else as Latin-1 or UTF-16."""
    pdf, out = Pdf(content), []

    def letters(raw: bytes, font: bytes) -> str:
        size, table = pdf.fonts.get(font, (1, {}))
        if table:
            return "".join(table.get(int.from_bytes(raw[i : i + size], "big"), "") for i in range(0, len(raw), size))
        return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")

    for data in pdf.streams:
        for block in re.findall(rb"\bBT\b(.*?)\bET\b", data, re.S):
            font, line = b"", []
            for m in SHOWN.finditer(block):
                if m[1]:
                    font = m[1]
                elif m[2] is not None:
                    raw = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda e: bytes([int(e[1], 8) & 255]) if e[1][:1].isdigit() else b"" if e[1].strip() == b"" else ESCAPES.get(e[1], e[1]), m[2], flags=re.S)
                    line.append(letters(raw, font))
                elif m[3] is not None:
                    digits = b"".join(m[3].split())
                    line.append(letters(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), font))
                elif m[4]:
                    line.append(" ")
                elif m[5] and line:
                    line.append("\n")
            out.append("".join(line))
    return "\n".join(out)


READERS = {"md": lambda b: b.decode("utf-8", "replace"), "txt": lambda b: b.decode("utf-8", "replace"), "docx": docx_text, "pdf": pdf_text}


def read_folder(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(path, name, text) of the readable files, normalised by kind, and (path, error) of the rest; one bad file never fails the others."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, content in zip(batch["path"], batch["content"]):
                kind = p.lower().rsplit(".", 1)[-1]
                try:
                    rows.append((p, kind, READERS[kind](bytes(content)), None))
                except KeyError:
                    rows.append((p, kind, None, f"unsupported format: {kind}"))
                except Exception as e:
                    rows.append((p, kind, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "kind", "raw", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    read = files.mapInPandas(run, "path string, kind string, raw string, error string")
    bad = F.coalesce(T.bad_character_share(F.col("raw")) > BAD_SHARE, F.lit(False))
    error = F.coalesce("error", F.when(bad, "encoding"))
    read = read.withColumn("error", error)
    text = F.when(F.col("kind") == "md", T.strip_markdown(F.col("raw"))).otherwise(T.normalize_text(F.col("raw")))
    good = read.where("error is null").select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "raw", text.alias("text"))
    return good, read.where("error is not null").select("path", "error")
