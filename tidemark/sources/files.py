"""Delimited, JSON and workbook files as DataFrames, for whole folders at once."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from itertools import islice
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import stage

SEPARATORS = [",", ";", "\t", "|"]


def file_formats(spark: SparkSession, path: str) -> DataFrame:
    """Rows (file, sep, encoding): the candidate that splits all lines of a file most evenly into the most fields."""
    # quoted text may contain any of the candidates
    bare = F.regexp_replace("value", '"[^"]*"', "")
    counts = [F.size(F.split(bare, re.escape(s), -1)).alias(f"c{i}") for i, s in enumerate(SEPARATORS)]
    # the file's name comes as a URI, in which a plus sign is itself
    file = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    lines = spark.read.text(path).filter(F.trim("value") != "").select(file.alias("file"), "value", *counts)
    ranked = [
        F.struct(F.min(f"c{i}").alias("low"), F.avg(f"c{i}").alias("mean"), F.lit(-i).alias("order"), F.lit(s).alias("sep"))
        for i, s in enumerate(SEPARATORS)
    ]
    found = lines.groupBy("file").agg(F.greatest(*ranked)["sep"].alias("sep"), F.bool_and(F.is_valid_utf8("value")).alias("utf8"))
    tabs = F.lower("file").endswith(".tsv")
    encoding = F.when(F.col("utf8"), "UTF-8").otherwise("ISO-8859-1")
    return found.select("file", F.when(tabs, "\t").otherwise(F.col("sep")).alias("sep"), encoding.alias("encoding"))


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, multi_line: bool = False) -> DataFrame:
    """All columns as text, files of any separator and encoding together, by column name.

    Each file has its own separator, unless ``sep`` is given, and is Latin-1 where its bytes are not
    UTF-8. Files of one kind are read together and share their header. With ``multi_line``, quoted
    text may hold line breaks; a file is then one task's work.
    """
    kinds = {}
    for file, own, encoding in sorted(file_formats(spark, path).collect()):
        kinds.setdefault((sep or own, encoding), []).append(file)
    out = None
    for (mark, encoding), files in (kinds or {(sep or ",", "UTF-8"): [path]}).items():
        one = spark.read.csv(files, sep=mark, header=True, encoding=encoding, quote='"', escape='"', multiLine=multi_line)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array per file, or one record per line, by suffix."""
    return spark.read.json(path, multiLine=not path.lower().endswith((".jsonl", ".ndjson")))


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
CELLS = "path string, sheet string, sheet_no int, row int, col int, value string"


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(ch) - 64
    return n - 1


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Indices of cell styles that show a serial number as a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    custom = {
        int(f.get("numFmtId")) for f in root.iter(f"{_NS}numFmt")
        if re.search(r"[ymd]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "").lower()))
    }
    dates = custom | {14, 15, 16, 17, 22}
    xfs = root.find(f"{_NS}cellXfs")
    return {i for i, xf in enumerate(xfs if xfs is not None else []) if int(xf.get("numFmtId", 0)) in dates}


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_NS}t"))


PARTS = "path string, kind string, sheet string, sheet_no int, dates array<int>, packed boolean, content binary"


def _parts(path: str, payload: bytes) -> Iterator[tuple]:
    """The sheets and the shared strings of a workbook as they lie in the archive, still packed."""
    with zipfile.ZipFile(io.BytesIO(payload)) as book:
        names = set(book.namelist())

        def taken(part: str) -> tuple[bool, bytes]:
            entry = book.getinfo(part)
            # the local header has a name and further fields of its own lengths before the data
            name, extra = struct.unpack_from("<HH", payload, entry.header_offset + 26)
            begin = entry.header_offset + 30 + name + extra
            return entry.compress_type != zipfile.ZIP_STORED, payload[begin : begin + entry.compress_size]

        dates = sorted(_date_styles(book))
        if "xl/sharedStrings.xml" in names:
            yield path, "strings", None, -1, [], *taken("xl/sharedStrings.xml")
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for number, sheet in enumerate(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_NS}sheet")):
            target = rels[sheet.get(_REL)].lstrip("/")
            part = target if target.startswith("xl/") else f"xl/{target}"
            yield path, "sheet", sheet.get("name"), number, dates, *taken(part)


class _Unpacked(io.RawIOBase):
    """A packed part, unpacked as far as it is read."""

    def __init__(self, packed: bool, content: bytes):
        self.source, self.stream = io.BytesIO(content), zlib.decompressobj(-15) if packed else None

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        out = b""
        while not out:
            if self.stream is None:
                out = self.source.read(len(into))
                break
            raw = self.stream.unconsumed_tail or self.source.read(1 << 16)
            if not raw:
                break
            out = self.stream.decompress(raw, len(into))
        into[: len(out)] = out
        return len(out)


def _elements(packed: bool, content: bytes, tag: str) -> Iterator:
    """Elements of one kind, each cleared once it has been used."""
    for _, node in ElementTree.iterparse(io.BufferedReader(_Unpacked(packed, content))):
        if node.tag == f"{_NS}{tag}":
            yield node
            node.clear()


def _cells(part) -> Iterator[tuple]:
    """Nonblank cells of one sheet: their value, or the number of their shared string."""
    dates = set(part.dates.tolist())
    for row in _elements(part.packed, part.content, "row"):
        for i, cell in enumerate(row.iter(f"{_NS}c")):
            kind, raw = cell.get("t"), cell.find(f"{_NS}v")
            value = _text(cell) if kind == "inlineStr" else raw.text if raw is not None else None
            if value is None or value == "":
                continue
            shared = int(value) if kind == "s" else None
            if kind is None and int(cell.get("s", 0)) in dates:
                value = str((pd.Timestamp("1899-12-30") + pd.Timedelta(days=float(value))).date())
            col = _column(cell.get("r")) if cell.get("r") else i
            yield part.path, part.sheet, part.sheet_no, int(row.get("r")) - 1, col, None if kind == "s" else value, shared


def _in_blocks(rows: Iterator[tuple], names: list[str], most: int = 50_000) -> Iterator[pd.DataFrame]:
    while block := list(islice(rows, most)):
        yield pd.DataFrame(block, columns=names)


def read_workbooks(spark: SparkSession, glob: str) -> DataFrame:
    """Cells of every workbook that matches: ``path, sheet, sheet_no, row, col, value``.

    A first pass takes the packed sheets out of the archives by their directories and writes them; each sheet is
    then one task's work, and shared strings are a table that cells meet by number.
    """

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, payload in zip(batch["path"], batch["content"]):
                for part in _parts(path, payload):
                    yield pd.DataFrame([part], columns=["path", "kind", "sheet", "sheet_no", "dates", "packed", "content"])

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in batch.itertuples():
                yield from _in_blocks(_cells(part), ["path", "sheet", "sheet_no", "row", "col", "value", "shared"])

    def read_strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in batch.itertuples():
                texts = ((part.path, i, _text(si)) for i, si in enumerate(_elements(part.packed, part.content, "si")))
                yield from _in_blocks(texts, ["path", "shared", "text"])

    files = spark.read.format("binaryFile").load(glob).select("path", "content")
    parts = stage(files.mapInPandas(split, PARTS), "workbook-parts")
    sheets = parts.filter("kind = 'sheet'").repartition("path", "sheet_no")
    cells = sheets.mapInPandas(parse, CELLS + ", shared int")
    strings = parts.filter("kind = 'strings'").repartition("path").mapInPandas(read_strings, "path string, shared int, text string")
    # cells with a value of their own look for a number that no string has, each row another one, so they do not crowd
    looked = cells.withColumn("shared", F.coalesce("shared", -1 - F.col("row")))
    named = looked.join(strings, ["path", "shared"], "left").withColumn("value", F.coalesce("value", "text"))
    return named.filter(F.col("value") != "").select("path", "sheet", "sheet_no", "row", "col", "value")
