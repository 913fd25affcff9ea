"""File sources: processed-table CSV (SRC-3) and workbooks (SRC-1).

Workbooks are read with ``binaryFile`` + ``mapInPandas`` and parsed with the
standard library (a workbook is a zip of XML parts), row by row, so that a task
holds the packed file, its shared strings and one chunk of rows, never a parsed
sheet.  Small workbooks share tasks; a large one is dealt over several tasks, each
giving every n-th block of its rows.  No file passes through the driver.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, header_map: dict | None = None) -> DataFrame:
    """SRC-3: a processed table in CSV with a header, under a declared schema.
    With ``header_map`` (original -> physical name) the file's own headers are
    used and renamed, so files carrying the original (Japanese) headers load
    into the ASCII physical schema."""
    if not header_map:
        return spark.read.schema(schema).option("header", True).csv(path)
    st = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    raw = spark.read.option("header", True).csv(path)
    named = raw.select(*[F.col(f"`{c}`").alias(header_map.get(c, c)) for c in raw.columns])
    return named.select(*[(named[f.name].try_cast(f.dataType) if f.name in named.columns
                           else F.lit(None).cast(f.dataType)).alias(f.name) for f in st.fields])


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _plain_text(item) -> str:
    """Text of a string item: its own and its runs' text, without phonetic runs."""
    parts = item.findall("m:t", _NS) + item.findall("m:r/m:t", _NS) if item is not None else []
    return "".join(t.text or "" for t in parts)


def uses_1904_dates(content: bytes) -> bool:
    """Whether the workbook counts date serials from 1904 instead of 1900."""
    wb = ET.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("xl/workbook.xml"))
    props = wb.find("m:workbookPr", _NS)
    return props is not None and props.get("date1904") in ("1", "true")


def _elements(z: zipfile.ZipFile, part: str, tag: str):
    """The elements of one kind of an XML part, one at a time; what was read is forgotten."""
    with z.open(part) as f:
        events = ET.iterparse(f, ("start", "end"))
        _, root = next(events)
        open_ = [root]
        for event, element in events:
            if event == "start":
                open_.append(element)
                continue
            open_.pop()
            if element.tag == f"{{{_NS['m']}}}{tag}":
                yield element
                open_[-1].clear()


def sheet_rows(content: bytes, sheet: int = 0, part: int = 0, parts: int = 1):
    """(row number, cell values as strings / floats) of one sheet, as it is read; row 0 is the header.

    With ``parts`` > 1 only the header and the blocks of rows that are dealt to ``part``.
    """
    z = zipfile.ZipFile(io.BytesIO(content))
    shared = [_plain_text(si) for si in _elements(z, "xl/sharedStrings.xml", "si")] \
        if "xl/sharedStrings.xml" in z.namelist() else []
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    rid = wb.findall("m:sheets/m:sheet", _NS)[sheet].get(_REL)
    rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    target = next(r.get("Target") for r in rels if r.get("Id") == rid).lstrip("/")
    target = target if target.startswith("xl/") else f"xl/{target}"
    for number, r in enumerate(_elements(z, target, "row")):
        if number and number // ROW_BLOCK % parts != part:
            continue
        vals: dict[int, object] = {}
        place = -1
        for c in r.findall("m:c", _NS):
            t = c.get("t")
            v = c.find("m:v", _NS)
            if t == "s" and v is not None:
                val = shared[int(v.text)]
            elif t == "inlineStr":
                val = _plain_text(c.find("m:is", _NS))
            elif t in ("str", "b", "e"):
                val = v.text if v is not None else None
            else:
                val = float(v.text) if v is not None and v.text not in (None, "") else None
            place = _col_index(c.get("r")) if c.get("r") else place + 1   # without a reference: the next cell
            vals[place] = val
        yield number, [vals.get(i) for i in range(max(vals) + 1 if vals else 0)]


def workbook_rows(content: bytes, sheet: int = 0) -> list[list]:
    """Cell values of one sheet as rows of strings / floats (first row = header)."""
    return [values for _, values in sheet_rows(content, sheet)]


def read_workbooks(spark: SparkSession, path: str, schema: T.StructType, header_map: dict | None = None) -> DataFrame:
    """SRC-1: every workbook under ``path`` (glob allowed) -> rows of ``schema``.

    Header names are mapped to physical names with ``header_map`` (original
    -> physical, e.g. the Japanese headers of the call table); columns absent
    from a workbook are null; values are coerced by Spark's cast rules later.
    """
    names = [f.name for f in schema.fields]
    dates = {f.name for f in schema.fields if isinstance(f.dataType, (T.TimestampType, T.DateType))}
    inverse = dict(header_map or {})
    str_schema = T.StructType([T.StructField(n, T.StringType()) for n in names])

    def parse(batches):
        for pdf in batches:
            for content, part, parts in zip(pdf["content"], pdf["part"], pdf["parts"]):
                content = bytes(content)
                shift = DAYS_1904 if uses_1904_dates(content) else 0
                pos, out = {}, []
                for number, r in sheet_rows(content, 0, part, parts):
                    if number == 0:
                        header = [inverse.get(h, h) if isinstance(h, str) else h for h in r]
                        pos = {h: i for i, h in enumerate(header)}
                        # the header's own block of rows is dealt to part 0
                        continue
                    out.append({n: (None if pos.get(n) is None or pos[n] >= len(r) or r[pos[n]] is None
                                    else _text(r[pos[n]] + shift if n in dates and isinstance(r[pos[n]], float)
                                               else r[pos[n]])) for n in names})
                    if len(out) == ROW_BLOCK:
                        yield pd.DataFrame(out, columns=names)
                        out = []
                yield pd.DataFrame(out, columns=names)

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))   # a few packed files at a time
    files = spark.read.format("binaryFile").load(path).select(
        "path", "content", F.ceil(F.col("length") / PART_BYTES).cast("int").alias("parts"))
    one = files.where("parts <= 1").select("content", F.lit(0).alias("part"), F.lit(1).alias("parts"))
    many = files.where("parts > 1").select("path", "content", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
                                           "parts")
    dealt = many.repartition("path", "part").select("content", "part", "parts")
    raw = one.unionAll(dealt).mapInPandas(parse, str_schema)
    return raw.select(*[_typed(raw[f.name], f.dataType).alias(f.name) for f in schema.fields])


#: Rows of a chunk; packed bytes of a workbook that one task parses; packed bytes handed to Python at once.
ROW_BLOCK = 4096
PART_BYTES = 8 << 20
BATCH_BYTES = 32 << 20
DAYS_1904 = 1462                  # fixed value: days from the 1900 to the 1904 date system
EXCEL_EPOCH_UNIX_DAYS = 25569     # fixed value: day 0 of workbook date serials is 1899-12-30


def _typed(c, dtype):
    """Text cell -> declared type; timestamps accept text or a workbook date
    serial (days since 1899-12-30, fraction = time of day)."""
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, (T.TimestampType, T.DateType)):
        serial = c.try_cast("double")
        from_serial = F.timestamp_micros(((serial - EXCEL_EPOCH_UNIX_DAYS) * 86400 * 1_000_000).cast("long"))
        ts = F.coalesce(F.when(serial.isNotNull(), from_serial), F.try_to_timestamp(c))
        return ts.cast(dtype)
    return c.try_cast(dtype)


def _text(v) -> str:
    if isinstance(v, float) and v.is_integer():
        return str(int(v))
    return str(v)
