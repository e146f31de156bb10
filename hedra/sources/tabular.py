"""Market spreadsheets: encoding, delimiter and header are found from the first bytes; the rows are read by Spark as text, with nothing taken for missing."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from hedra.functions.parse import neutral_cell
from hedra.operators.profile import column_map, internal_names

EXTENSIONS = ("csv", "xls", "xlsx")
#: Bytes of a file from which its form is read.
HEAD = 1 << 16
#: Stands for null, which no cell of a text file is.
NO_NULL = "\x00null"
# Byte order marks, longest first, and delimiters in order of preference.
MARKS = [(b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")]
DELIMITERS = (",", ";", "\t", "|")


class IngestError(ValueError):
    """A file that can't be read; `code` says why."""

    def __init__(self, code: str, detail: str = "") -> None:
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


@dataclass(frozen=True)
class Form:
    encoding: str
    delimiter: str
    bom: bool
    columns: tuple[str, ...]


def extension(name: str) -> str:
    name = name.rpartition("/")[2]
    return name.rpartition(".")[2].lower() if "." in name else ""


def encoding_of(head: bytes, given: str | None = None, whole: bool = True) -> tuple[str, bool]:
    """A given encoding, the byte order mark's, or the first that decodes the bytes (latin-1 always does)."""
    if given:
        return given, False
    for mark, name in MARKS:
        if head.startswith(mark):
            return name, True
    for name in ("utf-8", "cp1252", "latin-1"):
        try:
            head.decode(name)
        except UnicodeDecodeError as e:
            if name == "utf-8" and not whole and e.start >= len(head) - 3:
                return name, False  # a character is cut at the end of the sample
            continue
        return name, False
    return "latin-1", False


def delimiter_of(text: str) -> str:
    """What the sniffer finds in 20 lines, else the most frequent in the header."""
    lines = [x for x in text.splitlines() if x.strip()][:20]
    try:
        return csv.Sniffer().sniff("\n".join(lines), "".join(DELIMITERS)).delimiter
    except csv.Error:
        counts = [lines[0].count(d) if lines else 0 for d in DELIMITERS]
        return DELIMITERS[counts.index(max(counts))] if max(counts) else ","


def form_of(spark: SparkSession, path: str, encoding: str | None = None, delimiter: str | None = None) -> Form:
    """Reads the head of a file, or of the first file of a folder, by the file system that Spark has for the path: HEAD bytes, whatever the files' sizes."""
    file = spark.read.format("binaryFile").load(path).select("path", "length").orderBy("path").first()  # no content
    if file is None or not file["length"]:
        raise IngestError("empty_file")
    where = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file["path"]))
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        head = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(file["length"], HEAD)))
    finally:
        stream.close()
    name, bom = encoding_of(head, encoding, file["length"] <= HEAD)
    text = head.decode(name, "replace").lstrip("﻿")
    sep = delimiter or delimiter_of(text)
    return Form(name, sep, bom, tuple(next(csv.reader(io.StringIO(text), delimiter=sep), [])))


def check_size(spark: SparkSession, path: str, most: int) -> None:
    """An error where the files of a path are larger together than `most` bytes; no content is read."""
    total = spark.read.format("binaryFile").load(path).agg(F.sum("length").alias("n")).first()["n"] or 0
    if total > most:
        raise IngestError("file_too_large", f"{total} > {most}")


def read_csv(spark: SparkSession, path: str, encoding: str | None = None, delimiter: str | None = None, most_bytes: int | None = None) -> tuple[DataFrame, Form, dict[str, str]]:
    """Rows with internal column names (all text; an empty cell stays empty), the form, and the map from original names. most_bytes: a limit of size, where a caller has one."""
    if most_bytes is not None:
        check_size(spark, path, most_bytes)
    if extension(path) not in ("csv", ""):
        raise IngestError("unsupported_format", extension(path))
    form = form_of(spark, path, encoding, delimiter)
    names = column_map(list(form.columns))
    schema = StructType([StructField(n, StringType()) for n in internal_names(list(form.columns))])
    spark_name = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "latin-1": "ISO-8859-1", "cp1252": "windows-1252"}.get(form.encoding, form.encoding.upper())
    df = spark.read.csv(path, schema=schema, sep=form.delimiter, encoding=spark_name, header=True, multiLine=True, escape='"', nullValue=NO_NULL, emptyValue="", enforceSchema=True, mode="PERMISSIVE")
    return df.fillna(""), form, names


def _sheet(content: bytes) -> pd.DataFrame:
    """First sheet of an .xlsx file as text."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        first = min(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))
        rows = []
        for row in ElementTree.fromstring(z.read(first)).iter(f"{{{ns['m']}}}row"):
            cells: dict[int, str] = {}
            for c in row.findall("m:c", ns):
                letters = [x for x in c.get("r", "") if x.isalpha()]
                at = 0
                for x in letters:
                    at = at * 26 + ord(x) - 64
                v = c.find("m:v", ns)
                value = v.text if v is not None else "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t"))
                cells[at - 1 if letters else len(cells)] = shared[int(value)] if c.get("t") == "s" and value else value or ""
            rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
    width = max(map(len, rows), default=0)
    return pd.DataFrame([r + [""] * (width - len(r)) for r in rows[1:]], columns=(rows[0] + [""] * (width - len(rows[0])) if rows else []))


def read_xlsx(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """First sheet of every file of a path; files are read in parallel, each by one task, and must share the first one's header."""
    files = spark.read.format("binaryFile").load(path)
    first = files.orderBy("path").select("content").first()
    if first is None:
        raise IngestError("empty_file")
    header = list(_sheet(bytes(first["content"])).columns)
    names, inner = column_map(header), internal_names(header)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch.content:
                sheet = _sheet(bytes(content))
                if list(sheet.columns) != header:
                    raise IngestError("header_mismatch")
                yield sheet.set_axis(inner, axis=1).astype(str)

    return files.select("content").mapInPandas(rows, ", ".join(f"`{n}` string" for n in inner)), names


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and SHA-256 of every file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_manifest(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """path and status (ok, changed, missing, unexpected) of every file on either side; both have path and sha256."""
    joined = found.select("path", F.col("sha256").alias("_now")).join(manifest.select("path", F.col("sha256").alias("_due")), "path", "full")
    return joined.select("path", F.when(F.col("_now").isNull(), "missing").when(F.col("_due").isNull(), "unexpected").when(F.col("_now") == F.col("_due"), "ok").otherwise("changed").alias("status"))


def write_csv(df: DataFrame, path: str, safe: bool = True) -> None:
    """UTF-8 files with a header; safe: no cell is one that a spreadsheet would run. Doubles keep all digits."""
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])  # names may hold dots
    out = flat.select(*[(neutral_cell(F.col(c)) if safe and kind == "string" else F.col(c).cast("string")).alias(name) for (c, kind), name in zip(flat.dtypes, df.columns, strict=True)])
    out.write.csv(path, header=True, quote='"', escape='"', emptyValue="", encoding="UTF-8", mode="overwrite")


def write_pair(df: DataFrame, path: str) -> DataFrame:
    """A raw and a safe copy of a table, and the manifest of their files."""
    write_csv(df, f"{path}/raw", safe=False)
    write_csv(df, f"{path}/safe")
    return content_hashes(df.sparkSession, path)


def hex_number(column: str, df: DataFrame) -> DataFrame:
    """Adds <column>_text (17 digits) and <column>_hex of a double, which lose nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch[column]
            yield batch.assign(**{f"{column}_text": [None if pd.isna(v) else f"{v:.17g}" for v in x], f"{column}_hex": [None if pd.isna(v) else float(v).hex() for v in x]})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{fields}, `{column}_text` string, `{column}_hex` string")
