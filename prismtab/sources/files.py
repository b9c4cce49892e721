"""Files in and out: CSV, .xlsx, parquet; a catalog of demo files; Markdown and chart data."""

from __future__ import annotations

import io
import re
import zipfile
from pathlib import PurePosixPath
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
#: Bytes of a workbook at most: it is unpacked as a whole by one task.
WORKBOOK = 256 << 20


def load(spark: SparkSession, path: str) -> DataFrame:
    """A table by its file's extension: .csv with header and inferred types, .xlsx (first sheet), .parquet, .json; ValueError for others."""
    kind = PurePosixPath(path.rstrip("/")).suffix.lower()
    if kind == ".csv":
        return spark.read.csv(path, header=True, inferSchema=True)
    if kind == ".xlsx":
        return read_xlsx(spark, path)
    if kind == ".parquet":
        return spark.read.parquet(path)
    if kind == ".json":
        return spark.read.json(path)
    raise ValueError(f"unsupported file type {kind or path!r}")


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a workbook: the first row names the columns, types are inferred from the cells' text as for CSV.

    The workbook is read by Spark's binary reader, so any path that Spark knows will do, and parsed by one task.
    """
    files = spark.read.format("binaryFile").load(path).filter(F.col("length") <= WORKBOOK).select("content")

    @F.udf("array<array<string>>")
    def cells(content):
        return parse_xlsx(bytes(content))

    rows = files.select(F.posexplode(cells("content")).alias("i", "cells"))
    head = rows.filter("i = 0").first()
    if head is None:
        raise ValueError(f"no workbook of at most {WORKBOOK} bytes at {path!r}")
    names = [n or f"column_{i + 1}" for i, n in enumerate(head["cells"])]
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", *[F.when(F.try_element_at("cells", F.lit(i + 1)).isNotNull(), quoted(F.try_element_at("cells", F.lit(i + 1)))).otherwise(F.lit("")) for i in range(len(names))])
    lines = rows.filter("i > 0").select(F.regexp_replace(line, r"[\r\n]+", " ").alias("value"))
    return spark.read.csv(lines.rdd.map(lambda r: r[0]), inferSchema=True, escape='"').toDF(*names)


def parse_xlsx(content: bytes) -> list[list[str | None]]:
    """The rows of a workbook's first sheet, cells as text."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in root.iter(f"{_MAIN}si")]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        root = ElementTree.fromstring(z.read(sheets[0]))
    rows: list[list[str | None]] = []
    for row in root.iter(f"{_MAIN}row"):
        out: list[str | None] = []
        for c in row.iter(f"{_MAIN}c"):
            at = re.match(r"[A-Z]+", c.get("r", ""))
            column = 0
            for ch in at[0] if at else "":
                column = column * 26 + ord(ch) - 64
            column = column - 1 if at else len(out)
            out += [None] * (column - len(out) + 1)
            kind, v = c.get("t"), c.find(f"{_MAIN}v")
            if kind == "inlineStr":
                out[column] = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
            elif v is not None and v.text is not None:
                out[column] = shared[int(v.text)] if kind == "s" else {"0": "false", "1": "true"}.get(v.text, v.text) if kind == "b" else v.text
        rows.append(out)
    return rows


def write_xlsx(path: str, rows: list[list]) -> None:
    """A workbook with one sheet, for small results on the driver: numbers as numbers, the rest as inline text."""
    from xml.sax.saxutils import escape

    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"<c><v>{v}</v></c>"
        return f'<c t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'

    body = "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in rows)
    ns = _MAIN.strip("{}")
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData>{body}</sheetData></worksheet>')


def demo_catalog(spark: SparkSession, folder: str) -> dict[str, str]:
    """Title-cased names and paths of a folder's CSV files, as Spark lists them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path").collect()  # a row for each file
    return {re.sub(r"\.csv$", "", PurePosixPath(r["path"]).name).replace("_", " ").title(): r["path"] for r in sorted(files)}


def register_demos(spark: SparkSession, folder: str) -> list[str]:
    """The folder's CSV files as temporary views named as the files; the views' names."""
    out = []
    for path in demo_catalog(spark, folder).values():
        name = re.sub(r"\W+", "_", PurePosixPath(path).stem)
        load(spark, path).createOrReplaceTempView(name)
        out.append(name)
    return out


def preview(df: DataFrame, n: int = 50) -> DataFrame:
    return df.limit(n)


def write_markdown(spark: SparkSession, text: str, path: str) -> None:
    """A report's text as one file in the folder path."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)


def write_charts(charts: list, folder: str) -> list[str]:
    """Each chart's data as parquet under folder, with its title and kind in the names; no picture is drawn. A chart that can't be written is skipped."""
    out = []
    for i, c in enumerate(charts):
        path = f"{folder}/chart_{i}_{c.kind}"
        try:
            c.data.write.mode("overwrite").parquet(path)
        except Exception:  # noqa: BLE001  as a missing picture, a missing chart is not an error
            continue
        out.append(path)
    return out
