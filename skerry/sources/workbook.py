"""Workbooks: rows of the first (or a named) sheet of xlsx files, read where the files are.

A file is one task's work, as a zip archive can't be split; many files are read side by side. The header is the first row with
two filled cells or more; blank rows at the end are dropped; cells come as text, and typing follows the CSV policy.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.sources.ingest import Parsed, Rejected, policies, scan_archive

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def place(reference: str) -> int:
    """The column of a cell reference such as AB12, from 0."""
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def sheet_rows(data: bytes, sheet: str | None = None) -> Iterator[tuple[int, list[str | None]]]:
    """(row number, cells) of a sheet; blanks are None, numbers as written, true and false as words."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]
        sheets = {s.get("name"): s.get(f"{LINK}id") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet")}
        if not sheets or (sheet and sheet not in sheets):
            raise Rejected(f"no sheet {sheet or ''}")
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = links[sheets[sheet or next(iter(sheets))]]
        for row in ElementTree.fromstring(z.read("xl/" + target.removeprefix("/xl/"))).iter(f"{MAIN}row"):
            cells: list[str | None] = []
            for c in row.iter(f"{MAIN}c"):
                at = place(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                value, kind = c.find(f"{MAIN}v"), c.get("t")
                if kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
                elif value is None or value.text is None:
                    text = None
                else:
                    text = shared[int(value.text)] if kind == "s" else ("true" if value.text == "1" else "false") if kind == "b" else value.text
                cells[at] = text or None
            yield int(row.get("r") or 0), cells


def read_rows(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """(file, row, cells) of all workbooks at a path."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                if problems := scan_archive(bytes(data)):
                    raise Rejected(f"{name}: {', '.join(problems)}")
                rows = list(sheet_rows(bytes(data), sheet))
                yield pd.DataFrame({"file": name, "row": [n for n, _ in rows], "cells": [c for _, c in rows]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "file string, row long, cells array<string>")


def parse_xlsx(spark: SparkSession, path: str, sheet: str | None = None) -> Parsed:
    """Accepted rows of one workbook with typed columns."""
    rows = read_rows(spark, path, sheet).withColumn("filled", F.size(F.filter("cells", lambda c: c.isNotNull())))
    header = rows.where("filled >= 2").orderBy("row").first()
    if header is None:
        raise Rejected("no row has two filled cells")
    names = [c if c is not None else f"column_{i + 1}" for i, c in enumerate(header["cells"])]
    body = rows.where((F.col("row") > header["row"]) & (F.col("filled") > 0))
    extra = F.size("cells") > len(names)
    rejected = body.where(extra).select(F.col("row").alias("line"), F.lit("more cells than the header").alias("reason"))
    texts = body.where(~extra).select(F.col("row").alias("_line"), *(F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)))
    types, issues = policies(texts, names)
    typed = texts.select(*(F.when(F.col(n) != "", F.col(n)).try_cast({"integer": "long", "float": "double"}.get(types[n], "string")).alias(n) for n in names))
    return Parsed(typed, rejected, issues, types)
