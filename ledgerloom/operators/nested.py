"""Deeply nested documents into related flat tables.

Two steps.  ``parse`` turns each raw document into one nested record (sections,
and tables holding rows holding cells) in a single Arrow-batched pass over the
bytes; nothing but the markup is interpreted, so wrong encoding labels, stray
``<`` and ``&`` or missing levels do no harm.  The flat tables are then pure
SQL projections: nested ``transform`` calls attach the keys and indices of the
ancestors, ``flatten`` joins the arrays and one ``inline`` per target table
emits its rows.  No projection shuffles.

Defined results: null or empty content has no sections, tables or cells;
comments, CDATA, processing instructions and escaped markup are no elements; a
cell without a row opens a row, a row or cell without a table goes to table 0;
an element left open ends with its parent.  Redelivered documents count once
(first ``loaded_at``).
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL = "cell_no int, tag string, acode string, rowspan int, colspan int, text string"
NESTED = (
    "sections array<struct<section_no int, parent_section_no int, level int, title string>>, "
    f"tables array<struct<table_no int, parent_table_no int, section_no int, parent_section_no int, rows array<struct<row_no int, cells array<struct<{CELL}>>>>>>"
)

MARKUP = re.compile(
    rb"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<\?.*?(?:\?>|\Z)"
    rb"|<(/?)(section-[123]|table|tr|td|th|te|tu|title)(?=[\s/>])((?:[^<>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>",
    re.S | re.I,
)
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[/?!]?[A-Za-z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*>", re.S)
ATTRIBUTE = re.compile(rb"([A-Za-z_:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
CELLS = (b"td", b"th", b"te", b"tu")


def decode(raw: bytes) -> str:
    """Text of a document, whatever its label says: BOM, then UTF-8, then CP949 with replacement."""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return raw.decode("utf-16", "replace")
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return raw.decode("cp949", "replace")


def inner_text(raw: bytes) -> str:
    text = decode(raw)
    cdata = re.sub(r"<!\[CDATA\[(.*?)\]\]>", lambda m: html.escape(m[1]), text, flags=re.S)
    return " ".join(html.unescape(TAG.sub(" ", cdata)).split())


def span(attributes: dict[bytes, bytes], name: bytes) -> int:
    value = attributes.get(name, b"1").strip()
    return min(int(value), 2**31 - 1) if value.isdigit() and 0 < len(value) < 20 and int(value) > 0 else 1


def parse_document(raw: bytes | None) -> dict:
    """The nested record of one document."""
    sections: list[dict] = []
    tables: list[dict] = []
    if not raw:
        return {"sections": sections, "tables": tables}
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        raw = decode(raw).encode()
    loose: dict | None = None
    #: Open elements, innermost last: (kind, record, start of content).
    stack: list[tuple[bytes, dict, int]] = []

    def close(depth: int, end: int) -> None:
        while len(stack) > depth:
            kind, record, start = stack.pop()
            if kind in CELLS:
                record["text"] = inner_text(raw[start:end])
            elif kind == b"title" and stack and stack[-1][0].startswith(b"section") and stack[-1][1]["title"] is None:
                stack[-1][1]["title"] = inner_text(raw[start:end])

    def innermost(*kinds: bytes) -> int | None:
        return next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in kinds), None)

    def open_row(table: dict) -> dict:
        row = {"row_no": len(table["rows"]) + 1, "cells": []}
        table["rows"].append(row)
        return row

    def current_table() -> dict:
        nonlocal loose
        at = innermost(b"table")
        if at is not None:
            return stack[at][1]
        if loose is None:
            loose = {"table_no": 0, "parent_table_no": 0, "section_no": 0, "parent_section_no": 0, "rows": []}
            tables.append(loose)
        return loose

    for m in MARKUP.finditer(raw):
        if m[2] is None:
            continue
        kind = m[2].lower()
        base = innermost(b"table")
        floor = 0 if base is None else base + 1
        if m[1]:
            at = innermost(kind)
            # an end tag never reaches out of the table it stands in
            if at is not None and (at >= floor or kind == b"table"):
                close(at, m.start())
            elif at is not None and kind.startswith(b"section"):
                close(at, m.start())
            continue
        if kind.startswith(b"section"):
            around = [s[1] for s in stack if s[0].startswith(b"section")]
            record = {"section_no": len(sections) + 1, "parent_section_no": around[-1]["section_no"] if around else 0, "level": int(kind[-1:]), "title": None}
            sections.append(record)
        elif kind == b"table":
            around = [s[1]["section_no"] for s in stack if s[0].startswith(b"section")]
            outer = [s[1]["table_no"] for s in stack if s[0] == b"table"]
            number = sum(t["table_no"] > 0 for t in tables) + 1
            record = {"table_no": number, "parent_table_no": outer[-1] if outer else 0, "section_no": around[-1] if around else 0, "parent_section_no": around[-2] if len(around) > 1 else 0, "rows": []}
            tables.append(record)
        elif kind == b"tr":
            at = next((i for i in range(floor, len(stack)) if stack[i][0] == b"tr" or stack[i][0] in CELLS), None)
            if at is not None:
                close(at, m.start())
            record = open_row(current_table())
        elif kind in CELLS:
            at = next((i for i in range(floor, len(stack)) if stack[i][0] in CELLS), None)
            if at is not None:
                close(at, m.start())
            at = next((i for i in range(floor, len(stack)) if stack[i][0] == b"tr"), None)
            if at is None:
                row = open_row(current_table())
                stack.append((b"tr", row, m.start()))
            else:
                row = stack[at][1]
            attributes = {a[1].lower(): a[2] if a[2] is not None else a[3] for a in ATTRIBUTE.finditer(m[3] or b"")}
            code = attributes.get(b"acode")
            record = {"cell_no": len(row["cells"]) + 1, "tag": kind.decode().upper(), "acode": code.decode("ascii", "replace") if code is not None else None, "rowspan": span(attributes, b"rowspan"), "colspan": span(attributes, b"colspan"), "text": ""}
            row["cells"].append(record)
        else:
            record = {}
        if not m[4]:
            stack.append((kind, record, m.end()))
    close(0, len(raw))
    return {"sections": sections, "tables": tables}


def parse(documents: DataFrame) -> DataFrame:
    """document_id with the nested record of each document, one row per record id."""
    once = documents.groupBy("document_id").agg(F.min_by("raw_xml", F.struct(F.col("loaded_at").isNull(), F.col("loaded_at"))).alias("raw_xml"))

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            records = [parse_document(raw) for raw in pdf["raw_xml"]]
            yield pd.DataFrame({"document_id": pdf["document_id"], "sections": [r["sections"] for r in records], "tables": [r["tables"] for r in records]})

    return once.mapInPandas(batches, f"document_id string, {NESTED}")


def sections(parsed: DataFrame) -> DataFrame:
    return parsed.select("document_id", F.inline("sections"))


def tables(parsed: DataFrame) -> DataFrame:
    return parsed.select("document_id", F.inline(F.expr("transform(tables, t -> struct(t.table_no, t.parent_table_no, t.section_no, t.parent_section_no, size(t.rows) AS n_rows))")))


def rows(parsed: DataFrame) -> DataFrame:
    return parsed.select("document_id", F.inline(F.expr("flatten(transform(tables, t -> transform(t.rows, r -> struct(t.table_no, r.row_no, size(r.cells) AS n_cells))))")))


def cells(parsed: DataFrame) -> DataFrame:
    """One row per cell with the keys of all its ancestors."""
    return parsed.select(
        "document_id",
        F.inline(
            F.expr(
                "flatten(flatten(transform(tables, t -> transform(t.rows, r -> transform(r.cells, c -> "
                "struct(t.section_no, t.parent_section_no, t.table_no, t.parent_table_no, r.row_no, c.cell_no, c.tag, c.acode, c.rowspan, c.colspan, c.text))))))"
            )
        ),
    )
