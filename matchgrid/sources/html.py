"""Tables of HTML pages, parsed in Arrow batches (Spark has no HTML reader)."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[str]]] = []
        self.stack: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
            self.stack.append(self.tables[-1])
        elif self.stack and tag == "tr":
            self.stack[-1].append([])
        elif self.stack and tag in ("td", "th"):
            self.cell = []

    def handle_endtag(self, tag):
        if tag == "table" and self.stack:
            self.stack.pop()
        elif tag in ("td", "th") and self.cell is not None:
            if self.stack and self.stack[-1]:
                self.stack[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def parse_tables(html: str | None) -> list[list[list[str]]]:
    p = _Tables()
    p.feed(html or "")
    p.close()
    return [[r for r in t if r] for t in p.tables]


def tables(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, table_no, row_no, cells, header) of every table row; the first row of a table is its header."""
    kind = dict(pages.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, t, r, cells, table[0]) for k, h in zip(b["id"], b["html"]) for t, table in enumerate(parse_tables(h)) for r, cells in enumerate(table)]
            yield pd.DataFrame(rows, columns=["id", "table_no", "row_no", "cells", "header"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    return rows.mapInPandas(run, f"id {kind}, table_no int, row_no int, cells array<string>, header array<string>").withColumnRenamed("id", id_col)


def stat_table(all_tables: DataFrame, id_col: str, markers: tuple[str, ...] = ("Gls", "Goals")) -> DataFrame:
    """Of each page: the first table with a marker in its header, else the one with most rows."""
    marked = F.exists("header", lambda h: F.lit(False) if not markers else h.isin(*markers))
    size = all_tables.groupBy(id_col, "table_no").agg(F.count("*").alias("n"), F.max(marked).alias("marked"))
    best = size.groupBy(id_col).agg(F.min_by("table_no", F.struct(~F.col("marked"), F.when(~F.col("marked"), -F.col("n")), "table_no")).alias("table_no"))
    return all_tables.join(best, [id_col, "table_no"])


def columns_like(table: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """Cells under the first header that holds one of the wanted names, without case; data rows only."""
    def cell(names: list[str]):
        at = F.lit(None).cast("int")
        for n in reversed(names):
            i = F.array_position(F.transform("header", lambda h: F.lower(h).contains(n.lower())), F.lit(True))
            at = F.when(i > 0, i.cast("int")).otherwise(at)
        return F.try_element_at("cells", at)

    keys = [c for c in table.columns if c not in ("cells", "header")]
    return table.where("row_no > 0").select(*keys, *(cell(names).alias(c) for c, names in wanted.items()))
