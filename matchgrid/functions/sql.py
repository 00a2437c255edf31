"""Names for SQL text: the functions that Spark lacks, as SQL functions and table functions."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from matchgrid.functions.text import ascii_name
from matchgrid.operators.resolve import similarity
from matchgrid.sources.html import parse_tables


@udtf(returnType="table_no int, row_no int, cells array<string>, header array<string>")
class HtmlTables:
    """The rows of a page's tables, tables and rows numbered from 0; none for null."""

    def eval(self, html: str):
        for t, table in enumerate(parse_tables(html)):
            for r, cells in enumerate(table):
                yield t, r, cells, table[0]


@udtf(returnType="slot int, name string, minutes int, starter boolean")
class RosterEntries:
    """The entries of ``text.roster_entries``, a row each, numbered from 0."""

    def eval(self, text: str):
        for slot, part in enumerate(p for p in (text or "").split(",") if p.strip(" ")):
            name, colon, minutes = part.rpartition(":")
            number = int(minutes) if colon and minutes.strip().isdecimal() else None
            yield slot, (name if colon else part).strip(" "), number, number is not None and number >= 60


def register(spark: SparkSession) -> None:
    """ascii_name(text), token_set_ratio(text, text), and the table functions html_tables(text) and roster_entries(text)."""
    spark.udf.register("ascii_name", ascii_name)
    spark.udf.register("token_set_ratio", similarity)
    spark.udtf.register("html_tables", HtmlTables)
    spark.udtf.register("roster_entries", RosterEntries)
