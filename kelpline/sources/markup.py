"""Tables of HTML pages as cells: which table, row and column a text stands in, whatever is nested or left open.

A page is taken apart where it is, without a shuffle or a sort.  It is cut at the tags that open and close tables, of which it has few; a stack of the
open ones gives each part to the innermost, and what stands in a nested table belongs to that one.  A table's own parts are put
together and cut at its rows, and these at their cells: a row or a cell ends where the next one of its table begins, so that closing
tags may be missing.  Pages without tables make no rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpline.functions.text import collapse, html_to_text

#: Put before each tag of a table; in a page that has it, it is written in another way until the cells are cut.
_MARK, _OTHER = "\ufdd0", "\ufdd1"
_HIDDEN = r"(?is)<(?:!--.*?-->|(script|style|noscript)\b[^>]*>.*?</\1\s*>)"
_TAG = r"<(/?[tT](?:[rRdDhH]|[aA][bB][lL][eE])\b[^>]*>)"
#: A tag without an end, which is the last of its page, opens nothing.
_UNENDED = r"(?is)</?(?:table|tr|td|th)\b.*"
#: As many elements as there are.
_ALL = 1 << 30
_OPEN = "array<struct<table:int,parent:int,parts:array<string>>>"


def _behind(part: Column) -> Column:
    """What follows the tag that a part begins with."""
    return F.substr(part, F.instr(part, F.lit(">")) + 1)


def _written(c: Column) -> Column:
    """A page without marks of its own; _read undoes it."""
    other = F.replace(F.replace(c, F.lit(_OTHER), F.lit(f"{_OTHER}b")), F.lit(_MARK), F.lit(f"{_OTHER}a"))
    return F.when(F.contains(c, F.lit(_MARK)) | F.contains(c, F.lit(_OTHER)), other).otherwise(c)


def _read(c: Column) -> Column:
    return F.when(F.contains(c, F.lit(_OTHER)), F.replace(F.replace(c, F.lit(f"{_OTHER}a"), F.lit(_MARK)), F.lit(f"{_OTHER}b"), F.lit(_OTHER))).otherwise(c)


def _tables(html: Column) -> Column:
    """Structs (table, parent, own): each table of a page with what is its own, from its tag on; a space stands for a nested one."""
    marked = F.regexp_replace(F.regexp_replace(_written(html), _HIDDEN, " "), _TAG, f"{_MARK}$1")
    parts = F.split(marked, f"{_MARK}(?=/?[tT][aA])", -1)
    top = lambda s: F.get(s["open"], F.lit(0))

    def opened(s: Column, part: Column) -> Column:
        own = F.struct((s["n"] + 1).alias("table"), top(s)["table"].alias("parent"), F.array(part).alias("parts"))
        return F.struct(F.concat(F.array(own), s["open"]).alias("open"), s["done"].alias("done"), (s["n"] + 1).alias("n"))

    def closed(s: Column, part: Column) -> Column:
        more = lambda t: F.struct(t["table"].alias("table"), t["parent"].alias("parent"), F.array_append(t["parts"], _behind(part)).alias("parts"))
        around = F.concat(F.transform(F.slice(s["open"], 2, 1), more), F.slice(s["open"], 3, _ALL))
        return F.struct(around.alias("open"), F.array_append(s["done"], top(s)).alias("done"), s["n"].alias("n"))

    # A closing tag too many closes nothing.
    step = lambda s, part: F.when(~part.startswith("/"), opened(s, part)).when(F.size(s["open"]) > 0, closed(s, part)).otherwise(s)
    none = F.array().cast(_OPEN)
    start = F.struct(none.alias("open"), none.alias("done"), F.lit(0).alias("n"))
    found = F.aggregate(F.slice(parts, 2, _ALL), start, step, lambda s: F.concat(s["done"], s["open"]))
    return F.transform(found, lambda t: F.struct(t["table"].alias("table"), t["parent"].alias("parent"), F.array_join(t["parts"], " ").alias("own")))


def _rows(own: Column) -> Column:
    """A table cut at its rows; the first piece holds the cells before any row."""
    return F.split(own, f"{_MARK}(?=[tT][rR])", -1)


def _cells(row: Column) -> Column:
    """The cells of a row, from the names of their tags on; what follows a closing tag is in none."""
    return F.filter(F.split(row, _MARK, -1), lambda x: F.lower(F.left(x, F.lit(2))).isin("td", "th"))


def _columns(cells: Column) -> Column:
    """The first column of each cell, from 1, spans counted."""
    spans = lambda x: F.contains(F.lower(x), F.lit("colspan"))
    stated = lambda x: F.regexp_extract(F.substring_index(x, ">", 1), r"(?i)\bcolspan\s*=\s*[\"']?(\d{1,4})", 1)
    span = lambda x: F.when(spans(x), F.greatest(F.lit(1), F.concat(F.lit("0"), stated(x)).cast("int"))).otherwise(1)
    after = F.aggregate(cells, F.array(F.lit(1)), lambda cols, x: F.array_append(cols, F.element_at(cols, -1) + span(x)))
    return F.when(F.exists(cells, spans), F.slice(after, F.lit(1), F.size(cells))).otherwise(F.transform(cells, lambda x, k: k + 1))


def _inner(cell: Column) -> Column:
    inner = _behind(cell)
    return _read(F.when(F.contains(inner, F.lit("<")), F.regexp_replace(inner, _UNENDED, "")).otherwise(inner))


def _text(inner: Column) -> Column:
    return F.when(F.contains(inner, F.lit("<")) | F.contains(inner, F.lit("&")), html_to_text(inner)).otherwise(collapse(inner))


def _link(inner: Column) -> Column:
    """The first address in a cell, or null."""
    return F.when(F.contains(inner, F.lit("=")), F.nullif(F.regexp_extract(inner, r"(?i)\bhref\s*=\s*[\"']([^\"']+)", 1), F.lit("")))


def table_cells(pages: DataFrame, page_id: str, html: str) -> DataFrame:
    """pages -> page_id, table, parent, row, col, head, text, link: a row for each cell.

    table numbers a page's tables from 1 in the order in which they open; parent is the table around it, null for an outer one.  row counts
    the table's rows from 1, 0 for cells before the first; cells behind the end of a row still are that row's.  col is the cell's first column,
    spans counted.  head: the cell is a <th>.  text: what is visible in the cell, without nested tables; link: the first address in
    it.  Tags outside of a table are passed over, as are comments and scripts; a closing tag too many closes nothing.  Null and empty
    pages, and pages without cells, have no rows; each row of pages is a page of its own.
    """
    t = pages.select(F.col(page_id).alias("p"), F.explode(_tables(F.col(html))).alias("t"))
    t = t.select("p", "t.table", "t.parent", F.posexplode(_rows(F.col("t.own"))).alias("row", "own"))
    t = t.select("p", "table", "parent", "row", _cells(F.col("own")).alias("cells"))
    t = t.select("p", "table", "parent", "row", F.explode(F.arrays_zip(_columns(F.col("cells")).alias("col"), F.col("cells").alias("cell"))).alias("c"))
    t = t.select("p", "table", "parent", "row", "c.col", (F.lower(F.left("c.cell", F.lit(2))) == "th").alias("head"), _inner(F.col("c.cell")).alias("inner"))
    return t.select(F.col("p").alias(page_id), "table", "parent", "row", "col", "head", _text(F.col("inner")).alias("text"), _link(F.col("inner")).alias("link"))


def _key(c: Column) -> Column:
    """A label as it is compared: lower case, without white space and signs."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def _names(fields: Mapping[str, Sequence[str]], c: Column) -> Column:
    """The field that a label stands for."""
    out = F.lit(None).cast("string")
    for name, labels in fields.items():
        out = F.when(_key(c).isin([_plain(x) for x in labels]), name).otherwise(out)
    return out


def _plain(label: str) -> str:
    return "".join(ch for ch in label.lower() if ch.isalnum())


def labelled_values(cells: DataFrame, page_id: str, fields: Mapping[str, Sequence[str]]) -> DataFrame:
    """cells (of table_cells) -> page_id and a column for each field: the cell to the right of one of its labels, the first on the page.

    A value that is a label itself is none.  Fields are null where no label has a value; pages without any have no row."""
    beside = Window.partitionBy(page_id, "table", "row").orderBy("col")
    t = cells.withColumn("_name", _names(fields, F.col("text"))).withColumn("_value", F.when(F.lead("_name").over(beside).isNull(), F.nullif(F.lead("text").over(beside), F.lit(""))))
    t = t.where("_name IS NOT NULL AND _value IS NOT NULL")
    first = [F.min_by(F.when(F.col("_name") == n, F.col("_value")), F.when(F.col("_name") == n, F.struct("table", "row", "col"))).alias(n) for n in fields]
    return t.groupBy(page_id).agg(*first)


def listed_rows(pages: DataFrame, page_id: str, html: str, fields: Mapping[str, Sequence[str]], link: str = "link") -> DataFrame:
    """pages -> page_id, table, row, a column for each field, link: the rows of tables whose first row names columns by the labels of fields.

    Rows and cells are those of table_cells.  A cell belongs to the name above its first column, so that spans and cells that are left out
    move nothing; the first address in a row is its link."""
    t = pages.select(F.col(page_id).alias("p"), F.explode(_tables(F.col(html))).alias("t")).select("p", "t.table", F.transform(_rows(F.col("t.own")), _cells).alias("rows"))
    t = t.select("p", "table", "rows", F.array_position(F.transform("rows", lambda x: F.size(x) > 0), True).cast("int").alias("top"))
    t = t.select("p", "table", "rows", "top", F.get("rows", F.col("top") - 1).alias("first"))
    named = F.transform(F.transform(F.transform("first", _inner), _text), lambda x: _names(fields, x))
    t = t.select("p", "table", "rows", "top", F.arrays_zip(_columns(F.col("first")).alias("col"), named.alias("name")).alias("names"))
    # Rows without what is asked for are left out of an array before it is exploded: a condition on columns would compute them twice.
    columns = F.struct(*[F.transform(F.filter("names", lambda x: x["name"] == n), lambda x: x["col"]).alias(n) for n in fields])
    t = t.select("p", "table", "rows", "top", F.explode(F.filter(F.array(columns), lambda x: F.greatest(F.lit(0), *[F.size(x[n]) for n in fields]) > 0)).alias("columns"))
    t = t.select("p", "table", "top", "columns", F.posexplode(F.slice("rows", F.col("top") + 1, F.lit(_ALL))).alias("k", "cells"))
    t = t.select("p", "table", (F.col("top") + F.col("k")).alias("row"), "columns", F.arrays_zip(_columns(F.col("cells")).alias("col"), F.col("cells").alias("cell")).alias("cells"))
    below = lambda n: F.get(F.filter("cells", lambda c: F.array_contains(F.col("columns")[n], c["col"])), F.lit(0))["cell"]
    links = F.filter(F.transform("cells", lambda c: _link(_inner(c["cell"]))), lambda x: x.isNotNull())
    found = F.struct(*[below(n).alias(n) for n in fields], F.get(links, F.lit(0)).alias("_link"))
    t = t.select("p", "table", "row", F.explode(F.filter(F.array(found), lambda x: F.coalesce(*[x[n] for n in fields]).isNotNull())).alias("f"))
    t = t.select("p", "table", "row", *[_inner(F.col("f")[n]).alias(f"_{n}") for n in fields], F.col("f._link").alias("link"))
    return t.select(F.col("p").alias(page_id), "table", "row", *[F.nullif(_text(F.col(f"_{n}")), F.lit("")).alias(n) for n in fields], F.col("link").alias(link))
