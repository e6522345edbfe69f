"""Sources beyond Spark's own formats: other character sets, nested series, front matter, HTML tables, feeds, two-row headers."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import text
from ..operators import relational
from . import tables

SERIES = "results array<struct<data: array<struct<period: string, ratio: double>>>>"


def read_csv(spark: SparkSession, path: str, schema: StructType | str, sep: str = ",") -> DataFrame:
    """CSV (or delimited text) with a header and a declared schema; malformed numbers raise."""
    return spark.read.schema(schema).csv(path, header=True, sep=sep, mode="FAILFAST", encoding="UTF-8")


def read_csv_in(spark: SparkSession, path: str, schema: str, encoding: str = "cp949", multiline: bool = False) -> DataFrame:
    """CSV with a header in a character set that Spark does not read, of files of any size.

    Spark splits files and cells as bytes (Latin-1), which suits every set in which commas, quotes and line ends are no
    part of a longer character, as in CP949 and Shift JIS; Python then decodes batches of cells. Bytes that are not of
    the set raise; empty fields are null. With `multiline`, quoted cells may hold line ends (see quoted_records).
    """
    if encoding.lower().replace("-", "").startswith(("utf16", "utf32")):
        raise ValueError("Spark reads UTF-16 and UTF-32 itself: use read_csv")
    target = spark.createDataFrame([], schema).schema
    texts = StructType([StructField(f.name, StringType()) for f in target])
    if multiline:
        told = F.decode("record", "ISO-8859-1")
        options = {"escape": '"', "mode": "FAILFAST", "maxCharsPerColumn": "-1"}
        raw = quoted_records(spark, path).where("number > 1").select(F.from_csv(told, F.lit(texts.simpleString()[7:-1].replace(":", " ")), options).alias("r")).select("r.*")
        raw = raw.toDF(*[f.name for f in target])
    else:
        raw = spark.read.schema(texts).csv(path, header=True, encoding="ISO-8859-1", escape='"', enforceSchema=True, mode="FAILFAST")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.map(lambda v: v.encode("latin-1").decode(encoding) if v else None)

    return raw.mapInPandas(decode, texts).select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in target])


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """file, number (from 1), record binary: the records of delimited files whose quoted cells may hold line ends.

    A line begins a record where the quotes before it in its file are even in number. Each split counts its own; the
    counts, a row a split, are summed up, so that a split knows whether it starts inside quotes, and where. Within a
    split, lines are numbered and put together as they were read; a record that splits share is put together at the end,
    where its lines meet. Files are read where they are cut, at any byte, and never as a whole.
    """
    raw = spark.read.text(path, lineSep="\n")
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line")]
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = raw.select(*at, F.col("value").cast("binary").alias("value"), quotes.alias("quotes"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("file", "split").agg(F.sum("quotes").alias("quotes")).select("file", "split", F.coalesce(F.sum("quotes").over(before), F.lit(0)).alias("outside"))
    so_far = Window.partitionBy("file", "split").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.withColumn("within", F.coalesce(F.sum("quotes").over(so_far), F.lit(0))).join(splits, ["file", "split"])
    begins = placed.withColumn("begins", ((F.col("within") + F.col("outside")) % 2 == 0).cast("long"))
    starts = begins.groupBy("file", "split").agg(F.sum("begins").alias("begins")).select("file", "split", F.coalesce(F.sum("begins").over(before), F.lit(0)).alias("earlier"))
    own = Window.partitionBy("file", "split").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    numbered = begins.withColumn("own", F.sum("begins").over(own)).join(starts, ["file", "split"]).select("file", "split", "line", "value", (F.col("own") + F.col("earlier")).alias("number"))
    parts = numbered.groupBy("file", "number").agg(F.sort_array(F.collect_list(F.struct("split", "line", "value"))).alias("parts"))
    whole = F.aggregate("parts", F.lit(None).cast("binary"), lambda all_, p: F.when(all_.isNull(), p["value"]).otherwise(F.concat(all_, F.lit(b"\n"), p["value"])))
    # a line end of two characters ends records with the first of them
    record = F.when(F.substring(whole, -1, 1) == F.lit(b"\r"), F.substring(whole, F.lit(1), F.length(whole) - 1)).otherwise(whole)
    return parts.select("file", "number", record.alias("record")).where(F.length("record") > 0)


def price_history(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, symbol: str | None = None) -> DataFrame:
    """Date, Open, High, Low, Close, Volume of landed daily prices (CSV) from `start` to `end`, both included.

    Bounds that are None are open; the end is a parameter, not the clock. With `symbol`, the files have a column Symbol
    first, and only its rows are read. A malformed date or number raises.
    """
    columns = "Date date, Open double, High double, Low double, Close double, Volume long"
    df = read_csv(spark, path, columns if symbol is None else f"Symbol string, {columns}")
    if symbol is not None:
        df = df.where(F.col("Symbol") == symbol).drop("Symbol")
    if start is not None:
        df = df.where(F.col("Date") >= F.lit(start).cast("date"))
    return df if end is None else df.where(F.col("Date") <= F.lit(end).cast("date"))


def read_two_row_header(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """CSV export of a sheet whose first two rows are headers: unique names are given, and both rows are left out.

    The rows are told by their content: those of the header name no number in the last column.
    """
    df = spark.read.csv(path, header=False).toDF(*names)
    return df.where(F.col(names[-1]).try_cast("double").isNotNull())


def sheet_rows(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """file, row_no, cells: the rows of one sheet, by name or else the first, of Excel workbooks (see tables.sheet_rows).

    Spark fetches the workbooks from any store that it reads; a workbook, which holds 1,048,576 rows at most, is one task's.
    """
    books = spark.read.format("binaryFile").load(path).select(_file_name(), "content")
    return books.lateralJoin(tables.sheet_rows()(F.col("content").outer(), F.lit(sheet))).select("file", "row_no", "cells")


def read_excel(spark: SparkSession, path: str, schema: StructType | str, sheet: str | None = None, header_rows: int = 1) -> DataFrame:
    """The rows below `header_rows` of one sheet, cells by position under the names and types of `schema`.

    Null cells and those that a row lacks are null; a cell that is not of its type raises. Cells beyond the schema are
    left out.
    """
    target = spark.createDataFrame([], schema).schema
    rows = sheet_rows(spark, path, sheet).where(F.col("row_no") > header_rows)
    return rows.select(*[F.get("cells", F.lit(i)).cast(f.dataType).alias(f.name) for i, f in enumerate(target)])


def excel_header(spark: SparkSession, path: str, sheet: str | None = None) -> list[str]:
    """Names of the columns of a sheet's first row: one that repeats gets .1, .2 …, one that is empty its place."""
    row, seen, out = sheet_rows(spark, path, sheet).where("row_no = 1").select("cells").first(), {}, []
    for i, name in enumerate(row["cells"] if row else []):
        name = f"Unnamed: {i}" if name is None else name
        seen[name] = seen.get(name, -1) + 1
        out.append(f"{name}.{seen[name]}" if seen[name] else name)
    return out


def excel_columns(spark: SparkSession, path: str, names: Mapping[str, str], sheet: str | None = None, header_rows: int = 1) -> DataFrame:
    """Columns of a sheet picked by the names that excel_header gives, as texts under new names (old: new)."""
    header = excel_header(spark, path, sheet)
    rows = sheet_rows(spark, path, sheet).where(F.col("row_no") > header_rows)
    return rows.select(*[F.get("cells", F.lit(header.index(old))).alias(new) for old, new in names.items()])


def school_results(spark: SparkSession, path: str, fixes: Mapping[str, tuple[str, str]] = {}, sheet: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """region, school, code, graduates, science, language, total, city, district of a two-row-header table of graduates.

    A CSV export has these six columns in order. Of a workbook, `columns` names those of a sheet as excel_header does, in
    the same order; what stands there in place of a number is null. total is null where one of its parts is. city is the
    region's first word, shortened, and district its second; `fixes` sets both for a school's code. A region that is null
    leaves them null.
    """
    names = ["region", "school", "code", "graduates", "science", "language"]
    if columns is None:
        df = read_two_row_header(spark, path, names)
    else:
        df = excel_columns(spark, path, dict(zip(columns, names, strict=True)), sheet, header_rows=2)
    df = df.withColumns({n: F.col(n).try_cast("double") for n in names[3:]}).withColumn("total", relational.total(F.col("science"), F.col("language")))
    df = df.withColumn("city", text.shorten_region(text.token(F.col("region"), 0))).withColumn("district", text.token(F.col("region"), 1))
    for at, column in enumerate(("city", "district")):
        df = relational.patch(df, "code", column, {code: fix[at] for code, fix in fixes.items()})
    return df


def empty_frame(spark: SparkSession, schema: StructType | str) -> DataFrame:
    """No rows, of a schema that is named: for a union that rows are appended to."""
    return spark.createDataFrame([], schema)


def json_series(df: DataFrame, column: str, group: int | None = 0) -> DataFrame:
    """period date, ratio of {"results": [{"data": [{period, ratio}, …]}, …]}: the series of one group of `results`.

    `group` is its place from 0, the first by default; None gives those of all groups, with their place as `group`.
    Malformed JSON and a place that is not there give no rows; a malformed date raises.
    """
    results = df.select(F.from_json(column, SERIES)["results"].alias("r"))
    if group is None:
        rows = results.select(F.posexplode("r").alias("group", "x")).select("group", F.inline("x.data"))
    else:
        rows = results.select(F.inline(F.get("r", F.lit(group))["data"]))
    return rows.withColumn("period", F.to_date("period", "yyyy-MM-dd"))


def zip_series(df: DataFrame, period: str, first: str, second: str) -> DataFrame:
    """Rows of arrays of equal length, zipped by position."""
    return df.select(F.inline(F.arrays_zip(F.col(period).alias("period"), F.col(first).alias("first"), F.col(second).alias("second"))))


def html_tables(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, table_no, row_no, cells: the grids of all tables of each page, numbered from 0, spanned cells in every place
    that they span (see tables.html_rows). Null pages have none."""
    rows = pages.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{html}`").alias("_html"))
    found = rows.lateralJoin(tables.html_rows()(F.col("_html").outer()))
    return found.select(F.col("_key").alias(key), "table_no", "row_no", "cells")


def _file_name() -> Column:
    """The name of the file that a row comes from; Spark has it percent-encoded, with plus signs as they are."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))).alias("file")


def _yaml_scalar(head: str, name: str) -> Column:
    """Value of `name:` at the start of a line: quoted, or plain up to a comment; null where absent or empty."""
    line = rf"""(?m)^[ \t]*{name}:[ \t]*(?:"([^"\n]*)"|'((?:[^'\n]|'')*)'|([^\n]*?))(?:[ \t]+#[^\n]*)?[ \t]*$"""
    double, single, plain = (F.regexp_extract(head, line, k) for k in (1, 2, 3))
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in (double, F.replace(single, F.lit("''"), F.lit("'")), plain)])


def _unquoted(item: Column) -> Column:
    """An entry of a list without white space, a comment behind it, and the quotes around it."""
    bare = F.trim(F.regexp_replace(item, r"""\A\s*("[^"]*"|'[^']*'|.*?)(?:\s+#.*)?\s*\z""", "$1"))
    return F.regexp_replace(bare, r"""\A(["'])(.*)\1\z""", "$2")


def front_matter(spark: SparkSession, path: str) -> DataFrame:
    """Markdown posts with YAML front matter: file, layout, title, date, excerpt, tags, comments, project, body.

    Scalars, inline lists and lists of a line an entry are read, as posts use them, quoted or plain, without the comments
    behind them; a quoted entry may hold a comma. Keys that are absent are null, and text without front matter is body
    alone. `file` is the file's own name, blanks and all.
    """
    raw = spark.read.text(path, wholetext=True).select(_file_name(), F.col("value"))
    head = F.regexp_extract("value", r"(?s)\A---\s*\n(.*?)\n---\s*(?:\n|\z)", 1)
    df = raw.select("file", head.alias("head"), F.regexp_replace("value", r"(?s)\A---\s*\n.*?\n---\s*(?:\n|\z)", "").alias("body"))
    scalar = lambda name: _yaml_scalar("head", name)
    inline = F.regexp_extract("head", r"""(?m)^tags?:[ \t]*\[((?:"[^"\n]*"|[^\]"\n])*)\]""", 1)
    entries = F.regexp_extract_all(inline, F.lit(r"""\s*("[^"]*"|'[^']*'|[^,]+)\s*(?:,|$)"""), F.lit(1))
    block = F.regexp_extract("head", r"(?m)^tags?:[ \t]*\n((?:[ \t]*-[ \t]*.*(?:\n|\z))+)", 1)
    lines = F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]*-[ \t]*(.*?)[ \t]*$"), F.lit(1))
    tags = F.when(inline != "", entries).when(block != "", lines).otherwise(F.array().cast("array<string>"))
    return df.select(
        "file", scalar("layout").alias("layout"), scalar("title").alias("title"), F.to_date(F.substring(scalar("date"), 1, 10)).alias("date"), scalar("excerpt").alias("excerpt"),
        F.transform(tags, _unquoted).alias("tags"), (scalar("comments") == "true").alias("comments"), (scalar("project") == "true").alias("project"), "body",
    )


def yaml_table(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """file, place and the named columns of YAML files that hold a list of flat mappings, an entry a row from place 0.

    Keys that an entry lacks are null. Comments and the order of keys do no harm; nested values are not read.
    """
    raw = spark.read.text(path, wholetext=True).select(_file_name(), F.split("value", r"(?m)^-[ \t]+", -1).alias("parts"))
    rows = raw.select("file", F.posexplode(F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 1, F.lit(0)))).alias("place", "entry"))
    return rows.select("file", "place", *[_yaml_scalar("entry", n).alias(n) for n in names])


def yaml_entries(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, place, path, value: every scalar of each YAML text, nested keys and list entries by dots (see tables.yaml_rows)."""
    rows = texts.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    return rows.lateralJoin(tables.yaml_rows()(F.col("_text").outer())).select(F.col("_key").alias(key), "place", "path", "value")


def yaml_settings(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """file and a column for each of `names` (paths by dots, as "markdown.auto_ids") of YAML files; null where absent."""
    raw = spark.read.text(path, wholetext=True).select(_file_name(), "value")
    entries = yaml_entries(raw, "file", "value")
    made = entries.groupBy("file").agg(*[F.max(F.when(F.col("path") == n, F.col("value"))).alias(n) for n in names])
    return raw.select("file").join(made, "file", "left")


def yaml_records(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """file, place and the named columns of YAML files that hold a list of mappings, nested keys by dots."""
    entries = yaml_entries(spark.read.text(path, wholetext=True).select(_file_name(), "value"), "file", "value")
    parts = entries.withColumns({"_at": F.substring_index("path", ".", 1), "_key": F.expr("substring(path, locate('.', path) + 1)")})
    made = parts.where(F.col("_at").rlike(r"^\d+$")).groupBy("file", F.col("_at").cast("int").alias("place"))
    return made.agg(*[F.max(F.when(F.col("_key") == n, F.col("value"))).alias(n) for n in names])


def feed_entries(spark: SparkSession, path: str) -> DataFrame:
    """title, link, published of the items of a landed RSS file."""
    return spark.read.schema("title string, link string, pubDate string").format("xml").option("rowTag", "item").load(path).select("title", "link", F.col("pubDate").alias("published"))


def checked_body(responses: DataFrame) -> DataFrame:
    """Landed responses (code, body): the bodies, decoded; a row whose code is not 200 raises."""
    ok = F.when(F.col("code") == 200, F.decode("body", "UTF-8")).otherwise(F.raise_error(F.concat(F.lit("request failed: "), F.col("code").cast("string"))))
    return responses.select(ok.alias("body"))
