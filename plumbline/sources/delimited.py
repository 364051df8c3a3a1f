"""Delimited files: everything is read as text first, then named, cleared of null tokens and typed.

The head of a file names its columns and, if no Layout is given, suggests one; the delimiter and whether quoted cells hold
line breaks are then found over all lines of all files, and the table's width is that of its widest row, over all rows.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Refused
from ..functions.staging import small_side, stage
from ..functions.words import snake
from .multiline import records

PREVIEW_LINES = 200
DELIMITERS = (",", ";", "\t", "|")

NUMBER = re.compile(r"^[-+]?[₹$€£¥]?\s?[\d.,]+\s?%?$")
DATE = re.compile(r"^\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}([ T].*)?$")
PERIOD = re.compile(r"^((19|20)\d{2}([-_ ]?(0?[1-9]|1[0-2]|q[1-4]))?|(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
                    r"[a-z]*[-_ ]?(\d{2}|\d{4})?|q[1-4][-_ ]?(\d{4})?)$", re.I)


@dataclass(frozen=True)
class Layout:
    """How a file is laid out; ``skip`` leading title rows come before the header rows.

    ``multiline``: quoted cells may hold line breaks. Row ends are then found by ``sources.multiline``, a file still read by
    many tasks; only text in UTF-16 or UTF-32 is read by one task per file.
    """

    delimiter: str = ","
    header_rows: int = 1
    skip: int = 0
    names: tuple[str, ...] = ()
    join: str = "underscore"
    fill_header: bool = False
    na_values: tuple[str, ...] = ("",)
    footer: int = 0
    dtypes: dict = field(default_factory=dict)
    encoding: str = "UTF-8"
    multiline: bool = False


def sniff_delimiter(lines: list[str]) -> str:
    """The delimiter that splits the head of the file into the most even, widest rows."""
    return _evenest({d: Counter(line.count(d) for line in lines if line.strip()) for d in DELIMITERS})


def _evenest(counts: dict[str, Counter]) -> str:
    """Of delimiters with the number of lines by how often they hold it."""
    def score(d: str):
        common, n = max(counts[d].items(), key=lambda x: (x[1], x[0]), default=(0, 0))
        return (common > 0, n if common else 0, common)
    return max(DELIMITERS, key=score)


def table_delimiter(spark: SparkSession, path: str) -> str:
    """``sniff_delimiter`` over all lines."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), (F.length("value") - F.length(F.replace("value", F.lit(d), F.lit("")))).alias("n")) for d in DELIMITERS]))
    counts = {d: Counter() for d in DELIMITERS}
    for r in lines.select(each.alias("x")).groupBy("x.d", "x.n").count().collect():
        counts[r["d"]][r["n"]] = r["count"]
    return _evenest(counts)


def table_broken(spark: SparkSession, path: str, delimiter: str) -> bool:
    """Whether any line ends inside a quoted cell. The first one of a table is read from the start of a row, so it is seen."""
    d = re.escape(delimiter)
    cell = rf'(?:"(?:[^"]|"")*+"[^{d}]*+|[^"{d}][^{d}]*+|)'
    whole = re.compile(rf"{cell}(?:{d}{cell})*+")

    def is_open(lines: pd.Series) -> pd.Series:
        return lines.map(lambda line: whole.fullmatch(line) is None).astype(bool)

    quoted = spark.read.text(path).where(F.contains("value", F.lit('"')))
    return not quoted.where(F.pandas_udf(is_open, "boolean")("value")).isEmpty()


def head_lines(spark: SparkSession, path: str, n: int = PREVIEW_LINES) -> list[str]:
    """The first lines of the first file, in file order."""
    first = min(spark.read.text(path).inputFiles())
    return [r[0] for r in spark.read.text(first).limit(n).collect()]


def _options(layout: Layout) -> dict[str, str]:
    return {"sep": layout.delimiter, "encoding": layout.encoding, "header": "false", "quote": '"', "escape": '"',
            "multiLine": str(layout.multiline).lower(), "enforceSchema": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _schema(width: int) -> T.StructType:
    return T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(width)])


def cells(spark: SparkSession, path: str, layout: Layout, width: int) -> DataFrame:
    """Every row as text columns _0.. : quoted cells with their delimiters, doubled quotes and, if so laid out, line breaks."""
    return spark.read.options(**_options(layout)).schema(_schema(width)).csv(path)


def raw(spark: SparkSession, path: str, layout: Layout, width: int) -> DataFrame:
    """``cells`` with their place in the input."""
    if layout.multiline and not layout.encoding.upper().startswith(("UTF-16", "UTF-32")):
        rows = records(spark, path, layout.delimiter, layout.encoding)
        read = F.from_csv("record", ", ".join(f"_{i} string" for i in range(width)),
                          {**{k: v for k, v in _options(layout).items() if k not in ("encoding", "header", "enforceSchema")}, "lineSep": "\n"})
        return rows.select(read.alias("c"), "__file", "__block", "__row").select("c.*", "__file", "__block", "__row")
    return cells(spark, path, layout, width).select(
        "*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__row"))


def survey(spark: SparkSession, path: str, layout: Layout, guess: int = 32) -> tuple[int, DataFrame]:
    """Cells of the widest row, and each file's first row (__file, __first), by one pass (again if all columns were in use)."""
    while True:
        df = raw(spark, path, layout, guess)
        widest = F.max(F.coalesce(*[F.when(F.col(f"_{i}").isNotNull(), i) for i in reversed(range(guess))]))
        # one row per file
        files = stage(df.groupBy("__file").agg(widest.alias("__last"), F.min(F.when(F.col("__block") == 0, F.col("__row"))).alias("__first")))
        last = files.agg(F.max("__last")).first()[0]
        if last is None or last < guess - 1:
            return (last if last is not None else 0) + 1, files.where("__first IS NOT NULL").select("__file", "__first")
        guess *= 4


def table_width(spark: SparkSession, path: str, layout: Layout, guess: int = 32) -> int:
    """Cells of the widest row, over all rows."""
    return survey(spark, path, layout, guess)[0]


def split_line(line: str, delimiter: str) -> list[str]:
    import csv
    return next(csv.reader([line], delimiter=delimiter), [])


def header_names(rows: list[list[str]], join: str = "underscore", fill: bool = False) -> list[str]:
    """Column names from one or more header rows: joined, snake-cased, blanks named, repeats numbered."""
    width = max(len(r) for r in rows)
    rows = [list(r) + [""] * (width - len(r)) for r in rows]
    if fill:
        # a merged group cell names the columns to its right until the next one
        for r in rows[:-1]:
            last = ""
            for i, cell in enumerate(r):
                last = cell.strip() or last
                r[i] = last
    names = []
    for i in range(width):
        parts = [r[i].strip() for r in rows]
        if join == "bottom_only":
            parts = parts[-1:]
        elif join == "top_only":
            parts = parts[:1]
        sep = " " if join == "space" else "_"
        names.append(snake(sep.join(p for p in parts if p)) or f"column_{i + 1}")
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


def looks_like_value(cell: str) -> bool:
    c = cell.strip()
    return bool(NUMBER.match(c) and any(ch.isdigit() for ch in c)) or bool(DATE.match(c))


def guess_layout(lines: list[str], delimiter: str | None = None, broken: bool | None = None) -> Layout:
    """Title rows, header rows and delimiter from the head of a file.

    The first data row is the first with a number or a date in it that is as wide as the table;
    header rows are the filled text rows just above it; anything higher is a title. ``delimiter`` and ``broken`` (quoted
    cells hold line breaks) are taken from these lines unless given.
    """
    d = delimiter or sniff_delimiter(lines)
    if broken is None:
        # a line with an open quote goes on in the next one
        broken = any(line.count('"') % 2 for line in lines)
    rows = [split_line(line, d) for line in lines]
    width = max((len([c for c in r if c.strip()]) for r in rows), default=0)
    first = next((i for i, r in enumerate(rows)
                  if any(looks_like_value(c) for c in r)
                  and len([c for c in r if c.strip()]) >= max(2, width // 2)), None)
    if first is None:
        return Layout(delimiter=d, header_rows=1, multiline=broken)
    top = first
    while top > 0 and len([c for c in rows[top - 1] if c.strip()]) >= 2 and not any(
            looks_like_value(c) for c in rows[top - 1]):
        top -= 1
    return Layout(delimiter=d, header_rows=first - top, skip=top, fill_header=first - top > 1, multiline=broken)


def load(spark: SparkSession, path: str, layout: Layout | None = None, on_error: str = "fail") -> DataFrame:
    """The file as a typed table. ``on_error='null'`` turns an unreadable cell into NULL.

    A row wider than the header gets its surplus cells in columns named by their place; a narrower one ends in NULLs.
    """
    if layout is None:
        lines = head_lines(spark, path)
        if not lines:
            raise Refused("EMPTY_FILE", path)
        delimiter = table_delimiter(spark, path)
        layout = guess_layout(lines, delimiter, table_broken(spark, path, delimiter))
    width, starts = survey(spark, path, layout)
    top = layout.skip + layout.header_rows
    head = []
    if top:
        first = min(spark.read.text(path).inputFiles(), default=None)
        if first is None:
            raise Refused("EMPTY_FILE", path)
        head = [[(c or "").removesuffix("\r") for c in r] for r in cells(spark, first, layout, width).limit(top).collect()]
        if not head:
            raise Refused("EMPTY_FILE", path)
    df = raw(spark, path, layout, width)
    if layout.names:
        names = list(layout.names)
    elif layout.header_rows:
        names = header_names(head[layout.skip:], layout.join, layout.fill_header)
    else:
        names = [f"column_{i + 1}" for i in range(width)]
    names += [f"column_{i + 1}" for i in range(len(names), width)]
    if head:
        df = _without(df, head, starts, width)
    if layout.footer:
        df = drop_footer(df, layout.footer)
    df = df.select(*[F.col(f"_{i}").alias(n) if i < width else F.lit(None).cast("string").alias(n) for i, n in enumerate(names)])
    df = null_tokens(df, layout.na_values)
    return typed(df, layout.dtypes, on_error)


def _without(df: DataFrame, head: list[list[str]], starts: DataFrame, width: int) -> DataFrame:
    """Drop title and header rows where a file begins with them (each part may); rows like them further down stay.

    ``starts``: one row per file, its first row.
    """
    placed = df.join(small_side(starts), "__file", "left").withColumn("__nth", F.col("__row") - F.col("__first"))
    drop = F.lit(False)
    for i, row in enumerate(head):
        same = [F.coalesce(F.col(f"_{k}"), F.lit("")) == F.lit(row[k]) for k in range(width)]
        drop = drop | ((F.col("__block") == 0) & (F.col("__nth") == i) & reduce(lambda a, b: a & b, same))
    return placed.where(~F.coalesce(drop, F.lit(False))).drop("__first", "__nth")


def drop_footer(df: DataFrame, n: int) -> DataFrame:
    """Without the last n rows in file order; only n row positions reach the driver."""
    place = ("__file", "__block", "__row")
    last = df.select(*place).orderBy(*[F.desc(p) for p in place]).limit(n).collect()
    if not last:
        return df
    cut = min(tuple(r) for r in last)
    at = F.struct(*[F.col(p) for p in place])
    edge = F.struct(*[F.lit(v).alias(p) for p, v in zip(place, cut, strict=True)])
    return df.where(at < edge)


def null_tokens(df: DataFrame, tokens) -> DataFrame:
    if not tokens:
        return df
    return df.select(*[F.when(~F.trim(F.col(c)).isin(*tokens), F.col(c)).alias(c) for c in df.columns])


def null_token_counts(df: DataFrame, tokens) -> DataFrame:
    """Per column and token, how many values become NULL; one pass over the cells."""
    narrow = df.select(*[F.trim(F.col(c)).alias(c) for c in df.columns])
    cells = narrow.unpivot([], df.columns, "column", "token")
    return cells.where(F.col("token").isin(*tokens)).groupBy("column", "token").agg(
        F.count("*").alias("rows"))


def typed(df: DataFrame, dtypes: dict[str, str], on_error: str = "fail") -> DataFrame:
    for c in dtypes:
        if c not in df.columns:
            raise Refused("NO_SUCH_COLUMN", c)
    cols = []
    for c in df.columns:
        x = F.col(f"`{c}`")
        if c in dtypes:
            x = x.try_cast(dtypes[c]) if on_error == "null" else x.cast(dtypes[c])
        cols.append(x.alias(c))
    return df.select(*cols)


def coercion_failures(df: DataFrame, dtypes: dict[str, str]) -> DataFrame:
    """Cells each typed column loses, all columns in one aggregate."""
    wide = df.agg(*[F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(k).isNull()).alias(f"n{i}")
                    for i, (c, k) in enumerate(dtypes.items())])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(k).alias("type"), F.col(f"n{i}").alias("failed"))
        for i, (c, k) in enumerate(dtypes.items())])))


TWO_DIGIT = r"^\s*\d{1,2}[/.-]\d{1,2}[/.-]\d{2}\s*$"


def two_digit_years(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns whose dates have two-digit years: they stay text, because a cast reads year first."""
    wide = df.agg(*[F.count_if(F.col(c).rlike(TWO_DIGIT)).alias(f"n{i}") for i, c in enumerate(columns)])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("rows"),
                 (F.col(f"n{i}") > 0).alias("keep_text")) for i, c in enumerate(columns)])))


def huge_integers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns of whole numbers past what a double holds exactly."""
    big = F.lit(float(2 ** 53))
    aggs = []
    for i, c in enumerate(columns):
        x = F.col(c)
        aggs += [F.count_if(x.isNotNull() & ~F.trim(x).rlike(r"^[-+]?[0-9]+$")).alias(f"o{i}"),
                 F.count_if(F.abs(x.try_cast("double")) >= big).alias(f"b{i}")]
    wide = df.agg(*aggs)
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"b{i}").alias("beyond_double"),
                 ((F.col(f"o{i}") == 0) & (F.col(f"b{i}") > 0)).alias("exact_integer"))
        for i, c in enumerate(columns)])))


def exact_integer(c: Column) -> Column:
    return F.trim(c).try_cast("decimal(38,0)")


def drop_trailing_empty(df: DataFrame) -> DataFrame:
    """Without the unnamed, entirely empty columns at the right edge."""
    unnamed = [c for c in df.columns if re.fullmatch(r"column_\d+", c)]
    if not unnamed:
        return df
    held = df.agg(*[F.count(c).alias(c) for c in unnamed]).first()
    keep = list(df.columns)
    while keep and keep[-1] in unnamed and held[keep[-1]] == 0:
        keep.pop()
    return df.select(*keep)


def period_columns(columns: list[str]) -> list[str]:
    """Columns named like periods, if there are enough of them to be a report laid out wide."""
    named = [c for c in columns if PERIOD.match(c.strip())]
    return named if len(named) >= 3 and len(named) >= 0.5 * len(columns) else []


def unpivot_periods(df: DataFrame, value: str = "value") -> DataFrame:
    """A wide report as (ids, period, value) rows; refused when the columns are not periods."""
    periods = period_columns(df.columns)
    if not periods:
        raise Refused("NOT_A_WIDE_REPORT", "fewer than half of the columns are named like periods")
    ids = [c for c in df.columns if c not in periods]
    return df.unpivot(ids, periods, "period", value)


def to_utc(df: DataFrame, column: str, zone: str) -> DataFrame:
    """A local timestamp with a known zone as a UTC timestamp without one."""
    return df.withColumn(column, F.convert_timezone(F.lit(zone), F.lit("UTC"), F.col(column)))
