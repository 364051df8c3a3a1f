"""Delimited files whose quoted cells hold line breaks, read by many tasks.

No line tells by itself whether it starts a row: that depends on whether a quote is open before it. Files are therefore read
as lines, in the byte ranges Spark deals out, three times:

* every range is run through once for either answer, and tells in which state it ends (a transition of two states);
* composing the transitions of a file's ranges in order, one row per range, fixes the state in which each range starts;
* ranges are then cut at true row ends, by as many tasks as there are ranges. Only a row that crosses from one range into
  the next is moved: its parts are put together by file and range.

Quoting is that of RFC 4180: a cell that begins with a quote ends at the next single one, doubled quotes stand for one; what
follows a closing quote up to the delimiter belongs to the cell; a quote inside a cell that doesn't begin with one is a
character like others. A quote still open at a file's end ends there. Blank lines between rows are no rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORD = "__file string, __block long, __row long, record string"


class Quotes:
    """What a line does to the state: False between rows, True inside a quoted cell."""

    def __init__(self, delimiter: str):
        d = re.escape(delimiter)
        cell = rf'(?:"(?:[^"]|"")*+"[^{d}]*+|[^"{d}][^{d}]*+|)'
        self._whole = re.compile(rf"{cell}(?:{d}{cell})*+", re.S)
        self._rest = re.compile(rf'(?:[^"]|"")*+"[^{d}]*+(?:{d}{cell})*+', re.S)

    def after(self, line: str, inside: bool) -> bool:
        if '"' not in line:
            return inside
        return (self._rest if inside else self._whole).fullmatch(line) is None


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """value, __file, __block: lines in file order within each range; a carriage return before the break stays."""
    rows = spark.read.option("lineSep", "\n").text(path)
    value = F.col("value") if encoding.upper() in ("UTF-8", "UTF8") else F.decode(F.col("value").cast("binary"), encoding)
    return rows.select(value.alias("value"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"))


def _ranges(batches):
    """(file, block, lines) per batch, cut where the range changes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        files, blocks = batch.column(1), batch.column(2)
        change = pc.or_(pc.not_equal(files[1:], files[:-1]), pc.not_equal(blocks[1:], blocks[:-1])).to_numpy(zero_copy_only=False)
        edges = [0, *(change.nonzero()[0] + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield files[a].as_py(), blocks[a].as_py(), batch.column(0).slice(a, b - a)


def transitions(spark: SparkSession, path: str, delimiter: str, encoding: str = "UTF-8") -> DataFrame:
    """One row per range: __file, __block, and for a start outside and inside of quotes (index 0, 1): ``ends`` (the state at
    the end), ``head`` (lines before the first that starts a row), ``last`` (the line that starts the last row, -1: none; exact
    where the range ends inside), ``prior`` (rows before that one)."""
    quotes = Quotes(delimiter)

    def run(batches):
        at, state, head, last, prior, rows, n = None, None, None, None, None, None, 0

        def row():
            return pa.RecordBatch.from_pylist([{"__file": at[0], "__block": at[1], "ends": state, "head": head, "last": last, "prior": prior}], schema=schema)

        schema = pa.schema([("__file", pa.string()), ("__block", pa.int64()), ("ends", pa.list_(pa.bool_())),
                            *((c, pa.list_(pa.int64())) for c in ("head", "last", "prior"))])
        for file, block, lines in _ranges(batches):
            if at != (file, block):
                if at is not None:
                    yield row()
                at, state, n = (file, block), [False, True], 0
                head, last, prior, rows = [0, 0], [-1, -1], [0, 0], [0, 0]
            # lines without a quote keep the state; only the others are looked at
            quoted = pc.match_substring(lines, '"').to_numpy(zero_copy_only=False).nonzero()[0].tolist()
            filled = [0, *pc.cumulative_sum(pc.not_equal(pc.utf8_trim_whitespace(lines), "").cast(pa.int64())).to_pylist()]
            before = 0
            for i in [*quoted, len(lines)]:
                for k in (0, 1):
                    if not state[k]:  # each of the lines up to here starts a row
                        if i > before:
                            last[k] = n + i - 1
                            rows[k] += filled[i] - filled[before]
                    elif last[k] < 0:
                        head[k] += i - before
                if i == len(lines):
                    break
                line = lines[i].as_py()
                for k in (0, 1):
                    if not state[k]:
                        last[k], prior[k], rows[k] = n + i, rows[k], rows[k] + 1
                    elif last[k] < 0:
                        head[k] += 1
                    state[k] = quotes.after(line, state[k])
                before = i + 1
            n += len(lines)
        if at is not None:
            yield row()

    return _lines(spark, path, encoding).mapInArrow(run, "__file string, __block long, ends array<boolean>, head array<long>, last array<long>, prior array<long>")


def started(ranges: DataFrame) -> DataFrame:
    """``ranges`` with ``inside``: the state in which each starts, by composing those before it in its file."""
    before = Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    # ends of a state: the two transitions either forget their start (both alike), keep it, or turn it around. What counts is
    # the last range that forgets, and whether an odd number of turns came after it
    forgets, turns = F.col("ends")[0] == F.col("ends")[1], (F.col("ends")[0] & ~F.col("ends")[1]).cast("long")
    rows = ranges.withColumns({"__turns": F.coalesce(F.sum(turns).over(before), F.lit(0))})
    known = F.last(F.when(forgets, F.struct(F.col("ends")[0].cast("long").alias("state"), F.col("__turns").alias("turns"))), True).over(before)
    return rows.withColumn("__known", known).select(
        "__file", "__block", "ends", "head", "last", "prior",
        ((F.coalesce("__known.state", F.lit(0)) + F.col("__turns") - F.coalesce("__known.turns", F.lit(0))) % 2 == 1).alias("inside"))


def records(spark: SparkSession, path: str, delimiter: str, encoding: str = "UTF-8") -> DataFrame:
    """__file, __block, __row, record: the text of every row, placed where it starts (``__row`` counts within the range)."""
    quotes = Quotes(delimiter)
    ranges = {(r["__file"], r["__block"]): (r["inside"], *(r[c][r["inside"]] for c in ("head", "last", "ends", "prior")))
              for r in started(transitions(spark, path, delimiter, encoding)).collect()}  # a row per range, never per line
    lines = _lines(spark, path, encoding)

    def known(at):
        if at not in ranges:
            raise RuntimeError("ranges changed between passes: set spark.sql.files.minPartitionNum to a fixed number")
        return ranges[at]

    def text(parts: list[str], block: int, first: bool) -> str:
        whole = "\n".join(parts)
        whole = whole[:-1] if whole.endswith("\r") else whole
        return whole.removeprefix("\ufeff") if first and block == 0 else whole

    def cut(batches):
        """Rows that lie inside one range."""
        at, n, row, parts, inside, out = None, 0, 0, [], False, []
        for file, block, values in _ranges(batches):
            if at != (file, block):
                at, n, row, parts = (file, block), 0, 0, []
                state, head, last, open_, prior = known(at)
                inside = False
            for line in values.to_pylist():
                if n >= head and not (open_ and n >= last):
                    if line or inside:
                        parts.append(line)
                        inside = quotes.after(line, inside)
                    if not inside and parts:
                        record = text(parts, block, row == 0)
                        if record.strip():
                            out.append((file, block, row, record))
                            row += 1
                        parts = []
                n += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.string()))],
                                                 names=["__file", "__block", "__row", "record"])
                out = []

    whole = lines.mapInArrow(cut, RECORD)
    crossing = {k for k, v in ranges.items() if v[0] or v[3]}
    if not crossing:
        return whole

    def edges(batches):
        """The lines of a range that belong to a row crossing one of its ends: ``side`` 0 at its start, 1 at its end."""
        at, n = None, 0
        for file, block, values in _ranges(batches):
            if at != (file, block):
                at, n = (file, block), 0
                state, head, last, open_, prior = known(at)
                first = last if open_ and last >= 0 else None
            a, b = n, n + len(values)
            for side, low, high in ((0, 0, head), (1, first if first is not None else b, b)):
                low, high = max(low, a), min(high, b)
                if low < high:
                    kept = values.slice(low - a, high - low).to_pylist()
                    yield pa.RecordBatch.from_pylist([{"__file": file, "__block": block, "side": side, "line": low, "row": prior, "record": "\n".join(kept)}])
            n = b

    parts = lines.mapInArrow(edges, "__file string, __block long, side long, line long, row long, record string")
    # a row per range end: whose row it continues
    place = Window.partitionBy("__file").orderBy("__block", "side", "line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owned = parts.withColumn("owner", F.last(F.when(F.col("side") == 1, F.col("__block")), True).over(place))
    # the parts of one row
    joined = owned.groupBy("__file", "owner").agg(F.array_sort(F.collect_list(F.struct("__block", "side", "line", "row", "record"))).alias("parts"))
    record = F.regexp_replace(F.array_join(F.transform("parts", lambda p: p["record"]), "\n"), r"\r\z", "")
    record = F.when(F.col("owner") == 0, F.regexp_replace(record, r"\A\x{FEFF}", "")).otherwise(record)
    stitched = joined.select("__file", F.col("owner").alias("__block"), F.element_at("parts", 1)["row"].alias("__row"), record.alias("record"))
    return whole.unionByName(stitched.where(F.trim("record") != ""))
