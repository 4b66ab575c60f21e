"""CSV with inferred types.

The default reader is Spark's own, told to read every cell as text; one aggregation over
the cells decides types and nullability, and typed columns are casts of the text. Before
it, one pass over the lines finds out whether files can be split (no cell holds a line
break), which record has a wrong number of fields, and whether quotes stand where Spark's
reader would take them otherwise than this engine does. The strict reader, which is taken
in that case, tokenises whole files itself: quotes may open inside a cell, a blank line is a
record, and errors know their record.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.errors import CsvError, SourceIOError, translating
from quillon.functions import casts
from quillon.operators.frame import Frame
from quillon.plans.types import LField, LSchema, LType

#: Stands for an absent cell while Spark reads, as its reader cannot tell it from others.
_ABSENT = "\x00absent\x00"


@dataclass(frozen=True)
class CsvOptions:
    """How a CSV source is read.

    ``infer_rows`` bounds the rows that decide types (None: all); nulls are looked for in
    every row. ``multi_line`` lets cells hold line breaks, at the price of one task for a
    file; None finds out whether any does. ``strict`` takes the strict reader in any case.
    """

    has_header: bool = True
    delimiter: str = ","
    null_literal: str = ""
    infer_rows: int | None = None
    multi_line: bool | None = None
    strict: bool = False


def records_of(data: str, delimiter: str = ",") -> Iterator[list[str]]:
    """Records of a text: quotes may open and close anywhere in a cell and double inside quotes.

    A carriage return before a line's end goes; a last line needs no end, and an open quote
    ends with the text.
    """
    mark = re.compile(f'["\n{re.escape(delimiter)}]')
    cells: list[str] = []
    cell: list[str] = []
    at = 0
    while True:
        found = mark.search(data, at)
        stop = found.start() if found else len(data)
        cell.append(data[at:stop])
        at = stop + 1
        if found and found[0] == '"':
            close = data.find('"', at)
            while close >= 0 and data[close + 1 : close + 2] == '"':
                cell.append(data[at : close + 1])
                at = close + 2
                close = data.find('"', at)
            cell.append(data[at:] if close < 0 else data[at:close])
            at = len(data) if close < 0 else close + 1
            continue
        text = "".join(cell)
        cell = []
        if found and found[0] == delimiter:
            cells.append(text)
            continue
        if found or cells or text:
            yield [*cells, text.removesuffix("\r")]
        if not found:
            return
        cells = []


def read_csv(spark: SparkSession, path: str, options: CsvOptions = CsvOptions()) -> Frame:
    """A CSV file, or several of one header, as a frame."""
    with translating():
        if options.strict:
            return _strict(spark, path, options)
        reader = spark.read.options(sep=options.delimiter, quote='"', escape='"', multiLine=options.multi_line is not False, mode="FAILFAST", nullValue=_ABSENT, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        raw = reader.csv(path)
        if not raw.columns:
            return Frame(spark.createDataFrame([], LSchema([]).spark), LSchema([]))
        head = raw.first()
        names = _names(head, len(raw.columns), options)
        if options.multi_line is None:
            seen = _looked_through(spark, path, options, len(names))
            if seen.unusual or seen.blank and len(names) == 1:
                return _strict(spark, path, options)
            reader = reader.option("multiLine", bool(seen.open))
        text = LSchema([LField(n, LType.UTF8) for n in names])
        cells = reader.option("header", options.has_header).schema(text.spark).csv(path)
        place = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]
        sample = cells if options.infer_rows is None else cells.orderBy(*place).limit(options.infer_rows)
        typed = lambda df: df.select(*[_cell(i, n, options).alias(n) for i, n in enumerate(names)])
        return _typed(typed(cells), names, options, F.lit(0), typed(sample))


def read_csv_text(spark: SparkSession, data: str, options: CsvOptions = CsvOptions()) -> Frame:
    """A CSV text that the caller holds, read strictly."""
    found = list(records_of(data, options.delimiter))
    if not found:
        return Frame(spark.createDataFrame([], LSchema([]).spark), LSchema([]))
    names = _names(found[0], len(found[0]), options)
    rows = found[options.has_header :]
    first = 1 + options.has_header
    for i, r in enumerate(rows):
        if len(r) != len(names):
            raise CsvError(i + first, f"expected {len(names)} fields, found {len(r)}")
    schema = LSchema([LField(n, LType.UTF8) for n in names]).spark.add("record", "long")
    place = "record"
    while place in names:
        place += "_"
    schema.fields[-1].name = place
    schema.names[-1] = place
    cells = spark.createDataFrame([(*[None if c == options.null_literal else c for c in r], i + first) for i, r in enumerate(rows)], schema)
    return _typed(cells, names, options, F.col(place))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of files with the place of each: file, block of the file, and number within Spark's partition."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.regexp_replace("value", r"\r\z", "").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))


def _looked_through(spark: SparkSession, path: str, options: CsvOptions, n: int):
    """Whether some line leaves a quote open, is blank, or has quotes inside a cell; a CsvError if one has another number of fields than n."""
    sep = re.escape(options.delimiter)
    quotes = F.length("line") - F.length(F.translate("line", '"', ""))
    cell = rf'(?:[^"{sep}]*+|"(?:[^"]|"")*+")'
    usual = F.col("line").rlike(rf"\A{cell}(?:{sep}{cell})*+\z")
    own = F.size(F.regexp_extract_all(F.concat("line", F.lit(options.delimiter)), F.lit(rf'[^"{sep}]*+(?:"[^"]*+"[^"{sep}]*+)*+{sep}'), F.lit(0)))
    fields = F.when(quotes > 0, own).otherwise(F.length("line") - F.length(F.translate("line", options.delimiter, "")) + 1)
    lines = _lines(spark, path).withColumns({"quotes": quotes, "fields": fields})
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    wrong = F.col("fields") != n
    seen = lines.agg(any_(F.col("quotes") % 2 == 1).alias("open"), any_((F.col("quotes") > 0) & ~usual).alias("unusual"), any_(F.col("line") == "").alias("blank"), any_(wrong).alias("ragged")).first()
    if seen.ragged and not seen.open:
        first = lines.where(wrong).agg(F.min(F.struct("file", "block", "at", "fields")).alias("x")).first().x
        # Blocks of one file before it, and lines of its own block before it.
        before = (F.col("file") == first.file) & ((F.col("block") < first.block) | (F.col("block") == first.block) & (F.col("at") < first.at))
        raise CsvError(lines.where(before).count() + 1, f"expected {n} fields, found {first.fields}")
    return seen


def _names(head, n: int, options: CsvOptions) -> list[str]:
    names = [("" if c is None or c == _ABSENT else c) for c in head] if options.has_header else [f"col_{i}" for i in range(n)]
    return LSchema([LField(c, LType.UTF8) for c in names]).names


def _cell(i: int, name: str, options: CsvOptions) -> Column:
    return F.nullif(F.coalesce(F.col("`" + name.replace("`", "``") + "`"), F.lit("")), F.lit(options.null_literal))


def _strict(spark: SparkSession, path: str, options: CsvOptions) -> Frame:
    """Whole files through ``records_of``; a task holds one file."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    first = files.orderBy("path").first()
    try:
        head = next(records_of(first.content.decode("utf-8"), options.delimiter), None) if first else None
    except UnicodeDecodeError as error:
        raise SourceIOError(f"{path} is not UTF-8: {error}") from error
    if not head:
        return Frame(spark.createDataFrame([], LSchema([]).spark), LSchema([]))
    names = _names(head, len(head), options)
    n, header, delimiter = len(names), int(options.has_header), options.delimiter

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = list(records_of(bytes(content).decode("utf-8"), delimiter))[header:]
                yield pd.DataFrame({"record": range(1 + header, 1 + header + len(rows)), "cells": pd.Series(rows, dtype=object)})

    made = files.mapInPandas(split, "record long, cells array<string>")
    wrong = F.when(F.size("cells") != n, casts.fail("CSV", F.concat(F.col("record").cast("string"), F.lit(f":expected {n} fields, found "), F.size("cells").cast("string"))))
    place = "record"
    while place in names:
        place += "_"
    cells = made.select(*[F.coalesce(wrong, F.nullif(F.col("cells")[i], F.lit(options.null_literal))).alias(c) for i, c in enumerate(names)], F.col("record").alias(place))
    return _typed(cells, names, options, F.col(place))


def _typed(cells: DataFrame, names: list[str], options: CsvOptions, record: Column, sample: DataFrame | None = None) -> Frame:
    """Types by what the cells are, in one pass: Boolean, else Int64, else Float64, else Utf8.

    ``sample`` has the records that decide types, the first ones, if not all do.
    """
    quoted = ["`" + n.replace("`", "``") + "`" for n in names]
    no = F.lit(None)
    kinds = {LType.BOOLEAN: casts.text_to_bool, LType.INT64: casts.text_to_int, LType.FLOAT64: casts.text_to_float}
    holes = [F.coalesce(F.bool_or(F.col(q).isNull()), F.lit(False)).alias(f"n{i}") for i, q in enumerate(quoted)]
    fits = [F.bool_and(F.when(F.col(q).isNotNull(), to(F.col(q), no).isNotNull())).alias(f"{k.value}{i}") for i, q in enumerate(quoted) for k, to in kinds.items()]
    if options.infer_rows is None:
        nulls = seen = cells.agg(*holes, *fits).first()
    else:
        nulls = cells.agg(*holes).first()
        first = cells.orderBy(record).limit(options.infer_rows) if sample is None else sample
        seen = first.agg(*fits).first()
    fields, columns = [], []
    for i, (n, q) in enumerate(zip(names, quoted, strict=True)):
        kind = next((k for k in kinds if seen[f"{k.value}{i}"]), LType.UTF8)
        evidence = seen[f"{LType.INT64.value}{i}"] is not None
        fields.append(LField(n, kind, nulls[f"n{i}"] or not evidence))
        if kind is LType.UTF8:
            columns.append(F.col(q))
            continue
        wrong = casts.fail("CSV", F.concat(record.cast("string"), F.lit(":cannot parse '"), F.col(q), F.lit(f"' as {kind}"))).cast(kind.spark)
        columns.append(F.when(F.col(q).isNull(), F.lit(None).cast(kind.spark)).otherwise(kinds[kind](F.col(q), wrong)).alias(n))
    return Frame(cells.select(*columns), LSchema(fields))
