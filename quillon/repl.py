"""A prompt for queries over CSV files: table ``t`` is ``t.csv`` in the working folder."""

from __future__ import annotations

import sys
import time
from pathlib import Path
from typing import TextIO

from pyspark.sql import SparkSession

from quillon.errors import EngineError, SourceIOError, translating
from quillon.plans.binder import Binder
from quillon.plans.parser import parse
from quillon.render import table
from quillon.session import Session
from quillon.sources.csv import read_csv


def answer(session: Session, text: str, folder: Path, out: TextIO) -> None:
    """Run one query and print its table, its number of rows and its time without loading."""
    select = parse(text)
    path = folder / f"{select.table}.csv"
    if not path.exists():
        raise SourceIOError(f"table file '{path.name}' not found in {folder}")
    print(f"Loading {path.name}...", file=out)
    frame = read_csv(session.spark, str(path))
    with translating():
        print(f"Loaded {frame.df.count()} rows.", file=out)
    began = time.perf_counter()
    result = frame.run(Binder(frame.schema).bind(select))
    rows = result.collect()
    print(table(result.schema.names, rows), file=out)
    print(f"(Returned {len(rows)} rows in {time.perf_counter() - began:.3f} s)", file=out)


def loop(session: Session, lines: TextIO, out: TextIO, folder: Path) -> None:
    """One query a line until exit, quit or the end; errors are printed and the loop goes on."""
    while True:
        print("quillon> ", end="", file=out, flush=True)
        line = lines.readline()
        text = line.strip()
        if not line or text.lower() in ("exit", "quit"):
            print("Goodbye!", file=out)
            return
        if not text:
            continue
        try:
            answer(session, text, folder, out)
        except EngineError as error:
            print(f"Error: {error}", file=out)
        print(file=out)


def main() -> None:
    spark = SparkSession.builder.appName("quillon").getOrCreate()
    loop(Session(spark), sys.stdin, sys.stdout, Path.cwd())


if __name__ == "__main__":
    main()
