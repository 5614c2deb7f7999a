"""Run times as a table with a column per configuration, kept in a CSV file.

Times live in a long table (position, run order, seconds); the wide file is a
pivot of it, written through a temporary name.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

CELLS = "row BIGINT, position INT, name STRING, cell STRING"


def placed(appends: list[tuple[str, list[float]]]) -> list[tuple[int, int, str, str]]:
    """Cells (row, column position, column name, text) after appending columns of values one after the other.

    A new name is a new column from the first row on; values of a known name go
    below the last row of all columns.
    """
    names: list[str] = []
    cells: list[tuple[int, int, str, str]] = []
    rows = 0
    for name, values in appends:
        first = rows if name in names else 0
        if name not in names:
            names.append(name)
        cells += [(first + k, names.index(name), name, f"{v:.6f}") for k, v in enumerate(values)]
        rows = max(rows, first + len(values))
    return cells


def wide(cells: DataFrame, names: list[str]) -> DataFrame:
    """A row per position and a column per name, empty text where there is no cell."""
    table = cells.groupBy("row").pivot("name", names).agg(F.first("cell"))
    return table.select("row", *[F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names])


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """All cells as text; short lines are padded and longer ones cut."""
    first = spark.read.text(path).first()
    header = (first[0] if first else "").rstrip("\r").split(",")
    schema = ", ".join(f"`{name}` STRING" for name in header)
    return spark.read.option("header", True).option("enforceSchema", True).option("quote", "").schema(schema).csv(path).na.fill("")


def appended(text: str, name: str, values: list[float]) -> str:
    """The file's text with a column of run times added, or with rows in a column that it has."""
    header, *rows = [line.rstrip("\r").split(",") for line in text.splitlines()] or [[]]
    rows = [(r + [""] * len(header))[: len(header)] for r in rows]
    known = name in header
    if not known:
        header.append(name)
        rows = [[*r, ""] for r in rows]
    first = len(rows) if known else 0
    rows += [[""] * len(header) for _ in range(first + len(values) - len(rows))]
    for k, v in enumerate(values):
        rows[first + k][header.index(name)] = f"{v:.6f}"
    return "".join(",".join(r) + "\n" for r in [header, *rows])


def append_column(path: str, name: str, values: list[float], spark: SparkSession | None = None) -> None:
    """Add run times to a file, which is replaced as a whole. With a session, the file can be in any store that Spark reaches."""
    if spark is not None:
        text = files.read_text(spark, path) if files.exists(spark, path) else ""
        files.write_bytes(spark, path, appended(text, name, values).encode())
        return
    ensure_folder(os.path.dirname(path))
    text = ""
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            text = f.read()
    with tempfile.NamedTemporaryFile("w", encoding="utf-8", dir=os.path.dirname(path) or ".", delete=False) as f:
        f.write(appended(text, name, values))
    os.replace(f.name, path)


def ensure_folder(path: str) -> None:
    if path:
        os.makedirs(path.rstrip("/") or "/", mode=0o755, exist_ok=True)
