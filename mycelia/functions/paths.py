"""Names of result files, as expressions over a path column and as plain functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FALLBACK = "graph"


def stem(path: Column) -> Column:
    """The last part of a path without its last extension; a leading dot is part of the name; "graph" if nothing is left."""
    base = F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/]*)$", 1)
    cut = F.regexp_replace(base, r"^(.+)\.[^.]*$", "$1")
    return F.when(cut == "", FALLBACK).otherwise(cut)


def join_path(folder: Column, name: Column) -> Column:
    return F.when((folder == "") | folder.endswith("/"), F.concat(folder, name)).otherwise(F.concat(folder, F.lit("/"), name))


def result_path(folder: Column, prefix: Column, path: Column) -> Column:
    return join_path(folder, F.concat(prefix, F.lit("_"), stem(path), F.lit(".csv")))


def stem_of(path: str) -> str:
    base = path.rpartition("/")[2]
    dot = base.rfind(".")
    return (base[:dot] if dot > 0 else base) or FALLBACK


def join_of(folder: str, name: str) -> str:
    return folder + name if not folder or folder.endswith("/") else f"{folder}/{name}"


def result_path_of(folder: str, prefix: str, path: str) -> str:
    return join_of(folder, f"{prefix}_{stem_of(path)}.csv")
