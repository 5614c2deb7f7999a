"""Makes the package importable in executors that don't have it installed."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from pathlib import Path

ROOT = Path(__file__).resolve().parent
_done: set[str] = set()


def ship(spark) -> None:
    """Add the package's sources to the application once."""
    context = spark.sparkContext
    if context.applicationId in _done:
        return
    _done.add(context.applicationId)
    path = os.path.join(tempfile.mkdtemp(prefix="mycelia-src-"), "mycelia_src.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for source in sorted(ROOT.rglob("*.py")):
            archive.write(source, source.relative_to(ROOT.parent))
    context.addPyFile(path)


def shipped(query):
    @functools.wraps(query)
    def run(spark, *args, **kwargs):
        ship(spark)
        return query(spark, *args, **kwargs)

    return run
