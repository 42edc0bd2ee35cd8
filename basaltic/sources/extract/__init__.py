"""Facts of source files: one pass over each file, on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basaltic.sources.schemas import FACTS

TABLES = ("symbols", "imports", "calls", "inherits", "defuses", "hints", "diagnostics")


def facts_of(file_id: str, language: str, source: str) -> dict:
    """The facts of one file. Never raises: what can't be read is a diagnostic."""
    from basaltic.sources.extract import braces, python

    try:
        return python.extract(file_id, source) if language == "python" else braces.extract(file_id, language, source)
    except Exception as e:  # any failure of a front end is the file's, not the job's
        empty = {name: [] for name in (*TABLES, "tokens")}
        problem = {"file": file_id, "kind": "parse_error", "message": f"{type(e).__name__}: {e}"[:300], "line": 0}
        return empty | {"file_id": file_id, "parse_ok": False, "parse_partial": False, "diagnostics": [problem]}


def extract(files: DataFrame) -> DataFrame:
    """``files(id, language, source)`` to one row of facts each; no shuffle."""
    columns = [c.split(" ", 1)[0] for c in ("file_id", "parse_ok", "parse_partial", *TABLES[:6], "tokens", "diagnostics")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [facts_of(i, language, source or "") for i, language, source in zip(batch["id"], batch["language"], batch["source"], strict=True)]
            yield pd.DataFrame({c: [r[c] for r in rows] for c in columns})

    return files.select("id", "language", "source").mapInPandas(run, FACTS)


def fact_table(facts: DataFrame, name: str) -> DataFrame:
    """One of the fact tables, a row for each fact."""
    return facts.select(F.inline(name))
