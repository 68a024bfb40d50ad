"""Carrying a plan out on file systems that the executors see, and describing files beside them."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _side(planned: DataFrame) -> Column:
    fields = ("hash", "size", "type", "owner", "year", "is_duplicate", "path_metadata")
    have = [F.col(c) for c in fields if c in planned.columns]
    return F.to_json(F.struct(F.col("path").alias("original_path"), *have))


def sidecars(planned: DataFrame) -> DataFrame:
    """path of the side file beside each destination, and its JSON."""
    return planned.select(F.concat("destination", F.lit(".meta.json")).alias("path"), _side(planned).alias("value"))


def document_fields(files: DataFrame) -> DataFrame:
    """path, key, value: the fields one would embed in documents and recordings of the file's kind."""
    ext = F.lower(F.substring_index("path", ".", -1))
    title, owner, year = F.element_at(F.split("path", "/"), -1), F.col("owner"), F.col("year").cast("string")
    pairs = (
        F.when(ext == "pdf", F.create_map(F.lit("title"), title, F.lit("author"), owner, F.lit("keywords"), F.col("type")))
        .when(ext == "docx", F.create_map(F.lit("title"), title, F.lit("author"), owner))
        .when(ext == "mp3", F.create_map(F.lit("title"), title, F.lit("artist"), owner, F.lit("date"), year))
    )
    return files.select("path", F.explode(pairs)).where("value is not null")


def existing(files: DataFrame) -> DataFrame:
    """path of the rows whose file is there, as the executors see it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[b["path"].map(os.path.exists)]

    return files.where("path is not null").select("path").mapInPandas(run, "path string")


def copy_files(planned: DataFrame, execute: bool = False, metadata: bool = False) -> DataFrame:
    """path, destination, status (copied, planned, exists, missing, error) and error of each row.

    Without execute nothing is touched. Rows with one destination are given to one task, where the
    first by path is copied and the rest find it there. With metadata the same task writes the side file
    of each file it copies.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            status, errors = [], []
            for src, dst, side in zip(b["path"], b["destination"], b["side"]):
                s, e = "planned", None
                try:
                    if not os.path.exists(src):
                        s, e = "missing", "no such file"
                    elif os.path.exists(dst):
                        s = "exists"
                    elif execute:
                        os.makedirs(os.path.dirname(dst), exist_ok=True)
                        part = f"{dst}.part"
                        shutil.copy2(src, part)  # a retried task leaves no half file behind
                        os.replace(part, dst)
                        s = "copied"
                        if metadata:
                            with open(f"{dst}.meta.json", "w", encoding="utf-8") as out:
                                out.write(side)
                except OSError as x:
                    s, e = "error", str(x)
                status.append(s)
                errors.append(e)
            yield pd.DataFrame({"path": b["path"], "destination": b["destination"], "status": status, "error": errors})

    rows = planned.select("path", "destination", _side(planned).alias("side")).where("path is not null and destination is not null")
    return rows.repartition("destination").sortWithinPartitions("destination", "path").mapInPandas(run, "path string, destination string, status string, error string")


def write_lines(df: DataFrame, path: str) -> None:
    """A one-column DataFrame of text as files of lines."""
    df.select(F.col(df.columns[0]).alias("value")).write.mode("overwrite").text(path)


def write_file(df: DataFrame, path: str) -> None:
    """A sorted one-column DataFrame of text as one local file: executors write its parts, which are then joined in order."""
    at = os.path.abspath(path)
    parts = tempfile.mkdtemp(prefix=".parts-", dir=os.path.dirname(at))
    try:
        write_lines(df, f"file://{parts}")
        with open(at, "wb") as out:
            for name in sorted((x for x in os.listdir(parts) if x.startswith("part-")), key=lambda x: int(x.split("-")[1])):
                with open(os.path.join(parts, name), "rb") as part:
                    shutil.copyfileobj(part, out)
    finally:
        shutil.rmtree(parts)
