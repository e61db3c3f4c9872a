"""Source files of a code tree on storage that every executor can reach.

Spark's own file readers skip names that start with ``_`` or ``.``, which would lose every
``__init__.py``; so tasks list the directories and read the files themselves.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

from ..session import Scratch

# What is read and what is never entered.
SUFFIXES = (".sql", ".py")
SKIPPED = (".venv", ".git")
ENTRIES = "file_path string, is_dir boolean"
BATCH_CHARACTERS = 16 << 20


LISTED_AT_ONCE = 10_000


def open_root(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it of a path or URI as Spark takes it."""
    uri = re.sub(r"^s3[an]:", "s3:", root)  # Hadoop's names of the same store
    if "://" not in uri and not uri.startswith("/") and ":" not in uri:
        uri = os.path.abspath(uri)
    system, base = pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))
    return system, base.rstrip("/")


def _entries(system: pafs.FileSystem, folder: str) -> Iterator[tuple[str, bool, bool]]:
    """(name, is a folder, is a file) of what a folder holds; a local one is listed as it is read."""
    if isinstance(system, pafs.LocalFileSystem):
        with os.scandir(folder) as found:
            for entry in found:
                yield entry.name, entry.is_dir(follow_symlinks=False), entry.is_file()
        return
    for info in _again(lambda: system.get_file_info(pafs.FileSelector(folder))):
        yield info.base_name, info.type == pafs.FileType.Directory, info.type == pafs.FileType.File


def _again(action: Callable, tries: int = 3):
    """The action's result; a failure of storage may pass, so it is tried again and then fails the task."""
    for left in reversed(range(tries)):
        try:
            return action()
        except OSError:
            if not left:
                raise


def list_source_files(spark: SparkSession, root: str) -> DataFrame:
    """Paths below ``root`` (relative to it) of all SQL and Python files.

    One job per directory depth: the directories found so far are spread over the tasks,
    which list them. No list of paths passes through the driver, and a task hands on what it lists
    10,000 names at a time.
    """
    tasks = spark.sparkContext.defaultParallelism

    def list_dirs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = open_root(root)
        found = []
        for batch in batches:
            for parent in batch["file_path"]:
                for name, is_dir, is_file in _entries(system, f"{base}/{parent}".rstrip("/")):
                    if name in SKIPPED:
                        continue
                    if is_dir or (is_file and PurePosixPath(name).suffix in SUFFIXES):
                        found.append((f"{parent}/{name}".lstrip("/"), is_dir))
                    if len(found) >= LISTED_AT_ONCE:
                        yield pd.DataFrame(found, columns=["file_path", "is_dir"])
                        found = []
        yield pd.DataFrame(found, columns=["file_path", "is_dir"])

    scratch = Scratch(spark, "source-files")
    level = scratch.cut(spark.createDataFrame([("", True)], ENTRIES), "level/depth=0")
    depth = 0
    while True:
        depth += 1
        dirs = level.where("is_dir").select("file_path")
        found = dirs.repartition(tasks).mapInPandas(list_dirs, ENTRIES)
        if not scratch.write(found, f"level/depth={depth}"):
            break
        level = scratch.read(f"level/depth={depth}", level.schema)
    return scratch.read("level", level.schema).where("not is_dir").select("file_path")


def write_source_files(sources: DataFrame, root: str) -> None:
    """Store each (file_path, text) as a file below ``root``, in UTF-8; null texts are left out.

    A file is written beside its place and then takes it, so a task that is tried again or runs twice
    leaves whole files.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = open_root(root)
        written = 0
        for batch in batches:
            for path, text in zip(batch["file_path"], batch["text"]):
                place = PurePosixPath(base, path)
                system.create_dir(str(place.parent), recursive=True)
                beside = str(place.with_name(f"{place.name}.{uuid.uuid4().hex}.part"))
                with system.open_output_stream(beside) as stream:
                    stream.write(text.encode())
                system.move(beside, str(place))
                written += 1
        yield pd.DataFrame({"written": [written]})

    rows = sources.select("file_path", "text").where("file_path is not null and text is not null")
    rows.mapInPandas(write, "written bigint").agg({"written": "sum"}).first()


def _text_of(system: pafs.FileSystem, path: str, tries: int = 3) -> tuple[str | None, str | None]:
    """(text, None), or (None, reason) for another encoding or a file that may not be read.

    Any other failure may pass, so it is tried again and then fails the task.
    """

    def read() -> bytes | None:
        try:
            with system.open_input_stream(path) as stream:
                return stream.read()
        except PermissionError:
            return None

    body = _again(read, tries)
    if body is None:
        return None, "no permission"
    try:
        return body.decode("utf-8"), None
    except UnicodeDecodeError:
        return None, "not UTF-8"


def read_source_files(
    spark: SparkSession, root: str, tasks: int | None = None, with_reason: bool = False
) -> DataFrame:
    """(file_path, text) of the source files; line ends become ``\\n``.

    Files in other encodings or without permission are left out, or stay as rows with a null text and a
    ``reason`` if asked for.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = open_root(root)
        rows, held = [], 0
        for batch in batches:
            for path in batch["file_path"]:
                text, reason = _text_of(system, f"{base}/{path}")
                if text is not None:
                    text = text.replace("\r\n", "\n").replace("\r", "\n")
                rows.append((path, text, reason))
                held += len(text or "")
                if held > BATCH_CHARACTERS:
                    yield pd.DataFrame(rows, columns=["file_path", "text", "reason"])
                    rows, held = [], 0
        yield pd.DataFrame(rows, columns=["file_path", "text", "reason"])

    tasks = tasks or 4 * spark.sparkContext.defaultParallelism
    # An explicit number of partitions: paths are tiny, and the runtime would merge them
    # into one task although the files behind them are not.
    found = (
        list_source_files(spark, root)
        .repartition(tasks)
        .mapInPandas(read, "file_path string, text string, reason string")
    )
    return found if with_reason else found.where("reason is null").drop("reason")
