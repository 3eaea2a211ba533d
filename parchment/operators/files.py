"""Files written, moved and deleted by tasks, in any file system that Arrow reaches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame


def _at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path there; names may hold any character."""
    scheme, colon, rest = path.partition(":/")
    if not colon or scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/") if colon else path
    return fs.FileSystem.from_uri(f"{scheme}:/{quote(rest)}")


def write(path: str, data: bytes) -> None:
    """Puts data in place of the file at path; who reads it sees the old content or the new."""
    files, at = _at(path)
    folder = at.rpartition("/")[0]
    files.create_dir(folder, recursive=True)
    # a name that no file to keep has, so what a lost task leaves is known
    part = f"{folder}/.{uuid.uuid4().hex}.part"
    with files.open_output_stream(part) as out:
        out.write(data)
    try:
        files.move(part, at)
    except OSError:
        files.delete_file(part)
        raise


def move(path: str, to: str) -> None:
    """path takes the place of to.  If path is gone, as when a task runs again, nothing happens."""
    files, at = _at(path)
    if files.get_file_info(at).type == fs.FileType.File:
        files.move(at, _at(to)[1])


def copy(path: str, to: str) -> None:
    files, at = _at(path)
    with files.open_input_stream(at) as f:
        write(to, f.readall())


def delete(path: str) -> None:
    files, at = _at(path)
    if files.get_file_info(at).type == fs.FileType.File:
        files.delete_file(at)


def each(rows: DataFrame, name: str, do: Callable[[dict], None]) -> DataFrame:
    """(name, done, message): do() of each row, on the executors; what fails is told, and the others go on."""
    kind = rows.schema[name].dataType.simpleString()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            out = []
            for r in p.to_dict("records"):
                try:
                    do(r)
                    out.append((r[name], True, None))
                except Exception as e:  # noqa: BLE001  of one file, not of the job
                    out.append((r[name], False, str(e)))
            yield pd.DataFrame(out, columns=[name, "done", "message"])

    return rows.mapInPandas(run, f"{name} {kind}, done boolean, message string")
