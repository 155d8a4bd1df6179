"""Files written by tasks into a shared folder: temporary names, a manifest, then the commit.

A task writes each file under a temporary name of its own and returns a manifest row for it. The rows are
saved once; then a job renames exactly the files in the manifest to their final names, and the
manifest itself appears last, under its own name. A task that is lost and run again leaves at most
a temporary file that no manifest names. Paths are URIs that pyarrow's file systems open.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import save

MANIFEST = "_manifest.json"


def system(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or plain path."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


def temporary(folder: str, name: str) -> str:
    """A name that no other attempt uses."""
    return posixpath.join(folder, "_temporary", f"{name}.{uuid.uuid4().hex}")


def commit(written: DataFrame, folder: str) -> DataFrame:
    """Save the manifest rows (with columns temporary and file), rename the files, seal the manifest.

    Renaming is idempotent: a file that is already in its place is left there.
    """
    rows = save(written)

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for old, new in zip(batch.column("temporary").to_pylist(),
                                batch.column("file").to_pylist(), strict=True):
                files, target = system(posixpath.join(folder, new))
                _, source = system(old)
                if files.get_file_info(source).type == fs.FileType.File:
                    files.move(source, target)
                elif files.get_file_info(target).type != fs.FileType.File:
                    raise FileNotFoundError(old)
            yield batch.select(["file"])

    moved = rows.select("temporary", "file").mapInArrow(rename, "file string")
    n = moved.agg(F.count(F.lit(1))).first()[0]
    files, root = system(folder)
    files.create_dir(root, recursive=True)
    draft = posixpath.join(root, f"{MANIFEST}.{uuid.uuid4().hex}")
    with files.open_output_stream(draft) as f:
        f.write(json.dumps({"files": n, "columns": rows.columns}).encode())
    files.move(draft, posixpath.join(root, MANIFEST))
    return rows
