"""Listing and reading files in tasks.

A tree is listed level by level: its folders are rows of a DataFrame, dealt out
over tasks, each of which lists its folders; files go to a table in the shared
folder, folders are the next level.  So the driver holds neither files nor
folders, and a wide level is as parallel as it has folders.

Stores are opened with pyarrow's file systems (local, hdfs, s3, gs).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.session import stored

FILE = "path string, name string, dir string, length long"
#: Levels of folders after which a tree is taken for a loop.
DEEPEST = 1000
#: Bytes read at once.
CHUNK = 8 << 20


def _open(uri: str):
    """(file system, the path in it, what makes a URI of another path in it)."""
    from pyarrow import fs

    if uri.startswith("file:") or "://" not in uri:
        path = "/" + uri.removeprefix("file:").lstrip("/") if uri.startswith(("file:", "/")) else uri
        return fs.LocalFileSystem(), path, lambda p: f"file:{p}"
    scheme, _, rest = uri.partition("://")
    host, _, path = rest.partition("/")
    store, base = fs.FileSystem.from_uri(f"{scheme}://{host}/")
    base = base.rstrip("/")
    return store, f"{base}/{path}", lambda p: f"{scheme}://{host}/{p[len(base):].lstrip('/')}"


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """All files below ``root``, dot-files too: path (a URI), name, dir, length."""
    schema = f"folder boolean, {FILE}"

    def expand(batches) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path, uri_of = _open(uri)
                rows = []
                for info in store.get_file_info(fs.FileSelector(path, recursive=False)):
                    if info.type in (fs.FileType.Directory, fs.FileType.File):
                        rows.append((info.type == fs.FileType.Directory, uri_of(info.path), info.base_name, uri.rstrip("/"), info.size))
                for at in range(0, len(rows), 10_000):
                    part = list(zip(*rows[at : at + 10_000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(part[0]), *(pa.array(c, pa.string()) for c in part[1:4]), pa.array(part[4], pa.int64())], names=["folder", "path", "name", "dir", "length"])

    n = max(1, spark.sparkContext.defaultParallelism)
    _, path, uri_of = _open(root.rstrip("/") or "/")
    level = spark.createDataFrame([(uri_of(path),)], "path string")
    found = None
    for _ in range(DEEPEST):
        listed = stored(level.repartition(n).mapInArrow(expand, schema), "listing")
        files = listed.where(~F.col("folder")).drop("folder")
        found = files if found is None else found.unionByName(files)
        level = listed.where(F.col("folder")).select("path")
        if level.isEmpty():
            return found
    raise RecursionError(f"{root}: more than {DEEPEST} levels of folders")


def read_texts(files: DataFrame, path: str = "path", name: str = "content") -> DataFrame:
    """``files`` with the text of each (small) file, read where its row is; null where it can't be read."""
    columns = files.columns
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema.fields)

    def read(batches):
        for batch in batches:
            out = []
            for uri in batch.column(batch.schema.get_field_index(path)).to_pylist():
                try:
                    store, at, _ = _open(uri)
                    with store.open_input_stream(at) as f:
                        out.append(f.read().decode("utf-8", "replace"))
                except OSError:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*columns, name])

    return files.mapInArrow(read, f"{types}, {name} string")


#: Bytes of the digests that have no length of their own.  Fixed values.
SHAKE = {"shake_128": 32, "shake_256": 64}


def digests(files: DataFrame, path: str = "path", algo: str = "algo", name: str = "actual") -> DataFrame:
    """``files`` with the hex digest of each file by its row's algorithm, read in
    chunks where the row is; null where the file can't be read."""
    columns = files.columns
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema.fields)

    def one(uri: str, kind: str) -> str | None:
        try:
            store, at, _ = _open(uri)
            h = hashlib.new(kind)
            with store.open_input_stream(at) as f:
                while data := f.read(CHUNK):
                    h.update(data)
        except OSError:
            return None
        return h.hexdigest(SHAKE[kind]) if kind in SHAKE else h.hexdigest()

    def run(batches):
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()  # noqa: B023, E731
            out = [one(p, a) for p, a in zip(get(path), get(algo), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*columns, name])

    return files.mapInArrow(run, f"{types}, {name} string")
