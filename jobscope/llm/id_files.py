"""Token-ID / binary output: ids of all documents, in ascending doc_id, in range-coded files.

Documents are dealt to ranges of ids and streamed in order.  Each range is cut
into parts of whole documents; a part is a row of the files: its range and
number, the ids before it in the range, its documents with their numbers of
ids, and its blocks, one behind another, each with its own model and checksum
(see ``range_coder``).  The files are Parquet in the shared folder, committed by
Spark, so a task that is run again leaves no second copy.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .byte_bpe import encoder
from .common import register, shared_dir, table, texts
from .ordered import cut_points, in_order, range_of
from .range_coder import BLOCK, decode, encode

#: Id that ends a document.
END = 0
#: Ids of a part, unless its last document has more.
PART = 8 << 20
#: Bytes of text encoded at once.
TEXT = 1 << 20
FILE = "range int, part int, before long, n_docs int, n_ids long, doc_ids binary, nulls binary, sizes binary, blocks array<binary>"


def write(docs: DataFrame, tokenizer: str, path: str) -> None:
    """Encode every row's text and write the files.

    Null texts are empty and have the end id only.  Rows of one doc_id are
    ordered by a hash of their text; null ids come last.
    """
    W.small_batches(docs.sparkSession)
    cuts = cut_points(docs, 1)

    def deal(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids, raw = batch.column(0), [t.encode() for t in batch.column(1).to_pylist()]
            to = range_of(cuts, ids.fill_null(0).to_numpy()) if len(cuts) else np.zeros(len(raw), np.int64)
            to[np.flatnonzero(np.array(ids.is_null()))] = max(len(cuts) - 1, 0)
            tie = [int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "big", signed=True) for t in raw]
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), ids, pa.array(tie, pa.int64()), pa.array([pack.compress(t) for t in raw], pa.binary())], names=["range", "doc_id", "tie", "packed"])

    def code(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokens = encoder(tokenizer)
        open_ = zstandard.ZstdDecompressor()
        at = None
        part = before = 0
        keys: list = []
        sizes: list = []
        held: list = []
        n_ids = 0
        waiting: list = []
        waits = 0

        def flush():
            """Encode the texts that wait."""
            nonlocal waiting, waits, n_ids
            if waiting:
                ids, first = tokens.encode(waiting)
                n = np.diff(first)
                out = np.full(len(ids) + len(n), END, np.uint16)
                out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
                held.append(out)
                sizes.extend((n + 1).tolist())
                n_ids += len(out)
                waiting, waits = [], 0

        def row():
            nonlocal keys, sizes, held, n_ids, part, before
            ids = np.concatenate(held)
            held = []
            blocks = encode([ids[a : a + BLOCK] for a in range(0, len(ids), BLOCK)])
            null = np.array([k is None for k in keys])
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([at], pa.int32()),
                    pa.array([part], pa.int32()),
                    pa.array([before], pa.int64()),
                    pa.array([len(keys)], pa.int32()),
                    pa.array([len(ids)], pa.int64()),
                    pa.array([zstandard.compress(np.array([k or 0 for k in keys], "<i8").tobytes(), 1)], pa.binary()),
                    pa.array([zstandard.compress(null.astype(np.uint8).tobytes(), 1)], pa.binary()),
                    pa.array([zstandard.compress(np.array(sizes, "<i8").tobytes(), 1)], pa.binary()),
                    pa.array([blocks], pa.list_(pa.binary())),
                ],
                names=["range", "part", "before", "n_docs", "n_ids", "doc_ids", "nulls", "sizes", "blocks"],
            )
            before += len(ids)
            part += 1
            keys, sizes, n_ids = [], [], 0
            return out

        for batch in batches:
            for where, i, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
                if where != at:
                    flush()
                    if keys:
                        yield row()
                    at, part, before = where, 0, 0
                waiting.append(open_.decompress(packed.as_py()))
                keys.append(i)
                waits += len(waiting[-1])
                if waits >= TEXT:
                    flush()
                    if n_ids >= PART:
                        yield row()
        flush()
        if keys:
            yield row()

    dealt = texts(docs).mapInArrow(deal, "range int, doc_id long, tie long, packed binary")
    in_order(dealt, F.col("doc_id").asc_nulls_last(), "tie").mapInArrow(code, FILE).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document in the files: doc_id, start, n_tokens, ids_crc32, and its ids."""
    files = spark.read.schema(FILE).parquet(path)
    # one row for each range
    sizes = {r["range"]: r.n for r in files.groupBy("range").agg(F.sum("n_ids").alias("n")).collect()}
    starts, total = {}, 0
    for r in sorted(sizes):
        starts[r], total = total, total + sizes[r]
    W.small_batches(spark)

    def docs(batches):
        encoder.cache_clear()  # a worker that has encoded keeps no tables while it decodes
        for batch in batches:
            for row in batch.to_pylist():
                keys, null, n = (np.frombuffer(zstandard.decompress(row[c]), k) for c, k in (("doc_ids", "<i8"), ("nulls", "u1"), ("sizes", "<i8")))
                ids = np.concatenate([np.zeros(0, "<u4"), *decode(row.pop("blocks"))])
                cuts = np.concatenate([[0], np.cumsum(n)])
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64(), mask=null.astype(bool)), pa.array(starts[row["range"]] + row["before"] + cuts[:-1]), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(docs, "doc_id long, start long, n_tokens long, ids_crc32 long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@register("op8_token_id_output")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), default_tokenizer(), path)
    return read(spark, path)
