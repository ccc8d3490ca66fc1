"""Token ids in flat binary files with 64-bit offsets, read back through memory maps.

Documents are dealt out by ranges of doc_id and sorted there, so each partition writes one run
of the global order. A partition's place is the prefix sum of the token counts before it; only
those counts, one row for a partition, go to the driver. A task that is repeated writes files of
a new name, and the manifest names the files of the task that counted.

``X.bin``: ids as unsigned little-endian integers, document after document, of 16 bits where the
vocabulary has at most 65,536 ids, else of 32.
``X.idx``: the bytes ``TOKIDX01``, the bytes of an id (2 or 4), the number n of documents, n + 1 offsets in ids, n doc_ids, all
64-bit little-endian integers, then n bytes that are 0 where doc_id is null.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_tokens import tokens
from .common import partitions, range_bucket, shared_dir, slices, texts_of, tie

MAGIC = b"TOKIDX01"
MANIFEST = "part int, name string, n_docs long, n_tokens long"


def _place(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_index(path: str, offsets: np.ndarray, doc_ids: list[int | None], width: int) -> None:
    fs, at = _place(path)
    with fs.open_output_stream(at) as f:
        f.write(MAGIC + np.array([width, len(doc_ids)], "<i8").tobytes() + offsets.astype("<i8").tobytes())
        f.write(np.array([i or 0 for i in doc_ids], "<i8").tobytes() + np.array([i is not None for i in doc_ids], "u1").tobytes())


def mapped(uri: str) -> memoryview:
    """A file's bytes: a memory map where the folder is local, else read from its store."""
    fs, at = _place(uri)
    if isinstance(fs, pa.fs.LocalFileSystem):
        return memoryview(np.memmap(at, np.uint8, "r")) if fs.get_file_info(at).size else memoryview(b"")
    with fs.open_input_stream(at) as f:
        return memoryview(f.read())


def read_index(uri: str) -> tuple[np.ndarray, list[int | None], int]:
    """Offsets, doc_ids, and the bytes of an id."""
    data = mapped(uri)
    if bytes(data[:8]) != MAGIC:
        raise ValueError(f"{uri} is no index of token files")
    width, n = np.frombuffer(data, "<i8", 2, 8).tolist()
    offsets, ids = np.frombuffer(data, "<i8", n + 1, 24), np.frombuffer(data, "<i8", n, 32 + 8 * n)
    there = np.frombuffer(data, "u1", n, 32 + 16 * n)
    return offsets, [int(i) if t else None for i, t in zip(ids, there, strict=True)], width


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 0) -> list[tuple[int, str, int, int]]:
    """Write the ids of all documents, each with ``end_id`` after it, in ascending doc_id.

    Returns the manifest, which is also written: a part's number, file name, documents, tokens.
    Null texts are empty and have the end id only. Rows of a null doc_id come first, rows of the
    same doc_id side by side, by a hash of their text; equal rows are documents of their own. An
    empty table writes no files; other columns are not read. A text is held whole; memory is
    bounded by a slice of texts (``SLICE_BYTES``) or one longer text, and the numbers of a part.
    """
    spark = docs.sparkSession
    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    part, n = range_bucket(rows, "doc_id", partitions(spark))
    dealt = rows.withColumn("part", part).repartitionById(n, F.col("part")).sortWithinPartitions("doc_id", tie(), "text")
    fs, at = _place(folder)
    if isinstance(fs, pa.fs.LocalFileSystem):
        fs.create_dir(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = tokens(tokenizer_path), np.array([end_id], "<u4").tobytes()
        width = 2 if max(encoder.library.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        ids, sizes, part, out = [], [0], -1, None
        name = uuid.uuid4().hex
        for batch in slices(batches):
            if not batch.num_rows:
                continue
            if out is None:
                part = batch.column("part")[0].as_py()
                name = f"part-{part:06d}-{name}"
                store, at = _place(f"{folder}/{name}.bin")
                out = store.open_output_stream(at)
            coded = encoder.encode(texts_of(batch))
            flat = b"".join([c + end for c in coded])
            out.write(np.frombuffer(flat, "<u4").astype("<u2").tobytes() if width == 2 else flat)
            sizes += [len(c) // 4 + 1 for c in coded]
            ids += batch.column("doc_id").to_pylist()
        if out is not None:
            out.close()
            offsets = np.cumsum(np.array(sizes, np.int64))
            write_index(f"{folder}/{name}.idx", offsets, ids, width)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([len(ids)], pa.int64()), pa.array([int(offsets[-1])], pa.int64())], names=["part", "name", "n_docs", "n_tokens"])

    manifest = sorted(tuple(r) for r in dealt.mapInArrow(run, MANIFEST).collect())
    with fs.open_output_stream(f"{at}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def read_tokens(spark: SparkSession, folder: str, manifest: list[tuple[int, str, int, int]], with_ids: bool = False) -> DataFrame:
    """One row for a document in the files: doc_id, start, n_tokens, ids_crc32, and ids if asked."""
    bases = [0, *accumulate(m[3] for m in manifest)]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                offsets, doc_ids, width = read_index(f"{folder}/{row['name']}.idx")
                data = np.frombuffer(mapped(f"{folder}/{row['name']}.bin"), f"<u{width}")
                for i in range(0, len(doc_ids), 8192):
                    ends = offsets[i : i + 8193].tolist()
                    crcs = [zlib.crc32(data[a:b].astype("<u4")) for a, b in zip(ends, ends[1:], strict=False)]
                    columns = [pa.array(doc_ids[i : i + 8192], pa.int64()), pa.array([row["base"] + a for a in ends[:-1]], pa.int64()), pa.array(np.diff(ends), pa.int64()), pa.array(crcs, pa.int64())]
                    if with_ids:
                        columns.append(pa.array([data[a:b].astype(np.int64) for a, b in zip(ends, ends[1:], strict=False)], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids])

    files = spark.createDataFrame([(k, m[1], b) for k, (m, b) in enumerate(zip(manifest, bases, strict=False))], "k int, name string, base long")
    return files.repartitionById(max(1, len(manifest)), F.col("k")).mapInArrow(run, schema)


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Write all documents' ids to files in the shared folder, and read the files back: the columns of ``read_tokens``.

    Null, empty and repeated rows as in ``write_tokens``; an empty table gives no rows.
    """
    folder = shared_dir(docs.sparkSession, "token-files")
    return read_tokens(docs.sparkSession, folder, write_tokens(docs, tokenizer_path, folder, end_id), with_ids)
