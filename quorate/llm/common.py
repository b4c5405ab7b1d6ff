"""What the pipeline operators share: table reading, shared storage, Arrow text access.

Intermediate results that several jobs read are written as Parquet into the folder that the
cluster names in ``spark.checkpoint.dir``.  That cuts lineage without keeping blocks on
executors, so a lost executor costs only its running tasks.
"""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import brief_shuffles

#: ASCII white space, as in the class [\x20\x09-\x0D]; bytes.split() cuts at exactly these.
ASCII_SPACE = b" \t\n\x0b\x0c\r"


#: Rows and bytes of an Arrow batch, unless the session sets them: batches of whole texts stay at a few MB.
BATCH = {"maxRecordsPerBatch": 2000, "maxBytesPerBatch": 4 << 20}


def modest_batches(spark: SparkSession) -> None:
    """Bound what Spark hands to a Python worker at a time, where the session leaves that open."""
    known = spark.conf.getAll
    for name, most in BATCH.items():
        key = f"spark.sql.execution.arrow.{name}"
        if key not in known:
            spark.conf.set(key, str(most))


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 1 << 14, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Small batches of narrow rows put together until they have ``rows`` rows or ``size`` bytes."""
    held, n, held_bytes = [], 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n, held_bytes = n + batch.num_rows, held_bytes + batch.nbytes
        if n >= rows or held_bytes >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n, held_bytes = [], 0, 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: the session's checkpoint folder.

    Where none is configured, a local session gets a temporary folder and any other
    session a folder below its warehouse, which is shared by definition.
    """
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    base = spark.conf.get("spark.checkpoint.dir", None) or (known.get() if known.isDefined() else None)
    if base is None:
        if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
            base = "file://" + tempfile.mkdtemp(prefix="quorate-shared-")
        else:
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        sc.setCheckpointDir(base)
    base = base.rstrip("/")
    return base if "://" in base or base.startswith("file:") else "file://" + base


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in shared storage and read it back, with true sizes for the optimizer."""
    spark = df.sparkSession
    modest_batches(spark)
    path = shared_path(spark, label)
    with brief_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``materialise`` wrote; only for tables that nothing lazy still reads."""
    path = getattr(df, "_shared_path", None)
    if path:
        spark = df.sparkSession
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def release() -> None:
    """Give memory that Arrow and the C library hold for later back to the system, as Python workers outlive their task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """An Arrow task that gives its memory back when it ends."""

    @functools.wraps(task)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from task(batches)
        finally:
            release()

    return run


def text_bytes(column: pa.Array) -> pa.Array:
    """A text column as binary without decoding; nulls become empty."""
    if column.null_count:
        column = column.fill_null("")
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


def pieces(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch that hold about ``limit`` bytes of text each, one row at least."""
    sizes = _lengths(batch.column(column))
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += int(n)
    if start < len(sizes):
        yield start, len(sizes)


def _lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def held_out_flags(ids: list, modulus: int, remainder: int) -> list[bool]:
    """crc32 of the id's decimal text, mod ``modulus``; a null id hashes as empty text."""
    return [zlib.crc32(b"" if i is None else str(i).encode()) % modulus == remainder for i in ids]


def held_out_column(id_col: str, modulus: int, remainder: int):
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus) == remainder


def local_file(uri: str) -> str | None:
    """Path of a file URI; None for other stores."""
    if uri.startswith("file:"):
        path = uri[5:]
        return "/" + path.lstrip("/")
    return uri if uri.startswith("/") else None


def put_bytes(uri: str, data: bytes) -> None:
    """Write a file into shared storage under a name that appears only when it is whole."""
    path = local_file(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, path)
        return
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(at), recursive=True)
    part = f"{at}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, at)


def map_bytes(uri: str) -> np.ndarray:
    """A shared file as memory-mapped bytes; of a remote store, a private copy that is unlinked at once."""
    path = local_file(uri)
    if path is not None:
        return np.memmap(path, dtype=np.uint8, mode="r")
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(uri)
    with tempfile.NamedTemporaryFile() as copy:
        with store.open_input_stream(at) as f:
            while block := f.read(8 << 20):
                copy.write(block)
        copy.flush()
        return np.memmap(copy.name, dtype=np.uint8, mode="r")


def split_words(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Words between ASCII white space, in Arrow's kernels: (code of each word, distinct words, row bounds).

    Row i's words are ``codes[bounds[i]:bounds[i + 1]]``.  A-Z become lower case if ``lower``.
    Leading or trailing space gives the empty word, which callers treat as none.
    """
    import pyarrow.compute as pc

    if column.null_count:
        column = column.fill_null("")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(column) if lower else column)
    bounds = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.cast(pa.binary()).to_pylist(), bounds - bounds[0]


def gather_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ranges [start, start + length) one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


class Growing:
    """A numpy array that grows by doubling."""

    def __init__(self, dtype):
        self.data, self.size = np.empty(1024, dtype=dtype), 0

    def extend(self, more: np.ndarray) -> None:
        need = self.size + len(more)
        if need > len(self.data):
            self.data = np.concatenate([self.data[: self.size], np.empty(max(need, 2 * len(self.data)) - self.size, dtype=self.data.dtype)])
        self.data[self.size : need] = more
        self.size = need


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def copy_of(text):
    """What tells texts apart that share an id: a hash of the text, null counting as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def by_copy(docs: DataFrame, id_col: str, text_col: str, found: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of ``docs`` with (doc_id, copy) of a written table, whatever the names on either side."""
    names = [free_name(docs, n) for n in ("__id", "__copy")]
    renamed = small_side(found.select("doc_id", "copy")).toDF(*names)
    return docs.join(renamed, (docs[id_col].cast("long") == renamed[names[0]]) & (copy_of(docs[text_col]) == renamed[names[1]]), how)


def written_bytes(df: DataFrame) -> int:
    """Size of a written table by the optimizer's account of its files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def small_side(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """Marks a written table for broadcast if it has at most ``rows`` rows and 32 bytes a row; else the join is left to the optimizer."""
    return F.broadcast(df) if written_bytes(df) <= 32 * rows and df.count() <= rows else df
