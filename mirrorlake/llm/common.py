"""Shared helpers of the training-data operators: inputs, folds, the shared work folder."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MADE: list[str] = []


def _sweep() -> None:
    for path in _MADE:
        if urlparse(path).scheme in ("", "file"):
            shutil.rmtree(urlparse(path).path, ignore_errors=True)
            continue
        with contextlib.suppress(Exception):  # what can't be reached when the process ends is left to the folder's owner
            from pyarrow import fs

            system, at = fs.FileSystem.from_uri(path)
            system.delete_dir(at)


atexit.register(_sweep)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def fold(mod: int, column: str = "doc_id") -> Column:
    """crc32 of the id written as text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % mod


#: Bounds of the Arrow batches that Python workers get: rows and bytes.
BATCH_ROWS, BATCH_BYTES = 1000, "2m"


def batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session, one bound for all operators; what its user has set stays."""
    for name, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}", None) is None:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(value))


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where none is set a local session, all on one machine, makes its own; a cluster's has none that all share, and this raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = known.get() if known.isDefined() else None
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="mirrorlake-shared-")
        _MADE.append(root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder under the shared one, removed when the driver's Python ends."""
    path = f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex[:12]}"
    _MADE.append(path)
    return path


_WORKER_CACHES: dict[str, list] = {}


def claim(owner: str) -> None:
    """Empty the worker's caches of all other owners.

    Workers are used again by later stages; without this their memory would be the sum of all operators' caches.
    """
    for other, caches in _WORKER_CACHES.items():
        if other != owner and any(c.cache_info().currsize for c in caches):
            for c in caches:
                c.cache_clear()
            give_back()


def worker_cache(owner: str):
    """A one-place cache of a worker process that is emptied when another owner's work begins there."""
    import functools

    def wrap(make):
        held = functools.lru_cache(maxsize=1)(make)
        _WORKER_CACHES.setdefault(owner, []).append(held)

        @functools.wraps(make)
        def get(*args):
            claim(owner)
            return held(*args)

        return get

    return wrap


def give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def settle(spark: SparkSession, frame: DataFrame, path: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors."""
    schema = frame.schema
    frame.write.mode("overwrite").parquet(path)
    return spark.read.schema(schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared one that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


# --- plain files in the shared folder, written and mapped by Python workers -----------------------


def put_bytes(path: str, data: bytes) -> None:
    """Write a whole file under its final name in one step, so that a repeated task changes nothing."""
    url = urlparse(path)
    if url.scheme in ("", "file"):
        os.makedirs(os.path.dirname(url.path), exist_ok=True)
        part = f"{url.path}.{uuid.uuid4().hex[:8]}"
        with open(part, "wb") as out:
            out.write(data)
        os.replace(part, url.path)
        return
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    system.create_dir(os.path.dirname(at), recursive=True)
    part = f"{at}.{uuid.uuid4().hex[:8]}"
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, at)


#: Seconds after which a machine's copy of a shared file is removed when the next one is made; maps of it stay valid.
COPY_AGE = 6 * 3600


def _drop_old_copies() -> None:
    for entry in os.scandir(tempfile.gettempdir()):
        if entry.name.startswith("mirrorlake-") and entry.is_file() and time.time() - entry.stat().st_mtime > COPY_AGE:
            with contextlib.suppress(FileNotFoundError):
                os.unlink(entry.path)


def local_path(path: str) -> str:
    """A path that can be memory-mapped: the file itself on a mounted folder, else one copy per machine."""
    url = urlparse(path)
    if url.scheme in ("", "file"):
        return url.path
    from pyarrow import fs

    copy = os.path.join(tempfile.gettempdir(), "mirrorlake-" + uuid.uuid5(uuid.NAMESPACE_URL, path).hex)
    if not os.path.exists(copy):
        _drop_old_copies()
        system, at = fs.FileSystem.from_uri(path)
        with system.open_input_stream(at) as src, open(f"{copy}.{os.getpid()}", "wb") as out:
            shutil.copyfileobj(src, out)
        os.replace(f"{copy}.{os.getpid()}", copy)
    return copy


# --- texts in bounded runs, filters that keep whole rows ------------------------------------------


def groups(texts: list[bytes], size: int) -> Iterator[list[bytes]]:
    """The texts in runs of about ``size`` bytes, one text at least."""
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def filter_texts(docs: DataFrame, accept) -> DataFrame:
    """Rows of ``docs``, all columns as they are, whose text ``accept`` (list of texts, null as empty, to a mask) takes; no shuffle."""
    import pyarrow as pa

    batches(docs.sparkSession)
    at = docs.columns.index("text")

    def work(stream):
        for batch in stream:
            if batch.num_rows:
                yield batch.filter(pa.array(accept([t or "" for t in batch.column(at).to_pylist()]), pa.bool_()))
        give_back()

    return docs.mapInArrow(work, docs.schema)
