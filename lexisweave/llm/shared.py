"""Shared folders, materialised tables and byte-level word rules used by several operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, label: str) -> str:
    """URI of a new folder under spark.checkpoint.dir, which the driver and all executors can reach.

    Where that setting is unset (tests, a single machine), a folder of this machine is set once for the session.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_lexisweave_dir", None)
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = sc._lexisweave_dir = tempfile.mkdtemp(prefix="lexisweave-")
        sc.setCheckpointDir(base)
    if not re.match(r"[a-z][a-z0-9+.-]*:", base):
        base = "file://" + base
    return f"{base.rstrip('/')}/lexisweave/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(uri: str):
    """(pyarrow file system, path) of a URI; works for local, HDFS and object-store folders."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def publish(uri: str, write) -> None:
    """Call write(stream) on a hidden name beside uri and move the finished file into place.

    A retried or speculative task writes a name of its own, so a half-written file is never seen under uri.
    """
    system, path = file_system(uri)
    folder, _, name = path.rpartition("/")
    system.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        write(out)
    system.move(part, path)


#: Maps a byte to itself, lower-cased, if it belongs to a word ([0-9a-z] and every byte of a non-ASCII character), else to a space.
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

def alnum_words(text: bytes) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters in UTF-8 text, A-Z lower-cased."""
    return text.translate(ALNUM).split()


def binary_column(batch, name: str):
    """Column of an Arrow batch as bytes, nulls as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    kind = pa.large_binary() if pa.types.is_large_string(batch.column(name).type) else pa.binary()
    return pc.fill_null(batch.column(name).cast(kind), pa.scalar(b"", kind))
