"""Folders that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_dir(spark: SparkSession, label: str) -> str:
    """URI of a new folder under spark.checkpoint.dir; where that is unset, under a local folder set once on a single machine, and else under the warehouse."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_lexisweave_dir", None)
    if not base:
        single = sc.master == "local" or sc.master.startswith("local[")
        base = sc._lexisweave_dir = tempfile.mkdtemp(prefix="lexisweave-") if single else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        sc.setCheckpointDir(base)
    if not re.match(r"[a-z][a-z0-9+.-]*:", base):
        base = "file://" + base
    return f"{base.rstrip('/')}/lexisweave/{label}-{uuid.uuid4().hex}"
