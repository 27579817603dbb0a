"""A folder that all executors share, for tables that are written only to be read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; where that is unset below the warehouse, or in local
    mode below a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        master = spark.sparkContext.master
        here = master.startswith("local") and not master.startswith("local-cluster")
        base = f"file://{tempfile.gettempdir()}/varloom" if here else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_varloom_scratch"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
