"""What a session needs to run this package's code in its Python workers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


#: Python workers stay between tasks; large buffers that they free go back to the system.
WORKER_MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_TRIM_THRESHOLD_": "1048576"}
#: Arrow batches to Python hold so many rows and bytes at most; a session's smaller limits stay.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 4096, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver found it, and bounds their memory.

    On clusters without a shared code folder, pass the package with ``--py-files`` as usual.
    """
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, path) if x)
    for name, value in WORKER_MEMORY.items():
        env.setdefault(name, value)
    for name, most in BATCH.items():
        now = spark.conf.get(name, None)
        digits = (now or "").rstrip("bB")
        if not (digits.isdigit() and 0 < int(digits) <= most):
            spark.conf.set(name, str(most))
