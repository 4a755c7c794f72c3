"""Engine options and the Spark settings that stand for them."""

from __future__ import annotations

import os
from typing import Any

#: Option names that have a Spark counterpart.
SPARK_CONF = {
    "JOIN_PARTITION_SIZE_THRESHOLD": "spark.sql.adaptive.advisoryPartitionSizeInBytes",
    "MAX_JOIN_SCATTER_MEM_OVERHEAD": "spark.sql.autoBroadcastJoinThreshold",
    "MAX_DATA_LOAD_CONCAT_CACHE_BYTE_SIZE": "spark.sql.files.maxPartitionBytes",
    "MAX_ORDER_BY_SAMPLES_PER_NODE": "spark.sql.execution.rangeExchange.sampleSizePerPartition",
}
#: What holds while a session plans: no zone, and null instead of an error for x / 0, x % 0 and casts that fail.
PLANNING = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.sql.ansi.enabled": "false",
}
#: Environment variables that begin so stand for options.
ENV_PREFIX = "LUMENFRAME_"


def spark_settings(options: dict[str, Any] | None) -> dict[str, str]:
    """Spark settings for engine options; keys that start with ``spark.`` pass through.

    Options without a counterpart (threads, transport, logs of other engines)
    are accepted and have no effect.
    """
    options = {k[len(ENV_PREFIX) :]: v for k, v in os.environ.items() if k.startswith(ENV_PREFIX)} | dict(options or {})
    out = {}
    for name, value in options.items():
        if isinstance(name, bytes):
            name = name.decode()
        if name.startswith("spark."):
            out[name] = str(value)
        elif name in SPARK_CONF:
            out[SPARK_CONF[name]] = str(int(value))
    return out
