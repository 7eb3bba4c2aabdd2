"""The one place that makes sessions."""

from __future__ import annotations

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def session(name: str = "tidemark", **conf: str) -> SparkSession:
    """UTC, adaptive execution and the RocksDB state store; ``conf`` adds to that, dots as double underscores."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    }
    base |= {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.appName(name).config(map=base).getOrCreate()
