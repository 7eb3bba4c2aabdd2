"""Topics: Kafka where its connector is on the class path, else directories of JSON lines.

A record has key, value (both text), topic and timestamp either way, so pipelines don't
see the difference. A directory topic is a folder of text files, one record a line:
{"key": ..., "value": ..., "timestamp": ms}.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "key string, value string, timestamp long"
#: The port on which brokers ask for TLS and IAM.
SECURE_PORT = ":9098"


def security_options(bootstrap: str) -> dict[str, str]:
    """Client options for brokers on SECURE_PORT; none for others."""
    if SECURE_PORT not in bootstrap:
        return {}
    return {
        "kafka.security.protocol": "SASL_SSL",
        "kafka.sasl.mechanism": "AWS_MSK_IAM",
        "kafka.sasl.jaas.config": "software.amazon.msk.auth.iam.IAMLoginModule required;",
        "kafka.sasl.client.callback.handler.class": "software.amazon.msk.auth.iam.IAMClientCallbackHandler",
    }


@dataclass(frozen=True)
class Topic:
    """A topic by broker and name, or by directory."""

    name: str
    bootstrap: str | None = None
    directory: str | None = None
    group_id: str | None = None
    startup: str = "earliest"
    options: dict[str, str] = field(default_factory=dict)

    def records(self, spark: SparkSession, streaming: bool = False) -> DataFrame:
        """key, value, topic, timestamp."""
        reader = spark.readStream if streaming else spark.read
        if self.directory:
            lines = reader.schema(RECORD).format("json").options(**self.options).load(f"{self.directory}/{self.name}")
            return lines.select("key", "value", F.lit(self.name).alias("topic"), F.timestamp_millis("timestamp").alias("timestamp"))
        start = {"earliest-offset": "earliest", "latest-offset": "latest", "group-offsets": "latest"}.get(self.startup, self.startup)
        options = {"kafka.bootstrap.servers": self.bootstrap, "subscribe": self.name, "startingOffsets": start} | security_options(self.bootstrap or "") | self.options
        if self.group_id:
            options["kafka.group.id"] = self.group_id
        rows = reader.format("kafka").options(**options).load()
        return rows.select(F.col("key").cast("string"), F.col("value").cast("string"), "topic", "timestamp")

    def rows(self, spark: SparkSession, schema: str, streaming: bool = False, tolerant: bool = True) -> DataFrame:
        """JSON values as columns. Tolerant: missing fields are null, what doesn't parse is left out; else it fails."""
        mode = "PERMISSIVE" if tolerant else "FAILFAST"
        records = self.records(spark, streaming)
        bad = "_corrupt string"
        parsed = records.select(F.from_json("value", f"{schema}, {bad}", {"mode": mode, "columnNameOfCorruptRecord": "_corrupt"} if tolerant else {"mode": mode}).alias("r"))
        good = parsed.where(F.col("r").isNotNull() & F.col("r._corrupt").isNull())
        return good.select("r.*").drop("_corrupt")

    def encode(self, df: DataFrame, keys: list[str] | None = None, timestamp: Column | None = None) -> DataFrame:
        """Rows as records: JSON of the key fields, JSON of all."""
        key = F.to_json(F.struct(*keys)) if keys else F.lit(None).cast("string")
        ms = F.unix_millis(timestamp) if timestamp is not None else F.lit(0).cast("long")
        return df.select(key.alias("key"), F.to_json(F.struct(*df.columns)).alias("value"), ms.alias("timestamp"))

    def write(self, df: DataFrame, keys: list[str] | None = None, checkpoint: str | None = None, name: str | None = None):
        """Appends a batch, or starts a checkpointed stream of what is there and returns its query."""
        records = self.encode(df, keys)
        if not df.isStreaming:
            if self.directory:
                records.write.mode("append").json(f"{self.directory}/{self.name}")
            else:
                records.write.format("kafka").option("kafka.bootstrap.servers", self.bootstrap).option("topic", self.name).save()
            return None
        writer = records.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        writer = writer.queryName(name) if name else writer
        if self.directory:
            return writer.format("json").start(f"{self.directory}/{self.name}")
        return writer.format("kafka").option("kafka.bootstrap.servers", self.bootstrap).option("topic", self.name).start()
