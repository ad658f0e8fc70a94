"""Continuous ingestion: messages from any stream source, upserted batch by batch into a store."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.plans.catalog import TableDef
from tidemark.sources.rows import from_messages
from tidemark.sources.store import Store


def kafka(spark: SparkSession, servers: str, topic: str, most_per_batch: int = 1_000_000) -> DataFrame:
    """A topic's messages. The bound on a batch's size is what keeps late floods from piling up."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("maxOffsetsPerTrigger", most_per_batch).load()


def start(stream: DataFrame, store: Store, checkpoint: str, modes: dict[str, str] | None = None, order: str | None = None,
          name: str = "stream", every: str | None = None, now: int | None = None, attempts: int = 5, wait: float = 1.0) -> StreamingQuery:
    """Upserts each batch of the stream. A batch that is delivered again is known by its number and left alone, so sums
    stay right; late rows are put aside, never dropped by a watermark. A batch that fails is tried again, after twice as long
    each time, before the stream fails with it; nothing of a failed attempt is seen."""

    def take(batch: DataFrame, batch_id: int) -> None:
        rows = from_messages(batch, store.table) if "value" in batch.columns else batch
        for attempt in range(attempts):
            try:
                store.ingest(rows, modes, order, now, stream=name, batch_id=batch_id)
                return
            except Exception:
                if attempt + 1 == attempts:
                    raise
                time.sleep(wait * 2**attempt)

    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def to_kafka(df: DataFrame, table: TableDef, servers: str, topic: str, shards: int) -> None:
    """Writes rows to a topic as messages."""
    to_messages(df, table, shards).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def to_messages(df: DataFrame, table: TableDef, shards: int) -> DataFrame:
    """Rows as JSON messages, keyed by primary key and dealt to partitions by it, for a Kafka sink."""
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in table.primary_key])
    return df.select(key.alias("key"), F.to_json(F.struct(*df.columns)).alias("value"), F.pmod(F.xxhash64(*table.primary_key), F.lit(shards)).cast("int").alias("partition"))
