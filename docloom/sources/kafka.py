"""Kafka in and out: record codecs as columns, options, and the streams on top.

The codecs need no broker. ``read_changes`` and ``write_changes`` need Spark's Kafka connector on the
class path. Spark keeps consumed offsets in its checkpoint and its sink is at-least-once: a start from
a group's committed offsets and exactly-once delivery are refused or documented, not imitated.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from ..errors import ConfigurationError
from ..names import checked_name, uid
from ..operators.changes import DELETE, Key, changes_from

Decoder = Callable[[Column], Column]
Encoder = Callable[[Column], Column]

# Properties that the options set themselves.
RESERVED_SOURCE = ("bootstrap.servers", "group.id")
RESERVED_SINK = ("bootstrap.servers", "transactional.id")


def _text(value: str, what: str) -> str:
    if not isinstance(value, str) or not value.strip():
        raise ConfigurationError(f"{what} must not be blank")
    return value


def _properties(given: dict[str, str], reserved: tuple[str, ...]) -> dict[str, str]:
    taken = [k for k in reserved if k in given]
    if taken:
        raise ConfigurationError(f"properties {taken} are set by the options themselves")
    return dict(given)


@dataclass(frozen=True)
class KafkaSourceOptions:
    """``starting_offsets`` counts for a query's first start; after that its checkpoint does."""

    bootstrap_servers: str
    topic: str
    group_id: str
    starting_offsets: str = "earliest"
    properties: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        for name in ("bootstrap_servers", "topic", "group_id", "starting_offsets"):
            _text(getattr(self, name), name)
        _properties(self.properties, RESERVED_SOURCE)

    def reader(self) -> dict[str, str]:
        own = {"kafka.bootstrap.servers": self.bootstrap_servers, "subscribe": self.topic, "kafka.group.id": self.group_id, "startingOffsets": self.starting_offsets}
        return own | {f"kafka.{k}": v for k, v in self.properties.items()}


@dataclass(frozen=True)
class KafkaSinkOptions:
    """``delivery`` is 'at-least-once'. 'exactly-once' needs a transactional sink, which Spark's is not."""

    bootstrap_servers: str
    topic: str
    delivery: str = "at-least-once"
    transactional_id_prefix: str | None = None
    properties: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        _text(self.bootstrap_servers, "bootstrap_servers")
        _text(self.topic, "topic")
        _properties(self.properties, RESERVED_SINK)
        if self.delivery == "exactly-once":
            if self.transactional_id_prefix is None:
                raise ConfigurationError("exactly-once delivery needs a transactional_id_prefix")
            raise ConfigurationError("exactly-once delivery is not available: Spark's Kafka sink has no transactions. Readers that keep the last value per key see the same result with at-least-once")
        if self.delivery not in ("at-least-once", "none"):
            raise ConfigurationError(f"delivery {self.delivery!r} is not known")
        if self.transactional_id_prefix is not None:
            raise ConfigurationError("transactional_id_prefix is for exactly-once delivery only")

    def writer(self) -> dict[str, str]:
        return {"kafka.bootstrap.servers": self.bootstrap_servers, "topic": self.topic} | {f"kafka.{k}": v for k, v in self.properties.items()}


def json_decoder(schema: T.StructType) -> Decoder:
    """JSON text to a struct; text that is no such JSON fails the job, missing fields are null."""
    return lambda value: F.from_json(F.decode(value, "UTF-8"), schema, {"mode": "FAILFAST"})


def json_encoder(value: Column) -> Column:
    """A struct as JSON text in UTF-8; null fields are written."""
    return F.encode(F.to_json(value, {"ignoreNullFields": "false"}), "UTF-8")


@dataclass(frozen=True)
class SchemaRegistry:
    """The part of a Confluent-style schema registry that codecs need."""

    url: str

    def __post_init__(self):
        _text(self.url, "schema registry url")

    def register(self, subject: str, schema: str) -> int:
        """The id of ``schema`` under ``subject``, which is the same each time."""
        body = json.dumps({"schema": schema}).encode()
        headers = {"Content-Type": "application/vnd.schemaregistry.v1+json"}
        address = f"{self.url.rstrip('/')}/subjects/{quote(subject, safe='')}/versions"
        with urllib.request.urlopen(urllib.request.Request(address, body, headers, method="POST"), timeout=30) as answer:
            return int(json.loads(answer.read())["id"])


def framed(payload: Column, schema_id: int) -> Column:
    """Registry framing: a zero byte, the schema id as four bytes, the payload."""
    return F.concat(F.lit(b"\x00" + schema_id.to_bytes(4, "big")), payload)


def unframed(value: Column) -> Column:
    """The payload behind the frame; a value without one fails the job."""
    bad = F.raise_error(F.lit("value has no schema registry frame")).cast("binary")
    fine = (F.length(value) >= 5) & (F.hex(F.substring(value, 1, 1)) == "00")
    return F.when(value.isNull(), F.lit(None).cast("binary")).when(fine, F.substring(value, 6, (1 << 31) - 1)).otherwise(bad)


def avro_decoder(schema: str) -> Decoder:
    """Framed Avro records to a struct. Needs Spark's Avro package."""
    from pyspark.sql.avro.functions import from_avro

    return lambda value: from_avro(unframed(value), schema, {"mode": "FAILFAST"})


def avro_encoder(schema: str, schema_id: int) -> Encoder:
    """A struct to a framed Avro record. Needs Spark's Avro package."""
    from pyspark.sql.avro.functions import to_avro

    return lambda value: framed(to_avro(value, schema), schema_id)


@dataclass(frozen=True)
class DeleteFlag:
    """Soft deletes: a condition on the decoded value."""

    condition: Key


def decode_records(records: DataFrame, decode: Decoder) -> DataFrame:
    """Records (``value, topic, partition, offset``) with decoded values.

    A record without value fails the job and is named in the message. A value that the decoder makes
    null is left out.
    """
    place = F.concat_ws("", "topic", F.lit("-"), F.col("partition").cast("string"), F.lit("@"), F.col("offset").cast("string"))
    tombstone = F.raise_error(F.concat(F.lit("tombstones are not supported, flag deletes in the value: "), place)).cast("binary")
    checked = F.when(F.col("value").isNull(), tombstone).otherwise(F.col("value"))
    return records.withColumn("value", decode(checked)).where(F.col("value").isNotNull())


def changes_from_records(name: str, records: DataFrame, decode: Decoder, id: Key, deletes: DeleteFlag, order: str = "offset") -> DataFrame:
    """Records as changes, ordered by ``order``: 'offset', or 'timestamp' in milliseconds with the offset after it.

    Changes of an id come from one partition, where the offset orders them. Streams compare nothing
    else: each step numbers what it emits. A batch replay or snapshot of several topics lays their
    changes on one line, for which it needs 'timestamp', set by the broker so that it does not fall.
    """
    if order not in ("offset", "timestamp"):
        raise ConfigurationError(f"order {order!r} is neither offset nor timestamp")
    at = F.col("offset") if order == "offset" else F.unix_millis("timestamp")
    rows = decode_records(records, decode).select("value.*", at.alias("__order"), F.col("offset").alias("__offset"))
    fields = [c for c in rows.columns if c not in ("__order", "__offset")]
    return changes_from(
        name, rows, id, deletes.condition, lambda r: r["__order"], lambda r: F.struct(*[r[f].alias(f) for f in fields]), None if order == "offset" else lambda r: r["__offset"]
    )


def encode_changes(changes: DataFrame, encode: Encoder = json_encoder) -> DataFrame:
    """``key, value`` records: the id in UTF-8, and the encoded value or, for a delete, none."""
    value = F.when(F.col("kind") != DELETE, encode(F.col("value")))
    return changes.select(F.encode("id", "UTF-8").alias("key"), value.alias("value"))


def read_changes(name: str, spark: SparkSession, options: KafkaSourceOptions, decode: Decoder, id: Key, deletes: DeleteFlag) -> DataFrame:
    """One topic as a stream of changes in the order of the offsets, without watermark."""
    records = spark.readStream.format("kafka").options(**options.reader()).load()
    return changes_from_records(checked_name(name, "source name"), records, decode, id, deletes)


def write_changes(name: str, changes: DataFrame, options: KafkaSinkOptions, checkpoint: str, encode: Encoder = json_encoder) -> DataStreamWriter:
    """A writer of the changes to a topic, to be started."""
    out = encode_changes(changes, encode).writeStream.format("kafka").options(**options.writer())
    return out.queryName(uid("kafka_sink", name)).option("checkpointLocation", f"{checkpoint}/{uid('kafka_sink', name)}").outputMode("update")
