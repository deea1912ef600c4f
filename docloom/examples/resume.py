"""Worked example: candidates with their experiences, these with projects and company names, and skills.

Run as ``python -m docloom.examples.resume --bootstrap-servers ... --output kafka --checkpoint ...``.
"""

from __future__ import annotations

import argparse
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigurationError
from ..operators.lookup import Lookup
from ..operators.nest import Nest
from ..sources import kafka, search
from ..streaming import ROCKSDB

# Topics and schemas of the example.
TOPICS = {n: f"resume.{n}" for n in ("candidates", "skills", "companies", "experiences", "projects")}
DOCUMENTS_TOPIC = "resume.candidate-docs"
SCHEMAS = {
    "candidates": "id string, name string, deleted boolean",
    "skills": "id string, candidateId string, name string, deleted boolean",
    "companies": "id string, name string, deleted boolean",
    "experiences": "id string, candidateId string, title string, companyId string, companyName string, deleted boolean",
    "projects": "id string, experienceId string, name string, deleted boolean",
}

# Avro schema of the documents.
_STRINGS = {"type": "array", "items": "string"}
_EXPERIENCE = {
    "type": "record",
    "name": "ExperienceDoc",
    "fields": [
        {"name": "id", "type": "string"}, {"name": "candidateId", "type": "string"}, {"name": "title", "type": "string"},
        {"name": "companyName", "type": ["null", "string"], "default": None}, {"name": "projects", "type": _STRINGS},
    ],
}
DOCUMENT_AVRO = json.dumps(
    {
        "type": "record",
        "name": "CandidateDoc",
        "fields": [
            {"name": "id", "type": "string"}, {"name": "name", "type": "string"},
            {"name": "experiences", "type": {"type": "array", "items": _EXPERIENCE}}, {"name": "skills", "type": _STRINGS},
        ],
    }
)


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


def _with_company(experience: Column, company: Column) -> Column:
    return experience.withField("companyName", company["name"])


def candidate_documents(inputs: dict[str, DataFrame], mode: str | None = None) -> DataFrame:
    """The documents' changes from the five inputs' changes."""
    named = Lookup.of("company", inputs["experiences"], lambda v: v["companyId"]).from_(inputs["companies"]).enrich(_with_company, mode)
    experience = Nest.parent("experience", named)
    projects = experience.child("projects", inputs["projects"], lambda v: v["experienceId"])
    experiences = experience.assemble(
        lambda p, c: F.struct(p["id"].alias("id"), p["candidateId"].alias("candidateId"), p["title"].alias("title"), p["companyName"].alias("companyName"), F.transform(c[projects], lambda x: x["name"]).alias("projects")),
        mode,
    )
    candidate = Nest.parent("candidate", inputs["candidates"])
    experience_slot = candidate.child("experiences", experiences, lambda v: v["candidateId"])
    skill_slot = candidate.child("skills", inputs["skills"], lambda v: v["candidateId"])
    return candidate.assemble(
        lambda p, c: F.struct(p["id"].alias("id"), p["name"].alias("name"), c[experience_slot].alias("experiences"), F.transform(c[skill_slot], lambda x: x["name"]).alias("skills")),
        mode,
    )


@dataclass(frozen=True)
class Config:
    bootstrap_servers: str
    format: str
    output: str
    checkpoint: str
    schema_registry_url: str | None = None
    search_hosts: tuple[str, ...] = ()
    search_index: str | None = None

    @classmethod
    def parse(cls, args: list[str] | None = None) -> Config:
        p = argparse.ArgumentParser(description=__doc__)
        for flag in ("--bootstrap-servers", "--schema-registry-url", "--elasticsearch-hosts", "--elasticsearch-index", "--checkpoint"):
            p.add_argument(flag)
        p.add_argument("--format", default="json")
        p.add_argument("--output", default="kafka")
        a = p.parse_args(args)

        def need(value: str | None, flag: str) -> str:
            if not value:
                raise ConfigurationError(f"{flag} is required")
            return value

        if a.format not in ("json", "avro"):
            raise ConfigurationError(f"--format {a.format!r} is neither json nor avro")
        if a.output not in ("kafka", "elasticsearch"):
            raise ConfigurationError(f"--output {a.output!r} is neither kafka nor elasticsearch")
        registry = need(a.schema_registry_url, "--schema-registry-url") if a.format == "avro" else None
        hosts = tuple(need(a.elasticsearch_hosts, "--elasticsearch-hosts").split(",")) if a.output == "elasticsearch" else ()
        index = need(a.elasticsearch_index, "--elasticsearch-index") if a.output == "elasticsearch" else None
        return cls(need(a.bootstrap_servers, "--bootstrap-servers"), a.format, a.output, need(a.checkpoint, "--checkpoint"), registry, hosts, index)


def decoder(config: Config, name: str) -> kafka.Decoder:
    """JSON, or Avro in the registry's framing, which needs Spark's Avro package."""
    return kafka.json_decoder(schema(name)) if config.format == "json" else kafka.avro_decoder(avro_schema(name))


def encoder(config: Config) -> kafka.Encoder:
    """The format of the documents; an index always gets JSON."""
    if config.format == "json" or config.output != "kafka":
        return kafka.json_encoder
    schema_id = kafka.SchemaRegistry(config.schema_registry_url).register(f"{DOCUMENTS_TOPIC}-value", DOCUMENT_AVRO)
    return kafka.avro_encoder(DOCUMENT_AVRO, schema_id)


def avro_schema(name: str) -> str:
    """The Avro record schema of an input; ``deleted`` is false and ``companyName`` null where missing."""
    fields = []
    for f in schema(name):
        kind: object = "boolean" if isinstance(f.dataType, T.BooleanType) else "string"
        field = {"name": f.name, "type": kind}
        if f.name == "deleted":
            field["default"] = False
        if f.name == "companyName":
            field |= {"type": ["null", "string"], "default": None}
        fields.append(field)
    return json.dumps({"type": "record", "name": name.rstrip("s").capitalize(), "fields": fields})


def main(args: list[str] | None = None) -> None:
    config = Config.parse(args)
    spark = SparkSession.builder.appName("resume-search").config("spark.sql.streaming.stateStore.providerClass", ROCKSDB).getOrCreate()
    flag = kafka.DeleteFlag(lambda r: F.coalesce(r["deleted"], F.lit(False)))
    inputs = {}
    for name, topic in TOPICS.items():
        options = kafka.KafkaSourceOptions(config.bootstrap_servers, topic, "resume-search")
        inputs[name] = kafka.read_changes(name, spark, options, decoder(config, name), lambda r: r["id"], flag)
    documents = candidate_documents(inputs)
    if config.output == "kafka":
        writer = kafka.write_changes("candidate-docs", documents, kafka.KafkaSinkOptions(config.bootstrap_servers, DOCUMENTS_TOPIC), config.checkpoint, encoder(config))
    else:
        writer = search.stream_changes("candidate-docs", documents, search.SearchSinkOptions(config.search_hosts, config.search_index), config.checkpoint)
    writer.start().awaitTermination()


if __name__ == "__main__":
    main()
