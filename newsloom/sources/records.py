"""Line-delimited JSON caches, CSV and JSON reports, configuration, pre-fetched search results."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PipelineConfig:
    """Parameters of a run; unknown names are refused."""

    data: str
    output: str
    split_time: str = "2016-01-29 00:00:00"
    similarity: float = 0.3
    window_hours: int = 72
    high_df_ratio: float = 0.01
    entity_mode: str = "normalize_only"
    entity_version: str = "v2"
    semantic_ids: str | None = None
    embeddings: str | None = None
    embedding_width: int = 768
    stop_on_fail: bool = True
    required: dict[str, list[str]] = field(default_factory=dict)

    @classmethod
    def read(cls, path: str) -> PipelineConfig:
        """From JSON, or from YAML where a reader for it is installed."""
        with open(path, encoding="utf-8") as f:
            if not path.endswith((".yaml", ".yml")):
                return cls(**json.load(f))
            try:
                import yaml
            except ImportError as e:
                raise ValueError(f"{path} is YAML, and no reader for it is installed; JSON needs none") from e
            return cls(**yaml.safe_load(f))


def read_cache(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """A JSON-lines cache: malformed lines are skipped, the last record of a key wins.

    Lines are ordered by file name and place in the file (lines of one append keep their order).
    """
    raw = spark.read.text(path).withColumns({"__file": F.col("_metadata.file_name"), "__block": F.col("_metadata.file_block_start"), "__at": F.monotonically_increasing_id()})
    rows = raw.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), "__file", "__block", "__at").where(F.col(f"r.{key}").isNotNull())
    w = Window.partitionBy(f"r.{key}").orderBy(F.desc("__file"), F.desc("__block"), F.desc("__at"))
    return rows.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").select("r.*")


def append_cache(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text file on any file system: written beside its place, then moved there whole."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()  # noqa: SLF001
    target = jvm.org.apache.hadoop.fs.Path(path)
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex[:8]}.part")
    fs = target.getFileSystem(conf)
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"{path} can't be written")


def write_report(spark: SparkSession, report: dict, path: str) -> dict:
    """Metrics as a JSON file; returns them."""
    write_text(spark, json.dumps(report, ensure_ascii=False, indent=2, default=str) + "\n", path)
    return report


def claim_ids(payload, prop: str):
    """Ids that an entity's claims name under a property, from the JSON of an entity record."""
    schema = f"struct<claims: struct<{prop}: array<struct<mainsnak: struct<datavalue: struct<value: struct<id: string>>>>>>>"
    ids = F.transform(F.from_json(payload, schema)["claims"][prop], lambda c: c["mainsnak"]["datavalue"]["value"]["id"])
    return F.array_compact(F.coalesce(ids, F.array().cast("array<string>")))


#: Cached searches, one JSON line an entity; what ``search.hits_of`` reads.
SEARCH_CACHE = "entity_group string, canonical_entity string, canonical_entity_key string, searches array<struct<language: string, results: array<struct<id: string, label: string, description: string, match: struct<text: string>>>>>"


def entity_record(payload, languages: tuple[str, ...] = ("da", "en")):
    """An entity record from its JSON: struct(missing, label and description by language, label in the first language that has one or else the id, P31 and P279 ids)."""
    texts = ", ".join(f"{x}: struct<value: string>" for x in languages)
    r = F.from_json(payload, f"struct<id: string, missing: string, labels: struct<{texts}>, descriptions: struct<{texts}>>")
    named = [F.nullif(r["labels"][x]["value"], F.lit("")) for x in languages]
    return F.struct(
        r["id"].alias("qid"), r["missing"].isNotNull().alias("missing"), *[n.alias(f"label_{x}") for n, x in zip(named, languages, strict=True)],
        *[r["descriptions"][x]["value"].alias(f"description_{x}") for x in languages], F.coalesce(*named, r["id"]).alias("label"), claim_ids(payload, "P31").alias("p31"), claim_ids(payload, "P279").alias("p279"),
    )
