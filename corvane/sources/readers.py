"""Scans and sinks: events, panels, cards, corpora, calibration and manifests."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane import schema


def read_events(spark: SparkSession, path: str, nested: bool = False) -> DataFrame:
    """Events in the contract's types; columns a file lacks are null (additive schema)."""
    kind = schema.EVENT if nested else schema.flatten(spark.createDataFrame([], schema.EVENT)).schema
    return spark.read.schema(kind).parquet(path)


def write_events(events: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    events.write.mode(mode).partitionBy(*(partition_by or [])).parquet(path)


def read_panel(spark: SparkSession, paths: list[str], columns: dict[str, tuple[str, str]], required: list[str] | None = None) -> DataFrame:
    """CSV panels as one frame: {source column: (name, type)}; only these columns are parsed.

    A file whose header lacks a required column is refused.
    """
    for path in paths:
        header = spark.read.option("header", True).csv(path).columns
        missing = [c for c in (required or list(columns)) if c not in header]
        if missing:
            raise ValueError(f"{path} lacks the columns {missing}")
    frames = [spark.read.option("header", True).csv(p).select(*[F.col(f"`{c}`").try_cast(t).alias(n) for c, (n, t) in columns.items()]) for p in paths]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


CARD_ID = re.compile(r"^F[1-9]-\d{2}$")
STATUSES = ("draft", "implemented", "discovered")


def read_cards(spark: SparkSession, folder: str) -> DataFrame:
    """YAML cards of a folder, checked: (card_id, family, status, title, signals array<struct<layer, feature>>)."""
    import yaml

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.yaml").load(folder).select("path", F.decode("content", "UTF-8").alias("text")).collect()  # a folder of cards, not data
    rows, seen = [], set()
    for f in files:
        card = yaml.safe_load(f["text"]) or {}
        name = f["path"].rsplit("/", 1)[-1].removesuffix(".yaml")
        card_id = str(card.get("id", ""))
        if not CARD_ID.match(card_id):
            raise ValueError(f"{name}: bad card id {card_id!r}")
        if card_id in seen:
            raise ValueError(f"{card_id} occurs twice")
        if not name.upper().startswith(card_id):
            raise ValueError(f"{name}: the file is not named after {card_id}")
        if card.get("status", "draft") not in STATUSES:
            raise ValueError(f"{name}: bad status")
        seen.add(card_id)
        signals = [(str(s.get("layer", "")), str(s.get("feature", ""))) for s in card.get("observable_signals", [])]
        rows.append((card_id, card_id[:2], card.get("status", "draft"), str(card.get("title", "")), signals))
    return spark.createDataFrame(rows, "card_id string, family string, status string, title string, signals array<struct<layer:string,feature:string>>")


def signals_by_layer(cards: DataFrame) -> DataFrame:
    return cards.select(F.explode("signals").alias("s")).groupBy("s.layer").agg(F.sort_array(F.collect_set("s.feature")).alias("features"))


ARTIFACT = T.StructType([T.StructField(n, T.StringType()) for n in ("artifact", "kind", "title", "text", "source")])
BINDING = T.StructType([T.StructField(n, T.StringType()) for n in ("content_id", "artifact")])


def read_jsonl(spark: SparkSession, path: str, kind: T.StructType) -> DataFrame:
    """JSON lines; lines that do not parse are left out."""
    return spark.read.schema(kind).option("mode", "DROPMALFORMED").json(path).where(F.col(kind.fieldNames()[0]).isNotNull())


def write_jsonl(df: DataFrame, path: str, order: list[str], mode: str = "overwrite") -> None:
    df.orderBy(*order).write.mode(mode).json(path)


@dataclass
class Calibration:
    """Parameters of the simulated population; a JSON file may override them."""

    mean_events_per_day: float = 1.4
    agentic_share: float = 0.12
    decline_share: float = 0.06
    refund_share: float = 0.03
    dispute_share: float = 0.004
    zipf: float = 1.0
    extra: dict[str, float] = field(default_factory=dict)


def read_calibration(spark: SparkSession, path: str | None) -> Calibration:
    """Priors where there is no file; a malformed file is an error."""
    if path is None:
        return Calibration()
    try:
        text = spark.read.text(path, wholetext=True).first()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return Calibration()
        raise
    given = json.loads(text["value"]) if text else {}
    unknown = set(given) - set(asdict(Calibration()))
    if unknown:
        raise ValueError(f"unknown calibration keys {sorted(unknown)}")
    return Calibration(**given)


def write_manifest(spark: SparkSession, path: str, facts: dict) -> None:
    """One JSON object as a small text table."""
    spark.createDataFrame([(json.dumps(facts, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def cached_texts(prompts: DataFrame, cache: DataFrame, template: str = "Page about {kind}, number {key}.") -> DataFrame:
    """(key, text): from a cache keyed by the digest of prompt and kind, else from a fixed template (nothing is generated)."""
    keyed = prompts.withColumn("digest", F.sha2(F.concat_ws("\n", "kind", "prompt"), 256))
    before, _, rest = template.partition("{kind}")
    middle, _, after = rest.partition("{key}")
    made = F.concat(F.lit(before), F.col("kind"), F.lit(middle), F.substring("digest", 1, 8), F.lit(after))
    return keyed.join(cache.select("digest", F.col("text").alias("held")), "digest", "left").select("digest", "kind", F.coalesce("held", made).alias("text"))


def fill_cache(prompts: DataFrame, path: str, template: str = "Page about {kind}, number {key}.") -> DataFrame:
    """``cached_texts`` from the cache at ``path`` (digest, text), to which the texts that it lacked are appended, once a digest."""
    spark = prompts.sparkSession
    try:
        cache = spark.read.schema("digest string, text string").parquet(path)
        cache.limit(1).count()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        cache = spark.createDataFrame([], "digest string, text string")
    new = cached_texts(prompts, cache, template).join(cache.select("digest"), "digest", "left_anti")
    new.select("digest", "text").dropDuplicates(["digest"]).write.mode("append").parquet(path)
    return cached_texts(prompts, spark.read.schema("digest string, text string").parquet(path), template)


def replay(scored: DataFrame, family: str | None, offset: int, limit: int = 600) -> DataFrame:
    """The frames of a replay: legitimate rows and those of one family, rotated by an offset, at most 600."""
    rows = scored.where(~F.col("is_fraud") | F.lit(family is None) | (F.substring("attack_id", 1, 2) == F.lit(family)))
    return rows.orderBy((F.col("seq") < offset).cast("int"), "seq").limit(min(limit, 600))
