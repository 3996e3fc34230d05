"""Sources beside Parquet: entity lists as CSV, profile configuration as YAML or JSON, JSON reports as sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as X
from ..plans.tables import read
from ..session import scratch_path


def entities(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entities (type, name) and their aliases (name, alias, norm) from a CSV file with |-separated aliases.

    Rows without a type or name are skipped; the first spelling of a name or alias stays."""
    raw = spark.read.csv(path, header=True, schema="type string, name string, aliases string")
    good = raw.where((F.trim("type") != "") & (F.trim("name") != "")).select(F.trim("type").alias("type"), F.trim("name").alias("name"), "aliases")
    names = good.groupBy("type", "name").agg(F.first("aliases").alias("aliases"))
    spelled = good.select("name", F.explode(F.concat(F.array("name"), F.coalesce(F.split("aliases", r"\|"), F.array().cast("array<string>")))).alias("alias"))
    aliases = spelled.select("name", F.trim("alias").alias("alias"), X.normalize(F.col("alias")).alias("norm")).where("norm <> ''")
    return names.select("type", "name"), aliases.groupBy("name", "norm").agg(F.min("alias").alias("alias"))


def load_config(text: str) -> dict:
    """A profile's configuration from YAML, or from JSON where no YAML library is installed."""
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


def dump_config(tree: dict) -> str:
    """The configuration as text that load_config reads back, keys in order."""
    return json.dumps(tree, indent=2, sort_keys=True, ensure_ascii=False)


def entity_import(spark, d):
    """The parts written as a CSV entity list and read back."""
    path = scratch_path(spark, "entities")
    p = read(spark, d, "part").select(F.when(F.col("p_partkey") % 50 == 0, "").otherwise(F.col("p_type")).alias("type"), F.concat("p_brand", F.lit(" "), "p_partkey").alias("name"), F.concat("p_name", F.lit("|no "), F.col("p_partkey")).alias("aliases"))
    p.write.csv(path, header=True)
    names, aliases = entities(spark, path)
    return names.join(aliases, "name").groupBy("type").agg(F.count_distinct("name").alias("n_entities"), F.count(F.lit(1)).alias("n_aliases"))


QUERIES = {"entity_import": entity_import}
ORACLES = {"entity_import": "SELECT p_type AS type, count(*) AS n_entities, 3 * count(*) AS n_aliases FROM part WHERE p_partkey % 50 <> 0 GROUP BY p_type"}
