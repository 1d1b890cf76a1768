"""Sources: Parquet tables, text corpora, manifests, JSON indexes and captured tool output."""

from __future__ import annotations

import json

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: texts that hold it give a second entry, cut after it.
END_MARK = "END OF TERMS AND CONDITIONS"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """Paths, contents and names of all files below `path`; resource forks (`._*`) are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(path)
    return found.withColumn("name", F.element_at(F.split("path", "/"), -1)).where(~F.col("name").startswith("._"))


def library_files(listing: DataFrame, root: str, suffix: str) -> DataFrame:
    """Files below root/lib that end in the suffix, sorted by path. The global sort is over paths only."""
    inside = F.col("path").startswith(f"{root.rstrip('/')}/lib/")
    return listing.where(inside & F.col("path").endswith(suffix)).select("path").orderBy("path")


def decoded(content: Column) -> tuple[Column, Column]:
    """Text of bytes, broken sequences replaced, and whether any was broken."""
    return F.make_valid_utf8(content.cast("string")), ~F.is_valid_utf8(content.cast("string"))


def corpus(texts: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(id, content) of the known texts <id>.txt; any other file and any odd id is an error. A text with END_MARK is there
    twice, whole and cut after the mark, under one id."""
    name = F.element_at(F.split(F.col(path), "/"), -1)
    ident = F.regexp_extract(name, r"^([A-Za-z0-9\-_.+]+)\.txt$", 1)
    ident = F.when(ident == "", F.raise_error(F.concat(F.lit("not a known text: "), name)).cast("string")).otherwise(ident)
    whole = F.col(content)
    cut = F.concat(F.substring_index(whole, END_MARK, 1), F.lit(END_MARK))
    both = F.when(whole.contains(END_MARK), F.array(whole, cut)).otherwise(F.array(whole))
    return texts.select(ident.alias("id"), F.explode(both).alias("content")).orderBy("id", F.length("content"), "content")


def own_text(files_: DataFrame, wanted: str = "LICENSE") -> DataFrame:
    """Only files of exactly that name."""
    return files_.where(F.element_at(F.split("path", "/"), -1) == wanted)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def id_lists(maps: DataFrame, key: str = "path", ids: str = "ids") -> DataFrame:
    """Rows of a map from path to ids, with each id's place."""
    return maps.select(key, F.posexplode(ids).alias("ord", "id"))


def list_argument(values: DataFrame, column: str) -> DataFrame:
    """Names of a comma list or of a text of one a line, trimmed, in order, empties left out."""
    parts = F.posexplode(F.split(F.col(column), r"[,\n]"))
    return values.select(parts.alias("ord", "name")).select("ord", F.trim("name").alias("name")).where("name <> ''")


def fresh_entries(cache: DataFrame, as_of: Column, hours: int = 4) -> DataFrame:
    """Cache rows (key, value, ts) that are not older than their time to live; of equal keys the newest."""
    live = cache.where(F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(hours)) >= as_of)
    return live.groupBy("key").agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("ts"))


def cache_file(kind: Column, ident: Column) -> Column:
    """Name of a cache file: up to 40 letters and digits of the id, then its SHA-256."""
    return F.concat(kind, F.lit("/"), F.substring(F.regexp_replace(F.lower(ident), "[^a-z0-9]", ""), 1, 40), F.lit("-"), F.sha2(ident, 256))


def version_listing(listings: DataFrame, key: str = "package", body: str = "body") -> DataFrame:
    """(package, version, published) of each listing, a JSON text of a repository's answer; a version without a date counts
    as of the epoch, and an answer with a version that has no name gives no rows at all."""
    kind = "struct<versions:array<struct<version:string,published:string>>>"
    v = F.from_json(body, kind)["versions"]
    good = F.when(F.forall(v, lambda x: x["version"].isNotNull()), v)
    each = listings.select(key, F.explode(good).alias("v"))
    return each.select(key, F.col("v.version").alias("version"), F.coalesce(F.try_to_timestamp("v.published"), F.timestamp_seconds(F.lit(0))).alias("published"))


def settings(path: str | None, defaults: dict) -> dict:
    """A configuration file, YAML or JSON by its ending, over the defaults; no path: the defaults. Read on the driver."""
    if path is None:
        return dict(defaults)
    if not path.endswith((".yaml", ".yml", ".json")):
        raise ValueError(f"neither YAML nor JSON: {path}")
    with open(path, encoding="utf-8") as f:
        found = json.load(f) if path.endswith(".json") else yaml.safe_load(f)
    if not isinstance(found or {}, dict):
        raise ValueError(f"no map of settings: {path}")
    return dict(defaults) | (found or {})


def tree_listing(raw: Column) -> Column:
    """Paths of NUL-separated listing output."""
    return F.filter(F.split(raw, "\u0000"), lambda p: p != "")


def write_report(df: DataFrame, path: str) -> None:
    """JSON lines; nulls are left out."""
    df.write.json(path)
