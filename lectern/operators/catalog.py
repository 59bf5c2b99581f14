"""Incremental state of the document catalogue: what to ingest, what is gone, what is excluded, the page cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARSER_VERSION = 4


def with_hash(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumn("sha256", F.sha2(F.col(content), 256))


def plan_ingest(files: DataFrame, catalog: DataFrame, excluded: DataFrame, version: int = PARSER_VERSION,
                force: Column | bool = False) -> DataFrame:
    """Add ``result`` per file: excluded, skipped (same content, no error, same parser) or ingest.

    ``force`` (a flag, or a condition on path or course) ingests unchanged files again; it never overrides exclusion.
    """
    force = F.lit(force) if isinstance(force, bool) else F.coalesce(force, F.lit(False))
    have = catalog.select("path", F.col("sha256").alias("_sha"), F.col("status").alias("_status"),
                          F.col("parser_version").alias("_version"))
    out = excluded.select("path").distinct().withColumn("_out", F.lit(True))
    j = files.join(have, "path", "left").join(out, "path", "left")
    same = (F.col("_sha") == F.col("sha256")) & (F.col("_status") != "error") & (F.col("_version") == version)
    result = (F.when(F.col("_out"), "excluded").when(~force & F.coalesce(same, F.lit(False)), "skipped")
              .otherwise("ingest"))
    return j.withColumn("result", result).drop("_sha", "_status", "_version", "_out")


def result_counts(planned: DataFrame) -> DataFrame:
    return planned.groupBy("result").agg(F.count("*").alias("n"))


def gone(catalog: DataFrame, planned: DataFrame) -> DataFrame:
    """Catalogue rows whose file was not seen; an excluded file counts as not seen."""
    return catalog.join(planned.filter("result <> 'excluded'").select("path"), "path", "left_anti")


def under_folders(catalog: DataFrame, folders: DataFrame, path: str = "path") -> DataFrame:
    """Paths inside any of the folders, as an equi-join on each path's parent folders (``Prob`` is not ``Prob 2``)."""
    parts = F.split(path, "/")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts) - 1),
                          lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    rows = catalog.filter(F.col(path).contains("/")).select(path, F.explode(parents).alias("folder"))
    return rows.join(folders.select("folder"), "folder", "left_semi").select(path).distinct()


def remove_prefix(catalog: DataFrame, folders: DataFrame) -> DataFrame:
    """The catalogue without everything under the given folders."""
    return catalog.join(under_folders(catalog, folders), "path", "left_anti")


def exclude(catalog: DataFrame, excluded: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(catalogue without the paths, exclusion list with them); repeating it changes nothing."""
    listed = excluded.select("path").union(paths.select("path")).distinct()
    return catalog.join(paths.select("path"), "path", "left_anti"), listed


def include(excluded: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(exclusion list without the paths, the paths that really were excluded and are to be ingested again)."""
    return (excluded.join(paths.select("path"), "path", "left_anti"),
            excluded.join(paths.select("path"), "path", "left_semi").select("path").distinct())


def to_parse(docs: DataFrame, cache: DataFrame, version: int = PARSER_VERSION) -> DataFrame:
    """One document per content that the page cache does not hold for this parser version. Nulls have no content."""
    have = cache.filter(F.col("parser_version") == version).select("sha256")
    return docs.filter("sha256 is not null").dropDuplicates(["sha256"]).join(have, "sha256", "left_anti")


def store_pages(cache: DataFrame, new: DataFrame, replace: bool = False) -> DataFrame:
    """Cache with the new entries (sha256, parser_version, pages): inserted if absent, or replacing."""
    key = ["sha256", "parser_version"]
    new = new.dropDuplicates(key).select(*cache.columns)
    if replace:
        return cache.join(new.select(*key), key, "left_anti").select(*cache.columns).unionByName(new)
    return cache.unionByName(new.join(cache.select(*key), key, "left_anti").select(*cache.columns))


def prune_pages(cache: DataFrame, docs: DataFrame, version: int = PARSER_VERSION) -> DataFrame:
    """Drop entries of other parser versions and of contents no document has any more."""
    live = docs.select("sha256").distinct()
    return cache.filter(F.col("parser_version") == version).join(live, "sha256", "left_semi")
