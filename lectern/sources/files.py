"""Reading a folder of course files and a log of JSON event lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

EVENT_SCHEMA = T.StructType([
    T.StructField("job", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("action", T.StringType()), T.StructField("folder", T.StringType()),
    T.StructField("path", T.StringType()), T.StructField("kb", T.LongType()),
    T.StructField("error", T.StringType()), T.StructField("message", T.StringType()),
    T.StructField("bytes", T.LongType()), T.StructField("mode", T.StringType()),
    T.StructField("ts", T.StringType()), T.StructField("exit_code", T.IntegerType()),
    T.StructField("cancelled", T.BooleanType()),
])


def _any_case_glob(extensions) -> str:
    return "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in e) for e in extensions) + "}"


def is_supported(path: Column) -> Column:
    """A readable extension, and not a hidden or lock file."""
    name = X.file_name(path)
    return X.file_extension(path).isin(list(X.MIME_BY_EXTENSION)) & ~name.startswith("~$") & ~name.startswith(".")


def path_rules(df: DataFrame, path: str = "path") -> DataFrame:
    """Add what a relative path tells: ``course`` (first folder, NULL at the root), ``title`` (stem), ``mime``."""
    p = F.col(path)
    ext = X.file_extension(p)
    mime = F.lit(None).cast("string")
    for e, m in X.MIME_BY_EXTENSION.items():
        mime = F.when(ext == e, m).otherwise(mime)
    return df.withColumns({
        "course": F.when(F.size(F.split(p, "/")) > 1, F.element_at(F.split(p, "/"), 1)),
        "title": X.file_stem(p), "mime": mime, "supported": is_supported(p)})


def _relative(uri: Column, root: str) -> Column:
    """Path below ``root``; works for plain paths and for ``file:`` style URIs."""
    base = root.rstrip("/") + "/"
    return F.substring_index(uri, base, -1) if base.strip("/") else F.regexp_replace(uri, "^[a-z]+:/*", "")


def scan_inbox(spark: SparkSession, root: str) -> DataFrame:
    """Every supported file under ``root``: path, course, title, mime, mtime, content. ``content`` is only read
    from disk if the caller selects it. Spark's file sources never list files of zero bytes."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", _any_case_glob(X.MIME_BY_EXTENSION)).load(root))
    rows = files.select(_relative(F.col("path"), root).alias("path"),
                        F.col("modificationTime").alias("mtime"), "content")
    return path_rules(rows).filter("supported").select("path", "course", "title", "mime", "mtime", "content")


def note_title(text: Column, path: Column) -> Column:
    """First level-one heading of a Markdown note, else the file name."""
    heading = X.strip(F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1))
    return F.when((X.file_extension(path) == "md") & (heading != ""), heading).otherwise(X.file_stem(path))


def read_notes(spark: SparkSession, root: str) -> DataFrame:
    """Text notes as one-page documents: path, course, title, mime, text (normalised)."""
    raw = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", _any_case_glob(["md", "txt"]))
           .text(root, wholetext=True)
           .select(F.col("value"), F.col("_metadata.file_path").alias("uri")))
    uri = F.url_decode(F.replace("uri", F.lit("+"), F.lit("%2B")))
    rows = path_rules(raw.select(_relative(uri, root).alias("path"), X.normalize(F.col("value")).alias("text")))
    return (rows.filter("supported")
            .select("path", "course", note_title(F.col("text"), F.col("path")).alias("title"), "mime", "text"))


def parse_event_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """JSON lines to event rows. A line that is not a JSON object becomes an event of type ``log``."""
    schema = T.StructType([*EVENT_SCHEMA.fields, T.StructField("_bad", T.StringType())])
    parsed = lines.filter(F.col(value) != "").withColumn(
        "_e", F.from_json(value, schema, {"columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("_e").isNull() | F.col("_e._bad").isNotNull()
    fields = [F.when(~bad, F.col(f"_e.{f.name}")).alias(f.name) for f in EVENT_SCHEMA.fields if f.name != "type"]
    keep = [c for c in lines.columns if c != value]
    return parsed.select(*keep, F.when(bad, "log").otherwise(F.col("_e.type")).alias("type"), *fields,
                         F.when(bad, F.col(value)).alias("text"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Event rows of a folder of JSON-lines files."""
    return parse_event_lines(spark.read.text(path))
