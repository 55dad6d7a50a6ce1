"""Sources and sinks over files that Spark reads and writes; paths may be in any store that Spark knows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUEUE_SCHEMA = "id string, memory_data string, failure_reason string, retry_count int, max_retries int, queued_at timestamp, next_retry_at timestamp"
TRACE_SCHEMA = "timestamp double, event_type string, trace_id string, span_id string, parent_span_id string, session_id string, project_id string, data string, as_type string, tags array<string>"
TRANSCRIPT_SCHEMA = "session_id string, turn long, role string, content string"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, plain or gzipped, one file or many; malformed lines are left out."""
    broken = T.StructType([*spark.createDataFrame([], schema).schema.fields, T.StructField("_corrupt", T.StringType())])
    rows = spark.read.schema(broken).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.filter(F.col("_corrupt").isNull()).drop("_corrupt")


def retry_queue(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, QUEUE_SCHEMA)


def session_logs(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A log and its rotated, gzipped archives."""
    return json_lines(spark, f"{folder.rstrip('/')}/*.jsonl*", schema)


def transcript(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, TRANSCRIPT_SCHEMA)


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    """path, title, tags, kind, body of Markdown files below a folder; front matter is the block between --- lines at the start."""
    return front_matter(spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text")))


def front_matter(raw: DataFrame) -> DataFrame:
    """path, title, tags, kind, body of (path, text) rows."""
    front, body = F.regexp_extract("text", "(?s)^---\\r?\\n(.*?)\\r?\\n---\\r?\\n?(.*)$", 1), F.regexp_extract("text", "(?s)^---\\r?\\n(.*?)\\r?\\n---\\r?\\n?(.*)$", 2)
    r = raw.withColumn("front", front).withColumn("body", F.when(front == "", F.col("text")).otherwise(body))
    field = lambda name: F.trim(F.regexp_replace(F.regexp_extract("front", f"(?m)^{name}:[ \\t]*(.*)$", 1), "^[\"']|[\"']$", ""))
    title = F.coalesce(F.nullif(field("title"), F.lit("")), F.nullif(F.regexp_extract("body", "(?m)^#[ \\t]+(.+)$", 1), F.lit("")), F.regexp_replace(F.substring_index("path", "/", -1), "\\.md$", ""))
    return r.select("path", F.trim(title).alias("title"), tags(field("tags"), F.col("front")).alias("tags"), F.nullif(field("type"), F.lit("")).alias("kind"), F.trim("body").alias("body"))


def tags(line, front):
    """Tags of front matter: [a, b], a, b on the line, or a list of - items below it."""
    inline = F.split(F.regexp_replace(line, "[\\[\\]\"']", ""), "\\s*,\\s*")
    below = F.regexp_extract_all(F.regexp_extract(front, "(?m)^tags:[ \\t]*\\n((?:[ \\t]*-[ \\t]*.+\\n?)+)", 1), F.lit("-[ \\t]*([^\\n]+)"))
    found = F.when(line != "", inline).otherwise(below)
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.lower(F.trim(x))), lambda x: x != ""))


def handoffs(spark: SparkSession, folder: str) -> DataFrame:
    """path, date, number, body of handoff files."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("body"))
    return handoff_rows(raw)


def handoff_rows(raw: DataFrame) -> DataFrame:
    """Of (path, body) rows: date from the name, else the text; number from the session line at the start of the text, else the name."""
    name = F.substring_index("path", "/", -1)
    date = F.coalesce(*(F.nullif(F.regexp_extract(x, "(\\d{4}-\\d{2}-\\d{2})", 1), F.lit("")) for x in (name, F.col("body"))))
    said = F.regexp_extract(F.substring("body", 1, 500), "\\*\\*Session\\*\\*:\\s*PM\\s*#(\\d+)", 1)
    number = F.coalesce(*(F.nullif(x, F.lit("")) for x in (said, F.regexp_extract(name, "(?i)(?:session|handoff)[-_ ]?(\\d{1,3})(?![\\d-])", 1), F.regexp_extract(name, "(?i)session[-_ ](\\d{1,3})-", 1))))
    return raw.select("path", F.to_date(date).alias("date"), number.cast("int").alias("number"), "body")


def templates(spark: SparkSession, path: str) -> DataFrame:
    """Validated template rows of a JSON array: content, domain, tags; invalid ones are left out."""
    rows = spark.read.schema("content string, domain string, type string, tags array<string>, source_url string").option("multiLine", True).json(path)
    good = F.length("content").between(10, 2000) & (F.coalesce(F.col("domain"), F.lit("")) != "") & ~F.rlike("content", F.lit("(?i)<script|rm -rf /"))
    clean = F.array_distinct(F.filter(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), lambda x: x != ""))
    return rows.filter(good).select("content", F.lower("domain").alias("domain"), "type", clean.alias("tags"), "source_url")


def projects(spark: SparkSession, folder: str) -> DataFrame:
    """project, text of YAML files of a folder; of two files for one project the first by name counts."""
    raw = spark.read.option("pathGlobFilter", "*.y*ml").text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    name = F.regexp_replace(F.substring_index("path", "/", -1), "\\.ya?ml$", "")
    return raw.withColumn("project", name).groupBy("project").agg(F.min_by("text", "path").alias("text"))


def project_rows(raw: DataFrame) -> DataFrame:
    """project_id, source_directory, github_repo, github_branch of configurations (path, text): of files with one stem the first by
    name counts; one without project_id is left out."""
    name = F.substring_index("path", "/", -1)
    first = raw.groupBy(F.regexp_replace(name, "\\.ya?ml$", "").alias("stem")).agg(F.min_by("text", name).alias("text"))
    flat = lambda key: F.nullif(F.trim(F.regexp_replace(F.regexp_extract("text", f"(?m)^{key}:[ \\t]*(.+)$", 1), "^[\"']|[\"']$", "")), F.lit(""))
    below = F.regexp_extract("text", "(?m)^github:[ \\t]*\\n((?:[ \\t]+.*\\n?)+)", 1)
    nested = lambda key: F.nullif(F.trim(F.regexp_extract(below, f"(?m)^[ \\t]+{key}:[ \\t]*(.+)$", 1)), F.lit(""))
    rows = first.select(flat("project_id").alias("project_id"), flat("source_directory").alias("source_directory"), nested("repo").alias("github_repo"), F.coalesce(nested("branch"), F.lit("main")).alias("github_branch"))
    return rows.filter(F.col("project_id").isNotNull())


def project_configs(spark: SparkSession, folder: str) -> DataFrame:
    return project_rows(spark.read.option("pathGlobFilter", "*.y*ml").text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text")))


def constraints(spark: SparkSession, folder: str, phase: str | None = None) -> DataFrame:
    """text: the global constraints, then those of a phase, then how many files were read; empty where there are none. A phase is a
    name, so all other signs are dropped from it."""
    safe = re.sub(r"[^a-zA-Z0-9_-]", "", phase or "")
    raw = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    at = F.when(F.rlike("path", F.lit("/global/CONSTRAINTS\\.md(/|$)")), 0).when(F.rlike("path", F.lit(f"/{safe}/constraints\\.md(/|$)")) if safe else F.lit(False), 1)
    parts = raw.withColumn("at", at).filter("at IS NOT NULL AND text <> ''").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("p"))
    count = lambda k: F.size(F.filter("p", lambda x: x["at"] == k)).cast("string")
    body = F.array_join(F.transform("p", lambda x: x["text"]), "\n\n---\n\n")
    return parts.select(F.when(F.size("p") == 0, "").otherwise(F.concat(body, F.lit("\n\n---\nConstraints loaded: "), count(0), F.lit(" global + "), count(1), F.lit(" phase-specific"))).alias("text"))


def append_audit(rows: DataFrame, path: str) -> None:
    """Appends audit rows as JSON lines; contents are named by hash, never written."""
    hidden = [c for c in ("content", "text") if c in rows.columns]
    out = rows
    for c in hidden:
        out = out.withColumn(f"{c}_hash", F.substring(F.sha2(F.encode(F.coalesce(c, F.lit("")), "UTF-8"), 256), 1, 16)).drop(c)
    out.write.mode("append").json(path)


def write_traces(events: DataFrame, path: str, most: int = 10_000) -> None:
    """Trace events as JSON, their data cut to a size."""
    events.withColumn("data", F.when(F.length("data") > most, F.concat(F.substring("data", 1, most), F.lit("...[TRUNCATED]"))).otherwise(F.col("data"))).write.mode("append").json(path)


def store(memories: DataFrame, path: str) -> None:
    """The memory table: Parquet, by collection and tenant, so that searches prune both."""
    memories.repartition("collection", "group_id").write.mode("append").partitionBy("collection", "group_id").parquet(path)


def create_table(spark: SparkSession, name: str, schema: str) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet PARTITIONED BY (collection, group_id)")


def backup(table: DataFrame, path: str, version: str) -> dict[str, object]:
    """Copies a table to a versioned folder with a manifest of rows and a digest of all of them."""
    at = f"{path.rstrip('/')}/{version}"
    table.write.parquet(f"{at}/data")
    found = manifest(table.sparkSession.read.parquet(f"{at}/data"))
    table.sparkSession.createDataFrame([(version, found["rows"], found["digest"])], "version string, rows long, digest long").coalesce(1).write.json(f"{at}/manifest")
    return found


def manifest(table: DataFrame) -> dict[str, object]:
    r = table.agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64(*sorted(table.columns))).alias("digest")).first()
    return {"rows": r["rows"], "digest": r["digest"]}


def restore(spark: SparkSession, path: str, version: str) -> DataFrame:
    """A backup's rows; refuses one whose rows are not those of its manifest."""
    at = f"{path.rstrip('/')}/{version}"
    data, said = spark.read.parquet(f"{at}/data"), spark.read.schema("version string, rows long, digest long").json(f"{at}/manifest").first()
    found = manifest(data)
    if (found["rows"], found["digest"]) != (said["rows"], said["digest"]):
        raise ValueError(f"backup {version} has {found['rows']} rows, its manifest {said['rows']}, or their contents differ")
    return data
