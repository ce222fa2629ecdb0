"""The agents' delimited files: file names, writing and reading of statistics and descriptor mappings."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.schema import CATEGORIES, FD_MAP, OP_STATS, columns_of

#: Parts of ``<jobid>-<hostname>.<key>.<pid>.<startMillis>.<source>.<category>.<format>``.
NAME = r"^(?:([0-9]+)-)?(.+)\.([^.]+)\.(-?[0-9]+)\.([0-9]+)\.(?:(jvm|sfs)\.(read|write|other|zip)|filedescriptormappings)\.(csv|fb|bb)\z"


def parsed_names(files: DataFrame, name: str = "file_name") -> DataFrame:
    """``files`` with ``job_id, hostname, key, pid, start_ms, source, category, format`` of agent files; others are left out.

    Descriptor mappings have neither source nor category (null).
    """
    part = lambda i: F.nullif(F.regexp_extract(F.col(name), NAME, i), F.lit(""))
    return files.filter(F.col(name).rlike(NAME)).withColumns(
        {
            "job_id": part(1).cast("bigint"), "hostname": part(2), "key": part(3), "pid": part(4).try_cast("int"), "start_ms": part(5).try_cast("bigint"),
            "source": part(6), "category": part(7), "format": part(8),
        }
    )


def write_stats(stats: DataFrame, path: str) -> None:
    """Write statistics as CSV with a header, one directory per category and source, each with its own columns."""
    clean = stats.withColumn("hostname", F.regexp_replace("hostname", ",", ""))
    for category in CATEGORIES:
        part = clean.filter(F.col("category") == category).select(*columns_of(category), F.col("source").alias("src"))
        part.write.mode("overwrite").partitionBy("src").option("header", True).csv(f"{path}/{category}")


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """Read what ``write_stats`` wrote, in the full schema; measures that a category lacks are 0."""
    out = None
    for category in CATEGORIES:
        schema = T.StructType([OP_STATS[c] for c in columns_of(category)] + [T.StructField("src", T.StringType())])
        part = spark.read.schema(schema).option("header", True).csv(f"{path}/{category}").drop("src")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.na.fill(0, [f.name for f in OP_STATS if f.dataType == T.LongType()]).select(*OP_STATS.fieldNames())


def read_permissive(spark: SparkSession, path: str, schema: T.StructType = OP_STATS) -> DataFrame:
    """Read CSV, drop incomplete or malformed lines, fill missing measures with 0."""
    rows = spark.read.schema(schema).option("header", True).option("mode", "DROPMALFORMED").csv(path)
    return complete_rows(rows)


def complete_rows(rows: DataFrame) -> DataFrame:
    """Rows whose key columns are all known, missing measures 0."""
    needed = [c for c in OP_STATS.fieldNames()[:10] if c in rows.columns]
    return rows.na.drop(subset=needed).na.fill(0, [c for c in OP_STATS.fieldNames()[10:] if c in rows.columns])


def write_mappings(mappings: DataFrame, path: str) -> None:
    """Write descriptor mappings as CSV; the path column is called ``filename`` and quoted where needed."""
    mappings.select("hostname", "pid", "key", "fileDescriptor", F.col("path").alias("filename")).write.mode("overwrite").option(
        "header", True
    ).csv(path)


def read_mappings(spark: SparkSession, path: str) -> DataFrame:
    """Read descriptor mappings from CSV."""
    schema = T.StructType([*FD_MAP.fields[:4], T.StructField("filename", T.StringType())])
    return spark.read.schema(schema).option("header", True).csv(path).withColumnRenamed("filename", "path")


def cached_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The cached table at ``path``, or an empty one of ``schema`` if there is none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def write_cache(rows: DataFrame, path: str) -> None:
    """Cache a table as Parquet, partitioned by host so that host filters prune files."""
    rows.write.mode("overwrite").partitionBy("hostname").parquet(path)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line_no, line)`` of whole text files (bounded side inputs such as logs and counters), lines from 1."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    split = F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n")
    return texts.select("file", F.posexplode(split).alias("i", "line")).select("file", (F.col("i") + 1).alias("line_no"), "line")


def concatenate(spark: SparkSession, path: str, prefix: str = "", suffix: str = "", delete: bool = False) -> list[str]:
    """One file per source and category, and one of the descriptor mappings, of the agents' CSV files in ``path``.

    Outputs are the text folders ``<path>/<prefix><source>-<category><suffix>.csv`` and
    ``<path>/<prefix>filedescriptormappings<suffix>.csv`` with one part each: the header once, then the records of all
    files in order of name and line, one a line even where a file was cut off. Empty files and outputs of earlier runs
    aren't taken in. With ``delete`` the files taken in are removed afterwards. Returns the outputs.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    system = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    agent_file = re.compile(NAME.replace(r"\z", r"\Z"))
    # listed before anything is read, so that files that arrive meanwhile stay; scans leave out empty files
    taken = [
        s.getPath() for s in system.listStatus(hadoop.Path(path))
        if s.isFile() and (m := agent_file.match(s.getPath().getName())) and m.group(8) == "csv"
    ]
    lines = text_lines(spark, f"{path}/*.csv")
    names = parsed_names(lines.select("file").distinct(), "file").filter("format = 'csv'").select(
        "file", F.coalesce(F.concat_ws("-", F.nullif("source", F.lit("")), "category"), F.lit("")).alias("target")
    )
    target = F.when(F.col("target") == "", "filedescriptormappings").otherwise(F.col("target"))
    own = lines.join(names.select("file", target.alias("target")), "file").filter((F.col("line") != "") | (F.col("line_no") == 1))
    outputs = []
    for row in names.select(target.alias("target")).distinct().orderBy("target").collect():
        part = own.filter(F.col("target") == row["target"])
        header = part.filter("line_no = 1 and line <> ''").orderBy("file").limit(1).select(F.lit("").alias("file"), F.lit(0).alias("line_no"), "line")
        out = f"{path}/{prefix}{row['target']}{suffix}.csv"
        rows = header.unionByName(part.filter("line_no > 1").select("file", "line_no", "line"))
        rows.coalesce(1).sortWithinPartitions("file", "line_no").select("line").write.mode("overwrite").text(out)
        outputs.append(out)
    for p in taken if delete else ():
        system.delete(p, False)
    return outputs
