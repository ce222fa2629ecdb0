"""Loading of delimited text rows: valid rows typed, the others with the reason for their failure.

Lines are parsed with built-in expressions only. Cells are exploded into (row, column, value), checked against
a rule table and the failures aggregated per row; clean rows are what an anti-join leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lines of a chunk: a file is spread over as many tasks as it has chunks.
CHUNK_LINES = 1 << 16

RULE_SCHEMA = T.StructType(
    [
        T.StructField("column", T.StringType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("not_negative", T.BooleanType(), False),
        T.StructField("not_empty", T.BooleanType(), False),
        T.StructField("allowed", T.ArrayType(T.StringType()), True),
    ]
)

#: Rules of the agents' files: column, kind, not negative, not empty, allowed values in lower case.
AGENT_RULES = [
    ("hostname", "string", False, True, None),
    ("pid", "int", False, False, None),
    ("key", "string", False, True, None),
    ("count", "bigint", True, False, None),
    ("timeBin", "bigint", False, False, None),
    ("cpuTime", "bigint", True, False, None),
    ("source", "string", False, False, ["jvm", "sfs"]),
    ("category", "string", False, False, ["read", "write", "other", "zip"]),
    ("fileDescriptor", "int", False, False, None),
    ("threadId", "bigint", False, False, None),
    ("data", "bigint", True, False, None),
    ("remoteCount", "bigint", True, False, None),
    ("remoteCpuTime", "bigint", True, False, None),
    ("remoteData", "bigint", True, False, None),
    ("filename", "string", False, True, None),
]


def without_line_end(line: Column) -> Column:
    """The line without one trailing CR."""
    return F.regexp_replace(line, r"\r\z", "")


#: A value: without quotes, or enclosed by them with inner quotes doubled. Possessive, so neither stack nor time grow with its length.
_VALUE = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)'
_SOUND = rf"(?s)\A{_VALUE}(?:,{_VALUE})*+\z"
_CELL = rf"(?s),({_VALUE})"


def quoting_ok(line: Column) -> Column:
    """True if every double quote encloses a whole value, inner quotes being doubled."""
    return ~F.contains(line, F.lit('"')) | line.rlike(_SOUND)


def cells_of(line: Column) -> Column:
    """Cells of a line with sound quoting: commas in quotes don't separate, enclosing quotes are taken off.

    Only lines that hold a quote are cut by a pattern; nothing stands in for any character, so all values come out as they are.
    """

    def bare(cell: Column) -> Column:
        inner = F.replace(cell.substr(F.lit(2), F.length(cell) - 2), F.lit('""'), F.lit('"'))
        return F.when(F.startswith(cell, F.lit('"')), inner).otherwise(cell)

    quoted = F.transform(F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_CELL), 1), bare)
    return F.when(F.contains(line, F.lit('"')), quoted).otherwise(F.split(line, ",", -1))


def records(lines: DataFrame, files: DataFrame | None = None, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """Records of files: ``(file_id, line_no, record, header, names, *columns of files)``.

    ``lines`` has ``file_id, line_no (from 1), line`` in any order. A record is a line after the first that is
    neither blank nor a repeated header; one trailing CR belongs to the line end. Null lines, ids or
    numbers are no records, nor are lines of a file whose first line is missing; of several first lines the smallest
    counts. ``names`` are the cells of the header, cut once per file. Columns besides these three are ignored.
    ``files`` (one row per ``file_id``) restricts the files and adds its columns. Lines stored twice stay twice.

    Lines meet their header by (file, chunk of lines): a small file is one chunk, a huge one as many tasks' work as it
    has chunks, and a header is repeated per chunk of its own file only.
    """
    chunk = F.floor(F.col("line_no") / F.lit(chunk_lines)).alias("__chunk")
    own = lines.select("file_id", "line_no", without_line_end(F.col("line")).alias("record"))
    headers = own.filter(F.col("line_no") == 1).groupBy("file_id").agg(F.min("record").alias("header"))
    lengths = lines.filter("line_no > 1").groupBy("file_id").agg(F.max("line_no").alias("line_no")).select("file_id", chunk)
    heads = headers.join(lengths, "file_id").select("file_id", "header", "__chunk")
    if files is not None:
        heads = heads.join(files, "file_id")
    heads = heads.withColumn("names", cells_of(F.col("header"))).withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), "__chunk")))
    body = own.filter((F.col("line_no") > 1) & (F.btrim("record", F.lit(" \t\r\n")) != "")).withColumn("__chunk", chunk)
    return body.join(heads, ["file_id", "__chunk"]).drop("__chunk").filter(F.col("record") != F.col("header"))


def failing_cells(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``(file_id, line_no, place, column, reason)`` of everything that is wrong with ``records`` rows.

    A record is parsed once and exploded once. Rows with broken quoting or a wrong number of columns fail as a whole: they
    explode to one cell without column or place. The cells of the others are each joined to their rule. Columns
    without a rule take any value.
    """
    cell = lambda column, value: F.struct(column.alias("column"), value.alias("value"))
    whole = lambda reason: F.array(cell(F.lit(None).cast("string"), F.lit(reason)))
    parsed = rows.select(
        "file_id", "line_no", "names", F.when(quoting_ok(F.col("record")), cells_of(F.col("record"))).alias("cells"),
    )
    named = F.arrays_zip(F.col("names").alias("column"), F.col("cells").alias("value"))
    cells = parsed.select(
        "file_id", "line_no",
        F.posexplode(
            F.when(F.col("cells").isNull(), whole("broken quoting"))
            .when(F.size("cells") != F.size("names"), whole("wrong column count"))
            .otherwise(named)
        ).alias("place", "c"),
    ).select("file_id", "line_no", "place", F.col("c.column").alias("column"), F.col("c.value").alias("value"))
    # the rule table has one row per known column, so it is bounded by the schema
    checked = cells.join(F.broadcast(rules), "column", "left")
    value, kind = F.col("value"), F.col("kind")
    number = F.when(kind == "int", value.try_cast("int").cast("bigint")).otherwise(value.try_cast("bigint"))
    reason = (
        F.when(F.col("column").isNull(), value)
        .when(kind.isNull(), None)
        .when(kind == "string", F.when(F.col("not_empty") & (value == ""), "empty value")
              .when(F.col("allowed").isNotNull() & ~F.coalesce(F.array_contains("allowed", F.lower(value)), F.lit(False)), "unknown value"))
        .when(~value.rlike(r"^[+-]?[0-9]+\z"), "not a whole number")
        .when(number.isNull(), "out of range")
        .when(F.col("not_negative") & (number < 0), "negative value")
    )
    return checked.select(
        "file_id", "line_no", F.when(F.col("column").isNotNull(), F.col("place")).alias("place"), "column", reason.alias("reason")
    ).filter(F.col("reason").isNotNull())


def rejected_rows(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per failing record: ``(file_id, line_no, n_errors, reasons)``, reasons sorted as ``column: reason``.

    A line stored twice is one row and its errors count once.
    """
    why = F.struct("place", F.concat_ws(": ", "column", "reason").alias("text"))
    found = failing_cells(rows, rules).groupBy("file_id", "line_no").agg(F.collect_set(why).alias("e"))
    return found.select(
        "file_id", "line_no", F.size("e").cast("bigint").alias("n_errors"), F.array_join(F.sort_array(F.array_distinct("e.text")), "; ").alias("reasons")
    )


def accepted_rows(rows: DataFrame, rules: DataFrame, types: list[tuple[str, str]]) -> DataFrame:
    """Clean records, typed: ``(file_id, line_no, *columns)``; columns that a file lacks are null.

    ``types`` are (column, type) pairs. Clean is what the anti-join with the failing rows leaves. A line stored twice
    gives one row.
    """
    bad = failing_cells(rows, rules).select("file_id", "line_no").distinct()
    clean = rows.select("file_id", "line_no", "names", "record").join(bad, ["file_id", "line_no"], "left_anti").distinct()
    named = clean.select("file_id", "line_no", "names", cells_of(F.col("record")).alias("cells"))
    get = lambda name: F.get("cells", F.array_position("names", name).cast("int") - 1)
    return named.select("file_id", "line_no", *[get(n).try_cast(t).alias(n) for n, t in types])


def agent_rules(df: DataFrame) -> DataFrame:
    """``AGENT_RULES`` as a table."""
    return df.sparkSession.createDataFrame(AGENT_RULES, RULE_SCHEMA)
