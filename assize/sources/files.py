"""Files as typed, cleaned tables: delimited text, JSON lines, HTML; with the file and place a row came from."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assize.functions.text import clean_cell, column_labels


def read_delimited(spark: SparkSession, path: str, columns: list[str], separator: str = ",", encoding: str = "UTF-8", header: bool = True) -> DataFrame:
    """Delimited text under the given headers, all as cleaned text; broken lines are kept in ``_corrupt``.

    The schema is stated, so files are read once. Columns come in snake case, with the file's name as ``_file``.
    """
    names = column_labels(columns)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "_corrupt"]])
    reader = spark.read.schema(schema).option("header", header).option("sep", separator).option("encoding", encoding).option("multiLine", True).option("quote", '"').option("escape", '"')
    rows = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").csv(path)
    return rows.select(*[clean_cell(F.col(n)).alias(n) for n in names], "_corrupt", F.col("_metadata.file_name").alias("_file"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a stated schema; lines that do not parse are in ``_corrupt``."""
    full = T._parse_datatype_string(f"{schema}, _corrupt string")
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path).withColumn("_file", F.col("_metadata.file_name"))


def read_whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of text or HTML files, one row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def read_positional(spark: SparkSession, path: str, names: list[str], least: int, separator: str = ";", encoding: str = "UTF-8") -> DataFrame:
    """Delimited text without a header, columns by position, all as cleaned text; rows of fewer than ``least`` fields are left out.

    Only rows that do not have as many fields as names are counted, outside their quotes; a field that a row lacks is null.
    """
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "_corrupt"]])
    reader = spark.read.schema(schema).option("header", False).option("sep", separator).option("encoding", encoding).option("quote", '"').option("escape", '"')
    rows = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").csv(path)
    bare = F.regexp_replace("_corrupt", '"[^"]*"', "")
    fields = F.size(F.split(bare, re.escape(separator), -1))
    return rows.where(F.col("_corrupt").isNull() | (fields >= least)).select(*[clean_cell(F.col(n)).alias(n) for n in names])


def keep_members(rows: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """Rows of which any column is among its targets (value), once each; which sides are broadcast is left to their sizes."""
    kept, hit = rows, F.lit(False)
    for n, (column, values) in enumerate(targets.items()):
        known = values.where("value is not null").select(F.col("value").alias(f"_target{n}")).distinct()
        kept = kept.join(known, F.col(column) == F.col(f"_target{n}"), "left")
        hit = hit | F.col(f"_target{n}").isNotNull()
    return kept.where(hit).select(*rows.columns)


def read_lookup(spark: SparkSession, path: str, separator: str = ";", encoding: str = "UTF-8") -> DataFrame:
    """(code, description) of a two-column file without a header; blank codes are left out, of a code told twice the last line wins."""
    rows = read_positional(spark, path, ["code", "description"], 2, separator, encoding).where("code is not null")
    turn = rows.withColumn("_turn", F.monotonically_increasing_id())
    return turn.groupBy("code").agg(F.max_by("description", "_turn").alias("description"))


def write_clean_csv(df: DataFrame, path: str) -> None:
    """CSV with a header in which every text stands in quotes and no number does."""
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.coalesce(c, F.lit("")), '"', '""'), F.lit('"'))
    cells = [quoted(F.col(c)) if c in texts else F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    header = ",".join('"' + c.replace('"', '""') + '"' for c in df.columns)
    # A line without quotes or escapes of the writer's own: the one column is the line, its name the header.
    writer = df.select(F.concat_ws(",", *cells).alias(header)).write.mode("overwrite").option("header", True)
    writer.option("quote", "").option("sep", "\u0001").option("escapeQuotes", False).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("emptyValue", "").csv(path)


def append_audit(df: DataFrame, path: str) -> None:
    """Audit records as JSON lines added to those there are; earlier ones are never written again."""
    write_json_lines(df, path, mode="append")


def union_sources(parts: list[tuple[str, DataFrame, dict[str, str]]]) -> DataFrame:
    """Sources of other column names as one table, each row with its source; a missing column is null."""
    targets = list(dict.fromkeys(t for _, _, names in parts for t in names.values()))
    out = None
    for name, df, names in parts:
        back = {t: c for c, t in names.items()}
        rows = df.select(*[(F.col(back[t]) if t in back else F.lit(None)).cast("string").alias(t) for t in targets], F.lit(name).alias("source"))
        out = rows if out is None else out.unionByName(rows)
    return out


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet, by partitions if asked; rows of a partition go to its own files."""
    if partition_by:
        df.repartition(*partition_by, F.spark_partition_id() % 8).write.mode(mode).partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode(mode).parquet(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def merge_increment(current: DataFrame, update: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Current and new rows as one, the latest row a key; equal columns on both sides."""
    both = current.unionByName(update)
    columns = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in columns])


def replace_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Write the partitions that ``df`` has and leave all others of the table as they are."""
    df.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*partition_by).parquet(path)


def probe(spark: SparkSession, path: str) -> tuple[str, str, list[str]]:
    """(encoding, separator, header) of delimited text: UTF-8 if all its lines are, else Latin-1."""
    lines = spark.read.text(path)
    broken = bool(lines.where(~F.is_valid_utf8("value")).limit(1).count())
    first = lines.limit(1).select(F.col("value").cast("binary").alias("v")).first()
    line = (bytes(first["v"]) if first else b"").decode("latin-1" if broken else "utf-8")
    separator = max(";,\t|", key=lambda s: (line.count(s), -";,\t|".index(s)))
    return ("ISO-8859-1" if broken else "UTF-8"), separator, [h.strip().strip('"') for h in line.split(separator)]


def require_header(found: list[str], expected: list[str], source: str) -> None:
    """Raise if the headers, in snake case, are not the expected ones in order."""
    if column_labels(found) != column_labels(expected):
        raise ValueError(f"{source}: the header is {found}, not {expected}")


def by_alias(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Columns under one name each: of a field's aliases the first that the table has; null if it has none."""
    known = set(df.columns)
    chosen = {field: next((a for a in names if a in known), None) for field, names in aliases.items()}
    return df.select(*[(F.col(a) if a else F.lit(None).cast("string")).alias(field) for field, a in chosen.items()])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256, modified) of every file under a path; each is read by one task, a file at a time."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified"))


def sync_plan(found: DataFrame, known: DataFrame) -> DataFrame:
    """What to do with each file: add new ones, refresh changed ones, skip the rest, and note those that are gone."""
    old = known.select("file", F.col("sha256").alias("old"))
    both = found.select("file", "sha256").join(old, "file", "full")
    action = F.when(F.col("old").isNull(), "add").when(F.col("sha256").isNull(), "gone").when(F.col("old") != F.col("sha256"), "refresh").otherwise("skip")
    return both.select("file", action.alias("action"))


def movements(df: DataFrame, html: str, key: str) -> DataFrame:
    """Table rows of HTML pages as (key, number, cells): one row a table row, cells without tags."""
    from assize.functions.text import without_tags

    rows = F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("number", "row")
    cells = F.transform(F.regexp_extract_all("row", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), without_tags)
    return df.select(key, rows).select(key, "number", cells.alias("cells"))
