"""File sources and sinks: JSON lines, whole texts, manifests, logs, JSON result documents."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as X


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Rows of JSON lines files; blank lines are skipped, unreadable ones have nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "error", ascii_only: bool = False) -> None:
    """JSON lines, one file per partition; ``ascii_only`` escapes all other characters."""
    df.write.mode(mode).option("writeNonAsciiCharacterAsCodePoint", ascii_only).option("ignoreNullFields", False).json(path)


def append_log(df: DataFrame, path: str) -> None:
    """Append records to a JSON log; a null or missing timestamp becomes now."""
    stamp = F.coalesce(F.col("timestamp"), F.current_timestamp().cast("string")) if "timestamp" in df.columns else F.current_timestamp().cast("string")
    write_jsonl(df.withColumn("timestamp", stamp), path, "append")


def read_texts(spark: SparkSession, path: str, lines_glob: str = "*.jsonl") -> DataFrame:
    """Distinct training texts below a folder: field text, else problem, else the user turns of JSON lines, and whole .txt files."""
    schema = "text string, problem string, messages array<struct<role:string,content:string>>"
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", lines_glob).json(path)
    turns = F.transform(F.filter("messages", lambda m: m["role"] == "user"), lambda m: m["content"])
    own = F.coalesce(F.nullif("text", F.lit("")), F.nullif("problem", F.lit("")))
    lines = rows.select(F.explode(F.when(own.isNotNull(), F.array(own)).otherwise(turns)).alias("text"))
    whole = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path, wholetext=True).select(F.col("value").alias("text"))
    return lines.unionByName(whole).filter(~X.blank(F.col("text"))).distinct()


def read_documents(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One row per JSON file with its path; files that cannot be read are left out."""
    rows = spark.read.schema(T.StructType([*(T._parse_datatype_string(schema) if isinstance(schema, str) else schema).fields, T.StructField("_corrupt_record", T.StringType())])).option("multiLine", True).json(path)
    return rows.withColumn("source_file", F.col("_metadata.file_path")).filter("_corrupt_record IS NULL").drop("_corrupt_record")


def manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """File name, length and SHA-256 of each file; the content is hashed where it is read and not carried on."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("n_bytes"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("sha256"))


def short_hash(sha256: Column) -> Column:
    """The first 16 hex digits of a prefixed hash; "missing" where there is none."""
    return F.coalesce(F.left(F.regexp_replace(sha256, "^sha256:", ""), F.lit(16)), F.lit("missing"))


def manifest_json(files: DataFrame, version: str = "1.0") -> DataFrame:
    """The manifest as one JSON text: version, and for each file its name, length and hash, in order of the names."""
    entry = F.struct("file", F.struct("file", "n_bytes", "sha256"))
    return files.agg(F.to_json(F.struct(F.lit(version).alias("version"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("datasets"))).alias("manifest"))


def manifest_hash(spark: SparkSession, path: str) -> str:
    """SHA-256 of a manifest file, an empty string where there is none."""
    try:
        found = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()
    except AnalysisException:
        return ""
    return found[0] if found else ""


def read_checked(spark: SparkSession, folder: str, name: str, expected: DataFrame | None = None) -> DataFrame:
    """Lines (as JSON texts) of an evaluation set, checked against its manifest entry: file, sha256, n.

    ``expected`` has name, file, sha256 and n. The entry's file has to be there with that hash (if one is stated)
    and that many filled lines (if stated), else ValueError; without an entry NAME.jsonl or NAME_test.jsonl is read
    as it is; FileNotFoundError if none of them is there.
    """
    entry = expected.filter(F.col("name") == name).first() if expected is not None else None
    for file in [entry.file] if entry else [f"{name}.jsonl", f"{name}_test.jsonl"]:
        try:
            held = spark.read.format("binaryFile").load(f"{folder}/{file}")
        except AnalysisException:
            continue
        lines = spark.read.text(f"{folder}/{file}").filter(F.trim("value") != "")
        if entry:
            found = held.select(F.sha2("content", 256)).first()[0]
            if entry.sha256 and entry.sha256.removeprefix("sha256:") != found:
                raise ValueError(f"checksum mismatch for {name}: expected {entry.sha256[:16]}, got {found[:16]}")
            if entry.n and lines.count() != entry.n:
                raise ValueError(f"count mismatch for {name}: expected {entry.n}, got {lines.count()}")
        return lines
    raise FileNotFoundError(f"no evaluation set {name} in {folder}")


def read_items(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Evaluation items of all JSON lines files of a folder: dataset (the file's name), id, and the fields of ``schema``.

    Items without an id get one from the file's name and the number of their line, blank lines counting. A line's
    number is its place in its file, so each file is read by one task, as evaluation sets are small.
    """
    whole = spark.read.text(folder, wholetext=True, pathGlobFilter="*.jsonl").select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.jsonl$", 1).alias("dataset"), F.posexplode(F.split("value", "\r?\n")).alias("at", "line"))
    parsed = whole.filter(F.trim("line") != "").select("dataset", "at", F.from_json("line", schema).alias("item"))
    fields = T._parse_datatype_string(schema).fieldNames()
    made = X.item_id(F.col("dataset"), F.col("at"))
    return parsed.select("dataset", (F.coalesce("item.id", made) if "id" in fields else made).alias("id"), *[f"item.{f}" for f in fields if f != "id"])


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a header, columns by the stated schema."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """A CSV table with a header; quotes inside values are doubled."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def verify_manifest(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """status of each expected file: MISSING, MISMATCH or OK; a hash that is "pending" is not held against it."""
    found = actual.select("file", F.col("sha256").alias("found"))
    state = F.when(F.col("found").isNull(), "MISSING").when((F.col("sha256") != "pending") & (F.col("sha256") != F.col("found")), "MISMATCH").otherwise("OK")
    return expected.join(found, "file", "left").select("file", state.alias("status"))


def parse_log(df: DataFrame, line: str = "value") -> DataFrame:
    """step, of, loss, tokens per second and time left of progress lines; other lines are left out."""
    c = F.col(line)
    number = lambda p: F.regexp_extract(c, p, 1).try_cast("double")
    return df.filter(c.rlike(r"step [0-9]+/[0-9]+")).select(
        F.regexp_extract(c, r"step ([0-9]+)/", 1).try_cast("bigint").alias("step"), F.regexp_extract(c, r"step [0-9]+/([0-9]+)", 1).try_cast("bigint").alias("of"),
        number(r"loss[:= ]+([0-9.]+)").alias("loss"), number(r"([0-9.]+) ?tok/s").alias("tokens_per_second"), F.nullif(F.regexp_extract(c, r"eta[:= ]+(\S+)", 1), F.lit("")).alias("eta"),
    )


def flatten_results(documents: DataFrame, results: str, keep: list[str], interval: str | None = None) -> DataFrame:
    """One row per document and key of the map ``results``; the two ends of an interval become columns."""
    rows = documents.select(*keep, F.explode(results).alias("dataset", "r")).select(*keep, "dataset", "r.*")
    return rows if interval is None else rows.withColumn(f"{interval}_low", F.get(interval, F.lit(0))).withColumn(f"{interval}_high", F.get(interval, F.lit(1))).drop(interval)
