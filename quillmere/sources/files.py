"""File sources and sinks: JSON lines, CSV, whole JSON documents, the latest artifact, manifests, index tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OCR_LEAST = 40
#: The evaluation table as CSV.
EVAL_COLUMNS = (
    "question_id", "category", "requires_refusal", "requires_clarification", "refusal", "context_precision", "citation_accuracy", "recall_at_5", "hit", "mrr", "ndcg",
    "faithfulness", "answer_relevance", "context_relevance", "hallucination", "judge2_faithfulness", "judge2_answer_relevance", "judge2_context_relevance", "judge2_hallucination",
    "ambiguity_handled", "latency_ms", "cost_usd", "fallback_hop", "error_labels",
)


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None, strict: bool = False) -> DataFrame:
    """One object a line, blank lines left out; strict makes a broken line an error."""
    reader = spark.read.option("mode", "FAILFAST" if strict else "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).json(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def append_traces(traces: DataFrame, path: str) -> None:
    """Appends to a trace log; created_at is stamped where it is null."""
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    write_jsonl(traces.withColumn("created_at", F.coalesce(F.col("created_at").cast("string"), stamp)), path, append=True)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """With a header; an empty field is null."""
    reader = spark.read.option("header", True).option("nullValue", "").option("emptyValue", "")
    return (reader.schema(schema) if schema else reader).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Lists are joined by bars, nulls empty."""
    flat = df.select(*(F.concat_ws("|", c).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes))
    flat.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_eval_csv(rows: DataFrame, path: str) -> None:
    """Evaluation rows in the order of EVAL_COLUMNS; those that rows lacks are empty, others are left out. Fields are not quoted."""
    flat = rows.select(*((F.concat_ws("|", c) if dict(rows.dtypes)[c].startswith("array") else F.col(c)).cast("string").alias(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in EVAL_COLUMNS))
    flat.write.mode("overwrite").option("header", True).option("emptyValue", "").option("quote", "\u0000").csv(path)


def load_config(spark: SparkSession, path: str, id_field: str | None = None) -> dict:
    """A configuration file, YAML or JSON, from any store. It must be a mapping, with id_field in it if one is named; a missing file is an error."""
    text = "\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect())
    if path.endswith(".json"):
        found = json.loads(text)
    else:
        import yaml  # only where YAML is read

        found = yaml.safe_load(text)
    if not isinstance(found, dict):
        raise ValueError(f"{path} is no mapping")
    if id_field and not found.get(id_field):
        raise ValueError(f"{path} lacks {id_field}")
    return found


def config_ids(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(file, id) of configuration files {path: id field}; 'missing' where a file cannot be read or has no id."""
    ids: dict[str, str | None] = {}
    for path, field in paths.items():
        try:
            ids[path] = str(load_config(spark, path, field)[field])
        except Exception:  # noqa: BLE001  told as missing
            ids[path] = None
    return catalog(spark, ids)


def trace_id(prefix: str = "tr") -> Column:
    """A new id of a row: prefix, time in UTC and eight random hexadecimal digits."""
    now = F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz")), "yyyyMMdd_HHmmss")
    return F.concat(F.lit(f"{prefix}_"), now, F.lit("_"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 8))


def checked_points(chunks: DataFrame, vectors: DataFrame, width: int) -> DataFrame:
    """(point_id, chunk_id, vector) of chunks (chunk_id) and vectors (chunk_id, vector): a chunk without a vector, a vector without a chunk,
    or one of another width raises when the rows are read."""
    met = chunks.select("chunk_id", F.lit(1).alias("_c")).join(vectors.select("chunk_id", "vector"), "chunk_id", "full")
    told = F.when(F.col("_c").isNull(), "no chunk for the vector of ").when(F.col("vector").isNull(), "no vector for ").when(F.size("vector") != width, F.lit(f"a width other than {width} in "))
    vector = F.when(told.isNull(), F.col("vector")).otherwise(F.raise_error(F.concat(told, F.col("chunk_id"))))
    return met.select(point_id(F.col("chunk_id")).alias("point_id"), "chunk_id", vector.alias("vector"))


def read_json(spark: SparkSession, pattern: str) -> DataFrame:
    """Whole-document JSON files, with the file each row comes from."""
    return spark.read.option("multiLine", True).json(pattern).withColumn("_file", F.input_file_name())


def write_json(row: DataFrame, path: str) -> None:
    row.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def latest(df: DataFrame, file: str = "_file") -> DataFrame:
    """Rows of the file that comes last by name."""
    last = df.agg(F.max(file).alias("_last"))
    return df.join(F.broadcast(last), F.col(file) == F.col("_last")).drop("_last")  # one row


def catalog(spark: SparkSession, ids: dict[str, str | None]) -> DataFrame:
    """(file, id) of the configuration files; those that could not be read say 'missing'."""
    return spark.createDataFrame([(k, v or "missing") for k, v in sorted(ids.items())], "file string, id string")


def needs_ocr(chars_per_page: Column) -> Column:
    return chars_per_page < OCR_LEAST


def guarded_text(old: Column, new: Column) -> Column:
    """The old text where it is much longer than what a new extraction gives."""
    return F.when((F.length(old) > 2 * F.length(new)) & (F.length(old) > 500), old).otherwise(new)


def merge_manifest(new: DataFrame, old: DataFrame) -> DataFrame:
    """New manifest rows (doc_id, file, method, n_chars); those that old has from OCR keep their old values."""
    o = old.where("method = 'ocr'").select("doc_id", "file", F.col("method").alias("_m"), F.col("n_chars").alias("_n"))
    out = new.join(o, ["doc_id", "file"], "left")
    return out.select("doc_id", "file", F.coalesce("_m", "method").alias("method"), F.coalesce("_n", "n_chars").alias("n_chars"))


def ocr_batches(n_pages: Column, size: int = 15) -> Column:
    """Array of (first, last) page ranges."""
    starts = F.sequence(F.lit(1), n_pages, F.lit(size))
    return F.transform(starts, lambda s: F.struct(s.alias("first"), F.least(s + (size - 1), n_pages).alias("last")))


def load_registry(registry: DataFrame, manifest: DataFrame, texts: DataFrame) -> DataFrame:
    """registry (document_id, file, title) x manifest (file, method) x texts (document_id, text) -> documents with
    char_count, sha256 and source_type; a document without text raises when it is read."""
    m = manifest.dropDuplicates(["file"]).select("file", "method")
    out = registry.join(m, "file", "left").join(texts.select("document_id", "text"), "document_id", "left")
    text = F.when(F.col("text").isNull(), F.raise_error(F.concat(F.lit("no text for "), F.col("document_id").cast("string")))).otherwise(F.col("text"))
    out = out.withColumn("text", text)
    return out.withColumns({"char_count": F.length("text"), "sha256": F.sha2("text", 256), "source_type": F.when(F.col("method") == "ocr", "pdf").otherwise("html")})


def point_id(name: Column) -> Column:
    """The first 16 hexadecimal digits of a name's SHA-256 as an unsigned number."""
    return F.conv(F.substring(F.sha2(name, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def version_id(at: Column) -> Column:
    return F.concat(F.lit("data_"), F.date_format(at, "yyyyMMdd"))


def index_id(version: Column, model: Column) -> Column:
    return F.concat(F.lit("idx_"), F.regexp_replace(version, "^data_", ""), F.lit("_"), F.regexp_replace(model, "[-._]", ""))


def write_index(points: DataFrame, path: str, version: str, recreate: bool = False) -> bool:
    """Writes points as one version of an index; False if a complete one of as many points is there."""
    spark, target = points.sparkSession, f"{path}/index_version={version}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    if there and not recreate and spark.read.parquet(target).count() == points.count():
        return False
    points.write.mode("overwrite").parquet(target)
    return True


def snapshot(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def keyed_union(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Union of manifests; of rows of one key the last, new over old, stays."""
    both = old.withColumn("_at", F.lit(0)).unionByName(new.withColumn("_at", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc("_at"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_at")
