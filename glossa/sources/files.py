"""Readers and writers: stimuli, records, logs, vectors, prompts and texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import col, strip
from ..operators.design import pending

# Length that a kept paragraph exceeds, and paragraphs kept per page, unless the caller says otherwise.
MIN_PARAGRAPH, MAX_PARAGRAPHS = 80, 50

_CSV = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true", "comment": "#"}


def read_stimuli(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with header under a declared schema; lines that start with ``#`` are comments."""
    return spark.read.options(**_CSV).schema(schema).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header="true", quote='"', escape='"').csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON object per line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_calls(df: DataFrame, path: str) -> None:
    """Append call records, one folder per model."""
    df.write.mode("append").partitionBy("model").json(path)


def write_responses(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store responses by model and temperature, so that a slice is a pruned scan.

    Only the slices present in ``df`` are replaced.
    """
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("model", "temperature").parquet(path)


def write_vectors(df: DataFrame, path: str) -> None:
    """Store vectors next to the key they belong to."""
    df.write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """Prompt library, one JSON object per file, as rows of (experiment, part, name, text).

    ``part`` is null for a template that stands directly under its experiment.
    """
    whole = spark.read.text(path, wholetext=True)
    sections = whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("experiment", "body"))
    fields = sections.filter(F.startswith(F.ltrim("body"), F.lit("{"))).select(
        "experiment", F.explode(F.from_json("body", "map<string,string>")).alias("name", "text")
    )
    is_object = F.startswith("text", F.lit("{")) & F.from_json("text", "map<string,string>").isNotNull()
    nested = fields.filter(is_object).select(
        "experiment", F.col("name").alias("part"), F.explode(F.from_json("text", "map<string,string>")).alias("name", "text")
    )
    flat = fields.filter(~is_object).select("experiment", F.lit(None).cast("string").alias("part"), "name", "text")
    return flat.unionByName(nested)


def prompt_text(prompts: DataFrame, experiment: str, name: str, part: str | None = None) -> str:
    """One prompt's text: a single row of the library, brought to the driver to be rendered into a plan."""
    chosen = prompts.filter((F.col("experiment") == experiment) & (F.col("name") == name))
    chosen = chosen.filter(F.col("part").isNull() if part is None else F.col("part") == part)
    rows = chosen.select("text").limit(2).collect()
    if len(rows) != 1:
        raise KeyError(f"prompt {experiment}/{part or ''}/{name}: {len(rows)} found")
    return rows[0]["text"]


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Whole ``<domain>_ground_truth.txt`` files as (domain, ground_truth)."""
    files = spark.read.option("pathGlobFilter", "*_ground_truth.txt").text(path, wholetext=True)
    name = F.col("_metadata.file_name")
    return files.select(F.regexp_extract(name, r"^(.*)_ground_truth\.txt$", 1).alias("domain"), F.col("value").alias("ground_truth"))


def tagged_records(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Records of files named ``responses_<model>_T<digits>.jsonl`` with the tags of their names.

    ``T08`` reads 0.8 and ``T12`` 1.2: the point follows the first digit.
    """
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    pattern = r"^responses_(.+)_T(\d+)\.jsonl$"
    digits = F.regexp_extract(name, pattern, 2)
    value = F.concat(F.substring(digits, 1, 1), F.lit("."), F.expr("substring(file_digits, 2)"))
    return (
        spark.read.schema(schema)
        .option("pathGlobFilter", "responses_*.jsonl")
        .json(path)
        .withColumn("file_model", F.regexp_extract(name, pattern, 1))
        .withColumn("file_digits", digits)
        .withColumn("file_temperature", F.when(F.length("file_digits") == 1, F.col("file_digits")).otherwise(value).cast("double"))
        .drop("file_digits")
    )


def resume(design: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Design points still to be collected."""
    return pending(design, stored, keys)


def parse_scores(df: DataFrame, reply: str, schema: StructType, required: Sequence[str]) -> DataFrame:
    """Parse a judge's JSON reply into columns, with ``bad_reply`` where it cannot be used.

    A reply is bad if it is no JSON object or lacks a required score. Bad rows are
    kept; see ``split_scores``. Taken out of an array, a parsed reply is a row's value from then on: it is not
    parsed anew for each test and score that is asked of it.
    """
    parsed = df.select("*", F.explode(F.array(F.from_json(F.col(reply), schema))).alias("_reply"))
    missing = F.lit(False)
    for name in required:
        missing = missing | F.col("_reply")[name].isNull()
    return parsed.select("*", *[F.col("_reply")[f.name].alias(f.name) for f in schema.fields]).withColumn(
        "bad_reply", F.col("_reply").isNull() | missing
    ).drop("_reply")


def split_scores(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable rows, and the quarantine table."""
    good = parsed.filter(~F.col("bad_reply")).drop("bad_reply")
    return good, parsed.filter("bad_reply").drop("bad_reply")


def kept_paragraphs(text: str | Column, minimum: int = MIN_PARAGRAPH, most: int = MAX_PARAGRAPHS) -> Column:
    """Trimmed lines of more than ``minimum`` characters, the first ``most`` of them."""
    lines = F.transform(F.split(col(text), "\n"), strip)
    return F.slice(F.filter(lines, lambda p: F.length(p) > minimum), 1, most)


def paragraphs(df: DataFrame, text: str, *keep: str, minimum: int = MIN_PARAGRAPH, most: int = MAX_PARAGRAPHS) -> DataFrame:
    """One row per kept paragraph, numbered after filtering. Row-local: a page is its own group."""
    return df.select(*keep, F.posexplode(kept_paragraphs(text, minimum, most)).alias("para_index", "paragraph"))


def stored_pages(df: DataFrame, reply: str, schema: str, *keep: str) -> DataFrame:
    """Pages of stored page-API replies, one row each."""
    parsed = df.select(*keep, F.from_json(F.col(reply), schema).alias("_r"))
    return parsed.select(*keep, F.explode(F.map_values("_r.query.pages")).alias("page")).select(
        *keep, F.col("page.title").alias("title"), F.col("page.extract").alias("extract"), F.col("page.revisions").alias("revisions")
    )


def page_measures(pages: DataFrame, *keep: str) -> DataFrame:
    """Length of the introduction (null if empty) and number of revisions."""
    extract = F.col("extract")
    return pages.select(
        *keep,
        F.when(F.length(extract) > 0, F.length(extract)).alias("intro_length"),
        F.coalesce(F.size("revisions"), F.lit(0)).alias("n_revisions"),
    )


