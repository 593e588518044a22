"""Column expressions and row helpers that several of these operators share."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelspark.session import lookup_join, stage

# Space and U+0009 to U+000D separate words; everything else belongs to a word.
BREAKS = "[ \\t\\n\\x0B\\x0C\\r]+"
IN_WORD = "[^ \\t\\n\\x0B\\x0C\\r]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; null counts as an empty text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BREAKS), lambda w: w != "")


def word_count(text: Column) -> Column:
    """The number of words of a text (long); 0 for null."""
    return F.size(words(text)).cast("long")


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name the frame does not have yet, whatever extra columns it carries."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def with_row_names(docs: DataFrame, name: str) -> DataFrame:
    """`docs` with a number for each row that belongs to the row, whenever and however often it is read.

    A row of Parquet files is named by its file, in the order of their paths, and its place there; how the files are
    split among tasks does not matter. Any other frame is written once and named by the table.
    """
    if not docs.inputFiles():
        return with_row_names(stage(docs, "named-rows"), name)
    place = [F.col("_metadata.file_path").alias("_file_path"), F.col("_metadata.row_index").alias("_row_index")]
    kept = [F.col(f"`{c}`") for c in docs.columns]
    try:
        placed = docs.select(*kept, *place)
        files = placed.select("_file_path").distinct()
    except AnalysisException:
        return with_row_names(stage(docs, "named-rows"), name)
    # One short row per file; the session lists these paths anyway.
    numbers = files.withColumn("_file_no", F.row_number().over(Window.orderBy("_file_path")).cast("long"))
    numbers = stage(numbers, "file-numbers")
    known = numbers.agg(F.sum(F.length("_file_path") + 32)).first()[0] or 0
    found = lookup_join(placed, numbers, ["_file_path"], known, ["_row_index"], how="inner")
    return found.select(*kept, F.shiftleft("_file_no", 40).bitwiseOR(F.col("_row_index")).alias(name))


def pieces(rows: int, per_piece: int) -> int:
    """How many pieces of about `per_piece` rows the rows make; at least one."""
    return max(1, -(-rows // per_piece))
