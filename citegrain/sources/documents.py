"""Text files, labelled CSV sets and summary files in; detail tables and summaries out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citegrain.functions.text import unify_newlines


def read_text_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Each ``*.txt`` file of one folder as a row ``(doc_name, text)``.

    Partition columns encoded in the folder names below *folder* are kept behind these two.
    """
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt")
    extra = [c for c in files.columns if c != "value"]
    return files.select(
        F.col("_metadata.file_name").alias("doc_name"),
        unify_newlines("value").alias("text"),
        *extra,
    )


def read_labelled_set(
    spark: SparkSession, path: str, columns: list[str] | None = None, sequence: str | None = None
) -> DataFrame:
    """CSV with a header: every column a string, an empty cell is ``""``.

    Quoted cells may hold newlines, so a file is one task; write large sets as many files.
    Naming the *columns* saves the pass over the header, which must name the same ones in the same
    order. *sequence* adds a column of that name that orders the rows as they were written: by
    file name, then by line.
    """
    reader = (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
    )
    if columns:
        reader = reader.option("enforceSchema", False)
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    rows = reader.csv(path)
    place = [F.struct(F.col("_metadata.file_name"), F.monotonically_increasing_id().alias("row")).alias(sequence)] if sequence else []
    return rows.select(*rows.columns, *place).na.fill("", rows.columns)


def read_summary(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Summary files: every object of every file, pretty-printed or one to a line.

    A raw line break never stands inside a JSON string, so one between ``}`` and ``{`` parts two objects.
    """
    whole = spark.read.text(path, wholetext=True)
    parts = whole.select(F.explode(F.split(F.trim("value"), r"(?<=\})\s*[\r\n]\s*(?=\{)")).alias("value")).filter("value <> ''")
    if schema is None:  # summaries are small; inference reads them once more
        schema = spark.read.json(parts.rdd.map(lambda row: row.value)).schema
    return parts.select(F.from_json("value", schema).alias("summary")).select("summary.*")


def write_detail(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Detail table as CSV with a header; lists are joined with ``|``, structures become JSON.

    Cells keep their white space.
    """

    def cell(field: T.StructField):
        c = F.col(field.name)
        if isinstance(field.dataType, T.ArrayType) and isinstance(
            field.dataType.elementType, T.StringType
        ):
            return F.array_join(c, "|").alias(field.name)
        if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType, T.VariantType)):
            return F.to_json(c).alias(field.name)
        return c

    flat = df.select(*[cell(f) for f in df.schema.fields])
    writer = flat.write.mode(mode).option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_summary(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Summary rows as JSON objects, one per line; empty cells stay as nulls."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)
