"""Response bodies of the answering service, read tolerantly into answer records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_responses(responses: DataFrame, body: str = "body") -> DataFrame:
    """Replaces the JSON text in *body* by the answer record's columns.

    Missing or mistyped text is ``""``, lists that are none are empty, sources that are no objects have
    neither document nor chunk. A body that does not parse, or is no object, gives NULLs: such a response
    is no success, whatever its status.
    """
    parsed = F.try_parse_json(F.col(body))
    whole = F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed)
    rows = responses.withColumn("_body", whole).drop(body)
    present = F.col("_body").isNotNull()

    def field(name: str, kind: str) -> Column:
        return F.try_variant_get("_body", f"$.{name}", kind)

    def text(name: str) -> Column:
        return F.when(present, F.coalesce(field(name, "string"), F.lit("")))

    def items(name: str) -> Column:
        return F.coalesce(field(name, "array<variant>"), F.array().cast("array<variant>"))

    def of(item: Column, name: str, kind: str) -> Column:
        return F.try_variant_get(item, f"$.{name}", kind)

    source = lambda s: F.struct(
        of(s, "doc_name", "string").alias("doc_name"), of(s, "chunk_id", "bigint").alias("chunk_id"),
        of(s, "score", "double").alias("score"), of(s, "text", "string").alias("text"),
    )
    citations = F.transform(items("citations"), lambda c: F.coalesce(F.try_variant_get(c, "$", "string"), F.lit("")))
    return rows.withColumns(
        {
            "answer": text("answer"),
            "confidence": text("confidence"),
            "prompt_style": text("prompt_style"),
            "citations": F.when(present, citations),
            "sources": F.when(present, F.transform(items("sources"), source)),
        }
    ).drop("_body")
