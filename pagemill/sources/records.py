"""JSON and JSON-lines sources and sinks with strict records.

``from_json`` would turn a number into a string; here every field's type is checked on the parsed value, and lines
that break the contract become rows of an error table instead of values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of records: name, type as ``schema_of_variant`` says it (a prefix), type to read as, whether null is allowed.
SEGMENT = [
    ("id", "STRING", "string", False), ("locator", "STRING", "string", False), ("semantic_type", "STRING", "string", False),
    ("heading_path", "ARRAY<", "array<string>", False), ("source_text", "STRING", "string", False),
    ("protected", "ARRAY<", "array<struct<token:string,kind:string,value:string>>", False), ("context_ids", "ARRAY<", "array<string>", False), ("target", "BOOLEAN", "boolean", False),
]
TRANSLATION = [
    ("segment_id", "STRING", "string", False), ("text", "STRING", "string", False), ("notes", "STRING", "string", True),
    ("glossary_observations", "OBJECT<", "map<string,string>", True),
]
#: How the elements of arrays and maps may look.
_INNER = {"array<string>": "^ARRAY<(STRING|VOID)>$", "map<string,string>": "^OBJECT<([^:]*: STRING(, )?)*>$", "array<struct<token:string,kind:string,value:string>>": "^ARRAY<(VOID|OBJECT<kind: STRING, token: STRING, value: STRING>)>$"}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line): the lines that aren't blank."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"))
    return lines.where(F.col("line").rlike(r"\S"))


def checked(lines: DataFrame, fields: list[tuple], line: str = "line") -> DataFrame:
    """Adds ``error`` (the first broken rule, null if sound) and ``record`` (a struct of the fields)."""
    parsed = lines.withColumn("__v", F.try_parse_json(F.col(line)))
    errors: list[Column] = [F.when(F.col("__v").isNull(), F.lit("line must be valid JSON")), F.when(~F.schema_of_variant("__v").startswith("OBJECT"), F.lit("record must be an object"))]
    values = []
    for name, want, kind, optional in fields:
        own = F.variant_get("__v", f"$.{name}", "variant")
        seen = F.coalesce(F.schema_of_variant(own), F.lit("absent"))
        empty = seen.isin("VOID", "absent") if optional else F.lit(False)
        sound = seen.rlike(_INNER[kind]) if kind in _INNER else seen == want
        what = {"STRING": "a string", "BOOLEAN": "a boolean", "ARRAY<": "an array", "OBJECT<": "an object"}[want]
        errors.append(F.when(~(empty | sound), F.lit(f"{name} must be {what}")))
        values.append(F.when(~empty & sound, F.try_variant_get("__v", f"$.{name}", kind)).alias(name))
    return parsed.withColumns({"error": F.coalesce(*errors), "record": F.struct(*values)}).drop("__v")


def read_records(spark: SparkSession, path: str, fields: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """Sound records with their ``file``, and (file, line, error) of the others."""
    rows = checked(read_lines(spark, path), fields)
    return rows.where("error is null").select("file", "record.*"), rows.where("error is not null").select("file", "line", "error")


def read_translations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Zone files ``zone-NNN.jsonl``: records with ``zone_id``, and the errors."""
    sound, broken = read_records(spark, path, TRANSLATION)
    return sound.withColumn("zone_id", F.regexp_extract("file", r"^(.*)\.jsonl$", 1)).drop("file"), broken


def zone_ordinal(zone_id: Column) -> Column:
    """Zones sort by their number, not by their name: ``zone-1000`` comes after ``zone-999``."""
    return F.regexp_extract(zone_id, "^zone-([0-9]{3,})$", 1).try_cast("int")


def json_lines(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """(value): records as they are written, null fields kept."""
    return df.orderBy(*order).select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"))


def write_lines(df: DataFrame, path: str) -> None:
    """Lines of text; an existing path is an error, nothing is overwritten."""
    df.select("value").write.mode("errorifexists").text(path)


def glossary_rows(lines: DataFrame) -> DataFrame:
    """``lines(page_id, json)`` of an object of strings to (page_id, term, gloss)."""
    parsed = lines.select("page_id", F.try_variant_get(F.try_parse_json("json"), "$", "map<string,string>").alias("m"))
    return parsed.select("page_id", F.explode("m").alias("term", "gloss"))
