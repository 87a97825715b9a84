"""Assignments for translators, and the contracts that their results are held to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.contract import DIMENSIONS, MAX_RETRIES, MAX_SUMMARY, TOKEN_SQL

RECORD = ["heading_path", "id", "protected", "semantic_type", "source_text"]


def tokens_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({TOKEN_SQL})"), F.lit(1))


def same_multiset(a: Column, b: Column) -> Column:
    return F.array_sort(a).eqNullSafe(F.array_sort(b))


def records_of(zones: DataFrame, segments: DataFrame, column: str) -> DataFrame:
    """(page_id, zone_id, records): the five-field records of a zone's ids, in the order of the ids."""
    wanted = zones.select("page_id", F.col("id").alias("zone_id"), F.posexplode(column).alias("pos", "id"))
    found = wanted.join(segments.select("page_id", *RECORD), ["page_id", "id"])
    return found.groupBy("page_id", "zone_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct(*RECORD).alias("r")))), lambda x: x["r"]).alias(column))


def assignments(zones: DataFrame, segments: DataFrame, glossary: DataFrame, summaries: DataFrame) -> DataFrame:
    """One package per zone: summary, glossary, targets and neighbours as records."""
    out = zones.select("page_id", F.col("id").alias("zone_id"))
    for column, name in (("target_ids", "targets"), ("context_before_ids", "context_before"), ("context_after_ids", "context_after")):
        empty = F.array().cast(f"array<{segments.select(F.struct(*RECORD)).schema[0].dataType.simpleString()}>")
        out = out.join(records_of(zones, segments, column).withColumnRenamed(column, name), ["page_id", "zone_id"], "left").withColumn(name, F.coalesce(F.col(name), empty))
    terms = glossary.groupBy("page_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "gloss")))).alias("glossary"))
    out = out.join(terms, "page_id", "left").join(summaries.select("page_id", F.trim("summary").alias("document_summary")), "page_id")
    return out.select("page_id", "zone_id", F.to_json(F.struct(
        "context_after", "context_before", "document_summary", F.coalesce("glossary", F.expr("cast(map() as map<string,string>)")).alias("glossary"),
        F.lit(1).alias("schema_version"), "targets", "zone_id")).alias("json"))


def summary_errors(summaries: DataFrame) -> DataFrame:
    n = F.length(F.trim("summary"))
    return summaries.where(F.coalesce((n < 1) | (n > MAX_SUMMARY), F.lit(True))).select("page_id")


def overlapping_context(zones: DataFrame) -> DataFrame:
    """Zones whose neighbours are also targets."""
    return zones.where(F.arrays_overlap("target_ids", F.concat("context_before_ids", "context_after_ids"))).select("page_id", "id")


def zone_result_errors(zones: DataFrame, results: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """First broken rule per zone: (page_id, zone_id, check_ord, error).

    ``results(page_id, zone_id, segment_id, text)``; a null id or text is a wrong type.  Rules in order: types,
    duplicates, unassigned, missing, tokens.  With ``segments`` the tokens are theirs, not the zone's own.
    """
    assigned = zones.select("page_id", F.col("id").alias("zone_id"), F.posexplode("target_ids").alias("pos", "segment_id"), "expected_tokens")
    if segments is None:
        expected = assigned.select("page_id", "zone_id", "pos", "segment_id", F.coalesce(F.try_element_at("expected_tokens", "segment_id"), F.array().cast("array<string>")).alias("expected"))
    else:
        tokens = segments.select("page_id", F.col("id").alias("segment_id"), F.transform("protected", lambda t: t["token"]).alias("expected"))
        expected = assigned.drop("expected_tokens").join(tokens, ["page_id", "segment_id"], "left")
    given = results.groupBy("page_id", "zone_id", "segment_id").agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("text"), F.bool_or(F.col("segment_id").isNull() | F.col("text").isNull()).alias("untyped"))
    both = expected.join(given, ["page_id", "zone_id", "segment_id"], "full")
    named = F.when(F.coalesce("untyped", F.lit(False)), F.lit(1)).when(F.col("n") > 1, F.lit(2)).when(F.col("pos").isNull(), F.lit(3)).when(F.col("n").isNull(), F.lit(4)).when(~same_multiset(tokens_in(F.col("text")), F.col("expected")), F.lit(5))
    # missing ids come in the order of the assignment, all others sorted
    broken = both.withColumn("check_ord", named).where("check_ord is not null")
    key = F.struct(F.when(F.col("check_ord").isin(4, 5), F.col("pos")).otherwise(F.lit(0)).alias("pos"), F.coalesce("segment_id", F.lit("")).alias("id"))
    lists = broken.groupBy("page_id", "zone_id", "check_ord").agg(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["id"]).alias("ids"))
    first = lists.withColumn("__r", F.row_number().over(Window.partitionBy("page_id", "zone_id").orderBy("check_ord"))).where("__r = 1")
    ids = F.array_join("ids", ", ")
    error = (
        F.when(F.col("check_ord") == 1, F.lit("translation record must hold strings"))
        .when(F.col("check_ord") == 2, F.concat(F.lit("duplicate translation IDs: "), ids))
        .when(F.col("check_ord") == 3, F.concat(F.lit("unassigned translation IDs: "), ids))
        .when(F.col("check_ord") == 4, F.concat(F.lit("missing translation IDs: "), ids))
        .otherwise(F.concat(F.lit("protected-token multiset changed for "), F.get("ids", F.lit(0))))
    )
    return first.select("page_id", "zone_id", "check_ord", error.alias("error"))


def cover_errors(zones: DataFrame) -> DataFrame:
    """Zones whose token table names other segments than their targets."""
    named = F.map_keys("expected_tokens")
    return zones.where((F.size(F.array_except(named, "target_ids")) > 0) | (F.size(F.array_except("target_ids", named)) > 0)).select("page_id", "id")


def merge_errors(segments: DataFrame, zones: DataFrame, results: DataFrame) -> DataFrame:
    """(page_id, error): what forbids the merge of a whole page."""
    targets = segments.where("target").select("page_id", F.col("id").alias("segment_id"))
    assigned = zones.select("page_id", F.explode("target_ids").alias("segment_id"))
    wrong = targets.exceptAll(assigned).union(assigned.exceptAll(targets)).select("page_id").distinct()
    names = zones.where(~F.col("id").rlike("^zone-[0-9]{3,}$")).select("page_id", F.concat(F.lit("invalid zone ID: "), "id").alias("error"))
    twice = zones.groupBy("page_id", "id").count().where("count > 1").select("page_id", F.lit("duplicate zone ID").alias("error"))
    zone = zone_result_errors(zones, results, segments).select("page_id", "error")
    return wrong.select("page_id", F.lit("zone target IDs do not form an exact partition of source targets").alias("error")).union(names).union(twice).union(zone)


def merged(segments: DataFrame, results: DataFrame) -> DataFrame:
    """Translations in source order, for pages without errors."""
    return segments.where("target").select("page_id", "seg_ord", F.col("id").alias("segment_id")).join(results.drop("zone_id"), ["page_id", "segment_id"])


def id_differences(want: DataFrame, have: DataFrame) -> DataFrame:
    """(page_id, segment_id, side): ids that only one side has; both need (page_id, segment_id)."""
    a, b = want.select("page_id", "segment_id").distinct().withColumn("w", F.lit(1)), have.select("page_id", "segment_id").distinct().withColumn("h", F.lit(1))
    both = a.join(b, ["page_id", "segment_id"], "full").where("w is null or h is null")
    return both.select("page_id", "segment_id", F.when(F.col("h").isNull(), F.lit("missing")).otherwise(F.lit("foreign")).alias("side"))


# ---- reviews


def review_errors(zones: DataFrame, findings: DataFrame, retries: DataFrame, unresolved: DataFrame) -> DataFrame:
    """(page_id, zone_id, check_ord, error) for reviews.

    ``findings(page_id, zone_id, dimension, verdict, evidence)``, ``retries(page_id, zone_id, n)``,
    ``unresolved(page_id, items array<string>)``.
    """
    known = zones.select("page_id", F.col("id").alias("zone_id"))
    tried = known.join(retries, ["page_id", "zone_id"], "full").where(F.coalesce((F.col("n") < 0) | (F.col("n") > MAX_RETRIES), F.lit(True)))
    extra = retries.join(known, ["page_id", "zone_id"], "left_anti").select("page_id", "zone_id")
    bad = findings.where(F.coalesce(~F.col("dimension").isin(*DIMENSIONS) | ~F.col("verdict").isin("pass", "required-fix") | ~F.col("evidence").rlike(r"\S"), F.lit(True)))
    counts = findings.groupBy("page_id", "zone_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("dimension").alias("d"))
    uneven = known.join(counts, ["page_id", "zone_id"], "full").where(f"not (n <=> {len(DIMENSIONS)} and d <=> {len(DIMENSIONS)})")
    derived = findings.where("verdict = 'required-fix'").groupBy("page_id").agg(F.array_sort(F.collect_set(F.concat_ws(":", "zone_id", "dimension"))).alias("derived"))
    empty = F.array().cast("array<string>")
    differs = unresolved.join(derived, "page_id", "full").where(F.coalesce("items", empty) != F.coalesce("derived", empty))

    def told(df: DataFrame, n: int, error: str) -> DataFrame:
        zone = F.col("zone_id") if "zone_id" in df.columns else F.lit(None).cast("string")
        return df.select("page_id", zone.alias("zone_id"), F.lit(n).alias("check_ord"), F.lit(error).alias("error"))

    return (
        told(tried, 1, f"review retries must be integers from 0 to {MAX_RETRIES} for every zone")
        .union(told(extra, 2, "review retries name an unknown zone"))
        .union(told(bad, 3, "review finding is invalid"))
        .union(told(uneven, 4, "review must contain exactly one finding per dimension"))
        .union(told(differs, 5, "unresolved_required does not match the findings"))
        .distinct()
    )


def latest_attempt(results: DataFrame) -> DataFrame:
    """Of repeated results the one of the last attempt: ``results`` has an ``attempt`` column."""
    last = Window.partitionBy("page_id", "zone_id")
    return results.withColumn("__m", F.max("attempt").over(last)).where("attempt = __m").drop("__m")
