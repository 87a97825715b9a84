"""Zones: ordered, size-bounded assignments of segments with read-only neighbours."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from pagemill.contract import MAX_TARGET_ZONES, MAX_ZONE_CHARS, ZoneError
from pagemill.functions import packing


def _by(*columns: str):
    return Window.partitionBy(*columns)


def check_parameters(max_chars, target_zones) -> None:
    if type(max_chars) is not int or max_chars <= 0:
        raise ZoneError("max_chars must be a positive integer")
    if target_zones is not None and (type(target_zones) is not int or not 0 < target_zones <= MAX_TARGET_ZONES):
        raise ZoneError(f"target_zones must be an integer from 1 through {MAX_TARGET_ZONES}")


def row_key(semantic_type: Column) -> Column:
    """The table row that a cell belongs to; null for anything else, also for located cells."""
    key = F.regexp_extract(semantic_type, "^(table_cell|table_header):row:(.+)$", 2)
    return F.when(key != "", key)


def sections(segments: DataFrame) -> DataFrame:
    """Targets with their ``section``: a heading opens one, unless no target has come since the last."""
    headings = F.sum((F.col("semantic_type") == "heading").cast("int")).over(_by("page_id").orderBy("seg_ord").rowsBetween(Window.unboundedPreceding, 0))
    numbered = segments.withColumn("__h", headings).where("target")
    return numbered.withColumn("section", F.dense_rank().over(_by("page_id").orderBy("__h"))).drop("__h")


def units(targets: DataFrame) -> DataFrame:
    """Targets with their ``unit``: rows of a table stay whole, rows that overlap stay together."""
    order = _by("page_id", "section").orderBy("seg_ord")
    placed = targets.withColumns({"__at": F.row_number().over(order), "__key": row_key(F.col("semantic_type"))})
    of_row = _by("page_id", "section", "__key")
    first, last = F.min("__at").over(of_row), F.max("__at").over(of_row)
    reach = placed.withColumn("__end", F.when(F.col("__key").isNotNull() & (first == F.col("__at")), last).otherwise(F.col("__at")))
    before = F.max("__end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = reach.withColumn("__new", F.when(F.col("__at") <= F.coalesce(before, F.lit(0)), 0).otherwise(1))
    return starts.withColumn("unit", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__at", "__key", "__end", "__new")


def items(unit_rows: DataFrame, max_chars: int, atomic: bool) -> DataFrame:
    """One row per thing to pack: whole sections that fit, else (or with ``atomic``) units."""
    rows = unit_rows.withColumn("chars", F.length("source_text"))
    by_unit = rows.groupBy("page_id", "section", "unit").agg(F.sum("chars").alias("chars"), F.min("seg_ord").alias("first"), F.min("semantic_type").alias("any_type"), F.array_sort(F.collect_list("id")).alias("ids"))
    of_section = _by("page_id", "section")
    by_unit = by_unit.withColumns({"section_chars": F.sum("chars").over(of_section), "ends": F.col("unit") == F.max("unit").over(of_section)})
    whole = F.lit(False) if atomic else F.col("section_chars") <= max_chars
    part = by_unit.withColumn("part", F.when(whole, F.lit(0)).otherwise(F.col("unit")))
    packed = part.groupBy("page_id", "section", "part").agg(F.sum("chars").alias("chars"), F.max("ends").alias("ends"), F.min("first").alias("first"))
    return packed.withColumn("item", F.row_number().over(_by("page_id").orderBy("section", "part")))


def oversized(unit_rows: DataFrame, max_chars: int) -> DataFrame:
    """(page_id, first, error) of units that no zone can hold."""
    unit = unit_rows.groupBy("page_id", "section", "unit").agg(
        F.sum(F.length("source_text")).alias("chars"), F.array_sort(F.collect_list(F.struct("seg_ord", "id", row_key(F.col("semantic_type")).alias("key")))).alias("x"))
    ids = F.array_join(F.transform("x", lambda x: x["id"]), ", ")
    key = F.get("x", F.lit(0))["key"]
    error = F.when(key.isNull(), F.concat(F.lit("indivisible segment "), ids, F.lit(" exceeds max_chars"))).otherwise(F.concat(F.lit("indivisible table row "), key, F.lit(" exceeds max_chars: "), ids))
    return unit.where(F.col("chars") > max_chars).select("page_id", F.get("x", F.lit(0))["seg_ord"].alias("first"), error.alias("error"))


def zone_numbers(packable: DataFrame, max_chars: int, target_zones: int | None) -> DataFrame:
    """Adds ``zone`` (from 1) to items: a row per page goes through the packing."""

    def run(chars: pa.Array, ends: pa.Array) -> pa.Array:
        return pa.array([packing.pack(c, e, max_chars, target_zones) for c, e in zip(chars.to_pylist(), ends.to_pylist(), strict=True)], pa.list_(pa.int32()))

    lists = packable.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("item", "chars", "ends", "section", "part"))).alias("x"))
    chars, ends = F.transform("x", lambda x: x["chars"].cast("int")), F.transform("x", lambda x: x["ends"])
    packed = lists.withColumn("zones", arrow_udf(run, "array<int>")(chars, ends))
    rows = packed.select("page_id", F.explode(F.arrays_zip("x", "zones")).alias("y"))
    return rows.select("page_id", "y.x.section", "y.x.part", (F.col("y.zones") + 1).alias("zone"))


def greedy_sql(packable: DataFrame, max_chars: int) -> DataFrame:
    """The same for greedy packing, in built-in functions: (page_id, item, zone); for pages of some hundred items."""
    lists = packable.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("item", F.col("chars").cast("bigint").alias("chars")))).alias("x"))
    folded = F.expr(f"""aggregate(x, named_struct('zone', 1, 'fill', 0L, 'out', array_repeat(named_struct('item', 0, 'zone', 0), 0)),
        (a, i) -> if(size(a.out) > 0 and a.fill + i.chars > {max_chars},
            named_struct('zone', a.zone + 1, 'fill', i.chars, 'out', concat(a.out, array(named_struct('item', i.item, 'zone', a.zone + 1)))),
            named_struct('zone', a.zone, 'fill', a.fill + i.chars, 'out', concat(a.out, array(named_struct('item', i.item, 'zone', a.zone))))), a -> a.out)""")
    return lists.select("page_id", F.explode(folded).alias("o")).select("page_id", "o.*")


def assigned(segments: DataFrame, max_chars: int = MAX_ZONE_CHARS, target_zones: int | None = None) -> DataFrame:
    """Targets with the number of their zone."""
    check_parameters(max_chars, target_zones)
    placed = units(sections(segments))
    plain = items(placed, max_chars, atomic=target_zones is not None)
    numbered = zone_numbers(plain, max_chars, target_zones)
    section = numbered.select("page_id", "section", "part", "zone")
    keyed = placed.join(section.withColumnRenamed("part", "__p"), ["page_id", "section"]).where("__p = 0 or __p = unit").drop("__p")
    return keyed


def plan(segments: DataFrame, max_chars: int = MAX_ZONE_CHARS, target_zones: int | None = None) -> DataFrame:
    """One row per zone: id, heading path, ordered targets, neighbours within the budget, expected tokens."""
    order = _by("page_id").orderBy("seg_ord")

    def near(offset: int) -> Column:
        x = F.struct("id", F.length("source_text").alias("n"))
        return F.lag(x, offset).over(order) if offset > 0 else F.lead(x, -offset).over(order)

    around = segments.select("page_id", "seg_ord", near(1).alias("b1"), near(2).alias("b2"), near(-1).alias("a1"), near(-2).alias("a2"))
    rows = assigned(segments, max_chars, target_zones).join(around, ["page_id", "seg_ord"])
    tokens = F.transform("protected", lambda t: t["token"])
    zones = rows.groupBy("page_id", "zone").agg(
        F.array_sort(F.collect_list(F.struct("seg_ord", "id", tokens.alias("tokens")))).alias("x"),
        F.min_by("heading_path", "seg_ord").alias("heading_path"),
        (F.lit(max_chars) - F.sum(F.length("source_text"))).alias("budget0"),
        *[F.min_by(b, "seg_ord").alias(b) for b in ("b1", "b2")],
        *[F.max_by(a, "seg_ord").alias(a) for a in ("a1", "a2")],
    )
    # nearest first, before before after; one that doesn't fit is passed over
    for k, c in enumerate(("b1", "a1", "b2", "a2")):
        fits = F.col(f"budget{k}").isNotNull() & F.col(c).isNotNull() & (F.col(f"{c}.n") <= F.col(f"budget{k}")) & (F.col("budget0") > 0)
        zones = zones.withColumn(f"take_{c}", F.coalesce(fits, F.lit(False))).withColumn(f"budget{k + 1}", F.col(f"budget{k}") - F.when(F.col(f"take_{c}"), F.col(f"{c}.n")).otherwise(0))

    def taken(*names: str) -> Column:
        return F.array_compact(F.array(*[F.when(F.col(f"take_{c}"), F.col(f"{c}.id")) for c in names]))

    return zones.select(
        "page_id", F.col("zone").alias("zone_ord"), F.format_string("zone-%03d", "zone").alias("id"), "heading_path",
        F.transform("x", lambda x: x["id"]).alias("target_ids"), taken("b2", "b1").alias("context_before_ids"), taken("a1", "a2").alias("context_after_ids"),
        F.lit(0).alias("attempt"), F.map_from_entries(F.transform("x", lambda x: F.struct(x["id"], x["tokens"]))).alias("expected_tokens"),
    )


def zone_targets(zones: DataFrame) -> DataFrame:
    """(page_id, zone_ord, zone_id, pos, segment_id)."""
    return zones.select("page_id", "zone_ord", F.col("id").alias("zone_id"), F.posexplode("target_ids").alias("pos", "segment_id"))


def partition_errors(segments: DataFrame, zones: DataFrame) -> DataFrame:
    """Pages whose zones aren't an exact ordered partition of the targets."""
    want = segments.where("target").groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seg_ord", "id"))), lambda x: x["id"]).alias("want"))
    have = zones.groupBy("page_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("zone_ord", "target_ids"))), lambda x: x["target_ids"])).alias("have"))
    return want.join(have, "page_id", "full").where("not (want <=> have)").select("page_id")


def duplicate_ids(segments: DataFrame) -> DataFrame:
    return segments.groupBy("page_id", "id").count().where("count > 1").select("page_id", "id")


def zone_payload(zones: DataFrame) -> DataFrame:
    """(page_id, id, json): a zone as it is written, keys in order."""
    fields = ["attempt", "context_after_ids", "context_before_ids", "expected_tokens", "heading_path", "id", "target_ids"]
    return zones.select("page_id", "id", F.to_json(F.struct(*fields)).alias("json"))
