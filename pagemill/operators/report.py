"""Evidence: manifests as JSON and review reports as Markdown."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from pagemill.contract import MAX_DETECT_CHARS

POLICY = {"id": "english-technical-first-use-ko-gloss", "version": "1.0"}
TARGET_LANGUAGE = "ko"
TOOL = {"name": "pagemill", "version": "0.1.0"}

# Frequent short words by language, for an approximate guess.
_STOP_WORDS = {
    "de": "der die das und ist von mit für auf nicht ein eine den dem zu im des sich als auch",
    "en": "the of and to in is that it for was on with as by at be this are or from",
    "es": "el la de que y en los del se las por un para con no una su al es lo",
    "fr": "le la les de des et un une est que qui dans pour pas sur au par avec ce il",
    "it": "il lo la di che e un una per non con sono del della da in al gli le si",
    "nl": "de het een en van in is dat op te voor met niet zijn aan er om ook als dan",
    "pt": "o a de que e do da em um para com não uma os no se na por mais as",
}


@lru_cache(1)
def _stop_words() -> dict[str, frozenset[str]]:
    return {k: frozenset(v.split()) for k, v in _STOP_WORDS.items()}


def guess_language(text: str | None) -> str:
    """``und`` without letters; the language of the script, else the one with most frequent words, else ``en``."""
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    if not words:
        return "und"
    letters = "".join(words)
    for lang, span in (("ko", "[가-힣]"), ("ja", "[぀-ヿ]"), ("zh-cn", "[一-鿿]"), ("ru", "[а-яё]"), ("el", "[α-ωά-ώ]"), ("ar", "[ء-ي]"), ("he", "[א-ת]")):
        if 3 * len(re.findall(span, letters)) > len(letters):
            return lang
    hits = {lang: sum(w in own for w in words) for lang, own in _stop_words().items()}
    best = max(hits, key=lambda lang: (hits[lang], lang == "en"))
    return best


def source_language(segments: DataFrame) -> DataFrame:
    """(page_id, source_language) of the targets' texts, the first 100,000 characters of a page."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_ord", "source_text"))), lambda x: x["source_text"]), "\n")
    rows = segments.where("target").groupBy("page_id").agg(F.substring(text, 1, MAX_DETECT_CHARS).alias("text"))
    return rows.select("page_id", arrow_udf(lambda t: pa.array([guess_language(x) for x in t.to_pylist()], pa.string()), "string")("text").alias("source_language"))


def code_span(text: Column) -> Column:
    """An inert Markdown code span: markup, pipes and line ends escaped, one more back-tick than any run inside."""
    plain = F.regexp_replace(text, "\r\n|\r|\n", " ")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("|", "\\|")):
        plain = F.replace(plain, F.lit(a), F.lit(b))
    runs = F.transform(F.regexp_extract_all(plain, F.lit("(`+)"), F.lit(1)), lambda r: F.length(r))
    fence = F.repeat(F.lit("`"), F.coalesce(F.array_max(runs), F.lit(0)) + 1)
    return F.concat(fence, F.lit(" "), plain, F.lit(" "), fence)


def finding_lines(findings: Column) -> Column:
    """Markdown lines of ``array<struct<code, message, evidence (JSON), ...>>``, "None." for none."""
    lines = F.transform(findings, lambda f: F.concat(
        F.lit("- **"), code_span(f["code"]), F.lit("**: "), code_span(f["message"]),
        F.when(f["evidence"] != "{}", F.concat(F.lit("\n  - Evidence: "), code_span(f["evidence"]))).otherwise(F.lit(""))))
    return F.when(F.coalesce(F.size(findings) <= 0, F.lit(True)), F.lit("None.")).otherwise(F.array_join(lines, "\n"))


def ordered(findings: Column) -> Column:
    """By code, message, evidence (severity is one for the list)."""
    return F.array_sort(F.transform(findings, lambda f: F.struct(f["code"].alias("code"), f["message"].alias("message"), f["evidence"].alias("evidence"))))


def manifests(captures: DataFrame, segments: DataFrame, zones: DataFrame, translations: DataFrame, retries: DataFrame, gates: DataFrame) -> DataFrame:
    """(page_id, json): one manifest per page, keys in order."""
    counts = segments.groupBy("page_id").agg(F.count(F.lit(1)).alias("segments"), F.count_if("target").alias("target_segments"))
    translated = translations.groupBy("page_id").agg(F.count_distinct("segment_id").alias("translated_segments"))
    zone_count = zones.groupBy("page_id").agg(F.count(F.lit(1)).alias("zones"))
    tried = retries.groupBy("page_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("zone_id", "n")))).alias("retries"))
    rows = captures
    for part in (counts, translated, zone_count, tried, source_language(segments), gates):
        rows = rows.join(part, "page_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    captured = F.transform(F.array_sort(F.map_entries("asset_map")), lambda e: F.struct(
        F.when(F.array_contains("critical_assets", e["value"]), F.lit("critical")).otherwise(F.lit("optional")).alias("classification"),
        e["value"].alias("local_path"), F.element_at("fingerprints", e["value"]).alias("sha256"), e["key"].alias("source")))
    payload = F.struct(
        F.struct(captured.alias("captured"), F.coalesce("missing_optional_assets", F.array().cast("array<string>")).alias("missing_optional")).alias("assets"),
        F.struct("captured_at", "final_url", "requested_url").alias("capture"),
        F.struct(zero("segments"), zero("target_segments"), zero("translated_segments"), zero("zones")).alias("coverage"),
        F.struct(F.coalesce("source_language", F.lit("und")).alias("source"), F.lit(TARGET_LANGUAGE).alias("target")).alias("languages"),
        F.when(F.col("passed"), F.lit("passed")).otherwise(F.lit("failed")).alias("qa_status"),
        ordered(F.coalesce("required", F.array().cast(_FINDINGS))).alias("required_findings"),
        F.coalesce("retries", F.expr("cast(map() as map<string,int>)")).alias("retries"),
        F.lit("1.0").alias("schema_version"),
        F.col("final_url").alias("source_url"),
        F.struct(*[F.lit(v).alias(k) for k, v in POLICY.items()]).alias("terminology_policy"),
        F.struct(*[F.lit(v).alias(k) for k, v in TOOL.items()]).alias("tool"),
        ordered(F.coalesce("warnings", F.array().cast(_FINDINGS))).alias("warnings"),
    )
    return rows.select("page_id", F.to_json(payload, {"ignoreNullFields": "false"}).alias("json"))


_FINDINGS = "array<struct<ord:int,code:string,message:string,evidence:string>>"


def reports(captures: DataFrame, gates: DataFrame, reviews: DataFrame, unresolved: DataFrame, retries: DataFrame) -> DataFrame:
    """(page_id, markdown): one report per page; ``reviews(page_id, zone_id, dimension, verdict, evidence)``."""
    items = unresolved.groupBy("page_id").agg(F.flatten(F.collect_list("items")).alias("items"))
    tried = retries.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("zone_id", "n"))), lambda x: F.concat(F.lit("| "), code_span(x["zone_id"]), F.lit(" | "), x["n"].cast("string"), F.lit(" |"))), "\n").alias("tried"))
    zone = reviews.groupBy("page_id", "zone_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.concat_ws(": ", "dimension", "verdict", "evidence"))), lambda x: F.concat(F.lit("  - "), code_span(x))), "\n").alias("lines"))
    seen = zone.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("zone_id", "lines"))), lambda x: F.concat(F.lit("- **"), code_span(x["zone_id"]), F.lit("**\n"), x["lines"])), "\n").alias("sections"))
    rows = captures.select("page_id", "final_url")
    for part in (gates, items, tried, seen):
        rows = rows.join(part, "page_id", "left")
    none = F.lit("None.")
    left = F.when(F.coalesce(F.size("items") <= 0, F.lit(True)), none).otherwise(F.array_join(F.transform(F.array_sort("items"), lambda x: F.concat(F.lit("- "), code_span(x))), "\n"))
    text = F.concat_ws(
        "\n", F.lit("# Translation QA Review Report\n"), F.concat(F.lit("- Status: **"), F.when(F.col("passed"), F.lit("PASS")).otherwise(F.lit("FAIL")), F.lit("**")),
        F.concat(F.lit("- Source: "), code_span(F.col("final_url"))), F.lit("- Screenshots: 0"),
        F.lit("\n## Automated required findings\n"), finding_lines(ordered(F.col("required"))), F.lit("\n## Warnings\n"), finding_lines(ordered(F.col("warnings"))),
        F.lit("\n## Browser evidence\n\nNo browser evidence recorded."), F.lit("\n## Master semantic review\n\n### Unresolved required items\n"), left,
        F.lit("\n### Translation retries\n"), F.coalesce(F.concat(F.lit("| Zone | Retries |\n| --- | ---: |\n"), F.col("tried")), none),
        F.lit("\n### Section findings\n"), F.coalesce("sections", none), F.lit(""),
    )
    return rows.select("page_id", text.alias("markdown"))
