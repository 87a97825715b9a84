"""Pages and what they load, as tables: references, fetched bodies, style sheets that import others, offline markup.

There is no network here.  ``bodies(url, status, location, content_type, content)`` is what a fetcher has brought;
a location makes a redirect.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from pagemill.contract import MAX_ASSET_BYTES, MAX_CSS_DEPTH, MAX_HTML_BYTES, MAX_REDIRECTS, MAX_REQUESTS, MAX_TOTAL_BYTES, MAX_TOTAL_REDIRECTS, CaptureError
from pagemill.functions import css as C
from pagemill.functions import html as H
from pagemill.functions import urls as U
from pagemill.operators.nodes import elements
from pagemill.operators.qa import css_urls
from pagemill.plans.cut import cut


def _strings(f):
    return lambda values: pa.array([f(v) for v in values.to_pylist()], pa.string())


def url_error(column: Column | str) -> Column:
    """Why an address isn't public, null if it is."""
    return arrow_udf(_strings(U.public_url_error), "string")(column)


def url_join(base: Column | str, reference: Column | str) -> Column:
    def join(bases: pa.Array, refs: pa.Array) -> pa.Array:
        return pa.array([None if r is None or b is None else U.absolute(b, r) for b, r in zip(bases.to_pylist(), refs.to_pylist(), strict=True)], pa.string())

    return arrow_udf(join, "string")(base, reference)


def srcset_candidates(column: Column | str) -> Column:
    def parse(values: pa.Array) -> pa.Array:
        return pa.array([[{"url": u, "descriptor": d} for u, d in U.srcset(v or "")] for v in values.to_pylist()], pa.list_(pa.struct([("url", pa.string()), ("descriptor", pa.string())])))

    return arrow_udf(parse, "array<struct<url:string,descriptor:string>>")(column)


def suffix(path: Column, content_type: Column) -> Column:
    """The suffix of the media type, else a short plain one of the path, else ``.bin``."""
    known = F.create_map(*[F.lit(x) for p in U.SUFFIXES.items() for x in p])
    media = F.lower(F.trim(F.split(F.coalesce(content_type, F.lit("")), ";")[0]))
    own = F.lower(F.regexp_extract(path, r"(?<=[^/])(\.[A-Za-z0-9]{1,10})$", 1))
    return F.coalesce(F.try_element_at(known, media), F.nullif(own, F.lit("")), F.lit(".bin"))


def asset_name(url: Column, content_type: Column) -> Column:
    path = F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    return F.concat(F.lit("assets/"), F.substring(F.sha2(url, 256), 1, 16), suffix(path, content_type))


def with_fragment(path: Column, fragment: Column) -> Column:
    return F.when(F.coalesce(fragment, F.lit("")) == "", path).otherwise(F.concat(path, F.lit("#"), fragment))


def offline(reference: Column) -> Column:
    return F.lower(reference).rlike(r"^\s*(#|data:|blob:)")


def css_relative(from_sheet: Column, target: Column) -> Column:
    """All assets lie in one folder: within a sheet their paths are their names."""
    return F.when(from_sheet.isNull() | target.contains("://") | offline(target), target).otherwise(F.regexp_replace(target, "^assets/", ""))


# ---- which pages can be handled


def unsupported_pages(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """(page_id, error) of pages behind a login, a challenge or a script."""
    auth = r"(?i)(?:^|[^a-z0-9])(?:login|log-in|signin|sign-in|auth|session)(?:[^a-z0-9]|$)"
    own = elements(nodes)
    attr = lambda name: F.coalesce(F.col("attrs")[name], F.lit(""))
    password = own.where("tag = 'input'").where(F.lower(attr("type")) == "password").select("page_id").distinct()
    forms = own.where("tag = 'form'").select("page_id", F.col("pre").alias("form"), "post", F.array(attr("action"), attr("id"), attr("class")).alias("a"))
    in_form = F.get(F.filter("ancestors", lambda a: a["tag"] == "form"), F.lit(0))["pre"]
    texts = nodes.where("kind = 'text'").withColumn("form", in_form).where("form is not null").groupBy("page_id", "form").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", F.trim("text").alias("t")))), lambda x: x["t"]), " ").alias("t"))
    controls = own.where("tag in ('input', 'button')").withColumn("form", in_form).where("form is not null").groupBy("page_id", "form").agg(F.flatten(F.collect_list(F.array(attr("name"), attr("id"), attr("value"), attr("aria-label")))).alias("c"))
    both = forms.join(texts, ["page_id", "form"], "left").join(controls, ["page_id", "form"], "left")
    named = F.exists(F.concat("a", F.coalesce("c", F.array().cast("array<string>"))), lambda x: x.rlike(auth)) | F.coalesce(F.col("t").rlike(r"(?i)\b(?:log|sign)[ -]?in\b"), F.lit(False))
    login = both.where(named).select("page_id").distinct()
    captcha = pages.where(F.lower("html").rlike("g-recaptcha|h-captcha|hcaptcha|recaptcha")).select("page_id")
    above = F.transform("ancestors", lambda a: a["tag"])
    visible = nodes.where("kind = 'text'").where(~F.arrays_overlap(above, F.array(F.lit("script"), F.lit("style"), F.lit("noscript"))))
    length = visible.groupBy("page_id").agg(F.sum(F.length(F.trim(F.regexp_replace("text", r"\s+", " ")))).alias("n"))
    titles = nodes.where("kind = 'text'").where(F.arrays_overlap(above, F.array(F.lit("title"), F.lit("h1"))))
    challenge = titles.where(F.trim(F.regexp_replace(F.lower("text"), "[^a-z ]+", "")).isin("just a moment", "security check", "verify you are human")).select("page_id").distinct()
    marked = pages.where(F.lower("html").rlike("checking your browser|verify you are human|cf-challenge|challenge-form|captcha")).select("page_id")
    interstitial = challenge.join(marked, "page_id", "left_semi").join(length.where("n <= 500"), "page_id", "left_semi")
    scripted = own.where("tag = 'script'").select("page_id").distinct()
    empty = scripted.join(length.where("n > 0"), "page_id", "left_anti")
    shells = own.where(F.lower(attr("id")).rlike("^(app|root|__next|__nuxt)$")).select("page_id", F.col("pre").alias("a"), F.col("post").alias("z"))
    inside = shells.join(visible.select("page_id", "pre", "text"), "page_id").where("pre > a and pre <= z").groupBy("page_id", "a").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "text"))), lambda x: x["text"]), " ").alias("t"))
    waiting = inside.where(F.trim(F.regexp_replace(F.lower("t"), r"[.\s]+", " ")).isin("loading", "please wait", "initializing")).join(scripted, "page_id", "left_semi").select("page_id").distinct()

    def told(df: DataFrame, n: int, kind: str) -> DataFrame:
        return df.select("page_id", F.lit(n).alias("check_ord"), F.lit(f"unsupported {kind} page").alias("error"))

    all_errors = told(password, 1, "authentication").union(told(captcha, 2, "CAPTCHA")).union(told(login, 3, "authentication")).union(told(interstitial, 4, "interstitial")).union(told(waiting.union(empty), 5, "JavaScript-only"))
    return all_errors.groupBy("page_id").agg(F.min_by("error", "check_ord").alias("error"))


def oversized_pages(pages: DataFrame) -> DataFrame:
    return pages.where(F.octet_length("html") > MAX_HTML_BYTES).select("page_id")


# ---- references


def base_urls(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """(page_id, url, base): where a page's references resolve."""
    own = elements(nodes).where("tag = 'base' and map_contains_key(attrs, 'href')").groupBy("page_id").agg(F.min_by(F.col("attrs")["href"], "pre").alias("href"))
    return pages.select("page_id", "url").join(own, "page_id", "left").select("page_id", "url", F.coalesce(url_join("url", "href"), F.col("url")).alias("base"))


def page_refs(nodes: DataFrame) -> DataFrame:
    """(page_id, ord, tag, attr, raw, kind, critical): what a page loads, in document order."""
    own = elements(nodes)
    rels = F.split(F.lower(F.coalesce(F.col("attrs")["rel"], F.lit(""))), r"\s+")
    links = own.where("tag = 'link' and map_contains_key(attrs, 'href')").withColumn("kind", F.when(F.array_contains(rels, "stylesheet"), F.lit("stylesheet")).when(F.arrays_overlap(rels, F.array(F.lit("icon"), F.lit("apple-touch-icon"), F.lit("mask-icon"))), F.lit("image")))
    links = links.where("kind is not null").select("page_id", "pre", F.lit(0).alias("n"), "tag", F.lit("href").alias("attr"), F.col("attrs")["href"].alias("raw"), "kind")
    media = own.where("tag in ('img', 'source')")
    src = media.where("map_contains_key(attrs, 'src')").select("page_id", "pre", F.lit(0).alias("n"), "tag", F.lit("src").alias("attr"), F.col("attrs")["src"].alias("raw"), F.lit("image").alias("kind"))
    sets = media.where("map_contains_key(attrs, 'srcset')").select("page_id", "pre", "tag", F.posexplode(srcset_candidates(F.col("attrs")["srcset"])).alias("n", "c"))
    sets = sets.select("page_id", "pre", (F.col("n") + 1).alias("n"), "tag", F.lit("srcset").alias("attr"), F.col("c.url").alias("raw"), F.lit("image").alias("kind"))
    styles = nodes.where("kind = 'text'").where(F.get("ancestors", F.lit(0))["tag"] == "style").select("page_id", "pre", F.lit("style").alias("tag"), F.lit("text").alias("attr"), F.col("text").alias("css"))
    styles = styles.union(own.where("map_contains_key(attrs, 'style')").select("page_id", "pre", "tag", F.lit("style"), F.col("attrs")["style"]))
    used = styles.select("page_id", "pre", "tag", "attr", F.posexplode(css_urls(F.col("css"))).alias("n", "u"))
    imported = (F.col("u.context") == "import") & (F.col("attr") == "text")
    in_css = used.select("page_id", "pre", (F.col("n") + 1_000_000).alias("n"), "tag", "attr", F.col("u.url").alias("raw"), F.when(imported, F.lit("stylesheet")).otherwise(F.lit("asset")).alias("kind"))
    rows = links.union(src).union(sets).union(in_css)
    order = Window.partitionBy("page_id").orderBy("pre", "n")
    return rows.select("page_id", F.row_number().over(order).alias("ord"), "tag", "attr", "raw", "kind", (F.col("kind") == "stylesheet").alias("critical"))


def resolved_refs(refs: DataFrame, bases: DataFrame) -> DataFrame:
    """Adds ``url``, ``fragment`` and ``error`` to references that need the network."""
    rows = refs.where(~offline(F.col("raw"))).join(bases.select("page_id", "base"), "page_id").withColumn("whole", url_join("base", F.trim("raw")))
    parts = F.split("whole", "#", 2)
    return rows.withColumns({"url": parts[0], "fragment": F.get(parts, F.lit(1))}).withColumn("error", url_error("url")).drop("whole")


def redirects(bodies: DataFrame) -> DataFrame:
    """(url, final, hops, error): where each address ends, by at most ``MAX_REDIRECTS`` hops."""
    now = bodies.select("url", F.col("url").alias("final"), F.lit(0).alias("hops"))
    step = bodies.where("location is not null").select(F.col("url").alias("final"), url_join("url", "location").alias("next"))
    for _ in range(MAX_REDIRECTS + 1):
        now = now.join(step, "final", "left").select("url", F.coalesce("next", "final").alias("final"), (F.col("hops") + F.col("next").isNotNull().cast("int")).alias("hops"))
    return now.withColumn("error", F.when(F.col("hops") > MAX_REDIRECTS, F.lit("too many redirects")).otherwise(url_error("final")))


def content_error(kind: Column, content_type: Column, content: Column) -> Column:
    media = F.lower(F.trim(F.split(F.coalesce(content_type, F.lit("")), ";")[0]))
    binary = media.isin("application/octet-stream", "binary/octet-stream", "application/font-woff", "application/vnd.ms-fontobject") | media.startswith("application/x-font-")
    named = F.when(media == "", F.lit("no content type")).otherwise(media)
    return (
        F.when(F.coalesce(F.octet_length(content), F.lit(0)) == 0, F.lit("asset response body is empty"))
        .when(F.octet_length(content) > MAX_ASSET_BYTES, F.lit("asset exceeds the size limit"))
        .when((kind == "stylesheet") & (media != "text/css"), F.concat(F.lit("critical stylesheet returned "), named))
        .when((kind == "image") & ~media.startswith("image/"), F.concat(F.lit("image asset returned "), named))
        .when((kind == "asset") & ~(media.rlike("^(image|font)/") | binary), F.concat(F.lit("asset returned unsupported "), named))
    )


def assets(refs: DataFrame, bodies: DataFrame) -> DataFrame:
    """One row per page and address: local path, digest, class or error; ``refs`` are resolved references.

    An asset that was first an optional one can't become a style sheet later: ``error`` then says so.
    """
    ends = redirects(bodies)
    got = ends.join(bodies.select(F.col("url").alias("final"), "content_type", "content"), "final", "left")
    first = refs.groupBy("page_id", "url").agg(
        F.min("ord").alias("ord"), F.min_by("kind", "ord").alias("kind"), F.bool_or("critical").alias("critical"),
        F.min(F.when(F.col("critical"), F.col("ord"))).alias("c"), F.min(F.when(~F.col("critical"), F.col("ord"))).alias("o"), F.min("error").alias("url_error"),
    )
    rows = first.join(got.withColumnRenamed("error", "hop_error"), "url", "left")
    reused = F.when(F.col("c").isNotNull() & (F.col("o") < F.col("c")), F.lit("cannot reuse an optional asset as a critical stylesheet"))
    kind = F.when(F.col("critical"), F.lit("stylesheet")).otherwise(F.col("kind"))
    error = F.coalesce("url_error", "hop_error", F.when(F.col("final").isNull(), F.lit("asset was not fetched")), reused, content_error(kind, F.col("content_type"), F.col("content")))
    return rows.select(
        "page_id", "ord", "url", "final", F.when(error.isNull(), asset_name(F.col("url"), F.col("content_type"))).alias("local_path"),
        F.when(error.isNull(), F.sha2("content", 256)).alias("sha256"), F.when(F.col("critical"), F.lit("critical")).otherwise(F.lit("optional")).alias("classification"),
        "kind", F.octet_length("content").alias("bytes"), "content", "hops", error.alias("error"),
    )


def imported_refs(sheets: DataFrame, depth: int) -> DataFrame:
    """References of style sheets ``(page_id, ord, final, content)`` as rows of ``page_refs`` with their base; deeper than
    ``MAX_CSS_DEPTH`` imports are errors."""

    rows = sheets.select("page_id", "ord", F.col("final").alias("base"), F.posexplode(css_urls(F.col("content").cast("string"))).alias("n", "u"))
    imported = F.col("u.context") == "import"
    too_deep = F.when(imported & (F.lit(depth) > MAX_CSS_DEPTH), F.lit(f"critical stylesheet exceeds import depth {MAX_CSS_DEPTH}"))
    return rows.select("page_id", "ord", F.lit("css").alias("tag"), F.col("u.context").alias("attr"), F.col("u.url").alias("raw"), F.when(imported, F.lit("stylesheet")).otherwise(F.lit("asset")).alias("kind"), imported.alias("critical"), "base", too_deep.alias("depth_error"))


def closure(refs: DataFrame, bases: DataFrame, bodies: DataFrame) -> DataFrame:
    """All assets of pages, style sheets followed through their imports."""
    columns = ["page_id", "ord", "url", "kind", "critical", "error"]
    # one table a level: a level else would compute all those before it again
    known = cut(resolved_refs(refs, bases).select(*columns))
    sheets = assets(known, bodies).where("error is null and classification = 'critical'")
    for depth in range(1, MAX_CSS_DEPTH + 2):
        more = imported_refs(sheets, depth).where(~offline(F.col("raw"))).withColumn("whole", url_join("base", F.trim("raw")))
        more = more.withColumn("url", F.split("whole", "#", 2)[0]).withColumn("error", F.coalesce("depth_error", url_error("url")))
        fresh = cut(more.select(*columns).join(known.where("critical").select("page_id", "url").distinct(), ["page_id", "url"], "left_anti").select(*columns))
        if fresh.isEmpty():
            break
        known = known.union(fresh)
        sheets = assets(fresh, bodies).where("error is null and classification = 'critical'")
    return assets(known, bodies)


def budget_errors(fetches: DataFrame) -> DataFrame:
    """First fetch of a page at which a budget runs out: ``fetches(page_id, ord, url, hops, bytes)``."""
    order = Window.partitionBy("page_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    first = Window.partitionBy("page_id", "url").orderBy("ord")
    rows = fetches.withColumn("new", (F.row_number().over(first) == 1).cast("int"))
    sums = rows.withColumns({"requests": F.sum("new").over(order), "redirects": F.sum("hops").over(order), "total": F.sum("bytes").over(order)})
    what = F.when(F.col("requests") > MAX_REQUESTS, F.lit("requests")).when(F.col("redirects") > MAX_TOTAL_REDIRECTS, F.lit("redirects")).when(F.col("total") > MAX_TOTAL_BYTES, F.lit("downloaded bytes"))
    over = sums.withColumn("what", what).where("what is not null")
    return over.groupBy("page_id").agg(F.min("ord").alias("ord"), F.min_by("what", "ord").alias("what")).select("page_id", "ord", F.concat(F.lit("resource budget exceeded: "), "what").alias("error"))


# ---- markup


def rewrite_page(html: str, url: str, local: dict[str, str]) -> str:
    """The page with references to local files; ``local`` maps whole addresses to paths."""
    root = H.parse(html)
    nodes = [n for n in root.walk() if n.element]
    base = next((U.absolute(url, n.attrs["href"]) for n in nodes if n.tag == "base" and "href" in n.attrs), url)

    def place(reference: str) -> str:
        if U.offline_reference(reference):
            return reference
        whole, _, fragment = U.absolute(base, reference.strip()).partition("#")
        path = local.get(whole)
        return reference if path is None else path + (f"#{fragment}" if fragment else "")

    def in_css(use: C.Use) -> str:
        return U.same_document(use.url, base) or place(use.url)

    for n in nodes:
        if n.tag == "base":
            n.parent.children.remove(n)
        rels = n.attrs.get("rel", "").lower().split() if n.tag == "link" else []
        if "href" in n.attrs and {"stylesheet", "icon", "apple-touch-icon", "mask-icon"} & set(rels):
            n.attrs["href"] = place(n.attrs["href"])
        if n.tag in ("img", "source"):
            if "src" in n.attrs:
                n.attrs["src"] = place(n.attrs["src"])
            if "srcset" in n.attrs:
                n.attrs["srcset"] = ", ".join(" ".join(filter(None, (place(u), d))) for u, d in U.srcset(n.attrs["srcset"]))
        if "style" in n.attrs:
            n.attrs["style"] = C.declarations(n.attrs["style"], in_css)
        if n.tag == "style":
            for c in n.children:
                c.text = C.rewrite(c.text, in_css)
        if n.tag == "a" and "href" in n.attrs and not n.attrs["href"].startswith("#"):
            n.attrs["href"] = U.same_document(n.attrs["href"], url) if U.absolute(base, n.attrs["href"]).partition("#")[0] == url.partition("#")[0] and "#" in n.attrs["href"] else U.absolute(base, n.attrs["href"])
    return H.serialize(root)


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            html = rewrite_page(row["html"] or "", row["url"] or "", {x["url"]: x["local_path"] for x in row["local"] or []})
            yield pa.RecordBatch.from_arrays([pa.array([row["page_id"]], pa.int64()), pa.array([html], pa.string())], ["page_id", "html"])


def rewrite_pages(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(page_id, html): offline markup; ``found`` are the assets."""
    paths = found.where("error is null").groupBy("page_id").agg(F.collect_list(F.struct("url", "local_path")).alias("local"))
    return pages.select("page_id", "url", "html").join(paths, "page_id", "left").select("page_id", "url", "html", "local").mapInArrow(_rewrite, "page_id bigint, html string")


def rewrite_sheet(css: str, base: str, local: dict[str, str]) -> str:
    """A captured sheet: addresses become names beside it; a sheet without a sound rule is an error."""

    def place(use: C.Use) -> str:
        whole, _, fragment = U.absolute(base, use.url).partition("#")
        path = local.get(whole)
        return U.same_document(use.url, base) or (use.url if path is None else path.removeprefix("assets/") + (f"#{fragment}" if fragment else ""))

    return C.rewrite(C.checked(css), place)


def data_stylesheets(column: Column | str) -> Column:
    """``struct<css, error>`` of a ``data:text/css`` address."""

    def decode(values: pa.Array) -> pa.Array:
        rows = []
        for v in values.to_pylist():
            try:
                rows.append({"css": U.data_stylesheet(v or ""), "error": None})
            except CaptureError as e:
                rows.append({"css": None, "error": str(e)})
        return pa.array(rows, pa.struct([("css", pa.string()), ("error", pa.string())]))

    return arrow_udf(decode, "css string, error string")(column)


def capture_record(pages: DataFrame, found: DataFrame, marked: DataFrame, captured_at: str) -> DataFrame:
    """One row per page: what was captured, with two maps and sorted lists."""
    ok = found.where("error is null").groupBy("page_id").agg(
        F.map_from_entries(F.array_sort(F.array_distinct(F.collect_list(F.struct("url", "local_path"))))).alias("asset_map"),
        F.map_from_entries(F.array_sort(F.array_distinct(F.collect_list(F.struct("local_path", "sha256"))))).alias("fingerprints"),
        F.array_sort(F.collect_set(F.when(F.col("classification") == "critical", F.col("local_path")))).alias("critical_assets"),
        F.array_sort(F.collect_set(F.when(F.col("classification") == "optional", F.col("local_path")))).alias("optional_assets"),
    )
    lost = found.where("error is not null and classification = 'optional'").groupBy("page_id").agg(F.array_sort(F.collect_set("url")).alias("missing_optional_assets"))
    rows = pages.select("page_id", "url").join(ok, "page_id", "left").join(lost, "page_id", "left").join(marked.select("page_id", F.sha2("html", 256).alias("source_sha256")), "page_id", "left")
    return rows.select("page_id", F.col("url").alias("requested_url"), F.col("url").alias("final_url"), F.lit(captured_at).alias("captured_at"), "asset_map", "fingerprints", "critical_assets", "optional_assets", "missing_optional_assets", "source_sha256")


def capture_errors(captures: DataFrame) -> DataFrame:
    """(page_id, check_ord, error): records whose parts don't fit together."""
    paths = F.array_distinct(F.map_values("asset_map"))
    error = (
        F.when(~F.col("captured_at").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$") | F.try_to_timestamp("captured_at").isNull(), F.lit("1 captured_at must be whole-second UTC"))
        .when(F.arrays_overlap("critical_assets", "optional_assets"), F.lit("2 asset classes overlap"))
        .when(F.array_sort(F.array_union("critical_assets", "optional_assets")) != F.array_sort(paths), F.lit("3 asset classes don't cover the assets"))
        .when(F.array_sort(F.map_keys("fingerprints")) != F.array_sort(paths), F.lit("4 fingerprints don't cover the assets"))
        .when(F.exists(F.map_values("fingerprints"), lambda h: ~h.rlike("^[0-9a-f]{64}$")), F.lit("5 fingerprint is no SHA-256"))
        .when(F.exists(paths, lambda p: ~p.rlike(r"^assets/[^/\\]+$") | p.isin("assets/.", "assets/..")), F.lit("6 asset path is unsafe"))
    )
    return captures.select("page_id", error.alias("e")).where("e is not null").select("page_id", F.substring("e", 1, 1).cast("int").alias("check_ord"), F.expr("substring(e, 3)").alias("error"))


def run_id(url: Column, at: Column) -> Column:
    """Host, path and time as one plain name."""

    def slug(text: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(text, "[^a-zA-Z0-9._-]+", "-"), "^[.\\-_]+|[.\\-_]+$", "")

    host = F.regexp_extract(url, r"^[a-z]+://([^/:?#]+)", 1)
    path = F.coalesce(F.try_url_decode(F.replace(F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1), F.lit("+"), F.lit("%2B"))), F.lit(""))
    parts = F.filter(F.array(slug(F.lower(host)), slug(path), F.date_format(at, "yyyyMMdd-HHmmss")), lambda x: x != "")
    return F.array_join(parts, "-")
