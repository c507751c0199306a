"""End-to-end load: inventory, gate, pages, extraction, clean-up, merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fixatlas import fixed
from fixatlas.functions import urls as ux
from fixatlas.operators import discovery, extract
from fixatlas.operators.dedup import dedup_issues
from fixatlas.operators.merge import merge_issues, upsert_manifest
from fixatlas.operators.report import fetch_report
from fixatlas.sources.pages import latest_attempts, parse_pages, parse_pages_by, usable_pages
from fixatlas.sources.scratch import fresh_folder


def due_pages(inventory: DataFrame, manifest: DataFrame) -> DataFrame:
    """Pages to read in this run: issue pages, changed since, landing pages dropped.

    Everything here works on addresses; no page body is touched before this is done.
    """
    issue_pages = discovery.classify_inventory(inventory).filter(
        "is_issue_page and product_id is not null"
    )
    changed = discovery.changed_urls(issue_pages, manifest)
    return discovery.drop_landing_pages(discovery.version_pages(changed))


def chosen_captures(due: DataFrame, pages: DataFrame) -> DataFrame:
    """The capture of each due path to read (path, attempt), chosen on narrow columns and stored.

    Page bodies are not among the columns, so choosing moves no body; and since the result is a
    stored table, its size is known when the bodies are fetched: a short work list is sent to
    them, and for a long one Spark filters the bodies by it before they move.
    """
    narrow = pages.select("path", "status", "attempt").join(
        due.select("path").distinct(), "path", "left_semi"
    )
    where = fresh_folder(due.sparkSession, "captures")
    usable_pages(narrow, ("path",)).select("path", "attempt").write.parquet(where)
    return due.sparkSession.read.parquet(where)


def stored_work(due: DataFrame) -> DataFrame:
    """The work list as a stored table: every book of a load reads it, and none classifies addresses again."""
    where = fresh_folder(due.sparkSession, "due")
    due.write.parquet(where)
    return due.sparkSession.read.schema(due.schema).parquet(where)


def failed_pages(due: DataFrame, pages: DataFrame) -> DataFrame:
    """Due paths without a usable capture, with the reason: gone, transient, or not captured."""
    narrow = pages.select("path", "status", "attempt").join(
        due.select("path").distinct(), "path", "left_semi"
    )
    last = latest_attempts(narrow, ("path",)).select("path", "outcome")
    return (
        due.join(last, "path", "left")
        .withColumn("error", F.coalesce("outcome", F.lit("not captured")))
        .filter("error <> 'usable'")
        .select("product_id", "version", F.col("kind").alias("issue_type"), F.col("path").alias("url"), "error")
    )


def empty_pages(due: DataFrame, chosen: DataFrame, issues: DataFrame, keys=("product_id", "version", "issue_type", "url")) -> DataFrame:
    """Due pages that were read and gave no issue, as failures.

    Where headings name version or kind, a page is compared by fewer ``keys``.
    """
    read = due.join(chosen.select("path").distinct(), "path", "left_semi")
    pages = read.select("product_id", "version", F.col("kind").alias("issue_type"), F.col("path").alias("url"))
    found = issues.withColumn("url", F.col("source_url")).select(*keys).distinct()
    return pages.join(found, [*keys], "left_anti").withColumn("error", F.lit("no issues found"))


def load_issues(due: DataFrame, pages: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Issues of the due pages in the common tables-or-topics layout.

    Only bodies of chosen captures are read and parsed, each once; a page that fills both
    kinds is fanned out afterwards.
    """
    chosen = chosen_captures(due, pages) if chosen is None else chosen
    wanted = due.groupBy("path").agg(
        F.collect_set(F.struct("product_id", "version", "kind", "ordinal")).alias("uses")
    )
    bodies = pages.select("path", "attempt", "html").join(chosen, ["path", "attempt"]).drop("attempt")
    issues = extract.issue_pages(parse_pages(bodies.join(wanted, "path"), "tables", "topics"))
    place = ("ord", "row_no", "id_no")
    order = Window.partitionBy("product_id", "version", "issue_type", "source_url").orderBy(*place)
    flat = issues.withColumn("_u", F.explode("uses")).select(
        "_u.product_id", "_u.version", F.col("_u.kind").alias("issue_type"), "bug_id",
        "description", F.lit(None).cast("string").alias("symptoms"), "workaround", "fix_info",
        "affected_components", F.lit(None).cast("string").alias("release_date"),
        F.col("path").alias("source_url"), F.col("_u.ordinal").alias("page_ordinal"), *place,
    )
    # Places in a page are compared as they are, and numbered only for rows that stay.
    kept = dedup_issues(flat, order=("page_ordinal", "source_url", *place))
    return kept.withColumn("row_ordinal", F.row_number().over(order).cast("bigint")).drop(*place)


def refresh(
    held: DataFrame, due: DataFrame, pages: DataFrame, names: DataFrame, replace_changed: bool = False
) -> DataFrame:
    """Held issues plus those of the due pages, existing versions kept as they are.

    With ``replace_changed`` a version that has a due page is taken from the new side.
    """
    new = load_issues(due, pages).join(names, "product_id", "left")
    return merge_issues(held, new, replace_changed)


def run(
    held: DataFrame, manifest: DataFrame, due: DataFrame, pages: DataFrame, names: DataFrame, seq: int,
    replace_changed: bool = False, all_layouts: bool = False,
) -> dict[str, DataFrame]:
    """A load with its books: issues, manifest, failures and report.

    With ``all_layouts`` the work list is one of ``due_by_profile`` and pages are read as it says.
    Pages that were read enter the manifest, also those without issues; pages that were not stay
    due. Every due page is in exactly one of the two. ``due`` needs url and lastmod.
    """
    spark = due.sparkSession
    due = stored_work(due)
    chosen = chosen_captures(due, pages)
    where = fresh_folder(spark, "loaded")
    load = load_all_layouts if all_layouts else load_issues
    load(due, pages, chosen).write.parquet(where)
    new = spark.read.parquet(where)
    keys = ("product_id", "url") if all_layouts else ("product_id", "version", "issue_type", "url")
    failures = failed_pages(due, pages).unionByName(empty_pages(due, chosen, new, keys))
    read = due.join(chosen.select("path").distinct(), "path", "left_semi")
    seen = read.select("product_id", "url", "lastmod", F.lit(seq).cast("bigint").alias("seq")).distinct()
    return {
        "issues": merge_issues(held, new.join(names, "product_id", "left"), replace_changed),
        "manifest": upsert_manifest(manifest, seen),
        "failures": failures,
        "report": fetch_report(new, failures, due.select("product_id")),
    }


# --- all layouts ------------------------------------------------------------------------


def _version(url: Column, rule: Column) -> Column:
    """Version of a page by its rule; headings on the page name it for the rest.

    A plugin's page whose address has no dashed version carries it after the plugin's slug.
    """
    return (
        F.when(rule == "dotted", F.coalesce(ux.dotted_version(url), ux.plugin_version_by(url, F.col("slugs"))))
        .when(rule == "saas", F.lit(fixed.VERSION_SAAS))
        .when(rule == "template", ux.dotted_version(url))
        .when(rule == "year", ux.year_slug(url))
        .when(rule == "run_or_year", F.coalesce(ux.addressed_year(url), ux.run_version(url)))
        .when(rule == "tree", ux.tree_major(url))
        .when(rule == "space", ux.space_version(F.regexp_replace(F.regexp_replace(url, r"^.*?://[^/]*/", ""), r"/[^/]*$", ""), F.lit(None).cast("string")))
        .otherwise(F.lit(fixed.VERSION_UNKNOWN))
    )


def _kinds(url: Column, rule: Column) -> Column:
    one = F.array_compact(F.array(F.coalesce(ux.year_page_kind(url), ux.default_kind(url))))
    return (
        F.when(rule.isin("dotted", "template"), ux.page_kinds(url))
        .when(rule == "saas", ux.page_kinds_anywhere(url))
        .otherwise(one)
    )


def due_by_profile(inventory: DataFrame, manifest: DataFrame) -> DataFrame:
    """Pages to read with the version rule, layout, component and stage of their page; no product is left out."""
    url, rule = F.col("url"), F.col("version_rule")
    pages = inventory.filter(ux.is_issue_page(url) | ux.is_scoped_tree_page(url))
    work = discovery.changed_urls(discovery.page_dispatch(pages), manifest).select(
        "product_id", "layout", "component", "stage", _version(url, rule).alias("version"),
        F.explode(_kinds(url, rule)).alias("kind"), ux.relative_path(url).alias("path"), "ordinal", "url", "lastmod",
    )
    keys = ["product_id", "layout", "component", "stage", "version", "kind", "path"]
    listed = work.filter("version is not null").groupBy(*keys).agg(
        F.min("ordinal").alias("ordinal"), F.min("url").alias("url"), F.max("lastmod").alias("lastmod")
    )
    return discovery.drop_landing_pages(listed)


def _topics_with_fix_versions(pages: DataFrame) -> DataFrame:
    rows = extract.topic_pages(
        pages, id_pattern=r"^(PAN|PLUG)-\d+$", fix_phrases=("this issue is addressed",), fix_in_text=False, keep_empty=True
    )
    rows = rows.withColumns({"version": F.col("use.version"), "issue_type": F.col("use.kind")})
    return extract.fix_version_fanout(rows, F.col("issue_type"))


# What each layout reads of a page and how; pages carry ``use`` (product, version, kind, component, stage, ordinal).
_LAYOUTS = {
    "tables_then_topics": (("tables", "topics"), extract.issue_pages),
    "tables_only": (("tables",), extract.issue_tables),
    "topics_with_fix_versions": (("topics",), _topics_with_fix_versions),
    "agent_version_sections": (
        ("headings", "tables"), lambda p: extract.sections_by_agent_version(p, F.col("use.kind"))
    ),
    "index_version_sections": (("headings", "tables"), extract.sections_by_index_version),
    "component_sections": (("headings", "tables"), extract.sections_by_component),
    "calendar_version_sections": (("headings", "tables"), extract.sections_by_calendar_version),
    "feature_sections": (("headings", "tables"), extract.sections_by_feature),
    "version_kind_sections": (
        ("headings", "tables"), lambda p: extract.sections_by_version_and_kind(p, F.col("path"))
    ),
    "aria_tables": (("aria",), extract.aria_issues),
}


def parsed_by_layout(due: DataFrame, pages: DataFrame, chosen: DataFrame) -> DataFrame:
    """The parts of every due page that its layout needs, written once in a folder for each layout.

    This is the only pass over bodies: the work list meets them once, and the layouts then read
    the parts of their own pages.
    """
    spark = due.sparkSession
    use = F.struct("product_id", "version", "kind", "component", "stage", "ordinal")
    wanted = due.groupBy("path", "layout").agg(F.collect_set(use).alias("uses"))
    bodies = (
        pages.select("path", "attempt", "html").join(chosen, ["path", "attempt"]).drop("attempt").join(wanted, "path")
    )
    parsed = parse_pages_by(bodies, "layout", {name: parts for name, (parts, _) in _LAYOUTS.items()})
    where = fresh_folder(spark, "parsed-pages")
    parsed.write.partitionBy("layout").parquet(where)
    return spark.read.schema(parsed.schema).parquet(where)


def load_all_layouts(due: DataFrame, pages: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Issues of due pages of all products, each page read in the layout of its page or product.

    Bodies are read in one pass (``parsed_by_layout``). Issues of stage 1, of index pages over all
    versions, come behind those of a version's own pages, and one deduplication serves both
    stages. A constant component replaces what the rows name.
    """
    chosen = chosen_captures(due, pages) if chosen is None else chosen
    parsed = parsed_by_layout(due, pages, chosen)
    place = ["ord", "row_no", "id_no"]
    out = None
    for layout, (parts, rows_of) in _LAYOUTS.items():
        own = parsed.filter(F.col("layout") == layout).select("path", F.explode("uses").alias("use"), *parts)
        rows = rows_of(own)

        def column(name, other, rows=rows):
            return (F.coalesce(F.col(name), other) if name in rows.columns else other).alias(name)

        none = F.lit(None).cast("string")
        found = rows.select(
            F.col("use.product_id").alias("product_id"), column("version", F.col("use.version")),
            column("issue_type", F.col("use.kind")), "bug_id", "description", none.alias("symptoms"), "workaround",
            "fix_info", F.when(F.col("use.component").isNotNull(), F.array("use.component"))
            .otherwise(F.col("affected_components")).alias("affected_components"),
            column("release_date", none), F.col("path").alias("source_url"), F.col("use.stage").alias("stage"),
            F.col("use.ordinal").alias("page_ordinal"), *[column(c, F.lit(0)) for c in place],
        )
        out = found if out is None else out.unionByName(found)
    order = Window.partitionBy("product_id", "version", "issue_type", "source_url").orderBy(*place)
    kept = dedup_issues(out, order=("stage", "page_ordinal", "source_url", *place))
    return kept.withColumn("row_ordinal", F.row_number().over(order).cast("bigint")).drop("stage", *place)
