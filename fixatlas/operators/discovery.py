"""URL inventory to work list: which pages of which version hold which kind of issue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fixatlas import fixed
from fixatlas.functions import urls as ux
from fixatlas.functions import versions as vx


def classify_inventory(urls: DataFrame) -> DataFrame:
    """``product_id, major_version, is_issue_page`` for every URL, one narrow projection."""
    url = F.col("url")
    return urls.select(
        "*",
        ux.product_of(url).alias("product_id"),
        ux.major_slug(url).alias("major_version"),
        ux.is_issue_page(url).alias("is_issue_page"),
    )


def product_rules(spark: SparkSession, prefixes=None) -> DataFrame:
    """The fixed product rules as a table ``product_id, fragment, place``."""
    rows = [(p, f, n) for n, (p, f) in enumerate(prefixes or fixed.PRODUCT_PREFIXES)]
    return spark.createDataFrame(rows, "product_id string, fragment string, place long")


def classify_by_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``url, product_id`` of every distinct URL by a table of rules of any length.

    As `classify_inventory`: the longest fragment that the URL contains, letters aside, says the
    product; of equal fragments the one with the least ``place`` counts; null where none fits. A
    fragment has to begin with a slash, else the query fails; null and blank fragments say nothing.

    A fragment is some whole path segments and the begin of the next (often empty). An address is
    cut at its slashes into the runs of segments that have the shape of some rule, once for each
    URL, and runs meet rules by equality. The shapes, pairs of two small numbers, are all that is
    looked up beforehand; the rules stay a table that Spark sends to the URLs if it is small. After
    the distinct URLs are known they are shuffled no more unless the rules are large.
    """
    low = F.lower("fragment")
    wrong = F.raise_error(F.concat(F.lit("a rule has to begin with a slash: "), "fragment"))
    ready = (
        rules.filter("trim(fragment) <> ''")
        .select(F.when(low.startswith("/"), low).otherwise(wrong).alias("run"), "product_id", "place")
        .groupBy("run").agg(F.min(F.struct("place", "product_id")).alias("first"))
        .select(
            "run", F.col("first.place").alias("place"), F.col("first.product_id").alias("product_id"),
            (F.size(F.split("run", "/")) - 2).alias("depth"),
            F.length(F.element_at(F.split("run", "/"), -1)).alias("tail"),
        )
    )
    shapes = sorted(tuple(r) for r in ready.select("depth", "tail").distinct().collect())
    if not shapes:
        return urls.select("url").distinct().withColumn("product_id", F.lit(None).cast("string"))
    shape = F.array(*[F.struct(F.lit(d).alias("depth"), F.lit(t).alias("tail")) for d, t in shapes])
    fitting = F.filter(shape, lambda s: s["depth"] + 2 <= F.size("parts"))
    runs = (
        urls.select("url").distinct()
        .select("url", F.split(F.lower("url"), "/").alias("parts"))
        .select("url", "parts", F.explode_outer(fitting).alias("shape"))
        .select("url", "parts", "shape", F.explode_outer(F.expr("sequence(2, size(parts) - shape.depth)")).alias("start"))
        .selectExpr(
            "url", "shape.depth as depth",
            """case when length(parts[start + shape.depth - 1]) >= shape.tail then concat('/',
              array_join(transform(slice(parts, start, shape.depth), p -> concat(p, '/')), ''),
              left(parts[start + shape.depth - 1], shape.tail)) end as run""",
        )
    )
    # Runs that met no rule have no rank, and no say.
    rank = F.when(
        F.col("place").isNotNull(), F.struct(F.length("run").alias("length"), (-F.col("place")).alias("place"))
    )
    met = runs.join(ready.drop("tail"), ["depth", "run"], "left")
    return met.groupBy("url").agg(F.max_by("product_id", rank).alias("product_id"))


def version_pages(
    inventory: DataFrame,
    version: Column | None = None,
    kinds: Column | None = None,
    order: str = "ordinal",
) -> DataFrame:
    """One row per (product, version, kind, path), placed where the path first appears."""
    url = F.col("url")
    version = ux.dotted_version(url) if version is None else version
    kinds = ux.page_kinds(url) if kinds is None else kinds
    # Exploded and not filtered: a filter would be pushed below the column and work it out twice.
    pages = inventory.select("*", F.explode(F.array_compact(F.array(version))).alias("_version")).select(
        "product_id",
        F.col("_version").alias("version"),
        F.explode(kinds).alias("kind"),
        ux.relative_path(url).alias("path"),
        F.col(order).alias("ordinal"),
    )
    return pages.groupBy("product_id", "version", "kind", "path").agg(
        F.min("ordinal").alias("ordinal")
    )


def drop_landing_pages(pages: DataFrame) -> DataFrame:
    """Combined landing pages go when the version has a page of its own for the kind.

    An anti join against the distinct (product, version, kind) keys, not a window:
    a version with very many pages is never gathered in one task.
    """
    keys = ["product_id", "version", "kind"]
    specific = pages.filter(ux.is_specific(F.col("path"), F.col("kind"))).select(*keys).distinct()
    p, s = pages.alias("p"), specific.alias("s")
    same = [F.col(f"p.{k}") == F.col(f"s.{k}") for k in keys]
    return p.join(s, [*same, ux.is_landing(F.col("p.path"))], "left_anti")


def drop_index_pages(pages: DataFrame, scope: str = "space", listed: DataFrame | None = None) -> DataFrame:
    """Pages beneath which another page of the same space lies are tables of contents.

    Every page names its proper ancestors; the rest is an equality anti join, so the
    prefix test needs no nested loop. ``listed`` has the same pages as they were listed, if ``pages`` are
    the distinct ones of it: then no task holds its distinct pages beside their ancestors.
    """
    clean = F.expr("trim(TRAILING '/' FROM url)")
    slashes = F.length("_self") - F.length(F.replace("_self", F.lit("/")))
    ancestors = (
        (pages if listed is None else listed)
        .select(scope, clean.alias("_self"))
        .select(scope, "_self", F.explode(F.sequence(F.lit(1), F.greatest(slashes, F.lit(1)))).alias("_n"))
        .select(scope, F.expr("substring_index(_self, '/', _n)").alias("_page"), "_self")
        .filter("_page <> _self")
        .select(scope, "_page")
        .distinct()
    )
    # A page is moved as its clean address and the slashes after it, not as two addresses.
    split = pages.withColumns({"_page": clean, "_end": F.expr("substring(url, length(trim(TRAILING '/' FROM url)) + 1)")})
    kept = split.drop("url").join(ancestors, [scope, "_page"], "left_anti")
    return kept.withColumn("url", F.concat("_page", "_end")).select(*pages.columns)


def distinct_majors(inventory: DataFrame) -> DataFrame:
    """Majors per product with their sort key, for newest-first lists."""
    return (
        inventory.filter(F.col("major_version").isNotNull() & F.col("is_issue_page"))
        .select("product_id", "major_version")
        .distinct()
        .withColumn("major_key", vx.key_major(F.col("major_version")))
    )


def harvest_links(
    parsed: DataFrame,
    addressed_words=("addressed",),
    fallback_version: Column | None = None,
    version: Column | None = None,
) -> DataFrame:
    """Issue page links of parsed pages, one per (product, version, kind, path)."""
    links = parsed.select("product_id", F.explode("links").alias("_l")).select(
        "product_id", "_l.ord", "_l.href"
    )
    href = F.col("href")
    words = list(addressed_words)
    version = ux.first_version(href, "-") if version is None else version
    if fallback_version is not None:
        version = F.coalesce(version, fallback_version)
    path = ux.link_path(href)
    seg = ux.last_segment(path, ignore_trailing_slash=True)
    kind = F.when(ux.contains_any(seg, words), "addressed").when(seg.contains("known"), "known")
    return (
        links.filter(ux.contains_any(F.lower(href), ["known", *words]))
        .select("product_id", version.alias("version"), kind.alias("kind"), path.alias("path"), "ord", seg.alias("_seg"))
        .filter(
            F.col("version").isNotNull()
            & F.col("kind").isNotNull()
            & ~F.col("_seg").contains("known-and-addressed")
        )
        .groupBy("product_id", "version", "kind", "path")
        .agg(F.min("ord").alias("ordinal"))
    )


def first_page_per(pages: DataFrame, *keys: str, order: str = "ordinal") -> DataFrame:
    """First path of each key, for sections addressed by year or by version."""
    return pages.groupBy(*keys).agg(F.min_by("path", order).alias("path"))


def year_pages(inventory: DataFrame) -> DataFrame:
    """First known and first addressed page of every year bucket."""
    url = F.col("url")
    rows = inventory.select(
        ux.year_slug(url).alias("year"),
        ux.year_page_kind(url).alias("kind"),
        ux.relative_path(url).alias("path"),
        "ordinal",
    ).filter("year is not null and kind is not null")
    return first_page_per(rows, "year", "kind")


def scoped_work_list(inventory: DataFrame) -> DataFrame:
    """Known pages by run-together version, addressed pages by year, out-of-scope pages gone."""
    url = F.col("url")
    path = ux.relative_path(url)
    year, version = ux.addressed_year(url), ux.run_version(url)
    rows = inventory.filter(~ux.is_out_of_scope(url)).select(
        F.when(year.isNotNull(), "addressed").otherwise("known").alias("kind"),
        F.coalesce(year, version).alias("version"),
        path.alias("path"),
        "ordinal",
    )
    return first_page_per(rows.filter("version is not null"), "kind", "version")


def extraction_profiles(spark: SparkSession) -> DataFrame:
    """How each product names versions and lays out issues: a fixed table of 29 rows."""
    # Version rule and layout per product.
    dotted = ["panos", "globalprotect", "prisma-access", "prisma-access-agent", "prisma-sdwan"]
    saas = [
        "cloud-ngfw-azure", "cloud-ngfw-aws", "remote-browser-isolation",
        "ai-access-security", "ai-runtime-security", "strata-logging-service",
    ]
    rows = [(p, "dotted", "tables_then_topics") for p in dotted]
    rows += [(p, "saas", "tables_then_topics") for p in saas]
    rows += [
        (p, "dotted", "tables_then_topics")
        for p in dict.fromkeys(pid for pid, _ in fixed.PLUGIN_SLUGS)
    ]
    rows += [
        ("sdwan-plugin", "template", "topics_with_fix_versions"),
        ("adem", "heading", "agent_version_sections"),
        ("scm", "heading", "calendar_version_sections"),
        ("device-security", "year", "feature_sections"),
        ("enterprise-dlp", "run_or_year", "tables_then_topics"),
        ("ts-agent", "tree", "version_kind_sections"),
        ("cortex-xdr", "space", "aria_tables"),
    ]
    return spark.createDataFrame(rows, "product_id string, version_rule string, layout string")


def dispatch(inventory: DataFrame, *others: Column) -> DataFrame:
    """Products a URL feeds, with their profile; one URL may feed two products, and ``others``."""
    url = F.col("url")
    products = F.array_compact(
        F.array(
            ux.product_of(url),
            F.when(ux.is_scoped_tree_page(url), F.lit("ts-agent")),
            *others,
        )
    )
    profiles = F.broadcast(extraction_profiles(inventory.sparkSession))  # 29 rows
    return inventory.withColumn("product_id", F.explode(products)).join(profiles, "product_id")


def page_rules(spark: SparkSession) -> DataFrame:
    """Pages that are read in another way than their product's profile says.

    ``page`` is the role of a page (see ``page_role``); ``component`` says where its issues have their
    component from, and ``stage`` 1 puts its issues behind those of all pages of stage 0.
    """
    # Version rule, layout, component and stage by product and role of the page.
    rows = [
        ("scm", "multitenant", "saas", "tables_only", fixed.MULTITENANT_COMPONENT, 0),
        ("scm", "known", "saas", "component_sections", None, 0),
        ("prisma-access-agent", "index", "heading", "index_version_sections", None, 1),
    ]
    rows += [("remote-browser-isolation", page, "saas", "tables_only", None, 0) for page in ("known", "addressed", "index")]
    return spark.createDataFrame(
        rows, "product_id string, page string, own_version_rule string, own_layout string, component string, own_stage int"
    )


def page_role(url: Column) -> Column:
    """multitenant, index (addressed issues of all versions on one page), else the kind."""
    low = F.lower(url)
    kind = ux.default_kind(url)
    return (
        F.when(low.contains(fixed.MULTITENANT_PAGE) & (kind == "known"), "multitenant")
        .when(low.contains("addressed-issues") & ux.dotted_version(url).isNull(), "index")
        .otherwise(kind)
    )


def page_dispatch(inventory: DataFrame) -> DataFrame:
    """``dispatch`` with the rules of single pages: version_rule, layout, component, stage, and slugs of a plugin."""
    url = F.col("url")
    role = page_role(url)
    tenants = ux.product_of(url).isNull() & (role == "multitenant")
    dealt = dispatch(inventory, F.when(tenants, F.lit("scm")))
    spark = inventory.sparkSession
    slugs = {}
    for product, slug in fixed.PLUGIN_SLUGS:
        slugs.setdefault(product, []).append(slug)
    slugs = spark.createDataFrame(list(slugs.items()), "product_id string, slugs array<string>")
    own = F.broadcast(page_rules(spark))
    both = dealt.withColumn("page", role).join(own, ["product_id", "page"], "left")
    both = both.join(F.broadcast(slugs), "product_id", "left")
    return both.select(
        *[c for c in dealt.columns if c not in ("version_rule", "layout")],
        F.coalesce("own_version_rule", "version_rule").alias("version_rule"),
        F.coalesce("own_layout", "layout").alias("layout"), "component", "slugs",
        F.coalesce("own_stage", F.lit(0)).alias("stage"),
    )


# --- gates ----------------------------------------------------------------------------


def changed_urls(inventory: DataFrame, manifest: DataFrame) -> DataFrame:
    """URLs to fetch: all but those whose last-modified text equals the recorded one.

    Null never equals null in a join, which is the rule: no date, fetch to be safe.
    """
    seen = manifest.select("product_id", "url", "lastmod")
    return inventory.join(seen, ["product_id", "url", "lastmod"], "left_anti")


def new_versions_only(work: DataFrame, issues: DataFrame) -> DataFrame:
    held = issues.select("product_id", "version").distinct()
    return work.join(held, ["product_id", "version"], "left_anti")


def filter_majors(rows: DataFrame, majors: list[str], whole_parts: bool = False) -> DataFrame:
    """Versions under the given majors; without ``whole_parts`` 5-1 also admits 5.10."""
    end = "." if whole_parts else ""
    version = F.concat(F.col("version"), F.lit(end))
    tests = [version.startswith(m.replace("-", ".") + end) for m in majors]
    return rows.filter(F.array_contains(F.array(*tests), True))


def retry_worklist(fetch_log: DataFrame, profiles: DataFrame) -> DataFrame:
    """Products with a failed fetch that still are supported."""
    failed = fetch_log.filter("error is not null").select("product_id").distinct()
    return failed.join(profiles.select("product_id"), "product_id", "left_semi")


def is_fresh(updated_at: Column, now: Column, hours: int = fixed.CACHE_TTL_HOURS) -> Column:
    """Younger than the lifetime; what cannot be read is stale."""
    age = F.unix_micros(now) - F.unix_micros(F.try_to_timestamp(updated_at))
    return F.coalesce(age < hours * 3_600_000_000, F.lit(False))
