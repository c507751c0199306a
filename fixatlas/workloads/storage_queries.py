"""Sources and sinks: data is written to the shared folder, read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixatlas.operators import discovery, merge, report
from fixatlas.sources import sitemap, snapshots, tracker
from fixatlas.sources.scratch import fresh_folder
from fixatlas.workloads.derived import (
    COMPONENTS_SQL, PAGE_URL_SQL, WITH_FACTS, facts, issues, join_components, table,
)
from fixatlas.workloads.registry import query
from fixatlas.workloads.release_queries import _FETCH_LOG_DUCK, fetch_log

_LOC = "concat('https://docs.example.com/', l_orderkey, '/', row_ordinal, '/', issue_type)"


def _write_xml(rows, path, root, tag):
    rows.write.format("xml").option("rootTag", root).option("rowTag", tag).save(path)


@query("src_sitemap", WITH_FACTS + f"""
select {_LOC} as url, release_date as lastmod from facts where v3 <> 7""")
def src_sitemap(spark, data_dir):
    path = fresh_folder(spark, "sitemap")
    entries = facts(spark, data_dir).select(
        F.expr(f"case when v3 = 7 then '' else concat(' ', {_LOC}, ' ') end").alias("loc"),
        F.concat(F.lit(" "), "release_date").alias("lastmod"),
        F.lit("0.5").alias("priority"),
    )
    _write_xml(entries, path, "urlset", "url")
    return sitemap.read_urlset(spark, path)


_SPACE = "concat(case when v3 < 4 then '8.x/' when v3 = 4 then 'admin/' else '' end, v1, '.', v2, case when v3 = 5 then '-eol' when v3 = 6 then 'ce' else '' end)"
_SPACE_PAGE = f"""concat('https://docs.example.com/', {_SPACE}, '/', case when l_tax = 0 then 'overview'
  else concat(issue_type, '-issues') end, '/', row_ordinal)"""


@query("src_sitemap_index", WITH_FACTS + f"""
select {_SPACE} as space, {_SPACE_PAGE} as url, issue_type as kind from facts
where v3 <> 4 and l_tax > 0""")
def src_sitemap_index(spark, data_dir):
    rows = facts(spark, data_dir)
    index_path, pages_path = fresh_folder(spark, "index"), fresh_folder(spark, "pages")
    loc = F.expr(f"concat('https://docs.example.com/', {_SPACE}, '/sitemap-pages.xml')")
    _write_xml(rows.select(loc.alias("loc")).distinct(), index_path, "sitemapindex", "sitemap")
    _write_xml(rows.select(F.expr(_SPACE_PAGE).alias("loc")), pages_path, "urlset", "url")
    page_sets = sitemap.read_urlset(spark, pages_path).withColumn(
        "space", F.regexp_extract("url", r"^https://[^/]+/(.*)/[^/]+/[^/]+$", 1)
    )
    pages = sitemap.space_pages(sitemap.read_index(spark, index_path), page_sets)
    return pages.select("space", "url", "kind")


_TRACKED = f"""product_id, product_name, version, issue_type, bug_id, description, symptoms,
  workaround, fix_info, {COMPONENTS_SQL} as components, release_date"""
_TRACKED_COLUMNS = [
    "product_id", "product_name", "version", "issue_type", "bug_id", "description", "symptoms",
    "workaround", "fix_info",
]


@query("src_tracker_json", WITH_FACTS + f" select {_TRACKED} from facts")
def src_tracker_json(spark, data_dir):
    path = fresh_folder(spark, "tracker")
    tracker.write_tracker(issues(spark, data_dir), path)
    rows = tracker.flatten_issues(tracker.read_tracker(spark, path))
    return rows.select(*_TRACKED_COLUMNS, join_components(), "release_date")


@query("sink_tracker_json", WITH_FACTS + """
select product_id, version, count(*) as n, false as has_nulls from facts
group by product_id, version, l_orderkey // 1000""")
def sink_tracker_json(spark, data_dir):
    path = fresh_folder(spark, "tracker")
    tracker.write_tracker(issues(spark, data_dir), path)
    line = F.col("value")
    count = F.size(F.regexp_extract_all(line, F.lit('("bug_id":)'), 1))
    return spark.read.text(path).select(
        F.get_json_object(line, "$.id").alias("product_id"),
        F.get_json_object(line, "$.versions[0].version").alias("version"),
        count.cast("bigint").alias("n"),
        line.contains(":null").alias("has_nulls"),
    )


@query("tracker_release_dates", WITH_FACTS + """
select product_id, version, l_orderkey // 1000 as part, max(release_date) as version_release_date, count(*) as n
from facts group by product_id, version, l_orderkey // 1000""")
def tracker_release_dates(spark, data_dir):
    """Dates of versions, written with a tracker and read back."""
    path = fresh_folder(spark, "tracker")
    tracker.write_tracker(issues(spark, data_dir).withColumn("version_release_date", F.col("release_date")), path)
    rows = tracker.flatten_issues(tracker.read_tracker(spark, path))
    return rows.groupBy("product_id", "version", "part", "version_release_date").agg(F.count("*").alias("n"))


@query("tracker_metadata", """
select '2026-01-02T03:04:05Z' as generated_at, concat('1.', count(*), '.0') as version,
  concat('orders to ', strftime(max(o_orderdate), '%Y-%m-%d')) as source from orders""")
def tracker_metadata(spark, data_dir):
    """Metadata of a held tracker, written, renewed by a merge, written and read again."""
    held = spark.read.parquet(f"{data_dir}/orders.parquet").agg(
        F.lit("2025-01-01T00:00:00Z").alias("generated_at"),
        F.concat(F.lit("1."), F.count("*").cast("string"), F.lit(".0")).alias("version"),
        F.concat(F.lit("orders to "), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd")).alias("source"),
    )
    one, two = fresh_folder(spark, "metadata"), fresh_folder(spark, "metadata")
    tracker.write_metadata(held, one)
    tracker.write_metadata(merge.merge_metadata(tracker.read_metadata(spark, one), F.lit("2026-01-02T03:04:05Z")), two)
    return tracker.read_metadata(spark, two)


_LISTED = """select *, l_orderkey // 1000 as part, row_number() over (partition by product_id, version, issue_type,
  l_orderkey // 1000 order by page_ordinal, row_ordinal) - 1 as place from facts"""


@query("flatten_issues", WITH_FACTS + f""", listed as ({_LISTED})
select {_TRACKED}, part, cast(place as int) as row_ordinal,
  case when issue_type = 'known' then 0 else 1 end as kind_rank from listed""")
def flatten_issues(spark, data_dir):
    documents = tracker.to_documents(tracker.nest_versions(issues(spark, data_dir)))
    rows = tracker.flatten_issues(documents)
    return rows.select(
        *_TRACKED_COLUMNS, join_components(), "release_date", "part", "row_ordinal", "kind_rank"
    )


def _ids(kind):
    return f"""coalesce(string_agg(bug_id, ',' order by page_ordinal, row_ordinal)
      filter (issue_type = '{kind}'), '')"""


@query("nest_versions", WITH_FACTS + f"""
select product_id, version, l_orderkey // 1000 as part, {_ids('known')} as known,
  {_ids('addressed')} as addressed from facts group by all""")
def nest_versions(spark, data_dir):
    nested = tracker.nest_versions(issues(spark, data_dir))
    return nested.select(
        "product_id", "version", "part",
        F.array_join("known_issues.bug_id", ",").alias("known"),
        F.array_join("addressed_issues.bug_id", ",").alias("addressed"),
    )


_SEEN = f"product_id, {PAGE_URL_SQL} as url, release_date as lastmod, row_ordinal as seq"


@query("manifest_upsert", WITH_FACTS + f""", r as (select {_SEEN}, row_number() over (
  partition by product_id, {PAGE_URL_SQL} order by row_ordinal desc) as n from facts)
select product_id, url, lastmod, seq from r where n = 1""")
def manifest_upsert(spark, data_dir):
    rows = facts(spark, data_dir)
    old, new = (
        rows.filter(f"l_returnflag {op} 'N'").selectExpr(
            "product_id", f"{PAGE_URL_SQL} as url", "release_date as lastmod", "row_ordinal as seq"
        )
        for op in ("<>", "=")
    )
    first, second = fresh_folder(spark, "manifest"), fresh_folder(spark, "manifest")
    snapshots.save_manifest(snapshots.load_manifest(spark, f"{first}-none"), old, first)
    snapshots.save_manifest(snapshots.load_manifest(spark, first), new, second)
    return snapshots.load_manifest(spark, second)


@query("baseline_roundtrip", WITH_FACTS + """
select product_id, version, count(*) filter (issue_type = 'known') as known,
  count(*) filter (issue_type = 'addressed') as addressed,
  count(distinct bug_id) as n_bug_ids, count(distinct bug_id) as n_id_rows
from facts group by all""")
def baseline_roundtrip(spark, data_dir):
    path = fresh_folder(spark, "baseline")
    snapshots.save_baseline(issues(spark, data_dir), path)
    counts, ids = snapshots.load_baseline(spark, path)
    per_version = ids.groupBy("product_id", "version").agg(F.count("*").alias("n_id_rows"))
    return counts.join(per_version, ["product_id", "version"])


@query("report_roundtrip", WITH_FACTS + f""", log as ({_FETCH_LOG_DUCK}),
products as (select distinct product_id from log union select distinct product_id from facts),
m as (select product_id, count(distinct version) as versions, count(*) filter (issue_type = 'known') as known,
  count(*) filter (issue_type = 'addressed') as addressed from facts group by all),
f as (select product_id, count(*) as failed from log where error is not null group by all),
j as (select product_id, coalesce(versions, 0) as versions, coalesce(known, 0) as known,
  coalesce(addressed, 0) as addressed, coalesce(failed, 0) as failed
  from products left join m using (product_id) left join f using (product_id))
select product_id, url, error, null::bigint as versions, null::bigint as known, null::bigint as addressed,
  null::bigint as failed from log where error is not null
union all select product_id, null, null, versions, known, addressed, failed from j
union all select null, null, null, sum(versions)::bigint, sum(known)::bigint, sum(addressed)::bigint,
  sum(failed)::bigint from j""")
def report_roundtrip(spark, data_dir):
    path = fresh_folder(spark, "report")
    log = fetch_log(spark, data_dir)
    rows = issues(spark, data_dir)
    products = log.select("product_id").union(rows.select("product_id"))
    stats = report.fetch_report(rows, log, products)
    tracker.write_report(stats, log.filter("error is not null"), path)
    stats, failures = tracker.read_report(spark, path)
    return failures.select("product_id", "url", "error").unionByName(
        stats.drop("version_list"), allowMissingColumns=True
    )


_RELEASE = "concat(year(o_orderdate) - 1990, '.', month(o_orderdate), '.', o_custkey)"
_CHANGE = """case o_orderpriority when '1-URGENT' then 'fix' when '2-HIGH' then 'breaking'
  when '3-MEDIUM' then 'feature' else 'improvement' end"""


@query("release_changes", f"""
select {_RELEASE} as version, {_CHANGE} as type, count(*) as n from orders group by all""")
def release_changes(spark, data_dir):
    change = F.struct(
        F.expr(_CHANGE).alias("type"), F.concat(F.lit("Order "), "o_orderkey").alias("description")
    )
    log = (
        table(spark, data_dir, "orders")
        .groupBy(F.expr(_RELEASE).alias("version"), F.lit("2026-01-01").alias("date"))
        .agg(F.collect_list(change).alias("changes"))
    )
    path = fresh_folder(spark, "releases")
    log.write.json(path)
    return tracker.change_counts(tracker.read_releases(spark, path))


@query("cache_load", """
select c_name as product_id, cast(c_custkey as varchar) as version, 1 as n_known from customer
where c_acctbal >= 0 and c_mktsegment <> 'BUILDING'""")
def cache_load(spark, data_dir):
    line = """concat('{"schema_version":', case when c_mktsegment = 'BUILDING' then 2 else 1 end,
      ',"product_id":"', c_name, '","version":"', c_custkey, '","known_issues_urls":["/k"]',
      case when c_acctbal < 0 then '' else '}' end)"""
    path = fresh_folder(spark, "cache")
    table(spark, data_dir, "customer").select(F.expr(line).alias("value")).write.text(path)
    rows = tracker.read_cache(spark, path)
    return rows.select("product_id", "version", F.size("known_issues_urls").alias("n_known"))


_CLOCK = "1998-06-01 00:00:00"
_DAY = """concat(year(o_orderdate), '-', lpad(cast(month(o_orderdate) as string), 2, '0'), '-',
  lpad(cast(day(o_orderdate) as string), 2, '0'))"""


@query("fresh_entries", f"""
select o_orderkey, o_orderstatus <> 'P' and o_orderdate > timestamp '{_CLOCK}' - interval 24 hour
  + case when o_orderstatus = 'O' then interval 2 hour else interval 0 hour end as is_fresh
from orders""")
def fresh_entries(spark, data_dir):
    stamp = F.expr(f"""concat({_DAY}, case o_orderstatus when 'F' then 'T00:00:00'
      when 'O' then 'T00:00:00+02:00' else ' at noon' end)""")
    now = F.lit(_CLOCK).cast("timestamp")
    return table(spark, data_dir, "orders").select(
        "o_orderkey", discovery.is_fresh(stamp, now).alias("is_fresh")
    )
