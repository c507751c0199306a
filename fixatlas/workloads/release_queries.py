"""Search, releases, versions, dedup, merge, report and snapshot queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixatlas.functions import text as tx
from fixatlas.functions import versions as vx
from fixatlas.operators import baseline, dedup, discovery, merge, releases, report, search
from fixatlas.plans import cards, catalog
from fixatlas.sources.scratch import fresh_folder
from fixatlas.sources.snapshots import load_baseline, load_digests, save_baseline
from fixatlas.workloads.derived import (
    SNAPSHOTS_SQL, WITH_FACTS, as_issues, facts, issues, snapshots,
)
from fixatlas.workloads.registry import EXPECTED, query

KEY = ["page_ordinal", "row_ordinal"]
NEWEST = "v1 desc, v2 desc, v3 desc, hot desc"

_FIXES = f""", per_version as (
  select product_id, bug_id, version, v1, v2, v3, hot, count(*) as n
  from facts where issue_type = 'addressed' group by all),
fixes as (
  select product_id, bug_id, cast(sum(n) as bigint) as n_fixes,
    first(version order by {NEWEST}) as newest_fix
  from per_version group by all)"""


@query("fix_available", WITH_FACTS + _FIXES + """
select f.product_id, f.bug_id, f.version, f.page_ordinal, f.row_ordinal,
  coalesce(n_fixes, 0) as n_fixes, newest_fix, coalesce(n_fixes, 0) > 0 as fix_available
from facts f left join fixes x on f.product_id = x.product_id and f.bug_id = x.bug_id
where f.issue_type = 'known'""")
def fix_available(spark, data_dir):
    rows = issues(spark, data_dir).select("product_id", "bug_id", "version", "issue_type", *KEY)
    known = rows.filter("issue_type = 'known'").drop("issue_type")
    return releases.with_fixes(known, rows)


@query("also_affected", WITH_FACTS + f""", k as (
  select product_id, bug_id, version, v1, v2, v3, hot, count(*) as n
  from facts where issue_type = 'known' group by all),
others as (
  select a.product_id, a.bug_id, a.version, cast(sum(b.n) as bigint) as n_others,
    first(b.version order by b.v1 desc, b.v2 desc, b.v3 desc, b.hot desc) as newest_other
  from k a join k b on a.product_id = b.product_id and a.bug_id = b.bug_id
    and a.version <> b.version
  group by all)
select f.product_id, f.bug_id, f.version, f.page_ordinal, f.row_ordinal,
  coalesce(n_others, 0) as n_others, newest_other
from facts f left join others o on f.product_id = o.product_id and f.bug_id = o.bug_id
  and f.version = o.version
where f.issue_type = 'known'""")
def also_affected(spark, data_dir):
    rows = issues(spark, data_dir).select("product_id", "bug_id", "version", "issue_type", *KEY)
    known = rows.filter("issue_type = 'known'").drop("issue_type")
    return releases.also_affected(known, rows)


def _release_list(kind):
    return WITH_FACTS + f""", r as (
  select product_id, bug_id, version, v1, v2, v3, hot, count(*) as n
  from facts where issue_type = '{kind}' group by all)
select product_id, bug_id, version, n,
  row_number() over (partition by product_id, bug_id order by {NEWEST}) as place
from r"""


@query("fix_releases", _release_list("addressed"))
def fix_releases(spark, data_dir):
    return releases.fix_releases(issues(spark, data_dir))


@query("known_releases", _release_list("known"))
def known_releases(spark, data_dir):
    return releases.known_releases(issues(spark, data_dir))


@query("product_versions", WITH_FACTS + """, s as (
  select product_id, version, v1, v2, v3, hot, min(page_ordinal) as first_seen
  from facts group by all)
select product_id, version, row_number() over (partition by product_id
  order by v1 desc, v2 desc, v3 desc, case when hot > 0 then concat('-h', hot) else '' end desc,
    first_seen, version) as place
from s""")
def product_versions(spark, data_dir):
    return search.product_versions(issues(spark, data_dir))


@query("versions_newest_first", WITH_FACTS + f""", s as (
  select product_id, version, v1, v2, v3, hot from facts group by all)
select product_id, version,
  row_number() over (partition by product_id order by {NEWEST}) as place
from s""")
def versions_newest_first(spark, data_dir):
    return search.versions_newest_first(issues(spark, data_dir))


@query("search_issues", WITH_FACTS + """
select product_id, version, bug_id, page_ordinal, row_ordinal from facts
where product_id = 'economy' and issue_type = 'known'
  and contains(lower(concat_ws(' ', bug_id, description, symptoms, workaround, comp1, comp2)),
    'size 7')""")
def search_issues(spark, data_dir):
    found = search.search(
        issues(spark, data_dir), term="Size 7", product="economy", issue_type="known"
    )
    return found.select("product_id", "version", "bug_id", *KEY)


@query("search_across_fields", WITH_FACTS + """
select product_id, version, bug_id, page_ordinal, row_ordinal from facts
where contains(lower(concat_ws(' ', bug_id, description, symptoms, workaround, comp1, comp2)),
  'load set size 1')""")
def search_across_fields(spark, data_dir):
    return search.search(issues(spark, data_dir), term="load Set size 1").select(
        "product_id", "version", "bug_id", *KEY
    )


@query("suggest_options", """
select distinct p_name as product_name from part where contains(lower(p_name), 'ed ')""")
def suggest_options(spark, data_dir):
    options = spark.read.parquet(f"{data_dir}/part.parquet").selectExpr("p_name as product_name")
    return search.suggest(options, "ED ")


@query("component_counts", WITH_FACTS + """
select product_id, component, count(*) as n_issues
from (select product_id, unnest([comp1, comp2]) as component from facts)
where component is not null group by all""")
def component_counts(spark, data_dir):
    return search.component_counts(issues(spark, data_dir))


_DOCUMENT_ORDER = f"product_id, {NEWEST}, issue_type desc, page_ordinal, row_ordinal"
_BOLTS = """select product_id, version, bug_id, page_ordinal, row_ordinal from facts
where contains(lower(concat_ws(' ', bug_id, description, symptoms, workaround, comp1, comp2)),
  'bolt')"""


@query("paginate", WITH_FACTS + _BOLTS + f" order by {_DOCUMENT_ORDER} limit 50 offset 100")
def paginate(spark, data_dir):
    rows = issues(spark, data_dir)
    found = search.search(cards.placed(rows), term="bolt")
    counted = search.search(cards.shown_at_all(rows), term="bolt")
    return search.page_slice(found, cards.ORDER, page=3, counted=counted).select(
        "product_id", "version", "bug_id", *KEY
    )


@query("paginate_after", WITH_FACTS + _BOLTS + f" order by {_DOCUMENT_ORDER} limit 50 offset 50")
def paginate_after(spark, data_dir):
    """The page after the first one, from the key of the last row shown."""
    found = cards.numbered(search.search(cards.placed(issues(spark, data_dir)), term="bolt"))
    shown = search.page_after(found, cards.KEYSET, None).select(cards.KEYSET).collect()  # one page
    following = search.page_after(found, cards.KEYSET, list(shown[-1]) if shown else None)
    return following.select("product_id", "version", "bug_id", *KEY)


@query("page_of_catalog", WITH_FACTS + f"""
select product_id, version, bug_id, page_ordinal, row_ordinal, row_number() over () + 29999 as position
from (select * from facts order by {_DOCUMENT_ORDER} limit 50 offset 30000)""")
def page_of_catalog(spark, data_dir):
    """Page 601 by position, from the one or two slices that hold it."""
    path = fresh_folder(spark, "catalog")
    catalog.write_catalog(issues(spark, data_dir), path, slice_rows=5000)
    return catalog.open_page(spark, path, 601).select("product_id", "version", "bug_id", *KEY, "position")


@query("search_issues_indexed", EXPECTED["search_issues"])
def search_issues_indexed(spark, data_dir):
    """The rows of ``search_issues``, from the slices whose letter triples can hold the term."""
    path = fresh_folder(spark, "catalog")
    catalog.write_catalog(issues(spark, data_dir), path, slice_rows=5000)
    found = catalog.search_catalog(spark, path, "Size 7", product="economy", issue_type="known")
    return found.select("product_id", "version", "bug_id", *KEY)


@query("result_page", WITH_FACTS + _FIXES + """, page as (
  select * from facts
  where contains(lower(concat_ws(' ', bug_id, description, symptoms, workaround, comp1, comp2)),
    'gear')
  order by """ + _DOCUMENT_ORDER + """ limit 50),
listed as (select product_id, bug_id, version, count(*) as n from facts
  where issue_type = 'known' group by all)
select p.bug_id, p.page_ordinal, p.row_ordinal,
  concat(p.product_name, ' ', p.version) as label,
  p.issue_type = 'known' and coalesce(x.n_fixes, 0) > 0 as fix_available,
  p.issue_type = 'known' and exists (select 1 from listed k where k.product_id = p.product_id
    and k.bug_id = p.bug_id and k.version <> p.version) as others_known
from page p left join fixes x on p.product_id = x.product_id and p.bug_id = x.bug_id""")
def result_page(spark, data_dir):
    return cards.result_page(issues(spark, data_dir), page=1, term="Gear").select(
        "bug_id", *KEY, "label", "fix_available", "others_known"
    )


@query("page_numbers", WITH_FACTS + """, t as (
  select product_id, version, count(*) as rows,
    cast(ceil(count(*) / 2.0) as bigint) as pages, min(v3) as current
  from facts group by all)
select product_id, version, pages, case when pages <= 7
  then array_to_string(range(1, pages + 1), ' ')
  else concat_ws(' ', '1', case when current > 3 then '...' end,
    nullif(array_to_string(list_filter(range(greatest(2, current - 1), least(pages - 1, current + 1) + 1),
      lambda x: x > 1 and x < pages), ' '), ''),
    case when current < pages - 2 then '...' end, cast(pages as varchar)) end as strip
from t""")
def page_numbers(spark, data_dir):
    totals = facts(spark, data_dir).groupBy("product_id", "version").agg(
        F.count("*").alias("rows"), F.min("v3").alias("current")
    )
    pages = search.page_count(F.col("rows"), 2)
    strip = search.page_strip(F.col("current").cast("bigint"), F.col("pages"))
    return totals.withColumn("pages", pages).select(
        "product_id", "version", "pages", F.array_join(strip, " ").alias("strip")
    )


# --- keys ---------------------------------------------------------------------------------


@query("version_key", WITH_FACTS + """
select distinct version, v1 as major, v2 as minor, v3 as patch, hot as suffix from facts""")
def version_key(spark, data_dir):
    versions = facts(spark, data_dir).select("version").distinct()
    key = vx.key_patch(F.col("version"))
    names = ["major", "minor", "patch", "suffix"]
    return versions.select("version", *[key[i].cast("int").alias(n) for i, n in enumerate(names)])


@query("version_key_calendar", WITH_FACTS + """
select distinct concat(v1 + 1980, '.r', v2, '.', v3, case when hot > 0 then 'b' else '' end) as version,
  v1 + 1980 as year, v2 as release, v3 as patch from facts
union all select distinct version, 0, 0, 0 from facts""")
def version_key_calendar(spark, data_dir):
    rows = facts(spark, data_dir)
    calendar = rows.selectExpr(
        "concat(v1 + 1980, '.r', v2, '.', v3, case when hot > 0 then 'b' else '' end) as version"
    ).distinct()
    versions = calendar.unionByName(rows.select("version").distinct())
    key = vx.key_calendar(F.col("version"))
    names = ["year", "release", "patch"]
    return versions.select("version", *[key[i].cast("int").alias(n) for i, n in enumerate(names)])


@query("version_key_ce", WITH_FACTS + """
select distinct concat(v1, '.', v2, case when hot > 0 then '-CE' else '' end) as version,
  v1 as major, v2 as minor, case when hot > 0 then 1 else 0 end as ce from facts""")
def version_key_ce(spark, data_dir):
    versions = facts(spark, data_dir).selectExpr(
        "concat(v1, '.', v2, case when hot > 0 then '-CE' else '' end) as version"
    ).distinct()
    key = vx.key_edition(F.col("version"))
    names = ["major", "minor", "ce"]
    return versions.select("version", *[key[i].cast("int").alias(n) for i, n in enumerate(names)])


# Every numbered version also in calendar spelling, next to the two special ones.
_MIXED = """case when l_returnflag = 'A' then concat(v1 + 1980, '.r', v2, '.', v3)
  when v3 = 7 and v2 = 1 then 'SaaS' when v3 = 6 and v2 = 1 then 'Unknown' else version end"""


@query("version_key_full", WITH_FACTS + f""", m as (
  select distinct product_id, {_MIXED} as version,
    case when l_returnflag = 'A' then 1 when v3 = 7 and v2 = 1 then 2
      when v3 = 6 and v2 = 1 then 0 else 1 end as rank,
    case when l_returnflag = 'A' then v1 + 1980 when v3 >= 6 and v2 = 1 then 0 else v1 end as a,
    case when l_returnflag <> 'A' and v3 >= 6 and v2 = 1 then 0 else v2 end as b,
    case when l_returnflag <> 'A' and v3 >= 6 and v2 = 1 then 0 else v3 end as c,
    case when l_returnflag = 'A' or (v3 >= 6 and v2 = 1) then 0 else hot end as h
  from facts)
select product_id, version,
  row_number() over (partition by product_id order by rank desc, a desc, b desc, c desc, h desc)
    as place
from m""")
def version_key_full(spark, data_dir):
    rows = facts(spark, data_dir).selectExpr("product_id", f"{_MIXED} as version", "page_ordinal")
    return search.versions_newest_first(rows)


@query("version_major_order", WITH_FACTS + """, m as (
  select distinct product_id, v1, v2 from facts)
select product_id, concat(v1, '-', v2) as major_version,
  row_number() over (partition by product_id order by v1 desc, v2 desc) as place from m""")
def version_major_order(spark, data_dir):
    rows = facts(spark, data_dir).selectExpr(
        "product_id", "concat(v1, '-', v2) as version", "page_ordinal"
    )
    return search.versions_newest_first(rows, key=vx.key_major).withColumnRenamed(
        "version", "major_version"
    )


@query("version_major", WITH_FACTS + """
select distinct product_id, version, concat(v1, '-', v2) as major_version from facts""")
def version_major(spark, data_dir):
    versions = facts(spark, data_dir).select("product_id", "version").distinct()
    return versions.withColumn("major_version", vx.major_of(F.col("version")))


@query("display_label", WITH_FACTS + f"""
select page_ordinal, row_ordinal, case when l_returnflag <> 'A' and v3 >= 6 and v2 = 1
  then product_name else concat(product_name, ' ', {_MIXED}) end as label from facts""")
def display_label(spark, data_dir):
    rows = facts(spark, data_dir)
    return rows.select(*KEY, tx.display_label(F.col("product_name"), F.expr(_MIXED)).alias("label"))


# --- dedup and merge ------------------------------------------------------------------------

# Captures of every row: the first 100 characters are the same, ends differ but for the third.
_CAPTURES = """select {columns}, page_ordinal + {shift} as page_ordinal, row_ordinal,
  concat(rpad(description, 100, '.'), ' capture {n}') as description from facts"""
_DEDUP_COLUMNS = "product_id, version, issue_type, bug_id, release_date"


@query("dedup_issues", WITH_FACTS + f""", captures as (
  {_CAPTURES.format(columns=_DEDUP_COLUMNS, shift=0, n=1)} union all
  {_CAPTURES.format(columns=_DEDUP_COLUMNS, shift=1000000000000, n=2)} union all
  {_CAPTURES.format(columns=_DEDUP_COLUMNS, shift=2000000000000, n=1)}),
ranked as (select *, row_number() over (partition by {_DEDUP_COLUMNS}, description
  order by page_ordinal, row_ordinal) as n from captures)
select {_DEDUP_COLUMNS}, description, page_ordinal, row_ordinal from ranked where n = 1""")
def dedup_issues(spark, data_dir):
    rows = facts(spark, data_dir)
    kept = [c.strip() for c in _DEDUP_COLUMNS.split(",")]

    def capture(n, shift):
        return rows.select(
            *kept,
            (F.col("page_ordinal") + shift).alias("page_ordinal"),
            "row_ordinal",
            F.concat(F.rpad("description", 100, "."), F.lit(f" capture {n}")).alias("description"),
        )

    captures = capture(1, 0).unionByName(capture(2, 1_000_000_000_000))
    return dedup.dedup_issues(captures.unionByName(capture(1, 2_000_000_000_000)))


@query("merge_databases", SNAPSHOTS_SQL + """
select product_id, version, issue_type, bug_id, page_ordinal, row_ordinal, 'old' as origin from old
union all
select product_id, version, issue_type, bug_id, page_ordinal, row_ordinal, 'new' from new
where (product_id, version) not in (select (product_id, version) from old)""")
def merge_databases(spark, data_dir):
    old, new = snapshots(spark, data_dir)
    merged = merge.merge_issues(
        old.withColumn("origin", F.lit("old")), new.withColumn("origin", F.lit("new"))
    )
    return merged.select("product_id", "version", "issue_type", "bug_id", *KEY, "origin")


@query("merge_replace_changed", SNAPSHOTS_SQL + """
select product_id, version, issue_type, bug_id, page_ordinal, row_ordinal, 'new' as origin from new
union all
select product_id, version, issue_type, bug_id, page_ordinal, row_ordinal, 'old' from old
where (product_id, version) not in (select (product_id, version) from new)""")
def merge_replace_changed(spark, data_dir):
    old, new = snapshots(spark, data_dir)
    merged = merge.merge_issues(
        old.withColumn("origin", F.lit("old")),
        new.withColumn("origin", F.lit("new")),
        replace_changed=True,
    )
    return merged.select("product_id", "version", "issue_type", "bug_id", *KEY, "origin")


@query("existing_versions", WITH_FACTS + " select distinct product_id, version from facts")
def existing_versions(spark, data_dir):
    return merge.existing_versions(issues(spark, data_dir))


@query("merge_index_issues", WITH_FACTS + """, own as (select * from facts where l_returnflag <> 'N'),
idx as (select * from facts where l_returnflag <> 'R'),
both_ as (select *, 0 as late from own union all select *, 1 from idx),
ranked as (select *, row_number() over (partition by product_id, version, issue_type, bug_id,
  release_date, description order by late, page_ordinal, row_ordinal) as n
  from both_)
select product_id, version, issue_type, bug_id, page_ordinal, row_ordinal, late = 1 as from_index
from ranked where n = 1""")
def merge_index_issues(spark, data_dir):
    own, index = snapshots(spark, data_dir)
    merged = merge.merge_index_issues(
        own.withColumn("from_index", F.lit(False)), index.withColumn("from_index", F.lit(True))
    )
    return merged.select("product_id", "version", "issue_type", "bug_id", *KEY, "from_index")


@query("new_versions_only", SNAPSHOTS_SQL + """
select distinct product_id, version, issue_type from new
where (product_id, version) not in (select (product_id, version) from old)""")
def new_versions_only(spark, data_dir):
    old, new = snapshots(spark, data_dir)
    work = new.select("product_id", "version", "issue_type").distinct()
    return discovery.new_versions_only(work, old)


@query("filter_majors", WITH_FACTS + """
select product_id, version, bug_id, page_ordinal, row_ordinal from facts
where version like '15.1%' or version like '16.11%'""")
def filter_majors(spark, data_dir):
    rows = discovery.filter_majors(issues(spark, data_dir), ["15-1", "16-11"])
    return rows.select("product_id", "version", "bug_id", *KEY)


@query("filter_majors_whole", WITH_FACTS + """
select product_id, version, bug_id, page_ordinal, row_ordinal from facts
where v1 = 15 and v2 = 1 or v1 = 16 and v2 = 11""")
def filter_majors_whole(spark, data_dir):
    rows = discovery.filter_majors(issues(spark, data_dir), ["15-1", "16-11"], whole_parts=True)
    return rows.select("product_id", "version", "bug_id", *KEY)


# --- report and snapshots ---------------------------------------------------------------------


@query("version_matrix", WITH_FACTS + """
select product_id, version, count(*) filter (issue_type = 'known') as known,
  count(*) filter (issue_type = 'addressed') as addressed from facts group by all""")
def version_matrix(spark, data_dir):
    return report.version_matrix(issues(spark, data_dir))


@query("dataset_stats", WITH_FACTS + """
select count(distinct product_id) as products, count(distinct (product_id, version)) as versions,
  count(*) filter (issue_type = 'known') as known,
  count(*) filter (issue_type = 'addressed') as addressed from facts""")
def dataset_stats(spark, data_dir):
    return report.dataset_stats(issues(spark, data_dir))


# Fetch attempts: one per order, with the outcome taken from the order's status.
_FETCH_LOG = """select case when o_orderpriority = '5-LOW' then 'retired' else lower(p_type) end
  as product_id, concat('https://docs.example.com/', o_orderkey) as url,
  case when o_orderstatus = 'F' then 'timed out' end as error
from {orders} join {part} on o_custkey = p_partkey"""
_FETCH_LOG_DUCK = _FETCH_LOG.format(orders="orders", part="part")


def fetch_log(spark, data_dir):
    return spark.sql(
        _FETCH_LOG,
        orders=spark.read.parquet(f"{data_dir}/orders.parquet"),
        part=spark.read.parquet(f"{data_dir}/part.parquet"),
    )


# Products a load was to fetch: those that fetches name, some of which have no issues at all.
_LOADED = """select distinct product_id from {log} union select distinct product_id from {facts}"""


@query("fetch_report", WITH_FACTS + f""", log as ({_FETCH_LOG_DUCK}
  union all select 'never seen', 'https://docs.example.com/none', 'refused'),
products as ({_LOADED.format(log="log", facts="facts")}),
failures as (select product_id, count(*) as failed from log where error is not null group by all),
m as (select product_id, count(distinct version) as versions,
  count(*) filter (issue_type = 'known') as known,
  count(*) filter (issue_type = 'addressed') as addressed,
  string_agg(distinct version, ',' order by version) as version_list from facts group by all),
j as (select product_id, coalesce(versions, 0) as versions, coalesce(known, 0) as known,
  coalesce(addressed, 0) as addressed, coalesce(failed, 0) as failed, coalesce(version_list, '') as version_list
  from products left join m using (product_id) left join failures using (product_id))
select product_id, versions, known, addressed, failed, version_list from j
union all
select null, cast(sum(versions) as bigint), cast(sum(known) as bigint),
  cast(sum(addressed) as bigint), cast(sum(failed) as bigint), null from j""")
def fetch_report(spark, data_dir):
    rows = issues(spark, data_dir)
    log = fetch_log(spark, data_dir).unionByName(
        spark.sql("select 'never seen' as product_id, 'https://docs.example.com/none' as url, 'refused' as error")
    )
    products = log.select("product_id").union(rows.select("product_id")).distinct()
    result = report.fetch_report(rows, log, products)
    return result.withColumn("version_list", F.array_join("version_list", ","))


@query("retry_worklist", f"""with log as ({_FETCH_LOG_DUCK})
select distinct product_id from log where error is not null
  and product_id in (select lower(p_type) from part)""")
def retry_worklist(spark, data_dir):
    profiles = spark.read.parquet(f"{data_dir}/part.parquet").selectExpr("lower(p_type) as product_id")
    return discovery.retry_worklist(fetch_log(spark, data_dir), profiles.distinct())


@query("topn_lists", WITH_FACTS + f""", s as (
  select product_id, version, v1, v2, v3, hot from facts group by all),
r as (select *, row_number() over (partition by product_id order by {NEWEST}) as n,
  count(*) over (partition by product_id) as total from s)
select product_id, string_agg(version, ',' order by n) as items,
  greatest(max(total) - 20, 0) as more
from r where n <= 20 group by product_id""")
def topn_lists(spark, data_dir):
    lists = report.sample_versions(search.versions_newest_first(issues(spark, data_dir)))
    return lists.withColumn("items", F.array_join("items", ","))


@query("sample_ids", WITH_FACTS + """, s as (
  select product_id, version, bug_id, min((page_ordinal, row_ordinal)) as place from facts group by all),
r as (select *, row_number() over (partition by product_id, version order by place, bug_id) as n,
  count(*) over (partition by product_id, version) as total from s)
select product_id, version, string_agg(bug_id, ',' order by n) as items, greatest(max(total) - 5, 0) as more
from r where n <= 5 group by product_id, version""")
def sample_ids(spark, data_dir):
    return report.sample_ids(issues(spark, data_dir)).withColumn("items", F.array_join("items", ","))


@query("baseline_fingerprint", WITH_FACTS + """
select product_id, version, count(*) filter (issue_type = 'known') as known,
  count(*) filter (issue_type = 'addressed') as addressed,
  count(distinct bug_id) as n_bug_ids from facts group by all""")
def baseline_fingerprint(spark, data_dir):
    return baseline.fingerprint(issues(spark, data_dir))


@query("ids_by_kind", WITH_FACTS + """
select distinct product_id, version, issue_type, bug_id from facts""")
def ids_by_kind(spark, data_dir):
    return baseline.ids_by_kind(issues(spark, data_dir))


_COUNT_LOSSES = """select product_id, version, 'known' as issue_type, o.known as before_n,
    n.known as after_n from o join n using (product_id, version) where n.known < o.known
  union all
  select product_id, version, 'addressed', o.addressed, n.addressed
  from o join n using (product_id, version) where n.addressed < o.addressed"""
_MISSING = """select distinct product_id, version, bug_id from old
  where (product_id, version) in (select (product_id, version) from new)
    and (product_id, version, bug_id) not in (select (product_id, version, bug_id) from new)"""
_DELTAS = f""", losses as ({_COUNT_LOSSES}), missing as ({_MISSING}),
deltas as (
  select 'version_added' as delta_kind, product_id, version, null as issue_type,
    null::bigint as before_n, null::bigint as after_n, null as bug_id
    from n anti join o using (product_id, version)
    where product_id in (select product_id from o)
  union all
  select 'version_removed', product_id, version, null, null, null, null
    from o anti join n using (product_id, version) where product_id in (select product_id from n)
  union all
  select 'product_added', product_id, null, null, null, null, null
    from (select distinct product_id from n) where product_id not in (select product_id from o)
  union all
  select 'product_removed', product_id, null, null, null, null, null
    from (select distinct product_id from o) where product_id not in (select product_id from n)
  union all
  select 'count_regression', product_id, version, issue_type, before_n, after_n, null from losses
  union all
  select 'missing_id', product_id, version, null, null, null, bug_id from missing
  union all
  select 'missing_ids', product_id, version, null, count(*), null, null
    from missing group by product_id, version)
"""


def _saved(spark, states):
    """Folders of the stored states."""
    folders = []
    for state in states:
        folders.append(fresh_folder(spark, "baseline"))
        save_baseline(state, folders[-1])
    return folders


def _snapshot_tables(spark, data_dir):
    """Both states as they are kept: stored counts and identifiers."""
    kept = [load_baseline(spark, where) for where in _saved(spark, snapshots(spark, data_dir))]
    (before, before_ids), (after, after_ids) = kept
    return before, after, before_ids, after_ids


@query("baseline_diff", SNAPSHOTS_SQL + _DELTAS + "select * from deltas")
def baseline_diff(spark, data_dir):
    return baseline.diff(*_snapshot_tables(spark, data_dir))


_FEW_CHANGED = WITH_FACTS + """, old as (select * from facts),
 new as (select * from facts where not (v1 = 16 and v2 = 5 and l_discount > 0.04)),
 o as (select product_id, version, count(*) filter (issue_type = 'known') as known,
   count(*) filter (issue_type = 'addressed') as addressed from old group by all),
 n as (select product_id, version, count(*) filter (issue_type = 'known') as known,
   count(*) filter (issue_type = 'addressed') as addressed from new group by all)"""


@query("baseline_diff_pruned", _FEW_CHANGED + _DELTAS + "select * from deltas")
def baseline_diff_pruned(spark, data_dir):
    """The same deltas when few versions changed: digests tell which identifiers have to be compared."""
    rows = facts(spark, data_dir)
    after = rows.filter("not (v1 = 16 and v2 = 5 and l_discount > 0.04)")
    folders = _saved(spark, [as_issues(rows), as_issues(after)])
    (before, before_ids), (after, after_ids) = (load_baseline(spark, f) for f in folders)
    return baseline.diff(before, after, before_ids, after_ids, *[load_digests(spark, f) for f in folders])


@query("baseline_is_clean", SNAPSHOTS_SQL + _DELTAS + """
select count(*) = 0 as is_clean, count(*) as n_losses from deltas
where delta_kind not in ('version_added', 'product_added', 'missing_id')""")
def baseline_is_clean(spark, data_dir):
    return baseline.verdict(baseline.diff(*_snapshot_tables(spark, data_dir)))


@query("baseline_count_regressions", SNAPSHOTS_SQL + f", losses as ({_COUNT_LOSSES})" + """
select 'count_regression' as delta_kind, product_id, version, issue_type, before_n, after_n
from losses""")
def baseline_count_regressions(spark, data_dir):
    before, after, _, _ = _snapshot_tables(spark, data_dir)
    return baseline.count_regressions(baseline.compare(before, after))


@query("baseline_missing_ids", SNAPSHOTS_SQL + _MISSING.replace("select", " select", 1))
def baseline_missing_ids(spark, data_dir):
    _, _, old_ids, new_ids = _snapshot_tables(spark, data_dir)
    return baseline.missing_ids(old_ids, new_ids)


@query("parity_check", SNAPSHOTS_SQL + """
select * from (
  select product_id, version, 'known' as issue_type, o.known as before_n,
    coalesce(n.known, 0) as after_n from o left join n using (product_id, version)
  union all
  select product_id, version, 'addressed', o.addressed, coalesce(n.addressed, 0)
  from o left join n using (product_id, version))
where before_n > 0 and after_n < before_n * 0.5""")
def parity_check(spark, data_dir):
    before, after, _, _ = _snapshot_tables(spark, data_dir)
    return baseline.parity(before, after, min_ratio=0.5)


@query("parity_keys", SNAPSHOTS_SQL + """
select product_id, version, 'only_old' as side from o anti join n using (product_id, version)
union all
select product_id, version, 'only_new' from n anti join o using (product_id, version)""")
def parity_keys(spark, data_dir):
    before, after, _, _ = _snapshot_tables(spark, data_dir)
    return baseline.parity_keys(before, after)
