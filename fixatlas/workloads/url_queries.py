"""URL queries: addresses are built from columns in the shapes release notes use."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fixatlas import fixed
from fixatlas.functions import urls as ux
from fixatlas.operators import discovery
from fixatlas.sources.scratch import fresh_folder
from fixatlas.workloads.derived import WITH_FACTS, facts
from fixatlas.workloads.registry import query

KEY = ["page_ordinal", "row_ordinal"]
KEYS = "page_ordinal, row_ordinal"


def _quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


_N = len(fixed.PRODUCT_PREFIXES)
_PREFIX = f"element_at(array({_quoted(p for _, p in fixed.PRODUCT_PREFIXES)}), p_size % {_N} + 1)"
_PRODUCT_DUCK = f"[{_quoted(p for p, _ in fixed.PRODUCT_PREFIXES)}][p_size % {_N} + 1]"
_TRIPLE = "concat(v1, '-', v2, '-', v3, case when hot > 0 then concat('-h', hot) else '' end)"
_SLUG = """case when l_tax = 0 then 'overview' when l_returnflag = 'N' and issue_type = 'known'
  then 'known-and-addressed-issues' when issue_type = 'known' then 'known-issues'
  when l_tax > 0.06 then 'fixed-issues' else 'addressed-issues' end"""
_PREFIX_DUCK = f"[{_quoted(p for _, p in fixed.PRODUCT_PREFIXES)}][p_size % {_N} + 1]"


def _inventory_sql(prefix: str) -> str:
    """Path of a page: some sit under a second, shorter product fragment, some are upper case."""
    path = f"""concat(case when v3 = 1 then '/pan-os/' else '' end, {prefix}, '/', v1, '-', v2,
      '/rel-', {_TRIPLE}, '-', {_SLUG})"""
    return f"""concat('{fixed.DOCS_HOST}', case when v3 = 2 then upper({path}) else {path} end,
      case when v3 < 6 then '.html' else '' end)"""


_URL = _inventory_sql(_PREFIX)
_URL_DUCK = _inventory_sql(_PREFIX_DUCK)


def inventory(spark, data_dir):
    """One URL per derived row, ordered like its row."""
    rows = facts(spark, data_dir)
    built = rows.withColumns(
        {
            "url": F.expr(_URL),
            "lastmod": F.col("release_date"),
            "ordinal": F.col("row_ordinal"),
        }
    )
    return built


def stored_inventory(spark, data_dir, *columns):
    """The inventory as the stored table it is in use: rules read a column, not its recipe."""
    path = fresh_folder(spark, "inventory")
    rows = inventory(spark, data_dir).select(*columns)
    rows.write.parquet(path)
    return spark.read.parquet(path)


@query("url_classify", WITH_FACTS + f"""
select {KEYS}, {_PRODUCT_DUCK} as product from facts""")
def url_classify(spark, data_dir):
    rows = inventory(spark, data_dir)
    return rows.select(*KEY, ux.product_of(F.col("url")).alias("product"))


@query("url_classify_rules", WITH_FACTS + f"""
select distinct {_URL_DUCK} as url, {_PRODUCT_DUCK} as product_id from facts""")
def url_classify_rules(spark, data_dir):
    """The same by a table of rules, to which every order adds one that fits nowhere."""
    orders = facts(spark, data_dir).selectExpr(
        "'none' as product_id", "concat('/', l_orderkey, '/order/part-', l_orderkey) as fragment", "l_orderkey as place"
    )
    rules = discovery.product_rules(spark).unionByName(orders.distinct())
    return discovery.classify_by_rules(stored_inventory(spark, data_dir, "url"), rules)


@query("url_issue_pages", WITH_FACTS + f"select {KEYS}, l_tax > 0 as is_issue_page from facts")
def url_issue_pages(spark, data_dir):
    rows = inventory(spark, data_dir)
    return rows.select(*KEY, ux.is_issue_page(F.col("url")).alias("is_issue_page"))


@query("url_major", WITH_FACTS + f"select {KEYS}, concat(v1, '-', v2) as major from facts")
def url_major(spark, data_dir):
    rows = inventory(spark, data_dir)
    return rows.select(*KEY, ux.major_slug(F.col("url")).alias("major"))


_SHAPED = f"""case v3 when 1 then concat('/a/pan-9-9-9/rel-', {_TRIPLE}, '-known-issues')
  when 2 then concat('/plugins/', v1 % 10, v2 % 10, v3, '/known-issues')
  when 3 then concat('/access/', v1, '-', v2, '/known-issues')
  when 4 then concat('/agent/agent-', v1, '-', v2, '-known-issues')
  when 5 then concat('/rel/rel-', v1, '-', v2, '-', v3, '-known-issues')
  when 6 then concat('/plugins/534/rel-', v1, '-', v2, '-', v3, '-c', v2)
  else '/agent/known-issues' end"""


@query("url_version", WITH_FACTS + f"""
select {KEYS}, case v3 when 1 then version when 2 then concat(v1 % 10, '.', v2 % 10, '.', v3)
  when 3 then concat(v1, '.', v2, '.0') when 4 then concat(v1, '.', v2, '.0')
  when 5 then concat(v1, '.', v2, '.', v3) when 6 then concat(v1, '.', v2, '.', v3, '-c', v2) end
  as found from facts""")
def url_version(spark, data_dir):
    rows = facts(spark, data_dir)
    return rows.select(*KEY, ux.dotted_version(F.expr(_SHAPED)).alias("found"))


@query("text_version", WITH_FACTS + f"""
select {KEYS}, case when v3 < 7 then version end as in_text,
  case when v3 < 7 then concat(v1, '.', v2, '.', v3, case when hot > 0 then concat('-h', hot)
    when v3 = 2 then '-and' else '' end) end as in_link from facts""")
def text_version(spark, data_dir):
    text = """case when v3 < 7 then concat('Fixed in ', version,
      case when hot = 0 and v3 = 3 then '-known' else '' end, ', not in 9.9.9') else 'Fixed' end"""
    link = f"""case when v3 < 7 then concat('/rel-', {_TRIPLE},
      case when hot = 0 and v3 = 2 then '-and-addressed' when hot = 0 then '-known-issues' else '' end,
      '/8-8-8') else '/rel' end"""
    rows = facts(spark, data_dir)
    return rows.select(
        *KEY,
        ux.first_version(F.expr(text)).alias("in_text"),
        ux.first_version(F.expr(link), "-").alias("in_link"),
    )


@query("url_relpath", WITH_FACTS + f"""
select {KEYS}, regexp_replace(substring({_URL_DUCK}, {len(fixed.DOCS_HOST) + 1}), '\\.html$', '')
  as path from facts""")
def url_relpath(spark, data_dir):
    rows = inventory(spark, data_dir)
    return rows.select(*KEY, ux.relative_path(F.col("url")).alias("path"))


@query("url_absolute", WITH_FACTS + f"""
select {KEYS}, case when v3 = 1 then concat('http://other.example.com/', l_orderkey)
  else concat('{fixed.DOCS_HOST}/notes/', l_orderkey) end as url from facts""")
def url_absolute(spark, data_dir):
    path = F.expr("""case v3 when 1 then concat('http://other.example.com/', l_orderkey)
      when 2 then concat('notes/', l_orderkey) else concat('/notes/', l_orderkey) end""")
    return facts(spark, data_dir).select(*KEY, ux.absolute_url(path).alias("url"))


_KIND_URL = f"concat('/docs/known-and-addressed/', {_SLUG}, case when v3 = 7 then '/' else '' end)"
_KINDS_DUCK = """case when l_tax = 0 then [] when l_returnflag = 'N' and issue_type = 'known'
  then ['known', 'addressed'] else [issue_type] end"""


@query("url_kind", WITH_FACTS + f"""
select {KEYS}, unnest({_KINDS_DUCK}) as kind from facts where v3 <> 7""")
def url_kind(spark, data_dir):
    rows = facts(spark, data_dir)
    return rows.select(*KEY, F.explode(ux.page_kinds(F.expr(_KIND_URL))).alias("kind"))


@query("url_kind_flat", WITH_FACTS + f"""
select {KEYS}, unnest({_KINDS_DUCK}) as kind from facts""")
def url_kind_flat(spark, data_dir):
    url = F.expr(f"concat('/docs/', {_SLUG}, '/index')")
    return facts(spark, data_dir).select(*KEY, F.explode(ux.page_kinds_anywhere(url)).alias("kind"))


@query("url_kind_any", WITH_FACTS + f"""
select {KEYS}, case when l_tax = 0 or (issue_type = 'addressed' and l_tax > 0.06) then null
  else issue_type end as kind from facts""")
def url_kind_any(spark, data_dir):
    url = F.expr(f"upper(concat('/docs/', {_SLUG}))")
    return facts(spark, data_dir).select(*KEY, ux.page_kind_loose(url).alias("kind"))


@query("url_plugin_version", WITH_FACTS + f"""
select {KEYS}, case when v3 in (1, 2) then concat(v1, '.', v2, '.', v3)
  when v3 = 3 then concat(v1 % 10, '.', v2 % 10, '.3') when v3 = 4 then concat(v1 % 10, '.', v2 % 10, '.0')
  when v3 = 5 then concat(v1 % 10, '.', v2 % 10, '.0') end as found from facts""")
def url_plugin_version(spark, data_dir):
    href = F.expr("""concat('/plugins/AWS-Plugin-99/', case v3 when 1 then concat('aws-plugin-', v1, '-', v2, '-1/known')
      when 2 then concat('panorama-aws-plugin-', v1, '-', v2, '-2-h3.html')
      when 3 then concat('aws-plugin-', v1 % 10, v2 % 10, '3') when 4
      then concat('aws-plugin-', v1 % 10, v2 % 10, '-known-issues')
      when 5 then concat('aws-plugin-', v1 % 10, '-', v2 % 10, '.html')
      else 'aws-plugin-next/known' end)""")
    slugs = [s for p, s in fixed.PLUGIN_SLUGS if p == "plugin-aws"]
    return facts(spark, data_dir).select(*KEY, ux.plugin_version(href, slugs).alias("found"))


_DLP = "/enterprise-dlp/release-notes"


@query("url_dlp_version", WITH_FACTS + f"""
select {KEYS}, case when v3 = 1 then concat(v1 % 10, '.', v2 % 10)
  when v3 = 2 then concat(v1 % 10, '.', v2 % 10, '.', l_suppkey)
  when v3 = 3 then concat(v1 % 10, '.', v2 % 10, '.', l_suppkey) end as found,
  case when v3 = 5 then cast(v1 + 1990 as varchar) end as year from facts""")
def url_dlp_version(spark, data_dir):
    url = F.expr(f"""concat('{_DLP}/known-issues-in-enterprise-dlp-plugin-11/', case v3
      when 1 then concat('enterprise-dlp-plugin-', v1 % 10, v2 % 10)
      when 2 then concat('enterprise-dlp-plugin-', v1 % 10, v2 % 10, l_suppkey)
      when 3 then concat('enterprise-dlp-plugin-', v1 % 10, v2 % 10, '0', l_suppkey)
      when 5 then concat('addressed-issues-in-', v1 + 1990) else 'overview' end)""")
    return facts(spark, data_dir).select(
        *KEY, ux.run_version(url).alias("found"), ux.addressed_year(url).alias("year")
    )


@query("scope_urls", WITH_FACTS + f""", u as (
  select row_ordinal as ordinal, v3, case when v3 = 5 then 'addressed' else 'known' end as kind,
    case when v3 = 5 then cast(v1 + 1990 as varchar) else concat(v1 % 10, '.', v2 % 10) end as version,
    concat('{_DLP}/', l_orderkey, '/', case when v3 = 5 then concat('addressed-issues-in-', v1 + 1990)
      else concat('enterprise-dlp-plugin-', v1 % 10, v2 % 10) end) as path
  from facts where v3 in (1, 5))
select kind, version, first(path order by ordinal) as path from u group by all""")
def scope_urls(spark, data_dir):
    rows = facts(spark, data_dir).select(
        F.expr(f"""concat('{fixed.DOCS_HOST}{_DLP}/', l_orderkey, '/', case v3
          when 1 then concat('enterprise-dlp-plugin-', v1 % 10, v2 % 10)
          when 2 then concat('known-issues-in-endpoint-dlp/enterprise-dlp-plugin-', v1 % 10, v2 % 10)
          when 5 then concat('addressed-issues-in-', v1 + 1990)
          else 'addressed-issues-in-enterprise-dlp' end)""").alias("url"),
        F.col("row_ordinal").alias("ordinal"),
    )
    return discovery.scoped_work_list(rows)


@query("url_year_pages", WITH_FACTS + """, u as (
  select row_ordinal as ordinal, cast(v1 + 1990 as varchar) as year, issue_type as kind,
    concat('/iot/release-notes/', issue_type, '-issues-in-', v1 + 1990, '/', l_orderkey) as path
  from facts where v3 <> 7 and v1 + 1990 >= 2000)
select year, kind, first(path order by ordinal) as path from u group by all""")
def url_year_pages(spark, data_dir):
    rows = facts(spark, data_dir).select(
        F.expr(f"""concat('{fixed.DOCS_HOST}/iot/release-notes/', case when v3 = 7
          then concat(issue_type, '-issues-', v1, '-', v2, '-1') else
          concat(issue_type, '-issues-in-', v1 + 1990, '/', l_orderkey) end, '.html')""").alias("url"),
        F.col("row_ordinal").alias("ordinal"),
    )
    return discovery.year_pages(rows)


@query("space_version", WITH_FACTS + f"""
select {KEYS}, case when v3 in (1, 3) then concat(v1, '.', v2) when v3 in (2, 5)
  then concat(v1, '.', v2, '-CE') when v3 in (4, 6) then concat(v1, '.', v2) end as found from facts""")
def space_version(spark, data_dir):
    path = F.expr("""case v3 when 1 then concat('8.x/', v1, '.', v2, '-eol') when 2
      then concat('8.x/', v1, '.', v2, 'ce-eol') when 3 then concat(v1, '.', v2) else '9.x' end""")
    title = F.expr("""case v3 when 4 then concat('Agent ', v1, '.', v2, ' Release | Portal') when 5
      then concat('XDR agent ', v1, '.', v2, ' CE Release') when 6 then concat('Agent ', v1, '.', v2)
      else 'Agent Release' end""")
    return facts(spark, data_dir).select(*KEY, ux.space_version(path, title).alias("found"))


_TREE = "/terminal-services-agent-release-notes/"


@query("url_ts_major", WITH_FACTS + f"""
select {KEYS}, case when v3 = 7 then '' else concat(v1, '.', v2) end as major,
  case when v3 = 2 then 'addressed' else 'known' end as kind from facts""")
def url_ts_major(spark, data_dir):
    url = F.expr(f"""case v3 when 1 then concat('/pan-os/9-9{_TREE}x-release-information-', v1, '-', v2)
      when 2 then concat('/pan-os/', v1, '-', v2, '{_TREE}agent-addressed-issues')
      when 7 then '{_TREE}known-issues-in-ts-agent' else
      concat('/pan-os/', v1, '-', v2, '{_TREE}known-issues-in-ts-agent') end""")
    return facts(spark, data_dir).select(
        *KEY, ux.tree_major(url).alias("major"), ux.default_kind(url).alias("kind")
    )


@query("url_template", WITH_FACTS + f"""
select distinct concat(v1, '-', v2) as major, concat(
  '/sd-wan/release-notes/panorama-plugin-for-sd-wan/sd-wan-plugin-', v1, v2, '0',
  '/known-issues-in-sd-wan-plugin-', v1, v2, '0') as path from facts""")
def url_template(spark, data_dir):
    majors = facts(spark, data_dir).selectExpr("concat(v1, '-', v2) as major").distinct()
    return majors.withColumn("path", ux.known_issues_path(F.col("major")))


# --- work lists ---------------------------------------------------------------------------

# "fixed" is no page word of the version rule, so it counts as a suffix.
# The version is taken as the URL writes it, so an upper-case URL gives an upper-case suffix.
_AS_WRITTEN = """case when hot = 0 and l_tax > 0.06 and issue_type = 'addressed'
    then concat(version, '-fixed') else version end"""
_LISTED = f"""select {_PRODUCT_DUCK} as product_id,
    case when v3 = 2 then upper({_AS_WRITTEN}) else {_AS_WRITTEN} end as version, kind, min(row_ordinal) as ordinal,
  regexp_replace(substring(url, {len(fixed.DOCS_HOST) + 1}), '\\.html$', '') as path
  from (select *, {_URL_DUCK} as url, unnest({_KINDS_DUCK}) as kind from facts) group by all"""


def _listed(spark, data_dir):
    rows = stored_inventory(spark, data_dir, "url", "ordinal")
    return discovery.version_pages(discovery.classify_inventory(rows))


@query("version_pages", WITH_FACTS + f", listed as ({_LISTED}) select * from listed")
def version_pages(spark, data_dir):
    return _listed(spark, data_dir)


@query("drop_landing_pages", WITH_FACTS + f""", listed as ({_LISTED}),
special as (select distinct product_id, version, kind from listed
  where lower(path) like '%/' || '%-' || kind || '-issues' and lower(path) not like '%known-and-addressed-issues')
select * from listed where lower(path) not like '%known-and-addressed-issues'
  or (product_id, version, kind) not in (select (product_id, version, kind) from special)""")
def drop_landing_pages(spark, data_dir):
    return discovery.drop_landing_pages(_listed(spark, data_dir))


@query("distinct_majors", WITH_FACTS + f""", m as (
  select distinct {_PRODUCT_DUCK} as product_id, v1, v2 from facts where l_tax > 0)
select product_id, concat(v1, '-', v2) as major_version,
  row_number() over (partition by product_id order by v1 desc, v2 desc) as place from m""")
def distinct_majors(spark, data_dir):
    majors = discovery.distinct_majors(
        discovery.classify_inventory(stored_inventory(spark, data_dir, "url"))
    )
    order = Window.partitionBy("product_id").orderBy(F.desc("major_key"))
    return majors.select(
        "product_id", "major_version", F.row_number().over(order).cast("bigint").alias("place")
    )


# A recorded date for some pages, another for others, none for the rest.
_RECORDED = "case when l_returnflag = 'A' then release_date when l_returnflag = 'R' then '1999-01-01' end"


@query("changed_urls", WITH_FACTS + f""", m as (
  select distinct {_PRODUCT_DUCK} as product_id, {_URL_DUCK} as url, {_RECORDED} as lastmod
  from facts where l_returnflag <> 'N')
select {KEYS}, product_id, url, lastmod from (
  select {KEYS}, {_PRODUCT_DUCK} as product_id, {_URL_DUCK} as url, release_date as lastmod from facts) f
where not exists (select 1 from m where m.product_id = f.product_id and m.url = f.url
  and m.lastmod = f.lastmod)""")
def changed_urls(spark, data_dir):
    rows = stored_inventory(
        spark, data_dir, *KEY, "url", "lastmod", "release_date", "l_returnflag"
    ).withColumn("product_id", ux.product_of(F.col("url")))
    manifest = rows.filter("l_returnflag <> 'N'").select(
        "product_id", "url", F.expr(_RECORDED).alias("lastmod")
    )
    return discovery.changed_urls(rows, manifest).select(*KEY, "product_id", "url", "lastmod")


_DEEP = """case v3 when 1 then concat('https://x.example.com/s/', l_orderkey, '/issues')
  when 2 then concat('https://x.example.com/s/', l_orderkey, '/issues/', v3, '/')
  when 3 then concat('https://x.example.com/s/', l_orderkey, '/issues-', v3)
  else concat('https://x.example.com/s/', l_orderkey, '/issues/', v2, '/', v3) end"""


@query("drop_index_pages", WITH_FACTS + f""", p as (
  select distinct product_id as space, {_DEEP} as url, rtrim({_DEEP}, '/') as page from facts)
select space, url from p a where not exists (select 1 from p b where b.space = a.space
  and starts_with(b.page, a.page || '/'))""")
def drop_index_pages(spark, data_dir):
    rows = facts(spark, data_dir).select(
        F.col("product_id").alias("space"), F.expr(_DEEP).alias("url")
    )
    return discovery.drop_index_pages(rows.distinct(), listed=rows)


@query("profile_dispatch", WITH_FACTS + f""", u as (
  select {KEYS}, v3, {_PRODUCT_DUCK} as own from facts),
t as (select {KEYS}, own as product_id from u where v3 <> 7
  union all select {KEYS}, 'panos' from u where v3 = 7
  union all select {KEYS}, 'ts-agent' from u where v3 = 7)
select {KEYS}, product_id, case product_id when 'sdwan-plugin' then 'topics_with_fix_versions'
  when 'adem' then 'agent_version_sections' when 'scm' then 'calendar_version_sections'
  when 'device-security' then 'feature_sections' when 'ts-agent' then 'version_kind_sections'
  else 'tables_then_topics' end as layout from t""")
def profile_dispatch(spark, data_dir):
    url = F.when(
        F.col("v3") == 7,
        F.concat(F.lit(f"{fixed.DOCS_HOST}/pan-os/10-2{_TREE}"), "l_orderkey", F.lit("/known-issues-in-ts-agent")),
    ).otherwise(F.expr(_URL))
    path = fresh_folder(spark, "inventory")
    facts(spark, data_dir).select(*KEY, url.alias("url")).write.parquet(path)
    return discovery.dispatch(spark.read.parquet(path)).select(*KEY, "product_id", "layout")
