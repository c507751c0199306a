"""Extraction queries: pages are written from the derived rows and must give the rows back."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixatlas import fixed
from fixatlas.operators import discovery, extract
from fixatlas.plans import load
from fixatlas.sources.pages import latest_attempts, parse_pages, valid_landing_pages
from fixatlas.workloads.derived import (
    CLEAN_TEXT_SQL, COMPONENTS_SQL, EXPECTED_ISSUE_SQL, PAGE_URL_SQL, RAW_TEXT_SQL, TABLE_CLOSE,
    TABLE_OPEN, WITH_FACTS, facts, join_components, pages, table,
)
from fixatlas.workloads.registry import query

FIELDS = ["bug_id", "description", "workaround", "fix_info"]
ROW = f"concat('<tr><td>', bug_id, '</td><td>', {RAW_TEXT_SQL}, '</td></tr>')"
PAGE = f"{PAGE_URL_SQL} as url"
PLAIN = f"{PAGE}, bug_id, {EXPECTED_ISSUE_SQL}"

# Page order of a row within its page, for texts that carry over from row to row.
ON_PAGE = "over (partition by l_orderkey, issue_type order by row_ordinal)"


def _issue(df, *more):
    return df.select("url", *FIELDS, join_components(), *more)


def _pages(spark, data_dir, row, before="''", after="''", **options):
    return pages(facts(spark, data_dir), row, before, after, **options)


# --- the given pages ------------------------------------------------------------------


@query("page_titles", r"""
select page_id, url, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) as raw_title from pages""")
def page_titles(spark, data_dir):
    given = table(spark, data_dir, "pages").select("page_id", "url", "html", F.col("html").isNull().alias("none"))
    title = F.when(~F.col("none"), F.trim(F.coalesce("raw_title", F.lit(""))))
    return parse_pages(given, "raw_title").select("page_id", "url", title.alias("raw_title"))


@query("page_links", r"""
select page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as href from pages""")
def page_links(spark, data_dir):
    parsed = parse_pages(table(spark, data_dir, "pages").select("page_id", "html"), "links")
    return parsed.select("page_id", F.explode("links").alias("_l")).select("page_id", "_l.href")


@query("page_elements", r"""
select page_id, case when tag = '<p>' then 'p' else 'h1' end as tag, count(*) as n
from (select page_id, unnest(regexp_extract_all(html, '<(p|h1)>')) as tag from pages) group by all""")
def page_elements(spark, data_dir):
    parsed = parse_pages(table(spark, data_dir, "pages").select("page_id", "html"), "headings")
    found = parsed.select("page_id", F.explode("headings").alias("_h"))
    return found.groupBy("page_id", F.col("_h.tag").alias("tag")).agg(F.count("*").alias("n"))


@query("pages_valid_landing", r"""
select page_id, url from pages where html like '%<h1>%'
  and not regexp_matches(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '404|not found|error')""")
def pages_valid_landing(spark, data_dir):
    parsed = parse_pages(table(spark, data_dir, "pages"), "title", "headings")
    return valid_landing_pages(parsed).select("page_id", "url")


# Fetch attempts: one per order, several per customer's page.
_ATTEMPTS = """select concat('https://docs.example.com/', o_custkey) as url,
  case o_orderstatus when 'F' then 200 when 'O' then 503 else 404 end as status,
  o_orderkey as attempt from {orders}"""


@query("pages_usable", f"""with a as ({_ATTEMPTS.format(orders='orders')}),
r as (select *, row_number() over (partition by url
  order by case when status = 200 then 0 else 1 end, attempt desc) as n from a)
select url, status, attempt, case status when 200 then 'usable' when 404 then 'gone'
  else 'transient' end as outcome from r where n = 1""")
def pages_usable(spark, data_dir):
    attempts = spark.sql(_ATTEMPTS, orders=table(spark, data_dir, "orders"))
    return latest_attempts(attempts)


@query("link_harvest", WITH_FACTS + f""", l as (
  select product_id, v3, case when v3 in (6, 7) then null when v3 = 3 then null else v3 end as keep,
    concat(v1, '.', v2, '.', v3) as version, issue_type as kind,
    concat('/notes/rel-', v1, '-', v2, '-', v3, '/', issue_type, '-issues') as path from facts)
select distinct product_id, version, kind, path from l where v3 not in (3, 7)""")
def link_harvest(spark, data_dir):
    row = f"""concat('<li><a href="', case v3
      when 1 then concat('{fixed.LOCALE_ROOT}/notes/rel-', v1, '-', v2, '-1/', issue_type, '-issues.html')
      when 2 then concat('notes/rel-', v1, '-', v2, '-2/', issue_type, '-issues.html')
      when 3 then concat('/notes/rel-', v1, '-', v2, '-3/known-and-addressed-issues/')
      when 7 then concat('/notes/', issue_type, '-issues')
      else concat('/notes/rel-', v1, '-', v2, '-', v3, '/', issue_type, '-issues') end,
      '">link</a><li><a href="/about">about</a>')"""
    rows = facts(spark, data_dir)
    html = (
        rows.groupBy("product_id", "l_orderkey")
        .agg(F.array_sort(F.collect_list(F.struct("row_ordinal", F.expr(row).alias("html")))).alias("b"))
        .select("product_id", F.array_join(F.transform("b", lambda b: b["html"]), "").alias("html"))
    )
    links = discovery.harvest_links(parse_pages(html, "links"))
    return links.select("product_id", "version", "kind", "path").distinct()


# --- tables ---------------------------------------------------------------------------

_ALT = "concat('ALT-', 1000 + l_partkey)"


@query("extract_issue_tables", WITH_FACTS + f""", r as (
  select *, cast(row_number() {ON_PAGE} - 1 as int) as row_no from facts)
select {PLAIN}, row_no from r
union all select {PAGE}, {_ALT}, {EXPECTED_ISSUE_SQL}, row_no from r where l_quantity >= 45""")
def extract_issue_tables(spark, data_dir):
    # Two ids as paragraphs or joined in one text; a table without ids stands before.
    id_cell = f"""case when l_quantity >= 48 then concat('<div class="p">', bug_id,
      '</div><div class="x p">', {_ALT}, '</div>') when l_quantity >= 45
      then concat('<b>', bug_id, '</b> and <b>', {_ALT}, '</b>') else bug_id end"""
    row = f"concat('<tr><td>', {id_cell}, '</td><td>', {RAW_TEXT_SQL}, '</td></tr>')"
    before = f"concat('<table><tr><th>Feature</th></tr><tr><td>x</td></tr></table>', {TABLE_OPEN})"
    parsed = parse_pages(_pages(spark, data_dir, row, before, TABLE_CLOSE), "tables")
    return _issue(extract.issue_tables(parsed), "row_no")


@query("extract_td_headers", WITH_FACTS + f"select {PLAIN} from facts")
def extract_td_headers(spark, data_dir):
    """Unclosed cells, header in td, description before the id."""
    row = f"concat('<tr><td>', {RAW_TEXT_SQL}, '<td>', bug_id)"
    before = "'<table><tr><td>Summary<td><b>ISSUE ID</b>'"
    parsed = parse_pages(_pages(spark, data_dir, row, before, "'</table>'"), "tables")
    return _issue(extract.issue_tables(parsed))


@query("extract_inline_div", WITH_FACTS + f"select {PLAIN} from facts")
def extract_inline_div(spark, data_dir):
    row = f"""concat('<div style="display: inline;"><tr><div style="display:inline"><td>', bug_id,
      '</td><td>', {RAW_TEXT_SQL}, '</td></div></tr></div>')"""
    parsed = parse_pages(_pages(spark, data_dir, row, TABLE_OPEN, TABLE_CLOSE), "tables")
    return _issue(extract.issue_tables(parsed))


@query("extract_nested_table", WITH_FACTS + f"""
select {PAGE}, bug_id, concat(description, ' [Unit: ', l_suppkey, '; Size: ', p_size, '] end') as description,
  cast(null as varchar) as workaround, cast(null as varchar) as fix_info, {COMPONENTS_SQL} as components
from facts""")
def extract_nested_table(spark, data_dir):
    row = """concat('<tr><td>', bug_id, '</td><td>', case when comp1 is not null
      then concat('(', comp1, ') ') else '' end, case when comp2 is not null then concat('(', comp2, ') ')
      else '' end, description, '<table><tr><td>Unit</td><td>', l_suppkey,
      '</td></tr><tr><th>Size<td>', p_size, '</td></tr></table>end</td></tr>')"""
    parsed = parse_pages(_pages(spark, data_dir, row, TABLE_OPEN, TABLE_CLOSE), "tables")
    return _issue(extract.issue_tables(parsed))


@query("extract_feature_tables", WITH_FACTS + f"""
select {PAGE}, bug_id, {CLEAN_TEXT_SQL} as description, workaround, fix_info,
  concat_ws('|', concat(issue_type, ' feature'), comp1, comp2) as components from facts""")
def extract_feature_tables(spark, data_dir):
    html = _pages(spark, data_dir, ROW, TABLE_OPEN, TABLE_CLOSE)
    label = F.concat(F.regexp_extract("url", "/([a-z]+)-issues$", 1), F.lit(" feature"))
    return _issue(extract.feature_tables(parse_pages(html, "tables"), label))


# --- topics and ARIA --------------------------------------------------------------------

_TOPIC = f"""concat('<div class="topic nested1"><h2 class="title topictitle2">', bug_id, '</h2>',
  '<div class="shortdesc">Description of ', bug_id, ': ', description, '</div>',
  '<div class="p">', case when comp1 is not null then concat('( ', comp1, ' ) ') else '' end,
  'It <b>repeats</b>.</div>',
  case when fix_info is not null then concat('<div class="p"><tt>This issue is addressed in 5.',
    v2, ' and 5.', v2, ' and 10.', v3, '-h1.</tt></div>') else '' end,
  case when workaround is not null then concat('<div class="p"><b>Workaround</b>: ', workaround,
    ' <i>now</i></div><div class="p">Dropped text.</div>') else '' end, '</div>')"""
_TOPIC_FIX = "concat('This issue is addressed in 5.', v2, ' and 5.', v2, ' and 10.', v3, '-h1.')"
_TOPIC_FIELDS = f"""concat(description, ' It repeats .') as description,
  concat(workaround, ' now') as workaround,
  case when fix_info is not null then {_TOPIC_FIX} end as fix_info, comp1 as components"""
# DuckDB's concat skips nulls, so the null cases are spelled out.
_TOPIC_FIELDS = _TOPIC_FIELDS.replace(
    "concat(workaround, ' now') as workaround", "workaround || ' now' as workaround"
)


@query("extract_topics", WITH_FACTS + f"select {PAGE}, bug_id, {_TOPIC_FIELDS} from facts")
def extract_topics(spark, data_dir):
    # Topics stand in a wrapper without content of its own.
    html = _pages(spark, data_dir, _TOPIC, """'<div class="topic"><h2 class="x">All</h2>'""", "'</div>'")
    return _issue(extract.topic_pages(parse_pages(html, "topics")))


@query("extract_nested_topics", WITH_FACTS + f"select {PAGE}, bug_id, {_TOPIC_FIELDS} from facts")
def extract_nested_topics(spark, data_dir):
    """Every topic lies inside the one before it; each keeps to its own content."""
    row = f"regexp_replace({_TOPIC}, '</div>$', '')"
    html = _pages(spark, data_dir, row)
    return _issue(extract.topic_pages(parse_pages(html, "topics")))


@query("fix_version_fanout", WITH_FACTS + f""", k as (
  select {PAGE}, bug_id, concat(description, ' It repeats .') as description,
    workaround || ' now' as workaround, comp1 as components, fix_info, v2 from facts)
select url, bug_id, description, workaround,
  case when fix_info is not null then 'addressed' end as fix_info, components,
  '3.4' as version, 'known' as issue_type from k
union all
select url, bug_id, description, workaround, concat('Plugin 5.', v2), components,
  concat('5.', v2), 'addressed' from k where fix_info is not null""")
def fix_version_fanout(spark, data_dir):
    topic = _TOPIC.replace("bug_id", "replace(bug_id, 'ISS', 'PLUG')")
    parsed = parse_pages(_pages(spark, data_dir, topic), "topics")
    known = extract.topic_pages(
        parsed,
        id_pattern=r"^(PAN|PLUG)-\d+$",
        fix_phrases=("this issue is addressed",),
        fix_in_text=False,
        keep_empty=True,
    ).withColumns({"version": F.lit("3.4"), "issue_type": F.lit("known")})
    out = extract.fix_version_fanout(known)
    return out.select(
        "url",
        F.replace("bug_id", F.lit("PLUG"), F.lit("ISS")).alias("bug_id"),
        "description",
        "workaround",
        F.when(F.col("fix_info").contains("addressed"), "addressed")
        .otherwise(F.col("fix_info"))
        .alias("fix_info"),
        join_components(),
        "version",
        "issue_type",
    )


_ARIA_ROW = """concat('<div role="row"><div role="cell"><p>', bug_id,
  case when v3 = 1 then ' (Linux)' when v3 = 2 then ' This issue is resolved in 9.1.' else '' end,
  '</p></div><div role="cell">', case when v3 = 3 then 'Windows, mac' else 'General' end,
  '</div><div role="cell"><p>', description, '</p>', case when workaround is not null
  then concat('<p>Workaround: ', workaround, '</p>') else '' end, '</div></div>',
  '<div role="row"><div role="cell">Windows on ARM</div><div role="cell">x</div></div>')"""


@query("extract_aria_tables", WITH_FACTS + f"""
select {PAGE}, bug_id, description, workaround,
  case when v3 = 2 then 'This issue is resolved in 9.1' end as fix_info,
  case v3 when 1 then 'Linux' when 3 then 'Windows|macOS' end as components from facts""")
def extract_aria_tables(spark, data_dir):
    # Header cells with a role of their own, or as an ordinary first row.
    role = "case when issue_type = 'known' then 'columnheader' else 'cell' end"
    before = f"""concat('<div role="table"><div role="row">', concat_ws('',
      transform(array('ISSUE ID', 'PLATFORM', 'DESCRIPTION'),
        h -> concat('<div role="', {role}, '">', h, '</div>'))), '</div>')"""
    html = _pages(spark, data_dir, _ARIA_ROW, before, "'</div>'")
    return _issue(extract.aria_issues(parse_pages(html, "aria")))


@query("extract_dispatch", WITH_FACTS + f"""
select {PLAIN} from facts where issue_type = 'known'
union all select {PAGE}, bug_id, {_TOPIC_FIELDS} from facts where issue_type = 'addressed'""")
def extract_dispatch(spark, data_dir):
    """Known pages hold tables and topics, addressed pages topics and a table without issues."""
    row = f"case when issue_type = 'known' then {ROW} else {_TOPIC} end"
    before = f"""case when issue_type = 'known' then concat({_TOPIC_CONST}, {TABLE_OPEN})
      else '<table><tr><th>Issue ID</th></tr><tr><td>none yet</td></tr></table>' end"""
    html = _pages(spark, data_dir, row, before, f"case when issue_type = 'known' then {TABLE_CLOSE} else '' end")
    return _issue(extract.issue_pages(parse_pages(html, "tables", "topics")))


_TOPIC_CONST = """'<div class="topic"><h2 class="title">PAN-1</h2><div class="p">Not read.</div></div>'"""

# --- sections ---------------------------------------------------------------------------


def _own_table(row=ROW, open_=TABLE_OPEN):
    """Each row in a table of its own, so that headings can stand between rows."""
    return f"concat({open_}, {row}, {TABLE_CLOSE})"


def _latest(value, when):
    """Last value set by a row at or above this one on the page."""
    return f"last_value(case when {when} then {value} end ignore nulls) {ON_PAGE}"


def _since(setter):
    """Rows of a page in groups that start at each row with a setter."""
    return f"sum(case when {setter} then 1 else 0 end) {ON_PAGE}"


_VERSION_MARK = "l_tax > 0.04"
_DATE_MARK = "l_discount > 0.05"
_MONTHS = "['January','February','March','April','May','June','July','August','September','October','November','December']"
_MONTH_SPARK = f"element_at(array({_MONTHS[1:-1]}), v2)"
_DAY = "concat(cast(v1 + 1980 as string), '-', lpad(cast(v2 as string), 2, '0'), '-01')"


@query("section_version_date", WITH_FACTS + f""", g as (
  select *, {_since(_VERSION_MARK)} as section from facts),
s as (select *, {_latest("concat(v1, '.', v2)", _VERSION_MARK)} as found,
  last_value(case when {_DATE_MARK} then {_DAY} end ignore nulls) over (
    partition by l_orderkey, issue_type, section order by row_ordinal) as dated from g)
select {PLAIN}, coalesce(found, 'Unknown') as version,
  case when issue_type = 'addressed' then dated end as release_date from s""")
def section_version_date(spark, data_dir):
    row = f"""concat(case when {_VERSION_MARK} then concat('<h3>Autonomous DEM Agent ', v1, '.', v2, '</h3>')
      else '<h3>More</h3>' end, case when {_DATE_MARK} then concat(case when v3 % 2 = 0 then '<p>' else '<h4>' end,
      {_MONTH_SPARK}, ' ', v1 + 1980, case when v3 % 2 = 0 then '' else '</h4>' end) else '' end,
      {_own_table()})"""
    parsed = parse_pages(_pages(spark, data_dir, row), "headings", "tables")
    kind = F.regexp_extract("url", "/([a-z]+)-issues$", 1)
    return _issue(extract.sections_by_agent_version(parsed, kind), "version", "release_date")


@query("section_component", WITH_FACTS + f""", s as (
  select *, {_latest("p_brand", _VERSION_MARK)} as section from facts)
select {PAGE}, bug_id, {CLEAN_TEXT_SQL} as description, workaround, fix_info,
  nullif(concat_ws('|', comp1, comp2, case when section <> coalesce(comp1, '') then section end), '')
    as components from s""")
def section_component(spark, data_dir):
    row = f"""concat(case when {_VERSION_MARK} then concat('<h2>', p_brand, ' Known Issues</h2>')
      else '<h2>Known Issues</h2>' end, {_own_table()})"""
    parsed = parse_pages(_pages(spark, data_dir, row), "headings", "tables")
    return _issue(extract.sections_by_component(parsed))


@query("section_constant", WITH_FACTS + f"""
select {PAGE}, bug_id, {CLEAN_TEXT_SQL} as description, workaround, fix_info,
  '{fixed.MULTITENANT_COMPONENT}' as components from facts""")
def section_constant(spark, data_dir):
    parsed = parse_pages(_pages(spark, data_dir, ROW, TABLE_OPEN, TABLE_CLOSE), "tables")
    return _issue(extract.constant_component(extract.issue_tables(parsed)))


_COMPONENT_MARK = "v3 in (2, 5)"
_BARE = "v3 = 4"


@query("section_scm", WITH_FACTS + f""", g as (
  select *, {_since(_VERSION_MARK)} as section,
    case when {_VERSION_MARK} then 'v' when {_DATE_MARK} then 'd' end as mark from facts),
w as (select *, {_latest("mark", "mark is not null")} as last_mark,
  {_latest("concat(v1 + 1980, '.r', v2, '.0')", _VERSION_MARK)} as found,
  {_latest(_DAY, "mark = 'd'")} as dated,
  last_value(case when {_COMPONENT_MARK} then case v3 when 2 then 'Policy' else 'SASE' end end ignore nulls)
    over (partition by l_orderkey, issue_type, section order by row_ordinal) as component from g)
select {PAGE}, bug_id, {CLEAN_TEXT_SQL} as description, workaround, fix_info,
  nullif(concat_ws('|', comp1, comp2, case when not ({_BARE}) then component end), '') as components,
  case when {_BARE} then 'Unknown' when last_mark = 'v' then found else 'Unknown' end as version,
  case when {_BARE} then {_DAY} when last_mark = 'd' then dated end as release_date
from w""")
def section_scm(spark, data_dir):
    bare = f"""concat('<table><tbody><tr><td>', bug_id, '<br>', {_MONTH_SPARK}, ' ', v1 + 1980,
      '</td><td>', {RAW_TEXT_SQL}, '</td></tr></tbody></table>')"""
    row = f"""concat(case when {_VERSION_MARK} then concat('<h2>Release ', v1 + 1980, '.r', v2, '.0</h2>')
      when {_DATE_MARK} then concat('<h2>', {_MONTH_SPARK}, ' ', v1 + 1980, '</h2>') else '' end,
      case v3 when 2 then '<h3>Policy and Objects</h3>' when 5 then '<h3>About sase</h3>' else '<h4>x</h4>' end,
      case when {_BARE} then {bare} else {_own_table()} end)"""
    parsed = parse_pages(_pages(spark, data_dir, row), "headings", "tables")
    return _issue(extract.sections_by_calendar_version(parsed), "version", "release_date")


@query("extract_fused_id", WITH_FACTS + f"""
select {PLAIN}, case when v3 in (1, 2) then concat(v1 + 1980, '.r', v2, '.', v3) else 'Unknown' end
  as version, case when v3 in (3, 4) then {_DAY} end as release_date from facts where v3 <> 7""")
def extract_fused_id(spark, data_dir):
    row = f"""concat('<tr><td>', case when v3 = 7 then 'Feature' else bug_id end, '<br/>',
      case when v3 in (1, 2) then concat(v1 + 1980, '.r', v2, '.', v3)
        when v3 in (3, 4) then concat({_MONTH_SPARK}, ' ', v1 + 1980) else '' end,
      '</td><td>', {RAW_TEXT_SQL}, '</td></tr>')"""
    parsed = parse_pages(_pages(spark, data_dir, row, "'<table>'", "'</table>'"), "tables")
    return _issue(extract.fused_id_tables(parsed), "version", "release_date")


@query("section_feature", WITH_FACTS + f""", s as (
  select *, {_latest("concat('Feature ', l_suppkey)", _VERSION_MARK)} as section from facts)
select {PAGE}, bug_id, {CLEAN_TEXT_SQL} as description, workaround, fix_info,
  nullif(concat_ws('|', section, comp1, comp2), '') as components from s""")
def section_feature(spark, data_dir):
    row = f"""concat(case when {_VERSION_MARK} then concat('<h3>Feature ', l_suppkey, '</h3>')
      else '<h3>Other Issues</h3><h4>Table of Contents</h4>' end, {_own_table()})"""
    parsed = parse_pages(_pages(spark, data_dir, row), "headings", "tables")
    return _issue(extract.sections_by_feature(parsed))


@query("section_index_page", WITH_FACTS + f"""
select {PLAIN}, concat(v1, '.', v2) as version from facts where {_VERSION_MARK}""")
def section_index_page(spark, data_dir):
    """A heading without a version clears the one before it."""
    row = f"""concat('<h2>', case when {_VERSION_MARK} then concat('Addressed in <b>Prisma</b> Access Agent ',
      v1, '.', v2) else 'Addressed elsewhere' end, '</h2>', {_own_table()})"""
    parsed = parse_pages(_pages(spark, data_dir, row), "headings", "tables")
    return _issue(extract.sections_by_index_version(parsed), "version")


@query("section_version_kind", WITH_FACTS + f""", m as (
  select *, concat('/pan-os/9-9/x-release-information-', v1, '-', v2) as none,
    case when v3 in (1, 2) then concat('10.', v2, '.', v3) when v3 in (3, 4) then '' end as set_version,
    case when v3 in (1, 3) then 'known' when v3 in (2, 4) then 'addressed' end as set_kind from facts),
s as (select *, {_latest("set_version", "set_version is not null")} as found,
  {_latest("set_kind", "set_kind is not null")} as kind from m)
select concat('/pan-os/10-2/', l_orderkey, '/', issue_type) as url, bug_id, {EXPECTED_ISSUE_SQL},
  coalesce(nullif(found, ''), '10.2') as version, coalesce(kind, issue_type) as issue_type from s""")
def section_version_kind(spark, data_dir):
    row = f"""concat(case v3 when 1 then concat('<h2>TS <i>Agent</i> 10.', v2, '.1 Known Issues</h2>')
      when 2 then concat('<h2>TS Agent 10.', v2, '.2 Addressed Issues</h2>') when 3 then '<h3>Known Issues</h3>'
      when 4 then '<h3>Fixed</h3>' else '<h3>Features</h3>' end, {_own_table()})"""
    url = "concat('/pan-os/10-2/', l_orderkey, '/', issue_type)"
    parsed = parse_pages(_pages(spark, data_dir, row, url=url), "headings", "tables")
    out = extract.sections_by_version_and_kind(parsed, F.col("url"))
    return _issue(out, "version", "issue_type")


# --- a load over products of all layouts ----------------------------------------------------

# Orders take turns over twelve kinds of pages: address, what stands above the table, expected fields.
_ID = "(100000 + l_orderkey)"
_TURNS = [
    # version in the address
    ("'globalprotect'", "concat('/globalprotect/release-notes/gp-', l_orderkey % 20 + 1, '-', l_orderkey % 7, '-', l_orderkey, '-', issue_type, '-issues')",
     "''", "concat(l_orderkey % 20 + 1, '.', l_orderkey % 7, '.', l_orderkey)", "null"),
    # no version
    ("'cloud-ngfw-aws'", f"concat('/cloud-ngfw-aws/', {_ID}, '/', issue_type, '-issues')", "''", f"'{fixed.VERSION_SAAS}'", "null"),
    # version in a heading
    ("'adem'", f"concat('/autonomous-dem/', {_ID}, '/', issue_type, '-issues')",
     "concat('<h3>Agent 5.', l_orderkey % 9, '</h3>')", "concat('5.', l_orderkey % 9)", "null"),
    # component or calendar version in a heading
    ("'scm'", f"concat('/strata-cloud-manager/', {_ID}, '/', issue_type, '-issues')",
     "case when issue_type = 'known' then '<h2>Insights Known Issues</h2>' else concat('<h2>2025.r', l_orderkey % 6, '.0</h2>') end",
     f"case when issue_type = 'known' then '{fixed.VERSION_SAAS}' else concat('2025.r', l_orderkey % 6, '.0') end",
     "case when issue_type = 'known' then 'Insights' end"),
    # year in the address, feature in a heading
    ("'device-security'", f"concat('/iot/release-notes/', {_ID}, '/', issue_type, '-issues-in-20', 10 + l_orderkey % 15)",
     "'<h3>Sensors</h3>'", "concat('20', 10 + l_orderkey % 15)", "'Sensors'"),
    # version for known pages, year for addressed ones
    ("'enterprise-dlp'", f"""concat('/enterprise-dlp/', {_ID}, case when issue_type = 'known' then '/known-issues-in-enterprise-dlp-plugin-60'
      else '/addressed-issues-in-20' end, 10 + l_orderkey % 15)""",
     "''", "concat(case when issue_type = 'known' then '6.0.' else '20' end, 10 + l_orderkey % 15)", "null"),
    # version and kind in a heading
    ("'ts-agent'", f"""concat('/tsa/terminal-services-agent-release-notes/', {_ID},
      case when issue_type = 'known' then '/known-issues-in-ts-agent' else '/ts-agent-addressed-issues' end)""",
     "concat('<h2>TS Agent 11.', l_orderkey % 8, case when issue_type = 'known' then ' Known' else ' Addressed' end, ' Issues</h2>')",
     "concat('11.', l_orderkey % 8)", "null"),
    # topics, one issue more for each version of a fix
    ("'sdwan-plugin'", "concat('/plugins/vm-series-and-panorama-plugins-release-notes/panorama-plugin-for-sd-wan/sd-wan-plugin-3-', l_orderkey % 7, '-', l_orderkey, '-', issue_type, '-issues')",
     "''", "concat('3.', l_orderkey % 7, '.', l_orderkey)", "null"),
    # a documentation space with ARIA tables
    ("'cortex-xdr'", f"concat('/', {_ID}, '/9.', l_orderkey % 5, '/', issue_type, '-issues')", "''", "concat('9.', l_orderkey % 5)", "null"),
    # known pages by version, addressed ones as index pages
    ("'prisma-access-agent'", f"""case when issue_type = 'known'
      then concat('/prisma-access-agent/release-notes/paa-26-', l_orderkey % 7, '-', l_orderkey, '-known-issues')
      else concat('/prisma-access-agent/', {_ID}, '/addressed-issues') end""",
     "case when issue_type = 'known' then '' else concat('<h2>Issues Addressed in Prisma Access Agent 26.', l_orderkey % 7, '</h2>') end",
     "case when issue_type = 'known' then concat('26.', l_orderkey % 7, '.', l_orderkey) else concat('26.', l_orderkey % 7) end", "null"),
    # tables only
    ("'remote-browser-isolation'", f"concat('/remote-browser-isolation/', {_ID}, '/', issue_type, '-issues')", "''", f"'{fixed.VERSION_SAAS}'", "null"),
    # a page of its own of another product; addressed pages there are nobody's
    ("case when issue_type = 'known' then 'scm' end", f"concat('/sase/prisma-sase-multitenant-platform/release-updates/', {_ID}, '/', issue_type, '-issues-msp')",
     "''", f"'{fixed.VERSION_SAAS}'", f"'{fixed.MULTITENANT_COMPONENT}'"),
]


def _turn(field: int) -> str:
    whens = " ".join(f"when {i} then {t[field]}" for i, t in enumerate(_TURNS))
    return f"case l_orderkey % {len(_TURNS)} {whens} end"


_TOPICS, _ARIA = 7, 8
_IS = f"l_orderkey % {len(_TURNS)} = "
_LOAD_BEFORE = f"""concat({_turn(2)}, case when {_IS}{_TOPICS} then '' when {_IS}{_ARIA}
  then '<div role="table"><div role="row"><div role="columnheader">ISSUE ID</div><div role="columnheader">PLATFORM</div><div role="columnheader">DESCRIPTION</div></div>'
  else {TABLE_OPEN} end)"""
_LOAD_AFTER = f"case when {_IS}{_TOPICS} then '' when {_IS}{_ARIA} then '</div>' else {TABLE_CLOSE} end"
_LOAD_ROW = f"""case when {_IS}{_TOPICS} then concat('<div class="topic nested1"><h2 class="title topictitle2">', replace(bug_id, 'ISS', 'PLUG'),
    '</h2><div class="shortdesc">', description, '</div><div class="p">It repeats.</div>', case when fix_info is not null
    then concat('<div class="p"><tt>This issue is addressed in 5.', v2, '.</tt></div>') else '' end, '</div>')
  when {_IS}{_ARIA} then concat('<div role="row"><div role="cell"><p>', bug_id, '</p></div><div role="cell">General</div><div role="cell"><p>', description, '</p></div></div>')
  else concat('<tr><td>', bug_id, '</td><td>', description, '</td></tr>') end"""
_LOADED = f""", turns as (
  select *, {_turn(0)} as product, {_turn(1)} as path, {_turn(3)} as v, {_turn(4)} as components from facts
), loaded as (
  select distinct l_orderkey, path, product as product_id, v as version, issue_type,
    case when {_IS}{_TOPICS} then replace(bug_id, 'ISS', 'PLUG') else bug_id end as bug_id,
    case when {_IS}{_TOPICS} then concat(description, ' It repeats.') else description end as description, components
  from turns where product is not null
  union
  select l_orderkey, path, product, concat('5.', v2), 'addressed', replace(bug_id, 'ISS', 'PLUG'), concat(description, ' It repeats.'), components
  from turns where {_IS}{_TOPICS} and issue_type = 'known' and fix_info is not null
)"""


def _load_inputs(spark, data_dir):
    """Work list, captures and work list entries of the documentation space of the turns."""
    rows = facts(spark, data_dir)
    html = pages(rows, _LOAD_ROW, _LOAD_BEFORE, _LOAD_AFTER, url=_turn(1))
    captures = html.selectExpr("url as path", "200 as status", "1 as attempt", "html")
    addresses = rows.select(
        "l_orderkey", "issue_type", F.expr(_turn(1)).alias("path"), F.expr(_turn(3)).alias("version"),
        F.lit(None).cast("string").alias("lastmod"), F.col("l_orderkey").cast("bigint").alias("ordinal"),
    ).distinct().withColumn("url", F.concat(F.lit(fixed.DOCS_HOST), "path"))
    none = spark.createDataFrame([], "product_id string, url string, lastmod string")
    space = f"{_IS}{_ARIA}"
    due = load.due_by_profile(addresses.filter(f"not {space}").select("url", "lastmod", "ordinal"), none)
    given = addresses.filter(space).select(
        F.lit("cortex-xdr").alias("product_id"), F.lit("aria_tables").alias("layout"), F.lit(None).cast("string").alias("component"),
        F.lit(0).alias("stage"), "version", F.col("issue_type").alias("kind"), "path", "ordinal", "url", "lastmod",
    )
    return due.unionByName(given), captures


@query("load_issues_all_layouts", WITH_FACTS + _LOADED + """
select product_id, version, issue_type, bug_id, description, components from loaded""")
def load_issues_all_layouts(spark, data_dir):
    loaded = load.load_all_layouts(*_load_inputs(spark, data_dir))
    return loaded.select("product_id", "version", "issue_type", "bug_id", "description", join_components())


_GONE = "l_orderkey % 7 = 3"
_HELD = f"{_IS}0 and l_orderkey % 5 = 0"


@query("load_refresh", WITH_FACTS + _LOADED + f"""
select 'issue' as part, product_id, version, bug_id as item, description as detail from loaded
  where not ({_GONE}) and not ({_HELD})
union all
select distinct 'issue', product, v, bug_id, 'Held.' from turns where {_HELD}
union all
select distinct 'failure', product, '', path, 'gone' from turns where product is not null and {_GONE}
union all
select distinct 'manifest', product, '', path, '1' from turns where product is not null and not ({_GONE})""")
def load_refresh(spark, data_dir):
    """A load into a held data set with its books; some pages are gone, some versions are held."""
    due, captures = _load_inputs(spark, data_dir)
    due = load.stored_work(due)
    gone = F.col("ordinal") % 7 == 3
    missing = due.filter(gone).select("path").distinct().withColumn("gone", F.lit(True))
    captures = captures.join(missing, "path", "left").withColumn("status", F.when(F.col("gone"), 404).otherwise(F.col("status"))).drop("gone")
    none = spark.createDataFrame([], "product_id string, url string, lastmod string, seq long")
    names = due.select("product_id", F.col("product_id").alias("product_name")).distinct()
    held = facts(spark, data_dir).filter(_HELD).select(
        F.lit("globalprotect").alias("product_id"), F.lit("Held").alias("product_name"), F.expr(_turn(3)).alias("version"),
        "issue_type", "bug_id", F.lit("Held.").alias("description"),
        *[F.lit(None).cast("string").alias(c) for c in ("symptoms", "workaround", "fix_info", "release_date", "source_url")],
        F.lit(None).cast("array<string>").alias("affected_components"),
        F.lit(0).cast("bigint").alias("page_ordinal"), F.lit(0).cast("bigint").alias("row_ordinal"),
    ).dropDuplicates(["version", "bug_id"])
    books = load.run(held, none, due, captures, names, 1, all_layouts=True)

    def part(name, rows, version, item, detail):
        return rows.select(F.lit(name).alias("part"), "product_id", version.alias("version"), item.alias("item"), detail.alias("detail"))

    path = F.replace("url", F.lit(fixed.DOCS_HOST), F.lit(""))
    return (
        part("issue", books["issues"], F.col("version"), F.col("bug_id"), F.col("description"))
        .unionByName(part("failure", books["failures"].distinct(), F.lit(""), path, F.col("error")))
        .unionByName(part("manifest", books["manifest"], F.lit(""), path, F.col("seq").cast("string")))
    )
