"""Text clean-up queries: the input text is put together from columns, the result is the columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixatlas.functions import text as tx
from fixatlas.operators import extract
from fixatlas.workloads.derived import WITH_FACTS, facts, join_components
from fixatlas.workloads.registry import query

KEY = ["page_ordinal", "row_ordinal"]
KEYS = "page_ordinal, row_ordinal"


def _struct(spark, data_dir, raw, fn):
    """Key columns plus all fields of the struct ``fn`` makes of the text."""
    rows = facts(spark, data_dir).select(*KEY, F.expr(raw).alias("raw"))
    return rows.select(*KEY, fn(F.col("raw")).alias("_s")).select(*KEY, "_s.*")


@query("text_workaround", WITH_FACTS + f"""
select {KEYS}, concat(description, '.',
  case when workaround is not null and v3 = 1 then ' Note: ask' else '' end) as description,
  workaround from facts""")
def text_workaround(spark, data_dir):
    raw = """concat(description, '.', case when workaround is not null then concat(
      case when v3 % 2 = 0 then ' WORKAROUND :  ' else ' Workaround:' end, workaround,
      case when v3 = 1 then concat(chr(10), 'Note: ask') else '' end) else '' end)"""
    return _struct(spark, data_dir, raw, tx.split_workaround)


_SENTENCE = "concat('This issue is resolved in ', substring(fix_info, 13), '.')"
_FIX_RAW = f"""case when fix_info is null then concat(description, '.')
  when v3 = 6 then {_SENTENCE}
  else concat(description, '. ', {_SENTENCE}, case when v3 = 1 then ' Thanks.' else '' end) end"""
_CUT = "fix_info is not null and v3 not in (6, 7) and l_returnflag <> 'A'"


@query("text_fix_info", WITH_FACTS + f"""
select {KEYS}, case when {_CUT}
    then concat(description, '.', case when v3 = 1 then ' Thanks.' else '' end)
    else {_FIX_RAW} end as description,
  case when v3 = 7 then 'see notes' when l_returnflag = 'A' then 'Resolved in 9.1'
    when {_CUT} then fix_info end as fix_info from facts""")
def text_fix_info(spark, data_dir):
    known = F.expr("""case when v3 = 7 then 'see notes' when l_returnflag = 'A'
      then 'This issue is resolved in 9.1.' end""")
    rows = facts(spark, data_dir)
    cut = tx.split_fix_info(F.expr(_FIX_RAW), known)
    return rows.select(*KEY, cut.alias("_s")).select(*KEY, "_s.*")


@query("text_bug_id", WITH_FACTS + f"""
select {KEYS}, case when v3 = 7 then concat('Feature ', l_suppkey) else bug_id end as bug_id,
  case when v3 <> 7 then fix_info end as fix_info from facts""")
def text_bug_id(spark, data_dir):
    raw = """case when v3 = 7 then concat('Feature ', l_suppkey) else concat(' ', bug_id,
      case when v3 = 2 then '  ' else '' end, coalesce(fix_info, '')) end"""
    return _struct(spark, data_dir, raw, tx.split_bug_id)


@query("text_components", WITH_FACTS + f"""
select {KEYS}, concat(description, ' (all)') as description,
  nullif(concat_ws('|', comp1, comp2), '') as components from facts
where comp1 is not null or comp2 is not null
union all
select {KEYS}, concat(case when v3 = 2 then '( )' else '' end, description, ' (all)'), null
from facts where comp1 is null and comp2 is null""")
def text_components(spark, data_dir):
    raw = """concat(case when v3 = 2 then '( )' else '' end,
      case when comp1 is not null then concat('(', comp1, ') ') else '' end,
      case when comp2 is not null then concat('( ', comp2, ')') else '' end,
      description, ' (all)')"""
    out = _struct(spark, data_dir, raw, tx.split_components)
    return out.select(*KEY, "description", join_components())


_ALT = "concat('ALT-', 1000 + l_partkey)"


@query("text_multi_id", WITH_FACTS + f"""
select {KEYS}, case
  when v3 = 1 then bug_id
  when v3 = 5 then concat(bug_id, ', ', {_ALT}, ' see notes')
  when v3 = 7 then concat(bug_id, '|', {_ALT}, '|SUP-', 1000 + l_suppkey)
  else concat(bug_id, '|', {_ALT}) end as ids from facts""")
def text_multi_id(spark, data_dir):
    fused = F.expr(f"""case v3 when 1 then bug_id when 2 then concat(bug_id, ' and ', {_ALT})
      when 3 then concat(bug_id, '/', {_ALT}) when 5 then concat(bug_id, ', ', {_ALT}, ' see notes')
      when 7 then concat(bug_id, 'and', {_ALT}, 'SUP-', 1000 + l_suppkey)
      else concat(bug_id, {_ALT}) end""")
    parts = F.expr(f"""case v3 when 6 then array(bug_id, {_ALT})
      when 7 then array(concat(bug_id, 'and', {_ALT}), concat('SUP-', 1000 + l_suppkey))
      else cast(array() as array<string>) end""")
    ids = F.array_join(tx.split_id_cell(fused, parts), "|").alias("ids")
    return facts(spark, data_dir).select(*KEY, ids)


_RAW_ROW = """concat(
  case when comp1 is not null then concat('(', comp1, ') ') else '' end,
  case when comp2 is not null then concat('( ', comp2, ')') else '' end, description, '.',
  case when fix_info is not null then concat(' This issue is resolved in ', substring(fix_info, 13), '.') else '' end,
  case when workaround is not null then concat(' Workaround: ', workaround) else '' end)"""


@query("clean_issue_rows", WITH_FACTS + f""", cleaned as (
  select {KEYS}, v3, bug_id, {_ALT} as alt, concat(description, '.',
      case when v3 = 2 and fix_info is not null then concat(' This issue is resolved in ',
        substring(fix_info, 13), '.') else '' end) as description,
    workaround, case when v3 = 2 then 'In 9.1' else fix_info end as fix_info,
    nullif(concat_ws('|', comp1, comp2), '') as components from facts where v3 <> 7)
select {KEYS}, bug_id, description, workaround, fix_info, components from cleaned
union all
select {KEYS}, alt, description, workaround, fix_info, components from cleaned where v3 = 3""")
def clean_issue_rows(spark, data_dir):
    rows = facts(spark, data_dir).select(
        *KEY,
        F.expr(f"""case v3 when 2 then concat(bug_id, 'In 9.1') when 3 then concat(bug_id, 'and', {_ALT})
          when 7 then concat('Feature ', l_suppkey) else bug_id end""").alias("id"),
        F.expr("cast(array() as array<string>)").alias("id_parts"),
        F.expr(_RAW_ROW).alias("text"),
    )
    return extract.clean_rows(rows).select(
        *KEY, "bug_id", "description", "workaround", "fix_info", join_components()
    )


@query("text_aria_row", WITH_FACTS + f""", r as (
  select {KEYS}, v3, bug_id, {_ALT} as alt, description,
    workaround, case when v3 = 4 then 'This issue is resolved in 9.1' end as fix_info,
    nullif(concat_ws('|', case when v3 in (1, 2) then 'Windows' end,
      case when v3 = 2 then 'Linux' when v3 = 3 then 'macOS' when v3 = 6 then 'Solaris' end), '')
      as components from facts where v3 <> 7)
select {KEYS}, bug_id, description, workaround, fix_info, components from r
union all
select {KEYS}, alt, description, workaround, fix_info, components from r where v3 = 5""")
def text_aria_row(spark, data_dir):
    issue = F.expr(f"""case v3 when 1 then concat(bug_id, ' (Windows)') when 4
      then concat(replace(bug_id, '-', '‑'), ' This issue is resolved in 9.1.')
      when 5 then concat(bug_id, ', ', {_ALT}) when 7 then 'Windows on ARM' else bug_id end""")
    platform = F.expr("""case v3 when 1 then 'windows' when 2 then 'Windows, Linux' when 3
      then 'mac, General' when 6 then 'Solaris' end""")
    text = F.expr("""concat(description, case when workaround is not null
      then concat('  workaround: ', workaround) else '' end)""")
    rows = facts(spark, data_dir).select(
        *KEY, F.explode(tx.aria_row(issue, text, platform)).alias("_i")
    )
    return rows.select(
        *KEY, "_i.bug_id", "_i.description", "_i.workaround", "_i.fix_info",
        join_components("_i.affected_components"),
    )


_MONTH_NAMES = "'January','February','March','April','May','June','July','August','September','October','November','December'"


@query("text_date", WITH_FACTS + f"""
select {KEYS}, case
  when v3 in (1, 5) then concat(v1 + 1980, '-', lpad(cast(v2 as string), 2, '0'), '-',
    lpad(cast(l_suppkey % 28 + 1 as string), 2, '0'))
  when v3 = 2 then concat(v1 + 1980, '-', lpad(cast(v2 as string), 2, '0'), '-01')
  when v3 = 3 then release_date when v3 = 6 then '2024-02-31' end as release_date
from facts""")
def text_date(spark, data_dir):
    month = f"element_at(array({_MONTH_NAMES}), v2)"
    raw = F.expr(f"""case v3 when 1 then concat({month}, ' ', l_suppkey % 28 + 1, ', ', v1 + 1980)
      when 2 then concat(' ', {month}, ' ', v1 + 1980) when 3 then release_date
      when 4 then concat(substring({month}, 1, 3), '. ', v1 + 1980)
      when 5 then concat(lower({month}), ' ', l_suppkey % 28 + 1, ' ', v1 + 1980)
      when 6 then 'FEBRUARY 31, 2024' else concat('Released ', v1 + 1980) end""")
    return facts(spark, data_dir).select(*KEY, tx.parse_date(raw).alias("release_date"))


@query("text_collapse", """
select p_partkey, concat(p_name, ' of ', p_brand) as text from part""")
def text_collapse(spark, data_dir):
    rows = spark.read.parquet(f"{data_dir}/part.parquet")
    raw = F.concat(
        F.lit("  \t"), "p_name", F.lit(" \n "), F.lit("of"), F.lit("\r\n "), "p_brand",
        F.lit(" 　"),
    )
    return rows.select("p_partkey", tx.collapse(raw).alias("text"))


@query("text_collapse_documents", r"""
select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as text from documents""")
def text_collapse_documents(spark, data_dir):
    rows = spark.read.parquet(f"{data_dir}/documents.parquet")
    return rows.select("doc_id", tx.collapse(F.col("text")).alias("text"))


@query("show_fix_info", WITH_FACTS + f"""
select {KEYS}, v3 not in (1, 2, 3, 6) and fix_info is not null as shown from facts""")
def show_fix_info(spark, data_dir):
    text = F.expr("""case when fix_info is null or v3 = 6 then case when v3 = 5 then null else '' end
      when v3 = 1 then fix_info when v3 = 2 then 'This Issue is fixed' when v3 = 3
      then 'Addressed in 9.1' else concat('Hotfix ', substring(fix_info, 13)) end""")
    return facts(spark, data_dir).select(*KEY, tx.show_fix_info(text).alias("shown"))


@query("html_escape", """
select p_partkey, concat('&lt;b&gt;', p_name, '&lt;&#x2F;b&gt; &amp;amp; &quot;', p_brand,
  '&quot; it&#39;s') as html from part""")
def html_escape(spark, data_dir):
    rows = spark.read.parquet(f"{data_dir}/part.parquet")
    raw = F.concat(
        F.lit("<b>"), "p_name", F.lit('</b> &amp; "'), "p_brand", F.lit('" it\'s')
    )
    return rows.select("p_partkey", tx.html_escape(raw).alias("html"))


@query("parse_generated_at", WITH_FACTS + f"""
select {KEYS}, case when v3 in (1, 2, 3) then concat(v1 + 1980, '-', lpad(cast(v2 as string), 2, '0'),
  '-05') when v3 in (4, 5) then '-' end as generated from facts""")
def parse_generated_at(spark, data_dir):
    day = "concat(v1 + 1980, '-', lpad(cast(v2 as string), 2, '0'), '-05')"
    raw = F.expr(f"""case v3 when 1 then concat({day}, 'T10:11:12Z') when 2
      then concat({day}, 'T10:11:12.123456+00:00') when 3 then {day}
      when 4 then 'soon' when 5 then concat(v1, '/', v2) when 6 then '' end""")
    return facts(spark, data_dir).select(*KEY, tx.generated_date(raw).alias("generated"))
