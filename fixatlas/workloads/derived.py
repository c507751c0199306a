"""Issue data derived from the given tables.

The tables hold no issues, so every line item stands for one issue row of a part's
type ("product").  The definition is SQL that both engines read the same way; the
operators under test run on top of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FACTS_SQL = """
select f.*,
  concat(v1, '.', v2, '.', v3, case when hot > 0 then concat('-h', hot) else '' end) as version
from (
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax,
    l_returnflag, p_brand, p_size, p_name,
    lower(p_type) as product_id, p_type as product_name,
    cast(year(l_shipdate) - 1980 as int) as v1, cast(month(l_shipdate) as int) as v2,
    l_linenumber as v3,
    case when l_quantity >= 40 then cast(l_quantity as int) % 12 + 1 else 0 end as hot,
    case when l_linestatus = 'O' then 'known' else 'addressed' end as issue_type,
    concat('ISS-', 100000 + l_orderkey) as bug_id,
    concat(p_name, ' drops sessions on unit ', l_suppkey) as description,
    case when l_tax >= 0.07 then 'Seen under load' end as symptoms,
    case when l_discount >= 0.05 then concat('Set size ', p_size) end as workaround,
    case when l_returnflag = 'R' then concat('Resolved in ', year(l_shipdate) - 1979, '.0') end
      as fix_info,
    case when l_tax > 0 then p_brand end as comp1,
    case when l_tax > 0.04 then concat('Size ', p_size) end as comp2,
    case when l_linestatus = 'F' and l_discount > 0.02 then concat(cast(year(l_shipdate) as string),
      '-', lpad(cast(month(l_shipdate) as string), 2, '0'), '-01') end as release_date,
    l_orderkey as page_ordinal,
    ((cast(l_linenumber as bigint) * 10000000 + l_partkey) * 100000 + l_suppkey) * 100
      + cast(l_quantity as bigint) as row_ordinal
  from {lineitem} join {part} on l_partkey = p_partkey
) f
"""

# Start of an expected-result query: the derived rows as a common table expression.
WITH_FACTS = f"with facts as ({FACTS_SQL.format(lineitem='lineitem', part='part')})"

# Components as compared in results.
COMPONENTS_SQL = "nullif(concat_ws('|', comp1, comp2), '')"


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{data_dir}/{name}.parquet")


def facts(spark: SparkSession, data_dir: str) -> DataFrame:
    return spark.sql(
        FACTS_SQL,
        lineitem=table(spark, data_dir, "lineitem"),
        part=table(spark, data_dir, "part"),
    )


_ISSUE_COLUMNS = [
    "product_id", "product_name", "version", "issue_type", "bug_id", "description", "symptoms",
    "workaround", "fix_info", "affected_components", "release_date", "source_url",
    "page_ordinal", "row_ordinal",
]


def as_issues(rows: DataFrame) -> DataFrame:
    """Derived rows in the shape of the issues table."""
    components = F.array_compact(F.array("comp1", "comp2"))
    return rows.withColumns(
        {
            "affected_components": F.when(F.size(components) > 0, components),
            "source_url": page_url(),
        }
    ).select(*_ISSUE_COLUMNS)


def issues(spark: SparkSession, data_dir: str) -> DataFrame:
    return as_issues(facts(spark, data_dir))


def snapshots(spark: SparkSession, data_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two overlapping states: without rows flagged N, and without rows flagged R."""
    rows = facts(spark, data_dir)
    return (
        as_issues(rows.filter("l_returnflag <> 'N'")),
        as_issues(rows.filter("l_returnflag <> 'R'")),
    )


SNAPSHOTS_SQL = (
    WITH_FACTS
    + """, old as (select * from facts where l_returnflag <> 'N'),
 new as (select * from facts where l_returnflag <> 'R'),
 o as (select product_id, version, count(*) filter (issue_type = 'known') as known,
   count(*) filter (issue_type = 'addressed') as addressed from old group by all),
 n as (select product_id, version, count(*) filter (issue_type = 'known') as known,
   count(*) filter (issue_type = 'addressed') as addressed from new group by all)
"""
)


def join_components(c="affected_components") -> Column:
    return F.array_join(c, "|").alias("components")


# --- pages ------------------------------------------------------------------------------

PAGE_URL_SQL = "concat('https://docs.example.com/', l_orderkey, '/', issue_type, '-issues')"


def page_url() -> Column:
    return F.expr(PAGE_URL_SQL.replace("l_orderkey", "page_ordinal"))


def pages(
    rows: DataFrame, row_html: str, before: str = "''", after: str = "''", url: str = PAGE_URL_SQL
) -> DataFrame:
    """Pages ``url, html``: the rows of an order of one kind, in order, in one document.

    ``row_html``, ``before`` and ``after`` are SQL; a page has the handful of rows an
    order has.
    """
    body = F.array_sort(F.collect_list(F.struct("row_ordinal", F.expr(row_html).alias("html"))))
    head = "'<html><head><title>Release notes</title></head><body><h1>Release notes</h1>'"
    return (
        rows.groupBy("l_orderkey", "issue_type")
        .agg(body.alias("body"))
        .select(
            F.expr(url).alias("url"),
            F.concat(
                F.expr(f"concat({head}, {before})"),
                F.array_join(F.col("body")["html"], ""),
                F.expr(f"concat({after}, '</body></html>')"),
            ).alias("html"),
        )
    )


TABLE_OPEN = (
    "'<table><thead><tr><th>Issue ID</th><th>Description</th></tr></thead><tbody>'"
)
TABLE_CLOSE = "'</tbody></table>'"

# Text of an issue as a page shows it, and what cleaning makes of it.
RAW_TEXT_SQL = """concat(
  case when comp1 is not null then concat('(', comp1, ') ') else '' end,
  case when comp2 is not null then concat('( ', comp2, ')') else '' end,
  description, ' &amp; more.',
  case when fix_info is not null then concat(' This issue is <i>resolved</i> in ', substring(fix_info, 13), '.') else '' end,
  case when workaround is not null then concat(' <b>Workaround:</b> ', workaround) else '' end)"""
CLEAN_TEXT_SQL = "concat(description, ' & more.')"

EXPECTED_ISSUE_SQL = f"""{CLEAN_TEXT_SQL} as description, workaround, fix_info,
 {COMPONENTS_SQL} as components"""
