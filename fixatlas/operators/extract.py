"""Parsed pages to issue rows.

Every layout is an expression over the lists of one page, so extraction needs no
shuffle at all: a page is one row, document order is array order, and the
section a table stands in is the last heading of the array before it.  Rows are
exploded once per page, after which the text rules of `functions.text` apply.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixatlas import fixed
from fixatlas.functions import text as tx
from fixatlas.functions import urls as ux

# --- tables ---------------------------------------------------------------------------


def _any_word(words):
    return lambda x: ux.contains_any(x, words)


def _last_index(items: Column, test) -> Column:
    return F.array_max(F.transform(items, lambda x, i: F.when(test(x), i)))


def table_rows(tables: Column, td_headers: bool = True) -> Column:
    """Raw rows of all issue tables of a page: ``array<struct<ord, row_no, id, ..>>``.

    The issue column is the last header naming issue, bug or id; the description
    column the last other header naming description or summary.  Tables without an
    issue column and rows too short for the chosen columns give nothing.
    """
    names_issue = _any_word(["issue", "bug", "id"])
    names_text = _any_word(["description", "summary"])

    def lowered(cells):
        return F.transform(cells, lambda c: F.lower(c["fused"]))

    def of_tag(cells, tag):
        return F.filter(cells, lambda c: c["tag"] == tag)

    def layout(t):
        """Header texts, whether the first row served as header, and the data rows."""
        rows = t["rows"]
        head = F.flatten(
            F.transform(F.filter(rows, lambda r: r["section"] == "thead"), lambda r: r["cells"])
        )
        first = F.coalesce(F.try_element_at(rows, F.lit(1))["cells"], F.slice(head, 1, 0))
        first_th = of_tag(first, "th")
        first_td = lowered(of_tag(first, "td"))
        by_td = F.lit(False)
        if td_headers:
            by_td = (
                ~t["has_head"]
                & (F.size(first_th) == 0)
                & F.exists(first_td, _any_word(["issue", "id"]))
            )
        headers = (
            F.when(t["has_head"], lowered(of_tag(head, "th")))
            .when(by_td, first_td)
            .otherwise(lowered(first_th))
        )
        direct = F.filter(rows, lambda r: r["section"] == "")
        body = (
            F.when(t["has_body"], F.filter(rows, lambda r: r["section"] == "tbody 1"))
            .when(F.size(direct) > 0, direct)
            .otherwise(rows)
        )
        starts_with_th = F.exists(
            F.coalesce(F.try_element_at(body, F.lit(1))["cells"], F.slice(head, 1, 0)),
            lambda c: c["tag"] == "th",
        )
        skip = by_td | (~t["has_body"] & starts_with_th)
        return F.struct(
            t["ord"].alias("ord"),
            headers.alias("headers"),
            F.when(skip, F.slice(body, F.lit(2), F.greatest(F.size(body), F.lit(1)))).otherwise(body).alias("rows"),
        )

    def columns(t):
        return F.struct(
            t["ord"].alias("ord"),
            t["rows"].alias("rows"),
            _last_index(t["headers"], names_issue).alias("issue"),
            _last_index(t["headers"], lambda h: ~names_issue(h) & names_text(h)).alias("text"),
        )

    def raw_rows(t):
        wide = F.filter(
            t["rows"],
            lambda r: F.size(r["cells"]) > F.greatest(t["issue"], F.coalesce(t["text"], F.lit(0))),
        )
        return F.transform(
            wide,
            lambda r, i: F.struct(
                t["ord"].alias("ord"),
                i.alias("row_no"),
                F.get(r["cells"], t["issue"])["fused"].alias("id"),
                F.get(r["cells"], t["issue"])["parts"].alias("id_parts"),
                F.coalesce(F.get(r["cells"], t["text"])["spaced"], F.lit("")).alias("text"),
            ),
        )

    found = F.filter(
        F.transform(F.transform(tables, layout), columns), lambda t: t["issue"].isNotNull()
    )
    return F.flatten(F.transform(found, raw_rows))


def headerless_rows(tables: Column) -> Column:
    """Rows of tables without any header text: id cell first, description second."""

    def bare(t):
        head = F.flatten(
            F.transform(F.filter(t["rows"], lambda r: r["section"] == "thead"), lambda r: r["cells"])
        )
        first = F.coalesce(F.try_element_at(t["rows"], F.lit(1))["cells"], F.slice(head, 1, 0))
        headers = F.filter(
            F.when(t["has_head"], head).otherwise(first), lambda c: c["tag"] == "th"
        )
        return ~F.exists(headers, lambda c: c["fused"] != "")

    def rows(t):
        body = F.filter(
            t["rows"], lambda r: (F.size(r["cells"]) >= 2)
            & (~t["has_body"] | (r["section"] == "tbody 1"))
        )
        return F.transform(
            body,
            lambda r, i: F.struct(
                t["ord"].alias("ord"),
                i.alias("row_no"),
                F.get(r["cells"], F.lit(0))["fused"].alias("id"),
                F.get(r["cells"], F.lit(0))["parts"].alias("id_parts"),
                F.get(r["cells"], F.lit(1))["spaced"].alias("text"),
            ),
        )

    return F.flatten(F.transform(F.filter(tables, bare), rows))


def _valid_ids(row: Column) -> Column:
    """Cleaned identifiers of a raw row that pass validation, with their trailing fix text.

    A cell that is one identifier and nothing else, as most are, is taken as it is.
    """
    alone = (F.size(row["id_parts"]) == 0) & row["id"].rlike(r"\A[A-Z]+-\d+\z")
    own = F.array(F.struct(row["id"].alias("bug_id"), F.lit(None).cast("string").alias("fix_info")))
    split = F.filter(
        F.transform(tx.split_id_cell(row["id"], row["id_parts"]), tx.split_bug_id),
        lambda i: i["bug_id"].rlike(fixed.BUG_ID_VALID),
    )
    return F.when(alone, own).otherwise(split)


def clean_text(df: DataFrame, fix_info: Column | None = None) -> DataFrame:
    """Workaround, fix sentence and components out of ``text``, in this order.

    One expression with named steps: as separate columns the optimizer would merge
    the steps and repeat each of them for every use.
    """
    known = F.lit(None).cast("string") if fix_info is None else fix_info

    def fix(w):
        return F.struct(
            w["workaround"].alias("workaround"),
            tx.split_fix_info(w["description"], known).alias("f"),
        )

    def components(x):
        return F.struct(
            x["workaround"].alias("workaround"),
            x["f"]["fix_info"].alias("fix_info"),
            tx.split_components(x["f"]["description"]).alias("c"),
        )

    steps = tx.let(tx.let(tx.split_workaround(F.col("text")), fix), components)
    kept = [c for c in df.columns if c not in ("text", "fix_info")]
    # Exploding a one-element array keeps the struct whole, so it is computed once.
    return df.select(*kept, F.explode(F.array(steps)).alias("_s")).select(
        *kept,
        F.col("_s.c.description").alias("description"),
        F.col("_s.workaround").alias("workaround"),
        F.col("_s.fix_info").alias("fix_info"),
        F.col("_s.c.affected_components").alias("affected_components"),
    )


def clean_rows(rows: DataFrame) -> DataFrame:
    """Raw rows (``id``, ``id_parts``, ``text``) to one issue per valid identifier."""
    kept = [c for c in rows.columns if c not in ("id", "id_parts", "text")]
    one = rows.select(
        *kept,
        "text",
        F.posexplode(_valid_ids(F.struct("id", "id_parts"))).alias("id_no", "_i"),
    )
    one = one.select(*kept, "text", "id_no", "_i.bug_id", "_i.fix_info")
    return clean_text(one, F.col("fix_info"))


def explode_rows(pages: DataFrame, rows: Column, *drop: str) -> DataFrame:
    kept = [c for c in pages.columns if c not in drop]
    return pages.select(*kept, F.explode(rows).alias("_r")).select(*kept, "_r.*")


_PARTS = ("title", "headings", "links", "tables", "topics", "aria")


def issue_tables(pages: DataFrame) -> DataFrame:
    """Issues of all top-level tables of parsed pages."""
    return clean_rows(explode_rows(pages, table_rows(F.col("tables")), *_PARTS))


def without_issue_tables(pages: DataFrame) -> DataFrame:
    """Parsed pages whose tables give no issue: a test on the page's own arrays, no text is cleaned."""
    has_issue = F.exists(table_rows(F.col("tables")), lambda r: F.size(_valid_ids(r)) > 0)
    return pages.filter(~F.coalesce(has_issue, F.lit(False))).drop("tables")


# --- topics ---------------------------------------------------------------------------


def topic_issues(
    topics: Column,
    id_pattern: str = fixed.BUG_ID_VALID,
    fix_phrases=("this issue is addressed", "this issue is fixed"),
    fix_in_text: bool = True,
    keep_empty: bool = False,
) -> Column:
    """Issues of topic blocks as ``array<struct<ord, bug_id, description, ..>>``."""

    def says_fixed(x):
        return F.coalesce(tx.says_any(x, fix_phrases), F.lit(False))

    def sort_paras(t):
        """Paragraphs with their role: workaround marker, fix sentence or description."""
        roles = F.transform(
            t["paras"],
            lambda p, i: F.struct(
                i.alias("i"),
                p["text"].alias("text"),
                p["after_bold"].alias("after"),
                F.when(tx.says_any(p["bold"], ["workaround"]), "w")
                .when(says_fixed(p["tt"]), "t")
                .when(says_fixed(p["text"]) if fix_in_text else F.lit(False), "f")
                .otherwise("d")
                .alias("role"),
                p["tt"].alias("tt"),
            ),
        )
        return F.struct(
            t["ord"].alias("ord"), t["title"].alias("bug_id"), t["shortdesc"].alias("short"),
            roles.alias("paras"),
        )

    component = r"(?U)^\(\s*([^)]+?)\s*\)\s*"

    def last(paras, test, value):
        return F.try_element_at(F.transform(F.filter(paras, test), value), F.lit(-1))

    def read(t):
        paras = t["paras"]
        marker = F.array_min(F.transform(paras, lambda p: F.when(p["role"] == "w", p["i"])))

        def texts(marker):
            return F.transform(
                F.filter(paras, lambda p: (p["role"] == "d") & (p["i"] < F.coalesce(marker, F.lit(1 << 30)))),
                lambda p: p["text"],
            )

        return tx.let(tx.let(marker, texts), lambda body: with_body(t, paras, body))

    def with_body(t, paras, body):
        first = F.coalesce(F.get(body, F.lit(0)), F.lit(""))
        return F.struct(
            t["ord"].alias("ord"),
            t["bug_id"].alias("bug_id"),
            t["short"].alias("short"),
            F.transform(
                body,
                lambda x, i: F.when((i == 0) & x.startswith("("), F.regexp_replace(x, component, "")).otherwise(x),
            ).alias("body"),
            F.when(
                first.startswith("("), tx.blank_to_null(tx.strip(F.regexp_extract(first, component, 1)))
            ).alias("component"),
            tx.blank_to_null(
                F.regexp_replace(
                    last(
                        paras,
                        lambda p: (p["role"] == "w") & p["after"].isNotNull(),
                        lambda p: p["after"],
                    ),
                    r"(?U)^[:\-]\s*", "",
                )
            ).alias("workaround"),
            last(
                paras,
                lambda p: p["role"].isin("t", "f"),
                lambda p: F.when(p["role"] == "t", p["tt"]).otherwise(p["text"]),
            ).alias("fix"),
        )

    def describe(t):
        prefix = r"(?iU)^Description\s+of\s+([A-Z]+-\d+)[\s:.\-]*"

        def unnamed(full):
            named = F.upper(F.regexp_extract(full, prefix, 1)) == t["bug_id"]
            rest = F.substring(full, F.length(F.regexp_extract(full, prefix, 0)) + 1, F.length(full))
            return F.when(named, tx.strip(rest)).otherwise(full)

        full = tx.collapse(F.concat_ws(" ", t["short"], F.array_join(t["body"], " ")))
        return F.struct(t.alias("t"), tx.let(full, unnamed).alias("text"))

    def finish(x):
        t = x["t"]
        own = F.struct(x["text"].alias("description"), t["fix"].alias("fix_info"))
        if not keep_empty:
            own = F.when(t["fix"].isNotNull(), own).otherwise(tx.split_fix_info(x["text"]))
        return tx.let(
            own,
            lambda found: F.struct(
                t["ord"].alias("ord"),
                t["bug_id"].alias("bug_id"),
                found["description"].alias("description"),
                t["workaround"].alias("workaround"),
                found["fix_info"].alias("fix_info"),
                F.when(t["component"].isNotNull(), F.array(t["component"])).alias("affected_components"),
            ),
        )

    named = F.filter(topics, lambda t: t["title"].rlike(id_pattern))
    texts = F.transform(F.transform(F.transform(named, sort_paras), read), describe)
    if not keep_empty:
        texts = F.filter(texts, lambda x: x["text"] != "")
    return F.transform(texts, finish)


def topic_pages(pages: DataFrame, **options) -> DataFrame:
    return explode_rows(pages, topic_issues(F.col("topics"), **options), *_PARTS)


def issue_pages(pages: DataFrame) -> DataFrame:
    """Tables first; topic blocks only on pages whose tables hold no valid identifier.

    The choice is a test on the page's own arrays, so both layouts come out of one
    pass over the corpus, without joining pages to the issues found on them.
    """
    rows = table_rows(F.col("tables"))
    has_issue = F.exists("_rows", lambda r: F.size(_valid_ids(r)) > 0)
    as_row = F.transform(
        topic_issues(F.col("topics")),
        lambda t: F.struct(
            t["ord"].alias("ord"),
            F.lit(0).alias("row_no"),
            t["bug_id"].alias("id"),
            F.array().cast("array<string>").alias("id_parts"),
            F.lit("").alias("text"),
            t.alias("topic"),
        ),
    )
    none = F.slice(as_row, 1, 0)
    as_raw = F.transform(
        F.col("_rows"),
        lambda r: F.struct(
            r["ord"], r["row_no"], r["id"], r["id_parts"], r["text"],
            F.get(none, F.lit(0))["topic"].alias("topic"),
        ),
    )
    kept = [c for c in pages.columns if c not in _PARTS]
    chosen = pages.withColumn("_rows", rows).select(
        *kept, F.explode(F.when(has_issue, as_raw).otherwise(as_row)).alias("_r")
    )
    issues = clean_rows(chosen.select(*kept, "_r.*"))

    def pick(name):
        return F.when(F.col("topic").isNull(), F.col(name)).otherwise(F.col(f"topic.{name}"))

    fields = ("description", "workaround", "fix_info", "affected_components")
    return issues.select(
        *kept, "ord", "row_no", "id_no", "bug_id", *[pick(f).alias(f) for f in fields]
    )


# --- ARIA tables ----------------------------------------------------------------------


def aria_issues(pages: DataFrame) -> DataFrame:
    """Issues of ``role=table`` layouts; rows without an identifier are features, not issues."""

    def layout(t):
        headers = F.transform(t["headers"], F.lower)
        first = F.transform(
            F.coalesce(F.try_element_at(t["rows"], F.lit(1)), F.array().cast("array<string>")),
            F.lower,
        )
        by_row = (
            (F.size(headers) == 0)
            & (F.size(first) > 0)
            & F.forall(first, lambda x: x.isin(fixed.ARIA_HEADER_WORDS))
        )
        return F.struct(
            t["ord"].alias("ord"),
            F.when(by_row, first).otherwise(headers).alias("headers"),
            F.when(by_row, F.slice(t["rows"], F.lit(2), F.size(t["rows"])))
            .otherwise(t["rows"])
            .alias("rows"),
        )

    def is_platform(h):
        return h.contains("platform")

    def is_issue(h):
        return ~is_platform(h) & (h.contains("issue") | h.contains("bug") | (h == "id"))

    def is_text(h):
        words = ["description", "limitation", "details", "summary"]
        return ~is_platform(h) & ~is_issue(h) & ux.contains_any(h, words)

    def columns(t):
        return F.struct(
            t["ord"].alias("ord"),
            t["rows"].alias("rows"),
            F.coalesce(_last_index(t["headers"], is_issue), F.lit(0)).alias("issue"),
            _last_index(t["headers"], is_text).alias("text"),
            _last_index(t["headers"], is_platform).alias("platform"),
        )

    def rows(t):
        return F.transform(
            F.filter(t["rows"], lambda r: F.size(r) > t["issue"]),
            lambda r, i: F.struct(
                t["ord"].alias("ord"),
                i.alias("row_no"),
                F.get(r, t["issue"]).alias("issue"),
                F.get(
                    r, F.coalesce(t["text"], F.when(F.size(r) > 1, F.size(r) - 1))
                ).alias("text"),
                F.get(r, t["platform"]).alias("platform"),
            ),
        )

    raw = F.flatten(F.transform(F.transform(F.transform(F.col("aria"), layout), columns), rows))
    out = explode_rows(pages, raw, *_PARTS)
    kept = [c for c in out.columns if c not in ("issue", "text", "platform")]
    return out.select(
        *kept,
        F.posexplode(tx.aria_row(F.col("issue"), F.col("text"), F.col("platform"))).alias(
            "id_no", "_i"
        ),
    ).select(*kept, "id_no", "_i.*")


# --- sections -------------------------------------------------------------------------


def last_mark(marks: Column, before: Column, test=None, after: Column | None = None) -> Column:
    """Last mark standing before a place in the document, null when there is none."""

    def fits(m):
        ok = m["ord"] < before
        if after is not None:
            ok = ok & (m["ord"] > after)
        return ok & test(m) if test is not None else ok

    return F.try_element_at(F.filter(marks, fits), F.lit(-1))


def _marks(tags, **fields) -> Column:
    """Headings of the given tags with what each of them says, computed once per heading."""
    return F.transform(
        F.filter("headings", lambda h: h["tag"].isin(*tags)),
        lambda h: F.struct(h["ord"], *[f(h).alias(name) for name, f in fields.items()]),
    )


def _sectioned(pages: DataFrame, marks: Column, rows, **context) -> DataFrame:
    """Raw rows of all tables with what the headings above their table say.

    ``context`` gives columns as functions of (marks, place in the document). They are worked out
    once for each table, in the page's row, so neither tables nor rows carry the marks.
    ``rows`` makes raw rows of an array of tables.
    """
    kept = [c for c in pages.columns if c not in _PARTS]
    with_context = tx.let(
        marks,
        lambda m: F.transform(
            "tables",
            lambda t: F.struct(
                t.alias("t"), F.struct(*[f(m, t["ord"]).alias(n) for n, f in context.items()]).alias("c")
            ),
        ),
    )
    tables = pages.select(*kept, F.explode(with_context).alias("_z")).select(*kept, "_z.t", "_z.c.*")
    return tables.select(*kept, *context, F.explode(rows(F.array("t"))).alias("_r")).select(
        *kept, *context, "_r.*"
    )


def _set(name):
    return lambda m: m[name].isNotNull()


def _found(pattern, field="fused"):
    return lambda h: tx.blank_to_null(F.regexp_extract(h[field], pattern, 1))


def _append(components: Column, extra: Column) -> Column:
    none = F.array().cast("array<string>")
    added = F.array_union(F.coalesce(components, none), F.array(extra))
    return F.when(extra.isNull(), components).otherwise(added)


_H234 = ("h2", "h3", "h4")


def sections_by_agent_version(pages: DataFrame, kind: Column) -> DataFrame:
    """Version headings, and date headings or paragraphs that hold until the next version."""
    version = _found(r"(?iU)(?:Autonomous\s+DEM\s+)?Agent\s+(\d+\.\d+)")

    def heading_version(h):
        return F.when(h["tag"] != "p", version(h))

    marks = _marks(
        (*_H234, "p"),
        version=heading_version,
        date=lambda h: F.when(heading_version(h).isNull(), tx.parse_date(h["fused"])),
    )
    def date(m, at):
        since = F.coalesce(last_mark(m, at, _set("version"))["ord"], F.lit(-1))
        return F.when(kind == "addressed", last_mark(m, at, _set("date"), since)["date"])

    rows = _sectioned(
        pages, marks, table_rows,
        version=lambda m, at: F.coalesce(
            last_mark(m, at, _set("version"))["version"], F.lit(fixed.VERSION_UNKNOWN)
        ),
        release_date=date,
    )
    return clean_rows(rows)


def sections_by_component(pages: DataFrame) -> DataFrame:
    """``<component> Known Issues`` headings; the component is added last if absent."""
    name = r"(?iUd)^(.*?)\s*Known\s*Issues?$"
    marks = _marks(_H234, component=lambda h: tx.blank_to_null(tx.strip(F.regexp_extract(h["fused"], name, 1))))
    rows = _sectioned(
        pages, marks, table_rows,
        _component=lambda m, at: last_mark(m, at, _set("component"))["component"],
    )
    issues = clean_rows(rows)
    return issues.withColumn(
        "affected_components", _append(F.col("affected_components"), F.col("_component"))
    ).drop("_component")


def constant_component(issues: DataFrame, name: str = fixed.MULTITENANT_COMPONENT) -> DataFrame:
    return issues.withColumn("affected_components", F.array(F.lit(name)))


def split_fused_id(raw: Column) -> Column:
    """``struct(bug_id, version, date)`` of a cell that fuses an id with one of the others."""
    with_version = r"^([A-Z]+-\d+)(\d{4}\.r\d+\.\d+)$"
    with_date = r"(?U)^([A-Z]+-\d+)([A-Z][a-z]+\s+\d{4})$"
    by_version = tx.blank_to_null(F.regexp_extract(raw, with_version, 1))
    return F.struct(
        F.coalesce(
            by_version,
            tx.blank_to_null(F.regexp_extract(raw, with_date, 1)),
            F.when(raw.rlike(fixed.BUG_ID_VALID), raw),
        ).alias("bug_id"),
        F.coalesce(
            tx.blank_to_null(F.regexp_extract(raw, with_version, 2)),
            F.lit(fixed.VERSION_UNKNOWN),
        ).alias("version"),
        F.when(by_version.isNull(), tx.parse_date(F.regexp_extract(raw, with_date, 2))).alias(
            "release_date"
        ),
    )


def fused_id_tables(pages: DataFrame) -> DataFrame:
    """Issues of header-less tables."""
    rows = explode_rows(pages, headerless_rows(F.col("tables")), *_PARTS)
    return clean_text(fused_id_rows(rows))


def fused_id_rows(rows: DataFrame) -> DataFrame:
    kept = [c for c in rows.columns if c not in ("id", "id_parts", "text")]
    return (
        rows.withColumn("_i", split_fused_id(F.col("id")))
        .filter("_i.bug_id is not null")
        .select(*kept, "text", "_i.bug_id", "_i.version", "_i.release_date")
    )


def sections_by_calendar_version(pages: DataFrame) -> DataFrame:
    """Version, date and keyword headings; a date heading makes the version unknown.

    Tables with a header take version, date and component from the headings above
    them; header-less tables carry all that in the id cell.
    """
    version = _found(r"(\d{4}\.r\d+\.\d+)")

    def date(h):
        return F.when(version(h).isNull(), tx.parse_date(h["fused"]))

    def component(h):
        low = F.lower(h["fused"])
        first = F.coalesce(
            *[F.when(low.contains(c.lower()), F.lit(c)) for c in fixed.SECTION_COMPONENTS]
        )
        return F.when(version(h).isNull() & date(h).isNull(), first)

    marks = _marks(_H234, version=version, date=date, component=component)

    def shaped(rows, bare):
        return F.transform(
            rows,
            lambda r: F.struct(
                r["ord"], r["row_no"], r["id"], r["id_parts"], r["text"], F.lit(bare).alias("bare")
            ),
        )

    def both_shapes(tables):
        bare, headed = shaped(headerless_rows(tables), True), shaped(table_rows(tables), False)
        # A header-less table is read by its header-row fallback only if no row of it is fused.
        taken = F.exists(bare, lambda r: split_fused_id(r["id"])["bug_id"].isNotNull())
        return F.when(taken, bare).otherwise(F.concat(bare, headed))

    def since(m, at):
        return F.coalesce(last_mark(m, at, _set("version"))["ord"], F.lit(-1))

    def date_above(m, at):
        return last_mark(m, at, _set("date"), since(m, at))["date"]

    rows = _sectioned(
        pages, marks, both_shapes,
        _d=date_above,
        _component=lambda m, at: last_mark(m, at, _set("component"), since(m, at))["component"],
        _version=lambda m, at: F.when(
            date_above(m, at).isNull(), last_mark(m, at, _set("version"))["version"]
        ),
    )
    # One pass for both shapes: the id rules differ, the text rules do not.
    fused = split_fused_id(F.col("id"))
    as_bare = F.array(F.struct(fused["bug_id"].alias("bug_id"), F.lit(None).cast("string").alias("fix_info")))
    ids = F.when(F.col("bare"), F.filter(as_bare, lambda i: i["bug_id"].isNotNull())).otherwise(
        _valid_ids(F.struct("id", "id_parts"))
    )
    kept = [c for c in rows.columns if c not in ("id", "id_parts", "text")]
    one = rows.withColumn("_fused", fused).select(
        *kept, "_fused", "text", F.posexplode(ids).alias("id_no", "_i")
    )
    one = one.select(*kept, "_fused", "text", "id_no", "_i.bug_id", "_i.fix_info")
    issues = clean_text(one, F.col("fix_info"))
    return issues.select(
        *[c for c in issues.columns if c not in ("_fused", "_d", "_component", "_version", "bare", "affected_components")],
        F.when(F.col("bare"), F.col("affected_components"))
        .otherwise(_append(F.col("affected_components"), F.col("_component")))
        .alias("affected_components"),
        F.when(F.col("bare"), F.col("_fused.version"))
        .otherwise(F.coalesce(F.col("_version"), F.lit(fixed.VERSION_UNKNOWN)))
        .alias("version"),
        F.when(F.col("bare"), F.col("_fused.release_date"))
        .otherwise(F.col("_d"))
        .alias("release_date"),
    )


def with_feature(components: Column, feature: Column) -> Column:
    """Feature put in front of the components."""
    none = F.array().cast("array<string>")
    return F.when(feature.isNull(), components).otherwise(
        F.concat(F.array(feature), F.coalesce(components, none))
    )


def feature_tables(pages: DataFrame, feature: Column) -> DataFrame:
    """Tables with a ``th`` header, every issue labelled with a feature."""
    rows = explode_rows(
        pages.withColumn("_feature", feature), table_rows(F.col("tables"), td_headers=False), *_PARTS
    )
    return clean_rows(rows).withColumn(
        "affected_components", with_feature(F.col("affected_components"), F.col("_feature"))
    ).drop("_feature")


def sections_by_feature(pages: DataFrame) -> DataFrame:
    """The last heading that is not a mere page title names the feature."""

    def feature(h):
        low = F.lower(h["fused"])
        skip = reduce(lambda a, b: a | b, [low.contains(s) for s in fixed.FEATURE_HEADING_SKIPS])
        return F.when((h["fused"] != "") & ~skip, h["fused"])

    marks = _marks(_H234, feature=feature)
    rows = _sectioned(
        pages, marks, lambda tables: table_rows(tables, td_headers=False),
        _feature=lambda m, at: last_mark(m, at, _set("feature"))["feature"],
    )
    return clean_rows(rows).withColumn(
        "affected_components", with_feature(F.col("affected_components"), F.col("_feature"))
    ).drop("_feature")


def sections_by_index_version(pages: DataFrame) -> DataFrame:
    """Index page: the nearest heading must name a version, or its tables are left out."""
    version = _found(r"(?U)Prisma Access Agent\s+(\d+\.\d+(?:\.\d+)?)", "spaced")
    marks = _marks(("h2", "h3"), version=version)
    rows = _sectioned(
        pages, marks, table_rows, version=lambda m, at: last_mark(m, at)["version"]
    )
    return clean_rows(rows.filter("version is not null"))


def sections_by_version_and_kind(pages: DataFrame, url: Column) -> DataFrame:
    """Version and kind from headings, seeded from the URL.

    A heading that names only a kind speaks about the page's own version.
    """
    version = _found(r"(?iU)TS\s*Agent\s+(\d+\.\d+(?:\.\d+)?)", "spaced")

    def kind(h):
        low = F.lower(h["spaced"])
        return F.when(low.contains("known") & ~low.contains("addressed"), "known").when(
            low.contains("addressed") | low.contains("fixed"), "addressed"
        )

    def resets(h):
        return version(h).isNotNull() | kind(h).isNotNull()

    marks = _marks(("h1", *_H234), version=version, kind=kind, resets=resets)
    rows = _sectioned(
        pages, marks, table_rows,
        version=lambda m, at: F.coalesce(
            last_mark(m, at, lambda x: x["resets"])["version"], ux.tree_major(url)
        ),
        issue_type=lambda m, at: F.coalesce(
            last_mark(m, at, _set("kind"))["kind"], ux.default_kind(url)
        ),
    )
    return clean_rows(rows)


def fix_versions(fix_info: Column) -> Column:
    """Distinct plugin versions of a fix text, in order; majors from 8 are the host's own."""
    found = F.regexp_extract_all(
        F.coalesce(fix_info, F.lit("")), F.lit(r"(\d+\.\d+(?:\.\d+)?(?:-[a-zA-Z0-9]+)?)"), 1
    )
    return F.filter(
        F.array_distinct(found),
        lambda v: F.regexp_extract(v, r"^(\d+)\.", 1).try_cast("bigint") < 8,
    )


def fix_version_fanout(known: DataFrame, kind: Column | None = None) -> DataFrame:
    """Known issues plus one addressed row per fix version, from one pass over the input.

    With ``kind`` rows of other kinds stay as they are.
    """
    kind = F.lit("known") if kind is None else kind
    fixes = F.transform(
        fix_versions(F.col("fix_info")),
        lambda v: F.struct(
            v.alias("version"),
            F.lit("addressed").alias("issue_type"),
            F.concat(F.lit("Plugin "), v).alias("fix_info"),
        ),
    )
    own = F.array(
        F.struct(
            F.col("version").alias("version"),
            kind.alias("issue_type"),
            F.col("fix_info").alias("fix_info"),
        )
    )
    fixes = F.when(kind == "known", fixes).otherwise(F.slice(fixes, 1, 0))
    kept = [c for c in known.columns if c not in ("version", "issue_type", "fix_info")]
    return known.select(
        *kept, F.posexplode(F.concat(own, fixes)).alias("fan_no", "_f")
    ).select(*kept, "fan_no", "_f.*")
