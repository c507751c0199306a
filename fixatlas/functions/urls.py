"""What a URL says about product, version and kind of page (Column -> Column).

Marker tables become chains of ``contains``, so classifying an inventory is a
single narrow projection inside whole-stage codegen: no join, no loop over rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from fixatlas import fixed
from fixatlas.functions.text import blank_to_null, let


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def product_of(url: Column, prefixes=None) -> Column:
    """Product of the longest fragment contained in the URL; the first declared wins a tie."""
    by_length = sorted(prefixes or fixed.PRODUCT_PREFIXES, key=lambda p: -len(p[1]))

    def first_match(low):
        return F.coalesce(*[F.when(low.contains(p.lower()), F.lit(pid)) for pid, p in by_length])

    return let(F.lower(url), first_match)


def is_issue_page(url: Column) -> Column:
    return contains_any(F.lower(url), fixed.ISSUE_MARKERS)


def major_slug(url: Column) -> Column:
    return blank_to_null(F.regexp_extract(url, r"/(\d+-\d+)(?:[/-]|$)", 1))


def _rightmost(url: Column, pattern: str) -> Column:
    return F.try_element_at(F.regexp_extract_all(url, F.lit(pattern), 1), F.lit(-1))


def _with_suffix(base: Column, suffix: Column, excluded: list[str]) -> Column:
    keep = (suffix != "") & ~F.lower(suffix).isin(excluded)
    return F.concat(base, F.when(keep, F.concat(F.lit("-"), suffix)).otherwise(""))


def dotted_version(url: Column) -> Column:
    """Version in a URL: dashed triple, ``NNN``, ``/X-Y/`` or ``X-Y-known-issues``.

    The rightmost of the first shape present counts, because file names end with
    the version; two-part shapes are read as ``X.Y.0``.
    """
    triple = _rightmost(url, r"(\d+-\d+-\d+(?:-[a-zA-Z0-9]+)?)")
    numbers = F.replace(F.regexp_extract(triple, r"^(\d+-\d+-\d+)", 1), F.lit("-"), F.lit("."))
    suffix = F.regexp_extract(triple, r"^\d+-\d+-\d+-([a-zA-Z0-9]+)$", 1)
    run = _rightmost(url, r"(?<!\d)(\d\d\d)(?!\d)")
    pair = _rightmost(url, r"/(\d+-\d+)/")
    marked = blank_to_null(
        F.regexp_extract(url, r"(?<!\d)(\d+-\d+)-(?:known|addressed|fixed)-issues?\b", 1)
    )

    def dotted(x):
        return F.concat(F.replace(x, F.lit("-"), F.lit(".")), F.lit(".0"))

    return F.coalesce(
        _with_suffix(numbers, suffix, fixed.SLUG_NON_SUFFIXES),
        F.when(
            run.isNotNull(),
            F.concat_ws(".", F.substring(run, 1, 1), F.substring(run, 2, 1), F.substring(run, 3, 1)),
        ),
        dotted(pair),
        dotted(marked),
    )


def first_version(text: Column, separator: str = ".") -> Column:
    """First version triple of a text (``.``) or a link (``-``), suffix included."""
    sep = r"\." if separator == "." else separator
    pattern = rf"(\d+{sep}\d+{sep}\d+)(?:-([a-zA-Z0-9]+))?"
    base = blank_to_null(F.regexp_extract(text, pattern, 1))
    if separator != ".":
        base = F.replace(base, F.lit(separator), F.lit("."))
    return _with_suffix(base, F.regexp_extract(text, pattern, 2), fixed.TEXT_NON_SUFFIXES)


def strip_prefix(c: Column, prefix: str) -> Column:
    return F.when(c.startswith(prefix), F.substring(c, len(prefix) + 1, 1 << 30)).otherwise(c)


def strip_html(c: Column) -> Column:
    return F.regexp_replace(c, r"\.html\z", "")


def relative_path(url: Column, host: str = fixed.DOCS_HOST) -> Column:
    return strip_html(strip_prefix(url, host))


def absolute_url(path: Column, host: str = fixed.DOCS_HOST) -> Column:
    return (
        F.when(path.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://"), path)
        .when(path.startswith("//"), F.concat(F.lit("https:"), path))
        .when(path.startswith("/"), F.concat(F.lit(host), path))
        .otherwise(F.concat(F.lit(host + "/"), path))
    )


def last_segment(url: Column, ignore_trailing_slash: bool = False) -> Column:
    if ignore_trailing_slash:
        url = F.regexp_replace(url, "/+$", "")
    return F.lower(F.element_at(F.split(url, "/"), -1))


def _kinds(text: Column, addressed: Column) -> Column:
    known, fixed_ = F.lit("known"), F.lit("addressed")
    return (
        F.when(text.contains("known-and-addressed"), F.array(known, fixed_))
        .when(text.contains("known") & ~text.contains("addressed"), F.array(known))
        .when(addressed, F.array(fixed_))
        .otherwise(F.array().cast("array<string>"))
    )


def page_kinds(url: Column) -> Column:
    """Issue kinds a page holds, by its last path segment: none, one or both."""
    seg = last_segment(url)
    return _kinds(
        seg, (seg.contains("addressed") & ~seg.contains("known")) | seg.contains("fixed")
    )


def page_kinds_anywhere(url: Column) -> Column:
    """Same for services without versions, by the whole URL."""
    low = F.lower(url)
    return _kinds(low, low.contains("addressed") | low.contains("fixed"))


def page_kind_loose(url: Column) -> Column:
    """``known`` before ``addressed``, anywhere in the URL, else null."""
    low = F.lower(url)
    return F.when(low.contains("known"), "known").when(low.contains("addressed"), "addressed")


def is_landing(url: Column) -> Column:
    return last_segment(url).contains("known-and-addressed")


def is_specific(url: Column, kind: Column) -> Column:
    """A page of its own for the kind, beside which a combined landing page is redundant."""
    seg = last_segment(url)
    return F.when(
        kind == "known", seg.contains("known-issues") & ~seg.contains("addressed")
    ).otherwise(seg.contains("addressed-issues") & ~seg.contains("known"))


def plugin_version(href: Column, slugs: list[str]) -> Column:
    """Version after the last occurrence of a slug; hotfix dropped, two parts read as ``.0``."""
    return let(F.lower(href), lambda low: F.coalesce(*[_after_slug(low, F.lit(s)) for s in slugs]))


def plugin_version_by(href: Column, slugs: Column) -> Column:
    """``plugin_version`` with the slugs as an array column, tried in their order."""
    found = let(F.lower(href), lambda low: F.transform(slugs, lambda s: _after_slug(low, s)))
    return F.get(F.array_compact(found), F.lit(0))


def _after_slug(low: Column, slug: Column) -> Column:
    tail = r"(?:[/-]|$|\.html)"
    text = F.when(F.contains(low, slug), F.element_at(F.split(low, slug), -1))

    def join(pattern, n, end=""):
        groups = [F.regexp_extract(text, pattern, i) for i in range(1, n + 1)]
        return F.when(text.rlike(pattern), F.concat(F.concat_ws(".", *groups), F.lit(end)))

    return F.coalesce(
        join(rf"^(\d+)-(\d+)-(\d+)(?:-h\d+)?{tail}", 3),
        join(rf"^(\d)(\d)(\d){tail}", 3),
        join(rf"^(\d)-?(\d){tail}", 2, ".0"),
    )


def run_version(url: Column) -> Column:
    """``...-plugin-602`` to ``6.0.2``; patch digits are one number (``3010`` is ``3.0.10``)."""
    pattern = r"enterprise-dlp-plugin-(\d)(\d)(\d*)$"
    patch = F.regexp_extract(url, pattern, 3).try_cast("bigint").cast("string")
    return F.when(
        url.rlike(pattern),
        F.concat_ws(".", F.regexp_extract(url, pattern, 1), F.regexp_extract(url, pattern, 2), patch),
    )


def addressed_year(url: Column) -> Column:
    return blank_to_null(F.regexp_extract(url, r"addressed-issues-in-(20\d{2})$", 1))


def year_slug(url: Column) -> Column:
    return blank_to_null(F.regexp_extract(url, r"-in-(20\d{2})(?:[/-]|$)", 1))


def year_page_kind(url: Column) -> Column:
    low = F.lower(url)
    return F.when(low.contains("known-issues") & ~low.contains("addressed"), "known").when(
        low.contains("addressed-issues"), "addressed"
    )


def space_path(sitemap_url: Column) -> Column:
    """Path of a documentation space out of the URL of its page sitemap."""
    path = F.regexp_replace(F.regexp_replace(sitemap_url, r"^.*?://", ""), r"^[^/]*/?", "")
    return F.regexp_replace(F.regexp_replace(path, r"sitemap-pages\.xml$", ""), r"^/+|/+$", "")


def is_release_space(path: Column) -> Column:
    return (path != "") & path.rlike(fixed.SPACE_PATTERN)


def _edition(number: Column, ce: Column) -> Column:
    return F.when(number != "", F.concat(number, F.when(ce != "", "-CE").otherwise("")))


def space_version(path: Column, title: Column) -> Column:
    """Version named by the space path (``8.3ce``), else by the title of its root page."""
    segment = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    segment = F.regexp_replace(segment, r"(?i)-eol$", "")
    in_path = r"(?i)^(\d+\.\d+)(-?ce)?$"
    in_title = r"(?iU)Agent\s+(\d+\.\d+)(\s*-?\s*CE)?\b"
    return F.coalesce(
        _edition(F.regexp_extract(segment, in_path, 1), F.regexp_extract(segment, in_path, 2)),
        _edition(F.regexp_extract(title, in_title, 1), F.regexp_extract(title, in_title, 2)),
    )


def tree_major(url: Column) -> Column:
    """Major of a combined page: its own trailing slug before the tree it is filed under."""
    def pair(pattern):
        a, b = F.regexp_extract(url, pattern, 1), F.regexp_extract(url, pattern, 2)
        return F.when(a != "", F.concat_ws(".", a, b))

    return F.coalesce(
        pair(r"release-information-(\d+)-(\d+)$"), pair(r"/pan-os/(\d+)-(\d+)/"), F.lit("")
    )


def default_kind(url: Column) -> Column:
    low = F.lower(url)
    return F.when(low.contains("addressed") | low.contains("fixed"), "addressed").otherwise("known")


def known_issues_path(major: Column, template: str = fixed.SDWAN_KNOWN_TEMPLATE) -> Column:
    """Page address built from a major: ``3-4`` becomes slug ``340``."""
    return F.format_string(template, F.concat(F.replace(major, F.lit("-"), F.lit("")), F.lit("0")))


def link_path(href: Column, root: str = fixed.LOCALE_ROOT) -> Column:
    """Harvested link to site path: leading slash, no locale root, no ``.html``."""
    rooted = F.when(href.startswith("/"), href).otherwise(F.concat(F.lit("/"), href))
    return strip_html(strip_prefix(rooted, root))


def is_scoped_tree_page(url: Column) -> Column:
    low = F.lower(url)
    return low.contains(fixed.TS_TREE_MARKER) & contains_any(low, fixed.TS_PAGE_MARKERS)


def is_out_of_scope(url: Column) -> Column:
    return contains_any(F.lower(url), fixed.DLP_OUT_OF_SCOPE)
