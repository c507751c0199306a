"""Text clean-up of issue rows, as Column -> Column functions.

White space is spelt out as a character class because release notes are full of
no-break spaces: Java's ``\\s`` only knows ASCII, and its Unicode mode is several
times slower.  Functions that split a text in two return a struct, so that callers
read both halves off one column.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from fixatlas import fixed


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used.

    Chained text rules refer to their input many times; written out, each step would
    multiply the regular expressions of the step before.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


# Characters that count as white space.
_SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The same as ranges: a class is tried member by member for a letter that isn't in it.
_S = "[\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def strip(c: Column) -> Column:
    """Trim every kind of Unicode white space, not only the space character."""
    return F.trim(c, F.lit(_SPACES))


# All white space but the space itself, and as many spaces.
_OTHER = _SPACES.replace(" ", "")
_PLAIN = " " * len(_OTHER)


# Visible ASCII and spaces only.
_PRINTED = r"\A[ -~]*+\z"


def collapse(c: Column) -> Column:
    """One space for every run of white space, ends trimmed.

    A text of visible ASCII and spaces is left as it is if its spaces stand singly between words, and
    loses only spaces if they don't. In others every kind becomes a plain space first: a pattern of
    one letter scans a text four times as fast as one with the class of all kinds (2.5 and 11 s for
    25 million characters).
    """

    def collapsed(text):
        def plain(x):
            return F.trim(F.regexp_replace(x, " {2,}", " "))

        ends = text.startswith(" ") | text.endswith(" ")
        return (
            F.when(~text.rlike(_PRINTED), plain(F.translate(text, _OTHER, _PLAIN)))
            .when(text.contains("  "), plain(text))
            .when(ends, F.trim(text))
            .otherwise(text)
        )

    return let(c, collapsed)


def says_any(text: Column, phrases) -> Column:
    """Whether the lower-cased text contains one of the lower-case ASCII phrases.

    The text itself isn't lower-cased. Beside ASCII letters only the Kelvin sign and, where a phrase ends
    with it, the dotted I have an ASCII letter in lower case.
    """
    return text.rlike(
        "(?i)" + "|".join(re.sub("i$", "[i\u0130]", re.escape(p).replace("k", "[k\u212a]")) for p in phrases)
    )


def _cut(around: Column) -> Column:
    """What is left of a text once the middle has been taken out."""
    return collapse(F.array_join(around, " "))


# A word starts where no letter, digit or underscore stands before it. Its first letter is tried
# before that: most places of a text fail on it at once.
_WORKAROUND = (
    rf"(?is)[wW](?<![\p{{L}}\p{{N}}_]w)orkaround{_S}*:{_S}*(.+?)(?=\n(?:[A-Z][a-z]+{_S}*:|$)|$)"
)
_FIX_SENTENCE = (
    rf"(?id)[tT](?<![\p{{L}}\p{{N}}_]t)his{_S}+issue{_S}+is{_S}+resolved{_S}+in{_S}+(.+?)(?:\.(?:{_S}|$)|$)"
)
_FIX_WHOLE = rf"(?id)^This{_S}+issue{_S}+is{_S}+resolved{_S}+in{_S}+(.+?)\.?$"


# Fixed value: a character of private use, put around what a match captures.
_MARK = "\ue000"


def _marked(text: Column, pattern: str) -> Column:
    """A text cut before and after what each match captures, in up to four pieces."""
    return F.split(F.regexp_replace(text, pattern, f"{_MARK}$1{_MARK}"), _MARK, 4)


def _pieces(text: Column, marked: Column, pattern: str) -> Column:
    """What stands before the first match, what it captures and what stands after it; null without a match.

    The marks of one search cut the text. A text that holds the mark itself, or in which the
    pattern matches more than once, is searched once for each piece.
    """
    whole = f"(?s:^(.*?)){pattern}"
    after = F.substring(text, F.length(F.regexp_extract(text, whole, 0)) + 1, F.length(text))
    searched = F.array(F.regexp_extract(text, whole, 1), F.regexp_extract(text, whole, 2), after)
    return F.when(text.contains(_MARK) | (F.size(marked) > 3), searched).when(F.size(marked) == 3, marked)


def _cut_at(text: Column, pattern: str) -> Column:
    return let(_marked(text, pattern), lambda m: _pieces(text, m, pattern))


def _may_hold_workaround(text: Column) -> Column:
    """A colon follows the word; looking for one costs a tenth of a search for the word."""
    return text.contains(":") & text.rlike("(?i)workaround")


def _has_pair(text: Column, pair: str) -> Column:
    """Whether two letters stand side by side, in either case each."""
    a, b = pair
    forms = [x + y for x in (a, a.upper()) for y in (b, b.upper())]
    return reduce(lambda p, q: p | q, [text.contains(f) for f in forms])


def _may_hold_fix(text: Column) -> Column:
    """Two letters of the word rule out most texts without a search."""
    return _has_pair(text, "lv") & text.rlike("(?i)resolved")


def split_workaround(description: Column) -> Column:
    """``struct(description, workaround)``; the text is untouched when there is none."""

    def unchanged(text):
        return F.struct(text.alias("description"), F.lit(None).cast("string").alias("workaround"))

    def rebuild(text):
        def parts(p):
            return F.struct(
                _cut(F.array(p[0], p[2])).alias("description"),
                blank_to_null(collapse(p[1])).alias("workaround"),
            )

        return let(
            let(_cut_at(text, _WORKAROUND), parts),
            lambda w: F.when(w["workaround"].isNotNull(), w).otherwise(unchanged(text)),
        )

    return let(
        description,
        lambda text: F.when(_may_hold_workaround(text), rebuild(text)).otherwise(unchanged(text)),
    )


def _reworded(known: Column) -> Column:
    plain = blank_to_null(strip(F.regexp_extract(strip(known), _FIX_WHOLE, 1)))
    return F.coalesce(F.concat(F.lit("Resolved in "), plain), known)


def _found_fix(pieces: Column) -> Column:
    return F.when(pieces[1] != "", F.concat(F.lit("Resolved in "), strip(pieces[1])))


def split_fix_info(description: Column, known_fix: Column | None = None) -> Column:
    """``struct(description, fix_info)``.

    A fix text that is already known is only reworded and keeps the description
    whole; a sentence is only cut out when some description is left.
    """
    null = F.lit(None).cast("string")

    def result(text, fix):
        return F.struct(text.alias("description"), fix.alias("fix_info"))

    def rebuild(text):
        def parts(p):
            return result(_cut(F.array(p[0], p[2])), _found_fix(p))

        return let(
            let(_cut_at(text, _FIX_SENTENCE), parts),
            lambda f: F.when(f["fix_info"].isNotNull() & (f["description"] != ""), f).otherwise(
                result(text, null)
            ),
        )

    def choose(x):
        text, known = x["text"], blank_to_null(x["known"])
        return (
            F.when(known.isNotNull(), result(text, _reworded(known)))
            .when(_may_hold_fix(text), rebuild(text))
            .otherwise(result(text, null))
        )

    known = null if known_fix is None else known_fix
    return let(F.struct(description.alias("text"), known.alias("known")), choose)


_ID_AND_TAIL = r"(?d)^([A-Z]+-\d+)(.*)$"


def split_bug_id(raw: Column) -> Column:
    """``struct(bug_id, fix_info)`` of a cell such as ``EPM-4616Resolved in 25.3``."""
    text = strip(raw)
    return F.struct(
        F.coalesce(blank_to_null(F.regexp_extract(text, _ID_AND_TAIL, 1)), raw).alias("bug_id"),
        blank_to_null(strip(F.regexp_extract(text, _ID_AND_TAIL, 2))).alias("fix_info"),
    )


_LEADING_GROUPS = rf"^((?:\([^)]++\){_S}*+)++)"


def _group_names(head: Column) -> Column:
    names = F.transform(F.regexp_extract_all(head, F.lit(r"\(([^)]++)\)"), 1), strip)
    return F.array_remove(names, "")


def _behind(text: Column, head: Column) -> Column:
    return strip(F.substring(text, F.length(head) + 1, F.length(text)))


def split_components(description: Column) -> Column:
    """``struct(description, affected_components)`` peeling leading ``(...)`` groups."""

    def result(text, names):
        return F.struct(text.alias("description"), names.alias("affected_components"))

    def peel(text):
        """Groups at the start of a stripped text."""
        head = F.regexp_extract(text, _LEADING_GROUPS, 1)
        return let(
            F.struct(text.alias("text"), head.alias("head")),
            lambda x: result(_behind(x["text"], x["head"]), _group_names(x["head"])),
        )

    def choose(text):
        unchanged = result(text, F.lit(None).cast("array<string>"))

        def peeled(stripped):
            return F.when(
                stripped.startswith("("),
                let(peel(stripped), lambda c: F.when(F.size(c["affected_components"]) > 0, c).otherwise(unchanged)),
            ).otherwise(unchanged)

        return F.when(text.contains("("), let(strip(text), peeled)).otherwise(unchanged)

    return let(description, choose)


def split_ids(text: Column) -> Column:
    """All identifiers of a cell when nothing but connectors is left beside them.

    All or nothing: otherwise the whole text comes back as the only element.
    """
    def choose(x):
        residue = F.regexp_replace(x["text"], fixed.BUG_ID_SPLIT, "")
        several = (F.size(x["ids"]) >= 2) & residue.rlike(f"^(?:{_S}|[,/]|and)*$")
        return F.when(several, x["ids"]).otherwise(F.array(x["text"]))

    ids = F.regexp_extract_all(text, F.lit(f"({fixed.BUG_ID_SPLIT})"), 1)
    return let(F.struct(text.alias("text"), ids.alias("ids")), choose)


def split_id_cell(fused: Column, parts: Column) -> Column:
    """Identifiers of a table cell: by its paragraphs if they all are ids, else as one text."""
    by_part = F.flatten(F.transform(F.filter(parts, lambda p: p != ""), split_ids))

    def choose(found):
        good = (F.size(found) > 1) & F.forall(
            found, lambda i: i.rlike(f"^{fixed.BUG_ID_SPLIT}$")
        )
        return F.when(good, found).otherwise(split_ids(fused))

    return let(by_part, choose)


def month_number(name: Column) -> Column:
    months = F.create_map(
        *[F.lit(x) for i, m in enumerate(fixed.MONTHS, 1) for x in (m, f"{i:02d}")]
    )
    return F.try_element_at(months, F.lower(name))


def parse_date(raw: Column) -> Column:
    """``Month D, YYYY`` / ``Month YYYY`` / ISO to ``YYYY-MM-DD`` text, else null.

    No calendar check: "February 31, 2024" is a date heading like any other.
    """
    text = strip(raw)
    day_first = r"(?U)^([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})$"
    month_only = r"(?U)^([A-Za-z]+)\s+(\d{4})$"

    def part(pattern, group):
        return F.regexp_extract(text, pattern, group)

    return F.coalesce(
        F.concat(
            part(day_first, 3), F.lit("-"), month_number(part(day_first, 1)), F.lit("-"),
            F.lpad(part(day_first, 2), 2, "0"),
        ),
        F.concat(part(month_only, 2), F.lit("-"), month_number(part(month_only, 1)), F.lit("-01")),
        F.when(text.rlike(r"(?U)^\d{4}-\d{2}-\d{2}$"), text),
    )


_DASHES = "‑–—"


def _platform_name(text: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in fixed.PLATFORMS for x in pair])
    return F.try_element_at(known, F.lower(strip(text)))


def aria_row(issue: Column, description: Column, platform: Column) -> Column:
    """One row of an ARIA table as an array of issue structs, empty without an id."""

    def cells(raw):
        tagged = F.filter(
            F.transform(F.regexp_extract_all(raw, F.lit(r"\(([^)]*)\)"), 1), _platform_name),
            lambda p: p.isNotNull(),
        )
        listed = F.transform(
            F.filter(
                F.transform(F.split(F.coalesce(platform, F.lit("")), ","), strip),
                lambda p: ~F.lower(p).isin(fixed.NON_PLATFORMS),
            ),
            lambda p: F.coalesce(_platform_name(p), p),
        )
        return F.struct(
            F.regexp_replace(raw, r"\([^)]*\)", " ").alias("plain"),
            F.array_union(tagged, listed).alias("components"),
            collapse(F.coalesce(description, F.lit(""))).alias("text"),
        )

    def read(c):
        tail = F.regexp_extract(c["plain"], rf"(?s)^.*{fixed.BUG_ID_ARIA}(.*?)$", 1)
        return F.struct(
            F.regexp_extract_all(c["plain"], F.lit(f"({fixed.BUG_ID_ARIA})"), 1).alias("ids"),
            F.regexp_replace(collapse(tail), r"^[ ,;:.\-]+|[ ,;:.\-]+$", "").alias("tail"),
            split_workaround(c["text"]).alias("cleaned"),
            c["text"].alias("text"),
            F.when(F.size(c["components"]) > 0, c["components"]).alias("components"),
        )

    def fan_out(r):
        return F.transform(
            r["ids"],
            lambda i: F.struct(
                i.alias("bug_id"),
                F.coalesce(blank_to_null(r["cleaned"]["description"]), r["text"]).alias(
                    "description"
                ),
                r["cleaned"]["workaround"].alias("workaround"),
                F.when(r["tail"].rlike("[A-Za-z]{3}"), r["tail"]).alias("fix_info"),
                r["components"].alias("affected_components"),
            ),
        )

    return let(let(let(F.translate(issue, _DASHES, "---"), cells), read), fan_out)


def show_fix_info(fix_info: Column) -> Column:
    """Whether a fix text says more than the fix badge does."""
    lowered = F.lower(fix_info)
    redundant = reduce(
        lambda a, b: a | b, [lowered.contains(p) for p in fixed.REDUNDANT_FIX_PHRASES]
    )
    return F.coalesce((fix_info != "") & ~redundant, F.lit(False))


def html_escape(text: Column) -> Column:
    escaped = F.coalesce(text, F.lit(""))
    for char, entity in fixed.HTML_ESCAPES:
        escaped = F.replace(escaped, F.lit(char), F.lit(entity))
    return escaped


def is_hidden_version(version: Column) -> Column:
    return version.isin(fixed.HIDDEN_VERSIONS)


def display_label(product_name: Column, version: Column) -> Column:
    return F.when(is_hidden_version(version), product_name).otherwise(
        F.concat_ws(" ", product_name, version)
    )


def generated_date(raw: Column) -> Column:
    """Date part of a timestamp text, ``-`` when it cannot be read, null when absent."""
    return F.when(
        raw.isNotNull() & (raw != ""),
        F.coalesce(F.date_format(F.try_to_timestamp(raw), "yyyy-MM-dd"), F.lit("-")),
    )
