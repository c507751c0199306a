"""Text rules of issues: each text is cut and collapsed once."""

import contextlib
import io

from pyspark.sql import functions as F

from fixatlas.functions import text as tx
from fixatlas.operators import extract
from fixatlas.sources.pages import DOCUMENT_PARTS


def test_a_topic_is_collapsed_and_cut_once(spark):
    topics = spark.createDataFrame([], "url string, topics " + DOCUMENT_PARTS["topics"])
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        extract.topic_pages(topics).explain("extended")
    plan = out.getvalue().split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    # One for the topic's text; two for the fix sentence, before and after it is cut out.
    assert plan.count("translate(") <= 2 and plan.count("lower(") == 0


def test_phrases_are_found_as_in_lower_case(apply):
    texts = ["THIS Issue is Fixed", "worKaround", "fi", "Fİ", "İx", "none", None]
    words = ["issue is fixed", "workaround", "fi"]
    lowered = apply(lambda c: F.lower(c).contains(words[0]) | F.lower(c).contains(words[1]) | F.lower(c).contains(words[2]), texts)
    assert apply(lambda c: tx.says_any(c, words), texts) == lowered


def test_cut_of_texts_with_marks_or_several_matches(apply):
    texts = ["a Workaround: b\nNote: c\nWorkaround: d", "x y Workaround: z", "a:b", "  a   b  ", "a  b"]
    got = [(r.description, r.workaround) for r in apply(tx.split_workaround, texts)]
    assert got == [
        ("a Note: c Workaround: d", "b"), ("x y", "z"), ("a:b", None), ("  a   b  ", None), ("a  b", None),
    ]
    assert apply(tx.collapse, ["  a   b  ", "a  b", " a", "a\tb", "", None]) == ["a b", "a b", "a", "a b", "", None]
    parts = apply(tx.split_components, ["( a\xa0) (b)　( )x", "(a", "x (a)", " (a)"])
    assert [(r.description, r.affected_components) for r in parts] == [
        ("x", ["a", "b"]), ("(a", None), ("x (a)", None), ("", ["a"]),
    ]
