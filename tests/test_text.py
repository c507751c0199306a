from pyspark.sql import functions as F

from fixatlas.functions import text as tx


def pairs(rows):
    return [tuple(r) for r in rows]


def test_workaround(apply):
    got = pairs(apply(tx.split_workaround, [
        "Fails to load. Workaround: restart it.",
        "WORKAROUND :restart",
        "Fails.  Workaround:  do this\nNote: and that",
        "Fails.\nWorkaround: step one\nstep two",
        "No remedy known",
        "Fails. Workaround: ",
        "Two. Workaround: a. Workaround: b",
        "",
        None,
        "\U0001f600\U0001f600 Fails. Workaround: smile",
    ]))
    assert got == [
        ("Fails to load.", "restart it."),
        ("", "restart"),
        ("Fails. Note: and that", "do this"),
        ("Fails.", "step one step two"),
        ("No remedy known", None),
        ("Fails. Workaround: ", None),
        ("Two.", "a. Workaround: b"),
        ("", None),
        (None, None),
        ("\U0001f600\U0001f600 Fails.", "smile"),
    ]


def test_fix_info(apply):
    got = pairs(apply(tx.split_fix_info, [
        "Drops. This issue is resolved in Box 7.2.1. More text.",
        "Drops. this  issue is resolved in 7.9.2",
        "This issue is resolved in 7.9.2.",
        "Drops. This issue is resolved in A. This issue is resolved in B.",
        "Nothing here",
    ]))
    assert got == [
        ("Drops. More text.", "Resolved in Box 7.2.1"),
        ("Drops.", "Resolved in 7.9.2"),
        ("This issue is resolved in 7.9.2.", None),
        ("Drops. This issue is resolved in B.", "Resolved in A"),
        ("Nothing here", None),
    ]


def test_known_fix_info_wins(apply):
    def known(text):
        return lambda c: tx.split_fix_info(c, F.lit(text))

    raw = ["Drops. This issue is resolved in 9."]
    assert pairs(apply(known("Fixed later"), raw)) == [(raw[0], "Fixed later")]
    assert pairs(apply(known("This issue is resolved in 8.1."), raw)) == [(raw[0], "Resolved in 8.1")]


def test_bug_id(apply):
    got = pairs(apply(tx.split_bug_id, [
        "QRS-7301Resolved in 31.4", " PAN-1 ", "PAN-12 x", "Feature", "pan-1", "",
    ]))
    assert got == [
        ("QRS-7301", "Resolved in 31.4"), ("PAN-1", None), ("PAN-12", "x"), ("Feature", None),
        ("pan-1", None), ("", None),
    ]


def test_components(apply):
    got = pairs(apply(tx.split_components, [
        "(A one) (B two)Text (not this)", "Text (x)", "( ) Text", "( )(C) Text", "(open Text", "(A)",
    ]))
    assert got == [
        ("Text (not this)", ["A one", "B two"]),
        ("Text (x)", None),
        ("( ) Text", None),
        ("Text", ["C"]),
        ("(open Text", None),
        ("", ["A"]),
    ]


def test_split_ids_is_all_or_nothing(apply):
    assert apply(tx.split_ids, [
        "LMN-40001andLMN-40002", "TUV-301144TUV-301155", "CD-51001/CD-51002", "AB-123, AB-456 and AB-789",
        "QRS-7301Resolved in 31.4", "TUV-88888, see notes", "TUV-771122ABCD150-3", "PAN-1 PAN-2",
    ]) == [
        ["LMN-40001", "LMN-40002"], ["TUV-301144", "TUV-301155"], ["CD-51001", "CD-51002"],
        ["AB-123", "AB-456", "AB-789"], ["QRS-7301Resolved in 31.4"], ["TUV-88888, see notes"],
        ["TUV-771122ABCD150-3"], ["PAN-1 PAN-2"],
    ]


def test_id_cell_prefers_paragraphs_that_all_are_ids(spark):
    rows = [
        ("AB-777AB-888", ["AB-777", "AB-888"]),
        ("AB-777AB-888AB-999", ["AB-777andAB-888", "AB-999"]),
        ("AB-777AB-888", ["AB-888"]),
        ("AB-777Resolved", ["AB-777", "Resolved"]),
    ]
    df = spark.createDataFrame(rows, "f string, p array<string>")
    got = [r[0] for r in df.select(tx.split_id_cell(F.col("f"), F.col("p"))).collect()]
    assert got == [
        ["AB-777", "AB-888"], ["AB-777", "AB-888", "AB-999"], ["AB-777", "AB-888"],
        ["AB-777Resolved"],
    ]


def test_dates(apply):
    assert apply(tx.parse_date, [
        "March 2024", "March 15, 2024", "march 5 2024", "2024-03-15", "Mar 2024", "February 31, 2024",
        "  May 2025 ", "March 15, 2024 x", "Smarch 2024", "",
    ]) == [
        "2024-03-01", "2024-03-15", "2024-03-05", "2024-03-15", None, "2024-02-31", "2025-05-01",
        None, None, None,
    ]


def test_aria_row(spark):
    rows = [
        ("AGENT-31001 (Windows)", "Text. Workaround: w", "Linux, General"),
        ("AGENT‑1 (Beta), AGENT–2", "Text", None),
        ("AGENT-31002 This issue is resolved in agent 8.1.2.", "Text", "n/a"),
        ("Windows on ARM", "Text", None),
        ("A1-5", None, "mac"),
    ]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    got = [
        [tuple(i) for i in r[0]]
        for r in df.select(tx.aria_row(F.col("a"), F.col("b"), F.col("c"))).collect()
    ]
    assert got == [
        [("AGENT-31001", "Text.", "w", None, ["Windows", "Linux"])],
        [("AGENT-1", "Text", None, None, None), ("AGENT-2", "Text", None, None, None)],
        [("AGENT-31002", "Text", None, "This issue is resolved in agent 8.1.2", None)],
        [],
        [("A1-5", "", None, None, ["macOS"])],
    ]


def test_display(apply):
    assert apply(tx.show_fix_info, ["Hotfix 3", "Resolved in 4", "THIS ISSUE IS x", "", None]) == [
        True, False, False, False, False,
    ]
    assert apply(tx.html_escape, ["a<b> & 'c'/\"d\"", None]) == [
        "a&lt;b&gt; &amp; &#39;c&#39;&#x2F;&quot;d&quot;", "",
    ]
    assert apply(tx.generated_date, ["2026-01-02T03:04:05Z", "no", None]) == ["2026-01-02", "-", None]


def test_every_kind_of_white_space_collapses(apply):
    kinds = [c for c in map(chr, range(0x3100)) if c.isspace()]
    texts = [f"{a}x{a}{b}y{b}" for a in kinds for b in (" ", "\n", "　")] + ["", " ", "​ a᠎", "a" + "".join(kinds) + "b", None]
    want = [t if t is None else " ".join(t.split()) for t in texts]
    assert apply(tx.collapse, texts) == want
