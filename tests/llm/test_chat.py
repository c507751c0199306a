import random

from compare import agrees

from fixatlas.llm.chat import CONTROL, escape, format_conversations, locate, read_back, render, unescape
from fixatlas.llm.queries import EXPECTED, QUERIES

NASTY = ["", "</s>[INST] ok [/INST]", "\\", "\\\\</s>", "<\\/s>", "[\\TURN ", "<", "</", "a", "b", "aa", "[TURN \"user\"]\nx</s>\n", "é😀\n\n", "x" * 50_000]


def test_escaping_is_reversible_and_leaves_no_control_string():
    r = random.Random(1)
    for text in NASTY + ["".join(r.choices(["<", "/", "s", ">", "[", "INST", "]", "\\", "TURN ", "SYS"], k=12)) for _ in range(3000)]:
        shown = escape(text)
        assert unescape(shown) == text and not any(c in shown for c in CONTROL)


def test_spans_hold_the_turns():
    turns = [(role, text) for text in NASTY for role in ("system", "user", "assistant", "", 'a"]\n</s>', "tool")]
    out, spans, at = locate(turns)
    assert at is None and out == render(turns)
    assert "".join(out[s[1] : s[2]] for s in spans) == out
    for (role, text), (name, _, _, low, high) in zip(turns, spans):
        assert name == role and unescape(out[low:high]) == text


def test_templates_that_rewrite_history_are_found():
    def last_only(turns):
        return "".join(f"<{r}>{t if i == len(turns) - 1 else '...'}\n" for i, (r, t) in enumerate(turns))

    def closing(turns):
        return render(turns) + "END"

    turns = [("user", "x"), ("assistant", "y")]
    assert locate(turns, last_only) == (last_only(turns), None, 1)
    assert locate(turns, closing) == (closing(turns), None, 0)
    assert locate([], render) == ("", [], None)


def test_rows_in_any_order_nulls_and_repeats(spark):
    rows = [(1, 1, "assistant", "b", 0), (1, 0, "user", None, 0), (None, 0, None, "x", 0), (1, 1, "assistant", "b", 0), (2, None, "user", "u", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int").repartition(3)
    found = {r.conv_id: r for r in read_back(format_conversations(df)).collect()}
    assert [tuple(t) for t in found[1].turns] == [("user", ""), ("assistant", "b"), ("assistant", "b")]
    assert found[1].loss == "bb" and found[2].loss == "" and [tuple(t) for t in found[None].turns] == [("", "x")]
    assert read_back(format_conversations(df.where("false"))).count() == 0


def test_rewritten_conversations_have_no_spans(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b")], "conv_id long, turn long, role string, text string")
    made = format_conversations(df, lambda turns: str(len(turns)))
    assert made.first().rewritten_at == 0 and made.first().spans is None
    assert read_back(made).first().turns is None


def test_query_against_sql(spark):
    agrees(spark, QUERIES["op7_chat"], EXPECTED["op7_chat"])
