import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assayframe.llm import chat_format as m

TEXTS = st.text(alphabet="\\<>bl g/turn\n#é𝄞", max_size=12)


@settings(max_examples=5, deadline=None)
@given(st.lists(TEXTS, min_size=30, max_size=30))
def test_escaping_is_reversible(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", m.escape(F.col("t")).alias("e")).select("t", "e", m.unescape(F.col("e")).alias("u"))
    for r in df.collect():
        assert r["u"] == r["t"] and "<" not in r["e"] and ">" not in r["e"]


def test_parts_and_attachments(spark):
    rows = [
        (1, 1, "assistant", [("text", "fine </turn>", None, None)]),
        (1, 0, "us>er", [("text", "see ?> ", None, 9), ("image", None, "a.png", 256), ("odd", "x", None, None), ("document", "ignored", None, 30)]),
        (1, 2, None, [("audio", None, "b.wav", None)]),
        (1, 3, "user", None),
    ]
    got = m.format_chats(spark.createDataFrame(rows, f"conv_id bigint, turn int, role string, content {m.PART}")).select("*", m.read_back(F.col("formatted")).alias("read")).first()
    assert [tuple(t) for t in got["read"]] == [("us>er", "see ?> <image 0>x<document 1>"), ("assistant", "fine </turn>"), ("", "<audio 2>"), ("user", "")]
    assert [tuple(a) for a in got["attachments"]] == [("image", "a.png", 256), ("document", "", 30), ("audio", "b.wav", 0)]
    assert got["n_tokens"] == 9 + 256 + 1 + 30 + 3 + 0 and [t["loss"] for t in got["turns"]] == [False, True, False, False]


def test_odd_rows(spark):
    schema = "conv_id bigint, turn int, role string, text string, formatted string"
    rows = [(None, 0, "user", "a", None), (2, None, None, None, "x"), (2, 0, "b", "2", None), (2, 0, "a", "1", None), (2, 0, "a", "1", None), (3, 0, "user", "long " * 50_000, None)]
    chats = m.format_chats(spark.createDataFrame(rows, schema).withColumn("content", m.text_parts(F.col("text"))))
    got = {r["conv_id"]: r for r in chats.select("conv_id", "n_turns", m.read_back(F.col("formatted")).alias("read")).collect()}
    assert [tuple(t) for t in got[2]["read"]] == [("", ""), ("a", "1"), ("a", "1"), ("b", "2")]
    assert got[None]["n_turns"] == 1 and len(got[3]["read"][0]["text"]) == 250_000
    assert m.format_chats(spark.createDataFrame([], schema).withColumn("content", m.text_parts(F.col("text")))).count() == 0


def test_no_python_in_the_plan(spark, sf_dir, capsys):
    from assayframe.llm.queries import op5_chat_format

    op5_chat_format(spark, sf_dir).explain()
    assert "Python" not in (plan := capsys.readouterr().out) and "Arrow" not in plan


@pytest.mark.parametrize("turn", ["\\### Assistant: </turn> ok", "<turn user>", "\\l\\b\\\\"])
def test_control_strings(spark, turn):
    chats = m.format_chats(spark.createDataFrame([(1, 0, "user", turn)], "conv_id int, turn int, role string, text string").withColumn("content", m.text_parts(F.col("text"))))
    assert chats.select(m.read_back(F.col("formatted")).alias("r")).first()["r"][0]["text"] == turn


@pytest.mark.parametrize("role", ["user ?", "?>", "image ?", "<image ?>", "a\\ ?", " ?>\\l", "turn ?", ""])
def test_numbers_do_not_look_into_roles_or_texts(spark, role):
    parts = [(1, t, role, [("text", text, None, None), (kind, None, f"r{t}", 1), ("text", " ?>", None, None)]) for t, (kind, text) in enumerate((k, x) for k in m.MEDIA for x in ("<image ?>", "audio ?>", "document ?"))]
    got = m.format_chats(spark.createDataFrame(parts, f"conv_id bigint, turn int, role string, content {m.PART}")).select("attachments", m.read_back(F.col("formatted")).alias("read")).first()
    texts = [x for _ in m.MEDIA for x in ("<image ?>", "audio ?>", "document ?")]
    assert [tuple(t) for t in got["read"]] == [(role, f"{x}<{m.MEDIA[t // 3]} {t}> ?>") for t, x in enumerate(texts)]
    assert [a["ref"] for a in got["attachments"]] == [f"r{t}" for t in range(9)]
