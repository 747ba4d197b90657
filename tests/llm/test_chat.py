import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tabmeter.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
CONTROL = "</s>[INST] ok [/INST]"
ROWS = [
    (1, 0, "system", "be \\e brief \\l <s> é\U0001d11e"),
    (1, 1, None, None),
    (1, 2, "assistant", "\\n\n\\ </s>\n<s>assistant\nx"),
    (1, 3, "as\nsis", "[INST] [[/INST]<|im|></s>\n"),
    (1, 4, "assistant", ""),
    (None, None, "user", "x"),
    (None, None, "user", "x"),
    (None, 3, "assistant", "y"),
    (2, 0, "assistant", "z " * 3000),
    (3, 5, "user", "same turn"),
    (3, 5, "assistant", "same turn"),
    (3, 5, "assistant", "same turn"),
    (4, 0, "user", None),
    *[(5, 0, "system", "be good " * 20)],
    *[(5, i, "assistant" if i % 2 == 0 else "user", f"w{i} " * (i * 13 % 170)) for i in range(1, 60)],
]


@pytest.fixture(scope="module")
def conversations(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    return frame.withColumns({name: F.lit("extra") for name in ("at", "head", "body", "window", "cost", "said")})


def expected(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((-1 if turn is None else turn, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        whole = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        digests = (hashlib.sha256(x.encode()).hexdigest() for x in (whole, loss))
        out[conv] = (len(turns), next(digests), len(loss), next(digests))
    return out


def test_turns_and_loss_are_read_back(conversations):
    rows = [*ROWS, (-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)]
    found = {r["conv_id"]: tuple(r)[1:5] for r in chat.chat_report(conversations).collect()}
    assert found == expected(rows)


def test_windows_are_whole_turns_within_the_budget(conversations):
    windows = chat.format_windows(conversations).where("conv_id = 5").orderBy("window").collect()
    assert [w["window"] for w in windows] == list(range(len(windows))) and len(windows) > 5
    assert all(w["n_tokens"] <= chat.BUDGET for w in windows)
    assert all(w["text"].startswith("<s>system\nbe good") for w in windows)
    assert sum(w["n_turns"] - w["n_repeated"] for w in windows) == 60
    assert windows[0]["n_repeated"] == 0 and all(1 <= w["n_repeated"] <= 1 + chat.HISTORY for w in windows[1:])
    turns = [w["text"].split(chat.CLOSE)[:-1] for w in windows]
    for earlier, later, row in zip(turns, turns[1:], windows[1:], strict=False):
        again = later[1 : row["n_repeated"]]  # what is repeated after the system turn stood last before
        assert again == earlier[len(earlier) - len(again) :] or len(again) > len(earlier) - 1
    alone = chat.format_windows(conversations).where("conv_id = 2").collect()
    assert len(alone) == 1 and alone[0]["n_tokens"] > chat.BUDGET


def test_loss_holds_each_answer_once(conversations):
    said = defaultdict(list)
    for row in chat.format_windows(conversations).orderBy("window").collect():
        said[row["conv_id"]] += [row["text"][s["start"] : s["start"] + s["length"]] for s in row["loss"]]
    assert said[5] == [text for conv, _, role, text in ROWS if conv == 5 and role == "assistant"]


def test_control_strings_are_escaped_and_come_back(spark):
    texts = [CONTROL, "\\", "\\\\e", "\\l<s>", "<|x|>", "<<s>>", "a\\b[INST", "</s", "", "[/INST][INST]"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    found = frame.select("t", chat.escape(F.col("t")).alias("e")).withColumn("back", chat.unescape(F.col("e"))).collect()
    for row in found:
        assert row["back"] == row["t"]
        assert not any(x in row["e"] for x in ("<s>", "</s>", "[INST]", "[/INST]", "<|"))


def test_no_python_in_the_plan_and_one_shuffle(conversations):
    plan = chat.chat_report(conversations)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    assert plan.count("ENSURE_REQUIREMENTS") == 1


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert chat.format_windows(none).collect() == []
    assert [r["conv_id"] for r in chat.chat_report(none).collect()] == [-1]
