import random

import pytest
from pyspark.sql import functions as F

from reviewmill.llm import chat
from reviewmill.llm.queries import op9_chat

ODD = ["", "plain", "\\", "\\\\", "</s>", "<\\/s>", "[INST]", "[/INST] x [/INST]", "<|im_start|>user\nhi<|im_end|>\n", "<|im_end|>", "<<SYS>>",
       "<<|im_end|>|im_end|>", "a\nb\r\n", "\\n", "🙂 é", "<|im_start|", "\\<|im_end|>\\", "<s<s>>", "$1 \\$"]


def messages(spark, rows):
    return spark.createDataFrame(rows, "tree long, id long, parent long, score double, role string, text string")


def test_escapes_are_reversible_and_leave_no_control_string(spark):
    draw = random.Random(1)
    texts = ODD + ["".join(draw.choice(ODD) for _ in range(6)) for _ in range(500)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = frame.select("t", chat.escaped(F.col("t")).alias("e"), chat.unescaped(chat.escaped(F.col("t"))).alias("u")).collect()
    assert all(r.t == r.u for r in rows)
    assert not any(c in r.e for r in rows for c in chat.CONTROL)


def test_only_built_in_operations(spark, folder, capsys):
    op9_chat(spark, folder).explain("formatted")
    plan = capsys.readouterr().out
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoop"))


def test_paths_of_a_tree(spark):
    rows = [(1, 1, None, 0.0, "user", "q"), (1, 2, 1, 1.0, "assistant", "low"), (1, 3, 1, 5.0, "assistant", "high"),
            (1, 4, 3, -1.0, "user", "more"), (1, 5, 4, None, "assistant", "end"), (1, 6, 3, -1.0, "user", "tie"),
            (2, 1, 99, 1.0, "user", "orphan"), (2, 1, 99, 1.0, "user", "orphan"), (None, 1, None, 0.0, None, None)]
    frame = messages(spark, rows).withColumn("depth", F.lit("x")).withColumn("leaf", F.lit(0))
    found = chat.best_paths(frame, branches=2).orderBy("tree", "branch", "depth").collect()
    paths = {}
    for r in found:
        paths.setdefault((r.tree, r.branch, r.leaf), []).append(r.id)
    assert paths == {(1, 1, 5): [1, 3, 4, 5], (1, 2, 6): [1, 3, 6], (2, 1, 1): [1], (None, 1, 1): [1]}
    formatted = chat.format_paths(chat.best_paths(messages(spark, rows[:6])), messages(spark, rows[:6])).first()
    assert formatted.formatted == "".join(
        f"<|im_start|>{role}\n{text}<|im_end|>\n" for role, text in (("user", "q"), ("assistant", "high"), ("user", "more"), ("assistant", "end")))
    assert [formatted.formatted[s.start: s.start + s.length] for s in formatted.loss] == ["high", "end"]


def test_circle_of_replies(spark):
    with pytest.raises(ValueError):
        chat.best_paths(messages(spark, [(1, 1, 2, 0.0, "user", "a"), (1, 2, 1, 0.0, "user", "b")]))


def test_long_path(spark):
    frame = messages(spark, [(1, i, i - 1 if i else None, 1.0, "user", str(i)) for i in range(700)])
    found = chat.best_paths(frame).orderBy("depth").collect()
    assert [(r.depth, r.id) for r in found] == [(i + 1, i) for i in range(700)]


def test_hard_rows(spark):
    draw = random.Random(2)
    rows = [(c, t, draw.choice(["user", "assistant", "system", "a\nb", "\\", None, "<|im_end|>"]), draw.choice([*ODD, None]))
            for c in range(30) for t in range(draw.randint(1, 9))]
    rows += [(100, None, "user", "x"), (100, 1, "user", "y"), (100, 1, "assistant", "z"), (100, 1, "assistant", "z"),
             (None, 1, "user", "nobody"), (101, 0, "assistant", "long </s> " * 100_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("id", F.lit(1)).withColumn("tree", F.lit(2))
    trees = chat.as_trees(frame)
    formatted = chat.format_paths(chat.best_paths(trees), trees)
    got = {r.tree: r for r in formatted.select(
        "tree", "turns", "formatted", chat.read_back(F.col("formatted")).alias("read"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("learned")
    ).collect()}
    order = lambda r: tuple((x is not None, x if x is not None else 0) if i == 0 else (x is not None, (x or "").encode()) for i, x in enumerate(r[1:]))
    expected = {}
    for r in sorted(rows, key=order):
        expected.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    assert got.keys() == expected.keys()
    for key, turns in expected.items():
        assert [tuple(t) for t in got[key].read] == turns and got[key].turns == len(turns)
        assert got[key].learned == "".join(text for role, text in turns if role == "assistant")
    empty = chat.as_trees(frame.where("false"))
    assert chat.format_paths(chat.best_paths(empty), empty).count() == 0
