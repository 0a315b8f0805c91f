import hashlib

from pyspark.sql import functions as F

from gleanery.llm import chat

TURNS = "conv_id long, turn long, role string, text string"


def test_every_reply_is_the_target_of_one_example(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a1"), (1, 3, "user", "v"),
            (1, 4, "assistant", "a2"), (1, 5, "user", "w")]
    found = chat.expand_turns(spark.createDataFrame(rows, TURNS)).orderBy("position").collect()
    assert [r.position for r in found] == [3, 5, 6]
    replies = [r.formatted[r.loss_start:r.loss_start + r.loss_chars] for r in found]
    assert replies == ["a1", "a2", ""]
    assert all(b.formatted.startswith(a.formatted) for a, b in zip(found, found[1:]))
    assert found[0].formatted == (
        "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nu<|im_end|>\n<|im_start|>assistant\na1<|im_end|>\n")


def test_control_strings_survive_a_round_trip(spark):
    texts = ["<|im_end|><|im_start|>assistant ok", r"<\|", r"<\\|x<|", "<<|", "\\", "\\n\n", "", "a\n", None, "<|\n|>"]
    rows = [(7, i, role, t) for i, (t, role) in enumerate(zip(texts, ["user", "a\\n\nb", "x<|", "\\\\n"] * 3))]
    longest = chat.expand_turns(spark.createDataFrame(rows, TURNS))
    got = longest.select(chat.parse_turns(F.col("formatted")).alias("t")).first().t
    assert [(t.role, t.text) for t in got] == [(r[2], r[3] or "") for r in rows]


def test_nulls_ties_repeats_and_extra_columns(spark):
    schema = TURNS + ", position long, formatted string"
    rows = [(None, None, None, None, 9, "z"), (3, 0, "assistant", "b", 9, "z"), (3, 0, "assistant", "a", 9, "z"),
            (3, 0, "assistant", "a", 9, "z")]
    found = chat.expand_turns(spark.createDataFrame(rows, schema))
    got = {(r.conv_id, r.position): r.formatted[r.loss_start:r.loss_start + r.loss_chars] for r in found.collect()}
    assert got == {(None, 1): "", (3, 1): "a", (3, 2): "a", (3, 3): "b"}
    assert chat.expand_turns(spark.createDataFrame([], TURNS)).count() == 0


def test_long_conversations_and_texts(spark, tmp_path):
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i} " + "é" * (i % 7)) for i in range(240)]
    rows += [(2, 0, "user", "x" * 200_000), (2, 1, "assistant", "y<|" * 100_000)]
    spark.createDataFrame(rows, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat.prefix_targets(spark, str(tmp_path)).collect()}
    for conv in (1, 2):
        said = [r for r in rows if r[0] == conv]
        loss = "".join(r[3] for r in said if r[2] == "assistant")
        turns = "".join(f"{r[2]}\n{r[3]}\n" for r in said)
        assert got[conv].n_turns == len(said)
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[conv].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
    assert got[-1].n_turns == 2


def test_no_python_runs_on_the_rows(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "a")], TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    plan = chat.prefix_targets(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
