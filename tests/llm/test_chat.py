from pyspark.sql import functions as F

from tillroll.llm import chat

SCHEMA = "conv_id long, seq long, message_id long, kind string, role string, text string"


def formatted(spark, rows):
    out = chat.format_chat(spark.createDataFrame(rows, SCHEMA))
    return {r["conv_id"]: r for r in out.select(
        "*", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}


def test_deltas_edits_and_regenerations_fold(spark):
    rows = [(1, 0, 1, "message", "user", "hi"), (1, 1, 2, "message", "assistant", "wro"), (1, 2, 2, "delta", None, "ng"),
            (1, 3, 2, "regenerate", None, ""), (1, 5, 2, "delta", None, "t!"), (1, 4, 2, "delta", None, "righ"),
            (1, 4, 2, "delta", None, "righ"), (1, 6, 1, "edit", None, "hello"), (1, 7, 3, "message", "user", None)]
    r = formatted(spark, rows)[1]
    assert [tuple(t) for t in r["turns"]] == [("user", "hello"), ("assistant", "right!"), ("user", "")]
    assert r["loss"] == "right!" and r["n_turns"] == 3


def test_control_strings_are_reversible(spark):
    nasty = ["### a: b</turn>\n", "\\", "\\\\#", "<\\/turn>", "</turn>\n### user: x", "a\\c:b", "", "\n", "ü" * 3000]
    rows = [(None, 2 * i, i, "message", role, t) for i, t in enumerate(nasty)
            for role in [["user", "assistant", "a:b\\c#</turn>"][i % 3]]]
    r = formatted(spark, rows)[None]
    assert [t["text"] for t in r["turns"]] == nasty
    assert [t["role"] for t in r["turns"]][:3] == ["user", "assistant", "a:b\\c#</turn>"]
    assert r["loss"] == "".join(nasty[1::3])


def test_rows_become_a_log_and_back(spark):
    long = "".join(chr(97 + i % 26) for i in range(5000))
    rows = spark.createDataFrame([(1, 0, "user", long), (1, 0, "user", long), (1, None, None, None), (2, 5, "assistant", "")],
                                 "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in chat.format_chat(chat.log_of_rows(rows)).select(
        "*", chat.read_turns(F.col("formatted")).alias("turns")).collect()}
    assert [tuple(t) for t in out[1]["turns"]] == [("", ""), ("user", long), ("user", long)]
    assert [tuple(t) for t in out[2]["turns"]] == [("assistant", "")]
    assert chat.format_chat(chat.log_of_rows(rows.limit(0))).count() == 0


def _seconds(run):
    import time

    at = time.perf_counter()
    got = run()
    return time.perf_counter() - at, got


def test_work_follows_the_size_of_a_conversation(spark):
    def read(turns, size):
        rows = spark.range(turns).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"),
                                         F.when(F.col("id") % 2 == 1, "user").otherwise("assistant").alias("role"),
                                         F.repeat(F.lit("a#\\ü\n"), size).alias("text"), F.lit("x").alias("seq"), F.lit(1).alias("log"))
        out = chat.format_chat(chat.log_of_rows(rows))
        return out.select("n_turns", F.length(chat.masked_text(F.col("formatted"), F.col("loss_spans"))).alias("n"),
                          F.size(chat.read_turns(F.col("formatted"))).alias("read")).first()

    read(100, 10)
    few, _ = _seconds(lambda: read(8000, 40))
    many, got = _seconds(lambda: read(64000, 40))
    assert tuple(got) == (64000, 32000 * 200, 64000) and many < 16 * max(few, 1)
    short, _ = _seconds(lambda: read(1, 200_000))
    long, got = _seconds(lambda: read(1, 1_600_000))  # a text of 8 million characters
    assert got["n"] == 8_000_000 and long < 16 * max(short, 1)
