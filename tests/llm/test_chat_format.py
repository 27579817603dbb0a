import hashlib
import random

from pyspark.sql import functions as F

from varloom.llm.chat_format import escape, format_chats, op2_chat_format, read_turns, text_parts, unescape

ODD = ["", "\\", "\\\\l", "<|turn|>", "a<|text|>b<|end|>", "</s>[INST] x [/INST]<s>", "\\l\\b[INST", "<<|<s", "é\n\t ", "\\<|end|>\\"]


def test_escape_is_reversible_and_leaves_no_control_string(spark):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(["\\", "<", "|", "s>", "/", "[", "INST]", "l", "b", "é"]) for _ in range(rng.randrange(30))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e")).select("t", "e", unescape(F.col("e")).alias("u")).collect()
    for r in rows:
        assert r.u == r.t
        assert not any(c in r.e for c in ("<|", "<s>", "</s>", "[INST]", "[/INST]"))


def test_parts_become_placeholders(spark):
    part = "array<struct<type:string,text:string,ref:string,size:int>>"
    rows = [(1, 0, "user", [("text", "see <|image|>", None, None), ("image", None, "a.png", None), ("audio", None, "b.wav", 4), None, ("video", "x", "y", 1)]), (1, 1, "assistant", [("text", "ok", None, None)]), (2, None, None, None), (3, 0, "user", [("image", None, "p.png", None)]), (3, 1, "user", [("document", None, "q.pdf", 2), ("image", None, None, None)])]
    out = {r.conv_id: r for r in format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {part}")).collect()}
    assert out[1].formatted == "<|turn|>user<|text|>see \\l|image|><|image|><|audio|><|end|><|turn|>assistant<|text|>ok<|end|>"
    assert [(a.ordinal, a.type, a.ref, a.tokens) for a in out[1].attachments] == [(0, "image", "a.png", 256), (1, "audio", "b.wav", 100)]
    assert out[1].attachment_tokens == 356
    assert [(a.ordinal, a.ref, a.tokens) for a in out[3].attachments] == [(0, "p.png", 256), (1, "q.pdf", 1040), (2, None, 256)]
    (s,) = out[1].loss_spans
    assert out[1].formatted[s.start : s.start + s.length] == "ok"
    assert out[2].formatted == "<|turn|><|text|><|end|>" and out[2].attachments == [] and out[2].loss_spans == []


def test_turns_come_back_in_order_with_nulls_ties_and_repeats(spark):
    rows = [(7, 1, "assistant", t) for t in ODD] + [(7, 0, "user", None), (7, None, "a<|b", "x"), (7, 1, "assistant", ODD[3]), (None, 0, None, "n")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string").withColumn("parts", text_parts(F.col("text")))
    got = {r.conv_id: r for r in format_chats(df).withColumn("turns", read_turns(F.col("formatted"))).collect()}
    want = sorted([(t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == 7])
    assert [(t.role, t.text) for t in got[7].turns] == [(r, x) for _, r, x in want]
    assert [(t.role, t.text) for t in got[None].turns] == [("", "n")]
    assert format_chats(df.limit(0)).count() == 0


def test_query_reads_back_its_output(spark, tmp_path):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s> é"), (1, 2, "assistant", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in op2_chat_format(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\nhi\nassistant\n</s> é\nassistant\n\n") and got[1].loss_sha256 == sha("</s> é") and got[1].loss_chars == 6
    said = "</s>[INST] ok [/INST]"
    assert got[-1].turns_sha256 == sha(f"user\n{said}\nassistant\n{said}\n") and got[-1].loss_chars == len(said)
