import hashlib
import random

from pyspark.sql import functions as F

from loomlab.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def esc(t, control):
    for i, c in enumerate(control):
        t = t.replace(c, f"^{i}")
    return t


def brute(rows):
    """Per conversation: the examples as (text, loss) by plain string work."""
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t, r, x))
    low = lambda v: (v is not None, v if v is not None else 0)
    low_s = lambda v: (v is not None, v or "")
    out = {}
    for c, turns in convs.items():
        turns.sort(key=lambda v: (low(v[0]), low_s(v[1]), low_s(v[2])))
        text, made = "", []
        for i, (_, r, x) in enumerate(turns):
            body = esc(x or "", chat.CONTROL)
            text += "<|im_start|>" + esc(r or "", chat.ROLE_CONTROL) + "\n"
            at = len(text)
            text += body + "<|im_end|>\n"
            if r == "assistant":
                made.append((text, at, at + len(body)))
        if not made or made[-1][0] != text:
            made.append((text, len(text), len(text)))
        listed = "".join(f"{r or ''}\n{x or ''}\n" for _, r, x in turns)
        replies = "".join(x or "" for _, r, x in turns if r == "assistant")
        out[c] = (made, len(turns), hashlib.sha256(listed.encode()).hexdigest(), len(replies), hashlib.sha256(replies.encode()).hexdigest())
    return out


def messy():
    rng = random.Random(3)
    bits = ["</s>", "[INST]", " ok ", "[/INST]", "<|", "<|im_end|>\n", "<|im_start|>", "^", "^0", "^1", "é", "😀", "\n", "\\", "$1", ""]
    rows = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    for c in range(40):
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", None, "a\nb", "<|im_start|>"]), rng.choice([None, "".join(rng.choices(bits, k=rng.randint(0, 9)))])))
    rows += [(50, None, "user", "x"), (50, 1, "assistant", None), (50, 1, "assistant", None), (None, 0, "assistant", "who"), (None, 1, None, None)]
    rows += [(60, i, "assistant" if i % 2 else "user", "word " * 50) for i in range(300)]
    return rows


def test_examples_and_digests_match_plain_string_work(spark):
    rows = messy()
    shown = chat.examples(spark.createDataFrame(rows, SCHEMA).withColumn("example", F.lit("clash")))
    want = brute(rows)
    got = {}
    for r in shown.collect():
        got.setdefault(r["conv_id"], []).append((r["example"], r["text"], r["loss_start"], r["loss_end"]))
    assert {c: [e[1:] for e in sorted(v)] for c, v in got.items()} == {c: v[0] for c, v in want.items()}
    for r in chat.digests(shown).collect():
        made, n, turns, chars, loss = want[r["conv_id"]]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (n, turns, chars, loss)
        assert r["formatted_chars"] == sum(len(m[0]) for m in made)


def test_escapes_leave_no_control_string(spark):
    texts = [r[3] or "" for r in messy()]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat.unescaped(F.col("e")).alias("back")).collect():
        assert r["back"] == r["t"] and not any(c in r["e"] for c in chat.CONTROL[1:])


def test_empty_table_and_native_plan(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.digests(chat.examples(empty)).count() == 0
    plan = chat.digests(chat.examples(spark.createDataFrame(messy(), SCHEMA)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
