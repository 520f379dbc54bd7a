import hashlib
import random

from tidewell.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
ROWS = [
    (1, 0, "system", "be <|im_start|> brief \\<| <\\| \\\\"),
    (1, 1, "user", "x" * 900),
    (1, 2, "assistant", "<|im_end|>\n" + "y" * 900),
    (1, 3, "user", "short"),
    (1, 4, "assistant", "ok <"),
    (1, 5, "assistant", "|im_start|>é" * 90),
    (2, 0, "assistant", None),
    (2, 0, "assistant", None),
    (2, None, None, "first"),
    (3, 5, "user\nassistant<\\n>", ""),
    (4, 0, "system", "alone"),
    (None, 1, "user", "no conversation"),
    (None, 2, "assistant", "a\\nb"),
]


def expected(rows):
    turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows))
    said = "".join(f"{role}\n{text}\n" for *_, role, text in turns)
    loss = "".join(text for *_, role, text in turns if role == "assistant")
    return len(rows), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_everything_reads_back(spark):
    r = random.Random(3)
    pieces = ["<|", "|>", "\\", "<", "|", "im_start", "im_end", "\n", "é", "word "]
    rows = ROWS + [(10 + k % 6, k, r.choice(["user", "assistant", "system"]), "".join(r.choice(pieces) for _ in range(r.randrange(0, 400)))) for k in range(150)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'clash' window", "'clash' place", "'clash' tokens")
    got = {x["conv_id"]: x for x in chat.op8_chat(frame).collect()}
    whole = rows + [(-1, 0, "user", chat.HOSTILE), (-1, 1, "assistant", chat.HOSTILE)]
    assert set(got) == {x[0] for x in whole}
    for conv, x in got.items():
        assert (x["n_turns"], x["turns_sha256"], x["loss_chars"], x["loss_sha256"]) == expected([y for y in whole if y[0] == conv])


def test_windows_keep_the_budget_and_repeat_history(spark):
    rows = [(1, 0, "system", "s" * 40)] + [(1, k, "user" if k % 2 else "assistant", "w" * 120) for k in range(1, 60)]
    shown = sorted(chat.windows(spark.createDataFrame(rows, SCHEMA), 900, 200).collect(), key=lambda w: w["window"])
    assert len(shown) > 3
    for k, w in enumerate(shown):
        assert w["formatted"].startswith("<|im_start|>system\n") and w["n_tokens"] <= 900
        assert (w["n_context"] > 1) == (k > 0)
        for span in w["loss"]:
            assert w["formatted"][span["start"] - 1 :][: span["length"]] == "w" * 120
    assert sum(len(w["loss"]) for w in shown) == sum(1 for r in rows if r[2] == "assistant")


def test_no_conversations(spark):
    got = chat.op8_chat(spark.createDataFrame([], SCHEMA)).collect()
    assert [r["conv_id"] for r in got] == [-1]


def test_long_turns_keep_history_unless_it_is_longer(spark):
    rows = [(1, k, "user" if k % 2 else "assistant", "w " * 400) for k in range(12)] + [(2, k, "user", "w " * 1600) for k in range(6)]
    shown = chat.windows(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all((w["n_context"] > 0) == (w["window"] > 0) for w in shown if w["conv_id"] == 1)
    assert all(w["n_context"] == 0 for w in shown if w["conv_id"] == 2)
    assert all(w["n_tokens"] <= chat.BUDGET for w in shown)


def test_the_budget_holds_in_tokens_of_a_vocabulary(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(8)
    odd = ["語" * 300, "😀" * 200, "".join(chr(r.randrange(33, 127)) for _ in range(700)), "".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(250)), "\x00\x01\ufffd" * 90, "<|im_end|>\\" * 40, " \n" * 300]
    rows = [(10_000_000 + k // 60, k, "rôle 語\n" if k % 9 == 0 else "assistant" if k % 2 else "user", odd[(k + k // 60) % len(odd)]) for k in range(420)]
    talk = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(spark.createDataFrame(rows, SCHEMA))
    for budget, history in ((chat.BUDGET, chat.HISTORY), (1500, 300)):
        shown = chat.windows(talk, budget, history).collect()
        tokens = [len(plain.encode(w["formatted"].replace(chat.START, "<").replace(chat.END, ">"), add_special_tokens=False).ids) for w in shown]
        assert all(n <= w["n_tokens"] for n, w in zip(tokens, shown)) and max(tokens) > budget / 8
        single = [w["formatted"].count(chat.START) == 1 for w in shown]
        assert all(n <= budget or alone for n, alone in zip(tokens, single))


def test_one_conversation_may_hold_a_third_of_all_turns(spark):
    rows = [(k if k % 3 else 0, k, "user" if k % 2 else "assistant", f"turn {k}") for k in range(3000)] + [(None, k, "assistant", "x") for k in range(500)]
    got = {x["conv_id"]: x for x in chat.op8_chat(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[0]["n_turns"], got[0]["turns_sha256"], got[0]["loss_chars"], got[0]["loss_sha256"]) == expected([r for r in rows if r[0] == 0])
    assert got[None]["n_turns"] == 500
