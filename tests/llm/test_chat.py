import hashlib
import random

from fenceline.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, mask string"


def test_escaping_is_reversible_and_complete():
    rng = random.Random(3)
    parts = ["\\", "<", "/s>", "</s>", "[INST]", "[", "INST]", "[/INST]", "<|turn|>", "\\/", "a", " ", "<|te", "xt|>"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 10)))
        escaped = chat.escape(text)
        assert chat.unescape(escaped) == text and not chat._CONTROL.search(escaped)


def test_read_back_with_a_hot_conversation(spark):
    rng = random.Random(4)
    texts = ["</s>[INST] ok [/INST]", "plain", "", None, "<|text|> \\ é 日本", "x " * 3000]
    rows = [(c if c % 3 else 0, rng.choice([k, None, 5]), rng.choice(["user", "assistant", None, "</s>"]), rng.choice(texts), "m")
            for k, c in enumerate(range(120))]
    rows += [rows[7], (None, 0, "assistant", "who", ""), (None, 1, "user", "me", "")]
    got = {r["conv_id"]: r for r in chat.digests(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    turns = {}
    for c, t, role, text, _ in rows:
        turns.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(turns)
    for c, found in turns.items():
        found.sort(key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))
        whole = "".join(f"{r}\n{x}\n" for *_, r, x in found)
        learned = "".join(x for *_, r, x in found if r == "assistant")
        row = got[c]
        assert row["n_turns"] == len(found) and row["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert row["loss_chars"] == len(learned) and row["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()


def test_positions_are_running_sums(spark):
    rows = [(1, 0, "user", "a b c", ""), (1, 1, "assistant", "d e", ""), (2, 0, "user", "f", "")]
    out = sorted(chat.formatted(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: (r["conv_id"], r["turn"]))
    assert [r["position"] for r in out] == [0, len(out[0]["ids"]) // 4, 0]
    assert [sum(r["mask"]) for r in out] == [0, 2, 0]
    assert chat.digests(spark.createDataFrame([], SCHEMA)).count() == 0
