"""Chat windows: what is read back equals the turns, masks, budgets, edge cases."""

import hashlib

from weirflow.llm import chat, queries

SF = "/root/testdata/sf0.001"
KIND = "conv_id long, turn long, role string, text string, window string, pos int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    convs = {}
    for r in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or "")):
        convs.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    out = {}
    for c, turns in convs.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        out[c] = (len(turns), sha("".join(f"{role}\n{t}\n" for role, t in turns)), len(loss), sha(loss))
    return out


def got(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def test_conversations_read_back(spark):
    rows = [tuple(r)[:4] for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    odd = "</s>[INST] ok [/INST]"
    assert got(queries.op7_chat(spark, SF)) == expected([*rows, (-7, 0, "user", odd), (-7, 1, "assistant", odd)])


ODD = [
    (1, 0, "system", "be brief", "w", 1), (1, 1, "user", None, "w", 1), (1, 2, "assistant", "<|turn|>x<|end|>\n<\\|a [INST] <\\\\/s>", "w", 1), (1, 3, None, "", "w", 1),
    (1, None, "assistant", "last", "w", 1), (1, 3, "user", "tie b", "w", 1), (1, 3, "user", "tie a", "w", 1), (1, 3, "user", "tie a", "w", 1),
    (None, 5, "assistant", "of nobody", "w", 1), (2, 9, "a\nb%0A<|turn|>", "é\n\n", "w", 1), (3, 1, "assistant", "word " * 30_000, "w", 1), (3, 2, "assistant", "", "w", 1),
]


def test_edges(spark):
    df = spark.createDataFrame(ODD, KIND)
    assert got(chat.digests(chat.windows(df))) == expected(ODD)
    assert chat.digests(chat.windows(df.limit(0))).collect() == []


def test_windows_keep_to_the_budget_and_learn_each_target_once(spark):
    turns = [(1, 0, "system", "rules " * 10)] + [(1, i, ("assistant", "user")[i % 2], f"turn{i} " * (5 + i * 7 % 60)) for i in range(1, 2000)]
    rows = chat.windows(spark.createDataFrame([(*t, "", 0) for t in turns], KIND)).orderBy("window").collect()
    assert len(rows) > 100 and max(r.tokens for r in rows) <= chat.BUDGET and sum(r.n_turns for r in rows) == len(turns)
    learned, seen = [], []
    for i, r in enumerate(rows):
        pieces = r.formatted.split("<|turn|>")[1:]
        assert r.formatted.startswith("<|turn|>system\nrules") and (i == 0) == (r.n_context == 0)
        if i:
            assert 1 <= r.n_context <= 1 + chat.HISTORY_TURNS
            assert pieces[1 : r.n_context] == (seen[-(r.n_context - 1) :] if r.n_context > 1 else [])
        seen += pieces[r.n_context :]
        learned += [r.formatted[s.start : s.end] for s in r.loss]
    assert learned == [t[3] for t in turns if t[2] == "assistant"]
    assert expected([(*t, "") for t in turns]) == got(chat.digests(chat.windows(spark.createDataFrame([(*t, "", 0) for t in turns], KIND))))
