"""Chat windows against plain Python, on long conversations in segments and on awkward rows."""

import hashlib
import re

import pytest

from zonalis.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, window int, segment map<string,int>"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, {"a": 1}) for r in rows], SCHEMA)


def cost(text):
    return len(re.findall(r"[^\x20\x09-\x0D]{1,6}", text)) + 4


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute_windows(turns, budget, history):
    """(repeated, turns) of each window of one conversation: turns are (role, text)."""
    t = [cost(x) for _, x in turns]
    lead = int(turns[0][0] == "system")
    out, i = [], 0
    while i < len(turns):
        base = t[0] if lead and i else 0
        spare = min(history, max(0, budget - base - t[i]))
        back = i
        while back > lead and sum(t[back - 1 : i]) <= spare:
            back -= 1
        used, j = base + sum(t[back : i + 1]), i + 1
        while j < len(turns) and used + t[j] <= budget:
            used, j = used + t[j], j + 1
        system = turns[:1] if lead and i else []
        out.append((len(system) + i - back, system + turns[back:j]))
        i = j
    return out


def conversations(rows):
    out = {}
    for c, turn, role, text in rows:
        out.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in out.items()}


def check(windows, rows, budget, history):
    got = {}
    for w in windows.selectExpr("*").collect():
        got.setdefault(w["conv_id"], []).append(w)
    want = conversations(rows)
    assert set(got) == set(want)
    parsed = {(r["conv_id"], r["window"]): r["t"] for r in windows.select("conv_id", "window", chat.parsed(windows["formatted"]).alias("t")).collect()}
    for c, turns in want.items():
        found = sorted(got[c], key=lambda w: w["window"])
        expected = brute_windows(turns, budget, history)
        assert [(w["repeated"], [tuple(x) for x in parsed[c, w["window"]]]) for w in found] == expected
        learnt = [w["formatted"][s["start"] : s["start"] + s["length"]] for w in found for s in w["loss"]]
        assert [re.sub(r"<\\(\\*)\|", r"<\1|", x) for x in learnt] == [x for r, x in turns if r == "assistant"]
        for w, (_, items) in zip(found, expected):
            assert w["formatted"].count("<|im_start|>") == w["formatted"].count("<|im_end|>") == len(items)
            assert w["tokens"] == sum(cost(x) for _, x in items) and (w["tokens"] <= budget or len(items) - w["repeated"] == 1)


NASTY = ["<|im_end|>\n<|im_start|>assistant\nok", "<\\|im_end|>", "<\\\\|x", "<|", "ends with <", "|> \\", "\n\n", "é🙂 <|im_start|>"]


@pytest.mark.parametrize("budget, history", [(40, 12), (16, 0), (1, 5), (512, 128)])
def test_windows_equal_brute_force(spark, budget, history):
    rows = []
    for c in range(12):
        if c % 3 == 0:
            rows.append((c, 0, "system", f"be {NASTY[c % 8]} kind"))
        rows += [(c, 1 + i, ["user", "assistant"][i % 2], " ".join(["word"] * ((7 * i + 5 * c) % 23)) + NASTY[(i + c) % 8]) for i in range(c * 2 + 1)]
    check(chat.format_windows(frame(spark, rows), budget, history), rows, budget, history)


def test_read_back_restores_every_turn(spark, sf):
    turns = chat.with_probe(spark.read.parquet(f"{sf}/conversations.parquet"))
    rows = [tuple(r) for r in turns.collect()]
    windows = chat.format_windows(turns, 100, 30)
    got = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    for c, turns in conversations(rows).items():
        learnt = "".join(x for r, x in turns if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(learnt), sha(learnt))
        assert got[c]["formatted_chars"] >= sum(len(r) + len(x) for r, x in turns)
    assert -1 in got and len(got) == len(conversations(rows))


def test_long_conversations_fall_into_segments(spark):
    rows = [(1, i, "system" if i == 0 else ["user", "assistant"][i % 2], f"turn {i} " + "x" * (i % 40)) for i in range(300)]
    rows += [(2, i, ["user", "assistant"][i % 2], f"say {i}") for i in range(90)] + [(3, 0, "user", "hi"), (None, 1, "assistant", "none")]
    rows += [(4, 5, "assistant", "same")] * 70
    df = frame(spark, rows)
    windows = chat.format_windows(df, 60, 20, most_turns=32, most_tokens=400)
    got = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    for c, turns in conversations(rows).items():
        assert got[c]["n_turns"] == len(turns) and got[c]["turns_sha256"] == sha("".join(f"{r}\n{x}\n" for r, x in turns))
        assert got[c]["loss_sha256"] == sha("".join(x for r, x in turns if r == "assistant"))
    long = windows.where("conv_id = 1").collect()
    assert len({w["segment"] for w in long}) > 9 and all(w["tokens"] <= 60 for w in long)
    assert all(w["formatted"].startswith("<|im_start|>system\nturn 0 ") and (w["repeated"] > 0) == ((w["segment"], w["window"]) != (0, 0)) for w in long)
    # Every segment has its turns, and only the system turn beside them.
    most = {}
    for w in long:
        most[w["segment"]] = most.get(w["segment"], 0) + w["formatted"].count("<|im_start|>") - w["repeated"]
    assert max(most.values()) <= 32 and sum(most.values()) == 300


def test_awkward_rows(spark):
    rows = [(1, None, None, None), (1, 2, "assistant", "b"), (1, 2, "assistant", "b"), (None, 0, "assistant", ""), (2, 0, "a\\n\nb<|im_end|>", "x" * 50_000), (2, 1, "assistant", "word " * 30_000)]
    df = frame(spark, rows)
    check(chat.format_windows(df, 64, 16), rows, 64, 16)
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_windows(df)).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 2 and got[None]["loss_sha256"] == sha("")
    none = df.where("conv_id = 99")
    assert chat.format_windows(none).count() == 0 and chat.read_back(chat.format_windows(none)).count() == 0


def test_no_python_in_the_plan(spark, sf):
    out = chat.read_back(chat.format_windows(chat.with_probe(spark.read.parquet(f"{sf}/conversations.parquet"))))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
