import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F
from seqloom.llm import chat

TURNS = "conv_id bigint, turn bigint, role string, text string, window string, n int"


def corpus():
    rng = random.Random(3)
    bits = ["a", "\\", "<", "\\l", "</turn>", '<turn role="assistant">', "\n", "é🦆", '">', "word " * 30, "x " * 300]
    rows = []
    for c in range(40):
        n = rng.choice([1, 2, 5, 30])
        for t in range(n):
            role = "system" if t == 0 and c % 3 == 0 else ["user", "assistant"][t % 2]
            rows.append((c, t, role, "".join(rng.choice(bits) for _ in range(rng.randint(0, 8))), "w", 1))
    rows += [(90, 0, None, None, "w", 1), (90, 1, "assistant", "", "w", 1), (90, 1, "assistant", "", "w", 1), (None, 3, "assistant", "z", "w", 1), (None, 3, "assistant", "a", "w", 1), (91, 5, "rö<le\\", "t", "w", 1)]
    return rows


def expected(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted((t, role or "", text or "") for cc, t, role, text, *_ in rows if cc == c)
        told = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        out[c] = (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("budget,history,turns", [(512, 128, 2), (40, 10, 3), (8, 0, 0)])
def test_read_back(spark, budget, history, turns):
    rows = corpus()
    windows = chat.format_windows(spark.createDataFrame(rows, TURNS), budget, history, turns)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.conversation_digests(windows).collect()}
    assert got == expected(rows)


def cost(role, text):
    return chat.TAGS + sum(len(re.findall(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]", x)) for x in (role, text))


@pytest.mark.parametrize("budget,history,system", [(120, 40, 2), (512, 128, 200), (512, 128, 0), (512, 128, 450)])
def test_windows_keep_to_the_budget(spark, budget, history, system):
    rng = random.Random(7)
    rows = [(1, 0, "system", "s " * system, "w", 1)] * bool(system) + [(1, t, ["user", "assistant"][t % 2], "w " * rng.choice([3, 9, budget // 5, budget // 2, budget]), "w", 1) for t in range(1, 60)]
    windows = chat.format_windows(spark.createDataFrame(rows, TURNS), budget, history, 2).orderBy("window")
    windows = [(w, [(t.role, t.text) for t in r.turns]) for w, r in zip(windows.collect(), chat.read_windows(windows.withColumn("n_repeated", F.lit(0))).orderBy("window").collect(), strict=True)]
    assert len(windows) > 4
    for w, turns in windows:
        total, new = sum(cost(*t) for t in turns), turns[w.n_repeated :]
        head = cost("system", "s " * system) if system else 0
        assert total <= budget or (len(new) == 1 and head + cost(*new[0]) > budget and w.n_repeated <= bool(system))
        assert not system or turns[0] == ("system", "s " * system)
    assert any(w.n_repeated > 1 for w, _ in windows) or system == 450
    counted = "".join(w.formatted[s.start : s.start + s.length] for w, _ in windows for s in w.loss)
    assert counted == "".join(r[3] for r in rows if r[2] == "assistant")


def test_roles_hold_no_control_strings(spark):
    rows = [(1, i, role, "hello \\q", "w", 1) for i, role in enumerate(['x">y', '"', "\\q", '\\"<', "assistant"])]
    read = chat.read_windows(chat.format_windows(spark.createDataFrame(rows, TURNS))).first()
    assert [(t.role, t.text) for t in read.turns] == [(r[2], r[3]) for r in rows]


def test_empty(spark):
    assert chat.conversation_digests(chat.format_windows(spark.createDataFrame([], TURNS))).count() == 0
