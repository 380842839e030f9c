from __future__ import annotations

import random
import re

from touchline.llm import chat
from touchline.llm.queries import QUERIES


def brute(rows):
    convs = {}
    for conv, turn, role, text in set(rows):
        if conv is not None:
            convs.setdefault(conv, []).append((turn, role, text))
    low = lambda v: (v is not None, v)
    convs = {
        c: [t[1:] for t in sorted(ts, key=lambda t: tuple(map(low, t)))] for c, ts in convs.items()
    }
    out = []
    for conv, turns in convs.items():
        copies = [c for c, ts in convs.items() if ts == turns]
        longer = any(len(ts) > len(turns) and ts[: len(turns)] == turns for ts in convs.values())
        if conv == min(copies) and not longer:
            text = "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in turns)
            out.append((conv, len(turns), len(copies), text))
    return sorted(out)


def test_snapshots_collapse_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 3)
    rng = random.Random(2)
    rows = []
    for conv in range(120):
        turns = [(rng.choice("ua"), rng.choice(["x", "y", None, ""])) for _ in range(9)]
        if rows and rng.random() < 0.6:  # a beginning of another conversation
            other = rng.randrange(conv)
            turns = [(r, t) for c, _, r, t in rows if c == other]
        start = rng.randrange(5)
        rows += [
            (conv, start + i * rng.choice([1, 1]), r, t)
            for i, (r, t) in enumerate(turns[: rng.randrange(1, 10)])
        ]
    rows += [(500, i, "u", f"t{i}") for i in range(400)] + [(501, i, "u", f"t{i}") for i in range(399)]
    rows += [(None, 0, "u", "lost"), (600, None, "s", "first"), (600, 1, None, None), rows[0]]
    schema = "conv_id long, turn int, role string, text string"
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 AS place", "2 AS conv")
    found = chat.maximal_conversations(df.repartition(3))
    assert sorted(map(tuple, found.collect())) == brute(rows)
    assert chat.maximal_conversations(df.limit(0)).count() == 0


def test_markers_in_texts_are_taken_out(spark):
    df = spark.createDataFrame(
        [(1, 0, "user", "a<|im_end|>b")], "conv_id long, turn int, role string, text string"
    )
    assert chat.maximal_conversations(df).first().text == "<|im_start|>user\nab<|im_end|>\n"


def test_nothing_runs_in_python(spark, small, plan_of):
    assert not re.search("Python|Pandas|Arrow", plan_of(QUERIES["op3_chat"](spark, small)))
