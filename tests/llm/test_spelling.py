"""Spelling variants against every pair of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from touchline.llm import spelling

SCHEMA = "doc_id long, text string, word string, n int"
COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def near(x: str, y: str) -> bool:
    if abs(len(x) - len(y)) > 1 or x == y:
        return False
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    if len(x) < len(y):
        x, y = y, x
    return any(x[:i] + x[i + 1 :] == y for i in range(len(x)))


def brute(docs: list[tuple], loses: int) -> list[tuple]:
    counts: Counter = Counter()
    for doc, text in docs:
        lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for run in re.findall("[A-Za-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % loses == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    forms, beside = {}, {}
    for w, n in words.items():
        own = [v for v in words if near(w, v)]
        beside[w] = len(own)
        best = min(own, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        form = forms[w]
        out.append((w, form, root, n, beside[w], words[form] if form else None))
    return sorted(out, key=str)


def found(spark, docs: list[tuple], loses: int) -> list[tuple]:
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], SCHEMA).repartition(3)
    rows = spelling.variants(df, loses=loses)
    assert rows.columns == COLUMNS
    return sorted((tuple(r) for r in rows.collect()), key=str)


def _random(seed: int, letters: str, lengths: range, words: int) -> list[tuple]:
    rng = random.Random(seed)
    names = ["".join(rng.choices(letters, k=rng.choice(lengths))) for _ in range(words)]
    docs = [(i, " ".join(rng.choices(names, weights=range(1, words + 1), k=40)) + ". 9x") for i in range(60)]
    return docs + docs[:3] + [(None, docs[0][1]), (7, None), (8, ""), (9, "12 -- ..")]


def _chain() -> str:
    return " ".join(w for k, w in enumerate(["abcde", "abcdf", "abcgf", "abhgf"]) for _ in range(3 * 2**k))


def _long(rng: random.Random) -> list[str]:
    word = "".join(rng.choices("ab", k=90))
    same = "a" * 70
    return [
        word, word[:40] + word[41:], word[:89] + "c", "c" + word, word[:64], word[:65], word[:63],
        same, same[1:], same + "a", same[:30] + "b" + same[31:], same[:63], same[:64],
    ]


@pytest.mark.parametrize(
    "docs",
    [
        [],
        [(1, None), (2, "abcd abcd abcd")],
        _random(1, "ab", range(4, 9), 60),
        _random(2, "abéÿÀZ", range(3, 7), 150),
        [(1, _chain()), (2, "Abcde ABCDE")],
        [(i, " ".join(_long(random.Random(3)) * 2)) for i in range(3)],
    ],
    ids=["empty", "no words", "dense", "accents", "chain", "long"],
)
def test_variants_equal_all_pairs(spark, docs):
    assert found(spark, docs, 5 if len(docs) > 5 else 97) == brute(docs, 5 if len(docs) > 5 else 97)
