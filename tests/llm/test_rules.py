from __future__ import annotations

import re
from collections import Counter

from touchline.llm import rules
from touchline.llm.frames import table
from touchline.llm.queries import QUERIES


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen, covered = Counter(grams), set()
    for i, gram in enumerate(grams):
        if seen[gram] > 1:
            covered.update(range(i, i + 8))
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
    )


def counted(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words


def test_query_counts_equal_brute_force(spark, small):
    texts = {r.doc_id: r.text for r in table(spark, small, "documents").collect()}
    found = QUERIES["op10_quality_rules"](spark, small).collect()
    assert len(found) == len(texts)
    for r in found:
        assert counted(r) == brute(texts[r.doc_id])
        failed = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)


def test_nothing_runs_in_python(spark, small, plan_of):
    df = QUERIES["op10_quality_rules"](spark, small)
    assert not re.search("Python|Pandas|Arrow", plan_of(df))
    assert not re.search("Python|Pandas|Arrow", plan_of(rules.counts(df, "doc_id", "c")))


def test_odd_texts(spark):
    run = " ".join(f"w{i}" for i in range(9))
    texts = [None, "", " \n\t\n", "a", f"{run} {run}", f"{run}\x0b{run}\r{run}", "x " * 5000,
             "é 中文 😀|<\n\né 中文 😀|<\n \n", "a b\nA b\na b\na b \n", "\x1c\x85 b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs = docs.withColumn("_c_text", docs.text)
    found = rules.counts(docs, "text", "c").collect()
    assert [counted(r.c) for r in found] == [brute(t) for t in texts]


def corpus(spark):
    good = [(i, " ".join(f"word{(i * 7 + j * j) % 997}" for j in range(40)), 1) for i in range(90)]
    bad = [(100 + i, " ".join(f"w{(i + 1) * j}$$$" for j in range(30)), 0) for i in range(30)]
    return spark.createDataFrame(good + bad, "doc_id long, text string, quality int")


def test_learns_what_labels_say(spark):
    rows = corpus(spark)
    docs, labels = rows.select("doc_id", "text"), rows.select("doc_id", "quality")
    found = {r.doc: r.kept for r in rules.judged(docs, labels).collect()}
    assert {doc for doc, kept in found.items() if not kept} == set(range(100, 130))
    clash = docs.withColumn("rule_counts", docs.doc_id).withColumn("words", docs.doc_id)
    kept = rules.keep_good(clash, labels)
    assert kept.columns == clash.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(90))


def test_without_labels_only_the_base_rules_reject(spark):
    rows = corpus(spark)
    docs, labels = rows.select("doc_id", "text"), rows.select("doc_id", "quality")
    odd = docs.union(spark.createDataFrame([(None, None), (1, "few words")], docs.schema))
    for given in (labels.limit(0), labels.where("quality = 1")):
        found = rules.judged(odd, given).collect()
        assert len(found) == 122 and sum(r.kept for r in found) == 120
    assert rules.judged(docs.limit(0), labels).count() == 0
    nulls = labels.selectExpr("doc_id", "if(doc_id % 2 = 0, NULL, quality) AS quality").union(
        spark.createDataFrame([(None, 0)], "doc_id long, quality int")
    )
    assert rules.judged(odd, nulls).where("doc IS NULL AND kept").count() == 0


def test_columns_of_the_caller_come_back(spark):
    """Names that the counting uses on its way stay the caller's."""
    kinds = "doc_id long, text string, rule_counts string, _rule_counts_text string, _Rule_counts_words int"
    text = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, "a", "b", 3)], kinds)
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    kept = rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, text, "a", "b", 3)]
