"""Quality rules: counts of a text, and a decision list learned from labelled statistics.

Everything is DataFrame and SQL expressions; the driver sees histograms of bounded size only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.frames import SPACE, fold
from touchline.session import stage

WINDOW = 8
BASE_FAILED = "{c}n_words < 20 OR 100 * {c}n_repeat_words > 30 * {c}n_words"

# What the conditions of a learned rule may test, from the counts of a text.
MEASURES = {
    "words": "CAST({c}n_words AS DOUBLE)",
    "chars_per_word": "{c}word_chars / greatest({c}n_words, 1)",
    "symbols_per_word": "{c}n_symbols / greatest({c}n_words, 1)",
    "duplicate_lines": "{c}n_dup_lines / greatest({c}n_lines, 1)",
    "repeated_words": "{c}n_repeat_words / greatest({c}n_words, 1)",
    "capitals": "{c}n_capitals / greatest({c}word_chars, 1)",
    "digits": "{c}n_digits / greatest({c}word_chars, 1)",
    "marks_per_word": "{c}n_marks / greatest({c}n_words, 1)",
    "echoed_words": "{c}n_echoes / greatest({c}n_words, 1)",
    "words_per_line": "{c}n_words / greatest({c}n_lines, 1)",
}


def _overlap(column: str, shift: int) -> str:
    """Hashes of neighbours ``shift`` apart, which doubles the run a hash stands for."""
    rest = f"greatest(0, size({column}) - {shift})"
    return (
        f"zip_with(slice({column}, 1, {rest}), slice({column}, {shift + 1}, {rest}),"
        " (a, b) -> xxhash64(a, b))"
    )


def counts(docs: DataFrame, text_col: str, into: str) -> DataFrame:
    """``docs`` with a struct column ``into`` of counts and measures; NULL counts as empty.

    Windows are compared by 64-bit hash within their text: two different windows of one text
    with a million words agree with a chance below 1e-7. Only texts with a repeated window sort
    their windows.
    """
    name = "_" + into
    text, words, lines, hashes, pairs, quads, grams, order, again = (
        f"`{name}_{part}`" for part in "text words lines hashes pairs quads grams order again".split()
    )

    def add(df: DataFrame, **columns: str) -> DataFrame:
        return df.withColumns({f"{name}_{k}": F.expr(v) for k, v in columns.items()})

    df = docs.withColumn(f"{name}_text", F.coalesce(F.col(text_col), F.lit("")))
    space = SPACE.replace("\\", "\\\\")
    df = add(
        df,
        words=f"array_remove(split({text}, '{space}+'), '')",
        lines=f"filter(split({text}, '\\n'), l -> l RLIKE '[^{space[1:]}')",
    )
    df = add(df, hashes=f"transform({words}, w -> xxhash64(w))")
    df = add(df, pairs=_overlap(hashes, 1))
    df = add(df, quads=_overlap(pairs, 2))
    df = add(df, grams=_overlap(quads, 4))
    df = add(
        df,
        order=f"""if(size(array_distinct({grams})) < size({grams}),
            sort_array(transform({grams}, (h, i) -> struct(h AS h, i AS i))), NULL)""",
    )
    df = add(
        df,
        again=f"""sort_array(filter(transform({order}, (e, k) ->
            if(e.h <=> get({order}, k - 1).h OR e.h <=> get({order}, k + 1).h, e.i, NULL)),
            i -> i IS NOT NULL))""",
    )

    def only(characters: str) -> str:
        return f"CAST(length(regexp_replace({text}, '[^{characters}]+', '')) AS LONG)"

    found = F.expr(
        f"""named_struct(
        'n_words', CAST(size({words}) AS LONG),
        'word_chars', CAST(length(array_join({words}, '')) AS LONG),
        'n_symbols', {only("#*$%&|<>")},
        'n_lines', CAST(size({lines}) AS LONG),
        'n_dup_lines', CAST(size({lines}) - size(array_distinct({lines})) AS LONG),
        'n_repeat_words', CAST(coalesce(aggregate({again},
            named_struct('n', 0, 'last', -{WINDOW}),
            (s, i) -> named_struct('n', s.n + least({WINDOW}, i - s.last), 'last', i),
            s -> s.n), 0) AS LONG),
        'n_echoes', CAST(size(filter({hashes},
            (h, i) -> coalesce(h = get({hashes}, i - 1), false))) AS LONG),
        'n_capitals', {only("A-Z")},
        'n_digits', {only("0-9")},
        'n_marks', {only("!?")})"""
    )
    whole = df.select(*(F.col(f"`{c}`") for c in docs.columns), found.alias(into))
    derived = {**MEASURES, "base_failed": BASE_FAILED}
    more = (F.expr(sql.format(c=f"`{into}`.")).alias(m) for m, sql in derived.items())
    return whole.withColumn(into, F.struct(f"`{into}`.*", *more))


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    cut: float

    def sql(self, prefix: str = "") -> str:
        return f"{prefix}{self.measure} {'>=' if self.above else '<'} {self.cut!r}D"


@dataclass
class DecisionList:
    """Rules in order; the first that holds rejects, a text that meets none is kept."""

    rules: list[list[Condition]] = field(default_factory=list)

    def sql(self, prefix: str = "") -> str:
        cases = [" AND ".join(c.sql(prefix) for c in rule) for rule in self.rules]
        whens = " ".join(f"WHEN {case} THEN false" for case in cases)
        return f"CASE {whens} ELSE true END" if cases else "true"


def _held(conditions: list[Condition]) -> str:
    return " AND ".join(["true", *(c.sql() for c in conditions)])


def _histogram(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[str, list[list[int]]]:
    """Bad and good rows by measure and interval; one small row per interval reaches the driver."""
    places = [
        f"struct('{m}' AS measure, "
        f"size(filter(array({', '.join(f'{c!r}D' for c in cut)}), c -> c <= {m})) AS place)"
        for m, cut in cuts.items()
    ]
    found = (
        rows.select("bad", F.expr(f"inline(array({', '.join(places)}))"))
        .groupBy("measure", "place")
        .agg(F.sum("bad").alias("bad"), F.sum(F.lit(1) - F.col("bad")).alias("good"))
        .collect()
    )
    out = {m: [[0, 0] for _ in range(len(cut) + 1)] for m, cut in cuts.items()}
    for r in found:
        out[r.measure][r.place] = [r.bad, r.good]
    return out


def _best(cuts: dict[str, list[float]], histogram: dict[str, list[list[int]]]) -> tuple:
    """The condition with the highest information gain times bad rows covered, and its counts."""
    bad = good = 0
    for counts_ in histogram.values():
        bad, good = sum(b for b, _ in counts_), sum(g for _, g in counts_)
        break
    if not bad or not good:
        return None, bad, good
    before = math.log2(bad / (bad + good))
    best = (0.0, None, bad, good)
    for measure, cut in cuts.items():
        below_bad = below_good = 0
        for i, value in enumerate(cut):
            below_bad += histogram[measure][i][0]
            below_good += histogram[measure][i][1]
            for above, b, g in (
                (True, bad - below_bad, good - below_good),
                (False, below_bad, below_good),
            ):
                if b:
                    gain = b * (math.log2(b / (b + g)) - before)
                    if gain > best[0] + 1e-9:
                        best = (gain, Condition(measure, above, value), b, g)
    return best[1:]


def learn(
    labelled: DataFrame,
    max_rules: int = 12,
    max_conditions: int = 4,
    cuts: int = 40,
    least_precision: float = 0.8,
    least_rows: int = 3,
) -> DecisionList:
    """Sequential covering over ``labelled``: the measures, ``bad`` (1 or 0) and ``grow``.

    A rule grows on two thirds of the rows by the condition with the best gain until it covers no
    good row, and is pruned on the rest to the beginning with the best balance of bad over good
    rows. It joins the list if enough of what it covers in either part is bad; the covered rows
    leave and the next rule starts. Every step is one aggregation over all labelled rows.
    """
    fractions = [(i + 1) / (cuts + 1) for i in range(cuts)]
    asked = [
        F.expr(f"percentile_approx({m}, array({', '.join(map(str, fractions))}), 10000)").alias(m)
        for m in MEASURES
    ]
    # Cuts from the bad rows too: they are few, and the middle of all rows says little of them.
    found = [labelled.agg(*asked).first(), labelled.where("bad = 1").agg(*asked).first()]
    values = {m: sorted({v for row in found for v in row[m] or []}) for m in MEASURES}
    values = {m: cut for m, cut in values.items() if cut}
    learned = DecisionList()
    rest = labelled
    while values and len(learned.rules) < max_rules:
        rule: list[Condition] = []
        while len(rule) < max_conditions:
            grow = rest.where("grow").where(_held(rule))
            condition, _, good = _best(values, _histogram(grow, values))
            if condition is None:
                break
            rule.append(condition)
            if not good:
                break
        if not rule:
            break
        rule = _prune(rest, rule, least_precision, least_rows)
        if not rule:
            break
        learned.rules.append(rule)
        rest = rest.where(f"NOT ({_held(rule)})")
    return learned


def _prune(
    rest: DataFrame, rule: list[Condition], least_precision: float, least_rows: int
) -> list[Condition]:
    sums = []
    for i in range(1, len(rule) + 1):
        held = _held(rule[:i])
        for part, name in (("NOT grow", "prune"), ("true", "all")):
            for kind in ("bad", "1 - bad"):
                amount = f"sum(if({held} AND {part}, {kind}, 0))"
                sums.append(F.expr(f"coalesce({amount}, 0)").alias(f"{name}_{i}_{kind[0]}"))
    row = rest.agg(*sums).first()
    best, chosen = -1.0, []
    for i in range(1, len(rule) + 1):
        bad, good = row[f"prune_{i}_b"], row[f"prune_{i}_1"]
        all_bad, all_good = row[f"all_{i}_b"], row[f"all_{i}_1"]
        value = (bad - good) / (bad + good + 1)
        enough = all_bad >= least_rows and all_bad >= least_precision * (all_bad + all_good)
        if enough and bad >= least_precision * (bad + good) and value > best:
            best, chosen = value, rule[:i]
    return chosen


def _labelled(counted: DataFrame, labels: DataFrame, id_col: str, quality_col: str) -> DataFrame:
    """Measures of labelled documents; a document labelled both ways counts as its majority."""
    marks = (
        labels.select(F.col(id_col).alias("doc"), F.col(quality_col).cast("double").alias("good"))
        .where("doc IS NOT NULL AND good IS NOT NULL")
        .groupBy("doc")
        .agg(F.avg("good").alias("good"))
        .select("doc", F.expr("if(good >= 0.5, 0, 1)").alias("bad"))
    )
    return counted.join(marks, "doc").select(
        "bad", (fold("doc", 3) != 0).alias("grow"), *MEASURES
    )


def judged(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    quality_col: str = "quality",
    **options,
) -> DataFrame:
    """(doc, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept).

    One row per row of ``docs``. ``kept`` is false where the base rules fail or the learned list
    rejects. NULL and empty texts have zero counts and fail the base rules; rows without an id
    are judged but teach nothing; without labels, or with labels of one kind, the list is empty;
    repeated rows give repeated results.
    """
    chosen = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    counted = stage(counts(chosen, "text", "counts").select("doc", "counts.*"), "counts")
    verdict = learn(stage(_labelled(counted, labels, id_col, quality_col), "labelled"), **options)
    return counted.withColumn("kept", F.expr(f"NOT base_failed AND {verdict.sql()}")).drop(
        *MEASURES
    )


def keep_good(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    quality_col: str = "quality",
    **options,
) -> DataFrame:
    """The rows of ``docs`` that :func:`judged` keeps, read and counted once."""
    struct = "rule_counts"
    while any(c.lower().startswith((struct, f"_{struct}")) for c in docs.columns):
        struct = "_" + struct  # neither it nor the steps on the way to it take a caller's name
    counted = stage(counts(docs, text_col, struct), "counted", "zstd")
    known = counted.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{struct}`.*"))
    verdict = learn(stage(_labelled(known, labels, id_col, quality_col), "labelled"), **options)
    prefix = f"`{struct}`."
    return counted.where(f"NOT {prefix}base_failed AND {verdict.sql(prefix)}").select(
        *(F.col(f"`{c}`") for c in docs.columns)
    )
