"""Quality rules under weak supervision.

Each rule looks at a few counts of a text and votes good or bad or abstains. No rule must pass: a class-conditional
model of the votes is fitted by expectation-maximisation, which estimates for each rule how often it votes either way
on good and on bad texts, and a text stays if its posterior probability of being good is 0.5 or more. An abstention
says nothing. Only counts of vote patterns leave the executors: with r rules at most 3 ** r rows, whatever the input.

Texts may be null (no words), empty or very long; a null doc_id stays null; repeated rows are judged each on its own;
other columns, of whatever name, are left alone. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, checkpointed, let

BLANKS = " \t\n\x0b\x0c\r"


def repeated_words(words: Column) -> Column:
    """Words inside windows of three words that occur at least twice in `words`. Windows are told apart by a 64-bit hash."""

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda a, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - a, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda total, x: total + x).cast("long")

    def repeats(windows: Column) -> Column:
        def starts(ordered: Column) -> Column:
            def start(window: Column, k: Column) -> Column:
                near = (window.h == F.get(ordered, k - 1).h) | (window.h == F.get(ordered, k + 1).h)
                return F.when(near, window.i)

            return F.sort_array(F.array_compact(F.transform(ordered, start)))

        ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        found = let(let(ordered, starts), covered)
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(found)

    def windows(w: Column) -> Column:
        h = F.transform(
            F.slice(w, F.lit(1), F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))
        )
        return F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(let(h, repeats))

    return let(words, windows)


def counts(text: Column) -> Column:
    """What the rules look at, as a struct of longs; a null text counts as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))

    def of(t: Column) -> Column:
        words = F.filter(F.split(t, SPACES), lambda x: x != "")
        lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")

        def build(w: Column) -> Column:
            return let(lines, lambda ls: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                repeated_words(w).alias("n_repeat_words"),
                F.size(ls).cast("long").alias("n_lines"),
                F.regexp_count(t, F.lit(r"[^\p{L}\x20\x09-\x0D]")).cast("long").alias("n_not_letters"),
                F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
                F.regexp_count(t, F.lit("!")).cast("long").alias("n_exclaims"),
            ))

        return let(words, build)

    return let(text, of)


def base_failed(c: Column) -> Column:
    return (c.n_words < 50) | (100 * c.n_repeat_words > 50 * c.n_words)


#: name, votes bad, votes good (None: never); otherwise the rule abstains. c is a struct of counts().
RULES = (
    ("symbols", lambda c: 10 * c.n_symbols > c.n_words, None),
    (
        "letters",
        lambda c: 100 * (c.word_chars - c.n_not_letters) < 88 * c.word_chars,
        lambda c: 100 * (c.word_chars - c.n_not_letters) > 93 * c.word_chars,
    ),
    ("capitals", lambda c: 10 * c.n_capitals > 4 * F.greatest(F.lit(1), c.word_chars - c.n_not_letters), None),
    ("exclaims", lambda c: 10 * c.n_exclaims > 3 * c.n_words, None),
    ("repeats", lambda c: 10 * c.n_repeat_words > 4 * c.n_words, lambda c: (10 * c.n_repeat_words < c.n_words) & (c.n_words >= 20)),
    ("lines", lambda c: 10 * c.n_dup_lines > 3 * c.n_lines, None),
    (
        "word_length",
        lambda c: (c.n_words > 0) & ((c.word_chars > 12 * c.n_words) | (c.word_chars < 2 * c.n_words)),
        lambda c: (c.word_chars >= 3 * c.n_words) & (c.word_chars <= 7 * c.n_words) & (c.n_words > 0),
    ),
    ("size", lambda c: c.n_words == 0, lambda c: c.n_words >= 100),
)


def votes(c: Column) -> list[Column]:
    """1 good, 0 bad, null abstains; one for each rule."""
    out = []
    for _, bad, good in RULES:
        vote = F.when(bad(c), F.lit(0))
        out.append(vote.when(good(c), F.lit(1)) if good else vote)
    return out


@dataclass(frozen=True)
class Model:
    """Log odds of good: before any vote, and what a good or a bad vote of each rule adds."""

    prior: float
    good: tuple[float, ...]
    bad: tuple[float, ...]

    def posterior(self, c: Column) -> Column:
        total = F.lit(self.prior)
        for vote, good, bad in zip(votes(c), self.good, self.bad, strict=True):
            total = total + F.when(vote == 1, F.lit(good)).when(vote == 0, F.lit(bad)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def log_odds(pattern: tuple[int | None, ...], prior: float, table: list[dict]) -> float:
    return prior + sum(math.log(t[1][v] / t[0][v]) for t, v in zip(table, pattern, strict=True) if v is not None)


def estimate(patterns: dict[tuple[int | None, ...], int], rounds: int = 50) -> Model:
    """Expectation-maximisation over counted vote patterns (1, 0 or None for each rule).

    The first posterior is the share of good votes, bad votes counting threefold. Every estimate is smoothed by one
    imaginary text, so no probability is 0 or 1. Without patterns the model knows nothing: posterior 0.5.
    """
    rules = len(RULES)
    ordered = sorted(patterns.items(), key=str)  # the order of summing is fixed, and so are the results
    good = {p: (1 + sum(v == 1 for v in p)) / (2 + sum(v == 1 for v in p) + 3 * sum(v == 0 for v in p)) for p, _ in ordered}
    n = sum(patterns.values())
    prior, table = 0.0, [{y: {v: 1 / 3 for v in (None, 0, 1)} for y in (0, 1)} for _ in range(rules)]
    for _ in range(rounds if n else 0):
        share = (1 + sum(c * good[p] for p, c in ordered)) / (n + 2)
        prior = math.log(share / (1 - share))
        for j in range(rules):
            for y in (0, 1):
                mass = {None: 1.0, 0: 1.0, 1: 1.0}
                for p, c in ordered:
                    mass[p[j]] += c * (good[p] if y else 1 - good[p])
                total = sum(mass.values())
                table[j][y] = {v: m / total for v, m in mass.items()}
        good = {p: 1 / (1 + math.exp(min(500.0, -log_odds(p, prior, table)))) for p, _ in ordered}
    ratio = [{v: math.log(t[1][v] / t[0][v]) for v in (0, 1)} for t in table]
    return Model(prior, tuple(r[1] for r in ratio), tuple(r[0] for r in ratio))


def fit(counted: DataFrame, column: str = "c") -> Model:
    """The model of all rows of a table with a struct of counts()."""
    names = [f"v{j}" for j in range(len(RULES))]
    rows = (
        counted.select(*(v.alias(n) for v, n in zip(votes(F.col(column)), names, strict=True)))
        .groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()
    )
    return estimate({tuple(r[n] for n in names): r["n"] for r in rows})


def judge(documents: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, posterior and kept for each row of `documents` (doc_id, text)."""
    counted = checkpointed(documents.select("doc_id", counts(F.col("text")).alias("c")))
    model = fit(counted)
    c = F.col("c")
    return counted.select("doc_id", "c", model.posterior(c).alias("posterior")).select(
        "doc_id", "c.*", base_failed(c).alias("base_failed"), "posterior",
        (~base_failed(c) & (F.col("posterior") >= 0.5)).alias("kept"),
    )


def keep_good(documents: DataFrame) -> DataFrame:
    """The rows of `documents` that judge() keeps, all columns as they were.

    Texts are read twice, once for the model and once to decide; nothing is joined, shuffled or stored.
    """
    model = fit(documents.select(counts(F.col("text")).alias("c")))
    return documents.where(let(counts(F.col("text")), lambda c: ~base_failed(c) & (model.posterior(c) >= 0.5)))
