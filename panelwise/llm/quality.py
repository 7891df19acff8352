"""Quality rules by weak supervision, in DataFrame functions only.

Each rule votes good (1), votes bad (0) or abstains. The votes of all documents make a histogram of
vote patterns; its size is bounded by 3 ** len(RULES), whatever the number of documents. Expectation
maximisation over that histogram estimates how often each rule is right about good and about bad
documents, and the posterior probability that a document is good replaces all-must-pass filtering.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, SPACE, cut, keep_row, let, row_ids

#: Common function words of the languages that the rules know.
STOP_WORDS = (
    "the of and to in is that for it was with as be on by are this an at from a "
    "der die das und in zu den von mit ist des im nicht ein eine auf dem sich "
    "de la le les et des en un une du que est pour dans qui sur par au pas "
    "el los las y del se por con su para una al lo no es"
).split()


@dataclass(frozen=True)
class Rule:
    """Good where ``good`` holds, bad where ``bad`` holds (bad wins), otherwise no vote."""

    name: str
    good: str
    bad: str


#: Votes over the features of ``quality_features``. Most rules know one kind of junk only and
#: abstain on anything else: an absent fault is no evidence of quality.
RULES = (
    Rule("length", "n_words >= 40", "n_words < 20"),
    Rule("stop_words", "100 * n_stop >= 8 * n_words", "100 * n_stop < 2 * n_words"),
    Rule("word_length", "false", "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    Rule("symbols", "false", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "false", "10 * n_dup_lines > 3 * n_lines"),
    Rule("repeated_words", "false", "100 * n_repeat_words > 25 * n_words"),
    Rule("capitals", "false", "100 * n_upper > 40 * word_chars"),
    Rule("shouting", "false", "100 * n_shout > 30 * n_words"),
    Rule("variety", "false", "100 * n_distinct < 15 * n_words and n_distinct < 100"),
)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"([^{SPACE}]+)"), F.lit(1))


def _pairs(span: int):
    """Joins each hash with the one ``span`` places on."""

    def body(h: Column) -> Column:
        first = F.slice(h, 1, F.greatest(F.size(h) - span, F.lit(0)))
        return F.zip_with(first, F.slice(h, span + 1, F.greatest(F.size(h), F.lit(1))), lambda a, b: F.xxhash64(a, b))

    return body


def _window_hashes(words: Column, width: int) -> Column:
    """64-bit hashes of all ``width``-word windows; ``width`` is a power of two, doubled step by step."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    span = 1
    while span < width:
        hashes = let(hashes, _pairs(span))
        span *= 2
    return hashes


def _covered(hashes: Column, width: int) -> Column:
    """Words inside windows whose hash occurs twice or more. Texts without such a window skip the sort."""

    def sorted_positions(h: Column) -> Column:
        at = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(
            at,
            lambda s: let(
                F.transform(s, lambda x: x["h"]),
                lambda k: F.sort_array(
                    F.transform(
                        F.filter(
                            F.zip_with(
                                F.zip_with(s, F.concat(F.array(F.lit(None).cast("long")), F.slice(k, 1, F.greatest(F.size(k) - 1, F.lit(0)))), lambda x, before: F.struct(x.alias("x"), (before == x["h"]).alias("same"))),
                                F.slice(k, 2, F.greatest(F.size(k), F.lit(1))),
                                lambda x, after: F.struct(x["x"]["i"].alias("i"), (F.coalesce(x["same"], F.lit(False)) | F.coalesce(after == x["x"]["h"], F.lit(False))).alias("twice")),
                            ),
                            lambda x: x["twice"],
                        ),
                        lambda x: x["i"],
                    )
                ),
            ),
        )

    def total(p: Column) -> Column:
        steps = F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(width)), F.lit(width)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda n, x: n + x)

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(sorted_positions(h), total)))


def _without(text: Column, characters: str) -> Column:
    """Characters of ``text`` in a class."""
    return F.length(F.regexp_replace(text, f"[^{characters}]+", "")).cast("long")


def quality_features(docs: DataFrame) -> DataFrame:
    """Counts of each row: the base counts and what the rules read. Null text has no words.

    Adds to the row's ids r1 and r2: n_words, word_chars, n_symbols, n_dup_lines, n_lines,
    n_repeat_words, n_upper, n_stop, n_shout, n_distinct (all long). Whole texts are counted.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    stop = list(dict.fromkeys(STOP_WORDS))  # literals, which Spark makes a hash set

    def of_words(w: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.size(F.filter(w, lambda x: (F.length(x) <= 5) & F.lower(x).isin(stop))).cast("long").alias("n_stop"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            _covered(_window_hashes(w, 8), 8).alias("n_repeat_words"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("lines"),
        )

    counted = docs.select(
        F.col("doc_id"),
        *row_ids(),
        let(_words(text), of_words).alias("c"),
        _without(text, r"#*$%&|<>").alias("n_symbols"),
        _without(text, r"\p{Lu}").alias("n_upper"),
        _without(text, "!").alias("n_shout"),
    )
    return counted.select(
        "doc_id", "r1", "r2", "c.n_words", "c.word_chars", "n_symbols", "c.lines.n_dup_lines", "c.n_repeat_words", "c.lines.n_lines", "n_upper", "c.n_stop", "n_shout", "c.n_distinct"
    )


def votes(features: DataFrame, rules=RULES) -> DataFrame:
    """Adds ``pattern``: one digit a rule, 1 good, 0 bad, 2 no vote."""
    digits = [F.when(F.expr(r.bad), F.lit("0")).when(F.expr(r.good), F.lit("1")).otherwise(F.lit("2")) for r in rules]
    return features.withColumn("pattern", F.concat(*digits))


def fit_votes(patterns: dict[str, int], rounds: int = 60, anchor: float = 0.02) -> dict[str, float]:
    """Posterior probability of good for each vote pattern, by expectation maximisation.

    For each class a rule votes good, bad or not at all with probabilities that are estimated (its
    accuracies). Posteriors start at 0.9 without and 0.1 with a bad vote, and ``anchor`` times the
    number of documents is added to each estimate as votes like those of a rule that is mostly
    right, so that the classes cannot change places. Equal input gives equal output.
    """
    total = sum(patterns.values())
    if not total:
        return {}
    order, extra = sorted(patterns), anchor * total
    prior = {True: {"1": 0.6, "0": 0.01, "2": 0.39}, False: {"1": 0.25, "0": 0.35, "2": 0.4}}
    posterior = {p: 0.1 if "0" in p else 0.9 for p in order}
    for _ in range(rounds):
        mass = {True: sum(posterior[p] * patterns[p] for p in order)}
        mass[False] = total - mass[True]
        share = (mass[True] + 0.8 * extra) / (total + extra)
        odds = dict.fromkeys(order, log(share / (1 - share)))
        for j in range(len(order[0])):
            counts = {c: dict.fromkeys("012", 0.0) for c in (True, False)}
            for p in order:
                counts[True][p[j]] += posterior[p] * patterns[p]
                counts[False][p[j]] += (1 - posterior[p]) * patterns[p]
            chance = {c: {v: (counts[c][v] + extra * prior[c][v]) / (mass[c] + extra) for v in "012"} for c in counts}
            for p in order:
                odds[p] += log(chance[True][p[j]] / chance[False][p[j]])
        posterior = {p: 1 / (1 + exp(-max(-500.0, min(500.0, odds[p])))) for p in order}
    return posterior


def score_quality(docs: DataFrame, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """A row for each document row: its counts, base_failed, posterior and kept.

    Null or empty texts have no words, fail the base rules and are not kept; so do texts of white
    space. Repeated rows each get their row. An empty table gives an empty result. Columns of the
    input other than doc_id and text are not read.

    The counts are checkpointed, as they are read twice: for the histogram and for the result. The
    posterior of a pattern reaches the rows as a literal map, bounded by 3 ** len(rules) entries.
    """
    voted = cut(votes(quality_features(docs), rules))
    histogram = {r["pattern"]: r["n"] for r in voted.groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    fitted = fit_votes(histogram)
    spark = docs.sparkSession
    table = F.broadcast(spark.createDataFrame(sorted(fitted.items()) or [("", 0.0)], "pattern string, quality double"))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    scored = voted.join(table, "pattern", "left").withColumn("base_failed", base)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def filter_quality(docs: DataFrame, **options) -> DataFrame:
    """The document rows that ``score_quality`` keeps, with all their columns."""
    kept = score_quality(docs, **options).filter("kept").select(F.col("r1").alias("__r1"), F.col("r2").alias("__r2")).distinct()
    return keep_row(docs, *row_ids("__r1", "__r2")).join(kept, ["__r1", "__r2"], "left_semi").select(f"{ROW}.*")


def op2_quality(spark, sf_dir: str) -> DataFrame:
    """The digest that the contract of operator 2 names."""
    from .common import read

    scored = score_quality(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))
