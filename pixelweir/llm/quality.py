"""Quality rules as a learned decision list.

Statistics of labelled documents feed sequential covering: a rule is a conjunction of thresholds, grown on two thirds
of the labelled rows by FOIL's gain and pruned on the rest; rows that it covers go, and the next rule is learned. The
list becomes one ordered Spark conditional. Statistics and verdicts are Spark expressions alone; only the statistics
of at most SAMPLE labelled rows come to the driver, for fitting.

Results: null and empty texts have no words and fail the base rule. Repeated rows are judged alike. Rows with a null
label or a label without a document teach nothing; without labels the list is empty and the base rule decides. If a
document has several labels, each counts as a row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweir.llm.common import read
from pixelweir.llm.native import SPACES, let, words

#: Labelled rows that are used for fitting at most: those with the smallest hash of their id.
SAMPLE = 4000
#: Words of the windows whose repeats count.
WINDOW = 8

#: Ratios that rules may test: counts of the statistics, one over the other.
FEATURES = {
    "symbol_ratio": ("n_symbols", "word_chars"),
    "repeat_ratio": ("n_repeat_words", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "upper_ratio": ("n_upper", "word_chars"),
    "digit_ratio": ("n_digits", "word_chars"),
    "mark_ratio": ("n_marks", "word_chars"),
    "distinct_ratio": ("n_distinct", "n_words"),
    "word_length": ("word_chars", "n_words"),
}


def ratio(q: Column, feature: str) -> Column:
    over, under = FEATURES[feature]
    return q[over] / F.greatest(q[under], F.lit(1))


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _repeat_words(w: Column) -> Column:
    """Words in windows of WINDOW words that are found twice or more in the text."""

    def covered(places: Column) -> Column:
        step = F.aggregate(
            places,
            F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
            lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(WINDOW), p - s["last"])).alias("n")),
        )
        return step["n"]

    def among(sorted_: Column) -> Column:
        twice = F.filter(
            sorted_,
            lambda z, i: ((i > 0) & (F.get(sorted_, i - 1)["h"] == z["h"])) | ((i < F.size(sorted_) - 1) & (F.get(sorted_, i + 1)["h"] == z["h"])),
        )
        return covered(F.sort_array(F.transform(twice, lambda z: z["p"])))

    def windows(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(F.sort_array(pairs), among))

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    return F.when(F.size(w) <= WINDOW, 0).otherwise(let(hashes, windows))


def statistics(text: Column) -> Column:
    """A struct of the text's counts."""
    t = F.coalesce(text.cast("string"), F.lit(""))

    def of_lines(lines: Column) -> list[Column]:
        return [F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines")]

    def whole(w: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
        by_line = let(lines, lambda x: F.struct(*of_lines(x)))
        return let(
            by_line,
            lambda x: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
                _count(t, "#*$%&|<>").cast("long").alias("n_symbols"),
                x["n_dup_lines"].alias("n_dup_lines"),
                _repeat_words(w).cast("long").alias("n_repeat_words"),
                x["n_lines"].alias("n_lines"),
                F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
                _count(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_upper"),
                _count(t, "0123456789").cast("long").alias("n_digits"),
                _count(t, ".,;:!?\"'()[]{}=@/\\+-_~^`").cast("long").alias("n_marks"),
            ),
        )

    return let(words(t), whole)


@dataclass
class Rule:
    """A conjunction of (feature, '<=' or '>', threshold): it rejects what it covers."""

    tests: list[tuple[str, str, float]]
    covered: int = 0
    right: int = 0

    def covers(self, row: dict) -> bool:
        return all(row[f] <= t if op == "<=" else row[f] > t for f, op, t in self.tests)

    def expression(self, q: Column) -> Column:
        return reduce(lambda a, b: a & b, [ratio(q, f) <= t if op == "<=" else ratio(q, f) > t for f, op, t in self.tests])

    def __str__(self) -> str:
        return " and ".join(f"{f} {op} {t:.6g}" for f, op, t in self.tests) + f"  ({self.right} of {self.covered})"


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)

    def rejects(self, row: dict) -> bool:
        return any(r.covers(row) for r in self.rules)

    def expression(self, q: Column) -> Column:
        """The ordered conditional over a struct of statistics: true rejects."""
        if not self.rules:
            return F.lit(False)
        out = F.when(self.rules[0].expression(q), True)
        for r in self.rules[1:]:
            out = out.when(r.expression(q), True)
        return out.otherwise(False)


def _thresholds(rows: list[dict], feature: str, most: int = 48) -> list[float]:
    """Middles between neighbouring values, at quantiles."""
    values = sorted({r[feature] for r in rows})
    middles = [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]
    step = max(1, len(middles) // most)
    return middles[step // 2 :: step]


def _grow(bad: list[dict], good: list[dict], most_tests: int = 4) -> Rule:
    tests: list[tuple[str, str, float]] = []
    while good and len(tests) < most_tests:
        p0, n0 = len(bad), len(good)
        base = math.log2(p0 / (p0 + n0))
        best, gain = None, 1e-9
        for f in FEATURES:
            for t in _thresholds(bad + good, f):
                for op in ("<=", ">"):
                    test = Rule([(f, op, t)])
                    p = sum(map(test.covers, bad))
                    if not p:
                        continue
                    n = sum(map(test.covers, good))
                    g = p * (math.log2(p / (p + n)) - base)
                    if g > gain:
                        best, gain = test, g
        if best is None:
            break
        tests += best.tests
        bad, good = [r for r in bad if best.covers(r)], [r for r in good if best.covers(r)]
    return Rule(tests)


def _prune(rule: Rule, bad: list[dict], good: list[dict]) -> Rule:
    """Drops final tests as long as (right - wrong) / covered on the pruning rows doesn't fall."""

    def worth(r: Rule) -> float:
        p, n = sum(map(r.covers, bad)), sum(map(r.covers, good))
        return (p - n) / (p + n) if p + n else -1.0

    while len(rule.tests) > 1 and worth(shorter := Rule(rule.tests[:-1])) >= worth(rule):
        rule = shorter
    return rule


def learn(rows: list[dict], most_rules: int = 12, precision: float = 0.95) -> DecisionList:
    """Rows: features and `bad`. A rule joins the list only if it is right on `precision` of the rows that it covers, of fitting and of pruning rows."""
    rows = sorted(rows, key=lambda r: r["order"])
    found: list[Rule] = []
    # thirds in the rows' hash order, dealt by turns
    grow, prune = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if i % 3 == 0]
    while len(found) < most_rules:
        bad, good = [r for r in grow if r["bad"]], [r for r in grow if not r["bad"]]
        if len(bad) < 3:
            break
        rule = _grow(bad, good)
        if not rule.tests:
            break
        held_bad, held_good = [r for r in prune if r["bad"]], [r for r in prune if not r["bad"]]
        rule = _prune(rule, held_bad, held_good)
        p, n = (sum(map(rule.covers, x)) for x in (bad + held_bad, good + held_good))
        hp, hn = sum(map(rule.covers, held_bad)), sum(map(rule.covers, held_good))
        if p < 3 or p < precision * (p + n) or hp < precision * (hp + hn):
            break
        rule.covered, rule.right = p + n, p
        found.append(rule)
        grow, prune = [r for r in grow if not rule.covers(r)], [r for r in prune if not rule.covers(r)]
    return DecisionList(found)


def base_failed(q: Column) -> Column:
    return (q["n_words"] < 20) | (100 * q["n_repeat_words"] > 30 * q["n_words"])


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[dict]:
    """The features of at most `sample` labelled rows whose documents pass the base rule."""
    chosen = labels.filter("doc_id is not null and quality is not null").select("doc_id", (F.col("quality") == 0).alias("bad")).withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id", "bad").limit(sample)
    some = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` rows are broadcast
    q = F.col("q")
    stats = some.select("order", "doc_id", "bad", statistics(F.col("text")).alias("q")).select("order", "doc_id", "bad", base_failed(q).alias("failed"), *[ratio(q, f).alias(f) for f in FEATURES])
    return [r.asDict() for r in stats.orderBy("order", "doc_id", "bad", *FEATURES).limit(2 * sample).collect() if not r.failed]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DecisionList:
    return learn(labelled(docs, labels, sample))


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of each row."""
    q = F.col("q")
    stats = docs.select(F.col("doc_id").cast("long").alias("doc_id"), statistics(F.col("text")).alias("q"))
    return stats.select("doc_id", *[q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], base_failed(q).alias("base_failed"), (~base_failed(q) & ~rules.expression(q)).alias("kept"))


def keep(docs: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """The rows of docs that pass, with their own columns."""
    return docs.filter(let(statistics(F.col(text)), lambda q: ~base_failed(q) & ~rules.expression(q)))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return judge(docs, fit(docs, read(spark, sf_dir, "labels")))
