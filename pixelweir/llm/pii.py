"""Personal data spans by weak supervision, in Spark expressions.

Base spans (email, ip, card, phone) follow fixed patterns and checks. The method adds spans of the kind `secret`:
candidates are long unbroken strings; labelers (regex, gazetteer, context) vote on each or abstain. Counts of the vote
patterns over all documents, a table of bounded size, go to the driver; expectation-maximisation estimates there how
reliable each labeler is and how likely each pattern is a secret. A logistic classifier over votes and shape is then
trained on those soft labels and applied as a Spark expression.

Results: null and empty texts have no spans. Repeated rows are scanned alike. Other columns are left out. Without
candidates the classifier accepts nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweir.llm.common import read
from pixelweir.llm.native import let, match_spans

# The contract's patterns, written so that failing runs cost no more than their length: quantifiers don't give back,
# and a run is only tried from its start or from where the last match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

#: Candidates for secrets: strings of 16 characters or more without white space or quotes.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+=*+"
#: Characters before a candidate that context labelers see.
BEFORE = 32
# Openings of well-known credentials, and words that stand before secrets.
GAZETTEER = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk-", "sk_live_", "pk_live_", "AIza", "eyJ", "ya29")
CONTEXT = r"(?i)\b(?:api[_-]?key|access[_-]?key|secret|token|password|passwd|pwd|bearer|credential|authorization)\b\s*(?:is|=|:)?\s*[\"']?$"
ASSIGNED = r"[=:]\s*[\"']?$"

#: Labelers: each votes 1 (secret), 0 (none) or -1 (abstains). Beyond them the classifier sees the shape.
VOTES = ("hex_or_mixed", "gazetteer", "context", "assigned", "plain_word")
SHAPE = ("has_digit", "has_case_mix", "long", "distinct")


def _digits(s: Column) -> Column:
    return F.translate(s, "+ ().-", "")


def _ip_ok(s: Column) -> Column:
    return F.forall(F.split(s, r"\."), lambda p: let(F.ltrim(p, F.lit("0")), lambda x: (F.length(x) < 3) | ((F.length(x) == 3) & (x <= "255"))))


def _card_ok(s: Column) -> Column:
    def luhn(d: Column) -> Column:
        def add(total: Column, i: Column) -> Column:
            x = F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
            twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
            return total + F.when(i % 2 == 1, twice).otherwise(x)

        return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), add) % 10 == 0

    return let(_digits(s), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False))


def _phone_ok(s: Column) -> Column:
    return F.length(_digits(s)).between(10, 15)


CHECKS = {"email": (EMAIL, "@", None), "ip": (IP, ".", _ip_ok), "card": (CARD, None, _card_ok), "phone": (PHONE, "+", _phone_ok)}
_SPAN = "array<struct<b:int,k:int,e:int>>"


def base_spans(text: Column) -> Column:
    """A struct with, for each base kind, its spans (b, k, e) in code points; k is the kind's place in KINDS."""

    def of(kind: str) -> Column:
        pattern, needs, check = CHECKS[kind]
        found = match_spans(text, pattern)
        if check:
            found = F.filter(found, lambda x: check(x["s"]))
        rows = F.transform(found, lambda x: F.struct(x["b"].alias("b"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e")))
        return (F.when(F.contains(text, F.lit(needs)), rows).otherwise(F.array().cast(_SPAN)) if needs else rows).alias(kind)

    return F.struct(*[of(k) for k in KINDS])


def candidates(text: Column) -> Column:
    """array<struct<b, e, votes..., shape...>> of the possible secrets in a text."""

    def judged(x: Column) -> Column:
        s = x["s"]
        before = F.substring(text, F.greatest(x["b"] - BEFORE, F.lit(0)) + 1, F.least(x["b"], F.lit(BEFORE)))
        has_digit, lower, upper = s.rlike("[0-9]"), s.rlike("[a-z]"), s.rlike("[A-Z]")
        only_digits, letters = s.rlike("^[0-9+/_=-]+$"), s.rlike("^[A-Za-z]+$")
        hex_ = s.rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$")
        votes = (
            F.when(hex_ & has_digit | has_digit & lower & upper, 1).when(only_digits | letters, 0).otherwise(-1),
            F.when(s.rlike("^(?:" + "|".join(GAZETTEER) + ")"), 1).otherwise(-1),
            F.when(before.rlike(CONTEXT), 1).otherwise(-1),
            F.when(before.rlike(ASSIGNED), 1).otherwise(0),
            F.when(s.rlike("^[A-Za-z]+(?:[-_/][A-Za-z]+)*$"), 0).otherwise(-1),
        )
        shape = (
            has_digit.cast("int"),
            (lower & upper).cast("int"),
            (F.length(s) >= 32).cast("int"),
            (F.size(F.array_distinct(F.split(s, ""))) >= 10).cast("int"),
        )
        return F.struct(x["b"].alias("b"), x["e"].alias("e"), *[v.alias(n) for n, v in zip(VOTES + SHAPE, votes + shape, strict=True)])

    return F.transform(match_spans(text, CANDIDATE), judged)


def reliabilities(patterns: dict[tuple[int, ...], int], rounds: int = 100) -> tuple[float, list[list[list[float]]], dict[tuple[int, ...], float]]:
    """EM over counted vote patterns: the share of secrets, P(vote | class) per labeler (votes -1, 0, 1), and P(secret | pattern).

    It starts from the majority of the votes. Labelers are taken as independent given the class.
    """
    chance = {p: (1 + sum(v == 1 for v in p)) / (2 + sum(v >= 0 for v in p)) for p in patterns}
    total = sum(patterns.values())
    share, table = 0.5, []
    for _ in range(rounds):
        weight = sum(n * chance[p] for p, n in patterns.items())
        share = min(0.999, max(0.001, weight / max(1, total)))
        table = []
        for k in range(len(VOTES)):
            rows = []
            for cls in (0, 1):
                counts = [0.1, 0.1, 0.1]
                for p, n in patterns.items():
                    counts[p[k] + 1] += n * (chance[p] if cls else 1 - chance[p])
                rows.append([c / sum(counts) for c in counts])
            table.append(rows)
        new = {}
        for p in patterns:
            a, b = math.log(share), math.log(1 - share)
            for k, v in enumerate(p):
                a += math.log(table[k][1][v + 1])
                b += math.log(table[k][0][v + 1])
            new[p] = 1 / (1 + math.exp(max(-500, min(500, b - a))))
        moved = max((abs(new[p] - chance[p]) for p in new), default=0)
        chance = new
        if moved < 1e-9:
            break
    return share, table, chance


@dataclass(frozen=True)
class SpanClassifier:
    bias: float
    weights: tuple[float, ...]

    def score(self, votes: tuple[int, ...], shape: tuple[int, ...]) -> float:
        return self.bias + sum(w * x for w, x in zip(self.weights, (*[float(v == 1) for v in votes], *[float(v == 0) for v in votes], *map(float, shape)), strict=True))

    def accepts(self, x: Column) -> Column:
        parts = [(x[n] == 1) for n in VOTES] + [(x[n] == 0) for n in VOTES] + [(x[n] == 1) for n in SHAPE]
        total = F.lit(self.bias)
        for w, p in zip(self.weights, parts, strict=True):
            total = total + F.when(p, F.lit(w)).otherwise(F.lit(0.0))
        return total > 0


NOTHING = SpanClassifier(-1.0, (0.0,) * (2 * len(VOTES) + len(SHAPE)))


def train(counted: dict[tuple[int, ...], int], rounds: int = 400, rate: float = 1.0) -> SpanClassifier:
    """counted: (votes..., shape...) -> spans. Logistic regression on EM's soft labels, by full gradients over the patterns."""
    if not counted:
        return NOTHING
    k = len(VOTES)
    votes: dict[tuple[int, ...], int] = {}
    for p, n in counted.items():
        votes[p[:k]] = votes.get(p[:k], 0) + n
    chance = reliabilities(votes)[2]
    # counts are damped, so that a common pattern doesn't drown the rare ones
    rows = [((*[float(v == 1) for v in p[:k]], *[float(v == 0) for v in p[:k]], *map(float, p[k:])), chance[p[:k]], math.sqrt(n)) for p, n in sorted(counted.items())]
    total = sum(r[2] for r in rows)
    bias, w = 0.0, [0.0] * len(rows[0][0])
    for _ in range(rounds):
        gb, gw = 0.0, [1e-3 * x for x in w]
        for x, y, n in rows:
            z = bias + sum(a * b for a, b in zip(w, x, strict=True))
            d = (1 / (1 + math.exp(-max(-60, min(60, z)))) - y) * n / total
            gb += d
            for i, v in enumerate(x):
                if v:
                    gw[i] += d * v
        bias -= rate * gb
        w = [a - rate * g for a, g in zip(w, gw, strict=True)]
    return SpanClassifier(round(bias, 6), tuple(round(x, 6) for x in w))


def fit(docs: DataFrame, text: str = "text") -> SpanClassifier:
    """Counts vote patterns over all documents; at most 3^5 * 2^4 rows come back."""
    names = VOTES + SHAPE
    found = docs.select(F.explode(candidates(F.coalesce(F.col(text), F.lit("")))).alias("x"))
    rows = found.groupBy(*[F.col("x")[n].alias(n) for n in names]).count().collect()
    return train({tuple(r[n] for n in names): r["count"] for r in rows})


def find(docs: DataFrame, classifier: SpanClassifier, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, `base` (struct of span arrays by kind) and `spans` (array of b, k, e with secrets as kind 4)."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))

    def whole(s: Column) -> Column:
        secrets = F.transform(F.filter(candidates(s), classifier.accepts), lambda x: F.struct(x["b"].alias("b"), F.lit(len(KINDS)).alias("k"), x["e"].alias("e")))
        return let(base_spans(s), lambda base: let(F.concat(*[base[k] for k in KINDS]), lambda own: F.struct(base.alias("base"), F.sort_array(own).alias("own"), F.sort_array(F.concat(own, secrets)).alias("spans"))))

    return docs.select(*[F.col(c) for c in keep], let(t, whole).alias("_f")).select(*keep, F.col("_f.base").alias("base"), F.col("_f.own").alias("base_spans"), F.col("_f.spans").alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in (*KINDS, "secret")])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["b"].cast("string"), x["e"].cast("string"))), ",")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = find(docs, fit(docs))
    return found.select("doc_id", *[F.size(F.col("base")[k]).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(listed(F.col("base_spans")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
