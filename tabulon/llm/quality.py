"""Quality classification by a sparse ensemble of rules.

A random forest over simple statistics of the text proposes rules: every path from a root
to an inner node or leaf is a conjunction of thresholds. A logistic model with a lasso
penalty keeps the few that matter. The kept rules become one Spark column expression, so
scoring is a projection without Python.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from tabulon.llm.common import col, cut, fresh

SAMPLE = 20_000  # labelled rows learned from, about
TREES, DEPTH = 20, 3
PENALTY = 5e-4
SEED = 7
TASKS = 4  # for the bounded sample

#: (statistic index, True for <=, threshold)
Condition = tuple[int, bool, float]


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def counts(text: Column) -> dict[str, Column]:
    """What is counted in a text; a null is an empty text. Runs are matched as a whole,
    since a match for every character would cost more than all the rest."""
    text = F.coalesce(text, F.lit(""))
    without = lambda pattern: F.char_length(F.regexp_replace(text, pattern, "")).cast("double")
    plain = lambda sign: F.char_length(F.replace(text, F.lit(sign), F.lit(""))).cast("double")
    words = F.split(text, r"\s++")
    return {
        "chars": F.char_length(text).cast("double"),
        "words": F.size(words).cast("double"),
        "distinct": F.size(F.array_distinct(words)).cast("double"),
        "lines": _count(text, r"[^\n]++"),
        "no_upper": without(r"\p{Lu}++"),
        "no_letter": without(r"\p{L}++"),
        "digits": _count(text, r"[0-9]"),
        "symbols": _count(text, r"[#$%&*@^~=+<>_\\/{}\[\]]"),
        "stops": _count(text, r"[.?!](?=\s|\z)"),
        "no_bar": plain("|"),
        "no_exclamation": plain("!"),
    }


def statistics(c: dict[str, Column]) -> dict[str, Column]:
    """The statistics of a text, by name, from its counts; all are finite."""
    chars, words = c["chars"], c["words"]
    return {
        "log_chars": F.log1p(chars),
        "chars_per_word": _ratio(chars, words),
        "words_per_line": _ratio(words, c["lines"]),
        "upper_share": _ratio(chars - c["no_upper"], chars),
        "digit_share": _ratio(c["digits"], chars),
        "letter_share": _ratio(chars - c["no_letter"], chars),
        "symbols_per_word": _ratio(c["symbols"], words),
        "bars_per_word": _ratio(chars - c["no_bar"], words),
        "exclamations_per_word": _ratio(chars - c["no_exclamation"], words),
        "stops_per_word": _ratio(c["stops"], words),
        "distinct_words": _ratio(c["distinct"], words),
    }


def with_statistics(df: DataFrame, text: Column) -> tuple[DataFrame, str]:
    """`df` with a struct column of the statistics, and its name. The counts are a column of
    their own first, so that none is made twice."""
    place, name = fresh(df, "text_counts"), fresh(df, "text_statistics")
    counted = counts(text)
    df = df.withColumn(place, F.struct(*[c.alias(k) for k, c in counted.items()]))
    found = statistics({k: col(place)[k] for k in counted})
    return df.withColumn(name, F.struct(*[c.alias(k) for k, c in found.items()])).drop(place), name


def tree_rules(description: str) -> set[tuple[Condition, ...]]:
    """The paths of a forest's textual description, each sorted and without thresholds that
    another one of the path implies."""
    found, path = set(), []
    for line in description.splitlines():
        depth = (len(line) - len(line.lstrip())) // 1
        test = re.match(r"(If|Else) \(feature (\d+) (<=|>) ([-\d.eE]+)\)", line.strip())
        if not test:
            if line.strip().startswith("Tree"):
                path = []
            continue
        while path and path[-1][0] >= depth:
            path.pop()
        path.append((depth, (int(test[2]), test[3] == "<=", float(test[4]))))
        tight: dict[tuple[int, bool], float] = {}
        for _, (feature, below, threshold) in path:
            known = tight.get((feature, below), threshold)
            tight[feature, below] = min(known, threshold) if below else max(known, threshold)
        found.add(tuple(sorted((f, b, t) for (f, b), t in tight.items())))
    return found


@dataclass(frozen=True)
class RuleModel:
    names: tuple[str, ...]
    intercept: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]

    def holds(self, rule: tuple[Condition, ...], statistic: dict[str, Column]) -> Column:
        tests = [statistic[self.names[f]] <= t if below else statistic[self.names[f]] > t for f, below, t in rule]
        whole = tests[0]
        for test in tests[1:]:
            whole = whole & test
        return whole

    def score(self, statistic: dict[str, Column]) -> Column:
        """The probability of label 1 as a column expression over the statistics' columns."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(self.holds(rule, statistic), weight).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))

    def describe(self) -> list[str]:
        """The rules in words, the weightiest first."""
        text = lambda rule: " and ".join(f"{self.names[f]} {'<=' if below else '>'} {t:g}" for f, below, t in rule)
        return [f"{weight:+.3f} if {text(rule)}" for rule, weight in sorted(self.rules, key=lambda r: -abs(r[1]))]


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE
) -> RuleModel:
    """Learn from about `sample` labelled rows, chosen by a hash of the id. Rows without a
    label of 0 or 1 are left out; a document labelled twice counts twice. With labels of one
    kind, or none, the score is a constant: that kind, or one half."""
    known = labels.select(col(id_col).alias("id"), col(label_col).cast("double").alias("label")).where(F.col("label").isin(0.0, 1.0) & F.col("id").isNotNull())
    n = known.count()
    share = min(1 << 20, -(-sample * (1 << 20) // max(1, n)))
    chosen = known.where(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 20)) < share)
    rows = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    found, place = with_statistics(rows, F.col("text"))
    table = cut(found.select("id", "label", f"{place}.*"), "statistics").coalesce(TASKS)
    names = tuple(c for c in table.columns if c not in ("id", "label"))
    table = table.sortWithinPartitions("id", "label", *names).persist()
    try:
        counts = {r["label"]: r["count"] for r in table.groupBy("label").count().collect()}
        if len(counts) < 2:
            only = next(iter(counts), None)
            return RuleModel(names, 0.0 if only is None else math.copysign(20.0, only - 0.5), ())
        vectors = VectorAssembler(inputCols=list(names), outputCol="features").transform(table).select("label", "features")
        forest = RandomForestClassifier(
            numTrees=TREES, maxDepth=DEPTH, seed=SEED, bootstrap=False, featureSubsetStrategy="onethird", minInstancesPerNode=5
        ).fit(vectors)
        rules = sorted(set().union(*[tree_rules(t.toDebugString) for t in forest.trees]))
        if not rules:  # no statistic tells the labels apart
            share = counts[1.0] / sum(counts.values())
            return RuleModel(names, math.log(share / (1 - share)), ())
        ensemble = RuleModel(names, 0.0, tuple((r, 1.0) for r in rules))
        columns = {k: col(k) for k in names}
        flags = table.select("label", F.array(*[ensemble.holds(r, columns).cast("double") for r in rules]).alias("held"))
        from pyspark.ml.functions import array_to_vector

        matrix = flags.select("label", array_to_vector("held").alias("features")).persist()
        lasso = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, maxIter=100, standardization=False).fit(matrix)
        matrix.unpersist()
        weights = zip(rules, lasso.coefficients.toArray(), strict=True)
        return RuleModel(names, float(lasso.intercept), tuple((r, float(w)) for r, w in weights if w))
    finally:
        table.unpersist()


def classify(docs: DataFrame, model: RuleModel, text_col: str = "text", result: str = "quality_score") -> tuple[DataFrame, str]:
    """`docs` with one more column, the score from 0 to 1, and that column's name (`result`,
    made longer where the input has such a column). Null and empty texts are scored as texts
    without characters."""
    name = fresh(docs, result)
    found, place = with_statistics(docs, col(text_col))
    return found.withColumn(name, model.score({k: col(place)[k] for k in model.names})).drop(place), name
