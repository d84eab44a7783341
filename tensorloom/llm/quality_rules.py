"""Quality rules: a decision list of threshold conjunctions, learnt from labelled documents and emitted as Spark conditional expressions.

Every text has a few statistics, all by built-in functions. Sequential covering (in the manner of IREP and RIPPER) learns the list: a rule for
poor documents grows condition by condition by the information gained over counts of labelled rows, each a threshold on one statistic, halfway between two values that rows have; it is then
pruned to the prefix that does best on rows it wasn't grown on, and is kept if it is right there often enough; rows that it covers go, and the next rule
grows on the rest. The result reads like hand-written rules: "symbols > 0.0303 AND length <= 6.125", in order, the first that fits decides, and a
document that none fits is kept. Beside the list stands the fixed base rule (under 20 words, or over 30% of the words in repeated windows of eight).

Scale: texts are read once; their statistics, a few numbers for each, are written. A step of learning is one map-side-combined
count by (statistic, grid step, label), whose size is bounded by the grid (FEATURES x STEPS x 2 rows); the driver sees those counts alone. All labelled rows
take part. Nothing is shuffled by a document's text, so neither long texts nor copies make a task heavy beyond themselves.

Defined results: null counts as an empty text, which the base rule rejects; labels with a null, for unknown documents or that contradict each other are
ignored, and equal ones of one doc_id count once for each of its rows; rows with crc32(doc_id) mod 5 = 0 are left out of learning, and so are rows that
the base rule rejects; without labelled poor documents there are no rules; ties between conditions go to the first statistic, then to "<=", then to
the smaller threshold; an empty table gives an empty result; further columns pass through `keep_documents`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, held_out, materialise, spare_name, split_words

SPACE, DIGITS, SYMBOLS, STOPS, MARKS = " \t\n\x0b\x0c\r", "0123456789", "#*$%&|<>", ".,;:?", "{}[]\\^~=@_+/"
#: Words in a window, fewest words, and the share of words in repeated windows (in hundredths) beyond which the base rule rejects.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Statistics of a text by name, with grid steps for each unit; thresholds lie on the grid, of STEPS steps at most.
FEATURES = {"symbols": 512, "capitals": 512, "digits": 512, "shouts": 512, "stops": 512, "marks": 512, "bare": 512, "distinct": 512, "repeated": 512, "same_lines": 512, "length": 16, "line_words": 8, "size": 32}
STEPS = 1_024
#: Rules at most, conditions of one at most, the share of rows it must be right on while pruned (after adding one of each kind), labels left out of learning.
RULES, CONDITIONS, PRECISION, MOD = 12, 4, 0.75, 5


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and steps (array<int>, by FEATURES).

    Write the result before filtering by it: a filter that the optimiser moves below these columns repeats their steps for each element.
    """
    t = "q_text"
    df = docs.withColumn(t, F.coalesce(F.col(text).cast("string"), F.lit("")))
    df = df.withColumn("q_words", split_words(F.col(t), SPACE)).withColumn("n_words", F.size("q_words").cast("long"))
    # One pass leaves a letter for each class of characters, and the few characters that are in none; a-z go.
    classes = [(UPPER, "A"), (DIGITS, "0"), (SYMBOLS, "#"), ("!", "!"), (STOPS, "."), (MARKS, "{"), (SPACE, " ")]
    source, target = "".join(c for c, _ in classes) + LOWER, "".join(x * len(c) for c, x in classes)
    df = df.withColumn("q_class", F.translate(t, source, target))
    count = lambda x: (F.length("q_class") - F.length(F.replace(F.col("q_class"), F.lit(x), F.lit("")))).cast("long")
    df = df.withColumns({f"q_{name}": count(x) for name, x in (("upper", "A"), ("digit", "0"), ("symbol", "#"), ("bang", "!"), ("stop", "."), ("mark", "{"), ("space", " "))})
    df = df.withColumn("word_chars", F.length(t).cast("long") - F.col("q_space")).withColumnRenamed("q_symbol", "n_symbols")
    df = df.withColumn("q_lines", F.filter(F.split(t, "\n", -1), lambda x: F.translate(x, SPACE, "") != "")).withColumn("q_n_lines", F.size("q_lines"))
    df = df.withColumn("n_dup_lines", (F.col("q_n_lines") - F.size(F.array_distinct("q_lines"))).cast("long"))
    df = _repeated_words(df)
    df = df.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED))
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "q_n_lines"))
    values = {
        "symbols": F.col("n_symbols") / chars, "capitals": F.col("q_upper") / chars, "digits": F.col("q_digit") / chars, "shouts": F.col("q_bang") / words, "stops": F.col("q_stop") / words, "marks": F.col("q_mark") / chars,
        "bare": F.size(F.filter("q_words", lambda w: (F.length(w) == 1) & w.isin(*SYMBOLS, *MARKS, "-"))) / words, "distinct": F.size(F.array_distinct("q_words")) / words, "repeated": F.col("n_repeat_words") / words,
        "same_lines": F.col("n_dup_lines") / lines, "length": F.col("word_chars") / words, "line_words": F.col("n_words") / lines, "size": F.log2(F.col("n_words") + 1),
    }
    steps = F.array(*[F.least(F.ceil(values[name] * F.lit(float(n))), F.lit(STEPS)).cast("int") for name, n in FEATURES.items()])
    return df.withColumn("steps", steps).drop(*[c for c in df.columns if c.startswith("q_") and c not in docs.columns])


def _repeated_words(df: DataFrame) -> DataFrame:
    """df with n_repeat_words: words of q_words that lie in a window that the text holds twice or more.

    Hashes of the windows tell whether any can be repeated; where so, the windows themselves are sorted, so that equal ones lie side by side.
    """
    places = F.when(F.col("n_words") > WINDOW, F.sequence(F.lit(0), F.size("q_words") - WINDOW))
    own = lambda i: F.slice("q_words", i + 1, F.lit(WINDOW))
    df = df.withColumn("q_hashes", F.transform(places, lambda i: F.xxhash64(own(i))))
    again = F.size(F.array_distinct("q_hashes")) < F.size("q_hashes")
    df = df.withColumn("q_sorted", F.when(again, F.sort_array(F.transform(places, lambda i: F.struct(F.array_join(own(i), " ").alias("w"), i.alias("i"))))))
    beside = lambda x, j: F.coalesce(F.get("q_sorted", j - 1)["w"] == x["w"], F.lit(False)) | F.coalesce(F.get("q_sorted", j + 1)["w"] == x["w"], F.lit(False))
    df = df.withColumn("q_starts", F.sort_array(F.transform(F.filter("q_sorted", beside), lambda x: x["i"])))
    # Each start adds the words up to its window's end that the one before hasn't.
    step = lambda a, i: F.struct(i.alias("at"), (a["n"] + F.least(F.lit(WINDOW), i - a["at"])).alias("n"))
    n = F.aggregate("q_starts", F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).alias("n")), step, lambda a: a["n"])
    return df.withColumn("n_repeat_words", F.coalesce(n, F.lit(0)).cast("long"))


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool
    step: int

    def holds(self, steps: str = "steps") -> Column:
        x = F.get(F.col(steps), F.lit(self.feature))
        return x > self.step if self.above else x <= self.step

    def __str__(self) -> str:
        name = list(FEATURES)[self.feature]
        return f"{name} {'>' if self.above else '<='} {self.step / FEATURES[name]:.6g}"


Rule = tuple[Condition, ...]


def holds(rule: Rule, steps: str = "steps") -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.holds(steps)
    return out


def written(rule: Rule) -> str:
    return " AND ".join(map(str, rule))


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """Information gained about poor rows by going from p0 poor and n0 good ones to p and n."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def best_condition(counts: dict[tuple[int, int], list[int]], p0: int, n0: int) -> Condition | None:
    """counts: {(feature, step): [good, poor]} of the rows that are left. None if no threshold gains anything."""
    best, most = None, 1e-9
    for i in range(len(FEATURES)):
        p = n = 0
        at = {s: c for (f, s), c in counts.items() if f == i}
        tries = []
        for s, after in zip(sorted(at), sorted(at)[1:]):
            n, p = n + at[s][0], p + at[s][1]
            tries.append(((s + after) // 2, n, p))  # halfway to the next step that any row has
        for above in (False, True):
            for s, n, p in tries:
                g = _gain(p0 - p, n0 - n, p0, n0) if above else _gain(p, n, p0, n0)
                if g > most + 1e-9:
                    best, most = Condition(i, above, s), g
    return best


def learn(train: DataFrame, rules: int = RULES, conditions: int = CONDITIONS, precision: float = PRECISION) -> list[Rule]:
    """An ordered list of rules. train: steps, poor boolean, grow boolean (false: a row for pruning)."""
    out: list[Rule] = []
    left = train
    while len(out) < rules:
        rule: Rule = ()
        while len(rule) < conditions:
            rows = left.filter(F.col("grow") & holds(rule)).select("poor", F.posexplode("steps").alias("i", "s")).groupBy("i", "s", "poor").count().collect()  # at most one for each statistic, step and label
            counts: dict[tuple[int, int], list[int]] = {}
            for r in rows:
                counts.setdefault((r["i"], r["s"]), [0, 0])[int(r["poor"])] += r["count"]
            n, p = (sum(c[k] for (i, _), c in counts.items() if i == 0) for k in (0, 1))
            found = best_condition(counts, p, n) if p and n else None
            if found is None:
                break
            rule = (*rule, found)
        if not rule:
            break
        covers = lambda k, poor, rule=rule: F.sum((holds(rule[:k]) & (F.col("poor") if poor else ~F.col("poor"))).cast("long"))
        r = left.filter(~F.col("grow")).agg(*[covers(k, poor).alias(f"{'p' if poor else 'n'}{k}") for k in range(1, len(rule) + 1) for poor in (True, False)]).first()
        worth = [((r[f"p{k}"] or 0), (r[f"n{k}"] or 0), k) for k in range(1, len(rule) + 1)]
        p, n, k = max(worth, key=lambda w: ((w[0] - w[1]) / (w[0] + w[1]) if w[0] + w[1] else -1.0, w[0], -w[2]))
        if not p or (p + 1) / (p + n + 2) < precision:
            break
        out.append(rule[:k])
        left = left.filter(~holds(out[-1]))
    return out


def training_rows(stats: DataFrame, labels: DataFrame, doc_id: str = "doc_id", mod: int = MOD) -> DataFrame:
    """(steps, poor, grow) of labelled rows that the base rule passes. A third of them, by a hash, are for pruning."""
    known = labels.select(F.col("doc_id").alias("known_id"), F.col("quality").cast("int").alias("quality")).filter("quality is not null").groupBy("known_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high")).filter("low = high")
    rows = stats.filter(~F.col("base_failed") & ~held_out(F.col(doc_id), mod)).select(F.col(doc_id).alias("id"), "steps")
    grow = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("prune")), F.lit(3)) != 0
    return rows.join(known, rows["id"] == known["known_id"]).select("steps", (F.col("low") == 0).alias("poor"), grow.alias("grow"))


def deciding(rules: list[Rule], steps: str = "steps") -> Column:
    """The text of the first rule that fits, null where none does: one conditional expression in the order of the list."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(holds(rule, steps), F.lit(written(rule))).otherwise(out)
    return out


def judge_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", mod: int = MOD) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule for every row of docs."""
    stats = statistics(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).drop("text")
    own = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    stats = materialise(stats.select(*own, "steps"), "rule-statistics")
    rules = learn(materialise(training_rows(stats, labels, mod=mod), "rule-training"))
    return stats.withColumn("rule", deciding(rules)).select(*own, (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")


def keep_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", mod: int = MOD) -> DataFrame:
    """docs without those that the base rule or the learnt list rejects."""
    whole = spare_name(docs, "whole_row")
    of = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(whole))
    stats = materialise(statistics(of.drop(whole)).select("doc_id", "base_failed", "steps"), "rule-statistics")
    rules = learn(materialise(training_rows(stats, labels, mod=mod), "rule-training"))
    # A filter on a number of the row's own isn't moved below the statistics, where each of their steps would be worked out anew for each element.
    numbered = statistics(of).withColumn("row_no", F.monotonically_increasing_id())
    return numbered.filter((F.col("row_no") >= 0) & ~F.col("base_failed") & deciding(rules).isNull()).select(f"{whole}.*")
