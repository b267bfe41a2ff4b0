"""Quality rules: a learned decision list over text statistics, in Spark functions only.

Sequential covering: rules are conjunctions of thresholds that single out poor documents. Half of the
labelled examples grow a rule, adding the condition of highest gain until it covers poor ones only; thresholds
are sought between all neighbouring values of the examples that the rule covers so far. The other half prunes
it, dropping last conditions while that doesn't lower its worth. A rule is kept if it is precise on the second
half; the examples it covers are set aside, and the next rule is learned. Each step is one query over the
examples. The list becomes one ordered CASE expression.

Rules are learned from at most `EXAMPLES` labelled documents (those with the smallest hash of their id).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_SPACE, materialize, scratch

EXAMPLES = 20_000
SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 8
MIN_WORDS, MAX_REPEAT = 20, 30
PRECISION, MIN_COVER = 0.9, 5
#: Thresholds are learned over these columns of statistics().
FEATURES = ("word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "punct_share", "line_words", "distinct_share")


def _windows(hashes: Column, n: int) -> Column:
    """The hash and position of each window of n words, in the order of hashes."""
    at = F.sequence(F.lit(0), F.size(hashes) - n)
    return F.sort_array(F.transform(at, lambda i: F.struct(F.xxhash64(*[F.get(hashes, i + j) for j in range(n)]).alias("h"), i.alias("p"))))


def _repeated(windows: Column) -> Column:
    """The positions, rising, of the windows whose neighbour in the order of hashes is equal."""

    def same(w: Column, i: Column) -> Column:
        return (w["h"] == F.coalesce(F.get(windows, i - 1)["h"], F.bitwise_not(w["h"]))) | (w["h"] == F.coalesce(F.get(windows, i + 1)["h"], F.bitwise_not(w["h"])))

    return F.sort_array(F.filter(F.transform(windows, lambda w, i: F.when(same(w, i), w["p"])), lambda p: p.isNotNull()))


def statistics(docs: DataFrame, *, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in carry with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and FEATURES.

    A null or wordless text has zeros everywhere. Lines and words are compared as they stand.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    bare = F.translate(t, ASCII_SPACE, "")
    rows = docs.select(*carry, t.alias("__t"), bare.alias("__bare"), F.filter(F.split(t, "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "").alias("__w"))
    lines = F.filter(F.split("__t", "\n", -1), lambda x: F.trim(x, F.lit(ASCII_SPACE)) != "")
    # each step is its own projection, as later ones use it more than once
    rows = rows.select(*carry, "__t", "__bare", "__w", lines.alias("__l"), F.transform("__w", lambda w: F.xxhash64(w)).alias("__h"))
    some = F.when(F.size("__h") >= REPEAT_WINDOW, _windows(F.col("__h"), REPEAT_WINDOW))
    rows = rows.select(*carry, "__t", "__bare", "__w", "__l", some.alias("__r"))
    rows = rows.select(*carry, "__t", "__bare", "__w", "__l", _repeated(F.col("__r")).alias("__p"))
    # words in repeated windows: each position adds what lies before the next one, at most the window
    nexts = F.concat(F.slice("__p", 2, F.greatest(F.size("__p") - 1, F.lit(0))), F.array(F.lit(1 << 30)))
    covered = F.aggregate(F.zip_with("__p", nexts, lambda a, b: F.least(b - a, F.lit(REPEAT_WINDOW))), F.lit(0), lambda acc, x: acc + x)
    n, chars = F.size("__w").cast("long"), F.length("__bare").cast("long")
    out = rows.select(
        *carry,
        n.alias("n_words"),
        chars.alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(F.size("__p") > 0, covered), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("__l").alias("__lines"),
        F.size(F.array_distinct("__w")).alias("__distinct"),
        *[(F.length("__bare") - F.length(F.regexp_replace("__bare", c, ""))).alias(k) for k, c in (("__upper", r"\p{Lu}+"), ("__digit", r"\p{Nd}+"), ("__punct", r"[\p{P}\p{S}]+"))],
    )

    def share(a: str, b: str) -> Column:
        return F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))

    shares = [share(a, b).alias(k) for k, a, b in (("word_length", "word_chars", "n_words"), ("symbol_share", "n_symbols", "word_chars"), ("dup_line_share", "n_dup_lines", "__lines"), ("repeat_share", "n_repeat_words", "n_words"), ("upper_share", "__upper", "word_chars"), ("digit_share", "__digit", "word_chars"), ("punct_share", "__punct", "word_chars"), ("line_words", "n_words", "__lines"), ("distinct_share", "__distinct", "n_words"))]
    return out.select(*carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *shares)


@dataclass(frozen=True)
class Condition:
    """A threshold: the feature's value is above, or not above, the cut."""

    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        return F.col(self.feature) > self.cut if self.above else F.col(self.feature) <= self.cut


Rule = tuple[Condition, ...]


def _holds(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def verdict(rules: list[Rule]) -> Column:
    """The number, from 1, of the first rule that holds, else 0: an ordered conditional expression."""
    out = None
    for i, rule in enumerate(rules):
        out = (F.when if out is None else out.when)(_holds(rule), F.lit(i + 1))
    return F.lit(0) if out is None else out.otherwise(0)


def _totals(rows: DataFrame, tests: list[Column]) -> list[tuple[int, int]]:
    """(poor, good) rows that each test holds for."""
    sums = [F.coalesce(F.sum((t & (F.col("poor") == p)).cast("long")), F.lit(0)).alias(f"c{i}_{p}") for i, t in enumerate(tests) for p in (1, 0)]
    got = rows.agg(*sums).first()
    return [(got[f"c{i}_1"], got[f"c{i}_0"]) for i in range(len(tests))]


def _best(rows: DataFrame, poor: int, good: int) -> tuple[Condition, int, int] | None:
    """The condition of highest gain on rows with so many poor and good ones, and the (poor, good) rows it holds for.

    Cuts lie halfway between every two neighbouring values of a feature among the rows. Values are counted
    first; the windows then run over a feature's distinct values, at most EXAMPLES.
    """
    cells = rows.select("poor", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in FEATURES])).alias("x"))
    cells = cells.groupBy("x.feature", "x.value").agg(F.sum("poor").alias("p"), F.sum(1 - F.col("poor")).alias("g"))
    along = Window.partitionBy("feature").orderBy("value")
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.select("feature", "value", F.lead("value").over(along).alias("following"), F.sum("p").over(upto).alias("p"), F.sum("g").over(upto).alias("g")).filter(F.col("following").isNotNull())
    middle = F.col("value") + (F.col("following") - F.col("value")) / 2
    sides = F.array(*[F.struct(F.lit(above).alias("above"), (poor - F.col("p") if above else F.col("p")).alias("p"), (good - F.col("g") if above else F.col("g")).alias("g")) for above in (False, True)])
    tried = cells.select("feature", F.when(middle < F.col("following"), middle).otherwise(F.col("value")).alias("cut"), F.explode(sides).alias("side")).select("feature", "cut", "side.*")
    gain = F.col("p") * (F.log2(F.col("p") / (F.col("p") + F.col("g"))) - math.log2(poor / (poor + good)))
    found = tried.filter((F.col("p") >= MIN_COVER) & (F.col("g") < good)).withColumn("gain", gain).filter("gain > 0").orderBy(F.desc("gain"), "feature", "cut", "above").first()
    return found and (Condition(found["feature"], found["above"], found["cut"]), found["p"], found["g"])


def learn(examples: DataFrame, *, precision: float = PRECISION) -> list[Rule]:
    """Rules from examples with FEATURES, poor (0 or 1) and grow (whether it grows or prunes). No examples give no rules.

    A rule grows until it holds for poor examples only or no condition gains; learning ends with the first rule
    that, pruned, covers too few poor ones or is wrong too often on the pruning half. Neither rules nor
    conditions have a set number.
    """
    with scratch(examples.sparkSession):
        examples = materialize(examples.select(*FEATURES, "poor", "grow"), "quality-examples")
        rules: list[Rule] = []
        left = F.lit(True)
        while True:
            rule: Rule = ()
            growing, pruning = examples.filter(left & F.col("grow")), examples.filter(left & ~F.col("grow"))
            ((poor, good),) = _totals(growing, [F.lit(True)])
            while poor >= MIN_COVER and good:
                best = _best(growing.filter(_holds(rule)), poor, good)
                if best is None:
                    break
                condition, poor, good = best
                rule = (*rule, condition)
            if not rule:
                return rules
            tried = _totals(pruning, [_holds(rule[: i + 1]) for i in range(len(rule))])
            worth = [(p - g) / (p + g) if p + g else -1.0 for p, g in tried]
            best = max(range(len(rule)), key=lambda i: (worth[i], -i))
            p, g = tried[best]
            if p < MIN_COVER or p < precision * (p + g):
                return rules
            rules.append(rule[: best + 1])
            left = left & ~_holds(rules[-1])


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, *, text: str = "text", max_examples: int = EXAMPLES) -> tuple[DataFrame, list[Rule]]:
    """(statistics of docs with base_failed, rule and kept; the rules), learned from labels (doc_id, quality 0 or 1).

    rule is the number of the rule that rejects the document, 0 if none does; kept is false if base_failed or
    a rule holds. Labels without id or quality are left out, of repeated ones the larger counts. Without
    labels nothing but the base rejects. Repeated rows of docs each get a row.
    """
    stats = materialize(statistics(docs, text=text), "text-statistics")
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    draw = F.xxhash64("doc_id")
    chosen = known.orderBy(draw, "doc_id").limit(max_examples)
    examples = stats.join(F.broadcast(chosen), "doc_id")  # at most max_examples rows
    examples = examples.filter(~base_failed()).select(*FEATURES, (F.col("quality") == 0).cast("int").alias("poor"), (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.lit(2)) == 0).alias("grow"))
    rules = learn(examples)
    out = stats.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)), rules
