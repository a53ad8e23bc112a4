"""Quality rules: a decision list learned from labelled statistics, as Spark expressions only.

Measures of whole texts are DataFrame expressions. Sequential covering learns
rules that reject: a rule grows by the threshold condition of the highest
information gain on two thirds of the labelled documents, is pruned to the
prefix that does best on the other third, and is kept if it is precise there;
covered documents leave, and the next rule is learned. The counts behind every
step are aggregated in Spark over a sample of at most about `LABELLED` labelled
documents; the driver sees one histogram of a few hundred rows at a time.

Words are `[^\\x20\\x09-\\x0D]+`. Defined cases: null or empty texts have no
words, fail the base rule and are not kept; without bad labels the list is
empty; labels without a document and null labels are ignored; a null doc_id is
judged but not learned from; repeated rows are judged each; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import stored

LABELLED = 20_000
CUTS = 15
MOST_RULES = 12
MOST_CONDITIONS = 4
LEAST_PRECISION = 0.9
LEAST_COVERED = 3
GROWN_ON = 2 / 3
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
# Measures that rules may ask for.
MEASURES = [
    "n_words", "mean_word", "symbol_share", "line_repeat_share", "word_repeat_share", "upper_share", "digit_share",
    "shout_share", "distinct_share",
]


def base_measures(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the measures of rules."""
    text = F.coalesce(F.col("text"), F.lit(""))
    stage = docs.select(F.col("doc_id").cast("long"), text.alias("text")).select(
        "doc_id",
        "text",
        F.filter(F.split("text", "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"),
    )

    def without(chars: str) -> Column:
        return F.length(F.translate("text", chars, ""))

    n = F.size("words")
    triple = F.transform(
        F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)),
    )
    stage = stage.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        without(BLANKS).cast("long").alias("word_chars"),
        (F.length("text") - without(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").alias("n_lines"),
        (F.length("text") - without("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("n_upper"),
        (F.length("text") - without("0123456789")).alias("n_digits"),
        (F.length("text") - without("!?")).alias("n_shouts"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
        triple.alias("triples"),
    )
    # Equal windows are neighbours once sorted; only texts that repeat a window are sorted.
    repeats = F.size(F.array_distinct("triples")) < F.size("triples")
    pairs = F.when(repeats, F.sort_array(F.transform("triples", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    stage = stage.withColumn("pairs", pairs).drop("triples")
    places = F.transform(
        "pairs",
        lambda p, k: F.when((p["h"] == F.get("pairs", k - 1)["h"]) | (p["h"] == F.get("pairs", k + 1)["h"]), p["i"]),
    )
    stage = stage.withColumn("places", F.sort_array(F.filter(places, lambda p: p.isNotNull()))).drop("pairs")
    covered = F.transform("places", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("places", k + 1) - p, F.lit(3))))
    repeated = F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0))
    stage = stage.withColumn("n_repeat_words", repeated.cast("long")).drop("places")

    def share(part: str, whole: str) -> Column:
        return F.col(part) / F.greatest(F.col(whole), F.lit(1))

    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stage.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        share("word_chars", "n_words").alias("mean_word"),
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_dup_lines", "n_lines").alias("line_repeat_share"),
        share("n_repeat_words", "n_words").alias("word_repeat_share"),
        share("n_upper", "word_chars").alias("upper_share"),
        share("n_digits", "word_chars").alias("digit_share"),
        share("n_shouts", "word_chars").alias("shout_share"),
        share("n_distinct", "n_words").alias("distinct_share"),
    )


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    cut: float
    rank: int  # place of the cut among the candidates

    def column(self) -> Column:
        own = F.col(self.measure)
        return own > F.lit(self.cut) if self.above else own <= F.lit(self.cut)

    def binned(self) -> Column:
        """The same on the number of candidate cuts below the value."""
        own = F.col(f"bin_{self.measure}")
        return own > self.rank if self.above else own <= self.rank

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def matches(rule: Rule, binned: bool = False) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & (condition.binned() if binned else condition.column())
    return out


def _cuts(rows: DataFrame) -> dict[str, list[float]]:
    """Candidate thresholds: quantiles of each measure among all and among bad documents."""
    marks = F.array(*[F.lit((k + 1) / (CUTS + 1)) for k in range(CUTS)])
    found = rows.agg(
        *[F.percentile(m, marks).alias(f"all_{m}") for m in MEASURES],
        *[F.percentile(F.when(F.col("bad") == 1, F.col(m)), marks).alias(f"bad_{m}") for m in MEASURES],
    ).first()
    return {m: sorted({*(found[f"all_{m}"] or []), *(found[f"bad_{m}"] or [])}) for m in MEASURES}


def _binned(rows: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    """Measures as the number of candidate cuts below them."""
    def below(m: str) -> str:
        return " + ".join([f"int({m} > {c!r}D)" for c in cuts[m]] or ["0"])

    return rows.selectExpr("bad", "grow", *[f"{below(m)} AS bin_{m}" for m in MEASURES])


def _histogram(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[str, list[tuple[int, int]]]:
    """(bad, good) documents of each measure by the number of cuts below its value."""
    bins = ", ".join(f"struct({k} AS m, bin_{m} AS bin)" for k, m in enumerate(MEASURES))
    counts = {m: [(0, 0)] * (len(cuts[m]) + 1) for m in MEASURES}
    grouped = rows.selectExpr("bad", f"explode(array({bins})) AS x").groupBy("x.m", "x.bin")
    for m, at, bad, total in grouped.agg(F.sum("bad"), F.count(F.lit(1))).collect():
        counts[MEASURES[m]][at] = (bad, total - bad)
    return counts


def _grow(rows: DataFrame, cuts: dict[str, list[float]]) -> Rule:
    """Add the condition of the highest gain until the rule covers bad documents only."""
    rule: Rule = ()
    while len(rule) < MOST_CONDITIONS:
        counts = _histogram(rows.filter(matches(rule, True)), cuts)
        bad, good = (sum(x[i] for x in counts[MEASURES[0]]) for i in (0, 1))
        if not bad or not good:
            break
        before, best, added = math.log2(bad / (bad + good)), 0.0, None
        for measure in MEASURES:
            below_bad = below_good = 0
            for rank, (cut, (b, g)) in enumerate(zip(cuts[measure], counts[measure], strict=False)):
                below_bad, below_good = below_bad + b, below_good + g
                for above, p, n in ((False, below_bad, below_good), (True, bad - below_bad, good - below_good)):
                    if p >= LEAST_COVERED:
                        gain = p * (math.log2(p / (p + n)) - before)
                        if gain > best + 1e-9:
                            best, added = gain, Condition(measure, above, cut, rank)
        if added is None:
            break
        rule = (*rule, added)
    return rule


def _prune(rows: DataFrame, rule: Rule) -> tuple[Rule, float, int]:
    """The prefix of the rule that does best on documents it was not grown on; its precision and the bad ones it covers."""
    sums = []
    for length in range(1, len(rule) + 1):
        hit = matches(rule[:length], True)
        sums += [F.sum(F.when(hit, F.col("bad"))).alias(f"p{length}"), F.sum(F.when(hit, 1 - F.col("bad"))).alias(f"n{length}")]
    found = rows.agg(*sums).first()
    best = max(
        range(1, len(rule) + 1),
        key=lambda k: (((found[f"p{k}"] or 0) - (found[f"n{k}"] or 0)) / max(1, (found[f"p{k}"] or 0) + (found[f"n{k}"] or 0)), found[f"p{k}"] or 0, -k),
    )
    p, n = found[f"p{best}"] or 0, found[f"n{best}"] or 0
    return rule[:best], p / max(1, p + n), p


def sample(labels: DataFrame) -> DataFrame:
    """(doc_id, bad) of about LABELLED labelled documents, chosen by a hash of the id."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((1 - F.min("quality")).cast("int").alias("bad"))
    part = int(min(1.0, LABELLED / max(1, known.count())) * 1_000_000)
    return known.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < part)


def learn(docs: DataFrame, labels: DataFrame) -> list[Rule]:
    """Rules that reject, in order."""
    known = stored(sample(labels), "sample")
    few = F.broadcast(known)  # at most about LABELLED rows of 12 bytes
    measured = base_measures(docs.join(few, "doc_id", "left_semi"))
    part = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1000)) < int(1000 * GROWN_ON)
    own = measured.join(few, "doc_id").select("bad", "base_failed", part.alias("grow"), *MEASURES)
    # Filtered only once it is written: a filter pushed below would compute the measures again for itself.
    rows = stored(own, "labelled").coalesce(2).filter("NOT base_failed")
    cuts = _cuts(rows)
    rows = stored(_binned(rows, cuts), "binned")
    rules: list[Rule] = []
    while len(rules) < MOST_RULES:
        rule = _grow(rows.filter("grow"), cuts)
        if not rule:
            break
        rule, precision, covered = _prune(rows.filter("NOT grow"), rule)
        if precision < LEAST_PRECISION or covered < 1:
            break
        rules.append(rule)
        rows = rows.filter(~matches(rule, True))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The first rule that rejects a document, as text; null: none does."""
    out = None
    for number, rule in enumerate(rules, 1):
        said = F.lit(f"{number}: " + " and ".join(map(str, rule)))
        out = F.when(matches(rule), said) if out is None else out.when(matches(rule), said)
    return F.lit(None).cast("string") if out is None else out


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base measures, base_failed, kept, and the rule that rejected a document."""
    rejected = F.when(~F.col("base_failed"), verdict(learn(docs, labels)))
    return base_measures(docs).withColumn("rule", rejected).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule",
    )
