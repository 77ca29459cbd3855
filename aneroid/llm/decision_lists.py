"""Quality rules learned as a decision list: an ordered list of threshold conjunctions, found by covering."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from math import exp, lgamma, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aneroid.scratch import stored

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def count_characters(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the statistics of each whole text, all long:

    ``n_words``; ``word_chars``, code points in words; ``n_chars_all``; ``n_symbols``, characters of
    ``#*$%&|<>``; ``n_upper``, A-Z; ``n_marks``, ``!`` and ``?``; ``n_digits``; ``n_lines``, lines with a word;
    ``n_dup_lines``, those equal to an earlier one; ``n_repeat_words``, words inside a window of three words
    that the text has twice or more. NULL is an empty text. Columns of those names are replaced.

    Nothing is shuffled. Windows are compared by a 64-bit hash of their words inside one text: they are
    sorted with their places, and those equal to a neighbour are kept, so a text of n words takes n log n.
    """
    text = F.coalesce(text_col, F.lit(""))
    step = docs.withColumns({"_text": text, "_words": F.array_remove(F.split(text, SPACE), "")})
    windows = F.when(F.size("_words") >= 3, F.transform(
        F.sequence(F.lit(0), F.size("_words") - 3),
        lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)),
    )).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    step = step.withColumns({"_windows": windows, "_lines": lines})
    # most texts repeat no window: only the others are sorted
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    step = step.withColumn("_sorted", F.when(repeats, F.sort_array(
        F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    )))
    step = step.withColumn("_at", F.sort_array(F.transform(F.filter("_sorted", lambda w, i: (
        (w["h"] == F.get("_sorted", i - 1)["h"]) | (w["h"] == F.get("_sorted", i + 1)["h"])
    )), lambda w: w["i"])))
    # each repeated window adds the words that the one before it doesn't have
    added = F.transform("_at", lambda p, j: F.when(j == 0, 3).otherwise(F.least(F.lit(3), p - F.get("_at", j - 1))))
    repeated = F.coalesce(F.aggregate(added, F.lit(0), lambda a, x: a + x), F.lit(0))
    numbers = {
        "n_words": F.size("_words"),
        "word_chars": F.length(F.translate("_text", SPACES, "")),
        "n_chars_all": F.length("_text"),
        "n_symbols": count_characters(F.col("_text"), SYMBOLS),
        "n_upper": count_characters(F.col("_text"), UPPER),
        "n_marks": count_characters(F.col("_text"), "!?"),
        "n_digits": count_characters(F.col("_text"), "0123456789"),
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": repeated,
    }
    return step.withColumns({k: v.cast("long") for k, v in numbers.items()}).drop(
        "_text", "_words", "_windows", "_lines", "_sorted", "_at"
    )


def features() -> dict[str, Column]:
    """Ratios of the statistics, from 0 up; an empty text has 0 everywhere."""
    per_word = F.greatest(F.col("n_words"), F.lit(1))
    per_char = F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": F.col("word_chars") / per_word,
        "symbols_per_word": F.col("n_symbols") / per_word,
        "upper_per_char": F.col("n_upper") / per_char,
        "marks_per_word": F.col("n_marks") / per_word,
        "digits_per_char": F.col("n_digits") / per_char,
        "dup_lines_per_line": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeats_per_word": F.col("n_repeat_words") / per_word,
        "words_per_line": F.col("n_words") / F.greatest(F.col("n_lines"), F.lit(1)),
    }


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool
    bin: int  # of the threshold: a row is above it if its bin is larger


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; each is a conjunction of (feature, ``>`` or ``<=``, threshold)."""

    rules: list[list[tuple[str, str, float]]] = field(default_factory=list)

    def expression(self) -> Column:
        """The number of the first rule that holds, from 0, or NULL: one ordered conditional expression."""
        columns, case = features(), F.lit(None).cast("int")
        for n, rule in reversed(list(enumerate(self.rules))):
            holds = F.lit(True)
            for name, sign, threshold in rule:
                holds = holds & (columns[name] > threshold if sign == ">" else columns[name] <= threshold)
            case = F.when(holds, F.lit(n)).otherwise(case)
        return case


def learn(
    labelled: DataFrame,
    bad: str,
    split_by: str,
    thresholds: int = 24,
    most_conditions: int = 3,
    precision: float = 0.95,
    chance: float = 0.01,
) -> DecisionList:
    """Sequential covering over text statistics: rules that find the rows where ``bad`` is true.

    Thresholds are quantiles of each feature in both classes, found in one pass. The rows become small arrays
    of bin numbers, written once. Then, rule by rule: two thirds of the rows not yet covered (by a hash of
    ``split_by``) grow a rule by the condition with the highest information gain, until it covers no good row
    or has ``most_conditions``; the other third prunes it to the prefix with the best (bad - good) / covered
    there. A rule is kept if that third gives it ``precision`` and a bad row, and if so many bad rows among all it
    covers would come about by ``chance`` at most: the probability of drawing them at random, times the number of
    rules of that length. So a few rows are enough where bad ones are rare, and not otherwise. After a rule
    that fails, its first feature and direction are set aside and the next best is tried; all are tried again
    once a rule was kept, and the list ends when none is kept any more. Ties go to the first feature, ``<=`` and
    the lowest threshold; repeated rows count each. Only counts per (feature, bin) reach the driver, so all
    labelled rows are used.
    No bad or no good rows give an empty list. NULL in ``bad`` rows are left out.
    """
    columns = features()
    names = list(columns)
    rows = labelled.filter(F.col(bad).isNotNull()).select(
        F.col(bad).alias("bad"), F.col(split_by).alias("_id"), *[c.alias(n) for n, c in columns.items()]
    )
    rows = stored(rows, "rules-labelled")
    at = [(i + 0.5) / thresholds for i in range(thresholds)]
    asked = [
        F.percentile_approx(F.when(F.col("bad") == side, F.col(n)), at, 2000).alias(f"{n}_{side}")
        for n in names for side in (True, False)
    ]
    found = rows.agg(*asked, F.count_if("bad").alias("_bad"), F.count_if(~F.col("bad")).alias("_good")).first()
    if not found["_bad"] or not found["_good"]:
        return DecisionList()
    cuts = [sorted(set(found[f"{n}_True"] or []) | set(found[f"{n}_False"] or [])) for n in names]
    bins = F.array(*[_bin(F.col(n), cut) for n, cut in zip(names, cuts, strict=True)])
    binned = rows.select("bad", bins.alias("bins"), (F.pmod(F.xxhash64("_id"), F.lit(3)) == 0).alias("prune"))
    # rows with the same bins count together
    binned = stored(binned.groupBy("bad", "bins", "prune").agg(F.count("*").alias("n")), "rules-binned")
    rules: list[list[Condition]] = []
    tried = sum(2 * len(cut) for cut in cuts)
    aside: set[tuple[int, bool]] = set()
    kept = False
    left = binned
    while True:
        rule = _grow(left.filter(~F.col("prune")), most_conditions, aside)
        if rule:
            if pruned := _prune(left, rule, precision, chance, tried):
                rules.append(pruned)
                left, kept = binned.filter(~_any(rules)), True
            else:
                aside.add((rule[0].feature, rule[0].above))
        elif kept:
            aside, kept = set(), False
        else:
            break
    return DecisionList([
        [(names[c.feature], ">" if c.above else "<=", float(cuts[c.feature][c.bin])) for c in rule] for rule in rules
    ])


def _bin(value: Column, cuts: Sequence[float]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < value))


def _holds(conditions: Sequence[Condition]) -> Column:
    holds = F.lit(True)
    for c in conditions:
        value = F.col("bins")[c.feature]
        holds = holds & (value > c.bin if c.above else value <= c.bin)
    return holds


def _any(rules: Sequence[Sequence[Condition]]) -> Column:
    covered = F.lit(False)
    for rule in rules:
        covered = covered | _holds(rule)
    return covered


def _grow(rows: DataFrame, most: int, aside: set[tuple[int, bool]]) -> list[Condition]:
    """The rule with the highest gains whose first condition isn't set aside."""
    rule: list[Condition] = []
    while len(rule) < most:
        counts = rows.filter(_holds(rule)).select("bad", "n", F.posexplode("bins").alias("feature", "bin")).groupBy(
            "feature", "bin"
        ).agg(
            F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("bad"),
            F.sum(F.when(F.col("bad"), 0).otherwise(F.col("n"))).alias("good"),
        )
        table: dict[int, dict[int, tuple[int, int]]] = {}
        for r in counts.collect():  # at most features x (2 x thresholds + 1) rows
            table.setdefault(r["feature"], {})[r["bin"]] = (r["bad"], r["good"])
        if not table:
            break
        bad, good = (sum(x[k] for x in table[0].values()) for k in (0, 1))
        if not bad or not good:
            break
        before, best = log2(bad / (bad + good)), (0.0, None)
        for feature, by_bin in sorted(table.items()):
            below = [0, 0]
            for b in sorted(by_bin)[:-1]:
                below = [below[k] + by_bin[b][k] for k in (0, 1)]
                for above, (p, n) in ((False, below), (True, [bad - below[0], good - below[1]])):
                    if not rule and (feature, above) in aside:
                        continue
                    gain = p * (log2(p / (p + n)) - before) if p else 0.0
                    if gain > best[0] + 1e-9:
                        best = (gain, Condition(feature, above, b))
        if best[1] is None:
            break
        rule.append(best[1])
    return rule


def _prune(rows: DataFrame, rule: list[Condition], precision: float, chance: float, tried: int) -> list[Condition]:
    prefixes = [[], *(rule[: k + 1] for k in range(len(rule)))]
    counts = rows.agg(*[
        F.coalesce(F.sum(F.when(_holds(p) & (F.col("bad") == side) & among, F.col("n"))), F.lit(0)).alias(f"{k}_{side}_{name}")
        for k, p in enumerate(prefixes) for side in (True, False) for name, among in (("third", F.col("prune")), ("all", F.lit(True)))
    ]).first()
    third, whole = ([(counts[f"{k}_True_{x}"], counts[f"{k}_False_{x}"]) for k in range(len(prefixes))] for x in ("third", "all"))
    scored = [((b - g) / (b + g), -k, b, g) for k, (b, g) in enumerate(third) if k and b + g]
    if not scored:
        return []
    _, k, b, g = max(scored)
    hits, drawn = whole[-k][0], sum(whole[-k])
    enough = b and b >= precision * (b + g) and _tail(hits, drawn, *whole[0]) * tried**-k <= chance
    return prefixes[-k] if enough else []


def _tail(hits: int, drawn: int, bad: int, good: int) -> float:
    """The probability that ``drawn`` of the rows, drawn at random, hold ``hits`` bad ones or more."""
    def ways(n: int, k: int) -> float:
        return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)

    whole, total = ways(bad + good, drawn), 0.0
    for x in range(max(hits, drawn - good), min(bad, drawn) + 1):
        term = exp(ways(bad, x) + ways(good, drawn - x) - whole)
        total += term
        if x * (bad + good) > bad * drawn and term <= 1e-9 * total:  # beyond the mean, terms only get smaller
            break
    return total
