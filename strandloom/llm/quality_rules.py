"""Document quality rules as a short-circuit cascade of Spark column expressions.

Each rule's cost and selectivity are measured on a bounded sample; rules then run in the order of rejections per cost
inside one CASE expression, which Spark evaluates only until the first rule that rejects. A document's verdict is the
same in any order: it is kept if no rule rejects it.

Where only the verdict is wanted, a rule computes its own counts inside the CASE, so what comes after the first rejection
is never computed; where the counts are wanted too, those that are columns are read and the rest is computed there.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass
from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The words' separators, their complement and the complement of the symbols, as fixed by the contract.
_SPACE_CLASS = r"[\x20\x09-\x0D]+"
_WORD_CLASS = r"[^\x20\x09-\x0D]"
_OTHER_THAN_SYMBOLS = r"[^#*$%&|<>]+"


@dataclass(frozen=True)
class Counts:
    """What rules judge by: each is an expression over the text and its words, or a column that holds it already."""

    text: Column
    words: Column
    window: int
    held: frozenset[str] = frozenset()

    def _get(self, name: str, make: Callable[[], Column]) -> Column:
        return F.col(name) if name in self.held else make()

    @property
    def n_words(self) -> Column:
        return self._get("n_words", lambda: F.size(self.words).cast("long"))

    @property
    def word_chars(self) -> Column:
        return self._get("word_chars", lambda: F.length(F.array_join(self.words, "")).cast("long"))

    @property
    def n_symbols(self) -> Column:
        return self._get("n_symbols", lambda: F.length(F.regexp_replace(self.text, _OTHER_THAN_SYMBOLS, "")).cast("long"))

    @property
    def n_repeat_words(self) -> Column:
        return self._get("n_repeat_words", lambda: repeat_words(self.words, self.window).cast("long"))

    def dup_lines(self, body: Callable[[Column, Column], Column]) -> Column:
        """body(number of lines with a word, number of those equal to an earlier one)."""
        if "n_dup_lines" in self.held:
            return body(F.col("_n_lines"), F.col("n_dup_lines"))
        return _let(_lines(self.text), lambda x: body(F.size(x), F.size(x) - F.size(F.array_distinct(x))))


@dataclass(frozen=True)
class Rule:
    """Rejects a text where `rejects` (a column made from its counts) is true; null does not reject."""

    name: str
    rejects: Callable[[Counts], Column]


@dataclass(frozen=True)
class QualityParams:
    min_words: int = 20
    #: Percent of words inside 8-word windows that occur twice or more.
    max_repeat_percent: int = 30
    window: int = 8
    max_symbols_per_word: float = 0.25
    max_dup_line_fraction: float = 0.4
    min_mean_word: float = 1.5
    max_mean_word: float = 25.0
    max_digit_fraction: float = 0.4
    max_upper_fraction: float = 0.6
    #: Words equal to the one before them.
    max_stutter_fraction: float = 0.3
    #: Rows on which cost and selectivity are estimated, and how often a rule is timed.
    sample_rows: int = 1000
    timings: int = 3


def _let(value: Column, body) -> Column:
    """body(value) with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE_CLASS, -1), lambda w: w != "")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(_WORD_CLASS))


def repeat_words(words: Column, window: int) -> Column:
    """Words inside windows that are found twice or more in the text.

    window is a power of two. A window's hash is put together from hashes of halves. Texts without equal windows, by far the most, end
    there. Else windows are sorted by hash; equal neighbours are repeats; their places, sorted, give the words covered.
    Time is n log n in the text's words.
    """

    def marked(s: Column) -> Column:
        same = lambda x, i: (F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))) | (F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
        return F.sort_array(F.transform(F.filter(s, same), lambda x: x["p"]))

    def covered(p: Column) -> Column:
        return F.aggregate(
            p,
            F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last")),
            lambda acc, x: F.struct((acc["n"] + F.least(F.lit(window), x - acc["last"])).alias("n"), x.alias("last")),
            lambda acc: acc["n"],
        )

    def of_hashes(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(placed, lambda s: covered(marked(s))))

    def doubled(h: Column, size: int, then) -> Column:
        """Hashes of `window` words from those of `size` words: each round joins the hash at i with that at i + size."""
        if size == window:
            return then(F.slice(h, F.lit(1), F.size(h) - window + 1))
        pairs = F.zip_with(h, F.slice(h, F.lit(size + 1), F.size(h)), lambda a, b: F.xxhash64(a, b))
        return _let(pairs, lambda more: doubled(more, 2 * size, then))

    def of_words(h: Column) -> Column:
        return F.when(F.size(h) <= window, F.lit(0)).otherwise(doubled(h, 1, of_hashes))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), of_words)


def stutter(words: Column) -> Column:
    """Words equal to the one before them."""
    return F.size(F.filter(F.arrays_zip(words.alias("a"), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))).alias("b")), lambda x: x["a"] == x["b"]))


def statistics(docs: DataFrame, text_col: str = "text", params: QualityParams = QualityParams()) -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and the cascade's _words and _n_lines."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("_words", _words(text)).withColumn("_lines", _lines(text))
    counts = Counts(text, F.col("_words"), params.window)
    return out.withColumns(
        {
            "n_words": counts.n_words,
            "word_chars": counts.word_chars,
            "n_symbols": counts.n_symbols,
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": counts.n_repeat_words,
            "_n_lines": F.size("_lines"),
        }
    ).drop("_lines")


#: Columns that `statistics` leaves for the rules.
HELD = frozenset(["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])


def base_rules(params: QualityParams = QualityParams()) -> list[Rule]:
    return [
        Rule("few_words", lambda c: c.n_words < params.min_words),
        Rule("repeats", lambda c: c.n_repeat_words * 100 > c.n_words * params.max_repeat_percent),
    ]


def method_rules(params: QualityParams = QualityParams()) -> list[Rule]:
    mean = lambda c: c.word_chars / F.greatest(c.n_words, F.lit(1))
    digits = lambda c: F.length(F.regexp_replace(c.text, r"[^0-9]+", ""))
    upper = lambda c: F.length(F.regexp_replace(c.text, r"[^\p{Lu}]+", ""))
    return [
        Rule("symbols", lambda c: c.n_symbols > c.n_words * params.max_symbols_per_word),
        Rule("dup_lines", lambda c: c.dup_lines(lambda n, same: same > n * params.max_dup_line_fraction)),
        Rule("short_words", lambda c: mean(c) < params.min_mean_word),
        Rule("long_words", lambda c: mean(c) > params.max_mean_word),
        Rule("digits", lambda c: digits(c) > c.word_chars * params.max_digit_fraction),
        Rule("shouting", lambda c: upper(c) > c.word_chars * params.max_upper_fraction),
        Rule("stutter", lambda c: stutter(c.words) > c.n_words * params.max_stutter_fraction),
    ]


def _rejects(rule: Rule, counts: Counts) -> Column:
    return F.coalesce(rule.rejects(counts), F.lit(False))


def _of_text(text: Column, params: QualityParams, body: Callable[[Counts], Column]) -> Column:
    """body over the counts of a text, its words computed once; nothing else is computed unless body asks for it."""
    return _let(F.coalesce(text, F.lit("")), lambda t: _let(_words(t), lambda w: body(Counts(t, w, params.window))))


#: Costs are told apart by powers of two of so many seconds, so that the noise of a timing seldom changes the order.
COST_UNIT = 0.004


def rated(names: list[str], rejected: list[float], seconds: list[float]) -> list[str]:
    """Names by rejections per cost, most first; of equals, as given."""
    cost = [2.0 ** max(0, round(math.log2(max(s, COST_UNIT) / COST_UNIT))) for s in seconds]
    return [names[k] for k in sorted(range(len(names)), key=lambda k: (-(rejected[k] + 1e-4) / cost[k], k))]


def plan_cascade(docs: DataFrame, rules: list[Rule], params: QualityParams = QualityParams(), text_col: str = "text") -> list[Rule]:
    """Rules by rejections per cost, most first, as measured on a sample of about params.sample_rows rows of `docs`.

    Cost: the median of params.timings passes over the sample's texts that compute what the rule needs from the text,
    less that of passes that only cut the words, which all rules share. The sample decides the order only; with an empty
    sample the order is as given.
    """
    rows = docs.count()
    if not rows or len(rules) < 2:
        return list(rules)
    sampled = docs.select(F.col(text_col).alias("_text")).sample(min(1.0, params.sample_rows / rows), 11).limit(2 * params.sample_rows).repartition(2).cache()
    verdict = lambda rule: _of_text(F.col("_text"), params, lambda c: _rejects(rule, c))
    try:
        seen = sampled.agg(F.count("*").alias("n"), *[F.sum(verdict(r).cast("long")).alias(f"r{k}") for k, r in enumerate(rules)]).first()
        if not seen["n"]:
            return list(rules)

        def seconds(frame: DataFrame) -> float:
            began = time.perf_counter()
            frame.collect()
            return time.perf_counter() - began

        # in turns, as code that is compiled meanwhile makes later runs faster
        words = _of_text(F.col("_text"), params, lambda c: F.size(c.words) > 0)
        timed = [sampled.agg(F.sum(value.cast("long"))) for value in (words, *map(verdict, rules))]
        seconds(timed[0])
        floor, *took = (median(own) for own in zip(*[[seconds(frame) for frame in timed] for _ in range(params.timings)], strict=True))
        order = rated([r.name for r in rules], [seen[f"r{k}"] / seen["n"] for k in range(len(rules))], [s - floor for s in took])
        return sorted(rules, key=lambda r: order.index(r.name))
    finally:
        sampled.unpersist()


def cascade(rules: list[Rule], counts: Counts) -> Column:
    """The name of the first rule that rejects, in the given order; null if none does."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(_rejects(rule, counts), F.lit(rule.name)).otherwise(out)
    return out


def judge_quality(docs: DataFrame, *, text_col: str = "text", params: QualityParams = QualityParams()) -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rejected_by and kept.

    A null text counts as empty and fails few_words; an empty table gives no rows; repeated rows are judged alike.
    Columns of `docs` with one of the names above are replaced, as are those named _words, _lines and _n_lines; all others stay.
    rejected_by names the first rule of the cascade that rejects (null if kept); it may depend on the measured order
    where several rules reject, kept does not.
    """
    own = [*HELD, "base_failed", "rejected_by", "kept", "_words", "_lines", "_n_lines"]
    rows = docs.drop(*[c for c in own if c in docs.columns and c != text_col])
    base = base_rules(params)
    counts = Counts(F.coalesce(F.col(text_col), F.lit("")), F.col("_words"), params.window, HELD)
    order = plan_cascade(rows, [*base, *method_rules(params)], params, text_col)
    return (
        statistics(rows, text_col, params)
        .withColumns({"base_failed": _rejects(base[0], counts) | _rejects(base[1], counts), "rejected_by": cascade(order, counts)})
        .withColumn("kept", F.col("rejected_by").isNull())
        .drop("_words", "_n_lines")
    )


def drop_rejected(docs: DataFrame, *, text_col: str = "text", params: QualityParams = QualityParams()) -> DataFrame:
    """The rows of `docs` that no rule rejects, as judge_quality would, with nothing computed beyond the first rejection."""
    order = plan_cascade(docs, [*base_rules(params), *method_rules(params)], params, text_col)
    return docs.filter(_of_text(F.col(text_col), params, lambda c: cascade(order, c)).isNull())
