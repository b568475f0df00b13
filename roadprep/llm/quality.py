"""Quality rules as a short-circuit cascade, DataFrame functions only."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Rows at most on which the cost and the selectivity of rules are estimated, and how often each is evaluated on them.
#: They set the order of rules, never a verdict.
SAMPLE_ROWS, REPEATS = 200, 10
#: Texts longer than this are not in that sample.
SAMPLE_CHARS = 50_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with `value` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _count(text: Column, other: str) -> Column:
    """Code points of a text that don't match the class `other`."""
    return F.length(F.regexp_replace(text, other, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return _count(text, rf"[^{SYMBOLS}]+")


def n_duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def words_of(text: Column) -> Column:
    """The runs of characters other than space and U+0009 to U+000D."""
    return F.array_remove(F.split(text, SPACE), "")


def n_repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows of `window` words that are found twice or more in the text.

    Windows are compared by 64-bit hashes. Only texts in which some hash is found twice sort their windows: equal
    hashes are then neighbours, and the windows' ranges are added up in the order of position.
    """

    def of_hashes(h: Column) -> Column:
        return F.transform(F.slice(h, 1, F.size(h) - (window - 1)), lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, window))))

    def of_sorted(s: Column) -> Column:
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        at = F.transform(s, lambda x, i: F.when(same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)), x["i"]))
        return let(F.sort_array(F.array_compact(at)), covered)

    def covered(at: Column) -> Column:
        each = F.transform(at, lambda p, i: F.least(F.lit(window), p - F.coalesce(F.get(at, i - 1), F.lit(-window))))
        return F.aggregate(each, F.lit(0).cast("long"), lambda a, b: a + b)

    def of_windows(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) < F.size(w), let(ordered, of_sorted)).otherwise(F.lit(0).cast("long"))

    hashes = F.transform(words, lambda x: F.xxhash64(x))
    return F.when(F.size(words) > window, let(let(hashes, of_hashes), of_windows)).otherwise(F.lit(0).cast("long"))


class Features:
    """What rules read of a text: each attribute is a column; one that no rule asks for is not computed."""

    def __init__(self, text: Column, words: Column, known: Column | None = None):
        self.text, self.words, self.known = text, words, known

    def __getattr__(self, name: str) -> Column:
        if self.known is not None and name in OUTPUT:
            return self.known[name]
        return FEATURES[name](self.text, self.words)


#: Features by name, over the text and its words.
FEATURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda t, w: F.size(w).cast("long"),
    "word_chars": lambda t, w: F.length(F.array_join(w, "")).cast("long"),
    "n_symbols": lambda t, w: n_symbols(t),
    "n_dup_lines": lambda t, w: n_duplicate_lines(t),
    "n_repeat_words": lambda t, w: n_repeated_words(w),
    "n_lines": lambda t, w: F.size(F.split(t, "\n")),
    "letters": lambda t, w: _count(t, r"[^\p{L}]+"),
    "capitals": lambda t, w: _count(t, r"[^\p{Lu}]+"),
}
#: Those that the report returns.
OUTPUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A document that `rejects` holds for goes; null counts as false."""

    name: str
    rejects: Callable[[Features], Column]


def default_rules() -> list[Rule]:
    """The base rules, `length` and `repetition`, and the others. Thresholds are parameters of a rule's own column."""
    return [
        Rule("length", lambda f: f.n_words < 10),
        Rule("repetition", lambda f: 100 * f.n_repeat_words > 20 * f.n_words),
        Rule("symbols", lambda f: 100 * f.n_symbols > 25 * f.n_words),
        Rule("capitals", lambda f: 100 * f.capitals > 50 * f.letters),
        Rule("letters", lambda f: 100 * f.letters < 40 * f.word_chars),
        Rule("word_length", lambda f: let(f.word_chars, lambda c: (c < 2 * f.n_words) | (c > 15 * f.n_words))),
        Rule("lines", lambda f: 100 * f.n_dup_lines > 70 * f.n_lines),
    ]


def of_text(text: Column, body: Callable[[Features], Column]) -> Column:
    """body over the features of a text (null: empty); text and words are computed once."""
    return let(F.coalesce(text, F.lit("")), lambda t: let(words_of(t), lambda w: body(Features(t, w))))


def measure(docs: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS, text_col: str = "text") -> list[tuple[str, float, float]]:
    """(name, seconds, share of rows rejected) of each rule on a sample of at most `sample_rows` rows.

    Each rule is evaluated REPEATS times on each row; the time of a job that only reads the rows' words is taken off, so
    that what a job costs besides its rows does not count.
    """
    # head() reads as many partitions as it takes for these rows; very long texts would only make the sample large
    head = docs.select(F.col(text_col).alias("text")).filter(F.length("text") <= SAMPLE_CHARS).head(sample_rows)
    sample = docs.sparkSession.createDataFrame(head, "text string").repartition(2)
    sample = sample.select("text", F.explode(F.sequence(F.lit(1), F.lit(REPEATS)))).persist()

    def timed(column: Column) -> tuple[float, int]:
        began = time.perf_counter()
        n = sample.agg(F.count_if(column)).first()[0]
        return time.perf_counter() - began, n

    try:
        rows = max(1, sample.count())
        empty = of_text(F.col("text"), lambda f: f.n_words < 0)
        timed(empty)  # compiles and is not used
        base = min(timed(empty)[0] for _ in range(2))
        out = []
        for rule in rules:
            seconds, rejected = timed(of_text(F.col("text"), rule.rejects))
            out.append((rule.name, max(seconds - base, 1e-4), rejected / rows))
        return out
    finally:
        sample.unpersist()


def cascade_order(measured: list[tuple[str, float, float]]) -> list[str]:
    """Names by rejected share per second, the best first; ties by name."""
    return [m[0] for m in sorted(measured, key=lambda m: (-m[2] / max(m[1], 1e-6), m[0]))]


def cascade(rules: list[Rule], order: list[str], f: Features) -> Column:
    """The name of the first rule that rejects, null if none does. Later branches are not evaluated."""
    by_name = {r.name: r for r in rules}
    out = F
    for name in order:
        out = out.when(F.coalesce(by_name[name].rejects(f), F.lit(False)), F.lit(name))
    return out.otherwise(F.lit(None).cast("string")) if order else F.lit(None).cast("string")


def base_failed(f: Features) -> Column:
    return (f.n_words < 10) | (100 * f.n_repeat_words > 20 * f.n_words)


def quality_report(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept for each row.

    Null texts have no words. `kept` is true if no rule of the cascade rejects; the cascade's order comes from `measure`
    and changes the cost, not the verdict. What the report returns is computed once for each text, and rules read it;
    only what no column holds is computed as far as the cascade gets. An empty table gives no rows; repeated rows stay rows; other columns are not read. Narrow: no shuffle.
    """
    rules = default_rules() if rules is None else rules
    order = cascade_order(measure(docs, rules)) if rules else []

    def report(f: Features) -> Column:
        known = F.struct(*(getattr(f, n).alias(n) for n in OUTPUT))
        return let(known, lambda k: verdict(Features(f.text, f.words, k)))

    def verdict(f: Features) -> Column:
        return F.struct(*(f.known[n].alias(n) for n in OUTPUT), base_failed(f).alias("base_failed"), cascade(rules, order, f).alias("rejected_by"))

    # a row number, always true here: a later filter on a column is then not rewritten over all that it is made of
    row = F.when(F.monotonically_increasing_id() >= 0, of_text(F.col("text"), report))
    out = docs.select("doc_id", row.alias("r"))
    return out.select("doc_id", *(F.col(f"r.{n}").alias(n) for n in OUTPUT), F.col("r.base_failed").alias("base_failed"), (~F.col("r.base_failed") & F.col("r.rejected_by").isNull()).alias("kept"))


def keep_good(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that no rule of the cascade rejects, with their columns as they were, whatever their names.

    One filter: each rule's features are computed only where the rules before it kept the text.
    """
    rules = default_rules() if rules is None else rules
    order = cascade_order(measure(docs, rules, text_col=text_col)) if rules else []
    return docs.filter(of_text(F.col(text_col), lambda f: cascade(rules, order, f).isNull()))
