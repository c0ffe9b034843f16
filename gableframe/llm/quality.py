"""Quality rules as a short-circuit cascade, in DataFrame expressions only."""

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gableframe.llm.text import WORD
from gableframe.scratch import settle

Rule = tuple[str, Callable[[dict[str, Column]], Column]]

SPLIT = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PCT = 30
MAX_SYMBOLS_PER_10_WORDS = 2
MAX_DUP_LINES_PCT = 50
MEAN_WORD_CHARS = (2, 12)
MIN_LETTER_WORDS_PCT = 50
# The sample on which costs and rejections are measured.
SAMPLE_ROWS = 2000
SAMPLE_SEED = 7


def words_of(text: Column) -> Column:
    """The words of a text as an array; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPLIT), "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, though body names it several times."""
    return F.transform(F.array(value), body)[0]


def _after(items: Column) -> Column:
    """The items from the second on."""
    return F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0)))


def _covered(starts: Column) -> Column:
    """Words that windows from these ascending positions cover together."""
    steps = F.zip_with(starts, _after(starts), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    return F.aggregate(steps, F.lit(0), lambda total, step: total + step)


def _repeated_starts(hashes: Column) -> Column:
    """Ascending positions of the windows that occur twice or more."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def neighbours(s: Column) -> Column:
        pairs = F.zip_with(s, _after(s), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        return F.flatten(F.filter(pairs, lambda p: p.isNotNull()))

    return F.sort_array(F.array_distinct(_let(placed, neighbours)))


def repeated_words(words: Column) -> Column:
    """Words in windows of eight that the text holds twice or more, all occurrences counted.

    Windows are compared by a 64-bit hash. Only texts in which two hashes are equal are sorted.
    """
    n = F.size(words) - (WINDOW - 1)
    hashes = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(words, i, F.lit(WINDOW))))

    def count(found: Column) -> Column:
        repeats = F.size(F.array_distinct(found)) < F.size(found)
        return F.when(repeats, _let(_repeated_starts(found), _covered)).otherwise(0)

    return F.when(n > 1, _let(hashes, count)).otherwise(0).cast("long")


def signals(text: Column, words: Column) -> dict[str, Column]:
    """What the rules look at, each an expression that is computed only where it is asked for."""
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(WORD))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_repeat_words": repeated_words(words),
        "n_letter_words": F.regexp_count(body, F.lit(r"[^\x20\x09-\x0D]*\p{L}[^\x20\x09-\x0D]*")).cast("long"),
    }


# Each rule rejects where its condition holds. The two base rules come first.
BASE_RULES: list[Rule] = [
    ("few_words", lambda s: s["n_words"] < MIN_WORDS),
    ("repeated_windows", lambda s: 100 * s["n_repeat_words"] > MAX_REPEATED_PCT * s["n_words"]),
]
RULES: list[Rule] = [
    *BASE_RULES,
    ("symbols", lambda s: 10 * s["n_symbols"] > MAX_SYMBOLS_PER_10_WORDS * s["n_words"]),
    ("duplicate_lines", lambda s: 100 * s["n_dup_lines"] > MAX_DUP_LINES_PCT * s["n_lines"]),
    (
        "word_length",
        lambda s: ~s["word_chars"].between(MEAN_WORD_CHARS[0] * s["n_words"], MEAN_WORD_CHARS[1] * s["n_words"]),
    ),
    ("letters", lambda s: 100 * s["n_letter_words"] < MIN_LETTER_WORDS_PCT * s["n_words"]),
]


def _judged(text: Column, condition: Callable[[dict[str, Column]], Column]) -> Column:
    return _let(words_of(text), lambda words: condition(signals(text, words)))


def in_order_of_yield(docs: DataFrame, text_col: str = "text", rules: list[Rule] = RULES) -> list[Rule]:
    """The rules by rejections per second, as measured one by one on a bounded sample.

    The order decides how much is computed, never what is rejected: a text goes if any rule rejects
    it. So a sample that differs, or a slow machine, changes no result.
    """
    sample = settle(docs.select(F.col(f"`{text_col}`").alias("text")).sample(0.2, SAMPLE_SEED).limit(SAMPLE_ROWS), "sample")
    def measured(condition: Column) -> tuple[float, int]:
        start = time.perf_counter()
        rejected = sample.agg(F.count_if(condition)).first()[0]
        return time.perf_counter() - start, rejected

    text = F.col("text")
    idle_rule = _judged(text, lambda found: found["n_words"] < 0)
    measured(idle_rule)  # compiles what all rules share
    idle = measured(idle_rule)[0]
    gain = {}
    for name, condition in rules:
        seconds, rejected = measured(_judged(text, condition))
        gain[name] = rejected / max(seconds - idle, 0.001)
    return sorted(rules, key=lambda rule: -gain[rule[0]])


def first_rejection(rules: list[Rule], found: dict[str, Column]) -> Column:
    """The name of the first rule that rejects, null for texts that pass; later rules are not computed."""
    chain = F
    for name, condition in rules:
        chain = chain.when(condition(found), F.lit(name))
    return chain.otherwise(F.lit(None).cast("string"))


def keep_good(docs: DataFrame, text_col: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """The documents that no rule rejects, with their columns as they were.

    Null and empty texts have no words and are rejected. Repeated rows are judged alike.
    """
    ordered = in_order_of_yield(docs, text_col, rules)
    text = F.col(f"`{text_col}`")
    return docs.where(_judged(text, lambda found: first_rejection(ordered, found)).isNull())


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """Per row: doc_id, the signals, base_failed and kept. A null text counts as an empty one."""
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    ordered = in_order_of_yield(slim, "text", rules)
    text, shown = F.col("text"), ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def verdict(words: Column) -> Column:
        found = signals(text, words)

        def decide(base: Column) -> Column:
            known = found | {k: base[k] for k in shown}
            failed = F.lit(False)
            for _, condition in BASE_RULES:
                failed = failed | condition(known)
            kept = ~failed & first_rejection(ordered, known).isNull()
            return F.struct(*[known[k].alias(k) for k in shown], failed.alias("base_failed"), kept.alias("kept"))

        return _let(F.struct(*[found[k].alias(k) for k in shown]), decide)

    return slim.select("doc_id", _let(words_of(text), verdict).alias("v")).select("doc_id", "v.*")
