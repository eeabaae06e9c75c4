"""Quality rules: a threshold table compiled into one Spark projection."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from costlens.llm.tables import prepare

#: Common words of the four languages.
STOP_WORDS = (
    "the of and to in a is that it for was on are as with his they at be this have from or had "
    "by not but what all were when we there an your which their if will one has been "
    "der die das und ist nicht mit sich den von zu ein eine im für auf dem des als auch es bei "
    "le la les de des et un une est que qui dans pour pas sur avec par ce il plus en du au "
    "el los las y que una por con para del se su no lo al más como").split()
SPACES = "\t\n\x0b\x0c\r"
HAS_WORD = "[^\\x20\\x09-\\x0D]"


class Rule(NamedTuple):
    """A row of the threshold table: low <= metric <= high, from `words` words on."""
    metric: str
    low: float | None = None
    high: float | None = None
    words: int = 0


#: A metric is a count or a ratio of two; a null one (no words, no lines) passes.
RULES = (
    Rule("n_words", low=10),
    Rule("mean_word_chars", low=1.5, high=25),
    Rule("symbol_ratio", high=0.1),
    Rule("bang_ratio", high=0.5),
    Rule("stop_ratio", low=0.01, words=30),
    Rule("letter_word_ratio", low=0.6),
    Rule("repeat_ratio", high=0.2),
    Rule("twin_ratio", high=0.3),
    Rule("dup_line_ratio", high=0.5),
    Rule("ellipsis_line_ratio", high=0.5),
    Rule("bullet_line_ratio", high=0.9),
)


def count(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).cast("long")


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, window: int = 5) -> Column:
    """Words covered by windows that a text holds twice or more.

    Windows are compared by a 64-bit hash. A text whose window hashes are all
    distinct, as most are, needs no more; else sorting (hash, place) puts equal
    windows side by side, and each repeated window covers the words up to the next.
    """
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - window + 1), lambda i: F.xxhash64(
        *[F.element_at(words, i + k) for k in range(window)]))

    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            twice = F.filter(s, lambda x, j: F.get(s, j - 1)["h"].eqNullSafe(x["h"])
                             | F.get(s, j + 1)["h"].eqNullSafe(x["h"]))
            return F.array_sort(F.transform(twice, lambda x: x["i"]))

        def total(at: Column) -> Column:
            gaps = F.transform(at, lambda x, j: F.least(
                F.lit(window), F.coalesce(F.get(at, j + 1) - x, F.lit(window))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + g)

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            let(let(placed, starts), total))

    return F.when(n < window, F.lit(0).cast("long")).otherwise(let(hashes, covered))


def parts_of(t: Column) -> Column:
    """Struct of a text, its words, its words without punctuation, and lines with a word."""
    def words(x: Column) -> Column:
        return F.filter(F.split(F.translate(x, SPACES, " " * len(SPACES)), " ", -1),
                        lambda w: w != "")
    bare = F.lower(F.regexp_replace(t, "[\\p{Punct}]+", ""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(HAS_WORD))
    return F.struct(t.alias("t"), words(t).alias("w"), words(bare).alias("bare"),
                    lines.alias("l"))


def counts_of(p: Column) -> Column:
    """Struct of the counts, from the parts."""
    def some(array: Column, test) -> Column:
        return F.size(F.filter(array, test)).cast("long")
    w, lines = p["w"], p["l"]
    return F.struct(
        F.size(w).cast("long").alias("n_words"), F.size(lines).cast("long").alias("n_lines"),
        F.length(F.translate(p["t"], SPACES + " ", "")).cast("long").alias("word_chars"),
        count(p["t"], "[#*$%&|<>]").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeated_words(w).alias("n_repeat_words"),
        some(p["bare"], lambda x: x.isin(STOP_WORDS)).alias("n_stop"),
        some(w, lambda x: x.rlike("\\p{L}")).alias("n_lettered"),
        some(w, lambda x, i: x.eqNullSafe(F.get(w, i - 1))).alias("n_twins"),
        count(p["t"], "!").alias("n_bangs"),
        some(lines, lambda x: x.rlike("(\\.\\.\\.|…)\\s*$")).alias("n_ellipsis"),
        some(lines, lambda x: x.rlike("^\\s*[-*•]")).alias("n_bullets"))


#: Ratio metrics: numerator and denominator among the counts.
RATIOS = {
    "mean_word_chars": ("word_chars", "n_words"), "symbol_ratio": ("n_symbols", "n_words"),
    "bang_ratio": ("n_bangs", "n_words"), "stop_ratio": ("n_stop", "n_words"),
    "letter_word_ratio": ("n_lettered", "n_words"), "repeat_ratio": ("n_repeat_words", "n_words"),
    "twin_ratio": ("n_twins", "n_words"), "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "ellipsis_line_ratio": ("n_ellipsis", "n_lines"), "bullet_line_ratio": ("n_bullets", "n_lines"),
}


def metric(q: Column, name: str) -> Column:
    if name not in RATIOS:
        return q[name]
    above, below = RATIOS[name]
    return q[above] / F.nullif(q[below], F.lit(0).cast("long"))


def compiled(q: Column, rules=RULES) -> Column:
    """Names of the rules that counts `q` break, as one array expression."""
    broken = []
    for r in rules:
        m, out = metric(q, r.metric), F.lit(False)
        if r.low is not None:
            out = out | F.coalesce(m < r.low, F.lit(False))
        if r.high is not None:
            out = out | F.coalesce(m > r.high, F.lit(False))
        if r.words:
            out = out & (q["n_words"] >= r.words)
        broken.append(F.when(out, F.lit(r.metric)))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def verdict(text: Column, rules=RULES) -> Column:
    """Struct of counts (`q`) and names of broken rules (`broken`).

    Values used twice are bound by `let`, so the expression stays linear wherever the
    optimizer moves it, a filter included.
    """
    t = F.coalesce(text, F.lit(""))
    return let(let(parts_of(t), counts_of), lambda q: F.struct(
        q.alias("q"), compiled(q, rules).alias("broken")))


def judge(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """`docs` with `_q` (counts), `_broken` (rules broken) and `_kept`.

    One projection of built-in functions: no user function and no shuffle. A null
    text counts as empty and fails the length rule. Repeated rows are judged alike;
    extra columns pass through (names that begin with an underscore are reserved).
    """
    prepare(docs.sparkSession)
    v = docs.withColumn("_v", verdict(F.col(f"`{text}`"), rules))
    return v.withColumns({"_q": F.col("_v.q"), "_broken": F.col("_v.broken"),
                          "_kept": F.size("_v.broken") == 0}).drop("_v")


def keep(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """The rows that break no rule, with the columns they came with."""
    prepare(docs.sparkSession)
    return docs.where(F.size(verdict(F.col(f"`{text}`"), rules)["broken"]) == 0)
