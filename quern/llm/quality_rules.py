"""Quality rules: a table of thresholds, compiled into one projection of built-in functions.

Every statistic of a text comes from one pass over its array of words or lines, inside the row; nothing is shuffled and
no user function runs. Each rule is a name, a statistic and its bounds, so a table from a configuration file works too.

Cases: a null or empty text has no words, fails the base and isn't kept. Statistics look only at the text, so null ids,
repeated rows and ties need no rule. Texts of any length are taken whole, each in its row. Columns of the input that clash
with a result's name are replaced by the result. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let, shielded, words

# The symbols that the contract counts, and frequent function words of four languages.
SYMBOLS = "#*$%&|<>"
STOP_WORDS = (
    "the of and to in is that it for was on are as with be by this at from or an "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als "
    "le la les de et des en un une du que est pour qui dans par sur pas au "
    "el los las del y se por con para una su al lo como más"
).split()


@dataclass(frozen=True)
class Rule:
    """A text passes if low <= statistic <= high; an open end is None. Texts for which the statistic is null pass."""

    name: str
    statistic: str
    low: float | None = None
    high: float | None = None


#: The shipped table. Ratios are to words or lines, as their names say.
RULES = (
    Rule("mean word length", "mean_word_chars", 2.0, 12.0),
    Rule("symbols per word", "symbol_ratio", high=0.2),
    Rule("letters per character", "letter_ratio", low=0.6),
    Rule("stop words", "stop_ratio", low=0.02),
    Rule("repeated lines", "dup_line_ratio", high=0.5),
    Rule("capitals per letter", "capital_ratio", high=0.5),
    Rule("bulleted lines", "bullet_ratio", high=0.9),
    Rule("lines that trail off", "ellipsis_ratio", high=0.3),
)


#: The low bits of a packed window hash hold its position; texts of more words are counted by sorting the windows.
POSITION_BITS = 20


def _covered(positions: Column, n: int) -> Column:
    """Words in the union of the n-word windows that start at these ascending positions."""
    gaps = F.transform(positions, lambda p, i: F.least(F.lit(n), F.coalesce(F.get(positions, i + 1) - p, F.lit(n))))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)


def _with_repeat_words(df: DataFrame, w: str, n: int = 3) -> DataFrame:
    """df with n_repeat_words: words inside an n-word window that is found twice or more in the text.

    Each window's hash carries its position in the low bits, so that one sort of plain longs brings equal windows side by
    side; neighbours are then compared word by word. If two unequal windows share the hash bits, or the text is too long
    for the position bits, the windows themselves are sorted, so the count is exact.
    """
    low = (1 << POSITION_BITS) - 1
    count = F.size(w) - (n - 1)
    starts = F.slice(F.col(w), 1, F.greatest(count, F.lit(0)))
    gram = lambda i: [F.get(w, i + k) for k in range(n)]
    packed = F.transform(starts, lambda x, i: F.xxhash64(x, *gram(i)[1:]).bitwiseAND(F.lit(~low)).bitwiseOR(i))
    df = df.withColumn("_sorted", F.when((count > 1) & (count <= low), F.sort_array(packed)))
    equal = lambda a, b: F.shiftrightunsigned(a.bitwiseXOR(b), POSITION_BITS) == 0
    df = df.withColumn("_pairs", F.filter(F.zip_with("_sorted", F.slice("_sorted", 2, F.greatest(count, F.lit(1))), lambda a, b: F.when(equal(a, b), F.struct(a.alias("a"), b.alias("b")))), lambda x: x.isNotNull()))
    place = lambda x: x.bitwiseAND(F.lit(low)).cast("int")
    clash = F.exists("_pairs", lambda x: F.concat(*[(F.get(w, place(x["a"]) + k) == F.get(w, place(x["b"]) + k)).cast("string") for k in range(n)]).contains("false"))
    hits = F.sort_array(F.array_distinct(F.flatten(F.transform("_pairs", lambda x: F.array(place(x["a"]), place(x["b"]))))))
    by_window = let(F.sort_array(F.transform(starts, lambda x, i: F.struct(F.struct(*gram(i)).alias("g"), i.alias("p")))), lambda s: F.sort_array(F.array_compact(F.transform(
        s, lambda x, j: F.when((x["g"] == F.get(s, j - 1)["g"]) | (x["g"] == F.get(s, j + 1)["g"]), x["p"])))))
    return df.withColumn("n_repeat_words", F.when(count < 2, F.lit(0).cast("long")).when(
        F.size("_pairs") == 0, F.lit(0).cast("long")).when(
        ~clash, let(hits, lambda p: _covered(p, n))).otherwise(let(by_window, lambda p: _covered(p, n)))).drop("_sorted", "_pairs")


def with_statistics(df: DataFrame, text: str = "text", symbols: str = SYMBOLS, stop_words=tuple(STOP_WORDS)) -> DataFrame:
    """df with the statistics of each text; narrow projections only."""
    df, restored = shielded(df, "_words", "_lines", "_sorted", "_pairs")
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns({"_words": words(F.col(text)), "_lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    w, lines = F.col("_words"), F.col("_lines")
    # words as they are mostly written: all small, or with a capital first
    stops = [x for s in dict.fromkeys(stop_words) for x in (s, s.capitalize())]
    share = lambda part, whole: F.try_divide(part.cast("double"), whole.cast("double"))
    df = _with_repeat_words(df, "_words").withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.translate(t, SPACES, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, symbols, ""))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_letters": F.length(F.regexp_replace(t, r"[^\p{L}]+", "")).cast("long"),
        "n_capitals": F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long"),
        "n_stop_words": F.size(F.filter(w, lambda x: x.isin(stops))).cast("long"),
        "n_bullet_lines": F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•‣·]"))).cast("long"),
        "n_ellipsis_lines": F.size(F.filter(lines, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).cast("long"),
    }).drop("_words", "_lines")
    n, m = F.col("n_words"), F.col("n_lines")
    return restored(df).withColumns({
        "mean_word_chars": share(F.col("word_chars"), n), "symbol_ratio": share(F.col("n_symbols"), n),
        "letter_ratio": share(F.col("n_letters"), F.col("word_chars")), "stop_ratio": share(F.col("n_stop_words"), n),
        "capital_ratio": share(F.col("n_capitals"), F.col("n_letters")), "dup_line_ratio": share(F.col("n_dup_lines"), m),
        "bullet_ratio": share(F.col("n_bullet_lines"), m), "ellipsis_ratio": share(F.col("n_ellipsis_lines"), m)})


def compile_rules(rules) -> tuple[Column, Column]:
    """The names of the rules that a row breaks, and whether it breaks none."""
    broken = []
    for r in rules:
        c, bad = F.col(r.statistic), F.lit(False)
        if r.low is not None:
            bad = bad | (c < r.low)
        if r.high is not None:
            bad = bad | (c > r.high)
        broken.append(F.when(F.coalesce(bad, F.lit(False)), F.lit(r.name)))
    names = F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")
    return names, F.size(names) == 0


def quality_rules(df: DataFrame, text: str = "text", rules=RULES, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """df with its statistics, base_failed, broken_rules and kept (false if base_failed, else whether no rule is broken)."""
    names, passed = compile_rules(rules)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return with_statistics(df, text).withColumns({"base_failed": failed, "broken_rules": names, "kept": ~failed & passed})
