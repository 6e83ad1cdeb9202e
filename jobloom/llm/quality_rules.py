"""Quality rules: a threshold table compiled into one Spark projection.

Every metric is a column expression of built-in functions; the table below names a metric
and the range a document has to stay in.  No user function runs, and nothing is shuffled.

Defined cases: a null text is an empty one (no words, fails the length rule); a document
whose text repeats keeps a verdict of its own; extra columns pass through, and the operator's
columns win over input columns of the same name; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textmap import fresh

# White space between words, symbols counted, stop words of en, fr, de, es.
SPACES = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"
STOP_WORDS = tuple("""
a an and are as at be by for from in is it of on that the this to was with
au avec dans de des du elle en est et la le les ou par pas pour que qui sur un une
auf das dem den der die ein eine im in ist mit nicht sich und von zu
con del el es las los no para por que se una y
""".split())
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A document passes if ``low <= metric <= high`` (a bound of None is open)."""
    name: str
    metric: str
    low: float | None = None
    high: float | None = None
    langs: tuple[str, ...] | None = None     # the languages it can judge, where one is known


BASE_RULES = (
    Rule("length", "n_words", low=20),
    Rule("repetition", "repeat_ratio", high=0.30),
)
RULES = (
    Rule("word_length", "mean_word_chars", low=2.5, high=12.0),
    Rule("symbols", "symbol_ratio", high=0.10),
    Rule("stop_words", "stop_ratio", low=0.02, langs=("en", "fr", "de", "es")),
    Rule("capitals", "capital_ratio", high=0.30),
    Rule("stutter", "stutter_ratio", high=0.30),
    Rule("duplicate_lines", "dup_line_ratio", high=0.50),
)


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _n_of(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are among the (single-byte) ``chars``."""
    return (F.octet_length(text) - F.octet_length(_without(text, chars))).cast("long")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where a lambda uses it for each item
    (the optimiser would otherwise put the whole expression in place of a column used once)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def _repeat_words(w: Column, window: int) -> Column:
    """Words inside windows that occur twice or more: equal windows are neighbours once sorted;
    the starts that have an equal neighbour cover ``window`` words each, overlaps once."""
    same = lambda a, b: F.coalesce(a["w"] == b["w"], F.lit(False))
    at = F.sequence(F.lit(0), F.size(w) - window)
    ordered = F.sort_array(F.transform(at, lambda i: F.struct(
        F.array_join(F.slice(w, i + 1, window), " ").alias("w"), i.alias("i"))))
    starts = _let(ordered, lambda o: F.sort_array(F.transform(
        F.filter(o, lambda x, i: same(x, F.get(o, i + 1))
                 | ((i > 0) & same(x, F.get(o, F.greatest(i - 1, F.lit(0)))))),
        lambda x: x["i"])))
    return _let(starts, lambda p: F.aggregate(
        F.transform(p, lambda x, i: F.least(
            F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window)))),
        F.lit(0).cast("long"), lambda a, b: a + b.cast("long")))


def _word_counts(w: Column, window: int) -> Column:
    """All counts over the array of words, as one struct (the words are split once)."""
    at = F.sequence(F.lit(0), F.size(w) - window)
    hashes = _let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.transform(
        at, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(window)])))
    again = _let(hashes, lambda v: F.size(F.array_distinct(v)) < F.size(v))
    return F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long")
        .alias("n_stop_words"),
        F.size(F.filter(w, lambda x: (x == F.upper(x)) & (x != F.lower(x)))).cast("long")
        .alias("n_capitals"),
        F.size(F.filter(w, lambda x, i: F.coalesce(x == F.get(w, i + 1), F.lit(False))))
        .cast("long").alias("n_stutters"),
        F.when((F.size(w) > window) & again, _repeat_words(w, window))
        .otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
    )


def metrics(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """Adds the counts and ratios that the rules name.

    ``n_repeat_words``: words in ``window``-word windows that occur twice or more in the
    text, the first occurrence included.  Window hashes decide which texts repeat at all;
    only those compare the windows themselves, so the count is exact.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    spaced = t
    for c in SPACES[:-1]:
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    m = fresh("_m", docs)
    counted = docs.withColumn(m, F.struct(
        _let(F.array_remove(F.split(spaced, " "), ""), lambda w: _word_counts(w, window)).alias("w"),
        _let(lines, lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        )).alias("l"),
        (F.char_length(t) - _n_of(t, SPACES)).cast("long").alias("word_chars"),
        _n_of(t, SYMBOLS).alias("n_symbols"),
        # not deterministic: a filter on a count is then evaluated above this column and
        # doesn't repeat the whole expression for each count it names
        F.monotonically_increasing_id().alias("once"),
    ))
    counted = counted.withColumns({
        **{c: F.col(f"{m}.w.{c}") for c in
           ("n_words", "n_stop_words", "n_capitals", "n_stutters", "n_repeat_words")},
        "n_lines": F.col(f"{m}.l.n_lines"), "n_dup_lines": F.col(f"{m}.l.n_dup_lines"),
        "word_chars": F.col(f"{m}.word_chars"), "n_symbols": F.col(f"{m}.n_symbols"),
    })
    return counted.withColumns({
        "repeat_ratio": _ratio("n_repeat_words", "n_words"),
        "mean_word_chars": _ratio("word_chars", "n_words"),
        "symbol_ratio": _ratio("n_symbols", "n_words"),
        "stop_ratio": _ratio("n_stop_words", "n_words"),
        "capital_ratio": _ratio("n_capitals", "n_words"),
        "stutter_ratio": _ratio("n_stutters", "n_words"),
        "dup_line_ratio": _ratio("n_dup_lines", "n_lines"),
    }).drop(m)


def broken(rules: tuple[Rule, ...], lang: str | None = None) -> Column:
    """Names of the rules that a row of metrics breaks, from the table, as one array column.  With a
    ``lang`` column a rule for some languages doesn't judge rows of another known one."""
    out = []
    for r in rules:
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (F.col(r.metric) < F.lit(r.low))
        if r.high is not None:
            bad = bad | (F.col(r.metric) > F.lit(r.high))
        if r.langs and lang:
            bad = bad & F.coalesce(F.col(f"`{lang}`").isin(*r.langs), F.lit(True))
        out.append(F.when(bad, F.lit(r.name)))
    return F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")


def apply_rules(docs: DataFrame, text: str = "text", base: tuple[Rule, ...] = BASE_RULES,
                rules: tuple[Rule, ...] = RULES, lang: str | None = None) -> DataFrame:
    """Documents with all metrics, ``base_failed``, ``kept`` and ``failed_rules``.

    The share k/n > 0.30 decides like 100 * k > 30 * n: equal quotients round alike.
    """
    out = metrics(docs, text)
    first, more = fresh("_base", out), fresh("_more", out)
    out = out.withColumn(first, broken(base, lang)).withColumn(more, broken(rules, lang))
    return (out.withColumn("base_failed", F.size(first) > 0)
            .withColumn("failed_rules", F.concat(first, more))
            .withColumn("kept", F.size("failed_rules") == 0)
            .drop(first, more))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """Only the documents that break no rule, with the columns of ``docs``.  Where ``docs`` has a
    ``lang`` column, stop words judge only the languages whose stop words are known."""
    columns = docs.columns
    lang = F.col("lang") if "lang" in columns else F.lit(None).cast("string")
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"),
                        F.col(f"`{text}`").alias("text"), lang.alias("lang"))
    return apply_rules(inner, lang="lang").where("kept").select("_row.*")
