"""Quality rules with thresholds from mergeable quantile sketches.

All features are DataFrame expressions inside the row.  Repeated windows are found on 64-bit hashes of
8 words (three rounds of pairing neighbours), sorted inside the row only where a text has any.

Fixed cutoffs stay as the base rule.  The method's verdict takes each metric's quartiles from KLL
sketches: one for each language and source, built with partial aggregation and merged; a group with
fewer than ``LEAST`` rows takes the merged sketch of its language.  A row passes if each metric is
within ``SPREAD`` interquartile ranges of the group's median; a floor for the range keeps uniform
groups from failing texts that differ little.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import materialize

_GAP = "[ \\t-\\r]+"
#: words of a window, and ranges beyond the median that a metric may lie
WINDOW, SPREAD = 8, 4.0
#: rows under which a group takes its language's sketch, and the sketch's size parameter
LEAST, SKETCH_K = 200, 400
#: metric -> (least interquartile range, whether low values fail too)
METRICS = {"word_length": (1.0, True), "symbol_ratio": (0.03, False), "dup_line_ratio": (0.1, False), "repeat_ratio": (0.06, False)}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _pairs(h: Column, step: int, op: Callable[[Column, Column], Column]) -> Column:
    """op of the elements ``step`` apart."""
    n = F.greatest(F.size(h) - step, F.lit(0))
    return F.zip_with(F.slice(h, 1, n), F.slice(h, F.lit(step + 1), n), op)


def _covered(windows: Column) -> Column:
    """Words in windows whose hash occurs twice or more. windows: array of hashes by place."""
    ranked = F.sort_array(F.zip_with(windows, F.sequence(F.lit(0), F.size(windows) - 1), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = let(ranked, lambda s: F.flatten(F.filter(_pairs(s, 1, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))), lambda x: x.isNotNull())))
    places = F.sort_array(F.array_distinct(twice))
    return let(places, lambda p: F.aggregate(_pairs(p, 1, lambda a, b: F.least(b - a, F.lit(WINDOW))), F.lit(WINDOW).cast("long"), lambda t, x: t + x))


def repeat_words(words: Column) -> Column:
    """Number of words in 8-word windows that the array holds twice or more, the first included."""
    def of(h: Column) -> Column:
        for step in (1, 2, 4):
            h = (lambda step: let(h, lambda x: _pairs(x, step, lambda a, b: F.xxhash64(a, b))))(step)
        return let(h, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), _covered(w)).otherwise(F.lit(0).cast("long")))

    return let(words, lambda w: F.when(F.size(w) > WINDOW, of(F.transform(w, lambda x: F.xxhash64(x)))).otherwise(F.lit(0).cast("long")))


def features(text: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, _GAP, -1), "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^ \\t-\\r]"))
    both = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), repeat_words(w).alias("repeat")))
    dup = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    return {"words": both, "lines": dup, "n_symbols": F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long")}


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    raw = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), *(c.alias(k) for k, c in features(F.col(text_col)).items()))
    n, chars, repeat = F.col("words.n"), F.col("words.chars"), F.col("words.repeat")
    return raw.select(
        "doc_id", "lang", "source", n.alias("n_words"), chars.alias("word_chars"), "n_symbols", F.col("lines.dup").alias("n_dup_lines"), repeat.alias("n_repeat_words"),
        ((n < 20) | (100 * repeat > 30 * n)).alias("base_failed"),
        F.when(n > 0, chars / n).alias("word_length"), F.when(n > 0, F.col("n_symbols") / chars).alias("symbol_ratio"),
        F.when(F.col("lines.n") > 0, F.col("lines.dup") / F.col("lines.n")).alias("dup_line_ratio"), F.when(n > 0, repeat / n).alias("repeat_ratio"),
    )


def limits(rows: DataFrame) -> DataFrame:
    """lang, source, <metric>_low, <metric>_high from sketches."""
    own = rows.groupBy("lang", "source").agg(F.count("*").alias("n"), *(F.kll_sketch_agg_double(m, F.lit(SKETCH_K)).alias(m) for m in METRICS))
    own = materialize(own)
    whole = own.groupBy(F.col("lang").alias("lang_all")).agg(*(F.kll_merge_agg_double(m).alias(f"{m}_all") for m in METRICS))
    both = own.join(whole, own["lang"].eqNullSafe(whole["lang_all"]))
    cols = []
    for m, (least, low) in METRICS.items():
        sketch = F.when(F.col("n") >= LEAST, F.col(m)).otherwise(F.col(f"{m}_all"))
        q1, q2, q3 = (F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(q))) for q in (0.25, 0.5, 0.75))
        reach = SPREAD * F.greatest(q3 - q1, F.lit(least))
        cols += [(q2 - reach if low else F.lit(float("-inf"))).alias(f"{m}_low"), (q2 + reach).alias(f"{m}_high")]
    return both.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *cols)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """A row per input row: doc_id, lang, source, counts, base_failed, the metrics, their limits and kept.

    A null or empty text has no words, fails the base rule and enters no sketch.  Null languages and
    sources are groups of their own.  A metric at its limit passes.  Repeated rows stay; an empty
    table gives an empty result.
    """
    rows = materialize(measured(docs, id_col, text_col, lang_col, source_col))
    bounds = limits(rows)
    fine = F.lit(True)
    for m in METRICS:
        fine = fine & F.coalesce((F.col(m) >= F.col(f"{m}_low")) & (F.col(m) <= F.col(f"{m}_high")), F.lit(True))
    joined = rows.join(bounds, rows["lang"].eqNullSafe(bounds["g_lang"]) & rows["source"].eqNullSafe(bounds["g_source"]), "left").drop("g_lang", "g_source")
    return joined.withColumn("kept", ~F.col("base_failed") & fine)
