"""Quality rules (native): thresholds that follow each language and source, from quantile sketches.

Counts of a text are turned into five rates.  A KLL sketch per (language, source) holds the
distribution of each; sketches of one language and of all rows are merges of these, so the corpus is
aggregated once.  A rate is out of range above the 3rd quartile plus ``WIDTH`` times the spread
between the quartiles, but at least ``WIDTH`` times the ``LEAST`` spread, so that groups in which a rate hardly varies
do not reject on trifles.  The threshold of a group of n rows counts n / (n + ``PRIOR``), the rest is its language's, whose own
counts likewise beside that of all rows: small groups lean on the level above, and no single row changes that at once.
The threshold of a language, and of all rows, is the median over its sources, each with the weight n / (n + ``PRIOR``),
so below one however many rows it holds.  So a source that
is junk for the most part cannot excuse itself or others, as long as most sources are not like it:
before it is mixed, a threshold is cut to ``SLACK`` times the one of its language, and that to ``SLACK`` times the one of all rows.
The thresholds, a few rows, are joined to the documents.

All of it is built-in expressions inside the row: repeated words come from sorted (hash, position)
pairs, so their cost is n log n also for texts that only repeat.

Defined results: null and empty texts have no words and fail the base rules; a null language or
source is a group of its own; one row or many equal rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandgauge.llm.shared import write_once

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Rate -> least spread between quartiles that is taken seriously.
LEAST = {"symbols_per_word": 0.05, "dup_line_share": 0.1, "repeat_word_share": 0.08, "word_length": 0.5, "short_words": 0.5}
WIDTH, SLACK, PRIOR = 6.0, 2.0, 200
#: Thresholds are compared in steps of a thousandth when sources vote, so that a vote holds few different values.
STEPS = 1000
_SPACE = "\t\n\u000b\u000c\r "


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of the whole text; input columns of these names are replaced."""
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(whole, r"[\x20\x09-\x0D]+"), "")
    # Every array that is read more than once is a column of its own, so that it is computed once.
    given = docs.drop(*COUNTS)
    counted = (
        given.withColumn("_text", whole)
        .withColumn("_words", words)
        .withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.trim(x, F.lit(_SPACE)) != ""))
        .withColumn("_windows", F.expr("""
            CASE WHEN size(_words) < 4 THEN CAST(array() AS array<bigint>)
                 ELSE transform(sequence(0, size(_words) - 3), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2])) END"""))
        .withColumn("n_words", F.size("_words").cast("bigint"))
        .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("bigint"))
        .withColumn("n_symbols", F.length(F.regexp_replace("_text", "[^#*$%&|<>]+", "")).cast("bigint"))
        .withColumn("_n_lines", F.size("_lines").cast("bigint"))
        .withColumn("n_dup_lines", F.col("_n_lines") - F.size(F.array_distinct("_lines")))
        .drop("_words", "_text", "_lines")
        .withColumn("_pairs", F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
        .drop("_windows")
        .withColumn("n_repeat_words", F.coalesce(_repeat_words(), F.lit(0)).cast("bigint"))
    )
    # The counts leave through a generator of one row: a later filter on them cannot be moved below it, where
    # the arrays would be written out into it and built anew for every element.
    return counted.select(*given.columns, F.inline(F.array(F.struct(*COUNTS, "_n_lines"))))


def _repeat_words() -> Column:
    """Words inside 3-word windows that occur twice or more, from the sorted (hash, position) pairs of the windows."""
    n = F.size("_pairs")
    follow = F.zip_with(
        F.slice("_pairs", F.lit(1), n - 1), F.slice("_pairs", F.lit(2), n - 1),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], a["i"] + 1, a["i"] + 2, b["i"], b["i"] + 1, b["i"] + 2)))
    return F.size(F.array_distinct(F.flatten(F.filter(follow, lambda x: x.isNotNull()))))


def rates() -> dict[str, Column]:
    words = F.greatest("n_words", F.lit(1))
    return {
        "symbols_per_word": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest("_n_lines", F.lit(1)),
        "repeat_word_share": F.col("n_repeat_words") / words,
        "word_length": F.col("word_chars") / words,
        "short_words": words / F.greatest("word_chars", F.lit(1)) * 10,
    }


def thresholds(counted: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, one upper limit per rate) from merged sketches; one row per (language, source)."""
    usable = counted.filter("n_words > 0")
    names = list(LEAST)
    sketched = usable.select(F.col(lang).alias("lang"), F.col(source).alias("source"), *(c.alias(n) for n, c in rates().items())).groupBy(
        "lang", "source").agg(F.count(F.lit(1)).alias("n"), *(F.kll_sketch_agg_double(n).alias(n) for n in names))
    sketched = write_once(sketched, "sketches")

    def merged(rows: DataFrame, by: list[str], suffix: str) -> DataFrame:
        out = rows.groupBy(*by).agg(F.sum("n").alias(f"n_{suffix}"), *(F.kll_merge_agg_double(n).alias(f"{n}_{suffix}") for n in names))
        for n in names:
            low, high = (F.kll_sketch_get_quantile_double(f"{n}_{suffix}", F.lit(q)) for q in (0.25, 0.75))
            out = out.withColumn(f"{n}_{suffix}", high + WIDTH * F.greatest(high - low, F.lit(LEAST[n])))
        return out

    def voted(by: list[str], suffix: str) -> DataFrame:
        """Median over the limits of the sources; the weights n / (n + PRIOR) in thousandths."""
        weight = F.greatest(F.lit(1), (1000 * F.col(f"n_{suffix}") / (F.col(f"n_{suffix}") + PRIOR)).cast("int"))
        return merged(sketched, [*by, "source"], suffix).withColumn("_weight", weight).groupBy(*by).agg(
            F.sum(f"n_{suffix}").alias(f"n_{suffix}"),
            *((F.percentile(F.round(F.col(f"{n}_{suffix}") * STEPS), 0.5, F.col("_weight")) / STEPS).alias(f"{n}_{suffix}") for n in names))

    def shrunk(own: Column, n: Column, above: Column) -> Column:
        return (n * F.least(own, above * SLACK) + PRIOR * above) / (n + PRIOR)

    total, by_lang, own = voted([], "all"), voted(["lang"], "lang"), merged(sketched, ["lang", "source"], "own")
    # The limits of all rows are one row: a scalar, not a join.
    every = by_lang.withColumn("_all", total.select(F.struct(*(f"{n}_all" for n in names))).scalar()).withColumnRenamed("lang", "_lang")
    joined = own.join(every, F.col("lang").eqNullSafe(F.col("_lang")))
    limits = {}
    for n in names:
        language = shrunk(F.col(f"{n}_lang"), F.col("n_lang"), F.col(f"_all.{n}_all"))
        limits[n] = shrunk(F.col(f"{n}_own"), F.col("n_own"), language)
    return joined.select("lang", "source", *(c.alias(f"limit_{n}") for n, c in limits.items()))


def judge(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """``docs`` with counts, base_failed and kept; counts are taken twice, so that texts are written nowhere."""
    counted = counts(docs, text)
    return decide(counted, write_once(thresholds(counted, lang, source), "limits"), lang, source)


def with_limits(counted: DataFrame, limits: DataFrame, lang: str, source: str) -> DataFrame:
    """The result of ``counts`` with the limits of each row's group, as ``_limit_`` columns."""
    renamed = limits.withColumnsRenamed({"lang": "_limit_lang", "source": "_limit_source"} | {f"limit_{n}": f"_limit_{n}" for n in LEAST})
    return counted.join(
        renamed, F.col(lang).eqNullSafe(F.col("_limit_lang")) & F.col(source).eqNullSafe(F.col("_limit_source")), "left")


def base_fails() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rejections(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, n_rows, n_base, one count per rate): rows that fail the base rules, and rows that each rate rejects beyond these."""
    counted = counts(docs, text)
    joined = with_limits(counted, write_once(thresholds(counted, lang, source), "limits"), lang, source)
    return joined.groupBy(F.col(lang).alias("lang"), F.col(source).alias("source")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(base_fails()).alias("n_base"),
        *(F.count_if(~base_fails() & (rate > F.col(f"_limit_{n}"))).alias(n) for n, rate in rates().items()))


def decide(counted: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Base rules, then the joined limits, on the result of ``counts``."""
    joined = with_limits(counted.drop("base_failed", "kept"), limits, lang, source)
    fits = F.lit(True)
    for n, rate in rates().items():
        fits = fits & F.coalesce(rate <= F.col(f"_limit_{n}"), F.lit(True))
    return joined.withColumn("base_failed", base_fails()).withColumn("kept", ~F.col("base_failed") & fits).drop(
        "_n_lines", "_limit_lang", "_limit_source", *(f"_limit_{n}" for n in LEAST))
