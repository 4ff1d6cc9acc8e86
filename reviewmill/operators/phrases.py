"""Terms of more than one word, and words without the particles at their end.

A phrase is a pair of neighbouring words that stand together far more often than their own counts explain, by the
log-likelihood ratio. A particle is an ending that many words share: behind a stem the next character is open, which shows
as a high entropy of what follows, and the ending itself follows many stems.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewmill.operators.extractive import terms_of
from reviewmill.operators.scale import materialize

#: Times that a phrase has to occur, and its least ratio: chance alone passes it once in a thousand pairs.
MIN_COUNT, MIN_RATIO = 5, 10.83
HANGUL = "^[가-힣]+$"
#: Characters of an ending, stems that it has to follow, and entropy (bits) behind the stem.
ENDING_CHARS, ENDING_STEMS, OPEN_BITS = 3, 5, 1.0


def log_likelihood_ratio(both: Column, first: Column, second: Column, total: Column) -> Column:
    """2 * sum of observed * ln(observed / expected) over the four cells of a pair's table: both words, the first one only, the
    second one only, neither."""
    def cell(seen: Column, row: Column, column: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen * total / (row * column))).otherwise(0.0)

    return 2 * (
        cell(both, first, second) + cell(first - both, first, total - second)
        + cell(second - both, total - first, second)
        + cell(total - first - second + both, total - first, total - second)
    )


def phrases(
    texts: DataFrame, stop_words: Iterable[str] = (), min_count: int = MIN_COUNT, min_ratio: float = MIN_RATIO
) -> DataFrame:
    """first, second, n, ratio: the phrases in the column text. Pairs with a stop word are none, and pairs that stand together
    less often than by chance.

    Pairs are counted before anything moves. Every count of a first or second word is the sum of its pairs' counts, so the
    texts are read once and only the table of pairs, as large as the vocabulary's use, is joined with its own sums.
    """
    words = terms_of(F.col("text"))
    neighbours = texts.select(words.alias("words")).where(F.size("words") > 1).select(
        F.explode(F.arrays_zip(
            F.slice("words", 1, F.size("words") - 1).alias("first"), F.slice("words", 2, F.size("words")).alias("second"),
        )).alias("pair"))
    pairs = materialize(neighbours.groupBy("pair.first", "pair.second").agg(F.count(F.lit(1)).alias("n")))
    total = F.lit(pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]).cast("double")
    firsts = pairs.groupBy("first").agg(F.sum("n").cast("double").alias("as_first"))
    seconds = pairs.groupBy("second").agg(F.sum("n").cast("double").alias("as_second"))
    kept = pairs.where(F.col("n") >= min_count)
    stop = list(stop_words)
    if stop:
        listed = F.broadcast(pairs.sparkSession.createDataFrame([(w,) for w in stop], "word string"))  # a fixed word list
        for side in ("first", "second"):
            kept = kept.join(listed.withColumnRenamed("word", side), side, "left_anti")
    both = F.col("n").cast("double")
    ratio = log_likelihood_ratio(both, F.col("as_first"), F.col("as_second"), total)
    return (
        kept.join(firsts, "first").join(seconds, "second")
        .where(both * total > F.col("as_first") * F.col("as_second"))
        .select("first", "second", "n", ratio.alias("ratio"))
        .where(F.col("ratio") >= min_ratio)
    )


def stems(
    words: DataFrame, pattern: str = HANGUL, ending_chars: int = ENDING_CHARS, ending_stems: int = ENDING_STEMS,
    open_bits: float = OPEN_BITS,
) -> DataFrame:
    """word, stem, ending of each distinct word (column word) that matches the pattern and carries a particle.

    Every split of a word into a stem of two characters or more and an ending of up to `ending_chars` is looked at. Behind the
    stem at least `open_bits` of entropy say what comes next (another character or the word's end), each distinct word
    counting once, and the ending follows at least `ending_stems` such stems. The shortest stem of a word's splits wins, as
    particles follow one another.
    """
    known = materialize(words.select("word").where(F.col("word").rlike(pattern)).distinct())
    length = F.length("word")
    prefixes = known.select("word", F.explode(F.sequence(F.lit(1), length)).alias("at"))
    follows = prefixes.select(
        F.expr("left(word, at)").alias("stem"), F.expr("substring(word, at + 1, 1)").alias("next"))
    counts = follows.groupBy("stem", "next").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("stem"))  # one row for each next character
    open_stems = counts.withColumn("share", share).groupBy("stem").agg(
        (-F.sum(F.col("share") * F.log2("share"))).alias("bits")).where(F.col("bits") >= open_bits)
    splits = prefixes.where((F.col("at") >= 2) & (F.col("at") < length) & (length - F.col("at") <= ending_chars)).select(
        "word", F.expr("left(word, at)").alias("stem"), F.expr("substring(word, at + 1)").alias("ending"))
    likely = materialize(splits.join(open_stems.select("stem"), "stem"))
    endings = likely.groupBy("ending").agg(F.count(F.lit(1)).alias("stems")).where(F.col("stems") >= ending_stems)
    return likely.join(endings.select("ending"), "ending").groupBy("word").agg(
        F.min_by(F.struct("stem", "ending"), F.length("stem")).alias("cut")).select("word", "cut.stem", "cut.ending")
