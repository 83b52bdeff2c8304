"""Quality rules: repetition counts and a hashed n-gram log-likelihood ratio. Only DataFrame functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.quantiles import exact_percentiles
from ..sources.staging import stage
from .columns import held

#: Buckets of the hashed n-gram multinomials.
BUCKETS = 10_000
#: The threshold of the scores leaves at most this share of the trusted documents that pass the base rules below it.
LOST_TRUSTED = 0.001
#: Bits of the filter of trusted keys, 512 KB, and how many stand for a key: one other key in seven passes at a million keys.
FILTER_BITS, FILTER_HASHES = 1 << 22, 4
_WHITE = r"[\x20\x09-\x0D]+"


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed")


def _each(array: Column, function) -> Column:
    return F.transform(array, function)


def _sequence(first: int, last: Column) -> Column:
    return F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array().cast("array<int>"))


def _text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words of a text, in order."""
    return _each(F.filter(F.split(text, _WHITE), lambda w: w != ""), lambda w: F.xxhash64(w))


def repetition(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with _hashes (hashes of the words), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Everything is computed inside the row. A 3-word window is told by a 64-bit hash of its words; positions are ordered
    by window only in texts where a window occurs twice.
    """
    whole = _text(text)
    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.withColumns(
        {
            "_hashes": held(word_hashes(whole)),
            "_lines": held(lines),
            "word_chars": F.length(F.regexp_replace(whole, _WHITE, "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(whole, r"[^#*$%&|<>]+", "")).cast("long"),
        }
    )
    rows = rows.withColumns(
        {
            "n_words": F.size("_hashes").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_windows": held(
                _each(
                    _sequence(2, F.size("_hashes") - 1),
                    lambda i: F.xxhash64(F.get("_hashes", i - 2), F.get("_hashes", i - 1), F.get("_hashes", i)),
                )
            ),
        }
    )
    ordered = F.sort_array(F.transform("_windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    rows = rows.withColumn(
        "_ordered", held(F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), ordered))
    )
    twice = F.transform(
        F.filter(
            F.transform(
                "_ordered",
                lambda x, i: F.struct(
                    x["i"].alias("i"),
                    (
                        F.get("_ordered", i - 1)["w"].eqNullSafe(x["w"]) | F.get("_ordered", i + 1)["w"].eqNullSafe(x["w"])
                    ).alias("two"),
                ),
            ),
            lambda x: x["two"],
        ),
        lambda x: x["i"],
    )
    rows = rows.withColumn("_starts", held(F.sort_array(twice)))
    # Words covered by windows of three that start at the (ordered) places: three for each, less the overlap with the one before.
    covered = F.aggregate(
        F.transform("_starts", lambda s, i: F.least(F.lit(3), s - F.coalesce(F.get("_starts", i - 1), F.lit(-3)))),
        F.lit(0),
        lambda total, x: total + x,
    )
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop(
        "_lines", "_windows", "_ordered", "_starts"
    )


def buckets(hashes: Column, n: int = BUCKETS) -> Column:
    """Bucket of every word and of every pair of neighbours."""
    single = _each(hashes, lambda h: F.pmod(h, F.lit(n)))
    pair = _each(_sequence(1, F.size(hashes) - 1), lambda i: F.pmod(F.xxhash64(F.get(hashes, i - 1), F.get(hashes, i)), F.lit(n)))
    return F.concat(single, pair)


def _positions(key: Column, bits: int) -> list[Column]:
    """The bits of a filter that stand for a key: two hashes and their combinations."""
    first, second = F.xxhash64(key, F.lit(1)), F.xxhash64(key, F.lit(2))
    # Bitwise arithmetic on halves: products of whole hashes would overflow.
    low = F.lit((1 << 31) - 1)
    return [F.pmod(first.bitwiseAND(low) + F.lit(i) * second.bitwiseAND(low), F.lit(bits)) for i in range(FILTER_HASHES)]


def key_filter(keys: DataFrame, key: str, bits: int = FILTER_BITS) -> DataFrame:
    """One row (bits): a Bloom filter of the keys, as an array of bitmaps of 2^15 bits, NULL where no key has a bit.

    Its size is ``bits``, whatever the number of keys. A filter that fills up lets more keys through, but never loses one.
    """
    spots = keys.filter(F.col(key).isNotNull()).select(F.explode(F.array(*_positions(F.col(key), bits))).alias("at"))
    maps = spots.groupBy(F.shiftright("at", 15).cast("int").alias("i")).agg(
        F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit((1 << 15) - 1))).alias("map")
    )
    every = keys.sparkSession.range(bits >> 15).select(F.col("id").cast("int").alias("i")).join(maps, "i", "left")
    ordered = F.sort_array(F.collect_list(F.struct("i", "map")))
    return every.agg(F.transform(ordered, lambda x: x["map"]).alias("bits"))


def may_hold(found: Column, key: Column, bits: int = FILTER_BITS) -> Column:
    """Whether the filter lets a key through: all keys of the filter, and a few others."""
    through = key.isNotNull()
    for at in _positions(key, bits):
        octet = F.substring(F.get(found, F.shiftright(at, 15).cast("int")), F.shiftright(at.bitwiseAND(F.lit((1 << 15) - 1)), 3).cast("int") + 1, F.lit(1))
        value = F.conv(F.hex(octet), 16, 10).cast("int")
        through = through & F.coalesce(F.getbit(value, at.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    return through


def trusted_texts(docs: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The texts of the documents whose key ``trusted`` lists.

    Trusted keys may be many, so none is broadcast: a filter of fixed size drops all other texts (but a few) in the scan, and a
    merge join at any size decides on the rest. Only trusted texts are shuffled.
    """
    keys = trusted.select(F.col(key)).distinct()
    known = stage(key_filter(keys, key), "quality-filter").select("bits").scalar()
    near = docs.select(key, text).filter(may_hold(known, F.col(key)))
    return near.hint("merge").join(keys.hint("merge"), key, "left_semi").select(text)


def bucket_ratios(docs: DataFrame, trusted: DataFrame, n: int = BUCKETS, text: str = "text") -> DataFrame:
    """One row (ratios array<double>): per bucket the log of its share in trusted texts over its share in all texts.

    Counts have half an n-gram added per bucket. ``trusted`` holds the trusted texts. Counting is one
    aggregation over all n-grams of all documents with at most ``n`` groups per task. Without trusted documents
    all ratios are 0.
    """
    def grams(rows: DataFrame) -> DataFrame:
        # The hashes are a column of their own: inside the lambdas of buckets() they would be made anew for each word.
        hashed = rows.select(held(word_hashes(_text(text))).alias("_hashes"))
        return hashed.select(F.explode(buckets(F.col("_hashes"), n)).alias("bucket")).groupBy("bucket")

    per_bucket = grams(docs.select(text)).agg(F.count(F.lit(1)).alias("n_raw"))
    target = grams(trusted.select(text)).agg(F.count(F.lit(1)).alias("n_target"))
    spark = docs.sparkSession
    every = spark.range(n).select(F.col("id").alias("bucket")).join(per_bucket, "bucket", "left").join(target, "bucket", "left")
    counted = every.select("bucket", F.coalesce("n_raw", F.lit(0)).alias("r"), F.coalesce("n_target", F.lit(0)).alias("t"))
    packed = counted.agg(
        F.transform(F.sort_array(F.collect_list(F.struct("bucket", "t", "r"))), lambda x: F.struct(x["t"].alias("t"), x["r"].alias("r"))).alias("x"),
        F.sum("t").alias("st"),
        F.sum("r").alias("sr"),
    )
    share = lambda c, s: (c + F.lit(0.5)) / (s + F.lit(0.5 * n))
    ratio = F.when(
        F.col("st") > 0, F.transform("x", lambda b: F.log(share(b["t"], F.col("st"))) - F.log(share(b["r"], F.col("sr"))))
    ).otherwise(F.transform("x", lambda b: F.lit(0.0)))
    return packed.select(ratio.alias("ratios"))


def _scored(docs: DataFrame, ratios: DataFrame, n: int, least_words: int, most_repeated: float, text: str) -> DataFrame:
    """``docs`` with the repetition counts, score and base_failed."""
    rows = repetition(docs.drop("_hashes"), text).withColumn("_ratios", ratios.select("ratios").scalar())
    grams = F.col("n_words") + F.greatest(F.col("n_words") - 1, F.lit(0))
    total = F.aggregate(buckets(F.col("_hashes"), n), F.lit(0.0), lambda s, b: s + F.get("_ratios", b.cast("int")))
    score = F.when(grams > 0, total / grams).otherwise(F.lit(0.0))
    failed = (F.col("n_words") < least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * F.lit(most_repeated))
    return rows.withColumn("score", score).withColumn("base_failed", failed).drop("_hashes", "_ratios")


def threshold(scores: DataFrame, lost: float = LOST_TRUSTED) -> DataFrame:
    """One row (least): the largest of the scores that has at most ``lost`` of them below it; NULL without scores."""
    cut = exact_percentiles(scores, F.col("score"), {"cut": lost}).select("cut").scalar()
    return scores.filter(F.col("score") <= cut).agg(F.max("score").alias("least"))


def judge(
    docs: DataFrame,
    trusted: DataFrame,
    least_score: float | None = None,
    n: int = BUCKETS,
    least_words: int = 50,
    most_repeated: float = 50.0,
    text: str = "text",
    key: str = "doc_id",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """``docs`` (or their ``columns``) with the repetition counts, base_failed, score and kept.

    ``score`` is the sum of bucket ratios over a text's words and word pairs, divided by their number (0 without any);
    every document is kept or not by the same threshold, without a draw. The threshold is ``least_score`` or, if none is
    given, that of the scores of all trusted documents that pass the base rules: ``LOST_TRUSTED`` of them at most lie
    below. Without such documents the score rejects nothing. base_failed: fewer than ``least_words`` words,
    or more than ``most_repeated`` percent of them in repeated 3-word windows. A NULL text is empty. Repeated rows
    are judged alike; NULL keys are never trusted; an empty table gives no rows. The ratios are one row of ``n`` numbers,
    whatever the input's size. ``columns`` must hold the key unless a ``least_score`` is given.
    """
    ratios = stage(bucket_ratios(docs, trusted_texts(docs, trusted, text, key), n, text), "quality-ratios")
    rows = _scored(docs, ratios, n, least_words, most_repeated, text)
    if columns is not None:
        rows = rows.select(*columns, *MEASURES)
    if least_score is None:
        # Scored once: the threshold needs the trusted rows' scores, which are joined without the texts.
        rows = stage(rows, "quality-scored")
        scores = rows.filter("not base_failed").select(key, "score").join(trusted.select(F.col(key)).distinct(), key, "left_semi")
        least = F.coalesce(stage(threshold(scores.select("score")), "quality-threshold").scalar(), F.lit(float("-inf")))
    else:
        least = F.lit(least_score)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= least))
