"""Quality rules: hashed n-gram log-likelihood ratio between trusted text and the whole corpus. SQL functions only.

Tokens (runs of letters and digits, runs of other characters) and pairs of neighbouring tokens are hashed into
``BUCKETS``. Two multinomials over the buckets, one of trusted documents and one of all documents, give every bucket a
log ratio; a document's score is the mean over its tokens and pairs. The trusted multinomial is drawn towards the
corpus's with the weight of ``PRIOR`` tokens, so a bucket that little trusted text speaks of has a ratio near 0 and scores
do not fall with the number of labels. Log ratios are whole millionths, so sums do not depend on their order and a rerun
decides alike.

Defined cases: a null or empty text has no words, fails the base rule and scores 0; documents are judged row by
row, so repeated rows get the same verdict; an empty table gives no rows; without trusted rows both multinomials
are the corpus's and every score is 0; columns other than the id and the text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, words

# Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]+"
BUCKETS = 1 << 14
# Tokens and pairs that the corpus counts for beside the trusted documents' own.
PRIOR = 8 * BUCKETS
# Documents that the trusted multinomial is fitted on at most; which ones, their ids' hashes decide.
TRUSTED = 20_000
# Mean log ratio, in nats, below which a document goes.
LEAST = -0.1
MICRO = 1_000_000


def structure(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of every row, all of it in ``row``."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), body.alias("text"))
    # Words and hashes are columns of their own: what works on them next is then generated code.
    rows = rows.select("*", words(F.col("text")).alias("w"))
    rows = rows.select("*", window_hashes(F.col("w")).alias("h"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return rows.select(
        "row",
        "text",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", f"[{SYMBOLS}]+", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w"), F.col("h")).cast("long").alias("n_repeat_words"),
    )


def window_hashes(w: Column) -> Column:
    """One hash per window of five words: of its first and third pair and its last word."""

    def pairs(u: Column) -> Column:
        return let(F.transform(u, lambda x, k: F.xxhash64(x, F.get(u, k + 1))), lambda p: windows(u, p))

    def windows(u: Column, p: Column) -> Column:
        hashes = F.transform(p, lambda x, k: F.xxhash64(x, F.get(p, k + 2), F.get(u, k + 4)))
        return F.slice(hashes, 1, F.greatest(F.size(u) - 4, F.lit(0)))

    return let(F.transform(w, lambda x: F.xxhash64(x)), pairs)


def repeated_words(w: Column, h: Column, size: int = 5) -> Column:
    """Words covered by windows of ``size`` words that stand in the text twice or more.

    ``h`` holds the windows' hashes. They tell which windows can repeat; only those are compared as texts.
    """

    def repeating(s: Column) -> Column:
        """Places of the elements of ``s``, sorted by (g, i), whose g is there twice."""
        same = lambda k: F.coalesce(F.get(s, k - 1)["g"] == F.get(s, k)["g"], F.lit(False))
        return F.transform(F.filter(s, lambda x, k: same(k) | same(k + 1)), lambda x: x["i"])

    def window(i: Column) -> Column:
        return F.concat_ws(" ", *[F.get(w, i + k) for k in range(size)])

    def covered(found: Column) -> Column:
        return let(
            F.sort_array(found),
            lambda p: F.aggregate(
                F.transform(
                    p, lambda x, k: F.when(k == 0, size).otherwise(F.least(F.lit(size), x - F.get(p, k - 1)))
                ),
                F.lit(0),
                lambda a, x: a + x,
            ),
        )

    alike = let(F.sort_array(F.transform(h, lambda g, i: F.struct(g.alias("g"), i.alias("i")))), repeating)
    texts = F.transform(alike, lambda i: F.struct(window(i).alias("g"), i.alias("i")))
    return F.when(F.size(F.array_distinct(h)) < F.size(h), covered(let(F.sort_array(texts), repeating))).otherwise(0)


def token_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda x: F.xxhash64(x))


def bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def buckets(h: Column) -> Column:
    """Buckets of the tokens with hashes ``h`` and of their neighbouring pairs; the last token pairs with the end."""
    return F.concat(
        F.transform(h, lambda x: bucket(x)), F.transform(h, lambda x, k: bucket(F.xxhash64(x, F.get(h, k + 1))))
    )


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", at_most: int = TRUSTED) -> DataFrame:
    """At most ``at_most`` ids that are labelled good, those with the smallest hashes."""
    good = labels.groupBy(id_col).agg(F.min("quality").alias("quality")).where("quality = 1")
    return good.select(id_col).orderBy(F.xxhash64(id_col), id_col).limit(at_most)


def log_ratios(docs: DataFrame, trusted: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row with an array: the log ratio of every bucket, in millionths.

    Counts of all documents, summed per task before they are shuffled: at most ``BUCKETS`` rows leave a task. The trusted
    ids are at most ``TRUSTED`` (their broadcast is bounded by that).
    """
    marked = F.broadcast(trusted.select(F.col(id_col).alias("trusted_id")).distinct())
    rows = docs.select(F.col(id_col).alias("row_id"), F.col(text).alias("text")).join(
        marked, F.col("row_id") == F.col("trusted_id"), "left"
    )
    grams = rows.select(F.col("trusted_id").isNotNull().cast("long").alias("good"), F.explode(let(token_hashes(F.col("text")), buckets)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").alias("target"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    counts = every.join(counts, "bucket", "left").na.fill(0)
    # A table of BUCKETS rows: its window and its array are bounded by that.
    total = Window.partitionBy()
    counts = counts.select("bucket", "raw", "target", F.sum("raw").over(total).alias("n"), F.sum("target").over(total).alias("m"))
    usual = F.col("raw") / F.col("n")
    ratio = F.log((F.col("target") + PRIOR * usual) / (F.col("m") + PRIOR)) - F.log(usual)
    # A bucket that the corpus lacks has no trusted tokens either.
    micro = F.when((F.col("m") > 0) & (F.col("raw") > 0), F.round(ratio * MICRO).cast("long")).otherwise(0)
    pairs = F.sort_array(F.collect_list(F.struct("bucket", micro.alias("micro"))))
    return counts.agg(F.transform(pairs, lambda x: x["micro"]).alias("ratios"))


def judged(
    docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", least: float = LEAST
) -> DataFrame:
    """The row as it was (struct ``row``), its structure counts, base_failed, score (mean log ratio) and kept."""
    # BUCKETS numbers come to the driver and go into the plan as one constant.
    fitted = log_ratios(docs, trusted_ids(labels, id_col), text, id_col).first()["ratios"]
    ratios = F.split(F.lit(",".join(map(str, fitted))), ",").cast("array<bigint>")
    rows = structure(docs, text)

    def mean_ratio(h: Column) -> Column:
        per = F.transform(
            h, lambda x, k: F.get(ratios, bucket(x)) + F.get(ratios, bucket(F.xxhash64(x, F.get(h, k + 1))))
        )
        total = F.aggregate(per, F.lit(0).cast("long"), lambda a, x: a + x)
        return F.when(F.size(h) > 0, total / (2 * F.size(h)) / MICRO).otherwise(0.0)

    score = let(token_hashes(F.col("text")), mean_ratio)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = rows.select("*", failed.alias("base_failed"), score.alias("score")).drop("text")
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= least))
