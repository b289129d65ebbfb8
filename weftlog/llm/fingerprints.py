"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

All of it is DataFrame expressions. A text's shingles of five words (lower-cased A-Z; fewer words: one
shingle) are hashed once. The top bits of a hash choose one of ``BINS`` bins, and each bin keeps its least
hash. An empty bin borrows from the first bin that has one in a random order of its own, fixed for all
documents. Of each bin the low ``BITS`` bits are kept, as hex. Two fingerprints agree by chance in one of
2 ** BITS bins; the likeness corrects for that, and lies between 0 and 1.

Null and empty texts, and texts without words, have the empty fingerprint, whose likeness to itself is 1 and to
others 0. Rows that repeat a doc_id are ordered by text. Extra columns are ignored.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS, BITS, WIDTH = 128, 8, 5
_SHIFT = 64 - BINS.bit_length() + 1
_ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BLANKS = " \t\n\x0b\f\r"


def _orders() -> Column:
    """For each bin, all bins in a fixed random order: where an empty one looks."""
    rng = random.Random(42)
    return F.array(*[F.array(*[F.lit(k) for k in rng.sample(range(BINS), BINS)]) for _ in range(BINS)])


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``, the array of each bin's low bits (empty for a text without words). Scratch columns begin with ``_``."""
    words = F.split(F.trim(F.translate(F.col(text), _ASCII, _ASCII.lower()), F.lit(_BLANKS)), "[ \\t\\n\\x0B\\f\\r]+", -1)
    # each step reads the one before more than once, so it stays a column of its own and is evaluated once
    df = df.withColumn("_w", words)
    at = F.sequence(F.lit(0), F.greatest(F.size("_w") - WIDTH, F.lit(0)))
    df = df.withColumn("_s", F.sort_array(F.transform(at, lambda i: F.xxhash64(F.slice("_w", i + 1, WIDTH)))))
    new = lambda x, i: (i == 0) | (F.shiftrightunsigned(x, _SHIFT) != F.shiftrightunsigned(F.get("_s", i - 1), _SHIFT))
    df = df.withColumn("_m", F.filter("_s", new))
    df = df.withColumn("_b", F.transform("_m", lambda x: F.shiftrightunsigned(x, _SHIFT).cast("int")))
    df = df.withColumn("_m", F.transform("_m", lambda x: x.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")))

    def low(order: Column, k: Column) -> Column:
        own = F.array_position("_b", k.cast("int"))
        lent = F.array_position("_b", F.element_at(F.array_intersect(order, F.col("_b")), 1))
        return F.get("_m", F.when(own > 0, own).otherwise(lent).cast("int") - 1)

    none = F.size(F.filter("_w", lambda w: w != "")) == 0
    filled = F.when(none, F.array().cast("array<int>")).otherwise(F.transform(F.col("_orders"), low))
    return df.withColumn(out, filled).drop("_w", "_s", "_m", "_b")


def packed(bits: str) -> Column:
    """The bins' low bits as a hex string."""
    return F.array_join(F.transform(bits, lambda v: F.lpad(F.lower(F.hex(v)), BITS // 4, "0")), "")


def likeness(one: str, two: str) -> Column:
    """Estimated resemblance of two fingerprints, corrected for chance agreement of low bits."""
    same = F.aggregate(F.zip_with(one, two, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda a, x: a + x)
    chance = 2.0**-BITS
    found = F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when((F.size(one) == 0) | (F.size(two) == 0), F.when(F.size(one) == F.size(two), 1.0).otherwise(0.0)).otherwise(found)


def _bucket(bounds: list[int]) -> Column:
    """How many bounds are at most the doc_id, found in two steps of about the root of their number."""
    if not bounds:
        return F.lit(0)
    wide = max(1, int(len(bounds) ** 0.5))
    # one literal each, which the optimizer turns into an array once
    coarse, fine = (F.split(F.lit(",".join(map(str, x))), ",").cast("array<bigint>") for x in (bounds[wide - 1 :: wide], bounds))
    first = F.size(F.filter(coarse, lambda b: b <= F.col("doc_id"))) * wide
    return first + F.size(F.filter(F.slice(fine, first + 1, wide), lambda b: b <= F.col("doc_id")))


def edited(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document.

    The next document is that with the next smaller doc_id; after the smallest comes the largest. doc_id
    is cut into ranges of equal size by quantiles; each range also gets the first document of the next
    range, so that no task orders more than a range. A null doc_id counts as the smallest.
    """
    spark = docs.sparkSession
    many = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    smallest = -(1 << 63)
    rows = docs.select(F.col("doc_id").alias("_id"), F.coalesce("doc_id", F.lit(smallest)).cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = rows.select("doc_id")
    cuts = ids.agg(F.percentile_approx("doc_id", [k / many for k in range(1, many)], 20 * many).alias("cuts")).first()["cuts"]
    bucket = _bucket(sorted(set(cuts or [])))
    # one row a range: its largest doc_id; the number of ranges follows the shuffle partitions
    tops = sorted((r["b"], r["top"]) for r in ids.groupBy(bucket.alias("b")).agg(F.max("doc_id").alias("top")).collect())
    above = {top: tops[(k + 1) % len(tops)][0] for k, (_, top) in enumerate(tops)}
    first = spark.createDataFrame([(top, b) for top, b in above.items()], "doc_id long, bucket int")
    guests = rows.join(F.broadcast(first), "doc_id")
    guests = guests.groupBy("doc_id", "bucket").agg(F.max("text").alias("text")).select(F.lit(None).cast("long").alias("_id"), "doc_id", "text", "bucket", F.lit(True).alias("guest"))
    own = rows.select("_id", "doc_id", "text", bucket.cast("int").alias("bucket"), F.lit(False).alias("guest"))
    both = own.unionByName(guests).repartition("bucket").withColumn("_orders", _orders())
    both = with_fingerprint(both, "text", "f")
    # a guest comes after its range's own documents
    order = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc(), F.col("text").desc())
    both = both.withColumn("next_text", F.lead("text").over(order)).withColumn("next_f", F.lead("f").over(order)).where(~F.col("guest"))
    both = both.withColumn("n", F.length("text")).withColumn("k", F.floor(F.col("n") / 3).cast("int"))
    both = both.select("_id", "n", "f", "next_f", "_orders", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n") - F.col("k")), F.substring(F.col("next_text"), F.lit(1), F.col("k"))).alias("new"))
    both = with_fingerprint(both, "new", "g")
    return both.select(
        F.col("_id").alias("doc_id"),
        F.col("n").cast("long").alias("n_chars"),
        F.sha2(F.col("new").cast("binary"), 256).alias("edited_sha256"),
        packed("f").alias("fingerprint"),
        packed("g").alias("edited_fingerprint"),
        likeness("f", "g").alias("near_edited"),
        likeness("f", "next_f").alias("near_next"),
    )
