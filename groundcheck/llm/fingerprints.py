"""Bottom-k fingerprints of review notes, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from groundcheck.llm.common import SPACE, let, ranked

#: Hashes are the upper bits of a 64-bit hash, so they are positive and print in 12 digits.
BITS = 48


def sketch(text: Column, k: int = 128, width: int = 5) -> Column:
    """The ``k`` smallest distinct hashes of the text's word shingles, ascending; empty without words.

    Words are split at ASCII white space and lower-cased; a text of fewer than ``width`` words is one
    shingle.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), lambda w: w != "")

    def shingles(h: Column) -> Column:
        n = F.size(h)
        return F.when(n == 0, F.array().cast("array<bigint>")).when(
            n < width, F.array(F.xxhash64(h))).otherwise(
            F.transform(F.sequence(F.lit(0), F.greatest(n - width, F.lit(0))),
                        lambda i: F.xxhash64(*[h[i + j] for j in range(width)])))

    hashes = let(F.transform(words, lambda w: F.xxhash64(w)), shingles)
    small = F.transform(hashes, lambda x: F.shiftrightunsigned(x, 64 - BITS))
    return F.slice(F.sort_array(F.array_distinct(small)), 1, k)


def merge(a: Column, b: Column, k: int = 128) -> Column:
    """The sketch of the union of the two texts' shingles."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = 128) -> Column:
    """Estimated Jaccard similarity: the share of the union's sketch that both hold; two empty ones are equal."""
    def share(bottom: Column) -> Column:
        return F.when(F.size(bottom) == 0, F.lit(1.0)).otherwise(
            F.size(F.array_intersect(F.array_intersect(a, b), bottom)) / F.size(bottom))
    return let(merge(a, b, k), share)


def distinct_shingles(a: Column, k: int = 128) -> Column:
    """Number of distinct shingles: exact below ``k``, else estimated from the k-th smallest hash."""
    n = F.size(a)
    return F.when(n < k, n.cast("double")).otherwise(F.lit((k - 1) * 2.0**BITS) / F.element_at(a, -1))


def containment(a: Column, b: Column, k: int = 128) -> Column:
    """Estimated share of the first text's shingles that the second has; 1 for an empty first text."""
    both = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    """The fingerprint as hexadecimal digits, 12 a hash."""
    return F.lower(F.concat_ws("", F.transform(a, lambda x: F.lpad(F.hex(x), BITS // 4, "0"))))


def fingerprint_notes(events: DataFrame, key: str = "event_id", text: str = "notes", k: int = 128,
                      width: int = 5) -> DataFrame:
    """Fingerprint every note, its edited form and the likeness to that and to the next event's note.

    The edited note has its last quarter (``floor(n_chars / 4)`` code points) replaced by as many, or all,
    of the next note's first ones.  Next is the event of the next larger key, after the last the first.
    The order comes from :func:`ranked` over the keys alone; texts are dealt once by key, and only the
    part that is needed goes on to the event before.

    Returns ``key, n_chars, edited_text, fingerprint, edited_fingerprint (arrays of hashes), distinct_shingles,
    near_edited, near_next (estimated Jaccard, 0 to 1)``.

    * a null note counts as empty; empty notes have empty fingerprints, equal to each other;
    * of rows that repeat a key all have the next key as next; there the row of the smallest text hash is
      taken;
    * rows without a key have no place in the order: no next (``near_next`` null) and no replacement;
    * a single key is its own next; an empty table gives no rows.
    """
    rows = events.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    held = rows.filter("k is not null")
    keys = held.groupBy("k").agg(F.min(F.xxhash64("t")).alias("head"),
                                 F.floor(F.max(F.length("t")) / 4).cast("int").alias("need"))
    keys, counts = ranked(keys, [], ["k"])
    n = counts.get((), 0)
    after = keys.select(F.pmod(F.col("rank") - 1, F.lit(max(n, 1))).alias("rank"), F.col("k").alias("next"), "head")
    pairs = keys.select("rank", "k", "need").join(after, "rank")

    sketched = held.withColumn("s", sketch(F.col("t"), k, width))
    # both joins read the same columns under the same names, so the texts are dealt once for the two
    found = sketched.join(pairs.select("next", "head", "need", F.col("k").alias("before")), F.col("k") == F.col("next"))
    found = found.filter(F.xxhash64("t").bitwiseXOR(F.col("head")) == 0).select(
        F.col("before").alias("k"), F.expr("substring(t, 1, need)").alias("front"), F.col("s").alias("next_s"))
    found = found.dropDuplicates(["k"])
    full = sketched.join(found, "k").unionByName(
        rows.filter("k is null").withColumn("s", sketch(F.col("t"), k, width)), allowMissingColumns=True)
    full = full.select("k", "t", "s", "next_s", F.length("t").cast("long").alias("n"),
                       F.floor(F.length("t") / 4).cast("int").alias("q"), "front")
    edited = F.when(F.col("front").isNull(), F.col("t")).otherwise(
        F.concat(F.expr("substring(t, 1, cast(n as int) - q)"), F.expr("substring(front, 1, q)")))
    full = full.select("k", "s", "next_s", "n", edited.alias("e"))
    full = full.select("k", "s", "next_s", "n", "e", sketch(F.col("e"), k, width).alias("es"))
    return full.select(
        F.col("k").alias(key), F.col("n").alias("n_chars"), F.col("e").alias("edited_text"),
        F.col("s").alias("fingerprint"), F.col("es").alias("edited_fingerprint"),
        distinct_shingles(F.col("s"), k).alias("distinct_shingles"),
        resemblance(F.col("s"), F.col("es"), k).alias("near_edited"),
        F.when(F.col("next_s").isNotNull(), resemblance(F.col("s"), F.col("next_s"), k)).alias("near_next"))
