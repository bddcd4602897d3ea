"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

A text is a weighted set: its lower-cased words, each with the number of its occurrences S. For every sample and word, r and c
are gamma(2, 1) and b is uniform, all drawn from hashes of word and sample alone. With t = floor(ln S / r + b) and
ln y = r (t - b), the word with the smallest ln a = ln c - ln y - r wins the sample, which is (word, t). Two texts get the
same sample with the probability sum(min(S, S')) / sum(max(S, S')), the generalised Jaccard similarity.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SAMPLES = 32
GROUP = 4  # samples that one row of an aggregation keeps
_WORDS = "[\\x20\\x09-\\x0D]+"
_LOW = 0xFFFFFFFF


def _uniform(bits: Column, shift: int, width: int) -> Column:
    """In (0, 1), from width of the 64 bits."""
    return (F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long")).cast("double") + 0.5) * F.lit(2.0**-width)


def sample(term: Column, log_weight: Column, number: Column) -> Column:
    """A long whose order is that of a, and whose lower 32 bits tell the sample (word, t)."""
    one, two = F.xxhash64(term, number), F.xxhash64(number, term)
    r = -F.log(_uniform(one, 0, 32) * _uniform(one, 32, 32))
    c = -F.log(_uniform(two, 0, 24) * _uniform(two, 24, 24))
    b = _uniform(two, 48, 16)
    t = F.floor(log_weight / r + b)
    log_a = F.log(c) - r * (t - b + 1)
    # ln a lies within some thousands; 2**18 steps in each unit keep the order
    return F.shiftleft(F.floor(log_a * F.lit(2.0**18)), 32) + term.bitwiseXOR(t).bitwiseAND(F.lit(_LOW).cast("long"))


def signatures(texts: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """keys and s, an array of samples, for each text with words. texts: keys and text; keys tell the rows apart.

    Where texts are already dealt by one of the keys, nothing is shuffled: words are counted and the least samples found in
    place. Samples are found in groups, one row each, so that generated code stays small.
    """
    words = texts.select(*keys, F.explode(F.split(F.lower("text"), _WORDS)).alias("word")).where("word <> ''")
    counts = words.select(*keys, F.xxhash64("word").alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("n"))
    groups = -(-samples // GROUP)
    weighed = counts.select(*keys, "term", F.log(F.col("n").cast("double")).alias("w"), F.explode(F.array(*[F.lit(GROUP * g) for g in range(groups)])).alias("g"))
    least = weighed.groupBy(*keys, "g").agg(*(F.min(sample(F.col("term"), F.col("w"), F.col("g") + i)).alias(f"s{i}") for i in range(GROUP)))
    part = F.struct("g", F.array(*(F.col(f"s{i}").bitwiseAND(F.lit(_LOW).cast("long")) for i in range(GROUP))).alias("s"))
    # at most `groups` small arrays per text
    listed = least.groupBy(*keys).agg(F.array_sort(F.collect_list(part)).alias("x"))
    return listed.select(*keys, F.slice(F.flatten(F.transform("x", lambda x: x["s"])), 1, samples).alias("s"))


def fingerprint(s: Column) -> Column:
    """Eight hexadecimal digits per sample; an empty string for a text without words."""
    return F.coalesce(F.array_join(F.transform(s, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), ""), F.lit(""))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of equal samples, an estimate of the generalised Jaccard similarity; 1 for two texts without words, 0 if only one has none."""
    same = sum((F.get(a, F.lit(i)) == F.get(b, F.lit(i))).cast("int") for i in range(samples))
    return F.when(a.isNull() | b.isNull(), (a.isNull() & b.isNull()).cast("double")).otherwise(same / F.lit(float(samples)))


def numbered(docs: DataFrame, width: int = 512, most: int = 1 << 14) -> DataFrame:
    """docs (doc_id, text) dealt by block, with block and pos, which tell all rows apart.

    Blocks rise with doc_id; pos counts a block's rows by descending doc_id, then text, so rows by descending block, then
    pos, descend by doc_id. Where equal ranges of doc_id hold about width rows each, they are the blocks. Else blocks end
    at quantiles of doc_id, one for about width rows, and most at the utmost: then blocks grow. Rows of an id that spans
    several blocks are spread over them, and rows without an id, which come last, over as many as their number asks for. A
    partition gets about four blocks.
    """
    n, known, low, high = docs.agg(F.count("*"), F.count("doc_id"), F.min("doc_id"), F.max("doc_id")).first()
    order = Window.partitionBy("block").orderBy(F.desc_nulls_last("doc_id"), "text")
    dealt = lambda block: docs.withColumn("block", block).repartition(max(4, math.ceil(n / (4 * width))), "block").withColumn("pos", F.row_number().over(order))
    step = max(1, math.ceil((high - low + 1) / max(1, math.ceil(n / width)))) if known else 1
    even = F.coalesce(F.floor((F.col("doc_id") - F.lit(low or 0)) / F.lit(step)), F.lit(0)).cast("long")
    largest = 0 if known and high - low >= 1 << 62 else docs.groupBy(even.alias("k")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if 0 < largest <= 4 * width or not n:
        return dealt(even)
    count = min(most, math.ceil(known / width))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / count for i in range(1, count)], 8 * count)).first()[0] if count > 1 else []
    none = max(1, min(most, math.ceil((n - known) / width)))
    # of the sorted limits, how many are below doc_id and how many above
    limits = F.concat(F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>") if cuts else F.array().cast("array<bigint>"), F.array("doc_id"))
    some = F.xxhash64("text", F.monotonically_increasing_id())  # equal rows are spread as well
    below, above = (F.array_position(F.sort_array(limits, up), F.col("doc_id")) - 1 for up in (True, False))
    own = below + F.pmod(some, len(cuts) + 1 - below - above)
    return dealt(F.when(F.col("doc_id").isNull(), -1 - F.pmod(some, F.lit(none))).otherwise(own).cast("long"))


def with_next(rows: DataFrame, column: str) -> DataFrame:
    """rows (block, pos, column) with next_column, that of the next row: the next pos, or else the first of the next lower block (after the last: of the highest).

    A window by block finds most; what a block's last row needs is found among one row per block.
    """
    inside = Window.partitionBy("block").orderBy("pos")
    found = rows.withColumn("__last", F.lead("pos").over(inside).isNull()).withColumn("__next", F.lead(column).over(inside))
    heads = rows.where("pos = 1").select(F.col("block").alias("__after"), F.col(column).alias("__head"))
    # numbers only, one per block
    order = Window.orderBy(F.desc("__after"))
    follow = heads.select("__after", F.col("__after").alias("block"))
    follow = follow.select("block", F.coalesce(F.lead("__after").over(order), F.first("__after").over(order)).alias("__after"))
    after = follow.join(heads, "__after").select("block", F.lit(True).alias("__last"), "__head")
    out = found.join(after, ["block", "__last"], "left")
    return out.select(*rows.columns, F.when(F.col("__last"), F.col("__head")).otherwise(F.col("__next")).alias(f"next_{column}"))


def fingerprints(docs: DataFrame, width: int = 512) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every whole text.

    The edited text has the last floor(n_chars / 3) code points replaced by the first as many (or all) of the next document,
    by descending doc_id (after the last: the first; rows with equal ids in an order of their own; a null id last). docs: doc_id and
    text (null: empty); other columns are ignored; repeated rows give rows of their own. An empty table gives an empty result.
    """
    keys = ["block", "pos"]
    rows = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), width)
    third = F.floor(F.char_length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.char_length("text") - third), F.substring("next_text", F.lit(1), third))
    both = with_next(rows, "text").select(*keys, "doc_id", "text", edited.alias("edited"))
    about = both.select(*keys, "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    # kind 0 is the original, kind 1 the edited text
    texts = both.select(*keys, F.posexplode(F.array("text", "edited")).alias("kind", "text"))
    s = signatures(texts, [*keys, "kind"])
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("s")))
    pairs = cut(s.groupBy(*keys).agg(of(0).alias("s"), of(1).alias("e")))
    about = cut(about)
    out = with_next(about.join(pairs, keys, "left"), "s")
    return out.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("s")).alias("fingerprint"), fingerprint(F.col("e")).alias("edited_fingerprint"), likeness(F.col("s"), F.col("e")).alias("near_edited"), likeness(F.col("s"), F.col("next_s")).alias("near_next"))
