"""Order MinHash fingerprints, built from DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions

#: Words of a k-mer.
K = 3
#: Signatures of a fingerprint; each takes the least k-mer of two classes of hashes.
SIGNATURES = 64
#: Bits of a packed number that hold a word's place.
PLACE = 24


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def order_minhash(text: Column, k: int = K) -> Column:
    """The signatures of a text as an array of ``number << 16 | hash``; none of a text
    without words.

    Words lie apart by ASCII white space. Every word begins a k-mer (the last ones are
    filled with empty words), which is numbered among its equals; the hash of k-mer and
    number puts it in one of 128 classes. A signature hashes the least members of two
    classes, in the order in which they stand in the text. Equal k-mers at the same
    number but in another order thus differ: the share of equal signatures falls with
    the edit distance, as that of a MinHash of the set doesn't."""
    low = F.lit((1 << PLACE) - 1).cast("bigint")
    high = F.lit(-(1 << PLACE)).cast("bigint")
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    words = F.array_remove(F.split(text, " "), "")
    padded = F.concat(words, F.array_repeat(F.lit(""), k - 1))
    powers = F.lit([1 << j for j in reversed(range(PLACE + 1))])

    def hashes(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - k),
            lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]).bitwiseAND(high).bitwiseOR(i.cast("bigint").bitwiseAND(low)),
        )

    def numbered(p: Column, steps: Column) -> Column:
        """Each hash with its number among equal ones, which stand together in ``p``; the
        first of them is found by halving."""

        def first(x: Column) -> Column:
            ahead = lambda at, step: F.coalesce(F.get(p, at + step - 1) < x.bitwiseAND(high), F.lit(False))
            return F.aggregate(steps, F.lit(0), lambda at, step: F.when(ahead(at, step), at + step).otherwise(at))

        def one(x: Column, i: Column) -> Column:
            repeated = F.coalesce(x.bitwiseXOR(F.get(p, i - 1)).bitwiseAND(high) == 0, F.lit(False))
            number = F.when(repeated, i - first(x)).otherwise(F.lit(0))
            return F.xxhash64(x.bitwiseAND(high), number).bitwiseAND(high).bitwiseOR(x.bitwiseAND(low))

        return F.transform(p, one)

    def changes(s: Column, bits: int) -> Column:
        """The first of each run of numbers that are equal above ``bits``."""
        above = F.lit(-(1 << bits)).cast("bigint")
        return F.filter(s, lambda x, i: F.coalesce(x.bitwiseXOR(F.get(s, i - 1)).bitwiseAND(above) != 0, F.lit(True)))

    def signed(least: Column) -> Column:
        value = lambda x: F.shiftrightunsigned(x, PLACE)
        group = lambda x: F.shiftrightunsigned(x, 58)

        def one(x: Column, i: Column) -> Column:
            y = F.get(least, i + 1)
            alone = F.coalesce(group(x) != group(y), F.lit(True))
            pair = F.when(alone, F.xxhash64(value(x)))
            pair = pair.when(x.bitwiseAND(low) < y.bitwiseAND(low), F.xxhash64(value(x), value(y))).otherwise(F.xxhash64(value(y), value(x)))
            joined = F.shiftleft(group(x), 16).bitwiseOR(pair.bitwiseAND(F.lit(0xFFFF)))
            return F.when(F.coalesce(group(F.get(least, i - 1)) == group(x), F.lit(False)), F.lit(None)).otherwise(joined)

        return F.array_compact(F.transform(least, one))

    def full(w: Column) -> Column:
        steps = F.filter(powers, lambda x: x <= F.size(w))
        return _let(F.sort_array(hashes(w)), lambda p: _let(steps, lambda st: _let(F.sort_array(numbered(p, st)), lambda s: _let(changes(s, 57), signed))))

    return F.when(F.size(words) == 0, F.array().cast("array<bigint>")).otherwise(_let(padded, full))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal ones among the signatures that either text has; 1 if neither has any."""
    number = lambda x: F.shiftright(x, 16)
    either = F.size(F.array_union(F.transform(a, number), F.transform(b, number)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def as_string(signatures: Column) -> Column:
    """Two hexadecimal digits of each signature's number and four of its hash."""
    return F.array_join(F.transform(signatures, lambda x: F.lpad(F.lower(F.hex(x)), 6, "0")), "")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: the id and ``fingerprint``. Null text is empty and has
    the empty fingerprint; equal texts have equal ones; repeated rows and null ids stay;
    an empty table gives no rows; no other column is read. Nothing is shuffled."""
    return docs.select(F.col(id_col), as_string(order_minhash(F.coalesce(F.col(text_col), F.lit("")))).alias("fingerprint"))


def _bucket(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most the value, by halving; -1 for null."""
    if not bounds:
        return F.when(value.isNull(), F.lit(-1)).otherwise(F.lit(0))
    depth = len(bounds).bit_length()
    filled = F.lit(bounds + [2**63 - 1] * ((1 << depth) - 1 - len(bounds)))
    steps = F.lit([1 << (depth - 1 - s) for s in range(depth)])
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(filled, at + step - 1) <= value, at + step).otherwise(at))
    return F.when(value.isNull(), F.lit(-1)).otherwise(found)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` as (id, text, signatures) with next_text and next_signatures: those of the
    next row by descending id (null ids last; equal ids by the hash of their texts); the
    last row's next is the first.

    Ids are cut at quantiles into buckets, several to a partition; the order within a
    bucket is a window, and the first row of the bucket below follows its last."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    count = partitions(spark) * 4
    cuts = rows.agg(F.percentile_approx("id", [i / count for i in range(1, count)], 100 * count)).first()[0]
    rows = rows.withColumn("bucket", _bucket(F.col("id"), sorted(set(cuts or []))))
    order = F.struct(F.col("id").isNotNull(), "id", F.xxhash64("text"))
    heads = rows.groupBy("bucket").agg(F.max_by("text", order).alias("head"))
    here = sorted((r[0] for r in heads.select("bucket").collect()), reverse=True)
    if not here:
        return rows.select("id", "text", F.lit(None).cast("array<bigint>").alias("signatures"), F.col("text").alias("next_text"), F.lit(None).cast("array<bigint>").alias("next_signatures"))
    above = F.create_map(*[F.lit(x) for pair in zip(here[1:] + here[:1], here, strict=True) for x in pair])
    heads = heads.select(above[F.col("bucket")].alias("bucket"), "head", order_minhash(F.col("head")).alias("head_signatures"))
    from pyspark.sql import Window

    w = Window.partitionBy("bucket").orderBy(F.col("id").desc_nulls_last(), F.xxhash64("text").desc())
    rows = rows.withColumn("signatures", order_minhash(F.col("text"))).withColumn("next", F.lead(F.struct("text", "signatures")).over(w))
    rows = rows.join(heads, "bucket", "left")
    return rows.select(
        "id", "text", "signatures", F.coalesce("next.text", "head").alias("next_text"), F.coalesce("next.signatures", "head_signatures").alias("next_signatures")
    )


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text against an edited one, whose last half of characters (rounded down)
    gives way to as many first ones of the next document, or all it has.

    One row for each input row: the id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. A single row is its own next; an empty
    table gives no rows."""
    rows = with_next(docs, id_col, text_col)
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.char_length("text") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("id", F.char_length("text").cast("bigint").alias("n_chars"), "signatures", "next_signatures", edited.alias("edited"))
    rows = rows.withColumn("edited_signatures", order_minhash(F.col("edited")))
    return rows.select(
        F.col("id").alias(id_col),
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_string(F.col("signatures")).alias("fingerprint"),
        as_string(F.col("edited_signatures")).alias("edited_fingerprint"),
        likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"),
        likeness(F.col("signatures"), F.col("next_signatures")).alias("near_next"),
    )
