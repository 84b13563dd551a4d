"""Digests, identifiers and simhash; all native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sha256(col: Column) -> Column:
    return F.sha2(F.coalesce(col, F.lit("")).cast("binary"), 256)


def article_sha256(title: Column, text: Column) -> Column:
    return sha256(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit(""))))


def article_id(sha: Column) -> Column:
    return F.substring(sha, 1, 16)


def fallback_id(sha: Column, url: Column) -> Column:
    return F.substring(sha256(F.concat(F.coalesce(sha, F.lit("")), F.lit("|"), F.coalesce(url, F.lit("")))), 1, 16)


def md5_64(col: Column) -> Column:
    """The first 64 bits of the md5 digest as a long."""
    return F.conv(F.substring(F.md5(col.cast("binary")), 1, 16), 16, -10).cast("bigint")


def unsigned(col: Column) -> Column:
    """A long's bits as an unsigned decimal."""
    wide = col.cast("decimal(20,0)")
    return F.when(col < 0, wide + F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(wide)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


TOKEN = "[a-z0-9]{2,}"
_TWO_LANES = 0x0000000100000001


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def simhash64(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and simhash64 of every row: a bit is set if more than half of the row's tokens have it in their hash.

    Nothing is shuffled. Each long sums two bits of the hashes, k and k + 32, in lanes of 32 bits.
    """
    hashed = docs.select(id_col, F.transform(tokens(F.col(text_col)), md5_64).alias("hashes"))
    zero, lanes, one = F.lit(0).cast("bigint"), F.lit(_TWO_LANES).cast("bigint"), F.lit(1).cast("bigint")

    def two_bits(k: int) -> Column:
        return F.aggregate("hashes", zero, lambda total, h: total + F.shiftrightunsigned(h, k).bitwiseAND(lanes)).alias(f"s{k}")

    sums = [two_bits(k) for k in range(32)]
    summed = hashed.select(id_col, F.size("hashes").cast("bigint").alias("n"), *sums)
    out = zero
    for k in range(32):
        low, high = F.col(f"s{k}").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")), F.shiftrightunsigned(f"s{k}", 32)
        for bit, count in ((k, low), (k + 32, high)):
            out = out.bitwiseOR(F.when(2 * count > F.col("n"), F.shiftleft(one, bit)).otherwise(zero))
    return summed.select(id_col, out.alias("simhash64"))


def token_frequency(docs: DataFrame, text_col: str) -> DataFrame:
    """token, n (occurrences) and docs (rows that have it). Counts are combined before the only shuffle, by token."""
    row = F.col("tokens")
    marks = F.concat(F.transform(row, lambda t: F.struct(t.alias("token"), F.lit(0).alias("first"))), F.transform(F.array_distinct(row), lambda t: F.struct(t.alias("token"), F.lit(1).alias("first"))))
    seen = docs.select(tokens(F.col(text_col)).alias("tokens")).select(F.inline(marks))
    return seen.groupBy("token").agg(F.count_if(F.col("first") == 0).alias("n"), F.count_if(F.col("first") == 1).alias("docs"))
