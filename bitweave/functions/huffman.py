"""Variable-length codebooks: (value, bit length, codeword) rows, their tree, and checks."""

from __future__ import annotations

import re
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .literals import parse_int


def codebook_rows(texts: DataFrame, text: str, by: tuple[str, ...] = (), radix: tuple[int, int, int] = (10, 10, 16)) -> DataFrame:
    """by, value, bit_len, codeword of many codebooks, each the text of one row: three numbers a code, side by side in any layout, between any of nine delimiters.

    ``by`` names the book and must not repeat.  Numbers are put together inside
    their row, without a shuffle; an incomplete code at the end is left out.
    """
    words = F.filter(F.split(F.regexp_replace(text, r"[\s,;:|(){}]+", " "), " "), lambda w: w != "")
    rows = texts.select(*by, words.alias("_w")).withColumn("_k", F.explode(F.when(F.size("_w") >= 3, F.sequence(F.lit(0), F.floor(F.size("_w") / 3) * 3 - 3, F.lit(3)))))

    def number(offset: int, base: int) -> Column:
        word = F.get("_w", F.col("_k") + offset)
        return F.when(word.startswith("-"), F.concat(F.lit("-"), F.conv(F.substring(word, 2, 64), base, 10))).otherwise(F.conv(F.regexp_replace(word, "^0x", ""), base, 10)).cast("bigint")

    return rows.select(*by, number(0, radix[0]).alias("value"), number(1, radix[1]).cast("int").alias("bit_len"), number(2, radix[2]).alias("codeword"))


def read_codebook(spark: SparkSession, path: str, radix: tuple[int, int, int] = (10, 10, 16)) -> DataFrame:
    """``codebook_rows`` of one file."""
    return codebook_rows(spark.read.text(path, wholetext=True), "value", (), radix)


def codebook_stats(book: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per book: n_codes, n_distinct, min_len, max_len, kraft (sum of 2**(60 - length), 2**60 being a complete code), n_prefix_clashes, n_nodes."""
    code = F.lpad(F.bin("codeword"), 64, "0")
    rows = book.select(*by, "bit_len", F.substring(code, F.lit(65) - F.col("bit_len"), F.col("bit_len")).alias("bits"))
    base = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_codes"), F.countDistinct("bits").alias("n_distinct"), F.min("bit_len").alias("min_len"), F.max("bit_len").alias("max_len"), F.sum(F.expr("cast(shiftleft(cast(1 as bigint), 60 - bit_len) as decimal(38,0))")).cast("bigint").alias("kraft"))
    prefixes = rows.select(*by, F.explode(F.transform(F.sequence(F.lit(0), F.col("bit_len") - 1), lambda n: F.substring(F.col("bits"), F.lit(1), n))).alias("bits"))
    inner = prefixes.distinct()
    clashes = rows.join(inner, [*by, "bits"], "left_semi").groupBy(*by).agg(F.count(F.lit(1)).alias("n_prefix_clashes"))
    nodes = inner.groupBy(*by).agg(F.count(F.lit(1)).alias("n_inner"))
    both = base.join(clashes, list(by), "left").join(nodes, list(by), "left") if by else base.join(clashes).join(nodes)  # without a key one row each
    return both.select(*by, "n_codes", "n_distinct", "min_len", "max_len", "kraft", F.coalesce("n_prefix_clashes", F.lit(0)).alias("n_prefix_clashes"), (F.col("n_inner") + F.col("n_distinct")).alias("n_nodes"))


class Codebook:
    """A binary tree of codes: bit 0 goes left, bit 1 right."""

    def __init__(self, codes: list[tuple[int, int, int]]):
        self.table = {(n, code): value for value, n, code in codes}
        self.depth = max((n for _, n, _ in codes), default=0)

    def decode(self, bits: str) -> list[int]:
        out, at = [], 0
        while at < len(bits):
            for n in range(1, self.depth + 1):
                value = self.table.get((n, int(bits[at : at + n] or "0", 2))) if at + n <= len(bits) else None
                if value is not None:
                    out.append(value)
                    at += n
                    break
            else:
                break
        return out

    def kraft(self) -> Fraction:
        return sum((Fraction(1, 1 << n) for n, _ in self.table), Fraction(0))

    def search_rows(self) -> list[tuple[int, int, int]]:
        """The tree as an array for binary search: (left index, right index, value or -1), root first."""
        rows: list[list] = [[-1, -1, None]]
        for (n, code), value in sorted(self.table.items()):
            at = 0
            for k in reversed(range(n)):
                side = (code >> k) & 1
                if rows[at][side] < 0:
                    rows.append([-1, -1, None])
                    rows[at][side] = len(rows) - 1
                at = rows[at][side]
            rows[at][2] = value
        return [tuple(r) for r in rows]


def exp_golomb(spark: SparkSession, n: int) -> DataFrame:
    """The first n codes of ue(v) as a codebook."""
    bits = F.length(F.bin(F.col("id") + 1))
    return spark.range(n).select(F.col("id").alias("value"), (bits * 2 - 1).cast("int").alias("bit_len"), (F.col("id") + 1).alias("codeword"))


def parse_codebook(text: str, radix: tuple[int | None, int | None, int | None] = (None, 10, 16)) -> list[tuple[int, int, int]]:
    words = [x for x in re.split(r"[\s,;:|(){}]+", text) if x]
    return [tuple(parse_int(w, r) for w, r in zip(words[k : k + 3], radix, strict=True)) for k in range(0, len(words) - len(words) % 3, 3)]
