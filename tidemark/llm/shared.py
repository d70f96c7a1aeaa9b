"""Helpers that several corpus operators use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.stash import shared_dir, stash

__all__ = ["BLANKS", "WORD", "crc_of_id", "join_counted", "let", "n_words", "shared_dir", "small", "stash", "table", "uniform", "words"]

#: Keys that hold more than one in so many of all rows are joined by broadcast. There can't be more of them than this.
HOT_KEYS = 4096
#: Keys with at most so many rows are never hot.
NEVER_HOT = 2000
#: Tables of at most so many short rows are broadcast once they have been counted.
BROADCAST_ROWS = 100_000

#: A word is a maximal run of characters other than space and the five ASCII control blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates value once per row and hands it to body (a lambda variable, so that it isn't expanded at every use)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def n_words(text: Column) -> Column:
    """Number of words; null and blank texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """The words of a text in order; null text: no words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id as text, for folds."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def uniform(seed: int, *keys: Column) -> Column:
    """A number in (0, 1) that depends on the keys alone."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed).cast("long"), *keys), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if a count shows that it has at most `most` rows, and to be joined by shuffle beyond."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def join_counted(rows: DataFrame, keyed: DataFrame, on: dict[str, str], n: str, total: int) -> DataFrame:
    """Inner join of rows with keyed (one row per key, written tables both), where no key's rows all go to one task.

    on names the columns of rows and of keyed that must agree; keyed's column n is the number of rows with the key (or more), total
    the sum of n or more. Keys with more than total / HOT_KEYS rows number at most HOT_KEYS, so they are broadcast and their rows stay
    where they are; the rows of all others are dealt by key.
    """
    line = max(NEVER_HOT, total // HOT_KEYS)
    hot = keyed.where(F.col(n) > line)
    names = list(on.values())
    both = [F.col(a) == F.col(b) for a, b in on.items()]
    if hot.isEmpty():
        return rows.join(keyed, both)
    keys = F.broadcast(hot.select(*[F.col(c).alias(f"_hot{i}") for i, c in enumerate(names)]))
    cold = rows.join(keys, [F.col(a) == F.col(f"_hot{i}") for i, a in enumerate(on)], "left_anti")
    return rows.join(F.broadcast(hot), both).unionByName(cold.join(keyed.where(F.col(n) <= line), both))
