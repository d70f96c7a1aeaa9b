"""Repeated byte strings by hashes of windows, grouped by their least-hashed digit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import join_counted, stash

#: Bytes of the first digit; a suffix is sorted by it only where it is the least digit of its window.
DIGIT = 64
#: Windows hashed at once; longer texts are cut into overlapping parts of so many window starts.
PART = 1 << 20
#: Bytes that are hashed together: places in them are told apart by the bits of POSITION.
MOST = 2 * PART
POSITION = np.uint64(MOST - 1)
#: Two hashes, of different multipliers and different numbers for the bytes: one of digits, one of windows and spans.
MULTIPLIERS = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
Tables = tuple[np.ndarray, np.ndarray, np.ndarray]


def _tables(which: int, n: int) -> Tables:
    """A random number for each byte value, powers of an odd number, and powers of its inverse, modulo 2**64."""
    byte = np.random.default_rng(20240229 + which).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def powers(x: int) -> np.ndarray:
        out = np.full(n, x, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return byte, powers(MULTIPLIERS[which]), powers(pow(MULTIPLIERS[which], -1, 1 << 64))


_made: dict[int, Tables] = {}


def tables(which: int, n: int) -> Tables:
    """The tables for at least n bytes, kept by the worker."""
    if which not in _made or len(_made[which][1]) < n:
        _made[which] = _tables(which, max(2 * n, MOST + 1))
    return _made[which]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


class Hashed:
    """Hashes of any substring of some bytes, from prefix sums."""

    def __init__(self, data: np.ndarray, which: int):
        byte, power, self.inverse = tables(which, len(data) + 1)
        self.sums = np.empty(len(data) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(byte[data] * power[: len(data)], out=self.sums[1:])

    def each(self, size: int) -> np.ndarray:
        """Of every substring of so many bytes."""
        n = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:n]) * self.inverse[:n])

    def spans(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sums[b] - self.sums[a]) * self.inverse[a]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by minima from both ends of blocks of that width."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def window_runs(parts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """part, first start, last start, digit hash, span hash of the runs of windows that share their least digit.

    Every window of `length` bytes has one least digit (by hash, the leftmost of equals), at a place that its bytes alone decide. Equal
    windows thus have equal digits at the same distance from their starts. Neighbouring windows with the same digit form a run.
    """
    sizes = np.array([len(p) for p in parts])
    data = np.frombuffer(b"".join(parts), np.uint8)
    if len(data) > MOST:
        raise ValueError(f"at most {MOST} bytes at once")
    digit = Hashed(data, 0).each(DIGIT)
    least = sliding_min((digit & ~POSITION) | np.arange(len(digit), dtype=np.uint64), length - DIGIT + 1) & POSITION
    least = least.astype(np.int64)
    firsts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    change = np.flatnonzero(least[1:] != least[:-1]) + 1
    ends = firsts + sizes - length + 1  # after the last window of each part
    starts = np.unique(np.concatenate((change, firsts, ends)))
    starts = starts[starts < len(least)]
    lasts = np.concatenate((starts[1:], [len(least)])) - 1
    part = np.searchsorted(firsts, starts, "right") - 1
    inside = lasts < ends[part]
    starts, lasts, part = starts[inside], lasts[inside], part[inside]
    anchor = least[starts]
    whole = mixed(Hashed(data, 1).spans(starts, lasts + length) + mixed((((lasts - starts) << 20) + (anchor - starts)).astype(np.uint64)))
    return part, starts - firsts[part], lasts - firsts[part], digit[anchor], whole


def _runs(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, mark, first, last, digit, whole: the runs of windows of every text (column data, binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column("data")
            parts, owner, base, held = [], [], [], 0

            def flush(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                part, first, last, digit, whole = window_runs(parts, length)
                rows, shift = np.array(owner)[part], np.array(base)[part]
                keys = [batch.column(c).take(pa.array(rows)) for c in ("doc_id", "mark")]
                longs = [pa.array(x.astype(np.int64)) for x in (first + shift, last + shift)] + [pa.array(x.view(np.int64)) for x in (digit, whole)]
                return pa.RecordBatch.from_arrays(keys + longs, ["doc_id", "mark", "first", "last", "digit", "whole"])

            for i in range(batch.num_rows):
                text = data[i].as_py()
                for at in range(0, max(0, len(text) - length + 1), PART):
                    piece = text[at : at + PART + length - 1]
                    if held + len(piece) > MOST:
                        yield flush()
                        parts, owner, base, held = [], [], [], 0
                    parts.append(piece)
                    owner.append(i)
                    base.append(at)
                    held += len(piece)
                    if held >= PART:
                        yield flush()
                        parts, owner, base, held = [], [], [], 0
            if parts:
                yield flush()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, mark bigint, first bigint, last bigint, digit bigint, whole bigint")


def repeated_ranges(digits: np.ndarray, spans: list[bytes], several: np.ndarray, length: int) -> list[list[int]]:
    """For whole groups of distinct spans: the windows of each that also stand in another, as [first, last, first, last ...].

    A span that occurs several times is repeated from end to end. Of the others every window is hashed; windows of one digit with equal
    hashes count as equal strings.
    """
    hashed = Hashed(np.frombuffer(b"".join(spans), np.uint8), 1)
    sizes = np.array([len(s) for s in spans])
    counts = sizes - length + 1
    firsts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    owner = np.repeat(np.arange(len(spans)), counts)
    begin = np.concatenate(([0], np.cumsum(counts)[:-1]))
    inner = np.arange(len(owner)) - begin[owner]
    at = firsts[owner] + inner
    key = mixed(hashed.spans(at, at + length)) ^ mixed(digits.view(np.uint64))[owner]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    repeated = np.zeros(len(key), bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    repeated |= several[owner]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], repeated, [False])).astype(np.int8)))
    out: list[list[int]] = [[] for _ in spans]
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):  # a run may cross into the next spans
        while a < b:
            k = int(owner[a])
            stop = min(b, int(begin[k] + counts[k]))
            out[k] += [int(inner[a]), int(inner[stop - 1])]
            a = stop
    return out


def _spans(docs: DataFrame, length: int) -> DataFrame:
    """digit, whole, n, span for the runs listed with each document (column asked)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, int, bytes]] = []
            for data, asked in zip(batch.column("data"), batch.column("asked"), strict=True):
                text = data.as_py()
                rows += [(x["digit"], x["whole"], x["n"], text[x["first"] : x["last"] + length]) for x in asked.as_py()]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["digit", "whole", "n", "span"])

    return docs.select("data", "asked").mapInArrow(run, "digit bigint, whole bigint, n bigint, span binary")


def _compare_groups(spans: DataFrame, length: int) -> DataFrame:
    """digit, whole, n, ranges; all spans of a digit stand in one partition, in order, and are compared there some groups at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared(table: pa.Table) -> pa.RecordBatch:
            digits, whole, n = (table.column(c).to_numpy() for c in ("digit", "whole", "n"))
            ranges = repeated_ranges(digits, table.column("span").to_pylist(), n > 1, length)
            return pa.RecordBatch.from_arrays([pa.array(digits), pa.array(whole), pa.array(n), pa.array(ranges, pa.list_(pa.int32()))], ["digit", "whole", "n", "ranges"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            digits = batch.column("digit").to_numpy()
            cut = int(np.searchsorted(digits, digits[-1], "left"))  # the last group may go on in the next batch
            if cut or (held and held[-1].column("digit")[-1].as_py() != digits[0]):
                ready = [*held, batch.slice(0, cut)] if cut else held
                yield compared(pa.Table.from_batches(ready))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield compared(pa.Table.from_batches(held))

    return spans.mapInArrow(run, "digit bigint, whole bigint, n bigint, ranges array<int>")


def _compare_rows(spans: DataFrame, length: int) -> DataFrame:
    """The same for groups of any size: one row per window, counted by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                span = np.frombuffer(batch.column("span")[i].as_py(), np.uint8)
                keys = Hashed(span, 1).each(length).view(np.int64)
                fixed = [pa.array(np.full(len(keys), batch.column(c)[i].as_py())) for c in ("digit", "whole", "n")]
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(np.arange(len(keys), dtype=np.int32)), pa.array(keys)], ["digit", "whole", "n", "at", "key"])

    rows = stash(spans.mapInArrow(run, "digit bigint, whole bigint, n bigint, at int, key bigint"), "window-rows")
    often = rows.groupBy(F.col("digit").alias("_d"), F.col("key").alias("_k")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    hit = join_counted(rows.where("n = 1"), stash(often, "windows-often"), {"digit": "_d", "key": "_k"}, "_n", rows.count())
    # A span has at most length - DIGIT + 1 windows.
    one = hit.select("digit", "whole", "n", "at").unionByName(rows.where("n > 1").drop("key")).groupBy("digit", "whole", "n").agg(F.collect_set("at").alias("at"))
    return one.select("digit", "whole", "n", F.flatten(F.transform("at", lambda x: F.array(x, x))).alias("ranges"))


def remove_repeats(docs: DataFrame, length: int = 200, most_in_group: int = 20_000) -> DataFrame:
    """doc_id, n_bytes, removed (array of start, end), kept (binary) for every row of docs.

    Removes each byte covered by a string of `length` bytes (UTF-8) that also starts anywhere else, in the same document or another.

    This stands for a sort of all suffixes through their first `length` bytes, whose equal groups are the repeats. No suffix is sorted:
    windows are grouped by one digit of 64 bytes, at one place in about seventy: that of each window whose hash is
    least, which equal windows share. Neighbouring windows with the same least digit form a run. Runs that are alone with their digit
    have no repeat and go no further. Groups whose runs all have the same hash of their spans are repeated as a whole. Only for the
    rest the spans themselves are fetched, one for each distinct hash, and all their windows hashed: groups of up to most_in_group
    contents inside a task, larger ones as rows that Spark counts. Bytes are never compared: two windows count as equal if a hash of 64
    bits of the digit inside them and another one of 64 bits of the window or its span, with other multipliers, agree. For n different windows
    that share a digit, the chance that any two are taken for equal is about n * n / 2 ** 65.

    Null text counts as empty; texts shorter than `length` have no windows. Rows that agree in id and text are repeats of each other.
    Extra columns are left out. Groups are reduced by partial aggregation, and digits or spans that very many windows share are joined
    by broadcast (join_counted), so that a passage that a third of all documents share isn't put in one task.
    """
    if length < 2 * DIGIT:
        raise ValueError(f"windows are of at least {2 * DIGIT} bytes")
    data = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    docs = docs.select("doc_id", F.xxhash64("text").alias("mark"), data.alias("data"))
    runs = stash(_runs(docs, length), "window-runs")
    shared = runs.groupBy(F.col("digit").alias("_d")).agg(F.count(F.lit(1)).alias("_n"), F.min("whole").alias("_lo"), F.max("whole").alias("_hi")).where("_n > 1")
    hits = join_counted(runs, stash(shared, "shared-digits"), {"digit": "_d"}, "_n", runs.count()).select("doc_id", "mark", "first", "last", "digit", "whole", (F.col("_lo") == F.col("_hi")).alias("same"))
    hits = stash(hits, "window-hits")

    contents = hits.where("not same").groupBy("digit", "whole").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("doc_id", "mark", "first", "last")).alias("_at"))
    contents = contents.select("digit", "whole", F.col("_n").alias("n"), "_at.*")
    asked = contents.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("digit", "whole", "n", "first", "last")).alias("asked"))
    key = lambda other: F.col("doc_id").eqNullSafe(F.col(f"{other}.doc_id")) & (F.col("mark") == F.col(f"{other}.mark"))
    by_key = lambda df, other: df.select(F.struct("doc_id", "mark").alias(other), *[c for c in df.columns if c not in ("doc_id", "mark")])
    found = docs.join(by_key(asked, "_a"), key("_a"))
    # A text that stands in several rows is asked once.
    spans = stash(_spans(found, length).dropDuplicates(["digit", "whole"]), "window-spans")
    sizes = spans.groupBy("digit").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most_in_group).select("digit")
    large = stash(sizes, "large-groups")
    small = spans.join(large, "digit", "left_anti").repartition("digit").sortWithinPartitions("digit")
    ranges = _compare_groups(small, length)
    if not large.isEmpty():
        ranges = ranges.unionByName(_compare_rows(spans.join(large, "digit", "left_semi"), length))
    ranges = stash(ranges.where(F.size("ranges") > 0), "window-ranges").withColumnsRenamed({"digit": "_d", "whole": "_w"})

    partly = join_counted(hits.where("not same"), ranges, {"digit": "_d", "whole": "_w"}, "n", hits.count())
    pairs = F.transform(F.sequence(F.lit(0), F.size("ranges") - 2, F.lit(2)), lambda i: F.struct(F.get("ranges", i).alias("a"), F.get("ranges", i + 1).alias("b")))
    partly = partly.select("doc_id", "mark", "first", F.explode(pairs).alias("p")).select("doc_id", "mark", (F.col("first") + F.col("p.a")).alias("start"), (F.col("first") + F.col("p.b") + length).alias("end"))
    wholly = hits.where("same").select("doc_id", "mark", F.col("first").alias("start"), (F.col("last") + length).alias("end"))
    covered = wholly.unionByName(partly).groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", "end")).alias("covered"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            for data, covered in zip(batch.column("data"), batch.column("covered"), strict=True):
                text, spans = data.as_py(), []
                for x in sorted((x["start"], x["end"]) for x in covered.as_py() or ()):
                    if spans and x[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], x[1])
                    else:
                        spans.append(list(x))
                ends = [0, *(p for s in spans for p in s), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)))
                removed.append([{"start": a, "end": b} for a, b in spans])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(d.as_py()) for d in batch.column("data")], pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = docs.join(by_key(covered, "_c"), key("_c"), "left").select("doc_id", "data", "covered")
    return joined.mapInArrow(cut, f"doc_id {kind}, n_bytes bigint, removed array<struct<start:bigint,end:bigint>>, kept binary")
