"""Brown class-based bigram scores of documents."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import crc_of_id, stash
from tidemark.llm.simhash import LOWER

#: Words counted so often or more in training each have a class of their own choice, by their neighbours, however many they are. Rarer
#: ones share the classes of groups of equal endings.
LEAST = 10
#: The most frequent words, whose exchange makes the classes that all others then choose from.
WORDS = 2048
ENDINGS = 512
#: Words of one group in which a class is chosen for one after the other.
GROUP = 4000
#: Bits of a filter that tells which unknown words may have a class of their own.
FILTER = 1 << 24
#: Classes; the last one holds the end of the text alone.
CLASSES = 64
SWEEPS = 8
#: At most so many words, the most frequent, are known to every worker with their counts; the counts of rarer words are joined.
KNOWN = 1 << 17
#: Steps of frequency an octave, between which the line between known and rarer words is drawn.
STEPS = 16
#: Bytes of text, or tokens, that are worked on at once.
BATCH = 1 << 20
PENDING = 5_000_000
#: Classes before and after.
WIDTH = 2 * CLASSES


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


def count_words(docs: DataFrame) -> DataFrame:
    """word, n over all texts: counted in the tasks, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column("text"):
                seen.update(tokens(text.as_py()))
                if len(seen) > 400_000:
                    yield flush()
        yield flush()

    return docs.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Vocabulary:
    """What bounded tables know: the most frequent words, the endings, and totals over the whole corpus.

    ending_tokens and ending_once count the words that have no class of their own.
    """

    words: list[bytes]
    counts: np.ndarray
    n_tokens: int
    n_types: int
    n_ends: int
    ending_tokens: np.ndarray
    ending_once: np.ndarray
    #: So many of the words, the first, have classes of their own.
    n_single: int
    #: Words counted at least so often are known.
    cut: int = 1
    #: Marks the words counted LEAST times or more that aren't known, and some others.
    filter: np.ndarray = field(default_factory=lambda: np.zeros(FILTER // 64, np.uint64))

    @property
    def units(self) -> int:
        """Single words, endings, and the end of the text."""
        return self.n_single + ENDINGS + 1


def vocabulary(counts: DataFrame, n_ends: int) -> Vocabulary:
    """Collects at most KNOWN words and ENDINGS groups.

    Words are counted by steps of frequency first, a few hundred rows, so that no task sends more words than are taken.
    """
    total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    step = F.floor(F.log2("n") * STEPS).cast("int")
    levels = counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).orderBy(F.desc("s")).collect()
    taken, cut = 0, 1 << 62
    for level in levels:
        taken += level["words"]
        if taken > KNOWN:
            break
        cut = level["least"]
    top = counts.where(F.col("n") >= cut).toPandas().sort_values(["n", "word"], ascending=[False, True])
    words = [w.encode() for w in top["word"]]
    of = counts.where(F.col("n") < LEAST).withColumn("e", F.crc32(F.substring(F.encode("word", "UTF-8"), -3, 3)) % ENDINGS).groupBy("e").agg(F.sum("n").alias("n"), F.count_if(F.col("n") == 1).alias("once")).toPandas()
    held, once = np.zeros(ENDINGS), np.zeros(ENDINGS)
    held[of["e"].to_numpy(int)], once[of["e"].to_numpy(int)] = of["n"], of["once"]
    place = (F.crc32(F.encode("word", "UTF-8")) % FILTER).alias("h")
    marks = counts.where((F.col("n") >= LEAST) & (F.col("n") < cut)).select(place).groupBy(F.floor(F.col("h") / 64).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(h % 64 AS INT))")).alias("bits")).toPandas()
    bits = np.zeros(FILTER // 64, np.uint64)
    bits[marks["at"].to_numpy(int)] = marks["bits"].to_numpy(np.int64).view(np.uint64)
    n = top["n"].to_numpy(np.int64)
    return Vocabulary(words, n, int(total[1]) + n_ends, int(total[0]) + (n_ends > 0), n_ends, held, once, int((n >= LEAST).sum()), cut, bits)


class Reader:
    """Turns texts into numbers: the index among known words (-1: none) and the unit of each token."""

    def __init__(self, v: Vocabulary):
        self.at = {w: i for i, w in enumerate(v.words)}
        self.end = v.units - 1
        self.unit = np.array([i if i < v.n_single else v.n_single + ending(w) for i, w in enumerate(v.words)] or [0], np.int64)
        self.first_ending = v.n_single
        self.filter = v.filter.view(np.uint8)

    def own_class(self, words: list[bytes]) -> np.ndarray:
        """Which unknown words may have a class of their own."""
        h = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % FILTER
        return (self.filter[h >> 3] >> (h & 7).astype(np.uint8) & 1).astype(bool)

    def read(self, texts: list[str | None]) -> Tokens:
        split = [tokens(t) for t in texts]
        get = self.at.get
        flat: list[int] = []
        for words in split:
            flat += [get(w, -1) for w in words]
            flat.append(-2)
        index = np.array(flat, np.int64)
        unit = self.unit[np.maximum(index, 0)]
        unit[index == -2] = self.end
        sizes = np.array([len(w) + 1 for w in split])
        begin = np.cumsum(sizes) - sizes
        where = np.flatnonzero(index == -1)
        text = np.searchsorted(begin, where, "right") - 1
        rare = [split[t][k] for t, k in zip(text.tolist(), (where - begin[text]).tolist(), strict=True)]
        unit[where] = self.first_ending + np.fromiter(map(zlib.crc32, [w[-3:] for w in rare]), np.int64, len(rare)) % ENDINGS
        return Tokens(index, unit, sizes, where, text, rare)


@dataclass(frozen=True)
class Tokens:
    """All tokens of some texts, an end after each text: index among known words (-1: none, -2: an end) and unit of each; the length of
    each text with its end; and the unknown words, with their places among all tokens and their texts."""

    index: np.ndarray
    unit: np.ndarray
    sizes: np.ndarray
    where: np.ndarray
    text: np.ndarray
    rare: list[bytes]


def by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str | None]]]:
    """Slices of a batch's texts of about BATCH bytes: first row and texts."""
    texts, held, first = [], 0, 0
    for i, t in enumerate(batch.column("text")):
        texts.append(t.as_py())
        held += len(texts[-1] or "")
        if held >= BATCH or i + 1 == batch.num_rows:
            yield first, texts
            texts, held, first = [], 0, i + 1


def count_pairs(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """a, b, n: how often unit b follows unit a, the end also standing before each text. At most units ** 2 rows, whatever the corpus."""
    shared = docs.sparkSession.sparkContext.broadcast(v)
    units = v.units

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            codes, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array((codes // units).astype(np.int32)), pa.array((codes % units).astype(np.int32)), pa.array(n)], ["a", "b", "n"])

        for batch in batches:
            for _, texts in by_size(batch):
                unit = reader.read(texts).unit
                held.append(np.concatenate(([reader.end], unit[:-1])) * units + unit)
                if sum(map(len, held)) > PENDING:
                    yield flush()
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))


def class_counts(pairs: DataFrame, classes: np.ndarray) -> DataFrame:
    """unit, k, n: how often a unit stands before (k = class) or after (k = CLASSES + class) each class, and itself (k = 2 * CLASSES)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 2 * CLASSES + 1
        cells = np.zeros(len(classes) * width)
        for batch in batches:
            a, b, n = (batch.column(c).to_numpy() for c in ("a", "b", "n"))
            for rows, k, m in ((a, classes[b], n), (b, CLASSES + classes[a], n), (a, np.full(len(a), 2 * CLASSES), np.where(a == b, n, 0))):
                cells += np.bincount(rows.astype(np.int64) * width + k, weights=m, minlength=len(cells))
        some = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array((some // width).astype(np.int32)), pa.array((some % width).astype(np.int32)), pa.array(cells[some].astype(np.int64))], ["unit", "k", "n"])

    return pairs.mapInArrow(run, "unit int, k int, n bigint").groupBy("unit", "k").agg(F.sum("n").alias("n"))


def transitions(cells: DataFrame, classes: np.ndarray) -> np.ndarray:
    """Class bigram counts: at most CLASSES ** 2 numbers come to the driver."""
    named = cells.sparkSession.createDataFrame([(i, int(c)) for i, c in enumerate(classes)], "u int, c int")
    summed = cells.where(F.col("k") < CLASSES).join(F.broadcast(named), F.col("unit") == F.col("u")).groupBy("c", "k").agg(F.sum("n").alias("n")).collect()
    out = np.zeros((CLASSES, CLASSES))
    for r in summed:
        out[r["c"], r["k"]] = r["n"]
    return out


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(units: np.ndarray, before: np.ndarray, after: np.ndarray, itself: np.ndarray, classes: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Moves each unit in turn to the class that gives the class bigram model the highest likelihood; returns their classes.

    before[i] and after[i] are the counts of the classes that follow and precede unit i. The class bigrams are updated with each move.
    """
    f, out = pairs.copy(), np.empty(len(units), np.int64)
    for i, u in enumerate(units):
        own, s, p, e = int(classes[u]), before[i].copy(), after[i].copy(), itself[i]
        s[own] -= e
        p[own] -= e
        f[own, :] -= s
        f[:, own] -= p
        f[own, own] -= e
        np.maximum(f, 0, out=f)
        logs = xlogx(f)
        rows, cols = f.sum(1), f.sum(0)
        right, left = xlogx(f + s[None, :]) - logs, xlogx(f + p[:, None]) - logs
        d = np.diag(f)
        gain = right.sum(1) - np.diag(right) + left.sum(0) - np.diag(left) + xlogx(d + s + p + e) - xlogx(d)
        gain -= xlogx(rows + s.sum() + e) - xlogx(rows) + xlogx(cols + p.sum() + e) - xlogx(cols)
        gain[CLASSES - 1] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= gain[own] + 1e-9:
            best = own
        f[best, :] += s
        f[:, best] += p
        f[best, best] += e
        out[i] = best
    return out


def mover(f: np.ndarray, classes: np.ndarray):
    """The exchange over a group's class counts, for applyInArrow."""

    def run(table: pa.Table) -> pa.Table:
        unit, k, n = (table.column(c).to_numpy() for c in ("unit", "k", "n"))
        units, row = np.unique(unit, return_inverse=True)
        counts = np.zeros((len(units), 2 * CLASSES + 1))
        counts[row, k] = n
        moved = exchange(units, counts[:, :CLASSES], counts[:, CLASSES:-1], counts[:, -1], classes, f)
        return pa.table({"unit": pa.array(units.astype(np.int32)), "class": pa.array(moved.astype(np.int32))})

    return run


def cluster(pairs: DataFrame, v: Vocabulary, sweeps: int = SWEEPS, groups: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Class of each unit, and class bigram counts.

    Exchange clustering in sweeps: Spark counts each unit's neighbours by class, then tasks move the units of their group one after the
    other, each on its own copy of the class bigrams; the classes of all groups are the start of the next sweep. A sweep moves a random
    half of the units: if all moved at once, neighbours would follow each other's old classes and the likelihood would swing. The first
    classes go round by frequency.
    """
    classes = np.arange(v.units, dtype=np.int64) % (CLASSES - 1)
    classes[-1] = CLASSES - 1
    still = 0
    for sweep in range(sweeps):
        cells = class_counts(pairs, classes)
        cells = stash(cells, "class-counts")
        f, now = transitions(cells, classes), classes.copy()

        group = F.pmod(F.xxhash64(F.lit(sweep), "unit"), F.lit(2 * groups)).alias("g")
        moved = cells.where(F.col("unit") < v.units - 1).select("unit", "k", "n", group).where(F.col("g") < groups).groupBy("g").applyInArrow(mover(f, now), "unit int, class int").collect()
        for r in moved:
            classes[r["unit"]] = r["class"]
        still = still + 1 if np.array_equal(now, classes) else 0
        if still == 2:
            break
    return classes, transitions(class_counts(pairs, classes), classes)


def _rows_of(names: list, codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """One row a word, of sorted codes (number of the word times WIDTH, plus class) and their counts: word, cells (count times WIDTH, plus
    class)."""
    word = codes // WIDTH
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    cells = pa.ListArray.from_arrays(np.append(starts, len(codes)).astype(np.int32), pa.array(n * WIDTH + codes % WIDTH))
    return pa.RecordBatch.from_arrays([pa.array([names[i] for i in word[starts].tolist()], pa.binary()).cast(pa.string()), cells], ["word", "cells"])


def count_neighbours(docs: DataFrame, v: Vocabulary, coarse: Vocabulary, classes: np.ndarray) -> DataFrame:
    """word, cells: how often the words that are to choose a class stand before (class) or after (CLASSES + class) each class.

    classes are those of the coarse units. Words that aren't known come along if the filter has them. A word's counts are summed within
    tasks, dealt by word, and summed as they pass by in order, so that no more than a batch is held.
    """
    shared = docs.sparkSession.sparkContext.broadcast((v, coarse, classes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, coarse, classes = shared.value
        reader = Reader(coarse)
        held: list[np.ndarray] = []
        names, more = list(v.words), {}

        def flush() -> pa.RecordBatch:
            codes, n = np.unique(np.concatenate(held), return_counts=True)
            out = _rows_of(names, codes, n)
            held.clear()
            more.clear()
            del names[len(v.words) :]
            return out

        for batch in batches:
            for _, texts in by_size(batch):
                t = reader.read(texts)
                cls = classes[t.unit]
                before, after = np.concatenate(([CLASSES - 1], cls[:-1])) + CLASSES, np.concatenate((cls[1:], [CLASSES - 1]))
                index = t.index.copy()
                own = reader.own_class(t.rare)
                for i, w in zip(t.where[own].tolist(), [w for w, o in zip(t.rare, own.tolist(), strict=True) if o], strict=True):
                    if w not in more:
                        more[w] = len(names)
                        names.append(w)
                    index[i] = more[w]
                at = np.flatnonzero((index >= coarse.n_single) & ((index < v.n_single) | (index >= len(v.words))))
                held += [index[at] * WIDTH + k[at] for k in (before, after)]
                if sum(map(len, held)) > PENDING:
                    yield flush()
        if held:
            yield flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None  # the last word may go on in the next batch
        for batch in batches:
            if batch.num_rows == 0:
                continue
            both = batch if last is None else pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            words = pc.dictionary_encode(both.column("word"))  # numbered as they come, that is in order
            row = np.repeat(words.indices.to_numpy(), np.diff(both.column("cells").offsets.to_numpy()))
            values = both.column("cells").flatten().to_numpy()
            codes, at = np.unique(row.astype(np.int64) * WIDTH + values % WIDTH, return_inverse=True)
            n = np.bincount(at, weights=values // WIDTH, minlength=len(codes)).astype(np.int64)
            done = _rows_of([w.encode() for w in words.dictionary.to_pylist()], codes, n)
            last = done.slice(done.num_rows - 1)
            if done.num_rows > 1:
                yield done.slice(0, done.num_rows - 1)
        if last is not None:
            yield last

    kind = "word string, cells array<bigint>"
    return docs.select("text").mapInArrow(count, kind).repartition("word").sortWithinPartitions("word").mapInArrow(add, kind)


def choose_classes(cells: DataFrame, n_words: int, classes: np.ndarray, first_ending: int, f: np.ndarray) -> DataFrame:
    """word, n, class: each word of cells (word, n, cells) is moved from the class of its ending to that of the highest likelihood, by the
    exchange of its group of about GROUP words, dealt by a hash of the word.

    Rows without a word tell how a group's moves change the class bigrams: n is added at class and k (as in cells).
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("word").combine_chunks()
        words, lists = table.column("word").to_pylist(), table.column("cells").combine_chunks()
        values = lists.flatten().to_numpy()
        row = np.repeat(np.arange(len(words)), np.diff(lists.offsets.to_numpy()))
        counts = np.bincount(row * WIDTH + values % WIDTH, weights=values // WIDTH, minlength=len(words) * WIDTH).reshape(-1, WIDTH)
        old = classes[[first_ending + ending(w.encode()) for w in words]]
        moved = exchange(np.arange(len(words)), counts[:, :CLASSES], counts[:, CLASSES:], np.zeros(len(words)), old, f)
        change = np.zeros((CLASSES, WIDTH))
        np.add.at(change, moved, counts)
        np.subtract.at(change, old, counts)
        c, k = np.nonzero(change)
        return pa.table({
            "word": pa.array(words + [None] * len(c), pa.string()), "n": pa.array(np.concatenate((table.column("n").to_numpy(), change[c, k].astype(np.int64)))),
            "class": pa.array(np.concatenate((moved, c)).astype(np.int32)), "k": pa.array(np.concatenate((np.full(len(words), -1), k)).astype(np.int32)),
        })

    groups = max(1, -(-n_words // GROUP))
    dealt = cells.withColumn("g", F.pmod(F.xxhash64("word"), F.lit(groups)))
    return dealt.groupBy("g").applyInArrow(run, "word string, n bigint, class int, k int")


def moved_pairs(changes: DataFrame, f: np.ndarray) -> np.ndarray:
    """Class bigram counts after the words' moves, from at most 2 * CLASSES ** 2 sums. A pair of two moved words goes half each way."""
    out = f.copy()
    for r in changes.groupBy("class", "k").agg(F.sum("n").alias("n")).collect():
        at = (r["class"], r["k"]) if r["k"] < CLASSES else (r["k"] - CLASSES, r["class"])
        out[at] += r["n"]
    return np.maximum(out, 0)


@dataclass(frozen=True)
class Model:
    vocabulary: Vocabulary
    #: Of the words with classes of their own, then of the endings, then of the end of the text.
    classes: np.ndarray
    #: log10 of P(class | class before), P(unit | class), P(word | its ending) and P(no known word | ending)
    step: np.ndarray
    emit: np.ndarray
    within: np.ndarray
    unseen: np.ndarray
    #: Counts by class, each unit with half a count more.
    in_class: np.ndarray


def probabilities(v: Vocabulary, classes: np.ndarray, f: np.ndarray, more: np.ndarray | float = 0.0) -> Model:
    """Smoothed so that each distribution sums to one.

    Transitions are mixed with the class frequencies (Witten-Bell); units get half a count more; words that weren't seen share what the
    words seen once leave to them (Good-Turing) within their ending. more is what words that aren't known add to the classes.
    """
    single = v.n_single
    held = np.concatenate((v.counts[:single], v.ending_tokens, [v.n_ends])) + 0.5
    in_class = np.bincount(classes, weights=held, minlength=CLASSES) + more
    share = in_class / in_class.sum()
    rows, kinds = f.sum(1, keepdims=True), np.maximum((f > 0).sum(1, keepdims=True), 1)
    step = (f + kinds * share[None, :]) / (rows + kinds)
    unseen = np.clip((v.ending_once + 0.5) / (v.ending_tokens + 1), 1e-9, 0.5)
    unseen[v.ending_tokens == 0] = 1.0
    at = np.array([ending(w) for w in v.words[single:]], np.int64)
    within = np.concatenate((np.zeros(single), np.log10(v.counts[single:] * (1 - unseen[at]) / np.maximum(v.ending_tokens[at], 1))))
    with np.errstate(divide="ignore"):
        return Model(v, classes, np.log10(step), np.log10(held / in_class[classes]), within, np.log10(unseen), in_class)


def train(docs: DataFrame) -> tuple[Model, DataFrame, DataFrame]:
    """The model of all texts, the counts of all words (word, n), and the classes that words chose (word, n, class).

    First the exchange of the most frequent words, and of all others by their endings, makes the classes. Then every further word counted
    LEAST times or more chooses its class by its own neighbours. The classes of at most KNOWN words come to the driver.
    """
    counts = stash(count_words(docs), "word-counts")
    v = vocabulary(counts, docs.count())
    coarse = replace(v, n_single=min(WORDS, v.n_single))
    pairs = stash(count_pairs(docs, coarse), "unit-pairs")
    classes, f = cluster(pairs, coarse)
    often = counts.where(F.col("n") >= LEAST).withColumnRenamed("word", "w")
    cells = stash(count_neighbours(docs, v, coarse, classes).join(often, F.col("word") == F.col("w")).drop("w"), "word-neighbours")
    chosen = stash(choose_classes(cells, cells.count(), classes, coarse.n_single, f), "word-classes")
    f = moved_pairs(chosen.where("word is null"), f)
    chosen = chosen.where("word is not null").drop("k")
    at = {w: i for i, w in enumerate(v.words)}
    final = np.concatenate((classes[: coarse.n_single], np.zeros(v.n_single - coarse.n_single, np.int64), classes[coarse.n_single :]))
    for r in chosen.where(F.col("n") >= v.cut).select("word", "class").toLocalIterator():
        final[at[r["word"].encode()]] = r["class"]
    more = np.zeros(CLASSES)
    for r in chosen.where(F.col("n") < v.cut).groupBy("class").agg(F.sum(F.col("n") + 0.5).alias("n")).collect():
        more[r["class"]] = r["n"]
    return probabilities(v, final, f, more), counts, chosen


def score_documents(docs: DataFrame, fold: int = 2, folds: int = 7) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    Learns from the rows whose crc32 of the id, mod 7, isn't 2 (null ids included). Words are lower-cased (A-Z), each text ends with an
    end token; null text has only that. base_score is the add-one unigram log10 probability. score is that of a class bigram model: the
    class of a token depends on the class before, the word on its class. Words are counted over all training rows; those counted LEAST
    times or more each have a class of their own, however many they are, the others that of their ending, so that every word has a
    class. Counts and classes of the KNOWN most frequent words are with every worker (a bounded table, which changes no result); those
    of rarer words are joined to the documents' rare words. The unseen words of a class share one probability, that of any unseen word
    of it: score is that of the text with its unknown words folded into one a class, where base_score charges each as a word of its own.

    Without training rows all words are unknown and the probabilities of classes even. Repeated rows are scored each. Extra columns are
    left out.
    """
    docs = docs.select("doc_id", "text", F.coalesce(crc_of_id(F.col("doc_id")) % folds == fold, F.lit(False)).alias("held_out"))
    return _scored(docs, *train(docs.where("not held_out")))


def _scored(docs: DataFrame, model: Model, counts: DataFrame, chosen: DataFrame) -> DataFrame:
    spark, v = docs.sparkSession, model.vocabulary
    shared = spark.sparkContext.broadcast(model)
    norm = v.n_tokens + v.n_types + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        reader, single = Reader(m.vocabulary), m.vocabulary.n_single
        base = np.log10(np.concatenate((m.vocabulary.counts, [m.vocabulary.n_ends, 0])) + 1.0) - np.log10(norm)
        known_end = int(m.vocabulary.n_ends > 0)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for first, texts in by_size(batch):
                t = reader.read(texts)
                index, unit, sizes = t.index, t.unit, t.sizes
                begin = np.cumsum(sizes) - sizes
                total = lambda x: np.add.reduceat(x, begin)  # noqa: B023, E731
                cls = m.classes[unit]
                seen, end = index >= 0, index == -2
                # Words that may have a class of their own: what depends on it is left to the join.
                own = reader.own_class(t.rare)
                middle = np.zeros(len(index), bool)
                middle[t.where] = own
                after_middle = np.concatenate(([False], middle[:-1]))
                tail = seen & (index >= single)
                before = np.concatenate(([CLASSES - 1], cls[:-1]))
                gained = np.where(middle | after_middle, 0.0, m.step[before, cls]) + np.where(middle, 0.0, m.emit[unit])
                gained[tail] += m.within[index[tail]]
                simple = np.where(seen, base[np.maximum(index, 0)], np.where(end, base[-2], 0.0))
                n, rows = len(texts), row + np.arange(len(texts))
                row += n
                known = total(seen.astype(np.int64)) + known_end
                ids, out = batch.column("doc_id").slice(first, n), batch.column("held_out").slice(first, n)
                none = lambda kind, k=n: pa.nulls(k, kind)
                yield pa.RecordBatch.from_arrays([
                    pa.array(rows), ids, out, pa.array(sizes.astype(np.int64)), pa.array(known), pa.array(total(simple)), pa.array(total(gained)),
                    none(pa.string()), none(pa.int64()), none(pa.int32()), none(pa.string()), none(pa.int32()), none(pa.int32()),
                ], NAMES)
                docs_of, places = t.text.tolist(), t.where.tolist()
                some = [Counter([(d, w) for d, w, o in zip(docs_of, t.rare, own.tolist(), strict=True) if not o])]
                if own.any():  # the class before, or the word that it is joined by; the class after, unless that is left to its word
                    of_place = {place: w for place, w, o in zip(places, t.rare, own.tolist(), strict=True) if o}
                    some.append(Counter([
                        (d, of_place[p], of_place.get(p - 1), int(before[p]), None if p + 1 in of_place else int(cls[p + 1])) for d, p in zip(docs_of, places, strict=True) if p in of_place
                    ]))
                for times in filter(None, some):
                    of, found, *beside = zip(*times, strict=True)
                    k = len(found)
                    lefts, before_it, after_it = beside or (none(pa.binary(), k), none(pa.int32(), k), none(pa.int32(), k))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(rows[list(of)]), pa.nulls(k, ids.type), pa.nulls(k, pa.bool_()), *(pa.nulls(k, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())),
                        pa.array(found, pa.binary()).cast(pa.string()), pa.array(list(times.values()), pa.int64()), pa.array([ending(w) for w in found], pa.int32()),
                        pa.array(lefts, pa.binary()).cast(pa.string()), pa.array(before_it, pa.int32()), pa.array(after_it, pa.int32()),
                    ], NAMES)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.mapInArrow(run, f"row bigint, doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, word string, times bigint, e int, left_word string, before int, after int")
    rows = stash(rows, "token-scores")

    # Tables of ENDINGS, CLASSES ** 2 and CLASSES rows.
    ends = spark.createDataFrame([
        (i, float(np.log10((1 - 10**u) / max(n, 1))) if u < 0 else 0.0, float(u), int(model.classes[v.n_single + i]), float(model.emit[v.n_single + i]))
        for i, (u, n) in enumerate(zip(model.unseen, v.ending_tokens, strict=True))
    ], "e2 int, seen_part double, unseen_part double, e_class int, e_emit double")
    steps = spark.createDataFrame([(i * CLASSES + j, float(model.step[i, j])) for i in range(CLASSES) for j in range(CLASSES)], "pair int, step double")
    sizes = spark.createDataFrame([(i, float(n)) for i, n in enumerate(model.in_class)], "c int, held double")
    own = chosen.where(F.col("n") < v.cut).join(F.broadcast(sizes), F.col("class") == F.col("c")).select("word", "class", F.log10((F.col("n") + 0.5) / F.col("held")).alias("own_emit"))
    rare_counts = counts.where(F.col("n") < v.cut).select(F.col("word").alias("w"), "n").join(own.withColumnRenamed("word", "w4"), F.col("w") == F.col("w4"), "left").drop("w4")
    rare = rows.where("word is not null").select("row", "word", "times", "e", "left_word", "before", "after")
    # A word before that has a class of its own; the class of its ending is there already.
    alone = rare.where("left_word is null").drop("left_word")
    after_own = rare.where("left_word is not null").join(own.select(F.col("word").alias("w5"), F.col("class").alias("c5")), F.col("left_word") == F.col("w5"), "left")
    rare = alone.unionByName(after_own.withColumn("before", F.coalesce("c5", "before")).drop("left_word", "w5", "c5"))
    joined = rare.join(rare_counts, F.col("word") == F.col("w"), "left").join(F.broadcast(ends), F.col("e") == F.col("e2"))
    n = F.coalesce("n", F.lit(0))
    cls = F.coalesce("class", "e_class")
    for name, pair in (("in", F.col("before") * CLASSES + cls), ("on", cls * CLASSES + F.col("after"))):
        joined = joined.join(F.broadcast(steps.select(F.col("pair").alias(f"{name}_pair"), F.col("step").alias(name))), pair == F.col(f"{name}_pair"), "left")
    zero = F.lit(0.0)
    of_ending = F.when(n > 0, F.log10(n) + F.col("seen_part")).otherwise(F.col("unseen_part"))
    # Without a class before the word wasn't left to the join: only its part of the ending is missing.
    gained = F.when(F.col("before").isNull(), of_ending).otherwise(F.coalesce("own_emit", F.col("e_emit") + of_ending) + F.coalesce("in", zero) + F.coalesce("on", zero))
    extra = joined.groupBy(F.col("row").alias("r")).agg(
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("k"), F.sum(F.col("times") * F.log10(n + 1)).alias("b"), F.sum("times").alias("t"), F.sum(F.col("times") * gained).alias("s"),
    )
    final = rows.where("word is null").join(extra, F.col("row") == F.col("r"), "left")
    base = F.col("base") + F.coalesce("b", zero) - F.coalesce("t", F.lit(0)) * F.log10(F.lit(float(norm)))
    return final.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(v.n_tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"), (F.col("score") + F.coalesce("s", zero)).alias("score"),
    )


NAMES = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "word", "times", "e", "left_word", "before", "after"]
