"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import join_counted, small, stash
from tidemark.operators.components import components

SEED = 42
#: Words of 64 bits in a long fingerprint, at least.
LONG_WORDS = 4
#: Share of the pairs of just the similarity asked for that are to meet in some band. With 0.87 at 0.8 it is about 0.92 at 0.825, 0.96
#: at 0.85 and 0.99 at 0.9.
MEET = 0.87
#: Buckets of at most so many fingerprints are compared as one row each; larger ones in cells of two sides of about SIDE rows each.
FEW = 32
SIDE = 2048
#: Tables of at most this many short rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 500_000
#: The same for numbers alone.
MET_ROWS = 2_000_000
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each run of `size` words, A-Z lower-cased, joined by spaces; fewer words make one shingle, none make no shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[size - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint: bit i is 1 if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        block = np.ascontiguousarray(hashes[k : k + (1 << 16)])
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((majority(shingle_hashes(t.as_py(), size)) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


def ball(radius: int) -> list[int]:
    """All masks of at most so many bits, as signed 64-bit numbers."""
    masks = [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(64), n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """Edges (a, b) that connect the same distinct fingerprints as all pairs at most `distance` bits apart (an even number).

    Every fingerprint emits all variants within half the distance; two fingerprints are within the distance exactly if they share a
    variant. Those that share one are pairwise within the distance, so each is tied to the smallest of its bucket only: a bucket of n
    gives n - 1 edges, and no link between groups is lost. A bucket holds no more distinct fingerprints than the ball has masks.
    Colliding pairs are verified by their Hamming distance.
    """
    if distance % 2:
        raise ValueError("meet in the middle needs an even distance")
    masks = F.array(*[F.lit(m).cast("long") for m in ball(distance // 2)])
    # Dealt out anew, by an expression that no earlier exchange has dealt by: a few tasks would else make all variants, as fingerprints
    # take little room before they are multiplied.
    dealt = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))
    spread = dealt.select("fp", F.explode(masks).alias("_m")).select("fp", F.col("fp").bitwiseXOR(F.col("_m")).alias("variant"))
    met = spread.groupBy("variant").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    pairs = met.select("a", F.explode("all").alias("b")).where("a <> b")
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).distinct()


def near_groups(docs: DataFrame, size: int = 3, distance: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs.

    component_id is the smallest doc_id that can be reached over links between fingerprints at most `distance` bits apart. Documents of
    equal fingerprints are one node, so copies are never expanded into pairs. Null and blank texts have fingerprint zero and are linked
    like any other. Null ids are never the smallest unless a component has no other. Repeated rows come out as often as they went in.
    Extra columns are left out.
    """
    of = stash(fingerprints(docs, size), "fingerprints")
    firsts = of.groupBy("fp").agg(F.min("doc_id").alias("_first"))
    groups = components(links(of.select("fp").distinct(), distance))
    roots = firsts.join(groups, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("_root"), "_first")
    # Per fingerprint, not per document: a component's smallest id, brought back to its fingerprints.
    lowest = roots.groupBy(F.col("_root").alias("_r")).agg(F.min("_first").alias("component_id"))
    per_fp = stash(roots.join(lowest, F.col("_root") == F.col("_r")).select(F.col("fp").alias("_fp"), "component_id"), "components")
    return of.join(per_fp, F.col("fp") == F.col("_fp")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def scrambled(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th set of hashes made from the same shingles' hashes."""
    x = hashes + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def angle(similarity: float) -> float:
    """The chance that a bit differs between two sets of shingles of this Jaccard similarity.

    It is the angle between the sets' vectors as a part of a half turn; the cosine of sets of equal size is 2 s / (1 + s), that of other
    sets is higher.
    """
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


@dataclass(frozen=True)
class Bands:
    """A long fingerprint is cut into `count` bands of `bits` bits; of each, all variants within one bit are emitted."""

    bits: int
    count: int

    @property
    def words(self) -> int:
        return max(LONG_WORDS, -(-self.bits * self.count // 64))

    @classmethod
    def of(cls, rows: int, similarity: float, meet: float = MEET) -> Bands:
        """Bands so long that few unlike fingerprints among so many rows meet (one variant in forty or so has a chance partner), and so
        many that of the pairs of this similarity the share `meet` has a band that differs in at most two bits.
        """
        bits, p = max(16, math.ceil(math.log2(rows + 1)) + 10), angle(similarity)
        one = sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(3))
        return cls(bits, max(1, math.ceil(math.log(1 - meet) / math.log(1 - one))))

    def part(self, band: int) -> Column:
        """The bits of one band of column fp, which may reach over two words."""
        word, shift = divmod(band * self.bits, 64)
        low = F.shiftrightunsigned(F.get("fp", word), shift)
        if shift + self.bits > 64:
            low = low.bitwiseOR(F.shiftleft(F.get("fp", word + 1), 64 - shift))
        return low.bitwiseAND(F.lit((1 << self.bits) - 1))

    def exact(self) -> Column:
        """The bands themselves."""
        return F.array(*[self._own(k) for k in range(self.count)])

    def variants(self) -> Column:
        """The bands and all that differ from them in one bit."""
        masks = F.array(*[F.lit(m).cast("long") for m in [0, *(1 << b for b in range(self.bits))]])
        return F.flatten(F.array(*[self._of_band(k, masks) for k in range(self.count)]))

    def _own(self, band: int) -> Column:
        return self.part(band).bitwiseOR(F.lit(band << self.bits))

    def _of_band(self, band: int, masks: Column) -> Column:
        return F.transform(masks, lambda m: self._own(band).bitwiseXOR(m))


def long_fingerprints(docs: DataFrame, size: int = 5, words: int = LONG_WORDS) -> DataFrame:
    """doc_id, mark, id, fp (so many longs in an array) for every row of docs with its mark. Each distinct shingle counts once, and id
    is a hash of the set of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, ids = np.zeros((batch.num_rows, words), np.uint64), np.zeros(batch.num_rows, np.uint64)
            for i, text in enumerate(batch.column("text")):
                hashes = np.unique(shingle_hashes(text.as_py(), size))
                fps[i] = [majority(scrambled(hashes, k)) for k in range(words)]
                ids[i] = xxhash.xxh64_intdigest(hashes.tobytes(), SEED)
            flat = pa.array(fps.view(np.int64).ravel())
            offsets = pa.array(np.arange(0, len(flat) + 1, words, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(ids.view(np.int64)), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "mark", "id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "mark").mapInArrow(run, f"doc_id {kind}, mark bigint, id bigint, fp array<bigint>")


def shingle_sets(docs: DataFrame, size: int = 5) -> DataFrame:
    """id, n, shingles (32 bits of each distinct hash) for rows of id, n and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingle_hashes(text.as_py(), size).astype(np.uint32)).view(np.int32) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), pa.array(found, pa.list_(pa.int32()))], ["id", "n", "shingles"])

    return docs.select("id", "n", "text").mapInArrow(run, "id bigint, n bigint, shingles array<int>")


def most_bits(similarity: float, words: int = LONG_WORDS) -> int:
    """Differing bits up to which a pair of this similarity is looked at: three deviations above what is expected."""
    n, p = 64 * words, angle(similarity)
    return math.floor(n * p + 3 * math.sqrt(n * p * (1 - p)))


def _distance(a: str, b: str, words: int) -> Column:
    parts = [F.bit_count(F.get(a, k).bitwiseXOR(F.get(b, k))) for k in range(words)]
    return sum(parts[1:], parts[0])


def _near(ids: np.ndarray, roots: np.ndarray, fp: np.ndarray, own: np.ndarray, others: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a, b, bits between them: for each row of own and each other group among others the nearest row, at most `limit` bits apart."""
    a, b, d = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)]
    for k in range(0, len(own), 256):
        some = own[k : k + 256]
        apart = sum(np.bitwise_count(fp[some, None, w] ^ fp[None, others, w]).astype(np.int16) for w in range(fp.shape[1]))
        i, j = np.nonzero((apart <= limit) & (roots[some, None] != roots[None, others]))
        order = np.argsort(apart[i, j], kind="stable")
        i, j = some[i[order]], others[j[order]]
        once = np.unique(np.stack((i, roots[j]), 1), axis=0, return_index=True)[1]
        a.append(ids[i[once]])
        b.append(ids[j[once]])
        d.append(np.bitwise_count(fp[i[once]] ^ fp[j[once]]).sum(1, dtype=np.int32))
    a, b = np.concatenate(a), np.concatenate(b)
    return np.minimum(a, b), np.maximum(a, b), np.concatenate(d)


def _numbers(table: pa.Table | pa.RecordBatch, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, roots and fingerprints of the rows of a cell or of the members of buckets."""
    ids, roots = (table.column(c).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(c).to_numpy() for c in ("id", "root"))
    flat = table.column("fp").combine_chunks() if isinstance(table, pa.Table) else table.column("fp")
    return ids, roots, flat.flatten().to_numpy().view(np.uint64).reshape(-1, words)


def _strays(roots: np.ndarray) -> np.ndarray:
    """Which members of a bucket are outside its largest group; of groups of one size, the one of the highest root is taken for it."""
    groups, counts = np.unique(roots, return_counts=True)
    return roots != groups[len(groups) - 1 - np.argmax(counts[::-1])]


def _in_cells(limit: int, words: int):
    """Pairs between the two sides of a cell, for applyInArrow."""

    def run(table: pa.Table) -> pa.Table:
        ids, roots, fp = _numbers(table, words)
        stray = table.column("stray").to_numpy()
        return pa.table(dict(zip(("a", "b", "d"), map(pa.array, _near(ids, roots, fp, np.flatnonzero(stray), np.flatnonzero(~stray), limit)), strict=True)))

    return run


def _in_buckets(buckets: DataFrame, limit: int, words: int) -> DataFrame:
    """Pairs inside buckets (column members, at most FEW): strays with members of other groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column("members")
            ids, roots, fp = _numbers(pa.RecordBatch.from_struct_array(members.flatten()), words)
            ends = np.cumsum([len(x) for x in members]).tolist()
            found = [_near(ids, roots, fp, a + np.flatnonzero(_strays(roots[a:b])), np.arange(a, b), limit) for a, b in zip([0, *ends], ends, strict=False)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["a", "b", "d"])

    return buckets.select("members").mapInArrow(run, "a bigint, b bigint, d int")


def _cross_links(met: DataFrame, fps: DataFrame, edges: DataFrame, limit: int, words: int) -> DataFrame:
    """Pairs (a, b, d: bits between them) of members (columns id, variant, n: members of the bucket, FEW + 1 standing for more) of one
    bucket that the edges so far leave in different groups.

    Members of one group are connected already, and the two of a bucket of two have been compared. In each bucket those outside its largest group are compared with all that are in
    another group than they, so that afterwards every two members are connected, paired, or known to be too far apart. A bucket that is
    one group, as most families of near copies are, is dropped once its groups are known, and buckets of the same members are looked at
    once. A bucket of at most FEW members is gathered as one row; the members of larger ones stay rows.
    """
    groups = components(edges)
    grouped = stash(fps.join(groups, F.col("id") == F.col("node"), "left").select(F.col("id").alias("i2"), F.coalesce("root", "id").alias("root"), "fp"), "grouped-fingerprints")
    marks = [F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "id")).alias("y")]

    few = met.where((F.col("n") > 2) & (F.col("n") <= FEW)).join(grouped, F.col("id") == F.col("i2"))
    few = few.groupBy("variant").agg(F.array_sort(F.collect_list(F.struct("id", "root", "fp"))).alias("members"), F.min("root").alias("low"), F.max("root").alias("high"), *marks)
    near = _in_buckets(few.where("low <> high").dropDuplicates(["x", "y"]), limit, words)

    rows = stash(met.where(F.col("n") > FEW).join(grouped, F.col("id") == F.col("i2")).select("variant", "id", "root"), "grouped-rows")
    held = rows.groupBy("variant", "root").agg(F.count(F.lit(1)).alias("n"), *marks)
    buckets = held.groupBy("variant").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("most"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).where("n > most.n")
    once = buckets.groupBy("n", "x", "y").agg(F.min(F.struct("variant", "most")).alias("o")).select(F.col("o.variant").alias("v"), "n", F.col("o.most.n").alias("n_most"), F.col("o.most.root").alias("most"))
    rows = rows.join(once, F.col("variant") == F.col("v")).drop("v").join(grouped.select("i2", "fp"), F.col("id") == F.col("i2")).drop("i2")
    many = stash(rows.withColumn("outside", F.col("root") != F.col("most")), "open-rows")
    sides = F.ceil(F.col("n") / SIDE).cast("int"), F.ceil((F.col("n") - F.col("n_most")) / SIDE).cast("int")
    at = [F.pmod(F.xxhash64(F.lit(3), "id"), k).cast("int") for k in sides]
    upto = [F.explode(F.sequence(F.lit(0), k - 1)) for k in sides]
    cells = many.select("variant", "id", "root", "fp", F.lit(False).alias("stray"), at[0].alias("i"), upto[1].alias("j"))
    cells = cells.unionByName(many.where("outside").select("variant", "id", "root", "fp", F.lit(True).alias("stray"), upto[0].alias("i"), at[1].alias("j")))
    return near.unionByName(cells.groupBy("variant", "i", "j").applyInArrow(_in_cells(limit, words), "a bigint, b bigint, d int")).distinct()


def similar_links(fps: DataFrame, similarity: float = 0.8, bands: Bands | None = None, verify: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Edges (a, b) that connect the ids of distinct long fingerprints (columns id, fp) as all similar pairs that meet would.

    Meet in the middle by bands: of each band a fingerprint emits all variants within one bit, so that two meet if some band differs in
    at most two bits; pairs that meet are verified by the distance of the whole fingerprints, and then by `verify`, which keeps the rows
    (a, b) of truly similar texts.

    Families of near copies share most of their variants, so they are tied together first: fingerprints that share a whole band are
    compared with the smallest that has it. Then variants are counted, with the least and the greatest group among those that have
    them; a variant that a single group has can tell nothing new and goes, without a join. In a bucket of several groups each member is
    compared with the smallest one first; those that are in different groups after that are compared with each other (_cross_links).
    Members of one group are never compared again, and no bucket is expanded into its pairs.
    """
    spark = fps.sparkSession
    bands = bands or Bands.of(fps.count(), similarity)
    words, verify = bands.words, verify or (lambda pairs: pairs)
    limit = most_bits(similarity, words)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def close(pairs: DataFrame) -> DataFrame:
        sides = pairs.join(fps.select(F.col("id").alias("a"), F.col("fp").alias("fa")), "a").join(fps.select(F.col("id").alias("b"), F.col("fp").alias("fb")), "b")
        return sides.select("a", "b", _distance("fa", "fb", words).alias("d")).where(F.col("d") <= limit)

    whole = fps.select("id", F.explode(bands.exact()).alias("variant"))
    held = whole.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("a")).where("n > 1").select(F.col("variant").alias("v"), "a")
    family = whole.join(small(stash(held, "met-bands"), MET_ROWS), F.col("variant") == F.col("v")).where("id <> a").select("a", F.col("id").alias("b")).distinct()
    tied = _linked(close(family), verify)

    groups = small(stash(components(tied), "band-groups"), MET_ROWS)
    rooted = fps.join(groups, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("root"), "fp")
    rooted = stash(rooted, "rooted-fingerprints").repartition(parts, F.xxhash64("id"))
    spread = rooted.select("id", "root", F.explode(bands.variants()).alias("variant"))
    # A fingerprint has each of its variants once, so what is counted are fingerprints.
    met = spread.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    met = small(stash(met.select(F.col("variant").alias("v"), F.least("n", F.lit(FEW + 1)).cast("int").alias("n")), "met-variants"), MET_ROWS)
    rows = stash(spread.join(met, F.col("variant") == F.col("v")).select("id", "root", "variant", "n"), "met-rows")
    lead = rows.groupBy(F.col("variant").alias("v")).agg(F.min(F.struct("id", "root")).alias("a"))
    pairs = rows.join(lead, F.col("variant") == F.col("v")).where(F.col("root") != F.col("a.root")).select("a.id", F.col("id").alias("b")).toDF("a", "b").distinct()
    edges = tied.unionByName(_linked(close(pairs), verify))
    return edges.unionByName(_linked(_cross_links(rows.drop("root"), fps, edges, limit, words), verify))


def _linked(pairs: DataFrame, verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Edges (a, b) that connect what all verified pairs (a, b, d) would: each b is tried with its nearest a first, and further pairs
    only where that leaves the two in different groups. In a family of near copies that is one pair a member."""
    pairs = stash(pairs, "near-pairs")
    nearest = pairs.groupBy("b").agg(F.min(F.struct("d", "a")).alias("_x")).select("_x.a", "b")
    first = stash(verify(nearest), "similar-pairs")
    groups = small(stash(components(first), "pair-groups"), BROADCAST_ROWS)
    tied = pairs.join(groups.select(F.col("node").alias("n1"), F.col("root").alias("r1")), F.col("a") == F.col("n1"), "left")
    tied = tied.join(groups.select(F.col("node").alias("n2"), F.col("root").alias("r2")), F.col("b") == F.col("n2"), "left")
    open_pairs = tied.where(F.coalesce("r1", "a") != F.coalesce("r2", "b")).select("a", "b").join(nearest.select(F.col("a").alias("a3"), F.col("b").alias("b3")), (F.col("a") == F.col("a3")) & (F.col("b") == F.col("b3")), "left_anti")
    return first.unionByName(stash(verify(open_pairs), "similar-pairs"))


def _same_shingles(docs: DataFrame, firsts: DataFrame, size: int, similarity: float) -> Callable[[DataFrame], DataFrame]:
    """A function that keeps of pairs (a, b) those whose texts' sets of shingles have the Jaccard similarity asked for, or more.

    firsts names for each id one row of docs (doc_id, mark). Only texts that stand in a pair are read, and each is hashed once.
    """

    def run(pairs: DataFrame) -> DataFrame:
        pairs = stash(pairs, "likely-pairs")
        times = pairs.groupBy(F.col("a").alias("k")).agg(F.count(F.lit(1)).alias("n"))
        asked = pairs.select(F.col("b").alias("k")).distinct().withColumn("n", F.lit(0).cast("long")).unionByName(times).groupBy("k").agg(F.max("n").alias("n"))
        asked = stash(asked.join(firsts, F.col("k") == F.col("id")).select("id", "n", F.col("doc_id").alias("_id"), F.col("mark").alias("_m")), "asked-texts")
        texts = docs.join(small(asked, BROADCAST_ROWS), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_m")))
        # A text that stands in several equal rows is hashed as often, and taken once.
        sets = stash(shingle_sets(texts, size).dropDuplicates(["id"]), "shingle-sets")
        first = join_counted(pairs, sets.select(F.col("id").alias("ia"), F.col("shingles").alias("sa"), "n"), {"a": "ia"}, "n", pairs.count())
        both = first.join(sets.select(F.col("id").alias("ib"), F.col("shingles").alias("sb")), F.col("b") == F.col("ib"))
        common = F.size(F.array_intersect("sa", "sb"))
        return both.where(common >= F.lit(similarity) * (F.size("sa") + F.size("sb") - common)).select("a", "b")

    return run


def similar_groups(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, component_id for every row of docs: groups of texts linked by a Jaccard similarity of `similarity` or more.

    Similarity is that of the sets of shingles of `size` words, A-Z lower-cased. Links are found by bands of long fingerprints (Bands),
    whose length and number follow the number of rows, and verified by the sets themselves, so that no link is false; of the pairs of
    just this similarity the share MEET is found, of more similar ones more. component_id is the smallest doc_id reached over links. Null
    and blank texts are copies of each other. Null ids are never the smallest unless a component has no other. Repeated rows come out as
    often as they went in. Extra columns are left out.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    bands = Bands.of(docs.count(), similarity)
    of = stash(long_fingerprints(docs, size, bands.words), "long-fingerprints")
    lowest = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark"))
    distinct = stash(of.groupBy("id").agg(F.min("fp").alias("fp"), lowest.alias("_first")), "distinct-fingerprints")
    firsts = distinct.select("id", "_first.doc_id", "_first.mark")
    groups = components(similar_links(distinct.select("id", "fp"), similarity, bands, _same_shingles(docs, firsts, size, similarity)))
    roots = distinct.join(groups, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("_root"), F.col("_first.doc_id").alias("_first"))
    lowest = roots.groupBy(F.col("_root").alias("_r")).agg(F.min("_first").alias("component_id"))
    per_id = stash(roots.join(lowest, F.col("_root") == F.col("_r")).select(F.col("id").alias("_id"), "component_id"), "components")
    return of.join(per_id, F.col("id") == F.col("_id")).select("doc_id", "component_id")


def keep_one(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs whose id is the smallest of its group of similar texts, with their columns. Rows that share that id all stay."""
    groups = similar_groups(docs, size, similarity)
    gone = groups.groupBy(F.col("doc_id").alias("_gone")).agg(F.bool_or(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("_stays")).where("not _stays").drop("_stays")
    gone = small(stash(gone, "near-copies"), MET_ROWS)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"))
    return rows.join(gone, F.col("_id").eqNullSafe(F.col("_gone")), "left_anti").select("_row.*")
