"""Packing of documents into fixed-length sequences by first-fit decreasing."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import stash

END = 0
#: Distinct pre-tokens remembered by a worker: the first ones, among which the frequent ones are.
REMEMBERED = 600_000
#: Bytes of ids in one Arrow batch.
BATCH = 4 << 20
#: Bins of a group are numbered below this.
BINS = 1 << 20


#: Letters, numbers and white space below U+02B0, where Python's own expressions can tell them apart as the vocabulary's pattern does.
LETTERS, NUMBERS, SPACES = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u02af", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
LATIN = f" ?[{LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"


class Encoder(dict):
    """Ids of a byte-level BPE vocabulary file, as little-endian unsigned 32-bit numbers; a dict of the pre-tokens seen so far.

    The text is cut at the vocabulary's added tokens (such as <|endoftext|>), which keep their own ids. What lies between them is split
    into pre-tokens and each distinct one is encoded once by the tokenizers library; the ids are those of encoding the whole text.
    """

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
        self.model = whole.model
        added = whole.get_added_tokens_decoder()
        if any(t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError("added tokens that take blanks or whole words only are not supported")
        self.added = {t.content: struct.pack("<I", i) for i, t in added.items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(map(re.escape, longest_first))})").split if self.added else None
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.split_latin = re.compile(LATIN).findall
        self.beyond_latin = re.compile(r"[^\x00-\u02af]").search
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        self.letters = {b: b for b in printable} | {b: 256 + k for k, b in enumerate(others)}

    def __missing__(self, piece: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(piece.encode("utf-8", "replace").decode("latin-1").translate(self.letters))]
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < REMEMBERED:
            self[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        parts = self.cut(text) if self.cut else [text]
        return b"".join([self.added[p] if k % 2 else self.encode_plain(p) for k, p in enumerate(parts)])

    def encode_plain(self, text: str) -> bytes:
        pieces = self.split(text) if self.beyond_latin(text) else self.split_latin(text)
        return b"".join([self[p] for p in pieces])


_encoders: dict[str | None, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    """One encoder a worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut_documents(docs: DataFrame, capacity: int = 1024, vocabulary: str | None = None) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens: the token ids of every document with the end id, cut into pieces of at most `capacity`.

    ids is binary, four little-endian bytes an id. All pieces but a document's last one are full. Null text counts as empty and gives
    the end id alone. Repeated rows give repeated pieces. Extra columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        end = np.array([END], "<u4").tobytes()
        step = 4 * capacity
        for batch in batches:
            rows: list[tuple[int, int, int, bytes, int]] = []
            held = 0

            def flush(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                at, start, length, ids, total = zip(*rows, strict=True)
                return pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(at)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64())],
                    ["doc_id", "start", "length", "ids", "doc_tokens"],
                )

            for i, text in enumerate(batch.column("text")):
                ids = own.encode(text.as_py() or "") + end
                for at in range(0, len(ids), step):
                    piece = ids[at : at + step]
                    rows.append((i, at // 4, len(piece) // 4, piece, len(ids) // 4))
                    held += len(piece)
                    if held >= BATCH:
                        yield flush()
                        rows, held = [], 0
            if rows:
                yield flush()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint")


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item: longest first, each into the first bin with room.

    A tournament tree over the bins holds in each node the most room below it, so that the first bin that fits is found, and its room
    updated, in as many steps as the tree is high.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    full = int((lengths == capacity).sum())
    bins[order[:full]] = np.arange(full)
    offsets[order[:full]] = 0
    rest = order[full:]
    leaves = 1 << max(0, (len(rest) - 1).bit_length())
    room = [capacity] * (2 * leaves)
    for item, need in zip(rest.tolist(), lengths[rest].tolist(), strict=True):
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < need:
                node += 1
        bins[item] = full + node - leaves
        offsets[item] = capacity - room[node]
        room[node] -= need
        while node > 1:
            node //= 2
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = 1024, group_size: int = 8192, seed: int = 5) -> DataFrame:
    """Adds sequence_id and offset to pieces (column length, 1 to capacity): places in sequences of at most `capacity`.

    The pieces are dealt at random into groups of about group_size, whatever document they come from, and each group is packed by first
    fit decreasing on its own, so tasks are of even size and a document in very many pieces, or very many equal rows, fill no group.
    Sequences are numbered by group and bin; within a sequence the pieces lie without gaps from 0. Pieces of null or impossible length
    fail. The other columns stay, whatever their names; columns named sequence_id or offset are replaced.
    """
    if group_size * 8 > BINS:
        raise ValueError(f"groups are of at most {BINS // 8} pieces")
    pieces = pieces.drop("sequence_id", "offset")
    keep = [c for c in pieces.columns]
    piece, into = "_piece", "_group"
    while {piece, into} & {c.lower() for c in keep}:  # names that no column has
        piece, into = f"_{piece}", f"_{into}"
    numbered = stash(pieces.withColumn(piece, F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-numbered.count() // group_size))
    dealt = numbered.withColumn(into, F.pmod(F.xxhash64(F.lit(seed).cast("long"), piece), F.lit(groups)))

    def run(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        if len(lengths) and (lengths.min() < 1 or lengths.max() > capacity):
            raise ValueError("a piece has an impossible length")
        order = np.argsort(table.column(piece).to_numpy(), kind="stable")
        bins, offsets = np.empty_like(lengths), np.empty_like(lengths)
        bins[order], offsets[order] = first_fit_decreasing(lengths[order], capacity)
        group = table.column(into).to_numpy()
        return pa.table({piece: table.column(piece), "sequence_id": pa.array(group * BINS + bins), "offset": pa.array(offsets)})

    slim = dealt.select(piece, into, F.col("length").cast("long").alias("length"))
    if len(keep) > 8 or "ids" in keep:  # wide pieces stay where they are; only places travel
        placed = slim.groupBy(into).applyInArrow(run, f"{piece} bigint, sequence_id bigint, offset bigint")
        return numbered.join(placed, piece).drop(piece)

    def whole(table: pa.Table) -> pa.Table:
        places = run(table)
        return table.select(keep).append_column("sequence_id", places.column("sequence_id")).append_column("offset", places.column("offset"))

    from pyspark.sql.types import LongType, StructType

    schema = StructType(pieces.schema.fields).add("sequence_id", LongType()).add("offset", LongType())
    return dealt.groupBy(into).applyInArrow(whole, schema)


def sequences(packed: DataFrame, capacity: int = 1024) -> DataFrame:
    """sequence_id, ids, used: the packed sequences themselves, padded with the end id unless their length is a power of two.

    packed has ids (binary), length, sequence_id and offset. A sequence holds at most `capacity` pieces.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "length")))
    made = packed.groupBy("sequence_id").agg(parts.alias("_p")).select(
        "sequence_id", F.aggregate("_p", F.lit(""), lambda s, x: F.concat(s, F.hex(x["ids"]))).alias("_hex"), F.aggregate("_p", F.lit(0).cast("long"), lambda s, x: s + x["length"]).alias("used")
    )
    even = F.bit_count("used") == 1
    return made.select("sequence_id", F.unhex(F.when(even, F.col("_hex")).otherwise(F.rpad("_hex", capacity * 8, "0"))).alias("ids"), "used")
