"""Line dedup: documents that share rare lines are aligned and common blocks go from the later one."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import BLANKS, join_counted, n_words, stash


#: So many earlier documents are tried for each common run, unless all are asked for.
ROUNDS = 2
#: Where all are tried, at most so many of a run's holders are tried in one pass, and so many pairs of a run and a holder in one document.
DEPTH = 64
DOCUMENT_PAIRS = 500_000


def longest_rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of pairs (in order of their first numbers) that rises in both numbers, by patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    # Of equal first numbers only one can be used: higher second numbers go first.
    pairs = sorted(pairs, key=lambda p: (p[0], -p[1]))
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tops, y)
        back.append(at[k - 1] if k else -1)
        if k == len(tops):
            tops.append(y)
            at.append(i)
        else:
            tops[k], at[k] = y, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched places of two sequences of lines: patience diff.

    Lines that stand once in either part are put in their longest common order; the parts between them are then treated the same way.
    Equal beginnings and ends of a part are matched first.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {x: j for j, x in enumerate(b[b0:b1], b0) if once_b[x] == 1}
        anchors = longest_rising([(i, place[x]) for i, x in enumerate(a[a0:a1], a0) if once_a[x] == 1 and x in place])
        if not anchors:
            continue
        out += anchors
        for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)], strict=True):
            todo.append((i + 1, k, j + 1, m))
    return sorted(out)


def align_runs(runs: list[dict]) -> tuple[list[tuple[int, int]], list[int]]:
    """The common blocks of a later document with an earlier one (first and last place, in the later), and the numbers of runs left over.

    runs lists the places in the later document where a common run starts and stops, and where it first does in the earlier one. The
    two documents' runs, each in its own order, are aligned by patience diff; aligned runs that touch or overlap make a block. Runs that
    stand in another order than in the earlier document, or more often, are left over.
    """
    order = sorted(range(len(runs)), key=lambda i: (runs[i]["start"], runs[i]["stop"]))
    places = [i for n, i in enumerate(order) if not n or (runs[i]["start"], runs[i]["stop"]) != (runs[order[n - 1]]["start"], runs[order[n - 1]]["stop"])]
    earlier = sorted({(x["place"], x["until"], x["run"]) for x in runs})
    matched = [j for _, j in patience([r for _, _, r in earlier], [runs[i]["run"] for i in places])]
    blocks: list[tuple[int, int]] = []
    for j in sorted(matched):
        start, stop = runs[places[j]]["start"], runs[places[j]]["stop"]
        if blocks and start <= blocks[-1][1] + 1:
            start, stop = blocks[-1][0], max(blocks.pop()[1], stop)
        blocks.append((start, stop))
    return blocks, [i for j, i in enumerate(places) if j not in set(matched)]


def _aligned(pairs: DataFrame, depth: int | None = None) -> DataFrame:
    """later, start, stop, run, again: from rows (later, runs), a pair of documents each, the common blocks in the later document (run is
    null), and the runs that the alignment leaves over. With a depth a row is a later document whose runs have their holders with them."""
    names = ["later", "start", "stop", "run", "again"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for i in range(batch.num_rows):
                runs = batch.column("runs")[i].as_py()
                blocks, left = align_runs(runs) if depth is None else align_holders(runs, depth)
                out += [(*x, None, None) for x in blocks] + [(runs[k]["start"], runs[k]["stop"], runs[k]["run"], runs[k]["again"]) for k in left]
                rows += [i] * (len(blocks) + len(left))
            columns = zip(*out, strict=True) if out else [()] * 4
            kinds = pa.int32(), pa.int32(), pa.int64(), pa.int64()
            yield pa.RecordBatch.from_arrays([batch.column("later").take(pa.array(rows, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names)

    return pairs.select("later", "runs").mapInArrow(run, f"later {pairs.schema['later'].dataType.simpleString()}, start int, stop int, run long, again long")


def align_holders(runs: list[dict], depth: int) -> tuple[list[tuple[int, int]], list[int]]:
    """What align_runs gives for one later document with one earlier document after the other: each run of runs goes to the first of its
    holders (key, place, until), what is left over to the next, and so on. Runs still left after `depth` holders are left over; those that
    have no holder any more aren't."""
    blocks: list[tuple[int, int]] = []
    left = list(range(len(runs)))
    for k in range(depth):
        by_holder: dict[tuple, list[int]] = {}
        for i in left:
            if k < len(runs[i]["holders"]):
                by_holder.setdefault(tuple(runs[i]["holders"][k]["key"].values()), []).append(i)
        left = []
        for mine in by_holder.values():
            found, over = align_runs([runs[i] | {c: runs[i]["holders"][k][c] for c in ("place", "until")} for i in mine])
            blocks += found
            left += [mine[i] for i in over]
    return blocks, left


def _runs(shared: DataFrame, least: int) -> DataFrame:
    """key, start, stop, run, again: shortest runs of neighbouring lines of at least so many words, from each line on and up to each line.

    Any block of so many words that two documents share is covered by such runs that lie inside it, and a run depends on its own lines
    only, so equal blocks have equal runs. run and again are two hashes of a run's lines. Every line has a word, so no run has more than
    `least` lines.
    """
    order = Window.partitionBy("key").orderBy("k")
    out = []
    for side, sign in ((F.lead, 1), (F.lag, -1)):
        steps = [[F.col(c) if n == 0 else side(c, n).over(order) for c in ("k", "h", "g", "words")] for n in range(least)]
        rows = shared.select("key", "k", *[x.alias(f"{c}{n}") for n, step in enumerate(steps) for c, x in zip(("k", "h", "g", "words"), step, strict=True)])
        found = F.lit(None).cast("struct<n:int,run:bigint,again:bigint>")
        for n in reversed(range(least)):
            lines = [*range(n + 1)][::sign]
            whole = (sum((F.col(f"words{i}") for i in range(1, n + 1)), F.col("words0")) >= least) & (F.col(f"k{n}") == F.col("k") + sign * n)
            hashes = [F.xxhash64(F.lit(seed).cast("long"), *[F.col(f"{c}{i}") for i in lines for c in ("h", "g")]) for seed in (1, 2)]
            found = F.when(whole, F.struct(F.lit(n).alias("n"), hashes[0].alias("run"), hashes[1].alias("again"))).otherwise(found)
        runs = rows.select("key", "k", found.alias("r")).where("r is not null" if sign > 0 else "r.n > 0")
        ends = F.col("k"), F.col("k") + sign * F.col("r.n")
        out.append(runs.select("key", F.least(*ends).alias("start"), F.greatest(*ends).alias("stop"), "r.run", "r.again"))
    return out[0].unionByName(out[1])


def dedup_lines(docs: DataFrame, least_words: int = 5, rounds: int | None = ROUNDS) -> DataFrame:
    """doc_id, n_lines, removed (array of line numbers), kept (text) for every row of docs.

    Documents are in order of id (null last), then of a hash of their text. A line is compared without blanks around it; lines without a
    word are no lines here, are never removed and break no block. What documents share is found by hashes: of lines first, then, among
    lines that several documents have, of the shortest runs of neighbouring lines with at least least_words words. Runs are rarer than
    lines, so that frequent short lines bring no pairs. Each run pairs every document that has it with the first one that has it, and the
    two are aligned by patience diff over the runs that pair them. From the later document go the aligned blocks, and nothing else: of
    blocks that stand in another order than in the earlier document only those of one common order go, and of a block that stands
    there once and here twice one. What is left over is then paired with the next document that has it, if that is still an earlier
    one, and aligned with it; so up to `rounds` documents are tried for each run, or with None every earlier one that has it. What no
    alignment matches stays.

    A run is paired again only where it was left over: no group of documents is expanded into its pairs, and none is left out. Only the common
    runs of a pair travel, not the documents. The first document with a block keeps it.

    Rows that agree in id and text are one document: each comes out alike. Null text has no lines and is kept as null. An empty table
    gives an empty result. Extra columns are left out.
    """
    return _deduped(docs, least_words, rounds).select("doc_id", "n_lines", "removed", "kept")


def deduped_documents(docs: DataFrame, least_words: int = 5, rounds: int | None = ROUNDS) -> DataFrame:
    """docs with their columns, the text without the removed lines, and n_chars, where there is one, to match. No row goes."""
    done = _deduped(docs, least_words, rounds)
    new = {"text": F.col("kept")} | ({"n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return done.select(*[(new[c] if c in new else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def _holders(runs: DataFrame) -> DataFrame:
    """r2, a2, n, holder, place, until: of each run the first document that has it, with the run's first place there."""
    homes = runs.groupBy("run", "again").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "start", "stop")).alias("low"), F.max("key").alias("high")).where("low.key < high")
    return homes.select(F.col("run").alias("r2"), F.col("again").alias("a2"), "n", F.col("low.key").alias("holder"), F.col("low.start").alias("place"), F.col("low.stop").alias("until"))


def _next_holders(able: DataFrame, depth: int) -> DataFrame:
    """r2, a2, holders, held, last: of each run the next `depth` documents that have it, in order, with its first place there. Long lists
    are cut in 64 parts first, so that no task sorts all the documents of a frequent run."""
    first = able.groupBy("run", "again", "key").agg(F.min(F.struct("start", "stop")).alias("p"))
    part = F.pmod(F.xxhash64("key"), F.lit(64))
    for by in ([part.alias("_part")], []):
        first = first.select("run", "again", "key", "p", *by).withColumn("_n", F.row_number().over(Window.partitionBy("run", "again", *["_part"] * len(by)).orderBy("key"))).where(F.col("_n") <= depth)
    listed = F.array_sort(F.collect_list(F.struct("key", F.col("p.start").alias("place"), F.col("p.stop").alias("until"))))
    return first.groupBy(F.col("run").alias("r2"), F.col("again").alias("a2")).agg(listed.alias("holders"), F.count(F.lit(1)).alias("held"), F.max("key").alias("last"))


def _rest(asked: DataFrame, able: DataFrame, gone: list[DataFrame], total: int) -> None:
    """Tries all other earlier holders of the runs asked, and appends the blocks that are aligned to gone.

    A pass gives each document its runs that are left with the next holders of each, and one task aligns them one after the other. The fewer
    runs are left, the more holders a pass tries, so that it never has more pairs of a run and a holder than there are runs (or
    one each, if they are many), and never more than DOCUMENT_PAIRS in a document.
    """
    on = {"run": "r2", "again": "a2"}
    while True:
        size = asked.groupBy("key").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
        if not size[0]:
            return
        depth = max(1, min(DEPTH, total // size[0], DOCUMENT_PAIRS // size[1]))
        holders = stash(_next_holders(able, depth), "rest-holders")
        often = asked.groupBy(F.col("run").alias("r3"), F.col("again").alias("a3")).agg(F.count(F.lit(1)).alias("n"))
        named = stash(holders.join(often, (F.col("r2") == F.col("r3")) & (F.col("a2") == F.col("a3"))).drop("r3", "a3"), "rest-asked")
        met = join_counted(asked, named, on, "n", size[0]).withColumn("holders", F.filter("holders", lambda h: h["key"] < F.col("key"))).where(F.size("holders") > 0)
        documents = met.groupBy(F.col("key").alias("later")).agg(F.collect_list(F.struct("start", "stop", "run", "again", "holders")).alias("runs"))
        found = stash(_aligned(documents, depth), "rest-aligned")
        gone.append(found.where("run is null").select("later", "start", "stop"))
        asked = found.where("run is not null").select(F.col("later").alias("key"), "start", "stop", "run", "again")
        more = named.where(F.col("held") == depth).select("r2", "a2", "last").join(asked.select(F.col("run").alias("r2"), F.col("again").alias("a2")).distinct(), ["r2", "a2"], "left_semi")
        counts = able.groupBy(F.col("run").alias("r3"), F.col("again").alias("a3")).agg(F.count(F.lit(1)).alias("n"))
        more = stash(more.join(counts, (F.col("r2") == F.col("r3")) & (F.col("a2") == F.col("a3"))).drop("r3", "a3"), "rest-tried")
        able = stash(join_counted(able, more, on, "n", total).where(F.col("key") > F.col("last")).select("key", "start", "stop", "run", "again"), "rest-able")


def common_blocks(lines: DataFrame, least_words: int, rounds: int | None = ROUNDS) -> DataFrame:
    """later, at: numbers of the lines (key, at, k, h, g, words) that go from later documents."""
    seen = lines.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select(F.col("h").alias("h2"), F.col("g").alias("g2"), "n")
    shared = stash(join_counted(lines, stash(seen, "seen-lines"), {"h": "h2", "g": "g2"}, "n", lines.count()).drop("h2", "g2", "n"), "shared-lines")
    runs = stash(_runs(shared, least_words), "line-runs")
    total, on = runs.count(), {"run": "r2", "again": "a2"}
    # Runs that are to be aligned, and the documents that may hold them.
    asked, able, gone = runs, runs, []
    for k in range(ROUNDS if rounds is None else rounds):
        holders = stash(_holders(able), "run-holders")
        met = join_counted(asked, holders, on, "n", total).where(F.col("key") > F.col("holder"))
        pairs = met.groupBy(F.col("key").alias("later"), "holder").agg(F.collect_list(F.struct("start", "stop", "run", "again", "place", "until")).alias("runs"))
        found = stash(_aligned(pairs), "aligned-runs")
        gone.append(found.where("run is null").select("later", "start", "stop"))
        left = found.where("run is not null")
        if k + 1 == rounds or left.isEmpty():
            left = None
            break
        # The next round looks for each left run's next holder: among the documents after the one that was tried.
        asked = left.select(F.col("later").alias("key"), "start", "stop", "run", "again")
        tried = holders.join(asked.select(F.col("run").alias("r2"), F.col("again").alias("a2")).distinct(), ["r2", "a2"], "left_semi")
        able = stash(join_counted(able, stash(tried, "tried-holders"), on, "n", total).where(F.col("key") > F.col("holder")).select("key", "start", "stop", "run", "again"), "next-holders")
    if left is not None:
        _rest(asked, able, gone, total)
    places = reduce(DataFrame.unionByName, gone).select("later", F.explode(F.sequence("start", "stop")).alias("place")).distinct()
    numbers = shared.select(F.col("key").alias("k6"), F.col("k").alias("place6"), "at")
    return places.join(numbers, (F.col("later") == F.col("k6")) & (F.col("place") == F.col("place6"))).select("later", "at")


def _deduped(docs: DataFrame, least_words: int, rounds: int | None) -> DataFrame:
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_row")
    mark = F.xxhash64("text")
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), mark.alias("mark"))
    # k is a line's place among the lines with words.
    counted = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("at"), x.alias("line"), n_words(x).cast("int").alias("words")))
    split = docs.select(key.alias("key"), F.posexplode(F.filter(counted, lambda x: x["words"] > 0)).alias("k", "_l")).select("key", "k", "_l.*")
    bare = F.trim(F.translate("line", BLANKS, " " * len(BLANKS)))
    lines = split.select("key", "at", "k", F.xxhash64(bare).alias("h"), F.xxhash64(F.lit(77).cast("long"), bare).alias("g"), "words")
    lines = stash(lines.distinct(), "lines")
    removed = common_blocks(lines, least_words, rounds).groupBy("later").agg(F.array_sort(F.collect_list("at")).alias("removed"))
    text = docs.select("doc_id", "text", others, mark.alias("mark")).join(
        removed.select(F.col("later.id").alias("rid"), F.col("later.mark").alias("rmark"), "removed"), F.col("doc_id").eqNullSafe(F.col("rid")) & (F.col("mark") == F.col("rmark")), "left"
    )
    parts = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("removed"))
    kept = F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long")
    return text.select("doc_id", "_row", n_lines.alias("n_lines"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"), kept.alias("kept"))
