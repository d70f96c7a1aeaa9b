"""Packing, ranking, SimHash, Brown scores, repeated bytes, line alignment."""

import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import brown, line_dedup, packing, quality_model, repeats, simhash
from tidemark.operators import components


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60))
def test_first_fit_decreasing(lengths):
    x = np.array(lengths, np.int64)
    bins, offsets = packing.first_fit_decreasing(x, 32)
    rooms: list[int] = []
    want = {}
    for i in sorted(range(len(x)), key=lambda i: (-x[i], i)):
        b = next((k for k, r in enumerate(rooms) if r >= x[i]), len(rooms))
        rooms += [32] * (b == len(rooms))
        want[i] = (b, 32 - rooms[b])
        rooms[b] -= x[i]
    assert {i: (int(bins[i]), int(offsets[i])) for i in range(len(x))} == want


def test_packing_round_trip(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = packing.pack(packing.cut_documents(docs, 256), 256, group_size=64)
    rows = packed.collect()
    ids = lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
    want = Counter((r["doc_id"], s, tuple(w[s : s + 256]), len(w)) for r in docs.collect() for w in [ids(r["text"])] for s in range(0, len(w), 256))
    assert Counter((r["doc_id"], r["start"], tuple(np.frombuffer(r["ids"], "<u4").tolist()), r["doc_tokens"]) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        p.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(p, p[1:], strict=False)) and p[0][0] == 0 and sum(p[-1]) <= 256
    made = packing.sequences(packed, 256).collect()
    assert len(made) == len(places)
    assert all(len(r["ids"]) // 4 in (256, r["used"]) and r["used"] == sum(n for _, n in places[r["sequence_id"]]) for r in made)
    slim = packing.pack(packing.cut_documents(docs, 256).drop("ids"), 256)
    assert slim.count() == len(rows)
    assert packing.pack(packing.cut_documents(none), 1024).count() == 0


@pytest.mark.parametrize("wide", [False, True])
def test_columns_of_any_name_are_packed(spark, wide):
    names = ["_piece", "_group", "__group", "sequence_id", "offset"] + [f"more{i}" for i in range(6 * wide)]
    df = spark.createDataFrame([(i, 1 + i % 9) for i in range(200)], "doc_id long, length long").select("*", *[F.concat(F.lit(n), "doc_id").alias(n) for n in names])
    got = packing.pack(df, 16, group_size=32)
    assert got.columns == ["doc_id", "length", *[n for n in names if n not in ("sequence_id", "offset")], "sequence_id", "offset"]
    assert all(r["_piece"] == f"_piece{r['doc_id']}" and r["_group"] == f"_group{r['doc_id']}" for r in got.collect())
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 16").count() == 0


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=80))
def test_encoder_equals_tokenizer(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    global _t
    _t = globals().get("_t") or Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert np.frombuffer(packing.encoder(None).encode(text), "<u4").tolist() == _t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["<|endoftext|>", "<|endoftext|>at the start", "end <|endoftext|> x", "in<|endoftext|>side", "two  <|endoftext|><|endoftext|>\n ", "日本 <|endoftext|> 語  ", "<|endoftext|", "< |endoftext|>"])
def test_added_tokens_keep_their_ids(spark, text):
    import public_tokenizers
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.encoder(None).encode(text), "<u4").tolist() == want
    row = packing.cut_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert np.frombuffer(row["ids"], "<u4").tolist() == [*want, packing.END] and row["doc_tokens"] == len(want) + 1


def test_ranking_learns(spark, small, docs, none, labels):
    d, lab = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_model.score_documents(d, lab).join(lab, "doc_id").toPandas()
    good, bad = (got[got.quality == q].score.to_numpy() for q in (1, 0))
    assert (good[:, None] > bad).mean() > 0.95 and ((got.predicted == got.quality).mean()) > 0.93
    fold = [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]
    assert fold == got.held_out.tolist()
    flipped = lab.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality_model.score_documents(d, flipped).toPandas().set_index("doc_id").score
    assert np.allclose(again.loc[got.doc_id].to_numpy(), got.score.to_numpy())
    out = quality_model.score_documents(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)
    assert quality_model.score_documents(none, labels).count() == 0
    assert {r["predicted"] for r in quality_model.score_documents(docs, labels.where("quality = 1")).collect()} == {1}


def test_pairwise_fit_recovers_order():
    x = np.random.default_rng(0).normal(size=(300, 3))
    y = (x @ [2.0, -1.0, 0.0] > 0).astype(int)
    w = quality_model.fit_pairs(x, y)
    assert w[0] > 0 > w[1] and abs(w[2]) < abs(w[1])


def test_simhash_groups(docs, none):
    rows = docs.collect()
    fps = [brute.simhash(r["text"]) for r in rows]
    comp = brute.components([r["doc_id"] for r in rows], fps)
    want = Counter((r["doc_id"], f"{f:016x}", c) for r, f, c in zip(rows, fps, comp, strict=True))
    assert Counter(tuple(r) for r in simhash.near_groups(docs).collect()) == want
    assert simhash.near_groups(none).count() == 0


def test_similar_groups(spark, docs, none):
    rows = docs.collect()
    sets = [set(simhash.shingle_hashes(r["text"], 5).tolist()) for r in rows]
    got = simhash.similar_groups(docs)
    group = dict(tuple(r) for r in got.collect())
    assert Counter(r["doc_id"] for r in got.collect()) == Counter(r["doc_id"] for r in rows)
    for (a, x), (b, y) in combinations([(r["doc_id"], s) for r, s in zip(rows, sets, strict=True) if r["doc_id"] is not None], 2):
        share = len(x & y) / len(x | y) if x | y else 1.0
        assert (group[a] == group[b]) or share < 0.95
        assert (group[a] != group[b]) or share > 0.6


def similarity_of(x, y):
    return len(x & y) / len(x | y) if x | y else 1.0


def test_similar_pairs_are_found(spark):
    """Recall against brute force, by similarity: pairs of a text and an edited copy; and no link between texts below 0.8."""
    r = np.random.default_rng(6)
    rows = []
    for i in range(400):
        words = [f"w{x}" for x in r.integers(0, 5000, int(r.integers(60, 400))).tolist()]
        rows.append((2 * i, " ".join(words)))
        for k in r.choice(len(words), max(1, round(len(words) * float(r.uniform(0.002, 0.03)))), replace=False).tolist():
            words[k] = f"x{k}"
        rows.append((2 * i + 1, " ".join(words)))
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for _, t in rows]
    group = {x["doc_id"]: x["component_id"] for x in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = defaultdict(list)
    for i in range(400):
        s = similarity_of(sets[2 * i], sets[2 * i + 1])
        linked = group[2 * i] == group[2 * i + 1]
        assert not linked or s >= 0.8
        if s >= 0.8:
            found[min(int(s * 20), 19)].append(linked)
    assert min(map(len, found.values())) > 20 and all(np.mean(v) >= 0.9 for v in found.values())


def test_bands_follow_the_rows():
    p = simhash.angle(0.8)
    for rows in (1, 1000, 10**6, 10**10):
        b = simhash.Bands.of(rows, 0.8)
        one = sum(simhash.math.comb(b.bits, k) * p**k * (1 - p) ** (b.bits - k) for k in range(3))
        assert 1 - (1 - one) ** b.count >= simhash.MEET and b.words * 64 >= b.bits * b.count and rows < 2 ** (b.bits - 7)


@pytest.mark.parametrize("bands", [(16, 4), (24, 10), (26, 9)])
def test_variants_of_bands(spark, bands):
    b = simhash.Bands(*bands)
    r = np.random.default_rng(1)
    fp = r.integers(-(1 << 63), 1 << 63, b.words).tolist()
    whole = sum((x & (1 << 64) - 1) << 64 * k for k, x in enumerate(fp))
    want = {(whole >> k * b.bits & (1 << b.bits) - 1 ^ m) | k << b.bits for k in range(b.count) for m in (0, *(1 << j for j in range(b.bits)))}
    got = spark.createDataFrame([(fp,)], "fp array<bigint>").select(b.variants()).first()[0]
    assert set(got) == want and len(got) == len(want)


def test_similar_groups_of_kept_rows(docs, none):
    got = simhash.similar_groups(docs)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["component_id"] for r in got.collect()}
    assert simhash.similar_groups(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_bucket_members_that_differ_from_the_smallest(spark):
    """Three fingerprints share a band; the smallest is far from the two others, which are alike."""
    fps = [(1, [5, 0, 0, 0]), (2, [5, -1, -1, -1]), (3, [5, -1, -1, -2])]
    edges = simhash.similar_links(spark.createDataFrame(fps, "id long, fp array<bigint>"))
    assert {tuple(r) for r in edges.collect()} == {(2, 3)}


@pytest.mark.parametrize(("few", "side"), [(32, 2048), (1, 2)])
def test_linked_member_is_compared_with_the_others(spark, monkeypatch, few, side):
    """All share one word of four only. 1-2, 2-3 and so on are 30 bits apart, the next but one 60; 9 is far from all."""
    monkeypatch.setattr(simhash, "FEW", few)
    monkeypatch.setattr(simhash, "SIDE", side)
    word = lambda n: sum(0x1F << 5 * k | 0x1F << 32 + 5 * k for k in range(n))
    fps = [(1 + n, [5, word(n), word(n), word(n)]) for n in (0, 1, 2, 3, 4, 5)] + [(9, [5, -1, 0, -1])]
    edges = simhash.similar_links(spark.createDataFrame(fps, "id long, fp array<bigint>"))
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert got == {k: 1 for k in range(1, 7)}
    bits = lambda x, y: sum(((p ^ q) & (1 << 64) - 1).bit_count() for p, q in zip(x, y, strict=True))
    far = {(a, b) for (a, x), (b, y) in combinations(fps, 2) if bits(x, y) > simhash.most_bits(0.8)}
    assert not far & {tuple(r) for r in edges.collect()}


def test_links_connect_all_close_pairs(spark):
    r = np.random.default_rng(3)
    fps = set()
    for base in r.integers(0, 1 << 63, 12, dtype=np.uint64).tolist():
        for _ in range(25):
            for b in r.integers(0, 64, r.integers(0, 5)).tolist():
                base ^= 1 << b
            fps.add(base)
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    edges = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), 2)
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    want = brute.components(fps, [x & (1 << 64) - 1 for x in fps])
    assert [got.get(x, x) for x in fps] == want
    assert all(((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= 2 for r in edges.collect())


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, x) for x in range(200, 230)] + [(7, 7), (300, 301), (301, 300), (302, 301)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {x: 5 for x in [5, *range(200, 230)]} | {300: 300, 301: 300, 302: 300}


def test_brown_scores(spark, docs, none, small):
    got = sorted(brown.score_documents(docs).collect(), key=str)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = Counter((i, h, n, k, total, round(b, 6)) for (i, _), (h, n, k, total, b) in zip(rows, brute.unigram(rows), strict=True))
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert brown.score_documents(none).count() == 0
    d = spark.read.parquet(f"{small}/documents.parquet")
    total = brown.score_documents(d).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert total[0] > total[1]


def test_rare_words_are_joined(spark, docs, monkeypatch):
    full = {(r["doc_id"], r["n_tokens"]): r for r in brown.score_documents(docs).collect()}
    monkeypatch.setattr(brown, "KNOWN", 300)
    monkeypatch.setattr(brown, "WORDS", 50)
    single = {(r["doc_id"], r["n_tokens"]): r for r in brown.score_documents(docs).collect()}
    monkeypatch.setattr(brown, "KNOWN", 1 << 17)
    known = {(r["doc_id"], r["n_tokens"]): r for r in brown.score_documents(docs).collect()}
    for k, w in full.items():
        assert single[k]["n_known"] == known[k]["n_known"] == w["n_known"] and abs(single[k]["base_score"] - w["base_score"]) < 1e-6
        assert abs(single[k]["score"] - known[k]["score"]) < 1e-6


@pytest.mark.parametrize("known", [1 << 17, 60])
def test_scores_by_a_plain_version(spark, small, monkeypatch, known):
    """Token by token from the model's tables, with all words known to the workers or most of them joined."""
    import math

    monkeypatch.setattr(brown, "KNOWN", known)
    monkeypatch.setattr(brown, "WORDS", 40)
    monkeypatch.setattr(brown, "LEAST", 3)
    docs = spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 80").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(900, "never seenx seenx before"), (901, ""), (902, None), (903, "xyzzy " * 40)], docs.schema))
    model, counts, chosen = brown.train(docs.where("doc_id < 60"))
    v, n = model.vocabulary, {r["word"].encode(): r["n"] for r in counts.collect()}
    own = {w: int(model.classes[i]) for i, w in enumerate(v.words[: v.n_single])} | {r["word"].encode(): r["class"] for r in chosen.collect()}
    assert set(own) == {w for w, k in n.items() if k >= 3} and (len(v.words) < len(own)) == (known == 60)
    end = v.n_single + brown.ENDINGS

    def score(text):
        total, last = 0.0, brown.CLASSES - 1
        for w in [*brown.tokens(text), None]:
            e = None if w is None else brown.ending(w)
            c = brown.CLASSES - 1 if w is None else own.get(w, int(model.classes[v.n_single + e]))
            total += model.step[last, c]
            if w is None:
                total += model.emit[end]
            elif w in own:
                total += math.log10((n[w] + 0.5) / model.in_class[c])
            else:
                unseen = 10 ** model.unseen[e]
                total += model.emit[v.n_single + e] + (math.log10(n[w] * (1 - unseen) / v.ending_tokens[e]) if w in n else model.unseen[e])
            last = c
        return total

    got = brown._scored(docs.withColumn("held_out", F.lit(False)), model, counts, chosen).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(got) == len(texts)
    for r in got:
        assert math.isclose(r["score"], score(texts[r["doc_id"]]), rel_tol=1e-9)


def test_words_choose_classes_by_neighbours(spark, monkeypatch):
    """Words of unlike endings that stand in the same places choose the same class; words of one ending in unlike places don't."""
    monkeypatch.setattr(brown, "WORDS", 8)
    monkeypatch.setattr(brown, "LEAST", 5)
    r = np.random.default_rng(3)
    first, second = [f"{c}alpha" if i % 2 else f"{c}beta" for i, c in enumerate("bcdfghjklm")], [f"{c}beta" if i % 2 else f"{c}alpha" for i, c in enumerate("npqrstvwxz")]
    rows = [(i, " ".join(f"{'the' if k % 2 else 'a'} {r.choice(first)} {'of' if k % 3 else 'in'} {'is' if k % 2 else 'was'} {r.choice(second)} {'now' if k % 3 else 'then'}" for k in range(40))) for i in range(60)]
    chosen = {x["word"]: x["class"] for x in brown.train(spark.createDataFrame(rows, "doc_id long, text string"))[2].collect()}
    assert not {chosen[w] for w in first} & {chosen[w] for w in second}


def test_probabilities_sum_to_one():
    v = brown.Vocabulary([b"a", b"b"], np.array([5, 1]), 9, 4, 2, np.where(np.arange(brown.ENDINGS) == 3, 1.0, 0.0), np.where(np.arange(brown.ENDINGS) == 3, 1.0, 0.0), 2)
    classes = np.arange(v.units) % (brown.CLASSES - 1)
    classes[-1] = brown.CLASSES - 1
    f = np.random.default_rng(1).integers(0, 4, (brown.CLASSES, brown.CLASSES)).astype(float)
    m = brown.probabilities(v, classes, f)
    assert np.allclose((10**m.step).sum(1), 1)
    assert np.allclose(np.bincount(classes, weights=10**m.emit, minlength=brown.CLASSES), 1)


def test_exchange_separates_alternating_words():
    # Words 0..9 are followed by words 10..19 and the other way round: two classes explain all.
    n = 20
    pairs = np.zeros((n, n))
    pairs[:10, 10:] = 5
    pairs[10:, :10] = 5
    r, likelihoods = np.random.default_rng(0), []
    classes = r.integers(0, 2, n)
    for _ in range(12):
        before, after, f = np.zeros((n, brown.CLASSES)), np.zeros((n, brown.CLASSES)), np.zeros((brown.CLASSES, brown.CLASSES))
        for c in set(classes.tolist()):
            before[:, c], after[:, c] = pairs[:, classes == c].sum(1), pairs[classes == c, :].sum(0)
        np.add.at(f, classes, before)
        likelihoods.append(brown.xlogx(f).sum() - brown.xlogx(f.sum(0)).sum() - brown.xlogx(f.sum(1)).sum())
        some = np.flatnonzero(r.random(n) < 0.3)
        classes[some] = brown.exchange(some, before[some], after[some], np.zeros(len(some)), classes, f)
    assert not set(classes[:10]) & set(classes[10:]) and likelihoods[-1] > likelihoods[0]


@pytest.mark.parametrize("most_in_group", [20_000, 1])
def test_repeated_bytes(spark, docs, none, small, most_in_group):
    import hashlib

    more = spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 60").select("doc_id", "text")
    extra = [(1000 + i, "ab" * (90 + 7 * i)) for i in range(4)] + [(1100 + i, "q" * i + "the same passage, long enough to count. " * 1 + "z" * 170 + str(i) * 30) for i in range(8)] + [(1200, "é" * 250), (1201, "x" + "é" * 99 + "é")]
    df = docs.select("doc_id", "text").union(more).union(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = df.collect()
    want = Counter((r["doc_id"], *x) for r, x in zip(rows, brute.repeated_bytes([r["text"] for r in rows]), strict=True))
    got = Counter((r["doc_id"], r["n_bytes"], sum(x["end"] - x["start"] for x in r["removed"]), len(r["removed"]), hashlib.sha256(r["kept"]).hexdigest()) for r in repeats.remove_repeats(df, 200, most_in_group).collect())
    assert got == want
    if most_in_group > 1:
        assert repeats.remove_repeats(docs).count() == docs.count() and repeats.remove_repeats(none).count() == 0


def test_long_texts_in_parts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PART", 512)
    r = np.random.default_rng(5)
    base = "".join(map(chr, r.integers(97, 123, 3000)))
    texts = [base, base[1000:1900] + base[:400], "".join(map(chr, r.integers(97, 123, 700))) + base[2500:2790]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", F.lit(0).cast("long").alias("mark"), F.encode("text", "UTF-8").alias("data")).collect()
    parts = [(d["data"][a : a + 512 + 199], d["doc_id"], a) for d in docs for a in range(0, len(d["data"]) - 199, 512)]
    covered, windows = 0, defaultdict(set)
    for lot in (parts[i : i + 2] for i in range(0, len(parts), 2)):
        part, first, last, digit, _ = repeats.window_runs([p for p, _, _ in lot], 200)
        covered += sum(int(b - a + 1) for a, b in zip(first, last, strict=True))
        for p, a, b, d in zip(part, first, last, digit, strict=True):
            for k in range(int(a), int(b) + 1):
                windows[lot[p][0][k : k + 200]].add(int(d))
    assert covered == sum(len(t) - 199 for t in texts)
    assert all(len(v) == 1 for v in windows.values())


def test_digits_of_full_batches(spark):
    """A part's digits don't depend on what was hashed before it, up to the largest batch; a repeat is found wherever its row stands."""
    r = np.random.default_rng(9)
    first, second = r.bytes(repeats.MOST - repeats.PART - 199), r.bytes(repeats.PART + 199)
    both, alone = repeats.window_runs([first, second], 200), repeats.window_runs([second], 200)
    assert [set(zip(x[1][x[0] == k].tolist(), x[3][x[0] == k].tolist(), strict=True)) for x, k in ((both, 1), (alone, 0))][0] == set(zip(alone[1].tolist(), alone[3].tolist(), strict=True))
    with pytest.raises(ValueError):
        repeats.window_runs([first, second + b"x"], 200)
    letters = lambda n: "".join(map(chr, r.integers(97, 123, n)))
    end = letters(300)
    docs = spark.createDataFrame([(1, letters(repeats.PART - 6)), (2, letters(repeats.PART - 100) + end), (3, end)], "doc_id long, text string").coalesce(1)
    got = {x["doc_id"]: [tuple(s) for s in x["removed"]] for x in repeats.remove_repeats(docs).collect()}
    assert got == {1: [], 2: [(repeats.PART - 100, repeats.PART + 200)], 3: [(0, 300)]}


def test_hot_digits(spark, monkeypatch):
    """A passage in most documents: its digits are joined by broadcast, with the same result."""
    from tidemark.llm import shared

    monkeypatch.setattr(shared, "NEVER_HOT", 5)
    monkeypatch.setattr(shared, "HOT_KEYS", 20)
    passage = "a passage that stands in most documents of this table, " * 6
    rows = [(i, f"{i} " * 90 + passage + ("z" * 150 + str(i % 4)) * 2) for i in range(40)] + [(100 + i, f"other {i} " * 60) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter((i, *x[:3]) for (i, _), x in zip(rows, brute.repeated_bytes([t for _, t in rows]), strict=True))
    for most in (20_000, 1):
        got = repeats.remove_repeats(df, 200, most).collect()
        assert Counter((r["doc_id"], r["n_bytes"], sum(x["end"] - x["start"] for x in r["removed"]), len(r["removed"])) for r in got) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=25), st.lists(st.integers(0, 6), max_size=25))
def test_patience_is_a_common_order(a, b):
    m = line_dedup.patience(a, b)
    assert all(a[i] == b[j] for i, j in m)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(m, m[1:], strict=False))
    if a == b:
        assert len(m) == len(a)


def test_patience_keeps_unique_lines_in_order():
    a, b = list(range(50)), [99, *range(10, 30), 98, *range(40, 50), 0]
    assert {j for _, j in line_dedup.patience(a, b)} == set(range(1, 21)) | set(range(22, 32))


def line_cases():
    line = lambda k, n=8: " ".join(f"w{k}x{j}" for j in range(n))
    shared = [line(1000 + k) for k in range(6)]
    out = [(0, "\n".join([line(0), *shared, line(1)]))]
    out += [(1, "\n".join([line(2), *shared, line(3)])), (2, "\n".join([line(4), shared[0], line(5), shared[3], "", shared[4], line(6)]))]
    out += [(3, "short\n" + line(7)), (4, line(8) + "\nshort"), (5, out[0][1]), (6, "  " + shared[2] + " \n" + line(9))]
    out += [(100 + i, "\n".join([line(10 + i), "common line of seven words in all", line(300 + i)])) for i in range(90)]
    out += [(400, None), (401, ""), (402, "\n\n"), (403, "x"), (None, line(0)), (7, line(700)), (7, line(700)), (7, line(701))]
    return out, shared


def test_lines_of_later_documents_go(spark):
    rows, shared = line_cases()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("removed", F.lit("clash")).withColumn("n_chars", F.length("text"))
    got = line_dedup.dedup_lines(df).collect()
    assert len(got) == len(rows)
    kept = {(r["doc_id"], r["kept"]) for r in got}
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(t)
    gone = {r["doc_id"]: [r["removed"]] for r in got}
    assert gone[0] == [[]] and gone[1] == [[1, 2, 3, 4, 5, 6]] and gone[2] == [[1, 3, 5]] and gone[6] == [[0]]
    assert gone[3] == [[]] and gone[4] == [[]] and gone[5] == [list(range(8))] and (None, "") in kept
    assert gone[100] == [[]] and all(gone[100 + i] == [[1]] for i in range(1, 90))
    assert (400, None) in kept and (402, "\n\n") in kept and sum((r["doc_id"], r["kept"]) == (7, rows[-2][1]) for r in got) == 2
    whole = line_dedup.deduped_documents(df)
    assert whole.columns == df.columns and all(r["removed"] == "clash" and r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in whole.collect())


def removed_lines(spark, rows, **how):
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), **how).collect()
    return {r["doc_id"]: r["removed"] for r in got}


def test_moved_blocks_stay(spark):
    """A filter of lines seen before would empty documents 1 to 3; an alignment keeps one order."""
    line = lambda k: " ".join(f"o{k}x{j}" for j in range(7))
    p, q = [line(k) for k in range(4)], [line(k) for k in range(10, 13)]
    rows = [(0, "\n".join([*p, *q])), (1, "\n".join([*q, *p])), (2, "\n".join([*q, *p, line(20)])), (3, "\n".join([*p, *p]))]
    one = removed_lines(spark, rows, rounds=1)
    assert one == {0: [], 1: [3, 4, 5, 6], 2: [3, 4, 5, 6], 3: [0, 1, 2, 3]}
    # The block that stays in 2 is aligned with the next document that has it. The repeated block of 3 finds a second holder too.
    assert removed_lines(spark, rows) == {0: [], 1: [3, 4, 5, 6], 2: [0, 1, 2, 3, 4, 5, 6], 3: [0, 1, 2, 3, 4, 5, 6, 7]}
    assert shared_blocks(rows)[1] == [0, 1, 2, 3, 4, 5, 6]


def test_runs_of_short_lines(spark):
    """Each line stands in another document, but only 6 has them together."""
    line = lambda k: " ".join(f"o{k}x{j}" for j in range(7))
    rows = [(3, [line(30), "aa bb"]), (4, ["cc dd", line(31)]), (5, [line(32), "ee"]), (6, [line(33), "aa bb", "", "cc dd", "ee"]), (7, ["aa bb", "cc dd", "ee", line(34)]), (8, ["cc dd", "aa bb", "ee", line(35)])]
    assert removed_lines(spark, [(i, "\n".join(x)) for i, x in rows]) == {3: [], 4: [], 5: [], 6: [], 7: [0, 1, 2], 8: []}


def runs_of(text, least=5):
    """Places of lines with words, and (start, stop, lines) of the shortest runs from each line on and up to each line."""
    lines = [(k, x.strip()) for k, x in enumerate((text or "").split("\n")) if x.split()]
    size, found = [len(x.split()) for _, x in lines], set()
    for k in range(len(lines)):
        on = next((e for e in range(k, len(lines)) if sum(size[k : e + 1]) >= least), None)
        back = next((e for e in range(k, -1, -1) if sum(size[e : k + 1]) >= least), None)
        found |= ({(k, on)} if on is not None else set()) | ({(back, k)} if back is not None else set())
    return [k for k, _ in lines], sorted((a, b, tuple(x for _, x in lines[a : b + 1])) for a, b in found)


def shared_blocks(rows, least=5):
    """What a filter of runs seen before removes, in any order."""
    found, seen = {}, set()
    for i, text in rows:
        at, runs = runs_of(text, least)
        found[i] = sorted({at[k] for a, b, name in runs if name in seen for k in range(a, b + 1)})
        seen |= {name for _, _, name in runs}
    return found


def aligned_blocks(rows, rounds=2):
    """Plain version: patience diff of each document with the earlier ones that its runs name, one holder after the other."""
    known = {i: runs_of(text) for i, text in rows}
    found = {i: set() for i in known}
    for i, (at, runs) in known.items():
        left = runs
        for k in range(rounds):
            by_holder = {}
            for a, b, name in left:
                holders = [j for j in sorted(known) if any(n == name for _, _, n in known[j][1])]
                if k < len(holders) and holders[k] < i:
                    by_holder.setdefault(holders[k], []).append((a, b, name))
            left = []
            for j, mine in by_holder.items():
                names = {n for _, _, n in mine}
                first = {}
                for a, b, n in known[j][1]:
                    if n in names:
                        first.setdefault(n, (a, b))
                theirs = sorted(names, key=lambda n: first[n])
                matched = {y for _, y in line_dedup.patience([hash(n) for n in theirs], [hash(n) for _, _, n in mine])}
                for y, (a, b, name) in enumerate(mine):
                    if y in matched:
                        found[i] |= {at[x] for x in range(a, b + 1)}
                    else:
                        left.append((a, b, name))
            left.sort()
    return {i: sorted(x) for i, x in found.items()}


@pytest.mark.parametrize("rounds", [1, 2, 4])
def test_alignment_equals_plain_version(spark, rounds):
    r = np.random.default_rng(2)
    pool = [" ".join([f"w{x}"] * (1 + x % 4)) for x in range(40)]
    rows = []
    for i in range(60):
        own = [pool[x] for x in r.integers(0, 40, 6).tolist()]
        if i > 5:  # a part of an earlier document, at times in another order, between own lines
            old = rows[int(r.integers(0, i))][1].split("\n")
            a, b = sorted(r.integers(0, len(old) + 1, 2).tolist())
            own[3:3] = old[a:b] if i % 3 else old[b:] + old[a:b]
        rows.append((i, "\n".join(own)))
    got, want, all_seen = removed_lines(spark, rows, rounds=rounds), aligned_blocks(rows, rounds), shared_blocks(rows)
    assert got == want and sum(map(len, got.values())) > 150
    assert all(set(got[i]) <= set(all_seen[i]) for i in got) and got != all_seen


def test_crowded_runs_equal_plain_version(spark):
    r = np.random.default_rng(11)
    rows = [(i, "\n".join(" ".join([f"w{x}"] * (1 + x % 4)) for x in r.integers(0, 12, 9).tolist())) for i in range(120)]
    assert removed_lines(spark, rows) == aligned_blocks(rows)


def test_hot_lines(spark, monkeypatch):
    from tidemark.llm import shared

    rows, _ = line_cases()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter(map(str, line_dedup.dedup_lines(df).collect()))
    monkeypatch.setattr(shared, "NEVER_HOT", 5)
    monkeypatch.setattr(shared, "HOT_KEYS", 20)
    assert Counter(map(str, line_dedup.dedup_lines(df).collect())) == want


def test_removed_lines_stand_earlier(spark, docs, none, small):
    d = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r["doc_id"]: (r["text"] or "").split("\n") for r in d.collect()}
    done = line_dedup.dedup_lines(d).collect()
    left = {}
    for r in done:
        gone = set(r["removed"])
        left[r["doc_id"]] = [x for k, x in enumerate(rows[r["doc_id"]]) if k not in gone]
        assert r["kept"] == "\n".join(left[r["doc_id"]])
    first = {}
    for i in sorted(left):
        for x in left[i]:
            first.setdefault(x.strip(), i)
    for r in done:
        for k in r["removed"]:
            assert first[rows[r["doc_id"]][k].strip()] < r["doc_id"]
    assert line_dedup.dedup_lines(docs).count() == docs.count() and line_dedup.dedup_lines(none).count() == 0
