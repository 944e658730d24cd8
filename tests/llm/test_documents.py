"""Operators on documents against brute force, and their edge cases."""

import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quadrille.llm import line_rules, mixing, packing, quality, queries, sharding, simhash, surface, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, fp long, shard int, score double, part int, row string"
LONG = "tail " * 3000 + "lone"


def edge_docs(spark):
    """Nulls in any column, empty, blank and long texts, repeated rows, ties, and column names that operators use inside."""
    texts = [None, "", " \n\t ", "one", "same text here", "same text here", "\u00e9\u00e8 \u65e5\u672c\n\n'quote' \U0001d7d8", LONG, "a b c d e f g h"]
    rows = [(k, t, "en", "s1", 5, -1, -2, -3, -4.0, -5, "x") for k, t in enumerate(texts)]
    rows += [(None, "no id", None, None, None, None, None, None, None, None, None), (4, "same text here", "en", "s1", 5, -1, -2, -3, -4.0, -5, "x"), (50, None, None, None, None, 0, 0, 0, 0.0, 0, None)]
    return spark.createDataFrame(rows, SCHEMA)


def labels_for(spark):
    return spark.createDataFrame([(3, 1, 0), (3, 0, 1), (7, 1, 0), (None, 1, 1), (8, None, None), (999, 0, 1)], "doc_id long, quality int, toxic int")


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").toPandas()


# --- packing

def slow_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    return [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]


def test_packing_of_whole_documents(spark, sf, docs):
    out = queries.op2_best_fit_packing(spark, sf).toPandas()
    ids = dict(zip(docs.doc_id, slow_ids(docs.text), strict=True))
    for r in out.itertuples():
        want = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(array("I", want).tobytes()) == r.ids_crc32 and len(want) == r.length <= 1024
    for doc, pieces in out.groupby("doc_id"):
        p = pieces.sort_values("piece")
        assert p.piece.tolist() == list(range(len(p))) and p.start.tolist() == [0, *np.cumsum(p.length)[:-1].tolist()] and p.length.sum() == len(ids[doc])
        assert (p.length[1:] == 1024).all()
    for _, s in out.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1].tolist()] and s.length.sum() <= 1024
    # one packing of the whole table: as many sequences as a plain best fit of all lengths, one by one
    assert out.sequence_id.nunique() == len(best_fit(sorted(out.length.tolist(), reverse=True), 1024)[0])


def test_token_ids_equal_those_of_the_tokenizer():
    rng = np.random.default_rng(1)
    letters = list(" \t\n\r\x0b\x1c\x85\xa0\u2003\u3000'sdtmllvreABC019\u00e9\u6f22\U0001f389\u00bd\u00b2.,!#_\u0301\x00<|endoftext|>")
    texts = ["".join(rng.choice(letters, rng.integers(0, 15))) for _ in range(3000)] + [" " * 50_000, "a" * 50_000, "'s 't 've"]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    texts += ["a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|> y<|endoftext", "word " * 5000 + "<|endoftext|>"]
    encode = packing.encoder(packing.default_tokenizer())
    assert all(encode(x) == array("I", t.encode(x, add_special_tokens=False).ids).tobytes() for x in texts)
    assert list(array("I", encode("a<|endoftext|>b"))) == [64, 50256, 65]


def best_fit(lengths, size):
    """Room left in each sequence, and the offset of each length, by looking at all sequences."""
    room, offsets = [], []
    for n in lengths:
        open_ = [(c, i) for i, c in enumerate(room) if c >= n]
        if not open_:
            room.append(size)
            open_ = [(size, len(room) - 1)]
        c, i = min(open_)
        offsets.append(size - c)
        room[i] -= n
    return room, offsets


@pytest.mark.parametrize("seed", range(5))
@pytest.mark.parametrize("most", [65, 12])
def test_best_fit_takes_the_tightest_open_sequence(seed, most):
    rng = np.random.default_rng(seed)
    lengths = sorted(rng.integers(1, most, 400).tolist(), reverse=True)
    sequences, offsets = packing.pack_lengths(lengths, 64)
    room, want = best_fit(lengths, 64)
    assert sorted(offsets) == sorted(want) and max(sequences) + 1 == len(room)
    ends = np.zeros(len(room), int)
    for q, o, n in sorted(zip(sequences, offsets, lengths, strict=True)):
        assert ends[q] == o
        ends[q] += n
    assert sorted(ends) == sorted(64 - r for r in room)


def test_packing_edges(spark):
    out = packing.pack_documents(edge_docs(spark).repartition(4, "doc_id")).toPandas()
    assert out[out.doc_id.isin([0, 1, 50])].ids.map(list).tolist() == [[2]] * 3 and all(len(x) == n for x, n in zip(out.ids, out.length, strict=True))
    assert (out.doc_id == 4).sum() == 2 and out.doc_id.isna().sum() == 1
    assert packing.pack_documents(no_docs(spark)).count() == 0
    assert packing.cut_points(2049, 1024) == [(0, 1), (1, 1024), (1025, 1024)]


# --- near duplicates

def slow_fingerprint(text, k):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))


def slow_components(fps, ids, bits):
    label = {}
    for i in range(len(fps)):
        if i in label:
            continue
        stack, seen = [i], {i}
        while stack:
            u = stack.pop()
            near = np.flatnonzero(np.bitwise_count(fps ^ fps[u]) <= bits)
            more = [v for v in near.tolist() if v not in seen]
            seen.update(more)
            stack += more
        for v in seen:
            label[v] = min(ids[x] for x in seen)
    return [label[i] for i in range(len(fps))]


def test_simhash_equals_brute_force(spark, sf, docs):
    out = queries.op9_simhash_near_dedup(spark, sf).toPandas().set_index("doc_id").loc[docs.doc_id]
    fps = np.array([slow_fingerprint(t, 4) for t in docs.text], np.uint64)
    assert out.fingerprint.tolist() == [f"{x:016x}" for x in fps.tolist()]
    assert out.component_id.tolist() == slow_components(fps, docs.doc_id.tolist(), 4)


@pytest.mark.parametrize(("cap", "segments", "joined"), [(4096, 3, 1), (6, 3, 1), (4096, 5, 2), (6, 5, 2), (4096, 8, 5)])
def test_near_fingerprints_are_all_found(spark, cap, segments, joined):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    near = base[rng.integers(0, 6, 400)]
    for _ in range(4):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) * (rng.random(400) < 0.6)
    fps = np.unique(np.concatenate([base, near]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = {r["a"]: r["b"] for r in simhash.components(simhash.links(df, simhash.Scheme(run_cap=cap, segments=segments, joined=joined))).collect()}
    signed = fps.view(np.int64).tolist()
    assert [got.get(x, x) for x in signed] == slow_components(fps, signed, 4)


@pytest.mark.parametrize("n", [0, 200_000, 10**7, 10**9, 10**12])
def test_keys_meet_whenever_the_segments_suffice(n):
    rng = np.random.default_rng(4)
    s = simhash.Scheme().widened(n)
    assert s.complete and not simhash.NEAR_COPIES.complete and simhash.NEAR_COPIES.widened(n) is simhash.NEAR_COPIES
    assert s.joined == {0: 1, 200_000: 1, 10**7: 2, 10**9: 3}.get(n, 6) and not simhash.Scheme(segments=s.segments - 1, joined=s.joined).complete
    a = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    b = a.copy()
    for _ in range(4):
        b ^= np.uint64(1) << rng.integers(0, 64, 2000).astype(np.uint64)
    assert (simhash.first_shared(a[:, None], b[:, None], s) < s.keys).all()


def test_simhash_edges(spark):
    out = simhash.near_duplicates(edge_docs(spark)).collect()
    by = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    assert len(out) == 12 and {k: by[k]["component_id"] for k in (0, 1, 2, 50)} == {0: 0, 1: 0, 2: 0, 50: 0} and by[0]["fingerprint"] == "0" * 16
    assert by[5]["component_id"] == 4 and [r["component_id"] for r in out if r["doc_id"] is None] == [None]
    assert simhash.near_duplicates(no_docs(spark)).count() == 0
    kept = simhash.keep_one(edge_docs(spark))
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == edge_docs(spark).columns and sorted(x for x in ids if x is not None) == [0, 3, 4, 6, 7, 8] and ids.count(None) == 1


def test_near_copies_are_joined_and_others_are_not(spark):
    rng = np.random.default_rng(5)
    words = ["w%d" % k for k in range(4000)]
    rows = []
    for k in range(40):
        base = rng.choice(words, 300).tolist()
        rows.append((10 * k, " ".join(base)))
        rows.append((10 * k + 1, " ".join([*base[:150], "changed", *base[151:]])))
        rows.append((10 * k + 2, " ".join([*base[:150], *rng.choice(words, 150).tolist()])))
    out = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), simhash.NEAR_COPIES).collect()}
    assert sum(out[10 * k + 1] == 10 * k for k in range(40)) >= 39
    assert all(out[10 * k + 2] == 10 * k + 2 for k in range(40))


def test_similarity_is_exact_at_the_threshold(spark):
    rng = np.random.default_rng(6)
    words = ["w%d" % k for k in range(5000)]
    rows = []
    for k in range(60):
        base = rng.choice(words, 600).tolist()
        for at, changes in enumerate((0, 13, 14)):  # 596 shingles, 5 lost a change: 531 / 661 = 0.803 and 526 / 666 = 0.790
            other = list(base)
            for c in range(changes):
                other[20 + 40 * c] = f"new{at}x{c}"
            rows.append((10 * k + at, " ".join(other)))
    one, other = ([r for r in rows if r[0] % 10 != at] for at in (2, 1))
    classes = lambda x: {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(x, "doc_id long, text string"), simhash.NEAR_COPIES).collect()}
    found, apart = classes(one), classes(other)
    assert sum(found[10 * k + 1] == 10 * k for k in range(60)) >= 59
    assert all(apart[10 * k + 2] == 10 * k + 2 for k in range(60))


def _set_components(sets, ids, at=0.8):
    """Components of all pairs of sets by brute force."""
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= at * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return [min(ids[k] for k in range(len(ids)) if label[k] == x) for x in label]


@pytest.mark.parametrize("cap", [4096, 40])
def test_every_pair_within_the_bound_is_verified(spark, cap):
    """A hundred texts around 0.8 of each other: proposals fail often, and others that are farther apart in bits reach it."""
    rng = np.random.default_rng(8)
    base, rows = [f"b{k}" for k in range(300)], []
    for k in range(100):
        text = list(base)
        for c in rng.choice(60, int(rng.integers(3, 5)), replace=False):
            text[5 * int(c)] = f"n{k}x{c}"
        rows.append((k, " ".join(text)))
    s = simhash.Scheme(shingle_words=5, lanes=3, max_bits=60, segments=8, similarity=0.8, run_cap=cap)
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for _, t in rows]
    fps = [[simhash.majority(simhash._mixed(simhash.shingle_hashes(t.encode(), 5), lane)) for lane in range(3)] for _, t in rows]
    assert len(set(map(tuple, fps))) == 100
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), s).collect()}
    assert [got[k] for k in range(100)] == _set_components(sets, list(range(100)))


def test_equal_fingerprints_are_verified_too(spark, monkeypatch):
    """A passage that repeats outweighs the rest of a text; and texts whose lanes are equal still have to reach the similarity."""
    loops = [(k, "one line goes round again " * 200 + " ".join(f"d{k}x{n}" for n in range(100))) for k in range(6)]
    loops += [(10, "one line goes round again " * 200 + loops[0][1])]  # the words of the first text, with more repeats
    classes = lambda x: {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(x, "doc_id long, text string"), simhash.NEAR_COPIES).collect()}
    assert classes(loops) == {**{k: k for k in range(6)}, 10: 0}
    one = spark.createDataFrame([(1, 7, 7, 7, [1, 2, 3, 4, 5]), (2, 7, 7, 7, [11, 12, 13, 14, 15]), (3, 7, 7, 7, [1, 2, 3, 4, 5]), (4, 7, 7, 7, [11, 12, 13, 14])], "doc_id long, fp long, fp1 long, fp2 long, shingles array<int>")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, scheme: one.withColumn("node", F.xxhash64("fp", "fp1", "fp2", "shingles")))
    assert classes([(1, "")]) == {1: 1, 2: 2, 3: 1, 4: 2}


CLASHES = ["_gone", "_again", "_id", "_n", "_size", "_span", "_spans", "_passes", "row", "root", "node", "text_key", "text_crc32", "slot", "id", "key", "cut", "span", "first", "who"]


def clashing_docs(spark):
    """Two different texts of one id and size, a copy of one under another id, a repeated row; names that operators use inside."""
    texts = [(1, "a b c d e f g h"), (1, "q r s t u v w x"), (2, "a b c d e f g h"), (3, "lone words of their own here now ok"), (3, "lone words of their own here now ok"), (None, "a b c d e f g h")]
    return spark.createDataFrame([(k, t, "en", "s", len(t), *[9] * len(CLASHES)) for k, t in texts], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASHES))


def test_clashing_names_and_repeated_ids(spark, tmp_path):
    docs = clashing_docs(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"][0], r["who"]) for r in kept.collect()) == [(0, "a", 9), (1, "a", 9), (1, "q", 9), (3, "l", 9)]
    mixed = mixing.mixed_texts(docs, block=4)
    assert mixed.columns == docs.columns and mixed.where("_span = 9").count() == mixed.count()
    want = mixing.mix(docs, block=4).where("doc_id = 1").groupBy("text_key").agg(F.sum("taken").alias("n")).collect()
    got = mixed.where("doc_id = 1").groupBy(F.substring("text", 1, 1)).agg(F.sum(F.size(F.split(F.trim("text"), " ")))).collect()
    assert sorted(r["n"] for r in want if r["n"]) == sorted(r[1] for r in got)
    sharding.write_shards(docs, f"file://{tmp_path}/out", shards=2)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert set(back.columns) == {*docs.columns, "shard"} and back.select(*docs.columns).exceptAll(docs).isEmpty() and back.count() == docs.count()


# --- mixing

def targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=str) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        level = (total - sum(2 * sizes[s] for s in capped)) / max(sum(weight[s] for s in free), 1)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in capped else level * weight[s] for s in names}
        capped |= over


def test_mix_meets_targets(spark, sf, docs):
    out = queries.op5_source_mixing(spark, sf).toPandas().set_index("doc_id").loc[docs.doc_id].reset_index()
    out["source"], n = docs.source, [len(WORD.findall(t or "")) for t in docs.text]
    assert out["size"].tolist() == n and (out.taken <= 2 * out["size"]).all() and (out.taken >= 0).all()
    sizes = out.groupby("source", dropna=False)["size"].sum().to_dict()
    want = targets(sizes)
    for s, part in out.groupby("source"):
        assert (part.source_size == sizes[s]).all() and np.allclose(part.target, want[s])
        assert abs(part.taken.sum() - want[s]) <= max(0.01 * want[s], 2 * mixing.BLOCK)
    again = queries.op5_source_mixing(spark, sf).toPandas().set_index("doc_id").loc[docs.doc_id]
    assert again.taken.tolist() == out.taken.tolist()


def test_apportionment_equals_the_highest_quotients(spark):
    rng = np.random.default_rng(6)
    for seats in (0, 1, 7, 40, 211):
        shares = {f"s{k:02d}": float(x) for k, x in enumerate(rng.integers(0, 1000, 12))}
        df = spark.createDataFrame(list(shares.items()), "name string, share double")
        got = {r["name"]: r["quota"] for r in mixing.sainte_lague(df, F.lit(seats).cast("long"), F.col("share"), F.lit(10**6).cast("long"), [], [F.col("name")]).collect()}
        quotients = sorted(((-v / (2 * k + 1), n) for n, v in shares.items() for k in range(seats) if v > 0), key=lambda x: x)[:seats]
        assert got == {n: sum(m == n for _, m in quotients) for n in shares}


def test_many_tiny_sources_keep_their_seats_beside_a_hot_one(spark):
    rows = [("hot", 640_000)] + [("s%04d" % k, 38) for k in range(1000)]
    df = spark.createDataFrame(rows, "name string, share long")
    got = {r["name"]: r["quota"] for r in mixing.sainte_lague(df, F.lit(10_594).cast("long"), F.col("share"), F.lit(10**6).cast("long"), [], [F.col("name")]).collect()}
    won = sorted(((-share / (2 * k + 1), name) for name, share in rows for k in range(11_000 if name == "hot" else 3)))[:10_594]
    assert got == {name: 0 for name, _ in rows} | dict(Counter(name for _, name in won)) and got["s0999"] == 1


def test_mixed_texts_hold_the_words_taken(spark, sf, docs):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    plan = {r["doc_id"]: r["taken"] for r in mixing.mix(df, block=16).where("taken > 0").collect()}
    texts = mixing.mixed_texts(df, block=16)
    assert texts.columns == df.columns
    got, source = Counter(), dict(zip(docs.doc_id, docs.text, strict=True))
    for r in texts.collect():
        got[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert r["text"] in source[r["doc_id"]] and r["n_chars"] == len(r["text"])
    assert dict(got) == plan


def test_mix_edges(spark):
    out = mixing.mix(edge_docs(spark), docs_per_shard=3)
    rows = out.collect()
    assert len(rows) == 12 and all(r["taken"] == 0 for r in rows if r["size"] == 0) and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.mix(no_docs(spark)).count() == 0 and mixing.mixed_texts(no_docs(spark)).count() == 0
    one = [(None, "x y z", None), (1, None, "a"), (2, "", "b")]
    assert mixing.mix(spark.createDataFrame(one, "doc_id long, text string, source string")).count() == 3


# --- shards

def test_shards_are_balanced_and_whole(spark, sf, docs):
    out = queries.op6_sharding(spark, sf).toPandas().set_index("doc_id").loc[docs.doc_id]
    raw = [(t or "").encode() for t in docs.text]
    assert out["size"].tolist() == [len(b) + 8 for b in raw] and out.text_crc32.tolist() == [zlib.crc32(b) for b in raw]
    assert set(out.law) == {"bytes"} and out.grown_shard.isna().all() and set(out.shard) <= set(range(24))
    for _, s in out.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    sums = out.groupby("shard")["size"].sum()
    assert (sums - out["size"].sum() / 24).abs().max() <= out["size"].max()
    assert out.groupby("text_crc32").shard.apply(lambda s: s.max() - s.min()).le(1).all()


def test_shard_edges(spark, tmp_path):
    rows = sharding.assign_shards(edge_docs(spark), shards=3, rows_per_partition=4).collect()
    assert len(rows) == 12 and sorted(r["slot"] for r in rows if r["shard"] == 0) == list(range(sum(r["shard"] == 0 for r in rows)))
    assert sharding.assign_shards(no_docs(spark)).count() == 0
    hot = spark.createDataFrame([(k, "same") for k in range(400)] + [(1000 + k, f"t{k}") for k in range(200)], "doc_id long, text string")
    sums = [r["s"] for r in sharding.assign_shards(hot, shards=8, rows_per_partition=50).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sums) == 8 and max(sums) - min(sums) <= 24
    sharding.write_shards(hot, str(tmp_path / "shards"), shards=8)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 600


# --- quality, line rules, toxicity

def test_line_statistics(docs):
    field = line_rules.fit_field([])
    for t in [*docs.text.tolist()[:60], "", None, "a b a b a b", "\n".join(["x y z w"] * 30), "\u00e9 " * 60, "a #*$%&|<> b"]:
        words = WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        grams = Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
        r = line_rules.judge((t or "").encode(), field)
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")))
        assert r["n_dup_lines"] == len(lines) - len(set(lines)) and r["n_repeat_words"] == len(covered)
        assert r["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words)) and (not r["base_failed"] or not r["kept"])


def test_viterbi_finds_the_best_labelling():
    rng = np.random.default_rng(7)
    f = line_rules.LineField(np.zeros(9), 0.0, rng.normal(size=2), rng.normal(size=(2, 2)), np.zeros(9), np.ones(9))
    for n in (1, 2, 7):
        e = rng.normal(size=n)
        def score(y):
            return f.start[y[0]] + sum(e[i] * y[i] for i in range(n)) + sum(f.step[a, b] for a, b in zip(y, y[1:], strict=False))
        best = max(([k >> i & 1 for i in range(n)] for k in range(2**n)), key=score)
        assert list(f.decode(e.tolist())) == best
    assert list(f.decode([])) == []


def split_labels(spark, folder="/root/testdata/sf0.1"):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    return docs.where("doc_id < 4000"), labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")


def test_line_rules_on_held_out_labels(spark):
    docs, fit, test = split_labels(spark)
    r = line_rules.judge_documents(docs, fit).join(test, "doc_id").where("not base_failed")
    wrong = r.groupBy("quality").agg(F.avg((F.col("kept").cast("int") != F.col("quality")).cast("int")).alias("w")).collect()
    assert {x["quality"]: x["w"] < 0.05 for x in wrong} == {0: True, 1: True}


def test_quality_on_held_out_labels(spark):
    docs, fit, test = split_labels(spark)
    r = quality.score_documents(docs, fit).join(test, "doc_id")
    wrong = r.groupBy("quality").agg(F.avg((F.col("kept").cast("int") != F.col("quality")).cast("int")).alias("w")).collect()
    assert {x["quality"]: x["w"] < 0.02 for x in wrong} == {0: True, 1: True}


def test_sites_shrink_to_their_parents(spark):
    unit = quality._UNIT
    rows = [("big", "a", int(0.9 * unit))] * 60 + [("big", "b", int(0.9 * unit))] * 60 + [("bad", "a", int(0.1 * unit))] * 60 + [("one", "a", int(0.5 * unit)), (None, None, int(0.5 * unit))]
    marked = spark.createDataFrame(rows, "host string, path string, e long")
    out = quality.with_scores(marked, quality.site_posteriors(marked))
    by = {r["host"]: r for r in out.dropDuplicates(["host", "path"]).collect()}
    mean = sum(r[2] for r in rows) / len(rows) / unit
    assert out.count() == len(rows) and by["big"]["path_posterior"] > 0.8 and by["bad"]["path_posterior"] < 0.2
    assert abs(by["one"]["path_posterior"] - mean) < 0.05 and abs(by[None]["path_posterior"] - mean) < 0.05


def test_toxicity_on_held_out_labels(spark):
    docs, _, _ = split_labels(spark)
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    r = toxicity.score_documents(docs, labels).join(labels, "doc_id").where("held_out")
    pd = r.select("score", "predicted", "toxic").toPandas()
    # some junk texts lost the words that their label is for, and this table has few labels: 0.978 measured (1.000 on 0.1 GB)
    assert pd.score.between(0, 1).all() and (pd.predicted == pd.toxic).mean() > 0.97
    # 4 of 406 clean texts are flagged with 1155 labels to learn from; none of 4556 with 6000 labels
    assert ((pd.predicted == 1) & (pd.toxic == 0)).sum() <= 0.015 * len(pd)


def test_held_out_rows_are_those_of_the_rule(spark):
    ids = list(range(50)) + [-7, 10**12]
    got = [r["h"] for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").select(toxicity.held_out().alias("h")).collect()]
    assert got == [zlib.crc32(str(i).encode()) % 4 == 2 for i in ids]


@pytest.mark.parametrize("seed", range(3))
def test_automaton_equals_edit_distance(seed):
    rng = np.random.default_rng(seed)
    letters = list("abc")
    terms = {"".join(rng.choice(letters, rng.integers(4, 10))): False for _ in range(6)}
    a = toxicity.LexiconAutomaton(terms)

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            new = [i]
            for j, d in enumerate(y, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        return row[-1]

    for _ in range(1500):
        w = "".join(rng.choice(letters, rng.integers(1, 11)))
        near = sorted((distance(w, t), t) for t in terms if distance(w, t) <= toxicity.edits_allowed(t, False))
        got = a.match(w)
        assert (got is None) == (not near) and (got is None or got[1] == near[0][0])


def test_stems_and_context():
    m = toxicity.ToxicModel({"grumb": True, "nasty": False}, frozenset(["hasty"]))
    s = toxicity.Scorer(m)
    assert s["grumbling"] == ("grumb", 0) and s["grum"] is None and s["nastey"] == ("nasty", 1) and s["hasty"] is None
    meant, quoted = s.features("you nasty grumbler , go away now")[0], s.features('they said "nasty" about it')[0]
    assert meant > quoted > 0 and s.features(None) == [0.0, 0.0]
    near, far = s.features("nasty grumble"), s.features("nasty " + "x " * 60 + "grumble")
    assert near[0] == far[0] and near[1] > far[1]


def test_model_edges(spark):
    d, none, lab = edge_docs(spark), no_docs(spark), labels_for(spark)
    empty = lab.limit(0)
    for labels in (lab, empty):
        assert quality.score_documents(d, labels).count() == 12 and line_rules.judge_documents(d, labels).count() == 12 and toxicity.score_documents(d, labels).count() == 12
        assert quality.keep_good(d, labels).columns == d.columns and toxicity.keep_clean(d, labels).columns == d.columns
    assert quality.score_documents(none, lab).count() == line_rules.judge_documents(none, lab).count() == toxicity.score_documents(none, lab).count() == 0
    clean = toxicity.score_documents(d, empty)
    assert clean.where("predicted = 1").count() == 0 and toxicity.keep_clean(d, empty).count() == 12


def test_repeated_words_beyond_one_number():
    words = [str(k).encode() for k in range(3_000_000 // 1000)] * 2
    assert surface.repeated_words(words) == len(words)


def test_lines_of_the_other_kind_are_marked_within_a_text(spark):
    """Lines of bad texts planted into good ones that the fit has not seen: their labels are known."""
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("text is not null").orderBy("doc_id").select("doc_id", "text", "quality").collect()
    field = line_rules.fit_field([(r["text"], r["quality"]) for r in rows if r["doc_id"] % 2 == 0][:1500])
    lines = {q: [x for r in rows if r["doc_id"] % 2 and r["quality"] == q and len(x := list(line_rules.word_lines(r["text"].encode()))) >= 2] for q in (0, 1)}
    rng = np.random.default_rng(3)
    right = total = found = planted = 0
    for good in [x for x in lines[1] if len(x) >= 6][:300]:
        bad = lines[0][rng.integers(len(lines[0]))][: int(rng.integers(1, 4))]
        at = int(rng.integers(0, len(good)))
        want = [0] * at + [1] * len(bad) + [0] * (len(good) - at)
        got = field.decode(field.emissions(np.array([line_rules.line_features(*x) for x in [*good[:at], *bad, *good[at:]]])).tolist())
        right, total = right + sum(a == b for a, b in zip(got, want, strict=True)), total + len(want)
        found, planted = found + sum(a and b for a, b in zip(got, want, strict=True)), planted + len(bad)
    assert right >= 0.92 * total and found >= 0.55 * planted


@pytest.mark.parametrize("scheme", [simhash.Scheme(), simhash.NEAR_COPIES, simhash.Scheme(segments=5, joined=2)], ids=["query", "pipeline", "joined"])
def test_key_index_holds_each_struck_out_bit_once_and_keeps_keys_together(spark, scheme):
    import itertools
    import random

    draw = random.Random(1)
    rows = [(i, *[draw.getrandbits(64) - 2**63 for _ in range(3)]) for i in range(200)]
    df = spark.createDataFrame(rows, "node long, fp long, fp1 long, fp2 long").select(*simhash._columns(scheme))
    cuts = [64 * k // scheme.segments for k in range(scheme.segments + 1)]
    groups = list(itertools.combinations([list(range(*x)) for x in zip(cuts, cuts[1:], strict=False)], scheme.joined))
    want = []
    for r in df.collect():
        first = 0
        for name in simhash.lane_names(scheme):
            for bits in [sum(g, []) for g in groups]:
                value = sum((r[name] % 2**64 >> bit & 1) << at for at, bit in enumerate(bits))
                want += [(((value & ~(1 << k)) << 12) | (first + k), r[scheme.node]) for k in range(len(bits))]
                first += len(bits)
        assert first == scheme.keys
    for tasks in (None, 7):
        got = simhash.key_index(df, scheme, tasks).select("key", scheme.node, F.spark_partition_id().alias("task")).collect()
        assert sorted((x[0], x[1]) for x in got) == sorted(want)
        if tasks:
            assert len({(x[0], x[2]) for x in got}) == len({x[0] for x in got})
