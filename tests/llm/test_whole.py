"""Whole results where a part of the data, or of the languages, used to be left out."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from absorbia.llm import langid, nearcopies, pii, quality, simhash

rng = random.Random(5)
VOCABULARY = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(3000)]


def prose(n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def edited(words, k):
    out = list(words)
    for i in rng.sample(range(len(words)), k):
        out[i] = rng.choice(VOCABULARY)
    return out


def shingle_set(words, k=5):
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def jaccard_classes(texts):
    sets = [shingle_set((t or "").lower().split()) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 9 * len(a & b) >= 4 * (len(a) + len(b)):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))]


def test_near_copies_are_all_found(spark):
    base = [prose(n) for n in (3, 6, 30, 80, 200, 200, 400, 1000)]
    words = base + [edited(b, max(1, len(b) * k // 200)) for b in base for k in (1, 2, 3, 4, 5, 6)]
    words += [b[: len(b) * 17 // 20] for b in base] + [b + prose(len(b) // 5) for b in base]
    center, line = prose(120), prose(25)
    words += [edited(center, rng.randint(1, 4)) for _ in range(90)] + [line + prose(rng.randint(1, 12)) for _ in range(60)]
    texts = [" ".join(w) for w in words] + [None, "", " ", "Two words", "two  WORDS"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["component_id"] for r in sorted(nearcopies.near_copies(docs).collect(), key=lambda r: r["doc_id"])]
    assert got == jaccard_classes(texts)
    kept = {r["doc_id"] for r in corpus_pipeline.dedup_stage(spark, docs, "").collect()}
    assert kept == set(got)
    assert nearcopies.near_copies(docs.limit(0)).count() == 0


def test_anchors_link_near_copies_before_the_prefixes(spark, monkeypatch):
    monkeypatch.setitem(globals(), "rng", random.Random(11))  # the other tests draw what they drew
    base = [prose(n) for n in (300, 600, 900, 900)]
    words = base + [edited(b, 1) for b in base for _ in range(12)] + [prose(300) for _ in range(20)] + [prose(4) for _ in range(30)]
    texts = [" ".join(w) for w in words] + [None, ""]
    sets = list({nearcopies.set_id(h): (t, h) for t in texts for h in [nearcopies.shingles(t)]}.items())
    bits = [nearcopies.set_fingerprint(h) for _, (_, h) in sets]
    bits[5] = bits[4]  # of one fingerprint, alike
    bits[-3] = bits[-4]  # of one fingerprint, not alike
    # no set is written under any shingle: what is linked, the anchors have linked
    rows = [(n, len(h), f, t, [], bytearray(nearcopies.parity(h))) for (n, (t, h)), f in zip(sets, bits)]
    nodes = spark.createDataFrame(rows, "node long, size int, fp long, text string, prefix array<long>, parity binary").withColumn("text_hash", nearcopies.text_hash()).drop("text")
    source = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("text_hash", nearcopies.text_hash())
    near = [(i, j) for i in range(len(sets)) for j in range(i) if ((bits[i] ^ bits[j]) & (1 << 64) - 1).bit_count() <= 3]
    want = {frozenset((sets[i][0], sets[j][0])) for i, j in near for a, b in [(sets[i][1][1], sets[j][1][1])] if nearcopies.alike(len(np.intersect1d(a, b)), len(a), len(b))}
    assert len(want) < len(near)
    found = nearcopies.links(source, nodes)
    got = {frozenset((r["u"], r["v"])) for r in found.collect()}
    assert got and got <= want
    classes = lambda edges: {frozenset(c) for c in _classes_of(edges)}
    assert classes(got) == classes(want)


def _classes_of(edges):
    out = []
    for e in edges:
        met = [c for c in out if c & e]
        out = [c for c in out if not c & e] + [set(e).union(*met)]
    return out


def test_prefixes_compare_no_pair_that_the_anchors_linked(spark):
    pairs, parity = spark.createDataFrame([(1, 2), (1, 3)], "u long, v long"), nearcopies.parity(np.arange(50, dtype=np.uint64))
    nodes = spark.createDataFrame([(n, 50, bytearray(parity), c) for n, c in ((1, 1), (2, 1), (3, 3))], "node long, size int, parity binary, comp long")
    assert [tuple(r) for r in nearcopies._possible_pairs(pairs, nodes).collect()] == [(1, 3)]


def test_parity_sketches_bound_the_difference():
    draw = np.random.default_rng(3)
    sets = [np.unique(draw.integers(0, 1 << 64, n, np.uint64)) for n in (0, 1, 5, 63, 64, 65, 200, 1000, 5000)]
    sets += [np.unique(np.r_[s[: len(s) * 9 // 10], draw.integers(0, 1 << 64, len(s) // 9, np.uint64)]) for s in sets]
    sketches, (i, j) = [nearcopies.parity(s) for s in sets], np.indices((len(sets), len(sets))).reshape(2, -1)
    least = nearcopies.least_differences(sketches, i, j)
    true = np.array([len(np.setxor1d(sets[a], sets[b])) for a, b in zip(i, j)])
    assert (least <= true).all() and (least[i == j] == 0).all()
    alike = np.array([nearcopies.alike(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b])) for a, b in zip(i, j)])
    size = np.array(list(map(len, sets)))
    assert alike.any() and (9 * least <= size[i] + size[j])[alike].all()
    others = [nearcopies.parity(draw.integers(0, 1 << 64, 500, np.uint64)) for _ in range(2)]
    assert 9 * nearcopies.least_differences(others, np.array([0]), np.array([1]))[0] > 1000


def test_later_pairs_match_all_pairs():
    draw = np.random.default_rng(5)
    base = draw.integers(0, 1 << 64, 60, np.uint64)
    sets = [np.unique(np.r_[base[: draw.integers(40, 61)], draw.integers(0, 1 << 64, draw.integers(0, 9), np.uint64)]) for _ in range(150)]
    node, size = np.arange(150), np.array(list(map(len, sets)))
    batch = lambda key: pa.RecordBatch.from_arrays([pa.array(np.full(150, key)), pa.array(node), pa.array(size << 32), pa.array(node // 3), pa.array([nearcopies.set_fingerprint(s) for s in sets]), pa.array([nearcopies.parity(s) for s in sets])], names=list("abcdef"))
    got = {(u, v) for b in nearcopies._later_pairs([batch(1), batch(2)]) for u, v in zip(*(c.to_pylist() for c in b.columns))}
    assert {(u, v) for u in range(150) for v in range(u + 1, 150) if u // 3 != v // 3 and nearcopies.alike(len(np.intersect1d(sets[u], sets[v])), size[u], size[v])} <= got


def test_pipeline_drops_a_copy_beyond_three_bits(spark):
    words = prose(300)
    far = lambda t: (simhash.fingerprint(" ".join(words)) ^ simhash.fingerprint(t)).bit_count() > 3
    texts = [" ".join(words), next(t for _ in range(200) if far(t := " ".join(edited(words, 6))))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.dedup_stage(spark, docs, "").collect()] == [0]


def test_rare_languages_are_learned(spark):
    common = ["".join(rng.choice("abcde") for _ in range(rng.randint(4, 9))) for _ in range(30_000)]
    rare = ["".join(rng.choice("uvwxyz") for _ in range(rng.randint(4, 9))) for _ in range(40)]
    rows = [(i, "aa", " ".join(rng.choice(common) for _ in range(20))) for i in range(5_000)] + [(5_000 + i, "zz", " ".join(rng.sample(rare, 10))) for i in range(6)]
    docs = spark.createDataFrame([*rows, (None, "null_id", "κάτι άλλο εδώ")], "doc_id long, lang string, text string")
    model = langid.fit(docs)
    assert model.langs == ["aa", "null_id", "zz"]
    assert model.predict([" ".join(rare[:8]), rows[0][2], "κάτι"])[0] == ["zz", "aa", "null_id"]


def test_every_word_and_gram_is_known():
    words = [f"{a}{b}{c}" for a in "abcdef" for b in "abcdef" for c in "abcdef"]
    model = langid.learn(["aa"] * len(words) + ["zz"], [*words, "xyz"], [50] * len(words) + [1])
    assert model.langs == ["aa", "zz"] and set(words) < set(model.words) and "xyz" in model.grams and model.predict(["xyzz"])[0] == ["zz"]


def test_repeated_ids_do_not_crowd_out_others(spark):
    rows = [(1, "aa", f"uno{i} dos") for i in range(3_000)] + [(2 + i, "bb", "tres cuatro cinco") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = langid.fit(docs, max_docs=10, lang_docs=5)
    assert model.langs == ["aa", "bb"] and sum(w.startswith("uno") for w in model.words) == 1
    labels = spark.createDataFrame([(1, 1, 1), *[(2 + i, 0, 0) for i in range(20)]], "doc_id long, quality int, toxic int")
    known = labels.selectExpr("doc_id", "quality label")
    rows, y = quality.sample_rows(docs.drop("lang"), known, "doc_id", "text", 4_000, quality.BITS, quality.KINDS)
    assert len(rows) == len(y) == 21 and y.sum() == 1
    again, _ = quality.sample_rows(docs.drop("lang").orderBy(F.rand(3)), known, "doc_id", "text", 4_000, quality.BITS, quality.KINDS)
    assert (rows.feature == again.feature).all()


def test_rare_personal_data_is_learned(spark):
    ids = spark.range(6_000).orderBy(F.xxhash64(F.lit(0), "id"), "id").tail(40)
    rare = {r["id"] for r in ids}
    docs = spark.createDataFrame([(i, f"please write to bob{i} [at] example.org" if i in rare else "plain words only") for i in range(6_000)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.find(docs).collect()}
    assert all(got[i].startswith("contact:16:") for i in rare) and not any(got[i] for i in got.keys() - rare)
    assert not any("[at]" in r["text"] for r in pii.redact(docs).collect())


def test_pipeline_keeps_a_row_of_each_class_where_ids_repeat(spark):
    a, b, c = (" ".join(prose(60)) for _ in range(3))
    rows = [(1, a), (0, a), (1, b), (1, b), (2, b), (3, c), (3, a), (4, "x y"), (4, "y z"), (None, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.dedup_stage(spark, docs, "").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(0, a), (1, b), (3, c), (4, "x y"), (4, "y z"), (None, c)], key=str)
