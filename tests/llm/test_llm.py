"""Operators against brute force, and on null, empty, long, repeated and clashing rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from absorbia.llm import ann, bpe, digest, graph, langid, licenses, packing, pii, quality, simhash, toxicity
from absorbia.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, block int"


def table(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", 1) for i, t in zip(ids, texts)], SCHEMA)


rng = random.Random(11)
WORDS = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(200)]
PROSE = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(5, 60))) for _ in range(60)]
ODD = [None, "", " ", "\n\n", "x", "é ñ ü 日本語", "a" * 5000, " ".join(WORDS) * 20, "dup dup dup", "dup dup dup", "a\x1cb\x85c\xa0d", "<|endoftext|> and <|startoftext|>", "Tom's  don't\t'll 123 $$$"]
TEXTS = PROSE + ODD
IDS = [*range(len(PROSE)), *range(100, 100 + len(ODD) - 2), 108, None]


# --- packing -------------------------------------------------------------------------------


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing_is_whole(spark, capacity):
    got = packing.pack(table(spark, TEXTS, IDS), tokenizer_path("word_bpe_49k.json"), capacity=capacity).collect()
    want = []
    for i, ids in zip(IDS, library_ids(TEXTS)):
        for k, s in enumerate(range(0, len(ids), capacity)):
            part = ids[s : s + capacity]
            want.append((i, k, s, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(by) <= -(-sum(w[3] for w in want) // capacity) * 1.1 + 1


def test_packing_is_optimal_on_small_cases():
    def best(items, capacity):
        items, found = sorted(items, reverse=True), [len(items)]

        def place(i, bins):
            if len(bins) >= found[0]:
                return
            if i == len(items):
                found[0] = len(bins)
                return
            for b in {x: k for k, x in enumerate(bins)}.values():
                if bins[b] + items[i] <= capacity:
                    place(i + 1, [*bins[:b], bins[b] + items[i], *bins[b + 1 :]])
            place(i + 1, [*bins, items[i]])

        place(0, [])
        return found[0]

    r = random.Random(4)
    for _ in range(60):
        capacity, items = 20, [r.randint(1, 20) for _ in range(r.randint(1, 9))]
        made = packing.plan({k: items.count(k) for k in items}, capacity)
        assert sum(n for _, n in made) == best(items, capacity)
        assert sorted(k for p, n in made for k in p * n) == sorted(items)
        assert all(sum(p) <= capacity for p, _ in made)


def test_packing_of_nothing(spark):
    assert packing.pack(table(spark, []), tokenizer_path("word_bpe_49k.json")).count() == 0


# --- BPE -----------------------------------------------------------------------------------


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    docs = table(spark, TEXTS, IDS)
    got = {(r["doc_id"], r["text"]): r for r in bpe.digests(docs, tokenizer_path("byte_bpe_50k.json")).collect()}
    real = {(r["doc_id"], r["text"]): r for r in bpe.encode_decode(docs, tokenizer_path("byte_bpe_50k.json")).collect()}
    for i, text in zip(IDS, TEXTS):
        ids = t.encode(text or "", add_special_tokens=False).ids
        r = got[i, text]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert real[i, text]["ids"] == ids and real[i, text]["decoded"] == (text or "")
    assert bpe.digests(table(spark, []), tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_bpe_on_random_text():
    from tokenizers import Tokenizer

    t, coder, r = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), bpe.Bpe(open(tokenizer_path("byte_bpe_50k.json")).read()), random.Random(2)
    texts = ["".join(r.choice("ab eE\n\t'sS1 .,$éß　\x1f中") for _ in range(r.randint(0, 60))) for _ in range(800)]
    for text, data in zip(texts, coder.encode(texts)):
        assert np.frombuffer(data, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


# --- SimHash -------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_classes(spark):
    base = [" ".join(rng.choice(WORDS) for _ in range(150)) for _ in range(12)]
    near = [" ".join(b.split()[:-1] + [w]) for b in base[:8] for w in ("zz", "yy", "Zz")]
    texts, ids = TEXTS + base + near, [*IDS, *range(1000, 1000 + len(base) + len(near))]
    got = simhash.near_duplicates(table(spark, texts, ids)).collect()
    fps = [plain_fingerprint(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    want = sorted((str(d), f"{f:016x}", str(least.get(find(i)))) for i, (d, f) in enumerate(zip(ids, fps)))
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == want
    assert len({w[2] for w in want}) < len(want)
    assert simhash.near_duplicates(table(spark, [])).count() == 0


def test_cover_meets_every_pair():
    r = np.random.default_rng(0)
    for _ in range(200):
        x = int(r.integers(0, 1 << 63)) << 1 | int(r.integers(2))
        y = x
        for b in r.choice(64, int(r.integers(0, 4)), replace=False):
            y ^= 1 << int(b)
        i, keys = simhash.anchors(np.array([x, y], np.uint64).view(np.int64))
        assert set(keys[i == 0]) & set(keys[i == 1])


def test_split_anchors_lose_no_link(spark):
    r = np.random.default_rng(5)
    half = int(r.integers(0, 1 << 32))
    fp = [half | int(x) << 32 for x in r.integers(0, 1 << 32, 300)] + [int(x) << 32 | half for x in r.integers(0, 1 << 32, 300)]
    fp += [f ^ sum(1 << int(b) for b in r.choice(64, int(r.integers(1, 4)), replace=False)) for f in fp[::3]]
    fp = np.unique(np.array(fp, np.uint64).view(np.int64))
    assert len(simhash.frequent_anchors(df := spark.createDataFrame([(int(x),) for x in fp], "fp long"), 500, 50))
    want = {(int(a), int(b)) for k, b in enumerate(fp) for a in fp[:k] if ((int(a) ^ int(b)) & (1 << 64) - 1).bit_count() <= 3}
    find = lambda frequent: {tuple(sorted((x["u"], x["v"]))) for x in simhash.links(df, sample=500, frequent=frequent).collect()}
    assert find(50) <= want and find(10**6) <= want
    classes = lambda edges: {frozenset(x["node"] for x in rows) for rows in _by_root(graph.components(spark.createDataFrame(sorted(edges), "u long, v long")).collect())}
    assert classes(find(50)) == classes(want) == classes(find(10**6))


def _by_root(rows):
    out = {}
    for r in rows:
        out.setdefault(r["root"], []).append(r)
    return out.values()


def test_tree_of_links_and_components(spark):
    r = np.random.default_rng(1)
    center = int(r.integers(0, 1 << 62))
    fp = np.unique(np.array([center ^ sum(1 << int(b) for b in r.choice(60, int(r.integers(0, 5)), replace=False)) for _ in range(150)], np.uint64).view(np.int64))
    pairs = [(int(a), int(b)) for k, a in enumerate(fp) for b in fp[:k] if int(np.bitwise_count(a ^ b)) <= 3]
    tree = simhash.link_group(fp)
    assert len(tree) < len(fp) and set(map(frozenset, tree)) <= set(map(frozenset, pairs))

    def classes(edges):
        root = {int(x): int(x) for x in fp}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in edges:
            root[find(a)] = find(b)
        out = {}
        for x in root:
            out.setdefault(find(x), set()).add(x)
        return set(map(frozenset, out.values()))

    assert classes(tree) == classes(pairs)
    chain = [(i, i + 1) for i in range(40)] + [(100, 101)]
    got = {}
    for node, top in graph.components(spark.createDataFrame(chain, "u long, v long")).collect():
        got.setdefault(top, set()).add(node)
    assert sorted(map(sorted, got.values())) == [list(range(41)), [100, 101]]


# --- PII -----------------------------------------------------------------------------------


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def plain_pii(text):
    out, digits = [], lambda m: re.sub("[^0-9]", "", m)
    for k, kind, p, ok in (
        (0, "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (1, "ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        (2, "card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (3, "phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ):
        out += [(m.start(), k, m.end(), kind) for m in re.finditer(p, text or "") if ok(m[0])]
    return [(kind, s, e) for s, k, e, kind in sorted(out)]


PII = [
    "mail bob.smith@mail.example.com or a@b.c_d@e.f, @x.y a@b", "from 10.0.0.255 and 256.1.1.1 and 1.2.3.4.5.6.7.8 0001.002.3.4", "card 4111 1111 1111 1111 and 4111-1111-1111-1112 and 378282246310005",
    "call +44 (20) 7946-0958 now, +1 23, +12345678901234567890", "日本 +1 (415) 555-2671 é bob@x.org", "+1 4111111111111111", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "bob [at] example.org", "1 2 3 4 " * 3000, "9" * 20000, "a" * 20000 + "@", "+" + "1 " * 5000, "1." * 3000,
]


def test_pii_base_spans(spark):
    texts = TEXTS + PII
    got = {i: r for i, r in enumerate(sorted(pii.find(table(spark, texts)).collect(), key=lambda r: r["doc_id"]))}
    for i, text in enumerate(texts):
        want = plain_pii(text)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest(), (text or "")[:80]
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(w[0] == k for w in want) for k in pii.KINDS]
        spans = [x.split(":") for x in got[i]["spans"].split(",") if x]
        assert {(k, int(s), int(e)) for k, s, e in spans} >= set(want)
        assert [int(s[1]) for s in spans] == sorted(int(s[1]) for s in spans)
    assert pii.find(table(spark, [])).count() == 0


def test_pii_adds_secrets_and_redacts(spark):
    texts = [f'token = "{hashlib.sha1(str(i).encode()).hexdigest()}" é mail b{i}@x.org' for i in range(40)] + ["plain words only", None]
    docs = table(spark, texts)
    got = {r["doc_id"]: r["spans"] for r in pii.find(docs).collect()}
    assert got[3].split(",")[0] == "secret:9:49" and got[40] == got[41] == ""
    out = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    assert out[3]["text"] == 'token = "[SECRET]" é mail [EMAIL]' and out[40]["text"] == "plain words only" and out[41]["text"] is None
    assert out[3]["n_chars"] == len(out[3]["text"]) and out[3]["score"] == "clash" and pii.redact(docs).columns == docs.columns


def test_pii_plan_is_native(spark):
    plan = pii.find(table(spark, PII))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- licences ------------------------------------------------------------------------------


def test_licence_places(spark):
    texts = TEXTS + ["Under the MIT license, under-the mit; license under the mit license", "Apache License, Version 2.0", "cc-by-nc CC BY NC cc by cc by nc", "the " * 500 + licenses.TEMPLATES["bsd-2-clause"][0].upper(), licenses.TEMPLATES["mit"][0].replace("without restriction", "with no bounds")]
    got = sorted(licenses.scan(table(spark, texts)).collect(), key=lambda r: r["doc_id"])
    for text, r in zip(texts, got):
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        places = sorted((i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({p[1] for p in places})) and 0 <= r["score"] <= 1
    assert got[-2]["labels"] == "bsd-2-clause" and got[-1]["labels"] == "mit" and got[0]["labels"] == ""
    assert licenses.scan(table(spark, [])).count() == 0


def test_matching_statistics():
    r = random.Random(3)
    templates = {str(i): (" ".join(r.choice("abc") for _ in range(r.randint(1, 12))),) for i in range(4)}
    a = licenses.Automaton.build({}, templates)
    subs = {tuple(t[0].split()[i:j]) for t in templates.values() for i in range(12) for j in range(i + 1, 13)}
    words = [r.choice("abcd") for _ in range(300)]
    got = {i: n for i, _, n in a.statistics([a.vocab.get(w.encode()) for w in words])}
    for i in range(len(words)):
        assert got.get(i, 0) == max((n for n in range(13) if n <= i + 1 and tuple(words[i - n + 1 : i + 1]) in subs), default=0)


def test_chains_prefer_what_covers_most():
    passage = licenses.TEMPLATES["mit"][0].split()
    a = licenses.Automaton.build({}, {"mit": (" ".join(passage),), "two": ("one two three four five six seven eight nine ten one two three four five twelve",)})
    edited = passage[:20] + ["zzz"] + passage[22:]
    text = " ".join(["x"] * 9 + passage + ["y"] * 30 + edited + ["one two three four five six seven eight nine ten one two three four five twelve"] + passage[:10])
    got = a.scan(text)["spans"]
    n = len(passage)
    assert [(s[0], s[1], s[2]) for s in got] == [(9, 9 + n, "mit"), (39 + n, 39 + 2 * n - 1, "mit"), (38 + 2 * n, 54 + 2 * n, "two")]
    assert got[0][3] == got[2][3] == 1.0 and abs(got[1][3] - (n - 2) / n) < 1e-9


def test_licences_that_differ_in_a_word_are_told_apart():
    a = licenses.Automaton.build(licenses.PHRASES, licenses.TEMPLATES)
    for label in ("gpl-2", "gpl-3", "agpl-3", "cc-by", "cc-by-nc", "cc-by-sa", "isc", "bsd-3-clause"):
        assert {s[2] for s in a.scan("some words " + licenses.TEMPLATES[label][0] + " more words")["spans"]} == {label}
    assert a.scan("one two " + " ".join(licenses.TEMPLATES["mit"][0].split()[:20]))["spans"] == []


def test_many_matches_in_one_text():
    import time

    a, times = licenses.Automaton.build(licenses.PHRASES, licenses.TEMPLATES), []
    for n in (500, 4_000):
        text = ("under the MIT license " + licenses.TEMPLATES["mit"][0] + " ") * n
        began = time.process_time()
        got = a.scan(text)
        times.append(time.process_time() - began)
        assert len(got["base"]) == n and len(got["spans"]) == n
    assert times[1] < 25 * times[0]


# --- digests -------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [7, 2048])
def test_digests_of_neighbours(spark, block):
    ids = [i if i is not None else None for i in IDS]
    got = digest.neighbours(table(spark, TEXTS, ids), block=block).collect()
    rows = sorted(((-(2**63) if i is None else i, t or "") for i, t in zip(ids, TEXTS)), key=lambda r: (-r[0], hashlib.sha256(r[1].encode()).hexdigest()))
    want = []
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        n = len(text) // 3
        edited = text[: len(text) - n] + after[:n]
        a, b, c = (digest.digest(x.encode()) for x in (text, edited, after))
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, digest.likeness(a, b), digest.likeness(a, c)))
    assert sorted((-(2**63) if r[0] is None else r[0], *tuple(r)[1:]) for r in got) == sorted(want)
    assert all(0 <= w[5] <= 1 for w in want)
    assert digest.neighbours(table(spark, [])).count() == 0 and digest.neighbours(table(spark, ["one row"])).first()["near_next"] == 1.0


# --- classifiers and languages ---------------------------------------------------------------


def test_quality_learns_and_stands_odd_rows(spark):
    good = [p.capitalize() + "." for p in PROSE]
    bad = [" ".join(w.upper() + "!!" for w in p.split()) for p in PROSE]
    docs = table(spark, good + bad + ODD)
    labels = spark.createDataFrame([(i, 1 if i < 60 else 0, None) for i in range(120) if i % 4] + [(None, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out.values())
    assert all(out[i]["predicted"] == (i < 60) for i in range(120) if i % 4 == 0)
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {quality.Model(None, None, 0.0, 1.0, 35.0).probability(np.zeros(1))[0]}
    assert quality.classify(table(spark, []), labels).count() == 0


def test_dual_coordinate_descent_finds_the_optimum():
    r = np.random.default_rng(0)
    y = np.where(r.random(60) < 0.5, 1, -1)
    lists = [np.unique(np.r_[r.integers(0, 20, 5), 20 + (y[i] > 0)]).astype(np.int32) for i in range(60)]
    rows = quality.Rows.of(lists)
    w, square, bias = quality.fit_margin(rows, y, 32, epochs=200)
    m = quality.Model(w, square, bias, 1.0, 0.0).margins(np.repeat(np.arange(60), np.diff(rows.start)), rows.feature, 60)
    assert (np.sign(m) == y).all()


def test_toxicity_learns(spark):
    toxic = [f"{p} badword {p[:5]}" if i % 2 else f"{p} nastystem{i}" for i, p in enumerate(PROSE)]
    texts = PROSE * 4 + toxic
    docs = table(spark, texts + ODD)
    labels = spark.createDataFrame([(i, 1, int(i >= 240)) for i in range(300) if i % 3], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in toxicity.classify(docs, labels).collect()}
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out.values())
    held = [i for i in range(300) if i % 3 == 0]
    assert np.mean([out[i]["predicted"] == (i >= 240) for i in held]) > 0.97
    assert {r["predicted"] for r in toxicity.classify(docs, labels.where("toxic = 0")).collect()} == {0}


def test_language(spark):
    en = ["the cat and the dog are here with this thing", "that is what they think of the other house"] * 20
    de = ["der hund und die katze sind nicht hier", "das ist was wir von dem anderen haus denken"] * 20
    docs = table(spark, en + de).selectExpr("doc_id", "text", "if(doc_id < 40, 'en', 'de') lang")
    model = langid.fit(docs)
    new = table(spark, ["they are in the house", "katzen und hunde", None, "", "123 !!", "thinking", "dem haus " * 9000])
    got = {r["doc_id"]: r for r in langid.identify(new, model).collect()}
    assert [got[i]["lang_pred"] for i in range(7)] == ["en", "de", "und", "und", "und", "en", "de"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in langid.identify(new, langid.fit(docs.limit(0))).collect()} == {"und"}


def plain_log_odds(rows, word):
    """Log frequencies of a word by language, by the rule itself: the word, else its longest known n-grams."""
    langs = sorted({r[0] for r in rows})
    words, grams = {}, {}
    for lang, w, n in rows:
        words.setdefault(w, [0.0] * len(langs))[langs.index(lang)] += n
        padded = f" {w} "
        for m in range(1, 6):
            for i in range(len(padded) - m + 1):
                if padded[i : i + m] != " ":
                    grams.setdefault(padded[i : i + m], [0.0] * len(langs))[langs.index(lang)] += 1 + np.log(n)
    log = lambda table, key: np.array([np.log((table[key][j] + 0.5) / (sum(v[j] for v in table.values()) + 0.5 * len(table))) for j in range(len(langs))])
    if word in words:
        return log(words, word)
    padded = f" {word} "
    for m in range(5, 0, -1):
        got = [padded[i : i + m] for i in range(len(padded) - m + 1) if padded[i : i + m] in grams]
        if got:
            return np.mean([log(grams, g) for g in got], axis=0)
    return np.zeros(len(langs))


def test_language_scores_follow_the_rule():
    r = random.Random(8)
    rows = [(lang, "".join(r.choice(letters) for _ in range(r.randint(1, 6))), r.randint(1, 9)) for lang, letters in (("aa", "abcd"), ("bb", "cdef"), ("cc", "efgh")) for _ in range(40)]
    rows = [(*k, sum(x[2] for x in rows if x[:2] == k)) for k in {x[:2] for x in rows}]
    model = langid.learn(*zip(*rows))
    texts = [" ".join("".join(r.choice("abcdefghz") for _ in range(r.randint(1, 7))) for _ in range(r.randint(1, 9))) for _ in range(60)] + [rows[0][1] + "; " + rows[1][1].upper() + "9ж"]
    langs, scores = model.predict(texts)
    import regex

    for text, lang, score in zip(texts, langs, scores):
        total = sum(plain_log_odds(rows, w) for w in regex.findall(r"\p{L}+", text.lower()))
        share = np.exp(total - total.max())
        assert lang == sorted({x[0] for x in rows})[int(total.argmax())] and abs(score - 1 / share.sum()) < 1e-3


# --- neighbours ------------------------------------------------------------------------------


def vectors(n, dims=16, seed=0):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dims)).astype(np.float32)
    x[50:90] = x[50]
    return x


def test_neighbours_recall_and_odd_vectors(spark):
    x = vectors(3000)
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] * 16), (5300, [1.0, None] * 8), (5400, [float("inf")] * 16), (5500, [1.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(df, df.where("vec_id % 100 = 0 or vec_id = 60")).collect()
    hit = n = 0
    for q in {r["query_id"] for r in got}:
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        want = sorted((d[i], i) for i in range(3000) if i != q)[:10]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, 11)) and all(abs(d[m[1]] - m[2]) < 1e-12 for m in mine)
        hit, n = hit + len({w[1] for w in want} & {m[1] for m in mine}), n + 10
        if q == 60:
            assert [m[1] for m in mine] == [i for i in range(50, 61) if i != 60]
    assert len({r["query_id"] for r in got}) == 31 and hit / n >= 0.9
    few = df.where("vec_id < 4")
    assert ann.search(few, few).count() == 12 and ann.search(df.limit(0), df.limit(0)).count() == 0


# --- pipeline --------------------------------------------------------------------------------


def test_pipeline_keeps_columns_and_packs(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        assert kept.columns == docs.columns
        sizes.append(kept.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    packed = corpus_pipeline.run(spark, sf)
    assert packed.select("doc_id").distinct().count() == sizes[-1]
