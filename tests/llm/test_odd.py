"""Clashing names, empty tables, boosted trees and training against plain versions."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from absorbia.llm import pii, quality

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.withColumns({"score": F.lit(7.5), "predicted": F.lit("p"), "text_hash": F.lit(1), "base": F.lit("b"), "every": F.lit(True), "_score": F.lit(0), "h": F.lit(2)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        odd = stage(spark, odd, SF)
        assert odd.columns[len(docs.columns) :] == ["score", "predicted", "text_hash", "base", "every", "_score", "h"], name
        assert [tuple(r) for r in odd.select("score", "predicted", "text_hash", "base", "every", "_score", "h").distinct().collect()] == [(7.5, "p", 1, "b", True, 0, 2)], name


def test_stages_take_nulls_and_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    rows = docs.unionByName(spark.createDataFrame([(None, None, None, None, None), (900001, "", None, "s", 0), (900001, "", None, "s", 0)], docs.schema))
    for table in (rows, rows.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, table, SF).count() <= table.count()
        assert corpus_pipeline.STAGES[-1][1](spark, table, SF).select("doc_id").distinct().count() == table.select("doc_id").distinct().count()


def test_redaction_joins_overlapping_spans(spark):
    text = "x" * 3000 + "é card +1 4111111111111111 mail a@b.org" + "y" * 3000
    df = spark.createDataFrame([(text, [(3001, 4, 3010, 0), (3005, 0, 3008, 0), (3009, 3, 3020, 0), (3030, 1, 3033, 0)])], "text string, rows array<struct<s:int,k:int,e:int,bits:int>>")
    got = df.select(pii.redacted(F.col("text"), F.col("rows"))).first()[0]
    assert got == text[:3001] + f"[{pii.NAMES[4].upper()}]" + text[3020:3030] + "[IP]" + text[3033:]


def test_clear_drops_what_overlaps_a_base_span(spark):
    r = random.Random(6)
    for _ in range(4):
        base = [(s, r.randrange(4), s + r.randint(1, 40), 0) for s in r.sample(range(2000), 60)]
        more = [(s, 4 + r.randrange(3), s + r.randint(1, 12), 5) for s in r.sample(range(2000), 400)]
        kind = "array<struct<s:int,k:int,e:int,bits:int>>"
        df = spark.createDataFrame([(sorted(base), more)], f"base {kind}, more {kind}")
        got = [tuple(x) for x in df.select(pii.clear(F.col("base"), F.col("more"))).first()[0]]
        assert got == sorted(x for x in more if not any(b[0] < x[2] and x[0] < b[2] for b in base))


def test_boosting_lowers_the_loss_and_the_threshold_keeps_the_precision():
    r = random.Random(4)
    counts = [(b, r.randint(0, 20) * (1 - (b >> 14)) + 1, r.randint(0, 20) * (b >> 14)) for b in (r.randrange(1 << 15) for _ in range(80))]
    trees, start = pii.boost(counts, 10)
    loss = lambda n: sum(n0 * np.logaddexp(0, m) + n1 * np.logaddexp(0, -m) for b, n0, n1 in counts for m in [pii.margin(b, trees[:n], start)])
    assert all(loss(n + 1) <= loss(n) + 1e-9 for n in range(10)) and loss(10) < 0.7 * loss(0)
    i, j, _ = trees[0]
    p = 1 / (1 + np.exp(-start))

    def gain(i, j):
        leaf = [(0.0, 1.0)] * 4
        for b, n0, n1 in counts:
            k = (b >> i & 1) * 2 + (b >> j & 1)
            leaf[k] = (leaf[k][0] + n1 - (n0 + n1) * p, leaf[k][1] + (n0 + n1) * p * (1 - p))
        return sum(a * a / c for a, c in leaf)

    assert gain(i, j) >= max(gain(a, b) for a in range(pii.N_FEATURES) for b in range(a, pii.N_FEATURES)) - 1e-6
    for kind, cut in pii.calibrate(counts, trees, start, 0.6).items():
        above = [(n0, n1) for b, n0, n1 in counts if pii.kind_of(b) == kind and pii.margin(b, trees, start) >= cut]
        assert (sum(n1 for _, n1 in above) + 0.5) / (sum(map(sum, above)) + 1) >= 0.6


def test_dual_coordinate_descent_reaches_the_optimum():
    r = np.random.default_rng(2)
    y = np.where(r.random(50) < 0.4, 1, -1)
    lists = [np.unique(np.r_[r.integers(0, 24, 6), 24 + (r.random() < 0.5 + 0.3 * y[i])]).astype(np.int32) for i in range(50)]
    rows = quality.Rows.of(lists)
    w, square, bias = quality.fit_margin(rows, y, 32, epochs=3000, least=1)
    ratio = np.sqrt(square)
    x = np.zeros((50, 33))
    signed = np.where(ratio > 0, 1.0, 0.0) * np.sign(_ratio(lists, y))
    for i, f in enumerate(lists):
        x[i, f] = (ratio * signed)[f] / max(np.sqrt(square[f].sum()), 1e-9)
    x[:, 32] = 1
    top = np.where(y > 0, 50 / (2 * (y > 0).sum()), 50 / (2 * (y < 0).sum()))
    theta = np.r_[np.where(ratio > 0, w / np.where(ratio > 0, ratio * signed, 1), 0), bias]
    primal = lambda t: t @ t / 2 + (top * np.maximum(0, 1 - y * (x @ t))).sum()
    plain, best = np.zeros(33), np.inf
    for step in range(1, 20001):  # plain subgradient descent on the primal
        plain = plain - (plain - ((top * y * (y * (x @ plain) < 1)) @ x)) / step
        best = min(best, primal(plain)) if step % 50 == 0 else best
    assert primal(theta) <= best * 1.001 + 1e-6


def _ratio(lists, y):
    p, q = (np.bincount(np.concatenate([f for f, s in zip(lists, y) if s == sign]), minlength=32) for sign in (1, -1))
    return np.where(p + q > 0, np.log((p + 1) / ((y > 0).sum() + 2)) - np.log((q + 1) / ((y < 0).sum() + 2)), 0)
