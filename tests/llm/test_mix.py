"""Mixing: shares, caps, short sources, memberships."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidegauge.llm import mix as M

DOCS = "doc_id bigint, text string, source string"
TARGETS = "source string, weight double, max_repeat int"


def corpus(spark, counts, seed=1):
    rng = random.Random(seed)
    words = {s: [f"{s.strip().lower()[:3]}{c}{d}" for c in "abcdef" for d in "ghijkl"] for s in counts}
    common = ["the", "of", "index", "buffer"]
    rows = []
    for s, n in counts.items():
        for _ in range(n):
            text = " ".join(rng.choice(words[s] if rng.random() < 0.3 else common) for _ in range(rng.randrange(5, 60)))
            rows.append((len(rows), text, rng.choice((s, s.upper(), f" {s} "))))
    return spark.createDataFrame(rows, DOCS)


def test_shares_and_caps(spark):
    docs = corpus(spark, {"alpha": 1500, "beta": 600, "gamma": 60, "other": 100})
    targets = spark.createDataFrame([("alpha", 0.4, 1), ("beta", 0.4, 3), ("gamma", 0.15, 2), ("delta", 0.05, 9)], TARGETS)
    selection, wanted = M.mix_documents(docs, targets)
    rows = selection.collect()
    cap = {i: m for i, (_, _, m) in enumerate(wanted)}
    assert len({r["doc_id"] for r in rows}) == len(rows) == 2160
    assert all(0 <= r["repeats"] <= cap[r["k"]] for r in rows)
    report = {r["source"]: r for r in M.mix_report(selection, wanted).collect()}
    total = sum(r["tokens"] for r in report.values())
    for s in ("alpha", "beta"):
        assert abs(report[s]["selected_tokens"] - report[s]["weight"] * total) < 0.01 * total
    assert report["gamma"]["selected_tokens"] == 2 * report["gamma"]["tokens"] and report["gamma"]["is_short"]
    assert report["delta"]["tokens"] == 0 and report["delta"]["is_short"] and not report["beta"]["is_short"]
    assert sorted(r["source"] for r in M.short_sources(M.mix_report(selection, wanted)).collect()) == ["delta", "gamma"]
    assert abs(sum(r["share"] for r in report.values()) - 1) < 1e-9


def test_posteriors_tell_domains_apart(spark):
    """Held-out documents: without its own label's weight, a document's posterior still points to its domain."""
    docs = corpus(spark, {"alpha": 400, "beta": 400}, seed=2)
    members = M.memberships(docs, ["alpha", "beta"], max_labelled=200).collect()
    right = 0
    for r in members:
        q = np.array(r["q"])
        label = np.full(2, (1 - M.LABEL_TRUST) / 2)
        label[r["k"]] += M.LABEL_TRUST
        assert abs(q.sum() - 1) < 1e-5
        right += np.argmax(q / label) == r["k"]
    assert right / len(members) > 0.95


def test_edges(spark):
    targets = spark.createDataFrame([("a", 0.5, 1), (" A ", 0.6, 2), (None, 0.3, 1), ("b", None, 1), ("c", 0.4, None)], TARGETS)
    assert M.mix_targets(targets) == [("a", 0.6, 2), ("c", 0.4, 0)]
    docs = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (2, "", "A"), (None, "x", "a"), (3, "x y", None), (4, "x", "zz"), (5, "x " * 200_000, "c")], DOCS)
    docs = docs.withColumn("k", F.lit("clash")).withColumn("tokens", F.lit("clash"))
    selection, wanted = M.mix_documents(docs, targets)
    assert sorted((r["doc_id"], r["tokens"]) for r in selection.collect()) == [(1, 0), (2, 0), (5, 200_000)]
    report = {r["source"]: r for r in M.mix_report(selection, wanted).collect()}
    assert report["c"]["selected_tokens"] == 0 and report["c"]["is_short"] and report["a"]["share"] is None
    empty, none = M.mix_documents(docs, targets.limit(0))
    assert none == [] and empty.count() == 0 and M.mix_report(empty, none).count() == 0
    nothing, wanted = M.mix_documents(docs.limit(0), targets)
    assert nothing.count() == 0 and M.mix_report(nothing, wanted).count() == 2
