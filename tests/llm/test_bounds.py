"""Bounds that hold whatever a few texts or long runs do."""

from __future__ import annotations

import random
from collections import Counter

from factloom.llm import dedup, secrets


def test_long_runs_do_not_fill_a_shard(spark, monkeypatch):
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    texts = [noise(250) + "0123456789\n" * n + noise(250) for n in (26_000, 40, 900, 901, 30, 19)] + [noise(900)]
    n, bound = dedup.LENGTH, 40_000
    counts = Counter(t[k : k + n] for t in texts for k in range(len(t) - n + 1))
    want = []
    for i, t in enumerate(texts):
        gone = [False] * len(t)
        for k in range(len(t) - n + 1):
            if counts[t[k : k + n]] > 1:
                gone[k : k + n] = [True] * n
        want.append((i, sum(gone), "".join(c for c, g in zip(t, gone) if not g)))

    def watched(batches, *bounds, real=dedup._shard):
        held = list(batches)
        assert sum(len(x.as_py()) for b in held for x in b.column(3)) <= bound
        return real(iter(held), *bounds)

    monkeypatch.setattr(dedup, "_shard", watched)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in dedup.find_repeats(docs, shard_bytes=2000, hot_bytes=bound // 4).collect()}
    for i, size, kept in want:
        left, at = "", 0
        for s in got[i]:
            left, at = left + texts[i][at : s["start"]], s["end"]
        assert sum(s["end"] - s["start"] for s in got[i]) == size and left + texts[i][at:] == kept
    assert want[0][1] > dedup.SLICE


def test_secret_sample_takes_copies_once(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwy") for _ in range(rng.randrange(3, 9)))
    rows = [(k, " ".join(word() for _ in range(30))) for k in range(60)]
    once = spark.createDataFrame(rows, "doc_id long, text string")
    copied = spark.createDataFrame(rows + [(100 + k, "qqqq zzzz xqzj qqqq") for k in range(500)], "doc_id long, text string")
    added = once.unionAll(copied.where("doc_id = 100"))
    want = secrets.ratios(added, sample_rows=300)
    assert secrets.ratios(copied, sample_rows=300) == want != secrets.ratios(once, sample_rows=300)
    assert copied.count() > 500 and secrets.samples(copied, sample_rows=300).count() == secrets.samples(added, sample_rows=300).count()
    assert secrets.ratios(copied, sample_rows=20) == secrets.ratios(copied.repartition(7, "doc_id"), sample_rows=20)
