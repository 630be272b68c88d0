"""Operators that compare documents, and the pipeline, against brute force."""

from __future__ import annotations

import hashlib
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from factloom.llm import components, dedup, simhash, suffixes

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def _fingerprint(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    grams = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _roots(prints):
    """Least id reachable over links of at most 4 bits; prints: (id, fingerprint) rows."""
    best = list(range(len(prints)))

    def find(x):
        while best[x] != x:
            x = best[x]
        return x

    for a in range(len(prints)):
        for b in range(a + 1, len(prints)):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 4:
                x, y = find(a), find(b)
                best[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(prints):
        r = find(k)
        least[r] = min(least.get(r, i), i)
    return [least[find(k)] for k in range(len(prints))]


def test_simhash_of_documents(docs, no_docs, texts):
    rows = [(i, _fingerprint(t or "")) for i, t in texts]
    want = sorted((i, f, c) for (i, f), c in zip(rows, _roots(rows)))
    got = sorted((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for *_, c in want})
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.one_of_each(no_docs).count() == 0


def test_one_of_each_with_repeated_and_null_ids(spark):
    a, b, c = ("one two three four five six seven eight", "quite another text with words of its own in it", "a third thing that has nothing to do with them")
    rows = [(3, a), (5, a), (5, b), (5, b), (None, b), (None, c), (None, c)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == sorted([(3, a), (5, b), (0, c)])


@pytest.mark.parametrize("tile", [4096, 16])
def test_links_join_what_is_linked(spark, tile):
    rng = random.Random(4)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for centre in list(prints)[:20]:
        for _ in range(rng.choice([2, 150])):
            f = centre
            for _ in range(rng.randint(0, 6)):
                f ^= 1 << rng.randrange(64)
            prints.add(f)
    rows = sorted(prints)
    signed = [f - (1 << 64) if f >> 63 else f for f in rows]
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), tile=tile)
    pairs = [(r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1) for r in found.collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
    roots = {r["node"]: r["root"] for r in components.components(found).collect()}
    got = Counter(frozenset(k for k, v in roots.items() if v == r) for r in set(roots.values()))
    want = {}
    for f, c in zip(signed, _roots(list(enumerate(rows)))):
        want.setdefault(c, set()).add(f)
    assert got == Counter(frozenset(v) for v in want.values() if len(v) > 1)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {(r["node"], r["root"]) for r in components.components(links).collect()}
    assert got == {(k, 0) for k in range(61)} | {(100, 100), (101, 100)}
    assert components.components(links.limit(0)).count() == 0


def _shared(a, b, depth):
    n = 0
    while n < min(len(a), len(b), depth) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("base, chunk", [(1 << 20, 1 << 17), (3, 4), (0, 1), (3, 1 << 17)])
def test_suffix_order_and_prefixes(monkeypatch, base, chunk):
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    rng = random.Random(base + chunk)
    for alphabet in (1, 2, 3, 200, 5000):
        for _ in range(60 if chunk > 4 else 25):
            n, top = rng.randint(0, 90), alphabet - 1
            values = [rng.randrange(alphabet) for _ in range(n)]
            if rng.random() < 0.4:
                values = (values[:17] * 9)[:n]
            text = np.array(values, np.uint8 if alphabet <= 256 else np.int32)
            with suffixes.Scratch() as scratch:
                rows = list(suffixes.suffixes(text, top, 64, scratch, held=rng.choice([8, 64, 1 << 20]), base=base))
            order, prefix = ([x for part in rows for x in part[k].tolist()] for k in (0, 1))
            assert sorted(order) == list(range(len(values)))
            for k, (a, b) in enumerate(zip(order, order[1:])):
                assert prefix[k + 1] == _shared(values[a:], values[b:], 64)
                assert values[a : a + 64] >= values[b : b + 64]


def test_a_text_far_larger_than_memory(monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK", 1 << 10)
    rng = np.random.default_rng(8)
    piece = rng.integers(97, 105, 30_000, dtype=np.uint8)
    raw = np.concatenate([piece, rng.integers(97, 105, 150_000, dtype=np.uint8), piece[:20_000], piece[5_000:]])
    most = [0]

    def watched(self, key, position, prefix, real=suffixes.Queue.put):
        real(self, key, position, prefix)
        most[0] = max(most[0], self.held)

    monkeypatch.setattr(suffixes.Queue, "put", watched)
    with suffixes.Scratch() as scratch:
        path = scratch.name()
        raw.tofile(path)
        text, again, fits = np.memmap(path, np.uint8, "r"), np.zeros(len(raw), bool), np.arange(len(raw)) <= len(raw) - dedup.LENGTH
        dedup._repeated(text, fits, again, scratch, held=20_000, base=5_000)
        assert os.path.isdir(scratch.path)
    assert not os.path.isdir(scratch.path) and most[0] <= 5_000 + 10 * suffixes.CHUNK
    count = Counter(raw[k : k + 200].tobytes() for k in range(len(raw) - 199))
    want = np.array([k + 200 <= len(raw) and count[raw[k : k + 200].tobytes()] > 1 for k in range(len(raw))])
    assert (again == want).all() and want.sum() > 70_000


def _removed(rows):
    count = Counter(raw[k : k + 200] for raw in rows for k in range(len(raw) - 199))
    out = []
    for raw in rows:
        mask = bytearray(len(raw))
        for k in range(len(raw) - 199):
            if count[raw[k : k + 200]] > 1:
                mask[k : k + 200] = b"\1" * 200
        kept = bytes(b for b, m in zip(raw, mask) if not m)
        out.append((len(raw), sum(mask), len([x for x in bytes(mask).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("shard, hot, base", [(4 << 20, 4096, 1 << 21), (2000, 4096, 1 << 21), (4 << 20, 4096, 100), (4 << 20, 1, 1 << 21), (2000, 0, 1 << 21)])
def test_repeated_strings(spark, docs, no_docs, texts, shard, hot, base):
    want = sorted((i, *r) for (i, _), r in zip(texts, _removed([(t or "").encode() for _, t in texts])))
    got = sorted((r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), r["kept_sha256"]) for r in dedup.find_repeats(docs, shard_bytes=shard, hot=hot, held=30_000, base=base).collect())
    assert got == want and sum(r[2] for r in want) > 2000
    assert dedup.find_repeats(no_docs).count() == 0


def test_pipeline_against_its_parts(spark, tmp_path):
    import corpus_pipeline
    from factloom.llm import decontaminate, pii, quality, queries

    sf_dir = "/root/testdata/sf0.001"
    if not os.path.isdir(sf_dir):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept, sf_dir).write.parquet(f"{tmp_path}/{k}")
        kept = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert kept.columns == columns, name
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    net = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    ids = sorted(rows)
    good = [i for i, s in zip(ids, net.score([rows[i] for i in ids])) if s >= queries.KEEP]
    prints = [(i, _fingerprint(rows[i])) for i in good]
    single = sorted(set(_roots(prints)))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = [i for i, g in zip(single, decontaminate.Sketches(items).search([rows[i] for i in single])) if not g]
    trees, limits = pii.model()
    coder = __import__("factloom.llm.bpe", fromlist=["encoder"]).encoder(queries.ranks_path())
    want = {}
    for i in clean:
        text, done, out = rows[i], 0, []
        for s in pii.all_spans(text, trees, limits):
            out += [text[done : max(done, s["start"])], f"[{s['kind'].upper()}]"]
            done = max(done, s["end"])
        text = "".join([*out, text[done:]])
        token_ids, _ = coder.encode([text])
        want[i] = (len(token_ids), hashlib.sha256(",".join(map(str, token_ids.tolist())).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in kept.collect()}
    assert got == want and len(want) < len(rows)
