"""The registered queries themselves, over small tables with awkward rows, against plain reimplementations of their contracts."""

from __future__ import annotations

import glob
import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import pytest

from factloom.llm import arrow, decontaminate, html, queries

from test_corpus_operators import _fingerprint, _removed, _roots
from test_text_operators import _base, _secrets, reference  # noqa: F401

#: Columns whose names operators also use inside.
EXTRA = "least string, bucket string, bin string, id string, component_id string, copies string, h string, base string, spans string, ends string"


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    """A folder of tables: null ids, one id with two texts, repeated rows, empty, null and megabyte texts, clashing columns."""
    rng = random.Random(11)
    words = ["the", "and", "of", "stone", "river", "light", "Haus", "über", "naïve", "日本", "it's", "x1", "42", "a.b@c.de", "10.1.2.3", "token=abcdef12"]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = make(200)
    long = make(220_000)
    texts = [(1, base), (2, base), (2, make(80)), (2, make(80)), (3, None), (4, ""), (None, make(50)), (None, base), (5, long), (6, "z" * 70_000), (7, base + " tail"), (8, f"{make(10)} {base[:400]} {make(10)}"), (9, "Ā and ÿ")]
    texts += [texts[2], (10, None)]
    folder = tmp_path_factory.mktemp("tables")
    clash = ("x",) * 10
    rows = [(i, t, "en", "s", None if t is None else len(t), *clash) for i, t in texts]
    spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(k, k % 2, 0) for k in range(12)] + [(None, 1, 0), (1, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(1, base[:300]), (2, None), (3, ""), (None, base[:300]), (4, "quite unlike anything in there at all")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    pages = [(1, "u", "<article><p>One &amp; two</p></article>"), (1, "u", None), (None, None, ""), (2, "v", "<nav>no</nav>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return str(folder), texts, pages, items


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(spark, name, folder):
    return [r.asDict() for r in queries.QUERIES[name](spark, folder).collect()]


def key(row):
    return tuple("" if v is None else str(v) for v in row)


def same(got, want):
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_op1(spark, awkward):
    folder, texts, *_ = awkward
    got = rows_of(spark, "op1_pii", folder)
    want = []
    for i, t in texts:
        found = sorted(_base(t or ""), key=lambda s: (s[1], ("email", "ip", "card", "phone").index(s[0])))
        n = [sum(s[0] == k for s in found) for k in ("email", "ip", "card", "phone")]
        want.append((i, *n, sha(",".join(f"{k}:{a}:{b}" for k, a, b in found))))
    same([(r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got], want)
    assert sum(w[1] for w in want) > 1000


def test_op2(spark, awkward):
    folder, _, pages, _ = awkward
    want = [(i, u, t, len(t)) for i, u, t in ((i, u, html.main_text(h or "")) for i, u, h in pages)]
    same([(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in rows_of(spark, "op2_html", folder)], want)
    assert ("1", "u", "One & two", "9") in set(map(key, want))


def test_op3(spark, awkward):
    folder, texts, *_ = awkward
    got = rows_of(spark, "op3_quality", folder)
    same([(r["doc_id"], r["held_out"]) for r in got], [(i, None if i is None else zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in texts])
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_op4_and_op9(spark, awkward, reference):  # noqa: F811
    folder, texts, *_ = awkward
    ids = [reference.encode_ordinary(t or "") for _, t in texts]
    want = [(i, len(x), sha(",".join(map(str, x))), sha(t or ""), len((t or "").encode())) for (i, t), x in zip(texts, ids)]
    same([(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["n_bytes"]) for r in rows_of(spark, "op4_bpe", folder)], want)
    same([(r["doc_id"], r["n_tokens"]) for r in rows_of(spark, "op9_token_counts", folder)], [w[:2] for w in want])


def test_op5(spark, awkward):
    folder, texts, *_ = awkward
    order = sorted(((i, t or "") for i, t in texts if i is not None), reverse=True) + sorted(((i, t) for i, t in texts if i is None), key=lambda x: x[1], reverse=True)
    want = []
    for k, (i, t) in enumerate(order):
        after, half = order[(k + 1) % len(order)][1], len(t) // 2
        want.append((i, len(t), sha(t[: len(t) - half] + after[:half])))
    got = rows_of(spark, "op5_fingerprints", folder)
    same([(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got], want)
    prints = {}
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        prints.setdefault((r["doc_id"], r["n_chars"]), r["fingerprint"])
    assert prints[1, len(texts[0][1])] == prints[2, len(texts[0][1])] != prints[8, len(texts[11][1])]


def test_op6(spark, awkward):
    folder, texts, *_ = awkward
    short = [(i, t) for i, t in texts if t is None or len(t) < 100_000]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    from factloom.llm import dedup

    want = [(i, *r) for (i, _), r in zip(short, _removed([(t or "").encode() for _, t in short]))]
    found = dedup.find_repeats(docs.where("text is null or length(text) < 100000")).collect()
    same([(r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), r["kept_sha256"]) for r in found], want)
    whole = rows_of(spark, "op6_repeats", folder)
    same([(r["doc_id"], r["n_bytes"]) for r in whole], [(i, len((t or "").encode())) for i, t in texts])


def test_op7(spark, awkward):
    folder, texts, *_ = awkward
    want = []
    for i, t in texts:
        found = _secrets(t or "")
        want.append((i, *(sum(s[1] == k for s in found) for k in range(3)), sha(",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in found))))
    same([(r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in rows_of(spark, "op7_secrets", folder)], want)


def test_op8(spark, awkward):
    folder, texts, *_ = awkward
    prints = [(float("inf") if i is None else i, _fingerprint(t or "")) for i, t in texts]
    want = [(i, f"{f:016x}", None if c == float("inf") else c) for (i, _), (_, f), c in zip(texts, prints, _roots(prints))]
    same([(r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows_of(spark, "op8_simhash", folder)], want)


@pytest.mark.parametrize("tables", ["awkward", "/root/testdata/sf0.001"])
def test_op10_has_its_twins_rows(spark, awkward, tables):
    folder = awkward[0] if tables == "awkward" else tables
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    if tables == "awkward":  # one id with several texts: the twin takes ids to be distinct, so it is given rows
        items = [t for _, t in awkward[3] if t]
        texts = [t or "" for _, t in awkward[1]]
        hits = decontaminate.Sketches([(k, t) for k, t in enumerate(items)]).search(texts)
        assert len(rows_of(spark, "op10_decontaminate", folder)) == sum(map(len, hits)) > 4
        return
    want = [tuple(map(str, r)) for r in connection.sql(queries.ORACLE_SQL["op10_decontaminate"]).fetchall()]
    got = [(r["doc_id"], r["item_id"], r["n_shared"], r["n_shingles"]) for r in rows_of(spark, "op10_decontaminate", folder)]
    same(got, want)
    assert want


def test_quality_on_labels_held_out(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows_of(spark, "op3_quality", folder) if r["held_out"] and r["doc_id"] in labels]
    assert len(held) > 40 and np.mean([a == b for a, b in held]) > 0.9


def test_pipeline_of_awkward_and_empty_tables(spark, awkward, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{awkward[0]}/documents.parquet")
    for rows in (docs, docs.limit(0)):
        kept = rows
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = f"{tmp_path}/{rows is docs}-{k}"
            stage(spark, kept, awkward[0]).write.parquet(path)
            kept = spark.read.parquet(path)
            assert k == len(corpus_pipeline.STAGES) - 1 or kept.columns == docs.columns, name
        assert kept.count() <= rows.count()
    assert corpus_pipeline.run(spark, awkward[0]).count() > 0


def test_what_operators_leave_is_released(spark):
    rows = arrow.stored(spark.range(3), "left")
    folder = arrow.shared_folder(spark).removeprefix("file://")
    assert rows.count() == 3 and os.path.isdir(folder)
    spark.range(2).write.saveAsTable(f"{arrow.label(spark)}_t")
    arrow.release(spark)
    assert not os.path.isdir(folder) and not spark.catalog.tableExists(f"{arrow.label(spark)}_t")
