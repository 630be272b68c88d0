"""Per-document operators against plain reimplementations."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import unicodedata

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from factloom.llm import bpe, decontaminate, html, pii, quality, secrets, tokencount, winnow

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def by_row(rows, *columns):
    return sorted(tuple(r[c] for c in columns) for r in rows)


def test_bpe_encodes_as_the_library_and_decodes_back(docs, texts, reference):
    found = bpe.encode_documents(docs, PATH)
    want = sorted((i, reference.encode_ordinary(t or "")) for i, t in texts)
    assert sorted((r["doc_id"], list(r["ids"])) for r in found.collect()) == want
    decoded = sorted((r["doc_id"], bytes(r["decoded"]).decode()) for r in bpe.decode_documents(found, PATH).collect())
    assert decoded == sorted((i, t or "") for i, t in texts)
    both = bpe.round_trip(docs, PATH).collect()
    assert sorted((r["doc_id"], list(r["ids"])) for r in both) == want and sorted((r["doc_id"], bytes(r["decoded"]).decode()) for r in both) == decoded
    for r in found.collect():
        assert len(r["ends"]) == len(r["ids"]) and list(r["ends"]) == sorted(r["ends"])


def test_piece_boundaries_on_random_text(reference):
    rng, coder = random.Random(2), bpe.encoder(PATH)
    made = ["".join(rng.choice(" \n\t'stmdrevlxé1２.!　A") for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    ids, stops = coder.encode(made)
    at = [0, *stops.tolist()]
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [reference.encode_ordinary(t) for t in made]


def test_bpe_of_nothing(no_docs):
    assert bpe.decode_documents(bpe.encode_documents(no_docs, PATH), PATH).count() == 0


@pytest.mark.parametrize("block", [3, 64, 1 << 19])
def test_token_counts_cross_blocks(spark, tmp_path, docs, texts, reference, block):
    path = f"file://{tmp_path}/flat"
    rows = docs.select("doc_id", "text").coalesce(1).sortWithinPartitions("doc_id", "text")
    names = tokencount.write_flat(rows, PATH, path)
    separator, kind = tokencount.separator_for(tokencount.vocabulary(PATH))
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "flat").glob("part-*")))
    want = [reference.encode_ordinary(t or "") for _, t in sorted(texts, key=lambda x: (x[0], x[1] is not None, x[1] or ""))]
    assert raw == b"".join(np.array([*ids, separator], kind).tobytes() for ids in want)
    counts = tokencount.count_tokens(spark, path, separator, kind, block_tokens=block).withColumn("file", F.lit(0))
    assert by_row(names.join(counts, ["file", "ordinal"]).collect(), "doc_id", "n_tokens") == sorted((i, len(reference.encode_ordinary(t or ""))) for i, t in texts)


def test_token_counts_of_no_documents(spark, tmp_path, no_docs):
    names = tokencount.write_flat(no_docs, PATH, f"file://{tmp_path}/none")
    assert names.count() == 0 and tokencount.count_tokens(spark, f"file://{tmp_path}/none", *tokencount.separator_for(50256)).count() == 0


def test_separators_are_free_and_text():
    for n, want in ((50256, (0xC480, ">u2")), (100_256, (0x01C280, ">u4")), (65_535, (65_536, ">u4")), (10, (10, ">u2"))):
        got = tokencount.separator_for(n)
        assert got == want and got[0] >= n


def test_cut_token_files_are_refused(spark, tmp_path):
    (tmp_path / "part-0").write_bytes(b"abc")
    with pytest.raises(Exception, match="whole number"):
        tokencount.count_tokens(spark, f"file://{tmp_path}", 50_304, ">u2").count()


def test_token_counts_of_plain_blocks(spark):
    end, kind = tokencount.separator_for(50_256)
    blocks = [("f", 0, [1, 2]), ("f", 1, [3, 4]), ("f", 2, [end, end, 5]), ("f", 3, [6, end]), ("f", 4, [7]), ("g", 0, []), ("h", 0, [end])]
    rows = spark.createDataFrame([(f, b, bytearray(np.array(ids, kind).tobytes())) for f, b, ids in blocks] + [("g", 1, None)], "file string, block long, data binary")
    got = by_row(tokencount.stitched(tokencount.searched_blocks(rows, end, kind)).collect(), "file", "ordinal", "n_tokens", "complete")
    assert got == [("f", 0, 4, True), ("f", 1, 0, True), ("f", 2, 2, True), ("f", 3, 1, False), ("h", 0, 0, True)]


def _base(text):
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    out = []
    for k, p in kinds:
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(d[::-1])) % 10 == 0
            if k == "email" or k == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or k == "card" and 12 <= len(d) <= 19 and luhn or k == "phone" and 9 <= len(d) <= 15:
                out.append((k, *m.span()))
    return sorted(out)


def test_pii_base_spans_on_random_text():
    rng = random.Random(3)
    for alphabet in ("a.@-_1é", "01. -+()@a", "12.3", "0 -4"):
        for _ in range(3000):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert sorted(pii.base_spans(t)) == _base(t)


def test_pii_model_adds_and_refuses():
    trees, limits = pii.model()
    kinds = lambda t: {s["kind"] for s in pii.all_spans(t, trees, limits)}
    assert kinds("call (415) 555-0134 now") == {"local_phone"}
    assert kinds("write to john.doe [at] example.com ok") == {"masked_email"}
    assert kinds("SSN 123-45-6789") == {"identity"}
    assert kinds("IBAN DE89 3704 0044 0532 0130 00") == {"account"}
    for clean in ("on 12/05/2021 at page 20", "isbn 978-3-16-148410-0", "1 234 567 890 people", "version 3.0.12", ""):
        assert not kinds(clean)
    held = pii.samples(600, seed=99)
    p = trees.probability(np.array([pii.features(t, k, a, b) for t, k, a, b, _ in held]))
    assert ((p >= 0.5) == np.array([y for *_, y in held])).mean() > 0.95


def test_pii_recall_and_precision_on_fresh_rows():
    trees, limits = pii.model()
    held = pii.samples(2000, seed=123)
    chosen = trees.probability(np.array([pii.features(t, k, a, b) for t, k, a, b, _ in held])) >= np.array([limits[k] for _, k, *_ in held])
    label = np.array([y for *_, y in held]) == 1
    for kind in pii.MORE_KINDS:
        own = np.array([k == kind for _, k, *_ in held])
        assert (chosen & label & own).sum() / (label & own).sum() > 0.9, kind
        assert (chosen & label & own).sum() / (chosen & own).sum() > 0.9, kind


def test_pii_chooses_among_overlapping_readings():
    trees, limits = pii.model()
    added = lambda t: [t[s["start"] : s["end"]] for s in pii.all_spans(t, trees, limits) if not s["base"]]
    assert added("tel. 030 1234 5678 20 people") == ["030 1234 5678"]
    taken = pii._united([(0, 400), *((20 * k, 20 * k + 5) for k in range(15))])
    assert not pii._free(taken, 330, 345) and pii._free(taken, 400, 410) and not pii._free(taken, 405, 407)


def test_pii_redaction_leaves_each_kind(spark):
    text = "a a@b.co/+1 2345 678901 1.2.3.4 b"
    got = pii.redact(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in got} == {1: "a [EMAIL]/[PHONE][IP] b", 2: None, 3: ""}


def test_pii_tables(docs, no_docs, texts):
    got = {}
    for r in pii.find_spans(docs).collect():
        got[r["doc_id"]] = sorted((s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"])
    assert got == {i: _base(t or "") for i, t in texts}
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert clean.where(F.col("text").contains("[EMAIL]") & F.col("text").contains("[CARD]")).count() == 1
    assert clean.where("text is null").count() == 2
    assert pii.find_spans(no_docs).count() == 0 and pii.redact(no_docs).count() == 0


def test_long_texts_take_linear_time():
    trees, limits = pii.model()
    for t in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1(" * 60_000, "a@" * 60_000):
        pii.all_spans(t, trees, limits)
    for page in ("<" * 50_000, "<div>" * 30_000 + "x", "</div>" * 30_000, "<p title='" * 9000):
        html.main_text(page)


SECRETS = [("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+")]


def _secrets(text):
    out = []
    for order, (kind, p) in enumerate(SECRETS):
        for m in re.finditer(p, text, re.I | re.A if kind == "assign" else 0):
            if kind == "assign" and len(m[2]) >= 6 or kind == "access" and len(m[0]) >= 20 or kind == "hex" and len(m[0]) >= 24:
                out.append((m.start(), order, m.end(), kind))
    return sorted(out)


def test_secrets(spark, docs, no_docs, texts):
    extra = ["secret: token: abcdefgh", "TOKEN='ünï' api_key==x.y/z+1234", "Passwd:" + "a" * 50, "é" * 5 + "AKIA" + "A" * 15 + " AKIAAKIA" + "B" * 16, "deadbeef" * 4 + "g" + "0" * 24]
    words = " ".join(t or "" for _, t in texts)
    planted = "see Zk3Qp9xW7vL2mN8rT4yB6cH1 here or q7Xv2Lm9Kd4Z and ------------------------ //////////////"
    rows = [(i, t) for i, t in enumerate([*extra, planted, None, "", words])]
    model = secrets.ratios(docs)
    found = {r["doc_id"]: r for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"), model=model).collect()}
    for i, t in rows:
        assert [tuple(s) for s in found[i]["base"]] == _secrets(t or "")
        assert {tuple(s) for s in found[i]["base"]} <= {tuple(s) for s in found[i]["spans"]}
    more = [tuple(s) for s in found[len(extra)]["spans"]]
    assert [planted[a:b] for a, _, b, k in more if k == "random"] == ["Zk3Qp9xW7vL2mN8rT4yB6cH1", "q7Xv2Lm9Kd4Z"]
    assert secrets.find_secrets(no_docs).count() == 0


def test_secret_models_on_strings_held_back(spark, docs):
    model = secrets.ratios(docs)
    rows = secrets.samples(docs).where("held").where(F.col("s").rlike(f"^{secrets.TOKEN}$"))
    scored = rows.select("random", (secrets.ratio(F.col("s"), secrets.weights(model[0])) > model[1]).cast("int").alias("hit"))
    share = {r["random"]: r["share"] for r in scored.groupBy("random").agg(F.avg("hit").alias("share")).collect()}
    assert share[True] > 0.98 and share[False] < 0.01


def test_places_of_very_many_matches(spark):
    text = "a" * 9 + "".join(f"k{k:04d}! " for k in range(3000))
    for n in (0, 1, secrets.BLOCK, secrets.BLOCK + 1, 3000):
        cut = text[: 9 + 7 * n]
        got = spark.createDataFrame([(cut,)], "text string").select(secrets.matches(F.col("text"), "k[0-9]{4}").alias("m")).first()["m"]
        assert [(s["start"], s["end"]) for s in got] == [m.span() for m in re.finditer("k[0-9]{4}", cut)]


def _winnowed(h, window=winnow.WINDOW):
    w, out = min(window, len(h)), []
    for s in range(len(h) - w + 1):
        least = min(h[s : s + w])
        p = max(k for k in range(s, s + w) if h[k] == least)
        if p not in out:
            out.append(p)
    return out


def test_winnowing_chooses_rightmost_least(spark, docs, no_docs, texts):
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("text") - winnow.GRAM + 1)), lambda k: F.hash(F.encode(F.substr("text", k, F.lit(winnow.GRAM)), "UTF-32")))
    small = docs.where("length(text) < 2000 or text is null").fillna("", ["text"])
    all_grams = {r["doc_id"]: r["h"] for r in small.select("doc_id", grams.alias("h")).collect()}
    for r in winnow.fingerprints(small).collect():
        want = _winnowed(all_grams[r["doc_id"]])
        assert list(r["positions"]) == want and list(r["hashes"]) == [all_grams[r["doc_id"]][p] for p in want]
    assert winnow.fingerprints(no_docs).count() == 0


def test_edited_texts(spark, docs, no_docs, texts):
    rows = sorted(((i, t or "") for i, t in texts), reverse=True)
    edited = []
    for k, (i, t) in enumerate(rows):
        after, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        edited.append((i, t[: len(t) - half] + after[:half]))
    prints = {}
    for r in winnow.fingerprints(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(edited)], "doc_id long, text string")).collect():
        prints[edited[r["doc_id"]]] = list(r["hashes"])
    got = winnow.compare_edited(docs).collect()
    assert sorted((r["doc_id"], r["edited_sha256"]) for r in got) == sorted((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in edited)
    by_hash = {(i, hashlib.sha256(t.encode()).hexdigest()): h for (i, t), h in prints.items()}
    for r in got:
        assert list(r["edited_hashes"]) == by_hash[r["doc_id"], r["edited_sha256"]]
        a, b = set(r["hashes"]), set(r["edited_hashes"])
        assert r["near_edited"] == pytest.approx(len(a & b) / len(a | b))
    assert winnow.compare_edited(no_docs).count() == 0


def test_neighbours_of_clustered_and_awkward_ids(spark, monkeypatch):
    monkeypatch.setattr(winnow, "BUCKET_CHARS", 500)
    rows = [(k, f"text number {k} " * 5) for k in range(60)] + [(2**62, "far away"), (-(2**61), "far below"), (None, "no id"), (7, "again"), (7, None)]
    got = winnow.compare_edited(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    order = sorted(((i, t or "") for i, t in rows if i is not None), reverse=True) + [(None, "no id")]
    want = []
    for k, (i, t) in enumerate(order):
        after, half = order[(k + 1) % len(order)][1], len(t) // 2
        want.append((str(i), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["edited_sha256"]) for r in got.collect()) == sorted(want)
    chained, _ = winnow.with_next(spark.createDataFrame(rows, "doc_id long, text string"))
    assert chained.groupBy("bucket").agg(F.sum(F.length("text")).alias("n")).agg(F.max("n")).first()[0] < 1500
    assert all(list(r["positions"]) == sorted(r["positions"]) and len(r["positions"]) == len(r["hashes"]) for r in got.collect())


def test_main_text():
    page = """<html><head><title>T</title><script>var a="<p>no</p>"</script></head><body><header><h1>Site</h1><a href=1>Home</a></header>
    <div class="cookie-notice">We use cookies on the site and more of it</div><div class="has-sidebar"><div id="content"><h2>Title &amp; more</h2>
    <p>This is the first paragraph of the article and it is long enough to be good&nbsp;for all of us.<p>Short one.<div class="ad-box">Buy the thing now and get it for free in the shop</div>
    <p>Another of the paragraphs that is long and has many stop words<br>as it should be in the text.</p></div>
    <aside><p>The other article of the day that is long enough to be good for us all.</p></aside><section id="comments"><p>I think that the article is not good and the author should have been more careful.</p></section></div>
    <footer>&copy; all of the rights</footer></body></html>"""
    assert html.main_text(page).split("\n") == ["Title & more", "This is the first paragraph of the article and it is long enough to be good for all of us.", "Short one.", "Another of the paragraphs that is long and has many stop words as it should be in the text."]
    assert html.main_text("<nav><a>x</a></nav><article><h1>A</h1><p><b>B<br><p>C</article><footer>f</footer>") == "A\nB\nC"
    assert html.main_text("") == html.main_text("<article></article>") == ""
    assert html.main_text("<article><p>cut &am") == "cut &am"


GOOD = "This is paragraph {} of the article and it is long enough to be good for all of us."


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><p title=don't>" + GOOD.format(1) + "</p><p>" + GOOD.format(2) + "</p><p title=it's>" + GOOD.format(3) + "</p></article>", [1, 2, 3]),
        ("<article><a href=/x?q=o'neil>x</a><p>" + GOOD.format(1) + "</p></article>", [1]),
        ("<article><!--><p>" + GOOD.format(1) + "</p><!-- a --!><p>" + GOOD.format(2) + "</p><!-- x <p>no</p> --></article>", [1, 2]),
        ("<article><p>İ</p><SCRIPT>var a='<p>no</p>'</SCRIPT><p>" + GOOD.format(1) + "</p></article>", ["İ", 1]),
        ("<article><p a='>'>" + GOOD.format(1) + '</p><p b="x>' + GOOD.format(2) + "</p></article>", [1, 2]),
        ("<div class='cookie-notice'><p>" + GOOD.format(1) + "</p></div><section id=comments><p>" + GOOD.format(2) + "</p></section>", []),
        ("<textarea>" + GOOD.format(1) + "</Textarea ><p>" + GOOD.format(2) + "</p>", [2]),
    ],
)
def test_pages_lose_no_text(page, want):
    assert html.main_text(page) == "\n".join(x if isinstance(x, str) else GOOD.format(x) for x in want)


def test_raw_tags_take_linear_time():
    import time

    def took(n):
        began = time.process_time()
        html.main_text("<script>x</script><p>a b c</p>" * n)
        return time.process_time() - began

    took(500)
    assert min(took(4000) for _ in range(3)) < 12 * max(min(took(500) for _ in range(3)), 0.005)


def test_pages_table(spark):
    rows = [(1, "u", "<article><p>One</p></article>", "t"), (1, "u", "<article><p>One</p></article>", "t"), (2, None, None, None), (None, "v", "", "t")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), keep=("url",)).collect()
    assert sorted((r["page_id"] or 0, r["url"] or "", r["text"]) for r in got) == [(0, "v", ""), (1, "u", "One"), (1, "u", "One"), (2, "", "")]


def test_quality_network_separates_held_out_rows(spark):
    rng = random.Random(9)
    good = lambda: ", ".join(" ".join(rng.choice(["the", "river", "of", "stone", "and"]) for _ in range(9)) for _ in range(4)) + "."
    bad = lambda: " ".join(rng.choice(["THE", "RIVER", "NOISE"]) + "!!" for _ in range(30))
    rows = [(i, good() if i % 3 else bad()) for i in range(400)]
    docs = spark.createDataFrame([*rows, (900, ""), (901, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in rows] + [(902, None)], "doc_id long, quality int")
    net = quality.train(docs, labels)
    got = quality.score_documents(docs, net).withColumn("out", quality.held_out()).collect()
    held = [r for r in got if r["out"] and r["doc_id"] < 900]
    assert len(held) > 40 and all((r["score"] >= 0.3) == (r["doc_id"] % 3 > 0) for r in held)
    assert all(0 <= r["score"] <= 1 for r in got) and len(got) == 402
    kept = quality.without_rejected(docs, net, 0.3)
    assert kept.columns == docs.columns and kept.where("doc_id < 900").count() == sum(1 for r in got if r["doc_id"] < 900 and r["score"] >= 0.3)
    nothing = quality.train(docs.limit(0), labels.limit(0))
    assert set(r["score"] for r in quality.score_documents(docs, nothing).collect()) == {0.5}
    long_text = "x" * 300_000 + "!! "
    assert net.score([long_text])[0] == pytest.approx(net.score([long_text, "short"])[0], abs=1e-6)


def _shingles(text):
    apart = lambda c: not c.isalnum() if c.isascii() else unicodedata.category(c)[0] in "ZPS" or unicodedata.category(c) == "Cc"
    return "".join(" " if apart(c) else c for c in text.lower()).split()


def test_decontamination_is_exact(spark, docs, no_docs, texts):
    long_words = _shingles(texts[12][1])
    items = [(1, " ".join(long_words[500:530])), (2, "The, river: of"), (3, None), (4, ""), (5, " ".join(long_words[100:112]).upper()), (6, "not in any of the documents at all whatever happens"), (1, " ".join(long_words[500:530]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for i, t in texts:
        words = _shingles(t or "")
        for k, x in items:
            w = _shingles(x or "")
            n = min(5, len(w))
            own = {" ".join(w[j : j + n]) for j in range(len(w) - n + 1)} if w else set()
            there = {" ".join(words[j : j + n]) for j in range(len(words) - n + 1)}
            if own and len(own & there) >= 0.8 * len(own) - 1e-9:
                want.append((i, k, len(own & there), len(own)))
    got = decontaminate.find_items(docs, bench)
    assert by_row(got.collect(), "doc_id", "item_id", "shared", "size") == sorted(want) and want
    hit = {i for i, *_ in want}
    clean = decontaminate.without_items(docs, bench)
    assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == sorted(i for i, _ in texts if i not in hit)
    assert decontaminate.find_items(docs, bench.limit(0)).count() == 0 and decontaminate.find_items(no_docs, bench).count() == 0
    parts = list(decontaminate.passes(bench, "text", max_bytes=100))
    assert len(parts) > 1 and sum(map(len, parts)) == len({t or "" for _, t in items})
    assert by_row(decontaminate.find_items(docs, bench, max_bytes=100).collect(), "doc_id", "item_id", "shared", "size") == sorted(want)
    assert sorted(r["doc_id"] for r in decontaminate.without_items(docs, bench, max_bytes=100).collect()) == sorted(i for i, _ in texts if i not in hit)


def test_decontamination_sees_through_punctuation(spark):
    docs = spark.createDataFrame([(1, "He said: “the old stone bridge” — built in 1820 — still carries the road…"), (2, "nothing here")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "the old stone bridge built in 1820 still carries the road"), (None, "the old stone bridge built in 1820 still carries the road")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_items(docs, bench).collect()} == {(1, 7), (1, None)}
    assert [r["doc_id"] for r in decontaminate.without_items(docs, bench).collect()] == [2]
