"""The operators on Spark: nulls, empty and odd texts, repeated rows, clashing columns, empty tables, skew."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from engram.llm import html_text, media, ngram_join, packing, quality, secret_scan, suffix_pieces, token_count, toxicity, url_filter
from engram.operators.graph import connected_components

LONG = " ".join(f"word{i % 97} the and of" for i in range(8000))
TEXTS = [None, "", "  \n ", "One", "a b c d", "The cat sat on the mat and it was warm", "THE CAT SAT ON THE MAT AND IT WAS WARM", LONG, LONG + " end", "token = 'abcdefghijklmnop' é", "x\x85y\x1c z", "idiot here"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 4 == 0 else "src0", len(t or ""), 9, "kept", "x") for i, t in enumerate(TEXTS)]
    rows += [(5, TEXTS[5], "en", "src0", 1, 9, "kept", "x"), (None, "nobody owns this text but it is here", None, None, None, None, None, None)]
    # more columns, named like the operators' own
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words int, kept string, __t string")


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def brute_components(rows):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [x for x in least[find(i)] if x is not None]
        out.append((d, len(sets[i]), d if not sets[i] else min(ids) if ids else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_rows", [2048, 3])
def test_components_equal_brute_force(spark, docs, block_rows):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    words = [f"w{i}" for i in range(60)]
    for k in range(12):  # a group of near copies larger than a block, and one of exact copies
        rows.append((100 + k, " ".join(w if i != k else f"edit{k}" for i, w in enumerate(words * 2))))
    rows += [(200 + k, "exact copy of this short text, many times over") for k in range(8)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(d, block_rows=block_rows).collect()), key=repr)
    assert got == brute_components(rows)


def test_quality_counts(docs):
    def brute(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        at = defaultdict(list)
        for i in range(len(w) - 2):
            at[tuple(w[i : i + 3])].append(i)
        covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered), failed

    got = quality.measure(docs).collect()
    want = {r.doc_id: brute(r.text) for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want[r.doc_id]
        assert not (r.kept and r.base_failed)
    left = quality.keep_good(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {r.doc_id for r in got if r.kept}
    assert "Python" not in left._jdf.queryExecution().toString() and "Arrow" not in left._jdf.queryExecution().toString()


def test_packing_places_every_id_once(docs):
    t = Tokenizer.from_file(packing.default_vocabulary())
    t.encode_special_tokens = True
    ids = defaultdict(list)
    for r in docs.collect():
        ids[r.doc_id].append(t.encode(r.text or "", add_special_tokens=False).ids + [1])
    pieces = packing.pack(docs, window=64).collect()
    offsets, total = defaultdict(int), 0
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == offsets[p.sequence_id] and p.length > 0
        offsets[p.sequence_id] += p.length
        total += p.length
        import numpy as np

        assert any(len(x) == p.doc_tokens and zlib.crc32(np.array(x[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for x in ids[p.doc_id])
    assert total == sum(len(x) for v in ids.values() for x in v)
    full = max(offsets)
    assert sorted(offsets) == list(range(full + 1)) and all(n == 64 for s, n in offsets.items() if s != full)


def test_packing_follows_the_targets(spark):
    d = spark.createDataFrame([(i, "the and of " * 20, "ab"[i % 3 == 0]) for i in range(300)], "doc_id long, text string, source string")
    pieces = packing.pack(d, window=256).join(d.select("doc_id", "source"), "doc_id").collect()
    by = defaultdict(lambda: defaultdict(int))
    for p in pieces:
        by[p.sequence_id // 8][p.source] += p.length
    shares = [v["b"] / sum(v.values()) for k, v in by.items() if k < max(by)]
    assert all(abs(s - 1 / 3) < 0.15 for s in shares)


def test_media_round_trip(docs):
    got = media.round_trip(docs).collect()
    want = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        payload = media.padded(want[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32, r.feature) == (len(want[r.doc_id]), len(payload), zlib.crc32(payload[-32:]), media.features(payload))


def test_archive_ranges_cover_every_member_once(spark, tmp_path):
    w = media.ArchiveWriter(str(tmp_path / "x.zip"))
    for i in range(200):
        w.add(bytes([i]) * (50 + i))
    w.close()
    rows = media.read_archives(spark, [str(tmp_path)], range_bytes=999).collect()
    assert sorted(r.size for r in rows) == [50 + i for i in range(200)]


def test_narrow_operators_keep_rows(docs, nothing):
    n = docs.count()
    model = toxicity.Model({"idiot": 5.0}, (2.0, 4.0))
    for run in (token_count.count_tokens, secret_scan.digest, secret_scan.scan, suffix_pieces.digest, suffix_pieces.encode, quality.measure, lambda d: toxicity.score(d, model), media.round_trip, ngram_join.ngram_components):
        assert run(docs).count() == n and run(nothing).count() == 0
    assert packing.pack(nothing).count() == 0
    assert all(r.restored for r in suffix_pieces.digest(docs).collect())
    assert {r.doc_id for r in toxicity.score(docs, model).where("toxic").collect()} == {11}
    assert toxicity.keep_clean(docs, model).columns == docs.columns and toxicity.keep_clean(docs, model).count() == n - 1
    back = suffix_pieces.decode(suffix_pieces.encode(docs)).collect()
    assert {(r.doc_id, r.text) for r in back} == {(r.doc_id, r.text or "") for r in docs.collect()}


def test_redaction(docs):
    out = secret_scan.redact(docs, length_col="n_chars")
    assert out.columns == docs.columns
    r = out.where("doc_id = 9").first()
    assert r.text == "[SECRET]' é" and r.n_chars == len(r.text) and out.where("doc_id = 5").first().text == TEXTS[5]


def test_pages(spark):
    rows = [(1, "http://A.Example.ORG/es/5?q#f", "<p>x", "v"), (2, None, None, "v"), (3, "no scheme", "", "v"), (4, "http://org?x", "<nav>n</nav>", "v"), (5, "ftp://x.com/de/1/2/3/4/5/6", "<article><p>Body</article>", "v"), (5, "ftp://x.com/de/1/2/3/4/5/6", "<article><p>Body</article>", "v"), (None, "://example.org/en/1x", "<b>t", "v")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(d).collect()}
    assert got == {
        (1, "a.example.org", "/es/5", "example.org/es/", "block"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "org", "", None, "allow"),
        (5, "x.com", "/de/1/2/3/4/5/6", "com/de/", "block"), (None, "example.org", "/en/1x", "example.org/en/1", "block"),
    }
    assert url_filter.judge(d).count() == 7 and url_filter.judge(d.limit(0)).count() == 0
    text = {(r.page_id, r.url, r.text, r.n_chars) for r in html_text.extract(d).collect()}
    assert (5, rows[4][1], "Body", 4) in text and (2, None, "", 0) in text and html_text.extract(d.limit(0)).count() == 0


def test_template_tree_generalises_and_rejects(spark):
    rows = [(i, f"http://h.com/x/shop/item-{i}.html") for i in range(60)] + [(100 + i, f"http://h.com/x/{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'abc'[i % 3]}/end") for i in range(78)]
    d = spark.createDataFrame(rows, "page_id long, url string")
    rules = (url_filter.Rule("h.com/x/shop/item-1", "block"), url_filter.Rule("h.com/x/a", "allow"))
    got = {r.page_id: r for r in url_filter.judge(d, rules).collect()}
    assert got[7].template == "/x/shop/item-{n}.html" and got[7].rule is None and got[7].verdict == "block"
    assert got[101].template == "/x/*/end" and got[101].verdict == "allow"


def test_toxicity_learns_and_leaves_clean_texts(spark):
    rows = [(i, ("you are a total moron today " if i % 5 == 0 else "what a lovely morning ") + f"tail{i % 50}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(1500) if i % 3], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    held = {r.doc_id: r.toxic for r in toxicity.score(docs, model).collect() if r.doc_id % 3 == 0}
    assert all(v == (i % 5 == 0) for i, v in held.items())
    assert not any(r.toxic for r in toxicity.score(docs, toxicity.train(docs, labels.where("toxic = 0"))).collect())
    assert not any(r.toxic for r in toxicity.score(docs, toxicity.train(docs, labels.limit(0))).collect())


def test_components_of_a_long_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(100)], "a long, b long")
    assert {r.root for r in connected_components(e).collect()} == {0}


def test_pipeline_on_a_fixture(spark, tmp_path):
    good = [" ".join(f"the {w}{i}{j} of {w}x{i}{j}" for j, w in enumerate(["river", "stone", "cloud", "field", "house"] * 20)) for i in range(12)]
    rows = [(i, t) for i, t in enumerate(good)]
    rows += [(50, good[3]), (51, good[3].replace("stone31", "stone99")), (60, good[5] + " you moron"), (61, "too short"), (62, "### *** " * 60), (63, good[6].replace("river60", "token = abcdefghijklmnop"))]
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    extra = [(1000 + i, 1, int(i % 2)) for i in range(2)] + [(60, 0, 1)]
    spark.createDataFrame(extra, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        seen[name] = docs.columns
    assert all(c == ["doc_id", "text", "lang", "source", "n_chars"] for n, c in seen.items() if n != "packing")
    ids = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {61, 62, 50}.isdisjoint(ids) and set(range(12)) <= ids and 51 not in ids
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "secrets", "packing"]


@pytest.mark.parametrize("block_rows", [2048, 3])
def test_link_counts_equal_brute_force(spark, block_rows):
    words = [f"w{i}" for i in range(120)]
    rows = [(k, " ".join(w if i != 9 * k else f"edit{k}" for i, w in enumerate(words))) for k in range(12)]  # all pairs link
    rows += [(20 + k, " ".join(words[: 60 + 4 * k])) for k in range(12)]  # a chain, not all pairs of which link
    rows += [(40 + k, rows[3][1]) for k in range(3)] + [(50, None), (51, " "), (52, "alone here"), (None, rows[3][1])]
    rows += [(100 + k, " ".join(f"x{(i * i + 7 * k * (i % 11 == k % 11)) % 90}" for i in range(80))) for k in range(30)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_join.ngram_join(d, block_rows=block_rows).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_components(rows)
    sets = []
    for _, t in rows:
        w = (t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    want = [(d, sum(i != j and bool(s) and 100 * len(s & o) >= 80 * len(s | o) for j, o in enumerate(sets))) for i, ((d, _), s) in enumerate(zip(rows, sets))]
    assert sorted(((r.doc_id, r.n_links) for r in got), key=repr) == sorted(want, key=repr)
    assert dict(want)[3] > 11 and any(0 < n < 11 for _, n in want)
