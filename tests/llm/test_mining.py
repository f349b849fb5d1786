"""Collocations, periodic runs and the URL filter against brute force."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from floodflow.llm import catalog, collocations, runs, url_filter
from floodflow.llm.base import materialize
from floodflow.llm.words import SPACE, Words

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


# --- words ---

def test_words_are_cut_and_numbered_exactly():
    texts = [b"", b" \t", b"a b  a\n", "Ünï ñ".encode(), b"a", b"x" * 70_000 + b" a"]
    w = Words(texts)
    want = [(i, t) for i, text in enumerate(texts) for t in re.findall(rb"[^\x20\x09-\x0D]+", text)]
    vocabulary = w.vocabulary.to_pylist()
    assert [(i, vocabulary[c]) for i, c in zip(w.text.tolist(), w.code.tolist(), strict=True)] == want
    assert [bytes(w.data[a:b]) for a, b in zip(w.start, w.end, strict=True)] == [t for _, t in want]
    assert len(Words([], SPACE).code) == 0


# --- op11 ---

def brute_collocations(rows, least, longest, top):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(ws)
            for k in range(1, longest + 1):
                for i in range(len(ws) - k + 1):
                    f[lang or "und"][tuple(ws[i:i + k])] += 1
    out = []
    for lang, counts in f.items():
        long = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        held = {}
        for p, a in long.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    held[p[i:i + m]] = max(a, held.get(p[i:i + m], 0))
        rows = []
        for p, a in long.items():
            if held.get(p, 0) >= a:
                continue
            score, _, left, r = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]])
                                    for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, r))
        for i, (s, a, p, left, r) in enumerate(sorted(rows)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, r, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("shard,group", [(1 << 13, 256), (400, 2)])
def test_op11_matches_brute_force(spark, monkeypatch, shard, group):
    # The second case needs several tries a length and several passes over the blocks.
    monkeypatch.setattr(collocations, "SHARD_PHRASES", shard)
    monkeypatch.setattr(collocations, "GROUP_SHARDS", group)
    if group == 2:  # slices much shorter than a text, and a vocabulary in several parts
        monkeypatch.setattr(collocations, "SLICE", 997)
        monkeypatch.setattr(collocations, "PART_BYTES", 12_000)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    got = collocations.collocations(docs, least=12, top=40).collect()
    assert sorted(map(tuple, got)) == brute_collocations(rows, 12, 5, 40)


def test_op11_odd_rows(spark, odd_docs, no_docs):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([
        ("A b. a B, c a b", None), ("a b c a b c a b c", "und"), (None, "en"), ("", "en"), (" \t\n", "en"),
        ("x x x x x x x", "en"), ("x x x x x x x", "en"), ("É é É é\x0bÉ é", "en"), ("a b " * 3000, "de")])]
    docs = spark.createDataFrame(rows, "id long, text string, lang string") \
        .selectExpr("text", "lang", "id AS doc_id", "1 AS block", "2 AS codes", "3 AS words", "4 AS id")
    got = collocations.collocations(docs, least=3, top=7).collect()
    assert sorted(map(tuple, got)) == brute_collocations([(lang, t) for _, t, lang in rows], 3, 5, 7)
    got = collocations.collocations(odd_docs, least=2, top=50).collect()
    assert sorted(map(tuple, got)) == brute_collocations([(r["lang"], r["text"]) for r in odd_docs.collect()], 2, 5, 50)
    assert collocations.collocations(no_docs).count() == 0


def test_op11_scores_beyond_64_bits(spark):
    big = 3_000_000_000_000
    row = spark.createDataFrame([(1000, big, 7 * big, big, big)], "t long, a long, n long, l long, r long")
    got = row.select(collocations._exact("t", "a", "n").alias("x"), collocations._exact("l", "r").alias("y")) \
        .selectExpr("x div y AS s").first()
    assert got["s"] == 1000 * big * 7 * big // (big * big)


def test_op11_query_matches_duckdb(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.execute(catalog.SQL["op11_collocations"])
    names = [d[0] for d in want.description]
    got = catalog.QUERIES["op11_collocations"](spark, SF).collect()
    assert sorted(tuple(r[c] for c in names) for r in got) == sorted(want.fetchall())


def test_op11_large_rows_reach_a_worker_one_by_one(spark):
    """Blocks of megabytes do not gather in one Arrow batch; the session's own bound stays."""
    def sizes(it):
        for batch in it:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    bound = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    rows = spark.range(6, numPartitions=1).select(F.expr("repeat('x', 9000000)").cast("binary").alias("codes"))
    made = materialize(rows.mapInArrow(sizes, "n long"), "sizes", collocations.ROW_BYTES)
    assert [r["n"] for r in made.collect()] == [1] * 6
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == bound


def test_op11_large_rows_have_short_pages(spark):
    """Rows of megabytes do not gather in one page, nor in one batch of the reader."""
    rows = spark.range(6, numPartitions=1).select(F.expr("repeat(md5(string(id)), 60000)").cast("binary").alias("codes"))
    made = materialize(rows, "pages", collocations.ROW_BYTES, collocations.READ_ROWS)
    (part,) = made.inputFiles()
    hadoop, jvm = spark.sparkContext._jvm.org.apache.hadoop, spark.sparkContext._jvm
    file = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(hadoop.fs.Path(part), spark._jsc.hadoopConfiguration())
    pages = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(file)
    try:
        groups = pages.getFooter().getBlocks()
        assert sum(pages.readOffsetIndex(g.getColumns()[0]).getPageCount() for g in groups) == 6
    finally:
        pages.close()
    assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "4096"


def test_op11_counts_leave_a_worker_in_short_batches(monkeypatch):
    """An executor holds a batch outside its heap."""
    monkeypatch.setattr(collocations, "COUNT_ROWS", 100)
    codes = np.arange(1, 1000, dtype=np.int32)
    block = pa.RecordBatch.from_arrays([pa.array([codes.tobytes()], pa.binary()), pa.array([(codes * 7).astype(np.int64).tobytes()], pa.binary())],
                                       names=["codes", "ids"])
    got = list(collocations._word_pairs(iter([block])))
    assert max(b.num_rows for b in got) == 100
    pairs = pa.Table.from_batches(got)
    assert sorted(zip(pairs["a"].to_pylist(), pairs["b"].to_pylist(), strict=True)) == [(7 * c, 7 * c + 7) for c in range(1, 999)]
    assert set(pairs["n"].to_pylist()) == {1}


@pytest.mark.parametrize("size", [1, 3, 50])
def test_op11_rows_are_cut_between_phrases(spark, monkeypatch, size):
    """Rows of a block stay small, and no phrase is cut."""
    monkeypatch.setattr(collocations, "SLICE", size)
    rng = np.random.default_rng(size)
    for rare in (0.0, 0.1, 0.6, 1.0):
        codes = np.where(rng.random(400) < rare, 0, rng.integers(1, 9, 400)).astype(np.int32)
        pieces = list(collocations._pieces(codes))
        assert np.concatenate(pieces).tolist() == codes.tolist() and all(len(p) for p in pieces)
        assert all(p[0] == 0 for p in pieces[1:])
        assert all(len(p) <= size or not (p[1:] == 0).any() for p in pieces)


@pytest.mark.parametrize("most", [1, 30, 1 << 19])
def test_op11_a_task_adds_up_its_blocks(monkeypatch, most):
    """Equal pairs of a task's blocks are one row, of as many as it may hold."""
    monkeypatch.setattr(collocations, "MERGE_ROWS", most)
    rng, want, blocks = np.random.default_rng(5), collections.Counter(), []
    for size in (0, 9, 400, 0, 50, 50):
        pair = np.unique(rng.integers(0, 5, (size, 2)) + (1 << 40), axis=0)
        n = rng.integers(1, 4, len(pair))
        want.update({(a, b): k for (a, b), k in zip(pair.tolist(), n.tolist(), strict=True)})
        blocks.append((pair[:, 0], pair[:, 1], n))
    rows = [r for batch in collocations._merged(blocks) for r in zip(*map(pa.Array.to_pylist, batch.columns), strict=True)]
    got = collections.Counter()
    for a, b, n in rows:
        got[a, b] += n
    assert got == want and (most < 30 or len(rows) <= 25 * (1 + (most == 30)))
    assert not list(collocations._merged(blocks[:1]))


def test_op11_trie_holds_its_phrases_only():
    rng = np.random.default_rng(3)
    for length, words, n in ((1, 5, 5), (2, 40, 300), (5, 7, 400), (3, 2000, 500)):
        phrases = np.unique(rng.integers(0, words, (n, length)) * 1_000_003, axis=0)
        trie = collocations.Trie.build(phrases)
        asked = np.r_[phrases, rng.integers(0, words + 3, (n, length)) * 1_000_003]
        state, at = np.zeros(len(asked), np.int64), np.arange(len(asked))
        for d in range(length):
            state = trie.step(state, trie.codes(asked[at, d]))
            at, state = at[state >= 0], state[state >= 0]
        known = {tuple(p): i for i, p in enumerate(phrases.tolist())}
        assert dict(zip(at.tolist(), trie.phrase[state].tolist(), strict=True)) == {
            i: known[tuple(p)] for i, p in enumerate(asked.tolist()) if tuple(p) in known}


# --- op12 ---

def brute_runs(words):
    words, out = np.unique(words, return_inverse=True)[1], []
    seen = set()
    for q in range(1, len(words) // 4 + 1):
        same = np.flatnonzero(np.diff(np.r_[0, (words[q:] == words[:-q]).astype(np.int8), 0]))
        for s, e in zip(same[::2].tolist(), same[1::2].tolist(), strict=True):
            e += q
            if e - s >= max(6, 4 * q) and not any(a <= s and e <= b and q % p == 0 for a, b, p in seen):
                out.append((s, e, q))
        seen.update(x for x in out if x[2] == q)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_op12(doc_id, text, plant):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(ws)
    if plant and doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]
    found = brute_runs(ws) if n else []
    drop = {i for s, e, q in found for i in range(s + q, e)}
    best = min(((s - e, s, q) for s, e, q in found), default=None)
    best = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    said = "".join(f"{s},{e - s},{q}\n" for s, e, q in found)
    kept = " ".join(w for i, w in enumerate(ws) if i not in drop)
    return (doc_id, len(found), *best, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


OP12 = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


@pytest.mark.parametrize("plant", [True, False])
def test_op12_matches_brute_force(spark, odd_docs, plant):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd_docs):
        got = runs.periodic_runs(docs, plant=plant).select(*OP12).collect()
        want = [brute_op12(r["doc_id"], r["text"], plant) for r in docs.collect()]
        assert collections.Counter(map(tuple, got)) == collections.Counter(want)
    assert sum(w[1] for w in want) > 0


def test_op12_repetitive_and_empty(spark, no_docs):
    fib = ["a", "b"]
    while len(fib[-1]) < 3000:
        fib.append(fib[-1] + fib[-2])
    texts = ["a " * 20_000, "a b " * 5000 + "c " * 9, " ".join(fib[-1]), "x\n" * 5, "x " * 6, ("p q r s " * 4) * 3,
             "1 2 3 4 5 6 7 " * 4 + "2 3 4 5 6 7 1 " * 5]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = runs.periodic_runs(docs).select(*OP12).collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == [brute_op12(i, t, False) for i, t in enumerate(texts)]
    assert runs.periodic_runs(no_docs).count() == 0


def test_op12_random_small_alphabets():
    rng = np.random.default_rng(5)
    for _ in range(300):
        docs = []
        for _ in range(rng.integers(1, 4)):
            parts = [np.tile(rng.integers(0, 3, rng.integers(1, 9)), rng.integers(1, 9)) for _ in range(rng.integers(0, 5))]
            docs.append(np.concatenate([np.empty(0, np.int64), *parts]).astype(np.int64))
        doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        start = np.r_[0, np.cumsum([len(d) for d in docs])]
        want = [(s + o, e + o, q) for d, o in zip(docs, start, strict=False) if len(d) for s, e, q in brute_runs(d)]
        assert [tuple(r) for r in runs.find_runs(np.concatenate(docs), doc).tolist()] == want


def test_op12_grammar_derives_its_text():
    rng = np.random.default_rng(8)
    words = np.r_[np.tile(rng.integers(0, 4, 50), 20), rng.integers(0, 4, 500)]
    g = runs.Grammar(words, np.r_[np.ones(len(words) - 1, bool), False])
    assert len(g.heads) + 2 * len(g.left) < len(words) / 2

    def derive(x):
        return [x] if x < g.terminals else derive(g.left[x - g.terminals]) + derive(g.right[x - g.terminals])

    assert sum((derive(x) for x in g.symbol[g.heads]), []) == words.tolist()
    pairs = collections.Counter(zip(g.symbol[g.heads][:-1].tolist(), g.symbol[g.heads][1:].tolist(), strict=True))
    assert all(n == 1 or a == b for (a, b), n in pairs.items())


# --- op13 ---

def brute_rule(url, rules=url_filter.RULES):
    at = (url or "").find("://")
    rest = url[at + 3:] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = host.translate(LOWER)
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, None))
    return host, path, rule, verdict


URLS = ["http://WWW.Example.com/en/1", "https://m.example.com/en/1?x=/fr/", "http://example.com", "http://a.com/",
        "http://acom/en/", "x.net/es/1", "ftp://u.net/es/#a", "http://U.NET/fr/2?q", "http://n.net/de/1", "", None,
        "http://Ünï.net/es/", "http://h.org//a//b", "http://h.org/" + "/".join(str(i) for i in range(5000)),
        "a://b://c.com/en/", "http://h.org/*", "http://h.org/{n}", "http://h.org/[x|..2]", "://", "http://?a", "http://#/x"]


def test_op13_host_path_and_rule(spark):
    for df in (spark.read.parquet(f"{SF}/pages.parquet"),
               spark.createDataFrame([(i, u, "x", "y", "z") for i, u in enumerate(URLS + URLS)],
                                     "page_id long, url string, host string, segs string, template string")):
        got = url_filter.judge(df).collect()
        by_id = {r["page_id"]: r["url"] for r in df.collect()}
        assert len(got) == df.count()
        for r in got:
            host, path, rule, verdict = brute_rule(by_id[r["page_id"]])
            assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
            assert r["verdict"] == verdict if rule else r["verdict"] in ("allow", "block")
    assert url_filter.judge(df.where("page_id < 0")).count() == 0


def test_op13_templates_learn_a_section(spark):
    # One host; /ads/ and /promo/ are bad, /doc/ good, ids vary with and without a form.
    rows, labels = [], []
    for i in range(400):
        part = ("ads", "promo", "doc", "misc")[i % 4]
        tail = (f"{i}.html", f"ab{i}cdef{i}", f"name-{chr(97 + i % 26)}{chr(97 + i // 26)}")[i % 3]
        rows.append((i, f"http://h.org/{part}/{tail}"))
        if i % 3 != 2 and part != "misc":
            labels.append((i, part != "doc"))
    rows.append((None, "http://h.org/ads/1"))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([*labels, (None, True), (1, None)], "page_id long, blocked boolean")
    got = url_filter.judge(pages, labels, rules=()).collect()
    for r in got:
        part = r["path"].split("/")[1]
        assert r["verdict"] == ("block" if part in ("ads", "promo") else "allow"), r
    merged = {r["template"] for r in got if "/ads/" in r["path"] or "/promo/" in r["path"]}
    assert merged <= {"/[ads|..2]/{n}.html", "/[ads|..2]/{n}", "/[ads|..2]/{id}", "/[ads|..2]/*"}
    assert all(r["verdict"] == "allow" for r in url_filter.judge(pages, labels.limit(0), rules=()).collect())


def test_op13_held_out_accuracy(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    got = url_filter.judge(pages).where("rule IS NOT NULL").select("page_id", "verdict").collect()
    truth = {r["page_id"]: r["verdict"] == "block" for r in got}
    taught = spark.createDataFrame([(i, b) for i, b in truth.items() if i % 4], "page_id long, blocked boolean")
    out = {r["page_id"]: r["verdict"] == "block" for r in url_filter.judge(pages, taught, rules=()).collect()}
    held = [i for i in truth if i % 4 == 0]
    assert sum(out[i] == truth[i] for i in held) / len(held) > 0.95
