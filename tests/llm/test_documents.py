"""Document operators against brute force: sf0.001 and hand-made odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from floodflow.llm import (catalog, classifier, decontaminate, jaccard_join, line_dedup, packing, pipeline_stages,
                           quality_rules, repeats, token_index)
from floodflow.llm.base import materialize
from floodflow.llm.blocks import Block
from floodflow.llm.tokens import Encoder
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


@pytest.fixture(scope="module", params=["sf", "odd", "none"])
def docs(request, spark, odd_docs, no_docs):
    if request.param == "sf":
        return spark.read.parquet(f"{SF}/documents.parquet")
    return {"odd": odd_docs, "none": no_docs}[request.param]


def texts(docs):
    """Distinct (doc_id, text) in the operators' order: null ids first."""
    got = {(r["doc_id"], r["text"]) for r in docs.collect()}
    return sorted(got, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))


def by_doc(df, *cols):
    out = collections.Counter()
    for r in df.collect():
        out[(r["doc_id"], *(r[c] for c in cols))] += 1
    return out


def times(docs):
    return collections.Counter((r["doc_id"], r["text"]) for r in docs.collect())


def check(docs, df, cols, want):
    """``want(doc_id, text)`` gives the expected columns of every row."""
    expected = collections.Counter()
    for (d, t), n in times(docs).items():
        expected[(d, *want(d, t))] += n
    assert by_doc(df, *cols) == expected


def test_op1_repeats(docs):
    seen, result = set(), {}
    for d, t in texts(docs):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            k = b[s:s + 100]
            if k in seen:
                gone[s:s + 100] = True
            seen.add(k)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        result[d, t] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    df = repeats.remove_repeats(docs).withColumn("sha", F.sha2("kept", 256))
    check(docs, df, ("n_bytes", "n_removed", "n_spans", "sha"), lambda d, t: result[d, t])


def test_op1_interval_tree_finds_all_maximal_repeats():
    suffixes = [(b"ba", b"xyz"), (b"bc", b"xyz"), (b"ba", b"xyq"), (b"q", b"xyz")]
    got = {(left, right, tuple(m)) for left, right, m in repeats.repeat_groups(suffixes, 3)}
    assert (1, 2, (0, 1, 2)) in got and (2, 2, (0, 2)) in got and (0, 3, (0, 1, 3)) in got
    for left, right, members in got:
        assert len({suffixes[i][0][:left] for i in members}) == 1
        assert len({suffixes[i][1][:right] for i in members}) == 1


def test_op3_decontaminate(spark, docs):
    items = [(1, "the quick brown fox jumps over the lazy dog and runs far away into woods"), (2, "word7 word8"),
             (3, None), (4, "!!"), (None, LONG_ITEM), (1, "the quick brown"), (5, "a")]
    bench = spark.createDataFrame(items, "item_id long, text string").unionByName(
        spark.read.parquet(f"{SF}/benchmark.parquet").selectExpr("item_id + 1000 AS item_id", "text"))
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for r in bench.collect():
        w = word.findall((r["text"] or "").translate(LOWER))
        if w:
            for s in range(max(1, len(w) - 12)):
                windows[tuple(w[s:s + 13])].add("" if r["item_id"] is None else str(r["item_id"]))
    lens = {len(k) for k in windows}

    def want(d, t):
        w = word.findall((t or "").translate(LOWER))
        hit, items = set(), set()
        for n in lens:
            for s in range(len(w) - n + 1):
                if tuple(w[s:s + n]) in windows:
                    hit.update(range(s, s + n))
                    items |= windows[tuple(w[s:s + n])]
        return len(w), len(hit), ",".join(sorted(items)), len(hit) > 0 and 20 * len(hit) >= len(w)

    for limit in (decontaminate.BROADCAST_ROWS, 0):  # the size switch changes no row
        df = decontaminate.judge(docs, bench, limit).withColumn("ids", F.array_join("items", ","))
        check(docs, df, ("n_words", "n_hit", "ids", "contaminated"), want)


LONG_ITEM = " ".join(f"word{i}" for i in range(10, 30))


def test_op4_packing(docs):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    df = packing.pack(materialize(packing.pieces(docs)))
    rows = df.collect()
    want = collections.Counter()
    for (d, t), n in times(docs).items():
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        size, at, k = (len(ids) - 1) % 1024 + 1, 0, 0
        while at < len(ids):
            want[(d, k, at, size, np.array(ids[at:at + size], "<u4").tobytes())] += n
            at, k, size = at + size, k + 1, 1024
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in rows) == want
    per = collections.defaultdict(list)
    for r in rows:
        per[r["sequence_id"]].append((r["offset"], r["length"]))
    for spots in per.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r["length"] for r in rows)
    assert len(per) <= -(-total // 1024) * 1.05 + 1


def test_op4_pieces_are_put_together():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, enc = Tokenizer.from_file(path), Encoder(path, "space_prefix")
    rnd, asked = random.Random(4), []
    plain = enc._pack
    enc._pack = lambda texts: asked.extend(texts) or plain(texts)
    words = ["".join(rnd.choice("abcdeéß") for _ in range(6)) for _ in range(300)]
    rows = [" ".join(w + "$$$" for w in words), "\n".join(w + "!?" for w in words)]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(rows)] == [
        tok.encode(t, add_special_tokens=False).ids for t in rows]
    assert len(asked) <= 2  # marks after a word are not encoded with each word anew
    parts = [" ", "\n", "a", "é", "\t", "'s", "<|endoftext|>", ".", "$$", "1", "\u00a0", "  ", "\n\n", "word", "'", "_"]
    rows = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9))) for _ in range(3000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(rows)] == [
        tok.encode(t, add_special_tokens=False).ids for t in rows]


def test_op4_plan_uses_every_length_once():
    rng = np.random.default_rng(3)
    hist = np.zeros(65, np.int64)
    hist[1:] = rng.integers(0, 50, 64)
    groups = packing.plan(hist, 64)
    used = np.zeros(65, np.int64)
    for lengths, n in groups:
        assert sum(lengths) <= 64
        for v in lengths:
            used[v] += n
    assert (used == hist).all()
    # no packing needs fewer: by total length, and no two pieces over half share a sequence
    least = max(-(-int((hist * np.arange(65)).sum()) // 64), int(hist[33:].sum()))
    assert sum(n for _, n in groups) <= least * 1.04 + 1


def shingles(t, k=4):
    w = WORD.findall((t or "").translate(LOWER))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        low.setdefault(r, d)
    return {rows[i]: (len(sets[i]), low[root(i)]) for i in range(len(rows))}


def test_op5_components(docs):
    want = brute_components(texts(docs))
    df = jaccard_join.join_components(docs)
    check(docs, df, ("n_shingles", "component_id"), lambda d, t: want[d, t])


def test_op5_chains_and_borderline_copies(spark):
    """Edited copies that link through each other only, in a large group."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for d in range(150):
        w = list(base)
        for at in rng.choice(120, rng.integers(0, 6), replace=False):
            w[at] = f"z{rng.integers(0, 40)}"
        rows.append((d, " ".join(w)))
    want = brute_components(rows)
    got = jaccard_join.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {d: want[d, t][1] for d, t in rows}


def test_op5_large_sets_that_share_a_passage_are_no_pairs(spark):
    """A parity bitmap says nothing of sets of thousands; near copies of them are still found."""
    rng = np.random.default_rng(8)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(d, passage + " " + " ".join(f"w{w}" for w in rng.choice(10**6, 1200 + 150 * d))) for d in range(12)]
    near = rows[3][1].split()
    near[40:60] = [f"z{i}" for i in range(20)]
    rows.append((99, " ".join(near)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    none = jaccard_join.Orders(np.empty(0, np.uint64), np.empty(0, np.int64))
    sets = materialize(jaccard_join.signatures(docs, none), "sets").withColumn("comp", F.col("cls"))
    spots = sets.select("cls", "n", "score", "comp", F.posexplode("pre").alias("pos", "t"))
    every = spots.unionByName(sets.select("cls", "n", "score", "comp", F.lit(0).alias("pos"), F.lit(0).cast("long").alias("t")))
    assert jaccard_join._all_pairs(every, sets.drop("pre", "comp", "score", "doc"), 85).count() == 1
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.join_components(docs).collect()}
    assert got == {d: 3 if d == 99 else d for d, _ in rows}


@pytest.mark.parametrize("size", [1000, 1100, 1500, 1700, 4000])
def test_op5_sketches_bound_the_difference(spark, size):
    """Sets on both sides of a sketch's bounds: similar ones always pass."""
    rng = np.random.default_rng(size)
    all_ = rng.integers(0, 2**63, size * 2, dtype=np.uint64)
    low, high = jaccard_join._LARGE
    rows = []
    for cut in (0, size // 20, size // 13):
        for s, side in ((all_[:size], "a"), (np.r_[all_[cut:size], all_[size:size + cut // 2]], "b")):
            rows.append((cut, side, len(s), jaccard_join.parity(s).tolist() if len(s) <= high else None,
                         jaccard_join.counts(s).tolist() if len(s) > low else None))
    made = spark.createDataFrame(rows, "cut int, side string, n long, bits array<long>, cells array<byte>")
    a, b = (made.where(F.col("side") == x).select("cut", *[F.col(c).alias(p + c) for c in ("n", "bits", "cells")])
            for x, p in (("a", ""), ("b", "h")))
    assert a.join(b, "cut").where(jaccard_join._near("", "h", "n", "hn", 85)).count() == 3


def test_op5_a_late_shared_token_makes_no_pair(spark):
    """What two sets share comes after their first shared token: too little is left here."""
    spots = spark.createDataFrame([(1, 100, 0, 7), (2, 100, 8, 7), (3, 100, 9, 7)], "cls long, n long, pos int, t long")
    a, b = (spots.select("t", *[F.col(c).alias(p + c) for c in ("cls", "n", "pos")]) for p in ("", "h"))
    pairs = a.join(b, "t").where("cls < hcls").where(jaccard_join._fits("n", "pos", "hn", "hpos", 85))
    assert [(r["cls"], r["hcls"]) for r in pairs.collect()] == [(1, 2)]


def test_op5_texts_are_joined_by_a_shuffle_above_the_bound(spark, odd_docs, monkeypatch):
    want = collections.Counter(map(tuple, jaccard_join.join_components(odd_docs).collect()))
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 0)
    assert collections.Counter(map(tuple, jaccard_join.join_components(odd_docs).collect())) == want


def test_op5_buckets_are_dealt_in_passes(spark, monkeypatch):
    made = []
    monkeypatch.setattr(jaccard_join, "materialize", lambda df, name: made.append(name) or materialize(df, name))
    rows = [(c, 9, 0.0, [c, 100 + c % 3, -7]) for c in range(9)]
    got = jaccard_join._buckets(spark.createDataFrame(rows, "cls long, n long, score double, pre array<long>"))
    assert made == ["shingle-buckets"] * jaccard_join.PASSES > ["shingle-buckets"]
    assert sorted((r["t"], r["cls"], r["pos"], r["comp"]) for r in got.collect()) == sorted(
        [(100 + c % 3, c, 1, c) for c in range(9)] + [(-7, c, 2, c) for c in range(9)])


def test_pipeline_moves_keys_instead_of_texts(spark, monkeypatch):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # only what is asked for is broadcast
    try:
        rows = [(i, " ".join(f"{'ab'[i % 2]}{i // 2 * j}" for j in range(30))) for i in range(40)]
        docs = spark.createDataFrame(rows + [(50, rows[0][1]), (2, rows[2][1]), (None, None)], "doc_id long, text string")
        docs = materialize(docs, "docs")

        def plan(df):
            return df._jdf.queryExecution().executedPlan().toString()

        want = {}
        for most in (2_000_000, 0):  # the bound changes no row
            monkeypatch.setattr(pipeline_stages, "BROADCAST_ROWS", most)
            for stage in (pipeline_stages.ngram_jaccard_join, pipeline_stages.benchmark_decontamination):
                out = stage(spark, docs, SF)
                if most:
                    alone = plan(out).split("Union")[-1].split("HashAggregate")[0]
                    assert "BroadcastHashJoin" in alone and "SortMergeJoin" not in plan(out)
                got = collections.Counter(map(tuple, out.collect()))
                assert want.setdefault(stage.__name__, got) == got
        assert want["ngram_jaccard_join"][rows[2]] == 1 and (50, rows[0][1]) not in want["ngram_jaccard_join"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_labelled_statistics_take_ids_in_parts(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    known = materialize(docs.select("doc_id").where("doc_id % 3 = 0").distinct(), "known")
    n, seen = known.count(), []
    for most in (n, -(-n // 3), 1):  # one part, three parts, too many parts: joined by a shuffle
        monkeypatch.setattr(pipeline_stages, "BROADCAST_ROWS", most)
        seen.append(sorted((r["doc_id"], r["n_words"]) for r in pipeline_stages._labelled(docs, known).collect()))
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) >= n


def test_op6_places_are_joined_by_a_shuffle_above_the_bound(spark, odd_docs, monkeypatch):
    want = collections.Counter(map(tuple, line_dedup.dedup_lines(odd_docs, 1).collect()))
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    assert collections.Counter(map(tuple, line_dedup.dedup_lines(odd_docs, 1).collect())) == want


def test_op6_words_are_split_at_every_blank_and_sorted_as_numbers(spark):
    line = "Aa\tb\x0bC\x0cd\re  f g\u00a0h "
    df = spark.createDataFrame([(line,), ("",), (None,)], "line string")
    got = [r[0] for r in df.select(line_dedup._words(F.col("line"))).collect()]
    assert got == [["aa", "b", "c", "d", "e", "f", "g\u00a0h"], [], []]
    h = df.where("line != ''").select(line_dedup._ordered(line_dedup._hashes(F.col("line")), bytes(line_dedup.BUCKETS)).alias("h"))
    assert not h.schema["h"].dataType.containsNull  # arrays that may hold nulls are sorted as objects


def test_op6_lines(docs):
    seen, gone = [], {}
    for d, t in texts(docs):
        for no, line in enumerate(t.split("\n") if t is not None else []):
            w = set(WORD.findall(line.lower()))
            if len(w) >= 5:
                gone[d, t, no] = any(5 * len(w & o) >= 4 * len(w | o) for o in seen)
                seen.append(w)

    def want(d, t):
        if t is None:
            return 0, 0, None
        lines = t.split("\n")
        kept = [x for no, x in enumerate(lines) if not gone.get((d, t, no))]
        return len(lines), len(lines) - len(kept), "\n".join(kept)

    df = line_dedup.dedup_lines(docs)
    assert set(docs.columns) <= set(df.columns)
    check(docs, df, ("n_lines", "n_removed", "text"), want)


def test_op9_round_trip(spark, docs):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = token_index.lookup(spark, token_index.write(docs), docs.select("doc_id")).collect()
    want, order = collections.Counter(), []
    for (d, t), n in times(docs).items():
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        want[(d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += n
    assert collections.Counter((r["doc_id"], r["n_tokens"], zlib.crc32(r["ids"])) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
        order.append(r["doc_id"] if r["doc_id"] is not None else -1)
    assert order == sorted(order)


def test_op9_absent_keys_give_no_row(spark, odd_docs):
    keys = spark.createDataFrame([(77,), (6,)], "doc_id long")
    assert [r["doc_id"] for r in token_index.lookup(spark, token_index.write(odd_docs), keys).collect()] == [6]


def test_op9_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64))
    slots = token_index.PerfectHash.build(keys).slots(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))


def test_op10_base_statistics(docs):
    def want(d, t):
        t = t or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        count = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if count[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
        return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)),
                len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w))

    check(docs, quality_rules.statistics(docs), ("n_words", "word_chars", "n_symbols", "n_dup_lines",
                                                 "n_repeat_words", "base_failed"), want)


def test_op10_rules_from_labels_only(spark, odd_docs):
    none = spark.createDataFrame([(None, 0), (1, None), (999, 1)], "doc_id long, quality int")
    out = quality_rules.judge(odd_docs.select("doc_id", "text"), none).collect()
    assert len(out) == odd_docs.count() and all(r["kept"] == (not r["base_failed"]) for r in out)


def test_op10_learns_symbol_rule(spark):
    df = catalog.QUERIES["op10_quality_rules"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = df.join(labels, "doc_id").groupBy("quality").agg(
        F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r["quality"]: r["kept"] for r in got}
    assert kept[0] < 0.1 and kept[1] > 0.95


def test_op2_held_out_accuracy(spark):
    df = catalog.QUERIES["op2_quality_classifier"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    right = df.join(labels, "doc_id").where("held_out").select(
        F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert right > 0.93
    assert df.where("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_op2_odd_rows(spark, docs):
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 0), (6, None), (1, 1)], "doc_id long, quality int")
    rows = classifier.score_quality(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
               for r in rows)


def test_op6_large_group_of_near_lines(spark):
    """Edited lines on both sides of the threshold: leaders settle some, the join the rest."""
    rng = np.random.default_rng(6)
    base, rows = [f"w{i}" for i in range(40)], []
    for d in range(200):
        w = list(base)
        for at in rng.choice(40, rng.integers(0, 7), replace=False):
            w[at] = f"z{rng.integers(0, 30)}"
        rows.append((d, " ".join(w) + "\n" + " ".join(w[::-1][:30])))
    seen, want = [], {}
    for d, t in rows:
        for no, line in enumerate(t.split("\n")):
            w = set(line.split())
            want[d, no] = any(5 * len(w & o) >= 4 * len(w | o) for o in seen)
            seen.append(w)
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = {r["doc_id"]: r["text"] for r in got}
    assert kept == {d: "\n".join(x for no, x in enumerate(t.split("\n")) if not want[d, no]) for d, t in rows}
    assert 0 < sum(not x for x in want.values()) < len(want)


def test_op6_long_lines_that_share_few_words_are_no_candidates(spark):
    """Bitmaps of 64 bits let most pairs of long lines pass, whatever their words."""
    rng = np.random.default_rng(7)
    rows = [(d, "shared " + " ".join(f"w{w}" for w in rng.choice(100_000, 159, replace=False))) for d in range(120)]
    near = rows[0][1].split()
    near[5:11] = [f"z{i}" for i in range(6)]
    rows.append((999, " ".join(near)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # One word is the rarest of all, so all lines meet in its group.
    rarity = bytearray(b"\x10" * line_dedup.BUCKETS)
    rarity[spark.range(1).select(F.xxhash64(F.lit("shared"))).first()[0] & (line_dedup.BUCKETS - 1)] = 0
    lines = line_dedup.line_sets(docs, bytes(rarity))
    none = spark.createDataFrame([], "late long")
    assert line_dedup._candidates(lines, none).count() == 1


def test_op6_pairs_meet_at_words_that_can_be_their_first(spark, monkeypatch):
    made, meeting = [], line_dedup._meeting

    def counted(a, b):
        made.append(meeting(a, b).count())
        return meeting(a, b)

    monkeypatch.setattr(line_dedup, "_meeting", counted)
    common = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*common, f"own{i}"])) for i in range(20)]
    rows += [(20 + i, " ".join(common[i:] + [f"x{i}"])) for i in range(6)]  # fewer words, to four fifths
    lines = line_dedup.line_sets(spark.createDataFrame(rows, "doc_id long, text string"), bytes(line_dedup.BUCKETS))
    sets = [set(t.split()) for _, t in rows]
    want = sum(10 * len(a & b) >= 8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    none = spark.createDataFrame([], "late long")
    assert line_dedup._candidates(lines, none).count() >= want
    assert sum(made) <= 5 * 26 * 25 // 2  # nine words of every line go into the join


def test_op6_no_candidates_for_a_settled_later_line(spark):
    """The first line of a group stays open, but settled later lines need no pair with it."""
    words = [f"w{i}" for i in range(40)]
    rows = [(d, " ".join(words[:d] + [f"z{d}"] + words[d + 1:])) for d in range(30)]
    lines = line_dedup.line_sets(spark.createDataFrame(rows, "doc_id long, text string"), bytes(line_dedup.BUCKETS))
    settled = lines.where("doc > 0").select(F.col("set").alias("late"))
    assert line_dedup._candidates(lines, settled.where("false")).count() == 30 * 29 // 2
    assert line_dedup._candidates(lines, settled).count() == 0


def test_scratch_tables_leave_no_shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {x for x in str(blocks.getAllFiles().mkString("\n")).split("\n") if "shuffle_" in x}

    before = shuffled()
    out = materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "shuffled")
    assert not {x for x in shuffled() - before if x.endswith(".data")}
    assert out.count() == 7


def test_op6_short_lines(spark, odd_docs, tmp_path):
    """The query has no least number of words: one to four count like others."""
    short = spark.createDataFrame(
        [(20, "All rights reserved.\na b c d\n\n \t\nunique"), (21, "all  RIGHTS reserved.\na b c d e\n\nother"),
         (22, "go go go go\nd c b a\nall rights"), (23, "go\n" * 50 + "e d c b a"), (24, "c a b"), (25, "a b c")],
        "doc_id long, text string")
    made = short.unionByName(odd_docs.select("doc_id", "text"))
    made.write.parquet(f"{tmp_path}/documents.parquet")
    for sf in (str(tmp_path), SF):
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        seen, firsts, gone = [], set(), {}
        for d, t in texts(docs):
            for no, line in enumerate(t.split("\n") if t is not None else []):
                w = frozenset(WORD.findall(line.lower()))
                if w:
                    gone[d, t, no] = w in firsts or any(5 * len(w & o) >= 4 * len(w | o) for o in seen)
                    if w not in firsts:
                        seen.append(w)
                    firsts.add(w)

        def want(d, t):
            if t is None:
                return 0, 0, None
            lines = t.split("\n")
            kept = [x for no, x in enumerate(lines) if not gone.get((d, t, no))]
            return len(lines), len(lines) - len(kept), "\n".join(kept)

        check(docs, catalog.QUERIES["op6_line_dedup"](spark, sf), ("n_lines", "n_removed", "text"), want)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(short, min_words=1).collect()}
    assert got[21] == "\nother" and got[22] == "go go go go\nall rights" and got[23] == "" and got[25] == ""


def test_op1_tells_null_ids_with_one_hash_apart(spark):
    body = " ".join(f"v{i}" for i in range(60))
    made = spark.range(300_000).select(F.concat(F.lpad(F.col("id").cast("string"), 8, "0"), F.lit(body)).alias("text"))
    x, y = (made.groupBy(F.hash("text")).agg(F.min("text").alias("x"), F.max("text").alias("y"))
            .where("x < y").select("x", "y").first())
    docs = spark.createDataFrame([(None, x), (None, y)], "doc_id long, text string")
    got = sorted(r["n_removed"] for r in repeats.remove_repeats(docs).collect())
    assert got[0] == 0 and got[1] >= len(body)


def thue_morse(n):
    out = "a"
    while len(out) < n:
        out += out.translate(str.maketrans("ab", "ba"))
    return out


def test_op5_words_made_to_collide_stay_apart(spark):
    for n in (1024, 4096):
        word = thue_morse(n)
        other = word.translate(str.maketrans("ab", "ba"))
        b = Block([word.encode(), other.encode(), word.encode()])
        h = b.range_hash(b.starts, b.ends)
        assert h[0] != h[1] and h[0] == h[2]
    docs = spark.createDataFrame([(1, word), (2, other), (3, word)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.join_components(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_op5_pairs_meet_under_every_order_before_texts_move(spark, monkeypatch):
    seen = []
    share = jaccard_join._share

    def counted(pairs, fronts):
        out = share(pairs, fronts)
        seen.append((pairs.count(), out.count()))
        return out

    monkeypatch.setattr(jaccard_join, "_share", counted)
    jaccard_join.join_components(spark.read.parquet(f"{SF}/documents.parquet")).count()
    assert all(a >= b for a, b in seen) and sum(b for _, b in seen) > 0


def test_clashing_helper_columns_survive(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l", "x", "y", "z")],
                                 "doc_id long, text string, _s string, _rk string, _doc string")
    got = quality_rules.statistics(docs)
    assert got.columns[:5] == docs.columns and got.first()["_s"] == "x" and got.first()["n_words"] == 12
    for stage in (pipeline_stages.ngram_jaccard_join, pipeline_stages.benchmark_decontamination):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.first()["_rk"] == "y"
