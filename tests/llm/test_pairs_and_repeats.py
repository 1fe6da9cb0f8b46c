"""Hard negatives, cross-tokenizer alignment and substring dedup against brute force, and their edge cases."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from qualitylake.llm import alignment, hard_negatives, substring_dedup, vectors
from qualitylake.llm.encoding import _byte_letters

# ------------------------------------------------------------------ 11

VECTORS = "vec_id long, embedding array<double>, label int"


def brute_negatives(rows, anchor, k=5, scale=256):
    """By the contract: rows of (id, vector, label) that take part, one per id."""
    v = {i: (np.floor(scale * np.array(e)).astype(int).astype(object), y) for i, e, y in rows}
    out = set()
    for a in filter(anchor, v):
        scores = {i: int(v[a][0] @ v[i][0]) for i in v if i != a}
        first = sorted((i for i in scores if v[i][1] == v[a][1]), key=lambda i: (-scores[i], i))[:k]
        for p in first:
            fine = [i for i in scores if v[i][1] != v[a][1] and 80 * scores[p] <= 100 * scores[i] <= 100 * scores[p]]
            for n, i in enumerate(sorted(fine, key=lambda i: (-scores[i], i))[:k]):
                out.add((a, p, n + 1, i, scores[p], scores[i]))
    return out


def vectors_of(seed, n, dim=8, centres=6, spread=0.15, labels=4):
    r = np.random.default_rng(seed)
    c = r.normal(size=(centres, dim))
    x = c[r.integers(centres, size=n)] + spread * r.normal(size=(n, dim))
    return [(i, [float(t) for t in row], int(y)) for i, (row, y) in enumerate(zip(x / np.linalg.norm(x, axis=1)[:, None], r.integers(labels, size=n)))]


@pytest.mark.parametrize("seed,sizes", [(1, {}), (2, {"block": 16, "group": 3, "sample": 40})])
def test_hard_negatives_equal_brute_force(spark, seed, sizes):
    rows = vectors_of(seed, 400)
    rows += [(1000, rows[3][1], 1), (1100, rows[3][1], 2), (1200, rows[3][1], 1)]
    df = spark.createDataFrame(rows, VECTORS)
    got = [tuple(r) for r in hard_negatives.hard_negatives(df, F.col("vec_id") % 20 == 0, **sizes).collect()]
    want = brute_negatives(rows, lambda i: i % 20 == 0)
    assert want and len(got) == len(want) and set(got) == want


def test_hard_negatives_with_blocks_in_parts(spark):
    rows = vectors_of(5, 300)
    assert vectors.blocks_a_part(300) > 1
    got = [tuple(r) for r in hard_negatives.hard_negatives(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0, block=1, group=3, sample=40).collect()]
    want = brute_negatives(rows, lambda i: i % 20 == 0)
    assert want and len(got) == len(want) and set(got) == want


def test_packed_anchors_are_never_broadcast(spark):
    """Neither pass, however few bytes its anchors are before they stand packed for every part."""
    df = spark.createDataFrame(vectors_of(6, 1000), VECTORS)
    ran, write = [], hard_negatives.materialize

    def kept(step, name):
        if name == "positives":
            step.collect()
            ran.append(step)
        return write(step, name)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(hard_negatives, "materialize", kept)
        got = hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, block=64)
    assert got.collect()
    for pass_ in (*ran, got):
        plan = pass_._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"SortMergeJoin \[part#\d+\]", plan)
        assert not re.search(r"BroadcastHashJoin \[(part#|cell#\d+, block#)", plan)


def test_hard_negatives_odd_rows(spark):
    good = vectors_of(3, 60, dim=3)
    odd = [(None, [1.0, 0.0, 0.0], 1), (100, None, 1), (101, [1.0, None, 0.0], 1), (102, [float("nan"), 0.0, 0.0], 1), (103, [float("inf"), 0.0, 0.0], 2), (104, [1.0, 0.0, 0.0], None), (105, [], 1), (200, [0.5], 1), (7, good[7][1], 99), (300, [0.0, 0.0, 0.0], 2), (400, [-1.0, -1.0, -1.0], 0)]
    df = spark.createDataFrame(good + odd, VECTORS).withColumn("score", F.lit("clash")).withColumn("cell", F.lit(1)).withColumn("positive_id", F.lit(0))
    got = [tuple(r) for r in hard_negatives.hard_negatives(df, F.col("vec_id") % 5 == 0).collect()]
    want = brute_negatives([r for r in good] + [(200, [0.5, 0.0, 0.0], 1), (300, [0.0] * 3, 2), (400, [-1.0] * 3, 0)], lambda i: i % 5 == 0)
    assert len(got) == len(want) and set(got) == want
    empty = hard_negatives.hard_negatives(df.limit(0), F.lit(True))
    assert empty.count() == 0 and empty.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert hard_negatives.hard_negatives(df, F.lit(False)).count() == 0
    huge = [(i, [1e30 * (i + 1), 1.0], i % 2) for i in range(8)]
    assert hard_negatives.hard_negatives(spark.createDataFrame(huge, VECTORS), F.lit(True)).count() > 0


def test_tree_bounds_exclude_candidates_on_clusters():
    """A cluster's anchors bound each other: most candidates of other clusters are never scored."""
    r = np.random.default_rng(5)
    centres = 2000 * r.normal(size=(30, 16))
    x = (centres[r.integers(30, size=3000)] + 40 * r.normal(size=(3000, 16))).astype(np.int64)
    anchors, labels = x[:60], np.zeros(60, int)
    block = hard_negatives.Block.of(np.arange(3000), np.arange(3000) % 3, x)
    tree = hard_negatives.spanning_tree(anchors)
    assert sorted(tree.order) == list(range(60)) and all(tree.parent[a] < 0 or list(tree.order).index(tree.parent[a]) < n for n, a in enumerate(tree.order))
    tops = [int((anchors[a] @ x.T).max()) for a in range(60)]
    windows = [[(top * 9 // 10, top)] for top in tops]
    found, scored = hard_negatives.search(block, np.arange(60), labels, anchors, tree, windows, False, 5)
    assert scored < 60 * 2000 / 2
    for a, _, at, exact in found:
        s = anchors[a] @ x.T
        fine = [j for j in range(3000) if j % 3 != 0 and j != a and windows[a][0][0] <= s[j] <= tops[a]]
        assert [int(j) for j in at] == sorted(fine, key=lambda j: (-s[j], j))[:5] and exact.tolist() == s[at].tolist()


# ------------------------------------------------------------------ 12


def brute_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte = {c: x for x, c in _byte_letters().items()}
    a_bytes = {i: bytes(byte.get(c, 0) for c in t) for t, i in a.get_vocab().items()}
    b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())]
    rows, counts = [], Counter()
    for key, text in texts:
        x, y, data = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text), (" " + text).encode()) if text else ([], [], b" ")
        if b"".join(a_bytes[i] for i in x) != data or b"".join(b_bytes[i] for i in y) != data:
            rows.append((key, 0, 0, [], ""))
            continue
        ends = [{int(e): n for n, e in enumerate(np.cumsum([len(t[i]) for i in ids]))} for t, ids in ((a_bytes, x), (b_bytes, y))]
        groups, links, i, j = [], [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0][e] + 1, ends[1][e] + 1
            groups.append(",".join(map(str, x[i:p])) + "|" + ",".join(map(str, y[j:q])))
            links.append((x[p - 1], y[q - 1]))
            i, j = p, q
        counts.update(links)
        rows.append((key, len(x), len(y), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return [(k, n, m, len(l), len(l), sum(counts[p] == best[p[1]] for p in l), sum(counts[p] for p in l), s) for k, n, m, l, s in rows], counts


ODD = [
    "a\x1cb c", "İstanbul ΣΑΣ straße ǅ é 'S don't 3²½ x<|endoftext|>y", "​ ﻿ z q 　ok \x85w", "", None, " ", "  ", "日本語 テスト 😀😀 a😀b", "\n\nab\tcd  ",
    "\n", "a \n\n  b\t \tx  y", "<s></s><unk> <0x0A>", " " * 40 + "x" + " " * 17, "});\r\n    return x;\r\n", "▁▁a▁b", "it's 'til ' x's\n's", "\t x", "a  b", "é x  y z\x0b w",
    "tail \r\n", " lead", "a" * 3000, "the the the the the", "the the",
]


def invented(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeinorst") for _ in range(r.randrange(1, 8))) + r.choice(["", "", ",", ".\n"]) for _ in range(n))


def test_alignment_equals_brute_force(spark):
    texts = [*enumerate([*ODD, *(invented(k, 40 * k % 300) for k in range(40))]), (None, "the end"), (None, "the end"), (2**60 + 1, "again"), (2**60 + 1, "again the")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3).withColumn("a", F.lit("clash")).withColumn("shard", F.lit(1))
    want, counts = brute_alignment(texts)
    got = [tuple(r) for r in alignment.alignment_report(df).collect()]
    assert Counter(got) == Counter(want)
    pairs = {(r["a"], r["b"]): (r["n_docs"], r["n_links"]) for r in alignment.pair_counts(alignment.pair_index(df, entries=50)).collect()}
    assert {k: v[1] for k, v in pairs.items()} == dict(counts) and all(0 < d <= n for d, n in pairs.values()) and any(d < n for d, n in pairs.values())
    assert alignment.alignment_report(df.limit(0)).count() == 0


def test_alignment_of_a_long_text_and_small_caches():
    from qualitylake.llm.common import tokenizer_path

    paths = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    texts = [invented(k, 900) for k in range(6)] + ["word " * 200_000]
    large, small = alignment.Aligner(*paths), alignment.Aligner(*paths, limit=10)
    whole = [large.align([t])[:2] for t in texts]
    assert [(c.tolist(), d) for c, d in whole] == [(c.tolist(), d) for c, d in (small.align([t])[:2] for t in texts)]
    assert [(k, *c[0].tolist()[:2], d[0]) for k, (c, d) in enumerate(whole)] == [(r[0], r[1], r[2], r[-1]) for r in brute_alignment([*enumerate(texts)])[0]]


def test_planes_and_containers():
    r = np.random.default_rng(1)
    for n in (1, 5, 4096, 4097, 65536):
        docs = np.sort(r.choice(65536, n, replace=False)).astype("<u2")
        assert alignment.planes_of(alignment.container(docs))[0].tolist() == docs.tolist()
    entries = np.sort(np.unique(r.integers(0, 3, 9000) << alignment._DOC | r.integers(0, 65536, 9000)))
    times = r.integers(1, 9, len(entries))
    for a, b, docs, links, data in alignment.postings_of(entries, times):
        mine = entries >> alignment._DOC == (a << alignment._ID | b)
        assert docs == mine.sum() == alignment.merged([data]) and links == times[mine].sum() == sum(len(p) << k for k, p in enumerate(alignment.planes_of(data)))


# ------------------------------------------------------------------ 13


def brute_repeats(rows, window=20):
    """Rows of (doc_id, text); equal rows are one document."""
    import re

    words = {r: re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows}
    seen, gone = set(), {r: set() for r in rows}
    for r in sorted(words, key=lambda r: (r[0] is None, r[0] or 0)):
        for i in range(len(words[r]) - window + 1):
            w = tuple(words[r][i : i + window])
            if w in seen:
                gone[r].update(range(i, i + window))
            seen.add(w)
    return [(r[0], len(words[r]), len(gone[r]), hashlib.sha256(" ".join(x for i, x in enumerate(words[r]) if i not in gone[r]).encode()).hexdigest()) for r in rows]


def repeat_rows(seed, n, vocabulary):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(vocabulary)}"
    passages = [[word() for _ in range(r.randrange(15, 80))] for _ in range(5)]
    out = []
    for i in range(n):
        w = []
        for _ in range(r.randrange(4)):
            p = r.choice(passages)
            a = r.randrange(len(p))
            w += [word() for _ in range(r.randrange(40))] + (p if r.random() < 0.5 else p[a : a + r.randrange(1, 60)])
        out.append((i, r.choice([" ", "\n", "\t "]).join(w)))
    return out


@pytest.mark.parametrize("seed,vocabulary", [(1, 5000), (2, 30), (3, 3), (4, 2)])
def test_repeats_equal_brute_force(spark, seed, vocabulary):
    rows = repeat_rows(seed, 120, vocabulary)
    rows += [(200, "x " * 19), (201, "x " * 20), (202, "x " * 500), (203, "a b " * 300), (204, "b a c " * 100 + "a b " * 40), (205, ""), (206, None), (207, "\x0b "), (208, " ".join(rows[1][1].split()))]
    rows += [(209, "ü\xa0x y " * 30), (210, "ü\xa0x y " * 15), (211, "a\x1cb c d " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("name", F.lit("clash")).withColumn("places", F.lit(1)).withColumn("none", F.lit(2))
    got = [tuple(r) for r in substring_dedup.repeats_report(df).collect()]
    assert Counter(got) == Counter(brute_repeats(rows))
    cleaned = {r["doc_id"]: r for r in substring_dedup.remove_repeats(df).collect()}
    assert cleaned[202]["text"].split() == [] and cleaned[206]["text"] is None and cleaned[200]["text"] == rows[120][1] and set(cleaned[0].asDict()) == set(df.columns)


def test_repeats_of_repeated_and_null_ids(spark):
    text = " ".join(f"t{i}" for i in range(50))
    rows = [(5, text), (5, text), (None, text), (None, "q " + text), (2**60 + 1, text), (2**60, "z " * 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.repeats_report(df).collect())
    assert got == Counter({(5, 50, 0): 2, (2**60 + 1, 50, 50): 1, (None, 50, 50): 1, (None, 51, 50): 1, (2**60, 10, 0): 1})
    assert substring_dedup.repeats_report(df.limit(0)).count() == 0 and substring_dedup.remove_repeats(df.limit(0)).columns == df.columns


def test_equal_windows_pick_equal_symbols():
    """Whatever stands around it, a window picks the symbols that its words alone decide."""
    r = np.random.default_rng(3)
    for width in (2, 4, 1000):
        names = r.integers(1, width + 1, size=20).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        seen = set()
        for _ in range(60):
            before, after = (r.integers(1, width + 1, size=r.integers(0, 30)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(2))
            row = np.concatenate([before, names, after])
            at, name, start = substring_dedup.picks(row, np.array([len(row)]))
            i = int(np.flatnonzero(at == len(before))[0])
            seen.add((int(name[i]), int(start[i]) - len(before)))
        assert len(seen) == 1


def test_quality_sample_spreads_over_the_text(spark):
    from pyspark.sql import functions as F

    from qualitylake.llm import quality

    text = "".join(chr(0x4E00 + i) for i in range(1003))
    df = spark.createDataFrame([(1, text), (2, "short"), (3, "")], "doc_id long, text string")
    got = {r[0]: r[1] for r in df.select("doc_id", quality.spread(F.col("text"), 80)).collect()}
    assert got[2] == "short" and got[3] == ""
    assert len(got[1]) == 80 and got[1][:10] == text[:10] and got[1][-10:] == text[-10:] and len(set(got[1])) == 80
