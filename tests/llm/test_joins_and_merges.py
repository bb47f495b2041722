"""Cross-tokenizer alignment, the Jaccard join and centroid clustering against brute force, and on odd rows."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelfx.llm import align, centroids, overlap
from panelfx.llm.queries import tokenizer_path
from test_text_operators import ODD, empty, odd, plain_components

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


# --------------------------------------------------------------------------- alignment


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path(A))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(B))
    letters = {c: n for n, c in enumerate(align.byte_letters())}

    def tokens(text):
        """(id, bytes) of both sides by whole-text calls of the two libraries."""
        if not text:
            return [], []
        e = a.encode(" " + text, add_special_tokens=False)
        left = [(i, bytes(letters[c] for c in t)) for i, t in zip(e.ids, e.tokens)]
        right = []
        for i in b.encode(text):
            p = b.id_to_piece(i)
            right.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        if b"".join(x for _, x in left) != whole or b"".join(x for _, x in right) != whole:
            return [], []
        return left, right
    return tokens


def plain_alignment(rows, tokens):
    sides, links = [], []
    for _, text in rows:
        both = []
        for side in tokens(text):
            end, ends = 0, {}
            for k, (i, data) in enumerate(side):
                end += len(data)
                ends[end] = k, i
            both.append((side, ends))
        sides.append(both)
        links.append([(both[0][1][e][1], both[1][1][e][1]) for e in sorted(both[0][1].keys() & both[1][1].keys())])
    count = collections.Counter(x for ls in links for x in ls)
    highest = collections.Counter()
    for (_, b), n in count.items():
        highest[b] = max(highest[b], n)
    out = []
    for (doc, _), ((left, ends_a), (right, ends_b)), ls in zip(rows, sides, links):
        groups, x, y = [], 0, 0
        for e in sorted(ends_a.keys() & ends_b.keys()):
            i, j = ends_a[e][0] + 1, ends_b[e][0] + 1
            groups.append(",".join(str(t) for t, _ in left[x:i]) + "|" + ",".join(str(t) for t, _ in right[y:j]))
            x, y = i, j
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if left else ""
        out.append((doc, len(left), len(right), len(groups), len(ls), sum(count[x] == highest[x[1]] for x in ls), sum(count[x] for x in ls), sha))
    return out


HARD = ["a  b", " lead", "trail ", "tab\there\n\nline \n  x", "a▁b c", "x ▁y", "nul\0 z", "<|endoftext|> <s> </s> <unk> <0x41>", "naïve ﬁ Å é 日本語 текст 😀👍🏽",
        "a b c　d e f", "x\x1cy z\x1d w", " ", "\n", "it's we'll DON'T 12345 3.14 --- ___", "word " * 3000, "q" * 5000, "é" * 700 + " " + "\U0001f600" * 300]


def test_alignment(spark, texts, tokenizers):
    rows = texts + [(5000 + k, t) for k, t in enumerate(HARD)] + [(5000, "a repeated id"), (None, "no id"), (5100, None), (5101, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pair", F.lit("clash")).withColumn("n", F.lit(0)).repartition(5)
    got = align.digests(df, tokenizer_path(A), tokenizer_path(B))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = plain_alignment(rows, tokenizers)
    assert collections.Counter(tuple(r) for r in got.collect()) == collections.Counter(want)
    assert sum(r[1] == 0 for r in want) >= 4


def test_alignment_positions(spark, texts, tokenizers):
    rows = texts[:20] + [(7001, HARD[8]), (7002, "a▁b"), (7003, None)]
    got = {r["doc_id"]: r for r in align.align(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path(A), tokenizer_path(B)).collect()}
    for doc, text in rows:
        left, right = tokenizers(text)
        r = got[doc]
        assert (r["a"], r["b"]) == ([i for i, _ in left], [i for i, _ in right]) and len(r["link_a"]) == len(r["link_b"])
        ends = [np.cumsum([len(d) for _, d in side]) for side in (left, right)]
        assert [int(ends[0][i]) for i in r["link_a"]] == [int(ends[1][j]) for j in r["link_b"]] == sorted(set(ends[0].tolist()) & set(ends[1].tolist()))


def test_lockstep_over_walks():
    rng = np.random.default_rng(3)
    for n in (1, 2, 9, 500):
        x, y = np.unique(rng.integers(0, 3 * n, n)), np.unique(rng.integers(0, 3 * n, n))
        for walk in (1, 2, 7, 1000):
            i, j = align.lockstep(x, y, walk)
            both = np.intersect1d(x, y)
            assert x[i].tolist() == y[j].tolist() == both.tolist()


def test_alignment_odd(spark):
    got = align.digests(odd(spark), tokenizer_path(A), tokenizer_path(B)).collect()
    assert len(got) == len(ODD) and {(r["n_a"], r["groups_sha256"]) for r in got if r["doc_id"] in (900, 901)} == {(0, "")}
    assert align.digests(empty(spark), tokenizer_path(A), tokenizer_path(B)).count() == 0
    assert align.align(empty(spark), tokenizer_path(A), tokenizer_path(B)).count() == 0


def test_linked_pairs_are_bounded(texts):
    both = align.Pair(*align.load(tokenizer_path(A), tokenizer_path(B)))
    assert len(np.unique(both.align([t for _, t in texts]).pairs())) < both.bound() < 1_000_000


# --------------------------------------------------------------------------- centroid clustering


def plain_clusters(rows, k=16, rounds=3, dims=64, scale=64):
    """Integers of any size, one distance after the other."""
    kept = [(i, [math.floor(scale * float(np.float32(c))) for c in v]) for i, v in rows
            if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    digest = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest()
    order = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else digest(r[0]), r[1]))
    means = [x for _, x in order[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, m)), c) for c, m in enumerate(means))

    for _ in range(rounds):
        own = [nearest(x)[1] for _, x in kept]
        for c in range(len(means)):
            members = [x for (_, x), o in zip(kept, own) if o == c]
            if members:
                means[c] = [sum(col) // len(members) for col in zip(*members)]
    got = [(i, *nearest(x)) for i, x in kept]
    per = collections.Counter()
    for _, d, c in got:
        per[c] += d
    return collections.Counter((i, c, d, per[c], sum(per.values()), ",".join(map(str, means[c]))) for i, d, c in got)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("clash") for c in ("x", "cluster", "near", "n", "v")})


def test_centroids(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(9, 64)) * 3
    rows = [(i, (centers[i % 9] + rng.normal(size=64) * 0.3).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]                        # a very common vector
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1])]             # repeated rows, one id twice, no id
    rows += [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [None] + [0.0] * 63), (2004, [float("nan")] * 64), (2005, [float("inf")] + [0.0] * 63)]
    rows += [(2006, [0.0] * 64), (2007, [-0.001] * 64), (2008, [1000.0] * 64)]
    df = vectors(spark, rows).repartition(5)
    found = centroids.cluster(df)
    got = collections.Counter(tuple(r) for r in centroids.described(found).collect())
    assert got == plain_clusters(rows)
    assert sum(found.measured) < 0.5 * found.possible                           # the pivots spare most distances of grouped vectors


def test_centroids_ties_and_few_vectors(spark):
    same = [(i, [0.5] * 64) for i in range(40)]
    found = centroids.described(centroids.cluster(vectors(spark, same)))
    assert {(r["cluster"], r["distance"], r["inertia"]) for r in found.collect()} == {(0, 0, 0)}   # ties go to the smaller number
    few = [(i, [float(i)] * 64) for i in range(5)]
    assert collections.Counter(tuple(r) for r in centroids.described(centroids.cluster(vectors(spark, few))).collect()) == plain_clusters(few)
    assert centroids.described(centroids.cluster(vectors(spark, few[:0]))).count() == 0
    for large in (1e30, -1e30):
        with pytest.raises(Exception, match="64 bits"):
            centroids.cluster(vectors(spark, [(1, [large] * 64)]))


def test_bounds_leave_out_no_centroid():
    rng = np.random.default_rng(6)
    for spread_by in (1, 40, 3000):
        x = rng.integers(-spread_by, spread_by + 1, (500, 8))
        means = rng.integers(-spread_by, spread_by + 1, (12, 8))
        pivots = centroids.spread(x[:50], 5)
        c, d, n = centroids.assign(x, centroids.to_pivots(x, pivots), means, pivots)
        every = ((x[:, None] - means[None]) ** 2).sum(2)
        assert (c == every.argmin(1)).all() and (d == every.min(1)).all() and 500 <= n <= 6000


# --------------------------------------------------------------------------- Jaccard join


def plain_sets(rows, width=5):
    out = []
    for _, text in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
        out.append({tuple(words[k:k + width]) for k in range(max(1, len(words) - width + 1))} if words else set())
    return out


def plain_join(rows):
    """(doc_id, n_shingles, component_id) of rows with an id, by comparing all pairs."""
    rows = [r for r in rows if r[0] is not None]
    sets = plain_sets(rows)
    pairs = [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows))
             if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = plain_components(range(len(rows)), pairs)
    first = {}
    for k, (i, _) in enumerate(rows):
        first[root[k]] = min(first.get(root[k], i), i)
    return collections.Counter((i, len(sets[k]), first[root[k]]) for k, (i, _) in enumerate(rows))


def family(rng, start, n, size, changes, prefix):
    words = [f"{prefix}x{rng.randrange(900)}" for _ in range(size)]
    out = []
    for k in range(n):
        edit = list(words)
        for at in rng.sample(range(size), changes(k)):
            edit[at] = f"new{rng.random()}"
        out.append((start + k, " ".join(edit)))
    return out


def jaccard_rows(texts):
    rng = random.Random(5)
    rows = list(texts)
    for c in range(6):
        rows += family(rng, 10_000 + 100 * c, 8, 200, lambda k: 1 + k % 4, f"w{c}")
    rows += family(rng, 11_000, 60, 120, lambda k: 3 + k % 6, "v")                      # around the threshold: many components
    line = [f"c{k}" for k in range(160)]
    rows += [(20_000 + k, " ".join(line[6 * k:6 * k + 100])) for k in range(10)]        # a chain of which only neighbours are similar
    rows += [(21_000 + k, " ".join(line[:40] + [f"t{k}y{j}" for j in range(30)])) for k in range(20)]
    rows += [(23_000 + k, " ".join(line[:40] + [f"z{j}" for j in range(k)])) for k in range(14)]
    rows += [(22_000, None), (22_001, ""), (22_002, "One two"), (22_003, "one  TWO"), (22_004, "one two three"), (22_005, " \t")]
    rows += [(10_000, "another text under a known id here"), (22_003, "one two"), (None, "one two")]
    return rows


@pytest.mark.parametrize("cell", [1 << 18, 300])
def test_jaccard_join(spark, texts, monkeypatch, cell):
    monkeypatch.setattr(overlap, "CELL", cell)
    rows = jaccard_rows(texts)
    got = collections.Counter(tuple(r) for r in overlap.near_copies(odd(spark, rows).repartition(5)).collect())
    want = plain_join(rows)
    assert got == want
    assert (20_009, 96, 20_000) in want and (22_003, 1, 22_002) in want and (22_001, 0, 22_001) in want


def test_jaccard_odd(spark):
    assert overlap.near_copies(empty(spark)).count() == 0
    got = collections.Counter(tuple(r) for r in overlap.near_copies(odd(spark)).collect())
    assert got == plain_join(ODD)


def test_search_against_all_pairs():
    rng = random.Random(8)
    sets = []
    for base in range(6):
        whole = rng.sample(range(10_000), 60)
        for k in range(25):
            own = set(rng.sample(whole, rng.randrange(1, 61))) | set(rng.sample(range(10_000), rng.choice([0, 0, 3, 10])))
            sets.append(np.array(sorted(own), np.int64))
    index = overlap.Index(sets)
    for s in sets:
        want = [j for j, t in enumerate(sets) if 100 * len(np.intersect1d(s, t)) >= 80 * len(np.union1d(s, t))]
        assert sorted(index.search(s)) == want
    assert overlap.Index([]).search(sets[0]) == []


def test_merge_skip():
    rng = random.Random(9)
    for _ in range(200):
        lists = [sorted(rng.sample(range(30), rng.randrange(0, 12))) for _ in range(rng.randrange(1, 9))]
        count = collections.Counter(x for own in lists for x in own)
        for least in range(1, len(lists) + 1):
            assert list(overlap.merge_skip(lists, least)) == sorted((x, c) for x, c in count.items() if c >= least)


def test_prefixes_share_enough():
    """Sets at the threshold: their prefixes share as many shingles as the search asks for."""
    rng = random.Random(10)
    for n in [*range(1, 60), 200, 777]:
        for m in {n, -(-80 * n // 100), min(n * 100 // 80, n + 9)}:
            both = -(-80 * (n + m) // 180)
            if both > min(n, m):
                continue
            for _ in range(4):
                numbers = rng.sample(range(10 ** 6), n + m - both)
                x, y = sorted(numbers[:n]), sorted(numbers[n - both:])
                assert len(x) == n and len(y) == m
                shared = set(x[:overlap.prefix(n)]) & set(y[:overlap.prefix(m)])
                assert all(len(shared) >= 1 + -(-80 * k // 100) // 16 for k in (n, m))
