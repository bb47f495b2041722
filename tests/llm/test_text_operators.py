"""The text operators against brute force, and on nulls, empty and long texts, ties, repeats and empty tables."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import xxhash
from pyspark.sql import functions as F

from panelfx.llm import ann, bpe, decontaminate, langid, licences, lm, pii, simhash, toxicity, urlfilter
from panelfx.llm.components import components
from panelfx.llm.queries import tokenizer_path

ODD = [(900, None), (901, ""), (902, " \n\t "), (903, "x"), (904, "word " * 30_000), (905, "a" * 60_000), (906, "same text here"),
       (906, "same text here"), (None, "no id at all"), (907, "😀 \x00\x01 ß́")]


def odd(spark, rows=ODD, schema="doc_id long, text string"):
    """Odd rows with columns whose names the operators use themselves."""
    return spark.createDataFrame(rows, schema).withColumns(
        {c: F.lit("clash") for c in ("fp", "n", "key", "label", "score", "base", "spans", "ids", "shingle", "hash", "r", "a", "node")})


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


# --------------------------------------------------------------------------- near copies


def plain_fingerprint(text, width=4):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints_and_components(spark, texts):
    rows = texts[:120] + [(500 + i, t + f" tail{i}") for i, (_, t) in enumerate(texts[:30])]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    fps = {i: plain_fingerprint(t) for i, t in rows}
    assert {r["doc_id"]: r["fp"] % (1 << 64) for r in got} == fps
    ids = sorted(fps)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if (fps[a] ^ fps[b]).bit_count() <= 4]
    assert pairs
    assert {r["doc_id"]: r["component_id"] for r in got} == plain_components(ids, pairs)


def test_links_miss_no_pair(spark):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    fps = set(seeds)
    for s in seeds:
        for d in range(1, 7):
            x = s
            for b in rng.sample(range(64), d):
                x ^= 1 << b
            fps.add(x)
    fps |= {0, (1 << 64) - 1, 0b1111, 1 << 63}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    got = {frozenset((r["a"] % (1 << 64), r["b"] % (1 << 64))) for r in simhash.links(spark.createDataFrame(signed, "fp long")).collect()}
    every = sorted(fps)
    want = {frozenset((a, b)) for k, a in enumerate(every) for b in every[k + 1:] if (a ^ b).bit_count() <= 4}
    assert got == want


def test_links_send_no_side_to_the_driver(spark):
    """A fingerprint has up to 69 probe rows, sized as one: the small table stays under the broadcast threshold, its probes need not."""
    found = simhash.links(spark.range(500).select(F.xxhash64("id").alias("fp")))
    assert found.collect() == []
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_near_copies_odd(spark):
    got = [tuple(r) for r in simhash.near_duplicates(odd(spark)).collect()]
    by = collections.defaultdict(set)
    for i, fp, c in got:
        by[i].add((fp, c))
    assert len(got) == len(ODD) - 1 and by[900] == by[901] - {None} and {c for _, c in by[902]} == {900}
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_components_of_a_long_chain(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 150: 100, 200: 100}


# --------------------------------------------------------------------------- decontamination


def plain_shingles(text):
    w = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())
    k = min(5, len(w))
    return {" ".join(w[i:i + k]) for i in range(len(w) - k + 1)} if k else set()


def test_containment_joins_tables_of_known_size(spark, tmp_path):
    """One long item is thousands of shingles, so tables of shingles above the threshold must not be broadcast as if they were items."""
    rows = [(i, " ".join(f"w{i}x{n}" for n in range(4000))) for i in range(40)]
    spark.createDataFrame(rows, "id long, text string").coalesce(2).write.parquet(f"file://{tmp_path}/texts")
    docs = spark.read.parquet(f"file://{tmp_path}/texts").withColumnRenamed("id", "doc_id")
    items = docs.select((F.col("doc_id") + 900).alias("item_id"), "text")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1m")
    try:
        found = decontaminate.contaminated(docs, items)
        assert sorted((r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in found.collect()) == [(i, 900 + i, 3996, 3996) for i, _ in rows]
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert re.search(r"SortMergeJoin [^\n]*shingle", plan) and not re.search(r"BroadcastHashJoin [^\n]*shingle", plan)


def test_containment(spark, texts):
    rng = random.Random(1)
    items = [(i, " ".join(f"q{rng.randrange(10**6)}" for _ in range(n))) for i, n in enumerate([1, 3, 5, 6, 9, 14, 40, 90, 300])]
    items += [(20, None), (21, ""), (22, "?!"), (None, "abc def ghi jkl mno pqr")]
    docs = []
    for n, (_, t) in enumerate(texts[:60]):
        i, item = items[n % 9]
        words = item.split()
        part = words[:max(1, int(len(words) * rng.choice([1, .95, .85, .7])))]
        docs.append((n, t + "\n" + ", ".join(part).upper() + ". " + t[:50]))
    docs += ODD
    got = {(r["doc_id"], r["item_id"]): (r["n_item"], r["n_shared"]) for r in decontaminate.contaminated(
        odd(spark, docs), odd(spark, items, "item_id long, text string")).collect()}
    want = {}
    for d, t in docs:
        for i, item in items:
            if d is None or i is None:
                continue
            own, there = plain_shingles(item), plain_shingles(t)
            if len(item.split() if item else []) < 5 and own:
                w, k = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (t or "").lower()), len(item.split())
                there = {" ".join(w[j:j + k]) for j in range(len(w) - k + 1)}
            if own and len(own & there) >= 0.8 * len(own) - 1e-12:
                want[d, i] = (len(own), len(own & there))
    assert got == want and len(want) > 20
    assert decontaminate.contaminated(empty(spark), odd(spark, items, "item_id long, text string")).count() == 0
    assert decontaminate.contaminated(odd(spark), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_an_item_split_over_rows_of_one_id(spark):
    items = [(n, " ".join(f"w{n}x{i}" for i in range(12))) for n in range(60)]
    docs = []
    for n, text in items:
        w = text.split(" ")
        docs += [(n, " ".join(w[:8])), (n, " ".join(w[4:]))]
    got = decontaminate.contaminated(odd(spark, docs), odd(spark, items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["n_shared"]) for r in got) == [(n, n, 8) for n in range(60)]


# --------------------------------------------------------------------------- byte pairs


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def own():
    with open(tokenizer_path(), "rb") as f:
        return bpe.Tokenizer(f.read())


def test_bpe_matches_library(texts, library, own):
    rng = random.Random(2)
    pool = [chr(c) for r in ((32, 127), (0xa0, 0x250), (0x370, 0x400), (0x3040, 0x3097), (0x1f600, 0x1f640)) for c in range(*r)
            if chr(c).isprintable()]
    cases = [t for _, t in texts] + [t or "" for _, t in ODD]
    cases += ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(800)]
    cases += ["".join(rng.choice(a) for _ in range(n)) for a in ("ab", "thein", "abcdefghijklmnop", "ße") for n in (1500, 4000)]
    cases += ["a<|endoftext|>B <|startoftext|>", "ΑΣ Σ", "İ", "é", "a\x1cb\x85c", "don't I'LL 's"]
    for text in cases:
        ids = [i for block in own.encode(text) for i in block]
        assert ids == library.encode(text, add_special_tokens=False).ids, text[:60]
        state = own.decoder(joined=True)
        assert state.feed(ids[:5]) + state.feed(ids[5:]) + state.finish() == library.decode(ids, skip_special_tokens=False)


def test_stream_holds_a_bounded_window():
    """With random merge lists, the stream equals merging the whole run, and holds twice the lookahead at most."""
    rng = random.Random(3)
    for _ in range(30):
        names = list("abcd")
        merges = []
        for _ in range(12):
            a, b = rng.choice(names), rng.choice(names)
            if a + b not in names and len(a + b) < 9:
                merges.append((a, b))
                names.append(a + b)
        number = {n: i for i, n in enumerate(names)}
        pairs = {(number[a], number[b]): (k, number[a + b]) for k, (a, b) in enumerate(merges)}
        t = bpe.Transducer(pairs, {i: len(n) for n, i in number.items()}, bpe.lookahead(merges, tuple))
        run = [number[rng.choice("abcd")] for _ in range(400)]
        pulled = []

        def watched():
            for s in run:
                pulled.append(s)
                yield s

        out = []
        for token in t.stream(watched()):
            out.append(token)
            assert len(pulled) - sum(len(names[i]) for i in out) <= 2 * t.ahead or len(pulled) == len(run)
        assert out == t.merge(run)


def test_bpe_tables(spark, own):
    path = tokenizer_path()
    got = sorted(map(tuple, bpe.digests(odd(spark), path).collect()), key=str)
    assert len(got) == len(ODD)
    nothing = hashlib.sha256(b"").hexdigest()
    assert {r[1:] for r in got if r[0] in (900, 901, 902)} == {(0, nothing, nothing)}
    recoded = {r["doc_id"]: r for r in bpe.recode(odd(spark, [(1, "Hello  WORLD, é"), (2, None)]), path).collect()}
    assert recoded[1]["text"] == "hello world , é " and recoded[2]["ids"] == []
    encoded = bpe.encode(odd(spark, [(1, "Hello  WORLD, é"), (2, None)]), path)
    assert {r["doc_id"]: r["text"] for r in bpe.decode(encoded, path).collect()} == {1: "hello world , é ", 2: ""}
    assert bpe.digests(empty(spark), path).count() == 0


# --------------------------------------------------------------------------- urls


def test_url_rules(spark):
    rules = [urlfilter.Rule("allow", place="org/"), urlfilter.Rule("block", place="example.org/es/"),
             urlfilter.Rule("block", place="example.org/en/1"), urlfilter.Rule("block", pattern="||spam-*^"),
             urlfilter.Rule("block", pattern="*track*"), urlfilter.Rule("allow", pattern="/ads.txt|"), urlfilter.Rule("block", pattern="/ads.")]
    rows = {1: ("http://EXAMPLE.org/es/x", "example.org/es/", "block"), 2: ("https://a.example.org/en/199?q", "example.org/en/1", "block"),
            3: ("https://a.example.org/en/299", "org/", "allow"), 4: ("https://notexample.org/es/", "org/", "allow"),
            5: ("https://example.org", None, "allow"), 6: ("https://x.spam-farm.com/", None, "block"),
            7: ("https://x.com/mytracker", None, "block"), 8: ("https://x.com/ads.txt", None, "allow"),
            9: ("https://x.com/ads.js", None, "block"), 10: (None, None, "allow"), 11: ("", None, "allow"), 12: ("no scheme", None, "allow"),
            13: ("https://x.com/ads.txt\n", None, "block"), 14: ("http://" + "a" * 50_000 + ".org/" + "b" * 50_000, "org/", "allow")}
    df = spark.createDataFrame([(i, u[0]) for i, u in rows.items()], "page_id long, url string").withColumn("rule", F.lit("clash"))
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.judge(df, rules).collect()}
    assert got == {i: u[1:] for i, u in rows.items()}
    assert urlfilter.judge(df.limit(0), rules).count() == 0 and urlfilter.judge(df, []).where("verdict = 'allow'").count() == len(rows)


def test_rare_token_index_equals_all_rules(spark, sf_dir):
    urls = [r["url"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("url").collect()]
    rules = urlfilter.PATTERNS + [urlfilter.Rule("block", pattern=p) for p in ("|m.", "/en/^", "page=2", "*the*en^", ".example.net/")]
    index = urlfilter.Index(rules, {})
    for url in urls:
        host, path, rest = urlfilter.split_url(url)
        u = host + path + rest
        assert set(index.fitting(u)) == {r for r in rules if re.match(r.regex(), u)}


# --------------------------------------------------------------------------- languages


def test_profiles_and_ranks(spark, sf_dir, texts):
    def plain(text):
        c = collections.Counter()
        for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
            w = f" {w} "
            c.update(w[i:i + n] for n in (1, 2, 3) for i in range(len(w) - n + 1) if w[i:i + n].strip())
        return c

    def packed(g):
        k = 0
        for ch in g:
            k = k << 21 | ord(ch)
        return k

    for _, t in texts[:40] + [(0, "a1b  c_é"), (0, "")]:
        c = plain(t)
        assert dict(zip(*(x.tolist() for x in langid.gram_counts(t)))) == {packed(g): n for g, n in c.items()}
        assert langid.ranked(t).tolist() == [k for k, _ in sorted(((packed(g), n) for g, n in c.items()), key=lambda x: (-x[1], x[0]))[:300]]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learned = langid.profiles(docs.where("doc_id % 2 = 0"))
    held = langid.identify(docs.where("doc_id % 2 = 1"), learned).join(docs, "doc_id")
    assert held.where("lang_pred = lang").count() >= 0.97 * held.count()
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(odd(spark), learned).collect()}
    assert got[900] == got[901] == got[902] == ("und", 0.0) and all(0 <= s <= 1 for _, s in got.values())
    nothing = langid.profiles(docs.limit(0))
    assert nothing.count() == 0 and {r["lang_pred"] for r in langid.identify(odd(spark), nothing).collect()} == {"und"}


# --------------------------------------------------------------------------- toxicity


def test_toxicity(spark, sf_dir):
    docs = spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/documents.parquet")
    labels = spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/labels.parquet")
    train = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    model = toxicity.fit(docs, labels.where(train))
    held = toxicity.score(docs, model).join(labels.where(~train), "doc_id").collect()
    assert sum(r["predicted"] == r["toxic"] for r in held) >= 0.9 * len(held)
    toxic, clean = ([r["score"] for r in held if r["toxic"] == x] for x in (1, 0))
    assert np.mean([a > b for a in toxic for b in clean]) > 0.85
    got = [tuple(r) for r in toxicity.score(odd(spark), model).collect()]
    assert len(got) == len(ODD) and len({r[1] for r in got if r[0] in (900, 901)}) == 1 and all(0 <= r[1] <= 1 for r in got)
    assert toxicity.score(empty(spark), model).count() == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert {r["predicted"] for r in toxicity.score(odd(spark), none).collect()} == {0}
    ones = toxicity.fit(docs, labels.withColumn("toxic", F.when(F.col("toxic") == 1, 1)))
    assert {r["predicted"] for r in toxicity.score(odd(spark), ones).collect()} == {1}


# --------------------------------------------------------------------------- nearest neighbours


def plain_nearest(rows, k=5):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, x in ok:
        if q % 50 == 0:
            near = {}
            for i, v in ok:
                if i != q and len(v) == len(x):
                    s = float((x * v).sum() / (np.sqrt((x * x).sum()) * np.sqrt((v * v).sum())))
                    near[i] = max(near.get(i, -2), s)
            out[q] = sorted(((-s, i) for i, s in near.items()))[:k]
    return out


def test_nearest(spark, sf_dir):
    rng = np.random.default_rng(4)
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    rows += [(5000 + i, [float(x) for x in rows[3][1]]) for i in range(300)]
    rows += [(9000, None), (9001, []), (9002, [0.0] * 64), (9003, [float("nan")] * 64), (9004, [None] * 64), (9050, [1.0, 2.0]), (9051, [2.0, 1.0]),
             (None, rows[0][1]), rows[50], rows[7]]
    rows += [(20000 + i, (np.array(rows[10][1]) + rng.normal(0, .01, 64)).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"rank": F.lit(1), "id": F.lit(1), "v": F.lit(1)})
    got = collections.defaultdict(dict)
    for r in ann.nearest(df).collect():
        got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    want = {q: n for q, n in plain_nearest(rows).items() if n}
    assert got.keys() == want.keys()
    for q, near in want.items():
        assert [got[q][k + 1][0] for k in range(len(near))] == [i for _, i in near]
        assert np.allclose([got[q][k + 1][1] for k in range(len(near))], [-s for s, _ in near], atol=1e-12, rtol=0)
    assert ann.nearest(df.limit(0)).count() == 0


def test_nearest_of_repeated_ids(spark):
    """Rows of one id, equal or not, take one place: in a window, in a block, and where an id has a third of the rows."""
    rng = np.random.default_rng(6)
    base = [(i, rng.normal(size=8)) for i in range(150)]
    rows = [(i, (v + rng.normal(0, 1e-3, 8) * (i % 2)).tolist()) for i, v in base for _ in range(12)]
    rows += [(1001, (base[50][1] + rng.normal(0, 1e-2, 8)).tolist()) for _ in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(dict)
    for r in ann.nearest(df, window=40).collect():
        got[r["query_id"]][r["rank"]] = r["vec_id"]
    want = {q: [i for _, i in near] for q, near in plain_nearest(rows).items()}
    assert set(want) == {0, 50, 100} and {q: [n[k + 1] for k in range(len(n))] for q, n in got.items()} == want


def test_hilbert_visits_neighbours():
    side = 8
    points = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    key = ann.hilbert(points, 3)
    assert sorted(key.tolist()) == list(range(side ** 3))
    path = points[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


# --------------------------------------------------------------------------- language model


def test_language_model(spark, sf_dir, texts):
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    docs = spark.createDataFrame(texts + ODD[:5], "doc_id long, text string").withColumns({"word": F.lit("clash"), "c": F.lit(1)})
    model = lm.fit(docs.where(~held))
    got = {r["doc_id"]: r for r in lm.score(docs, model).collect()}
    import zlib
    counts = collections.Counter()
    split = lambda t: (t or "").encode().lower().split() + [b""]
    for i, t in texts + ODD[:5]:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(split(t))
    n, v = counts.total(), len(counts)
    for i, t in texts + ODD[:5]:
        words = split(t)
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), rel=1e-9)
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(words), sum(counts[w] > 0 for w in words), n)
        assert got[i]["score"] < 0
    # better than the base on texts it has not seen
    unseen = [got[i] for i, _ in texts if zlib.crc32(str(i).encode()) % 7 == 2]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)


def probabilities(model):
    """Probability of every word after every context from the model's tables, each number looked up by itself."""
    numbers = {w: n for n, w in enumerate(model.lexicon)}
    words = {bytes(r["word"]): r["c"] for r in model.words.collect()}
    for w in words:
        numbers.setdefault(w, lm._RARE | xxhash.xxh64_intdigest(w, 42) & lm._RARE - 1)
    t, m = dict(enumerate(model.totals.t)), dict(enumerate(model.totals.m))
    for r in model.totals.rare.collect():
        t[r["id"]], m[r["id"]] = r["t"], r["m"]
    pairs = {(r["u"], r["w"]): (r["n"], r["t"]) for r in model.pairs.collect()}
    p0 = {w: model.totals.parent.probability(np.array([float(m[numbers[w]])]))[0] for w in words}
    unknown = model.totals.parent.probability(np.zeros(1))[0]

    def of(u, w):
        top = p0.get(w, unknown)
        if u not in words:
            return top
        n, k = pairs.get((numbers[u], numbers.get(w)), (0, 0))
        d = model.discount
        return (n - d * k + (lm.STRENGTH + d * t[numbers[u]]) * top) / (lm.STRENGTH + words[u])

    return words, of


@pytest.mark.parametrize("frequent", [3, 1 << 17])
def test_language_model_probabilities(spark, frequent):
    """Every context gives a distribution, and scores are those of single look-ups, however many words tasks hold."""
    rng = random.Random(frequent)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.8))}" for _ in range(rng.randrange(60)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = lm.fit(docs.where("doc_id < 100"), frequent=frequent)
    words, of = probabilities(model)
    assert len(model.lexicon) <= frequent + 1
    for u in [*list(words)[:20], b"never seen"]:
        assert sum(of(u, w) for w in words) + of(u, b"never seen") == pytest.approx(1)
    got = {r["doc_id"]: r["score"] for r in lm.score(docs, model).collect()}
    for i, text in rows:
        line = [b"", *text.encode().split(), b""]
        assert got[i] == pytest.approx(sum(math.log10(of(u, w)) for u, w in zip(line, line[1:])), rel=1e-9)
    # what the model holds are all pairs of the training texts
    pairs = collections.Counter()
    for i, text in rows[:100]:
        line = [b"", *text.encode().split(), b""]
        pairs.update(zip(line, line[1:]))
    assert sorted(r["n"] for r in model.pairs.collect()) == sorted(pairs.values())


@pytest.mark.parametrize("frequent", [3, 20, 1 << 17])
def test_language_model_in_many_cells(spark, monkeypatch, frequent):
    """Pairs are rows of a few cells, not rows of their own, and scores are those of single look-ups in them."""
    monkeypatch.setattr(lm, "CELL", 200)
    monkeypatch.setattr(lm, "_BLOCK", 100)
    rng = random.Random(frequent)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.8))}" for _ in range(rng.randrange(60)))) for i in range(120)] + [(200, None), (None, "w1 w1 w2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = lm.fit(docs.where("doc_id < 100"), frequent=frequent)
    pairs = model.pairs.count()
    assert 5 <= model.grid.cells < model.cells.count() <= 2 * model.grid.cells < pairs
    # the most frequent pairs that tasks hold are few here, so that the others meet their cells
    monkeypatch.setattr(lm, "_top_terms", lambda model, far, floor, top=lm._top_terms: top(model, far, 4))
    _, of = probabilities(model)
    got = {r["doc_id"]: r["score"] for r in lm.score(docs, model).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        line = [b"", *(text or "").encode().split(), b""]
        assert got[i] == pytest.approx(sum(math.log10(of(u, w)) for u, w in zip(line, line[1:])), rel=1e-9)


@pytest.mark.parametrize("kind", [np.uint16, np.uint32, np.int64])
def test_packed_columns(kind):
    rng = np.random.default_rng(1)
    top = np.iinfo(kind).max
    for n in (0, 1, 2, 1000):
        x = rng.integers(0, top, n, kind, endpoint=True)
        for column in (x, np.sort(x)):
            back = lm._array(lm._pack(column), kind)
            assert back.dtype == kind and (back == column).all()


def test_words_of_blocks():
    """Texts cut into words by blocks have the words of each text alone, whatever bytes they hold and wherever blocks end."""
    rng = random.Random(4)
    texts = [b"", b" ", b"A", b" a", b"B\xff ", b"\x0bX\x1cY\x85 \xc3\x84", b"", b"c" * 40, b"\n\n"]
    texts += [bytes(rng.choice(b"aZz \t\n\x0b\x0c\r\x00\x1f\x85\xa0") for _ in range(rng.randrange(30))) for _ in range(300)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[at:at + 40], pa.binary())], names=["text"]) for at in range(0, len(texts), 40)]
    for size in (1, 25, 1 << 20):
        words, lengths, blocks = [], [], 0
        for part in lm._parts(iter(batches), size):
            tokens, length = lm._tokens(part.column("text"))
            assert part.num_rows == 1 or pc.sum(pc.binary_length(part.column("text"))).as_py() <= size + len(texts[7])
            words, lengths, blocks = words + tokens.to_pylist(), lengths + length.tolist(), blocks + 1
        assert words == [w for t in texts for w in [*t.lower().split(), b""]]
        assert lengths == [len(t.split()) + 1 for t in texts] and (blocks == 1) == (size == 1 << 20)


@pytest.mark.parametrize("frequent", [3, 20])
def test_language_model_samples_what_moves(spark, frequent):
    """Sampling keeps to the words of pairs seen more than once; totals of all words are those of all pairs."""
    rng = random.Random(frequent)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.8))}" for _ in range(rng.randrange(60)))) for i in range(120)]
    model = lm.fit(spark.createDataFrame(rows, "doc_id long, text string"), frequent=frequent)
    pairs = [(r["u"], r["w"], r["n"], r["t"]) for r in model.pairs.collect()]
    t, m = collections.Counter(), collections.Counter()
    for u, w, _, k in pairs:
        t[u] += k
        m[w] += k
    moved, still = (x.collect() for x in (model.totals.moved, model.totals.still))
    assert {r["id"] for r in moved} == {x for u, w, n, _ in pairs if n > 1 for x in (u, w) if x >= lm._RARE}
    assert len(still) > len(moved) > 0
    got = {r["id"]: (r["t"], r["m"]) for r in moved + still}
    assert got == {x: (t[x], m[x]) for x in {*t, *m} if x >= lm._RARE} and len(got) == len(moved) + len(still)
    assert model.totals.t.tolist() == [t[x] for x in range(len(model.lexicon))]
    assert model.totals.m.tolist() == [m[x] for x in range(len(model.lexicon))]


def test_language_model_empty_and_join(spark):
    nothing = lm.fit(empty(spark))
    got = lm.score(odd(spark, [(1, "a b"), (2, None)]), nothing).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["n_known"]) for r in got} == {1: (3, 0), 2: (1, 0)}
    rows = [(i, " ".join(f"w{j % (i + 2)}" for j in range(60))) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    few = lm.score(docs, lm.fit(docs, frequent=10)).collect()
    model = lm.fit(docs)
    many = lm.score(docs, model).collect()
    assert {r["doc_id"]: (r["n_known"], round(r["base_score"], 9)) for r in few} == {r["doc_id"]: (r["n_known"], round(r["base_score"], 9)) for r in many}
    assert lm.score(empty(spark), model).count() == 0


def seatings(n, others, p, d):
    """Exact probabilities of the numbers of tables of a dish, from all ways to seat its customers one by one."""
    ways = {1: lm.STRENGTH + d * others}
    for c in range(1, n):
        more = collections.defaultdict(float)
        for t, x in ways.items():
            more[t] += x * (c - d * t)
            more[t + 1] += x * (lm.STRENGTH + d * (others + t)) * p
        total = sum(more.values())
        ways = {t: x / total for t, x in more.items()}
    return ways


@pytest.mark.parametrize("n,others,p", [(2, 5, 0.1), (7, 40, 0.02), (12, 3, 0.4), (150, 900, 0.01)])
def test_tables_follow_their_conditional(n, others, p):
    draws, d = 40_000, 0.6
    got = lm.Seating(d, np.random.default_rng(1)).draw(np.full(draws, n), np.full(draws, float(others)), np.full(draws, p))
    share = collections.Counter(got.tolist())
    want = seatings(n, others, p, d)
    assert set(share) <= set(want)
    for t, x in want.items():
        assert share[t] / draws == pytest.approx(x, abs=0.015)


@pytest.mark.parametrize("n,others,p", [(400, 300.0, 0.02), (700, 50.0, 1e-5), (1500, 4000.0, 0.05), (900, 10.0, 0.9)])
def test_tables_of_many_customers(monkeypatch, n, others, p):
    """Draws beyond the tabulated numbers against the exact mean and spread; a skewed law (the last) is met least well."""
    d = 0.6
    want = seatings(n, others, p, d)
    mean = sum(t * x for t, x in want.items())
    spread = math.sqrt(sum((t - mean) ** 2 * x for t, x in want.items()))
    monkeypatch.setattr(lm, "EXACT", 256)
    got = lm.Seating(d, np.random.default_rng(2)).draw(np.full(4000, n), np.full(4000, others), np.full(4000, p))
    assert got.mean() == pytest.approx(mean, abs=0.3 * spread + 0.01)
    assert got.std() == pytest.approx(spread, rel=0.1, abs=0.05)


# --------------------------------------------------------------------------- personal data


def plain_spans(text):
    def luhn(d):
        return sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0

    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_personal_data(spark, texts):
    rng = random.Random(6)
    parts = ["1", "2", "25", "255", "0", ".", ".", "-", " ", " ", "+", "(", ")", "a", "b", "@", "@", ".com", "é", "😀", "\x01", "_", "x@y.z",
             "4111111111111111", "\n", "%", "12", "9"]
    rows = [(10_000 + i, "".join(rng.choice(parts) for _ in range(rng.randrange(60)))) for i in range(1500)]
    rows += [(2000, "1 " * 3000 + "4111-1111-1111-1111 x@y.zz_q@w.com 1.2.3.4.5.6.7.8"), (2001, "a" * 20_000 + "@b.c"), (2002, "1." * 4000),
             (2003, "7" * 20_000), (2004, "+1" * 3000), (2005, "call (459) 555-9246 or john (at) mail (dot) com")]
    rows += texts[:60] and [(3000 + i, t) for i, t in texts[:60]]
    rows += [(i, t) for i, t in ODD if i is not None]
    df = odd(spark, rows).drop("base", "spans")
    scanned = pii.scan(df)
    model = pii.fit(scanned)
    got = pii.found(scanned, model).select("doc_id", pii.written(F.col("base")).alias("b"), pii.written(F.col("spans")).alias("s")).collect()
    assert len(got) == len(rows)
    want = dict(rows)
    for r in got:
        assert r["b"] == plain_spans(want[r["doc_id"]]), r["doc_id"]
        assert set(filter(None, r["b"].split(","))) <= set(filter(None, r["s"].split(",")))
    added = next(r["s"] for r in got if r["doc_id"] == 2005)
    assert added == "phone:5:19,email:23:47"
    clean = pii.found(scanned, model).where("doc_id = 2005").select(pii.redacted(F.col("text"), F.col("spans"))).first()[0]
    assert clean == "call [PHONE] or [EMAIL]"
    none = pii.scan(empty(spark))
    assert pii.found(none, pii.fit(none)).count() == 0


# --------------------------------------------------------------------------- licences


def test_licences(spark):
    mit = licences._MIT
    rows = [(1, "Text before.\nReleased under the MIT License.\nafter"), (2, "licensed  UNDER the apache license version 2.0"),
            (3, mit.replace("\n", " ")), (4, "Intro\n\n" + mit + "\n\nOutro"), (5, "nothing about it"), (6, "MIT")] + ODD
    got = {(r["doc_id"], r["unit"], r["licence"]) for r in licences.scan(odd(spark, rows)).collect()}
    assert got == {(1, "line", "MIT"), (1, "sentences", "MIT"), (2, "line", "Apache-2.0"), (3, "line", "MIT"), (4, "paragraph", "MIT"),
                   (4, "paragraphs", "MIT"), (4, "sentences", "MIT"), (4, "text", "MIT")}
    assert licences.scan(empty(spark)).count() == 0 and licences.scan(odd(spark), []).count() == 0


def test_licence_of_each_notice(spark):
    """Every notice is named by its own licence and not by a neighbour's, alone and inside longer texts."""
    fsf = "{} is free software{} you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free " \
          "Software Foundation{} either version {} of the License, or (at your option) any later version."
    notices = {
        "AGPL-3.0": fsf.format("This program", ":", "Affero General Public License", ",", "3"),
        "LGPL-3.0": fsf.format("This library", ":", "Lesser General Public License", ",", "3"),
        "GPL-2.0": fsf.format("This program", ";", "General Public License", ";", "2"),
        "GPL-3.0": fsf.format("This program", ":", "General Public License", ",", "3"),
        "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "BSD-3-Clause": licences._BSD3, "MPL-2.0": licences._MPL, "Apache-2.0": licences._APACHE}
    prose = "The harbour was quiet that evening and nobody spoke about the weather. Boats came in one after another!"
    names = sorted(notices)
    rows = [(n, notices[k]) for n, k in enumerate(names)]
    rows += [(100 + n, f"{prose} {notices[k]} {prose}") for n, k in enumerate(names)]
    rows += [(200, prose + "\n\n" + licences._BSD2.replace(": R", ":\n\nR").replace(". R", ".\n\nR") + "\n\n" + prose)]
    found = {}
    for r in licences.scan(odd(spark, rows)).collect():
        best = found.get(r["doc_id"], (0.0, ""))
        found[r["doc_id"]] = max(best, (r["dice"], r["licence"]))
    assert {k: found[n][1] for n, k in enumerate(names)} == {k: k for k in names}
    assert {k: found[100 + n][1] for n, k in enumerate(names)} == {k: k for k in names}
    assert found[200][1] == "BSD-2-Clause"


def test_licence_key_words_lose_nothing():
    grams = [licences._bigrams(t.text) for t in licences.TEMPLATES]
    keys = set(licences.key_words(grams, 0.8))
    for b in grams:
        without = [g for g in b if not keys & set(g.split(" "))]
        assert len(without) < licences.bounds(len(b), 0.8)[0]


def test_licence_ties_and_repeats(spark):
    same = [licences.Template("B", "one two three"), licences.Template("A", "one two three")]
    rows = licences.scan(odd(spark, [(1, "one two three"), (1, "one two three")]), same).collect()
    assert [(r["licence"], r["unit"], r["span"], r["dice"]) for r in rows] == [("A", "line", 1, 1.0)] * 2


def test_licence_bounds_lose_nothing():
    for n in range(1, 60):
        least, most = licences.bounds(n, 0.8)
        for m in range(1, 150):
            best = 2 * min(n, m) / (n + m)
            assert best < 0.8 - 1e-12 or least <= m <= most
