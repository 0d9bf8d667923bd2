"""The ten operators against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from seriesloom.llm import blocking, common, components, decontamination, edits, entry, licenses, lines, packing, quality, sharding, simhash, toxicity, vptree, warc, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, size long, fp long, h long, vec_id long"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from it."), (2, "The quick brown fox jumps over the lazy dog and runs away from it."), (3, None), (4, ""), (5, " \n\t "), (6, LONG), (7, LONG + " end"),
    (8, "one"), (9, "one two"), (9, "one two"), (None, "no id here"), (10, "Ünïcödé ÄÖ\x0bx\x1fy　z \U0001f600"), (11, "Line a is here\nLine b is there\nLine a is here"), (12, "line  A is HERE\nanother line altogether"), (13, None), (5, "the id five again"),
]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rows = [(i, t, "en", "s", 0 if t is None else len(t), "x", -1, -2, -3, -4) for i, t in TEXTS]
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(rows, DOCS).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return [tuple(r) for r in df.collect()]


def small(spark, table):
    return common.table(spark, "/root/testdata/sf0.001", table)


# ---- 1


def test_nearest_is_exact_at_factor_one_and_good_beyond(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(900, 6)) + 3 * rng.integers(0, 3, (900, 1)), 2)
    x[300:600] = x[0]  # a third of all rows is one vector
    ids = rng.permutation(900)
    table = spark.createDataFrame([(int(i), v.tolist(), 1) for i, v in zip(ids, x)], "vec_id long, embedding array<double>, score int")
    asked = table.where("vec_id % 20 = 0")
    want = {}
    for i, v in zip(ids, x):
        if i % 20 == 0:
            s = vptree.products(np.broadcast_to(v, x.shape), x)
            order = [k for k in np.lexsort([ids, -s]) if ids[k] != i][:20]
            want[int(i)] = [(int(ids[k]), float(s[k])) for k in order]
    got = {}
    for q, r, v, s in sorted(rows(vptree.nearest(table, asked, relax=1.0, shard_rows=250))):
        assert r == len(got.setdefault(q, [])) + 1
        got[q].append((v, s))
    assert got == want
    near = {}
    for q, _, v, _ in rows(vptree.nearest(table, asked, shard_rows=250)):
        near.setdefault(q, set()).add(v)
    recall = np.mean([len(near[q] & {v for v, _ in w}) / len(w) for q, w in want.items()])
    assert recall >= 0.9


@pytest.mark.parametrize("scale", [1.0, 1e-9, 1e9])
def test_nearest_of_different_vectors_with_equal_scores(spark, scale):
    """Small whole numbers: most scores are shared by many different vectors, and the least ids win at any size of the shards."""
    rng = np.random.default_rng(3)
    x = rng.integers(-3, 4, (800, 4)).astype(float)
    x = x[(x != 0).any(axis=1)][:750] * scale
    ids = rng.permutation(len(x))
    table = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = {}
    for q, r, v, s in rows(vptree.nearest(table, table.where("vec_id % 5 = 0"), relax=1.0, shard_rows=200, query_rows=64)):
        got.setdefault(q, []).append((r, v, s))
    assert len(got) == (ids % 5 == 0).sum()
    for i, v in zip(ids, x):
        if i % 5 == 0:
            s = vptree.products(np.broadcast_to(v, x.shape), x)
            order = [k for k in np.lexsort([ids, -s]) if ids[k] != i][:20]
            assert [(a, b) for _, a, b in sorted(got[int(i)])] == [(int(ids[k]), float(s[k])) for k in order]


def test_nearest_of_a_repeated_query_id_is_of_its_least_vector(spark):
    t = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0]), (9, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted(rows(vptree.nearest(t, q, k=1))) == [(9, 1, 2, 1.0)]


def test_nearest_leaves_out_unusable_vectors(spark):
    bad = [(1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, []), (None, [1.0, 1.0])]
    good = [(20, [1.0, 0.0]), (21, [2.0, 0.0]), (22, [2.0, 0.0]), (40, [0.0, 1.0]), (60, [1.0, 1.0, 1.0])]
    t = spark.createDataFrame(bad + good, "vec_id long, embedding array<double>")
    got = sorted(rows(vptree.nearest(t, t.where("vec_id % 20 = 0"))))
    assert got == [(20, 1, 21, 2.0), (20, 2, 22, 2.0), (20, 3, 40, 0.0), (40, 1, 20, 0.0), (40, 2, 21, 0.0), (40, 3, 22, 0.0)]
    assert rows(vptree.nearest(t.where("false"), t)) == [] and rows(vptree.nearest(t, t.where("false"))) == []


# ---- 2


def test_licences(spark, docs, empty):
    t = spark.createDataFrame([(1, "x\nReleased under  the MIT license\ny"), (2, licenses.TEMPLATES["MIT"]), (3, "Released"), (4, None), (5, ""), (6, licenses.TEMPLATES["MIT"] + " " + LONG), (7, "prose only\nof lines")], "doc_id long, text string")
    got = {(r["doc_id"], r["license"]): (round(r["dice"], 6), r["n_units"]) for r in licenses.scan(t.withColumn("license", F.lit(1)).withColumn("dice", F.lit(2))).collect()}
    assert got == {(1, "MIT (notice)"): (1.0, 1), (2, "MIT"): (1.0, 1)}
    ws = licenses.TEMPLATES["MIT"].split()
    wrapped = "\n".join(" # " + " ".join(ws[i : i + 9]) for i in range(0, len(ws), 9))
    t = spark.createDataFrame([(1, LONG + "\n \n\n" + wrapped + "\n\nother words\nto the end")], "doc_id long, text string")
    assert [(r["license"], round(r["dice"], 6)) for r in licenses.scan(t).collect()] == [("MIT", 1.0)]
    assert rows(licenses.scan(docs)) == [] and rows(licenses.scan(empty)) == []


# ---- 3


def check_shards(table, n):
    got = [r.asDict() for r in table.collect()]
    assert all(r["law"] == "bytes" and r["grown_shard"] is None for r in got)
    assert all(sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got))) for k in range(n))
    total, most = sum(r["size"] for r in got), max((r["size"] for r in got), default=0)
    for k in range(n):
        assert abs(sum(r["size"] for r in got if r["shard"] == k) - total / n) <= most
    order = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    shards = {}
    for r in order:
        shards.setdefault((r["text_crc32"], r["size"]), []).append(r["shard"])
    # Equal texts lie together, but where a shard ends among them.
    assert sum(len(set(v)) > 1 for v in shards.values()) <= n - 1 and all(v == sorted(v) and max(v) - min(v) + 1 == len(set(v)) for v in shards.values())
    return got


def test_shards(spark, docs, empty):
    got = check_shards(sharding.byte_shards(docs), 8)
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in TEXTS)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert rows(sharding.byte_shards(empty)) == []
    check_shards(sharding.byte_shards(spark.range(1000).selectExpr("if(id % 3 = 0, 5, id) as doc_id", "repeat('x', cast(id % 50 as int)) as text")), 8)


# ---- 4


@pytest.mark.parametrize("n", [200, 20_000])
def test_top_word_is_of_the_whole_text(n):
    words = [f"w{i}" for i in range(n // 2)] + ["junk"] * (n // 2)
    assert quality.features(" ".join(words).encode())[quality.FEATURES.index("top word")] == 0.5


def test_quality(spark, docs, empty):
    d, known = common.table(spark, "/root/testdata/sf0.01", "documents"), common.table(spark, "/root/testdata/sf0.01", "labels")
    got = quality.judged(d, known, carry=["doc_id"]).join(known, "doc_id").collect()
    good = [r["__quality"] >= 0.5 for r in got if r["quality"] == 1]
    bad = [r["__quality"] >= 0.5 for r in got if r["quality"] == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.5  # some labels are noise
    model = quality.fit(d, known)
    p = {r["doc_id"]: (r["source"], r["lang"], 1 / (1 + np.exp(-r["__odds"])), r["__odds"]) for r in quality.with_evidence(d, model, keep=[F.col("doc_id"), F.col("source"), F.col("lang")]).collect()}
    hosts, paths = {}, {}
    for s, lang, q, _ in p.values():
        hosts.setdefault(s, []).append(q)
        paths.setdefault((s, lang), []).append(q)
    mean = np.mean([q for *_, q, _ in p.values()])

    def strength(groups, centre):
        n = np.array([len(v) for v in groups.values()])
        r, m = np.array([np.mean(v) for v in groups.values()]), np.array([centre(k) for k in groups])
        extra = max(((n * (r - m) ** 2).sum() - (m * (1 - m)).sum()) / n.sum(), 1e-6)
        return min(max((m * (1 - m)).mean() / extra - 1, 1), 1000)

    hk, pk = strength(hosts, lambda k: mean), strength(paths, lambda k: np.mean(hosts[k[0]]))
    logit = lambda x: np.log(np.clip(x, 0.001, 0.999) / (1 - np.clip(x, 0.001, 0.999)))
    for r in quality.judged(d, known, carry=["doc_id"]).collect():
        s, lang, q, odds = p[r["doc_id"]]
        host = (sum(hosts[s]) - q + hk * mean) / (len(hosts[s]) - 1 + hk)
        path = (sum(paths[s, lang]) - q + pk * host) / (len(paths[s, lang]) - 1 + pk)
        assert r["__quality"] == pytest.approx(1 / (1 + np.exp(-(odds + logit(path) - logit(mean)))), rel=1e-6)
    none = known.where("false")
    assert quality.accepted(docs, none).count() == len(TEXTS) and quality.accepted(docs, none).columns == docs.columns
    assert quality.accepted(docs, known).count() <= len(TEXTS) and rows(quality.accepted(empty, known)) == []


# ---- 5


def plain_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split() if w]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, bits):
    keys = list(prints)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_simhash(spark, docs, empty):
    d = docs.select("doc_id", "text", "fp").unionByName(small(spark, "documents").select(F.col("doc_id") + 100, "text", F.lit(0).cast("long").alias("fp")).toDF("doc_id", "text", "fp"))
    texts = [(r["doc_id"], r["text"]) for r in d.collect()]
    prints = {}
    for i, t in texts:
        prints.setdefault(plain_fingerprint(t), []).append(i)
    comp = plain_components(prints, 2)
    least = {}
    for k, ids in prints.items():
        for i in ids:
            if i is not None:
                least[comp[k]] = min(least.get(comp[k], i), i)
    want = Counter((i, f"{plain_fingerprint(t):016x}", least.get(comp[plain_fingerprint(t)])) for i, t in texts)
    got = simhash.near_duplicates(d).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id")
    assert Counter(rows(got)) == want
    assert rows(simhash.near_duplicates(empty)) == []
    stay = simhash.survivors(docs)
    assert stay.columns == docs.columns and rows(simhash.survivors(empty)) == []
    left = {r["doc_id"] for r in stay.collect()}
    assert {None, 6, 1, 8, 10, 11, 12} <= left and not {2, 7, 13} & left and stay.count() == stay.dropDuplicates(["doc_id", "text"]).count()


@pytest.mark.parametrize("upto, blocks", [(2, 4), (24, 4), (48, 5)])
def test_large_buckets_lose_no_connection(spark, upto, blocks):
    rng = np.random.default_rng(4)
    base = int(rng.integers(0, 2**62))
    prints = {base}
    while len(prints) < 300:  # chains and stars around one fingerprint
        x = list(prints)[int(rng.integers(len(prints)))]
        for _ in range(int(rng.integers(1, 4))):
            x ^= 1 << int(rng.integers(0, 63))
        prints.add(x)
    want = plain_components(dict.fromkeys(prints), 2)
    table = spark.createDataFrame([(int(p),) for p in prints], "fp long")
    found = simhash.links(table, blocks=blocks, pairs_upto=upto)
    assert all((a ^ b).bit_count() <= 2 for a, b in rows(found))
    got = dict(rows(components.components(found)))
    classes = {}
    for p in prints:
        classes.setdefault(got.get(p, p), set()).add(p)
    other = {}
    for p, r in want.items():
        other.setdefault(r, set()).add(p)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, other.values()))


def shingles(text):
    ws = text.lower().split()
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def test_survivors_against_all_pairs(spark):
    """Near copies of five-word similarity 0.8 and more go, unlike texts stay, whatever is in between."""
    rng = np.random.default_rng(12)
    made, near, far = [], 0, 0
    for g in range(150):
        n = int(rng.integers(60, 900))
        ws = [f"w{x}" for x in rng.zipf(1.3, n) % 30_000]
        other = list(ws)
        for at in rng.integers(0, n, int(rng.integers(1, 2 + n // 45))):
            other[at] = f"new{at}"
        made += [(2 * g, " ".join(ws)), (2 * g + 1, " ".join(other))]
    left = {r["doc_id"] for r in simhash.survivors(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    text = dict(made)
    assert all(2 * g in left for g in range(150))
    for g in range(150):
        a, b = shingles(text[2 * g]), shingles(text[2 * g + 1])
        if len(a & b) / len(a | b) >= 0.8:
            near += 1
            far += 2 * g + 1 in left
    assert near > 60 and far <= 0.1 * near


def test_wide_sketches_by_text_alone():
    texts = [b"", b"one", b"one two three four", b"a b c d e f g A B", b" ", b"word " * 400 + b"x", " ".join(f"w{i % 700}" for i in range(3000)).encode()]
    data, begins = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])[:-1]
    sets, many = simhash.wide(data, begins)
    for i, t in enumerate(texts):
        one = simhash.wide(np.frombuffer(t, np.uint8), np.zeros(1, np.int64))
        assert one[0].tolist() == sets[i : i + 1].tolist() and one[1].tolist() == many[i : i + 1].tolist()
    assert not sets[0].any() and not many[4].any() and len({tuple(x) for x in many.tolist()}) == len(texts) - 1
    h = words.words_of(data, begins)[1][:9]
    assert words.set_bits(np.tile(h, 100), np.array([0, 7, 300])).tolist() == [[sum(int(x) >> b & 1 for x in part) for b in range(64)] for part in np.split(np.tile(h, 100), [7, 300])]


def test_near_copies_with_the_words_of_another_text_meet(spark):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(200)]
    shuffled = [" ".join(rng.permutation(words)) for _ in range(30)]
    texts = [x for t in shuffled for x in (t, t.upper())]  # one bag of words: one fingerprint of words for all
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.survivors(docs).collect()) == list(range(0, 60, 2))


def test_components_of_a_long_path_and_no_edges(spark):
    e = spark.range(200).selectExpr("id as a", "id + 1 as b")
    assert {c for _, c in rows(components.components(e))} == {0}
    assert rows(components.components(e.where("false"))) == []
    assert rows(components.components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long"))) == []


# ---- 6


def edit_distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d, last = [i], d
        for j, y in enumerate(b, 1):
            d.append(min(last[j] + 1, d[-1] + 1, last[j - 1] + (x != y)))
    return d[-1]


def plain_hash(word):
    h = sum(int(words.VALUE[c]) * words.ODD**i for i, c in enumerate(word)) % 2**64
    return plain_mix(h)


def plain_mix(h):
    for _ in range(2):
        h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 % 2**64
    return h ^ h >> 32


def plain_keys(line):
    """Keys of a line by whole numbers alone."""
    every = [plain_hash(w) for w in line]
    rare = [h for h, w in zip(every, line) if len(w) > lines.SHORT]
    pairs = set()
    for h in ([rare] if len(rare) >= lines.FEW else [rare, every]):
        pairs |= {plain_mix((a * words.ODD + b) % 2**64) for a, b in zip([1, *h], [*h, 2])} if h else set()
    out = []
    for band, (salt, odd) in enumerate(np.random.default_rng(words.SEED).integers(0, 1 << 63, (lines.BANDS, 2)).tolist()):
        x = sorted(((p ^ salt) * (odd | 1) % 2**64) for p in pairs)
        x = sorted((v ^ v >> 32) * words.ODD % 2**64 for v in x)
        out.append(plain_mix((plain_mix(x[0] + band) * words.ODD + x[1]) % 2**64))
    return out


@pytest.mark.parametrize("step", [4, 64, 1 << 19])
def test_hashes_of_lines(monkeypatch, step):
    monkeypatch.setattr(words, "BYTES_AT_ONCE", step)
    rng = np.random.default_rng(5)
    texts = [b"", b"One two\n\ntwo one\n", b"no break", b"", b"\n", b"one TWO", b"w" * 300, b"\x1c\xc3\xa9 x" * 300]
    texts += [bytes(rng.choice(list(b"aB \n\t"), int(rng.integers(0, 400))).astype(np.uint8)) for _ in range(60)]
    begins = np.cumsum([0, *map(len, texts)])[:-1]
    text, number, h, *each, new = lines.hashed(np.frombuffer(b"".join(texts), np.uint8), begins)
    want = [(i, k, tuple(w)) for i, t in enumerate(texts) for k, x in enumerate(t.split(b"\n")) if (w := lines.normalized(x))]
    assert list(zip(text.tolist(), number.tolist())) == [(i, k) for i, k, _ in want]
    assert len({w for _, _, w in want}) == len(set(h.tolist())) == len({(a, w) for a, (_, _, w) in zip(h.tolist(), want)})
    assert lines.bands(*each, new).tolist() == [plain_keys(w) for _, _, w in want]
    odd = np.arange(len(new)) % 2 == 1
    assert lines.bands(*each, new, odd).tolist() == [plain_keys(w) for _, _, w in want][1::2]
    assert all(len(x) == 0 for x in lines.hashed(np.zeros(0, np.uint8), np.zeros(2, np.int64))) and lines.bands(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)).shape == (0, lines.BANDS)


def test_lines(spark, docs, empty):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega " * 3
    near = base.replace("kappa", "kappas", 1)
    t = spark.createDataFrame([(1, f"{base}\nkeep me please\n\n{near}"), (2, f"{near.upper()}\nmine alone"), (3, "keep  ME please"), (4, None), (5, ""), (6, "keep me please\n" * 3 + "x"), (2, "other of two")], "doc_id long, text string")
    t = t.withColumn("line_no", F.lit("clash")).withColumn("first", F.lit(0)).withColumn("th", F.lit(1)).withColumn("did", F.lit(2))
    got = {(r["doc_id"], r["text"]) for r in lines.dedup(t).collect()}
    assert got == {(1, f"{base}\nkeep me please\n"), (2, "mine alone"), (3, ""), (4, None), (5, ""), (6, "x"), (2, "other of two")}
    assert lines.dedup(t).columns[: len(t.columns)] == t.columns
    assert lines.dedup(docs).count() == len(TEXTS) and rows(lines.dedup(empty)) == []
    out = {(r["doc_id"], r["text"]) for r in lines.dedup(docs).collect()}
    assert (11, "Line a is here\nLine b is there") in out and (12, "another line altogether") in out and (9, "one two") in out


def alike(a, b):
    """Edit similarity of two lines (tuples of words): the better of words and characters."""
    x, y = b" ".join(a).decode(), b" ".join(b).decode()
    by_words = 1 - edit_distance(a, b) / max(len(a), len(b))
    return max(by_words, 1 - edit_distance(x, y) / max(len(x), len(y)))


def test_lines_against_brute_force(spark):
    """Links are those of all similar pairs that share a key, and what goes is all but the first of each group."""
    d = common.materialize(small(spark, "documents").select("doc_id", "text").where("length(text) < 2500"), "test-docs")
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    rng = np.random.default_rng(3)
    made = []
    for i in sorted(texts)[:40]:  # copies of lines with a few words touched
        ws = texts[i].split("\n")[0].split()
        for k in range(3):
            other = list(ws)
            for at in rng.integers(0, len(ws), int(rng.integers(1, 2 + len(ws) // 6))):
                other[at] = other[at][::-1] + "x" * k
            made.append((100_000 + 3 * i + k, " ".join(other)))
    d = d.unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    texts |= dict(made)
    place, kinds = {}, {}
    for i in sorted(texts):
        for k, line in enumerate(texts[i].split("\n")):
            if w := tuple(lines.normalized(line.encode())):
                place.setdefault(w, []).append((i, k))
                kinds[w] = None
    by_key, root, met, similar = {}, {w: w for w in kinds}, Counter(), Counter()
    for w in kinds:
        for k in plain_keys(w):
            by_key.setdefault(k, []).append(w)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = {(a, b) for ws in by_key.values() for n, a in enumerate(ws) for b in ws[:n]}
    for a, b in pairs:
        if alike(a, b) >= lines.SIMILARITY - 1e-9:
            root[find(a)] = find(b)
    groups = {}
    for w in kinds:
        groups.setdefault(find(w), []).extend(place[w])
    gone = {x for g in groups.values() for x in sorted(g)[1:]}
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in texts.items()}
    assert {r["doc_id"]: r["text"] for r in lines.dedup(d).collect()} == want
    for i in sorted(texts)[:40]:  # recall, by similarity alone
        own = [w for j in range(3) for w in [tuple(lines.normalized(texts[100_000 + 3 * i + j].encode()))]] + [tuple(lines.normalized(texts[i].split("\n")[0].encode()))]
        for n, a in enumerate(own):
            for b in own[:n]:
                if a != b and alike(a, b) >= 0.8:
                    kind = 1 - edit_distance(a, b) / max(len(a), len(b)) >= 0.8
                    similar[kind] += 1
                    met[kind] += find(a) == find(b)
    # By words, as the keys are; what is alike by characters alone has more words touched.
    assert similar[True] > 50 and met[True] / similar[True] >= 0.9 and met[False] / similar[False] >= 0.5, (met, similar)


def test_lines_of_one_bag_of_words_are_all_compared(spark):
    """A, its words reversed, and those with two neighbours swapped: the last two are alike, whichever comes first by hash."""
    rng = np.random.default_rng(9)
    made = []
    for g in range(60):
        ws = [f"g{g}w{x}" for x in rng.permutation(20)]
        back = ws[::-1]
        swapped = [*back[:9], back[10], back[9], *back[11:]]
        made += [(3 * g, " ".join(ws)), (3 * g + 1, " ".join(back)), (3 * g + 2, " ".join(swapped))]
    out = dict(spark.createDataFrame(made, "doc_id long, text string").transform(lines.dedup).select("doc_id", "text").collect())
    assert all(out[3 * g] and out[3 * g + 1] and not out[3 * g + 2] for g in range(60))


def replaced_share(spark, n, cuts, pairs=60):
    """Share of pairs of lines of ``n`` words, ``cuts`` of them replaced, of which the second line goes."""
    rng = np.random.default_rng(n)
    rows = []
    for i in range(pairs):
        words = [f"w{x}" for x in rng.integers(0, 10**9, n)]
        other = list(words)
        for k in rng.choice(n, cuts, replace=False):
            other[k] = f"v{i}x{k}"
        rows += [(i, " ".join(words)), (1000 + i, " ".join(other))]
    out = dict(spark.createDataFrame(rows, "doc_id long, text string").transform(lines.dedup).select("doc_id", "text").collect())
    assert all(out[i] for i in range(pairs))
    return sum(not out[1000 + i] for i in range(pairs)) / pairs


@pytest.mark.parametrize("n", [10, 20, 100])
def test_lines_with_replaced_words_go(spark, n):
    assert replaced_share(spark, n, 1) >= 0.95
    assert replaced_share(spark, n, n // 5) >= 0.85


@pytest.mark.parametrize("groups", [2, 30])
def test_lines_of_one_key_are_all_compared(spark, groups):
    """The least line of the key is like no other; the others are similar in small groups."""
    rng = np.random.default_rng(8)
    texts = ["alone " * 10]
    for g in range(groups):
        ws = [hashlib.md5(f"{g} {k}".encode()).hexdigest()[:8] for k in range(10)]
        texts += [" ".join(ws), " ".join([*ws[:9], "x"]), " ".join(["y", *ws[1:9], "x"])]
    order = rng.permutation(len(texts) - 1)
    h = [0, *(int(x) + 1 for x in order)]
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "did long, th long, text string")
    table = spark.createDataFrame([(i, i, 0, h[i], [7]) for i in range(len(texts))], "did long, th long, line_no int, h long, keys array<long>")
    of = {h[i]: (i - 1) // 3 for i in range(1, len(texts))}
    got = dict(rows(lines.groups(docs, table).selectExpr("h", "first.did")))
    assert got == {k: 3 * g + 1 for k, g in of.items()}


@pytest.mark.parametrize("block", [16, 512])
def test_unlike_lines_of_one_key_make_no_rows_of_pairs(spark, monkeypatch, block):
    """90 lines share half of their words and a key, 30 of these have one near copy; links are right, and pairs are not sent to be compared."""
    rng = np.random.default_rng(11)
    made = lambda n: ["".join(chr(97 + x) for x in rng.integers(0, 26, 6)) for _ in range(n)]
    passage = made(24)
    texts = [" ".join([*made(22), *passage]) for _ in range(90)]
    texts += [t[:40] + "#" + t[41:] for t in texts[:30]]
    h = [int(x) + 1 for x in rng.permutation(len(texts))]
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "did long, th long, text string")
    table = spark.createDataFrame([(i, i, 0, h[i], [7, 8]) for i in range(len(texts))], "did long, th long, line_no int, h long, keys array<long>")
    sent, plain = [], lines.linked

    def counted(keyed, prepare, alike, verified, *rest):
        def counting(pairs):
            sent.append(pairs.count())
            return verified(pairs)

        return plain(keyed, prepare, alike, counting, *rest)

    monkeypatch.setattr(lines, "linked", counted)
    monkeypatch.setattr(blocking, "BLOCK", block, raising=False)
    got = dict(rows(lines.groups(docs, table).selectExpr("h", "first.did")))
    assert got == {h[i]: i % 90 for i in [*range(30), *range(90, 120)]}
    assert sum(sent) <= 3 * len(texts), sent


def test_keys_with_the_same_lines_are_worked_on_once(spark, monkeypatch):
    """40 pairs of similar lines share ten keys each, a third line shares one of these with the first; each pair is sent once, the third lines are found."""
    made = lambda *x: hashlib.md5(repr(x).encode()).hexdigest()[:9]
    texts, keys = [], []
    for g in range(40):
        ws = [made(g, k) for k in range(12)]
        texts += [" ".join(ws), " ".join([*ws[:11], "x"]), " ".join(["y", "z", *ws[2:]])]
        keys += [[100 * g + k for k in range(11)], [100 * g + k for k in range(10)], [100 * g + 10]]
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "did long, th long, text string")
    table = spark.createDataFrame([(i, i, 0, i + 1, x) for i, x in enumerate(keys)], "did long, th long, line_no int, h long, keys array<long>")
    sent, plain = [], lines.compared

    def counted(rows, *args, **named):
        sent.append(rows.count())
        return plain(rows, *args, **named)

    monkeypatch.setattr(lines, "compared", counted)
    assert dict(rows(lines.groups(docs, table).selectExpr("h", "first.did"))) == {i + 1: 3 * (i // 3) for i in range(len(texts))}
    assert sent == [2 * 2 * 40]


def test_each_pair_of_a_key_meets_once(spark, monkeypatch):
    """Records of one key in blocks of 8: all pairs but those within the greatest component."""
    monkeypatch.setattr(blocking, "BLOCK", 8)
    rest = [(k, u, -1 if u < great else u) for k, n, great in [(1, 60, 25), (2, 7, 3), (3, 40, 0), (4, 2, 2)] for u in range(n)]
    met = Counter()
    at = {}
    for k, i, j, b, u, c, lower in rows(blocking.dealt(spark.createDataFrame(rest, "k long, u long, c long"))):
        assert b in (i, j) and set(lower) == {x for x, v, _ in rest if v == u and x < k}
        at.setdefault((k, i, j), []).append((b, u, c))
    for (k, i, j), members in at.items():
        assert len(members) <= 40  # two blocks, dealt by hash
        for n, (b, u, c) in enumerate(members):
            met.update((k, *sorted((u, v))) for d, v, e in members[:n] if c != e and (i == j or b != d))
    want = {(k, u, v) for k, u, c in rest for x, v, d in rest if k == x and u < v and c != d}
    assert set(met) == want and set(met.values()) <= {1}


def test_edits_up_to_a_limit():
    """Against the plain recurrence, with bands of one and of several numbers of 64 bits."""
    rng = np.random.default_rng(6)
    a, b, limits = [], [], []
    for n, kinds in [(3, 2), (40, 4), (90, 30), (160, 400), (420, 12)]:
        for _ in range(30):
            x = "".join(chr(c) for c in rng.integers(0x61, 0x61 + kinds, int(rng.integers(n - n // 6, n + 1))))
            y = list(x)
            for at in rng.integers(0, len(x), int(rng.integers(0, 1 + n // 3))).tolist():
                y[min(at, len(y) - 1) : at + int(rng.integers(0, 2))] = ["x\U0001f600"[int(rng.integers(0, 2))]]
            y = "".join(y)
            y = y[n // 5 :] + y[: n // 5] if rng.random() < 0.2 else y
            d = edit_distance(x, y)
            a, b, limits = [*a, x, x], [*b, y, y], [*limits, d, max(d - 1, 0)]
    a, b, limits = [*a, "", "", "ab"], [*b, "", "ab", ""], np.array([*limits, 0, 1, 2])
    want = [edit_distance(x, y) <= k for x, y, k in zip(a, b, limits)]
    assert edits.near(a, b, limits).tolist() == want == [edits.within(x, y, int(k)) for x, y, k in zip(a, b, limits)]
    assert edits.near([], [], np.zeros(0, np.int64)).tolist() == []


def test_edits_of_arrays_are_ruled_out_by_what_one_side_lacks(monkeypatch):
    """Numbers of 32 bits; of pairs that have too few in common none is compared step by step."""
    rng = np.random.default_rng(9)
    x = [rng.integers(0, 1 << 32, 60).astype(np.uint32) for _ in range(40)]
    y = [np.r_[a[5:], a[:5]] if i % 2 else rng.integers(0, 1 << 32, 60).astype(np.uint32) for i, a in enumerate(x)]
    compared, plain = [], edits._banded
    monkeypatch.setattr(edits, "_banded", lambda a, b, limits: compared.append(len(a)) or plain(a, b, limits))
    assert edits.near(x, y, np.full(40, 12)).tolist() == [bool(i % 2) for i in range(40)]
    assert compared == [20]


def test_pairs_of_several_keys_are_compared_once(spark):
    """All of 30 records share three keys; none is like a hub, some are like each other."""
    keyed = spark.createDataFrame([(k, u) for k in (5, 6, 7) for u in range(30)], "k long, u long")
    asked = []

    def verified(pairs):
        asked.append(rows(pairs.selectExpr("least(u, v)", "greatest(u, v)")))
        return pairs.where("mu % 7 = mv % 7 and u > 2 and v > 2").select("u", "v")

    hubs = {min(range(30), key=lambda u: u ^ order) for order in blocking.ORDERS}
    got = blocking.linked(keyed, lambda nodes: common.materialize(nodes.select("u", F.col("u").alias("mark")), "test-marks"), lambda a, b: a != b, verified)
    last = asked[-1]
    known = {h % 7 for h in hubs if h > 2}  # linked to a hub already
    want = {(u, v) for u in range(3, 30) for v in range(u + 1, 30) if u % 7 == v % 7 and u % 7 not in known}
    assert len(last) == len(set(last)) and set(last) >= want
    assert {tuple(sorted(x)) for x in rows(got)} >= want


# ---- 7


def plain_hits(text, items):
    words = decontamination.words_of(None if text is None else text.encode())
    hit, found = set(), set()
    for item, t in items:
        w = decontamination.words_of(None if t is None else t.encode())
        n = min(8, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in grams:
                hit.update(range(i, i + n))
                found.add(str(item))
    return len(words), len(hit), len(found), decontamination.item_digest(list(found)), len(found) >= 2


@pytest.mark.parametrize("bits", [25, 6])
def test_decontamination(spark, docs, empty, bits):
    items = [(1, "brown fox jumps over the lazy dog and runs"), (2, "one TWO"), (3, "one"), (4, None), (5, ""), (2, "one two"), (6, " ".join(f"word{i}" for i in range(900, 930))), (7, "fox jumps over the lazy dog and runs away x y z")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(9))
    extra = [(50, "a brown, FOX jumps-over the lazy dog and stops"), (51, "brown fox jumps over the lazy dog and"), (52, "x " + " ".join(f"word{i}" for i in range(905, 913)) + " y")]
    d = docs.select("doc_id", "text", F.lit("c").alias("items"), F.lit("d").alias("n_words")).unionByName(spark.createDataFrame([(i, t, "c", "d") for i, t in extra], "doc_id long, text string, items string, n_words string"))
    got = decontamination.report(decontamination.find(d, bench, ["doc_id"], filter_bits=bits))
    assert Counter(rows(got)) == Counter((i, *plain_hits(t, items)) for i, t in TEXTS + extra)
    assert rows(decontamination.find(empty, bench, ["doc_id"])) == []
    assert decontamination.clean(docs, bench.where("false")).count() == len(TEXTS)
    left = {r["doc_id"] for r in decontamination.clean(docs, bench).collect()}
    three = spark.createDataFrame([(1, "brown fox jumps"), (2, "over the lazy")], "item_id long, text string")
    assert decontamination.clean(docs, three).count() == len(TEXTS)  # two short items side by side are no long one
    assert 1 not in left and 2 not in left and {3, 4, 8, 11} <= left and decontamination.clean(docs, bench).columns == docs.columns


# ---- 8


def plain_warc(pages):
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in pages:
        data = (h or "").encode()
        to = first.get(h or "")
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if to is None or to == i else "revisit", None if to is None or to == i else to))
    return Counter(out)


@pytest.mark.parametrize("gzip", [True, False])
def test_warc_round_trip(spark, gzip, monkeypatch):
    pages = [(3, "http://a/ \nb", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "u", None), (5, "u", ""), (7, "u", "WARC/1.1\r\n\r\nnot a head\r\n\r\n"), (8, "u", "z" * (3 * warc.CHUNK + 5)), (9, "u", "z" * (3 * warc.CHUNK + 5)), (None, "u", "<p>é</p>"), (None, "u", "alone"), (1, None, "<p>é</p>")]
    t = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("sha1", F.lit("clash")).withColumn("first", F.lit(1)).repartition(2)
    assert Counter(rows(warc.round_trip(t, gzip))) == plain_warc(pages)
    assert rows(warc.round_trip(t.where("false"), gzip)) == []
    folder = common.new_path(spark, "warc-test")
    manifest = common.materialize(warc.write(warc.decisions(t), folder, gzip), "warc-test")
    got = warc.read(manifest, folder).where("page_id = 8").orderBy("chunk_no").collect()
    data = b"".join(bytes(r["chunk"]) for r in got)
    assert data == b"z" * (3 * warc.CHUNK + 5) and len(got) >= 4 and max(len(r["chunk"]) for r in got) <= warc.CHUNK and [r["last"] for r in got] == [False] * (len(got) - 1) + [True]
    at = 0
    for r in got:
        at += len(r["chunk"])
        assert r["bytes_so_far"] == at and r["digest_so_far"] == warc.base32_sha1(hashlib.sha1(data[:at]).digest())


# ---- 9


def test_toxicity(spark, docs, empty):
    d, known = common.table(spark, "/root/testdata/sf0.1", "documents"), common.table(spark, "/root/testdata/sf0.1", "labels")
    machine = toxicity.fit(d, known)
    got = toxicity.score(d, machine, ["doc_id"]).join(known, "doc_id").collect()
    held = [(r["score"], r["toxic"]) for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    s, y = np.array([a for a, _ in held]), np.array([b for _, b in held])
    assert (s[y == 1][:, None] > s[y == 0][None]).mean() > 0.95
    scores = [r["score"] for r in toxicity.score(docs.withColumn("y", F.lit(1)), machine, ["doc_id"]).collect()]
    assert len(scores) == len(TEXTS) and all(0 <= x <= 1 for x in scores)
    assert rows(toxicity.score(empty, machine, ["doc_id"])) == []
    turned = known.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit(d, turned)  # labels held out have no say
    assert (again.bias, again.w.tolist(), again.v.tolist()) == (machine.bias, machine.w.tolist(), machine.v.tolist())
    many = d.unionByName(d).unionByName(d)
    assert toxicity.labelled_sample(many, known, "toxic", 50).count() == 50
    flat = toxicity.fit(d, known.where("toxic = 1"))
    assert len({r["score"] for r in toxicity.score(docs, flat, ["doc_id"]).collect()}) == 1


def test_machine_learns_a_pair_that_no_sum_of_weights_can():
    rng = np.random.default_rng(0)
    a, b = 11, 22  # wrong only together or not at all
    rows_, y = [], []
    for _ in range(800):
        x, z = rng.integers(0, 2, 2)
        rows_.append(np.array(sorted({*([a] if x else []), *([b] if z else []), *rng.integers(100, 130, 3)})))
        y.append(int(x == z))
    m = toxicity.Machine(rounds=400, slots=200).fit(rows_, np.array(y))
    got = [m.score([m.number[s] for s in r if s in m.number]) >= 0.5 for r in rows_]
    assert np.mean(np.array(got) == np.array(y)) > 0.95


# ---- 10


def check_packing(spark, table, texts):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    got = [r.asDict() for r in packing.pack(table, path).collect()]
    t = Tokenizer.from_file(path)
    want = Counter()
    for i, text in texts:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for a in range(0, len(ids), 2048):
            want[i, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for off, n in sorted(pieces):
            assert off == at
            at += n
        assert at <= 2048
    return len(by), sum(r["length"] for r in got)


def test_packing(spark, docs, empty):
    check_packing(spark, docs.withColumn("cls", F.lit(1)).withColumn("start", F.lit("s")), TEXTS)
    assert rows(packing.pack(empty, packing.default_tokenizer())) == []
    d = small(spark, "documents")
    many, tokens = check_packing(spark, d, [(r["doc_id"], r["text"]) for r in d.collect()])
    assert many <= 1.05 * tokens / 2048 + 2


def test_words_have_the_tokenizer_s_ids():
    w = packing.WordIds(packing.default_tokenizer())
    for text in ("Don't I'LL we've\tx1y2", "İSTANBUL ΣΑΣ ς", "a<|endoftext|>b <|startoftext|>", "é ½ ²x ß ẞ", "中文　字\x85a\xa0b", "—“q”… 😀😀", "x" * 500, "\x1fa\x00b", "it's'S 'tis"):
        want = w.whole.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(w.ids(text.encode()), "<u4").tolist() == want, text


def test_cutting_stock_meets_demand_and_the_bound():
    rng = np.random.default_rng(0)
    for width, n in ((32, 500), (64, 10_000), (16, 3), (8, 0)):
        demand = rng.multinomial(n, rng.dirichlet(np.ones(width)))
        plan = packing.cutting_stock(demand)
        assert (sum((k * c for k, c in plan), np.zeros(width, int)) == demand).all()
        assert all(k > 0 and c @ np.arange(1, width + 1) <= width for k, c in plan)
        assert sum(k for k, _ in plan) <= 1.1 * demand @ np.arange(1, width + 1) / width + width


# ---- all


def test_names_and_sql():
    q = entry.queries()
    assert sorted({int(n[2:].split("_")[0]) for n in q}) == list(range(1, 11)) and set(entry.oracle_sql()) <= set(q)


def test_pipeline(spark, docs, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    now = common.table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.materialize(stage(spark, now, sf), "test-stage")
        assert out.columns == now.columns and 0 < out.count() <= now.count(), name
        now = out
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, sf)
    assert {r["doc_id"] for r in pieces.collect()} == {r["doc_id"] for r in now.collect()}
    odd = docs
    for _, stage in corpus_pipeline.STAGES:
        odd = common.materialize(stage(spark, odd, sf), "test-odd")
    assert odd.count() > 0
    none = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        none = common.materialize(stage(spark, none, sf), "test-none")
    assert none.count() == 0
