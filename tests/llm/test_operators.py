"""Each operator of the subpackage against a brute-force version, with nulls, empties, ties, repeated rows and clashing names."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioweave.llm import feistel, fmindex, itq, langid, minhash, mixing, nearest, packing, pitmanyor, substring, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, ids=None, extra=False):
    rows = [(i if ids is None else ids[i], t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    for clash in ("id", "mark", "key", "words", "u", "at") if extra else ():
        df = df.withColumn(clash, F.lit("x"))
    return df


def words(rng, n, vocabulary=60):
    return " ".join(f"w{x}" for x in rng.integers(0, vocabulary, n))


EDGE = [None, "", "  \t\n", "one", "one", "x " * 30, "ÄÖ é ß"]


# 1 ------------------------------------------------------------------------------------------------


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def test_feistel_keeps_formats_and_links(spark):
    texts = ["card 4111 1111 1111 1111, ip 10.0.0.1 and 10.0.0.1", "again 4111-1111-1111-1111 on 2024-02-29 or 29.02.2024", "no card 4111111111111112", "mail a.b9@x.org; 123-45-6789", *EDGE]
    out = [tuple(r) for r in feistel.pseudonymise(docs_of(spark, texts, extra=True), "k", count_col="n").select("text", "n").collect()]
    card = re.search(r"[0-9]{4}(?: [0-9]{4}){3}", out[0][0])[0]
    assert luhn(card.replace(" ", "")) and card != "4111 1111 1111 1111" and card.replace(" ", "-") in out[1][0]
    a, b = re.findall(r"\d+\.\d+\.\d+\.\d+", out[0][0])
    assert a == b != "10.0.0.1" and out[0][1] == 3
    y, m, d = re.search(r"on (\d+)-(\d+)-(\d+)", out[1][0]).groups()
    assert f"{d}.{m}.{y}" in out[1][0]
    assert out[2] == ("no card 4111111111111112", 0)
    assert re.fullmatch(r"mail [a-z]\.[a-z][0-9]@x\.org; \d{3}-\d\d-\d{4}", out[3][0]) and "123-45-6789" not in out[3][0]
    assert [t for t, _ in out[4:]] == EDGE


def twin(d, key, tweak=""):
    """The permutation of a string of digits in plain Python, and its inverse."""
    f = lambda i, x: int(hashlib.sha256("|".join([hashlib.sha256(key.encode()).hexdigest(), str(i), tweak, str(x)]).encode()).hexdigest()[:15], 16)
    h = len(d) // 2
    a, b = 10**h, 10 ** (len(d) - h)
    x, y = int(d[:h]), int(d[h:])
    for i in range(0, feistel.ROUNDS, 2):
        x = (x + f(i, y)) % a
        y = (y + f(i + 1, x)) % b
    u, v = x, y
    for i in reversed(range(0, feistel.ROUNDS, 2)):
        v = (v - f(i + 1, u)) % b
        u = (u - f(i, v)) % a
    assert (u, v) == (int(d[:h]), int(d[h:]))
    return f"{x:0{h}d}{y:0{len(d) - h}d}"


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def test_feistel_equals_its_twin(spark):
    rng = np.random.default_rng(23)
    values = ["".join(map(str, rng.integers(0, 10, n))) for n in (2, 7, 15, 18, 19) for _ in range(5)]
    df = spark.createDataFrame([(v,) for v in values], "d string").select("d", feistel.digits_permuted(F.col("d"), "k", "t").alias("e"))
    assert all(r["e"] == twin(r["d"], "k", "t") for r in df.collect())
    bban = "00370400440532013000"[2:]
    iban = f"DE{98 - int(bban + '131400') % 97:02d}{bban}"
    assert mod97(iban) == 1
    texts = ["555-123-4567 and 555.123.4567 or +1 555 123 4567", "on 12/25/2020, 25/12/2020, 08/31/1999 and 02/29/2000", f"pay {iban} or {iban[:4]} {iban[4:8]} {iban[8:12]} {iban[12:16]} {iban[16:20]} {iban[20:]}", "no 12-34-56 or 99/99/2020"]
    out = [r["text"] for r in feistel.pseudonymise(docs_of(spark, texts), "k").orderBy("doc_id").collect()]
    last = twin("1234567", "kphone", "555")
    assert out[0].startswith(f"555-{last[:3]}-{last[3:]} and 555.{last[:3]}.{last[3:]} or +1 555 ")
    us, eu, end, leap = re.findall(r"\d\d/\d\d/\d{4}", out[1])
    assert 13 <= int(us[3:5]) <= 28 and us != "12/25/2020" and eu != "25/12/2020" and int(eu[3:5]) <= 12 and int(end[3:5]) >= 29 and leap == "02/29/2000"
    plain, spaced = re.fullmatch(r"pay (\w+) or ([\w ]+)", out[2]).groups()
    assert mod97(plain) == 1 and plain != iban and spaced.replace(" ", "") == plain and out[3] == texts[3]
    days = spark.range(28).select(F.concat(F.lit("03/"), F.lpad((F.col("id") + 1).cast("string"), 2, "0"), F.lit("/2001")).alias("text"))
    got = [r["text"] for r in feistel.pseudonymise(days, "k").collect()]
    assert len(set(got)) == 28


def test_feistel_is_a_permutation(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    assert df.select(feistel.digits_permuted(F.col("d"), "k").alias("e")).where("e rlike '^[0-9]{3}$'").distinct().count() == 1000
    assert feistel.pseudonymise(docs_of(spark, []), "k").count() == 0


# 2, 6 ---------------------------------------------------------------------------------------------


def vectors(spark, rng, n=300, dim=16):
    base = rng.normal(size=(n, dim)).astype(np.float32)
    base[n // 2 :] = base[: n - n // 2] + rng.normal(size=(n - n // 2, dim)).astype(np.float32) * rng.choice([0, 0.05, 0.3], size=(n - n // 2, 1)).astype(np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(1000, None), (1001, [0.0] * dim), (1002, [float("nan")] * dim), (1003, [None] * dim), (1004, []), (1005, [1.0, 2.0]), (1006, [2.0, 4.0])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>"), base


def test_itq_finds_all_links(spark):
    df, base = vectors(spark, np.random.default_rng(1))
    m = base.astype(float)
    unit = m / np.sqrt((m * m).sum(1))[:, None]
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    root = np.arange(len(m))
    for _ in range(len(m)):
        low = np.minimum(root, np.where(near, root[None, :], len(m)).min(1))
        if (low == root).all():
            break
        root = low
    got = {r["vec_id"]: r for r in itq.near_vectors(df.withColumn("class", F.lit(1))).collect()}
    assert len(got) == len(m) + 7
    assert [got[i]["n_links"] for i in range(len(m))] == near.sum(1).tolist()
    assert [got[i]["component_id"] for i in range(len(m))] == root.tolist()
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(1000, 1005))
    assert (got[1006]["n_links"], got[1006]["component_id"], got[1006]["kept"]) == (1, 1005, False)
    assert itq.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("dim", [64, 256])
def test_itq_finds_planted_links(spark, dim, monkeypatch):
    """Pairs at cosines just above the threshold; buckets that are cut into parts; repeated ids, null ids, huge numbers."""
    monkeypatch.setattr(itq, "BUCKET", 32)
    rng = np.random.default_rng(dim)
    base = rng.normal(size=(600, dim))
    base /= np.linalg.norm(base, axis=1)[:, None]
    other = rng.normal(size=base.shape)
    other -= (other * base).sum(1)[:, None] * base
    other /= np.linalg.norm(other, axis=1)[:, None]
    cos = rng.uniform(0.9005, 0.99, 600)
    near = cos[:, None] * base + np.sqrt(1 - cos**2)[:, None] * other
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate((base, near)))]
    rows += [(None, rows[0][1]), (5000, [1e150 * x for x in rows[1][1]]), (5000, rows[2][1])]
    got = itq.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append(r)
    assert sum(by[i + 600][0]["component_id"] == min(i, 600) for i in range(600)) >= 597
    assert by[None][0]["kept"] and by[None][0]["n_links"] == 0
    assert len(by[5000]) == 2 and {r["component_id"] for r in by[5000]} <= {1, 2} and all(r["n_links"] >= 1 for r in by[5000])
    assert len(got) == len(rows)


def test_hamming_radius():
    p, bits = math.acos(0.9) / math.pi, 64
    r = itq.radius_for(0.9, bits)
    tail = lambda r: sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(r + 1, bits + 1))
    assert tail(r) <= itq.FAR < tail(r - 1)


def test_itq_codes_are_balanced():
    sample = np.random.default_rng(0).normal(size=(2000, 16))
    (r,) = itq.learn_rotations(sample, 1)
    assert abs((sample @ r > 0).mean(0) - 0.5).max() < 0.05


def test_nearest_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 64)
    df, base = vectors(spark, np.random.default_rng(2))
    m = base.astype(float)
    got = {}
    for r in nearest.top_inner_products(df, F.col("vec_id") % 20 == 0, k=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, len(m), 20):
        score = m @ m[q]
        best = sorted((x for x in range(len(m)) if x != q), key=lambda x: (-score[x], x))[:5]
        assert [x[1] for x in sorted(got[q])] == best and np.allclose([x[2] for x in sorted(got[q])], score[best], rtol=1e-12)
    assert set(got) == set(range(0, len(m), 20))
    assert nearest.top_inner_products(df.limit(0), F.lit(True)).count() == 0


def test_nearest_ties_repeated_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(nearest, "PAIRS", 100)
    rows = [(i, [1.0, 2.0]) for i in range(300)] + [(0, [2.0, 1.0]), (None, [9.0, 9.0])]
    got = nearest.top_inner_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=3).collect()
    assert sorted((r["score"], r["vec_id"], r["rank"]) for r in got) == [(4.0, i, i) for i in (1, 2, 3)] + [(5.0, i, i) for i in (1, 2, 3)]


# 3 ------------------------------------------------------------------------------------------------


def shingles(text, k):
    w = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.mark.parametrize("k", [2, 5])
def test_minhash_equals_brute_force(spark, k):
    rng = np.random.default_rng(k)
    texts = list(EDGE)
    for _ in range(25):
        base = words(rng, int(rng.integers(40, 160)), 500).split()
        texts.append(" ".join(base))
        for cut in (0, 1, 3, 8):
            w = list(base)
            for x in rng.integers(0, len(w), cut):
                w[x] = "new"
            texts.append(" ".join(w).upper())
    sets = [shingles(t, k) for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            x, y = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if y and 100 * x >= 80 * y:
                ra, rb = sorted((root[a], root[b]))
                root = [ra if r == rb else r for r in root]
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs_of(spark, texts, extra=True), k=k).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i]["component_id"] for i in range(len(texts))] == root
    assert minhash.near_duplicates(docs_of(spark, [])).count() == 0
    same = minhash.near_duplicates(docs_of(spark, ["a b", "a b", None], ids=[5, 5, None])).collect()
    assert len(same) == 3 and all(r["kept"] for r in same)


def test_minhash_rows_of_one_id_are_one_vertex(spark):
    rng = np.random.default_rng(14)
    a, b = words(rng, 60, 500), words(rng, 60, 500)
    docs = docs_of(spark, [a, a, b, b, " ", a], ids=[3, 5, 5, 7, 7, 3])
    got = sorted(tuple(r)[:1] + tuple(r)[2:] for r in minhash.near_duplicates(docs, k=2).collect())
    assert got == [(3, 3, True), (3, 3, True), (5, 3, False), (5, 3, False), (7, 3, False), (7, 3, False)]


def test_minhash_long_text(spark):
    long = words(np.random.default_rng(15), 200_000, 10**6)
    got = minhash.near_duplicates(docs_of(spark, [long + " end", "short", long])).collect()
    assert sorted(r["component_id"] for r in got) == [0, 0, 1]


def test_minhash_links_many_edited_copies_of_one_text(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PART", 300)
    rng = np.random.default_rng(3)
    original = [f"o{i}" for i in range(301)]
    texts = [" ".join(original)]
    for i in range(1200):
        w = list(original)
        for at in rng.choice(np.arange(2, 299, 3), 15, replace=False):
            w[at] = f"n{i}x{at}"
        texts.append(" ".join(w))
    sets = [shingles(t, 2) for t in texts]
    alike = lambda x, y: 100 * len(x & y) >= 80 * len(x | y)
    assert all(alike(sets[0], s) for s in sets) and not any(alike(sets[i], sets[i + 1]) for i in range(1, 1200))
    ids = [int(x) for x in rng.permutation(len(texts)) + 10]
    got = minhash.near_duplicates(docs_of(spark, texts, ids=ids), k=2).collect()
    assert [r["component_id"] for r in got] == [10] * len(texts)


def test_minhash_sketches_reject_no_link():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(-(2**63), 2**63, n)) for n in (3, 250, 257, 600, 3000)]
    sets += [np.union1d(s[rng.random(len(s)) > 0.1], rng.integers(-(2**63), 2**63, len(s) // 12)) for s in sets for _ in range(8)]
    size, part = np.array([len(s) for s in sets]), np.arange(len(sets)) % 2
    for parts in (part, part * 0):
        got = set(zip(*minhash.close(size, [minhash.sketch(s) for s in sets], parts, np.arange(len(sets)), 80)))
        got = {tuple(sorted(map(int, x))) for x in got}
        for a in range(len(sets)):
            for b in range(a + 1, len(sets)):
                x = len(np.intersect1d(sets[a], sets[b]))
                if 100 * x >= 80 * (size[a] + size[b] - x) and (parts[a] != parts[b] or not parts.any()):
                    assert (a, b) in got


# 4 ------------------------------------------------------------------------------------------------


def cut(texts, ids, width):
    w = [WORD.findall(t or "") for t in texts]
    first = {}
    for i, x in zip(ids, w):
        for a in range(len(x) - width + 1):
            key = tuple(x[a : a + width])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, x in zip(ids, w):
        gone = {a + j for a in range(len(x) - width + 1) if first[tuple(x[a : a + width])] < i for j in range(width)}
        kept = [v for p, v in enumerate(x) if p not in gone]
        out.append((i, len(x), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("hot,shard", [(4096, 1024), (4096, 2), (0, 1024), (3, 8)])
def test_substring_equals_brute_force(spark, hot, shard):
    rng = np.random.default_rng(4)
    passages = [words(rng, n, 300) for n in (49, 50, 51, 80, 200)]
    texts = [*EDGE, *passages]
    for _ in range(60):
        parts = [words(rng, int(rng.integers(0, 60)), 300)]
        for p in rng.integers(0, len(passages), 2):
            w = passages[p].split()
            if rng.random() < 0.4:
                w[int(rng.integers(0, len(w)))] = "changed"
            parts += [" ".join(w), words(rng, int(rng.integers(0, 9)), 300)]
        texts.append("\n".join(parts))
    ids = [int(x) for x in rng.permutation(len(texts))]
    got = substring.remove_repeats(docs_of(spark, texts, ids, extra=True), shard=shard, hot=hot)
    assert sorted(tuple(r)[:4] for r in got.collect()) == sorted(cut(texts, ids, 50))


def test_fm_index_searches():
    rng = np.random.default_rng(5)
    text = np.append(rng.integers(1, 4, 499), 0)
    index = fmindex.FMIndex(text, np.arange(500), 8)
    for _ in range(200):
        pattern = text[(a := int(rng.integers(0, 490))) : a + int(rng.integers(1, 8))]
        lo, hi = np.array([0]), np.array([500])
        for c in pattern[::-1]:
            lo, hi = index.extend(lo, hi, np.array([c]))
        places = [i for i in range(500 - len(pattern) + 1) if (text[i : i + len(pattern)] == pattern).all()]
        assert hi[0] - lo[0] == len(places) and index.smallest_owner(lo, hi)[0] == places[0]


def test_substring_empty(spark):
    assert substring.remove_repeats(docs_of(spark, [])).count() == 0


# 5, 9 ---------------------------------------------------------------------------------------------


def test_toxicity_learns_and_gradient_reaches_the_words(spark):
    rng = np.random.default_rng(6)
    texts = [words(rng, 60, 200) + (" vile slur" if i % 3 == 0 else "") for i in range(300)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(200)] + [(999, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs_of(spark, texts), labels, lang_col="lang")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs_of(spark, texts + EDGE, extra=True), model).collect()}
    assert np.mean([got[i]["predicted"] == (i % 3 == 0) for i in range(200, 300)]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values()) and all(got[i]["predicted"] == 0 for i in range(300, 303))
    assert set(model.thresholds) == {"en"}
    none = toxicity.learn(docs_of(spark, texts), labels.where("toxic = 0"))
    assert {r["score"] for r in toxicity.toxicity(docs_of(spark, EDGE), none).collect()} == {0.0}


def test_toxicity_features_equal_a_plain_convolution():
    rng = np.random.default_rng(18)
    texts = [rng.integers(0, 2**63, int(n)).astype(np.uint64) for n in (0, 1, 2, 9, 40)]
    model = toxicity.Model(tags=np.zeros(toxicity.BUCKETS, np.uint32))
    for t in texts:
        model.tags[(t >> np.uint64(48)).astype(int)] = (t & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    model.tables = {w: rng.normal(size=(w, toxicity.BUCKETS + 1, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS}
    model.bias = rng.normal(size=(len(toxicity.WIDTHS), toxicity.FILTERS)).astype(np.float32)
    ids = [model.ids(t) for t in texts]
    got = model.features(np.concatenate(ids), np.concatenate(([0], np.cumsum([len(i) for i in ids]))))
    for row, own in zip(got, ids):
        for k, w in enumerate(toxicity.WIDTHS):
            best = np.zeros(toxicity.FILTERS)
            for a in range(len(own) - w + 1):
                best = np.maximum(best, sum(model.tables[w][j][own[a + j]] for j in range(w)) + model.bias[k])
            assert np.allclose(row[k * toxicity.FILTERS : (k + 1) * toxicity.FILTERS], best, atol=1e-5)


def test_toxicity_thresholds_by_language(spark):
    docs = docs_of(spark, ["a b"] * 3).withColumn("lang", F.array(F.lit("en"), F.lit("de"), F.lit(None).cast("string"))[F.col("doc_id").cast("int")])
    model = toxicity.Model(prior=0.6, thresholds={"en": 0.5, "de": 0.65})
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, model, lang_col="lang").collect()}
    assert [got[i]["predicted_lang"] for i in range(3)] == [1, 0, 0] and all(r["predicted"] == 0 for r in got.values())


def test_toxicity_learns_from_all_labelled_documents(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD_WORDS", 12_000, raising=False)  # four shards
    n = 12_600
    texts = [f"w{i % 3150} plain" + (" vile" if i % 40 == 0 else "") for i in range(n)]  # each word in MIN_DOCS documents
    labels = spark.createDataFrame([(i, int(i % 40 == 0)) for i in range(n)], "doc_id long, toxic int")
    model = toxicity.learn(docs_of(spark, texts), labels, lang_col="lang")
    column = toxicity.pa.array([f"w{i}" for i in range(3150)])
    ((_, _, buf, off),) = toxicity.chunks(column)
    hashes, _ = toxicity.word_hashes(buf, off)
    assert (model.tags[(hashes >> np.uint64(48)).astype(int)] > 0).all()  # a sample misses some documents of most words
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs_of(spark, ["w1 plain", "w2 plain vile", "w3 plain"]), model).collect()}
    assert got == {0: 0, 1: 1, 2: 0}
    known = labels.where("doc_id % 7 = 0").select(F.col("doc_id").alias("id"))
    kept = {r["id"] for r in toxicity._marked(docs_of(spark, texts).withColumnRenamed("doc_id", "id"), known).collect()}
    assert set(range(0, n, 7)) <= kept and len(kept) < n / 6


def test_toxicity_calibration_counts_every_document():
    rng = np.random.default_rng(24)
    z, y = rng.integers(-3000, 3000, 500), rng.integers(0, 2, 500)
    z = np.where(y == 1, z + 2000, z)
    tally = Counter(zip(z.tolist(), y.tolist()))
    counts = [("en", v, tally[v, 0], tally[v, 1]) for v in sorted(set(z.tolist()))]
    model = toxicity.Model()
    toxicity.calibrate(model, counts, float(y.mean()))
    f1 = [2 * (y[z >= v] == 1).sum() / ((z >= v).sum() + y.sum()) for v in z]
    p = 1 / (1 + np.exp(-(model.scale * z / toxicity.GRID + model.shift)))
    assert np.isclose(2 * y[p >= toxicity.OPERATING].sum() / ((p >= toxicity.OPERATING).sum() + y.sum()), max(f1))


def test_names_that_clash_and_empty_tables(spark):
    rng = np.random.default_rng(19)
    names = ["id", "text_", "score", "lang_pred", "predicted", "mix_tokens", "mix_kept", "m0", "tokens", "place", "keys", "n", "print", "b", "kind", "chunk", "shard", "length", "held", "component_id"]
    for texts in ([words(rng, 40) for _ in range(6)] + [None, ""], []):
        docs = docs_of(spark, texts).withColumns({c: F.lit("x") for c in names})
        labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
        results = [
            feistel.pseudonymise(docs, "k"), minhash.near_duplicates(docs), substring.remove_repeats(docs), toxicity.toxicity(docs, toxicity.learn(docs, labels)),
            pitmanyor.score(docs, F.col("doc_id") == 1), packing.pack(docs), langid.identify(docs, langid.learn(docs)), mixing.mix(docs, {"source": F.col("source"), "kept": F.col("mix_kept")}),
        ]
        for r in results:
            assert len(r.select(*dict.fromkeys(r.columns)).collect()) == len(texts)
        vec = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(len(texts))], "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in names})
        assert itq.near_vectors(vec).count() == len(texts)
        assert nearest.top_inner_products(vec, F.col("vec_id") == 1, k=3).count() == (3 if texts else 0)


def test_bigru_gradient():
    net = langid.BiGRU(3)
    ids, y = np.random.default_rng(0).integers(97, 105, (4, 5)).astype(np.uint8), np.array([0, 1, 2, 1])
    _, g = net.gradients(ids, y)
    for k, at in (("hf", (1, 2)), ("xb", (3, 40)), ("emb", (100, 1)), ("out", (5, 1))):
        old, e = net.w[k][at], 1e-2
        net.w[k][at] = old + e
        up = net.gradients(ids, y)[0]
        net.w[k][at] = old - e
        down = net.gradients(ids, y)[0]
        net.w[k][at] = old
        assert math.isclose((up - down) / (2 * e), g[k][at], rel_tol=0.05, abs_tol=2e-4)


def test_langid_learns(spark):
    rng = np.random.default_rng(7)
    make = lambda a: " ".join("".join(rng.choice(list(a), 6)) for _ in range(40))
    texts = [make("abcdefgh" if i % 2 else "opqrstuä") for i in range(200)]
    df = spark.createDataFrame([(i, t, "one" if i % 2 else "two") for i, t in enumerate(texts)] + [(900, None, "one"), (901, "12 ?!", "one"), (902, "", None)], "doc_id long, text string, lang string")
    model = langid.learn(df.where("doc_id < 100"), order=F.xxhash64("doc_id"))
    got = {r["doc_id"]: r for r in langid.identify(df.withColumn("score", F.lit(1)).drop("score"), model, keep=["doc_id"]).collect()}
    assert np.mean([got[i]["lang_pred"] == ("one" if i % 2 else "two") for i in range(100, 200)]) > 0.97
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (900, 901, 902))
    assert {r["lang_pred"] for r in langid.identify(df, langid.learn(df.limit(0))).collect()} == {"und"}


# 7 ------------------------------------------------------------------------------------------------


def test_pitmanyor_counts_and_gain(spark):
    rng = np.random.default_rng(8)
    texts = []
    for _ in range(200):  # each word leads to one of three
        w, t = 0, []
        for _ in range(60):
            w = int((w * 7 + rng.integers(0, 3)) % 50)
            t.append(f"W{w}")
        texts.append(" ".join(t))
    texts += EDGE
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    toks = [[w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(t or "")] + [None] for t in texts]
    c = Counter(x for i, t in enumerate(toks) if not held(i) for x in t)
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in pitmanyor.score(docs_of(spark, texts, extra=True), F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1).collect()}
    for i, t in enumerate(toks):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(t), sum(x in c for x in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t), rel_tol=1e-9)
        assert r["score"] <= 0
    gain = np.mean([(got[i]["score"] - got[i]["base_score"]) / len(toks[i]) for i in range(200) if held(i)])
    assert gain > 1.0
    none = pitmanyor.score(docs_of(spark, ["a b", None]), F.lit(True)).collect()
    assert [(r["score"], r["base_score"], r["n_known"]) for r in none] == [(0.0, 0.0, 0)] * 2
    assert pitmanyor.score(docs_of(spark, []), F.lit(True)).count() == 0


def test_pitmanyor_equals_the_formula_over_its_seatings(spark):
    """Blocks, spread contexts and chunks against dictionaries; each context's probabilities sum to one."""
    from folioweave.llm.shared import Stage

    rng = np.random.default_rng(9)
    texts = [words(rng, int(rng.integers(0, 90)), 40) for _ in range(60)] + EDGE + [words(rng, 15_000, 200).replace(" ", " w1 ")]
    ids = [*range(len(texts) - 3), None, 7, 7]
    docs = pitmanyor.prepared(docs_of(spark, texts, ids=ids), F.col("doc_id") % 5 == 1)
    stage = Stage(spark, "test")
    model = pitmanyor.learn(docs, stage, block=2000)
    assert model.blocks > 10 and len(model.split)
    got = pitmanyor.scored(docs, model, stage).collect()
    assert len(got) == len(texts)
    token, low = {}, lambda w: w.translate({i: i + 32 for i in range(65, 91)})
    for w in {low(w) for t in texts for w in WORD.findall(t or "")}:
        token[w] = int(pitmanyor.tokens_of(*[np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())])])[0][0])
    end, start = int(pitmanyor.END), int(pitmanyor.START)
    count, tables = Counter(), Counter()
    for i, t in zip(ids, texts):
        if i is not None and i % 5 != 1:
            seq = [token[low(w)] for w in WORD.findall(t or "")] + [end]
            count.update(zip([start, *seq[:-1]], seq))
    n = len(model.samples)
    for r in model.state.collect():
        f = lambda x, t: np.frombuffer(r[x], t).tolist()  # noqa: E731, B023
        u, q, t = f("x0", np.uint64), f("x5", np.uint64), np.frombuffer(r["x7"], np.int32).reshape(n, -1)
        for k, (a, b, c) in enumerate(zip(f("x3", np.int32), f("x4", np.int32), f("x6", np.int64))):
            assert count[u[a], q[b]] == c > 1
            for s in range(n):
                tables[s, u[a], q[b]] = int(t[s, k])
                assert 1 <= t[s, k] <= c
    root = {}
    for r in model.answers.collect():
        root.update(zip(np.frombuffer(r["x0"], np.uint64).tolist(), np.frombuffer(r["x1"], np.float32).tolist()))
    unknown = np.mean([s.of_root(0, 0) for s in model.samples])
    known = {w for _, w in count}
    assert math.isclose(sum(root[w] for w in known) + unknown, 1, rel_tol=1e-4)
    customers, of = Counter(), {}
    for (u, w), c in count.items():
        customers[u] += c
        of.setdefault(u, []).append(w)
    t_of = lambda s, u, w: tables.get((s, u, w), min(count[u, w], 1))

    def p(u, w):
        if u not in of:
            return root.get(w, unknown)
        own = np.mean([x.own(count[u, w], t_of(s, u, w), customers[u]) for s, x in enumerate(model.samples)])
        share = np.mean([x.share(customers[u], sum(t_of(s, u, v) for v in of[u])) for s, x in enumerate(model.samples)])
        return own + share * root.get(w, unknown)

    for u in list(of)[:20]:
        assert math.isclose(sum(p(u, w) for w in known) + p(u, 1), 1, rel_tol=1e-4)
    want = []
    for t in texts:
        seq = [token[low(w)] for w in WORD.findall(t or "")] + [end]
        want.append(sum(math.log10(p(u, w)) for u, w in zip([start, *seq[:-1]], seq)))
    assert np.allclose(sorted(r["p"] for r in got), sorted(want), rtol=1e-5)


def test_stirling_numbers():
    table = pitmanyor.stirling(0.5, 64)
    assert math.isclose(table[3, 2], math.log(3 * 0.5))  # (1 - d) * 3 ways to part three customers in two
    near = pitmanyor.Saddle(0.5)(np.full(63, 64.0), np.arange(1.0, 64))
    exact = table[64, 1:64]
    assert np.abs((near - near[20]) - (exact - exact[20]))[2:60].max() < 0.02
    assert math.isclose(pitmanyor.log_rising(2.0, 0.5, np.array([3, 1]), np.array([1, 1])), math.log(2 * 2.5 * 3) + math.log(2))


@pytest.mark.parametrize("c,log_p", [(5, -1.0), (60, -2.0), (2000, -4.0), (2000, -9.0), (20000, -6.0)])
def test_draws_follow_the_conditional(c, log_p):
    """Against exact weights by the recurrence, in the window of t that holds the mass."""
    n, d, a, upto = 4000, 0.7, 30.0, min(c, 1500)
    s = np.full(upto + 1, -np.inf)
    s[0] = 0
    t = np.arange(upto + 1)
    for x in range(c):
        s, old = s + np.log(np.maximum(x - t * d, 1e-300)), s
        s[1:] = np.logaddexp(s[1:], old[:-1])
    z = s[1:] + np.cumsum(np.log(a + d * np.arange(upto)) + log_p)
    p = np.exp(z - z.max())
    p /= p.sum()
    mean = (p * t[1:]).sum()
    spread = math.sqrt((p * (t[1:] - mean) ** 2).sum())
    assert p[-1] < 1e-6 or upto == c
    u = (np.arange(n) + 0.5) / n
    got = pitmanyor.draw_tables(np.full(n, c), np.full(n, a), np.full(n, log_p), d, u)
    assert abs(got.mean() - mean) < 0.03 * spread + 0.02 and abs(got.std() - spread) < 0.05 * spread + 0.05


# 8 ------------------------------------------------------------------------------------------------


def test_packing_keeps_all_ids(spark):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(10)
    texts = [words(rng, int(n), 3000) for n in rng.integers(1, 900, 60)] + [words(rng, 5000)] + EDGE + ["Mixed CASE\x01 tab\tend", "ﬁ İ"]
    rows = packing.pack(docs_of(spark, texts, extra=True)).collect()
    tok = Tokenizer.from_str(packing.tokenizer_text())
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in parts] == [(s, min(2048, len(ids) - s)) for s in range(0, len(ids), 2048)]
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in parts)
    total = 0
    for s in by_seq.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
        total += at
    sizes = [r["length"] for r in rows]
    need = packing.lower_bound(sizes, 2048)
    assert -(-total // 2048) <= need <= len(by_seq) <= need + 1
    assert packing.pack(docs_of(spark, [])).count() == 0
    odd = packing.pack(docs_of(spark, ["a b", "c", "a b", words(rng, 40_000, 5000)], ids=[None, 4, 4, 5]))
    assert odd.where("doc_id is null").count() == 1 and odd.where("doc_id = 4").count() == 2 and odd.where("doc_id = 5").count() > 20


def fewest_bins(sizes, room):
    """By trying every bin for every item."""
    best = len(sizes)
    rooms = []

    def place(i):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= sizes[i] and rooms[k] not in rooms[:k]:
                rooms[k] -= sizes[i]
                place(i + 1)
                rooms[k] += sizes[i]
        rooms.append(room - sizes[i])
        place(i + 1)
        rooms.pop()

    sizes = sorted(sizes, reverse=True)
    place(0)
    return best


def packed_well(sizes, room):
    bins = packing.complete(sizes, room)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= room for b in bins)
    return len(bins)


def test_bin_completion_equals_brute_force():
    rng = np.random.default_rng(21)
    gained = 0
    for _ in range(300):
        sizes = [int(x) for x in rng.integers(3, 60, int(rng.integers(1, 12)))]
        got = packed_well(sizes, 100)
        assert got == fewest_bins(sizes, 100)
        gained += got < len(packing.best_fit(sizes, 100))
    assert gained
    assert packing.complete([], 10) == []
    assert packing.lower_bound([6, 6, 6, 5, 5], 10) == 4 and packing.lower_bound([6, 6, 4, 4], 10) == 2 and packing.lower_bound([10, 10], 10) == 2
    assert packing.undominated({5: 1, 3: 1, 2: 2}, 5) == [(5,)]  # 3 and 2 fit into 5


def test_bin_completion_beats_best_fit():
    rng = np.random.default_rng(22)
    for _ in range(4):  # triples that fill a bin
        a = rng.integers(500, 900, 120)
        b = rng.integers(500, 700, 120)
        sizes = [int(x) for x in np.concatenate((a, b, 2048 - a - b))]
        assert packed_well(sizes, 2048) < len(packing.best_fit(sizes, 2048))
    for _ in range(4):
        sizes = [int(x) for x in rng.integers(300, 1500, 400)]
        assert packed_well(sizes, 2048) <= len(packing.best_fit(sizes, 2048))


def test_complete_search_of_more_pieces_than_the_limit():
    gained = 0
    for seed in range(0, 20, 2):
        rng = np.random.default_rng(seed)
        m = 9 + seed % 3
        a, b = rng.integers(20, 50, m), rng.integers(20, 50, m)
        sizes = [int(x) for x in np.concatenate((a, b, 100 - a - b))]  # fill m bins
        bins = packing.complete(sizes, 100, exact=True)
        assert len(sizes) > packing.EXACT and len(bins) == m
        assert sorted(i for x in bins for i in x) == list(range(len(sizes))) and all(sum(sizes[i] for i in x) <= 100 for x in bins)
        gained += m < packed_well(sizes, 100)
    assert gained
    for _ in range(50):
        count = Counter(int(x) for x in rng.integers(3, 30, 9))
        found = [tuple(sorted(f, reverse=True)) for f in packing.fillings(count, 60)]
        assert len(set(found)) == len(found) and set(packing.undominated(count, 60)) <= set(found)
        assert [sum(f) for f in found] == sorted((sum(f) for f in found), reverse=True)


# 10 -----------------------------------------------------------------------------------------------


def test_mixing_meets_targets_either_way(spark):
    rng = np.random.default_rng(11)
    texts = [words(rng, int(n)) for n in rng.integers(5, 80, 400)]
    df = docs_of(spark, texts + EDGE, extra=True).withColumn("lang", F.when(F.col("doc_id") % 4 == 0, None).otherwise(F.col("lang")))
    margins = {"source": F.col("source"), "lang": F.col("lang")}
    targets = {"source": {"s0": 0.6, "s1": 0.4, "zz": 1.0}, "lang": {"en": 0.5, None: 0.5}}
    ways = []
    for on_driver in (1000, 0):
        out = mixing.mix(df, margins, targets if on_driver else {"source": targets["source"]}, fraction=0.3, cells_on_driver=on_driver)
        rows = out.select("doc_id", "mix_source", "mix_lang", "mix_tokens", "mix_weight", "mix_probability", "mix_kept").collect()
        assert len(rows) == len(texts) + len(EDGE)
        ways.append(rows)
        assert all(not r["mix_kept"] for r in rows if r["mix_source"] == "s2")
    tokens = lambda rows, f: sum(r["mix_tokens"] * r["mix_weight"] for r in rows if f(r))
    total = tokens(ways[0], lambda r: True)
    assert math.isclose(tokens(ways[0], lambda r: r["mix_source"] == "s0") / total, 0.6, rel_tol=1e-6)
    assert math.isclose(tokens(ways[0], lambda r: r["mix_lang"] is None) / total, 0.5, rel_tol=1e-6)
    same = mixing.mix(df, margins, {"source": targets["source"]}, fraction=0.3).select("doc_id", "mix_probability").collect()
    other = {r["doc_id"]: r["mix_probability"] for r in ways[1]}
    assert all(math.isclose(r["mix_probability"], other[r["doc_id"]], rel_tol=1e-6, abs_tol=1e-9) for r in same)
    assert mixing.mix(docs_of(spark, []), margins).count() == 0
    assert all(r["mix_kept"] for r in mixing.mix(df, {"topic": mixing.topic_of(F.col("text"))}, fraction=0.3).where("text is null").collect())


def test_mixing_keeps_targets_when_strict_and_reports_contradictions(spark):
    rng = np.random.default_rng(13)
    df = docs_of(spark, [words(rng, 30) for _ in range(4000)]).withColumn("source", F.when(F.col("doc_id") < 3000, "big").otherwise("small"))
    for cells in (1000, 0):
        out = mixing.mix(df, {"source": F.col("source")}, {"source": {"big": 0.5, "small": 0.5}}, fraction=0.8, strict=True, cells_on_driver=cells)
        got = {r["value"]: r for r in mixing.shares(out, "source").collect()}
        assert abs(got["small"]["kept"] - 0.5) < 0.04 and math.isclose(got["small"]["aim"], 0.5, rel_tol=1e-6)
        # kept by the stated rule
        prob = {"big": 1 / 3, "small": 1.0}
        assert all(math.isclose(r["mix_probability"], prob[r["source"]], rel_tol=1e-6) for r in out.limit(50).collect())
    tied = df.withColumn("lang", F.col("source"))
    with pytest.raises(ValueError, match="contradict"):
        mixing.mix(tied, {"source": F.col("source"), "lang": F.col("lang")}, {"source": {"big": 0.5, "small": 0.5}, "lang": {"big": 0.9, "small": 0.1}})


def test_raking_equals_a_plain_loop():
    rng = np.random.default_rng(17)
    tokens = rng.integers(1, 100, 12).astype(float)
    codes, targets = [np.arange(12) % 3, np.arange(12) // 3], [np.array([0.5, 0.3, 0.2]), np.array([0.1, 0.2, 0.3, 0.4])]
    w = [1.0] * 12
    for _ in range(500):
        for c, t in zip(codes, targets):
            for v in range(len(t)):
                now = sum(w[i] * tokens[i] for i in range(12) if c[i] == v)
                for i in range(12):
                    if c[i] == v:
                        w[i] *= t[v] * tokens.sum() / now
    assert np.allclose(mixing.rake(tokens, codes, targets), w, rtol=1e-8)
    p = mixing.calibrated(tokens, np.array(w), 0.6)
    lo, hi = 0.0, 1e6
    for _ in range(200):
        f = (lo + hi) / 2
        lo, hi = (f, hi) if sum(t * min(1, f * x) for t, x in zip(tokens, w)) < 0.6 * tokens.sum() else (lo, f)
    assert np.allclose(p, [min(1, lo * x) for x in w], rtol=1e-6)


# pipeline -----------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(12)
    texts = [words(rng, int(n), 400) for n in rng.integers(20, 200, 80)]
    texts += [texts[0], texts[1] + " end", "call 10.1.2.3 " + texts[2], None, "12 34", *EDGE]
    docs = docs_of(spark, texts)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == corpus_pipeline.COLUMNS, name
        assert docs.join(before, "doc_id", "left_anti").isEmpty()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "MinHash near-dedup", "PII", "mixing", "best-fit packing"]
    first = corpus_pipeline.identify_language(spark, docs_of(spark, texts), "")
    lost = {i for i, t in enumerate(texts) if not any(ch.isalpha() for ch in t or "")}
    assert {r["doc_id"] for r in first.collect()} == set(range(len(texts))) - lost
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, first, "").collect()}
    assert 80 not in kept and 81 not in kept and {0, 1, 2} <= kept
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_pipeline_edge_cases(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(16)
    a, b, c = (words(rng, 80, 500) for _ in range(3))
    docs = docs_of(spark, [a, a, b, b, c, None, "12"], ids=[3, 5, 5, 7, None, 8, 9])
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert {t for _, t in kept} == {a, b, c, None, "12"} and (3, a) in kept and len(kept) == 5
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string")).withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit("x"))
    first = corpus_pipeline.identify_language(spark, unlabelled, "")
    assert sorted(r["text"] for r in first.collect()) == sorted([a, a, b, b, c])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs_of(spark, [], extra=True), "").count() == 0
