"""Near copies of texts and vectors, and repeated passages, against all pairs."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm import itq, minhash, suffix_dedup
from palimpsest.llm.shared import connected_components


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def bag(text):
    w = (text or "").split()
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))


def alike(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def corpus(rng, n=160):
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 30, 120, 400]))) for _ in range(n // 8)]
    out = []
    for _ in range(n):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 4, 12])):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        out.append(rng.choice([" ", "  ", "\n"]).join(w))
    return out + [None, "", " \n", "a a a a a a a a a a", "a a a a a a a a a a a", "x" * 100_000]


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots({x for p in links for x in p}, links)
    assert got == {n: r for n, r in want.items() if n in got} and set(want) - set(got) <= {n for n, r in want.items() if n == r}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_dedup_classes_are_those_of_all_pairs(spark):
    texts = dict(enumerate(corpus(random.Random(1))))
    rows = [(i, t, 1, "x") for i, t in texts.items()] + [(3, texts[3], 1, "x"), (None, texts[5], 1, "x"), (None, "alone in the world with null id", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id int, root string")
    out = minhash.near_dedup(docs).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r for r in out if r.doc_id is not None}
    bags = {i: bag(t) for i, t in texts.items()}
    want = roots(texts, [(i, j) for i in texts for j in texts if i < j and alike(bags[i], bags[j]) >= 0.8])
    assert {i: r.class_id for i, r in got.items()} == want
    assert all(r.kept == (i == r.class_id) for i, r in got.items())
    assert sorted((r.class_id is None, r.kept) for r in out if r.doc_id is None) == [(False, False), (True, True)]
    left = minhash.drop_near(docs).collect()
    assert {r.doc_id for r in left} == {i for i, r in want.items() if i == r} | {None}
    assert minhash.near_dedup(docs.limit(0)).count() == 0


def test_near_dedup_of_a_group_whose_links_are_few(spark):
    """Copies with so many changes that half of them are alike to no other one, among copies that are: with and without sketches."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(140)]
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(rng.randrange(1, 8)):
            k = rng.randrange(len(w))
            w[k] = rng.choice([f"n{rng.randrange(10**6)}", "and", "or"])
        texts.append(" ".join(w))
    bags = [bag(t) for t in texts]
    want = roots(range(150), [(i, j) for i in range(150) for j in range(i) if alike(bags[i], bags[j]) >= 0.8])
    assert len(set(want.values())) > 10
    docs = spark.createDataFrame(enumerate(texts), "doc_id long, text string")
    for sigmas in (minhash.SIGMAS, None):
        assert {r.doc_id: r.class_id for r in minhash.near_dedup(docs, sigmas=sigmas).collect()} == want


def test_drop_near_tells_texts_of_one_id_apart(spark):
    near = " ".join(f"w{k}" for k in range(200))
    rows = [(1, near), (2, near + " x"), (2, "alone in the world with a second text"), (3, "of its own")]
    left = minhash.drop_near(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, left)) == [rows[0], rows[2], rows[3]]


def test_signatures_are_unbiased():
    texts = pa.array(["a b c d e " * 40 + " ".join(f"w{k}" for k in range(60)), "a b c d e " * 25 + " ".join(f"w{k}" for k in range(50))])
    text, shingle, weight = minhash.bags(texts)
    assert weight.max() > 30
    want = minhash.overlaps(texts[:1], texts[1:])[0]
    assert abs(want - alike(bag(texts[0].as_py()), bag(texts[1].as_py()))) < 1e-12
    same = [np.mean(np.equal(*minhash.signatures(text, minhash.mix(shingle + np.uint64(k)) >> np.uint64(14), weight, 2, 144))) for k in range(150)]
    assert abs(np.mean(same) - want) < 5 * (want * (1 - want) / (150 * 144)) ** 0.5


def test_repeats_are_those_of_all_windows(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**6)}"
    passages = [[word() for _ in range(n)] for n in (50, 51, 60, 75, 200)] + [["und"] * 90, [word() for _ in range(49)]]
    texts = []
    for _ in range(120):
        w = []
        for _ in range(rng.randrange(4)):
            w += [word() for _ in range(rng.randrange(80))]
            if rng.random() < 0.6:
                w += rng.choice(passages)
        texts.append(" ".join(w + [word() for _ in range(rng.randrange(30))]))
    own = [word() for _ in range(70)]
    texts += [" ".join(own + ["x"] + own), None, "", texts[7], "und " * 3000]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(9, texts[9], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, begin_word int")
    where = defaultdict(set)
    words = {i: (t or "").split() for i, t in enumerate(texts)}
    for i, w in words.items():
        for k in range(len(w) - 49):
            where[tuple(w[k : k + 50])].add(i)
    want = defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - 49):
            if len(where[tuple(w[k : k + 50])]) > 1:
                want[i].update(range(k, k + 50))
    for parts in (2, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        got = defaultdict(set)
        for r in suffix_dedup.repeats(docs).collect():
            assert r.other_id != r.doc_id and r.n_words == r.stop_word - r.begin_word >= 50
            got[r.doc_id].update(range(r.begin_word, r.stop_word))
        assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert suffix_dedup.repeats(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.repeats(docs, least=20)


def test_repeats_with_a_frequent_shared_tail(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    some = lambda n: [word() for _ in range(n)]
    texts, want = [], {}
    for _ in range(12):
        head, tail = some(10), some(45)
        for k in range(24):
            before = some(60)
            if k % 12 == 5:  # two texts with the head, 22 with the tail alone
                want[len(texts)] = [(60, 115)]
                before += head
            texts.append(" ".join(before + tail + some(60)))
    got = defaultdict(list)
    for r in suffix_dedup.repeats(spark.createDataFrame(enumerate(texts), "doc_id long, text string")).collect():
        assert abs(r.other_id - r.doc_id) == 12
        got[r.doc_id].append((r.begin_word, r.stop_word))
    assert got == want


def test_repeats_of_other_lengths_and_of_repeated_lines(spark):
    rng = random.Random(6)
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    long, short, line = some(130), some(90), some(23)
    texts = [some(20) + long + some(20), some(5) + long + some(40), short + some(30), some(70) + short, line * 40 + some(9), some(11) + line * 9]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    for least in (48, 100, 200):
        where = defaultdict(set)
        for i, w in enumerate(texts):
            for k in range(len(w) - least + 1):
                where[tuple(w[k : k + least])].add(i)
        want = defaultdict(set)
        for i, w in enumerate(texts):
            for k in range(len(w) - least + 1):
                if len(where[tuple(w[k : k + least])]) > 1:
                    want[i].update(range(k, k + least))
        got = defaultdict(set)
        for r in suffix_dedup.repeats(docs, least=least).collect():
            got[r.doc_id].update(range(r.begin_word, r.stop_word))
        assert got == want


def test_bits_of_the_keys_grow_with_the_label():
    for n in (100, 10_000, 10**6, 10**8):
        rotations, tables, bits = itq.layout(n)
        assert n < 2**bits <= 2**30 and (1 - (1 - np.arccos(itq.ALIKE) / np.pi) ** bits) ** (rotations * tables) <= itq.MISSED


def test_near_vectors_finds_the_links_of_all_pairs(spark):
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(60, 64))
    x = np.concatenate([centre[rng.integers(60, size=700)] + rng.normal(size=(700, 64)) * rng.choice([0.05, 0.2, 0.26], size=(700, 1)), rng.normal(size=(300, 64))])
    x[900:950] = x[0]
    vectors = [(i, v.astype(np.float32).tolist(), int(rng.integers(2)), "x") for i, v in enumerate(x)]
    vectors += [(2000, None, 0, "x"), (2001, [0.0] * 64, 0, "x"), (2002, [float("nan")] + [1.0] * 63, 0, "x"), (2003, vectors[0][1], None, "x"), (2004, [], 0, "x"), (2005, [1.0, 2.0], 0, "x"), (2006, [2.0, 4.0], 0, "x"), vectors[5]]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int, v string")
    for block in (16, 1024):
        out = itq.near_vectors(df, block=block).collect()
        assert len(out) == len(vectors)
        got = {r.vec_id: r for r in out}
        unit = {i: np.array(v) / np.linalg.norm(v) for i, v, *_ in vectors if i < 2000}
        label = {i: k for i, _, k, _ in vectors}
        links = [(i, j) for i in unit for j in unit if i < j and label[i] == label[j] and unit[i] @ unit[j] >= 0.93]
        n = Counter(x for p in links for x in p)
        for i, _ in [p for p in links if 5 in p for p in (p, p[::-1])]:
            n[i] += i != 5  # row 5 is there twice
        n[5] += 1
        assert all(got[i].n_links <= n[i] for i in unit)
        assert sum(got[i].n_links for i in unit) >= 0.95 * sum(n[i] for i in unit)
        want = roots(unit, links)
        assert np.mean([got[i].component_id == want[i] for i in unit]) > 0.9
        assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (2000, 2001, 2002, 2003, 2004))
        assert got[2005].n_links == got[2006].n_links == 1 and got[2006].component_id == 2005
    assert itq.near_vectors(df.limit(0)).count() == 0
    assert itq.near_vectors(df.where("vec_id = 2000")).count() == 1
