"""Token counts under edits, the quality classifier and packing, each against a plain version of itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex

from palimpsest.llm import packing, quality, token_counts
from palimpsest.llm.queries import op2_token_counts, op5_quality, op6_packing

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_edits_count_as_a_fresh_tree():
    count = token_counts.counter(RANKS)
    whole = lambda text: count.encoding.encode_ordinary(text)
    rng = random.Random(5)
    bits = ["word", " ", "  ", "\n\n", "'s", "'", "é", "12", ".", "!?", " a", "\t", "日本", "𝒳", "'re", "x" * 300]
    for trial in range(60):
        text = "".join(rng.choices(bits, k=rng.choice([0, 3, 40, 1500])))
        tree = token_counts.Tree.of(text, count)
        for _ in range(25):
            a = rng.randint(0, len(text) + 2)
            b = a + rng.choice([0, 0, 1, 5, 40, len(text)])
            new = "".join(rng.choices(bits, k=rng.choice([0, 1, 2, 30, 400 if trial % 9 == 0 else 3])))
            done = tree.edit(a, b, new)
            text = text[: min(a, len(text))] + new + text[min(b, len(text)) :]
            assert "".join(tree.leaves) == text and tree.chars == len(text)
            assert tree.tokens == len(whole(text)), (trial, a, b, new)
            assert done <= len(text)


def test_edits_stay_local():
    tree = token_counts.Tree.of("plain words " * 20_000, token_counts.counter(RANKS))
    assert tree.edit(100_000, 100_004, "other") < 2000


def test_token_counts_query(spark, sf_dir):
    count = token_counts.counter(RANKS)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op2_token_counts(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r.doc_id]
        k = len(t) // 3
        new = t[:k] + "a changed phrase" + t[k + 7 :]
        new = new[: 2 * k] + "It's new\n\n" + new[2 * k :] + " the end"
        assert (r.n_tokens, r.n_chars_after, r.n_tokens_after) == (len(count.encoding.encode_ordinary(t)), len(new), len(count.encoding.encode_ordinary(new)))


def test_trees_are_kept_and_edited_later(spark):
    docs = spark.createDataFrame([(1, None), (None, "a b"), (1, "a b")], "doc_id long, text string")
    trees = token_counts.build_trees(docs, RANKS).withColumn("edits", token_counts.F.expr("array(named_struct('start', 0L, 'stop', 1L, 'text', 'hello'), null)"))
    out = sorted((r.text, r.n_tokens, sum(r.leaf_tokens)) for r in token_counts.apply_edits(trees, RANKS).collect())
    assert out == [("hello", 1, 1), ("hello b", 2, 2), ("hello b", 2, 2)]
    assert token_counts.apply_edits(trees.limit(0), RANKS).count() == 0
    clash = token_counts.build_trees(docs.withColumnRenamed("doc_id", "N_tokens").withColumn("leaf_chars", token_counts.F.lit(1)), RANKS, "N_tokens")
    assert sorted((str(r.N_tokens_), r.n_tokens) for r in clash.collect()) == [("1", 0), ("1", 2), ("None", 2)]


def test_quality_is_right_on_held_out_rows(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    out = op5_quality(spark, d).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    tested = [r for r in out if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in tested]) > 0.95


def test_quality_without_labels_and_with_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "s"), (None, "", "t"), (1, "a" * 100_000, "u"), (2, "퟿ \x00", "u")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit_on(docs, labels)
    out = quality.score(docs.drop("score"), model).collect()
    assert len(out) == 4 and {r.score for r in out} == {0.5}
    assert quality.score(docs.drop("score").limit(0), model).count() == 0
    clash = quality.score(docs, model)
    assert clash.columns == ["doc_id", "score", "score_"] and {(r.score, r.score_) for r in clash.collect()} == {(s, 0.5) for s in "stu"}
    assert quality.keep_good(docs, model, threshold=0.4).columns == docs.columns and quality.keep_good(docs, model).count() == 0


def test_splits_are_the_best_of_all():
    """The first tree's root against all features and thresholds, one by one."""
    rng = np.random.default_rng(4)
    for _ in range(10):
        x = np.round(rng.normal(size=(300, 4)), 1)
        y = (x[:, rng.integers(4)] + 0.3 * rng.normal(size=300) > 0.4).astype(float)
        m = quality.fit(x, y, trees=1)
        p = 1 / (1 + np.exp(-m.base))
        g, h = p - y, np.full(300, p * (1 - p))
        term = lambda k: g[k].sum() ** 2 / (h[k].sum() + quality.RIDGE)

        def gain(f, t):
            low = x[:, f] <= t
            if h[low].sum() < quality.LEAST or h[~low].sum() < quality.LEAST:
                return 0
            return term(low) + term(~low) - term(np.ones(300, bool))

        best = max(gain(f, t) for f in range(4) for t in np.unique(x[:, f]))
        assert abs(gain(m.feature[0][0], m.threshold[0][0]) - best) < 1e-9 * max(1, best)


def test_trees_in_arrays_go_the_same_way_as_one_by_one():
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(600, 5)), 1)
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > -0.3)).astype(float)
    m = quality.fit(x, y, trees=40)
    assert (((m.score(x) > 0.5) == y).mean()) > 0.95

    def walk(row):
        total = m.base
        for f, t, leaf in zip(m.feature, m.threshold, m.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + bool(row[f[node]] > t[node])
            total += leaf[node - len(f)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(m.score(x[:50]), [walk(r) for r in x[:50]])


ODD = [None, "", " ", "a b\x1cc", "It's 'the' I'LL x's 12.5 ab3 İstanbul é <|endoftext|> 　z", "日本語。 ok!!! a\x85b", "\x00 q​q", "ﬁn. ǅ Ⅷ ²", "x" * 5000]


def test_encoder_gives_the_tokenizers_ids(spark, sf_dir):
    e = packing.Encoder(WORDS)
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for t, ids in zip(texts, e.encode(pa.array(texts))):
        assert ids.tolist() == e.tokenizer.encode(t or "", add_special_tokens=False).ids


def check_pieces(pieces, texts, size):
    e = packing.Encoder(WORDS)
    ids = {d: [*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for d, t in texts.items()}
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
        own = np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4")
        assert p.ids_crc32 == zlib.crc32(own.tobytes()) and p.doc_tokens == len(ids[p.doc_id])
    assert by_doc.keys() == texts.keys()
    for d, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.length > 0
            at += p.length
        assert at == len(ids[d])
    pad = 0
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size
        pad += 0 if at & (at - 1) == 0 else size - at
    return pad / sum(map(len, ids.values()))


def test_packing_keeps_each_id_once(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert check_pieces(op6_packing(spark, sf_dir).collect(), texts, 2048) < 0.03
    texts = {i: t for i, t in enumerate(ODD)} | {99: "no end " * 9000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check_pieces(packing.pack(docs.coalesce(1), WORDS, size=64, look_ahead=1).collect(), texts, 64)
    assert packing.pack(docs.limit(0), WORDS).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (1, None), (None, None)], "start long, text string")
    out = packing.pack(odd, WORDS, id_col="start").collect()
    assert sorted((str(r.start_), r.start, r.length) for r in out) == [("1", 0, 1), ("1", 0, 3), ("1", 0, 3), ("None", 0, 1), ("None", 0, 3)]


def test_cuts_are_the_best():
    rng = random.Random(2)
    for _ in range(200):
        size = 16
        at = np.cumsum([rng.randint(1, 9) for _ in range(rng.randint(1, 14))])
        cost = np.array([rng.choice([0, 3, 7]) for _ in at])
        got = packing.cuts(at, cost, size)
        penalty = dict(zip(at.tolist(), cost.tolist()))

        def total(ends):
            out, begin = 0, 0
            for e in ends:
                n = e - begin
                out += penalty[e] + (packing.SHORTER if n in (8, 4, 2) and packing.SHORTER < size - n else size - n)
                begin = e
            return out

        best = {0: 0}
        for e in at.tolist():
            best[e] = min(best[b] + penalty[e] + (packing.SHORTER if e - b in (8, 4, 2) and packing.SHORTER < size - e + b else size - e + b) for b in best if e - b <= size)
        assert total(got) == best[int(at[-1])] and all(b - a <= size for a, b in zip([0, *got], got))


def test_pattern_context(spark):
    assert regex.compile(token_counts.PATTERN).pattern == public_tokenizers.PATTERN
