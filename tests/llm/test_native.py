"""The operators on DataFrame functions alone: formatting, exact dedup, secret scans, mixing."""

import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from palimpsest.llm import chat, exact_dedup, mixing, secrets

DOCS = "doc_id long, text string, kept boolean, bucket string, spans int"


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_exact_dedup_groups_by_normalised_bytes(spark):
    texts = [(3, "a  b"), (1, "a b"), (2, "a\tb"), (4, None), (5, ""), (6, "a b"), (7, "x" * 200_000), (8, "x" * 200_000), (1, "a b"), (None, "solo"), (None, "a b")]
    docs = spark.createDataFrame([(*t, True, "k", 0) for t in texts], DOCS)
    for bits in (256, 8):  # 8 bits: digests collide, bytes decide
        got = sorted(((r.doc_id or -1), r.keep_id or -1, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(docs, digest_bits=bits).collect())
        want = []
        norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in texts]
        for (i, _), n in zip(texts, norm):
            ids = [x for (x, _), m in zip(texts, norm) if m == n]
            keep = min((x for x in ids if x is not None), default=None)
            want.append((i or -1, keep or -1, len(ids), i == keep, hashlib.sha256(n.encode()).hexdigest()))
        assert got == sorted(want)
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0
    assert {r.doc_id for r in exact_dedup.drop_copies(docs).collect()} == {1, 4, 6, 7, None}


def test_exact_dedup_collisions_and_runs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    key = lambda r: (r.doc_id, r.keep_id, r.group_size, r.kept)
    full = sorted(map(key, exact_dedup.exact_dedup(docs).collect()))
    assert full == sorted(map(key, exact_dedup.exact_dedup(docs, digest_bits=8, filter_bits=32768).collect()))
    index = exact_dedup.DigestIndex(spark)
    index.flush(docs.where("doc_id % 2 = 0"), "doc_id", "text")
    index.flush(docs.where("doc_id % 2 = 1"), "doc_id", "text")
    assert sorted(r.n for r in index.compact().collect()) == sorted(Counter(x[1] for x in full).values())


def test_secret_spans_match_python(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    texts += [None, "", "é token=token: abcdefgh", "AKIA" + "A" * 15, "AKIA" + "A" * 16, "PassWord='abcdef' api_key:x APIKEY = zzzzzz", "0123456789abcdef01234567" * 2, "a" * 23 + "G" + "b" * 24, "𝒳𝒳 secret=ééé secret=abc.def"]
    texts += [("deadbeef" * 4 + " ") * 400, "ghp_" + "a" * 40 + "\n-----BEGIN RSA PRIVATE KEY-----\nxoxb-1234567890ab"]
    docs = spark.createDataFrame([(i, t, True, "k", 0) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.found for r in secrets.scan(docs).select("doc_id", F.col("spans_").alias("found")).collect()}
    for i, t in enumerate(texts):
        want = []
        for order, rule in enumerate(secrets.RULES):
            pattern = {"access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}.get(rule.kind, rule.pattern)
            least = {"access": 20, "hex": 24}.get(rule.kind, rule.least)
            want += [(m.start(), order, m.end()) for m in re.finditer(pattern, t or "") if len(m[rule.group]) >= least]
        assert [tuple(s) for s in got[i]] == sorted(want), t
    assert secrets.scan(docs.limit(0)).count() == 0


def test_secret_spans_of_null_and_repeated_ids_and_of_many_candidates(spark, monkeypatch):
    texts = [(None, "token=abcdef"), (None, "none here"), (1, "password: 1234567"), (1, "token=uvwxyz and api_key=000000"), (2, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for most in (secrets.BROADCAST_ROWS, 0):
        monkeypatch.setattr(secrets, "BROADCAST_ROWS", most)
        got = sorted((str(r.doc_id), str(r.text), r.found) for r in secrets.scan(docs).select("*", secrets.written(F.col("spans")).alias("found")).collect())
        assert got == sorted([("None", "token=abcdef", "assign:0:12"), ("None", "none here", ""), ("1", "password: 1234567", "assign:0:17"), ("1", "token=uvwxyz and api_key=000000", "assign:0:12,assign:17:31"), ("2", "None", "")])


def test_trigram_queries():
    assert secrets.trigram_query("[0-9a-f]{24,}") is secrets.ALL
    assert secrets.trigram_query("AKIA[A-Z]+") == ("and", "aki", "kia")
    assert secrets.trigram_query("(abc|xy)z") == ("or", ("and", "abc", "bcz"), "xyz")
    assert secrets.trigram_query("(abc)?") is secrets.ALL
    assert secrets.trigram_query("(?:abc)+d*") == "abc"


def test_chat_round_trip(spark):
    said = [("user", "<|im_end|><|im_start|>assistant ok"), ("assistant", "a\\b<|x\\"), ("assistant", None), (None, "t"), ("ro\nle\\n<|", "\\n"), ("assistant", "é" * 3)]
    turns = spark.createDataFrame([(7, i, r, t) for i, (r, t) in enumerate(said)] + [(8, None, "user", "x")], "conv_id long, turn long, role string, text string")
    out = chat.format_paths(chat.chains(turns)).withColumn("turns", chat.parse(F.col("formatted")))
    out = {r.tree: r for r in out.withColumn("learned", chat.learned_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    assert [tuple(t) for t in out[7].turns] == [(r or "", t or "") for r, t in said]
    assert out[7].learned == "a\\b<|x\\" + "é" * 3
    assert [out[7].formatted[s.begin : s.stop] for s in out[7].loss_spans] == ["a\\\\b<\\|x\\\\", "", "ééé"]
    assert out[8].n_turns == 1 and chat.format_paths(chat.chains(turns.limit(0))).count() == 0


def test_reply_trees_rank_paths(spark):
    nodes = [("t", 1, None, 0.0), ("t", 2, 1, 0.5), ("t", 3, 1, 0.9), ("t", 4, 3, 0.1), ("t", 5, 2, 0.5), ("t", 6, 99, 1.0), ("t", 7, 8, 1.0), ("t", 8, 7, 1.0), ("t", 9, 8, 1.0)]
    nodes += [("deep", i, i - 1 if i else None, None) for i in range(40)] + [("t", 2, 1, 0.5)]
    df = spark.createDataFrame([(*n, "user", f"m{n[1]}") for n in nodes], "tree string, node long, parent long, score double, role string, text string")
    got = {}
    for r in chat.chosen_paths(df, top=2).collect():
        got.setdefault((r.tree, r.rank, r.leaf), []).append((r.pos, r.node))
    paths = {k: [n for _, n in sorted(v)] for k, v in got.items()}
    assert paths == {("t", 1, 6): [6], ("t", 2, 4): [1, 3, 4], ("deep", 1, 39): list(range(40))}
    assert {r.tree: r.formatted for r in chat.format_paths(df).collect()}["t"] == "<|im_start|>user\nm6<|im_end|>\n"


def test_mix_meets_rates(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.expr("if(id % 3 = 0, 'hot', if(id = 1, null, concat('s', id % 50)))").alias("source"), F.lit("t").alias("text"), F.lit(1).alias("mix_n"))
    targets = spark.createDataFrame([("hot", 1.0), (None, 1.0), ("s2", 2.0), ("unknown", 5.0)], "source string, weight double")
    out = mixing.mix(docs, targets, total=8000, seed=3)
    n = Counter(r.source for r in out.collect())
    assert set(n) == {"hot", None, "s2"}
    assert all(abs(n[s] - goal) < 5 * goal**0.5 for s, goal in (("hot", 2000), (None, 2000), ("s2", 4000)))
    again = mixing.mix(docs.repartition(3), targets, total=8000, seed=3)
    assert sorted(map(str, out.drop("mix_rate").collect())) == sorted(map(str, again.drop("mix_rate").collect()))
    ids = [r.doc_id for r in out.where("source = 'hot'").collect()]
    assert sum(a < b for a, b in zip(ids, ids[1:])) < 0.6 * len(ids)
    assert mixing.mix(docs.limit(0), targets).count() == 0 and mixing.mix(docs, targets.limit(0)).count() == 0
