"""The pipeline, stage by stage, against what each stage is to keep."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from palimpsest.llm.queries import QUERIES
from palimpsest.llm.shared import cut

from .test_near import alike, bag, roots


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean, junk, copied and nearly copied documents, with labels, under a folder like the driver's."""
    rng = random.Random(8)
    d = tmp_path_factory.mktemp("corpus")
    word = lambda: "".join(rng.choice(["the", "an", "er", "in", "ou", "st", "th", "re"]) for _ in range(rng.choice([1, 2, 3])))
    good = lambda: " ".join(word() + ("." if rng.random() < 0.1 else "") for _ in range(rng.randrange(40, 200)))
    bad = lambda: " ".join(word().upper() + "!!" for _ in range(rng.randrange(40, 200)))
    rows = [(i, bad() if i % 6 == 5 else good()) for i in range(420)]
    rows += [(420 + k, rows[k][1]) for k in range(0, 60, 2)]
    for k in range(1, 61, 4):
        w = rows[k][1].split()
        w[len(w) // 2] = "changed"
        rows.append((500 + k, " ".join(w)))
    rows += [(900, None), (901, "")]
    docs = [(i, t, "en", f"src{0 if i % 3 == 0 else i % 5}", len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    labels = [(i, int(i % 6 != 5), 0) for i in range(300)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), dict(rows)


def test_stages_keep_what_they_are_to_keep(spark, corpus):
    d, texts = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "mix_sources", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    now = cut(stage["quality"](spark, docs, d), "t")
    ids = {r.doc_id for r in now.collect()}
    clean = {i for i in texts if i < 420 and i % 6 != 5}
    assert clean <= ids and not {i for i in ids if i < 420 and i % 6 == 5}
    assert now.columns == list(corpus_pipeline.COLUMNS)

    after = cut(stage["exact_dedup"](spark, now, d), "t")
    first = {}
    for i in sorted(ids):
        first.setdefault(" ".join((texts[i] or "").split()), i)
    kept = {r.doc_id for r in after.collect()}
    assert kept == set(first.values())

    near = cut(stage["near_dedup"](spark, after, d), "t")
    bags = {i: bag(texts[i]) for i in kept}
    want = roots(kept, [(i, j) for i in kept for j in kept if i < j and alike(bags[i], bags[j]) >= 0.8])
    left = {r.doc_id for r in near.collect()}
    assert left == {i for i, r in want.items() if i == r}

    mixed = cut(stage["mix_sources"](spark, near, d), "t")
    rows = mixed.collect()
    assert mixed.columns == list(corpus_pipeline.COLUMNS) and {r.doc_id for r in rows} <= left and all(r.text == texts[r.doc_id] for r in rows)
    packed = stage["packing"](spark, mixed, d).collect()
    copies, pieces = Counter(r.doc_id for r in rows), Counter()
    for p in packed:
        pieces[p.doc_id] += p.length
    sizes = {p.doc_id: p.doc_tokens for p in packed}
    assert pieces == {i: n * sizes[i] for i, n in copies.items()}


def test_run_is_the_stages_in_turn(spark, corpus):
    d, _ = corpus
    out = corpus_pipeline.run(spark, d).collect()
    assert out and sum(p.length for p in out) > 0 and max(p.offset + p.length for p in out) <= 2048


def test_all_ten_operators_are_registered():
    assert [sum(n.startswith(f"op{k}_") for n in QUERIES) for k in range(1, 11)] == [1] * 10
