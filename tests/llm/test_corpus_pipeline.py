"""The pipeline's stages, one after the other, against brute force on a small corpus."""

import re
from collections import Counter

import numpy as np
import pytest

from brute import passages, removals, without

corpus_pipeline = pytest.importorskip("corpus_pipeline")

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(text.lower())
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    words = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 3000, n))
    passage = words(60)
    rows, labels = [], []
    for i in range(240):
        text = words(int(rng.integers(30, 120)))
        toxic = int(i % 6 == 0)
        if toxic:
            text = " ".join(w if j % 9 else ["numskull", "blockhead", "lowlife"][j % 3] for j, w in enumerate(text.split()))
        labels.append((i, 1, toxic))
        if i % 20 == 1:
            text += "\n" + passage + "\n" + words(25)
        rows.append((i, text, "en", f"s{i % 4 % 3}", len(text)))
    clean = [r for r in rows if r[0] % 6]
    for n, r in enumerate(clean[:30]):
        text = r[1] if n % 2 else r[1] + " tail"
        rows.append((1000 + n, text, "en", "s0", len(text)))
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, dict((r[0], r[1]) for r in rows)


def test_stages(spark, folder):
    path, texts = folder
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard_join", "substring_dedup", "mixing", "packing"]
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns

    docs = stages["toxicity"](spark, docs, path).cache()
    kept = {r.doc_id: r.text for r in docs.collect()}
    toxic = {i for i in range(240) if i % 6 == 0}
    assert docs.columns == columns and len(toxic & set(kept)) <= 3 and len(set(texts) - toxic - set(kept)) <= 3
    assert all(texts[i] == t for i, t in kept.items())

    docs = stages["jaccard_join"](spark, docs, path).cache()
    sets = {i: shingles(t) for i, t in kept.items()}
    want, parent = set(kept), {i: i for i in kept}
    order = sorted(kept)
    for n, i in enumerate(order):
        for j in order[n + 1:]:
            if similar(sets[i], sets[j]):
                low, high = sorted((parent[i], parent[j]))
                parent = {k: low if v == high else v for k, v in parent.items()}
    want = {i for i in kept if parent[i] == i}
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert docs.columns == columns and set(kept) == want

    docs = stages["substring_dedup"](spark, docs, path).cache()
    units, members, hit = passages(list(kept.items()))
    _, removed = removals(units, members, hit)
    want = {i: without(t, i, units, removed) for i, t in kept.items()}
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert removed and docs.columns == columns and kept == {i: t for i, t in want.items() if t.strip()}
    assert all(r.n_chars == len(r.text) for r in docs.collect())

    mixed = stages["mixing"](spark, docs, path).cache()
    uses = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == columns and set(uses) == set(kept)

    out = stages["packing"](spark, mixed, path).collect()
    ends = Counter(r.doc_id for r in out if r.start + r.length == r.doc_tokens)
    assert ends == uses
    size = Counter()
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == size[r.sequence_id]
        size[r.sequence_id] += r.length
    assert max(size.values()) <= 2048
