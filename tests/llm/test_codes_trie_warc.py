"""Vector codes, the prefix trie and WARC bundles against brute force, with nulls, ties, repeated rows and empty tables."""

import base64
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from factorseg.llm import prefix_trie, vector_codes, warc_bundles
from factorseg.llm.salting import join_summary
from factorseg.operators.lineage import Scratch


# ---- vector codes -----------------------------------------------------------

@pytest.mark.parametrize("size", [1, 2, 8, 32])
def test_transform_is_the_matrix_by_sequency(size):
    h = vector_codes.hadamard(size)
    assert list((np.diff(h, axis=1) != 0).sum(axis=1)) == list(range(size))
    x = np.random.default_rng(size).integers(-9, 9, (20, size))
    assert (vector_codes.transformed(x) == x @ h.T).all()


@pytest.mark.parametrize("width, entries, top", [(1, 1, 5), (3, 16, 3), (8, 16, 4000), (24, 40, 2), (8, 16, 1 << 25)])
def test_nearest_is_exact_and_ties_go_to_the_lower_index(width, entries, top):
    rng = np.random.default_rng(width + entries)
    x, c = rng.integers(-top, top, (300, width)), rng.integers(-top, top, (entries, width))
    c[-1] = c[0]
    d = ((x[:, None].astype(object) - c[None].astype(object)) ** 2).sum(axis=2)
    index, distance = vector_codes.nearest(x, c)
    assert (index == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()


def brute_codes(rows, parts, entries, rounds):
    kept = []
    for i, v, label in rows:
        if v and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(float(x) * 4096)) for x in v], label))
    longest = max(len(v) for _, v, _ in kept)
    width = -(-longest // parts)
    kept = [(i, v + [0] * (width * parts - len(v)), label) for i, v, label in kept]
    start = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p * width:(p + 1) * width] for r in start] for p in range(parts)]

    def near(part, book):
        d = [sum((a - b) ** 2 for a, b in zip(part, c)) for c in book]
        return min(range(len(d)), key=lambda k: (d[k], k)), min(d)

    for step in range(rounds + 1):
        codes = [[near(v[p * width:(p + 1) * width], books[p]) for p in range(parts)] for _, v, _ in kept]
        if step < rounds:
            for p in range(parts):
                for k in range(len(books[p])):
                    mine = [v[p * width:(p + 1) * width] for (_, v, _), c in zip(kept, codes) if c[p][0] == k]
                    if mine:
                        books[p][k] = [sum(x) // len(mine) for x in zip(*mine)]
    errors = [sum(d for _, d in c) for c in codes]
    by_label = defaultdict(int)
    for (_, _, label), e in zip(kept, errors):
        by_label[label] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted([(i, "".join("%02x" % k for k, _ in c), e, by_label[label], sha)
                   for (i, _, label), c, e in zip(kept, codes, errors)], key=str)


@pytest.mark.parametrize("dims, n", [(16, 150), (20, 9)])
def test_codes_equal_brute_force(spark, dims, n):
    rng = np.random.default_rng(dims)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.3, dims)], None if i % 7 == 0 else int(i % 3)) for i in rng.permutation(n)]
    rows += [(1000, None, 1), (1001, [], 1), (1002, [None] * dims, 1), (1003, [float("nan")] * dims, 1), (1004, [float("inf")] * dims, 1),
             (1005, [0.0] * dims, 1), (None, [0.25] * dims, 2), (1, [0.5] * dims, 2), rows[0], (1006, [1.0, -1.0], 2)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, code string, id int").repartition(5)
    got = vector_codes.coded(df, parts=8, entries=16, rounds=3)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute_codes(rows, 8, 16, 3)
    assert vector_codes.coded(df.filter("false")).count() == 0 and vector_codes.coded(df.filter("vec_id = 1000")).count() == 0


def test_components_beyond_a_long_are_left_out(spark):
    df = spark.createDataFrame([(1, [1e30] * 8, 0), (2, [8191.0] * 8, 0), (3, [-8192.0] * 8, 0)], "vec_id long, embedding array<double>, label int")
    assert {r.vec_id for r in vector_codes.coded(df, rounds=1).collect()} == {1, 2, 3} - {1}


def test_join_summary_splits_frequent_keys(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit(None).cast("int")).otherwise((F.col("id") % 100).cast("int")).alias("k"))
    sums = rows.groupBy("k").agg(F.count("*").alias("n"), F.sum("id").alias("s"))
    got = join_summary(rows, sums, ["k"], "n", F.col("id"))
    want = defaultdict(int)
    plain = rows.collect()
    for r in plain:
        want[r.k] += r.id
    assert got.columns == ["id", "k", "s"] and {(r.id, r.k, r.s) for r in got.collect()} == {(r.id, r.k, want[r.k]) for r in plain}


# ---- prefix trie --------------------------------------------------------------

def brute_trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", hashlib.md5((x or "").encode()).hexdigest(), x or ""))
    own = {c: [(s[2], s[4]) for s in sorted(steps)] for c, steps in own.items()}
    members = {}
    for c, steps in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        members[c] = tuple(own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + steps[h:])
    nodes = defaultdict(list)
    for c, path in members.items():
        for d in range(len(path) + 1):
            nodes[path[:d]].append(c)
    children = {p: [q for q in nodes if len(q) == len(p) + 1 and q[:-1] == p] for p in nodes}
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = sum(saved[q] for q in children[p]) + (len(nodes[p]) - 1) * (len(p[-1][1]) if p else 0)
    return sorted([(min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p],
                    hashlib.sha256(",".join(str(c) for c in sorted(m) if members[c] == p).encode()).hexdigest()) for p, m in nodes.items()], key=str)


def turns(rng):
    rows = []
    for c in [*range(0, 230), -1, -100, -205, 9999]:
        for t in range(int(rng.integers(1, 12))):
            # few different texts, so that paths meet; a long one, odd ones and nulls
            rows.append((c, t, ["user", "assistant", None][int(rng.integers(0, 3)) if t > 8 else t % 2], ["a", "é b", "", None][int(rng.integers(0, 4)) if t else 0]))
    rows += [(3, 2, "user", "tie"), (3, 2, "user", "tie"), (3, 2, "a", "tie"), (4, None, "user", "first"), (None, 0, "user", "nobody"),
             (500, 0, "user", "long " * 20_000), (600, 0, "user", "a"), (601, 0, "user", "a")]
    return rows


@pytest.mark.parametrize("shard_steps, waiting", [(20_000, 100_000), (40, 100_000), (7, 1), (300, 0)])
def test_trie_equals_brute_force(spark, shard_steps, waiting):
    rows = turns(np.random.default_rng(1))
    df = spark.createDataFrame([(*r, 1, b"x") for r in rows], "conv_id long, turn long, role string, text string, depth int, path binary").repartition(4)
    scratch = Scratch(spark)
    got = prefix_trie.trie(prefix_trie.shared_heads(df, scratch), shard_steps, waiting)
    scratch.drop()
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute_trie(rows)


def test_trie_of_copies_and_of_nothing(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(300) for t in range(4)] + [(1000 + c, 0, "user", f"only {c}") for c in range(50)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    scratch = Scratch(spark)
    assert sorted([tuple(r) for r in prefix_trie.trie(prefix_trie.shared_heads(df, scratch), 20).collect()], key=str) == brute_trie(rows)
    assert prefix_trie.trie(prefix_trie.shared_heads(df.filter("false"), scratch)).count() == 0
    scratch.drop()


def test_a_skeleton_bounded_by_cutting_splitters(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SAMPLE_BYTES", 4000)
    rows = turns(np.random.default_rng(2))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    scratch = Scratch(spark)
    got = prefix_trie.trie(prefix_trie.shared_heads(df, scratch), 10)
    scratch.drop()
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute_trie(rows)


# ---- WARC ------------------------------------------------------------------

PAGES = [(1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (3, "http://a/3", "<p>other</p>"), (4, None, None), (5, "u", ""),
         (6, "http://x/é \r\nWARC-Type: bad%20", "WARC/1.1\r\n\r\n\r\n"), (7, "long", "é" * 700_000), (8, "copy", "é" * 700_000),
         (None, "n", "<p>same</p>"), (None, "n", "nobody else"), (3, "http://a/3", "<p>other</p>"), (9, "r", "<p>other</p>")]


def bare(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("warc"))
    df = spark.createDataFrame([(*r, 1, "x") for r in PAGES], "page_id long, url string, html string, size int, first_id string").repartition(3)
    return folder, warc_bundles.write_bundles(df, folder, frame_bytes=400, bundle_bytes=2000)


def test_archives_give_back_every_page(spark, archive):
    _, index = archive
    got = warc_bundles.read_bundles(index).collect()
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, u, h in PAGES:
        f = first.get(h or "")
        again = f is not None and f != i
        want.append((i, "revisit" if again else "response", f if again else None, u or "", len((h or "").encode()), bare(h),
                     None if again else (h or "").encode()))
    assert sorted([tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in got], key=str) == sorted(want, key=str)


def test_any_reader_opens_a_bundle_and_the_index_finds_records(spark, archive):
    folder, index = archive
    places = index.collect()
    files = {r.file for r in places}
    assert len(files) > 1 and max(r.frame for r in places) > 0
    for name in files:
        data = open(name, "rb").read()
        with zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True) as reader:
            whole = reader.read()
        mine = [r for r in places if r.file == name]
        assert whole.count(b"WARC-Record-ID") == len(mine)
        for r in mine:
            frame = zstandard.ZstdDecompressor().decompress(data[r.frame_start:r.frame_start + r.frame_bytes])
            raw = frame[r.record_start:r.record_start + r.record_bytes]
            assert f"<urn:page:{'' if r.page_id is None else r.page_id}>".encode() in raw and raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")
    ids = spark.createDataFrame([(7, 1), (2, 1), (77, 1)], "page_id long, file int")
    found = {r.page_id: r for r in warc_bundles.lookup(index, ids).collect()}
    assert set(found) == {2, 7} and bytes(found[7].payload).decode() == "é" * 700_000 and found[2].refers_to == 1


def test_a_damaged_bundle_is_not_read(archive, tmp_path):
    with pytest.raises(ValueError):
        warc_bundles.read_table(open(__file__, "rb"), 100)
    good = warc_bundles.record(1, "u", b"abc", warc_bundles.payload_digest(b"abc"), None, False, "1970-01-01T00:00:00Z")
    assert next(warc_bundles.parsed(good))[-1] == b"abc"
    with pytest.raises(ValueError):
        next(warc_bundles.parsed(good.replace(b"abc", b"abd")))


def test_no_pages(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    index = warc_bundles.write_bundles(none, str(tmp_path / "none"))
    assert index.count() == 0 and warc_bundles.read_bundles(index).count() == 0
