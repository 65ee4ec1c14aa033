"""Text operators against brute force, and their defined results for nulls, empty and long texts, ties and repeated rows."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brute import WORD, groups, lower, passages, removals, split, without
from factorseg.llm import (chat_format, jaccard_join, license_scan, mixing, ngram_model, packing, substring_dedup, tokens,
                           toxicity, words)
from factorseg.llm.elias_fano import Sequence, Trie, mapped_arrays, packed_arrays

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component string, n int, token string"
def shingles(text, k):
    w = split(text)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def sentence(rng, n, kinds=400):
    return " ".join(f"w{i}" for i in rng.integers(0, kinds, n))


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies, shared passages, odd texts, a repeated row, null id and columns with names used inside."""
    rng = np.random.default_rng(3)
    base = sentence(rng, 120)
    passage = sentence(rng, 60)
    rows = [(1, base), (2, base), (3, base.replace("w1 ", "x1 ", 1)), (4, None), (5, ""), (6, "  \n\t "), (7, "one two"),
            (8, "One TWO"), (9, "a\x0bb\x0cc"), (10, "é à ö ß"), (11, "long " * 30_000), (12, "long " * 29_999),
            (13, sentence(rng, 3000, 3000)), (1, base), (None, base), (None, None), (-5, sentence(rng, 90))]
    for i in range(20, 60):
        w = base.split()
        for p in rng.integers(0, len(w), i % 4):
            w[p] = f"y{rng.integers(0, 9)}"
        rows.append((i, " ".join(w)))
    for i in range(60, 75):
        rows.append((i, sentence(rng, 40) + "\n" + passage + "\n" + sentence(rng, 40)))
    rows.append((75, sentence(rng, 30) + "\n" + " ".join(passage.split()[:-1] + ["other"]) + "\n" + passage))
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", None if j % 5 == 0 else f"s{j % 3}", len(t or ""), "c", 1, "t")
                                  for j, (i, t) in enumerate(texts)], SCHEMA).repartition(3).cache()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("k, similarity", [(3, (9, 10)), (5, (4, 5))])
def test_jaccard_components(docs, texts, k, similarity):
    num, den = similarity
    got = jaccard_join.jaccard_components(docs, k, similarity).collect()
    assert len(got) == len(texts)
    known = sorted({(i, t) for i, t in texts if i is not None}, key=str)
    links = []
    for i, t in known:
        for j, u in known:
            a, b = shingles(t, k), shingles(u, k)
            if a and b and den * len(a & b) >= num * len(a | b):
                links.append((i, j))
    want = groups(links)
    sizes = sorted(((i, len(shingles(t, k))) for i, t in texts), key=str)
    assert sorted(((r.doc_id, r.n_shingles) for r in got), key=str) == sizes
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == {i: want.get(i, i) for i, _ in known}
    kept = [r.doc_id for r in jaccard_join.keep_first(docs, k, similarity).collect()]
    assert sorted(x for x in kept if x is not None) == sorted(i for i, _ in texts if i is not None and want.get(i, i) == i)
    assert kept.count(None) == 2


def test_large_groups_of_near_copies(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(3):
        base = sentence(rng, 100, 5000).split()
        for _ in range(60):
            w = list(base)
            for p in rng.integers(0, len(w), rng.integers(0, 4)):
                w[p] = f"z{rng.integers(0, 10 ** 9)}"
            rows.append((len(rows), " ".join(w)))
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(
        spark.createDataFrame(rows, "doc_id long, text string"), 3, (9, 10)).collect()}
    links = []
    sets = [shingles(t, 3) for _, t in rows]
    for i, a in enumerate(sets):
        links += [(i, j) for j, b in enumerate(sets) if 10 * len(a & b) >= 9 * len(a | b)]
    assert got == groups(links)


def check_passages(docs, texts):
    """The operator's rows against those of ``passages``."""
    units, members, hit = passages([(i, t) for i, t in texts if i is not None and t])
    got = substring_dedup.repeated_passages(docs).collect()
    assert len({(r.doc_id, r.start, r.end, r.document) for r in got}) == len(got)
    kept, removed = removals(units, members, hit)
    told = {m for g in members.values() if set(g) & removed for m in g if m in removed or m in kept}
    assert sorted((r.doc_id, r.start, r.end, r.n_words, r.kept, r.removed) for r in got) == sorted(
        (units[n][0], units[n][2], units[n][3], len(units[n][4]), n in kept, n in removed) for n in told)
    left = substring_dedup.without_repeats(docs)
    assert left.columns == docs.columns
    want = []
    for i, t in texts:
        if i is None or not t:
            want.append((i, t))
            continue
        cut = without(t, i, units, removed)
        if cut == t or WORD.search(cut):
            want.append((i, cut))
    rows = left.collect()
    assert sorted(((r.doc_id, r.text) for r in rows), key=str) == sorted(want, key=str)
    assert all(r.n_chars == len(r.text or "") for r in rows)
    return removed, units


def test_repeated_passages(docs, texts):
    removed, _ = check_passages(docs, texts)
    assert removed


def test_passages_inside_lines_and_over_wrapped_lines(spark):
    rng = np.random.default_rng(11)
    rows = []
    for p in range(12):
        passage = sentence(rng, int(rng.integers(51, 90)), 5000).split()
        for copy in range(4):
            before, after = sentence(rng, int(rng.integers(0, 300)), 5000), sentence(rng, int(rng.integers(0, 300)), 5000)
            if copy == 1:      # hard-wrapped
                size = int(rng.integers(9, 14))
                text = "\n".join([before] + [" ".join(passage[i:i + size]) for i in range(0, len(passage), size)] + [after])
            elif copy == 2:    # a line of its own
                text = before + "\n" + " ".join(passage) + "\n" + after
            else:              # inside a line
                text = before + " " + " ".join(passage) + " " + after
            rows.append((100 * p + copy, text, len(text)))
    rows += [(5000 + i, sentence(rng, 400, 5000), 0) for i in range(40)]
    rows = [(i, t, len(t)) for i, t, _ in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int").withColumn("row", F.lit(1)).withColumn("spans", F.lit(2))
    check_passages(df, [(i, t) for i, t, _ in rows])
    got = {r.doc_id for r in substring_dedup.repeated_passages(df).filter("removed").collect()}
    planted = {100 * p + copy for p in range(12) for copy in (1, 2, 3)}
    assert len(got & planted) >= 0.9 * len(planted) and got <= planted


def test_rows_that_repeat_an_id_are_cut_apart(spark):
    rng = np.random.default_rng(12)
    p, q, a, b = (sentence(rng, n, 9000) for n in (60, 60, 30, 30))
    rows = [(0, p), (1, p + "\n" + a), (1, q + "\n" + b), (2, None), (None, p)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted(((r.doc_id, r.text) for r in substring_dedup.without_repeats(df).collect()), key=str)
    assert left == sorted([(0, p), (1, a), (1, q + "\n" + b), (2, None), (None, p)], key=str)
    assert substring_dedup.without_repeats(df.filter("false")).count() == 0
    assert substring_dedup.repeated_passages(df.filter("false")).count() == 0


def test_license_scan(spark, docs):
    notice = license_scan.TEMPLATES["gpl-3.0"]
    rows = [(1, "before words here\n" + notice), (2, notice.upper()), (3, None), (4, ""), (5, notice.replace("License", "Thing")),
            (6, "word " * 5000 + license_scan.TEMPLATES["bsd-conditions"] + " tail" * 5000), (7, notice + " " + notice), (7, notice),
            (None, notice), (8, "é " + license_scan.TEMPLATES["mit"])]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, license int")
    got = license_scan.scanned(df).collect()

    def brute(text):
        out = set()
        w = split(text)
        for name, template in license_scan.TEMPLATES.items():
            t = [tuple(x) for x in zip(*(split(template)[j:] for j in range(5)))]
            s = [tuple(x) for x in zip(*(w[j:] for j in range(5)))]
            for begin in range(0, len(s), len(t)):
                if 5 * len(set(s[begin:begin + 2 * len(t)]) & set(t)) >= 4 * len(set(t)):
                    out.add(name)
        return out

    assert sorted(((r.doc_id, r.license) for r in got), key=str) == sorted(((i, n) for i, t in rows for n in brute(t)), key=str)
    for r in got:
        text = dict((i, t) for i, t in rows if i != 7).get(r.doc_id, notice)
        assert lower(text)[r.start:r.end] == lower(license_scan.TEMPLATES[r.license])
    assert license_scan.scanned(empty(spark)).count() == 0
    assert license_scan.scanned(docs).count() == 0


def test_tokens_equal_the_tokenizers_file():
    import public_tokenizers
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    rng = np.random.default_rng(1)
    odd = [None, "", " ", "\n", "a  b   c\n\n d", "é  　 x\t\n y", "it's  we'll\x1c  z <|endoftext|> 12 3!!", "x\x85  b", "ab" * 4000]
    alphabet = list("ab 1'\n\t.é  \x1c漢")
    odd += ["".join(rng.choice(alphabet, 30)) for _ in range(300)]
    ids, offsets = tokens.Encoder(*tokens.public_vocabulary()).encode(pa.array(odd))
    for i, t in enumerate(odd):
        assert list(ids[offsets[i]:offsets[i + 1]]) == whole.encode(t or "", add_special_tokens=False).ids


def test_added_tokens_are_those_of_the_tokenizers_file(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(2)
    odd = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y", "a  <|endoftext|>  b\n", "<|endoftext|", "é<|endoftext|>\x85 z"]
    odd += ["".join(rng.choice(["a", " ", "<|endoftext|>", "\n", "'s", "é", "<|", "\u3000"], 20)) for _ in range(200)]
    want = [whole.encode(t, add_special_tokens=False).ids for t in odd]
    assert want[0] == [64, 220, 50256, 275]
    out = packing.packed(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), keep_ids=True).collect()
    assert {r.doc_id: list(r.ids) for r in out} == {i: [*ids, 1] for i, ids in enumerate(want)}


def test_packing(spark, docs, texts):
    encoder = tokens.Encoder(*tokens.public_vocabulary())
    ids, offsets = encoder.encode(pa.array([t for _, t in texts]))
    want = sorted(((i, np.append(ids[offsets[n]:offsets[n + 1]], 1).astype("<u4").tobytes()) for n, (i, _) in enumerate(texts)), key=str)
    out = packing.packed(docs, keep_ids=True).toPandas()
    place = defaultdict(int)
    for r in out.sort_values(["sequence_id", "offset"]).itertuples():
        assert r.offset == place[r.sequence_id]
        place[r.sequence_id] += r.length
        assert r.length == len(r.ids) and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    assert max(place.values()) <= 2048
    full = (out.length == 2048).sum()
    assert full >= 1 and out.length.sum() == sum(len(b) // 4 for _, b in want)
    single = out[(out.start == 0) & (out.length == out.doc_tokens)]
    short = [(i, b) for i, b in want if len(b) <= 4 * 2048]
    assert sorted(((None if x.doc_id != x.doc_id else int(x.doc_id), np.array(x.ids, "<u4").tobytes()) for x in single.itertuples()), key=str) == short
    assert packing.packed(empty(spark)).count() == 0


def test_packing_plan_uses_up_every_length():
    rng = np.random.default_rng(0)
    for size, top in ((8, 3), (32, 50), (128, 1000)):
        counts = rng.integers(0, top, size + 1)
        counts[0] = 0
        plan = packing.packing_plan(counts)
        used = np.zeros(size + 1, int)
        for parts, repeats in plan:
            assert sum(parts) <= size and repeats > 0
            np.add.at(used, list(parts), repeats)
        assert (used == counts).all()
        if size == 128:
            assert (counts * np.arange(size + 1)).sum() / (size * sum(r for _, r in plan)) > 0.95


def test_mixing_schedule_and_rows(spark):
    rows = [(i if i % 50 else None, f"s{i % 7 % 3}" if i % 11 else None, i) for i in range(700)] + [(7, "s1", 7)] * 3
    df = spark.createDataFrame(rows, "doc_id long, source string, q int").withColumn("key", F.lit("x")).withColumn("row", F.lit(1))
    weights = {"s0": 5, "s1": 3, "s2": 1, None: 1}
    out = mixing.mixed(df, weights, block_rows=2).toPandas()
    assert set(out.q) == {r[2] for r in rows} and (out.groupby("mix_position").size() == 1).all()
    share = {"s0": .5, "s1": .3, "s2": .1, None: .1}
    slots = out.assign(slot=out.mix_position // 2, s=out.source.where(out.source.notna(), None)).drop_duplicates("slot").sort_values("slot")
    assert list(slots.slot) == list(range(len(slots)))
    for s, w in share.items():
        is_s = slots.source.isna() if s is None else slots.source == s
        lag = np.abs(is_s.cumsum().to_numpy() - w * np.arange(1, len(slots) + 1))
        assert lag.max() < 1
    assert mixing.mixed(empty(spark)).count() == 0
    assert mixing.mixed(df).count() >= len(rows)


def test_mixing_shares_in_rows(spark):
    """Sources of 1, 17 and 1,000 rows keep their shares in rows, prefix by prefix, to less than one block."""
    sizes = {"one": 1, "big": 1000} | {f"s{i}": 17 for i in range(8)}
    rows = [(i * 10_000 + j, s) for i, (s, n) in enumerate(sizes.items()) for j in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    out = mixing.mixed(df, dict.fromkeys(sizes, 1)).toPandas().sort_values("mix_position")
    assert list(out.mix_position) == list(range(len(out))) and len(out) % 16 == 0
    assert set(out.doc_id) == {r[0] for r in rows}
    for s, n in sizes.items():
        lag = np.abs((out.source == s).cumsum().to_numpy() - 0.1 * np.arange(1, len(out) + 1))
        assert lag.max() < 16
        times = out[out.source == s].doc_id.value_counts()
        assert times.max() - times.min() <= 1 and len(times) == n


def test_chat_round_trip(spark):
    import hashlib
    rows = [(1, 0, "user", "hi </turn> &lt; <turn user>"), (1, 1, "assistant", "é <b> &amp;"), (1, 2, "user", None), (2, 0, "assistant", "a"),
            (2, 1, "assistant", ""), (2, 1, "assistant", "z"), (3, None, None, "x\ny"), (None, 0, "assistant", "n"), (4, 5, "a>b", "t" * 50_000),
            (4, 6, "assistant", "</turn>\n<turn assistant>\n"), (4, 6, "assistant", "</turn>\n<turn assistant>\n")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, example int")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.examples(df)).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted((-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv)
        said = "".join(x for _, r, x in turns if r == "assistant")
        r = got[conv]
        assert r.n_turns == len(turns) and r.loss_chars == len(said)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    ex = chat_format.examples(df).filter("conv_id = 1").collect()
    assert [e.loss_chars for e in sorted(ex, key=lambda e: e.example)] == [len("é &lt;b&gt; &amp;amp;"), 0]
    assert chat_format.read_back(chat_format.examples(df.filter("false"))).count() == 0


def test_toxicity(spark):
    rng = np.random.default_rng(2)
    bad = ["stinkard", "blockhead", "numskull", "lowlife"]
    rows, labels = [], []
    for i in range(600):
        w = sentence(rng, int(rng.integers(20, 200)), 3000).split()
        toxic = int(i % 5 == 0)
        if toxic:
            for p in rng.integers(0, len(w), max(2, len(w) // 15)):
                w[p] = bad[rng.integers(0, 4)]
        rows.append((i, " ".join(w), "x"))
        labels.append((i, 1, toxic, "y"))
    rows += [(1000, None, "x"), (1001, "", "x"), (None, "word", "x"), (0, rows[0][1], "x"), (1002, "w1 " * 100_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels + [(1000, None, None, None), (5, 1, 1, "y")], "doc_id long, quality int, toxic int, text string")
    out = toxicity.scored(docs, toxicity.train(docs, marks)).toPandas()
    assert len(out) == len(rows) and out.score.between(0, 1).all() and out.score.notna().all()
    assert ((out.score >= 0.3) == (out.predicted == 1)).all()
    held = out[out.held_out].merge(docs.sparkSession.createDataFrame(labels, "doc_id long, q int, toxic int, t string").toPandas(), on="doc_id")
    assert ((held.predicted == held.toxic).mean()) > 0.95
    assert set(held.doc_id.astype(int)) == {i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2}
    none = toxicity.train(docs, marks.filter("toxic = 0"))
    assert set(toxicity.scored(docs, none).toPandas().score) == {0.0}
    assert toxicity.scored(empty(spark), none).count() == 0
    kept = toxicity.clean(docs, marks)
    assert kept.columns == docs.columns and kept.filter("doc_id is null").count() == 1


def test_toxicity_trains_both_dictionaries(spark):
    rng = np.random.default_rng(4)
    usual = [sentence(rng, 100, 3000) for _ in range(300)] + ["one stinkard said"]
    toxic = [" ".join(x for w in sentence(rng, 100, 3000).split() for x in ([w, "stinkard"] if rng.random() < 0.1 else [w])) for _ in range(150)]
    rows = spark.createDataFrame([(0, t) for t in usual] + [(1, t) for t in toxic], "toxic int, text string")
    frequent = toxicity._toxic_words(rows, len(usual), len(toxic))
    made = toxicity._dictionaries([t.encode() for t in usual], [t.encode() for t in toxic], frequent)
    for name in ("ordinary", "toxic"):
        assert made[name][:4] == bytes.fromhex("37a430ec") and len(made[name]) >= 1024  # zstandard's mark
    assert b" stinkard " in made["words"]  # although one ordinary text holds it
    few = toxicity._dictionaries([b"a b"], [b"c d"], [])
    assert few["ordinary"] == b"a b" and few["toxic"] == b"c d"


def test_toxicity_learns_from_whole_texts(spark):
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for i in range(300):
        toxic = int(i % 4 == 0)
        w = sentence(rng, 1500, 3000).split()  # about 7,000 characters
        if toxic:
            w[1250:] = [x for v in w[1250:] for x in ([v, "stinkard"] if rng.random() < 0.2 else [v])]
        rows.append((i, " ".join(w)))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.scored(docs, toxicity.train(docs, marks)).filter("held_out").toPandas().merge(marks.toPandas(), on="doc_id")
    assert (out.predicted == out.toxic).mean() > 0.95


@pytest.mark.parametrize("shard_events", [400, 2_500_000])
def test_ngram_model(spark, docs, texts, shard_events):
    discount = ngram_model.DISCOUNT
    learned = [split(t) + ["</s>"] for i, t in texts if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    one, two, three = defaultdict(int), defaultdict(int), defaultdict(int)
    total, kinds = defaultdict(int), defaultdict(set)
    for w in learned:
        for x in w:
            one[x] += 1
        for a, b, c in zip(["<s>", "<s>", *w], ["<s>", *w], w):
            two[b, c] += 1
            three[a, b, c] += 1
            for context in ((b,), (a, b)):
                total[context] += 1
                kinds[context].add(c)
    n = sum(one.values())
    step = lambda p: np.ceil(-np.log10(p) * 16) / -16

    def log10(a, b, c):
        if three[a, b, c]:
            return step((three[a, b, c] - discount) / total[a, b])
        out = step(discount * len(kinds[a, b]) / total[a, b]) if total[a, b] else 0
        if two[b, c]:
            return out + step((two[b, c] - discount) / total[b,])
        return out + (step(discount * len(kinds[b,]) / total[b,]) if total[b,] else 0) + np.log10((one.get(c, 0) + 1) / (n + kinds_before + 1))

    kinds_before = len(one)
    want = []
    for i, t in texts:
        w = split(t) + ["</s>"]
        known = sum(one.get(x, 0) > 0 for x in w)
        base = sum(np.log10((one.get(x, 0) + 1) / (n + kinds_before + 1)) for x in w)
        want.append((i, len(w), known, n, base, sum(log10(a, b, c) for a, b, c in zip(["<s>", "<s>", *w], ["<s>", *w], w))))
    got = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)
           for r in ngram_model.scores(docs, shard_events=shard_events).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    for a, b in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9) and a[5] == pytest.approx(b[5], rel=1e-6, abs=1e-6)


def test_ngram_model_on_nothing(spark):
    assert ngram_model.scores(empty(spark)).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, top in ((0, 10), (1, 1), (5, 9), (900, 1100), (5000, 10 ** 12)):
        values = np.unique(rng.integers(0, top, n))
        s = Sequence.of(mapped_arrays(packed_arrays(Sequence.arrays("x", values, top))), "x")
        assert (s.get(np.arange(len(values))) == values).all()
        asked = np.concatenate([values, rng.integers(0, top, 200)])
        place = {int(v): i for i, v in enumerate(values)}
        assert list(s.find(asked)) == [place.get(int(v), -1) for v in asked]


def test_trie_levels_are_mapped_from_a_file():
    ints = lambda *x: np.array(x, np.int64)
    buffer = Trie.build(4, ints(0, 0, 1), ints(1, 2, 3), ints(3, 1, 2), ints(0), ints(1), ints(3), ints(2), 0.75)
    trie = Trie.mapped(buffer)
    for a in trie.a.values():
        while not isinstance(a, np.memmap):
            a = a.base if isinstance(a, np.ndarray) else a.obj
    asked = ints(0, 2, 0), ints(1, 1, 0), ints(3, 3, 2)
    for x, y in zip(trie.query(*asked), Trie(mapped_arrays(buffer)).query(*asked), strict=True):
        assert (x == y).all()


def test_words_follow_the_definition():
    texts = ["", None, "A b\tC\x0bd", "\x1c\x85é É", "x" * 600_000 + " y", " lead"]
    data, bounds = words.text_bytes(pa.array(texts))
    starts, ends, first = words.word_spans(data, bounds)
    got = [[bytes(data[a:b]).decode() for a, b in zip(starts[first[i]:first[i + 1]], ends[first[i]:first[i + 1]])] for i in range(len(texts))]
    assert got == [WORD.findall(t or "") for t in texts]
    h = words.span_hashes(data, starts, ends)
    one = words.span_hashes(*[np.frombuffer(b"a", np.uint8), np.array([0]), np.array([1])])
    assert h[0] == one[0] and len(set(h.tolist())) == len(h)
