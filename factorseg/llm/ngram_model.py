"""N-gram language model in Elias-Fano tries, learned from and queried over whole corpora.

A trigram event (before, word, following) goes to the shard of its middle word. That shard holds all of the word's training
events, so it counts them, writes a trie (``elias_fano.Trie``) to a file, maps it and looks all events up in it. The
probability is discounted: a seen triple has (c - D) / c(before, word); else the share D * kinds / total of its context goes
to the pair level, and from there to the add-one unigram level. The logarithm is a sum over levels, and each term is
known in one shard: whether an event falls to the unigram level of its last word is seen in that word's own shard, where
the same pair is a context. So one shuffle of compact events makes both the model and all scores. A shard answers each
payload of events with one payload of sums by text, which goes back to the stretch of texts it came from; there they are
added, so no row is made for a text in a shard.

Hot words and pairs: a sketch of fixed size counts words and pairs first. A word with more than a quarter of a shard's
events is dealt over several shards by the word before it, and a pair likewise by document; the counts of their pairs and
triples, combined within each task, are sent to all of these. The number of shards follows the number of events.

Shares are not given to words that are seen already, so probabilities sum to at most one (the rest is small).

Defined results: null and empty texts are one end token; rows without an id are training rows; rows that repeat an id or are
equal are scored alike and all count in training; without training rows every probability is that of the empty model
(1 / 1 for unigrams); other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from factorseg.llm import words
from factorseg.llm.elias_fano import Trie, mapped_arrays, packed_arrays
from factorseg.operators.lineage import cut_lineage

SHARD_EVENTS = 3_000_000   # of a shard, on average
PART_EVENTS = 300_000      # of a shard that are counted and looked up at a time
FLUSH_EVENTS = 1_500_000   # a task sends these together; the more, the fewer times a word is named
DISCOUNT = 0.75
CELL_BITS = 19
BEGIN, END = np.uint64(1), np.uint64(2)
NUMBERED = ("before", "word", "following", "bi0", "bi1", "tri0", "tri1", "tri2")   # columns of word numbers
SUMS = ("score", "base", "known", "unigrams", "ends", "events")
PARTIAL = "doc_id long, kinds long, score double, base double, known long, unigrams long, ends long, events long"


def _held_out(ids) -> np.ndarray:
    return np.array([i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i in ids], bool)


def _events(part: pa.RecordBatch):
    """(word hashes, and of each event of the texts in order: before, word, following as places in those; text)."""
    data, bounds = words.text_bytes(part.column("text"))
    starts, ends, first = words.word_spans(data, bounds)
    w = words.span_hashes(data, starts, ends)
    n = np.diff(first)
    text = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(w)) + text                      # each text has one more event than words
    total = len(w) + len(n)
    place = np.arange(2, len(w) + 2, dtype=np.int32)    # 0 is BEGIN, 1 is END
    before, word, following = np.zeros(total, np.int32), np.zeros(total, np.int32), np.ones(total, np.int32)
    following[at] = place
    word[at + 1] = place
    inner = np.ones(len(w), bool)
    inner[first[1:][n > 0] - 1] = False                # a text's last word is never two before an event
    before[at[inner] + 2] = place[inner]
    return np.concatenate([[BEGIN, END], w]), before, word, following, np.repeat(np.arange(len(n), dtype=np.int32), n + 1)


def _pair_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return words.mixed(before * np.uint64(0x9E3779B97F4A7C15) + word)


def _cell(h: np.ndarray) -> np.ndarray:
    return (words.mixed(h) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _counted(rows: DataFrame) -> np.ndarray:
    """Events by hashed word, then by hashed pair: 2 * 2**CELL_BITS cells."""

    def count(batches):
        size = 1 << CELL_BITS
        cells = np.zeros(2 * size, np.uint32)
        for batch in batches:
            for part in words.pieces(batch, "text", 2_000_000):
                h, before, word, _, _ = _events(part)
                cells[:size] += np.bincount(_cell(h[word]), minlength=size).astype(np.uint32)
                cells[size:] += np.bincount(_cell(_pair_hash(h[before], h[word])), minlength=size).astype(np.uint32)
        yield from words.cell_rows(cells)

    parts = rows.select("text").mapInArrow(count, "chunk int, cells binary")
    return np.frombuffer(words.merged_cells(parts, CELL_BITS + 1), np.uint32).reshape(2, -1)


class _Deal:
    """Which shards words and pairs go to."""

    def __init__(self, cells: np.ndarray, shard_events: int):
        total = int(cells[0].sum())
        self.shards = max(1, -(-total // shard_events))
        share = max(1, shard_events // 4)
        # what chance puts into every cell is no sign of a frequent word
        excess = np.maximum(cells.astype(np.int64) - total // cells.shape[1], 0)
        ways = np.where(excess > share, np.minimum(self.shards, -(-excess // share)), 1)
        self.words = {int(c): int(ways[0, c]) for c in np.flatnonzero(ways[0] > 1)}   # at most 4 * shards of each
        self.pairs = {int(c): int(ways[1, c]) for c in np.flatnonzero(ways[1] > 1)}

    @staticmethod
    def _ways(table: dict, h: np.ndarray) -> np.ndarray:
        keys = np.array(sorted(table), np.int64)
        out = np.ones(len(h), np.int64)
        if len(keys) and len(h):
            cell = _cell(h)
            at = np.minimum(np.searchsorted(keys, cell), len(keys) - 1)
            hit = keys[at] == cell
            out[hit] = np.array([table[int(k)] for k in keys], np.int64)[at[hit]]
        return out

    def home(self, h: np.ndarray) -> np.ndarray:
        return (words.mixed(h ^ np.uint64(0x5BD1E995)) % np.uint64(self.shards)).astype(np.int64)

    def word_ways(self, h):
        return self._ways(self.words, h)

    def pair_ways(self, before, word):
        return self._ways(self.pairs, _pair_hash(before, word))


def _payloads(hashes, before, word, following, text, keys, train, ids, no_id, deal: _Deal):
    """(shard, payload) of one stretch of events; numbers in a payload are places in its own list of word hashes, and its texts
    are places in the stretch. The first payload also has the ids of all texts."""
    own, back = np.unique(hashes, return_inverse=True)
    back = back.astype(np.int32)
    before, word, following = back[before], back[word], back[following]
    n = len(own)
    home, ways = deal.home(own), deal.word_ways(own)
    shard = home[word]
    hot = np.flatnonzero(ways[word] > 1)
    bi = tri = None
    if len(hot):
        b, w, t = (x[hot].astype(np.int64) for x in (before, word, following))
        k = ways[w]
        step = (words.mixed(own[b]) % k.astype(np.uint64)).astype(np.int64)
        pair_ways = np.minimum(deal.pair_ways(own[b], own[w]), k)
        step_doc = (words.mixed(keys[text[hot]]) % pair_ways.astype(np.uint64)).astype(np.int64)
        shard[hot] = (home[w] + (step + step_doc) % k) % deal.shards
        learned = train[text[hot]]
        bi = _types([w[learned], t[learned]], n)
        wide = learned & (pair_ways > 1)
        tri = _types([b[wide], w[wide], t[wide]], n)
    order = np.argsort(shard.astype(np.uint16) if deal.shards < 65536 else shard, kind="stable")
    limits = np.searchsorted(shard[order], np.arange(deal.shards + 1))
    extra = {s: [] for s in range(deal.shards)} if bi is not None else {}
    if bi is not None:
        k = ways[bi[0]]
        for j in range(int(k.max(initial=0))):
            _spread(extra, "bi", (home[bi[0]] + j) % deal.shards, k > j, bi)
        k = ways[tri[1]]
        step = (words.mixed(own[tri[0]]) % k.astype(np.uint64)).astype(np.int64)
        pair_ways = np.minimum(deal.pair_ways(own[tri[0]], own[tri[1]]), k)
        for j in range(int(pair_ways.max(initial=0))):
            _spread(extra, "tri", (home[tri[1]] + (step + j) % k) % deal.shards, pair_ways > j, tri)
    import zstandard
    squeeze = zstandard.ZstdCompressor(level=3)
    lookup = np.zeros(n, np.int64)
    header = {"ids": ids, "no_id": no_id.astype(np.uint8)}
    for s in range(deal.shards):
        mine = order[limits[s]:limits[s + 1]]
        parts = {"before": before[mine], "word": word[mine], "following": following[mine]}
        for kind, columns in extra.get(s, []):
            parts |= {f"{kind}{i}": c for i, c in enumerate(columns)}
        if not len(mine) and len(parts) == 3:
            continue
        counts = {name: parts.pop(name).astype(np.uint32) for name in ("bi2", "tri3") if name in parts}
        seen = np.zeros(n, bool)
        for c in parts.values():
            seen[c] = True
        there = np.flatnonzero(seen)
        lookup[there] = np.arange(len(there))
        small = np.uint16 if len(there) < 65536 else np.uint32
        parts = {name: lookup[c].astype(small) for name, c in parts.items()} | counts
        texts, place = np.unique(text[mine], return_inverse=True)
        parts |= {"hashes": _stepped(own[there]), "places": texts.astype(np.int32), "train": train[texts].astype(np.uint8),
                  "text": place.astype(np.uint16 if len(texts) < 65536 else np.uint32)} | header
        header = {}
        yield s, squeeze.compress(packed_arrays(parts))


def _stepped(sorted_values: np.ndarray) -> np.ndarray:
    """Steps between sorted values as planes of equal bytes; the high planes are nearly empty."""
    steps = np.diff(sorted_values, prepend=np.uint64(0)).astype("<u8")
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)


def _unstepped(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _types(columns: list[np.ndarray], n: int) -> list[np.ndarray]:
    """Distinct rows of numbers below n, and how often each comes."""
    code = np.zeros(len(columns[0]), np.int64)
    last = columns[-1]
    for c in columns[:-1]:
        code = code * n + c
    if len(columns) == 3 and n >= 1 << 21:
        _, code = np.unique(code, return_inverse=True)
    own, first, count = np.unique(code * n + last, return_index=True, return_counts=True)
    del own
    return [c[first] for c in columns] + [count]


def _spread(extra: dict, kind: str, shard: np.ndarray, on: np.ndarray, columns: list[np.ndarray]) -> None:
    at = np.flatnonzero(on)
    at = at[np.argsort(shard[at], kind="stable")]
    limits = np.flatnonzero(np.r_[True, shard[at][1:] != shard[at][:-1]]) if len(at) else at
    for a, b in zip(limits, np.append(limits[1:], len(at))):
        held = extra[int(shard[at[a]])]
        old = next((c for name, c in held if name == kind), None)
        new = [c[at[a:b]] for c in columns]
        if old is None:
            held.append((kind, new))
        else:
            old[:] = [np.concatenate(x) for x in zip(old, new)]


def sharded_events(rows: DataFrame, deal: _Deal) -> DataFrame:
    """(shard, origin, payload) of all texts; ``rows`` has doc_id, text and a key of both. The origin, a stretch of texts, is the
    same when a lost task runs again: the place of the stretch in its partition."""

    def send(batches):
        from pyspark import TaskContext
        held, events = [], 0
        origin = TaskContext.get().partitionId() << 32

        def flush():
            nonlocal origin
            columns = [[] for _ in range(9)]
            at = texts = 0
            while held:
                h, before, word, following, text, keys, *of_text = held.pop(0)
                for c, v in zip(columns, (h, before + at, word + at, following + at, text + texts, keys, *of_text)):
                    c.append(v)
                at += len(h)
                texts += len(keys)
            for s, payload in _payloads(*map(np.concatenate, columns), deal):
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([origin], pa.int64()),
                                                  pa.array([payload], pa.binary())], ["shard", "origin", "payload"])
            origin += 1

        for batch in batches:
            for part in words.pieces(batch, "text", 2_000_000):
                h, before, word, following, text = _events(part)
                ids = part.column("doc_id")
                held.append((h, before, word, following, text, part.column("key").to_numpy().view(np.uint64),
                             ~_held_out(ids.to_pylist()), ids.fill_null(0).to_numpy(zero_copy_only=False),
                             ids.is_null().to_numpy(zero_copy_only=False)))
                events += len(text)
                if events >= FLUSH_EVENTS:
                    yield from flush()
                    events = 0
        if held:
            yield from flush()

    return rows.mapInArrow(send, "shard int, origin long, payload binary")


def _arrays(payload) -> dict[str, np.ndarray]:
    import zstandard
    return mapped_arrays(zstandard.ZstdDecompressor().decompress(payload.as_py()))


def _opened(payloads) -> dict:
    """What the parts of a shard share: distinct word hashes, each payload's word numbers, train of the texts, and the number
    of events. The events stay in their compressed payloads."""
    lists, train, events = [], [], 0
    for p in map(_arrays, payloads):
        lists.append(_unstepped(p["hashes"]))
        train.append(p["train"].copy())
        events += len(p["word"])
    own = np.unique(np.concatenate(lists))
    numbers = [np.searchsorted(own, lists.pop(0)).astype(np.int32) for _ in range(len(lists))]
    return {"hashes": own, "numbers": numbers, "train": np.concatenate(train), "events": events}


def _parts(payloads, e: dict):
    """The shard's events in parts of about PART_EVENTS, all events of a word in one; a part is all that is open at a time."""
    parts = max(1, -(-e["events"] // PART_EVENTS))
    of_word = (words.mixed(e["hashes"] ^ np.uint64(0x2545F491)) % np.uint64(parts)).astype(np.int16)
    for i in range(parts):
        held: dict[str, list[np.ndarray]] = {}
        texts = 0
        for number, p in zip(e["numbers"], map(_arrays, payloads)):
            here = of_word[number] == i
            chosen = dict.fromkeys(("before", "word", "following", "text"), np.flatnonzero(here[p["word"]]))
            for kind, size, word in (("bi", 3, "bi0"), ("tri", 4, "tri1")):
                if word in p:
                    chosen |= dict.fromkeys((f"{kind}{j}" for j in range(size)), np.flatnonzero(here[p[word]]))
            for name, at in chosen.items():
                values = p[name][at]
                if name in NUMBERED:
                    values = number[values]
                elif name == "text":
                    values = values.astype(np.int32) + np.int32(texts)
                held.setdefault(name, []).append(values)
            texts += len(p["train"])
        part = {"hashes": e["hashes"], "train": e["train"]} | {name: np.concatenate(held.pop(name)) for name in list(held)}
        if len(part["word"]) or len(part.get("bi0", ())):
            yield part


def _learned(e: dict[str, np.ndarray], discount: float):
    """(trie buffer, training count of each word, distinct triples of all events: before, word, following; and of each
    event its triple)."""
    n = len(e["hashes"])
    train = e["train"][e["text"]].astype(np.int64)
    pairs, pair = np.unique(e["word"].astype(np.int64) * n + e["before"], return_inverse=True)
    triples, triple = np.unique(pair.astype(np.int64) * n + e["following"], return_inverse=True)
    context, following = np.divmod(triples, n)
    word, before = np.divmod(pairs[context], n)
    count = np.bincount(triple, train, minlength=len(triples)).astype(np.int64)

    def with_sent(have, have_count, sent, sent_count, group, sent_group):
        """Counts as sent replace those counted here for the groups that were sent."""
        keep = ~np.isin(group, np.unique(sent_group)) & (have_count > 0)
        keys, at = np.unique(np.concatenate([have[keep], sent]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([have_count[keep], sent_count]), minlength=len(keys)).astype(np.int64)

    none = np.zeros(0, np.int64)
    bi = [e.get(f"bi{i}", none).astype(np.int64) for i in range(3)]
    tri = [e.get(f"tri{i}", none).astype(np.int64) for i in range(4)]
    two, at = np.unique(word * n + following, return_inverse=True)
    two_count = np.bincount(at, count, minlength=len(two)).astype(np.int64)
    two, two_count = with_sent(two, two_count, bi[0] * n + bi[1], bi[2], two // n, bi[0])
    # triples as (context number, following), with contexts numbered among all that occur or were sent
    sent_pair = tri[1] * n + tri[0]
    contexts = np.union1d(pairs, sent_pair)
    own_context = np.searchsorted(contexts, pairs)[context]
    sent_context = np.searchsorted(contexts, sent_pair)
    three, three_count = with_sent(own_context * n + following, count, sent_context * n + tri[2], tri[3], own_context, sent_context)
    c, t = np.divmod(three, n)
    w, b = np.divmod(contexts[c], n)
    buffer = Trie.build(n, two // n, two % n, two_count, b, w, t, three_count, discount)
    return buffer, np.bincount(two // n, two_count, minlength=n), (before, word, following), triple


def scores(docs: DataFrame, discount: float = DISCOUNT, shard_events: int = SHARD_EVENTS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per input row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn(
        "key", F.xxhash64("doc_id", "text"))
    with words.small_batches(docs.sparkSession):
        return _scores(rows, discount, shard_events)


def _scores(rows: DataFrame, discount: float, shard_events: int) -> DataFrame:
    deal = _Deal(_counted(rows), shard_events)

    def score(group: pa.Table) -> pa.Table:
        import zstandard
        payloads = group.column("payload")
        e = _opened(payloads)
        shard = group.column("shard")[0].as_py()
        begin = np.searchsorted(e["hashes"], BEGIN) if BEGIN in e["hashes"] else -1
        end = np.searchsorted(e["hashes"], END) if END in e["hashes"] else -1
        own = deal.home(e["hashes"]) == shard
        n, kinds = len(e["train"]), 0
        sums = {c: np.zeros(n) for c in SUMS}
        for part in _parts(payloads, e):
            buffer, count, (before, word, following), triple = _learned(part, discount)
            trie = Trie.mapped(buffer)
            del buffer
            value, pair_known, context_known = trie.query(before, word, following)
            real = word != begin
            single = np.where(real, np.log10(count[word] + 1), 0.0)
            falls = real & ~context_known          # the pair before the word is unseen: its unigram level is due here
            for c, x in (("score", value + np.where(falls, single, 0.0)), ("base", single), ("known", real & (count[word] > 0)),
                         ("unigrams", falls), ("ends", (following == end) & ~pair_known)):
                sums[c] += np.bincount(part["text"], x[triple], minlength=n)
            sums["events"] += np.bincount(part["text"], minlength=n)
            here = own & (count > 0)
            if begin >= 0:
                here[begin] = False
            kinds += int(here.sum())
        squeeze, answers, at = zstandard.ZstdCompressor(level=1), [], 0
        for p in map(_arrays, payloads):
            to = at + len(p["train"])
            answer = {c: v[at:to] if c in ("score", "base") else v[at:to].astype(np.int32) for c, v in sums.items()}
            answers.append(squeeze.compress(packed_arrays(
                {"places": p["places"]} | answer | {c: p[c] for c in ("ids", "no_id") if c in p})))
            at = to
        out = pa.table({"origin": group.column("origin"), "kinds": pa.array([kinds] + [0] * (len(answers) - 1), pa.int64()),
                        "payload": pa.array(answers, pa.binary())})
        del e, sums, answers
        words.release()
        return out

    def added(group: pa.Table) -> pa.Table:
        """One row a text of the stretch, and one without events that has the distinct training words of its shards."""
        payloads = group.column("payload")
        ids = next(p for p in map(_arrays, payloads) if "ids" in p)
        sums = {c: np.zeros(len(ids["ids"]) + 1, float if c in ("score", "base") else np.int64) for c in SUMS}
        for p in map(_arrays, payloads):
            for c, total in sums.items():
                total[p["places"]] += p[c]
        kinds = np.zeros(len(ids["ids"]) + 1, np.int64)
        kinds[-1] = pc.sum(group.column("kinds")).as_py()
        return pa.table({"doc_id": pa.array(np.append(ids["ids"], 0), pa.int64(), mask=np.append(ids["no_id"], 1).astype(bool)),
                         "kinds": kinds} | sums)

    answered = sharded_events(rows, deal).groupBy("shard").applyInArrow(score, "origin long, kinds long, payload binary")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))
    table = cut_lineage(answered.groupBy("origin").applyInArrow(added, PARTIAL).withColumn("held_out", held_out))
    distinct = table.agg(F.coalesce(F.sum("kinds"), F.lit(0))).first()[0]
    table = table.filter("events > 0")
    seen = table.filter("not held_out").agg(F.coalesce(F.sum("events"), F.lit(0)), F.count("*")).first()
    tokens, ends = int(seen[0]), int(seen[1])
    kinds = distinct + (1 if ends else 0)
    room, last = float(np.log10(tokens + kinds + 1)), float(np.log10(ends + 1))
    return table.select(
        "doc_id", "held_out", F.col("events").alias("n_tokens"), (F.col("known") + (1 if ends else 0)).cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + last - F.col("events") * room).alias("base_score"),
        (F.col("score") + F.col("ends") * last - (F.col("unigrams") + F.col("ends")) * room).alias("score"))


def model(docs: DataFrame, discount: float = DISCOUNT, shard_events: int = SHARD_EVENTS) -> DataFrame:
    """(shard, part, hashes, trie): the tries over the training rows as buffers that ``Trie(mapped_arrays(...))`` opens where they
    are mapped, with the hashes their word numbers stand for."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn(
        "key", F.xxhash64("doc_id", "text"))
    deal = _Deal(_counted(rows), shard_events)

    def build(group: pa.Table) -> pa.Table:
        payloads = group.column("payload")
        e = _opened(payloads)
        shard = group.column("shard")[0].as_py()
        tries = [_learned(part, discount)[0] for part in _parts(payloads, e)]
        return pa.table({"shard": pa.array([shard] * len(tries), pa.int32()), "part": pa.array(range(len(tries)), pa.int32()),
                         "hashes": pa.array([e["hashes"].tobytes()] * len(tries), pa.binary()), "trie": pa.array(tries, pa.binary())})

    return sharded_events(rows, deal).groupBy("shard").applyInArrow(build, "shard int, part int, hashes binary, trie binary")
