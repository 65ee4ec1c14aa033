"""Substring dedup: passages that repeat exactly or nearly, found by MinHash banding of short paragraphs and removed.

1. Lines of at least MIN_WORDS words are segments of their own; runs of shorter lines (hard-wrapped text) are joined. A segment is cut
   into paragraphs where a pair of words has the least hash among those within REACH words on both sides. Such places depend
   on the words around them alone, so a passage is cut alike wherever it stands: inside a longer line, over wrapped lines
   or as a line of its own. Paragraphs have about 2 * REACH + 1 words, and at least REACH but at a segment's bounds.
2. Every paragraph gives a 96-bit hash, which names it, and one key per band. With BANDS bands of one minimum each, a pair at Jaccard
   0.8 shares no band with probability (1 - 0.8)**2 = 0.04 (0.9: 0.01), and equal paragraphs share all.
3. Equal paragraphs collapse to one row.
4. Paragraphs that collide in a band are joined and verified by exact Jaccard of their word shingles; components follow (``linking``;
   no list is paired with itself).
5. The first occurrence of a component (least document id, then text, then position) stays. All others are removed where neighbours that go make a passage of at least MIN_WORDS
   words; shorter repeats (phrases) stay.

Defined results: null and empty texts, and rows without an id, have no passages to remove and come back unchanged; a document is
an id and a text: rows equal in both are one, so they do not repeat each other, and rows that repeat an id with other texts are
other documents; a passage repeated within one text is removed there too; paragraphs of under REACH words are compared with
nothing; ids are integers (other types are cast to long); other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from factorseg.llm import words
from factorseg.llm.linking import linked
from factorseg.operators.lineage import Scratch, cut_lineage

BANDS = 2
REACH = 8
MIN_WORDS = 20
NEWLINE = 10
SEEDS = words.mixed(np.arange(1, BANDS + 1, dtype=np.uint64) * words.BASE)


def _segments(data: np.ndarray, bounds: np.ndarray, starts: np.ndarray, row: np.ndarray, min_words: int) -> np.ndarray:
    """The first word of each segment: a line of ``min_words`` words, or a run of shorter lines of one text."""
    lines = np.searchsorted(np.flatnonzero(data == NEWLINE), starts)
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (lines[1:] != lines[:-1])])
    long = np.diff(np.append(first, len(starts))) >= min_words
    opens = np.r_[True, long[1:] | long[:-1] | (row[first[1:]] != row[first[:-1]])]
    return first[opens]


def _cuts(hashes: np.ndarray, segments: np.ndarray, reach: int) -> np.ndarray:
    """The first word of each paragraph: segment starts, and words whose pair with the next has a hash below those of the ``reach``
    words before it in the segment and at most those of the ``reach`` after it; none within ``reach`` words of its bounds."""
    n = len(hashes)
    size = np.diff(np.append(segments, n))
    following = np.append(hashes[1:], np.uint64(0))
    following[segments[1:] - 1] = 0  # a segment's last word has none, so cuts depend on the segment alone
    pair = words.mixed(hashes * np.uint64(5) + following)
    place = np.arange(n) - np.repeat(segments, size)
    at = np.flatnonzero((place >= reach) & (np.repeat(size, size) - place >= reach))
    for step in range(1, reach + 1):
        after = np.minimum(at + step, n - 1)
        inside = place[after] > place[at]
        at = at[(pair[at] < pair[at - step]) & ((pair[at] <= pair[after]) | ~inside)]
    return np.union1d(segments, at)


def _split(batch: pa.RecordBatch, reach: int, min_words: int):
    """Of all paragraphs of at least ``reach`` words: row, number in the text, first and last word; their texts' word hashes,
    and the places in the text where words start (bytes from the text's start; one more at each text's end)."""
    data, bounds = words.text_bytes(batch.column("text"))
    starts, ends, first = words.word_spans(data, bounds)
    hashes = words.span_hashes(data, starts, ends)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none, hashes, none, none
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    begin = _cuts(hashes, _segments(data, bounds, starts, row, min_words), reach)
    end = np.append(begin[1:], len(starts))
    of = row[begin]
    number = np.arange(len(begin)) - np.searchsorted(of, of)
    # a paragraph reaches to the next one's first word, the last to the text's end
    last = np.append(of[1:] != of[:-1], True)
    from_byte = starts[begin] - bounds[of]
    to_byte = np.where(last, bounds[of + 1], np.append(starts[begin[1:]], 0)) - bounds[of]
    keep = end - begin >= reach
    return of[keep], number[keep], begin[keep], end[keep], hashes, from_byte[keep], to_byte[keep]


def _compact(begin: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the ranges one after another, and their offsets."""
    size = end - begin
    offsets = np.concatenate([[0], np.cumsum(size)])
    return hashes[np.repeat(begin - offsets[:-1], size) + np.arange(offsets[-1])], offsets


def _names(own: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit and a 32-bit hash of each range's words in order."""
    weight = words.mixed(own + np.arange(len(own), dtype=np.uint64) - np.repeat(offsets[:-1], np.diff(offsets)).astype(np.uint64))
    again = np.add.reduceat(words.mixed(weight + words.BASE), offsets[:-1])
    return np.add.reduceat(weight, offsets[:-1]).view(np.int64), (again >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, document) of the rows with an id and a text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.filter("doc_id is not null and text is not null").withColumn("document", F.xxhash64("doc_id", "text"))


def repeated_passages(docs: DataFrame, k: int = 5, similarity: tuple[int, int] = (4, 5), min_words: int = MIN_WORDS,
                      reach: int = REACH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, document, paragraph, start, end, n_words, component, first_doc_id, kept, removed): every paragraph that repeats.

    ``document`` names the id and the text; ``start`` and ``end`` are bytes of the text; ``component`` names the group, of which the first
    occurrence alone is ``kept``; ``removed`` paragraphs lie in a passage of at least ``min_words`` words of which no word is kept.
    """
    with words.small_batches(docs.sparkSession):
        return _repeated(_documents(docs, id_col, text_col), k, similarity, min_words, reach)


def _repeated(rows: DataFrame, k: int, similarity: tuple[int, int], min_words: int, reach: int) -> DataFrame:
    bands = [f"band_{i}" for i in range(BANDS)]

    def scan(batches):
        for batch in batches:
            for part in words.pieces(batch, "text", 2_000_000):
                row, number, begin, end, hashes, from_byte, to_byte = _split(part, reach, min_words)
                if not len(row):
                    continue
                ids, document = part.column("doc_id").to_numpy()[row], part.column("document").to_numpy()[row]
                own, offsets = _compact(begin, end, hashes)
                values, limits = words.shingle_hashes(own, offsets, k)
                keys = [words.mixed(np.minimum.reduceat(words.mixed(values ^ seed), limits[:-1]) + np.uint64(band))
                        for band, seed in enumerate(SEEDS)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array(document), pa.array(number.astype(np.int32)), pa.array(from_byte.astype(np.int64)),
                     pa.array(to_byte.astype(np.int64)), pa.array((end - begin).astype(np.int32)),
                     *[pa.array(h) for h in _names(own, offsets)], *[pa.array(key.view(np.int64)) for key in keys]],
                    ["doc_id", "document", "paragraph", "start", "end", "n_words", "hash_a", "hash_b", *bands])
        words.release()

    schema = ("doc_id long, document long, paragraph int, start long, end long, n_words int, hash_a long, hash_b int, "
              + ", ".join(f"{b} long" for b in bands))
    scratch = Scratch(rows.sparkSession)
    found = scratch.cut(rows.mapInArrow(scan, schema))
    same = ["hash_a", "hash_b", "n_words"]
    # a paragraph's hash is its name among the links; equal paragraphs have equal bands
    texts = scratch.cut(found.groupBy(*same).agg(F.count("*").alias("copies"), *[F.min(b).alias(b) for b in bands]))
    size = F.greatest(F.col("n_words") - (k - 1), F.lit(1)).cast("long")
    groups = texts.select(F.col("hash_a").alias("leader"), size.alias("n"), "copies", F.array(*bands).alias("tokens"))
    members = texts.select(F.col("hash_a").alias("rep"), F.col("hash_a").alias("leader"))

    def full_sets(bitmap):
        def sets_of(batches):
            cells = np.frombuffer(bitmap.value, np.uint32)
            for batch in batches:
                for part in words.pieces(batch, "text", 2_000_000):
                    row, _, begin, end, hashes, _, _ = _split(part, reach, min_words)
                    if not len(row):
                        continue
                    name = _names(*_compact(begin, end, hashes))[0]
                    need = words.in_bitmap(pa.array(name), cells)
                    if need.any():
                        own, offsets = _compact(begin[need], end[need], hashes)
                        yield words.set_rows(pa.array(name[need]), *words.shingle_hashes(own, offsets, k))
            words.release()
        return rows.select("text").mapInArrow(sets_of, "id long, items array<long>")

    settled = linked(groups, members, full_sets, similarity, sized=False)
    named = texts.join(settled, texts.hash_a == settled.node, "left").filter("copies > 1 or component is not null or node is not null")
    linked_to = settled.select(F.col("component").alias("named")).distinct()  # least nodes are not among a component's rows
    heads_of = texts.join(linked_to, texts.hash_a == linked_to.named, "left_semi").select(*same, F.col("hash_a").alias("component"))
    repeated = scratch.cut(named.select(*same, F.coalesce("component", "hash_a").alias("component")).unionByName(heads_of).distinct())
    hits = scratch.cut(found.drop(*bands).join(repeated, same).distinct())
    heads = hits.groupBy("component").agg(F.min(F.struct("doc_id", "document", "paragraph")).alias("head"), F.count("*").alias("size"))
    hits = hits.join(heads.filter("size > 1").drop("size"), "component")
    hits = hits.withColumn("kept", F.struct("doc_id", "document", "paragraph") == F.col("head"))
    # passages: neighbours that go; a document's hits are a part of its own text
    order = W.partitionBy("doc_id", "document").orderBy("paragraph")
    new = F.col("kept") | F.lag("kept", 1, True).over(order) | (F.lag("end").over(order) < F.col("start"))
    hits = hits.withColumn("new", new).withColumn("passage", F.sum(F.col("new").cast("int")).over(order)).drop("new")
    whole = F.sum("n_words").over(W.partitionBy("doc_id", "document", "passage"))
    hits = hits.withColumn("removed", ~F.col("kept") & (whole >= min_words))
    out = scratch.cut(hits.select("doc_id", "document", "paragraph", "start", "end", F.col("n_words").cast("long").alias("n_words"), "component",
                                  F.col("head.doc_id").alias("first_doc_id"), "kept", "removed"))
    # of components of which nothing goes, nothing is said
    told = out.filter("removed").select("component").distinct()
    result = cut_lineage(out.join(told, "component", "left_semi").filter("kept or removed").select(
        "doc_id", "document", "paragraph", "start", "end", "n_words", "component", "first_doc_id", "kept", "removed"))
    scratch.drop()
    return result


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """The documents with all but the first occurrence of repeated passages cut out; texts left without words go.

    ``n_chars`` follows the text where that column exists.
    """
    spans = (repeated_passages(docs, **options).filter("removed").groupBy("doc_id", "document")
             .agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans")))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"),
                        F.col("text").cast("string").alias("text"))
    joined = whole.withColumn("name", F.xxhash64("id", "text")).join(
        spans, (F.col("id") == F.col("doc_id")) & (F.col("name") == F.col("document")), "left")
    raw = F.col("text").cast("binary")
    # what stays lies between the removed spans
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["end"]))
    starts = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.octet_length("text").cast("long")))
    parts = F.zip_with(ends, starts, lambda a, b: F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")).cast("string"))
    cut = joined.withColumn("left", F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.array_join(parts, "")))
    cut = cut.filter(F.col("spans").isNull() | F.col("left").rlike("[^\\x20\\x09-\\x0D]"))
    new = {"text": F.col("left")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("spans").isNull(), F.col("row.n_chars")).otherwise(F.length("left")).cast(docs.schema["n_chars"].dataType)
    return cut.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
