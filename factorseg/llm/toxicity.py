"""Toxicity by compression distance: windows compress shorter with a dictionary of toxic text than without.

1. Labelled training rows are sampled (``SAMPLE_ROWS`` a class and purpose), half of them for the dictionaries and half
   for the calibration. Their whole texts are read where they lie; the driver gets stretches spread over each text
   (``SAMPLE_BYTES`` a class), the toxic words and one row of features for each calibration text.
2. zstandard trains an ordinary and a toxic dictionary, each on such stretches of its class. All compressors get
   the ordinary dictionary and the toxic one also the toxic dictionary, so chance matches with ordinary text cancel and the
   difference of two lengths is what toxic text saves. A trained dictionary follows the frequent text of its class more than
   its rare words, so a third compressor has a list of toxic words instead: words with at least one distinct word before
   them for every RARE toxic texts (copies of a text bring no new ones), and RATIO times as many a text as in ordinary texts.
3. Every whole text is cut into windows of WINDOW bytes; a logistic curve over both savings (mean, share above 1 byte,
   share above 3, largest) and the text's number of windows is fitted on the whole calibration texts, weighted to the
   classes' true shares.
4. All documents are scored where they lie; nothing but the model (a few kB) is sent.

Defined results: null and empty texts have no savings and get the curve's value for that; labels that are null are not used;
repeated labels of one id count once each; a training set without both classes gives every text the toxic share
(0 without labels); rows without an id are scored, too; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from factorseg.llm.words import release

SAMPLE_ROWS = 4000
SAMPLE_BYTES = 8_000_000
WINDOW = 48
RARE, RATIO = 100, 50
STRETCH = 5 * WINDOW
ORDINARY_SIZE, TOXIC_SIZE, WORDS_SIZE = 32768, 32768, 4096
LEAST_TEXT, LEAST_SAMPLES = 8192, 32  # zstandard trains on no less


def training_part(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 4: 2 is held out, 3 calibrates, 0 and 1 fill the dictionaries."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)).cast("int")


def _windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    flat = b" ".join((text or "").encode().lower().split())
    return [flat[i:i + size] for i in range(0, max(1, len(flat)), size)]


class Compressors:
    """The compressors made from the dictionaries' contents: ordinary, toxic and toxic words."""

    def __init__(self, ordinary: bytes, toxic: bytes, words: bytes):
        import zstandard
        parameters = zstandard.ZstdCompressionParameters(
            window_log=17, hash_log=15, chain_log=15, search_log=4, min_match=4, target_length=16,
            strategy=zstandard.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0)
        self.all = []
        for content in (ordinary, toxic + ordinary, words + ordinary):
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=parameters)
            self.all.append(zstandard.ZstdCompressor(compression_params=parameters, dict_data=held))

    def features(self, text: str | None) -> list[float]:
        windows = _windows(text)
        plain, *others = ([len(c.compress(w)) for w in windows] for c in self.all)
        out = [1.0, np.log(len(windows)) / 4]
        for other in others:
            saved = np.array(plain) - np.array(other)
            n = len(saved)
            out += [np.log1p(10 * np.maximum(saved, 0).sum() / n), np.log1p(50 * (saved > 1).sum() / n),
                    np.log1p(50 * (saved > 3).sum() / n), min(float(saved.max()), 8.0) / 4]
        return out


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """The model: the dictionaries' contents, weights of the curve and the toxic share."""
    ids = docs.select("doc_id").distinct()
    marked = labels.filter("toxic in (0, 1)").select("doc_id", "toxic", training_part().alias("part")).filter("part <> 2").join(ids, "doc_id")
    counts = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    order = F.xxhash64("doc_id")
    groups = [(toxic, fit, marked.filter((F.col("toxic") == toxic) & ((F.col("part") < 3) == F.lit(fit))).orderBy(order, "doc_id")
               .limit(SAMPLE_ROWS)) for toxic in (0, 1) for fit in (True, False)]
    chosen = [(r["doc_id"], toxic, fit) for toxic, fit, g in groups for r in g.collect()]
    model = {"ordinary": b"", "toxic": b"", "words": b"", "weights": None, "share": share}
    if not chosen:
        return model
    # at most 4 * SAMPLE_ROWS ids, so their side is small enough to go to every task
    picked = docs.sparkSession.createDataFrame(chosen, "doc_id long, toxic int, fit boolean")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    count = {(r["toxic"], r["fit"]): r["n"] for r in texts.groupBy("toxic", "fit").agg(F.count("*").alias("n")).collect()}
    if len(count) < 4:
        return model
    fitting = texts.filter("fit").select("toxic", "text")
    each = [max(1, SAMPLE_BYTES // STRETCH // count[toxic, True]) for toxic in (0, 1)]
    samples = {0: [], 1: []}
    for r in _stretches(fitting, each).toArrow().to_pylist():
        samples[r["toxic"]].append(r["stretch"])
    frequent = _toxic_words(fitting, count[0, True], count[1, True])
    model |= _dictionaries(samples[0], samples[1], frequent)
    truth, rows = _calibration(texts.filter("not fit").select("toxic", "text"), model)
    weight = np.where(truth == 1, share / count[1, False], (1 - share) / count[0, False]) * len(truth)
    model["weights"] = _logistic(rows, truth, weight)
    return model


def _trained(samples: list[bytes], size: int, **options) -> bytes:
    """A dictionary trained by zstandard, of up to an eighth of the distinct samples' bytes; samples that are fewer than
    LEAST_SAMPLES or shorter than LEAST_TEXT are their own dictionary."""
    import zstandard
    samples = sorted(set(samples))
    total = sum(map(len, samples))
    if len(samples) < LEAST_SAMPLES or total < LEAST_TEXT:
        return b" ".join(samples)[-size:]
    return zstandard.train_dictionary(min(size, total // 8), samples, level=3, **options).as_bytes()


def _dictionaries(ordinary: list[bytes], toxic: list[bytes], frequent: list[bytes]) -> dict:
    """The three dictionaries' contents from stretches of both classes and the toxic words, the most frequent last."""
    plain = [s[i:i + WINDOW] for s in ordinary for i in range(0, len(s), WINDOW)]
    return {"ordinary": _trained(plain, ORDINARY_SIZE), "toxic": _trained(toxic, TOXIC_SIZE, k=64, d=8),
            "words": b" " + b" ".join(frequent)[-WORDS_SIZE:] + b" "}


def _stretches(texts: DataFrame, each: list[int]) -> DataFrame:
    """(toxic, stretch): of every text its stretches of STRETCH bytes, or each[toxic] of them spread over all its length."""
    def cut(batches):
        for batch in batches:
            toxic, out = [], []
            for t, text in zip(batch.column("toxic").to_pylist(), batch.column("text")):
                found = _windows(text.as_py(), STRETCH)
                m, n = len(found), min(len(found), each[t])
                out += [found[(2 * j + 1) * m // (2 * n)] for j in range(n)]
                toxic += [t] * n
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(out, pa.binary())], ["toxic", "stretch"])

    return texts.mapInArrow(cut, "toxic int, stretch binary")


def _toxic_words(texts: DataFrame, ordinary: int, toxic: int) -> list[bytes]:
    """The words of WORDS_SIZE bytes with the most distinct words before them in toxic texts, the most frequent last."""
    def pairs(batches):
        for batch in batches:
            for t, text in zip(batch.column("toxic").to_pylist(), batch.column("text")):
                w = (text.as_py() or "").encode().lower().split()
                found = list(set(zip([b"", *w], w)))
                yield pa.RecordBatch.from_arrays([pa.array([t] * len(found), pa.int32()), *(
                    pa.array([f[i] for f in found], pa.binary()) for i in (0, 1))], ["toxic", "before", "word"])

    seen = texts.mapInArrow(pairs, "toxic int, before binary, word binary").distinct()
    counted = seen.groupBy("word").agg(*(F.count_if(F.col("toxic") == t).alias(f"n{t}") for t in (0, 1)))
    rare = counted.filter((F.col("n1") >= max(2.0, toxic / RARE)) & (F.col("n1") * ordinary >= RATIO * F.col("n0") * toxic))
    return [bytes(r["word"]) for r in rare.orderBy(F.desc("n1"), F.desc("word")).limit(WORDS_SIZE).collect()][::-1]


def _calibration(texts: DataFrame, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Classes and features of whole texts, taken where they lie."""
    def measured(batches):
        made = Compressors(model["ordinary"], model["toxic"], model["words"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([made.features(t.as_py()) for t in batch.column("text")], pa.list_(pa.float64()))],
                                             ["toxic", "features"])

    found = sorted((r["toxic"], r["features"]) for r in texts.mapInArrow(measured, "toxic int, features array<double>").toArrow().to_pylist())
    return np.array([t for t, _ in found], float), np.array([f for _, f in found])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    ridge = 1e-2 * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge,
                               x.T @ (weight * (y - p)) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def scored(docs: DataFrame, model: dict, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def score(batches):
        made = Compressors(model["ordinary"], model["toxic"], model["words"])
        weights = model["weights"]
        for batch in batches:
            if weights is None:
                found = np.full(batch.num_rows, model["share"])
            else:
                found = np.array([1 / (1 + np.exp(-np.clip(np.dot(made.features(t.as_py()), weights), -30, 30)))
                                  for t in batch.column("text")], float)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    out = rows.mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(training_part() == 2, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that the model does not reject; all columns and repeated rows stay as they are."""
    model = train(docs, labels)

    def keep(batches):
        made = Compressors(model["ordinary"], model["toxic"], model["words"])
        weights = model["weights"]
        for batch in batches:
            if weights is not None:
                value = [np.dot(made.features(t.as_py()), weights) for t in batch.column("text")]
                batch = batch.filter(pa.array(1 / (1 + np.exp(-np.clip(np.array(value, float), -30, 30))) < threshold, pa.bool_()))
            yield batch
        release()

    return docs.mapInArrow(keep, docs.schema)
