"""Toxicity by multiple-instance learning: sentences scored, joined by noisy-or, trained from document labels.

A document is a bag of sentences.  A sentence's probability is a logistic score of its distinct hashed
features (words, and their first bytes, so that word families share evidence); the document's is
``1 - prod(1 - p)``.  Only documents carry labels: the gradient of the document loss flows through
the noisy-or to the sentences that can explain the label, so the same model then points at the
offending sentences.

The fit sees a bounded sample of ``TRAIN_DOCS`` labelled documents (whole texts, all positives kept
in preference up to half of it) and yields ``FEATURES`` weights, 8 MB whatever the input size and nearly all 0; scoring
is one pass over all texts.

Edge cases: null and empty texts have no sentence; their score is the model's score of a sentence
without features.  Sentences end at . ! ? and line ends.  Rows of labels whose label is null, and
repeated rows that disagree, are left out of the fit.  Without positive or negative labels the
model is the constant 0.  Other columns are passed over.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protolens.llm import kernel as K
from protolens.llm.common import prepare, texts, written

BITS = 21
FEATURES = 1 << BITS
#: bound of the training sample, in documents
TRAIN_DOCS = 8000
ROUNDS = 300
#: features that get a weight at most, documents that must hold one, and its least chi-square (chance in some 1e6 features)
CHOSEN, SEEN, WORTH = 4096, 4, 24.0
THRESHOLD = 0.7
#: words are runs of letters, digits and bytes over 127 (lower-cased A-Z)
WORD = np.zeros(256, dtype=bool)
WORD[list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True
STOP = np.zeros(256, dtype=bool)
STOP[[0x0A, 0x0D, 0x21, 0x2E, 0x3F]] = True
PREFIXES = (4, 5, 6)


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, sentence of the feature, first sentence of each document) of a run of documents.

    Every document has at least one sentence; sentences are numbered through the run."""
    low = K.LOWER[buf]
    s, e, first = K.spans(low, offs, WORD)
    ends = np.flatnonzero(STOP[buf])
    doc_first = np.searchsorted(ends, offs[:-1]) + np.arange(len(offs) - 1)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    sentence = np.searchsorted(ends, s) + doc
    parts, where = [K.hash_spans(low, s, e, seed=11)], [sentence]
    for n in PREFIXES:
        long = np.flatnonzero(e - s > n)
        parts.append(K.hash_spans(low, s[long], s[long] + n, seed=20 + n))
        where.append(sentence[long])
    f = (np.concatenate(parts) >> K.U64(64 - BITS)).astype(np.int64)
    n_sentences = len(ends) + len(offs) - 1
    return f, np.concatenate(where), np.append(doc_first, n_sentences)


def sentence_logits(weights: np.ndarray, f: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
    return weights[-1] + np.bincount(sentence, weights=weights[f], minlength=n)


def noisy_or(z: np.ndarray, first: np.ndarray) -> np.ndarray:
    """1 - prod(1 - sigmoid(z)) over the sentences of each document, by sums of logs."""
    keep = np.concatenate([[0.0], np.cumsum(np.logaddexp(0.0, z))])  # -log(1 - p)
    return -np.expm1(-(keep[first[1:]] - keep[first[:-1]]))


def _counts(batches):
    """(feature, documents with label 0, with label 1) of a batch of (text, y)."""
    for b in batches:
        y = np.asarray(b.column(1)).astype(np.int64)
        buf, offs = K.string_buffers(b.column(0))
        for lo, hi, part, o in K.chunks(buf, offs):
            f, s, first = features(part, o)
            doc = np.repeat(np.arange(hi - lo), np.diff(first))[s]
            once = np.unique(doc * np.int64(FEATURES) + f)
            own, f = y[lo:hi][once // FEATURES], once % FEATURES
            name, back = np.unique(f, return_inverse=True)
            n = np.bincount(back * 2 + own, minlength=2 * len(name)).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(n[:, 0]), pa.array(n[:, 1])], ["f", "n0", "n1"])


def _bags(chosen: np.ndarray):
    """Per document: label, sentences without a chosen feature, and (sentence, feature) of the others."""

    def run(batches):
        for b in batches:
            buf, offs = K.string_buffers(b.column(0))
            for lo, hi, part, o in K.chunks(buf, offs):
                f, s, first = features(part, o)
                at = np.minimum(np.searchsorted(chosen, f), max(len(chosen) - 1, 0))
                use = chosen[at] == f if len(chosen) else np.zeros(len(f), bool)
                key = np.unique(s[use] * np.int64(max(len(chosen), 1)) + at[use])  # a feature counts once a sentence
                s, f = key // max(len(chosen), 1), key % max(len(chosen), 1)
                cut = np.searchsorted(s, first)
                rows = [(s[i:j] - first[k], f[i:j]) for k, (i, j) in enumerate(zip(cut[:-1], cut[1:]))]
                plain = [int(n) - len(np.unique(r[0])) for n, r in zip(np.diff(first), rows)]
                yield pa.RecordBatch.from_arrays([b.column(1).slice(lo, hi - lo), pa.array(plain, pa.int64()),
                                                  pa.array([r[0].astype(np.int32).tobytes() for r in rows], pa.binary()),
                                                  pa.array([r[1].astype(np.int32).tobytes() for r in rows], pa.binary())], ["y", "plain", "sentence", "feature"])

    return run


def fit(bags: pa.Table, chosen: np.ndarray, rounds: int = ROUNDS, rate: float = 0.5, penalty: float = 1e-6) -> np.ndarray:
    """Weights (the last one is the bias) by full-batch AdaGrad on the document log loss."""
    y = np.asarray(bags.column("y").combine_chunks()).astype(bool) if len(bags) else np.zeros(0, bool)
    weights = np.zeros(FEATURES + 1)
    if not y.any() or y.all():
        weights[-1] = -50.0
        return weights
    plain = np.asarray(bags.column("plain").combine_chunks()).astype(float)
    ss, ff, dd, n = [], [], [], 0
    for k, (s, f) in enumerate(zip(bags.column("sentence").to_pylist(), bags.column("feature").to_pylist())):
        name, s = np.unique(np.frombuffer(s, np.int32), return_inverse=True)
        ss.append(s + n)
        ff.append(np.frombuffer(f, np.int32))
        dd.append(np.full(len(name), k))
        n += len(name)
    s, f, doc = np.concatenate(ss), np.concatenate(ff), np.concatenate(dd)
    own = np.zeros(len(chosen) + 1)
    own[-1] = -6.0
    seen = np.full(len(own), 1e-10)
    balance = np.where(y, 0.2 / y.sum(), 0.8 / (~y).sum())  # a clean document flagged costs more
    for _ in range(rounds):
        z = sentence_logits(own, f, s, n)
        none = -np.logaddexp(0.0, own[-1]) * plain - np.bincount(doc, weights=np.logaddexp(0.0, z), minlength=len(y))
        big = np.clip(-np.expm1(none), 1e-9, 1 - 1e-12)
        # d loss / d z of a sentence: p in a negative document, -(1 - P) / P * p in a positive one
        share = balance * np.where(y, -(1 - big) / big, 1.0)
        g = share[doc] / (1.0 + np.exp(-np.clip(z, -40, 40)))
        grad = np.empty(len(own))
        grad[:-1] = np.bincount(f, weights=g[s], minlength=len(chosen)) + penalty * own[:-1]
        grad[-1] = g.sum() + (share * plain).sum() / (1.0 + np.exp(-own[-1]))
        seen += grad * grad
        own -= rate * grad / np.sqrt(seen)
    weights[chosen], weights[-1] = own[:-1], own[-1]
    return weights


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", most: int = TRAIN_DOCS) -> DataFrame:
    """(text, y) of at most ``most`` labelled documents of the training folds, positives first up to half.

    Drawn by the hash order of doc_id.  Folds: crc32(doc_id as text) mod 3 other than 1."""
    marks = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
             .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
             .where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
             .groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top"))
    marks = marks.join(texts(docs).select("doc_id").distinct(), "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = (marks.where("y = 1").orderBy(*order).limit(most // 2)
              .unionByName(marks.where("y = 0").orderBy(*order).limit(most // 2)).select("doc_id", "y"))
    chosen = written(chosen, "toxic-ids")
    # at most ``most`` ids: a proven bound for the broadcast; a repeated doc_id gives its first text
    found = texts(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    return written(found.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "y"), "toxic-sample")


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic") -> np.ndarray:
    """Features are chosen by chi-square of their document frequencies; only those and the bags of the sample reach the driver."""
    prepare(docs.sparkSession)
    rows = training_rows(docs, labels, label_col)
    total = rows.agg(F.sum(F.lit(1) - F.col("y")).alias("n0"), F.sum("y").alias("n1")).first()
    if not total["n0"] or not total["n1"]:
        return fit(pa.table({"y": pa.array([], pa.int32())}), np.zeros(0, np.int64)).astype(np.float32)
    both, share = F.col("n0") + F.col("n1"), total["n1"] / (total["n0"] + total["n1"])
    worth = F.pow(F.col("n1") - both * share, 2) / (both * share) + F.pow(F.col("n0") - both * (1 - share), 2) / (both * (1 - share))
    top = (rows.select("text", "y").mapInArrow(_counts, "f long, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
           .where(both >= SEEN).withColumn("worth", worth).where(F.col("worth") >= WORTH).orderBy(F.desc("worth"), "f").limit(CHOSEN).select("f").collect())
    chosen = np.sort(np.array([r["f"] for r in top], dtype=np.int64))
    bags = rows.select("text", "y", "doc_id").mapInArrow(_bags(chosen), "y int, plain long, sentence binary, feature binary")
    return fit(bags.toArrow(), chosen).astype(np.float32)


def scorer(weights: np.ndarray):
    """Function from an Arrow text column to document scores."""

    def run(text: pa.Array) -> np.ndarray:
        buf, offs = K.string_buffers(text)
        out = np.zeros(len(offs) - 1)
        for lo, hi, part, o in K.chunks(buf, offs):
            f, s, first = features(part, o)
            heavy = np.flatnonzero(np.abs(weights[f]) > 1e-3)  # the rest moves no score
            key = np.unique(s[heavy] * np.int64(FEATURES) + f[heavy])
            z = sentence_logits(weights, key % FEATURES, key // FEATURES, int(first[-1]))
            out[lo:hi] = noisy_or(z, first)
        return out

    return run


def score(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        of = scorer(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(of(b.column(1)), pa.float64())], ["doc_id", "score"])

    out = texts(docs).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"),
                      "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, weights: np.ndarray, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents scored below ``threshold``, all columns unchanged."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    at = docs.columns.index(text_col)

    def run(batches):
        of = scorer(shared.value)
        for b in batches:
            yield b.filter(pa.array(of(b.column(at)) < threshold))

    return docs.mapInArrow(run, docs.schema)


def offending(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, sentence number, score of every sentence scored at least ``threshold`` on its own."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = shared.value
        for b in batches:
            buf, offs = K.string_buffers(b.column(1))
            ids = b.column(0)
            for lo, _, part, o in K.chunks(buf, offs):
                f, s, first = features(part, o)
                key = np.unique(s * np.int64(FEATURES) + f)
                p = 1.0 / (1.0 + np.exp(-np.clip(sentence_logits(w, key % FEATURES, key // FEATURES, int(first[-1])), -40, 40)))
                hit = np.flatnonzero(p >= threshold)
                doc = np.searchsorted(first, hit, side="right") - 1
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc + lo)), pa.array(hit - first[doc]), pa.array(p[hit])], ["doc_id", "sentence", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, sentence long, score double")
