"""Language identification with a bit-sliced Bloom filter of n-grams.

One filter holds all languages.  Its rows are a power of two, at least ``ROWS`` and ``ROWS_EACH`` for every n-gram that
the fullest language may have, so that at most about a fifth of a language's bits are set (``fill``), up to ``ROWS_MOST``
(beyond, bits fill up and the correction below weighs what is left).  A row is a bit mask with one bit a language, and an
n-gram's mask is the AND of its ``HASHES`` rows, so one look-up returns every language that has the
n-gram.  A document's evidence for a language is the popcount of its bit over the document's n-grams,
corrected for the bit's false positive rate ``fill ** HASHES``; the largest decides.

n-grams are windows of ``N`` bytes of the text with A-Z lower-cased and every run of bytes that are
neither letters nor over 127 read as one blank.  An n-gram belongs to a language when it was seen there
``MIN_COUNT`` times or more, at ``SHARE`` or more of the largest rate that any language shows.  Counts come
from all training documents (partial counts in the tasks, one sum by n-gram); only filter rows reach
the driver, ``ROWS_MOST`` for each 64 languages at most whatever the input.

Edge cases: text null or without a letter is ``und`` with score 0; a text whose n-grams no language
knows gets the language with most training documents; no training rows at all give ``und``; rows with a
null doc_id or lang teach nothing (a null doc_id counts as held out); repeated rows are predicted each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from protolens.llm import kernel as K
from protolens.llm.common import prepare

N = 4
ROWS, ROWS_EACH, ROWS_MOST = 1 << 20, 8, 1 << 24
HASHES = 2
MIN_COUNT = 3
SHARE = 0.2
#: blanks: all bytes that are neither ASCII letters nor parts of wider characters
_FOLD = K.LOWER.copy()
_FOLD[[b for b in range(128) if not (65 <= b <= 90 or 97 <= b <= 122)]] = 0x20
_ASCII = np.zeros(256, dtype=bool)
_ASCII[list(range(65, 91)) + list(range(97, 123))] = True


def grams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams as 32-bit numbers, index of each document's first n-gram) of a run of documents."""
    low = _FOLD[buf]
    blank = low == 0x20
    keep = np.ones(len(low), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])  # a run of blanks is one
    first = offs[:-1][np.diff(offs) > 0]
    keep[first] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    low, offs = low[keep], kept[offs]
    if len(low) < N:
        return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
    every = np.ndarray((len(low) - N + 1,), dtype="<u4", buffer=np.ascontiguousarray(low), strides=(1,))
    use = np.ones(len(every), bool)
    for k in range(1, N):  # no n-gram crosses documents
        cut = offs[1:-1] - k
        use[cut[(cut >= 0) & (cut < len(every))]] = False
    return every[use], np.concatenate([[0], np.cumsum(use)])[np.minimum(offs, len(every))]


def rows_for(grams: int) -> int:
    """Filter rows where the fullest language has so many n-grams."""
    return min(ROWS_MOST, max(ROWS, 1 << max(0, ROWS_EACH * grams - 1).bit_length()))


def slots(g: np.ndarray, rows: int = ROWS) -> list[np.ndarray]:
    h = K.mix(g.astype(np.uint64))
    return [((h >> K.U64(24 * k)) & K.U64(rows - 1)).astype(np.int64) for k in range(HASHES)]


class LanguageFilter:
    """languages, their prior order and the filter rows as 64-bit words (one word for each 64 languages)."""

    def __init__(self, languages: list[str], words: np.ndarray, default: int):
        self.languages, self.words, self.default = languages, words, default
        self.fill = np.array([float(((words[k // 64] >> K.U64(k % 64)) & K.U64(1)).mean()) for k in range(len(languages))])
        if len(languages) <= 8:
            self.words = words.astype(np.uint8)  # the table then stays in a core's cache

    def evidence(self, g: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Corrected popcounts, documents x languages."""
        n = np.diff(first)
        at = slots(g, self.words.shape[1])
        out = np.zeros((len(n), len(self.languages)))
        for w in range(len(self.words)):
            mask = self.words[w][at[0]]
            for more in at[1:]:
                mask &= self.words[w][more]
            if mask.dtype == np.uint8:  # popcounts of all languages from one histogram of masks
                doc = np.repeat(np.arange(len(n)), n)
                hist = np.bincount(doc * 256 + mask, minlength=256 * len(n)).reshape(len(n), 256)
                bits = (np.arange(256)[:, None] >> np.arange(len(self.languages))) & 1
                out = (hist @ bits).astype(float)
            else:
                for k in range(64 * w, min(64 * w + 64, len(self.languages))):
                    add = np.concatenate([[0], np.cumsum((mask >> K.U64(k % 64)) & K.U64(1), dtype=np.int64)])
                    out[:, k] = add[first[1:]] - add[first[:-1]]
        wrong = self.fill ** HASHES
        return np.maximum((out - n[:, None] * wrong) / np.maximum(1.0 - wrong, 1e-9), 0.0)

    def predict(self, text: pa.Array) -> tuple[list[str], np.ndarray]:
        buf, offs = K.string_buffers(text)
        names: list[str] = []
        score = np.zeros(len(offs) - 1)
        for lo, hi, part, o in K.chunks(buf, offs):
            letters = np.concatenate([[0], np.cumsum(_ASCII[part])])[o]
            wide = np.concatenate([[0], np.cumsum(part >= 0x80)])[o]
            g, first = grams(part, o)
            seen = self.evidence(g, first) if self.languages else np.zeros((hi - lo, 0))
            for k in range(hi - lo):
                known = letters[k + 1] > letters[k] or wide[k + 1] > wide[k] and any(c.isalpha() for c in text[lo + k].as_py())
                if not known or not self.languages:
                    names.append("und")
                    continue
                row = seen[k]
                best = int(np.argmax(row)) if row.any() else self.default
                rest = float(np.delete(row, best).max()) if len(row) > 1 else 0.0
                names.append(self.languages[best])
                score[lo + k] = row[best] / (row[best] + rest) if row[best] > 0 else 1.0 / len(row)
        return names, score


def learn(docs: DataFrame) -> LanguageFilter:
    """Filter from the (text, lang) rows of ``docs``; null langs and texts teach nothing."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")

    def count(batches):
        held: dict[str, list] = {}

        def fold(name: str) -> None:
            g = np.concatenate([x[0] for x in held[name]])
            n = np.concatenate([x[1] for x in held[name]])
            u, back = np.unique(g, return_inverse=True)
            held[name] = [(u, np.bincount(back, weights=n).astype(np.int64))]

        docs_seen: dict[str, int] = {}
        for b in batches:
            lang = np.array(b.column(1).to_pylist(), dtype=object)
            for name in sorted(set(lang)):
                own = b.column(0).filter(pa.array(lang == name))
                docs_seen[name] = docs_seen.get(name, 0) + len(own)
                buf, offs = K.string_buffers(own)
                for _, _, part, o in K.chunks(buf, offs):
                    g, _ = grams(part, o)
                    g.sort()
                    at = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
                    held.setdefault(name, []).append((g[at], np.diff(np.append(at, len(g)))))
                    if len(held[name]) >= 16:
                        fold(name)
        for name in docs_seen:
            if held.get(name):
                fold(name)
                g, n = held[name][0]
            else:
                g, n = np.zeros(0, np.uint32), np.zeros(0, np.int64)
            g, n = np.append(g.astype(np.int64), -1), np.append(n, docs_seen[name])  # gram -1 counts documents
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g), pa.array(n)], ["lang", "gram", "n"])

    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    counts.persist()
    try:
        totals = counts.groupBy("lang").agg(F.sum(F.when(F.col("gram") >= 0, F.col("n"))).alias("grams"), F.sum(F.when(F.col("gram") < 0, F.col("n"))).alias("docs"),
                                              F.count_if((F.col("gram") >= 0) & (F.col("n") >= MIN_COUNT)).alias("often")).collect()
        size = rows_for(max((r["often"] for r in totals), default=0))
        totals = sorted((r["lang"], max(r["grams"] or 0, 1), r["docs"]) for r in totals)  # one row a language
        languages = [t[0] for t in totals]
        if not languages:
            return LanguageFilter([], np.zeros((1, size), np.uint64), 0)
        info = spark.createDataFrame([(t[0], k, float(t[1])) for k, t in enumerate(totals)], "lang string, bit int, total double")
        rate = (counts.where("gram >= 0").join(F.broadcast(info), "lang").withColumn("rate", F.col("n") / F.col("total"))
                .withColumn("top", F.max("rate").over(Window.partitionBy("gram")))  # one row a language in each group
                .where((F.col("n") >= MIN_COUNT) & (F.col("rate") >= SHARE * F.col("top"))))

        def place(batches):
            for b in batches:
                g, bit = np.asarray(b.column(0)).astype(np.uint32), np.asarray(b.column(1))
                at = np.concatenate(slots(g, size))
                many = np.tile(bit, HASHES)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array((many // 64).astype(np.int32)), pa.array(np.left_shift(np.int64(1), (many % 64).astype(np.int64)))], ["slot", "word", "mask"])

        placed = (rate.select("gram", "bit").mapInArrow(place, "slot long, word int, mask long")
                  .groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toArrow())  # at most ROWS_MOST rows a word
    finally:
        counts.unpersist()
    words = np.zeros((-(-len(languages) // 64), size), np.uint64)
    words[np.asarray(placed.column("word")), np.asarray(placed.column("slot"))] = np.asarray(placed.column("mask").combine_chunks()).view(np.uint64)
    return LanguageFilter(languages, words, int(np.argmax([t[2] for t in totals])))


def identify(docs: DataFrame, filter_: LanguageFilter) -> DataFrame:
    """doc_id, lang_pred, score of every document."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(filter_)

    def run(batches):
        for b in batches:
            names, score = shared.value.predict(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def predict_languages(docs: DataFrame) -> DataFrame:
    """Learn from the training folds (crc32(doc_id as text) mod 5 other than 0) and predict every document."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    found = identify(docs, learn(docs.where(fold != 0)))
    return found.select("doc_id", F.coalesce(fold == 0, F.lit(True)).alias("held_out"), "lang_pred", "score")
