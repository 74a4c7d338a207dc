"""Token counts by a map-side two-tier lookup.

A text is cut into pre-tokens (a run of spaces and the word after it), which
the tokenizer model never merges across.  Tier one is a compact broadcast table
from the hashes of frequent pre-tokens to their token counts, of at most
``TABLE_SIZE`` entries, filled from a bounded sample; tier two is a cache in
each Python worker that tokenizes unknown pre-tokens once.  No pre-token is
shuffled, and the sample decides only speed, never a count.

Edge cases: null and empty texts have 0 bytes and 0 tokens; a text that holds
U+2581 (the model's own space mark) or NUL is tokenized whole by the library.
Repeated rows are counted row by row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protolens.llm import kernel as K
from protolens.llm.common import prepare, texts
from protolens.llm.piece_cache import PieceCache

#: entries of the broadcast table: 10 bytes each, so 640 kB at most
TABLE_SIZE = 1 << 16
#: documents of the sample that fills it (an upper bound in expectation)
SAMPLE_DOCS = 4000
SCHEMA = "doc_id long, n_bytes long, n_tokens long"

_LIBRARY: dict[str, object] = {}
_CACHE: dict[str, PieceCache] = {}


def _processor(path: str):
    if path not in _LIBRARY:
        import sentencepiece

        _LIBRARY[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _LIBRARY[path]


def piece_counts(path: str, pieces: list[bytes]) -> list[int]:
    """Tokens of pre-tokens that begin with a space: the model's own leading space stands for it."""
    got = _processor(path).encode([p[1:].decode("utf-8", "replace") for p in pieces], num_threads=1)
    return [len(g) if len(p) > 1 else 1 for g, p in zip(got, pieces)]


def _space_led(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buffers of the texts with one space put before each."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    return K.string_buffers(pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), col, pa.scalar("", pa.large_string())))


def _cuts(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pre-tokens: from each space that follows a non-space (or starts a document) to the next such."""
    space = buf == 0x20
    head = space.copy()
    head[1:] &= ~space[:-1]
    head[offs[:-1]] = True
    starts = np.flatnonzero(head)
    return starts, np.append(starts[1:], len(buf)), np.searchsorted(starts, offs)


def _odd(col: pa.Array) -> np.ndarray:
    """Texts the library takes whole."""
    found = pc.match_substring_regex(col.cast(pa.large_string()), "▁|\x00")
    return np.asarray(pc.fill_null(found, False))


def frequent_pieces(docs: DataFrame, model: str, size: int = TABLE_SIZE, sample_docs: int = SAMPLE_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the most frequent pre-tokens of about ``sample_docs`` documents."""
    n = docs.count()
    share = 1.0 if n <= sample_docs else sample_docs / n

    def run(batches):
        from collections import Counter

        for b in batches:
            buf, offs = _space_led(b.column(0))
            seen: Counter = Counter()
            for _, _, part, o in K.chunks(buf, offs):
                s, e, _ = _cuts(part, o)
                raw = part.tobytes()
                seen.update(raw[x:y] for x, y in zip(s.tolist(), e.tolist()) if y - x <= 64)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["piece", "n"])

    def counted(batches):
        for b in batches:
            pieces = b.column(0).to_pylist()
            raw = np.frombuffer(b"".join(pieces), np.uint8)
            ends = np.cumsum([len(p) for p in pieces]).astype(np.int64)
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
            h = K.hash_spans(raw, starts, ends, seed=7)
            yield pa.RecordBatch.from_arrays([pa.array(K.signed(h)), pa.array(piece_counts(model, pieces), pa.int32())], ["h", "k"])

    sample = docs.select("text").where(F.col("text").isNotNull() & (F.rand(11) < F.lit(share)))
    top = (sample.mapInArrow(run, "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "piece").limit(size).select("piece").mapInArrow(counted, "h long, k int"))
    got = top.toArrow()  # at most ``size`` rows of 12 bytes
    return np.asarray(got.column("h").combine_chunks()).view(np.uint64).copy(), np.asarray(got.column("k").combine_chunks()).astype(np.int32)


def count_tokens(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    spark = docs.sparkSession
    prepare(spark)
    rows = texts(docs)
    keys, counts = frequent_pieces(rows, model)
    shared = spark.sparkContext.broadcast((keys, counts))

    def run(batches):
        own = f"{model}:{len(shared.value[0])}:{shared.id if hasattr(shared, 'id') else ''}"
        keys, counts = shared.value
        first = K.HashPool()
        first.add(keys, np.arange(len(keys), dtype=np.int32))
        if own not in _CACHE:
            _CACHE.clear()
            _CACHE[own] = PieceCache(lambda pieces: piece_counts(model, pieces), keep_ids=False)
        cache = _CACHE[own]
        for b in batches:
            text = b.column(1)
            buf, offs = _space_led(text)
            size = np.diff(offs) - 1
            total = np.zeros(len(size), np.int64)
            for lo, hi, part, o in K.chunks(buf, offs):
                s, e, f = _cuts(part, o)
                row = first.find(K.hash_spans(part, s, e, seed=7))
                n = np.where(row >= 0, counts[row] if len(counts) else 0, 0)
                miss = np.flatnonzero(row < 0)
                if len(miss):
                    got = cache.rows(part, s[miss], e[miss])
                    n[miss] = cache.length[got]
                add = np.concatenate([[0], np.cumsum(n)])
                total[lo:hi] = add[f[1:]] - add[f[:-1]]
            total[size == 0] = 0
            odd = np.flatnonzero(_odd(text))
            for k in odd:
                total[k] = len(_processor(model).encode(text[int(k)].as_py()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(total)], ["doc_id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(run, SCHEMA).withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
