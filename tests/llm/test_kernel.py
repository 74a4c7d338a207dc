"""Text kernels against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa

from protolens.llm import kernel as K

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def docs():
    r = random.Random(1)
    pool = ["abc", "de", "ünï", "ijklmnopqrst", "uvwxyz0123456789abcdef", "x" * 700]
    return ["", "a b  c\n", None, " lead", "z"] + [" ".join(r.choice(pool) for _ in range(80)) for _ in range(12)]


def test_words_hashes_and_windows_depend_on_content_only():
    texts = docs()
    buf, offs = K.string_buffers(pa.array(texts))
    words, windows = {}, {}
    for limit in (64, 1 << 20):
        for lo, hi, part, o in K.chunks(buf, offs, limit):
            s, e, first = K.spans(part, o)
            h = K.hash_spans(part, s, e)
            raw = [part[a:b].tobytes() for a, b in zip(s, e)]
            for k in range(lo, hi):
                assert raw[first[k - lo]:first[k - lo + 1]] == WORD.findall((texts[k] or "").encode())
            for w, x in zip(raw, h):
                assert words.setdefault(w, x) == x
            for size in (1, 4, 7, 20, 50):
                got = K.window_hash(h, size)
                at, doc = K.window_docs(first, size)
                assert all(first[d] <= a and a + size <= first[d + 1] for a, d in zip(at, doc))
                for a in at:
                    key = (size, tuple(raw[a:a + size]))
                    assert windows.setdefault(key, got[a]) == got[a]
    assert len(set(words.values())) == len(words) and len(set(windows.values())) == len(windows)


def test_hash_pool_and_ragged():
    pool, h = K.HashPool(16), K.mix(np.arange(1, 20001, dtype=np.uint64))
    for i in range(0, 20000, 777):
        pool.add(h[i:i + 777], np.arange(i, min(i + 777, 20000), dtype=np.int32))
    assert (pool.find(h) == np.arange(20000)).all()
    assert (pool.find(K.mix(np.arange(50000, 60000, dtype=np.uint64))) == -1).all()
    assert K.ragged(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]
    assert K.ragged(np.array([3]), np.array([0])).tolist() == []


def test_null_slots_with_bytes_are_empty():
    col = pa.Array.from_buffers(pa.string(), 2, [pa.py_buffer(b"\x02"), pa.py_buffer(np.array([0, 2, 4], np.int32).tobytes()), pa.py_buffer(b"abcd")])
    buf, offs = K.string_buffers(col)
    assert buf[offs[0]:offs[1]].tobytes() == b"" and buf[offs[1]:offs[2]].tobytes() == b"cd"
