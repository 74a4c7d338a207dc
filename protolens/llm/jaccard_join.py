"""N-gram Jaccard join by T-occurrence search over divided inverted lists.

A document is the set of its distinct shingles (``SHINGLE`` words, hashed to 64 bits).  Two documents
link when ``100 * overlap >= 85 * union``, that is when their overlap reaches T(|a|, |b|).

1. Sets.  One pass over the texts gives each document's set size, a 128-bit set hash (equal sets become
   one node), two parity sketches, and the prefix of its set under a global order of shingles.
2. Divided lists.  The order puts common shingles (long inverted lists, found on a bounded sample) last.
   Two linked sets share a shingle of their prefixes ``|a| - ceil(0.85 |a|) + 1`` whatever the order, so
   merging the lists of prefixes finds every link; common shingles enter only the prefixes of sets that
   hold little else, and otherwise serve when a candidate's overlap is probed.
3. Merge.  Lists are sorted runs of one shuffle by shingle.  A list of at most ``SHORT`` sets gives its pairs
   that pass the size filter; longer lists go on as rows, are dealt into blocks of about ``BLOCK`` sets and
   compared block against block.
4. Prune.  The parity sketch of a set has bit h mod B flipped by every shingle h, so the popcount of two
   sketches' XOR is a lower bound of their symmetric difference: pairs it rules out cannot link.
5. Probe.  Candidates that are left are verified on whole sets by binary search of one in the other.
   Each set is first tried with its nearest and its smallest candidate; components of those links are
   then contracted, and only candidates between different components are verified after that.
   Pairs inside a component cannot change it, so components are exact with few pairs.

Nothing is capped or sampled away: sample, block and list sizes decide speed only.

Edge cases: null texts and texts without words have size 0 and link with nothing; fewer than ``SHINGLE``
words are one shingle; repeated rows and copies share a component; rows with one doc_id are one document;
a null doc_id takes part but names no component (its rows get its class' smallest doc_id, if any).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from protolens.llm import kernel as K
from protolens.llm.common import partitions, prepare, release, texts, written
from protolens.llm.components import components

SHINGLE = 4
PERCENT = 85
#: documents of the sample that finds common shingles, how many of them make one common, and the most kept
SAMPLE_DOCS, COMMON_DOCS, COMMON_MOST = 20_000, 8, 50_000
SHORT, BLOCK = 32, 1024
#: bits of the coarse sketch, and of the fine one per shingle (powers of two, between these bounds)
COARSE, FINE_PER, FINE_MOST = 512, 4, 1 << 15


class Rule:
    """The link rule ``100 * overlap >= percent * union`` and what follows from it."""

    def __init__(self, percent: int = PERCENT):
        self.percent = percent

    def prefix(self, n: int) -> int:
        return n + (-self.percent * n // 100) + 1

    def sizes(self, a, b):
        return 100 * np.minimum(a, b) >= self.percent * np.maximum(a, b)

    def differs(self, total, difference):
        """Whether a symmetric difference of at least ``difference`` of ``total`` = |a| + |b| rules a link out."""
        return (100 - self.percent) * total < (100 + self.percent) * difference

    def links(self, overlap: int, total: int) -> bool:
        return 100 * overlap >= self.percent * (total - overlap)


def shingle_sets(buf: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document of a run."""
    low = K.LOWER[buf]
    s, e, first = K.spans(low, offs)
    words = K.hash_spans(low, s, e, seed=5)
    windows = K.mix(K.window_hash(words, size, salt=9))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            g = np.sort(windows[a:b - size + 1])
            out.append(g[np.concatenate([[True], g[1:] != g[:-1]])])
        elif b > a:
            out.append(K.mix(K.window_hash(words[a:b], b - a, salt=31 + b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_hash(g: np.ndarray) -> tuple[int, int]:
    """128 bits of a set as two signed 64-bit numbers."""
    n = K.U64(len(g))
    x = K.mix(np.array([K.mix(g ^ K.U64(0x5851F42D4C957F2D)).sum() + n, K.mix(g + K.U64(0x14057B7EF767814F)).sum() ^ n], dtype=np.uint64))
    a, b = x.view(np.int64)
    return int(a), int(b)


def fine_bits(n: int) -> int:
    return min(FINE_MOST, max(COARSE, 1 << max(0, FINE_PER * n - 1).bit_length()))


def parity(g: np.ndarray, bits: int) -> bytes:
    """Bit p is set when an odd number of shingles fall on p."""
    odd = np.bincount((g & K.U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fold(sketch: np.ndarray, size: int) -> np.ndarray:
    """Rows of bytes folded to ``size`` bytes by XOR of halves: the sketch with fewer bits."""
    while sketch.shape[-1] > size:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def common_shingles(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> np.ndarray:
    """Hashes of the shingles that many documents of a bounded sample hold, sorted (``COMMON_MOST`` at most)."""
    n = docs.count()
    share = 1.0 if n <= sample_docs else sample_docs / n

    def run(batches):
        for b in batches:
            buf, offs = K.string_buffers(b.column(0))
            for _, _, part, o in K.chunks(buf, offs):
                h, k = np.unique(np.concatenate(shingle_sets(part, o)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(K.signed(h)), pa.array(k)], ["h", "k"])

    top = docs.where("text is not null").where(F.rand(5) < F.lit(share)).select("text").distinct()  # copies make no shingle common
    top = (top.mapInArrow(run, "h long, k long").groupBy("h").agg(F.sum("k").alias("k")).where(F.col("k") >= COMMON_DOCS)
           .orderBy(F.desc("k"), "h").limit(COMMON_MOST).select("h").toArrow())
    return np.sort(np.asarray(top.column("h").combine_chunks()).view(np.uint64)) if top.num_rows else np.zeros(0, np.uint64)


def set_table(docs: DataFrame, common: np.ndarray, rule: Rule) -> DataFrame:
    """doc_id, n, sid, sid2, coarse, fine, prefix of every document; a task gives sketches and prefix once a set."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        common = shared.value
        gate = np.zeros(1 << 20, bool)
        gate[(common >> K.U64(44)).astype(np.int64)] = True
        seen: set[tuple[int, int]] = set()
        for b in batches:
            keys = b.column(0)
            buf, offs = K.string_buffers(b.column(1))
            for lo, hi, part, o in K.chunks(buf, offs):
                n, sid, sid2, coarse, fine, prefix = [], [], [], [], [], []
                for g in shingle_sets(part, o):
                    x, y = set_hash(g)
                    n.append(len(g))
                    sid.append(x)
                    sid2.append(y)
                    if not len(g) or (x, y) in seen:
                        coarse.append(None)
                        fine.append(None)
                        prefix.append(None)
                        continue
                    seen.add((x, y))
                    bits = fine_bits(len(g))
                    fine.append(parity(g, bits))
                    coarse.append(fold(np.frombuffer(fine[-1], np.uint8), COARSE // 8).tobytes())
                    often = gate[(g >> K.U64(44)).astype(np.int64)]
                    at = np.flatnonzero(often)
                    if len(at):
                        place = np.minimum(np.searchsorted(common, g[at]), len(common) - 1)
                        often[at] = common[place] == g[at]
                        order = np.concatenate([g[~often], g[often]])
                    else:
                        order = g
                    prefix.append(order[:rule.prefix(len(g))].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(lo, hi - lo), pa.array(n, pa.int32()), pa.array(sid, pa.int64()), pa.array(sid2, pa.int64()),
                     pa.array(coarse, pa.binary()), pa.array(fine, pa.binary()), pa.array(prefix, pa.binary())],
                    ["doc_id", "n", "sid", "sid2", "coarse", "fine", "prefix"])

    return docs.mapInArrow(run, "doc_id long, n int, sid long, sid2 long, coarse binary, fine binary, prefix binary")


def one_id_a_set(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sets, one row of each set): sets whose 64-bit ids are equal by chance, as their other halves tell, get new ids."""
    rounds = 0
    while True:
        reps = written(sets.where("n > 0").groupBy("sid")
                       .agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.max("coarse").alias("coarse"), F.max("fine").alias("fine"),
                            F.min("sid2").alias("low"), F.max("sid2").alias("high")), "jaccard-reps")
        clash = reps.where("low <> high").select(F.col("sid").alias("clash"))
        if clash.isEmpty():
            return sets, reps
        rounds += 1
        sid = F.when(F.col("clash").isNull(), F.col("sid")).otherwise(F.xxhash64("sid", "sid2", F.lit(rounds)))
        sets = written(sets.join(clash, F.col("sid") == F.col("clash"), "left").withColumn("sid", sid).drop("clash"), "jaccard-sets")


def _postings(batches):
    """(token, sid, n) of every prefix place."""
    for b in batches:
        sid, n = np.asarray(b.column(0)), np.asarray(b.column(1))
        buf, offs = K.string_buffers(b.column(2))
        if not offs[-1] - offs[0]:
            continue
        token = np.frombuffer(buf[offs[0]:offs[-1]].tobytes(), np.int64)
        many = np.diff(offs) // 8
        yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(np.repeat(sid, many)), pa.array(np.repeat(n, many))], ["token", "sid", "n"])


def _lists(rule: Rule, short: int):
    """Merge of lists sorted by (token, sid): pairs of short lists (kind 0), rows of long ones (kind 1)."""

    def rows(kind, x, y, nx, ny):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int32)), pa.array(x), pa.array(y), pa.array(nx.astype(np.int32)), pa.array(ny.astype(np.int32))],
                                          ["kind", "x", "y", "nx", "ny"])

    def settle(t, s, n, long_token):
        """All lists of these rows are complete, but the one of ``long_token`` began before."""
        begin = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        size = np.diff(np.append(begin, len(t)))
        long = size > short
        if long_token is not None and len(t) and t[0] == long_token:
            long[0] = True
        if long.any():
            at = K.ragged(begin[long], size[long])
            yield rows(1, t[at], s[at], np.zeros(len(at), np.int32), n[at])
        for m in np.unique(size[~long & (size > 1)]):
            first = begin[~long & (size == m)]
            i, j = np.triu_indices(int(m), 1)
            step = max(1, 2_000_000 // len(i))
            for k in range(0, len(first), step):
                a, b = (first[k:k + step, None] + i).ravel(), (first[k:k + step, None] + j).ravel()
                ok = rule.sizes(n[a].astype(np.int64), n[b].astype(np.int64))
                if ok.any():
                    yield rows(0, s[a[ok]], s[b[ok]], n[a[ok]], n[b[ok]])

    def run(batches):
        t = s = n = None
        long_token = None
        for b in batches:
            x, y, z = (np.asarray(b.column(k)) for k in range(3))
            if not len(x):
                continue
            if t is not None:
                x, y, z = np.concatenate([t, x]), np.concatenate([s, y]), np.concatenate([n, z])
            keep = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])  # copies of a set from several tasks
            x, y, z = x[keep], y[keep], z[keep]
            open_ = int(np.searchsorted(x, x[-1], side="left"))
            yield from settle(x[:open_], y[:open_], z[:open_], long_token)
            if open_:
                long_token = None
            t, s, n = x[open_:], y[open_:], z[open_:]
            if len(t) > short:  # a long list: its rows go on as they come, the last one stays to compare with
                long_token = t[0]
                yield rows(1, t[:-1], s[:-1], np.zeros(len(t) - 1, np.int32), n[:-1])
                t, s, n = t[-1:], s[-1:], n[-1:]
        if t is not None:
            yield from settle(t, s, n, long_token)

    return run


def _popcounts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.ascontiguousarray(a ^ b).view(np.uint64)).sum(-1, dtype=np.int64)


def _close(rule: Rule):
    """(x, y, d) of the pairs (x, y, nx, ny, sx, sy) that their sketches do not rule out; d is their distance there."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            total = np.asarray(b.column("nx")).astype(np.int64) + np.asarray(b.column("ny"))
            (bx, ox), (by, oy) = K.string_buffers(b.column("sx")), K.string_buffers(b.column("sy"))
            wide = np.minimum(np.diff(ox), np.diff(oy))
            d = np.zeros(len(total), np.int64)
            for w in np.unique(wide):
                at = np.flatnonzero(wide == w)
                for k in range(0, len(at), 4096):
                    some = at[k:k + 4096]
                    sides = []
                    for buf, o in ((bx, ox), (by, oy)):
                        size = o[some + 1] - o[some]
                        out = np.zeros((len(some), int(w)), np.uint8)
                        for own in np.unique(size):
                            i = np.flatnonzero(size == own)
                            out[i] = fold(buf[o[some[i]][:, None] + np.arange(own)], int(w))
                        sides.append(out)
                    d[some] = _popcounts(*sides)
            ok = pa.array(~rule.differs(total, d))
            yield pa.RecordBatch.from_arrays([*(b.column(c).filter(ok) for c in ("x", "y", "nx", "ny")), pa.array(d).filter(ok)], ["x", "y", "nx", "ny", "d"])

    return run


def _block_pairs(rule: Rule, across: bool):
    """Candidates of one pair of blocks of a long list (rows: token, i, j, block, sid, n, fine[, component]).

    ``across`` False: each set with its nearest and its smallest candidate.  True: all candidates between
    different components."""

    def run(key, group):
        i, j = key[1].as_py(), key[2].as_py()
        n = np.asarray(group.column("n").combine_chunks()).astype(np.int64)
        order = np.argsort(n, kind="stable")
        group = group.take(pa.array(order))
        n = n[order]
        sid = np.asarray(group.column("sid").combine_chunks())
        block = np.asarray(group.column("block").combine_chunks())
        comp = np.asarray(group.column("component").combine_chunks()) if across else None
        fine = group.column("fine").to_pylist()
        size = np.array([len(f) for f in fine])
        xs, ys = [], []
        far, none = np.iinfo(np.int64).max, np.full(len(n), -1)
        near_d, near, least_sid, least = np.full(len(n), far), none.copy(), np.full(len(n), far), none.copy()
        words = {}

        def at_size(width):  # every sketch folded to one width
            if width not in words:
                words[width] = np.stack([fold(np.frombuffer(f, np.uint8), width) if len(f) >= width else np.zeros(width, np.uint8) for f in fine])
            return words[width]

        top = np.searchsorted(n, 100 * n // rule.percent, side="right")  # largest partner by size, sets sorted by size
        for a in range(len(n)):
            if top[a] <= a + 1:
                continue
            other = np.arange(a + 1, top[a])
            if i != j:
                other = other[block[other] != block[a]]
            if across:
                other = other[comp[other] != comp[a]]
            if not len(other):
                continue
            w = at_size(int(size[a]))  # a's own width: its partners are not smaller
            d = _popcounts(w[other], w[a])
            ok = ~rule.differs(n[a] + n[other], d)
            other, d = other[ok], d[ok]
            if not len(other):
                continue
            if across:
                xs += [a] * len(other)
                ys += other.tolist()
                continue
            k, low = int(np.argmin(d)), int(other[np.argmin(sid[other])])
            if d[k] < near_d[a]:
                near_d[a], near[a] = d[k], other[k]
            if sid[low] < least_sid[a]:
                least_sid[a], least[a] = sid[low], low
            better = d < near_d[other]
            near_d[other[better]], near[other[better]] = d[better], a
            smaller = sid[a] < least_sid[other]
            least_sid[other[smaller]], least[other[smaller]] = sid[a], a
        if not across:
            own = np.arange(len(n))
            xs = np.concatenate([own[near >= 0], own[least >= 0]])
            ys = np.concatenate([near[near >= 0], least[least >= 0]])
        x, y = sid[np.array(xs, np.int64)], sid[np.array(ys, np.int64)]
        return pa.table({"x": np.minimum(x, y), "y": np.maximum(x, y)}, schema=pa.schema([("x", pa.int64()), ("y", pa.int64())]))

    return run


def _verify(rule: Rule):
    """(a, b) doc ids of the pairs whose whole sets link: the smaller set is probed in the larger."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sets = [[np.frombuffer(v, np.uint64) for v in b.column(c).to_pylist()] for c in ("gx", "gy")]
            ok = np.zeros(b.num_rows, bool)
            for k, (g, h) in enumerate(zip(*sets)):
                if len(g) > len(h):
                    g, h = h, g
                at = np.minimum(np.searchsorted(h, g), len(h) - 1)
                ok[k] = rule.links(int((h[at] == g).sum()), len(g) + len(h))
            yield b.select(["a", "b"]).filter(pa.array(ok))

    return run


def link_components(docs: DataFrame, percent: int = PERCENT, short: int = SHORT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    spark = docs.sparkSession
    prepare(spark)
    rule, parts = Rule(percent), partitions(spark)
    rows = texts(docs)
    sets, reps = one_id_a_set(written(set_table(rows, common_shingles(rows), rule), "jaccard-sets"))

    lists = (sets.where("prefix is not null").select("sid", "n", "prefix").mapInArrow(_postings, "token long, sid long, n int")
             .repartition(parts, "token").sortWithinPartitions("token", "sid").mapInArrow(_lists(rule, short), "kind int, x long, y long, nx int, ny int"))
    lists = written(lists, "jaccard-lists")
    release(spark)

    pairs = lists.where("kind = 0").select("x", "y", "nx", "ny").distinct()
    for sketch in ("coarse", "fine"):  # the fine ones are larger and tell long sets apart
        of = reps.select("sid", sketch)
        pairs = (pairs.join(of.toDF("x", "sx"), "x").join(of.toDF("y", "sy"), "y").select("x", "y", "nx", "ny", "sx", "sy")
                 .mapInArrow(_close(rule), "x long, y long, nx int, ny int, d long"))
        pairs = written(pairs, f"jaccard-{sketch}").drop(*(["d"] if sketch == "coarse" else []))
        release(spark)
    sides = pairs.select("x", "y", "d").unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"), "d"))
    best = sides.groupBy("x").agg(F.min(F.struct("d", "y")).alias("near"), F.min("y").alias("least"))
    best = best.select("x", F.explode(F.array("near.y", "least")).alias("y"))

    long = lists.where("kind = 1").select(F.col("x").alias("token"), F.col("y").alias("sid"), F.col("ny").alias("n"))
    blocks = long.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))
    long = written(long.join(blocks, "token").withColumn("block", F.pmod(F.xxhash64("sid", F.lit(3)), F.col("blocks")).cast("int")), "jaccard-long")

    def dealt(rows_: DataFrame) -> DataFrame:
        """Every row to each pair of blocks that its own is part of."""
        out = rows_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return out.select("token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "sid", "n", "fine", *(["component"] if "component" in out.columns else []))

    fine = reps.select("sid", "fine", "rep")
    tried = dealt(long.join(fine, "sid")).groupBy("token", "i", "j").applyInArrow(_block_pairs(rule, False), "x long, y long")
    tried = best.unionByName(tried).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    tried = written(tried, "jaccard-candidates")
    release(spark)

    # whole sets of the documents in any candidate: each set that has one has its nearest
    nodes = tried.select(F.col("x").alias("sid")).unionByName(tried.select(F.col("y").alias("sid"))).distinct()
    wanted = nodes.join(reps.select("sid", "rep", "low"), "sid").where("rep is not null")  # low: the second half of the set's hash

    def whole(batches):
        for b in batches:
            buf, offs = K.string_buffers(b.column(2))
            for lo, hi, part, o in K.chunks(buf, offs):
                found = shingle_sets(part, o)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array([set_hash(g)[1] for g in found], pa.int64()),
                                                  pa.array([g.tobytes() for g in found], pa.binary()), b.column(3).slice(lo, hi - lo)], ["sid", "rep", "own", "g", "low"])

    found = (rows.join(wanted.select("sid", "low", F.col("rep").alias("doc_id")).hint("shuffle_hash"), "doc_id")
             .select("sid", F.col("doc_id").alias("rep"), "text", "low").mapInArrow(whole, "sid long, rep long, own long, g binary, low long")
             .where("low = own").dropDuplicates(["sid"]).select("sid", "rep", "g"))
    whole_sets = written(found, "jaccard-whole")
    release(spark)

    def verified(candidates: DataFrame) -> DataFrame:
        both = (candidates.join(whole_sets.toDF("x", "a", "gx"), "x").join(whole_sets.toDF("y", "b", "gy"), "y"))
        return both.select("a", "b", "gx", "gy").mapInArrow(_verify(rule), "a long, b long")

    first = components(written(verified(tried), "jaccard-links"))
    release(spark)
    labels = long.join(fine, "sid").join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = labels.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
    across = dealt(labels.join(mixed, "token")).groupBy("token", "i", "j").applyInArrow(_block_pairs(rule, True), "x long, y long")
    named = reps.select("sid", "rep").join(first.withColumnRenamed("node", "rep"), "rep").select("sid", "component")
    apart = (pairs.select("x", "y").join(named.toDF("x", "cx"), "x", "left").join(named.toDF("y", "cy"), "y", "left")
             .where("cx is null or cy is null or cx <> cy"))
    rest = across.unionByName(apart.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))).distinct().join(tried, ["x", "y"], "left_anti")
    rest = written(rest, "jaccard-rest")
    release(spark)
    more = written(verified(rest), "jaccard-across")
    # the second links join whole components
    named = first.toDF("node", "component")
    second = components(more.join(named.toDF("a", "ca"), "a", "left").join(named.toDF("b", "cb"), "b", "left")
                        .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    joined = second.select(F.col("node").alias("component"), F.col("component").alias("top"))
    final = (first.join(joined, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
             .unionByName(second.join(first, "node", "left_anti").select("node", "component"))).dropDuplicates(["node"])

    out = sets.select("doc_id", "n", "sid").join(reps.select("sid", "rep"), "sid", "left").join(final.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"),
                      F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "rep")).alias("component_id"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each component, that of its smallest doc_id, all columns unchanged.

    Of rows that share this doc_id the one with the smallest text stays; rows with a null doc_id, which no
    component can name, stay."""
    found = link_components(docs, percent)
    place, gone, again = (x + "_" * max(map(len, docs.columns)) for x in ("place", "gone", "again"))  # longer than any column's name
    drop = written(found.where("doc_id is not null and component_id <> doc_id").select(F.col("doc_id").alias(gone)).distinct(), "jaccard-dropped")
    twice = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    out = docs.join(drop.hint("shuffle_hash"), F.col("doc_id").cast("long") == F.col(gone), "left_anti")
    if twice.isEmpty():
        return out
    order = Window.partitionBy("doc_id").orderBy(*[F.col("`" + c.replace("`", "``") + "`") for c in ("text", *[c for c, t in docs.dtypes if c not in ("doc_id", "text") and not t.startswith("map")])])
    repeated = written(twice.select(F.col("doc_id").alias(again)), "jaccard-repeated")
    some = out.join(repeated, F.col("doc_id") == F.col(again), "left_semi").withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).drop(place)
    return out.join(repeated, F.col("doc_id") == F.col(again), "left_anti").unionByName(some)
