"""Prefix trie of conversations by truncation peeling.

A node is a distinct sequence of first turns (role and text); the root is the empty one.  From the deepest level up, the
conversations that end at a depth are merged with the nodes that survive from below: one grouping by the node's key
gives its members, children, leaves and savings, its row is written, its last turn is stripped and what is left is
grouped again one level higher.  So each node is found and aggregated in the same pass.

Turns travel as 16-byte digests; a node's key is the digest of its parent's key and its last turn, and a surviving row
carries the keys of its path (16 bytes a turn).  Copies of a conversation are one row from the first grouping
on, and all groupings are sums and minima combined before the shuffle, so a first turn or a conversation that a third of
all rows share costs one row a task.

A grouping of all rows a depth would take as many rounds as the longest conversation has turns.  So long conversations
are first peeled to depth 4096, 512, 64 and 8: rows that share their first 8 turns are peeled by one task where they
hold at most ``GROUP_TURNS`` turns below, and by rounds where they hold more.  The last nine depths are rounds.
The turns of one conversation are sorted and gathered in one task.

Edge cases: turns are ordered by ``turn``, null first, ties by a digest of role and text (equal rows are separate turns); a
null role or text is empty; rows without conv_id take no part; an empty table has no node; other columns are
passed over.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from protolens.llm.common import hot_join, prepare, written

#: depths to which rows are peeled in one task a group before all rows are peeled depth by depth
CUTS = (8, 64, 512, 4096, 32768)
#: turns of a group that one task may peel
GROUP_TURNS = 1 << 19


def _md5(text):
    return F.unhex(F.md5(text))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), digest of role and text, bytes of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        _md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"))
    by = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return rows.select("conv_id", (F.row_number().over(by) - 1).alias("pos"), "digest", "bytes")


def with_borrowed_heads(turns: DataFrame, group: int = 5, spread: int = 9) -> DataFrame:
    """Every conversation c with the first h turns of conversation c - c % group in place of its own first h, for
    h = crc32(decimal c) % spread.  A row of pos -1 stands for each conversation, with turns or without."""
    turns = written(turns, "trie-turns")
    head = (F.crc32(F.col("conv_id").cast("string")) % spread).alias("h")
    ids = turns.select("conv_id").distinct().select("conv_id", head)
    own = turns.select("*", head).where("pos >= h").select(turns.columns)
    lent = (turns.where((F.col("pos") < spread - 1) & (F.col("conv_id") % group == 0))
            .select(F.explode(F.sequence(F.col("conv_id") - (group - 1), F.col("conv_id") + (group - 1))).alias("to"), "*")
            .where((F.col("to") - F.col("to") % group) == F.col("conv_id"))
            .join(ids.withColumnRenamed("conv_id", "to"), "to").where("pos < h")
            .select(F.col("to").alias("conv_id"), "pos", "digest", "bytes"))
    return own.unionByName(lent).unionByName(_roots(ids))


def _roots(ids: DataFrame) -> DataFrame:
    return ids.select("conv_id", F.lit(-1).alias("pos"), F.unhex(F.lit("")).alias("digest"), F.lit(0).cast("long").alias("bytes"))


def paths(turns: DataFrame) -> DataFrame:
    """conv_id, keys of the nodes from the root to its end, and the bytes of each node's last text."""
    per = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "bytes"))).alias("t"))
    per = per.select("conv_id", F.expr("if(t[0].pos < 0, slice(t, 2, size(t)), t)").alias("t"))
    keys = F.aggregate("t", F.array(_md5(F.lit(""))),
                       lambda done, x: F.concat(done, F.array(_md5(F.concat(F.element_at(done, -1), x["digest"])))))
    sizes = F.concat(F.array(F.lit(0).cast("long")), F.transform("t", lambda x: x["bytes"]))
    return per.select("conv_id", keys.alias("path"), sizes.alias("sizes"))


def _key(depth: int | None = None):
    """Key of the node where a row's path ends, or of its prefix of ``depth`` turns."""
    return F.element_at("path", -1 if depth is None else depth + 1)


def _level(rows: DataFrame, d: int) -> DataFrame:
    """Nodes of depth ``d`` from the rows whose path ends there."""
    node = rows.groupBy(_key().alias("key")).agg(
        F.first("path").alias("path"), F.first("sizes").alias("sizes"), F.sum("n_convs").alias("n_convs"),
        F.min("conv_id").alias("conv_id"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    return node.select(
        "key", (F.element_at("path", -2) if d else F.lit(None).cast("binary")).alias("parent_key"),
        F.lit(d).cast("long").alias("depth"), "path", "sizes", "n_convs", "conv_id", "n_children",
        F.greatest("n_leaves", F.lit(1).cast("long")).alias("n_leaves"),
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.element_at("sizes", -1)).alias("saved_tokens"))


def _stripped(nodes: DataFrame, d: int) -> DataFrame:
    """Nodes of depth ``d`` as rows of their parents."""
    return nodes.select(F.lit(d - 1).alias("depth"), F.slice("path", 1, d).alias("path"), F.slice("sizes", 1, d).alias("sizes"),
                        "n_convs", "conv_id", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens")


def _rounds(rows: DataFrame, top: int, bottom: int) -> tuple[list[DataFrame], DataFrame | None]:
    """Peel from depth ``top`` to ``bottom``, one grouping of all rows a depth: (nodes by depth, rows of depth bottom - 1)."""
    levels, above = [], None
    for d in range(top, bottom - 1, -1):
        here = rows.where(F.col("depth") == d).select(ROW)
        if above is not None:
            here = here.unionByName(above)
        levels.append(written(_level(here, d), f"trie-level-{d}"))
        above = _stripped(levels[-1], d) if d else None
    return levels, above


def _peel_group(rows: list[tuple], bottom: int) -> tuple[list[tuple], tuple]:
    """Nodes below depth ``bottom`` of rows that share their first ``bottom`` turns, and the row of that prefix."""
    by_depth: dict[int, list] = {}
    for depth, path, sizes, *numbers in rows:
        by_depth.setdefault(depth, []).append((path, sizes, *numbers))
    nodes, above = [], []
    for d in range(max(by_depth), bottom, -1):
        level: dict[bytes, list] = {}
        for path, sizes, n, conv, children, leaves, saved in (*by_depth.get(d, ()), *above):
            x = level.get(path[d])
            if x is None:
                level[path[d]] = [path, sizes, n, conv, children, leaves, saved]
            else:
                x[2:] = x[2] + n, min(x[3], conv), x[4] + children, x[5] + leaves, x[6] + saved
        above = []
        for key, (path, sizes, n, conv, children, leaves, saved) in level.items():
            leaves, saved = max(leaves, 1), saved + (n - 1) * sizes[d]
            nodes.append((key, path[d - 1], d, n, conv, children, leaves, saved))
            above.append((path, sizes, n, conv, 1, leaves, saved))
    path, sizes = above[0][:2]
    n, conv, children, leaves, saved = zip(*(x[2:] for x in above))
    return nodes, (bottom, path[:bottom + 1], sizes[:bottom + 1], sum(n), min(conv), sum(children), sum(leaves), sum(saved))


NODE = ["key", "parent_key", "depth", "n_convs", "conv_id", "n_children", "n_leaves", "saved_tokens"]
ROW = ["depth", "path", "sizes", "n_convs", "conv_id", "n_children", "n_leaves", "saved_tokens"]
_PEELED = pa.schema([("key", pa.binary()), ("parent_key", pa.binary()), ("depth", pa.int64()), ("path", pa.list_(pa.binary())),
                     ("sizes", pa.list_(pa.int64())), *((c, pa.int64()) for c in ROW[3:])])


def _peel(bottom: int):
    """Rows sorted by their prefix of ``bottom`` turns: the nodes below (with a key), then the row left of each group."""

    def batch(nodes: list[tuple], left: list[tuple]) -> pa.RecordBatch:
        rows = [dict(zip(NODE, x)) for x in nodes] + [dict(zip(ROW, x)) for x in left]
        return pa.RecordBatch.from_pylist(rows, schema=_PEELED)

    def run(batches):
        group, prefix = [], None
        for b in batches:
            nodes, left = [], []
            for row in zip(*(b.column(i).to_pylist() for i in range(len(ROW)))):
                if group and row[1][bottom] != prefix:
                    more, rest = _peel_group(group, bottom)
                    nodes += more
                    left.append(rest)
                    group = []
                prefix = row[1][bottom]
                group.append(row)
            yield batch(nodes, left)
        if group:
            nodes, rest = _peel_group(group, bottom)
            yield batch(nodes, [rest])

    return run


def prefix_trie(turns: DataFrame, group_turns: int = GROUP_TURNS) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends).  nodes: key, depth, conv_id (smallest member), parent_key, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens; ends: key, conv_id of each conversation and the node where it ends."""
    prepare(turns.sparkSession)
    whole = written(paths(turns), "trie-paths")
    ends = whole.select(_key().alias("key"), "conv_id")
    zero = F.lit(0).cast("long")
    rows = whole.groupBy((F.size("path") - 1).alias("depth"), _key().alias("key")).agg(
        F.first("path").alias("path"), F.first("sizes").alias("sizes"), F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    rows = written(rows.select(*ROW[:5], *(zero.alias(c) for c in ROW[5:])), "trie-ended")
    deepest = rows.agg(F.max("depth")).first()[0]
    if deepest is None:
        empty = rows.select(F.lit(None).cast("binary").alias("key"), F.col("depth").cast("long").alias("depth"), "conv_id",
                            F.lit(None).cast("binary").alias("parent_key"), zero.alias("parent_conv_id"), *ROW[3:4], *ROW[5:])
        return empty, ends
    tables, top = [], deepest
    for c in reversed([c for c in CUTS if c < deepest]):
        deep, rows = rows.where(F.col("depth") > c), rows.where(F.col("depth") <= c)
        weights = deep.groupBy(_key(c).alias("key")).agg(F.sum(F.col("depth") - c).alias("turns"))
        large = written(weights.where(F.col("turns") > group_turns).select("key"), "trie-large")  # few: the sum is bounded
        mine = deep.join(F.broadcast(large), _key(c) == large["key"], "left_anti")
        peeled = (mine.select(F.col("depth").cast("long").alias("depth"), *ROW[1:]).repartition(_key(c)).sortWithinPartitions(_key(c))
                  .mapInArrow(_peel(c), "key binary, parent_key binary, depth long, path array<binary>, sizes array<long>, "
                              + ", ".join(f"{x} long" for x in ROW[3:])))
        peeled = written(peeled, "trie-peeled")
        tables.append(peeled.where("key is not null"))
        rows = rows.unionByName(peeled.where("key is null").select(F.col("depth").cast("int").alias("depth"), *ROW[1:]))
        if not large.isEmpty():
            levels, left = _rounds(deep.join(F.broadcast(large), _key(c) == large["key"], "left_semi"), top, c + 1)
            tables += levels
            rows = rows.unionByName(left)
        rows, top = written(rows, "trie-rows"), c
    tables += _rounds(rows, top, 0)[0]
    nodes = reduce(DataFrame.unionByName, [t.select(NODE) for t in tables])
    nodes = written(nodes, "trie-nodes")
    parents = nodes.where("n_children > 0").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"),
                                                   F.col("n_children").alias("below"))
    return hot_join(nodes, parents, ["parent_key"], "below", nodes.count()).drop("below"), ends


def _spell(batches):
    """Runs of one key in rows sorted by key and number: key, first number, all numbers as text."""
    for b in batches:
        keys, ids = b.column(0).to_pylist(), b.column(1).to_pylist()
        out, a = [], 0
        for k in range(1, len(keys) + 1):
            if k == len(keys) or keys[k] != keys[a]:
                out.append((keys[a], ids[a], ",".join(map(str, ids[a:k]))))
                a = k
        cols = list(zip(*out)) if out else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()),
                                          pa.array(cols[2], pa.string())], ["key", "first", "ids"])


def _hash(batches):
    """key, sha256 of the comma-joined texts of each key, streamed over rows sorted by key and first number."""
    key, state = None, None
    for b in batches:
        keys, digests = [], []
        for k, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            if state is not None and k == key:
                state.update(b",")
            else:
                if state is not None:
                    keys.append(key)
                    digests.append(state.hexdigest())
                key, state = k, hashlib.sha256()
            state.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], ["key", "sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["key", "sha256"])


def id_list_digests(ends: DataFrame) -> DataFrame:
    """key, sha256 of its conv_ids as decimals, ascending and comma-joined.  Ranges of (key, conv_id) become pieces of text
    first, so one key's numbers are spelled by many tasks and only the hash itself, streamed, is in one."""
    pieces = (ends.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
              .mapInArrow(_spell, "key binary, first long, ids string"))
    return pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hash, "key binary, sha256 string")
