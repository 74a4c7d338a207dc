"""Secret scan: fixed patterns plus dictionary-primed zstandard novelty.

Base spans come from three patterns (``assign``, ``access``, ``hex``).  On top, every other
maximal run of key characters that stands near a sensitive word, begins like a known issuer's key (``ISSUED``), or follows or precedes such a run
on an adjacent line (a key block), is weighed by its marginal compressed size: bytes of (context + candidate) minus bytes of (context), both compressed
with a dictionary primed with the corpus' own identifiers.  Names that code repeats cost
almost nothing; a string that neither its surroundings nor the identifiers explain costs
nearly its entropy and is reported as ``novel``: the parts of it that no base span covers, and a shorter last
line below it.  What stands before an ``assign`` span in its run is the name's beginning and weighed on its own.

The identifier dictionary is counted over the surroundings of all candidates and base spans
of all documents; the ``DICTIONARY_WORDS`` most frequent are kept, so what reaches the driver
and the executors is bounded.  Two scans of the text, no shuffle of it.

Edge cases: a null text counts as empty (no spans); repeated rows are scanned each; positions
are code points, end exclusive; other columns are passed over.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protolens.llm.common import prepare, texts

#: fixed values: the base patterns
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, so the same as all runs less the short ones
KINDS = ("assign", "access", "hex", "novel")
ASSIGN_MIN, ACCESS_MIN = 6, 20

SENSITIVE = ("passw", "secret", "token", "api_key", "apikey", "access_key", "accesskey", "credential", "bearer", "private", "signature", "auth")
#: fixed values: beginnings of keys that name their issuer; such a key is sensitive wherever it stands
ISSUED = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "sk_live_", "sk_test_", "rk_live_", "xoxb-", "xoxp-", "AIza", "npm_")
ISSUED_KEY = re.compile("(?<![A-Za-z0-9])(?:" + "|".join(ISSUED) + ")[A-Za-z0-9]")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: between the parts of a dotted token, and the lines of a key block (also as escapes or quoted strings); a short last line below a line of ``WRAP`` or more
ADJACENT = re.compile(r"""\.|\\+|[\x20\t]*(?:\\[rn])*["']?[\x20\t]*[+,\\]?[\x20\t]*\r?\n[\x20\t]*[>#*"']*[\x20\t]*""")
TAIL = re.compile(r"[\x20\t]*\r?\n[\x20\t]*([A-Za-z0-9+/_=-]{1,15})(?=[\x20\t]*(?:\r?\n|\Z))")
WRAP = 40
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]{2,31}")
NEAR = 64  # code points of context on each side
DICTIONARY_WORDS = 2048
#: marginal compressed bytes per character from which a candidate counts as novel
NOVELTY = 0.55


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, in order."""
    out = []
    if ("=" in text or ":" in text) and _mentions(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _mentions(text: str) -> bool:
    low = text.lower()
    return any(w in low for w in ("passw", "secret", "token", "api"))


def _mixed(run: str) -> bool:
    return any(c.isdigit() for c in run) and any(c.isalpha() for c in run)


def _uncovered(a: int, b: int, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, kind number of the base span at the end or -1) of the parts of a run outside ``base``, in order."""
    out = []
    for s, kind, e in base:
        if a < s < b:
            out.append((a, s, kind))
        a = max(a, e)
    return out + [(a, b, -1)] if a < b else out


def _assigned(block: list[tuple[int, int]], base: list[tuple[int, int, int]], k: int) -> bool:
    """Whether an ``assign`` span from number ``k`` on covers the beginning of a block of several lines."""
    while len(block) > 1 and k < len(base) and base[k][0] < block[0][1]:
        if base[k][1] == 0:
            return True
        k += 1
    return False


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(start, end, parts to report) of the runs with letters and digits near a sensitive word, or in a block with such a run."""
    low = text.lower()
    issued = any(w in text for w in ISSUED)
    if not issued and not any(w in low for w in SENSITIVE):
        return []
    blocks: list[list[tuple[int, int]]] = []
    for m in CANDIDATE.finditer(text):
        if blocks and m.start() - blocks[-1][-1][1] <= NEAR and ADJACENT.fullmatch(text, blocks[-1][-1][1], m.start()):
            blocks[-1].append(m.span())
        else:
            blocks.append([m.span()])
    out, k = [], 0
    for block in blocks:
        mixed = [_mixed(text[a:b]) for a, b in block]
        if not any(mixed):
            continue
        while k < len(base) and base[k][2] <= block[0][0]:
            k += 1
        own = issued and any(yes and ISSUED_KEY.search(text, a, b) for (a, b), yes in zip(block, mixed))
        if not own and not _assigned(block, base, k) and not any(w in (text[max(0, a - NEAR):a] + "\n" + text[b:b + NEAR // 2]).lower() for (a, b), yes in zip(block, mixed) if yes for w in SENSITIVE):
            continue
        for (a, b), yes in zip(block, mixed):
            if not yes and (len(block) == 1 or b - a < WRAP):
                continue
            tail = TAIL.match(text, b) if b - a >= WRAP and (a, b) == block[-1] else None
            end = tail.end(1) if tail else b
            while k < len(base) and base[k][2] <= a:
                k += 1
            over, n = [], k
            while n < len(base) and base[n][0] < end:
                over.append(base[n])
                n += 1
            parts = []
            for s, e, kind in _uncovered(a, b, over):
                if kind:
                    parts.append((s, e))
                elif e - s >= 16 and _mixed(text[s:e]):  # before the sensitive word of an assignment
                    out.append((s, e, [(s, e)]))
            if parts:
                out.append((a, b, parts + [(s, e) for s, e, _ in (_uncovered(*tail.span(1), over) if tail else [])]))
    return out


def _around(text: str, a: int, b: int) -> str:
    return text[max(0, a - NEAR):a] + "\n" + text[b:b + NEAR]


def identifier_dictionary(docs: DataFrame, size: int = DICTIONARY_WORDS) -> bytes:
    """The most frequent identifiers around all candidates and base spans, least frequent first."""

    def run(batches):
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                base = base_spans(text)
                for a, b in [(s, e) for s, _, e in base] + [(a, b) for a, b, _ in candidates(text, base)]:
                    seen.update(IDENTIFIER.findall(_around(text, a, b)))
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    top = (docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
           .where(F.col("n") > 1).orderBy(F.desc("n"), "word").limit(size).collect())  # at most ``size`` short words
    return " ".join(r["word"] for r in reversed(top)).encode()


class Novelty:
    """Marginal compressed bytes of a string in its context, under a raw-content dictionary."""

    def __init__(self, words: bytes):
        import zstandard

        primed = {"dict_data": zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)} if len(words) >= 8 else {}
        self.tool = zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False, write_dict_id=False, **primed)

    def per_char(self, text: str, a: int, b: int) -> float:
        before, after = text[max(0, a - NEAR):a], text[b:b + NEAR]
        with_it = len(self.tool.compress((before + after + "\n" + text[a:b]).encode("utf-8", "replace")))
        without = len(self.tool.compress((before + after + "\n").encode("utf-8", "replace")))
        return (with_it - without) / (b - a)


def all_spans(text: str | None, novelty: Novelty, threshold: float = NOVELTY) -> list[tuple[int, int, int]]:
    text = text or ""
    base = base_spans(text)
    more = [(s, 3, e) for a, b, parts in candidates(text, base) if novelty.per_char(text, a, b) >= threshold for s, e in parts]
    return sorted(base + more) if more else base


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, threshold: float = NOVELTY) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans of every document."""
    prepare(docs.sparkSession)
    rows = texts(docs)
    words = identifier_dictionary(rows)

    def run(batches):
        novelty = Novelty(words)
        for batch in batches:
            found = [all_spans(t, novelty, threshold) for t in batch.column(1).to_pylist()]
            count = [[sum(1 for s in spans if s[1] == k) for spans in found] for k in range(4)]
            digest = [hashlib.sha256(joined([s for s in spans if s[1] < 3]).encode()).hexdigest() for spans in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in count), pa.array(digest, pa.string()), pa.array([joined(s) for s in found], pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"])

    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]", threshold: float = NOVELTY, length_col: str | None = None) -> DataFrame:
    """The same rows and columns with every found span replaced by ``mask``; a null text stays null.

    ``length_col`` (if the table has it) changes by as many code points as its row's text."""
    prepare(docs.sparkSession)
    words = identifier_dictionary(docs.select(F.col(text_col).cast("string").alias("text")))
    at = docs.columns.index(text_col)
    size_at = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches):
        novelty = Novelty(words)
        for batch in batches:
            text = batch.column(at).to_pylist()
            new = [t if not (spans := all_spans(t, novelty, threshold)) else masked(t, spans, mask) for t in text]
            if size_at is not None:
                size = batch.column(size_at).to_pylist()
                size = [n if n is None or t is None else n + len(m) - len(t) for n, t, m in zip(size, text, new)]
                batch = batch.set_column(size_at, batch.schema.field(size_at), pa.array(size, batch.schema.field(size_at).type))
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
