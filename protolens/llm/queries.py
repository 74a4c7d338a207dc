"""The queries of this subpackage, each over its whole table, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from protolens.llm import oracles
from protolens.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from protolens.llm.token_count import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), limit=4096)


@query
def op10_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from protolens.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), max_tokens=2048)


@query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from protolens.llm.secret_scan import scan

    return scan(table(spark, sf_dir, "documents"))


@query
def op5_line_block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from protolens.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


@query
def op6_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    from protolens.llm.language_id import predict_languages

    return predict_languages(table(spark, sf_dir, "documents"))


@query
def op8_toxicity_noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    from protolens.llm.toxicity import score, train

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


@query
def op4_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from protolens.llm.decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op9_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from protolens.llm.jaccard_join import link_components

    return link_components(table(spark, sf_dir, "documents"))


@query
def op3_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from protolens.llm.substring_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


@query
def op1_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from protolens.llm.ann_forest import nearest

    return nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0, k=20)


def looped_words(doc_id: int | None, n: int):
    """The word that stands at each place of a document of ``n`` words: a tenth of the documents repeat a stretch to
    their end (crc32 of the decimal doc_id decides which, from where and how long); None for the others."""
    import zlib

    import numpy as np

    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from protolens.llm.periodic_runs import find_runs

    found = find_runs(table(spark, sf_dir, "documents"), order=looped_words)
    # exact comparison of length / period by cross multiplication; runs are sorted by start and period
    best = F.expr("""reduce(runs, cast(null as struct<start:long,length:long,period:long>), (best, r) ->
                     if(best is null or r.length * best.period > best.length * r.period, r, best))""")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"),
                                                               r["period"].cast("string")), F.lit("\n")))
    return (found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                         F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
            .select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                    F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"))


ORACLE_SQL["op11_periodic_runs"] = oracles.PERIODIC_RUNS

#: (host, path, verdict): fixed values
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@query
def op12_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from protolens.llm.url_reputation import judge

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = judge(table(spark, sf_dir, "pages"), rules)
    return judged.select(F.col("page_id").cast("long").alias("page_id"), "host", "path", "rule", "verdict",
                         F.round("block_rate", 6).alias("block_rate"), F.round("block_bound", 6).alias("block_bound"))


ORACLE_SQL["op12_url_reputation"] = oracles.URL_REPUTATION


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from protolens.llm.conv_trie import id_list_digests, ordered_turns, prefix_trie, with_borrowed_heads

    nodes, ends = prefix_trie(with_borrowed_heads(ordered_turns(table(spark, sf_dir, "conversations"))))
    return nodes.join(id_list_digests(ends), "key", "left").select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


ORACLE_SQL["op13_prefix_trie"] = oracles.PREFIX_TRIE
