"""The registered queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import decontam, html_text, langid, lexical, mixing, pii, sharding, simhash, substring_dedup, token_files, topk, url_filter, whitening
from granary.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``documents``.

    Null and empty texts have size 0 and nothing is taken of them; null sources
    are one source, the last; rows of one doc_id, null or not, each have a row;
    ties of the shuffle go by doc_id, then size; an empty table gives no rows.
    """
    _, taken = mixing.mixed(read_table(spark, sf_dir, "documents"))
    return taken


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``.

    A null or empty url, or one without ``://``, has an empty host and path;
    urls of any length count whole; of several rules that fit the longest wins;
    repeated rows and null ids stay; an empty table gives no rows.
    """
    return url_filter.judged(read_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of ``documents``.

    Null and empty texts have no words and the hash of ""; rows that share a
    doc_id don't remove from each other, a null doc_id counts as the largest;
    repeated rows stay; an empty table gives no rows.
    """
    return substring_dedup.repeats_removed(read_table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``.

    A null, empty or blank page gives "" and 0; broken pages of any length are
    read whole; repeated rows and null ids stay; an empty table gives no rows.
    """
    found = html_text.extracted(read_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of ``documents``.

    Null and empty texts have no spans; counts and hash are of the base spans,
    ``spans`` has the method's too; where several kinds fit
    a discovered word the best scored is taken, then the first as listed;
    repeated rows and null ids stay; an empty table gives no rows.
    """
    return pii.report(read_table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``documents``.

    Null and empty texts have fingerprint zero and link like any other; repeated
    rows stay; a null doc_id names no component: where a component has no other,
    component_id is null; an empty table gives no rows.
    """
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, score, start_word, n_words): the pairs of ``documents`` and ``benchmark`` that align.

    Texts on either side that are null or without a word are in no pair; of
    places that score alike the first counts; repeated rows are each reported,
    null ids as null; an empty table on either side gives no rows.
    """
    return decontam.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, rank, vec_id, score): the five best of ``embeddings`` for each row whose vec_id 50 divides.

    Vectors that are null, empty, or hold a null or non-finite component, and
    rows without an id, take no part; ties go to the smaller vec_id; repeated
    rows are queries and candidates of their own; a shorter vector counts as
    filled up with zeros; an empty table gives no rows.
    """
    return topk.search(read_table(spark, sf_dir, "embeddings"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) for every row of ``documents``, from the files.

    Null and empty texts hold the end id alone; null ids come first; rows of one
    doc_id are in the order of a hash of their texts; an empty table gives no
    files and no rows.
    """
    return token_files.written_digests(read_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``documents``.

    A null or empty text, or one without a letter, is ``und`` with score 0, and
    so is every text if no row to learn from has a lang; ties go to the first
    language by name; repeated rows stay; a null doc_id is held out as null; an
    empty table gives no rows.
    """
    found = langid.identified(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): eight rows for each vector of ``embeddings``.

    Vectors that are null, or hold a null or an entry that isn't finite, take no
    part; a shorter one counts as filled up with zeros; repeated rows and null
    ids stay; equal eigenvalues' vectors are any orthonormal ones; directions
    without variance are no components; an empty table gives no rows.
    """
    return whitening.whitened(read_table(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, rank, doc_id, score): for every row of ``benchmark`` its 20 best of ``documents``.

    Texts on either side that are null, empty or without a term are in no row;
    equal scores are ranked by doc_id, nulls last; repeated documents are ranked
    each, repeated items reported each; an empty table on either side gives no
    rows.
    """
    return lexical.ranked(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``documents``, by the law ``rows``.

    Null and empty texts have size 8 and checksum 0; null sources, langs and
    ids come last; repeated rows each have a slot; a group of equal texts, of
    whatever size, is cut where a shard is full; an empty table gives no rows.
    """
    found = sharding.sharded(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def queries() -> dict[str, Query]:
    every = (op1_mixing, op2_url_filter, op3_substring_dedup, op4_html_text, op5_personal_data, op6_simhash, op7_decontamination, op8_topk_search, op9_token_files, op10_language_id, op11_whitening, op12_lexical_search, op13_sharding)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.ORACLE_SQL, "op2_url_filter": url_filter.ORACLE_SQL, "op8_topk_search": topk.ORACLE_SQL, "op12_lexical_search": lexical.ORACLE_SQL, "op13_sharding": sharding.ORACLE_SQL}
