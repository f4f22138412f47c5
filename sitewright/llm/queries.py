"""The dealt operators as registered queries over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .access_codes import encode_codes
from .chosen_path import near_duplicate_classes
from .collocations import collocations
from .common import documents, fold
from .conversation_trie import prefix_trie
from .decontamination import find_contamination
from .language_centroids import fit_languages, identify_languages
from .oracles import COLLOCATIONS, CONTAMINATION, PREFIX_TRIE
from .packing import pack_sequences
from .piece_transducer import encode_pieces
from .quality_network import fit_quality, score_quality
from .robust_outliers import robust_outliers
from .secret_tagger import fit_tagger, scan_secrets
from .surrogates import replace_entities
from .vector_cells import near_duplicate_vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


@query("op2_packing")
def packing(spark, sf_dir):
    pieces = pack_sequences(documents(spark, sf_dir))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query("op8_token_codes")
def token_codes(spark, sf_dir):
    return encode_codes(documents(spark, sf_dir)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op5_quality_network")
def quality_network(spark, sf_dir):
    docs = documents(spark, sf_dir)
    net = fit_quality(docs, documents(spark, sf_dir, "labels"))
    return score_quality(docs, net).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@query("op10_language_centroids")
def language_centroids(spark, sf_dir):
    docs = documents(spark, sf_dir)
    found = identify_languages(docs, fit_languages(docs))
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


@query("op9_chosen_path_join")
def chosen_path_join(spark, sf_dir):
    return near_duplicate_classes(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links", "kept")


@query("op3_surrogates")
def surrogates(spark, sf_dir):
    return replace_entities(documents(spark, sf_dir), length_column="n_chars").select("doc_id", "text", "n_chars", "n_entities")


@query("op6_robust_outliers")
def outliers(spark, sf_dir):
    return robust_outliers(documents(spark, sf_dir))


@query("op7_vector_cells")
def vector_cells(spark, sf_dir):
    return near_duplicate_vectors(documents(spark, sf_dir, "embeddings"))


@query("op1_secret_tagger")
def secret_tagger(spark, sf_dir):
    docs = documents(spark, sf_dir)
    found = scan_secrets(docs, fit_tagger(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


@query("op4_piece_transducer")
def piece_transducer(spark, sf_dir):
    pieces = encode_pieces(documents(spark, sf_dir))
    decoded = F.sha2(F.col("decoded").cast("binary"), 256)
    return pieces.select("doc_id", "n_ids", F.crc32("ids").alias("ids_crc32"), decoded.alias("decoded_sha256"))


@query("op11_prefix_trie", PREFIX_TRIE)
def conversation_trie(spark, sf_dir):
    return prefix_trie(documents(spark, sf_dir, "conversations"))


@query("op12_collocations", COLLOCATIONS)
def phrase_collocations(spark, sf_dir):
    return collocations(documents(spark, sf_dir))


@query("op13_contamination", CONTAMINATION)
def contamination(spark, sf_dir):
    found = find_contamination(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed, "contaminated")
