"""The corpus operators as registered queries, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import embed_dedup, graph_ann, html_blocks, lattice_sampling, line_chunks, packing, quality, secret_scan, simhash, toxicity
from .shared import table


def tokenizer_path(name: str) -> str:
    """Where the installed public vocabularies lie; they are never copied into the repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(table(spark, sf_dir, "documents"))


def op5_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_ann.nearest(table(spark, sf_dir, "embeddings"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_lattice_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_sampling.sample(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op8_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    return line_chunks.deduplicate(docs, report=True, passages=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_embed_dedup, op3_quality, op4_secret_scan, op5_graph_ann, op6_toxicity, op7_lattice_sampling, op8_html_blocks, op9_packing, op10_line_chunks)}


#: All pairs by cosine, and what each vector reaches by links. The other operators hash, learn, tokenize or approximate,
#: which SQL cannot express; tests hold them against plain versions.
_LINKS = """with recursive v as (select vec_id, cast(embedding as double[]) as e from embeddings where vec_id is not null and embedding is not null
  and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
 l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.95),
 r(a, c) as (select vec_id, vec_id from v union select l.a, r.c from l join r on r.a = l.b),
 c as (select a, min(c) as c from r group by a), n as (select a, count(*) as n from l group by a)
 select vec_id, coalesce(n.n, 0) as n_links, coalesce(c.c, vec_id) as component_id, coalesce(vec_id = coalesce(c.c, vec_id), false) as kept
 from embeddings left join c on c.a = vec_id left join n on n.a = vec_id"""


def oracle_sql() -> dict[str, str]:
    return {"op2_embed_dedup": _LINKS}
