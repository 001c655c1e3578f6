"""The training-data queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from labelweave.llm import ann, chat, codes, forest, lines, packing, pieces, secrets, simhash, tokens, toxicity, urls, whitening

QUERIES = {
    "op6_chat": chat.op6_chat,
    "op8_urls": urls.op8_urls,
    "op1_sentencepiece": pieces.op1_sentencepiece,
    "op3_nearest": ann.op3_nearest,
    "op4_forest": forest.op4_forest,
    "op5_line_dedup": lines.op5_line_dedup,
    "op2_secrets": secrets.op2_secrets,
    "op7_toxicity": toxicity.op7_toxicity,
    "op9_simhash": simhash.op9_simhash,
    "op10_packing": packing.op10_packing,
    "op11_token_counts": tokens.op11_token_counts,
    "op12_vector_codes": codes.op12_vector_codes,
    "op13_whitening": whitening.op13_whitening,
}

_LINKED = """
WITH RECURSIVE sound AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b
  ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON vec_id = least.a LEFT JOIN degree ON vec_id = degree.a
"""

#: The others need a tokenizer, a trained model, a hash or a search that SQL lacks; tests compare them with brute force.
ORACLE_SQL: dict[str, str] = {"op4_forest": _LINKED, "op12_vector_codes": codes.codebook_sql()}
