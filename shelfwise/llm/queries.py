"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfwise.llm import (
    benchmark_automaton,
    conversation_repair,
    edit_fingerprints,
    exact_substrings,
    html_text,
    jaccard_join,
    neighbours,
    oracle,
    packing,
    passages,
    piece_sampling,
    quality,
    spelling,
    token_counts,
)


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_neighbours": neighbours.op1,
        "op2_token_counts": token_counts.op2,
        "op3_html_extraction": html_text.op3,
        "op4_substring_dedup": passages.op4,
        "op5_quality_classifier": quality.op5,
        "op6_piece_sampling": piece_sampling.op6,
        "op7_jaccard_join": jaccard_join.op7,
        "op8_fingerprints": edit_fingerprints.op8,
        "op9_suffix_array_dedup": exact_substrings.op9,
        "op10_packing": packing.op10,
        "op11_spelling_variants": spelling.op11,
        "op12_conversation_repair": conversation_repair.op12,
        "op13_benchmark_decontamination": benchmark_automaton.op13,
        "pipeline": _pipeline,
    }


#: Words, three-word shingle sets, links and components, all pairs that share a shingle at once: for small tables.
OP7_SQL = r"""WITH RECURSIVE low AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3
      THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM low
), sizes AS (
  SELECT doc_id, COUNT(*) AS n FROM sets GROUP BY doc_id
), links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, COUNT(*) AS i FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * i >= 90 * (p.n + q.n - i)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT d.doc_id, COALESCE(MAX(z.n), 0) AS n_shingles, MIN(r.b) AS component_id
FROM documents d JOIN reach r ON r.a = d.doc_id LEFT JOIN sizes z ON z.doc_id = d.doc_id
GROUP BY d.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "op7_jaccard_join": OP7_SQL,
        "op11_spelling_variants": oracle.OP11_SQL,
        "op12_conversation_repair": oracle.OP12_SQL,
        "op13_benchmark_decontamination": oracle.OP13_SQL,
    }
