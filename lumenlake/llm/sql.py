"""SQL oracles of the text queries that SQL can express: what must hold of a result whatever the model or tokenizer says."""

ORACLE: dict[str, str] = {
    "p6_coverage": "SELECT count(DISTINCT id) AS n_posts, count(DISTINCT id) AS n_confident FROM insta_content WHERE caption IS NOT NULL",
    "p8_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS text_hash FROM documents",
    "p9_checks": "SELECT pack_id, count(*) AS n_documents, 0 AS n_changed, 0 AS n_overfull, 0 AS n_overlaps FROM pack_capacities, documents GROUP BY pack_id",
    "p10_sources": "SELECT coalesce(lower(trim(source)), 'unknown') AS source, count(*) AS n_documents FROM documents GROUP BY 1",
}
