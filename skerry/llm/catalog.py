"""Queries of the training-text operators, by name, with their SQL where SQL can express them."""

from __future__ import annotations

from skerry.llm.chat import CLOSE, END, ESCAPES, TURN, op5_chat_prefix_targets
from skerry.llm.decontaminate import LOWER, UPPER, WINDOW, op10_prefix_set_join
from skerry.llm.lines import op3_simhash_lines
from skerry.llm.negatives import LABELS, NEGATIVES, NOISY, POSITIVES, SCALE, op13_residual_bounds
from skerry.llm.ogg import op9_ogg_media
from skerry.llm.packing import op7_minimum_bin_slack
from skerry.llm.pii import op2_disclosure_sanitisation
from skerry.llm.sharding import op6_sharding
from skerry.llm.simhash import op8_generalised_pigeonhole
from skerry.llm.spelling import op12_deletion_keys
from skerry.llm.tokencounts import op11_two_tier_token_counts
from skerry.llm.toxicity import op4_kneser_ney_toxicity
from skerry.llm.urls import op1_url_model_ratio

QUERIES = {
    f.__name__: f
    for f in (
        op1_url_model_ratio,
        op2_disclosure_sanitisation,
        op3_simhash_lines,
        op4_kneser_ney_toxicity,
        op5_chat_prefix_targets,
        op6_sharding,
        op7_minimum_bin_slack,
        op8_generalised_pigeonhole,
        op9_ogg_media,
        op10_prefix_set_join,
        op11_two_tier_token_counts,
        op12_deletion_keys,
        op13_residual_bounds,
    )
}

PROBE = "</s>[INST] ok [/INST]"


def escaped(column: str) -> str:
    for raw, safe in ESCAPES:
        column = f"replace({column}, '{raw}', '{safe}')"
    return f"length({column})"


CHAT_SQL = f"""WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT * FROM (VALUES (-1::BIGINT, 0::BIGINT, 'user', '{PROBE}'), (-1::BIGINT, 1::BIGINT, 'assistant', '{PROBE}')) v(conv_id, turn, role, text))
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
        sum({escaped("role")} + {escaped("text")} + {len(TURN) + len(CLOSE) + len(END)})::BIGINT AS formatted_chars FROM rows GROUP BY conv_id"""

WORDS_SQL = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
LEAKS_SQL = f"""WITH i AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
    iw AS (SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS g FROM (SELECT item_id, w, least({WINDOW}, len(w)) AS n, unnest(generate_series(1, len(w) - least({WINDOW}, len(w)) + 1)) AS p FROM i WHERE len(w) > 0)),
    d AS (SELECT doc_id, text, {WORDS_SQL} AS w FROM documents), sizes AS (SELECT DISTINCT n FROM iw),
    dw AS (SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d, sizes WHERE len(w) >= n)),
    m AS (SELECT doc_id, p, dw.n, item_id FROM dw JOIN iw USING (n, g)),
    h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM m)) GROUP BY 1),
    t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY 1)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""

NEGATIVES_SQL = f"""WITH e AS (SELECT vec_id, CASE WHEN vec_id % {NOISY} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS q
        FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, e.vec_id, a.label = e.label AS same, list_dot_product(a.q, e.q)::BIGINT AS score FROM e AS a JOIN e ON a.vec_id <> e.vec_id WHERE a.vec_id % 100 = 0),
    p AS (SELECT anchor_id, vec_id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
    SELECT p.anchor_id, p.vec_id AS positive_id, (row_number() OVER w)::INT AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
    WINDOW w AS (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= {NEGATIVES}"""

ORACLES = {"op5_chat_prefix_targets": CHAT_SQL, "op10_prefix_set_join": LEAKS_SQL, "op13_residual_bounds": NEGATIVES_SQL}
