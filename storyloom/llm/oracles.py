"""SQL that says the same as those queries of this subpackage that SQL can express."""

from __future__ import annotations

import string

_LOWER = f"translate({{}}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"


def _escaped(column: str, *more: str) -> str:
    """The template's escapes of a column."""
    for plain in ("\\", "###", "</turn>", *more):
        column = f"replace({column}, '{plain}', '\\{plain}')"
    return column


_SAID = "\\### Assistant: </turn> ok"
CHAT = (
    f"WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '{_SAID}' UNION ALL SELECT -7, 1, 'assistant', '{_SAID}'), "
    f"p AS (SELECT *, concat('### ', {_escaped('role', ':')}, ': ', {_escaped('text')}, '</turn>', chr(10)) AS piece FROM t) "
    "SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, "
    "sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(length(piece)) AS BIGINT) AS formatted_chars FROM p GROUP BY 1"
)

NEAR = (
    f"WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER.format('text'))} AS w FROM documents), "
    "s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1])) ELSE w END) AS g FROM d), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), "
    "p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2), l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)), "
    "e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r AS (SELECT doc_id, doc_id AS z FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.z = e.a) "
    "SELECT doc_id, coalesce(max(n), 0) AS n_shingles, min(z) AS component_id, doc_id = min(z) AS kept FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id"
)

_ITEM_WORDS = f"regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
DECONTAMINATION = (
    f"WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ITEM_WORDS} AS w FROM benchmark), p AS (SELECT item, least(13, len(w)) AS k, w FROM i WHERE len(w) > 0), "
    "q AS (SELECT DISTINCT item, k, array_to_string(w[j : j + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS j FROM p)), "
    f"d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents), x AS (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS j FROM d JOIN (SELECT DISTINCT k FROM q) ON len(w) >= k), "
    "h AS (SELECT doc_id, j, x.k AS k, item FROM (SELECT doc_id, k, j, array_to_string(w[j : j + k - 1], ' ') AS g FROM x) x JOIN q USING (k, g)), "
    "n AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + k)) AS pos FROM h) GROUP BY 1), m AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY 1) "
    "SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"
)

SUBSTRINGS = (
    f"WITH d AS (SELECT doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents), x AS (SELECT doc_id, j, array_to_string(w[j : j + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS j FROM d)), "
    "r AS (SELECT doc_id, j FROM x QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, j) > 1), g AS (SELECT DISTINCT doc_id, unnest(range(j, j + 20)) AS k FROM r), "
    "k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS kept, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d) ANTI JOIN g USING (doc_id, k) GROUP BY 1) "
    "SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"
)

_VECTORS = "FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0"
HARD_NEGATIVES = (
    f"WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x {_VECTORS} AND label IS NOT NULL), "
    "s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0), "
    "p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5), "
    "n AS (SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank "
    "FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score) SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"
)

SQL = {
    "op1_chat_formatting": CHAT,
    "op2_minhash_near_dedup": NEAR,
    "op6_benchmark_decontamination": DECONTAMINATION,
    "op7_sharding": "SELECT doc_id, source, CAST(strlen(text) AS BIGINT) AS n_bytes, sha256(text) AS text_sha256 FROM documents",
    "op9_substring_dedup": SUBSTRINGS,
    "op13_hard_negatives": HARD_NEGATIVES,
}
