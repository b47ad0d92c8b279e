"""SQL counterparts of the queries that SQL can express over whole tables."""

from __future__ import annotations

_ESCAPED = r"replace(replace(replace({x}, '\', '\s'), '#', '\h'), '<', '\l')"

_CHAT = rf"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
    coalesce(sum(length(t)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    sum(4 + length(replace({_ESCAPED.format(x='role')}, ':', '\c')) + 2 + length({_ESCAPED.format(x='t')}) + 8)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

_MIX = r"""
WITH d AS (
    SELECT doc_id, coalesce(source, chr(1114111)) AS k, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
        md5(concat_ws('|', '17', coalesce(doc_id::VARCHAR, 'null'), md5(coalesce(text, '')))) AS draw,
        row_number() OVER (PARTITION BY source, doc_id, text) AS copy
    FROM documents
), s AS (
    SELECT k, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY k)) - 1) % 3 + 1 AS w FROM d GROUP BY k
), o AS (
    SELECT *, source_size / w AS ratio, sum(source_size) OVER () AS budget FROM s
), lv AS (
    -- the level with the sources below a ratio clamped; clamping too few or too many gives a lower one
    SELECT a.ratio, (any_value(a.budget) - coalesce(sum(3 * b.source_size) FILTER (WHERE b.ratio < a.ratio), 0))::DOUBLE
        / sum(b.w) FILTER (WHERE b.ratio >= a.ratio) AS level
    FROM o a, o b GROUP BY a.ratio
), best AS (
    SELECT max(level) AS level FROM lv
), t AS (
    SELECT k, source_size, least(source_size::DOUBLE * 3, level * w) AS target FROM s, best
), f AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t
), r AS (
    SELECT d.doc_id, d.size, f.source_size, f.target, f.whole, f.target - f.whole * f.source_size AS wanted,
        sum(d.size) OVER (PARTITION BY d.k ORDER BY d.draw, d.copy) AS through, d.size AS own
    FROM d JOIN f USING (k)
)
SELECT doc_id, size, source_size, target,
    (size * (whole + CASE WHEN through - own / 2.0 < wanted THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""

_TERMS = r"regexp_extract_all(translate(coalesce({x}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

_SEARCH = rf"""
WITH i AS (
    SELECT item_id, unnest(list_distinct({_TERMS.format(x='text')})) AS term FROM benchmark
), t AS (
    SELECT row_number() OVER () AS r, doc_id, {_TERMS.format(x='text')} AS terms FROM documents
), s AS (
    SELECT count(*) FILTER (len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM t
), c AS (
    SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM t)
    WHERE term IN (SELECT term FROM i) GROUP BY ALL
), w AS (
    SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM c, s GROUP BY term
), p AS (
    SELECT r, doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms)) AS impact FROM c, s
), scored AS (
    SELECT item_id, r, doc_id, sum(w * impact)::BIGINT AS score FROM i JOIN w USING (term) JOIN p USING (term) GROUP BY ALL
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""

_MIDDLE = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, 'null')) AS h
    FROM documents
), k AS (
    SELECT doc_id, t, u, len(u)::BIGINT AS n, [('0x' || h[x:x + 7])::BIGINT FOR x IN [1, 9, 17, 25]] AS h FROM d
), c AS (
    SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS low, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS high,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
             WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM k
), p AS (
    SELECT doc_id, t, n, form, array_to_string(u[1:low], '') AS prefix, array_to_string(u[low + 1:high], '') AS middle,
        array_to_string(u[high + 1:], '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM p
"""

LLM_SQL: dict[str, str] = {
    "op4_chat_format": _CHAT, "op10_mixing": _MIX, "op12_ranked_search": _SEARCH, "op13_fill_middle": _MIDDLE,
}
