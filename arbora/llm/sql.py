"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from arbora.llm.licenses import TEMPLATES, THRESHOLD, template_rows

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _license_sql() -> str:
    rows = ", ".join(f"({_text(n)}, [{', '.join(map(_text, g))}], {lo}, {hi})" for n, g, lo, hi in template_rows(TEMPLATES, THRESHOLD))
    return rf"""
    WITH templates(name, grams, lo, hi) AS (VALUES {rows}),
    units AS (
      SELECT DISTINCT doc_id, trim(regexp_replace({_LOWER.format('u')}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' ') AS u
      FROM (SELECT doc_id, unnest(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '\n[ \t\r]*\n'))) AS u FROM documents)),
    grams AS (
      SELECT doc_id, u, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g
      FROM (SELECT doc_id, u, string_split(u, ' ') AS w FROM units) WHERE len(w) > 1),
    found AS (
      SELECT doc_id, u, min((-2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + len(grams)), name)) AS best
      FROM grams JOIN templates ON len(g) BETWEEN lo AND hi GROUP BY doc_id, u),
    good AS (SELECT doc_id, struct_extract(best, 1) AS loss, struct_extract(best, 2) AS name, best FROM found WHERE -struct_extract(best, 1) >= {THRESHOLD}),
    per AS (SELECT doc_id, min(best) AS best, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM good GROUP BY doc_id)
    SELECT d.doc_id, struct_extract(best, 2) AS license, -struct_extract(best, 1) AS dice, coalesce(n, 0)::BIGINT AS n_matches, coalesce(names, '') AS licenses
    FROM documents d LEFT JOIN per USING (doc_id)
    """


_JOIN_SQL = rf"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents),
    s AS (
      SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
      FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id != b.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 9 * c >= 4 * (x.n + y.n)),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
    texts AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY array_to_string(w, ' ')) AS text_class, len(w) AS n FROM w),
    linked AS (SELECT a, count(*) AS n, count(DISTINCT CASE WHEN x.text_class != y.text_class THEN y.text_class END) AS t FROM links JOIN texts x ON x.doc_id = a JOIN texts y ON y.doc_id = b GROUP BY a)
    SELECT d.doc_id, (SELECT min(b) FROM reach WHERE a = d.doc_id) AS class_id, coalesce(linked.n, 0)::BIGINT AS n_links, coalesce(linked.t, 0)::BIGINT AS n_text_links,
      CASE WHEN d.n = 0 THEN d.doc_id ELSE d.text_class END AS text_class
    FROM texts d LEFT JOIN linked ON linked.a = d.doc_id
    """

_LEAKS_SQL = rf"""
    WITH items AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM benchmark),
    sized AS (SELECT *, least(13, len(w)) AS n FROM items WHERE len(w) > 0),
    windows AS (SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g FROM sized),
    docs AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents),
    places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows)),
    hits AS (SELECT doc_id, i, p.n, item_id FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM places) p JOIN windows v ON v.n = p.n AND v.g = p.g),
    words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
    found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
      coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM docs d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
    """

ORACLES = {"op1_license_scan": _license_sql(), "op5_jaccard_join": _JOIN_SQL, "op10_decontamination": _LEAKS_SQL}
