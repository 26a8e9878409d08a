"""DuckDB SQL of those queries for training text that SQL can express."""

from __future__ import annotations

from . import lookalikes

_TOKENS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
_KEPT = "SELECT delivery_id, text FROM messages QUALIFY message_id IS NULL OR channel_id IS NULL OR row_number() OVER (PARTITION BY channel_id, message_id ORDER BY scraped_at DESC NULLS LAST, delivery_id) = 1"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _mapped(sql: str, table: dict[int, str | None]) -> str:
    """``sql`` with characters replaced: one by one, by several, or by none."""
    one = {chr(k): v for k, v in table.items() if v is not None and len(v) == 1}
    sql = f"translate({sql}, {_q(''.join(one))}, {_q(''.join(one.values()))})"
    for k, v in table.items():
        if v is not None and len(v) > 1:
            sql = f"replace({sql}, {_q(chr(k))}, {_q(v)})"
    gone = "".join(chr(k) for k, v in table.items() if v is None)
    return f"regexp_replace({sql}, {_q('[' + gone + ']')}, '', 'g')" if gone else sql


def _shape(sql: str) -> str:
    """What a text looks like: marks of joiners and selectors that stay, the others and all invisible characters dropped, letters of one shape in Latin."""
    e, mark = lookalikes._EMOJI, ""
    pair = _q(f"([{e}️])‍([{e}])")
    for _ in range(2):
        sql = f"regexp_replace({sql}, {pair}, {_q(chr(92) + '1' + mark + chr(92) + '2')}, 'g')"
    keep = _q(f"([{e}0-9#*©®])([︀-️])")
    sql = f"regexp_replace({sql}, {keep}, {_q(chr(92) + '1' + chr(92) + '2')}, 'g')"
    for _ in range(2):
        sql = f"regexp_replace({sql}, {_q('(^|[^])[︀-️]')}, {_q(chr(92) + '1')}, 'g')"
    sql = f"replace(replace(replace({sql}, '‍', ''), '', ''), {_q(mark)}, '‍')"
    return f"nfc_normalize({_mapped(f'nfc_normalize({_mapped(sql, lookalikes._PLAIN)})', lookalikes._SHAPE)})"


_WRITTEN = f"""WITH t AS (
  SELECT DISTINCT 'text' AS field, delivery_id AS key, text AS v FROM messages WHERE text IS NOT NULL UNION ALL SELECT DISTINCT 'title', id, title FROM channels WHERE title IS NOT NULL
), s AS (SELECT v, {_shape('v')} AS shape FROM (SELECT DISTINCT v FROM t) d), j AS (SELECT field, key, t.v, shape FROM t JOIN s ON s.v = t.v),
"""
ORACLES = {
    "p3_found": f"""{_WRITTEN} mixed AS (SELECT field, shape FROM j GROUP BY field, shape HAVING count(DISTINCT v) > 1), k AS (SELECT j.* FROM j JOIN mixed m ON m.field = j.field AND m.shape = j.shape)
SELECT DISTINCT a.field, a.key AS key_a, b.key AS key_b FROM k a JOIN k b ON a.field = b.field AND a.shape = b.shape AND a.key < b.key AND a.v <> b.v""",
    "p3_classes": f"""{_WRITTEN} c AS (SELECT field, shape, min(key) AS class_id, count(DISTINCT v) AS ways, count(*) AS rows FROM j GROUP BY field, shape HAVING count(DISTINCT v) > 1)
SELECT j.field, j.key, c.class_id, c.ways, c.rows FROM j JOIN c ON c.field = j.field AND c.shape = j.shape""",
    "p7_found": f"""WITH RECURSIVE kept AS ({_KEPT}), w AS (SELECT delivery_id, {_TOKENS} AS w FROM kept WHERE text IS NOT NULL),
 sets AS (SELECT delivery_id AS id, list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1])))) AS g FROM w WHERE len(w) >= 40),
 grams AS (SELECT id, unnest(g) AS gram FROM sets), f AS (SELECT gram, count(*) AS n FROM grams GROUP BY gram),
 ranked AS (SELECT g.id, g.gram, s.n AS size, row_number() OVER (PARTITION BY g.id ORDER BY f.n, g.gram) AS pos FROM grams g JOIN f ON f.gram = g.gram JOIN (SELECT id, len(g) AS n FROM sets) s ON s.id = g.id),
 prefix AS (SELECT id, gram FROM ranked WHERE pos <= size - (7 * size + 9) // 10 + 1),
 cand AS (SELECT DISTINCT a.id AS a, b.id AS b FROM prefix a JOIN prefix b ON a.gram = b.gram AND a.id < b.id),
 c AS (SELECT c.a, c.b, len(list_intersect(x.g, y.g)) AS n, len(x.g) + len(y.g) AS total FROM cand c JOIN sets x ON x.id = c.a JOIN sets y ON y.id = c.b),
 link AS (SELECT a, b FROM c WHERE 10 * n >= 7 * (total - n) UNION ALL SELECT b, a FROM c WHERE 10 * n >= 7 * (total - n)),
 reach(id, node) AS (SELECT DISTINCT a, a FROM link UNION SELECT r.id, l.b FROM reach r JOIN link l ON l.a = r.node)
SELECT id AS delivery_id, min(node) AS group_id FROM reach GROUP BY id""",
    "p8_found": f"""WITH d AS (SELECT doc_id, {_TOKENS} AS w FROM documents WHERE text IS NOT NULL),
 i AS (SELECT item_id, {_TOKENS} AS w FROM (SELECT item_id, passage AS text FROM eval_items UNION ALL SELECT item_id, question FROM eval_items) q WHERE text IS NOT NULL),
 dw AS (SELECT doc_id, array_to_string(list_slice(w, k, k + 11), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d) x),
 iw AS (SELECT item_id, array_to_string(list_slice(w, k, k + 11), ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i) x)
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw ON dw.s = iw.s""",
}
