"""DuckDB SQL for the operator queries that SQL can express."""

LOW = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM_WORDS = "regexp_extract_all(" + LOW + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
NONSPACE_WORDS = "regexp_extract_all(" + LOW + r", '[^\x20\x09-\x0D]+')"

DECONTAMINATION = f"""
WITH dw AS (SELECT doc_id, {ALNUM_WORDS.format('text')} AS w FROM documents),
iw AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {ALNUM_WORDS.format('text')} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
        FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM iw)),
dwin AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
         FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
               FROM dw, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, i, n, item_id FROM dwin JOIN win USING (n, win)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

EMBEDDING_NEAR_DEDUP = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT vec_id, label, e FROM v
       WHERE label IS NOT NULL AND len(e) > 0 AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN e])
         AND list_bool_or([x <> 0 FOR x IN e])),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
         WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM comp LEFT JOIN n USING (vec_id)
"""

_ORDER = "ORDER BY turn NULLS FIRST, role, text"
CHAT_FORMATTING = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
           UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {_ORDER})) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' {_ORDER}) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(14 + length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g'))
           + length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

PHRASES = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOW.format('text')}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*)::HUGEINT AS f
      FROM (SELECT lang, m, unnest([array_to_string(w[i:i + m - 1], ' ') FOR i IN range(1, len(w) - m + 2)]) AS phrase
            FROM w, (VALUES (1), (2), (3), (4)) AS sizes(m))
      GROUP BY ALL HAVING count(*) >= 30),
g AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
parts AS MATERIALIZED (SELECT lang, phrase, m, f AS a, k, array_to_string(ws[1:k], ' ') AS p1, array_to_string(ws[k + 1:], ' ') AS p2
                       FROM g, (VALUES (1), (2), (3)) AS cuts(k) WHERE k < m),
cut AS (SELECT parts.*, l.f AS l, r.f AS r, (2000000 * a) // (l.f + r.f) AS score
        FROM parts JOIN f AS l ON l.lang = parts.lang AND l.phrase = p1 JOIN f AS r ON r.lang = parts.lang AND r.phrase = p2),
weak AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
cover AS (SELECT lang, part, max(f) AS f FROM (
            SELECT lang, f, array_to_string(ws[i:i + s - 1], ' ') AS part
            FROM g, (VALUES (2), (3)) AS lengths(s), (VALUES (1), (2), (3)) AS places(i) WHERE s < m AND i + s - 1 <= m)
          GROUP BY ALL),
best AS (SELECT weak.* FROM weak LEFT JOIN cover ON cover.lang = weak.lang AND part = weak.phrase WHERE cover.f IS NULL OR 100 * cover.f < 80 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


def _mixing_rounds(rounds: int) -> str:
    """The queue's rounds: each serves what is left of the entries and of the targets."""
    out = ["q1 AS (SELECT source_no, lap, md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || size) AS key, doc_id, size, n "
           "FROM g, (VALUES (1), (2)) AS laps(lap) WHERE size > 0)",
           "w1 AS (SELECT source_no, target AS want FROM t)"]
    for i in range(1, rounds + 1):
        out += [f"""b{i} AS MATERIALIZED (SELECT q{i}.*, want, coalesce(sum(n * size) OVER (PARTITION BY source_no ORDER BY lap, key, doc_id NULLS FIRST, size
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM q{i} JOIN w{i} USING (source_no) WHERE size <= want)""",
                f"s{i} AS MATERIALIZED (SELECT *, greatest(0, least(n, floor((want - before) / size)))::BIGINT AS copies FROM b{i})",
                f"q{i + 1} AS (SELECT source_no, lap, key, doc_id, size, n - copies AS n FROM s{i} WHERE n > copies)",
                f"""w{i + 1} AS MATERIALIZED (SELECT source_no, any_value(w{i}.want) - coalesce(sum(copies * size), 0)::BIGINT AS want
                    FROM w{i} LEFT JOIN s{i} USING (source_no) GROUP BY 1)"""]
    return ",\n".join(out)


SOURCE_MIXING = rf"""
WITH d AS (SELECT source, doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS source_no FROM d GROUP BY 1),
wt AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(source_no - 1) % 3 + 1] AS weight, (2 * source_size)::DOUBLE AS cap FROM src),
al AS (SELECT 1.5::DOUBLE * sum(source_size)::BIGINT AS budget, sum(weight) AS weights FROM wt),
pre AS (SELECT cap / weight AS ratio, sum(cap) OVER o AS caps, sum(weight) OVER o AS used,
               coalesce(lead(cap / weight) OVER (ORDER BY cap / weight, source_no), 'inf'::DOUBLE) AS next
        FROM wt WINDOW o AS (ORDER BY cap / weight, source_no)
        UNION ALL SELECT 0, 0, 0, min(cap / weight) FROM wt),
lev AS (SELECT coalesce(arg_min((budget - caps) / (weights - used), used) FILTER (WHERE used < weights AND (budget - caps) / (weights - used) < next), 'inf'::DOUBLE) AS level
        FROM pre, al),
t AS MATERIALIZED (SELECT source, source_no, source_size, CASE WHEN cap <= level * weight THEN cap ELSE level * weight END AS target FROM wt, lev),
g AS MATERIALIZED (SELECT source_no, doc_id, size, count(*) AS n FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source GROUP BY ALL),
{_mixing_rounds(3)},
c AS (SELECT source_no, doc_id, size, sum(copies)::BIGINT AS copies
      FROM ({' UNION ALL '.join(f'SELECT source_no, doc_id, size, copies FROM s{i}' for i in (1, 2, 3))}) GROUP BY ALL),
r AS (SELECT g.*, unnest(range(1, n + 1)) AS i FROM g)
SELECT r.doc_id, r.size, source_size, target, (r.size * (coalesce(copies, 0) // n + CASE WHEN i <= coalesce(copies, 0) % n THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r JOIN t USING (source_no) LEFT JOIN c ON c.source_no = r.source_no AND c.doc_id IS NOT DISTINCT FROM r.doc_id AND c.size = r.size
"""
