"""DuckDB SQL of the training-data queries that SQL can express."""

COLLOCATIONS = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM pieces),
totals AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM words GROUP BY lang),
spots AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM words, range(1, 6) AS t(k) WHERE len(ws) >= k),
grams AS (SELECT lang, array_to_string(ws[i:i + k - 1], ' ') AS phrase, k, count(*) AS f FROM spots GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
    SELECT g.lang, g.phrase, g.f AS a, n, c, string_split(g.phrase, ' ') AS ws, g.k
    FROM grams g JOIN totals USING (lang), range(1, 5) AS t(c) WHERE c < g.k),
scored AS (
    SELECT cuts.lang, cuts.phrase, a, n, c, x.f AS l, y.f AS r, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score
    FROM cuts JOIN grams x ON x.lang = cuts.lang AND x.phrase = array_to_string(ws[1:c], ' ')
              JOIN grams y ON y.lang = cuts.lang AND y.phrase = array_to_string(ws[c + 1:], ' ')),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
parts AS (
    SELECT g.lang, g.f, array_to_string(string_split(g.phrase, ' ')[s:s + m - 1], ' ') AS phrase
    FROM grams g, range(1, 6) AS u(s), range(2, 5) AS v(m) WHERE m < g.k AND s + m - 1 <= g.k),
kept AS (
    SELECT * FROM least c
    WHERE NOT EXISTS (SELECT 1 FROM parts p WHERE p.lang = c.lang AND p.phrase = c.phrase AND 100 * p.f >= 100 * c.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
"""

ORACLES: dict[str, str] = {"op11_collocations": COLLOCATIONS}
