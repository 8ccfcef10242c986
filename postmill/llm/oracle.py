"""DuckDB SQL of the corpus queries that SQL can express."""

_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_TWO = "('ac.uk', 'co.in', 'co.jp', 'co.kr', 'co.nz', 'co.uk', 'co.za', 'com.ar', 'com.au', 'com.br', 'com.cn', 'com.mx', 'com.tr', 'gov.uk', 'org.uk')"


def _last(n: int) -> str:
    return f"array_to_string(list_slice(string_split(host, '.'), -{n}, -1), '.')"


def _level(name: str, key: str, parent: str, mean: str) -> str:
    """Counts of a level, the weight of its prior, and the posterior."""
    return f"""{name}_n AS (SELECT {key}, {mean} AS mean, sum(n) AS n, sum(bad) AS bad FROM counts{parent} GROUP BY ALL),
        {name}_w AS (SELECT CASE WHEN coalesce(sum(mean * (1 - mean) * (n - 1)), 0) = 0 THEN 1e6 ELSE
            1 / least(greatest((sum(n * pow(bad / n - mean, 2)) - sum(mean * (1 - mean))) / sum(mean * (1 - mean) * (n - 1)), 1e-6), 0.999) - 1 END AS w
          FROM {name}_n WHERE n > 0),
        {name} AS (SELECT {key}, mean * w + bad AS a, (1 - mean) * w + n - bad AS b, (mean * w + bad) / (w + n) AS rate FROM {name}_n, {name}_w)"""

#: Terms of a phrase's words from one place to another.
_WORDS = "array_to_string(list_slice(words, {}, {}), ' ')"

SQL = {
    "op4_ngram_join": f"""
        WITH RECURSIVE parts AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_LOWER}), '[\\x20\\x09-\\x0D]'), lambda x: x <> '') AS words FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
                ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' '))) END AS shingles FROM parts
        ), sized AS (SELECT doc_id, len(shingles) AS n FROM sets),
        each AS MATERIALIZED (SELECT doc_id, unnest(shingles) AS shingle FROM sets),
        common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM each a JOIN each b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL),
        links AS MATERIALIZED (SELECT x, y FROM common JOIN sized p ON p.doc_id = x JOIN sized q ON q.doc_id = y WHERE 100 * shared >= 90 * (p.n + q.n - shared)),
        edges AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reached AS (SELECT doc_id, doc_id AS other FROM sized UNION SELECT reached.doc_id, edges.y FROM reached JOIN edges ON edges.x = reached.other)
        SELECT doc_id, n AS n_shingles, min(other) AS component_id FROM reached JOIN sized USING (doc_id) GROUP BY ALL
    """,
    "op13_phrases": f"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {_LOWER}), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
        ), parts AS (
            SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]'), lambda x: x <> '') AS words FROM pieces
        ), sizes AS (SELECT lang, sum(len(words))::BIGINT AS n FROM parts GROUP BY lang),
        starts AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS s FROM parts),
        grams AS (
            SELECT lang, {_WORDS.format("s", "s + k - 1")} AS phrase, k AS size, count(*) AS a
            FROM starts, (SELECT unnest(range(1, 6)) AS k) WHERE s + k - 1 <= len(words) GROUP BY ALL HAVING count(*) >= 100
        ), found AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS words FROM grams WHERE size > 1),
        cuts AS (
            SELECT lang, phrase, a, {_WORDS.format("1", "c")} AS one, {_WORDS.format("c + 1", "size")} AS two, c
            FROM found, (SELECT unnest(range(1, 5)) AS c) WHERE c < size
        ), scored AS (
            SELECT cuts.lang, cuts.phrase, cuts.a, first.a AS l, rest.a AS r, n, c,
                   ((1000 * cuts.a::HUGEINT * n) // (first.a::HUGEINT * rest.a))::BIGINT AS score
            FROM cuts JOIN grams AS first ON first.lang = cuts.lang AND first.phrase = one
            JOIN grams AS rest ON rest.lang = cuts.lang AND rest.phrase = two JOIN sizes ON sizes.lang = cuts.lang
        ), inside AS (
            SELECT lang, {_WORDS.format("s", "s + k - 1")} AS phrase, max(a) AS longer
            FROM found, (SELECT unnest(range(1, 5)) AS s), (SELECT unnest(range(2, 5)) AS k) WHERE k < size AND s + k - 1 <= size GROUP BY ALL
        ), lowest AS (
            SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::INTEGER AS rank, phrase, a, l, r, n, score
        FROM lowest LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a
        QUALIFY rank <= 2000
    """,
    "op12_hard_negatives": """
        WITH rows AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
            FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scores AS MATERIALIZED (
            SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
            FROM rows a JOIN rows b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
        ), positives AS (
            SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
        )
        SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank,
               other_id AS negative_id, positive_score, score AS negative_score
        FROM positives JOIN scores USING (anchor_id)
        WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        QUALIFY rank <= 3
    """,
    "op3_url_filter": f"""
        WITH outcome AS (
            SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 WHEN toxic IS NOT NULL AND quality IS NOT NULL THEN 0 END) AS bad FROM labels GROUP BY doc_id
        ), page AS (
            SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), {_LOWER}), '') AS host,
                   coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
        ), counts AS (
            SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad,
                   CASE WHEN {_last(2)} IN {_TWO} THEN {_last(3)} ELSE {_last(2)} END AS domain,
                   CASE WHEN {_last(2)} IN {_TWO} THEN {_last(2)} ELSE {_last(1)} END AS suffix
            FROM page LEFT JOIN outcome ON doc_id = page_id GROUP BY host
        ), top AS (SELECT (sum(bad) + 1) / (sum(n) + 2) AS mean FROM counts),
        {_level("s", "suffix", ", top", "top.mean")},
        {_level("d", "domain", " JOIN s USING (suffix)", "s.rate")},
        {_level("h", "host", " JOIN d USING (domain)", "d.rate")},
        rules(rule, name, start, verdict) AS (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
            ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
        ruled AS (SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
            FROM page JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY page_id)
        SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN rate - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
        FROM page LEFT JOIN ruled USING (page_id) JOIN h USING (host)
    """,
    "op1_line_dedup": f"""
        WITH lines AS (
            SELECT row_id, doc_id, line, n, translate(trim(line, {_BLANKS}), {_LOWER}) AS key
            FROM (SELECT row_id, doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS n
                  FROM (SELECT row_number() OVER () AS row_id, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
        ), repeats AS (
            SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE keeper <> doc_id) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
        FROM lines LEFT JOIN repeats USING (key) GROUP BY row_id, doc_id
    """,
}
