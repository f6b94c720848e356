"""DuckDB equivalents of the queries that SQL can express."""

BLANK_WORDS = r"'[^\x20\x09-\x0D]+'"
ALNUM_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def lower(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


OP1 = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {BLANK_WORDS}) AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w),
h AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM p),
f AS (SELECT h, min(doc_id) AS first FROM h GROUP BY h),
c AS (SELECT DISTINCT h.doc_id, h.i + k AS i FROM h JOIN f USING (h) CROSS JOIN range(50) r(k) WHERE h.doc_id > f.first),
t AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
k AS (SELECT t.doc_id, count(c.i)::BIGINT AS n_removed, coalesce(string_agg(word, ' ' ORDER BY t.i) FILTER (c.i IS NULL), '') AS kept
      FROM t LEFT JOIN c ON t.doc_id = c.doc_id AND t.i = c.i GROUP BY t.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""

WORDS = f"""
SELECT source, lang, count(*)::BIGINT AS n_docs, sum(len(regexp_extract_all(coalesce(text, ''), {BLANK_WORDS})))::BIGINT AS n_tokens
FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.toxic = 1 AND l.doc_id = d.doc_id) GROUP BY ALL
"""

OP3 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({lower("coalesce(text, '')")}, {ALNUM_WORDS}) AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({lower("coalesce(text, '')")}, {ALNUM_WORDS}) AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS s
       FROM (SELECT item_id, ws, least(10, len(ws)) AS m, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS s
       FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT m FROM bw) WHERE len(ws) >= m)),
hit AS (SELECT doc_id, dw.m, i, item_id FROM dw JOIN bw USING (m, s)),
n AS (SELECT doc_id, count(*)::BIGINT AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS k FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP6 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({lower("coalesce(text, '')")}, {BLANK_WORDS}) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 4], ' ')) AS h
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (h) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) least USING (doc_id)
"""


def _op7(powers: dict[str, float], rate: float, rounds: int, seed: str) -> str:
    words = f"len(regexp_extract_all(coalesce(text, ''), {BLANK_WORDS}))::BIGINT"
    steps = [
        f"d AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, {words} AS n_tokens FROM documents)",
        "t AS (SELECT *, CASE WHEN n_tokens < 150 THEN 'note' WHEN n_tokens < 600 THEN 'article' ELSE 'longform' END AS topic FROM d)",
        "c AS (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM t GROUP BY ALL)",
        "w0 AS (SELECT *, tokens::DOUBLE AS weight, " + ", ".join(f"CASE WHEN sum(tokens) OVER (PARTITION BY {d}) > 0 THEN pow((sum(tokens) OVER (PARTITION BY {d}))::DOUBLE, {p}::DOUBLE) ELSE 0 END AS target_{d}" for d, p in powers.items()) + " FROM c)",
    ]
    n = 0
    for _ in range(rounds):
        for d in powers:
            steps.append(f"w{n + 1} AS (SELECT * REPLACE (coalesce(weight * target_{d} / nullif(sum(weight) OVER (PARTITION BY {d}), 0), 0) AS weight) FROM w{n})")
            n += 1
    steps.append(f"f AS (SELECT source, lang, topic, round(coalesce(weight * ({rate}::DOUBLE * (SELECT sum(tokens) FROM w{n})::DOUBLE / (SELECT sum(weight) FROM w{n})) / nullif(tokens::DOUBLE, 0), 0), 9) AS factor FROM w{n})")
    steps.append(f"r AS (SELECT *, ('0x' || substr(md5(doc_id::VARCHAR || '-{seed}'), 1, 13))::BIGINT::DOUBLE / {16**13}::DOUBLE AS u FROM t JOIN f USING (source, lang, topic))")
    return "WITH " + ",\n".join(steps) + """
SELECT doc_id, source, lang, topic, n_tokens, CASE WHEN n_tokens > 0 THEN least(factor, 1::DOUBLE) ELSE 0 END AS probability,
       CASE WHEN n_tokens > 0 THEN greatest(factor, 1::DOUBLE) ELSE 0 END AS weight, n_tokens > 0 AND u < least(factor, 1::DOUBLE) AS selected FROM r
"""


OP7 = _op7({"source": 0.5, "lang": 0.5, "topic": 0.0}, 0.7, 10, "mix-1")


def _op8(rules: list[tuple[str, str, str]], depth: int) -> str:
    """Rules and template trees; `depth` levels of a tree are written out, which is enough for paths of fewer segments than that."""
    fits = " UNION ALL ".join(f"SELECT '{h}' AS h, '{p}' AS p, '{v}' AS v" for h, p, v in rules)
    smoothed = lambda k, n, prior="0.1::DOUBLE": f"(({k}) + {prior} * 5) / (({n}) + 5)::DOUBLE"
    steps = [
        "u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        f"a AS (SELECT page_id, {lower("regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1)")} AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u)",
        f"rules AS ({fits})",
        "best AS (SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM (SELECT DISTINCT host, path FROM a) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL)",
        "j AS (SELECT page_id, host, path, rule, v, [CASE WHEN regexp_full_match(x, '([0-9]+|[0-9a-fA-F-]{8,})([.][A-Za-z0-9]{1,5})?') THEN '*' || regexp_extract(x, '([.][A-Za-z0-9]{1,5})?$') ELSE x END FOR x IN string_split(path, '/') IF x <> ''] AS segments FROM a LEFT JOIN best USING (host, path))",
        "paths AS (SELECT host, segments, count(*) AS n, count(v) AS labelled, count(*) FILTER (v = 'block') AS hits FROM j GROUP BY ALL)",
        "hosts AS (SELECT host, sum(labelled) AS class_n, sum(hits) AS class_k FROM paths GROUP BY ALL)",
        f"l0 AS (SELECT paths.*, []::VARCHAR[] AS made, []::VARCHAR[] AS class, CASE WHEN class_n >= 5 THEN {smoothed('class_k', 'class_n')} END AS near, class_n, class_k, true AS open FROM paths JOIN hosts USING (host))",
    ]
    for i in range(depth):
        steps += [
            f"s{i} AS (SELECT * EXCLUDE (class_n, class_k, open), coalesce(segments[{i + 1}], '') AS s FROM l{i} WHERE open)",
            f"k{i} AS (SELECT host, made, count(*) AS kinds, max(n) / sum(n) AS share FROM (SELECT host, made, s, sum(n) AS n FROM s{i} GROUP BY ALL) GROUP BY ALL)",
            f"t{i} AS (SELECT s{i}.*, CASE WHEN kinds >= 16 AND share <= 0.2::DOUBLE AND s <> '' THEN '*' ELSE s END AS t FROM s{i} JOIN k{i} USING (host, made))",
            f"h{i} AS (SELECT host, class, t, sum(labelled) AS here_n, sum(hits) AS here_k FROM t{i} GROUP BY ALL)",
            f"z{i} AS (SELECT *, sum(here_n) OVER w AS up_n, (sum(here_k) OVER w) / greatest(sum(here_n) OVER w, 1)::DOUBLE AS rate FROM h{i} WINDOW w AS (PARTITION BY host, class))",
            f"c{i} AS (SELECT host, class, t, CASE WHEN here_n >= 5 AND abs(here_k - here_n * rate) / sqrt(greatest(here_n * rate * (1 - rate), 1e-9::DOUBLE)) < 1.96::DOUBLE AND t <> '' THEN '/' ELSE t END AS c FROM z{i})",
            f"m{i} AS (SELECT *, sum(labelled) OVER w AS class_n, sum(hits) OVER w AS class_k, count(*) OVER w AS paths FROM t{i} JOIN c{i} USING (host, class, t) WINDOW w AS (PARTITION BY host, class, c))",
            f"l{i + 1} AS (SELECT host, segments, n, labelled, hits, CASE WHEN t <> '' THEN list_append(made, t) ELSE made END AS made, list_append(class, c) AS class, CASE WHEN class_n >= 5 THEN {smoothed('class_k', 'class_n')} ELSE near END AS near, class_n, class_k, s <> '' AND paths > 1 AS open FROM m{i})",
        ]
    ended = " UNION ALL ".join(f"SELECT host, segments, labelled, hits, near, class_n, class_k, list_concat(made, segments[{i + 2}:]) AS made FROM l{i + 1} WHERE NOT open" for i in range(depth))
    steps += [
        f"e AS (SELECT *, '/' || array_to_string(made, '/') AS template FROM ({ended}))",
        "told AS (SELECT template, host, sum(hits) / sum(labelled)::DOUBLE AS own FROM e GROUP BY ALL HAVING sum(labelled) > 0)",
        "every AS (SELECT template, count(*) AS hosts, sum(own) AS shares FROM told GROUP BY ALL)",
        "x AS (SELECT e.*, (coalesce(shares, 0) - coalesce(own, 0) + 0.5::DOUBLE) / (coalesce(hosts, 0) - (own IS NOT NULL)::INT + 5)::DOUBLE AS across FROM e LEFT JOIN told USING (template, host) LEFT JOIN every USING (template))",
        f"y AS (SELECT host, segments, round(CASE WHEN class_n >= 5 THEN near ELSE {smoothed('class_k', 'class_n', 'coalesce(near, across)')} END, 12) >= 0.8::DOUBLE AS rejected FROM x)",
    ]
    return "WITH " + ",\n".join(steps) + "\nSELECT page_id, host, path, rule, coalesce(v, CASE WHEN rejected THEN 'block' ELSE 'allow' END) AS verdict FROM j LEFT JOIN y USING (host, segments)"


#: Hosts with their subdomains, path beginnings, verdicts: the rules of the query.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
OP8 = _op8(URL_RULES, 4)


def _escaped(text: str) -> str:
    """Lengths only matter: each control string and each backslash grows by one character."""
    return f"(length({text}) + length(regexp_replace({text}, '[^\\\\]', '', 'g')) + len(regexp_extract_all({text}, '<s>|</s>|\\[INST\\]|\\[/INST\\]|<<SYS>>|<</SYS>>|\\[TURN|\\[/TURN\\]')))"


OP5 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, {_escaped("text")} + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 WHEN 'system' THEN 18
        ELSE 17 + {_escaped("role")} + length(({_escaped("role")})::VARCHAR) END AS chars FROM c)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(chars))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

#: All pairs of vectors, and what links lead to.
OP12 = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reached AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a),
c AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""

#: All phrases, all cuts of them, and all longer phrases that hold them.
OP13 = f"""
WITH p AS (SELECT lang, doc_id, unnest(ps) AS piece, unnest(range(len(ps))) AS i
           FROM (SELECT coalesce(lang, 'und') AS lang, doc_id, regexp_split_to_array({lower("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]') AS ps FROM documents)),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
g AS (SELECT lang, d, array_to_string(ws[i:i + d - 1], ' ') AS phrase FROM (SELECT lang, ws, d, unnest(range(1, len(ws) - d + 2)) AS i FROM w CROSS JOIN range(1, 5) r(d))),
f AS (SELECT lang, phrase, d, string_split(phrase, ' ') AS ws, count(*)::BIGINT AS a FROM g GROUP BY lang, phrase, d HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT f.lang, f.phrase, f.a, k, x.a AS l, y.a AS r, (2000000::HUGEINT * f.a) // (x.a + y.a) AS score
      FROM (SELECT *, unnest(range(1, d)) AS k FROM f WHERE d > 1) f
      JOIN f x ON x.lang = f.lang AND x.phrase = array_to_string(f.ws[1:k], ' ') JOIN f y ON y.lang = f.lang AND y.phrase = array_to_string(f.ws[k + 1:], ' ')),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_of AS (SELECT lang, a AS longer, array_to_string(ws[i:i + m - 1], ' ') AS phrase
             FROM (SELECT f.*, m, unnest(range(1, d - m + 2)) AS i FROM f CROSS JOIN range(2, 4) r(m) WHERE m < d)),
h AS (SELECT lang, phrase, max(longer) AS longer FROM inner_of GROUP BY lang, phrase),
k AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank
      FROM b LEFT JOIN h USING (lang, phrase) WHERE h.longer IS NULL OR 100::HUGEINT * h.longer < 80::HUGEINT * b.a)
SELECT k.lang, rank::BIGINT AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM k JOIN n USING (lang) WHERE rank <= 2000
"""
