"""DuckDB SQL with the rows of each registered query."""

from __future__ import annotations


def _unescape(x: str) -> str:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{char}')"
    return x


def _strip(x: str, *patterns: str) -> str:
    for p in patterns:
        x = f"regexp_replace({x}, '{p}', ' ', 'g')"
    return x


def _plain(x: str) -> str:
    return f"trim({_strip(_unescape(x), r'\s+')})"


def _between(tag: str) -> str:
    return _plain(_strip(f"regexp_extract(html, '(?is)<{tag}[^>]*>(.*?)</{tag}>', 1)", "(?s)<[^>]*>"))


def _tokens(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


def _u64(x: str) -> str:
    return f"CAST(('0x' || substr(sha256({x}), 1, 16))::UBIGINT AS DECIMAL(20,0))"


BODY = _plain(_strip("html", r"(?is)<head(\s[^>]*)?>.*?</head>", "(?is)<script[^>]*>.*?</script>", "(?is)<style[^>]*>.*?</style>", "(?s)<!--.*?-->", "(?s)<[^>]*>"))
TEXT = f"""
px AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
pt AS (SELECT page_id, url, html, {_between('title')} AS title, {_between('h1')} AS h1, {BODY} AS body FROM px),
pd AS (SELECT *, substr(regexp_extract(body, '^[^.!?]*[.!?]?', 0), 1, 200) AS description FROM pt)"""
INDEX = f"""{TEXT},
idx AS (SELECT {_u64('url')} AS id, page_id, url, coalesce(nullif(title, ''), nullif(h1, ''), '') AS title, description, body,
               CAST(1704067200 + page_id * 60 AS BIGINT) AS "timestamp"
        FROM pd QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id DESC) = 1)"""


def _keywords(source: str) -> str:
    """Direct and related keywords of the pages of a source with id and body, and their texts by id."""
    return f"""
tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({_tokens('body')}) AS term FROM {source}) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
dk AS (SELECT id, term, round(tf * ln(CAST((SELECT count(*) FROM {source}) AS DOUBLE) / df), 6) AS weight FROM tf JOIN df USING (term)),
dr AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY weight DESC, term) AS INTEGER) AS rank FROM dk QUALIFY rank <= 25),
pr AS (SELECT x.term AS a, y.term AS b, count(*) AS both_ FROM dr x JOIN dr y ON x.id = y.id AND x.term <> y.term GROUP BY ALL HAVING count(*) >= 2),
o AS (SELECT term, count(*) AS c FROM dr GROUP BY ALL),
pa AS (SELECT a, b, round(ln(both_ * CAST((SELECT count(DISTINCT id) FROM dr) AS DOUBLE) / (CAST(oa.c AS DOUBLE) * ob.c)), 6) AS pmi FROM pr JOIN o oa ON oa.term = a JOIN o ob ON ob.term = b),
nr AS (SELECT dr.id, b AS term, round(sum(pmi), 6) AS weight FROM dr JOIN pa ON pa.a = dr.term GROUP BY ALL),
rr AS (SELECT id, term, weight, CAST(row_number() OVER (PARTITION BY id ORDER BY weight DESC, term) AS INTEGER) AS rank
       FROM nr WHERE NOT EXISTS (SELECT 1 FROM tf WHERE tf.id = nr.id AND tf.term = nr.term) QUALIFY rank <= 25),
dt AS (SELECT id, string_agg(term, ' ' ORDER BY rank) AS k FROM dr GROUP BY id),
rt AS (SELECT id, string_agg(term, ' ' ORDER BY rank) AS k FROM rr GROUP BY id)"""


RECORDS = f"""{INDEX}, {_keywords('idx')},
rec AS MATERIALIZED (SELECT idx.*, coalesce(dt.k, '') AS direct_keywords, coalesce(rt.k, '') AS related_keywords FROM idx LEFT JOIN dt USING (id) LEFT JOIN rt USING (id))"""
FIELDS = ("title", "description", "direct_keywords", "related_keywords")


def _words(source: str, fields: tuple[str, ...]) -> str:
    return " UNION ALL ".join(f"SELECT '{f}' AS field, id, unnest({_tokens(f)}) AS term, unnest(range(len({_tokens(f)}))) AS pos FROM {source}" for f in fields)


def _post(source: str = "rec", name: str = "post", fields: tuple[str, ...] = FIELDS) -> str:
    return f"""
{name}_w AS ({_words(source, fields)}),
{name} AS (SELECT field, term, id, CAST(count(*) AS INTEGER) AS tf, list(pos ORDER BY pos) AS positions FROM {name}_w GROUP BY ALL)"""


STATS = """
dl AS (SELECT field, id, sum(tf) AS dl FROM post GROUP BY ALL),
fs AS (SELECT field, count(*) AS n, avg(dl) AS avgdl FROM dl GROUP BY ALL),
ts AS (SELECT field, term, count(*) AS df FROM post GROUP BY ALL)"""
ASKED = f"""
q AS (SELECT page_id AS query_id, title AS text, {_tokens('title')} AS w FROM idx WHERE page_id % 100 = 0),
qt AS (SELECT DISTINCT query_id, unnest(w) AS term FROM q)"""


def _scores(fields: str = "true") -> str:
    return f"""
sc AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
       FROM post JOIN qt USING (term) JOIN ts USING (field, term) JOIN dl USING (field, id) JOIN fs USING (field) WHERE {fields} GROUP BY ALL)"""


def _search(where: str = "true", low: int = 0, high: int = 15, fields: str = "true") -> str:
    return f"""WITH {RECORDS}, {_post()}, {STATS}, {ASKED}, {_scores(fields)},
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc WHERE {where})
SELECT query_id, CAST(rank AS INTEGER) AS rank, score, title, description, "timestamp", url FROM rk JOIN idx USING (id) WHERE rank > {low} AND rank <= {high}"""


CAPTURES = """
v_captures AS (SELECT e.event_id AS seq, p.page_id, p.url, e.user_id, CAST(floor(epoch(e.ts)) AS BIGINT) AS ts,
                      CASE WHEN e.event_type = 'error' THEN 'delete' ELSE 'index' END AS op
               FROM events e JOIN pages p ON p.page_id = e.event_id % (SELECT count(*) FROM pages))"""
USERS = """
v_users AS (SELECT CAST(c_custkey + 1 AS BIGINT) AS id, CAST((c_custkey + 1) // 4 AS BIGINT) AS parent_id, 'u' || CAST(c_custkey + 1 AS VARCHAR) AS username,
                   CAST(1704067200 + c_custkey * 3600 AS BIGINT) AS creation_datetime, c_name AS secret, c_mktsegment AS invite_secret,
                   CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_custkey % 3 AS INTEGER) END AS invite_counter FROM customer)"""
SESSIONS = """
v_sessions AS (SELECT sha256(CAST(event_id AS VARCHAR)) AS key, 'host' || CAST(event_id % 3 AS VARCHAR) AS host, user_id,
                      CAST(floor(epoch(ts)) AS BIGINT) AS creation_datetime, CAST(floor(epoch(ts)) AS BIGINT) + 86400 AS expires_at_datetime
               FROM events WHERE event_type = 'signup')"""
REQUESTS = """
v_requests AS (SELECT event_id AS request_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts,
                      sha256(CAST(event_id - 1 AS VARCHAR)) || '@host' || CAST((event_id - 1) % 4 AS VARCHAR) AS session_key
               FROM events WHERE event_type = 'click')"""
FILES = """
v_files AS (SELECT doc_id AS id, sha256(text) AS hash, source || '/' || CAST(doc_id AS VARCHAR) AS filename,
                   CAST(octet_length(encode(text)) AS BIGINT) AS size, CAST(doc_id % 2 AS INTEGER) AS is_public FROM documents)"""
RESOLVED = f"""{REQUESTS}, {SESSIONS}, {USERS},
rs AS (SELECT request_id, r.host, s.user_id AS session_user, u.username
       FROM (SELECT request_id, split_part(session_key, '@', 1) AS key, split_part(session_key, '@', 2) AS host FROM v_requests) r
       LEFT JOIN v_sessions s ON s.key = r.key AND s.host = r.host AND s.expires_at_datetime > 1705276800 AND s.host IN ('host0', 'host1', 'host2')
       LEFT JOIN v_users u ON u.id = s.user_id)"""
LATEST = "QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq DESC) = 1"
TREE = """
e AS (SELECT u.id, p.id AS parent FROM v_users u LEFT JOIN v_users p ON p.id = u.parent_id),
dep AS (SELECT id, 0 AS depth FROM e WHERE parent IS NULL UNION ALL SELECT e.id, depth + 1 FROM e JOIN dep ON e.parent = dep.id)"""
BELOW = """
roots AS (SELECT id, 0 AS depth FROM v_users WHERE id % 40 = 3),
dsc AS (SELECT * FROM roots UNION ALL SELECT u.id, depth + 1 FROM v_users u JOIN dsc ON u.parent_id = dsc.id),
gone AS (SELECT id, min(depth) AS depth FROM dsc GROUP BY id)"""


def _deleted(gone: str) -> str:
    return f"""WITH RECURSIVE {USERS}, {SESSIONS}, {BELOW}, g AS ({gone})
SELECT u.id, CASE WHEN u.parent_id NOT IN (SELECT id FROM g) THEN u.parent_id END AS parent_id,
       (SELECT count(*) FROM v_sessions WHERE user_id NOT IN (SELECT id FROM g)) AS sessions_left, (SELECT count(*) FROM g) AS n
FROM v_users u WHERE id NOT IN (SELECT id FROM g)"""


LINES = "f AS (SELECT source, doc_id // 1000 AS part, string_agg(to_base64(encode(coalesce(text, ''))), chr(10) ORDER BY doc_id) || chr(10) AS c FROM documents GROUP BY ALL)"
CHANGED = f"""{RECORDS}, now AS (SELECT id, url, "timestamp", direct_keywords, related_keywords, CASE WHEN page_id % 7 = 3 THEN title || ' ' || description ELSE title END AS title,
    CASE WHEN page_id % 7 = 3 THEN title ELSE description END AS description FROM rec WHERE page_id % 7 <> 5), {_post('now')}"""
POSITIONS = "SELECT field, term, id, tf, array_to_string(positions, ' ') AS positions"
ORACLES = {
    "page_text": f"WITH {TEXT} SELECT page_id, url, title, h1, body, description, coalesce(nullif(title, ''), nullif(h1, ''), url, '') AS shown_title FROM pd",
    "page_ids": f"SELECT page_id, {_u64('url')} AS id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS origin FROM pages",
    "page_tokens": f"WITH {TEXT} SELECT page_id, CAST(unnest(range(len({_tokens('body')}))) AS INTEGER) AS pos, unnest({_tokens('body')}) AS term FROM pd",
    "postings": f"WITH {RECORDS}, {_post()} {POSITIONS} FROM post",
    "corpus_stats": f"WITH {RECORDS}, {_post()}, {STATS} SELECT field, term, df, n, round(avgdl, 6) AS avgdl FROM ts JOIN fs USING (field)",
    "direct_keywords": f"WITH {INDEX}, {_keywords('idx')} SELECT id, term, weight, rank FROM dr",
    "related_keywords": f"WITH {INDEX}, {_keywords('idx')} SELECT id, term, weight, rank FROM rr",
    "page_records": f"""WITH {TEXT}, {CAPTURES},
lc AS (SELECT url, ts, user_id FROM v_captures WHERE op = 'index' {LATEST}),
p AS (SELECT {_u64('url')} AS id, pd.*, lc.ts, lc.user_id FROM (SELECT * FROM pd QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id DESC) = 1) pd JOIN lc USING (url)),
{_keywords('p')}
SELECT id, url, coalesce(nullif(title, ''), nullif(h1, ''), url, '') AS title, description, coalesce(dt.k, '') AS direct_keywords, coalesce(rt.k, '') AS related_keywords, ts AS "timestamp", user_id,
       CASE WHEN page_id % 2 = 0 THEN sha256(html) ELSE '' END AS image_hash, CASE WHEN page_id % 2 = 0 THEN CAST(page_id AS VARCHAR) || '.jpg' ELSE '' END AS image_filename
FROM p LEFT JOIN dt USING (id) LEFT JOIN rt USING (id)""",
    "search_any": _search(),
    "search_topk": f"WITH {RECORDS}, {_post()}, {STATS}, {ASKED}, {_scores()} SELECT query_id, id, score FROM sc ORDER BY score DESC, query_id, id LIMIT 10",
    "search_page2": _search(low=15, high=30),
    "search_fields": _search(fields="field = 'title'"),
    "search_must": _search("EXISTS (SELECT 1 FROM q JOIN post p ON p.term = q.w[1] WHERE q.query_id = sc.query_id AND p.id = sc.id) OR (SELECT len(w) FROM q WHERE q.query_id = sc.query_id) = 0"),
    "search_must_not": _search("NOT EXISTS (SELECT 1 FROM q JOIN post p ON p.term = q.w[2] WHERE q.query_id = sc.query_id AND p.id = sc.id)"),
    "search_phrase": _search("EXISTS (SELECT 1 FROM q JOIN post_w x ON x.term = q.w[1] JOIN post_w y ON y.field = x.field AND y.id = x.id AND y.pos = x.pos + 1 AND y.term = q.w[2] WHERE q.query_id = sc.query_id AND x.id = sc.id) OR EXISTS (SELECT 1 FROM q JOIN post p ON p.term = q.w[1] WHERE len(q.w) = 1 AND q.query_id = sc.query_id AND p.id = sc.id)"),
    "search_time": _search('EXISTS (SELECT 1 FROM idx WHERE idx.id = sc.id AND idx."timestamp" BETWEEN 1704067200 AND 1704073200)'),
    "lookup_url": f"WITH {INDEX}, {CAPTURES} SELECT id, url, title FROM idx WHERE url IN (SELECT url FROM v_captures WHERE seq % 100 = 0)",
    "latest_by_url": f"WITH {CAPTURES} SELECT * FROM v_captures {LATEST}",
    "upsert_pages": f"""WITH {CAPTURES}, l AS (SELECT * FROM v_captures WHERE op = 'index'),
old AS (SELECT * FROM l WHERE seq % 2 = 0 {LATEST}), new AS (SELECT * FROM l WHERE seq % 2 = 1 {LATEST})
SELECT * FROM old WHERE url NOT IN (SELECT url FROM new) UNION ALL SELECT * FROM new""",
    "apply_log": f"WITH {CAPTURES}, l AS (SELECT * FROM v_captures {LATEST}) SELECT * FROM l WHERE op = 'index'",
    "delete_by_url": f"WITH {CAPTURES}, l AS (SELECT * FROM v_captures WHERE op = 'index' {LATEST}) SELECT * FROM l WHERE url NOT IN (SELECT url FROM v_captures WHERE op = 'delete')",
    "update_postings": f"""WITH {RECORDS}, ix2 AS (SELECT id, direct_keywords, related_keywords, CASE WHEN page_id % 7 = 3 THEN title || ' ' || description ELSE title END AS title, CASE WHEN page_id % 7 = 3 THEN title ELSE description END AS description FROM rec),
{_post('ix2')} {POSITIONS} FROM post""",
    "recent_captures": f"WITH {CAPTURES} SELECT * FROM v_captures WHERE op = 'index' ORDER BY seq DESC LIMIT 15",
    "session_users": f"WITH {RESOLVED} SELECT * FROM rs",
    "valid_at_request": f"WITH {REQUESTS}, {SESSIONS} SELECT * FROM v_requests r WHERE EXISTS (SELECT 1 FROM v_sessions s WHERE s.user_id = r.user_id AND r.ts >= s.creation_datetime AND r.ts < s.expires_at_datetime)",
    "access_decision": f"WITH {RESOLVED} SELECT *, CASE WHEN username IS NULL THEN 'missing_user' WHEN host <> 'host0' THEN 'foreign' WHEN username <> 'admin' THEN 'not_admin' ELSE 'ok' END AS access FROM rs",
    "user_lookup": f"""WITH {USERS}, i AS (SELECT DISTINCT CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE 'u' || CAST(user_id AS VARCHAR) END AS ident FROM events)
SELECT ident, id, username FROM i JOIN v_users u ON CASE WHEN regexp_matches(ident, '^[0-9]+$') THEN try_cast(ident AS BIGINT) = u.id ELSE ident = u.username END""",
    "key_lookup": f"WITH {SESSIONS}, {REQUESTS} SELECT * FROM v_sessions WHERE key IN (SELECT split_part(session_key, '@', 1) FROM v_requests)",
    "user_listing": f"WITH {USERS} SELECT id, parent_id, username, creation_datetime FROM v_users",
    "redacted_users": f"WITH {USERS} SELECT username, creation_datetime FROM v_users",
    "valid_names": f"WITH {USERS}, n AS (SELECT id, CASE WHEN id % 4 = 0 THEN username || ' x' ELSE username END AS username FROM v_users) SELECT id, username, regexp_matches(username, '^[a-zA-Z0-9]+$') AS valid FROM n",
    "child_counts": f"WITH {USERS} SELECT id, (SELECT count(*) FROM v_users c WHERE c.parent_id = u.id AND c.parent_id <> 0) AS children FROM v_users u",
    "tree_stats": f"""WITH RECURSIVE {USERS}, {TREE} SELECT count(*) AS total, round(coalesce(sum(CASE WHEN parent_id <> 0 THEN 1 ELSE 0 END) / count(*), 0), 1) AS average_invites,
       (SELECT coalesce(max(depth), -1) + 1 FROM dep) AS levels FROM v_users""",
    "tree_depth": f"WITH RECURSIVE {USERS}, {TREE} SELECT id, depth FROM dep",
    "descendants": f"WITH RECURSIVE {USERS}, {BELOW} SELECT id, depth FROM gone",
    "tree_parents": f"WITH {USERS} SELECT u.id, p.id AS parent FROM v_users u LEFT JOIN v_users p ON p.id = u.parent_id",
    "delete_one": _deleted("SELECT id FROM roots"),
    "delete_tree": _deleted("SELECT id FROM gone"),
    "bump_counters": f"""WITH {USERS} SELECT id, CAST(coalesce(invite_counter, 0) + (SELECT count(*) FROM events WHERE event_type = 'signup' AND user_id = v_users.id) AS BIGINT) AS invite_counter FROM v_users""",
    "add_sessions": f"""WITH {SESSIONS} SELECT * FROM v_sessions UNION ALL SELECT sha256('p' || CAST(event_id AS VARCHAR)), 'host0', user_id, CAST(floor(epoch(ts)) AS BIGINT), CAST(floor(epoch(ts)) AS BIGINT) + 86400
FROM events WHERE event_type = 'purchase'""",
    "live_sessions": f"WITH {SESSIONS} SELECT * FROM v_sessions WHERE expires_at_datetime > 1705276800 AND host IN ('host0', 'host1', 'host2')",
    "age_labels": f"""WITH {USERS}, a AS (SELECT id, creation_datetime AS c, CAST(floor((1709251200 - creation_datetime) / 86400) AS BIGINT) AS days FROM v_users)
SELECT id, CASE WHEN days = 0 THEN 'Today' WHEN days = 1 THEN 'Yesterday' WHEN days < 7 THEN days || ' days ago' WHEN days < 30 THEN (days // 7) || ' weeks ago'
       ELSE strftime(make_timestamp(c * 1000000), '%b %-d, %Y') END AS label FROM a""",
    "file_dedup": f"""WITH {FILES} SELECT id, hash, first_value(id) OVER w AS stored_id, first_value(filename) OVER w AS stored_filename, row_number() OVER w = 1 AS is_first FROM v_files WINDOW w AS (PARTITION BY hash ORDER BY id)""",
    "visible_files": f"WITH {FILES} SELECT id, hash, filename, size FROM v_files WHERE is_public = 1",
    "file_access": f"""WITH {FILES} SELECT event_id AS request_id, event_id * 3 AS file_id, CASE WHEN is_public IS NULL THEN 'no_metadata' WHEN is_public = 0 AND event_type <> 'click' THEN 'private' ELSE 'ok' END AS decision
FROM events LEFT JOIN v_files ON id = event_id * 3""",
    "stored_contents": f"WITH {FILES} SELECT hash, size, hash AS content_hash FROM v_files WHERE hash NOT IN (SELECT hash FROM v_files WHERE id % 10 = 0) QUALIFY row_number() OVER (PARTITION BY hash ORDER BY id) = 1",
    "annotation_parse": """SELECT event_id, CASE WHEN event_id % 5 > 0 THEN event_type END AS title, CASE WHEN event_id % 5 > 0 THEN event_type || ' ' || CAST(user_id AS VARCHAR) END AS direct_keywords,
       CASE WHEN event_id % 5 > 0 THEN '' END AS related_keywords, CASE WHEN event_id % 5 > 0 THEN '' END AS description, event_id % 5 > 0 AS parsed FROM events""",
    "stream_log": f"WITH {CAPTURES}, l AS (SELECT * FROM v_captures {LATEST}) SELECT * FROM l WHERE op = 'index'",
    "stream_ingest": f"""WITH {RECORDS}, {CAPTURES}, l AS (SELECT url, ts, user_id, seq, op FROM v_captures {LATEST})
SELECT id, url, title, description, direct_keywords, related_keywords, ts AS "timestamp", user_id, seq FROM l JOIN rec USING (url) WHERE op = 'index'""",
    "stream_postings": f"""WITH {RECORDS}, {CAPTURES}, l AS (SELECT url, op FROM v_captures {LATEST}), rl AS (SELECT * FROM rec WHERE url IN (SELECT url FROM l WHERE op = 'index')), {_post('rl')} {POSITIONS} FROM post""",
    "read_table": "SELECT doc_id, lang, source, n_chars FROM documents",
    "read_captures": f"WITH {CAPTURES} SELECT seq, url, user_id, ts, op, page_id % 2 = 0 AS stored, CAST(page_id AS VARCHAR) || '.jpg' AS image_filename FROM v_captures",
    "read_contents": f"WITH {LINES} SELECT source, CAST(part AS BIGINT) AS part, CAST(strlen(c) AS BIGINT) AS length, sha256(c) AS content_hash FROM f",
    "chained_files": f"""WITH {LINES} SELECT source, CAST(part AS BIGINT) AS part, CAST(strlen(c) AS BIGINT) AS length, lower(hex(list_reduce(
  list_transform(range(CAST(ceil(strlen(c) / 4096) AS BIGINT)), lambda i: unhex(sha256(array_slice(encode(c), i * 4096 + 1, (i + 1) * 4096)))), lambda a, x: unhex(sha256(a || x)), ''::BLOB))) AS chained FROM f""",
    "add_users": f"""WITH {USERS} SELECT id, parent_id, username, creation_datetime, CAST(invite_counter AS INTEGER) AS invite_counter FROM v_users
UNION ALL SELECT CAST(s_suppkey + 1000000 AS BIGINT), 1, 's' || CAST(s_suppkey AS VARCHAR), 1705276800, 0 FROM supplier""",
    "add_files": f"""WITH {FILES}, f AS (SELECT *, row_number() OVER (PARTITION BY hash, id % 2 ORDER BY id) AS k FROM v_files)
SELECT id, hash, filename, size, is_public FROM f WHERE k = 1 AND (id % 2 = 0 OR hash NOT IN (SELECT hash FROM v_files WHERE id % 2 = 0))""",
    "chained_hash": """SELECT doc_id AS id, CASE WHEN t = '' THEN '' ELSE lower(hex(list_reduce(
  list_transform(range(CAST(ceil(octet_length(encode(t)) / 1024) AS BIGINT)), lambda i: unhex(sha256(array_slice(encode(t), i * 1024 + 1, (i + 1) * 1024)))),
  lambda a, c: unhex(sha256(a || c)), ''::BLOB))) END AS chained FROM (SELECT doc_id, text AS t FROM documents)""",
    "annotate_hook": f"""WITH {TEXT} SELECT page_id, 'page' AS direct_keywords, CAST(length(CASE WHEN page_id % 2 = 0 THEN 'Annotate the page ' || url || ' titled ' || title ELSE 'Annotate the image captured at ' || url END
  || '. Answer with title, up to 25 direct_keywords, up to 25 related_keywords and a short description as JSON.') AS VARCHAR) AS title FROM pd""",
    "stream_recent": f"WITH {CAPTURES} SELECT * FROM v_captures WHERE op = 'index' ORDER BY seq DESC LIMIT 15",
    "stream_sessions": f"""WITH {REQUESTS}, {SESSIONS} SELECT request_id, r.ts, s.user_id AS session_user FROM v_requests r JOIN v_sessions s
ON s.key = split_part(session_key, '@', 1) AND s.host = split_part(session_key, '@', 2) WHERE r.ts >= s.creation_datetime AND s.expires_at_datetime > r.ts""",
}
ORACLES["changed_postings"] = f"""WITH {CHANGED} {POSITIONS} FROM post"""
ORACLES["changed_stats"] = f"WITH {CHANGED}, {STATS} SELECT field, term, df, n, round(avgdl, 6) AS avgdl FROM ts JOIN fs USING (field)"
ORACLES["changed_search"] = f"""WITH {CHANGED}, {STATS}, {ASKED}, {_scores()}, rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc)
SELECT query_id, CAST(rank AS INTEGER) AS rank, score, title, description, "timestamp", url FROM rk JOIN now USING (id) WHERE rank <= 15"""
ORACLES["stream_valid"] = ORACLES["valid_at_request"]
ORACLES["search_json"] = f"""WITH h AS ({ORACLES['search_any']})
SELECT query_id, to_json({{'search_results': list({{'score': score, 'doc': {{'title': title, 'description': description, 'timestamp': "timestamp", 'url': url}}}} ORDER BY rank)}}) AS result FROM h GROUP BY query_id
UNION ALL SELECT page_id, '{{"search_results":[]}}' FROM (SELECT page_id FROM pages QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id DESC) = 1)
WHERE page_id % 100 = 0 AND page_id NOT IN (SELECT query_id FROM h)"""
