"""The same questions as SQL for DuckDB, written independently of the Spark expressions."""

from __future__ import annotations

NL = "chr(10)"
WS = "(chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(160))"

DOCS = "(SELECT *, source || '/' || doc_id AS path FROM documents WHERE length(text) > 0)"
EARLIER = f"""(SELECT d.path, CASE WHEN l.quality = 0 THEN d.text || {NL} || d.text ELSE d.text END AS text
    FROM {DOCS} d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.toxic, 0) = 0)"""


def chunk_rows(source: str, stamp: str | None = None) -> str:
    extra = f"'{stamp}' AS processed_ts, " if stamp else ""
    return f"""SELECT 'doc:' || sha256(path || '||' || (s // 2700)) AS id, path AS source_file,
        CAST(s // 2700 AS INT) AS chunk_index, sha256(text) AS content_hash, {extra}
        substr(text, s + 1, 3000) AS chunk
        FROM (SELECT path, text, unnest(range(0, length(text), 2700)) AS s FROM {source})"""


CHANGED = f"""(SELECT d.path, d.text FROM {DOCS} d LEFT JOIN {EARLIER} e USING (path)
    WHERE e.text IS NULL OR e.text <> d.text)"""
REPLACED = f"""WITH live AS ({chunk_rows(EARLIER, "earlier")}), new AS ({chunk_rows(CHANGED, "now")})
    SELECT * FROM live WHERE source_file NOT IN (SELECT path FROM {CHANGED})
    UNION ALL SELECT * FROM new"""

JOBS = """(SELECT event_id AS pandaid, 'site_' || user_id AS _queue, date_trunc('day', ts) AS day,
    event_type AS jobstatus, value AS durationsec,
    CASE WHEN event_type = 'error' THEN CAST(props->>'$.k' AS INT) ELSE 0 END AS piloterrorcode FROM events)"""
OCCURRENCES = """(SELECT 'site_' || user_id AS _queue, event_id AS pandaid, error, CAST(codeval AS INT) AS codeval, diag FROM (
    SELECT *, 'pilot' AS error, CAST(props->>'$.k' AS INT) AS codeval, 'pilot code ' || (props->>'$.k') AS diag FROM events WHERE event_type = 'error'
    UNION ALL SELECT *, 'exe', CAST(props->>'$.k' AS INT), 'exit of click' FROM events WHERE event_type = 'click'
    UNION ALL SELECT *, 'sup', hour(ts), NULL FROM events WHERE event_type = 'view' AND value > 10
    UNION ALL SELECT *, 'ddm', CAST(floor(value) AS INT), 'storage' FROM events WHERE event_type = 'error' AND value > 5
    UNION ALL SELECT *, 'brokerage', minute(ts), 'no site' FROM events WHERE event_type = 'error' AND hour(ts) >= 12
    UNION ALL SELECT *, 'jobdispatcher', CAST(floor(value) AS INT), 'lost heartbeat' FROM events WHERE event_type = 'signup'
    UNION ALL SELECT *, 'taskbuffer', CAST(props->>'$.k' AS INT), 'killed' FROM events WHERE event_type = 'purchase') WHERE codeval <> 0)"""
ERRORS = f"""(SELECT *, CAST(row_number() OVER (PARTITION BY _queue ORDER BY count DESC, error, codeval) - 1 AS INT) AS id
    FROM (SELECT _queue, error, codeval, count(*) AS count, min(pandaid) AS example_pandaid
        FROM {OCCURRENCES} WHERE codeval <> 0 GROUP BY _queue, error, codeval))"""

CATALOGUE = """(SELECT *, 'catalogue/' || c_custkey AS source, '{"' || c_name || '":' || CASE
    WHEN c_mktsegment = 'MACHINERY' THEN '"moved"' ELSE
    '{"corecount":' || c_nationkey || ',"corepower":' || c_acctbal ||
    CASE WHEN c_acctbal >= 0 THEN ',"nodes":' || c_custkey WHEN c_mktsegment = 'BUILDING' THEN '' ELSE ',"nodes":null' END ||
    ',"status":"' || CASE WHEN c_acctbal > 5000 THEN 'online' ELSE 'offline' END || '","is_cvmfs":' ||
    CASE WHEN c_nationkey < 5 THEN 'true' ELSE 'false' END || ',"hc_suite":["PFT","' ||
    CASE WHEN c_nationkey < 10 THEN 'AFT' ELSE 'XYZ' END || '"],"queues":[{"ce_endpoint":"ce' || c_custkey ||
    '","ce_flavour":"HTCONDOR-CE"}],"copytools":{"rucio":{"setup":"' || c_mktsegment || '"}},"corepower_data":"dropped"}'
    END || '}' AS content FROM customer)"""
ENTRIES = "(SELECT * FROM customer WHERE c_mktsegment <> 'MACHINERY')"
SUITE = """'["PFT","' || CASE WHEN c_nationkey < 10 THEN 'AFT' ELSE 'XYZ' END || '"]'"""

# Events with their response, their place in it, and what came first in it; LANDED are those of the readable responses.
PLACED = """(SELECT *, CAST(row_number() OVER (PARTITION BY response ORDER BY event_id) - 1 AS INT) AS position,
    first_value(event_type) OVER (PARTITION BY response ORDER BY event_id) AS head
    FROM (SELECT *, 'site_' || user_id AS _queue, CAST(epoch_us(date_trunc('day', ts)) AS BIGINT) AS fetched, props->>'$.k' AS k,
        user_id || '/' || date_trunc('day', ts) || '/' || (event_id // 1000) AS response FROM events))"""
LANDED = f"(SELECT * FROM {PLACED} WHERE head <> 'purchase')"
RANKED = f"""(SELECT *, CAST(row_number() OVER (PARTITION BY response ORDER BY n DESC, error, codeval) - 1 AS INT) AS id FROM (
    SELECT response, l._queue, fetched, error, codeval, count(*) AS n, min(pandaid) AS example_pandaid, coalesce(min(diag), 'none') AS diag,
        '[' || string_agg(pandaid, ',' ORDER BY pandaid) || ']' AS pandalist_json
    FROM {OCCURRENCES} o JOIN {LANDED} l ON pandaid = event_id GROUP BY ALL))"""
FACETS = f"""(SELECT response, _queue, fetched, CAST(0 AS INT) AS id, 'jobstatus' AS field, event_type AS kname, count(*) AS n FROM {LANDED} GROUP BY ALL
    UNION ALL SELECT response, _queue, fetched, CAST(1 AS INT), 'piloterrorcode', k, count(*) FROM {LANDED} WHERE event_type = 'error' GROUP BY ALL)"""
LAST_ORDER = """(SELECT o.*, c.*, c_mktsegment || '/' || c_name AS repo FROM (SELECT *, row_number() OVER
    (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) o
    JOIN customer c ON o_custkey = c_custkey WHERE rn = 1)"""

LATE = "ts >= TIMESTAMP '2024-01-30' AND event_type IN ('signup', 'error')"

LINES = f"""(SELECT lang, source, CAST(doc_id // 1000 AS VARCHAR) AS block,
    string_agg(doc_id || '|' || replace(text, {NL}, ' ') || {NL}, '' ORDER BY doc_id) AS text FROM documents GROUP BY ALL)"""

ORACLE: dict[str, str] = {
    # --- landed files
    "landed_documents": f"""SELECT lang, source, block, sha256(text) AS text_hash, CAST(length(text) AS INT) AS n_chars FROM {LINES}""",
    "landed_repositories": f"""SELECT repo, block, sha256(repo) AS commit_sha, sha256(text) AS content_hash
        FROM (SELECT 'lang=' || lang || '/source=' || source AS repo, block, text FROM {LINES} WHERE lang <> 'fr')""",
    "landed_catalogue": """SELECT c_name AS name, CASE WHEN c_acctbal < 0 THEN 'poor' ELSE 'rich' END AS status,
        CAST(c_custkey AS BIGINT) AS nodes FROM customer""",
    "selected_rows": f"SELECT pandaid, jobstatus, _queue FROM {JOBS} WHERE _queue = 'site_8'",
    # --- responses and catalogues that cannot all be loaded
    "bad_envelopes": """SELECT event_id AS pandaid, CASE event_type WHEN 'signup' THEN 'no queue' WHEN 'click' THEN 'no fetch time'
        WHEN 'purchase' THEN 'payload is not an object of lists' ELSE 'loaded' END AS outcome FROM events""",
    "stream_failures": """SELECT CASE event_type WHEN 'signup' THEN '?' ELSE 'site_' || user_id END AS source,
        bool_and(event_type NOT IN ('signup', 'click', 'purchase')) AS ok,
        max(CASE event_type WHEN 'signup' THEN 'no queue' WHEN 'click' THEN 'no fetch time'
            WHEN 'purchase' THEN 'payload is not an object of lists' END) AS error
        FROM events GROUP BY ALL""",
    "catalogue_refresh": """SELECT c_name AS queue, CASE WHEN c_acctbal >= 0 THEN 'rich' WHEN c_nationkey < 5 THEN 'gone' ELSE 'poor' END AS status,
        CAST(c_custkey AS BIGINT) AS nodes FROM customer
        UNION ALL SELECT DISTINCT 'nation/7/' || (c_custkey // 10000), 'not JSON', CAST(-1 AS BIGINT) FROM customer WHERE c_nationkey = 7""",
    "catalogue_types": """WITH f AS (SELECT 'nation/' || c_nationkey || '/' || (c_custkey // 10000) AS source, count(*) AS cells FROM customer GROUP BY 1)
        SELECT source, 'status' AS field, CAST(2 AS INT) AS rank, cells FROM f UNION ALL SELECT source, 'nodes', CAST(0 AS INT), cells FROM f""",
    "catalogue_context": """WITH c AS (SELECT *, c_mktsegment <> 'MACHINERY' AS opened FROM customer), t AS (
        SELECT 'queue' AS column_name, 'TEXT' AS column_type, count(*) AS filled FROM c
        UNION ALL SELECT 'data', 'TEXT', count(*) FILTER (NOT opened) FROM c
        UNION ALL SELECT 'nodes', 'TEXT', count(*) FILTER (opened AND c_acctbal >= 0) FROM c
        UNION ALL SELECT unnest(['copytools', 'hc_suite', 'is_cvmfs', 'queues', 'status']), 'TEXT', n FROM (SELECT count(*) FILTER (opened) AS n FROM c)
        UNION ALL SELECT 'corecount', 'BIGINT', count(*) FILTER (opened) FROM c
        UNION ALL SELECT 'corepower', 'DOUBLE', count(*) FILTER (opened) FROM c)
        SELECT CAST(row_number() OVER (ORDER BY column_name <> 'queue', column_name) - 1 AS INT) AS position, column_name, column_type, filled FROM t""",
    # --- documents
    "content_hashes": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "chunks": chunk_rows(DOCS),
    "chunks_short_steps": """SELECT doc_id, CAST(s // 300 AS INT) AS chunk_index, substr(text, s + 1, 1000) AS chunk
        FROM (SELECT doc_id, text, unnest(range(0, length(text), 300)) AS s FROM documents)""",
    "document_changes": f"""SELECT d.path, CASE WHEN e.text IS NULL THEN 'new' WHEN e.text <> d.text THEN 'changed'
        ELSE 'unchanged' END AS status, sha256(d.text) AS content_hash, sha256(e.text) AS previous_hash,
        CAST(coalesce(ceil(length(e.text) / 2700), 0) AS INT) AS n_previous
        FROM {DOCS} d LEFT JOIN {EARLIER} e USING (path)""",
    "documents_processed": f"""SELECT d.path, sha256(d.text) AS content_hash
        FROM {DOCS} d JOIN {EARLIER} e ON d.path = e.path AND d.text = e.text""",
    "cycle_statistics": f"""SELECT count(*) FILTER (e.text IS NULL OR e.text <> d.text) AS processed,
        count(*) FILTER (e.text = d.text) AS skipped, count(*) FILTER (e.text IS NULL) AS new,
        count(*) FILTER (e.text <> d.text) AS changed FROM {DOCS} d LEFT JOIN {EARLIER} e USING (path)""",
    "checkpoint_merge": f"""SELECT d.path, sha256(d.text) AS content_hash,
        CASE WHEN e.text = d.text THEN 'earlier' ELSE 'now' END AS processed_ts,
        CAST(ceil(length(d.text) / 2700) AS INT) AS chunks,
        array_to_string(list_transform(range(0, length(d.text), 2700), lambda s: 'doc:' || sha256(d.path || '||' || (s // 2700))), ',') AS ids
        FROM {DOCS} d LEFT JOIN {EARLIER} e USING (path)""",
    "replace_chunks": REPLACED,
    "document_cycle": f"SELECT *, CAST(8 AS INT) AS dim FROM ({REPLACED})",
    "strip_index": rf"""WITH d AS (SELECT doc_id, string_split(text || {NL} || repeat(source || '.run() (pkg.' || lang ||
            ' method), ' || n_chars || {NL}, length(text) - length(replace(text, {NL}, ''))) || 'end', {NL}) AS l
            FROM documents),
        f AS (SELECT doc_id, pos, sum(CAST(regexp_full_match(l[pos],
                '\s*[\w.() \t]+\([\w. \t]+(attribute|method|class|function|module|exception)\)\s*,\s*\d+\s*') AS INT))
                OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS run
            FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS pos FROM d)),
        cut AS (SELECT doc_id, min(pos) AS p FROM f WHERE run = 5 GROUP BY doc_id)
        SELECT doc_id, CASE WHEN p IS NULL THEN array_to_string(l, {NL})
            ELSE array_to_string(l[1:p - 1], {NL}) || {NL} END AS text FROM d LEFT JOIN cut USING (doc_id)""",
    "frontmatter": f"""SELECT doc_id, '---' || {NL} || 'source_repo: ' || source || {NL} || 'source_path: docs.v1/' || doc_id ||
        CASE lang WHEN 'en' THEN '.md' WHEN 'fr' THEN '.MD' WHEN 'de' THEN '.txt' ELSE '/.md' END || {NL} ||
        'source_type: ' || CASE WHEN lang IN ('en', 'fr') THEN 'md' ELSE 'unknown' END || {NL} ||
        'source_commit_sha: ' || sha256(source) || {NL} || '---' || {NL} || {NL} || trim(text, {WS}) || {NL} AS normalized
        FROM documents""",
    "rst_to_markdown": f"""SELECT doc_id, concat_ws({NL}, '# ' || source, '', '> **Note:** ' || lang, '', '### Block',
        '```' || lang, 'Inner', '-----', text, '', '```',
        'See [' || source || '](' || lang || ') and [' || lang || '](' || source || ').', '', text, '',
        '## End', 'short', '--', '> **Tip:** done') AS markdown FROM documents""",
    "decode_lenient": "SELECT doc_id, text || 'z' AS text, true AS refused FROM documents",
    "universal_newlines": f"SELECT doc_id, text || {NL} || source AS text FROM documents",
    "repo_documents": f"""SELECT 'org/' || source AS repo, 'docs/' || lang || '/' || doc_id || '.md' AS source_path,
        sha256('org/' || source) AS commit_sha, CAST(strlen(text) AS INT) AS n_bytes, sha256(text) AS content_hash,
        '---' || {NL} || 'source_repo: org/' || source || {NL} || 'source_path: docs/' || lang || '/' || doc_id || '.md' ||
        {NL} || 'source_type: md' || {NL} || 'source_commit_sha: ' || sha256('org/' || source) || {NL} || '---' || {NL} ||
        {NL} || trim(text, {WS}) || {NL} AS normalized FROM documents WHERE lang <> 'de'""",
    "glob_filter": """SELECT page_id, url FROM pages WHERE (contains(url, '/en/') OR contains(url, '.org/'))
        AND NOT regexp_matches(url, 'page=[0-9]') AND regexp_matches(url[-1], '[a-z0-9]')""",
    "path_suffix": r"""SELECT page_id, suffix, CASE WHEN suffix IN ('md', 'rst') THEN suffix ELSE 'unknown' END AS source_type
        FROM (SELECT page_id, CASE WHEN regexp_full_match(name, '.+\.[^.]+') THEN lower(string_split(name, '.')[-1]) ELSE '' END AS suffix
        FROM (SELECT page_id, string_split(regexp_replace(url, '[?#].*', '') ||
            CASE WHEN page_id < 100 THEN '.RST' ELSE '/.md' END, '/')[-1] AS name FROM pages))""",
    "recency_gate": f"""SELECT repo, CAST(o_orderkey AS VARCHAR) AS commit_sha, CASE
        WHEN abs(c_acctbal - 4500) > 2000 AND c_mktsegment <> 'BUILDING'
            AND age > CASE c_mktsegment WHEN 'MACHINERY' THEN 2000 ELSE 4800 END THEN 'too_old'
        WHEN c_acctbal > 6500 THEN 'unchanged' ELSE 'sync' END AS decision,
        c_mktsegment AS owner, c_name AS name, round(age, 4) AS age_hours
        FROM (SELECT *, (epoch_us(TIMESTAMP '2001-08-01 12:00:00') - epoch_us(o_orderdate)) / 3.6e9 AS age FROM {LAST_ORDER})""",
    # --- vectors
    "embed_documents": f"""SELECT doc_id, CAST(length(text) AS BIGINT) AS v0,
        CAST(length(text) - length(replace(text, ' ', '')) AS BIGINT) AS v1,
        CAST(length(text) - length(replace(text, {NL}, '')) AS BIGINT) AS v2 FROM documents""",
    "dummy_vectors": "SELECT doc_id, CAST(8 AS INT) AS dim, true AS is_zero FROM documents",
    "zero_vector_check": """SELECT label, count(*) AS n_vectors, count(*) FILTER (label = 0) AS n_zero
        FROM embeddings GROUP BY label""",
    "nearest_vectors": """SELECT vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]),
        list_transform(range(64), lambda i: CASE WHEN i < 32 THEN 1.0 ELSE -0.5 END)::DOUBLE[]), 6) AS score
        FROM embeddings ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]),
        list_transform(range(64), lambda i: CASE WHEN i < 32 THEN 1.0 ELSE -0.5 END)::DOUBLE[]) DESC, vec_id LIMIT 10""",
    "collection_counts": """SELECT lang || '_docs' AS collection, CAST(sum(ceil(length(text) / 2700)) AS BIGINT) AS n_chunks
        FROM documents GROUP BY lang""",
    # --- payloads
    "payload_jobs": f"""SELECT event_id AS pandaid, event_type AS jobstatus, CASE WHEN event_type <> 'view' THEN value END AS durationsec,
        CAST(k AS BIGINT) AS taskid, CAST(epoch_us(date_trunc('second', ts)) AS BIGINT) AS modified, CAST(NULL AS VARCHAR) AS cloud,
        _queue, fetched FROM {LANDED} WHERE event_type <> 'signup'""",
    "payload_fields": f"""SELECT _queue, fetched, 'pandaid,taskid,modificationtime,jobstatus' ||
        CASE WHEN bool_or(event_type <> 'view') THEN ',durationsec' ELSE '' END AS listed
        FROM (SELECT * FROM {LANDED} WHERE event_type <> 'signup') GROUP BY response, _queue, fetched""",
    "payload_quarantine": f"""SELECT 'jobs' AS kind, 'does not fit: taskid' AS reason, position, _queue, fetched FROM {LANDED} WHERE event_type = 'signup'
        UNION ALL SELECT 'payload', 'payload is not an object of lists', -1, _queue, fetched FROM {PLACED} WHERE head = 'purchase' AND position = 0
        UNION ALL SELECT 'errors_by_count', 'does not fit: codeval', id, _queue, fetched FROM {RANKED} WHERE error = 'taskbuffer'""",
    "payload_summary": f"""SELECT f.id, f.field,
        coalesce('[' || string_agg('{{"kname":"' || kname || '","kvalue":' || n || '}}', ',' ORDER BY try_cast(kname AS INT), kname) || ']', '[]') AS list_json,
        coalesce('{{"sum":' || sum(n) || '}}', 'none') AS stats_json, r._queue, r.fetched
        FROM (SELECT DISTINCT response, _queue, fetched FROM {LANDED}) r
        CROSS JOIN (VALUES (CAST(0 AS INT), 'jobstatus'), (CAST(1 AS INT), 'piloterrorcode')) f(id, field)
        LEFT JOIN {FACETS} v ON v.response = r.response AND v.id = f.id GROUP BY r.response, r._queue, r.fetched, f.id, f.field""",
    "payload_facet_values": f"SELECT _queue, field, kname, CAST(sum(n) AS BIGINT) AS jobs FROM {FACETS} GROUP BY ALL",
    "payload_facet_stats": f"SELECT _queue, id, field, 'sum' AS stat, CAST(sum(n) AS BIGINT) AS total FROM {FACETS} GROUP BY ALL",
    "payload_errors": f"""SELECT id, error, error || ':' || codeval AS codename, codeval, diag,
        CASE diag WHEN 'none' THEN 'none' ELSE diag || ' on ' || _queue END AS error_desc_text,
        example_pandaid, CAST(n AS INT) AS count, pandalist_json, _queue, fetched FROM {RANKED} WHERE error <> 'taskbuffer'""",
    "payload_error_jobs": f"""SELECT _queue, id, unnest(CAST(CAST(pandalist_json AS JSON) AS BIGINT[])) AS pandaid
        FROM {RANKED} WHERE error <> 'taskbuffer'""",
    "stream_ingest": """SELECT event_id AS pandaid, CASE event_type WHEN 'purchase' THEN 'closed' ELSE event_type END AS jobstatus,
        value AS durationsec, CASE WHEN event_type = 'error' THEN CAST(props->>'$.k' AS INT) END AS piloterrorcode,
        'site_' || user_id AS _queue, CAST(epoch_us(date_trunc('second', ts +
            CASE event_type WHEN 'purchase' THEN INTERVAL 31 DAYS ELSE INTERVAL 0 DAYS END)) AS BIGINT) AS fetched FROM events""",
    "stream_audit": """SELECT 'site_' || user_id AS source, true AS ok, CAST(max(epoch_us(date_trunc('second', ts +
        CASE event_type WHEN 'purchase' THEN INTERVAL 31 DAYS ELSE INTERVAL 0 DAYS END))) AS BIGINT) AS fetched
        FROM events GROUP BY user_id""",
    # --- merges
    "latest_per_key": """SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER
        (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
    "upsert_partial": """WITH target AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
            ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01') WHERE rn = 1),
        batch AS (SELECT *, o_orderpriority = '1-URGENT' AS u, o_orderpriority = '2-HIGH' AS h,
            o_orderstatus = 'F' AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH') AS k
            FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01'),
        carried AS (SELECT *, NOT (h OR k) AS has_status, NOT (u OR k) AS has_price FROM batch),
        listed AS (SELECT o_orderpriority, bool_or(has_status) AS l_status, bool_or(has_price) AS l_price FROM carried GROUP BY 1),
        one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, o_custkey
            ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM carried) WHERE rn = 1),
        steps AS (SELECT * FROM one JOIN listed USING (o_orderpriority)),
        statement AS (SELECT o_custkey, max_by(o_orderkey, o_orderpriority) AS o_orderkey, max(o_orderpriority) AS o_orderpriority,
            max_by({'v': CASE WHEN has_price THEN o_totalprice END}, o_orderpriority) FILTER (l_price) AS price,
            max_by({'v': CASE WHEN has_status THEN o_orderstatus END}, o_orderpriority) FILTER (l_status) AS status
            FROM steps GROUP BY o_custkey)
        SELECT coalesce(s.o_custkey, t.o_custkey) AS o_custkey, coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey,
            CASE WHEN s.price IS NOT NULL THEN s.price.v ELSE t.o_totalprice END AS o_totalprice,
            CASE WHEN s.status IS NOT NULL THEN s.status.v ELSE t.o_orderstatus END AS o_orderstatus,
            coalesce(s.o_orderpriority, t.o_orderpriority) AS o_orderpriority
        FROM target t FULL JOIN statement s ON t.o_custkey = s.o_custkey""",
    "replace_per_group": f"""SELECT event_id, user_id, event_type, value FROM events WHERE NOT ({LATE})
            AND user_id NOT IN (SELECT user_id FROM events WHERE {LATE})
        UNION ALL SELECT event_id, user_id, event_type, value FROM events WHERE {LATE} AND event_type = 'error'""",
    "audit_log": """SELECT 's' || user_id AS snapshot_id, event_type AS source, CAST(epoch_us(ts) AS BIGINT) AS fetched,
        sha256(props) AS content_hash, event_type <> 'error' AS ok, CASE WHEN event_type = 'error' THEN props END AS error
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, (event_type <> 'error') DESC) AS rn FROM events)
        WHERE rn = 1""",
    "history_append": """WITH rows AS (SELECT c_nationkey, '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' ||
        c_nationkey || ',"c_acctbal":' || c_acctbal || ',"c_mktsegment":"' || c_mktsegment || '"}' AS data,
        CAST(epoch_us(TIMESTAMP '2024-02-01') AS BIGINT) AS updated FROM customer)
        SELECT data, updated FROM rows UNION ALL SELECT data, updated FROM rows WHERE c_nationkey = 1""",
    # --- catalogue
    "raw_snapshots": f"SELECT source, sha256(content) AS content_hash, true AS is_object FROM {CATALOGUE}",
    "infer_types": f"""WITH e AS (SELECT CAST(content AS JSON)->('$."' || c_name || '"') AS payload FROM {CATALOGUE}),
        o AS (SELECT payload, unnest(json_keys(payload)) AS field FROM e WHERE json_type(payload) = 'OBJECT'),
        c AS (SELECT field, json_type(payload, '$."' || field || '"') AS t FROM o WHERE field <> 'corepower_data'
            UNION ALL SELECT 'data', json_type(payload) FROM e WHERE json_type(payload) <> 'OBJECT')
        SELECT field, ['BIGINT', 'DOUBLE', 'TEXT'][max(CASE WHEN t IN ('BIGINT', 'UBIGINT') THEN 1 WHEN t = 'DOUBLE' THEN 2 ELSE 3 END)] AS type
        FROM c GROUP BY field""",
    "wide_catalogue": f"""SELECT c_name AS queue, CAST(c_nationkey AS BIGINT) AS corecount, c_acctbal AS corepower,
        CASE WHEN c_acctbal >= 0 THEN CAST(c_custkey AS VARCHAR) END AS nodes,
        CASE WHEN c_acctbal > 5000 THEN 'online' ELSE 'offline' END AS status,
        CAST(c_nationkey < 5 AS VARCHAR) AS is_cvmfs, {SUITE} AS hc_suite,
        '{{"rucio":{{"setup":"' || c_mktsegment || '"}}}}' AS copytools, CAST(NULL AS VARCHAR) AS data FROM {ENTRIES}
        UNION ALL SELECT c_name, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'moved' FROM customer WHERE c_mktsegment = 'MACHINERY'""",
    "shape_check": """SELECT 'catalogue/' || c_custkey AS source,
        CASE WHEN c_custkey < 50 THEN 'top level is ARRAY' WHEN c_custkey < 90 THEN 'not JSON' ELSE '' END AS reason FROM customer""",
    "snapshot_gate": f"""SELECT s.source, sha256(content) AS content_hash FROM {CATALOGUE} s WHERE NOT EXISTS (
        SELECT 1 FROM (SELECT o_custkey, max(o_orderdate) AS at FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) m
        WHERE m.o_custkey = s.c_custkey AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = s.c_custkey
            AND o.o_orderdate = m.at AND o.o_orderstatus = 'O'))""",
    "resolve_queues": "SELECT CAST(0 AS INT) AS position, c_name AS queue FROM customer",
    "json_path": """SELECT c_name AS queue, CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment END AS setup FROM customer""",
    "json_membership": f"SELECT c_name AS queue, {SUITE} AS hc_suite FROM {ENTRIES} WHERE c_nationkey < 10",
    "json_unnest": f"SELECT c_name AS queue, 'ce' || c_custkey AS ce_endpoint, 'HTCONDOR-CE' AS ce_flavour FROM {ENTRIES}",
    "first_endpoints": f"SELECT c_name AS queue, 'ce' || c_custkey AS first_ce FROM {ENTRIES}",
    "catalogue_listing": f"""SELECT c_name AS queue, CAST(c_nationkey AS BIGINT) AS corecount FROM {ENTRIES}
        WHERE c_acctbal > 5000 AND c_nationkey < 5 ORDER BY corecount, queue""",
    # --- analytics
    "current_snapshot": f"""SELECT pandaid, _queue, CAST(epoch_us(day) AS BIGINT) AS fetched, jobstatus FROM {JOBS} j
        WHERE day = (SELECT max(date_trunc('day', ts)) FROM events e WHERE 'site_' || e.user_id = j._queue)""",
    "current_snapshot_of_queue": f"""SELECT pandaid, _queue, CAST(epoch_us(day) AS BIGINT) AS fetched, jobstatus FROM {JOBS}
        WHERE _queue = 'site_8' AND day = (SELECT max(date_trunc('day', ts)) FROM events WHERE user_id = 8)""",
    "latest_fetch": "SELECT 'site_' || user_id AS _queue, CAST(max(epoch_us(date_trunc('day', ts))) AS BIGINT) AS fetched FROM events GROUP BY user_id",
    "queue_counts": "SELECT 'site_' || user_id AS _queue, count(*) AS n_rows FROM events GROUP BY user_id",
    "row_counts": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}"
        for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
    ),
    "facets": f"""WITH v AS (SELECT _queue, 'jobstatus' AS field, jobstatus AS kname FROM {JOBS}
        UNION ALL SELECT _queue, 'piloterrorcode', CAST(piloterrorcode AS VARCHAR) FROM {JOBS})
        SELECT _queue, field, kname, count(*) AS kvalue,
        CAST(sum(count(*)) OVER (PARTITION BY _queue, field) AS BIGINT) AS sum FROM v GROUP BY _queue, field, kname""",
    "errors_ranked": f"SELECT * FROM {ERRORS}",
    "top_errors": f"SELECT _queue, error, codeval, count FROM {ERRORS} ORDER BY count DESC, _queue, id",
    "error_members": f"SELECT _queue, error, codeval, pandaid FROM {OCCURRENCES} WHERE codeval <> 0",
    "error_example_jobs": f"""SELECT e._queue, error, codeval, example_pandaid, jobstatus, durationsec
        FROM {ERRORS} e JOIN {JOBS} j ON e.example_pandaid = j.pandaid""",
    "job_queue_metadata": """SELECT o_orderkey AS pandaid, 'C' || o_custkey AS computingsite,
        c_mktsegment AS cloud FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    "newest_jobs": f"SELECT pandaid, _queue, jobstatus, durationsec FROM {JOBS} ORDER BY day DESC, pandaid DESC LIMIT 25",
    "recent_jobs_of_queue": f"""SELECT pandaid, jobstatus, durationsec FROM {JOBS} WHERE _queue = 'site_8'
        ORDER BY day DESC, pandaid DESC LIMIT 20""",
    "companion_listing": f"SELECT _queue, id, error, codeval, count FROM {ERRORS} ORDER BY _queue, id",
    "snapshot_listing": f"SELECT pandaid AS snapshot_id, CAST(epoch_us(day) AS BIGINT) AS fetched FROM {JOBS} ORDER BY day DESC, pandaid",
    # --- inspection
    "export_json": """SELECT '{"event_id":' || event_id || ',"event_type":"' || event_type || '","value":' ||
        CASE WHEN event_type = 'error' THEN 'null' ELSE CAST(value AS VARCHAR) END || ',"props_json":' ||
        replace(props, ' ', '') || ',"ts":"' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '","note":' ||
        CASE WHEN event_type = 'view' THEN '"seen"' ELSE 'null' END || '}' AS line FROM events""",
    "vertical_rows": """SELECT doc_id, column_name, CASE WHEN length(cell) > 120 THEN substr(cell, 1, 117) || '...' ELSE cell END AS display
        FROM (SELECT doc_id, 'text' AS column_name, text AS cell FROM documents UNION ALL SELECT doc_id, 'lang', lang FROM documents
        UNION ALL SELECT doc_id, 'n_chars', CAST(n_chars AS VARCHAR) FROM documents
        UNION ALL SELECT doc_id, 'source', source FROM documents WHERE lang = 'en') WHERE cell IS NOT NULL""",
    "display_values": """SELECT conv_id, turn, CASE WHEN role <> 'user' OR text IS NULL THEN 'NULL'
        WHEN length(text) > 120 THEN substr(text, 1, 117) || '...' ELSE text END AS display FROM conversations""",
    "context_lines": """WITH e AS (SELECT p_brand AS table_name, p_partkey AS position,
        p_name || '_' || p_partkey || '_' || p_name || '_' || p_name AS n, p_type AS t, p_name || ' of size ' || p_size AS d FROM part)
        SELECT table_name, position,
        '  ' || n || repeat(' ', greatest(30 - length(n), 0)) || ' ' || t || repeat(' ', greatest(10 - length(t), 0)) || '  ' || d || '. Not shown.' AS long_line,
        '  ' || n || repeat(' ', greatest(30 - length(n), 0)) || '  ' || t || repeat(' ', greatest(10 - length(t), 0)) || '  ' || d || '.' AS line
        FROM e""",
}
ORACLE["job_upsert"] = ORACLE["stream_ingest"]
ORACLE["late_landing"] = f"SELECT pandaid, jobstatus, durationsec, _queue, fetched FROM ({ORACLE['stream_ingest']})"
ORACLE["many_batches"] = f"""SELECT pandaid, '{{"pandaid":' || pandaid || ',"jobstatus":"' || jobstatus || '"' ||
    CASE WHEN piloterrorcode IS NULL THEN '' ELSE ',"piloterrorcode":' || piloterrorcode END || '}}' AS record,
    durationsec, _queue, fetched FROM ({ORACLE['stream_ingest']})"""
PASSES = f"""(SELECT lang, source, CAST(doc_id // 1000 AS VARCHAR) AS block, stamp,
    string_agg(doc_id || '|' || replace(text, {NL}, ' ') || more || {NL}, '' ORDER BY doc_id) AS text
    FROM documents, (VALUES ('earlier', ''), ('now', '|again')) v(stamp, more) WHERE stamp = 'earlier' OR lang = 'en' GROUP BY ALL)"""
ORACLE["edited_directory"] = f"""SELECT lang, source, block, CAST(s // 2700 AS INT) AS chunk_index, stamp AS processed_ts, substr(text, s + 1, 3000) AS chunk
    FROM (SELECT *, unnest(range(0, length(text), 2700)) AS s FROM {PASSES})"""
ORACLE["refused_documents"] = f"""SELECT lang, source, block, 'chunks' AS place FROM {PASSES}
    UNION ALL SELECT DISTINCT lang, 'none', '0', 'no text from pdf' FROM documents"""
# --- what cycles count while they write
ORACLE["job_statistics"] = f"""WITH m(table_name, measure, n) AS (
    SELECT 'jobs', 'rows', count(*) FROM ({ORACLE['payload_jobs']})
    UNION ALL SELECT 'selectionsummary', 'rows', 2 * count(DISTINCT _queue) FROM {LANDED}
    UNION ALL SELECT 'quarantine', 'rows', count(*) FROM ({ORACLE['payload_quarantine']})
    UNION ALL SELECT 'snapshots', CASE WHEN bad THEN 'failed' ELSE 'ok' END, count(*) FROM (SELECT bool_or(head = 'purchase') AS bad FROM {PLACED} GROUP BY _queue) GROUP BY bad)
    SELECT 'r1' AS run_id, t AS table_name, s AS measure, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (VALUES ('jobs', 'rows'), ('selectionsummary', 'rows'),
        ('quarantine', 'rows'), ('snapshots', 'ok'), ('snapshots', 'failed')) v(t, s) LEFT JOIN m ON t = table_name AND s = measure"""
ORACLE["published_tables"] = """SELECT t AS table_name, CAST(n AS BIGINT) AS n_columns, c AS last_column, true AS accounted FROM (VALUES ('jobs', 135, '_fetched_utc'),
    ('selectionsummary', 6, '_fetched_utc'), ('errors_by_count', 11, '_fetched_utc'), ('snapshots', 6, 'error')) v(t, n, c), (SELECT count(*) AS k FROM events) WHERE k > 0"""
ORACLE["document_statistics"] = f"""WITH r AS ({REPLACED}) SELECT run_id, table_name, measure, CAST(n AS BIGINT) AS n FROM (
    SELECT 'r1' AS run_id, 'chunks' AS table_name, 'new' AS measure, count(*) AS n FROM ({chunk_rows(EARLIER)})
    UNION ALL SELECT 'r1', 'chunks', 'kept', 0 UNION ALL SELECT 'r1', 'checkpoint', 'kept', 0
    UNION ALL SELECT 'r1', 'checkpoint', 'new', count(*) FROM {EARLIER}
    UNION ALL SELECT 'r2', 'chunks', 'new', count(*) FILTER (processed_ts = 'now') FROM r
    UNION ALL SELECT 'r2', 'chunks', 'kept', count(*) FILTER (processed_ts = 'earlier') FROM r
    UNION ALL SELECT 'r2', 'checkpoint', 'new', count(*) FROM {CHANGED}
    UNION ALL SELECT 'r2', 'checkpoint', 'kept', count(*) FROM {EARLIER} WHERE path NOT IN (SELECT path FROM {CHANGED}))"""
ORACLE["repository_statistics"] = """SELECT 'r1' AS run_id, table_name, measure, CAST(n AS BIGINT) AS n FROM (
    SELECT 'repo_docs' AS table_name, unnest(['saved', 'normalized']) AS measure, n FROM (SELECT count(*) AS n FROM documents WHERE lang <> 'de')
    UNION ALL SELECT 'repo_docs', 'kept', 0 UNION ALL SELECT 'repo_state', 'synced', count(DISTINCT source) FROM documents)"""
ORACLE["catalogue_statistics"] = """WITH f AS (SELECT c_nationkey AS k, count(*) AS n, bool_or(c_acctbal < 0) AS poor FROM customer GROUP BY c_nationkey, c_custkey // 10000)
    SELECT run_id, table_name, measure, CAST(n AS BIGINT) AS n FROM (
    SELECT 'r1' AS run_id, 'queuedata' AS table_name, 'rows' AS measure, sum(n) AS n FROM f UNION ALL SELECT 'r1', 'catalogue_entries', 'entries', sum(n) FROM f
    UNION ALL SELECT 'r1', 'catalogue_types', 'cells', 2 * sum(n) FROM f
    UNION ALL SELECT 'r1', 'catalogue_loads', 'loaded', count(*) FROM f UNION ALL SELECT 'r1', 'catalogue_loads', 'refused', 0
    UNION ALL SELECT 'r2', 'catalogue_loads', 'loaded', count(*) FILTER (k < 5 AND poor) FROM f
    UNION ALL SELECT 'r2', 'catalogue_loads', 'refused', count(*) FILTER (k = 7) FROM f)"""
