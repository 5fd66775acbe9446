"""SQL for DuckDB with the rows of the registered transcript queries."""

from __future__ import annotations

_LOG = """log AS (SELECT CAST(user_id AS VARCHAR) AS item_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'new' WHEN 'view' THEN 'downloaded'
  WHEN 'click' THEN 'transcript_ready' WHEN 'purchase' THEN 'uploaded' WHEN 'error' THEN 'error' END AS status FROM events)"""
_CURRENT = _LOG + """, cur AS (SELECT item_id, arg_max(status, row(ts, event_id)) AS status, max(ts) AS last_ts FROM log GROUP BY item_id)"""
_CATALOG = """cat AS (SELECT doc_id AS pos, CAST(doc_id AS VARCHAR) AS item_id, substr(text, 1, 60) AS title, source AS author, n_chars AS duration_s FROM documents)"""
_REASON = r"""CASE WHEN duration_s < 300 THEN 'too_short' WHEN contains(lower(coalesce(author, '')), 'src3') THEN 'author'
  WHEN coalesce(title, '') <> '' AND (regexp_matches(title, '^the ', 'i') OR regexp_matches(title, '###')) THEN 'title' END"""
_QUEUEABLE = "('new','error','downloading','transcribing','transcript_ready','correcting','corrected','summarizing','summarized','success')"
_PRESENT = "files AS (SELECT DISTINCT 'media/' || doc_id || '.m4a' AS path FROM labels)"
_TALK = "talk AS (SELECT CAST(conv_id AS VARCHAR) AS item_id, turn AS seq, role AS speaker, text, trim(text, E' \\t\\n\\r') AS t FROM conversations)"
_STATS = _TALK + """, stats AS (SELECT item_id, speaker, sum(length(t)) AS chars, min(seq) AS first_seq FROM talk WHERE length(t) > 0 GROUP BY ALL),
  shared AS (SELECT *, chars / sum(chars) OVER (PARTITION BY item_id) AS share, row_number() OVER (PARTITION BY item_id ORDER BY chars DESC, first_seq) = 1 AS prominent FROM stats),
  sig AS (SELECT *, CASE WHEN bool_or(share > 0.3 OR chars > 2000) OVER (PARTITION BY item_id) THEN share > 0.3 OR chars > 2000 ELSE prominent END AS significant FROM shared)"""
_SENTENCES = r"""cut AS (SELECT doc_id, text, list_filter(list_transform(regexp_extract_all(text, '[^。！？；.!?;]*[。！？；.!?;]|[^。！？；.!?;]+$'), lambda x: trim(x, E' \t\n\r')), lambda x: x <> '') AS s FROM documents)"""
_SPANS = """span AS (SELECT CAST(user_id AS VARCHAR) AS item_id, event_id AS seq, event_type AS speaker, epoch_us(ts) / 3.6e9 AS s, epoch_us(ts) / 3.6e9 + value AS e, value FROM events)"""


_METRICS = """run AS (SELECT '1_' || lang AS config_name, 'e' AS engine, round(sum(n_chars) / 7.0, 1) AS duration_seconds,
  CASE WHEN lang = 'de' THEN 'it broke in the middle of everything' END AS error FROM documents GROUP BY lang),
joined AS (SELECT '1_' || lang AS config_name, string_agg(replace(replace(text, '.', '。'), chr(10), ' '), ' ' ORDER BY doc_id) AS j, sum(len(string_split(text, chr(10)))) AS n FROM documents GROUP BY lang),
metrics AS (SELECT config_name, engine, CASE WHEN error IS NULL THEN length(j) ELSE 0 END AS char_count, CASE WHEN error IS NULL THEN n ELSE 0 END AS line_count,
  CASE WHEN error IS NULL THEN len(list_filter(string_split(j, '。'), lambda p: trim(p, E' \\t\\n\\r') <> '')) ELSE 0 END AS paragraph_count, duration_seconds, error FROM run JOIN joined USING (config_name))"""

ORACLES: dict[str, str] = {
    "queue_status": f"WITH {_CATALOG}, {_CURRENT}, q AS (SELECT coalesce(status, 'new') AS status FROM cat LEFT JOIN cur USING (item_id) WHERE {_REASON} IS NULL) SELECT status, count(*) AS n FROM q WHERE status IN {_QUEUEABLE} GROUP BY status",
    "rule_filter": f"WITH {_CATALOG} SELECT item_id, title, author, duration_s FROM cat WHERE {_REASON} IS NULL",
    "drop_reasons": f"WITH {_CATALOG} SELECT coalesce({_REASON}, 'kept') AS reason, count(*) AS n FROM cat GROUP BY 1",
    "upsert_state": f"WITH {_CURRENT}, err AS (SELECT item_id, arg_max(row(CASE WHEN status = 'error' THEN 'failed' END), row(ts, event_id)) AS e FROM log WHERE status IN ('error', 'new') GROUP BY item_id) SELECT item_id, status, e[1] AS error FROM cur LEFT JOIN err USING (item_id)",
    "lookup_status": f"WITH {_CURRENT}, {_CATALOG} SELECT item_id, coalesce(status, 'new') AS status FROM cat LEFT JOIN cur USING (item_id)",
    "status_counts": f"WITH {_CURRENT} SELECT status, count(*) AS n FROM cur GROUP BY status",
    "transition_audit": f"""WITH {_LOG}, p AS (SELECT lag(status) OVER (PARTITION BY item_id ORDER BY ts, event_id) AS previous, status AS next FROM log),
  ok(previous, next) AS (VALUES ('new','downloading'),('new','skipped_ai'),('new','skipped_old'),('downloading','downloaded'),('downloaded','transcribing'),('transcribing','transcript_ready'),('transcript_ready','correcting'),('correcting','corrected'),('corrected','summarizing'),('summarizing','summarized'),('summarized','success'),('success','uploaded'),('downloading','error'),('transcribing','error'),('correcting','error'),('summarizing','error'))
  SELECT previous, next, count(*) AS n, (previous, next) IN (SELECT (previous, next) FROM ok) AS allowed FROM p WHERE previous IS NOT NULL GROUP BY previous, next""",
    "mark_seen": f"""WITH {_CURRENT}, seen AS (SELECT CAST(doc_id AS VARCHAR) AS item_id, CASE WHEN doc_id % 3 = 0 THEN 1700000000 + doc_id * 60 END AS p FROM documents)
  SELECT item_id, coalesce(c.status, 'new') AS status, CASE WHEN c.item_id IS NULL THEN 'now' ELSE 'then' END AS first_seen, CASE WHEN s.item_id IS NULL THEN 'then' ELSE 'now' END AS last_seen,
  coalesce(s.p, CASE WHEN c.item_id IS NOT NULL THEN 7 END) AS pubdate FROM cur c FULL JOIN seen s USING (item_id)""",
    "build_queue": f"""WITH {_CURRENT}, {_CATALOG}, r AS (SELECT pos, item_id, coalesce(status, 'new') AS status FROM cat LEFT JOIN cur USING (item_id)),
  b AS (SELECT *, coalesce(sum((status IN {_QUEUEABLE})::INT) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
  SELECT item_id, CASE WHEN status IN {_QUEUEABLE} THEN status END AS status, status IN {_QUEUEABLE} AS queued FROM b WHERE before < 50""",
    "capped_scan": f"""WITH {_CURRENT}, {_CATALOG}, r AS (SELECT pos, item_id, coalesce(status, 'new') AS status FROM cat LEFT JOIN cur USING (item_id)),
  b AS (SELECT *, coalesce(sum((status = 'downloaded')::INT) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r) SELECT pos, item_id, status FROM b WHERE before < 20""",
    "stage_worklist": f"WITH {_CURRENT}, {_CATALOG}, {_PRESENT} SELECT pos, item_id, status FROM cat JOIN cur USING (item_id) WHERE status IN ('transcript_ready','correcting','corrected','summarizing') AND 'media/' || item_id || '.m4a' IN (SELECT path FROM files)",
    "prioritize_current_run": f"WITH {_CURRENT}, {_CATALOG} SELECT pos, item_id, item_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels) AS current FROM cat JOIN cur USING (item_id) WHERE status = 'uploaded'",
    "touched_set": f"WITH {_CURRENT}, t AS (SELECT item_id FROM cur WHERE status IN ('downloaded', 'error')) SELECT item_id, false AS appended FROM t UNION ALL SELECT DISTINCT CAST(doc_id AS VARCHAR), true FROM labels WHERE CAST(doc_id AS VARCHAR) NOT IN (SELECT item_id FROM t)",
    "recover_state": f"""WITH {_CURRENT}, {_PRESENT} SELECT item_id, CASE WHEN status <> 'error' THEN status WHEN 'media/' || item_id || '.m4a' IN (SELECT path FROM files) THEN 'downloaded' ELSE 'new' END AS status,
  CAST(NULL AS VARCHAR) AS error, status = 'error' AS changed FROM cur""",
    "reset_unfinished": f"WITH {_CURRENT} SELECT item_id, CASE WHEN status = 'uploaded' THEN status ELSE 'new' END AS status, CAST(NULL AS VARCHAR) AS error, status NOT IN ('uploaded', 'new') AS changed FROM cur",
    "artifact_pairs": f"WITH {_CURRENT}, {_PRESENT} SELECT item_id, 'media/' || item_id || '.m4a' IN (SELECT path FROM files) AS there FROM cur",
    "match_artifact": f"WITH {_PRESENT}, f AS (SELECT CASE WHEN length(path) % 2 = 0 THEN regexp_replace(path, 'm4a$', 'webm') ELSE path END AS path, regexp_extract(path, '/([0-9]+)', 1) AS stem FROM files) SELECT stem, path FROM f WHERE stem IN (SELECT CAST(doc_id AS VARCHAR) FROM documents)",
    "ai_decision_filter": f"""WITH {_CURRENT}, {_CATALOG}, r AS (SELECT pos, item_id FROM cat LEFT JOIN cur USING (item_id) WHERE coalesce(status, 'new') = 'new' ORDER BY pos LIMIT 200),
  l AS (SELECT CAST(doc_id AS VARCHAR) AS item_id, any_value(toxic) AS toxic FROM labels GROUP BY 1) SELECT item_id, coalesce(toxic = 1, false) AS skip FROM r LEFT JOIN l USING (item_id)""",
    "download_plan": rf"""WITH {_CATALOG}, n AS (SELECT item_id, regexp_replace(regexp_replace(regexp_replace(item_id || '_' || substr(title, 1, 50), '[<>:"/\\|?*]', '_', 'g'), '\s+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS stem FROM cat)
  SELECT item_id, 'https://example.org/' || item_id AS url, CASE WHEN length(stem) > 100 THEN regexp_replace(substr(stem, 1, 100), '_+$', '') ELSE stem END AS stem FROM n""",
    "publish_source": "SELECT * FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 's/' || source WHEN doc_id % 2 = 0 THEN 't/' || source END AS source_path FROM documents) WHERE source_path IS NOT NULL",
    "detect_language": r"""WITH m AS (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN repeat('中', CAST(floor(n_chars / 2) AS INT)) WHEN 1 THEN repeat('の', CAST(floor(n_chars / 2) AS INT)) ELSE '' END AS t FROM documents),
  c AS (SELECT doc_id, length(regexp_replace(t, '\s', '', 'g')) AS n, len(regexp_extract_all(t, '[\x{3040}-\x{309F}\x{30A0}-\x{30FF}]')) AS j, len(regexp_extract_all(t, '[\x{4E00}-\x{9FFF}]')) AS z FROM m)
  SELECT doc_id, CASE WHEN n = 0 THEN 'zh' WHEN j / n > 0.2 THEN 'ja' WHEN z / n > 0.3 THEN 'zh' ELSE 'en' END AS language FROM c""",
    "strip_hallucinations": r"""WITH m AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '  谢谢收看' || text || chr(10) || ' ' || chr(10) || ' ' || chr(10) || '感谢收看 end' ELSE text END AS t FROM documents),
  c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(replace(replace(t, '谢谢收看', ''), '感谢收看', ''), '  +', ' ', 'g'), '\n\s*\n\s*\n', chr(10) || chr(10), 'g'), E' \t\n\r') AS t FROM m) SELECT doc_id, length(t) AS n, md5(t) AS digest FROM c""",
    "strip_think": r"""SELECT doc_id, md5(trim(text, E' \t\n\r')) AS digest FROM documents""",
    "safe_filename": r"""WITH n AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[<>:"/\\|?*]', '_', 'g'), '\s+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS s FROM documents)
  SELECT doc_id, coalesce(nullif(CASE WHEN length(s) > 100 THEN regexp_replace(substr(s, 1, 100), '_+$', '') ELSE s END, ''), 'untitled') AS name FROM n""",
    "extract_title": r"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN coalesce(nullif(trim(regexp_extract(text, '^\s*(\S[^\n]*)', 1), E' \t\n\r'), ''), CAST(doc_id AS VARCHAR)) ELSE CAST(doc_id AS VARCHAR) END AS title FROM documents""",
    "extract_body": r"""WITH b AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN trim(text || chr(10) || '---', E' \t\n\r') WHEN 1 THEN trim(' ---' || source, E' \t\n\r') ELSE ' ' || text END AS t FROM documents)
  SELECT doc_id, length(t) AS n, md5(t) AS digest FROM b""",
    "inject_pub_line": r"""WITH t AS (SELECT *, '**发布时间**: ' || strftime(make_timestamp((1700000000 + doc_id) * 1000000), '%Y-%m-%d %H:%M') AS line FROM documents)
  SELECT doc_id, md5(CASE doc_id % 3 WHEN 0 THEN '# ' || source || chr(10) || 'UP主：a' || chr(10) || chr(10) || line || chr(10) || text
  WHEN 1 THEN 'x' || chr(10) || '# ' || source || ' more' || chr(10) || chr(10) || line || chr(10) || text ELSE line || chr(10) || chr(10) || text END) AS digest FROM t""",
    "format_timestamp": "SELECT doc_id, CASE WHEN n_chars >= 3600 THEN printf('%02d:%02d:%02d', n_chars // 3600, n_chars // 60 % 60, n_chars % 60) ELSE printf('%02d:%02d', n_chars // 60, n_chars % 60) END AS stamp, printf('[%.1f-%.1f] %s', CAST(doc_id AS DOUBLE), CAST(n_chars AS DOUBLE), source) AS line FROM documents",
    "accept_correction": r"""WITH c AS (SELECT doc_id, length(text) AS n, CAST(floor(length(text) * ((doc_id % 10) / 10)) AS INT) AS r, length(trim(text, E' \t\n\r')) AS v, text FROM documents),
  a AS (SELECT doc_id, text, CASE WHEN r < 0.3 * n THEN n ELSE r END AS chunk, CASE WHEN v >= 20 AND r >= 0.5 * n AND r <= 2 * n THEN r ELSE n END AS paragraph FROM c)
  SELECT doc_id, chunk, paragraph, md5(substr(text, 1, chunk)) AS chunk_digest, md5(substr(text, 1, paragraph)) AS paragraph_digest FROM a""",
    "split_sentences": f"WITH {_SENTENCES} SELECT doc_id, i - 1 AS seq, md5(s[i]) AS digest FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM cut)",
    "speaker_stats": f"WITH {_STATS} SELECT item_id, speaker, chars, first_seq, round(share, 6) AS share FROM shared",
    "significant_speakers": f"WITH {_STATS} SELECT item_id, speaker, prominent, significant FROM sig",
    "relabel_insignificant": f"""WITH {_STATS}, m AS (SELECT talk.item_id, seq, CASE WHEN significant THEN talk.speaker END AS own FROM talk LEFT JOIN sig USING (item_id, speaker))
  SELECT m.item_id, m.seq, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY m.item_id ORDER BY m.seq), best.speaker) AS effective FROM m LEFT JOIN (SELECT item_id, speaker FROM sig WHERE prominent) best USING (item_id)""",
    "speaker_blocks": f"""WITH {_TALK}, e AS (SELECT item_id, seq, CASE WHEN speaker = 'system' THEN 'user' ELSE speaker END AS speaker, t FROM talk),
  n AS (SELECT *, CASE WHEN lag(speaker) OVER (PARTITION BY item_id ORDER BY seq) IS NOT DISTINCT FROM speaker THEN 0 ELSE 1 END AS new FROM e),
  b AS (SELECT *, sum(new) OVER (PARTITION BY item_id ORDER BY seq) AS block FROM n) SELECT item_id, block, speaker, sum(length(t)) AS n, md5(string_agg(t, '' ORDER BY seq)) AS digest FROM b GROUP BY item_id, block, speaker""",
    "speaker_labels": "WITH s AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS item_id, role AS speaker FROM conversations) SELECT item_id, speaker, '[说话人 ' || chr(64 + CAST(rank() OVER (PARTITION BY item_id ORDER BY speaker) AS INT)) || ']' AS label FROM s",
    "plan_chunks": "WITH c AS (SELECT CAST(doc_id AS VARCHAR) AS item_id, n_chars AS d, unnest(range(0, CASE WHEN n_chars <= 210 THEN 1 ELSE CAST(ceil(n_chars / 180) AS INT) END)) AS k FROM documents) SELECT item_id, k AS chunk_no, k * 180 AS start_s, CASE WHEN d <= 210 THEN d ELSE least((k + 1) * 180, d) END AS end_s FROM c",
    "speaker_probe": f"WITH {_SPANS}, z AS (SELECT item_id, speaker, s - min(s) OVER (PARTITION BY item_id) AS s FROM span), p AS (SELECT item_id, count(DISTINCT CASE WHEN s < 120 THEN speaker END) AS n, max(s) AS d FROM z GROUP BY item_id) SELECT item_id, n AS n_speakers, d <= 120 AS probe_is_full, n <= 1 AS single_route FROM p",
    "assign_speakers": f"""WITH {_SPANS}, o AS (SELECT a.item_id, a.seq, b.speaker, sum(least(a.e, b.e) - greatest(a.s, b.s)) AS v FROM span a JOIN span b ON a.item_id = b.item_id AND a.speaker = 'error' AND b.speaker <> 'error' AND least(a.e, b.e) > greatest(a.s, b.s) GROUP BY ALL),
  best AS (SELECT item_id, seq, arg_min(speaker, row(-round(v, 6), speaker)) AS speaker FROM o GROUP BY ALL) SELECT span.item_id, span.seq, best.speaker FROM span LEFT JOIN best ON span.item_id = best.item_id AND span.seq = best.seq WHERE span.speaker = 'error'""",
    "speaker_map": "SELECT conv_id, turn, CASE WHEN role = 'user' THEN '主持人' ELSE role END AS a, 'x' AS c, 2 AS n, '说话人A 是 ' || CASE WHEN role = 'user' THEN '主持人' ELSE role END || ', C 是 x' AS info FROM conversations",
    "replaced_tags": r"SELECT conv_id, turn, '**[$1\' || role || ']** ' || text || ' **[Bo]** x **[Bo]** y **[$1\' || role || ']** z' AS text FROM conversations",
    "path_conflicts": r"""WITH m AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(substr(text, 1, 60), '[<>:"/\\|?*]', '_', 'g'), '\s+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS p FROM documents), n AS (SELECT doc_id, coalesce(nullif(p, ''), 'untitled') AS p FROM m)
  SELECT CAST(doc_id AS VARCHAR) AS item_id, count(*) OVER (PARTITION BY p) AS n_items, row_number() OVER (PARTITION BY p ORDER BY doc_id DESC) = 1 AS wins FROM n""",
    "stage_stats": f"""WITH {_CURRENT}, {_CATALOG}, r AS (SELECT coalesce(status, 'new') AS s FROM cat LEFT JOIN cur USING (item_id)), x AS (
  SELECT 'download' AS stage, CASE WHEN s = 'uploaded' THEN 'already_downloaded' WHEN s <> 'error' THEN 'downloaded' ELSE 'download_failed' END AS outcome FROM r
  UNION ALL SELECT 'transcribe', CASE WHEN s = 'uploaded' THEN 'already_transcribed' WHEN s = 'new' THEN 'no_audio' WHEN s <> 'error' THEN 'transcribed' ELSE 'error' END FROM r
  UNION ALL SELECT 'llm', unnest(CASE WHEN s = 'error' THEN ['error'] ELSE ['corrected', 'summarized'] END) FROM r WHERE s <> 'new'
  UNION ALL SELECT 'upload', CASE WHEN s NOT IN ('new', 'error') THEN 'uploaded' ELSE 'error' END FROM r) SELECT stage, outcome, count(*) AS n FROM x GROUP BY ALL""",
    "run_success": f"WITH {_CURRENT}, {_CATALOG}, b AS (SELECT * FROM cat ORDER BY pos LIMIT 100), j AS (SELECT pos, item_id, coalesce(status IN ('success', 'uploaded'), false) AS ok FROM b LEFT JOIN cur USING (item_id)) SELECT count(*) AS n, count(*) FILTER (ok) AS n_success, coalesce(string_agg(CASE WHEN ok THEN item_id END, ',' ORDER BY pos), '') AS ids FROM j",
    "recent_uploads": f"WITH {_CURRENT} SELECT item_id, 'Unknown Title' AS title FROM cur WHERE status = 'uploaded' ORDER BY last_ts DESC, CAST(item_id AS INT) LIMIT 10",
    "file_counts": "SELECT lower(lang) AS extension, count(*) AS n FROM documents GROUP BY 1",
    "queue_preview": f"WITH {_CATALOG}, c AS (SELECT count(*) AS n FROM cat), h AS (SELECT row_number() OVER (ORDER BY pos) AS number, title FROM cat) SELECT number, title FROM h WHERE number <= 10 UNION ALL SELECT 11, 'and ' || (n - 10) || ' more' FROM c WHERE n > 10",
    "transcript_metrics": f"WITH {_METRICS} SELECT * FROM metrics",
    "eval_report": f"WITH {_METRICS} SELECT split_part(config_name, '_', 1) AS number, config_name, engine, char_count || CASE WHEN error IS NULL AND char_count = (SELECT max(char_count) FROM metrics WHERE error IS NULL) THEN ' ⭐' ELSE '' END AS chars, paragraph_count AS paragraphs, duration_seconds AS seconds, CASE WHEN error IS NULL THEN '✅' ELSE '❌ ' || substr(error, 1, 30) END AS status FROM metrics",
}

_FOLD = """list_reduce(list_prepend(struct_pack(o := []::VARCHAR[], c := '', l := 0), list_transform({items}, lambda x: struct_pack(o := []::VARCHAR[], c := x, l := length(x)))),
  lambda a, y: CASE WHEN a.c <> '' AND a.l + y.l > {limit} THEN struct_pack(o := list_append(a.o, a.c), c := y.c, l := y.l)
  ELSE struct_pack(o := a.o, c := CASE WHEN a.c = '' THEN y.c ELSE a.c || {join} || y.c END, l := a.l + y.l + {plus}) END)"""
ORACLES["pack_paragraphs"] = f"""WITH {_SENTENCES}, f AS (SELECT doc_id, {_FOLD.format(items="s", limit=500, join="''", plus=0)} AS r FROM cut WHERE len(s) > 0),
  p AS (SELECT doc_id, list_append(r.o, r.c) AS p FROM f UNION ALL SELECT doc_id, [text] FROM cut WHERE len(s) = 0 AND text <> '')
  SELECT doc_id, i - 1 AS seq, length(p[i]) AS n, md5(p[i]) AS digest FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM p)"""
ORACLES["pack_chunks"] = rf"""WITH l AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: trim(x, E' \t\r') <> '') AS s FROM documents),
  f AS (SELECT doc_id, {_FOLD.format(items="s", limit=2500, join="chr(10) || chr(10)", plus=2)} AS r FROM l WHERE len(s) > 0),
  p AS (SELECT doc_id, list_append(r.o, r.c) AS p FROM f UNION ALL SELECT doc_id, [text] FROM l WHERE len(s) = 0)
  SELECT doc_id, i - 1 AS chunk_no, length(p[i]) AS n, md5(p[i]) AS digest FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM p)"""
ORACLES["pack_segments"] = f"""WITH {_TALK}, l AS (SELECT item_id, list(t ORDER BY seq) AS s FROM talk WHERE t <> '' GROUP BY item_id),
  f AS (SELECT item_id, {_FOLD.format(items="s", limit=500, join="''", plus=0)} AS r FROM l), p AS (SELECT item_id, list_append(r.o, r.c) AS p FROM f)
  SELECT item_id, i - 1 AS seq, length(p[i]) AS n, md5(p[i]) AS digest FROM (SELECT item_id, p, unnest(range(1, len(p) + 1)) AS i FROM p)"""
ORACLES["batch_turns"] = f"""WITH RECURSIVE {_SPANS}, o AS (SELECT item_id, seq, round((s + value) - s, 2) AS d, row_number() OVER (PARTITION BY item_id ORDER BY seq) AS k FROM span),
  r AS (SELECT item_id, seq, k, 0 AS batch_no, 1 AS n, d AS t FROM o WHERE k = 1
  UNION ALL SELECT o.item_id, o.seq, o.k, CASE WHEN r.n >= 8 OR r.t + o.d > 240 THEN r.batch_no + 1 ELSE r.batch_no END, CASE WHEN r.n >= 8 OR r.t + o.d > 240 THEN 1 ELSE r.n + 1 END, CASE WHEN r.n >= 8 OR r.t + o.d > 240 THEN o.d ELSE r.t + o.d END
  FROM r JOIN o ON o.item_id = r.item_id AND o.k = r.k + 1) SELECT item_id, seq, batch_no FROM r"""
ORACLES["merge_turns"] = f"""WITH RECURSIVE {_SPANS}, o AS (SELECT item_id, speaker, s, e, row_number() OVER (PARTITION BY item_id ORDER BY s, seq) AS k FROM span),
  r AS (SELECT item_id, k, k AS first, speaker, s AS s0, e FROM o WHERE k = 1
  UNION ALL SELECT o.item_id, o.k, CASE WHEN o.speaker = r.speaker AND o.s - r.e <= 300 AND o.e - r.s0 <= 500 THEN r.first ELSE o.k END, o.speaker,
  CASE WHEN o.speaker = r.speaker AND o.s - r.e <= 300 AND o.e - r.s0 <= 500 THEN r.s0 ELSE o.s END, o.e FROM r JOIN o ON o.item_id = r.item_id AND o.k = r.k + 1)
  SELECT item_id, first AS seq, any_value(speaker) AS speaker, round(any_value(s0), 4) AS start_s, round(arg_max(e, k), 4) AS end_s, count(*) AS n_turns FROM r GROUP BY item_id, first"""

_PLAIN = "translate(text, '*_`[]()#', '')"
_MARKED = f"""array_to_string(list_transform(string_split({_PLAIN}, chr(10)), lambda x, i: CASE (i - 1) % 5 WHEN 0 THEN '## ' || x WHEN 1 THEN '  - ' || x WHEN 2 THEN '* ' || x WHEN 3 THEN chr(9) || '> ' || x ELSE x END), chr(10))"""
_ESCAPED = """replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;')"""
# lines are classified by what they hold; md is a CTE with doc_id and md
_BLOCKS = rf"""l AS (SELECT doc_id, unnest(string_split(md, chr(10))) AS s, unnest(range(0, len(string_split(md, chr(10))))) AS line_no FROM md),
  k AS (SELECT doc_id, line_no, s, ltrim(s, E' \t') AS t, CASE WHEN trim(s, E' \t') = '' THEN 'blank' WHEN regexp_matches(s, '^#{{1,6}}\s+') THEN 'heading' WHEN regexp_matches(s, '^\s*(-{{3,}}|\*{{3,}}|_{{3,}})\s*$') THEN 'rule'
    WHEN starts_with(ltrim(s, E' \t'), '> ') THEN 'quote' WHEN regexp_matches(ltrim(s, E' \t'), '^[-*] ') THEN 'bullet' ELSE 'paragraph' END AS kind FROM l),
  b AS (SELECT doc_id, line_no, kind, CASE kind WHEN 'heading' THEN length(regexp_extract(s, '^#+')) ELSE 0 END AS level,
    CASE kind WHEN 'heading' THEN trim(regexp_replace(s, '^#+\s+', ''), E' \t') WHEN 'rule' THEN '' WHEN 'quote' THEN trim(substr(t, 3), E' \t') WHEN 'bullet' THEN trim(substr(t, 3), E' \t') ELSE trim(s, E' \t') END AS text,
    kind = 'bullet' AND coalesce(lag(kind) OVER w, '') <> 'bullet' AS opens, kind = 'bullet' AND coalesce(lead(kind) OVER w, '') <> 'bullet' AS closes FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))"""
_STYLE = """  <style>
    body{font-family:serif;line-height:1.45;font-size:0.95em}
    h1,h2,h3{margin:0.6em 0 0.35em; padding:0}
    p{margin:0.35em 0}
    ul{margin:0.25em 0 0.35em 1.1em; padding:0}
    li{margin:0.15em 0}
    blockquote{margin:0.5em 0; padding-left:1em; border-left:3px solid #ccc; color:#666; font-style:italic}
    hr{border:0; border-top:1px solid #ddd; margin:1em 0}
  </style>
"""
_HEAD = "<?xml version=''1.0'' encoding=''utf-8''?>\n<!DOCTYPE html>\n<html xmlns=''http://www.w3.org/1999/xhtml'' xml:lang=''zh-CN'' lang=''zh-CN''>\n<head>\n  <meta charset=''utf-8''/>\n  <title>Content</title>\n" + _STYLE + "</head>\n<body>\n"
_XHTML = f"""{_BLOCKS}, e AS (SELECT *, replace({_ESCAPED.format(x="text")}, '**发布时间**', '<b>发布时间</b>') AS i FROM b WHERE kind <> 'blank'),
  h AS (SELECT doc_id, line_no, CASE kind WHEN 'heading' THEN '<h' || level || '>' || i || '</h' || level || '>' WHEN 'rule' THEN '<hr/>' WHEN 'quote' THEN '<blockquote>' || i || '</blockquote>'
    WHEN 'bullet' THEN CASE WHEN opens THEN '<ul>' || chr(10) ELSE '' END || '<li>' || i || '</li>' || CASE WHEN closes THEN chr(10) || '</ul>' ELSE '' END ELSE '<p>' || i || '</p>' END AS html FROM e),
  x AS (SELECT md.doc_id, '{_HEAD}' || coalesce(string_agg(html, chr(10) ORDER BY line_no), '') || chr(10) || '</body>' || chr(10) || '</html>' || chr(10) AS xhtml FROM md LEFT JOIN h USING (doc_id) GROUP BY md.doc_id)"""
ORACLES["markdown_blocks"] = f"WITH md AS (SELECT doc_id, {_MARKED} AS md FROM documents), {_BLOCKS} SELECT doc_id AS item_id, line_no, kind, level, md5(text) AS digest, CASE WHEN kind = 'bullet' THEN run END AS run FROM (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM b) WHERE kind <> 'blank'"
ORACLES["rendered_xhtml"] = f"WITH md AS (SELECT doc_id, {_MARKED} AS md FROM documents), {_XHTML} SELECT doc_id, length(xhtml) AS n, md5(xhtml) AS digest FROM x"
ORACLES["inline_html"] = f"""SELECT doc_id, md5('<b>' || source || '</b> <code style="background:#f4f4f4;padding:0 2px"> cd </code> <a href="u_v_w">a_b</a> <i>i</i> ' || {_ESCAPED.format(x=_PLAIN)}) AS digest FROM documents"""
ORACLES["book_table"] = f"""WITH book AS (SELECT *, strftime(make_timestamp((1700000000 + doc_id) * 1000000), '%Y-%m-%d %H:%M') AS pub_time FROM documents WHERE doc_id % 4 <> 0),
  md AS (SELECT doc_id, '# ' || source || chr(10) || chr(10) || '**发布时间**: ' || pub_time || chr(10) || {_MARKED} AS md FROM book WHERE doc_id % 10 <> 1), {_XHTML}
  SELECT CAST(doc_id AS VARCHAR) AS item_id, CASE WHEN doc_id % 10 = 1 THEN CAST(doc_id AS VARCHAR) ELSE source END AS title, pub_time, CASE WHEN doc_id % 10 = 1 THEN CAST(doc_id AS VARCHAR) ELSE source END || '.epub' AS path,
  CASE WHEN doc_id % 10 = 1 THEN 'error' ELSE 'converted' END AS outcome, md5(xhtml) AS digest FROM book LEFT JOIN x USING (doc_id)"""
_CORRECTED = "'# ' || source || chr(10) || chr(10) || '**UP主**: ' || lang || chr(10) || chr(10) || '---' || chr(10) || chr(10) || {body}"
_FULL = "chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## 完整文本' || chr(10) || chr(10) || text"
ORACLES["stage_documents"] = f"SELECT doc_id, md5({_CORRECTED.format(body='text')}) AS corrected, md5({_CORRECTED.format(body=chr(39) + 's' + chr(39))} || {_FULL}) AS final FROM documents"
ORACLES["stale_paths"] = "SELECT CAST(doc_id AS VARCHAR) AS item_id, 'out/' || doc_id || '.epub' AS epub_path FROM documents WHERE doc_id % 2 = 0"
_SPOKEN = rf"""doc AS (SELECT CAST(conv_id AS VARCHAR) AS item_id, string_agg('**[说话人 A]** ' || text, chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id),
  li AS (SELECT item_id, list_filter(string_split(body, chr(10)), lambda x: trim(x, E' \t\r') <> '') AS s FROM doc), fo AS (SELECT item_id, {_FOLD.format(items="s", limit=2500, join="chr(10) || chr(10)", plus=2)} AS r FROM li),
  chunks AS (SELECT item_id, list_append(r.o, r.c) AS p FROM fo)"""
_SAID = rf"""{_SPOKEN}, jo AS (SELECT item_id, array_to_string(list_transform(p, lambda x: trim(x, E' \t\r\n')), chr(10) || chr(10)) AS j FROM chunks),
  na AS (SELECT item_id, regexp_replace(regexp_replace(j, '\*\*\[说话人 A\]\*\*[:：\s]*', '**[Ann]** ', 'g'), '(\*\*\[Ann\]\*\* )+', '**[Ann]** ', 'g') AS j FROM jo),
  said AS (SELECT item_id, trim(regexp_replace(regexp_replace(j, '  +', ' ', 'g'), '\n\s*\n\s*\n', chr(10) || chr(10), 'g'), E' \t\r\n') AS c FROM na)"""
ORACLES["corrected_documents"] = f"WITH {_SAID} SELECT item_id, length(c) AS n, md5(c) AS digest FROM said"
ORACLES["process_transcripts"] = f"WITH {_SAID} SELECT item_id, 't' AS title, 'a' AS author, md5(c) AS corrected, md5(c) AS summary FROM said"
ORACLES["stitched_responses"] = f"WITH {_SPOKEN} SELECT item_id, i - 1 AS chunk_no, CASE WHEN i % 2 = 1 THEN md5(lower(p[i])) END AS digest FROM (SELECT item_id, p, unnest(range(1, len(p) + 1)) AS i FROM chunks)"
ORACLES["summarize_documents"] = rf"""WITH a AS (SELECT *, CASE doc_id % 7 WHEN 0 THEN '总结失败：API 超时。原始内容长度: ' || length(text) WHEN 1 THEN '总结失败：boom' ELSE CASE WHEN doc_id % 3 = 0 THEN trim(text, E' \t\r\n') ELSE source END END AS s FROM documents)
  SELECT doc_id AS item_id, doc_id % 7 > 1 AND length(s) < 100 AS is_short, doc_id % 7 <= 1 AS is_error, md5(s) AS summary, md5({_CORRECTED.format(body="s")} || {_FULL}) AS final FROM a"""
ORACLES["filter_requests"] = "WITH a AS (SELECT doc_id, md5('Keep ' || coalesce(nullif(substr(text, 1, 60), ''), '未知标题') || ' of ' || source || '?') AS p FROM documents) SELECT CAST(doc_id AS VARCHAR) AS item_id, p AS prompt, p AS sent, CAST(0 AS DOUBLE) AS temperature, 512 AS num_predict FROM a"
ORACLES["speaker_requests"] = "SELECT doc_id AS item_id, md5('未知标题 ' || source || ' ' || substr(text, 1, 5000)) AS prompt FROM documents"
ORACLES["response_texts"] = r"SELECT doc_id, md5(trim(text, E' \t\r\n')) AS digest FROM documents"
ORACLES["languages"] = r"""WITH c AS (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN lang END AS own, length(regexp_replace(text, '\s', '', 'g')) AS n, len(regexp_extract_all(text, '[\x{3040}-\x{309F}\x{30A0}-\x{30FF}]')) AS j, len(regexp_extract_all(text, '[\x{4E00}-\x{9FFF}]')) AS z FROM documents)
  SELECT doc_id, CASE WHEN n = 0 THEN 'zh' WHEN j / n > 0.2 THEN 'ja' WHEN z / n > 0.3 THEN 'zh' ELSE 'en' END AS detected, 'ja' AS configured, coalesce(own, 'zh') AS reported, coalesce(own NOT IN ('zh', 'chinese', 'cmn'), true) AS batched, coalesce(own NOT IN ('zh', 'chinese', 'cmn'), false) AS single FROM c"""
ORACLES["simplified"] = "SELECT doc_id, md5('说话头发发现了X' || translate(text, 'e', 'é') || '头发现了') AS digest FROM documents"
ORACLES["parsed_times"] = "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN CAST(floor(epoch(ts)) AS BIGINT) END AS seconds FROM events"
_CLOCK = "CASE WHEN {x} >= 3600 THEN printf('%02d:%02d:%02d', {x} // 3600, {x} // 60 % 60, {x} % 60) ELSE printf('%02d:%02d', {x} // 60, {x} % 60) END"
ORACLES["stamped_lines"] = f"SELECT CAST(user_id AS VARCHAR) AS item_id, md5(string_agg('[' || {_CLOCK.format(x='event_id')} || ' --> ' || {_CLOCK.format(x='(event_id + 4000)')} || '] ' || event_type, chr(10) ORDER BY event_id)) AS digest FROM events GROUP BY user_id"
ORACLES["id_labels"] = "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '[' || source || ']' WHEN doc_id < 26 THEN '[说话人 ' || chr(65 + CAST(doc_id AS INT)) || ']' ELSE '[说话人 ' || (doc_id + 1) || ']' END AS label FROM documents"
# t: a CTE with key, text; the unterminated tail joins the last paragraph unchecked
_UNCHECKED = rf"""se AS (SELECT key, text, list_filter(list_transform(regexp_extract_all(text, '[^。！？；.!?;]*[。！？；.!?;]|[^。！？；.!?;]+$'), lambda x: trim(x, E' \t\n\r')), lambda x: x <> '') AS s FROM t),
  ta AS (SELECT *, len(s) > 0 AND NOT regexp_matches(s[-1], '[。！？；.!?;]$') AS tail FROM se), bo AS (SELECT *, CASE WHEN tail THEN s[:-2] ELSE s END AS body FROM ta),
  fo AS (SELECT *, CASE WHEN len(body) > 0 THEN {_FOLD.format(items="body", limit=500, join="''", plus=0)} END AS r FROM bo),
  packed AS (SELECT key, CASE WHEN text = '' THEN [] WHEN len(s) = 0 THEN [text] WHEN tail AND len(body) = 0 THEN [s[-1]] WHEN tail THEN list_append(r.o, r.c || s[-1]) ELSE list_append(r.o, r.c) END AS p FROM fo)"""
ORACLES["unchecked_tails"] = f"WITH t AS (SELECT doc_id AS key, text || ' and a tail without an end' AS text FROM documents), {_UNCHECKED} SELECT key AS doc_id, i - 1 AS seq, length(p[i]) AS n, md5(p[i]) AS digest FROM (SELECT key, p, unnest(range(1, len(p) + 1)) AS i FROM packed)"
_STRONG = _STATS.replace("share > 0.3 OR chars > 2000", "share > 0.05 OR chars > 100")
ORACLES["rendered_transcripts"] = f"""WITH {_STRONG}, m AS (SELECT talk.item_id, seq, t, CASE WHEN significant THEN talk.speaker END AS own FROM talk LEFT JOIN sig USING (item_id, speaker)),
  ef AS (SELECT m.item_id, m.seq, m.t, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY m.item_id ORDER BY m.seq), best.speaker) AS e FROM m LEFT JOIN (SELECT item_id, speaker FROM sig WHERE prominent) best USING (item_id)),
  nw AS (SELECT *, CASE WHEN seq > min(seq) OVER (PARTITION BY item_id) AND lag(e) OVER (PARTITION BY item_id ORDER BY seq) IS NOT DISTINCT FROM e THEN 0 ELSE 1 END AS new FROM ef),
  bl AS (SELECT *, sum(new) OVER (PARTITION BY item_id ORDER BY seq) AS block FROM nw), t AS (SELECT row(item_id, block, e) AS key, string_agg(t, '' ORDER BY seq) AS text FROM bl GROUP BY item_id, block, e), {_UNCHECKED},
  la AS (SELECT item_id, speaker, '[说话人 ' || chr(64 + CAST(rank() OVER (PARTITION BY item_id ORDER BY speaker) AS INT)) || ']' AS label FROM stats), sv AS (SELECT item_id, count(*) > 1 AS several FROM sig WHERE significant GROUP BY item_id),
  ro AS (SELECT key[1] AS item_id, key[2] AS block, key[3] AS speaker, p FROM packed), pa AS (SELECT ro.item_id, block, list_transform(p, lambda x: CASE WHEN several THEN '**' || label || '** ' ELSE '' END || x) AS p FROM ro LEFT JOIN la USING (item_id, speaker) LEFT JOIN sv USING (item_id)),
  bd AS (SELECT item_id, array_to_string(flatten(list(p ORDER BY block)), chr(10) || chr(10)) AS body FROM pa GROUP BY item_id)
  SELECT item_id, md5('# T' || item_id || chr(10) || chr(10) || '**UP主**: U' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || coalesce(nullif(body, ''), '(转录失败或无文字内容)') || chr(10)) AS digest FROM bd"""
ORACLES["named_turns"] = "SELECT CAST(conv_id AS VARCHAR) AS item_id, turn AS seq, CASE WHEN role = 'user' THEN 'Ann ' || conv_id ELSE role END AS name FROM conversations"
ORACLES["filled_turns"] = f"WITH {_TALK} SELECT item_id, seq FROM talk WHERE seq % 3 <> 0 AND seq % 7 <> 0 AND t <> ''"
ORACLES["required_fields"] = "SELECT CASE WHEN doc_id % 5 = 0 THEN 'missing_fields' ELSE 'kept' END AS reason, count(*) AS n FROM documents GROUP BY 1"
ORACLES["state_selections"] = f"WITH {_CURRENT}, c AS (SELECT item_id, status, CAST(item_id AS INT) AS i FROM cur) SELECT 'pending' AS selection, item_id FROM c WHERE status = 'downloaded' UNION ALL SELECT 'summaries', item_id FROM c WHERE i % 3 = 0 UNION ALL SELECT 'transcripts', item_id FROM c WHERE i % 3 = 0 OR i % 2 = 0"
ORACLES["catalog_to_queue"] = "SELECT doc_id AS pos, CAST(doc_id AS VARCHAR) AS item_id, substr(text, 1, 60) AS title, 'https://example.org/' || doc_id AS url, CAST(n_chars AS INT) AS duration_s, source AS author, 1700000000 + doc_id * 60 AS pubdate FROM documents"
ORACLES["applied_outcomes"] = f"""WITH {_LOG}, f AS (SELECT *, CASE status WHEN 'new' THEN 'downloading' WHEN 'transcript_ready' THEN 'error' ELSE status END AS s, CASE status WHEN 'transcript_ready' THEN 'Transcription failed: ' || item_id WHEN 'error' THEN 'LLM step failed: ' || item_id END AS e FROM log)
  SELECT item_id, arg_max(s, row(ts, event_id)) AS status, arg_max(e, row(ts, event_id)) FILTER (e IS NOT NULL) AS error FROM f GROUP BY item_id"""
_MIDWAY = "mid AS (SELECT doc_id AS pos, CAST(doc_id AS VARCHAR) AS item_id, ['transcribing', 'correcting', 'summarizing', 'downloading', 'error', 'summarized', 'corrected', 'transcript_ready', 'summary_ready', 'success'][doc_id % 10 + 1] AS s FROM documents)"
ORACLES["recovered_midway"] = f"""WITH {_MIDWAY}, {_PRESENT}, n AS (SELECT *, CASE s WHEN 'error' THEN CASE WHEN 'media/' || item_id || '.m4a' IN (SELECT path FROM files) THEN 'downloaded' ELSE 'new' END WHEN 'transcribing' THEN 'downloaded' WHEN 'correcting' THEN 'transcript_ready' WHEN 'summarizing' THEN 'corrected' ELSE s END AS status FROM mid)
  SELECT item_id, status, CASE WHEN s <> 'error' THEN 'e' END AS error, status <> s AS changed FROM n"""
ORACLES["publish_worklist"] = f"WITH {_MIDWAY}, r AS (SELECT pos, item_id, s AS status, list_position(['summarized', 'corrected', 'transcript_ready', 'summary_ready'], s) AS rank FROM mid) SELECT pos, item_id, status, CAST(rank AS BIGINT) AS rank FROM r WHERE rank > 0"
ORACLES["combined_stats"] = f"""WITH st AS ({ORACLES["stage_stats"]}) SELECT coalesce(sum(n) FILTER (outcome IN ('downloaded', 'transcribed')), 0) AS processed, coalesce(sum(n) FILTER (outcome = 'transcribed'), 0) AS transcript_ready, coalesce(sum(n) FILTER (outcome = 'corrected'), 0) AS corrected,
  coalesce(sum(n) FILTER (outcome = 'summarized'), 0) AS summarized, coalesce(sum(n) FILTER (outcome = 'download_failed'), 0) AS download_failed, coalesce(sum(n) FILTER (outcome = 'error' AND stage <> 'upload'), 0) AS error FROM st"""
ORACLES["catalog_files"] = """WITH p AS (SELECT *, row_number() OVER (ORDER BY CAST(doc_id // 100 AS VARCHAR), doc_id) - 1 AS pos FROM documents WHERE doc_id // 100 % 5 <> 4)
  SELECT pos, CAST(doc_id AS VARCHAR) AS item_id, source AS title, 'http://h/' || doc_id AS url, CAST(n_chars AS INT) AS duration_s, lang AS author, doc_id AS aid FROM p WHERE doc_id % 7 <> 0"""
ORACLES["state_files"] = f"WITH {_CURRENT} SELECT item_id, status, CASE WHEN status = 'error' THEN 'failed' END AS error, status = 'error' AS has_error FROM cur"
ORACLES["queue_files"] = f"""WITH {_CURRENT}, r AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS item_id, d.* EXCLUDE (doc_id) FROM documents d), q AS (SELECT r.*, row_number() OVER (ORDER BY doc_id) AS k FROM r LEFT JOIN cur USING (item_id) WHERE coalesce(status, 'new') IN {_QUEUEABLE})
  SELECT k - 1 AS pos, item_id, substr(text, 1, 60) AS title, 'https://example.org/' || item_id AS url, CAST(n_chars AS INT) AS duration_s, source AS author, 1700000000 + doc_id * 60 AS pubdate FROM q WHERE k <= 50"""
ORACLES["document_files"] = "SELECT doc_id AS item_id, CASE WHEN doc_id % 2 = 0 THEN 'transcript' ELSE 'final' END AS stage, source || '/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.md' ELSE '.final.md' END AS path, md5(text) AS digest FROM documents"
ORACLES["text_files"] = "SELECT source, sum(length(text) + 1) AS n_chars, sum(octet_length(encode(text)) + 1) AS n_bytes FROM documents GROUP BY source"
ORACLES["eval_files"] = "SELECT lang, 'e' AS engine, count(*) AS n, CAST(0.5 * count(*) AS DOUBLE) AS seconds FROM documents GROUP BY lang"
ORACLES["state_stream"] = "SELECT CAST(user_id AS VARCHAR) AS item_id, max(event_id) AS seq, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id"
ORACLES["ingest_stream"] = f"""WITH {_CURRENT}, k AS (SELECT CAST(doc_id AS VARCHAR) AS item_id FROM documents WHERE n_chars >= 300) SELECT item_id, coalesce(status, 'new') AS status, k.item_id IS NOT NULL AS seen, k.item_id IS NOT NULL AND coalesce(status, 'new') IN {_QUEUEABLE} AS queued FROM cur FULL JOIN k USING (item_id)"""
ORACLES["ingest_in_order"] = f"""WITH {_CURRENT}, p AS (SELECT CAST(doc_id AS VARCHAR) AS item_id, n_chars, row_number() OVER (ORDER BY doc_id // 100 % 5, CAST(doc_id // 100 AS VARCHAR), doc_id) - 1 AS pos FROM documents)
  SELECT pos, item_id, coalesce(status, 'new') AS status FROM p LEFT JOIN cur USING (item_id) WHERE n_chars >= 300 AND coalesce(status, 'new') IN {_QUEUEABLE} ORDER BY pos LIMIT 120"""
ORACLES["upsert_stream"] = """WITH u AS (SELECT CAST(user_id AS VARCHAR) AS item_id, event_id, event_type AS t FROM events),
  g AS (SELECT item_id, arg_max(t, event_id) FILTER (t <> 'click') AS s, arg_max(row(CASE WHEN t = 'error' THEN 'at ' || event_id END), event_id) FILTER (t IN ('error', 'signup')) AS e FROM u GROUP BY item_id),
  k AS (SELECT CAST(c_custkey AS VARCHAR) AS item_id, 'known' AS status, 'old' AS error FROM customer)
  SELECT item_id, coalesce(s, status) AS status, CASE WHEN e IS NULL THEN error ELSE e[1] END AS error FROM k FULL JOIN g USING (item_id)"""
ORACLES["skipped_states"] = f"""WITH {_CURRENT}, sk AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS item_id, 'https://example.org/' || doc_id AS title, source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1),
  new AS (SELECT sk.* FROM sk LEFT JOIN cur USING (item_id) WHERE coalesce(status, 'new') = 'new')
  SELECT item_id, CASE WHEN title IS NULL THEN status ELSE 'skipped_ai' END AS status, title, source AS up_name, CASE WHEN title IS NOT NULL THEN 'now' END AS last_attempt FROM cur FULL JOIN new USING (item_id)"""
_ENTRIES = r"entry AS (SELECT entry, min((item_id << 16) + i) AS pos FROM (SELECT item_id, unnest(w) AS entry, unnest(range(len(w))) AS i FROM (SELECT item_id, regexp_extract_all(text, '\p{L}{6,}') AS w FROM benchmark)) GROUP BY entry)"
ORACLES["denied_texts"] = f"""WITH {_ENTRIES}, low AS (SELECT lower(entry) AS k, min(pos) AS pos, arg_min(entry, pos) AS entry FROM entry GROUP BY 1), hit AS (SELECT doc_id, arg_min(entry, pos) AS denied_by FROM documents JOIN low ON contains(lower(text), k) GROUP BY doc_id)
  SELECT doc_id, denied_by FROM documents LEFT JOIN hit USING (doc_id)"""
ORACLES["denied_authors"] = """WITH deny AS (SELECT 'C' || substr(s_name, 11, 20) AS entry, s_suppkey AS pos FROM supplier WHERE s_name IS NOT NULL), c AS (SELECT c_custkey AS item_id, replace(c_name, 'ustomer#', '') AS author FROM customer),
  hit AS (SELECT item_id, arg_min(entry, pos) AS denied_by FROM c JOIN deny ON contains(lower(author), lower(entry)) GROUP BY item_id) SELECT item_id, denied_by FROM c LEFT JOIN hit USING (item_id)"""
ORACLES["phrase_tables"] = f"""WITH {_ENTRIES}, p AS (SELECT '(' || string_agg(entry, '|' ORDER BY length(entry) DESC, entry) || ')' AS p FROM entry), m AS (SELECT doc_id, regexp_replace(text, p, '<' || chr(1) || '\\1' || chr(2) || '>', 'g') AS t FROM documents, p),
  s AS (SELECT doc_id, string_split(t, chr(1)) AS parts FROM m)
  SELECT doc_id, md5(array_to_string(list_transform(parts, lambda x: CASE WHEN contains(x, chr(2)) THEN split_part(x, chr(2), 1) || replace(split_part(x, chr(2), 2), 'e', 'é') ELSE replace(x, 'e', 'é') END), '')) AS digest FROM s"""
ORACLES["placed_texts"] = "SELECT source || '/' || doc_id % 97 || '.final.md' AS path, md5(arg_min(text, doc_id)) AS digest FROM documents GROUP BY 1"
ORACLES["state_entries"] = f"""WITH {_CURRENT}, k AS (SELECT CAST(c_custkey AS VARCHAR) AS item_id, c_acctbal, c_nationkey FROM customer)
  SELECT item_id, coalesce(status, 'known') AS status, CASE WHEN status = 'error' THEN 'failed' END AS error, cur.item_id IS NOT NULL AS has_error, k.item_id IS NOT NULL AS has_note, round(CAST(c_acctbal AS DOUBLE), 2) AS balance, CAST(c_nationkey AS BIGINT) AS nation FROM k FULL JOIN cur USING (item_id)"""
ORACLES["asked_once"] = "SELECT CAST(conv_id AS VARCHAR) AS item_id, CAST(turn AS INT) AS seq, md5('<think>hm</think>' || lower(role) || ' ' || split_part(text, '.', 1)) AS digest, CAST(NULL AS VARCHAR) AS error FROM conversations"
ORACLES["merged_state"] = f"""WITH {_CURRENT}, err AS (SELECT item_id, arg_max(row(CASE WHEN status = 'error' THEN 'failed' END), row(ts, event_id)) AS e FROM log WHERE status IN ('error', 'new') GROUP BY item_id),
  u AS (SELECT item_id, cur.status AS s, e FROM cur LEFT JOIN err USING (item_id)), k AS (SELECT CAST(c_custkey AS VARCHAR) AS item_id, 'known' AS status, 'old' AS error FROM customer)
  SELECT item_id, coalesce(s, status) AS status, CASE WHEN e IS NULL THEN error ELSE e[1] END AS error FROM k FULL JOIN u USING (item_id)"""
_TITLED = "it AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS item_id, 'T' || conv_id AS title, CASE WHEN conv_id % 2 = 0 THEN 'U' ELSE '' END AS author FROM conversations)"
ORACLES["diarized_turns"] = f"""WITH {_SPANS}, z AS (SELECT item_id, seq, speaker, s - min(s) OVER (PARTITION BY item_id) AS s FROM span),
  p AS (SELECT item_id, max(s) <= 720 AS reused FROM z GROUP BY item_id HAVING count(DISTINCT CASE WHEN s < 720 THEN speaker END) > 1) SELECT item_id, seq, speaker, reused FROM z JOIN p USING (item_id)"""
ORACLES["filter_publish_stats"] = f"""WITH {_CURRENT}, {_CATALOG}, r AS (SELECT coalesce(status, 'new') AS s FROM cat LEFT JOIN cur USING (item_id)), x AS (
  SELECT 'filter' AS stage, unnest(CASE WHEN s = 'error' THEN ['kept', 'error'] WHEN s = 'uploaded' THEN ['skipped'] ELSE ['kept'] END) AS outcome FROM r
  UNION ALL SELECT 'publish', CASE WHEN s NOT IN ('new', 'error') THEN 'converted' ELSE 'error' END FROM r) SELECT stage, outcome, count(*) AS n FROM x GROUP BY ALL"""
ORACLES["report_text"] = f"""WITH rp AS ({ORACLES["eval_report"]}), ln AS (SELECT string_agg('| ' || concat_ws(' | ', number, config_name, engine, chars, paragraphs, CAST(CAST(seconds AS DECIMAL(18, 1)) AS VARCHAR), status) || ' |', chr(10) ORDER BY config_name) AS body FROM rp)
  SELECT array_to_string(['# ASR 转录基准测试报告', '', '**测试视频**: documents', '**测试时间**: 2024-01-01 00:00:00', '', '## 结果对比', '', '| # | 配置 | 引擎 | 字符数 | 段落数 | 耗时(秒) | 状态 |', '|---|------|------|--------|--------|----------|------|', body,
    '', '> ⭐ = 最多字符数 (可能意味着最完整的转录)', '', '## 详细参数', '', '### 1_de', '- d', '- e', '', '### 1_en', ''], chr(10)) AS text FROM ln"""
ORACLES["rendered_plain"] = f"""WITH {_TALK}, {_TITLED}, l AS (SELECT item_id, list(t ORDER BY seq) AS s FROM talk WHERE t <> '' AND CAST(item_id AS BIGINT) % 3 <> 0 GROUP BY item_id),
  f AS (SELECT item_id, {_FOLD.format(items="s", limit=500, join="''", plus=0)} AS r FROM l), p AS (SELECT item_id, array_to_string(list_append(r.o, r.c), chr(10) || chr(10)) AS body FROM f)
  SELECT item_id, md5('# ' || title || chr(10) || chr(10) || CASE WHEN body IS NULL OR author <> '' THEN '**UP主**: ' || author || chr(10) || chr(10) ELSE '' END || '---' || chr(10) || chr(10) || coalesce(body || chr(10), '(转录失败或无文字内容)')) AS digest FROM it LEFT JOIN p USING (item_id)"""
ORACLES["rendered_with_ids"] = f"""WITH {_STRONG}, {_TITLED}, m AS (SELECT talk.item_id, seq, t, CASE WHEN significant THEN talk.speaker END AS own FROM talk LEFT JOIN sig USING (item_id, speaker) WHERE t <> ''),
  ef AS (SELECT m.item_id, m.seq, m.t, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY m.item_id ORDER BY m.seq), best.speaker) AS e FROM m LEFT JOIN (SELECT item_id, speaker FROM sig WHERE prominent) best USING (item_id)),
  nw AS (SELECT *, CASE WHEN seq > min(seq) OVER (PARTITION BY item_id) AND lag(e) OVER (PARTITION BY item_id ORDER BY seq) IS NOT DISTINCT FROM e THEN 0 ELSE 1 END AS new FROM ef),
  bl AS (SELECT *, sum(new) OVER (PARTITION BY item_id ORDER BY seq) AS block FROM nw), se AS (SELECT item_id, block, e, string_agg(t, '' ORDER BY seq) AS text FROM bl GROUP BY item_id, block, e),
  sp AS (SELECT *, list_filter(list_transform(regexp_extract_all(text, '[^。！？；.!?;]*[。！？；.!?;]|[^。！？；.!?;]+$'), lambda x: trim(x, E' \\t\\n\\r')), lambda x: x <> '') AS s FROM se),
  fo AS (SELECT *, CASE WHEN len(s) > 0 THEN {_FOLD.format(items="s", limit=500, join="''", plus=0)} END AS r FROM sp), packed AS (SELECT item_id, block, e, CASE WHEN text = '' THEN [] WHEN len(s) = 0 THEN [text] ELSE list_append(r.o, r.c) END AS p FROM fo),
  sv AS (SELECT item_id, count(*) > 1 AS several FROM sig WHERE significant GROUP BY item_id),
  pa AS (SELECT item_id, block, list_transform(p, lambda x: CASE WHEN several THEN '**' || CASE WHEN e = 'user' THEN '[说话人 A]' ELSE '[' || e || ']' END || '** ' ELSE '' END || x) AS p FROM packed LEFT JOIN sv USING (item_id)),
  bd AS (SELECT item_id, array_to_string(flatten(list(p ORDER BY block)), chr(10) || chr(10)) AS body FROM pa GROUP BY item_id)
  SELECT item_id, md5('# ' || title || chr(10) || chr(10) || coalesce(nullif(body, ''), '(转录失败或无文字内容)') || chr(10)) AS digest FROM it LEFT JOIN bd USING (item_id)"""
