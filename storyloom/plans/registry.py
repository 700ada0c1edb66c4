"""Registry of queries with the equivalent SQL, and the SQL twins of the item views."""

from __future__ import annotations

import re

from storyloom import constants as K

QUERIES: dict = {}
SQL: dict = {}

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"



def _quoted(words) -> str:
    return ", ".join("'" + w + "'" for w in words)


# SQL twins of storyloom.plans.tables, in dependency order; a statement pulls in those it names
VIEWS = {
    "doc_base": """
        SELECT d.*, md5(text) AS text_digest,
               TIMESTAMP '2024-01-01 00:00:00' + to_hours((doc_id % 720)::INTEGER) AS slot
        FROM documents d""",
    "items": f"""
        SELECT doc_id AS id,
          CASE WHEN doc_id % 11 = 0 THEN 'telegram' WHEN doc_id % 31 = 5 THEN 'manual' ELSE 'rss' END AS source_type,
          doc_id::VARCHAR AS source_id,
          CASE doc_id % 10 WHEN 3 THEN 'tw_' || source WHEN 6 THEN 'gh_stars_' || source WHEN 9 THEN 'gh_' || source
               WHEN 8 THEN '@' || source ELSE source END AS feed_name,
          NULL::VARCHAR AS author,
          CASE WHEN doc_id % 37 = 0 THEN NULL
               WHEN doc_id % 10 IN (6, 9) THEN 'https://github.com/' || source || '/repo-' || doc_id::VARCHAR || '.git'
               ELSE 'https://www.Feeds.example.com/item/' || text_digest || '/?utm_source=' || source || '&b=2&a=1#top' END AS url,
          CASE WHEN doc_id % 5 <> 0 THEN substring(split_part(text, chr(10), 1), 1, 60) END AS title,
          text, text_digest, lang,
          CASE WHEN doc_id % 3 <> 0 THEN lang END AS category,
          (doc_id % 7) / 7::DOUBLE AS raw_score,
          CASE WHEN doc_id % 13 <> 0 THEN (doc_id % 9) / 9::DOUBLE END AS insight_score,
          CASE WHEN doc_id % 17 <> 0 THEN slot END AS published_at,
          slot + INTERVAL 10 MINUTE AS fetched_at,
          CASE WHEN doc_id % 23 <> 0 THEN slot + INTERVAL 10 MINUTE + to_minutes((doc_id % 50)::INTEGER) END AS processed_at,
          CASE WHEN doc_id % 17 <> 0 THEN slot ELSE slot + INTERVAL 10 MINUTE END AS sort_ts,
          CASE doc_id % 4 WHEN 0 THEN 'business' WHEN 1 THEN 'it' WHEN 2 THEN 'medical' END AS vertical,
          CASE WHEN doc_id % 58 = 0 THEN '{K.MUTE_PREFIX}t3'
               WHEN doc_id % 29 = 0 THEN 'низкая близость к профилям: 0.21 (ближе всего it)' END AS skip_reason,
          CASE WHEN doc_id % 4 <> 3 AND doc_id % 19 <> 0 THEN ((doc_id * 37) % 101) / 101::DOUBLE END AS personal_score,
          ((doc_id * 53) % 97) / 97::DOUBLE AS score,
          CASE WHEN doc_id % 13 = doc_id % 5 THEN [source, lang, 't' || (doc_id % 13)::VARCHAR]
               ELSE [source, lang, 't' || (doc_id % 13)::VARCHAR, 't' || (doc_id % 5)::VARCHAR] END AS tags,
          CASE doc_id % 8 WHEN 1 THEN ['Claude'] WHEN 5 THEN ['Iran', 'Природные явления'] ELSE []::VARCHAR[] END AS watch_topics,
          CASE WHEN doc_id % 6 <> 0 THEN substring(text, 1, 120) END AS summary,
          CASE WHEN doc_id % 16 = 0 THEN NULL WHEN doc_id % 15 = 0 THEN 'old' ELSE 'm1' END AS embedding_model,
          CASE WHEN doc_id % 14 = 0 THEN NULL WHEN doc_id % 9 = 0 THEN 0 ELSE 1 END AS embedding_version,
          CASE WHEN doc_id % 23 = 0 THEN (doc_id // 23) % 26 ELSE 0 END AS attempts,
          CASE WHEN doc_id % 2 = 0 THEN slot + INTERVAL 40 MINUTE END AS retry_after,
          CASE WHEN doc_id % 12 = 0 THEN slot + INTERVAL 30 MINUTE END AS pushed_at,
          CASE WHEN doc_id % 18 = 0 THEN slot + INTERVAL 35 MINUTE END AS channel_posted_at,
          CASE WHEN doc_id % 33 = 0 THEN slot + INTERVAL 40 MINUTE END AS star_posted_at,
          doc_id % 3 AS scored_profile_version,
          CASE WHEN doc_id % 41 <> 0 THEN min(doc_id) OVER (PARTITION BY text_digest) END AS cluster_id
        FROM doc_base""",
    "judged": "SELECT i.*, l.quality::DOUBLE AS llm_relevance FROM items i LEFT JOIN labels l ON l.doc_id = i.id",
    "visible": "SELECT * FROM items WHERE processed_at IS NOT NULL AND skip_reason IS NULL",
    "clicks": """
        SELECT event_id, ts, user_id, k AS item_id,
          CASE event_type WHEN 'click' THEN 'up' WHEN 'purchase' THEN 'save' WHEN 'error' THEN 'down'
               WHEN 'signup' THEN 'mute_topic' WHEN 'view' THEN 'open' END AS signal,
          CASE WHEN event_type = 'signup' THEN 't' || (k % 13)::VARCHAR END AS topic
        FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events)""",
    "actions": """
        SELECT *, CASE WHEN nth % 2 = 1 THEN 'added' ELSE 'removed' END AS action
        FROM (SELECT *, row_number() OVER (PARTITION BY item_id, signal, topic ORDER BY ts, event_id) AS nth FROM clicks)""",
    "marks": """
        SELECT item_id, signal, topic, max(ts) AS marked_at FROM clicks
        GROUP BY item_id, signal, topic HAVING count(*) % 2 = 1""",
    "steps": """
        SELECT a.event_id, a.ts, a.item_id, a.signal, a.action, i.vertical, i.tags, i.source_type,
          coalesce(i.feed_name, '') AS source_key,
          CASE WHEN (a.signal IN ('up', 'save')) = (a.action = 'added') THEN 1 ELSE -1 END AS direction
        FROM actions a JOIN items i ON i.id = a.item_id
        WHERE a.signal IN ('up', 'down', 'save') AND i.vertical IS NOT NULL""",
    "tag_ranked": """
        SELECT vertical, tag, direction,
          row_number() OVER (PARTITION BY vertical, tag ORDER BY ts DESC, event_id DESC) - 1 AS after
        FROM (SELECT *, unnest(tags) AS tag FROM steps)""",
    "tag_aff": """
        SELECT vertical, tag, sum(0.1::DOUBLE * pow(0.9::DOUBLE, after) * direction) AS weight,
          count(*) FILTER (WHERE direction > 0) AS n_pos, count(*) FILTER (WHERE direction < 0) AS n_neg
        FROM tag_ranked GROUP BY vertical, tag""",
    "source_ranked": """
        SELECT vertical, source_type, source_key, direction,
          row_number() OVER (PARTITION BY vertical, source_type, source_key ORDER BY ts DESC, event_id DESC) - 1 AS after
        FROM steps""",
    "source_aff": """
        SELECT vertical, source_type, source_key, sum(0.1::DOUBLE * pow(0.9::DOUBLE, after) * direction) AS weight,
          count(*) FILTER (WHERE direction > 0) AS n_pos, count(*) FILTER (WHERE direction < 0) AS n_neg
        FROM source_ranked GROUP BY vertical, source_type, source_key""",
    "vecs": "SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label FROM embeddings",
    "liked_vecs": """
        SELECT i.vertical, v.vec FROM marks m JOIN items i ON i.id = m.item_id JOIN vecs v ON v.id = m.item_id
        WHERE m.signal IN ('up', 'save') AND i.vertical IS NOT NULL""",
    "taste_parts": """
        SELECT vertical, pos, avg(vec[pos]) AS m, count(*) AS n
        FROM (SELECT vertical, vec, unnest(range(1, len(vec) + 1)) AS pos FROM liked_vecs) GROUP BY vertical, pos""",
    "taste": "SELECT vertical, max(n) AS n_liked, list(m ORDER BY pos) AS vec FROM taste_parts GROUP BY vertical",
    "profile_parts": """
        SELECT CASE label WHEN 0 THEN 'business' WHEN 1 THEN 'it' ELSE 'medical' END AS vertical, pos, avg(vec[pos]) AS m
        FROM (SELECT label, vec, unnest(range(1, len(vec) + 1)) AS pos FROM vecs WHERE label IN (0, 1, 2)) GROUP BY 1, 2""",
    "profile_vecs": "SELECT vertical, list(m ORDER BY pos) AS vec FROM profile_parts GROUP BY vertical",
    "mutes_learned": """
        SELECT vertical, topic AS tag FROM (
          SELECT i.vertical, a.topic, max_by(a.action, (a.ts, a.event_id)) AS last_action
          FROM actions a JOIN items i ON i.id = a.item_id
          WHERE a.signal = 'mute_topic' AND i.vertical IS NOT NULL GROUP BY 1, 2) WHERE last_action = 'added'""",
    "profiles": """
        SELECT * FROM (VALUES
          ('business', 1, 'Markets and companies', [{'name': 't1', 'polarity': 'like'}, {'name': 't2', 'polarity': 'mute'}]),
          ('business', 2, 'Markets  and   companies', [{'name': 't1', 'polarity': 'love'}, {'name': 't3', 'polarity': 'like'}, {'name': 't4', 'polarity': 'dislike'}, {'name': 'solar', 'polarity': 'like'}]),
          ('it', 1, 'Engineering', [{'name': 't1', 'polarity': 'love'}, {'name': 't5', 'polarity': 'mute'}]),
          ('it', 2, 'Engineering and tools', [{'name': 't1', 'polarity': 'love'}, {'name': 't6', 'polarity': 'like'}, {'name': 't7', 'polarity': 'mute'}, {'name': 't8', 'polarity': 'meh'}]),
          ('medical', 1, 'Clinical research', [{'name': 't9', 'polarity': 'mute'}, {'name': 'en', 'polarity': 'like'}])
        ) t(vertical, version, description, topics)""",
    "active": "SELECT * FROM profiles p WHERE version = (SELECT max(version) FROM profiles x WHERE x.vertical = p.vertical)",
    "topics": "SELECT vertical, t.name AS tag, t.polarity AS polarity FROM (SELECT vertical, unnest(topics) AS t FROM active)",
    "edited": """
        SELECT * FROM (VALUES
          ('business', 'Markets and companies', [{'name': 't1', 'polarity': 'love'}, {'name': 't3', 'polarity': 'dislike'}, {'name': 't10', 'polarity': 'like'}]),
          ('it', 'Engineering, tools', [{'name': 't1', 'polarity': 'love'}, {'name': 't6', 'polarity': 'like'}, {'name': 't7', 'polarity': 'mute'}]),
          ('medical', 'Clinical research', [{'name': 't9', 'polarity': 'mute'}, {'name': 'en', 'polarity': 'like'}])
        ) t(vertical, description, topics)""",
    "edited_topics": "SELECT vertical, t.name AS tag, t.polarity AS polarity FROM (SELECT vertical, unnest(topics) AS t FROM edited)",
    "topic_changes": """
        SELECT coalesce(o.vertical, n.vertical) AS vertical, coalesce(o.tag, n.tag) AS tag,
          o.polarity AS old_polarity, n.polarity AS new_polarity,
          CASE WHEN o.polarity IS NULL THEN 'added' WHEN n.polarity IS NULL THEN 'removed'
               WHEN o.polarity <> n.polarity THEN 'changed' ELSE 'same' END AS change
        FROM topics o FULL JOIN edited_topics n ON o.vertical = n.vertical AND o.tag = n.tag""",
    "muted": "SELECT vertical, tag FROM topics WHERE polarity = 'mute' UNION SELECT vertical, tag FROM mutes_learned",
    "muted_hits": """
        SELECT id, min_by(tag, pos) AS muted_tag FROM (
          SELECT id, vertical, unnest(tags) AS tag, unnest(range(1, len(tags) + 1)) AS pos FROM items WHERE vertical IS NOT NULL) x
        JOIN muted USING (vertical, tag) GROUP BY id""",
    "tag_parts": """
        SELECT id, avg(weight) AS tag_aff FROM (SELECT id, vertical, unnest(list_distinct(tags)) AS tag FROM items WHERE vertical IS NOT NULL) x
        JOIN tag_aff USING (vertical, tag) GROUP BY id""",
    "scored_parts": f"""
        SELECT j.id, j.vertical, j.watch_topics, j.llm_relevance, h.muted_tag,
          coalesce(tp.tag_aff, 0) AS tag_aff, coalesce(sa.weight, 0) AS source_aff, coalesce(t.n_liked, 0) AS n_liked,
          CASE WHEN t.n_liked > 0 AND v.vec IS NOT NULL THEN list_cosine_similarity(v.vec, t.vec) ELSE 0 END AS taste_cos,
          exp(-greatest(coalesce(date_diff('second', j.published_at, {AS_OF}) / 3600::DOUBLE, 24), 0) / 48) AS fresh
        FROM judged j LEFT JOIN muted_hits h ON h.id = j.id LEFT JOIN tag_parts tp ON tp.id = j.id
        LEFT JOIN source_aff sa ON sa.vertical = j.vertical AND sa.source_type = j.source_type AND sa.source_key = coalesce(j.feed_name, '')
        LEFT JOIN taste t ON t.vertical = j.vertical LEFT JOIN vecs v ON v.id = j.id""",
    "scored": """
        SELECT *, CASE WHEN vertical IS NULL OR muted_tag IS NOT NULL THEN NULL
          WHEN len(list_filter(watch_topics, lambda x: x <> 'Природные явления')) > 0 THEN least(1.0::DOUBLE, plain + 0.15) ELSE plain END AS ps
        FROM (SELECT *, 0.5 * coalesce(llm_relevance, 0) + 0.2 * least(1.0, n_liked / 20::DOUBLE) * taste_cos
                + 0.15 * tag_aff + 0.1 * source_aff + 0.05 * fresh AS plain FROM scored_parts)""",
    "requests": """
        SELECT b.item_id AS query_id, e.embedding::DOUBLE[] AS query_vec,
          CASE b.item_id % 4 WHEN 0 THEN 'latest ' || b.text WHEN 1 THEN b.text || ' github tools' ELSE b.text END AS query
        FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id""",
    "request_words": """
        SELECT query_id, list_transform(regexp_extract_all(query, '[0-9a-zA-Zа-яёА-ЯЁ]{2,}'), lambda w: lower(w)) AS words FROM requests""",
    "request_terms": f"""
        SELECT DISTINCT query_id, unnest(list_filter(words, lambda w: w NOT IN ({_quoted(K.STOP_WORDS)}) AND w NOT IN ({_quoted(K.FRESH_WORDS)}))) AS term
        FROM request_words""",
    "doc_words": "SELECT id, regexp_extract_all(lower(concat_ws(' ', title, text)), '[\\p{L}\\p{N}]+') AS words FROM visible",
    "postings": "SELECT id, length, term, count(*) AS tf FROM (SELECT id, len(words) AS length, unnest(words) AS term FROM doc_words) WHERE term IN (SELECT term FROM request_terms) GROUP BY id, length, term",
    "idf": """
        SELECT term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, avg_length
        FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), (SELECT count(*) AS n, avg(len(words)) AS avg_length FROM doc_words)""",
    "lex_hits": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, id) - 1 AS rank FROM (
          SELECT t.query_id, p.id, sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / avg_length))) AS bm25
          FROM request_terms t JOIN postings p ON p.term = t.term JOIN idf i ON i.term = t.term GROUP BY 1, 2)) WHERE rank < 80""",
    "sem_hits": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, id) - 1 AS rank FROM (
          SELECT r.query_id, v.id, list_cosine_similarity(r.query_vec, v.vec) AS cos FROM requests r, vecs v WHERE r.query_vec IS NOT NULL)
          WHERE cos >= 0.2) WHERE rank < 80""",
    "hit_pool": """
        SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY f) AS pos FROM (
          SELECT query_id, id, min((list_no, rank)) AS f FROM (
            SELECT query_id, id, rank, 0 AS list_no FROM sem_hits UNION ALL SELECT query_id, id, rank, 1 FROM lex_hits) GROUP BY 1, 2)""",
    "hit_facts": f"""
        SELECT p.query_id, p.pos, v.*, list_has_any(w.words, [{_quoted(K.FRESH_WORDS)}]) AS wants_fresh, list_has_any(w.words, [{_quoted(K.PROJECT_WORDS)}]) AS wants_project
        FROM hit_pool p JOIN visible v ON v.id = p.id JOIN request_words w ON w.query_id = p.query_id""",
    "hit_lists": """
        SELECT query_id, id, rank, 0 AS list_no FROM sem_hits UNION ALL SELECT query_id, id, rank, 1 FROM lex_hits
        UNION ALL SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY sort_ts DESC, pos) - 1, 2 FROM hit_facts WHERE wants_fresh
        UNION ALL SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1, 3 FROM hit_facts
          WHERE wants_project AND (starts_with(feed_name, 'gh_') OR coalesce(contains(url, 'github.com'), false))""",
    "fused_hits": "SELECT query_id, id, sum(1 / (60 + rank)::DOUBLE) AS rrf, min((list_no, rank)) AS first_seen FROM hit_lists GROUP BY 1, 2",
    "hybrid_hits": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, first_seen) AS rank FROM (
          SELECT h.query_id, h.id, h.rrf, h.first_seen, row_number() OVER (PARTITION BY h.query_id, f.cluster_id IS NULL, coalesce(f.cluster_id, f.id)
            ORDER BY round(h.rrf, 12) DESC, h.first_seen) AS c
          FROM fused_hits h JOIN hit_facts f ON f.query_id = h.query_id AND f.id = h.id) WHERE c = 1) WHERE rank <= 40""",
    "mention_sources": """
        SELECT id AS seq, tags, feed_name, lang, strftime(processed_at, '%Y-%m-%d') AS date, trim(coalesce(title, '')) AS note,
          'sources/' || id::VARCHAR || '-' || coalesce(nullif(trim(substring(trim(regexp_replace(lower(trim(coalesce(nullif(title, ''), 'source'))), '[^0-9a-zA-Zа-яёА-ЯЁ]+', '-', 'g'), '-'), 1, 60), '-'), ''), 'untitled') AS source_ref
        FROM visible""",
    "mention_rows": """
        SELECT kind, slug, source_ref, arg_min(name, pos) AS name, any_value(date) AS date, any_value(seq) AS seq, arg_min(note, pos) AS note, min(pos) AS pos FROM (
          SELECT *, coalesce(nullif(trim(substring(trim(regexp_replace(lower(trim(name)), '[^0-9a-zA-Zа-яёА-ЯЁ]+', '-', 'g'), '-'), 1, 60), '-'), ''), 'untitled') AS slug FROM (
            SELECT 'concepts' AS kind, unnest(tags[1:5]) AS name, unnest(range(0, len(tags[1:5]))) AS pos, source_ref, date, seq, note FROM mention_sources
            UNION ALL SELECT 'entities', unnest([feed_name, lang]), unnest([0, 1]), source_ref, date, seq, note FROM mention_sources))
        GROUP BY kind, slug, source_ref""",
    "wiki_pages": """
        SELECT kind, slug, arg_min(name, (date, seq, pos)) AS title, arg_min(note, (date, seq, pos)) AS note, count(*) AS mentions FROM mention_rows GROUP BY kind, slug""",
    "wiki_bodies": """
        SELECT p.kind, p.slug, '# ' || p.title || chr(10) || chr(10) || p.note || chr(10) || chr(10) || '## Упоминания' || chr(10) ||
          string_agg('- [' || m.date || '] ' || m.note || ' — [[' || m.source_ref || ']]', chr(10)) AS body
        FROM wiki_pages p JOIN mention_rows m ON m.kind = p.kind AND m.slug = p.slug GROUP BY p.kind, p.slug, p.title, p.note""",
    "wiki_sources": f"""
        SELECT 'sources' AS kind, split_part(source_ref, '/', -1) AS slug, title, rtrim(body, ' ' || chr(10)) AS body FROM (
          SELECT m.source_ref, coalesce(nullif(v.title, ''), '{K.UNTITLED}') AS title, '# ' || coalesce(nullif(v.title, ''), '{K.UNTITLED}') || chr(10) || chr(10) || '{K.WIKI_SAVED}' || m.date || '{K.WIKI_FROM}' || v.feed_name || chr(10)
            || CASE WHEN coalesce(v.url, '') <> '' THEN '- ' || v.url ELSE '' END || chr(10) || array_to_string(list_transform(v.tags[1:6], lambda t: '#' || t), ' ') || chr(10) || chr(10)
            || trim(coalesce(nullif(v.summary, ''), nullif(trim(regexp_replace(v.text, '\\s+', ' ', 'g')), ''), '')) AS body
          FROM visible v JOIN mention_sources m ON m.seq = v.id)""",
    "wiki_all_pages": """
        SELECT kind, slug, title, mentions FROM wiki_pages UNION ALL
        SELECT kind, slug, title, (len(body) - len(replace(body, chr(10) || '- [', ''))) // 4 FROM wiki_sources""",
    "wiki_all_bodies": "SELECT kind, slug, body FROM wiki_bodies UNION ALL SELECT kind, slug, body FROM wiki_sources",
}


def with_views(sql: str) -> str:
    """The statement preceded by the views it needs."""
    needed, frontier = set(), sql
    while True:
        found = {v for v in VIEWS if v not in needed and re.search(rf"\b{v}\b", frontier)}
        if not found:
            break
        needed |= found
        frontier = " ".join(VIEWS[v] for v in found)
    ctes = ", ".join(f"{v} AS ({VIEWS[v]})" for v in VIEWS if v in needed)
    body = sql.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"


def query(name: str, sql: str | None = None):
    """Register a query under `name`, with its SQL twin where there is one."""

    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_views(sql)
        return fn

    return deco
