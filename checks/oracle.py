"""DuckDB statements that compute the registered queries independently, on the same tables."""

from __future__ import annotations

import os

from reviewmill import constants as C
from reviewmill.operators import enrichment, extractive
from reviewmill.plans.queries import SPAM_PHRASES

# the documented bounds, spelled out so that a wrong constant in the engine shows
TINY = 50
MIN_NEGATIVES, SAMPLE, NEAREST = 5, 20, 10
TARGET_SPAM_RATIO, MIN_POSITIVE_SIMILARITY, MIN_SIMILARITY_GAP, URL_SCORE_BOOST = 0.06, 0.32, 0.03, 0.1
MMR_LAMBDA, SEED = 0.6, 42
MAX_ISSUES, MAJOR_SHARE, POSITIVE_SHARE, NEGATIVE_SHARE = 5, 0.2, 0.7, 0.3
TERM_PATTERN = r"[\p{L}\p{N}]{2,}"
BLOCKER_PATTERN = r"(crash|freez|won.t (start|launch)|cannot progress|game.?breaking)"


def q(text: str) -> str:
    """SQL string literal, with control characters spelled out."""
    parts, plain = [], ""
    for ch in text:
        if ord(ch) < 32 or ch == "\x85":
            if plain:
                parts.append("'" + plain.replace("'", "''") + "'")
                plain = ""
            parts.append(f"chr({ord(ch)})")
        else:
            plain += ch
    if plain or not parts:
        parts.append("'" + plain.replace("'", "''") + "'")
    return "(" + " || ".join(parts) + ")"


def with_(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def strip(text: str) -> str:
    return f"trim({text}, {q(C.WHITESPACE)})"


def clip(text: str, n: int, ellipsis: bool = True) -> str:
    line = strip(f"replace(coalesce({text}, ''), chr(10), ' ')")
    cut = f"substring({line}, 1, {n})"
    if not ellipsis:
        return cut
    return f"CASE WHEN length({line}) > {n} THEN {cut} || '…' ELSE {line} END"


def has_url(text: str) -> str:
    return f"regexp_matches({text}, {q('(?i)' + C.URL_PATTERN)})"


def case(key: str, table: dict, default: str) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v) if isinstance(v, str) else v}" for k, v in table.items())
    return f"CASE {key} {whens} ELSE {default} END"


REVIEWS = """reviews AS (
  SELECT d.doc_id AS review_id, d.text, d.lang, l.quality = 1 AS recommended,
         d.n_chars / CAST(100 AS DOUBLE) AS playtime_hours, CAST(NULL AS VARCHAR) AS posted_at
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
VECTORS = """vectors AS (
  SELECT vec_id AS review_id, embedding::DOUBLE[] AS emb, label AS cluster_id FROM embeddings)"""
MEMBERS = """members AS (
  SELECT r.*, v.emb, coalesce(v.cluster_id, -1) AS cluster_id
  FROM reviews r LEFT JOIN vectors v ON r.review_id = v.review_id)"""
PROTOTYPES = """prototypes AS (
  SELECT e.label AS pid, e.embedding::DOUBLE[] AS emb FROM embeddings e
  JOIN (SELECT label, min(vec_id) AS vec_id FROM embeddings WHERE label < 8 GROUP BY label) p
    ON e.vec_id = p.vec_id)"""
BASE = [REVIEWS, VECTORS, MEMBERS]


def scores(vectors: str = "vectors", reviews: str = "reviews") -> list[str]:
    return [
        PROTOTYPES,
        f"""sims AS (
  SELECT v.review_id, p.pid, list_cosine_similarity(v.emb, p.emb) AS s
  FROM {vectors} v, prototypes p)""",
        f"""scores AS (
  SELECT r.review_id, s.sim_pos, s.sim_neg, s.matched_prototype, {has_url('r.text')} AS has_url
  FROM (SELECT review_id, max(s) FILTER (WHERE pid < 5) AS sim_pos,
               max(s) FILTER (WHERE pid >= 5) AS sim_neg,
               'prototype ' || arg_max(pid, s) FILTER (WHERE pid < 5) AS matched_prototype
        FROM sims GROUP BY review_id) s
  RIGHT JOIN {reviews} r ON r.review_id = s.review_id)""",
        f"""threshold AS (
  SELECT greatest(coalesce(quantile_cont(sim_pos, 1.0 - {TARGET_SPAM_RATIO}), 1.0),
                  {MIN_POSITIVE_SIMILARITY}) AS t FROM scores)""",
        f"""flags AS (
  SELECT review_id,
         coalesce(sim_pos >= t AND sim_pos - sim_neg >= {MIN_SIMILARITY_GAP}, false) OR has_url AS is_spam,
         round(sim_pos - sim_neg + CASE WHEN has_url THEN {URL_SCORE_BOOST}::DOUBLE ELSE 0 END, 4)
           AS spam_score,
         round(sim_pos, 4) AS sim_pos, round(sim_neg, 4) AS sim_neg, has_url, matched_prototype
  FROM scores, threshold)""",
    ]


def centroids(source: str, name: str = "centroids") -> str:
    return f"""{name} AS (
  SELECT cluster_id, list(m ORDER BY pos) AS c, any_value(n) AS size FROM (
    SELECT cluster_id, pos, avg(x) AS m, count(*) AS n FROM (
      SELECT cluster_id, unnest(emb) AS x, generate_subscripts(emb, 1) AS pos FROM {source})
    GROUP BY cluster_id, pos) GROUP BY cluster_id)"""


def selection(source: str, n_near: int, n_mmr: int, where: str = "true") -> list[str]:
    """Nearest and diverse picks of the clusters whose centroid row satisfies the condition."""
    lam = MMR_LAMBDA
    ctes = [
        centroids(source),
        f"""relevance AS (
  SELECT s.cluster_id, s.review_id, s.emb, list_cosine_similarity(s.emb, c.c) AS rel
  FROM {source} s JOIN centroids c ON s.cluster_id = c.cluster_id WHERE {where})""",
        f"""nearest AS (
  SELECT cluster_id, review_id, rel, CAST(rank AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY rel DESC, review_id) AS rank
    FROM relevance) WHERE rank <= {n_near})""",
        """cand1 AS (
  SELECT r.*, CAST(NULL AS DOUBLE) AS pen FROM relevance r
  ANTI JOIN nearest n ON r.cluster_id = n.cluster_id AND r.review_id = n.review_id)""",
    ]
    for i in range(1, n_mmr + 1):
        ctes.append(f"""pick{i} AS (
  SELECT cluster_id, review_id, emb FROM (
    SELECT *, row_number() OVER (PARTITION BY cluster_id
        ORDER BY {lam}::DOUBLE * rel - {1 - lam}::DOUBLE * coalesce(pen, 0) DESC, review_id) AS k
    FROM cand{i}) WHERE k = 1)""")
        ctes.append(f"""cand{i + 1} AS (
  SELECT c.cluster_id, c.review_id, c.emb, c.rel,
         greatest(coalesce(c.pen, -2), list_cosine_similarity(c.emb, p.emb)) AS pen
  FROM cand{i} c JOIN pick{i} p ON c.cluster_id = p.cluster_id
  WHERE c.review_id <> p.review_id)""")
    union = " UNION ALL ".join(
        f"SELECT cluster_id, review_id, CAST({i} AS INTEGER) AS rank FROM pick{i}"
        for i in range(1, n_mmr + 1)
    )
    ctes.append(f"mmr AS ({union})")
    ctes.append(f"""picks AS (
  SELECT cluster_id, review_id, rank FROM nearest
  UNION ALL SELECT cluster_id, review_id, CAST(rank + {n_near} AS INTEGER) FROM mmr)""")
    return ctes


def silhouette(source: str, power: int = 1) -> list[str]:
    """Mean silhouette over all rows, from all pairs; power 2 takes squared Euclidean distances."""
    return [
        f"""means AS (
  SELECT a.review_id, a.cluster_id AS own, b.cluster_id AS other,
         avg(power(list_distance(a.emb, b.emb), {power})) AS d
  FROM {source} a JOIN {source} b ON a.review_id <> b.review_id
  GROUP BY a.review_id, a.cluster_id, b.cluster_id)""",
        """sides AS (
  SELECT review_id, max(d) FILTER (WHERE own = other) AS a,
         min(d) FILTER (WHERE own <> other) AS b FROM means GROUP BY review_id)""",
        f"""silhouette AS (
  SELECT CASE WHEN (SELECT count(DISTINCT cluster_id) FROM {source}) < 2 THEN -1.0::DOUBLE
  ELSE (SELECT avg(coalesce((b - a) / greatest(a, b), 0)) FROM sides) END AS value)""",
    ]


# the reviews that are no spam
ACTIVE_BASE = [
    REVIEWS, VECTORS, MEMBERS.replace("members AS", "all_members AS"), *scores(),
    """members AS (
  SELECT m.* FROM all_members m ANTI JOIN flags f ON f.review_id = m.review_id AND f.is_spam)""",
]


NEGATIVES = """negatives AS (
  SELECT v.review_id, v.cluster_id, v.emb FROM vectors v
  JOIN labels l ON l.doc_id = v.review_id WHERE l.quality <> 1)"""


def negative_picks() -> list[str]:
    return [
        NEGATIVES,
        *selection("negatives", NEAREST, SAMPLE - NEAREST, f"c.size > {SAMPLE}"),
        f"""sampled AS (
  SELECT cluster_id, review_id, rank FROM picks UNION ALL
  SELECT n.cluster_id, n.review_id,
         CAST(row_number() OVER (PARTITION BY n.cluster_id ORDER BY n.review_id) AS INTEGER)
  FROM negatives n JOIN centroids c ON n.cluster_id = c.cluster_id
  WHERE c.size <= {SAMPLE})""",
    ]


TERM = q(TERM_PATTERN)


def stop_words() -> list[str]:
    """Spark's lists, kept beside this module so that no installation is searched, and the engine's Korean list."""
    with open(os.path.join(os.path.dirname(os.path.abspath(__file__)), "stop_words.txt"), encoding="utf-8") as lines:
        words = {line.rstrip("\n") for line in lines if not line.startswith("#")}
    return sorted((words | set(extractive.KOREAN_STOP_WORDS)) - {""})


def class_terms(source: str) -> list[str]:
    """source: cluster_id (may be NULL), text."""
    return [
        f"""tokens AS (
  SELECT * FROM (
    SELECT cluster_id, unnest(regexp_extract_all(lower(text), {TERM})) AS term FROM {source})
  WHERE term NOT IN ({', '.join(map(q, stop_words()))}))""",
        "tf AS (SELECT cluster_id, term, count(*) AS tf FROM tokens GROUP BY cluster_id, term)",
        """mean_tokens AS (
  SELECT sum(n) / CAST(count(*) AS DOUBLE) AS a
  FROM (SELECT cluster_id, CAST(sum(tf) AS DOUBLE) AS n FROM tf GROUP BY cluster_id))""",
        """weighted AS (
  SELECT cluster_id, term, tf,
         tf * ln(1.0::DOUBLE + a / CAST(sum(tf) OVER (PARTITION BY term) AS DOUBLE)) AS weight
  FROM tf, mean_tokens)""",
    ]


KEYWORDS = """keywords AS (
  SELECT * FROM (
    SELECT cluster_id, term, tf, weight, CAST(row_number() OVER (
      PARTITION BY cluster_id ORDER BY weight DESC, term) AS INTEGER) AS rank FROM weighted)
  WHERE rank <= 10)"""

SENTIMENT = f"""sentiment AS (
  SELECT cluster_id, recommended_share,
         CASE WHEN recommended_share >= {POSITIVE_SHARE} THEN 'positive'
              WHEN recommended_share <= {NEGATIVE_SHARE} THEN 'negative'
              ELSE 'mixed' END AS sentiment
  FROM (SELECT cluster_id, avg(CAST(recommended AS INTEGER)) AS recommended_share
        FROM members GROUP BY cluster_id))"""

RATIO = """ratio AS (
  SELECT cluster_id, count(*) AS size,
         count(*) FILTER (WHERE recommended = false) AS negative_review_count,
         count(*) FILTER (WHERE recommended = false) / CAST(count(*) AS DOUBLE) AS negative_ratio
  FROM members GROUP BY cluster_id)"""

# topic records: words, sentiment, three nearest reviews
TOPICS = [
    *class_terms("members"), KEYWORDS, SENTIMENT, RATIO,
    centroids("members"),
    """top3 AS (
  SELECT * FROM (SELECT v.cluster_id, v.review_id, row_number() OVER (PARTITION BY v.cluster_id
      ORDER BY list_cosine_similarity(v.emb, c.c) DESC, v.review_id) AS rank
    FROM members v JOIN centroids c ON v.cluster_id = c.cluster_id) WHERE rank <= 3)""",
    f"""quotes AS (
  SELECT t.cluster_id,
         string_agg('- ' || {clip('r.text', 200)}, chr(10) ORDER BY t.rank) AS summary,
         string_agg('> ' || {clip('r.text', 200)} || ' _— review #' || r.review_id || '_'
                    || chr(10) || chr(10), '' ORDER BY t.rank) AS quoted
  FROM top3 t JOIN reviews r ON r.review_id = t.review_id GROUP BY t.cluster_id)""",
    """topics AS (
  SELECT z.cluster_id, z.n AS size, w.topic, s.sentiment, w.ko, w.en, q.summary, q.quoted
  FROM (SELECT cluster_id, count(*) AS n FROM members GROUP BY cluster_id) z
  JOIN (SELECT cluster_id,
               string_agg(term, ' ' ORDER BY rank) FILTER (WHERE rank <= 3) AS topic,
               coalesce(string_agg(term, ' · ' ORDER BY rank)
                        FILTER (WHERE regexp_matches(term, '[가-힣]')), '') AS ko,
               coalesce(string_agg(term, ' · ' ORDER BY rank)
                        FILTER (WHERE NOT regexp_matches(term, '[가-힣]')), '') AS en
        FROM keywords GROUP BY cluster_id) w ON w.cluster_id = z.cluster_id
  JOIN sentiment s ON s.cluster_id = z.cluster_id
  LEFT JOIN quotes q ON q.cluster_id = z.cluster_id)""",
]


def prefixed(ctes: list[str], names: list[str], prefix: str) -> list[str]:
    """The same CTEs under other names, so that two families fit in one statement."""
    import re

    def rename(text: str) -> str:
        for name in names:
            text = re.sub(rf"\b{name}\b", prefix + name, text)
        return text

    return [rename(c) for c in ctes]


ISSUES = [
    """classes AS (
  SELECT CASE WHEN recommended = false THEN cluster_id END AS cluster_id, text FROM members)""",
    *prefixed(class_terms("classes"), ["tokens", "mean_tokens", "weighted"], "i_"),
    f"""counts AS (
  SELECT cluster_id, count(*) AS n FROM members WHERE recommended = false
  GROUP BY cluster_id HAVING count(*) >= {MIN_NEGATIVES})""",
    f"""issue_terms AS (
  SELECT * FROM (SELECT w.cluster_id, w.term, row_number() OVER (
      PARTITION BY w.cluster_id ORDER BY w.weight DESC, w.term) AS k
    FROM i_weighted w JOIN counts c ON c.cluster_id = w.cluster_id)
  WHERE k <= {MAX_ISSUES})""",
    f"""mentions AS (
  SELECT i.cluster_id, i.term, m.review_id, m.emb,
         regexp_matches(lower(m.text), {q(BLOCKER_PATTERN)}) AS blocks
  FROM issue_terms i JOIN members m ON m.cluster_id = i.cluster_id AND m.recommended = false
  WHERE list_contains(regexp_extract_all(lower(m.text), {TERM}), i.term))""",
    "negative_members AS (SELECT * FROM members WHERE recommended = false)",
    centroids("negative_members", "negative_centroids"),
    """issue_quotes AS (
  SELECT cluster_id, term, CAST(review_id AS VARCHAR) AS id, k FROM (
    SELECT m.*, row_number() OVER (PARTITION BY m.cluster_id, m.term
      ORDER BY list_cosine_similarity(m.emb, c.c) DESC, m.review_id) AS k
    FROM mentions m JOIN negative_centroids c ON c.cluster_id = m.cluster_id) WHERE k <= 3)""",
    f"""facts AS (
  SELECT m.cluster_id, m.term, any_value(c.n) AS n, CAST(count(*) AS INTEGER) AS frequency,
         CASE WHEN bool_or(m.blocks) THEN 'critical'
              WHEN count(*) >= {MAJOR_SHARE}::DOUBLE * any_value(c.n) THEN 'major'
              ELSE 'minor' END AS severity
  FROM mentions m JOIN counts c ON c.cluster_id = m.cluster_id GROUP BY m.cluster_id, m.term)""",
    f"""issues AS (
  SELECT f.cluster_id,
         CAST(row_number() OVER (PARTITION BY f.cluster_id ORDER BY f.frequency DESC,
           {case('f.severity', C.SEVERITY_RANK, '9')}, f.term) - 1 AS INTEGER) AS pos,
         f.term AS title, f.term AS title_en,
         f.frequency || ' of ' || f.n || ' negative reviews mention "' || f.term || '".'
           AS description,
         f.severity, f.frequency, coalesce(q.quote_ids, '') AS quote_ids
  FROM facts f LEFT JOIN (SELECT cluster_id, term, string_agg(id, ',' ORDER BY k) AS quote_ids
                     FROM issue_quotes GROUP BY cluster_id, term) q
    ON q.cluster_id = f.cluster_id AND q.term = f.term)""",
]

SECTIONS = f"""sections AS (
  SELECT t.cluster_id, t.size,
    '---' || chr(10) || chr(10) || '### 클러스터 ' || t.cluster_id || ' — ' || t.topic || ' ('
    || t.topic || ')' || chr(10) || '**리뷰 수**: ' || format('{{:,}}', t.size) || ' / **감정**: '
    || {case('t.sentiment', C.SENTIMENT_BADGE, "''")} || chr(10)
    || '**키워드**: ' || t.ko || chr(10) || '**Keywords**: ' || t.en || chr(10) || chr(10)
    || '**요약**' || chr(10) || coalesce(t.summary, '') || chr(10) || chr(10)
    || '**Summary**' || chr(10) || coalesce(t.summary, '') || chr(10) || chr(10)
    || '**대표 인용**' || chr(10) || chr(10) || coalesce(t.quoted, '')
    || coalesce(chr(10) || {q(C.ISSUES_HEADING)} || chr(10) || chr(10) || {q(C.ISSUE_TABLE_HEADER)}
                || l.lines || chr(10), '') || chr(10) AS markdown
  FROM topics t LEFT JOIN (SELECT cluster_id, string_agg(line, chr(10) ORDER BY issue_no) AS lines
                           FROM issue_lines GROUP BY cluster_id) l ON l.cluster_id = t.cluster_id)"""

ISSUE_LINES = """issue_lines AS (
  SELECT cluster_id, CAST(pos + 1 AS INTEGER) AS issue_no,
         '| ' || (pos + 1) || ' | ' || severity || ' | ' || frequency || ' | '
         || replace(title, '|', '/') || ' | ' || replace(title_en, '|', '/') || ' | '
         || array_to_string(string_split(quote_ids, ',')[1:2], ', ') || ' |' AS line
  FROM issues)"""

CALLS = "calls AS (SELECT event_id AS seq, event_type AS step, " + case(
    "user_id % 6", {}, "NULL"
).replace(" ELSE", " " + " ".join(
    f"WHEN {i} THEN {q(m)}" for i, m in enumerate([*C.MODEL_PRICES, "unlisted"])
) + " ELSE") + """ AS model,
  event_id % 1000 AS tokens_in, user_id % 100 AS tokens_out FROM events)"""
PRICES = "prices(model, pi, po) AS (VALUES " + ", ".join(
    f"({q(m)}, {i}::DOUBLE, {o}::DOUBLE)" for m, (i, o) in C.MODEL_PRICES.items()
) + ")"
COSTS = """costs AS (
  SELECT c.*, coalesce((tokens_in * pi + tokens_out * po) / 1000000, 0) AS cost
  FROM calls c LEFT JOIN prices p ON p.model = c.model)"""
LEDGER = [CALLS, PRICES, COSTS]

MOJIBAKE_OF_EXAMPLE = """list_aggregate(list_transform(
    range(0, CAST(least(octet_length(encode(text)), 120) AS BIGINT)),
    lambda i: chr(CAST('0x' || substr(hex(encode(text)), CAST(2 * i + 1 AS BIGINT), 2) AS INTEGER))),
    'string_agg', '')"""

KPIS = [
    *LEDGER,
    "placed AS (SELECT v.* FROM vectors v SEMI JOIN members m ON m.review_id = v.review_id)",
    *silhouette("placed"),
    f"""kpis AS (
  SELECT 'input_count' AS metric, CAST(count(*) AS DOUBLE) AS value FROM reviews UNION ALL
  SELECT 'output_count', count(*) FILTER (WHERE {strip('text')} <> '') FROM reviews UNION ALL
  SELECT 'encoding_repaired', count(*) FILTER (
    WHERE review_id % 33 = 0 AND regexp_matches(text, '[^\\x00-\\x7F]')) FROM reviews UNION ALL
  SELECT 'spam_count', count(*) FILTER (WHERE is_spam) FROM flags UNION ALL
  SELECT 'spam_ratio', avg(CAST(is_spam AS INTEGER)) FROM flags UNION ALL
  SELECT 'k', count(DISTINCT cluster_id) FROM members WHERE cluster_id <> -1 UNION ALL
  SELECT 'sample_silhouette', value FROM silhouette UNION ALL
  SELECT 'negative_count', sum(negative_review_count) FROM ratio UNION ALL
  SELECT 'total_cost_usd', round(sum(cost), 6) FROM costs UNION ALL
  SELECT 'normal_count', (SELECT count(*) FILTER (WHERE {strip('text')} <> '') FROM reviews)
                       - (SELECT count(*) FILTER (WHERE is_spam) FROM flags))""",
]


def _lines(*rows: str) -> str:
    return " || chr(10) || ".join(rows)


def _kpi(metric: str) -> str:
    return f"(SELECT value FROM kpis WHERE metric = '{metric}')"


def _count_row(name: str, metric: str, tail: str = "''") -> str:
    return f"'| {name} | ' || format('{{:,}}', CAST({_kpi(metric)} AS BIGINT)) || '건' || {tail} || ' |'"


KPI_BLOCK = _lines(
    q(C.KPI_HEADING), "''", "'| 지표 | 값 |'", "'|---|---|'",
    "'| 분석 일시 | 2024-01-01 00:00 UTC |'",
    _count_row("입력 리뷰", "input_count"),
    _count_row("정상 리뷰", "normal_count"),
    _count_row("스팸 후보", "spam_count", f"printf(' (%.1f%%)', {_kpi('spam_ratio')} * 100)"),
    _count_row("인코딩 복구", "encoding_repaired"),
    f"'| 클러스터 수 | ' || CAST({_kpi('k')} AS INTEGER) || "
    f"printf(' (silhouette=%.3f)', {_kpi('sample_silhouette')}) || ' |'",
    _count_row("부정 리뷰", "negative_count"),
    f"'| LLM 비용 | ' || printf('$%.4f', {_kpi('total_cost_usd')}) || ' |'",
    "''",
)

_REPAIRABLE = "review_id % 33 = 0 AND regexp_matches(text, '[^\\x00-\\x7F]')"
_FLAG = "CASE WHEN recommended = false THEN '👎비추천' ELSE '👍추천' END"

ORACLE: dict[str, str] = {
    "active_cluster_summary": with_(
        [*BASE, *scores()],
        """SELECT m.cluster_id, count(*) AS size,
  count(*) FILTER (WHERE recommended = false) AS negative_review_count,
  round(count(*) FILTER (WHERE recommended = false) / CAST(count(*) AS DOUBLE), 6) AS negative_ratio
FROM members m JOIN flags f ON f.review_id = m.review_id AND NOT f.is_spam
WHERE trim(m.text) <> '' GROUP BY m.cluster_id""",
    ),
    "clean_text_score": with_(
        [REVIEWS,
         f"""counted AS (
  SELECT review_id, CAST(length(text) AS DOUBLE) AS n,
         len(regexp_extract_all(text, '[가-힣]')) AS hangul,
         len(regexp_extract_all(text, '[A-Za-z]')) AS ascii,
         len(regexp_extract_all(text, {q('[' + C.MOJIBAKE_CHARS + ']')})) AS mojibake,
         len(regexp_extract_all(text, {q('[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_' + chr(92)
             + 's' + chr(92) + 'x0b' + chr(92) + 'x1c-' + chr(92) + 'x1f' + chr(92) + 'x{85}'
             + chr(92) + 'p{Z}' + C.HANGUL_CHARS + C.PLAIN_PUNCTUATION + ']')})) AS noise
  FROM reviews)"""],
        """SELECT review_id, CASE WHEN n = 0 THEN -1.0::DOUBLE
  ELSE round((hangul + ascii) / n - (mojibake * 3 + noise) / n, 6) END AS score FROM counted""",
    ),
    "mojibake_repair": with_(
        [REVIEWS], f"SELECT review_id, text, {_REPAIRABLE} AS was_repaired FROM reviews"
    ),
    "blank_filter": with_(
        [REVIEWS],
        """SELECT review_id, review_id % 40 <> 0 AS kept,
  CASE WHEN review_id % 40 = 0 THEN ' ' ELSE text END AS embed_text FROM reviews""",
    ),
    "repair_examples": with_(
        [REVIEWS],
        f"""SELECT review_id, {MOJIBAKE_OF_EXAMPLE} AS before, substring(text, 1, 120) AS after
FROM reviews WHERE {_REPAIRABLE} ORDER BY review_id LIMIT 5""",
    ),
    "clean_stats": with_(
        [REVIEWS],
        f"""SELECT count(*) AS input_count,
  count(*) FILTER (WHERE review_id % 40 <> 0) AS output_count,
  count(*) FILTER (WHERE review_id % 40 <> 0 AND {_REPAIRABLE}) AS encoding_repaired
FROM reviews""",
    ),
    "lang_distribution": "SELECT lang, count(*) AS review_count FROM documents GROUP BY lang",
    "url_marker": f"""SELECT 'review' AS kind, doc_id AS review_id, {has_url('text')} AS has_url
FROM documents UNION ALL SELECT 'page', page_id, {has_url('url')} FROM pages""",
    "clip_text": f"""SELECT doc_id AS review_id, {clip('text', 400)} AS topic_line,
  {clip('text', 350)} AS issue_line, replace({clip('text', 200)}, '|', '/') AS report_cell,
  {clip('text', 300, False)} AS ticket_line FROM documents""",
    "inject_spam": f"""SELECT review_id, text, {has_url('text')} AS has_url FROM (
  SELECT doc_id AS review_id, CASE WHEN doc_id % 20 = 0
    THEN [{', '.join(map(q, SPAM_PHRASES))}][doc_id % 5 + 1] ELSE text END AS text FROM documents)""",
    "cosine_to_prototypes": with_(
        [REVIEWS, VECTORS, *scores()[:2]],
        """SELECT review_id, round(max(s) FILTER (WHERE pid < 5), 4) AS sim_pos,
  round(max(s) FILTER (WHERE pid >= 5), 4) AS sim_neg,
  'prototype ' || arg_max(pid, s) FILTER (WHERE pid < 5) AS matched_prototype
FROM sims GROUP BY review_id""",
    ),
    "spam_threshold": with_(
        [*BASE, *scores()], "SELECT round(t, 6) AS threshold_pos FROM threshold"
    ),
    "spam_flags": with_([*BASE, *scores()], "SELECT * FROM flags"),
    "spam_stats": with_(
        [*BASE, *scores()],
        f"""SELECT count(*) AS total, count(*) FILTER (WHERE is_spam) AS spam_count,
  round(avg(CAST(is_spam AS INTEGER)), 6) AS spam_ratio,
  (SELECT round(t, 6) FROM threshold) AS threshold_pos,
  {MIN_SIMILARITY_GAP}::DOUBLE AS threshold_diff,
  count(*) FILTER (WHERE has_url) AS url_boost_count FROM flags""",
    ),
    "spam_candidates": with_(
        [*BASE, *scores()],
        """SELECT f.review_id, coalesce(spam_score, 0.0::DOUBLE) AS score, matched_prototype, text
FROM flags f JOIN reviews r ON r.review_id = f.review_id WHERE is_spam""",
    ),
    "spam_override": with_(
        [*BASE, *scores()],
        """SELECT review_id, is_spam AND review_id NOT IN
  (SELECT doc_id FROM labels WHERE quality = 1) AS is_spam, has_url FROM flags""",
    ),
    "active_reviews": with_(
        [*BASE, *scores()],
        """SELECT review_id, lang, recommended, cluster_id FROM members
WHERE review_id NOT IN (SELECT review_id FROM flags WHERE is_spam)""",
    ),
    "spam_recall": with_(
        [REVIEWS, VECTORS,
         """all_reviews AS (
  SELECT review_id, text FROM reviews UNION ALL SELECT item_id + 900001, text FROM benchmark)""",
         """all_vectors AS (
  SELECT review_id, emb FROM vectors UNION ALL
  SELECT item_id + 900001, emb FROM benchmark JOIN vectors ON review_id = item_id)""",
         *scores("all_vectors", "all_reviews")],
        """SELECT count(*) AS injected, count(*) FILTER (WHERE is_spam) AS caught,
  round(avg(CAST(is_spam AS INTEGER)), 6) AS recall FROM flags
WHERE review_id IN (SELECT item_id + 900001 FROM benchmark)""",
    ),
    "cluster_centroids": with_(
        [VECTORS],
        """SELECT cluster_id, count(*) AS size, CAST(pos - 1 AS INTEGER) AS pos,
  round(avg(x), 6) AS value
FROM (SELECT cluster_id, unnest(emb) AS x, generate_subscripts(emb, 1) AS pos FROM vectors)
GROUP BY cluster_id, pos""",
    ),
    "nearest_centroid": with_(
        [VECTORS, centroids("vectors")],
        """SELECT review_id, cluster_id, round(s, 4) AS similarity FROM (
  SELECT v.review_id, c.cluster_id, list_cosine_similarity(v.emb, c.c) AS s,
         row_number() OVER (PARTITION BY v.review_id
           ORDER BY list_cosine_similarity(v.emb, c.c) DESC, c.cluster_id) AS k
  FROM vectors v, centroids c) WHERE k = 1""",
    ),
    "nearest_per_cluster": with_(
        [VECTORS, *selection("vectors", 5, 1)[:3]],
        "SELECT cluster_id, review_id, round(rel, 4) AS score, rank FROM nearest",
    ),
    "mmr_per_cluster": with_([VECTORS, *selection("vectors", 5, 5)], "SELECT * FROM mmr"),
    "representatives": with_([VECTORS, *selection("vectors", 5, 5)], "SELECT * FROM picks"),
    "negative_sample": with_([VECTORS, *negative_picks()], "SELECT * FROM sampled"),
    "tiny_cluster_merge": f"""SELECT vec_id AS review_id,
  CASE WHEN count(*) OVER (PARTITION BY label) < {TINY} THEN -1 ELSE label END AS cluster_id
FROM embeddings""",
    "cluster_sizes": f"""SELECT cluster_id, CAST(sum(n) AS BIGINT) AS size, cluster_id = -1 AS is_other
FROM (SELECT CASE WHEN count(*) < {TINY} THEN -1 ELSE label END AS cluster_id, count(*) AS n
      FROM embeddings GROUP BY label) GROUP BY cluster_id""",
    "silhouette_exact": with_(
        [VECTORS,
         *silhouette("vectors", 2)],
        "SELECT round(value, 6) AS silhouette FROM silhouette",
    ),
    "silhouette_euclidean": with_(
        [VECTORS, *silhouette("vectors")],
        "SELECT round(value, 6) AS silhouette, 0::DOUBLE AS error_bound FROM silhouette",
    ),
    "pca_distance": with_(
        [VECTORS, "whole AS (SELECT 0 AS cluster_id, emb FROM vectors)", centroids("whole")],
        "SELECT review_id, round(list_distance(emb, c), 4) AS distance FROM vectors, centroids",
    ),
    "kmeans_check": """SELECT count(*) AS rows, 6::BIGINT AS clusters, 0::BIGINT AS misplaced
FROM embeddings""",
    "k_check": """SELECT 5::BIGINT AS tried, 1::BIGINT AS chosen, 0::DOUBLE AS behind,
  0::BIGINT AS out_of_range FROM embeddings LIMIT 1""",
    "clustering_check": """SELECT count(*) AS rows, true AS k_in_range, 0::BIGINT AS too_small,
  0::BIGINT AS strangers, 0::BIGINT AS named_twice FROM embeddings""",
    "uniform_sample_ids": f"""SELECT doc_id AS review_id FROM documents
ORDER BY md5('{SEED}:' || doc_id), doc_id LIMIT 100""",
    "paraphrase_agreement": with_(
        [VECTORS, centroids("vectors"),
         """placed AS (
  SELECT v.review_id // 3 AS probe_group,
         arg_max(c.cluster_id, list_cosine_similarity(v.emb, c.c)) AS cid
  FROM vectors v, centroids c GROUP BY v.review_id)"""],
        """SELECT probe_group, count(*) AS probes, count(DISTINCT cid) AS clusters,
  count(DISTINCT cid) = 1 AS agrees FROM placed GROUP BY probe_group""",
    ),
    "embed_text": """SELECT doc_id AS review_id, CAST(i AS INTEGER) AS pos,
  CAST(2 * length(text) - length(replace(text, chr(97 + CAST(i AS INTEGER)), ''))
       - length(replace(text, chr(65 + CAST(i AS INTEGER)), '')) AS DOUBLE) AS value
FROM documents, range(26) r(i)""",
    "offline_embedding": """SELECT doc_id AS review_id, 256::INTEGER AS width,
  CASE WHEN regexp_matches(text, '[\\p{L}\\p{N}]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS length
FROM documents""",
    "embed_usage": """SELECT CAST(sum(length(text)) AS BIGINT) AS tokens_in,
  round(sum(length(text)) * 0.02::DOUBLE / 1000000, 6) AS cost FROM documents""",
    "topic_prompt": with_(
        [*BASE, *selection("vectors", 5, 5)],
        f"""SELECT cluster_id, count(*) AS n_reviews,
  '# 클러스터 ID: ' || cluster_id || chr(10) || '# 리뷰 수: ' || count(*) || '건 중 대표 '
  || least(count(*), 10) || '건' || chr(10) || chr(10) || '## 리뷰 목록' || chr(10)
  || string_agg('- [id=' || r.review_id || ', ' || lang || ', ' || {_FLAG} || '] '
                || {clip('text', 400)}, chr(10) ORDER BY rank)
  || chr(10) || chr(10) || {q(enrichment.TOPIC_INSTRUCTIONS)} AS prompt
FROM picks p JOIN reviews r ON r.review_id = p.review_id GROUP BY cluster_id""",
    ),
    "issue_prompt": with_(
        [*BASE, *negative_picks()],
        f"""SELECT cluster_id, 'topic ' || cluster_id AS topic, count(*) AS n_reviews,
  '# 클러스터: topic ' || cluster_id || ' (id=' || cluster_id || ')' || chr(10) || '# 부정 리뷰 '
  || count(*) || '건 샘플' || chr(10) || chr(10) || '## 부정 리뷰' || chr(10)
  || string_agg('- [id=' || r.review_id || ', ' || lang || '] ' || {clip('text', 350)},
                chr(10) ORDER BY rank)
  || chr(10) || chr(10) || {q(enrichment.ISSUE_INSTRUCTIONS)} AS prompt
FROM sampled p JOIN reviews r ON r.review_id = p.review_id GROUP BY cluster_id""",
    ),
    "response_parse": with_(
        ["""shaped AS (SELECT doc_id AS d, doc_id % 6 AS s, quality FROM labels)""",
         """wanted AS (
  SELECT d, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM (
    SELECT d, CASE s WHEN 0 THEN [d, d + 1] WHEN 4 THEN [999999999]
                     ELSE [d, d + 2, d + 4] END AS ids FROM shaped))""",
         f"""quoted AS (
  SELECT w.d, string_agg(CAST(w.id AS VARCHAR), ',' ORDER BY w.pos) AS quote_ids,
         string_agg({clip('t.text', 200)}, '|' ORDER BY w.pos) AS quotes
  FROM wanted w JOIN documents t ON t.doc_id = w.id GROUP BY w.d)"""],
        """SELECT s.d AS cluster_id, CAST(quality AS BIGINT) AS size,
  CASE s WHEN 0 THEN 't' || s.d WHEN 1 THEN 't' || s.d WHEN 5 THEN '클러스터 ' || s.d
         ELSE '(미정)' END AS topic,
  CASE s WHEN 0 THEN 'e' || s.d WHEN 4 THEN 'only' WHEN 5 THEN 'Cluster ' || s.d
         ELSE '(unknown)' END AS topic_en,
  CASE s WHEN 0 THEN 'positive' WHEN 2 THEN 'negative' ELSE 'mixed' END AS sentiment,
  CASE s WHEN 0 THEN 'a|b' WHEN 5 THEN 'LLM 호출 실패: timeout' ELSE '' END AS summary,
  CASE s WHEN 0 THEN 'c' WHEN 5 THEN 'LLM call failed: timeout' ELSE '' END AS summary_en,
  '' AS keywords_ko, CASE s WHEN 0 THEN 'k1|k2' ELSE '' END AS keywords_en,
  coalesce(quote_ids, '') AS quote_ids, coalesce(quotes, '') AS quotes
FROM shaped s LEFT JOIN quoted q ON q.d = s.d""",
    ),
    "issue_parse": """SELECT doc_id AS cluster_id, CAST(pos AS INTEGER) AS pos,
  title, title_en, description, description_en, severity, CAST(frequency AS INTEGER) AS frequency,
  quote_ids, priority FROM (
  SELECT doc_id, 0 AS pos, 'a' || doc_id AS title, 'b' AS title_en, 'd' AS description,
         'e' AS description_en, 'critical' AS severity, doc_id AS frequency,
         CAST(doc_id AS VARCHAR) AS quote_ids, 'Highest' AS priority
  FROM labels WHERE doc_id % 5 = 0 UNION ALL
  SELECT doc_id, 1, 'second', '(unknown)', '', '', 'minor', 0, '', 'Medium'
  FROM labels WHERE doc_id % 5 = 0 UNION ALL
  SELECT doc_id, 0, '(미정)', '(unknown)', '', '', 'blocker', 7, '', 'Medium'
  FROM labels WHERE doc_id % 5 = 1 UNION ALL
  SELECT doc_id, 0, 'LLM 호출 실패', 'LLM failure', 'timeout', 'timeout', 'minor', 0, '', 'Medium'
  FROM labels WHERE doc_id % 5 = 4)""",
    "quote_resolution": with_(
        ["""wanted AS (SELECT doc_id, unnest([doc_id, doc_id + 1, doc_id + 100000000, doc_id]) AS id,
  unnest([1, 2, 3, 4]) AS pos FROM labels)""",
         """found AS (SELECT w.doc_id, w.id, w.pos, d.text,
  row_number() OVER (PARTITION BY w.doc_id ORDER BY w.pos) AS k
  FROM wanted w JOIN documents d ON d.doc_id = w.id)"""],
        """SELECT doc_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos) AS ids,
  string_agg(text, chr(10) ORDER BY pos) AS texts FROM found WHERE k <= 3 GROUP BY doc_id""",
    ),
    "cluster_sentiment": with_(
        [*ACTIVE_BASE, SENTIMENT],
        """SELECT cluster_id, round(recommended_share, 6) AS recommended_share, sentiment
FROM sentiment""",
    ),
    "cluster_keywords": with_(
        [*ACTIVE_BASE, *class_terms("members"), KEYWORDS],
        "SELECT cluster_id, term, tf, round(weight, 4) AS weight, rank FROM keywords",
    ),
    "negative_issues": with_(
        [*ACTIVE_BASE, *ISSUES],
        """SELECT cluster_id, pos, title, title_en, description, description AS description_en,
  severity, frequency, quote_ids FROM issues""",
    ),
    "negative_ratio": with_(
        [*ACTIVE_BASE, RATIO],
        """SELECT cluster_id, size, negative_review_count, round(negative_ratio, 6) AS negative_ratio
FROM ratio""",
    ),
    "explorer_filter": with_(
        [REVIEWS, VECTORS],
        """SELECT r.review_id, lang, recommended, playtime_hours, cluster_id
FROM reviews r LEFT JOIN vectors v ON v.review_id = r.review_id
WHERE cluster_id IN (1, 2, 3, 4, 5) AND lang IN ('en', 'fr') AND recommended
  AND playtime_hours BETWEEN 5 AND 150 AND contains(lower(text), 'then')""",
    ),
    "explorer_page": with_(
        [REVIEWS, VECTORS],
        """SELECT r.review_id, lang, playtime_hours, coalesce(cluster_id, -1) AS cluster_id, text
FROM reviews r LEFT JOIN vectors v ON v.review_id = r.review_id
ORDER BY r.review_id LIMIT 50 OFFSET 100""",
    ),
    "key_phrases": with_(
        [f"texts AS (SELECT regexp_extract_all(lower(text), {TERM}) AS w FROM documents)",
         """pairs AS (SELECT a AS first, b AS second, count(*) AS n FROM (
  SELECT unnest(w[:-2]) AS a, unnest(w[2:]) AS b FROM texts WHERE len(w) > 1) GROUP BY a, b)""",
         f"stop AS (SELECT unnest([{', '.join(map(q, stop_words()))}]) AS word)",
         """counted AS (
  SELECT first, second, n, CAST(n AS DOUBLE) AS k, CAST(sum(n) OVER (PARTITION BY first) AS DOUBLE) AS r,
         CAST(sum(n) OVER (PARTITION BY second) AS DOUBLE) AS c, CAST(sum(n) OVER () AS DOUBLE) AS t FROM pairs)""",
         """rated AS (
  SELECT first, second, n, 2 * (k * ln(k * t / (r * c))
    + CASE WHEN r > k THEN (r - k) * ln((r - k) * t / (r * (t - c))) ELSE 0 END
    + CASE WHEN c > k THEN (c - k) * ln((c - k) * t / ((t - r) * c)) ELSE 0 END
    + CASE WHEN t - r - c + k > 0 THEN (t - r - c + k) * ln((t - r - c + k) * t / ((t - r) * (t - c))) ELSE 0 END) AS g
  FROM counted WHERE n >= 5 AND k * t > r * c
    AND first NOT IN (SELECT word FROM stop) AND second NOT IN (SELECT word FROM stop))"""],
        "SELECT first, second, n, round(g, 3) AS ratio FROM rated WHERE g >= 10.83",
    ),
    "stored_page": with_(
        [REVIEWS], "SELECT review_id, lang, playtime_hours, text FROM reviews ORDER BY review_id LIMIT 50 OFFSET 100"
    ),
    "text_search": "SELECT doc_id AS review_id, lang FROM documents WHERE contains(lower(text), 'then ')",
    "explorer_facets": with_(
        [REVIEWS, VECTORS],
        """SELECT 'cluster' AS facet, CAST(coalesce(cluster_id, -1) AS VARCHAR) AS value, count(*) AS reviews
FROM reviews r LEFT JOIN vectors v ON v.review_id = r.review_id GROUP BY ALL
UNION ALL SELECT 'lang', lang, count(*) FROM reviews WHERE lang IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'max_playtime', CAST(max(playtime_hours) AS VARCHAR), count(playtime_hours) FROM reviews""",
    ),
    "page_count": """SELECT count(*) AS total,
  CAST(greatest(ceil(count(*) / 50.0), 1) AS BIGINT) AS max_page FROM documents""",
    "topic_ranking": with_(
        [*ACTIVE_BASE, *TOPICS],
        f"""SELECT t.cluster_id, t.size, t.topic, t.topic AS topic_en, t.sentiment,
  {case('t.sentiment', C.SENTIMENT_ICON, q(C.DEFAULT_ICON))} AS icon,
  round(r.negative_review_count / CAST(t.size AS DOUBLE), 6) AS negative_ratio
FROM topics t JOIN ratio r ON r.cluster_id = t.cluster_id
WHERE t.sentiment IN ('positive', 'mixed')""",
    ),
    "issue_ranking": with_(
        [*ACTIVE_BASE, *ISSUES],
        f"""SELECT cluster_id, 'topic ' || cluster_id AS topic, CAST(pos + 1 AS INTEGER) AS issue_no,
  title, severity, CAST({case('severity', C.SEVERITY_RANK, '9')} AS INTEGER) AS severity_rank,
  {case('severity', C.SEVERITY_LABEL, 'severity')} AS severity_label, frequency,
  CASE WHEN quote_ids = '' THEN 0 ELSE CAST(len(string_split(quote_ids, ',')) AS INTEGER) END AS quotes
FROM issues""",
    ),
    "total_issues": with_([*ACTIVE_BASE, *ISSUES], "SELECT count(*) AS total_issues FROM issues"),
    "issue_table": with_([*ACTIVE_BASE, *ISSUES, ISSUE_LINES], "SELECT * FROM issue_lines"),
    "ticket_rows": with_(
        [*ACTIVE_BASE, *ISSUES, RATIO,
         f"""ticket_quotes AS (
  SELECT q.cluster_id, q.term,
         string_agg('- "' || {clip('r.text', 300, False)} || '" (review #' || q.id || ')',
                    chr(10) ORDER BY q.k) AS quoted
  FROM issue_quotes q JOIN reviews r ON CAST(r.review_id AS VARCHAR) = q.id
  GROUP BY q.cluster_id, q.term)"""],
        f"""SELECT i.cluster_id, CAST(i.pos + 1 AS INTEGER) AS issue_no, 'GAME' AS project,
  'Bug' AS issue_type, {q(C.TICKET_SUMMARY_PREFIX)} || i.title AS summary,
  '클러스터: topic ' || i.cluster_id || ' (TOPIC ' || i.cluster_id || ')' || chr(10)
  || '클러스터 부정 리뷰: ' || r.negative_review_count || '건' || chr(10)
  || '이 이슈 추정 빈도: ' || i.frequency || '건' || chr(10) || chr(10) || i.description
  || chr(10) || chr(10) || '--- English ---' || chr(10) || i.description
  || coalesce(chr(10) || chr(10) || '대표 인용:' || chr(10) || q.quoted, '') AS description,
  {case('i.severity', C.SEVERITY_PRIORITY, "'Medium'")} AS priority,
  'cx-review,auto-extracted,cluster-' || i.cluster_id || ',severity-' || i.severity AS labels
FROM issues i JOIN ratio r ON r.cluster_id = i.cluster_id
LEFT JOIN ticket_quotes q ON q.cluster_id = i.cluster_id AND q.term = i.title""",
    ),
    "topic_sections": with_(
        [*ACTIVE_BASE, *TOPICS, *prefixed(ISSUES, ["tf"], "i_"), ISSUE_LINES, SECTIONS],
        "SELECT * FROM sections",
    ),
    "kpi_summary": with_([*ACTIVE_BASE, RATIO, *KPIS], "SELECT metric, round(value, 6) AS value FROM kpis"),
    "report_sections": with_(
        [*ACTIVE_BASE, *TOPICS, *prefixed(ISSUES, ["tf"], "i_"), ISSUE_LINES,
         SECTIONS, *KPIS],
        f"""SELECT CAST(1 AS INTEGER) AS section_no, {q(C.REPORT_TITLE)} || chr(10) AS markdown
UNION ALL SELECT 2, {KPI_BLOCK}
UNION ALL SELECT 3, chr(10) || {q(C.TOPICS_HEADING)} || chr(10)
UNION ALL SELECT CAST(row_number() OVER (ORDER BY size DESC, cluster_id) + 3 AS INTEGER), markdown
FROM sections""",
    ),
    "call_cost": with_(
        LEDGER, "SELECT seq, step, model, tokens_in, tokens_out, round(cost, 9) AS cost FROM costs"
    ),
    "cost_by_step": with_(
        LEDGER,
        """SELECT step, count(*) AS calls, CAST(sum(tokens_in) AS BIGINT) AS tokens_in,
  CAST(sum(tokens_out) AS BIGINT) AS tokens_out, round(sum(cost), 6) AS cost,
  arg_min(model, seq) AS model FROM costs GROUP BY step""",
    ),
    "total_cost": with_(LEDGER, "SELECT round(sum(cost), 6) AS total_cost_usd FROM costs"),
}
