"""What DuckDB makes of the same tables: the SQL that the catalog's queries are held against."""

from __future__ import annotations

import re
import unicodedata

from lorekeep.functions.conversion import CHARACTERS, PHRASES
from lorekeep.plans.catalog import ACCENTED, CLASSED, EXCLUDED, HAN, HAN_QUERIES, HAN_WORDS, INSTANT, KEY, LETTERS, OLD, QUERIES, SIMPLE


def _values(rows) -> str:
    cell = lambda x: "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({', '.join(map(cell, r))})" for r in rows)


_SEG = "replace('<' || regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', '><', 'g') || '>', '<>', '')"


def _lexical(rows) -> str:
    """CTEs: q, c, st, and rt (trigram ranks) and rs (segment ranks). ``rows``: the queries, or SQL for them."""
    asked = rows if isinstance(rows, str) else f"VALUES {_values(rows)}"

    def ranks(name: str, hay: str, phrase: str, dl: str, avg: str) -> str:
        return f"""
{name}_m AS (SELECT qid, k, scope, chunk_id, project, (length({hay}) - length(replace({hay}, {phrase}, ''))) // length({phrase}) AS tf, {dl} AS dl
    FROM q, c WHERE length({phrase}) > 0 AND contains({hay}, {phrase})),
{name}_d AS (SELECT qid, count(*) AS df FROM {name}_m GROUP BY qid),
{name}_s AS (SELECT m.qid, k, chunk_id, round(greatest(0.000001, ln((n - df + 0.5) / (df + 0.5))) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / {avg})), 9) AS score
    FROM {name}_m m JOIN {name}_d d ON d.qid = m.qid, st WHERE scope IS NULL OR scope = project),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM {name}_s) WHERE rank <= greatest(5 * k, 50))"""

    return f"""WITH q0(qid, text, k, scope) AS ({asked}),
q AS (SELECT qid, k, scope::VARCHAR AS scope, CASE WHEN length(trim(text)) >= 3 THEN lower(trim(text)) ELSE '' END AS tp, {_SEG.format("trim(text)")} AS sp FROM q0),
c AS (SELECT doc_id AS chunk_id, 'p' || (doc_id % 5) AS project, lower(text) AS lt, greatest(length(text) - 2, 0) AS tdl, {_SEG.format("text")} AS seg FROM documents),
st AS (SELECT count(*) AS n, avg(tdl) AS ta, avg(length(seg) - length(replace(seg, '<', ''))) AS sa FROM c),
{ranks("rt", "lt", "tp", "tdl", "ta")},
{ranks("rs", "seg", "sp", "length(seg) - length(replace(seg, '<', ''))", "sa")}"""


_VECTOR = """
v AS (SELECT doc_id AS chunk_id, 'p' || (doc_id % 5) AS project, embedding::DOUBLE[] AS e FROM documents JOIN embeddings ON vec_id = doc_id % (SELECT count(*) FROM embeddings)),
rv_s AS (SELECT qid, k, chunk_id, round(list_inner_product(e, x.embedding::DOUBLE[]), 9) AS score FROM q JOIN embeddings x ON x.vec_id = q.qid * 7, v WHERE scope IS NULL OR scope = project),
rv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM rv_s) WHERE rank <= greatest(5 * k, 50))"""


def _fused(*channels: str) -> str:
    names = {"rt": "trigram", "rs": "segment", "rv": "vector"}
    every = " UNION ALL ".join(f"SELECT qid, k, chunk_id, '{names[c]}' AS channel, rank FROM {c}" for c in channels)
    term = "coalesce(max(CASE WHEN channel = '{}' THEN 1.0::DOUBLE / (60 + rank) END), 0.0::DOUBLE)"
    return f""",
r AS ({every}),
f AS (SELECT qid, k, chunk_id, {" + ".join(term.format(x) for x in ("trigram", "segment", "vector"))} AS score, 3 - count(DISTINCT channel) AS band,
    string_agg(channel, ',' ORDER BY channel) AS channels FROM r GROUP BY qid, k, chunk_id),
o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY band, score DESC, chunk_id) - 1 AS pos FROM f)"""


_ROWS = "SELECT qid, pos, chunk_id, round(score, 9) AS score, band, channels FROM o WHERE pos < k"
_TOP = "SELECT qid, chunk_id, rank, score FROM "

_OBSERVED = """WITH t AS (SELECT lang AS project, substring(sha256(lang), 1, 32) AS project_fingerprint, sha256(text) AS uuid, source AS source_key, 's' || (doc_id % 9) AS session_id,
    1700000000 + doc_id * 60 AS ts, text, doc_id AS seq FROM documents),
l AS (SELECT project_fingerprint, uuid, source_key, arg_max(session_id, seq) AS session_id, arg_max(ts, seq) AS ts FROM t GROUP BY ALL),
c AS (SELECT project_fingerprint, uuid, min(project) AS project, max(ts) AS ts, count(DISTINCT source_key) AS source_count FROM t GROUP BY project_fingerprint, uuid),
g AS (SELECT project_fingerprint, uuid, source_count + CASE WHEN uuid[1] = 'a' THEN 1 ELSE 0 END AS source_count FROM c)"""

_USAGE = f"""WITH e0 AS (SELECT CASE event_type WHEN 'view' THEN 'shown' WHEN 'click' THEN 'opened' WHEN 'purchase' THEN 'cited' WHEN 'signup' THEN 'pinned' WHEN 'error' THEN 'dismissed' END AS kind,
    user_id || '-' || (event_id % 7) AS anchor, ts, 'p' || (user_id // 5 * 10 + regexp_extract(props, '([0-9]+)', 1)::INT % 10) AS presentation, event_id AS seq, user_id FROM events),
e AS (SELECT *, pow(1 + greatest(0, (epoch_us(TIMESTAMP '{INSTANT}') - epoch_us(ts)) / 86400e6), -0.5) AS decay,
    CASE kind WHEN 'opened' THEN 1.0::DOUBLE WHEN 'cited' THEN 2.0::DOUBLE WHEN 'pinned' THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END AS w FROM e0 WHERE ts <= TIMESTAMP '{INSTANT}')"""

_PAGE = """p0 AS (SELECT doc_id // 40 AS qid, doc_id AS anchor, (doc_id * 37 % 11) / 8.0::DOUBLE AS base_score, (doc_id * 13 % 3)::INT AS band FROM documents),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY band, base_score DESC, anchor) - 1 AS pos FROM p0)),
runs AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY qid ORDER BY pos) AS run FROM (
    SELECT *, coalesce(band = lag(band) OVER w AND base_score = lag(base_score) OVER w, false) AS same FROM p WINDOW w AS (PARTITION BY qid ORDER BY pos)))"""


def _passes(segment: str, n: int) -> str:
    """The bounded pass, n times: each a walk along each segment that carries the last result and whether it is free."""
    out = f"""WITH RECURSIVE {_PAGE},
i0 AS (SELECT qid, anchor, pos, {segment} AS seg, coalesce(net, 0) AS net, row_number() OVER (PARTITION BY qid, {segment} ORDER BY pos) AS n
    FROM runs LEFT JOIN (SELECT doc_id AS a, (doc_id * 7919 % 17 - 5)::DOUBLE AS net FROM documents WHERE doc_id % 3 <> 0) ON a = anchor)"""
    for k in range(n):
        i, walk, swap = f"i{k}", f"walk{k}", "w.free AND i.net > w.tail_net"
        out += f""",
{walk}(qid, seg, n, tail, tail_net, free, done, done_net, done_pos) AS (
    SELECT qid, seg, n, anchor, net, true, NULL::BIGINT, NULL::DOUBLE, NULL::BIGINT FROM {i} WHERE n = 1
    UNION ALL
    SELECT w.qid, w.seg, i.n, CASE WHEN {swap} THEN w.tail ELSE i.anchor END, CASE WHEN {swap} THEN w.tail_net ELSE i.net END,
        NOT ({swap}), CASE WHEN {swap} THEN i.anchor ELSE w.tail END, CASE WHEN {swap} THEN i.net ELSE w.tail_net END, i.pos - 1
    FROM {walk} w JOIN {i} i ON i.qid = w.qid AND i.seg = w.seg AND i.n = w.n + 1),
i{k + 1} AS (SELECT *, row_number() OVER (PARTITION BY qid, seg ORDER BY pos) AS n FROM (
    SELECT qid, done AS anchor, done_pos AS pos, seg, done_net AS net FROM {walk} WHERE done IS NOT NULL
    UNION ALL SELECT w.qid, w.tail, e.pos, w.seg, w.tail_net FROM {walk} w JOIN (SELECT qid, seg, max(n) AS n, max(pos) AS pos FROM {i} GROUP BY qid, seg) e ON e.qid = w.qid AND e.seg = w.seg AND e.n = w.n))"""
    return out + f", placed AS (SELECT qid, anchor, pos AS new_pos FROM i{n})"


_MOVES = """ SELECT p.qid, p.anchor, p.pos, new_pos, p.pos - new_pos AS displacement,
CASE WHEN p.pos > new_pos THEN 'advanced ' || (p.pos - new_pos) WHEN p.pos < new_pos THEN 'receded ' || (new_pos - p.pos) ELSE 'unmoved' END AS movement
FROM p JOIN placed USING (qid, anchor)"""


def _report(generations: int) -> str:
    return (
        _USAGE
        + f""", s AS (SELECT *, presentation[2:]::INT AS pk, 'g' || (presentation[2:]::INT % {generations}) AS generation, CASE WHEN seq % 17 <> 0 THEN presentation END AS shown_in FROM e0),
pr AS (SELECT presentation AS id, pk, CASE pk % 3 WHEN 0 THEN 'latin-alnum' WHEN 1 THEN 'mixed' ELSE 'cjk-2char' END AS query_class, generation AS p_generation, pk % 10 = 9 AS is_null,
    list_sort(list(DISTINCT anchor)) AS members FROM s WHERE kind = 'shown' GROUP BY ALL),
d AS (SELECT s.*, pr.query_class, pr.id, pr.is_null, CASE WHEN length(anchor) % 2 = 0 THEN 'archival' ELSE 'human-like' END AS strategy,
    CASE WHEN shown_in IS NULL THEN 'skip: no presentation' WHEN pr.id IS NULL THEN 'skip: unknown presentation' WHEN pr.is_null THEN 'skip: null comparison'
         WHEN generation <> p_generation THEN 'reject: generation' WHEN NOT list_contains(members, anchor) THEN 'reject: not shown' ELSE 'score' END AS disposition
    FROM s LEFT JOIN pr ON pr.id = s.shown_in)"""
    )


def _levels(generations: int) -> str:
    return (
        _report(generations)
        + """, z AS (SELECT strategy, query_class, generation, kind FROM d WHERE disposition = 'score'
    UNION ALL SELECT DISTINCT unnest(['archival', 'human-like']), query_class, p_generation, NULL FROM pr WHERE NOT is_null),
x AS (SELECT strategy, query_class, generation, grouping(query_class) AS no_class, grouping(generation) AS no_generation, count(*) FILTER (kind = 'shown') AS presented,
    count(*) FILTER (kind IN ('opened', 'cited', 'pinned')) AS credits, count(*) FILTER (kind = 'dismissed') AS penalties FROM z
    GROUP BY GROUPING SETS ((strategy, query_class), (strategy, generation), (strategy, query_class, generation), (strategy))),
y AS (SELECT *, CASE WHEN no_class = 1 AND no_generation = 1 THEN 'total' WHEN no_class = 1 THEN 'generation' WHEN no_generation = 1 THEN 'class' ELSE 'generation_class' END AS level FROM x)
SELECT level, strategy, query_class, generation, presented, credits, penalties, credits - penalties AS net, round(CASE WHEN presented > 0 THEN (credits - penalties) / presented END, 9) AS rate
FROM y WHERE level LIKE 'generation%' OR (SELECT count(DISTINCT generation) FROM d WHERE disposition = 'score') <= 1"""
    )


def _pad(byte: int) -> str:
    """The key, filled up to a block and mixed with a pad byte, as a blob: the keyed hash's inner or outer prefix."""
    return "unhex('" + bytes(b ^ byte for b in KEY.ljust(64, b"\0")).hex() + "')"


def _known_items() -> str:
    """Twenty seeded items of the corpus, each with a word of its own as query, and their reports by ranking."""
    rankings = {"lexical": ("rt", "rs"), "vector": ("rv",), "fused": ("rt", "rs", "rv")}
    queries = """SELECT qid, text, 20, NULL FROM (SELECT chunk_id, text, row_number() OVER (ORDER BY chunk_id) AS qid FROM (
    SELECT chunk_id, text FROM (SELECT doc_id AS chunk_id, words[1 + ('0x' || substr(sha256('42word:' || text), 1, 8))::BIGINT % greatest(len(words), 1)] AS text
        FROM (SELECT doc_id, text, list_filter(regexp_extract_all(text, '[A-Za-z0-9]{4,}'), lambda w: w <> trim(text)) AS words FROM documents))
    WHERE text IS NOT NULL ORDER BY sha256('42:' || chunk_id), chunk_id LIMIT 20))"""
    return (
        _lexical(queries)
        + ", items AS ("
        + queries.replace("SELECT qid, text, 20, NULL", "SELECT qid, chunk_id", 1)
        + ")"
        + ", "
        + _VECTOR
        + "".join(re.sub(r"\b([rfo]) AS \(", rf"\1_{name} AS (", re.sub(r"FROM ([rf])\b", rf"FROM \1_{name}", _fused(*channels))) for name, channels in rankings.items())
        + f""", h AS ({" UNION ALL ".join(f"SELECT qid, '{name}' AS channel, chunk_id, pos + 1 AS rank FROM o_{name} WHERE pos < 20" for name in rankings)}),
deep AS (SELECT qid, channel, count(*) >= least(20, (SELECT count(*) FROM documents)) AS full_list FROM h GROUP BY qid, channel),
x AS (SELECT i.qid, c.channel, coalesce(full_list, false) OR h.rank IS NOT NULL AS counts, h.rank FROM items i CROSS JOIN (VALUES ('lexical'), ('vector'), ('fused')) c(channel)
    LEFT JOIN deep ON deep.qid = i.qid AND deep.channel = c.channel LEFT JOIN h ON h.qid = i.qid AND h.channel = c.channel AND h.chunk_id = i.chunk_id)
SELECT 'latin-alnum' AS query_class, channel, count(*) FILTER (counts) AS scored, count(rank) AS recalled, round(count(rank) / nullif(count(*) FILTER (counts), 0), 9) AS recall_rate,
    round(avg(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) WHEN rank IS NOT NULL THEN 0 END), 9) AS mean_ndcg FROM x GROUP BY channel"""
    )


_HAN = "[\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{20000}-\\x{2A6DF}]"
_ENLARGED = [(q, t, min(4 * k, 1000), p) for q, t, k, p in QUERIES]
_GONE = ", ".join(f"'{s}'" for s in EXCLUDED)

def _replaced(text: str, pairs: list[tuple[str, str]]) -> str:
    for old, new in pairs:
        text = f"replace({text}, '{old}', '{new}')"
    return text


#: CTEs up to words (doc_id, words): documents in Han characters, cut by the cheapest path over each distinct run. A step
#: appends the best cut of the next longer prefix: cost, number of words, length of the last word, and the words.
_CUT = f"""WITH RECURSIVE d AS (SELECT doc_id, doc_id % 5 AS p, lower(translate(regexp_replace(text, '([a-z]+) ([a-z]+)', '\\1\\2', 'g'), '{LETTERS}', '{HAN}')) AS t FROM documents),
f AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[a-z]+')) AS w FROM documents) WHERE length(w) BETWEEN 2 AND 4 GROUP BY w ORDER BY n DESC, w LIMIT {HAN_WORDS}),
lex AS MATERIALIZED (SELECT map(list(translate(w, '{LETTERS}', '{HAN}')), list(round(1000 * ln(total / n))::BIGINT)) AS m, any_value(round(1000 * ln(total))::BIGINT + 2000) AS unknown FROM f, (SELECT sum(n) AS total FROM f)),
tok AS MATERIALIZED (SELECT doc_id, i, t FROM (SELECT doc_id, generate_subscripts(ts, 1) AS i, unnest(ts) AS t FROM (SELECT doc_id, list_filter(string_split_regex(regexp_replace(t, '([{HAN}]+)', ' \\1 ', 'g'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ts FROM d))),
runs AS (SELECT DISTINCT t AS run FROM tok WHERE contains('{HAN}', t[1])),
step AS (SELECT run, 0 AS i, [{{'c': 0::BIGINT, 'n': 0::BIGINT, 'l': 0::BIGINT, 'w': ''}}] AS b FROM runs UNION ALL
    SELECT run, i + 1, list_append(b, list_min(list_filter(list_transform(range(1, least(4, i + 1) + 1), lambda l: {{
        'c': b[i + 2 - l].c + coalesce(map_extract(m, run[i + 2 - l:i + 1])[1], CASE WHEN l = 1 THEN unknown END), 'n': b[i + 2 - l].n + 1, 'l': l,
        'w': CASE WHEN i + 1 = l THEN '' ELSE b[i + 2 - l].w || '|' END || run[i + 2 - l:i + 1]}}), lambda x: x.c IS NOT NULL))) FROM step, lex WHERE i < length(run)),
cut AS (SELECT run, b[i + 1].w AS w FROM step WHERE i = length(run)),
words AS MATERIALIZED (SELECT d.doc_id, any_value(d.p) AS p, coalesce(string_agg(coalesce(cut.w, tok.t), '|' ORDER BY tok.i), '') AS w FROM d LEFT JOIN tok ON tok.doc_id = d.doc_id LEFT JOIN cut ON cut.run = tok.t GROUP BY d.doc_id)"""


def _converted(text: str, pairs: list[tuple[str, str]]) -> str:
    """Longest match: an alternation whose longer entries come first, each match looked up, all else as it is."""
    first: dict[str, str] = {}
    for source, target in pairs:
        first.setdefault(source, target)
    entries = sorted(first, key=lambda e: -len(e))
    table = "map([" + ", ".join(f"'{e}'" for e in entries) + "], [" + ", ".join(f"'{first[e]}'" for e in entries) + "])"
    return f"array_to_string(list_transform(regexp_extract_all({text}, '(?s)' || '{'|'.join(entries)}|[\\x00-\\x{{2E7F}}]+|.'), lambda x: coalesce(map_extract({table}, x)[1], x)), '')"


def _pairs(swap: bool) -> list[tuple[str, str]]:
    own = (PHRASES + " " + CHARACTERS).split()
    return [(t, s) if swap else (s, t) for s, t in zip(own[::2], own[1::2], strict=True)]


ORACLES = {
    "cjk_words": _CUT + " SELECT doc_id, CASE WHEN w = '' THEN 0 ELSE len(string_split(w, '|')) END AS n_words, sha256(w) AS words_sha256 FROM words",
    "cjk_topk": _CUT + f""", c AS (SELECT doc_id AS chunk_id, CASE WHEN w = '' THEN [] ELSE string_split(w, '|') END AS ws FROM words),
st AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM c),
q AS (SELECT qid, translate(t, '{LETTERS}', '{HAN}') AS t FROM (VALUES {_values(list(enumerate(HAN_QUERIES)))}) AS v(qid, t)),
m AS (SELECT qid, chunk_id, len(list_filter(ws, lambda x: x = q.t)) AS tf, len(ws) AS dl FROM q, c WHERE list_contains(ws, q.t)),
s AS (SELECT qid, chunk_id, round(greatest(0.000001, ln((n - df + 0.5) / (df + 0.5))) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)), 9) AS score FROM m JOIN (SELECT qid, count(*) AS df FROM m GROUP BY qid) f USING (qid), st)
SELECT * FROM (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank, score FROM s) WHERE rank <= 50""",
    "script_variants": f"""WITH d AS (SELECT doc_id AS qid, CASE WHEN doc_id % 2 = 0 THEN {_replaced("text", SIMPLE)} ELSE {_replaced("text", OLD)} END AS t FROM documents WHERE text IS NOT NULL),
v AS (SELECT qid, list_filter([t, {_converted("t", _pairs(False))}, {_converted("t", _pairs(True))}], lambda x: x <> '') AS f FROM d),
o AS (SELECT qid, list_filter(f, lambda x, i: list_position(f, x) = i) AS f FROM v)
SELECT qid, (unnest(range(0, len(f))))::INT AS variant, sha256(unnest(f)) AS text_sha256 FROM o""",
    "normal_forms": f"""WITH d AS (SELECT doc_id, {_replaced("text", [(c, unicodedata.normalize("NFD", c)) for c in ACCENTED])} AS t FROM documents)
SELECT doc_id, sha256(t) AS apart_sha256, sha256(trim(regexp_replace(nfc_normalize(coalesce(t, '')), '\\s+', ' ', 'g'))) AS normal_sha256 FROM d""",
    "fused_topk": _lexical(QUERIES) + _fused("rt", "rs") + _ROWS,
    "fused_topk_3ch": _lexical(QUERIES) + "," + _VECTOR + _fused("rt", "rs", "rv") + _ROWS,
    "channel_subset": _lexical(QUERIES) + "," + _VECTOR + _fused("rs", "rv") + _ROWS,
    "trigram_topk": _lexical(QUERIES) + _TOP + "rt",
    "segment_topk": _lexical(QUERIES) + _TOP + "rs",
    "vector_topk": _lexical(QUERIES) + "," + _VECTOR + "SELECT qid, chunk_id, rank, round(score, 6) AS score FROM rv",
    "bm25_stats": _lexical(QUERIES) + "SELECT n, round(ta, 6) AS trigram_avgdl, round(sa, 6) AS segment_avgdl FROM st",
    "scope_filter_global_idf": _lexical([(1, "tion", 8, "p2"), (2, "tion", 8, None)]) + _TOP + "rt",
    "variant_union_rank": _lexical([(1, "thing", 4, None), (2, "tion", 4, None)])
    + """, u AS (SELECT chunk_id, min(qid * 100000 + rank) AS place FROM rt GROUP BY chunk_id),
w AS (SELECT 1 AS qid, chunk_id, row_number() OVER (ORDER BY place) AS rank FROM u) SELECT * FROM w WHERE rank <= 50""",
    "exclude_sessions": _lexical(_ENLARGED)
    + _fused("rt", "rs")
    + f""", own AS (SELECT doc_id, list(DISTINCT source) OVER (PARTITION BY text) AS sessions FROM documents),
h AS (SELECT o.*, row_number() OVER (PARTITION BY qid ORDER BY pos) - 1 AS new_pos FROM o JOIN own ON doc_id = chunk_id WHERE pos < k AND len(list_filter(sessions, lambda s: s NOT IN ({_GONE}))) > 0)
SELECT qid, new_pos AS pos, chunk_id, round(score, 9) AS score, band FROM h WHERE new_pos < 10""",
    "query_class": f"""WITH q(n, query) AS (SELECT * FROM (VALUES {_values(list(enumerate(CLASSED)))}) UNION ALL SELECT (item_id + 100)::INT, text FROM benchmark),
c AS (SELECT n, length(query) - length(regexp_replace(query, '{_HAN}', '', 'g')) AS han, length(query) - length(regexp_replace(query, '[A-Za-z0-9]', '', 'g')) AS al FROM q)
SELECT n, CASE WHEN han > 0 AND al > 0 THEN 'mixed' WHEN han = 0 THEN 'latin-alnum' WHEN han <= 2 THEN 'cjk-2char' WHEN han = 3 THEN 'cjk-3char' ELSE 'cjk-4plus' END AS query_class FROM c""",
    "ident_shape": """SELECT conv_id, turn, regexp_matches(conv_id || '-' || turn, '^[A-Za-z0-9._-]{1,64}$') AS id_ok, regexp_matches(text, '^[A-Za-z0-9._-]{1,64}$') AS text_ok FROM conversations""",
    "fingerprint": "SELECT DISTINCT source, substring(sha256(source), 1, 32) AS fingerprint, true AS ok FROM documents",
    "clip_flatten": "SELECT conv_id, turn, CASE WHEN length(text) > 160 THEN substring(replace(text, chr(10), ' '), 1, 160) || '…' ELSE replace(text, chr(10), ' ') END AS snippet FROM conversations",
    "normalise_ws": "SELECT doc_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS plain_sha256 FROM documents",
    "span_slice_orphans": """WITH a AS (SELECT doc_id, text, doc_id * 31 % 40 AS lo, doc_id * 31 % 40 + doc_id % 60 AS hi FROM documents),
s AS (SELECT *, CASE WHEN hi > lo AND hi <= length(text) THEN substring(text, lo + 1, hi - lo) END AS span FROM a),
r AS (SELECT *, CASE WHEN doc_id % 10 = 0 THEN 'turnMissing' WHEN span IS NULL THEN 'spanOutOfBounds' WHEN trim(regexp_replace(span, '\\s+', ' ', 'g')) = '' THEN 'contentNormalizesToNothing'
    WHEN doc_id % 4 = 0 THEN 'contentHashMismatch' END AS orphan_reason FROM s)
SELECT orphan_reason, count(*) AS n, sum(CASE WHEN orphan_reason IS NULL THEN length(span) END) AS chars FROM r GROUP BY orphan_reason""",
    "dedup_sources": _OBSERVED + " SELECT project_fingerprint, uuid, project, source_count, uuid AS text_sha256 FROM c",
    "sessions_per_chunk": _OBSERVED + " SELECT project_fingerprint, uuid, string_agg(session_id, ',' ORDER BY source_key) AS sessions FROM l GROUP BY project_fingerprint, uuid",
    "latest_per_chunk": _OBSERVED + " SELECT project_fingerprint, uuid, ts AS latest FROM c",
    "source_counts": _OBSERVED + " SELECT source_key, count(*) AS chunk_count FROM l GROUP BY source_key",
    "audit_divergent": _OBSERVED
    + """, r AS (SELECT project_fingerprint, uuid, count(DISTINCT source_key) AS real FROM l GROUP BY ALL)
SELECT uuid[1:2] AS prefix, count(*) AS n, sum(source_count)::BIGINT AS stored, sum(real)::BIGINT AS real FROM g JOIN r USING (project_fingerprint, uuid) WHERE source_count <> real GROUP BY prefix""",
    "audit_dangling": _OBSERVED + " SELECT source_key, count(*) AS n FROM l WHERE uuid[1] = 'b' GROUP BY source_key",
    "audit_orphan": _OBSERVED + " SELECT uuid FROM c WHERE uuid[1] = 'c'",
    "uncovered_sources": _OBSERVED + " SELECT DISTINCT source_key FROM l WHERE source_key LIKE '%7'",
    "audit_figures": _OBSERVED
    + """, ll AS (SELECT * FROM l WHERE uuid[1] <> 'c'), kept AS (SELECT * FROM g WHERE uuid[1] <> 'b'),
r AS (SELECT project_fingerprint, uuid, count(DISTINCT source_key) AS real FROM ll GROUP BY ALL),
a AS (SELECT source_key, count(*) + CASE WHEN source_key LIKE '%3' THEN 1 ELSE 0 END AS stored FROM l GROUP BY source_key),
b AS (SELECT source_key, count(*) AS real FROM ll GROUP BY source_key)
SELECT 'divergent_chunks' AS figure, (SELECT count(*) FROM kept LEFT JOIN r USING (project_fingerprint, uuid) WHERE source_count <> coalesce(real, 0)) AS n
UNION ALL SELECT 'divergent_sources', (SELECT count(*) FROM a FULL JOIN b USING (source_key) WHERE stored IS DISTINCT FROM real)
UNION ALL SELECT 'dangling_links', (SELECT count(*) FROM ll WHERE uuid[1] = 'b')
UNION ALL SELECT 'orphan_chunks', (SELECT count(*) FROM kept WHERE uuid[1] = 'c')
UNION ALL SELECT 'uncovered_sources', (SELECT count(DISTINCT source_key) FROM ll WHERE source_key LIKE '%7')""",
    "manifest_diff": """WITH o AS (SELECT DISTINCT o_orderkey % 997 AS k FROM orders),
s AS (SELECT k, CASE WHEN k % 50 = 1 THEN -1 ELSE k * 10 END AS done FROM o WHERE k % 5 <> 0),
f AS (SELECT k, k * 10 + CASE WHEN k % 3 = 0 THEN 5 ELSE 0 END - CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END AS size, k % 11 = 0 AS changed FROM o WHERE k % 7 <> 0)
SELECT 'p' || (k % 4) || '/f' || k AS source_key, CASE WHEN size IS NULL THEN CASE WHEN k % 4 = 2 THEN 'kept' ELSE 'vanished' END WHEN done IS NULL THEN 'new'
    WHEN done < 0 OR size < done OR changed THEN 'rewritten' WHEN size > done THEN 'appended' ELSE 'same' END AS action
FROM f FULL JOIN s USING (k)""",
    "duplication_stats": _OBSERVED
    + """, u AS (SELECT uuid, count(DISTINCT source_key) AS f, count(DISTINCT text) AS x, count(DISTINCT session_id) AS s FROM t GROUP BY uuid)
SELECT count(*) AS uuids, count(*) FILTER (f > 1) AS in_several, count(*) FILTER (f > 1 AND x = 1) AS same_content, count(*) FILTER (f > 1 AND s > 1) AS other_sessions FROM u""",
    "script_cooccurrence": f"""WITH b AS (SELECT regexp_matches(text, '{_HAN}') AS h, regexp_matches(text, '[A-Za-z]{{2,}}') AS l FROM documents)
SELECT count(*) AS texts, count(*) FILTER (h) AS han, count(*) FILTER (l) AS latin, count(*) FILTER (h AND l) AS both FROM b""",
    "upsert_last_writer": """WITH o AS (SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders GROUP BY 1), n AS (SELECT c_custkey + c_custkey % 2 AS k, -max(c_custkey) AS v FROM customer GROUP BY 1)
SELECT k, coalesce(n.v, o.v) AS v FROM o FULL JOIN n USING (k)""",
    "remove_sources": _OBSERVED + f" SELECT project_fingerprint, uuid, count(DISTINCT source_key) AS source_count, max(ts) AS latest FROM l WHERE source_key NOT IN ({_GONE}) GROUP BY project_fingerprint, uuid",
    "strength_projection": _USAGE
    + """, s AS (SELECT anchor, sum(w * decay) AS r, sum(CASE WHEN kind = 'dismissed' THEN 2 * decay ELSE 0 END) AS u FROM e GROUP BY anchor)
SELECT anchor, round(r, 9) AS reinforcement, round(u, 9) AS suppression, round(r - u, 9) AS net FROM s""",
    "impressions_counts": _USAGE
    + """ SELECT anchor, count(*) FILTER (kind = 'shown') AS impressions, count(*) FILTER (kind = 'opened') AS opened, count(*) FILTER (kind = 'cited') AS cited, count(*) FILTER (kind = 'pinned') AS pinned,
count(*) FILTER (kind = 'dismissed') AS dismissed, strftime(max(ts) FILTER (kind <> 'shown'), '%Y-%m-%d %H:%M:%S') AS last_deliberate FROM e GROUP BY anchor""",
    "future_events": f"SELECT count(*) AS future_events FROM events WHERE ts > TIMESTAMP '{INSTANT}'",
    "spreading_projection": _USAGE
    + """, x AS (SELECT * FROM e),
m AS (SELECT presentation, anchor, sum(w * decay) AS own FROM x GROUP BY ALL), gr AS (SELECT presentation, sum(own) AS total, count(*) AS n FROM m GROUP BY presentation),
sp AS (SELECT anchor, 0.3 * sum(total - own) AS gain FROM m JOIN gr USING (presentation) WHERE n BETWEEN 2 AND 2000 AND anchor NOT IN (SELECT anchor FROM x WHERE kind = 'dismissed') GROUP BY anchor),
s AS (SELECT anchor, sum(w * decay) AS r, sum(CASE WHEN kind = 'dismissed' THEN 2 * decay ELSE 0 END) AS u, count(*) FILTER (kind = 'shown') AS impressions FROM x GROUP BY anchor)
SELECT anchor, round(r + coalesce(gain, 0), 6) AS reinforcement, round(u, 6) AS suppression, impressions FROM s LEFT JOIN sp USING (anchor) WHERE r + coalesce(gain, 0) > 0 OR u > 0 OR impressions > 0""",
    "human_like_rerank": _passes("band", 1) + _MOVES,
    "conservative_rerank": _passes("run", 1) + _MOVES,
    "human_like_bound3": _passes("band", 3) + _MOVES,
    "archival_rerank": f"WITH {_PAGE} SELECT qid, anchor, pos AS new_pos, 'unmoved' AS movement FROM p",
    "one_pass_fold": _passes("run", 1) + " SELECT qid, anchor, new_pos FROM placed",
    "guard_violations": f"""WITH {_PAGE}, n AS (SELECT *, count(*) OVER (PARTITION BY qid) AS n FROM runs),
a AS (SELECT *, CASE WHEN qid % 5 = 0 THEN n - 1 - pos ELSE pos END AS dest FROM n),
j AS (SELECT a.*, b.band AS place_band, b.run AS place_run FROM a JOIN n b ON b.qid = a.qid AND b.pos = a.dest),
v AS (SELECT qid, unnest([CASE WHEN band <> place_band THEN 'band_per_place' END, CASE WHEN abs(pos - dest) > 3 THEN 'bound' END, CASE WHEN pos <> dest THEN 'honest_movement' END, CASE WHEN run <> place_run THEN 'ties_only' END, CASE WHEN anchor % 9 = 0 AND (anchor % 3 = 0 OR anchor * 7919 % 17 - 5 <> 1) THEN 'honest_history' END]) AS rule FROM j)
SELECT qid, rule, count(*) AS n FROM v WHERE rule IS NOT NULL GROUP BY qid, rule""",
    "displacement": f"WITH {_PAGE} SELECT qid, anchor, pos - (row_number() OVER (PARTITION BY qid ORDER BY anchor) - 1) AS displacement FROM p",
    "tie_runs": f"WITH {_PAGE} SELECT qid, anchor, run::BIGINT AS run FROM runs",
    "tie_stats": f"""WITH {_PAGE}, s AS (SELECT *, coalesce(base_score = lag(base_score) OVER (PARTITION BY qid ORDER BY pos), false) AS same_score FROM runs),
g AS (SELECT qid, run, count(*) AS size, count(*) FILTER (same) AS tied, count(*) FILTER (same_score) AS tied_score FROM s GROUP BY qid, run)
SELECT qid, sum(size)::BIGINT AS n, sum(tied)::BIGINT AS tied_pairs, sum(tied_score)::BIGINT AS tied_score_pairs, count(*) FILTER (size > 1) AS runs, coalesce(sum(size) FILTER (size > 1), 0)::BIGINT AS covered, max(size) AS longest FROM g GROUP BY qid""",
    "tie_run_lengths": f"""WITH {_PAGE} SELECT length, count(*) AS runs FROM (SELECT count(*) AS length FROM runs GROUP BY qid, run) WHERE length > 1 GROUP BY length""",
    "record_faults": _report(2)
    + """, x0 AS (SELECT id, pk, CASE WHEN pk % 7 = 0 THEN 'archival' WHEN pk % 7 = 1 THEN 'conservative' ELSE 'human-like' END AS b, pk % 5 = 4 AS is_null FROM pr),
x AS (SELECT *, count(*) OVER (PARTITION BY id) AS times, first_value(b) OVER (ORDER BY id) AS first_b FROM (SELECT * FROM x0 UNION ALL SELECT * FROM x0 WHERE pk % 11 = 0)),
y AS (SELECT id, unnest([CASE WHEN b = 'archival' THEN 'one strategy' END, CASE WHEN is_null THEN 'credit in a null comparison' END, CASE WHEN times > 1 THEN 'duplicate id' END, CASE WHEN b <> first_b THEN 'differing pairs' END]) AS fault FROM x)
SELECT id, fault FROM y WHERE fault IS NOT NULL""",
    "salvage_presentations": _report(2)
    + " SELECT CASE WHEN pk % 10 IN (0, 1) THEN 'corrupt' WHEN len(list_filter(members, lambda a: ends_with(a, '-3'))) > 0 THEN 'superseded' ELSE 'ok' END AS status, count(*) AS n FROM pr GROUP BY 1",
    "unattributable_hits": "SELECT doc_id // 40 AS qid, count(*) FILTER (doc_id % 9 <> 0) AS attributed, count(*) FILTER (doc_id % 9 = 0) AS unattributable FROM documents GROUP BY 1",
    "script_runs": """WITH r AS (SELECT doc_id, regexp_extract_all(translate(text, 'xz', '選釘'), '[選釘]+|[^選釘]+') AS runs FROM documents)
SELECT doc_id, len(runs)::INT AS n_runs, len(list_filter(runs, lambda r: r[1] IN ('選', '釘')))::INT AS n_cjk, sha256(array_to_string(list_transform(runs, lambda r: CASE WHEN r[1] IN ('選', '釘') THEN 'c' ELSE 'o' END || r), '|')) AS runs_sha256 FROM r""",
    "signal_maps": _USAGE
    + """, k AS (SELECT anchor, kind, count(*) AS n FROM e0 GROUP BY ALL)
SELECT anchor, '{' || coalesce(string_agg('"' || kind || '":' || n, ',' ORDER BY kind) FILTER (kind <> 'shown'), '') || '}' AS deliberate, coalesce(bool_or(kind = 'pinned'), false) AS pinned FROM k GROUP BY anchor""",
    "source_union": "SELECT source AS source_key FROM documents WHERE lang = 'en' UNION SELECT source FROM documents WHERE lang = 'fr'",
    "interleave_ab": f"""WITH RECURSIVE {_PAGE}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY anchor) - 1 AS pos_b FROM p),
g AS (SELECT qid, list(anchor ORDER BY pos) AS a, list(anchor ORDER BY pos_b) AS b FROM r GROUP BY qid),
w(qid, a, b, taken, turn, pick, by_a) AS (
    SELECT qid, a, b, []::BIGINT[], 0, NULL::BIGINT, NULL::BOOLEAN FROM g
    UNION ALL
    SELECT qid, a, b, list_append(taken, x), turn + 1, x, from_a FROM (
        SELECT *, (turn % 2 = 0) = (qid % 2 = 0) AS from_a, list_filter(CASE WHEN (turn % 2 = 0) = (qid % 2 = 0) THEN a ELSE b END, lambda y: NOT list_contains(taken, y))[1] AS x FROM w WHERE turn < len(a)))
SELECT qid, (turn - 1)::INT AS place, pick AS anchor, CASE WHEN a <> b THEN CASE WHEN by_a THEN 'a' ELSE 'b' END END AS credited_to FROM w WHERE turn > 0""",
    "comparison_report": _levels(1),
    "generation_rows": _levels(2),
    "dispositions": _report(2) + " SELECT disposition, count(*) AS n FROM d GROUP BY disposition",
    "corrected_preference": """WITH o AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'a' ELSE 'b' END AS s, (value > 50)::INT AS w FROM events)
SELECT round(avg(w), 9) AS pooled, round((avg(w) FILTER (s = 'a') + avg(w) FILTER (s = 'b')) / 2, 9) AS corrected, count(*) FILTER (s = 'a') AS a_first, count(*) FILTER (s = 'b') AS b_first,
least(count(*) FILTER (s = 'a'), count(*) FILTER (s = 'b')) * 4 < count(*) AS severe FROM o""",
    "ndcg_by_class": """WITH h AS (SELECT doc_id, lang AS query_class, unnest(['lexical', 'vector', 'fused']) AS channel FROM documents),
r AS (SELECT *, 1 + (doc_id * 17 + length(channel) * 5) % 31 AS rank FROM h)
SELECT query_class, channel, count(*) AS scored, count(*) FILTER (rank <= 20) AS recalled, round(count(*) FILTER (rank <= 20) / count(*), 9) AS recall_rate,
round(avg(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) FILTER (rank <= 20), 9) AS mean_ndcg FROM r GROUP BY query_class, channel""",
    "latency_p95": "SELECT event_type, count(*) AS samples, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type",
    "event_range": _USAGE + " SELECT seq, kind, anchor FROM e0 WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12'",
    "salvage_lines": _USAGE + """, n AS (SELECT *, (user_id // 100)::VARCHAR AS file, row_number() OVER (PARTITION BY user_id // 100 ORDER BY seq) AS line_no FROM e0)
SELECT file, line_no, CASE WHEN seq % 10 IN (0, 1) THEN 'corrupt' ELSE 'superseded' END AS status FROM n WHERE seq % 10 IN (0, 1) OR anchor LIKE '1%'""",
    "salvage_log": _USAGE + " SELECT CASE WHEN seq % 10 IN (0, 1) THEN 'corrupt' WHEN anchor LIKE '1%' THEN 'superseded' ELSE 'ok' END AS status, count(*) AS n FROM e0 GROUP BY 1",
    "mark_events": _report(1)
    + """, x AS (SELECT id, unnest(members[1:3]) AS anchor, generate_subscripts(members[1:3], 1) AS rank FROM pr)
SELECT id AS presentation, CASE WHEN rank = 1 THEN 'pinned' ELSE 'opened' END AS kind, anchor, CASE WHEN length(anchor) % 2 = 0 THEN 'archival' ELSE 'human-like' END AS policy, rank = 1 AS has_note FROM x""",
    "skip_tally": """WITH r AS (SELECT (conv_id * 8 + turn) % 20 AS r FROM conversations),
s AS (SELECT CASE r WHEN 1 THEN 'noIndexableText' WHEN 2 THEN 'notATurn' WHEN 3 THEN 'missingPointerField' WHEN 4 THEN 'malformedIdentifier' WHEN 5 THEN 'unparseableLine' WHEN 7 THEN 'toolResultOnly' WHEN 8 THEN 'incompleteTrailingRecord'
    WHEN 10 THEN 'noIndexableText' WHEN 11 THEN 'noIndexableText' END AS skip_reason FROM r)
SELECT skip_reason, count(*) AS n FROM s WHERE skip_reason IS NOT NULL GROUP BY skip_reason""",
    "tool_metadata": """WITH c AS (SELECT *, (conv_id * 8 + turn) % 20 AS r FROM conversations)
SELECT conv_id || '-' || turn AS uuid, CASE WHEN r = 9 THEN CASE WHEN role = 'assistant' THEN role ELSE 'user' END ELSE role END AS role,
    sha256(CASE WHEN r = 6 THEN '⟨tool Read command=a b' || turn || ' path=/f/' || turn || '⟩' WHEN r = 9 THEN '⟨tool_result error⟩' || chr(10) || text ELSE text END) AS text_sha256,
    1704067200000 + turn * 1000 + CASE WHEN r % 2 = 0 THEN 250 ELSE 0 END AS ms
FROM c WHERE r NOT IN (1, 2, 3, 4, 5, 7, 8, 10, 11)""",
    "content_hash": f"""WITH t AS (SELECT conv_id, turn, text, trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g')) AS plain, hex(encode(text)) AS h FROM conversations),
s AS (SELECT *, list_reduce(list_transform(range(0, length(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::UHUGEINT), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % {1 << 64}::UHUGEINT, 14695981039346656037::UHUGEINT) AS f0 FROM t),
m1 AS (SELECT *, (xor(f0, f0 >> 33) * {0xFF51AFD7ED558CCD}::UHUGEINT) % {1 << 64}::UHUGEINT AS f1 FROM s),
m2 AS (SELECT *, (xor(f1, f1 >> 33) * {0xC4CEB9FE1A85EC53}::UHUGEINT) % {1 << 64}::UHUGEINT AS f2 FROM m1)
SELECT conv_id, turn, CASE WHEN plain <> '' THEN sha256({_pad(0x5C)} || unhex(sha256({_pad(0x36)} || encode(plain)))) END AS content_hash, CASE WHEN xor(f2, f2 >> 33) % 2 = 0 THEN 'a' ELSE 'b' END AS side FROM m2""",
    "nested_samples": """WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('7:' || doc_id), doc_id) AS n FROM documents)
SELECT doc_id, CASE WHEN n <= 10 THEN 10 WHEN n <= 40 THEN 40 ELSE 160 END AS smallest_sample FROM d WHERE n <= 160""",
    "known_item_recall": _known_items(),
    "prompt_modes": """WITH c AS (SELECT conv_id, turn, conv_id % 5 AS m, turn % 4 = 2 AS cmd, coalesce(text, '') AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN m = 2 THEN 'off' WHEN cmd OR trim(t) = '' THEN 'synthetic' WHEN m = 1 OR regexp_matches(t, '(?i)ques+') THEN 'hit' ELSE 'miss' END AS outcome FROM c""",
    "prompt_gate": """WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN text WHEN turn % 4 = 2 THEN '/cmd ' || text ELSE text END AS own FROM conversations)
SELECT conv_id, turn, CASE WHEN trim(own) = '' OR starts_with(own, '/cmd') THEN 'synthetic' WHEN regexp_matches(own, '(?i)\\bthing\\b') OR regexp_matches(own, '(?i)ques+') THEN 'hit' ELSE 'miss' END AS outcome FROM c""",
}
