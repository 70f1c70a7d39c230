"""DuckDB SQL for the queries of ``queries.py``, written apart from the Spark plans.

Long texts are cut into blocks before positions are taken, as ``substr`` walks a text.
Alignment scores come from a recursion over cells in row order that keeps the last n + 2
values: the first is the diagonal neighbour, the second the one above, the last the left one.
"""

from __future__ import annotations

K_SEED = 20
SIZE = 256


def _kmers(source: str, id: str, seq: str, k: int) -> str:
    """SELECT of (id, pos, kmer)."""
    return f"""
SELECT id, start + off AS pos, substr(blk, off + 1, {k}) AS kmer FROM (
  SELECT id, start, blk, unnest(range(least({SIZE}, length(blk) - {k - 1})))::BIGINT AS off FROM (
    SELECT id, start, substr(seq, (start + 1)::BIGINT, {SIZE + k - 1}) AS blk FROM (
      SELECT {id}::BIGINT AS id, {seq} AS seq, unnest(range(0, greatest(length({seq}) - {k - 1}, 0), {SIZE}))::BIGINT AS start FROM {source}
    )
  )
)"""


PART = ("part", "p_partkey", "p_name")
DOCS = ("documents", "doc_id", "text")
ITEMS = ("benchmark", "item_id", "text")


def _seeds(k: int) -> str:
    return f"""seeds AS (
  SELECT q.id AS query_id, r.id AS ref_id, q.pos AS query_pos, r.pos AS ref_pos
  FROM ({_kmers(*ITEMS, k)}) q JOIN ({_kmers(*DOCS, k)}) r ON q.kmer = r.kmer
), runs AS (
  SELECT query_id, ref_id, min(query_pos) AS query_pos, min(ref_pos) AS ref_pos, count(*)::BIGINT AS n_seeds FROM (
    SELECT *, ref_pos - query_pos AS diag, query_pos - row_number() OVER (PARTITION BY query_id, ref_id, ref_pos - query_pos ORDER BY query_pos) AS grp FROM seeds
  ) GROUP BY query_id, ref_id, diag, grp
)"""


# Offsets of a side with running score and best; the side ends at the first offset whose score is more than 5 below the best.
_EXTEND = f"""{_seeds(K_SEED)}, flanks AS (
  SELECT u.*, b.text AS q, d.text AS r,
    least(length(b.text) - query_pos, length(d.text) - ref_pos) AS right_n, least(query_pos, ref_pos) AS left_n
  FROM runs u JOIN benchmark b ON b.item_id = u.query_id JOIN documents d ON d.doc_id = u.ref_id
), cut AS (
  SELECT query_id, ref_id, query_pos, ref_pos, n_seeds, substr(q, query_pos + 1, right_n) AS qr, substr(r, ref_pos + 1, right_n) AS rr,
    reverse(substr(q, query_pos - left_n + 1, left_n)) AS ql, reverse(substr(r, ref_pos - left_n + 1, left_n)) AS rl
  FROM flanks
), right_steps AS (
  SELECT query_id, ref_id, query_pos, ref_pos, i, CASE WHEN substr(qr, i, 1) = substr(rr, i, 1) THEN 1 ELSE -1 END AS s
  FROM (SELECT *, unnest(range(1, length(qr) + 1)) AS i FROM cut)
), right_scores AS (
  SELECT *, greatest(0, max(score) OVER (PARTITION BY query_id, ref_id, query_pos, ref_pos ORDER BY i)) AS best FROM (
    SELECT *, sum(s) OVER (PARTITION BY query_id, ref_id, query_pos, ref_pos ORDER BY i) AS score FROM right_steps)
), right_ends AS (
  SELECT query_id, ref_id, query_pos, ref_pos, coalesce(min(i) FILTER (WHERE score < best - 5), 1000000000) AS stop FROM right_scores GROUP BY ALL
), right_best AS (
  SELECT query_id, ref_id, query_pos, ref_pos, greatest(0, max(score)) AS best, coalesce(arg_min(i, (-score, i)), 0) AS at
  FROM right_scores JOIN right_ends USING (query_id, ref_id, query_pos, ref_pos) WHERE i <= stop GROUP BY ALL
), left_steps AS (
  SELECT c.query_id, c.ref_id, c.query_pos, c.ref_pos, i, b.best AS base, CASE WHEN substr(ql, i, 1) = substr(rl, i, 1) THEN 1 ELSE -1 END AS s
  FROM (SELECT *, unnest(range(1, length(ql) + 1)) AS i FROM cut) c JOIN right_best b USING (query_id, ref_id, query_pos, ref_pos)
), left_scores AS (
  SELECT *, greatest(base, max(score) OVER (PARTITION BY query_id, ref_id, query_pos, ref_pos ORDER BY i)) AS best FROM (
    SELECT *, base + sum(s) OVER (PARTITION BY query_id, ref_id, query_pos, ref_pos ORDER BY i) AS score FROM left_steps)
), left_ends AS (
  SELECT query_id, ref_id, query_pos, ref_pos, coalesce(min(i) FILTER (WHERE score < best - 5), 1000000000) AS stop FROM left_scores GROUP BY ALL
), left_best AS (
  SELECT query_id, ref_id, query_pos, ref_pos, max(score) AS top, arg_min(i, (-score, i)) AS at, any_value(base) AS base
  FROM left_scores JOIN left_ends USING (query_id, ref_id, query_pos, ref_pos) WHERE i <= stop GROUP BY ALL
), extended AS (
  SELECT u.query_id, u.ref_id, u.query_pos, u.ref_pos, u.n_seeds,
    (u.query_pos - CASE WHEN l.top > l.base THEN l.at ELSE 0 END)::BIGINT AS query_start, (u.query_pos + r.at)::BIGINT AS query_end,
    (u.ref_pos - CASE WHEN l.top > l.base THEN l.at ELSE 0 END)::BIGINT AS ref_start, (u.ref_pos + r.at)::BIGINT AS ref_end,
    greatest(r.best, coalesce(l.top, 0))::BIGINT AS score
  FROM runs u JOIN right_best r USING (query_id, ref_id, query_pos, ref_pos) LEFT JOIN left_best l USING (query_id, ref_id, query_pos, ref_pos)
), merged AS (
  SELECT query_id, ref_id, query_start, query_end, ref_start, ref_end, score, min((query_pos, ref_pos)) AS f, sum(n_seeds)::BIGINT AS n_seeds FROM extended GROUP BY ALL
), hits AS (
  SELECT query_id, ref_id, f[1] AS query_pos, f[2] AS ref_pos, query_start, query_end, ref_start, ref_end, score,
    substr(b.text, query_start + 1, query_end - query_start) AS query_seq, substr(d.text, ref_start + 1, ref_end - ref_start) AS ref_seq, n_seeds
  FROM merged JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = ref_id
)"""
_EXTEND = _EXTEND.replace("min((query_pos, ref_pos)) AS f", "min(query_pos) AS qp, arg_min(ref_pos, (query_pos, ref_pos)) AS rp").replace("f[1] AS query_pos, f[2] AS ref_pos", "qp AS query_pos, rp AS ref_pos")

_PATTERNS = """patterns AS (
  SELECT DISTINCT pattern FROM (
    SELECT substr(text, 30, 12) AS pattern FROM benchmark UNION ALL SELECT substr(text, 50, 20) FROM benchmark UNION ALL SELECT substr(text, 30, 6) || '#absent' FROM benchmark
  ) WHERE pattern <> ''
)"""


def _locate(name: str, patterns: str, text: str = "documents", id: str = "doc_id", seq: str = "text") -> str:
    """CTE of (text_id, pattern, pos): pairs that contain, then a scan of blocks."""
    return f"""{name}_pairs AS (
  SELECT t.{id}::BIGINT AS text_id, t.{seq} AS seq, pattern FROM {text} t JOIN {patterns} ON contains(t.{seq}, pattern)
), {name} AS (
  SELECT text_id, pattern, start + off AS pos FROM (
    SELECT text_id, pattern, start, blk, unnest(range({SIZE}))::BIGINT AS off FROM (
      SELECT text_id, pattern, start, substr(seq, start + 1, {SIZE} + length(pattern) - 1) AS blk FROM (
        SELECT *, unnest(range(0, length(seq), {SIZE}))::BIGINT AS start FROM {name}_pairs)
    ) WHERE contains(blk, pattern)
  ) WHERE substr(blk, off + 1, length(pattern)) = pattern
)"""


_LOCATED = f"{_PATTERNS}, {_locate('located', 'patterns')}"
_AGG = "count(*)::BIGINT AS count, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions"

_PAIRS = "pairs AS (SELECT a.p_partkey::BIGINT AS pair_id, a.p_name AS x, b.p_name AS y, length(a.p_name) AS m, length(b.p_name) AS n FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)"


def _scores(match: int, mismatch: int, gap: int, local: bool, where: str = "") -> str:
    edge = "0" if local else f"(c // (n + 1)) * {gap}"
    first = "0" if local else f"j * {gap}"
    floor = "0, " if local else ""
    result = "best" if local else "cells[n + 2]"
    return f"""
WITH RECURSIVE {_PAIRS}, fill AS (
  SELECT pair_id, x, y, m, n, (n + 1)::BIGINT AS c, list_concat([0], list_transform(range(n + 1), lambda j: ({first})::BIGINT)) AS cells, 0::BIGINT AS best FROM pairs
  UNION ALL
  SELECT pair_id, x, y, m, n, c + 1, list_concat(cells[2:], [v]), greatest(best, v) FROM (
    SELECT *, (CASE WHEN c % (n + 1) = 0 THEN {edge} ELSE greatest({floor}cells[1] + CASE WHEN substr(x, c // (n + 1), 1) = substr(y, c % (n + 1), 1) THEN {match} ELSE {mismatch} END, cells[2] + {gap}, cells[n + 2] + {gap}) END)::BIGINT AS v
    FROM fill WHERE c < (m + 1) * (n + 1)
  )
)
SELECT pair_id, ({result})::BIGINT AS score FROM fill WHERE c = (m + 1) * (n + 1) {where}"""


def _affine(match: int, mismatch: int, opened: int, extend: int) -> str:
    low = "-1000000"
    return f"""
WITH RECURSIVE {_PAIRS}, fill AS (
  SELECT pair_id, x, y, m, n, (n + 1)::BIGINT AS c, list_transform(range(n + 2), lambda j: 0::BIGINT) AS ms, list_transform(range(n + 2), lambda j: ({low})::BIGINT) AS gs, list_transform(range(n + 2), lambda j: ({low})::BIGINT) AS ds, 0::BIGINT AS best FROM pairs
  UNION ALL
  SELECT pair_id, x, y, m, n, c + 1, list_concat(ms[2:], [mv]), list_concat(gs[2:], [gv]), list_concat(ds[2:], [dv]), greatest(best, mv, gv, dv) FROM (
    SELECT *,
      (CASE WHEN edge THEN 0 ELSE greatest(0, greatest(ms[1], gs[1], ds[1]) + CASE WHEN substr(x, c // (n + 1), 1) = substr(y, c % (n + 1), 1) THEN {match} ELSE {mismatch} END) END)::BIGINT AS mv,
      (CASE WHEN edge THEN {low} ELSE greatest(0, ms[n + 2] + {opened}, ds[n + 2] + {opened}, gs[n + 2] + {extend}) END)::BIGINT AS gv,
      (CASE WHEN edge THEN {low} ELSE greatest(0, ms[2] + {opened}, gs[2] + {opened}, ds[2] + {extend}) END)::BIGINT AS dv
    FROM (SELECT *, c % (n + 1) = 0 AS edge FROM fill WHERE c < (m + 1) * (n + 1))
  )
)
SELECT pair_id, best AS score FROM fill WHERE c = (m + 1) * (n + 1)"""


def _rotations(table: str, id: str, seq: str) -> str:
    return f"""closed AS (SELECT {id}::BIGINT AS text_id, CASE WHEN {seq} LIKE '%$' THEN {seq} ELSE {seq} || '$' END AS s FROM {table}),
rotations AS (SELECT text_id, s, i, substr(s, i + 1) || substr(s, 1, i) AS rot FROM (SELECT *, unnest(range(length(s)))::BIGINT AS i FROM closed)),
ranked AS (SELECT text_id, i, row_number() OVER (PARTITION BY text_id ORDER BY rot, i) - 1 AS rank, right(rot, 1) AS ch FROM rotations)"""


def _doubling() -> str:
    """CTEs up to ``ranked`` (text_id, i, rank, ch) of whole documents: ranks of 16 characters, doubled in twelve windows, up to 65,536."""
    steps = "".join(
        f""", r{n + 1} AS MATERIALIZED (
  SELECT a.text_id, a.i, a.n, rank() OVER (PARTITION BY a.text_id ORDER BY a.r, b.r) AS r FROM r{n} a JOIN r{n} b ON b.text_id = a.text_id AND b.i = (a.i + {16 << n}) % a.n)"""
        for n in range(12)
    )
    return f"""closed AS (SELECT doc_id::BIGINT AS text_id, CASE WHEN text LIKE '%$' THEN text ELSE text || '$' END AS s FROM documents WHERE text IS NOT NULL),
pieces AS (SELECT text_id, n, start, substr(s || repeat(s, 16)[:15], (start + 1)::BIGINT, {SIZE} + 15) AS blk FROM (SELECT text_id, s, length(s) AS n, unnest(range(0, length(s), {SIZE}))::BIGINT AS start FROM closed)),
r0 AS MATERIALIZED (
  SELECT text_id, i, n, rank() OVER (PARTITION BY text_id ORDER BY b) AS r FROM (
    SELECT text_id, n, start + off AS i, substr(blk, off + 1, 16) AS b FROM (SELECT *, unnest(range(least({SIZE}, n - start)))::BIGINT AS off FROM pieces)
  )){steps}, ranked AS (
  SELECT text_id, i, row_number() OVER (PARTITION BY text_id ORDER BY r, i) - 1 AS rank FROM r12
)"""


# Both scores of whole texts: a row of cells a round, a cell a table row; a gap along the row is a running maximum.
_COMPARE = f"""WITH RECURSIVE {_EXTEND}, asked AS (
  SELECT DISTINCT query_id, ref_id, b.text AS q, d.text AS r FROM seeds JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = ref_id
), letters AS (
  SELECT query_id, ref_id, unnest(range(length(r) + 1))::INTEGER AS j, unnest(list_concat([''], string_split(r, ''))) AS ch FROM asked
), cells AS (
  SELECT query_id, ref_id, 0 AS i, j, ch, -j AS g, 0 AS l FROM letters
  UNION ALL
  SELECT query_id, ref_id, i + 1, j, ch, (max(gd + j) OVER w - j)::INTEGER, greatest(0, max(ld + j) OVER w - j)::INTEGER FROM (
    SELECT c.query_id, c.ref_id, i, j, ch,
      CASE WHEN j = 0 THEN -(i + 1) ELSE greatest(g - 1, lag(g) OVER o + CASE WHEN ch = substr(q, i + 1, 1) THEN 1 ELSE -1 END) END AS gd,
      CASE WHEN j = 0 THEN 0 ELSE greatest(0, l - 1, lag(l) OVER o + CASE WHEN ch = substr(q, i + 1, 1) THEN 2 ELSE -1 END) END AS ld
    FROM cells c JOIN asked USING (query_id, ref_id) WHERE i < length(q) WINDOW o AS (PARTITION BY c.query_id, c.ref_id ORDER BY j)
  ) WINDOW w AS (PARTITION BY query_id, ref_id ORDER BY j)
), scored AS (
  SELECT query_id, ref_id, arg_max(g, (i, j))::BIGINT AS global_score, max(l)::BIGINT AS local_score FROM cells GROUP BY query_id, ref_id
), top AS (
  SELECT query_id, ref_id, score, ref_start, ref_end FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, ref_id ORDER BY score DESC, query_pos, ref_pos) = 1
), whole AS (
  SELECT query_id, ref_id, count(*)::BIGINT AS count, string_agg(p::VARCHAR, ',' ORDER BY p) AS positions FROM (
    SELECT query_id, ref_id, unnest(range(length(r) - length(q) + 1)) AS p, q, r FROM asked WHERE contains(r, q)
  ) WHERE substr(r, p + 1, length(q)) = q GROUP BY query_id, ref_id
)
SELECT s.query_id, s.ref_id, global_score, local_score, t.score AS seed_score, t.ref_start AS seed_ref_start, t.ref_end AS seed_ref_end,
  coalesce(w.count, 0)::BIGINT AS count, coalesce(w.positions, '') AS positions
FROM scored s LEFT JOIN top t USING (query_id, ref_id) LEFT JOIN whole w USING (query_id, ref_id)"""

# Affine scores of whole texts, a row of cells a round: m ends in a match or mismatch, d in a gap of the document, g in one of the
# passage. Inside a row only g runs on, so its best opening is a running maximum.
_AFFINE_WHOLE = f"""WITH RECURSIVE {_seeds(K_SEED)}, asked AS (
  SELECT DISTINCT query_id, ref_id, b.text AS q, d.text AS r FROM seeds JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = ref_id
), letters AS (
  SELECT query_id, ref_id, unnest(range(length(r) + 1))::INTEGER AS j, unnest(list_concat([''], string_split(r, ''))) AS ch FROM asked
), cells AS (
  SELECT query_id, ref_id, 0 AS i, j, ch, 0 AS m, -1000000 AS d, -1000000 AS g FROM letters
  UNION ALL
  SELECT query_id, ref_id, i, j, ch, m, d, (CASE WHEN j = 0 THEN -1000000 ELSE greatest(0, max(greatest(m, d) + j) OVER w - 4 + 1 - j) END)::INTEGER AS g FROM (
    SELECT c.query_id, c.ref_id, i + 1 AS i, j, ch,
      CASE WHEN j = 0 THEN 0 ELSE greatest(0, greatest(lag(m) OVER o, lag(d) OVER o, lag(g) OVER o) + CASE WHEN ch = substr(q, i + 1, 1) THEN 2 ELSE -1 END) END AS m,
      CASE WHEN j = 0 THEN -1000000 ELSE greatest(0, greatest(m, g) - 4, d - 1) END AS d
    FROM cells c JOIN asked USING (query_id, ref_id) WHERE i < length(q) WINDOW o AS (PARTITION BY c.query_id, c.ref_id ORDER BY j)
  ) WINDOW w AS (PARTITION BY query_id, ref_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)
SELECT query_id, ref_id, max(greatest(m, d, g))::BIGINT AS score FROM cells GROUP BY query_id, ref_id"""


ORACLE_SQL = {
    "k1_kmers": _kmers(*PART, 4),
    "k1_kmers_long": f"SELECT kmer, count(*)::BIGINT AS n, max(pos)::BIGINT AS last_pos FROM ({_kmers(*DOCS, 6)}) GROUP BY kmer",
    "k2_postings": f"SELECT kmer, count(*)::BIGINT AS n, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM ({_kmers(*PART, 5)}) GROUP BY kmer",
    "k2_postings_by_id": f"SELECT id, kmer, count(*)::BIGINT AS n, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM ({_kmers(*PART, 2)}) GROUP BY id, kmer",
    "k2_postings_parts": f"SELECT id, kmer, pos // 4096 AS part, count(*)::BIGINT AS n, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM ({_kmers(*DOCS, 2)}) GROUP BY id, kmer, part",
    "s1_seed_join": f"WITH {_seeds(11)} SELECT * FROM seeds",
    "s1_seed_join_stored": f"WITH {_seeds(11)} SELECT * FROM seeds",
    "s1_diagonal_runs": f"WITH {_seeds(K_SEED)} SELECT * FROM runs",
    "s2_extend_seeds": f"WITH {_EXTEND} SELECT * FROM extended",
    "s3_seed_extend": f"""WITH {_EXTEND}
SELECT query_id, ref_id, query_pos + i AS query_pos, ref_pos + i AS ref_pos, query_start, query_end, ref_start, ref_end, score,
  substr(b.text, query_start + 1, query_end - query_start) AS query_seq, substr(d.text, ref_start + 1, ref_end - ref_start) AS ref_seq, 1::BIGINT AS n_seeds
FROM (SELECT *, unnest(range(n_seeds))::BIGINT AS i FROM extended) JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = ref_id""",
    "s3_seed_extend_dedup": f"WITH {_EXTEND} SELECT * FROM hits",
    "s4_top_hits": f"WITH {_EXTEND} SELECT *, 1::INTEGER AS rank FROM hits QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, query_pos, ref_pos, ref_id) <= 1",
    "s5_hit_context": f"""WITH {_EXTEND}
SELECT query_id, ref_id, query_start, ref_start, score, substr(d.text, greatest(0, ref_start - 5) + 1, least(length(d.text), ref_end + 5) - greatest(0, ref_start - 5)) AS context,
  (ref_start - greatest(0, ref_start - 5))::BIGINT AS context_offset
FROM hits JOIN documents d ON d.doc_id = ref_id""",
    "p1_pattern_count": f"WITH {_LOCATED} SELECT text_id, pattern, count(*)::BIGINT AS count FROM located GROUP BY text_id, pattern",
    "p2_pattern_locate": f"WITH {_LOCATED} SELECT * FROM located",
    "p2_passages": f"WITH patterns AS (SELECT DISTINCT text AS pattern FROM benchmark WHERE text <> ''), {_locate('located', 'patterns')} SELECT * FROM located",
    "p2_overlapping": f"WITH patterns AS (SELECT DISTINCT substr(p_name, 1, 2) AS pattern FROM part), {_locate('located', 'patterns', 'part', 'p_partkey', 'p_name')} SELECT * FROM located",
    "p3_pattern_search": f"""WITH {_LOCATED}, found AS (SELECT text_id, pattern, {_AGG} FROM located GROUP BY text_id, pattern)
SELECT d.doc_id::BIGINT AS text_id, p.pattern, coalesce(f.count, 0)::BIGINT AS count, coalesce(f.positions, '') AS positions
FROM documents d CROSS JOIN patterns p LEFT JOIN found f ON f.text_id = d.doc_id AND f.pattern = p.pattern""",
    "p4_prefix_fallback": f"""WITH {_LOCATED}, found AS (SELECT text_id, pattern, {_AGG} FROM located GROUP BY text_id, pattern),
prefixes AS (SELECT DISTINCT substr(pattern, 1, 6) AS pattern FROM patterns), {_locate('short_located', 'prefixes')},
short_found AS (SELECT text_id, pattern, {_AGG} FROM short_located GROUP BY text_id, pattern)
SELECT text_id, pattern, pattern AS searched, false AS used_prefix, count, positions FROM found
UNION ALL
SELECT s.text_id, p.pattern, s.pattern AS searched, true AS used_prefix, s.count, s.positions
FROM short_found s JOIN patterns p ON substr(p.pattern, 1, 6) = s.pattern
WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.text_id = s.text_id AND f.pattern = p.pattern)""",
    "p5_match_context": f"""WITH {_LOCATED}, firsts AS (SELECT text_id, pattern, min(pos) AS pos FROM located GROUP BY text_id, pattern)
SELECT text_id, pattern, pos, substr(text, greatest(0, pos - 3) + 1, pos - greatest(0, pos - 3)) AS before, substr(text, pos + 1, length(pattern)) AS match, substr(text, pos + length(pattern) + 1, 3) AS after
FROM firsts JOIN documents d ON d.doc_id = text_id""",
    "p6_matched": f"WITH {_PATTERNS} SELECT doc_id::BIGINT AS id FROM documents d WHERE EXISTS (SELECT 1 FROM patterns p WHERE contains(d.text, p.pattern))",
    "p6_unmatched": f"WITH {_PATTERNS} SELECT doc_id::BIGINT AS id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM patterns p WHERE contains(d.text, p.pattern))",
    "p6_matched_patterns": f"WITH {_PATTERNS} SELECT DISTINCT pattern FROM patterns p WHERE EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, p.pattern))",
    "p6_unmatched_patterns": f"WITH {_PATTERNS} SELECT DISTINCT pattern FROM patterns p WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, p.pattern))",
    "b1_rotation_ranks": f"WITH {_rotations(*PART)} SELECT text_id, i, rank FROM ranked",
    "b1_rotation_ranks_doubling": f"WITH {_rotations('customer', 'c_custkey', 'c_name')} SELECT text_id, i, rank FROM ranked",
    "b2_bwt": f"WITH {_rotations(*PART)} SELECT text_id, string_agg(ch, '' ORDER BY rank) AS bwt FROM ranked GROUP BY text_id",
    "b3_char_table": f"""WITH {_rotations(*PART)}, counted AS (SELECT text_id, ch, count(*)::BIGINT AS n FROM ranked GROUP BY text_id, ch)
SELECT text_id, ch, n, coalesce(sum(n) OVER (PARTITION BY text_id ORDER BY ch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c_before FROM counted""",
    "b1_rotation_ranks_passages": f"WITH {_rotations(*ITEMS)} SELECT text_id, i, rank FROM ranked",
    "b1_rotation_ranks_documents": f"WITH {_doubling()} SELECT text_id, rank // 4096 AS part, string_agg(i::VARCHAR, ',' ORDER BY rank) AS indexes FROM ranked GROUP BY text_id, part",
    "b2_bwt_blocks": f"""WITH {_doubling()}, letters AS (SELECT text_id, unnest(string_split(s, '')) AS ch, unnest(range(length(s))) AS i, length(s) AS n FROM closed)
SELECT text_id, rank // 1024 AS block, string_agg(ch, '' ORDER BY rank) AS bwt FROM ranked JOIN (SELECT text_id, ch, (i + 1) % n AS i FROM letters) USING (text_id, i) GROUP BY text_id, block""",
    "b2_bwt_passages": f"WITH {_rotations(*ITEMS)} SELECT text_id, string_agg(ch, '' ORDER BY rank) AS bwt FROM ranked GROUP BY text_id",
    "b3_char_table_documents": """WITH closed AS (SELECT doc_id::BIGINT AS text_id, CASE WHEN text LIKE '%$' THEN text ELSE text || '$' END AS s FROM documents WHERE text IS NOT NULL),
counted AS (SELECT text_id, ch, count(*)::BIGINT AS n FROM (SELECT text_id, unnest(string_split(s, '')) AS ch FROM closed) GROUP BY text_id, ch)
SELECT text_id, ch, n, coalesce(sum(n) OVER (PARTITION BY text_id ORDER BY ch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c_before FROM counted""",
    "a1_global_score": f"WITH {_PAIRS} SELECT pair_id, (m + n - 3 * levenshtein(x, y))::BIGINT AS score FROM pairs",
    "a1_global_score_kernel": _scores(1, -1, -1, False),
    "a1_global_min_score": _scores(1, -1, -1, False, "AND cells[n + 2] >= 1"),
    "a1_global_pairs": """SELECT a.c_custkey::BIGINT AS id1, b.c_custkey::BIGINT AS id2, (length(a.c_name) + length(b.c_name) - 3 * levenshtein(a.c_name, b.c_name))::BIGINT AS score
FROM customer a JOIN customer b ON length(a.c_name) + length(b.c_name) - 3 * levenshtein(a.c_name, b.c_name) >= 33""",
    "a3_local_tiles": f"{_COMPARE[: _COMPARE.index('), top AS')]}) SELECT query_id, ref_id, local_score AS score FROM scored",
    "a4_affine_tiles": _AFFINE_WHOLE,
    "a3_local_score": _scores(2, -1, -1, True),
    "a3_local_min_score": _scores(2, -1, -1, True, "AND best >= 14"),
    "a4_affine_score": _affine(2, -1, -4, -1),
    "a4_affine_min_score": f"{_affine(2, -1, -4, -1)} AND best >= 14",
    "a5_match_line": """SELECT pair_id, string_agg(mark, '' ORDER BY i) AS line, count(*) FILTER (WHERE mark = '|') / count(*)::DOUBLE AS identity FROM (
  SELECT pair_id, i, CASE WHEN substr(a, i, 1) = substr(b, i, 1) THEN '|' ELSE ' ' END AS mark FROM (
    SELECT x.c_custkey::BIGINT AS pair_id, x.c_name AS a, y.c_name AS b, unnest(range(1, length(x.c_name) + 1)) AS i FROM customer x JOIN customer y ON y.c_custkey = x.c_custkey + 1)
) GROUP BY pair_id""",
    "a6_compare_methods": _COMPARE,
}
