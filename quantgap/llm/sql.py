"""SQL for the registered queries, as functions of the table they read."""

from __future__ import annotations

from quantgap.llm import mixing, quality, sharding
from quantgap.llm.common import BENCH_WORD, UPPER, WORD
from quantgap.llm.decontamination import WINDOW

UNIT = "(('0x' || substr(md5({0}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def _lower(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{UPPER.lower()}')"


def quality_rows(docs: str = "documents") -> str:
    """Measures and verdict of each row of ``docs``, beside its row number ``rid``."""
    stop = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
    measures = {
        "n_words": "n_words",
        "repeat_ratio": "if(n_words > 0, n_repeat_words / n_words, 0)",
        "mean_word_chars": "if(n_words > 0, word_chars / n_words, 0)",
        "symbol_ratio": "if(word_chars > 0, n_symbols / word_chars, 0)",
        "stop_ratio": "if(n_words > 0, n_stop_words / n_words, 0)",
        "dup_line_ratio": "if(n_lines > 0, n_dup_lines / n_lines, 0)",
    }
    failed = " OR ".join(
        f"({measures[r.measure]}) {sign} {bound}" for r in quality.RULES for sign, bound in (("<", r.low), (">", r.high)) if bound is not None
    )
    return f"""
WITH q_docs AS (SELECT *, row_number() OVER () AS rid, coalesce(text, '') AS body FROM {docs}),
q_tokens AS (SELECT rid, regexp_extract_all(body, '{WORD}') AS w FROM q_docs),
q_windows AS (
  SELECT rid, i, w[i + 1] || chr(1) || w[i + 2] || chr(1) || w[i + 3] AS g
  FROM (SELECT rid, w, unnest(range(0, len(w) - 2)) AS i FROM q_tokens WHERE len(w) >= 3)),
q_twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM q_windows) WHERE n > 1),
q_repeats AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM q_twice) GROUP BY rid),
q_lines AS (
  SELECT rid, count(*) AS n, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT rid, unnest(string_split(body, chr(10))) AS line FROM q_docs) WHERE regexp_matches(line, '{WORD}') GROUP BY rid),
q_counts AS (
  SELECT d.*, len(t.w)::BIGINT AS n_words,
    length(regexp_replace(body, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    coalesce(l.dup, 0)::BIGINT AS n_dup_lines, coalesce(l.n, 0)::BIGINT AS n_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(t.w, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop_words
  FROM q_docs d JOIN q_tokens t USING (rid) LEFT JOIN q_lines l USING (rid) LEFT JOIN q_repeats r USING (rid))
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, NOT ({failed}) AS kept FROM q_counts"""


def quality_query() -> str:
    return f"SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM ({quality_rows()})"


def decontamination_rows(docs: str = "documents", benchmark: str = "benchmark") -> str:
    """Hits of each row of ``docs``, beside all its columns."""
    tokens = f"regexp_extract_all({_lower("coalesce(text, '')")}, '{BENCH_WORD}')"
    return f"""
WITH c_docs AS (SELECT *, row_number() OVER () AS rid, {tokens} AS w FROM {docs}),
c_items AS (SELECT item_id::VARCHAR AS item, {tokens} AS w FROM {benchmark}),
c_grams AS (
  SELECT DISTINCT item, width, array_to_string(w[i + 1:i + width], ' ') AS gram
  FROM (SELECT item, w, least(len(w), {WINDOW}) AS width, unnest(range(0, len(w) - least(len(w), {WINDOW}) + 1)) AS i FROM c_items WHERE len(w) > 0)),
c_places AS (
  SELECT rid, width, i, array_to_string(w[i + 1:i + width], ' ') AS gram
  FROM (SELECT rid, w, width, unnest(range(0, len(w) - width + 1)) AS i
        FROM c_docs, (SELECT DISTINCT width FROM c_grams) WHERE len(w) >= width)),
c_hits AS (SELECT DISTINCT rid, i, p.width, item FROM c_places p JOIN c_grams g ON p.gram = g.gram AND p.width = g.width),
c_words AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + width)) AS p FROM c_hits) GROUP BY rid),
c_ids AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM c_hits WHERE item IS NOT NULL) GROUP BY rid)
SELECT d.* EXCLUDE (w), len(d.w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(c.n, 0)::BIGINT AS n_items,
  sha256(coalesce(c.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM c_docs d LEFT JOIN c_words h USING (rid) LEFT JOIN c_ids c USING (rid)"""


def decontamination_query() -> str:
    return f"SELECT doc_id, n_words, n_hit, n_items, items_sha256, contaminated FROM ({decontamination_rows()})"


def near_duplicate_rows(docs: str = "documents") -> str:
    """Sets, component and verdict of each row of ``docs`` (ids must be unique), beside all its columns."""
    return f"""
WITH RECURSIVE n_docs AS (SELECT *, coalesce(regexp_extract_all({_lower("text")}, '{WORD}'), []) AS w FROM {docs}),
n_shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + least(len(w), 5)], chr(1)) AS s
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - least(len(w), 5) + 1)) AS i FROM n_docs WHERE len(w) > 0)),
n_sizes AS (SELECT doc_id, count(*)::BIGINT AS n FROM n_shingles GROUP BY doc_id),
n_common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM n_shingles a JOIN n_shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
n_links AS (
  SELECT x, y FROM n_common JOIN n_sizes m ON m.doc_id = x JOIN n_sizes n ON n.doc_id = y WHERE 100 * c >= 75 * (m.n + n.n - c)),
n_both AS (SELECT x, y FROM n_links UNION ALL SELECT y, x FROM n_links),
n_reach AS (SELECT x, y FROM n_both UNION SELECT r.x, b.y FROM n_reach r JOIN n_both b ON r.y = b.x),
n_ids AS (SELECT x, min(y) AS y FROM n_reach GROUP BY x)
SELECT d.* EXCLUDE (w), coalesce(s.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(r.y, d.doc_id)) AS component_id,
  d.doc_id <= coalesce(r.y, d.doc_id) AS kept
FROM n_docs d LEFT JOIN n_sizes s USING (doc_id) LEFT JOIN n_ids r ON r.x = d.doc_id"""


def near_duplicate_query() -> str:
    return f"SELECT doc_id, n_shingles, component_id, kept FROM ({near_duplicate_rows()})"


def mixing_rows(docs: str = "documents", seed: int = 11) -> str:
    """Sizes, targets and copies of each row of ``docs``, beside all its columns."""
    weights = ", ".join(map(str, mixing.WEIGHTS))
    cap, unit = mixing.CAP, UNIT.format(f"concat_ws(':', '{seed}', coalesce(doc_id::VARCHAR, ''), size::VARCHAR)")
    return f"""
WITH m_docs AS (SELECT *, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM {docs}),
m_sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    ([{weights}])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1)::INT]::DOUBLE AS weight,
    (sum(size) * {cap})::DOUBLE AS filled FROM m_docs GROUP BY source),
m_levels AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(filled) OVER (ORDER BY filled / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY filled / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM m_sources),
m_targets AS (
  SELECT source, source_size, CASE WHEN filled / weight > lvl THEN
    least(filled, weight * (SELECT lvl FROM m_levels WHERE filled / weight > lvl ORDER BY filled / weight LIMIT 1)) ELSE filled END AS target FROM m_levels),
m_split AS (
  SELECT source, sum(CASE WHEN size >= {mixing.LONG} THEN size ELSE 0 END)::DOUBLE AS high, sum(CASE WHEN size >= {mixing.LONG} THEN 0 ELSE size END)::DOUBLE AS low
  FROM m_docs GROUP BY source),
m_tilts AS (
  SELECT t.*, CASE WHEN {mixing.PREFERRED} * target <= {cap} * (low + {mixing.PREFERRED} * high) THEN target / (low + {mixing.PREFERRED} * high)
    WHEN low > 0 THEN (target - {cap} * high) / low ELSE {cap} END AS tilt
  FROM m_targets t JOIN m_split s ON t.source IS NOT DISTINCT FROM s.source),
m_rates AS (
  SELECT d.*, t.source_size, t.target, row_number() OVER () AS rid,
    CASE WHEN t.target > 0 THEN round(least({cap}::DOUBLE, CASE WHEN size >= {mixing.LONG} THEN {mixing.PREFERRED} ELSE 1 END * tilt), 9) ELSE 0::DOUBLE END AS rate, {unit} AS u
  FROM m_docs d JOIN m_tilts t ON d.source IS NOT DISTINCT FROM t.source),
m_parts AS (SELECT *, floor(rate)::BIGINT AS whole, rate - floor(rate) AS frac FROM m_rates),
m_keys AS (SELECT *, CASE WHEN frac > 0 THEN (u / (1 - u)) / (frac / (1 - frac)) END AS key FROM m_parts),
m_rest AS (SELECT source, any_value(target) - sum(size * whole) AS rest FROM m_keys GROUP BY source),
m_order AS (
  SELECT rid, sum(size) OVER (PARTITION BY source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    - sum(size) OVER (PARTITION BY source, key) / 2 AS middle FROM m_keys WHERE frac > 0 AND size > 0),
m_copies AS (
  SELECT k.*, CASE WHEN size = 0 THEN 0 ELSE whole + CASE WHEN o.middle <= r.rest THEN 1 ELSE 0 END END AS copies
  FROM m_keys k JOIN m_rest r ON k.source IS NOT DISTINCT FROM r.source LEFT JOIN m_order o USING (rid))
SELECT * EXCLUDE (rid, u, key, whole, frac), (size * copies)::BIGINT AS taken FROM m_copies"""


def mixing_query() -> str:
    return f"SELECT doc_id, size, source_size, target, taken, rate FROM ({mixing_rows()})"


def _feistel(value: str, total: str, seed: int) -> str:
    rounds = f"{{'l': {value} // b, 'r': {value} % b}}"
    for k in range(sharding.ROUNDS):
        half, other, modulus = ("l", "r", "a") if k % 2 == 0 else ("r", "l", "b")
        moved = f"(s.{half} + ('0x' || substr(md5('{seed}.{k}:' || s.{other}), 1, 12))::BIGINT) % {modulus}"
        fields = {"l": "s.l", "r": "s.r", half: moved}
        rounds = f"(list_transform([{rounds}], lambda s: {{'l': {fields['l']}, 'r': {fields['r']}}}))[1]"
    return f"(list_transform([{rounds}], lambda s: s.l * b + s.r))[1]"


def sharding_rows(keyed: str, keys: list[str], shards: int, seed: int = 7) -> str:
    """Shard and slot of each row of ``keyed``, ordered by the md5 of the first key, that of the others, and then the keys."""
    text = [f"coalesce({k}::VARCHAR, '')" for k in keys]
    order = ", ".join([f"md5({text[0]})", f"md5(concat_ws('|', {', '.join(text[1:] or [repr('')])}))", *[f"{k} NULLS LAST" for k in keys]])
    return f"""
WITH RECURSIVE s_rows AS (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS n, count(*) OVER () AS total FROM {keyed}),
s_sides AS (SELECT *, greatest(1, ceil(sqrt(total::DOUBLE))::BIGINT) AS a FROM s_rows),
s_base AS (SELECT *, greatest(1, ceil(total::DOUBLE / a)::BIGINT) AS b FROM s_sides),
s_walk AS (
  SELECT n, total, a, b, {_feistel("n", "total", seed)} AS y FROM s_base
  UNION ALL
  SELECT n, total, a, b, {_feistel("y", "total", seed)} AS y FROM s_walk WHERE y >= total)
SELECT s.* EXCLUDE (n, total, a, b), (w.y % {shards})::INT AS shard, w.y // {shards} AS slot
FROM s_base s JOIN s_walk w ON s.n = w.n AND w.y < w.total"""


CRC_KEYS = """
(WITH c_steps AS (SELECT range AS v, list_reduce(list_prepend(range, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS t FROM range(256)),
c_table AS (SELECT list(t ORDER BY v) AS t FROM c_steps)
SELECT doc_id, octet_length(encode(body)) + 1 AS size,
  xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda c, x: xor(c // 256, t[(xor(c, x) & 255) + 1])))::BIGINT AS text_crc32
FROM (SELECT doc_id, coalesce(text, '') AS body FROM documents), c_table)"""


def sharding_query() -> str:
    rows = sharding_rows(CRC_KEYS, ["doc_id", "size", "text_crc32"], 8)
    return f"SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, shard, slot::BIGINT AS slot, NULL::INT AS grown_shard FROM ({rows})"


def warc_query() -> str:
    """SHA-1 in hexadecimal is written in base 32 by groups of five digits, which are four signs each."""
    sign = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
    five = "('0x' || substr(sha, 5 * g + 1, 5))::BIGINT"
    signs = " || ".join(f"substr({sign}, ({five} // {32**k}) % 32 + 1, 1)" for k in (3, 2, 1, 0))
    return f"""
WITH bodies AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
hashed AS (SELECT page_id, octet_length(encode(body))::BIGINT AS n, sha1(body) AS sha FROM bodies),
firsts AS (SELECT sha, max(page_id) AS id FROM hashed GROUP BY sha)
SELECT page_id, n AS payload_bytes, array_to_string(list_transform(range(8), lambda g: {signs}), '') AS payload_digest,
  CASE WHEN page_id = id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> id THEN id END AS refers_to
FROM hashed JOIN firsts USING (sha)"""


def exact_query() -> str:
    return """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, digest AS text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents) WINDOW g AS (PARTITION BY digest)"""


def centroid_query(k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, seed: str = "3") -> str:
    """Lloyd's rounds one after the other, on one row per vector and component."""
    near = lambda t: f"""
SELECT rid, min({{'d': d, 'c': c}}) AS best FROM (
  SELECT v.rid, m.c, sum((v.x - m.x) * (v.x - m.x))::BIGINT AS d FROM k_parts v JOIN {t} m USING (j) GROUP BY v.rid, m.c) GROUP BY rid"""  # noqa: E731
    steps = ""
    for r in range(rounds):
        steps += f""",
k_near{r} AS MATERIALIZED ({near(f"k_mean{r}")}),
k_mean{r + 1} AS MATERIALIZED (
  SELECT m.c, m.j, coalesce(((s.total - ((s.total % s.n) + s.n) % s.n) // s.n)::BIGINT, m.x) AS x
  FROM k_mean{r} m LEFT JOIN (
    SELECT best.c AS c, j, sum(x) AS total, count(*) AS n FROM k_near{r} JOIN k_parts USING (rid) GROUP BY best.c, j) s ON s.c = m.c AND s.j = m.j)"""
    return f"""
WITH k_rows AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {scale})::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {width}),
k_parts AS MATERIALIZED (SELECT rid, unnest(range({width})) AS j, unnest(q) AS x FROM k_rows),
k_seeds AS (SELECT q, row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')), q) - 1 AS c FROM k_rows),
k_mean0 AS MATERIALIZED (SELECT c, unnest(range({width})) AS j, unnest(q) AS x FROM k_seeds WHERE c < {k}){steps},
k_last AS MATERIALIZED ({near(f"k_mean{rounds}")}),
k_names AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY j)) AS name FROM k_mean{rounds} GROUP BY c)
SELECT vec_id, best.c::INT AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia,
  (sum(best.d) OVER ())::BIGINT AS inertia, name AS centroid_sha256
FROM k_rows JOIN k_last USING (rid) JOIN k_names ON k_names.c = best.c"""


def _crc32(body: str) -> str:
    """CRC-32 of an ASCII expression; ``t`` is the byte table of ``CRC_TABLE``."""
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode({body})), '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda c, x: xor(c // 256, t[(xor(c, x) & 255) + 1])))::BIGINT"""


CRC_TABLE = """c_steps AS (SELECT range AS v, list_reduce(list_prepend(range, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS t FROM range(256)),
c_table AS (SELECT list(t ORDER BY v) AS t FROM c_steps)"""


def periodic_query() -> str:
    """Stretches of equal words a period apart, over all pairs of equal words of a text."""
    return f"""
WITH {CRC_TABLE},
p_docs AS (
  SELECT *, len(w) AS n, h // 10 AS g FROM (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '{WORD}'), []) AS w, {_crc32("doc_id::VARCHAR")} AS h FROM documents, c_table)),
p_start AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a FROM p_docs),
p_words AS MATERIALIZED (
  SELECT rid, n, i, w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END] AS word FROM (SELECT *, unnest(range(n)) AS i FROM p_start)),
p_same AS (
  SELECT x.rid, y.i - x.i AS q, x.i FROM p_words x JOIN p_words y ON x.rid = y.rid AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
p_islands AS (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM p_same),
p_long AS (SELECT rid, q, min(i) AS s, count(*) + q AS len FROM p_islands GROUP BY rid, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
p_runs AS MATERIALIZED (SELECT rid, s, len, min(q) AS q FROM p_long GROUP BY rid, s, len),
p_gone AS (SELECT DISTINCT rid, unnest(range(s + q, s + len)) AS i FROM p_runs),
p_kept AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS body FROM p_words ANTI JOIN p_gone USING (rid, i) GROUP BY rid),
p_best AS (SELECT * FROM p_runs QUALIFY row_number() OVER (PARTITION BY rid ORDER BY len::DOUBLE / q DESC, s, q) = 1),
p_lines AS (SELECT rid, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM p_runs GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, len::BIGINT AS length, q::BIGINT AS period,
  (1000 * len // q)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
FROM p_docs LEFT JOIN p_kept USING (rid) LEFT JOIN p_best USING (rid) LEFT JOIN p_lines USING (rid)"""
