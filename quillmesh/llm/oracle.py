"""DuckDB SQL for the queries whose rows SQL can express; each goes its own plain way to them."""

from __future__ import annotations

from .quality_rules import PARTS as LABEL_PARTS
from .quality_rules import STEPS, SYMBOLS

_WORD = r"'[^\x20\x09-\x0D]+'"


def _words(text: str = "text") -> str:
    return f"regexp_extract_all(coalesce({text}, ''), {_WORD})"


def _runs(words: str, k: int) -> str:
    """List of the runs of k words, each as one text; empty if there are fewer."""
    return f"list_transform(range(1, greatest(len({words}) - {k - 2}, 1)), lambda i: array_to_string({words}[i:i + {k - 1}], ' '))"


SUBSTRING_DEDUP = f"""
WITH w AS MATERIALIZED (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS FIRST, md5(coalesce(text, ''))) AS d, {_words()} AS words FROM documents),
runs AS (SELECT d, unnest(r) AS run, generate_subscripts(r, 1) AS i FROM (SELECT d, {_runs("words", 20)} AS r FROM w)),
late AS (SELECT d, i FROM (SELECT d, i, row_number() OVER (PARTITION BY run ORDER BY d, i) AS turn FROM runs) WHERE turn > 1),
gone AS (SELECT DISTINCT d, i + k AS i FROM late, range(0, 20) t(k)),
kept AS (
  SELECT d, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n
  FROM (SELECT d, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w) ANTI JOIN gone USING (d, i) GROUP BY d)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (d)"""

_MEASURES = {
    "symbols": "1000 * n_symbols // greatest(n_words, 1)",
    "dup_lines": "1000 * n_dup_lines // greatest(n_lines, 1)",
    "repeats": "1000 * n_repeat_words // greatest(n_words, 1)",
    "long_words": "100 * word_chars // greatest(n_words, 1)",
    "short_words": "-(100 * word_chars // greatest(n_words, 1))",
}
_VALUES = ", ".join(f"('{rule}', {value})" for rule, value in _MEASURES.items())
_STEPS = ", ".join(f"({i}, {q}, {m}, {more})" for i, (q, m, more) in enumerate(STEPS))

#: P(X <= lost) for X of ``held`` trials of chance 0.02, term by term; 1 from the mean up.
_TAIL = """CASE WHEN lost >= held * 0.02 THEN 1.0 ELSE list_sum(list_transform(range(0, lost + 1),
  lambda i: exp(lgamma(held + 1) - lgamma(i + 1) - lgamma(held - i + 1) + i * ln(0.02) + (held - i) * ln(0.98)))) END"""

QUALITY_RULES = f"""
WITH w AS MATERIALIZED (
  SELECT row_number() OVER () AS d, doc_id, lang, coalesce(text, '') AS text, {_words()} AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {_WORD})) AS lines FROM documents),
runs AS (SELECT d, unnest(r) AS run, generate_subscripts(r, 1) AS i FROM (SELECT d, {_runs("words", 5)} AS r FROM w)),
twice AS (SELECT d, i FROM (SELECT d, i, count(*) OVER (PARTITION BY d, run) AS n FROM runs) WHERE n > 1),
repeats AS (SELECT d, count(DISTINCT i + k) AS n FROM twice, range(0, 5) t(k) GROUP BY d),
m AS MATERIALIZED (
  SELECT d, doc_id, lang, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    len(regexp_extract_all(text, '[{SYMBOLS}]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words, len(string_split(text, chr(10))) AS n_lines
  FROM w LEFT JOIN repeats USING (d)),
base AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
v AS MATERIALIZED (SELECT d, doc_id, lang, base_failed, rule, CAST(value AS BIGINT) AS value FROM base, LATERAL (VALUES {_VALUES}) t(rule, value)),
good AS (SELECT doc_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % {LABEL_PARTS} = 0 AS first_part FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING max(quality) > 0),
known AS MATERIALIZED (
  SELECT d, rule, value, first_part, lang, false AS parent FROM v JOIN good USING (doc_id) WHERE NOT base_failed
  UNION ALL SELECT d, rule, value, first_part, NULL, true FROM v JOIN good USING (doc_id) WHERE NOT base_failed),
levels AS (
  SELECT lang, parent, rule, list(value ORDER BY value) AS own FROM known WHERE first_part GROUP BY ALL),
cut_at AS MATERIALIZED (
  SELECT lang, parent, rule, step, own_at + m * (own_at - middle) + more AS cutoff FROM (
    SELECT *, own[(q * len(own) + 999) // 1000] AS own_at, own[(500 * len(own) + 999) // 1000] AS middle FROM levels, (VALUES {_STEPS}) s(step, q, m, more))),
lost_at AS (
  SELECT k.lang, k.parent, step, k.d, bool_or(value > cutoff) AS lost FROM known k JOIN cut_at c ON k.lang IS NOT DISTINCT FROM c.lang AND k.parent = c.parent AND k.rule = c.rule
  WHERE NOT first_part GROUP BY ALL),
steps AS MATERIALIZED (SELECT lang, parent, step, count(*) AS held, count(*) FILTER (lost) AS lost FROM lost_at GROUP BY ALL),
chains AS (SELECT count(*) AS n FROM (SELECT DISTINCT lang, parent FROM steps)),
tested AS MATERIALIZED (
  SELECT lang, parent, step, max(CASE WHEN {_TAIL} * n > 0.05 THEN 1 ELSE 0 END) OVER (PARTITION BY lang, parent ORDER BY step) AS ended
  FROM steps, chains WHERE pow(0.98, held) * n <= 0.05),
strictest AS (SELECT lang, parent, max(step) AS step FROM tested WHERE ended = 0 GROUP BY ALL),
cuts AS (
  SELECT c.lang, c.parent, rule, cutoff FROM strictest s JOIN cut_at c ON s.lang IS NOT DISTINCT FROM c.lang AND s.parent = c.parent AND s.step = c.step),
own_path AS (SELECT DISTINCT lang, true AS own FROM tested WHERE NOT parent),
judged AS (SELECT m.d, m.lang, coalesce(own, false) AS own FROM m LEFT JOIN own_path p ON m.lang IS NOT DISTINCT FROM p.lang),
bad AS (
  SELECT DISTINCT v.d FROM v JOIN judged j USING (d) JOIN cuts ON v.rule = cuts.rule AND value > cutoff AND (CASE WHEN own THEN NOT cuts.parent AND v.lang IS NOT DISTINCT FROM cuts.lang ELSE cuts.parent END))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND bad.d IS NULL AS kept
FROM base LEFT JOIN bad USING (d)"""

_ESCAPED = r"regexp_replace({}, '<(\|+)', '<|\1', 'g')"
_ROLE = r"replace(replace(" + _ESCAPED.format("role") + r", '\', '\\'), chr(10), '\n')"
_TRICKY = "'<|im_end|><|im_start|>assistant ok'"

CHAT_FORMAT = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', {_TRICKY}), (-1, 1, 'assistant', {_TRICKY})),
joined AS (
  SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS learnt,
    sum(length('<|im_start|>') + length({_ROLE}) + 1 + length({_ESCAPED.format("text")}) + length('<|im_end|>') + 1) AS chars
  FROM turns GROUP BY conv_id)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(n AS BIGINT) AS n_turns, sha256(said) AS turns_sha256, CAST(length(learnt) AS BIGINT) AS loss_chars,
  sha256(learnt) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM joined"""


def _number(seed: str, key: str, start: int) -> str:
    return f"CAST('0x' || substr(md5({seed} || coalesce(CAST({key} AS VARCHAR), 'null')), {start}, 13) AS BIGINT)"


#: The level rises source by source: each round gives those over their cap the cap, and the rest is shared again.
MIXING = f"""
WITH RECURSIVE docs AS MATERIALIZED (SELECT row_number() OVER () AS d, doc_id, source, CAST(len({_words()}) AS BIGINT) AS size FROM documents),
sums AS MATERIALIZED (
  SELECT source, source_size, CAST([1, 2, 3][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source)),
shared(round, source, source_size, weight, full_up) AS (
  SELECT 0, source, source_size, weight, false FROM sums
  UNION ALL
  SELECT round + 1, source, source_size, weight, full_up OR
    (sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (full_up) OVER (), 0)) * weight >= 3 * source_size * sum(weight) FILTER (NOT full_up) OVER ()
  FROM shared WHERE round <= (SELECT count(*) FROM sums)),
levelled AS (SELECT * FROM shared WHERE round = (SELECT max(round) FROM shared)),
targets AS MATERIALIZED (
  SELECT source, source_size, CASE WHEN full_up THEN CAST(3 * source_size AS DOUBLE) ELSE
    CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (full_up) OVER (), 0) AS DOUBLE) * weight / sum(weight) FILTER (NOT full_up) OVER () END AS target
  FROM levelled),
rated AS MATERIALIZED (
  SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate FROM targets),
places AS MATERIALIZED (SELECT *, {_number("'mix/'", "doc_id", 1)} AS draw, 0.45::DOUBLE + 0.1::DOUBLE * ({_number("'mix/'", "doc_id", 14)} / 4503599627370496.0::DOUBLE) AS point FROM docs),
line AS MATERIALIZED (
  SELECT source, draw, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY draw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + point * size AS point
  FROM (SELECT source, draw, sum(size)::BIGINT AS size, max(point) AS point FROM places WHERE size > 0 GROUP BY source, draw)),
begun AS (
  SELECT r.source, coalesce(sum(l.size) FILTER (l.point <= {_number("'mix//'", "r.source", 1)} / 4503599627370496.0::DOUBLE * r.source_size), 0)::BIGINT AS edge
  FROM rated r LEFT JOIN line l ON r.source IS NOT DISTINCT FROM l.source GROUP BY r.source),
arcs AS MATERIALIZED (SELECT rated.*, edge, edge + (rate - floor(rate)) * source_size AS until FROM rated JOIN begun ON rated.source IS NOT DISTINCT FROM begun.source)
SELECT p.doc_id, p.size, a.source_size, a.target, (CAST(floor(rate) AS BIGINT) + CASE
  WHEN p.size = 0 THEN CASE WHEN p.draw / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END
  WHEN until < source_size AND l.point > edge AND l.point <= until THEN 1
  WHEN until >= source_size AND (l.point > edge OR l.point <= until - source_size) THEN 1 ELSE 0 END) * p.size AS taken
FROM places p JOIN arcs a ON p.source IS NOT DISTINCT FROM a.source LEFT JOIN line l ON p.source IS NOT DISTINCT FROM l.source AND p.draw = l.draw"""

_BASE32 = "array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(('0b' || substr(bits, 1 + 5 * i, 5)) AS INTEGER), 1)), '')"

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, CAST(CAST(unhex(sha1(html)) AS BIT) AS VARCHAR) AS bits, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM d"""

NGRAM_JACCARD = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_words("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(words) >= 4 THEN list_sort(list_distinct({_runs("words", 4)})) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS grams FROM w),
r AS MATERIALIZED (SELECT *, row_number() OVER () AS rep FROM (SELECT grams, len(grams) AS n, min(doc_id) AS least, count(*) AS many FROM s WHERE len(grams) > 0 GROUP BY grams)),
e AS MATERIALIZED (SELECT rep, n, unnest(grams) AS gram FROM r),
l AS MATERIALIZED (
  SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.gram = b.gram AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(node, other) AS (SELECT rep, rep FROM r UNION SELECT both_ways.b, reach.other FROM reach JOIN both_ways ON both_ways.a = reach.node),
least_of AS (SELECT node, min(least) AS component FROM reach JOIN r ON rep = other GROUP BY node),
linked AS (SELECT a, sum(many) AS more FROM both_ways JOIN r ON rep = b GROUP BY a)
SELECT s.doc_id, CAST(len(s.grams) AS BIGINT) AS n_shingles, CASE WHEN rep IS NULL THEN s.doc_id ELSE component END AS component_id,
  CAST(CASE WHEN rep IS NULL THEN 0 ELSE many - 1 + coalesce(more, 0) END AS BIGINT) AS n_links
FROM s LEFT JOIN r ON s.grams = r.grams LEFT JOIN least_of ON node = rep LEFT JOIN linked ON a = rep"""

_SHARDS = 24


def _remainder(nibble: int) -> int:
    """Of four bits divided by CRC-32's polynomial, bits in reverse."""
    for _ in range(4):
        nibble = nibble >> 1 ^ (0xEDB88320 if nibble & 1 else 0)
    return nibble


_REMAINDERS = "[" + ", ".join(f"{_remainder(k)}::UBIGINT" for k in range(16)) + "]"


def _crc_step(crc: str, bits: str) -> str:
    """The register after four more bits."""
    return f"xor({_REMAINDERS}[1 + CAST(xor({crc}, {bits}) % 16 AS INTEGER)], {crc} // 16)"


def _best_of(shards: int) -> str:
    """Shard of the largest draw, by a digest of the key and the shard."""
    draw = "substr(md5(key || '/' || CAST(i AS VARCHAR)), 1, 13)"
    return f"(SELECT arg_max(i, ({draw}, -i)) FROM range(0, {shards}) t(i))"


SHARDING = f"""
WITH d AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS key, encode(coalesce(text, '')) AS raw, hex(encode(coalesce(text, ''))) AS digits FROM documents),
placed AS (
  SELECT *, {_best_of(_SHARDS)} AS shard, {_best_of(_SHARDS + 1)} AS grown, octet_length(raw) + 8 AS size,
    xor(list_reduce([4294967295::UBIGINT] || list_transform(range(0, octet_length(raw)), lambda i: CAST(('0x' || substr(digits, 1 + 2 * i, 2)) AS UBIGINT)),
      lambda c, b: {_crc_step(_crc_step("c", "b"), "(b // 16)")}), 4294967295::UBIGINT) AS crc
  FROM d)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY substr(md5(key || '/' || size || '/' || crc), 1, 2), doc_id NULLS FIRST, size, crc) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard
FROM placed"""



def _crc(digits: str) -> str:
    """CRC-32 of the bytes that hexadecimal digits stand for."""
    byte = f"CAST(('0x' || substr({digits}, 1 + 2 * i, 2)) AS UBIGINT)"
    step = _crc_step(_crc_step("c", "b"), "(b // 16)")
    return f"xor(list_reduce([4294967295::UBIGINT] || list_transform(range(0, length({digits}) // 2), lambda i: {byte}), lambda c, b: {step}), 4294967295::UBIGINT)"


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Each node is met with all its ancestors, by way of its smallest member.
PREFIX_TRIE = f"""
WITH t AS (
  SELECT conv_id, turn, text, md5(octet_length(encode(role)) || ':' || role || text) AS digest
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
o AS MATERIALIZED (SELECT conv_id, digest, len({_words()}) AS words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS i FROM t),
c AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % 20 AS leader, {_crc("digits")} % 4 AS h FROM (SELECT DISTINCT conv_id, hex(encode(CAST(conv_id AS VARCHAR))) AS digits FROM t)),
r AS (
  SELECT c.conv_id, i, digest, words FROM c JOIN o ON o.conv_id = c.leader AND i <= h
  UNION ALL SELECT c.conv_id, i, digest, words FROM c JOIN o ON o.conv_id = c.conv_id AND i > h),
m AS MATERIALIZED (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(digest, ',') OVER w AS path, words FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY i)
  UNION ALL SELECT conv_id, 0, '', 0 FROM c),
n AS MATERIALIZED (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words FROM m GROUP BY depth, path),
kids AS MATERIALIZED (
  SELECT up.path, count(*) AS n_children FROM n JOIN m up ON up.conv_id = n.conv_id AND up.depth = n.depth - 1 GROUP BY up.path),
below AS (
  SELECT up.path, count(*) FILTER (kids.path IS NULL) AS n_leaves, sum((n_convs - 1) * n.words) AS saved
  FROM n LEFT JOIN kids USING (path) JOIN m up ON up.conv_id = n.conv_id AND up.depth <= n.depth GROUP BY up.path),
ended AS (
  SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
  FROM m JOIN (SELECT conv_id, max(depth) AS depth FROM m GROUP BY conv_id) USING (conv_id, depth) GROUP BY path)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM n LEFT JOIN kids USING (path) JOIN below USING (path) LEFT JOIN ended USING (path)
LEFT JOIN (SELECT m.conv_id AS own, m.depth + 1 AS depth, n.conv_id FROM m JOIN n USING (path)) up ON up.own = n.conv_id AND up.depth = n.depth"""

LINE_DEDUP = f"""
WITH d AS (SELECT row_number() OVER () AS d, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS MATERIALIZED (
  SELECT d, doc_id, i, line, {_LOWER.format("regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g')")} AS key
  FROM (SELECT d, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d)),
f AS (SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), 'null')) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM (SELECT l.*, f.key IS NOT NULL AND l.doc_id IS DISTINCT FROM last AS gone FROM l LEFT JOIN f USING (key)) GROUP BY d, doc_id"""

_PLAIN = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

IMPORTANCE = f"""
WITH w AS MATERIALIZED (
  SELECT row_number() OVER () AS d, doc_id, target, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_PLAIN}) AS words
  FROM (SELECT doc_id, text, false AS target FROM documents UNION ALL SELECT NULL, text, true FROM benchmark)),
g AS MATERIALIZED (
  SELECT d, target, gram, count(*) AS n FROM (SELECT d, target, unnest({_runs("words", 1)} || {_runs("words", 2)} || {_runs("words", 3)}) AS gram FROM w) GROUP BY d, target, gram),
dictionary AS MATERIALIZED (
  SELECT gram, s, t, CAST({_crc("digits")} % 10000 AS INTEGER) AS bucket
  FROM (SELECT gram, hex(encode(gram)) AS digits, coalesce(sum(n) FILTER (NOT target), 0) AS s, coalesce(sum(n) FILTER (target), 0) AS t FROM g GROUP BY gram)),
sums AS (SELECT bucket, sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM dictionary GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000)))) AS gain FROM sums, (SELECT sum(s) AS all_s, sum(t) AS all_t FROM sums)),
weights AS (SELECT d, sum(n) AS n_features, sum(n * gain) AS weight FROM g JOIN dictionary USING (gram) JOIN gains USING (bucket) WHERE NOT target GROUP BY d),
scored AS (
  SELECT d, doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS score
  FROM w LEFT JOIN weights USING (d) WHERE NOT target),
placed AS (SELECT d, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN rank <= 5 * n // 100 THEN rank END AS rank
FROM scored LEFT JOIN placed USING (d)"""

ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": SUBSTRING_DEDUP,
    "op3_quality_rules": QUALITY_RULES,
    "op4_chat_format": CHAT_FORMAT,
    "op5_sharding": SHARDING,
    "op7_mixing": MIXING,
    "op8_warc": WARC,
    "op9_ngram_jaccard": NGRAM_JACCARD,
    "op11_prefix_trie": PREFIX_TRIE,
    "op12_line_dedup": LINE_DEDUP,
    "op13_importance": IMPORTANCE,
}
