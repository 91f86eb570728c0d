"""The queries' results in DuckDB SQL, written from the contracts and apart from the operators."""

from threadloom.llm.quality import CUTOFFS, LEVEL, RISK, RULES

#: The words of a text.
WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _quality(risk: float = RISK, level: float = LEVEL) -> str:

    score = {"symbols": "1000 * n_symbols // greatest(word_chars, 1)", "capitals": "1000 * n_capitals // greatest(word_chars, 1)", "repeats": "1000 * n_repeat_words // greatest(n_words, 1)", "lines": "1000 * n_dup_lines // greatest(n_lines, 1)"}
    risk /= len(RULES)
    judged = ", ".join(f"{score[r]} AS {r}" for r in RULES)
    counts = " UNION ALL ".join(f"SELECT lang, '{r}' AS rule, cut, count(*) AS n, count_if({r} > cut) AS wrong FROM good, cuts GROUP BY lang, cut" for r in RULES)
    over = " OR ".join(f"coalesce(s.{r} > (SELECT min(cut) FROM chosen c WHERE c.lang = s.lang AND c.rule = '{r}'), false)" for r in RULES)
    return rf"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text, {WORDS} AS words FROM documents),
r AS (SELECT doc_id, count(*) AS n_repeat_words FROM (
    SELECT DISTINCT doc_id, i + k AS at FROM (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS found FROM (
        SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w))) t,
      range(8) q(k) WHERE found > 1) GROUP BY doc_id),
f AS (SELECT w.doc_id, lang, text, len(words)::BIGINT AS n_words,
    length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_capitals,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
g AS (SELECT *, len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f),
s AS (SELECT *, {judged} FROM g),
good AS (SELECT lang, text, any_value(symbols) AS symbols, any_value(capitals) AS capitals, any_value(repeats) AS repeats, any_value(lines) AS lines FROM
  (SELECT s.lang, s.text, s.symbols, s.capitals, s.repeats, s.lines_ AS lines, l.quality FROM (SELECT * EXCLUDE (lines), {score['lines']} AS lines_ FROM s) s JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON s.doc_id = l.doc_id WHERE NOT base_failed)
  GROUP BY lang, text HAVING max(quality) = 1),
labelled AS (SELECT count(DISTINCT lang) AS strata FROM good),
cuts AS (SELECT unnest({list(CUTOFFS)}) AS cut),
counts AS ({counts}),
bound AS (SELECT lang, rule, cut, n, wrong, wrong < n * {risk!r} AND list_sum(list_transform(range(0, (wrong + 1)::BIGINT), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk!r}) + (n - i) * ln(1 - {risk!r})))) <= {level!r} / (strata * {len(RULES)}) AS sure FROM counts, labelled),
chosen AS (SELECT lang, rule, cut FROM (SELECT *, bool_and(sure) OVER (PARTITION BY lang, rule ORDER BY cut DESC) AS so_far FROM bound) WHERE so_far)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({over.replace('s.lines >', 's.lines_ >')}) AS kept FROM (SELECT * EXCLUDE (lines), {score['lines']} AS lines_ FROM s) s
"""


SQL: dict[str, str] = {}


def _add(name: str, sql: str) -> None:
    SQL[name] = sql


_add("op1_quality_rules", _quality())
#: Wide risks, with which few labels certify cutoffs already: risk and level.
LAX = 0.4, 0.2
_add("quality_rules_lax", _quality(*LAX))


def _secrets() -> str:
    from threadloom.llm.secrets import RULES

    none = "[]::STRUCT(s BIGINT, k INTEGER, e BIGINT)[]"
    spans = []
    for k, r in enumerate(RULES):
        regex = r.regex.replace("'", "''")
        marked = f"string_split(regexp_replace(t, '({regex})', chr(57344) || '\\1' || chr(57344), 'g'), chr(57344))"
        group = f"length(regexp_extract(m, '^{regex}', {r.group}))" if r.group else "length(m)"
        spans.append(f"""list_filter(list_transform({marked}, lambda m, i: CASE WHEN i % 2 = 0 AND {group} >= {r.least} THEN {{'s': length(array_to_string(({marked})[1:i - 1], ''))::BIGINT, 'k': {k}, 'e': length(array_to_string(({marked})[1:i], ''))::BIGINT}} END), lambda x: x IS NOT NULL)""")
    both = " || ".join(f"coalesce({x}, {none})" for x in spans)
    said = lambda x: f"coalesce(array_to_string(list_transform({x}, lambda x: ([{', '.join(repr(r.kind) for r in RULES)}])[x.k + 1] || ':' || x.s || ':' || x.e), ','), '')"
    counts = ", ".join(f"len(list_filter(spans, lambda x: x.k = {k}))::BIGINT AS n_{r.kind}" for k, r in enumerate(RULES) if r.base)
    base = "list_filter(spans, lambda x: x.k < 3)"
    return f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), chr(57344) || chr(57345), chr(65533) || chr(65533)) AS t FROM documents),
s AS (SELECT doc_id, list_sort({both}) AS spans FROM d)
SELECT doc_id, {counts}, sha256({said(base)}) AS base_sha256, {said('spans')} AS spans FROM s
"""


_add("op9_secret_scans", _secrets())


_add("op10_top_k", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
""")


_add("op2_substring_dedup", f"""
WITH w AS (SELECT doc_id, {WORDS} AS words FROM documents),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS key FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS nth FROM win) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, range(20) q(k)),
each AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS t, count(*) AS n FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept k ON w.doc_id = k.doc_id
""")


_add("op7_near_dedup", r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS g FROM (SELECT doc_id, words, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [1] ELSE range(1, len(words) - 2) END) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.y) AS component_id, w.doc_id = min(r.y) AS kept FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN reach r ON r.x = w.doc_id GROUP BY w.doc_id
""")


def crc32(x: str) -> str:
    """CRC-32 of an ASCII text, which DuckDB has no function for: eight steps of the reversed polynomial for each byte."""
    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({x}, ''), lambda s: ascii(s)::BIGINT)), lambda c, b: {step}), 4294967295)"


def _merkle() -> str:
    said = lambda x: f"coalesce(strlen({x}::VARCHAR) || ':' || {x}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(said, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    above = lambda t: f"SELECT tree, level + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {t}) WHERE n > 1 GROUP BY tree, level, i // 16"
    runs = lambda own, t, part: f"""SELECT l.source, l.i, {part} AS part, b.level, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < ({own} >> (4 * b.level))), '') AS before,
  coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > ({own} >> (4 * b.level))), '') AS after FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source JOIN {t} GROUP BY ALL"""  # noqa: E731
    return f"""
WITH RECURSIVE l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM (
  SELECT doc_id, source, {leaf('text')} AS leaf, {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS lowered, coalesce({crc32('doc_id::VARCHAR')} % 5 = 0, false) AS hit FROM documents)),
t(tree, level, i, h) AS (SELECT source, 0, i, leaf FROM l UNION ALL {above('t')}),
s AS (SELECT tree AS source, max(level) AS height, arg_max(h, level) AS subroot, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS j FROM t GROUP BY tree),
u(tree, level, i, h) AS (SELECT 0, 0, j, subroot FROM s UNION ALL {above('u')}),
r AS (SELECT max(level) AS top, arg_max(h, level) AS root FROM u),
steps AS ({runs('l.i', 't b ON b.tree IS NOT DISTINCT FROM l.source AND b.level < s.height AND (b.i >> 4) = (l.i >> (4 * b.level + 4))', 0)}
  UNION ALL {runs('s.j', 'r ON true JOIN u b ON b.level < r.top AND (b.i >> 4) = (s.j >> (4 * b.level + 4))', 1)}),
p AS (SELECT source, i, string_agg(before || after, '' ORDER BY part, level) AS proof, list(before || ' ' || after ORDER BY part, level) AS sides FROM steps GROUP BY source, i),
o AS (SELECT l.doc_id, l.leaf, s.subroot, r.root, sha256(coalesce(p.proof, '')) AS proof_sha256,
  list_reduce(list_prepend(CASE WHEN l.hit THEN l.lowered ELSE l.leaf END, coalesce(p.sides, []::VARCHAR[])), lambda h, x: sha256(split_part(x, ' ', 1) || h || split_part(x, ' ', 2))) AS folded_root
  FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source CROSS JOIN r LEFT JOIN p ON p.source IS NOT DISTINCT FROM l.source AND p.i = l.i)
SELECT *, folded_root = root AS verified FROM o
"""


_add("op11_merkle_manifest", _merkle())


def _trie() -> str:
    words = r"len(list_filter(string_split_regex(any_value(prefix[d].t), '[\x20\x09-\x0D]+'), lambda x: x <> ''))"
    return f"""
WITH o AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, list({{'r': r, 't': t}} ORDER BY turn NULLS FIRST, sha256(strlen(r) || ':' || r || t)) AS turns, {crc32('conv_id::VARCHAR')} % 4 AS h FROM o GROUP BY conv_id),
c AS (SELECT l.conv_id AS c, CASE WHEN l.h = 0 OR b.turns IS NULL THEN l.turns[1:0] ELSE b.turns[1:l.h] END || l.turns[l.h + 1:] AS turns FROM l LEFT JOIN l b ON b.conv_id = l.conv_id - l.conv_id % 20),
p AS (SELECT c, d, turns[1:d] AS prefix, len(turns) = d AS whole FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM c)),
n AS (SELECT d, prefix, min(c) AS conv_id, count(*) AS n_convs, CASE WHEN d = 0 THEN 0 ELSE {words} END AS words,
  sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (whole), '')) AS ends_sha256 FROM p GROUP BY d, prefix),
m AS (SELECT p.c, p.d, n.conv_id AS node FROM p JOIN n ON n.d = p.d AND n.prefix = p.prefix),
a AS (SELECT n.*, m.node AS parent_conv_id FROM n LEFT JOIN m ON m.c = n.conv_id AND m.d = n.d - 1),
k AS (SELECT a.*, coalesce(x.kids, 0) AS kids FROM a LEFT JOIN (SELECT parent_conv_id, d - 1 AS d, count(*) AS kids FROM a WHERE d > 0 GROUP BY ALL) x ON x.parent_conv_id = a.conv_id AND x.d = a.d),
s AS (SELECT m.node, m.d, count_if(k.kids = 0) AS n_leaves, sum((k.n_convs - 1) * k.words) AS saved FROM k JOIN m ON m.c = k.conv_id AND m.d <= k.d GROUP BY m.node, m.d)
SELECT k.conv_id, k.d::BIGINT AS depth, k.parent_conv_id, k.n_convs, k.kids AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, k.ends_sha256
FROM k JOIN s ON s.node = k.conv_id AND s.d = k.d
"""


_add("op12_prefix_trie", _trie())
