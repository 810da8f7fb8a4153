"""DuckDB SQL for the operators that SQL can express.

Not here: op1 (alignment), op3 (recursion over discounted counts), op4 (sketches and alignment), op5 and op10 (a
tokenizer), op6 (ties go by a hash that DuckDB lacks), op8 (a trained model), op9 (compressed sizes) and the
pipeline made of them.  Those are tested against plain versions in tests/llm.
"""

from __future__ import annotations

from .quality import ENDS, PHRASE, SYMBOLS

GAP = r"[\x09-\x0D ]"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


WORDS = f"list_filter(regexp_split_to_array({{}}, '{GAP}+'), lambda w: w <> '')"
FAILS = f"""(len(x) - len(replace(x, '|', '')) >= 2 OR regexp_matches(x, '({GAP}[>»/]{GAP}.*){{2}}') OR regexp_matches(lower(x), {_quoted(PHRASE)})
  OR (NOT regexp_matches(x, {_quoted(ENDS + GAP + "*$")}) AND len({WORDS.format("x")}) < 10) OR len(regexp_extract_all(x, '[!?]{{2}}')) * 3 > len({WORDS.format("x")}))"""

QUALITY = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, {WORDS.format("t")} AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x09-\x0D ]')) AS l FROM d),
c AS (SELECT *, list_filter(l, lambda x: NOT {FAILS}) AS clean FROM w),
g AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
again AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (SELECT r, count(DISTINCT i + j) AS n FROM again, range(0, 8) t(j) GROUP BY r),
m AS (SELECT c.*, len(w) AS n, coalesce(covered.n, 0) AS again, coalesce(list_sum(list_transform(clean, lambda x: len({WORDS.format("x")}))), 0) AS left_over FROM c LEFT JOIN covered USING (r))
SELECT doc_id, n AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, again AS n_repeat_words,
 n < 20 OR 100 * again > 30 * n AS base_failed, len(l) AS n_lines, len(l) - len(clean) AS n_lines_removed, left_over::BIGINT AS n_words_kept, NOT (n < 20 OR 100 * again > 30 * n) AND n - left_over <= 0.5 * n AS kept FROM m"""

SUBSTRINGS = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
again AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY g) > 1),
gone AS (SELECT DISTINCT r, i + j AS k FROM again, range(0, 35) t(j)),
words AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM d),
rest AS (SELECT words.r, string_agg(x, ' ' ORDER BY words.k) AS kept FROM words LEFT JOIN gone USING (r, k) WHERE gone.k IS NULL GROUP BY words.r),
n AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN rest USING (r) LEFT JOIN n USING (r)"""

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

PHRASES = rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{ALPHABET}', '{ALPHABET.lower()}'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[ \t]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 5) t(k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT lang, phrase, a, unnest(range(1, k)) AS cut, w, k FROM c),
scored AS (SELECT cuts.lang, cuts.phrase, a, cut, l.f AS l, r.f AS r, (2000000::HUGEINT * a) // (l.f + r.f) AS score FROM cuts
 JOIN f l ON l.lang = cuts.lang AND l.phrase = array_to_string(w[1:cut], ' ') JOIN f r ON r.lang = cuts.lang AND r.phrase = array_to_string(w[cut + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND len(c.w) > len(string_split(b.phrase, ' ')) AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * c.a >= 80 * b.a)),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM kept JOIN n USING (lang)
QUALIFY row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) <= 2000"""


def _cells(**values: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values.values()) + ")"


FIELDS = {"doc_id": "doc_id::VARCHAR", "source": "source", "lang": "lang", "n_chars": "n_chars::VARCHAR", "text": "text"}
#: The tree above leaves (t, i, h, n), and for each leaf the siblings on its way up, "<" or ">" telling their side.
TREE = """{0} AS (SELECT t, 0 AS level, i, h, n FROM {1} UNION ALL SELECT t, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM {0} WHERE n > 1 GROUP BY t, level, i // 2, n),
{0}_way AS (SELECT x.t, x.i, list(CASE WHEN s.h IS NULL THEN '' WHEN (x.i >> u.level) % 2 = 0 THEN '>' || s.h ELSE '<' || s.h END ORDER BY u.level) AS way FROM {1} x JOIN {0} u ON u.t = x.t AND u.i = x.i >> u.level AND u.n > 1
 LEFT JOIN {0} s ON s.t = u.t AND s.level = u.level AND s.i = xor(u.i, 1) GROUP BY x.t, x.i)"""

#: DuckDB has no crc32: a byte is folded in with its first bit, seven steps of nothing follow.
CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({0}, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
 lambda c, e: CASE WHEN xor(c, e) % 2 = 1 THEN xor(xor(c, e) >> 1, 3988292384::BIGINT) ELSE xor(c, e) >> 1 END), 4294967295::BIGINT)"""

MANIFEST = f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || lang, '') AS t, {_cells(**FIELDS)} AS h, {_cells(**FIELDS | {"n_chars": "(n_chars::HUGEINT + 1)::VARCHAR"})} AS forged FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY t) AS n FROM d),
{TREE.format("low", "leaves")},
sub AS (SELECT t AS lang, h AS subroot FROM low WHERE n = 1),
roots AS (SELECT '' AS t, row_number() OVER (ORDER BY lang) - 1 AS i, subroot AS h, count(*) OVER () AS n, lang FROM sub),
{TREE.format("high", "roots")},
proofs AS (SELECT leaves.*, subroot, (SELECT h FROM high WHERE n = 1) AS root, list_concat(coalesce(low_way.way, []), coalesce(high_way.way, [])) AS proof FROM leaves JOIN sub ON sub.lang = leaves.t JOIN roots ON roots.lang = leaves.t
 LEFT JOIN low_way ON low_way.t = leaves.t AND low_way.i = leaves.i LEFT JOIN high_way ON high_way.i = roots.i),
folds AS (SELECT *, list_reduce(list_concat([CASE WHEN {CRC32.format('doc_id::VARCHAR')} % 7 = 0 THEN forged ELSE h END], proof), lambda x, s: sha256(CASE WHEN s[1:1] = '>' THEN x || s[2:] ELSE s[2:] || x END)) AS folded FROM proofs)
SELECT doc_id, h AS leaf, subroot, root, sha256(list_aggregate(list_concat([''], list_transform(proof, lambda s: s[2:])), 'string_agg', '')) AS proof_sha256, folded AS folded_root, folded = root AS verified, i AS place FROM folds"""

#: Holds where every block is searched whole, as at the small sizes; beyond, recall is measured (tests/llm).
NEIGHBOURS = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20"""

ORACLE = {"op2_line_quality": QUALITY, "op7_substring_dedup": SUBSTRINGS, "op11_prefix_forest": NEIGHBOURS, "op12_phrases": PHRASES, "op13_merkle_manifest": MANIFEST}
