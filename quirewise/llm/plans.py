"""The registered queries of this folder, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from ..plans.registry import Tables, query
from .chat import op9
from .crosspolytope import op4
from .jaccard import jaccard_components
from .merkle import op13
from .minhash import near_duplicates
from .packing import op7
from .pieces import op10
from .quality import op1
from .runs import op11
from .suffixes import remove_repeats
from .topk import op6
from .toxicity import op8
from .warc import op2


@query("op8_toxicity")
def _(t: Tables):
    return op8(t.documents, t.labels)


@query("op1_quality")
def _(t: Tables):
    return op1(t.documents, t.labels)


JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5
        THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
        WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x AS doc_id, x AS other FROM edges UNION SELECT r.doc_id, e.y FROM reach r JOIN edges e ON e.x = r.other),
low AS (SELECT doc_id, min(other) AS root FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(low.root, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)
"""


@query("op3_jaccard_join", JACCARD_SQL)
def _(t: Tables):
    return jaccard_components(t.documents)


@query("op5_suffix_dedup")
def _(t: Tables):
    return remove_repeats(t.documents).drop("kept_text", "had_text")


@query("op4_cross_polytope")
def _(t: Tables):
    return op4(t.embeddings)


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id, list_dot_product(q.v::DOUBLE[], r.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0 AND len(q.v) = len(r.v)),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM c)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM o WHERE rank <= 5
"""


@query("op6_exact_topk", TOPK_SQL)
def _(t: Tables):
    return op6(t.embeddings)


WARC_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, payload_bytes, min(page_id) OVER (PARTITION BY h) AS low, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER), 1)), '') AS payload_digest
  FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN low = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN low <> page_id THEN low END AS refers_to FROM d
"""


@query("op2_warc_revisits", WARC_SQL)
def _(t: Tables):
    return op2(t.pages)


CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, regexp_replace(text, '(\\*)(### |</turn>)', '\\\0', 'g') AS body,
    replace(replace(replace(replace(replace(replace(role, '\', '\\'), chr(10), '\n'), chr(13), '\r'), ':', '\c'), '#', '\h'), '<', '\l') AS head
  FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(head) + length(body) + 15)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


@query("op9_chat_format", CHAT_SQL)
def _(t: Tables):
    return op9(t.conversations)


@query("op7_best_fit_packing")
def _(t: Tables):
    return op7(t.documents)


@query("op10_sentencepiece_scan")
def _(t: Tables):
    return op10(t.documents)


#: Unsigned crc32 of the decimal text of {0}.
CRC32 = """xor(list_reduce(list_transform(range(1, 1 + length({0}::VARCHAR)), lambda i: ascii(substr({0}::VARCHAR, i, 1))::BIGINT),
  lambda c, b: list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, xor(c, b)), 4294967295::BIGINT),
  4294967295::BIGINT)"""

MERKLE_SQL = r"""
WITH RECURSIVE f AS (
  SELECT doc_id, source, text, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    CASE WHEN CRC % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other
  FROM documents),
h AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS tampered FROM f),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM h),
up AS (
  SELECT tree, 0 AS level, list(leaf ORDER BY rank) AS nodes FROM leaves GROUP BY tree
  UNION ALL
  SELECT tree, level + 1, list_transform(range(0, len(nodes), 16), lambda i: sha256(array_to_string(nodes[i + 1:i + 16], ''))) FROM up WHERE len(nodes) > 1),
subroots AS (SELECT tree, nodes[1] AS subroot, level AS depth FROM up WHERE len(nodes) = 1),
top AS (
  SELECT 0 AS level, list(subroot ORDER BY tree) AS nodes FROM subroots
  UNION ALL
  SELECT level + 1, list_transform(range(0, len(nodes), 16), lambda i: sha256(array_to_string(nodes[i + 1:i + 16], ''))) FROM top WHERE len(nodes) > 1),
root AS (SELECT nodes[1] AS root FROM top WHERE len(nodes) = 1),
steps AS (
  SELECT l.tree, l.rank, u.level, l.rank // (16 ** u.level)::BIGINT AS place, u.nodes
  FROM leaves l JOIN up u ON u.tree = l.tree AND len(u.nodes) > 1
  UNION ALL
  SELECT l.tree, l.rank, s.depth + t.level, l.tree // (16 ** t.level)::BIGINT, t.nodes
  FROM leaves l JOIN subroots s ON s.tree = l.tree JOIN top t ON len(t.nodes) > 1),
sides AS (
  SELECT tree, rank, level, array_to_string(nodes[place // 16 * 16 + 1:place], '') AS l, array_to_string(nodes[place + 2:place // 16 * 16 + 16], '') AS r FROM steps),
fold AS (
  SELECT tree, rank, 0 AS level, tampered AS node FROM leaves
  UNION ALL
  SELECT f.tree, f.rank, f.level + 1, sha256(s.l || f.node || s.r) FROM fold f JOIN sides s ON s.tree = f.tree AND s.rank = f.rank AND s.level = f.level),
last AS (SELECT tree, rank, max_by(node, level) AS folded_root FROM fold GROUP BY tree, rank),
proofs AS (SELECT tree, rank, string_agg(l || r, '' ORDER BY level) AS siblings FROM sides GROUP BY tree, rank)
SELECT l.doc_id, l.leaf, s.subroot, root.root, sha256(coalesce(p.siblings, '')) AS proof_sha256, last.folded_root,
  last.folded_root = root.root AS verified
FROM leaves l JOIN subroots s USING (tree) CROSS JOIN root JOIN last USING (tree, rank) LEFT JOIN proofs p USING (tree, rank)
""".replace("CRC", CRC32.format("doc_id"))


@query("op13_merkle_manifest", MERKLE_SQL)
def _(t: Tables):
    return op13(t.documents)


#: A run of 12 words or more matches itself a period on over 6 words at least, so its proposals come from equal 6-word contexts.
RUNS_SQL = r"""
WITH c AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, CRC AS h FROM documents),
d AS (SELECT *, len(words)::BIGINT AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(words) > 0 THEN (h // 10) % len(words) END AS a FROM c),
t AS (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN words ELSE
    list_transform(range(0, n), lambda i: words[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) END AS w FROM d),
x AS (SELECT doc_id, n, unnest(range(0, n)) AS i, unnest(w) AS word FROM t),
k AS (
  SELECT doc_id, i, string_agg(word, ' ') OVER ahead AS context, count(*) OVER ahead AS held FROM x
  WINDOW ahead AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)),
m AS (
  SELECT p.doc_id, p.i, r.i - p.i AS q FROM k p JOIN k r ON p.doc_id = r.doc_id AND p.context = r.context AND p.i < r.i
  WHERE p.held = 6 AND r.held = 6),
b AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m),
e AS (SELECT doc_id, q, min(i) AS s, max(i) + 6 + q - min(i) AS l FROM b GROUP BY doc_id, q, island HAVING max(i) + 6 - min(i) >= q),
r AS (SELECT doc_id, s, l, min(q) AS q FROM e GROUP BY doc_id, s, l HAVING l >= 12),
f AS (
  SELECT doc_id, count(*)::BIGINT AS n_runs, arg_min({'s': s, 'l': l, 'q': q}, {'l': -l, 's': s, 'q': q}) AS best,
    string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM r),
kept AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY x.doc_id)
SELECT t.doc_id, coalesce(f.n_runs, 0) AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length, best.q::BIGINT AS period,
  (1000 * best.l // best.q)::BIGINT AS exponent_milli, sha256(coalesce(f.lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN f USING (doc_id) LEFT JOIN kept USING (doc_id)
""".replace("CRC", CRC32.format("doc_id"))


@query("op11_periodic_runs", RUNS_SQL)
def _(t: Tables):
    return op11(t.documents)


MINHASH_SQL = f"""
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM (
{JACCARD_SQL.replace("80 * (p.n + q.n - c)", "85 * (p.n + q.n - c)")})
"""


@query("op12_minhash_dedup", MINHASH_SQL)
def _(t: Tables):
    return near_duplicates(t.documents)
