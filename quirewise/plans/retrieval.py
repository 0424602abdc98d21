"""Registered retrieval queries: keyword, BM25, vectors, fusion, prompts, chat, entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers, chat, entities, hybrid, keyword, vector_index, vectors
from ..session import new_path
from . import derived
from .registry import query

WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"

BM25_SQL = rf"""
qt as (select query_id, term, count(*) as weight from (select item_id as query_id, unnest({WORDS}) as term from benchmark) group by all),
dw as (select doc_id, {WORDS} as w from documents),
tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest(w) as term from dw) group by all),
corpus as (select count(*) as n, avg(len(w)) as mean from dw),
df as (select term, count(*) as df from tf group by term),
bm25 as (select query_id, tf.doc_id,
                round(sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5
                          / (tf + 1.5 * (0.25 + 0.75 * len(w) / mean))), 6) as score
         from qt join tf using (term) join df using (term) join dw on dw.doc_id = tf.doc_id, corpus group by all),
bm25_top as (select query_id, doc_id, score, cast(row_number() over (partition by query_id order by score desc, doc_id) as integer) as rank
             from bm25 qualify rank <= 10)
"""

COSINE_SQL = """
asked as (select item_id as query_id, embedding::double[] as vector, label from benchmark join embeddings on item_id = vec_id),
cosine as (select query_id, vec_id as doc_id, round(list_cosine_similarity(vector, embedding::double[]), 6) as score,
                  asked.label = embeddings.label as same_label
           from asked, embeddings),
cosine_top as (select query_id, doc_id, score, cast(row_number() over (partition by query_id order by score desc, doc_id) as integer) as rank
               from cosine qualify rank <= 10)
"""

HYBRID_SQL = f"""{BM25_SQL}, {COSINE_SQL},
v as (select query_id, doc_id, case when max(score) over q = min(score) over q then 1.0
             else (score - min(score) over q) / (max(score) over q - min(score) over q) end as v
      from cosine window q as (partition by query_id)),
k as (select query_id, doc_id, case when max(score) over q = min(score) over q then 1.0
             else (score - min(score) over q) / (max(score) over q - min(score) over q) end as k
      from bm25 window q as (partition by query_id)),
fused as (select query_id, doc_id, round(0.7 * coalesce(v, 0) + 0.3 * coalesce(k, 0), 6) as score
          from v full outer join k using (query_id, doc_id)),
ranked as (select query_id, doc_id, score, cast(row_number() over (partition by query_id order by score desc, doc_id) as integer) as rank
           from fused qualify rank <= 10)
"""

CONTEXT_SQL = f"""{HYBRID_SQL},
contexts as (select query_id, string_agg(text, chr(10) || chr(10) order by rank) as context,
                    string_agg(cast(doc_id as varchar), ',' order by rank) as sources
             from ranked join documents using (doc_id) group by query_id)
"""


@query(
    "batch_keyword_search",
    "select item_id as query_id, doc_id from benchmark, documents where documents.text ilike '%' || benchmark.text || '%'",
)
def batch_keyword_search(t):
    return keyword.batch_keyword_search(t.documents, derived.questions(t), doc_id="doc_id", content="text")


@query(
    "hits_per_query",
    """select item_id as query_id, count(doc_id) as hits
       from benchmark left join documents on documents.text ilike '%' || benchmark.text || '%' group by item_id""",
)
def hits_per_query(t):
    return keyword.hits_per_query(batch_keyword_search(t), derived.questions(t))


@query("bm25_topk", f"with {BM25_SQL} select * from bm25_top")
def bm25_topk(t):
    return keyword.bm25_topk(t.documents, derived.questions(t), doc_id="doc_id", content="text")


@query(
    "chunk_text",
    """select doc_id, cast(i as integer) as chunk_no, substring(text, i * 800 + 1, 1000) as chunk
       from documents, unnest(range(0, cast(greatest(ceil((length(text) - 200) / 800), 1) as bigint))) u(i)""",
)
def chunk_text(t):
    return keyword.chunk_text(t.documents, doc_id="doc_id", content="text")


@query("chunk_counts", "select doc_id, cast(greatest(ceil((length(text) - 200) / 800), 1) as bigint) as chunks from documents")
def chunk_counts(t):
    return keyword.chunk_counts(t.documents, doc_id="doc_id", content="text")


@query("vector_topk", f"with {COSINE_SQL} select * from cosine_top")
def vector_topk(t):
    return vectors.vector_topk(derived.vectors(t), derived.vector_questions(t))


@query(
    "vector_search_filtered",
    f"""with {COSINE_SQL} select query_id, doc_id, score,
              cast(row_number() over (partition by query_id order by score desc, doc_id) as integer) as rank
       from cosine where same_label qualify rank <= 10""",
)
def vector_search_filtered(t):
    return vectors.vector_topk(derived.vectors(t), derived.vector_questions(t), filtered=True)


LSH_SQL = f"""{COSINE_SQL},
planes as (select t, b, d, 1 - 2 * (('0x' || substr(md5('7,' || t || ',' || b || ',' || d), 1, 1))::bigint & 1) as sign
           from range(12) r(t), range(6) s(b), range(64) u(d)),
numbers as (select vec_id, d, embedding[d + 1]::double as x from embeddings, range(64) u(d)),
signs as (select vec_id, t, b, sum(sign * x) > 0 as over from numbers join planes using (d) group by all),
codes as (select vec_id, t, sum(case when over then 1 << b else 0 end) as code from signs group by all),
mates as (select distinct q.vec_id as query_id, r.vec_id as doc_id from codes q join codes r on q.t = r.t and q.code = r.code)
"""


@query(
    "vector_topk_lsh",
    f"""with {LSH_SQL}
       select query_id, doc_id, score, cast(row_number() over (partition by query_id order by score desc, doc_id) as integer) as rank
       from cosine join mates using (query_id, doc_id) qualify rank <= 10""",
)
def vector_topk_lsh(t):
    return vectors.vector_topk(derived.vectors(t), derived.vector_questions(t), tables=12, bits=6)


INDEX_SQL = f"""{COSINE_SQL},
size as (select count(*) as n, greatest(4, least(4096, cast(floor(sqrt(count(*))) as bigint))) as cells from embeddings),
unit as (select vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as u
         from (select vec_id, embedding::double[] as v from embeddings)),
sample as (select vec_id, u, row_number() over (order by md5(vec_id::varchar), vec_id) as place from unit
           qualify place <= greatest((select cells from size), 65536)),
seeds as (select place - 1 as cell, u as centre from sample where place <= (select cells from size)),
owner as (select vec_id, sample.u, arg_min(cell, {{'near': -round(list_dot_product(sample.u, centre), 6), 'cell': cell}}) as cell
          from sample, seeds group by all),
means as (select cell, list(total order by d) as m
          from (select cell, d, sum(u[d + 1]) as total from owner, range(64) r(d) group by all) group by cell),
centres as (select cell, list_transform(m, lambda x: round(x / sqrt(list_dot_product(m, m)), 6)) as centre from means),
scale as (select max(list_aggregate(list_transform(u, lambda x: abs(x)), 'max')) as s from sample),
coded as (select vec_id, arg_min(cell, {{'near': -round(list_dot_product(u, centre), 6), 'cell': cell}}) as cell,
                 list_transform(u, lambda x: ((least(15, greatest(0, floor((x / s + 1) * 8))) + 0.5) / 8 - 1) * s) as c
          from unit, centres, scale group by vec_id, u, s),
probed as (select item_id as query_id, u, cell from benchmark join unit on item_id = vec_id, centres
           qualify row_number() over (partition by item_id order by round(list_dot_product(u, centre), 6) desc, cell)
                   <= greatest(1, round_even((select cells from size) * 0.75, 0))),
pooled as (select query_id, vec_id as doc_id from probed join coded using (cell)
           qualify row_number() over (partition by query_id order by round(list_dot_product(u, c), 6) desc, vec_id) <= 40)
"""


@query(
    "vector_index_search",
    f"""with {INDEX_SQL}
       select query_id, doc_id, score, cast(row_number() over (partition by query_id order by score desc, doc_id) as integer) as rank
       from cosine join pooled using (query_id, doc_id) qualify rank <= 10""",
)
def vector_index_search(t):
    index = vector_index.build_index(derived.vectors(t).select("doc_id", "embedding"), new_path(t.spark, "vector-index"))
    return vector_index.search_index(index, derived.vector_questions(t))


def _hash_sql(table: str, key: str) -> str:
    """Hash embedding of a table's texts: ``(id, place, value)`` for places that are not zero."""
    return rf"""(
      select id, place, total / sqrt(sum(total * total) over (partition by id)) as value
      from (select id, ('0x' || substr(md5(word), 1, 8))::bigint % 64 as place,
                   cast(sum(case when ('0x' || substr(md5(word), 9, 1))::bigint % 2 = 0 then 1 else -1 end) as double) as total
            from (select {key} as id, unnest({WORDS}) as word from {table}) group by all))"""


@query(
    "hash_embedding",
    f"select id as doc_id, place, round(value, 6) as value from {_hash_sql('benchmark', 'item_id')} where value <> 0",
)
def hash_embedding(t):
    made = vectors.hash_embedding(t.benchmark, doc_id="item_id", content="text")
    return made.select("doc_id", F.posexplode("embedding")).filter("col <> 0").select(
        "doc_id", F.col("pos").cast("bigint").alias("place"), F.round("col", 6).alias("value")
    )


@query(
    "search_semantic",
    f"""with q as {_hash_sql('benchmark', 'item_id')}, d as {_hash_sql('documents', 'doc_id')},
         near as (select q.id as query_id, d.id as doc_id, sum(q.value * d.value) as dot from q join d using (place) group by all),
         every as (select q.id as query_id, d.id as doc_id, round(coalesce(dot, 0), 6) as score
                   from (select distinct id from q) q cross join (select distinct id from d) d
                   left join near on near.query_id = q.id and near.doc_id = d.id)
       select query_id, doc_id, score, cast(row_number() over (partition by query_id order by score desc, doc_id) as integer) as rank
       from every qualify rank <= 10""",
)
def search_semantic(t):
    return vectors.search_semantic(t.documents, derived.questions(t), doc_id="doc_id", content="text")


@query(
    "hybrid_union",
    f"""with {COSINE_SQL}, asked_all as (select 'b' || item_id as query_id, text from benchmark
                              union all select 'n' || n_nationkey, n_name from nation),
         edges as ({derived.EDGES_SQL}), nodes as ({derived.NODES_SQL}), triples as ({derived.TRIPLES_SQL})
       select query_id, 'relational' as source, 0 as source_rank, cast(doc_id as varchar) as id,
              cast(null as double) as score, lang as detail
       from asked_all, documents where documents.text ilike '%' || asked_all.text || '%'
       union all
       select 'b' || query_id, 'vector', 1, cast(doc_id as varchar), score, null from cosine_top
       union all
       select query_id, 'graph', 2, nodes.id, null, nodes.type
       from asked_all join edges on src = text join nodes on nodes.id = dst
       union all
       select query_id, 'knowledge_graph', 3, s, null, o
       from asked_all, triples where contains(s || ' ' || p || ' ' || o, text)""",
)
def hybrid_union(t):
    asked = derived.vector_questions(t).select(F.concat(F.lit("b"), "query_id").alias("query_id"), "text", "vector")
    nations = t.nation.select(
        F.concat(F.lit("n"), "n_nationkey").alias("query_id"),
        F.col("n_name").alias("text"),
        F.array().cast("array<float>").alias("vector"),
    )
    documents = t.documents.select(
        F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("text").alias("content"),
        F.col("lang").alias("file_type"), F.col("source").alias("user_id"),
    )
    found = hybrid.hybrid_union(
        asked.unionByName(nations),
        documents=documents,
        vectors=derived.vectors(t),
        nodes=derived.nodes(t),
        edges=derived.edges(t),
        triples=derived.triples(t),
    )
    detail = F.coalesce(*[F.element_at("payload", F.lit(k)) for k in ("file_type", "type", "o")])
    return found.select("query_id", "source", "source_rank", "id", "score", detail.alias("detail"))


def _hybrid(t):
    return hybrid.hybrid_weighted(
        t.documents, derived.vectors(t), derived.vector_questions(t), doc_id="doc_id", content="text"
    )


@query("hybrid_weighted", f"with {HYBRID_SQL} select * from ranked")
def hybrid_weighted(t):
    return _hybrid(t).select("query_id", "doc_id", "score", "rank")


def _contexts(t):
    return answers.assemble_context(_hybrid(t), t.documents, doc_id="doc_id", content="text")


@query("rag_context", f"with {CONTEXT_SQL} select * from contexts")
def rag_context(t):
    return _contexts(t)


@query(
    "rag_prompts",
    f"""with {CONTEXT_SQL}
       select item_id as query_id, 'Context:' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || 'Question: ' || text
              || chr(10) || chr(10) || 'Answer:' as prompt, coalesce(sources, '') as sources
       from benchmark left join contexts on item_id = query_id""",
)
def rag_prompts(t):
    return answers.build_prompts(derived.questions(t), _contexts(t))


CHAT_SQL = r"""
b as (select *, coalesce(sum(case when role = 'assistant' then 1 else 0 end) over (partition by conv_id order by turn
             rows between unbounded preceding and 1 preceding), 0) as block from conversations),
g as (select conv_id, block, max(case when role = 'user' then 1 else 0 end) as asked from b where role <> 'assistant' group by all),
m as (select conv_id, block, coalesce(sum(asked) over (partition by conv_id order by block
             rows between unbounded preceding and 1 preceding), 0) as message from g),
u as (select conv_id, max(case when role = 'user' then turn end) as at_turn, 'user' as role,
             coalesce(string_agg(case when role = 'system' then text || chr(10) end, '' order by turn), '')
             || coalesce(string_agg(case when role = 'user' then text end, chr(10) order by turn), '') as text
      from b join m using (conv_id, block) where role <> 'assistant' group by conv_id, message having at_turn is not null),
folded as (select * from u union all select conv_id, turn, 'model', text from conversations where role = 'assistant')
"""


@query("chat_fold", f"with {CHAT_SQL} select * from folded")
def chat_fold(t):
    return chat.fold_chat(t.conversations)


@query(
    "chat_payload",
    f"""with {CHAT_SQL}
       select conv_id, cast(0 as bigint) as part, '{{"contents":[' || string_agg('{{"role":"' || role || '","parts":[{{"text":' || to_json(text) || '}}]}}', ','
              order by at_turn) || '],"generationConfig":{{"temperature":0.1,"maxOutputTokens":2048}}}}' as payload
       from folded group by conv_id""",
)
def chat_payload(t):
    return chat.chat_payload(t.conversations)


@query(
    "chat_payload_parts",
    f"""with {CHAT_SQL},
         parts as (select conv_id, at_turn // 3 as part, string_agg('{{"role":"' || role || '","parts":[{{"text":' || to_json(text) || '}}]}}', ','
                          order by at_turn) as body from folded group by all)
       select conv_id, part, case when lag(part) over w is null then '{{"contents":[' else ',' end || body
              || case when lead(part) over w is null then '],"generationConfig":{{"temperature":0.1,"maxOutputTokens":2048}}}}' else '' end as payload
       from parts window w as (partition by conv_id order by part)""",
)
def chat_payload_parts(t):
    return chat.chat_payload(t.conversations, segment=3)


@query("json_path", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_path(t):
    return chat.read_path(t.events, "props", "$.k", "k", "bigint").select("event_id", "k")


ENTITY_SQL = r"""
found as (select doc_id, regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)*') as hits,
                 regexp_split_to_array(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)*') as gaps from documents),
spread as (select doc_id, i, hits[i] as text, length(gaps[i]) as gap from found, unnest(range(1, len(hits) + 1)) u(i)),
entity as (select doc_id, cast(i - 1 as integer) as pos, text,
                  cast(sum(gap + length(text)) over w - length(text) as integer) as start_char,
                  cast(sum(gap + length(text)) over w as integer) as end_char, 'NAME' as label
           from spread window w as (partition by doc_id order by i))
"""


@query("extract_entities", f"with {ENTITY_SQL} select * from entity")
def extract_entities(t):
    return entities.extract_entities(t.documents, doc_id="doc_id", content="text")


@query(
    "entity_nodes",
    f"""with {ENTITY_SQL} select text as id, label as type, cast(start_char as varchar) as start_char,
              cast(end_char as varchar) as end_char
       from entity qualify row_number() over (partition by text order by doc_id desc, pos desc) = 1""",
)
def entity_nodes(t):
    nodes = entities.entity_nodes(extract_entities(t))
    return nodes.select("id", "type", *[F.element_at("properties", F.lit(k)).alias(k) for k in ("start_char", "end_char")])
