"""Registered catalog queries: ownership, accounts, deletes, ingest and its stream form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.frames import union_all
from ..operators import catalog, ingest, keys, vectors
from ..operators.keyed_store import KeyedStore
from ..session import new_path
from ..streaming import ingest as stream
from . import derived
from .registry import query

OWNED = f"with files as ({derived.FILES_SQL}), users as ({derived.USERS_SQL}), owned as ({derived.OWNED_SQL})"


@query(
    "files_with_owner",
    """select o_orderkey as id, 'o' || o_orderkey || '.csv' as filename, o_custkey as user_id, c_name as full_name
       from orders join customer on o_custkey = c_custkey""",
)
def files_with_owner(t):
    owners = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("full_name"))
    return catalog.files_with_owner(derived.order_files(t).select("id", "filename", "user_id"), owners)


ACTIVE_USERS_SQL = """select c_custkey as id, case when c_mktsegment = 'MACHINERY' then 'admin' else 'user' end as role
       from customer where c_acctbal >= 0"""


@query(
    "assign_owner",
    f"""with users as ({ACTIVE_USERS_SQL})
       select o_orderkey, o_custkey as directory,
              coalesce(u.id, (select coalesce(min(case when role = 'admin' then id end), min(id)) from users)) as user_id
       from orders left join users u on o_custkey = u.id""",
)
def assign_owner(t):
    users = t.customer.filter("c_acctbal >= 0").select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_mktsegment") == "MACHINERY", "admin").otherwise("user").alias("role")
    )
    return catalog.assign_owner(t.orders.select("o_orderkey", F.col("o_custkey").alias("directory")), users)


def _catalog(t):
    """Catalog rows exist for the labelled documents."""
    owned = catalog.assign_owner(derived.files(t), derived.users(t))
    return keys.find_many(owned, t.labels, ["doc_id"]).select("filename", "user_id")


@query(
    "uncataloged_files",
    f"{OWNED} select doc_id, filename, user_id from owned where doc_id not in (select doc_id from labels)",
)
def uncataloged_files(t):
    owned = catalog.assign_owner(derived.files(t), derived.users(t)).select("doc_id", "filename", "user_id")
    return catalog.uncataloged_files(owned, _catalog(t))


@query(
    "catalog_backfill",
    f"""{OWNED} select filename, lower(regexp_extract(filename, '\\.([^.]*)$', 1)) as file_type,
              regexp_matches(lower(filename), '\\.(csv|xlsx?)$') as is_structured,
              case when filename like '%.csv' then 'csv' when filename like '%.XLSX' then 'excel' end as structure_type,
              user_id
       from owned where doc_id not in (select doc_id from labels)""",
)
def catalog_backfill(t):
    return catalog.catalog_backfill(derived.files(t), derived.users(t), _catalog(t))


@query(
    "insert_if_absent",
    """select o_orderkey, o_custkey,
              case when o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING') then 'key already stored'
                   when row_number() over (partition by o_custkey order by o_orderkey) > 1 then 'key repeated in this batch'
              end as error
       from orders""",
)
def insert_if_absent(t):
    store = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return keys.insert_if_absent(store, t.orders.select("o_orderkey", "o_custkey"), ["o_custkey"], ["o_orderkey"])


LOGIN_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query(
    "merge_accounts",
    f"""with a as (select *, cast(null as varchar) as google_id from ({derived.USERS_SQL})),
         l as (select 'Customer#' || lpad(cast(l_partkey as varchar), 9, '0') as email, 'g' || l_orderkey as google_id,
                      case when l_returnflag = 'A' then 'P' || l_orderkey end as name,
                      case when l_linestatus = 'O' then 'pic' || l_suppkey end as picture,
                      row_number() over (order by {', '.join(LOGIN_ORDER)}) as turn from lineitem),
         n as (select email, arg_max(google_id, turn) as google_id, arg_min(name, turn) filter (name is not null) as name,
                      arg_max(picture, turn) filter (picture is not null) as picture from l group by email)
       select coalesce(a.email, n.email) as email, coalesce(n.google_id, a.google_id) as google_id,
              coalesce(a.full_name, n.name) as full_name, n.picture as profile_picture,
              coalesce(a.is_active, true) as is_active, coalesce(a.role, 'user') as role,
              case when a.id is null then 'inserted' when n.email is null then 'kept' else 'updated' end as action
       from a full outer join n on a.email = n.email""",
)
def merge_accounts(t):
    accounts = derived.users(t).withColumns(
        {
            "google_id": F.lit(None).cast("string"),
            "profile_picture": F.lit(None).cast("string"),
            "updated_at": F.lit(None).cast("timestamp"),
        }
    )
    logins = t.lineitem.select(
        F.concat(F.lit("Customer#"), F.lpad(F.col("l_partkey").cast("string"), 9, "0")).alias("email"),
        F.concat(F.lit("g"), "l_orderkey").alias("google_id"),
        F.when(F.col("l_returnflag") == "A", F.concat(F.lit("P"), "l_orderkey")).alias("name"),
        F.when(F.col("l_linestatus") == "O", F.concat(F.lit("pic"), "l_suppkey")).alias("profile_picture"),
        *LOGIN_ORDER,
    )
    return catalog.merge_accounts(accounts, logins, LOGIN_ORDER).drop("id", "updated_at")


@query(
    "partial_update",
    f"""with c as (select l_partkey as id, case when l_returnflag = 'R' then 'N' || l_orderkey end as full_name,
                      case when l_linestatus = 'F' then l_quantity > 25 end as is_active,
                      case when l_tax > 0.04 and l_discount > 0.05 then 'admin' end as role,
                      row_number() over (order by {', '.join(LOGIN_ORDER)}) as turn from lineitem),
         n as (select id, arg_max(full_name, turn) filter (full_name is not null) as full_name,
                      arg_max(is_active, turn) filter (is_active is not null) as is_active,
                      arg_max(role, turn) filter (role is not null) as role from c group by id)
       select s_suppkey as id, coalesce(n.full_name, s_name) as full_name, coalesce(n.is_active, s_acctbal >= 0) as is_active,
              coalesce(n.role, 'user') as role, n.id is not null as updated, cast(null as varchar) as error
       from supplier left join n on s_suppkey = n.id
       union all
       select id, full_name, is_active, role, false, 'User not found' from c where id not in (select s_suppkey from supplier)""",
)
def partial_update(t):
    users = t.supplier.select(
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("full_name"),
        (F.col("s_acctbal") >= 0).alias("is_active"),
        F.lit("user").alias("role"),
        F.lit(None).cast("timestamp").alias("updated_at"),
    )
    changes = t.lineitem.select(
        F.col("l_partkey").alias("id"),
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("N"), "l_orderkey")).alias("full_name"),
        F.when(F.col("l_linestatus") == "F", F.col("l_quantity") > 25).alias("is_active"),
        F.when(F.col("l_discount") > 0.05, "admin").alias("role"),
        (F.col("l_tax") > 0.04).alias("admin_action"),
        *LOGIN_ORDER,
    )
    updated, rejected = catalog.partial_update(users, changes, LOGIN_ORDER, fields=["full_name", "is_active"])
    columns = ["id", "full_name", "is_active", "role"]
    granted = F.when(F.col("admin_action"), F.col("role")).alias("role")
    return union_all(
        [
            updated.select(*columns, F.col("updated_at").isNotNull().alias("updated"), F.lit(None).cast("string").alias("error")),
            rejected.select("id", "full_name", "is_active", granted, F.lit(False).alias("updated"), "error"),
        ]
    )


@query(
    "delete_by_key",
    """with k as (select distinct o_orderkey as c_custkey from orders where o_orderpriority = '1-URGENT')
       select c_custkey, 'kept' as status from customer where c_custkey not in (select c_custkey from k)
       union all select c_custkey, 'not found' from k where c_custkey not in (select c_custkey from customer)""",
)
def delete_by_key(t):
    wanted = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("c_custkey"))
    kept, missing = keys.delete_keys(t.customer, wanted, ["c_custkey"])
    return kept.select("c_custkey", F.lit("kept").alias("status")).unionByName(
        missing.withColumn("status", F.lit("not found"))
    )


@query(
    "delete_document",
    """with gone as (select doc_id from labels where toxic = 1)
       select 'documents' as store, doc_id from documents where doc_id not in (select doc_id from gone)
       union all select 'labels', doc_id from labels where doc_id not in (select doc_id from gone)
       union all select 'vectors', vec_id from embeddings where vec_id not in (select doc_id from gone)""",
)
def delete_document(t):
    stores = {"documents": (t.documents, "doc_id"), "labels": (t.labels, "doc_id"), "vectors": (derived.vectors(t), "doc_id")}
    left = keys.delete_everywhere(stores, t.labels.filter("toxic = 1").select("doc_id"))
    return union_all([df.select(F.lit(name).alias("store"), "doc_id") for name, df in left.items()])


@query(
    "ingest_documents",
    f"""with f as ({derived.FILES_SQL})
       select filename as id, filename as title, content, filename as file_path,
              lower(regexp_extract(filename, '\\.([^.]*)$', 1)) as file_type, directory as user_id,
              regexp_matches(lower(filename), '\\.(csv|xlsx?)$') as is_structured,
              case when filename like '%.csv' then 'csv' when filename like '%.XLSX' then 'excel' end as structure_type,
              case when filename like '%.zip' then 'File type .zip is not supported.'
                   when doc_id in (select doc_id from labels) then 'key already stored' end as error
       from f""",
)
def ingest_documents(t):
    files = derived.files(t)
    stored = keys.find_many(files, t.labels, ["doc_id"]).select(F.col("filename").alias("id"))
    arriving = files.withColumnRenamed("directory", "user_id")
    batch = ingest.ingest_documents(arriving, stored)
    none = F.lit(None).cast("string").alias("error")
    return batch.documents.select(*ingest.RECORD_COLUMNS, none).unionByName(batch.rejects)


@query(
    "ingest_stores",
    rf"""with f as ({derived.FILES_SQL}),
         accepted as (select filename as id, content, case when filename like '%.csv' then 'csv' when filename like '%.XLSX' then 'excel' else '' end as kind
                      from f where filename not like '%.zip' and doc_id not in (select doc_id from labels)),
         places as (select id, kind, ('0x' || substr(md5(word), 1, 8))::bigint % 64 as place,
                           cast(sum(case when ('0x' || substr(md5(word), 9, 1))::bigint % 2 = 0 then 1 else -1 end) as double) as total
                    from (select id, kind, unnest(regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}]+')) as word from accepted) group by all),
         names as (select id, unnest(regexp_extract_all(content, '[A-Z][a-z]+(?: [A-Z][a-z]+)*')) as name from accepted)
       select 'vectors' as store, id, kind || ':' || place as detail, round(value, 6) as value
       from (select *, total / sqrt(sum(total * total) over (partition by id)) as value from places) where value <> 0
       union all select 'entities', id, name, cast(count(*) as double) from names group by id, name
       union all select 'nodes', name, 'NAME', 1.0 from names group by name""",
)
def ingest_stores(t):
    """What a batch adds to the other stores: vectors place by place, entities by document, and the entities' nodes."""
    files = derived.files(t)
    stored = keys.find_many(files, t.labels, ["doc_id"]).select(F.col("filename").alias("id"))
    batch = ingest.ingest_documents(files.withColumnRenamed("directory", "user_id"), stored)
    kind = F.coalesce(F.element_at("metadata", F.lit("structure_type")), F.lit(""))
    places = batch.vectors.select(F.col("doc_id").alias("id"), kind.alias("kind"), F.posexplode("embedding")).filter("col <> 0")
    vector = places.select(F.lit("vectors").alias("store"), "id", F.concat("kind", F.lit(":"), "pos").alias("detail"), F.round("col", 6).alias("value"))
    entity = batch.entities.groupBy("doc_id", "text").agg(F.count(F.lit(1)).cast("double").alias("value"))
    entity = entity.select(F.lit("entities").alias("store"), F.col("doc_id").alias("id"), F.col("text").alias("detail"), "value")
    node = batch.nodes.select(F.lit("nodes").alias("store"), "id", F.col("type").alias("detail"), F.lit(1.0).alias("value"))
    return union_all([vector, entity, node])


@query(
    "upsert_vectors",
    """select vec_id as doc_id, label, i - 1 as place, cast(embedding[i] as double) as value
       from (select vec_id, label, embedding from embeddings
             qualify row_number() over (partition by label order by vec_id desc) = 1) e, unnest(range(1, 65)) u(i)""",
)
def upsert_vectors(t):
    """Vectors written once per label, over a store that holds the odd ones already: the last one stays."""
    writes = t.embeddings.select(F.col("label").alias("doc_id"), "embedding", "vec_id")
    latest = vectors.upsert_vectors(writes.filter("vec_id % 2 = 1"), writes.filter("vec_id % 2 = 0"), "vec_id")
    return latest.select(F.col("vec_id").alias("doc_id"), F.col("doc_id").alias("label"), F.posexplode("embedding")).select(
        "doc_id", "label", F.col("pos").cast("bigint").alias("place"), F.col("col").cast("double").alias("value")
    )


def _stream(t, key: str):
    target, rejects, checkpoint = (new_path(t.spark, n) for n in ("stored", "refused", "progress"))
    arriving = stream.table_stream(t.spark, t.path("documents") + "*", t.documents.schema)
    stream.ingest_stream(arriving, target, rejects, checkpoint, [key], ["doc_id"])
    return t.spark.read.parquet(target).drop(stream.BATCH)


@query("stream_ingest", "select * from documents")
def stream_ingest(t):
    return _stream(t, "doc_id")


@query("stream_ingest_dedup", "select * from documents qualify row_number() over (partition by text order by doc_id) = 1")
def stream_ingest_dedup(t):
    return _stream(t, "text")


@query("stream_ingest_keyed", "select * from documents qualify row_number() over (partition by text order by doc_id % 3, doc_id) = 1")
def stream_ingest_keyed(t):
    """Three files that repeat each other's texts, each arriving after the one before was taken in."""
    arrived, target, rejects, checkpoint = (new_path(t.spark, n) for n in ("arriving", "stored", "refused", "progress"))
    for i in range(3):
        t.documents.filter(F.col("doc_id") % 3 == i).write.mode("append").parquet(arrived)
        stream.ingest_keyed(stream.table_stream(t.spark, arrived, t.documents.schema), target, rejects, checkpoint, ["text"], ["doc_id"])
    return t.spark.read.parquet(target).drop(stream.BATCH)


@query(
    "keyed_store_insert",
    """select doc_id, source, cast(null as varchar) as error from documents where doc_id % 10 <> 0
       union all select doc_id, 'late', case when doc_id % 10 = 0 then null else 'key already stored' end from documents where doc_id % 5 = 0""",
)
def keyed_store_insert(t):
    """A store of nine tenths of the documents, then a batch that half of is known."""
    rows = t.documents.select("doc_id", "source")
    store = KeyedStore(t.spark, new_path(t.spark, "keyed"), rows.schema, ["doc_id"], 64)
    store.insert(rows.filter("doc_id % 10 <> 0"), "first", ["source"])
    refused = store.insert(rows.filter("doc_id % 5 = 0").withColumn("source", F.lit("late")), "second", ["source"])
    return store.read().withColumn("error", F.lit(None).cast("string")).unionByName(refused)
