"""Registered table queries: scans, filters, projections, aggregates, de-duplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import catalog, keys, keyword, tables
from ..session import materialize, new_path
from ..sources import documents as docs
from ..sources import tabular
from ..sources.routing import classify_files
from . import derived
from .registry import query

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]
LINE_TEXT = """cast(l_orderkey as varchar) as l_orderkey, cast(l_linenumber as varchar) as l_linenumber,
    cast(l_partkey as varchar) as l_partkey, cast(l_quantity as varchar) as l_quantity"""
ORDER = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"]
STRIP = "regexp_replace(lower({0}), '^\\s+|\\s+$', '', 'g')"

# ---- scans and sinks -----------------------------------------------------------------------


@query(
    "scan_csv",
    """select cast(c_custkey as varchar) as c_custkey, c_name, cast(c_nationkey as varchar) as c_nationkey,
              cast(c_acctbal as varchar) as c_acctbal, c_mktsegment from customer""",
)
def scan_csv(t):
    path = new_path(t.spark, "csv")
    tabular.write_csv(t.customer, path)
    return tabular.scan_csv(t.spark, path)


@query(
    "scan_workbooks",
    """select p_partkey, p_name, p_type, cast(p_size as bigint) as p_size, p_retailprice from part""",
)
def scan_workbooks(t):
    books = tabular.export_workbooks(t.part, "p_partkey", t.part.columns, rows_per_book=1000)
    rows = materialize(tabular.scan_workbooks(books), "sheets")
    sheet = tabular.sheet_table(tabular.choose_sheet(rows))
    return sheet.select("p_partkey", "p_name", "p_type", "p_size", "p_retailprice")


@query(
    "scan_text",
    "select lang, cast(sum(length(text) + 1) as bigint) as characters from documents group by lang",
)
def scan_text(t):
    path = new_path(t.spark, "texts")
    t.documents.select("lang", "text").write.partitionBy("lang").text(path)
    lang = F.regexp_extract("path", r"/lang=([^/]+)/", 1)
    whole = docs.scan_text(t.spark, path)
    return whole.groupBy(lang.alias("lang")).agg(F.sum(F.length("content")).alias("characters"))


@query(
    "markdown_sections",
    r"""with cut as (select page_id, regexp_split_to_array(html, '<h[1-6][^>]*>') as parts from pages),
         md as (select page_id, array_to_string(parts, chr(10) || '# ') as body from cut),
         s as (select page_id, string_split(chr(10) || body, chr(10) || '# ') as pieces from md)
       select page_id as doc_id, cast(i - 1 as integer) as section_no,
              case when i = 1 then substring(pieces[i] || case when len(pieces) > 1 then chr(10) else '' end, 2)
                   when i < len(pieces) then pieces[i] || chr(10) else pieces[i] end as section
       from s, unnest(range(1, len(pieces) + 1)) u(i)""",
)
def markdown_sections(t):
    marked = t.pages.select("page_id", F.regexp_replace("html", "<h[1-6][^>]*>", "\n# ").alias("content"))
    return docs.markdown_sections(marked, doc_id="page_id", content="content")


@query(
    "extract_docs",
    """select 'f' || doc_id || case when lang = 'en' then '.pptx' else '.docx' end as file,
              case when source = 'src3' then '[Error processing document: f' || doc_id ||
                   case when lang = 'en' then '.pptx' else '.docx' end || '. Error: BadZipFile: File is not a zip file]'
                   else text end as content,
              case when source = 'src3' then 'BadZipFile: File is not a zip file' end as error
       from documents""",
)
def extract_docs(t):
    return docs.extract_documents(derived.office_files(t))


@query(
    "classify_files",
    f"""with f as ({derived.FILES_SQL})
       select filename, lower(regexp_extract(filename, '\\.([^.]*)$', 1)) as file_type,
              regexp_matches(lower(filename), '\\.(csv|xlsx?)$') as is_structured,
              case when filename like '%.csv' then 'csv' when filename like '%.XLSX' then 'excel' end as structure_type,
              filename not like '%.zip' as is_supported
       from f""",
)
def classify(t):
    return classify_files(derived.files(t).select("filename"))


@query(
    "table_to_text",
    """select cast(floor(p_partkey / 1000) as bigint) as block_no,
              string_agg(p_partkey || ' ' || p_name || ' ' || p_brand || ' ' || p_type || ' ' || p_size || ' ' || p_retailprice,
                         chr(10) order by p_partkey) as text
       from part group by 1""",
)
def table_to_text(t):
    return tables.table_to_text(t.part, "p_partkey")


@query(
    "column_widths",
    " union all ".join(
        f"select '{c}' as column_name, greatest(max(length(cast({c} as varchar))), length('{c}')) + 2 as width from customer"
        for c in ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    ).replace("greatest(", "cast(greatest(").replace(" + 2 as", " + 2 as integer) as"),
)
def column_widths(t):
    return tables.column_widths(t.customer)


@query(
    "export_filtered",
    f"""select cast(c_custkey as varchar) as c_custkey, c_name, cast(c_nationkey as varchar) as c_nationkey from customer
       where {STRIP.format('c_mktsegment')} = 'building' and c_acctbal > 5000
       qualify row_number() over (partition by c_nationkey order by c_custkey) = 1""",
)
def export_filtered(t):
    result = tables.filter_table(
        t.customer,
        [
            {"column": "c_mktsegment", "operator": "==", "value": " Building "},
            {"column": "c_acctbal", "operator": ">", "value": "5000"},
        ],
        text_mode=True,
        dedup=True,
        subset=["c_nationkey"],
        order_by="c_custkey",
        columns=["c_custkey", "c_name", "c_nationkey"],
    )
    path = new_path(t.spark, "export")
    tabular.write_csv(result, path)
    return tabular.scan_csv(t.spark, path)


# ---- text-mode filters ---------------------------------------------------------------------


def _text_filter(name: str, table: str, columns: list[str], column: str, operator: str, value, where: str, select: str = ""):
    """Filter over a table held as text, the way a CSV file holds it."""
    select = select or ", ".join(f"cast({c} as varchar) as {c}" for c in columns)

    @query(name, f"select {select} from {table} where {where}")
    def run(t):
        df = derived.as_text(getattr(t, table).select(*columns))
        return tables.filter_table(df, {"column": column, "operator": operator, "value": value}, text_mode=True)


CUSTOMER = ["c_custkey", "c_name", "c_mktsegment"]
_text_filter("filter_text_eq", "customer", CUSTOMER, "c_mktsegment", "==", " building ", f"{STRIP.format('c_mktsegment')} = 'building'")
_text_filter("filter_text_ne", "customer", CUSTOMER, "c_mktsegment", "!=", "BUILDING ", f"{STRIP.format('c_mktsegment')} <> 'building'")
_text_filter("filter_text_contains", "part", ["p_partkey", "p_name"], "p_name", "contains", "^RED|ring$", "regexp_matches(lower(p_name), '^red|ring$')")
_text_filter("filter_num_gt", "lineitem", LINE, "l_quantity", ">", "30.5", "l_quantity > 30.5", LINE_TEXT)
_text_filter("filter_num_lt", "lineitem", LINE, "l_quantity", "<", 7, "l_quantity < 7", LINE_TEXT)
_text_filter("filter_num_ge", "lineitem", LINE, "l_quantity", ">=", "49", "l_quantity >= 49", LINE_TEXT)
_text_filter("filter_num_le", "lineitem", LINE, "l_quantity", "<=", 2.0, "l_quantity <= 2", LINE_TEXT)


@query(
    "filter_normalized",
    f"""select cast(c_custkey as varchar) as c_custkey, {STRIP.format('c_mktsegment')} as c_mktsegment from customer
       where {STRIP.format('c_mktsegment')} = 'machinery'""",
)
def filter_normalized(t):
    return tables.filter_table(
        derived.as_text(t.customer.select("c_custkey", "c_mktsegment")),
        {"column": "c_mktsegment", "operator": "==", "value": "Machinery"},
        text_mode=True,
        normalize=["c_mktsegment"],
    )


# ---- typed-mode filters --------------------------------------------------------------------


def _typed_filter(name: str, table: str, columns: list[str], column: str, operator: str, value, where: str):
    @query(name, f"select {', '.join(columns)} from {table} where {where}")
    def run(t):
        df = getattr(t, table).select(*columns)
        return tables.filter_table(df, {"column": column, "operator": operator, "value": value}, text_mode=False)


_typed_filter("filter_typed_ts", "orders", ORDER, "o_orderdate", ">=", "1998-01-02", "o_orderdate >= timestamp '1998-01-02'")
_typed_filter("filter_typed_eq", "orders", ORDER, "o_orderstatus", "==", "F", "o_orderstatus = 'F'")
_typed_filter("filter_typed_ne", "orders", ORDER, "o_orderstatus", "!=", "F", "o_orderstatus <> 'F'")
_typed_filter("filter_typed_gt", "orders", ORDER, "o_totalprice", ">", "250000.5", "o_totalprice > 250000.5")
_typed_filter("filter_typed_lt", "orders", ORDER, "o_totalprice", "<", 50000, "o_totalprice < 50000")
_typed_filter("filter_typed_ge", "orders", ORDER, "o_custkey", ">=", "100", "o_custkey >= 100")
_typed_filter("filter_typed_le", "orders", ORDER, "o_custkey", "<=", 99, "o_custkey <= 99")
_typed_filter("filter_typed_contains", "part", ["p_partkey", "p_type"], "p_type", "contains", "s.*a", "regexp_matches(lower(p_type), 's.*a')")


@query("filter_conjunction", "select * from lineitem where l_quantity > 25 and l_discount <= 0.05 and l_returnflag = 'R'")
def filter_conjunction(t):
    return tables.filter_table(
        t.lineitem,
        [
            {"column": "l_quantity", "operator": ">", "value": "25"},
            {"column": "l_discount", "operator": "<=", "value": 0.05},
            {"column": "l_returnflag", "operator": "==", "value": "R"},
        ],
        text_mode=False,
    )


@query("filter_none", "select * from nation")
def filter_none(t):
    return tables.filter_table(t.nation, [], text_mode=True)


@query(
    "keyword_search",
    """select cast(doc_id as varchar) as id, source as title, text as content, lang as file_type, source as user_id
       from documents where text ilike '%the%ing%'""",
)
def keyword_search(t):
    library = t.documents.select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("source").alias("title"),
        F.col("text").alias("content"),
        F.col("lang").alias("file_type"),
        F.col("source").alias("user_id"),
    )
    return keyword.keyword_search(library, "THE%ing")


# ---- look-ups and views --------------------------------------------------------------------


@query("files_of_user", f"select * from ({derived.ORDER_FILES_SQL}) where user_id = 42")
def files_of_user(t):
    return keys.owned_by(derived.order_files(t), 42)


@query("search_in_files", "select doc_id, text from documents where text ilike '%tion%' and doc_id in (select doc_id from labels)")
def search_in_files(t):
    chosen = keys.in_files(t.documents.select("doc_id", "text"), t.labels.select("doc_id"), "doc_id")
    return chosen.filter(keyword.keyword_test(F.col("text"), F.lit("tion")))


@query(
    "file_lookup",
    f"select * from ({derived.ORDER_FILES_SQL}) where file_type = 'csv' and user_id = 7 order by created_at, id limit 1",
)
def file_lookup(t):
    return keys.find_first(derived.order_files(t), {"file_type": "csv", "user_id": 7}, ["created_at", "id"])


@query("lookup_by_key", "select * from customer where c_custkey in (select s_suppkey from supplier)")
def lookup_by_key(t):
    return keys.find_many(t.customer, t.supplier.select(F.col("s_suppkey").alias("c_custkey")), ["c_custkey"])


@query(
    "file_listing",
    f"""select filename, file_type as type, is_structured, structure_type,
               strftime(created_at, '%Y-%m-%dT%H:%M:%S') as created_at from ({derived.ORDER_FILES_SQL})""",
)
def file_listing(t):
    return catalog.file_listing(derived.order_files(t))


@query(
    "user_view",
    f"select id, email, full_name, is_active, role, cast(null as timestamp) as created_at from ({derived.USERS_SQL})",
)
def user_view(t):
    accounts = derived.users(t).withColumns(
        {"hashed_password": F.sha2("email", 256), "created_at": F.lit(None).cast("timestamp_ntz")}
    )
    return catalog.user_view(accounts)


@query(
    "result_as_json",
    """select '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' as json
       from nation""",
)
def result_as_json(t):
    return tables.result_as_json(t.nation)


@query(
    "search_relational",
    "select doc_id, lang, n_chars from documents where lang = 'fr' and n_chars > 2000 and regexp_matches(lower(text), 'tion')",
)
def search_relational(t):
    conditions = [
        {"column": "lang", "operator": "==", "value": "fr"},
        {"column": "n_chars", "operator": ">", "value": 2000},
        {"column": "text", "operator": "contains", "value": "tion"},
    ]
    return tables.filter_table(t.documents, conditions, text_mode=False, columns=["doc_id", "lang", "n_chars"])


# ---- aggregates and de-duplication ---------------------------------------------------------


@query(
    "distinct_values",
    "select o_orderpriority as value, min(o_orderkey) as first_seen from orders group by 1",
)
def distinct_values(t):
    return tables.distinct_values(t.orders, "o_orderpriority", "o_orderkey")


@query("count_matching", f"select count(*) as \"Count\" from customer where {STRIP.format('c_mktsegment')} = 'household'")
def count_matching(t):
    return tables.count_matching(t.customer, "c_mktsegment", " HouseHold", text_mode=False)


@query("count_only_eq", f"select count(*) as \"Count\" from customer where {STRIP.format('c_mktsegment')} = 'furniture'")
def count_only_eq(t):
    return tables.filter_table(
        t.customer,
        {"column": "c_mktsegment", "operator": "==", "value": "Furniture", "count_only": True},
        text_mode=True,
    )


@query(
    "count_only_multi",
    """select count(*) as "Count" from (select distinct l_partkey, l_suppkey from lineitem
       where l_quantity > 10 and l_discount < 0.08)""",
)
def count_only_multi(t):
    return tables.filter_table(
        t.lineitem,
        [
            {"column": "l_quantity", "operator": ">", "value": 10},
            {"column": "l_discount", "operator": "<", "value": 0.08},
        ],
        text_mode=False,
        dedup=True,
        subset=["l_partkey", "l_suppkey"],
        count_only=True,
    )


@query("dedup_all", "select distinct text, lang from documents")
def dedup_all(t):
    return tables.drop_duplicates(t.documents.select("text", "lang"))


@query("dedup_subset", "select * from documents qualify row_number() over (partition by text order by doc_id) = 1")
def dedup_subset(t):
    return tables.drop_duplicates(t.documents, ["text"], "doc_id")


@query("duplicate_keys", "select text, count(*) as uses from documents group by text having count(*) > 1")
def duplicate_keys(t):
    return tables.duplicate_keys(t.documents, ["text"])


@query(
    "upsert_latest",
    "select * from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1",
)
def upsert_latest(t):
    return tables.keep_latest(t.events, ["user_id"], ["ts", "event_id"])


# ---- scalar functions ----------------------------------------------------------------------


@query(
    "scalar_functions",
    f"""with f as ({derived.FILES_SQL})
       select filename, 'up/' || lang || '/' || filename as path, regexp_extract(lower(filename), '(\\.[^.]+)$', 1) as ext,
              {STRIP.format("' ' || upper(source) || chr(9)")} as stripped,
              cast(substr(source, 4) as double) as number, cast(null as double) as no_number,
              list_filter(string_split(lang || ',' || source, ','), lambda x: x <> '')[2] as second,
              coalesce(case when lang = 'en' then source end, 'unknown') as with_default,
              nullif(case when lang = 'en' then '' else lang end, '') as filled, md5(content) as hash, length(content) as length
       from f""",
)
def scalar_functions(t):
    f = derived.files(t).withColumn("path", F.concat(F.lit("up/"), "lang", F.lit("/"), "filename"))
    some = F.when(F.col("lang") == "en", F.create_map(F.lit("source"), F.col("source"))).otherwise(F.create_map())
    return f.select(
        text.base_name("path").alias("filename"),
        "path",
        text.extension("path").alias("ext"),
        text.norm(F.concat(F.lit(" "), F.upper("source"), F.lit("\t"))).alias("stripped"),
        text.to_number(F.substr("source", F.lit(4))).alias("number"),
        text.to_number("source").alias("no_number"),
        F.element_at(text.split_list(F.concat_ws(",", "lang", "source")), 2).alias("second"),
        text.map_value(some.cast("map<string,string>"), "source", "unknown").alias("with_default"),
        text.filled(F.when(F.col("lang") == "en", "").otherwise(F.col("lang"))).alias("filled"),
        F.md5(F.col("content").cast("binary")).alias("hash"),
        F.length("content").cast("bigint").alias("length"),
    )
