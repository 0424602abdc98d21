"""Inputs derived from the given tables, each beside the SQL that derives the same rows."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sizing import spread
from ..functions.streams import pieces
from .registry import Tables

# ---- tables as text ------------------------------------------------------------------------


def as_text(df: DataFrame) -> DataFrame:
    """Every column as the string a CSV file would hold."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


# ---- uploaded files ------------------------------------------------------------------------

FILES_SQL = """
select doc_id,
       'f' || doc_id || case when source in ('src3', 'src7') then '.zip' when source = 'src5' then '.PDF'
                             when source = 'src9' then '.docx' when lang = 'fr' then '.csv'
                             when lang = 'de' then '.XLSX' when lang = 'es' then '.md' else '.txt' end as filename,
       cast(n_chars as varchar) as directory, text as content, lang, source
from documents
"""


def files(t: Tables) -> DataFrame:
    """One uploaded file per document; its directory is the text length, which may name a user."""
    ext = (
        F.when(F.col("source").isin("src3", "src7"), ".zip")
        .when(F.col("source") == "src5", ".PDF")
        .when(F.col("source") == "src9", ".docx")
        .when(F.col("lang") == "fr", ".csv")
        .when(F.col("lang") == "de", ".XLSX")
        .when(F.col("lang") == "es", ".md")
        .otherwise(".txt")
    )
    return t.documents.select(
        "doc_id",
        F.concat(F.lit("f"), F.col("doc_id").cast("string"), ext).alias("filename"),
        F.col("n_chars").cast("string").alias("directory"),
        F.col("text").alias("content"),
        "lang",
        "source",
    )


USERS_SQL = """
select cast(c_custkey as varchar) as id, c_name as email,
       case when c_mktsegment = 'BUILDING' then null else 'N ' || c_name end as full_name,
       c_acctbal >= 0 as is_active, case when c_mktsegment = 'MACHINERY' then 'admin' else 'user' end as role
from customer
"""


def users(t: Tables) -> DataFrame:
    return t.customer.select(
        F.col("c_custkey").cast("string").alias("id"),
        F.col("c_name").alias("email"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.concat(F.lit("N "), F.col("c_name"))).alias("full_name"),
        (F.col("c_acctbal") >= 0).alias("is_active"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "admin").otherwise("user").alias("role"),
    )


OWNED_SQL = f"""
select f.*, coalesce(u.id, (select coalesce(min(case when role = 'admin' then id end), min(id)) from users)) as user_id
from files f left join users u on f.directory = u.id
"""


def order_files(t: Tables) -> DataFrame:
    """Orders seen as catalog rows."""
    return t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string"), F.lit(".csv")).alias("filename"),
        F.lit("csv").alias("file_type"),
        F.lit(True).alias("is_structured"),
        F.lit("csv").alias("structure_type"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("created_at"),
    )


ORDER_FILES_SQL = """
select o_orderkey as id, 'o' || o_orderkey || '.csv' as filename, 'csv' as file_type, true as is_structured,
       'csv' as structure_type, o_custkey as user_id, o_orderdate as created_at
from orders
"""

# ---- questions and vectors -----------------------------------------------------------------


def questions(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text")


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(
        F.col("vec_id").alias("doc_id"),
        "embedding",
        F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"),
    )


def vector_questions(t: Tables) -> DataFrame:
    """Questions with the vector of the same number, and a filter on that vector's label."""
    v = vectors(t).select("doc_id", F.col("embedding").alias("vector"), F.col("metadata").alias("filters"))
    return questions(t).join(v, F.col("query_id") == F.col("doc_id")).drop("doc_id")


# ---- graph and triples ---------------------------------------------------------------------

NODES_SQL = """
select c_name as id, 'customer' as type, c_mktsegment as label from customer
union all select n_name, 'nation', null from nation
union all select r_name, 'region', null from region
"""

EDGES_SQL = """
select c_name as src, n_name as dst, 'in_nation' as type from customer join nation on c_nationkey = n_nationkey
union all select n_name, r_name, 'in_region' from nation join region on n_regionkey = r_regionkey
union all select s_name, n_name, 'in_nation' from supplier join nation on s_nationkey = n_nationkey
"""

TRIPLES_SQL = """
select c_name as s, 'in_nation' as p, n_name as o from customer join nation on c_nationkey = n_nationkey
union all select n_name, 'in_region', r_name from nation join region on n_regionkey = r_regionkey
union all select c_name, 'ordered', o_orderpriority from orders join customer on o_custkey = c_custkey
"""


def nodes(t: Tables) -> DataFrame:
    def node(df: DataFrame, name: str, kind: str, label: Column) -> DataFrame:
        return df.select(F.col(name).alias("id"), F.lit(kind).alias("type"), F.create_map(F.lit("label"), label).alias("properties"))

    none = F.lit(None).cast("string")
    return (
        node(t.customer, "c_name", "customer", F.col("c_mktsegment"))
        .unionByName(node(t.nation, "n_name", "nation", none))
        .unionByName(node(t.region, "r_name", "region", none))
    )


def edges(t: Tables) -> DataFrame:
    """Customers and nations link to known nodes; suppliers are no nodes, so theirs are refused."""

    def edge(df: DataFrame, src: str, dst: str, kind: str) -> DataFrame:
        none = F.lit(None).cast("map<string,string>")
        return df.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("type"), none.alias("properties"))

    nation = t.nation
    return (
        edge(t.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")), "c_name", "n_name", "in_nation")
        .unionByName(edge(nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")), "n_name", "r_name", "in_region"))
        .unionByName(edge(t.supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")), "s_name", "n_name", "in_nation"))
    )


def triples(t: Tables) -> DataFrame:
    def triple(df: DataFrame, s: str, p: str, o: str) -> DataFrame:
        return df.select(F.col(s).alias("s"), F.lit(p).alias("p"), F.col(o).alias("o"))

    nation = t.nation
    return (
        triple(t.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")), "c_name", "in_nation", "n_name")
        .unionByName(triple(nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")), "n_name", "in_region", "r_name"))
        .unionByName(
            triple(t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")), "c_name", "ordered", "o_orderpriority")
        )
    )


# ---- Office files --------------------------------------------------------------------------

WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
SLIDE = "http://schemas.openxmlformats.org/presentationml/2006/main"
DRAW = "http://schemas.openxmlformats.org/drawingml/2006/main"
RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE_RELS = "http://schemas.openxmlformats.org/package/2006/relationships"


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def _xml_text(line: str) -> str:
    return escape(line, {"\r": "&#13;", "\t": "&#9;"})


def build_docx(text: str) -> bytes:
    """A document with one paragraph per line."""
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{_xml_text(x)}</w:t></w:r></w:p>' for x in text.split("\n"))
    return _zip({"word/document.xml": f'<w:document xmlns:w="{WORD}"><w:body>{body}</w:body></w:document>'})


def build_pptx(text: str) -> bytes:
    """A one-slide show with one text run per line."""
    runs = "".join(f"<a:p><a:r><a:t>{_xml_text(x)}</a:t></a:r></a:p>" for x in text.split("\n"))
    return _zip(
        {
            "ppt/presentation.xml": f'<p:presentation xmlns:p="{SLIDE}" xmlns:r="{RELS}"><p:sldIdLst>'
            '<p:sldId id="256" r:id="rId1"/></p:sldIdLst></p:presentation>',
            "ppt/_rels/presentation.xml.rels": f'<Relationships xmlns="{PACKAGE_RELS}">'
            '<Relationship Id="rId1" Type="slide" Target="slides/slide1.xml"/></Relationships>',
            "ppt/slides/slide1.xml": f'<p:sld xmlns:p="{SLIDE}" xmlns:a="{DRAW}"><p:cSld><p:spTree><p:sp><p:txBody>'
            f"{runs}</p:txBody></p:sp></p:spTree></p:cSld></p:sld>",
        }
    )


def office_files(t: Tables) -> DataFrame:
    """Each document as an Office file: a show if English, else a text document; source src3 arrives damaged."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in pieces(whole)):
            made = [
                (build_pptx if lang == "en" else build_docx)(text)[: 40 if source == "src3" else None]
                for lang, source, text in zip(*(batch[c].to_pylist() for c in ("lang", "source", "text")), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch["file"], pa.array(made, pa.binary())], ["file", "content"])

    suffix = F.when(F.col("lang") == "en", ".pptx").otherwise(".docx")
    named = t.documents.select(
        F.concat(F.lit("f"), F.col("doc_id").cast("string"), suffix).alias("file"), "lang", "source", "text"
    )
    return spread(named).mapInArrow(build, "file string, content binary")
