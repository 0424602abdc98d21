"""A document library kept as plain Parquet tables under one folder.

The front door for users who think in uploads and questions. Every method is a few operator calls:

- ``upload``, ``list_documents``, ``delete_documents``, ``compact``
- ``table``, ``filter``, ``count``, ``distinct``, ``export`` for the rows of uploaded table files
- ``add_graph``, ``add_triples``, ``traverse``, ``within_hops``, ``match`` for what is known beside the documents
- ``search`` in all four stores, ``ranked`` over texts and vectors, ``prompts``, ``answers``

Tables only grow, one ``batch`` partition per upload; a deletion is a row in ``deletions`` that reads
leave out until ``compact`` applies it. Writing a batch again replaces it, so a repeated upload of a stream adds nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import RequestError
from .functions.sizing import broadcast_checked
from .operators import answers, catalog, compaction, graph, hybrid, ingest, tables, triples
from .operators.keys import find_first, in_files, owned_by
from .operators.vectors import hash_embedding
from .session import materialize, ship_package
from .sources.listing import read_binary
from .sources.tabular import choose_sheet, export_workbooks, scan_csv, scan_workbooks, sheet_table, write_csv

TABLES = {
    "documents": "id string, title string, content string, file_path string, file_type string, user_id string, "
    "is_structured boolean, structure_type string, created_at timestamp",
    "vectors": "doc_id string, embedding array<double>, metadata map<string,string>, created_at timestamp",
    "entities": "doc_id string, pos int, text string, start_char int, end_char int, label string, created_at timestamp",
    "deletions": "id string, deleted_at timestamp",
    "nodes": "id string, type string, properties map<string,string>, created_at timestamp",
    "edges": "src string, dst string, type string, properties map<string,string>, created_at timestamp",
    "triples": "s string, p string, o string, created_at timestamp",
}
#: Batches of a table that are merged into one of the next tier.
TIER = 8


class Library:
    def __init__(
        self, spark: SparkSession, folder: str, embed: Callable[[DataFrame], DataFrame] | None = None
    ):
        """``embed`` maps ``(id, content, ...)`` to ``(doc_id, embedding)``; hash embedding by default."""
        self.spark, self.folder = ship_package(spark), folder.rstrip("/")
        self.embed = embed or (lambda df: hash_embedding(df, doc_id="id", content="content"))

    # ---- tables ----

    def _read(self, name: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], f"{TABLES[name]}, batch string")
        rows = self.spark.read.schema(f"{TABLES[name]}, batch string").parquet(f"{self.folder}/{name}")
        covered = compaction.unfinished(self._batches(name))
        return rows.filter(~F.col("batch").isin(covered)) if covered else rows

    def _write(self, name: str, rows: DataFrame, batch: str) -> None:
        columns = T.StructType.fromDDL(TABLES[name]).names
        rows.select(*columns).write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")

    def _batches(self, name: str) -> list[str]:
        """Names of the batches a table holds; as many as uploads since the last compaction, and a few."""
        return compaction.batches(self.spark, f"{self.folder}/{name}")

    def _now(self) -> Column:
        return F.lit(self.spark.range(1).select(F.current_timestamp().alias("now")).first()["now"])

    def _live(self, name: str, key: str, except_batch: str = "") -> DataFrame:
        """Rows whose document was not deleted after they were written; without deletions a plain read."""
        if not self._batches("deletions"):
            return self._read(name).filter(F.col("batch") != except_batch).drop("batch")
        gone = self._read("deletions").groupBy(F.col("id").alias("_id")).agg(F.max("deleted_at").alias("_at"))
        rows = self._read(name).filter(F.col("batch") != except_batch).drop("batch")
        deleted = (F.col(key) == F.col("_id")) & (F.col("created_at") <= F.col("_at"))
        return rows.join(broadcast_checked(gone), deleted, "left_anti")

    @property
    def documents(self) -> DataFrame:
        return self._live("documents", "id")

    @property
    def vectors(self) -> DataFrame:
        return self._live("vectors", "doc_id")

    @property
    def entities(self) -> DataFrame:
        return self._live("entities", "doc_id")

    @property
    def nodes(self) -> DataFrame:
        """The last written row of every node."""
        return graph.upsert_nodes(self._read("nodes").drop("batch"), "created_at").drop("created_at")

    @property
    def edges(self) -> DataFrame:
        return self._read("edges").drop("batch", "created_at")

    @property
    def triples(self) -> DataFrame:
        return self._read("triples").drop("batch", "created_at")

    # ---- uploads ----

    def upload(self, path: str, user_id: str) -> DataFrame:
        """Ingest every file under ``path``; returns ``(filename, success, error)`` per file."""
        return self.add(ingest.read_uploads(self.spark, path, user_id), uuid.uuid4().hex)

    def add(self, uploads: DataFrame, batch: str) -> DataFrame:
        """Ingest decoded uploads as the named batch, replacing an earlier run of that batch."""
        made = ingest.ingest_documents(uploads, self._live("documents", "id", batch), self.embed)
        stamp = self._now()
        stores = {"vectors": made.vectors, "entities": made.entities, "nodes": made.nodes, "documents": made.documents}
        for name, rows in stores.items():
            self._write(name, rows.withColumn("created_at", stamp), batch)
        stored = made.documents.select(F.col("id").alias("filename"), F.lit(True).alias("success"), F.lit(None).cast("string").alias("error"))
        return stored.unionByName(made.rejects.select(F.col("id").alias("filename"), F.lit(False).alias("success"), "error"))

    def list_documents(self, user_id: str) -> DataFrame:
        """``(file_id, filename, type, is_structured, structure_type, created_at)`` of one owner."""
        mine = owned_by(self.documents, user_id).withColumn("filename", F.col("title"))
        return catalog.file_listing(mine).withColumn("file_id", F.col("filename"))

    def delete_documents(self, ids: Sequence[str] | DataFrame, user_id: str) -> DataFrame:
        """Delete an owner's documents from every table; returns the ids that were theirs."""
        mine = in_files(owned_by(self.documents, user_id).select("id"), ids, "id")
        batch = uuid.uuid4().hex
        self._write("deletions", mine.withColumn("deleted_at", self._now()), batch)
        return self._read("deletions").filter(F.col("batch") == batch).select("id")

    def compact(self) -> dict[str, int]:
        """Merge batches of like size into fewer and apply deletions to them; how many batches each table is left with.

        Sizes go in tiers of TIER; the batches of a tier are rewritten once it holds TIER of them, so a row is written again once
        for each tier. A merged batch is written under the name of its parts before they are removed, and reads while both
        are there see the parts only; a compaction that broke off is finished by the next. When every batch of the
        document tables is clean, deletions made before are forgotten, and reads join nothing. No upload may run meanwhile.
        """
        return compaction.compact(self, TIER)

    # ---- uploaded tables ----

    def table(self, file_id: str, sheet: str | None = None) -> DataFrame:
        """The rows of an uploaded table file, with their order in ``_order``: a CSV file, or the only or the named sheet of a workbook."""
        row, text_mode = self._table_file(file_id)
        if text_mode:
            return scan_csv(self.spark, row["file_path"], multiline=None, with_order=True)
        book = scan_workbooks(read_binary(self.spark, row["file_path"]).select("file", "content"))
        return sheet_table(choose_sheet(book, sheet)).drop("file").withColumnRenamed("row_no", "_order")

    def _table_file(self, file_id: str) -> tuple[Row, bool]:
        row = find_first(self.documents, {"id": file_id}, ["created_at"]).first()
        if row is None:
            raise RequestError(f"There is no document {file_id!r}.")
        if not row["is_structured"]:
            raise RequestError(f"{file_id!r} is not a table.")
        return row, row["structure_type"] == "csv"

    def filter(
        self, file_id: str, conditions=None, *, sheet: str | None = None, dedup: bool = False, subset: Sequence[str] | None = None,
        columns: Sequence[str] | None = None, count_only: bool = False,
    ) -> DataFrame:
        """The rows of a table that satisfy all ``conditions``, or their number; in file order where they are shown."""
        rows, text_mode = self.table(file_id, sheet), self._table_file(file_id)[1]
        subset = list(subset) if subset else [c for c in rows.columns if c != "_order"]
        shown = list(columns) if columns else [c for c in rows.columns if c != "_order"]
        found = tables.filter_table(
            rows, conditions, text_mode=text_mode, dedup=dedup, subset=subset if dedup else None, order_by="_order",
            columns=None if count_only else [*shown, "_order"], count_only=count_only,
        )
        return found if "_order" not in found.columns else found.orderBy("_order").drop("_order")

    def count(self, file_id: str, column: str, value: Any, sheet: str | None = None) -> int:
        """How many rows of a table hold ``value`` in ``column``."""
        return tables.count_matching(self.table(file_id, sheet), column, value, self._table_file(file_id)[1]).first()["Count"]

    def distinct(self, file_id: str, column: str, sheet: str | None = None) -> DataFrame:
        """``(value)``: the different values of a column in the order they first come."""
        return tables.distinct_values(self.table(file_id, sheet), column, "_order").select("value")

    def export(self, file_id: str, path: str, conditions=None, *, kind: str = "csv", sheet: str | None = None, **request: Any) -> str:
        """Write the rows that ``filter`` gives under ``path``, as ``csv`` or ``xlsx`` part files; returns the path."""
        found = self.filter(file_id, conditions, sheet=sheet, **request)
        if kind == "csv":
            write_csv(found, path)
        elif kind == "xlsx":
            rows = materialize(found.withColumn("_order", F.monotonically_increasing_id()), "exported")
            export_workbooks(rows, "_order", found.columns).write.parquet(path)
        else:
            raise RequestError(f"An export is csv or xlsx, not {kind!r}.")
        return path

    # ---- graph and knowledge ----

    def add_graph(self, nodes: DataFrame, edges: DataFrame, batch: str | None = None) -> DataFrame:
        """Add nodes and then the edges whose ends are known; returns the edges that were refused."""
        batch, stamp = batch or uuid.uuid4().hex, self._now()
        none = F.create_map().cast("map<string,string>")
        self._write("nodes", _with_default(nodes, "properties", none).withColumn("created_at", stamp), batch)
        valid, refused = graph.check_edges(_with_default(edges, "properties", none), self.nodes)
        self._write("edges", valid.withColumn("created_at", stamp), batch)
        return refused

    def add_triples(self, triples: DataFrame, batch: str | None = None) -> None:
        self._write("triples", triples.withColumn("created_at", self._now()), batch or uuid.uuid4().hex)

    def traverse(self, starts: DataFrame, relationship: str = "") -> DataFrame:
        """``(start, id, type, properties)`` of the nodes one step from each ``start``."""
        return graph.traverse(starts, self.edges, self.nodes, relationship)

    def within_hops(self, starts: DataFrame, hops: int, relationship: str = "") -> DataFrame:
        """``(start, id, hop)`` of the nodes within ``hops`` steps."""
        return graph.traverse_hops(starts, self.edges, hops, relationship)

    def match(self, patterns: Sequence[Sequence[str | None]]) -> DataFrame:
        """A column for each variable of the patterns ``(s, p, o)``, a row for each way all of them hold."""
        return triples.match_patterns(self.triples, patterns)

    # ---- questions ----

    def _asked(self, questions: DataFrame) -> DataFrame:
        """The questions with their ``vector``."""
        asked = self.embed(questions.select(F.col("query_id").cast("string").alias("id"), F.col("text").alias("content")))
        asked = asked.select(F.col("doc_id").alias("_id"), F.col("embedding").alias("vector"))
        return questions.join(asked, F.col("query_id").cast("string") == F.col("_id"), "left").drop("_id")

    def search(self, questions: DataFrame, k: int = 10) -> DataFrame:
        """What all stores hold for ``(query_id, text[, filters, databases])``, in one envelope (``hybrid_union``)."""
        return hybrid.hybrid_union(
            self._asked(questions), documents=self.documents, vectors=self.vectors, nodes=self.nodes, edges=self.edges,
            triples=self.triples, k=k,
        )

    def ranked(
        self, questions: DataFrame, user_id: str | None = None, file_ids: Any = None, k: int = 10, metadata: Mapping[str, str] | None = None
    ) -> DataFrame:
        """Weighted hybrid ranking for ``(query_id, text)`` over all, one owner's, or some files, or those with this ``metadata``."""
        documents, vectors = self._scope(user_id, file_ids), self.vectors
        if metadata:
            fits = reduce(lambda a, b: a & b, [F.element_at("metadata", F.lit(key)) == F.lit(value) for key, value in metadata.items()])
            described = documents.withColumn("metadata", ingest.document_metadata())
            documents = described.filter(fits).drop("metadata")
        if user_id is not None or file_ids is not None or metadata:
            vectors = vectors.join(documents.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
        return hybrid.hybrid_weighted(documents, vectors, self._asked(questions), k, doc_id="id", content="content")

    def _scope(self, user_id: str | None, file_ids: Any) -> DataFrame:
        documents = self.documents if user_id is None else owned_by(self.documents, user_id)
        return in_files(documents, file_ids, "id")

    def prompts(
        self, questions: DataFrame, user_id: str | None = None, file_ids: Any = None, k: int = 10, metadata: Mapping[str, str] | None = None
    ) -> DataFrame:
        """``(query_id, prompt, sources)``: each question with the texts that rank best for it."""
        ranked = self.ranked(questions, user_id, file_ids, k, metadata)
        contexts = answers.assemble_context(ranked, self.documents, doc_id="id", content="content")
        return answers.build_prompts(questions, contexts)

    def prompts_from_all(self, questions: DataFrame, k: int = 10) -> DataFrame:
        """``(query_id, prompt, sources)`` with what ``search`` finds in all stores, store by store, each piece once.

        A document gives its text, a node its id and type, a triple its three parts; of each store the best ``k`` pieces count.
        """
        hits = self.search(questions, k)
        known = F.col("source_rank") < 2
        part = lambda key: F.element_at("payload", F.lit(key))
        piece = F.when(known, F.concat(F.lit("document:"), "id")).when(
            F.col("source_rank") == 2, F.concat(F.lit("node:"), "id")
        ).otherwise(F.concat(F.lit("triple:"), F.concat_ws(" ", part("s"), part("p"), part("o"))))
        text = F.when(F.col("source_rank") == 2, F.concat_ws(" ", "id", part("type"))).when(
            F.col("source_rank") == 3, F.concat_ws(" ", part("s"), part("p"), part("o"))
        )
        hits = hits.select("query_id", "source_rank", F.coalesce("score", F.lit(0.0)).alias("score"), piece.alias("doc_id"), text.alias("text"))
        best = hybrid.top_k(hits.distinct(), k, by=("query_id", "source_rank"))
        best = materialize(best.drop("rank"), "pieces")
        once = tables.keep_one(best, ["query_id", "doc_id"], [F.col("source_rank").asc()])
        order = Window.partitionBy("query_id").orderBy("source_rank", F.desc("score"), "doc_id")
        ranked = once.withColumn("rank", F.row_number().over(order))
        texts = self.documents.select(F.concat(F.lit("document:"), "id").alias("id"), "content").unionByName(
            best.filter("text is not null").select(F.col("doc_id").alias("id"), F.col("text").alias("content")).distinct()
        )
        return answers.build_prompts(questions, answers.assemble_context(ranked, texts, doc_id="id", content="content"))

    def answers(self, questions: DataFrame, load_model, user_id: str | None = None, file_ids: Any = None) -> DataFrame:
        """``(query_id, answer, sources, error)`` from the user's model."""
        return answers.answer_prompts(self.prompts(questions, user_id, file_ids), load_model)


def _with_default(df: DataFrame, column: str, value: Column) -> DataFrame:
    return df if column in df.columns else df.withColumn(column, value)
