"""Document scans: plain text, Markdown, Office files, and one extraction job for all of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.streams import pieces
from ..functions.text import base_name, extension
from .listing import read_whole_text
from .office import read_docx, read_pptx

Extractor = Callable[[bytes], str]

# The texts that stand for a document that cannot be read, and for one without any text.
DAMAGED = "[Error processing document: %s. Error: %s]"
BLANK = "[This document appears to contain no extractable text: %s]"


def _utf8(content: bytes) -> str:
    return content.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n")


# One decoder per extension. PDF has none here: pass one in, or its files become placeholders.
EXTRACTORS: dict[str, Extractor] = {".txt": _utf8, ".md": _utf8, ".docx": read_docx, ".pptx": read_pptx}


def scan_text(spark: SparkSession, path: str | Sequence[str], pattern: str = "*.txt") -> DataFrame:
    """``(filename, path, content)``: each file one row, text verbatim."""
    return read_whole_text(spark, path, pattern).select(base_name("path").alias("filename"), "path", "content")


def markdown_sections(documents: DataFrame, *, doc_id: str, content: str) -> DataFrame:
    """``(doc_id, section_no, section)``: Markdown text cut before its headings; row-local."""
    return documents.select(
        F.col(doc_id).alias("doc_id"),
        F.posexplode(F.split(F.col(content), r"(?m)^#+ ")).alias("section_no", "section"),
    )


def extract_documents(files: DataFrame, extractors: Mapping[str, Extractor] | None = None) -> DataFrame:
    """``(file, content, error)`` from ``(file, content BINARY)``; bad input never fails the job.

    A file that cannot be read, or has no decoder, keeps a bracketed placeholder as content.
    ``file`` may be a name or a whole path.
    """
    decoders = {**EXTRACTORS, **(extractors or {})}

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in pieces(whole, "content")):
            texts, errors = [], []
            for ext, content in zip(batch["ext"].to_pylist(), batch["content"].to_pylist(), strict=True):
                try:
                    if ext not in decoders:
                        raise ValueError(f"no decoder for {ext or 'files without extension'}")
                    texts.append(decoders[ext](content))
                    errors.append(None)
                except Exception as exc:  # any damage is this file's, not the job's
                    texts.append(None)
                    errors.append(f"{type(exc).__name__}: {exc}")
            columns = [batch["file"], pa.array(texts, pa.string()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["file", "content", "error"])

    raw = files.select("file", extension("file").alias("ext"), "content").mapInArrow(
        extract, "file string, content string, error string"
    )
    name = base_name("file")
    blank = F.col("error").isNull() & (F.trim(F.coalesce("content", F.lit(""))) == "") & (extension("file") == ".pdf")
    return raw.select(
        "file",
        F.when(F.col("error").isNotNull(), F.format_string(DAMAGED, name, "error"))
        .when(blank, F.format_string(BLANK, name))
        .otherwise(F.col("content"))
        .alias("content"),
        F.when(blank, "no extractable text").otherwise(F.col("error")).alias("error"),
    )
