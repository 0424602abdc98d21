"""From ranked documents to prompts and answers, for whole tables of questions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

def assemble_context(
    ranked: DataFrame, documents: DataFrame, *, doc_id: str, content: str, budget: int | None = None
) -> DataFrame:
    """``(query_id, context, sources)``: the ranked texts joined by a blank line, whole and all of them.

    Only with a ``budget`` of characters is the context cut: a text is then taken while the texts before it and it fit,
    and the first that does not is cut to what is left. The ranking is written out first: it is small, so
    adaptive execution can send it to the document scan and only ranked texts move. A query's group is its top-k rows.
    """
    wanted = materialize(ranked.select("query_id", "doc_id", "rank"), "ranking")
    text = F.col(content) if budget is None else F.substring(content, 1, budget)
    found = documents.select(F.col(doc_id).alias("doc_id"), text.alias("text")).join(wanted, "doc_id")
    if budget is not None:
        ordered = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
        left = F.lit(budget) - F.coalesce(F.sum(F.length("text")).over(ordered), F.lit(0))
        found = found.withColumn("_left", left).filter("_left > 0").withColumn(
            "text", F.substring(F.col("text"), F.lit(1), F.col("_left").cast("int"))
        )
    return found.groupBy("query_id").agg(
        F.expr("listagg(text, '\n\n') within group (order by rank)").alias("context"),
        F.expr("listagg(cast(doc_id as string), ',') within group (order by rank)").alias("sources"),
    )


def build_prompts(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """``(query_id, prompt, sources)`` for every question; no context found is an empty one."""
    return questions.join(contexts, "query_id", "left").select(
        "query_id",
        F.concat(
            F.lit("Context:\n"),
            F.coalesce("context", F.lit("")),
            F.lit("\n\nQuestion: "),
            F.col("text"),
            F.lit("\n\nAnswer:"),
        ).alias("prompt"),
        F.coalesce("sources", F.lit("")).alias("sources"),
    )


def answer_prompts(
    prompts: DataFrame, load_model: Callable[[], Callable[[Sequence[str]], Sequence[str]]]
) -> DataFrame:
    """``(query_id, answer, sources, error)`` from a user model, loaded once per worker stream.

    The model gets a batch of prompts at a time. A prompt the model fails on becomes a row with ``error``; the job goes on.
    """
    schema = T.StructType(
        [
            prompts.schema["query_id"],
            T.StructField("answer", T.StringType()),
            T.StructField("sources", T.StringType()),
            T.StructField("error", T.StringType()),
        ]
    )

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_model()
        for batch in batches:
            prompts = batch["prompt"].tolist()
            try:
                answers, errors = list(model(prompts)), [None] * len(prompts)
                if len(answers) != len(prompts):
                    raise ValueError("the model gave another number of answers")
            except Exception:  # some prompt of the batch fails: ask one by one
                answers, errors = [], []
                for prompt in prompts:
                    try:
                        answers.append(model([prompt])[0])
                        errors.append(None)
                    except Exception as exc:  # any model failure is this row's, not the job's
                        answers.append(None)
                        errors.append(f"{type(exc).__name__}: {exc}")
            yield pd.DataFrame(
                {"query_id": batch["query_id"], "answer": answers, "sources": batch["sources"], "error": errors}
            )

    return prompts.select("query_id", "prompt", "sources").mapInPandas(answer, schema)
