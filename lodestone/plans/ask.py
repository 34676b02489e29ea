"""Questions against a collection: in batches, as events, or one by one at a prompt.

    python -m lodestone.plans.ask --collection DIR [--dim N] [--top-k K]
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterable
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession

from lodestone.operators.tables import kept
from lodestone.operators.embedding import Embedder, embedded, hashing_embedder
from lodestone.plans import rag
from lodestone.plans.collection import Collection

EXIT = ("exit", "quit", "q")


class AskError(Exception):
    """A question batch that could not be planned; the cause tells the step."""


def ask(collection: Collection, questions: DataFrame, embed: Embedder, generate: rag.Generator = rag.extractive, k: int = 5, threshold: float | None = None, hybrid: bool = False, template: str = rag.TEMPLATES["answer"], system: str | None = rag.SYSTEM) -> DataFrame:
    """questions (qid, question) -> qid, question, answer, sources, context.

    Retrieval is dense; with hybrid it is fused with keyword search.
    """
    try:
        asked = kept(embedded(questions.select("qid", "question"), "question", embed, collection.dimension), "questions")  # each is embedded once
        hits = collection.hybrid_search(asked, k, threshold) if hybrid else collection.search(asked.select("qid", "vector"), k, threshold)
    except Exception as e:
        raise AskError(f"retrieval can't be planned: {e}") from e
    return rag.answers(questions, hits, generate, template, system)


def ask_events(collection: Collection, questions: DataFrame, embed: Embedder, **options) -> DataFrame:
    """The same as rows of events: sources, the answer's words, the end."""
    return rag.events(ask(collection, questions, embed, **options))


def asked_lines(lines: Iterable[str]) -> Iterable[str]:
    """Questions up to an exit word; blank lines don't count."""
    for line in lines:
        question = line.strip()
        if question.lower() in EXIT:
            return
        if question:
            yield question


def converse(collection: Collection, embed: Embedder, lines: Iterable[str] = sys.stdin, out: TextIO = sys.stdout, **options) -> None:
    for question in asked_lines(lines):
        row = ask(collection, collection.spark.createDataFrame([(0, question)], "qid int, question string"), embed, **options).first()
        print(row["answer"], file=out)
        for i, s in enumerate(row["sources"], 1):
            meta = s["metadata"].asDict() if s["metadata"] else {}
            score = "N/A" if s["score"] is None else f"{s['score']:.4f}"
            print(f"  [{i}] {meta.get('source') or meta.get('file_name') or '未知文档'} p.{meta.get('page') or '-'} {score} {s['text'][:80]}...", file=out)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--collection", required=True)
    parser.add_argument("--dim", type=int, default=1536)
    parser.add_argument("--top-k", type=int, default=5)
    args = parser.parse_args(argv)
    converse(Collection(SparkSession.builder.getOrCreate(), args.collection, args.dim), hashing_embedder(args.dim), k=args.top_k)


if __name__ == "__main__":
    main()
