"""Answers with sources: retrieval, context, prompt, generation, as joins over questions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from inspect import signature

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import filled, shortened
from lodestone.operators.embedding import with_retries

# How a context is laid out, and the answer where nothing was found.
CONTEXT_LABEL, CONTEXT_JOINER = "文档", "\n\n---\n\n"
NO_EVIDENCE = "当前知识库中缺少与您问题相关的证据，无法给出确切结论。请尝试换一种表述，或补充更多临床信息。"

#: Templates by name; {context} and {question} are filled once and never read again.
TEMPLATES = {
    "answer": "Context\n{context}\n\nTask\n{question}\n\nReply in a few sentences and quote the labels of the passages behind each one.",
    "refine": "Earlier answer:\n\n{context}\n\nFollow-up: {question}\n\nImprove the answer without adding what it doesn't support.",
    "differential": "Case:\n\n{context}\n\nQuestion: {question}\n\nList what could explain the case, with what speaks for and against each.",
    "guideline": "Guideline passages:\n\n{context}\n\nTopic: {question}\n\nSummarise what the passages recommend.",
}
WARNINGS = {
    "emergency": "If this is an emergency, call the emergency services now.",
    "medication": "Change no medication without asking a doctor or pharmacist.",
    "diagnosis": "This is no diagnosis; a doctor has to see the patient.",
    "evidence": "The passages found support this only in part.",
}
SYSTEM = "You reply from given passages and cite them."
MAX_QUESTION, MAX_TOP_K = 2000, 50

#: prompts -> answers, in order.  One with a parameter `system` is given the system prompt by
#: itself; for any other it stands before the prompt.
Generator = Callable[..., list[str]]


class NoSystemPrompt(Exception):
    """What a generator raises that turns out to take no system prompt; it gets it before the prompt then."""


def valid_questions(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose question has 1 to 2000 characters and whose top_k is null or 1 to 50, and the others."""
    long = F.char_length(F.coalesce("question", F.lit("")))
    good = long.between(1, MAX_QUESTION) & (F.col("top_k").isNull() | F.col("top_k").between(1, MAX_TOP_K))
    return questions.filter(good), questions.filter(~good)


def contexts(hits: DataFrame) -> DataFrame:
    """qid and the labelled texts of its hits in rank order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: F.concat(F.lit(f"[{CONTEXT_LABEL}"), x["rank"].cast("string"), F.lit("]\n"), x["text"]))
    return hits.groupBy("qid").agg(F.array_join(parts, CONTEXT_JOINER).alias("context"))  # k texts a question


def sources(hits: DataFrame, size: int = 200) -> DataFrame:
    """qid and an array of (text, metadata, score) in rank order, texts shortened."""
    row = F.struct("rank", shortened(F.col("text"), size).alias("text"), "metadata", "score")
    cut = F.transform(F.array_sort(F.collect_list(row)), lambda x: x.dropFields("rank"))
    return hits.groupBy("qid").agg(cut.alias("sources"))


def prompt(context: Column, question: Column, template: str = TEMPLATES["answer"]) -> Column:
    return filled(template, context=context, question=question)


def extractive(prompts: list[str]) -> list[str]:
    """An answer without a model: the first labelled text of the prompt."""
    mark, after = f"[{CONTEXT_LABEL}1]\n", TEMPLATES["answer"].partition("{context}")[2].partition("{question}")[0]
    return [p.partition(mark)[2].partition(CONTEXT_JOINER)[0].rpartition(after)[0].strip() or p.partition(mark)[2].partition(CONTEXT_JOINER)[0].strip() or NO_EVIDENCE for p in prompts]


def with_system(generate: Generator, system: str | None) -> Callable[[list[str]], list[str]]:
    """A generator of prompts alone."""
    if not system or generate is extractive:
        return generate
    apart = "system" in signature(generate).parameters

    def run(prompts: list[str]) -> list[str]:
        if apart:
            try:
                return generate(prompts, system=system)
            except NoSystemPrompt:
                pass
        return generate([f"{system}\n\n{p}" for p in prompts])

    return run


def generated(rows: DataFrame, generate: Generator, column: str = "prompt", system: str | None = None) -> DataFrame:
    """rows with `answer`, stripped of white space at the ends."""

    call = with_retries(with_system(generate, system))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(answer=[x.strip() for x in call(part[column].tolist())])

    return rows.mapInPandas(run, T.StructType([*(f for f in rows.schema.fields if f.name != "answer"), T.StructField("answer", T.StringType())]))


def answers(questions: DataFrame, hits: DataFrame, generate: Generator = extractive, template: str = TEMPLATES["answer"], system: str | None = None) -> DataFrame:
    """qid, question, answer, sources, context.  The generator never sees a question without hits:
    those get the fixed answer, no sources and an empty context."""
    asked = questions.select("qid", "question").join(contexts(hits), "qid", "left").join(sources(hits), "qid", "left")
    found = asked.filter(F.col("context").isNotNull()).withColumn("prompt", prompt(F.col("context"), F.col("question"), template))
    told = generated(found, generate, system=system).select("qid", "question", "answer", "sources", "context")
    nothing = asked.filter(F.col("context").isNull()).select("qid", "question", F.lit(NO_EVIDENCE).alias("answer"), F.array().cast(told.schema["sources"].dataType).alias("sources"), F.lit("").alias("context"))
    return told.unionByName(nothing)


def events(rows: DataFrame) -> DataFrame:
    """qid, seq, event, data: the sources, then the answer's words one by one, then the end."""
    words = F.filter(F.split("answer", r"(?<=\s)(?=\S)", -1), lambda x: x != "")
    first = F.struct(F.lit("sources").alias("event"), F.to_json(F.struct("sources")).alias("data"))
    each = F.transform(words, lambda x: F.struct(F.lit("token").alias("event"), F.to_json(F.struct(x.alias("text"))).alias("data")))
    last = F.struct(F.lit("done").alias("event"), F.lit("{}").alias("data"))
    return rows.select("qid", F.posexplode(F.concat(F.array(first), each, F.array(last)))).select("qid", F.col("pos").alias("seq"), "col.event", "col.data")


def framed(event: Column, data: Column) -> Column:
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))


def parsed(frames: Column) -> Column:
    """Frames joined in one text back to an array of (event, data)."""
    parts = F.filter(F.split(frames, "\n\n", -1), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(F.regexp_extract(x, "(?m)^event: (.*)$", 1).alias("event"), F.regexp_extract(x, "(?m)^data: (.*)$", 1).alias("data")))
