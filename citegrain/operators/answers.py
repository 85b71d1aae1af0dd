"""Prompts, answers and answer records for whole question tables.

A question has at most 20 hits, so gathering a question's hits into one row is bounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrain.functions.text import chunk_label, context_block, hard_preview, preview, strip
from citegrain.operators.vectors import PREVIEW_CHARS, confidence_of

# Prompt styles, prompt texts and the texts of the model-free answer.
STYLES = ("v1", "v2")
DEFAULT_STYLE = "v1"
DEFAULT_PROVIDER = "echo"
PROMPTS = {
    "v1": (
        "你是一个严谨的AI助理。请只基于给定的上下文回答。\n"
        "如果上下文不足，请明确说“根据当前检索内容无法确定”。\n"
        "回答后请列出你使用到的来源标签。\n\n"
        "问题：{question}\n\n"
        "上下文：\n{context}\n\n"
        "请输出：\n"
        "1) 简明答案\n"
        "2) 来源标签列表"
    ),
    "v2": (
        "你是一个严谨的RAG问答助手。只能依据给定上下文回答，不可臆测。\n"
        "若上下文不足，必须明确写“根据当前检索内容无法确定”。\n"
        "必须在回答末尾给出“引用”小节，格式为 [doc#chunk]。\n\n"
        "问题：{question}\n\n"
        "上下文：\n{context}\n\n"
        "输出要求：\n"
        "1) 答案：1-3句话，直接回答问题\n"
        "2) 引用：列出使用到的来源标签（如 [rag_design.txt#chunk0]）"
    ),
}
ECHO_ANSWER = (
    "[echo-rag:{style}] 问题: {question}\n"
    "基于检索片段的示例回答: {context}\n"
    "提示: 这是调试模式。设置 LLM_PROVIDER=ollama 或 deepseek 获取真实生成回答。"
)
NO_CONTEXT_ANSWER = "未检索到可用上下文，无法回答。"
ECHO_PREFIX = "[echo] "
ECHO_BLOCKS = 2
ECHO_CHARS = 80
ECHO_JOIN = "；"
#: First characters of a text on which a record without a generator depends; one more than shown tells whether it is cut.
SHOWN_CHARS = max(PREVIEW_CHARS, ECHO_CHARS) + 1


def _filled(template: str, **values: Column) -> Column:
    """The template with its ``{name}`` places taken by columns; their text is not looked into."""
    parts: list[Column] = []
    rest = template
    for name in sorted(values, key=lambda n: template.index("{" + n + "}")):
        head, rest = rest.split("{" + name + "}", 1)
        parts += [F.lit(head), values[name]]
    return F.concat(*parts, F.lit(rest))


def normalized_style(style: Column, default: str = DEFAULT_STYLE) -> Column:
    cleaned = F.lower(strip(style))
    return F.when(cleaned.isin(*STYLES), cleaned).otherwise(F.lit(default))


def prompt_text(question: Column, context: Column, style: Column, prompts: dict[str, str] = PROMPTS) -> Column:
    fallback = _filled(prompts[DEFAULT_STYLE], question=question, context=context)
    text = F.when(style == "v2", _filled(prompts["v2"], question=question, context=context))
    return text.otherwise(fallback)


def echo_answer(question: Column, texts: Column, style: Column) -> Column:
    """The model-free answer: the heads of the first two context texts in a fixed frame."""
    heads = F.transform(F.slice(texts, 1, ECHO_BLOCKS), lambda t: hard_preview(t, ECHO_CHARS))
    answer = _filled(
        ECHO_ANSWER, style=style, question=question, context=F.array_join(heads, ECHO_JOIN)
    )
    return F.when(F.size(texts) > 0, answer).otherwise(F.lit(NO_CONTEXT_ANSWER))


def echo_prompt(prompt: Column) -> Column:
    return F.concat(F.lit(ECHO_PREFIX), prompt)


def with_hits(questions: DataFrame, hits: DataFrame, key: str = "qid") -> DataFrame:
    """Each question with its hits in rank order in ``hits``; no hits is an empty list."""
    ranked = hits.groupBy(key).agg(
        F.array_sort(
            F.collect_list(F.struct("rank", "doc_name", "chunk_id", "score", "text"))
        ).alias("hits")
    )
    empty = F.array().cast(ranked.schema["hits"].dataType)
    return questions.join(ranked, key, "left").withColumn("hits", F.coalesce("hits", empty))


def _label(hit: Column) -> Column:
    return chunk_label(hit["doc_name"], hit["chunk_id"])


def context_text(hits: Column) -> Column:
    blocks = F.transform(hits, lambda h: context_block(_label(h), h["text"]))
    return F.array_join(blocks, "\n\n")


def prompts(
    questions: DataFrame, hits: DataFrame, key: str = "qid", style: Column | None = None
) -> DataFrame:
    """``key, query, prompt_style, context, prompt`` for every question."""
    chosen = normalized_style(F.lit(None).cast("string") if style is None else style)
    return with_hits(questions.withColumn("prompt_style", chosen), hits, key).select(
        key,
        "query",
        "prompt_style",
        context_text(F.col("hits")).alias("context"),
    ).withColumn("prompt", prompt_text(F.col("query"), F.col("context"), F.col("prompt_style")))


def answer_records(
    questions: DataFrame,
    hits: DataFrame,
    key: str = "qid",
    provider: str = DEFAULT_PROVIDER,
    style: Column | None = None,
    generate: Callable[[Column], Column] | None = None,
    max_chars: int = PREVIEW_CHARS,
) -> DataFrame:
    """One answer record per question: answer, confidence, grounded, citations and sources.

    *generate* makes an answer column from the prompt column, as a pandas UDF does; without it
    the model-free answer is used. *style* is the requested prompt style, normalized here.
    """
    chosen = normalized_style(F.lit(None).cast("string") if style is None else style)
    rows = with_hits(questions.withColumn("prompt_style", chosen), hits, key)
    found, question, wanted = F.col("hits"), F.col("query"), F.col("prompt_style")
    if generate is None:
        answer = echo_answer(question, F.transform(found, lambda h: h["text"]), wanted)
    else:
        answer = generate(prompt_text(question, context_text(found), wanted))
    sources = F.transform(
        found,
        lambda h: F.struct(
            h["doc_name"].alias("doc_name"),
            h["chunk_id"].alias("chunk_id"),
            F.round(h["score"], 6).alias("score"),
            preview(h["text"], max_chars).alias("text"),
        ),
    )
    return rows.select(
        key,
        F.lit(provider).alias("provider"),
        question.alias("question"),
        "prompt_style",
        answer.alias("answer"),
        confidence_of(F.get(found, F.lit(0))["score"]).alias("confidence"),
        (F.size(found) > 0).alias("grounded"),
        F.transform(found, _label).alias("citations"),
        sources.alias("sources"),
    )
