"""Choice of logic by id: chunkers, tokenizers, searches, rerankers and prompts, ingest pipelines in place of some of them, and models by provider."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from shardloom.functions import models
from shardloom.functions import text as tx
from shardloom.operators import chunking, rerank, search
from shardloom.operators import structure as st
from shardloom.plans import structure_v2
from shardloom.sources.config import Experiment

CATEGORIES = ("chunking", "tokenizer", "search", "reranking", "prompt")
STAGES = frozenset({"convert", "normalize", "chunking"})


@dataclass(frozen=True)
class IngestPipeline:
    """Ingests files (path, content) itself: ``ingest`` maps them and the experiment's chunker to chunks.

    Chunks have source, chunk_text and chunk_no, and may have vector_texts and the columns of
    store.HIERARCHY. ``superseded`` names the stages that it stands for; where chunking is among them there
    is no chunker (None), and the experiment's isn't looked up.
    """

    name: str
    superseded: frozenset[str]
    ingest: Callable[[DataFrame, Callable[[DataFrame], DataFrame] | None], DataFrame]

    def __post_init__(self):
        if unknown := set(self.superseded) - STAGES:
            raise ValueError(f"no such stages: {sorted(unknown)}")
        if not callable(self.ingest):
            raise TypeError(f"{self.name} has no ingest function")


@dataclass(frozen=True)
class Reranker:
    """``rank`` maps candidates and the top_k asked for to ranked rows with effective_top_k; ``without_hits`` gives that of a question that found nothing."""

    rank: Callable[[DataFrame, int], DataFrame]
    without_hits: Callable[[int], int]


def _recursive(docs: DataFrame) -> DataFrame:
    return chunking.recursive_chunks(docs)


def _plain_structure(docs: DataFrame) -> DataFrame:
    chunks = st.structure_chunks(docs, most=1000, tail=False)
    return chunks.withColumn("chunk_text", tx.stripped(tx.without_prefixes(chunks["chunk_text"]))).where("chunk_text <> ''")


#: Functions of each category by id. Chunkers map documents (doc_id, text) to chunks with chunk_text.
_LOGIC: dict[str, dict[str, object]] = {
    "chunking": {
        "logic_01": _recursive,
        "logic_02": lambda docs: structure_v2.structure_chunks_v2(docs).withColumnRenamed("chunk_role", "role"),
        "logic_03": lambda docs: st.structure_chunks(docs, most=1000, tail=False, repair=False, two_levels=True),
        "logic_04": lambda docs: st.structure_chunks(docs, most=1000, tail=False),
        "logic_05": _plain_structure,
        "logic_06": lambda docs: st.with_vector_texts(st.structure_chunks(docs, most=1000)),
    },
    "tokenizer": {"logic_01": tx.query_tokens},
    "search": {"logic_01": "vector", "logic_02": "none", "logic_03": "vector"},
    "reranking": {
        "logic_01": Reranker(rerank.identity, lambda k: k),
        "logic_02": Reranker(rerank.hierarchical, lambda k: 0),
        "logic_03": Reranker(lambda c, k: rerank.hierarchical(c, k, cut_at_average=False), lambda k: 0),
    },
}

_ROLE = "You answer from the context alone."
_UNKNOWN = "If the context doesn't say it, answer that you don't know."
#: System prompts by id, in this package's own words.
_PROMPTS = {
    "logic_01": f"{_ROLE} Be exact and short, don't guess, and name the source. {_UNKNOWN}",
    "logic_02": f"{_ROLE} Be exact and short, and don't guess. {_UNKNOWN}",
    "logic_03": f"{_ROLE} Answer in plain Japanese, exactly and shortly, and name the source. {_UNKNOWN}",
    "logic_04": f"{_ROLE} Answer in plain Japanese, exactly and shortly, without guesses. {_UNKNOWN}",
    "logic_05": f"{_ROLE} Answer in plain Japanese, exactly and shortly, without guesses. Where the context has nothing clear, say that the material doesn't hold it.",
    "logic_06": f"{_ROLE} Answer in plain Japanese without guesses, and say which rule or article it follows from. {_UNKNOWN}",
    "logic_07": f"{_ROLE} Answer in plain Japanese without guesses; give the conclusion first, then its grounds in the context. {_UNKNOWN}",
    "logic_08": f"{_ROLE} First find the passages that bear on the question, then answer from them step by step in plain Japanese; keep conditions and exceptions that they state. {_UNKNOWN}",
    "logic_09": f"{_ROLE} First find the passages that bear on the question and leave out others; answer in plain Japanese, conditions and exceptions included, and check each statement against them. {_UNKNOWN}",
    "logic_10": f"{_ROLE} Each block of the context begins with its headings, outer ones first: use them to tell which rule a passage belongs to. Answer in plain Japanese, conditions and exceptions included, and don't mix rules. {_UNKNOWN}",
    "logic_11": f"{_ROLE} Each block of the context begins with its headings, outer ones first. Find the blocks that bear on the question, compare them where several do, and answer in plain Japanese with the rule, its conditions, its exceptions and its source. {_UNKNOWN}",
}
_PIPELINES: dict[str, IngestPipeline] = {}


def normalised_id(raw: str | None) -> str:
    found = (raw or "").strip().lower().replace("-", "_")
    if not found:
        raise ValueError("a logic id is empty")
    return found


def ids(category: str) -> list[str]:
    return sorted(_PROMPTS if category == "prompt" else _LOGIC[category])


def resolve(category: str, logic_id: str):
    """What an id stands for; unknown categories and ids raise LookupError."""
    known = _PROMPTS if category == "prompt" else _LOGIC[category]
    if (found := normalised_id(logic_id)) not in known:
        raise LookupError(f"no {category} logic {found}; there are {', '.join(sorted(known))}")
    return known[found]


def register(category: str, logic_id: str, value) -> None:
    """Adds a logic of one's own."""
    (_PROMPTS if category == "prompt" else _LOGIC[category])[normalised_id(logic_id)] = value


def register_pipeline(pipeline: IngestPipeline) -> None:
    _PIPELINES[pipeline.name] = pipeline


def pipeline(pipeline_id: str) -> IngestPipeline:
    name = (pipeline_id or "").strip()
    if name not in _PIPELINES:
        raise LookupError(f"no ingest pipeline {name!r}")
    return _PIPELINES[name]


def chunker(logic_id: str) -> Callable[[DataFrame], DataFrame]:
    return resolve("chunking", logic_id)


def system_prompt(logic_id: str) -> str:
    text = resolve("prompt", logic_id)
    if not isinstance(text, str) or not text.strip():
        raise TypeError(f"prompt logic {logic_id} has no text")
    return text


def search_kind(e: Experiment) -> str:
    """vector, keyword or none: logic_01 and logic_03 search vectors (a chunk with several texts has several), logic_02 finds nothing.

    ``rag_hybrid_delegate`` of the configuration, where given, chooses between vectors and keywords.
    """
    kind = resolve("search", e.search_logic_id)
    if kind != "none" and e.rag_hybrid_delegate:
        return "keyword" if e.rag_hybrid_delegate == "keyword_search" else "vector"
    return kind


def preflight(e: Experiment) -> None:
    """Every logic of an experiment must be known before any work starts; the chunker is left out where a pipeline stands for it."""
    own = pipeline(e.ingest_pipeline_id) if e.ingest_pipeline_id else None
    for category in CATEGORIES:
        if category == "chunking" and own and "chunking" in own.superseded:
            continue
        resolve(category, getattr(e, f"{category}_logic_id"))
    system_prompt(e.prompt_logic_id)
    embedding(e)


def embedding(e: Experiment) -> Callable[[DataFrame, str, str], DataFrame]:
    """How an experiment's texts become vectors; an unknown provider is an error."""
    return models.embedding_of(e.embedding_provider, models.EmbeddingParams(e.embedding_base_url, e.embedding_model))


def chat_params(e: Experiment) -> models.ChatParams:
    return models.ChatParams(e.llm_model, e.llm_temperature, e.llm_request_timeout_seconds, e.llm_api_base_url)
