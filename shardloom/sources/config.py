"""Experiment configurations: reading, validation, and what a run may reuse."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession

LOGIC_ID = re.compile(r"^logic_[a-z0-9_]+$")
# The keys of a configuration that its result table repeats.
SPEC = ("llm_model", "embedding_provider", "embedding_base_url", "embedding_model", "search_logic_id", "chunking_logic_id", "reranking_logic_id", "tokenizer_logic_id", "prompt_logic_id", "ingest_pipeline_id", "top_k", "qa_dataset", "document_set_id", "ragas_enabled", "langfuse_enabled")
_SUFFIXES = (".yaml", ".yml", ".json")


@dataclass(frozen=True)
class Experiment:
    """A configuration; wrong values raise ValueError."""

    research_pair_id: str
    search_logic_id: str
    chunking_logic_id: str
    reranking_logic_id: str
    tokenizer_logic_id: str
    prompt_logic_id: str
    top_k: int
    qa_dataset: str
    document_set_id: str
    llm_model: str | None = None
    llm_temperature: float | None = None
    llm_request_timeout_seconds: float | None = None
    embedding_provider: str | None = None
    embedding_model: str | None = None
    ingest_pipeline_id: str | None = None
    ragas_enabled: bool = False
    rag_hybrid_delegate: str | None = None
    llm_api_base_url: str | None = None
    embedding_base_url: str | None = None
    langfuse_enabled: bool | None = None

    def __post_init__(self):
        put = lambda k, v: object.__setattr__(self, k, v)
        if not 1 <= len(self.research_pair_id) <= 128:
            raise ValueError("research_pair_id has 1 to 128 characters")
        if not 1 <= self.top_k <= 500:
            raise ValueError("top_k is 1 to 500")
        for f in fields(self):
            if f.name.endswith("_logic_id"):
                v = getattr(self, f.name).strip().lower().replace("-", "_")
                if not LOGIC_ID.match(v):
                    raise ValueError(f"{f.name} doesn't name a logic: {v}")
                put(f.name, v)
        if self.llm_temperature is not None and not 0 <= self.llm_temperature <= 2:
            raise ValueError("llm_temperature is 0 to 2")
        if self.llm_request_timeout_seconds is not None and self.llm_request_timeout_seconds < 1:
            raise ValueError("llm_request_timeout_seconds is 1 at least")
        put("embedding_provider", (self.embedding_provider or "").strip().lower() or None)
        if self.rag_hybrid_delegate is not None:
            put("rag_hybrid_delegate", "keyword_search" if self.rag_hybrid_delegate.strip().lower() in ("keyword", "keyword_search") else "vector_search")
        for name in ("qa_dataset", "document_set_id"):
            inside(getattr(self, name))

    def canonical(self) -> str:
        """Keys sorted, other alphabets kept."""
        return json.dumps(asdict(self), sort_keys=True, ensure_ascii=False)

    def spec(self) -> str:
        """What a result table says of its configuration: the keys of SPEC, sorted, as JSON."""
        return json.dumps({k: getattr(self, k) for k in SPEC}, sort_keys=True, ensure_ascii=False)

    def ingest_fingerprint(self) -> str:
        """Equal for experiments whose vector records are the same, so that one may reuse the other's."""
        parts = (self.chunking_logic_id, self.document_set_id, self.ingest_pipeline_id, self.embedding_provider, self.embedding_base_url, self.embedding_model)
        return hashlib.sha256(json.dumps(parts).encode()).hexdigest()[:16]


def inside(name: str) -> str:
    """A relative path that stays in its root, else ValueError."""
    path = PurePosixPath(name)
    if not name.strip() or path.is_absolute() or ".." in path.parts:
        raise ValueError(f"path leaves its root: {name!r}")
    return name


def parse(text: str, suffix: str) -> Experiment:
    if suffix == ".json":
        data = json.loads(text)
    else:
        import yaml  # only for YAML files

        data = yaml.safe_load(text)
    if not isinstance(data, dict):
        raise ValueError("a configuration is an object")
    known = {f.name for f in fields(Experiment)}
    if unknown := sorted(set(data) - known):
        raise ValueError(f"unknown keys: {unknown}")
    return Experiment(**data)


def read_experiment(folder: str, name: str) -> Experiment:
    """By id, trying the suffixes in turn, or by file name, of which the last part counts unless it is absolute."""
    path = Path(name)
    if path.suffix in _SUFFIXES:
        found = [path if path.is_absolute() else Path(folder, path.name)]
    else:
        found = [Path(folder, f"{name}{s}") for s in _SUFFIXES]
    for p in found:
        if p.exists():
            return parse(p.read_text(encoding="utf-8"), p.suffix)
    raise FileNotFoundError(name)


def as_rows(spark: SparkSession, experiments: list[Experiment]) -> DataFrame:
    """research_pair_id, top_k, fingerprint and canonical JSON of each experiment."""
    rows = [(e.research_pair_id, e.top_k, e.ingest_fingerprint(), e.canonical()) for e in experiments]
    return spark.createDataFrame(rows, "research_pair_id string, top_k int, fingerprint string, spec string")


def with_top_k(e: Experiment, top_k: int) -> Experiment:
    return replace(e, top_k=top_k)
