"""Pluggable embedding, chat and judge models as Arrow functions, chosen by provider, with deterministic stand-ins that need no network."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A model is made once per task by a factory. A chat model maps batches of message lists, each message a dict of role and
#: content, to answers: a text each, or a list of parts. A judge maps question, answer and contexts to faithfulness and relevancy.
Embedder = Callable[[list[str]], list[list[float]]]
Chat = Callable[[list[list[dict]]], list]
Judge = Callable[[str, str, list[str]], tuple]

ROLES = ("user", "assistant", "system")  # fixed values
MESSAGES = "array<struct<role:string,content:string>>"


@dataclass(frozen=True)
class ChatParams:
    """What a provider needs to make a chat model."""

    model: str | None = None
    temperature: float | None = None
    request_timeout_seconds: float | None = None
    api_base_url: str | None = None


@dataclass(frozen=True)
class EmbeddingParams:
    base_url: str | None = None
    model: str | None = None


_CHATS: dict[str, Callable[[ChatParams], Callable[[], Chat]]] = {}
_EMBEDDINGS: dict[str, Callable[[EmbeddingParams], Callable[[DataFrame, str, str], DataFrame]]] = {}


def _named(provider: str | None) -> str:
    return (provider or "").strip().lower()


def register_chat(provider: str, make: Callable[[ChatParams], Callable[[], Chat]]) -> None:
    """``make`` maps parameters to a factory, which tasks call."""
    _CHATS[_named(provider)] = make


def register_embedding(provider: str, make: Callable[[EmbeddingParams], Callable[[DataFrame, str, str], DataFrame]]) -> None:
    """``make`` maps parameters to a function of rows, the name of their text and document or query, which adds ``embedding``."""
    _EMBEDDINGS[_named(provider)] = make


def _found(known: dict, provider: str | None, kind: str):
    if (name := _named(provider)) not in known:
        raise ValueError(f"no {kind} provider {name!r}; there are {', '.join(sorted(known))}")
    return known[name]


def chat_factory(provider: str | None, params: ChatParams = ChatParams()) -> Callable[[], Chat]:
    """The chat models of a provider; an unknown one is a ValueError before any work starts."""
    return _found(_CHATS, provider or "echo", "chat")(params)


def embedding_of(provider: str | None, params: EmbeddingParams = EmbeddingParams()) -> Callable[[DataFrame, str, str], DataFrame]:
    return _found(_EMBEDDINGS, provider or "hashed", "embedding")(params)


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is evaluated once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _unit_counts(places: Column, dimension: int) -> Column:
    def counted(held: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda k: F.size(F.filter(held, lambda p: p == k)).cast("double"))

    def scaled(counts: Column) -> Column:
        norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
        return _once(norm, lambda n: F.transform(counts, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)).cast("float")))

    return _once(_once(places, counted), scaled)


def _words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")


def hashed_embedding(text: Column, dimension: int = 16) -> Column:
    """A stand-in: unit vector of hashed word counts, in DataFrame functions."""
    return _unit_counts(F.transform(_words(text), lambda w: F.pmod(F.xxhash64(w), F.lit(dimension)).cast("int")), dimension)


def digest_embedding(text: Column, dimension: int = 64) -> Column:
    """hashed_embedding() with places from MD5 digests, which other engines have too."""
    return _unit_counts(F.transform(_words(text), lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % dimension).cast("int")), dimension)


def _by_column(function: Callable[[Column], Column]) -> Callable[[EmbeddingParams], Callable[[DataFrame, str, str], DataFrame]]:
    from shardloom.functions.text import with_input_prefix

    return lambda params: lambda rows, text, kind: rows.withColumn("embedding", function(with_input_prefix(F.col(text), F.lit(kind))))


register_embedding("hashed", _by_column(lambda c: hashed_embedding(c, 64)))
register_embedding("digest", _by_column(lambda c: digest_embedding(c, 64)))


def embedded(rows: DataFrame, factory: Callable[[], Embedder], text: str, dimension: int) -> DataFrame:
    """``rows`` with ``embedding``, by a model; a vector of another length fails the job. Rows keep all their columns."""
    schema = T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]):
        model = factory()
        for batch in batches:
            vectors = model([t or "" for t in batch.column(text).to_pylist()])
            for v in vectors:
                if len(v) != dimension:
                    raise ValueError(f"embedding has dimension {len(v)}, not {dimension}")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*batch.schema.names, "embedding"])

    return rows.mapInArrow(run, schema)


def messages(**by_role: Column) -> Column:
    """Messages in the order given, as array<struct<role,content>>."""
    return F.array(*[F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in by_role.items()]).cast(MESSAGES)


def checked_messages(c: Column) -> Column:
    """Messages with roles in lower case and stripped; one that isn't a role fails the job."""
    role = lambda m: F.lower(F.trim(F.coalesce(m["role"], F.lit(""))))
    known = lambda m: F.when(role(m).isin(*ROLES), role(m)).otherwise(F.raise_error(F.concat(F.lit("unknown message role: "), F.coalesce(m["role"], F.lit("none")))))
    return F.transform(c, lambda m: F.struct(known(m).alias("role"), F.coalesce(m["content"], F.lit("")).alias("content")))


def _joined(answer) -> str:
    """An answer's text; parts of a list are joined."""
    return "".join(map(str, answer)) if isinstance(answer, list) else str(answer)


def asked(model: Chat, prompts: list[list[dict]], size: int, retries: int) -> list[str]:
    """Answers to all prompts, ``size`` at a time, each try repeated up to ``retries`` times; then its error stands."""
    out: list[str] = []
    for a in range(0, len(prompts), size):
        part = prompts[a : a + size]
        for left in range(retries, -1, -1):
            try:
                answers = model(part)
                if len(answers) != len(part):
                    raise ValueError(f"{len(answers)} answers to {len(part)} prompts")
                break
            except Exception:
                if not left:
                    raise
        out += [_joined(x) for x in answers]
    return out


def answered(prompts: DataFrame, factory: Callable[[], Chat], size: int = 16, retries: int = 2, done=None) -> DataFrame:
    """``prompts`` (messages, answer) with the answers of a chat model where there are messages; fixed replies stay.

    ``done``: an accumulator of answered rows, for progress.
    """
    rows = prompts.withColumn("messages", checked_messages(F.col("messages")))

    def run(batches: Iterator[pa.RecordBatch]):
        model = None
        for batch in batches:
            held, answers = batch.column("messages").to_pylist(), batch.column("answer").to_pylist()
            at = [k for k, m in enumerate(held) if m]
            if at and model is None:
                model = factory()
            for k, text in zip(at, asked(model, [held[k] for k in at], size, retries) if at else [], strict=True):
                answers[k] = text
            if done is not None:
                done.add(batch.num_rows)
            yield batch.set_column(batch.schema.get_field_index("answer"), "answer", pa.array(answers, pa.string()))

    return rows.mapInArrow(run, rows.schema)


def echo_chat() -> Chat:
    """A stand-in: the last line of the last message."""
    return lambda prompts: [p[-1]["content"].rsplit("\n", 1)[-1] for p in prompts]


register_chat("echo", lambda params: echo_chat)


def overlap_judge() -> Judge:
    """A stand-in: the share of an answer's words that its contexts have, and the cosine of word counts of question and answer."""

    def judge(question: str, answer: str, contexts: list[str]) -> tuple[float, float]:
        own, asked_ = answer.lower().split(), question.lower().split()
        known = {w for c in contexts for w in c.lower().split()}
        count = lambda words: {w: words.count(w) for w in set(words)}
        a, q = count(own), count(asked_)
        size = (sum(n * n for n in a.values()) * sum(n * n for n in q.values())) ** 0.5
        return sum(w in known for w in a) / len(a), sum(n * q.get(w, 0) for w, n in a.items()) / size if size else 0.0

    return judge


def judged(answers: DataFrame, factory: Callable[[], Judge] = overlap_judge) -> DataFrame:
    """``answers`` (question, answer, contexts) with faithfulness and relevancy as text of six decimals.

    Blank without contexts or with a blank answer, and where the judge fails or gives none: a failure costs
    its own row's cells, not the job.
    """
    schema = T.StructType([*answers.schema.fields, T.StructField("faithfulness", T.StringType()), T.StructField("relevancy", T.StringType())])

    def cell(x) -> str:
        try:
            return "" if x is None else f"{float(x):.6f}"
        except (TypeError, ValueError):
            return str(x)

    def run(batches: Iterator[pa.RecordBatch]):
        judge = None
        for batch in batches:
            cells = []
            for q, a, c in zip(*(batch.column(n).to_pylist() for n in ("question", "answer", "contexts")), strict=True):
                try:
                    if not c or not (a or "").strip():
                        raise LookupError("nothing to judge")
                    judge = judge or factory()
                    faithful, relevant = judge(q or "", a, c)
                    cells.append((cell(faithful), cell(relevant)))
                except Exception:
                    cells.append(("", ""))
            faithful, relevant = zip(*cells, strict=True) if cells else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(faithful, pa.string()), pa.array(relevant, pa.string())], names=[*batch.schema.names, "faithfulness", "relevancy"])

    return answers.mapInArrow(run, schema)
