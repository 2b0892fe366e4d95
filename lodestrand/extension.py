"""What can be plugged in: memories, stores, graphs, providers, handlers, metrics and embedders. All work on DataFrames."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.operators import graph, lifecycle, retrieval
from lodestrand.session import cut

Embedder = Callable[[Column], Column]


class Memory(ABC):
    """Answers queries from a bank, and takes in new records."""

    @abstractmethod
    def retrieve(self, queries: DataFrame, k: int) -> DataFrame:
        """``qid``, ``id``, ``score``, ``rank`` for ``queries`` (``qid``, ``query``)."""

    @abstractmethod
    def extract(self, records: DataFrame) -> Memory:
        """The memory with what the records (``id``, ``text``) teach."""


_memories: dict[str, type[Memory]] = {}


def register(name: str) -> Callable[[type[Memory]], type[Memory]]:
    """Makes a class available by name; a name that is taken raises ValueError."""

    def of(cls: type[Memory]) -> type[Memory]:
        if name in _memories:
            raise ValueError(f"{name!r} is registered")
        _memories[name] = cls
        return cls

    return of


def memory(name: str, *args, **kwargs) -> Memory:
    """A new memory of a registered kind; another name raises ValueError."""
    if name not in _memories:
        raise ValueError(f"no memory {name!r}; there are {', '.join(sorted(_memories))}")
    return _memories[name](*args, **kwargs)


@register("bm25")
class WordMemory(Memory):
    """Finds by words."""

    def __init__(self, bank: DataFrame):
        self.bank = bank

    def retrieve(self, queries: DataFrame, k: int) -> DataFrame:
        return retrieval.bm25(self.bank, "id", "text", queries, k)

    def extract(self, records: DataFrame) -> WordMemory:
        return WordMemory(lifecycle.upsert(self.bank, records.select("id", "text"), "id"))


@register("vector")
class VectorMemory(Memory):
    """Finds by the vectors that the embedder makes of texts."""

    def __init__(self, bank: DataFrame, embed: Embedder):
        self.bank, self.embed = bank, embed

    def retrieve(self, queries: DataFrame, k: int) -> DataFrame:
        bank = self.bank.select("id", self.embed(F.col("text")).alias("v"))
        return retrieval.search_all(bank, "id", "v", queries.select("qid", self.embed(F.col("query")).alias("v")), k)

    def extract(self, records: DataFrame) -> VectorMemory:
        return VectorMemory(lifecycle.upsert(self.bank, records.select("id", "text"), "id"), self.embed)


def letter_vector(text: Column) -> Column:
    """An embedder without a model: shares of the letters a to z in the lower-case text."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.array(*[(F.char_length(t) - F.char_length(F.replace(t, F.lit(c)))).cast("double") for c in "abcdefghijklmnopqrstuvwxyz"])


@dataclass
class Usage:
    """Calls and tokens, added up; draining gives them and starts anew."""

    calls: int = 0
    tokens: int = 0

    def add(self, calls: int, tokens: int) -> None:
        self.calls, self.tokens = self.calls + calls, self.tokens + tokens

    def drain(self) -> tuple[int, int]:
        out = self.calls, self.tokens
        self.calls = self.tokens = 0
        return out


class Agent(ABC):
    """Injects what a memory has into prompts, learns from results, and counts what that took."""

    def __init__(self) -> None:
        self.usage = Usage()

    @abstractmethod
    def utilize(self, prompts: DataFrame) -> DataFrame:
        """Prompts (``qid``, ``query``) with ``memory``, the text to inject."""

    @abstractmethod
    def update(self, results: DataFrame) -> None:
        """Takes in results (``id``, ``text``)."""


class RecallAgent(Agent):
    """Injects the best ``k`` texts of a memory, best first."""

    def __init__(self, store: WordMemory | VectorMemory, k: int = 2):
        super().__init__()
        self.store, self.k = store, k

    def utilize(self, prompts: DataFrame) -> DataFrame:
        hits = cut(self.store.retrieve(prompts, self.k))  # few, so the bank's texts aren't shuffled
        hits = retrieval.small(hits, hits.count()).join(self.store.bank.select("id", "text"), "id")
        best = hits.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n").alias("memory"))
        self.usage.add(1, 0)
        return prompts.join(best, "qid", "left").withColumn("memory", F.coalesce("memory", F.lit("")))

    def update(self, results: DataFrame) -> None:
        self.store = self.store.extract(results)
        self.usage.add(1, 0)


class GraphStore:
    """Nodes (``id``, ...) and edges (``src``, ``dst``, ``kind``) with one contract."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges = nodes, edges

    def add_edges(self, new: DataFrame) -> GraphStore:
        return GraphStore(self.nodes, graph.add_edges(self.edges, new))

    def remove(self, gone: DataFrame) -> GraphStore:
        return GraphStore(*graph.remove_nodes(self.nodes, self.edges, gone))

    def neighbours(self, seeds: DataFrame, direction: str = "both") -> DataFrame:
        return graph.neighbours(self.edges, seeds, direction)

    def subgraph(self, centre: DataFrame, depth: int) -> DataFrame:
        return graph.subgraph(self.edges, centre, depth)


class VectorStore:
    """Rows ``id``, ``v``, ``payload`` (a map) with one contract: insert, search, keyword search, get, list, update, delete, reset."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def insert(self, new: DataFrame) -> VectorStore:
        return VectorStore(lifecycle.upsert(self.rows, new, "id"))

    def update(self, patch: DataFrame) -> VectorStore:
        return VectorStore(lifecycle.partial_update(self.rows, patch, "id"))

    def delete(self, gone: DataFrame) -> VectorStore:
        return VectorStore(self.rows.join(gone, "id", "left_anti"))

    def list(self, condition: Column | None = None) -> DataFrame:
        return self.rows if condition is None else self.rows.filter(condition)

    def search(self, queries: DataFrame, k: int, condition: Column | None = None) -> DataFrame:
        return retrieval.search_all(self.list(condition), "id", "v", queries, k)

    def keyword_search(self, queries: DataFrame, k: int, field_: str = "text") -> DataFrame:
        return retrieval.bm25(self.rows.select("id", F.col("payload")[field_].alias("text")), "id", "text", queries, k)

    def reset(self) -> VectorStore:
        return VectorStore(self.rows.limit(0))


@dataclass
class Handlers:
    """What is to be done with messages, by label: those of higher priority first, those of equal priority in the order of registration."""

    known: list[tuple[int, str, Callable[[DataFrame], DataFrame]]] = field(default_factory=list)

    def register(self, label: str, handle: Callable[[DataFrame], DataFrame], priority: int = 0) -> None:
        self.known.append((priority, label, handle))

    def run(self, messages: DataFrame) -> list[DataFrame]:
        """The results, in the order in which the handlers run; a label without a handler is left alone."""
        return [handle(messages.filter(F.col("label") == label)) for _, label, handle in sorted(self.known, key=lambda x: -x[0])]


def best_over_golds(metric: Callable[[Column, Column], Column], predicted: Column, golds: Column) -> Column:
    """Any metric of a prediction, the greatest over alternative gold answers; null where there are none."""
    return F.array_max(F.transform(golds, lambda g: metric(predicted, g)))


def installed(name: str, source: str) -> type[Memory]:
    """A memory class from code that names it ``Provided``: checked, run, and registered. Code that runs other code or touches the
    system, or that has no such class, raises ValueError."""
    from lodestrand.functions.checks import _is_dangerous

    if _is_dangerous(source):
        raise ValueError("the code isn't allowed")
    space: dict = {"Memory": Memory, "WordMemory": WordMemory, "VectorMemory": VectorMemory, "F": F}
    exec(source, space)  # noqa: S102
    cls = space.get("Provided")
    if not (isinstance(cls, type) and issubclass(cls, Memory)):
        raise ValueError("the code has no class Provided")
    return register(name)(cls)
