"""Limits of search and context, in two presets."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    """How many rows each step of a search keeps (free preset; ``PAID`` is the larger one)."""

    sub_queries: int = 3
    vector: int = 20
    keyword: int = 20
    parents: int = 15
    rerank: int = 4
    round_chunks: int = 10
    seeds: int = 2
    references: int = 2
    table_parts: int = 2
    chapter: int = 10
    rounds: int = 3
    context_chunks: int = 10
    context_chars: int = 16_000

    def across_documents(self) -> Limits:
        """Searches over many documents look at 30 matches and 20 parents at least."""
        from dataclasses import replace

        return replace(self, vector=max(30, self.vector), keyword=max(30, self.keyword), parents=max(20, self.parents))


FREE = Limits()
PAID = Limits(
    sub_queries=4, vector=30, keyword=30, parents=25, rerank=8, round_chunks=16, seeds=4, references=4, table_parts=4,
    chapter=16, rounds=6, context_chunks=16, context_chars=32_000,
)
#: Constant and weights of reciprocal-rank fusion.
FUSION_K = 10
WEIGHTS = {"vector": 1.0, "identifier": 2.5, "phrase": 1.5, "keyword": 1.0}
#: Words that are not searched for.
STOP_WORDS = ("what", "is", "the", "in", "of", "and", "to", "for", "a", "an", "on", "with", "how", "when", "where", "which", "did", "does")
