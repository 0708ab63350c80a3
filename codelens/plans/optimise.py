"""The optimisation loop: refine, code again, compare, until every construct agrees."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.codebook import Meta, only_constructs, refine, underperforming
from ..operators.metrics import pooled_summary
from ..scratch import materialise
from ..sources.sinks import pass_name, write_codebook


def optimise(comparison: DataFrame, codebook: DataFrame, human: DataFrame, code: Callable[[DataFrame], DataFrame], compare: Callable[[DataFrame, DataFrame], DataFrame], reruns: int = 1, threshold: float = 0.8, meta: Meta | None = None, root: str | None = None, name: str = "codebook", **sizes) -> list[DataFrame]:
    """Partial codebooks, one a pass, the first from the given comparison.

    Each rerun codes with the last partial codebook alone and compares with the humans' constructs of it.
    It ends early when no construct is below the threshold or nothing new is found.  With ``root``, each
    partial codebook is written there under a name with the number of its pass; ``meta`` is the codebook's.
    """
    about = meta or Meta(name)
    partials: list[DataFrame] = []
    current, book = comparison, codebook
    for k in range(reruns + 1):
        if k:
            llm = materialise(code(book), "coded")
            current = materialise(compare(only_constructs(human, book), llm), "comparison")
        pooled = pooled_summary(current)
        if underperforming(pooled, threshold).isEmpty():
            break
        book = materialise(refine(current, pooled, book, threshold, **sizes), "partial")
        if book.isEmpty():
            break
        partials.append(book)
        about = about.refined()
        if root:
            write_codebook(book, about, f"{root}/{pass_name(name, k + 1)}")
    return partials
