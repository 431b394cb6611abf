"""Embedders: an injected client called in batches, with a fallback for failures that may pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Client = Callable[[list[str]], list[list[float]]]


class Recoverable(Exception):
    """A failure that may pass: a time-out, a full queue, an error of the server."""


def is_recoverable(status: Column) -> Column:
    """408, 429 and 5xx may pass; every other status is final."""
    return status.isin(408, 429) | status.between(500, 599)


def embedded(texts: DataFrame, client: Client, text: str = "text", batch: int = 96, fallback: Client | None = None, mode: str | None = None, dim: int | None = None) -> DataFrame:
    """The rows with `vector`, `error`, `recovered` and `primary_error`, the order of rows and texts kept.

    A batch that fails for good, or whose answer has another length, or vectors of another dimension than `dim`, fails its
    own rows only. After a Recoverable failure, and no other, the fallback, if any, gets the same batch: `primary_error`
    then says why, and `recovered` whether it helped. With `mode` ("query" or "document") clients that read both
    differently are called with it as their second argument.
    """
    if mode not in (None, "query", "document"):
        raise ValueError(f"unknown mode {mode!r}")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema)

    def ask(part: list[str]) -> tuple[list, str | None, bool, str | None]:
        first = None
        for c in (client, fallback):
            if c is None:
                break
            try:
                got = c(part) if mode is None else c(part, mode)
                if len(got) != len(part):
                    return [None] * len(part), f"{len(got)} vectors for {len(part)} texts", False, first
                if dim is not None and any(len(v) != dim for v in got):
                    return [None] * len(part), f"vectors of another dimension than {dim}", False, first
                return got, None, first is not None, first
            except Recoverable as e:
                if first is not None:
                    return [None] * len(part), f"{first}; fallback recoverable: {e}"[:400], False, first
                first = f"recoverable: {e}"[:200]
            except Exception as e:  # noqa: BLE001  a batch that fails is rows with an error
                return [None] * len(part), (f"{first}; fallback terminal: {e}" if first else f"terminal: {e}")[:400], False, first
        return [None] * len(part), first, False, first

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vectors, told = [], []
            for at in range(0, len(pdf), batch):
                part = pdf[text].iloc[at : at + batch].tolist()
                got, *rest = ask(part)
                vectors += got
                told += [rest] * len(part)
            yield pdf.assign(vector=vectors, error=[x[0] for x in told], recovered=[x[1] for x in told], primary_error=[x[2] for x in told])

    return texts.mapInPandas(work, f"{schema}, vector array<float>, error string, recovered boolean, primary_error string")


def scored(pairs: DataFrame, judge: Callable[[str, str], str], question: str = "q", text: str = "text") -> DataFrame:
    """The pairs with `answer`, what an injected judge says of a text to a question; null where it fails."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)

    def one(q: str, x: str) -> str | None:
        try:
            return judge(q, x)
        except Exception:  # noqa: BLE001
            return None

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(answer=[one(q, x) for q, x in zip(pdf[question], pdf[text])])

    return pairs.mapInPandas(work, f"{schema}, answer string")


def judge_prompt(question: Column, text: Column) -> Column:
    return F.format_string("Question: %s\n\nPassage: %s\n\nHow well does the passage answer the question? Reply 0 (not), 1 (in part) or 2 (directly).", question, text)
