"""Choice of a provider with a lifetime, and of a model that is not retired."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Seconds for which a choice holds. A fixed value.
LIFETIME = 300


class ModelRetired(Exception):
    """The provider does not know the model any more (status 404)."""


@dataclass(frozen=True)
class Service:
    """A provider: whether it works at a time (seconds), its models by preference, and how it is asked (model, text, time)."""

    name: str
    models: tuple[str, ...]
    works: Callable[[float], bool]
    ask: Callable[[str, str, float], str]


@dataclass
class Choice:
    """The provider in use: chosen anew once the choice is older than ``lifetime``, so that one that died in between is dropped.

    A retired model is replaced by the first of the provider's other models that answers; that one stays until the next choice.
    """

    services: tuple[Service, ...]
    lifetime: float = LIFETIME
    service: Service | None = None
    model: str | None = None
    since: float = field(default=0.0)

    def answer(self, text: str, at: float) -> str:
        if self.service is None or at - self.since > self.lifetime:
            found = next((s for s in self.services if s.works(at)), None)
            if found is None:
                raise RuntimeError("no provider")
            self.service, self.model, self.since = found, found.models[0], at
        try:
            return self.service.ask(self.model, text, at)
        except ModelRetired as retired:
            for model in self.service.models:
                if model != self.model:
                    try:
                        out = self.service.ask(model, text, at)
                    except ModelRetired:
                        continue
                    self.model = model
                    return out
            raise retired


def ask_in_order(calls: DataFrame, services: tuple[Service, ...], lifetime: float = LIFETIME) -> DataFrame:
    """Answers to ``calls`` (caller, at: timestamp, id, text): id, provider, model, answer and error.

    Each caller has a choice of its own and its calls are made in their order, so they pass through one task; they come sorted
    from the shuffle and only the choice of the present caller is held.  A call that fails is a row with an error.
    """
    kind = calls.schema["id"].dataType.simpleString()

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        caller, choice = None, None
        for b in batches:
            out = []
            for who, at, number, text in b[["caller", "_at", "id", "text"]].itertuples(index=False):
                if choice is None or who != caller:
                    caller, choice = who, Choice(services, lifetime)
                try:
                    answer, error = choice.answer(text, at / 1e6), None
                except Exception as e:
                    answer, error = None, str(e) or type(e).__name__
                out.append((number, choice.service and choice.service.name, choice.model, answer, error))
            yield pd.DataFrame(out, columns=["id", "provider", "model", "answer", "error"])

    dealt = calls.withColumn("_at", F.unix_micros("at")).filter("caller is not null and at is not null").repartition("caller").sortWithinPartitions("caller", "_at", "id")
    return dealt.select("caller", "_at", "id", "text").mapInPandas(ask, f"id {kind}, provider string, model string, answer string, error string")
