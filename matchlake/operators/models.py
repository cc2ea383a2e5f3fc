"""Models that live as long as a worker process.

A task's function carries a `Model`: a name and how to make it, not the model. The first task of a worker that calls it
makes it; later tasks, and other jobs on the same worker, find it in the worker's registry, which is a module of its own, so
it is there whatever was sent along with the function.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from dataclasses import dataclass

_REGISTRY = "matchlake_worker_models"
#: Models a worker keeps at most; the one unused for longest goes.
KEPT = 4


@dataclass(frozen=True)
class Model:
    """`make(*args)` gives a function of texts to vectors; equal names are the same model."""

    name: str
    make: Callable
    args: tuple = ()

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return held(self)(texts)


def held(model: Model) -> Callable:
    """The model of this process, made if it is not there yet."""
    home = sys.modules.setdefault(_REGISTRY, types.ModuleType(_REGISTRY))
    models = home.__dict__.setdefault("models", {})
    got = models.pop(model.name, None)
    if got is None:
        got = model.make(*model.args)
        while len(models) >= KEPT:
            del models[next(iter(models))]
    models[model.name] = got  # the last used comes last
    return got
