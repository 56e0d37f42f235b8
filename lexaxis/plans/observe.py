"""Logs calls of queries: name, arguments, plan, seconds and, where asked for, rows; and puts other functions in their place."""

from __future__ import annotations

import contextlib
import functools
import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Observation

LOG = logging.getLogger("lexaxis.queries")


_HOOKS: dict[str, Callable[..., DataFrame]] = {}


@contextlib.contextmanager
def hook(name: str, put: Callable[..., DataFrame]):
    """While it is open, calls of the query `name` go to `put(original, *args)`, which may call the original or not."""
    before = _HOOKS.get(name)
    _HOOKS[name] = put if before is None else lambda original, *args: put(lambda *a: before(original, *a), *args)
    try:
        yield
    finally:
        if before is None:
            del _HOOKS[name]
        else:
            _HOOKS[name] = before


def hooked(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """`f`, whose calls a hook() of its name may stand in for."""

    @functools.wraps(f)
    def call(*args, **named):
        put = _HOOKS.get(f.__name__)
        return f(*args, **named) if put is None else put(f, *args, **named)

    return call


def logged(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """`f`, whose calls are logged at INFO, and the plans of its results at DEBUG."""

    @functools.wraps(f)
    def call(*args, **named):
        began = time.perf_counter()
        result = f(*args, **named)
        shown = ", ".join([*(repr(a) for a in args if isinstance(a, (str, int, float))), *(f"{k}={v!r}" for k, v in named.items())])
        LOG.info("%s(%s) -> %s, planned in %.3f s", f.__name__, shown, result.schema.simpleString(), time.perf_counter() - began)
        if LOG.isEnabledFor(logging.DEBUG):
            LOG.debug("%s", result._jdf.queryExecution().toString())
        return result

    return call


def counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    """(`df`, an observation whose get["rows"] is its number of rows once an action has run): no job of its own."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen
