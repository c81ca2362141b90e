"""Caller code inside a job: a text transform (X1), a model call per
record (X2) and per-record failure isolation (X3)."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART_BYTES = 1 << 20


def apply_transform(df: DataFrame, fn: Callable[[Column], Column], col: str = "text", out: str | None = None) -> DataFrame:
    """A caller's caption transform written on columns (runs in the JVM)."""
    return df.withColumn(out or col, fn(F.col(col)))


def apply_python_transform(df: DataFrame, fn: Callable[[str], str], col: str = "text", out: str | None = None) -> DataFrame:
    """A caller's ``str -> str`` Python function, as a vectorised pandas
    UDF (Arrow batches); NULL stays NULL."""
    @F.pandas_udf(T.StringType())
    def _udf(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else fn(v))

    return df.withColumn(out or col, _udf(F.col(col)))


def _replies(call, prompts):
    out = list(call(prompts))
    if len(out) != len(prompts):
        raise ValueError(f"{len(out)} replies to {len(prompts)} prompts")
    return out


def _call_isolated(call, prompts):
    """Replies and errors for one batch.  A batch that fails, or answers
    with another number of replies than prompts, is retried record by
    record, so that one bad record only fails itself (the records of that
    batch are sent a second time)."""
    try:
        return _replies(call, prompts), [None] * len(prompts)
    except Exception:
        replies, errors = [], []
        for p in prompts:
            try:
                replies += _replies(call, [p])
                errors.append(None)
            except Exception as e:  # isolate the record
                replies.append(None)
                errors.append(f"{type(e).__name__}: {e}")
        return replies, errors


def _parts(prompts: pa.Array, limit: int = PART_BYTES) -> list[tuple[int, int]]:
    """(first row, rows) of consecutive parts of a batch, of ``limit`` bytes of prompts at most (or one longer prompt)."""
    parts, lo, size = [], 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(prompts), 0).to_pylist()):
        if i > lo and size + n > limit:
            parts.append((lo, i - lo))
            lo, size = i, 0
        size += n
    return parts + [(lo, len(prompts) - lo)] if len(prompts) else parts


def _rows_by(keys: pa.Array | None, n: int) -> dict:
    """Row numbers of each key, in order of appearance; a null key has no function."""
    if keys is None:
        return {None: range(n)}
    out: dict = {}
    for i, k in enumerate(keys.to_pylist()):
        if k is not None:
            out.setdefault(k, []).append(i)
    return out


def model_hook(df: DataFrame, call, prompt: str = "prompt", keep: Iterable[str] = (),
               by: str | None = None, store: str | None = None) -> DataFrame:
    """X2 + X3: send every prompt to a caller's batch function
    (``list[str] -> list[str]``) inside ``mapInArrow``, a part of ``PART_BYTES`` of prompts at a
    time, so that a task holds the Arrow batch and one part's prompts and
    replies, whatever the length of the texts; returns the kept columns with ``reply`` and ``error``.  With ``by``, ``call`` is a
    factory ``key -> batch function`` and each row goes to the function of
    its ``by`` value (one pass for many models).  Failures are isolated per
    record: the error text lands in ``error`` and the job goes on.

    Without a store this is a plan: a retried task, or a second action,
    calls again, and a batch that fails is sent a second time record by
    record.  With ``store`` (a shared folder) the calls are made now, each
    request once, and their answers kept there (``replies``)."""
    if store:
        from .replies import resumable_hook
        return resumable_hook(df, call, store, prompt, keep, by)
    keep = list(keep)
    fields = [f for f in df.schema.fields if f.name in keep]
    schema = T.StructType(fields + [T.StructField("reply", T.StringType()), T.StructField("error", T.StringType())])
    cols = list(dict.fromkeys(keep + ([by] if by else []) + [prompt]))

    def run(batches):
        funcs = {}
        for batch in batches:
            for lo, n in _parts(batch.column(prompt)):
                part = batch.slice(lo, n)
                prompts = part.column(prompt).to_pylist()
                replies, errors = [None] * n, [None] * n
                for key, at in _rows_by(part.column(by) if by else None, n).items():
                    if by is None:
                        fn = call
                    elif key in funcs:
                        fn = funcs[key]
                    else:
                        fn = funcs[key] = call(key)
                    for i, r, e in zip(at, *_call_isolated(fn, [prompts[i] for i in at])):
                        replies[i], errors[i] = r, e
                text = batch.column(prompt).type
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in fields], pa.array(replies, text), pa.array(errors, text)],
                                                 names=schema.fieldNames())

    return df.select(*cols).mapInArrow(run, schema)


def split_quarantine(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Good rows (no error) and quarantined rows."""
    return df.where(F.col(error).isNull()).drop(error), df.where(F.col(error).isNotNull())
