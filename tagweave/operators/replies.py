"""X2 with a reply store: a model stage that can be stopped and resumed.

Every request is known by the hash of its model and prompt.  A stage first leaves out the requests that the store
already answers; the others are dealt into buckets, and a task sends a bucket's requests in small batches and
writes each answered batch to the store at once, as one file moved into place under a name made of its first
request.  A retried task lists its buckets first and goes on after the last batch written; a rerun of the whole
job, after whatever failure, asks only what is not in the store.  Equal requests are sent once, however many
rows carry them.  A batch that fails is sent in halves, so its good half is stored and not sent again.

Two attempts of one task that run at the same time (speculation) may both send a batch; the store still holds one
answer.  Failed requests are not stored: they are reported, and sent again by the next run."""

from __future__ import annotations

import hashlib
import io
import uuid
from collections.abc import Iterable

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import staged
from ..sources.paths import open_path, put

BATCH = 16  # requests sent at once, and answers in a file
BUCKET = 2000  # requests of a bucket
STORED = "key string, reply string"


def request_key(model: Column, prompt: Column) -> Column:
    model = F.coalesce(model.cast("string"), F.lit(""))
    return F.sha2(F.concat(F.octet_length(model).cast("string"), F.lit(":"), model, F.coalesce(prompt, F.lit(""))), 256)


def stored_replies(spark: SparkSession, store: str) -> DataFrame:
    """(key, reply) of everything answered so far, one row per key."""
    files, folder = open_path(store)
    files.create_dir(folder, recursive=True)
    return spark.read.schema(STORED).option("recursiveFileLookup", "true").parquet(store) \
        .groupBy("key").agg(F.min("reply").alias("reply"))


def _answered(files: pafs.FileSystem, folder: str) -> set[str]:
    """Keys answered in one bucket (at most ``BUCKET`` or so)."""
    files.create_dir(folder, recursive=True)
    keys: set[str] = set()
    for info in files.get_file_info(pafs.FileSelector(folder)):
        if info.base_name.endswith(".parquet") and not info.base_name.startswith("."):
            with files.open_input_file(info.path) as f:
                keys.update(pq.read_table(f, columns=["key"]).column(0).to_pylist())
    return keys


def _save(files: pafs.FileSystem, folder: str, keys: list[str], replies: list) -> None:
    out = io.BytesIO()
    pq.write_table(pa.table({"key": pa.array(keys, pa.string()), "reply": pa.array(replies, pa.string())}), out)
    put(files, f"{folder}/{hashlib.sha256(','.join(keys).encode()).hexdigest()}.parquet", out.getvalue())


def _send(call, files, folder: str, keys: list[str], prompts: list[str], failed: list[tuple[str, str]]) -> None:
    """Send a batch and store its answers; on failure its halves, down to single requests."""
    try:
        replies = list(call(prompts))
        if len(replies) != len(prompts):
            raise ValueError(f"{len(replies)} replies to {len(prompts)} prompts")
    except Exception as e:
        if len(keys) == 1:
            failed.append((keys[0], f"{type(e).__name__}: {e}"))
            return
        half = len(keys) // 2
        _send(call, files, folder, keys[:half], prompts[:half], failed)
        _send(call, files, folder, keys[half:], prompts[half:], failed)
        return
    _save(files, folder, keys, replies)


def answer(requests: DataFrame, call, store: str, by_model: bool, batch: int = BATCH, bucket: int = BUCKET) -> DataFrame:
    """Send every request of ``requests`` (key, model, prompt) that the store does not answer; a job.  Returns
    (key, error) of those that failed.  ``call`` is a batch function, or with ``by_model`` a factory of them."""
    spark = requests.sparkSession
    todo = staged(requests.groupBy("key").agg(F.min("model").alias("model"), F.min("prompt").alias("prompt"))
                  .join(stored_replies(spark, store).select("key"), "key", "left_anti"), "requests")
    n = todo.count()
    if n == 0:
        return todo.select("key", F.lit(None).cast("string").alias("error"))
    buckets = -(-n // bucket)
    run_folder = f"run={uuid.uuid4().hex}"

    def run(batches):
        files, root = open_path(store)
        at, folder, done, fn, model = None, "", set(), None, None
        keys, prompts, failed = [], [], []

        def flush():
            if keys:
                _send(fn, files, folder, list(keys), list(prompts), failed)
                keys.clear()
                prompts.clear()
        for pdf in batches:
            for key, m, prompt, b in zip(pdf["key"], pdf["model"], pdf["prompt"], pdf["bucket"]):
                if b != at:
                    flush()
                    at, folder = b, f"{root}/{run_folder}/bucket={b}"
                    done = _answered(files, folder)
                if fn is None or (by_model and m != model):
                    flush()
                    model, fn = m, call(m) if by_model else call
                if key in done:
                    continue
                keys.append(key)
                prompts.append(prompt)
                if len(keys) >= batch:
                    flush()
            yield pd.DataFrame(failed, columns=["key", "error"])
            failed.clear()
        flush()
        yield pd.DataFrame(failed, columns=["key", "error"])

    dealt = todo.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")) \
        .repartition(int(min(buckets, 10_000)), "bucket").sortWithinPartitions("bucket", "model", "key")
    return staged(dealt.select("key", "model", "prompt", "bucket").mapInPandas(run, "key string, error string"), "unanswered")


def resumable_hook(df: DataFrame, call, store: str, prompt: str = "prompt", keep: Iterable[str] = (),
                   by: str | None = None, batch: int = BATCH, bucket: int = BUCKET) -> DataFrame:
    """``hooks.model_hook`` over a reply store (a shared folder): the kept columns with ``reply`` and ``error``.
    The calls are made now; what is returned reads the store."""
    keep = list(keep)
    model = F.col(by) if by else F.lit(None).cast("string")
    rows = df.withColumn("_key", request_key(model, F.col(prompt)))
    errors = answer(rows.select(F.col("_key").alias("key"), model.cast("string").alias("model"), F.col(prompt).alias("prompt")),
                    call, store, by is not None, batch, bucket)
    answers = stored_replies(df.sparkSession, store).select(F.col("key").alias("_key"), "reply", F.lit(None).cast("string").alias("error"))
    failed = errors.select(F.col("key").alias("_key"), F.lit(None).cast("string").alias("reply"), "error") \
        .where(F.col("error").isNotNull())
    return rows.select(*keep, "_key").join(answers.unionByName(failed), "_key", "left").select(*keep, "reply", "error")
