"""Conversation prefix trie by truncation peeling.

Every conversation is a sequence of turns (role, text).  A trie node is a distinct prefix of d turns; it
is known by a 128-bit chain of turn digests.  The peel starts at the maximum depth: the conversations
that end there merge with one another, every node found loses its last turn and meets, under the key
of its parent, its siblings and the conversations that end one turn earlier.  A node's figures (members,
smallest member, children, leaves, saved tokens) are complete when it is met, so nodes are discovered
and aggregated in one pass from the deepest level to the root.

Scale: levels are peeled in bands whose depths double (0-1, 1-2, 2-4, 4-8, ...).  All rows of a band that share
the prefix at its lower end go to one task, which descends the band's levels; a prefix shared by more
rows than a task should hold is split at the band's middle depth, down to bands of one level, and
those are one hash aggregate each, with map-side combine.  So the number of rounds follows the logarithm
of the depth, and no group, however hot, meets in one task: copies of a conversation are merged before
any band.  Texts leave the first map as digests and word counts.  The id lists of nodes are cut into
pieces by a range sort over (node, id), and a node's digest is streamed over its pieces.

Defined results: rows with null conv_id are left out; null role or text is empty; turns go by turn
number, null first, ties by role, then by the digest of (role, text); repeated rows are repeated turns;
an empty table has no nodes; other columns are ignored.  One conversation is one row (24 bytes a turn),
whatever the length of its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

KEY = 16  # bytes of a node's key
GROUP_LEVELS = 200_000  # rows times levels of one prefix that a task may peel
TASK_LEVELS = 1_000_000  # the same for all prefixes of a task
PIECE = 1 << 16  # characters of an id list in one row
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

_STATE = "depth int, keys binary, words binary, n long, conv_id long, kids long, leaves long, saved long"
_FIGURES = ("n", "conv_id", "kids", "leaves", "saved")


# ---------------------------------------------------------------- sequences

def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as (digest, words)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    one = F.struct(F.col("turn").alias("turn"), role.alias("role"), digest.alias("digest"),
                   F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"))
    return conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("one")) \
        .groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns")) \
        .select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words")))
                .alias("turns"))


def rebuilt(conversations: DataFrame, every: int = 20, most: int = 3) -> DataFrame:
    """(conv_id, turns) with the opening of a shared conversation: the first h turns of conversation
    c - c % ``every``, then c's own turns after its first h; h = crc32(c) % (``most`` + 1)."""
    own = turns(conversations)
    heads = own.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    joined = own.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % every) \
        .join(heads, "base", "left")
    none = F.array().cast("array<struct<digest:binary,words:int>>")
    opening = F.when(F.col("h") > 0, F.slice(F.coalesce("head", none), F.lit(1), F.greatest("h", F.lit(1)))).otherwise(none)
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return joined.select("conv_id", F.concat(opening, rest).alias("turns"))


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, digests, words) to (conv_id, depth, keys, words): node keys and word counts end to end."""
    for batch in batches:
        keys, words, depth = [], [], []
        for digests, counts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            key, out = bytes(KEY), bytearray()
            for d in digests:
                key = hashlib.blake2b(key + d, digest_size=KEY).digest()
                out += key
            keys.append(bytes(out))
            words.append(np.asarray(counts, np.int32).tobytes())
            depth.append(len(digests))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(depth, pa.int32()), pa.array(keys, pa.binary()),
                                          pa.array(words, pa.binary())], names=["conv_id", "depth", "keys", "words"])


def chained(sequences: DataFrame) -> DataFrame:
    """``sequences`` (conv_id, turns) as (conv_id, depth, keys, words); ``keys`` holds the keys of depths 1, 2, ..."""
    return sequences.select("conv_id", F.col("turns.digest").alias("digests"), F.col("turns.words").alias("words")) \
        .mapInArrow(_chained, "conv_id long, depth int, keys binary, words binary")


# ---------------------------------------------------------------- peeling

def key_at(depth: int | Column) -> Column:
    """The key of a row's prefix of ``depth`` turns; empty for the root."""
    if isinstance(depth, int):
        return F.substring("keys", KEY * (depth - 1) + 1, KEY) if depth else F.lit(b"")
    return F.when(depth > 0, F.substring(F.col("keys"), KEY * (depth - 1) + 1, F.lit(KEY))).otherwise(F.lit(b""))


def _peel_rows(low: int):
    """Map over a partition that holds every row of its prefixes of ``low`` turns: descend to that depth.
    Nodes found come out with alive = false, the prefixes' states with alive = true."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ending: dict[int, list] = {}
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                ending.setdefault(r[0], []).append(r)
        alive: dict[bytes, list] = {}
        for d in range(max(ending, default=low), low - 1, -1):
            # newly ended conversations (and states of a deeper band) meet the surviving nodes
            for _, keys, words, *figures in ending.pop(d, ()):
                key = keys[KEY * (d - 1):KEY * d] if d else b""
                _merge(alive, key, figures, keys, words)
            if d == low:
                yield _batch([(low, k, b"", *s) for k, s in alive.items()], True)
                return
            nodes, above = [], {}
            for key, s in alive.items():
                keys, words = s[5], s[6]
                n, conv_id, kids, leaves, saved = _closed(s, int(np.frombuffer(words, np.int32, 1, 4 * (d - 1))[0]))
                up = keys[KEY * (d - 2):KEY * (d - 1)] if d > 1 else b""
                nodes.append((d, key, up, n, conv_id, kids, leaves, saved, b"", b""))
                _merge(above, up, (n, conv_id, 1, leaves, saved), keys, words)
            yield _batch(nodes, False)
            alive = above
    return run


def _merge(states: dict, key: bytes, figures, keys: bytes, words: bytes) -> None:
    n, conv_id, kids, leaves, saved = figures
    s = states.get(key)
    if s is None:
        states[key] = [n, conv_id, kids, leaves, saved, keys, words]
    else:
        s[0] += n
        s[1] = min(s[1], conv_id)
        s[2] += kids
        s[3] += leaves
        s[4] += saved


def _closed(s: list, words: int) -> tuple:
    """A node's figures once all below it is known."""
    return s[0], s[1], s[2], s[3] if s[2] else 1, s[4] + (s[0] - 1) * words


_OUT = ("depth int, key binary, up binary, n long, conv_id long, kids long, leaves long, saved long, "
        "keys binary, words binary, alive boolean")
_OUT_ARROW = pa.schema([("depth", pa.int32()), ("key", pa.binary()), ("up", pa.binary()),
                        *[(c, pa.int64()) for c in _FIGURES], ("keys", pa.binary()), ("words", pa.binary()),
                        ("alive", pa.bool_())])


def _batch(rows: list[tuple], alive: bool) -> pa.RecordBatch:
    if alive:  # (depth, key, up, n, conv_id, kids, leaves, saved, keys, words): cut to the depth left
        rows = [(*r[:8], r[8][:KEY * r[0]], r[9][:4 * r[0]]) for r in rows]
    cols = list(zip(*rows)) if rows else [()] * 10
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*cols, [alive] * len(rows)], _OUT_ARROW)],
                                      schema=_OUT_ARROW)


def _states(df: DataFrame) -> DataFrame:
    return df.select("depth", "keys", "words", *_FIGURES)


_NODES = ("depth", "key", "up", *_FIGURES)


def regroup(rows: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """One level, by a hash aggregate: rows of exactly ``depth`` turns to (nodes, states one turn shorter)."""
    met = rows.groupBy(key_at(depth).alias("key")).agg(
        F.min("keys").alias("keys"), F.min("words").alias("words"), F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"),
        F.sum("kids").alias("kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    nodes = staged(met.select(
        F.lit(depth).alias("depth"), "key", (key_at(depth - 1) if depth else F.lit(b"")).alias("up"), "n", "conv_id", "kids",
        F.when(F.col("kids") > 0, F.col("leaves")).otherwise(F.lit(1)).cast("long").alias("leaves"),
        (F.col("saved") + (F.col("n") - 1) * _last_words(depth)).alias("saved"), "keys", "words"), "trie-level")
    short = nodes.select(
        F.lit(depth - 1).alias("depth"), F.substring("keys", 1, KEY * max(0, depth - 1)).alias("keys"),
        F.substring("words", 1, 4 * max(0, depth - 1)).alias("words"), "n", "conv_id", F.lit(1).cast("long").alias("kids"),
        "leaves", "saved")
    return nodes.select(*_NODES), short


def _last_words(depth: int) -> Column:
    """The word count of turn ``depth``, from the packed little-endian counts."""
    out = F.lit(0).cast("long")
    for i in range(4 if depth else 0):
        byte = F.conv(F.hex(F.substring("words", 4 * (depth - 1) + 1 + i, 1)), 16, 10).cast("long")
        out = out + F.shiftleft(byte, 8 * i)
    return out


def peel(rows: DataFrame, low: int, top: int, group_levels: int = GROUP_LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """``rows``: states of depths ``low`` to ``top``.  (nodes of depths above ``low``, states at ``low``)."""
    at_low, above = rows.where(F.col("depth") == low), rows.where(F.col("depth") > low)
    if top - low == 1:
        nodes, short = regroup(above, top)
        return [nodes], at_low.unionByName(short)
    levels = F.sum(F.col("depth") - low)
    load = above.groupBy(key_at(low).alias("prefix")).agg(levels.alias("levels"))
    total, most = load.agg(F.sum("levels"), F.max("levels")).first()
    if total is None:
        return [], at_low
    if most <= group_levels:
        return _peeled(above, at_low, low, total)
    hot = staged(load.where(F.col("levels") > group_levels).select("prefix"), "trie-hot")
    marked = staged(above.withColumn("prefix", key_at(low)).join(hot.withColumn("hot", F.lit(True)), "prefix", "left")
                    .drop("prefix"), "trie-marked")
    nodes, short = _peeled(_states(marked.where("hot IS NULL")), at_low, low, total)
    split, middle = _states(marked.where("hot")), (low + top) // 2
    upper, left = peel(split.where(F.col("depth") >= middle), middle, top, group_levels)
    lower, rest = peel(split.where(F.col("depth") < middle).unionByName(left), low, middle, group_levels)
    return [*nodes, *upper, *lower], short.unionByName(rest)


def _peeled(above: DataFrame, at_low: DataFrame, low: int, total: int) -> tuple[list[DataFrame], DataFrame]:
    tasks = max(int(above.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_LEVELS))
    out = staged(_states(above).withColumn("prefix", key_at(low)).repartition(tasks, "prefix").drop("prefix")
                 .mapInArrow(_peel_rows(low), _OUT), "trie-band")
    return [out.where("NOT alive").select(*_NODES)], at_low.unionByName(_states(out.where("alive")))


def bands(depth: int) -> list[tuple[int, int]]:
    """(low, top] from the deepest to the root's children; depths double."""
    cuts = [0, 1]
    while cuts[-1] < depth:
        cuts.append(min(depth, 2 * cuts[-1]))
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b <= max(depth, 1)][::-1]


# ---------------------------------------------------------------- id digests

def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv_id) to (key, first, ids): comma-joined runs of bounded length."""
    key, first, ids, size, out = None, 0, [], 0, []
    for batch in batches:
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != key or size > PIECE:
                if ids:
                    out.append((key, first, ",".join(ids)))
                key, first, ids, size = k, c, [], 0
            ids.append(str(c))
            size += len(ids[-1]) + 1
        if len(out) > 1000:
            yield _piece_batch(out)
            out = []
    if ids:
        out.append((key, first, ",".join(ids)))
    yield _piece_batch(out)


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()),
                                       pa.array(cols[2], pa.string())], names=["key", "first", "ids"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (key, first) to (key, sha)."""
    key, sha, out = None, None, []
    for batch in batches:
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != key or sha is None:
                if sha is not None:
                    out.append((key, sha.hexdigest()))
                key, sha = k, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
        if len(out) > 5000:
            yield _digest_batch(out)
            out = []
    if sha is not None:
        out.append((key, sha.hexdigest()))
    yield _digest_batch(out)


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [(), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.string())], names=["key", "sha"])


def end_digests(ended: DataFrame) -> DataFrame:
    """(key, sha): SHA-256 of the ids that end at each node, ascending and comma-joined.  The range sort
    deals a node's ids out over tasks; only its joined pieces, 64 KiB each, meet in one."""
    pieces = ended.select(key_at(F.col("depth")).alias("key"), "conv_id").repartitionByRange("key", "conv_id") \
        .sortWithinPartitions("key", "conv_id").mapInArrow(_pieces, "key binary, first long, ids string")
    return pieces.repartition("key").sortWithinPartitions("key", "first").select("key", "ids") \
        .mapInArrow(_digested, "key binary, sha string")


# ---------------------------------------------------------------- the trie

def trie(sequences: DataFrame, group_levels: int = GROUP_LEVELS) -> DataFrame:
    """``sequences``: (conv_id, turns of (digest, words)), one row per conversation.  One row per node:
    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)."""
    ended = staged(chained(sequences), "trie-ended")
    # copies of a conversation are one state
    merged = staged(ended.withColumn("key", key_at(F.col("depth"))).groupBy("key", "depth").agg(
        F.min("keys").alias("keys"), F.min("words").alias("words"), F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
        .select("depth", "keys", "words", "n", "conv_id", *[F.lit(0).cast("long").alias(c) for c in ("kids", "leaves", "saved")]),
        "trie-merged")
    deepest = merged.agg(F.max("depth")).first()[0]
    nodes: list[DataFrame] = []
    rows = merged.limit(0)
    for low, top in bands(deepest or 0):
        found, rows = peel(rows.unionByName(merged.where((F.col("depth") > low) & (F.col("depth") <= top))), low, top,
                           group_levels)
        nodes += found
    nodes.append(regroup(rows.unionByName(merged.where("depth = 0")), 0)[0])
    every = nodes[0]
    for df in nodes[1:]:
        every = every.unionByName(df)
    every = staged(every, "trie-nodes")
    parents = every.select(F.col("key").alias("up"), F.col("depth").alias("up_depth"), F.col("conv_id").alias("parent_conv_id"))
    sha = staged(end_digests(ended), "trie-digests")
    # the root's key is empty, as is its own parent's
    return every.join(parents, (every.up == parents.up) & (every.depth == F.col("up_depth") + 1), "left") \
        .join(sha, "key", "left").select(
            "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"),
            F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
            F.coalesce("sha", F.lit(EMPTY_SHA)).alias("ends_sha256"))


def report(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return trie(rebuilt(conversations))
