"""URL filter: host and path rules, else logistic regression on hashed character n-grams.

A url's host is what follows its first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; its path goes on
from there up to ``?``, ``#`` or the end.  A rule (action, host, path) fits its host and all subdomains, if the path
starts with the rule's path; the longest fitting rule (host and path together, then host) decides.  All
other urls are judged by the model.

Model: byte n-grams of 3 to 5 of the host (between ``.`` marks) and of the path (between ``/`` marks), host and
path apart, hashed into 2^18 buckets, each present bucket weighing 1 / sqrt(n-grams of the url).  The labelled
table is small (at most ``max_rows`` urls, by hash of the url: a documented bound), so it meets in one task,
which fits by gradient steps with an L2 penalty.  Scoring is a map over all urls with 2^18 floats in the
function; there is no shuffle, so a hot host costs nothing.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule and gets the
model's score of no n-grams (its bias); empty paths have none; labels that are null are ignored, repeated
urls count once (the largest label); a table of one kind of label (or none) gives that kind (allow) to
every url; repeated rows are each judged; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_texts, mix, powers, text_chunks

BITS = 18
SIZES = (3, 4, 5)
MAX_ROWS = 20_000

# (action, host, path) of the registered query
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]

# The labelled table: words of hosts and paths that a corpus does not want, and of ordinary ones.
# Each word is set into urls of several forms by ``labelled_urls``.
UNWANTED = """casino poker roulette slots jackpot betting bets gamble lottery win-big free-spins
adult xxx porn sex nude escort webcam-girls hookup erotic
pills viagra cialis pharmacy-cheap cheap-meds steroid weight-loss-pill
spam link-farm seo-farm backlink bulk-mail click-farm
ads ad-server adtrack tracker track-click banner-ads popunder doubleads telemetry
warez torrent crack keygen serial-key malware phishing free-download-now
payday-loan quick-cash get-rich forex-signal crypto-giveaway replica-watch fake-id""".split()
ORDINARY = """news wiki library museum university school science journal archive garden kitchen recipes
travel maps weather health history music theatre books reading poetry science-daily astronomy physics biology
chemistry mathematics engineering software docs manual tutorial forum community city council parliament
government justice court law economy market finance-news bank insurance sports football cycling running
photography painting design architecture building house furniture repair tools farmers harvest animals birds
forest river mountain ocean climate energy transport railway airport hotel restaurant coffee bread winter
summer family parents children teacher students research laboratory medicine hospital nurse dentist
tionre thering onthat andble heren estion ingare entle auchen derung lichkeit ement quelle pourle cione dados""".split()


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, blocked): the small labelled table, by rule from the two word lists above.  Subdomains, top
    domains, languages and page numbers are the same for both kinds, so they say nothing."""
    rows = []
    tops, subs, langs = ("com", "net", "org"), ("", "www.", "blog.", "m."), ("en", "fr", "de", "es")
    for blocked, names in ((1, UNWANTED), (0, ORDINARY)):
        for i, w in enumerate(names):
            other = names[(i * 7 + 3) % len(names)]
            for j, host in enumerate((w, f"{w}-{other}", f"{other}{w}")):
                k = i + j
                page = f"{langs[k % 4]}/{137 * (k % 12) + 100}"
                rows.append((f"https://{subs[k % 4]}{host}.example.{tops[k % 3]}/{page}", blocked))
            rows.append((f"http://{subs[i % 4]}pages.example.{tops[i % 3]}/{langs[i % 4]}/{w}/{137 * (i % 12)}.html", blocked))
    return spark.createDataFrame(rows, "url string, blocked int")


# ---------------------------------------------------------------- host, path, rules

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return (F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER),
            F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def deciding_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule text, action) of the longest rule that fits; null where none does.  ``rules`` is a short list
    (a parameter), so it is one expression."""
    order = sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1])), reverse=True)
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in reversed(order):
        h = h.translate(str.maketrans(_UPPER, _LOWER))
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        text, action = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(act)).otherwise(action)
    return text, action


# ---------------------------------------------------------------- model

def _grams(texts: list[bytes], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket hash) of every n-gram of the texts, none across two of them."""
    buf = np.frombuffer(b"".join(texts), np.uint8)
    length = np.fromiter(map(len, texts), np.int64, count=len(texts))
    row = np.repeat(np.arange(len(texts)), length)
    power, inverse = powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[:len(buf)], out=sums[1:])
    rows, hashes = [], []
    for n in SIZES:
        start = np.flatnonzero(row[:len(buf) - n + 1] == row[n - 1:]) if len(buf) >= n else np.zeros(0, np.int64)
        rows.append(row[start])
        hashes.append(mix((sums[start + n] - sums[start]) * inverse[start] + np.uint64((salt * 16 + n) << 48)))
    return np.concatenate(rows), np.concatenate(hashes)


def features(hosts: list[bytes], paths: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, bucket), sorted, and each pair's value."""
    parts = [_grams([b"." + h + b"." if h else b"" for h in hosts], 1), _grams([p + b"/" if p else b"" for p in paths], 2)]
    row, h = (np.concatenate(x) for x in zip(*parts))
    key = np.unique((row.astype(np.uint64) << np.uint64(bits)) | (h >> np.uint64(64 - bits)))
    row = (key >> np.uint64(bits)).astype(np.int64)
    return row, (key & np.uint64((1 << bits) - 1)).astype(np.int64), \
        1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(hosts)), 1))[row]


class UrlModel:
    def __init__(self, bias: float, weights: np.ndarray):
        self.bias, self.weights = bias, weights

    def scores(self, hosts: list[bytes], paths: list[bytes]) -> np.ndarray:
        out = np.full(len(hosts), self.bias)
        sizes = [h + b"/" + p for h, p in zip(hosts, paths)]
        bits = int(np.log2(len(self.weights)))
        for lo, hi in text_chunks(sizes):
            row, at, x = features(hosts[lo:hi], paths[lo:hi], bits)
            out[lo:hi] += np.bincount(row, self.weights[at] * x, hi - lo)
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def fit_rows(hosts: list[bytes], paths: list[bytes], label: np.ndarray, bits: int = BITS, steps: int = 300,
             rate: float = 0.5, decay: float = 2e-3) -> UrlModel:
    """Logistic regression by Adam over the whole (small) table.  Whatever the table's share of blocked urls, the
    ordinary ones weigh three times as much in all, so a url of unknown n-grams leans to allow."""
    weights = np.zeros(1 << bits)
    if not len(label) or label.min() == label.max():
        return UrlModel(40.0 if len(label) and label[0] else -40.0, weights)
    row, at, x = features(hosts, paths, bits)
    used, col = np.unique(at, return_inverse=True)
    each = np.where(label == 1, 0.25 / (label == 1).sum(), 0.75 / (label == 0).sum())
    p = np.zeros(len(used) + 1)
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        z = p[-1] + np.bincount(row, p[col] * x, len(label))
        d = (1 / (1 + np.exp(-z)) - label) * each
        g = np.append(np.bincount(col, d[row] * x, len(used)) + decay * p[:-1] / len(used), d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate / np.sqrt(t) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    weights[used] = p[:-1]
    return UrlModel(float(p[-1]), weights)


def _fitted(bits: int):
    def run(t: pa.Table) -> pa.Table:
        rows = sorted(zip(*(t.column(c).to_pylist() for c in ("host", "path", "label"))))
        model = fit_rows([h.encode() for h, _, _ in rows], [p.encode() for _, p, _ in rows],
                         np.array([float(y) for *_, y in rows]), bits)
        return pa.table({"bias": [model.bias], "weights": [model.weights.tobytes()]},
                        schema=pa.schema([("bias", pa.float64()), ("weights", pa.binary())]))
    return run


def fit(labelled: DataFrame, max_rows: int = MAX_ROWS, bits: int = BITS) -> UrlModel:
    """``labelled``: (url, blocked 0/1).  At most ``max_rows`` urls meet in one task; the model (2 MB) comes back."""
    host, path = host_and_path(F.col("url"))
    rows = labelled.where("url IS NOT NULL AND blocked IS NOT NULL").groupBy("url") \
        .agg(F.max(F.col("blocked").cast("int")).alias("label")).orderBy(F.xxhash64("url"), "url").limit(max_rows) \
        .select(host.alias("host"), path.alias("path"), "label")
    got = rows.groupBy(F.lit(1).alias("all")).applyInArrow(_fitted(bits), "bias double, weights binary").first()
    if got is None:
        return fit_rows([], [], np.zeros(0), bits)
    return UrlModel(got[0], np.frombuffer(got[1], np.float64))


# ---------------------------------------------------------------- judging

def judge(pages: DataFrame, model: UrlModel, rules: list[tuple[str, str, str]], cut: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row of ``pages`` (page_id, url)."""
    host, path = host_and_path(F.col("url"))
    schema = "page_id long, host string, path string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.scores(byte_texts(batch.column(1)), byte_texts(batch.column(2)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())],
                                             names=["page_id", "host", "path", "score"])
    scored = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path")) \
        .mapInArrow(run, schema)
    rule, action = deciding_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("score") >= cut, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, own).alias("verdict"), "score")


def report(pages: DataFrame, labelled: DataFrame | None = None, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    model = fit(labelled_urls(pages.sparkSession) if labelled is None else labelled)
    return judge(pages, model, RULES if rules is None else rules)
