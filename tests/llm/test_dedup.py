"""Operators 4, 5 and 8 against brute force, on skewed groups and edge rows."""

import hashlib
import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave.llm import linedup as ld
from tagweave.llm import neardup as nd
from tagweave.llm import substring as sb
from tagweave.llm.components import components


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a):
        new = [i + 1]
        for j, e in enumerate(b):
            new.append(min(row[j] + (c != e), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def union(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def variants(rng, base, n, edits, alphabet):
    out = set()
    for _ in range(n):
        x = list(base)
        for _ in range(rng.randint(1, edits)):
            i, kind = rng.randrange(len(x)), rng.random()
            if kind < 0.34:
                x[i] = rng.choice(alphabet)
            elif kind < 0.67:
                x.insert(i, rng.choice(alphabet))
            else:
                del x[i]
        out.add("".join(x))
    return out


@pytest.mark.parametrize("t", [1, 2, 3])
def test_edit_links_lose_no_pair(spark, t):
    rng = random.Random(t)
    lines = set()
    for _ in range(8):
        base = "".join(rng.choice("ab ") for _ in range(rng.randint(9, 26)))
        lines |= {base} | variants(rng, base, 12, 4, "abé\U0001F600")
    lines = sorted(x for x in lines if x)
    want = {(i, j) for j in range(len(lines)) for i in range(j) if edit(lines[i], lines[j]) <= t}
    df = spark.createDataFrame([(i, x, len(x)) for i, x in enumerate(lines)], "id long, line string, n int")
    got = [tuple(sorted(r)) for r in ld.edit_links(df, t).collect()]
    assert set(got) == want and len(got) == len(set(got))


def brute_lines(rows, min_docs, least=8):
    """[(doc_id, text after the operator)] and each line's number of links, by the docstring's rules."""
    distinct = sorted({x for _, s in rows for x in (s or "").split("\n") if x})
    letters = {x: sum(c.isalpha() for c in x) for x in distinct}
    links = [(a, b) for i, a in enumerate(distinct) for b in distinct[:i]
             if min(letters[a], letters[b]) >= least and edit(a, b) <= (1 if min(len(a), len(b)) < 16 else 2)]
    cls, degree = union(links, distinct), defaultdict(int)
    for pair in links:
        for x in pair:
            degree[x] += 1
    place, docs_of = {}, defaultdict(set)
    for d, s in rows:
        for no, x in enumerate((s or "").split("\n")):
            if x:
                at = (d is None, d or 0, no)
                place[cls[x]] = min(place.get(cls[x], at), at)
                docs_of[cls[x]].add(d)
    out = []
    for d, s in rows:
        keep = [x for no, x in enumerate((s or "").split("\n"))
                if not x or letters[x] < 16 or len(docs_of[cls[x]]) < min_docs or place[cls[x]] == (d is None, d or 0, no)]
        out.append((d, None if s is None else "\n".join(keep)))
    return out, degree


def test_boilerplate_lines(spark, monkeypatch):
    rng = random.Random(5)
    foot = "Copyright notice, all rights reserved %s"
    rows = []
    for d in range(30):
        own = "".join(rng.choice("abcdefgh ") for _ in range(40))
        rows.append((d, "\n".join([own, foot % d, "", "short", "short", "tail of " + str(d)][:rng.randint(1, 6)])))
    rows += [(50, None), (51, ""), (52, "\n\n"), (None, foot % 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("gone", F.lit("x")).withColumn("no", F.lit(1))
    monkeypatch.setattr(ld.line_classes, "__defaults__", (2, 8, 16, 5, 1e-6))
    out = ld.clean(df)
    assert out.columns == df.columns and {(r["gone"], r["no"]) for r in out.collect()} == {("x", 1)}
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    kept, _ = brute_lines(rows, 5)
    assert got == sorted(kept, key=str)
    rep = {r["doc_id"]: r for r in ld.report(df).collect()}
    full = lambda t: len([x for x in (t or "").split("\n") if x])
    assert len(rep) == len(rows)
    for (d, s), (_, k) in zip(rows, kept):
        assert (rep[d]["n_lines"], rep[d]["n_removed"]) == (full(s), full(s) - full(k))


def test_link_rule_by_length_and_letters(spark):
    """By the registered defaults, against brute force: variants of lines about the rule's bounds."""
    rng = random.Random(11)
    bases = ["All rights reserved.", "abcdefgh", "Contents", "a b c d e f g h", "x" * 15, "y" * 16, "12345678901234567 abc",
             "2019-01-01 12:00", "Total amount due", "été où çà là", "return value;", "},", "No"]
    lines = sorted(set(bases) | {v for base in bases if len(base) > 3 for v in variants(rng, base, 14, 3, "aé1 ")})
    rows = [(d, "\n".join(rng.sample(lines, 60) + [f"{chr(0x4E00 + 9 * d) * 20} own"])) for d in range(14)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept, degree = brute_lines(rows, 10, 0)
    assert sorted(map(tuple, ld.clean(df).select("doc_id", "text").collect())) == sorted(kept)
    rep = {r["doc_id"]: r for r in ld.report(df).collect()}
    assert {d: rep[d]["n_links"] for d, _ in rows} == {d: sum(degree[x] for x in t.split("\n")) for d, t in rows}
    assert sum(r["n_removed"] for r in rep.values()) > 20 and sum(degree.values()) > 200


def test_lines_of_few_letters_lose_no_link(spark):
    """Characters, words, numbers, dates and rules of signs, against brute force; classes by all links."""
    rng = random.Random(21)
    lines = set("aé1\U0001F600}中文字") | {"ab", "ac", "é1", "}}", "aab", "aaab", "No", "Not"} | {str(i) for i in range(95, 125)} \
        | {f"2019-01-{i:02d} 12:00:0{i % 3}" for i in range(1, 20)} | {"=" * k for k in range(12, 22)} | {"1" * 14 + "abcdefg", "1" * 14 + "abcdefgh"}
    for base in ("abcdefg", "12,50 | 7", "| 1 | 2 | 3 | 40 | 5", "123456789012345", "abcdefgh", "1234567890123 abcdefgh"):
        lines |= variants(rng, base, 10, 3, "a1 ") | {base}
    lines = sorted(lines)
    want = {frozenset((a, b)) for i, a in enumerate(lines) for b in lines[:i] if edit(a, b) <= (1 if min(len(a), len(b)) < 16 else 2)}
    rows = [(d, "\n".join(lines[d::3])) for d in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = ld.distinct_lines(df)
    text = {r["id"]: r["line"] for r in found.collect()}
    got = [frozenset((text[r["a"]], text[r["b"]])) for r in ld.line_links(found).collect()]
    assert set(got) == want and len(got) == len(want)
    cls = union([tuple(p) for p in want], lines)
    of = {}
    for r in ld.line_classes(df).collect():
        of.setdefault(r["class_id"], set()).add(cls[rows[r["doc_id"]][1].split("\n")[r["no"]]])
    assert all(len(x) == 1 for x in of.values()) and len(of) == len(set(cls.values()))


def test_boilerplate_does_not_follow_the_number_of_documents(spark, monkeypatch):
    """A line in 10 documents is boilerplate however many documents there are (told here, not made)."""
    foot = "Subscribe to our newsletter for more stories"
    df = spark.createDataFrame([(d, f"{foot}\n{d} {chr(0x4E00 + d) * 9}") for d in range(10)], "doc_id long, text string")
    monkeypatch.setattr(type(df), "count", lambda self: 50_000_000)
    assert sum(r["removed"] for r in ld.line_classes(df).collect()) == 9


def test_code_tables_and_lists_keep_their_lines(spark):
    rng = random.Random(2)
    ordinary = ["}", "{", "else:", "No", "Yes", "42", "2019", "cat", "Male", "Female", "Total", "return None", "import os", "end;",
                "| 1 | 2 | 3 |", "2019-01-01,12.50,7", "- milk", "* bread", "0.25", "---", "x = 1", "})();", "N/A", "Mon Tue Wed"]
    foot = "Subscribe to our newsletter for more stories"
    rows = [(d, "\n".join([f"Heading of document {chr(0x4E00 + d) * 8}"] + rng.choices(ordinary, k=12) + [foot + "." * (d % 3)]))
            for d in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"].split("\n") for r in ld.clean(df).collect()}
    for d, t in rows:
        lines = t.split("\n")
        assert got[d] == (lines if d == 0 else lines[:-1])


def test_short_lines_make_few_candidates(spark):
    """Candidates follow the lines, not their square: one character, numbers, dates, words, cells."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    short = {chr(0x4E00 + i) for i in range(5000)} | {str(i) for i in range(20_000)} | {f"{i},{i}.50" for i in range(5000)} \
        | {f"2019-{i % 12 + 1:02d}-{i % 28 + 1:02d} {i:05d}" for i in range(5000)} | {word(rng.randint(1, 7)) for _ in range(8000)} \
        | {word(rng.randint(9, 15)) for _ in range(9000)}
    df = spark.createDataFrame([(1, "\n".join(sorted(short)))], "doc_id long, text string")
    lines = ld.distinct_lines(df, ld.LINK_LETTERS)
    n = ld.candidates(lines.where(F.col("n") >= ld.LONG), 2).count() + ld.candidates(lines.where(F.col("n") <= ld.LONG), 1, ld.LONG).count()
    assert len(short) > 45_000 and n < len(short) / 10


def test_line_dedup_edges(spark, edge, empty):
    assert ld.clean(edge).columns == edge.columns
    assert ld.clean(edge).count() == edge.count() == ld.report(edge).count()
    assert sorted(map(str, ld.clean(edge).select("doc_id", "text").collect())) == sorted(map(str, edge.select("doc_id", "text").collect()))
    assert ld.clean(empty).count() == 0 and ld.report(empty).count() == 0


def test_line_dedup_stays_in_the_jvm(spark, docs):
    for df in (ld.line_links(ld.distinct_lines(docs, 8)), ld.report(docs), ld.clean(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_line_links_are_planned_in_small_queries(spark, docs):
    """The driver plans a query anew after each of its shuffles: its memory follows the plan, whatever the input."""
    links = ld.line_links(ld.distinct_lines(docs))
    assert len(links._jdf.queryExecution().executedPlan().toString()) < 80_000  # 157,709 in one query


def test_counts_of_letters(spark):
    rng = random.Random(6)
    lines = ["", "é", "eeeee"] + ["".join(rng.choices("etaoinshrdlcumwfgypb xéE", k=rng.randint(1, 90))) for _ in range(120)]
    got = [r["counts"] for r in ld.with_counts(spark.createDataFrame([(x,) for x in lines], "line string")).collect()]
    assert got == [sum(x.count(c) % 4 << 2 * k for k, c in enumerate(ld.LETTERS)) for x in lines]
    pairs = [(a, b) for a in got for b in got[:20]] + [(0, 2 ** 40 - 1), (2 ** 40 - 1, 0)]
    far = [sum(min(d, 4 - d) for d in (((a >> 2 * k) - (b >> 2 * k)) % 4 for k in range(20))) for a, b in pairs]
    df = spark.createDataFrame(pairs, "a long, b long").select(ld.counts_apart(F.col("a"), F.col("b")).alias("d"))
    assert [r["d"] for r in df.collect()] == far


def test_components(spark):
    rng = random.Random(0)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 560)] \
        + [(1000, 1001 + i) for i in range(300)] + [(7, 7)]
    got = {r["id"]: r["class_id"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = union(pairs, {x for p in pairs for x in p})
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {n: c for n, c in want.items() if n in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------------ near-duplicates

FOLD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def weighted(texts):
    """Shingle weights by the docstring, with exact words in place of hash buckets."""
    ws = [FOLD.findall(t.translate({c: c + 32 for c in range(65, 91)})) for t in texts]
    df = defaultdict(int)
    for w in ws:
        for x in set(w):
            df[x] += 1
    idf = {x: 1 + np.log((1 + len(texts)) / (1 + n)) for x, n in df.items()}
    out = []
    for w in ws:
        sh = defaultdict(float)
        for i in range(max(1, len(w) - 4) if w else 0):
            g = tuple(w[i:i + 5])
            sh[g] += sum(idf[x] for x in g) / len(g)
        out.append(sh)
    return out


def jaccard(a, b):
    low = sum(min(a[k], b[k]) for k in a.keys() & b.keys())
    total = sum(a.values()) + sum(b.values()) - low
    return low / total if total else 0.0


def corpus(seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    texts = []
    for size in (1, 1, 1, 2, 3, 5, 40):
        base = [word() for _ in range(rng.randint(60, 160))]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 30)) if size > 1 else 0):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    texts += [texts[0], texts[0].upper(), "just two", "Just, two!", "one two three four five six"]
    rng.shuffle(texts)
    return texts


def test_similarity_equals_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    idf = nd.bucket_idf(df)
    w = weighted(texts)
    i, j = np.triu_indices(len(texts), 1)
    got = nd.similarities([texts[a].encode() for a in i], [texts[b].encode() for b in j], idf)
    want = np.array([jaccard(w[a], w[b]) for a, b in zip(i, j)])
    assert np.abs(got - want).max() < 0.01


def test_samples_agree_as_often_as_the_similarity():
    rng = np.random.default_rng(1)
    n = 400
    sh = rng.integers(1, 1 << 44, n).astype(np.uint64)
    wa, wb = rng.uniform(0.5, 6, n), rng.uniform(0.5, 6, n)
    wb[: n // 2] = wa[: n // 2]
    order = np.argsort(sh)
    doc = np.repeat([0, 1], n)
    s = nd.samples(doc, np.tile(sh[order], 2), np.concatenate([wa[order], wb[order]]).astype(np.float32), 2, 3000)
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((s[0] == s[1]).mean() - want) < 0.03


def test_classes_equal_brute_force(spark):
    texts = corpus(3)
    rows = list(enumerate(texts)) + [(500, None), (501, ""), (502, "..."), (503, "..."), (504, None), (None, "just two"), (0, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class_id", F.lit("clash")).withColumn("key", F.lit(0))
    w = weighted(texts)
    sims = {(a, b): jaccard(w[a], w[b]) for a in range(len(texts)) for b in range(a)}
    sure = union([p for p, s in sims.items() if s >= 0.805], range(len(texts)))
    most = union([p for p, s in sims.items() if s >= 0.795], range(len(texts)))
    out = nd.classes(df)
    assert out.count() == len(rows)
    got = {r["doc_id"]: r["class_id"] for r in out.collect()}
    for a in range(len(texts)):
        for b in range(a):
            if sure[a] == sure[b]:
                assert got[a] == got[b]
            if most[a] != most[b]:
                assert got[a] != got[b]
    assert got[502] == got[503] == 502 and got[500] == 500 and got[504] == 504 and got[501] == 501 and got[None] is None
    kept = nd.keep_one(df)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == df.columns and len(ids) == len(set(ids))
    assert set(ids) == {c for c in got.values()}


def test_open_pairs_of_a_bucket_are_closed(spark):
    """11 and 12 are both open; 21 - 22 is ruled out by the triangle, 31 - 32 by what stands in 32 alone."""
    met = spark.createDataFrame([(k, 3, n, 10 * k) for k in (1, 2, 3) for n in (10 * k, 10 * k + 1, 10 * k + 2)],
                                "key long, n long, node long, leader long")
    sims = spark.createDataFrame([(10, 11, 0.82), (10, 12, 0.70), (20, 21, 0.9), (20, 22, 0.1), (30, 31, 0.82), (30, 32, 0.7)],
                                 "a long, b long, sim double")
    label = spark.createDataFrame([(10, 10), (11, 10), (20, 20), (21, 20), (30, 30), (31, 30)], "id long, class_id long")
    common = " ".join(f"w{i}" for i in range(40))
    own = " ".join(f"own{i}" for i in range(30))
    texts = spark.createDataFrame([(n, f"{common} {own}" if n == 32 else common) for n in (10, 11, 12, 20, 21, 22, 30, 31, 32)],
                                  "id long, text string")
    idf = spark.sparkContext.broadcast(np.ones(1 << nd.DF_BITS, np.float32))
    got = {tuple(r) for r in nd._undecided(met, sims, label, 0.8, texts, idf).collect()}
    assert got == {(11, 12)}


def test_bounds_never_rule_out_a_link(spark):
    """Every pair of edited copies in one open bucket: all links are left, most other pairs are not."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(60):
        w = list(base)
        for k in rng.sample(range(200), rng.choice([1, 2, 4, 6, 9])):
            w[k] = f"x{i}_{k}"
        texts.append(" ".join(w))
    n = len(texts)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    idf = spark.sparkContext.broadcast(nd.bucket_idf(df))
    raw = [t.encode() for t in texts]
    i, j = np.triu_indices(n, 1)
    sim = dict(zip(zip(i.tolist(), j.tolist()), nd.similarities([raw[a] for a in i], [raw[b] for b in j], idf.value)))
    met = spark.createDataFrame([(1, n + 1, a, 1000) for a in range(n)], "key long, n long, node long, leader long")
    sims = spark.createDataFrame([(a, 1000, 0.75) for a in range(n)], "a long, b long, sim double")
    got = {tuple(r) for r in nd._undecided(met, sims, spark.createDataFrame([], "id long, class_id long"), 0.8, df, idf).collect()}
    links = {p for p, s in sim.items() if s >= 0.8}
    assert links <= got and len(links) > 50
    far = {p for p, s in sim.items() if s < 0.7}
    assert len(far) > 300 and len(far & got) < 0.05 * len(far)


def test_large_group_of_copies_edited_to_any_degree(spark):
    """Copies of one text with 0 to 60 % of the words replaced: every link is kept, and far fewer pairs
    than the group's square are compared."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(150):
        w = list(base)
        for k in rng.sample(range(120), int(rng.random() * 0.6 * 120 * rng.random())):
            w[k] = f"x{i}_{k}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    w = weighted(texts)
    want = union([(a, b) for a in range(150) for b in range(a) if jaccard(w[a], w[b]) >= 0.805], range(150))
    got = {r["doc_id"]: r["class_id"] for r in nd.classes(df).collect()}
    assert all(got[a] == got[b] for a in range(150) for b in range(a) if want[a] == want[b])


def test_near_duplicate_edges(spark, edge, empty):
    assert nd.keep_one(edge).columns == edge.columns
    assert nd.report(edge).count() == edge.count()
    ids = sorted(str(r["doc_id"]) for r in nd.keep_one(edge).collect())
    assert ids == sorted(str(i) for i in [1, 2, 3, 4, 5, None, None, 6, 7, 8, 9])
    assert nd.keep_one(empty).count() == 0 and nd.report(empty).count() == 0


# ------------------------------------------------------------------ substrings

def brute_substring(rows, n=20):
    """The contract, window by window, in (doc_id, row) order; null ids last."""
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for p in range(len(w) - n + 1):
            k = tuple(w[p:p + n])
            if k in seen:
                gone[p:p + n] = [True] * n
            seen.add(k)
        left = [x for x, g in zip(w, gone) if not g]
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(left)).hexdigest()))
    return sorted(out, key=str)


def passages(seed, docs=60, vocabulary=40):
    """Documents cut and pasted from a few passages, so that factors overlap and repeat."""
    rng = random.Random(seed)
    words = [rng.choice("abcxyz") * rng.randint(1, 4) + str(rng.randrange(vocabulary)) for _ in range(vocabulary)]
    pool = [[rng.choice(words) for _ in range(rng.randint(15, 70))] for _ in range(6)]
    rows = []
    for d in range(docs):
        w = []
        for _ in range(rng.randint(0, 6)):
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            w += p[a:a + rng.randint(5, 60)] if rng.random() < 0.7 else [rng.choice(words) for _ in range(rng.randint(1, 25))]
        if rng.random() < 0.1:
            w += ["again"] * 50
        rows.append((d, "".join(x + rng.choice([" ", "\n", "\t", "  ", "\x0b"]) for x in w)))
    return rows


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_substring_equals_brute_force(spark, seed):
    rows = passages(seed)
    if seed == 2:  # repeated and null ids, null and odd texts
        rows += [(3, rows[3][1]), (3, rows[10][1]), (None, rows[5][1]), (None, None), (70, None), (71, ""), (72, "\x1c a\xa0b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash")).withColumn("doc", F.lit(0))
    got = sorted((tuple(r[:4]) for r in sb.report(df).collect()), key=str)
    assert got == brute_substring(rows)


@pytest.mark.parametrize("seed", [0, 4])
def test_substring_factors_copy_earlier_words(spark, seed):
    rows = passages(seed)
    text = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in rows}
    got = sb.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    seen = 0
    for r in got:
        for f in r["factors"]:
            own, source, n = text[r["doc_id"]], text[f["source"]], f["last"] - f["first"] + 1
            assert n >= sb.WINDOW and (f["source"], f["source_first"]) < (r["doc_id"], f["first"])
            assert own[f["first"]:f["last"] + 1] == source[f["source_first"]:f["source_first"] + n]
            seen += 1
        covered = {i for f in r["factors"] for i in range(f["first"], f["last"] + 1)}
        assert covered == {i for s in r["spans"] for i in range(s["first"], s["last"] + 1)} and len(covered) == r["n_removed"]
    assert seen


def test_substring_one_copied_passage_is_one_factor(spark):
    words = [f"p{i}" for i in range(500)]
    rows = [(1, " ".join(["a", "b", *words, "c"])), (2, " ".join(["x", *words[50:450], "y", "z"])),
            (3, " ".join([*words[:100], "gap", *words[100:300]]))]
    got = {r["doc_id"]: [tuple(f) for f in r["factors"]] for r in sb.report(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [(1, 400, 1, 52)], 3: [(0, 99, 1, 2), (101, 300, 1, 102)]}


def test_hot_passage(spark):
    """A third of all documents holds one passage: every copy but the first goes."""
    rng = random.Random(9)
    hot = " ".join(f"hot{i}" for i in range(60))
    rows = [(d, " ".join([*(f"w{rng.randrange(10 ** 6)}" for _ in range(30)), hot if d % 3 == 0 else "", f"end{d}"])) for d in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in sb.report(df).collect()}
    assert all(got[d]["n_removed"] == (60 if d % 3 == 0 and d else 0) for d in range(300))
    assert [(s["first"], s["last"]) for s in got[3]["spans"]] == [(30, 89)]


def test_substring_edges(spark, edge, empty):
    rows = [(r["doc_id"], r["text"]) for r in edge.select("doc_id", "text").collect()]
    assert sorted((tuple(r[:4]) for r in sb.report(edge).collect()), key=str) == brute_substring(rows)
    assert sb.report(empty).count() == 0


def test_pieces_tile_the_windows():
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abc") for _ in range(n)).encode() for n in (0, 19, 20, 21, 300)]
    d, anchor, context, first, n = sb.pieces(texts)
    for k, size in enumerate((0, 19, 20, 21, 300)):
        covered = sorted(x for a, c in zip(first[d == k], n[d == k]) for x in range(a, a + c))
        assert covered == list(range(max(0, size - 19)))
