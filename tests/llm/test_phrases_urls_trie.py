"""Operators 11, 12 and 13 against brute force, on skewed groups and edge rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave.llm import catalog
from tagweave.llm import collocations as co
from tagweave.llm import convtrie as ct
from tagweave.llm import urlfilter as uf

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def clashing(df, *names):
    for c in names:
        df = df.withColumn(c, F.lit("x"))
    return df


# ---------------------------------------------------------------- 11: collocations

def brute_collocations(rows, least=30, top=2000, depth=4):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for d in range(1, depth + 1):
                f[lang].update(tuple(w[i:i + d]) for i in range(len(w) - d + 1))
    out = []
    for lang, counts in f.items():
        cand = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        covered = set()
        for g, a in cand.items():
            for m in range(2, len(g)):
                for i in range(len(g) - m + 1):
                    if 100 * a >= 80 * cand[g[i:i + m]]:
                        covered.add(g[i:i + m])
        best = []
        for g, a in cand.items():
            if g not in covered:
                score, k = min((2_000_000 * a // (counts[g[:k]] + counts[g[k:]]), k) for k in range(1, len(g)))
                best.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def got_collocations(df, **kw):
    return sorted(tuple(r) for r in co.collocations(df, **kw).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_quicksort_counts_every_phrase():
    rng = np.random.default_rng(3)
    for n, size in ((0, 5), (1, 5), (2000, 4), (3000, 1), (500, 1000)):
        keys = rng.integers(1, size + 1, (n, 4)).astype(np.uint64)
        for d in range(1, 4):  # pieces that end
            keys[rng.random(n) < 0.1, d:] = 0
        lang = rng.integers(0, 3, n)
        want = {d: Counter((lang[i], *keys[i, :d].tolist()) for i in range(n) if keys[i, d - 1]) for d in range(1, 5)}
        got = {d: {} for d in range(1, 5)}
        for d, first, count in co.quicksort(keys, lang):
            for i, c in zip(first, count):
                assert (lang[i], *keys[i, :d].tolist()) not in got[d]
                got[d][(lang[i], *keys[i, :d].tolist())] = int(c)
        assert got == want


def test_collocations_equal_brute_force(spark):
    rng = random.Random(7)
    vocabulary = ["the", "of", "New", "york", "City", "été", "x-ray", "\U0001F600", "a", "b", "c", "d"]
    rows = []
    for i in range(400):
        words = rng.choices(vocabulary, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            words[len(words) // 2:len(words) // 2] = ["in", "New", "York", "City"]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "!"]) for w in words)
        rows.append((rng.choice(["en", "en", "en", "de", None]), text))
    rows += [("en", None), ("en", ""), (None, "one two"), ("zz", " \t "), ("fr", "hot hot " * 40_000), ("fr", "Z" * 5000)]
    rows += rows[:20]  # repeated rows count again
    df = clashing(spark.createDataFrame(rows, "lang string, text string"), "h", "word", "c", "rank")
    want = brute_collocations(rows, least=10, top=50)
    assert len(want) > 60
    assert got_collocations(df, least=10, top=50) == want
    # a long text is cut only where a piece ends
    parts = co._cuts(b"a b c. " * 600_000)
    assert len(parts) > 3 and b"".join(parts) == b"a b c. " * 600_000 and all(p.endswith((b".", b" ")) for p in parts)


def test_collocations_with_a_crowded_bitmap(spark):
    """Pairs whose hash meets a kept one are counted too, and go by their exact sums."""
    rng = random.Random(1)
    rows = [("en", " ".join(str(int(rng.paretovariate(0.6))) for _ in range(200))) for _ in range(150)]
    df = spark.createDataFrame(rows, "lang string, text string")
    want = brute_collocations(rows)
    assert want and co.kept_pairs(co._base(df), 30, 5)[1] == 5
    assert got_collocations(df, map_bits=5) == want == got_collocations(df)


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert co.report(empty).collect() == []
    assert co.report(spark.createDataFrame([("en", None), (None, "")], "lang string, text string")).collect() == []


# ---------------------------------------------------------------- 12: url filter

def brute_url(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = host.translate(LOWER)
    fits = [(len(h + p), len(h), h + p, act) for act, h, p in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, None)))


URLS = [None, "", "no scheme", "http://", "https://A.Example.ORG/es/1", "https://example.org/en/12?x#y", "http://org/",
        "http://org", "http://xorg/", "http://my.org?q=/a", "http://a.com/fr/x", "http://a.com/fr", "http://com/de/",
        "x://b.COM/de/#", "http://a.net/en/1", "http://é.org/ü", "a://b://c.org/x", "http://a.org:80/es/", "http://h/\n/x",
        "http://" + "a" * 100_000 + ".org/", "http://a.com/fr/" + "x" * 100_000, "http://EXAMPLE.org/es/", "https://example.org/en/2"]


def test_hosts_paths_and_rules(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(1, URLS[4]), (None, URLS[5])]
    df = clashing(spark.createDataFrame(rows, "page_id long, url string"), "host", "path", "rule", "score")
    got = uf.report(df).collect()
    assert len(got) == len(rows)
    want = Counter((i, *brute_url(u, uf.RULES)[:3]) for i, u in rows)
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in got) == want
    for r in got:
        action = brute_url(f"x://{r.host}{r.path}", uf.RULES)[3] if r.host or r.path else None
        assert r.verdict == (action or ("block" if r.score >= 0.5 else "allow")) and 0 <= r.score <= 1


def test_longest_rule_wins_whatever_its_place(spark):
    rules = [("block", "a.net", "/x/long"), ("allow", "net", "/x/longer/"), ("block", "b.a.net", "/x"), ("allow", "net", "/")]
    urls = ["h://b.a.net/x/longer/1", "h://b.a.net/x/long", "h://c.net/x/longer/", "h://b.a.net/x", "h://b.a.net/", "h://net/y"]
    for order in (rules, rules[::-1]):
        df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
        got = {r.page_id: (r.rule, r.verdict) for r in uf.report(df, rules=order).collect()}
        assert got == {i: brute_url(u, rules)[2:] for i, u in enumerate(urls)}


def test_url_model_on_words_it_has_not_seen_together(spark):
    """Words of one kind in new hosts, subdomains and paths; unknown hosts are left alone."""
    bad = ["https://best-casino.example.net/en/77", "http://x.cheap-pills-shop.example.net/fr/9", "https://www.spam-links.example.net/en/1",
           "https://adult-video.example.net/", "http://cdn.adtrack1.example.net/en/5", "https://news.example.net/torrent/poker.html"]
    good = ["https://city-library.example.net/en/77", "http://x.garden-school.example.net/fr/9", "https://www.qwfpgj.net/en/1",
            "https://thnding.example.net/", "http://blog.riverbank.example.net/en/5", "https://news.example.net/history/music.html"]
    df = spark.createDataFrame(list(enumerate(bad + good)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in uf.report(df).collect()}
    assert [got[i] for i in range(len(got))] == ["block"] * len(bad) + ["allow"] * len(good)


def test_url_model_held_out(spark):
    """Every fourth url of the labelled table is held out: its words are known from other urls."""
    rows = [tuple(r) for r in uf.labelled_urls(spark).collect()]
    learn = [r for r in rows if zlib.crc32(r[0].encode()) % 4]
    held = [r for r in rows if not zlib.crc32(r[0].encode()) % 4]
    split = lambda urls: zip(*[[x.encode() for x in brute_url(u, [])[:2]] for u, _ in urls])
    hosts, paths = map(list, split(learn))
    model = uf.fit_rows(hosts, paths, np.array([y for _, y in learn]))
    right = (model.scores(*map(list, split(held))) >= 0.5) == np.array([y for _, y in held])
    assert len(held) > 100 and right.mean() > 0.9


def test_url_model_of_odd_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.net/"), (2, None)], "page_id long, url string")
    table = lambda rows: spark.createDataFrame(rows, "url string, blocked int")
    for rows, verdict in (([], "allow"), ([("h://x/", 0)], "allow"), ([("h://x/", 1), ("h://y/", None), (None, 0)], "block"),
                          ([("h://x/", 1), ("h://x/", 0)], "block")):
        assert {r.verdict for r in uf.report(pages, table(rows)).collect()} == {verdict}
    assert uf.report(pages.limit(0)).collect() == []


# ---------------------------------------------------------------- 13: conversation trie

def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t, key=lambda x: x[:3])] for c, t in own.items()}
    seqs = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))  # the remainder has the sign of c, as in SQL
        seqs[c] = tuple(own.get(base, [])[:h] + t[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in seqs.items():
        ends[s].append(c)
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids, leaves, saved = Counter(), Counter(), Counter()
    for p in sorted(members, key=len, reverse=True):
        if p:
            saved[p] += (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1]))
        leaves[p] = leaves[p] or 1
        if p:
            kids[p[:-1]] += 1
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items()), key=str)


def conversations(spark, rows):
    return clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "key", "depth", "n", "h")


def made_up(seed, n):
    rng = random.Random(seed)
    say = lambda: rng.choice(["", " ", "yes", "no no", "tell me\tmore\nnow", "é \U0001F600"])
    rows = []
    for c in rng.sample(range(-50, 4 * n), n):
        for i in range(rng.choice([1, 1, 2, 3, 4, 5, 8, 9, 17, 40])):
            rows.append((c, i if rng.random() < 0.95 else None, rng.choice(["user", "assistant", None]),
                         say() if rng.random() < 0.95 else None))
    # a hot conversation, a hot opening of 12 turns that then parts, one long chain, repeated turns
    rows += [(10_000 + c, i, "user", "same again") for c in range(80) for i in range(6)]
    rows += [(20_000 + c, i, "user", f"step {i}" if i < 15 else say()) for c in range(80) for i in range(20)]
    rows += [(30_001, i, "assistant", "on and on") for i in range(70)]
    rows += [(40_001, 1, "user", "twice")] * 2 + [(None, 0, "user", "no conversation")]
    seen = set()  # ties of a turn are left out: their order is the operator's own
    out = []
    for r in rows:
        if (r[0], r[1], r[2] or "") not in seen or r[0] == 40_001:
            seen.add((r[0], r[1], r[2] or ""))
            out.append(r)
    return out


@pytest.mark.parametrize("group_levels", [ct.GROUP_LEVELS, 40])
def test_trie_equals_brute_force(spark, group_levels):
    rows = made_up(group_levels, 120)
    got = ct.trie(ct.rebuilt(conversations(spark, rows)), group_levels)
    assert sorted(map(tuple, got.collect()), key=str) == brute_trie(rows)


def test_trie_of_little(spark):
    for rows in ([], [(None, 1, "user", "x")], [(7, 0, None, None)], [(21, 0, "user", "a b")],
                 [(20, 0, "user", "a b"), (20, 1, "user", "c"), (21, 0, "user", "d"), (22, 0, "user", "e")]):
        got = ct.report(conversations(spark, rows))
        assert sorted(map(tuple, got.collect()), key=str) == brute_trie(rows)


def test_id_lists_are_cut_into_pieces(spark, monkeypatch):
    """A node where many conversations end: its digest runs over several pieces and tasks."""
    monkeypatch.setattr(ct, "PIECE", 64)
    ids = [c * 20 + 1 for c in range(-500, 1500)]
    rows = [(c, 0, "user", "all the same") for c in ids]
    got = ct.report(conversations(spark, rows))
    assert sorted(map(tuple, got.collect()), key=str) == brute_trie(rows)


def test_bands_cover_every_depth():
    for depth in range(0, 200):
        got = ct.bands(depth)
        assert [b for _, b in got[1:]] == [a for a, _ in got[:-1]] and got[-1][0] == 0 and got[0][1] == max(depth, 1)


def test_registered():
    for key in ("op11_collocations", "op12_url_filter", "op13_conversation_trie"):
        assert key in catalog.QUERIES
    assert {"op11_collocations", "op13_conversation_trie"} <= set(catalog.SQL)
