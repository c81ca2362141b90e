"""Licence scan: generalised suffix automaton of licence tokens and matching statistics.

The automaton accepts every word sequence that occurs in any template (a licence sentence or a
phrase).  A text is streamed word by word: the automaton's state and the length of the longest match
ending at each word are the matching statistics.  Long matches (``min_match`` words or more) are
chained per template (a paragraph of a licence), and the share of a template's words so covered marks a
template label.  Licences borrow each other's wording, so where spans overlap the better covered template
stands: a span is dropped if more than half of its words lie in spans of a larger share.  Phrases
are found by their state in the suffix-link tree.

Scale: a map over documents, no shuffle; the automaton is built once per Python worker from the
given templates (text of a few KB that ships with the function), so its size is bounded by them.

Defined results: null text is empty: no words, no places, empty labels, score 0; very long texts are
streamed; repeated rows are each returned; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_texts, fold_words, text_frame
from .license_texts import PARAGRAPHS as TEMPLATES

# Phrases of the base labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

MIN_MATCH = 4
MIN_COVER = 0.6


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers (one pass per template, shared states)."""

    def __init__(self, templates: list[list[bytes]]):
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.paths: list[list[int]] = []
        for words in templates:
            last = 0
            path = [self.ids.setdefault(w, len(self.ids)) for w in words]
            self.paths.append(path)
            for c in path:
                last = self._extend(last, c)

    def _new(self, edges: dict[int, int], length: int, link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The state of exactly the strings of p followed by c, cut out of q where q has longer ones."""
        if self.length[p] + 1 == self.length[q]:
            return q
        twin = self._new(dict(self.next[q]), self.length[p] + 1, self.link[q])
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        self.link[q] = twin
        return twin

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, self.next[last][c], c)
        new, p = self._new({}, self.length[last] + 1, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][c], c)
        return new

    def marks(self, paths: dict[tuple[int, ...], str]) -> list[list[tuple[int, str]]]:
        """Per state: (length, label) of each of ``paths`` that is a suffix of the state's strings."""
        own: dict[int, list[tuple[int, str]]] = {}
        for path, label in paths.items():
            s = 0
            for c in path:
                s = self.next[s][c]
            own.setdefault(s, []).append((len(path), label))
        out: list[list[tuple[int, str]]] = [[] for _ in self.next]
        for s in sorted(range(len(self.next)), key=self.length.__getitem__):
            up = out[self.link[s]] if s else []
            out[s] = own.get(s, []) + up
        return out


class Scanner:
    """The automaton with what the chaining needs: templates' words and the phrases' marks."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, list[str]], min_match: int, min_cover: float):
        named = [(fold_words(t.encode()), label, False) for label, ts in templates.items() for t in ts]
        named += [(fold_words(p.encode()), label, True) for p, label in phrases.items()]
        self.auto = SuffixAutomaton([w for w, _, _ in named])
        self.min_match, self.min_cover = min_match, min_cover
        self.shortest = min([len(w) for w, _, is_phrase in named if is_phrase] + [min_match])
        self.marks = self.auto.marks({tuple(p): label for p, (_, label, is_phrase) in zip(self.auto.paths, named)
                                      if is_phrase})
        self.templates = [(p, label) for p, (_, label, is_phrase) in zip(self.auto.paths, named) if not is_phrase]
        self.grams: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for k, (path, _) in enumerate(self.templates):
            n = min(min_match, len(path))
            for i in range(len(path) - n + 1):
                self.grams.setdefault(tuple(path[i:i + n]), []).append((k, i))

    def statistics(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(word index, state, match length) wherever a match of ``shortest`` words or more ends.

        Only runs of known words can hold one, so other stretches are skipped as a whole.
        """
        get, step, link, length = self.auto.ids.get, self.auto.next, self.auto.link, self.auto.length
        ids = np.array([get(w, -1) for w in words], dtype=np.int32)
        known = np.concatenate(([0], (ids >= 0).view(np.int8), [0]))
        edges = np.flatnonzero(np.diff(known))
        for lo, hi in zip(edges[0::2].tolist(), edges[1::2].tolist()):
            if hi - lo < self.shortest:
                continue
            state = n = 0
            for i, c in enumerate(ids[lo:hi].tolist(), lo):
                while state and c not in step[state]:
                    state = link[state]
                    n = length[state]
                if c in step[state]:
                    state = step[state][c]
                    n += 1
                if n >= self.shortest:
                    yield i, state, n

    def scan(self, text: bytes) -> dict:
        words = fold_words(text)
        places: list[tuple[int, str]] = []
        ends: list[tuple[int, int]] = []
        for i, state, n in self.statistics(words):
            places += [(i - m + 1, label) for m, label in self.marks[state] if m <= n]
            if n >= self.min_match:
                ends.append((i, n))
        spans, best = self._chain(words, ends)
        base = sorted({label for _, label in places})
        return {"n_words": len(words), "n_base": len(places), "places": sorted(places), "base": base,
                "labels": sorted({*base, *(label for _, _, label, _ in spans)}), "spans": spans,
                "score": max([best, *(1.0 for _ in places[:1])], default=0.0)}

    def _chain(self, words: list[bytes], ends: list[tuple[int, int]]):
        """Long matches as maximal stretches, chained on each template in order of its words."""
        stretches: list[tuple[int, int]] = []
        for k, (i, n) in enumerate(ends):
            if k + 1 == len(ends) or ends[k + 1] != (i + 1, n + 1):
                stretches.append((i - n + 1, i + 1))
        covered: dict[int, list[tuple[int, int, int]]] = {}
        for lo, hi in stretches:
            path = [self.auto.ids[w] for w in words[lo:hi]]
            for k, at in self.grams.get(tuple(path[:self.min_match]), ()):
                if self.templates[k][0][at:at + len(path)] == path:
                    covered.setdefault(k, []).append((lo, hi, at))
        spans, best = [], 0.0
        for k, found in covered.items():
            path, label = self.templates[k]
            chain: list[tuple[int, int, int]] = []
            for lo, hi, at in [*found, (None, None, None)]:
                fits = chain and lo is not None and at >= chain[-1][2] + chain[-1][1] - chain[-1][0] \
                    and 0 <= lo - chain[-1][1] <= len(path)
                if chain and not fits:
                    share = sum(b - a for a, b, _ in chain) / len(path)
                    best = max(best, min(1.0, share))
                    if share >= self.min_cover:
                        spans.append((chain[0][0], chain[-1][1], label, share))
                    chain = []
                if lo is not None:
                    chain.append((lo, hi, at))
        return sorted(_better(spans, len(words))), best


def _better(spans: list[tuple[int, int, str, float]], n: int) -> list[tuple[int, int, str, float]]:
    """The spans of which at most half the words lie in spans of a larger share."""
    if len(spans) < 2:
        return spans
    high = np.zeros(n)
    for a, b, _, share in spans:
        np.maximum(high[a:b], share, out=high[a:b])
    return [s for s in spans if (high[s[0]:s[1]] > s[3] + 1e-9).mean() <= 0.5]


_BUILT: dict[tuple, Scanner] = {}
SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
          "labels string, score double, spans array<struct<first:long,last:long,label:string,cover:double>>")


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, list[str]] | None = None,
         min_match: int = MIN_MATCH, min_cover: float = MIN_COVER) -> DataFrame:
    """One row per document: places of the phrases, labels, template spans (word indexes) and a score,
    the largest covered share of a template (1 where a phrase stands)."""
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string()),
                               ("cover", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (repr(phrases), repr(templates), min_match, min_cover)
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = Scanner(phrases, templates, min_match, min_cover)
        scanner = _BUILT[key]
        for batch in batches:
            found = [scanner.scan(t) for t in byte_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([r["n_words"] for r in found], pa.int64()),
                pa.array([r["n_base"] for r in found], pa.int64()),
                pa.array([r["places"][0][0] if r["places"] else None for r in found], pa.int64()),
                pa.array([r["places"][-1][0] if r["places"] else None for r in found], pa.int64()),
                pa.array([",".join(r["base"]) for r in found], pa.string()),
                pa.array([",".join(r["labels"]) for r in found], pa.string()),
                pa.array([r["score"] for r in found], pa.float64()),
                pa.array([[{"first": a, "last": b - 1, "label": n, "cover": c} for a, b, n, c in r["spans"]]
                          for r in found], span)], names=names[:8] + ["spans"])
    return text_frame(docs).mapInArrow(run, SCHEMA)
