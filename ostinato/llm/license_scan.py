"""Licence detections: ordered signature rules behind a keyword prefilter, overlaps settled by priority and containment.

A text is lower-cased (A-Z only) and read as its words joined by one space. One
pass of an Aho-Corasick automaton over that tells which rules' keywords occur;
only their patterns run. Detections are then settled class by class, from the
highest priority down:

* one that shares a word with a detection of higher priority that stands goes;
* of one priority, one that lies within another goes; if they cover the same
  words, the rule that comes first stands.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Sequence
from itertools import groupby
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .license_rules import RULES, Rule

#: Bytes that are no part of a word: ASCII but for digits and letters.
_GAPS = bytes(x if x > 0x7F or chr(x).isalnum() else 0x20 for x in range(256))


class Hit(NamedTuple):
    """A rule's match, from its first word to behind its last."""

    start: int
    end: int
    rule: int


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_GAPS).split()


class Scanner:
    """Rules made ready: the automaton of their keywords and the compiled patterns."""

    def __init__(self, rules: Sequence[Rule]) -> None:
        self.rules = rules
        # words end at spaces, which neighbouring matches may share
        self.patterns = [re.compile(f"(?<![^ ])(?:{r.pattern})(?![^ ])") for r in rules]
        gated: dict[str, list[int]] = {}
        for i, r in enumerate(rules):
            gated.setdefault(r.keyword, []).append(i)
        self.keywords = ahocorasick.Automaton()
        for keyword, those in gated.items():
            self.keywords.add_word(keyword, (keyword, those))
        if gated:
            self.keywords.make_automaton()

    def candidates(self, said: str) -> list[int]:
        """The rules whose keyword occurs, in order."""
        if not self.rules:
            return []
        return sorted(i for _, those in {k: (k, v) for _, (k, v) in self.keywords.iter(said)}.values() for i in those)

    def hits(self, said: str) -> list[Hit]:
        """All matches of all rules, by place: a rule's own don't overlap each other."""
        found = sorted((m.start(), m.end(), i) for i in self.candidates(said) for m in self.patterns[i].finditer(said))
        out, at, word = [], 0, 0
        for begin, end, i in found:
            word += said.count(" ", at, begin)
            at = begin
            out.append(Hit(word, word + said.count(" ", begin, end) + 1, i))
        return out

    def settle(self, hits: list[Hit]) -> list[Hit]:
        """The detections that stand, by place."""
        taken, stand = _Covered(), []
        ranked = sorted(hits, key=lambda h: (-self.rules[h.rule].priority, h.start, -h.end, h.rule))
        for _, rank in groupby(ranked, key=lambda h: self.rules[h.rule].priority):
            free = [h for h in rank if not taken.touches(h.start, h.end)]
            reach, here = -1, []
            for h in free:  # by start, the longest first: one lies within another if it ends by where an earlier one reached
                if h.end > reach:
                    here.append(h)
                    reach = h.end
            taken.add(here)
            stand += here
        return sorted(stand)


class _Covered:
    """Word intervals that are taken, merged and sorted, so that a look-up is a binary search."""

    def __init__(self) -> None:
        self.starts, self.ends = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def touches(self, start: int, end: int) -> bool:
        i = int(np.searchsorted(self.ends, start, "right"))
        return i < len(self.starts) and bool(self.starts[i] < end)

    def add(self, hits: list[Hit]) -> None:
        merged: list[list[int]] = []
        for s, e in sorted([*zip(self.starts.tolist(), self.ends.tolist(), strict=True), *((h.start, h.end) for h in hits)]):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(e, merged[-1][1])
            else:
                merged.append([s, e])
        self.starts, self.ends = (np.array([m[i] for m in merged], np.int64) for i in (0, 1))


@functools.cache
def _scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


_DETECTION = pa.struct([("rule", pa.int32()), ("label", pa.string()), ("priority", pa.int32()), ("start", pa.int64()), ("length", pa.int64())])
_OUT = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("detections", pa.list_(_DETECTION))])


def judge(text: bytes, scanner: Scanner) -> tuple:
    """One text's row of _OUT."""
    words = words_of(text)
    rules = scanner.rules
    hits = scanner.hits(b" ".join(words).decode()) if words else []
    base = [h for h in hits if rules[h.rule].base]
    stand = scanner.settle(hits)
    named = {rules[h.rule].label for h in base}
    best: dict[str, int] = {}
    for h in stand:
        best[rules[h.rule].label] = max(best.get(rules[h.rule].label, 0), rules[h.rule].priority)
    doubt = 1.0
    for label in sorted(best):
        doubt *= 1 - best[label] / 100
    told = [{"rule": h.rule, "label": rules[h.rule].label, "priority": rules[h.rule].priority, "start": h.start, "length": h.end - h.start} for h in stand]
    return len(words), len(base), base[0].start if base else None, base[-1].start if base else None, ",".join(sorted(named)), ",".join(sorted(named | set(best))), 1 - doubt, told


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    Words are runs of ASCII letters and digits and of anything beyond ASCII,
    numbered from 0. n_base counts all places of the rules marked base, which
    are plain phrases; first_word and last_word are the least and greatest start
    among them, null if there are none. base_labels and labels are distinct,
    sorted and joined by commas ('' for none): labels has those of the base and
    of all detections that stand. score is 1 less the product, over the labels
    that stand, of 1 less the best priority / 100: 0 without a detection.
    detections (rule, label, priority, start, length) are those that stand.

    Each row is judged for itself: rows of one id, equal rows and a null id are
    rows like others. A null text counts as empty and has no words. Other
    columns of any name aren't read. An empty table gives an empty result. A
    text is held whole in a task, its patterns look at bounded stretches.
    """
    rules = tuple(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(rules)
        for b in batches:
            for part, texts in common.by_bytes(b, "__text"):
                cols = list(zip(*(judge(t or b"", scanner) for t in texts), strict=True)) or [()] * len(_OUT)
                yield pa.record_batch([part.column(0), *(pa.array(c, f.type) for c, f in zip(cols, _OUT, strict=True))], [id_col, *_OUT.names])

    given = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("__text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return given.mapInArrow(common.lean(run), f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<rule:int,label:string,priority:int,start:long,length:long>>")


def mentions(label: str | Column, labels: str = "labels") -> Column:
    """Whether a row's labels hold one, for a filter of what scan returns."""
    return F.array_contains(F.split(labels, ","), label)
