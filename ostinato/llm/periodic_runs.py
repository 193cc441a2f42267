"""All runs (maximal periodic stretches) of the words of a text, by the method of Kolpakov and Kucherov.

1. The text is cut into Lempel-Ziv factors, each the longest stretch that also
   occurs from an earlier place, read off a suffix automaton whose states know
   where their strings end first.
2. At each border between factors, Main's algorithm finds the runs that touch
   it: for each period the longest common extensions to both sides come from
   two Z-functions. A run that reaches beyond the factor behind the border is
   left to a later one; none goes back further than twice the factor before
   the border and once the one behind it, as that factor would otherwise have
   been longer.
3. Runs strictly inside a factor are copies of runs at its earlier place, which
   are all known by then.

All three take time in proportion to the words. A run of at least `least` words
and `times` periods needs words that repeat a short distance on: in it, each
word lies in a stretch of `least` - `least` // `times` words that stands twice in
the text. Such stretches are found by sorted hashes for many texts at once, and
the method runs on what they cover: a maximal covered part holds each of its
runs whole, and the words beside it extend none. A false match of hashes only
makes a part larger.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

U = np.uint64


def factors(s: Sequence[int]) -> list[tuple[int, int, int]]:
    """s as (start, length, earlier start): the longest stretches that also start earlier; -1 with a length of 1 for a new word.

    A state of the automaton keeps its first way out in two arrays, as most have
    no other, and further ones in a dictionary.
    """
    size, link, first, by, to = (array("q", [v]) for v in (0, -1, -1, -1, 0))
    more: dict[int, dict[int, int]] = {}

    def step(u: int, c: int) -> int:
        if by[u] == c:
            return to[u]
        return more[u].get(c, -1) if u in more else -1

    def put(u: int, c: int, v: int) -> None:
        if by[u] == c or by[u] == -1:
            by[u], to[u] = c, v
        else:
            more.setdefault(u, {})[c] = v

    def state(length: int, back: int, end: int) -> int:
        size.append(length)
        link.append(back)
        first.append(end)
        by.append(-1)
        to.append(0)
        return len(size) - 1

    last = 0
    for i, c in enumerate(s):
        new = state(size[last] + 1, 0, i)
        u = last
        while u >= 0 and (q := step(u, c)) < 0:
            put(u, c, new)
            u = link[u]
        if u >= 0:
            if size[q] == size[u] + 1:
                link[new] = q
            else:
                half = state(size[u] + 1, link[q], first[q])
                by[half], to[half] = by[q], to[q]
                if q in more:
                    more[half] = dict(more[q])
                while u >= 0 and step(u, c) == q:
                    put(u, c, half)
                    u = link[u]
                link[q] = link[new] = half
        last = new
    out, i, n = [], 0, len(s)
    while i < n:
        u, length = 0, 0
        while i + length < n:
            v = step(u, s[i + length])
            if first[v] == i + length:  # its first occurrence is this one
                break
            u, length = v, length + 1
        out.append((i, length, first[u] - length + 1) if length else (i, 1, -1))
        i += max(length, 1)
    return out


def z_function(s: Sequence[int]) -> list[int]:
    """For each place, how long s from there agrees with s from its start (0 at the start itself)."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def touching(s: Sequence[int], low: int, border: int, end: int, least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """Runs (start, end, period) that touch the border, start at low or later and end by `end`."""
    n, before, behind = len(s), border - low, end - border
    back = s[low:end][::-1]
    ahead = z_function([*s[border:end], -1, *s[low:end]])[behind + 1 :]  # from low + j: agreement with what follows the border
    behind_z = z_function([*back[behind:], -1, *back])[before + 1 :]  # from end - 1 - j backwards: agreement with what precedes the border
    for q in range(1, max(before, behind) + 1):
        need = max(least, times * q) - q
        spans = []
        if q <= behind:  # the period behind the border
            left = behind_z[behind - q]
            right = ahead[before + q] if q < behind else 0
            if left + right >= need:
                spans.append((border - left, border + q + right))
        if q <= before:  # the period before the border
            left = behind_z[behind + q] if q < before else 0
            right = ahead[before - q] if behind else 0
            if left + right >= need:
                spans.append((border - q - left, border + right))
        for a, z in spans:
            if (a == 0 or s[a - 1] != s[a - 1 + q]) and (z == n or s[z] != s[z - q]):
                yield a, z, q


def runs(s: Sequence[int], least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """All (start, length, period) of runs of at least `least` words and `times` (2 or more) smallest periods, by start and period."""
    cut = factors(s)
    found: dict[tuple[int, int], int] = {}
    starts: dict[int, list[int]] = {}

    def note(a: int, z: int, q: int) -> None:
        if (a, z) not in found:
            starts.setdefault(a, []).append(z)
            found[a, z] = q
        elif q < found[a, z]:
            found[a, z] = q

    previous = 0
    for border, length, source in [*cut, (len(s), 0, -1)]:
        g = border - previous
        if 2 * (g + length) >= least:
            for a, z, q in touching(s, max(0, border - 2 * g - length), border, border + length, least, times):
                note(a, z, q)
        if source >= 0 and length > least:
            shift = border - source
            for a in range(border + 1, border + length - least):
                for z in starts.get(a - shift, ()):
                    if z + shift < border + length:
                        note(a, z + shift, found[a - shift, z])
        previous = border
    return sorted((a, z - a, q) for (a, z), q in found.items())


def repeated_parts(hashes: np.ndarray, text: np.ndarray, k: int) -> np.ndarray:
    """Whether each word lies in a stretch of k words that stands again in the same text."""
    n = len(hashes) - k + 1
    covered = np.zeros(len(hashes), bool)
    if n <= 1:
        return covered
    grams, width, weight = hashes.copy(), 1, 0x9E3779B97F4A7C15
    whole, done = np.zeros(n, U), 0
    while True:  # stretches of 1, 2, 4, ... words; those that k is made of are put together
        if k & width:
            whole = whole * U(weight) + grams[done : done + n]
            done += width
        if done == k:
            break
        grams = (grams[:-width] ^ (grams[:-width] >> U(29))) * U(weight) + grams[width:]
        weight = weight * weight % 2**64
        width *= 2
    own = np.nonzero(text[:n] == text[k - 1 :])[0]
    key = (whole[own] ^ (whole[own] >> U(32))) * U(0xD6E8FEB86659FD93) + text[own].astype(U) * U(0xBF58476D1CE4E5B9)
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(own), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edges, own[twice], 1)
    np.add.at(edges, own[twice] + k, -1)
    return np.cumsum(edges[:-1]) > 0


def runs_of_texts(texts: list[list[bytes]], least: int, times: int) -> list[list[tuple[int, int, int]]]:
    """runs of each text's words."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    hashes = np.fromiter((hash(w) for words in texts for w in words), np.int64, int(sizes.sum())).view(U)
    text = np.repeat(np.arange(len(texts)), sizes)
    covered = repeated_parts(hashes, text, least - least // times)
    # a part ends where its text ends
    new = np.concatenate([[True], (covered[1:] != covered[:-1]) | (text[1:] != text[:-1])]) if len(text) else np.zeros(0, bool)
    begins = np.nonzero(new)[0]
    ends = np.append(begins, len(text))[1:]
    first = np.cumsum(sizes) - sizes
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for a, z in zip(begins.tolist(), ends.tolist(), strict=True):
        if covered[a] and z - a >= least:
            t = int(text[a])
            at = a - int(first[t])
            known: dict[bytes, int] = {}
            s = [known.setdefault(w, len(known)) for w in texts[t][at : at + z - a]]
            out[t] += [(at + b, length, q) for b, length, q in runs(s, least, times)]
    return out


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_OUT = pa.schema([("n_words", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("runs", pa.list_(_RUN))])


def _better(a: tuple[int, int, int], b: tuple[int, int, int]) -> bool:
    """Whether run a has the greater length / period, then the smaller start, then the smaller period."""
    x, y = a[1] * b[2], b[1] * a[2]
    return (-x, a[0], a[2]) < (-y, b[0], b[2])


def collapse(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words less those that a run holds after its first period."""
    if not found:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for a, length, q in found:
        edges[a + q] += 1
        edges[a + length] -= 1
    gone = np.cumsum(edges[:-1]) > 0
    return [w for w, x in zip(words, gone.tolist(), strict=True) if not x]


def _row(words: list[bytes], found: list[tuple[int, int, int]]) -> tuple:
    best = None
    for r in found:
        if best is None or _better(r, best):
            best = r
    said = "".join(f"{a},{length},{q}\n" for a, length, q in found)
    kept = hashlib.sha256(b" ".join(collapse(words, found))).hexdigest()
    return len(words), len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(said.encode()).hexdigest(), kept, [{"start": a, "length": length, "period": q} for a, length, q in found]


def find_runs(docs: DataFrame, least: int = 24, times: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, n_words, n_runs, the run of greatest length / period (start, length, period, exponent_milli), runs_sha256, collapsed_sha256, runs.

    Words are cut at ASCII white space and numbered from 0. A run is a stretch of
    words with smallest period q, of at least `least` words and `times` * q
    (times is 2 or more), that neither neighbour extends keeping the period. Of
    runs that tie in length / period the one of the smallest start, then period
    counts; without runs its four columns are null. collapsed_sha256 is of the
    words joined by one space, less those a run holds after its first q words.
    runs has all of them by start, then period.

    Each row is judged for itself: rows of one id, equal rows and a null id are
    rows like others. A null text has no words. Other columns of any name aren't
    read. An empty table gives an empty result. A text is held whole in a task;
    time and memory go in proportion to its words.
    """
    if times < 2 or least < 2:
        raise ValueError("a run has two periods and two words at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in common.by_bytes(b, "__text"):
                words = [(t or b"").split() for t in texts]
                rows = map(_row, words, runs_of_texts(words, least, times))
                cols = list(zip(*rows, strict=True)) or [()] * len(_OUT)
                yield pa.record_batch([part.column(0), *(pa.array(c, f.type) for c, f in zip(cols, _OUT, strict=True))], [id_col, *_OUT.names])

    given = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("__text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return given.mapInArrow(common.lean(run), f"`{id_col}` {kind}, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>")
