"""Toxicity by a linear-chain conditional random field over tokens.

The labels say of documents what they say of tokens: all tokens of a clean
document are labelled clean, of a toxic one some token is toxic, it isn't known
which. The field has two states and sees all features of a token; its weights
are fitted by the likelihood of these labels, with the forward and backward
messages of whole texts. A token's marginal marks the offending offsets; the
marginals' sum and the surest of them make the document's score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import common

TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
STRIPPED = re.compile(r"^\W+|\W+$")


WIDTH = 9


def word_features(token: str) -> list[int]:
    """Hashes of the token without outer punctuation in lower case, its beginnings of 3 to 7 letters, its last 3, its shape: WIDTH at most."""
    w = STRIPPED.sub("", token.lower())
    if not w:
        return []
    shape = ("A" if token.isupper() else "a") + ("0" if any(c.isdigit() for c in w) else "") + ("+" if len(w) > 12 else "")
    named = [f"w:{w}", f"s:{shape}", *(f"{n}:{w[:n]}" for n in (3, 4, 5, 6, 7) if len(w) > n), *([f"e:{w[-3:]}"] if len(w) > 3 else [])]
    return [zlib.crc32(x.encode()) for x in named]


@dataclass
class Field:
    """Weights of the toxic state against the other one; link[i, j]: from state i to j."""

    weights: dict[int, float]
    bias: float
    link: np.ndarray
    document: np.ndarray = field(default_factory=lambda: np.zeros(4))

    def emission(self, token: str) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in word_features(token))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def arriving(a: np.ndarray, link: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Odds of the toxic state that reach each step from those before it, for the odds a of the steps' own emissions.

    1 where a text begins. A span of steps maps the odds that reach it as a 2x2
    matrix does: the matrices of all spans are made side by side, the odds go
    through them one span after the other, and then through the steps of all
    spans side by side. Nothing is cut off, whatever a text's length.
    """
    n = len(a)
    span = min(512, max(16, int(n**0.5)))
    rows = -(-n // span)
    own, begins = np.ones(rows * span), np.ones(rows * span, bool)
    own[1:n], begins[:n] = a[: n - 1], first  # own: of the step before
    own, begins = np.ascontiguousarray(own.reshape(rows, span).T), np.ascontiguousarray(begins.reshape(rows, span).T)
    (p, q), (r, s) = np.exp(link - link.max())
    up, down = s * own, r * own
    m = np.zeros((2, 2, rows))
    m[0, 0] = m[1, 1] = 1.0
    for t in range(span):
        top, low = up[t] * m[0] + q * m[1], down[t] * m[0] + p * m[1]
        low += np.where(low > 0, 0.0, 1e-300)
        top = np.where(begins[t], low, top)
        m[0], m[1] = top, low
        m /= m.max(axis=(0, 1))
    odds, x = np.empty(rows), 1.0
    for k, (b, c, d, e) in enumerate(zip(*m.reshape(4, rows).tolist(), strict=True)):
        odds[k] = x
        x = (b * x + c) / (d * x + e)
    out = np.empty((span, rows))
    for t in range(span):
        odds = np.where(begins[t], 1.0, (up[t] * odds + q) / (down[t] * odds + p))
        out[t] = odds
    return out.T.reshape(-1)[:n]


def both_ways(e: np.ndarray, link: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own odds of each step, and those that reach it from the left and from the right, for texts one behind the other.

    An emission counts e**60 at most.
    """
    a = np.exp(np.clip(e, -60, 60))
    last = np.append(first[1:], True)
    return a, arriving(a, link, first), arriving(a[::-1], link.T, last[::-1])[::-1]


def marginals(e: np.ndarray, link: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each token's probability of the toxic state, for the emissions of texts one behind the other; first marks where one begins."""
    if not len(e):
        return np.zeros(0)
    a, left, right = both_ways(e, link, first)
    x = a * left * right
    return x / (1 + x)


def one_of_copies(texts: list[str], shingle: int = 5, sketch: int = 8, shared: int = 4) -> list[int]:
    """Places of the texts that aren't near copies of one before: a text that a corpus repeats would mark all its words.

    Two are if they share `shared` of their `sketch` least shingle hashes.
    """
    seen: dict[int, list[int]] = {}
    kept = []
    for i, x in enumerate(texts):
        w = x.lower().split()
        least = sorted({zlib.crc32(" ".join(w[k : k + shingle]).encode()) for k in range(max(1, len(w) - shingle + 1))})[:sketch]
        met = Counter(j for h in least for j in seen.get(h, ()))
        if met and max(met.values()) >= min(shared, len(least)):
            continue
        kept.append(i)
        for h in least:
            seen.setdefault(h, []).append(i)
    return kept


def _emissions(w: np.ndarray, of_word: np.ndarray, bias: float) -> np.ndarray:
    return bias + sum(w[of_word[:, f]] for f in range(WIDTH))


def _begins(n: int, starts: np.ndarray) -> np.ndarray:
    first = np.zeros(n, bool)
    first[starts] = True
    return first


def _parts(lengths: np.ndarray, labels: np.ndarray, most: int = 2**19) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last place, starts and labels of whole texts one behind the other, about `most` tokens a part: memory follows a part."""
    out, ends, d = [], np.cumsum(lengths), 0
    while d < len(ends):
        i = int(ends[d] - lengths[d])
        k = max(d + 1, int(np.searchsorted(ends, i + most, "right")))
        out.append((i, int(ends[k - 1]), ends[d:k] - lengths[d:k] - i, labels[d:k]))
        d = k
    return out


def _gaps(e: np.ndarray, link: np.ndarray, starts: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How the log likelihood of texts' labels grows with each emission, and with each link."""
    first = _begins(len(e), starts)
    a, left, right = both_ways(e, link, first)
    p = a * left * right
    p /= 1 + p
    # a step is toxic after a clean one with these odds: how likely is it that none ever is
    odds = a * right * np.where(first, 1.0, np.exp(link[0, 1] - link[0, 0]))
    none = np.exp(-np.add.reduceat(np.log1p(odds), starts))
    pull = np.repeat(np.where(toxic, none / np.maximum(1 - none, 1e-9), -1.0), np.diff(np.append(starts, len(e))))
    inner = ~first[1:]  # steps that have one before them in their text
    x, y = (a * left)[:-1][inner], (a * right)[1:][inner]
    pairs = np.stack([np.ones_like(x), y, x, x * y]) * np.exp(link).reshape(4, 1)
    pairs /= pairs.sum(axis=0)
    pairs[0] -= 1.0
    return pull * p, pairs @ pull[1:][inner]


def fit(texts: list[str], toxic: list[int], steps: int = 80, least_docs: int = 3, ridge: float = 0.3) -> Field:
    """The field of labelled texts, whole ones; features of fewer than least_docs texts teach nothing.

    What is fitted is the likelihood of the labels: of a clean text, that all
    its tokens are clean; of a toxic one, that not all are. Without texts of
    both labels every text gets the same low score.
    """
    kept = one_of_copies(texts)
    texts, toxic = [texts[i] for i in kept], [toxic[i] for i in kept]
    words: dict[str, int] = {}
    docs = [np.array([words.setdefault(t, len(words)) for t in TOKEN.findall(x)], np.int32) for x in texts]
    del texts
    labels = np.array([bool(y) for y, doc in zip(toxic, docs, strict=True) if len(doc)])
    docs = [doc for doc in docs if len(doc)]
    if labels.all() or not labels.any():
        return Field({}, -8.0, np.zeros((2, 2)), np.array([-4.0, 0, 0, 0]))
    of_word = np.zeros((len(words), WIDTH), np.uint32)
    for t, i in words.items():
        own = word_features(t)
        of_word[i, : len(own)] = own
    del words
    names, of_word = np.unique(np.append(of_word, np.uint32(0)), return_inverse=True)
    of_word = of_word[:-1].reshape(-1, WIDTH)
    seen = np.zeros(len(names), np.int64)
    for doc in docs:
        seen[np.unique(of_word[np.unique(doc)])] += 1
    taught = np.nonzero((seen >= least_docs) & (names > 0))[0]
    place = np.zeros(len(names), np.int32)
    place[taught] = np.arange(1, len(taught) + 1)
    of_word = place[of_word]
    tokens = np.concatenate(docs)
    lengths = np.array([len(doc) for doc in docs])
    del docs, seen
    parts = _parts(lengths, labels)
    w, bias, link = np.zeros(len(taught) + 1), -4.0, np.zeros((2, 2))
    moment, size = np.zeros(len(w) + 5), np.zeros(len(w) + 5)
    for k in range(1, steps + 1):
        emission = _emissions(w, of_word, bias)
        of_words, total, of_links = np.zeros(len(of_word)), 0.0, np.zeros(4)
        for i, j, starts, toxic in parts:
            gap, links = _gaps(emission[tokens[i:j]], link, starts, toxic)
            of_words += np.bincount(tokens[i:j], gap, len(of_word))
            total, of_links = total + gap.sum(), of_links + links
        gradient = np.concatenate([sum(np.bincount(of_word[:, f], of_words, len(w)) for f in range(WIDTH)), [total], of_links])
        gradient[: len(w)] -= ridge * w
        gradient[-4:] -= link.ravel()
        moment, size = 0.9 * moment + 0.1 * gradient, 0.99 * size + 0.01 * gradient**2
        step = 0.1 * (moment / (1 - 0.9**k)) / (np.sqrt(size / (1 - 0.99**k)) + 1e-3)
        w, bias, link = w + step[: len(w)], bias + step[len(w)], link + step[-4:].reshape(2, 2)
        w[0] = 0.0
    found = Field({int(names[f]): float(x) for f, x in zip(taught, w[1:], strict=True) if abs(x) > 1e-3}, float(bias), link)
    emission, x = _emissions(w, of_word, bias), []
    for i, j, starts, _ in parts:
        p = marginals(emission[tokens[i:j]], link, _begins(j - i, starts))
        x += [summary(own) for own in np.split(p, starts[1:])]
    found.document = _logistic(np.array(x), labels.astype(float))
    return found


def summary(p: np.ndarray) -> tuple[float, float, float]:
    """What a document's marginals sum up to: log of the expected number of toxic tokens, the surest one, and the second."""
    if not len(p):
        return 0.0, 0.0, 0.0
    top = np.partition(p, len(p) - 2)[-2:] if len(p) > 1 else np.array([0.0, p[0]])
    return float(np.log1p(p[p > 0.02].sum())), float(top[1]), float(top[0])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Constant and weights by Newton's method, with a ridge; the rarer label counts more, by the root of what it is rarer."""
    x = np.column_stack([np.ones(len(x)), x])
    each = np.where(y > 0, np.sqrt((1 - y).sum() / y.sum()), 1.0)
    held = np.diag([1e-3, *[ridge] * (x.shape[1] - 1)])
    b = np.zeros(x.shape[1])
    for _ in range(40):
        p = _sigmoid(x @ b)
        b += np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + held, x.T @ (each * (y - p)) - held @ b)
    return b


class Scorer:
    """Scores texts by a field; emissions of words met are kept, up to a bound."""

    def __init__(self, model: Field, most_words: int = 400_000):
        self.model, self.most, self.known = model, most_words, {}

    def emissions(self, tokens: list[str]) -> list[float]:
        known = self.known
        try:
            return [known[t] for t in tokens]
        except KeyError:
            if len(known) > self.most:
                known.clear()
            for t in tokens:
                if t not in known:
                    known[t] = self.model.emission(t)
            return [known[t] for t in tokens]

    def many(self, texts: list[str | None]) -> Iterator[tuple[float, list[tuple[int, int, float]]]]:
        """Score and offending spans (start, end, marginal), in code points, of each text."""
        split = [TOKEN.findall(t or "") for t in texts]
        flat: list[float] = []
        starts = []
        for tokens in split:
            starts.append(len(flat))
            flat += self.emissions(tokens)
        begins = np.zeros(len(flat) + 1, bool)
        begins[starts] = True
        p = marginals(np.array(flat), self.model.link, begins[:-1])
        for text, tokens, s in zip(texts, split, starts, strict=True):
            own = p[s : s + len(tokens)]
            score = float(_sigmoid(self.model.document @ np.array([1.0, *summary(own)])))
            spans = []
            if (own > 0.5).any():
                hit = set(np.nonzero(own > 0.5)[0].tolist())
                spans = [(m.start(), m.end(), float(own[k])) for k, m in enumerate(TOKEN.finditer(text)) if k in hit]
            yield score, spans


SPANS = "array<struct<start:int,end:int,marginal:double>>"


def learn(docs: DataFrame, labels: DataFrame, most_rows: int = 2000, most_chars: int = 2**16, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Field:
    """The field of labelled documents: of each label at most most_rows, those of least hashed id among the texts of up to most_chars code points.

    The bounds hold what the driver takes in; they make the only sample, but for
    near copies, which count once (one_of_copies). Null labels, null ids and
    texts without a word are left out before the rows are picked; of several
    texts of one id the least is taken.
    """
    own = labels.filter(F.col(label_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).distinct()
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).filter((F.length("__text") <= most_chars) & F.col("__text").rlike(common.WORD))
    usable = own.join(texts.select("__id").distinct(), "__id", "left_semi")
    picked = None
    for y in (0, 1):
        some = usable.filter(F.col("__y") == y).orderBy(F.xxhash64(F.lit("learn"), "__id"), "__id").limit(most_rows)
        picked = some if picked is None else picked.union(some)
    rows = texts.join(F.broadcast(picked), "__id").groupBy("__id", "__y").agg(F.min("__text").alias("__text")).collect()
    rows.sort(key=lambda r: (r["__id"], r["__y"]))
    found, toxic = [r["__text"] for r in rows], [r["__y"] for r in rows]
    del rows
    return fit(found, toxic)


def score(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """id, score (0 to 1) and spans (start, end, marginal) of every whole text; with keep, docs' own columns, then __score.

    Null and empty texts score as texts without a toxic token. Rows that
    repeat, ties and null ids are scored row by row; other columns don't count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            for part, texts in common.by_bytes(b, text_col):
                found = list(scorer.many(texts))
                scores = pa.array([s for s, _ in found], pa.float64())
                if keep:
                    yield pa.record_batch([*part.columns, scores], [*part.schema.names, "__score"])
                else:
                    spans = pa.array([[dict(zip(("start", "end", "marginal"), x, strict=True)) for x in s] for _, s in found], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())])))
                    yield pa.record_batch([part.column(id_col), scores, spans], [id_col, "score", "spans"])

    if keep:
        return docs.mapInArrow(common.lean(run), StructType([*docs.schema.fields, StructField("__score", DoubleType())]))
    return docs.select(id_col, text_col).mapInArrow(common.lean(run), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double, spans {SPANS}")


def held_out(id_col: str = "doc_id"):
    """The rows that are not learnt from: remainder 1 of crc32 of the id as text, by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
