"""Prediction by partial matching: code lengths of texts under a byte-context trie.

The trie is trained once on a corpus ("pretrained"). A text is its words, each
followed by a space, and at last an end symbol; before it stand end symbols. A
byte's contexts are the 0 to `order` bytes before it, across words. A symbol
that a context hasn't seen escapes to the next shorter one, where the symbols
of the longer context are excluded.

So a byte's probability depends on it and the `order` bytes before it: a gram.
The whole corpus comes down to a table of distinct grams with their counts, of
which a trie of all orders follows, as a shorter context's counts are sums over
the longer ones. Grams are dealt over the tasks by the NEAR bytes next to the
symbol: whatever contexts of NEAR bytes or more a gram has are then in one task,
and shorter contexts, of which there are 65,793 at most, are known to all.
Words are counted and looked up in the same table, under their hashes.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

U = np.uint64
END = 10
#: Contexts of so many bytes or more meet in the task that has all grams with these bytes.
NEAR = 3
#: Marks the key of a word: grams have at most 7 bytes.
WORD = U(1 << 63)

_rng = np.random.default_rng(11)
#: A number for each byte, none for the space, and the base of the words' hash.
_OF_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_OF_BYTE[32] = 0
_BASE = U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@functools.lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base to the powers from 0 to n - 1, and their inverses (modulo 2**64)."""
    inverse = U(pow(int(_BASE), -1, 2**64))
    return tuple(np.cumprod(np.concatenate([[U(1)], np.full(n - 1, x)])) for x in (_BASE, inverse))


def symbols(text: bytes | None, order: int) -> bytes:
    """The bytes of a text to predict, behind `order` end symbols."""
    words = (text or b"").lower().split()
    words.append(b"\n")
    return b"\n" * order + b" ".join(words)


def read(texts: list[bytes | None], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all bytes to predict the gram and its text; of all tokens the key and its text.

    A gram has the symbol in its lowest byte, the one before it in the next. A
    token's key is a hash of 63 bits: of a billion words two agree with a
    probability of 0.05, and their counts are then one.
    """
    if not texts:
        return np.zeros(0, U), np.zeros(0, np.int32), np.zeros(0, U), np.zeros(0, np.int32)
    parts = [symbols(t, order) for t in texts]
    raw = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    begins = np.cumsum(sizes) - sizes
    told = np.ones(len(raw), bool)
    for j in range(order):
        told[begins + j] = False
    gram = raw.astype(U)
    for j in range(1, order + 1):
        gram[j:] |= raw[:-j].astype(U) << U(8 * j)
    text = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
    opens = told & (raw != 32)
    opens[1:] &= (raw[:-1] == 32) | ~told[:-1]
    starts = np.nonzero(opens)[0]
    up, down = _powers(1 << (len(raw) - 1).bit_length())
    value = _OF_BYTE[raw]
    value *= told
    value *= up[: len(raw)]
    word = _mix(np.add.reduceat(value, starts) * down[starts]) | WORD
    return gram[told], text[told], word, text[starts]


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of n."""
    if not len(key):
        return key, n
    by = np.argsort(key)
    key, n = key[by], n[by]
    first = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
    return key[first], np.add.reduceat(n, first)


class Level:
    """The contexts of k bytes: sorted (context, symbol) keys, their counts, and each context's total and number of symbols."""

    def __init__(self, key: np.ndarray, n: np.ndarray):
        self.key, self.n = key, n
        context = key >> U(8)
        first = np.nonzero(np.concatenate([[True], context[1:] != context[:-1]]))[0] if len(key) else np.zeros(0, np.int64)
        self.context = context[first]
        self.degree = np.diff(np.append(first, len(key)))
        self.total = np.add.reduceat(n, first) if len(first) else np.zeros(0, np.int64)
        self.of_pair = np.repeat(np.arange(len(first)), self.degree)

    def shorter(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        return _summed(self.key & U((1 << 8 * (k + 1)) - 1), self.n)


def _place(sorted_: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(sorted_, asked)
    at[at == len(sorted_)] = 0
    return at, (sorted_[at] == asked if len(sorted_) else np.zeros(len(asked), bool))


def levels(key: np.ndarray, n: np.ndarray, order: int, down_to: int = 0) -> dict[int, Level]:
    """The trie's levels from `order` down, of the grams that were learnt."""
    made = {order: Level(*_summed(key, n))}
    for k in range(order - 1, down_to - 1, -1):
        made[k] = Level(*made[k + 1].shorter(k))
    return made


def rate(asked: np.ndarray, trie: dict[int, Level]) -> np.ndarray:
    """log10 of the probability of each gram's symbol after the bytes before it.

    Escape estimation by method D: with d symbols and t occurrences left, an
    escape has d / 2t; nothing escapes from a context without a symbol left, as
    it decides nothing. At last all bytes never learnt are equally likely.
    """
    out = np.zeros(len(asked))
    open_ = np.arange(len(asked))
    longer = np.full(len(asked), -1)  # the context one byte longer, if it was met
    for k in range(max(trie), -1, -1):
        here = trie[k]
        if not len(here.key):
            continue
        key = asked[open_] & U((1 << 8 * (k + 1)) - 1)
        at, known = _place(here.context, key >> U(8))
        pair, hit = _place(here.key, key)
        left, kinds = here.total[at].astype(float), here.degree[at].astype(float)
        child = longer[open_]
        if k + 1 in trie and len(trie[k + 1].key):
            above = trie[k + 1]
            gone = np.bincount(above.of_pair, here.n[_place(here.key, above.key & U((1 << 8 * (k + 1)) - 1))[0]], len(above.context))
            left -= np.where(child >= 0, gone[child], 0)
            kinds -= np.where(child >= 0, above.degree[child], 0)
        some = known & (left > 0)
        escape = np.where(some, kinds / np.maximum(2 * left, 1), 1.0)
        hit &= some
        with np.errstate(divide="ignore"):
            out[open_] += np.where(hit, np.log10((1 - escape) * here.n[pair] / np.maximum(left, 1)), np.log10(escape))
        longer[open_] = np.where(known, at, -1)
        open_ = open_[~hit]
    out[open_] -= np.log10(max(1, 256 - (len(trie[0].key) if 0 in trie else 0)))
    return out


class Lookup:
    """Values of keys in an open-addressing table, for many keys at once."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        bits = max(4, int(2 * len(key)).bit_length())
        self.shift, self.mask = U(64 - bits), (1 << bits) - 1
        self.key, self.value = np.zeros(1 << bits, U), np.zeros(1 << bits, np.float32)
        spot, todo = self._spot(key), np.arange(len(key))
        while len(todo):
            free = todo[self.key[spot[todo]] == 0]
            self.key[spot[free]] = key[free]  # of those for one slot the last one gets it
            got = self.key[spot[todo]] == key[todo]
            self.value[spot[todo[got]]] = value[todo[got]]
            todo = todo[~got]
            spot[todo] = (spot[todo] + 1) & self.mask

    def _spot(self, key: np.ndarray) -> np.ndarray:
        return ((key * U(0xD6E8FEB86659FD93)) >> self.shift).astype(np.int64)

    def get(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values, 0 where there is none, and whether there is one. No key is 0."""
        spot = self._spot(key)
        found = self.key[spot]
        hit = found == key
        value = np.where(hit, self.value[spot], np.float32(0))
        todo = np.nonzero(~hit & (found != 0))[0]
        while len(todo):
            spot[todo] = (spot[todo] + 1) & self.mask
            found = self.key[spot[todo]]
            own = found == key[todo]
            value[todo[own]], hit[todo[own]] = self.value[spot[todo[own]]], True
            todo = todo[~own & (found != 0)]
        return value, hit


def count(batches: Iterator[pa.RecordBatch], order: int, chunk: int, most: int = 2**21) -> Iterator[pa.RecordBatch]:
    """Rows (key, n) of batches (train, text): grams and words, those of other texts with n 0. A task holds about `most` of them."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        return _summed(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))

    def out(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

    for b in batches:
        for part, texts in common.by_bytes(b, 1, chunk):
            train = part.column(0).to_numpy(zero_copy_only=False).astype(bool)
            gram, of_gram, word, of_word = read(texts, order)
            for keys, of in ((gram, of_gram), (word, of_word)):
                learnt = train[of]
                key, n = np.unique(keys[learnt], return_counts=True)
                held.append((key, n.astype(np.int64)))
                if not learnt.all():
                    key = np.unique(keys[~learnt])
                    held.append((key, np.zeros(len(key), np.int64)))
            if sum(len(k) for k, _ in held) > most:
                held = [merged()]
                if len(held[0][0]) > most // 2:
                    yield out(*held[0])
                    held = []
    if held:
        yield out(*merged())


def score(docs: DataFrame, train: str, order: int = 6, frequent: int = 2**21, chunk: int = 2**19, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 of the text's probability).

    train: SQL condition on docs that says which rows are learnt from; the
    others are held out (null: held out). Every context learnt is kept. The
    `frequent` most frequent grams and words, about, are sent to the tasks that
    read texts, as a table of 12 bytes times 2 to 4 each; the others meet their
    scores in a join. order: at most 6. A null text is empty and has the end
    token only. Nothing to learn from: any byte is as likely as another. Rows
    that repeat and rows of one id or of none are scored one by one; a text's
    bytes are read at once, others in parts of about `chunk` bytes. Other
    columns don't count.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.expr(train), F.lit(False)).alias("train"), F.col(text_col).cast("binary").alias("text"))
    table = common.cut(rows.select("train", "text").mapInArrow(common.lean(lambda batches: count(batches, order, chunk)), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    is_word, learnt = F.col("key") < 0, F.col("n") > 0
    told = table.filter(is_word).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(learnt)).first()
    tokens, kinds = told
    # the contexts that all tasks know
    mask = (1 << 8 * NEAR) - 1
    near = table.filter(~is_word & learnt).groupBy(F.col("key").bitwiseAND(F.lit(mask)).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    short = levels(near.column("key").to_numpy().view(U), near.column("n").to_numpy(), min(order, NEAR - 1))
    known = spark.sparkContext.broadcast({k: (x.key, x.n) for k, x in short.items()})

    def rated(batches: Iterator[pa.RecordBatch], most: int = 2**18) -> Iterator[pa.RecordBatch]:
        """(key, n, p) of grams that come sorted by the bytes next to the symbol."""
        top = {k: Level(*x) for k, x in known.value.items()}

        def told(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            own = key.view(U)
            trie = top | levels(own[n > 0], n[n > 0], order, NEAR) if order >= NEAR else top
            return pa.record_batch([pa.array(key), pa.array(n), pa.array(rate(own, trie))], ["key", "n", "p"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            if sum(len(k) for k, _ in held) > most:
                key, n = (np.concatenate([x[j] for x in held]) for j in range(2))
                near = key >> 8 & mask
                ends = int(np.searchsorted(near, near[-1]))
                if ends:
                    yield told(key[:ends], n[:ends])
                held = [(key[ends:], n[ends:])]
        if held:
            yield told(*(np.concatenate([x[j] for x in held]) for j in range(2)))

    next_to = F.shiftright("key", 8).bitwiseAND(F.lit(mask))
    dealt = table.filter(~is_word).repartition(common.partitions(spark), next_to).sortWithinPartitions(next_to)
    base = F.log10((F.col("n") + 0.1) / (tokens + 0.1 * (kinds + 1)))
    scores = common.cut(dealt.mapInArrow(common.lean(rated), "key long, n long, p double").union(table.filter(is_word).select("key", "n", base.alias("p"))).withColumn("p", F.col("p").cast("float")))
    common.discard(table)
    bins = scores.filter(learnt).groupBy(F.floor(8 * F.log2("n")).alias("bin")).agg(F.count(F.lit(1)).alias("keys")).orderBy(F.desc("bin")).collect()
    room, least = frequent, None
    for r in bins:
        room -= r["keys"]
        if room < 0:
            break
        least = r["bin"]
    often = scores.filter(learnt & (F.floor(8 * F.log2("n")) >= F.lit(least if least is not None else 10_000))).select("key", "p").toArrow()
    sent = spark.sparkContext.broadcast(Lookup(often.column("key").to_numpy().view(U), often.column("p").to_numpy()))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, rid = sent.value, TaskContext.get().partitionId() << 33
        for b in batches:
            for part, texts in common.by_bytes(b, 2, chunk):
                gram, of_gram, word, of_word = read(texts, order)
                m = len(texts)
                value, hit = at.get(gram)
                base, known = at.get(word)
                rest = np.concatenate([gram[~hit], word[~known]])
                of = np.concatenate([of_gram[~hit], of_word[~known]])
                by = np.argsort(of, kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=m))]).astype(np.int32)
                yield pa.record_batch(
                    [
                        pa.array(np.arange(rid, rid + m)), part.column(0), part.column(1), pa.array(np.bincount(of_word, minlength=m)), pa.array(np.bincount(of_word, known, m).astype(np.int64)),
                        pa.array(np.bincount(of_word, base, m)), pa.array(np.bincount(of_gram, value, m)), pa.ListArray.from_arrays(pa.array(ends), pa.array(rest[by].view(np.int64))),
                    ],
                    ["rid", "id", "train", "tokens", "known", "base", "score", "rest"],
                )
                rid += m

    part = common.cut(rows.mapInArrow(common.lean(look), "rid long, id long, train boolean, tokens long, known long, base double, score double, rest array<long>"))
    met = part.select("rid", F.explode("rest").alias("key")).join(scores, "key")
    more = met.groupBy("rid").agg(F.count_if(is_word & learnt).alias("more_known"), F.sum(F.when(is_word, F.col("p"))).alias("more_base"), F.sum(F.when(~is_word, F.col("p"))).alias("more_score"))
    total = {x: F.col(x) + F.coalesce(F.col(f"more_{x}"), F.lit(0)) for x in ("known", "base", "score")}
    return part.drop("rest").join(more, "rid", "left").select(
        F.col("id").alias(id_col),
        (~F.col("train")).alias("held_out"),
        F.col("tokens").alias("n_tokens"),
        total["known"].alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        total["base"].alias("base_score"),
        total["score"].alias("score"),
    )
