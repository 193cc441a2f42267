"""Licence scans, periodic runs and phrases against brute force, with nulls, empty and very long texts, ties, repeats and clashing names."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from re import _parser as regex_parser

from ostinato.llm import collocations, license_scan, periodic_runs, queries
from ostinato.llm.license_rules import RULES, Rule

SCHEMA = "doc_id long, text string, lang string, labels string, words int, n string, score string, __text string, start string"
LOWER = {c: c + 32 for c in range(65, 91)}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 1, "n", "s", "u", "v") for i, t, lang in rows], SCHEMA).repartition(3)


# licence scans


def examples(pattern):
    """Texts that the pattern matches: all branches, optional parts with and without, the least repeats and one more."""
    out = [""]
    for op, arg in regex_parser.parse(pattern) if isinstance(pattern, str) else pattern:
        name = str(op)
        if name == "LITERAL":
            parts = [chr(arg)]
        elif name == "IN":
            parts = ["q" if str(kind) == "NEGATE" else chr(value) for kind, value in arg[:1] if str(kind) == "NEGATE"] or [chr(value) for _, value in arg]
        elif name == "BRANCH":
            parts = [x for branch in arg[1] for x in examples(branch)]
        elif name == "SUBPATTERN":
            parts = examples(arg[3])
        elif name == "MAX_REPEAT":
            parts = [x * n for x in examples(arg[2]) for n in ({arg[0], min(arg[0] + 1, arg[1])} if len(arg[2]) > 1 or arg[0] == 0 else {arg[0]})]
        else:
            parts = ["q"]
        out = [x + y for x in out for y in dict.fromkeys(parts)]
    return out


def test_rules_are_hundreds_and_no_match_lacks_the_keyword():
    assert len(RULES) >= 200 and len(set(RULES)) == len(RULES)
    assert all("," not in r.label and 0 < r.priority < 100 for r in RULES)
    scanner = license_scan.Scanner(RULES)
    for i, r in enumerate(RULES):
        for said in {re.sub(" +", " ", x).strip() for x in examples(r.pattern)}:
            assert r.keyword in said, (r, said)
            assert i in {h.rule for h in scanner.hits(f"zz {said} zz")}, (r, said)


def brute_hits(words, rules):
    said = " ".join(words)
    out = []
    for i, r in enumerate(rules):
        for m in re.finditer(f"(?<![^ ])(?:{r.pattern})(?![^ ])", said):
            out.append((said[: m.start()].count(" "), said[: m.end()].count(" ") + 1, i))
    return sorted(out)


def brute_settle(hits, rules):
    stand = []
    for p in sorted({rules[h[2]].priority for h in hits}, reverse=True):
        free = [h for h in hits if rules[h[2]].priority == p and not any(a < h[1] and h[0] < z for a, z, _ in stand)]
        stand = stand + [h for h in free if not any(g != h and g[0] <= h[0] and h[1] <= g[1] and ((g[0], g[1]) != (h[0], h[1]) or g[2] < h[2]) for g in free)]
    return sorted(stand)


BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def brute_scan(text):
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER)) if w]
    base = sorted((i, label) for phrase, label in BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    stand = brute_settle(brute_hits(words, RULES), RULES)
    best = defaultdict(int)
    for _, _, i in stand:
        best[RULES[i].label] = max(best[RULES[i].label], RULES[i].priority)
    named = {label for _, label in base}
    score = 1 - float(np.prod([1 - p / 100 for p in best.values()]))
    return len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(named)), ",".join(sorted(named | set(best))), score, [(a, z - a, i) for a, z, i in stand]


LICENCES = [
    "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0",
    "GNU General Public License, version 2. MIT License; see cc-by, CC BY-SA 4.0, (cc) by, Cc By 4.0!",
    "SPDX-License-Identifier: GPL-3.0-or-later\nSPDX-License-Identifier: MIT",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "permit license, MIT-license mit\tlicense mitlicense éMIT License x MIT LICENSÉ",
    "Tous droits réservés. All rights reserved.",
    "the mit license mit the MIT License (MIT)",
]


def licence_rows():
    return [(1, None, None), (2, "", "en"), (2, "no licence at all", "en"), (None, "mit license", None), (5, " . , ", "en"), *[(10 + i, t, "en") for i, t in enumerate(LICENCES)], (10, LICENCES[0], "en"), (90, " ".join([*LICENCES, "word"] * 300), "en"), (91, "mit license " * 20_000, "en")]


def test_licences_against_brute_force(spark):
    rows = [r for r in licence_rows() if r[0] != 91]
    found = license_scan.scan(frame(spark, rows)).collect()
    key = lambda r: (str(r[0]), str(r[1:]))
    told = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9), [(d.start, d.length, d.rule) for d in r.detections]) for r in found), key=key)
    wanted = sorted(((i, *(round(x, 9) if isinstance(x, float) else x for x in brute_scan(t))) for i, t, _ in rows), key=key)
    assert told == wanted
    assert license_scan.scan(frame(spark, [])).count() == 0


def test_licences_of_a_very_long_text(spark):
    r = license_scan.scan(frame(spark, [x for x in licence_rows() if x[0] == 91])).first()
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.labels) == (40_000, 20_000, 0, 39_998, "mit")


def test_licences_by_hand(spark):
    one = lambda t: {(d.label, d.start, d.length) for d in license_scan.scan(frame(spark, [(1, t, None)])).first().detections}
    assert one("x Licensed under the Apache License, Version 2.0 y") == {("apache-2.0", 1, 8)}  # the bare name lies within
    assert one("cc by nc sa 4.0, then cc by") == {("cc-by-nc-sa-4.0", 0, 6), ("cc-by", 7, 2)}
    assert one("GNU General Public License version 3") == {("gpl-3.0", 0, 6)}


def test_licences_filter(spark):
    df = license_scan.scan(frame(spark, licence_rows()[:-1]))
    assert {r.doc_id for r in df.filter(license_scan.mentions("gpl-3.0-or-later")).collect()} == {12, 90}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("a b c ab".split()), max_size=30), st.lists(st.tuples(st.sampled_from(["a b", "b", "a(?: b)?", "b c", "a b c", "ab", "c(?: [^ ]+){0,2} a"]), st.integers(1, 3)), max_size=6))
def test_settling_against_all_pairs(words, drawn):
    rules = tuple(Rule(f"l{i}", p, {"b": "b", "ab": "ab", "b c": "b c"}.get(t, t[0]), t) for i, (t, p) in enumerate(drawn))
    scanner = license_scan.Scanner(rules)
    hits = scanner.hits(" ".join(words))
    assert [tuple(h) for h in hits] == (brute_hits(words, rules) if words else [])
    assert [tuple(h) for h in scanner.settle(hits)] == brute_settle([tuple(h) for h in hits], rules)


# periodic runs


def brute_runs(s, least=24, times=3):
    found = []
    for q in range(1, len(s) // 2 + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least, times * q) and not any(s[i : i + length - p] == s[i + p : i + length] for p in range(1, q)):
                found.append((i, length, q))
            i = j + 1
    return sorted(found)


periodic = st.one_of(
    st.lists(st.integers(0, 2), max_size=60),
    st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 12), st.lists(st.integers(0, 3), max_size=9)).map(lambda x: x[2] + x[0] * x[1] + x[2] * 3 + x[0] * 2),
)


@settings(max_examples=300, deadline=None)
@given(periodic, st.sampled_from([(2, 2), (3, 2), (6, 3), (24, 3), (5, 4)]))
def test_runs_against_all_periods(s, bounds):
    assert periodic_runs.runs(s, *bounds) == brute_runs(s, *bounds)
    texts = [[b"%d" % x for x in t] for t in (s, [], s[::-1])]
    assert periodic_runs.runs_of_texts(texts, *bounds) == [brute_runs(t, *bounds) for t in (s, [], s[::-1])]


@given(st.lists(st.integers(0, 2), max_size=40))
def test_factors_are_the_longest_that_start_earlier(s):
    at = 0
    for a, length, source in periodic_runs.factors(s):
        before = lambda n, at=at: any(s[j : j + n] == s[at : at + n] for j in range(at)) and at + n <= len(s)
        assert a == at and (before(length) if source >= 0 else length == 1) and not (before(length + 1) if source >= 0 else before(1))
        assert source < 0 or (source < a and s[source : source + length] == s[a : a + length])
        at += length
    assert at == len(s)


def run_rows():
    rng = np.random.default_rng(3)
    words = [f"w{x}" for x in rng.integers(0, 50, 400)]
    loop = words[:7] * 9
    texts = [None, "", " \t", "a " * 23, "a " * 24, "a\tb\n" * 40, " ".join(words), " ".join(words[:90] + loop + words[90:] + loop), " ".join(words[:10] * 2), " ".join((words[:30] * 3 + ["x"]) * 4), "é ü " * 30]
    rows = [(3 * i, t, None) for i, t in enumerate(texts)] + [(None, "a " * 30, None), (0, "b " * 30, None), (0, "b " * 30, None)]
    return rows + [(10_000 + i, " ".join(words[i : i + 5 + 4 * i]), "en") for i in range(60)]


def brute_row(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    found = brute_runs(words)
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{a},{n},{q}\n" for a, n, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def test_runs_of_rows(spark):
    rows = run_rows()
    df = periodic_runs.find_runs(frame(spark, rows))
    found = sorted((tuple(r)[:1] + tuple(r)[2:9] for r in df.collect()), key=str)
    assert found == sorted(((i, *brute_row(t)) for i, t, _ in rows), key=str)
    assert all([tuple(x) for x in r.runs] == brute_runs(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in df.join(frame(spark, rows).select("doc_id", "text").dropDuplicates(["doc_id"]), "doc_id").filter("doc_id > 0").collect())
    assert periodic_runs.find_runs(frame(spark, [])).count() == 0
    with pytest.raises(ValueError, match="two periods"):
        periodic_runs.find_runs(frame(spark, []), times=1)


def test_runs_of_a_very_long_text(spark):
    long = " ".join(f"w{x}" for x in np.random.default_rng(1).integers(0, 9, 37))
    r = periodic_runs.find_runs(frame(spark, [(1, f"start {(long + ' ') * 3000} end", None)])).first()
    assert (r.n_words, r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (111_002, 1, 1, 111_000, 37, 3_000_000)


def test_planted_periods(spark, tmp_path):
    rows = run_rows()
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")

    def planted(i, text):
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        if h % 10 or not words:
            return text
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return " ".join(words[:a] + [words[a + (j - a) % p] for j in range(a, n)])

    found = queries.op12(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(((i, *brute_row(planted(i, t))) for i, t, _ in rows), key=str)


# phrases


def brute_phrases(rows, least, most, top, within=80, scale=2_000_000):
    counted, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            total[lang or "und" if lang is None else lang] += len(words)
            for k in range(1, most + 1):
                counted[lang if lang is not None else "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counted.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        dropped = {p[i : i + k] for p, a in candidates.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= within * f[p[i : i + k]]}
        scored = []
        for p, a in candidates.items():
            if p not in dropped:
                score, k = min((scale * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, total[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def phrase_rows():
    rng = np.random.default_rng(8)
    text = lambda n: "".join(f"{'wW'[int(x) % 2]}{int(x) % 30}{' '  if y else ', '}" for x, y in zip(rng.zipf(1.4, n), rng.random(n) < 0.8, strict=True))
    rows = [(i, text(200), ("en", "de", None, "und")[i % 4]) for i in range(40)]
    return rows + [(None, "New York\tcity; new york City!\nnew\x0byork " * 30, "en"), (1, None, "en"), (1, "", "xx"), (2, "a a a a a a a", "en"), (2, "a a a a a a a", "en"), (3, "é ü é ü " * 40, "é"), (5, "one word. " * 50, "en"), (6, "long tail " * 20_000, "de"), (7, "\x1c a\x00b a\x00b", None)]


@pytest.mark.parametrize(("least", "most", "top"), [(30, 4, 2000), (3, 5, 40), (2, 2, 3)])
def test_phrases_against_brute_force(spark, least, most, top):
    rows = phrase_rows()
    found = collocations.mine(frame(spark, rows), least, most, top, shard_bytes=3000)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == brute_phrases(rows, least, most, top)


def test_phrases_whatever_the_shards(spark):
    rows = phrase_rows()
    one, many = (sorted(map(tuple, collocations.mine(frame(spark, rows), 5, 4, shard_bytes=size, filter_bits=bits).collect())) for size, bits in ((1, 15), (2**30, 20)))
    assert one == many  # a small field has many false hits
    assert collocations.mine(frame(spark, [])).count() == 0
    assert collocations.mine(frame(spark, [(1, None, None)])).count() == 0


def test_phrase_arithmetic_is_exact(spark):
    a = 2**62
    row = spark.sql(f"select cast({a}L as decimal(20,0)) * 2000000 div (cast({a}L as decimal(20,0)) + cast({a - 1}L as decimal(20,0))) as s").first()
    assert row.s == 2_000_000 * a // (2 * a - 1)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(2, 6))
def test_suffix_array_counts(drawn, most):
    ids = np.array([*drawn, 0], np.int64)
    wanted = Counter(tuple(drawn[i : i + k]) for k in range(1, most + 1) for i in range(len(drawn) - k + 1) if 0 not in drawn[i : i + k])
    found = {tuple(ids[a : a + k].tolist()): c for k, at, sizes in collocations.grams(ids, range(1, most + 1)) for a, c in zip(at.tolist(), sizes.tolist(), strict=True)}
    assert found == dict(wanted)


SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_on_the_given_tables(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in queries.documents(spark, SF).collect()]
    told = {r.doc_id: r for r in queries.op11(spark, SF).collect()}
    for i, text, _ in rows:
        n_words, n_base, first, last, base, labels, score, _ = brute_scan(text)
        r = told[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == (n_words, n_base, first, last, base, labels) and abs(r.score - score) < 1e-9
    assert sorted(map(tuple, queries.op13(spark, SF).collect())) == brute_phrases(rows, 30, 4, 2000)
