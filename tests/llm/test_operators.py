"""The training-data operators on small fixtures, against brute force and with awkward rows:
nulls, empty and very long texts, ties, repeated rows, empty tables, clashing column names."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from graphloom.llm import jaccard, langid, licenses, mixing, packing, tokencount, topk, toxicity, vectordedup, warc
from graphloom.llm.common import materialise, ship, sparing
from graphloom.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n int, size long, key double, rank int, node long, slot int"


def docs_of(spark, rows):
    """rows: (doc_id, text, lang, source); further columns have names that operators use inside."""
    return spark.createDataFrame([(*r, 1, 2, 0.5, 3, 4, 5) for r in rows], DOCS)


WORDS = "ba ce di fo gu ha je ki lo mu na pe".split()


def prose(rnd, n, words=WORDS):
    return " ".join("".join(rnd.choices(words, k=rnd.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    out = [(i, prose(rnd, rnd.randint(1, 60)), "aa", f"s{i % 3}") for i in range(40)]
    base = prose(rnd, 80)
    out += [(100 + i, base.replace("ba", "ba", 1) + f" end{i}", "aa", "hot") for i in range(30)]
    out += [(200, base, "aa", None), (200, base, "aa", None), (201, None, None, "s0"), (202, "", "aa", "s1"), (203, " \t\n", None, "s1"), (None, "one two", "aa", "s1"), (204, prose(rnd, 9000), "aa", "s2"), (205, "x" * 50_000, None, "s2")]
    return out


def test_packing(spark, rows):
    got = packing.pack_documents(docs_of(spark, rows), vocabulary("byte_bpe_50k.json"), 64).toPandas()
    enc = packing.encoder(vocabulary("byte_bpe_50k.json")).model
    want = []
    for i, text, *_ in rows:
        ids = (enc.encode(text, add_special_tokens=False).ids if text else []) + [0]
        first = (len(ids) - 1) % 64 + 1
        cuts = [0, *range(first, len(ids) + 1, 64)]
        want += [(-1 if i is None else i, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    seen = [(-1 if pd.isna(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()]
    assert sorted(seen) == sorted(want)
    got = got.sort_values(["sequence_id", "offset"])
    by = got.groupby("sequence_id")["length"]
    assert (got["offset"] == by.cumsum() - got["length"]).all() and by.sum().max() <= 64
    assert got["sequence_id"].nunique() <= 1.05 * got["length"].sum() / 64 + 1
    assert packing.pack_documents(docs_of(spark, []), vocabulary("byte_bpe_50k.json")).count() == 0


def test_plan_uses_every_slot_once():
    rnd = random.Random(1)
    for _ in range(30):
        counts = {rnd.randint(1, 30): rnd.randint(1, 40) for _ in range(8)}
        used, ranks = {}, {}
        for length, a, b, seq, off in packing.plan_best_fit(counts, 30):
            assert a == ranks.get(length, 0)
            ranks[length] = b
            for k in range(b - a):
                used.setdefault(seq + k, []).append((off, length))
        assert ranks == counts
        for slots in used.values():
            at = 0
            for off, length in sorted(slots):
                assert off == at
                at += length
            assert at <= 30


def test_token_counts(spark, rows):
    path = vocabulary("piece_bpe_32k.model")
    got = {r["doc_id"]: r for r in tokencount.count_tokens(docs_of(spark, rows), path).collect()}
    counter = tokencount.counter(path)
    model, enc = counter.model, packing.encoder(vocabulary("byte_bpe_50k.json"))
    for i, text, *_ in rows:
        assert got[i]["n_tokens"] == (len(model.encode(text)) if text else 0)
        assert got[i]["n_bytes"] == len((text or "").encode())
    rnd = random.Random(3)
    for _ in range(500):
        t = "".join(rnd.choice("ab ▁\n<>s|é. ") for _ in range(rnd.randint(0, 12)))
        assert counter.count(t) == len(model.encode(t))
        assert enc.encode(t) == np.array(enc.model.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()


def brute_sets(rows, width):
    sets = []
    for i, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    return sets


def brute_labels(rows, width, percent):
    sets = brute_sets(rows, width)
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                x, y = sets[a], sets[b]
                if x and y and label[a] != label[b] and 100 * len(x & y) >= percent * len(x | y):
                    low, high = sorted((label[a], label[b]))
                    label = [low if v == high else v for v in label]
                    changed = True
    return label


def brute_classes(rows, width, percent):
    sets, label = brute_sets(rows, width), brute_labels(rows, width, percent)
    ids = {}
    for (i, *_), v in zip(rows, label):
        if i is not None:
            ids[v] = min(ids.get(v, i), i)
    return [(i, len(s), ids.get(v)) for (i, *_), s, v in zip(rows, sets, label)]


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_jaccard(spark, rows, width, percent):
    rnd = random.Random(9)
    more = list(rows)
    base = prose(rnd, 60).split()
    for i in range(25):  # near copies at various distances, so that some link only through others
        w = list(base)
        for k in rnd.sample(range(60), rnd.randint(0, 4)):
            w[k] = f"new{i}x{k}"
        more.append((300 + i, " ".join(w), "aa", "hot"))
    got = jaccard.near_duplicates(docs_of(spark, more), width, percent).select("doc_id", "n_shingles", "component_id").collect()
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(map(key, got)) == sorted(map(key, brute_classes(more, width, percent)))
    assert jaccard.near_duplicates(docs_of(spark, []), width, percent).count() == 0


def test_one_of_each(spark, rows):
    """One row a class, also with null ids, repeated rows and one id on different texts."""
    base = " ".join(f"w{i}" for i in range(60))
    more = [*rows, (None, base, "aa", "x"), (None, base, "aa", "y"), (None, base + " end", "aa", "x"), (500, "other text of its own", "aa", "x"), (500, base + " tail", "aa", "x"), (501, base, "aa", "x"), (None, None, "aa", "x"), (None, "", "aa", "x")]
    docs = docs_of(spark, more)
    got = jaccard.one_of_each(docs, 5, 80)
    assert got.columns == docs.columns
    sets, label = brute_sets(more, 5), brute_labels(more, 5, 80)
    where = {}
    for (i, text, *_), s, v in zip(more, sets, label):
        where.setdefault((i, text), []).append(v if s else None)
    kept = [(r["doc_id"], r["text"]) for r in got.collect()]
    per = {}
    for k in kept:
        if (v := where[k][0]) is not None:
            per[v] = per.get(v, 0) + 1
            assert k[0] == min((i for (i, *_), w in zip(more, label) if w == v and i is not None), default=None)
    assert per == {v: 1 for s, v in zip(sets, label) if s}
    assert len([k for k in kept if where[k][0] is None]) == sum(not s for s in sets)
    assert jaccard.one_of_each(docs_of(spark, [])).count() == 0


def test_mixing(spark, rows):
    docs = docs_of(spark, rows)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    one = mixing.mix_sources(docs, mixing.quality_weights(labels)).toPandas()
    two = mixing.mix_sources(docs.repartition(5), mixing.quality_weights(labels)).toPandas()
    columns = ["doc_id", "size", "taken", "copies"]
    order = lambda d: sorted(d[columns].fillna(-1).itertuples(index=False, name=None))
    assert order(one) == order(two) and len(one) == len(rows)
    assert (one["taken"] <= 2 * one["size"]).all()
    per = one.groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"), most=("size", "max"))
    assert ((per["taken"] - per["target"]).abs() <= per["most"] / 2 + 1e-6).all()
    weights, target = dict(zip(["hot", "s0", "s1", "s2"], (5, 2, 1, 5))), {}
    sizes = {k if isinstance(k, str) else None: v for k, v in per["size"].items()}
    weights[None] = 2
    left, free = 1.5 * sum(sizes.values()), set(sizes)
    while True:
        level = left / sum(weights[s] for s in free)
        full = {s for s in free if level * weights[s] > 2 * sizes[s]}
        if not full:
            target.update({s: level * weights[s] for s in free})
            break
        target.update({s: 2.0 * sizes[s] for s in full})
        left, free = left - sum(2 * sizes[s] for s in full), free - full
    for s, t in target.items():
        assert per.loc[per.index.isna() if s is None else per.index == s, "target"].iloc[0] == pytest.approx(t)
    assert mixing.mix_sources(docs_of(spark, [])).count() == 0
    copies = mixing.mixed_documents(docs, mixing.quality_weights(labels))
    assert copies.columns == docs.columns
    many = lambda d: sorted((-1 if pd.isna(i) else i, t or "", n) for (i, t), n in d.items())
    seen, want = {}, {}
    for r in copies.collect():
        seen[r["doc_id"], r["text"]] = seen.get((r["doc_id"], r["text"]), 0) + 1
    for (i, text, *_), in zip(rows):
        n = one.loc[one["doc_id"].isna() if i is None else one["doc_id"] == i, "copies"]
        if n.sum():
            want[i, text] = int(n.sum())
    assert many(seen) == many(want)


def test_licenses(spark):
    texts = ["Some words.\nReleased under the MIT License.", "licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License", None, "", "no license here", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"]
    got = [r["licenses"] for r in licenses.scan_licenses(docs_of(spark, [(i, t, None, None) for i, t in enumerate(texts)])).orderBy("doc_id").collect()]
    assert got == [["MIT"], ["Apache-2.0"], [], [], [], []]
    assert all(any(a in s for a in licenses.ANCHORS) for s in licenses.SENTENCES)


def test_language(spark):
    rnd = random.Random(2)
    other = "zo xy wib tra vul quo zan yst wom".split()
    train = [(i, prose(rnd, 60), "aa", None) for i in range(60)] + [(100 + i, prose(rnd, 60, other), "bb", None) for i in range(60)]
    docs = docs_of(spark, train)
    models = langid.train(docs)
    tests = [(1, prose(rnd, 12), None, None), (2, prose(rnd, 12, other), None, None), (3, None, None, None), (4, "", None, None), (5, "12 34", None, None), (6, "x" * 5000, None, None)]
    got = {r["doc_id"]: r["__language"] for r in langid.identify(docs_of(spark, tests), models).collect()}
    assert [got[i]["lang"] for i in (1, 2, 3, 4, 5)] == ["aa", "bb", "und", "und", "und"]
    assert not got[1]["rejected"] and got[3]["rejected"] and all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.train(docs_of(spark, [])) == {}
    assert langid.identify(docs_of(spark, tests), {}).count() == len(tests)


def naive_kneser_ney(words, order):
    """Interpolated Kneser-Ney by its definition: probability of a character after a context."""
    grams = [Counter() for _ in range(order + 1)]
    for w, n in words.items():
        line = f" {w} "
        for k in range(1, order + 1):
            for end in range(max(2, k), len(line) + 1):  # the leading blank is only context
                grams[k][line[end - k : end]] += n
    counts = [None, *grams[1:]]
    for k in range(1, order):
        seen = Counter(g[1:] for g in grams[k + 1])
        counts[k] = {g: max(seen.get(g, 0), 1) for g in grams[k]}
    size = len(grams[1]) + 1
    discount = [0.0]
    for k in range(1, order + 1):
        ones, twos = (sum(c == n for c in counts[k].values()) for n in (1, 2))
        discount.append(ones / (ones + 2 * twos) if ones and twos else 0.5)

    def p(c, context):
        k = len(context) + 1
        below = p(c, context[1:]) if context else 1 / size
        same = [n for g, n in counts[k].items() if g[:-1] == context]
        if not same:
            return below
        mine = counts[k].get(context + c)
        rest = discount[k] * len(same) / sum(same)
        return (max(mine - discount[k], 0) / sum(same) if mine else 0.0) + rest * below

    return p


def test_kneser_ney_against_definition():
    words = {"abab": 5, "abba": 3, "bb": 2, "ca": 1, "bac": 4, "x" * 9: 1}
    for order in (1, 2, 3, 4):
        model, p = langid.fit(words, order), naive_kneser_ney(words, order)
        for word in ("abab", "cab", "q", "baq", "xxx", "bb"):
            line = f" {word} "
            want = -sum(math.log2(p(c, line[max(0, i - order + 1) : i])) for i, c in enumerate(line) if i)
            assert langid.word_bits(model, [word])[0] == pytest.approx(want, abs=1e-9)
        total = sum(p(c, " ab"[-(order - 1) :] if order > 1 else "") for c in "abcx ")
        assert total <= 1 + 1e-9


def test_rejection_by_bands():
    rng = np.random.default_rng(3)
    chars = rng.integers(10, 4000, 3000).astype(float)
    entropy = 2 + rng.normal(size=3000) * (0.05 + 2 / np.sqrt(chars))
    entropy[:2] = 9  # junk among the held texts
    lengths, limit = langid.limits(entropy, chars)
    assert len(limit) == len(lengths) + 1 == 8 and (np.diff(lengths) > 0).all()
    bound = limit[np.searchsorted(lengths, chars, side="right")]
    assert (entropy[2:] <= bound[2:]).all() and limit.max() < 6 and limit[-1] < limit[0]
    assert langid.limits(entropy[:3], chars[:3])[1].tolist() == [np.inf]


def test_other_languages_and_noise_are_rejected(spark):
    rnd = random.Random(12)
    train = [(i, prose(rnd, rnd.randint(3, 120)), "aa", None) for i in range(400)]
    docs = docs_of(spark, train + [(0, None, "aa", None), (None, "ba ce", "aa", None), (1, "x", None, None)])
    models = langid.train(docs, 200, 200)
    letters = "abcdefghijklmnopqrstuvwxyz"
    noise = [(1000 + n, " ".join("".join(rnd.choices(letters, k=rnd.randint(2, 9))) for _ in range(n)), None, None) for n in (4, 15, 60, 300, 3000)]
    other = [(2000 + n, prose(rnd, n, "zo xy wib tra vul quo zan".split()), None, None) for n in (4, 15, 60, 300)]
    fine = [(i, prose(rnd, rnd.randint(3, 120)), None, None) for i in range(3000, 3200)]
    fine += [(4000, prose(rnd, 4000), None, None), fine[0]]
    got = langid.identify(docs_of(spark, noise + other + fine), models)
    rejected = [r["doc_id"] for r in got.filter("__language.rejected").collect()]
    assert sorted(rejected) == sorted(i for i, *_ in noise + other)
    assert langid.identify(docs_of(spark, []), models).count() == 0
    assert langid.identify(got.limit(2), models).columns == got.columns


def brute_segments(s):
    """Ruzzo-Tompa's segments by their recursive definition."""
    best, where = 0, None
    for a in range(len(s)):
        for b in range(a + 1, len(s) + 1):
            if sum(s[a:b]) > best + 1e-9:
                best, where = sum(s[a:b]), (a, b)
    if not where:
        return []
    a, b = where
    left = brute_segments(s[:a])
    right = [(x + b, y + b, v) for x, y, v in brute_segments(s[b:])]
    return left + [(a, b, best)] + right


def test_segments():
    rnd = random.Random(4)
    for _ in range(200):
        s = [rnd.choice([-3, -2, -1, 1, 2, 3, 5]) + rnd.random() / 100 for _ in range(rnd.randint(0, 12))]
        got = toxicity.maximal_segments(np.array(s), 0.0)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute_segments(s)]


def test_toxicity(spark):
    rnd = random.Random(6)
    bad = ["vile", "vileness", "rotten"]
    rows, labels = [], []
    for i in range(300):
        w = prose(rnd, 50).split()
        toxic = i % 4 == 0
        if toxic:
            for k in rnd.sample(range(50), 4):
                w[k] = rnd.choice(bad) + rnd.choice(["", ",", "."])
        rows.append((i, " ".join(w), "aa", None))
        labels.append((i, int(toxic)))
    table = spark.createDataFrame(labels + [(0, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs_of(spark, rows[:200]), table)
    awkward = [(900, None, None, None), (901, "", None, None), (902, "vile " * 4000, None, None), (None, "ba", None, None)]
    got = {r["doc_id"]: r["__toxicity"] for r in toxicity.score_toxicity(docs_of(spark, rows[200:] + awkward), model).collect()}
    assert all((got[i]["score"] >= 0.7) == bool(t) for i, t in labels[200:])
    assert got[900]["score"] < 0.7 and got[901]["score"] < 0.7 and got[902]["score"] > 0.7
    assert all(got[i]["passages"] for i, t in labels[200:] if t)
    assert toxicity.train(docs_of(spark, []), table.limit(0)).words == {}


def test_toxicity_against_definition(spark):
    """Words, stems, evidence and score by plain Python, for texts and their repeats."""
    rnd = random.Random(16)
    rows = []
    for i in range(600):
        w = prose(rnd, 30).split()
        if i % 3 == 0:
            for k in rnd.sample(range(30), 5):
                w[k] = rnd.choice(["vile", "vileness", "rotten,", "(rotten"])
        rows.append((i % 3 == 0, " ".join(w)))
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "row long, text string")
    seen = {True: Counter(), False: Counter()}
    for toxic, text in rows:
        seen[toxic].update({toxicity.EDGE.sub("", w) for w in text.lower().split()})
    counts = spark.createDataFrame([(w, seen[True][w], seen[False][w]) for w in seen[True] | seen[False]], "word string, toxic long, clean long")
    words, stems = toxicity.fit_words(counts)
    n = {k: sum(v.values()) for k, v in seen.items()}
    share = n[True] / (n[True] + n[False])

    def odds(t, c, prior_t, prior_c):
        delta = math.log((t + prior_t) / max(n[True] - t, 1)) - math.log((c + prior_c) / max(n[False] - c, 1))
        gain = t * math.log(max(t, 1e-12) / ((t + c) * share)) + c * math.log(max(c, 1e-12) / ((t + c) * (1 - share)))
        return delta, math.copysign(math.sqrt(2 * max(gain, 0)), t / (t + c) - share)

    per_stem = {}
    for w in seen[True] | seen[False]:
        t, c = per_stem.get(w[: toxicity.STEM], (0, 0))
        per_stem[w[: toxicity.STEM]] = t + seen[True][w], c + seen[False][w]
    want_stems = {}
    for stem, (t, c) in per_stem.items():
        delta, z = odds(t, c, toxicity.PRIOR * share, toxicity.PRIOR * (1 - share))
        if abs(z) >= toxicity.STEM_Z:
            want_stems[stem] = delta
    want_words = {}
    for w in seen[True] | seen[False]:
        t, c = per_stem[w[: toxicity.STEM]]
        rate = (t + toxicity.PRIOR * share) / (t + c + toxicity.PRIOR)
        delta, z = odds(seen[True][w], seen[False][w], toxicity.PRIOR * rate, toxicity.PRIOR * (1 - rate))
        if abs(z) >= toxicity.LEAST_Z or w[: toxicity.STEM] in want_stems:
            want_words[w] = delta if abs(z) >= toxicity.LEAST_Z else 0.0
    assert stems == pytest.approx(want_stems) and words == pytest.approx(want_words) and want_stems and words["rotten"] > 0
    model = toxicity.ToxicModel(words, stems, 0.4, 0.02, 1.5, -2.0)
    some = [t for _, t in rows[:60]] + [rows[0][1], "", None, "Vile! " * 500]
    got = toxicity.score_toxicity(docs_of(spark, [(i, t, None, None) for i, t in enumerate(some)]), model)
    for r in got.collect():
        tokens = (r["text"] or "").lower().split()
        clean = [toxicity.EDGE.sub("", w) for w in tokens]
        scores = [want_words.get(w, want_stems.get(w[: toxicity.STEM], 0.0) if len(w) > toxicity.STEM else 0.0) - toxicity.DRIFT for w in clean]
        if len(scores) > 100:
            found = [(0, len(scores), sum(scores))]
        else:
            found = brute_segments(scores)
        rare = [(a, b, x, 0.4 * x - math.log(0.02 * max(len(tokens), 1))) for a, b, x in found]
        strong = [x for x in rare if x[3] >= -math.log(toxicity.LEAST_E)]
        evidence = sum(x[3] for x in strong) if strong else max((min(max(x[3], 0), -math.log(toxicity.LEAST_E)) for x in rare), default=-1.0)
        assert r["__toxicity"]["score"] == pytest.approx(1 / (1 + math.exp(-max(-60, min(60, 1.5 * evidence - 2)))))
        assert [(p["first"], p["last"]) for p in r["__toxicity"]["passages"]] == [x[:2] for x in strong]
    assert toxicity.score_toxicity(docs_of(spark, []), model).count() == 0
    assert toxicity.score_toxicity(got, model).columns == got.columns


VECTOR = "vec_id long, embedding array<float>, score long, rank int, node long"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], VECTOR)


@pytest.fixture(scope="module")
def vectors():
    rnd = np.random.default_rng(8)
    x = rnd.normal(size=(200, 8))
    x[50:120] = x[0] + rnd.normal(size=(70, 8)) * 0.2
    x[120:160] = x[1]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, [float(v) for v in x[i]]) for i in range(200)]
    return rows + [(200, None), (201, [0.0] * 8), (202, [float("nan")] * 8), (203, [None] + [0.1] * 7), (204, [float("inf")] * 8), (205, [1.0, 0.0]), (206, [2.0, 0.0]), (20, rows[20][1])]


def test_top_k(spark, vectors):
    got = topk.exact_top_k(vectors_of(spark, vectors), 5).collect()
    good = [(i, np.floor(64 * np.array(v, dtype=np.float32).astype(float))) for i, v in vectors if v is not None and None not in v and np.isfinite(np.array(v, dtype=float)).all()]
    want = []
    for a, (i, x) in enumerate(good):
        if i % 20 == 0:
            near = sorted((-int(x @ y), j) for b, (j, y) in enumerate(good) if b != a and len(x) == len(y))[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(near)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)
    assert topk.exact_top_k(vectors_of(spark, []), 5).count() == 0


@pytest.mark.parametrize("cap", [6000, 60])
def test_near_vectors(spark, vectors, cap, monkeypatch):
    monkeypatch.setattr(vectordedup, "CAP", cap)  # the small one splits shards again and compares dense ones whole
    monkeypatch.setattr(vectordedup, "SHARD", 500 if cap > 100 else 20)
    got = {r["vec_id"]: r for r in vectordedup.near_vectors(vectors_of(spark, vectors[:-1])).collect()}
    good = {i: np.array(v, dtype=np.float32).astype(float) for i, v in vectors[:-1] if v is not None and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v)}
    truth = {i: [j for j in good if j != i and len(good[j]) == len(good[i]) and good[i] @ good[j] / np.linalg.norm(good[i]) / np.linalg.norm(good[j]) >= 0.9] for i in good}
    found = sum(got[i]["n_links"] for i in good)
    assert found >= 0.95 * sum(map(len, truth.values())) and all(got[i]["n_links"] <= len(truth[i]) for i in good)
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(200, 205)) and got[206]["component_id"] == 205
    assert got[130]["component_id"] == min([1, *truth[1]]) and vectordedup.near_vectors(vectors_of(spark, [])).count() == 0


def arc(n, spread):
    """Unit vectors along an arc: each links with its neighbours on both sides."""
    return [(i, [math.cos(i * spread), math.sin(i * spread)]) for i in range(n)]


def test_overlap_grows_until_the_audit_is_content(spark, monkeypatch):
    for k, v in {"SHARD": 40, "OVERLAP": 1, "REACH": 0.5}.items():
        monkeypatch.setattr(vectordedup, k, v)
    seen, audit = [], vectordedup.audit_recall
    monkeypatch.setattr(vectordedup, "audit_recall", lambda *a: seen.append(audit(*a)) or seen[-1])
    rows = arc(400, 0.012)
    got = {r["vec_id"]: r for r in vectordedup.near_vectors(vectors_of(spark, rows + [rows[3], (None, rows[5][1])])).collect()}
    assert len(seen) > 1 and seen[0] < vectordedup.WANTED_RECALL <= seen[-1]
    x = np.array([v for _, v in rows], dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    truth = (x @ x.T >= 0.9).sum(axis=1) - 1
    assert sum(min(got[i]["n_links"], truth[i]) for i in range(400)) >= 0.95 * truth.sum()
    assert all(got[i]["component_id"] == 0 for i in range(400))


def test_low_recall_is_compared_whole(spark, monkeypatch):
    """Shards without overlap find too little here; the exact comparison that follows finds every link."""
    for k, v in {"SHARD": 10, "OVERLAP": 1, "REACH": 0.0, "TRIES": 1}.items():
        monkeypatch.setattr(vectordedup, k, v)
    rows = arc(300, 0.01)
    whole, calls = vectordedup._all_compared, []
    monkeypatch.setattr(vectordedup, "_all_compared", lambda *a: calls.append(1) or whole(*a))
    got = {r["vec_id"]: r["n_links"] for r in vectordedup.near_vectors(vectors_of(spark, rows)).collect()}
    x = np.array([v for _, v in rows], dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.9).sum(axis=1) - 1
    assert calls == [1] and [got[i] for i, _ in rows] == near.tolist()


def test_index_in_several_passes(spark, tmp_path, monkeypatch):
    for k, v in {"RUN_ROWS": 7, "FAN_IN": 2, "MERGE_ROWS": 9, "ARCHIVE_BYTES": 900}.items():
        monkeypatch.setattr(warc, k, v)
    rnd = random.Random(3)
    rows = [(i if i % 9 else None, rnd.choice(["http://hot.org/", f"http://b.org/{i}", None]), "x" * rnd.randint(0, 2000)) for i in range(120)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    archives = warc.write_archives(warc.with_revisits(pages), str(tmp_path / "w"), 900)
    want = sorted(warc._place(e) for r in archives.collect() for e in warc.captures(r["archive"]))
    got = [warc._place((r["url_key"], r["timestamp"], r["page_id"], r["archive"], r["offset"])) for r in warc.build_index(archives, str(tmp_path / "runs")).orderBy("range", "place").collect()]
    assert got == want and len(got) == 120


def test_records_are_read_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 100)
    pages = spark.createDataFrame([(1, "u", "abc" * 9000), (2, "v", "é\r\n\r\n" * 50)], "page_id long, url string, html string").coalesce(1)
    archive = warc.write_archives(warc.with_revisits(pages), str(tmp_path / "w")).first()["archive"]
    found = list(warc.read_records(archive))
    assert [h["WARC-Type"] for _, _, h, _ in found] == ["warcinfo", "response", "response"]
    assert sorted(b.partition(warc.END)[2] for _, _, _, b in found[1:]) == [b"abc" * 9000, ("é\r\n\r\n" * 50).encode()]
    raw = open(archive.removeprefix("file://"), "rb").read()
    assert b"".join(raw[a : a + n] for a, n, _, _ in found) == raw


def test_warc(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "http://www.b.org/x", "a" * 1500), (2, "https://a.org/", "a" * 1500), (3, None, big), (4, "http://b.org/x#f", big), (5, "u", None), (6, "u", "small"), (7, "u", "small"), (8, "u\nv", "\r\n\r\n" * 400), (None, None, "z"), (9, "http://b.org/x", "q" * 300_000)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, size int")
    got = {r["page_id"]: r for r in warc.archive_pages(pages, str(tmp_path / "w")).collect()}
    for i, _, html in rows:
        raw = (html or "").encode()
        same = [j for j, _, h in rows if h == html and j is not None]
        revisit = len(raw) >= 1000 and i != max(same)
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", max(same)) if revisit else ("response", None))
    order = warc.archive_pages(pages, str(tmp_path / "v")).orderBy("range", "place").collect()
    assert [(r["url_key"], r["timestamp"]) for r in order] == sorted((r["url_key"], r["timestamp"]) for r in order)
    assert warc.archive_pages(pages.limit(0), str(tmp_path / "e")).count() == 0


def test_loser_tree():
    rnd = random.Random(7)
    for k in range(9):
        runs = [sorted((rnd.choice("abc"), "1", rnd.randint(0, 9), "x", rnd.randint(0, 99)) for _ in range(rnd.randint(0, 6))) for _ in range(k)]
        assert list(warc.merge_runs(runs)) == sorted(sum(runs, []))


def naive_copies(rows, weights, share=1.5):
    """How often each row is taken, by a plain loop over each source's rows in key order."""
    size = [len((t or "").encode().split()) for _, t, *_ in rows]
    names = sorted({r[3] for r in rows if r[3] is not None}) + ([None] if any(r[3] is None for r in rows) else [])
    total = {s: sum(n for n, r in zip(size, rows) if r[3] == s) for s in names}
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(total.values())
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if level * w[s] > 2 * total[s]}
        for s in full or free:
            target[s] = 2.0 * total[s] if full else level * w[s]
        left, free = left - sum(2 * total[s] for s in full), free - full if full else set()
    out = [0] * len(rows)
    for s in names:
        epochs = int(target[s] // total[s]) if total[s] else 0
        place = []
        for k, r in enumerate(rows):
            if r[3] == s:
                name = "mix" if r[0] is None else f"{r[0]}/mix"
                u = (int(hashlib.md5(name.encode()).hexdigest()[:12], 16) + 0.5) / 2**48
                place.append((-math.log(u) / weights.get(r[0], 1.0), -1 if r[0] is None else r[0], size[k], k))
        upto = 0
        for *_, n, k in sorted(place):
            upto += n
            out[k] = epochs + (upto - n / 2 <= target[s] - epochs * total[s])
    return out


def test_pipeline_stages_are_sparing(spark, tmp_path):
    """Readers and batches of every stage are small, and its workers give memory back; single operators are as before."""
    import corpus_pipeline

    arrow, readers, malloc = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize", "MALLOC_TRIM_THRESHOLD_"
    usual, environment = spark.conf.get(readers), dict(spark.sparkContext.environment)
    docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat('ba ce di fo ', 500) AS text", "'aa' AS lang", "'s' AS source")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    def probe(spark, docs):
        ship(spark)

        def sizes(batches):
            for b in batches:
                yield pd.DataFrame({"bytes": [int(b["text"].str.len().sum())], "malloc": [os.environ.get(malloc)]})

        return docs.select("text").mapInPandas(sizes, "bytes long, malloc string")

    alone = probe(spark, docs).toPandas()
    assert alone["bytes"].max() > 3 << 20 and alone["malloc"].isna().all()
    got = sparing(probe)(spark, docs).toPandas()
    assert got["bytes"].sum() == alone["bytes"].sum() and got["bytes"].max() <= (2 << 20) + 6000 and got["malloc"].notna().all()
    try:
        for name, stage in corpus_pipeline.STAGES:
            spark.conf.unset(readers)
            ship(spark)
            stage(spark, docs.limit(3), str(tmp_path))
            assert int(spark.conf.get(readers)) <= 512, name
            assert name == "source_mixing" or int(spark.conf.get(arrow)) <= 2 << 20, name
            assert spark.sparkContext.environment == environment, name
        ship(spark)
        assert int(spark.conf.get(arrow)) == 8 << 20
    finally:
        spark.conf.set(readers, usual)


def test_pipeline(spark, rows, tmp_path):
    """Each stage against plain Python on the rows that it was given."""
    import corpus_pipeline

    columns = ["doc_id", "text", "lang", "source"]
    rnd = random.Random(21)
    more = [(1000 + i, prose(rnd, 40) + (" vile rotten vile" if i % 4 == 0 else ""), "aa", f"s{i % 4}") for i in range(200)]
    more += [(3000, " ".join("".join(rnd.choices("qxzjkvw", k=7)) for _ in range(300)), None, "s1")]
    docs_of(spark, rows + more).select(columns).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(1000 + i, i % 2, int(i % 4 == 0)) for i in range(200)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    given = sorted(map(tuple, docs.collect()), key=key)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns, name
        out = materialise(out)
        got = sorted(map(tuple, out.collect()), key=key)
        if name == "language_id":
            scorer = langid.Scorer(langid.train(docs))
            want = [r for r in given if r[1] and any(c.isalpha() for c in r[1]) and not scorer.predict([r[1]])["rejected"][0]]
            assert got == want and len(want) < len(given) and not any(r[0] == 3000 for r in got)
        elif name == "toxicity":
            scorer = toxicity.ToxicScorer(toxicity.train(docs, spark.read.parquet(str(tmp_path / "labels.parquet"))))
            want = [r for r in given if scorer.probability(scorer.passages(r[1] or "")[1]) < corpus_pipeline.TOXIC]
            assert got == want and len(want) < len(given)
        elif name == "ngram_jaccard_join":
            label = brute_labels(given, 5, 80)
            kept = [min(k for k, v in enumerate(label) if v == c) for c in sorted(set(label))]
            assert len(got) == len(kept) < len(given)
            assert {label[given.index(r)] for r in got} == set(label)
        elif name == "source_mixing":
            weights = {i: 1.0 if q else 0.25 for i, q, _ in labels}
            assert got == sorted([r for r, n in zip(given, naive_copies(given, weights)) for _ in range(n)], key=key)
        docs, given = out, got
    enc = packing.encoder(vocabulary("byte_bpe_50k.json")).model
    want = Counter()
    for i, text, *_ in given:
        n = len(enc.encode(text, add_special_tokens=False).ids) + 1
        want[i] += n
    out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).toPandas()
    assert out.groupby("doc_id")["length"].sum().to_dict() == {k: v for k, v in want.items() if k is not None}
    by = out.sort_values(["sequence_id", "offset"]).groupby("sequence_id")["length"]
    assert by.sum().max() <= 2048 and (out.sort_values(["sequence_id", "offset"])["offset"] == by.cumsum() - out.sort_values(["sequence_id", "offset"])["length"]).all()
    whole = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert sorted(whole[["length", "ids_crc32"]].itertuples(index=False)) == sorted(out[["length", "ids_crc32"]].itertuples(index=False))


def test_near_vectors_where_searches_find_nothing(spark, vectors, monkeypatch):
    """Where every search stays below the least recall, the exact comparison gives all links."""
    monkeypatch.setattr(vectordedup, "CAP", 40)  # several blocks
    monkeypatch.setattr(vectordedup, "audit_recall", lambda *_: 0.0)
    monkeypatch.setattr(vectordedup, "TRIES", 1)
    monkeypatch.setattr(vectordedup, "_links", lambda classes, *_: classes.sparkSession.createDataFrame([], vectordedup.RESULT))
    got = {r["vec_id"]: r["n_links"] for r in vectordedup.near_vectors(vectors_of(spark, vectors[:-1])).collect()}
    good = {i: np.array(v, dtype=np.float32).astype(float) for i, v in vectors[:-1] if v is not None and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v)}
    for i, x in good.items():
        assert got[i] == sum(j != i and len(y) == len(x) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9 for j, y in good.items())


def test_one_direction(spark, monkeypatch):
    """Vectors of one direction, which no centres take apart, are compared whole."""
    monkeypatch.setattr(vectordedup, "CAP", 60)
    monkeypatch.setattr(vectordedup, "SHARD", 20)
    rows = [(i, [float(i + 1), 0.0, 0.0]) for i in range(150)] + [(200, [0.0, 1.0, 0.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectordedup.near_vectors(vectors_of(spark, rows)).collect()}
    assert got == {**{i: (149, 0) for i in range(150)}, 200: (0, 200)}
