"""The language mixture against a version in plain Python, from counts to sets."""

import collections
import math
import zlib

import plain
import pytest

from adoptlens.llm import language

SF = "/root/testdata/sf0.001"


def cells(text):
    """The n-gram cells of the letters of each word."""
    t, out, inside = (text or "").lower(), [], False
    code = [ord(c) if c.isalpha() else 0 for c in t]
    for k, c in enumerate(code):
        if not c:
            inside = False
            continue
        if not inside:
            out.append([])
        inside = True
        before, after = code[k - 1] if k else 0, code[k + 1] if k + 1 < len(code) else 0
        cell = (before * 0x9E3779B1 + c * 0x85EBCA77 + after * 0xC2B2AE3D) % 2**32
        out[-1].append((((cell ^ (cell >> 15)) * 0x2C1B3C6D) % 2**32) >> 16)
    return out


def learned(rows):
    counts = collections.defaultdict(collections.Counter)
    for i, text, lang in rows:
        if text is not None and lang is not None and (i is None or zlib.crc32(str(i).encode()) % 4 != 2):
            counts[lang].update(c for word in cells(text) for c in word)
    total = {lang: sum(n.values()) + 0.5 * language.BINS for lang, n in counts.items()}
    return {lang: lambda c, n=n, s=total[lang]: math.log((n[c] + 0.5) / s) for lang, n in counts.items()}


def mixture(model, text):
    """[(lang, share)], the set with the highest penalised likelihood."""
    langs = sorted(model)
    words = cells(text)
    if not words or not langs:
        return []
    likely = []
    for word in words:
        logs = [sum(model[x](c) for c in word) for x in langs]
        likely.append([math.exp(v - max(logs)) for v in logs])

    def fit(share):
        for _ in range(language.ROUNDS):
            total = [0.0] * len(langs)
            for w in likely:
                parts = [a * b for a, b in zip(w, share)]
                whole = max(sum(parts), 1e-300)
                total = [t + p / whole for t, p in zip(total, parts)]
            share = [t / len(likely) for t in total]
        return share, sum(math.log(max(sum(a * b for a, b in zip(w, share)), 1e-300)) for w in likely)

    start, _ = fit([1 / len(langs)] * len(langs))
    order = sorted(range(len(langs)), key=lambda k: (-start[k], k))
    best, value = None, -math.inf
    for size in range(1, len(langs) + 1):
        share = [max(start[k], 1e-6) if k in order[:size] else 0.0 for k in range(len(langs))]
        share, now = fit([s / sum(share) for s in share])
        now -= language.PENALTY * (size - 1) * math.log(len(words) + 1)
        if now <= value:
            break
        best, value = share, now
    return sorted(((langs[k], s) for k, s in enumerate(best) if s > 0), key=lambda x: -x[1])


def test_sets_and_shares_agree_with_plain_python(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in documents.select("doc_id", "text", "lang").collect()]
    model = learned(rows)
    texts = {i: t for i, t, _ in rows if t is not None and len(t) < 2500}
    texts = dict(sorted(texts.items())[:40])
    by = {lang: next(t for _, t, x in rows if x == lang and t and 800 < len(t) < 2500) for lang in sorted(model)}
    first, second = sorted(by)[:2]
    texts |= {9001: by[first][:700] + "\n" + by[second][:700], 9002: "12 34", 9003: None, 9004: "é", 9005: by[first][:60]}
    asked = plain.frame(spark, list(texts.items()))
    found = {r["doc_id"]: r for r in language.predict(asked, language.learn(documents)).collect()}
    several = 0
    for i, text in texts.items():
        want = mixture(model, text)
        got = [(x["lang"], x["share"]) for x in found[i]["langs"]]
        assert sorted(x for x, _ in got) == sorted(x for x, _ in want), i
        assert dict(got) == pytest.approx(dict(want), abs=2e-3), i
        assert found[i]["lang_pred"] == (got[0][0] if got else language.UNDETERMINED)
        several += len(got) > 1
    assert several >= 1
