"""Fingerprints, repeated passages, exact and near duplicates."""

import hashlib

import numpy as np
import plain
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from adoptlens.llm import components, exact_dedup, fingerprints, near_dedup, queries, repeats, shingles


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def same(found, wanted):
    assert sorted(found, key=repr) == sorted(wanted, key=repr)


@pytest.fixture(scope="module")
def edge(spark):
    return plain.frame(spark, plain.edge_rows()).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    return plain.frame(spark, plain.odd_rows())


@pytest.fixture(scope="module")
def empty(spark):
    return plain.frame(spark, [])


# fingerprints


def test_fingerprints_of_edge_texts(edge):
    docs = sorted(((i, t or "") for i, t in plain.edge_rows()), reverse=True)
    found = {r["doc_id"]: r for r in fingerprints.fingerprints(edge, with_positions=True).collect()}
    assert len(found) == len(docs)
    for k, (i, text) in enumerate(docs):
        following = docs[(k + 1) % len(docs)][1]
        n = len(text)
        edited = text[: n - n // 2] + following[: n // 2]
        row = found[i]
        assert row["edited"] == edited
        unsigned = lambda anchors: [(p, h % 2**32) for p, h in zip(anchors["pos"], anchors["hash"])]
        assert unsigned(row["anchors"]) == plain.syncmers(text)
        assert unsigned(row["edited_anchors"]) == plain.syncmers(edited)
        assert row["next"]["text"] == following


def test_fingerprint_query_columns(spark, tmp_path):
    plain.frame(spark, plain.edge_rows()).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r for r in queries.op1_fingerprints(spark, str(tmp_path)).collect()}
    texts = dict(plain.edge_rows())
    anchors = [h for _, h in plain.syncmers(texts[13])]
    assert out[13]["fingerprint"] == "".join(f"{h:08x}" for h in dict.fromkeys(anchors))
    assert out[1]["fingerprint"] == out[3]["fingerprint"]
    assert out[7]["fingerprint"] == "" and out[6]["n_chars"] == 0
    assert out[6]["edited_sha256"] == hashlib.sha256(b"").hexdigest()
    following = [h for _, h in plain.syncmers(texts[12])]
    assert out[13]["near_next"] == pytest.approx(plain.in_order(anchors, following))
    assert all(0 <= r["near_edited"] <= 1 for r in out.values())


def test_likeness_is_that_of_plain_python(spark):
    base = plain.sentence(40, 60).split()
    moved = base[30:] + base[:30]
    texts = [" ".join(base), " ".join(moved), " ".join(base[:40]), " ".join(reversed(base)), "", "one two", plain.sentence(41, 30) * 2]
    pairs = [(a, b) for a in texts for b in texts]
    df = spark.createDataFrame(pairs, "a string, b string")
    df = fingerprints.with_anchors(fingerprints.with_anchors(df, "a", "x"), "b", "y")
    found = fingerprints.with_likeness(df, "x", "y", "likeness").collect()
    for r in found:
        one, two = ([h for _, h in plain.syncmers(t)] for t in (r["a"], r["b"]))
        assert r["likeness"] == pytest.approx(plain.in_order(one, two))
    told = {(r["a"], r["b"]): r["likeness"] for r in found}
    assert all(told[t, t] == 1.0 for t in texts)
    assert 0.5 < told[texts[0], texts[1]] < 1.0 and told[texts[0], ""] == 0.0


def test_fingerprints_of_odd_and_empty_tables(odd, empty):
    assert fingerprints.fingerprints(empty).count() == 0
    found = fingerprints.fingerprints(odd).collect()
    assert len(found) == 7
    # descending ids, those without one last, then the first again
    order = sorted(found, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["text"]))
    for a, b in zip(order, order[1:] + order[:1]):
        assert a["next"]["text"] == b["text"]


def test_ids_are_never_ordered_in_one_task(spark):
    many = spark.range(0, 5000, 1, 7).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    got = {r["doc_id"]: r["next"]["text"] for r in fingerprints.fingerprints(many).collect()}
    assert all(got[i] == str((i - 1) % 5000) for i in range(5000))


# repeated passages


def removed(df, **options):
    return rows(repeats.remove_repeats(df, **options), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_repeats_of_edge_texts(edge, empty):
    same(removed(edge), plain.repeats(plain.edge_rows()))
    assert removed(empty) == []


def test_repeats_spans_and_kept_bytes(edge):
    texts = {i: (t or "").encode() for i, t in plain.edge_rows()}
    for r in repeats.remove_repeats(edge, with_kept=True).collect():
        gone = bytearray(len(texts[r["doc_id"]]))
        for s in r["spans"]:
            gone[s["start"] : s["end"]] = b"\1" * (s["end"] - s["start"])
        assert bytes(r["kept"]) == bytes(c for c, g in zip(texts[r["doc_id"]], gone) if not g)
        assert sum(gone) == r["n_removed"] and len(r["spans"]) == r["n_spans"]


def test_repeats_over_chunk_edges(spark, monkeypatch):
    text = plain.sentence(1, 400)
    docs = [(1, text), (2, "new " + text[100:2000]), (3, text[50:]), (4, text * 2)]
    monkeypatch.setattr(repeats, "CHUNK", 512)
    same(removed(plain.frame(spark, docs)), plain.repeats(docs))


def test_rows_that_repeat_an_id_keep_their_strings(odd):
    out = removed(odd)
    assert len(out) == 7
    long = len(plain.sentence(1, 120))
    assert [r[2] for r in out if r[0] == 2] == [long]
    # a null id is smaller than any other
    assert sorted(r[2] for r in out if r[0] == 1) == [0, long, long]
    assert all(r[2] == 0 for r in out if r[0] is None)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("ab", max_size=90), min_size=1, max_size=6), st.integers(17, 22))
def test_first_documents_agree_with_pairs(texts, least):
    raw = np.frombuffer("".join(texts).encode() + b"\0", np.uint8)
    at, doc, start = [], [], 0
    for d, t in enumerate(texts):
        for x in range(len(t) - least + 1):
            at.append(start + x)
            doc.append(d)
        start += len(t)
    at, doc = np.array(at, dtype=np.int64), np.array(doc, dtype=np.int64)
    found = repeats.first_documents(raw, at, doc, least)
    strings = [raw[a : a + least].tobytes() for a in at]
    assert found.tolist() == [min(d for d, s in zip(doc.tolist(), strings) if s == mine) for mine in strings]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=8, max_size=8), st.integers(0, 5)), max_size=40))
def test_previous_factors_agree_with_every_pair(suffixes):
    suffixes = sorted(suffixes, key=lambda x: x[0])
    common = lambda a, b: next((k for k in range(8) if a[k] != b[k]), 8)
    columns = [np.array([int.from_bytes(t[k : k + n].encode()) for t, _ in suffixes], np.uint64) for k, n in ((0, 5), (5, 3))]
    lcp = repeats.common_prefixes(columns, [5, 3], np.arange(len(suffixes)))
    assert lcp.tolist() == [common(suffixes[k - 1][0], t) if k else 0 for k, (t, _) in enumerate(suffixes)]
    doc = np.array([d for _, d in suffixes], dtype=np.int64)
    length, source = repeats.previous_factors(doc, lcp)
    for k, (text, d) in enumerate(suffixes):
        assert length[k] == max([common(text, t) for t, e in suffixes if e < d], default=0)
        if length[k]:
            assert doc[source[k]] < d and common(suffixes[source[k]][0], text) == length[k]


def test_runs_under_one_key_are_told_apart(spark, monkeypatch):
    text = [plain.sentence(k, 60) for k in range(70, 76)]
    docs = [(k, a + "\n" + b) for k, (a, b) in enumerate([(text[0], text[1]), (text[2], text[0]), (text[3], text[3]), (text[1], text[4])])]
    want = plain.repeats(docs)
    assert sum(r[2] for r in want) > 500
    raw = np.frombuffer(b"abcabcabdabc", np.uint8)
    at, length = np.array([0, 3, 6, 9]), np.array([3, 3, 3, 2])
    assert repeats._unlike(raw, at, length, np.zeros(4, np.int64)).tolist() == [False, False, True, True]
    # with one key for all runs nothing is removed, and nothing wrong is
    monkeypatch.setattr(repeats, "_unlike", lambda raw, at, length, other: np.ones(len(at), bool))
    table = pa.Table.from_arrays(
        [pa.array([0]), pa.array([0]), pa.array([np.array([1], "<i8").tobytes() + np.array([5], "<i8").tobytes()
         + np.array([3], "<u2").tobytes() + zstandard.compress(b"x" * 50)])], names=["part", "split", "data"],
    )
    told = repeats._answer(50)(table).column("data")[0].as_py()
    assert np.frombuffer(told, "<i8", 2).tolist() == [0, 0]
    monkeypatch.undo()
    same(removed(plain.frame(spark, docs)), want)


def in_steps(docs, least, splits=2):
    """The steps of op2 without Spark: removed bytes by row, and the runs that were sent."""
    deal = [docs[k::splits] for k in range(splits)]
    tables = [
        pa.table({
            "doc_id": pa.array([d for d, _ in rows], pa.int64()),
            "raw": pa.array([t.encode() for _, t in rows], pa.binary()),
            "split": pa.array([k] * len(rows), pa.int64()),
        })
        for k, rows in enumerate(deal)
    ]

    def dealt(blobs, by):
        blobs = pa.concat_tables([repeats.BLOB.empty_table(), *blobs])
        return [blobs.filter(pa.array([x == k for x in blobs.column(by).to_pylist()], pa.bool_())) for k in range(splits)]

    sides = [repeats._send_sides(splits, least)(t) for t in tables if t.num_rows]
    shared = dealt([repeats._meet(b) for b in dealt(sides, "part") if b.num_rows], "split")
    runs = [repeats._send_runs(splits, least)(t, s) for t, s in zip(tables, shared)]
    answers = dealt([repeats._answer(least)(b) for b in dealt(runs, "part") if b.num_rows], "split")
    out = [repeats._cut_out(least, False)(t, a) for t, a in zip(tables, answers)]
    sent = sum(int(np.frombuffer(b, "<i8", 1)[0]) for r in runs for b in r.column("data").to_pylist())
    return sorted(zip(*[pa.concat_tables(out).column(c).to_pylist() for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")])), sent


@settings(max_examples=60, deadline=None)
@given(
    st.lists(st.one_of(st.text("ab", max_size=120), st.text("a", max_size=120), st.text("abcdefgh", max_size=40).map(lambda t: t * 4)), max_size=6),
    st.sampled_from([17, 18, 33, 50, 64]),
)
def test_repeats_in_repetitive_texts(texts, least):
    docs = list(enumerate([*texts, *(t[3:70] for t in texts)]))
    same(in_steps(docs, least)[0], plain.repeats(docs, least))


def test_short_strings_that_meet_by_chance_are_not_sent():
    phrase = "of the other one in the"
    far = [(k, plain.sentence(2 * k, 12) + phrase + plain.sentence(2 * k + 1, 12)) for k in range(300, 308)]
    found, sent = in_steps(far, 50)
    assert sent == 0 and all(r[2] == 0 for r in found)
    # one more word on each side, and a string is long enough
    near = [(k, t.replace(phrase, f"some more words {phrase} and so on again")) for k, t in far]
    found, sent = in_steps(near, 50)
    assert sent > 0 and [r[2] > 0 for r in found] == [False] + [True] * 7


def test_only_suffixes_with_a_shared_string_are_ordered(monkeypatch):
    ordered = []
    first = repeats.first_documents
    monkeypatch.setattr(repeats, "first_documents", lambda raw, at, *rest: ordered.append(len(at)) or first(raw, at, *rest))
    common = plain.sentence(310, 9)[:50]
    docs = [(k, plain.sentence(320 + k, 12) + common + plain.sentence(340 + k, 12)) for k in range(4)]
    same(in_steps(docs, 50)[0], plain.repeats(docs))
    # a string of 50 bytes in four documents, and a few that chance adds at its ends
    assert 0 < sum(ordered) < 40


# exact duplicates


def test_exact_groups(edge, empty, odd):
    found = rows(exact_dedup.exact_groups(edge), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    same(found, plain.exact(plain.edge_rows()))
    assert exact_dedup.exact_groups(empty).count() == 0
    found = rows(exact_dedup.exact_groups(odd), "doc_id", "keep_id", "group_size", "kept")
    wanted = [(None, 2, 4, False), (None, None, 1, True), (None, None, 1, True), (1, 2, 4, False), (1, 2, 4, False)]
    same(found, [*wanted, (1, 1, 1, True), (2, 2, 4, True)])


def test_chunks_make_up_the_text(edge):
    parts = exact_dedup.chunks(F.col("text"), 16, 64)
    for r in edge.filter("text is not null").select("text", parts.alias("parts")).collect():
        assert b"".join(map(bytes, r["parts"])).decode() == r["text"]
        assert all(len(p) <= 64 for p in r["parts"]) and all(len(p) >= 16 for p in r["parts"][:-1] if len(p) < 64)


def test_an_edit_moves_only_the_cuts_near_it(spark):
    random = np.random.default_rng(7)
    alphabets = [
        [chr(c) for c in range(0x4E00, 0x9FA5)], [chr(c) for c in range(0xE01, 0xE3B)], list("0123456789abcdef"), list("ACGT"),
        list("etaoin shrdlu"), [chr(c) for c in range(0x430, 0x450)],
    ]
    pairs = []
    for letters in alphabets:
        text = "".join(random.choice(letters, 60_000))
        for at in random.integers(0, len(text), 6):
            pairs.append((text, text[:at] + "x" + text[at:]))
    df = spark.createDataFrame(pairs, "a string, b string")
    changed = []
    for r in df.select(exact_dedup.chunks(F.col("a")).alias("a"), exact_dedup.chunks(F.col("b")).alias("b")).collect():
        one, two = [bytes(x) for x in r["a"]], [bytes(x) for x in r["b"]]
        changed.append(len(set(two) - set(one)))
        assert 20 < len(one) and 256 <= sum(map(len, one)) / len(one) <= 4096
    assert max(changed) <= 3 and np.mean(changed) < 2


def test_very_long_text_without_a_cut(spark):
    df = spark.range(1).select(F.expr("repeat('a', int(3000000 + id))").alias("t"))
    sizes = df.select(F.transform(exact_dedup.chunks(F.col("t")), F.octet_length).alias("n")).first()["n"]
    assert sum(sizes) == 3_000_000 and max(sizes) == exact_dedup.MOST


def test_one_identifier_for_two_chunks_is_an_error(edge, monkeypatch):
    monkeypatch.setattr(exact_dedup, "identifier", lambda chunk: F.sha2(F.lit("same"), 256))
    with pytest.raises(ValueError):
        exact_dedup.verify_identifiers(edge.select(F.coalesce("text", F.lit("")).alias("norm")), "norm")


# near duplicates


def test_near_duplicates_of_edge_texts(edge, empty):
    for words in (4, 5):
        found = rows(near_dedup.near_duplicates(edge, words), "doc_id", "n_shingles", "component_id", "kept")
        same(found, plain.near(plain.edge_rows(), words))
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_duplicates_of_odd_rows(odd):
    out = rows(near_dedup.near_duplicates(odd), "doc_id", "component_id", "kept")
    wanted = [(None, 1, False), (None, None, True), (None, None, True), (1, 1, True), (1, 1, True), (1, 1, True)]
    same(out, [*wanted, (2, 1, False)])


def _variants(n, step):
    """Texts that differ from one base in some words, each in others: chains of links whose
    ends aren't linked, and some that are linked with none."""
    out = []
    for k in range(n):
        words = plain.sentence(50, 100).split()
        for j in range(k % step):
            words[(k * 7 + j * 31) % 100] = f"v{k}x{j}"
        out.append((k * 3 + 1, " ".join(words)))
    return out


def test_links_that_no_hub_has_are_found(spark):
    docs = _variants(60, 9)
    found = rows(near_dedup.near_duplicates(plain.frame(spark, docs), 4), "doc_id", "n_shingles", "component_id", "kept")
    same(found, plain.near(docs, 4))


def test_chain_of_links(spark):
    base = plain.sentence(60, 300).split()
    docs = [(k, " ".join(base[k * 8 : k * 8 + 120])) for k in range(20)]
    found = rows(near_dedup.near_duplicates(plain.frame(spark, docs), 4), "doc_id", "n_shingles", "component_id", "kept")
    same(found, plain.near(docs, 4))


def test_sets_survive_their_bytes():
    one = shingles.shingle_sets([plain.sentence(3, 200)], 4)[0]
    back = near_dedup.from_bytes(near_dedup.set_bytes(one))
    assert (back == np.unique(one >> np.uint64(16))).all()


def test_shingles_don_t_depend_on_their_neighbours():
    texts = [t for _, t in plain.edge_rows()]
    together = shingles.shingle_sets(texts, 4)
    for text, found in zip(texts, together):
        assert (shingles.shingle_sets([text], 4)[0] == found).all()
        w = plain.words_of(text)
        assert len(found) == len({tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else ())


def test_min_max_estimates_likeness():
    a, b = (shingles.shingle_sets([plain.sentence(s, 400)], 1)[0] for s in (1, 2))
    x, y = near_dedup.min_max(a), near_dedup.min_max(np.concatenate([a, b]))
    true = len(a) / len(np.union1d(a, b))
    assert abs((x == y).mean() - true) < 0.12


def test_components_of_long_paths(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 90), (90, 95), (7, 7)]
    found = components.components(spark.createDataFrame(edges, "a long, b long"))
    wanted = [(k, 0) for k in range(41)] + [(90, 90), (95, 90), (100, 90)]
    same(rows(found, "node", "component"), wanted)
