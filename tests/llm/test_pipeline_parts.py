"""Languages, token files, mixing, archives, shards, packing."""

import base64
import gzip
import hashlib
import zlib

import numpy as np
import plain
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from adoptlens.llm import language, mixing, packing, queries, sharding, simple8b, token_files, tokens, warc

SF = "/root/testdata/sf0.001"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture(scope="module")
def edge(spark):
    return plain.frame(spark, plain.edge_rows()).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    return plain.frame(spark, plain.odd_rows())


@pytest.fixture(scope="module")
def empty(spark):
    return plain.frame(spark, [])


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_path())


def ids_of(library, text):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")


# languages


def test_held_out_accuracy(spark, documents):
    model = language.learn(documents)
    found = language.predict(documents, model).join(documents.select("doc_id", "lang"), "doc_id")
    rows_ = found.filter(language.held_out(F.col("doc_id"))).collect()
    assert len(rows_) > 30
    assert sum(r["lang"] == r["lang_pred"] for r in rows_) / len(rows_) > 0.9
    for r in rows_:
        assert 0 <= r["score"] <= 1 and sum(x["share"] for x in r["langs"]) == pytest.approx(1)


def test_held_out_is_crc32_of_the_id(spark):
    ids = spark.createDataFrame([(i,) for i in [*range(50), -3, None]], "doc_id long")
    for i, out in ids.select("doc_id", language.held_out(F.col("doc_id"))).collect():
        assert out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)


def test_two_languages_in_one_text(spark, documents):
    model = language.learn(documents)
    by = {r["lang"]: r["text"] for r in documents.filter("n_chars > 1500").orderBy("doc_id").collect()}
    mixed = by["en"][:1200] + "\n" + by["de"][:1200]
    found = language.predict(plain.frame(spark, [(1, mixed)]), model).first()
    assert {x["lang"] for x in found["langs"]} == {"en", "de"} and 0.3 < found["score"] < 0.7


def test_languages_of_edge_texts(spark, edge, odd, empty, documents):
    model = language.learn(documents)
    found = {r["doc_id"]: r for r in language.predict(edge, model).collect()}
    assert {i for i, r in found.items() if r["lang_pred"] == "und"} == {6, 7, 8, 18, 24}
    assert found[1]["score"] == found[3]["score"] and found[6]["score"] == 0.0
    assert language.predict(odd, model).count() == 7
    assert language.predict(empty, model).count() == 0
    carried = language.with_language(edge, model)
    assert carried.columns == [*edge.columns, "__language"] and carried.count() == edge.count()
    untaught = language.learn(edge.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in language.predict(edge, untaught).collect()} == {"und"}


# token files


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=300), st.integers(1, 80))
def test_simple8b_round_trip(values, block):
    data = simple8b.encode(np.array(values, dtype=np.uint64), block)
    assert simple8b.decode(data).tolist() == values
    assert simple8b.size_of(data + b"more") == len(data)


def test_simple8b_packs_small_values():
    assert len(simple8b.encode(np.ones(60_000, np.uint64))) < 60_000 / 8 * 1.1
    words, escapes = simple8b.encode_block(np.array([1 << 61, 5], dtype=np.uint64))
    assert escapes.tolist() == [1 << 61] and len(words) == 2


def test_words_have_the_library_s_ids(library):
    texts = [t for _, t in plain.edge_rows()] + ["e\u0301, A\u030a. x\u0301 ,. \u00c9t\u00e9. don't, y'all're; 'rest, 's, a.. b.,c. 3. d","It's we're!? 'tis a--b c.d x.,y Été ÉTÉ.", "a b\tc\r\nd  e <|endoftext|> f", "İİ K ﬁ"]
    flat, lengths = tokens.WordEncoder(tokens.vocabulary_path()).encode(texts)
    at = 0
    for text, n in zip(texts, lengths.tolist()):
        library.encode_special_tokens = True
        assert flat[at : at + n].tolist() == ids_of(library, text).tolist(), text
        at += n


def test_encoder_forgets_and_learns_again(library, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    encoder = tokens.WordEncoder(tokens.vocabulary_path())
    for text in ("one two three, four. five six", "seven eight one two", "one two three, four!"):
        assert encoder.encode([text])[0].tolist() == ids_of(library, text).tolist()


def test_token_file_of_edge_texts(spark, edge, odd, empty, library, tmp_path):
    token_files.write_tokens(edge, f"{tmp_path}/t", segment_ids=500)
    found = token_files.read_tokens(spark, f"{tmp_path}/t").orderBy("doc_id").collect()
    start = 0
    for (i, text), r in zip(sorted(plain.edge_rows()), found, strict=True):
        ids = ids_of(library, text)
        assert tuple(r) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    token_files.write_tokens(empty, f"{tmp_path}/e")
    assert token_files.read_tokens(spark, f"{tmp_path}/e").count() == 0
    token_files.write_tokens(odd, f"{tmp_path}/o")
    found = token_files.read_tokens(spark, f"{tmp_path}/o").orderBy("start").collect()
    assert [r["doc_id"] for r in found] == [None, None, None, 1, 1, 1, 2]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(found, found[1:]))


# packing


def check_packing(found, wanted, length):
    by_sequence, by_doc = {}, {}
    for r in found:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= length
    for i, ids in wanted.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert bytes(r["ids"]) == ids[at : at + r["length"]].tobytes()
            assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids)
    return by_sequence


def test_packing_of_edge_texts(edge, empty, odd, library):
    wanted = {i: ids_of(library, t) for i, t in plain.edge_rows()}
    for length in (64, 4096):
        check_packing(packing.pack(edge, length, open_windows=2, with_ids=True).collect(), wanted, length)
    assert packing.pack(empty).count() == 0
    assert packing.pack(odd).agg(F.sum("length")).first()[0] == sum(len(ids_of(library, t)) for _, t in plain.odd_rows())


def test_packing_merges_many_partitions_and_pads_little(documents, library):
    wanted = {r["doc_id"]: ids_of(library, r["text"]) for r in documents.collect()}
    found = packing.pack(documents.repartition(40), 4096, with_ids=True).collect()
    sequences = check_packing(found, wanted, 4096)
    used = sum(len(x) for x in wanted.values())
    assert used / (4096 * len(sequences)) > 0.93


# mixing


def test_raking_meets_the_marginals():
    draw = np.random.default_rng(3)
    tokens_, codes = draw.integers(1, 1000, 60).astype(float), [np.arange(60) % 5, np.arange(60) // 5 % 4, np.arange(60) // 20]
    targets = [np.full(5, 0.2), np.array([0.4, 0.3, 0.2, 0.1]), np.array([0.5, 0.25, 0.25])]
    weight, error = mixing.rake(tokens_, codes, targets)
    assert error <= mixing.TOLERANCE
    for code, target in zip(codes, targets):
        assert np.bincount(code, weight) == pytest.approx(target, abs=1e-9)


def test_sparse_cells_are_raked_to_the_tolerance():
    # 20 sources x 20 languages x 4 topics, 15 % of the cells filled
    draw = np.random.default_rng(11)
    grid = np.argwhere(draw.random((20, 20, 4)) < 0.15)
    cells = sorted((f"s{a}", f"l{b}", f"t{c}", int(draw.integers(1, 10_000))) for a, b, c in grid)
    found = mixing.cell_probabilities(cells, mixing.POWERS)
    assert all(met for *_, met in found) and max(p for *_, p, _ in found) == 1.0
    # a category of one cell whose other marginal wants less can't be met
    torn = [("a", "x", "t", 10), ("b", "y", "t", 10)]
    targets = {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.1, "y": 0.9}}
    assert not any(met for *_, met in mixing.cell_probabilities(torn, {}, targets))


def test_cells_on_spark_agree_with_the_driver(spark, monkeypatch, edge, empty):
    monkeypatch.setattr(mixing, "MOST_ROUNDS", 3)
    args = (F.col("source"), F.col("lang"), F.col("text").substr(1, 1), mixing.words(F.col("text")), mixing.draw(F.col("doc_id"), F.col("text")))
    for table, options in ((edge, {"powers": mixing.POWERS}), (edge, {"targets": {"source": {"src0": 0.2, "src1": 0.8}}}), (empty, {})):
        want = rows(mixing.mix(table.drop("mix"), *args, **options), "doc_id", "mix.probability", "mix.kept", "mix.on_target")
        with monkeypatch.context() as patch:
            patch.setattr(mixing, "DRIVER_CELLS", 0)
            got = rows(mixing.mix(table.drop("mix"), *args, **options), "doc_id", "mix.probability", "mix.kept", "mix.on_target")
        assert [r[0::2] for r in got] == [r[0::2] for r in want]
        assert [r[1] for r in got] == pytest.approx([r[1] for r in want], abs=1e-8)


def test_sample_follows_the_targets(spark):
    rows_ = [(i, "w " * (1 + i % 7), "en" if i % 3 else "de", "big" if i % 10 else "small") for i in range(4000)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string")
    args = (F.col("source"), F.col("lang"), F.lit("t"), mixing.words(F.col("text")), mixing.draw(F.col("doc_id"), F.col("text")))
    out = mixing.mix(docs, *args, targets={"source": {"big": 0.5, "small": 0.5}}).filter("mix.kept")
    shares = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum("mix.tokens").alias("n")).collect()}
    assert shares["big"] / sum(shares.values()) == pytest.approx(0.5, abs=0.06)


def test_mixing_of_edge_rows(spark, edge, empty, odd):
    def mixed(df, **options):
        number = mixing.draw(F.col("doc_id"), F.col("text"))
        return mixing.mix(df.drop("mix"), F.col("source"), F.col("lang"), F.lit(None), mixing.words(F.col("text")), number, **options)

    assert mixed(empty).count() == 0
    # natural shares keep everything
    assert mixed(odd).filter("mix.kept").count() == 7
    assert mixed(edge, powers={"source": 0.5}).count() == len(plain.edge_rows())
    nothing = plain.frame(spark, [(1, None), (2, "")])
    assert mixed(nothing).filter("mix.kept").count() == 2
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (2, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    found = dict(rows(mixing.with_topic(odd, labels), "doc_id", "__topic"))
    assert found == {None: "none", 1: "toxic", 2: "good"}


# archives


PAGES = [
    (1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, None, "other\r\n\r\nWARC/1.1\r\n\r\n"), (4, "http://a/4\r\nX: y", None),
    (5, "http://a/5", ""), (6, "http://a/6", "é" * 5000), (7, "http://a/7", "same"), (8, "http://a/8", "x" * 300_000),
    (9, "http://a/9", "twice"), (9, "http://a/9", "twice"), (9, "http://b/9", "else"),
]


def archived(spark, pages, path, **options):
    warc.write_archives(pages, path, **options)
    records = warc.read_records(spark, path)
    return warc.with_referred_page(warc.transactions(records), records)


def test_archives_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "yes", 1) for p in PAGES], "page_id long, url string, html string, digest string, copy int")
    found = archived(spark, pages.repartition(3), f"{tmp_path}/w", records_per_file=4).collect()
    digest = lambda html: base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()
    wanted = []
    for i, _, html in PAGES:
        kind, to = "response", None
        if (i, html) in ((1, "same"), (2, "same")):
            kind, to = "revisit", 7
        if i == 4:
            kind, to = "revisit", 5
        wanted.append((i, len((html or "").encode()), digest(html), kind, to))
    wanted[9] = (*wanted[9][:3], "revisit", 9)
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to_page"]) for r in found]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)
    for r in found:
        assert r["request"] is not None and r["metadata"] is not None
        if r["record_type"] == "response":
            assert digest(bytes(r["payload"]).decode()) == r["payload_digest"]
    files = list((tmp_path / "w").glob("*.txt.gz"))
    records = [h for f in files for h, _ in warc.parse(gzip.decompress(f.read_bytes()))]
    assert len(records) == 3 * len(PAGES) and len({h["warc-record-id"] for h in records}) == len(records)


def test_archives_of_small_payloads_and_empty_tables(spark, tmp_path):
    schema = "page_id long, url string, html string"
    few = [(1, "u", "tiny"), (2, "u", "tiny"), (3, "u", "large enough"), (4, "u", "large enough"), (None, "u", "large enough")]
    found = archived(spark, spark.createDataFrame(few, schema), f"{tmp_path}/s", least_bytes=5).collect()
    kinds = sorted(((r["page_id"], r["record_type"], r["refers_to_page"]) for r in found), key=repr)
    assert kinds == sorted([(1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None), (None, "revisit", 4)], key=repr)
    assert archived(spark, spark.createDataFrame([], schema), f"{tmp_path}/e").count() == 0


def test_long_payloads_in_one_file(spark, tmp_path):
    # 100 MB with no record end, and 20 MB of nothing but record ends
    # (times that depend on the row, so that no plan holds the text)
    times = "int(if(id = {}, {}, 0))"
    page = F.expr(f"repeat('0123456789', {times.format(0, 10**7)}) || repeat('\\r\\n\\r\\n', {times.format(1, 5 * 10**6)})")
    pages = spark.range(4).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), page.alias("html")).coalesce(1)
    path = f"{tmp_path}/long"
    warc.write_archives(pages, path)
    records = warc.read_records(spark, path, whole=False)
    found = warc.with_referred_page(warc.transactions(records), records).collect()
    got = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["refers_to_page"]) for r in found)
    digest = [base64.b32encode(hashlib.sha1(x).digest()).decode() for x in (b"0123456789" * 10**7, b"\r\n\r\n" * (5 * 10**6), b"")]
    assert got[:3] == [(0, 10**8, digest[0], None), (1, 2 * 10**7, digest[1], None), (2, 0, digest[2], 3)]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(st.sampled_from("\r\n a:"), max_size=12), max_size=6))
def test_records_come_out_of_any_pieces(blocks):
    archive = b"".join(
        f"WARC/1.1\r\nA: {k}\r\nContent-Length: {len(b)}\r\n\r\n{b}\r\n\r\n".encode() for k, b in enumerate(blocks)
    )
    assert [(h["a"], b.decode()) for h, b in warc.parse(archive)] == [(str(k), b) for k, b in enumerate(blocks)]
    if blocks and blocks[-1]:
        with pytest.raises(ValueError, match="ends within"):
            list(warc.parse(archive[:-5]))


# shards


def test_flow_moves_the_fewest_bytes():
    draw = np.random.default_rng(1)
    for _ in range(30):
        m, n = draw.integers(1, 7, 2)
        old = draw.integers(0, 100, m).tolist()
        new = sharding.even(sum(old), int(n))
        flow = sharding.transfers(old, new)
        assert [sum(b for (i, _), b in flow.items() if i == k) for k in range(m)] == old
        assert all(sum(b for (_, j), b in flow.items() if j == k) <= new[k] for k in range(n))
        stay = sum(min(old[k], new[k]) for k in range(min(m, n)))
        assert sum(b for (i, j), b in flow.items() if i != j) == sum(old) - stay
    with pytest.raises(ValueError):
        sharding.transfers([5], [4])


def placed(df, capacities=16, old=None):
    return sharding.reshard(df, sharding.by_content(F.coalesce("text", F.lit(""))) if old is None else old, capacities)


def test_shards_are_even_and_slots_gapless(documents):
    found = placed(documents).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in documents.collect()}
    assert {r["doc_id"] for r in found} == set(texts) and len(found) == len(texts)
    total, sizes = sum(len(t) + 1 for t in texts.values()), {}
    for r in found:
        assert r["size"] == len(texts[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]])
        sizes.setdefault(r["shard"], []).append((r["slot"], r["size"]))
    assert set(sizes) == set(range(16))
    for pieces in sizes.values():
        assert sorted(s for s, _ in pieces) == list(range(len(pieces)))
    assert max(sum(x for _, x in p) for p in sizes.values()) - total / 16 < max(len(t) for t in texts.values())


def test_resharding_of_edge_rows(edge, odd, empty):
    assert placed(empty).count() == 0
    assert placed(edge).count() == len(plain.edge_rows())
    found = placed(odd, 2).collect()
    assert len(found) == 7
    for s in {r["shard"] for r in found}:
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(sum(r["shard"] == s for r in found)))


def test_only_affected_shards_are_written(spark, tmp_path):
    docs = plain.frame(spark, [(i, "x" * (400 if i < 6 else 100)) for i in range(30)] + [(3, "x" * 400)])
    old = F.when(F.col("doc_id") < 6, F.lit(0)).otherwise(F.lit(1) + F.col("doc_id").cast("int") % 2)
    plan = sharding.reshard(docs, old, [1700, 1300, 2400])
    affected = sharding.rewrite_affected(docs, plan, f"{tmp_path}/shards")
    assert affected == sorted({s for r in plain_moves(plan) for s in r}) and 0 in affected
    back = spark.read.parquet(f"{tmp_path}/shards")
    want = rows(plan.filter(F.col("shard").isin(affected)), "doc_id", "size", "shard", "slot")
    assert rows(back.select("doc_id", (F.length("text") + 1).cast("long").alias("n"), "shard", "slot"), "doc_id", "n", "shard", "slot") == want
    same = sharding.reshard(docs, F.lit(0), [10**6])
    assert sharding.rewrite_affected(docs, same, f"{tmp_path}/none") == []


def plain_moves(plan):
    return [(r["old_shard"], r["shard"]) for r in plan.filter("old_shard <> shard").collect()]


def test_registered_queries_and_sql_agree():
    assert set(queries.ORACLES) <= set(queries.QUERIES)
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))
