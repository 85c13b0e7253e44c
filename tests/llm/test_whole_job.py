"""The whole job of the corpus operators, on what a shortcut would leave out."""

import glob
import re
import zlib

import numpy as np
import corpus_pipeline
import plain
import pytest
from pyspark.sql import functions as F

from adoptlens import session
from adoptlens.llm import fingerprints, mixing, packing, queries, sharding, token_files, tokens

SPECIAL = [
    "one text <|endoftext|> another", "<|startoftext|>", "a<|endoftext|>b <|endoftext|>. <|ENDOFTEXT|>", "<|ENDOFTEXT|> x",
    "H̱a T̈. W̊ Y̊ J̌", "T̴̈", "Å I’m <|endoftext|", "plain words, only.", None, "",
]


@pytest.fixture
def library():
    """The library as it is loaded, nothing set."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_path())


def ids_of(library, text):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")


def test_texts_have_the_unaltered_library_s_ids(library):
    flat, lengths = tokens.encoder(tokens.vocabulary_path()).encode(SPECIAL)
    at = 0
    for text, n in zip(SPECIAL, lengths.tolist(), strict=True):
        assert flat[at : at + n].tolist() == ids_of(library, text).tolist(), text
        at += n
    assert at == len(flat) and flat[:4].tolist() == [637, 4160, 49407, 1380]


def test_token_files_and_pieces_hold_special_tokens(spark, library, tmp_path):
    table = plain.frame(spark, list(enumerate(SPECIAL)))
    token_files.write_tokens(table, f"{tmp_path}/t")
    start = 0
    for r, text in zip(token_files.read_tokens(spark, f"{tmp_path}/t").orderBy("doc_id").collect(), SPECIAL, strict=True):
        ids = ids_of(library, text)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    for r in packing.pack(table).collect():
        ids = ids_of(library, SPECIAL[r["doc_id"]])
        assert (r["start"], r["length"], r["ids_crc32"]) == (0, len(ids), zlib.crc32(ids.tobytes()))


def test_short_texts_have_fingerprints(spark):
    texts = [plain.sentence(seed, n) for n in range(1, 13) for seed in range(1, 30)]
    texts += [plain.sentence(seed, 9).replace(" ", "\u3042") for seed in range(30, 40)] + ["日本語の文字列です", "日本語の文字列だよ"]
    table = plain.frame(spark, list(enumerate(texts))).select("text")
    found = fingerprints.with_anchors(table, "text", "a").select("text", fingerprints.fingerprint(F.col("a")).alias("f")).collect()
    holes = {}
    for text, got in found:
        anchors = [h for _, h in plain.syncmers(text)]
        if not anchors:  # no k-mer is one: all tokens together
            parts = re.findall(r"[\u3040-\u30ff\u4e00-\u9fff]|[^\s\u3040-\u30ff\u4e00-\u9fff]{1,24}", text)
            assert 7 <= len(parts) <= 10
            anchors = [(plain._hash(" ".join(parts)) % 2**64) >> 32]
            holes[text] = got
        assert got == "".join(f"{h:08x}" for h in dict.fromkeys(anchors)) != ""
    assert len(holes) > 20 and len(set(holes.values())) == len(holes)


def test_resharding_writes_shards_and_reads_them_back(spark, tmp_path):
    docs = plain.edge_rows() + plain.odd_rows() + [(None, None)] * 300 + [(7, "same")] * 50
    plain.frame(spark, docs).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    with_files = set(glob.glob(f"{session.shared_root(spark)}/adoptlens/shards-*"))
    found = queries.op9_resharding(spark, str(tmp_path)).collect()
    raw = [(i, (t or "").encode()) for i, t in docs]
    want = sorted(((i, len(b) + 1, zlib.crc32(b)) for i, b in raw), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in found), key=repr) == want
    for s in {r["shard"] for r in found}:
        slots = sorted(r["slot"] for r in found if r["shard"] == s)
        assert slots == list(range(len(slots)))
    made = set(glob.glob(f"{session.shared_root(spark)}/adoptlens/shards-*")) - with_files
    (old,) = (p for p in made if "shards-old" in p)
    (new,) = (p for p in made if "shards-new" in p)
    stored = spark.read.parquet(old).collect()
    key = lambda r: (r["doc_id"], r["text"])
    assert sorted(map(key, stored), key=repr) == sorted(docs, key=repr)
    by = lambda rows, s, name: sorted((r["doc_id"] or 0, r["text"] or "") for r in rows if r[name] == s)
    moved = {s for r in found if r["shard"] != r["old_shard"] for s in (r["shard"], r["old_shard"])}
    written = spark.read.parquet(new).collect()
    assert {r["shard"] for r in written} <= moved and moved
    for r in spark.read.parquet(new).select("old_shard").distinct().collect():
        # what an affected shard had is in the new files, row by row
        assert by(written, r[0], "old_shard") == by(stored, r[0], "shard")


def test_untouched_shards_stay_and_copies_are_numbered_in_ranges(spark, tmp_path):
    texts = [(None, None)] * 400 + [(i, "y" * (i % 7)) for i in range(200)] + [(5, None)] * 3
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    old, new = f"{tmp_path}/old", f"{tmp_path}/new"
    sharding.write_shards(docs, F.when(F.col("doc_id").isNull(), 0).otherwise(1 + F.col("doc_id") % 2), old)
    stored = sharding.read_shards(spark, old, docs.schema)
    sizes = {r[0]: r[1] for r in stored.groupBy("shard").agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 1)).collect()}
    plan = sharding.reshard(stored, F.col("shard"), [sizes[0] - 150, sizes[1], sizes[2], 200])
    affected = sharding.rewrite_affected(stored.drop("shard"), plan, new)
    assert affected == [0, 3]
    found = sharding.layout(spark, docs.schema, old, new, affected)
    columns = ("doc_id", "size", "text_crc32", "old_shard", "shard", "slot")
    got, wanted = (sorted((tuple(r) for r in df.select(*columns).collect()), key=repr) for df in (found, plan))
    assert got == wanted and len(got) == len(texts)
    numbered = sharding._numbered(docs.select(F.coalesce("doc_id", F.lit(0)).alias("k"), F.monotonically_increasing_id().alias("m")), ["k"], [F.col("m")])
    most = numbered.filter("k = 0").agg(F.max("__copy"), F.count("*"), F.count_distinct("__copy")).first()
    assert tuple(most) == (400, 401, 401)


def test_language_stage_keeps_texts_without_a_model(spark):
    letters = [(i, t) for i, t in plain.edge_rows() if any(c.isalpha() for c in t or "")]
    table = plain.frame(spark, plain.edge_rows()).withColumn("lang", F.lit(None).cast("string"))
    found = corpus_pipeline.identify_language(spark, table, "")
    assert found.columns == table.columns
    assert sorted((r["doc_id"], r["text"], r["lang"]) for r in found.collect()) == sorted((*r, None) for r in letters)


def test_language_found_takes_effect(spark, tmp_path):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 4 == 2][:6]
    en, xx = "the house of the men is where they think", "zxqy qqxz yzzq xyxq zqqy"
    rows = [(held[0], en, "en"), (held[1], xx, "xx"), (held[2], en + " the men", None), (held[3], xx + " yzzq", None), (held[4], "12 !", None), (held[5], None, "en")]
    table = spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    told = corpus_pipeline.identify_language(spark, table, "")
    assert {r["doc_id"]: r["lang"] for r in told.collect()} == {held[0]: "en", held[1]: "xx", held[2]: "en", held[3]: "xx"}
    rows_ = mixing.mix(told, F.col("source"), F.col("lang"), F.lit("none"), mixing.words(F.col("text")), F.lit(0.0), mixing.POWERS)
    assert {r["mix"]["lang"] for r in rows_.collect()} == {"en", "xx"}
