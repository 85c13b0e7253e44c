"""``corpus_pipeline.run`` over small tables, each stage against plain Python."""

import glob
import hashlib

import corpus_pipeline
import plain
import pytest
from pyspark.sql import functions as F

from adoptlens import session
from adoptlens.llm import mixing, tokens

LABELS = [(1, 1, 0), (4, 0, 0), (9, 1, 1), (13, 0, 0), (13, 1, 0), (16, 1, 0), (None, 1, 1)]


def run(spark, folder, rows):
    """(documents in, {stage: rows it wrote})."""
    table = plain.frame(spark, rows).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "yy").otherwise(F.col("lang")))
    table = table.withColumn("lang", F.when(F.coalesce(F.col("doc_id") % 5 != 0, F.lit(True)), F.col("lang")))
    table.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    root = f"{session.shared_root(spark)}/adoptlens"
    before = set(glob.glob(f"{root}/stage-*"))
    result = corpus_pipeline.run(spark, str(folder)).collect()
    paths = set(glob.glob(f"{root}/stage-*")) - before
    out = {}
    for name, _ in corpus_pipeline.STAGES:
        (path,) = [p for p in paths if f"/stage-{name}-" in p]
        out[name] = spark.read.parquet(path).collect() if glob.glob(f"{path}/*.parquet") else []
    same(result, out["packing"])
    return table.collect(), out


def same(found, wanted):
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, wanted), key=repr)


def mixed(rows):
    """Raking and sampling, cell by cell."""
    labels = {}
    for i, quality, toxic in LABELS:
        q, t = labels.get(i, (1, 0))
        labels[i] = (min(q, quality), max(t, toxic))
    topic = lambda i: "none" if i is None or i not in labels else "toxic" if labels[i][1] else "good" if labels[i][0] else "plain"
    cell = lambda r: (r["source"], r["lang"], topic(r["doc_id"]))
    natural = {}
    for r in rows:
        natural[cell(r)] = natural.get(cell(r), 0) + len(plain.words_of(r["text"]))
    total = sum(natural.values())
    weight = {c: n / total for c, n in natural.items()}

    def share(values, d, c):
        return sum(v for k, v in values.items() if k[d] == c)

    powers = [mixing.POWERS[d] for d in mixing.DIMENSIONS]
    for _ in range(200):
        for d, power in enumerate(powers):
            kinds = {c[d] for c in natural}
            wanted = {k: share(natural, d, k) ** power for k in kinds}
            now = {k: share(weight, d, k) for k in kinds}
            weight = {c: w * wanted[c[d]] / sum(wanted.values()) / now[c[d]] for c, w in weight.items()}
    ratio = {c: weight[c] / natural[c] for c in natural}

    def number(r):
        name = hashlib.md5(r["text"].encode()).hexdigest() if r["doc_id"] is None else str(r["doc_id"])
        return int(hashlib.md5(name.encode()).hexdigest()[:13], 16) / 16**13

    return [r for r in rows if number(r) < ratio[cell(r)] / max(ratio.values())]


@pytest.mark.parametrize("more", [[], [(None, plain.sentence(8, 50)), (None, None), (None, "Word"), (3, plain.sentence(1, 120)), (77, "12 3")]])
def test_every_stage_agrees_with_plain_python(spark, tmp_path, more):
    docs, found = run(spark, tmp_path, plain.edge_rows() + more)

    # languages: what has a letter stays; a given label stays, a missing one is filled
    kept = [r for r in docs if any(c.isalpha() for c in r["text"] or "")]
    told = found["language_id"]
    blank = lambda rows: [tuple(r[c] for c in docs[0].asDict() if c != "lang") for r in rows]
    same(blank(told), blank(kept))
    given = {(r["doc_id"], r["text"]): r["lang"] for r in docs}
    for r in told:
        assert r["lang"] in ("xx", "yy") and given[r["doc_id"], r["text"]] in (None, r["lang"])

    # exact copies: the largest id of equal texts, once
    best = {}
    for r in told:
        key = r["text"].translate(plain.LOW)
        best[key] = max(best.get(key), r["doc_id"], key=lambda i: -(2**63) if i is None else i)
    want = {(i, key) for key, i in best.items()}
    got = [(r["doc_id"], r["text"].translate(plain.LOW)) for r in found["exact_dedup"]]
    same(got, want)
    assert {tuple(r) for r in found["exact_dedup"]} <= {tuple(r) for r in told}

    # near copies: the smallest id of each component of pairs
    rows = found["exact_dedup"]
    stays = plain.near_survivors([(r["doc_id"], r["text"]) for r in rows], corpus_pipeline.WORDS, corpus_pipeline.PERCENT)
    same(found["near_dedup"], [rows[k] for k in stays])
    assert len(found["near_dedup"]) < len(found["exact_dedup"]) < len(told)

    same(found["mixing"], mixed(found["near_dedup"]))
    assert 0 < len(found["mixing"]) < len(found["near_dedup"])

    # packing: every id of every document once, in windows without gaps
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.vocabulary_path())
    sizes = {r["doc_id"]: len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in found["mixing"]}
    windows = {}
    for r in found["packing"]:
        assert r["doc_tokens"] == sizes[r["doc_id"]]
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, n in sizes.items():
        at = 0
        for start, length in sorted((r["start"], r["length"]) for r in found["packing"] if r["doc_id"] == i):
            assert start == at
            at += length
        assert at == n
    for pieces in windows.values():
        ends = [0]
        for offset, n in sorted(pieces):
            assert offset == ends[-1]
            ends.append(offset + n)
        assert ends[-1] <= 4096


def test_near_stage_keeps_one_row_of_each_group(spark):
    rows = plain.odd_rows() + [(5, "a b c d e f"), (5, "A  b c d e f"), (6, "a b c d e f"), (7, None), (7, "")]
    found = corpus_pipeline.drop_near_copies(spark, plain.frame(spark, rows), "")
    assert found.columns == plain.frame(spark, []).columns
    got = sorted(((r["doc_id"], r["text"]) for r in found.collect()), key=repr)
    base = plain.sentence(1, 120)
    tied = [r for r in got if r[0] == 5]
    assert len(tied) == 1 and tied[0][1] in ("a b c d e f", "A  b c d e f")
    want = [(None, None), (None, plain.sentence(8, 50)), (1, base), (1, plain.sentence(9, 60)), (7, None), (7, ""), *tied]
    assert got == sorted(want, key=repr)


def test_run_of_an_empty_table(spark, tmp_path):
    _, found = run(spark, tmp_path, [])
    assert found == {name: [] for name, _ in corpus_pipeline.STAGES}


def test_weights_of_the_mix_move_without_texts(spark, tmp_path, monkeypatch):
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen, mix = plain.frame(spark, plain.odd_rows()), [], mixing.mix

    def watched(rows, source, lang, topic, weight, *more):
        cells = rows.groupBy(source, lang, topic).agg(F.sum(weight))
        seen.append(cells._jdf.queryExecution().optimizedPlan().toString())
        return mix(rows, source, lang, topic, weight, *more)

    monkeypatch.setattr(mixing, "mix", watched)
    found = corpus_pipeline.mix_sources(spark, docs, str(tmp_path))
    assert found.columns == docs.columns
    (plan,) = seen
    joined = plan.index("Join LeftOuter")
    assert "text" not in plan[:joined] and "text" in plan[joined:]
