"""Results that must not depend on NULLs, short inputs, restarts or early stops."""

import datetime as dt
import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from adoptlens.functions.arrays import with_running_sums
from adoptlens.operators import adoption, chunking, corpus, diagnostics, expectations, intervals, metrics, scoring
from adoptlens.operators.metrics import Measure, Metric
from adoptlens.operators.passages import passage_occurrences, passage_spans
from adoptlens.operators.ranking import global_rank, running_total
from adoptlens.plans import evidence
from adoptlens.sources import store
from adoptlens.streaming import ingest
from test_telemetry import beat, lines, request


def walk(proposals, budget):
    """(rank, start, end, end before the cut) by walking proposals in rank order."""
    taken, used, out = set(), 0, []
    for rank, a, b in sorted(proposals):
        free = [p for p in range(a, b) if p not in taken]
        while free and used < budget:
            start = end = free.pop(0)
            end += 1
            while free and free[0] == end:
                end = free.pop(0) + 1
            size = min(end - start, budget - used)
            out.append((rank, start, start + size, end))
            used += size
        taken.update(range(a, b))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_deferred_ends_are_those_of_the_owner_s_piece(spark, seed):
    rng = random.Random(seed)
    cases = {0: ([(1, 0, 100), (2, 30, 60), (3, 0, 100)], 20)}
    for c in range(1, 40):
        rows = [(r, a, a + rng.randint(1, 25)) for r, a in enumerate(rng.randint(0, 60) for _ in range(rng.randint(1, 9)))]
        cases[c] = (rows, rng.randint(1, 40))
    rows = [(c, r, a, b, n) for c, (ps, n) in cases.items() for r, a, b in ps]
    df = spark.createDataFrame(rows, "k int, rank int, start long, end long, n int")
    got = sorted(tuple(x) for x in intervals.budget_context(df, ["k"], "n", 8).select("k", "rank", "start", "end", "deferred_end").collect())
    assert got == sorted((c, *x) for c, (ps, n) in cases.items() for x in walk(ps, n))
    assert [x for x in got if x[0] == 0] == [(0, 1, 0, 20, 100)]


def test_union_of_runs_that_pass_through_many_buckets(spark):
    spans = [(1, 0, 100), (1, 10, 12), (1, 100, 105), (1, 107, 108), (1, 108, 200), (1, 300, 301), (2, 5, 500), (2, 80, 90), (None, 1, 2), (None, 2, 30)]
    got = intervals.interval_union(spark.createDataFrame(spans, "k int, start long, end long"), ["k"], 8)
    want = [(1, 0, 105), (1, 107, 200), (1, 300, 301), (2, 5, 500), (None, 1, 30)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_null_scores_rank_last_and_null_groups_are_groups(spark):
    rows = [(None, 1, 5.0), (None, 2, None), ("a", 1, None), ("a", 2, 1.0), ("a", 3, None), ("a", 4, 9.0)]
    df = spark.createDataFrame(rows, "g string, k int, s double")
    got = global_rank(df, "s", "k", by=["g"]).select("g", "k", "row_number", "average_rank").collect()
    want = {(None, 1): (1, 1.0), (None, 2): (2, 2.0), ("a", 4): (1, 1.0), ("a", 2): (2, 2.0), ("a", 1): (3, 3.5), ("a", 3): (4, 3.5)}
    assert {(r["g"], r["k"]): (r["row_number"], r["average_rank"]) for r in got} == want
    total = running_total(global_rank(df, "s", "k", by=["g"]), "k", "row_number", by=["g"])
    assert {(r["g"], r["row_number"]): r["running"] for r in total.collect()}[("a", 4)] == 10


def test_a_long_tail_does_not_fill_one_range(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") == 7, F.lit(1e15)).otherwise(F.col("id") % 997).alias("s"))
    got = {r["id"]: r["row_number"] for r in global_rank(df, "s", "id").collect()}
    want = sorted(range(5000), key=lambda i: (-(1e15 if i == 7 else i % 997), i))
    assert got == {i: n for n, i in enumerate(want, 1)}


def test_null_groups_of_two_facts_share_a_row(spark):
    one = spark.createDataFrame([(None, 1), ("a", 2)], "g string, x int")
    two = spark.createDataFrame([(None, 5), ("b", 6)], "g string, y int")
    named = {"m1": Metric("m1", Measure("one", F.sum("x"))), "m2": Metric("m2", Measure("two", F.sum("y")))}
    got = metrics.evaluate(list(named.values()), {"one": one, "two": two}, ["g"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(None, 1, 5), ("a", 2, None), ("b", None, 6)], key=str)


def test_a_null_group_has_its_own_adoption(spark):
    lawyers = spark.createDataFrame([(1, None, True), (2, None, True), (3, "g", True)], "lawyer_id int, office string, is_active boolean")
    sessions = spark.createDataFrame([(1, dt.date(2024, 1, 3))], "lawyer_id int, activity_date date")
    got = adoption.adoption_by_group(sessions, lawyers, ["office"]).select("office", "lawyers", "active_lawyers").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 2, 1), ("g", 1, 0)], key=str)


def test_a_new_checkpoint_keeps_what_is_stored(spark, tmp_path):
    kept = ingest.EventStore(str(tmp_path / "store"))
    assert kept.ingest(lines(spark, [beat("a"), beat("b")]), 0) == "success"
    assert kept.ingest(lines(spark, [beat("c"), request("r", "r")]), 0) == "success"
    assert kept.log(spark).count() == 4
    assert kept.ledger(spark).count() == 2
    # a retry is the same batch again
    assert kept.ingest(lines(spark, [beat("c"), request("r", "r")]), 0) == "success"
    assert kept.log(spark).count() == 4 and kept.ledger(spark).count() == 2


def test_only_a_missing_path_is_an_empty_store(spark, tmp_path):
    assert store.read_if_exists(spark, str(tmp_path / "none"), "a int").count() == 0
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "part-0.parquet").write_text("not a table")
    with pytest.raises(Exception) as error:
        store.read_if_exists(spark, str(tmp_path / "other"), "a int").count()
    assert not (isinstance(error.value, AnalysisException) and error.value.getCondition() == "PATH_NOT_FOUND")


def test_the_run_log_keeps_the_whole_message(spark, tmp_path):
    def fail():
        raise ValueError("x" * 5000)

    with pytest.raises(ValueError):
        store.run_logged(spark, str(tmp_path / "log"), "job", "{}", fail)
    assert len(spark.read.parquet(str(tmp_path / "log")).first()["message"]) == 5000


def test_short_passages_are_found(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight"), (2, "two"), (3, "nothing here")], "document_id long, text string")
    passages = spark.createDataFrame([(1, "o"), (2, "two three"), (3, "two three four"), (4, "one two three four five six"), (5, "wo three f")], "item_id long, text string")
    got = sorted((r["item_id"], r["document_id"], r["answer_start"]) for r in evidence.passage_matches(passages, docs).collect())
    texts = {r["document_id"]: r["text"] for r in docs.collect()}
    want = [(p["item_id"], i, t.index(p["text"])) for p in passages.collect() for i, t in texts.items() if p["text"] in t]
    assert got == sorted(want)


def test_every_place_of_every_passage_is_masked(spark):
    texts = {1: "aa aa aa aa, b aa aa aa", 2: "  lead one two\tthree four five one two\tthree", 3: "none", 4: "", 5: "x1 aab two\tthr"}
    passages = {1: "aa aa aa", 2: "one two\tthree", 3: "a", 4: "", 5: "wo\tthr", 6: "one two\tthree four five one", 7: " lead one two"}
    docs = spark.createDataFrame(list(texts.items()), "document_id long, text string")
    asked = spark.createDataFrame(list(passages.items()), "item_id long, text string")
    found = passage_occurrences(asked, docs)
    got = sorted((r["item_id"], r["document_id"], r["start"]) for r in found.collect())
    want = [(i, d, s) for i, p in passages.items() for d, t in texts.items() for s in range(len(t)) if p and t.startswith(p, s)]
    assert got == sorted(want) and len(want) > 20
    masked = {r["document_id"]: r["text"] for r in corpus.mask_spans(docs, passage_spans(found)).collect()}
    for d, t in texts.items():
        gone = {s + k for i, e, s in want if e == d for k in range(len(passages[i]))}
        assert masked[d] == "".join("X" if k in gone and not c.isspace() else c for k, c in enumerate(t))
    none = spark.createDataFrame([], "item_id long, text string")
    assert passage_occurrences(none, docs).count() == 0


def test_failed_queries_are_rows(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, " \n\x1c"), (3, "-- .. !"), (4, "")], "document_id long, text string")
    tasks = [("a", 1, "words"), ("b", 1, "?!"), ("c", 2, "words"), ("d", 3, "words"), ("e", 9, "words"), ("f", 4, "words"), ("g", 1, None)]
    tasks = spark.createDataFrame(tasks, "case_id string, document_id long, query string")
    got = {r["case_id"]: (r["status"], r["error_type"]) for r in scoring.retrieval_states(tasks, docs).collect()}
    empty, error = ("error", "empty_document"), "error"
    assert got == {
        "a": ("ok", None), "b": (error, "invalid_query"), "c": empty, "d": (error, "empty_vocabulary"),
        "e": (error, "unknown_document"), "f": empty, "g": (error, "invalid_query"),
    }


def test_an_unknown_value_meets_no_expectation(spark):
    names = [r[0] for r in expectations.RANGES]
    values = [(names[0], 20.9), (names[1], 2.0), (names[3], 12.0), (names[10], None), (names[12], 0.75), (names[16], 0.0)]
    got = {r["check"]: r["ok"] for r in expectations.judged(spark.createDataFrame(values, "check string, value double")).collect()}
    assert [got[n] for n, _ in values] == [True, True, False, False, False, True]


def test_a_short_stratum_is_an_error(spark):
    docs = spark.createDataFrame([(i, "p", "w " * i) for i in range(1, 9)], "document_id long, partition string, text string")
    assert corpus.stratified_select(docs, {"p": [1, 1, 1, 1]}, "s").count() == 4
    with pytest.raises(ValueError):
        corpus.stratified_select(docs, {"p": [1, 1, 1, 5]}, "s")
    assert corpus.stratified_select(docs, {"p": [1, 1, 1, 5]}, "s", allow_short=True).count() == 5


def test_copies_are_all_left_out(spark):
    docs = spark.createDataFrame([(1, "A b"), (2, "a  B"), (3, "c"), (4, "d")], "document_id long, text string")
    assert sorted(r["document_id"] for r in corpus.dedupe_documents(docs).collect()) == [3, 4]


def test_running_sums(spark):
    df = spark.createDataFrame([(1, list(range(1000))), (2, [7]), (3, [])], "k int, v array<int>")
    got = {r["k"]: r["s"] for r in with_running_sums(df, F.col("v"), F.lit(5), "s").collect()}
    want, total = [5], 5
    for v in range(1000):
        total += v
        want.append(total)
    assert got == {1: want, 2: [5, 12]}


def test_windows_of_a_long_text(spark):
    text = " ".join(f"w{i}" for i in range(20_000))
    got = chunking.chunk(spark.createDataFrame([(1, text)], "document_id long, text string"), 60, 13).orderBy("chunk_no").collect()
    step = 47
    starts = [0] + [text.index(f"w{i} ") if i < 19_999 else text.index(f"w{i}") for i in range(step, 20_000, step)][: len(got) - 1]
    assert [r["start"] for r in got] == starts
    assert got[-1]["end"] == len(text) and all(text[r["start"] : r["end"]] == r["chunk_text"] for r in got)


def _diagnosed(spark):
    """Case x finds half of its region, case y has no answer."""
    docs = spark.createDataFrame([(1, "aaaa bbbb cccc dddd")], "document_id int, text string")
    tasks = [("x", 1, "c1", "bbbb zzz"), ("y", 1, "c2", "eeee")]
    tasks = spark.createDataFrame(tasks, "case_id string, document_id int, category string, query string")
    gold = spark.createDataFrame([("x", 5, 9), ("x", 9, 14)], "case_id string, start long, end long")
    spans = "case_id string, rank int, start long, end long"
    ranked = spark.createDataFrame([("x", 1, 0, 9), ("x", 2, 10, 19), ("y", 1, 0, 9)], spans)
    context = spark.createDataFrame([("x", 1, 0, 9), ("y", 1, 0, 9)], spans)
    return gold, context, ranked, tasks, docs, 9


def _operators(df):
    return len(df._jdf.queryExecution().optimizedPlan().toString().splitlines())


def test_regions_are_settled_before_they_are_joined(spark):
    found = diagnostics.region_diagnostics(*_diagnosed(spark))
    (r,) = [x.asDict() for x in found.collect()]
    assert r == {
        "case_id": "x", "start": 5, "end": 14, "covered_characters": 4, "best_overlapping_chunk_rank": 1, "query_terms_in_region": ["bbbb"],
        "missing_fragments": 1, "missing_characters": 5, "shares_reached_window_boundary": True,
    }
    # a plan that holds every union of intervals has hundreds, and planning it fills the driver
    assert _operators(found) < 40


def test_case_features_are_counted_over_settled_cases(spark):
    cases = diagnostics.case_diagnostics(*_diagnosed(spark))
    assert _operators(cases) < 60
    (x, y) = [r.asDict() for r in cases.orderBy("case_id").collect()]
    assert (x["gold_characters"], x["missing_gold_characters"], x["missing_in_budget_cut"], x["incomplete_regions"]) == (9, 5, 0, 1)
    assert (y["is_answerable"], y["context_characters"], y["gold_regions"]) == (False, 9, 0)
    (r,) = diagnostics.failure_features(cases).collect()
    assert tuple(r) == (2, 1, 1, 0, 0, 0, 1, 1, 0, 1)
