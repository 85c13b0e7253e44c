"""Lines that many documents share."""

import collections
import time

import plain
import pytest

from adoptlens.llm import lines

BLANK = " \t\n\x0b\x0c\r"


def dropped(rows, least_chars=40, least_documents=5):
    """[(doc_id, n_lines, n_dropped, kept)] of (doc_id, text) by reading every line."""
    holders = collections.defaultdict(set)
    split = [(i, (t or "").split("\n")) for i, t in rows]

    def key(line):
        return line.strip(BLANK).translate(plain.LOW)

    for i, parts in split:
        for line in parts:
            if len(key(line)) >= least_chars:
                holders[key(line)].add(i)
    out = []
    for i, parts in split:
        held = [holders.get(key(x), set()) for x in parts]
        kept = [x for x, h in zip(parts, held) if len(h) < least_documents or max(h, key=lambda d: (d is not None, d)) == i]
        out.append((i, len(parts), len(parts) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def found(df, **more):
    return sorted((tuple(r) for r in lines.drop_lines(df, **more).collect()), key=repr)


COMMON = "A line that is shared, of forty code points or more."
UMLAUT = "ÄÖÜ " * 10 + "x"  # 41 code points, only A-Z is lower-cased


def line_rows():
    rows = [(i, f"{plain.sentence(i, 12)}\n  {COMMON}\t\r\n\n{plain.sentence(i + 50, 3)}\n{COMMON.upper()}") for i in range(1, 7)]
    rows += [(i, UMLAUT + "\n" + "y" * 39 + "\n" + "z" * 40) for i in range(10, 15)]
    rows += [(i, UMLAUT.lower()) for i in range(15, 19)]
    rows += [(20, COMMON), (21, "\n"), (22, COMMON + "\n"), (23, "\x85" + COMMON), (24, "\x0b" + COMMON.lower() + "\x0c")]
    return rows


def test_lines_of_edge_rows(spark):
    rows = line_rows() + [(i - 100, t) for i, t in plain.edge_rows()]
    df = plain.frame(spark, rows).repartition(3)
    want = dropped(rows)
    assert found(df) == want and sum(r[2] for r in want) > 12
    assert found(df, least_chars=1, least_documents=2) == dropped(rows, 1, 2)


def test_rows_that_repeat_an_id_and_rows_without_one(spark):
    rows = [(None, COMMON + "\na"), (None, "b\n" + COMMON), (1, COMMON + "\nc"), (1, COMMON + "\nc"), (1, "d\n" + COMMON)]
    rows += [(2, COMMON), (3, COMMON + "\n" + COMMON), (3, "e"), (None, None), (None, None)]
    df = plain.frame(spark, rows)
    assert found(df) == dropped(rows)  # four documents
    assert found(df, least_documents=4) == dropped(rows, least_documents=4)
    assert sum(r[2] for r in dropped(rows, least_documents=4)) == 6
    only = plain.frame(spark, [(None, COMMON)] * 6)
    assert {r[2] for r in found(only, least_documents=1)} == {0}


def test_empty_table(spark):
    assert found(plain.frame(spark, [])) == []


def test_long_text_takes_linear_time(spark):
    def seconds(n):
        shared = "\n".join(f"{COMMON} {k // 2}" if k % 2 else f"own {k}" for k in range(n))
        df = spark.createDataFrame([(i, f"{shared}\n{i}") for i in range(5)], "doc_id long, text string")
        start = time.perf_counter()
        got = {r[0]: r[1:3] for r in found(df)}
        assert got[0] == (n + 1, n // 2) and got[4] == (n + 1, 0)
        return time.perf_counter() - start

    seconds(2000)
    assert seconds(200_000) < 20 * max(1.0, seconds(20_000))


def test_query_has_no_python_workers(spark, tmp_path):
    from adoptlens.llm import queries

    plain.frame(spark, line_rows()).write.parquet(f"{tmp_path}/documents.parquet")
    df = queries.op13_line_dedup(spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    assert df.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"] and df.count() == len(line_rows())


@pytest.mark.parametrize("text", ["", "\n", "a\n", "\n\na"])
def test_lines_make_up_the_text(spark, text):
    assert found(spark.createDataFrame([(1, text)], "doc_id long, text string"))[0][3] == text
