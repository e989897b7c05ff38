"""Line de-duplication against brute force."""

import collections
import random

import pytest

from symdiff.llm import lines

WHITE = " \t\n\v\f\r"


def lowered(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)


def brute_force(rows, min_chars, min_docs):
    key = lambda line: lowered(line.strip(WHITE))
    holders = collections.defaultdict(set)
    for i, text in rows:
        if i is not None:
            for line in (text or "").split("\n"):
                if len(key(line)) >= min_chars:
                    holders[key(line)].add(i)
    out = []
    for i, text in rows:
        all_lines = (text or "").split("\n")
        kept = [x for x in all_lines if not (i is not None and len(holders.get(key(x), ())) >= min_docs and i < max(holders[key(x)]))]
        out.append((i, "\n".join(kept), len(all_lines), len(all_lines) - len(kept)))
    return sorted(out, key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, id int, h1 string")
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in lines.line_dedup(df, **options).collect()), key=str)


EDGES = [
    (1, None), (2, ""), (3, "\n\n"), (None, "a line that many documents hold, again"), (None, None),
    (4, "A line that many documents HOLD, again\nother"), (5, " a line that many documents hold, again\t\r\n"),
    (6, "a line that many documents hold, again\na line that many documents hold, again\nx"),
    (7, "ÀÉ a line that differs in letters that aren't A-Z\n漢字漢字漢字漢字漢字漢字漢字漢字漢字漢"), (8, "àé a line that differs in letters that aren't A-Z"),
    (9, "漢字漢字漢字漢字漢字漢字漢字漢字漢字漢字"), (10, "漢字漢字漢字漢字漢字漢字漢字漢字漢字漢字"), (11, "漢字漢字漢字漢字漢字漢字漢字漢字漢字漢字\nend"),
    (12, "held by one id in three rows, so by one document"), (12, "held by one id in three rows, so by one document"), (12, "held by one id in three rows, so by one document\n"),
    (13, "held by one id in three rows, so by one document"),
    (14, "only white space inside:    isn't stripped "), (15, "x\x1c" * 12), (16, "no line end " * 9000),
]


def test_edges(spark):
    assert run(spark, EDGES) == brute_force(EDGES, 20, 3)
    assert run(spark, []) == []
    assert run(spark, [(None, None), (1, None)]) == brute_force([(None, None), (1, None)], 20, 3)


@pytest.mark.parametrize(("batches", "min_chars", "min_docs"), [(1, 20, 3), (4, 5, 2), (7, 12, 4)])
def test_random_tables_match_brute_force(spark, batches, min_chars, min_docs):
    """More batches than a level holds, so runs are compacted; hot lines; rows that repeat ids."""
    rng = random.Random(batches)
    pool = ["".join(rng.choices("abcdE é\t", k=rng.randint(0, 26))) for _ in range(60)]
    rows = [(rng.choice([None, *range(80)]), "\n".join(rng.choices(pool, weights=[1 / (k + 1) for k in range(60)], k=rng.randint(0, 12)))) for _ in range(150)]
    assert run(spark, rows, batches=batches, min_chars=min_chars, min_docs=min_docs) == brute_force(rows, min_chars, min_docs)


def test_a_key_is_in_one_run_only(spark):
    runs = lines.LineRuns(spark, fanout=2)
    for k in range(5):
        runs.add(spark.createDataFrame([(i, 0, 100 * k + i) for i in range(4 * k, 4 * k + 8)], "h1 long, h2 long, id long"))
        held = [r.h1 for run in runs.runs() for r in run.collect()]
        assert len(held) == len(set(held)) == 4 * k + 8
        assert all(len(level) < 2 for level in runs.levels)
    assert sorted(tuple(r) for r in runs.frequent(2).collect()) == [(i, 0, 100 * (i // 4) + i) for i in range(4, 20)]
    plan = runs.runs()[0].join(runs.runs()[-1].hint("merge"), lines.KEY)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
