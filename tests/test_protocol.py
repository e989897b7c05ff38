"""The synchronisation protocol over generated edits, against direct computation."""

import random

import pytest
from pyspark.sql import functions as F

from symdiff.__main__ import main
from symdiff.operators import protocol


def edited(r, data):
    words = data.split(" ")
    for _ in range(r.choice([0, 1, 3, 12])):
        at = r.randrange(len(words) + 1)
        words[at : at + r.choice([0, 1, 1, 4])] = [f"new{r.randrange(99)}"] * r.choice([0, 1, 2])
    return " ".join(words)


def versions(spark):
    r = random.Random(3)
    old = [(i, " ".join(f"w{r.randrange(60 if i % 2 else 10**6)}é" for _ in range(r.choice([1, 40, 400, 1500])))) for i in range(40)]
    new = [(i, edited(r, t)) for i, t in old]
    old += [(100, "same text " * 300), (101, None), (102, "goes away " * 90), (103, "ab" * 3000)]
    new += [(100, "same text " * 300), (101, "now here " * 200), (102, None), (103, "ab" * 2999 + "ba"), (104, "only new " * 50), (105, "")]
    return old, new, *(spark.createDataFrame(x, "doc_id long, text string") for x in (old, new))


@pytest.mark.parametrize(("average", "overlap", "factor"), [(20, 1, 2), (50, 3, 0.1), (None, None, 2)])
def test_files_are_synchronised(spark, average, overlap, factor):
    old, new, before, after = versions(spark)
    files = protocol.paired(before, after, average, overlap).persist()
    signed = protocol.signed_keys(files).persist()
    told = protocol.exchanged(files, factor, octets=True).persist()
    found = protocol.differences(told)
    sides = {}
    for x in signed.collect():
        sides.setdefault((x.doc_id, x.sign), set()).add(x.key)
    want = {(d, s, k) for d in {d for d, _ in sides} for s, sign in (("A", 1), ("B", -1)) for k in sides.get((d, sign), set()) - sides.get((d, -sign), set())}
    assert {tuple(x) for x in found.collect()} == want and want
    said = protocol.received(protocol.encoded(told)).persist()
    assert sorted(map(str, said.collect())) == sorted(map(str, protocol.round2(told).collect()))
    rows = {x.doc_id: x for x in protocol.rebuilt(files, said).collect()}
    assert {i: bytes(x.content) for i, x in rows.items()} == {i: (t or "").encode() for i, t in new}
    assert all(x.ok for x in rows.values())
    costs = {x.doc_id: x for x in protocol.totals(files, told).collect()}
    assert set(costs) == set(rows) and costs[100].table_bits == 0 and all(x.round2_bits >= 0 for x in costs.values())
    for x in costs.values():
        assert (x.table_octets == 0) == (x.table_bits == 0) and 0 < x.strata_compressed and 20 < x.round2_octets
    for x in said.collect():
        assert sum(x.chunk_exists) == len(x.existing_chunk_encoding) and len(x.chunk_exists) - sum(x.chunk_exists) == len(x.new_chunk_info)
    if average == 20:
        assert sum(len(b) for b in said.where("doc_id = 103").first().new_chunk_info) < 6000
        assert said.select(F.sum(F.size("existing_chunk_encoding"))).first()[0] > 1000


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    files = protocol.paired(empty, empty)
    told = protocol.exchanged(files)
    assert protocol.differences(told).count() == 0 and protocol.rebuilt(files, protocol.round2(told)).count() == 0


def test_command_line(spark, tmp_path, capsys):
    r = random.Random(5)
    old = "".join(r.choice("abc defgh") for _ in range(40_000))
    (tmp_path / "a/sub").mkdir(parents=True)
    (tmp_path / "b/sub").mkdir(parents=True)
    for name, before, after in (("x", old, old[:9000] + "!" + old[9001:]), ("sub/y", "1", "1"), ("sub/z", None, "2")):
        if before is not None:
            (tmp_path / "a" / name).write_text(before)
        (tmp_path / "b" / name).write_text(after)
    rows = {x["path"]: x for x in main(["files", str(tmp_path / "a"), str(tmp_path / "b")], spark)}
    assert set(rows) == {"x", "sub/y", "sub/z"} and all(x["ok"] for x in rows.values()) and rows["x"]["round2_bits"] < 8 * 6000
    (one,) = main(["files", str(tmp_path / "a/x"), str(tmp_path / "b/x"), "--block-size", "100"], spark)
    assert one["ok"] and one["round2_bits"] < 8 * 6000 and one["table_bits"] > 0
    plan = main(["folders", str(tmp_path / "b"), str(tmp_path / "a")], spark)
    assert sorted((x["path"], x["action"]) for x in plan) == [("sub/z", "new"), ("x", "modified")]
    assert '"action": "new"' in capsys.readouterr().out
    for what in (["--error-prob", "0.001"], ["--num-changes", "3"]):
        (row,) = main(["corrupt", "--file-len", "20000", *what], spark)
        assert row["ok"] and row["round2_bits"] < 8 * 20_000
