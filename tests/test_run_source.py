"""Records of many runs as one table and as a stream."""

import json

import pytest

from lodestar.sources import run_source

SCHEMA = "record_id long, score struct<hit:boolean,share:double>, ids array<string>"


def line(i, **more):
    return json.dumps({"record_id": i, "score": {"hit": i % 2 == 0, "share": i / 4}, "ids": [f"é{i}"], **more}, ensure_ascii=False)


@pytest.fixture
def root(tmp_path):
    for name in ("a", "b", "empty", "late", "_tmp"):
        (tmp_path / name).mkdir()
    # no line end at the end, a blank line, a field of no column, lacking fields
    (tmp_path / "a/records.jsonl").write_text("\n".join([line(1), "  ", line(2, other=[1, {"x": 2}]), '{"record_id": 3}', '{"ids": null}']))
    (tmp_path / "b/records.jsonl").mkdir()
    (tmp_path / "b/records.jsonl/part-0.json").write_text(line(1) + "\n")
    (tmp_path / "b/records.jsonl/part-1.json").write_text("")
    (tmp_path / "b/records.jsonl/_SUCCESS").write_text("")
    (tmp_path / "empty/records.jsonl").write_text("")
    (tmp_path / "_tmp/records.jsonl").write_text("no json")
    return tmp_path


def found(df):
    return sorted(((r["run"], r["record_id"]) for r in df.collect()), key=str)


def test_all_runs(spark, root):
    df = run_source.read_runs(spark, f"file://{root}", SCHEMA)
    assert df.columns == ["run", "record_id", "score", "ids"]
    assert found(df) == [("a", 1), ("a", 2), ("a", 3), ("a", None), ("b", 1)]
    got = {(r["run"], r["record_id"]): r for r in df.collect()}
    assert got["a", 2]["score"].asDict() == {"hit": True, "share": 0.5} and got["a", 2]["ids"] == ["é2"]
    assert got["a", 3]["score"] is None and got["a", None]["ids"] is None
    assert run_source.read_runs(spark, f"file:{root}", SCHEMA).select("ids").count() == 5


def test_named_runs(spark, root):
    df = run_source.read_runs(spark, {"new=1": f"{root}/b", "old": f"file://{root}/a", "none": f"{root}/late"}, SCHEMA)
    assert df.groupBy("run").count().orderBy("run").collect() == [("new=1", 1), ("old", 4)]


def test_only_some_runs(spark, root):
    (root / "late/records.jsonl").write_text("no json at all\n")  # read, it would fail
    only = lambda *names: run_source.read_runs(spark, str(root), SCHEMA, only=list(names))
    assert found(only("b")) == [("b", 1)] and found(only("a", "none").where("record_id > 1")) == [("a", 2), ("a", 3)]
    assert only().count() == 0
    with pytest.raises(Exception, match="JSON"):
        only("b", "late").count()


def test_filters_hold_for_one_scan_only(spark, root):
    df = run_source.read_runs(spark, str(root), SCHEMA)
    b = df.where("run = 'b'")
    assert (b.count(), df.count(), b.union(df.where("run = 'a'")).union(df).count()) == (1, 5, 10)


@pytest.mark.parametrize("split", [1, 7, 50, 64, 1000])
def test_every_line_is_read_once(split, tmp_path, monkeypatch):
    text = "".join(line(i) + "\n" * (1 + i % 3) for i in range(40))
    file = tmp_path / "records.jsonl"
    file.write_text(text)
    monkeypatch.setattr(run_source, "SPLIT", split)
    monkeypatch.setattr(run_source, "BLOCK", 100)
    blocks = [b for p in run_source._parts("a", str(file), 0, len(text.encode())) for b in run_source._blocks(p)]
    assert [json.loads(x)["record_id"] for b in blocks for x in b.splitlines()] == list(range(40))


def test_stream_takes_what_is_appended(spark, root, tmp_path_factory):
    out, state = (f"file://{tmp_path_factory.mktemp(x)}" for x in ("out", "state"))
    schema = f"run string, {SCHEMA}"
    file = root / "a/records.jsonl"
    file.write_text(line(1) + "\n" + line(2)[:9])  # the second line isn't complete

    def run():
        df = run_source.read_runs(spark, str(root), SCHEMA, stream=True)
        df.writeStream.format("json").option("path", out).option("checkpointLocation", state).start().processAllAvailable()
        for q in spark.streams.active:
            q.stop()
        return found(spark.read.schema(schema).json(out))

    assert run() == [("a", 1), ("b", 1)]
    file.write_text("".join(line(i) + "\n" for i in (1, 2, 3)))
    (root / "late/records.jsonl").write_text(line(9) + "\n")
    assert run() == [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("late", 9)]
    assert run() == [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("late", 9)]


def test_a_schema_is_needed(spark, root):
    run_source.read_runs(spark, str(root), SCHEMA)
    with pytest.raises(Exception, match="name the columns"):
        spark.read.format("runs").load(str(root)).collect()
