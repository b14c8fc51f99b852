"""JSON lines through a stream that is stopped, and whose last batch runs again."""

from pyspark.sql.types import LongType, StringType, StructType

from quirefold.streaming import lines

SCHEMA = StructType().add("id", LongType()).add("text", StringType())


def test_a_restart_gives_no_row_twice(spark, tmp_path):
    source, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    source.mkdir()

    def run():
        lines.writing_lines(lines.json_lines(spark, str(source), SCHEMA), str(out), str(state)).trigger(availableNow=True).start().awaitTermination(60)
        return sorted((r["id"], r["text"]) for r in lines.read_lines(spark, str(out), SCHEMA).collect())

    (source / "a.json").write_text('{"id": 1, "text": "one"}\n\n{"id": 2, "text": null, "more": 5}\n{"id": 3, "te\n   \n')
    assert run() == [(1, "one"), (2, None)]
    (source / "b.json").write_text('{"id": 4, "text": "four"}\nnot json\n{"text": "none", "id": 9}\n')
    expected = [(1, "one"), (2, None), (4, "four"), (9, "none")]
    assert run() == expected and run() == expected
    # As after a failure between the files and the mark that the batch is done.
    commits = sorted(p for p in (state / "commits").iterdir() if p.name.isdigit())
    assert len(commits) == 2
    for p in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        p.unlink(missing_ok=True)
    assert run() == expected
    assert sorted(r["value"] for r in spark.read.text(f"{out}/damaged/batch=*").collect()) == ["not json", '{"id": 3, "te']
