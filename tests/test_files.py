"""Scans and sinks on small hand-made files."""

import io
import json
import tarfile
import zipfile

from repolith.functions import python as py
from repolith.sources import files, sinks


def test_methods_keep_broken_lines(spark, tmp_path):
    good = {"name": "f", "signature": "int f(int)", "beginLine": 1, "endLine": 2, "filename": "a.c", "modifier": ["STATIC"], "params": [{"name": "x", "type": "int"}], "callees": ["g"]}
    (tmp_path / "methods.jsonl").write_text(json.dumps(good) + "\n{broken\n")
    rows = files.methods(spark, str(tmp_path / "methods.jsonl")).cache()
    assert [r.modifier for r in rows.where("name IS NOT NULL").collect()] == ['["STATIC"]']
    assert files.wrong_lines(rows).count() == 1
    assert files.unwritable(rows.where("name IS NOT NULL")).count() == 0


def test_tags(spark, tmp_path):
    (tmp_path / "tags").write_text("!_TAG\tx\ty\tz\nf\ta.h\t/^f/\tp\ng\ta.c\t/^g/\tf\nf\tb.hpp\t/^f/\tp\n")
    path = str(tmp_path / "tags")
    assert [r.name for r in files.tags(spark, path).collect()] == ["f"]
    assert [r.name for r in files.tags(spark, path, header=False).collect()] == ["g"]


def test_archives(spark):
    def zipped(names):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n in names:
                z.writestr(n, n.encode())
        return out.getvalue()

    def tarred(names):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as t:
            for n in names:
                info = tarfile.TarInfo(n)
                info.size = len(n)
                t.addfile(info, io.BytesIO(n.encode()))
        return out.getvalue()

    rows = spark.createDataFrame([("one.zip", bytearray(zipped(["r/a.c", "r/b/c.c"]))), ("two.zip", bytearray(zipped(["r/a.c", "top.c"]))), ("three.tar", bytearray(tarred(["x/a", "x/b"]))), ("no", bytearray(b"plain"))], "path string, content binary")
    got = sorted((r.archive, r.path) for r in files.archives(rows).collect())
    assert got == [("one.zip", "a.c"), ("one.zip", "b/c.c"), ("three.tar", "a"), ("three.tar", "b"), ("two.zip", "r/a.c"), ("two.zip", "top.c")]


def test_encodings():
    assert py.probe("naïve".encode()) == ("naïve", "utf-8")
    assert py.probe("汉字".encode("gbk")) == ("汉字", "gbk")
    assert py.probe("ab".encode("utf-16"))[0] == "ab"
    assert py.probe(None) == (None, None)


def test_tolerant_json_ladder():
    assert py.tolerant('{"a": 1}') == '{"a": 1}'
    assert py.tolerant('```json\n{"a": 1}\n```') == '{"a": 1}'
    assert py.tolerant('Here: {"a": [1, 2]} done') == '{"a": [1, 2]}'
    assert py.tolerant('{"a": "x\x01y"}') == '{"a": "x y"}'
    assert py.tolerant('{"a": {"b": 1') == '{"a": {"b": 1}}'
    assert py.tolerant("nothing") is None


def test_source_files_and_code(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "tests").mkdir()
    (tmp_path / "src" / "a.rs").write_text("one\ntwo\nthree")
    (tmp_path / "src" / "gbk.rs").write_bytes("汉字".encode("gbk"))
    (tmp_path / "tests" / "b.rs").write_text("x")
    rows = files.source_files(spark, str(tmp_path), (".rs",))
    assert sorted((r.path.rsplit("/", 1)[1], r.encoding) for r in rows.collect()) == [("a.rs", "utf-8"), ("gbk.rs", "gbk")]
    functions = spark.createDataFrame([("f", "lost/a.rs", 2, 9)], "name string, filename string, beginLine int, endLine int")
    assert files.with_code(functions, rows).collect()[0].code == "two\nthree"
    assert files.with_code(functions, rows, clamp=False).collect()[0].code == ""


def test_lock_readme_default(spark, tmp_path):
    (tmp_path / "lock").write_text('[[package]]\nname = "serde"\nversion = "1"\nname = "syn"\n')
    assert sorted(r.package for r in files.lock_packages(spark, str(tmp_path / "lock")).collect()) == ["serde", "syn"]
    rows = spark.createDataFrame([("p/README", "b"), ("p/README.md", "a"), ("q/x.c", "n")], "path string, text string")
    assert [(r.folder, r.text) for r in files.first_readme(rows).collect()] == [("p", "a")]
    empty = rows.where("false")
    assert files.or_default(empty, rows.limit(1)).count() == 1
    assert files.or_default(rows, rows).count() == 3


def test_markdown_and_sinks(spark, tmp_path):
    doc = "### f\n\n#### Description\nDoes it.\n\n### g\nno section\n"
    rows = spark.createDataFrame([(doc,), (None,), ("",)], "text string")
    assert [(r.pos, r.name) for r in files.markdown_docs(rows).collect()] == [(0, "f"), (1, "g")]
    assert [(r.name, r.description) for r in files.repository_modules(rows).collect()] == [("f", "Does it.")]
    qa = spark.createDataFrame([("Q: a?\nA: b\nQ: c?\nA: d",)], "text string")
    assert [(r.question, r.answer) for r in files.qa_pairs(qa).collect()] == [("a?", "b"), ("c?", "d")]
    module = spark.createDataFrame([("m", "About", ["x", "y"], None)], "name string, description string, functions array<string>, example string")
    out = module.select("name", sinks.module_markdown().alias("t"))
    assert "- x\n- y" in out.collect()[0].t
    sinks.write_markdown(out, str(tmp_path / "md"), "name", out.t)
    assert "### m" in "\n".join(r.value for r in spark.read.text(str(tmp_path / "md")).collect())
    sinks.write_jsonl(module, str(tmp_path / "jsonl"))
    assert spark.read.json(str(tmp_path / "jsonl")).count() == 1


def test_last_by_name(spark):
    rows = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new")], "name string, ord int, doc string")
    assert [r.doc for r in files.last_by_name(rows, "name", "ord").collect()] == ["new"]


def test_source_files_below_a_folder_of_a_skipped_name(spark, tmp_path):
    root = tmp_path / "tests" / "repo"
    for path in ("src/a.ts", "tests/b.ts", "node_modules/c.ts", "d.ts"):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text("function go(x) {}\nclass A { run() {} }")
    rows = files.source_files(spark, str(root), (".ts",))
    assert sorted(r.path.split("/repo/")[1] for r in rows.collect()) == ["d.ts", "src/a.ts"]
    assert sorted(r.name for r in files.ts_names(rows).collect()) == ["go", "run"]


def test_filters_of_records(spark):
    rows = spark.createDataFrame([("f", "a.c", ""), ("g", "<empty>", ""), ("h", "<empty>", "x"), (None, "a.c", "y"), ("i", "gone.c", "z")], "signature string, filename string, code string")
    assert sorted(r.signature for r in files.named_rows(rows).collect()) == ["f", "h", "i"]
    assert sorted(r.signature or "" for r in files.present(rows, spark.createDataFrame([("a.c",)], "path string")).collect()) == ["", "f"]
    assert files.complete(rows, ("signature", "code")).count() == 4


def test_markdown_folder(spark, tmp_path):
    (tmp_path / "one.md").write_text("### x\ntext")
    (tmp_path / "two.md").write_text("")
    (tmp_path / "three.txt").write_text("no")
    assert {r.repo: r.text for r in files.markdown_folder(spark, str(tmp_path)).collect()}["one"] == "### x\ntext"
