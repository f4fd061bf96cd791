"""Scalar functions against their golden cases."""

from pyspark.sql import functions as F

from repolith.functions import python as py
from repolith.functions import scalar as s


def value(spark, column, **row):
    names = list(row)
    data = spark.createDataFrame([tuple(row.values())], ", ".join(f"{n} {'array<string>' if isinstance(row[n], list) else 'string'}" for n in names))
    return data.select(column.alias("v")).first().v


def test_types(spark):
    assert value(spark, s.trim_c_type("t"), t="const char *[16]") == "char"
    assert value(spark, s.trim_ts_type("t"), t="Promise<Map<string, Foo>>[] | null") == "Promise"
    assert value(spark, s.trim_ts_type("t"), t="string | Foo") == "Foo"
    assert value(spark, s.trim_ts_type("t"), t="A<B<C<D<E<F<G>>>>>>[ ]") == "A"
    assert value(spark, s.trim_ts_type("t"), t="x < Foo") == "Foo"
    for basic in ("string", "String", "Unknown[]", ""):
        assert value(spark, s.trim_ts_type("t"), t=basic) is None
    assert value(spark, s.strip_resource("t", s.F.lit("x")), t="resource/x/a.rs") == "a.rs" and value(spark, s.strip_resource("t", s.F.lit("x")), t="resource/y/a.rs") == "y/a.rs"
    assert sorted(value(spark, s.ts_function_names("t"), t="function  go(a) {}\nclass A {\n  run() {}\n  two() {}\n}")) == ["go", "run"]
    assert value(spark, s.retryable("t", s.F.lit(None).cast("int")), t="ReadTimeout") and not value(spark, s.retryable("t", s.F.lit(500)), t="LLMDeadlineExceeded")
    assert value(spark, s.trim_rust_type("t"), t="&mut Vec<u8>") == "Vec"


def test_texts(spark):
    assert value(spark, s.prefix_lines("t", "> "), t="a\nb") == "> a\n> b\n"
    assert value(spark, s.prefix_lines("t", "> "), t="") == ""
    assert value(spark, s.dedented("t"), t="  a // x\n\n    b") == "a\n  b"
    assert value(spark, s.fences_off("t"), t="```json\n{}\n```") == "{}"
    assert value(spark, s.calls_in("t"), t="f(x); g!(y) f(z)") == ["f", "g"]
    assert value(spark, s.section("t", "Description"), t="### f\n#### Description\nabc\n#### Other\nx") == "abc"
    assert value(spark, s.section("t", "Missing"), t="### f") is None
    assert value(spark, s.is_likely_function("t"), t="MAX_SIZE") is False
    assert value(spark, s.is_likely_function("t"), t="run_all") is True
    assert value(spark, s.type_kind(F.col("t")), t=["FIELD", "VARIANT"]) == "enum"


def test_names(spark):
    assert value(spark, s.next_patch("t"), t="1.2.9") == "1.2.10"
    assert value(spark, s.next_patch("t"), t="v1") == "1.0.1"
    assert value(spark, s.safe_name("t"), t="a b/c") == "a_b_c"
    assert value(spark, s.safe_name("t"), t="  ") == "unnamed"
    assert value(spark, s.url_stem("t"), t="https://h.com/x/repo.git?z=1") == "repo"
    assert value(spark, s.ordinals("t"), t="1, 4, x") == [1, 4]
    assert value(spark, s.ordinals("t"), t="- 3. foo") == [3]


def test_headers():
    text = "### f\n#### Descr\na\n#### Param\nb"
    assert py.rename_headers(text, ["Description", "Parameters"]).count("#### Description") == 1
    assert py.rename_headers(text + "\n#### Code Details\nc", ["Code Detail", "Descr"]).startswith("### f\n#### Descr\n")
    assert py.rename_headers(None, ["x"]) is None
    assert py.html_to_text("<p>a<b>c</b></p><script>x</script> d &amp; e") == "a c d & e"


def test_code_synthesis(spark):
    row = spark.sql("SELECT 'C' AS name, array(struct('x' AS name, 'int' AS type, 'public' AS access)) AS f, array(struct('void g()' AS signature, 'private' AS access)) AS m")
    out = row.select(s.class_code("name", F.col("f"), F.col("m")).alias("c"), s.class_code("name", F.col("f"), F.col("m"), True).alias("e"), s.rust_code("name", F.col("f"), F.col("m")).alias("r")).first()
    assert out.c == "class C {\npublic:\n  int x;\nprivate:\n  void g();\n};" and out.e == ""
    assert out.r == "struct C {\n    x: int,\n}\n\nimpl C {\n    void g();\n}"


def test_doc_comments(spark):
    text = "Does it.\n# Parameters\n* `a`: first\n- `b` - second\n# Examples\n```rust\nrun();\n```\n# Errors\nnone"
    assert value(spark, s.doc_examples("t"), t=text) == ["run();"]
    assert value(spark, s.doc_section("t", "Errors"), t=text) == "none"
    assert value(spark, s.doc_fields("t", "Parameters"), t=text) == {"a": "first", "b": "second"}
    assert value(spark, s.derives("t"), t="#[derive(Debug, Clone)] #[derive(Clone)]") == ["Debug", "Clone"]
    loc = value(spark, s.source_location("t"), t="../src/a/b.rs.html#12-14")
    assert (loc.file, loc.line) == ("a/b.rs", 12)
    assert value(spark, s.crate_of("t"), t="serde::de::X") == "serde"
    assert value(spark, s.error_style("t"), t="x.unwrap()") == "panic"
    assert value(spark, s.labelled(name=F.col("t"), gone=F.lit(None).cast("string")), t="x") == "Name: x"


def test_rustdoc():
    html = '<h3><code>pub struct Foo</code></h3><div class="docblock"><p>A foo.</p></div><h4><code>pub fn run(x: u8)</code></h4><div class="docblock">Runs <div>it</div></div>'
    assert [(i["kind"], i["name"], i["doc"]) for i in py.rustdoc(html)] == [("type", "Foo", "A foo."), ("function", "run", "Runs it")]
    assert py.rustdoc(None) == [] and py.is_doc_page("a/struct.Foo.html") and not py.is_doc_page("a/index.html")
