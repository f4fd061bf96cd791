"""Queries for scalar functions, projections and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from repolith.functions import python as py
from repolith.functions import scalar as s
from repolith.plans.base import FUNCTIONS, MARKDOWN, functions, markdown, query, table
from repolith.sources import files


@query(f"WITH {FUNCTIONS} SELECT signature, filename, left(code, 5000) AS code, CASE WHEN length(code) > 5000 THEN left(code, 5000) || chr(10) || '...' ELSE code END AS shown FROM fn")
def function_projection(spark, d):
    f = functions(spark, d)
    return f.select("signature", "filename", F.substring("code", 1, 5000).alias("code"), s.truncated("code", 5000).alias("shown"))


@query(f"""WITH {FUNCTIONS} SELECT signature, CASE WHEN modifier LIKE '%PRIVATE%' THEN 'private' WHEN modifier LIKE '%PROTECTED%' THEN 'protected' ELSE 'public' END AS access,
  CASE WHEN lang IN ('en', 'de') THEN visible AND modifier NOT LIKE '%STATIC%' WHEN lang = 'fr' THEN modifier LIKE '%PUBLIC%' ELSE TRUE END AS visible FROM fn""")
def access_and_visibility(spark, d):
    lang = F.when(F.col("lang").isin("en", "de"), "c").when(F.col("lang") == "fr", "rust").otherwise("js")
    return functions(spark, d).select("signature", s.access("modifier").alias("access"), s.visible(lang, "modifier", F.col("visible")).alias("visible"))


@query("SELECT p_partkey, trim(regexp_replace('const ' || p_type || ' *[' || p_size || ']', '[*&]|(\\[\\d*\\])|const|volatile|restrict', '', 'g')) AS c_type, trim(string_split(replace(replace('&mut ' || p_brand || '<' || p_type || '>', '&', ''), 'mut ', ''), '<')[1]) AS rust_type FROM part")
def type_names(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", s.trim_c_type(F.concat(F.lit("const "), "p_type", F.lit(" *["), "p_size", F.lit("]"))).alias("c_type"), s.trim_rust_type(F.concat(F.lit("&mut "), "p_brand", F.lit("<"), "p_type", F.lit(">"))).alias("rust_type"))


@query("""SELECT * FROM (VALUES ('src/main.rs', 'crate'), ('src/lib.rs', 'crate'), ('src/utils/mod.rs', 'crate::utils'), ('src/parser/ast.rs', 'crate::parser::ast')) t(path, module)""")
def module_paths(spark, d):
    rows = spark.createDataFrame([("src/main.rs",), ("src/lib.rs",), ("src/utils/mod.rs",), ("src/parser/ast.rs",)], "path string")
    return rows.select("path", s.module_path("path").alias("module"))


@query("""SELECT * FROM (VALUES ('&str', 'str'), ('&mut String', 'String'), ('Vec<String>', 'Vec'), ('std::collections::HashMap', 'HashMap'), ('''a str', 'str')) t(type, name)""")
def clean_types(spark, d):
    rows = spark.createDataFrame([("&str",), ("&mut String",), ("Vec<String>",), ("std::collections::HashMap",), ("'a str",)], "type string")
    return rows.select("type", s.clean_type_name("type").alias("name"))


@query("""SELECT * FROM (VALUES ('src/tests/mod.rs', TRUE), ('tests/integration.rs', TRUE), ('src/lib_test.rs', TRUE), ('src/lib.rs', FALSE), ('src/parser.rs', FALSE)) t(path, test)""")
def test_paths(spark, d):
    rows = spark.createDataFrame([("src/tests/mod.rs",), ("tests/integration.rs",), ("src/lib_test.rs",), ("src/lib.rs",), ("src/parser.rs",)], "path string")
    return rows.select("path", s.is_test_path("path").alias("test"))


@query(f"""WITH {FUNCTIONS} SELECT signature, 'int ' || signature || '(' || lang || ', ' || filename || ')' AS formatted FROM fn""")
def signature_format(spark, d):
    params = F.array(F.struct(F.col("lang").alias("type")), F.struct(F.col("filename").alias("type")))
    return functions(spark, d).select("signature", s.signature(F.lit("int"), F.col("signature"), params).alias("formatted"))


@query(f"""WITH {FUNCTIONS} SELECT signature, array_to_string(string_split(code, chr(10))[2:3], chr(10)) AS lines, CASE WHEN len(string_split(code, chr(10))) < 3 THEN '' ELSE array_to_string(string_split(code, chr(10))[2:3], chr(10)) END AS strict,
  CASE WHEN code = '' THEN '' ELSE '> ' || replace(code, chr(10), chr(10) || '> ') || chr(10) END AS quoted FROM fn""")
def line_slices(spark, d):
    f, two, three = functions(spark, d), F.lit(2), F.lit(3)
    return f.select("signature", s.line_range(F.col("code"), two, three).alias("lines"), s.line_range(F.col("code"), two, three, False).alias("strict"), s.prefix_lines("code", "> ").alias("quoted"))


@query("SELECT page_id, url, regexp_replace(string_split(regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', ''), '/+$', ''), '/')[-1], '\\.[^.]*$', '') AS stem, COALESCE(nullif(regexp_replace(trim(url), '[^A-Za-z0-9._-]', '_', 'g'), ''), 'unnamed') AS safe, left(sha1(url), 8) AS digest FROM pages")
def url_names(spark, d):
    return table(spark, d, "pages").select("page_id", "url", s.url_stem("url").alias("stem"), s.safe_name("url").alias("safe"), s.digest8("url").alias("digest"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, props IS NOT NULL AND json_valid(props) AS valid, regexp_replace(props, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', ' ', 'g') AS clean FROM events")
def json_lines(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), F.coalesce(F.try_parse_json("props").isNotNull(), F.lit(False)).alias("valid"), s.scrubbed("props").alias("clean"))


@query("""SELECT event_id, '{"k": ' || json_extract_string(props, '$.k') || '}' AS fenced, '{"k": ' || json_extract_string(props, '$.k') || '}' AS open FROM events""")
def tolerant_json(spark, d):
    e = table(spark, d, "events")
    bare = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"))
    return e.select("event_id", py.tolerant_json(F.concat(F.lit("Result:\n```json\n"), bare, F.lit("}\n```\n"))).alias("fenced"), py.tolerant_json(bare).alias("open"))


@query("SELECT o_orderkey, '1.' || (o_orderkey % 7) || '.' || o_orderkey AS version, '1.' || (o_orderkey % 7) || '.' || (o_orderkey + 1) AS up, '1.0.1' AS broken FROM orders")
def semver_patch(spark, d):
    v = F.concat(F.lit("1."), F.col("o_orderkey") % 7, F.lit("."), F.col("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", v.alias("version"), s.next_patch(v).alias("up"), s.next_patch(F.concat(F.lit("v"), v)).alias("broken"))


@query("SELECT s_suppkey, s_nationkey || ',' || (s_nationkey + 1) AS numbers, CAST(s_nationkey AS VARCHAR) AS dotted FROM supplier")
def ordinal_lines(spark, d):
    n, text = F.col("s_nationkey"), lambda x: F.array_join(x.cast("array<string>"), ",")
    return table(spark, d, "supplier").select("s_suppkey", text(s.ordinals(F.concat(n, F.lit(", "), n + 1, F.lit(", x")))).alias("numbers"), text(s.ordinals(F.concat(F.lit("- "), n, F.lit(". "), "s_name"))).alias("dotted"))


@query("SELECT p_partkey, 'let ' || p_brand || ' = ' || p_size || ';' AS line, CAST(p_size AS VARCHAR) AS value, p_brand AS quoted, CASE p_size % 4 WHEN 0 THEN 'macro' WHEN 1 THEN 'generic' WHEN 2 THEN 'associated' ELSE 'function' END AS call FROM part")
def code_text(spark, d):
    name = F.expr("CASE p_size % 4 WHEN 0 THEN 'println!' WHEN 1 THEN 'Vec::<u8>::new' WHEN 2 THEN 'Vec::new' ELSE 'run' END")
    line = F.concat(F.lit("let "), "p_brand", F.lit(" = "), "p_size", F.lit(";"))
    return table(spark, d, "part").select("p_partkey", line.alias("line"), s.constant_value(line).alias("value"), s.quoted(F.concat(F.lit('name = "'), "p_brand", F.lit('"'))).alias("quoted"), s.call_type(name).alias("call"))


@query(f"""WITH {FUNCTIONS}, l AS (SELECT signature, list_filter(list_transform(string_split('    // note' || chr(10) || '    ' || regexp_replace(code, '[.] +', '; // why' || chr(10) || '      ', 'g'), chr(10)),
  lambda x: rtrim(regexp_replace(x, '//.*$', ''))), lambda x: trim(x) <> '') AS lines FROM fn)
SELECT signature, COALESCE(array_to_string(list_transform(lines, lambda x: substr(x, CAST(list_min(list_transform(lines, lambda y: length(y) - length(ltrim(y)))) + 1 AS INTEGER))), chr(10)), '') AS body FROM l""")
def dedented_code(spark, d):
    """Texts as code: a sentence a line, indented, with comments."""
    code = F.concat(F.lit("    // note\n    "), F.regexp_replace("code", "[.] +", "; // why\n      "))
    return functions(spark, d).select("signature", s.dedented(code).alias("body"))


@query(f"""WITH {MARKDOWN}, x AS (SELECT conv_id, unnest(string_split(chr(10) || text, chr(10) || '### ')[2:]) AS b FROM md)
SELECT conv_id, trim(string_split(b, chr(10))[1]) AS name, nullif(trim(string_split(string_split(b, '#### Description' || chr(10))[2], '####')[1], ' ' || chr(10)), '') AS description, 'first,' || string_split(b, ' ')[1] AS items FROM x""")
def markdown_blocks(spark, d):
    rows = files.markdown_docs(markdown(spark, d), keep=("conv_id",))
    description = F.nullif(F.trim(s.section("block", "Description"), F.lit(" \n")), F.lit(""))
    return rows.select("conv_id", "name", description.alias("description"), F.array_join(s.bullets(s.section("block", "Parameters")), ",").alias("items"))


@query(f"""WITH {MARKDOWN}, x AS (SELECT conv_id, unnest(string_split(chr(10) || text, chr(10) || '### ')[2:]) AS b FROM md),
n AS (SELECT conv_id, COUNT(*) AS modules, SUM(len(string_split(b, chr(10) || '#### ')) - 1) AS headers FROM x WHERE contains(b, chr(10) || '#### Description') GROUP BY conv_id)
SELECT conv_id, modules, CAST(headers AS BIGINT) AS headers FROM n""")
def repository_documents(spark, d):
    md = markdown(spark, d)
    modules = files.repository_modules(md, keep=("conv_id",)).groupBy("conv_id").agg(F.count(F.lit(1)).alias("modules"))
    headers = md.select("conv_id", F.regexp_count("text", F.lit(r"(?m)^#### ")).cast("long").alias("headers"))
    return modules.join(headers, "conv_id")


@query("SELECT page_id, length(html) AS n_html, contains(html, '<') AS tagged FROM pages")
def html_pages(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.length("html").cast("long").alias("n_html"), F.contains("html", F.lit("<")).alias("tagged"))
    return rows


@query()
def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", py.html_text("html").alias("text"))


@query()
def header_renames(spark, d):
    rename = py.renamed(["Description", "Arguments"])
    return markdown(spark, d).select("conv_id", rename("text").alias("text"))


@query("SELECT doc_id, text, CASE WHEN text IS NULL THEN NULL WHEN doc_id % 3 = 1 AND text <> '' THEN 'utf-16' ELSE 'utf-8' END AS encoding FROM documents")
def encodings(spark, d):
    """Texts from bytes; every third is UTF-16 with a byte order mark."""
    data = F.when(F.col("doc_id") % 3 == 1, F.encode("text", "UTF-16")).otherwise(F.col("text").cast("binary"))
    rows = table(spark, d, "documents").select("doc_id", py.decoded(data).alias("r"))
    return rows.select("doc_id", "r.text", "r.encoding")
