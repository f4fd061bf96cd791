"""Queries for classes, modules and statistics. Suppliers are classes, the parts that they deliver their fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from repolith.functions import scalar as s
from repolith.operators import code, lookup
from repolith.plans.base import FUNCTIONS, functions, query, table
from repolith.plans.lifecycle import valid_profiles


def _classes(spark, d):
    return table(spark, d, "supplier").select(F.concat(F.lit("Supplier"), "s_suppkey").alias("signature"), F.concat(F.lit("Nation"), "s_nationkey").alias("name"), F.col("s_suppkey").alias("ord"))


_TYPE = """CASE l_partkey % 5 WHEN 0 THEN 'const Supplier' || (l_partkey % 100) || ' *' WHEN 1 THEN 'Supplier' || (l_partkey % 100) WHEN 2 THEN '&mut Supplier' || (l_partkey % 100) || '<T>'
  WHEN 3 THEN 'Nation' || (l_partkey % 25) || '<Map<K, V>>[]' ELSE 'String' END"""
_FIELDS = f"fields AS (SELECT DISTINCT 'Supplier' || l_suppkey AS src, {_TYPE} AS type FROM lineitem), classes AS (SELECT 'Supplier' || s_suppkey AS signature, 'Nation' || s_nationkey AS name, s_suppkey AS ord FROM supplier)"


def _fields(spark, d):
    return table(spark, d, "lineitem").select(F.concat(F.lit("Supplier"), "l_suppkey").alias("src"), F.expr(_TYPE).alias("type")).distinct()


@query(f"WITH {_FIELDS} SELECT DISTINCT src, signature AS dst FROM (SELECT src, trim(regexp_replace(type, '[*&]|\\[\\d*\\]|const|volatile|restrict', '', 'g')) AS t FROM fields) JOIN classes ON t = signature")
def field_edges_c(spark, d):
    return code.field_edges(_fields(spark, d), _classes(spark, d), "c")


@query(f"WITH {_FIELDS} SELECT DISTINCT src, signature AS dst FROM (SELECT src, trim(string_split(replace(replace(type, '&', ''), 'mut ', ''), '<')[1]) AS t FROM fields) JOIN classes ON t = signature WHERE src <> signature")
def field_edges_rust(spark, d):
    return code.field_edges(_fields(spark, d), _classes(spark, d), "rust")


@query(f"""WITH {_FIELDS}, f AS (SELECT name, min_by(signature, ord) AS dst FROM classes GROUP BY name), b AS (SELECT src, regexp_replace(regexp_replace(regexp_replace(type, '\\[\\s*\\]', '', 'g'), '<[^<>]*>', '', 'g'), '<[^<>]*>', '', 'g') AS t FROM fields)
SELECT DISTINCT src, dst FROM b JOIN f ON regexp_extract(t, '([A-Z][A-Za-z0-9_]*)', 1) = f.name WHERE src <> dst""")
def field_edges_ts(spark, d):
    return code.field_edges(_fields(spark, d), _classes(spark, d), "ts")


@query(f"""WITH {_FIELDS}, c AS (SELECT signature, signature AS name FROM classes) SELECT DISTINCT src, type AS dst FROM fields WHERE type IN (SELECT signature FROM c)
  AND trim(regexp_replace(type, '[*&]|\\[\\d*\\]|const|volatile|restrict', '', 'g')) IN (SELECT name FROM c)""")
def field_edges_js(spark, d):
    return code.field_edges(_fields(spark, d), _classes(spark, d).withColumn("name", F.col("signature")), "js")


@query("""WITH p AS (SELECT 'Supplier' || l_suppkey AS src, unnest(['Supplier' || (l_suppkey + l_linenumber), 'Base' || l_linenumber]) AS dst FROM lineitem)
SELECT DISTINCT src, dst FROM p WHERE dst IN (SELECT DISTINCT 'Supplier' || l_suppkey FROM lineitem)""")
def inheritance_edges(spark, d):
    parents = F.flatten(F.collect_set(F.array(F.concat(F.lit("Supplier"), F.col("l_suppkey") + F.col("l_linenumber")), F.concat(F.lit("Base"), "l_linenumber"))))
    return code.inheritance_edges(table(spark, d, "lineitem").groupBy(F.concat(F.lit("Supplier"), "l_suppkey").alias("signature")).agg(parents.alias("parents")))


@query("""WITH o AS (SELECT o_orderkey AS signature, list(DISTINCT l_linenumber::VARCHAR) AS params FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber > 1 GROUP BY 1),
x AS (SELECT signature, unnest(CASE WHEN params = [NULL] THEN [] ELSE params END) AS name FROM o)
SELECT o.o_orderkey AS signature, CASE WHEN o.o_orderkey % 3 = 0 THEN o.o_orderpriority END AS doc_comment,
 COALESCE((SELECT string_agg(name || '=' || CASE WHEN o.o_orderkey % 3 = 0 AND name IN ('2', '4') THEN o.o_orderstatus || name ELSE '?' END, ',' ORDER BY name) FROM x WHERE x.signature = o.o_orderkey AND name IS NOT NULL), '') AS params FROM orders o""")
def documented_functions(spark, d):
    """Orders as functions, their lines beyond the first as parameters; every third is documented, with two of the parameters."""
    o = table(spark, d, "orders")
    names = table(spark, d, "lineitem").where("l_linenumber > 1").groupBy(F.col("l_orderkey").alias("signature")).agg(F.array_sort(F.collect_set(F.col("l_linenumber").cast("string"))).alias("names"))
    params = F.transform(F.coalesce("names", F.array().cast("array<string>")), lambda n: F.struct(n.alias("name")))
    rows = o.select(F.col("o_orderkey").alias("signature")).join(names, "signature", "left").select("signature", params.alias("params"))
    told = F.array(*(F.struct(F.lit(n).alias("name"), F.concat("o_orderstatus", F.lit(n)).alias("description")) for n in ("2", "4")))
    docs = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("signature"), F.col("o_orderpriority").alias("doc_comment"), told.alias("params"))
    shown = F.array_join(F.transform("params", lambda p: F.concat(p["name"], F.lit("="), F.coalesce(p["description"], F.lit("?")))), ",")
    return code.with_member_docs(rows, docs, "signature", "params").select("signature", "doc_comment", shown.alias("params"))


@query(f"""WITH {FUNCTIONS}, t AS (SELECT conv_id, list(CASE WHEN role = 'user' AND turn % 2 = 1 THEN 'VARIANT' WHEN role = 'assistant' THEN 'TRAIT_METHOD' ELSE 'FIELD' END) AS a FROM conversations GROUP BY 1),
k AS (SELECT CASE WHEN list_contains(a, 'VARIANT') THEN 'enum' WHEN list_contains(a, 'TRAIT_METHOD') THEN 'trait' ELSE 'struct' END AS kind, len(a) AS n FROM t),
f AS (SELECT modifier, n_chars % 4 AS params, n_chars % 9 AS callees FROM fn)
SELECT (SELECT COUNT(*) FROM f) AS total_methods, (SELECT COUNT(*) FROM f WHERE modifier LIKE '%PUBLIC%') AS public_methods, (SELECT COUNT(*) FROM f WHERE modifier LIKE '%PRIVATE%') AS private_methods,
 (SELECT COUNT(*) FROM f WHERE modifier LIKE '%ASYNC%') AS async_methods, (SELECT COUNT(*) FROM f WHERE modifier LIKE '%UNSAFE%') AS unsafe_methods, (SELECT AVG(params) FROM f) AS avg_method_params,
 (SELECT CAST(MAX(callees) AS INTEGER) FROM f) AS max_call_depth, COUNT(*) AS total_types, COUNT(*) FILTER (kind = 'struct') AS struct_count, COUNT(*) FILTER (kind = 'enum') AS enum_count, COUNT(*) FILTER (kind = 'trait') AS trait_count, AVG(n) AS avg_type_attributes FROM k""")
def code_statistics(spark, d):
    several = lambda n: F.array_repeat(F.lit("x"), (F.col("n_chars") % n).cast("int"))
    f = functions(spark, d).select("modifier", several(4).alias("params"), several(9).alias("callees"))
    mark = F.expr("CASE WHEN role = 'user' AND turn % 2 = 1 THEN 'VARIANT' WHEN role = 'assistant' THEN 'TRAIT_METHOD' ELSE 'FIELD' END")
    return code.statistics(f, table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(mark.alias("modifier"))).alias("attributes")))


@query(f"""WITH {FUNCTIONS}, f AS (SELECT 'src/' || lang || '/' || filename AS filename, signature AS name, modifier FROM fn WHERE lang IS NOT NULL AND filename IS NOT NULL),
i AS (SELECT replace(regexp_replace(filename, '^src/(.*)\\.c$', '\\1'), '/', '::') AS path, CASE WHEN modifier LIKE '%PUBLIC%' THEN name END AS item FROM f
  UNION ALL SELECT CASE WHEN s_nationkey % 2 = 0 THEN 'en' ELSE 'root' END, s_name FROM supplier),
m AS (SELECT path, COALESCE(list_sort(list(item) FILTER (item IS NOT NULL)), []) AS items FROM i GROUP BY path),
c AS (SELECT regexp_extract(path, '^(.*)::', 1) AS path, list_sort(list(string_split(path, '::')[-1])) AS subs FROM m WHERE contains(path, '::') GROUP BY 1)
SELECT path, string_split(path, '::')[-1] AS name, array_to_string(items, ',') AS public_items, COALESCE(array_to_string(subs, ','), '') AS submodules FROM m LEFT JOIN c USING (path)""")
def module_tree(spark, d):
    f = functions(spark, d).where("lang IS NOT NULL AND filename IS NOT NULL").select(F.concat(F.lit("src/"), "lang", F.lit("/"), "filename").alias("filename"), F.col("signature").alias("name"), "modifier")
    t = table(spark, d, "supplier").select(F.when(F.col("s_nationkey") % 2 == 0, F.concat(F.lit("en::"), "s_name")).otherwise(F.col("s_name")).alias("fullname"), F.col("s_name").alias("name"))
    return code.module_rollup(f, t).select("path", "name", F.array_join("public_items", ",").alias("public_items"), F.array_join("submodules", ",").alias("submodules"))


@query("""WITH dr AS (SELECT o_orderkey AS draft, o_custkey AS cluster, o_orderkey AS pos, CASE WHEN o_orderkey % 11 > 0 THEN 'M' || o_orderkey END AS name, CASE o_orderkey % 3 WHEN 0 THEN '[to do]' WHEN 1 THEN '' ELSE o_orderpriority END AS description FROM orders),
l AS (SELECT l_orderkey AS draft, list(l_partkey::VARCHAR ORDER BY l_linenumber, l_partkey) AS fs FROM lineitem GROUP BY 1),
r AS (SELECT dr.*, COALESCE(fs, []) AS fs FROM dr LEFT JOIN l USING (draft)),
u AS (SELECT cluster, pos, unnest(range(len(fs))) AS i, unnest(fs) AS f FROM r), v AS (SELECT cluster, f, min((pos, i)) AS spot FROM u GROUP BY 1, 2), w AS (SELECT cluster, string_agg(f, ',' ORDER BY spot) AS functions FROM v GROUP BY 1),
g AS (SELECT cluster, arg_max({'name': name, 'd': description}, (len(fs), -pos)) AS rep, string_agg(description, chr(10) || chr(10) ORDER BY pos) FILTER (description <> '' AND description NOT LIKE '[%') AS told FROM r GROUP BY 1)
SELECT g.cluster, COALESCE(rep.name, 'Module_' || (g.cluster + 1)) AS name, COALESCE(told, rep.d) AS description, COALESCE(functions, '') AS functions FROM g LEFT JOIN w USING (cluster)""")
def merged_modules(spark, d):
    """Orders as drafts of modules, their parts as functions, customers as clusters."""
    o = table(spark, d, "orders")
    fs = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("draft")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string")).alias("functions"))
    drafts = o.select(F.col("o_orderkey").alias("draft"), F.expr("CASE WHEN o_orderkey % 11 > 0 THEN concat('M', o_orderkey) END").alias("name"), F.expr("CASE o_orderkey % 3 WHEN 0 THEN '[to do]' WHEN 1 THEN '' ELSE o_orderpriority END").alias("description")).join(fs, "draft", "left")
    clusters = o.select(F.col("o_custkey").alias("cluster"), F.col("o_orderkey").alias("pos"), F.col("o_orderkey").alias("draft"))
    return code.merge_clusters(clusters, drafts).withColumn("functions", F.array_join("functions", ","))


@query("SELECT s_nationkey AS community, array_to_string(list_sort(list(s_suppkey)), ',') AS apis FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49) GROUP BY 1")
def community_apis(spark, d):
    apis = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("node"))
    found = code.communities_of(table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("community")), apis)
    return found.select("community", F.array_join(F.col("apis").cast("array<string>"), ",").alias("apis"))


@query("SELECT doc_id, CASE WHEN starts_with(f, 'resource/' || source || '/') THEN substr(f, length(source) + 11) WHEN starts_with(f, 'resource/') THEN substr(f, 10) ELSE f END AS filename FROM (SELECT doc_id, source, CASE doc_id % 3 WHEN 0 THEN 'resource/' || source || '/' || lang WHEN 1 THEN 'resource/' || lang ELSE source || '/' || lang END AS f FROM documents)")
def stripped_files(spark, d):
    f = F.expr("CASE doc_id % 3 WHEN 0 THEN concat('resource/', source, '/', lang) WHEN 1 THEN concat('resource/', lang) ELSE concat(source, '/', lang) END")
    return table(spark, d, "documents").select("doc_id", s.strip_resource(f, "source").alias("filename"))


@query("SELECT c_custkey AS profile FROM customer WHERE c_mktsegment <> 'HOUSEHOLD'")
def usable_profiles(spark, d):
    status = F.when(F.col("c_mktsegment") == "HOUSEHOLD", "failed").otherwise("succeeded")
    return valid_profiles(table(spark, d, "customer").select(F.col("c_custkey").alias("profile"), status.alias("status"))).select("profile")


@query("""WITH i AS (SELECT o_custkey % 25 AS module, o_orderstatus AS type, o_orderkey AS ord, o_orderpriority AS m FROM orders), b AS (SELECT 'm' || module || '::' || type AS fullname, string_agg(m, ',' ORDER BY ord) AS methods FROM i GROUP BY 1),
t AS (SELECT 'm' || n_nationkey || '::' || k AS fullname FROM nation, (SELECT unnest(['F', 'O', 'X']) AS k)) SELECT fullname, COALESCE(methods, '') AS methods FROM t LEFT JOIN b USING (fullname)""")
def impl_methods(spark, d):
    o = table(spark, d, "orders")
    impls = o.select(F.concat(F.lit("m"), F.col("o_custkey") % 25).alias("module"), F.col("o_orderstatus").alias("type"), F.col("o_orderkey").alias("ord"), F.array("o_orderpriority").alias("methods"))
    types = table(spark, d, "nation").select(F.explode(F.array(*(F.concat(F.lit("m"), "n_nationkey", F.lit(f"::{k}")) for k in "FOX"))).alias("fullname"))
    return code.impl_methods(types, impls).withColumn("methods", F.array_join("methods", ","))


@query("SELECT 'Supplier' || l_suppkey AS class, l_partkey AS signature FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def class_members(spark, d):
    methods = table(spark, d, "lineitem").select(F.concat(F.lit("Supplier"), "l_suppkey").alias("class"), F.col("l_partkey").alias("signature"))
    return code.known_methods(methods, table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("signature"))).select("class", "signature")


@query("SELECT p_partkey AS signature FROM part WHERE p_size % 3 <> 0 OR p_size % 2 <> 0")
def non_empty_classes(spark, d):
    some = lambda n: F.array_repeat(F.lit("x"), (F.col("p_size") % n).cast("int"))
    return code.non_empty(table(spark, d, "part").select(F.col("p_partkey").alias("signature"), some(3).alias("fields"), some(2).alias("functions"))).select("signature")


@query("""WITH a AS (SELECT l_partkey AS signature, list_sort(list(DISTINCT l_suppkey::VARCHAR)) AS own FROM lineitem GROUP BY 1), c AS (SELECT DISTINCT p_partkey AS signature, unnest([p_size::VARCHAR, '1']) AS callee FROM part)
SELECT signature, array_to_string(list_sort(list_distinct(own || COALESCE((SELECT list(callee) FROM c WHERE c.signature = a.signature), []))), ',') AS callees FROM a""")
def callees_of_both(spark, d):
    """Callees as two front ends see them, each once."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("signature")).agg(F.collect_set(F.col("l_suppkey").cast("string")).alias("callees"))
    calls = table(spark, d, "part").select(F.col("p_partkey").alias("caller"), F.explode(F.array(F.col("p_size").cast("string"), F.lit("1"))).alias("callee"))
    return lookup.merge_callees(rows, calls).select("signature", F.array_join(F.array_sort("callees"), ",").alias("callees"))
