"""Queries for lookups, sets, windows and rollups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from repolith.functions import scalar as s
from repolith.operators import lookup
from repolith.plans.base import FUNCTIONS, PART_CALLS, functions, part_calls, query, table
from repolith.sources import sinks


def _releases(spark, d):
    """Two releases of the api names of a corpus: the newer lacks the first file, the older the last."""
    f = functions(spark, d)
    ends = f.agg(F.min("filename").alias("lo"), F.max("filename").alias("hi"))
    rows = f.crossJoin(F.broadcast(ends))  # one row
    return rows.where("filename <> hi").select(F.col("signature").alias("api")), rows.where("filename <> lo").select(F.col("signature").alias("api"))


_RELEASES = f"""{FUNCTIONS}, old AS (SELECT DISTINCT signature AS api FROM fn WHERE filename <> (SELECT MAX(filename) FROM fn)), new AS (SELECT DISTINCT signature AS api FROM fn WHERE filename <> (SELECT MIN(filename) FROM fn))"""
_COMPARE = """SELECT *, CASE WHEN least(n_old, n_new) > 0 THEN shared::DOUBLE / least(n_old, n_new) ELSE 0.0 END AS overlap, CASE WHEN least(n_old, n_new) > 0 THEN shared::DOUBLE / least(n_old, n_new) > 0.5 ELSE FALSE END AS same_software FROM
  (SELECT (SELECT COUNT(*) FROM old JOIN new USING (api)) AS shared, (SELECT COUNT(*) FROM new ANTI JOIN old USING (api)) AS added, (SELECT COUNT(*) FROM old ANTI JOIN new USING (api)) AS removed, (SELECT COUNT(*) FROM old) AS n_old, (SELECT COUNT(*) FROM new) AS n_new)"""


@query(f"WITH {_RELEASES} {_COMPARE}")
def release_compare(spark, d):
    return lookup.compare_apis(*_releases(spark, d))


@query(f"WITH old AS (SELECT DISTINCT sha1(text) AS api FROM documents WHERE lang = 'en' AND text IS NOT NULL), new AS (SELECT DISTINCT sha1(text) AS api FROM documents WHERE lang <> 'en' AND text IS NOT NULL) {_COMPARE}")
def other_software_compare(spark, d):
    t = table(spark, d, "documents")
    return lookup.compare_apis(t.where("lang = 'en'").select(F.sha1("text")), t.where("lang <> 'en'").select(F.sha1("text")))


@query(f"WITH {_RELEASES} SELECT api, 'added' AS change FROM new ANTI JOIN old USING (api) UNION ALL SELECT api, 'removed' FROM old ANTI JOIN new USING (api)")
def api_changes(spark, d):
    old, new = _releases(spark, d)
    diff = lambda a, b, name: a.join(b, "api", "left_anti").distinct().withColumn("change", F.lit(name))
    return diff(new, old, "added").unionByName(diff(old, new, "removed"))


@query(f"WITH {_RELEASES} SELECT 'newer' AS role, COUNT(*) AS n FROM new UNION ALL SELECT 'older', COUNT(*) FROM old")
def release_order(spark, d):
    """The release with more functions is the newer, on a tie the second."""
    old, new = (x.agg(F.count_distinct("api").alias("n")).withColumn("pos", F.lit(i)) for i, x in enumerate(_releases(spark, d)))
    w = Window.partitionBy().orderBy("n", "pos")
    return old.unionByName(new).select(F.when(F.row_number().over(w) == 2, "newer").otherwise("older").alias("role"), "n")


@query("SELECT n_name AS name, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey) AS used FROM nation")
def existence_join(spark, d):
    n = table(spark, d, "nation")
    return lookup.exists_in(n, table(spark, d, "supplier").select("s_nationkey"), "n_nationkey", "used").select(F.col("n_name").alias("name"), "used")


@query(f"WITH {PART_CALLS} SELECT src, dst FROM ce WHERE dst IN (SELECT src FROM ce)")
def call_graph_edges(spark, d):
    calls = part_calls(spark, d).groupBy("src").agg(F.collect_set("dst").alias("callees")).withColumnRenamed("src", "signature")
    return lookup.call_edges(calls)


@query("""WITH own AS (SELECT n_name AS class, row_number() OVER (PARTITION BY n_name ORDER BY s_suppkey) - 1 AS pos, s_name AS signature FROM nation JOIN supplier ON s_nationkey = n_nationkey),
bare AS (SELECT n_name, n_nationkey FROM nation WHERE n_name NOT IN (SELECT class FROM own)),
alt AS (SELECT n_name AS class, row_number() OVER (PARTITION BY n_name ORDER BY c_custkey) - 1 AS pos, c_name AS signature FROM bare JOIN customer ON c_nationkey = n_nationkey)
SELECT class, CAST(pos AS INTEGER) AS pos, signature FROM own UNION ALL SELECT class, CAST(pos AS INTEGER), signature FROM alt WHERE pos < 5""")
def class_methods(spark, d):
    n, sup, cus = (table(spark, d, t) for t in ("nation", "supplier", "customer"))
    named = sup.join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda x: x["s_name"]).alias("methods"))
    classes = n.join(named, "n_name", "left").select(F.col("n_name").alias("name"), F.coalesce("methods", F.array().cast("array<string>")).alias("methods"))
    types = cus.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("signature"), F.col("c_custkey").alias("ord"), F.array("n_name").alias("types"))
    known = types.unionByName(sup.select(F.col("s_name").alias("signature"), F.col("s_suppkey").alias("ord"), F.array().cast("array<string>").alias("types")))
    return lookup.bind_methods(classes, known).select("class", F.col("pos").cast("int").alias("pos"), "signature")


@query("SELECT DISTINCT s_name AS src, n_name AS dst FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name <> r_name")
def type_edges(spark, d):
    n, r, sup = (table(spark, d, t) for t in ("nation", "region", "supplier"))
    fields = sup.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("src"), F.concat(F.lit("const "), "n_name", F.lit(" *")).alias("type"))
    more = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("src"), F.concat("r_name", F.lit("&")).alias("type"))
    classes = n.select(F.col("n_name").alias("name")).unionAll(r.select("r_name")).unionAll(sup.select("s_name")).distinct()
    return lookup.type_edges(fields.unionByName(more), classes, s.trim_c_type("type"))


@query(f"""WITH {PART_CALLS}, x AS (SELECT src AS node, dst AS neighbour, p_name AS doc, row_number() OVER (PARTITION BY src ORDER BY dst) AS nth FROM ce JOIN part ON p_partkey = dst WHERE p_size > 10)
SELECT node, nth, neighbour, doc FROM x WHERE nth <= 10""")
def callee_docs(spark, d):
    docs = table(spark, d, "part").select(F.col("p_partkey").alias("name"), F.when(F.col("p_size") > 10, F.col("p_name")).alias("doc"))
    return lookup.neighbour_docs(part_calls(spark, d), docs, 10).withColumn("nth", F.col("nth").cast("long"))


@query(f"""WITH {PART_CALLS}, x AS (SELECT dst AS node, src AS neighbour, p_name AS doc, row_number() OVER (PARTITION BY dst ORDER BY src) AS nth FROM ce JOIN part ON p_partkey = src)
SELECT node, nth, neighbour, doc FROM x WHERE nth <= 5""")
def caller_docs(spark, d):
    docs = table(spark, d, "part").select(F.col("p_partkey").alias("name"), F.col("p_name").alias("doc"))
    return lookup.neighbour_docs(part_calls(spark, d), docs, 5, "dst", "src").withColumn("nth", F.col("nth").cast("long"))


@query("""WITH k AS (SELECT DISTINCT p_name AS key FROM part), c AS (SELECT DISTINCT p_name AS callee FROM part UNION SELECT DISTINCT substr(p_name, 3) FROM part UNION SELECT 'absent'),
x AS (SELECT callee, key, levenshtein(callee, key) AS d FROM c JOIN k ON contains(key, callee) WHERE callee NOT IN (SELECT key FROM k)),
m AS (SELECT callee, key, row_number() OVER (PARTITION BY callee ORDER BY d, key) AS nth FROM x)
SELECT callee, CASE WHEN callee IN (SELECT key FROM k) THEN callee ELSE (SELECT key FROM m WHERE m.callee = c.callee AND nth = 1) END AS resolved FROM c""")
def callee_resolution(spark, d):
    p = table(spark, d, "part")
    names = p.select(F.col("p_name").alias("callee")).unionAll(p.select(F.expr("substr(p_name, 3)"))).unionAll(spark.range(1).select(F.lit("absent")))
    return lookup.resolve(names, p.select(F.col("p_name").alias("key")))


@query("""WITH x AS (SELECT l_orderkey, l_partkey, COUNT(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1, 2), c AS (SELECT s.s_nationkey AS caller, q.s_nationkey AS callee, COUNT(*) AS calls
  FROM lineitem l JOIN supplier s ON s.s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN (SELECT DISTINCT c_nationkey AS s_nationkey FROM customer) q ON q.s_nationkey = c_nationkey WHERE s.s_nationkey <> c_nationkey GROUP BY 1, 2)
SELECT caller, callee, calls FROM c""")
def cross_crate_calls(spark, d):
    """Calls between crates, nations here: the supplier's calls the customer's."""
    li, o, cu, su = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "supplier"))
    rows = li.join(su, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(cu, F.col("o_custkey") == F.col("c_custkey"))
    return rows.where("s_nationkey <> c_nationkey").groupBy(F.col("s_nationkey").alias("caller"), F.col("c_nationkey").alias("callee")).agg(F.count(F.lit(1)).alias("calls"))


@query("""SELECT l_partkey AS signature, array_to_string(list_sort(list_distinct(list(l_suppkey) || list(l_linenumber::BIGINT))), ',') AS callees FROM lineitem GROUP BY l_partkey""")
def merged_callees(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("signature")).agg(F.collect_set("l_suppkey").alias("a"), F.collect_set(F.col("l_linenumber").cast("long")).alias("b"))
    return g.select("signature", F.array_join(F.array_sort(F.array_union("a", "b")).cast("array<string>"), ",").alias("callees"))


@query(f"""WITH {FUNCTIONS} SELECT signature, coalesce(b.text, 'no doc') AS doc FROM fn LEFT JOIN benchmark b ON b.item_id = fn.ord""")
def doc_left_join(spark, d):
    docs = table(spark, d, "benchmark").select(F.col("item_id").alias("ord"), "text")
    return functions(spark, d).join(docs, "ord", "left").select("signature", F.coalesce("text", F.lit("no doc")).alias("doc"))


@query("""SELECT c_custkey, coalesce(n.n_name, s.s_name, 'none') AS found FROM customer LEFT JOIN nation n ON n_nationkey = c_custkey LEFT JOIN supplier s ON s_suppkey = c_custkey""")
def coalesced_lookup(spark, d):
    c, n, su = (table(spark, d, t) for t in ("customer", "nation", "supplier"))
    return c.join(n, F.col("n_nationkey") == F.col("c_custkey"), "left").join(su, F.col("s_suppkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("n_name", "s_name", F.lit("none")).alias("found"))


@query("""WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents), l AS (SELECT item_id, unnest([item_id + 1, item_id + 3, 0, 100000000]) AS n FROM benchmark)
SELECT item_id, l.n, doc_id FROM l JOIN a USING (n)""")
def ordinal_lookup(spark, d):
    from repolith.operators.ordered import numbered

    docs = numbered(table(spark, d, "documents").select("doc_id"), "doc_id", "n")
    asked = table(spark, d, "benchmark").select("item_id", F.explode(F.array(F.col("item_id") + 1, F.col("item_id") + 3, F.lit(0), F.lit(100000000))).alias("n"))
    return asked.join(docs, "n").select("item_id", "n", "doc_id")


@query("SELECT a.conv_id, a.turn, a.text AS question, b.text AS answer FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user'")
def question_answers(spark, d):
    c = table(spark, d, "conversations")
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return c.where("role = 'user'").join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.col("text").alias("question"), "answer")


@query(f"""WITH {FUNCTIONS} SELECT COUNT(*) AS total, COUNT(*) FILTER (modifier LIKE '%PUBLIC%') AS public, COUNT(*) FILTER (modifier LIKE '%PRIVATE%') AS private, COUNT(*) FILTER (modifier LIKE '%ASYNC%') AS async, COUNT(*) FILTER (modifier LIKE '%UNSAFE%') AS unsafe,
  COALESCE(AVG(n_chars), 0.0) AS avg_chars, MAX(n_chars) AS max_chars, COUNT(DISTINCT filename) AS files FROM fn""")
def analysis_statistics(spark, d):
    has = lambda m: F.count_if(F.contains("modifier", F.lit(m)))
    return functions(spark, d).agg(
        F.count(F.lit(1)).alias("total"), has("PUBLIC").alias("public"), has("PRIVATE").alias("private"), has("ASYNC").alias("async"), has("UNSAFE").alias("unsafe"),
        F.coalesce(F.avg("n_chars"), F.lit(0.0)).alias("avg_chars"), F.max("n_chars").alias("max_chars"), F.count_distinct("filename").alias("files"),
    )


@query(f"WITH {FUNCTIONS} SELECT filename, COUNT(*) AS n, COUNT(*) FILTER (visible) AS visible, array_to_string(list_sort(list(ord)), ',') AS functions FROM fn GROUP BY filename HAVING COUNT(*) > 1")
def file_groups(spark, d):
    return functions(spark, d).groupBy("filename").agg(F.count(F.lit(1)).alias("n"), F.count_if("visible").alias("visible"), F.array_join(F.array_sort(F.collect_list("ord")).cast("array<string>"), ",").alias("functions")).where("n > 1")


@query(f"""WITH {FUNCTIONS}, u AS (SELECT filename AS path, signature AS item FROM fn WHERE visible UNION ALL SELECT source || '.c', 'type_' || lang FROM (SELECT DISTINCT source, lang FROM documents))
SELECT path, array_to_string(list_sort(list(item)), ',') AS items FROM u GROUP BY path""")
def module_rollup(spark, d):
    f = functions(spark, d)
    items = f.where("visible").select(F.col("filename").alias("path"), F.col("signature").alias("item")).unionByName(f.select(F.col("filename").alias("path"), F.concat(F.lit("type_"), "lang").alias("item")).distinct())
    return items.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))


@query("SELECT n_regionkey AS module, array_to_string(list_sort(list(n_name)), ', ') AS names, max_by(n_name, n_nationkey) AS last FROM nation GROUP BY n_regionkey")
def cluster_merge(spark, d):
    return table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("module")).agg(F.array_join(F.array_sort(F.collect_list("n_name")), ", ").alias("names"), F.max_by("n_name", "n_nationkey").alias("last"))


@query("""WITH x AS (SELECT o_custkey AS repo, COUNT(*) AS n, COUNT(*) FILTER (o_orderstatus = 'F') AS ok, COUNT(*) FILTER (o_orderpriority LIKE '1%') AS issues FROM orders GROUP BY 1)
SELECT repo, CASE WHEN ok = 0 THEN 'failed' WHEN ok = n AND issues = 0 THEN 'succeeded' ELSE 'partial' END AS status FROM x""")
def status_rollup(spark, d):
    from repolith.plans.lifecycle import rollup

    return rollup(table(spark, d, "orders").select(F.col("o_custkey").alias("repo"), (F.col("o_orderstatus") == "F").alias("ok"), F.startswith("o_orderpriority", F.lit("1")).cast("int").alias("issues")))


@query("""WITH m AS (SELECT o_custkey AS profile, COUNT(DISTINCT o_orderpriority) AS mapped, COUNT(DISTINCT o_orderpriority) FILTER (o_orderpriority IN (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority < '3')) AS valid FROM orders GROUP BY 1)
SELECT profile, mapped / 5.0::DOUBLE AS coverage, valid / 5.0::DOUBLE AS valid_coverage FROM m""")
def coverage(spark, d):
    from repolith.plans.lifecycle import coverage_of

    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("profile"), F.col("o_orderpriority").alias("standard_id"))
    standard = rows.select("standard_id").where("standard_id < '3'").distinct()
    return coverage_of(rows, standard, 5)


@query("""WITH m AS (SELECT l_suppkey AS module_ord, l_linenumber AS pos, l_partkey AS item FROM lineitem), a AS (SELECT p_partkey AS item FROM part UNION ALL SELECT unnest([-1, -2])),
o AS (SELECT item, module_ord FROM (SELECT m.*, row_number() OVER (PARTITION BY m.item ORDER BY module_ord, pos) AS nth FROM m JOIN a USING (item)) WHERE nth = 1),
s AS (SELECT module_ord FROM (SELECT module_ord, COUNT(*) AS n FROM o GROUP BY 1) ORDER BY n, module_ord LIMIT 1)
SELECT item, module_ord FROM o UNION ALL SELECT item, (SELECT module_ord FROM s) FROM a WHERE item NOT IN (SELECT item FROM o)""")
def partition_repair(spark, d):
    members = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("module_ord"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("item"))
    allowed = table(spark, d, "part").select(F.col("p_partkey").alias("item")).unionAll(spark.range(1).select(F.explode(F.array(F.lit(-1), F.lit(-2)).cast("array<long>"))))
    return lookup.repair_partition(members, allowed)


@query("""WITH x AS (SELECT trim(o_orderpriority) AS feature, MIN(o_orderkey) AS first FROM orders WHERE trim(o_orderpriority) <> '' GROUP BY 1) SELECT feature, row_number() OVER (ORDER BY first, feature) AS nth FROM x""")
def unmapped_features(spark, d):
    from repolith.plans.lifecycle import distinct_in_order

    return distinct_in_order(table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("feature")), "feature", "o_orderkey")


@query("SELECT c_custkey, c_mktsegment || CASE WHEN nth > 1 THEN '_' || nth ELSE '' END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS nth FROM customer)")
def unique_names(spark, d):
    nth = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", F.when(nth > 1, F.concat("c_mktsegment", F.lit("_"), nth)).otherwise(F.col("c_mktsegment")).alias("unique_name"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey) AS nth FROM lineitem")
def running_numbers(spark, d):
    from repolith.operators.ordered import numbered

    return numbered(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber", "l_partkey"], "nth")


@query("SELECT user_id AS name, max_by(event_id, event_id) AS last, min_by(event_id, event_id) AS first FROM events GROUP BY user_id")
def first_and_last_by_name(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("name")).agg(F.max("event_id").alias("last"), F.min("event_id").alias("first"))


@query("""WITH p AS (SELECT DISTINCT source || '/' || CASE WHEN lang = 'en' THEN 'README.md' ELSE lang || '.md' END AS path FROM documents)
SELECT row_number() OVER (ORDER BY CASE WHEN lower(path) LIKE '%readme.md' THEN 0 ELSE 3 END, lower(path), path) AS nth, '* [' || regexp_replace(path, '\\.md$', '') || '](' || path || ')' AS line FROM p""")
def table_of_contents(spark, d):
    path = F.concat("source", F.lit("/"), F.when(F.col("lang") == "en", "README.md").otherwise(F.concat("lang", F.lit(".md"))))
    return sinks.contents(table(spark, d, "documents").select(path.alias("path")).distinct()).select(F.col("nth").cast("long").alias("nth"), "line")


@query("""WITH p AS (SELECT DISTINCT string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS parts FROM pages), x AS (SELECT DISTINCT array_to_string(parts[1:i], '/') AS path FROM p, LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i))
SELECT path, len(string_split(path, '/')) - 1 AS depth, repeat('  ', len(string_split(path, '/')) - 1) || string_split(path, '/')[-1] AS line FROM x""")
def directory_tree(spark, d):
    from repolith.operators.graph import directories

    return directories(table(spark, d, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path"))).withColumn("depth", F.col("depth").cast("long"))


@query(f"""WITH {FUNCTIONS} SELECT filename, '### ' || filename || chr(10) || chr(10) || '#### Description' || chr(10) || COUNT(*) || ' functions' AS block FROM fn GROUP BY filename""")
def markdown_rendering(spark, d):
    g = functions(spark, d).groupBy(F.col("filename").alias("name")).agg(F.concat(F.count(F.lit(1)).cast("string"), F.lit(" functions")).alias("description"))
    empty = F.lit(None).cast("string")
    rows = g.select("name", "description", empty.alias("parameters"), empty.alias("code_details"), empty.alias("example"))
    return rows.select(F.col("name").alias("filename"), sinks.function_markdown().alias("block"))


@query("""SELECT s_suppkey, '{"name":"' || s_name || '"' || CASE WHEN s_nationkey % 3 > 0 THEN ',"parent":' || s_nationkey ELSE '' END || '}' AS json FROM supplier""")
def json_rows(spark, d):
    """Rows as JSON lines; a null field is left out."""
    parent = F.expr("CASE WHEN s_nationkey % 3 > 0 THEN s_nationkey END").alias("parent")
    return table(spark, d, "supplier").select("s_suppkey", F.to_json(F.struct(F.col("s_name").alias("name"), parent)).alias("json"))
