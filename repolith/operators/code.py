"""Classes, modules and statistics of analysed code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith import schemas
from repolith.functions import scalar as s


def field_edges(fields: DataFrame, classes: DataFrame, rule: str) -> DataFrame:
    """Distinct (src, dst): a class refers to another by the type of a field. fields(src, type), classes(signature, name, ord).

    What a type must be, by ``rule``: c: trimmed, a class; js, arkts: as it is a class, and trimmed the name
    of one; rust: trimmed, a class other than its own; ts: trimmed, the name of classes, of which the
    first counts, other than its own.
    """
    nodes = classes.select(F.col("signature").alias("dst"))
    if rule == "ts":
        first = classes.groupBy(F.col("name").alias("_name")).agg(F.min_by("signature", "ord").alias("dst"))
        edges = fields.withColumn("_name", s.trim_ts_type("type")).join(first, "_name").where("src <> dst")
    elif rule in ("js", "arkts"):
        names = classes.select(F.col("name").alias("_name"))
        edges = fields.withColumn("_name", s.trim_c_type("type")).join(names, "_name", "left_semi").withColumn("dst", F.col("type")).join(nodes, "dst", "left_semi")
    elif rule == "rust":
        edges = fields.withColumn("dst", s.trim_rust_type("type")).join(nodes, "dst", "left_semi").where("src <> dst")
    elif rule == "c":
        edges = fields.withColumn("dst", s.trim_c_type("type")).join(nodes, "dst", "left_semi")
    else:
        raise ValueError(f"no rule {rule}")
    return edges.select("src", "dst").distinct()


def inheritance_edges(classes: DataFrame) -> DataFrame:
    """Distinct (src, dst): classes(signature, parents) and those of their parents that are classes too."""
    nodes = classes.select(F.col("signature").alias("dst"))
    return classes.select(F.col("signature").alias("src"), F.explode("parents").alias("dst")).join(nodes, "dst", "left_semi").select("src", "dst").distinct()


def non_empty(classes: DataFrame) -> DataFrame:
    """Classes(fields, functions) that have any."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))  # noqa: E731  of null -1 or null, by setting
    return classes.where((size("fields") > 0) | (size("functions") > 0))


def with_member_docs(rows: DataFrame, docs: DataFrame, key: str, members: str, kept: tuple[str, ...] = ("doc_comment",)) -> DataFrame:
    """``rows`` with the ``kept`` columns of their documentation by ``key``, and each of the structs in ``members`` with the description of its name.

    docs(key, *kept, members array<struct<name, description>>); of several of a key, any has to do.
    Rows and members without documentation have null.
    """
    known = docs.dropDuplicates([key]).select(key, *kept, F.col(members).alias("_docs"))
    about = lambda m: F.element_at(F.filter("_docs", lambda x: x["name"] == m["name"]), -1)["description"]
    out = rows.join(known, key, "left")
    return out.withColumn(members, F.transform(members, lambda m: F.struct(m["name"].alias("name"), F.when(F.exists("_docs", lambda x: x["name"] == m["name"]), about(m)).alias("description")))).drop("_docs")


def impl_methods(types: DataFrame, impls: DataFrame) -> DataFrame:
    """types(fullname) with the methods of their impl blocks, block by block. impls(module, type, ord, methods)."""
    blocks = impls.groupBy(s.item_id("module", "type").alias("fullname")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "methods"))), lambda x: x["methods"])).alias("methods"))
    return types.join(blocks, "fullname", "left").withColumn("methods", F.coalesce("methods", F.array().cast("array<string>")))


def known_methods(methods: DataFrame, extracted: DataFrame) -> DataFrame:
    """methods(class, signature) that were extracted too."""
    return methods.join(extracted.select("signature"), "signature", "left_semi")


def statistics(functions: DataFrame, types: DataFrame) -> DataFrame:
    """One row: counts and means over functions(modifier, params, callees) and types(attributes array<struct<modifier>>).

    A type with a VARIANT is an enum, else one with a TRAIT_METHOD a trait, else a struct. Means of no rows are 0.
    """
    has = lambda m: F.count_if(F.contains("modifier", F.lit(m)))
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    mean = lambda c: F.coalesce(F.avg(size(c)), F.lit(0.0))
    f = functions.agg(
        F.count(F.lit(1)).alias("total_methods"), has("PUBLIC").alias("public_methods"), has("PRIVATE").alias("private_methods"), has("ASYNC").alias("async_methods"), has("UNSAFE").alias("unsafe_methods"),
        mean("params").alias("avg_method_params"), F.coalesce(F.max(size("callees")), F.lit(0)).alias("max_call_depth"),
    )
    marked = lambda m: F.coalesce(F.exists("attributes", lambda a: a["modifier"] == m), F.lit(False))
    kind = F.when(marked("VARIANT"), "enum").when(marked("TRAIT_METHOD"), "trait").otherwise("struct")
    t = types.withColumn("_kind", kind).agg(
        F.count(F.lit(1)).alias("total_types"), *(F.count_if(F.col("_kind") == k).alias(f"{k}_count") for k in ("struct", "enum", "trait")), mean("attributes").alias("avg_type_attributes")
    )
    return f.crossJoin(F.broadcast(t))  # one row


def module_of_file(filename: Column | str) -> Column:
    """Folders and stem of a file as a path, without folders named src or resource; root if nothing is left."""
    parts = F.split(F.regexp_replace(filename, r"(?<=[^/])\.[^./]*$", ""), "/")
    path = F.array_join(F.filter(parts, lambda p: ~p.isin("src", "resource", "", ".", "..")), "::")
    return F.when(path == "", "root").otherwise(path)


def module_of_type(fullname: Column | str) -> Column:
    """What stands before the last :: of a full name, else root."""
    at = F.regexp_extract(fullname, r"(?s)^(.*)::", 1)
    return F.when(F.contains(fullname, F.lit("::")), at).otherwise("root")


def module_rollup(functions: DataFrame, types: DataFrame) -> DataFrame:
    """(path, name, public_items, submodules) of every module that has a function or a type.

    functions(filename, name, modifier) belong to the path of their file and are items if public;
    types(fullname, name) to what stands before their name and always are. Submodules are modules one
    step below. Both lists are sorted; an item is listed as often as it is there.
    """
    rows = functions.select(module_of_file("filename").alias("path"), F.when(F.contains("modifier", F.lit("PUBLIC")), F.col("name")).alias("item"))
    rows = rows.unionByName(types.select(module_of_type("fullname").alias("path"), F.col("name").alias("item")))
    modules = rows.groupBy("path").agg(F.array_sort(F.collect_list("item")).alias("public_items"))
    last = F.element_at(F.split("path", "::"), -1)
    below = modules.where(F.contains("path", F.lit("::"))).select(F.regexp_extract("path", r"(?s)^(.*)::", 1).alias("path"), last.alias("child")).groupBy("path").agg(F.array_sort(F.collect_list("child")).alias("submodules"))
    return modules.join(below, "path", "left").select("path", last.alias("name"), "public_items", F.coalesce("submodules", F.array().cast("array<string>")).alias("submodules"))


def merge_clusters(clusters: DataFrame, drafts: DataFrame) -> DataFrame:
    """(cluster, name, description, functions): one module for each cluster of drafts.

    clusters(cluster, pos, draft), drafts(draft, name, description, functions). Functions stand in order,
    each once; the name is that of the draft with most, the first on a tie, or Module_ and the
    cluster's number from 1; descriptions follow each other, but for empty ones and placeholders,
    which begin with a bracket; if none is left the name-giving draft's stays.
    """
    rows = clusters.join(drafts, "draft").withColumn("functions", F.coalesce("functions", F.array().cast("array<string>")))
    told = (F.coalesce("description", F.lit("")) != "") & ~F.coalesce(F.startswith(F.trim("description"), F.lit("[")), F.lit(False))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["x"])
    out = rows.groupBy("cluster").agg(
        F.array_distinct(F.flatten(in_order(F.struct("pos", F.col("functions").alias("x"))))).alias("functions"),
        F.max_by(F.struct("name", "description"), F.struct(F.size("functions"), -F.col("pos"))).alias("rep"),
        F.array_join(in_order(F.when(told, F.struct("pos", F.col("description").alias("x")))), "\n\n").alias("told"),
    )
    name = F.coalesce(F.nullif(F.col("rep.name"), F.lit("")), F.concat(F.lit("Module_"), F.col("cluster") + 1))
    return out.select("cluster", name.alias("name"), F.when(F.col("told") != "", F.col("told")).otherwise(F.coalesce("rep.description", F.lit(""))).alias("description"), "functions")


def communities_of(communities: DataFrame, apis: DataFrame) -> DataFrame:
    """(community, apis): the apis in each community, sorted; communities(node, community) without any are left out. apis(node)."""
    return communities.join(apis.select("node").distinct(), "node", "left_semi").groupBy("community").agg(F.array_sort(F.collect_list("node")).alias("apis"))


def unique_files(rows: DataFrame, name: str, order: str, out: str = "file") -> DataFrame:
    """``out``: a file name for each row, _2, _3 and so on where a name comes again, by ``order``."""
    nth = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return rows.withColumn(out, F.when(nth > 1, F.concat(name, F.lit("_"), nth)).otherwise(F.col(name)))


def with_language(rows: DataFrame, key: str, by: str = "cli") -> DataFrame:
    """``rows`` with ``language`` and ``render`` of their language, known by its command-line name (cli) or fence name (render, the first); null if unknown."""
    at = {"cli": 2, "render": 1}[by]
    found = {x[at]: x for x in reversed(schemas.LANGUAGES)}
    pick = lambda i: F.create_map(*(F.lit(v) for k, x in found.items() for v in (k, x[i])))[F.col(key)]
    return rows.withColumn("language", pick(0)).withColumn("render", pick(1))
