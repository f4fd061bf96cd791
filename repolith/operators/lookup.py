"""Lookups that are joins, and what orders or repairs their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exists_in(rows: DataFrame, names: DataFrame, key: str, flag: str) -> DataFrame:
    """``flag``: whether the row's ``key`` is one of ``names``."""
    return rows.join(names.select(F.col(names.columns[0]).alias(key)).distinct().withColumn("_there", F.lit(True)), key, "left").withColumn(flag, F.col("_there").isNotNull()).drop("_there")


def call_edges(functions: DataFrame, endpoints: str = "both") -> DataFrame:
    """Distinct (src, dst) of functions(signature, callees); ``endpoints``: both or callee must be functions, or none is checked."""
    edges = functions.select(F.col("signature").alias("src"), F.explode("callees").alias("dst")).distinct()
    if endpoints == "none":
        return edges
    nodes = functions.select(F.col("signature").alias("dst")).distinct()
    return edges.join(nodes, "dst", "left_semi").select("src", "dst")


def first_k(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("nth", nth).where(F.col("nth") <= k)


def bind_methods(classes: DataFrame, functions: DataFrame, k: int = 5) -> DataFrame:
    """(class, pos, signature): functions that a class names; a class with none that exist gets the first k with a parameter of its type.

    classes(name, methods array), functions(signature, ord, types array of trimmed parameter types).
    """
    own = classes.select(F.col("name").alias("class"), F.posexplode("methods").alias("pos", "signature")).join(functions.select("signature"), "signature", "left_semi").select("class", "pos", "signature")
    bare = classes.select(F.col("name").alias("class")).join(own.select("class").distinct(), "class", "left_anti")
    takers = functions.select("signature", "ord", F.explode(F.array_distinct("types")).alias("class")).join(bare, "class")
    return own.unionByName(first_k(takers, ["class"], [F.col("ord")], k).select("class", (F.col("nth") - 1).alias("pos"), "signature"))


def type_edges(fields: DataFrame, classes: DataFrame, trimmed: Column) -> DataFrame:
    """Distinct (src, dst): a class refers to another by a field's type. fields(src, type), classes(name)."""
    return fields.select("src", trimmed.alias("dst")).join(classes.select(F.col("name").alias("dst")), "dst", "left_semi").where("src <> dst").select("src", "dst").distinct()


def neighbour_docs(edges: DataFrame, docs: DataFrame, k: int, of: str = "src", other: str = "dst") -> DataFrame:
    """For each node up to k documents of its neighbours, by neighbour: (node, nth, neighbour, doc). docs(name, doc)."""
    rows = edges.select(F.col(of).alias("node"), F.col(other).alias("neighbour")).join(docs.withColumnRenamed("name", "neighbour"), "neighbour").where("doc IS NOT NULL")
    return first_k(rows, ["node"], [F.col("neighbour")], k).select("node", "nth", "neighbour", "doc")


def resolve(callees: DataFrame, keys: DataFrame, grams: int = 3) -> DataFrame:
    """(callee, resolved): the key of that name, else of all keys that contain it the nearest by Levenshtein, ties to the smaller key.

    A key that contains a callee contains its first ``grams`` characters, so candidates meet by an
    equi-join on these; callees shorter than that are compared with all keys.
    """
    names = callees.select(F.col(callees.columns[0]).alias("callee")).distinct()
    known = keys.select(F.col(keys.columns[0]).alias("key")).distinct()
    exact = names.join(known, F.col("callee") == F.col("key")).select("callee", F.col("key").alias("resolved"))
    rest = names.join(exact, "callee", "left_anti")
    parts = known.select("key", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("key") - grams + 1, F.lit(1))), lambda i: F.substr("key", i, F.lit(grams))))).alias("gram"))
    long_ = rest.where(F.length("callee") >= grams).withColumn("gram", F.substring("callee", 1, grams)).join(parts, "gram").where(F.contains("key", F.col("callee")))
    short = rest.where(F.length("callee") < grams).join(known, F.contains(F.col("key"), F.col("callee")))
    found = long_.select("callee", "key").unionByName(short.select("callee", "key"))
    best = found.groupBy("callee").agg(F.min(F.struct(F.levenshtein("callee", "key").alias("d"), "key")).alias("m")).select("callee", F.col("m.key").alias("resolved"))
    return names.join(exact.unionByName(best), "callee", "left")


def repair_partition(members: DataFrame, allowed: DataFrame) -> DataFrame:
    """Every allowed item in exactly one module: (item, module_ord). members(module_ord, pos, item), allowed(item).

    The first module that names an item owns it; items that none names go to the module with fewest
    items, the first on a tie, or to module 0 if all are lost.
    """
    owned = first_k(members.join(allowed, "item", "left_semi"), ["item"], [F.col("module_ord"), F.col("pos")], 1).select("item", "module_ord")
    left = allowed.join(owned, "item", "left_anti").select("item")
    sizes = owned.groupBy("module_ord").agg(F.count(F.lit(1)).alias("n"))
    smallest = sizes.agg(F.coalesce(F.min(F.struct("n", "module_ord"))["module_ord"], F.lit(0)).alias("module_ord"))
    return owned.unionByName(left.crossJoin(F.broadcast(smallest)))  # one row


def compare_apis(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row for two sets of api names: shared, added, removed, overlap (shared over the smaller), same_software (overlap above a half).

    An empty set gives overlap 0.
    """
    a, b = (x.select(F.col(x.columns[0]).alias("api")).where("api IS NOT NULL").distinct() for x in (old, new))
    sides = a.withColumn("side", F.lit(1)).unionAll(b.withColumn("side", F.lit(2))).groupBy("api").agg(F.sum("side").alias("side"))
    n = lambda *s: F.count(F.when(F.col("side").isin(*s), 1))
    counts = sides.agg(n(3).alias("shared"), n(2).alias("added"), n(1).alias("removed"), n(1, 3).alias("n_old"), n(2, 3).alias("n_new"))
    overlap = F.when(F.least("n_old", "n_new") > 0, F.col("shared") / F.least("n_old", "n_new")).otherwise(0.0)
    return counts.withColumn("overlap", overlap).withColumn("same_software", F.col("overlap") > 0.5)


def crates_of(symbols: DataFrame, crates: DataFrame, main: str) -> DataFrame:
    """(symbol, crate): the known crate that the symbol's path begins with, by alias or name, else ``main``. crates(name, crate)."""
    from repolith.functions.scalar import crate_of

    rows = symbols.select(F.col(symbols.columns[0]).alias("symbol")).withColumn("_head", crate_of("symbol"))
    known = crates.select(F.col("name").alias("_head"), "crate").dropDuplicates(["_head"])
    return rows.join(known, "_head", "left").select("symbol", F.coalesce("crate", F.lit(main)).alias("crate"))


def merge_callees(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """functions(signature, callees) with the callees of calls(caller, callee) put in, each once, in order."""
    more = calls.groupBy(F.col("caller").alias("signature")).agg(F.array_sort(F.collect_set("callee")).alias("_more"))
    return functions.join(more, "signature", "left").withColumn("callees", F.array_union(F.coalesce("callees", F.array().cast("array<string>")), F.coalesce("_more", F.array().cast("array<string>")))).drop("_more")


def member_docs(members: DataFrame) -> DataFrame:
    """One row a workspace: a map from member to its version and features. members(workspace, name, version, features)."""
    return members.groupBy("workspace").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.struct("version", "features"))))).alias("member_docs"))
