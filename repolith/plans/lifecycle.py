"""Stages of the analysis with pluggable providers: documents by level, modules, retrieval, profiles, evolution, status."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repolith.functions import scalar as s
from repolith.operators import graph, lookup, vector
from repolith.operators.ordered import numbered
from repolith.plans.base import functions, query, table
from repolith.session import checkpointed


class Provider(Protocol):
    """What answers prompts; must not depend on the order of calls."""

    def chat(self, prompt: str) -> str: ...


class Summary:
    """A stand-in for a language model: the first words and the length of the prompt."""

    def chat(self, prompt: str) -> str:
        return f"{' '.join(prompt.split()[:8])} ({len(prompt)} characters)"


def asked(rows: DataFrame, prompt: str, answer: str, provider: Provider, attempts: int = 2, concurrency: int = 4) -> DataFrame:
    """``answer`` by the provider for the column ``prompt``: at most ``concurrency`` tasks at a time, ``attempts`` calls a row, null where all fail."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(text: str | None) -> str | None:
            for _ in range(attempts if text is not None else 0):
                try:
                    return provider.chat(text)
                except Exception:  # noqa: BLE001  a failed row is null and is asked again on the next run
                    continue
            return None

        for frame in frames:
            yield frame.assign(**{answer: frame[prompt].map(one)})

    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.repartition(concurrency).mapInPandas(run, f"{kinds}, `{answer}` string")


def embedded(rows: DataFrame, text: str, out: str, size: int = 64) -> DataFrame:
    """A deterministic embedding: hashed words, in unit length; each distinct text is computed once."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    texts = rows.select(text).distinct()
    hits = texts.select(text, F.explode(words).alias("w")).select(text, F.pmod(F.xxhash64("w"), F.lit(size)).cast("int").alias("i")).groupBy(text, "i").agg(F.count(F.lit(1)).alias("n"))
    norm = hits.groupBy(text).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"), F.map_from_entries(F.collect_list(F.struct("i", "n"))).alias("m"))
    at = lambda i: F.coalesce(F.try_element_at("m", i.cast("int")), F.lit(0)) / F.col("norm")
    vectors = norm.select(text, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), at).alias(out))
    return rows.join(vectors, text, "left").withColumn(out, F.coalesce(out, F.array_repeat(F.lit(0.0), size)))


def document_functions(rows: DataFrame, edges: DataFrame, provider: Provider, known: DataFrame | None = None) -> DataFrame:
    """(name, level, doc): documents callees first, one job per level; prompts hold up to 10 callees' documents and 5 callers'. rows(name, code).

    Functions in ``known`` (name, doc) are not asked again.
    """
    levels = checkpointed(graph.levels(edges).withColumnRenamed("node", "name"))
    levels = rows.select("name").join(levels, "name", "left").select("name", F.coalesce("level", F.lit(0)).alias("level"))
    levels = checkpointed(levels)
    none = rows.sparkSession.createDataFrame([], f"name {dict(rows.dtypes)['name']}, level int, doc string")
    done = none if known is None else known.join(levels, "name").select("name", "level", "doc")
    for level in [r["level"] for r in levels.select("level").distinct().orderBy("level").collect()]:  # as many as the graph is deep
        now = rows.join(levels.where(F.col("level") == level), "name").join(done.select("name"), "name", "left_anti")
        gather = lambda k, a, b, c: lookup.neighbour_docs(edges, done.select("name", "doc"), k, a, b).groupBy("node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "doc"))), lambda x: x["doc"]), "\n").alias(c))
        callees, callers = gather(10, "src", "dst", "callee_docs"), gather(5, "dst", "src", "caller_docs")
        prompts = now.join(callees.withColumnRenamed("node", "name"), "name", "left").join(callers.withColumnRenamed("node", "name"), "name", "left")
        prompts = prompts.withColumn("prompt", F.concat_ws("\n", F.lit("Describe this function."), s.truncated("code", 5000), "callee_docs", "caller_docs"))
        done = checkpointed(done.unionByName(asked(prompts, "prompt", "doc", provider).select("name", "level", "doc")))
    return done


def distinct_in_order(rows: DataFrame, value: str, order: str) -> DataFrame:
    """Trimmed, non-blank values once each, with their place by first appearance."""
    first = rows.select(F.trim(value).alias(value), order).where(f"{value} <> ''").groupBy(value).agg(F.min(order).alias("_first"))
    return numbered(first, ["_first", value], "nth").drop("_first")


def rollup(parts: DataFrame) -> DataFrame:
    """(repo, status): failed without a success, succeeded without a failure or an issue of a stage, else partial. parts(repo, ok, issues)."""
    counts = parts.groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("good"), F.sum("issues").alias("issues"))
    return counts.select("repo", F.when(F.col("good") == 0, "failed").when((F.col("good") == F.col("n")) & (F.col("issues") == 0), "succeeded").otherwise("partial").alias("status"))


def coverage_of(mapped: DataFrame, standard: DataFrame, n: int) -> DataFrame:
    """(profile, coverage, valid_coverage): distinct mapped ids over n features, as they are and only those of the standard."""
    valid = lookup.exists_in(mapped, standard, "standard_id", "valid")
    counts = valid.groupBy("profile").agg(F.count_distinct("standard_id").alias("a"), F.count_distinct(F.when(F.col("valid"), F.col("standard_id"))).alias("b"))
    return counts.select("profile", (F.col("a") / F.lit(n)).alias("coverage"), (F.col("b") / F.lit(n)).alias("valid_coverage"))


def map_features(raw: DataFrame, standard: DataFrame, least: float = 0.8) -> DataFrame:
    """(raw_id, standard_id or null, confidence): the most similar standard feature of each raw one, if similar enough. raw(raw_id, text), standard(standard_id, text)."""
    a = embedded(raw, "text", "q").select(F.col("raw_id").alias("query_id"), "q")
    b = embedded(standard, "text", "v").select(F.col("standard_id").alias("id"), "v")
    best = vector.nearest(a, b, 1)
    score = F.lit(1.0) - F.col("distance") / 2  # unit vectors
    return best.select(F.col("query_id").alias("raw_id"), F.when(score >= least, F.col("id")).alias("standard_id"), score.alias("confidence"))


def valid_profiles(profiles: DataFrame) -> DataFrame:
    """Profiles that were made without a failure; only these take part in a model's evolution."""
    return profiles.where("status = 'succeeded'")


def evolve(features: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(features, changes): the next version of a model after decisions(ord, action, ...) in their order.

    ADD_NEW_FEATURE and ADD_SUB_FEATURE add a feature each, under the root or a known parent, if they
    give a name and a description; MERGE_FEATURE rewrites a known feature's description, the last one
    counts. IGNORE, what names no known feature and what lacks a value change nothing. An id is the
    digest of parent, name and how often both came before, so that a run again gives the same ids and
    adds nothing twice. New features stand after the old ones, in the order of their decisions.
    """
    ids = features.select("id")
    given = lambda *names: " AND ".join(f"coalesce({n}, '') <> ''" for n in names)
    add = decisions.where(given("new_feature_name", "new_feature_description"))
    top = add.where("action = 'ADD_NEW_FEATURE'").withColumn("parent_feature_id", F.lit(None).cast("string"))
    sub = add.where("action = 'ADD_SUB_FEATURE'").join(ids.withColumnRenamed("id", "parent_feature_id"), "parent_feature_id", "left_semi")
    before = F.row_number().over(Window.partitionBy("parent_feature_id", "new_feature_name").orderBy("ord"))
    fresh = top.unionByName(sub.select(*top.columns)).withColumn("id", F.concat(F.lit("feat_"), F.sha1(F.concat_ws("\u0001", F.coalesce("parent_feature_id", F.lit("")), "new_feature_name", before))))
    fresh = fresh.select("id", F.col("parent_feature_id").alias("parent_id"), F.col("new_feature_name").alias("name"), F.col("new_feature_description").alias("description"), F.col("ord").alias("place")).join(ids, "id", "left_anti")
    merges = decisions.where("action = 'MERGE_FEATURE' AND " + given("target_feature_id", "updated_description")).groupBy(F.col("target_feature_id").alias("id")).agg(F.max_by("updated_description", "ord").alias("updated"))
    kept = features.join(merges, "id", "left").withColumn("changed", F.col("updated").isNotNull()).withColumn("description", F.coalesce("updated", "description")).drop("updated")
    head = features.agg(F.first("model").alias("model"), F.first("version").alias("version"), F.max("ord").alias("last"))
    added = fresh.crossJoin(F.broadcast(head)).withColumn("changed", F.lit(True)).withColumn("ord", F.col("last") + 1 + F.col("place"))  # one row
    columns = ("model", "version", "id", "parent_id", "name", "description", "ord", "changed")
    out = kept.select(*columns).unionByName(added.select(*columns))
    any_ = out.agg(F.coalesce(F.bool_or("changed"), F.lit(False)).alias("any_changed"))
    out = out.crossJoin(F.broadcast(any_)).withColumn("version", F.when(F.col("any_changed"), s.next_patch("version")).otherwise(F.col("version")))
    return out.drop("changed", "any_changed"), out.where("changed").select("id", "name")


def _model(spark, d):
    b = table(spark, d, "benchmark")
    return b.select(
        F.lit("domain").alias("model"), F.lit("1.0.0").alias("version"), F.concat(F.lit("f"), "item_id").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.concat(F.lit("feature "), "item_id").alias("name"),
        F.col("text").alias("description"), F.col("item_id").alias("ord"),
    )


def _decisions(spark, d):
    kind = F.expr("CASE c_mktsegment WHEN 'BUILDING' THEN 'ADD_NEW_FEATURE' WHEN 'MACHINERY' THEN 'ADD_SUB_FEATURE' WHEN 'HOUSEHOLD' THEN 'MERGE_FEATURE' ELSE 'IGNORE' END")
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("ord"), kind.alias("action"), F.concat(F.lit("new "), "c_nationkey").alias("new_feature_name"), F.expr("CASE WHEN c_custkey % 5 <> 0 THEN c_name END").alias("new_feature_description"),
        F.concat(F.lit("f"), F.col("c_custkey") % 50).alias("parent_feature_id"), F.concat(F.lit("f"), "c_nationkey").alias("target_feature_id"), F.col("c_name").alias("updated_description"),
    )


@query("""WITH f AS (SELECT 'f' || item_id AS id, 'feature ' || item_id AS name, text AS description, item_id AS ord FROM benchmark),
k AS (SELECT c_custkey AS ord, c_mktsegment AS kind, 'new ' || c_nationkey AS name, 'f' || (c_custkey % 50) AS parent, 'f' || c_nationkey AS target, c_name FROM customer),
a AS (SELECT CASE WHEN kind = 'MACHINERY' THEN parent END AS parent_id, name, c_name AS description, ord FROM k WHERE ord % 5 <> 0 AND (kind = 'BUILDING' OR (kind = 'MACHINERY' AND parent IN (SELECT id FROM f)))),
n AS (SELECT *, row_number() OVER (PARTITION BY parent_id, name ORDER BY ord) AS nth FROM a),
m AS (SELECT target AS id, max_by(c_name, ord) AS updated FROM k WHERE kind = 'HOUSEHOLD' GROUP BY 1)
SELECT '1.0.1' AS version, 'feat_' || sha1(COALESCE(parent_id, '') || chr(1) || name || chr(1) || nth) AS id, parent_id, name, description, (SELECT MAX(ord) FROM f) + 1 + ord AS ord FROM n
UNION ALL SELECT '1.0.1', f.id, NULL, f.name, COALESCE(m.updated, f.description), f.ord FROM f LEFT JOIN m USING (id)""")
def model_evolution(spark, d):
    out, _ = evolve(_model(spark, d), _decisions(spark, d))
    return out.select("version", "id", "parent_id", "name", "description", "ord")


@query("SELECT 'f' || item_id AS id, COALESCE(m.updated, text) AS description FROM benchmark LEFT JOIN (SELECT c_nationkey AS item_id, max_by(c_name, c_custkey) AS updated FROM customer WHERE c_mktsegment = 'HOUSEHOLD' GROUP BY 1) m USING (item_id)")
def merged_features(spark, d):
    out, _ = evolve(_model(spark, d), _decisions(spark, d))
    return out.where("id LIKE 'f%' AND name LIKE 'feature %'").select("id", "description")


@query()
def feature_mapping(spark, d):
    raw = table(spark, d, "conversations").select(F.concat_ws(".", "conv_id", "turn").alias("raw_id"), "text")
    standard = table(spark, d, "benchmark").select(F.concat(F.lit("f"), "item_id").alias("standard_id"), "text")
    return map_features(raw, standard)


@query()
def function_documents(spark, d):
    """Documents of suppliers, nations and regions, what is used before what uses it."""
    r, n, su = (table(spark, d, t) for t in ("region", "nation", "supplier"))
    rows = r.select(F.col("r_name").alias("name"), F.lit("region").alias("code")).unionAll(n.select("n_name", F.lit("nation"))).unionAll(su.select("s_name", F.lit("supplier"))).dropDuplicates(["name"])
    edges = su.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("src"), F.col("n_name").alias("dst")).unionAll(n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")).distinct().where("src <> dst")
    return document_functions(rows, edges, Summary())


@query()
def retrieval_answers(spark, d):
    """Each turn of a user with the three nearest benchmark items as context, answered by the provider."""
    c = table(spark, d, "conversations").where("role = 'user'").select(F.concat_ws(".", "conv_id", "turn").alias("query_id"), "text")
    base = embedded(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"), "text", "v")
    near = vector.nearest(embedded(c, "text", "q").select("query_id", "q"), base.select("id", "v"), 3)
    context = near.join(base.select("id", "text"), "id").groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda x: x["text"]), "\n").alias("context"))
    prompts = c.join(context, "query_id").withColumn("prompt", F.concat_ws("\n", "text", "context"))
    return asked(prompts, "prompt", "answer", Summary()).select("query_id", "answer")


@query("SELECT source || '.c' AS filename, COUNT(*) AS functions, COUNT(*) FILTER (COALESCE(l.quality = 1, FALSE)) AS visible FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def repository_summary(spark, d):
    return functions(spark, d).groupBy("filename").agg(F.count(F.lit(1)).alias("functions"), F.count_if("visible").alias("visible"))


@query("WITH s AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user') SELECT conv_id, turn, text FROM s ANTI JOIN (SELECT conv_id, turn - 1 AS turn FROM conversations WHERE role = 'assistant' AND length(text) % 2 = 0) USING (conv_id, turn)")
def resume_missing(spark, d):
    """Rows that have no document yet: only these are asked on a run again. Answers of even length count as documents."""
    c = table(spark, d, "conversations")
    done = c.where("role = 'assistant' AND length(text) % 2 = 0").select("conv_id", (F.col("turn") - 1).alias("turn"))
    return c.where("role = 'user'").select("conv_id", "turn", "text").join(done, ["conv_id", "turn"], "left_anti")


def ranked_first(rows: DataFrame, by: str, order: str) -> DataFrame:
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(order))).where("nth = 1").drop("nth")


def draft_modules(clusters: DataFrame, docs: DataFrame, provider: Provider) -> tuple[DataFrame, DataFrame]:
    """(modules, members): a module a cluster, described by the provider from up to 20 of its functions' documents; every function in one module.

    clusters(id, label), docs(id, doc). Single functions stay in a module only where it is the only one.
    """
    rows = clusters.join(docs, "id", "left")
    sizes = clusters.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    one = sizes.agg(F.count(F.lit(1)).alias("modules"))
    kept = sizes.crossJoin(F.broadcast(one)).where("n > 1 OR modules = 1").select("label")  # one row
    preview = lookup.first_k(rows, ["label"], [F.col("id")], 20).groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", F.coalesce("doc", F.lit("")).alias("doc")))), lambda x: x["doc"]), "\n").alias("prompt"))
    modules = asked(preview.join(kept, "label"), "prompt", "description", provider).select("label", F.concat(F.lit("Module "), "label").alias("name"), "description")
    named = clusters.join(kept, "label").select(F.col("label").alias("module_ord"), F.col("id").alias("pos"), F.col("id").alias("item"))
    return modules, lookup.repair_partition(named, clusters.select(F.col("id").alias("item")))


def enhance(modules: DataFrame, provider: Provider) -> DataFrame:
    """Descriptions asked again from themselves; where the provider fails the draft stays."""
    return asked(modules, "description", "better", provider).withColumn("description", F.coalesce("better", "description")).drop("better")


def initial_model(profiles: DataFrame, domain: str) -> DataFrame:
    """A first model from raw features: every distinct one is a top-level feature. profiles(repo, feature, ord)."""
    rows = distinct_in_order(profiles.select("feature", "ord"), "feature", "ord")
    return rows.select(F.lit(domain).alias("model"), F.lit("1.0.0").alias("version"), s.digest8("feature").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("feature").alias("name"), F.col("feature").alias("description"))


@query("SELECT s_name || '::' || n_name AS symbol, CASE WHEN s_nationkey < 10 THEN 'crate_' || s_nationkey ELSE 'main' END AS crate FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def symbol_crates(spark, d):
    su, n = table(spark, d, "supplier"), table(spark, d, "nation")
    rows = su.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat("s_name", F.lit("::"), "n_name").alias("symbol"), "s_name", "s_nationkey")
    crates = rows.where("s_nationkey < 10").select(F.col("s_name").alias("name"), F.concat(F.lit("crate_"), "s_nationkey").alias("crate"))
    return lookup.crates_of(rows, crates, "main")


@query()
def module_drafts(spark, d):
    """Modules of the embeddings' labels, whose documents are benchmark texts."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    docs = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("doc"))
    modules, members = draft_modules(e, docs, Summary())
    counts = members.groupBy(F.col("module_ord").alias("label")).agg(F.count(F.lit(1)).alias("functions"))
    return enhance(modules, Summary()).join(counts, "label", "left")


@query("SELECT left(sha1(f), 8) AS id, f AS name FROM (SELECT DISTINCT trim(o_orderpriority) AS f FROM orders)")
def bootstrap_model(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderpriority").alias("feature"), F.col("o_orderkey").alias("ord"))
    return initial_model(rows, "domain").select("id", "name")
