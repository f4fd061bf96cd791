"""Every query with SQL against DuckDB at sf0.001; the others against what must hold."""


import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from repolith.plans.registry import ORACLES, QUERIES
from tests.conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def normal(frame: pd.DataFrame) -> list[tuple]:
    text = lambda x: "~" if x is None or (isinstance(x, float) and pd.isna(x)) or x is pd.NaT else f"{x:.8g}" if isinstance(x, float) else str(x)
    return sorted(tuple(text(x) for x in row) for row in frame[sorted(frame.columns)].astype(object).where(frame.notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SMALL).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert normal(ours) == normal(theirs)


def test_entry(spark):
    row = entry.entry(spark).collect()[0]
    assert row.same_software and row.overlap > 0.5


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_cycle_removal(spark):
    from repolith.operators import graph

    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5), (4, 6)], "src long, dst long")
    for most in (100, 0):
        out = graph.break_cycles(edges, graph.pagerank(edges), most)
        kept = out.where("NOT removed")
        assert graph.cyclic_core(kept.select("src", "dst")).isEmpty()
        gone = {(r.src, r.dst) for r in out.where("removed").collect()}
        assert (5, 5) in gone and not gone & {(3, 4), (4, 6)}
    acyclic = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    assert graph.break_cycles(acyclic, graph.pagerank(acyclic)).where("removed").isEmpty()


def test_cycle_removal_is_the_same_at_any_size(spark):
    from repolith.operators import graph

    rng = random.Random(4)
    rows = {(g * 100 + rng.randrange(20), g * 100 + rng.randrange(20)) for g in range(5) for _ in range(60)}
    edges = spark.createDataFrame(sorted(rows), "src long, dst long")
    ranks = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().withColumn("rank", F.pmod(F.xxhash64("node"), F.lit(7)).cast("double"))
    small, large = ({(r.src, r.dst) for r in graph.break_cycles(edges, ranks, most).where("removed").collect()} for most in (1000, 0))
    assert small == large
    assert graph.cyclic_core(spark.createDataFrame(sorted(rows - large), "src long, dst long")).isEmpty()


def test_levels_with_a_cycle(spark):
    from repolith.operators import graph

    edges = spark.createDataFrame([(1, 2), (2, 1), (1, 3), (3, 4)], "src long, dst long")
    assert {r.node: r.level for r in graph.levels(edges).collect()} == {1: -1, 2: -1, 3: 1, 4: 0}


def test_bounded_clusters_cover_all(spark):
    out = QUERIES["bounded_clusters"](spark, SMALL)
    assert out.count() == out.select("id").distinct().count() == 500


def test_documents_come_callees_first(spark):
    from repolith.plans.lifecycle import Summary, document_functions

    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "name long, code string")
    edges = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    docs = {r.name: r for r in document_functions(rows, edges, Summary()).collect()}
    assert [docs[i].level for i in (3, 2, 1)] == [0, 1, 2]
    assert all(d.doc for d in docs.values())
    again = document_functions(rows, edges, Summary(), known=spark.createDataFrame([(3, "kept")], "name long, doc string"))
    assert {r.name: r.doc for r in again.collect()}[3] == "kept"


def test_feature_mapping_is_total(spark):
    out = QUERIES["feature_mapping"](spark, SMALL).toPandas()
    assert out.confidence.between(-1.01, 1.01).all()
    assert (out.standard_id.notna() == (out.confidence >= 0.8)).all()


def test_cycle_search_takes_no_time_by_length_of_cycles():
    import time

    from repolith.operators.graph import _cycle_edges

    n, began = 20_000, time.time()
    edges = [(i, i + 1) for i in range(n)] + [(n, i) for i in range(n)]
    assert set(_cycle_edges(edges, {i: float(i) for i in range(n)} | {n: float(n)})) == {(n, i) for i in range(n)}
    assert time.time() - began < 15  # going along each cycle takes 200 million steps


def test_dedent_takes_time_in_proportion_to_lines(spark):
    import time

    from repolith.functions import scalar

    text, began = "\n".join(f"    line {i} // note" for i in range(3000)), time.time()
    out = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(scalar.dedented("t").alias("t")).collect()
    assert [r.t for r in out] == ["\n".join(f"line {i}" for i in range(3000)), None, ""]
    assert time.time() - began < 15  # 9 million lines if each finds the indent again


def test_many_queries_get_the_same_neighbours(spark):
    from repolith.operators import vector

    rng = random.Random(5)
    point = lambda: [float(rng.randrange(3)) / 3 for _ in range(4)]
    queries = spark.createDataFrame([(f"q{i}", point()) for i in range(300)], "query_id string, q array<double>")
    base = spark.createDataFrame([(f"b{i}", point()) for i in range(50)], "id string, v array<double>")
    want = sorted(vector.nearest(queries, base, 3).collect())
    assert sorted(vector.nearest(queries, base, 3, most_queries=299).collect()) == want  # one block of the base
    assert sorted(vector.nearest(queries, base, 3, most_queries=20).collect()) == want
    few = vector.nearest(queries, base, 60, most_queries=299)
    assert sorted(few.collect()) == sorted(vector.nearest(queries, base, 60).collect())
    plan = vector.nearest(queries, base, 3, most_queries=299)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan  # no pairs are shuffled, however many queries there are


def test_nearest_documents_ranks_rounded_distances(spark, tmp_path):
    """As the SQL does: distances that are equal when rounded go by id."""
    rows = pd.DataFrame({"vec_id": [1, 2, 3, 4], "embedding": [[0.001], [0.0], [-0.001], [0.0]], "label": 0})
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert normal(QUERIES["nearest_documents"](spark, str(tmp_path)).toPandas()) == normal(con.sql(ORACLES["nearest_documents"]).df())


def test_pagerank_rounds_do_not_compute_earlier_ones_again(spark):
    from repolith.operators import graph

    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    out = graph.pagerank(edges, 4, tolerance=None)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.agg(F.sum("rank")).first()[0] == pytest.approx(1)


def test_levels_and_core_take_no_round_for_each_level(spark):
    import time

    from repolith.operators import graph

    chain, began = spark.range(300).selectExpr("id AS src", "id + 1 AS dst"), time.time()
    assert {r.node: r.level for r in graph.levels(chain).collect()} == {i: 300 - i for i in range(301)}
    assert graph.cyclic_core(chain).isEmpty()
    assert time.time() - began < 60  # 300 rounds of jobs and 150 of others


def test_levels_and_core_are_the_same_by_parts(spark):
    from repolith.operators import graph

    rows = [(1, 2), (2, 3), (3, 1), (4, 1), (3, 5), (11, 12), (12, 13), (11, 13), (21, 22), (22, 22), (23, None), (None, 11), (31, None)]
    edges = spark.createDataFrame(rows, "src long, dst long")
    levels = {1: -1, 2: -1, 3: -1, 4: -1, 5: 0, 13: 0, 12: 1, 11: 2, 21: -1, 22: -1, 23: -1, 31: -1, None: 0}
    for most in (100, 4, 0):  # one task, both ways, rounds only
        found = graph.levels(edges, most).collect()
        assert len(found) == len(levels) and {r.node: r.level for r in found} == levels
        assert sorted(map(tuple, graph.cyclic_core(edges, most).collect())) == [(1, 2), (2, 3), (3, 1), (22, 22)]
