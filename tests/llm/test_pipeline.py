"""The pipeline stage by stage on the smallest table, each against what must hold of its own input."""

import pytest

import corpus_pipeline as pipeline

from repolith.llm import common, mixing
from tests.conftest import SMALL
from tests.llm.test_operators import brute_cut, brute_links


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SMALL).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(spark, stages):
    columns = spark.read.parquet(f"{SMALL}/documents.parquet").columns
    assert all(s.columns == columns for s in stages[:-1])


def test_near_duplicates_keep_one_of_each_group(stages):
    before = [(r.doc_id, r.text, "") for r in stages[0].orderBy("doc_id").collect()]
    links, seen, kept = brute_links(before), set(), set()
    for i in range(len(before)):
        if i not in seen:
            kept.add(before[i][0])
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in seen:
                    seen.add(j)
                    todo += links[j]
    assert set(texts(stages[1])) == kept


def test_substrings_cut_what_brute_force_cuts(stages):
    before = [(r.doc_id, r.text, "") for r in stages[1].collect()]
    after = texts(stages[2])
    for (name, n, gone, _), (_, text, _) in zip(brute_cut(before), before):
        assert len(after[name].split()) == n - gone
        if not gone:
            assert after[name] == text


def test_mix_repeats_whole_documents(stages):
    before, rows = texts(stages[2]), stages[3].collect()
    partial = [r for r in rows if r.text != before[r.doc_id]]
    assert len(partial) <= 2 * len({r.source for r in rows})
    assert all(before[r.doc_id].split()[: len(r.text.split())] == r.text.split() for r in partial)
    assert all(sum(r.doc_id == i for r in rows) <= 2 for i in before)


def test_packing_holds_every_token(stages):
    rows = stages[4].collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in stages[3].collect()}
    fill = {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) + 1


ODD = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (None, "some words here", "en", None, 1), (None, "other words", None, "a", 1), (3, "x y z", "en", "a", 1), (3, "x y z", "en", "a", 1),
    (7, " ".join(f"w{i}" for i in range(100)), "de", "b", 9), (7, "six words under the same id", "de", "b", 9),
]


def test_odd_rows_survive_the_filters(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    clean = pipeline._toxicity(spark, docs, SMALL)
    assert clean.columns == docs.columns and clean.count() == len(ODD)  # no labelled text among them: nothing is known of toxicity
    out = pipeline._near_duplicates(spark, docs, SMALL)
    assert out.count() == len(ODD) - 1 and out.where("doc_id = 3").count() == 1
    cut = pipeline._substrings(spark, out, SMALL)
    assert cut.count() == len(ODD) - 1 and cut.columns == docs.columns
    assert pipeline._mixing(spark, cut, SMALL).where("text = ''").count() == 0
    assert pipeline._packing(spark, docs, SMALL).count() == len(ODD)
    empty = docs.where("false")
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0


def test_near_duplicates_without_ids(spark):
    docs = spark.createDataFrame([(None, "one two three four five six seven")] * 3 + [(5, "one two three four five six seven"), (5, "something else under that id, long enough to count")], "doc_id long, text string")
    docs = docs.withColumn("source", pipeline.F.lit("a"))
    assert sorted(r.text[:3] for r in pipeline._near_duplicates(spark, docs, SMALL).collect()) == ["one", "som"]


def test_columns_with_clashing_names(spark, tmp_path):
    clashing = "size first taken again kept n_words n_removed id row rest digest score held_out block payload more_0 pass rank words target".split()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(20)
    for name in clashing:
        docs = docs.withColumn(name, pipeline.F.lit("own " + name))
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert out.columns == docs.columns and out.where(" OR ".join(f"`{c}` <> 'own {c}'" for c in clashing)).count() == 0
            docs = out


def test_rows_of_one_id_are_mixed_each_by_its_size(spark):
    long, short = " ".join(f"w{i}" for i in range(100)), "six words under the same id"
    docs = spark.createDataFrame([(7, long, "b"), (7, short, "b"), (8, "eight", "c")], "doc_id long, text string, source string")
    out = [r.text for r in pipeline._mixing(spark, docs, SMALL).collect()]
    assert all(long.startswith(x) or short.startswith(x) or x == "eight" for x in out) and sum(long.startswith(x) for x in out) <= 2 and sum(short.startswith(x) for x in out) <= 2


def test_mixing_measures_texts_in_the_table_it_numbers(spark):
    docs, before = spark.read.parquet(f"{SMALL}/documents.parquet"), set(common.written)
    pipeline._mixing(spark, docs, SMALL)
    assert sorted(x.rsplit("/", 1)[1].rsplit("-", 1)[0] for x in common.written if x not in before) == ["mix-sources", "numbered"]
    stored = common.saved(mixing.measured(docs), "measured")
    assert sorted(mixing.mix_sources(stored, is_measured=True).collect()) == sorted(mixing.mix_sources(docs).collect())


def test_a_text_of_twelve_megabytes(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(1_500_000))
    docs = spark.createDataFrame([(1, long, "en", "a", len(long)), (2, "a short one", "en", "a", 11)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    pieces = docs.where("doc_id = 1").count()
    assert pieces > 4000
