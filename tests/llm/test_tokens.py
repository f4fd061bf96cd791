"""Token files and packing against the library's own encoding of whole texts."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from repolith.llm import packing, simple8b, token_files, tokens

ROWS = [(3, "Hello  world,\n\nit's\ta test of 日本語 spaces"), (1, None), (2, ""), (2, ""), (7, " lead and trail \n"), (None, "no id"), (9, "word " * 5000)]


def encoded(name, text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.vocabulary(name))
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=300), st.sampled_from([7, 64, 4096]))
def test_simple8b_round_trip(ids, block):
    data = simple8b.pack(np.array(ids, np.uint64), block)
    assert simple8b.unpack(data).tolist() == ids
    assert simple8b.unpack(data, 10, 30).tolist() == ids[10:30]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in ROWS], "doc_id long, text string, start string, part string")


def test_token_files(spark, docs, tmp_path):
    token_files.write_token_ids(docs, str(tmp_path / "ids"), tokens.vocabulary("byte_bpe_50k.json"), shard_ids=100)
    got = sorted((r.start, -1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read_token_ids(spark, str(tmp_path / "ids")).collect())
    want, start = [], 0
    for i, text in sorted(ROWS, key=lambda r: (-1 if r[0] is None else r[0], r[1] or "")):
        ids = encoded("byte_bpe_50k.json", text)
        want.append((start, -1 if i is None else i, len(ids), crc(ids)))
        start += len(ids)
    assert got == want


def test_a_shard_is_a_row_group(spark, tmp_path):
    many = spark.range(0, 400, 1, 1).selectExpr("id AS doc_id", "repeat('word and word ', 20) AS text")
    token_files.write_token_ids(many, str(tmp_path / "ids"), tokens.vocabulary("byte_bpe_50k.json"), shard_ids=1000)
    files = [pq.ParquetFile(x).metadata for x in (tmp_path / "ids").glob("*.parquet")]
    groups = [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]
    assert len(groups) > 4 * len(files) and set(groups) == {1}
    columns = [m.row_group(0).column(j) for m in files for j in range(m.num_columns)]
    assert {c.compression for c in columns} == {"UNCOMPRESSED"} and not any("DICTIONARY" in x for c in columns for x in c.encodings)
    assert token_files.read_token_ids(spark, str(tmp_path / "ids")).count() == 400


def test_empty_table(spark, docs, tmp_path):
    token_files.write_token_ids(docs.where("false"), str(tmp_path / "ids"), tokens.vocabulary("byte_bpe_50k.json"))
    assert token_files.read_token_ids(spark, str(tmp_path / "ids")).count() == 0
    assert packing.pack_documents(docs.where("false"), tokens.vocabulary("word_bpe_49k.json")).count() == 0


def check_packing(rows, source, capacity):
    want = Counter()
    for i, text in source:
        ids = encoded("word_bpe_49k.json", text)
        want.update((i, k, s, crc(ids[s : s + capacity])) for k, s in enumerate(range(0, len(ids), capacity)))
    assert Counter((r.doc_id, r.piece, r.start, r.ids_crc32) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held), -(-sum(r.length for r in rows) // capacity)


def test_packing_edges(docs):
    rows = packing.pack_documents(docs, tokens.vocabulary("word_bpe_49k.json")).collect()
    used, least = check_packing(rows, ROWS, 2048)
    assert used == least


def test_packing_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack_documents(docs, tokens.vocabulary("word_bpe_49k.json")).collect()
    used, least = check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()], 2048)
    assert used <= least + 1


def fewest(lengths, capacity):
    """The optimum, by trying every bin for every item."""
    best = len(lengths)

    def place(i, spaces):
        nonlocal best
        if len(spaces) >= best:
            return
        if i == len(lengths):
            best = len(spaces)
            return
        for space in set(spaces):
            if space >= lengths[i]:
                rest = list(spaces)
                rest.remove(space)
                place(i + 1, [*rest, space - lengths[i]])
        place(i + 1, [*spaces, capacity - lengths[i]])

    place(0, [])
    return best


@pytest.mark.parametrize("low, high, n", [(300, 1200, 2000), (500, 900, 1500), (300, 1000, 1500)])
def test_local_search_beats_best_fit(low, high, n):
    lengths = np.random.default_rng(5).integers(low, high, n)
    plain, bins = packing.best_fit(lengths, 2048), packing.pack(lengths, 2048)
    assert np.bincount(bins, weights=lengths).max() <= 2048 and len(bins) == n
    assert bins.max() + 1 < plain.max() + 1


def test_local_search_finds_the_fewest():
    rng = np.random.default_rng(7)
    found, gained = [], 0
    for _ in range(60):
        lengths = np.sort(rng.integers(15, 60, 11))[::-1]
        used = int(packing.pack(lengths, 100).max()) + 1
        gained += int(packing.best_fit(lengths, 100).max()) + 1 - used
        found.append((used, fewest(lengths.tolist(), 100)))
    assert all(a >= b for a, b in found) and sum(a == b for a, b in found) >= 59 and gained >= 1


def test_pairs_of_many_short_items():
    lengths = np.array([60, 55] + [1] * 10 + [2] * 10 + [3] * 10 + [5] * 5)
    bins = packing.pack(lengths, 100)
    assert np.bincount(bins, weights=lengths).max() <= 100 and bins.max() + 1 == 2
