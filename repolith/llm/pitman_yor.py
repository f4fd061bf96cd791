"""Language-model scoring with a hierarchical Pitman-Yor model."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, drop, groups, partitions, saved, table, written
from .exchange import ASKED, answered, answers_of, asked_rows, by_bucket, make_blocks, open_block, rows_of, with_answers
from .tokens import trimmed
from .words import hashed, mixed

#: The end of a text, and the context of its first token.
END = int(mixed(np.array([0x656E64], np.uint64))[0])


class _Tokens:
    """Tokens of a block: hashes, the text and the fold of each, and the token before it."""

    def __init__(self, payload: bytes, folds: int, held_out: int) -> None:
        self.ids, texts, *_ = open_block(payload)
        counts, words = [np.empty(0, np.int64)], []
        for _, n, h, *_ in hashed(texts, lower=True):
            counts.append(n)
            words.append(h)
        self.counts = np.concatenate(counts) + 1
        stops = np.cumsum(self.counts)
        self.h = np.full(int(stops[-1]) if len(stops) else 0, END, np.uint64)
        is_word = np.ones(len(self.h), bool)
        is_word[stops - 1] = False
        if words:
            self.h[is_word] = np.concatenate(words)
        self.before = np.empty_like(self.h)
        self.before[1:] = self.h[:-1]  # the end of the text before stands for the start
        if len(self.h):
            self.before[0] = END
        names = self.ids.to_pylist()
        self.held_out = np.array([x is not None and crc32(str(x).encode()) % folds == held_out for x in names], bool)
        self.trains = np.repeat(~self.held_out, self.counts)


class _Pairs:
    """A block's distinct (token, context) pairs by token hash, with how often training texts have each."""

    def __init__(self, t: _Tokens) -> None:
        self.words, of = np.unique(t.h, return_inverse=True)
        contexts, context = np.unique(t.before, return_inverse=True)
        keys, self.of_token = np.unique(of * len(contexts) + context, return_inverse=True)
        self.counts = np.bincount(self.of_token, weights=t.trains, minlength=len(keys)).astype(np.uint32)
        word_of, at = np.divmod(keys, max(1, len(contexts)))
        self.contexts = contexts[at]
        self.each = np.bincount(word_of, minlength=len(self.words))
        self.first = np.cumsum(self.each) - self.each
        self.of_word = of

    def in_order(self, words: np.ndarray) -> np.ndarray:
        """Places of the pairs of ``words``, in turn."""
        each = self.each[words]
        stops = np.cumsum(each)
        return np.arange(int(stops[-1]) if len(stops) else 0) + np.repeat(self.first[words] - stops + each, each)


def _write(arrays: list[np.ndarray]) -> bytes:
    """Arrays, compressed: counts and numbers are small."""
    raw = b"".join(a.tobytes() for a in arrays)
    return np.array([len(raw), *map(len, arrays)], np.int64).tobytes() + pa.Codec("zstd").compress(raw, asbytes=True)


def _read(data: bytes, kinds: tuple) -> list[np.ndarray]:
    size, *lengths = np.frombuffer(data, np.int64, 1 + len(kinds)).tolist()
    raw = pa.Codec("zstd").decompress(memoryview(data)[8 * (1 + len(kinds)) :], size, asbytes=True)
    at, out = 0, []
    for n, kind in zip(lengths, kinds):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


#: Words, pairs of each, contexts and counts of the pairs, as a block sends them; a bucket's pairs, merged, with the
#: distinct contexts and the place of each pair's among them.
PAIRS, MERGED = (np.uint64, np.uint32, np.uint64, np.uint32), (np.uint32, np.uint64, np.int32, np.int64)
#: Contexts, their tables and customers.
TOTALS = (np.uint64, np.int64, np.int64)


def seat(counts: np.ndarray, parent: np.ndarray, strength: np.ndarray, discount: float, rng: np.random.Generator, exact: int = 64) -> np.ndarray:
    """Tables of each dish after its customers come back one after another.

    A customer opens a table with weight strength * parent (strength is theta + discount * tables of
    the restaurant, the other dishes seated) and joins one with weight customers - discount * tables.
    From ``exact`` customers on they come in groups of an eighth of those seated, whose new tables
    are one binomial draw.
    """
    tables = np.minimum(counts, 1).astype(np.int64)
    many = np.flatnonzero(counts > 1)
    many = many[np.argsort(-counts[many], kind="stable")]
    c, pull, t = counts[many], (strength * parent)[many], np.ones(len(many), np.int64)
    done = 1
    while len(c) and done < c[0]:
        step = 1 if done < exact else done // 8
        n = int(np.searchsorted(-c, -done, "left"))  # those with more customers than are seated
        new = pull[:n] / (pull[:n] + done + (step - 1) / 2 - discount * t[:n])
        t[:n] += rng.random(n) < new if step == 1 else rng.binomial(np.minimum(step, c[:n] - done), np.clip(new, 0, 1))
        done += step
    tables[many] = np.minimum(t, c)
    return tables


def _rising(x: np.ndarray) -> bytes:
    """Rising numbers, small: their steps, compressed."""
    steps = np.diff(x, prepend=x[:1] * 0).astype(np.uint32)
    return np.int64(len(x)).tobytes() + pa.Codec("zstd").compress(steps.tobytes(), asbytes=True)


def _risen(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    return np.cumsum(np.frombuffer(pa.Codec("zstd").decompress(data[8:], 4 * n, asbytes=True), np.uint32), dtype=np.int64)


def merge(payloads: list[bytes]) -> tuple[bytes, list[list[bytes]]]:
    """A bucket's distinct pairs by word, and the places of each block's words and pairs among them, which rise."""
    parts = [_read(p, PAIRS) for p in payloads]
    words, each, contexts, counts = (np.concatenate(x) for x in zip(*parts))
    words, word_of = np.unique(words, return_inverse=True)
    contexts, context_of = np.unique(contexts, return_inverse=True)
    keys, pair_of = np.unique(np.repeat(word_of, each) * len(contexts) + context_of, return_inverse=True)
    word, context = np.divmod(keys, len(contexts))
    total = np.bincount(pair_of, weights=counts, minlength=len(keys)).astype(np.int64)
    places, w, p = [], 0, 0
    for part in parts:
        places.append([_rising(word_of[w : w + len(part[0])]), _rising(pair_of[p : p + len(part[2])])])
        w, p = w + len(part[0]), p + len(part[2])
    return _write([np.bincount(word, minlength=len(words)).astype(np.uint32), contexts, context.astype(np.int32), total]), places


def sum_contexts(_: int, payloads: list[bytes]) -> list[bytes]:
    """Tables and customers of each context that a bucket asks for, over all buckets."""
    parts = [_read(p, TOTALS) for p in payloads]
    contexts, *sums = (np.concatenate(x) for x in zip(*parts))
    _, at = np.unique(contexts, return_inverse=True)
    sums = [np.bincount(at, weights=x).astype(np.int64)[at] for x in sums]
    stops = np.cumsum([len(p[0]) for p in parts])
    return [_write([x[stop - len(p[0]) : stop] for x in sums]) for p, stop in zip(parts, stops.tolist())]


class _Bucket:
    """All pairs of the tokens of one bucket, their seating, and the totals of their contexts' restaurants."""

    def __init__(self, payload: bytes, buckets: int, answers: dict[int, bytes]) -> None:
        each, self.contexts, self.context, self.counts = _read(payload, MERGED)
        n = len(each)
        self.word = np.repeat(np.arange(n), each)
        self.order, self.cuts = by_bucket(self.contexts, buckets)
        self.T, self.C = np.zeros(len(self.contexts), np.int64), np.zeros(len(self.contexts), np.int64)
        for bucket, data in answers.items():
            own = self.order[self.cuts[bucket] : self.cuts[bucket + 1]]
            self.T[own], self.C[own] = _read(data, TOTALS[1:])
        self.tokens = np.bincount(self.word, weights=self.counts, minlength=n).astype(np.int64)
        self.tables = np.minimum(self.counts, 1)
        self.root_tables = np.minimum(self.tokens, 1)

    def customers(self) -> np.ndarray:
        """At the root: one for each table below."""
        return np.bincount(self.word, weights=self.tables, minlength=len(self.tokens)).astype(np.int64)

    def root(self, m: dict) -> np.ndarray:
        n = self.customers()
        return (n - m["d0"] * self.root_tables + (m["theta0"] + m["d0"] * m["root_tables"]) / (m["V"] + 1)) / (m["theta0"] + m["root_customers"])

    def sweep(self, m: dict, rng: np.random.Generator) -> None:
        strength = m["theta1"] + m["d1"] * np.maximum(self.T[self.context] - self.tables, 0)
        self.tables = seat(self.counts, self.root(m)[self.word], strength, m["d1"], rng)
        n = self.customers()
        others = m["theta0"] + m["d0"] * np.maximum(m["root_tables"] - self.root_tables, 0)
        self.root_tables = seat(n, np.full(len(n), 1 / (m["V"] + 1)), others, m["d0"], rng)

    def predictive(self, m: dict) -> np.ndarray:
        """A context that doesn't occur in training has no customers, which leaves the root."""
        root = self.root(m)[self.word]
        return (self.counts - m["d1"] * self.tables + (m["theta1"] + m["d1"] * self.T[self.context]) * root) / (m["theta1"] + self.C[self.context])

    def asked(self, number: int) -> pa.RecordBatch:
        """What the bucket has of each context's tables and customers."""
        t, c = (np.bincount(self.context, weights=x, minlength=len(self.contexts)).astype(np.int64) for x in (self.tables, self.counts))

        def payload(low: int, high: int) -> bytes:
            own = self.order[low:high]
            return _write([self.contexts[own], t[own], c[own]])

        return asked_rows(number, self.cuts, payload)

    def sums(self) -> np.ndarray:
        """Training tokens and distinct ones; tables and customers of the root; dishes of one and of two customers below, and at the root."""
        n = self.customers()
        below = (self.counts == 1).sum(), (self.counts == 2).sum()
        return np.array([self.tokens.sum(), (self.tokens > 0).sum(), self.root_tables.sum(), n.sum(), *below, (n == 1).sum(), (n == 2).sum()], np.int64)


def _discount(ones: float, twos: float) -> float:
    return float(np.clip((ones + 1) / (ones + 2 * twos + 2), 0.05, 0.95))


def score_texts(
    docs: DataFrame, folds: int = 7, held_out: int = 2, samples: int = 3, burn_in: int = 2, theta: tuple[float, float] = (10.0, 1.0), seed: int = 17,
    id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4 << 20,
) -> DataFrame:
    """log10 probabilities of whole texts, by add-one counts and by a hierarchical Pitman-Yor model.

    Tokens are runs of characters other than ASCII white space, A-Z as a-z, then one end. Texts whose
    crc32(id) modulo ``folds`` isn't ``held_out`` train. Every token that training texts have is a
    context with a restaurant of its own, after any other the root predicts; all restaurants share
    the root as parent, whose base is even over the V tokens and one for all others. Pairs (token,
    context) go to buckets by token as one entry a block. A bucket seats its customers by Gibbs
    sweeps, given the restaurants' totals, which are summed between rounds in buckets by context and
    go back to the buckets that asked; only sums over all come to the driver. Discounts come from
    the numbers of dishes with one and two customers. A text's score sums log10 of the predictive
    probability, averaged over ``samples`` seatings. The same input gives the same scores.

    One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score. Null
    and empty texts are the end alone; a null id trains; repeated rows count each; without training
    texts every token is unknown; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    buckets = 2 * n  # a task holds one bucket at a time
    blocks = make_blocks(docs, id_col, text_col, block_bytes)

    def ask_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            p = _Pairs(_Tokens(row["payload"], folds, held_out))
            order, cuts = by_bucket(p.words, buckets)

            def payload(low: int, high: int) -> bytes:
                own = order[low:high]
                at = p.in_order(own)
                return _write([p.words[own], p.each[own].astype(np.uint32), p.contexts[at], p.counts[at]])

            yield asked_rows(row["block"], cuts, payload)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in groups(batches, "bucket"):
            merged, places = merge(bucket["payload"].to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([bucket["bucket"][0].as_py()], pa.int64()), pa.array([merged], pa.binary()), pa.array([bucket["block"].to_pylist()], pa.list_(pa.int64())), pa.array([places], pa.list_(pa.list_(pa.binary())))], names=["block", "payload", "blocks", "places"])

    # a bucket is one row, so that no reader splits it; it asks buckets of contexts as a block does, and its answers come to where it is
    asked = blocks.mapInArrow(trimmed(ask_pairs), ASKED).repartition(n, F.col("bucket").cast("long")).sortWithinPartitions("bucket", "block")
    held = bucketed(asked.mapInArrow(trimmed(whole), "block long, payload binary, blocks array<long>, places array<array<binary>>"), "pairs", "block", n)
    stored = written[-1]
    model: dict = {"theta0": theta[0], "theta1": theta[1]}

    def totals(pairs: DataFrame, m: dict, sweeps: int) -> DataFrame:
        """Answers of the contexts' buckets after ``sweeps``; the sums over all go into the model."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in rows_of(batches):
                bucket, rng = _Bucket(row["payload"], n, answers_of(row)), np.random.default_rng([seed, row["block"], sweeps])
                for _ in range(sweeps):
                    bucket.sweep(m, rng)
                yield bucket.asked(row["block"])
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), pa.array([-1], pa.int32()), pa.array([bucket.sums().tobytes()], pa.binary())], names=["block", "bucket", "payload"])

        asked = saved(pairs.mapInArrow(trimmed(run), ASKED), "context-totals")
        sent = written[-1]
        rows = asked.where("bucket = -1").select("payload").collect()
        sums = sum((np.frombuffer(r["payload"], np.int64) for r in rows), np.zeros(8, np.int64)).tolist()
        if "V" not in m:
            m["N"], m["V"], m["d1"], m["d0"] = sums[0], sums[1], _discount(*sums[4:6]), _discount(*sums[6:])
        m["root_tables"], m["root_customers"] = sums[2:4]
        answers = saved(answered(asked.where("bucket >= 0"), sum_contexts), "context-answers")
        drop(spark, [sent])
        return answers

    pairs = held.select("block", "payload")
    first = totals(pairs.withColumn("answers", F.lit(None).cast("array<struct<bucket: int, answer: binary>>")), model, 0)
    told = written[-1]
    second = totals(with_answers(pairs, first), model, burn_in)
    drop(spark, [told])
    used = [stored, written[-1]]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            bucket, rng = _Bucket(row["payload"], n, answers_of(row)), np.random.default_rng([seed, row["block"], 10**6])
            mean = np.zeros(len(bucket.counts))
            for i in range(burn_in + samples):
                bucket.sweep(model, rng)
                if i >= burn_in:
                    mean += bucket.predictive(model) / samples
            logs = np.log10(mean).astype(np.float32)
            for block, data in zip(row["blocks"], row["places"]):
                words, own = map(_risen, data)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([row["block"]], pa.int32()), pa.array([_write([bucket.tokens[words], logs[own]])], pa.binary())], names=["block", "bucket", "payload"])

    n_tokens = model["N"]
    base_total = float(np.log10(n_tokens + model["V"] + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            t = _Tokens(row["payload"], folds, held_out)
            p = _Pairs(t)
            order, cuts = by_bucket(p.words, buckets)
            seen, logs = np.zeros(len(p.words), np.int64), np.zeros(len(p.counts))
            for bucket, data in answers_of(row).items():
                own = order[cuts[bucket] : cuts[bucket + 1]]
                seen[own], logs[p.in_order(own)] = _read(data, (np.int64, np.float32))
            cut = np.cumsum(t.counts) - t.counts
            sums = lambda x: np.add.reduceat(x, cut) if len(cut) else np.empty(0)  # noqa: E731,B023
            c = seen[p.of_word]
            yield pa.RecordBatch.from_arrays(
                [
                    t.ids, pa.array(t.held_out), pa.array(t.counts), pa.array(sums((c > 0).astype(np.int64))), pa.array(np.full(len(t.ids), n_tokens)),
                    pa.array(sums(np.log10(c + 1.0)) - t.counts * base_total), pa.array(sums(logs[p.of_token])),
                ],
                names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    schema = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    answers = saved(with_answers(held, second).mapInArrow(trimmed(answer), ASKED), "answers")
    drop(spark, used)
    return with_answers(blocks, answers).mapInArrow(trimmed(score), schema).withColumnRenamed("id", id_col)


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
