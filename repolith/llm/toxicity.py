"""Toxicity of whole texts: a bidirectional gated network over overlapping windows of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table
from .gated import Adam, GatedNetwork
from .tokens import _Places, trimmed
from .words import byte_grams, hashed

GRAM = 5
#: Bytes that no word holds: ASCII other than letters and digits.
OUTSIDE = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


class _Stretch:
    """Words of some texts: row of the word table and rows of the byte-gram table of each."""

    def __init__(self, counts: np.ndarray, words: np.ndarray, gram_of: np.ndarray, grams: np.ndarray) -> None:
        self.counts, self.words, self.gram_of, self.grams = counts, words, gram_of, grams


class ToxicityModel:
    """Word and character inputs, one network; a text's score is that of its worst window."""

    def __init__(self, window: int = 32, stride: int = 16, word_size: int = 6, gram_size: int = 4, seed: int = 5) -> None:
        self.window, self.stride, self.word_size, self.gram_size, self.seed = window, stride, word_size, gram_size, seed

    # inputs

    @staticmethod
    def _evidence(with_1: np.ndarray, with_0: np.ndarray, n_1: int, n_0: int) -> np.ndarray:
        """How surely a feature leans to a label: the signed root of its likelihood ratio statistic, 3 and less counting as none, on a log scale."""
        n, both = n_1 + n_0, with_1 + with_0
        term = lambda seen, expected: seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9))
        table = (with_1, both * n_1 / n), (with_0, both * n_0 / n), (n_1 - with_1, (n - both) * n_1 / n), (n_0 - with_0, (n - both) * n_0 / n)
        root = np.sqrt(np.maximum(0, 2 * sum(term(*x) for x in table)))
        return (np.sign(with_1 * n_0 - with_0 * n_1) * np.log1p(np.maximum(0, root - 3))).astype(np.float32)

    def _vocabulary(self, lists: list[np.ndarray], labels: np.ndarray, least: int, sure: float) -> tuple[_Places, np.ndarray]:
        """Features in ``least`` texts or more whose evidence is at least ``sure`` either way, and that evidence."""
        flat = np.concatenate([np.unique(x) for x in lists]) if lists else np.empty(0, np.uint64)
        label = np.repeat(labels, [len(np.unique(x)) for x in lists])
        keys, index = np.unique(flat, return_inverse=True)
        ones = np.bincount(index, weights=label, minlength=len(keys))
        all_ = np.bincount(index, minlength=len(keys))
        lean = self._evidence(ones, all_ - ones, int(labels.sum()), int((1 - labels).sum()))
        held = (all_ >= least) & (np.abs(lean) >= sure)
        places = _Places()
        places.add(np.maximum(keys[held], 1), np.arange(int(held.sum()), dtype=np.int32))
        return places, lean[held]

    def _stretches(self, texts: pa.Array, most: int = 1 << 20) -> Iterator[_Stretch]:
        for _, counts, h, data, starts, ends in hashed(texts, lower=True, most=most, outside=OUTSIDE):
            of, grams = byte_grams(data, starts, ends, GRAM, OUTSIDE)
            place = self.gram_places.find(grams)
            known = place >= 0
            yield _Stretch(counts, self.word_places.find(h) + 1, of[known], place[known])

    def _inputs(self, s: _Stretch, own: np.ndarray | None = None) -> np.ndarray:
        """A row for each word, or for the words at ``own``, and an empty one for what stands past a text's end."""
        words, gram_of, grams = self._features(s, own)
        n = len(words)
        out = np.zeros((n + 1, self.word_size + self.gram_size), np.float32)
        out[:n, : self.word_size] = self.words[words]
        if len(grams):
            shares = np.bincount(gram_of, minlength=n)
            for j in range(self.gram_size):
                out[:n, self.word_size + j] = np.bincount(gram_of, weights=self.grams[grams, j], minlength=n) / np.maximum(shares, 1)
        return out

    @staticmethod
    def _features(s: _Stretch, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the word table, and rows of the gram table with the word that each belongs to."""
        if own is None:
            return s.words, s.gram_of, s.grams
        low, high = np.searchsorted(s.gram_of, own), np.searchsorted(s.gram_of, own, "right")
        each = high - low
        places = np.arange(int(each.sum())) + np.repeat(low - np.cumsum(each) + each, each)
        return s.words[own], np.repeat(np.arange(len(own)), each), s.grams[places]

    def _windows(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the words of every window, -1 past the end; text of each window)."""
        each = np.maximum(1, -(-(counts - self.window) // self.stride) + 1)
        of = np.repeat(np.arange(len(counts)), each)
        first = (np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)) * self.stride
        places = first[:, None] + np.arange(self.window)
        base = (np.cumsum(counts) - counts)[of]
        return np.where(places < counts[of][:, None], places + base[:, None], -1), of

    # scores

    def _logits(self, s: _Stretch, block: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        projected = self.net.project(self._inputs(s))
        places, of = self._windows(s.counts)
        out = np.empty(len(places), np.float32)
        for low in range(0, len(places), block):
            own = places[low : low + block]
            out[low : low + block] = self.net.forward(projected[own], (own >= 0).astype(np.float32))
        return out, places, of

    def _leans(self, s: _Stretch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows with the sums of their words' evidence instead of logits."""
        places, of = self._windows(s.counts)
        of_grams = np.bincount(s.gram_of, weights=self.gram_lean[s.grams], minlength=len(s.words)) / np.maximum(1, np.bincount(s.gram_of, minlength=len(s.words)))
        return np.append(self.word_lean[s.words] + of_grams, 0)[places].sum(axis=1), places, of

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = []
        # a few hundred texts and 256 KB at a time: a worker's memory doesn't follow the size of its batches
        for s in self._stretches(texts, 1 << 18):
            logits, _, of = self._logits(s)
            out.append(np.maximum.reduceat(logits, np.searchsorted(of, np.arange(len(s.counts)))))
        logits = np.concatenate(out).astype(np.float64) if out else np.empty(0)
        return 1 / (1 + np.exp(-(logits - self.shift)))

    # training

    def fit(self, texts: list[str | None], labels: list[int], steps: int = 300, batch: int = 64, rate: float = 0.01, table_rate: float = 0.02, dropped: float = 0.2, natural: float | None = None) -> "ToxicityModel":
        """Learns from labelled texts: each epoch takes the worst window of every text, and any other of clean ones."""
        y = np.array(labels, np.float32)
        rng = np.random.default_rng(self.seed)
        column = pa.array(texts, pa.string())
        words, grams = [], []
        for _, counts, h, data, starts, ends in hashed(column, lower=True, outside=OUTSIDE):
            of, g = byte_grams(data, starts, ends, GRAM, OUTSIDE)
            stops = np.cumsum(counts)
            gram_stops = np.searchsorted(of, stops)
            words += np.split(h, stops[:-1])
            grams += np.split(g, gram_stops[:-1])
        # evidence chooses the features and the first windows to learn from; it is no input
        self.word_places, lean = self._vocabulary(words, y, 3, 0)
        self.word_lean = np.append(np.float32(0), lean)
        self.words = np.concatenate([np.zeros((1, self.word_size)), rng.standard_normal((len(lean), self.word_size)) * 0.05]).astype(np.float32)
        self.gram_places, lean = self._vocabulary(grams, y, 4, 0.3)
        self.gram_lean = np.append(lean, np.float32(0))[: max(1, len(lean))]
        self.grams = (rng.standard_normal((max(1, len(lean)), self.gram_size)) * 0.05).astype(np.float32)
        self.net, self.shift = GatedNetwork(self.word_size + self.gram_size, seed=self.seed), 0.0
        if not len(y):
            return self
        stretches = list(self._stretches(column))
        firsts = np.cumsum([0, *(len(s.counts) for s in stretches)])
        adam, tables, done, rated_at = Adam(rate), (Adam(table_rate, sparse=True), Adam(table_rate, sparse=True)), 0, None
        while done < steps:
            # which windows speak for their texts: by evidence at first, then by the network, six times in all
            if rated_at is None or done - rated_at >= steps / 6:
                rated = [self._leans(s) if rated_at is None else self._logits(s) for s in stretches]
                rated_at = done
            picked: list[tuple[int, np.ndarray, float]] = []
            for at, s in enumerate(stretches):
                logits, places, of = rated[at]
                cuts = np.append(np.searchsorted(of, np.arange(len(s.counts))), len(of))
                for i, (low, high) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())):
                    label = float(y[firsts[at] + i])
                    picked.append((at, places[low + int(np.argmax(logits[low:high]))], label))
                    if not label:
                        picked.append((at, places[int(rng.integers(low, high))], label))
            ones = sum(x[2] for x in picked)
            weight = {1.0: 0.5 * len(picked) / max(1, ones), 0.0: 0.5 * len(picked) / max(1, len(picked) - ones)}
            by_stretch = [[] for _ in stretches]
            for at, places, label in picked:
                by_stretch[at].append((places, label))
            order = rng.permutation(len(stretches))
            for at in order.tolist():
                s, own = stretches[at], by_stretch[at]
                own = [own[i] for i in rng.permutation(len(own))]
                for low in range(0, len(own), batch):
                    places = np.array([p for p, _ in own[low : low + batch]])
                    target = np.array([t for _, t in own[low : low + batch]], np.float32)
                    mask = (places >= 0).astype(np.float32)
                    used = np.unique(places[places >= 0])
                    at_used = np.where(places >= 0, np.searchsorted(used, places), len(used))
                    # a fifth of the words are left out of a step, so that no single one decides
                    at_used[rng.random(at_used.shape) < dropped] = len(used)
                    x = self._inputs(s, used)[at_used]
                    keep: dict = {}
                    logit = self.net.forward(self.net.project(x), mask, keep)
                    d = (1 / (1 + np.exp(-logit)) - target) * np.array([weight[t] for t in target.tolist()], np.float32) / len(target)
                    grad, d_x = self.net.backward(x, keep, d.astype(np.float32))
                    adam.step(self.net.p, grad)
                    self._tune(s, used, at_used, d_x, tables)
                    done += 1
        logits = np.concatenate([np.maximum.reduceat(l, np.searchsorted(of, np.arange(len(s.counts)))) for s in stretches for l, _, of in [self._logits(s)]])
        self.shift = self._threshold(logits.astype(np.float64), y, natural)
        return self

    def _tune(self, s: _Stretch, used: np.ndarray, at_used: np.ndarray, d_x: np.ndarray, tables: tuple[Adam, Adam]) -> None:
        """A step on the rows of both tables that a batch used; row 0 of the words, unknown ones, stays zero."""
        of_words = np.zeros((len(used) + 1, d_x.shape[2]), np.float32)
        np.add.at(of_words, at_used.ravel(), d_x.reshape(-1, d_x.shape[2]))
        words, gram_of, grams = self._features(s, used)
        step = np.zeros_like(self.words)
        np.add.at(step, words, of_words[:-1, : self.word_size])
        step[0] = 0
        tables[0].step({"words": self.words}, {"words": step})
        if len(grams):
            step = np.zeros_like(self.grams)
            np.add.at(step, grams, (of_words[:-1, self.word_size :] / np.maximum(1, np.bincount(gram_of, minlength=len(used)))[:, None])[gram_of])
            tables[1].step({"grams": self.grams}, {"grams": step})

    @staticmethod
    def _threshold(logits: np.ndarray, y: np.ndarray, natural: float | None) -> float:
        """The logit at which predicted labels have fewest errors, both classes weighted as they come by nature."""
        share = natural if natural is not None else float(y.mean())
        order = np.argsort(logits)
        z, t = logits[order], y[order]
        weight = np.where(t == 1, share / max(1, t.sum()), (1 - share) / max(1, (1 - t).sum()))
        errors = np.append(0, np.cumsum(np.where(t == 1, weight, 0))) + np.append(np.cumsum(np.where(t == 0, weight, 0)[::-1])[::-1], 0)
        best = np.flatnonzero(errors <= errors.min() + 1e-12)
        at = int(best[len(best) // 2])
        edges = np.concatenate([[z[0] - 2], (z[1:] + z[:-1]) / 2, [z[-1] + 2]])
        return float(edges[at])


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id is in no held-out fold."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def train(docs: DataFrame, labels: DataFrame, sample: int = 800, longest: int = 1 << 17, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Fits the model on at most ``sample`` labelled texts of either label, by md5 of the id, of at most ``longest`` bytes, none of fold 0.

    Labels other than 0 and 1 and null ids don't count; of several labels of an id the largest does;
    null and empty texts train as empty ones, repeated rows each. Without labelled texts, or with an
    empty table, the model is an untrained network that predicts 0 throughout.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (fold(id_col, folds) != 0)).groupBy(id_col).agg(F.max(label_col).alias("label"))
    shares = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    mark = F.md5(F.concat(F.lit("toxic"), F.col(id_col).cast("string")))
    chosen = None
    for label in (0, 1):
        part = known.where(F.col("label") == label).withColumn("mark", mark).orderBy("mark").limit(sample)
        chosen = part if chosen is None else chosen.unionAll(part)
    # at most 2 * sample rows, hence broadcast
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= longest).join(F.broadcast(chosen.select(id_col, "label", "mark")), id_col).select("mark", "text", "label").collect()
    rows.sort(key=lambda r: (r["mark"], r["text"] or ""))
    total = sum(shares.values())
    return ToxicityModel().fit([r["text"] for r in rows], [r["label"] for r in rows], natural=shares.get(1, 0) / total if total else None)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """Scores every whole text: the largest over all windows of 32 words, 16 apart.

    One row per input row: id, held_out, score (0 to 1), predicted (score >= 0.5). Null and empty
    texts, and those without letters or digits, get the score of an empty window; repeated rows are
    scored each; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.scores(batch.column(2)))], names=["id", "held_out", "score"])

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(fold(id_col, folds) == 0, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    scored = plain.mapInArrow(trimmed(run), "id long, held_out boolean, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows, all columns as they are, whose score is below 0.5; nothing is shuffled."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(model.scores(batch.column(place)) < 0.5))

    return docs.mapInArrow(trimmed(run), docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
