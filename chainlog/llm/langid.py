"""Language identification by a byte convolutional network, trained here in numpy on labelled texts.

A text is cut into windows of a fixed number of UTF-8 bytes, which overlap by the widest filter less one, so that each run of
bytes that the widest filter can see is in one window; the last is padded with zeros. A window's bytes become vectors, filters of several
widths pass over them, each filter's largest answer is kept, and a softmax gives the languages' probabilities. A text's are the
windows' mean, weighted by how many letters a window has; the largest is the answer, and its score.

Training takes a bounded sample (`Sample`): of each language the rows whose ids' hashes come first, and of each row a few
windows at places that a hash deals. That sample is all that comes to the driver, and the same rows give the same network.
Prediction covers whole texts of all rows, a batch of windows at a time, in one pass without a shuffle; the network is some ten
thousand numbers and travels with the task.

A null text, a text without a letter (of any script) and every text where nothing was learned give `und` with score 0. Rows
without text or label are not learned from; where fewer than two languages are left, the one language is always the answer,
with score 1. Equal texts have equal answers. Rows are never dropped. Only the named columns are read; columns with the names
of the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.workers import let_workers_import, small_batches

UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
#: Bytes of letters A-Z, a-z and of non-ASCII characters, whose number weighs a window.
LETTERS = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])
#: Windows that go through the network at once: few enough for their answers to stay in a core's cache.
BATCH = 32
#: Groups of tasks whose samples are cut before they meet.
PARTS = 256


@dataclass(frozen=True)
class Sample:
    """Bounds of what is learned from: rows of a language, rows in all, windows of a row."""

    per_lang: int = 500
    total: int = 20_000
    windows: int = 4


@dataclass(frozen=True)
class Net:
    window: int = 256
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16
    size: int = 8
    epochs: int = 6
    batch: int = 64
    rate: float = 0.01
    seed: int = 13

    @property
    def alive(self) -> np.ndarray:
        """Whether a filter sees the byte at an offset (widest x all filters)."""
        widths = np.repeat(sorted(self.widths, reverse=True), self.filters)
        return np.arange(max(self.widths))[:, None] < widths


@dataclass
class Model:
    """weights: bytes (256 x size), filters (widest x size x all filters, the widest first, zero beyond a filter's width), out."""

    net: Net
    langs: list[str]
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """As a byte is one of 256, each filter row's answer to it is looked up instead of multiplied."""
        w, places = self.weights, self.net.window - max(self.net.widths) + 1
        at = windows.astype(np.intp)
        total = np.take(w["bytes"] @ w["filters"][0], at[:, :places], axis=0)
        for k, rows in enumerate(w["filters"][1:], 1):
            total += np.take(w["bytes"] @ rows, at[:, k : k + places], axis=0)
        hidden = np.maximum(largest(total) + w["bias"], 0)
        return softmax(hidden @ w["out"] + w["out_bias"])

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy."""
        net, w = self.net, self.weights
        widest, size, n = w["filters"].shape
        seen = w["bytes"][windows].reshape(len(windows), -1)
        columns = sliding_window_view(seen, widest * size, axis=1)[:, ::size]
        answers = (columns.reshape(-1, widest * size) @ w["filters"].reshape(-1, n)).reshape(len(windows), -1, n)
        places = answers.argmax(axis=1)  # only the place with the largest answer learns
        before = np.take_along_axis(answers, places[:, None], axis=1)[:, 0] + w["bias"]
        hidden = np.maximum(before, 0)
        d = softmax(hidden @ w["out"] + w["out_bias"])
        d[np.arange(len(labels)), labels] -= 1
        d /= len(labels)
        down = (d @ w["out"].T) * (before > 0)
        each = np.arange(len(windows))[:, None]
        filters = np.einsum("nf,nfc->cf", down, columns[each, places]).reshape(w["filters"].shape) * net.alive[:, None]
        to_bytes = np.einsum("nf,ksf->nfks", down, w["filters"]).reshape(-1, size)
        found = {"out": hidden.T @ d, "out_bias": d.sum(axis=0), "bias": down.sum(axis=0), "filters": filters, "bytes": np.zeros_like(w["bytes"])}
        np.add.at(found["bytes"], windows[each[:, :, None], places[:, :, None] + np.arange(widest)].ravel(), to_bytes)
        return found


def largest(answers: np.ndarray) -> np.ndarray:
    """The maximum over the middle axis, by halves."""
    while (n := answers.shape[1]) > 1:
        half = n // 2
        best = np.maximum(answers[:, :half], answers[:, half : 2 * half])
        if n % 2:
            np.maximum(best[:, :1], answers[:, 2 * half :], out=best[:, :1])
        answers = best
    return answers[:, 0]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def learned(windows: np.ndarray, labels: np.ndarray, langs: list[str], net: Net = Net()) -> Model:
    """The network for windows (n x window bytes) with labels 0..len(langs)-1, by Adam. Half of the windows of each pass are cut
    short at random, so that short texts are learned as well."""
    rng = np.random.default_rng(net.seed)
    widest, n = net.alive.shape
    start = {"bytes": rng.normal(0, 1, (256, net.size)), "filters": rng.normal(0, 1, (widest, net.size, n)) * net.alive[:, None], "bias": np.zeros(n)}
    start["filters"] /= np.sqrt(widest * net.size)
    start |= {"out": rng.normal(0, 1 / np.sqrt(n), (n, len(langs))), "out_bias": np.zeros(len(langs))}
    model = Model(net, langs, {k: v.astype(np.float32) for k, v in start.items()})
    if len(langs) < 2:
        return model
    first, second = ({k: np.zeros_like(v) for k, v in model.weights.items()} for _ in range(2))
    step, steps = 0, net.epochs * -(-len(windows) // net.batch)
    for _ in range(net.epochs):
        order = rng.permutation(len(windows))
        for a in range(0, len(order), net.batch):
            some = windows[order[a : a + net.batch]].copy()
            short = np.exp(rng.uniform(np.log(8), np.log(net.window), len(some)))
            ends = np.where(rng.random(len(some)) < 0.5, short, net.window)
            some[np.arange(net.window) >= ends[:, None]] = 0
            step += 1
            rate = net.rate * (1 - step / (steps + 1))
            for k, g in model.gradients(some, labels[order[a : a + net.batch]]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.weights[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def sampled(docs: DataFrame, key: str, text: str, label: str, sample: Sample = Sample(), window: int = Net.window) -> DataFrame:
    """(label, windows) of the sample, in a fixed order: rows of each label by their key's hash. Ranks are cut in
    each task before they are shuffled, then in groups of tasks and then in all, so no task gets a language's rows."""
    body = F.encode(F.col(text), "utf-8")
    last = F.greatest(F.length("body") - window, F.lit(0))
    place = lambda i: F.pmod(F.xxhash64(F.col("k"), F.lit(i)), last + 1)
    cut = F.array(*[F.substring("body", (place(i) + 1).cast("int"), F.lit(window)) for i in range(sample.windows)])
    rows = docs.where(F.col(text).rlike(r"\p{L}") & F.col(label).isNotNull())
    rows = rows.select(F.col(label).cast("string").alias("label"), F.col(key).cast("string").alias("k"), body.alias("body"))
    rows = rows.select("label", F.xxhash64("k").alias("h"), cut.alias("windows"))
    rows = rows.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    for keys in (("label", "part"), ("label",)):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("h", "windows"))
        rows = rows.withColumn("rank", rank).where(F.col("rank") <= sample.per_lang)
    return rows.orderBy("rank", "label").limit(sample.total).select("label", "windows")


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", sample: Sample = Sample(), net: Net = Net()) -> Model:
    rows = sampled(docs, key, text, label, sample, net.window).collect()
    langs = sorted({r.label for r in rows})
    number = {lang: i for i, lang in enumerate(langs)}
    padded = b"".join(bytes(w).ljust(net.window, b"\0") for r in rows for w in r.windows)
    windows = np.frombuffer(padded, np.uint8).reshape(-1, net.window)
    return learned(windows, np.repeat([number[r.label] for r in rows], sample.windows).astype(int), langs, net)


def cut(body: bytes, net: Net) -> np.ndarray:
    """The windows of a whole text, as a view of its padded bytes."""
    overlap = max(net.widths) - 1
    step = net.window - overlap
    n = max(1, -(-len(body) // step))  # a filter may start at any byte, the last too
    return sliding_window_view(np.frombuffer(body.ljust(n * step + overlap, b"\0"), np.uint8), net.window)[::step]


def predictor(model: Model):
    """From batches of texts to frames (lang, score)."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sums = np.zeros((len(texts), max(1, len(model.langs))))
            known = np.zeros(len(texts), bool)
            waiting: list[np.ndarray] = []
            owners: list[np.ndarray] = []

            def pass_on() -> None:
                windows, rows = np.concatenate(waiting), np.concatenate(owners)
                weights = LETTERS[windows].sum(axis=1, keepdims=True)
                np.add.at(sums, rows, model.probabilities(windows) * weights)
                waiting.clear()
                owners.clear()

            have = 0
            for i, text in enumerate(texts):
                if not (model.langs and isinstance(text, str) and LETTER.search(text)):
                    continue
                known[i] = True
                windows = cut(text.encode(), model.net)
                at = 0
                while at < len(windows):
                    some = windows[at : at + BATCH - have]
                    waiting.append(some)
                    owners.append(np.full(len(some), i))
                    at, have = at + len(some), have + len(some)
                    if have == BATCH:
                        pass_on()
                        have = 0
            if have:
                pass_on()
            best = sums.argmax(axis=1)
            score = sums[np.arange(len(texts)), best] / np.where(known, sums.sum(axis=1), 1)
            names = [model.langs[b] if k else UNKNOWN for b, k in zip(best, known)]
            yield pd.DataFrame({"lang": names, "score": np.where(known, np.clip(score, 0, 1), 0.0)})

    return run


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred and score."""
    let_workers_import(docs.sparkSession)
    small_batches(docs.sparkSession)
    run = predictor(model)

    @F.pandas_udf("struct<lang:string,score:double>")
    def answer(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return run(texts)

    df = docs.drop("lang_pred", "score").withColumn("__answer", answer(text))
    return df.select(*[c for c in df.columns if c != "__answer"], F.col("__answer.lang").alias("lang_pred"), F.col("__answer.score").alias("score"))
