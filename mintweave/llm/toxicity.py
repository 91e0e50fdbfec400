"""Toxicity by a subsequence string kernel, Nystroem landmarks and a support vector machine.

The kernel compares two strings by the 4-byte subsequences they share, each occurrence spanning at most
``SPAN`` bytes and weighing ``DECAY`` per byte skipped.  Inserted characters therefore cost little, and
words spelled letter by letter ("s t u p") are closed up first.

Labels are known per text, not per word: a text is a bag of words.  Words that nearly only toxic texts hold,
beyond what chance among all words allows, are candidates; the positive examples are those that explain the
most toxic texts not explained yet, so words that merely stand beside an insult in copies of a text drop
out, and then the candidates that the machine itself takes for insults.  Words of clean texts, first a hashed
share, then those nearest the positive ones, are the negative examples.
A squared-hinge machine is trained on Nystroem features of these.  Since the kernel is a sum over shared
subsequences, the machine folds into one weight per (hashed) subsequence, so scoring a text is a pass over
its bytes: the text's margin is the highest of its words', and a logistic fit on the labelled texts turns
it into a score.

``max_texts`` bounds the labelled texts used for fitting, ``max_words`` the examples; scoring reads every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mintweave.llm import common as C
from mintweave.llm.spelling import gathered_bytes as gathered
from mintweave.session import cut

SPAN = 6
DECAY = 0.7
BITS = 18
LANDMARKS = 512
#: A candidate's largest share of clean texts, and the fewest unexplained texts that it must explain.
IMPURE = 0.05
EXPLAINS = 3
FLOOR = -3.0
_OFFSETS = [c for c in combinations(range(1, SPAN), 3)]
_WEIGHTS = [DECAY ** (c[-1] - 3) for c in _OFFSETS]


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    intercept: float
    fitted: bool = True

    def score(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.intercept, -60, 60)))


def closed_up(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes without the blanks between single-byte words; word starts, ends and words before each text."""
    data = C.LOWER[data]
    starts, ends, first = C.word_spans(data, offsets)
    if len(starts) < 2:
        return data, starts, ends, first
    single = ends - starts == 1
    owner = np.searchsorted(offsets, starts, "right")
    join = single[:-1] & single[1:] & (starts[1:] == ends[:-1] + 1) & (owner[1:] == owner[:-1])
    if not join.any():
        return data, starts, ends, first
    gone = np.zeros(len(data) + 1, np.int64)
    gone[ends[:-1][join]] = 1
    shift = np.cumsum(gone) - gone
    head, tail = np.insert(~join, 0, True), np.append(~join, True)
    return data[gone[:-1] == 0], (starts - shift[starts])[head], (ends - shift[ends])[tail], np.append(0, np.cumsum(head))[first]


def _packed(data: np.ndarray, pattern: tuple[int, int, int], n: int) -> np.ndarray:
    x = data[:n].astype(np.uint32)
    for k, step in enumerate(pattern, 1):
        x |= data[step:step + n].astype(np.uint32) << np.uint32(8 * k)
    return (x * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def _room(starts: np.ndarray, ends: np.ndarray, total: int) -> np.ndarray:
    """For every byte the bytes left in its word."""
    stop = np.zeros(total, np.int32)
    length = ends - starts
    inside = np.repeat(starts - np.append(0, np.cumsum(length)[:-1]), length) + np.arange(length.sum())
    stop[inside] = np.repeat(ends, length)
    stop[inside] -= inside.astype(np.int32)
    return stop


def _norms(length: np.ndarray) -> np.ndarray:
    """Self-similarity by length, each subsequence taken as distinct."""
    return np.sqrt(np.maximum(sum(w * w * np.maximum(length - c[-1], 0) for c, w in zip(_OFFSETS, _WEIGHTS)), 1e-9))


def margins(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """The machine's decision value of every word."""
    total = np.zeros(len(data) + 1)
    room = _room(starts, ends, len(data))
    for pattern, weight in zip(_OFFSETS, _WEIGHTS):
        n = len(data) - pattern[-1]
        if n > 0:
            total[:n] += np.where(room[:n] > pattern[-1], weights[_packed(data, pattern, n)], 0) * weight
    sums = np.append(0.0, np.cumsum(total[:-1]))
    return (sums[ends] - sums[starts]) / _norms(ends - starts) + bias


def _features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hashed subsequence and weight of each subsequence of each word, normalised."""
    data = np.frombuffer(b" ".join(words), np.uint8)
    length = np.array([len(w) for w in words])
    ends = np.cumsum(length + 1) - 1
    starts = ends - length
    room = _room(starts, ends, len(data))
    owner = np.searchsorted(ends, np.arange(len(data)), "right")
    norm = _norms(length)
    rows, columns, values = [], [], []
    for pattern, weight in zip(_OFFSETS, _WEIGHTS):
        n = max(len(data) - pattern[-1], 0)
        spot = np.flatnonzero(room[:n] > pattern[-1])
        rows.append(owner[spot])
        columns.append(_packed(data, pattern, n)[spot].astype(np.int64))
        values.append(weight / norm[owner[spot]])
    return np.concatenate(rows), np.concatenate(columns), np.concatenate(values)


def _similarity(words: list[bytes], landmarks: list[bytes]) -> np.ndarray:
    """Kernel values between words and landmarks."""
    row, column, value = _features(landmarks)
    used, column = np.unique(column, return_inverse=True)
    basis = np.zeros((len(landmarks), len(used)), np.float32)
    np.add.at(basis, (row, column), value)
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for at in range(0, len(words), 2000):
        row, column, value = _features(words[at:at + 2000])
        spot = np.searchsorted(used, column)
        spot[spot == len(used)] = 0
        hit = used[spot] == column if len(used) else np.zeros(len(column), bool)
        part = np.zeros((len(words[at:at + 2000]), len(used)), np.float32)
        np.add.at(part, (row[hit], spot[hit]), value[hit])
        out[at:at + 2000] = part @ basis.T
    return out


def train(positive: list[bytes], negative: list[bytes], cost: float = 1000.0) -> tuple[np.ndarray, float]:
    """Weights per hashed subsequence and bias of the Nystroem machine."""
    spread = lambda words, n: words if len(words) <= n else [words[i] for i in np.linspace(0, len(words) - 1, n).astype(int)]
    landmarks = list(dict.fromkeys(spread(positive, LANDMARKS * 3 // 4) + spread(negative, LANDMARKS // 4)))
    root, vectors = np.linalg.eigh(_similarity(landmarks, landmarks).astype(float))
    half = vectors / np.sqrt(np.maximum(root, 1e-4)) @ vectors.T
    x = _similarity(positive + negative, landmarks) @ half
    x = np.hstack([x, np.ones((len(x), 1))])
    y = np.repeat([1.0, -1.0], [len(positive), len(negative)])
    weight = np.repeat([0.5 / max(len(positive), 1), 0.5 / max(len(negative), 1)], [len(positive), len(negative)]) * cost * 100
    w = np.zeros(x.shape[1])
    ridge = np.append(np.ones(x.shape[1] - 1), 1e-3)
    for _ in range(30):  # Newton steps on the squared hinge
        short = 1 - y * (x @ w)
        hot = short > 0
        gradient = ridge * w - 2 * (x[hot] * (weight * y * short)[hot, None]).sum(axis=0)
        curve = np.diag(ridge) + 2 * x[hot].T @ (x[hot] * weight[hot, None])
        step = np.linalg.solve(curve, gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    folded = half @ w[:-1]
    row, column, value = _features(landmarks)
    weights = np.zeros(1 << BITS, np.float32)
    np.add.at(weights, column, folded[row] * value)
    return weights, float(w[-1])


def _margins_of(batch: pa.RecordBatch, text: str, weights: np.ndarray, bias: float) -> np.ndarray:
    """The highest decision value among the words of every text of a batch, at least ``FLOOR``."""
    best = np.full(batch.num_rows, FLOOR)
    for at, _, data, offsets in C.text_steps(batch, text):
        with np.errstate(over="ignore"):
            tight, starts, ends, first = closed_up(data, offsets)
            if not len(starts):
                continue
            found = margins(tight, starts, ends, weights, bias)
        some = np.flatnonzero(np.diff(first) > 0)
        best[at + some] = np.maximum(FLOOR, np.maximum.reduceat(found, first[:-1][some]))
    return best


def text_margins(docs: DataFrame, weights: np.ndarray, bias: float, key: str, text: str, *extra: str) -> DataFrame:
    """``id, margin`` and ``extra`` columns."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_margins_of(batch, "text", weights, bias)), *batch.columns[2:]], names=["id", "margin", *extra])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), *extra)
    return C.per_batch(rows, work, ", ".join(["id long, margin double", *(f"{c} {t}" for c, t in rows.dtypes[2:])]))


def accepted(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows, all columns as they are, whose score is below ``threshold``; null, empty and blank texts stay.

    A model that could not be fitted tells no text from another, so it rejects none.
    """
    if not model.fitted:
        return docs

    @F.arrow_udf("boolean")
    def harmless(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            below = model.score(_margins_of(pa.RecordBatch.from_arrays([texts], ["text"]), "text", model.weights, model.bias)) < threshold
            said = pc.match_substring_regex(texts, r"[^\x20\x09-\x0D]")
            yield pc.or_(pa.array(below), pc.invert(pc.fill_null(said, False)))
        C.released()

    # Only the text leaves the JVM, and one truth value comes back.
    return C.bounded(docs).filter(harmless(F.col(text)))


def _word_counts(labelled: DataFrame) -> DataFrame:
    """``word, toxic, clean``: labelled texts of either kind that hold the word."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        label = batch.column(1).to_numpy() != 0
        for at, end, data, offsets in C.text_steps(batch, "text"):
            tight, starts, ends, first = closed_up(data, offsets)
            text = np.repeat(np.arange(end - at), np.diff(first))
            long = ends - starts >= 4
            starts, ends, text = starts[long], ends[long], text[long]
            if not len(starts):
                continue
            with np.errstate(over="ignore"):
                hashes = C.word_hashes(tight, starts, ends)
            # texts ascend, so a stable sort by hash puts a word's occurrences in one text side by side
            order = np.argsort(hashes, kind="stable")
            hashes, text, spot = hashes[order], text[order], order
            new = np.append(True, hashes[1:] != hashes[:-1])
            once = new | np.append(True, text[1:] != text[:-1])
            first_of = np.flatnonzero(new)
            toxic = np.add.reduceat((once & label[at:end][text]).astype(np.int64), first_of)
            texts = np.add.reduceat(once.astype(np.int64), first_of)
            words = gathered(tight, starts[spot[first_of]], ends[spot[first_of]])
            yield pa.RecordBatch.from_arrays([words, pa.array(toxic), pa.array(texts - toxic)], names=["word", "toxic", "clean"])

    return C.per_batch(labelled.select("text", "label"), work, "word binary, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def labelled_sample(docs: DataFrame, marks: DataFrame, max_texts: int = 40_000, key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """``docs`` with the label of ``marks``, at most ``max_texts`` of them, chosen by hashed id.

    Repeated marks of an id count as the highest.  Ids without a document take no place of the bound.  The chosen ids
    have a fixed bound, so they are broadcast and no text is shuffled.
    """
    known = marks.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias(label)).join(docs.select(key), key, "left_semi")
    return docs.join(F.broadcast(known.orderBy(F.xxhash64(key), key).limit(max_texts)), key)


def fit(labelled: DataFrame, max_texts: int = 40_000, max_words: int = 20_000, text: str = "text", label: str = "toxic", key: str = "doc_id") -> Model:
    """A model from ``key, text, label`` rows (label 0 or 1; rows with a null label are ignored, a null text is empty).

    With no toxic or no clean row, or no word that tells them apart, every text scores the share of toxic rows.
    """
    rows = labelled.filter(F.col(label).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.col(label).cast("int").alias("label"))
    total = rows.count()
    if total > max_texts:
        rows = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(max_texts / total * (1 << 20)))
    rows = cut(rows, "labelled")
    n_toxic, n = rows.agg(F.sum("label"), F.count(F.lit(1))).first()
    n_toxic = n_toxic or 0
    prior = (n_toxic + 0.1) / (n + 1)
    flat = Model(np.zeros(1 << BITS, np.float32), FLOOR, 0.0, float(np.log(prior / (1 - prior))), fitted=False)
    if not n_toxic or n_toxic == n:
        return flat
    counts = cut(_word_counts(rows), "words")
    words = max(counts.count(), 1)
    x, y, part = F.col("toxic"), F.col("clean"), lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    excess = 2 * (part(x, (x + y) * prior) + part(y, (x + y) * (1 - prior)))
    telling = (excess > 2 * float(np.log(words * 10))) & (y <= IMPURE * (x + y))
    candidates = [bytes(r[0]) for r in counts.filter(telling).orderBy(F.desc(excess), "word").limit(max_words // 4).collect()]
    positive = _explaining(rows.filter("label = 1"), candidates)
    if not positive:
        return flat
    clean = counts.filter((y > 0) & ~telling & (x <= (x + y) * 0.5))
    share = F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(min(1, max_words / 2 / words) * (1 << 20))
    negative = sorted(bytes(r[0]) for r in clean.filter(share).select("word").collect()) or [b"none"]
    for _ in range(2):
        weights, bias = train(_broken_up(positive), negative)
        hard = _hard(clean, weights, bias).orderBy(F.desc("margin"), "word").limit(max_words // 4).collect()
        negative = sorted({*negative, *(bytes(r[0]) for r in hard)})
    weights, bias = train(_broken_up(positive), negative)
    own = _word_margins(candidates, weights, bias)
    positive = sorted({*positive, *(w for w, m in zip(candidates, own) if m > 0)})
    weights, bias = train(_broken_up(positive), negative)
    fitted = text_margins(rows, weights, bias, "id", "text", "label").select("margin", "label").toArrow()
    slope, intercept = _logistic(fitted.column(0).to_numpy(), fitted.column(1).to_numpy().astype(float))
    return Model(weights, bias, slope, intercept)


def _broken_up(words: list[bytes]) -> list[bytes]:
    """The words, and each with a mark put into it at three places."""
    spots = lambda w: {2, len(w) // 2, len(w) - 2}
    return sorted({*words, *(w[:k] + b"*" + w[k:] for w in words for k in spots(w))})


def _explaining(toxic: DataFrame, candidates: list[bytes]) -> list[bytes]:
    """Candidates that explain the toxic texts, the one that explains most of those left first (a greedy cover)."""
    known = frozenset(candidates)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = []
        for at, end, data, offsets in C.text_steps(batch, "text"):
            for i in range(end - at):
                tight, starts, ends, _ = closed_up(data[offsets[i]:offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))
                raw = tight.tobytes()
                found.append(sorted({raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())} & known))
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.binary()))], names=["words"])

    held = [[bytes(w) for w in r[0]] for r in C.per_batch(toxic.select("text"), work, "words array<binary>").collect()]
    texts: dict[bytes, set[int]] = {}
    for k, found in enumerate(held):
        for word in found:
            texts.setdefault(word, set()).add(k)
    left = {w: len(t) for w, t in texts.items()}
    open_, chosen = set(range(len(held))), []
    while left:
        word = max(left, key=lambda w: (left[w], w))
        if left[word] < EXPLAINS:
            break
        chosen.append(word)
        for k in texts[word] & open_:
            for other in held[k]:
                left[other] -= 1
        open_ -= texts[word]
    return sorted(chosen)


def _word_margins(words: list[bytes], weights: np.ndarray, bias: float) -> np.ndarray:
    row, column, value = _features(words)
    return np.bincount(row, weights[column] * value, len(words)) + bias


def _hard(clean: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """Words of clean texts on the wrong side of the margin."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words = batch.column(0).to_pylist()
        if words:
            found = _word_margins(words, weights, bias)
            keep = found > -0.9
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), pa.array(found[keep])], names=["word", "margin"])

    return C.per_batch(clean.select("word"), work, "word binary, margin double")


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps, slightly regularised."""
    design = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - y) + [0.5 * w[0], 0]
        curve = design.T @ (design * (p * (1 - p))[:, None]) + np.diag([0.5, 1e-6])
        step = np.linalg.solve(curve, gradient)
        w = w - np.clip(step, -5, 5)
    return float(w[0]), float(w[1])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``id, score, predicted, margin`` of every text.

    Null, empty and blank texts have the lowest margin.  Rows are kept one for one, repeated rows get equal
    results, other columns are not read.
    """
    out = text_margins(docs, model.weights, model.bias, key, text)
    value = 1 / (1 + F.exp(-(F.col("margin") * model.slope + model.intercept)))
    return out.select("id", value.alias("score"), (value >= threshold).cast("int").alias("predicted"), "margin")
