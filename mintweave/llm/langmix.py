"""Language identification by multilingual mixtures.

Training counts the character trigrams of every labelled text per language (hashed to ``BUCKETS``), giving
one smoothed multinomial per language.  For a text, expectation-maximisation estimates the proportions
``pi`` of the languages from ``sum_g count(g) * log sum_l pi_l P(g | l)``.  Starting from all learned
languages, the one whose removal costs least likelihood is taken away for as long as the penalised
likelihood ``logL - 0.5 * (languages - 1) * log(trigrams)`` does not fall.  The largest proportion left names
the text; its size is the score.

Likelihoods of one step's texts are arrays over (text, trigram) entries, so EM runs for all of them at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mintweave.llm import common as C

BUCKETS = 1 << 15
ROUNDS = 12
#: Texts are handled in steps of this many bytes.
STEP = 1 << 19
#: The same for proportions, whose arrays hold every language of every trigram.
MIX_STEP = 1 << 17


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram that starts at each byte, and whether the byte starts one inside its text.

    ASCII letters are lower-cased, other ASCII bytes count as blanks, so digits, marks and line ends tell nothing.
    Trigrams of blanks alone are left out.
    """
    kind = C.LOWER[data]
    kind = np.where((kind < 128) & ~((kind >= 97) & (kind <= 122)), np.uint8(32), kind).astype(np.uint64)
    n = len(kind)
    if n < 3:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    packed = (kind[:-2] << np.uint64(16)) | (kind[1:-1] << np.uint64(8)) | kind[2:]
    bucket = ((packed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)).astype(np.int64)
    inside = (kind[:-2] != 32) | (kind[1:-1] != 32)
    cut = offsets[(offsets > 0) & (offsets < n)]
    for back in (1, 2):
        spot = cut - back
        spot = spot[(spot >= 0) & (spot < n - 2)]
        inside[spot] = False
    return bucket, inside


def profiles(labelled: DataFrame, lang: str = "lang", text: str = "text") -> dict[str, np.ndarray]:
    """Trigram counts per language: at most ``BUCKETS`` numbers for each learned language reach the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column(1).to_pylist(), object)
            for at, end, data, offsets in C.text_steps(batch, "text", STEP):
                with np.errstate(over="ignore"):
                    bucket, inside = trigrams(data, offsets)
                owner = np.repeat(np.arange(end - at), np.diff(offsets))[: len(bucket)]
                for name in set(names[at:end]):
                    here = inside & (names[at:end] == name)[owner] if len(bucket) else inside
                    counts[name] = counts.get(name, 0) + np.bincount(bucket[here], minlength=BUCKETS)
        for name, total in counts.items():
            spot = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(spot), pa.string()), pa.array(spot), pa.array(total[spot])], names=["lang", "bucket", "n"])

    rows = labelled.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter("text is not null and lang is not null")
    found = C.bounded(rows).mapInArrow(work, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    out: dict[str, np.ndarray] = {}
    for name, bucket, n in zip(*(c.to_pylist() for c in found.toArrow().columns)):
        out.setdefault(name, np.zeros(BUCKETS))[bucket] = n
    return dict(sorted(out.items()))


def _proportions(likely: np.ndarray, count: np.ndarray, first: np.ndarray, owner: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM for all texts: proportions over the active languages and the log-likelihood."""
    total = np.add.reduceat(count, first)
    pi = active / active.sum(axis=1, keepdims=True)
    weighted = np.empty_like(likely)
    for turn in range(ROUNDS + 1):
        np.multiply(likely, pi[owner], out=weighted)
        mass = weighted.sum(axis=1)
        if turn == ROUNDS:
            break
        weighted *= (count / mass)[:, None]
        pi = np.add.reduceat(weighted, first, axis=0) / total[:, None]
    return pi, np.add.reduceat(count * np.log(mass), first)


def mixtures(likely: np.ndarray, count: np.ndarray, first: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Selected proportions per text; a language that is not selected has 0."""
    texts, langs = len(first), likely.shape[1]
    active = np.ones((texts, langs), likely.dtype)
    pi, fit = _proportions(likely, count, first, owner, active)
    size = np.log(np.maximum(np.add.reduceat(count, first), 2))
    open_ = np.ones(texts, bool)
    ends = np.append(first, len(count))
    for _ in range(langs - 1):
        rows = np.flatnonzero(open_)
        if not len(rows):
            break
        fewer = active[rows].copy()
        share = np.where(fewer > 0, pi[rows], np.inf)
        fewer[np.arange(len(rows)), share.argmin(axis=1)] = 0
        length = ends[rows + 1] - ends[rows]
        entry = np.repeat(ends[rows] - np.append(0, np.cumsum(length)[:-1]), length) + np.arange(length.sum())
        start = np.append(0, np.cumsum(length)[:-1])
        new_pi, new_fit = _proportions(likely[entry], count[entry], start, np.repeat(np.arange(len(rows)), length), fewer)
        better = new_fit + 0.5 * size[rows] >= fit[rows]
        took = rows[better]
        active[took], pi[took], fit[took] = fewer[better], new_pi[better], new_fit[better]
        open_[rows[~better]] = False
    return pi


class Identifier:
    """Language, score and proportions of every text of a batch, from trigram counts."""

    def __init__(self, counts: dict[str, np.ndarray]) -> None:
        self.names = list(counts)
        shares = [(counts[k] + 0.5) / (counts[k].sum() + 0.5 * BUCKETS) for k in self.names]
        self.table = np.array(shares).T.astype(np.float32) if shares else np.zeros((BUCKETS, 0), np.float32)
        self.usual = int(np.argmax([counts[k].sum() for k in self.names])) if shares else 0

    def of(self, batch: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        langs = len(self.names)
        shares = np.full((batch.num_rows, langs), 1 / max(langs, 1), np.float32)
        best = np.full(batch.num_rows, self.usual)
        for at, end, data, offsets in C.text_steps(batch, text, MIX_STEP):
            with np.errstate(over="ignore"):
                bucket, inside = trigrams(data, offsets)
            if not langs or not inside.any():
                continue
            owner = np.repeat(np.arange(end - at), np.diff(offsets))[: len(bucket)]
            packed = np.sort(owner[inside] * BUCKETS + bucket[inside])
            first = np.flatnonzero(np.diff(packed, prepend=-1))
            count = np.diff(first, append=len(packed)).astype(np.float32)
            packed = packed[first]
            text_of, gram = packed // BUCKETS, packed % BUCKETS
            start = np.flatnonzero(np.diff(text_of, prepend=-1))
            pi = mixtures(self.table[gram], count, start, np.repeat(np.arange(len(start)), np.diff(start, append=len(text_of))))
            rows = at + text_of[start]
            shares[rows] = pi
            best[rows] = pi.argmax(axis=1)
        return np.array([*self.names, "und"], object)[best] if langs else np.full(batch.num_rows, "und", object), shares[np.arange(len(best)), best] if langs else np.zeros(len(best)), shares


def _lettered(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, counts: dict[str, np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, lang_pred, score, proportions`` of every text.

    A null text, or one without a letter, is ``und`` with score 0; so is every text when nothing was learned.
    A text with letters but no trigram gets the language of most training text, score 1 / languages.
    Rows are kept one for one; repeated rows get equal results; other columns are not read.
    """
    model = Identifier(counts)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        label, score, shares = model.of(batch, "text")
        lettered = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        label, score = np.where(lettered, label, "und"), np.where(lettered, score, 0).astype(float).clip(0, 1)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(label, pa.string()), pa.array(score), pa.array(list(shares.astype(float)), pa.list_(pa.float64()))], names=["id", "lang_pred", "score", "proportions"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), _lettered(text).alias("lettered"))
    return C.per_batch(rows, work, "id long, lang_pred string, score double, proportions array<double>")


def accepted(docs: DataFrame, counts: dict[str, np.ndarray], share: float, text: str = "text") -> DataFrame:
    """The rows, all columns as they are, with a letter and a language of at least ``share``; all lettered rows when nothing was learned."""
    model = Identifier(counts)

    @F.arrow_udf("boolean")
    def clear(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(model.of(pa.RecordBatch.from_arrays([texts], ["text"]), "text")[1] >= share)
        C.released()

    # Only the text leaves the JVM, and one truth value comes back.
    lettered = C.bounded(docs).filter(_lettered(text))
    return lettered.filter(clear(F.col(text))) if counts else lettered
