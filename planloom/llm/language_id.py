"""Language ID by multilingual mixture inference.

A document is a mixture of languages: each of its byte trigrams (lower-cased,
other than letters turned to blanks, hashed into ``BUCKETS`` buckets) comes from
language l with probability pi(l) * theta(l, trigram).  Expectation-maximisation
estimates pi; the languages are then added in order of their proportion, and
the set with the highest penalised log-likelihood stays.  Its largest member is
the prediction, with that member's proportion as the score.

``fit`` counts trigrams over all training documents, in partial sums per task and
a grouped sum; the model has ``BUCKETS`` rows per language, so its size depends
on the number of languages only.

*Rejection* (``keep_identified`` with ``only_known``).  A background in which all buckets are
equally likely competes with the sets of languages at the price of one more language.
If it wins, the text is in no known language.

Defined cases: a null text or one without a letter (Unicode category L; numerals and
signs are none) is ``und`` with score 0; so is
everything if nothing was learned; ties go to the language first by name;
repeated rows give repeated results; a null id stays null and is in the training fold
(``held_out`` is false); an empty table gives an empty result; other columns are ignored.
``LEAST_SHARE``, ``PENALTY`` and the greedy order decide which minor languages are in
the set; none can change which language is first but by the fit itself.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
#: Added to every trigram's count.
SMOOTHING = 0.1
ITERATIONS = 12
#: Languages under this proportion are not tried in a set.
LEAST_SHARE = 0.02
#: Times log(n) that each further language costs.
PENALTY = 4.0

_LETTER = regex.compile(r"\p{L}")
_KEEP = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def trigram_buckets(text: str) -> np.ndarray:
    """The bucket of every trigram whose middle byte belongs to a word."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8").translate(_KEEP) + b" ", dtype=np.uint8).astype(np.uint32)
    middle = data[1:-1]
    codes = ((data[:-2] << np.uint32(16)) | (middle << np.uint32(8)) | data[2:])[middle != 32]
    return (codes * np.uint32(2654435761)) >> np.uint32(32 - 15)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    prior: np.ndarray
    theta: np.ndarray  # BUCKETS x languages

    def explained(self, text: str | None) -> tuple[list[tuple[str, float]], float]:
        """The chosen languages with their proportions, largest first, and how far their penalised fit is
        above the background's; an empty list for ``und``."""
        if not text or not self.languages or not _LETTER.search(text):
            return [], 0.0
        buckets, counts = np.unique(trigram_buckets(text), return_counts=True)
        if not len(buckets):
            return [(self.languages[int(np.argmax(self.prior))], float(self.prior.max()))], 0.0
        theta, counts = self.theta[buckets], counts.astype(np.float64)
        shares, _ = _mixture(theta, counts, np.full(len(self.languages), 1 / len(self.languages)), ITERATIONS)
        order = np.argsort(-shares, kind="stable")
        order = order[shares[order] >= min(LEAST_SHARE, shares.max())]
        best, kept = -np.inf, None
        cost = PENALTY * np.log(counts.sum() + 1)
        for size in range(1, len(order) + 1):
            chosen = order[:size]
            start = shares[chosen] / shares[chosen].sum()
            own, fit = _mixture(theta[:, chosen], counts, start, 1 if size == 1 else ITERATIONS)
            if fit - cost * (size - 1) <= best:
                break
            best, kept = fit - cost * (size - 1), (chosen, own)
        chosen, own = kept
        rank = sorted(range(len(chosen)), key=lambda i: (-own[i], self.languages[chosen[i]]))
        return [(self.languages[chosen[i]], float(min(1.0, own[i]))) for i in rank], best - (counts.sum() * -np.log(BUCKETS) - cost)

    def infer(self, text: str | None) -> list[tuple[str, float]]:
        """The chosen languages and their proportions, largest first; empty for ``und``."""
        return self.explained(text)[0]

    def known(self, text: str | None) -> bool:
        """Whether the text has a language and the languages explain it better than the background."""
        languages, above = self.explained(text)
        return bool(languages) and bool(above >= 0)


def _mixture(theta: np.ndarray, counts: np.ndarray, shares: np.ndarray, iterations: int) -> tuple[np.ndarray, float]:
    total = counts.sum()
    for _ in range(iterations):
        new = shares * ((counts / (theta @ shares)) @ theta) / total
        done = np.abs(new - shares).max() < 1e-4
        shares = new / new.sum()
        if done:
            break
    return shares, float(counts @ np.log(theta @ shares))


def fit(df: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn from every row whose text and language are not null."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = sums.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                held += np.bincount(trigram_buckets(text), minlength=BUCKETS)
        for lang, held in sums.items():
            some = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(held[some], pa.int64())], names=["lang", "bucket", "n"])

    rows = df.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counts.toArrow()  # at most BUCKETS rows per language
    names, bucket, n = table.column("lang").to_pylist(), table.column("bucket").to_numpy(), table.column("n").to_numpy()
    languages = tuple(sorted(set(names)))
    number = {x: i for i, x in enumerate(languages)}
    sums = np.zeros((BUCKETS, len(languages)))
    if languages:
        sums[bucket, [number[x] for x in names]] = n
    totals = sums.sum(axis=0)
    return LanguageModel(languages, totals / max(totals.sum(), 1), (sums + SMOOTHING) / (totals + SMOOTHING * BUCKETS))


def identify(df: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, lang_pred, score and ``languages``, an array of (lang, share)."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[id_col].dataType.simpleString()
    item = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            sets = [model.infer(t) for t in batch.column(1).to_pylist()]
            first = [s[0] if s else ("und", 0.0) for s in sets]
            languages = pa.array([[{"lang": a, "share": b} for a, b in s] for s in sets], item)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in first], pa.string()), pa.array([b for _, b in first], pa.float64()), languages], names=["id", "lang_pred", "score", "languages"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(predict, f"id {kind}, lang_pred string, score double, languages array<struct<lang:string,share:double>>")
    return out.withColumnRenamed("id", id_col)


def keep_identified(df: DataFrame, model: LanguageModel, *, text_col: str = "text", only_known: bool = False) -> DataFrame:
    """The rows whose text has a language (is in known languages), columns as they were, in one pass over whole texts."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            yield batch.filter(pa.array([model.known(t) if only_known else bool(model.infer(t)) for t in batch.column(at).to_pylist()], pa.bool_()))

    return df.mapInArrow(keep, df.schema)


def held_out(id_col: str = "doc_id"):
    """A fifth of all ids; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
