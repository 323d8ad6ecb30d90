"""Language identification by multilingual mixtures over character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets that character trigrams are hashed to, and their prior count.
BUCKETS, PRIOR = 1 << 15, 0.25
#: Rounds of expectation and maximisation, and the least change that goes on.
ROUNDS, LEAST_CHANGE = 30, 1e-4
#: Trigrams overlap, so about a third of them are independent evidence.
OVERLAP = 3
#: Share below which a language isn't tried as a part of the mixture.
LEAST_SHARE = 0.01
UNKNOWN = "und"

_FOLD: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """Letters of the first plane to lower case, all else to a blank."""
    if not _FOLD:
        low = [
            ord(chr(i).lower()[0]) if chr(i).isalpha() else 32
            for i in range(1 << 16)
            if not 0xD800 <= i < 0xE000
        ]
        table = np.full(1 << 16, 32, np.uint32)
        table[[i for i in range(1 << 16) if not 0xD800 <= i < 0xE000]] = low
        _FOLD.append(table)
    return _FOLD[0]


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's trigrams and how often each comes.

    Letters are folded to lower case and every other character separates; at a
    word's ends the separator counts as a character. A text without a letter
    has no trigrams.
    """
    codes = np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)
    high = codes >= 1 << 16
    folded = _fold()[np.where(high, 32, codes)]
    for i in np.flatnonzero(high):
        if chr(codes[i]).isalpha():
            folded[i] = codes[i]
    if not (folded != 32).any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.full(1, 32, np.uint32)
    line = np.concatenate([edge, folded, edge]).astype(np.uint64)
    a, b, c = line[:-2], line[1:-1], line[2:]
    whole = (b != 32) | ((a != 32) & (c != 32))
    key = (a * np.uint64(0x9E3779B1) + b) * np.uint64(0x85EBCA77) + c
    key = key * np.uint64(0x9E3779B97F4A7C15)
    bucket = (key >> np.uint64(64 - 15)).astype(np.int64)[whole]
    counts = np.bincount(bucket, minlength=BUCKETS)
    found = np.flatnonzero(counts)
    return found, counts[found]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(
            batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True
        ):
            found, counts = trigrams(text)
            if lang not in total:
                total[lang] = np.zeros(BUCKETS, np.int64)
            total[lang][found] += counts
    for lang, counts in total.items():
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(found)), pa.array(found), pa.array(counts[found])],
            names=["lang", "bucket", "n"],
        )


def learn(texts: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in their order, and each one's log probability of each bucket.

    Counts all rows with ``lang`` and ``text``; they are summed within each task
    before the shuffle. A row per language and bucket comes to the driver: the
    size of the model, not of the data. Languages without a trigram aren't
    learned.
    """
    rows = texts.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    counted = rows.mapInArrow(_count, "lang STRING, bucket BIGINT, n BIGINT")
    table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(table.column("lang").to_pylist()))
    counts = np.zeros((len(langs), BUCKETS))
    row = np.array([langs.index(x) for x in table.column("lang").to_pylist()], np.int64)
    counts[row, table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    share = (counts + PRIOR) / (counts.sum(axis=1, keepdims=True) + PRIOR * BUCKETS)
    return langs, share


def mixture(share: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS):
    """The languages' proportions in one text, and its log likelihood, by
    expectation-maximisation; ``share`` has a row per trigram of the text."""
    part = np.full(share.shape[1], 1 / share.shape[1])
    total = counts.sum()
    for _ in range(rounds):
        fresh = part * (share.T @ (counts / (share @ part))) / total
        change = np.abs(fresh - part).max()
        part = fresh
        if change < LEAST_CHANGE:
            break
    return part, float(counts @ np.log(share @ part))


def proportions(share: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Proportions over the set of languages of the highest penalised likelihood.

    The mixture of all languages ranks them; the sets of the first one, two, ...
    of that order are fitted, and each language costs half the logarithm of the
    independent trigrams. Languages outside the set have proportion 0.
    """
    every, _ = mixture(share, counts)
    order = np.argsort(-every, kind="stable")
    order = order[: max(1, int((every > LEAST_SHARE).sum()))]
    evidence = counts.sum() / OVERLAP
    best, chosen = -np.inf, None
    for size in range(1, len(order) + 1):
        held = order[:size]
        part, likelihood = mixture(share[:, held], counts) if size > 1 else (
            np.ones(1), float(counts @ np.log(share[:, held[0]]))
        )
        value = likelihood / OVERLAP - size * 0.5 * np.log(max(evidence, 2.0))
        if value <= best:
            break
        best, chosen = value, (held, part)
    found = np.zeros(share.shape[1])
    found[chosen[0]] = chosen[1]
    return found


def identify(texts: DataFrame, langs: list[str], share: np.ndarray) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` (the largest proportion, ties to the
    first name), ``score`` (that proportion) and ``mix`` (all above 0, by name).

    A null text, a text without a letter, and any text if nothing was learned,
    is ``und`` with score 0. Row by row: no shuffle.
    """
    columns = np.ascontiguousarray(share.T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, mixes = [], [], []
            for text in batch.column("text").to_pylist():
                found, counts = trigrams(text)
                if not len(found) or not langs:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    mixes.append([])
                    continue
                part = proportions(columns[found], counts.astype(float))
                top = int(np.argmax(part))
                names.append(langs[top])
                scores.append(min(1.0, float(part[top])))
                mixes.append([(langs[i], float(part[i])) for i in np.flatnonzero(part)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(names, pa.string()),
                    pa.array(scores, pa.float64()),
                    pa.array(mixes, pa.map_(pa.string(), pa.float64())),
                ],
                names=["doc_id", "held_out", "lang_pred", "score", "mix"],
            )

    return texts.select("doc_id", "held_out", "text").mapInArrow(
        run,
        "doc_id BIGINT, held_out BOOLEAN, lang_pred STRING, score DOUBLE, mix MAP<STRING, DOUBLE>",
    )


def remainder(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string")) % 3


def predictions(docs: DataFrame) -> DataFrame:
    """Learn from the documents whose remainder is not 1, predict all.

    A null key is neither held out nor learned from. Predictions see the text
    alone.
    """
    chosen = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(remainder() == 1, F.lit(False)).alias("held_out"),
        "text",
        "lang",
    )
    langs, share = learn(chosen.where(~F.col("held_out") & F.col("doc_id").isNotNull()))
    return identify(chosen, langs, share).select("doc_id", "held_out", "lang_pred", "score")
