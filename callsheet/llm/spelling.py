"""Spelling variants: words that differ by one code point, found by Bloom filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsheet.llm.words import BASE, mixed
from callsheet.session import materialise

#: Code points of a word, and occurrences of it, at least.
LEAST, OCCURRENCES = 7, 2
#: A form is so many times as common as its variant, at least.
RATIO = 10
#: Characters of a run that makes a word.
LETTERS = "A-Za-z\\u00C0-\\u00FF"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of this length and longer share a filter.
LONG = 64
#: Bits of a filter for each of its words, and bytes of all filters that are broadcast
#: at a time. A filter that would be larger has fewer bits a word and lets more edits
#: pass, which the join with the vocabulary removes.
BITS_A_WORD, FILTER_BYTES = 24, 32 << 20
#: Code points that are edited at a time.
BLOCK = 1 << 18

KEYED = "id BIGINT, word STRING, n BIGINT, size INT, key BIGINT"
PROBED = "id BIGINT, key BIGINT, at INT, letter INT"
_INVERSE = np.uint64(pow(BASE, -1, 1 << 64))


# --- hashes that follow an edit ----------------------------------------------------


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of words of one length, with their code points, in blocks."""
    sizes = np.array([len(w) for w in words], np.int64)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        step = max(1, BLOCK // max(int(size), 1))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            text = "".join(words[i] for i in part)
            yield part, np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(-1, size)


def _values(points: np.ndarray) -> np.ndarray:
    return mixed((points.astype(np.uint64) + np.uint64(1)) * np.uint64(BASE))


def _powers(size: int) -> np.ndarray:
    """BASE to the power size - 1, ..., 1, 0."""
    found = np.full(size, BASE, np.uint64)
    found[-1:] = 1
    return np.cumprod(found[::-1])[::-1]


def _tails(points: np.ndarray) -> np.ndarray:
    """For each word and place the polynomial hash of what begins there."""
    terms = _values(points) * _powers(points.shape[1])
    tails = np.zeros((len(points), points.shape[1] + 1), np.uint64)
    tails[:, :-1] = np.cumsum(terms[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
    return tails


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column("word").to_pylist()
        key = np.zeros(len(words), np.uint64)
        for rows, points in _by_length(words):
            key[rows] = mixed(_tails(points)[:, 0])
        sizes = pa.array([len(w) for w in words], pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("word"), batch.column("n"), sizes, pa.array(key.view(np.int64))],
            names=["id", "word", "n", "size", "key"],
        )


# --- filters -------------------------------------------------------------------------


def _mask(keys: np.ndarray) -> np.ndarray:
    """Five bits of a block of 64."""
    one, found = np.uint64(1), np.uint64(0)
    for shift in range(0, 30, 6):
        found = found | (one << ((keys >> np.uint64(shift)) & np.uint64(63)))
    return found


def _blocks(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def _filled(shards: dict[int, int]):
    """A task's words as blocks of their filters: of a block one row."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.minimum(batch.column("size").to_numpy(), LONG)
            keys = batch.column("key").to_numpy().view(np.uint64)
            for shard in np.unique(size).tolist():
                if shard not in shards:
                    continue
                own = keys[size == shard]
                block = _blocks(own, shards[shard])
                order = np.argsort(block, kind="stable")
                block, starts = np.unique(block[order], return_index=True)
                bits = np.bitwise_or.reduceat(_mask(own[order]), starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(block), shard, np.int32)), pa.array(block), pa.array(bits.view(np.int64))],
                    names=["shard", "block", "bits"],
                )

    return fill


def _bins(counts: dict[int, int]) -> list[tuple[list[int], dict[int, int]]]:
    """Lengths that are probed together, and the filters (by length, with the
    logarithm of their blocks) that this needs: their own and that of words one
    shorter. All filters of a bin fit in FILTER_BYTES."""
    most = (FILTER_BYTES // 16).bit_length() - 1  # of two filters
    size = {
        shard: min(max(1, (n * BITS_A_WORD // 64).bit_length()), most) for shard, n in counts.items()
    }
    bins: list[tuple[list[int], dict[int, int]]] = []
    for shard in sorted(counts):
        wanted = {s: size[s] for s in (shard - 1, shard) if s in size}
        if bins:
            lengths, filters = bins[-1]
            if sum(8 << b for b in {**filters, **wanted}.values()) <= FILTER_BYTES:
                lengths.append(shard)
                filters.update(wanted)
                continue
        bins.append(([shard], wanted))
    return bins


def _passing(keys: np.ndarray, held: tuple[int, np.ndarray] | None) -> np.ndarray:
    """The numbers of the keys that a filter may hold."""
    if held is None:
        return np.empty(0, np.int64)
    bits, blocks = held
    found = blocks[_blocks(keys, bits)]
    first = np.flatnonzero((found >> (keys & np.uint64(63))) & np.uint64(1))
    mask = _mask(keys[first])
    return first[(found[first] & mask) == mask]


def _probe(shared, letters: np.ndarray):
    """All edits of a word that delete a code point or replace it by a greater one,
    as hashes; those that pass the filter of their length remain. What inserts or
    replaces by a smaller one is found from the other word."""
    worth = _values(letters)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = shared.value
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for rows, points in _by_length(batch.column("word").to_pylist()):
                size = points.shape[1]
                tails, power = _tails(points), _powers(size)
                whole = tails[:, :1]
                found = []

                def keep(keys, word, at, letter, held, found=found):
                    hits = _passing(keys, held)
                    found.append((word[hits], at[hits], np.full(len(hits), letter, np.int32), keys[hits]))

                # of a run of equal code points, deleting any gives the same word
                fresh = np.ones(points.shape, bool)
                fresh[:, 1:] = points[:, 1:] != points[:, :-1]
                word, at = np.nonzero(fresh)
                shorter = (whole - tails[:, :-1]) * _INVERSE + tails[:, 1:]
                keep(mixed(shorter[word, at]), word, at, -1, filters.get(min(size - 1, LONG)))
                own = filters.get(min(size, LONG))
                value = _values(points)
                for letter, x in zip(letters.tolist(), worth, strict=True):
                    word, at = np.nonzero(points < letter)
                    changed = whole[word, 0] + (x - value[word, at]) * power[at]
                    keep(mixed(changed), word, at, letter, own)
                word, at, letter, keys = (np.concatenate(c) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[rows[word]]),
                        pa.array(keys.view(np.int64)),
                        pa.array(at.astype(np.int32)),
                        pa.array(letter),
                    ],
                    names=["id", "key", "at", "letter"],
                )

    return probe


# --- the operator ----------------------------------------------------------------------


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """``a``, ``a_n``, ``b``, ``b_n``: each two words of ``vocabulary`` (distinct
    ``word``, ``n``) that differ by one inserted, deleted or replaced code point,
    once.

    1. Blocked Bloom filters, one for each length, hold the vocabulary: 64-bit
       blocks, of which a word sets five bits. Lengths are probed in bins whose
       filters fit in 32 MB together; only these are collected and broadcast.
    2. Each word's deletions and replacements are probed as hashes that follow
       from the word's own, so no edit is ever written out, however long the word.
    3. Those that pass are joined with the vocabulary by hash, and the words are
       compared: this removes false positives, of the filter and of the hash.

    No words give no pairs.
    """
    spark = vocabulary.sparkSession
    numbered = vocabulary.select(F.monotonically_increasing_id().alias("id"), "word", "n")
    keyed = materialise(materialise(numbered, "vocabulary").mapInArrow(_keyed, KEYED), "keyed-words")
    shard = F.least("size", F.lit(LONG))
    counts = {r["shard"]: r["count"] for r in keyed.groupBy(shard.alias("shard")).count().collect()}
    points = keyed.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct()
    letters = np.array(sorted(ord(r["c"]) for r in points.where("c <> ''").collect()), np.uint32)

    probed = None
    for lengths, wanted in _bins(counts):
        blocks = keyed.where(shard.isin(list(wanted))).select("size", "key")
        blocks = blocks.mapInArrow(_filled(wanted), "shard INT, block BIGINT, bits BIGINT")
        rows = blocks.groupBy("shard", "block").agg(F.bit_or("bits").alias("bits")).toArrow()
        filters = {s: (bits, np.zeros(1 << bits, np.uint64)) for s, bits in wanted.items()}
        of = rows.column("shard").to_numpy()
        for s, (_, held) in filters.items():
            own = of == s
            held[rows.column("block").to_numpy()[own]] = rows.column("bits").to_numpy()[own].view(np.uint64)
        shared = spark.sparkContext.broadcast(filters)
        some = keyed.where(shard.isin(lengths)).select("id", "word").mapInArrow(_probe(shared, letters), PROBED)
        probed = some if probed is None else probed.union(some)
    if probed is None:
        return vocabulary.limit(0).selectExpr("word AS a", "n AS a_n", "word AS b", "n AS b_n")

    probed = materialise(probed, "passing-edits")
    target = keyed.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"))
    source = keyed.select("id", F.col("word").alias("a"), F.col("n").alias("a_n"))
    met = probed.join(target, "key").join(source, "id")
    before, after = F.substring("a", F.lit(1), F.col("at")), F.substring("a", F.col("at") + 2, F.length("a"))
    # letters up to U+00FF only: Spark's char() has no others, so pieces are compared
    in_place = F.substring("b", F.col("at") + 1, F.lit(1))
    replaced = (
        (F.length("a") == F.length("b"))
        & (F.substring("b", F.lit(1), F.col("at")) == before)
        & (F.substring("b", F.col("at") + 2, F.length("b")) == after)
        & (in_place != F.substring("a", F.col("at") + 1, F.lit(1)))
    )
    deleted = F.col("b") == F.concat(before, after)
    same = F.when(F.col("letter") < 0, deleted).otherwise(replaced)
    return materialise(met.where(same).select("a", "a_n", "b", "b_n").distinct(), "near-words")


def last_forms(links: DataFrame) -> DataFrame:
    """``word`` and ``root``, the end of its chain, for every ``word`` that has a
    ``form``. Chains ascend in ``n``, so they end; each round doubles the steps
    that are taken, and is written."""
    now = materialise(links.select("word", F.col("form").alias("root")), "forms")
    while True:
        step = now.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        met = now.join(step, F.col("root") == F.col("_word"), "left")
        moved = materialise(
            met.select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("more")),
            "form-chains",
        )
        now = moved.select("word", "root")
        if moved.where("more").isEmpty():
            return now


def spelling_groups(vocabulary: DataFrame, ratio: int = RATIO) -> DataFrame:
    """For each ``word`` of ``vocabulary`` (distinct, with ``n``): ``n_near``, the
    number of words that differ from it by one code point; ``form``, the most common
    of them (ties: the least in code-point order) if it is ``ratio`` times as common
    as the word, with its ``form_n``; and ``root``, the last of the forms that follow
    one another, or the word itself. No words give no rows."""
    kept = materialise(vocabulary.select("word", "n"), "spelled-words")
    pairs = near_pairs(kept)
    both = pairs.union(pairs.select("b", "b_n", "a", "a_n"))
    of_word = both.groupBy(F.col("a").alias("_word")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("n"), F.col("b").alias("word"))).alias("best")
    )
    fits = -F.col("best.n") >= F.col("n") * ratio
    rows = materialise(
        kept.join(of_word, F.col("word") == F.col("_word"), "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(fits, F.col("best.word")).alias("form"),
            F.when(fits, -F.col("best.n")).alias("form_n"),
        ),
        "word-forms",
    )
    roots = last_forms(rows.where("form IS NOT NULL"))
    return rows.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def words_of_runs(runs: Column, salt: Column, every: int) -> Column:
    """``runs`` without the code point that the checksum of salt and run names, where
    ``every`` divides that checksum."""
    h = F.crc32(F.concat(salt, F.lit(":"), runs))
    cut = (h % F.length(runs)).cast("int")
    shorter = F.concat(F.substring(runs, F.lit(1), cut), F.substring(runs, cut + 2, F.length(runs)))
    return F.when(h % every == 0, shorter).otherwise(runs)


def vocabulary_of(
    docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = 31, least: int = LEAST
) -> DataFrame:
    """``word`` and ``n``: the runs of letters of all texts, A to Z lowered and
    thinned (``words_of_runs``), that then have ``least`` code points and come twice.

    Runs shorter than ``least`` can't become longer, so only longer ones are
    taken; words are counted in each task before the shuffle. Null and empty
    texts have no words; a null key reads as empty.
    """
    pattern = F.lit(f"[{LETTERS}]{{{least},}}")
    found = docs.select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("salt"),
        F.explode(F.regexp_extract_all(F.col(text), pattern, F.lit(0))).alias("run"),
    ).withColumn("run", F.translate("run", UPPER, LOWER))
    words = found.select(words_of_runs(F.col("run"), F.col("salt"), every).alias("word"))
    counted = words.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= OCCURRENCES)


def variants(docs: DataFrame) -> DataFrame:
    """The rows of the query."""
    return spelling_groups(vocabulary_of(docs.select("doc_id", "text")))
