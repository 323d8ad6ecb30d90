"""Repeated passages by prefix-partitioned suffix trees."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsheet.llm.words import BASE, hashes_of, mixed, sliding, stretches, words_of
from callsheet.session import materialise

#: Words of a window, and of the prefix that splits suffixes into groups.
WINDOW, PREFIX = 35, 8
#: Prefixes that start in a window; a shared window shares the least of them.
STARTS = WINDOW - PREFIX + 1
#: Suffixes that share a short prefix and are put together in one task.
GROUP = 20_000
#: Bytes of a word's hash that a suffix carries.
BYTES = 6
#: Rows that a task gathers before it hands them on.
GATHERED = 400_000

REF = "doc_id BIGINT, hash BIGINT, pos INT"
OWN, PASSED = 0, 2


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def anchors_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix hashes by place, each window's least one, and the anchors' places.

    An anchor is a place whose prefix is the least in some window, so equal
    windows have their anchors at equal places.
    """
    grams = stretches(hashes, PREFIX)
    if len(hashes) < WINDOW:
        return grams, np.empty(0, np.uint64), np.empty(0, np.int64)
    least = sliding(grams, STARTS, np.minimum)
    edge = np.zeros(STARTS - 1, np.uint64)
    reach = sliding(np.concatenate([edge, least, edge]), STARTS, np.maximum)
    return grams, least, np.flatnonzero(reach == grams)


def _documents(batch: pa.RecordBatch) -> Iterator[tuple[int | None, int, str]]:
    columns = (batch.column(c).to_pylist() for c in ("doc_id", "hash", "text"))
    return zip(*columns, strict=True)


def _firsts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, how often its key comes if it is the first, else 0."""
    _, first, counts = np.unique(keys, return_index=True, return_counts=True)
    weight = np.zeros(len(keys), np.int64)
    weight[first] = counts
    return weight, first


ANCHOR = f"route BIGINT, kind INT, key BIGINT, weight BIGINT, {REF}"


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's anchors: of equal ones the first goes to the key's group with
    their number, the others are known to be shared and go anywhere."""
    held: dict[str, list] = defaultdict(list)
    size = 0

    def hand_on() -> Iterator[pa.RecordBatch]:
        if not size:
            return
        keys = np.concatenate(held["key"])
        weight, _ = _firsts(keys)
        kind = np.where(weight > 0, OWN, PASSED).astype(np.int32)
        doc = np.repeat(np.array(held["doc"], np.int64), held["n"])
        missing = np.repeat(np.array(held["null"], bool), held["n"])
        anywhere = mixed(keys + np.arange(len(keys), dtype=np.uint64))
        whole = pa.RecordBatch.from_arrays(
            [
                _signed(np.where(weight > 0, keys, anywhere)),
                pa.array(kind),
                _signed(keys),
                pa.array(weight),
                pa.array(doc, mask=missing),
                pa.array(np.repeat(np.array(held["hash"], np.int64), held["n"])),
                pa.array(np.concatenate(held["pos"]).astype(np.int32)),
            ],
            names=["route", "kind", "key", "weight", "doc_id", "hash", "pos"],
        )
        for at in range(0, whole.num_rows, 1 << 16):
            yield whole.slice(at, 1 << 16)

    for batch in batches:
        for doc, text_hash, text in _documents(batch):
            grams, _, places = anchors_of(hashes_of(words_of(text)))
            if len(places):
                held["key"].append(grams[places])
                held["pos"].append(places)
                held["n"].append(len(places))
                held["doc"].append(doc or 0)
                held["null"].append(doc is None)
                held["hash"].append(text_hash)
                size += len(places)
        if size >= GATHERED:
            yield from hand_on()
            held.clear()
            size = 0
    yield from hand_on()


def _whole_runs(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Sorted rows regathered so that no run of (kind, key) is cut, in tables of
    ``least`` rows or more; a run is never longer than its group may be."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= least:
            rows = pa.Table.from_batches(held)
            kind, key = rows.column("kind").to_numpy(), rows.column("key").to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (kind[1:] != kind[:-1]))
            if len(cuts):
                cut = int(cuts[-1]) + 1
                yield rows.slice(0, cut)
                held = rows.slice(cut).to_batches()
                size -= cut
    if held:
        yield pa.Table.from_batches(held)


def _totals(rows: pa.Table) -> np.ndarray:
    """Each row's total weight of its run of (kind, key)."""
    kind, key = rows.column("kind").to_numpy(), rows.column("key").to_numpy()
    starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (kind[1:] != kind[:-1])])
    sums = np.add.reduceat(rows.column("weight").to_numpy(), starts)
    return np.repeat(sums, np.diff(np.r_[starts, rows.num_rows]))


SHARED = f"key BIGINT, {REF}"


def _shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _whole_runs(batches, 1 << 16):
        shared = (_totals(rows) >= 2) | (rows.column("kind").to_numpy() == PASSED)
        kept = rows.filter(pa.array(shared)).select(["key", "doc_id", "hash", "pos"])
        yield from kept.combine_chunks().to_batches()


SUFFIX = f"route BIGINT, kind INT, key BIGINT, weight BIGINT, mask INT, words BINARY, {REF}"
WIDE = 1


def _suffixes_of(text: str, hot: list[dict]):
    """Per shared anchor: its mask of windows (bit o: the window that starts o words
    before) and the words they cover, as bytes; per anchor with too many
    occurrences: each window by the hash of its 35 words, its longest prefix."""
    hashes = hashes_of(words_of(text))
    grams, least, _ = anchors_of(hashes)
    places = np.array([h["pos"] for h in hot], np.int64)
    many = np.array([h["many"] for h in hot], bool)
    offsets = np.arange(STARTS)
    starts = places[:, None] - offsets[None, :]
    inside = (starts >= 0) & (starts < len(least))
    own = inside & (least[np.clip(starts, 0, len(least) - 1)] == grams[places][:, None])
    used = own.any(axis=1)
    places, many, own = places[used], many[used], own[used]
    masks = (own.astype(np.int64) << offsets).sum(axis=1)
    last, first = STARTS - 1 - np.argmax(own[:, ::-1], axis=1), np.argmax(own, axis=1)
    if many.any():
        windows = stretches(hashes, WINDOW)
        rows, offset = np.nonzero(own & many[:, None])
        # with the offset: a window may have equal least prefixes, and isn't its own repeat
        keys = mixed(windows[places[rows] - offset] + offset.astype(np.uint64) * np.uint64(BASE))
        for key, place, o in zip(keys.tolist(), places[rows].tolist(), offset.tolist(), strict=True):
            yield WIDE, key, 1 << o, b"", place
    narrow = np.flatnonzero(~many)
    if len(narrow):
        span = np.arange(-(STARTS - 1), WINDOW)
        at = places[narrow, None] + span[None, :]
        take = (span >= -last[narrow, None]) & (span < WINDOW - first[narrow, None])
        flat = hashes[at[take]].view(np.uint8).reshape(-1, 8)[:, :BYTES].tobytes()
        ends = np.r_[0, np.cumsum(take.sum(axis=1))] * BYTES
        for i, row in enumerate(narrow):
            key = int(grams[places[row]])
            yield OWN, key, int(masks[row]), flat[ends[i] : ends[i + 1]], int(places[row])


def _find_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's suffixes; of equal ones the first goes to the group of its prefix
    with their number, the others are known to be repeated and go anywhere."""
    rows: dict[tuple, list] = {}
    passed: dict[tuple, int] = defaultdict(int)  # all such windows of an anchor at once

    def hand_on() -> Iterator[pa.RecordBatch]:
        own = [(k, key, n, m, w, *ref) for (k, key, m, w), (n, ref) in rows.items()]
        more = [(PASSED, i, 1, m, b"", *ref) for i, (ref, m) in enumerate(passed.items())]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        kinds += [pa.int64(), pa.int64(), pa.int32()]
        every = own + more
        for at in range(0, len(every), 1 << 15):
            part = zip(*every[at : at + (1 << 15)], strict=True)
            columns = [pa.array(list(c), k) for c, k in zip(part, kinds, strict=True)]
            names = ["kind", "key", "weight", "mask", "words", "doc_id", "hash", "pos"]
            keys = np.asarray(columns[1]).view(np.uint64)
            route = _signed(mixed(keys))
            yield pa.RecordBatch.from_arrays([route, *columns], names=["route", *names])

    for batch in batches:
        hot = batch.column("hot").to_pylist()
        for (doc, text_hash, text), anchors in zip(_documents(batch), hot, strict=True):
            for kind, key, mask, words, place in _suffixes_of(text, anchors):
                signed = key - (1 << 64) if key >> 63 else key
                found = rows.get((kind, signed, mask, words))
                if found is None:
                    rows[(kind, signed, mask, words)] = [1, (doc, text_hash, place)]
                else:
                    found[0] += 1
                    passed[(doc, text_hash, place)] |= mask
        if len(rows) + len(passed) >= GATHERED // 4:
            yield from hand_on()
            rows.clear()
            passed.clear()
    yield from hand_on()


def _nodes(key: np.ndarray, words: np.ndarray, depths: int) -> np.ndarray:
    """For each row and depth d, the number of its node at depth d of the suffix
    tree under its key: the rows sorted, cut where the common prefix is shorter."""
    n, width = words.shape
    raw = np.empty((n, 8 + width * BYTES), np.uint8)
    raw[:, :8] = key.view(np.uint8).reshape(n, 8)
    raw[:, 8:] = (
        np.ascontiguousarray(words).view(np.uint8).reshape(n, width, 8)[:, :, :BYTES].reshape(n, -1)
    )
    order = np.argsort(raw.view(f"S{raw.shape[1]}").ravel(), kind="stable")
    sorted_words, sorted_key = words[order], key[order]
    equal = sorted_words[1:] == sorted_words[:-1]
    common = np.where(equal.all(axis=1), width, np.argmin(equal, axis=1))
    common[sorted_key[1:] != sorted_key[:-1]] = -1
    nodes = np.empty((depths + 1, n), np.int64)
    for depth in range(depths + 1):
        nodes[depth, order] = np.cumsum(np.r_[True, common < depth])
    return nodes


def repeated_masks(key, mask, weight, contents: list[bytes]) -> np.ndarray:
    """Of each suffix's windows, those that occur twice or more under its prefix.

    The window that starts o words before the anchor is the last o words of the
    left context and the first 35 - o of the suffix: it is repeated where the
    node at depth 35 - o has leaves that agree in those left words, too. These
    deep inner nodes, with all their left extensions, are the maximal repeats.
    """
    n = len(key)
    bits = (mask[:, None] >> np.arange(STARTS)) & 1 == 1
    last, first = STARTS - 1 - np.argmax(bits[:, ::-1], axis=1), np.argmax(bits, axis=1)
    flat = np.frombuffer(b"".join(contents), np.uint8).reshape(-1, BYTES)
    word = np.zeros((len(flat) + 1, 8), np.uint8)
    word[:-1, :BYTES] = flat
    value = word.view(np.uint64).ravel()
    ends = np.cumsum([0, *(len(c) // BYTES for c in contents)])[:-1] + last  # the anchors
    right, left = np.arange(WINDOW), np.arange(1, STARTS)
    has_right, has_left = right < WINDOW - first[:, None], left <= last[:, None]
    rights = value[np.where(has_right, ends[:, None] + right, len(flat))]
    lefts = value[np.where(has_left, ends[:, None] - left, len(flat))]
    down, up = _nodes(key, rights, WINDOW), _nodes(key, lefts, STARTS - 1)
    found = np.zeros(n, np.int64)
    for offset in range(STARTS):
        rows = np.flatnonzero(bits[:, offset])
        both = down[WINDOW - offset, rows] * (n + 1) + up[offset, rows]
        _, group = np.unique(both, return_inverse=True)
        total = np.bincount(group, weights=weight[rows])
        found[rows[total[group] >= 2]] |= 1 << offset
    return found


REPEATED = f"{REF}, mask INT"


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _whole_runs(batches, GROUP):
        kind = rows.column("kind").to_numpy()
        mask = rows.column("mask").to_numpy().astype(np.int64)
        found = np.where((kind == PASSED) | (_totals(rows) >= 2), mask, 0)
        tree = np.flatnonzero((kind == OWN) & (found > 0))
        if len(tree):
            own = rows.take(pa.array(tree))
            found[tree] = repeated_masks(
                own.column("key").to_numpy(),
                mask[tree],
                own.column("weight").to_numpy(),
                own.column("words").to_pylist(),
            )
        kept = rows.select(["doc_id", "hash", "pos"]).append_column(
            "mask", pa.array(found.astype(np.int32))
        )
        yield from kept.filter(pa.array(found > 0)).combine_chunks().to_batches()


def _covered(n_words: int, repeated: list[dict]) -> np.ndarray:
    pos = np.array([r["pos"] for r in repeated], np.int64)
    mask = np.array([r["mask"] for r in repeated], np.int64)
    rows, offset = np.nonzero((mask[:, None] >> np.arange(STARTS)) & 1)
    starts = pos[rows] - offset
    step = np.bincount(starts, minlength=n_words + 1) - np.bincount(
        starts + WINDOW, minlength=n_words + 1
    )
    return np.cumsum(step[:n_words]) > 0


def _remove(batches: Iterator[pa.RecordBatch], layout: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        repeated = batch.column("repeated").to_pylist()
        for (_, _, text), found in zip(_documents(batch), repeated, strict=True):
            words = words_of(text)
            n_words.append(len(words))
            if found:
                covered = _covered(len(words), found)
                words = [w for w, gone in zip(words, covered.tolist(), strict=True) if not gone]
            n_removed.append(n_words[-1] - len(words))
            kept.append(text if layout and not n_removed[-1] else " ".join(words))
        names = [n for n in batch.schema.names if n not in ("hash", "text", "repeated")]
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(n) for n in names],
                pa.array(n_words, pa.int64()),
                pa.array(n_removed, pa.int64()),
                pa.array(kept, pa.string()),
            ],
            names=[*names, "n_words", "n_removed", "kept"],
        )


def _same_row(left: DataFrame, right: DataFrame):
    return left["doc_id"].eqNullSafe(right["_doc_id"]) & (left["hash"] == right["_hash"])


def without_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", layout: bool = False
) -> DataFrame:
    """Each row of ``docs`` as ``row`` (a struct of the columns but the text, and
    ``no_text``, true for a null one), with ``n_words``, ``n_removed`` and ``kept``:
    the words outside all repeated 35-word windows, joined by blanks. With
    ``layout`` a text that loses no words is kept as it was written.

    A window is repeated when its words also start anywhere else in the corpus,
    in the same document too; all its occurrences go, none is spared.

    1. Anchors: each window's least 8-word prefix. Equal windows have equal
       anchors, so only anchors that occur twice or more can bear repeats. Equal
       anchors of a task are counted before the shuffle, so a group gets at most
       a row per task, however often a passage comes.
    2. Documents with shared anchors send, per anchor, the suffix that starts
       there with its left context, to the group of its 8-word prefix. Prefixes
       with more than 20,000 occurrences are lengthened to whole windows, which
       again are counted before the shuffle.
    3. Each group is a suffix tree of bounded size (``repeated_masks``).
    4. The repeated windows go back to their documents.

    Rows with null texts have no words; rows are told apart by key and text, and
    repeated rows repeat each other; null keys are a key like others; no rows
    give no rows. Other columns travel along unread.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    rows = docs.select(
        F.struct(*others, F.col(text).isNull().alias("no_text")).alias("row"),
        F.col(key).cast("long").alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.xxhash64(text).alias("hash"),
    )
    narrow = rows.select("doc_id", "hash", "text")
    found = narrow.mapInArrow(_find_anchors, ANCHOR)
    dealt = found.repartition("route").sortWithinPartitions("kind", "key")
    shared = materialise(dealt.mapInArrow(_shared_anchors, SHARED), "shared-anchors")
    # written, so that its size is known and the hot keys need not be shuffled for it
    many = shared.groupBy("key").count().where(F.col("count") > GROUP)
    sized = shared.join(materialise(many, "long-prefixes"), "key", "left")
    hot = sized.groupBy(F.col("doc_id").alias("_doc_id"), F.col("hash").alias("_hash")).agg(
        F.collect_set(F.struct("pos", F.col("count").isNotNull().alias("many"))).alias("hot")
    )
    with_hot = rows.join(hot, _same_row(rows, hot)).drop("_doc_id", "_hash")
    suffixes = with_hot.mapInArrow(_find_suffixes, SUFFIX)
    grouped = suffixes.repartition("route").sortWithinPartitions("kind", "key")
    windows = grouped.mapInArrow(_subtrees, REPEATED)
    repeated = windows.groupBy(F.col("doc_id").alias("_doc_id"), F.col("hash").alias("_hash")).agg(
        F.collect_set(F.struct("pos", "mask")).alias("repeated")
    )
    marked = rows.join(repeated, _same_row(rows, repeated), "left").drop("_doc_id", "_hash")
    row_type = rows.schema["row"].dataType.simpleString()
    return marked.mapInArrow(
        lambda batches: _remove(batches, layout),
        f"row {row_type}, doc_id BIGINT, n_words BIGINT, n_removed BIGINT, kept STRING",
    )


def digests(docs: DataFrame) -> DataFrame:
    """The digest rows of the query."""
    return without_repeats(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )
