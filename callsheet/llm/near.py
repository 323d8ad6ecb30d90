"""Near-duplicate classes by weighted MinHash over TF-IDF shingles."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsheet.llm.components import components
from callsheet.llm.words import BASE, hashes_of, mixed, stretches, words_of
from callsheet.session import materialise

#: Words of a shingle, least similarity of a link.
WORDS, SIMILAR = 5, 0.8
#: Bands of samples: two texts of similarity s meet with 1 - (1 - s**4)**16,
#: which is 0.9998 at 0.8.
BANDS, ROWS = 16, 4
SAMPLES = BANDS * ROWS
#: Pairs with fewer equal samples are not compared in full: 0.8 is 4 standard
#: deviations above.
LEAST_EQUAL = 38
#: Buckets that document frequencies are counted in.
BUCKETS = 1 << 16
#: Texts that are compared with each other in one task.
GROUP = 4096
#: Pairs that are held at a time.
PAIRS = 1 << 21
#: Bits of a filter for each of its nodes, and bits of a filter at most.
FILTER_BITS, MOST_BITS = 16, 1 << 27
#: Shingles whose samples are drawn together.
BLOCK = 1 << 14

#: What is kept of a shingle's hash: its upper 48 bits.
_KEPT = np.uint64(((1 << 64) - 1) ^ ((1 << 16) - 1))
_SEEDS = mixed(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)


def shingles_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (hashes, ascending) and how often each comes. A text of
    fewer than five words is one shingle, a text without words has none."""
    words = words_of(text or "")
    hashes = hashes_of(words)
    found = stretches(hashes, min(WORDS, len(words)) or 1)
    return np.unique(found & _KEPT, return_counts=True)


#: Bytes of a shingle's hash that are written.
BYTES = 6
SHINGLED = "doc_id BIGINT, node BINARY, shingles BINARY, counts BINARY"


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's shingles and how often each comes, packed; null texts have none."""
    for batch in batches:
        shingles, counts = [], []
        for text in batch.column("text").to_pylist():
            own, n = shingles_of(text)
            shingles.append(own.view(np.uint8).reshape(-1, 8)[:, 8 - BYTES :].tobytes())
            counts.append(b"" if (n == 1).all() else n.astype(np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("node"),
                pa.array(shingles, pa.binary()),
                pa.array(counts, pa.binary()),
            ],
            names=["doc_id", "node", "shingles", "counts"],
        )


def packed_shingles(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The shingles of every text, written; ``node`` is the text's digest."""
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        F.col(text).alias("text"),
        F.unhex(F.md5(F.col(text))).alias("node"),
    )
    return materialise(rows.mapInArrow(_shingled, SHINGLED), "shingles")


def _forget(written: DataFrame) -> None:
    """Remove the files of an intermediate that no later step reads."""
    files = written.inputFiles()
    if files:
        spark = written.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(unquote(files[0])).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _unpacked(shingles: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, of which the upper bytes were kept, and counts."""
    flat = np.frombuffer(shingles, np.uint8).reshape(-1, BYTES)
    whole = np.zeros((len(flat), 8), np.uint8)
    whole[:, 8 - BYTES :] = flat
    number = np.frombuffer(counts, np.uint32) if counts else np.ones(len(flat), np.uint32)
    return whole.view(np.uint64).ravel(), number


def _packed_rows(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    columns = (batch.column(c).to_pylist() for c in ("shingles", "counts"))
    for shingles, counts in zip(*columns, strict=True):
        yield _unpacked(shingles, counts)


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (mixed(shingles) >> np.uint64(48)).astype(np.int64)


# --- weights ---------------------------------------------------------------------


def _count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, documents = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for shingles, _ in _packed_rows(batch):
            if len(shingles):
                total[np.unique(_bucket(shingles))] += 1
                documents += 1
    bucket = np.flatnonzero(total)
    if documents:
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[-1, bucket]), pa.array(np.r_[documents, total[bucket]])],
            names=["bucket", "n"],
        )


def inverse_frequencies(shingled: DataFrame) -> np.ndarray:
    """For each bucket ln(1 + N / (df + N / 10)), over all documents with words.

    df is the number of documents with a shingle in the bucket, summed in each
    task before the shuffle. A tenth of all documents is added to it: shingles of
    boilerplate that a large share has weigh less, but copies of a text do not
    sink below the words that tell them apart. What comes to the driver is a
    row per bucket, at most 65,537, whatever the data's size.
    """
    counted = shingled.select("shingles", "counts").mapInArrow(_count_buckets, "bucket BIGINT, n BIGINT")
    rows = counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    frequency = np.zeros(BUCKETS)
    documents = 1
    for row in rows:
        if row["bucket"] < 0:
            documents = row["n"]
        else:
            frequency[row["bucket"]] = row["n"]
    return np.log1p(documents / (frequency + documents / 10)).astype(np.float32)


# --- samples -----------------------------------------------------------------------


def _gamma_table() -> tuple[np.ndarray, np.ndarray]:
    """2**16 quantiles of the Gamma(2, 1) distribution, and their inverses."""
    p = (np.arange(1 << 16) + 0.5) / (1 << 16)
    low, high = np.zeros(1 << 16), np.full(1 << 16, 40.0)
    for _ in range(60):
        middle = (low + high) / 2
        under = 1 - np.exp(-middle) * (1 + middle) < p
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    return low.astype(np.float32), (1 / low).astype(np.float32)


_GAMMA, _INVERSE = _gamma_table()


def samples(shingles: np.ndarray, log_weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Improved consistent weighted samples of each text (rows ``starts[i]`` on).

    For shingle and seed, r and c are Gamma(2, 1) and beta is uniform, all drawn
    from the shingle's hash. With t = floor(ln w / r + beta), the shingle with
    the least ln c - r (t - beta + 1) is sampled together with its t: two texts
    draw the same sample with a probability of their weighted Jaccard similarity.
    """
    sizes = np.diff(np.r_[starts, len(shingles)])
    found = np.empty((len(starts), SAMPLES), np.uint64)
    for number, seed in enumerate(_SEEDS):
        x = shingles * seed
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        parts = x.view(np.uint16).reshape(-1, 4)
        r = _GAMMA[parts[:, 0]]
        beta = parts[:, 1] * np.float32(2**-16)
        u = (parts[:, 2] + np.float32(0.5)) * ((parts[:, 3] + np.float32(0.5)) * np.float32(2**-32))
        t = np.floor(log_weight * _INVERSE[parts[:, 0]] + beta)
        score = np.log(-np.log(u)) - r * (t - beta + np.float32(1))
        least = np.minimum.reduceat(score, starts)
        hits = np.flatnonzero(score == np.repeat(least, sizes))
        hit = hits[np.searchsorted(hits, starts)]
        found[:, number] = shingles[hit] + t[hit].astype(np.int64).view(np.uint64) * np.uint64(BASE)
    return mixed(found ^ _SEEDS)


def band_keys(drawn: np.ndarray) -> np.ndarray:
    bands = drawn.reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), bands.shape[:2])
    for row in range(ROWS):
        key = mixed(key * np.uint64(BASE) + bands[:, :, row])
    return key


def _signatures(idf: np.ndarray):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[list[int]] = [[] for _ in range(batch.num_rows)]
            marks: list[bytes] = [b""] * batch.num_rows
            waiting: list[tuple[int, np.ndarray, np.ndarray]] = []
            size = 0

            def draw(waiting, keys, marks):
                if not waiting:
                    return
                shingles = np.concatenate([w[1] for w in waiting])
                weight = np.concatenate([w[2] for w in waiting])
                starts = np.cumsum([0, *(len(w[1]) for w in waiting[:-1])])
                drawn = samples(shingles, np.log(weight).astype(np.float32), starts)
                signed = band_keys(drawn).view(np.int64).tolist()
                mark = (drawn >> np.uint64(56)).astype(np.uint8)
                for (row, *_), own, seen in zip(waiting, signed, mark, strict=True):
                    keys[row], marks[row] = own, seen.tobytes()

            for row, (shingles, counts) in enumerate(_packed_rows(batch)):
                if len(shingles):
                    waiting.append((row, shingles, counts * idf[_bucket(shingles)]))
                    size += len(shingles)
                if size >= BLOCK:
                    draw(waiting, keys, marks)
                    waiting, size = [], 0
            draw(waiting, keys, marks)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("node"),
                    pa.array(keys, pa.list_(pa.int64())),
                    pa.array(marks, pa.binary()),
                ],
                names=["doc_id", "node", "bands", "mark"],
            )

    return sign


# --- comparing ---------------------------------------------------------------------


def weighted_jaccard(a, b) -> float:
    """Sum of the smaller over sum of the larger weights of two (shingles, weights)."""
    place = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    both = b[0][place] == a[0]
    common = float(np.minimum(a[1][both], b[1][place[both]]).sum())
    return common / max(float(a[1].sum()) + float(b[1].sum()) - common, 1e-300)


def links_within(
    marks: np.ndarray, profile, n: int, split: int = 0, earlier: np.ndarray | None = None
) -> Iterator[tuple[int, int]]:
    """Links that connect whatever is similar among ``n`` texts, at most n - 1.

    All pairs with enough equal samples are compared, the likeliest first among
    some millions, but for those that are connected already. With ``split``,
    only pairs of one of the first ``split`` texts and one of the others are
    meant. Pairs with an equal value in a row of ``earlier`` (a row per band)
    are left to the bucket of that band.
    """
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    turned = np.ascontiguousarray(marks.T)
    known: dict[int, tuple] = {}
    firsts, seconds, equals, size = [], [], [], 0
    last = (split or n) - 1
    roots = np.arange(n)
    for i in range(last + 1):
        start = split or i + 1
        equal = (turned[:, start:] == turned[:, i : i + 1]).sum(axis=0, dtype=np.uint8)
        near = np.flatnonzero((equal >= LEAST_EQUAL) & (roots[start:] != roots[i]))
        if earlier is not None and len(near):
            near = near[~(earlier[:, near + start] == earlier[:, i : i + 1]).any(axis=0)]
        if len(near):
            firsts.append(np.full(len(near), i))
            seconds.append(near + start)
            equals.append(equal[near].astype(np.int64))
            size += len(near)
        if size >= PAIRS or (i == last and size):
            first, second = np.concatenate(firsts), np.concatenate(seconds)
            order = np.argsort(-np.concatenate(equals), kind="stable")
            for a, b in zip(first[order].tolist(), second[order].tolist(), strict=True):
                if root(a) != root(b):
                    for k in (a, b):
                        if k not in known:
                            known[k] = profile(k)
                    if weighted_jaccard(known[a], known[b]) >= SIMILAR:
                        parent[root(b)] = root(a)
                        yield a, b
            firsts, seconds, equals, size = [], [], [], 0
            roots = np.array([root(k) for k in range(n)])


def _compare(idf: np.ndarray):
    """Sorted rows of (grp, node) to verified links; a group is at most a task's.

    The rows of a group with ``side`` 0 and 1 are two blocks of a wide bucket,
    whose texts are compared across; all others are compared with one another.
    """

    def resolve(rows: list[tuple]) -> list[tuple[bytes, bytes]]:
        if len(rows) < 2:
            return []
        rows.sort(key=lambda r: r[4])  # stable
        split = sum(r[4] == 0 for r in rows)
        if split == len(rows):
            split = 0
        elif not split and rows[0][4] == 1:  # the other block is empty
            return []
        marks = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), SAMPLES)
        earlier = None
        if rows[0][5] is not None:
            bands = np.array([r[5] for r in rows], np.int64).T
            own = np.flatnonzero(bands[:, 0] == int(rows[0][0].split()[1]))[0]
            earlier = np.ascontiguousarray(bands[:own])

        def profile(i: int):
            shingles, counts = _unpacked(*rows[i][3])
            return shingles, (counts * idf[_bucket(shingles)]).astype(np.float64)

        links = links_within(marks, profile, len(rows), split, earlier)
        return [(rows[i][1], rows[j][1]) for i, j in links]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            found = []
            names = ("grp", "node", "mark", "side", "bands", "shingles", "counts")
            columns = (batch.column(c).to_pylist() for c in names)
            for *own, side, bands, shingles, counts in zip(*columns, strict=True):
                row = (*own, (shingles, counts), side, bands)
                if row[0] != group:
                    found += resolve(held)
                    group, held = row[0], []
                if not held or held[-1][1] != row[1]:  # repeated rows stand once
                    held.append(row)
            if found:
                yield _pairs(found)
        yield _pairs(resolve(held))

    return run


def _pairs(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) if found else [(), ()]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), pa.binary()) for c in columns], names=["a", "b"]
    )


def _refined(entries: DataFrame) -> DataFrame:
    """``grp``, ``node`` and ``side`` of all buckets of texts whose candidates are
    too many for one task.

    A bucket of up to ``GROUP`` texts is a group. The texts of a wider one are
    dealt by their hash to blocks of somewhat fewer, and every block with itself
    and every two blocks are a group, so that all its pairs meet in some task.
    """
    sizes = entries.groupBy("key").count().where("count > 1")
    name = F.concat(F.lit("bucket "), F.col("key").cast("string"))
    sized = entries.join(sizes, "key").select("key", "node", "count", name.alias("grp"))
    fit = sized.where(F.col("count") <= GROUP).select("grp", "node", F.lit(0).alias("side"))
    blocks = F.ceil(F.col("count") * 1.1 / GROUP).cast("int")
    dealt = sized.where(F.col("count") > GROUP).select(
        "grp", "node", blocks.alias("n"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("own")
    )
    met = dealt.select("grp", "node", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    two = F.concat_ws(" ", "grp", F.least("own", "other"), F.greatest("own", "other"))
    return fit.union(
        met.select(two.alias("grp"), "node", F.when(F.col("own") > F.col("other"), 1).otherwise(0))
    )


def _passing(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The ``rows`` whose node is one of ``nodes`` (distinct), and one in 16 or so of
    the others: a filter for what is too wide to be shuffled before a join with them.

    The filter has a bit for each place that a node's hash may take. It is put together
    in Spark from pieces of 32,768 bits; 16 MB at most come to the driver and are
    broadcast. Beyond 8 million nodes it has fewer bits for each and lets more pass.
    """
    size = min(MOST_BITS, max(1 << 15, -(-FILTER_BITS * nodes.count() // (1 << 15)) << 15))
    place = F.pmod(F.xxhash64("node"), F.lit(size))
    pieces = (
        nodes.select(F.shiftright(place, 15).alias("piece"), (place % (1 << 15)).alias("bit"))
        .groupBy("piece")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
    )
    filled = np.zeros((size >> 15, 1 << 12), np.uint8)
    for row in pieces.toLocalIterator():
        filled[row["piece"]] = np.frombuffer(row["bits"], np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(filled.ravel())

    @F.arrow_udf("boolean")
    def passes(places: pa.Array) -> pa.Array:
        at = places.to_numpy()
        return pa.array(shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1)

    return rows.where(passes(place))


def _rooted(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """``doc_id`` and ``node`` of every row; and for each node its ``least`` key,
    whether it has ``several`` rows, and the ``root`` of its class: the least node
    linked with it, which tells classes apart where their keys do not."""
    shingled = packed_shingles(docs, key, text)
    idf = inverse_frequencies(shingled)
    signed = materialise(
        shingled.mapInArrow(
            _signatures(idf), "doc_id BIGINT, node BINARY, bands ARRAY<BIGINT>, mark BINARY"
        ),
        "signatures",
    )
    nodes = materialise(
        signed.where(F.col("node").isNotNull() & (F.size("bands") > 0))
        .groupBy("node")
        .agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("mark").alias("mark")),
        "nodes",
    )
    entries = nodes.select("node", F.explode("bands").alias("key"))
    centres = entries.groupBy("key").agg(F.min("node").alias("b"), F.count("*").alias("n"))
    met = entries.join(centres.where("n > 1"), "key").where("node <> b")
    groups = materialise(components(met.select(F.col("node").alias("a"), "b"), "met"), "groups")
    sizes = groups.groupBy("root").count().where(F.col("count") > GROUP)
    sized = materialise(groups.join(sizes, "root", "left"), "group-sizes")
    normal = sized.where("count IS NULL").select(
        F.hex("root").alias("grp"), "node", F.lit(0).alias("side")
    )
    large = sized.where("count IS NOT NULL").select("node")
    grouped = normal
    if not large.isEmpty():
        finer = _refined(entries.join(large, "node", "left_semi").select("key", "node"))
        grouped = materialise(normal.union(finer), "finer-groups")
    known = grouped.join(nodes.select("node", "mark", "bands", F.col("doc_id").alias("_first")), "node")
    known = known.withColumn("bands", F.when(F.col("grp").startswith("bucket "), F.col("bands")))
    wanted = _passing(shingled, groups).select(
        F.col("doc_id").alias("_id"), F.col("node").alias("_node"), "shingles", "counts"
    )
    texts = known.join(
        wanted, (F.col("node") == F.col("_node")) & F.col("_first").eqNullSafe(F.col("_id"))
    )
    dealt = texts.select("grp", "node", "mark", "side", "bands", "shingles", "counts").repartition("grp")
    links = materialise(
        dealt.sortWithinPartitions("grp", "node").mapInArrow(_compare(idf), "a BINARY, b BINARY"),
        "links",
    )
    _forget(shingled)  # the links are written, and nothing else reads them
    classes = materialise(components(links, "classes"), "class-roots")

    ids = signed.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.min("doc_id").alias("least"), (F.count("*") > 1).alias("several")
    )
    rooted = ids.join(classes, "node", "left").select(
        "node", "least", "several", F.coalesce("root", "node").alias("root")
    )
    return signed.select("doc_id", "node"), materialise(rooted, "rooted")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``node`` (a text's digest) and ``class_id`` for every row of
    ``docs``: the least key of all rows whose texts are equal or linked over any
    number of links between texts of weighted Jaccard similarity 0.8 or more.

    1. The five-word shingles of each text are written once, as 48 bits of hash, and
       weighed by TF-IDF (``inverse_frequencies``).
    2. 64 consistent weighted samples of each text, in 16 bands of 4.
    3. Equal texts are one node. Nodes that share a band's bucket are linked to
       the bucket's least node, and the components of these links are the groups
       of candidates; no pairs are made of them. Groups beyond 4,096 texts are
       split into their buckets, and wider buckets into pairs of blocks: the
       texts of a bucket of n are read by n / 3,700 tasks.
    4. The shingles of texts in groups (told by a filter, ``_passing``, before they are
       shuffled) come to their groups, where pairs with enough equal samples are
       verified by weighted Jaccard similarity, unless they are connected already.
    5. The components of the verified links are the classes.

    A null text is a class of its own with each key; texts without words are
    similar to equal texts only; rows of one key with different texts may be in
    different classes; a class of null keys only has a null id; repeated rows
    stay; no rows give no rows. Other columns are not read.
    """
    narrow, rooted = _rooted(docs, key, text)
    named = rooted.groupBy("root").agg(F.min("least").alias("class_id"))
    of_node = materialise(rooted.join(named, "root").select("node", "class_id"), "class-ids")
    return (
        narrow.where(F.col("node").isNotNull())
        .join(of_node, "node")
        .select("doc_id", "node", "class_id")
        .union(
            narrow.where(F.col("node").isNull()).select(
                "doc_id", "node", F.col("doc_id").alias("class_id")
            )
        )
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, that with the least key (null keys last) and of its
    texts the least digest, with all columns as they are. Classes are told apart by
    their links, not by their keys, which may be null or repeated. Rows with null
    texts are kept, each once for its key. Of rows equal in key and text the least
    stays, by their other columns written as JSON."""
    columns = docs.columns
    narrow, rooted = _rooted(docs, key, text)
    least = F.min(F.struct(F.col("least").isNull(), "least", "node", "several"))
    first = rooted.groupBy("root").agg(least.alias("_first")).select(
        F.col("_first.least").alias("_id"),
        F.col("_first.node").alias("_node"),
        F.col("_first.several").alias("_again"),
    )
    blank = narrow.where(F.col("node").isNull()).groupBy("doc_id", "node").agg(
        (F.count("*") > 1).alias("_again")
    )
    first = materialise(first.union(blank), "kept-rows")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"),
        F.col(key).cast("long").alias("_key"),
        F.unhex(F.md5(F.col(text))).alias("_digest"),
    )
    kept = rows.join(
        first,
        F.col("_key").eqNullSafe(F.col("_id")) & F.col("_digest").eqNullSafe(F.col("_node")),
    )
    once = kept.where(~F.col("_again")).select("_row")
    again = kept.where("_again").groupBy("_id", "_node").agg(
        F.min_by("_row", F.to_json("_row", {"ignoreNullFields": "false"})).alias("_row")
    )
    return once.union(again.select("_row")).select(*[F.col("_row")[c].alias(c) for c in columns])


def digests(docs: DataFrame) -> DataFrame:
    """The rows of the query: every document with its class."""
    return near_duplicates(docs).select("doc_id", "class_id")
