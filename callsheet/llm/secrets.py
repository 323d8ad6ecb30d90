"""Secret scans: fixed kinds, and sliding-window entropy (SQL functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in their order, pattern, counted group, least characters.
KINDS = (
    (
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
    ),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]+", 0, 32),
)
#: What a text must hold before its matches are looked for one by one.
HINTS = {
    "assign": r"(?i:password|passwd|secret|token|api_?key)",
    "access": "AKIA[A-Z0-9]{12}",
    "hex": "(?<![0-9a-f])[0-9a-f]{32}",
}
#: Candidates of the entropy scan: whole runs of these characters.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
CANDIDATE = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
#: Patterns begin with ^, as they would else be tried from every character of a run.
#: Least bits per character, in some window, by class of the candidate: hex digits
#: of both sorts, upper or lower case with digits, both cases with digits, both
#: cases without.
CLASSES = (
    ("^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]+$", 3.0),
    ("^(?=.*[0-9])(?=.*[A-Za-z])(?:[0-9a-z+/_-]+|[0-9A-Z+/_-]+)$", 3.4),
    ("^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])", 3.6),
    ("^(?=.*[a-z])(?=.*[A-Z])[A-Za-z]+$", 3.85),
)
WINDOW = 20
#: Windows that overlap any of these are known to hold no secret.
ALLOWED = "(?i)example|sample|placeholder|dummy|xxxxxx|000000|abcdef|12345678"

#: Counts that share a number of 64 bits, a byte each; so windows have 127 characters at most.
PACKED, BITS = 8, 8
SPAN = "struct<at:bigint,kind:int,until:bigint,name:string>"
#: Items that are folded together before their results are joined.
BLOCK = 256


# --- helpers for arrays that are built along a text ----------------------------------


def _let(value: Column, body) -> Column:
    """``body(value)``, with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _folded(items: Column, kind: str, step) -> tuple:
    """The place after all ``items`` and an array (of ``kind``) of what they add.

    ``step(place, item)`` returns the next place, whether the item adds anything, and
    what. Appending copies an array, so items are folded in blocks, whose results
    are then joined.
    """
    none = F.expr(f"CAST(array() AS array<{kind}>)")

    def add(state: Column, item: Column) -> Column:
        place, wanted, value = step(state["at"], item)
        out = F.when(wanted, F.concat(state["out"], F.array(value))).otherwise(state["out"])
        return F.struct(place.cast("long").alias("at"), out.alias("out"))

    def start(place: Column) -> Column:
        return F.struct(place.cast("long").alias("at"), none.alias("out"))

    def join(state: Column, block: Column) -> Column:
        return _let(
            F.aggregate(block, start(state["at"]), add),
            lambda inner: F.struct(inner["at"].alias("at"), F.concat(state["out"], inner["out"]).alias("out")),
        )

    def whole(held: Column) -> Column:
        last = F.floor((F.size(held) - 1) / BLOCK).cast("int")
        numbers = F.when(F.size(held) > 0, F.sequence(F.lit(0), last)).otherwise(
            F.expr("CAST(array() AS array<int>)")
        )
        blocks = F.transform(numbers, lambda b: F.slice(held, b * BLOCK + 1, F.lit(BLOCK)))
        return F.aggregate(blocks, start(F.lit(0)), join)

    return _let(items, whole)


def _steps(text: Column, pattern: str) -> Column:
    """The stretches between the matches of a pattern, each with the match behind it.

    ``split`` and ``regexp_extract_all`` stop at the same matches, so the lengths
    give the places.
    """
    between = F.transform(F.split(text, pattern, -1), lambda b: F.length(b).cast("long"))
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.arrays_zip(between.alias("gap"), matches.alias("match"))


def _spans(text: str, pattern: str, number: int, name: str, wanted) -> Column:
    """All matches, leftmost first and without overlap, as spans in code points.

    ``wanted`` tells from a match and its number whether it stays.
    """

    def step(place: Column, item: Column):
        at = place + item["gap"]
        until = at + F.coalesce(F.length(item["match"]), F.lit(0))
        span = F.struct(
            at.alias("at"), F.lit(number).alias("kind"), until.alias("until"), F.lit(name).alias("name")
        )
        return until, wanted(item), span

    return _folded(_steps(F.col(text), pattern), SPAN, step)["out"]


# --- entropy ----------------------------------------------------------------------------


def _grown(window: int) -> Column:
    """By how much the sum of c * log2(c) grows where a count goes from c to c + 1."""
    worth = [c * math.log2(c) if c else 0.0 for c in range(window + 2)]
    return F.lit([b - a for a, b in zip(worth, worth[1:], strict=False)])


def _listed(candidate: Column) -> Column:
    """For each character whether it is part of an allow-listed word."""
    stretch = lambda n, value: F.array_repeat(F.lit(value), n.cast("int"))
    return F.flatten(
        F.transform(
            _steps(candidate, ALLOWED),
            lambda x: F.concat(
                stretch(x["gap"], False), stretch(F.coalesce(F.length(x["match"]), F.lit(0)), True)
            ),
        )
    )


def best_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits per character, of any window that holds
    no character of an allow-listed word.

    One pass over the characters, of which each becomes a code once: the counts of
    the window, packed into a few numbers, and the sum of c * log2(c) are updated
    by the character that leaves and the one that comes, so a step costs the same
    in a run of any length. A string without such a window gives 0.
    """
    if window > 127:
        raise ValueError("a window has 127 characters at most")
    slots, grown = -(-len(ALPHABET) // PACKED), _grown(window)
    bits = math.log2(window)

    def coded(c: Column) -> Column:
        """A character as the slot of its count, the place in it, and one unit there."""
        code = F.instr(F.lit(ALPHABET), c) - 1
        by = code.bitwiseAND(F.lit(PACKED - 1)) * BITS
        one = F.lit(1).cast("long")
        return F.struct(
            F.shiftright(code, 3).alias("slot"), by.alias("by"), F.call_function("shiftleft", one, by).alias("unit")
        )

    def count(state: Column, of: Column) -> Column:
        held = F.lit(0).cast("long")
        for k in range(slots):
            held = F.when(of["slot"] == k, state[f"c{k}"]).otherwise(held)
        return F.call_function("shiftright", held, of["by"]).bitwiseAND(F.lit(127).cast("long")).cast("int")

    def step(state: Column, item: Column) -> Column:
        comes, leaves = item["comes"], item["leaves"]
        left = leaves["slot"] >= 0
        again = left & (leaves["unit"] == comes["unit"]) & (leaves["slot"] == comes["slot"])
        less = F.when(left, count(state, leaves))
        more = count(state, comes) - F.when(again, 1).otherwise(0)
        total = state["total"] + F.get(grown, more) - F.when(left, F.get(grown, less - 1)).otherwise(0.0)

        def moved(k: int) -> Column:
            now = F.when(comes["slot"] == k, state[f"c{k}"] + comes["unit"]).otherwise(state[f"c{k}"])
            return F.when(leaves["slot"] == k, now - leaves["unit"]).otherwise(now).alias(f"c{k}")

        clear = F.when(item["listed"], 0).otherwise(F.least(state["clear"] + 1, F.lit(window)))

        def judged(x: Column) -> Column:
            best = F.when(
                x["clear"] >= window, F.greatest(state["best"], F.lit(bits) - x["total"] / window)
            ).otherwise(state["best"])
            return F.struct(
                *[moved(k) for k in range(slots)],
                x["total"].alias("total"),
                best.alias("best"),
                x["clear"].alias("clear"),
            )

        return _let(F.struct(total.alias("total"), clear.alias("clear")), judged)

    start = F.struct(
        *[F.lit(0).cast("long").alias(f"c{k}") for k in range(slots)],
        F.lit(0.0).alias("total"),
        F.lit(0.0).alias("best"),
        F.lit(0).alias("clear"),
    )

    def walked(held: Column) -> Column:
        none = F.struct(
            F.lit(-1).alias("slot"), F.lit(0).alias("by"), F.lit(0).cast("long").alias("unit")
        )
        steps = F.arrays_zip(
            held.alias("comes"),
            F.slice(F.concat(F.array_repeat(none, window), held), F.lit(1), F.size(held)).alias("leaves"),
            _listed(candidate).alias("listed"),
        )
        return F.aggregate(steps, start, step, lambda state: state["best"])

    return _let(F.transform(F.split(candidate, ""), coded), walked)


def _high_entropy(match: Column) -> Column:
    # lazily: only strings of a class that can be flagged are walked through, once
    least = F.least(*[F.when(match.rlike(pattern), F.lit(bits)) for pattern, bits in CLASSES])
    return _let(
        least, lambda bits: F.when(bits.isNotNull(), best_entropy(match) >= bits).otherwise(False)
    )


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``_base`` and ``_all``: the spans of the fixed kinds, and with those of
    the entropy scan, each sorted by start, then kind.

    Every kind scans the whole text on its own; a span is the whole match. The
    entropy scan adds a candidate run when some window of 20 characters that
    overlaps no allow-listed word reaches its class's bits, unless the run lies
    within a span of a fixed kind. A null or empty text has no spans. Row by row: no
    shuffle.
    """
    clear = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    none = F.expr(f"CAST(array() AS array<{SPAN}>)")
    found = []
    for number, (name, pattern, group, least) in enumerate(KINDS):
        if group:
            counted = lambda item, p=pattern, g=group, n=least: (
                F.length(F.regexp_extract(item["match"], p, g)) >= n
            )
        else:
            counted = lambda item, n=least: F.length(item["match"]) >= n
        spans = _spans("_text", pattern, number, name, counted)
        found.append(F.when(F.col("_text").rlike(HINTS[name]), spans).otherwise(none))
    based = clear.withColumn("_base", F.sort_array(F.concat(*found)))
    entropy = _spans(
        "_text",
        CANDIDATE,
        len(KINDS),
        "entropy",
        lambda item: F.when(item["match"].isNotNull(), _high_entropy(item["match"])),
    )
    more = F.when(F.col("_text").rlike(CANDIDATE), entropy).otherwise(none)
    # in order of their starts: within a fixed span is what ends before the last one does
    both = F.sort_array(F.concat("_base", more))

    def outside(reached: Column, span: Column):
        fixed = span["kind"] < len(KINDS)
        further = F.when(fixed, F.greatest(reached, span["until"])).otherwise(reached)
        return further, fixed | (span["until"] > reached), span

    return based.withColumn("_all", _folded(both, SPAN, outside)["out"])


def _written(spans: str) -> Column:
    return F.array_join(
        F.transform(
            F.col(spans),
            lambda s: F.concat_ws(":", s["name"], s["at"].cast("string"), s["until"].cast("string")),
        ),
        ",",
    )


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The digest rows: counts of the fixed kinds, a hash of their spans, all spans."""
    count = lambda n: F.size(F.filter("_base", lambda s: s["kind"] == n)).cast("long")
    found = with_spans(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")))
    return found.select(
        F.col("doc_id").alias(key),
        *[count(n).alias(f"n_{kind[0]}") for n, kind in enumerate(KINDS)],
        F.sha2(_written("_base"), 256).alias("base_sha256"),
        _written("_all").alias("spans"),
    )


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret, or overlapping secrets, replaced by ``mark``.

    Rows and columns stay as they are (also those named like this package's
    own); a null text stays null, and a text without secrets is not changed.
    """
    whole = docs.select(F.struct("*").alias("_row"), F.col(text).alias("text"))

    def gap(reached: Column, span: Column):
        piece = F.struct(reached.alias("at"), (span["at"] - reached).alias("size"))
        return F.greatest(reached, span["until"]), span["at"] >= reached, piece

    def cut(whole: Column, at: Column, size: Column) -> Column:
        return F.substring(whole, (at + 1).cast("int"), size.cast("int"))

    def block(pieces: Column) -> Column:
        """The pieces, from the stretch of text that holds them: to find a place in a
        text takes a walk to it, which is short there."""
        start = F.get(pieces, F.lit(0))["at"]
        end = F.element_at(pieces, -1)["at"] + F.element_at(pieces, -1)["size"]
        return _let(
            cut(F.col("_text"), start, end - start),
            lambda part: F.array_join(F.transform(pieces, lambda p: cut(part, p["at"] - start, p["size"])), mark),
        )

    def joined(state: Column) -> Column:
        last = F.floor((F.size(state["out"]) - 1) / BLOCK).cast("int")
        blocks = F.transform(
            F.sequence(F.lit(0), last),
            lambda b: _let(F.slice(state["out"], b * BLOCK + 1, F.lit(BLOCK)), block),
        )
        rest = cut(F.col("_text"), state["at"], F.length("_text"))
        return F.array_join(F.concat(blocks, F.array(rest)), mark)

    pieces = _folded(F.col("_all"), "struct<at:bigint,size:bigint>", gap)
    clean = F.when(F.size("_all") > 0, _let(pieces, joined))
    found = with_spans(whole).withColumn("_clean", F.coalesce(clean, F.col("text")))
    return found.select(
        *[
            (F.col("_clean") if name == text else F.col("_row")[name]).alias(name)
            for name in docs.columns
        ]
    )
