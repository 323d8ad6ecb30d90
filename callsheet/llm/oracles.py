"""SQL texts for DuckDB of the numbered queries that SQL can express in full."""

from __future__ import annotations

#: Levels of a tree of 16 children a node that the text of op11 has room for.
LEVELS = 8


def _crc32(text: str) -> str:
    """Unsigned crc32 of an ASCII text, bit by bit (reversed polynomial 0xEDB88320)."""
    bit = "list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    # the low byte is mixed in whole, then eight bits are shifted out
    codes = f"list_transform(string_split({text}, ''), lambda d: CAST(ascii(d) AS BIGINT))"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {codes}), lambda c, b: {bit}), 4294967295)"


TOP_K = """
    WITH fit AS (
        SELECT row_number() OVER () AS row, vec_id,
               list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    scored AS (
        SELECT q.row AS query_row, q.vec_id AS query_id, c.row, c.vec_id,
               CAST(coalesce(list_sum(list_transform(
                   range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i])), 0) AS BIGINT) AS score
        FROM fit q JOIN fit c ON c.row <> q.row WHERE q.vec_id % 50 = 0
    )
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
        SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id, row) AS rank
        FROM scored
    ) WHERE rank <= 5"""

# A window is told by the words themselves, joined by blanks, which no word holds.
SUBSTRINGS = """
    WITH texts AS (
        SELECT row_number() OVER () AS row, doc_id,
               regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
        FROM documents
    ),
    starts AS (SELECT row, words, unnest(range(1, len(words) - 33)) AS p FROM texts),
    windows AS (SELECT row, p, array_to_string(words[p : p + 34], ' ') AS w FROM starts),
    repeated AS (
        SELECT row, p FROM (SELECT row, p, count(*) OVER (PARTITION BY w) AS n FROM windows) WHERE n > 1
    ),
    covered AS (SELECT DISTINCT row, unnest(range(p, p + 35)) AS i FROM repeated),
    places AS (SELECT row, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM texts),
    kept AS (
        SELECT places.row, string_agg(word, ' ' ORDER BY places.i) AS text
        FROM places LEFT JOIN covered ON covered.row = places.row AND covered.i = places.i
        WHERE covered.i IS NULL GROUP BY places.row
    ),
    gone AS (SELECT row, count(*) AS n FROM covered GROUP BY row)
    SELECT doc_id, len(words) AS n_words, coalesce(n, 0) AS n_removed,
           sha256(coalesce(kept.text, '')) AS kept_sha256
    FROM texts LEFT JOIN gone ON gone.row = texts.row LEFT JOIN kept ON kept.row = texts.row"""


def _tree(name: str, start: str) -> str:
    """CTEs of a tree: ``{name}0`` (tree, idx, digest) is ``start``; each level has the
    runs of the one before as lists; ``{name}_last`` has each tree's last node."""
    parts = [f"{name}0 AS ({start})"]
    for level in range(LEVELS):
        parts.append(
            f"{name}runs{level} AS (SELECT tree, idx // 16 AS idx, list(digest ORDER BY idx) AS run FROM"
            f" (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {name}{level}) WHERE n > 1 GROUP BY 1, 2)"
        )
        parts.append(
            f"{name}{level + 1} AS (SELECT tree, idx, sha256(array_to_string(run, '')) AS digest FROM {name}runs{level})"
        )
    lasts = " UNION ALL ".join(
        f"SELECT tree, any_value(digest) AS digest FROM {name}{level} GROUP BY tree HAVING count(*) = 1"
        for level in range(LEVELS + 1)
    )
    parts.append(f"{name}_last AS ({lasts})")
    return ",\n".join(parts)


def _fold(name: str, start: str, tree: str) -> str:
    """CTEs that carry rows (row, tree, idx, acc, proof) up a tree, level by level."""
    parts = [f"{name}0 AS ({start})"]
    for level in range(LEVELS):
        left = "array_to_string(run[1 : f.idx % 16], '')"
        right = "array_to_string(run[f.idx % 16 + 2 :], '')"
        parts.append(
            f"{name}{level + 1} AS (SELECT f.row, f.tree, f.idx // 16 AS idx,"
            f" CASE WHEN run IS NULL THEN acc ELSE sha256({left} || acc || {right}) END AS acc,"
            f" CASE WHEN run IS NULL THEN proof ELSE proof || {left} || {right} END AS proof"
            f" FROM {name}{level} f LEFT JOIN {tree}runs{level} r ON r.tree = f.tree AND r.idx = f.idx // 16)"
        )
    return ",\n".join(parts)


def _manifest() -> str:
    def record(text: str) -> str:
        return "sha256(" + " || ".join(
            f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
            for c in ("doc_id", "source", "lang", "n_chars", text)
        ) + ")"

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = _crc32("CAST(doc_id AS VARCHAR)")
    return f"""
    WITH leaves AS (
        SELECT row_number() OVER () AS row, doc_id, source, {record("text")} AS leaf,
               CASE WHEN {crc} % 5 = 0 THEN {record(lowered)} ELSE {record("text")} END AS shown
        FROM documents
    ),
    placed AS (
        SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
               row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx
        FROM leaves
    ),
    {_tree("a", "SELECT tree, idx, leaf AS digest FROM placed")},
    {_tree("b", "SELECT 0 AS tree, tree AS idx, digest FROM a_last")},
    {_fold("f", "SELECT row, tree, idx, shown AS acc, '' AS proof FROM placed", "a")},
    {_fold("g", f"SELECT row, 0 AS tree, tree AS idx, acc, proof FROM f{LEVELS}", "b")}
    SELECT doc_id, leaf, a_last.digest AS subroot, b_last.digest AS root,
           sha256(proof) AS proof_sha256, acc AS folded_root, acc = b_last.digest AS verified
    FROM placed JOIN g{LEVELS} g ON g.row = placed.row
    JOIN a_last ON a_last.tree = placed.tree CROSS JOIN b_last"""


def _spelling() -> str:
    lower = "translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # the checksum is over bytes; only distinct pairs of document and run are hashed
    octets = "list_transform(range(1, octet_length(b) + 1), lambda i: CAST('0x' || substr(hex(b), 2 * i - 1, 2) AS BIGINT))"
    bit = "list_reduce(list_concat([xor(c, o)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {octets}), lambda c, o: {bit}), 4294967295)"
    return f"""
    WITH RECURSIVE runs AS (
        SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
               unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run
        FROM documents WHERE text IS NOT NULL
    ),
    counted AS (
        SELECT id, {lower} AS run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY 1, 2
    ),
    hashed AS (SELECT run, n, {crc} AS h FROM (SELECT *, encode(id || ':' || run) AS b FROM counted)),
    thinned AS (
        SELECT CASE WHEN h % 31 = 0
                    THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2)
                    ELSE run END AS word, n
        FROM hashed
    ),
    words AS (
        SELECT word, CAST(sum(n) AS BIGINT) AS n FROM thinned
        WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
    ),
    cuts AS (
        SELECT DISTINCT word, n, length(word) AS size, i,
               substr(word, 1, i - 1) || substr(word, i + 1) AS cut
        FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)
    ),
    pairs AS (
        SELECT a.word, b.word AS other, b.n AS other_n
        FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.size = b.size AND a.i = b.i AND a.word <> b.word
        UNION
        SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.cut = b.word
        UNION
        SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.cut = b.word
    ),
    best AS (
        SELECT word, count(*) AS n_near,
               first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n
        FROM pairs GROUP BY word
    ),
    forms AS (
        SELECT words.word, words.n, coalesce(n_near, 0) AS n_near,
               CASE WHEN other_n >= 10 * words.n THEN other END AS form,
               CASE WHEN other_n >= 10 * words.n THEN other_n END AS form_n
        FROM words LEFT JOIN best ON best.word = words.word
    ),
    chains AS (
        SELECT word, word AS root, form AS next FROM forms
        UNION ALL
        SELECT chains.word, forms.word, forms.form FROM chains JOIN forms ON forms.word = chains.next
    )
    SELECT forms.word, form, chains.root, n, n_near, form_n
    FROM forms JOIN chains ON chains.word = forms.word AND chains.next IS NULL"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_threshold_top_k": TOP_K,
        "op8_substring_dedup": SUBSTRINGS,
        "op11_merkle_manifest": _manifest(),
        "op12_spelling_variants": _spelling(),
    }
