"""Small tables for the tests."""

from __future__ import annotations

from datetime import date

from callsheet.schemas import TABLES
from callsheet.sources import literal_rows

# The seed rows behind the expected report results, ids only.
PARTITIONS = [
    (4, "part 4", date(1999, 5, 16), 115000000, 1027000000, 9132, None),
    (5, "part 5", date(2002, 5, 16), 115000000, 653000000, 7981, None),
    (6, "part 6", date(2005, 5, 19), 113000000, 868400000, 7293, None),
]
SCORES = [10000, 20500, 27700, 13400, 13500, 12000, 4700, 17700, 12000, 11900]
FLAG_A = [False, True, False, True, True, True, True, True, True, True]
FLAG_B = [True, False, True, True, False, False, None, True, True, None]
LOCATION_IDS = [0, 1, 2, 3, 4, 5, 1, None, 6, 7]
RELATIONS = [
    (0, 2), (0, 3), (3, 2), (1, 2), (1, 4), (1, 5), (4, 0), (7, 3), (7, 4), (7, 8), (4, 8),
]
CONTESTS = [
    (0, 0, 4, 0, 5, None), (1, 1, 4, 5, 0, True), (2, 1, 4, 3, 5, True), (3, 2, 5, 4, 3, True),
    (4, 2, 5, 4, 2, True), (5, 2, 5, 4, 7, None), (6, 3, 6, 2, 4, True), (7, 3, 6, 4, 3, True),
    (8, 4, 6, 3, 8, None), (9, 5, 6, 1, 8, True), (10, 5, 6, 2, 8, True), (11, 6, 6, 7, 1, None),
    (12, 7, 6, 3, 2, True),
]
WORDS = {
    4: {0: 1085, 2: 616, 6: 523, 3: 427, 1: 344, 7: 194, 8: 163, 5: 33},
    5: {2: 1365, 3: 1050, 6: 806, 4: 417, 7: 378, 8: 280, 1: 250},
    6: {2: 1680, 1: 1303, 3: 1186, 6: 548, 7: 436, 8: 365, 9: 98, 4: 48},
}


def table(spark, name, rows):
    return literal_rows(spark, rows, TABLES[name].schema)


def seed_tables(spark):
    """The seed dimensions, and one invented line per speaker and part."""
    entities = [
        (i, f"entity {i}", SCORES[i], None, FLAG_A[i], LOCATION_IDS[i], FLAG_B[i])
        for i in range(10)
    ]
    locations = [(i, f"location {i}", 1, 1, None) for i in range(8)]
    lines = [(p, e, n) for p, spoken in WORDS.items() for e, n in spoken.items()]
    turns = [
        (i, part, entity, (entity + 1) % 10, " ".join(["word"] * words), None)
        for i, (part, entity, words) in enumerate(lines)
    ]
    return {
        "partition": table(spark, "partition", PARTITIONS),
        "location": table(spark, "location", locations),
        "entity": table(spark, "entity", entities),
        "turn": table(spark, "turn", turns),
        "relation": table(spark, "relation", RELATIONS),
        "contest": table(spark, "contest", CONTESTS),
    }


def rows(df):
    """The rows as sorted tuples."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(v is None, v) for v in r])
