"""Tables with everything that operators must bear: nulls, empty and long texts, ties, repeated rows, clashing columns."""

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
ROWS = [
    (1, "a quick brown fox jumps over the lazy dog by the river bank today"), (1, "a quick brown fox jumps over the lazy dog by the river bank today"), (2, None), (3, ""), (4, "   \n\t "), (5, "!!! ???"), (None, "a text whose id is missing but which has words"),
    (None, None), (6, LONG), (7, "x"), (8, "Ünïcode tëxt with 日本語 and emoji 🙂 inside"), (9, "a quick brown fox jumps over the lazy dog by the river bank today"), (10, "mail me at jo.doe@mail.example.com or call +1 (212) 555-0199"),
]
CLASH = "k1 string, k2 string, dk string, id string, key string, label string, cell string, h string, d string, bucket string, length int, rank int, words int, entities int, drops int, _acts int"


def documents(spark, rows=ROWS):
    """(doc_id, text) and a crowd of columns with the names that operators use inside."""
    n = CLASH.count(",") + 1
    return spark.createDataFrame([(*r, *[None] * n) for r in rows], f"doc_id bigint, text string, {CLASH}")


def empty(spark):
    return spark.createDataFrame([], f"doc_id bigint, text string, {CLASH}")
