"""Tables that hold what real ones may: nulls, blanks, very long texts, ties, repeated rows, clashing names."""

LONG = " ".join(f"w{i}" for i in range(60_000))
PROSE = "one two three four five six seven eight nine ten " * 8
NAMES = "kept boolean, host string, n_words int, runs string, fingerprint string, bucket int, ahead boolean, x int, size int, n int"
EXTRA = (True, "h", 3, "r", "f", 1, True, 2, 3, 4)
DOCUMENTS = [
    (1, None), (2, ""), (3, " \n\t "), (None, PROSE), (None, PROSE), (None, "other"), (4, PROSE), (4, PROSE), (4, "unlike " + LONG[:900]),
    (5, PROSE + "x"), (6, LONG), (7, LONG + " end"), (8, "short"), (9, "\U0001f600 é　ü" * 40), (20, "a " * 3000), (-3, "ab\x1cc " * 50),
]


def documents(spark, rows=None):
    rows = DOCUMENTS if rows is None else rows
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], f"doc_id long, text string, {NAMES}")


def vectors(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], f"vec_id long, embedding array<float>, {NAMES}")
