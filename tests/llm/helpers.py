"""Small tables with the awkward cases that every operator has to handle."""

DOC = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = DOC + ", size long, shard int, row string, words string, id long, `part` int"


def documents(spark, rows, clash=False):
    """rows: (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1])) for r in rows]
    if clash:
        return spark.createDataFrame([x + (7, 7, "x", "x", 7, 7) for x in full], CLASH)
    return spark.createDataFrame(full, DOC)


AWKWARD = [(1, None), (2, ""), (3, "  \n\t "), (None, None), (None, "a b c d e f"), (4, "dup dup dup"), (4, "dup dup dup"), (5, "word " * 30_000), (6, "é ñ \U0001f600 x\x00y"), (7, "x" * 50_000)]
