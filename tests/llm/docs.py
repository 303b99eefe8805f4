"""Documents with every awkward case: null, empty, long, tied, repeated, odd characters."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

LONG = "lorem ipsum dolor " * 40_000

TEXTS = [
    (0, "The cat sat.\nShared line\n  SHARED LINE\t\nanother one"),
    (1, None),
    (2, ""),
    (3, "   \n\n\t"),
    (5, "Shared line\nÉtude Straße ΣΑΣ 漢字かな交じり文 🙂🙂 é"),
    (5, "Shared line\nÉtude Straße ΣΑΣ 漢字かな交じり文 🙂🙂 é"),
    (5, "same id, other text\nshared line"),
    (None, "no id here\nShared line"),
    (None, None),
    (8, LONG),
    (9, "x"),
    (10, "don't we'll I'M they've 12345 67  89\r\n\x0b\x0c  odd \u001c blanks"),
    (11, "a" * 3000),
    (12, "\x00 zero <|endoftext|>x<|startoftext|> 100% $$$!!"),
]


def awkward(spark, extra=False):
    df = spark.createDataFrame([(i, t, "en" if t else None, "s", len(t) if t else None) for i, t in TEXTS], SCHEMA)
    if extra:
        for name in ("n_lines", "n_dropped", "count", "h", "start", "length", "hash", "label", "fingerprint", "score", "_t", "key", "pos", "word", "shard", "a", "b"):
            df = df.selectExpr("*", f"'clash' AS {name}")
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
