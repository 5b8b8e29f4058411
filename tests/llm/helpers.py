import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")

#: Texts that every operator must take: null, empty, blank, one word, ties, repeats, beyond ASCII, long.
ODD = [
    None, "", "   \n\t ", "one", "One", "a b", "same text here and there", "same text here and there", "SAME text here and there",
    "é ü ñ 日本語 \x0b x", "#*$ %&| <> !!\n#*$ %&| <> !!", "w " * 3000, "long " + "abcdefghi " * 20000, "a" * 500, "é" * 250, "\n\n\n", "tail\n",
]


def words(text):
    return WORD.findall((text or "").encode())


def lowered(text):
    return (text or "").encode().lower()


def odd_documents(spark, columns="doc_id long, text string, lang string, source string, n_chars long, score double, component_id string, kept string"):
    """ODD as documents, with further columns whose names clash with those of results, null ids and sources, and rows that
    are repeated in full."""
    rows = [(k * 3 - 5, t, "en", None if k % 4 == 0 else f"s{k % 3}", len(t or ""), 0.5, "x", None) for k, t in enumerate(ODD)]
    rows += [rows[5], rows[6], (None, "no id but some words in it", "en", "s1", 1, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, columns)


def documents(spark, texts, source=None):
    rows = [(k, t, "en", (source or (lambda k: "s"))(k), len(t or "")) for k, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def empty(spark):
    return documents(spark, [(1, "x")]).limit(0)
