"""Small tables with every awkward case, and plain versions of the operators."""

import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id long, size long, lang_pred string, toxicity double, main_text string, _order string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(spark, texts, langs=None, sources=None):
    """documents with extra columns whose names the operators use themselves."""
    data = [(i, t, (langs or ["en"])[i % len(langs or [1])], (sources or ["a"])[i % len(sources or [1])], len(t or ""), -1, -1, "x", 0.5, "m", "o") for i, t in enumerate(texts)]
    return spark.createDataFrame(data, DOCS)


def odd(spark):
    base = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the dark wood of the north"
    texts = [None, "", "   \n\t ", "word", base, base, base + " again", "x" * 30_000, "a b " * 8_000, "é" * 50, "1 2 3", "<|im_end|>", "A@B.co", "\U0001f600 a b"]
    docs = rows(spark, texts)
    more = spark.createDataFrame([(None, base, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None), (4, base, "en", "a", 1, 1, 1, "x", 0.5, "m", "o")], DOCS)
    return docs.unionByName(more)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def very_long(spark):
    """A text of several MB, one unbroken run of characters, and a short text beside them."""
    prose = "The quick brown fox jumps over the lazy dog and runs away from the wolf, as it is in the wood. "
    return rows(spark, [prose * 32_000, "z" * 1_500_000, prose])
