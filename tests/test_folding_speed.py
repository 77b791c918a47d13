"""Folding takes time by the length of the text, not by length times the ranges of characters that need Python."""

import sys
import time

import pandas as pd
from pyspark.sql import functions as F

from chronofacts.functions import text as X


def test_long_texts_fold_at_once(spark):
    """4 MB in one task: each character was tried against hundreds of ranges before."""
    texts = spark.range(40, numPartitions=1).select(F.repeat(F.concat(F.lit("Größe and plain words "), F.col("id").cast("string")), 4000).alias("t"))
    folded = X.with_folded(texts, "t", "f").agg(F.sum(F.length("f")).alias("n"))
    began = time.perf_counter()
    assert folded.first().n == sum(len(x) for x in X._fold(pd.Series([f"Größe and plain words {k}" * 4000 for k in range(40)])))
    assert time.perf_counter() - began < 10


def test_every_white_space_and_the_characters_around_blocks(spark):
    """All white space of Python's ``split``, alone and in runs, in plain and other texts; and every 11th character from 128 on."""
    blanks = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()]
    texts = [f"{b}A{b}{other}É{b}" for b in blanks for other in ("", " ", *blanks)] + [f"{b}A{b}{other}B{b} c" for b in blanks for other in ("", " ", *blanks)]
    texts += [f"E {chr(c)}" for c in range(128, sys.maxunicode, 11) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r.k: r.f for r in X.with_folded(df, "t", "f").collect()}
    wrong = [(t, got[k]) for k, (t, f) in enumerate(zip(texts, X._fold(pd.Series(texts)), strict=True)) if got[k] != f]
    assert len(got) == len(texts) and not wrong, wrong[:5]
