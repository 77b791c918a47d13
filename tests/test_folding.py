"""Folding of whole tables against Python's own, and plans without Python where none is needed."""

import random
import sys
import unicodedata

from pyspark.sql import functions as F

from chronofacts.functions import text as X


def plain(x):
    return None if x is None else " ".join(unicodedata.normalize("NFKC", x).split()).casefold()


def test_folding_equals_python(spark):
    rnd = random.Random(3)
    alphabets = ["aB \t", "éÉßẞÀ ", "Ａ１　ｱ", "éñ", "ﬁ①½㎏", "Ωµſ", "한한", "  \x1c\x85", "ǅİıς", "😀𝒜𐐀"]
    texts = ["".join(rnd.choice(rnd.choice(alphabets)) for _ in range(rnd.randrange(12))) for _ in range(1500)] + [None, "", " ", "Straße"]
    texts += [chr(c) + "x" for c in range(1, sys.maxunicode, 37) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r.k: r.f for r in X.with_folded(df, "t", "f").collect()}
    assert len(got) == len(texts)
    wrong = [(t, plain(t), got[k]) for k, t in enumerate(texts) if got[k] != plain(t)]
    assert not wrong, wrong[:5]


def test_no_python_where_characters_fold_on_their_own(spark):
    df = spark.createDataFrame([("Plain ASCII",), ("Größe ÉTÉ",), (None,)], "t string").withColumn("u", F.col("t"))
    folded = X.with_folded(df, "t", "f")
    plan = folded._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert [r.f for r in folded.collect()] == ["plain ascii", "grösse été", None]
    assert X.with_folded(df.limit(0), "t", "f").count() == 0
