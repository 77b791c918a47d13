"""Text, list and record clean-up, as columns."""

from __future__ import annotations

import math
import sys
import unicodedata
from functools import cache
from string import ascii_uppercase as _UPPER

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .timeparse import DAY, let, strip


def clean_token(c: Column) -> Column:
    return F.translate(c, "_", " ")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def slot_text(c: Column) -> Column:
    """A triple's slot for matching: no brackets, lower case, trimmed."""
    return strip(F.lower(F.regexp_replace(c, r"[\[\]{}]", "")))


def _fold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).split()).casefold())


def folded_text(c: Column) -> Column:
    """NFKC, single spaces, case-folded. Spark has neither form, so texts beyond ASCII pass a Pandas UDF; of plain ASCII it gets a null and the JVM does the work."""
    plain = c.rlike(r"^[\x00-\x7F]*$")
    return F.when(plain, F.lower(collapse(c))).otherwise(pandas_udf(_fold, "string")(F.when(~plain, c)))


@cache
def _fold_tables() -> tuple[str, str, str]:
    """From the interpreter's Unicode tables: characters that fold to one other character, what they fold to, and a class of those that do not fold on their own.

    The last are characters that fold to several (but sharp s, which is common and replaced by itself) and whatever can combine with its neighbours.
    """
    one, other, several = [], [], []
    for code in range(128, sys.maxunicode + 1):
        c = chr(code)
        if 0xD800 <= code < 0xE000:
            continue
        f = unicodedata.normalize("NFKC", c).casefold()
        if len(f) != 1 and c not in "ßẞ" or unicodedata.combining(c) or unicodedata.category(c)[0] == "M" or 0x1160 <= code < 0x1200:
            several.append(code)
        elif f != c and len(f) == 1:
            one.append(c)
            other.append(f)
    ranges = []
    for code in several:
        if ranges and code == ranges[-1][1] + 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    # A class is a chain of ranges that Java tries one by one for every character. Blocks of ranges are entered by their span only, and plain ASCII enters none.
    ranged = lambda a, b: f"\\x{{{a:x}}}-\\x{{{b:x}}}"
    step = math.isqrt(len(ranges))
    blocks = [ranges[k : k + step] for k in range(0, len(ranges), step)]
    inside = "".join(f"[{ranged(b[0][0], b[-1][1])}&&[{''.join(ranged(*r) for r in b)}]]" for b in blocks)
    return "".join(one), "".join(other), f"[{ranged(128, sys.maxunicode)}&&[{inside}]]"


#: White space of Python's ``split`` in ASCII, and beyond it what NFKC leaves as it is.
_BLANKS, _WIDE_BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f", "\x85\u1680\u2028\u2029"


def with_folded(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with ``folded_text`` of a column, for tables: the JVM folds whatever folds character by character, and only rows with others reach Python.

    Those rows are looked for first (a pass over the column that ends at the first one), so the plan of a table without them has no Python step.
    """
    one, other, several = _fold_tables()
    c = F.col(column)
    plain = F.octet_length(c) == F.length(c)
    hard = F.coalesce(~plain & c.rlike(several), F.lit(False))
    upper, blanks = _UPPER + _BLANKS + _WIDE_BLANKS, _UPPER.lower() + " " * len(_BLANKS + _WIDE_BLANKS)
    folded = F.replace(F.replace(F.translate(c, one + upper, other + blanks), F.lit("ß"), F.lit("ss")), F.lit("ẞ"), F.lit("ss"))
    # Single spaces, most of all white space, stay where they are.
    squeezed = F.regexp_replace(F.lower(c), r"[\t-\r\x1C-\x1F][\t-\r\x1C-\x1F ]*| [\t-\r\x1C-\x1F ]+", " ")
    easy = df.where(~hard).withColumn(name, F.trim(F.when(plain, squeezed).otherwise(F.regexp_replace(folded, "  +", " "))))
    rest = df.where(hard)
    if rest.isEmpty():
        return easy
    return easy.unionByName(rest.withColumn(name, pandas_udf(_fold, "string")(c)))


def hit_text(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def squeezed_text(c: Column) -> Column:
    """Lower case without any white space."""
    return F.regexp_replace(F.lower(c), r"(?U)\s", "")


def link_text(c: Column) -> Column:
    """Lower case, single spaces, trimmed: for finding names in questions."""
    return strip(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def mention_text(c: Column) -> Column:
    """``link_text`` with long dashes as hyphens."""
    return link_text(F.translate(c, "–—", "--"))


def as_list(c: Column) -> Column:
    """A one-item list of a text; null is empty."""
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.array(c))


def to_number(c: Column) -> Column:
    return c.try_cast("double")


def label(c: Column) -> Column:
    return F.coalesce(F.nullif(strip(c), F.lit("")), F.lit("unknown"))


def parse_event(c: Column) -> Column:
    """``head|relation|tail|start|end`` as a struct of trimmed parts; null unless there are five."""
    parts = F.transform(F.split(c, r"\|"), strip)
    names = ("head", "relation", "tail", "start", "end")
    return let(parts, lambda p: F.when(F.size(p) == 5, F.struct(*(F.get(p, F.lit(k)).alias(n) for k, n in enumerate(names)))))


def event_string(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)


def event_phrase(head: Column, relation: Column, tail: Column) -> Column:
    return F.concat_ws(" ", head, relation, tail)


def canonical_answer(c: Column) -> Column:
    """``A - B``, ``A-B`` and ``A TO B`` of days become ``A to B``; years too; other texts are trimmed."""
    text = strip(c)
    for side in (DAY, r"\d{4}"):
        text = F.regexp_replace(text, rf"(?i)^({side})\s*(?:-|–|—|\bto\b)\s*({side})$", "$1 to $2")
    return text


def answer_values(c: Column) -> Column:
    """A ``;`` text as canonical items without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), canonical_answer), lambda x: x != "")


def answer_item(c: Column) -> Column:
    """Trimmed; ``equals`` becomes ``equal``."""
    return F.when(strip(c) == "equals", "equal").otherwise(strip(c))


def stable_json(*fields: str) -> Column:
    """Compact JSON of the fields in name order, nulls kept; escapes of control characters in lower case."""
    text = F.to_json(F.struct(*(F.col(f) for f in sorted(fields))), {"ignoreNullFields": "false"})
    return F.aggregate(F.sequence(F.lit(0), F.lit(31)), text, lambda t, k: F.replace(t, F.concat(F.lit("\\u"), F.lpad(F.hex(k.cast("long")), 4, "0")), F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(k.cast("long")), 4, "0")))))


def record_hash(*fields: str) -> Column:
    return F.sha2(stable_json(*fields), 256)


def text_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def short_id(c: Column, prefix: str) -> Column:
    """Prefix and 16 characters of the URL-safe base64 of the SHA-1."""
    return F.concat(F.lit(prefix), F.substring(F.translate(F.base64(F.unhex(F.sha1(c))), "+/", "-_"), 1, 16))


#: Ordinal words. Fixed values.
ORDINALS = ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth")


def ordinal(c: Column) -> Column:
    """``second``, ``2nd`` or ``2`` as a number; else null."""
    table = F.create_map(*(F.lit(x) for k, w in enumerate(ORDINALS, 1) for x in (w, k)))
    text = strip(F.lower(c))
    return F.coalesce(F.try_element_at(table, text), F.nullif(F.regexp_extract(text, r"^(\d+)(?:st|nd|rd|th)?$", 1), F.lit("")).try_cast("int"))


def offset_in(question: Column) -> Column:
    """``N days before|after`` in a question as struct(days, relation); null if there is none."""
    p = r"(?i)(\d+)\s+days\s+(before|after)"
    return F.when(question.rlike(p), F.struct(F.regexp_extract(question, p, 1).try_cast("int").alias("days"), F.lower(F.regexp_extract(question, p, 2)).alias("relation")))


def clauses(question: Column) -> Column:
    """The two sides of the first comma; without one, the whole question twice."""
    parts = F.transform(F.split(question, ",", 2), strip)
    return F.when(F.size(parts) == 2, parts).otherwise(F.array(question, question))


#: Words that begin a temporal clause. Fixed value: the spans of the data were cut by it.
_MARKER = r"\b(?:\d+\s+days\s+(?:before|after)|before|after|during|while|at the same time that|between)\b"


def anchor_spans(question: Column) -> Column:
    """Stretches from one temporal marker to the next, each cut at a semicolon."""
    marked = F.split(F.regexp_replace(question, rf"(?iU)({_MARKER})", "\u0001$1"), "\u0001")
    return F.transform(F.filter(F.slice(marked, F.lit(2), F.greatest(F.size(marked), F.lit(1))), lambda s: s != ""), lambda s: strip(F.split_part(s, F.lit(";"), F.lit(1))))


#: What the answers of a repaired question look like, as patterns. Fixed values.
ANSWER_FORMS = {
    "is_year": r"^\d{3,4}$", "is_date": r"^\d{3,4}-\d{2}-\d{2}$", "is_interval": r"^\d{3,4}-\d{2}-\d{2} to \d{3,4}-\d{2}-\d{2}$",
    "is_duration": r"^\d+ days$", "is_integer": r"^\d+$", "is_comparison": r"(?i)^(longer|shorter|equal)$",
}


def answer_form(c: Column, form: str) -> Column:
    """Whether the text, with single spaces and trimmed, has the form."""
    return collapse(c).rlike(ANSWER_FORMS[form])


def is_temporal(c: Column) -> Column:
    return answer_form(c, "is_year") | answer_form(c, "is_date") | answer_form(c, "is_interval") | answer_form(c, "is_duration")


def safe_ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def percent(part: Column, whole: Column) -> Column:
    return F.round(safe_ratio(part, whole) * 100, 3)


def reduction_percent(before: Column, after: Column) -> Column:
    return F.round(safe_ratio(before - after, before) * 100, 3)


def is_unknown(c: Column) -> Column:
    return c.isNull() | (strip(c) == "?")


def anchor_type(head: Column, relation: Column, tail: Column) -> Column:
    """Which slot is unknown; a later slot overrides an earlier one."""
    return F.when(is_unknown(tail), "tail").when(is_unknown(relation), "relation").when(is_unknown(head), "head")


def unknown_slot(head: Column, tail: Column) -> Column:
    return F.when(is_unknown(head), "head").when(is_unknown(tail), "tail")


def no_answer(c: Column, compat: bool = False) -> Column:
    """Null, empty, ``none``, ``n/a`` or ``no answer``. With ``compat``, the last is none of them, since only texts without spaces are compared."""
    return squeezed_text(F.coalesce(c, F.lit(""))).isin("", "none", "n/a", *([] if compat else ["noanswer"]))
