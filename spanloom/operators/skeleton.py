"""Skeletons: what the rules read of a text that wears a disguise, with the way back to the text's own characters.

Characters that are never shown go, composed letters take the place of letters followed by their marks (NFC), and full-width
forms and the decimal digits of all scripts become ASCII. Blanks and all other characters stay. Rules run on the
skeleton; a span's places are mapped back, so its value is the slice of the text that stands there, with all that was hidden in it.

Only disguised texts pass through Python, in Arrow batches; for all others the function is given nulls and the JVM does all. A
disguised text costs two whole numbers a character of its skeleton, in its own row. A null text has no skeleton.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import blocks, cut
from .detect import with_spans
from .rules import Rule

#: The code points of the Unicode property Default_Ignorable_Code_Point, as ranges.
IGNORABLE = [
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F),
    (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
]
#: The full-width forms of the printable ASCII characters, and how far they lie above them.
WIDE, ABOVE = (0xFF01, 0xFF5E), 0xFEE0
#: Characters of texts whose skeletons are held at once, beside a single longer text.
SLICE = 1 << 20
SKELETON = T.StructType([T.StructField("text", T.StringType()), T.StructField("start", T.ArrayType(T.IntegerType())), T.StructField("end", T.ArrayType(T.IntegerType()))])

_RANGES = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in IGNORABLE)
#: As the JVM reads it: whether a text can have a skeleton of its own.
DISGUISE = rf"[{_RANGES}\x{{{WIDE[0]:X}}}-\x{{{WIDE[1]:X}}}\p{{M}}]|[\p{{Nd}}&&[^0-9]]"

_HIDDEN = "".join(f"{chr(a)}-{chr(b)}" for a, b in IGNORABLE)
#: What changes: a character with its marks, hidden characters among them or not; hidden characters; one that is written in another form.
_CLUSTER = regex.compile(rf"(?V1)[^{_HIDDEN}](?:[{_HIDDEN}]*[\p{{M}}--[{_HIDDEN}]])+|[\p{{M}}--[{_HIDDEN}]]|[{_HIDDEN}]+|[{chr(WIDE[0])}-{chr(WIDE[1])}]|[\p{{Nd}}--[0-9]]", regex.S)
_HIDE = regex.compile(f"[{_HIDDEN}]+")


def disguised(text: Column) -> Column:
    """Whether a text may have a skeleton; a null text has none."""
    return F.coalesce(text.rlike(DISGUISE), F.lit(False))


def _plain(cluster: str) -> str:
    """A cluster as the skeleton has it."""
    shown = _HIDE.sub("", cluster)
    if not shown:
        return ""
    code = ord(shown[0])
    if WIDE[0] <= code <= WIDE[1]:
        shown = chr(code - ABOVE) + shown[1:]
    elif code > 0x7F and unicodedata.category(shown[0]) == "Nd":
        shown = str(unicodedata.decimal(shown[0])) + shown[1:]
    return unicodedata.normalize("NFC", shown)


def skeleton(text: str | None) -> tuple[str, np.ndarray, np.ndarray] | None:
    """The skeleton and, for each of its characters, where the cluster that it stands for begins and ends in the text; None where it is the text itself."""
    if text is None:
        return None
    out, starts, ends, at = [], [], [], 0
    for m in _CLUSTER.finditer(text):
        new = _plain(m[0])
        out += [text[at : m.start()], new]
        starts += [np.arange(at, m.start(), dtype=np.int32), np.full(len(new), m.start(), np.int32)]
        ends += [np.arange(at + 1, m.start() + 1, dtype=np.int32), np.full(len(new), m.end(), np.int32)]
        at = m.end()
    out.append(text[at:])
    if "".join(out) == text:
        return None
    starts.append(np.arange(at, len(text), dtype=np.int32))
    ends.append(np.arange(at + 1, len(text) + 1, dtype=np.int32))
    return "".join(out), np.concatenate(starts), np.concatenate(ends)


def _slices(batch: pd.Series) -> Iterator[pd.Series]:
    """A batch's texts in order, as many at once as have SLICE characters together, one at least: its skeletons' places are many times its own size."""
    begin, held = 0, 0
    for i, x in enumerate(batch):
        n = len(x) if x is not None else 0
        if i > begin and held + n > SLICE:
            yield batch.iloc[begin:i]
            begin, held = i, 0
        held += n
    yield batch.iloc[begin:]


@F.pandas_udf(SKELETON)
def _skeletons(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        for part in _slices(batch):
            yield pd.DataFrame([skeleton(x) or (None, None, None) for x in part], columns=["text", "start", "end"])


def with_skeleton(docs: DataFrame, text: str = "text", into: str = "skeleton") -> DataFrame:
    """docs and struct<text, start, end>: what a disguised text reads as, and each of its characters' place; fields are null for all other texts."""
    body = F.col(f"`{text}`")
    return docs.withColumn(into, _skeletons(F.when(disguised(body), body)))


def with_mapped_spans(docs: DataFrame, rules: Sequence[Rule], text: str = "text", into: str = "spans") -> DataFrame:
    """As detect.with_spans, but rules read skeletons; places and values are those of the text itself."""
    seen = with_skeleton(docs, text, "_skeleton").withColumn("_read", F.coalesce("_skeleton.text", F.col(f"`{text}`"))).withColumn("_blocks", blocks(F.when(F.col("_skeleton.text").isNotNull(), F.col(f"`{text}`"))))
    found = with_spans(seen, rules, "_read", into)
    start, end = (lambda s: F.get(F.col("_skeleton.start"), s["start"])), (lambda s: F.get(F.col("_skeleton.end"), s["end"] - 1))

    def back(s: Column) -> Column:
        return F.struct(start(s).alias("start"), end(s).alias("end"), cut(F.col("_blocks"), start(s), end(s)).alias("value"), s["type"].alias("type"), s["category"].alias("category"), s["rank"].alias("rank"))

    mapped = F.when(F.col("_skeleton.text").isNull(), F.col(into)).otherwise(F.transform(into, back))
    return found.withColumn(into, mapped).drop("_skeleton", "_read", "_blocks")
