"""Fill-in-middle by an event scan.

One Aho-Corasick automaton finds the ASCII characters at which a unit can end and the sentinels; all other text is a gap. The number
of units up to an event follows from the events before it by arithmetic, so a text is scanned once, only its events are kept, and a
cut after any number of units is a lookup by rank. Rows stay where they are: there is no shuffle.
"""

from __future__ import annotations

import functools
from array import array
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

SENTINELS = ("<P>", "<S>", "<M>")
RATE, SPM_RATE = 100, 50
SEED = 7
#: Where a unit can end. A word keeps the white space after it; characters end everywhere and need no events.
ENDS = {"line": "\n", "word": " \t\n\x0b\x0c\r", "char": ""}
ROWS = "doc_id string, n long, form string, prefix_chars long, middle_chars long, output string"


class Units:
    """The units of one text: their number, the place of each cut, and whether a sentinel occurs."""

    def __init__(self, text: str, unit: str):
        self.size, self.unit, self.marked = len(text), unit, False
        self.ends = array("q")
        runs = unit == "word"
        for at, sentinel in _automaton(unit).iter(text):
            if sentinel:
                self.marked = True
            elif runs and self.ends and self.ends[-1] == at:
                self.ends[-1] = at + 1  # white space that goes on
            else:
                self.ends.append(at + 1)
        if unit == "char":
            self.n = self.size
        else:
            self.n = len(self.ends) + (self.size > (self.ends[-1] if self.ends else 0))

    def cut(self, units: int) -> int:
        """The place after so many units."""
        if units >= self.n:
            return self.size
        return units if self.unit == "char" or not units else self.ends[units - 1]


@functools.cache
def _automaton(unit: str) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for c in ENDS[unit]:
        found.add_word(c, 0)
    for k, s in enumerate(SENTINELS):
        found.add_word(s, k + 1)
    found.make_automaton()
    return found


def rearrange(text: str, unit: str, h: tuple[int, int, int, int], rate: int, spm_rate: int) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of a text by four numbers."""
    units = Units(text, unit)
    if not text or units.marked or h[2] % 100 >= rate:
        return units.n, "plain", None, None, text
    a, b = sorted((units.cut(h[0] % (units.n + 1)), units.cut(h[1] % (units.n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = SENTINELS
    if h[3] % 100 < spm_rate:
        return units.n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return units.n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def rebuilt(output: str, form: str) -> str:
    """The text that rearrange() was given. The parts hold no sentinel, so the three that are found are its own."""
    if form == "plain":
        return output
    at = {k: end for end, k in _automaton("char").iter(output)}
    p, s, m = at[1] + 1, at[2] + 1, at[3] + 1
    if form == "spm":
        suffix, prefix = output[s : p - 3], output[p : m - 3]
    else:
        prefix, suffix = output[p : s - 3], output[s : m - 3]
    return prefix + output[m:] + suffix


def draws(id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the id: the first groups of the SHA-256 of `seed:id`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, *, id: str = "doc_id", text: str = "text", unit: str = "line", rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED, keep: bool = False) -> DataFrame:
    """Per row: doc_id, n (units), form, prefix_chars, middle_chars (code points, null if plain) and output, the rearranged text; with
    keep=True also `row`, a struct of all columns of docs.

    `unit` is line, word (with the white space after it; white space that leads a text is a unit of its own) or char. Of 100 texts
    about `rate` are rearranged, of 100 of these about `spm_rate` with the suffix first. The cuts follow from `seed` and id alone, so
    reruns agree and rows with one id are cut alike. A null text is an empty one; empty texts and texts that hold a sentinel stay
    plain. A row without an id is drawn from an empty id. An empty table gives an empty one, other columns do not matter.
    """
    if unit not in ENDS:
        raise ValueError(f"unit {unit!r} is not one of {', '.join(ENDS)}")
    kind = docs.schema[id].dataType.simpleString()
    given = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"), *[h.alias(f"h{k}") for k, h in enumerate(draws(F.col(id), seed))], *([F.struct(*docs.columns).alias("row")] if keep else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True)
            rows = [rearrange(t.as_py() or "", unit, x, rate, spm_rate) for t, x in zip(batch.column(1), h, strict=True)]
            n, form, prefix, middle, output = zip(*rows, strict=True) if rows else ((),) * 5
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *batch.columns[6:]], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", *(["row"] if keep else [])])

    schema = ROWS.replace("doc_id string", f"doc_id {kind}", 1)
    return given.mapInArrow(run, schema + (f", row {given.schema['row'].dataType.simpleString()}" if keep else ""))


def restore(rows: DataFrame, *, output: str = "output", form: str = "form", as_: str = "restored") -> DataFrame:
    """rows with one more column, the text that transform() was given, from output and form alone. A null output or form gives null."""
    as_ = free_name(as_, rows.columns)
    given = rows.select(F.col(output).alias("o"), F.col(form).alias("f"), F.struct(*rows.columns).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = ((o.as_py(), f.as_py()) for o, f in zip(batch.column(0), batch.column(1), strict=True))
            texts = pa.array([None if o is None or f is None else rebuilt(o, f) for o, f in pairs], pa.string())
            yield pa.RecordBatch.from_arrays([texts, batch.column(2)], ["text", "row"])

    out = given.mapInArrow(run, f"text string, row {given.schema['row'].dataType.simpleString()}")
    return out.select("row.*", F.col("text").alias(as_))
