"""Splitting long text into chunks: paragraph packing, recursive splitting, job entries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankwell.functions.core import let
from rankwell.functions.text import DATES, strip, strip_chars

PACK_CHARS, PACK_OVERLAP = 1200, 120
SIZE_RANGE = (500, 1000)
SEPARATORS = ("\n\n", "\n", ". ", " ")
GROUP = 1 << 20  # bytes of texts that a Python worker splits together


def pack_paragraphs(text: Column, limit: int = PACK_CHARS, overlap: int = PACK_OVERLAP) -> Column:
    """array<string> of pieces: paragraphs packed up to ``limit``, each next piece led by the last characters.

    A paragraph too long to start with is cut once at the limit; its rest continues with an overlap. An array fold copies
    its state at every step, so the paragraphs are folded in blocks, as many as each holds: n paragraphs cost
    n times the square root of n copies at most, instead of n times n.
    """
    none = F.array().cast("array<string>")

    def state(cur: Column, out: Column) -> Column:
        return F.struct(cur.alias("cur"), out.alias("out"))

    def add(s: Column, para: Column) -> Column:
        cur, out = s["cur"], s["out"]
        joined = F.when(cur != "", strip(F.concat(cur, F.lit("\n\n"), para))).otherwise(para)
        return (
            F.when(F.length(joined) <= limit, state(joined, out))
            .when(cur != "", state(strip(F.concat(F.right(cur, F.lit(overlap)), F.lit("\n\n"), para)), F.array_append(out, cur)))
            .otherwise(state(F.substr(para, F.lit(limit - overlap + 1)), F.array_append(out, F.substr(para, F.lit(1), F.lit(limit)))))
        )

    def fold(paragraphs: Column) -> Column:
        n = F.size(paragraphs)
        width = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(n - 1, F.lit(0)) / width).cast("int")), lambda k: F.slice(paragraphs, k * width + 1, width))
        return F.aggregate(
            blocks,
            F.struct(F.lit("").alias("cur"), F.array().cast("array<array<string>>").alias("done")),
            lambda s, block: let(
                F.aggregate(block, state(s["cur"], none), add),
                lambda b: F.struct(b["cur"].alias("cur"), F.array_append(s["done"], b["out"]).alias("done")),
            ),
            lambda s: F.flatten(F.array_append(s["done"], F.when(s["cur"] != "", F.array(s["cur"])).otherwise(none))),
        )

    def pack(body: Column) -> Column:
        paragraphs = F.filter(F.transform(F.split(body, "\n\n"), strip), lambda p: p != "")
        return F.when(body == "", none).when(F.length(body) <= limit, F.array(body)).otherwise(let(paragraphs, fold))

    return let(strip(text), pack)


def _windows(text: str, size: int, overlap: int) -> list[str]:
    starts = range(0, max(len(text) - overlap, 1), size - overlap)
    return [text[s : s + size] for s in starts]


def _pieces(text: str, size: int, overlap: int, separators: tuple[str, ...]) -> list[str]:
    if len(text) <= size:
        return [text]
    at = next((i for i, s in enumerate(separators) if s in text), None)
    if at is None:
        return _windows(text, size, overlap)
    sep, packed, run = separators[at], [], ""
    for part in filter(None, map(str.strip, text.split(sep))):
        if run and len(part) <= size and len(run) + len(sep) + len(part) <= size:
            run += sep + part
            continue
        if run:
            packed.append(run)
        run = part if len(part) <= size else ""
        if len(part) > size:
            packed += _pieces(part, size, overlap, separators[at + 1 :])
    if run:
        packed.append(run)
    return packed[:1] + [_led(prev[-overlap:], cur) for prev, cur in zip(packed, packed[1:])]


def _led(tail: str, piece: str) -> str:
    gap = "" if tail[-1:].isspace() or piece[:1].isspace() else " "
    return (tail + gap + piece).strip()


def slices(texts: pa.Array, limit: int) -> Iterator[pa.Array]:
    """A batch of texts in consecutive parts of about ``limit`` bytes; a longer text ends its part."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) // limit
    stops = [*(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]
    for start, stop in zip([0, *stops], stops):
        yield texts.slice(start, stop - start)


def recursive_split(size: int = 1000, overlap: int = 500, separators: tuple[str, ...] = SEPARATORS):
    """An Arrow-batched function of a text column to its overlapping pieces.

    The size lies in 500..1000 and the overlap in 50..60 % of it. Pieces fit the size before each is led by
    the end of its predecessor. A worker holds the pieces of few texts at a time, however many a batch has.
    """
    low, high = SIZE_RANGE
    if not low <= size <= high:
        raise ValueError(f"size must lie in [{low}, {high}], got {size}")
    if not size * 50 // 100 <= overlap <= size * 60 // 100:
        raise ValueError(f"overlap must be 50 to 60 percent of {size}, got {overlap}")

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for part in slices(texts, GROUP):
                trimmed = ((t or "").strip() for t in part.to_pylist())
                yield pa.array([_pieces(t, size, overlap, separators) if t else [] for t in trimmed], pa.list_(pa.string()))

    return split


_ENTRY = "struct<title:string,company:string,dates:string,location:string,details:array<string>>"


def _is_title(line: Column) -> Column:
    """Short, capitalised, no digits, no sentence end, no comma before a lower-case word."""

    def test(text: Column) -> Column:
        tokens = F.filter(F.split(text, r"\s+"), lambda w: w != "")
        return (
            (text != "")
            & (F.length(text) <= 80)
            & ~F.rlike(text, F.lit(r"[.!?]$"))
            & ~F.rlike(text, F.lit(r",\s+[a-z]"))
            & ~F.rlike(text, F.lit(r"\d"))
            & (F.size(tokens) <= 10)
            & F.exists(tokens, lambda w: F.rlike(w, F.lit(r"^\p{Lu}")))
        )

    return let(strip_chars(strip(line), r"•*+\- "), test)


def experience_entries(text: Column) -> Column:
    """array of job entries read line by line.

    A dates line completes the entry whose title came before it, or opens a new one; bullets and prose are
    details; a title waits until the next line tells what it belongs to.
    """

    def classify(line: Column) -> Column:
        found = F.regexp_extract(line, DATES, 0)
        at = F.position(found, line)
        before = strip_chars(F.substr(line, F.lit(1), at - 1), r" \-:=,")
        after = strip_chars(F.substr(line, at + F.length(found)), r" \-:=,")
        dated = (found != "") & ~F.startswith(F.lower(line), F.lit("summary"))
        kind = (
            F.when(dated, "dates")
            .when(F.rlike(line, F.lit(r"^[+\-•*]")), "bullet")
            .when(_is_title(line), "title")
            .otherwise("text")
        )
        return F.struct(
            line.alias("line"), kind.alias("kind"), strip(found).alias("dates"),
            F.nullif(before, F.lit("")).alias("company"), F.nullif(after, F.lit("")).alias("location"),
            strip(F.regexp_replace(line, r"^[+*\-• ]+", "")).alias("bullet"),
        )

    def entry(title, company, dates, location, details) -> Column:
        return F.struct(
            title.alias("title"), company.alias("company"), dates.alias("dates"), location.alias("location"), details.alias("details")
        ).cast(_ENTRY)

    none, no_details = F.lit(None).cast("string"), F.array().cast("array<string>")

    def keep(out: Column, e: Column) -> Column:
        signal = (
            F.coalesce(e["title"], e["company"], e["dates"], e["location"]).isNotNull() | (F.size(e["details"]) > 0)
        )
        return F.when(signal, F.array_append(out, e)).otherwise(out)

    def step(state: Column, row: Column) -> Column:
        cur, pending, out = state["cur"], state["pending"], state["out"]

        def make(cur_, pending_, out_) -> Column:
            return F.struct(cur_.alias("cur"), pending_.cast("string").alias("pending"), out_.alias("out"))

        def with_details(details: Column) -> Column:
            return entry(cur["title"], cur["company"], cur["dates"], cur["location"], details)

        settled = F.when(pending.isNotNull(), F.array_append(cur["details"], pending)).otherwise(cur["details"])

        def on_dates() -> Column:
            title = F.coalesce(cur["title"], pending)
            details = F.when(pending.isNotNull() & cur["title"].isNotNull(), F.array_append(cur["details"], pending)).otherwise(cur["details"])
            attach = cur["dates"].isNull() & (title.isNotNull() | (F.size(details) > 0))
            closed = entry(title, cur["company"], cur["dates"], cur["location"], details)
            return F.when(
                attach, make(entry(title, row["company"], row["dates"], row["location"], details), none, out)
            ).otherwise(make(entry(none, row["company"], row["dates"], row["location"], no_details), none, keep(out, closed)))

        bullet = F.when(row["bullet"] != "", F.array_append(cur["details"], row["bullet"])).otherwise(cur["details"])
        return (
            F.when(row["kind"] == "dates", on_dates())
            .when(row["kind"] == "bullet", make(with_details(bullet), pending, out))
            .when(row["kind"] == "title", make(with_details(settled), row["line"], out))
            .otherwise(make(with_details(F.array_append(settled, row["line"])), none, out))
        )

    def finish(state: Column) -> Column:
        cur = state["cur"]
        last = entry(
            F.coalesce(cur["title"], state["pending"]), cur["company"], cur["dates"], cur["location"], cur["details"]
        )
        return keep(state["out"], last)

    lines = F.filter(F.transform(F.split(text, r"\r?\n"), strip), lambda line: line != "")
    start = F.struct(
        entry(none, none, none, none, no_details).alias("cur"), none.alias("pending"),
        F.array().cast(f"array<{_ENTRY}>").alias("out"),
    )
    return F.aggregate(F.transform(lines, classify), start, step, finish)
