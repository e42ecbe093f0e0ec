"""Line dedup by content-defined chunks.

A text's lines (ended by a line break or by the end of a sentence) are hashed, and a rolling hash
over neighbouring line hashes chooses the chunks' boundaries, so that an inserted line moves
boundaries only near itself.  Beside these there are grams of words, chosen by their hashes alone
(the least of each window), so that any two occurrences of ``GRAM + WINDOW - 1`` = 50 words or more have a gram in common,
whatever stands around them and wherever their lines end.  Chunks and grams that occur elsewhere are found by hash;
neighbouring ones with the same first occurrence are joined to runs, compared byte by byte with that
occurrence, extended as far as the bytes agree, and removed.  The first occurrence, by
(doc_id, hash of the text, position), stays.

Beside a run, ``CONTEXT`` = 50 words of the first occurrence are compared, however long they are.  No repeated stretch reaches further: one of 50
words or more has a gram within 24 words of either end, and a shorter one has fewer than 50 words in all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnspark.llm import _text
from tarnspark.llm._bitmap import members, only_members, with_member
from tarnspark.llm._scratch import drop, free_names, save

#: A chunk has so many lines and words at least; then each boundary closes it with a chance of 1 / CHANCE.
LEAST_LINES, LEAST_WORDS, CHANCE = 2, 8, 2
#: Words of a gram, and successive grams of which the one of least hash is kept.  A window is shorter than a gram, so neighbours leave no gap.
GRAM, WINDOW = 26, 25
#: Words beside a run that are compared to extend it.
CONTEXT = 50
_END = np.zeros(256, bool)
_END[list(b".!?")] = True


def _around(starts: np.ndarray, ends: np.ndarray, first: np.ndarray, row: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes from ``CONTEXT`` words before word ``a`` to its start, and from the end of word ``b`` to so many words after it, within the row."""
    before, after = np.maximum(a - CONTEXT, first[row]), np.minimum(b + CONTEXT, first[row + 1] - 1)
    return starts[a] - starts[before], ends[after] - ends[b]


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, _text.RangeHash]:
    """Starts and ends of a slice's words, each row's first word, and hashes of byte ranges: what chunks and grams have in common."""
    return *_text.words(data, at), _text.RangeHash(data)


def chunk_slice(data: np.ndarray, at: np.ndarray, found: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, hash, lead, tail) of the chunks of a slice; positions are bytes within the row, without white space around;
    lead and tail are the bytes of context before and after.  ``found`` is the slice's ``words_of``, if the caller has them."""
    starts, ends, first, hashed = found or words_of(data, at)
    n = len(starts)
    none = np.zeros(0, np.int64)
    if not n:
        return none, none, none, none, none, none
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    closes = _END[data[ends - 1]]  # the word ends a sentence,
    before = np.searchsorted(ends, np.flatnonzero(data == 10), "right") - 1
    closes[before[before >= 0]] = True  # or a line break follows,
    closes[first[1:][first[1:] > 0] - 1] = True  # or the text ends
    last = np.flatnonzero(closes)
    line_first = np.concatenate([[0], last[:-1] + 1])
    line_hash = hashed(starts[line_first], ends[last])
    line_row, line_words = row[last], last - line_first + 1
    rolled = _text.mix(line_hash * _text.U(3))
    rolled[1:] = _text.mix(line_hash[1:] * _text.U(3) + line_hash[:-1])
    rolled[np.concatenate([[0], np.flatnonzero(np.diff(line_row)) + 1])] = 1
    wanted = rolled % _text.U(CHANCE) == 0
    final = np.concatenate([line_row[1:] != line_row[:-1], [True]])
    cuts, lines, words = [], 0, 0
    for i, (w, n_words, end) in enumerate(zip(wanted.tolist(), line_words.tolist(), final.tolist(), strict=True)):
        lines += 1
        words += n_words
        if end or (w and lines >= LEAST_LINES and words >= LEAST_WORDS):
            cuts.append((i, lines, words))
            lines = words = 0
    c_last, c_lines, c_words = np.array(cuts).T
    c_first = c_last - c_lines + 1
    keep = (c_lines >= LEAST_LINES) & (c_words >= LEAST_WORDS)
    a, b, r = line_first[c_first][keep], last[c_last][keep], line_row[c_last][keep]
    start, end = starts[a], ends[b]
    return r, start - at[r], end - at[r], hashed(start, end).view(np.int64), *_around(starts, ends, first, r, a, b)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the position of the least one, the leftmost of equals."""
    least, place, have = h, np.arange(len(h)), 1
    while have < width:
        by = min(have, width - have)
        right = least[by:] < least[:-by]
        least, place, have = np.where(right, least[by:], least[:-by]), np.where(right, place[by:], place[:-by]), have + by
    return place


def gram_slice(data: np.ndarray, at: np.ndarray, found: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, hash, lead, tail, again) of the chosen grams of a slice; positions and ``found`` as for chunks.

    A stretch that repeats itself within less than a gram has an equal gram at each repetition.  The first and last are kept and
    so many between that no window is without; ``again`` marks all but the first, which are no second occurrence in their own text.
    """
    starts, ends, first, hashed = found or words_of(data, at)
    none = np.zeros(0, np.int64)
    n = len(starts) - GRAM + 1
    if n < 1:
        return none, none, none, none, none, none, np.zeros(0, bool)
    count = np.diff(first)
    row = np.repeat(np.arange(len(at) - 1), count)
    h = hashed(starts[:n], ends[GRAM - 1 :])
    top = _text.U(2**64 - 1)
    padded = np.concatenate([np.where(row[:n] == row[GRAM - 1 :], h, top), np.full(WINDOW - 1, top)])
    whole = np.zeros(n, bool)  # windows within a row, and the only one of a row with fewer grams
    whole[: max(0, n - WINDOW + 1)] = row[: max(0, n - WINDOW + 1)] == row[GRAM + WINDOW - 2 :]
    whole[first[:-1][(count >= GRAM) & (count < GRAM + WINDOW - 1)]] = True
    grams = np.unique(_least(padded, WINDOW)[whole])
    if not len(grams):
        return none, none, none, none, none, none, np.zeros(0, bool)
    new = np.ones(len(grams), bool)
    new[1:] = (h[grams[1:]] != h[grams[:-1]]) | (row[grams[1:]] != row[grams[:-1]]) | (np.diff(grams) >= GRAM)
    part = (grams - grams[new][np.cumsum(new) - 1]) // (WINDOW // 2)
    keep = new | np.append(new[1:], True)
    keep[1:] |= part[1:] != part[:-1]
    grams, again = grams[keep], ~new[keep]
    r = row[grams]
    return r, starts[grams] - at[r], ends[grams + GRAM - 1] - at[r], h[grams].view(np.int64), *_around(starts, ends, first, r, grams, grams + GRAM - 1), again


def _keys(docs: DataFrame) -> tuple[Column, Column]:
    """What stands for a document: its id (null: last of all) and the hash of its text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), F.xxhash64("text")


def chunks(docs: DataFrame) -> DataFrame:
    """(k1, k2, w, n, s, e, h, lead, tail, again) of every chunk and gram of every text: keys, whether it is a gram, number within the text's
    chunks or grams, bytes from and to, hash, bytes of context, and whether it goes on with the one before."""
    k1, k2 = _keys(docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = _text.buffers(batch["text"])
            for i, j in _text.slices(at):
                piece, of = data[at[i] : at[j]], at[i : j + 1] - at[i]
                found = words_of(piece, of)
                lines = chunk_slice(piece, of, found)
                for w, (row, *values) in enumerate(((*lines, np.zeros(len(lines[0]), bool)), gram_slice(piece, of, found))):
                    n = np.arange(len(row)) - np.searchsorted(row, row)
                    own = pa.array(row + i)
                    kind = np.full(len(row), w == 1)
                    yield pa.RecordBatch.from_arrays([batch["k1"].take(own), batch["k2"].take(own), *map(pa.array, (kind, n, *values))], ["k1", "k2", "w", "n", "s", "e", "h", "lead", "tail", "again"])
        _text.trim()

    return docs.select(k1.alias("k1"), k2.alias("k2"), "text").mapInArrow(cut, "k1 long, k2 long, w boolean, n long, s long, e long, h long, lead long, tail long, again boolean")


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(k1, k2, s, e, o1, o2, os, oe, lead, tail): runs of chunks, the first occurrence of the same hashes, and its bytes of context."""
    every = save(chunks(docs), "chunks")
    repeated = save(every.groupBy("h").count().where("count > 1").select("h"), "repeated-hashes")  # most hashes occur once; only the others go on
    occurs = save(only_members(every, members(repeated, "h"), "h"), "repeated-chunks")
    drop(every)
    owner = F.min(F.struct("k1", "k2", "s", "e", "n", "lead", "tail"))
    firsts = occurs.groupBy("h").agg(owner.alias("o"), F.count("*").alias("c")).where("c > 1").drop("c")
    firsts = save(firsts, "first-chunks")
    later = occurs.drop("lead", "tail").join(firsts, "h").where("struct(k1, k2, s, e) != struct(o.k1, o.k2, o.s, o.e) and not (again and k1 = o.k1 and k2 = o.k2)")
    later = later.dropDuplicates(["k1", "k2", "w", "n"])  # repeated rows
    order = Window.partitionBy("k1", "k2", "w").orderBy("n")
    before = lambda c: F.lag(c).over(order)
    joined = (before("n") == F.col("n") - 1) & (before("o.k1") == F.col("o.k1")) & (before("o.k2") == F.col("o.k2")) & (before("o.n") == F.col("o.n") - 1)
    numbered = later.withColumn("new", F.when(joined & (F.col("s") - before("s") == F.col("o.s") - before("o.s")), 0).otherwise(1))
    runs = numbered.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("k1", "k2", "w", "run")
    found = save(runs.agg(
        F.min("s").alias("s"), F.max("e").alias("e"), F.first("o.k1").alias("o1"), F.first("o.k2").alias("o2"), F.min("o.s").alias("os"), F.max("o.e").alias("oe"),
        F.min_by("o.lead", "o.s").alias("lead"), F.max_by("o.tail", "o.e").alias("tail"),
    ).drop("w", "run"), "runs")
    drop(occurs)
    drop(firsts)
    return found


def _alike(a: bytes, b: bytes, order: str) -> int:
    """How many bytes of two strings of one length agree: from the start ("little") or from the end ("big")."""
    if a == b:
        return len(a)
    differ = int.from_bytes(a, order) ^ int.from_bytes(b, order)
    return ((differ & -differ).bit_length() - 1) >> 3


def _grow(text: bytes, s: int, e: int, first: bytes, lead: int) -> tuple[int, int] | None:
    """The run's extent in ``text``, extended while its bytes are those around the first occurrence; None if it differs."""
    if text[s:e] != first[lead : lead + e - s]:
        return None
    most, end = min(s, lead), lead + e - s
    a = s - _alike(text[s - most : s], first[lead - most : lead], "big")
    most = min(len(text) - e, len(first) - end)
    b = e + _alike(text[e : e + most], first[end : end + most], "little")
    if a < s and a > 0 and not text[a - 1 : a].isspace():  # whole words only
        while a < s and not text[a : a + 1].isspace():
            a += 1
    while a < s and text[a : a + 1].isspace():  # the white space before stays, so that words aren't joined
        a += 1
    if b > e and b < len(text) and not text[b : b + 1].isspace():
        while b > e and not text[b - 1 : b].isspace():
            b -= 1
    return a, b


def remove_runs(text: bytes, runs: list[tuple[int, int, bytes, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """``text`` without the confirmed runs (start, end, first occurrence with context, bytes of context before), and what was removed."""
    gone: list[list[int]] = []
    for s, e, first, lead in sorted(runs):
        if (span := _grow(text, s, e, first, lead)) is not None:
            if gone and span[0] <= gone[-1][1]:
                gone[-1][1] = max(gone[-1][1], span[1])
            else:
                gone.append(list(span))
    parts, at, kept = [], 0, 0
    for a, b in gone:
        parts.append(text[at:a])
        kept += max(0, a - at)
        at = b
        if not kept or parts[-1][-1:].isspace():  # white space on one side of the gap is enough
            while at < len(text) and text[at : at + 1].isspace():
                at += 1
    return b"".join([*parts, text[at:]]), [(a, b) for a, b in gone]


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_DONE = pa.struct([("text", pa.string()), ("spans", _SPAN)])


def _clean_batch(text: pa.Array, runs: pa.Array) -> pa.Array:
    out = []
    if isinstance(runs, pa.ChunkedArray):
        runs = runs.combine_chunks()
    at, (s, e, b, lead) = runs.offsets.to_pylist(), runs.values.flatten()  # a field at a time: an object for each run takes longer
    for t, known, i, j in zip(text, runs.is_valid(), at[:-1], at[1:], strict=True):
        if not known.as_py() or not t.is_valid:
            out.append({"text": t.as_py(), "spans": []})
            continue
        new, gone = remove_runs(t.as_py().encode(), list(zip(*(x[i:j].to_pylist() for x in (s, e, b, lead)), strict=True)))
        # a cut between the bytes of a character can't occur: both ends stand beside white space or an end of the run
        out.append({"text": new.decode(), "spans": [{"start": a, "end": b} for a, b in gone]})
    return pa.array(out, _DONE)


def deduplicated(docs: DataFrame, spans: str = "_spans") -> DataFrame:
    """``docs`` with ``text`` without repeated chunks and a column ``spans``, new to ``docs``, of the byte ranges removed from the text before.

    All columns and rows stay; a text of which nothing is left is empty.  Null texts stay null.  Rows with
    equal id and text are one document: all of them keep what any of them keeps.  A document without
    repeated chunks isn't shuffled: a bit array of fixed size tells those that may have some.
    """
    if spans in docs.columns:
        raise ValueError(f"{spans} is a column already")
    runs = repeated_runs(docs)
    both = runs.select("k1", "k2").unionByName(runs.select(F.col("o1").alias("k1"), F.col("o2").alias("k2")))
    touched, held = members(runs, "k1", "k2"), members(both, "k1", "k2")
    k1, k2 = _keys(docs)
    texts = only_members(docs.select(k1.alias("o1"), k2.alias("o2"), F.col("text").cast("binary").alias("b")), held, "o1", "o2")
    texts = texts.groupBy("o1", "o2").agg(F.first("b").alias("b"))
    owned = runs.groupBy("o1", "o2", "os", "oe").agg(F.max("lead").alias("lead"), F.max("tail").alias("tail"))
    piece = F.expr("substring(b, int(os - lead) + 1, int(oe + tail - os + lead))")
    bytes_of = save(owned.join(texts, ["o1", "o2"]).select("o1", "o2", "os", "oe", F.col("lead").cast("int").alias("lead"), piece.alias("b")), "first-occurrences")
    m1, m2, r1, r2, may, new, own = free_names(docs, "_k1", "_k2", "_r1", "_r2", "_may", "_new", "_runs")
    per_doc = (
        runs.drop("lead", "tail").join(bytes_of, ["o1", "o2", "os", "oe"]).groupBy(F.col("k1").alias(r1), F.col("k2").alias(r2))
        .agg(F.collect_list(F.struct("s", "e", "b", "lead")).alias(own))  # the runs of one text, which its length bounds
    )
    marked = with_member(docs.withColumns({m1: k1, m2: k2}), touched, may, m1, m2)
    names = docs.columns
    empty = F.array().cast("array<struct<start:long,end:long>>")
    left = marked.where(~F.col(may)).select(*names, empty.alias(spans))
    some = marked.where(may).join(per_doc, (F.col(m1) == F.col(r1)) & (F.col(m2) == F.col(r2)), "left")
    some = some.withColumn(new, F.arrow_udf(_clean_batch, "text string, spans array<struct<start:long,end:long>>")("text", own))
    return left.unionByName(some.select(*(F.col(f"{new}.text").alias(c) if c == "text" else F.col(c) for c in names), F.col(f"{new}.spans").alias(spans)))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, the text that is left, removed_bytes and removed_spans for every row."""
    done = deduplicated(docs.select("doc_id", "text"))
    removed = F.aggregate("_spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return done.select("doc_id", "text", removed.alias("removed_bytes"), F.col("_spans").alias("removed_spans"))
