"""Best-fit packing with certified bounds.

Pieces of documents are dealt to partitions, and each partition packs its own by best-fit
decreasing.  Lower bounds from dual-feasible functions certify a partition whose number of bins can't
be lowered by itself.  Bins with gaps give up their pieces, in the first round those of certified partitions
too, since gaps of several partitions may make a bin together; the pieces are dealt anew to so many partitions as they need and packed
again, until the bound over all pieces is met or a round gains nothing.  The bound is returned beside the number of bins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnspark.llm._scratch import save

CAPACITY = 2048
#: Pieces that a task packs at once, about; so many times as many in an exchange, where fewer are left.
ITEMS, EXCHANGE = 32_768, 16
END_ID = 0
SPECIAL = "<|endoftext|>"
PIECES = "piece int, start long, length long, ids_crc32 long"


def lower_bound(histogram: np.ndarray) -> int:
    """The most bins that dual-feasible functions prove necessary; ``histogram[x]``: items of length x, capacity last."""
    c = len(histogram) - 1
    x = np.arange(c + 1, dtype=np.int64)
    n = histogram.astype(np.int64)
    best = -(-int((n * x).sum()) // c)
    count, mass = np.cumsum(n), np.cumsum(n * x)
    for e in range(1, c // 2 + 1):  # items over c - e count as c, those under e as nothing
        best = max(best, -(-int((count[c] - count[c - e]) * c + mass[c - e] - mass[e - 1]) // c))
    for k in range(1, 101):  # rounding functions of Fekete and Schepers, times k
        scaled = (k + 1) * x
        best = max(best, -(-int((n * np.where(scaled % c == 0, x * k, scaled // c * c)).sum()) // (c * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item, and the free room of each bin.  Ties keep the order given."""
    n = len(lengths)
    place, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    free: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(free)
            free.append(capacity)
        place[i], offset[i] = b, capacity - room
        free[b] = room - size
        by_room[room - size].append(b)
        rooms |= 1 << (room - size)
    return place, offset, np.array(free, np.int64)


def _packer(round_no: int, capacity: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held or not sum(b.num_rows for b in held):
            return
        table = pa.Table.from_batches(held).combine_chunks()
        lengths = table["length"].to_numpy()
        place, offset, free = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1))
        certified = len(free) == bound
        base = (round_no << 56) | (TaskContext.get().partitionId() << 32)
        opened = np.zeros(len(place), bool) if certified and round_no else (free > 0)[place]
        for name, values in (("sequence_id", place + base), ("offset", offset), ("certified", np.full(len(place), certified)), ("open", opened)):
            table = table.append_column(name, pa.array(values))
        yield from table.to_batches(max_chunksize=65_536)

    return pack


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, items: int = ITEMS, rounds: int | None = None) -> DataFrame:
    """``pieces`` with sequence_id, offset, certified, and for all rows alike sequences and least_sequences: how many there are, and the bound.

    ``length`` lies between 1 and ``capacity``.  Other columns pass through.  Each round is written to the
    shared folder, so a lost executor repeats its tasks only.  A round that doesn't lower the
    number of bins is thrown away, so the result is never worse than the first packing.  Without ``rounds`` they end when one gains nothing.
    """
    names = pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long, certified boolean, open boolean"
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # as many rows as there are lengths
        histogram[length] = n
    bound, parts, done, k = lower_bound(histogram), max(1, -(-int(histogram.sum()) // items)), [], 0
    packed = save(pieces.repartition(parts).mapInArrow(_packer(0, capacity), schema), "pack-0")
    bins = packed.where("offset = 0").count()
    while bins > bound and (rounds is None or k + 1 < rounds):
        pool, pool_bins = packed.agg(F.count(F.when(F.col("open"), 1)), F.count(F.when(F.col("open") & (F.col("offset") == 0), 1))).first()
        if parts == 1 or pool_bins <= 1:
            break
        k, parts = k + 1, max(1, -(-pool // (items * EXCHANGE)))
        again = save(packed.where("open").select(*names).repartition(parts).mapInArrow(_packer(k, capacity), schema), f"pack-{k}")
        now = again.where("offset = 0").count()
        if now >= pool_bins:
            break
        done.append(packed.where("not open"))
        packed, bins = again, bins - pool_bins + now
    for d in done:
        packed = packed.unionByName(d)
    return packed.drop("open").withColumns({"sequences": F.lit(bins).cast("long"), "least_sequences": F.lit(bound).cast("long")})


class Tokenizer:
    """Token ids of the byte-level vocabulary.

    The ids are those of the ``tokenizers`` library for the same file.  A text with the special token's string, or with a
    run too long for the faster encoder of the same merges, goes through that library; all others through the faster one.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import base64

        import tiktoken
        from tokenizers import Tokenizer as Plain

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.path, self.plain, self.load = json_path, None, Plain.from_file

    def __call__(self, text: str) -> np.ndarray:
        if SPECIAL not in text:
            try:
                return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.uint32)
            except ValueError:  # its pattern can't go back over hundreds of thousands of equal characters
                pass
        self.plain = self.plain or self.load(self.path)
        return np.array(self.plain.encode(text, add_special_tokens=False).ids, np.uint32)


_LOADED: dict[str, Tokenizer] = {}


def public_tokenizer(name: str = "byte_bpe_50k") -> Tokenizer:
    if name not in _LOADED:
        import public_tokenizers as p

        _LOADED[name] = Tokenizer(p.path(f"{name}.json"), p.path(f"{name}.tiktoken"), p.PATTERN)
    return _LOADED[name]


def piece_rows(ids: np.ndarray, capacity: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document; only one that is too long is cut, its first piece being the shorter."""
    n, raw = len(ids), ids.astype("<u4")
    cuts = [0, *range(n % capacity or capacity, n, capacity), n]
    return [(k, a, b - a, zlib.crc32(raw[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]


def document_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """The pieces of every row's token ids and a closing id 0; a null text is empty, so one closing id is left."""
    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = public_tokenizer(tokenizer)
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch["text"]):
                for row in piece_rows(np.append(encode(text.as_py() or ""), np.uint32(END_ID)), capacity):
                    at.append(i)
                    rows.append(row)
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, {PIECES}")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """All documents in few sequences of at most ``capacity`` tokens, one row per piece.

    Repeated rows are packed one by one; null ids are kept; an empty table gives none; other columns are ignored.
    """
    pieces = save(document_pieces(docs, capacity), "pieces")
    return pack_pieces(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified", "sequences", "least_sequences")
