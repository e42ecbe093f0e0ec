"""N-gram Jaccard join by a token-group matrix.

Texts with the same shingle set are one node.  Similar nodes are put into groups: nodes that
agree in a band of min-hashes share a group.  A group is cut into parts of a bounded number of tokens, and each part
stores the union of its members' tokens.  A member can link with a member of another part only if
enough tokens of its prefix (its rarest tokens) are in the other's prefixes, and only if its
overlap with the other part's union reaches the size that the threshold asks for; only such parts are
opened, and overlaps counted with all members at once.  The links give connected components.

Before that, each node is compared with the smallest node of its bands.  The links found so join near copies in time
proportional to their number; parts whose members all link with the same node aren't compared again.

Token sets are sent only for pairs of nodes that a short sketch lets pass: a bit array of the parities of
the tokens, whose differences bound the overlap from above.

The order in which tokens count as rare comes from an array of levels of a fixed size, made from how many
texts have a token in their prefixes.  Any order gives the same links; a good one opens fewer parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnspark.llm import _text
from tarnspark.llm._bitmap import members, only_members, with_member
from tarnspark.llm._scratch import drop, free_names, save
from tarnspark.llm.components import components

#: Min-hash bands that propose groups, and hashes in each.
BANDS, ROWS = 8, 3
#: Slots of the array of levels (a byte each), and tokens of a part of a group, about.
SLOTS = 1 << 22
PART_TOKENS = 1 << 16
#: Rows that a token is in, from which on it counts as common; overlap in percent, from which on nodes of a band are grouped.
COMMON, SIMILAR = 4, 60
#: Rows of a batch of token sets, and of one of opened parts.
SETS, OPENED = 128, 16
_ODD = _text.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def required(size: int, percent: int) -> int:
    """The least overlap that a set of ``size`` has with any set it links to."""
    return -(-size * percent // 100)


def links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a & b| >= percent * |a | b|, for sorted distinct arrays; empty ones link with nothing."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _tokens(scalar: pa.Scalar) -> np.ndarray:
    return np.frombuffer(scalar.as_buffer(), np.uint64)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """How many tokens fall on each of at least four slots a token, odd (1) or even (0), as a bit array."""
    size = max(512, 1 << (4 * len(tokens) - 1).bit_length())
    return np.packbits(np.bincount((tokens & _text.U(size - 1)).astype(np.int64), minlength=size) & 1)


def may_link(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int, percent: int) -> bool:
    """False only for sets that don't link: two sets differ in at least as many tokens as their sketches in bits.

    The longer sketch is folded to the length of the other; parities of folded slots add up.
    """
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    most = (n_a + n_b - int(np.bitwise_count(a ^ b).sum())) // 2
    return most * (100 + percent) >= percent * (n_a + n_b)


def _node(tokens: np.ndarray) -> bytes:
    """What stands for a set: 96 bits of a cryptographic hash."""
    return hashlib.blake2b(tokens.tobytes(), digest_size=12).digest()


def _bands(tokens: np.ndarray) -> list[int]:
    least = np.full(len(_ODD), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(tokens), 1 << 16):
        least = np.minimum(least, (_ODD[:, None] * tokens[None, i : i + (1 << 16)]).min(1))
    m = least.reshape(BANDS, ROWS)
    mixed = _text.mix(m[:, 0] * _text.U(3) + _text.mix(m[:, 1] * _text.U(5) + _text.mix(m[:, 2] + np.arange(BANDS, dtype=np.uint64))))
    return mixed.view(np.int64).tolist()


def _prefix(tokens: np.ndarray, percent: int, level: np.ndarray | None, more: int = 0) -> np.ndarray:
    """The rarest tokens, and ``more`` that follow; any set that links to this one has one of the former, and in its own prefix too."""
    length = len(tokens) - required(len(tokens), percent) + 1 + more if len(tokens) else 0
    if level is not None and len(tokens):
        rank = level[(tokens % _text.U(SLOTS)).astype(np.int64)]
        if rank.any():
            tokens = tokens[np.argsort(rank, kind="stable")]  # ties by hash
    return tokens[:length].view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))


def described(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, x, n, node, bands, prefix) of every row, x being the text's hash; node and bands are null for an empty set."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.pieces(batches):
            n, nodes, bands, prefix = [], [], [], []
            for tokens in _text.row_shingle_sets(batch["text"], k):
                n.append(len(tokens))
                nodes.append(_node(tokens) if len(tokens) else None)
                bands.append(_bands(tokens) if len(tokens) else None)
                prefix.append(_prefix(tokens, percent, None))
            columns = [batch["doc_id"], batch["x"], pa.array(n, pa.int64()), pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64())), _lists(prefix)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "x", "n", "node", "bands", "prefix"])
        _text.trim()

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("x"), "text")
    return keyed.mapInArrow(describe, "doc_id long, x long, n long, node binary, bands array<long>, prefix array<long>")


def token_levels(prefixes: DataFrame, sizes: int = SLOTS) -> np.ndarray:
    """For each slot the binary logarithm (15 at most) of the most rows that one of its common tokens is in, else 0.

    ``sizes`` bytes reach the driver, in blocks, whatever the data.
    """
    block = 1 << 12
    counts = prefixes.select(F.explode("prefix").alias("t")).groupBy("t").count().where(f"count >= {COMMON}")
    level = F.least(F.floor(F.log2("count")), F.lit(15)).cast("int")
    slots = counts.groupBy(F.expr(f"int(t & {sizes - 1})").alias("s")).agg(F.max(level).alias("v"))
    packed = slots.groupBy(F.shiftright("s", 12).alias("b")).agg(F.collect_list(F.col("s").bitwiseAND(block - 1) * 16 + F.col("v")).alias("x"))  # at most a block's slots
    out = np.zeros(sizes, np.uint8)
    rows = packed.toArrow()
    for b, x in zip(rows["b"].to_pylist(), rows["x"], strict=True):
        x = x.values.to_numpy(zero_copy_only=False)
        out[b * block + x // 16] = x % 16
    return out


def newcomers(docs: DataFrame, k: int, percent: int, levels: np.ndarray) -> DataFrame:
    """(prefix): for every row whose prefix changes with ``levels``, the tokens that come into it and as many more that may follow."""
    sent = docs.sparkSession.sparkContext.broadcast(levels.tobytes())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(sent.value, np.uint8)
        for batch in _text.pieces(batches):
            found = []
            for tokens in _text.row_shingle_sets(batch["text"], k):
                first = _prefix(tokens, percent, None)
                out = int(np.count_nonzero(level[(first.view(np.uint64) % _text.U(SLOTS)).astype(np.int64)]))
                if out:
                    found.append(np.setdiff1d(_prefix(tokens, percent, level, 2 * out), first))
            yield pa.RecordBatch.from_arrays([_lists(found)], ["prefix"])
        _text.trim()

    return docs.select("text").mapInArrow(find, "prefix array<long>")


def ranked_prefixes(docs: DataFrame, k: int, percent: int, levels: np.ndarray) -> DataFrame:
    """(node, n, prefix) of every row that isn't empty, by the order of ``levels``."""
    sent = docs.sparkSession.sparkContext.broadcast(levels.tobytes())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(sent.value, np.uint8)
        for batch in _text.pieces(batches):
            sets = [t for t in _text.row_shingle_sets(batch["text"], k) if len(t)]
            columns = [pa.array([_node(t) for t in sets], pa.binary()), pa.array([len(t) for t in sets], pa.int64()), _lists([_prefix(t, percent, level) for t in sets])]
            yield pa.RecordBatch.from_arrays(columns, ["node", "n", "prefix"])
        _text.trim()

    return docs.select("text").mapInArrow(cut, "node binary, n long, prefix array<long>")


def _made_of(docs: DataFrame, wanted: DataFrame, k: int, column: str, make) -> DataFrame:
    """(node, n, column): what ``make`` gives for the set of one document of each wanted (node, doc_id).

    Texts are read where they lie; a bit array of a fixed size tells which rows may be wanted, so a few more nodes may come along.
    """

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.pieces(batches):
            held = list(_text.row_shingle_sets(batch["text"], k))
            columns = [pa.array([_node(t) for t in held], pa.binary()), pa.array([len(t) for t in held], pa.int64()), pa.array([make(t).tobytes() for t in held], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["node", "n", column])
        _text.trim()

    rows = only_members(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), members(wanted, "doc_id"), "doc_id").select("text")
    made = rows.mapInArrow(compute, f"node binary, n long, {column} binary")
    return made.groupBy("node").agg(F.first("n").alias("n"), F.first(column).alias(column))


def sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, tokens) of the wanted (node, doc_id) rows, and perhaps of others."""
    return _made_of(docs, wanted, k, "tokens", lambda t: t).select("node", "tokens")


def passed(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, k: int, percent: int, wide: int | None = None) -> DataFrame:
    """(a, b, close): the pairs of nodes whose sketches don't rule out an overlap of ``wide`` percent (``percent`` by default); close: nor a link."""
    named = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = nodes.select("node", "doc_id").join(named, "node", "left_semi")
    sketches = save(_made_of(docs, wanted, k, "sketch", sketch), "sketches", "uncompressed")
    left, right = (sketches.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.pieces(batches):
            rows = [(np.frombuffer(a.as_buffer(), np.uint8), m.as_py(), np.frombuffer(b.as_buffer(), np.uint8), n.as_py()) for a, m, b, n in zip(*(batch[c] for c in ("sa", "na", "sb", "nb")), strict=True)]
            keep = [i for i, r in enumerate(rows) if may_link(*r, wide or percent)]
            kept = batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))
            yield kept.append_column("close", pa.array([may_link(*rows[i], percent) for i in keep], pa.bool_()))
        _text.trim()

    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "sa", "na", "sb", "nb")
    found = save(both.mapInArrow(test, "a binary, b binary, close boolean"), "passed", rows=SETS)
    drop(sketches)
    return found


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The rows (a, b) of pairs of nodes that link, from those whose sketches passed."""
    named = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = nodes.select("node", "doc_id").join(named, "node", "left_semi")
    sets = save(sets_of(docs, wanted, k), "sets", "uncompressed")
    left, right = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")), sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.pieces(batches, 64):
            keep = [i for i, (x, y) in enumerate(zip(batch["x"], batch["y"], strict=True)) if links(_tokens(x), _tokens(y), percent)]
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))
        _text.trim()

    found = save(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(verify, "a binary, b binary"), "verified", rows=SETS)
    drop(sets)
    return found


def star_pairs(nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b): a node and the smallest node of a band that both share, BANDS at most for each node."""
    banded = nodes.select("node", "n", F.explode("bands").alias("band"))
    smallest = banded.groupBy("band").agg(F.min(F.struct("node", "n")).alias("m"), F.count("*").alias("c")).where("c > 1")
    smallest = save(smallest.select("band", F.col("m.node").alias("b"), F.col("m.n").alias("bn")), "bands")
    close = 100 * F.least("n", "bn") >= percent * F.greatest("n", "bn")
    return save(banded.join(smallest, "band").where((F.col("node") != F.col("b")) & close).select(F.col("node").alias("a"), "b").distinct(), "star-pairs")


def leaders(pairs: DataFrame) -> DataFrame:
    """(node, label) of the nodes of pairs (a, b), b being the smaller: the smallest partner, or the node itself."""
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))


def grouped(nodes: DataFrame, pairs: DataFrame, stars: DataFrame) -> DataFrame:
    """(node, doc_id, n, g, part, v) of the nodes in groups: g the group; nodes of equal v are joined by verified links.

    A v of more than a part's tokens has parts of its own, by the hash of the node; the others of a
    group are dealt to parts by the hash of v.
    """
    own = nodes.select("node", "doc_id", "n").join(leaders(pairs).withColumnRenamed("label", "group"), "node")
    own = own.join(leaders(stars), "node", "left").select("node", "doc_id", "n", F.xxhash64("group").alias("g"), F.xxhash64(F.coalesce("label", "node")).alias("v"))
    own = save(own, "placed")
    joined = own.groupBy("g", "v").agg(F.sum("n").alias("vn"))
    rest = F.sum(F.when(F.col("vn") <= PART_TOKENS, F.col("vn")))
    sizes = joined.groupBy("g").agg(F.coalesce(F.ceil(rest / PART_TOKENS), F.lit(1)).alias("p"))
    large = joined.where(F.col("vn") > PART_TOKENS).select("g", "v", F.ceil(F.col("vn") / PART_TOKENS).alias("vp"))
    both = own.join(sizes, "g").join(large, ["g", "v"], "left")
    part = F.when(F.col("vp").isNotNull(), F.xxhash64("v", F.pmod(F.xxhash64("node"), F.col("vp")))).otherwise(F.pmod(F.xxhash64("v"), F.col("p")))
    return save(both.select("node", "doc_id", "n", "g", part.alias("part"), "v"), "groups")


_MEMBER = pa.struct([("node", pa.binary()), ("tokens", pa.binary())])


def _matrix_rows(key: tuple, table: pa.Table) -> pa.Table:
    """One row of the matrix: a part with its members and, if there are several, their token union."""
    sets = [_tokens(t) for t in table["tokens"]]
    union = np.unique(np.concatenate(sets)) if len(sets) > 1 else np.zeros(0, np.uint64)
    members_ = [{"node": n.as_py(), "tokens": t.tobytes()} for n, t in zip(table["node"], sets, strict=True)]
    return pa.table(
        [pa.array([k.as_py()], pa.int64()) for k in key] + [pa.array([union.tobytes()], pa.binary()), pa.array([members_], pa.list_(_MEMBER))],
        names=["g", "part", "union", "members"],
    )


def _linked(left: list[tuple[bytes, np.ndarray]], right: list[tuple[bytes, np.ndarray]], union: np.ndarray, percent: int, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """For members of ``left`` by number, the numbers of all members of ``right`` that they link with (a set with itself too).

    Members whose overlap with ``union``, the tokens of ``right``, can't suffice are passed by; for the others the overlaps with all
    members of ``right`` are counted from their postings, ``most`` at a time.
    """
    tokens = np.concatenate([t for _, t in right])
    owner = np.repeat(np.arange(len(right)), [len(t) for _, t in right])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    sizes = np.array([len(t) for _, t in right])
    for at, (_, own) in enumerate(left):
        if len(np.intersect1d(own, union, assume_unique=True)) < required(len(own), percent):
            continue
        a, b = np.searchsorted(tokens, own, "left"), np.searchsorted(tokens, own, "right")
        overlap = np.zeros(len(right), np.int64)
        for i, j in _ranges(b - a, most):
            hits = np.repeat(a[i:j], (b - a)[i:j]) + _within((b - a)[i:j])
            overlap += np.bincount(owner[hits], minlength=len(right))
        yield at, np.flatnonzero(100 * overlap >= percent * (len(own) + sizes - overlap))


def part_links(left: list[tuple[bytes, np.ndarray]], right: list[tuple[bytes, np.ndarray]], union: np.ndarray, percent: int, most: int = 1 << 19) -> list[tuple[bytes, bytes]]:
    """A spanning forest of the links between members of two parts (or of one, given twice)."""
    root: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    found = []
    for at, partners in _linked(left, right, union, percent, most):
        node = left[at][0]
        for k in partners:
            x, y = find(node), find(right[k][0])
            if x != y:
                root[x] = y
                found.append((node, right[k][0]))
    return found


def part_counts(left: list[tuple[bytes, np.ndarray]], right: list[tuple[bytes, np.ndarray]], union: np.ndarray, percent: int, same: bool, most: int = 1 << 19) -> list[tuple[bytes, int]]:
    """(node, number of all its links) between members of two parts, or within one given twice (``same``)."""
    mine, theirs = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
    for at, partners in _linked(left, right, union, percent, most):
        mine[at] = len(partners) - same  # without itself
        theirs[partners] += 1
    both = [(left, mine)] if same else [(left, mine), (right, theirs)]
    return [(node, int(c)) for side, counts in both for (node, _), c in zip(side, counts, strict=True) if c]


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of the given lengths."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def _ranges(counts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    i, total = 0, np.cumsum(counts)
    while i < len(counts):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


def _opened(percent: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.pieces(batches, 4):
            found: list[tuple[bytes, bytes]] = []
            for row in range(batch.num_rows):
                m1, m2 = ([(m["node"].as_py(), _tokens(m["tokens"])) for m in batch[c][row]] for c in ("m1", "m2"))
                few, many, union = (m1, m2, batch["u2"][row]) if len(m1) <= len(m2) else (m2, m1, batch["u1"][row])
                found += part_links(few, many, _tokens(union) if len(many) > 1 else many[0][1], percent)
            columns = list(zip(*found, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], ["a", "b"])

    return compare


def _counted(percent: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.pieces(batches, 4):
            found: list[tuple[bytes, int]] = []
            for row in range(batch.num_rows):
                m1, m2 = ([(m["node"].as_py(), _tokens(m["tokens"])) for m in batch[c][row]] for c in ("m1", "m2"))
                few, many, union = (m1, m2, batch["u2"][row]) if len(m1) <= len(m2) else (m2, m1, batch["u1"][row])
                found += part_counts(few, many, _tokens(union) if len(many) > 1 else many[0][1], percent, batch["same"][row].as_py())
            node, links_ = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(links_, pa.int64())], ["node", "links"])

    return compare


def least_common(lo: Column, hi: Column, lo2: Column, hi2: Column, percent: int) -> Column:
    """How many prefix tokens two parts with sets of these sizes must share at least, for any of their sets to link.

    Of two linked sets, the one whose prefix ends first has all but its suffix among the shared prefix tokens: the
    overlap is at most the shared ones and that suffix, and at least percent / (100 + percent) of both sizes.
    """
    share = percent / (100.0 + percent)
    exact = F.ceil((hi + hi2) * share - 1e-6) - F.ceil(F.greatest(hi, hi2) * percent / 100.0 - 1e-6) + 1
    large, small = F.greatest(hi, hi2), F.greatest(F.least(lo, lo2), F.greatest(lo, lo2) * percent / 100.0)
    spread = F.ceil((large + small) * share - large * percent / 100.0 - 1e-6)  # the least over all sizes in between
    return F.greatest(F.when((lo == hi) & (lo2 == hi2), exact).otherwise(spread), F.lit(1))


def candidate_parts(ranked: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(g, part, g2, part2): parts that may hold linked sets, in one order, a part of several components with itself too."""
    may = with_member(ranked, members(groups, "node"), "may", "node")
    alone: Column = F.xxhash64("node")
    inside = may.where("may").drop("may").join(groups.select(F.col("node").alias("gn"), "g", "part", "v"), F.col("node") == F.col("gn"), "left")
    placed = may.where("not may").select("n", "prefix", alone.alias("g"), F.lit(0).cast("long").alias("part"), alone.alias("v")).unionByName(
        inside.select("n", "prefix", F.coalesce("g", alone).alias("g"), F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("v", alone).alias("v"))
    )
    tokens = placed.select("g", "part", "v", "n", F.explode("prefix").alias("t"))
    shared = tokens.groupBy("t").agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a != b")
    index = only_members(tokens, members(shared, "t"), "t").groupBy("t", "g", "part").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("v").alias("va"), F.max("v").alias("vb"))
    index = save(index, "index")
    other = index.select("t", *(F.col(c).alias(f"{c}2") for c in ("g", "part", "lo", "hi", "va", "vb")))
    fits = (100 * F.col("hi") >= percent * F.col("lo2")) & (100 * F.col("hi2") >= percent * F.col("lo"))
    ordered = (F.col("g") < F.col("g2")) | ((F.col("g") == F.col("g2")) & (F.col("part") < F.col("part2")))
    apart = (F.col("va") != F.col("vb")) | (F.col("va2") != F.col("vb2")) | (F.col("va") != F.col("va2"))
    met = index.join(other, "t").where(ordered & fits & apart).groupBy("g", "part", "g2", "part2")
    met = met.agg(F.count("*").alias("c"), *(f(x).alias(x) for x in ("lo", "lo2") for f in (F.min,)), *(f(x).alias(x) for x in ("hi", "hi2") for f in (F.max,)))
    # sizes seen at the shared tokens only bound less than the parts' own, so those are taken
    spans = save(placed.groupBy("g", "part").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("v").alias("va"), F.max("v").alias("vb")).where("lo != hi or va != vb"), "spans")
    one = spans.select("g", "part", F.col("lo").alias("slo"), F.col("hi").alias("shi"))
    two = spans.select(F.col("g").alias("g2"), F.col("part").alias("part2"), F.col("lo").alias("slo2"), F.col("hi").alias("shi2"))
    met = met.join(one, ["g", "part"], "left").join(two, ["g2", "part2"], "left")
    ends = [F.coalesce(f"s{x}", x) for x in ("lo", "hi", "lo2", "hi2")]
    pairs = met.where(F.col("c") >= least_common(*ends, percent)).select("g", "part", "g2", "part2")
    mixed = spans.where("va != vb").select("g", "part", F.col("g").alias("g2"), F.col("part").alias("part2"))
    return save(pairs.unionByName(mixed), "part-pairs")


def cross_links(docs: DataFrame, nodes: DataFrame, groups: DataFrame, pairs: DataFrame, k: int, percent: int, count: bool = False) -> DataFrame:
    """(a, b): the links between members of the parts that their components need; with ``count`` (node, links), how many there are at all.

    Parts of one node each are compared as nodes; pairs with a larger part are opened from the matrix.
    """
    alone: Column = F.xxhash64("node")
    named = pairs.select("g", "part").unionByName(pairs.select(F.col("g2").alias("g"), F.col("part2").alias("part"))).distinct()
    every = nodes.join(groups.select("node", "g", "part"), "node", "left").select("node", "doc_id", F.coalesce("g", alone).alias("g"), F.coalesce("part", F.lit(0)).alias("part"))
    wanted = save(every.join(named, ["g", "part"], "left_semi"), "wanted")
    single = wanted.groupBy("g", "part").agg(F.count("*").alias("m"), F.min("node").alias("node"))
    single = single.select("g", "part", F.when(F.col("m") == 1, F.col("node")).alias("node"))
    second = single.select(F.col("g").alias("g2"), F.col("part").alias("part2"), F.col("node").alias("b"))
    placed = save(pairs.join(single.withColumnRenamed("node", "a"), ["g", "part"]).join(second, ["g2", "part2"]), "placed-pairs")
    one = placed.where("a is not null and b is not null and a != b").select("a", "b")
    plain = verified(docs, nodes, passed(docs, nodes, one, k, percent), k, percent)
    pairs = placed.where("a is null or b is null").select("g", "part", "g2", "part2")
    large = pairs.select("g", "part").unionByName(pairs.select(F.col("g2").alias("g"), F.col("part2").alias("part"))).distinct()
    held = wanted.join(large, ["g", "part"], "left_semi")
    sets = sets_of(docs, held, k).join(held.select("node", "g", "part"), "node")
    matrix = save(sets.groupBy("g", "part").applyInArrow(_matrix_rows, "g long, part long, union binary, members array<struct<node:binary,tokens:binary>>"), "matrix", "uncompressed", SETS)
    first = matrix.select("g", "part", F.col("union").alias("u1"), F.col("members").alias("m1"))
    second = matrix.select(F.col("g").alias("g2"), F.col("part").alias("part2"), F.col("union").alias("u2"), F.col("members").alias("m2"))
    opened = pairs.join(first, ["g", "part"]).join(second, ["g2", "part2"])
    if count:
        same = ((F.col("g") == F.col("g2")) & (F.col("part") == F.col("part2"))).alias("same")
        counts = opened.select("m1", "m2", "u1", "u2", same).mapInArrow(_counted(percent), "node binary, links long")
        once = plain.select(F.explode(F.array("a", "b")).alias("node"), F.lit(1).cast("long").alias("links"))
        found = save(counts.unionByName(once).groupBy("node").agg(F.sum("links").alias("links")), "link-counts", rows=OPENED)
    else:
        found = plain.unionByName(save(opened.select("m1", "m2", "u1", "u2").mapInArrow(_opened(percent), "a binary, b binary"), "cross-links", rows=OPENED))
    drop(matrix)
    return found


def joined(docs: DataFrame, k: int, percent: int, count: bool = False) -> DataFrame:
    """(doc_id, x, n, root, component_id) of every row: hash of the text, size of the set, component, its smallest id; the
    last two are null for an empty set.  With ``count`` also links, the number of other sets that the set links with.

    Counting opens every part that may hold links, also those whose sets are known to be of one component.
    """
    docs = docs.select("doc_id", "text")
    seen = save(described(docs, k, percent), "described")
    nodes = save(
        seen.where("node is not null").select("doc_id", "n", "node", "bands").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands")), "nodes"
    )
    levels = token_levels(seen.select("prefix"))
    whole, seen = seen, save(seen.select("doc_id", "x", "n", "node"), "seen")
    drop(whole)
    new = save(newcomers(docs, k, percent, levels), "newcomers")  # tokens that come into a prefix for a commoner one may be common too
    levels = np.maximum(levels, token_levels(new))
    drop(new)
    ranked = save(ranked_prefixes(docs, k, percent, levels), "prefixes")
    near = passed(docs, nodes, star_pairs(nodes, percent), k, percent, SIMILAR)
    stars = verified(docs, nodes, near.where("close"), k, percent)
    groups = grouped(nodes, near, stars)
    parts = candidate_parts(ranked, groups, percent)
    if count:
        single = grouped(nodes, near, stars.limit(0))  # no nodes are joined, so that no pair of parts is left out
        counts = cross_links(docs, nodes, single, candidate_parts(ranked, single, percent), k, percent, count=True)
    drop(ranked)
    crossed = cross_links(docs, nodes, groups, parts, k, percent)
    labels = components(stars.unionByName(crossed))
    rooted = save(nodes.join(labels, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    placed = rooted.join(least, "root")
    names = ["doc_id", "x", "n", "root", "component_id"]
    if count:
        placed, names = placed.join(counts, "node", "left").withColumn("links", F.coalesce("links", F.lit(0))), [*names, "links"]
    return seen.join(placed.select("node", *names[3:]), "node", "left").select(*names)


def document_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id as ``join_documents`` gives them, without counting links."""
    component = F.coalesce("component_id", F.when(F.col("root").isNull(), F.col("doc_id")))
    return joined(docs, k, percent).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def join_documents(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links for every row.

    ``component_id`` is the smallest id reachable by links, the row's own included; ``n_links`` counts all
    verified links of the row's set with other sets.  Null and
    empty texts have no shingles and are linked with nothing.  A row with a null id takes part; its
    component is null only if no row of it has an id.  Repeated rows share their values.  Other columns are ignored.
    """
    component = F.coalesce("component_id", F.when(F.col("root").isNull(), F.col("doc_id")))
    return joined(docs, k, percent, count=True).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce("links", F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: that of its smallest id (null last), of least text hash among its texts.

    Rows with an empty set all stay.  Only the texts of rows that aren't alone in their component are shuffled; a bit array of
    fixed size tells them.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))
    k1, k2, blank_, may, id_, x_ = free_names(docs, "_key", "_hash", "_blank", "_may", "_id", "_x")
    rooted = save(joined(docs, k, percent).where("n > 0").select(key.alias("id"), "x", "root"), "rooted-rows")
    firsts = rooted.groupBy("root").agg(F.min(F.struct("id", "x")).alias("m"), F.count("*").alias("c")).where("c > 1").select("root", "m")
    shared = save(rooted.join(save(firsts, "firsts"), "root").select("id", "x", (F.struct("id", "x") != F.col("m")).alias("later")).distinct(), "shared-rows")
    dropped = shared.where("later").select(F.col("id").alias(id_), F.col("x").alias(x_))
    blank = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rows = with_member(docs.withColumns({k1: key, k2: F.xxhash64("text"), blank_: blank}), members(shared, "id", "x"), may, k1, k2)
    doubtful = rows.where(F.col(may) & ~F.col(blank_)).join(dropped, (F.col(k1) == F.col(id_)) & (F.col(k2) == F.col(x_)), "left_anti")
    one = doubtful.dropDuplicates([k1, k2])  # repeated rows
    return rows.where(~F.col(may) | F.col(blank_)).select(*docs.columns).unionByName(one.select(*docs.columns))
