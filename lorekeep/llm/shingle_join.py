"""N-gram Jaccard join with set-relation skipping.

A document's set holds its distinct five-word shingles; two documents link when
``100 * |A & B| >= 75 * |A | B|``.  The join is exact (up to collisions of 64-bit hashes, and of their first 56 bits inside a family).  Equal sets are
one node from the start: the smallest doc_id that has them.

* Tokens have one global order: those that occur in many documents come last, the rest by hash.  Two
  sets that link share a token among the first ``n - ceil(0.75 n) + 1`` of both, so only these
  prefixes are indexed.
* Index-level skipping.  An index entry holds the set, its size and its position in the set's order, kept as its
  *reach*: the largest partner whose overlap the tokens from that position on can still give.  At the first
  common token of a link, each size is within the reach of the other entry.  Each list has the smallest size and
  the largest reach in it, and entries that fit neither are passed over; so are whole blocks of a long family, by
  the same bounds.  Tokens that only one set has, or only sets whose sizes cannot fit, are told by a bitmap
  and do not enter the index.
* Families.  The entries of a list stand under one leader, the set of least hash, so that lists with the same leader become one family.  Two sets that share a token share a family; a pair is looked at in
  the least family that both are in, and nowhere else.
* Answer-level skipping.  In a family the answers of one reference set (its overlap with each member) are computed
  first.  One minus the Jaccard similarity is a distance, so they settle every pair whose distances from the
  reference add up to 0.25 at most, or differ by more.  The overlap of any other pair is derived from the reference's two
  answers and the differences: what both members lack of the reference and what both have besides it.

Families are cut into blocks of at most about ``BLOCK`` members, in the order of their sizes; a task holds two blocks at a time.  It
returns one row a member, with its number of links and one neighbour that keeps the block's links connected;
pairs never become rows.  Metadata (sizes, reach) is compared first, and only sets that still have a possible
partner leave their partition.  The work inside a family of m different sets that the answers do not settle grows with
m squared, as the links themselves do.

Which tokens are frequent, and which occur twice, is told by bitmaps of fixed size.  They only order and prefilter:
a bit that another token has set costs work, never a link.

Defined results: a null text or one without words has an empty set and links with nothing; with fewer
than five words the whole sequence is the one shingle; repeated rows give repeated results; rows that share a doc_id
are connected, each row has the size and links of its own text; rows with a null doc_id and equal sets count as one document,
their component is the smallest doc_id that can be reached, null if there is none (doc_ids from 2^62 on are reserved for this);
an empty table gives no rows; columns of other names are ignored.  ``n_links`` is the number of other documents whose
sets link with the row's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bitmaps
from . import kernels as K
from .components import components
from .shared import by_groups, discard, partitions, stored, table

SHINGLE = 5
PERCENT = 75
#: Logarithm of the width of a size class; sets that link differ by less.
WIDE = np.log(3.2)
#: Tokens that a task counts at a time, how often one must occur there to be reported, and in all to be frequent.
COUNTED, REPORTED, FREQUENT = 4_000_000, 2, 8
#: The bitmaps of frequent tokens, of copies and of wanted texts have 2^MAP_BITS bits.
MAP_BITS = 25
#: Members of a block of a family when sizes are compared, and when sets are.
META_BLOCK, BLOCK = 4096, 2048
#: Tokens of a block when sets are compared (a set may have more).
BLOCK_TOKENS = 4_000_000
#: Rows and columns of a matrix of pairs at a time.
TILE = 512
#: Columns of a matrix of differences at a time.
COLUMNS = 4096
#: Keys from here on stand for rows without a doc_id.
NAMELESS = 1 << 62


def set_hashes(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set, as signed numbers."""
    if not len(s):
        return 0, 0
    with np.errstate(over="ignore"):
        return int(K.mix64(s + K.U64(1)).sum().view(np.int64)), int(K.mix64(s ^ K.U64(0x5851F42D4C957F2D)).sum().view(np.int64))


def _key(doc_id: int | None, h1: int) -> int:
    return doc_id if doc_id is not None else NAMELESS | (h1 & (NAMELESS - 1))


_SURVEY = "doc_id long, key long, t1 long, t2 long, h1 long, h2 long, n long, token long"


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row its set's hashes and size (token is null), and counts n of tokens that are not rare where they stand."""
    pending: list[np.ndarray] = []
    held = 0
    names = [x.split()[0] for x in _SURVEY.split(", ")]

    def report() -> pa.RecordBatch:
        found, count = np.unique(np.concatenate(pending), return_counts=True)
        keep = count >= REPORTED
        m = int(keep.sum())
        return pa.RecordBatch.from_arrays([*[pa.nulls(m, pa.int64())] * 6, pa.array(count[keep].astype(np.int64)), pa.array(found[keep].view(np.int64))], names=names)

    for b in batches:
        rows: list[tuple[int, int, int, int]] = []
        for doc_id, s in zip(b.column("doc_id").to_pylist(), K.shingle_sets(b.column("text"), SHINGLE), strict=True):
            h1, h2 = set_hashes(s)
            rows.append((_key(doc_id, h1), h1, h2, len(s)))
            pending.append(s)
            held += len(s)
            if held > COUNTED:
                yield report()
                pending, held = [], 0
        key, h1s, h2s, n = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 4
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), key, b.column("t1"), b.column("t2"), h1s, h2s, n, pa.nulls(len(b), pa.int64())], names=names)
    if pending:
        yield report()


def prefix(tokens: np.ndarray, frequent: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The tokens to index, in the global order, of an ascending set; ``frequent`` is a bitmap over their first bits."""
    n = len(tokens)
    size = n - (percent * n + 99) // 100 + 1
    if n and len(frequent):
        often = bitmaps.among(frequent, tokens)
        if often.any():
            tokens = np.concatenate([tokens[~often], tokens[often]])
    return tokens[:size] if n else tokens


def prefixes(docs: DataFrame, frequent: np.ndarray, repeated: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """(h1, h2, n, tokens) of each distinct set that is not empty; ``repeated`` is a bitmap of the h1 that several documents have."""
    shared = docs.sparkSession.sparkContext.broadcast((frequent, repeated))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, again = shared.value
        for whole in batches:
            for at in range(0, len(whole), 1024):
                rows: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
                for s in K.shingle_sets(whole.column("text").slice(at, 1024), SHINGLE):
                    if len(s) and (h := set_hashes(s)) not in rows:
                        rows[h] = (len(s), prefix(s, often, percent))
                if rows:
                    off = np.zeros(len(rows) + 1, dtype=np.int32)
                    np.cumsum([len(x[1]) for x in rows.values()], out=off[1:])
                    tokens = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate([x[1] for x in rows.values()]).view(np.int64)))
                    h1 = np.array([h[0] for h in rows], dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array([h[1] for h in rows], pa.int64()), pa.array([x[0] for x in rows.values()], pa.int64()), tokens, pa.array(bitmaps.among(again, h1.view(K.U64)))], names=["h1", "h2", "n", "tokens", "again"])

    rows = docs.select("text").mapInArrow(run, "h1 long, h2 long, n long, tokens array<long>, again boolean")
    return rows.where("not again").unionByName(rows.where("again").dropDuplicates(["h1", "h2"])).drop("again")


def _classes(n: np.ndarray) -> np.ndarray:
    """Size class of sets; it never falls as sizes grow."""
    return (np.log(np.maximum(n, 1)) / WIDE).astype(np.int64)


class _Entries:
    """The entries of a batch of prefixes: tokens, rows, reach, and up to two cells of the map of lists, by token and size class.

    Of two sets that may link, the larger one marks the class of the smaller one too, so at each common token of their prefixes
    they share a cell."""

    def __init__(self, b: pa.RecordBatch, percent: int) -> None:
        lists = b.column("tokens")
        self.token = lists.flatten().to_numpy(zero_copy_only=False).view(K.U64)
        off = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        length = np.diff(off)
        self.row = np.repeat(np.arange(len(b)), length)
        at = np.arange(len(self.token)) - np.repeat(off[:-1], length)
        sizes = b.column("n").to_numpy()
        self.n = sizes[self.row]
        # The last entries of a prefix reach smaller sets only; a reach below zero reaches none.
        self.reach = np.maximum((self.n - at) * (100 + percent) // percent - self.n, 0)
        own, low = _classes(sizes), _classes(-(-percent * sizes // 100))
        self.cell = self._cell(own[self.row])
        self.two = (low < own)[self.row]
        self.lower = self._cell(low[self.row[self.two]], self.token[self.two])

    def _cell(self, size_class: np.ndarray, token: np.ndarray | None = None) -> np.ndarray:
        return K.mix64((self.token if token is None else token) ^ (size_class.astype(K.U64) * K.U64(0x9E3779B97F4A7C15)))


def _marks(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (_Entries(b, percent) for b in batches)
        yield from bitmaps.paged(np.concatenate([x.cell, x.lower]) for x in found)

    return run


def entries(rows: DataFrame, lists: np.ndarray, often: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """(token, id, at, often): the index; id is the set's first hash, ``at`` packs its size and its reach, ``often`` tells tokens of possibly long lists."""
    shared = rows.sparkSession.sparkContext.broadcast((lists, often))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, frequent = shared.value
        for b in batches:
            x = _Entries(b, percent)
            keep = bitmaps.among(held, x.cell)
            keep[x.two] |= bitmaps.among(held, x.lower)
            token, row = x.token[keep], x.row[keep]
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(b.column("h1").to_numpy()[row]), pa.array((x.n[keep] << 32) | x.reach[keep]), pa.array(bitmaps.among(frequent, token))], names=["token", "id", "at", "often"])

    return rows.select("h1", "n", "tokens").mapInArrow(run, "token long, id long, at long, often boolean")


def families(index: DataFrame) -> DataFrame:
    """(lead, id, n, t, reach) of each set in each of its families; reach is the largest of its entries there, t the number of all its entries in lists of several sets.

    The lists of rare tokens are dealt once and looked at where they lie; those of frequent ones are summed up before the shuffle and joined, which Spark can split."""
    n, reach = F.shiftright("at", 32), F.col("at").bitwiseAND(F.lit(0xFFFFFFFF))

    def met(own: DataFrame) -> DataFrame:
        lists = own.groupBy("token").agg(F.min("id").alias("lead"), F.max("id").alias("last"), F.min("at").alias("low"), F.max(reach).alias("most")).where("lead < last")
        return own.join(lists.select("token", "lead", F.shiftright("low", 32).alias("least"), "most"), "token")

    rare = met(index.where("not often").select("token", "id", "at").repartition(partitions(index.sparkSession), "token"))
    every = rare.unionByName(met(index.where("often").select("token", "id", "at")))
    fits = F.when((reach >= F.col("least")) & (n <= F.col("most")), reach)
    under = every.groupBy("lead", "id").agg(F.max(n).alias("n"), F.count(F.lit(1)).alias("c"), F.max(fits).alias("reach"))
    return under.withColumn("t", F.sum("c").over(Window.partitionBy("id"))).where("reach is not null").select("lead", "id", "n", "t", "reach")


def in_blocks(members: DataFrame, block: int, tokens: int | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """``members`` (lead, id, n, reach, ...) once for each pair (x, y) of blocks of their family that may hold a link, with ``side``: 0 in x, 1 in y, 0 if both are one;
    and the small tables to discard when that is stored.

    The blocks of a family follow the sizes of its sets; one size with many sets is cut by hash.  Pairs of blocks whose sizes and reach cannot fit are skipped.
    What is known of the families of several blocks is stored before it is joined: as one plan it would be made over and over for each of its uses."""
    weight = F.lit(1.0 / block)
    if tokens:
        weight = F.greatest(weight, F.col("n") / F.lit(float(tokens)))  # of one set, as a share of a block
    share = F.col("c") * weight
    family = Window.partitionBy("lead")
    before = F.sum(share).over(family.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)) - share
    sizes = members.groupBy("lead", "n").agg(F.count(F.lit(1)).alias("c"))
    cuts = sizes.select("lead", "n", F.floor(before).alias("at"), F.greatest(F.lit(1), F.ceil(share)).cast("int").alias("parts"))
    # Families of several blocks only: a member without a row here is in the one block of its family.
    cuts = cuts.withColumn("n_blocks", F.max(F.col("at") + F.col("parts")).over(family)).where("n_blocks > 1")
    cuts = stored(cuts.select("lead", "n", "at", "parts"), "cuts")
    placed = members.join(cuts, ["lead", "n"]).withColumn("block", F.col("at") * (1 << 24) + F.pmod(F.xxhash64("id"), F.col("parts"))).drop("at", "parts")
    bounds = stored(placed.groupBy("lead", "block").agg(F.min("n").alias("small"), F.max("n").alias("big"), F.max("reach").alias("most")), "bounds")
    a, b = [bounds.select("lead", *[F.col(c).alias(f"{c}_{k}") for c in ("block", "small", "big", "most")]) for k in "xy"]
    met = a.join(b, "lead").where("block_x <= block_y and small_x <= most_y and small_y <= most_x").select("lead", F.col("block_x").alias("x"), F.col("block_y").alias("y"))
    # Each block with the pairs it is in: (lead, block, x, y, side); a family of one block has no row here.
    sides = F.when(F.col("x") < F.col("y"), F.array(F.struct(F.col("x").alias("block"), F.lit(0).alias("side")), F.struct(F.col("y").alias("block"), F.lit(1).alias("side")))).otherwise(F.array(F.struct(F.col("x").alias("block"), F.lit(0).alias("side"))))
    places = met.select("lead", "x", "y", F.explode(sides).alias("place")).select("lead", "place.block", "x", "y", "place.side")
    alone = members.join(cuts.select("lead", "n"), ["lead", "n"], "left_anti").withColumns({"x": F.lit(0).cast("long"), "y": F.lit(0).cast("long"), "side": F.lit(0)})
    return alone.unionByName(placed.join(places, ["lead", "block"]).drop("block").select(*alone.columns)), [cuts, bounds]


def _needed(a: np.ndarray, b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For sizes against each other: the overlap of a link, and how many tokens the prefixes of a link share."""
    overlap = -(-percent * (a + b) // (100 + percent))
    room = lambda n: overlap + 1 - (percent * n + 99) // 100  # noqa: E731  prefix length less the tokens that may stand before a common one
    return overlap, np.maximum(1, np.minimum(room(a), room(b)))


def _possible(n: np.ndarray, t: np.ndarray, rows: slice, cols: slice, percent: int) -> np.ndarray:
    """Pairs that size and number of entries allow to link."""
    a, b = n[rows][:, None], n[cols][None, :]
    _, shared = _needed(a, b, percent)
    return (100 * a >= percent * b) & (100 * b >= percent * a) & (shared <= np.minimum(t[rows][:, None], t[cols][None, :]))


def _partners(percent: int):
    """Members that have a possible partner in their pair of blocks."""

    def run(group: pa.Table) -> pa.Table:
        if len(group) < 2:
            return group.slice(0, 0).select(["lead", "id", "n", "t"])
        n, t, reach, side = [group.column(c).to_numpy() for c in ("n", "t", "reach", "side")]
        order = np.lexsort((n, side))
        n, t, reach = n[order], t[order], reach[order]
        cut = int((side == 0).sum())
        has = np.zeros(len(n), dtype=bool)
        rows, cols = (0, cut), ((cut, len(n)) if cut < len(n) else (0, cut))
        step = 512
        for i in range(rows[0], rows[1], step):
            a = slice(i, min(i + step, rows[1]))
            for j in range(cols[0], cols[1], step):
                b = slice(j, min(j + step, cols[1]))
                if cut == len(n) and j < i or n[a].min() > reach[b].max() or n[b].min() > reach[a].max():
                    continue  # block skipping by size and reach
                ok = _possible(n, t, a, b, percent) & (n[a][:, None] <= reach[b][None, :]) & (n[b][None, :] <= reach[a][:, None])
                if cut == len(n) and i == j:
                    np.fill_diagonal(ok, False)
                has[a] |= ok.any(1)
                has[b] |= ok.any(0)
        return group.select(["lead", "id", "n", "t"]).take(pa.array(order[has]))

    return run


def _sets(wanted):
    """(h1, h2, key, n, tokens) of the rows whose hash is in the broadcast bitmap; one of equal sets of a batch, with the smallest key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        for whole in batches:
            b = whole.filter(pa.array(bitmaps.among(wanted.value, whole.column("row").to_numpy().view(K.U64))))
            for at in range(0, len(b), 1024):
                part = b.slice(at, 1024)
                rows: dict[tuple[int, int], tuple] = {}
                for doc_id, s in zip(part.column("doc_id").to_pylist(), K.shingle_sets(part.column("text"), SHINGLE), strict=True):
                    h = set_hashes(s)
                    key = _key(doc_id, h[0])
                    if h not in rows or key < rows[h][2]:
                        rows[h] = (*h, key, len(s), _packed(s))
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows.values(), strict=True), kinds, strict=True)], names=["h1", "h2", "key", "n", "tokens"])

    return run


def _packed(tokens: np.ndarray) -> bytes:
    """The first 56 bits of each token, seven bytes each: what sets are shipped as."""
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 1:]).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 7, 8), dtype=np.uint8)
    out[:, 1:] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 7)
    return out.reshape(-1).view("<u8").astype(K.U64, copy=False)


def _gram(rows: np.ndarray, cols: np.ndarray, n_rows: int, cut: int) -> np.ndarray:
    """How many columns each of the first ``cut`` rows shares with each of the others (of all, if cut is n_rows): a sum of matrix products over strips of columns."""
    out = np.zeros((cut, n_rows - cut if cut < n_rows else n_rows), dtype=np.float64)
    if not len(cols):  # members that have nothing besides the reference
        return out
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    first = np.flatnonzero(np.concatenate([[True], cols[1:] != cols[:-1]]))
    length = np.diff(np.append(first, len(cols)))
    several = np.repeat(length > 1, length)  # a column of one row is shared by none
    rows, cols = rows[several], cols[several]
    number = np.cumsum(np.concatenate([[True], cols[1:] != cols[:-1]])) - 1 if len(cols) else cols
    ends = np.searchsorted(number, np.arange(0, (number[-1] + 1 if len(number) else 0) + COLUMNS, COLUMNS))
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        strip = np.zeros((n_rows, int(number[b - 1] - number[a]) + 1), dtype=np.float32)
        strip[rows[a:b], number[a:b] - number[a]] = 1
        out += strip[:cut] @ (strip[cut:] if cut < n_rows else strip).T
    return out


class _Family:
    """The members of a pair of blocks, their sets' overlaps with one reference set, and what is left of each set besides it."""

    def __init__(self, n: np.ndarray, tokens: np.ndarray, ref: np.ndarray) -> None:
        self.n, self.ref = n, ref
        self.off = np.zeros(len(n) + 1, dtype=np.int64)
        np.cumsum(n, out=self.off[1:])
        self.place = np.minimum(np.searchsorted(ref, tokens), len(ref) - 1).astype(np.int32)
        self.common = ref[self.place] == tokens
        self.tokens = tokens
        self.answer = np.add.reduceat(self.common, self.off[:-1], dtype=np.int64)
        self.far = 1.0 - self.answer / (n + len(ref) - self.answer)

    def overlaps(self, a: np.ndarray, b: np.ndarray, one: bool) -> np.ndarray:
        """|A & B| for members ``a`` against members ``b`` (the same ones if ``one``).

        That is what they share of the reference, and of the rest.  The first part is |A & R| + |B & R| - |R| + |both lack of R| where the
        members are similar to the reference, and counted as it is where they lack more of it than they have."""
        who = a if one else np.concatenate([a, b])
        at = np.concatenate([np.arange(self.off[i], self.off[i + 1]) for i in who])
        owner = np.repeat(np.arange(len(who)), self.n[who])
        common, place = self.common[at], self.place[at]
        cut = len(a)
        if 2 * common.sum() >= len(who) * len(self.ref):
            seen = np.zeros((len(who), len(self.ref)), dtype=bool)
            seen[owner[common], place[common]] = True
            lacking, missed = np.nonzero(~seen)
            both = self.answer[a][:, None] + self.answer[who if one else b][None, :] - len(self.ref) + _gram(lacking, missed, len(who), cut)
        else:
            both = _gram(owner[common], place[common], len(who), cut)
        return both + _gram(owner[~common], self.tokens[at][~common], len(who), cut)


def _links(percent: int, tile: int = TILE):
    """(id, h1, links, other): what the members of a pair of blocks find there; ``other`` keeps the links of the pair connected."""
    reach = (100 - percent) / 100

    def run(group: pa.Table) -> pa.Table:
        lead, m = group.column("lead")[0].as_py(), len(group)
        order = np.lexsort((group.column("n").to_numpy(), group.column("side").to_numpy()))
        side, key, h1, n, t, w = [group.column(c).to_numpy()[order] for c in ("side", "key", "id", "n", "t", "w")]
        cut = int((side == 0).sum())
        links, label = np.zeros(m, dtype=np.int64), key.copy()
        found: list[tuple[np.ndarray, np.ndarray]] = []
        if m > 1:
            data = group.column("tokens").take(pa.array(order)).combine_chunks()
            tokens = _unpacked(b"".join([x.as_buffer() for x in data]))
            # Pairs that are both in a family before this one are looked at there.
            leads = [np.array(x, dtype=np.int64) for x in group.column("leads").take(pa.array(order)).to_pylist()]
            earlier = [x[x < lead] for x in leads]
            # The answers of a reference set: the family's leader if it is here, else the first member.
            at = np.flatnonzero(h1 == lead)
            at = int(at[0]) if len(at) else 0
            begin = int(n[:at].sum())
            family = _Family(n, tokens, tokens[begin : begin + int(n[at])])
            last = m if cut == m else cut
            for i in range(0, last, tile):
                rows = slice(i, min(i + tile, last))
                for j in range(i, m, tile) if cut == m else range(cut, m, tile):
                    cols = slice(j, min(j + tile, m))
                    one = rows == cols
                    open_ = _possible(n, t, rows, cols, percent) & (key[rows][:, None] != key[cols][None, :])
                    if one:
                        open_ = np.triu(open_, 1)
                    if not open_.any():
                        continue
                    if any(len(earlier[x]) for x in range(rows.start, rows.stop)):
                        who = [*range(rows.start, rows.stop), *(() if one else range(cols.start, cols.stop))]
                        own = [earlier[x] for x in who]
                        open_ &= _gram(np.repeat(np.arange(len(who)), [len(x) for x in own]), np.concatenate(own), len(who), rows.stop - rows.start) == 0
                    fa, fb = family.far[rows][:, None], family.far[cols][None, :]
                    linked = open_ & (fa + fb <= reach - 1e-9)
                    rest = open_ & ~linked & (np.abs(fa - fb) <= reach + 1e-9)
                    if rest.any():
                        a, b = np.flatnonzero(rest.any(1)), np.flatnonzero(rest.any(0))
                        if one:
                            a = b = np.union1d(a, b)
                        both = family.overlaps(a + rows.start, b + cols.start, one)
                        near = (100 + percent) * both >= percent * (n[rows][a][:, None] + n[cols][b][None, :])
                        linked[np.ix_(a, b)] |= rest[np.ix_(a, b)] & near & (both > 0)
                    if linked.any():
                        links[rows] += linked @ w[cols]
                        links[cols] += linked.T @ w[rows]
                        x, y = np.nonzero(linked)
                        found.append(_forest(x + rows.start, y + cols.start, key))
        if found:
            x, y = [np.concatenate(p) for p in zip(*found, strict=True)]
            while True:  # labels fall until they stand
                before = label.copy()
                np.minimum.at(label, x, before[y])
                np.minimum.at(label, y, before[x])
                if np.array_equal(before, label):
                    break
        got = links > 0
        return pa.table({"id": pa.array(key[got]), "h1": pa.array(h1[got]), "links": pa.array(links[got]), "other": pa.array(label[got])})

    return run


def _forest(x: np.ndarray, y: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most as many links as there are ends, with the same components: each end with the least key that it is connected to."""
    ends, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    ends = ends[np.argsort(key[ends], kind="stable")] if len(ends) else ends
    rank = np.empty(int(max(x.max(), y.max())) + 1, dtype=np.int64)
    rank[ends] = np.arange(len(ends))
    p, q = rank[x], rank[y]
    label = np.arange(len(ends))
    while True:
        before = label.copy()
        np.minimum.at(label, p, before[q])
        np.minimum.at(label, q, before[p])
        label = label[label]
        if np.array_equal(before, label):
            return ends, ends[label]


def join(docs: DataFrame, percent: int = PERCENT, block: int = BLOCK, meta_block: int = META_BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, n_shingles, component_id, n_links, and t1, t2, label: hashes of the text and the component with those of
    rows without a doc_id); links (a, b) between class representatives that connect what links; (key, node) of rows that have a copy."""
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    survey = stored(keyed.select("doc_id", "text", F.xxhash64("text").alias("t1"), F.xxhash64("text", F.lit(7)).alias("t2")).mapInArrow(_survey, _SURVEY), "survey")
    sizes = survey.where("token is null").drop("token")
    # Equal sets: one node, the smallest key; w documents have it.
    named = sizes.where("n > 0").select("key", "h1", "h2").distinct()
    same = stored(named.groupBy("h1", "h2").agg(F.min("key").alias("node"), F.count(F.lit(1)).alias("w")).where("w > 1"), "same")

    often = survey.where("token is not null").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    frequent = bitmaps.bitmap(often, "token", MAP_BITS)
    rows = stored(prefixes(keyed, frequent, bitmaps.bitmap(same, "h1", MAP_BITS), percent), "prefixes")
    index = entries(rows, bitmaps.twice(rows.select("n", "tokens").mapInArrow(_marks(percent), bitmaps.PAGED)), frequent, percent)
    under = stored(families(index), "families")
    discard(rows)
    # Sizes and reach first: only members with a possible partner go on.
    blocks, small = in_blocks(under, meta_block)
    met = by_groups(blocks, ["lead", "x", "y"], _partners(percent), "lead long, id long, n long, t long")
    chosen = stored(met.distinct(), "chosen")
    discard(under, *small)
    # One row of each chosen set is read again: that of its node.
    texts = sizes.where("n > 0").join(chosen.select(F.col("id").alias("h1")).distinct(), "h1", "left_semi").join(same.select("h1", "h2", "node"), ["h1", "h2"], "left").where("node is null or node = key")
    wanted = spark.sparkContext.broadcast(bitmaps.bitmap(texts.select(F.xxhash64("t1", "doc_id").alias("row")), "row", MAP_BITS))
    found = keyed.withColumn("row", F.xxhash64(F.xxhash64("text"), "doc_id")).mapInArrow(_sets(wanted), "h1 long, h2 long, key long, n long, tokens binary")
    # Grouped by the hash that the join is on, so that the sets are dealt once.
    sets = found.groupBy("h1").agg(F.min("key").alias("key"), F.first("tokens").alias("tokens"))
    leads = chosen.groupBy("id").agg(F.collect_list("lead").alias("leads"))
    blocks, small = in_blocks(chosen.withColumn("reach", F.floor(100 * F.col("n") / percent)), block, BLOCK_TOKENS)
    places = blocks.groupBy("id").agg(F.collect_list(F.struct("lead", "x", "y", "side", "n", "t")).alias("places")).join(leads, "id")
    weights = same.select(F.col("h1").alias("id"), F.col("w").alias("copies"))
    places = places.join(weights, "id", "left").withColumn("w", F.coalesce("copies", F.lit(1)).cast("long")).drop("copies")
    ready = sets.withColumnRenamed("h1", "id").join(places, "id").select("id", "key", "w", "leads", "tokens", F.explode("places").alias("place")).select("id", "key", "w", "leads", "tokens", "place.*")
    answers = stored(by_groups(ready, ["lead", "x", "y"], _links(percent), "id long, h1 long, links long, other long"), "answers")
    discard(*small)
    edges = answers.where("id <> other").select(F.col("id").alias("a"), F.col("other").alias("b"))
    # Rows that share a doc_id but not the set connect their nodes.
    several = named.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    twins = stored(named.join(several, "key", "left_semi").join(same, ["h1", "h2"], "left").select("h1", "h2", "key", F.coalesce("node", "key").alias("node"), F.coalesce("w", F.lit(1)).alias("w")), "several")
    edges = edges.unionByName(twins.where("key <> node").select(F.col("key").alias("a"), F.col("node").alias("b")))
    labels = components(edges)
    links = answers.groupBy(F.col("id").alias("node"), "h1").agg(F.sum("links").alias("links"))
    # What is known of a set that links, has a copy, or belongs to a doc_id with several.
    nodes = answers.select("h1", "id").distinct().join(survey.where("token is null").select("h1", "h2").distinct(), "h1").select("h1", "h2", F.col("id").alias("node"), F.lit(1).cast("long").alias("w"))
    nodes = nodes.unionByName(same.select("h1", "h2", "node", "w")).unionByName(twins.select("h1", "h2", "node", "w")).groupBy("h1", "h2").agg(F.min("node").alias("node"), F.max("w").alias("w"))
    verdict = stored(nodes.join(labels, "node", "left").join(links, ["node", "h1"], "left").select("h1", "h2", F.coalesce("component", "node").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links")), "verdict")
    copies = sizes.join(same.select("h1", "h2", "node"), ["h1", "h2"]).select("key", "node").distinct()
    discard(chosen, answers, twins)
    out = sizes.join(verdict, ["h1", "h2"], "left").withColumn("label", F.coalesce("label", "key"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("label") < NAMELESS, F.col("label")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "t1", "t2", "label")
    return out, labels.select(F.col("node").alias("a"), F.col("component").alias("b")), copies


def op10_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents").select("doc_id", "text"))[0].select("doc_id", "n_shingles", "component_id", "n_links")


def stage_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group stays, that of the smallest doc_id; rows that share a doc_id stay together.

    Of a group without any doc_id the row of the least text hash stays; columns of any other name are kept as they are."""
    rows, _, _ = join(docs.select("doc_id", "text"))
    gone = rows.where("component_id <> doc_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(gone, "doc_id", "left_anti").select(*docs.columns)
    lost = rows.where("doc_id is null and n_shingles > 0").select(F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), F.col("label").alias("_label")).distinct()
    nameless = docs.where("doc_id is null").withColumns({"_t1": F.xxhash64(F.coalesce("text", F.lit(""))), "_t2": F.xxhash64(F.coalesce("text", F.lit("")), F.lit(7))})
    judged = nameless.join(lost, ["_t1", "_t2"], "left")
    every = F.struct("_t1", "_t2", *[F.col(f"`{c}`") for c in docs.columns])
    first = judged.where(F.col("_label") >= NAMELESS).groupBy("_label").agg(F.min(every).alias("row")).select("row.*").drop("_t1", "_t2")
    return named.unionByName(judged.where("_label is null").select(*docs.columns)).unionByName(first.select(*docs.columns))
