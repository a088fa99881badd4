"""Near duplicates by Order MinHash, verified by banded alignment.

Texts with the same words are one class from the start and take part once. Each distinct text has
``SKETCHES`` sketches: the ``PICKS`` least of its five-word shingles under one hash function, each
labelled by its occurrence number, hashed in the order in which they stand in the text. Short texts
have their least shingles themselves instead, as many as every linked pair must share one of. Texts
that share a sketch or such a shingle meet in a bucket. Texts too many of whose shingles no other text
of any bucket has fall out: that settles texts that share a passage and nothing more.

The pairs of a bucket are settled without forming them all, however many texts it holds:

1. Every text is compared with one centre, the heaviest of its buckets' centres. Links give components.
2. Each bucket whose members are in several components gets the heaviest text of its centre's component
   as hub, and each member is compared with it. A galaxy is all that have one hub.
3. Two members of a galaxy that are not both linked to the hub can only be linked to each other if they
   differ from the hub in the same shingles, in a number that follows from both distances (see
   :func:`sharing`). An index over the rarest of these differences finds all such pairs.

Two texts are linked when the multiset similarity of their five-word shingles is at least 0.8 and
an alignment of their words, in a band that this similarity allows, keeps at least 0.8 of them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewell.llm.common import gather, sliced, stored, table
from tidewell.llm.components import components
from tidewell.llm.units import split_units, strings

SHINGLE, SIMILARITY = 5, 0.8
SKETCHES, PICKS = 32, 5
#: Texts of fewer shingles are found by their least shingles instead of sketches.
SHORT = 40
#: Shingles that only one of two texts of similarity ``SIMILARITY`` has, as a share of both their numbers.
APART = (1 - SIMILARITY) / (1 + SIMILARITY)
#: Keys or row numbers that may be broadcast (24 MB); beyond it they are joined by shuffle.
BROADCAST_KEYS = 500_000
#: Most cells of the table of shared shingles, as a power of two (two bits each), and bytes in a block of it.
CELL_BITS, CELL_BLOCK = 25, 2048

_WORD = re.compile(r"\w+")
_FACTORS = np.random.default_rng(23).integers(1, 2**63, (2, SKETCHES), dtype=np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def word_arrays(texts: pa.Array) -> list[np.ndarray]:
    """64-bit hashes of the lower-case words of each text."""
    units, counts = split_units(texts)
    found = [_WORD.findall(u.lower()) for u in strings(units.dictionary)]
    n = np.fromiter(map(len, found), np.int64, len(found))
    hashes = np.frombuffer(b"".join(hashlib.blake2b(w.encode(), digest_size=8).digest() for f in found for w in f), "<u8")
    use = units.indices.to_numpy()
    flat = gather(hashes, (np.cumsum(n) - n)[use], n[use])
    ends = np.concatenate([[0], np.cumsum(n[use])])[np.concatenate([[0], np.cumsum(counts)])]
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def shingles(words: np.ndarray) -> np.ndarray:
    """64-bit hashes of all runs of five words, or of all words of a shorter text; a repeated one is mixed with the
    number of its earlier occurrences."""
    width = min(SHINGLE, len(words))
    if not width:
        return np.zeros(0, np.uint64)
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = out * _P + words[i : i + n].astype(np.uint64) + np.uint64(1)
    out = _mix(out)
    order = np.argsort(out, kind="stable")
    same = out[order][1:] == out[order][:-1]
    if same.any():
        first = np.concatenate([[0], np.flatnonzero(~same) + 1])
        number = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
        again = order[number > 0]
        out[again] = _mix(out[again] + number[number > 0].astype(np.uint64) * _P)
    return out


def sketch(labelled: np.ndarray) -> np.ndarray:
    """The sketches of one text's labelled shingles."""
    hashed = _mix((labelled[None, :] ^ _FACTORS[0][:, None]) * _FACTORS[1][:, None])
    rows = np.arange(SKETCHES)
    picks = []
    for _ in range(min(PICKS, len(labelled))):
        at = hashed.argmin(1)
        picks.append(at)
        hashed[rows, at] = np.uint64(0xFFFFFFFFFFFFFFFF)
    places = np.sort(np.stack(picks, 1), 1)
    out = rows.astype(np.uint64) * _P
    for i in range(places.shape[1]):
        out = _mix(out * _P + labelled[places[:, i]])
    return out.view(np.int64)


def prefix(labelled: np.ndarray) -> np.ndarray:
    """The least shingles of one text, so many that two texts of at least ``SIMILARITY`` share one of them.

    The text has k = ceil(0.8 n) shingles in common with any such other one, so the least common one is
    among its n - k + 1 least, and likewise in the other text.
    """
    n = len(labelled)
    least = np.sort(labelled)[: n - int(np.ceil(SIMILARITY * n - 1e-9)) + 1]
    return _mix(least * _P + np.uint64(SKETCHES)).view(np.int64)


def buckets(labelled: np.ndarray) -> np.ndarray:
    """The buckets of one text. One of fewer than ``SHORT`` shingles can only be linked to such of fewer than
    ``SHORT / SIMILARITY``, and both have prefixes."""
    n = len(labelled)
    parts = [np.zeros(0, np.int64)]
    if 0 < n < SHORT / SIMILARITY:
        parts.append(prefix(labelled))
    if n >= SHORT:
        parts.append(sketch(labelled))
    return np.concatenate(parts)


def shingle_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Multiset Jaccard similarity of two texts' labelled shingles."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    total = len(a) + len(b) - shared
    return shared / total if total else 1.0


def aligned(a: list[int], b: list[int], least: float) -> float:
    """Share of the words of both texts that a best alignment keeps, or 0 where it is below ``least``.

    Furthest-reaching paths of insertions and deletions; the band is the number of them that
    ``least`` allows.
    """
    total = len(a) + len(b)
    if not total:
        return 1.0
    band = int((1 - least) * total + 1e-9)
    start = 0
    short = min(len(a), len(b))
    while start < short and a[start] == b[start]:
        start += 1
    end = 0
    while end < short - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    n, m = len(a), len(b)
    if abs(n - m) > band:
        return 0.0
    reach = {1: 0}
    for edits in range(band + 1):
        for k in range(-edits, edits + 1, 2):
            if k > n or -k > m:
                continue
            down, right = reach.get(k + 1, -1), reach.get(k - 1, -2) + 1
            x = max(down, right)
            if x < 0 or x > n or x - k > m or x - k < 0:
                continue
            while x < n and x - k < m and a[x] == b[x - k]:
                x += 1
            reach[k] = x
            if x == n and x - k == m:
                return 1 - edits / total
    return 0.0


_SKETCHED = "deal long, key binary, n int, sketches array<long>, words binary"


def sketched(df: DataFrame, text_col: str, columns: list[str]) -> DataFrame:
    """``columns`` of every row as a struct ``row``, with a row number, the digest of its words, the number of its
    shingles, its buckets as ``sketches`` and its words. A text without words has the digest of its stripped self; a null counts
    as empty."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in sliced(batches):
            column = batch.column(1)
            keys, ns, sketches, blobs = [], [], [], []
            for i, words in enumerate(word_arrays(column)):
                raw = words.tobytes()
                keys.append(hashlib.blake2b(raw or (column[i].as_py() or "").strip().encode(), digest_size=16, key=b"" if raw else b"bare").digest())
                words = words.astype(np.uint32)  # what verification reads
                labelled = shingles(words)
                ns.append(len(labelled))
                sketches.append(buckets(labelled))
                blobs.append(words.tobytes())
            n = batch.num_rows
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sketches)]), pa.int32()), pa.array(np.concatenate(sketches)))
            columns_out = [batch.column(0), pa.array(np.arange(row, row + n)), pa.array(keys, pa.binary()), pa.array(ns, pa.int32()), lists, pa.array(blobs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns_out, ["row", "deal", "key", "n", "sketches", "words"])
            row += n

    chosen = df.select(F.struct(*columns).alias("row"), F.col(text_col).cast("string").alias("text"))
    schema = StructType([*chosen.select("row").schema.fields, *StructType.fromDDL(_SKETCHED).fields])
    return stored(chosen.mapInArrow(rows, schema), "near-sketches")


def _with_words(pairs: DataFrame, words: DataFrame, a: str, b: str) -> DataFrame:
    of = lambda side: words.select(F.col("key").alias(side), F.col("words").alias(f"words_{side}"))
    return pairs.join(of(a), a).join(of(b), b).select(a, b, f"words_{a}", f"words_{b}")


def _word_pairs(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Words and shingles of both texts of each row of (a, b, words of a, words of b)."""
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for *keys, raw_a, raw_b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
        for key, raw in zip(keys, (raw_a, raw_b), strict=True):
            if key not in known:
                words = np.frombuffer(raw.as_buffer(), "<u4")
                known[key] = words, shingles(words)
        yield *known[keys[0]], *known[keys[1]]


def verify(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The pairs (a, b) of texts that are linked."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            linked = [shingle_similarity(x, y) >= SIMILARITY and aligned(a.tolist(), b.tolist(), SIMILARITY) > 0 for a, x, b, y in _word_pairs(batch)]
            yield batch.select([0, 1]).filter(pa.array(linked, pa.bool_()))

    return _with_words(pairs, words, "a", "b").mapInArrow(compare, "a long, b long")


def differences(galaxies: DataFrame, words: DataFrame) -> DataFrame:
    """Of members (hub, key) of galaxies: ``n`` of the member and ``n_hub``, whether the two are ``linked``, and ``cells``,
    the shingles that one of the two texts has and the other has not, each mixed with the hub."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            n, n_hub, linked, cells = [], [], [], [np.zeros(0, np.uint64)]
            for hub, (a, x, b, y) in zip(batch.column(0).to_pylist(), _word_pairs(batch), strict=True):
                apart = np.setxor1d(x, y, assume_unique=True)
                n.append(len(y))
                n_hub.append(len(x))
                linked.append(len(apart) <= APART * (len(x) + len(y)) + 1e-9 and aligned(a.tolist(), b.tolist(), SIMILARITY) > 0)
                cells.append(_mix(apart * _P + np.uint64(hub)))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, cells[1:])]), pa.int32()), pa.array(np.concatenate(cells).view(np.int64)))
            columns = [batch.column(0), batch.column(1), pa.array(n, pa.int32()), pa.array(n_hub, pa.int32()), pa.array(linked, pa.bool_()), lists]
            yield pa.RecordBatch.from_arrays(columns, ["hub", "key", "n", "n_hub", "linked", "cells"])

    return _with_words(galaxies, words, "hub", "key").mapInArrow(compare, "hub long, key long, n int, n_hub int, linked boolean, cells array<long>")


def shared_shingles(words: DataFrame, n_shingles: int) -> DataFrame:
    """(key, shared): how many shingles of each text other texts of the table may have as well, at least as many
    as they do have.

    Shingles fall into a table of cells of bounded size that remembers what one and what several
    texts have; two shingles in one cell only raise the count. Tasks send their cells in blocks,
    blocks are merged as they stream in, and the driver gathers two bits a cell.
    """
    bits = min(max(16, (4 * n_shingles).bit_length()), CELL_BITS)
    mask = np.uint64((1 << bits) - 1)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, more = np.zeros(1 << bits, bool), np.zeros(1 << bits, bool)
        for batch in batches:
            for raw in batch.column(0):
                at = (shingles(np.frombuffer(raw.as_buffer(), "<u4")) & mask).astype(np.int64)
                more[at[one[at]]] = True
                one[at] = True
        packed = [np.packbits(x).reshape(-1, CELL_BLOCK) for x in (one, more)]
        used = np.flatnonzero(packed[0].any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array([p[i].tobytes() for i in used], pa.binary()) for p in packed)], ["block", "one", "more"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for block, one, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one, more = np.frombuffer(one, np.uint8), np.frombuffer(more, np.uint8)
                if block in known:
                    one_before, more_before = known[block]
                    one, more = one | one_before, more | more_before | (one & one_before)
                known[block] = one, more
        yield pa.RecordBatch.from_arrays([pa.array(list(known), pa.int32()), *(pa.array([v[i].tobytes() for v in known.values()], pa.binary()) for i in (0, 1))], ["block", "one", "more"])

    schema = "block int, one binary, more binary"
    n_blocks = (1 << bits) // 8 // CELL_BLOCK
    several = np.zeros((n_blocks, CELL_BLOCK), np.uint8)
    for block, raw in words.select("words").mapInArrow(cells, schema).repartition(min(64, n_blocks), "block").mapInArrow(merge, schema).select("block", "more").collect():
        several[block] = np.frombuffer(raw, np.uint8)
    table_of = words.sparkSession.sparkContext.broadcast(several.ravel())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = table_of.value
        for batch in batches:
            n = []
            for raw in batch.column(1):
                at = (shingles(np.frombuffer(raw.as_buffer(), "<u4")) & mask).astype(np.int64)
                n.append(int((packed[at >> 3] >> (7 - (at & 7)) & 1).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32())], ["key", "shared"])

    counted = stored(words.select("key", "words").mapInArrow(count, "key long, shared int"), "near-shared")
    table_of.destroy()
    return counted


def pruned(members: DataFrame, words: DataFrame) -> DataFrame:
    """Members of buckets without those that can be linked to no other member.

    Two texts with n and m shingles need 0.8 / 1.8 * (n + m) in common. A text's shingles that no
    other open text has are in common with none, and m is at least the least of the bucket and 0.8 n.
    """
    texts = members.select("key", "n").distinct()
    n_texts, n_shingles = texts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    keys = texts.select("key")
    open_words = words.join(F.broadcast(keys) if n_texts <= BROADCAST_KEYS else keys, "key", "left_semi")
    shared = shared_shingles(open_words, int(n_shingles))
    least = members.groupBy("bucket").agg(F.min("n").alias("least"))
    needed = SIMILARITY / (1 + SIMILARITY) * (F.col("n") + F.greatest(F.col("least").cast("double"), SIMILARITY * F.col("n")))
    return members.join(shared, "key").join(least, "bucket").where(F.col("shared") >= needed - 1e-6).drop("shared", "least")


def _close(n: str, m: str) -> Column:
    return F.least(n, m) >= SIMILARITY * F.greatest(n, m) - 1e-9


def _rooted(df: DataFrame, roots: DataFrame, node: str, root: str) -> DataFrame:
    """``df`` with the component of ``node``; a text without links is its own."""
    return df.join(roots.select(F.col("node").alias(node), F.col("root").alias(root)), node, "left").withColumn(root, F.coalesce(root, node))


def _in_several(df: DataFrame, group: str) -> DataFrame:
    """The groups that have members in several components."""
    return df.groupBy(group).agg(F.min("root").alias("one"), F.max("root").alias("other")).where("one <> other").select(group)


def sharing(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of members of a galaxy in different components that can be linked and are not both as near
    to the hub as linked texts are.

    Let D be the shingles in which a text differs from its hub, and f = \\|D\\| - APART * (n - n_hub), which is
    never negative; a text is as near as linked ones are where e = f - 2 * APART * n_hub is at most 0. Two
    texts have 0.8 similarity only if they have (e_a + f_b) / 2 of their differences in common. Differences
    are put in order, the most common of the galaxy last; if the first one that both texts have is the r-th
    from the end for one of them, at most r are common. A text's differences are therefore indexed only as
    long as the rest behind them suffices for any partner, and a partner must have
    f >= e - 2 * APART * (its n - n_hub) so that its differences suffice as well.
    """
    f = F.size("cells") - APART * (F.col("n") - F.col("n_hub"))
    e = F.col("f") - 2 * APART * F.col("n_hub")
    partner = F.greatest(F.lit(0.0), F.col("e") - 2 * APART * F.greatest(F.lit(0.0), F.col("n") / SIMILARITY - F.col("n_hub")))
    measured = members.withColumn("f", f).withColumn("e", e)
    # e is a multiple of a ninth of a shingle, so that no partner outside has less than a tenth
    cells = stored(measured.select("hub", "key", F.when(F.col("e") > 1e-6, F.col("e") + partner).otherwise(F.col("f") + 0.1).alias("least"), F.explode("cells").alias("cell")), "near-cells")
    common = cells.groupBy("cell").agg(F.count("*").alias("texts")).where("texts > 1")
    behind = F.row_number().over(Window.partitionBy("hub", "key").orderBy(F.desc("texts"), F.desc("cell")))
    index = cells.join(common, "cell").withColumn("behind", behind).where(2 * F.col("behind") >= F.col("least") - 1e-6).select("hub", "key", "cell", "behind")
    index = stored(index.join(measured.select("hub", "key", "n", "e", "f", "root"), ["hub", "key"]).drop("hub"), "near-index")
    side = lambda end: index.select("cell", *(F.col(c).alias(f"{c}_{end}") for c in ("key", "n", "e", "f", "root", "behind")))
    suffices = F.col("e_a") + F.col("f_b") <= 2 * F.least("behind_a", "behind_b") + 1e-6
    once = (F.col("e_b") <= 1e-6) | (F.col("key_a") < F.col("key_b"))
    met = side("a").where("e_a > 1e-6").join(side("b"), "cell").where((F.col("root_a") != F.col("root_b")) & _close("n_a", "n_b") & suffices & once)
    return met.select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b")).distinct()


def links(sketches: DataFrame) -> DataFrame:
    """Links (a, b) between distinct texts, each named by the least number of its rows, that connect all that are linked."""
    texts = sketches.where("n > 0").groupBy(F.col("key").alias("digest")).agg(F.min("deal").alias("key"), F.first("n").alias("n"), F.first("sketches").alias("sketches"))
    members = texts.select("key", "n", F.explode("sketches").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    met = stored(members.join(shared, "bucket"), "near-members")
    weights = stored(met.groupBy("key").agg(F.sum("size").alias("weight")), "near-weights")
    candidates = F.broadcast(weights.select("key")) if weights.count() <= BROADCAST_KEYS else weights.select("key")
    words = stored(sketches.select(F.col("deal").alias("key"), "words").join(candidates, "key", "left_semi"), "near-words")
    members = stored(pruned(met.join(weights, "key").select("bucket", "key", "n", "weight"), words), "near-members")

    heaviest = F.max_by(F.struct(F.col("key").alias("centre"), F.col("n").alias("n_centre"), F.col("weight").alias("weight_centre")), F.struct("weight", "key")).alias("centre")
    members = stored(members.join(members.groupBy("bucket").agg(heaviest).select("bucket", "centre.*"), "bucket"), "near-members")
    to_centre = members.where((F.col("key") != F.col("centre")) & _close("n", "n_centre")).groupBy("key").agg(F.max_by("centre", F.struct("weight_centre", "centre")).alias("centre"))
    found = stored(verify(to_centre.select(F.col("key").alias("a"), F.col("centre").alias("b")), words), "near-links")
    roots = components(found)

    members = _rooted(members, roots, "key", "root")
    members = _rooted(members.join(_in_several(members, "bucket"), "bucket"), roots, "centre", "root_centre")
    hubs = weights.join(roots.withColumnRenamed("node", "key"), "key").groupBy(F.col("root").alias("root_centre")).agg(F.max_by("key", F.struct("weight", "key")).alias("hub"))
    members = stored(members.join(hubs, "root_centre", "left").select("bucket", F.coalesce("hub", "centre").alias("hub"), "key", "n").where("key <> hub"), "near-members")
    stars = stored(differences(members.select("hub", "key").distinct(), words), "near-stars")
    found = stored(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(stars.where("linked").select(F.col("hub").alias("a"), F.col("key").alias("b"))), "near-links")
    roots = components(found)

    rooted = _rooted(stars, roots, "key", "root")
    rooted = stored(rooted.join(_in_several(rooted, "hub"), "hub"), "near-stars")
    pairs = sharing(rooted)
    # texts that are near a hub but not aligned with it meet all others of that kind in their buckets
    near = rooted.where(F.size("cells") <= APART * (F.col("n") + F.col("n_hub")) + 1e-6).select("hub", "key", "root", "linked")
    meeting = members.select("bucket", "hub", "key").join(near, ["hub", "key"])
    other = meeting.select("bucket", "hub", F.col("key").alias("other"), F.col("root").alias("root_other"))
    twisted = meeting.where("not linked").join(other, ["bucket", "hub"]).where("root <> root_other").select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b"))
    return found.unionByName(stored(verify(pairs.unionByName(twisted).distinct(), words), "near-links"))


def classes(sketches: DataFrame, id_col: str) -> DataFrame:
    """(deal, doc_id, class_id, class_size, kept) of every row: its class has the least id of all its members, and
    the first row with that id is kept."""
    roots = components(links(sketches))
    texts = sketches.groupBy("key").agg(F.min("deal").alias("node")).join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("root"))
    rows = sketches.select("deal", F.col("row")[id_col].cast("long").alias("doc_id"), "key").join(texts, "key")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "deal")).alias("first")
    whole = rows.groupBy("root").agg(first, F.count("*").alias("class_size"))
    return rows.join(whole, "root").select("deal", "doc_id", F.col("first.doc_id").alias("class_id"), "class_size", (F.col("deal") == F.col("first.deal")).alias("kept"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, class_size, kept of every row.

    Texts with the same words, repeated rows included, share a class; so do null texts and empty ones.
    Texts of fewer than five words are one shingle and have only such copies. The class id is the least id of the class
    (null where all are null); one row of each class is kept. Other columns are not read; an empty
    table gives an empty one.
    """
    return classes(sketched(df, text_col, [id_col]), id_col).drop("deal")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, that are kept of their classes."""
    rows = sketched(df, text_col, df.columns)
    dropped = stored(classes(rows, id_col).where(~F.col("kept")).select("deal"), "near-dropped")
    if dropped.count() <= BROADCAST_KEYS:
        dropped = F.broadcast(dropped)
    return rows.select("deal", "row").join(dropped, "deal", "left_anti").select("row.*")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
