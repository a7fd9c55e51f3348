"""Line dedup: an edit-distance join of lines by segment partition.

Lines are lower-cased, white space is collapsed. A line goes when the same line stands earlier in the corpus
(by doc_id, then place), whatever its length, or one within edit distance ``tau`` when the longer of the two has ``near``
characters or more.

If two strings are within tau edits and the shorter one is cut into tau + 1 segments, one of them is
found in the longer string, near its own place. So every line is indexed by its segments, and probes
the indexes of its own length and of up to tau shorter ones with the few substrings that can match.

1. ``live_hashes``: one reading hashes all segments and probes of all lines long enough, in numpy over running sums;
   one shuffle finds the hashes that two different lines share.
2. ``read``: a second reading keeps (place, id) of every line, and text, segments and probes only of the
   lines that meet a live hash, by a Bloom bitmap of fixed size.
3. ``edit_links``: segments and probes are joined on the hash. The join itself leaves out pairs whose
   character counts differ by more than 2 * tau, which no tau edits can do, so that a large group of lines
   with other words in them does not come out pair by pair. The distinct pairs that are left are verified
   by a banded bit-parallel edit distance, many pairs at a time.
4. ``marks``: a line's first place by a plain aggregate; copies never meet in one task.
5. ``classed``: a document is tied to an earlier one in which lines of it stand first, or lines linked to those that
   stand first in itself, when these lines hold the share ``cover`` of its characters (each different line counted
   once); documents of the same lines are tied in any case. Classes are the connected parts. So a line that
   many documents share joins those of which it is a large part, not all that hold it; a share of 0 joins them all.
6. ``line_table``: the same on the level of lines, every place with the id of its line, and links between ids.

A line's id is a 64-bit hash of its characters and length. Defined cases: null texts are empty;
empty lines are always kept; rows with the same id and text are one document and keep the same
lines; null ids come last; ties in doc_id are ordered by the row's key; a document whose lines all go is
dropped by ``dedup_lines`` and reported by ``marks``; further columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .chosen_path import components
from .registry import query
from .support import bitmap_of, row_key, stage, table, text_of, unused
from .words import Hasher, mix, runs, slices

#: Lines of fewer characters are left alone: only empty ones.
LEAST = 1
TAU = 2
#: Two lines are compared by edits when the longer one has so many characters: a few edits make another word of a short one.
NEAR = 20
#: Share of a document's characters in lines of an earlier document that makes both one class.
COVER = 0.5
#: Bits of the bitmap of live hashes: 8 MB, whatever their number.
BITS = 26
#: Classes of characters that are counted to tell lines apart in the join.
CLASSES = 16


def lines_of(part: pa.RecordBatch, hasher: Hasher, least: int):
    """Normal lines of a part: characters, start, length, row, place in the text, running sums."""
    column = pc.fill_null(part.column("text"), "")
    sizes = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    chars = np.frombuffer("".join(column.to_pylist()).encode("utf-32-le"), np.uint32)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    n = len(chars)
    space = (chars == 32) | ((chars >= 9) & (chars <= 13) & (chars != 10)) | (chars == 160)
    begins = np.zeros(n + 1, bool)  # a line begins at this character
    begins[1:] = chars == 10
    begins[offsets] = True
    blank, blank_end = runs(space, offsets)
    drop = np.zeros(n, bool)
    # of each run of blanks the first one stays, unless the run is at an end of its line
    at_end = begins[blank] | begins[blank_end] | (np.append(chars, 10)[blank_end] == 10)
    drop[space] = True
    drop[blank[~at_end]] = False
    line_of = np.concatenate([[0], np.cumsum(chars == 10)])  # line breaks before each character
    kept = np.concatenate([[0], np.cumsum(~drop)])
    start, end = runs(chars != 10, offsets)
    row = np.searchsorted(offsets, start, "right") - 1
    place = line_of[start] - line_of[offsets[row]]
    text = np.where(space, np.uint32(32), chars)[~drop]
    start, length = kept[start], kept[end] - kept[start]
    ok = length >= least
    return text, start[ok], length[ok], row[ok], place[ok], hasher.sums(text)


def segments(length: np.ndarray, tau: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Start and length of each of the tau + 1 segments of strings of these lengths; longer ones come last."""
    parts = tau + 1
    base, longer = length // parts, length % parts
    return [(i * base + np.maximum(0, i - (parts - longer)), base + (i >= parts - longer)) for i in range(parts)]


def indexed(sums, hasher, start, length, tau: int) -> list[np.ndarray]:
    """Hashes of (length, segment number, segment)."""
    return [_tagged(hasher.pieces(sums, start + at, start + at + size), length, i) for i, (at, size) in enumerate(segments(length, tau))]


def probes(sums, hasher, start, length, tau: int) -> list[np.ndarray]:
    """Hashes of all substrings that can equal a segment of a line of the same or up to tau smaller length.

    Before segment i a match has at most i edits, after it at most tau - i; so a segment that stands at
    ``at`` in the shorter line starts within i of ``at``, and within tau - i of ``at`` plus the difference.
    """
    out = []
    for d in range(tau + 1):
        for i, (at, size) in enumerate(segments(length - d, tau)):
            for shift in range(max(-i, d - (tau - i)), min(i, d + (tau - i)) + 1):
                begin = np.clip(start + at + shift, start, start + length - size)
                out.append(_tagged(hasher.pieces(sums, begin, begin + size), length - d, i))
    return out


def _tagged(h: np.ndarray, length: np.ndarray, i: int) -> np.ndarray:
    return mix(h ^ (length.astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(i)))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), row_key().alias("row"), F.lower(text_of()).alias("text"))


def live_hashes(docs: DataFrame, near: int, tau: int) -> DataFrame:
    """Hashes that one line has as a segment and another one has too."""

    def batches(source):
        hasher = Hasher()
        for whole in source:
            for part in slices(whole, "text"):
                _, start, length, _, _, sums = lines_of(part, hasher, max(1, near - tau))
                ids = hasher.pieces(sums, start, start + length)
                ids, first = np.unique(ids, return_index=True)
                start, length = start[first], length[first]
                long = length >= near
                for flag, which, hashes in (
                    (1, ids, indexed(sums, hasher, start, length, tau)), (0, ids[long], probes(sums, hasher, start[long], length[long], tau)),
                ):
                    # the lowest bit of an id says whether the hash is a segment's
                    value = (which & ~np.uint64(1)) | np.uint64(flag)
                    for h in hashes:
                        yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(value.view(np.int64))], names=["hash", "value"])

    rows = _texts(docs).select("text").mapInArrow(batches, "hash long, value long").repartition("hash")
    line = F.shiftright("value", 1)
    found = rows.groupBy("hash").agg(F.min(line).alias("low"), F.max(line).alias("high"), F.bit_or("value").alias("flags"))
    return found.filter((F.col("low") != F.col("high")) & (F.col("flags").bitwiseAND(F.lit(1)) == 1)).select("hash")


def read(docs: DataFrame, bitmap: np.ndarray, least: int, tau: int, near_least: int) -> DataFrame:
    """One row per document: its lines as (place, id, size), and in full those that meet a live hash."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    line = pa.struct([("place", pa.int32()), ("id", pa.int64()), ("size", pa.int32())])
    full = pa.struct([("id", pa.int64()), ("text", pa.string()), ("counts", pa.list_(pa.int16())), ("segments", pa.list_(pa.int64())), ("probes", pa.list_(pa.int64()))])
    schema = "doc_id long, row binary, lines array<struct<place:int,id:long,size:int>>, near array<struct<id:long,text:string,counts:array<smallint>,segments:array<long>,probes:array<long>>>"

    def passes(h: np.ndarray) -> np.ndarray:
        bits, one = shared.value, np.uint64(1)
        a, b = h & np.uint64((1 << BITS) - 1), (h >> np.uint64(32)) & np.uint64((1 << BITS) - 1)
        hit = [(bits[(x >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63))) & one for x in (a, b)]
        return (hit[0] & hit[1]).astype(bool)

    def batches(source):
        hasher = Hasher()
        for whole in source:
            for part in slices(whole, "text"):
                text, start, length, row, place, sums = lines_of(part, hasher, least)
                ids = hasher.pieces(sums, start, start + length)
                bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
                lines = pa.StructArray.from_arrays([pa.array(place.astype(np.int32)), pa.array(ids.view(np.int64)), pa.array(length.astype(np.int32))], fields=list(line))
                _, first = np.unique(ids, return_index=True)
                first = first[length[first] >= max(1, near_least - tau)]
                own = indexed(sums, hasher, start[first], length[first], tau)
                probed = probes(sums, hasher, start[first], length[first], tau)
                own_ok, probed_ok = [passes(h) for h in own], [passes(h) & (length[first] >= near_least) for h in probed]
                near = [[] for _ in range(part.num_rows)]
                for j in np.flatnonzero(np.any(own_ok + probed_ok, axis=0)) if len(first) else ():
                    i = first[j]
                    chars = text[start[i] : start[i] + length[i]]
                    near[row[i]].append({
                        "id": int(ids[i].view(np.int64)), "text": chars.tobytes().decode("utf-32-le"),
                        "counts": np.minimum(np.bincount(chars % CLASSES, minlength=CLASSES), 32767),
                        "segments": [int(h[j].view(np.int64)) for h, ok in zip(own, own_ok) if ok[j]],
                        "probes": [int(h[j].view(np.int64)) for h, ok in zip(probed, probed_ok) if ok[j]],
                    })
                yield pa.record_batch([
                    part.column("doc_id"), part.column("row"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), lines), pa.array(near, pa.list_(full)),
                ], names=["doc_id", "row", "lines", "near"])

    return _texts(docs).mapInArrow(batches, schema)


def within(a: list[str], b: list[str], tau: int) -> np.ndarray:
    """Whether each pair is within tau edits, by bit-parallel rows of the band of 2 * tau + 1 diagonals.

    reached[e] has a bit per diagonal d of the current row i: cell (i, i + d) costs e edits or fewer. A row
    advances by matches on a diagonal, and with one edit more by a replaced character (same diagonal), a
    deleted one (next diagonal) and an inserted one (diagonal before, in the new row).
    """
    n = len(a)
    out, cores = np.zeros(n, bool), []
    for k in range(n):
        x, y = (np.frombuffer(s[k].encode("utf-32-le"), np.uint32) for s in (a, b))
        m = min(len(x), len(y))
        if abs(len(x) - len(y)) > tau:
            continue
        other = np.flatnonzero(x[:m] != y[:m])
        head = int(other[0]) if len(other) else m
        rest = m - head
        other = np.flatnonzero(x[len(x) - rest :][::-1] != y[len(y) - rest :][::-1])
        tail = int(other[0]) if len(other) else rest
        cores.append((k, x[head : len(x) - tail], y[head : len(y) - tail]))
    if not cores:
        return out
    which = np.array([k for k, _, _ in cores])
    nx, ny = (np.array([len(c[j]) for c in cores]) for j in (1, 2))
    pad = np.full(2 * tau + 1, 0xFFFFFFFF, np.uint32)
    xs = np.concatenate([np.concatenate([c[1], pad]) for c in cores])
    ys = np.concatenate([np.concatenate([pad, c[2], pad]) for c in cores])
    x0 = np.concatenate([[0], np.cumsum(nx + len(pad))])[:-1]
    y0 = np.concatenate([[0], np.cumsum(ny + 2 * len(pad))])[:-1] + len(pad)
    full = np.uint64((1 << (2 * tau + 1)) - 1)
    one = np.uint64(1)
    reached = [np.full(len(cores), sum(1 << (tau + d) for d in range(e + 1)), np.uint64) for e in range(tau + 1)]
    alive, i = np.arange(len(cores)), 0
    while True:
        ended = nx[alive] == i
        goal = alive[ended]
        out[which[goal]] = (reached[tau][ended] >> (tau + ny[goal] - nx[goal]).astype(np.uint64)) & one == one
        stay = ~ended & (reached[tau] != 0)
        alive, reached = alive[stay], [r[stay] for r in reached]
        if not len(alive):
            return out
        ch, match = xs[x0[alive] + i], np.zeros(len(alive), np.uint64)
        for d in range(-tau, tau + 1):
            j = np.clip(i + d, -len(pad), ny[alive] + len(pad) - 1)
            match |= (ys[y0[alive] + j] == ch).astype(np.uint64) << np.uint64(tau + d)
        # cells left of the first or right of the last column do not exist
        valid = np.zeros(len(alive), np.uint64)
        for d in range(-tau, tau + 1):
            valid |= ((i + 1 + d >= 0) & (i + 1 + d <= ny[alive])).astype(np.uint64) << np.uint64(tau + d)
        new = [reached[0] & match & valid]
        for e in range(1, tau + 1):
            step = (reached[e] & match) | reached[e - 1] | (reached[e - 1] >> one) | ((new[e - 1] << one) & full)
            new.append(step & valid)
        reached, i = new, i + 1


def edit_links(lines: DataFrame, tau: int) -> DataFrame:
    """Rows (a, b), a < b, of different lines within tau edits."""
    near = stage(lines.select(F.explode("near").alias("n")).select("n.*").dropDuplicates(["id"]), "near-lines")
    own = near.select(F.col("id").alias("a"), F.col("counts").alias("u"), F.explode("segments").alias("hash"))
    other = near.select(F.col("id").alias("b"), F.col("counts").alias("v"), F.explode("probes").alias("hash"))
    apart = F.aggregate(F.zip_with("u", "v", lambda x, y: F.abs(x - y).cast("int")), F.lit(0), lambda total, x: total + x)
    met = own.join(other, (own["hash"] == other["hash"]) & (F.col("a") != F.col("b")) & (apart <= 2 * tau))
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    texts = near.select("id", "text")
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")

    def batches(source):
        for whole in source:
            for part in slices(whole, "x"):
                ok = within(part.column("x").to_pylist(), part.column("y").to_pylist(), tau)
                yield part.select(["a", "b"]).filter(pa.array(ok))

    return both.select("a", "b", "x", "y").mapInArrow(batches, "a long, b long")


def _read(docs: DataFrame, least: int, tau: int, near_least: int) -> tuple[DataFrame, DataFrame]:
    """The staged rows of ``read`` and of ``edit_links``."""
    live = live_hashes(docs, near_least, tau)
    lines = stage(read(docs, bitmap_of(live, BITS), least, tau, near_least), "lines")
    return lines, stage(edit_links(lines, tau), "line-links")


def _marks(docs: DataFrame, least: int, tau: int, near_least: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``marks`` with ``chars``, of the different lines, and ``heads``, the first documents of repeated lines.

    Also rows (row, head, size): a line that stands first in ``row`` is linked to one that stands first in the earlier ``head``.
    """
    lines, links = _read(docs, least, tau, near_least)
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "place")
    each = lines.select("doc_id", "row", F.explode("lines").alias("l")).select("doc_id", "row", "l.*")
    first = each.groupBy("id").agg(F.min(rank).alias("first"), F.max("size").alias("size"), F.count(F.lit(1)).alias("n"))
    both = links.union(links.select("b", "a"))
    ids = both.select("a").distinct()
    linked = stage(first.join(ids, F.col("id") == F.col("a"), "left_semi").select("id", "first", "size"), "linked-lines")
    theirs = linked.select(F.col("id").alias("b"), F.col("first").alias("theirs"))
    head = F.col("first.row")
    later = both.join(linked.withColumnRenamed("id", "a"), "a").join(theirs, "b").filter(F.col("theirs") < F.col("first"))
    ends = later.select(head.alias("row"), F.col("theirs.row").alias("head"), "a", "size").filter(F.col("row") != F.col("head")).distinct()
    near = both.join(theirs, "b").groupBy(F.col("a").alias("id")).agg(F.min("theirs").alias("earliest"), F.count(F.lit(1)).alias("n_links"))
    seen = first.join(near, "id", "left").filter((F.col("n") > 1) | F.col("n_links").isNotNull())
    seen = seen.select("id", "first", "n_links", F.when(F.col("earliest") < F.col("first"), F.col("earliest")).alias("earlier"))
    hit = each.join(seen, "id")
    gone = F.col("earlier").isNotNull() | (rank != F.col("first"))
    keeper = F.coalesce("earlier", "first")["doc_id"]
    # rows with the same key are one document
    per_row = hit.groupBy("row").agg(
        F.array_sort(F.collect_set(F.when(gone, F.col("place")))).alias("removed"), F.array_sort(F.collect_set(F.when(gone, keeper))).alias("first_docs"),
        F.countDistinct(F.when(F.col("earlier").isNotNull(), F.col("place"))).alias("n_near"),
        F.aggregate(
            F.collect_set(F.when(F.col("n_links").isNotNull(), F.struct("place", "n_links"))), F.lit(0).cast("long"), lambda total, x: total + x["n_links"]
        ).alias("n_links"),
        F.collect_set(F.when(F.col("row") != head, F.struct(head.alias("head"), "id", "size"))).alias("heads"),
    )
    chars = F.aggregate(F.array_distinct(F.transform("lines", lambda l: F.struct(l["id"], l["size"].alias("size")))), F.lit(0).cast("long"), lambda total, l: total + l["size"])
    rows = lines.select("doc_id", "row", F.size("lines").alias("n_lines"), chars.alias("chars"), F.when(F.size("lines") > 0, F.xxhash64("lines.id")).alias("same")).join(per_row, "row", "left").select(
        "doc_id", "row", "n_lines", "chars", "same", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
        F.coalesce("first_docs", F.array().cast("array<long>")).alias("first_docs"), F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), "heads",
    )
    return rows, ends.drop("a")


def marks(docs: DataFrame, least: int = LEAST, tau: int = TAU, near_least: int = NEAR) -> DataFrame:
    """One row per document: its row key, counts, the places of the lines that go, and where they stand first."""
    return _marks(docs, least, tau, near_least)[0].drop("heads", "chars", "same")


def line_table(docs: DataFrame, least: int = LEAST, tau: int = TAU, near_least: int = NEAR) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, row, place, id) of all lines, and the links (a, b), a < b, between the ids of different lines."""
    lines, links = _read(docs, least, tau, near_least)
    return lines.select("doc_id", "row", F.explode("lines").alias("l")).select("doc_id", "row", "l.place", "l.id"), links


def classed(docs: DataFrame, least: int = LEAST, tau: int = TAU, near_least: int = NEAR, cover: float = 0.0) -> DataFrame:
    """The rows of ``marks`` with class_id, the smallest doc_id of the documents reached over ties that hold the share ``cover``."""
    rows, ends = _marks(docs, least, tau, near_least)
    rows = stage(rows, "line-marks")
    each = rows.select("row", "chars", "same", "heads").dropDuplicates(["row"])  # repeated rows are one document
    shared = each.select("row", F.explode("heads").alias("h")).select("row", "h.head", "h.size").unionByName(ends)
    ties = shared.groupBy("row", "head").agg(F.sum("size").alias("size")).join(each.select("row", "chars"), "row")
    ties = ties.filter(F.col("size") >= F.lit(float(cover)) * F.col("chars")).select(F.col("row").alias("a"), F.col("head").alias("b"))
    alike = each.filter(F.col("same").isNotNull()).groupBy("same").agg(F.min("row").alias("head"))
    copies = each.join(alike, "same").filter(F.col("row") != F.col("head")).select(F.col("row").alias("a"), F.col("head").alias("b"))
    labels = components(ties.union(copies)).withColumnRenamed("key", "row")
    named = stage(rows.drop("heads", "chars", "same").join(labels, "row", "left").withColumn("label", F.coalesce("label", "row")), "line-classes")
    heads = named.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("head"))
    return named.join(heads, "label").withColumn("class_id", F.col("head.doc_id")).drop("label", "head")


def dedup_lines(
    docs: DataFrame, least: int = LEAST, tau: int = TAU, near_least: int = NEAR, least_kept: float = 0.0
) -> DataFrame:
    """The documents without the lines that go, all columns kept; ``n_chars`` follows the text where it exists.

    Documents left empty go, and so do those of which less than ``least_kept`` of the characters is left:
    the rest of a near copy is of no use, and no later stage would know it as a copy.
    """
    key, lost = unused(docs, "row"), unused(docs, "removed")
    found = marks(docs, least, tau, near_least).filter(F.size("removed") > 0).select(F.col("row").alias(key), F.col("removed").alias(lost))
    found = stage(found.dropDuplicates([key]), "line-marks")
    joined = docs.withColumn(key, row_key()).join(found, key, "left")
    kept = F.array_join(F.filter(F.split(text_of(), "\n"), lambda line, i: ~F.array_contains(lost, i)), "\n")
    size = unused(docs, "size")
    cut = joined.withColumn(size, F.length(text_of())).withColumn("text", F.when(F.col(lost).isNull(), F.col("text")).otherwise(kept))
    enough = F.length("text") >= F.lit(float(least_kept)) * F.col(size)
    cut = cut.filter(F.col(lost).isNull() | ((F.trim("text") != "") & enough))
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col(lost).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
        cut = cut.withColumn("n_chars", n_chars)
    return cut.select(*docs.columns)


@query("op1_line_dedup")
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classed(table(spark, sf_dir, "documents"), cover=COVER).select(
        "doc_id", "class_id", "n_lines", F.size("removed").alias("n_removed"), "n_near", "n_links", "removed", "first_docs",
    )
