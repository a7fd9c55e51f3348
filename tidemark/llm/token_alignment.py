"""Alignment of two tokenizers' tokens by their byte ends, and the link counts of token pairs.

1. ``align`` encodes every whole text with both tokenizers in workers. Byte ends of the tokens are two
   rising lists; the shorter one is searched in the longer one by ``gallop``: exponential steps from the
   place of an earlier end, then binary search. Ends in both lists cut the tokens into groups, and the
   differences of ranks are the ranges of tokens that overlap each token, the links.
2. The distinct pairs of each document with their numbers of links are written as Parquet, sorted, beside
   the document's counts and digests.
3. ``pair_counts`` adds up pairs over all documents, in workers before they are shuffled.
4. ``best_links`` looks every written pair up again. The most frequent pairs, ``HOT_PAIRS`` at most, go to
   the workers as one file of bounded size and answer most lookups there; all other pairs are joined with
   the counts, exactly, and summed per document.

Defined cases: a text that is null or empty, or whose tokens of either tokenizer do not spell a blank and
the text, has no tokens: zeros and an empty string instead of a digest. Rows are told apart by a row number
given when they are written, so repeated rows and repeated or null ids give a row each and all count. Pairs
that tie for the highest count of their second id are all best. An empty table gives no rows. Further
columns are ignored, so their names cannot clash. Texts of any length are aligned whole.
"""

from __future__ import annotations

import hashlib
import json
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bpe_lexicon import byte_letters
from .registry import query
from .support import shared_file, stage, table, worker_cache
from .words import slices

#: Pairs answered in workers; 24 bytes each in one file. A size for memory only: the others are joined.
HOT_PAIRS = 1 << 20
#: Distinct pairs a task adds up before it hands its sums on.
HELD_PAIRS = 1 << 21
#: Every so many elements are placed first, and the elements between start from there.
STRIDE = 16


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each element of a rising array, how many of the other rising array are smaller.

    Each element starts at the place of an earlier element of its own array, doubles its steps until it
    has passed the answer, and searches the last step by halves. All elements move together.
    """
    n, m = len(short), len(long)
    low = np.zeros(n, np.int64)
    if n > STRIDE:
        low += np.repeat(gallop(short[::STRIDE], long), STRIDE)[:n]
    high = np.full(n, m, np.int64)
    on, step = np.arange(n), 1
    while len(on):
        probe = low[on] + (step - 1)
        inside = probe < m
        on, probe = on[inside], probe[inside]
        smaller = long[probe] < short[on]
        high[on[~smaller]] = probe[~smaller]
        on = on[smaller]
        low[on] = probe[smaller] + 1
        step *= 2
    on = np.flatnonzero(low < high)
    while len(on):
        a, b = low[on], high[on]
        middle = (a + b) >> 1
        smaller = long[middle] < short[on]
        low[on] = np.where(smaller, middle + 1, a)
        high[on] = np.where(smaller, b, middle)
        on = on[low[on] < high[on]]
    return low


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Indices of both lists where they share an end, and the linked token pairs as two index arrays.

    Both lists cover the same bytes. The shorter one drives.
    """
    if len(a_ends) > len(b_ends):
        b_shared, a_shared, b_link, a_link = overlaps(b_ends, a_ends)
        return a_shared, b_shared, a_link, b_link
    place = gallop(a_ends, b_ends)
    shared = b_ends[np.minimum(place, len(b_ends) - 1)] == a_ends if len(b_ends) else np.zeros(0, bool)
    first = np.zeros(len(place), np.int64)
    first[1:] = place[:-1] + shared[:-1]
    sizes = place - first + 1
    a_link = np.repeat(np.arange(len(place)), sizes)
    begin = np.cumsum(sizes) - sizes
    b_link = np.arange(len(a_link)) + np.repeat(first - begin, sizes)
    return np.flatnonzero(shared), place[shared], a_link, b_link


class Sides:
    """Both tokenizers of a worker, with the bytes, byte lengths and decimal names of their ids."""

    def __init__(self, byte_level: str, pieces: str, pattern: str):
        import sentencepiece
        import tiktoken

        with open(byte_level, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, special = spec["model"]["vocab"], {t["content"] for t in spec["added_tokens"]}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [vocab[a + b] for a, b in pairs]
        if any(i >= j for i, j in zip(made, made[1:])):
            raise ValueError("the merges must be listed by the ids they make, so that ids are ranks")
        letter = {x: b for b, x in enumerate(byte_letters())}
        spelled = {bytes(map(letter.__getitem__, t)): i for t, i in vocab.items() if t not in special}
        self.a = tiktoken.Encoding("byte level", pat_str=pattern, mergeable_ranks=spelled, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.a_bytes = [b""] * (1 + max(spelled.values()))
        for token, i in spelled.items():
            self.a_bytes[i] = token
        size = self.b.get_piece_size()
        names = self.b.id_to_piece(list(range(size)))
        self.b_bytes = [
            bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else x.replace("▁", " ").encode()
            for i, x in enumerate(names)
        ]
        self.a_sizes = np.array(list(map(len, self.a_bytes)))
        self.b_sizes = np.array(list(map(len, self.b_bytes)))
        # names with the sign behind them: within a side, last of side A, last of side B
        a, b = len(self.a_bytes), len(self.b_bytes)
        self.names = [b"%d%c" % (i, sign) for n, signs in ((a, b",|"), (b, b",;")) for sign in signs for i in range(n)]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides; none where the tokens do not spell a blank and the text."""
        spaced = [" " + t for t in texts]
        a = list(map(self.a.encode_ordinary, spaced))
        b = self.b.encode(texts, num_threads=1)
        for k, text in enumerate(spaced):
            raw = text.encode()
            if (
                len(raw) == 1 or b"".join(map(self.a_bytes.__getitem__, a[k])) != raw
                or b"".join(map(self.b_bytes.__getitem__, b[k])) != raw
            ):
                a[k], b[k] = [], []
        return a, b


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])
    return np.fromiter(chain.from_iterable(lists), np.int64, bounds[-1]), bounds


def align_texts(sides: Sides, texts: list[str]) -> dict[str, list]:
    """Counts, digest and distinct linked pairs of each text."""
    a_lists, b_lists = sides.encode(texts)
    (a, a_bounds), (b, b_bounds) = _flat(a_lists), _flat(b_lists)
    # every text with tokens covers the same bytes on both sides, so texts on end stay aligned
    a_shared, b_shared, a_link, b_link = overlaps(np.cumsum(sides.a_sizes[a]), np.cumsum(sides.b_sizes[b]))
    n_a, n_b = np.diff(a_bounds), np.diff(b_bounds)
    groups = np.searchsorted(a_shared, a_bounds)  # a group ends within its text
    n_groups = np.diff(groups)

    # tokens of both sides in the order of the groups
    a_last, b_last = np.zeros(len(a), bool), np.zeros(len(b), bool)
    a_last[a_shared], b_last[b_shared] = True, True
    a_group = np.cumsum(a_last) - a_last
    b_group = np.cumsum(b_last) - b_last
    b_before = np.concatenate([[0], b_shared + 1])[a_group] if len(a) else a
    a_before = (a_shared + 1)[b_group] if len(b) else b
    wide_a, wide_b = len(sides.a_bytes), len(sides.b_bytes)
    order = np.empty(len(a) + len(b), np.int64)
    order[np.arange(len(a)) + b_before] = a + wide_a * a_last
    order[np.arange(len(b)) + a_before] = b + 2 * wide_a + wide_b * b_last
    named = list(map(sides.names.__getitem__, order.tolist()))
    cuts = (a_bounds + b_bounds).tolist()
    digests = [hashlib.sha256(b"".join(named[i:j])[:-1]).hexdigest() if j > i else "" for i, j in zip(cuts, cuts[1:])]

    text_of = np.repeat(np.arange(len(texts)), n_a)
    pair, links = np.unique((text_of[a_link] * wide_a + a[a_link]) * wide_b + b[b_link], return_counts=True)
    pair_bounds = np.searchsorted(pair, np.arange(len(texts) + 1) * (wide_a * wide_b))
    return {
        "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": np.diff(np.searchsorted(a_link, a_bounds)),
        "groups_sha256": digests, "pairs": pair % (wide_a * wide_b), "links": links, "bounds": pair_bounds,
    }


ALIGNED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<int>"
)


def align(docs: DataFrame, byte_level: str, pieces: str, pattern: str) -> DataFrame:
    """One row per document: ``ALIGNED``, and ``wide``-coded pairs (first id times the number of second ids, plus second id)."""
    spark = docs.sparkSession
    for path in (byte_level, pieces):
        spark.sparkContext.addFile(path)
    files = tuple(path.rstrip("/").rpartition("/")[2] for path in (byte_level, pieces))

    def batches(source):
        sides = worker_cache("sides", (files, pattern), lambda: Sides(*map(SparkFiles.get, files), pattern))
        for whole in source:
            for part in slices(whole, "text"):
                got = align_texts(sides, [t or "" for t in part.column("text").to_pylist()])
                bounds = pa.array(got["bounds"], pa.int32())
                yield pa.record_batch([
                    part.column("doc_id"), *[pa.array(got[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")],
                    pa.array(got["groups_sha256"], pa.string()), pa.ListArray.from_arrays(bounds, pa.array(got["pairs"], pa.int64())),
                    pa.ListArray.from_arrays(bounds, pa.array(got["links"], pa.int32())),
                ], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(batches, ALIGNED)


def _lists(batch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column on end, and the row of each."""
    column = batch.column(name)
    sizes = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)


def pair_counts(aligned: DataFrame, wide: int) -> DataFrame:
    """``pair, n, best``: links of each pair in all documents, and whether its second id has no pair of more."""

    def add_up(source):
        held, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def batch():
            return pa.record_batch([pa.array(held), pa.array(sums)], names=["pair", "n"])

        for part in source:
            pairs, links = (_lists(part, c)[0] for c in ("pairs", "links"))
            held, place = np.unique(np.concatenate([held, pairs]), return_inverse=True)
            both = np.concatenate([sums, links.astype(np.int64)])
            sums = np.zeros(len(held), np.int64)
            np.add.at(sums, place, both)
            if len(held) > HELD_PAIRS:
                yield batch()
                held, sums = held[:0], sums[:0]
        yield batch()

    counts = aligned.select("pairs", "links").mapInArrow(add_up, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    second = (F.col("pair") % F.lit(wide)).alias("second")
    highest = counts.groupBy(second).agg(F.max("n").alias("highest"))
    return counts.withColumn("second", F.col("pair") % F.lit(wide)).join(highest, "second").select(
        "pair", "n", (F.col("n") == F.col("highest")).alias("best")
    )


def hot_pairs(counts: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """The most frequent pairs, ``most`` at most, by classes of their counts; and whether these are all pairs."""
    by_class = counts.withColumn("class", F.floor(8 * F.log2("n")).cast("int"))
    sums = by_class.groupBy("class").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("class")).collect()
    least, total = None, 0
    for row in sums:
        total += row["k"]
        if total > most:
            break
        least = row["class"]
    everything = total <= most
    if everything:
        return counts, True
    return (by_class.filter(F.col("class") >= F.lit(least)) if least is not None else by_class.limit(0)).drop("class"), False


LOOKED = "row long, n_best long, count_sum long, others array<long>, other_links array<int>"


def best_links(aligned: DataFrame, counts: DataFrame, most: int = HOT_PAIRS) -> DataFrame:
    """``row, n_best, count_sum`` of every row of a written table of aligned documents."""
    hot, everything = hot_pairs(counts, most)
    found = hot.toPandas().sort_values("pair")
    packed = np.concatenate([found["pair"].to_numpy(np.int64), found["n"].to_numpy(np.int64), found["best"].to_numpy(np.int64)])
    name = shared_file(aligned.sparkSession, "pairs.bin", packed.tobytes())

    def look_up(source):
        keys, sums, best = np.memmap(SparkFiles.get(name), np.int64, "r").reshape(3, -1) if len(packed) else np.zeros((3, 0), np.int64)
        for part in source:
            (pairs, row), (links, _) = _lists(part, "pairs"), _lists(part, "links")
            n, links = part.num_rows, links.astype(np.int64)
            at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            known = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            n_best, count_sum = np.zeros(n, np.int64), np.zeros(n, np.int64)
            np.add.at(n_best, row[known], links[known] * best[at[known]])
            np.add.at(count_sum, row[known], links[known] * sums[at[known]])
            bounds = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[~known], minlength=n))]), pa.int32())
            yield pa.record_batch([
                part.column("row"), pa.array(n_best), pa.array(count_sum),
                pa.ListArray.from_arrays(bounds, pa.array(pairs[~known], pa.int64())),
                pa.ListArray.from_arrays(bounds, pa.array(links[~known], pa.int32())),
            ], names=["row", "n_best", "count_sum", "others", "other_links"])

    looked = aligned.select("row", "pairs", "links").mapInArrow(look_up, LOOKED)
    if everything:
        return looked.select("row", "n_best", "count_sum")
    rest = looked.select("row", F.explode(F.arrays_zip("others", "other_links")).alias("x"))
    rest = rest.select("row", F.col("x.others").alias("pair"), F.col("x.other_links").alias("k")).join(counts, "pair")
    rest = rest.select("row", F.when(F.col("best"), F.col("k")).otherwise(0).cast("long").alias("n_best"), (F.col("k") * F.col("n")).alias("count_sum"))
    return looked.select("row", "n_best", "count_sum").unionByName(rest).groupBy("row").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")
    )


def alignment(docs: DataFrame, byte_level: str, pieces: str, pattern: str, most: int = HOT_PAIRS) -> DataFrame:
    """Counts, digest of the groups, and links by how often their pair is linked in all documents."""
    import sentencepiece

    wide = sentencepiece.SentencePieceProcessor(model_file=pieces).get_piece_size()
    aligned = stage(align(docs, byte_level, pieces, pattern).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = stage(pair_counts(aligned, wide), "pair-counts")
    plain = aligned.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return plain.join(best_links(aligned, counts, most), "row").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


@query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return alignment(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.PATTERN)
