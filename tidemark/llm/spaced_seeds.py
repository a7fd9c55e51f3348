"""Benchmark decontamination by spaced seeds.

Masks of span ``SPAN`` ignore some word positions, so a seed still hits when words at ignored places
were replaced. Every position of every benchmark text and every document gets a hash per mask.

1. ``benchmark_seeds`` hashes the benchmark; a Bloom bitmap of fixed size is made of the hashes.
2. ``document_segments`` hashes all documents in one pass and keeps the neighbourhoods of the seeds
   that pass the bitmap: their word hashes and the seeds. The bitmap only thins out what is shuffled.
3. ``overlaps`` joins documents and benchmark on the hash, puts hits of one diagonal together and
   compares the words along it: of all stretches with a share of ``similar`` equal words, the one with
   most equal words is taken, so text around a stretch cannot take its place; it counts with ``least`` equal
   words, or the share ``similar`` of a benchmark text that has fewer than ``least``.

Documents are told apart by their text, so copies are looked at once and take the result of their
text in one join. Defined cases: null texts are empty; benchmark texts of five words or more, but
fewer than ``least``, are looked for by the hashes of every choice of so many of their words as must be equal; those of
fewer than five words recur by chance and are not looked for; several benchmark texts in one document are all reported; repeated rows give a row each; a null id stays
null; an empty benchmark contaminates nothing; further columns are kept by ``clean`` and ignored by the query.
"""

from __future__ import annotations

import math
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .registry import query
from .support import bitmap_of, stage, table, text_of, unused
from .words import BASE, Hasher, mix, slices, utf8, words

#: Fixed masks: x counts, - is ignored. Nine words, six or seven of which count.
MASKS = ["xxxxxxx--", "xx-xx-xxx", "xxx--xx-x"]
SPAN = 9
#: A stretch counts with this many equal words and this share of equal words.
LEAST, SIMILAR = 12, 0.75
#: Bits of the bitmap: 2**24 bits are 2 MB, whatever the benchmark's size.
BITS = 24
#: Words kept around seeds of a document, on either side; a stretch that reaches further is found from its other seeds.
AROUND = 64
#: Benchmark texts of fewer words are not looked for.
SHORTEST = 5


def seeds_of(hashes: np.ndarray, first: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Seed hash at each place where the mask fits into the row, and these places."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.full(n, int("1" + mask.replace("x", "1").replace("-", "0"), 2), np.uint64)
    for j, mark in enumerate(mask):
        if mark == "x":
            out = mix(out * np.uint64(BASE) + hashes[j : n + j])
    row_of = np.searchsorted(first, np.arange(n), "right") - 1
    places = np.flatnonzero(first[1:][row_of] - np.arange(n) >= len(mask))
    return out[places], places


def needed(n: int, least: int, similar: float) -> int:
    """Equal words that a benchmark text of n words needs."""
    return least if n >= least else math.ceil(_share(similar) * n)


def _share(similar: float) -> Fraction:
    return Fraction(similar).limit_denominator(10_000)


def short_masks(n: int, need: int) -> list[tuple[int, str]]:
    """Each choice of ``need`` of n words as a mask from the first to the last word chosen, and where it begins."""
    return [(c[0], "".join("x" if i in c else "-" for i in range(c[0], c[-1] + 1))) for c in combinations(range(n), need)]


def _lowered(text: str = "text"):
    return F.lower(text_of(text)).alias("text")


def benchmark_words(benchmark: DataFrame, least: int = LEAST, similar: float = SIMILAR) -> DataFrame:
    """Rows (item_id, words, seeds) with hashes of words, and (place, hash) of the seeds of each text."""
    schema = "item_id long, item_text binary, words array<long>, seeds array<struct<place:int,hash:long>>"

    def batches(source):
        hasher = Hasher()
        for whole in source:
            for part in slices(whole, "text"):
                _, _, hashes, first = words(*utf8(part.column("text")), hasher)
                rows = [[] for _ in range(part.num_rows)]
                for mask in MASKS:
                    seed, at = seeds_of(hashes, first, mask)
                    row = np.searchsorted(first, at, "right") - 1
                    for r, place, h in zip(row.tolist(), (at - first[row]).tolist(), seed.view(np.int64).tolist()):
                        rows[r].append({"place": place, "hash": h})
                for r, n in enumerate(np.diff(first).tolist()):
                    if SHORTEST <= n < least:
                        for place, mask in short_masks(n, needed(n, least, similar)):
                            seed, _ = seeds_of(hashes[first[r] + place : first[r] + place + len(mask)], np.array([0, len(mask)]), mask)
                            rows[r].append({"place": place, "hash": int(seed.view(np.int64)[0])})
                signed = hashes.view(np.int64)
                yield pa.record_batch([
                    part.column("item_id"), part.column("item_text"),
                    pa.array([signed[a:b] for a, b in zip(first, first[1:])], pa.list_(pa.int64())),
                    pa.array(rows, pa.list_(pa.struct([("place", pa.int32()), ("hash", pa.int64())]))),
                ], names=["item_id", "item_text", "words", "seeds"])

    rows = benchmark.select(F.col("item_id").cast("long"), F.unhex(F.md5(text_of())).alias("item_text"), _lowered())
    return rows.mapInArrow(batches, schema)


def document_segments(docs: DataFrame, bitmap, lengths: list[int], least: int = LEAST, similar: float = SIMILAR) -> DataFrame:
    """Rows (key, begin, words, seeds): stretches of documents around seeds that pass the bitmap.

    ``lengths`` are those of the benchmark texts that have fewer words than must be equal in longer ones.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    schema = "key binary, begin int, words array<long>, seeds array<struct<place:int,hash:long>>"
    one = np.uint64(1)
    masks = [*MASKS, *sorted({mask for n in lengths for _, mask in short_masks(n, needed(n, least, similar))})]

    def passes(h: np.ndarray) -> np.ndarray:
        bits, low = shared.value, np.uint64((1 << BITS) - 1)
        a, b = h & low, (h >> np.uint64(32)) & low
        return ((bits[(a >> np.uint64(6)).astype(np.int64)] >> (a & np.uint64(63))) & (bits[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & one).astype(bool)

    def batches(source):
        hasher = Hasher()
        for whole in source:
            for part in slices(whole, "text"):
                _, _, hashes, first = words(*utf8(part.column("text")), hasher)
                found_at, found = [], []
                for mask in masks:
                    seed, at = seeds_of(hashes, first, mask)
                    ok = passes(seed)
                    found_at.append(at[ok]), found.append(seed[ok])
                at, seed = np.concatenate(found_at), np.concatenate(found).view(np.int64)
                order = np.argsort(at, kind="stable")
                at, seed = at[order], seed[order]
                row = np.searchsorted(first, at, "right") - 1
                new = np.ones(len(at), bool)
                new[1:] = (row[1:] != row[:-1]) | (np.diff(at) > 2 * AROUND)
                cuts = [*np.flatnonzero(new).tolist(), len(at)]
                out = {"key": [], "begin": [], "words": [], "seeds": []}
                keys, signed = part.column("key"), hashes.view(np.int64)
                for a, b in zip(cuts, cuts[1:]):
                    r = int(row[a])
                    begin, end = max(first[r], at[a] - AROUND), min(first[r + 1], at[b - 1] + SPAN + AROUND)
                    out["key"].append(keys[r].as_py())
                    out["begin"].append(int(begin - first[r]))
                    out["words"].append(signed[begin:end])
                    out["seeds"].append([{"place": int(p - begin), "hash": int(h)} for p, h in zip(at[a:b], seed[a:b])])
                yield pa.record_batch([
                    pa.array(out["key"], pa.binary()), pa.array(out["begin"], pa.int32()), pa.array(out["words"], pa.list_(pa.int64())),
                    pa.array(out["seeds"], pa.list_(pa.struct([("place", pa.int32()), ("hash", pa.int64())]))),
                ], names=list(out))

    return docs.select(F.unhex(F.md5(text_of())).alias("key"), _lowered()).mapInArrow(batches, schema)


def best_stretch(equal: np.ndarray, similar: float = SIMILAR) -> tuple[int, int]:
    """Start and end of the stretch with most equal words among those with a share of ``similar`` of them.

    A stretch has the share when the sum of equal words less ``similar`` does not fall over it. For each end,
    the earliest such start holds most equal words; it is the first place where the lowest sum is low enough.
    """
    share, n = _share(similar), len(equal)
    count = np.concatenate([[0], np.cumsum(equal, dtype=np.int64)])
    total = count * share.denominator - np.arange(n + 1) * share.numerator
    start = np.searchsorted(-np.minimum.accumulate(total), -total, "left")
    end = int(np.argmax(count - count[start]))
    inside = np.flatnonzero(equal[start[end] : end])
    return (int(start[end] + inside[0]), int(start[end] + inside[-1] + 1)) if len(inside) else (0, 0)


def overlaps(segments: DataFrame, items: DataFrame, least: int, similar: float) -> DataFrame:
    """Verified overlaps (key, item_id, start, n_equal, n_words) of document segments and benchmark texts."""
    seeds = segments.select("key", "begin", F.explode("seeds").alias("s")).select("key", "begin", "s.place", "s.hash")
    known = items.select("item_text", F.explode("seeds").alias("s")).select("item_text", F.col("s.place").alias("at"), "s.hash")
    shift = (F.col("place") - F.col("at")).alias("shift")
    lines = seeds.join(known, "hash").select("key", "begin", "item_text", shift).distinct()
    pairs = lines.join(segments.select("key", "begin", F.col("words").alias("doc_words")), ["key", "begin"]).join(
        items.dropDuplicates(["item_text"]).select("item_text", F.col("words").alias("item_words")), "item_text"
    )

    def batches(source):
        for part in source:
            rows = {"key": [], "item_text": [], "start": [], "n_equal": [], "n_words": []}
            columns = {c: part.column(c) for c in ("key", "item_text", "begin", "shift", "doc_words", "item_words")}
            for i in range(part.num_rows):
                doc = np.asarray(columns["doc_words"][i].values)
                item = np.asarray(columns["item_words"][i].values)
                shift = columns["shift"][i].as_py()
                a, b = max(0, shift), min(len(doc), len(item) + shift)
                equal = doc[a:b] == item[a - shift : b - shift]
                start, end = best_stretch(equal, similar)
                n, size = int(equal[start:end].sum()), end - start
                if size and n >= needed(len(item), least, similar):
                    rows["key"].append(columns["key"][i].as_py())
                    rows["item_text"].append(columns["item_text"][i].as_py())
                    rows["start"].append(columns["begin"][i].as_py() + a + start)
                    rows["n_equal"].append(n)
                    rows["n_words"].append(size)
            yield pa.record_batch([
                pa.array(rows["key"], pa.binary()), pa.array(rows["item_text"], pa.binary()), *[pa.array(rows[c], pa.int32()) for c in ("start", "n_equal", "n_words")]
            ], names=list(rows))

    columns = ["key", "item_text", "begin", "shift", "doc_words", "item_words"]
    return pairs.select(*columns).mapInArrow(batches, "key binary, item_text binary, start int, n_equal int, n_words int")


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, similar: float = SIMILAR) -> DataFrame:
    """Rows (key, item_ids, n_equal) of the distinct texts that overlap the benchmark; key is the md5 of the text."""
    items = stage(benchmark_words(benchmark, least, similar), "benchmark-words")
    size = F.size("words")
    lengths = [n for (n,) in items.filter((size >= SHORTEST) & (size < least)).select(size).distinct().collect()]  # seven at most
    bitmap = bitmap_of(items.select(F.explode("seeds").alias("s")).select("s.hash"), BITS)
    segments = stage(document_segments(docs, bitmap, lengths, least, similar).dropDuplicates(["key", "begin"]), "seed-segments")
    found = overlaps(segments, items, least, similar)
    ids = items.groupBy("item_text").agg(F.collect_set("item_id").alias("ids"))
    return (
        found.join(ids, "item_text").groupBy("key")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("item_ids"), F.max("n_equal").alias("n_equal"))
    )


def clean(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, similar: float = SIMILAR) -> DataFrame:
    """The documents without overlap, all columns kept."""
    key = unused(docs, "found")
    found = stage(contaminated(docs, benchmark, least, similar).select(F.col("key").alias(key)), "contaminated")
    return docs.join(found, F.unhex(F.md5(text_of())) == F.col(key), "left_anti")


@query("op10_spaced_seeds")
def op10_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = stage(contaminated(docs, table(spark, sf_dir, "benchmark")), "contaminated")
    return docs.select(F.col("doc_id").cast("long"), F.unhex(F.md5(text_of())).alias("key")).join(found, "key", "left").select(
        "doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"),
        F.coalesce("n_equal", F.lit(0)).alias("n_equal"),
    )
