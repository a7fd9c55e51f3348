"""BPE encoding and decoding with a minimal acyclic transducer of the frequent words.

1. ``word_counts`` counts the words of all texts; the most frequent ones, ``size`` at most, make the lexicon.
2. ``compile_lexicon`` merges each once and builds a minimal automaton over their UTF-8 bytes. Equal
   suffixes share states; every transition carries a number, and their sum along a word is its place
   in the table of ids. The arrays go to executors as one file, which they memory-map.
3. ``encode`` splits whole texts, walks all new words of a part through the automaton at once, and
   merges words that are not in it by the tokenizer's ranks, exactly. Words seen lately stay in a
   bounded store of the worker. ``decode`` turns ids into text by the vocabulary.

Defined cases: a null text is empty and gives no ids and an empty decoded text; rows are encoded one
by one, so repeated rows and repeated or null ids give a row each; an empty table gives no rows and
an empty lexicon, which is valid; further columns are ignored. Words of any length are merged whole.
"""

from __future__ import annotations

import hashlib
import heapq
import io
import json
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F

from .registry import query
from .support import shared_file, stage, table, worker_cache
from .words import slices

#: Words in the automaton. A size for memory only: all other words are merged exactly.
LEXICON_WORDS = 65536
#: Words in a worker's store before it starts anew.
STORE_WORDS = 300_000
#: Words of more bytes are merged one by one, with a heap.
LONG_WORD = 64
#: Words counted before a task hands its counts on.
COUNT_WORDS = 200_000
#: How a word tokenizer splits, and what that comes to for lower-case ASCII texts, where ``re`` finds it faster.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ASCII_SPLIT = r"[a-z]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\t-\r a-z0-9]+"


def byte_letters() -> list[str]:
    """The printable letter of each byte: itself where printable, else the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else free))
        free += b not in plain
    return out


class Rules:
    """A tokenizer file: how texts split into words, and how words merge into ids."""

    def __init__(self, content: str):
        import regex

        spec = json.loads(content)
        model = spec["model"]
        self.vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = {
            (self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)
        }
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        letters = byte_letters()
        self.inner = [self.vocab[x] for x in letters]
        self.final = [self.vocab[x + self.suffix] for x in letters]
        self.first_ids = np.array(self.inner), np.array(self.final)
        self.width = 1 + max(self.token)
        found = sorted((a * self.width + b, rank) for (a, b), (rank, _) in self.merges.items())
        by_rank = np.zeros(len(pairs), np.int64)
        for rank, new in self.merges.values():
            by_rank[rank] = new
        self.pairs = np.array([k for k, _ in found]), np.array([r for _, r in found]), by_rank
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.find = regex.compile(split["pattern"]["Regex"], regex.V1).findall
        self.find_ascii = re.compile(ASCII_SPLIT).findall if split["pattern"]["Regex"] == SPLIT else self.find
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))).split if self.special else None
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))).findall if self.special else None

    def plain_words(self, text: str) -> list[str]:
        """Words of a text without special tokens: NFC, lower case by character, split."""
        if text.isascii():
            return self.find_ascii(text.lower())
        return self.find(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def words(self, text: str) -> list[str]:
        """All words; a special token stands as a word that starts with a zero byte."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.plain_words(text)
        parts, marks = self.cut(text), self.marks(text)
        out = self.plain_words(parts[0])
        for mark, part in zip(marks, parts[1:]):
            out.append("\x00" + mark)
            out += self.plain_words(part)
        return out

    def merge(self, word: str) -> list[int]:
        """Exact ids of a word: always the pair of lowest rank, the leftmost of equals."""
        if word[0] == "\x00" and word[1:] in self.special:
            return [self.special[word[1:]]]
        raw = word.encode()
        ids = [self.inner[b] for b in raw[:-1]] + [self.final[raw[-1]]]
        merges = self.merges
        if len(ids) <= 32:
            while len(ids) > 1:
                best, place = None, 0
                for i in range(len(ids) - 1):
                    m = merges.get((ids[i], ids[i + 1]))
                    if m is not None and (best is None or m[0] < best[0]):
                        best, place = m, i
                if best is None:
                    break
                ids[place : place + 2] = [best[1]]
            return ids
        n = len(ids)
        nxt, prv = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(m[0], i, m[1], ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, new, left, right = heapq.heappop(heap)
            j = nxt[i]
            if j < 0 or ids[i] != left or ids[j] != right:
                continue
            ids[i], ids[j], nxt[i] = new, -1, nxt[j]
            if nxt[i] >= 0:
                prv[nxt[i]] = i
            for a in (prv[i], i):
                if a >= 0 and nxt[a] >= 0 and (m := merges.get((ids[a], ids[nxt[a]]))):
                    heapq.heappush(heap, (m[0], a, m[1], ids[a], ids[nxt[a]]))
        return [x for x in ids if x >= 0]

    def merge_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words on end and their bounds. In each round every word makes its next merge.

        ``rank`` holds the rank of the pair that starts at each symbol; a merge renews it at two places.
        """
        keys, key_ranks, by_rank = self.pairs
        none = np.int64(len(by_rank))

        def ranks(left, right):
            key = left * self.width + right
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            return np.where(keys[at] == key, key_ranks[at], none)

        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(words), np.uint8)
        ids = self.first_ids[0][data]
        ids[ends - 1] = self.first_ids[1][data[ends - 1]]
        starts, word = ends - sizes, np.arange(len(words))
        rank = np.full(len(ids), none)
        rank[:-1] = ranks(ids[:-1], ids[1:])
        rank[ends - 1] = none
        done_ids, done_words, done_sizes = [], [], []
        while len(word):
            best = np.minimum.reduceat((rank << 32) | np.arange(len(rank)), starts)
            open_ = (best >> 32) < none
            if not open_.all():  # words without a further merge leave
                stay = np.repeat(open_, sizes)
                done_ids.append(ids[~stay]), done_words.append(word[~open_]), done_sizes.append(sizes[~open_])
                best = best[open_]
                moved = np.cumsum(stay) - 1
                ids, rank, sizes, word = ids[stay], rank[stay], sizes[open_], word[open_]
                at = moved[best & 0xFFFFFFFF]
                starts = np.cumsum(sizes) - sizes
            else:
                at = best & 0xFFFFFFFF
            if not len(word):
                break
            ids[at] = by_rank[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            rank[at] = rank[at + 1]
            ids, rank = ids[keep], rank[keep]
            at = at - np.arange(len(at))  # one symbol less for each word before
            sizes = sizes - 1
            starts = np.cumsum(sizes) - sizes
            right = at[at < starts + sizes - 1]
            rank[right] = ranks(ids[right], ids[right + 1])
            left = at[at > starts] - 1
            rank[left] = ranks(ids[left], ids[left + 1])
        word = np.concatenate(done_words) if done_words else np.zeros(0, np.int64)
        sizes = np.concatenate(done_sizes) if done_sizes else np.zeros(0, np.int64)
        flat = np.concatenate(done_ids) if done_ids else np.zeros(0, np.int64)
        order = np.argsort(word, kind="stable")
        begin = (np.cumsum(sizes) - sizes)[order]
        sizes = sizes[order]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        return flat[np.repeat(begin - bounds[:-1], sizes) + np.arange(bounds[-1])], bounds

    def decode(self, ids) -> str:
        """Tokens joined by blanks, as a tokenizer without a decoder does; unknown ids are left out."""
        return " ".join(filter(None, map(self.token.get, ids)))


def compile_lexicon(entries: list[tuple[str, list[int]]]) -> dict[str, np.ndarray]:
    """The minimal automaton of words in byte order, and the ids of each word by its place.

    Returns sorted transition keys (state * 256 + byte), their targets and numbers, the final states
    and the ids. Words are added in order; a state whose subtree is complete is looked up among the
    states registered so far and replaced by an equal one.
    """
    entries = sorted(((w.encode(), ids) for w, ids in entries), key=lambda x: x[0])
    edges: list[dict[int, int]] = [{}]
    final = [False]
    known: dict[tuple, int] = {}
    path: list[tuple[int, int]] = []  # (state, byte) of the last word, not yet shared

    def share(down_to: int) -> None:
        while len(path) > down_to:
            state, byte = path.pop()
            child = edges[state][byte]
            key = (final[child], *edges[child].items())
            edges[state][byte] = known.setdefault(key, child)

    last = b""
    for word, _ in entries:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        share(common)
        state = edges[path[-1][0]][path[-1][1]] if path else 0
        for byte in word[common:]:
            edges.append({})
            final.append(False)
            edges[state][byte] = len(edges) - 1
            path.append((state, byte))
            state = len(edges) - 1
        final[state] = True
        last = word
    share(0)
    below: dict[int, int] = {}
    stack = [0]
    while stack:  # words that can be read from each state
        state = stack[-1]
        todo = [c for c in edges[state].values() if c not in below]
        if todo:
            stack += todo
            continue
        below[state] = final[state] + sum(below[c] for c in edges[state].values())
        stack.pop()
    number = {state: i for i, state in enumerate(sorted(below))}
    rows = []
    for state in sorted(below):
        skipped = int(final[state])
        for byte in sorted(edges[state]):
            rows.append((number[state] * 256 + byte, number[edges[state][byte]], skipped))
            skipped += below[edges[state][byte]]
    rows.sort()
    keys, targets, numbers = (np.array(c, np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3
    sizes = [len(ids) for _, ids in entries]
    return {
        "keys": keys, "targets": targets, "numbers": numbers,
        "final": np.array([final[s] for s in sorted(below)], bool),
        "bounds": np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64),
        "ids": np.array([i for _, ids in entries for i in ids], np.uint32),
    }


ARRAYS = {"keys": "<i8", "targets": "<i8", "numbers": "<i8", "bounds": "<i8", "ids": "<u4", "final": "?"}


def pack(lexicon: dict[str, np.ndarray]) -> bytes:
    """All arrays in one file behind a header of their lengths."""
    out = io.BytesIO()
    out.write(np.array([len(lexicon[k]) for k in ARRAYS], "<i8").tobytes())
    for k, kind in ARRAYS.items():
        out.write(np.ascontiguousarray(lexicon[k], kind).tobytes())
    return out.getvalue()


def mapped(path: str) -> dict[str, np.ndarray]:
    """The arrays of a packed file, memory-mapped."""
    whole = np.memmap(path, np.uint8, "r")
    lengths, at, out = whole[: 8 * len(ARRAYS)].view("<i8"), 8 * len(ARRAYS), {}
    for (k, kind), n in zip(ARRAYS.items(), lengths.tolist()):
        size = n * np.dtype(kind).itemsize
        out[k] = whole[at : at + size].view(kind)
        at += size
    return out


def places(lexicon: dict[str, np.ndarray], words: list[bytes]) -> np.ndarray:
    """The place of each word in the lexicon, or -1; all words walk the automaton together."""
    keys, targets, numbers = lexicon["keys"], lexicon["targets"], lexicon["numbers"]
    out = np.full(len(words), -1, np.int64)
    if not len(keys) or not words:
        return out
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(words), np.uint8)
    alive = np.flatnonzero(sizes > 0)
    state, total, step = np.zeros(len(alive), np.int64), np.zeros(len(alive), np.int64), 0
    while len(alive):
        key = state * 256 + data[starts[alive] + step]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        ok = keys[at] == key
        alive, at = alive[ok], at[ok]
        state, total, step = targets[at], total[ok] + numbers[at], step + 1
        done = sizes[alive] == step
        hit = done & lexicon["final"][state]
        out[alive[hit]] = total[hit]
        alive, state, total = alive[~done], state[~done], total[~done]
    return out


def _rules(name: str) -> Rules:
    def make():
        with open(SparkFiles.get(name), encoding="utf-8") as f:
            return Rules(f.read())

    return worker_cache("rules", name, make)


def _ship_tokenizer(spark: SparkSession, path: str) -> str:
    spark.sparkContext.addFile(path)
    return path.rstrip("/").rpartition("/")[2]


def word_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """How often each word occurs in all texts. A task adds up its words before they are shuffled."""

    def count(source):
        rules, seen = _rules(tokenizer), Counter()

        def flush():
            batch = pa.record_batch(
                [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"]
            )
            seen.clear()
            return batch

        for whole in source:
            for text in whole.column("text").to_pylist():
                seen.update(rules.words(text or ""))
                if len(seen) > COUNT_WORDS:
                    yield flush()
        yield flush()

    words = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, tokenizer: str, size: int = LEXICON_WORDS) -> str:
    """Compile the most frequent words and hand the automaton to the executors; returns the file's name.

    Words are taken by classes of their counts, eight to each doubling, as long as all words of a class
    fit: a few hundred sums and ``size`` words at most come to the driver, and nothing is sorted.
    """
    spark = docs.sparkSession
    counts = stage(word_counts(docs, tokenizer).withColumn("class", F.floor(8 * F.log2("n")).cast("int")), "word-counts")
    sums = counts.groupBy("class").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("class")).collect()
    least, total = None, 0
    for r in sums:
        total += r["n"]
        if total > size:
            break
        least = r["class"]
    frequent = counts.filter(F.col("class") >= F.lit(least)) if least is not None else counts.limit(0)
    rules = _rules(tokenizer)
    entries = [(r["word"], rules.merge(r["word"])) for r in frequent.select("word").collect()]
    return shared_file(spark, "lexicon.bin", pack(compile_lexicon(entries)))


class Words:
    """A worker's words with their ids and decoded text; bounded."""

    def __init__(self, rules: Rules, lexicon: dict[str, np.ndarray]):
        self.rules, self.lexicon, self.ids, self.text = rules, lexicon, {}, {}

    def learn(self, new: list[str]) -> None:
        lex, rules, raw = self.lexicon, self.rules, [w.encode() for w in new]
        found = places(lex, raw)
        ids, bounds = lex["ids"], lex["bounds"]
        unseen = []
        for k, place in enumerate(found.tolist()):
            if place >= 0:
                self.keep(new[k], ids[bounds[place] : bounds[place + 1]].tobytes())
            elif len(raw[k]) > LONG_WORD or raw[k][0] == 0:
                self.keep(new[k], np.array(rules.merge(new[k]), "<u4").tobytes())
            else:
                unseen.append(k)
        if unseen:
            flat, at = rules.merge_many([raw[k] for k in unseen])
            packed, at = flat.astype("<u4").tobytes(), (4 * at).tolist()
            for k, a, b in zip(unseen, at, at[1:]):
                self.keep(new[k], packed[a:b])

    def keep(self, word: str, ids: bytes) -> None:
        self.ids[word] = ids
        self.text[word] = self.rules.decode(memoryview(ids).cast("I"))


ENCODED = "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string"


def encode(docs: DataFrame, tokenizer_path: str, size: int = LEXICON_WORDS, keep_ids: bool = True) -> DataFrame:
    """Ids of every text, their digest, and the digest of the text decoded from them."""
    spark = docs.sparkSession
    tokenizer = _ship_tokenizer(spark, tokenizer_path)
    lexicon = build_lexicon(docs, tokenizer, size)

    def batches(source):
        rules = _rules(tokenizer)
        store = worker_cache("words", (tokenizer, lexicon), lambda: Words(rules, mapped(SparkFiles.get(lexicon))))
        for whole in source:
            for part in slices(whole, "text"):
                texts = [rules.words(t or "") for t in part.column("text").to_pylist()]
                wanted = set().union(*texts)
                new = [w for w in wanted if w not in store.ids]
                if len(new) + len(store.ids) > STORE_WORDS:
                    store.ids.clear(), store.text.clear()
                    new = list(wanted)
                store.learn(new)
                ids = [b"".join(map(store.ids.__getitem__, ws)) for ws in texts]
                columns = {
                    "doc_id": pa.array(part.column("doc_id").to_pylist(), pa.int64()),
                    "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids": pa.array([np.frombuffer(x, np.int32) if keep_ids else None for x in ids], pa.list_(pa.int32())),
                    "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    "decoded_sha256": pa.array(
                        [hashlib.sha256(" ".join(map(store.text.__getitem__, ws)).encode()).hexdigest() for ws in texts], pa.string()
                    ),
                }
                yield pa.record_batch(list(columns.values()), names=list(columns))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(batches, ENCODED)


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """The text of the ids in column ``ids``, beside ``doc_id``."""
    tokenizer = _ship_tokenizer(encoded.sparkSession, tokenizer_path)

    def batches(source):
        rules = _rules(tokenizer)
        for part in source:
            texts = [rules.decode(x or []) for x in part.column("ids").to_pylist()]
            yield pa.record_batch([part.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(batches, "doc_id long, decoded string")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op3_bpe_lexicon")
def op3_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), tokenizer_path(), keep_ids=False).drop("ids")
