"""Secrets in texts: base patterns, and character Markov models of random strings against ordinary identifiers.

``scan`` reads each text once. It finds the base spans, counts character pairs of labelled samples
(values of base spans are random; other tokens, with digits or without, are ordinary identifiers unless
they change between small letters, capitals and digits at more than every fourth character) and keeps the tokens to be judged. ``train`` sums the pair counts over all documents into two models
of fixed size. Rare pairs lean on how often their second character occurs in the sample; half of the random
model is uniform, because secrets come in other alphabets than the labelled ones. ``judge`` adds a
span for each token whose log-likelihood ratio reaches the threshold. ``held_back`` measures the models
on samples that they have not seen.

Defined cases: a null text is empty; an empty text has no span; a token that touches a base span is
left to that span; tokens without a letter are numbers (dates, telephones, cards) and only samples; without
any random sample no token is added; a ratio equal to the threshold adds the span; rows are judged one by one, so
repeated rows and repeated or null ids give a row each; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .registry import query
from .support import stage, table
from .words import runs, slices, utf8

# fixed values of the contract
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ["assign", "access", "hex", "markov"]

#: Tokens of at least this many characters are judged; shorter random strings are too like words.
JUDGED_LEAST = 16
#: Ordinary identifiers of at least this many characters are samples.
SAMPLE_LEAST = 8
#: Characters an ordinary sample has for each change of class; a capital before a small letter is no change.
PER_CHANGE = 4
#: Nats by which the random model must explain a token better than the ordinary one.
THRESHOLD = 12.0
SMOOTHING = 0.5
#: Pairs' worth of the characters' own frequencies behind each row of a model.
BACKED = 20.0
#: Part of the random model that is uniform over the alphabet.
UNIFORM = 0.5

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
N_STATES = len(ALPHABET) + 1  # the last one is the start of a token

SCANNED = (
    "doc_id long, spans array<struct<kind:int,start:int,end:int>>, "
    "judged array<struct<start:int,end:int,value:string>>, labelled array<string>, pairs array<struct<label:int,pair:int,n:long>>"
)


def _pairs(code: np.ndarray) -> np.ndarray:
    """Pair numbers of one token's character codes, the start state first."""
    return np.concatenate([[N_STATES - 1], code[:-1]]) * N_STATES + code


def _scanner():
    assign, access, digits = re.compile(ASSIGN, re.I | re.A), re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{%d,}" % HEX_LEAST)
    code = np.full(256, 255, np.uint8)
    for i, ch in enumerate(ALPHABET):
        code[ord(ch)] = i
    is_hex, is_letter, joined = np.zeros(256, bool), np.zeros(256, bool), code != 255
    is_hex[[*range(48, 58), *range(97, 103)]] = True
    is_letter[[*range(65, 91), *range(97, 123)]] = True
    kind = np.zeros(256, np.uint8)  # 0: a separator
    kind[65:91], kind[97:123], kind[48:58] = 1, 2, 3
    joined[128:] = True  # a letter outside ASCII belongs to the token and makes it an ordinary word

    def of_text(text: str, hexes: bool):
        found = []
        if "=" in text or ":" in text:
            found += [(0, m.start(), m.end(), m.start(2)) for m in assign.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
        if "AKIA" in text:
            found += [(1, m.start(), m.end(), m.start()) for m in access.finditer(text) if len(m[0]) >= ACCESS_LEAST]
        if hexes:
            found += [(2, m.start(), m.end(), m.start()) for m in digits.finditer(text)]
        return found

    def batches(source):
        for whole in source:
            for part in slices(whole, "text"):
                data, offsets = utf8(part.column("text"))
                n = len(offsets) - 1
                s, e = runs(is_hex[data], offsets)
                has_hex = np.zeros(n, bool)
                has_hex[np.searchsorted(offsets, s[e - s >= HEX_LEAST], "right") - 1] = True
                texts = [bytes(data[a:b]).decode() for a, b in zip(offsets, offsets[1:])]
                spans, labelled, counts, taken = [], [[] for _ in range(n)], np.zeros((2, N_STATES * N_STATES), np.int64), np.zeros(len(data) + 1, bool)
                for i, text in enumerate(texts):
                    found = of_text(text, has_hex[i])
                    for _, start, end, value_at in found:
                        at = offsets[i] + len(text[:start].encode())
                        taken[at : at + len(text[start:end].encode())] = True
                        labelled[i].append(text[value_at:end])
                        values = code[np.frombuffer(text[value_at:end].encode(), np.uint8)]
                        values = values[values != 255].astype(np.int64)
                        if len(values):
                            np.add.at(counts[1], _pairs(values), 1)
                    spans.append([{"kind": k, "start": a, "end": b} for k, a, b, _ in sorted(found, key=lambda x: (x[1], x[0]))])
                s, e = runs(joined[data], offsets)
                long = e - s >= SAMPLE_LEAST
                s, e = s[long], e[long]
                wide = np.concatenate([[0], np.cumsum(data >= 128)])
                letter = np.concatenate([[0], np.cumsum(is_letter[data])])
                free = np.concatenate([[0], np.cumsum(taken[:-1])])
                ok = (wide[e] == wide[s]) & (free[e] == free[s])
                s, e = s[ok], e[ok]
                now = kind[data]
                change = np.zeros(len(data) + 1, np.int64)  # at i: between the characters before and at i - 1
                change[2:] = (now[1:] != now[:-1]) & (now[1:] > 0) & (now[:-1] > 0) & ~((now[:-1] == 1) & (now[1:] == 2))
                change = np.cumsum(change)
                calm = PER_CHANGE * (change[e] - change[s + 1]) <= e - s
                inside = np.zeros(len(data) + 1, np.int32)
                np.add.at(inside, s[calm], 1)
                np.add.at(inside, e[calm], -1)
                at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
                if len(at):
                    before = code[data[at - 1]].astype(np.int64)
                    head = np.zeros(len(data), bool)
                    head[s[calm]] = True
                    before[head[at]] = N_STATES - 1
                    counts[0] += np.bincount(before * N_STATES + code[data[at]], minlength=N_STATES * N_STATES)
                judged = [[] for _ in range(n)]
                wanted = (e - s >= JUDGED_LEAST) & (letter[e] > letter[s])
                for a, b in zip(s[wanted].tolist(), e[wanted].tolist()):
                    row = int(np.searchsorted(offsets, a, "right")) - 1
                    start = len(bytes(data[offsets[row] : a]).decode())
                    judged[row].append({"start": start, "end": start + b - a, "value": bytes(data[a:b]).decode()})
                label, pair = np.nonzero(counts)
                pairs = [{"label": int(x), "pair": int(y), "n": int(counts[x, y])} for x, y in zip(label, pair)]
                yield pa.record_batch(
                    [
                        pa.array(part.column("doc_id").to_pylist(), pa.int64()),
                        pa.array(spans, pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))),
                        pa.array(judged, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))),
                        pa.array(labelled, pa.list_(pa.string())),
                        pa.array([pairs if i == 0 else [] for i in range(n)], pa.list_(pa.struct([("label", pa.int32()), ("pair", pa.int32()), ("n", pa.int64())]))),
                    ],
                    names=["doc_id", "spans", "judged", "labelled", "pairs"],
                )

    return batches


def scan(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scanner(), SCANNED)


def train(scanned: DataFrame) -> np.ndarray | None:
    """Log-ratio of each character pair, random over ordinary. At most 2 * 67**2 sums come to the driver."""
    sums = scanned.select(F.explode("pairs").alias("p")).groupBy("p.label", "p.pair").agg(F.sum("p.n").alias("n")).collect()
    counts = np.zeros((2, N_STATES, N_STATES))
    for label, pair, n in sums:
        counts[label].flat[pair] += n
    if not any(label == 1 for label, _, _ in sums):
        return None
    counts = counts[:, :, :-1]
    single = counts.sum(axis=1, keepdims=True) + SMOOTHING
    single /= single.sum(axis=2, keepdims=True)
    p = (counts + BACKED * single) / (counts.sum(axis=2, keepdims=True) + BACKED)
    p[1] = (1 - UNIFORM) * p[1] + UNIFORM / len(ALPHABET)
    return np.log(p[1]) - np.log(p[0])


def score(value: str, ratio: np.ndarray) -> float:
    """Log-likelihood ratio of a token, random over ordinary; characters outside the alphabet are passed over."""
    seq = np.array([i for i in map(ALPHABET.find, value) if i >= 0], np.int64)
    return float(ratio[np.concatenate([[N_STATES - 1], seq[:-1]]), seq].sum()) if len(seq) else 0.0


def held_back(docs: DataFrame, threshold: float = THRESHOLD, one_in: int = 5) -> DataFrame:
    """Rows (label, n, n_random): of ``n`` distinct unseen samples that are long enough, how many the models call random.

    Models are trained on texts whose hash is not divisible by ``one_in``; samples are those of the other
    texts that the training texts do not hold, label 1 the values of base spans, 0 the other tokens.
    """
    fold = F.crc32(F.coalesce(F.col("text").cast("string"), F.lit(""))) % one_in == 0
    known = stage(scan(docs.filter(~fold)), "secret-known")
    unseen = stage(scan(docs.filter(fold)), "secret-unseen")
    ratio = train(known)

    def samples(scanned):
        labelled = scanned.select(F.lit(1).alias("label"), F.explode("labelled").alias("value"))
        plain = scanned.select(F.lit(0).alias("label"), F.explode("judged.value").alias("value"))
        return labelled.unionAll(plain).filter(F.length("value") >= JUDGED_LEAST).distinct()

    def batches(source):
        for part in source:
            hit = [ratio is not None and score(v, ratio) >= threshold for v in part.column("value").to_pylist()]
            yield pa.record_batch([part.column("label"), pa.array([int(h) for h in hit], pa.int64())], names=["label", "hit"])

    fresh = samples(unseen).join(samples(known), ["label", "value"], "left_anti")
    return fresh.mapInArrow(batches, "label int, hit long").groupBy("label").agg(
        F.count("*").alias("n"), F.sum("hit").alias("n_random")
    )


def judge(scanned: DataFrame, ratio: np.ndarray | None, threshold: float = THRESHOLD) -> DataFrame:
    """Base and added spans of each document, with the digests of the contract."""
    schema = (
        "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string"
    )

    def added(tokens):
        if ratio is None:
            return []
        return [{"kind": 3, "start": t["start"], "end": t["end"]} for t in tokens if score(t["value"], ratio) >= threshold]

    def batches(source):
        for part in source:
            rows = []
            for doc_id, spans, tokens in zip(*(part.column(c).to_pylist() for c in ("doc_id", "spans", "judged"))):
                text = lambda xs: ",".join(f"{KINDS[x['kind']]}:{x['start']}:{x['end']}" for x in xs)
                every = sorted(spans + added(tokens), key=lambda x: (x["start"], x["kind"])) if tokens else spans
                n = [0, 0, 0, 0]
                for x in every:
                    n[x["kind"]] += 1
                rows.append((doc_id, *n, hashlib.sha256(text(spans).encode()).hexdigest(), text(every)))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            names = ["doc_id", "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=names)

    return scanned.select("doc_id", "spans", "judged").mapInArrow(batches, schema)


def secret_scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    scanned = stage(scan(docs), "secret-scan")
    return judge(scanned, train(scanned), threshold)


@query("op2_secret_scan")
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))
