"""Line dedup and the Jaccard join against plain versions: classes by share, links of all lines, recall in deep nodes."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tidemark.llm import chosen_path, line_dedup

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def normal_lines(text):
    return [(place, " ".join(line.lower().split())) for place, line in enumerate((text or "").split("\n")) if line.strip()]


def plain(rows, tau, near, cover):
    """{doc_id: (removed, n_links, class_id)} by comparing all lines with all lines; ids are distinct."""
    lines = {d: normal_lines(t) for d, t in sorted(rows)}
    first = {}
    for d, mine in lines.items():
        for place, line in mine:
            first.setdefault(line, (d, place))
    known = sorted(first)
    pairs = [(a, b) for i, a in enumerate(known) for b in known[i + 1 :] if abs(len(a) - len(b)) <= tau and max(len(a), len(b)) >= near]
    linked = {line: set() for line in known}
    ok = line_dedup.within([a for a, _ in pairs], [b for _, b in pairs], tau)
    for (a, b), near_enough in zip(pairs, ok):
        if near_enough:
            linked[a].add(b), linked[b].add(a)
    label = {d: d for d in lines}

    def tie(a, b):
        low, high = sorted((label[a], label[b]))
        for d in label:
            label[d] = low if label[d] == high else label[d]

    out = {}
    for d, mine in lines.items():
        removed = [p for p, line in mine if first[line] != (d, p) or any(first[o] < first[line] for o in linked[line])]
        shared = {}
        for line in {line for _, line in mine}:
            heads = {first[line][0]} if first[line][0] != d else {first[o][0] for o in linked[line] if first[o] < first[line]}
            for h in heads - {d}:
                shared[h] = shared.get(h, 0) + len(line)
        for h, size in shared.items():
            if size >= cover * sum(len(line) for line in {line for _, line in mine}):
                tie(d, h)
        for o, theirs in lines.items():
            if mine and [line for _, line in theirs] == [line for _, line in mine]:
                tie(d, o)
        out[d] = removed, sum(len(linked[line]) for _, line in mine)
    return {d: (*out[d], label[d]) for d in lines}


def found(docs, cover):
    return {r["doc_id"]: (r["removed"], r["n_links"], r["class_id"]) for r in line_dedup.classed(docs, cover=cover).collect()}


@pytest.mark.parametrize("cover", [0.0, 0.5])
def test_line_dedup_equals_all_pairs(spark, cover):
    r = random.Random(8)
    pool = ["".join(r.choice("abcdefgh ") for _ in range(r.randint(3, 60))) for _ in range(60)]
    rows = []
    for d in range(120):
        lines = [r.choice(pool[:5] if r.random() < 0.2 else pool) for _ in range(r.randint(0, 5))]
        for i, line in enumerate(lines):
            if r.random() < 0.4 and line:
                at = r.randrange(len(line))
                lines[i] = line[:at] + r.choice(["", "x", "yz"]) + line[at + 1 :]
        rows.append((d, "\n".join(lines) if d != 7 else None))
    rows += [(200, rows[3][1]), (201, rows[50][1])]
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(3), cover) == plain(rows, line_dedup.TAU, line_dedup.NEAR, cover)


def test_line_dedup_of_the_given_table_equals_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(docs, line_dedup.COVER) == plain(rows, line_dedup.TAU, line_dedup.NEAR, line_dedup.COVER)


def test_a_common_line_joins_only_documents_it_covers(spark):
    notice, whole = "all rights reserved by the owner", "a text of its own, number "
    rows = [(i, f"{notice}\n{whole * 3}{'abcdefgh'[i] * 9}") for i in range(6)]
    rows += [(6, notice), (7, rows[5][1]), (8, rows[5][1] + "!"), (9, ""), (10, None)]
    docs = spark.createDataFrame([*rows, (6, notice)], SCHEMA)
    assert {d: c for d, (_, _, c) in found(docs, 0.5).items()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 0, 7: 5, 8: 5, 9: 9, 10: 10}
    assert {c for d, (_, _, c) in found(docs, 0.0).items() if d < 9} == {0}


def test_line_table_has_every_line_and_link(spark):
    rows = [(1, "one line of more than twenty characters\n\nshort"), (2, "One  line of more than twenty character"), (3, "SHORT")]
    members, links = line_dedup.line_table(spark.createDataFrame(rows, SCHEMA))
    got = [(r["doc_id"], r["place"], r["id"]) for r in members.collect()]
    assert sorted(g[:2] for g in got) == [(1, 0), (1, 2), (2, 0), (3, 0)]
    number = {(d, p): i for d, p, i in got}
    assert number[1, 2] == number[3, 0] and [set(r) for r in links.collect()] == [{number[1, 0], number[2, 0]}]
    none = line_dedup.line_table(spark.createDataFrame([], SCHEMA))
    assert [t.count() for t in none] == [0, 0]


def test_runs_reach_the_recall_at_every_depth():
    r = np.random.default_rng(3)
    for levels in (1, 2, 3, chosen_path.DEPTH):
        runs = chosen_path.runs_for(0.99, levels)
        assert chosen_path.missed(runs, levels) <= 0.01 < chosen_path.missed(runs - 1, levels)
        # a pair in one node after the other: dealt alike by the first coordinate, or by a second one in one node of four
        n, c = 20000, chosen_path.COORDINATES
        share = (r.random((n, c)) < chosen_path.SIMILAR).mean(axis=1)
        lost = np.ones(n, bool)
        for _ in range(runs):
            first, second = r.random((n, levels)) < share[:, None], (r.random((n, levels)) < share[:, None] * (1 - 1 / c)) & (r.random((n, levels)) < 0.25)
            lost &= ~(first | second).all(axis=1)
        assert (lost | (share < chosen_path.SKETCHED)).mean() < 0.013
    with pytest.raises(ValueError):
        chosen_path.runs_for(1.0)


def test_pairs_in_deep_nodes_are_found(spark, monkeypatch):
    """Planted pairs at the threshold amid a family whose members resemble each other too little."""
    monkeypatch.setattr(chosen_path, "BUCKET", 24)
    r, pairs, c = np.random.default_rng(11), 400, chosen_path.COORDINATES
    base = np.arange(c)
    fresh = lambda: r.integers(1000, 1 << 30, c)
    rows = []
    for p in range(pairs):
        x = np.where(r.random(c) < 0.55, base, fresh())
        y = np.where(np.isin(np.arange(c), r.permutation(c)[:51]), x, fresh())  # 51 of 64 coordinates are shared
        rows += [(bytes([0]) + p.to_bytes(2, "big"), x.tolist()), (bytes([1]) + p.to_bytes(2, "big"), y.tolist())]
    sets = spark.createDataFrame(rows, "key binary, sketch array<int>")
    once = chosen_path.buckets(sets.withColumn("cluster", sets["key"]), range(chosen_path.runs_for(0.9999)))
    assert once[1] is not None and once[2] > 2
    label = {bytes(k): bytes(v) for k, v in chosen_path.components(chosen_path.candidates(sets)).collect()}
    at = [(label.get(bytes([0]) + p.to_bytes(2, "big")), label.get(bytes([1]) + p.to_bytes(2, "big"))) for p in range(pairs)]
    assert all(a is not None and a == b for a, b in at)
    assert len({a for a, _ in at}) > pairs / 2  # the family as a whole is not one cluster


def test_a_large_cluster_is_told_once_and_not_once_a_run(spark, monkeypatch):
    r, n, c = np.random.default_rng(5), 90, chosen_path.COORDINATES
    base, told = r.integers(0, 1 << 30, c), []
    rows = [(i.to_bytes(2, "big"), np.where(r.random(c) < 0.95, base, r.integers(0, 1 << 30, c)).tolist()) for i in range(n)]
    compared = chosen_path.compared
    monkeypatch.setattr(chosen_path, "compared", lambda nodes: told.append(compared(nodes).count()) or compared(nodes))
    sets = spark.createDataFrame(rows, "key binary, sketch array<int>")
    labels = chosen_path.components(chosen_path.candidates(sets)).collect()
    assert len(labels) == n and len({bytes(r["label"]) for r in labels}) == 1
    assert sum(told) < 1.5 * n


def test_a_few_sets_beside_a_known_cluster_are_compared_at_once(spark):
    """Sets that share much with a large known cluster but are not of it keep no node of it alive."""
    r, n, c = np.random.default_rng(8), 1500, chosen_path.COORDINATES
    base = r.integers(0, 1 << 30, c)
    like = lambda share: np.where(r.random(c) < share, base, r.integers(0, 1 << 30, c)).tolist()
    rows = [(b"m" + i.to_bytes(2, "big"), like(0.99), b"m") for i in range(n)]
    rows += [(b"s" + i.to_bytes(2, "big"), like(0.7), b"s" + i.to_bytes(2, "big")) for i in range(40)]
    sets = spark.createDataFrame(rows, "key binary, sketch array<int>, cluster binary")
    nodes, deep, depth = chosen_path.buckets(sets, range(3))
    assert depth == 1 and deep is None
    assert nodes.count() < 3 * 2 * len(rows)


def test_clusters_known_are_connected_and_not_told_anew(spark):
    sets = spark.createDataFrame([(b"a", b"a"), (b"b", b"a"), (b"c", b"c"), (b"d", b"d"), (b"e", b"d"), (b"f", b"f")], "key binary, cluster binary")
    edges = spark.createDataFrame([(b"b", b"c"), (b"e", b"d")], "a binary, b binary")
    got = {bytes(r["key"]): bytes(r["cluster"]) for r in chosen_path.clustered(sets, edges).collect()}
    assert got == {b"a": b"a", b"b": b"a", b"c": b"a", b"d": b"d", b"e": b"d", b"f": b"f"}
