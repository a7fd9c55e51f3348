"""Filter audit, byte-level BPE and token alignment against plain versions, and their defined odd cases."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from tidemark.llm import byte_transducer, chosen_path, filter_audit, line_dedup, line_rules, spaced_seeds, token_alignment
from tidemark.llm.bpe_lexicon import byte_letters

SCHEMA = "doc_id long, text string, lang string, part string, mask int, row long, pairs string, digest string"
rng = random.Random(7)
WORDS = ["".join(rng.choice("abcdeéüñ中x") for _ in range(rng.randint(1, 8))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


TEXTS = [
    (1, prose(120, 1), "en"), (2, prose(120, 1), "de"), (3, prose(120, 1), "en"), (3, prose(120, 1), "en"), (4, None, "en"), (5, "", None),
    (6, "", "en"), (7, "A B C $ " * 60, "fr"), (None, prose(120, 1), "en"), (None, "zwei <|endoftext|> drei", None), (8, "x" * 5000 + " \n\n  y", "en"),
    (9, prose(9000, 2), "de"), (10, "İΣς ﬁ don't 12345 　É ₿ \U0001f600 Ᲊ՘ a▁b", "de"), (11, "  vorn und hinten  ", "fr"), (0, prose(120, 1), "fr"),
    (12, "HELLO", "en"), (13, "HELLO", "en"), (14, "▁", "en"), (15, "====" * 50 + "\t\r\n" * 20, "fr"),
]
LABELS = [(1, 1, 0), (1, 0, 1), (2, None, 1), (3, 1, None), (8, 1, 1), (12, 1, 0), (13, 1, 0), (None, 1, 1), (99, 1, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, la, "p", 5, 6, "q", "r") for d, t, la in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def labels_of(spark, rows=LABELS):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def plain_audit(rows, labels):
    marks = {d: (any(q == 1 for e, q, _ in labels if e == d), any(t == 1 for e, _, t in labels if e == d)) for d, _, _ in labels if d is not None}
    facts = []
    for d, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        smaller = any(e is not None and d is not None and e < d and (other or "") == text for e, other, _ in rows)
        fails = [
            len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            re.search(r"[#$%&*|]", text) is not None, smaller,
        ]
        facts.append((lang or "", fails, *marks.get(d, (False, False))))
    out = {}
    for part in {f[0] for f in facts}:
        own = [f for f in facts if f[0] == part]
        removed_of = Counter()
        for order in itertools.permutations(range(5)):
            left = own
            for step, k in enumerate(order, 1):
                gone = [f for f in left if f[1][k]]
                left = [f for f in left if not f[1][k]]
                removed_of[k] += len(gone)
                out[part, "".join("ABCDE"[i] for i in order), step] = [
                    len(left), len(gone), sum(f[1][k] for f in own) - len(gone), sum(f[1][k] and sum(f[1]) == 1 for f in own),
                    sum(f[2] for f in gone), sum(f[3] for f in gone),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed_of["ABCDE".index(order[step - 1])])
    return out


def test_audit_equals_removing_step_by_step(spark, docs):
    got = {tuple(r[:3]): list(r[3:]) for r in filter_audit.audit(docs, labels_of(spark)).collect()}
    assert got == plain_audit(TEXTS, LABELS) and len(got) == 120 * 5 * 4


def test_audit_of_empty_tables(spark, docs, none):
    assert filter_audit.audit(none, labels_of(spark)).count() == 0
    rows = filter_audit.audit(docs, labels_of(spark, [])).collect()
    assert len(rows) == 2400 and all(r["good_lost"] == r["toxic_lost"] == 0 for r in rows)


def test_gray_walk_equals_filtering_each_subset():
    r = random.Random(3)
    cells = [(mask, r.randint(0, 9), r.randint(0, 4), r.randint(0, 4)) for mask in range(32)]
    state = filter_audit.survivors(cells)
    for subset in range(32):
        left = [c for c in cells if not c[0] & subset]
        assert state[subset] == tuple(sum(c[k] for c in left) for k in (1, 2, 3))


RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(RANKS, "rb") as f:
        return byte_transducer.read_ranks(f)


@pytest.fixture(scope="module")
def library(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_library(docs, none, library):
    encoded = byte_transducer.encode(docs, RANKS, P.PATTERN).cache()
    want = sorted((-1 if d is None else d, library.encode_ordinary(t or ""), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, _ in TEXTS)
    rows = encoded.collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["ids"], r["decoded_sha256"]) for r in rows) == want
    assert all(r["n_tokens"] == len(r["ids"]) and r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest() for r in rows)
    texts = sorted(r["decoded"] for r in byte_transducer.decode(encoded, RANKS, P.PATTERN).collect())
    assert texts == sorted(t or "" for _, t, _ in TEXTS)
    assert byte_transducer.encode(none, RANKS, P.PATTERN).count() == 0


def test_transducer_on_random_pieces(ranks, library):
    machine = byte_transducer.Transducer(ranks, most_states=500)  # tables start anew all the time
    r = random.Random(5)
    for _ in range(400):
        text = "".join(r.choice("aaabcdeé=ß中") for _ in range(r.randint(1, 60)))
        for piece in re.findall(r"\w+|\W+", text):
            assert machine.encode(piece.encode()) == library.encode_ordinary(piece)
    assert machine.encode(b"a" * 20_000) == library.encode_ordinary("a" * 20_000)


def test_transducer_on_small_invented_ranks():
    """All strings of two letters up to eight bytes against plain merging, for merges whose order crosses."""
    for seed in range(6):
        r = random.Random(seed)
        ranks = {bytes([b]): b for b in range(256)}
        for k in range(12):
            pool = [t for t in ranks if set(t) <= {97, 98}]
            token = r.choice(pool) + r.choice(pool)
            if token not in ranks:
                ranks[token] = 1000 + r.randrange(10_000) * 16 + k
        machine = byte_transducer.Transducer(ranks)
        for n in range(1, 9):
            for piece in map(bytes, itertools.product(b"ab", repeat=n)):
                want = [ranks[piece]] if piece in ranks else [ranks[p] for p in machine.history(piece)[0]]
                assert machine.encode(piece) == want


def test_splitter_knows_every_character(library):
    split = byte_transducer.Splitter(P.PATTERN)
    exact = split.written_out()
    for at in range(0x80, 0x110000, 11):
        if not 0xD800 <= at < 0xE000:
            text = f"a{chr(at)}1{chr(at)}!{chr(at)} {chr(at)}"
            assert split(text) == exact(text)


def test_utf8_stream_in_parts_of_any_size():
    r = random.Random(9)
    for _ in range(500):
        data = bytes(r.choice([r.randrange(256), 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 65]) for _ in range(r.randrange(30)))
        stream, parts, at = byte_transducer.Utf8Stream(), [], 0
        while at < len(data):
            size = r.randrange(1, 6)
            parts.append(stream.feed(data[at : at + size]))
            at += size
        assert "".join(parts) + stream.close() == data.decode("utf-8", "replace")


def plain_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    letter = {c: i for i, c in enumerate(byte_letters())}
    count, rows = Counter(), []
    for d, text in texts:
        text = text or ""
        a = t.encode(" " + text, add_special_tokens=False).ids
        b = sp.encode(text)
        a_bytes = [bytes(letter[c] for c in t.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        raw = (" " + text).encode()
        if not text or b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
            rows.append((d, [], [], [], []))
            continue
        a_ends, b_ends = (list(itertools.accumulate(map(len, x))) for x in (a_bytes, b_bytes))
        links = [
            (a[i], b[j]) for i in range(len(a)) for j in range(len(b))
            if max(a_ends[i] - len(a_bytes[i]), b_ends[j] - len(b_bytes[j])) < min(a_ends[i], b_ends[j])
        ] if len(a) < 400 else token_links(a, b, a_ends, b_ends)
        groups, i, j = [], 0, 0
        for end in sorted(set(a_ends) & set(b_ends)):
            p, q = a_ends.index(end, i) + 1, b_ends.index(end, j) + 1
            groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
            i, j = p, q
        count.update(links)
        rows.append((d, a, b, groups, links))
    top = Counter()
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    return sorted(
        (-1 if d is None else d, len(a), len(b), len(g), len(k), sum(count[x] == top[x[1]] for x in k), sum(count[x] for x in k),
         hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for d, a, b, g, k in rows
    )


def token_links(a, b, a_ends, b_ends):
    out, j = [], 0
    for i, end in enumerate(a_ends):
        begin = a_ends[i - 1] if i else 0
        while b_ends[j] <= begin:
            j += 1
        k = j
        out.append((a[i], b[k]))
        while b_ends[k] < end:
            k += 1
            out.append((a[i], b[k]))
    return out


@pytest.mark.parametrize("most", [1 << 20, 200, 0])
def test_alignment_equals_plain_version(docs, most):
    """Also when most pairs, or all, are joined instead of looked up."""
    got = token_alignment.alignment(docs, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.PATTERN, most).collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == plain_alignment([(d, t) for d, t, _ in TEXTS])


def test_alignment_of_an_empty_table(none):
    assert token_alignment.alignment(none, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.PATTERN).count() == 0


def test_gallop_equals_search():
    r = np.random.default_rng(2)
    for n, m, top in [(0, 5, 9), (5, 0, 9), (1, 1, 2), (300, 20, 500), (20, 3000, 5000), (900, 950, 1000), (5000, 5000, 1 << 40)]:
        a, b = np.unique(r.integers(0, top, n)), np.unique(r.integers(0, top, m))
        assert (token_alignment.gallop(a, b) == np.searchsorted(b, a)).all()


CLASHING = "doc_id long, text string, source string, key string, row string, removed int, found int, cut int, cut_host int, cut_key int, _row int"


def test_columns_with_the_names_of_helpers_stay(spark):
    shared = "the very same line stands in all of these texts"
    rows = [(i, f"{shared}\n{prose(40, 50 + i)}", "s", "k", "r", 1, 2, 3, 4, 5, 6) for i in range(8)] + [(9, None, None, *[None] * 8)]
    docs = spark.createDataFrame(rows, CLASHING)
    bench = spark.createDataFrame([(1, prose(40, 53))], "item_id long, text string")
    for out in (
        line_dedup.dedup_lines(docs), line_rules.without_frequent(docs, share=0.1), spaced_seeds.clean(docs, bench), chosen_path.keep_one(docs),
    ):
        got = {r["doc_id"]: r for r in out.collect()}
        assert out.columns == docs.columns and got[0][3:] == rows[0][3:]
    assert 3 not in {r["doc_id"] for r in spaced_seeds.clean(docs, bench).collect()}


def test_blocks_by_weight_lose_no_link(spark, monkeypatch):
    texts = [prose(60, 4) + " " + " ".join(prose(1, 900 + i) for _ in range(i % 4)) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    whole = sorted(map(tuple, chosen_path.classes(docs).select("doc_id", "class_id", "n_links").collect()))
    monkeypatch.setattr(chosen_path, "BLOCK_GRAMS", 300)
    assert sorted(map(tuple, chosen_path.classes(docs).select("doc_id", "class_id", "n_links").collect())) == whole


def test_line_dedup_drops_what_is_left_of_a_copy(spark):
    body = "\n".join(prose(12, 70 + i) for i in range(9))
    docs = spark.createDataFrame([(1, body), (2, body + "\nnew"), (3, body + "\n" + prose(200, 80))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in line_dedup.dedup_lines(docs).collect()) == [1, 2, 3]
    assert sorted(r["doc_id"] for r in line_dedup.dedup_lines(docs, least_kept=0.2).collect()) == [1, 3]
