"""Alignment of tokenizations against whole-text encoding and plain Python, on odd texts too."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexiloom.llm import alignment

A, B = f"{alignment.TOKENIZERS}/{alignment.A_FILE}", f"{alignment.TOKENIZERS}/{alignment.B_FILE}"
pytestmark = pytest.mark.skipif(not os.path.exists(A), reason="no tokenizer files")


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(*alignment.read_files(A, B))


def whole(pair, text):
    """(id, end) of A and B over a whole text, or nothing."""
    if not text:
        return [], []
    full = (" " + text).encode()
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    if not pair.restored(full, a, b):
        return [], []
    ends = lambda ids, spelled: list(zip(ids, np.cumsum([len(spelled[i]) for i in ids]).tolist()))
    return ends(a, pair.a_bytes), ends(b, pair.b_bytes)


def overlaps(a, b):
    start_a = [0, *[e for _, e in a]]
    start_b = [0, *[e for _, e in b]]
    i = j = 0
    while i < len(a) and j < len(b):
        if max(start_a[i], start_b[j]) < min(a[i][1], b[j][1]):
            yield a[i][0], b[j][0]
        if a[i][1] <= b[j][1]:
            i, j = i + 1, j + (a[i][1] == b[j][1])
        else:
            j += 1


def brute(pair, texts):
    tokens = [whole(pair, t) for t in texts]
    links = [list(overlaps(a, b)) for a, b in tokens]
    count = Counter(x for found in links for x in found)
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for (a, b), found in zip(tokens, links):
        cuts = sorted({e for _, e in a} & {e for _, e in b})
        groups, low = [], 0
        for e in cuts:
            groups.append("|".join(",".join(str(i) for i, end in ids if low < end <= e) for ids in (a, b)))
            low = e
        text = ";".join(groups)
        out.append((len(a), len(b), len(cuts), len(found), sum(count[x] == best[x[1]] for x in found), sum(count[x] for x in found), text))
    return out, count


def texts():
    rnd = random.Random(4)
    words = ["the", "Antion", "thanedble,", "été", "señro.", "Ñdo***", "don't", "<|endoftext|>", "<s>", "<0x0A>", "日本語", "\U0001f600\U0001f468‍\U0001f469", "a　b", "x y", "1234567", "é"]
    gaps = [" ", " ", " ", "  ", "   ", "\n", " \n ", "\t", "  ", "  ", "\r\n", "\x1c ", "\x00 ", "\x7f "]
    out = [None, "", " ", "  ", "a", " a ", "\n", "a▁b c", "▁", "plain text▁", "<unk>", "﻿x  y"]
    for n in (1, 3, 8, 40, 300):
        out += ["".join(rnd.choice(words) + rnd.choice(gaps) for _ in range(n)) for _ in range(8)]
    return [*out, *out[12:20], "zq" * 3000, "the and attion " * 5000]


def test_against_whole_texts(spark, pair):
    plain = texts()
    want, count = brute(pair, plain)
    docs = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(plain)], "doc_id long, text string, chunk string").repartition(3)
    for chunk_bytes in (alignment.CHUNK_BYTES, 500):
        rows, pairs = alignment.align(docs, chunk_bytes=chunk_bytes)
        got = {r.doc_id or 0: tuple(r)[1:] for r in rows.collect()}
        assert [got[i] for i in range(len(plain))] == want
    assert {(r.a, r.b): r["count"] for r in pairs.collect()} == dict(count)
    hashed = {r.doc_id or 0: r.groups_sha256 for r in alignment.digest(docs).collect()}
    assert [hashed[i] for i in range(len(plain))] == [hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "" for w in want]


def test_no_documents(spark):
    rows, pairs = alignment.align(spark.createDataFrame([], "doc_id long, text string"))
    assert rows.count() == 0 and pairs.count() == 0
    rows, _ = alignment.align(spark.createDataFrame([(1, None), (1, ""), (None, "▁")], "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.n_a, r.count_sum, r.groups) for r in rows.collect()) == [(0, 0, 0, ""), (1, 0, 0, ""), (1, 0, 0, "")]


def test_bytes_that_are_no_text(spark):
    rows, _ = alignment.align(spark.sql("select 1L as doc_id, cast(unhex('61FF62') as string) as text union all select 2L, 'ab cd'"))
    assert {r.doc_id: r.n_a > 0 for r in rows.collect()} == {1: False, 2: True}


LOADED = []


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab'.,1é日 \n\t 　 \u0085᠎​\x1f\x0b\U0001f600"), min_size=1, max_size=40))
def test_stretches_are_encoded_as_in_the_text(text):
    if not LOADED:
        LOADED.append(alignment.Pair(*alignment.read_files(A, B)))
    pair = LOADED[0]
    full = (" " + text).encode()
    starts = [*alignment.stretch_starts(np.frombuffer(full, np.uint8), np.array([0])).tolist(), len(full)]
    parts = [full[a:b].decode() for a, b in zip(starts, starts[1:])]
    a, b = pair.encode(parts)
    assert sum(a, []) == pair.a.encode(" " + text, add_special_tokens=False).ids
    assert sum(b, []) == pair.b.encode(text)


def test_stretches_encoded_as_one_text(pair):
    rnd = random.Random(7)
    pool = [" the", "  x", " été", " señ\n", " \n", " a\t\t", " ", "  ", " b", " 日本", " c　", " ...", " <s>", " é"]
    for n in (1, 2, 5, 50):
        stretches = [rnd.choice(pool).encode() for _ in range(n)]
        ids, counts = alignment.encode_stretches(pair, stretches)
        want = pair.encode([x.decode() for x in stretches])
        for flat, c, w in zip(ids, counts, want):
            assert c.tolist() == [len(x) for x in w] and flat.tolist() == sum(w, [])
