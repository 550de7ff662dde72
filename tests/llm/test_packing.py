import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from helpers import docs
from tokenizers import Tokenizer

from pagemill.llm import packing, tokens


def serial(totals, weights, length):
    """Deficit round-robin, window by window, in fractions: what each queue has been due after each window."""
    sent, left, out = [Fraction(0)] * len(totals), list(map(Fraction, totals)), []
    while sum(left):
        room = Fraction(length)
        while room and sum(left):
            of = sum(w for w, x in zip(weights, left) if x)
            step = min([room, *(x * of / w for w, x in zip(weights, left) if x)])
            for i, w in enumerate(weights):
                if left[i]:
                    took = min(left[i], step * w / of)
                    sent[i], left[i] = sent[i] + took, left[i] - took
            room -= step
        out.append(list(sent))
    return out


@pytest.mark.parametrize("totals,weights", [((5000, 3000, 700, 1), None), ((5000, 3000, 700, 1), (1, 2, 3, 1)), ((400, 10, 2000, 9, 77, 1300, 5), (5, 2, 1, 5, 2, 1, 5)), ((9,), (2,)), ((1, 1, 1), None)])
def test_schedule_is_serial_deficit_round_robin(totals, weights):
    schedule = packing.Schedule(totals, 97, weights)
    due = serial(totals, weights or totals, 97)
    assert len(due) == schedule.windows
    for q, total in enumerate(totals):
        path, places = schedule.path(q), np.arange(total)
        window = schedule.windows_of(path, places)
        assert (np.diff(window) >= 0).all()
        for w, x in enumerate(due):  # a token for each level of the tree, and one for each queue that ran empty before
            assert abs(int((window <= w).sum()) - x[q]) <= len(path) + (0 if weights is None else len(totals))
        doc, start, size, at, offset = schedule.pieces(q, places[::7], np.minimum(7, total - places[::7]))
        assert sum(size) == total and (np.repeat(at, size) == window).all()
    filled = sorted((int(w), int(o), int(k)) for q, n in enumerate(totals) for _, _, k, w, o in zip(*schedule.pieces(q, np.array([0]), np.array([n]))))
    at = {}
    for w, o, k in filled:
        assert o == at.get(w, 0)
        at[w] = o + k
    assert list(at.values()) == [97] * (sum(totals) // 97) + [sum(totals) % 97] * bool(sum(totals) % 97)


def test_places_are_exact_at_any_size():
    totals = (6 * 10**12, 10**12 + 7, 3, 5 * 10**12)
    huge = packing.Schedule(totals, 4096, (3, 2, 1, 3))
    for q, n in enumerate(totals):
        path = huge.path(q)
        places = np.unique(np.array([0, 1, n // 3, n // 2, n - 1]).clip(0, n - 1))
        for right, split in reversed(path):
            places = split.place(right, places)
        for right, split in path:  # a token and the one before it part just there
            a, b = split.left_of(places), split.left_of(places + 1)
            assert ((b - a) == (0 if right else 1)).all()
            places = places - a if right else a
        assert places.tolist() == np.unique(np.array([0, 1, n // 3, n // 2, n - 1]).clip(0, n - 1)).tolist()
    rng = np.random.default_rng(0)
    x, a = rng.integers(0, 1 << 44, 5000), rng.integers(1, 1 << 44, 5000)
    b = np.maximum(a, rng.integers(1, 1 << 44, 5000))
    assert packing.scaled(x, a, b).tolist() == [int(i) * int(j) // int(k) for i, j, k in zip(x, a, b)]
    assert packing.scaled(x, a, b, True).tolist() == [-(-int(i) * int(j) // int(k)) for i, j, k in zip(x, a, b)]


@pytest.mark.parametrize("text", ["Plain words, here's one.", "a\x1cb c\x85d\xa0e", "Straße ÉCOLE é", "日本 é ΑΣ", "", None, "<|endoftext|> x", "a" * 300])
def test_ids_equal_the_tokenizer(text):
    path = public_tokenizers.path(tokens.VOCABULARY)
    want = Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids + [2]
    assert np.frombuffer(tokens.token_ids(tokens.load(path), text), "<u2").tolist() == want


def fixture():
    rng = np.random.default_rng(0)
    out = [(i, " ".join(f"w{rng.integers(0, 999)}" for _ in range(int(rng.integers(1, 300)))), ["hot", "b", None][min(i % 9, 2)]) for i in range(200)]
    return out + [(500, None, "b"), (501, "", "c"), (None, "x y", "c"), (502, "long " * 9000, "b"), (7, "x y", "c"), (7, "x y", "c")]


@pytest.mark.parametrize("small", [None, False])
def test_packs_each_id_once_and_holds_the_mixture(spark, small):
    rows = fixture()
    got = packing.pack(docs(spark, rows).selectExpr("*", "1 as n", "2 as task"), length=256, small=small).collect()
    words = tokens.load(tokens.vocabulary_path())
    want = defaultdict(list)
    for i, t, s in rows:
        want[(i, s, tokens.token_ids(words, t))].append(1)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[(r["doc_id"], r["source"], r["doc_tokens"])].append(r)
        by_seq[r["sequence_id"]].append(r)
    ids = {(i, s, len(x) // 2): (x, len(k)) for (i, s, x), k in want.items()}
    assert set(by_doc) == set(ids)
    for key, pieces in by_doc.items():
        raw, copies = ids[key]
        whole = np.frombuffer(raw, "<u2").astype("<u4")
        assert sum(r["length"] for r in pieces) == copies * len(whole)
        for r in pieces:
            assert r["ids_crc32"] == zlib.crc32(whole[r["start"] : r["start"] + r["length"]].tobytes())
    total = sum(len(x) // 2 * len(k) for (_, _, x), k in want.items())
    assert sorted(by_seq) == list(range(-(-total // 256)))
    share = defaultdict(int)
    for r in got:
        share[r["source"]] += r["length"]
    for s, pieces in by_seq.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        if s < len(by_seq) - 1:
            assert at == 256
            for source, n in share.items():
                here = sum(r["length"] for r in pieces if r["source"] == source)
                assert abs(here - 256 * n / total) <= len(share)


def test_given_targets_hold_in_each_window_and_across_partitions(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{rng.integers(0, 99)}" for _ in range(30)), ["a", "a", "b", None][i % 4]) for i in range(1200)]
    df = docs(spark, rows).repartition(7)
    targets = {"a": 1.0, "b": 2.5, None: 0.5}
    got = packing.pack(df, length=200, targets=targets).collect()
    own = {s: sum(r["length"] for r in got if r["source"] == s) for s in targets}
    sent = {s: 0 for s in targets}
    for w in range(max(r["sequence_id"] for r in got)):
        here = {s: sum(r["length"] for r in got if r["sequence_id"] == w and r["source"] == s) for s in targets}
        for s in targets:
            sent[s] += here[s]
        if sent["b"] < own["b"]:  # all three last
            for s in targets:
                assert abs(here[s] - 200 * targets[s] / 4) <= 2
                assert abs(sent[s] - (w + 1) * 200 * targets[s] / 4) <= 2  # deficits are carried, whatever the partition
        elif sent["b"] - here["b"] == own["b"] and sent["a"] < own["a"]:
            assert abs(here["a"] - 200 * 1.0 / 1.5) <= 2
    assert len(df.rdd.glom().filter(len).collect()) > 1
    with pytest.raises(ValueError, match="no target"):
        packing.pack(df, targets={"a": 1.0})


@pytest.mark.parametrize("length", [512, 256])
def test_many_sources_keep_their_shares(spark, length):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"w{rng.integers(0, 99)}" for _ in range(int(rng.integers(1, 90)))), f"s{i % 40 if i % 3 else i % 5}") for i in range(900)]
    rows += [(1000, "rare", "once"), (1001, "x y", None)]
    got = packing.pack(docs(spark, rows).repartition(5), length=length).collect()
    share, by_seq, by_doc = defaultdict(int), defaultdict(list), defaultdict(list)
    for r in got:
        share[r["source"]] += r["length"]
        by_seq[r["sequence_id"]].append(r)
        by_doc[r["doc_id"]].append(r)
    total = sum(share.values())
    for pieces in by_doc.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["length"]
        assert at == pieces[0]["doc_tokens"]
    assert len(by_doc) == len(rows) and len(by_seq) == -(-total // length)
    for s, pieces in by_seq.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        if s < len(by_seq) - 1:
            assert at == length
            for source, n in share.items():
                assert abs(sum(r["length"] for r in pieces if r["source"] == source) - length * n / total) <= 3


def test_empty(spark):
    assert packing.pack(docs(spark, [])).count() == 0
