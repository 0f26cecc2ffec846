"""Byte and word dedup against brute force, and their parts."""

import hashlib
import random

import numpy as np
import pytest

from likeness.llm import recompression, repeats, suffix_dedup
from likeness.llm.words import WordSpans


def brute(texts, units_of, join, window):
    """(n, removed, sha of the rest) for every row, by looking every window up in all smaller documents."""
    first = {}
    for doc, text in texts:
        units = units_of(text or "")
        for p in range(len(units) - window + 1):
            key = tuple(units[p : p + window])
            first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in texts:
        units = units_of(text or "")
        gone = [False] * len(units)
        for p in range(len(units) - window + 1):
            if first[tuple(units[p : p + window])] < doc:
                gone[p : p + window] = [True] * window
        rest = join(u for u, g in zip(units, gone) if not g)
        out.append((doc, len(units), sum(gone), hashlib.sha256(rest).hexdigest()))
    return sorted(out)


def test_bytes(docs, texts):
    found = suffix_dedup.suffix_dedup(docs).collect()
    expected = brute(texts, lambda t: list(t.encode()), bytes, 50)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in found) == expected
    assert {r.doc_id: r.text for r in found}[90] is None
    assert all((r.n_spans > 0) == (r.n_removed > 0) for r in found)


def test_words(docs, texts):
    found = recompression.substring_dedup(docs).collect()
    expected = brute(texts, lambda t: t.encode().split(), b" ".join, 50)
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found) == expected
    for r in found:
        if r.text is not None:
            assert hashlib.sha256(b" ".join(r.text.encode().split())).hexdigest() == r.kept_sha256


@pytest.mark.parametrize("hot", [1, 3])
def test_split_anchors(docs, texts, hot, monkeypatch):
    """Anchors with many fragments are split over shards and merged again."""
    monkeypatch.setattr(repeats, "HOT_FRAGMENTS", hot)
    found = recompression.substring_dedup(docs.repartition(12), with_text=False).collect()
    expected = brute(texts, lambda t: t.encode().split(), b" ".join, 50)
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found) == expected


def test_nothing(none):
    assert suffix_dedup.suffix_dedup(none).count() == 0
    assert recompression.substring_dedup(none).count() == 0


def test_suffix_array():
    rng = random.Random(5)
    for n, letters in ((1, b"a"), (9, b"ab"), (400, b"ab"), (900, b"abcdefgh"), (300, b"a")):
        text = bytes(rng.choice(letters) for _ in range(n))
        order, head, new = suffix_dedup.suffix_array(np.frombuffer(text, "u1"), 50)
        cut = [text[i : i + 50] + b"\0" * max(0, 50 - (n - i)) for i in order]
        assert cut == sorted(cut) and sorted(order) == list(range(n))
        shared = suffix_dedup.common_prefixes(np.frombuffer(text, "u1"), head, order, new, 50, lanes=7)
        for k in range(1, n):
            a, b = text[order[k - 1] :], text[order[k] :]
            real = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            # At the text's end a tie of padded suffixes may show as equal; windows never reach there.
            assert shared[k] == min(real, 50) or (not new[k] and n - max(order[k], order[k - 1]) < 64)


def test_anchor_is_the_windows_own():
    method = recompression.WordRepeats(50)
    rng = np.random.default_rng(1)
    core = rng.integers(0, 40, 50).astype("u8")
    keys = set()
    for _ in range(50):
        before, after = rng.integers(0, 40, rng.integers(0, 60)), rng.integers(0, 40, rng.integers(0, 60))
        keys.add(int(method._anchors(np.concatenate([before, core, after]).astype("u8"))[len(before)]))
    assert len(keys) == 1


def test_words_as_arrays():
    class Whole:
        data = " a bc\t\n dé".encode() + b"x y"
        starts = np.array([0, 11, 12, 14])

    spans = WordSpans(Whole)
    assert [Whole.data[a:b] for a, b in zip(spans.begin, spans.end)] == [b"a", b"bc", b"d\xc3\xa9", b"x", b"y"]
    assert len(set(spans.hashes().tolist())) == 5
