"""The segments and the suffix sort of the byte-wise dedup against plain versions, and how much they sort."""

from collections import Counter

import brute
import numpy as np
import pytest

from modelwatch.llm import suffix_dedup
from modelwatch.llm.common import mix64


def plain_segments(raw, length, gram):
    window = length - gram + 1
    prefixes = suffix_dedup.FIRST.prefixes(np.frombuffer(raw, np.uint8))
    grams = mix64(suffix_dedup.FIRST.of(prefixes, np.arange(len(raw) - gram + 1), gram)).tolist()
    least = [min(grams[i : i + window]) for i in range(len(raw) - length + 1)]
    out = []
    for i, v in enumerate(least):
        if out and out[-1][0] == v and i - out[-1][2] < window:
            out[-1][3] = i
        else:
            out.append([v, None, i, i])
    for s in out:
        s[1] = suffix_dedup.segment_digest(raw[s[2] : s[3] + length])
        s.append(grams[s[2] : s[3] + window].count(s[0]) > 1)
    return out


def test_segments_of_many_texts_are_those_of_each():
    texts = [brute.prose(n, i).encode() for i, n in enumerate([90, 300, 120, 90])]
    texts += [b"a" * 1500, b"abcab" * 300, texts[1], texts[0][:400], b"x" + texts[1][200:900] + b"y" * 450]
    own, *columns = suffix_dedup.segments(texts, 400, 40)
    want = [(i, *s) for i, t in enumerate(texts) for s in plain_segments(t, 400, 40)]
    assert list(zip(own.tolist(), *[c.tolist() for c in columns], strict=True)) == want
    assert any(w[-1] for w in want) and not all(w[-1] for w in want)


@pytest.mark.parametrize("length", [1, 3, 4, 5, 8, 9, 16, 31, 100])
def test_repeated_windows_of_any_length(length):
    random = np.random.default_rng(length)
    for letters in (1, 2, 40):
        texts = [bytes(random.integers(97, 97 + letters, length + n).astype(np.uint8)) for n in (0, 30, 200, 0, 7)]
        texts += [texts[2][10 : 10 + length + 40], texts[2][5 : 5 + length]]
        groups = [0, 0, 1, 1, 2, 2, 2]
        windows = [(g, t[i : i + length]) for g, t in zip(groups, texts, strict=True) for i in range(len(t) - length + 1)]
        count = Counter(windows)
        assert suffix_dedup.repeated_windows(texts, groups, length).tolist() == [count[w] > 1 for w in windows]


def test_suffixes_around_lone_strings_are_not_sorted(monkeypatch):
    """Of 60 texts of one group two share a passage: the sort does not go over all bytes of all texts."""
    sorted_, ranked = [], suffix_dedup.ranked
    monkeypatch.setattr(suffix_dedup, "ranked", lambda high, low: sorted_.append(len(high)) or ranked(high, low))
    random = np.random.default_rng(1)
    texts = [bytes(random.integers(97, 123, 800).astype(np.uint8)) for _ in range(60)]
    texts[7] = texts[7][:100] + texts[40][200:650] + texts[7][550:]
    hits = suffix_dedup.repeated_windows(texts, [0] * 60, 400).reshape(60, 401)
    assert np.flatnonzero(hits[7]).tolist() == list(range(100, 151)) and np.flatnonzero(hits[40]).tolist() == list(range(200, 251))
    assert hits.sum() == 102
    assert 0 < max(sorted_) < 0.1 * sum(map(len, texts))
