import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from quernel.llm import textops
from quernel.llm.textops import Words, buffers, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
texts = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("aZ09 _é東.\n\x00")), st.text()), max_size=8)


def python_words(text):
    return WORD.findall((text or "").translate(LOWER))


@settings(max_examples=150, deadline=None)
@given(texts)
def test_words_are_those_of_the_pattern(rows):
    raw, offsets = buffers(pa.array([None if r is None else r.encode("utf-8", "ignore").decode() for r in rows], pa.string()))
    w = Words(raw, offsets)
    found = [[bytes(w.low[a:b]).decode() for a, b in zip(w.starts[i:j], w.ends[i:j])] for i, j in zip(w.offsets[:-1], w.offsets[1:])]
    assert found == [python_words(r.encode("utf-8", "ignore").decode() if r else r) for r in rows]
    flat = [x for own in found for x in own]
    same = {}
    for word, h in zip(flat, w.hashes.tolist()):
        assert same.setdefault(word, h) == h
    assert len(set(same.values())) == len(same)


def test_slices_give_the_same_words(monkeypatch):
    rows = ["one two three", "x" * 300, "", "four five " * 40]
    whole = Words(*buffers(pa.array(rows))).hashes
    monkeypatch.setattr(textops, "SLICE", 64)
    raw, offsets = buffers(pa.array(rows))
    cut = np.concatenate([w.hashes for _, _, w in words_of(raw, offsets)])
    assert (whole == cut).all()


def test_sliced_arrays():
    a = pa.array(["zz", "one", None, "two three"]).slice(1)
    raw, offsets = buffers(a)
    assert bytes(raw) == b"onetwo three" and offsets.tolist() == [0, 3, 3, 12]
