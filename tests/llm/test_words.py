import re

import numpy as np
import pyarrow as pa

from jobloom.llm import words as W

from .odd import WORD, rows


def spans(texts, **kw):
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    off = np.cumsum([0, *map(len, raw)])
    return data, off, W.words(data, off, **kw)


def test_words_of_each_text_and_equal_hashes():
    texts = [r[1] or "" for r in rows()]
    data, off, (s, e, h, bounds) = spans(texts)
    seen = {}
    for i, t in enumerate(texts):
        own = [data[a:b].tobytes().decode() for a, b in zip(s[bounds[i]:bounds[i + 1]],
                                                            e[bounds[i]:bounds[i + 1]])]
        assert own == WORD.findall(t)
        for w, x in zip(own, h[bounds[i]:bounds[i + 1]].tolist()):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_texts_that_touch_do_not_share_a_word():
    _, _, (s, e, h, bounds) = spans(["ab", "cd", "", "ab"])
    assert bounds.tolist() == [0, 1, 2, 2, 3] and h[0] == h[2] != h[1]


def test_pieces_of_a_long_text_agree_with_one_pass(monkeypatch):
    text = " ".join(r[1] or "" for r in rows(long_words=0))
    whole = spans([text])[2]
    monkeypatch.setattr(W, "BLOCK_BYTES", 97)
    cut = spans([text])[2]
    for a, b in zip(whole, cut):
        assert np.array_equal(a, b)


def test_lower_case_is_ascii_only():
    _, _, (_, _, h, _) = spans(["É é AB ab"], lower=True)
    assert h[2] == h[3] and h[0] != h[1]


def test_window_hashes_depend_on_every_word_and_its_place():
    h = W.mix(np.arange(1, 60, dtype=np.uint64))
    for width in (1, 2, 5, 8, 20):
        x = W.window_hashes(h, width)
        assert len(x) == len(h) - width + 1 and len(set(x.tolist())) == len(x)
        moved = np.concatenate([h[3:3 + width], h[:4]])
        assert W.window_hashes(moved, width)[0] == x[3]
    assert not len(W.window_hashes(h[:4], 5))


def test_blocks_hold_whole_rows_and_nulls_are_empty():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(["ab", None, "c" * 50, ""])],
                                       names=["doc_id", "text"])
    got = [(r.column(0).to_pylist(), d.tobytes().decode(), o.tolist())
           for r, d, o in W.blocks([batch.slice(1), batch], "text", 10)]
    assert [x for g in got for x in g[0]] == [2, 3, 4, 1, 2, 3, 4]
    assert all(g[2][-1] == len(g[1]) for g in got)


def test_terms_are_letters_digits_apostrophes():
    data, _, (s, e, _, _) = spans(["it's, WÖRD-two\t#3"], space=W.NOT_IN_TERM)
    assert [data[a:b].tobytes().decode() for a, b in zip(s, e)] == \
        re.findall(r"[\w']+", "it's, WÖRD-two\t#3")
