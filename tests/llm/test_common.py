import random
import re

import numpy as np
import pyarrow as pa
import pytest

from metrolith.llm import common


@pytest.mark.parametrize("span", [64, 5000, 1 << 19])
def test_words_of_any_length_and_place(span, monkeypatch):
    """Equal words have equal hashes wherever they stand, and bounds are those of a split."""
    monkeypatch.setattr(common, "_SPAN", span)
    rng = random.Random(span)
    texts = ["", "a", "  ", "x" * 9000 + " y" * 3000, None, "Éa\tb\nc \x1fd"] + ["".join(rng.choice("abC \n\té") for _ in range(rng.randint(0, 3000))) for _ in range(40)]
    buf, at = common.text_buffer(pa.array(texts))
    for lower in (False, True):
        b, e, h, first = common.words(buf, at, lower)
        seen = {}
        for i, t in enumerate(texts):
            want = [w for w in re.split(b"[\x20\x09-\x0d]+", (t or "").encode()) if w]
            own = slice(int(first[i]), int(first[i + 1]))
            assert [buf[x:y].tobytes() for x, y in zip(b[own], e[own])] == want
            for w, x in zip(want, h[own].tolist()):
                assert seen.setdefault(w.lower() if lower else w, x) == x
        assert len(set(seen.values())) == len(seen)
    assert np.array_equal(common.unpacked(common.packed(at), np.int64), at)
