import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsignal.llm import quality
from newsignal.llm import textkit as tk

TEXT = st.text(alphabet="ab é\n\t#|\x0b\x1c漢", max_size=60)


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), min_size=1, max_size=8), st.integers(1, 40))
def test_base_features(texts, target):
    got = []
    for _, _, buf, offs in tk.slices(pa.array(texts, pa.string()), target):
        base = quality.base_features(buf, offs, *quality._parse(buf, offs))
        got += np.stack(list(base.values()), axis=1).tolist()
    assert got == [brute(t or "") for t in texts]


def test_hashes_do_not_depend_on_place_or_segment():
    word = b"shingle"
    buf = np.frombuffer((word + b" ") * 30_000, np.uint8)  # over several segments
    starts, ends, first = tk.word_spans(buf, np.array([0, len(buf)]))
    assert len(starts) == 30_000 and len(np.unique(tk.span_hashes(buf, starts, ends))) == 1


def test_empty_input():
    assert list(tk.slices(pa.array([], pa.string()))) == []
    starts, ends, first = tk.word_spans(np.empty(0, np.uint8), np.array([0, 0]))
    assert not len(starts) and first.tolist() == [0, 0]


def test_a_lean_task_gives_memory_back_however_it_ends(monkeypatch):
    ends = []
    monkeypatch.setattr(tk, "give_back", lambda: ends.append(1))

    def broken(batches):
        yield next(batches)
        raise ValueError

    assert list(tk.lean(lambda x: (2 * b for b in x))(iter([1, 2]))) == [2, 4] and len(ends) == 1
    early = tk.lean(lambda x: x)(iter([1, 2]))
    next(early)
    early.close()
    assert len(ends) == 2
    with pytest.raises(ValueError):
        list(tk.lean(broken)(iter([1])))
    assert len(ends) == 3


def test_free_arrow_memory_goes_back():
    def held():
        return sum(int(line.split()[1]) for line in open("/proc/self/smaps_rollup") if line.startswith("Pss_Anon")) >> 10

    def run(batches):
        for _ in batches:
            many = [pa.array(np.zeros(1 << 17, np.int64)).take(pa.array(np.arange(1 << 17))) for _ in range(200)]  # 200 MB
            yield len(many)

    before = held()
    assert list(tk.lean(run)(iter([1]))) == [200]
    assert held() - before < 60
