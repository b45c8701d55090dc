"""What a worker of the pipeline's stages holds besides its batch."""

import re
import subprocess
import sys
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from foldline.llm import decontam, jaccard, langid, pii

ROWS, WORDS = 3_000, 300
NAMES = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "c", "cab"]
LANGS = ["en", "de", "fr", "es"]


def batch():
    """Some 5 MB of text, nearly all words distinct."""
    rng = np.random.default_rng(7)
    letters = np.frombuffer(b"abcdefgh", np.uint8)
    text = [" ".join(w.tobytes().decode() for w in letters[rng.integers(0, 8, (WORDS, 5))]) + f" mail{i}@example.com" for i in range(ROWS)]
    return pa.RecordBatch.from_arrays([pa.array(range(ROWS), pa.int64()), pa.array(text), pa.array([LANGS[i % 4] for i in range(ROWS)])], names=["doc_id", "text", "lang"])


def model():
    prob = np.random.default_rng(3).random((len(NAMES) + 1, len(LANGS))) + 0.1
    return {"pieces": NAMES, "langs": LANGS, "prob": (prob / prob.sum(axis=0)).astype(np.float32)}


def pairs(b):
    return pa.RecordBatch.from_arrays([b.column(0), b.column(0), b.column(1), b.column(1)], names=["x", "y", "text_x", "text_y"])


#: Most MB, and the worker's function.
STAGES = {
    "expect": (100, lambda: langid._expect(NAMES, LANGS, model()["prob"].astype(float))),
    "predict": (40, lambda: langid._predict(model())),
    "identified": (40, lambda: langid._identified(model(), "text", "lang", 0.0)),
    "signatures": (25, lambda: jaccard._signatures(5)),
    "prefixes": (25, lambda: jaccard._prefixes(5, 80, 4, bytes(1 << jaccard.SKETCH_BITS))),
    "linked": (25, lambda: jaccard._linked(5, 80)),
    "clean": (25, lambda: decontam._clean(decontam.Index([(1, "one two three four five six seven")], 5, 80), "text")),
    "redact": (4, lambda: pii._redact({"unary": {}, "skip": np.zeros((pii.LABELS, pii.LABELS)), "chain": np.zeros((pii.LABELS, pii.LABELS)), "rounds": 1, "accept": 2.0}, "text")),
}


@pytest.mark.parametrize("stage", STAGES)
def test_a_worker_holds_little_besides_its_batch(stage):
    most, run = STAGES[stage]
    b = pairs(batch()) if stage == "linked" else batch()
    tracemalloc.start()
    try:
        rows = sum(out.num_rows for out in run()(iter([b])))
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    if stage != "prefixes":  # a row for each posting
        assert rows == {"expect": 1, "signatures": ROWS + jaccard.SLICES}.get(stage, ROWS)
    assert peak < most


def kept(stage):
    """MB of its own that this process holds more than before, once the task has ended."""
    own = lambda: int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1e3
    b, before = batch(), own()
    for _ in STAGES[stage][1]()(iter([b])):
        pass
    return own() - before


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
@pytest.mark.parametrize("stage", ["expect", "identified", "signatures"])
def test_a_worker_gives_back_what_its_task_held(stage):
    here = Path(__file__)
    code = f"import sys; sys.path[:0] = [{str(here.parent)!r}, {str(here.parents[2])!r}]; import test_memory; print(test_memory.kept({stage!r}))"
    assert float(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=120).stdout) < 25
