"""Counting the n-grams of labelled texts takes memory by the piece, not by the task's texts."""

import tracemalloc

import numpy as np
import pandas as pd

from plumbline.llm import toxicity


def test_a_task_that_counts_ngrams_stays_small():
    letters = np.random.default_rng(5).integers(97, 123, 1_200_000).astype(np.uint8).tobytes().decode()
    texts = [letters[at:at + 3000] for at in range(0, len(letters), 3000)]
    frame = pd.DataFrame({"text": texts, "toxic": np.arange(len(texts), dtype=np.int32) % 2})
    tracemalloc.start()
    got = list(toxicity._presence([frame]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6, peak
    assert sum(map(len, got)) == pd.concat(got)["bucket"].nunique()
