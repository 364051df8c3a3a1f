import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from plumbline.llm import packing


def test_pieces_equal_the_tokenizer(spark, documents, sample):
    texts = sample | {5000: "", 5001: None, 5002: "a <|endoftext|> b  \n\n c", 5003: "word " * 5000, 5004: "it's   é"}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = packing.pack_documents(documents(list(texts.items()))).toPandas()
    for doc, rows in out.groupby("doc_id"):
        ids = np.array(tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids + [2], dtype="<u4")
        rows = rows.sort_values("piece")
        assert list(rows.start) == [0, *rows.length.cumsum()[:-1]] and rows.length.sum() == len(ids)
        assert list(rows.length[1:]) == [1024] * (len(rows) - 1)
        for r in rows.itertuples():
            assert zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32
    assert set(out.doc_id) == set(texts)
    for _, rows in out.sort_values("offset").groupby("sequence_id"):
        assert list(rows.offset) == [0, *rows.length.cumsum()[:-1]] and rows.length.sum() <= 1024


def test_repeated_rows_are_documents_of_their_own(spark, documents):
    out = packing.pack_documents(documents([(1, "a b c")] * 3 + [(None, "x")])).collect()
    assert len(out) == 4 and len({(r["sequence_id"], r["offset"]) for r in out}) == 4
    assert packing.pack_documents(documents([])).count() == 0


def test_best_two_fit():
    # greedy takes 6 and 3; 2 + 2 fill the gap that 3 leaves
    assert packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10) == [((6, 2, 2), 1), ((3,), 1)]
    for seed in range(5):
        r = random.Random(seed)
        lengths = Counter(min(100, max(1, int(r.lognormvariate(3, 1)))) for _ in range(3000))
        patterns = packing.best_two_fit(lengths, 100)
        packed = Counter()
        for bin_, times in patterns:
            assert sum(bin_) <= 100
            for n in bin_:
                packed[n] += times
        assert packed == lengths
        bound = -(-sum(n * c for n, c in lengths.items()) // 100)
        assert sum(t for _, t in patterns) <= 1.03 * bound + 1
        places = packing.slots(patterns)
        assert sum(end - first for _, first, end, *_ in places) == sum(lengths.values())


def test_one_at_a_time_gives_the_same_bins():
    lengths = Counter({50: 7, 30: 9, 21: 13, 7: 5, 100: 3})
    many = Counter()
    for bin_, times in packing.best_two_fit(lengths, 100):
        many[bin_] += times
    left, single = Counter(lengths), Counter()
    while +left:
        bin_ = packing.best_two_fit(+left, 100)[0][0]
        single[bin_] += 1
        left -= Counter(bin_)
    assert many == single
