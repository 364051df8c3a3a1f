import hashlib
import random

import numpy as np
import pytest

from plumbline.llm import suffixes


def brute(rows):
    """Per (doc_id, text) in order: bytes, removed, spans, digest of what is left."""
    seen, out = set(), {}
    for doc, text in rows:
        raw = (text or "").encode()
        covered = bytearray(len(raw))
        for p in range(len(raw) - 99):
            window = raw[p:p + 100]
            if window in seen:
                covered[p:p + 100] = b"\1" * 100
            seen.add(window)
        kept = bytes(b for b, c in zip(raw, covered) if not c)
        spans = sum(1 for i, c in enumerate(covered) if c and (i == 0 or not covered[i - 1]))
        out[doc] = (len(raw), sum(covered), spans, hashlib.sha256(kept).hexdigest())
    return out


def planted():
    r = random.Random(11)

    def prose(n):
        return "".join(r.choice("abcdefgh éß\n") for _ in range(n))

    passages = [prose(n) for n in (99, 100, 101, 150, 400)]
    texts = {i: prose(r.randint(0, 300)) + r.choice(passages) + prose(r.randint(0, 200)) + r.choice(passages) for i in range(60)}
    texts |= {100: "=" * 700, 101: "=" * 150, 102: "ab" * 200, 103: None, 104: "", 105: texts[3], 106: texts[3][:120], 107: texts[5][40:], 108: "ü" * 120}
    return texts


@pytest.mark.parametrize("crowd", [suffixes.CROWD, 3])
def test_equals_brute_force(spark, documents, crowd):
    texts = planted()
    out = suffixes.digests(documents(list(texts.items())), crowd).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out} == brute(sorted(texts.items()))


def test_chunks_of_a_long_text(spark, documents, monkeypatch):
    r = random.Random(2)
    part = "".join(r.choice("abcdefghij") for _ in range(260))
    text = part + "".join(r.choice("klmnop") for _ in range(700)) + part[:130]
    whole = [a.tolist() for a in suffixes.anchors(text.encode())]
    monkeypatch.setattr(suffixes, "CHUNK", 97)
    assert [a.tolist() for a in suffixes.anchors(text.encode())] == whole


def test_repeated_ids_and_nulls(spark, documents):
    a, b = "x" * 0 + "".join(map(chr, range(200, 330))), "".join(map(chr, range(400, 530)))
    out = suffixes.digests(documents([(1, a), (1, a), (1, b), (None, b), (2, a)])).collect()
    removed = sorted((r["doc_id"] or -1, r["n_removed"] > 0) for r in out)
    # the null id comes first, rows that repeat id and text are one document
    assert removed == [(-1, False), (1, False), (1, False), (1, True), (2, True)]
    assert suffixes.digests(documents([])).count() == 0


def test_sort_and_extensions():
    r = random.Random(4)
    rows = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 12))) for _ in range(300)]
    group = np.sort(np.array([r.randrange(9) for _ in rows]))
    matrix = np.zeros((300, 12), np.uint8)
    for i, row in enumerate(rows):
        matrix[i, :len(row)] = np.frombuffer(row, np.uint8)
    s = suffixes.Suffixes(matrix, np.array([len(x) for x in rows]))
    order = s.sort(group)
    assert [(group[i], rows[i]) for i in order] == sorted((group[i], rows[i]) for i in range(300))
    extensions = s.extensions(order, group)
    for k in range(1, 300):
        x, y = rows[order[k]], rows[order[k - 1]]
        common = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        assert extensions[k] == (common if group[order[k]] == group[order[k - 1]] else -1)
