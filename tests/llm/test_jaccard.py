import random
import re

from plumbline.llm import jaccard

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(texts):
    sets = {}
    for i, text in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(seed=1, groups=12, size=14):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [r.choice(vocabulary) for _ in range(30)]
    texts = {}
    for g in range(groups):
        base = [r.choice(vocabulary) for _ in range(r.randint(4, 150))] + (passage if g % 2 else [])
        for k in range(size):
            words = list(base)
            for _ in range(r.randint(0, max(1, len(words) // 22))):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            texts[g * 100 + k] = " ".join(words)
    return texts


def check(documents, texts):
    out = jaccard.near_copies(documents(list(texts.items()))).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute(texts)


def test_components_equal_brute_force(spark, documents, sample):
    check(documents, sample | {i + 10_000: t for i, t in edited().items()})


def test_blocks_of_a_neighbourhood(spark, documents, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    check(documents, edited(seed=2))


def test_odd_texts(spark, documents):
    check(documents, {0: None, 1: "", 2: " \t\n", 3: "one", 4: "ONE", 5: "a b c d", 6: "A b  c\td", 7: "é É", 8: "a b c d e", 9: "x " * 3000, 10: "x " * 4000,
                      11: "a b c d e f"})


def test_repeated_and_empty(spark, documents):
    docs = documents([(5, "a b c d e f"), (5, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (None, None), (9, "else")])
    out = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in jaccard.near_copies(docs).collect())
    assert out == [(-1, -1), (-1, 3), (3, 3), (5, 3), (5, 3), (9, 9)]
    assert jaccard.near_copies(documents([])).count() == 0


def test_one_of_each_group_stays(spark, documents):
    docs = documents([(4, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (7, "other words than those here"), (8, "")])
    kept = jaccard.kept(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 7, 8]


def test_suffix_filter_and_verification_agree_with_sets():
    import numpy as np
    r = random.Random(5)
    sets = [np.unique(np.array([r.getrandbits(64) for _ in range(60)], dtype=np.uint64))]
    for _ in range(20):
        own = sets[0].copy()
        for k in r.sample(range(60), r.randint(0, 14)):
            own[k] = r.getrandbits(64)
        sets.append(np.unique(own))
    got = jaccard.linked(sets)
    parent = list(range(len(sets)))
    changed = True
    while changed:
        changed = False
        for a in range(len(sets)):
            for b in range(a):
                common = len(np.intersect1d(sets[a], sets[b]))
                if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common) and parent[a] != parent[b]:
                    low, high = sorted((parent[a], parent[b]))
                    parent = [low if p == high else p for p in parent]
                    changed = True
    assert got.tolist() == parent


def test_a_chain_through_a_row_without_an_id(spark, documents):
    words = [f"w{i}" for i in range(60)]
    first, middle, last = " ".join(words), " ".join(words[6:] + ["x"]), " ".join(words[12:] + ["x", "y", "z", "q"])
    assert not linked_by_brute(first, last) and linked_by_brute(first, middle) and linked_by_brute(middle, last)
    got = {(r["doc_id"], r["component_id"]) for r in jaccard.near_copies(documents([(1, first), (None, middle), (3, last)])).collect()}
    assert got == {(1, 1), (None, 1), (3, 1)}


def linked_by_brute(a, b):
    x, y = ({tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return 100 * len(x & y) >= 75 * len(x | y)


def test_documents_that_share_an_id_are_judged_by_their_own_text(spark, documents):
    a, b, c = (" ".join(f"{k}{i}" for i in range(30)) for k in "abc")
    near = b + " more"
    docs = documents([(1, a), (2, a), (2, c), (2, c), (5, b), (5, near), (None, a), (7, None), (7, "")])
    got = sorted(((r["doc_id"], r["text"]) for r in jaccard.kept(docs).collect()), key=repr)
    fives = [t for i, t in got if i == 5]
    assert len(fives) == 1 and fives[0] in (b, near)
    assert [g for g in got if g[0] != 5] == sorted([(1, a), (2, c), (None, a), (7, None), (7, "")], key=repr)
    extra = documents([(1, a, "s", 9), (2, a, "s", 8), (2, c, "s", 7)], ", node int")
    assert sorted((r["doc_id"], r["node"]) for r in jaccard.kept(extra).collect()) == [(1, 9), (2, 7)]
