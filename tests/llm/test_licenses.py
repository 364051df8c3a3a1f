import re
from math import ceil

import pytest

from plumbline.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, templates=licenses.TEMPLATES, containment=90):
    """n_words, n_base, first_word, last_word, base_labels, labels, score, templates met."""
    w = words_of(text)
    at, base, held, most, met = [], set(), set(), 0.0, set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        spots = [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
        at += spots
        base |= {label} if spots else set()
    for start in range(0, max(len(w) - 64, 1), 64):
        block = set(w[start:start + 128])
        for number, (label, template) in enumerate(templates):
            t = set(words_of(template))
            if t and len(t & block) * 100 >= containment * len(t):
                held, most, met = held | {label}, max(most, len(t & block) / len(t)), met | {number}
    score = max(most, 0.5 if at else 0.0)
    return (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | held)), score, len(met))


NAMES = [f"license_{c}" for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "templates")]


def check(spark, docs, texts, **options):
    got = sorted((tuple(r) for r in licenses.scan(docs, **options).select(*NAMES).collect()), key=repr)
    assert got == sorted((brute(t, **options) for t in texts), key=repr)
    return got


def test_against_brute_force(spark, documents, sample):
    texts = list(sample.values())
    templates = [t for _, t in licenses.TEMPLATES]
    texts += [f"{x[:400]} {t} {x[400:900]}" for x, t in zip(texts, templates)]
    texts += [re.sub("the ", "", t, count=1) for t in templates] + [t[:len(t) // 2] for t in templates] + [" ".join(templates)]
    got = check(spark, documents(list(enumerate(texts))), texts)
    assert sum(r[-1] for r in got) > len(templates)


@pytest.mark.parametrize("containment", [1, 50, 100])
def test_other_thresholds(spark, documents, containment):
    templates = (("a", "one two three four five six seven"), ("b", "five six seven eight"), ("none", " - "), ("c", "rare"), ("c", "ünî one"))
    texts = ["one two three", "five six seven eight nine", "rare", "ÜNÎ one ünî", "One TWO three four", "seven " * 200 + "six five", "", None]
    texts += [" ".join(f"x{i}" for i in range(k)) + " one two three four five six seven" for k in range(50, 260, 7)]
    check(spark, documents(list(enumerate(texts))), texts, templates=templates, containment=containment)


def test_odd_texts_ids_and_copies(spark, documents):
    texts = [None, "", "...", "MIT-License", "mit license", "MİT LICENSE", "K cc by", "cc  BY cc by", "permit license", "mit licenses",
             "gnu general public license " * 500, "Released under the MIT License. " * 3, "a" * 100_000, " mit license"]
    docs = documents([(i % 3, t) for i, t in enumerate(texts)] + [(None, t) for t in texts] + [(1, texts[11])] * 40)
    check(spark, docs, texts * 2 + [texts[11]] * 40)


def test_empty_table_no_templates_and_clashing_columns(spark, documents):
    assert licenses.scan(documents([])).count() == 0
    assert licenses.scan(documents([(1, "mit license")]), templates=()).first()["license_labels"] == "mit"
    row = licenses.scan(documents([(1, "mit license", "s", 5, 6)], ", license_score int, block int")).first()
    assert row["license_score"] == 0.5 and row["block"] == 6 and row["doc_id"] == 1
    with pytest.raises(ValueError):
        licenses.matches(documents([]), templates=(("x", " ".join(f"w{i}" for i in range(licenses.MOST_WORDS + 1))),))


def test_every_pair_once_and_no_python(spark, documents):
    docs = documents([(i, t) for i, (_, t) in enumerate(licenses.TEMPLATES)])
    pairs = [tuple(r) for r in licenses.matches(docs, keep=("doc_id",)).collect()]
    assert len({p[:3] for p in pairs}) == len(pairs) >= len(licenses.TEMPLATES)
    plan = licenses.scan(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_needed():
    assert all(licenses.needed(n, c) == max(1, ceil(n * c / 100 - 1e-9)) for n in range(1, 60) for c in (1, 50, 75, 90, 100))
