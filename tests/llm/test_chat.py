import random
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def talks(n=120, turns=(2, 7), seed=1):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        at = 0
        if c % 6 == 0:
            rows.append((c, at, "system", "You are helpful. " * r.randint(1, 3)))
            at += 1
        for k in range(r.randint(*turns)):
            user = k % 2 == 0
            text = "what is this?" if user else "\n".join("It is a long answer with words. " * r.randint(2, 6) for _ in range(r.randint(1, 4)))
            rows.append((c, at, "user" if user else "assistant", text))
            at += 1
    return rows


def recovered(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r["conv_id"] if r["conv_id"] is not None else -1, r["turn_no"])):
        out.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    return out


def test_held_out_turns_are_recovered(spark):
    rows = talks()
    known = [(c, t, role if c % 5 else None, x) for c, t, role, x in rows]
    raw = chat.transcribed(spark.createDataFrame(rows, SCHEMA)).drop("role")
    roles = spark.createDataFrame([(c, t, role) for c, t, role, _ in known], "conv_id long, turn long, role string")
    out = recovered(chat.format_chats(raw.join(roles, ["conv_id", "turn"])))
    truth = {}
    for c, _, role, x in rows:
        truth.setdefault(c, []).append((role, x.strip()))
    unseen = [c for c in truth if c % 5 == 0]
    hits = sum((Counter(truth[c]) & Counter(out.get(c, []))).total() for c in unseen)
    assert hits / sum(len(truth[c]) for c in unseen) > 0.9


def test_a_conversation_over_many_partitions_is_decoded_as_one(spark):
    rows = talks(12, (40, 60), seed=3)
    raw = chat.transcribed(spark.createDataFrame(rows, SCHEMA))
    few, many = chat.lines(raw, 1), chat.lines(raw, 7)
    chain = chat.fit(few)
    other = chat.fit(many)
    assert np.allclose(chain.step, other.step) and np.allclose(chain.start, other.start) and np.allclose(chain.symbol, other.symbol)
    assert recovered(chat.turns(chat.decode(many, chain))) == recovered(chat.turns(chat.decode(few, chain)))


def test_viterbi_equals_brute_force():
    r = np.random.default_rng(5)
    n = chat.STATES
    chain = chat.Chain(np.log(r.dirichlet(np.ones(n))), np.log(r.dirichlet(np.ones(n), n)), np.log(r.dirichlet(np.ones(4), n)))
    symbols = r.integers(0, 4, 5)

    def score(path):
        s = chain.start[path[0]] + chain.symbol[path[0], symbols[0]]
        for i in range(1, len(path)):
            s += chain.step[path[i - 1], path[i]] + chain.symbol[path[i], symbols[i]]
        return s

    best = max(np.ndindex(*[n] * 5), key=score)
    assert tuple(chat._viterbi(chain, symbols, None, None)) == best
    matrix = chat._matrix(chain, symbols[2:])
    halves = max((score((*a, *b)), (*a, *b)) for a in np.ndindex(n, n) for b in np.ndindex(n, n, n))
    assert halves[1] == best
    last = best[-1]
    tail = chat._viterbi(chain, symbols[2:], int(best[1]), int(last))
    assert tuple(tail) == best[2:] and matrix[best[1], last] == pytest.approx(score(best) - chain.start[best[0]] - chain.symbol[best[0], symbols[0]] - chain.step[best[0], best[1]] - chain.symbol[best[1], symbols[1]])


def test_odd_rows(spark):
    rows = [(1, 0, "user", "hi?"), (1, 0, "user", "hi?"), (1, 1, "assistant", None), (None, 0, "tool", "x"), (2, 0, None, ""), (3, 0, "assistant", "line\n" * 3000)]
    out = chat.format_chats(chat.transcribed(spark.createDataFrame(rows, SCHEMA)))
    assert {r["conv_id"] for r in out.collect()} >= {1, None, 3}
    assert all(r["rendered"].startswith(f"<|{r['role']}|>\n") and r["rendered"].endswith("\n<|end|>\n") for r in out.collect())
    assert chat.format_chats(chat.transcribed(spark.createDataFrame([], SCHEMA))).count() == 0
