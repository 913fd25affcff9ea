"""Backoff automaton against a direct recursive computation."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from callrisk.llm import backoff_lm
from callrisk.llm.tasks import held_out

from .conftest import rows_of

D = backoff_lm.DISCOUNT


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + ["\n"]


def is_held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


def brute(rows, order):
    counts, kinds, seen = Counter(), defaultdict(set), Counter()
    for i, t in rows:
        if is_held_out(i):
            continue
        w = [" "] + tokens(t)
        for k in range(1, len(w)):
            for n in range(1, order + 1):
                if k - n + 1 >= 0:
                    gram = tuple(w[k - n + 1:k + 1])
                    counts[gram] += 1
                    kinds[gram[:-1]].add(gram)
                    seen[gram[:-1]] += 1
    total, types = seen[()], len(kinds[()])

    def p(history, word):
        if not history:
            return (counts[(word,)] + 0.5) / (total + 0.5 * (types + 1))
        low = p(history[1:], word)
        if not seen[history]:
            return low
        return max(counts[history + (word,)] - D, 0) / seen[history] + D * len(kinds[history]) / seen[history] * low

    out = []
    for i, t in rows:
        w = [" "] + tokens(t)
        base = sum(math.log10(p((), x)) for x in w[1:])
        full = sum(math.log10(p(tuple(w[max(0, k - order + 1):k]), w[k])) for k in range(1, len(w)))
        out.append((i, is_held_out(i), len(w) - 1, sum(counts[(x,)] > 0 for x in w[1:]), total, base, full))
    return sorted(out, key=str)


@pytest.mark.parametrize("name,order", [("documents", 2), ("documents", 3), ("edge", 2), ("edge", 1), ("edge", 4)])
def test_scores(name, order, request, monkeypatch):
    df = request.getfixturevalue(name)
    monkeypatch.setattr(backoff_lm, "SHARD_BYTES", 1 << 16)
    monkeypatch.setattr(backoff_lm, "SEGMENT", 64)
    got = backoff_lm.score(df, ~held_out(F.col("doc_id"), 1), order).collect()
    want = brute(rows_of(df), order)
    got = sorted(((r.doc_id, not r.train, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=str)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda r: str(r[:5])), sorted(want, key=lambda r: str(r[:5]))):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


def test_empty(empty):
    assert backoff_lm.score(empty, F.lit(True)).count() == 0


def local_automaton(rows, order):
    """The automaton of one shard that is the whole corpus, its counts taken directly."""
    import numpy as np

    from callrisk.llm import exchange
    from callrisk.llm.arrays import offsets_of, utf8
    import pyarrow as pa

    data, offsets = utf8(pa.array([t or "" for _, t in rows]))
    train = np.array([not is_held_out(i) for i, _ in rows])
    shard = backoff_lm.Shard.of_text(data, offsets, train)
    grams, histories, types = [], [], 0
    for n in range(1, order + 1):
        at, keys = shard.grams(n)
        distinct, one, which = np.unique(keys, return_index=True, return_inverse=True)
        count = np.bincount(which.reshape(-1), shard.train[at], len(distinct)).astype(np.int64)
        grams.append({"level": n, "answer": exchange.pack(np.stack([count, count > 0], axis=1).astype(np.int64))})
        if n == 1:
            types = int((count > 0).sum())
            continue
        h = shard.histories(n - 1)[0][at]
        _, of = np.unique(h, return_inverse=True)
        of = of.reshape(-1)
        seen = np.bincount(of, shard.train[at])
        kinds = np.bincount(of[one], count > 0, len(seen))
        histories.append({"level": n, "answer": exchange.pack(np.stack([seen, kinds], axis=1).astype(np.int64))})
    return shard, backoff_lm.Automaton(shard, grams, histories, order, int(shard.train.sum()), types)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_states_are_the_longest_known_histories(documents, order):
    """After every token the traversal stands in the state of the longest history seen in training."""
    import numpy as np

    rows = sorted(rows_of(documents))[:40]
    shard, machine = local_automaton(rows, order)
    known = set()
    for i, t in rows:
        if not is_held_out(i):
            w = [" "] + tokens(t)
            known |= {tuple(w[max(k - m, 0):k]) for k in range(1, len(w)) for m in range(1, order) if k >= m}
    names, checked = {0: ()}, 0
    for d, (i, t) in enumerate(rows):
        w = [" "] + tokens(t)
        state = machine.start[d:d + 1]
        for k in range(1, len(w)):
            history = next((tuple(w[k - m:k]) for m in range(min(order - 1, k), 0, -1) if tuple(w[k - m:k]) in known), ())
            # one state, one history: numbers are never shared
            assert names.setdefault(int(state[0]), history) == history
            state, _ = machine.step(state, shard.tokens[shard.first[d] + k - 1:shard.first[d] + k])
            checked += 1
    assert checked > 2000 and len(set(names.values())) == len(names) > 100
    # failure arcs drop the first word, and every state but the root has one
    for number, history in names.items():
        if history and history[1:] in names.values():
            assert names[int(machine.fail_target[number])] == history[1:]
    assert (np.diff(machine.key) > 0).all() and len(machine.fail_weight) >= len(names)


def test_segments_change_nothing(documents, monkeypatch):
    rows = sorted(rows_of(documents))[:60]
    shard, machine = local_automaton(rows, 3)
    whole = machine.read(shard)
    for size in (1, 7, 100, 10**6):
        monkeypatch.setattr(backoff_lm, "SEGMENT", size)
        assert machine.read(shard) == pytest.approx(whole, rel=1e-12)
