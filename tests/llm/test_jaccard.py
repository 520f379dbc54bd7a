import random

import numpy as np
import pytest

from tests.llm import cases
from tidewell.llm import jaccard, simhash


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def kept_by_brute_force(rows):
    """Smallest id of each component of rows whose shingles have Jaccard similarity 0.8 at least."""
    rows = sorted(rows)
    sets = [shingles(r[1]) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return [r[0] for k, r in enumerate(rows) if label[k] == k]


def edited(text, r, edits):
    words = text.split()
    for _ in range(edits):
        words[r.randrange(len(words))] = f"changed{r.randrange(10**6)}"
    return " ".join(words)


def test_edited_copies_go_as_brute_force_says(spark):
    r = random.Random(3)
    texts = cases.filler(40, 5, 160)
    for t in texts[:30]:
        texts += [edited(t, r, edits) for edits in range(1, 9)]  # similarities on both sides of 0.8
    chain = [texts[31]]
    for _ in range(12):  # each links to the next only
        chain.append(edited(chain[-1], r, 2))
    texts += chain[1:] + [edited(texts[32], r, 1) for _ in range(60)]  # a bucket longer than others
    order = list(range(len(texts)))
    r.shuffle(order)
    rows = [(order[k], t, "en", "a", 1) for k, t in enumerate(texts)]
    got = sorted(x["doc_id"] for x in simhash.keep_one(cases.docs(spark, rows)).select("doc_id").collect())
    want = kept_by_brute_force(rows)
    assert got == want
    assert len(want) < len(rows) - 150


@pytest.mark.parametrize("block", [1500, 4_000_000])
def test_a_large_group_in_blocks(spark, monkeypatch, block):
    """Copies of one text with up to 25 edits, most on neither side of the threshold to each other, and a passage that many share."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    r = random.Random(8)
    base, passage, *others = cases.filler(120, 15, 130)
    texts = [edited(base, r, r.randrange(26)) for _ in range(160)] + [" ".join(edited(base, r, 2).split()[: r.randrange(90, 130)]) for _ in range(40)]
    texts += [f"{' '.join(t.split()[: r.randrange(12, 130)])} {passage}" for t in others[:80]] + others[80:]
    order = list(range(len(texts)))
    r.shuffle(order)
    rows = [(order[k], t, "en", "a", 1) for k, t in enumerate(texts)]
    got = sorted(x["doc_id"] for x in simhash.keep_one(cases.docs(spark, rows)).select("doc_id").collect())
    assert got == kept_by_brute_force(rows)
    assert 110 < len(got) < len(rows) - 40


def test_forest_connects_what_all_pairs_connect():
    r = np.random.default_rng(5)
    base = r.integers(-(1 << 62), 1 << 62, 200)
    sets = [np.unique(np.r_[r.permutation(base)[: r.integers(150, 200)], r.integers(-(1 << 62), 1 << 62, r.integers(0, 30))]) for _ in range(120)] + [base[:3], base[:1]]
    index = jaccard.Index(sets)
    core = np.array([len(s) for s in sets]) - index.alone()
    held = [set(s.tolist()) for s in sets]
    assert [len(h & held[7]) for h in held] == index.shared(sets[7]).tolist()
    assert [sum(not any(x in o for j, o in enumerate(held) if j != k) for x in h) for k, h in enumerate(held)] == index.alone().tolist()
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(held[i] & held[j]) >= 4 * len(held[i] | held[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    assert jaccard.forest(sets, core).tolist() == label
    assert jaccard.forest([], np.zeros(0)).tolist() == []


def test_repeated_and_null_ids_lose_no_text_and_keep_no_copy(spark):
    a, b, c = cases.filler(3, 9, 40)
    rows = [(1, a, "en", "a", 1), (2, a, "en", "a", 1), (2, b, "en", "a", 1), (None, c, "en", "a", 1), (None, c + " more", "en", "a", 1)]
    kept = simhash.keep_one(cases.docs(spark, rows)).select("doc_id", "text").collect()
    assert len(kept) == 3
    assert {(1, a), (2, b)} <= {tuple(r) for r in kept} and sum(r["doc_id"] is None for r in kept) == 1
