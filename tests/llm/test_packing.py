import random
from collections import Counter, defaultdict

import pytest

from cardloom.llm import packing as P


def check(sizes, capacity):
    stretches, used = P.plan(dict(Counter(sizes)), capacity)
    by = defaultdict(list)
    for size, rank, start, each in stretches:
        by[size].append((rank, start, each))
    room, large = Counter(), Counter()
    for size, n in Counter(sizes).items():
        for rank in range(n):
            first, start, each = max(x for x in by[size] if x[0] <= rank)
            at = start + (rank - first) // each
            room[at] += size
            large[at] += 3 * size > capacity
    assert max(room.values()) <= capacity and set(room) == set(range(used)) and max(large.values()) <= 2
    return used


@pytest.mark.parametrize("seed", range(40))
def test_plans_hold_everything(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 30, 64, 512])
    sizes = [rng.randint(1, capacity if rng.random() < 0.5 else max(1, capacity // 5)) for _ in range(rng.choice([1, 5, 50, 2000]))]
    used = check(sizes, capacity)
    first_fit = []
    for s in sorted(sizes, reverse=True):
        at = next((i for i, r in enumerate(first_fit) if r >= s), None)
        if at is None:
            first_fit.append(capacity - s)
        else:
            first_fit[at] -= s
    assert used <= 1.02 * len(first_fit) + 2


def test_documents(spark):
    rows = [(i, "word " * (i % 40)) for i in range(200)] + [(500, "long " * 100), (501, None), (502, ""), (None, "x"), (3, "word " * 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as tokens", "2 as rank")
    specs = spark.createDataFrame([(1, 32), (2, 64), (3, 0), (None, 8)], "spec_id int, capacity_tokens int")
    got = P.pack(docs, specs).collect()
    size = {r.doc_id: r.tokens for r in P.token_counts(docs).distinct().collect()}
    for spec, capacity in ((1, 32), (2, 64)):
        own = [r for r in got if r.spec_id == spec]
        fill, parts = Counter(), Counter()
        for r in own:
            parts[r.doc_id] += r.tokens
            if r.container_id is not None:
                fill[r.container_id] += r.tokens
        assert parts == Counter(size) and max(fill.values()) <= capacity
        assert all(n == 1 or size[d] > capacity for d, n in Counter(r.doc_id for r in own).items())
        assert {r.doc_id for r in own if r.container_id is None} == {d for d, n in size.items() if n == 0}


def test_empty(spark):
    assert P.pack(spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([(1, 8)], "spec_id int, capacity_tokens int")).count() == 0
    assert P.pack(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), spark.createDataFrame([], "spec_id int, capacity_tokens int")).count() == 0
