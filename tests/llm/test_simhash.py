import random

import pytest
import xxhash

from loamtext.llm import components, simhash


def brute_print(text):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def near(values, bits):
    return [(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= bits]


def signed(v):
    return v - (1 << 64) if v >> 63 else v


@pytest.mark.parametrize("limit", [3, 1000])
def test_links_keep_every_connection(spark, limit):
    r = random.Random(5)
    values = set()
    for _ in range(12):
        base = r.getrandbits(64)
        for _ in range(40):
            x = base
            for _ in range(r.randrange(4)):
                x ^= 1 << r.randrange(64)
            values.add(x)
    values = sorted(values, key=signed)
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    for bits in (2, 1):
        got = {x.node: x.label for x in components.components(simhash.links(df, bits, limit)).collect()}
        want = groups([(signed(a), signed(b)) for a, b in near(values, bits)], [signed(v) for v in values])
        assert {signed(v): got.get(signed(v), signed(v)) for v in values} == want


def test_components_of_a_long_chain_and_a_hub(spark):
    pairs = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5, 5), (7, 6)]
    df = spark.createDataFrame(pairs, "u long, v long")
    got = {x.node: x.label for x in components.components(df).collect()}
    assert got == {**{k: 0 for k in range(201)}, **{k: 1000 for k in range(1000, 1300)}}
    assert components.components(df.limit(0)).count() == 0


def test_odd_rows_equal_brute_force(odd, odd_rows, none):
    got = sorted(((x.id, x.fp % (1 << 64), x.component_id) for x in simhash.near_duplicates(odd).collect()), key=repr)
    prints = [brute_print(r[1]) for r in odd_rows]
    label = groups(near(sorted(set(prints)), 2), set(prints))
    least = {}
    for r, p in zip(odd_rows, prints):
        if r[0] is not None:
            least[label[p]] = min(r[0], least.get(label[p], r[0]))
    assert got == sorted(((r[0], p, least.get(label[p])) for r, p in zip(odd_rows, prints)), key=repr)
    assert simhash.near_duplicates(none).count() == 0


def test_one_of_each(odd, odd_rows, none):
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    prints = {brute_print(r[1]) for r in odd_rows}
    label = groups(near(sorted(prints), 2), prints)
    rows = [tuple(r) for r in kept.collect()]
    assert sorted(label[brute_print(r[1])] for r in rows) == sorted(set(label.values()))
    assert simhash.one_of_each(none).count() == 0


def test_the_number_of_lists_tells_the_shared_bytes(spark):
    assert len(simhash.BLOCKS) == 14 and [simhash.least_lists(k) for k in (0, 1, 2)] == [14, 7, 3]
    r = random.Random(3)
    values = [r.getrandbits(64)]
    for places in [(), (1,), (2, 5), (0, 3, 6), (1, 2, 3, 4), (0, 1, 2, 3, 4)]:
        values.append(values[0] ^ sum(r.randrange(1, 256) << 8 * p for p in places))
    df = spark.createDataFrame([(signed(v),) for v in {*values}], "fp long")
    met = {frozenset((x.u, x.v)): x.n for x in simhash.tallied(simhash._postings(df)).collect()}
    for v in values[2:]:
        shared = sum((values[0] ^ v) >> 8 * p & 255 == 0 for p in range(8))
        assert met.get(frozenset((signed(values[0]), signed(v))), 0) in {7: (7,), 6: (3,), 5: (1,), 4: (0, 1), 3: (0,)}[shared]


def test_the_tally_removes_candidates(spark):
    r = random.Random(4)
    base = r.getrandbits(64)
    # three differing bytes: such pairs meet in one list, and only the tally keeps them from being verified
    values = sorted({signed(base ^ sum(r.randrange(1, 256) << 8 * p for p in r.sample(range(8), 3))) for _ in range(8)} | {signed(base), signed(base ^ 5)}, key=abs)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    met = simhash.tallied(simhash._postings(df))
    kept = met.where(f"n >= {simhash.least_lists(2)}")
    assert kept.count() < met.count()
    assert {frozenset((x.u, x.v)) for x in kept.collect()} >= {frozenset((signed(base), signed(base ^ 5)))}


def test_one_of_each_carries_any_column(spark):
    df = spark.createDataFrame([(1, "a b c", 5, 6), (2, "a b c", 7, 8)], "doc_id long, text string, _k1 int, k2 int")
    assert [tuple(r) for r in simhash.one_of_each(df).collect()] == [(1, "a b c", 5, 6)]
    assert simhash.one_of_each(df).columns == df.columns
