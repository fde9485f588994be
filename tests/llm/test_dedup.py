import random
from collections import defaultdict

import numpy as np

from loamtext.llm import line_dedup, substring


def prose(r, n):
    return " ".join("".join(r.choices("abcdefghij", k=r.randrange(2, 9))) for _ in range(n))


def test_gear_hash_is_the_rolling_one():
    data, h, want = bytes(random.Random(1).randrange(256) for _ in range(300)), 0, []
    for x in data:
        h = (2 * h + int(substring._GEAR[x])) % (1 << 32)
        want.append(h)
    assert substring.gear_hashes(data).tolist() == want
    assert substring.gear_hashes(b"a").tolist() == want[:0] + [int(substring._GEAR[97])]


def test_borders_resist_insertion():
    data = prose(random.Random(2), 400).encode()
    cut = lambda d: {d[a:b] for a, b in zip([0, *substring.chunk_ends(d)], substring.chunk_ends(d))}
    one, two = cut(data), cut(data[:700] + b"inserted" + data[700:])
    assert len(one - two) <= 4
    assert b"".join(data[a:b] for a, b in zip([0, *substring.chunk_ends(data)], substring.chunk_ends(data))) == data
    assert max(np.diff([0, *substring.chunk_ends(data)])) <= substring.MAX_BYTES


def brute_spans(rows, min_span):
    """Spans from a dictionary of all chunks."""
    seen, cuts = defaultdict(list), []
    for k, (i, t) in enumerate(rows):
        data = (t or "").encode()
        e = [0, *substring.chunk_ends(data)]
        cuts.append([(a, b, data[a:b]) for a, b in zip(e, e[1:])])
        for a, _, x in cuts[-1]:
            seen[x].append((k, a))
    out = []
    for k, cut in enumerate(cuts):
        runs, end = [], None
        for a, b, x in cut:
            if len(seen[x]) > 1:
                if a == end:
                    runs[-1][1] = b
                else:
                    runs.append([a, b])
                end = b
        out += [(rows[k][0], a, b) for a, b in runs if b - a >= min_span]
    return sorted(out, key=repr)


def test_spans_equal_brute_force(spark, odd, odd_rows, none):
    r = random.Random(3)
    passage = prose(r, 60)
    rows = [(k, prose(r, 50) + (" " + passage if k % 3 == 0 else "") + " " + prose(r, 50)) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((x.id, x.start, x.end) for x in substring.repeated_spans(df).collect()), key=repr)
    assert got == brute_spans(rows, substring.MIN_SPAN)
    assert {x[0] for x in got} == {k for k in range(30) if k % 3 == 0}
    # all but the first occurrence are to go
    out = {x.doc_id: x for x in substring.repeated_documents(df).collect()}
    assert out[0].removed_bytes == 0 and all(out[k].removed_bytes == out[k].span_bytes for k in out if k)
    got = sorted(((x.id, x.start, x.end) for x in substring.repeated_spans(odd).collect()), key=repr)
    assert got == brute_spans([x[:2] for x in odd_rows], substring.MIN_SPAN)
    assert substring.repeated_documents(none).count() == 0


def cleaned(df, **kw):
    return {r.doc_id: r.text for r in line_dedup.dedup_lines(df, **kw).collect()}


def test_recurring_templates_go_but_for_the_first(spark):
    rows = [(k, f"Page {k} of 90 printed here\nown text number {chr(97 + k)} stands here alone\nSession of user{k} closed at 1{k}:00 sharp\nOk.") for k in range(5)]
    rows += [(9, "Nothing of it recurs\n\nhere we go again")]
    out = cleaned(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out[0] == rows[0][1] and out[9] == rows[-1][1]
    assert out[3] == "own text number d stands here alone\nOk." or out[3] == "Ok."
    assert "Page" not in out[4] and "Session" not in out[4]


def test_leaf_groups_by_shared_positions(spark):
    body = ["the quick brown fox jumps over a lazy dog today", "the quick brown cat jumps over a lazy dog today", "the quick brown eel jumps over a lazy dog today"]
    rows = [(k, f"{b}\nunrelated {'abc'[k]} words in the {'xyz'[k]} remaining {'pqr'[k]} line {'uvw'[k]} {'klm'[k]}") for k, b in enumerate(body)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = cleaned(df)
    assert out[0] == rows[0][1] and out[1].startswith("unrelated") and out[2].startswith("unrelated")


def test_copies_of_one_text_are_no_recurrence(spark):
    rows = [(k, "one and the same line\nand another of the same") for k in range(6)]
    assert cleaned(spark.createDataFrame(rows, "doc_id long, text string")) == dict(rows)


def test_group_leaf_is_first_fit():
    blocks = np.array([[1, 2, 3, 4], [1, 2, 3, 9], [7, 2, 3, 4], [5, 5, 5, 5]])
    assert line_dedup.group_leaf(np.array([10, 11, 12, 13]), blocks, 0.75).tolist() == [10, 10, 12, 13]


def test_odd_rows_of_line_dedup(odd, odd_rows, none):
    out = line_dedup.dedup_lines(odd)
    assert out.columns == [*odd.columns, "_dropped"]
    got = sorted((tuple(r)[:12] for r in out.collect()), key=repr)
    assert got == sorted(odd_rows, key=repr)  # no line recurs in three texts
    assert line_dedup.dedup_lines(none).count() == 0


def test_a_template_goes_at_every_size(spark):
    name = lambda k: "".join("abcdefghij"[int(c)] for c in str(k))
    rows = [(k, f"Posted by user {name(k)} from here today") for k in range(2100)]
    out = cleaned(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out[0] == rows[0][1] and all(out[k] == "" for k in range(1, 2100))


def test_templates_equal_a_comparison_with_all():
    r = np.random.default_rng(4)
    for width, lead in ((5, 3), (8, 0), (13, 3), (24, 3)):
        rows = r.integers(0, 3, (400, width)).astype(np.int32)
        rows[:, :lead] = 7
        held, want = [], []
        for i, row in enumerate(rows):
            for t in held:
                same = (t[1] == row) & t[2]
                if same.sum() >= 0.75 * width:
                    t[2] = same
                    want.append(t[0])
                    break
            else:
                held.append([i, row, np.ones(width, bool)])
                want.append(i)
        found = line_dedup.Templates(width, 0.75, lead)
        assert [found.join(i, row) for i, row in enumerate(rows)] == want and len(held) < 400


def test_long_lines_are_compared_by_token(spark):
    words = [f"{a}{b}" for a in "klmnop" for b in "qrst"]
    # three variable words in three different eighths: 21 of 24 tokens are shared, but 5 of 8 blocks
    line = lambda k: " ".join(x + "xyz"[k] if p in (7, 13, 20) else x for p, x in enumerate(words))
    rows = [(k, line(k)) for k in range(3)]
    assert cleaned(spark.createDataFrame(rows, "doc_id long, text string")) == {0: rows[0][1], 1: "", 2: ""}


def brute_lines(rows, similarity=0.75):
    """Texts by a direct reading of the module's docstring; ``rows`` of (id, text) with different texts."""
    import re
    from hashlib import blake2b

    number = lambda s: int.from_bytes(blake2b(s.encode(), digest_size=8).digest(), "little", signed=True)
    lines, leaves = [], defaultdict(dict)
    for i, text in rows:
        for no, line in enumerate((text or "").split("\n") if text else []):
            tokens = re.sub(r"\S*(?:[0-9@]|://)\S*", "<*>", line).split()
            if len(tokens) < 3:
                continue
            key = number(" ".join(tokens))
            lines.append((i, text, no, key))
            if len(tokens) >= 5:
                leaves[len(tokens), *tokens[:3]][key] = tokens
    merged = {}
    for leaf in leaves.values():
        held = []
        for key, tokens in sorted(leaf.items()):
            for t in held:
                same = [a if a == b else None for a, b in zip(t[1], tokens)]
                if sum(x is not None for x in same) >= similarity * len(tokens):
                    merged[key], t[1] = t[0], same
                    break
            else:
                held.append([key, tokens])
    holders = defaultdict(set)
    for i, text, _, key in lines:
        holders[merged.get(key, key)].add((i is not None, i, text))
    gone = {(i, no) for i, text, no, key in lines if len(h := holders[merged.get(key, key)]) >= 3 and (i is not None, i, text) != min(h, key=lambda x: x[:2])}
    return {i: None if text is None else "\n".join(x for no, x in enumerate(text.split("\n")) if (i, no) not in gone) for i, text in rows}


def test_line_dedup_equals_brute_force(spark):
    r = random.Random(17)
    frames = [[r.choice("abcdefgh") * r.randrange(2, 5) for _ in range(r.randrange(2, 14))] for _ in range(12)]

    def line():
        words = list(r.choice(frames))
        for _ in range(r.randrange(4)):
            words[r.randrange(len(words))] = r.choice(["x1", "mail@x", "u" * r.randrange(1, 9), "v", "w"])
        return r.choice(["", " "]) + r.choice([" ", "  ", "\t"]).join(words)

    rows = [(k, "\n".join(line() for _ in range(r.randrange(6)))) for k in range(160)]
    seen = set()
    rows = [(k, t) for k, t in rows if not (t in seen or seen.add(t))] + [(1000, None)]
    want = brute_lines(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert cleaned(df) == want and sum(want[k] != t for k, t in rows) > 40
    assert cleaned(df, similarity=0.5) == brute_lines(rows, 0.5)


def test_carried_columns_may_have_any_name(spark):
    rows = [(k, "the same footer line stands here\n" + prose(random.Random(k), 20), 7, "a", "b", "c") for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _dropped int, template string, lines string, k1 string")
    out = line_dedup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "_dropped_in", "template", "lines", "k1", "_dropped"]
    assert {(r.doc_id, r["_dropped_in"], len(r["_dropped"])) for r in out.collect()} == {(0, 7, 0), (1, 7, 1), (2, 7, 1), (3, 7, 1)}


def brute_repeats(rows):
    """(id, span, removed bytes, first ids) with a byte-by-byte gear hash and dictionaries."""
    seen, cuts = defaultdict(list), []
    order = {}
    for k, (i, t) in enumerate(rows):
        data, h, last, at, ends = (t or "").encode(), 0, -substring.GAP, 0, []
        marks = []
        for p, x in enumerate(data):
            h = (2 * h + int(substring._GEAR[x])) % (1 << 32)
            if h & substring.MASK == 0:
                if p + 1 - last >= substring.GAP:
                    marks.append(p + 1)
                last = p + 1
        for p in [*marks, len(data)]:
            while p - at > substring.MAX_BYTES:
                at += substring.MAX_BYTES
                ends.append(at)
            if p > at:
                ends.append(p)
                at = p
        edges = [0, *ends]
        cuts.append([(a, b, data[a:b]) for a, b in zip(edges, edges[1:])])
        for a, _, x in cuts[-1]:
            seen[x].append((i is not None, i, order.setdefault(k, k), a))
    out = []
    for k, (i, _) in enumerate(rows):
        runs = []
        for a, b, x in cuts[k]:
            if len(seen[x]) > 1:
                if not runs or runs[-1][1] != a:
                    runs.append([a, a, 0, set()])
                first = min(seen[x], key=lambda y: (y[0], y[1] or 0, y[2], y[3]))
                runs[-1][1] = b
                runs[-1][2] += (b - a) * (first[2:] != (k, a))
                runs[-1][3].add(first[1])
        out += [(i, a, b, n, tuple(sorted(ids))) for a, b, n, ids in runs if b - a >= substring.MIN_SPAN]
    return sorted(out)


def test_removed_bytes_and_first_ids_equal_brute_force(spark):
    r = random.Random(23)
    passages = [prose(r, r.randrange(20, 80)) for _ in range(6)]
    rows = [(k, " ".join(r.choice([prose(r, 30), r.choice(passages)]) for _ in range(r.randrange(1, 6)))) for k in range(60)]
    got = substring.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted((x.id, x.start, x.end, x.removed_bytes, tuple(x.first_ids)) for x in got) == brute_repeats(rows)
    assert len(got) > 30


def test_rows_with_one_id_may_come_in_any_order(spark):
    rows = [(1, "x" * 300), (1, "y" * 40 + "x" * 300 + "z" * 40), (1, "x" * 300)]
    view = lambda some: sorted((x.id, x.start, x.end, x.removed_bytes) for x in substring.repeated_spans(spark.createDataFrame(some, "doc_id long, text string").coalesce(1)).collect())
    assert view(rows) == view(rows[::-1]) == view([rows[1], rows[0], rows[2]])
