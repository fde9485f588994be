import re
from collections import Counter

from loamtext.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(words, words[1:], words[2:]))
    inside = {p for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_counts_equal_brute_force(spark, odd, odd_rows):
    got = sorted(map(tuple, quality.judge(odd).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()), key=repr)
    assert got == sorted(((r[0], *brute(r[1])) for r in odd_rows), key=repr)


def test_verdict_does_not_depend_on_the_order(odd):
    names = [r.name for r in quality.RULES]
    one = sorted(map(tuple, quality.judge(odd, order=names).collect()), key=repr)
    assert one == sorted(map(tuple, quality.judge(odd, order=names[::-1]).collect()), key=repr)


def test_order_is_by_rejection_per_cost_of_what_is_left():
    # rule 0 rejects rows 0-2 at cost 3, rule 1 rejects rows 0-1 at cost 1, rule 2 rejects row 2 at cost 1
    sample = [(0b011, [3, 1, 1]), (0b011, [3, 1, 1]), (0b101, [3, 1, 1]), (0, [3, 1, 1])]
    assert quality.order_rules(sample, ["a", "b", "c"]) == ["b", "c", "a"]


def test_empty_table(none):
    assert quality.judge(none).count() == 0


def test_against_sql(compare, small):
    compare("op1_quality_rules", small)


def test_costs_are_beyond_the_base_counts(spark, monkeypatch):
    import time

    class Slow(quality.Features):
        @property
        def n_repeat_words(self):  # made by the base rule: a rule that uses it pays nothing for it
            if "n_repeat_words" not in self.__dict__:
                time.sleep(0.002)
                self.__dict__["n_repeat_words"] = 0
            return self.__dict__["n_repeat_words"]

    df = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(60))) for k in range(40)], "doc_id long, text string").coalesce(1)
    rules = (quality.Rule("dear", lambda d: sum(range(30_000)) < 0 or len(d.words) > 0), quality.Rule("free", lambda d: d.n_repeat_words >= 0))
    assert quality.estimate_order(df, rules=rules) == ["free", "dear"]


def test_the_sample_is_bounded_and_taken_by_a_hash(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "order_rules", lambda sample, names: seen.extend(sample) or names)
    words = " ".join(f"concat(id, 'x{k}')," for k in range(60))[:-1]
    df = spark.range(5000).selectExpr("id as doc_id", f"concat_ws(' ', {words}) as text")
    rule = quality.Rule("late", lambda d: int(d.words[0][:-2]) >= 2500)
    quality.estimate_order(df, rules=(rule,), sample_rows=400)
    assert len(seen) == 400 and 150 < sum(mask for mask, _ in seen) < 250
