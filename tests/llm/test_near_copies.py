"""Near copies: links that only the group step can find, doc_ids with several texts, planted families."""

import math
import random

import pytest

import corpus_pipeline
from framewright.llm import near_copies


def sets_of(rows, k):
    out = []
    for _, text in rows:
        w = (text or "").lower().split()
        out.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    return out


def brute(rows, k, percent):
    """(doc_id, size, component) of each row: components over rows that have a doc_id."""
    sets, root = sets_of(rows, k), list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    root[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(i)] = min(least.get(top(i), doc), doc)
    return sorted(((d is None, d or 0), len(sets[i]), None if d is None else least[top(i)]) for i, (d, _) in enumerate(rows))


def found(spark, rows, k=4, percent=85):
    groups = near_copies.near_copy_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), k, percent).collect()
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_shingles"], r["component_id"]) for r in groups)


def test_a_size_between_the_ends_asks_for_less(spark):
    """For n = 18 sizes 18 and 20 ask for 2 common prefix shingles, 19 for 1."""
    n = 18
    least = lambda n, m: max(math.ceil((n + m) * 85 / 185 - 1e-9) - max(math.ceil(n * 0.85 - 1e-9), math.ceil(m * 0.85 - 1e-9)) + 1, 1)
    assert [least(n, m) for m in (18, 19, 20)] == [2, 1, 2]
    columns = "n long, least long, most long, shared long"
    df = spark.createDataFrame([(18, 18, 20, 1), (18, 18, 20, 0), (18, 30, 40, 9)], columns)
    link = near_copies.may_link(*(df[c] for c in ("n", "least", "most", "shared")), 85)
    assert [r[0] for r in df.select(link).collect()] == [True, False, False]


@pytest.mark.parametrize("percent", [80, 85])
def test_bound_of_a_group_is_never_too_high(spark, percent):
    """Whatever sizes a group holds, it is opened whenever one of them could link."""
    rows = [(n, a, b) for n in range(1, 90) for a in range(1, 110, 3) for b in range(a, min(a + 30, 110), 4)]
    df = spark.createDataFrame(rows, "n long, least long, most long")
    shares = [(n, m, max(math.ceil((n + m) * percent / (100 + percent) - 1e-9) - max(math.ceil(n * percent / 100 - 1e-9), math.ceil(m * percent / 100 - 1e-9)) + 1, 1))
              for n in range(1, 90) for m in range(1, 140) if min(n, m) * 100 >= percent * max(n, m)]
    one = spark.createDataFrame(shares, "n long, m long, shared long")
    pairs = df.join(one, (df["n"] == one["n"]) & (one["m"] >= df["least"]) & (one["m"] <= df["most"])).drop(one["n"])
    assert pairs.filter(~near_copies.may_link(*(pairs[c] for c in ("n", "least", "most", "shared")), percent)).count() == 0


def test_four_texts_with_a_link_by_group(spark):
    """Two connected texts of different sizes make a group; a third links with a member of a size between."""
    pick = random.Random(1)
    for _ in range(4):
        rows, base = [], [f"w{pick.randint(0, 9999)}" for _ in range(22)]
        for doc in (1, 2, 3, 9):
            words = list(base)
            for _ in range(pick.randint(0, 2)):
                words[pick.choice([0, 1, len(words) - 1])] = f"v{pick.randint(0, 9999)}"
            rows.append((doc, " ".join(words[: len(words) - pick.randint(0, 3)])))
        assert found(spark, rows) == brute(rows, 4, 85)


@pytest.mark.parametrize("seed", range(2))
def test_families_against_brute_force(spark, monkeypatch, seed):
    """Families whose members drift apart, so that many links are found by opened groups alone; small blocks."""
    monkeypatch.setattr(near_copies, "LEAST", 2 + seed)
    monkeypatch.setattr(near_copies, "BLOCK", 3)
    pick = random.Random(seed)
    rows, doc = [], 0
    for family in range(8):
        words = [f"f{family}x{pick.randint(0, 400)}" for _ in range(pick.randint(15, 45))]
        for _ in range(14):
            at = pick.randrange(len(words))
            change = pick.random()
            if change < 0.4:
                words = words[:at] + [f"n{pick.randint(0, 10**6)}"] + words[at + 1 :]
            elif change < 0.6:
                words = words[:-1] if len(words) > 12 else words
            elif change < 0.8:
                words = [*words, f"e{pick.randint(0, 10**6)}"]
            rows.append((doc, " ".join(words)))
            doc += pick.randint(0, 2)  # some doc_ids have two texts
    rows += [(None, rows[0][1]), (5000, rows[0][1]), (5000, "alone here"), (5001, None), (5001, "")]
    pick.shuffle(rows)
    assert found(spark, rows) == brute(rows, 4, 85)
    assert found(spark, rows, 5, 80) == brute(rows, 5, 80)


def test_texts_of_one_doc_id_are_judged_apart(spark):
    a, b = "a b c d e f g", " ".join(f"u{i}" for i in range(500))
    assert found(spark, [(1, a), (5, a), (5, b)]) == [((False, 1), 4, 1), ((False, 5), 4, 1), ((False, 5), 497, 5)]
    assert found(spark, [(1, a), (1, b)]) == [((False, 1), 4, 1), ((False, 1), 497, 1)]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in [(1, a), (5, a), (5, b), (None, a), (7, None), (1, a)]], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_copy_stage(spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (1, a), (5, b), (None, a), (7, None)], key=str)


def test_extra_columns_stay(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", 1), (2, "a b c", "y", 2)], "doc_id long, text string, _set string, component_id int")
    assert [tuple(r) for r in near_copies.without_near_copies(docs).collect()] == [(1, "a b c", "x", 1)]
    assert near_copies.without_near_copies(docs.filter("false")).count() == 0
