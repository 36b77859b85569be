"""Operators against plain Python on small generated corpora."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from framewright.llm import decontaminate, lm, near_copies, pieces, quality, repeats, toxicity, words

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


@pytest.fixture(scope="module")
def corpus(spark):
    """Families of near copies at many distances, shared passages, exact copies, short and empty texts."""
    pick = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)] + ["The", "of", "Ünd"]
    base = [[pick.choice(vocabulary) for _ in range(n)] for n in (40, 90, 150, 150)]
    passage = [pick.choice(vocabulary) for _ in range(30)]
    texts = []
    for text in base:
        for _ in range(25):
            rate = pick.random() * 0.08
            texts.append([pick.choice(vocabulary) if pick.random() < rate else w for w in text])
    texts += [[pick.choice(vocabulary) for _ in range(60)] + passage[: pick.randint(10, 30)] for _ in range(20)]
    texts += [list(t) for t in pick.sample(texts, 15)] + [[], ["one"], ["one"], ["a", "b", "c"], ["A", "b", "c"]]
    pick.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_near_copies(corpus, k, percent):
    docs, rows = corpus
    sets = {}
    for i, t in rows:
        w = spaced(t.translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_copies.near_copy_groups(docs, k, percent).collect()}
    assert got == {i: (len(s), top(i)) for i, s in sets.items()}


def test_near_copies_with_frequent_shingles(corpus, monkeypatch):
    docs, _ = corpus
    plain = {tuple(r) for r in near_copies.near_copy_groups(docs).collect()}
    monkeypatch.setattr(near_copies, "LEAST", 2)
    monkeypatch.setattr(near_copies, "CHUNK", 50)
    assert {tuple(r) for r in near_copies.near_copy_groups(docs).collect()} == plain


def test_repeats(corpus):
    docs, rows = corpus
    first = {}
    for i, t in rows:
        w = spaced(t)
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    expected = {}
    for i, t in rows:
        w = spaced(t)
        gone = {p for j in range(len(w) - 12) if first[tuple(w[j : j + 13])] < i for p in range(j, j + 13)}
        expected[i] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in repeats.remove_repeats(docs).collect()}
    assert got == expected


def test_benchmark_hits(spark, corpus):
    docs, rows = corpus
    source = alnum(rows[3][1])
    items = [(1, " ".join(source[:25])), (2, "W1, w2"), (3, "one"), (4, "nothing of the kind " * 5), (10, " ".join(source[5:20]))]
    table = spark.createDataFrame(items, "item_id long, text string")
    strings = {(i, tuple(w[j : j + min(10, len(w))])) for i, t in items for w in [alnum(t)] for j in range(len(w) - min(10, len(w)) + 1)}
    expected = {}
    for i, t in rows:
        w = alnum(t)
        found = [(n, j, len(s)) for n, s in strings for j in range(len(w) - len(s) + 1) if tuple(w[j : j + len(s)]) == s]
        hit = {p for _, j, m in found for p in range(j, j + m)}
        names = sorted({str(n) for n, _, _ in found})
        expected[i] = (len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit))
    for shard in (500_000, 4):
        got = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.benchmark_hits(docs, table, shard_windows=shard).collect()}
        assert got == expected
    assert sum(x[4] for x in expected.values()) > 3


def test_quality_measures(spark):
    pick = random.Random(2)
    rows = []
    for i in range(60):
        lines = [" ".join(pick.choice(["a", "b", "c", "Word", "x#y", "|"]) for _ in range(pick.randint(0, 12))) for _ in range(pick.randint(0, 9))]
        rows.append((i, "\n".join(lines)))
    got = {r["doc_id"]: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        w = spaced(t)
        seen = {}
        for j in range(len(w) - 2):
            seen.setdefault(tuple(w[j : j + 3]), []).append(j)
        again = {p for places in seen.values() if len(places) > 1 for j in places for p in range(j, j + 3)}
        lines = [x for x in t.split("\n") if spaced(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(again))


def test_line_rules(spark):
    good = " ".join(f"Sentence {i} has word{i} and other{i}." for i in range(12))
    end = good.replace("word", "more").replace("Sentence", "Phrase")
    bad = ["Home | About | News | Contact", "Please read our privacy policy", "BUY NOW THIS IS THE BEST", "a### b$$$ c%%% d&&&"]
    docs = spark.createDataFrame([(1, "\n".join([good, *bad, end]))], "doc_id long, text string")
    row = quality.quality_rules(docs).first()
    assert row["kept"] and row["clean_text"] == good + "\n" + end


def test_pieces(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    pick = random.Random(3)
    letters = list("abcdeghinorstu      \n\t▁éñß.,#01 日本'") + ["the", " and", "  "]
    texts = ["".join(pick.choices(letters, k=pick.randint(0, 80))) for _ in range(800)] + ["", " ", "   x", "▁", "\n", " " * 70 + "y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in pieces.decode(pieces.encode(docs, MODEL), MODEL).collect():
        ids = model.encode(row["text"], add_eos=True)
        assert row["ids"] == ids and row["decoded"] == model.decode(ids)


def test_interactions_are_learnt(spark):
    """Two words that are harmless alone and toxic together, and held-out accuracy."""
    pick = random.Random(9)
    rows, labels = [], []
    for i in range(3000):
        w = [f"w{pick.randint(0, 400)}" for _ in range(30)]
        a, b = pick.random() < 0.5, pick.random() < 0.5
        w += ["fool"] * a + ["group"] * b
        pick.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(a and b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = spark.createDataFrame(labels[:2000], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, train)).collect()}
    right = np.mean([(got[i] >= 0.5) == bool(y) for i, y in labels[2000:]])
    assert right > 0.95


def test_words_match_the_expressions():
    pick = random.Random(1)
    letters = list("aAzZ09_-. \t\n\x0b\x0cé日\x00~") + ["Word"]
    texts = ["".join(pick.choices(letters, k=pick.randint(0, 30))) for _ in range(500)]
    import pyarrow as pa

    for table, lower, plain in ((words.NON_SPACE, False, spaced), (words.ALNUM, True, alnum)):
        n = 0
        for row, data, offsets in words.slices(pa.array(texts), 200):
            found = words.split(data, offsets, table, lower)
            for k in range(len(offsets) - 1):
                own = [bytes(found.data[found.starts[j] : found.ends[j]]).decode() for j in range(found.first[k], found.first[k + 1])]
                assert own == plain(texts[row + k])
                n += 1
        assert n == 500


def test_cross_entropy_counts_every_word(spark, monkeypatch):
    """Against exact counts, with more distinct words and bigrams than the former tables held (65,536 words)."""
    pick = random.Random(4)
    rows = [(i, " ".join(f"w{int(70_000 * pick.random() ** 2)}" for _ in range(600))) for i in range(300)]
    rows += [(1000 + i, " ".join(f"u{i * 600 + j}" for j in range(600))) for i in range(100)] + [(2000, ""), (2001, None), (2002, "w1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    in_target = lambda i: i % 3 == 0
    models = []
    for part in ([t for i, t in rows if in_target(i)], [t for _, t in rows]):
        unigrams, befores, bigrams = Counter(), Counter(), Counter()
        for t in part:
            w = alnum(t)
            unigrams.update(w)
            befores.update([None, *w[:-1]] if w else [])
            bigrams.update(zip([None, *w], w))
        models.append((unigrams, befores, bigrams, sum(unigrams.values())))
    kinds = len(models[1][0]) + 2
    assert kinds > 65_538
    got = {r["doc_id"]: r for r in lm.cross_entropy_difference(docs, docs.filter("doc_id % 3 = 0")).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        w = alnum(t)
        assert got[i]["n_tokens"] == len(w)
        if not w:
            assert got[i]["target_loss"] is None and got[i]["score"] == 0
            continue
        losses = []
        for unigrams, befores, bigrams, n in models:
            p = [(bigrams[b, x] + 50 * (unigrams[x] + 0.1) / (n + 0.1 * kinds)) / (befores[b] + 50) for b, x in zip([None, *w], w)]
            losses.append(-np.mean(np.log(p)))
        assert np.allclose((got[i]["target_loss"], got[i]["background_loss"], got[i]["score"]), (*losses, losses[0] - losses[1]), rtol=1e-9, atol=1e-9)
    by_id = docs.filter("doc_id % 3 = 0").select("doc_id")
    assert got == {r["doc_id"]: r for r in lm.cross_entropy_difference(docs, by_id).collect()}
    # many small slices and shards
    monkeypatch.setattr(lm, "SLICE", 20_000)
    monkeypatch.setattr(lm, "SHARD", 10_000)
    small = {r["doc_id"]: r for r in lm.cross_entropy_difference(docs, by_id).collect()}
    assert all(np.isclose(small[i]["score"], got[i]["score"]) for i in got)


def test_labels_meet_slices_without_the_texts(spark, monkeypatch):
    """The target's ids, here of unknown size, are joined with the slices' ids alone: no text moves for them."""
    pick = random.Random(11)
    rows = [(i, " ".join(f"w{pick.randint(0, 300)}" for _ in range(pick.randint(0, 40)))) for i in range(500)]
    rows += [(7, "again w1"), (None, "w2 w3"), (600, None), (601, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ids = spark.createDataFrame([(i,) for i in [*range(0, 500, 3), 7, 7, 600, 9999, None]], "doc_id long")
    good = {r["doc_id"] for r in ids.collect()} - {None}
    plans, keep = [], lm.stored
    monkeypatch.setattr(lm, "stored", lambda df: plans.append((df.columns, df._jdf.queryExecution().sparkPlan().toString())) or keep(df))
    order = lambda df: sorted(df.collect(), key=str)
    got = order(lm.cross_entropy_difference(docs, ids))
    assert len(got) == len(rows)
    for columns, plan in plans:
        if "data" in columns or "answer" in columns:
            assert "SortMergeJoin" not in plan, plan
    # the same counts as of the target's own texts, also in many slices, and when the slices' marks are too large for a broadcast
    texts = docs.filter(docs.doc_id.isin(sorted(good)))
    assert got == order(lm.cross_entropy_difference(docs, texts))
    monkeypatch.setattr(lm, "SLICE", 400)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        many = order(lm.cross_entropy_difference(docs, ids))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for a, b in zip(many, got, strict=True):
        assert a["doc_id"] == b["doc_id"] and a["n_tokens"] == b["n_tokens"] and np.isclose(a["score"], b["score"])
