"""What each method is there for: exactness at odd sizes, decisions that come from the method, and planted cases."""

import itertools
import math
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers

import corpus_pipeline
from framewright.llm import decontaminate, licenses, near_copies, pieces, private_data, quality, repeats, store, toxicity, urls, words


def twins(n):
    """Two words of n letters that any polynomial hash modulo 2**64 takes for one."""
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_patterned_words_have_different_hashes(n):
    a, b = twins(n)
    texts = [a, b, a[:-1], "x" + a[1:], a[:8], a[:9], b[:9], "aaaaaaaabbbbbbbb", "bbbbbbbbaaaaaaaa"]
    for row, data, offsets in words.slices(pa.array(texts)):
        assert len(set(words.split(data, offsets, words.NON_SPACE, False).hashes.tolist())) == len(texts)


def test_patterned_words_do_not_link_documents(spark):
    a, b = twins(1024)
    docs = spark.createDataFrame([(1, f"one two {a} three four"), (2, f"one two {b} three four")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_copies.near_copy_groups(docs).collect()} == {1: 1, 2: 2}


def test_least_shared_prefix_shingles(spark):
    """No linked pair of sets has fewer prefix shingles in common than the bound says."""
    pick = random.Random(8)
    for _ in range(400):
        percent = pick.choice([80, 85])
        a = set(pick.sample(range(200), pick.randint(1, 60)))
        b = {x for x in a if pick.random() > 0.08} | set(pick.sample(range(200), pick.randint(0, 6)))
        if not b or 100 * len(a & b) < percent * len(a | b):
            continue
        part = lambda n: -(-n * percent // 100)
        prefix = [set(sorted(s)[: len(s) - part(len(s)) + 1]) for s in (a, b)]
        n, m = len(a), len(b)
        least = max(-(-(n + m) * percent // (100 + percent)) - max(part(n), part(m)) + 1, 1)
        assert len(prefix[0] & prefix[1]) >= least


def test_blocks_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 3)
    monkeypatch.setattr(near_copies, "QUERIES", 2)
    pick = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(w if pick.random() > 0.01 else f"x{pick.randint(0, 9999)}" for w in base) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copy_groups(docs).collect()}
    monkeypatch.undo()
    assert got == {r["doc_id"]: r["component_id"] for r in near_copies.near_copy_groups(docs).collect()}


@pytest.mark.parametrize("n", [65_535, 65_536, 70_000])
def test_repeat_words_at_every_size(spark, n):
    pick = random.Random(n)
    w = [f"w{pick.randint(0, 60)}" for _ in range(n // 2)] + [f"u{i}" for i in range(n - n // 2)]
    seen = {}
    for j in range(len(w) - 2):
        seen.setdefault(tuple(w[j : j + 3]), []).append(j)
    again = {p for places in seen.values() if len(places) > 1 for j in places for p in range(j, j + 3)}
    row = quality.quality_rules(spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string")).first()
    assert (row["n_words"], row["n_repeat_words"]) == (n, len(again))


def test_words_of_a_line_are_the_contracts(spark):
    good = "A plain sentence stands here. " * 20
    lines = ["\t".join(f"w{i}" for i in range(45)), "return" + " " * 60 + "value"]
    row = quality.quality_rules(spark.createDataFrame([(1, "\n".join([good, *lines]))], "doc_id long, text string")).first()
    assert row["clean_text"] == "\n".join([good, lines[1]])  # 45 words without an end go, two words stay


def test_licenses_by_row_and_over_lines(spark):
    wrapped = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated\ndocumentation files"
    rows = [(1, "nothing here"), (1, "see the MIT License"), (None, "plain"), (None, "Apache License"), (2, wrapped), (3, "Licensed under CC BY-NC 4.0.")]
    got = {(r["doc_id"], r["labels"], r["score"] > 0) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "", False), (1, "mit", True), (None, "", False), (None, "apache", True), (2, "mit", True), (3, "cc-by-nc", True)}


def test_template_matches_against_brute_force(spark):
    pick = random.Random(6)
    bag = [w for _, words_ in licenses.TEMPLATES for w in words_.split()] + ["zebra", "quite"]
    rows = []
    for i in range(60):
        _, template = pick.choice(licenses.TEMPLATES)
        line = [w for w in template.split() if pick.random() > 0.15] + pick.sample(bag, 3)
        rows.append((i, "\n".join([" ".join(line), *(" ".join(pick.sample(bag, 5)) for _ in range(3))])))
    expected = set()
    for i, text in rows:
        sets = [set(re.findall(r"[a-z0-9]+", x.lower())) for x in text.split("\n")]
        for k in range(len(sets)):
            block = set().union(*sets[k : k + licenses.BLOCK_LINES])
            for label, template in licenses.TEMPLATES:
                t = set(template.split())
                if len(block & t) >= math.ceil(0.8 * len(t) - 1e-9):
                    expected.add((i, k, label, round(len(block & t) / len(t), 9)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = licenses.template_matches(docs).join(docs.selectExpr("doc_id", "sha2(text, 256) AS text_sha256"), "text_sha256")
    assert {(r["doc_id"], r["line"], r["label"], round(r["containment"], 9)) for r in found.collect()} == expected and expected


def test_the_automaton_decides(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"a b {passage} c"), (2, f"d {passage} e f"), (3, "g h i")], "doc_id long, text string")
    run = lambda: {r["doc_id"]: r["n_removed"] for r in repeats.remove_repeats(docs).collect()}
    assert run() == {1: 0, 2: 30, 3: 0}
    data = np.frombuffer(f"a {passage} b".encode(), np.uint8)
    found = words.split(data, np.array([0, len(data)]), words.NON_SPACE, False)
    every = np.arange(1, 19)
    for passages in (every, np.delete(every, [4, 5])):
        reported = {int(b) for begin, _ in repeats.located(found, passages, 13) for b in begin}
        assert reported == set(passages.tolist())  # a passage that was not compiled is not found


def test_largest_and_missing_ids_stay_apart(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    last = (1 << 63) - 1
    rows = [(last, f"x {passage}"), (None, f"y {passage}"), (None, f"z {passage}"), (5, f"w {passage}")]
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("5", 0), (str(last), 20), ("None", 0), ("None", 0)]


def brute_split(name, counts, total):
    """The cheapest of all ways to cut a name."""
    memo = {}

    def cost(part):
        if part not in memo:
            memo[part] = math.log(total + 1) + (len(part) - 1) * math.log(10)
            if part in counts:
                alone = math.log(total / counts[part])
                if alone + math.log(urls.COHESION) < min((c for c, _ in ways(part) if _ > 1), default=math.inf):
                    memo[part] = alone
        return memo[part]

    def ways(part):
        for cuts in itertools.product([0, 1], repeat=len(part) - 1):
            ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(part)]
            parts = [part[a:b] for a, b in zip([0, *ends], ends)]
            if len(parts) > 1:
                yield sum(map(cost, parts)), len(parts)

    return min([cost(name), *(c for c, _ in ways(name))]), cost


def test_viterbi_against_all_splits():
    pick = random.Random(2)
    counts = {"".join(pick.choices("abc", k=k)): pick.randint(1, 500) for k in (1, 2, 2, 2, 3, 3, 4) for _ in range(4)}
    total = sum(counts.values())
    for _ in range(60):
        name = "".join(pick.choices("abc", k=pick.randint(1, 7)))
        best, cost = brute_split(name, counts, total)
        found = urls.split_name(name, counts, total)
        assert "".join(found) == name and math.isclose(sum(map(cost, found)), best)


def test_planted_names_are_split_and_markup_is_no_word(spark):
    text = "<p>" + "cheap pills and more pills for cheap money " * 40 + "</p>"
    rows = [(i, f"https://cheappills{i % 3}.org/money{i}", text + '<a href="http://cheappills.org/">cheappills.org</a><script>cheappills</script>') for i in range(20)]
    rows += [(99, "https://" + "a" * 3000 + ".net/x", ""), (100, rows[0][1], rows[0][2]), (100, rows[0][1], rows[0][2])]
    got = urls.url_filter(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 23
    for r in got:
        if r["page_id"] != 99:
            assert r["words"][:3] == ["h:cheap", "h:pills", "h#1"] and r["words"][4] == "p:money"


def test_bayes_against_counts(spark):
    pick = random.Random(5)
    rows = [(i, pick.choice(["allow", "block"]), f"u{i}", pick.choices(["h:a", "h:b", "p:c", "p:d"], k=pick.randint(0, 5))) for i in range(200)]
    start, odds = urls.fit_bayes(spark.createDataFrame(rows, "_row long, judged string, url string, words array<string>"), 10_000)
    n = {k: sum(r[1] == k for r in rows) for k in ("allow", "block")}
    bag = {k: [w for r in rows if r[1] == k for w in r[3]] for k in n}
    assert math.isclose(start, math.log(n["block"] / n["allow"]))
    for w in ("h:a", "h:b", "p:c", "p:d"):
        share = {k: (bag[k].count(w) + 1) / (len(bag[k]) + 4 + 1) for k in n}
        assert math.isclose(odds[w], math.log(share["block"]) - math.log(share["allow"]))


@pytest.mark.parametrize("kind", ["and", "xor"])
def test_pairs_neutral_alone_among_many_words(spark, kind):
    pick = random.Random(9)
    rows, labels = [], []
    for i in range(3000):
        w = [f"w{pick.randint(0, 6000)}" for _ in range(30)]
        a, b = pick.random() < 0.5, pick.random() < 0.5
        w += ["fool"] * a + ["group"] * b
        pick.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(a and b) if kind == "and" else int(a != b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    machine = toxicity.fit_toxicity(docs, spark.createDataFrame(labels[:2000], "doc_id long, toxic int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, machine).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, y in labels[2000:]]) > 0.95


def test_machine_against_the_formula():
    pick = np.random.default_rng(3)
    machine = toxicity.FactorizationMachine(np.arange(20) * 3, 0.3)
    machine.weights, machine.vectors = pick.normal(size=20), pick.normal(size=(20, toxicity.FACTORS)) * 0.3
    texts = [np.sort(pick.choice(70, n, replace=False)) for n in (0, 1, 5, 30)]
    first = np.concatenate([[0], np.cumsum(list(map(len, texts)))])
    got = machine.score(*machine.places(np.concatenate(texts), first))
    for text, score in zip(texts, got, strict=True):
        own = [int(s) // 3 for s in text if s % 3 == 0 and s < 60]
        z = 0.3 + sum(machine.weights[i] for i in own) + sum(machine.vectors[i] @ machine.vectors[j] for i, j in itertools.combinations(own, 2))
        assert math.isclose(score, 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def test_one_class_only(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    for y in (0, 1):
        machine = toxicity.fit_toxicity(docs, spark.createDataFrame([(1, y)], "doc_id long, toxic int"))
        assert all(round(r["score"]) == y for r in toxicity.score_toxicity(docs, machine).collect())


def test_hits_are_confirmed_by_bytes():
    strings = [b"a b c", b"a b d"]
    data = np.frombuffer(b"x a b c y a b e", np.uint8)
    found = words.split(data, np.array([0, len(data)]), words.ALNUM, True)
    table = decontaminate._tables({3: {s: {"1"} for s in strings}})[3][0]
    assert table.search(found)[0].tolist() == [1]
    table.texts = [b"a b q", b"a b d"]  # equal hashes, other words
    assert table.search(found)[0].tolist() == []


def luhn(card):
    digits = [int(c) for c in card if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def test_mentions_of_one_thing_agree(spark):
    texts = [
        "Mrs Anna Smith met Mrs. Smith; Anna Smith spoke, not Anna Smithson.", "Mr. Jones and Mr Jones", "call (017) 555-7713 or +1 (017) 555-7713",
        "Jo.Doe@mail.com jo.doe@mail.com", "card 4111 1111 1111 1111 or 4111111111111111", "DE89 3704 0044 0532 0130 00", "key " + "0123456789abcdef" * 20,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["text"] for r in sorted(private_data.replace_private_data(docs, "key").collect())]
    first, last = re.match(r"Mrs (\w+) (\w+) met", got[0]).groups()
    assert got[0] == f"Mrs {first} {last} met Mrs. {last}; {first} {last} spoke, not Anna Smithson." and "Anna" != first
    assert re.fullmatch(r"Mr\. (\w+) and Mr \1", got[1]) and re.fullmatch(r"call (\(.*) or \+1 \1", got[2])
    a, b = got[3].split()
    assert a.lower() == b and a != b
    assert got[4][5:24].replace(" ", "") == got[4][28:] and luhn(got[4][28:])
    iban = got[5].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert "0123456789abcdef" not in got[6] and len(got[6]) == len(texts[6])


def test_clean_parts_stay_byte_by_byte(spark):
    """Against an independent pattern of e-mail addresses: all else is as before."""
    pick = random.Random(4)
    plain = ["the", "Größe", "x_1", "日本", "—", "a.b", "(c)", "\t", "1999", "3.5"]
    rows = []
    for i in range(80):
        parts = [pick.choice(plain) for _ in range(12)]
        for _ in range(pick.randint(0, 3)):
            parts.insert(pick.randint(0, len(parts)), f"u{pick.randint(0, 30)}@mail{pick.randint(0, 3)}.com")
        rows.append((i, " ".join(parts)))
    got = {r["doc_id"]: r for r in private_data.replace_private_data(spark.createDataFrame(rows, "doc_id long, text string"), "key").collect()}
    mail = re.compile(r"\b[a-z0-9]+@[a-z0-9]+\.com\b")
    known = {}
    for i, text in rows:
        old, new = mail.findall(text), mail.findall(got[i]["text"])
        assert mail.split(text) == mail.split(got[i]["text"]) and got[i]["n_entities"] == len(old) == len(new)
        for x, y in zip(old, new, strict=True):
            assert known.setdefault(x, y) == y and x != y
    assert len(set(known.values())) == len(known)


def test_decoding_nulls_empty_and_long(spark):
    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = [(1, None), (2, []), (3, [2]), (4, [450, 29871] * 60_000)]
    got = {r["doc_id"]: r["decoded"] for r in pieces.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), model).collect()}
    import sentencepiece

    assert got[2] == got[3] == "" and not got[1]
    assert got[4] == sentencepiece.SentencePieceProcessor(model_file=model).decode(rows[3][1])


def test_pipeline_edges(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(80)) + "."
    long = " ".join(f"long{i}" for i in range(60_000)) + "."
    rows = [(1, text, "en", "a", 9, "x", 1.0), (1, text, "en", "a", 9, "x", 1.0), (2, None, None, None, None, None, None), (3, "", "", "", 0, "", 0.0), (4, long, "en", "a", 1, "y", 2.0), (5, text, "de", "b", 9, "z", 3.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, score double")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, table in (("full", docs), ("none", docs.filter("false"))):
        for _, stage in corpus_pipeline.STAGES:
            table = store.stored(stage(spark, table, str(tmp_path)))
        got = sorted(r["doc_id"] for r in table.collect())
        assert got == ([1, 1, 4] if name == "full" else []) and table.columns[:5] == corpus_pipeline.COLUMNS


def test_stored_tables_can_be_dropped(spark, monkeypatch):
    monkeypatch.setattr(store, "_written", [])
    assert store.stored(spark.range(5)).count() == 5
    path = store._written[0].removeprefix("file:")
    assert os.path.isdir(path)
    store.drop_stored(spark)
    assert not os.path.exists(path) and not store._written


def test_items_without_an_id_hit(spark):
    """Their words count as hit; they have no id to be counted by, in one pass over the documents or in several."""
    docs = spark.createDataFrame([(1, "one two three four"), (2, "nothing here")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "two three"), (None, None), (7, "three four")], "item_id long, text string")
    empty = decontaminate.benchmark_hits(docs, items.filter("item_id IS NULL")).collect()
    assert {(r["doc_id"], r["n_hit"], r["n_items"], r["contaminated"]) for r in empty} == {(1, 2, 0, True), (2, 0, 0, False)}
    for shard in (10_000, 1):
        rows = decontaminate.benchmark_hits(docs, items, shard_windows=shard).collect()
        assert {(r["doc_id"], r["n_hit"], r["n_items"], r["contaminated"]) for r in rows} == {(1, 3, 1, True), (2, 0, 0, False)}


def test_names_with_words_of_any_length(spark):
    """A word of 40 letters is looked up by its first ones, and a path of many thousand letters is split, too."""
    long = "abcdefghij" * 4
    text = " ".join([long] * 500 + ["shop"] * 500 + ["other"] * 5000)
    rows = [
        (1, f"http://shop{long}.net/x", f"<p>{text}</p>"),
        (2, f"http://{long}.net/{'shop' * 5000}", ""),
        (3, f"http://{long[:36]}.net/shop", None),
    ]
    got = {r["page_id"]: r["words"] for r in urls.url_filter(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1][:2] == ["h:shop", f"h:{long}"]
    assert got[2][0] == f"h:{long}" and got[2].count("p:shop") == 5000
    assert got[3] == [f"h:{long[:36]}", "h:net", "p:shop"]
