"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from framewright.llm import decontaminate, licenses, lm, near_copies, pieces, private_data, quality, repeats, toxicity, urls

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LONG = "word " * 60_000 + "x" * 100_000


@pytest.fixture(scope="module")
def messy(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, ""), (4, " \n\t "), (None, "a b c d e f"), (5, LONG), (6, "ünïcode – 日本語 \x00 ok")]
    extra = "n long, rep long, label string, plain string, score double, ids string, kept string, _text string, entity string"
    rows = [r + (7, 8, "x", "y", 0.5, "i", "k", "t", "e") for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, " + extra).repartition(3)


def items(spark):
    return spark.createDataFrame([(1, "b c d"), (2, None), (3, ""), (None, "a b"), (1, "b c d")], "item_id long, text string")


def operators(spark):
    labels = spark.createDataFrame([(1, 1), (3, 0), (6, 0), (99, 1), (None, 1)], "doc_id long, toxic int")
    return {
        "near_copies": near_copies.near_copy_groups,
        "licenses": licenses.license_scan,
        "lm": lambda d: lm.cross_entropy_difference(d, d.filter("doc_id = 1"), vocabulary=50, bits=10),
        "repeats": repeats.remove_repeats,
        "toxicity": lambda d: toxicity.score_toxicity(d, toxicity.fit_toxicity(d, labels)),
        "quality": quality.quality_rules,
        "encode": lambda d: pieces.encode(d, MODEL),
        "decontaminate": lambda d: decontaminate.benchmark_hits(d, items(spark), keep=("score", "n_words")),
        "drop": lambda d: decontaminate.decontaminate(d, items(spark)),
        "private": lambda d: private_data.replace_private_data(d, "key"),
    }


NAMES = ["near_copies", "licenses", "lm", "repeats", "toxicity", "quality", "encode", "decontaminate", "drop", "private"]


@pytest.mark.parametrize("name", NAMES)
def test_messy_rows(spark, messy, name):
    rows = operators(spark)[name](messy).collect()
    assert len(rows) == (5 if name == "drop" else 8)  # three rows hold an item's words
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows)
    if name != "drop":
        assert ids == [(False, 1), (False, 1), (False, 2), (False, 3), (False, 4), (False, 5), (False, 6), (True, 0)]


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, messy, name):
    assert operators(spark)[name](messy.filter("false")).count() == 0


def test_defined_results(spark, messy):
    groups = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in near_copies.near_copy_groups(messy).collect()}
    assert groups[(1, 3)] == 1 and groups[(None, 3)] is None and groups[(2, 0)] == 2 and groups[(4, 0)] == 4
    found = {r["doc_id"]: r for r in repeats.remove_repeats(messy).collect()}
    assert found[5]["n_words"] == 60_001 and found[5]["n_removed"] == 0 and found[2]["kept_text"] == ""
    ids = {r["doc_id"]: r["ids"] for r in pieces.encode(messy, MODEL).collect()}
    assert ids[2] == [2] and ids[3] == [2]
    kept = {r["doc_id"]: r for r in quality.quality_rules(messy).collect()}
    assert kept[5]["n_words"] == 60_001 and kept[5]["n_repeat_words"] == 60_000 and kept[2]["base_failed"] and kept[1]["plain"] == "y"
    losses = {r["doc_id"]: r for r in lm.cross_entropy_difference(messy, messy.filter("false"), vocabulary=5, bits=8).collect()}
    assert losses[3]["score"] == 0 and losses[3]["target_loss"] is None and losses[1]["n_tokens"] == 6


def test_urls(spark):
    rows = [(1, "https://a.org/x", "<p>cheap pills cheap pills</p>"), (2, None, None), (3, "no scheme", ""), (4, "http://cheappills.com/de/1", ""), (5, "HTTP://X.ORG", "")]
    pages = spark.createDataFrame([r + ("clash",) for r in rows], "page_id long, url string, html string, words string")
    got = {r["page_id"]: r for r in urls.url_filter(pages).collect()}
    assert (got[1]["rule"], got[1]["verdict"]) == ("org/", "allow") and (got[4]["rule"], got[4]["verdict"]) == ("com/de/", "block")
    assert got[2]["host"] == "" and got[2]["path"] == "" and got[5]["host"] == "x.org" and got[5]["rule"] is None
    assert got[4]["words"][:2] == ["h:cheap", "h:pills"]
    assert urls.url_filter(pages.filter("false")).count() == 0


def test_very_long_names_and_clean_text_stay(spark):
    docs = spark.createDataFrame([(1, "x@" * 50_000), (2, "a plain line\nand another")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in private_data.replace_private_data(docs, "key").collect()}
    assert got[2]["text"] == "a plain line\nand another" and got[2]["n_entities"] == 0
    assert got[1]["n_entities"] == 0


def test_surrogates(spark):
    text = "Mail jo.doe@mail.example.com or +1 (017) 555-7713, card 4111111111111111, ip 10.0.0.1, Mrs Anna Smith. "
    docs = spark.createDataFrame([(i, text + f"own{i}@mail.example.com") for i in range(200)], "doc_id long, text string")
    rows = private_data.replace_private_data(docs, "key").collect()
    found = spark.createDataFrame(rows).select(F.regexp_extract_all("text", F.lit(private_data.ANY), F.lit(0)).alias("e")).collect()
    shared, own = {tuple(r["e"][:5]) for r in found}, {r["e"][5] for r in found}
    assert len(shared) == 1 and len(own) == 200  # the same entity everywhere; distinct ones stay distinct
    assert not any("jo.doe@" in r["text"] or "4111111111111111" in r["text"] or "Smith" in r["text"] for r in rows)
    (mail, phone, card, ip, name) = shared.pop()
    assert mail.endswith(".com") and phone.startswith("+1 (") and len(card) == 16 and name.startswith("Mrs ") and name.endswith("lina")
    other = private_data.replace_private_data(docs, "another key").first()["text"]
    assert other != rows[0]["text"]


def test_every_title_is_found_in_a_text_without_digits(spark):
    titles = [t for group in private_data.TITLES.values() for t in group]
    names = {"Г": "Иванова", "Κ": "Νίκος"}
    rows = [(i, f"said {t}{dot} {names.get(t[0], 'Schmidt')} today") for i, (t, dot) in enumerate((t, d) for t in titles for d in ("", "."))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in private_data.replace_private_data(docs, "key").collect()}
    left = [text for i, text in rows if got[i]["n_entities"] != 1 or got[i]["kinds"] != "name" or text.split()[2] in got[i]["text"]]
    assert left == []


def test_collisions_are_drawn_again(spark, monkeypatch):
    real = private_data.surrogate

    def narrow(entity, kind, key, attempt):
        return F.when(F.lit(attempt) == 0, F.lit("same@x.com")).otherwise(real(entity, kind, key, attempt))

    monkeypatch.setattr(private_data, "surrogate", narrow)
    docs = spark.createDataFrame([(i, f"user{i}@mail.com") for i in range(20)], "doc_id long, text string")
    assert len({r["text"] for r in private_data.replace_private_data(docs, "key").collect()}) == 20


def test_surrogates_never_run_out(spark, monkeypatch):
    """More one-word names and short e-mails than surrogates of their first length, and a script without syllables."""
    monkeypatch.setitem(private_data.SYLLABLES, "Latin", ["ba"] * 8 + ["ce"] * 8)
    names = [f"Mr. {a}{b}n" for a in "ABCDEFGH" for b in "aeiou"]
    mails = [f"{a}@{b}.co" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrst"]
    docs = spark.createDataFrame(list(enumerate([*names, *mails, "Mr. Արամ"])), "doc_id long, text string")
    got = [(r["doc_id"], r["text"], r["kinds"]) for r in private_data.replace_private_data(docs, "key").collect()]
    texts = {t for _, t, _ in got}
    assert len(texts) == len(got) == 40 + 520 + 1 and not texts & {*names, *mails, "Mr. Արամ"}
    assert all(t.startswith("Mr. ") and t.endswith("mir") if k == "name" else t.endswith(".co") for _, t, k in got)


def test_later_draws_keep_the_kind(spark):
    rows = [("+49 22 33 44", "phone"), ("+49 22 33 44 55", "phone"), ("(017) 555-7713", "phone"), ("a@b.co", "email"), ("Mme Anna Roy", "name"), ("10.0.0.1", "ip")]
    df = spark.createDataFrame(rows, "entity string, kind string")
    for attempt in (1, 5):
        drawn = private_data.surrogate(F.col("entity"), F.col("kind"), "key", attempt)
        got = df.select("entity", "kind", drawn.alias("s"), private_data.kind_of(drawn).alias("k")).collect()
        assert all(r["k"] == r["kind"] for r in got)
        assert {r["entity"]: len(r["s"]) - len(r["entity"]) for r in got if r["kind"] in ("phone", "email")} == {
            "+49 22 33 44": 6, "+49 22 33 44 55": 2, "(017) 555-7713": 0, "a@b.co": attempt
        }
