"""Token alignment against plain Python, and its edge cases."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from framewright.llm import alignment
from framewright.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "The cat sat on the mat. The cat sat again, and again, and again.",
    "The cat sat on the mat. The cat sat again, and again, and again.",
    "  double  spaces\tand tabs\n\nlines  ",
    "ünïcode – 日本語 🙂   naïve",
    "<|endoftext|> and <s> </s> <unk> <0x41> are plain",
    "▁marks ▁ and ▁▁ stay apart",
    "x" * 400 + " " + "ab" * 500,
    "1234567890 3.14159 " * 60,
    "\x00 control \x7f bytes \r\n",
    "ﬁ ligature ① ＡＢＣ Å",
    "a", " ", "", None,
]


def brute(texts):
    """The contract, straight: rows by text, with corpus-wide counts of linked pairs."""
    a_model, b_model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_model.encode_special_tokens = True
    visible = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    table = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in visible)}

    def b_bytes(k):
        piece = b_model.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if b_model.is_byte(k) else piece.replace("▁", " ").encode()

    rows, count = [], Counter()
    for text in texts:
        want = (" " + (text or "")).encode()
        a = [(k, bytes(table[c] for c in a_model.id_to_token(k))) for k in a_model.encode(" " + (text or ""), add_special_tokens=False).ids]
        b = [(k, b_bytes(k)) for k in b_model.encode(text or "")]
        if not text or b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            rows.append(([], [], [], []))
            continue
        ends = []
        for tokens in (a, b):
            at, found = 0, {}
            for n, (k, x) in enumerate(tokens):
                at += len(x)
                found[at] = (n, k)
            ends.append(found)
        links, groups, fa, fb = [], [], 0, 0
        for at in sorted(ends[0].keys() & ends[1].keys()):
            (na, ka), (nb, kb) = ends[0][at], ends[1][at]
            links.append((ka, kb))
            groups.append(",".join(str(k) for k, _ in a[fa : na + 1]) + "|" + ",".join(str(k) for k, _ in b[fb : nb + 1]))
            fa, fb = na + 1, nb + 1
        count.update(links)
        rows.append((a, b, links, groups))
    best = {}
    for (_, kb), n in count.items():
        best[kb] = max(best.get(kb, 0), n)
    return [
        (len(a), len(b), len(groups), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links),
         hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for a, b, links, groups in rows
    ]


FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize(("links", "size"), [(3_000_000, 1 << 20), (60, 50), (10_000, 1)])
def test_against_plain_python(spark, links, size):
    """The same rows however slices and blocks are cut."""
    sent = {"BLOCK_LINKS": links, "SLICE_BYTES": size}
    texts = TEXTS * 3
    rows = [(i, t, 1, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_a long, block string").repartition(3)

    def build(batches):  # the setting holds in the workers, too
        alignment.BLOCK_LINKS, alignment.SLICE_BYTES = sent["BLOCK_LINKS"], sent["SLICE_BYTES"]
        yield from batches

    df = df.select("doc_id", "text").mapInArrow(build, "doc_id long, text string")
    found = {r["doc_id"]: tuple(r[f] for f in FIELDS) for r in alignment.align(df, A, B).collect()}
    assert found == dict(enumerate(brute(texts)))


def test_generated_texts(spark):
    pick = np.random.default_rng(11)
    words = ["the", "of", "Größe", "naïve", "x1", "...", "\n", "日本", "theory", "ing", " ", "über-", "$$$", "🙂"]
    texts = ["".join(pick.choice(words) + pick.choice(["", " ", "  "]) for _ in range(pick.integers(1, 200))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    found = {r["doc_id"]: tuple(r[f] for f in FIELDS) for r in alignment.align(df, A, B).collect()}
    assert found == dict(enumerate(brute(texts)))


def test_ids_null_and_repeated(spark):
    rows = [(None, "a cat"), (4, "a cat"), (4, "a cat"), (4, None)]
    found = alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()
    want = brute([t for _, t in rows])
    assert sorted((r["doc_id"] or 0, *(r[f] for f in FIELDS)) for r in found) == sorted((i or 0, *w) for (i, _), w in zip(rows, want))


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


@pytest.mark.parametrize("n_slots", [1, 7, 300, 4096])
def test_bitmaps_return_what_they_hold(n_slots):
    """Sparse and dense bitmaps, planes of many links, merged slices."""
    pick = np.random.default_rng(n_slots)
    pairs = pick.integers(0, 40, 5000) ** 3
    slots = pick.integers(0, n_slots, 5000)
    every = pairs * alignment.BLOCK_DOCS + slots
    found = alignment.Postings.of([every[:2000], every[2000:]], n_slots)
    back = Counter()
    for key, slot, times in alignment.Postings.entries(found.planes, len(found.pairs), n_slots):
        for k, s in zip(found.pairs[key].tolist(), slot.tolist()):
            back[k, s] += times
    assert back == Counter(zip(pairs.tolist(), slots.tolist()))
    assert (found.links == [(pairs == p).sum() for p in found.pairs]).all()
    assert (found.docs == [len(set(slots[pairs == p])) for p in found.pairs]).all()


def test_pair_scores(spark):
    df = spark.createDataFrame([(1, "the the cat"), (2, "the dog")], "doc_id long, text string").repartition(2)
    rows = alignment.pair_scores(alignment.inverted_index(df, A, B)).collect()
    the = max(rows, key=lambda r: r["n_links"])
    assert (the["n_docs"], the["n_links"], the["best"]) == (2, 3, True)
    assert all(r["pair"] == r["a_id"] << alignment.ID_BITS | r["b_id"] for r in rows)


def test_numbers():
    data, ends = alignment._numbers(np.array([0, 7, 10, 50256, 999999]), np.frombuffer(b",|;,;", np.uint8))
    assert data.tobytes() == b"0,7|10;50256,999999;" and ends.tolist() == [2, 4, 7, 13, 20]


def test_slices_hold_every_row():
    texts = pa.array(["ab", None, "c" * 50, "", "d"])
    parts = list(alignment._slices(pa.array(range(5)), texts))
    assert [i for ids, _ in parts for i in ids.to_pylist()] == list(range(5))


def test_query(spark, tmp_path):
    spark.createDataFrame([(1, "a cat"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["op13_cross_tokenizer_alignment"](spark, str(tmp_path)).count() == 2
