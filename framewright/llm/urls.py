"""URL filter: rules first, then naive Bayes over the words of host and path.

Hosts and paths are cut into names at everything but letters, and each name is split into words by the likeliest unigram
segmentation (Viterbi). The words and their counts are those of the visible text of all pages (no tags, attributes,
scripts, addresses or host names). A string counts as a word of its own only if it is seen ``COHESION`` times as often as
its best split into other words predicts, so that chance neighbours such as two words run together are split. Names,
their substrings and the counts are joined as tables: no dictionary passes through the driver, and none is cut.

Multinomial naive Bayes over the words of host and path (numbers by their length) is fitted on pages that a rule has
judged, at most ``SAMPLE`` of each class by a hash of their url, which bounds the model. A rule's verdict stands; all other
pages get that of the model.

Edge cases: a null url or one without ``://`` has an empty host and path, no rule and the verdict of the classes' prior;
without judged pages of both classes the model allows; repeated rows, also of one page_id, each get their row; a name's
substrings of up to ``HEAD`` letters are looked up and longer words by their first ones, so very long names take time linear in
their length and words may have any length; an empty table stays empty; only page_id, url and html are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .store import schema_with, stored

#: (verdict, host, start of the path)
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
SAMPLE = 100_000
#: A name's substrings up to this length are looked up as they are, longer words by so many first letters.
HEAD = 32
COHESION = 30.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(pages: DataFrame) -> DataFrame:
    """``pages`` with ``host`` and ``path`` of the url."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(F.col("url"), F.lit(""))
    host = F.translate(F.regexp_extract(url, pattern, 1), _UPPER, _LOWER)
    return pages.withColumns({"host": host, "path": F.regexp_extract(url, pattern, 2)})


def rule_of(rules: list[tuple[str, str, str]], value: int) -> Column:
    """The longest rule that fits: 0 for its verdict, 1 for its text."""
    found = F.lit(None).cast("string")
    host = F.concat(F.lit("."), F.col("host"))
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = F.endswith(host, F.lit(f".{name}")) & F.startswith(F.col("path"), F.lit(start))
        found = F.when(fits, (verdict, name + start)[value]).otherwise(found)
    return found


def visible_text(html: Column) -> Column:
    """Lower-case text of a page without markup, addresses and host names."""
    text = F.coalesce(html, F.lit(""))
    for pattern in (r"(?is)<(script|style)\b.*?</\1\s*>", r"(?s)<!--.*?-->", r"<[^>]*>", r"&[#\w]+;", r"(?<![\w+.-])[\w+.-]++://\S++", r"(?<![\w.-])[\w-]++(?:\.[\w-]++)++"):
        text = F.regexp_replace(text, pattern, " ")
    return F.lower(text)


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, n) over the visible text of all pages."""
    words = F.explode(F.regexp_extract_all(visible_text(F.col("html")), F.lit("[a-z]{2,}"), F.lit(0))).alias("word")
    return pages.select(words).groupBy("word").agg(F.count("*").alias("n"))


def split_name(name: str, counts: dict[str, int], total: int) -> list[str]:
    """The likeliest words of a name, of any length. Any run of letters may be an unknown word, ten times less likely with each
    letter: of the runs that end at a letter the likeliest start is carried along, so a name takes time linear in its length."""
    unknown, letter = math.log(total + 1), math.log(10)
    own: dict[str, float] = {}  # of strings that are words of their own
    lengths = sorted({len(word) for word in counts})

    def best(part: str, whole: bool) -> tuple[float, list[int]]:
        """Cost and last starts; ``whole``: the part may be one word."""
        costs, back = [0.0], [0]
        start, later = 0, None  # of the likeliest unknown run; the same without the first letter
        for end in range(1, len(part) + 1):
            new = end - 1
            if costs[new] - new * letter < costs[start] - start * letter:
                start = new
            if new and (later is None or costs[new] - new * letter < costs[later] - later * letter):
                later = new
            run = start if whole or end < len(part) else later
            found = [] if run is None else [(costs[run] + unknown + (end - run - 1) * letter, run)]
            for k in lengths:
                if k <= end and (whole or k < len(part)) and (cost := own.get(part[end - k : end])) is not None:
                    found.append((costs[end - k] + cost, end - k))
            top, at = min(found, default=(math.inf, 0))
            costs.append(top)
            back.append(at)
        return costs[-1], back

    for word in sorted(counts, key=len):
        alone = math.log(total / counts[word])
        # a word, if it is more than its best split
        if alone + math.log(COHESION) < best(word, False)[0]:
            own[word] = alone
    back = best(name, True)[1]
    words, end = [], len(name)
    while end:
        words.append(name[back[end] : end])
        end = back[end]
    return words[::-1]


def segmented(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, words) of each distinct name. ``counts``: word and n."""
    names = stored(names.select("name").distinct())
    counts = stored(counts)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("name").to_pylist():
                for row in range(0, len(name), 4096):
                    parts = {name[i : i + k] for i in range(row, min(row + 4096, len(name))) for k in range(2, HEAD + 1) if i + k <= len(name)}
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(parts), pa.string()), pa.array(list(parts), pa.string())], ["name", "word"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("name").to_pylist(), batch.column("found").to_pylist(), strict=True)
            words = [split_name(name, {x["word"]: x["n"] for x in found or ()}, total) for name, found in rows]
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(words, pa.list_(pa.string()))], ["name", "words"])

    found = names.mapInArrow(substrings, "name string, word string").join(counts, "word")
    # longer words by their first letters
    long = counts.filter(F.length("word") > HEAD).select(F.substring("word", 1, HEAD).alias("head"), F.col("word").alias("long"), "n")
    heads = names.mapInArrow(substrings, "name string, word string").filter(F.length("word") == HEAD)
    longer = heads.join(long, F.col("word") == F.col("head")).filter(F.contains("name", "long")).select(F.col("long").alias("word"), "name", "n")
    found = found.unionByName(longer).groupBy("name").agg(F.collect_set(F.struct("word", "n")).alias("found"))
    return names.join(found, "name", "left").mapInArrow(cut, "name string, words array<string>")


_NAME = r"[a-z]+|[0-9]+|[^\x00-\x7f]+"


def url_words(judged: DataFrame, pages: DataFrame) -> DataFrame:
    """``judged`` (_row, host, path, ...) with ``words``: host and path words in order, marked by the part they stand in."""
    def marked(where: str, text: Column) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(_NAME), F.lit(0)), lambda x: F.struct(F.lit(where).alias("part"), x.alias("name")))

    names = F.concat(marked("h", F.col("host")), marked("p", F.lower("path")))
    rows = judged.select("_row", F.posexplode(names).alias("pos", "x")).select("_row", "pos", "x.part", "x.name")
    letters = rows.filter(F.col("name").rlike("^[a-z]"))
    split = stored(segmented(letters, word_counts(pages)))
    number = F.array(F.concat(F.lit("#"), F.length("name").cast("string")))
    words = F.when(F.col("name").rlike("^[0-9]"), number).otherwise(F.coalesce("words", F.array("name")))
    words = F.transform(words, lambda w: F.concat("part", F.when(w.startswith("#"), "").otherwise(":"), w))
    rows = rows.join(split, "name", "left").groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("pos", words.alias("words")))).alias("found"))
    joined = judged.join(rows, "_row", "left")
    none = F.expr("cast(array() as array<string>)")
    return joined.withColumn("words", F.coalesce(F.flatten(F.col("found.words")), none)).drop("found")


def fit_bayes(labelled: DataFrame, sample: int) -> tuple[float, dict[str, float]]:
    """(log odds of a block, log odds of each word), with one count added; ``labelled``: judged, url, words."""
    classes = [labelled.filter(F.col("judged") == c).orderBy(F.xxhash64("url"), "url", "_row").limit(sample) for c in ("allow", "block")]
    rows = stored(classes[0].unionByName(classes[1]).select("judged", "words"))
    prior = {r["judged"]: r["count"] for r in rows.groupBy("judged").count().collect()}
    counts: dict[str, dict[str, int]] = {"allow": {}, "block": {}}
    for r in rows.select("judged", F.explode("words").alias("w")).groupBy("w", "judged").count().collect():  # of the sample
        counts[r["judged"]][r["w"]] = r["count"]
    if not (prior.get("allow") and prior.get("block")):
        return -1.0, {}
    vocabulary = sorted(counts["allow"].keys() | counts["block"].keys())
    size = {k: sum(x.values()) + len(vocabulary) + 1 for k, x in counts.items()}
    share = lambda k, w: math.log((counts[k].get(w, 0) + 1) / size[k])
    return math.log(prior["block"] / prior["allow"]), {w: share("block", w) - share("allow", w) for w in vocabulary}


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, sample: int = SAMPLE) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, words (of the url) and block_score (log odds of the model)."""
    judged = parts(pages.select("page_id", "url")).withColumns({"rule": rule_of(rules, 1), "judged": rule_of(rules, 0)})
    judged = stored(judged.withColumn("_row", F.monotonically_increasing_id()))
    judged = stored(url_words(judged, pages))
    model = pages.sparkSession.sparkContext.broadcast(fit_bayes(judged.filter("judged IS NOT NULL"), sample))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, odds = model.value
        for batch in batches:
            scores = [start + sum(odds.get(w, 0.0) for w in words) for words in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "block_score"])

    judged = judged.drop("_row", "url")
    scored = judged.mapInArrow(score, schema_with(judged, "block_score", DoubleType()))
    verdict = F.coalesce("judged", F.when(F.col("block_score") > 0, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "words", "block_score")
