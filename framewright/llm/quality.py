"""Quality rules, line first: lines that fail a rule go, then documents that lost too much text.

DataFrame functions only. Each line is judged on its own:

* navigation: at least three separators (``|``), one for every four words or more;
* symbols: runs of symbols ``#*$%&|<>``, three or more and three for every ten words or more;
* shouting: five words or more, with letters, none of them lower-case;
* boilerplate: a stock phrase of web pages in a line of at most ``boilerplate_words`` words;
* punctuation: ``unpunctuated_words`` words or more without any sentence end.

A document is kept if it passes the base rules (``min_words``; words inside repeated 3-word windows at most half)
and the failed lines held at most ``max_removed`` of its word characters.

Edge cases: null and empty texts have no words and are rejected; repeated rows are judged alike and all returned;
an empty table gives an empty table; other columns stay as they are, and a column that has the name of a result is
replaced by it. Memory is bounded by one text. A filter on ``kept`` that is pushed below the results computes them twice;
store the results first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Stock phrases of web pages, lower-case, by language.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "javascript",
    "click here", "read more", "sign up", "log in", "subscribe to", "share this", "lorem ipsum",
    "alle rechte vorbehalten", "weiterlesen", "jetzt anmelden", "nutzungsbedingungen",
    "tous droits réservés", "en savoir plus", "politique de confidentialité", "conditions d'utilisation",
    "todos los derechos reservados", "leer más", "política de privacidad", "términos de uso",
)
RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text"]


def _line_fails(line: Column, boilerplate_words: int, unpunctuated_words: int) -> Column:
    # words; in a line whose only blanks are single spaces between words, one more than the spaces
    spaces = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))
    n = F.when(line.rlike(r"[\x09-\x0D]|^ |  | $|^$"), F.regexp_count(line, F.lit(WORD))).otherwise(spaces + 1)
    bars = F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))
    symbols = F.regexp_count(line, F.lit(r"[#*$%&|<>]+"))
    phrase = line.rlike("(?i)" + "|".join(BOILERPLATE))
    return (
        ((bars >= 3) & (bars * 4 >= n))
        | (line.rlike(r"[#*$%&|<>]") & (symbols >= 3) & (symbols * 10 >= n * 3))
        | (~line.rlike(r"\p{Ll}") & line.rlike(r"\p{Lu}") & (n >= 5))
        | (~line.rlike(r"[.!?…。؟।;:]") & (n >= unpunctuated_words))
        | ((n <= boilerplate_words) & phrase)
    )


_N = "greatest(size(_words) - 2, 0)"
#: 3-word windows, by the upper bits of their hash, with their place in the lower bits that places of this text need.
_WINDOWS = f"arrays_zip(slice(_words, 1, {_N}), slice(_words, 2, {_N}), slice(_words, 3, {_N}))"
_MASK = "(shiftleft(1L, length(bin(size(_words)))) - 1)"
_PACKED = f"sort_array(transform({_WINDOWS}, (w, i) -> (xxhash64(w) & ~m) | i))"
#: Places of windows that share the hash's bits with another; then, by their words, those that do stand twice or more.
_MAYBE = "transform(filter(s, (x, k) -> (k > 0 AND (s[k - 1] ^ x) & ~m = 0) OR (k + 1 < size(s) AND (s[k + 1] ^ x) & ~m = 0)), x -> cast(x & m AS int))"
_BY_WORDS = f"sort_array(transform({_MAYBE}, i -> struct(struct(_words[i], _words[i + 1], _words[i + 2]) AS w, i AS i)))"
_TWICE = "filter(t, (x, k) -> (k > 0 AND t[k - 1].w = x.w) OR (k + 1 < size(t) AND t[k + 1].w = x.w))"
#: Words inside them. Each transform over one element binds a name.
_REPEAT_WORDS = (
    f"transform(transform(transform(array({_MASK}), m -> transform(array({_PACKED}), s -> {_BY_WORDS})[0]), t -> {_TWICE}), "
    "r -> size(array_distinct(flatten(transform(r, x -> array(x.i, x.i + 1, x.i + 2))))))[0]"
)


def quality_rules(
    docs: DataFrame,
    text: str = "text",
    min_words: int = 50,
    max_removed: float = 0.4,
    boilerplate_words: int = 25,
    unpunctuated_words: int = 40,
) -> DataFrame:
    """``docs`` with the rule measures, ``base_failed``, ``kept`` and ``clean_text`` (the lines that passed)."""
    names = {f"k{i}": c for i, c in enumerate(docs.columns) if c not in RESULTS}
    others = list(names)
    safe = F.coalesce(F.col(text).cast("string"), F.lit(""))
    df = docs.select(*(F.col(f"`{c}`").alias(k) for k, c in names.items()), safe.alias("_text"), F.regexp_extract_all(safe, F.lit(WORD), F.lit(0)).alias("_words"))
    clean = F.filter(F.split("_text", "\n"), lambda x: ~_line_fails(x, boilerplate_words, unpunctuated_words))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumns({"_lines": lines, "_clean": F.array_join(clean, "\n")})
    spaces = r"[\x20\x09-\x0D]+"
    n_words, repeat = F.col("n_words"), F.col("n_repeat_words")
    df = df.select(
        *others,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr(_REPEAT_WORDS).cast("long").alias("n_repeat_words"),
        "_clean",
    )
    lost = F.col("word_chars") - F.length(F.regexp_replace("_clean", spaces, ""))
    df = df.withColumn("base_failed", (n_words < min_words) | (100 * repeat > 50 * n_words))
    return df.select(
        *(F.col(k).alias(c) for k, c in names.items()),
        *RESULTS[:6],
        (~F.col("base_failed") & (lost <= max_removed * F.col("word_chars"))).alias("kept"),
        F.col("_clean").alias("clean_text"),
    )
