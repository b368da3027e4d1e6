"""Tokenisers and word edit distance as native column expressions.

Three tokenisers that are not interchangeable: `n1` keeps letters, digits and underscores; `n2` letters and digits;
`n3` strips ASCII punctuation from words split at white space and keeps a word that becomes empty. Each maps null to
an empty array. word_distance stays in the JVM: the distinct words of a pair become one character each and the
built-in levenshtein does the rest.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the ASCII punctuation that n3 deletes.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Distinct words of a pair that have a character of their own: U+4E00 up to the surrogates, then all beyond the BMP.
IN_BMP = 0xD800 - 0x4E00
MAX_WORDS = IN_BMP + 0x100000


def _split(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def n1(text: Column) -> Column:
    return _split(F.regexp_replace(F.lower(text), r"(?U)[^\p{L}\p{N}_\s]", ""))


def n2(text: Column) -> Column:
    return _split(F.regexp_replace(F.lower(text), r"(?U)[^\p{L}\p{N}\s]", ""))


def n3(text: Column) -> Column:
    return F.transform(_split(text), lambda w: F.translate(F.lower(w), PUNCTUATION, ""))


MODES = {"n1": n1, "n2": n2, "n3": n3}


def normalize_words(text: Column, mode: str = "n1") -> Column:
    """array<string> of the words of text by one of the tokenisers."""
    return MODES[mode](text)


def squeeze(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def word_distance(ref: Column, hyp: Column) -> Column:
    """Levenshtein distance of two word arrays; null for a null array. A pair of more than MAX_WORDS (1 083 904) distinct
    words fails the query, as it has more words than there are characters.

    The pair and its vocabulary go through a one-element array, as an expression inside a lambda is evaluated anew for
    every word.
    """
    pair = F.struct(F.array_distinct(F.concat(ref, hyp)).alias("voc"), ref.alias("r"), hyp.alias("h"))

    def code(words: Column, voc: Column) -> Column:
        def one(w: Column) -> Column:
            at = F.array_position(voc, w) - 1
            far = at - IN_BMP  # a surrogate pair
            return F.when(at < IN_BMP, at + 0x4E00).otherwise((F.shiftright(far, 10) + 0xD800) * 0x10000 + far.bitwiseAND(0x3FF) + 0xDC00)

        return F.array_join(F.transform(words, lambda w: F.decode(F.unhex(F.hex(one(w))), "UTF-16BE")), "")

    def distance(p: Column) -> Column:
        found = F.levenshtein(code(p["r"], p["voc"]), code(p["h"], p["voc"]))
        return F.when(F.size(p["voc"]) <= MAX_WORDS, found).when(p["voc"].isNotNull(), F.raise_error(F.lit("too many distinct words in a pair")).cast("int"))

    return F.get(F.transform(F.array(pair), distance), F.lit(0))


def error_rate(ref: Column, hyp: Column) -> Column:
    """Word error rate of two word arrays; null if the reference has no word."""
    return F.try_divide(word_distance(ref, hyp), F.size(ref))


def chains(segments: Column, words) -> Column:
    """struct<a, b>: the words of the first and the second speaker in order of appearance; later speakers are dropped.

    segments is array<struct<speaker, text, ..>>, words turns a text column into an array of words.
    """
    who = F.array_distinct(F.transform(segments, lambda s: s["speaker"]))
    of = lambda i: F.flatten(F.transform(F.filter(segments, lambda s: s["speaker"].eqNullSafe(F.get(who, F.lit(i))) & (F.size(who) > i)), lambda s: words(s["text"])))
    return F.struct(of(0).alias("a"), of(1).alias("b"))


def speaker_texts(segments: Column) -> Column:
    """array<struct<speaker, text>>: one joined text per speaker in order of appearance; speakers without text dropped."""
    who = F.array_distinct(F.transform(segments, lambda s: s["speaker"]))
    joined = F.transform(
        who,
        lambda x: F.struct(
            x.alias("speaker"),
            F.array_join(F.transform(F.filter(segments, lambda s: s["speaker"].eqNullSafe(x)), lambda s: F.coalesce(s["text"], F.lit(""))), " ").alias("text"),
        ),
    )
    return F.filter(joined, lambda s: F.trim(s["text"]) != "")
