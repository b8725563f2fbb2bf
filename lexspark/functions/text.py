"""Strings: normal forms, keys, ids, tokens and the comparisons of answers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A sentence: what runs up to closing marks or a line's end.
SENTENCE = r"[^.!?\n]+[.!?]*"
LETTERS = r"\p{L}+"
#: Words with exactly one space between them.
RUN = r"\p{L}+(?: \p{L}+)*"


def normalise(x: Column) -> Column:
    """Lower case without outer space and with ss for sharp s. Composed characters (NFC) are expected from ingest."""
    return F.replace(F.lower(F.trim(x)), F.lit("ß"), F.lit("ss"))


def ascii_fold(x: Column) -> Column:
    """Umlauts as their base letters, sharp s as ss."""
    return F.replace(F.translate(x, "äöüÄÖÜ", "aouAOU"), F.lit("ß"), F.lit("ss"))


def transliterate(x: Column) -> Column:
    """Umlauts as a letter and e, sharp s as ss, in lower case."""
    x = F.lower(x)
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def slug(x: Column) -> Column:
    """A key of a-z, 0-9 and single underscores."""
    return F.trim(F.regexp_replace(transliterate(x), "[^a-z0-9]+", "_"), F.lit("_"))


def card_id(unit_id: Column, sentence: Column) -> Column:
    """Twelve hex digits that name a unit's sentence."""
    return F.substring(F.sha1(F.concat(unit_id, F.lit("\n"), sentence)), 1, 12)


def reserve_letter(x: Column) -> Column:
    """First letter without its umlaut, ``_`` for what is no letter."""
    first = F.translate(F.lower(F.substring(x, 1, 1)), "äöüß", "aous")
    return F.when(first.rlike("^[a-z]$"), first).otherwise(F.lit("_"))


def letter_tokens(x: Column) -> Column:
    """Lower-case runs of letters, in order."""
    return F.regexp_extract_all(F.lower(x), F.lit(LETTERS), F.lit(0))


def sentences_of(x: Column) -> Column:
    """Trimmed sentences of a text."""
    return F.transform(F.regexp_extract_all(x, F.lit(SENTENCE), F.lit(0)), lambda s: F.trim(s))


def plausible(x: Column) -> Column:
    """Whether a sentence can stand alone: 25-160 characters, 5-18 words, closed by a mark, no markup."""
    words = F.size(F.split(F.trim(x), r"\s+"))
    return F.length(x).between(25, 160) & x.rlike("[.!?]$") & words.isin(*range(5, 19)) & ~x.rlike(r"[|<>\[\]{}\t]")  # unlike between, isin splits once


# Words whose double s is theirs in any spelling, and Swiss spellings; those of "groß" and "weiß" are names with a capital
OWN_DOUBLE_S = ("diesseits", "jenseits")
SWISS = ("heissend", "heissen", "heisst", "heisse", "hiessen", "hiess", "geheissen", "draussen")
SWISS_SMALL = ("gross", "grosse", "grossem", "grossen", "grosser", "grosses", "weiss", "weisse", "weissem", "weissen", "weisser", "weisses", "weisst")
SWISS_STEM = "^(?:strasse.*|fuss(?:es)?|füsse.*|mass(?:es)?|spass(?:es)?)$"
SWISS_NUMBER = r"[0-9]['’][0-9]{3}(?:[^0-9]|$)"
#: A double quotation mark, the first of the text, that closes what was not opened.
MID_QUOTATION = r"^[^\"„“”«»]*[^\s(\[{<\"„“”«»][\"“”«](?:[^\p{L}\p{N}]|$)"
#: The same for Java alone, which gives back nothing of the run.
FIRST_QUOTATION = r"^[^\"„“”«»]*+(?<=[^\s(\[{<\"„“”«»])[\"“”«](?:[^\p{L}\p{N}]|$)"
TERMINAL = r"[.!?…]['\"”’)]*\s*$"


def swiss_spelling(x: Column) -> Column:
    """Whether a sentence writes ss for sharp s after a long vowel, or parts thousands by an apostrophe."""

    def word(w: Column) -> Column:
        low = F.lower(w)
        diphthong = low.rlike("(?:ei|eu|äu|ie)ss") & ~low.isin(*OWN_DOUBLE_S) & ~(low.startswith("weiss") & (w != low))
        return F.contains(low, F.lit("ss")) & (low.isin(*SWISS) | w.isin(*SWISS_SMALL) | low.rlike(SWISS_STEM) | diphthong)  # all of these have ss

    words = F.exists(F.regexp_extract_all(x, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), word)
    return (F.contains(F.lower(x), F.lit("ss")) & words) | ((F.contains(x, F.lit("'")) | F.contains(x, F.lit("’"))) & x.rlike(SWISS_NUMBER))


def opens_mid_quotation(x: Column) -> Column:
    """``MID_QUOTATION`` without trying every place: texts without a closing mark are left out, and the first mark ends the one run before it."""
    closes = F.contains(x, F.lit('"')) | F.contains(x, F.lit("“")) | F.contains(x, F.lit("”")) | F.contains(x, F.lit("«"))
    return closes & x.rlike(FIRST_QUOTATION)


def shape_reason(x: Column) -> Column:
    """The first rule of shape that a sentence breaks, else null. The first letter counts, whatever stands before it."""
    return (
        F.when(~F.regexp_extract(x, r"\p{L}", 0).rlike(r"^(?:\p{Lu}|$)"), "not_capitalized")
        .when(~x.rlike(TERMINAL), "no_terminal_punctuation")
        .when(swiss_spelling(x), "swiss_spelling")
        .when(opens_mid_quotation(x), "opens_mid_quotation")
    )


def gloss_ok(german: Column, english: Column) -> Column:
    """A gloss with text, on one line, of 0.4 to 2.5 times the sentence's length."""
    ratio = F.length(english) / F.length(german)
    return F.coalesce((F.trim(english) != "") & ~F.contains(english, F.lit("\n")) & (F.length(german) > 0) & ratio.between(0.4, 2.5), F.lit(False))


def gloss_senses(x: Column) -> Column:
    """The senses that a gloss lists, without brackets, articles and the infinitive's to, each once."""
    plain = F.regexp_replace(F.lower(x), r"\([^)]*\)", " ")
    parts = F.transform(F.split(plain, r"[,;/]"), lambda s: F.trim(F.regexp_replace(F.trim(s), r"^(?:to|the|an|a) ", "")))
    return F.array_distinct(F.filter(parts, lambda s: s != ""))


def adjacent_transposition(a: Column, b: Column) -> Column:
    """Whether two words of one length differ by two neighbours that changed places."""
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    i, j = F.get(places, F.lit(0)), F.get(places, F.lit(1))
    swapped = (F.substr(a, i, F.lit(1)) == F.substr(b, j, F.lit(1))) & (F.substr(a, j, F.lit(1)) == F.substr(b, i, F.lit(1)))
    return F.coalesce((F.length(a) == F.length(b)) & (F.size(places) == 2) & (j - i == 1) & swapped, F.lit(False))


def common_prefix(a: Column, b: Column) -> Column:
    """How many characters two words begin with alike."""
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(a, F.lit(1), i) == F.substr(b, F.lit(1), i))
    return F.when(n == 0, F.lit(0)).otherwise(F.size(same))


def typo(a: Column, b: Column, ending: int = 2) -> Column:
    """One edit outside the last ``ending`` letters, or neighbours that changed places: a slip, not another form."""
    edit = (F.levenshtein(a, b) == 1) & (common_prefix(a, b) < F.greatest(F.length(a), F.length(b)) - ending)
    return (F.length(b) > 3) & (edit | adjacent_transposition(a, b))


def compound_splits(x: Column, least: int = 4) -> Column:
    """(head, tail) of each cut that leaves both parts ``least`` letters."""
    places = F.sequence(F.lit(least), F.greatest(F.length(x) - least, F.lit(least)))
    cuts = F.transform(places, lambda i: F.struct(F.substr(x, F.lit(1), i).alias("head"), F.substr(x, i + 1).alias("tail")))
    return F.when(F.length(x) >= 2 * least, cuts).otherwise(F.filter(cuts, lambda _: F.lit(False)))
