"""Dependency trees inside one row: children, governing verbs and separated particles of a parsed sentence.

A parsed sentence is a row ``(source, line_id, text, tokens)``; tokens are structs ``(i, text, lemma, pos, dep, head, idx, morph)``
in sentence order, ``head`` being the place of the governing token (its own for the root) and ``morph`` a map. Labels are those of
the TIGER scheme (``sb``, ``oa``, ``da``, ``op``, ``mo``, ``nk``, ``oc``, ``svp``, ``cvc``, ``pd``). Nothing is exploded: all steps are array expressions
over the sentence's own tokens, with at most four hops, so no row meets another.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Closed classes of German that decide results
AUXILIARIES = ["haben", "sein", "werden", "möchten", "können", "müssen", "wollen", "dürfen", "sollen"]
PREFIXES = ["ab", "an", "auf", "aus", "bei", "ein", "fest", "her", "hin", "los", "mit", "nach", "vor", "weg", "weiter", "zu", "zurueck", "zurück", "zusammen"]
INSEPARABLE = ["be", "emp", "ent", "er", "ge", "miss", "ver", "zer"]
PARTICLES = (
    "abwärts auseinander aufwärts bekannt bereit dar davon dazu durch empor entgegen entlang fehl fern fort frei gegenüber gleich gut heim herab heran herauf heraus "
    "herbei herein herüber herum herunter hervor hierher hinab hinauf hinaus hindurch hinein hinterher hinüber hinunter hinweg hinzu hoch inne instand kaputt kennen "
    "klar leer nahe nieder offen preis ran raus rein rüber rum runter schwer sicher statt still teil tot über übrig um umher unter verloren voran voraus vorbei vorüber "
    "vorwärts wahr wider wieder zugrunde zugute zurecht zustande zuteil zuvor zuwider"
).split()
ADVERB_PARTICLES = ["wieder", "weiter", "zurück"]
PRONOMINAL = ["da", "dar", "wo", "wor", "hier"]
AFTER_NO_PARTICLE_POS, AFTER_NO_PARTICLE_TEXT = ["NOUN", "PROPN", "DET", "NUM", "X"], [":", '"', "„", "'", "http"]
REFLEXIVES = ["sich", "mich", "dich", "uns", "euch", "mir", "dir"]


def told(condition: Column) -> Column:
    """The condition, false where something in it is missing."""
    return F.coalesce(condition, F.lit(False))


def is_word(x: Column) -> Column:
    """Letters, with hyphens."""
    return x.rlike(r"^-*\p{L}[\p{L}\-]*$")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once. Inside array functions each mention of an expression is worked out anew."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sole(found: Column) -> Column:
    return let(found, lambda f: F.when(F.size(f) == 1, F.get(f, F.lit(0))))


def children(at: Column, *rules: Callable[[Column], Column]) -> Column:
    """Tokens right under a place that fit all rules."""

    def fits(c: Column) -> Column:
        held = (c["head"] == at) & (c["i"] != at)
        for rule in rules:
            held = held & rule(c)
        return held

    return F.filter("t", fits)


def separable(low: Column, apart: Column) -> tuple[Column, Column]:
    """Whether a prefix is to be trusted, ``apart`` being what stands beside it or before it against that, and whether only if it makes a word with its verb."""
    pronominal = F.lit(False)
    for head in PRONOMINAL:
        pronominal = pronominal | low.startswith(head)
    return (low != "da") & ~apart, (pronominal & (low != "dazu")) | low.isin(ADVERB_PARTICLES) | ~low.isin(PREFIXES + PARTICLES)


def stands_apart(before: Column, after: Column) -> Column:
    """Whether the tokens beside a prefix show that it is none."""
    return told(before["low"] == "und") | told(after["low"] == "und") | told(after["pos"].isin(AFTER_NO_PARTICLE_POS) | after["text"].isin(AFTER_NO_PARTICLE_TEXT))


def _prefix(p: Column) -> Column:
    of_von = (p["low"] == "aus") & F.exists("t", lambda x: (x["low"] == "von") & (x["pos"] == "ADP") & (x["i"] < p["i"]))
    trusted, needs = separable(p["low"], stands_apart(F.get("t", p["i"] - 1), F.get("t", p["i"] + 1)) | of_von)
    return F.when(p.isNotNull() & trusted, F.struct(p["i"].alias("i"), p["low"].alias("low"), p["idx"].alias("idx"), p["text"].alias("text"), needs.alias("needs")))


def particle_at(at: Column) -> Column:
    """``(i, low, idx, text, needs)`` of a verb's separated prefix, null for none or one that is not to be trusted; ``needs``: only if it makes a word with the verb."""
    return let(_sole(children(at, lambda c: c["dep"] == "svp")), _prefix)


def sole(found: Column) -> Column:
    """Of tokens those whose head no other of them has."""
    return let(found, lambda all_: F.filter(all_, lambda p: F.size(F.filter(all_, lambda q: q["head"] == p["head"])) == 1))


def particles() -> Column:
    """``particle_at`` of all verbs that have one, by place: the sentence's tokens are gone through once, not once a verb."""
    prefixes = sole(F.filter("t", lambda c: told((c["dep"] == "svp") & (c["head"] != c["i"]))))
    verbs = F.filter(prefixes, lambda p: told(F.get("t", p["head"])["pos"] == "VERB"))
    entries = F.transform(verbs, lambda p: F.struct(p["head"].cast("int").alias("at"), _prefix(p).alias("p")))
    return F.map_from_entries(F.filter(entries, lambda e: e["p"].isNotNull()))


def form_key(x: Column) -> Column:
    """Which form of a verb a token shows: ``Fin|Pres|3|Sing``, ``Part``, ``Inf``; ``K1`` for reported speech."""
    m = x["morph"]
    form = F.coalesce(m["VerbForm"], F.lit("Fin"))
    part = lambda k: F.coalesce(m[k], F.lit("?"))
    return F.when(form == "Fin", F.concat_ws("|", F.lit("Fin"), part("Tense"), part("Person"), part("Number"), F.when(reported(x), F.lit("K1")))).otherwise(form)


def reported(x: Column) -> Column:
    return told((x["morph"]["Mood"] == "Sub") & (x["morph"]["Tense"] == "Pres"))


def clause_at(at: Column) -> Column:
    """The place of the one clausal object under a place, -1 for none or several."""
    return F.coalesce(_sole(children(at, lambda c: c["dep"] == "oc", lambda c: c["pos"] == "VERB"))["i"], F.lit(-1))


def _next(at: Column) -> Column:
    """Where a walk goes from a place: nowhere from a lexical verb, to the clausal object under an auxiliary, to -1 elsewhere. Children are only sought where they decide."""

    def step(x: Column) -> Column:
        modal = x["lem"].isin(AUXILIARIES) | ~x["lem"].endswith("n")
        verb = x["pos"] == "VERB"
        below = let(clause_at(x["i"]), lambda b: F.when(verb & ~(modal & (b >= 0)), x["i"]).when((x["pos"] == "AUX") | modal, b).otherwise(-1))
        return F.when(x.isNull(), -1).when(verb & ~modal, x["i"]).when(~x["pos"].isin("VERB", "AUX") & ~modal, -1).otherwise(below)

    return let(F.get("t", at), lambda x: F.coalesce(step(x), F.lit(-1)))


def verb_of(x: Column) -> Column:
    """The place of the lexical verb that governs a token, through auxiliaries and modals with one clausal object, -1 for none."""
    last = F.aggregate(F.array(F.lit(1), F.lit(2), F.lit(3)), x["head"].cast("int"), lambda at, _: _next(at))
    return let(last, lambda v: F.when((v >= 0) & (_next(v) == v), v).otherwise(-1))


def _up(at: Column) -> Column:
    return F.get("t", at)["head"]


def reflexive_at(at: Column) -> Column:
    """Whether a reflexive pronoun hangs on a place or up to three heads above; null beyond the sentence."""
    pronouns = F.filter("t", lambda c: told((c["pos"] == "PRON") & c["low"].isin(REFLEXIVES) & (c["morph"]["Reflex"] == "Yes") & (c["head"] != c["i"])))
    h1 = _up(at)
    over = lambda held: F.array_contains(held, at) | told(F.array_contains(held, h1)) | told(F.array_contains(held, _up(h1))) | told(F.array_contains(held, _up(_up(h1))))
    return F.when(F.get("t", at).isNotNull(), let(F.transform(pronouns, lambda c: c["head"]), lambda held: F.when(F.size(held) == 0, False).otherwise(over(held))))


def finite_at(at: Column) -> Column:
    """The place of the finite verb above a place, three heads at most."""
    ends = lambda i: let(F.get("t", i), lambda x: (x["head"] == x["i"]) | told(F.get("t", x["head"])["morph"]["VerbForm"] == "Fin"))
    h1, h2, h3 = _up(at), _up(_up(at)), _up(_up(_up(at)))
    return F.when(ends(at), h1).when(ends(h1), h2).when(ends(h2), h3).otherwise(_up(h3))


def subject_at(at: Column) -> Column:
    """Morphology of the first subject under a place."""
    return F.get(children(at, lambda c: c["dep"] == "sb"), F.lit(0))["morph"]


def with_tokens(parsed: DataFrame) -> DataFrame:
    """``(source, line_id, text, t)``: ``t`` the tokens with lower-case ``low`` and ``lem``. The functions of this module look at it."""
    token = lambda x: F.struct(*[x[c].alias(c) for c in ("i", "text", "lemma", "pos", "dep", "head", "idx", "morph")], F.lower(x["text"]).alias("low"), F.lower(x["lemma"]).alias("lem"))
    return parsed.select("source", "line_id", "text", F.coalesce(F.transform("tokens", token), F.expr("array()")).alias("t"))


def with_trees(parsed: DataFrame) -> DataFrame:
    """``(source, line_id, text)`` with arrays that have an entry for each token.

    ``t`` (see ``with_tokens``); ``kids`` the tokens right under each; ``clause`` (see ``clause_at``), ``verb`` (``verb_of``), ``particle`` (``particle_at``),
    ``reflexive``, ``finite`` and ``subject`` of each. Sentences without tokens have empty arrays; a head that is no token's place leads nowhere.
    The detectors ask for what they need at the tokens that they need it for, and never hold these arrays: work grows with the square of a sentence's length.
    """
    at = {"kids": children, "clause": clause_at, "particle": particle_at, "reflexive": reflexive_at, "finite": finite_at, "subject": subject_at}
    each = lambda f: F.transform("t", lambda x: f(x["i"]))
    return with_tokens(parsed).select("source", "line_id", "text", "t", F.transform("t", verb_of).alias("verb"), *[each(f).alias(name) for name, f in at.items()])
