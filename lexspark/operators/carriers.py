"""Whether a sentence can carry a gap: an ordered set of reasons against it, over parsed sentences.

A parsed sentence is a row of ``trees`` whose tokens have ``tag`` too, the fine part of speech of the STTS scheme. Rules are array
expressions over a sentence's own tokens, in one chain whose first hit is the answer, so a later rule runs only where no earlier one holds.
Words that must be real are looked up in a dictionary by one join, for the sentences that come so far.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions import text as X
from lexspark.operators.paradigms import ADJECTIVE, DEFINITE, EIN, EIN_STEMS, cells
from lexspark.operators.trees import PREFIXES, children, let, told
from lexspark.storage import stored

# Tags and labels that decide results
FINITE_TAGS = ["VVFIN", "VAFIN", "VMFIN", "VVIMP", "VAIMP"]
SUBJECTS = ["sb", "ep"]
OPEN_ENDS = ["ART", "PIAT", "PPOSAT", "APPR", "APPRART", "KON", "KOUS", "KOUI", "KOKOM", "PTKZU"]
CLOSING_FORMS = ["VVPP", "VVINF", "VAINF", "VMINF", "VAPP", "VMPP", "VVIZU"]
CLAUSE_OPENERS = ["KOUS", "KOUI", "PRELS", "PRELAT", "PWS", "PWAV", "PWAT", "KOKOM"]
RELATIVE_TAGS = ["PRELS", "PRELAT"]
HEADLINE_DETERMINERS = ["ART", "PIAT", "PPOSAT", "PDAT", "PIDAT"]
DETERMINERS = ["ART", "PIAT", "PPOSAT"]
LOOKED_UP_FORMS = ["VVPP", "VVINF", "VAINF", "VMINF"]
HEADING_POS = ["NOUN", "PROPN", "NUM", "X", "ADJ"]
QUOTES = "\"„“”'‘’«»"
QUANTIFIERS = ["viel", "wenig", "einig", "mehrer"]
ADJECTIVE_ENDINGS = ["em", "en", "es", "er", "e"]
NEED_OBJECTS = ["kaufen", "schenken"]
TAKE_NO_DASS = ["kaufen", "schenken", "helfen"]
SIBILANTS = ["ss", "s", "ß", "z", "tz", "x"]
MEDIA_MARKS = ["symbolbild", "symbolfoto", "archivbild", "archivfoto", "foto", "fotos", "bild", "bilder", "quelle", "anzeige", "werbung"]
# In the order in which they are tried
REASONS = (
    "empty_sentence not_capitalized no_terminal_punctuation swiss_spelling opens_mid_quotation multiple_sentences fragment_too_short dangling_fragment no_finite_verb "
    "colon_joined_fragment no_main_clause_verb verb_final_fragment missing_clause_connector no_subject_found agreement_undecidable subject_verb_disagreement "
    "finite_verb_not_a_real_word content_word_not_a_real_word adjective_declension_mismatch dass_clause_missing_object dass_after_physical_action_verb"
).split()

#: Steps from a coordinated verb to the first of its row.
CONJUNCTS = 5
#: Heads from a token to the top of its tree; no sentence is as deep.
DEEPEST = 64
#: Different rows of words to look up that are broadcast; beyond that they are joined by a shuffle.
BROADCAST_ASKED = 200_000


def _token(x: Column) -> Column:
    return F.struct(*[x[c].alias(c) for c in ("i", "text", "lemma", "pos", "tag", "dep", "head", "morph")], F.lower(x["text"]).alias("low"))


def _some(array: Column, rule: Callable[[Column], Column]) -> Column:
    return F.exists(array, lambda x: told(rule(x)))


def _finite(x: Column) -> Column:
    return told(x["tag"].isin(FINITE_TAGS) & x["pos"].isin("VERB", "AUX"))


def _at(i: Column) -> Column:
    return F.get("t", i)


def _kids(x: Column) -> Column:
    return let(x["i"], lambda at: children(at))


def _walked(start: Column, steps: int, step: Callable[[Column], Column]) -> Column:
    """Where so many steps lead from a place."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda at, _: step(at))


def _row(i: Column) -> Column:
    """The first conjunct of a token: from each finite verb without a subject to the verb above the conjunction that it hangs on."""

    def before(x: Column, first: Column) -> Column:
        alone = ~_some(_kids(x), lambda c: c["dep"].isin(SUBJECTS))
        return F.when(told(_finite(first) & (first["i"] != x["i"]) & alone), first["i"]).otherwise(x["i"])

    step = lambda x: F.when(told(x["dep"] == "cj"), let(_at(_at(x["head"])["head"]), lambda first: before(x, first))).otherwise(x["i"])
    return _walked(i, CONJUNCTS, lambda at: let(_at(at), step))


def _lead(i: Column) -> Column:
    """The first conjunct of a token, whatever it is."""
    step = lambda x: F.when(told(x["dep"] == "cj"), F.coalesce(_at(_at(x["head"])["head"])["i"], x["i"])).otherwise(x["i"])
    return _walked(i, CONJUNCTS, lambda at: let(_at(at), step))


def _top(i: Column) -> Column:
    return _walked(i, DEEPEST, lambda at: F.coalesce(_at(_at(at)["head"])["i"], at))


def _with_tokens(parsed: DataFrame) -> DataFrame:
    return parsed.withColumn("t", F.coalesce(F.transform("tokens", _token), F.expr("array()")))


def _content() -> Column:
    return F.filter("t", lambda x: ~told(x["pos"] == "PUNCT"))


def _last(array: Column, back: int = 1) -> Column:
    return F.get(array, F.size(array) - back)


def several_sentences() -> Column:
    """A full stop after which another tree begins."""
    return F.exists("t", lambda x: told((_at(x["i"] - 1)["tag"] == "$.") & (_top(x["i"]) != _top(x["i"] - 1))))


def dangling() -> Column:
    """The last word expects another, unless it is the question "oder?"."""
    last = _last(_content())
    return told(last["tag"].isin(OPEN_ENDS)) & ~(told(last["tag"] == "KON") & F.col("text").rlike("(?i)\\boder\\s*\\?['\"”’)]*\\s*$"))


def colon_joined() -> Column:
    """A credit in brackets, or a part before or after a colon outside quotations that has no finite verb and no letters, is a heading, or opens with a noun and has a preposition."""
    marks = lambda x: x["text"].rlike(f"^[{QUOTES}]+$")
    punct = lambda x: told(x["pos"] == "PUNCT")
    inside = lambda x: F.size(F.filter("t", lambda q: marks(q) & (q["i"] < x["i"]))) % 2 == 1
    cuts = F.filter("t", lambda x: punct(x) & x["text"].contains(":") & ~marks(x) & ~inside(x))

    def part(k: Column) -> Column:
        start, end = F.when(k == 0, -1).otherwise(F.get(cuts, k - 1)["i"]), F.coalesce(F.get(cuts, k)["i"], F.size("t"))
        held = F.filter("t", lambda x: (x["i"] > start) & (x["i"] < end))
        words = F.filter(held, lambda x: ~punct(x))
        heading = (k == 0) & (F.size(words) > 0) & ~F.exists(words, lambda x: ~told(x["pos"].isin(HEADING_POS)))
        subheading = told(F.get(words, F.lit(0))["pos"].isin("NOUN", "PROPN")) & _some(words, lambda x: x["pos"] == "ADP")
        return ~F.exists(held, _finite) & (~F.exists(held, lambda x: x["text"].rlike(r"\p{L}")) | heading | subheading)

    credit = F.col("text").rlike(rf"(?i)\(\s*({'|'.join(MEDIA_MARKS)})\b[^)]*\)")
    return credit | ((F.size(cuts) > 0) & F.exists(F.sequence(F.lit(0), F.size(cuts)), part))


def headline() -> Column:
    """A noun with its determiner as the only root, whose verbs all stand in relative clauses."""
    roots = F.filter("t", lambda x: told(x["dep"] == "ROOT"))
    root = F.get(roots, F.lit(0))
    clauses = F.filter(_kids(root), lambda c: told(c["dep"] == "rc"))

    def under(x: Column, top: Column) -> Column:
        """Whether a walk up from x meets top, itself included."""
        start = F.struct(x["i"].alias("at"), (x["i"] == top).alias("met"))
        walk = lambda s, _: F.struct(F.coalesce(_at(s["at"])["head"], s["at"]).alias("at"), (s["met"] | told(_at(s["at"])["head"] == top)).alias("met"))
        return F.aggregate("t", start, walk, lambda s: s["met"])

    relative = lambda rc: F.exists("t", lambda x: told(x["tag"].isin(RELATIVE_TAGS) & (x["i"] < rc["i"])) & under(x, rc["i"]))
    verbal = _some(
        _kids(root), lambda c: (c["dep"] != "rc") & (_finite(c) | ((c["dep"] == "cd") & F.exists(_kids(c), lambda g: told(g["dep"] == "cj") & _finite(g))))
    )
    first = _at(F.lit(0))
    return (
        (F.size(roots) == 1) & told(root["pos"].isin("NOUN", "PROPN") & root["tag"].isin("NN", "NE") & (first["dep"] == "nk") & (first["head"] == root["i"]))
        & (F.size(clauses) > 0) & _some(_kids(root), lambda c: (c["dep"] == "nk") & c["tag"].isin(HEADLINE_DETERMINERS)) & ~verbal & F.forall(clauses, relative)
    )


def verb_final() -> Column:
    """The root closes the sentence right after a form that is not finite, and nothing opens a clause."""
    words = _content()
    last, before = _last(words), _last(words, 2)
    closes = _finite(last) & told((last["dep"] == "ROOT") & before["tag"].isin(CLOSING_FORMS) & (before["i"] == last["i"] - 1))
    return (F.size(words) >= 3) & closes & ~_some(F.col("t"), lambda x: x["tag"].isin(CLAUSE_OPENERS))


def no_connector(x: Column) -> Column:
    """A finite verb under another one without a conjunction of its own."""
    return ~told(x["dep"] == "ROOT") & _finite(_at(x["head"])) & ~_some(_kids(x), lambda c: c["dep"] == "cp")


def agreement(x: Column) -> Column:
    """What is wrong between a finite verb and its subject, null for nothing.

    A verb without a subject shares that of the conjunct before it, five conjuncts at most; imperatives at the start need none. Several
    subjects joined by a conjunction are third persons, plural, or cannot be told. Forms that one spelling shares agree: first and third
    person in the plural, in the past and in the subjunctive; "ihr" with "er" on -t; "du" with "er" after a sibilant; "du" with any form on -st.
    """
    found = let(_row(x["i"]), lambda r: children(r, lambda c: told(c["dep"].isin(SUBJECTS))))
    lead = lambda y: told((y["dep"] == "ROOT") & (y["i"] == 0)) & ~_some(_kids(y), lambda c: c["dep"].isin(SUBJECTS))
    order = let(_at(_lead(x["i"])), lead) & ~F.col("text").rlike(r"\?\s*$")
    joins = lambda s: children(s["i"], lambda c: told(c["dep"] == "cd"))
    one = lambda s: let(joins(s), lambda j: _disagreement(x, s, j))
    return let(found, lambda f: F.when(F.size(f) == 1, let(F.get(f, F.lit(0)), one)).when(~order, "no_subject_found"))


def _disagreement(x: Column, s: Column, joins: Column) -> Column:
    """What is wrong between a finite verb and its one subject, to which conjunctions join others."""
    person = lambda c: F.when(told((c["pos"] == "PRON") & (c["morph"]["PronType"] == "Prs") & c["morph"]["Person"].isin("1", "2")), c["morph"]["Person"]).otherwise(F.lit("3"))
    others = F.flatten(F.transform(joins, lambda cd: F.filter(_kids(cd), lambda c: told(c["dep"] == "cj"))))
    joined = F.size(joins) > 0
    thirds = (person(s) == "3") & F.forall(others, lambda c: person(c) == "3")
    vp, vn, tense = x["morph"]["Person"], x["morph"]["Number"], x["morph"]["Tense"]

    def hissing() -> Column:
        stem, held = F.regexp_replace(F.regexp_replace(x["lemma"], "en$", ""), "n$", ""), F.lit(False)
        for end in SIBILANTS:
            held = held | stem.endswith(end)
        return held

    def judged(p: Column, n: Column) -> Column:
        pair = lambda a, b: (F.concat(p, n) == a) & (F.concat(vp, vn) == b) | (F.concat(p, n) == b) & (F.concat(vp, vn) == a)
        shared = (
            pair("1Plur", "3Plur") | (pair("1Sing", "3Sing") & (told(tense == "Past") | told(x["morph"]["Mood"] == "Sub")))
            | (pair("2Plur", "3Sing") & (tense == "Pres") & x["low"].endswith("t")) | (pair("2Sing", "3Sing") & (tense == "Pres") & hissing())
        )
        agrees = told((p == vp) & (n == vn)) | told(shared) | told((p == "2") & (n == "Sing") & x["low"].endswith("st"))
        return F.when((joined & ~thirds) | n.isNull() | vp.isNull() | vn.isNull(), "agreement_undecidable").when(~agrees, "subject_verb_disagreement")

    p = F.when(joined, "3").otherwise(person(s))
    n = F.when(joined, "Plur").otherwise(F.coalesce(s["morph"]["Number"], F.when(told(s["pos"] == "VERB"), "Sing")))
    return let(F.struct(p.alias("p"), n.alias("n")), lambda q: judged(q["p"], q["n"]))


def _endings(declension: str, cases: set[str], gender: str, number: str) -> list[str]:
    return sorted({e for e, c, g, n in cells(ADJECTIVE[declension]) if c in cases and g == gender and n == number})


def allowed_endings() -> dict[str, list[str]]:
    """Endings of adjectives by ``determiner|gender|number``: an article's form, ``ein`` with its ending, a quantifier's ending after ``+``, ``-`` for none."""
    held: dict[str, list[str]] = {}
    strong: dict[str, set[str]] = {}
    for e, c, _, n in cells(ADJECTIVE["strong"]):
        if n == "Plur":
            strong.setdefault(e, set()).add(c)
    for g in ("Masc", "Fem", "Neut"):
        for n in ("Sing", "Plur"):
            for name, table, declension in (("", DEFINITE, "weak"), ("ein", EIN, "mixed")):
                forms: dict[str, set[str]] = {}
                for e, c, gender, number in cells(table):
                    if (gender, number) == (g, n):
                        forms.setdefault(e, set()).add(c)
                held |= {f"{name}{e}|{g}|{n}": _endings(declension, cases, g, n) for e, cases in forms.items()}
            held |= {f"+{e}|{g}|{n}": _endings("strong", cases, g, n) for e, cases in strong.items()}
            held[f"-|{g}|{n}"] = _endings("strong", set(DEFINITE), g, n)
    return {k: v for k, v in held.items() if v}


def determiner_key(x: Column) -> Column:
    """How a determiner declines what follows it: its form, ``ein`` with its ending, ``+`` with a quantifier's ending; null where it does not tell."""
    quantity = F.regexp_extract(x["low"], f"^(?:{'|'.join(QUANTIFIERS)})(em|en|es|er|e)$", 1)
    ein = F.regexp_extract(x["low"], f"^(?:{'|'.join(EIN_STEMS)})((?:e|en|em|er|es)?)$", 1)
    is_ein = x["low"].rlike(f"^(?:{'|'.join(EIN_STEMS)})(?:e|en|em|er|es)?$")
    return (
        F.when(told((x["tag"] == "ART") & (x["morph"]["Definite"] == "Def")), x["low"])
        .when(told((x["tag"] == "PIAT") & quantity.isin("e", "en", "er")), F.concat(F.lit("+"), quantity)).when(is_ein, F.concat(F.lit("ein"), ein))
    )


def declension() -> Column:
    """An adjective before a noun of known gender and number has an ending that its determiner leaves no case for."""
    allowed = F.create_map(*[x for k, v in allowed_endings().items() for x in (F.lit(k), F.array(*map(F.lit, v)))])

    def wrong(noun: Column) -> Column:
        known = told(noun["pos"].isin("NOUN", "PROPN") & noun["morph"]["Gender"].isNotNull() & noun["morph"]["Number"].isNotNull())
        return F.when(known, let(_kids(noun), lambda kids: off(noun, kids))).otherwise(False)

    def off(noun: Column, kids: Column) -> Column:
        held = F.filter(kids, lambda c: told((c["dep"] == "nk") & c["tag"].isin(DETERMINERS)))
        key = let(held, lambda h: F.when(F.size(h) == 0, "-").when(F.size(h) == 1, determiner_key(F.get(h, F.lit(0)))))
        endings = let(key, lambda k: F.when(k.isNotNull(), F.element_at(allowed, F.concat_ws("|", k, noun["morph"]["Gender"], noun["morph"]["Number"]))))
        ending = lambda a: F.regexp_extract(a["low"], f"^.+?({'|'.join(ADJECTIVE_ENDINGS)})$", 1)
        # forms of places, "Berliner", never change
        place = lambda a: (a["i"] > 0) & a["text"].rlike(r"^\p{Lu}") & (ending(a) == "er")
        adjectives = F.filter(kids, lambda a: told((a["dep"] == "nk") & (a["tag"] == "ADJA") & ~place(a) & (ending(a) != "")))
        wrong_in = lambda e, held: e.isNotNull() & _some(held, lambda a: ~F.array_contains(e, ending(a)))
        return let(adjectives, lambda held: F.when(F.size(held) > 0, let(endings, lambda e: wrong_in(e, held))).otherwise(False))

    return F.exists("t", wrong)


def _dass(x: Column) -> Column:
    return told((x["tag"] == "KOUS") & (x["dep"] == "cp") & (x["low"] == "dass"))


def dass_without_object() -> Column:
    """A clause with "dass" whose verb needs an object and has none: the relative "das" misspelt. The verb is found under up to four auxiliaries."""

    def below(at: Column) -> Column:
        held = children(at, lambda c: told((c["dep"] == "oc") & c["pos"].isin("VERB", "AUX")))
        return let(held, lambda h: F.when(F.size(h) == 1, F.get(h, F.lit(0))["i"]).otherwise(_at(at)["i"]))

    def wrong(x: Column) -> Column:
        lacks = lambda verb: told(verb["lemma"].isin(NEED_OBJECTS)) & ~_some(_kids(verb), lambda c: c["dep"].isin("svp", "oa", "oa2"))
        return F.when(_dass(x) & _finite(_at(x["head"])), let(_at(_walked(x["head"], 4, below)), lacks)).otherwise(False)

    return F.exists("t", wrong)


def dass_after_action() -> Column:
    """A clause with "dass" under a verb of doing that takes none: "kaufen, dass", "laden ... herunter, dass"."""

    def wrong(x: Column) -> Column:
        verb = _at(x["head"])
        up = _at(verb["head"])
        over = F.when(told(up["pos"].isin("NOUN", "PROPN")), _at(up["head"])).otherwise(up)
        sound = told(verb["pos"].isin("VERB", "AUX") & (up["i"] != verb["i"]) & over["pos"].isin("VERB", "AUX") & (over["i"] != verb["i"]))
        particles = F.transform(F.filter(_kids(over), lambda c: told(c["dep"] == "svp")), lambda c: c["low"])
        bad = F.when(over["lemma"] == "laden", particles == F.array(F.lit("herunter"))).otherwise(over["lemma"].isin(TAKE_NO_DASS) & (F.size(particles) == 0))
        return F.when(_dass(x), sound & told(bad)).otherwise(False)

    return F.exists("t", wrong)


def _asked() -> Column:
    """``(n, words)`` for each verb form that must be a real word: finite verbs of the present before infinitives and participles, with all the words that it may stand for."""

    def finite(x: Column) -> Column:
        base = F.when(told(x["morph"]["Number"] == "Plur"), x["low"]).otherwise(F.concat(F.regexp_replace(x["low"], "e$", ""), F.lit("en")))
        particle = F.filter(_kids(x), lambda c: told(c["dep"] == "svp"))
        return F.concat(F.array(base), F.when(F.size(particle) == 1, F.array(F.concat(F.get(particle, F.lit(0))["low"], base))).otherwise(F.expr("array()")))

    def counts(x: Column) -> Column:
        m = x["morph"]
        singular = (m["Number"] == "Sing") & (m["Person"] == "1") & x["low"].endswith("e") & (F.length(x["low"]) >= 3)
        return told((x["tag"] == "VVFIN") & (x["pos"] == "VERB") & (m["Mood"] == "Ind") & (m["Tense"] == "Pres") & (singular | ((m["Number"] == "Plur") & m["Person"].isin("1", "3"))))

    def other(x: Column) -> Column:
        cut = [F.when(x["low"].startswith(p + "ge"), F.substring(x["low"], len(p) + 1, 1_000)) for p in [*PREFIXES, "wieder"]]
        return F.array_compact(F.array(x["low"], *cut))

    row = lambda rule, words: lambda x: F.struct(rule.alias("rule"), F.transform(words(x), X.normalise).alias("words"))
    first = F.transform(F.filter("t", counts), row(F.lit(0), finite))
    second = F.transform(F.filter("t", lambda x: told(x["tag"].isin(LOOKED_UP_FORMS))), row(F.lit(1), other))
    return F.concat(first, second)


def validated(parsed: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """``parsed`` with ``reason``: the first of ``REASONS`` that speaks against a sentence, null for a sound one.

    ``parsed`` is ``(source, line_id, text, tokens)``, one row for each source and line; ``dictionary(word)`` has words in normal form, and without one
    every word is real. A sentence without text is ``empty_sentence``; one without tokens is too short. Morphology that is missing makes a
    verb undecidable and leaves nouns alone. Work grows with the square of a sentence's length; only different rows of words are shuffled, and only of
    sentences that no rule before the dictionary rejects. Sentences stay where they are unless more than ``BROADCAST_ASKED`` such rows are no words.
    """
    x = F.trim(F.coalesce("text", F.lit("")))
    p = _with_tokens(parsed.select("source", "line_id", x.alias("text"), "tokens"))
    verbs = F.filter("t", _finite)
    wrong = F.filter(F.transform(verbs, agreement), lambda r: r.isNotNull())
    early = (
        F.when(F.col("text") == "", "empty_sentence").otherwise(
            F.coalesce(
                X.shape_reason(F.col("text")),
                F.when(several_sentences(), "multiple_sentences").when(F.size(_content()) < 3, "fragment_too_short").when(dangling(), "dangling_fragment")
                .when(F.size(verbs) == 0, "no_finite_verb").when(colon_joined(), "colon_joined_fragment").when(headline(), "no_main_clause_verb")
                .when(verb_final(), "verb_final_fragment").when(F.exists(verbs, no_connector), "missing_clause_connector").otherwise(F.get(wrong, F.lit(0))),
            )
        )
    )
    late = F.when(declension(), "adjective_declension_mismatch").when(dass_without_object(), "dass_clause_missing_object").when(dass_after_action(), "dass_after_physical_action_verb")
    p = p.withColumn("early", early)
    p = p.select("source", "line_id", "text", "early", F.when(F.col("early").isNull(), late).alias("late"), F.when(F.col("early").isNull(), _asked()).alias("asked"))
    if dictionary is None:
        return p.select("source", "line_id", "text", F.coalesce("early", "late").alias("reason"))
    p = stored(p)
    # what a sentence asks for hangs on its forms only: each different row of them is looked up once
    rows = p.where(F.size("asked") > 0).select("asked").distinct()
    words = rows.select("asked", F.posexplode("asked").alias("n", "a")).select("asked", "n", "a.rule", F.explode("a.words").alias("word"))
    real = dictionary.select("word", F.lit(True).alias("real")).distinct()
    unreal = words.join(real, "word", "left").groupBy("asked", "n", "rule").agg(F.max("real").alias("real")).where("real is null")
    unreal = stored(unreal.groupBy("asked").agg(F.min("rule").alias("rule")))
    unreal_reason = F.when(F.col("rule") == 0, "finite_verb_not_a_real_word").when(F.col("rule") == 1, "content_word_not_a_real_word")
    told_of = lambda held: held.select("source", "line_id", "text", F.coalesce("early", unreal_reason, "late").alias("reason"))
    if unreal.count() <= BROADCAST_ASKED:
        return told_of(p.join(F.broadcast(unreal), "asked", "left"))
    asks = told(F.size("asked") > 0)
    return told_of(p.where(asks).join(unreal, "asked", "left")).unionByName(told_of(p.where(~asks).withColumn("rule", F.lit(None).cast("int"))))


def reason_counts(validated: DataFrame) -> DataFrame:
    """``(source, reason, n)`` of rejected sentences, and ``fine`` for the others."""
    return validated.groupBy("source", F.coalesce("reason", F.lit("fine")).alias("reason")).agg(F.count("*").alias("n"))
