"""Units of vocabulary in parsed sentences: verbs with prepositions, reflexive and separable verbs, collocations, single words.

Every detector is an array of candidates over a sentence's tokens (see ``trees``), exploded at its end. Cheap rules on a token come before walks through
the tree, which are made for the tokens that are left; no tree is stored. What the dictionary decides
about a verb (whether the lemma is a word, whether a particle makes a word with it, whether it is written with its prefix) hangs on the verb's lemma
and particle only. These pairs are looked up once in a small table that is joined to the candidates; sentences are never regrouped.

Occurrences are ``(kind, unit_key, parts, tokens, source, line_id, text, form_key, case, evidence)``, tokens being ``(i, start, end, text)`` in sentence order.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions.text import normalise
from lexspark.operators.trees import INSEPARABLE, PREFIXES, REFLEXIVES, children, finite_at, form_key, is_word, let, particle_at, particles, reflexive_at, reported, subject_at, told, verb_of, with_tokens
from lexspark.storage import stored

#: Pairs of a verb's lemma and particle that are broadcast; beyond that they are joined by a shuffle.
BROADCAST_VERBS = 200_000

# Closed classes that decide results
CONTRACTED = {"am": "an", "ans": "an", "im": "in", "ins": "in", "zum": "zu", "zur": "zu", "beim": "bei", "vom": "von", "aufs": "auf", "fürs": "für", "ums": "um", "übers": "über", "durchs": "durch", "hinters": "hinter", "unters": "unter", "vors": "vor"}
CASES = {"Acc": "Akk", "Dat": "Dat", "Gen": "Gen"}
NO_COMPLEMENT = "seit während trotz wegen statt anstatt laut ab je pro per via binnen innerhalb außerhalb gemäß zwecks mangels dank".split()
TEMPORAL_NOUNS = (
    "tag woche monat jahr stunde minute sekunde uhr zeit mal morgen vormittag mittag nachmittag abend nacht wochenende montag dienstag mittwoch donnerstag freitag samstag "
    "sonnabend sonntag januar februar märz april mai juni juli august september oktober november dezember beginn anfang ende jahrhundert jahrzehnt sommer winter herbst "
    "frühling frühjahr saison moment augenblick weile zeitpunkt termin datum feiertag weihnachten ostern silvester prozent euro dollar meter kilometer grad million milliarde "
    "ort stelle unfallort unfallstelle tatort einsatzort stadt haus hause straße platz rand seite boden wand tisch bett"
).split()
NUMBER_WORDS = "eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf halb viertel mitternacht mittag".split()
AGREEMENT = {"mich": ("1", "Sing"), "mir": ("1", "Sing"), "dich": ("2", "Sing"), "dir": ("2", "Sing"), "uns": ("1", "Plur"), "euch": ("2", "Plur")}
PRONOUN_CASES = {"mich": "Akk", "dich": "Akk", "mir": "Dat", "dir": "Dat"}
LIGHT_VERBS = ["sein", "haben", "werden", "bleiben", "lassen"]
STOP_ADJECTIVES = (
    "bissch bisschen ander viel wenig einig mehrer solch letzt nächst ganz erst zweit dritt eigen gleich einzeln weiter verschieden bestimmt gesamt jeweilig vergangen "
    "kommend früher heutig weitere sogenannt einzig meist zahlreich übrig folgend letzter erster nächster zweiter dritter vorig voriger vergangener kommender heutiger "
    "jeweiliger sogenannter einziger übriger gesamter ganzer eigener gleicher weiterer verschiedener bestimmter mehrere einige mein dein sein ihr unser euer anderer "
    "andere anderes welcher dieser jener jeder manch mancher beide beider sämtlich übrige französische englische deutsche"
).split()
STOP_NOUNS = (
    "euro dollar cent prozent meter kilometer zentimeter kilo kilogramm gramm liter grad million milliarde tausend hundert stück jahr monat woche tag stunde minute "
    "sekunde uhr mal zeit prozentpunkt quadratmeter hektar tonne"
).split()
STOP_ADVERBS = (
    "wirklich ziemlich total wahnsinnig riesig voll echt natürlich eigentlich unbedingt bestimmt sicherlich ebenfalls weiterhin zusätzlich einfach bitte gerade lange "
    "endlich fast da dann dort hier jetzt nun so auch nur noch schon sehr mehr immer wieder nicht ja nein doch wo wann wie warum weshalb wieso woher wohin darum daher "
    "deshalb deswegen dabei dadurch dafür dagegen damit danach daran darauf daraus darin davon davor dazu hierbei hierfür worauf worum womit wovon wobei wodurch etwa "
    "eben halt denn mal man her hin vorbei heraus herein hinaus nie oft gern gerne erst bereits heute morgen gestern zuerst zuletzt weg zusammen vielleicht"
).split()
GRAMMAR_ADVERBS = (
    "da dann so auch nur noch schon mehr nicht ja nein doch denn mal man halt etwa her hin heraus herein hinaus wo wann wie warum weshalb wieso woher wohin darum daher "
    "deshalb deswegen dabei dadurch dafür dagegen damit danach daran darauf daraus darin davon davor dazu hierbei hierfür worauf worum womit wovon wobei wodurch"
).split()
#: Parts of speech of single words.
WORDS = ["NOUN", "VERB", "ADJ", "ADV"]
REPAIRS = {"eren": "ern", "elen": "eln"}

_NO_TOKENS = "array<struct<i:int,start:int,end:int,text:string>>"


def _mapped(x: Column, values: dict[str, str], other: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(v) for kv in values.items() for v in kv])[x], other)


def _shown(x: Column) -> Column:
    return F.struct(x["i"].cast("int").alias("i"), x["idx"].cast("int").alias("start"), (x["idx"] + F.length(x["text"])).cast("int").alias("end"), x["text"].alias("text"))


def _found(kind: str, lead: list[Column], tail: list[Column], verb: Column | None, others: list[Column], form: Column | None = None, case: Column | None = None, fused: Column | None = None, **evidence: Column) -> Column:
    """A candidate: the words of its key before and after the verb's, the verb's place, other tokens; ``form`` defaults to the verb's."""
    none = F.lit(None).cast("string")
    lone = F.lit(None).cast("struct<i:int,start:int,end:int,text:string>")

    def held(v: Column | None, particle: Column | None) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), F.array(*lead).cast("array<string>").alias("lead"), F.array(*tail).cast("array<string>").alias("tail"),
            F.lit(verb is not None).alias("verbal"), (v["lem"] if v is not None else none).alias("lemma"), (v["pos"] == "AUX" if v is not None else F.lit(False)).alias("plain"),
            F.coalesce(particle["low"], F.lit("")).alias("particle") if v is not None else F.lit("").alias("particle"), (told(particle["needs"]) if v is not None else F.lit(False)).alias("needs"),
            (F.when(particle.isNotNull(), _shown(particle)) if v is not None else lone).alias("particle_token"),
            F.array(*[_shown(o) for o in others], *([_shown(v)] if v is not None else [])).cast(_NO_TOKENS).alias("tokens"),
            (form if form is not None else form_key(v)).alias("form_key"), (case if case is not None else none).alias("case"), (fused if fused is not None else F.lit(False)).alias("fusable"),
            F.create_map(*[c for k, e in evidence.items() for c in (F.lit(k), e.cast("string"))]).alias("evidence") if evidence else F.create_map().cast("map<string,string>").alias("evidence"),
        )

    if verb is None:
        return held(None, None)
    return let(F.struct(F.get("t", verb).alias("v"), particle_at(verb).alias("p")), lambda s: held(s["v"], s["p"]))


def _base(prep: Column) -> Column:
    return _mapped(prep["low"], CONTRACTED, prep["low"])


def _case_of(prep: Column) -> Column:
    """The case that a preposition governs: its own, or that of its noun kernels if they agree."""
    of = lambda x: F.create_map(*[F.lit(v) for kv in CASES.items() for v in kv])[x["morph"]["Case"]]
    below = F.array_distinct(F.filter(F.transform(children(prep["i"], lambda c: c["dep"] == "nk"), of), lambda c: c.isNotNull()))
    return F.coalesce(of(prep), F.when(F.size(below) == 1, F.get(below, F.lit(0))))


def _frames(prep: Column) -> Column:
    """Whether what is under a preposition is a time, a measure or a name."""
    one = lambda c: (c["dep"] == "nk") & (c["text"].rlike(r"\p{Nd}") | c["pos"].isin("NUM", "PROPN") | c["low"].isin(NUMBER_WORDS + TEMPORAL_NOUNS) | c["lem"].isin(TEMPORAL_NOUNS))
    return F.exists(children(prep["i"]), lambda c: told(one(c)))


def _governed(tokens: Column) -> Column:
    """``(x, v)``: tokens under a lexical verb, and its place."""
    return F.filter(F.transform(tokens, lambda x: F.struct(x.alias("x"), verb_of(x).alias("v"))), lambda s: s["v"] >= 0)


def _prepositions() -> Column:
    """Prepositions with a noun phrase that are a verb's, as tokens with the verb's place."""
    fits = lambda x: (x["pos"] == "ADP") & x["dep"].isin("op", "mo") & is_word(x["text"]) & ~_base(x).isin(NO_COMPLEMENT) & F.exists(children(x["i"]), lambda c: told(c["dep"] == "nk")) & ~_frames(x)
    return _governed(F.filter("t", lambda x: told(fits(x))))


def _prep_case(x: Column) -> Column:
    return F.when(_base(x) != "als", _case_of(x))


def verb_prep() -> Column:
    """A verb and a preposition of its own, reflexive verbs left out (``reflexive_verb`` has them)."""
    one = lambda s: _found("verb_prep", [], [_base(s["x"])], s["v"], [s["x"]], case=_prep_case(s["x"]), dep=s["x"]["dep"], verb_i=s["v"], prep_i=s["x"]["i"], reflexive=F.lit("false"))
    return F.transform(F.filter(_prepositions(), lambda s: ~reflexive_at(s["v"])), one)


def reflexive_verb() -> Column:
    """``sich`` and a verb, for each reflexive pronoun that agrees with its subject, and the same with each preposition of the verb."""
    person, number = ({k: v[i] for k, v in AGREEMENT.items()} for i in (0, 1))
    none = F.lit(None).cast("string")

    def agrees(s: Column) -> Column:
        x = s["x"]
        of = lambda m: (m["Person"] == _mapped(x["low"], person, none)) & (m["Number"] == _mapped(x["low"], number, none))
        return (x["low"] == "sich") | told(let(F.coalesce(subject_at(s["v"]), subject_at(finite_at(s["v"]))), of))

    fits = lambda x: (x["pos"] == "PRON") & x["low"].isin(REFLEXIVES) & (x["dep"].isin("oa", "da") | ((x["dep"] == "mo") & (x["low"] == "sich")))
    reciprocal = F.exists("t", lambda x: x["low"].isin("gegenseitig", "einander"))
    told_of = lambda x: {"pron": x["low"], "pron_case": _mapped(x["low"], PRONOUN_CASES, F.lit(""))}
    alone = lambda s: _found("reflexive_verb", [F.lit("sich")], [], s["v"], [s["x"]], **told_of(s["x"]), with_prep=none)
    both = lambda s, q: _found("reflexive_verb", [F.lit("sich")], [_base(q)], s["v"], [s["x"], q], case=_prep_case(q), **told_of(s["x"]), with_prep=_base(q))

    def found(prons: Column) -> Column:
        pairs = lambda preps: F.flatten(F.transform(prons, lambda s: F.transform(F.filter(preps, lambda q: q["v"] == s["v"]), lambda q: both(s, q["x"]))))
        return F.when(F.size(prons) > 0, F.concat(F.transform(prons, alone), let(_prepositions(), pairs)))

    held = F.filter(_governed(F.filter("t", lambda x: told(fits(x)))), agrees)
    return F.coalesce(F.when(~reciprocal, let(held, found)), F.array())


def _fusable(x: Column) -> Column:
    """Whether a verb's place in the sentence lets it be written with its prefix: an infinitive or participle, or under another verb, and no adjective."""
    return (told(x["morph"]["VerbForm"].isin("Inf", "Part")) | x["dep"].isin("oc", "re", "cj")) & ~x["dep"].isin("pd", "mo")


def separable_verb() -> Column:
    """Separable verbs, written apart ("steht ... auf") or in one word ("aufstehen")."""
    verbs = F.filter("t", lambda x: (x["pos"] == "VERB") & (told(_fusable(x)) | particle_at(x["i"]).isNotNull()))
    return F.transform(verbs, lambda x: _found("separable_verb", [], [], x["i"], [], fused=told(_fusable(x))))


def noun_verb() -> Column:
    """A noun object and its verb ("Entscheidung treffen", "Hunger haben"), and nouns in fixed phrases with a preposition ("zur Verfügung stehen")."""
    head = lambda x: F.get("t", x["head"])
    owns = lambda x: told((head(x)["pos"] == "AUX") & (head(x)["lem"] == "haben") & ~F.exists(children(head(x)["i"]), lambda c: told(c["dep"] == "oc")))
    verb = lambda x: F.when(owns(x), x["head"]).otherwise(let(verb_of(x), lambda v: F.when(~F.get("t", v)["lem"].isin(LIGHT_VERBS), v)))
    noun = F.filter("t", lambda x: told((x["pos"] == "NOUN") & x["dep"].isin("oa", "da") & is_word(x["text"]) & ~x["lem"].isin(STOP_NOUNS)))
    placed = F.filter(F.transform(noun, lambda x: F.struct(x.alias("x"), verb(x).cast("int").alias("v"))), lambda s: told(s["v"] >= 0))
    there_is = lambda s: (F.get("t", s["v"])["lem"] == "geben") & F.exists(children(s["v"]), lambda c: told((c["low"] == "es") & c["dep"].isin("sb", "ep")))
    objects = F.transform(F.filter(placed, lambda s: ~there_is(s)), lambda s: _found("noun_verb", [s["x"]["lemma"]], [], s["v"], [s["x"]], dep=s["x"]["dep"], noun=s["x"]["lem"]))
    nouns = lambda x: children(x["i"], lambda c: c["dep"] == "nk", lambda c: c["pos"] == "NOUN")
    fixed = _governed(F.filter("t", lambda x: told((x["pos"] == "ADP") & (x["dep"] == "cvc") & (F.size(nouns(x)) == 1))))
    phrase = lambda s: let(F.get(nouns(s["x"]), F.lit(0)), lambda n: _found("noun_verb", [s["x"]["low"], n["lemma"]], [], s["v"], [s["x"], n], dep=F.lit("cvc"), noun=n["lem"]))
    return F.concat(objects, F.transform(fixed, phrase))


def _plain_degree(x: Column) -> Column:
    return F.coalesce(x["morph"]["Degree"], F.lit("Pos")) == "Pos"


def _named(x: Column) -> Column:
    """Whether a capital inside the sentence makes a word part of a name."""
    return x["text"].rlike(r"^\p{Lu}") & (x["i"] > 0)


def _case_number(x: Column) -> Column:
    return F.concat_ws("|", F.coalesce(x["morph"]["Case"], F.lit("?")), F.coalesce(x["morph"]["Number"], F.lit("?")))


def adj_noun() -> Column:
    """An attributive adjective and its noun."""
    noun = lambda x: F.get("t", x["head"])
    fits = lambda x: (
        (x["pos"] == "ADJ") & (x["dep"] == "nk") & is_word(x["text"]) & _plain_degree(x) & ~x["lem"].isin(STOP_ADJECTIVES) & (F.length(x["lem"]) >= 3) & ~_named(x)
        & (noun(x)["pos"] == "NOUN") & is_word(noun(x)["text"]) & ~noun(x)["lem"].isin(STOP_NOUNS)
    )
    one = lambda x: _found("adj_noun", [x["lem"], noun(x)["lemma"]], [], None, [x, noun(x)], form=_case_number(x), adj=x["lem"], noun=noun(x)["lem"])
    return F.transform(F.filter("t", lambda x: told(fits(x))), one)


def adj_verb() -> Column:
    """A predicative or adverbial adjective and its verb ("ernst nehmen")."""
    fits = lambda x: (
        x["pos"].isin("ADJ", "ADV") & x["dep"].isin("pd", "oc", "mo") & is_word(x["text"]) & _plain_degree(x) & ~x["lem"].isin(STOP_ADJECTIVES + STOP_ADVERBS)
        & (F.length(x["lem"]) >= 3) & ~_named(x)
    )
    held = F.filter(_governed(F.filter("t", lambda x: told(fits(x)))), lambda s: told(~F.get("t", s["v"])["lem"].isin(LIGHT_VERBS)))
    return F.transform(held, lambda s: _found("adj_verb", [s["x"]["lem"]], [], s["v"], [s["x"]], dep=s["x"]["dep"], adj=s["x"]["lem"]))


def _reported() -> Column:
    return F.exists("t", lambda x: x["pos"].isin("VERB", "AUX") & reported(x))


def word_tokens(parsed: DataFrame) -> DataFrame:
    """``(source, line_id, text, x, reported, particles)``: one row for each token ``x`` of parsed sentences, with what their single words need to know of the sentence."""
    held = with_tokens(parsed).select("source", "line_id", "text", "t", _reported().alias("reported"), particles().alias("particles"))
    return held.select("source", "line_id", "text", "reported", "particles", F.explode_outer("t").alias("x")).where("x is not null")


def word_candidates(tokens: DataFrame) -> DataFrame:
    """Nouns, verbs, adjectives and adverbs among ``word_tokens``, one flat row each: ``(word, pos, particle, needs, fusable, i, start, surface, form_key, gender, reported)`` and the columns of ``tokens`` that say where they are.

    Whether a verb is kept, and as which word, hangs on ``word``, ``particle``, ``needs`` and ``fusable`` alone. Rows are kept narrow, since they are sorted or stored: what follows from other columns is added at the end.
    """
    x = F.col("x")
    pos, verb = x["pos"], x["pos"] == "VERB"
    p = F.col("particles")[x["i"].cast("int")]
    fits = F.when(pos == "NOUN", ~x["lem"].isin(STOP_NOUNS) & (F.length(x["lem"]) >= 3)).when(verb, True).when(
        pos.isin("ADJ", "ADV"), _plain_degree(x) & (x["dep"] != "svp") & (F.length(x["lem"]) >= 3) & ~x["lem"].isin(STOP_ADJECTIVES + GRAMMAR_ADVERBS)
    )
    return tokens.where(pos.isin(WORDS) & told(fits) & is_word(x["text"])).select(
        *[c for c in tokens.columns if c not in {"x", "particles", "reported"}], x["lem"].alias("word"), pos.alias("pos"),
        F.when(verb, F.coalesce(p["low"], F.lit(""))).otherwise("").alias("particle"), (verb & told(p["needs"])).alias("needs"), (verb & told(_fusable(x))).alias("fusable"), x["i"].cast("int").alias("i"), x["idx"].cast("int").alias("start"),
        x["text"].alias("surface"), F.when(verb, form_key(x)).when(pos == "ADV", "adv").otherwise(_case_number(x)).alias("form_key"), F.when(pos == "NOUN", F.coalesce(x["morph"]["Gender"], F.lit(""))).alias("gender"), "reported",
    )


def settled_words(candidates: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """``word_candidates``, which should be stored, with ``kind``, ``unit_key`` and ``end``; adjectives and adverbs are one kind, since taggers mix them up. Verbs that are no word, separable verbs and particles are left out."""
    verb = F.col("pos") == "VERB"
    facts = _facts(candidates.where(verb).select(F.col("word").alias("lemma"), "particle"), dictionary)
    c = candidates.withColumn("lemma", F.when(verb, F.col("word"))).join(facts, ["lemma", "particle"], "left")
    apart = (F.col("particle") != "") & (~F.col("needs") | F.col("fuses"))
    base = F.when(~told(apart) & ~(F.col("fusable") & told(F.col("fused"))), F.nullif(F.col("base"), F.lit("")))
    c = c.withColumn("unit_key", F.when(verb, base).otherwise(F.col("word"))).where("unit_key is not null")
    kept = [k for k in candidates.columns if k not in {"word", "pos", "particle", "needs", "fusable"}]
    kind = F.when(verb, "verb").when(F.col("pos") == "NOUN", "noun").otherwise("adjective")
    return c.select(kind.alias("kind"), "unit_key", *kept, (F.col("start") + F.length("surface")).alias("end"), F.when(kind == "adjective", F.col("pos")).alias("pos"))


def single_words(parsed: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """Single words of parsed sentences as occurrences."""
    held = settled_words(stored(word_candidates(word_tokens(parsed))), dictionary)
    evidence = F.create_map(*[c for k in ("surface", "gender", "pos") for c in (F.lit(k), F.col(k))], F.lit("k1_sentence"), F.when(F.col("reported"), "true"))
    return held.select(
        "kind", "unit_key", F.array("unit_key").alias("parts"), F.array(F.struct("i", "start", "end", F.col("surface").alias("text"))).alias("tokens"), "source", "line_id", "text", "form_key", F.lit(None).cast("string").alias("case"),
        F.map_filter(evidence, lambda _, v: v.isNotNull()).alias("evidence"),
    )


def _exploded(tokens: DataFrame, candidates: Column) -> DataFrame:
    return tokens.select("source", "line_id", "text", _reported().alias("reported"), F.inline(candidates))


def verb_facts(pairs: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """``(lemma, particle, base, fuses, fused)`` of distinct pairs: the repaired lemma ("" if it is no infinitive), whether the particle makes a word with it, whether it begins with its prefix.

    ``dictionary(word)`` has words in normal form; without one every word is taken for known. Each pair asks for some 40 words at most, which are joined to the dictionary once.
    """
    pairs = pairs.select("lemma", "particle").distinct()
    longest = sorted(PREFIXES, key=lambda p: (-len(p), p))
    rest = {p: F.substring(F.col("lemma"), len(p) + 1, 1_000) for p in longest}
    repaired = {a: F.concat(F.expr(f"left(lemma, greatest(length(lemma) - {len(a)}, 0))"), F.lit(b)) for a, b in REPAIRS.items()}
    if dictionary is None:
        known = lambda _: F.lit(True)
        held = pairs
    else:
        asked = [F.col("lemma"), F.concat("particle", "lemma"), *[F.when(F.col("lemma").endswith(a), c) for a, c in repaired.items()]]
        for p in longest:
            asked += [F.when(F.col("lemma").startswith(p), rest[p]), F.when(rest[p].startswith("zu") & F.col("lemma").startswith(p), F.concat(F.lit(p), F.substring(rest[p], 3, 1_000)))]
        words = pairs.select("lemma", "particle", F.explode(F.array_distinct(F.filter(F.array(*[normalise(a) for a in asked]), lambda w: w.isNotNull()))).alias("word"))
        held = words.join(dictionary.select("word"), "word", "left_semi").groupBy("lemma", "particle").agg(F.collect_set("word").alias("words"))
        held = pairs.join(held, ["lemma", "particle"], "left")
        known = lambda w: told(F.array_contains("words", normalise(w)))
    lemma = F.col("lemma")
    base = F.when(~lemma.endswith("n") | (F.length(lemma) < 4), F.lit("")).when(known(lemma), lemma)
    for a, c in repaired.items():
        base = base.when(lemma.endswith(a) & known(c), c)
    fused = F.when(F.lit(False), False)
    for p in INSEPARABLE:
        fused = fused.when(lemma.startswith(p), False)
    for p in longest:
        twice = rest[p].startswith("zu") & known(F.concat(F.lit(p), F.substring(rest[p], 3, 1_000))) if dictionary is not None else F.lit(False)
        fused = fused.when(lemma.startswith(p) & (F.length(rest[p]) >= 4) & known(rest[p]), ~twice)
    return held.select("lemma", "particle", base.otherwise("").alias("base"), known(F.concat("particle", "lemma")).alias("fuses"), fused.otherwise(False).alias("fused"))


def _facts(verbs: DataFrame, dictionary: DataFrame | None) -> DataFrame:
    facts = stored(verb_facts(verbs, dictionary))
    return F.broadcast(facts) if facts.count() <= BROADCAST_VERBS else facts


def occurrences(candidates: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """Candidates of any detector but ``single_words`` with their verbs settled: occurrences. Those whose verb is no word are left out."""
    candidates = stored(candidates)
    c = candidates.join(_facts(candidates.where("verbal"), dictionary), ["lemma", "particle"], "left")
    apart = (F.col("particle") != "") & (~F.col("needs") | F.col("fuses")) & ~F.col("plain")
    c = c.withColumn("apart", told(apart))
    stem = F.when(F.col("plain"), F.col("lemma")).otherwise(F.nullif(F.col("base"), F.lit("")))
    verb = F.concat(F.when(F.col("apart"), F.col("particle")).otherwise(""), stem)
    separable = F.col("kind") == "separable_verb"
    verb = F.when(separable & ~F.col("apart"), F.when(F.col("fusable") & F.col("fused"), F.col("lemma"))).otherwise(verb)
    c = c.withColumn("key", verb).where(~F.col("verbal") | F.col("key").isNotNull())
    own = F.when(F.col("verbal"), F.array("key")).otherwise(F.array().cast("array<string>"))
    parts = F.concat("lead", own, "tail")
    tokens = F.array_sort(F.when(F.col("apart"), F.concat("tokens", F.array("particle_token"))).otherwise(F.col("tokens")))
    form = F.when(separable, F.concat_ws("|", "form_key", F.when(F.col("apart"), F.lit("discontinuous")).otherwise("fused"))).otherwise(F.col("form_key"))
    added = F.map_from_arrays(
        F.array(*[F.lit(k) for k in ("verb", "particle", "fused", "k1_sentence")]),
        F.array(F.when(F.col("kind").isin("noun_verb", "adj_verb"), F.col("key")), F.when(separable & F.col("apart"), F.col("particle")), F.when(separable & ~F.col("apart"), "true"), F.when(F.col("reported"), "true")),
    )
    evidence = F.map_filter(F.map_concat("evidence", added), lambda _, v: v.isNotNull())
    key = F.concat_ws(" ", F.transform(parts, lambda p: F.lower(p)))
    return c.select("kind", key.alias("unit_key"), parts.alias("parts"), tokens.alias("tokens"), "source", "line_id", "text", form.alias("form_key"), "case", evidence.alias("evidence"))


def first_candidates(candidates: DataFrame, cap: int, order: tuple[str, ...] = ("line_id",), by: tuple[str, ...] = ()) -> DataFrame:
    """The first ``cap`` of ``word_candidates`` of each source (and what ``by`` says) that come to the same word or to none, stored.

    Whatever the facts about verbs, the first ``cap`` occurrences of a word and source are among them, so that facts are asked for these few.
    Each task drops what is beyond ``cap`` there before it sends anything.
    """
    alike = Window.partitionBy("word", "source", "pos", "particle", "needs", "fusable", *by).orderBy(*order, "i")
    return stored(candidates.withColumn("n", F.row_number().over(alike)).where(F.col("n") <= cap).drop("n"))


def word_occurrences(words: DataFrame, lemmas: DataFrame, glossed: DataFrame | None, cap: int = 12, order: tuple[str, ...] = ("line_id",)) -> DataFrame:
    """Occurrences of single words that may become units: known lemmas in glossed sentences, the first ``cap`` of a word and source in ``order``.

    ``words`` are occurrences or rows of ``settled_words``; without ``glossed(text)`` all their sentences are taken for glossed. ``lemmas(word)`` may write ss for sharp s.
    The first ones are kept before known lemmas are looked up, which decide on all or none of them, so that few rows are sent.
    """
    place = F.col("i") if "i" in words.columns else F.col("tokens")[0]["i"]
    kept = words if glossed is None else words.join(glossed.select("text").distinct(), "text", "left_semi")
    first = Window.partitionBy("unit_key", "kind", "source").orderBy(*[F.col(c) for c in order], place)
    kept = stored(kept.withColumn("n", F.row_number().over(first)).where(F.col("n") <= cap).drop("n"))
    spelled = F.array_distinct(F.array("unit_key", F.replace("unit_key", F.lit("ß"), F.lit("ss"))))
    asked = kept.select("unit_key").distinct().select("unit_key", F.explode(spelled).alias("word"))
    known = asked.join(lemmas.select("word").distinct(), "word", "left_semi").select("unit_key").distinct()
    return kept.join(known, "unit_key", "left_semi")


def role_counts(trees: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """``(role, lemma, sentences)``: in how many sentences a lemma stands as verb, noun, adjective, adverb or preposition. A separated particle belongs to its verb."""
    pairs = lambda x, p: F.struct(
        F.when(x["pos"].isin("VERB", "AUX"), "verb").when(x["pos"] == "NOUN", "noun").when(x["pos"] == "ADJ", "adjective").when(x["pos"] == "ADV", "adverb").otherwise("preposition").alias("role"),
        F.when(x["pos"] == "ADP", x["low"]).otherwise(x["lem"]).alias("lemma"), (x["pos"] == "AUX").alias("plain"),
        F.when(x["pos"] == "VERB", F.coalesce(p["low"], F.lit(""))).otherwise("").alias("particle"), told(p["needs"]).alias("needs"),
    )
    particle = lambda x: F.when(x["pos"].isin("VERB", "AUX"), particle_at(x["i"]))
    counted = F.filter("t", lambda x: x["pos"].isin("VERB", "NOUN", "ADJ", "ADV", "ADP") | ((x["pos"] == "AUX") & (x["lem"] == "haben")))
    row = trees.select("t", F.monotonically_increasing_id().alias("row")).select("row", F.inline(F.array_distinct(F.transform(counted, lambda x: let(particle(x), lambda p: pairs(x, p))))))
    row = stored(row)
    held = row.join(_facts(row.where("role = 'verb' and not plain"), dictionary), ["lemma", "particle"], "left")
    apart = (F.col("particle") != "") & (~F.col("needs") | F.col("fuses"))
    stem = F.when(F.col("plain"), F.col("lemma")).otherwise(F.nullif(F.col("base"), F.lit("")))
    key = F.when(F.col("role") == "verb", F.concat(F.when(told(apart), F.col("particle")).otherwise(""), stem)).otherwise(F.col("lemma"))
    return held.select("row", "role", key.alias("lemma")).where("lemma is not null").distinct().groupBy("role", "lemma").agg(F.count("*").alias("sentences"))


#: ``single_words`` needs no walk through a tree and goes by rows of tokens; the others are arrays over a sentence's tokens.
DETECTORS = {f.__name__: f for f in (verb_prep, reflexive_verb, separable_verb, noun_verb, adj_noun, adj_verb, single_words)}


def _some(head: Column, fits: Callable[[Column, Column], Column]) -> Column:
    """Whether any place fits, by its head and itself."""
    return F.size(F.filter(head, lambda h, i: told(fits(h, i)))) > 0


def _heads(head: Column, of: Callable[[Column], Column]) -> Column:
    return F.filter(head, lambda h, i: told(of(i) & (h != i)))


def _under_verb(pos: Column, dep: Column, head: Column, fits: Callable[[Column, Column], Column]) -> Column:
    """Whether a place that fits may have a lexical verb: its head is one or has a clausal object."""
    clauses = _heads(head, lambda i: (F.get(dep, i) == "oc") & (F.get(pos, i) == "VERB"))
    return let(clauses, lambda over: _some(head, lambda h, i: fits(h, i) & ((F.get(pos, h) == "VERB") | F.array_contains(over, h))))


def _may_verb_prep(pos: Column, dep: Column, head: Column) -> Column:
    nouns = _heads(head, lambda i: F.get(dep, i) == "nk")
    return let(nouns, lambda led: _under_verb(pos, dep, head, lambda _, i: (F.get(pos, i) == "ADP") & F.get(dep, i).isin("op", "mo") & F.array_contains(led, i)))


def _may_noun_verb(pos: Column, dep: Column, head: Column) -> Column:
    noun = lambda i: (F.get(pos, i) == "NOUN") & F.get(dep, i).isin("oa", "da")
    owned = _some(head, lambda h, i: noun(i) & (F.get(pos, h) == "AUX"))
    return owned | _under_verb(pos, dep, head, lambda _, i: noun(i) | ((F.get(pos, i) == "ADP") & (F.get(dep, i) == "cvc")))


def _may_adj_noun(pos: Column, dep: Column, head: Column) -> Column:
    return _some(head, lambda h, i: (F.get(pos, i) == "ADJ") & (F.get(dep, i) == "nk") & (F.get(pos, h) == "NOUN"))


def _may_reflexive_verb(pos: Column, dep: Column, head: Column) -> Column:
    return _under_verb(pos, dep, head, lambda _, i: (F.get(pos, i) == "PRON") & F.get(dep, i).isin("oa", "da", "mo"))


def _may_adj_verb(pos: Column, dep: Column, head: Column) -> Column:
    return _under_verb(pos, dep, head, lambda _, i: F.get(pos, i).isin("ADJ", "ADV") & F.get(dep, i).isin("pd", "oc", "mo"))


#: What parts of speech, labels and heads (arrays over a sentence's places) rule out: false only where a detector finds nothing, so that such sentences need no tokens. Other detectors look at most sentences.
SIEVES = {"verb_prep": _may_verb_prep, "noun_verb": _may_noun_verb, "adj_noun": _may_adj_noun, "reflexive_verb": _may_reflexive_verb, "adj_verb": _may_adj_verb}


def detected(parsed: DataFrame, dictionary: DataFrame | None = None, kinds: tuple[str, ...] = tuple(DETECTORS)) -> DataFrame:
    """Occurrences of all ``kinds`` in parsed sentences."""
    found = [single_words(parsed, dictionary)] if "single_words" in kinds else []
    candidates = [DETECTORS[kind]() for kind in kinds if kind != "single_words"]
    if candidates:
        found.append(occurrences(_exploded(with_tokens(parsed), candidates[0] if len(candidates) == 1 else F.concat(*candidates)), dictionary))
    return functools.reduce(DataFrame.unionByName, found)
