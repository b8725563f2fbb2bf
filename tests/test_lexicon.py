"""Lemma candidates, levels, compounds and ceilings on German words."""

import pytest

from lexspark.operators import lexicon as L

IRREGULAR = [("sprach", "sprechen"), ("gab", "geben"), ("buch", "buch")]
VOCABULARY = {"machen": 1, "fahren": 1, "strom": 3, "anrufen": 2, "rufen": 4, "projekt": 2, "leiter": 3, "sprechen": 1, "spielen": 1, "verkehr": 2, "mittel": 1, "haus": 1, "groß": 1, "schwer": 4, "analyse": 4}


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def facts_of(spark, words):
    one = lambda xs: frame(spark, [(x,) for x in xs], "word string")
    vocabulary = frame(spark, list(VOCABULARY.items()), "word string, level int")
    irregular = frame(spark, IRREGULAR, "form string, lemma string")
    ranks = frame(spark, [("selten", 30_000), ("oft", 10), ("selten", 40_000)], "word string, rank long")
    return L.word_facts(one(words), vocabulary, irregular, one(["der", "ich", "morgen"]), one(["berlin"]), ranks)


def slow_candidates(key, irregular):
    """The rules one by one."""
    if len(key) < 2:
        return [key]
    roots = {key}
    if key.startswith("ge") and len(key) > 5:
        core = key[2:]
        roots.add(core)
        if core.endswith("et") and len(core) >= 5:
            roots.add(core[:-2])
        elif core.endswith("t") and len(core) >= 4:
            roots.add(core[:-1])
    stems = set(roots)
    for r in roots:
        stems |= {r[: -len(e)] for e in L.ENDINGS if r.endswith(e) and len(r) - len(e) >= 3}
        stems |= {r[:-1]} if r.endswith("d") and len(r) >= 4 else set()
    stems |= {s[:-1] for s in stems if s.endswith("d") and len(s) >= 4}
    out = []
    for s in [key, *sorted(stems, key=lambda s: (-len(s), s))]:
        for x in dict.fromkeys([s, s.translate(str.maketrans("äöü", "aou"))]):
            out += [x, *([x + "en"] if not x.endswith("en") and len(x) >= 3 else []), *([irregular[x]] if x in irregular else [])]
    return list(dict.fromkeys(out))


def test_candidates_come_in_their_order(spark):
    words = ["machte", "gemacht", "gefahren", "strömen", "spielende", "sprach", "a", "ge", "geht", "gegabt", "grosses", "bücher", "lernend", "getanzet", "end", "geadet"]
    got = {}
    for r in L.lemma_candidates(frame(spark, [(w,) for w in [*words, *words]], "word string"), frame(spark, IRREGULAR, "form string, lemma string")).orderBy("place").collect():
        got.setdefault(r.word, []).append(r.candidate)
    assert got == {w: slow_candidates(w, dict(IRREGULAR)) for w in words}


def test_levels_of_words(spark):
    words = ["machte", "gemacht", "strömen", "sprach", "spielende", "projektleiter", "verkehrsmittel", "der", "projekthaus", "xyzzy", "berlin"]
    got = {r.word: r.level for r in L.word_level(facts_of(spark, words)).collect()}
    assert got == {"machte": 1, "gemacht": 1, "strömen": 3, "sprach": 1, "spielende": 1, "projektleiter": 3, "verkehrsmittel": 2, "der": 1, "projekthaus": 2, "xyzzy": None, "berlin": None}


@pytest.fixture(scope="module")
def checked(spark):
    lines = frame(spark, [
        ("apart", "Ich rufe dich morgen an."), ("near", "Der Strom, Strom und Strom macht."), ("two", "Der Strom und Strom macht."), ("hard", "Analyse in Berlin, oft selten xyzzy"), ("none", ""), ("null", None), ("short", "an ab"),
    ], "line_id string, text string")
    words = L.sentence_words(lines)
    facts = facts_of(spark, [r.word for r in words.select("word").distinct().collect()])
    return {r.line_id: (r.violations, r.over_budget, r.unknown) for r in L.ceiling_check(lines, facts, 2).collect()}, words, facts


def test_a_separated_prefix_makes_the_easier_verb(checked):
    told, words, facts = checked
    assert told["apart"][0] == ["dich"] and "rufe" not in told["apart"][1]
    within = {(r.line_id, r.token): r.within for r in L.within_ceiling(words, facts, 2).collect()}
    assert within["apart", "rufe"] and within["hard", "xyzzy"] and not within["hard", "Analyse"] and within["hard", "Berlin"]


def test_words_one_level_above_have_a_budget(checked):
    told = checked[0]
    assert told["near"] == (["und", "Strom", "Strom", "Strom"], ["Strom"] * 3, ["und"])
    assert told["two"] == (["und"], ["Strom"] * 2, ["und"])
    assert told["hard"] == (["Analyse", "selten", "xyzzy"], [], ["oft", "selten", "xyzzy"])
    assert told["none"] == told["null"] == told["short"] == ([], [], [])
