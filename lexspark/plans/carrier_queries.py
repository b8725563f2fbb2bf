"""Validation of carriers over a parsed table that Spark derives from documents.

No parser is at hand, so each run of eight words of a document picks one of the sentences below, parsed by hand, by a hash of its
place; ``*`` is the document's own word, as a noun, and one token in eight has its number, its head or its tag changed. All reasons are met that way.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.operators import carriers, trees
from lexspark.plans.corpus_queries import shape_sql
from lexspark.plans.tables import read

#: Words of a run.
LENGTH = 8
_PRES = "Mood=Ind|Tense=Pres|Person={}|Number={}"
_S1, _S3, _P1, _P3 = _PRES.format(1, "Sing"), _PRES.format(3, "Sing"), _PRES.format(1, "Plur"), _PRES.format(3, "Plur")
_I, _HE, _WE = "PronType=Prs|Person=1|Number=Sing", "PronType=Prs|Person=3|Number=Sing", "PronType=Prs|Person=1|Number=Plur"
_END = ". -- PUNCT $. punct {}"
#: Sentences by the reason against them; a token is text, lemma, part of speech, tag, label, head and morphology.
SENTENCES = {
    "fine": f"Der der DET ART nk 2 Definite=Def/alte alt ADJ ADJA nk 2/* * NOUN NN sb 3 Gender=Masc|Number=Sing/wartet warten VERB VVFIN ROOT 3 {_S3}/heute heute ADV ADV mo 3/{_END.format(3)}",
    "fine order": f"Komm kommen VERB VVIMP ROOT 0/und und CCONJ KON cd 0/lies lesen VERB VVIMP cj 1/das der DET ART nk 4 Definite=Def/* * NOUN NN oa 2/{_END.format(0)}",
    "fine row": f"Ich ich PRON PPER sb 1 {_I}/warte warten VERB VVFIN ROOT 1 {_S1}/und und CCONJ KON cd 1/lese lesen VERB VVFIN cj 2 {_S1}/viel viel ADV ADV mo 3/{_END.format(1)}",
    "fine weil": f"Er er PRON PPER sb 1 {_HE}/wartet warten VERB VVFIN ROOT 1 {_S3}/, -- PUNCT $, punct 1/weil weil SCONJ KOUS cp 5/* * PROPN NE sb 5 Number=Sing/kommt kommen VERB VVFIN mo 1 {_S3}/{_END.format(1)}",
    "swiss_spelling": f"Er er PRON PPER sb 1 {_HE}/steht stehen VERB VVFIN ROOT 1 {_S3}/draussen draussen ADV ADV mo 1/{_END.format(1)}",
    "not_capitalized": f"er er PRON PPER sb 1 {_HE}/sieht sehen VERB VVFIN ROOT 1 {_S3}/* * NOUN NN oa 1/{_END.format(1)}",
    "no_terminal_punctuation": f"Er er PRON PPER sb 1 {_HE}/sieht sehen VERB VVFIN ROOT 1 {_S3}/* * NOUN NN oa 1",
    "opens_mid_quotation": f'Das der PRON PDS oa 1/sagte" sagen VERB VVFIN ROOT 1 {_S3}/* * PROPN NE sb 1 Number=Sing/{_END.format(1)}',
    "multiple_sentences": f"Er er PRON PPER sb 1 {_HE}/geht gehen VERB VVFIN ROOT 1 {_S3}/{_END.format(1)}/Sie sie PRON PPER sb 4 {_HE}/kommt kommen VERB VVFIN ROOT 4 {_S3}/{_END.format(4)}",
    "fragment_too_short": f"Der der DET ART nk 1 Definite=Def/* * NOUN NN ROOT 1/{_END.format(1)}",
    "dangling_fragment": f"Er er PRON PPER sb 1 {_HE}/sieht sehen VERB VVFIN ROOT 1 {_S3}/* * NOUN NN oa 1/und und CCONJ KON cd 2/{_END.format(1)}",
    "no_finite_verb": f"Heute heute ADV ADV mo 2/sehr sehr ADV ADV mo 2/schön schön ADJ ADJD ROOT 2/{_END.format(2)}",
    "colon_joined_fragment": f"* * NOUN NN dep 3/: -- PUNCT $. punct 3/Wir wir PRON PPER sb 3 {_WE}/warten warten VERB VVFIN ROOT 3 {_P1}/heute heute ADV ADV mo 3/{_END.format(3)}",
    "no_main_clause_verb": f"Das der DET ART nk 1 Definite=Def/* * NOUN NN ROOT 1 Gender=Neut|Number=Sing/, -- PUNCT $, punct 1/das der PRON PRELS oa 5/er er PRON PPER sb 5 {_HE}/sieht sehen VERB VVFIN rc 1 {_S3}/{_END.format(1)}",
    "verb_final_fragment": f"Den der DET ART nk 1 Definite=Def/* * NOUN NN oa 2/gesehen sehen VERB VVPP oc 3/hat haben AUX VAFIN ROOT 3 {_S3}/{_END.format(3)}",
    "missing_clause_connector": f"Er er PRON PPER sb 1 {_HE}/sagt sagen VERB VVFIN ROOT 1 {_S3}/* * PROPN NE sb 3 Number=Sing/kommt kommen VERB VVFIN oc 1 {_S3}/{_END.format(1)}",
    "no_subject_found": f"Heute heute ADV ADV mo 1/wartet warten VERB VVFIN ROOT 1 {_S3}/auf auf ADP APPR op 1/* * NOUN NN nk 2/{_END.format(1)}",
    "agreement_undecidable": f"Du du PRON PPER sb 3 PronType=Prs|Person=2|Number=Sing/und und CCONJ KON cd 0/* * PROPN NE cj 1 Number=Sing/kommen kommen VERB VVFIN ROOT 3 {_P3}/heute heute ADV ADV mo 3/{_END.format(3)}",
    "subject_verb_disagreement": f"Heute heute ADV ADV mo 1/kauft kaufen VERB VVFIN ROOT 1 {_S3}/ich ich PRON PPER sb 1 {_I}/* * NOUN NN oa 1/{_END.format(1)}",
    "finite_verb_not_a_real_word": f"Wir wir PRON PPER sb 1 {_WE}/treuen treuen VERB VVFIN ROOT 1 {_P1}/uns wir PRON PRF oa 1/an an ADP PTKVZ svp 1/{_END.format(1)}",
    "content_word_not_a_real_word": f"Er er PRON PPER sb 1 {_HE}/hat haben AUX VAFIN ROOT 1 {_S3}/* * NOUN NN oa 3/heilgemacht heilmachen VERB VVPP oc 1/{_END.format(1)}",
    "adjective_declension_mismatch": f"Viele viel DET PIAT nk 2/nassen nass ADJ ADJA nk 2/* * NOUN NN sb 3 Gender=Neut|Number=Plur/lagen liegen VERB VVFIN ROOT 3 Mood=Ind|Tense=Past|Person=3|Number=Plur/dort dort ADV ADV mo 3/{_END.format(3)}",
    "dass_clause_missing_object": f"Es es PRON PPER ep 1 {_HE}/gibt geben VERB VVFIN ROOT 1 {_S3}/* * NOUN NN oa 1/, -- PUNCT $, punct 1/dass dass SCONJ KOUS cp 7/wir wir PRON PPER sb 7 {_WE}/gekauft kaufen VERB VVPP oc 7/haben haben AUX VAFIN oc 1 {_P1}/{_END.format(1)}",
    "dass_after_physical_action_verb": f"Ich ich PRON PPER sb 1 {_I}/helfe helfen VERB VVFIN ROOT 1 {_S1}/, -- PUNCT $, punct 1/dass dass SCONJ KOUS cp 5/* * PROPN NE sb 5 Number=Sing/kommt kommen VERB VVFIN oc 1 {_S3}/{_END.format(1)}",
}
MORPH = ["Number", "Person", "Tense", "Mood", "Gender", "PronType", "Definite"]
#: Words of the dictionary that verbs are looked up in.
WORDS = ["warten", "lesen", "kaufen", "kommen", "helfen", "gekauft", "gesehen", "anziehen"]


def tokens_of(sentence: str) -> list[dict]:
    """A sentence written as above, as tokens."""
    out = []
    for i, row in enumerate(sentence.split("/")):
        text, lemma, pos, tag, dep, head, *morph = row.split()
        out.append({"i": i, "text": text, "lemma": lemma, "pos": pos, "tag": tag, "dep": dep, "head": int(head), "morph": dict(kv.split("=") for kv in (morph[0].split("|") if morph else []))})
    return out


def dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in WORDS], "word string")


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(source, line_id, text, tokens)``: a sentence of ``SENTENCES`` for each run of ``LENGTH`` words of ``documents``, with its own noun and changes by hashes."""
    held = F.from_json(F.lit(json.dumps([tokens_of(x) for x in SENTENCES.values()])), "array<array<struct<i:int,text:string,lemma:string,pos:string,tag:string,dep:string,head:int,morph:map<string,string>>>>")
    words = read(spark, sf_dir, "documents").select("source", "doc_id", F.regexp_extract_all("text", F.lit(r"[a-z]+"), F.lit(0)).alias("w")).where("size(w) > 0")
    runs = words.select("source", "doc_id", F.posexplode(F.filter("w", lambda _, i: i % LENGTH == 0)).alias("k", "w"))
    runs = runs.select("source", F.concat_ws("#", "doc_id", "k").alias("line_id"), "w")
    digits = lambda h, at: F.conv(F.substring(h, at, 2), 16, 10).cast("int")
    runs = runs.withColumn("own", F.initcap("w"))

    def filled(x, i, n, h, change):
        number = x["morph"]["Number"]
        flipped = F.when(number == "Sing", "Plur").otherwise("Sing")
        morph = F.when((change == 0) & number.isNotNull(), F.map_from_entries(F.transform(F.map_entries(x["morph"]), lambda e: F.struct(e["key"], F.when(e["key"] == "Number", flipped).otherwise(e["value"])))))
        return F.struct(
            i.cast("int").alias("i"), F.when(x["text"] == "*", F.col("own")).otherwise(x["text"]).alias("text"), F.when(x["lemma"] == "*", F.col("own")).otherwise(x["lemma"]).alias("lemma"), x["pos"].alias("pos"),
            F.when((change == 1) & (x["tag"] == "VVFIN"), "VVPP").otherwise(x["tag"]).alias("tag"), x["dep"].alias("dep"),
            F.when(change.isin(2, 3), digits(h, 3) % n).otherwise(x["head"]).cast("int").alias("head"), F.coalesce(morph, x["morph"]).alias("morph"),
        )

    def token(x, i, n):
        return trees.let(F.md5(F.concat_ws(":", "line_id", i.cast("string"))), lambda h: trees.let(digits(h, 1) % 32, lambda change: filled(x, i, n, h, change)))

    sentence = F.get(held, digits(F.md5("line_id"), 1) % len(SENTENCES))
    runs = runs.withColumn("tokens", trees.let(sentence, lambda s: trees.let(F.size(s), lambda n: F.transform(s, lambda x, i: token(x, i, n)))))
    return runs.select("source", "line_id", F.array_join(F.transform("tokens", lambda x: x["text"]), " ").alias("text"), "tokens")


def carrier_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence with the first reason against it."""
    held = carriers.validated(tagged(spark, sf_dir), dictionary(spark))
    return held.select("source", "line_id", "text", F.coalesce("reason", F.lit("fine")).alias("reason"))


def carrier_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carriers.reason_counts(carriers.validated(tagged(spark, sf_dir), dictionary(spark)))


QUERIES = {f.__name__: f for f in (carrier_reasons, carrier_reason_counts)}


def _quoted(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def _list(words) -> str:
    return "(" + ", ".join(map(_quoted, words)) + ")"


def _values() -> str:
    rows = [(n, *[x[c] for c in ("i", "text", "lemma", "pos", "tag", "dep", "head")], *[x["morph"].get(m) for m in MORPH]) for n, s in enumerate(SENTENCES.values()) for x in tokens_of(s)]
    return ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else _quoted(v) for v in row) + ")" for row in rows)


_RANK = "CASE reason " + " ".join(f"WHEN '{r}' THEN {n}" for n, r in enumerate(carriers.REASONS)) + " END"
_SUBJECTS = _list(carriers.SUBJECTS)
_TOPS = ",\n".join(f"top{n + 1} AS MATERIALIZED (SELECT a.line_id, a.i, b.top FROM top{n} a JOIN top{n} b ON b.line_id = a.line_id AND b.i = a.top)" for n in range(6))
_PERSON = "CASE WHEN {0}.pos = 'PRON' AND {0}.m_PronType = 'Prs' AND {0}.m_Person IN ('1', '2') THEN {0}.m_Person ELSE '3' END"
_QUANTITY = f"regexp_extract(low, '^(?:{'|'.join(carriers.QUANTIFIERS)})(em|en|es|er|e)$', 1)"
_STEMS = "|".join(carriers.EIN_STEMS)
_PAIR = "(p || n = '{0}' AND vp || vn = '{1}' OR p || n = '{1}' AND vp || vn = '{0}')"
VALIDATED = rf"""
words AS (SELECT source, doc_id, regexp_extract_all(text, '[a-z]+') AS w FROM documents),
runs AS (SELECT source, doc_id || '#' || k AS line_id, w[k * {LENGTH} + 1] AS w FROM (SELECT *, unnest(range(0, (len(w) + {LENGTH - 1}) // {LENGTH})) AS k FROM words)),
entry(s, i, text, lemma, pos, tag, dep, head, {", ".join("m_" + m for m in MORPH)}) AS (VALUES {_values()}),
hashed AS (SELECT r.source, r.line_id, upper(substr(w, 1, 1)) || substr(w, 2) AS own, e.*, md5(line_id || ':' || i) AS h, count(*) OVER (PARTITION BY line_id) AS size
  FROM runs r JOIN entry e ON e.s = CAST('0x' || substr(md5(line_id), 1, 2) AS INTEGER) % {len(SENTENCES)}),
changed AS (SELECT *, CAST('0x' || substr(h, 1, 2) AS INTEGER) % 32 AS c FROM hashed),
tk AS MATERIALIZED (SELECT source, line_id, i, CASE text WHEN '*' THEN own ELSE text END AS text, lower(CASE text WHEN '*' THEN own ELSE text END) AS low, CASE lemma WHEN '*' THEN own ELSE lemma END AS lemma, pos, dep,
  CASE WHEN c = 1 AND tag = 'VVFIN' THEN 'VVPP' ELSE tag END AS tag, CASE WHEN c IN (2, 3) THEN CAST('0x' || substr(h, 3, 2) AS INTEGER) % size ELSE head END AS head,
  CASE WHEN c = 0 AND m_Number = 'Sing' THEN 'Plur' WHEN c = 0 AND m_Number = 'Plur' THEN 'Sing' ELSE m_Number END AS m_Number, {", ".join("m_" + m for m in MORPH[1:])},
  coalesce((CASE WHEN c = 1 AND tag = 'VVFIN' THEN 'VVPP' ELSE tag END) IN {_list(carriers.FINITE_TAGS)} AND pos IN ('VERB', 'AUX'), false) AS fin FROM changed),
sent AS MATERIALIZED (SELECT source, line_id, string_agg(text, ' ' ORDER BY i) AS text, count(*) FILTER (pos <> 'PUNCT') AS n, max(i) FILTER (pos <> 'PUNCT') AS last, bool_or(fin) AS fin FROM tk GROUP BY ALL),
kid AS MATERIALIZED (SELECT * FROM tk WHERE head <> i),
subj AS MATERIALIZED (SELECT line_id, head AS i, count(*) AS n, min(i) AS s FROM kid WHERE dep IN {_SUBJECTS} GROUP BY ALL),
top0 AS MATERIALIZED (SELECT line_id, i, head AS top FROM tk),
{_TOPS},
back AS MATERIALIZED (SELECT x.line_id, x.i, x.dep, f.i AS first, f.fin AS joined FROM tk x JOIN tk h ON h.line_id = x.line_id AND h.i = x.head JOIN tk f ON f.line_id = h.line_id AND f.i = h.head),
walk AS (SELECT line_id, i, i AS stop, 0 AS d FROM tk WHERE fin
  UNION ALL SELECT w.line_id, w.i, b.first, d + 1 FROM walk w JOIN back b ON b.line_id = w.line_id AND b.i = w.stop LEFT JOIN subj s ON s.line_id = w.line_id AND s.i = w.stop WHERE d < {carriers.CONJUNCTS} AND s.n IS NULL AND b.dep = 'cj' AND b.joined AND b.first <> b.i),
leads AS (SELECT line_id, i, i AS stop, 0 AS d FROM tk WHERE fin UNION ALL SELECT w.line_id, w.i, b.first, d + 1 FROM leads w JOIN back b ON b.line_id = w.line_id AND b.i = w.stop WHERE d < {carriers.CONJUNCTS} AND b.dep = 'cj'),
orders AS (SELECT l.line_id, l.i FROM (SELECT line_id, i, arg_max(stop, d) AS stop FROM leads GROUP BY ALL) l JOIN tk t ON t.line_id = l.line_id AND t.i = l.stop JOIN sent e ON e.line_id = l.line_id
  WHERE t.dep = 'ROOT' AND t.i = 0 AND NOT ends_with(rtrim(e.text), '?') AND NOT EXISTS (FROM subj s WHERE s.line_id = t.line_id AND s.i = t.i)),
resolved AS (SELECT r.line_id, r.i, s.s FROM (SELECT line_id, i, arg_max(stop, d) AS stop FROM walk GROUP BY ALL) r JOIN subj s ON s.line_id = r.line_id AND s.i = r.stop WHERE s.n = 1),
conj AS (SELECT cd.line_id, cd.head AS s, bool_and(coalesce({_PERSON.format("cj")} = '3', true)) AS thirds FROM kid cd LEFT JOIN kid cj ON cj.line_id = cd.line_id AND cj.head = cd.i AND cj.dep = 'cj' WHERE cd.dep = 'cd' GROUP BY ALL),
pairs AS (SELECT v.line_id, v.i, v.low, v.m_Person AS vp, v.m_Number AS vn, v.m_Tense AS tense, v.m_Mood AS mood, v.lemma, r.s, c.s IS NOT NULL AS joined, coalesce(c.thirds, true) AND ({_PERSON.format("t")}) = '3' AS thirds,
  CASE WHEN c.s IS NOT NULL THEN '3' ELSE {_PERSON.format("t")} END AS p, CASE WHEN c.s IS NOT NULL THEN 'Plur' WHEN t.m_Number IS NOT NULL THEN t.m_Number WHEN t.pos = 'VERB' THEN 'Sing' END AS n
  FROM tk v LEFT JOIN resolved r ON r.line_id = v.line_id AND r.i = v.i LEFT JOIN tk t ON t.line_id = r.line_id AND t.i = r.s LEFT JOIN conj c ON c.line_id = r.line_id AND c.s = r.s WHERE v.fin),
agree AS (SELECT line_id, i, CASE WHEN s IS NULL THEN CASE WHEN (line_id, i) IN (SELECT (line_id, i) FROM orders) THEN NULL ELSE 'no_subject_found' END WHEN joined AND NOT thirds OR n IS NULL OR vp IS NULL OR vn IS NULL THEN 'agreement_undecidable'
  WHEN p = vp AND n = vn OR {_PAIR.format("1Plur", "3Plur")} OR {_PAIR.format("1Sing", "3Sing")} AND (coalesce(tense = 'Past', false) OR coalesce(mood = 'Sub', false)) OR {_PAIR.format("2Plur", "3Sing")} AND coalesce(tense = 'Pres', false) AND ends_with(low, 't')
    OR {_PAIR.format("2Sing", "3Sing")} AND coalesce(tense = 'Pres', false) AND regexp_matches(regexp_replace(regexp_replace(lemma, 'en$', ''), 'n$', ''), '(?:s|ß|z|x)$') OR p = '2' AND n = 'Sing' AND ends_with(low, 'st') THEN NULL ELSE 'subject_verb_disagreement' END AS reason FROM pairs),
quotes AS (SELECT line_id, i, text, pos, low, fin, sum(CASE WHEN q THEN 1 ELSE 0 END) OVER (PARTITION BY line_id ORDER BY i) AS marks, q FROM (SELECT *, regexp_matches(text, '^[{carriers.QUOTES.replace("'", "''")}]+$') AS q FROM tk)),
cuts AS (SELECT *, pos = 'PUNCT' AND contains(text, ':') AND NOT q AND marks % 2 = 0 AS cut FROM quotes),
parts AS (SELECT *, sum(cut::INT) OVER (PARTITION BY line_id ORDER BY i) AS part, sum(cut::INT) OVER (PARTITION BY line_id) AS n_cuts FROM cuts),
colons AS (SELECT p.line_id FROM (SELECT line_id, n_cuts, unnest(range(0, n_cuts + 1)) AS part FROM (SELECT DISTINCT line_id, n_cuts::INT AS n_cuts FROM parts WHERE n_cuts > 0)) p LEFT JOIN (SELECT * FROM parts WHERE NOT cut) t USING (line_id, part) GROUP BY p.line_id, part
  HAVING NOT coalesce(bool_or(fin), false) AND (NOT coalesce(bool_or(regexp_matches(text, '\p{{L}}')), false) OR (part = 0 AND coalesce(bool_and(pos IN {_list(carriers.HEADING_POS)}) FILTER (pos <> 'PUNCT'), false))
    OR (coalesce(arg_min(pos, i) FILTER (pos <> 'PUNCT') IN ('NOUN', 'PROPN'), false) AND coalesce(bool_or(pos = 'ADP'), false)))),
roots AS (SELECT line_id, min(i) AS root FROM tk WHERE dep = 'ROOT' GROUP BY 1 HAVING count(*) = 1),
above AS (SELECT line_id, i, i AS stop FROM tk WHERE tag IN {_list(carriers.RELATIVE_TAGS)} UNION SELECT a.line_id, a.i, t.head FROM above a JOIN tk t ON t.line_id = a.line_id AND t.i = a.stop),
clauses AS (SELECT c.line_id, c.head AS root, bool_and(EXISTS (FROM above a WHERE a.line_id = c.line_id AND a.stop = c.i AND a.i < c.i)) AS relative FROM kid c WHERE dep = 'rc' GROUP BY ALL),
headlines AS (SELECT r.line_id FROM roots r JOIN tk t ON t.line_id = r.line_id AND t.i = r.root JOIN clauses c ON c.line_id = r.line_id AND c.root = r.root JOIN tk f ON f.line_id = r.line_id AND f.i = 0
  WHERE t.pos IN ('NOUN', 'PROPN') AND t.tag IN ('NN', 'NE') AND c.relative AND f.dep = 'nk' AND f.head = r.root
    AND EXISTS (FROM kid k WHERE k.line_id = r.line_id AND k.head = r.root AND k.dep = 'nk' AND k.tag IN {_list(carriers.HEADLINE_DETERMINERS)})
    AND NOT EXISTS (FROM kid k WHERE k.line_id = r.line_id AND k.head = r.root AND k.dep <> 'rc' AND k.fin)
    AND NOT EXISTS (FROM kid k JOIN kid g ON g.line_id = k.line_id AND g.head = k.i WHERE k.line_id = r.line_id AND k.head = r.root AND k.dep = 'cd' AND g.dep = 'cj' AND g.fin)),
asked AS (SELECT line_id, i, 0 AS rule, CASE WHEN m_Number = 'Plur' THEN low ELSE regexp_replace(low, 'e$', '') || 'en' END AS word, low FROM tk WHERE tag = 'VVFIN' AND pos = 'VERB' AND m_Mood = 'Ind' AND m_Tense = 'Pres' AND (m_Number = 'Sing' AND m_Person = '1' AND ends_with(low, 'e') AND length(low) >= 3 OR m_Number = 'Plur' AND m_Person IN ('1', '3'))
  UNION ALL SELECT line_id, i, 1, low, low FROM tk WHERE tag IN {_list(carriers.LOOKED_UP_FORMS)}),
particles AS (SELECT line_id, head AS i, min(low) AS particle FROM kid WHERE dep = 'svp' GROUP BY ALL HAVING count(*) = 1),
tried AS (SELECT line_id, i, rule, word FROM asked UNION ALL SELECT line_id, i, 0, particle || word FROM asked JOIN particles USING (line_id, i) WHERE rule = 0
  UNION ALL SELECT line_id, i, 1, substr(low, length(p) + 1) FROM asked, (SELECT unnest([{", ".join(map(_quoted, [*carriers.PREFIXES, "wieder"]))}]) AS p) WHERE rule = 1 AND starts_with(low, p || 'ge')),
unreal AS (SELECT line_id, rule FROM tried GROUP BY line_id, i, rule HAVING NOT bool_or(replace(word, 'ß', 'ss') IN {_list(WORDS)})),
allowed(key, ending) AS (VALUES {", ".join(f"('{k}', '{e}')" for k, v in carriers.allowed_endings().items() for e in v)}),
det AS (SELECT line_id, head AS i, count(*) AS n, min(CASE WHEN tag = 'ART' AND m_Definite = 'Def' THEN low WHEN tag = 'PIAT' AND {_QUANTITY} IN ('e', 'en', 'er') THEN '+' || {_QUANTITY} WHEN regexp_matches(low, '^(?:{_STEMS})(?:e|en|em|er|es)?$') THEN 'ein' || regexp_extract(low, '^(?:{_STEMS})((?:e|en|em|er|es)?)$', 1) END) AS key
  FROM kid WHERE dep = 'nk' AND tag IN {_list(carriers.DETERMINERS)} GROUP BY ALL),
nouns AS (SELECT t.line_id, t.i, CASE WHEN d.n IS NULL THEN '-' WHEN d.n = 1 THEN d.key END || '|' || m_Gender || '|' || m_Number AS key FROM tk t LEFT JOIN det d USING (line_id, i) WHERE pos IN ('NOUN', 'PROPN')),
declined AS (SELECT DISTINCT n.line_id FROM nouns n JOIN (SELECT *, regexp_extract(low, '^.+?(em|en|es|er|e)$', 1) AS ending FROM kid) a ON a.line_id = n.line_id AND a.head = n.i AND a.dep = 'nk' AND a.tag = 'ADJA'
  WHERE n.key IN (SELECT key FROM allowed) AND a.ending <> '' AND NOT (a.i > 0 AND regexp_matches(a.text, '^\p{{Lu}}') AND a.ending = 'er') AND NOT EXISTS (FROM allowed w WHERE w.key = n.key AND w.ending = a.ending)),
oc AS (SELECT line_id, head AS i, min(i) AS oc FROM kid WHERE dep = 'oc' AND pos IN ('VERB', 'AUX') GROUP BY ALL HAVING count(*) = 1),
dass AS (SELECT * FROM tk WHERE tag = 'KOUS' AND dep = 'cp' AND low = 'dass'),
down AS (SELECT d.line_id, d.i, d.head AS stop, 0 AS d FROM dass d JOIN tk v ON v.line_id = d.line_id AND v.i = d.head WHERE v.fin UNION ALL SELECT w.line_id, w.i, o.oc, d + 1 FROM down w JOIN oc o ON o.line_id = w.line_id AND o.i = w.stop WHERE d < 4),
gap AS (SELECT w.line_id FROM (SELECT line_id, i, arg_max(stop, d) AS stop FROM down GROUP BY ALL) w JOIN tk v ON v.line_id = w.line_id AND v.i = w.stop WHERE v.lemma IN {_list(carriers.NEED_OBJECTS)} AND NOT EXISTS (FROM kid k WHERE k.line_id = v.line_id AND k.head = v.i AND k.dep IN ('svp', 'oa', 'oa2'))),
heads_over AS (SELECT d.line_id, v.i AS v, u.i AS u, CASE WHEN u.pos IN ('NOUN', 'PROPN') THEN u.head ELSE u.i END AS o FROM dass d JOIN tk v ON v.line_id = d.line_id AND v.i = d.head JOIN tk u ON u.line_id = v.line_id AND u.i = v.head WHERE v.pos IN ('VERB', 'AUX') AND u.i <> v.i),
acts AS (SELECT m.line_id FROM heads_over m JOIN tk o ON o.line_id = m.line_id AND o.i = m.o LEFT JOIN (SELECT line_id, head AS i, list(low ORDER BY i) AS ps FROM kid WHERE dep = 'svp' GROUP BY ALL) p ON p.line_id = o.line_id AND p.i = o.i
  WHERE o.i <> m.v AND o.pos IN ('VERB', 'AUX') AND CASE WHEN o.lemma = 'laden' THEN coalesce(ps = ['herunter'], false) ELSE o.lemma IN {_list(carriers.TAKE_NO_DASS)} AND ps IS NULL END),
found AS (SELECT line_id, {shape_sql("text")} AS reason, 0 AS i FROM sent
  UNION ALL SELECT t.line_id, 'multiple_sentences', 0 FROM tk t JOIN top6 a ON a.line_id = t.line_id AND a.i = t.i JOIN tk b ON b.line_id = t.line_id AND b.i = t.i - 1 JOIN top6 c ON c.line_id = b.line_id AND c.i = b.i WHERE a.top <> c.top AND b.tag = '$.'
  UNION ALL SELECT line_id, 'fragment_too_short', 0 FROM sent WHERE n < 3
  UNION ALL SELECT s.line_id, 'dangling_fragment', 0 FROM sent s JOIN tk t ON t.line_id = s.line_id AND t.i = s.last WHERE t.tag IN {_list(carriers.OPEN_ENDS)} AND NOT (t.tag = 'KON' AND regexp_matches(s.text, '(?i)\boder\s*\?[''"”’)]*\s*$'))
  UNION ALL SELECT line_id, 'no_finite_verb', 0 FROM sent WHERE NOT fin
  UNION ALL SELECT line_id, 'colon_joined_fragment', 0 FROM colons UNION ALL SELECT line_id, 'colon_joined_fragment', 0 FROM sent WHERE regexp_matches(text, '(?i)\(\s*({"|".join(carriers.MEDIA_MARKS)})\b[^)]*\)')
  UNION ALL SELECT line_id, 'no_main_clause_verb', 0 FROM headlines
  UNION ALL SELECT s.line_id, 'verb_final_fragment', 0 FROM sent s JOIN tk l ON l.line_id = s.line_id AND l.i = s.last JOIN tk b ON b.line_id = l.line_id AND b.i = l.i - 1
    WHERE s.n >= 3 AND l.fin AND l.dep = 'ROOT' AND b.pos <> 'PUNCT' AND b.tag IN {_list(carriers.CLOSING_FORMS)} AND NOT EXISTS (FROM tk t WHERE t.line_id = s.line_id AND t.tag IN {_list(carriers.CLAUSE_OPENERS)})
  UNION ALL SELECT v.line_id, 'missing_clause_connector', 0 FROM tk v JOIN tk h ON h.line_id = v.line_id AND h.i = v.head WHERE v.fin AND v.dep <> 'ROOT' AND h.fin AND NOT EXISTS (FROM kid k WHERE k.line_id = v.line_id AND k.head = v.i AND k.dep = 'cp')
  UNION ALL SELECT line_id, arg_min(reason, i), 0 FROM agree WHERE reason IS NOT NULL GROUP BY line_id
  UNION ALL SELECT line_id, CASE rule WHEN 0 THEN 'finite_verb_not_a_real_word' ELSE 'content_word_not_a_real_word' END, 0 FROM unreal
  UNION ALL SELECT line_id, 'adjective_declension_mismatch', 0 FROM declined UNION ALL SELECT line_id, 'dass_clause_missing_object', 0 FROM gap UNION ALL SELECT line_id, 'dass_after_physical_action_verb', 0 FROM acts),
firsts AS (SELECT line_id, arg_min(reason, {_RANK}) AS reason FROM found WHERE reason IS NOT NULL GROUP BY line_id),
validated AS (SELECT s.source, s.line_id, s.text, coalesce(f.reason, 'fine') AS reason FROM sent s LEFT JOIN firsts f USING (line_id))"""
ORACLES = {
    "carrier_reasons": f"WITH RECURSIVE {VALIDATED} SELECT source, line_id, text, reason FROM validated",
    "carrier_reason_counts": f"WITH RECURSIVE {VALIDATED} SELECT source, reason, count(*) AS n FROM validated GROUP BY ALL",
}
