"""Operators of the training-data pipeline against brute force, SQL, round trips and held-out rows."""

import hashlib
import itertools
import math
import os
import random
import re
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexspark.llm import extraction, mixing, pieces, quality, registry, sharding, simhash, substrings, tokens, topk, toxicity
from lexspark.llm.components import connected_components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, extra=""):
    rows = [(i if isinstance(t, str) or t is None else t[0], t if isinstance(t, str) or t is None else t[1], "en", f"s{i % 3}", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def plain_docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def components_of(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


# 1 SimHash


def slow_fingerprint(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words_of(text)]
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_components_equal_brute_force(spark):
    rng = random.Random(0)
    base = [t for _, t in plain_docs(spark)[:60]]
    texts = [*base, None, "", " \n\t", "one", "One two", "a" * 50_000, "x " * 30_000]
    for t in base[:12]:  # near copies
        w = t.split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts += [" ".join(w), t]
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs_of(spark, texts)).collect()}
    fps = [slow_fingerprint(t) for t in texts]
    assert [got[i][0] for i in range(len(texts))] == fps
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if (fps[a] ^ fps[b]).bit_count() <= 3]
    assert [got[i][1] for i in range(len(texts))] == components_of(len(texts), links)


@pytest.mark.parametrize("distance", [1, 3, 5])
def test_near_pairs_equal_brute_force(spark, distance):
    rng = random.Random(distance)
    points = {rng.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1}
    for p in list(points):
        for _ in range(4):
            points.add(p ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(1, distance + 2))}))
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    got = {(r.u, r.v) for r in simhash.near_pairs(spark.createDataFrame([(p,) for p in signed], "fp long"), distance).collect()}
    want = {(min(a, b), max(a, b)) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= distance}
    assert got == want


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}


def test_keep_first_keeps_one_of_each_group(spark):
    docs = docs_of(spark, ["a b c d", "a b c d", "x y z", (5, "q r s"), (5, "q r s"), (None, "a b c d"), "A B c d"])
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 0), (False, 2), (False, 5), (True, 0)]


# 2 mixing


def test_mix_comes_near_its_targets(spark):
    held = registry.QUERIES["op2_mixing"](spark, "/root/testdata/sf0.1")
    rows = held.groupBy("target", "source_size").agg(F.sum("taken").alias("t"), F.max(F.col("taken") / F.greatest("size", F.lit(1))).alias("m")).collect()
    assert all(abs(r.t - r.target) <= 0.15 * r.target and r.m <= 2 for r in rows)
    assert abs(sum(r.target for r in rows) - 1.5 * sum(r.source_size for r in rows)) < 1e-3


def test_mix_without_words_and_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, None, None, 9.0), (2, "", "a", 9.0), (3, "one two", None, 9.0), (3, "one two", None, 9.0)], "doc_id long, text string, source string, target double")
    held = {(r.doc_id, r.source): r for r in mixing.with_copies(docs).collect()}
    assert held[1, None].source_size == 4 and held[2, "a"].target == 0.0 and held[2, "a"].copies == 0
    assert held[3, None].copies in (1, 2) and mixing.mix(docs).columns == docs.columns
    assert mixing.with_copies(docs.limit(0)).count() == 0


def test_rates_equal_repeated_sharing(spark):
    rng = random.Random(2)
    sizes = {f"s{i:02d}": rng.choice([3, 10, 500, 4000]) for i in range(11)}
    weights = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(sorted(sizes))}
    target, open_, left = {}, set(sizes), 1.5 * sum(sizes.values())
    while open_:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    got = {r.source: r.target for r in mixing.source_rates(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    assert all(math.isclose(got[s], target[s]) for s in sizes)


# 3 toxicity


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_levenshtein():
    rng = random.Random(3)
    lexicon = ["idiot", "moron", "trash", "trashy", "ab", "lowei"]
    fuzzy = [len(w) >= 5 for w in lexicon]
    a = toxicity.LexiconAutomaton(lexicon, fuzzy)
    words = {"".join(rng.choice("abdhiomnrstwely") for _ in range(rng.randrange(1, 8))) for _ in range(800)}
    for w in lexicon:
        for _ in range(60):
            i = rng.randrange(len(w) + 1)
            words.add(rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("xyz") + w[i:], w[:i] + "q" + w[i + 1 :], w]))
    for w in words:
        near = [(edits(w, x), i) for i, x in enumerate(lexicon) if w == x or (fuzzy[i] and edits(w, x) <= 1)]
        assert a.match(w) == (min(near)[::-1] if near else None), w


def test_quotation_is_told_from_abuse():
    words = toxicity._Matches(toxicity.LexiconAutomaton(["idiot"], [True]))
    said, abuse, line, empty = (toxicity.features(t, words, [5.0]) for t in ('He wrote "you idiot" to me', "you idoit idiots idiot", "> you idiot\nno", ""))
    assert said[2] > 0 and said[0] == 0 and line[2] > 0 and abuse[0] > 0 and abuse[1] > 0 and abuse[2] == 0 and not any(empty)


def test_held_out_accuracy(spark):
    found = toxicity.op3_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out")
    r = found.agg(F.count_if((F.col("toxic") == 1) & (F.col("predicted") == 1)).alias("hit"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if((F.col("toxic") == 0) & (F.col("predicted") == 1)).alias("false"), F.count("*").alias("n")).first()
    assert r.hit >= 0.85 * r.toxic and r.false <= 0.01 * r.n


def test_scores_without_labels_or_texts(spark):
    docs = docs_of(spark, [None, "", "word " * 20_000, (3, "a"), (3, "a"), (None, "b")])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(0, 1), (1, None), (None, 1), (3, 0), (3, 1)], "doc_id long, toxic int")
    for labels in (none, odd):
        rows = toxicity.toxicity_scores(docs, labels).collect()
        assert len(rows) == 6 and all(0 <= r.score < 0.7 and r.held_out is not None for r in rows)
    assert toxicity.toxicity_scores(docs.limit(0), none).count() == 0


# 4 extraction

PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var t="</p>";</script></head><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav>
<div class="cookie-notice">We use cookies</div><!-- a > b --><article><h1>Title &amp; x</h1><p>Hello <b>big</b>\n world<br>next&nbsp;x<div class=ad>Buy</div><p>Number {n} <a href=y>link</a> text &lt;3
<ul><li>one<li>two</ul><form>Sign<input></form><section id="comments"><p>Nice!</p></section></article><aside>rel</aside><footer>c</footer>"""
TEXT = "Title & x\nHello big world next x\nNumber {n} link text <3\none\ntwo"


def test_article_without_its_surroundings(spark):
    rows = [(i, "http://a.example/" + str(i), PAGE.replace("{n}", str(i)), "old") for i in range(5)]
    rows += [(9, None, None, "old"), (10, "x", "", "old"), (11, "http://b.example/", "plain &eacute; <b>text", "old"), (11, "http://b.example/", "plain &eacute; <b>text", "old")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text) for r in extraction.extracted(pages).collect()]
    assert sorted(got) == sorted([(i, TEXT.replace("{n}", str(i))) for i in range(5)] + [(9, ""), (10, ""), (11, "plain é text"), (11, "plain é text")])
    assert extraction.extracted(pages.limit(0)).count() == 0


def test_template_tells_constant_slots(spark):
    page = "<body><div class=x><p>Always the same words here</p></div><div class=y><p>Story {n} with words</p></div><div class=z><a href=1>Menu one</a> <a href=2>two</a></div></body>"
    rows = [(i, f"http://a.example/{i}", page.replace("{n}", str(i))) for i in range(4)]
    got = {r.page_id: r.text for r in extraction.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Story {i} with words" for i in range(4)}


def test_classes_decide_inside_articles(spark):
    page = "<body><article><div class=popular><p>Story {n} has words</p></div><div class=zq><p>Constant box</p></div><p class=zr>Constant line</p></article></body>"
    rows = [(i, f"http://a.example/{i}", page.replace("{n}", str(i))) for i in range(4)]
    swapped = ["<div class=popular>One {n}</div><div class=zq>Box</div>", "<div class=zq>Box</div><div class=popular>One {n}</div>"]  # no class by their order: names decide
    rows += [(4 + i, f"http://b.example/{i}", f"<body><article>{swapped[i % 2].replace('{n}', str(i))}</article></body>") for i in range(2)]
    rows += [(6, "http://c.example/", page.replace("{n}", "6"))]
    got = {r.page_id: r.text for r in extraction.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    # a constant paragraph of an article is its text, a constant box in it is the template's
    assert got == {i: f"Story {i} has words\nConstant line" for i in range(4)} | {4: "Box", 5: "Box", 6: "Constant box\nConstant line"}


PARTS = """<div class="story"><h1>Title {n}</h1><p>Body of story {n}.</p><p class="step">Preheat the oven.</p><p>End {n}.</p></div>
<div class="comments"><h3>Reader comments</h3><p>user{n} says thing {n}</p></div><div class="reader-comments-area"><article class="comment"><p>Nice {n}</p></article></div>
<div class="sidebar"><p>Weather today {n} degrees</p></div><div class="ad"><p>Buy item {n}</p></div><div class="cookie-notice"><p>Notice {n} for you</p></div><div id="site-menu"><p>Menu {n}</p></div>"""


@pytest.mark.parametrize("around", ["<body>{}</body>", "<body><article>{}</article></body>", "<body><main><div class=zz>{}</div></main></body>"])
@pytest.mark.parametrize("n_pages", [1, 2, 6])
def test_comments_sidebars_and_adverts_go_whatever_a_host_has(spark, around, n_pages):
    rows = [(i, f"http://a.example/{i}", around.replace("{}", PARTS.replace("{n}", str(i))), 1, "x") for i in range(n_pages)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, _template int, _of string")
    got = extraction.extracted(pages)
    assert got.columns == [*pages.columns, "text"]
    assert {r.page_id: r.text for r in got.collect()} == {i: f"Title {i}\nBody of story {i}.\nPreheat the oven.\nEnd {i}." for i in range(n_pages)}


def test_names_count_as_a_whole():
    told = lambda name, tag="div", inside=False: extraction._is_named(tag, [name], inside)
    assert [told(x) for x in ("comments", "reader-comments", "ad-slot", "left_sidebar", "popular", "popular-posts", "legal-news", "share-price", "story", "article-header", "body")] == [2, 2, 2, 2, 1, 1, 0, 0, 0, 0, 0]
    assert told("comment", "article", True) == 2 and told("search", "body") == 0 and told("header", "div", True) == 0


def test_one_page_decides_for_itself_and_copies_say_nothing(spark):
    page = "<body><article><div class=zq{h}><p>Story {n} has words</p></div></article></body>"
    rows = [(i, f"http://a.example/{i}", page.replace("{n}", str(i)).replace("{h}", " hidden" if i % 3 == 0 else " style='color:red'")) for i in range(9)]
    copy = "<body><div class=zr><p>One story, two addresses</p></div></body>"
    rows += [(9, "http://b.example/1", copy), (10, "http://b.example/2", copy)] + [(i, f"http://b.example/{i}", f"<body><div class=zs>Other {i}</div></body>") for i in (11, 12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: "" if i % 3 == 0 else f"Story {i} has words" for i in range(9)} | {9: "One story, two addresses", 10: "One story, two addresses", 11: "Other 11", 12: "Other 12"}
    for n in (1, 5):
        assert {r.page_id: r.text for r in extraction.extracted(pages.repartition(n)).collect()} == want


def test_pages_of_the_table(spark):
    for r in extraction.op4_html_extraction(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").drop("url"), "page_id").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        blocks = [" ".join(extraction.entities.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(x for x in blocks if x) and r.n_chars == len(r.text)


# 5 token counts


def test_length_table_equals_brute_force(spark):
    texts = [t for _, t in plain_docs(spark)[:80]] + [None, "", "", "<|endoftext|>", "w " * 20_000]
    encode = tokens.encoding(tokens.VOCABULARY).encode_ordinary
    lens = sorted(len(encode(t or "")) for t in texts)
    table = tokens.length_table(tokens.length_histogram(docs_of(spark, texts))).orderBy("n_tokens").cache()
    for r in table.collect():
        n = r.n_tokens
        assert (r.n_docs, r.docs_from, r.docs_over) == (lens.count(n), sum(x >= n for x in lens), sum(x > n for x in lens))
        assert (r.tokens_from, r.total_tokens, r.truncated_tokens) == (sum(x for x in lens if x >= n), sum(lens), sum(min(x, n) for x in lens))
    assert tokens.quantile(table, 0.5).first().n_tokens == lens[math.ceil(0.5 * len(lens)) - 1]
    assert tokens.truncated_total(table, 100).first().tokens == sum(min(x, 100) for x in lens)
    assert tokens.length_table(tokens.length_histogram(docs_of(spark, texts).limit(0))).count() == 0


# 2, 6, 7, 8 against SQL


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        p = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    a, b = registry.QUERIES[name](spark, SF).toPandas(), c.execute(registry.ORACLES[name]).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b)
    for col in columns:
        assert np.allclose(a[col], b[col]) if a[col].dtype.kind == "f" else (a[col] == b[col]).all(), col


# 6 quality


def slow_stats(text):
    w = words_of(text)
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    win = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) for k in range(3) if win[tuple(w[i : i + 3])] > 1}
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_text_stats_equal_brute_force(spark):
    texts = [None, "", " \n ", "a a a a", "a b c a b c d", "x\nx\n\nx y\n", "# * | <>", "é\x1fé \x85 é", "w " * 5_000, "a b c x a b c y a b"]
    rows = quality.text_stats(docs_of(spark, texts).withColumn("n_words", F.lit("clash"))).orderBy("doc_id").collect()
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows] == [slow_stats(t) for t in texts]


def test_verdict_does_not_hang_on_the_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stats = quality.text_stats(docs)
    rules = [(r, 1.0, 0.1) for r in quality.RULES]
    kept = [{r.doc_id for r in quality.cascade(stats, order).where("rejected_by is null").collect()} for order in (rules, rules[::-1])]
    assert kept[0] == kept[1]
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == {r.doc_id for r in quality.judged(docs).where("kept").collect()}
    assert quality.judged(docs.limit(0)).count() == 0


def test_lazy_statistics_equal_the_columns(spark):
    texts = [None, "", " \n ", "a a a a", "a b c a b c d", "x\nx\n\nx y\n", "# * | <>", "é\x1fé \x85 é", "w " * 5_000, "a b c x a b c y a b"]
    docs = docs_of(spark, texts).orderBy("doc_id")
    held = quality._repeats(quality._words(docs))
    rows = held.select("doc_id", *[quality._own(c).alias(c) for c in quality.COUNTS]).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in rows] == [slow_stats(t) for t in texts]
    clash = docs.withColumnsRenamed({"lang": "n_words", "source": "n_lines"})
    assert quality.keep_good(clash).columns == clash.columns and "n_lines" in quality.judged(clash).columns


def test_base_rules_are_in_the_cascade_and_repeats_come_late(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    order = quality.rule_order(docs)
    assert {r.name for r, _, _ in order} == {r.name for r in quality.BASE + quality.RULES}
    found = quality.judged(docs).groupBy().agg(F.count_if(F.col("base_failed") & F.col("kept")).alias("both"), F.count_if("base_failed").alias("failed")).first()
    assert found.both == 0 and found.failed > 0


# 7 top-k


def test_top_k_with_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, None), (7, [None, 1.0]), (None, [1.0, 1.0]), (8, [0.5, -0.7]), (9, [1.0, 0.0, 0.0]), (10, [])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(v, F.col("vec_id") % 50 == 0, 3).collect()}
    assert got == {(0, 1): (3, 65536), (0, 2): (3, 65536), (0, 3): (50, 65536), (50, 1): (0, 65536), (50, 2): (3, 65536), (50, 3): (3, 65536)}
    assert topk.top_k(v.limit(0), F.lit(True)).count() == 0


def test_top_k_of_huge_finite_components(spark):
    rows = [(0, [1e300, 1.0]), (50, [-3.4e38, 2.0**60 + 2**20]), (3, [1.7e308, -1e308]), (4, [0.25, 0.5]), (5, [2.0**30, 2.0**29]), (6, [-1e300, -1.0]), (7, [1e-300, -1e-300])]
    exact = {i: [math.floor(Fraction(x) * 256) for x in v] for i, v in rows}
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, 4).collect()}
    for q in (0, 50):
        best = sorted((-sum(a * b for a, b in zip(exact[q], exact[i])), i) for i in exact if i != q)[:4]
        assert [got[q, n + 1] for n in range(4)] == [(i, -s if -(1 << 63) <= -s < 1 << 63 else None) for s, i in best]
    rows = [(i, [float((i * 37 + j * 11) % 101 - 50) * 2.0**16 for j in range(6)]) for i in range(30)]  # products of more than 53 bits
    exact = {i: [int(x) * 256 for x in v] for i, v in rows}
    got = {r["rank"]: (r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 7, 5).collect()}
    best = sorted((-sum(a * b for a, b in zip(exact[7], exact[i])), i) for i in exact if i != 7)[:5]
    assert [got[n + 1] for n in range(5)] == [(i, -s) for s, i in best]


def test_block_search_equals_brute_force():
    rng = np.random.default_rng(7)
    c = rng.integers(-128, 128, (700, 48))
    c[:20] = c[20:40]  # ties
    ids = rng.permutation(700)
    for i, (found, scores) in enumerate(topk.best_of_block(c[:40], ids[:40], c, ids, 5, 8)):
        s = c @ c[i]
        want = sorted((-int(x), int(k)) for x, k in zip(s, ids) if k != ids[i])[:5]
        assert list(zip(-scores, found)) == want


# 8 substrings


def slow_removal(rows, window):
    first = {}
    for d, t in rows:
        w = words_of(t)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, d), d)
    out = {}
    for d, t in rows:
        w = words_of(t)
        gone = {i + k for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < d for k in range(window)}
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[d] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("partitions", [1, 7])
def test_removal_equals_brute_force(spark, partitions):
    rng = random.Random(8)
    passages = [[rng.choice("abcdefghij") * rng.randrange(1, 3) for _ in range(rng.randrange(10, 40))] for _ in range(6)]
    rows = []
    for d in rng.sample(range(10_000), 90):
        parts = [rng.choice(passages) if rng.random() < 0.5 else [str(rng.random()) for _ in range(rng.randrange(0, 20))] for _ in range(4)]
        rows.append((d, rng.choice([" ", "\n", " \t "]).join(w for p in parts for w in p)))
    rows += [(20_000, rows[0][1]), (20_001, ""), (20_002, None), (20_003, "few words"), (20_004, "few words"), (20_005, "long " * 20_000)]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_words int").repartition(partitions)
    cut = substrings.without_repeats(docs)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in cut.collect()}
    assert got == slow_removal(rows, 13)
    for r in cut.collect():
        assert hashlib.sha256(" ".join(words_of(r.text)).encode()).hexdigest() == r.kept_sha256
    assert substrings.without_repeats(docs.limit(0)).count() == 0


def test_windows_that_a_document_repeats_are_few_rows(spark):
    text = "la " * 3_000 + " ".join(f"w{i % 40}" for i in range(4_000))
    rows = [(1, "la " * 20), (2, text), (3, text + " end"), (4, "other " + " ".join(f"w{i % 40}" for i in range(100)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.without_repeats(docs).collect()} == slow_removal(rows, 13)
    spans = substrings.repeated_spans(docs).collect()
    assert len(spans) < 20 and all(r.start >= 0 for r in spans)


def test_rows_without_an_id_stay(spark):
    text = " ".join(map(str, range(30)))
    got = substrings.without_repeats(docs_of(spark, [(None, text), (1, text), (1, text), (2, text)])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (1, 0), (1, 0), (2, 30)]


# 9 pieces


def paths_of(lat, node):
    if node < 0:
        yield (), 0.0
        return
    for e in range(int(lat.first[node]), int(lat.first[node]) + int(lat.n_edges[node])):
        for tail, p in paths_of(lat, int(lat.target[e])):
            yield (*lat.pieces(np.array([e])).tolist(), *tail), float(lat.log_p[e]) + p


def test_samples_are_all_paths_in_the_end_and_follow_their_odds():
    lat = pieces.Lattice(pieces.vocabulary())
    lat.known["▁the"]
    lat.add()
    odds = {p: math.exp(s) for p, s in paths_of(lat, 0)}
    assert math.isclose(sum(odds.values()), 1.0)
    whole = pieces.sample_batch(["the"], [1], 50, lat)[0]
    assert {tuple(p.tolist()) for p, *_ in whole} == set(odds) and all(s[3] == 1.0 for s in whole)
    assert [s[2] for s in whole] == sorted((s[2] for s in whole), reverse=True)
    n = 4_000
    firsts = Counter(tuple(s[0][0].tolist()) for s in pieces.sample_batch(["the"] * n, list(range(n)), 2, lat))
    assert all(abs(firsts[p] / n - q) < 4 * math.sqrt(q * (1 - q) / n) + 1e-3 for p, q in odds.items())


def test_samples_are_distinct_round_trips_that_hang_on_the_key(spark):
    texts = [t for _, t in plain_docs(spark)[:20]] + [None, "", " ", "  a  b ", "日本 龘\t\n\n", "x" * 3_000, "naïve ▁ mark", "the"]
    docs = docs_of(spark, texts)
    a = {(r.doc_id, r.sample): tuple(r.pieces) for r in pieces.sampled_segmentations(docs, k=3).collect()}
    rows = pieces.sampled_segmentations(docs.repartition(5), k=3).collect()
    assert a == {(r.doc_id, r.sample): tuple(r.pieces) for r in rows} and all(r.round_trip for r in rows)
    for i, t in enumerate(texts):
        own = [p for (d, _), p in a.items() if d == i]
        assert own and len(own) == len(set(own)) == (3 if i < 20 and len(t) > 20 else len(own))
    back = pieces.decode_pieces(pieces.sampled_segmentations(docs, k=1)).select("doc_id", "decoded").collect()
    assert {r.doc_id: r.decoded for r in back} == {i: (t or "").replace("▁", " ") for i, t in enumerate(texts)}
    assert pieces.sampled_segmentations(docs.limit(0)).count() == 0


def test_query_has_its_segmentations(spark):
    texts, v = dict(plain_docs(spark)), pieces.vocabulary()
    for r in pieces.op9_sentencepiece(spark, SF).where("doc_id < 40").collect():
        assert len(r.pieces) == r.n_pieces and pieces.decoded(np.asarray(r.pieces), v) == (texts[r.doc_id] or "").replace(pieces.SPACE, " ")


# 10 sharding


def test_shards_are_whole_even_and_repeatable(spark, tmp_path):
    texts = [t for _, t in plain_docs(spark)[:50]] + [None, "", "same", "same", (7, "again"), (7, "again")]
    docs = docs_of(spark, texts).withColumn("slot", F.lit("clash"))
    runs = [sorted((r.shard, r.slot, r.doc_id, r.text) for r in sharding.shuffled_shards(docs.repartition(n), str(tmp_path / str(n)), 8, bucket_bytes=20_000).collect()) for n in (1, 6)]
    assert runs[0] == runs[1]
    assert Counter((d, t) for _, _, d, t in runs[0]) == Counter((r.doc_id, r.text) for r in docs.collect())
    counts = Counter(s for s, *_ in runs[0])
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 8
    for s in counts:
        assert [x for k, x, *_ in runs[0] if k == s] == list(range(counts[s]))
    assert [d for *_, d, _ in runs[0]] != sorted(d for *_, d, _ in runs[0])
    few = sharding.shuffled_shards(docs.limit(3), str(tmp_path / "few"), 8)
    assert sorted((r.shard, r.slot) for r in few.collect()) == [(0, 0), (1, 0), (2, 0)]
    assert sharding.shuffled_shards(docs.limit(0), str(tmp_path / "none"), 8).count() == 0


def test_pairs_of_samples_follow_the_odds_of_drawing_without_replacement():
    lat = pieces.Lattice(pieces.vocabulary())
    lat.known["▁sun"]
    lat.add()
    odds = {p: math.exp(s) for p, s in paths_of(lat, 0)}
    n = 20_000
    pairs = Counter(tuple(tuple(x[0].tolist()) for x in s) for s in pieces.sample_batch(["sun"] * n, list(range(n)), 2, lat))
    for (a, b), seen in pairs.items():
        q = odds[a] * odds[b] / (1 - odds[a])
        assert abs(seen / n - q) < 5 * math.sqrt(q * (1 - q) / n) + 5e-4
    assert sum(odds[a] * odds[b] / (1 - odds[a]) for a, b in pairs) > 0.99


def test_inclusion_scores_weigh_samples_to_totals():
    lat = pieces.Lattice(pieces.vocabulary())
    n = 4_000
    lengths = [sum(math.exp(lp) / inside * len(p) for p, lp, _, inside in s) for s in pieces.sample_batch(["sun"] * n, list(range(n)), 3, lat)]
    lat.known["▁sun"]
    node = int(lat.start[lat.known["▁sun"]])
    want = sum(math.exp(s) * len(p) for p, s in paths_of(lat, node))
    assert abs(np.mean(lengths) - want) < 5 * np.std(lengths) / math.sqrt(n)


def test_lattices_of_long_chunks_equal_those_laid_out_at_once(monkeypatch):
    v, chunk = pieces.vocabulary(), "▁" + "unbelievableness" * 3
    held = []
    for block in (10_000, 7):
        monkeypatch.setattr(pieces, "BLOCK", block)
        lat = pieces.Lattice(v)
        lat.known[chunk]
        lat.add()
        held.append([sorted((int(lat.target[e]), int(lat.out[e]), round(float(lat.log_p[e]), 9)) for e in range(lat.first[i], lat.first[i] + lat.n_edges[i])) for i in range(len(chunk))])
    assert held[0] == held[1]
    text = "日本" * 40 + "unbelievable" + "龘" * 9
    codes = np.array([ord(c) for c in text], np.uint32)
    cuts = {0, *lat.cuts(codes, np.array([0]), np.array([len(text)])).tolist(), len(text)}
    pieces_ = {v.bytes_of[i].decode() for i in range(len(v.bytes_of)) if len(v.bytes_of[i]) > 1 and i not in v.byte_id}
    assert cuts == {i for i in range(len(text) + 1) if not any(text[a:b] in pieces_ for a in range(max(0, i - 16), i) for b in range(i + 1, min(len(text), a + 16) + 1))}


def test_unbroken_texts_null_ids_and_clashing_columns(spark):
    texts = [(None, "the sun"), (None, "the sun"), (3, "".join(chr(33 + i * i % 90) for i in range(100_000))), (4, "ab" * 20_000), (5, "the sun"), (5, "the sun")]
    docs = spark.createDataFrame([(i, t, "a", "b", 0) for i, t in texts], SCHEMA).withColumnsRenamed({"lang": "pieces", "source": "sample"})
    rows = pieces.sampled_segmentations(docs).collect()
    assert len(rows) == 12 and all(r.round_trip for r in rows)
    told = lambda i: Counter((r.sample, tuple(r.pieces)) for r in rows if r.doc_id == i)
    assert set(told(None).values()) == {2} and set(told(5).values()) == {2} and len(told(3)) == len(told(4)) == 2


def test_vectors_in_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(7)
    vectors = [(i, [float(x) for x in rng.normal(size=20)]) for i in range(300)]
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, embedding array<float>, query_id string")
    q = {i: np.floor(np.float32(v).astype(float) * 256).astype(int) for i, v in vectors}
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 40)
    monkeypatch.setattr(topk, "SCORED_AT_ONCE", 3)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 10 == 0, k=4).collect()}
    want = {}
    for i in range(0, 300, 10):
        for n, (s, j) in enumerate(sorted(((-int(q[i] @ q[j]), j) for j in q if j != i))[:4], 1):
            want[i, n] = (j, -s)
    assert got == want


def test_names_of_boxes_and_things_inside_paragraphs():
    page = lambda x: extraction.main_text(x, {})
    assert page('<article class="legal-news"><h1>T</h1><p>Body one.</p></article>') == "T\nBody one."
    assert page('<article><div class="article-header"><h1>Ti</h1></div><div class="print-content"><p>Bo</p></div></article>') == "Ti\nBo"
    assert page('<main><div class="share-price"><p>a</p></div><div id="popular-science"><p>b</p></div></main>') == "a\nb"
    assert page("<article><p>tail <svg><text>x</text></svg>more <button>Click <b>me</b></button>end</p></article>") == "tail more end"
    assert page('<article><p>a<script>var x="<p>";</script>c<select><option>1<option>2</select></p><div class="comment-list"><p>no</p></div></article>') == "ac"
    long = " ".join(f"w{i}" for i in range(200_000))
    assert page(f"<nav>menu</nav><article><p>{long}</p></article><footer>f</footer>") == long


def test_hosts_are_read_one_way(spark):
    urls = ["http://A.example/x", "//b.example:80/x", " https://u@c.example?x", "http://[::1]:8080/x", None, "no address", "mailto:x@y"]
    df = spark.createDataFrame([(u,) for u in urls], "url string").select(extraction.host_of(F.col("url")).alias("h"))
    assert [r.h for r in df.collect()] == ["a.example", "b.example", "c.example", "[::1]", "", "", ""]
    pages = spark.createDataFrame([(1, "//b.example/x", "<p>hello there</p>", "mine", "too"), (2, None, None, None, None)], "page_id long, url string, html string, host string, _of string")
    got = extraction.extracted(pages)
    assert got.columns == [*pages.columns, "text"] and {(r.page_id, r.host, r.text) for r in got.collect()} == {(1, "mine", "hello there"), (2, None, "")}


def test_classes_decide_on_generated_templates(spark):
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice(["river", "stone", "light", "walk", "north", "glass", "paper", "seven"]) + str(rng.randrange(900)) for _ in range(n))
    rows, want = [], {}
    for i in range(40):
        blocks = [say(20) for _ in range(rng.randrange(1, 5))]
        body = "".join(f"<p>{x}</p>" for x in blocks)
        html = f'<body><div class="a1x"><span>Our paper since 1900</span></div><div class="zq"><div class="kk">{body}</div></div><div class="mm"><a href="/1">One thing</a> <a href="/2">Other thing</a></div><div class="oo">All rights here</div></body>'
        rows.append((i, f"http://t.example/{i}", html))
        want[i] = "\n".join(blocks)
    got = {r.page_id: r.text for r in extraction.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == want


def test_context_windows_weigh_words_near_hits(spark):
    toxic = [f"you are a blarg and nobody wants you here number {i}" for i in range(40)]
    clean = [f"the report said that blarg is a term nobody should use number {i}" for i in range(20)] + [f"plain words about rivers and stones {i}" for i in range(200)]
    fit = spark.createDataFrame([(t, 1) for t in toxic] + [(t, 0) for t in clean], "text string, label int")
    near = toxicity.learn_context(fit, [("blarg", 3.0, True)])
    assert near["you"] > 1 > -1 > near["said"] and "rivers" not in near
    matches = toxicity._Matches(toxicity.LexiconAutomaton(["blarg"], [True]))
    a, b = (toxicity.features(t, matches, [3.0], near)[-1] for t in ("you are a blarg", "it said that blarg is a term"))
    assert a > 0 > b
    words = "you are a bl4rg x blar blargg blrag".split()
    hits = [w for w in words if toxicity._Matches(toxicity.LexiconAutomaton(["blarg"], [True]))[w]]
    assert hits == ["bl4rg", "blar", "blargg"]


def test_rows_that_repeat_without_end_are_dealt_over_buckets(spark, tmp_path):
    docs = spark.createDataFrame([(7, "same text", 1)] * 400 + [(i, "other" * 50, i) for i in range(40)] + [(None, None, None)] * 3 + [(50, "long " * 3_000, 0)], "doc_id long, text string, slot int").repartition(3)
    runs = [sharding.shuffled_shards(docs.repartition(n), str(tmp_path / f"s{n}"), bucket_bytes=2_000) for n in (2, 5)]
    a, b = ({(r.shard, r.slot): (r.doc_id, r.text) for r in x.collect()} for x in runs)
    assert a == b and len(a) == 444
    counts = Counter(shard for (shard, _), (d, _) in a.items() if d == 7)
    assert len(counts) == 8 and max(counts.values()) < 60
    assert sharding._told_apart(docs.drop("slot"), 10).select("_key").distinct().count() == 444
