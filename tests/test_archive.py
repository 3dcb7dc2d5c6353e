"""Functions, merges, sources and query state on small literal tables."""

import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from millrace.functions import authors, keywords, text
from millrace.operators import counts, fuzzy, merge
from millrace.plans.facets import FacetQuery
from millrace.plans.labels import classify, classify_by_prompt
from millrace.sources import archive, html


def values(spark, items, column, kind="string"):
    rows = spark.createDataFrame(list(enumerate(items)), f"k int, v {kind}")
    return [r[0] for r in rows.orderBy("k").select(column(F.col("v")).alias("o")).collect()]


def test_text(spark):
    assert values(spark, ["a  B c ", None], text.title_key) == ["a b c", ""]
    assert values(spark, ["ﬁne “x” Â soft­hy​phen"], text.sanitize_display) == ['fine "x" softhyphen']
    assert values(spark, ["Jose´ Garc´ia", "plain"], text.repair_accents) == ["Jose´ García", "plain"]
    assert values(spark, ["cafÃ© donâ€™t", "æ—¥", None], text.normalize_field)[:1] == ["café don't"]
    assert values(spark, ["(2019) see https://x.y/z , pp. 3-5; Smith et al. vol. 3"], text.strip_citations) == ["see , ; Smith"]
    assert values(spark, ["Tom &amp; Jerry  x"], text.clean_text) == ["Tom & Jerry x"]
    assert values(spark, ["exam-\nple  of\ntext"], text.unfold_pdf_text) == ["example of text"]
    assert values(spark, ["a | b ||c ", None], text.split_list) == [["a", "b", "c"], []]
    assert values(spark, [["a", "", "b"], None], text.join_list, "array<string>") == ["a | b", ""]
    assert values(spark, ['a,"b"', "plain", None], text.csv_cell) == ['"a,""b"""', "plain", ""]
    assert values(spark, [3.14159, -2.0], text.delta_label, "double") == ["+3.1%", "-2.0%"]
    assert values(spark, ['```json\n{"primary_theme": "A", "secondary_topics": ["B"]}\n```'], text.parse_answer)[0].secondary_topics == ["B"]
    assert values(spark, ["P12", "12", ""], lambda v: text.unique_poster(v, F.lit("77"))) == ["P12", "12-77", "77"]


def test_search(spark):
    index = values(spark, ["Brain-body B³ net, how do global", "Résumé ±5"], text.search_index)
    hit = lambda query, k: text.normalize_search(query) in index[k] or text.normalize_search(query).replace(" ", "") in index[k]
    assert hit("brainbody", 0) and hit("brain body", 0) and hit("b3net", 0) and hit("GLOBAL", 0) and not hit("dog", 0)
    assert hit("resume", 1) and text.normalize_search("Élan  vital!") == "elan vital"
    assert all(text.normalize_search(x) == x for x in index)


@pytest.mark.parametrize(
    ("field", "want"),
    [
        ("Ada Lovelace 1 ( ada@x.edu ), Alan Turing 2,3 ; 1 Uni A, 2 Uni B, 3 Lab C", "Ada Lovelace, Alan Turing"),
        ("Jane Doe, MIT, United States", "Jane Doe"),
        ("marcel van gerven & sean o'brien", "Marcel van Gerven, Sean O'Brien"),
        ("Jean-rémi king and ann mcdonald*", "Jean-Rémi King, Ann McDonald"),
        ("Presentation Time: now", ""),
        (None, ""),
    ],
)
def test_authors(spark, field, want):
    assert values(spark, [field], authors.normalize_authors) == [want]


def test_names(spark):
    people = ["o'brien", "J.D. smith", "(jean-rémi)", "MCDONALD", "de souza", "anna de souza", "DeVries", "x", "MIT"]
    assert values(spark, people, authors.capitalized) == ["O'Brien", "J.D. Smith", "(Jean-Rémi)", "McDonald", "De Souza", "Anna de Souza", "DeVries", "X", "MIT"]
    parts = ["Ann Lee, Bobb, Ray, Cy Dow", None, "A B, C D"]
    assert values(spark, parts, lambda c: authors.normalize_authors(c, {("bobb", "ray"): "Bobby Ray"})) == ["Ann Lee, Bobby Ray, Cy Dow", "", "A B, C D"]
    assert values(spark, ["MIT", "the United States.", "Jane Doe", "Dept of X", "A. Labrador", "Bell Labs"], authors.is_affiliation) == [True, True, False, True, False, True]
    assert [authors.is_affiliation_text(p) for p in ("MIT", "the United States.", "Jane Doe", "Dept of X", "A. Labrador", "Bell Labs")] == [True, True, False, True, False, True]
    # points: 4 for ;, 2 for a digit, 3 for an address, 5 for two names, 3 for two people, 1 for a comma, 1 for 40 characters
    scored = ["", None, "Ada Lovelace", "Ada Lovelace, Alan Turing", "Ada Lovelace 1 (ada@x.edu), Alan Turing 2 ; 1 Uni", "a,", "x" * 400]
    assert values(spark, scored, authors.block_score) == [0, 0, 1, 9, 19, 1, 6]
    blocks = ["Ada Lovelace, Alan Turing", "Presenter: Ada Lovelace, Alan Turing", "ann 1, bob 2 ; uni", "plain text, here", "Abstract of Ada Lovelace, Alan Turing", None, "Ada Lovelace, Alan Turing " + "x" * 700]
    assert values(spark, blocks, lambda c: authors.is_author_block(c, F.lit("<p>"))) == [True, False, True, False, False, False, False]
    assert values(spark, ["x"], lambda c: authors.is_author_block(c, F.lit("<sup>1</sup>"))) == [True]
    noise = ["Search Papers", "poster session 3", "poster session 3 poster <b>", "Poster B2 in Hall " + "y" * 200, "Extended Abstract: x"]
    assert values(spark, noise, authors.is_noise_paragraph) == [True, True, False, False, True]


def test_author_columns(spark):
    lists = ["Ada Lovelace", "Ada Lovelace 1 (ada@x.edu), Alan Turing 2 ; 1 Uni", ""]
    assert values(spark, lists, authors.authors_are_thin) == [True, False, True]
    assert values(spark, [", ".join(f"Name {c}x" for c in "ABCDEFGH")], authors.tooltip) == ["Name Ax, Name Bx, Name Cx, Name Dx, Name Ex, Name Fx, et al."]
    assert values(spark, ["", "View PDF now", "Poster A1 in Hall", "A real paragraph"], authors.is_noise_paragraph) == [True, True, True, False]


def test_keywords(spark):
    lists = lambda items, f: values(spark, items, f, "array<string>")
    dirty = ["deeplearning", "fMRI", "the brain", "John Smith", "Poster", "x", "memory (2019)", "fMRI"]
    assert lists([dirty, ["fMRI", None], None, []], keywords.sanitize_keywords) == [["deep learning", "fmri", "memory"], ["fmri"], [], []]
    raw = ["Neural coding; fMRI, working memory & attention  Introduction text", "Deep nets. Vision 2. Memory", "good one, x ≤ y, lost", None]
    assert values(spark, raw, keywords.parse_keywords) == [["neural coding", "fmri", "working memory", "attention"], ["deep nets", "vision 2", "memory"], ["good one"], []]
    title = "The Learning of Neural Codes via Learning"
    assert values(spark, [title, None], keywords.title_keywords) == [["learning", "neural", "codes"], []]
    low = lambda abstract: lambda c: keywords.low_quality(c, F.lit(title), F.lit(abstract))
    assert lists([["learning", "neural", "codes"], ["codes"], ["vision"], [], ["abcdefghijklmnop"], ["two words", "abcdefghijklmnop x"]], low("")) == [True, True, False, False, True, False]
    prose = [f"word{c}" for c in "abcdefgh"]
    assert lists([prose], low(" ".join(prose))) == [True] and lists([prose], low("none")) == [False]
    rules = keywords.KeywordRules(split_inner_and=True)
    assert values(spark, ["understanding"], keywords.split_compounds) == ["understanding"]
    assert values(spark, ["understanding"], lambda c: keywords.split_compounds(c, rules)) == ["underst and ing"]
    assert values(spark, ["self-supervised", "selfsupervisedlearning", "deep networkmodels", "ab-learning", "xlearning", "model"], keywords.split_compounds) == ["self supervised", "self supervised learning", "deep network models", "ab learning", "xlearning", "model"]
    many = [[f"word{k}" for k in range(12)], [f"two words{k}" for k in range(12)], ["a b"]]
    assert [len(k) for k in lists(many, keywords.compacted)] == [0, 8, 1]
    people = ["john smith", "deep nets", "vision", "a", "b", "c"]
    assert lists([people, people[:5]], keywords.without_names) == [people[1:], people[:5]]
    phrases = ["deep nets", "the brain", "in vivo imaging", "we show it", "a" * 19, "a-" * 17 + "b", "x (y", "(x) y", "one two the four five", "de smith", "x ray", "2019", "", "x" * 80, "what is it?"]
    assert values(spark, phrases, keywords.is_plausible) == [True, False, True, False, False, True, False, True, False, False, False, False, False, False, False]
    assert values(spark, ["poster session", "fmri", "", "keywords", "neural poster"], keywords.is_metadata) == [True, False, True, True, False]
    assert values(spark, ["van gogh", "john smith", "ab cd", "deep nets", "van go-gh", "john smi1h"], keywords.is_name_or_citation) == [True, True, True, False, False, False]
    authored = [["Deep Nets", "12", "3(4)", "View PDF", "Deep nets", None], [f"word{c}" for c in "abcdefghij"], [f"two word{w}" for w in "abcdefghij"], None]
    assert lists(authored, keywords.author_keywords) == [["deep nets"], [], [f"two word{w}" for w in "abcdefgh"], []]


def test_keyword_resolution(spark):
    schema = "k int, a array<string>, e array<string>, c array<string>, title string, abstract string, authors string, label string"
    title = "Neural codes of memory"
    rows = [
        (0, ["fMRI"], ["x y z"], None, title, "", "", None),
        (1, ["Ada Lovelace"], ["deep nets"], None, title, "", "Ada Lovelace, Bob", None),
        (2, ["Ada Lovelace"], ["deep nets"], None, title, "", "Ada Lovelace, Bob", "vision"),
        (3, [], ["neural", "codes"], ["memory nets"], title, "", "", None),
        (4, None, None, ["neural", "codes", "memory"], title, None, None, None),
        (5, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    c = {n: F.col(n) for n in df.columns}
    got = df.select("k", keywords.reconciled(c["a"], c["e"], c["c"], c["title"], c["abstract"], c["authors"], c["label"]).alias("r"), keywords.dashboard_keywords(c["a"], c["e"], c["c"], c["title"], c["label"]).alias("d"), keywords.content_keywords(c["a"], c["e"], c["c"]).alias("f")).orderBy("k").collect()
    assert [tuple(r.r) for r in got] == [
        (["fmri"], [], ["fmri"]),
        (["ada lovelace"], ["deep nets"], ["deep nets"]),
        (["ada lovelace"], [], ["vision"]),
        ([], [], ["memory nets"]),
        ([], [], []),
        ([], [], []),
    ]
    assert [r.d for r in got] == [["fmri"], ["ada lovelace"], ["ada lovelace"], ["memory nets"], [], []]
    assert [r.f for r in got] == [["fmri"], ["ada lovelace"], ["ada lovelace"], ["neural", "codes"], ["neural", "codes", "memory"], []]
    own = lambda html, paper, label, counts: tuple(df.limit(1).select(keywords.finalized(F.array(*map(F.lit, html)).cast("array<string>"), F.array(*map(F.lit, paper)).cast("array<string>"), F.lit(label), F.lit(counts)).alias("r")).first().r)
    assert own(["Deep nets"], ["other"], "vision", False) == (["deep nets"], [], ["deep nets"])
    assert own([], ["Other one"], "vision", False) == (["other one"], [], ["other one"])
    assert own([], [], "vision", False) == ([], [], ["vision"]) and own([], [], "poster", False) == ([], [], []) and own([], [], "poster", True) == ([], [], ["poster"])
    asked = lambda force: [r[0] for r in df.orderBy("k").select(keywords.needs_paper(c["a"], F.lit(2018), F.when(c["k"] > 3, "u"), [2018], force)).collect()]
    assert asked(False) == [False] * 4 + [True] * 2 and asked(True) == [False] * 4 + [True] * 2
    html = df.orderBy("k").select(keywords.initial_html_keywords(c["a"], c["c"], c["k"] != 4).alias("h")).collect()
    assert [r.h for r in html] == [["fMRI"], ["Ada Lovelace"], ["Ada Lovelace"], ["memory nets"], [], []]


def test_facets(spark):
    rows = spark.createDataFrame([(1, 2017, ["A", "B"], "deep nets"), (2, 2018, ["A"], "x"), (3, 2018, None, "y"), (4, 2019, [], "deepnets")], "row_ord int, year int, topics array<string>, search_text string")
    ids = lambda q: sorted(r.row_ord for r in q.filtered(rows).collect())
    both = FacetQuery(topics=("A", "B"))
    assert ids(both) == [1] and ids(both.with_mode("exclude")) == [2, 3, 4] and ids(FacetQuery()) == [1, 2, 3, 4]
    assert ids(FacetQuery(search="Deep-nets")) == [1, 4] and ids(FacetQuery(years=(2018,), search=" ")) == [2, 3]
    q = FacetQuery().toggle_year(2018).toggle_year(2017).toggle_topic("b").toggle_topic("Á")
    assert q.years == (2017, 2018) and q.topics == ("Á", "b") and q.toggle_year(2017).years == (2018,)
    assert q.label() == "Years 2017 and 2018 · Include papers with all of Á and b" and q.year_menu_label() == "2017, 2018"
    assert q.slug().startswith("years-2017-and-2018") and FacetQuery().slug() == "all-submissions"
    assert FacetQuery(years=(2022,)).with_delta_years([2019, 2022, 2023]).delta == (2019, 2022)
    assert FacetQuery(years=(2019,)).with_delta_years([2019, 2022]).delta == (2019, 2022)
    shown = FacetQuery(years=(2017,), search="zzz", topics=("A",)).reveal(2018, ["B"], "text")
    assert (shown.years, shown.search, shown.topics) == ((2018,), "", ())
    listed = rows.selectExpr("*", "string(row_ord) row_key", "search_text title", "'u' source_url", "'' poster_number", "'Ann' authors")
    assert [(r.row_key, r.meta, r.topics, r.highlighted) for r in FacetQuery(topics=("B", "A"), highlighted="1").paper_list(listed).collect()] == [("1", "2017 · Ann", ["A", "B"], True)]
    assert [r.row_ord for r in FacetQuery(years=(2017,)).drawn_points(rows).collect()] == [2, 3, 4, 1]
    assert FacetQuery(years=(2018,)).note(4, 2) == "4 papers on map · 2 highlighted · Year 2018" and FacetQuery().note(4, 0) == "4 submissions, colored by year"
    assert FacetQuery(topics=("A",)).results_label(3) == "3 papers · Include papers with A" and FacetQuery().results_label(3) == "3 matching submissions"
    assert FacetQuery().with_delta_years([2017, 2018, 2026, 2027], (2017, 2026)).delta == (2017, 2026)
    dateless = spark.createDataFrame([(5, None, ["A", "A", "C"], "z")], rows.schema).unionByName(rows)
    assert {(r.year, r.topic, r.n, r.year_total) for r in counts.topic_year_pivot(dateless).collect() if r.n or r.year is None} == {(None, "A", 1, 1), (None, "B", 0, 1), (None, "C", 1, 1), (2017, "A", 1, 1), (2017, "B", 1, 1), (2018, "A", 1, 2)}
    pivot = counts.topic_year_pivot(both.filtered(rows), rows).collect()
    assert {(r.year, r.topic, r.n) for r in pivot} == {(2017, "A", 1), (2017, "B", 1)}


def test_merge(spark):
    rng = random.Random(2)
    items = [(rng.randrange(9), k) for k in range(40)]
    want = OrderedDict()
    for key, k in items:
        want[key] = k
    got = merge.last_wins(spark.createDataFrame([(a, b, b) for a, b in items], "key int, v int, ord int"), ["key"], "ord").orderBy("place").collect()
    assert [(r.key, r.v) for r in got] == list(want.items())

    schema = "row_ord int, id string, year int, title_key string, authors string, abstract string"
    old = spark.createDataFrame([(1, "a", 2019, "t1", "X", "old a"), (2, "b", 2019, "t2", "Ann Lee 1, Bob Ray 2 ; 1 Uni", "old b"), (3, "a", 2018, "t1", "Z", "keep")], schema)
    new = spark.createDataFrame([(9, "a", 2019, "t9", "", ""), (10, "new", 2019, "t2", "Ann Lee", "new"), (11, "q", 2019, "t7", "Q", "")], schema)
    got = {(r.id, r.year): (r.authors, r.abstract) for r in merge.merge_years(old, new, [2019], ["authors", "abstract"], authors.block_score).collect()}
    assert got == {("a", 2018): ("Z", "keep"), ("a", 2019): ("X", "old a"), ("new", 2019): ("Ann Lee 1, Bob Ray 2 ; 1 Uni", "new"), ("q", 2019): ("Q", "")}
    dateless = spark.createDataFrame([(4, "z", None, "t4", "N", "no year")], schema).unionByName(old)
    assert {(r.id, r.year) for r in merge.merge_years(dateless, new.limit(0), [2019], ["authors", "abstract"]).collect()} == {("a", 2018), ("z", None)}
    assert {(r.id, r.year) for r in merge.replace_year(dateless, new.where("id = 'q'"), 2019).collect()} == {("q", 2019), ("a", 2018), ("z", None)}
    clash = merge.last_wins(spark.createDataFrame([(1, 5, "x", 1, 7), (1, 6, "y", 2, 8)], "r int, place int, row string, ord int, v int"), ["r"], "ord")
    assert clash.columns == ["r", "place", "row", "ord", "v", "place_"] and [tuple(x) for x in clash.collect()] == [(1, 6, "y", 2, 8, 1)]
    points = spark.createDataFrame([("k1", 2019, "P1", 1, 1.0, 2.0), ("k1", 2019, "P1", 2, 3.0, 4.0), ("k9", 2026, "P2", 3, 5.0, 6.0)], "row_key string, year int, poster_number string, row_ord int, x double, y double")
    seen = spark.createDataFrame([("k1", "P1", 0, 0), ("k2", "P2", 0, 0), ("k3", None, 0, 0)], "row_key string, poster_number string, own int, other int")
    assert sorted((r.row_key, r.x, r.y) for r in merge.with_coordinates(seen, points, 2026).collect()) == [("k1", 3.0, 4.0), ("k2", 5.0, 6.0), ("k3", None, None)]
    assert merge.with_coordinates(seen, points).columns == [*seen.columns, "x", "y"]
    assert {r.row_key for r in merge.display_points(merge.with_coordinates(seen, points)).collect()} == {"k1"}
    topics = spark.createDataFrame([("k1", 1, ["b", "a"]), ("k1", 2, ["c"])], "row_key string, row_ord int, topics array<string>")
    assert sorted((r.row_key, r.x, r.topics) for r in merge.point_topics(points, topics).collect()) == [("k1", 1.0, ["a", "b"]), ("k1", 3.0, ["a", "b"]), ("k9", 5.0, [])]
    pair = merge.pending_backfill((F.lit(""), F.lit(None)), (F.lit("track"), F.lit("text")))
    assert tuple(old.limit(1).select(*pair).first()) == ("track", "text")
    same = merge.merge_years(old, new.limit(0), [], ["authors", "abstract"])
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, old.collect()))

    own = lambda p, s: spark.createDataFrame([(p, s)], "p string, s array<string>").select(merge.assignment(F.col("p"), F.col("s"), ["A", "B", "C"], "A")).first()[0]
    assert own("B", ["C", "B", "x"]) == ["B", "C"] and own("x", ["C", "B"]) == ["C", "B"] and own(None, None) == ["A"]


def test_classify(spark):
    rows = spark.createDataFrame([("k1", 1, "good", "", None), ("k2", 2, "bad", "", []), ("k3", 3, "known", "", [])], "row_key string, row_ord int, title string, abstract string, keywords array<string>")
    cache = spark.createDataFrame([("k3",)], "row_key string")

    def own(title, abstract, keywords):
        if title == "bad":
            raise ValueError
        return "B", ["A"]

    got = {r.row_key: (r.assigned_topics, r.failed) for r in classify(rows, cache, own, ["A", "B"], "A", wait=0.0).collect()}
    assert got == {"k1": (["B", "A"], False), "k2": (["A"], True)}
    assert classify(rows, cache, own, ["A", "B"], "A", limit=1, wait=0.0).count() == 1

    def ask(prompt):
        if "Title: bad" in prompt:
            return "I can't tell"
        assert "- A\n- B" in prompt
        return '```json\n{"primary_theme": "B", "secondary_topics": ["x", "A"]}\n```'

    got = {r.row_key: (r.assigned_topics, r.failed) for r in classify_by_prompt(rows, cache, ask, ["A", "B"], "A", wait=0.0).collect()}
    assert got == {"k1": (["B", "A"], False), "k2": (["A"], True)}


def test_fuzzy(spark):
    import difflib

    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(40)]
    right = [(k, " ".join(rng.choices(words, k=rng.randint(3, 9)))) for k in range(60)]
    left = []
    for k, (_, t) in enumerate(right[:40]):
        own = list(t)
        for _ in range(rng.randint(0, 5)):
            own[rng.randrange(len(own))] = rng.choice("abcxyz ")
        left.append((k, "".join(own)))
    # runs that repeat, short titles, equal ones
    right += [(100, "a" * 20), (101, "ha " * 20), (102, "abcdef"), (103, "abcde"), (104, "xy"), (105, "xyz"), (106, "twice same"), (107, "twice same"), (108, "abcdefghijklm"), (109, "n" * 250 + "m" * 250)]
    left += [(100, "a" * 19 + "b"), (101, "ha " * 19 + "hb "), (102, "abcdefg"), (103, "bcdef"), (104, "x"), (105, "xyzw"), (106, "twice same"), (107, "abcdeghijklm"), (108, "n" * 249 + "m" * 250), (109, "abdefghijklmn")]
    got = fuzzy.best_titles(spark.createDataFrame(left, "left_id long, title_key string"), spark.createDataFrame(right, "right_id long, right_key string")).collect()
    want = {}
    for i, a in left:
        best = max((1.0 if a == b else difflib.SequenceMatcher(None, b, a).ratio(), b, j) for j, b in right)
        if best[0] >= 0.86:
            want[i] = (best[2], round(best[0], 9))
    assert {r.left_id: (r.right_id, round(r.ratio, 9)) for r in got} == want and len(want) > 15 and len(got) == len(want)
    small = ["".join(rng.choices("ab", k=rng.randint(1, 9))) for _ in range(60)]
    one, two = small[:30], sorted(set(small[30:]))
    want = {}
    for i, a in enumerate(one):
        best = max((1.0 if a == b else difflib.SequenceMatcher(None, b, a).ratio(), b) for b in two)
        if best[0] >= 0.86:
            want[i] = best[1]
    got = fuzzy.best_titles(spark.createDataFrame(list(enumerate(one)), "left_id int, title_key string"), spark.createDataFrame(list(enumerate(two)), "right_id int, right_key string")).collect()
    assert {r.left_id: r.right_key for r in got} == want
    with pytest.raises(ValueError):
        fuzzy.best_titles(None, None, 0.8)


def test_sources(spark, tmp_path):
    listing = '<table class="listing"><tr><td>A1</td><td><a href="/poster/?id=7">A &amp; title</a></td><td>Jane</td><td>Topic</td></tr><tr><td>none</td></tr></table>'
    assert html.listing(listing, "https://x.org/list/") == [{"id": "7", "poster_number": "A1", "title": "A & title", "presenter": "Jane", "topic": "Topic", "url": "https://x.org/poster/?id=7"}]
    page = f"<h2>Title</h2><p>Keywords: a, b</p><p>Presenter: P</p><p>Ann<sup>1</sup></p><script>x</script><p>{'long ' * 40}</p><p>{'word ' * 30}</p>"
    assert html.detail(page) == {"title": "Title", "abstract": ("long " * 40).strip(), "authors": "Ann1", "keywords": "a, b", "topic_area": "", "presenter": "P"}
    older = "<h3>An old title</h3><table><tr><td>Poster 3, Hall B</td></tr><tr><td>Ada Lovelace 1, Alan Turing 2</td></tr></table><div class='session-trackname big'>Vision</div><div class='paper-abstract'>Short <b>abstract</b>.</div><p>" + "z " * 100 + "</p>"
    assert html.detail(older) == {"title": "An old title", "abstract": "Short abstract.", "authors": "Ada Lovelace 1, Alan Turing 2", "keywords": "", "topic_area": "Vision", "presenter": ""}
    papers_ = '<table><tr><td>1</td><td><a href="abstract_12.pdf">T &amp; one</a></td><td>Ann</td><td>x</td></tr><tr><td><a href="abstract_13.pdf">y</a></td></tr></table>'
    assert html.paper_listing(papers_, "http://b.c/l/") == [{"id": "12", "title": "T & one", "authors": "Ann", "url": "http://b.c/l/abstract_12.pdf"}]
    assert html.paper_link('<a href="x.html">a</a><a href="../p.PDF?v=1">b</a>', "http://b.c/d/") == "http://b.c/p.PDF?v=1"
    assert html.paper_link("<a onclick=\"window.open('q.php')\">", "http://b.c/d/") == "http://b.c/d/q.php" and html.paper_link("", "http://b.c") == ""
    old = '<a href="p.php?PaperNum=12">First title</a><a href="p.php?PaperNum=12">Last title</a><a href="p.php?PaperNum=13">x</a>'
    assert html.anchors(old, "http://b.c/", r"PaperNum=(\d+)") == [{"id": "12", "title": "Last title", "url": "http://b.c/p.php?PaperNum=12"}]
    assert values(spark, ['<a href="b.pdf"><a HREF="a.PDF"><a href="b.pdf">'], html.pdf_links) == [["a.PDF", "b.pdf"]]
    fields = values(spark, ["Abstract: some\ntext Keywords: k1; k2 Introduction rest"], html.pdf_fields)[0]
    assert (fields.abstract, fields.keywords) == ("some text", "k1; k2")

    (tmp_path / "p.json").write_text('{"metadata": {}, "submissions": [{"id": "1", "year": 2019, "title": "T, \\"q\\"", "keywords": ["a"]}], "stats": {}}')
    rows = archive.read_payload(spark, str(tmp_path / "p.json"))
    assert rows.first().asDict()["authors"] == "" and rows.first().keywords == ["a"]
    full = rows.withColumns({"author": F.lit("A"), "assigned_topics": F.array(F.lit("x"), F.lit("y"), F.lit("z")), "umap_x": F.lit(1.5), "umap_y": F.lit(None).cast("double")})
    archive.write_explorer(full, str(tmp_path / "csv"))
    back = archive.read_explorer(spark, str(tmp_path / "csv")).first()
    assert (back.title, back.year, back.topics, back.x, back.y) == ('T, "q"', 2019, ["x", "y"], 1.5, None)
    assert archive.read_snapshot(spark, str(tmp_path / "csv")).first().keywords == ["a"]
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf/a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "pdf/b.pdf").write_bytes(b"<html>")
    assert archive.read_pdfs(spark, str(tmp_path / "pdf")).count() == 1

    def get(url):
        if "bad" in url:
            raise OSError("down")
        return "body"

    got = {r.url: (r.body, r.error) for r in archive.fetched(spark.createDataFrame([("a",), ("bad",)], "url string"), get, wait=0.0, tasks=2).collect()}
    assert {u: (bytes(b).decode() if b else b, e) for u, (b, e) in got.items()} == {"a": ("body", None), "bad": (None, "down")}
    raw = bytes([0x25, 0x50, 0x44, 0x46, 0xFF, 0xFE, 0x00, 0xE9])
    pdf = archive.fetched(spark.createDataFrame([("p",), (None,)], "url string"), lambda url: {"p": raw}[url], wait=0.0, tasks=1).orderBy(F.desc("url")).collect()
    assert bytes(pdf[0].body) == raw and pdf[1].body is None and pdf[1].error
    shown = spark.createDataFrame([(bytearray(b"caf\xc3\xa9"),), (bytearray(b"caf\xe9"),), (None,)], "body binary").select(archive.body_text(F.col("body")).alias("t")).collect()
    assert [r.t for r in shown] == ["café", "caf\ufffd", None]

    urls = spark.createDataFrame([("a.pdf",), ("b.html",), ("c.pdf",), ("a.pdf",), ("",)], "url string")
    bodies = {"a.pdf": b"%PDF text of a", "b.html": b"<html>", "c.pdf": b"%PDF bad"}

    def extract(body):
        if b"bad" in body:
            raise ValueError
        return body[5:].decode()

    known = spark.createDataFrame([("k.pdf", "old"), ("c.pdf", "of c")], "url string, text string")
    read = lambda known: {r.url: r.text for r in archive.paper_texts(urls, extract, bodies.__getitem__, known, wait=0.0, retries=1, tasks=1).collect()}
    assert read(None) == {"a.pdf": "text of a", "b.html": "", "c.pdf": ""} and read(known) == {"a.pdf": "text of a", "b.html": "", "c.pdf": "of c"}

    archive.write_payload(rows, str(tmp_path / "payload"), {"n": rows.groupBy("year").count()}, source="s")
    back = archive.read_payload(spark, str(tmp_path / "payload"))
    assert [tuple(r) for r in back.collect()] == [tuple(r) for r in rows.collect()] and back.columns == rows.columns
    about = spark.read.json(str(tmp_path / "payload/metadata")).first()
    assert about.years == [2019] and about.total_count == 1 and about.source == "s"
    labels = str(tmp_path / "labels")
    assert archive.read_labels(spark, labels).count() == 0
    for topic in ("A", "B"):
        archive.append_labels(spark.createDataFrame([("k", [topic]), (topic, [topic])], "row_key string, assigned_topics array<string>"), labels, "m")
    assert {r.row_key: r.assigned_topics for r in archive.read_labels(spark, labels).collect()} == {"k": ["B"], "A": ["A"], "B": ["B"]}
    archive.write_embeddings(full.unionByName(full.withColumn("umap_y", F.lit(2.5))), str(tmp_path / "points"), "m")
    assert [(r.id, r.x, r.y, r.title) for r in spark.read.json(str(tmp_path / "points/points")).collect()] == [("1", 1.5, 2.5, 'T, "q"')]
    assert values(spark, [None], lambda v: archive.export_stamp(F.lit("2024-03-05").cast("date"))) == ["20240305"]
    (tmp_path / "pending.csv").write_text("title,track,abstract\nA  b,T1,x\na B,T2,y\n,T3,z\n")
    assert [(r.title_key, r.track) for r in archive.read_pending(spark, str(tmp_path / "pending.csv")).collect()] == [("a b", "T2")]


def test_acquire(spark, tmp_path):
    from millrace.plans import acquire

    listing = "<table class='listing'>" + "".join(f'<tr><td>P{k}</td><td><a href="/poster/?id={k}">Title number {w}</a></td><td>Pres Enter</td><td>Vision</td></tr>' for k, w in ((2, "two"), (1, "one"), (3, "three"), (4, "[GAC update] x"))) + "</table>"
    details = {
        "1": f"<h2>Title number one</h2><p>Keywords: fMRI, deep nets</p><p>Ada Lovelace<sup>1</sup>, Alan Turing<sup>2</sup></p><p>{'An abstract. ' * 20}</p>",
        "2": '<h2>Monday 3</h2><a href="/files/two.pdf">pdf</a>',
    }
    paper = "Title number two\nGrace Hopper (g@x.org), Mary Shaw (m@y.org)\nAbstract\nWe look.\nKeywords: working memory; vision\n\nBody"
    site = {"http://a/list": listing, "http://a/files/two.pdf": b"%PDF" + paper.encode(), **{f"http://a/poster/?id={k}": f"{d}<h2>[GAC update] x</h2>" if k == "4" else d for k, d in details.items()}}
    site["http://a/poster/?id=4"] = "<h2>[GAC update] news</h2>"
    sources = [acquire.YearSource(2018, "http://a/list"), acquire.YearSource(2019, "http://a/none"), acquire.YearSource(2017, "http://a/empty")]
    site["http://a/empty"] = "<p>nothing</p>"
    how = {"get": site.__getitem__, "extract": lambda body: body[4:].decode(), "rules": acquire.Rules(paper_years=(2018,)), "wait": 0.0, "retries": 1, "tasks": 1}
    prior = spark.createDataFrame([(2018, "Title  number three!", "Old track", "Old abstract")], "year int, title string, track string, abstract string")
    rows, failed = acquire.scrape(spark, sources, prior=prior, **how)
    got = {r.id: r for r in rows.collect()}
    assert sorted(got) == ["1", "2", "3"] and sorted((r.year, r.url) for r in failed.collect()) == [(2017, "http://a/empty"), (2019, "http://a/none")]
    assert (got["1"].authors, got["1"].keywords, got["1"].author_keywords) == ("Ada Lovelace, Alan Turing", ["fmri", "deep nets"], ["fmri", "deep nets"])
    assert got["1"].abstract.startswith("An abstract") and got["1"].poster_number == "P1" and got["1"].row_ord < got["2"].row_ord < got["3"].row_ord
    assert (got["2"].title, got["2"].authors, got["2"].keywords) == ("Title number two", "Grace Hopper, Mary Shaw", ["working memory", "vision"])
    assert (got["3"].authors, got["3"].keywords, got["3"].abstract, got["3"].track) == ("Pres Enter", ["vision"], "Old abstract", "Vision")

    posted = acquire.YearSource(2020, "http://a/search", form=(("q", "all"),))
    rows_2020, none = acquire.listings(spark, [posted, acquire.YearSource(2020, "http://a/list")], site.__getitem__, lambda url, form: listing if form == {"q": "all"} else "", wait=0.0, retries=1, tasks=1)
    assert rows_2020.count() == 8 and none.count() == 0

    bare = rows.withColumns({c: F.array().cast("array<string>") for c in ("author_keywords", "extracted_keywords", "keywords")})
    again = {r.id: (r.gained, r.keywords) for r in acquire.refresh_keywords(bare, **how).collect()}
    assert again == {"1": (True, ["fmri", "deep nets"]), "2": (True, ["working memory", "vision"]), "3": (False, ["vision"])}
    assert {r.gained for r in acquire.refresh_keywords(rows, years=[2000], **how).collect()} == {False}
    old = rows.withColumns({"abstract": F.lit("older"), "year": F.when(F.col("id") == "1", 2018).otherwise(2015)})
    new = acquire.update(old, rows.where("id <> '3'").withColumn("abstract", F.lit("")), [2018])
    assert sorted((r.id, r.year, r.abstract) for r in new.collect()) == [("1", 2018, "older"), ("2", 2015, "older"), ("2", 2018, ""), ("3", 2015, "older")]


def test_neighbours(spark):
    import numpy as np

    from millrace.operators import vectors

    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    v = centres[rng.integers(0, 40, 1500)] + 0.4 * rng.normal(size=(1500, 16))
    v /= np.linalg.norm(v, axis=1)[:, None]
    points = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "doc_id long, v array<double>").repartition(4)
    cosine = v @ v.T
    np.fill_diagonal(cosine, -2)
    least = np.sort(cosine, axis=1)[:, -5]
    for cell, recall in ((5000, 1.0), (150, 0.9)):
        got = vectors.neighbours(points, k=5, cell=cell).collect()
        assert len(got) == 5 * 1500 and sum(cosine[r.doc_id, r.other] >= least[r.doc_id] - 1e-9 for r in got) >= recall * len(got)
        assert all(abs(r.similarity - cosine[r.doc_id, r.other]) < 1e-9 for r in got[:100])


def test_layout_keeps_groups_together(spark):
    from millrace.operators import vectors

    rng = random.Random(3)
    words = [[f"{g}word{k}" for k in range(30)] for g in "abc"]
    docs = [(k, " ".join(rng.choices(words[k % 3], k=25))) for k in range(90)] + [(200, None), (201, docs_twice := "aword1 aword2 aword3"), (202, docs_twice)]
    got = {r.doc_id: (r.x, r.y) for r in vectors.layout(vectors.tfidf(spark.createDataFrame(docs, "doc_id int, text string"))).collect()}
    assert set(got) == {k for k, _ in docs} - {200} and got[201] == pytest.approx(got[202])
    gap = lambda a, b: ((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5
    mean = [tuple(sum(got[k][j] for k in range(g, 90, 3)) / 30 for j in (0, 1)) for g in range(3)]
    inside = max(sum(gap(got[k], mean[g]) for k in range(g, 90, 3)) / 30 for g in range(3))
    assert inside * 2 < min(gap(mean[a], mean[b]) for a, b in ((0, 1), (0, 2), (1, 2)))
    again = {r.doc_id: (r.x, r.y) for r in vectors.layout(vectors.tfidf(spark.createDataFrame(docs, "doc_id int, text string"))).collect()}
    assert all(again[k] == pytest.approx(got[k], abs=1e-6) for k in got)


def test_streamed_upsert(spark, tmp_path):
    from millrace.streaming.upsert import current, upsert

    schema = "key int, v int, ord int"
    for n, rows in enumerate(([(1, 10, 1), (2, 20, 2), (1, 11, 3)], [(2, 21, 4), (3, 30, 5)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        upsert(stream, f"{tmp_path}/out", ["key"], "ord", f"{tmp_path}/state").awaitTermination()
        assert n == 0 or {r.key: r.v for r in current(spark, f"{tmp_path}/out", ["key"]).collect()} == {1: 11, 2: 21, 3: 30}
