"""Content by the host's wrapper, not by element names."""

from cuemill.llm import wrappers


def texts(spark, pages):
    df = spark.createDataFrame([(k, "http://h.example/" + str(k), x) for k, x in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in wrappers.report(df).collect()}


def test_fixed_text_inside_article_goes(spark):
    page = "<body><article><h1>head {k}</h1><div>Read us every day</div><p>text {k}</p><div>Thank you</div></article></body>"
    got = texts(spark, [page.format(k=k) for k in range(5)])
    assert got == {k: f"head {k}\ntext {k}" for k in range(5)}


def test_text_beside_article_stays(spark):
    card = "<article><a href='/'>card {k}{n}</a></article>"
    pages = ["<body><div>Site name</div><div class='x'><p>real text {k} of the page</p></div>".replace("{k}", str(k)) + "".join(card.format(k=k, n=n) for n in range(2 + k % 2)) for k in range(5)]
    got = texts(spark, pages)
    for k in range(5):
        assert f"real text {k} of the page" in got[k] and "Site name" not in got[k]


def test_few_pages_are_bounded_by_article(spark):
    page = "<body><div>Site</div><article><p>text {k}</p></article></body>"
    assert texts(spark, [page.format(k=k) for k in range(2)]) == {0: "text 0", 1: "text 1"}


def test_long_groups_and_long_optional_ones():
    """Repeated groups of over 60 tokens and optional ones of over 400."""
    group = ["div.g", *["p", "#1", "/p", "h2", "#2", "/h2"] * 12, "/div"]
    assert wrappers.folded(group * 3)[0][0] == "+" and len(wrappers.folded(group * 3)) == 1
    long = [y for k in range(200) for y in (f"p.c{k}", "#1", "/p")]
    wrapper = wrappers.infer([["div", "#a", "/div", "h6", "#b", "/h6"], ["div", "#a", "/div", *long, "h6", "#b", "/h6"]])
    assert wrappers.fixed(wrapper) == {"#a", "#b"} and wrappers.Matcher(wrapper).furniture(["div", "#a", "/div", "h6", "#b", "/h6"]) == [True, True]


def test_copies_and_empty_pages_teach_nothing(spark):
    """Of each host the copies, null and empty pages do not hide what is fixed."""
    page = "<body><div>Site name</div><div class='x'><p>text {k} of the page</p></div></body>"
    pages = [page.format(k=0)] * 40 + [page.format(k=k) for k in range(1, 5)] + [None, "", "<!-- -->"] * 5
    got = texts(spark, pages)
    assert {got[k] for k in range(40)} == {"text 0 of the page"} and all(got[40 + k] == f"text {k + 1} of the page" for k in range(4))
    assert all(got[k] == "" for k in range(44, len(pages)))


def test_wrapper_reads_all_pages_alike(spark):
    """Text that all but one of many pages share is not fixed, however pages lie."""
    page = "<body><div>Site name</div><section>{same}</section><p>text {k}</p>{more}</body>"
    rows = [(k, "http://h/", page.format(k=k, same="other" if k == 77 else "same", more="<table><tr><td>x</td></tr></table>" * (k % 3))) for k in range(90)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    one, many = ([tuple(r) for r in wrappers.wrappers(df.repartition(n)).collect()] for n in (1, 7))
    assert one == many and one[0][1] == 90
    assert {r.page_id for r in wrappers.report(df).collect() if "Site name" in r.text or ("same" in r.text) == (r.page_id == 77)} == set()


def test_altered_wrapper_alters_the_text():
    """With the tag rules out of play the wrapper decides what stays."""
    page = "<body><div>Alpha line</div><h2>Beta line</h2><p>text {k}</p></body>"
    wrapper = wrappers.infer([wrappers.blocks(page.format(k=k))[1] for k in range(4)])
    assert wrappers.extract(page.format(k=2), wrapper=wrappers.Matcher(wrapper)) == "text 2"
    for fixed in sorted(wrappers.fixed(wrapper)):
        altered = ["#" if x == fixed else x for x in wrapper]
        got = wrappers.extract(page.format(k=2), wrapper=wrappers.Matcher(altered))
        assert got in ("Alpha line\ntext 2", "Beta line\ntext 2")


def test_long_and_broken_pages(spark):
    """A page of a million characters, thousands of unclosed elements, columns of clashing names."""
    long = "<body><div>Site</div>" + "".join(f"<p>line {k}</p>" for k in range(40_000)) + "</body>"
    unclosed = "<body>" + "<div><b><i>" * 5000 + "deep text"
    rows = [(1, "http://h/1", long, "t", 5, "h"), (2, "http://g/1", unclosed, "t", 5, "h"), (3, None, "<p>no host", None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int, host string")
    got = {r.page_id: r for r in wrappers.main_text(df).collect()}
    assert got[1].text.count("\n") >= 39_999 and got[1].n_chars == len(got[1].text)
    assert got[2].text == "deep text" and got[3].text == "no host"
    assert wrappers.main_text(df.limit(0)).collect() == []


ARTICLE = "<article><h1>Head</h1><p>Real text of the page, as long as a page is.</p></article>"


def test_class_words_on_what_holds_the_page():
    want = "Head\nReal text of the page, as long as a page is."
    for begin in ("<body class='single has-sidebar'>", "<body class='nav-open'>", "<html class='menu-open'><body id='legal'>", "<body><div class='page-nav wrap'>", "<body><form id='aspnet'>", "<body><main class='widget'>"):
        assert wrappers.extract(f"{begin}<div class='menu'>Home</div>{ARTICLE}<div class='comments'><article class='comment'>{'A long comment. ' * 20}</article></div>") == want
    assert wrappers.extract("<body><article class='post category-legal tag-search'><p>Real text</p></article></body>") == "Real text"
    assert wrappers.extract("<div class='post tag-search'><p>Real text here</p></div><div class='ads'>Buy</div>") == "Real text here"
    assert wrappers.extract(f"{ARTICLE}<section class='related-posts'><article>{'Another story. ' * 20}</article></section>") == want


def test_inline_furniture_goes_where_it_stands():
    page = "<article><p>One <button>Click</button> two <label>Name</label> three <span hidden>hid</span> four <span class='advert'>Buy</span> five <span style='display: none'>x</span>six</p><p><a class='share'>Share</a></p></article>"
    assert wrappers.extract(page) == "One two three four five six"


def test_attributes_are_read_one_by_one():
    assert wrappers.extract("<article><p title='a > b' data-x=\"class='ad' hidden\">kept</p><p title=it's>own</p></article>") == "kept\nown"


def test_broken_markup_is_read_once():
    """A page of a million broken attributes, comments or declarations takes no longer than its length."""
    import time

    for unit in ("<p a='", '<p a="', "<!", "<?", "<p='>'", "<p a=", "<", "</", "<a ", "<!--", "<script>", "<p class='", "class=' ", "<span hidden>z"):
        began = time.process_time()
        wrappers.extract(unit * (1_000_000 // len(unit)))
        assert time.process_time() - began < 20, unit  # quadratic reading takes hours
    assert wrappers.extract("<p>before</p><p a='never ends <b>more</b> text>after") == "before\nmore text>after"


def test_evidence_grows_without_a_step(spark):
    """Fixed text inside the article leaves when enough pages have it, sooner where little else is fixed; beside it at once."""
    page = "<body><div>Site name and so on</div><article><h1>head {k}</h1><div>Read us every day</div>{more}</article></body>"

    def stays(n, own):
        got = texts(spark, [page.format(k=k, more="".join(f"<p>line {k} {j}</p>" for j in range(own))) for k in range(n)])
        assert not any("Site name" in t for t in got.values())
        return all("Read us" in t for t in got.values())

    assert [stays(n, 1) for n in (1, 2, 3, 4, 5)] == [True, True, True, False, False]
    assert [stays(n, 30) for n in (1, 2, 3)] == [True, False, False]
    same = "<article>" + "".join(f"<p>shared line {j}</p>" for j in range(20)) + "<p>own line {k}</p></article>"
    got = texts(spark, [same.format(k=k) for k in range(3)])
    assert all(t.count("shared line") == 20 for t in got.values())  # near copies are no furniture


def test_wrappers_keep_to_the_length_of_pages():
    """Thousands of different structures: what hardly a page has leaves the wrapper."""
    import random

    rng = random.Random(1)
    streams = [["div", "#site", "/div", *[y for _ in range(12) for c in [rng.randrange(10**6)] for y in (f"p.c{c}", f"#{c}", "/p")], "h6", "#foot", "/h6"] for _ in range(600)]
    wrapper = wrappers.infer(streams)
    assert len(wrappers.spread(wrapper, 600)) < 12 * 3 * wrappers.RARE and wrappers.fixed(wrapper) == {"#site", "#foot"}
    assert wrappers.Matcher(wrapper, 600).furniture(streams[5])[0] and not any(wrappers.Matcher(wrapper, 600).furniture(streams[5])[1:-1])
