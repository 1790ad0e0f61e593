import random
import re
import time

import pytest
import zstandard

from tradewind.llm import decontamination, extraction, language, linededup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _brute_lines(rows, least=linededup.MIN_WORDS):
    """Deletes each line that lies in a run of least words which starts earlier too: all pairs of starts are compared."""
    docs = [[(p, x) for p, x in enumerate(t.split("\n")) if WORD.search(x)] for _, t in rows]
    starts = [(n, i) for n, lines in enumerate(docs) for i in range(len(lines))]
    gone = set()
    for at, (n, i) in enumerate(starts):
        for m, j in starts[:at]:
            run = 0
            while i + run < len(docs[n]) and j + run < len(docs[m]) and docs[n][i + run][1] == docs[m][j + run][1]:
                run += 1
            if sum(len(WORD.findall(x)) for _, x in docs[n][i : i + run]) >= least:
                gone |= {(n, p) for p, _ in docs[n][i : i + run]}
    return {d: "\n".join(x for p, x in enumerate(t.split("\n")) if (n, p) not in gone) for n, (d, t) in enumerate(rows)}


def test_line_dedup_matches_brute_force(spark, make_docs):
    r = random.Random(9)
    pool = [f"line {k} " + "w " * r.randint(0, 4) for k in range(12)] + ["", " ", "one two three four five six seven eight nine"]
    rows = [(k, "\n".join(r.choice(pool) for _ in range(r.randint(1, 14)))) for k in range(60)]
    rows.append((60, rows[3][1]))
    rows.append((61, "\n".join(["again and again and again"] * 9)))
    rows += [(62, "a b c\nd e f\nx"), (63, "a b c\nd e f\ng h i"), (64, "start\na b c\n\nd e f\n \ng h i\nend"), (65, "g h i\na b c\nd e f")]
    got = {x["doc_id"]: x for x in linededup.dedup_lines(make_docs(rows)).collect()}
    want = _brute_lines(rows)
    assert want[64] == "start\n\n \nend" and want[65] == rows[-1][1]
    assert {d: x["text"] for d, x in got.items()} == want
    for d, t in rows:
        kept = len(want[d].split("\n")) if want[d] or got[d]["n_removed"] < got[d]["n_lines"] else 0
        assert got[d]["n_lines"] == len(t.split("\n")) and got[d]["n_removed"] == got[d]["n_lines"] - kept


def test_line_dedup_edges(spark, make_docs):
    passage = " ".join(f"word{k}" for k in range(60))
    rows = [(None, passage), (1, f"start\n{passage}\nend"), (2, None), (3, ""), (4, f"x\n{passage}"), (4, f"x\n{passage}")]
    got = sorted(((x["doc_id"], x["text"], x["n_removed"]) for x in linededup.dedup_lines(make_docs(rows)).collect()), key=repr)
    assert got == sorted([(None, passage, 0), (1, "start\nend", 1), (2, None, 0), (3, "", 0), (4, "x", 1), (4, "x", 1)], key=repr)
    assert linededup.dedup_lines(make_docs([])).count() == 0
    clash = make_docs([(1, passage, None, None, None, 7, "x")], ", n_removed bigint, rank string")
    assert [(r["n_removed"], r["n_lines"], r["rank"]) for r in linededup.dedup_lines(clash).collect()] == [(0, 1, "x")]
    for least, want in ((1, {1: "a b\nc", 2: "", 3: "d"}), (3, {1: "a b\nc", 2: "", 3: "d\na b"}), (4, {1: "a b\nc", 2: "a b\nc", 3: "d\na b"})):
        got = linededup.dedup_lines(make_docs([(1, "a b\nc"), (2, "a b\nc"), (3, "d\na b")]), least).collect()
        assert {r["doc_id"]: r["text"] for r in got} == want


def test_line_dedup_of_long_common_runs(spark, make_docs):
    r = random.Random(3)
    lines = [f"w{k} and {' '.join('v' * r.randint(1, 3) for _ in range(r.randint(0, 5)))}".strip() for k in range(200)]
    rows = [(k, "\n".join(lines[a : a + r.randint(1, 90)] + [f"own {k}"] + lines[b : b + 5])) for k in range(40) for a, b in [(r.randint(0, 190), r.randint(0, 190))]]
    got = {x["doc_id"]: x["text"] for x in linededup.dedup_lines(make_docs(rows)).collect()}
    assert got == _brute_lines(rows)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{x}}</style><script>var a="</p><p>no</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice"><p>We use cookies on this site, a lot of them indeed.</p></div>
<div class="ad">Buy this now</div><div id="main"><{box} class="post p{n}"><h1>Title {n} &amp; more</h1><p>First&nbsp;paragraph   of
page {n}, with <a href="x">a link</a> in it.<p>Second <b>one</b>, 1 &lt; 2.<br>After a break.<ul><li>Item one<li>Item two</ul><form><input value="v"><label>Name</label></form></{box}>
<div class="comments"><article class="comment"><p>Reader comment that is long enough to matter here, really it is very long.</p></article></div></div>
<aside><p>Sidebar text</p></aside><footer>Foot &copy;</footer></body></html>"""
TEXT = "Title {n} & more\nFirst paragraph of page {n}, with a link in it.\nSecond one, 1 < 2. After a break.\nItem one\nItem two"


def test_main_text(spark):
    rows = [(n, f"http://h{n % 2}.org/{n}", PAGE.format(n=n, box=("article", "div")[n % 2]), "clash") for n in range(8)]
    rows += [(100, None, None, ""), (101, "bad", "", ""), (102, "http://x.y/", "plain text, no tags", ""), (103, "http://x.y/", "<p>a<script>b</p>", ""), (0, rows[0][1], rows[0][2], "")]
    got = extraction.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()
    want = {n: TEXT.format(n=n) for n in range(8)} | {100: "", 101: "", 102: "plain text, no tags", 103: "a"}
    assert len(got) == len(rows)
    for r in got:
        assert r["text"] == want[r["page_id"]] and r["n_chars"] == len(r["text"])


def test_extraction_follows_the_host(spark):
    body = "".join(f"<p>Sentence {k} of the story goes on for a while.</p>" for k in range(6))
    usual = "<html><body><div class='story{0}'>" + body + "</div><div class='links'><p>x</p></div></body></html>"
    odd = "<html><body><div class='story9'><p>Short.</p></div><div class='links'>" + body * 2 + "</div></body></html>"
    rows = [(n, "http://h/x", usual.format(n)) for n in range(5)] + [(9, "http://h/y", odd)]
    got = {r["page_id"]: r["text"] for r in extraction.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[9] == "Short."


def test_words_of_layout_in_articles():
    page = "<body><div class='header'>Site</div><article class='post with-sidebar'><div class='entry-header'><h1>Title</h1></div><p>Text.</p><div class='share'>Share</div></article></body>"
    assert extraction.Page(page).extract([]) == "Title\nText."


def test_wrappers_with_layout_words_stay():
    for head in ("div id='page' class='has-sidebar'", "div class='content no-sidebar'", "div class='header-fixed'", "div class='elementor-widget-container'", "form action='x.aspx'"):
        tag = head.split()[0]
        page = f"<body><div class='menu'><a href='/'>Home</a></div><{head}><div class='story'><p>The first paragraph of the story.</p><p>The second one of it.</p></div><div class='sidebar'><p>Other things.</p></div></{tag}><div class='cookie-notice'><p>Cookies.</p></div></body>"
        assert extraction.Page(page).extract([]) == "The first paragraph of the story.\nThe second one of it.", head
    talk = "<body><div class='story'><h1>Title</h1><p>Short.</p></div><div class='comments'><p>" + "A comment. " * 30 + "</p></div></body>"
    assert extraction.Page(talk).extract([]) == "Title\nShort."
    assert extraction.Page("<body><div class='comments-open'><p>Text of the page.</p></div></body>").extract([]) == "Text of the page."


def test_text_before_an_inline_part_stays():
    page = "<body><div class='story'>Text before <span class='share'>Share <div>this</div></span> and after.</div></body>"
    assert extraction.Page(page).extract([]) == "Text before\nand after."


def test_classes_that_say_something_about_other_parts():
    for name in ("content with-sidebar", "no-ads", "post comments-open", "widget-content", "entry has-share no-comments"):
        page = f"<body><div class='top'>Name of the site</div><div class='{name}'><p>The first paragraph of the story.</p><p>The second one.</p></div><footer>Foot</footer></body>"
        assert extraction.Page(page).extract([]) == "The first paragraph of the story.\nThe second one.", name


def test_malformed_markup_is_read():
    for bad in ("<![foo bar]]>", "<![ ", "<![if IE]>", "<![CDATA[x]]>", "<!doctype", "<!-- open", "</ >", "<a <b>", "&#xFFFFFFFF;", "<p", "<!", "</", "<div class='x", "\x00"):
        text = extraction.Page(f"<body><article><p>Before.</p></article>{bad}").extract([])
        assert text.startswith("Before."), bad
        extraction.Page(f"{bad}<article><p>After.</p></article>").extract([])
    r = random.Random(4)
    bits = ["<", ">", "<p>", "</p>", "<div class='a b1'>", "</div>", "<!", "[", "]]>", "--", "<a href='x'>", "</a>", "text ", "&amp", ";", "<li>", "<td>", "</table>", "<form>", "</form>", "'", '"', "<h1>", "<script>", "</script>", "<article>"]
    for _ in range(2000):
        page = extraction.Page("".join(r.choice(bits) for _ in range(r.randint(1, 60))))
        assert isinstance(page.extract([page.path(page.best())]), str)


def test_unclosed_and_deep_markup_takes_linear_time():
    n = 30_000
    for page in ("<p>" + "<b>" * n + "</i>" * n + "Text.", "<i><div>" + "<b>" * n + "</i>" * n + "Text.", "<div class='x y'>" * n + "Text.", "<h1><div class='menu'>" * n + "Text.", "<p>Text.</p>" * n, "<div><p>Text.</p>" * n):
        began = time.process_time()
        got = extraction.Page(page)
        assert "Text." in got.extract([got.path(got.best())]) or "menu" in page
        assert time.process_time() - began < 8


ALPHABET = "abcdefghijklmnop"


def _known_page(r, k):
    """A page in one of several themes, with its article's blocks."""
    sentence = lambda: " ".join("".join(r.choice(ALPHABET) for _ in range(r.randint(2, 8))) for _ in range(r.randint(6, 30))) + "."
    title, paragraphs = sentence(), [sentence() for _ in range(r.randint(2, 7))]
    menu = "".join(f"<li><a href='/{n}'>{sentence()[:9]}</a></li>" for n in range(6))
    box, close = [("<article>", "</article>"), ("<div class='post comments-open'>", "</div>"), ("<div id='content' class='no-sidebar'>", "</div>"), ("<main><div class='entry entry-12'>", "</div></main>"), ("<section class='story'>", "</section>")][k % 5]
    body = "".join(f"<p>{p}" + ("</p>" if r.random() < 0.8 else "") for p in paragraphs)
    other = [f"<nav><ul>{menu}</ul></nav>", f"<div class='ad'>{sentence()}</div>", f"<div class='cookie-notice'><p>{sentence()}</p></div>", f"<aside><p>{sentence()}</p></aside>", f"<form><p>{sentence()}</p></form>", f"<div class='sidebar widget'><ul>{menu}</ul></div>"]
    r.shuffle(other)
    comments = f"<div class='comments'><p>{sentence()}</p></div>" if r.random() < 0.5 else ""
    html = f"<!DOCTYPE html><html><head><title>{title}</title><script>x='</p>'</script></head><body>{''.join(other[:3])}{box}<h1>{title}</h1>{body}{close}{''.join(other[3:])}{comments}<footer>{sentence()}</footer></body></html>"
    return html, "\n".join([title, *paragraphs])


def test_articles_of_generated_pages(spark):
    r = random.Random(12)
    pages = [(k, f"http://host{k % 5}.org/{k}", *_known_page(r, k)) for k in range(200)]
    got = {x["page_id"]: x["text"] for x in extraction.extract_pages(spark.createDataFrame([p[:3] for p in pages], "page_id bigint, url string, html string")).collect()}
    assert [k for k, _, _, want in pages if got[k] != want] == []


def test_extraction_of_no_pages(spark):
    assert extraction.extract_pages(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def _corpus(n, seed=10):
    r = random.Random(seed)
    own = {lang: ["".join(r.choice(a) for _ in range(r.randint(2, 7))) for _ in range(80)] for lang, a in {"aa": "abcdefgh", "bb": "ijklmnop", "cc": "qrstuvwx"}.items()}
    return [(k, " ".join(r.choice(own[lang]) for _ in range(r.randint(8, 60))), lang) for k in range(n) for lang in [("aa", "bb", "cc")[k % 3]]]


def test_language_on_held_out_texts(spark, make_docs):
    rows = _corpus(300)
    extra = [(1000, None, "aa"), (1001, "12 !!", "aa"), (None, rows[0][1], "bb"), (1002, rows[1][1].upper() * 200, None)]
    got = {r["doc_id"]: r for r in language.identify(make_docs(rows + extra)).collect()}
    assert len(got) == len(rows) + len(extra)
    held = [(lang, got[k]) for k, _, lang in rows if got[k]["held_out"]]
    assert len(held) > 60 and sum(r["lang_pred"] == lang for lang, r in held) / len(held) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert got[1000]["lang_pred"] == got[1001]["lang_pred"] == "und" and got[1002]["lang_pred"] == "bb" and got[None]["lang_pred"] == "aa"


def test_language_equals_a_plain_loop_and_collects_bounded_rows(spark, make_docs):
    rows = _corpus(120, 5) + [(500, f"text {k} abc abd", "aa") for k in range(400)] + [(501, "same", "bb")] * 50
    docs = make_docs(rows)
    learned = language.dictionaries(docs)
    assert all(raw.count(b"\n") < language.DOCS for raw in learned.values())
    got = {(r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in language.identify(docs).collect()}
    want = set()
    for k, text, _ in rows:
        raw, sizes = text.lower().encode(), []
        for lang, known in learned.items():
            pack = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
            sizes.append((sum(len(pack.compress(raw[a : a + language.PIECE])) for a in range(0, len(raw), language.PIECE)), lang))
        sizes.sort()
        want.add((k, sizes[0][1], round(1 - sizes[0][0] / sizes[1][0], 9)))
    assert {x[:2] for x in got} == {x[:2] for x in want} and len(got ^ want) <= len(want) // 20


def test_language_without_rows_or_labels(spark, make_docs):
    assert language.identify(make_docs([])).count() == 0
    assert [r["lang_pred"] for r in language.identify(make_docs([(1, "some text")])).collect()] == ["und"]


ITEM = "A train travels 120 km in 3 hours from the city of Paris to the coast, how long would 240 km take at the same speed?"


def _leaks(spark, make_docs, texts, items, limit=1 << 20):
    docs = make_docs(list(enumerate(texts)))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    return {(r["doc_id"], r["item_id"]): r["changed"] for r in decontamination.find_leaks(docs, bench, limit).collect()}


def test_leaks_and_changed_parameters(spark, make_docs):
    changed = ITEM.replace("120", "90").replace("3 hours", "2 hours").replace("240", "180").replace("Paris", "London")
    mixed = "A train travels 120 km in 3 hours from the city of Paris to the coast, how long would 120 km take at the same speed?"
    filler = " ".join(f"filler{k}" for k in range(300))
    texts = [f"{filler}. {ITEM} {filler}", changed, filler, None, "", ITEM.upper(), ITEM + " " + ITEM, mixed, "Only a train travels"]
    items = [ITEM, None, "", "too short", "seven words are here in this item"]
    for limit in (1 << 20, 0):
        got = _leaks(spark, make_docs, texts, items, limit)
        assert {k: v for k, v in got.items() if k[0] != 7} == {(0, 0): False, (1, 0): True, (5, 0): got.get((5, 0)), (6, 0): False}
    assert _leaks(spark, make_docs, ["seven words are here in this item"], items) == {(0, 4): False}


def test_inconsistent_values_are_no_leak(spark, make_docs):
    item = "give 5 apples and 5 pears and 5 plums to each of the children now"
    assert _leaks(spark, make_docs, [item.replace("5", "7"), item.replace("5", "7", 1).replace("5", "8", 1)], [item]) == {(0, 0): True}


SHOP = "A shop buys 12 apples on Monday and sells some of them to a farmer who brings back 12 pears on the next day, how many pieces of fruit are left?"


def test_copies_with_an_altered_value(spark, make_docs):
    mixed = ITEM.replace("240", "120")
    altered = SHOP.replace("12 pears", "15 pears")
    both = altered.replace("12 apples", "7 apples")
    merged = altered.replace("15", "12")
    texts = [altered, both, mixed, merged, "Once, " + both]
    assert _leaks(spark, make_docs, texts, [SHOP, ITEM]) == {(0, 0): True, (1, 0): True, (2, 1): True, (3, 0): False, (4, 0): True}
    assert _leaks(spark, make_docs, [merged], [altered]) == {(0, 0): True}


def test_copies_of_items_with_few_plain_words(spark, make_docs):
    table = "Alice 12 Bob 15 Carol 18 Dave 21 Erin 24 Frank 27 Grace 30 Heidi 33 Ivan 36 Judy 39 Karl 42 and the rest of them have none"
    names = "In Vienna Anna met Karl Maria Otto and then went to Paris with Hans"
    short = "What is the capital of France?"
    texts = [table, names.lower(), f"Q: {short}", f'He said "{short}"', "the capital of france is what is known"]
    for limit in (1 << 20, 0):
        assert _leaks(spark, make_docs, texts, [table, names, short], limit) == {(0, 0): False, (1, 1): False, (2, 2): False, (3, 2): False}
    assert _leaks(spark, make_docs, ["Alice 12 Bob 15 Carol 18 Dave 21 Erin"], ["Alice 12 Bob 15 Carol 18 Dave 21 Erin"]) == {(0, 0): False}
    long, filler = " ".join(f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)), " ".join(f"other{k}" for k in range(50))
    passage = lambda n: f"{filler} {' '.join(long.split()[100 : 100 + n])} {filler}"
    assert _leaks(spark, make_docs, [passage(13), passage(12)], [long]) == {(0, 0): False}


def test_items_below_five_words_as_sentences(spark, make_docs):
    texts = ["He said. What is 2+2? Then he left.", "what is 2+2", "this is what is 2+2 and more", "Yes", "yes and no"]
    for limit in (1 << 20, 0):
        assert _leaks(spark, make_docs, texts, ["What is 2+2?", "Yes"], limit) == {(0, 0): False, (1, 0): False, (3, 1): False}


def test_what_stands_before_a_copy(spark, make_docs):
    item = "Anna has 3 apples and 5 pears in her bag."
    texts = ["I ask: Anna has 3 apples and 5 pears in her bag.", "so Bert has 4 apples and 9 pears in her bag", "Bert has 4 apples and 9 pears in her bag."]
    assert _leaks(spark, make_docs, texts, [item]) == {(0, 0): False, (1, 0): True, (2, 0): True}
    question = "What is the capital of France?"
    assert _leaks(spark, make_docs, ["I ask: What is the capital of Spain?", "Paris is the capital of France."], [question]) == {(0, 0): True}


def test_recall_of_copies_and_new_parameters(spark, make_docs):
    r = random.Random(21)
    pool = ["".join(r.choice("bcdfghklmnprst") + r.choice("aeiou") for _ in range(r.randint(2, 4))) for _ in range(400)]
    names, others, units = ["Anna", "Boris", "Clara", "Dmitri"], ["Emil", "Fatima", "Gerda", "Hugo"], ["km", "hours", "dollars"]

    def item(n):
        words = [r.choice(names) if x < 0.1 else f"{r.randint(1, 99)} {r.choice(units)}" if x < 0.2 else str(r.randint(100, 999)) if x < 0.25 else r.choice(pool) for x in (r.random() for _ in range(n))]
        return words[0].capitalize() + "".join((". " + w.capitalize() if r.random() < 0.05 else " " + w) for w in words[1:]) + "."

    items = [item(r.randint(1, 40)) for _ in range(150)]
    filler = lambda: " ".join(r.choice(pool) for _ in range(r.randint(5, 60))) + r.choice([". ", ": ", "\n"])
    change = {**dict(zip(names, others, strict=True)), **{str(k): str(1000 + k * 7) for k in range(1000)}}
    changed = [re.sub(r"[A-Z][a-z]+|\d+", lambda m: change.get(m[0], m[0]), x) for x in items]
    copies = [filler() + x + " " + filler() for x in items]
    lower = [filler() + x.lower() for x in items]
    anew = [filler() + x + " " + filler() for x in changed]
    clean = [filler() * 3 for _ in range(150)]
    got = _leaks(spark, make_docs, copies + lower + anew + clean, items)
    n = len(items)
    whole = [k for k, x in enumerate(items) if len(decontamination.TOKEN.findall(x)) > decontamination.LEAST + 1]
    plain = lambda x: sum(w in pool or w.lower() in pool for w in re.findall(r"\w+", x))
    searched = [k for k in whole if plain(items[k]) >= max(4, 0.6 * len(items[k].split()))]
    found = lambda at, of: sum((at * n + k, k) in got for k in of) / len(of)
    assert len(searched) > 60 and found(0, whole) == 1 and found(1, whole) >= 0.99 and found(2, searched) >= 0.99
    assert not [d for d, _ in got if d >= 3 * n and not any(w in (copies + lower + anew + clean)[d] for w in (x[:-1].lower() for x in items if len(x.split()) < 5))]


def test_drop_leaks(spark, make_docs):
    docs = make_docs([(1, ITEM), (None, ITEM), (2, "clean text of some words"), (3, None)])
    bench = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    out = decontamination.drop_leaks(docs, bench)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [2, 3]
    assert decontamination.drop_leaks(make_docs([]), bench).count() == 0
    assert decontamination.drop_leaks(docs, bench.where("false")).count() == 4


def _text_of(html):
    return extraction.Page(html).extract([])


STORY = "<p>" + "The main story goes on and on with words. " * 6 + "</p>"


@pytest.mark.parametrize(("html", "there", "gone"), [
    (f'<article><h1>T</h1>{STORY}<h2 id="related-work">Related work</h2><p>x</p><h3 id="warning-signs">Warning signs</h3><h2 class="banner">Banner</h2></article>', ["Related work", "Warning signs", "Banner"], []),
    (f'<article><h1>T</h1>{STORY}<section id="related-work"><h2>Heading</h2><p>Part of the article.</p></section></article>', ["Heading", "Part of the article."], []),
    (f'<article><h1>T</h1>{STORY}<p class="social-science">Social.</p><p id="notice-board">Board.</p><p class="byline">By me</p></article>', ["Social.", "Board."], ["By me"]),
    ('<div class="content"><h1>T</h1><p>Short article.</p></div><div class="sidebar-right"><p>' + "Side words. " * 40 + "</p></div>", ["Short article."], ["Side"]),
    ('<div class="content"><h1>T</h1><p>Short article.</p></div><div class="widget-area"><p>' + "Side words. " * 40 + "</p></div>", ["Short article."], ["Side"]),
    (f'<div class="page-with-sidebar"><div><h1>T</h1>{STORY}</div></div><div>Other words here</div>', ["The main story"], []),
    (f'<article><h1>T</h1>{STORY}<section class="related-articles"><ul><li><a href="1">Another story to read</a></li></ul></section><section class="comments-area"><p>A reader says so.</p></section><div id="comments-list"><p>Another reader.</p></div></article>', ["The main story"], ["Another", "reader"]),
    (f'<article><h1>T</h1>{STORY}<div id="related-work"><p>Work in a part.</p></div></article><div id="cookie-consent"><p>We use cookies.</p></div>', ["Work in a part."], ["cookies"]),
])
def test_names_weigh_and_don_t_drop(html, there, gone):
    text = _text_of(f"<html><body>{html}</body></html>")
    assert all(x in text for x in there) and not any(x in text for x in gone), text


@pytest.mark.parametrize("piece", ["<a ", "<!-- ", "</a ", "<?x ", "<![x ", '<a x="', "<script>", "<", "<!-", "<title>", "&am"])
def test_unclosed_pieces_of_a_megabyte(piece):
    began = time.time()
    for end in ("", ">", "<p>end</p>"):
        extraction.Page("<p>start</p>" + piece * (1_000_000 // len(piece)) + end).extract([])
    assert time.time() - began < 15


def test_generated_pages_with_anchors_and_sidebars():
    r, kept, had, got = random.Random(11), 0, 0, 0
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    words = lambda n: [word() for _ in range(n)]
    names = ["related-work", "warning-signs", "social-science", "search-methods", "header-files", "promotion-rules", "menu-design"]
    for _ in range(120):
        parts, want = [], []
        for _ in range(r.randint(2, 6)):
            head, body = words(2), words(r.randint(8, 60))
            name = r.choice(names)
            parts.append(r.choice([f'<h2 id="{name}">{{}}</h2><p>{{}}</p>', f'<section id="{name}"><h2>{{}}</h2><p>{{}}</p></section>', f'<h3>{{}}</h3><p class="{name}">{{}}</p>']).format(" ".join(head), " ".join(body)))
            want += head + body
        title, side = words(3), words(r.randint(5, 400))
        article = r.choice(["<article><h1>{}</h1>{}</article>", '<div class="content"><h1>{}</h1>{}</div>', '<main class="no-sidebar"><h1>{}</h1>{}</main>']).format(" ".join(title), "".join(parts))
        bar = f'<div class="{r.choice(["sidebar-right", "widget-area", "left_sidebar", "sidebar"])}"><p>{" ".join(side)}</p></div>'
        html = f'<html><body><nav><a href="/">{word()}</a></nav>{r.choice([article + bar, bar + article])}<footer>{word()}</footer></body></html>'
        text = set(_text_of(html).split())
        kept += len(text & {*title, *want})
        had += len({*title, *want})
        got += len(text)
    print("recall of words", kept / had, "precision", kept / got)
    assert kept >= 0.99 * had and kept >= 0.99 * got


def test_contradicting_values_count_nowhere(spark, make_docs):
    item = "The bus leaves the town at 9 and travels 60 km per hour for 3 hours until it comes to the harbour"
    change = lambda *v: item.replace("9", v[0]).replace("60", v[1]).replace("3 hours", f"{v[2]} hours")
    texts = [change("8", "50", "4"), change("7", "60", "7"), change("7", "7", "7"), change("9", "60", "5"), change("11", "45", "6")]
    got = _leaks(spark, make_docs, texts, [item])
    assert got == {(0, 0): True, (3, 0): True, (4, 0): True}


def test_names_in_capitals_and_short_items(spark, make_docs):
    items = ["IBM has 31 apples and gives 8 of them to NASA at the end of the long day in spring", "Capital of Peru?", "Lima"]
    texts = ["SAP has 45 apples and gives 9 of them to ESA at the end of the long day in spring", "we ask: capital of peru? It is there", "the capital of Peru is Lima, as all know", "he said (Capital of Peru), then left", "Lima. Yes"]
    for limit in (1 << 20, 0):
        assert _leaks(spark, make_docs, texts, items, limit) == {(0, 0): True, (1, 1): False, (3, 1): False, (4, 2): False}
