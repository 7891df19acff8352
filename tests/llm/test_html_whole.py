"""Main text behind omitted end tags, deep stacks, unclosed hidden elements and other languages."""

import time

from panelwise.llm.html import main_text

TEXT = "It is the first of the paragraphs and it is the one that is here for the test of it, and of all the others that are to come."
ARTICLE = f"<article><p>{TEXT}</p></article>"


def test_omitted_end_tags_in_an_aside():
    cells = "".join("<tr><td>a<td><b>b" for _ in range(150))
    terms = "".join("<dt>a<dd><i>b" for _ in range(300))
    for inner in (f"<table>{cells}</table>", f"<dl>{terms}</dl>", "<b>x" * 500, f"<table>{cells}", f"<dl>{terms}"):
        for tag in ("nav", "aside", "form"):
            assert main_text(f"<body><{tag}>{inner}</{tag}>{ARTICLE}</body>") == TEXT
        assert main_text(f"<body><div class=sidebar>{inner}</div>{ARTICLE}</body>") == TEXT
    assert main_text(f"<body><article><p>{TEXT}" + "<b>" * 300 + f"</article><p>{TEXT} Outside.</p></body>") == TEXT


def test_items_and_paragraphs_end_where_the_next_begins():
    assert main_text(f"<div><p class=share>tell all<div>{TEXT}</div></div>") == TEXT
    assert main_text(f"<div><ul><li class=promo><p>buy<li><p>{TEXT}</ul></div>") == TEXT
    assert main_text(f"<table><tr><td class=menu><table><tr><td>x</table><td>{TEXT}</table>") == TEXT


def test_hidden_elements_without_an_end_tag():
    for hidden in ("<datalist><option value=a><option value=b></datalist>", "<div><button>press</div>", "<p><canvas></p>", "<svg viewBox='0 0 1 1'/>", "<iframe src='x' />", "<div><object><div>in</div></div>", "<div><svg><g><path d=x></g></div>"):
        assert main_text(f"<body>{hidden}{ARTICLE}</body>") == TEXT, hidden


def test_a_language_without_known_stop_words():
    text = "Příliš žluťoučký kůň úpěl ďábelské ódy " * 8
    assert main_text(f"<body><div><p>{text}</p></div><div><a href=x>odkaz</a></div></body>") == text.strip()


def test_many_unclosed_elements_take_time_in_proportion():
    begin = time.time()
    main_text("<div><b><p>x<li>y</i>" * 20_000 + "<button>" * 2000)
    assert time.time() - begin < 20


def test_dense_text_outside_an_article_element_is_text():
    told = "The people of the town were told that the river would rise again in the night and that they should leave their houses. "
    story = [told * 3 + f"This was part {k} of it." for k in range(6)]
    page = "<body><div class=nav><a href=x>Home</a> <a href=y>News</a></div><article class=card><p>A short teaser of the story.</p></article><div>" + "".join(f"<p>{p}</p>" for p in story) + "<p>Share</p></div><footer>All of it is ours.</footer></body>"
    assert main_text(page).split("\n")[1:7] == story and "Home" not in main_text(page) and "ours" not in main_text(page)
    thin = "<body><article><p>" + told * 4 + "</p></article><div><p>Read more</p><p>Seen 12 times</p></div></body>"
    assert main_text(thin) == (told * 4).strip()
