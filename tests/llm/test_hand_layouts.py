"""Main text of pages written by hand, in layouts and with names that the training pages' generator doesn't make."""

import pytest

from weftgraph.llm import html_text

STORY = [
    "The ferry left the harbour shortly after six, with fewer passengers than the crew had expected on a public holiday.",
    "Captain Moreau said the crossing would take about four hours; the sea was calm & the forecast had not changed since the morning.",
    "By noon the first cars rolled onto the quay, where a small crowd had gathered to greet relatives from the mainland.",
    "Ticket sales have fallen for three years in a row, and the operator now plans to run the route only on weekends.",
]
MORE = [
    "To prepare the dough, mix the flour with the water and let it rest for an hour under a damp cloth.",
    "Knead it until it no longer sticks to the table, then cut it into eight pieces of about the same size.",
    "Bake the loaves in a very hot oven for twenty minutes, and let them cool on a rack before you slice them.",
]
p = "".join


def paragraphs(texts, tag="p", attrs=""):
    return p(f"<{tag}{attrs}>{t.replace('&', '&amp;')}</{tag}>" for t in texts)


PAGES = {
    "tables": (
        f"<html><body><table width=100%><tr><td colspan=2><a href=/>Start</a> | <a href=/n>News</a> | <a href=/s>Sport</a></td></tr><tr><td width=160><a href=/1>Weather</a><br><a href=/2>Traffic</a><br><a href=/3>Archive</a></td><td>{paragraphs(STORY)}</td></tr></table></body></html>",
        STORY,
    ),
    "sections": (
        f"<body><div id='masthead'><a href='/'>Island Courier</a></div><main><section class='story-body'><h1>Fewer ferries</h1>{paragraphs(STORY)}</section><section class='discussion'><h2>12 replies</h2><div class='reply'><b>anna77</b> <p>I took that boat last year, never again!</p></div></section></main><footer>&copy; Island Courier. <a href=/p>Privacy</a> <a href=/t>Terms</a></footer></body>",
        ["Fewer ferries", *STORY],
    ),
    "divs": (
        f"<body><div class='topbar'><ul><li><a href='a'>Recipes</a><li><a href='b'>Techniques</a><li><a href='c'>Shop</a></ul></div><div class='wrap'><div class='entry'>{paragraphs(MORE, 'div')}</div><div class='widget'>Sign up for our letter <form><input name=m><button>Join</button></form></div></div></body>",
        MORE,
    ),
    "cookie": (
        f"<body><div class='consent-banner'>We use cookies to improve your visit. <button>Accept</button></div><header><nav><a href=1>Home</a><a href=2>About</a></nav></header><article><h2>Bread at home</h2>{paragraphs(MORE)}</article><aside><h3>Related</h3><ul><li><a href=3>Ten soups</a></li><li><a href=4>Better butter</a></li></ul></aside></body>",
        ["Bread at home", *MORE],
    ),
    "markup": (
        f"<body><article>{paragraphs(STORY[:2])}<script>if (a < b) track('<p>x</p>')</script><style>p {{ color: red }}</style><!-- <p>old text</p> --><p>{MORE[0]} <em>{MORE[1]}</em></p><div class='advertisement'>Buy two, get one free</div>{paragraphs(STORY[2:])}</article></body>",
        [*STORY[:2], f"{MORE[0]} {MORE[1]}", *STORY[2:]],
    ),
}


@pytest.fixture(scope="module")
def model():
    return html_text.train()


def scores(model):
    """(words of the article found, words found that are not of it) over all pages."""
    lost = more = total = 0
    for html, want in PAGES.values():
        got = model.extract(html).split("\n\n")
        total += sum(len(w.split()) for w in want)
        lost += sum(len(w.split()) for w in want if w not in got)
        more += sum(len(g.split()) for g in got if g not in want)
    return lost, more, total


def test_hand_written_layouts(model):
    lost, more, total = scores(model)
    assert lost <= 0.02 * total and more <= 0.05 * total, (lost, more, total)


@pytest.mark.parametrize("name", PAGES)
def test_article_paragraphs(model, name):
    html, want = PAGES[name]
    got = model.extract(html).split("\n\n")
    assert [w for w in want if len(w.split()) > 5 and w not in got] == []
