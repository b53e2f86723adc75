"""Main text of made layouts whose article is known, and of broken and deep markup."""

import random
import time

import pytest

from corpusprep.llm.html_text import main_blocks

RNG = random.Random(3)
WORDS = "river stone early market letter winter garden signal bridge copper window forest little answer morning".split()


def _sentence(n=14):
    words = [RNG.choice(WORDS) for _ in range(n)]
    return f"{' '.join(words[:5]).capitalize()}, {' '.join(words[5:])}."


ARTICLE = ["A title of the page", _sentence(8), *[_sentence(30) for _ in range(6)], "A part", *[_sentence(25) for _ in range(3)], "Last words."]
TITLE, LEAD, BODY, PART, MORE, LAST = ARTICLE[0], ARTICLE[1], ARTICLE[2:8], ARTICLE[8], ARTICLE[9:12], ARTICLE[12]
p = lambda texts: "".join(f"<p>{t}</p>" for t in texts)
HEAD = f"<h1>{TITLE}</h1><p>{LEAD}</p>"
REST = f"<h2>{PART}</h2>{p(MORE)}<p>{LAST}</p>"
NESTED = {
    "flat": f"{HEAD}{p(BODY)}{REST}",
    "story beside": f"{HEAD}<div class='story'>{p(BODY)}</div>{REST}",
    "sections": f"<section>{HEAD}{p(BODY)}</section><section>{REST}</section>",
    "unclosed paragraphs": f"<h1>{TITLE}</h1><p>{LEAD}" + "".join(f"<p>{t}" for t in BODY) + f"<h2>{PART}</h2>" + "".join(f"<p>{t}" for t in [*MORE, LAST]),
    "inner links": f"{HEAD}{p(t.replace('river', '<a href=/r>river</a>') for t in BODY)}{REST}",
}
AROUND = {
    "article": "<article>{}</article>",
    "main": "<main>{}</main>",
    "div": "<div class='page'><div id='content'>{}</div></div>",
    "article in main": "<main><article>{}</article></main>",
}
LINKS = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in WORDS[:8])
BEFORE = f"<header><p>Site of the day</p></header><nav><ul>{LINKS}</ul></nav><div class='cookie-notice'>We use cookies, as you know. Accept them all.</div>"
AFTER = f"<div class='comments'>{p(_sentence(20) for _ in range(3))}</div><aside><p>{_sentence(20)}</p></aside><form><p>Your mail</p></form><footer>&copy; Someone</footer>"


@pytest.mark.parametrize("around", AROUND)
@pytest.mark.parametrize("nested", NESTED)
def test_the_whole_article_and_nothing_else(nested, around):
    page = f"<html><head><title>T</title></head><body>{BEFORE}{AROUND[around].format(NESTED[nested])}{AFTER}</body></html>"
    assert main_blocks(page) == ARTICLE


def test_quotes_and_marks_inside_of_blocks():
    assert main_blocks('<p>before <a href="x"">kept words</a> after') == ["before kept words after"]
    assert main_blocks('<p>before <a href="x>kept words</a> after</p><p>next</p>') == ["before kept words after", "next"]
    assert main_blocks("<p title='a > b'>one</p><p title=a'b>two</p>") == ["one", "two"]
    assert main_blocks("<p>a hel<span hidden>x</span>lo <span hidden>y</span> world</p>") == ["a hello world"]
    assert main_blocks("<p>1 < 2 and 3 > 2 <!-- c > --> end<br>x") == ["1 < 2 and 3 > 2 end x"]
    assert main_blocks("<title>open<body><p>text") == ["text"]
    assert main_blocks("<head><title>open</head><body><p>text") == ["text"]
    assert main_blocks("<script>if (a < b) '</p>'</script><p>text") == ["text"]


def test_equal_blocks_stay_each():
    assert main_blocks(f"<article>{p([LEAD, LEAD, *BODY, LEAD])}</article>") == [LEAD, LEAD, *BODY, LEAD]


@pytest.mark.parametrize(
    "unit", ["<div>", "<div class=ad>", "<a b='", "<a b='>c' ", '<p a="x"">t ', "<b>", "<p></i>", "<title>", "<!--", "<", "<svg>", "<li><div>", "</div>", "word "]
)
def test_time_is_linear_in_broken_and_deep_markup(unit):
    def seconds(n):
        at = time.process_time()
        main_blocks(unit * n + "x")
        return time.process_time() - at

    seconds(1000)
    assert seconds(80_000) < 8 * seconds(20_000) + 1  # quadratic time takes 16 times as long
