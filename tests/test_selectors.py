"""Selectors: combinators, pseudo-classes, what is refused, and that width and depth cost in proportion."""

import time

import pytest

from weftlake.functions import dom

PAGE = dom.parse("""<html><body><div id=a class="x y"><p>1</p><p class=k>2</p><span>3</span><p>4</p></div><div id=b><ul><li>5</li><li class=k>6</li><li>7</li><li>8</li></ul><p data-z="a b">9</p><i></i></div>
<section><div><p>10 <b>deep</b></p></div></section></body></html>""")
CASES = {
    "p": "1 2 4 9 10", "div > p": "1 2 4 9 10", "#a p.k": "2", "p + p": "2", "p ~ p": "2 4", "p.k + span": "3", "span ~ p": "4", "#a > :first-child": "1", "#a > p:last-child": "4", "li:nth-child(odd)": "5 7", "li:nth-child(2n)": "6 8", "li:nth-child(-n+2)": "5 6", "li:nth-child( 3 )": "7",
    "li:nth-last-child(1)": "8", "p:nth-of-type(2)": "2", "p:last-of-type": "4 9 10", "p:not(.k)": "1 4 9 10", "p:not(.k, [data-z])": "1 4 10", "li:not(:nth-child(2)):not(:last-child)": "5 7", ":is(span, i)": "3", "div:not(#a) > p": "9 10", "section p": "10", "body > div p:only-of-type": "9", "p:contains('deep')": "10", "i:empty": "",
    '[data-z~="b"]': "9", "[data-z='a b']": "9", "[data-z^=a]": "9", "li.k ~ li, span": "3 7 8", "ul>li+li.k": "6", "section * b": "deep", ".y.x > span": "3", "P.k": "2", "div p ~ i": "", "html:root > body > section b": "deep",
}


@pytest.mark.parametrize("css", CASES)
def test_select(css):
    got = [" ".join(n.text().split()) for n in dom.select(PAGE, css)]
    got = [g.replace("10 deep", "10") for g in got]
    assert " ".join(g for g in got if g) == CASES[css]


@pytest.mark.parametrize("css", ["", "p >", "> p", "p,,q", "p:nope", "p:not(", "p:nth-child(x)", "p[", "a b,", "p:first-child(2)", ":not()", "p ! q"])
def test_refused(css):
    with pytest.raises(ValueError):
        dom.compile_selector(css)


def test_no_shape_squares():
    wide = dom.parse("<div>" + "<p>x</p>" * 20_000 + "<b>y</b></div>")
    deep = dom.parse("<div>" * 250 + "<p>x</p>" * 200)
    began = time.perf_counter()
    assert len(dom.select(wide, "p ~ p")) == 19_999 and len(dom.select(wide, "p:nth-last-of-type(2n)")) == 10_000 and len(dom.select(wide, "p + b")) == 1
    assert len(dom.select(deep, "div div div div div div div div p")) == 200 and dom.select(deep, "i div div div div div div p") == []
    assert time.perf_counter() - began < 20
