import pytest

from tidecrawl.functions.html import extract, page_text, parse_page, parse_selector, select, tree

PIER = "http://harbour.example/pier/plan.html"


def test_links():
    hrefs = ["boats", "./boats?age=1#bow", "/tide#high", "/tide", "//north.example/x", "../sea/../sand", "?moon", "https://Far.example", "", "#top", " ", "tel:1", "javascript:go()", "http://[bad", "boats"]
    page = parse_page("<a>none</a><area href=/no>" + "".join(f'<a href="{h}">x</a>' for h in hrefs), PIER)
    assert page["links"] == ["http://harbour.example/pier/boats", "http://harbour.example/pier/boats?age=1", "http://harbour.example/tide", "http://north.example/x", "http://harbour.example/sand", f"{PIER}?moon", "https://Far.example"]


def test_base_address():
    html = '<a href="x">x</a><base><base href=" /dock/ "><base href="/late/"><img src="y.png">'
    page = parse_page(html, PIER)
    assert page["links"] == ["http://harbour.example/dock/x"] and page["images"] == [{"src": "http://harbour.example/dock/y.png", "alt": None}]


@pytest.mark.parametrize("html", ["", None, " \n ", "<html><body></body></html>", "<!-- only a note -->"])
def test_pages_without_content(html):
    page = parse_page(html, PIER)
    assert page == {"title": None, "text": "", "links": [], "metadata": {"title": None, "description": None, "keywords": [], "canonical": None, "language": None}, "images": [], "headings": {"h1": [], "h2": [], "h3": []}, "tables": [], "lists": []}


def test_wanted_fields():
    html = "<title>Tides</title><p>Low water</p><a href=/x>x</a>"
    assert parse_page(html, PIER, ["links", "title"]) == {"links": ["http://harbour.example/x"], "title": "Tides"}


def test_broken_markup():
    page = parse_page('<ul><li>rope<li>sail</b></ul><p>at <i>sea</p> <a href=/in>in</a> </div> &amp; &copy out<a href="/cut', PIER)
    assert page["text"] == "rope sail at sea in & © out" and page["links"] == ["http://harbour.example/in"]


def test_text():
    root = tree("<head><title>Title</title><style>p{}</style></head><p id=one>first <b>bold</b></p><svg><text>drawn</text></svg><template>t</template><noscript>n</noscript><div class='note'>a<div class='note'>b</div></div><!-- c -->")
    assert page_text(root) == "first bold a b" and page_text(root, ".note") == "a b b" and page_text(root, "title") == "Title" and page_text(root, "h6") == ""


def test_metadata():
    page = parse_page('<html lang=" nl "><title> Low \n tide </title><title>2</title><meta name=KEYWORDS content=" mud,, sand ,"><meta name="description"><meta name="description" content="late"><link rel="next Canonical" href="low">', PIER)
    assert page["metadata"] == {"title": "Low tide", "description": None, "keywords": ["mud", "sand"], "canonical": "low", "language": " nl "}


def test_images_and_headings():
    page = parse_page('<img src=" a.gif "><img src=""><img alt=lost><img src="data:x" alt=" two words "><h3>c</h3><h1> </h1><h1>a <i>b</i><script>s</script></h1><h4>d</h4>', PIER)
    assert page["images"] == [{"src": "http://harbour.example/pier/a.gif", "alt": None}, {"src": "data:x", "alt": "two words"}]
    assert page["headings"] == {"h1": ["a b"], "h2": [], "h3": ["c"]}


def test_tables():
    html = "<table><caption>Tides</caption><tr></tr><tr><th>Port</th><th>High</th></tr><tbody><tr><td>North</td><td>4.1</td></tr><tr><th>South</th><th>3.9</th></tr><tr><td colspan=2><table><tr><th>a</th><td>b</td></tr></table></td></tr></tbody></table><table><tr><td><table></table></td></tr></table>"
    assert parse_page(html, "")["tables"] == [
        {"headers": ["Port", "High"], "rows": [["North", "4.1"], ["South", "3.9"], ["a b"]]},
        {"headers": [], "rows": [["a", "b"]]},
        {"headers": [], "rows": [[""]]},
    ]


def test_lists():
    html = "<ol><li>cast off</li><li> </li><div><li>no child</li></div><li>steer<ul><li>port</li><li>starboard</li></ul></li></ol><ul></ul>"
    assert parse_page(html, "")["lists"] == [{"type": "ol", "items": ["cast off", "steer port starboard"]}, {"type": "ul", "items": ["port", "starboard"]}]


def test_selectors():
    root = tree('<main id="bay"><p class="depth low">3</p><section><p class="depth">9</p><a rel="next nofollow" href=" /n " data-k="x y">n</a></section></main><meta name="unit" content=" m ">')
    texts = lambda css: [e.words() for e in select(root, css)]
    assert texts("#bay > .depth") == ["3"] and texts("main p.depth") == ["3", "9"] and texts("p.low, a") == ["3", "n"] and texts("a[rel~=next][href*='n'][data-k='x y']") == ["n"] and texts("body p") == []
    wanted = {"first": ".depth", "every": {"selector": "section *", "all": True}, "rel": {"selector": "a", "attr": "rel"}, "href": {"selector": "a", "attr": "href"}, "unit": "meta[name=unit]", "gone": "h1", "none": {"selector": "h1", "all": True}}
    assert extract(root, wanted) == {"first": "3", "every": ["9", "n"], "rel": "next nofollow", "href": "/n", "unit": "m", "gone": None, "none": []}
    assert parse_selector(" depth = p[x=y] ") == ("depth", "p[x=y]")
    for bad in ("> p", "p >", "p:hover", ""):
        with pytest.raises(ValueError):
            select(root, bad)
