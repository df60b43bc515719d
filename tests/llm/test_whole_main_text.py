from tidemark.llm import main_text

PROSE = "It was one of the days on which there is not much that a person can do but wait for the rain to end, and so they sat by the window with their tea. " * 2


def test_prose_outside_beside_a_card():
    page = f"<body><div class=post><p>{PROSE}<p>And so on.<p>{PROSE}</div><article class=card><h3>Boots</h3><p>Now cheaper</p></article></body>"
    got = main_text.main_blocks(page)
    assert got[:3] == [PROSE.strip(), "And so on.", PROSE.strip()]


def test_good_prose_outside_a_larger_article_stays():
    page = f"<body><div>Home</div><article><h1>Rain</h1><p>{PROSE}<p>{PROSE}<p>Ends.</article><div>{PROSE}</div><div>Top</div></body>"
    assert main_text.main_blocks(page) == ["Rain", PROSE.strip(), PROSE.strip(), "Ends.", PROSE.strip()]


def test_short_blocks_among_link_lists_in_an_article():
    links = "".join(f"<li><a href=/{i}>Some other story {i}</a>" for i in range(3))
    page = f"<article><p>{PROSE}<p>By me.<p>{PROSE}<ul>{links}</ul><p>More stories<p>Our choice<ul>{links}</ul></article>"
    assert main_text.main_blocks(page) == [PROSE.strip(), "By me.", PROSE.strip()]


def test_unclosed_head_and_title():
    for head in ("<head><title>T</title><meta charset=utf-8>", "<head><title>T</title><script>x</script>"):
        assert main_text.main_blocks(f"<html>{head}<body><div><p>{PROSE}</div>") == [PROSE.strip()]
        assert main_text.main_blocks(f"<html>{head}<article><p>{PROSE}</article>") == [PROSE.strip()]


def test_form_around_the_page():
    page = f"<body><form action=/><input name=q><nav><a href=/>Home</a></nav><div><h1>Rain</h1><p>{PROSE}<p>And so on.<p>{PROSE}</div><label>Name</label><button>Send</button></form></body>"
    assert main_text.main_blocks(page) == ["Rain", PROSE.strip(), "And so on.", PROSE.strip()]
    assert main_text.main_blocks(f"<article><p>{PROSE}</article><form><p>Get our letter every week in your box, it is free of charge.</form>") == [PROSE.strip()]


def test_names_that_only_mention_what_surrounds():
    page = f"<article><p>{PROSE}</p><div class='social-history'><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p></div><div class='comment-list'><p>{PROSE}</p><p>{PROSE}</p></div><div class=ad-slot-3><p>{PROSE}</p></div></article>"
    assert main_text.main_blocks(page) == [PROSE.strip()] * 4


RULES = {
    "stop words": ("STOP_HIGH", 0.0, f"<div><p>{PROSE}</p><p>{'Kupl 400 Zzyx 12 Brant 88 mbar Oxid Tarm 5 Quell ' * 6}</p></div>"),
    "length": ("LENGTH_HIGH", 0, "<div><p>So it is with all of them who are in it now or who will be, and that was what he had to say.</p><hr><p>One Two</p></div>" + f"<div><a href=/>Home page of this site and more</a></div><div>{PROSE}</div>"),
    "links": ("LINK_HIGH", 2.0, f"<div><p>{PROSE}</p><p><a href=/a>{PROSE}</a></p><p><a href=/b>{PROSE}</a></p></div>"),
}


def test_every_rule_decides_pages(monkeypatch):
    """Without one of the rules the result of a page is another one, within an article element and without."""
    changed = {}
    for name, (constant, value, page) in RULES.items():
        for kind in ("div", "article"):
            html = page if kind == "div" else f"<article>{page}</article>"
            before = main_text.main_blocks(html)
            monkeypatch.setattr(main_text, constant, value)
            changed[name, kind] = main_text.main_blocks(html) != before
            monkeypatch.undo()
    print(changed)
    assert all(changed[name, "div"] for name in RULES) and changed["links", "article"]
    page = f"<div><p>Menu one</p><p>Menu two</p><p><a href=/>All the news of the day</a></p><p>{PROSE}</p><p>So it goes.</p><p>{PROSE}</p></div>"
    assert main_text.main_blocks(page) == [PROSE.strip(), "So it goes.", PROSE.strip()]
    monkeypatch.setattr(main_text, "second_pass", lambda blocks: None)
    assert main_text.main_blocks(page) == [PROSE.strip(), PROSE.strip()]
