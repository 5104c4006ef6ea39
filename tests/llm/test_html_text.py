from pagecorpus.llm import html_text as H

ARTICLE = "<article><h1>The&nbsp;title</h1><p>First  para\n graph <b>bold</b>ly.</p><p>Second &amp; <a href=x>linked</a> one.<br>Same block.</p><p>Hm.</p></article>"
TEXT = "The title\nFirst para graph boldly.\nSecond & linked one. Same block.\nHm."


def test_article_without_surroundings():
    page = ("<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p><p>no</p>';</script></head><body class='has-sidebar'>"
            "<header><p>Site head</p></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class='cookie-notice'><p>We use cookies</p></div>"
            "<div id=sidebar><p>Side</p><div>deep</div></div><div class=\"ad\">Buy</div><!-- <p>gone</p> --><main>" + ARTICLE +
            "</main><section id='comments'><article class='comment'><p>A reader says a lot, really a lot of words, more than the article itself has, "
            "far more than that, and so on and on, without any end of it.</p></article></section><form><p>Name</p><input name=a></form>"
            "<aside><p>See also</p></aside><footer><p>&copy; me</p></footer></body></html>")
    assert H.main_text(page) == TEXT


def test_page_without_article():
    body = "".join(f"<div>Paragraph number {i} holds a good deal of text, as paragraphs do.</div>" for i in range(6))
    page = f"<body><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul><div><h2>Head</h2>{body}</div><div class='footer'>bye</div><ul><li><a href=a>Three</a></li></ul></body>"
    assert H.main_text(page) == "Head\n" + "\n".join(f"Paragraph number {i} holds a good deal of text, as paragraphs do." for i in range(6))


def test_advert_inside_article_and_unclosed_tags():
    page = "<article><p><b>One here<br><p>Two here<div class='advertisement'><p>Buy now</div><p>Three here</article><footer>f"
    assert H.main_text(page) == "One here\nTwo here\nThree here"


def test_plain_and_broken_markup():
    assert H.main_text(None) == H.main_text("") == H.main_text("<p></p>") == ""
    assert H.main_text("just  text &lt;b&gt;") == "just text <b>"
    assert H.main_text("<p>a<script>never ends") == "a"
    assert H.main_text("<p title='it's>a</p>1 < 2") != ""
    assert H.main_text("<div>a<br><br>b</div>") == "a\nb"
    assert H.main_text("<table><tr><td>x</td><td>y</td></tr></table>") == "x\ny"
    assert len(H.main_text("<p>" + "word " * 300_000 + "</p>")) == 5 * 300_000 - 1


def test_regions_surge_and_dive():
    import numpy as np
    assert H.regions(np.array([0, 5, 6, 0, 0, 7, 0])) == [(1, 3), (5, 6)]
    assert H.regions(np.zeros(3, np.int64)) == []


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", ARTICLE, "x"), (1, "u", ARTICLE, "x"), (None, None, None, None)], "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in H.extract(df).collect())
    assert got == [(0, "", 0), (1, TEXT, len(TEXT)), (1, TEXT, len(TEXT))]
    assert H.extract(df.limit(0)).count() == 0


def _paragraphs(first, last):
    return "".join(f"<p>Paragraph number {i} holds a good deal of text, as paragraphs do.</p>" for i in range(first, last))


def test_short_text_after_an_advert_without_article():
    page = "<body>" + _paragraphs(0, 6) + "<div class=advert>Buy</div><p>Short end.</p></body>"
    assert H.main_text(page).split("\n")[-1] == "Short end." and "Buy" not in H.main_text(page)
    page = "<body>" + _paragraphs(0, 3) + "<p><a href=x>One block that is a link</a></p>" + _paragraphs(3, 4) + "</body>"
    assert H.main_text(page).split("\n")[3:] == ["One block that is a link", "Paragraph number 3 holds a good deal of text, as paragraphs do."]
    page = "<body>" + _paragraphs(0, 6) + "<div class=advert>Buy</div>" * 5 + "<p>Short end.</p></body>"
    assert H.main_text(page).endswith("do.\nShort end.")  # next to the main region


def test_window_changes_regions(monkeypatch):
    import numpy as np

    lengths = np.array([0, 5, 0, 0, 7, 0, 0, 0, 2])
    assert H.regions(lengths, 3) == [(1, 5), (8, 9)]
    assert H.regions(lengths, 2) == [(1, 2), (4, 5), (8, 9)] and H.regions(lengths, 4) == [(1, 9)]
    links = "<p><a href=x>A link</a></p>" * 3
    page = "<body>" + _paragraphs(0, 6) + links + "<p>Short.</p>" + links + "<p>Further.</p></body>"
    three = H.main_text(page)
    assert "Short." in three and "A link" not in three and "Further." not in three
    monkeypatch.setattr(H, "WINDOW", 4)
    assert H.main_text(page).count("A link") == 6 and H.main_text(page).endswith("Further.")


def test_lines_of_other_containers_stay_out():
    page = "<article><p>One here is a text</p><article class=x><p>Inner</p></article><p>Two here is a text</p></article>"
    assert H.main_text(page) == "One here is a text\nTwo here is a text"
