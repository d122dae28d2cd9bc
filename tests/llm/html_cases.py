"""Pages of several kinds of mark-up and the text that is their article."""

LONG = "This is a paragraph of the article, with commas, and words enough to count as running text, as people write it."
MORE = "Another paragraph follows, which goes on about the same thing, in some detail, and then comes to its end, at last."
MENU = '<ul class="top"><li><a href=1>Home</a></li><li><a href=2>News</a></li><li><a href=3>Sport</a></li></ul>'
TEXT = f"{LONG}\n{MORE}"

CASES = {
    "a plain div": (f"<body>{MENU}<div><p>{LONG}</p><p>{MORE}</p></div><footer>© 2020, all rights, of course</footer></body>", TEXT),
    "wrappers": (f"<body>{MENU}<div><div><div><p>{LONG}<p>{MORE}</div></div></div></body>", TEXT),
    "a title beside the text": (f"<body><div id=wrap><h1>Title</h1><div class=text><p>{LONG}<p>{MORE}</div></div></body>", f"Title\n{TEXT}"),
    "text in several sections": (f"<body>{MENU}<div id=x><section><p>{LONG}</p></section><section><p>{MORE}</p></section></div></body>", TEXT),
    "text in a table": (f"<body><table><tr><td>{MENU}</td><td><p>{LONG}</p><p>{MORE}</p></td></tr></table></body>", TEXT),
    "line breaks for paragraphs": (f"<body>{MENU}<div>{LONG}<br><br>{MORE}</div></body>", f"{LONG} {MORE}"),
    "comments of an unknown class": (f"<body><div class=c1><p>{LONG}</p><p>{MORE}</p></div><div class=x7><div class=u><p>Nice, very nice, I say.</p></div><div class=u><p>Not so nice, I say.</p></div></div></body>", TEXT),
    "a discussion beside an article": ("<body><article><p>One, two, three.</p></article><section class=discussion><p>Four, five, six.</p></section></body>", "One, two, three."),
    "an unnamed block that ties with the article": ("<body><article><p>One, two, three.</p></article><div class=zz><p>Four, five, six.</p></div></body>", "One, two, three."),
    "comments inside the article": (f"<article><p>{LONG}</p><p>{MORE}</p><div class=comments><p>{LONG}</p></div></article>", TEXT),
    "several articles": (f"<body><article><p>{LONG}</p></article><article><p>{MORE}</p></article></body>", TEXT),
    "articles in a main element": (f"<main><article><p>{LONG}</p></article><article><p>{MORE}</p></article></main>", TEXT),
    "a nested advert": (f"<div><p>{LONG} <span class=ad>Buy <span>now</span> today</span></p><p>{MORE}</p></div>", TEXT),
    "an advert left open": (f"<div><p>{LONG} <span class=ad>Buy <p>{MORE}</div>", TEXT),
    "an advert in the middle of a word run": (f"<div><p>Some words, <ins class=adsbygoogle>Buy</ins> and more words, of the article.</p><p>{MORE}</p></div>", f"Some words, and more words, of the article.\n{MORE}".replace("adsbygoogle", "")),
    "nested drawings": (f"<div><p>{LONG} <svg><g><svg><text>in</text></svg><text>out</text></g></svg></p><p>{MORE}</p></div>", TEXT),
    "self-closed drawings": (f"<div><p><svg/>{LONG}<svg width=1 /></p><p>{MORE}</p></div>", TEXT),
    "a share link": (f"<div><p>{LONG} <a class=share href=x>Share this</a></p><p>{MORE}</p></div>", TEXT),
    "links in the text": (f"<div><p>{LONG} <a href=x>A link</a>.</p><p>{MORE}</p></div>", f"{LONG} A link.\n{MORE}"),
    "related links in the article": (f"<article><p>{LONG}</p><ul><li><a href=1>One thing</a><li><a href=2>Two things</a><li><a href=3>Three</a></ul><p>{MORE}</p></article>", TEXT),
    "a list in the article": (f"<article><p>{LONG}</p><ul><li>One thing<li>Two things</ul><p>{MORE}</p></article>", f"{LONG}\nOne thing\nTwo things\n{MORE}"),
    "a table in the article": (f"<article><p>{LONG}</p><table><tr><th>a<th>b<tr><td>1<td>2</table><p>{MORE}</p></article>", f"{LONG}\na\nb\n1\n2\n{MORE}"),
    "unopened end tags": (f"</div></section><div><p>{LONG}</b></p></span><p>{MORE}</p></article></div></p>", TEXT),
    "an end tag in a cell": (f"<div><table><tr><td>{LONG}</div></td></tr><tr><td>{MORE}</td></tr></table></div>", TEXT),
    "a form and a notice": (f"<div class=body><div class=cookie-notice>We use cookies, yes, many.</div><p>{LONG}</p><form><p>Name, please</p></form><p>{MORE}</p></div>", TEXT),
    "hidden parts": (f"<div><p>{LONG}</p><p hidden>No</p><div style='display: none'><p>{MORE}</p></div><p>{MORE}</p></div>", TEXT),
    "scripts with tags": (f"<div><script>document.write('<p>x</p></scripty>')</script><p>{LONG}</p><SCRIPT>a</SCRIPT ><p>{MORE}</p></div>", TEXT),
    "quotes with angle brackets": (f"<div title='a > b'><p data-x=\"</p>\">{LONG}</p><p>{MORE}</p></div>", TEXT),
    "character references": ("<article><p>a &lt;b&gt; &amp;amp; &#233;&nbsp;\n\t x</p></article>", "a <b> &amp; é x"),
    "no text": ("<html><body><div></div><p> </p></body></html>", ""),
}

#: 200 KB and more each: nothing may take time by the square of a page.
_N = 20_000
HOSTILE = {
    "open and unopened": "<div>" * _N + "</section>" * _N,
    "open adverts": "<span class=ad>" * _N + "x",
    "deep": "<div>" * _N + "x" + "</div>" * _N,
    "paragraphs": "<p>" * _N,
    "a long attribute": "<div " + "a" * 1_000_000 + ">x</div>",
    "spaces in a tag": "<div a" + " " * 1_000_000 + "b>x",
    "quotes": "<a \"x'>" * _N,
    "tables": "<table><tr><td>" * _N + "</div>" * _N,
    "lists": "<ul><li>" * _N + "<li>" * _N,
    "angle brackets": "<" * 1_000_000,
    "comments": "<!--" * 100_000,
}
