"""Labelled pages from which the weights of the page scan are fitted.

Every page is a list of (is_main_text, html) parts in page order. The pages are put together by a
rule from some ways to frame, write and surround a text; no sentence of a main text stands elsewhere.
"""

from __future__ import annotations

_STORY = [
    "The river rose for three days before the first fields were lost, and the people of the valley moved their cattle to the hills.",
    "Nobody had seen water this high since the old bridge fell, so the council met at night and voted for a new dam.",
    "Work begins in spring and should end within two years, the engineers say.",
    "Der Regen hielt die ganze Nacht an, und am Morgen stand der Markt unter Wasser.",
    "Les habitants ont quitté leurs maisons avant le lever du jour, sans attendre les secours.",
    "El puente nuevo resistió la crecida, pero el camino del norte quedó cerrado durante semanas.",
    "It was the third flood in ten years.",
    "The school opened again after a month, with new floors and a line on the wall that shows how far the water came.",
]
_NAV = "<nav><ul><li><a href='/a'>Home page</a></li><li><a href='/b'>All news</a></li><li><a href='/c'>About us</a></li></ul></nav>"
_BEFORE = [
    _NAV,
    "<header><a href='/'>Valley Post</a><form><input name=q><button>Look it up</button></form></header>" + _NAV,
    "<div id='menu'><a href='/1'>One</a> <a href='/2'>Two</a> <a href='/3'>Three</a></div><div><span><a href='/login'>Sign in</a></span></div>",
    "<div><a href='/'>Start</a> &gt; <a href='/n'>News</a> &gt; <a href='/n/v'>Valley</a></div><p>You are reading the free edition.</p>",
    "<table><tr><td><a href='/1'>Index</a></td><td><a href='/2'>Maps</a></td><td><a href='/3'>Help</a></td></tr></table>",
    "<div class='ad'>Buy two boats and pay for one of them only today.</div><div role='banner'>Valley Post of today</div>",
    "<article class='card'><h2>Short</h2><p>Teaser of another page.</p></article>" + _NAV,
]
_AFTER = [
    "<footer><p>&copy; Example Press. All rights are reserved.</p><a href='/imprint'>Imprint</a></footer>",
    "<aside><h3>Most read</h3><ul><li><a href='/x'>Ten ways to dry a carpet</a></li><li><a href='/y'>Where the fish went</a></li></ul></aside>",
    "<section class='comments'><h2>Comments</h2><p>I saw it with my own eyes and it was terrible to look at.</p><p>My uncle lost his barn that night.</p></section>",
    "<div><h3>2 Comments</h3><div><b>Anna</b><p>Thank you for this report, it says it all.</p></div><div><b>Paul</b><p>And who pays for it in the end?</p></div></div>",
    "<div><ul><li><a href='/p'>Older post</a></li><li><a href='/n'>Newer post</a></li></ul></div><div class='cookie-notice'>We use cookies to make this page better for all who read it.</div>",
    "<div class='newsletter'><form><label>Your mail</label><input><button>Send</button></form><p>Follow the news by mail every morning at no cost.</p></div>",
    "<div><a href='/up'>Back to top</a> <a href='/print'>Print</a> <a href='/send'>Send to a friend</a></div>",
]
_FRAMES = [
    ("<article>", "</article>"), ("<main>", "</main>"), ("<div>", "</div>"), ("<div class='content with-sidebar'>", "</div>"), ("<section>", "</section>"),
    ("<table><tr><td>", "</td></tr></table>"), ("<div class='post'><div class='entry-content'>", "</div></div>"), ("<div class='story legal'>", "</div>"),
]


def _written(way: int, at: int) -> str:
    """A main text in one of several ways to write it."""
    s = [_STORY[(at + k) % len(_STORY)] for k in range(6)]
    head = f"<h1>{s[0].split(',')[0]}</h1>"
    return [
        head + "".join(f"<p>{x}</p>" for x in s),
        head + f"<p><b>{s[1]}</b><br><p>{s[2]}<p>{s[3]}",
        f"{s[0]}<br><br>{s[1]}<br><br>{s[2]}<br><br>{s[4]}",
        head + f"<p>{s[1]}</p><ul><li>{s[2]}</li><li>{s[6 % 6]}</li><li>{s[4]}</li></ul><p>{s[5]}</p>",
        head + f"<p>{s[1]} <a href='/x'>{s[2]}</a> {s[3]}</p><blockquote><p>{s[4]}</p></blockquote><h2>{s[2].split(' and ')[0]}</h2><p>{s[5]}</p>",
        head + "".join(f"<div><span>{x}</span></div>" for x in s),
        f"<p>{s[0]}</p>",
        "<h1>Flood</h1>" + "".join(f"<p>{x}</p>" for x in s[:2]) + "<p>Soon.</p>" + f"<p>{s[3]}</p><p>Ends.</p>",
        "".join(f"<p>Line {k} tells what was seen by the river.</p>" for k in range(30)),
    ][way]


#: One page for each frame, way to write and two of the surroundings, which change from page to page.
PAGES: list[list[tuple[bool, str]]] = [
    [(False, f"<html><head><title>Flood</title></head><body>{_BEFORE[(frame + 2 * way + turn) % 7]}"), (True, start + _written(way, frame + turn) + end), (False, f"{_AFTER[(way + 3 * frame + turn) % 7]}{_AFTER[(frame + 5 * turn + 1) % 7]}</body></html>")]
    for frame, (start, end) in enumerate(_FRAMES)
    for way in range(9)
    for turn in (0, 3)
]
