"""Pages by hand, of makes that no training page has. The mark before a block's text says whether it is article."""

import re

MARKED = [
    # layout by tables
    """<html><body><table width=100%><tr><td colspan=2>-<a href=/>Home</a> | <a href=/n>News</a> | <a href=/s>Sport</a></td></tr>
    <tr><td valign=top>+<font size=5>Council approves new bridge over the river</font><p>+The council voted on Tuesday to build a second bridge across the river, after years of debate about its cost and its route.<p>+Work is to begin in spring, said the mayor, and will take about three years.</td>
    <td width=150>-<b>Most read</b><br><a href=/1>Storm closes harbour</a><br><a href=/2>Team wins cup</a></td></tr>
    <tr><td colspan=2>-All rights reserved. Contact us</td></tr></table></body></html>""",
    # no wrappers at all
    """<h1>+A walk along the coast</h1><p>-<a href=/>Home</a> <a href=/about>About</a> <a href=/archive>Archive</a></p>
    <p>+We set out early, when the mist was still lying over the fields, and reached the cliffs by noon.</p>
    <p>+The path is narrow there.</p><p>+It goes down to a beach of black stones where fishermen used to land their boats until the war.</p>
    <hr><p>-Copyright 2019 Jane Miller</p>""",
    # names that say nothing
    """<body><div class="x1a"><div class="q9"><a href=/a>-Start</a></div><div class="q9"><a href=/b>-Products</a></div><div class="q9"><a href=/c>-Support</a></div></div>
    <div class="zz7"><div class="k3"><h2>+Why batteries age</h2><div class="p0">+Every time a cell is charged, a thin layer grows on its electrode and binds some of the lithium for good.</div>
    <div class="p0">+Heat makes this faster. A phone that lies in the sun loses capacity even when nobody uses it.</div><ul><li>+Keep it cool<li>+Avoid full charge<li>+Do not leave it empty</ul></div></div>
    <div class="v4">-Sign up for our newsletter and never miss a story</div><div class="w2">-Terms of use - Privacy policy</div></body>""",
    # results in a list
    """<body><center>-<a href=/>Front page</a> - <a href=/p>Politics</a></center><div><h1>+Election results by party</h1>
    <p>+The votes of all districts have been counted. Turnout was higher than four years ago, in the cities most of all.</p>
    <ul><li>+Labour: 3 million</li><li>+Greens: 1.2 million</li><li>+Others: 400,000</li></ul>
    <p>+A coalition of two parties is the likely outcome, but talks may take weeks.</p></div><div><small>-Page generated in 0.2 seconds</small></div></body>""",
    # hidden blocks
    """<body><main><h1>+Baking bread at home</h1><p>+Mix flour, water, salt and a little yeast, and let the dough rest for twelve hours in a cool place.</p>
    <p hidden>-You have read two of three free articles this month.</p><div style="display:none">-Please enable scripts to see this page.</div>
    <p>+Then fold it four times and bake it in a hot pot with the lid on for half an hour.</p></main></body>""",
    # line breaks in a cell, a letter
    """<html><body bgcolor=white><table><tr><td bgcolor=navy>-<a href=i.html>Index</a><br><a href=l.html>Links</a><br><a href=g.html>Guestbook</a></td>
    <td><h3>+My first telescope</h3>+When I was ten my uncle gave me a small telescope with a wooden stand.<br><br>Through it I saw the rings of Saturn, and I have not stopped looking up since.</td></tr></table>
    <center>-You are visitor number 10293</center></body></html>""",
    # a forum-like tail
    """<body><div id=a><h1>+How to sharpen a kitchen knife</h1><p>+Hold the blade at a steady angle of about twenty degrees and draw it over the wet stone from heel to tip.</p>
    <p>+Repeat this ten times on each side, then turn to the finer stone.</p></div><div id=b><h3>-Leave a reply</h3><div>-Tom says: great, thanks!</div><div>-Anna says: mine is still dull</div></div>
    <div id=c>-<a href=/r1>Ten best pans</a><p>-<a href=/r2>Which oven to buy</a></div></body>""",
    # spans and sections of an application
    """<body><div class="css-1f8k"><span>-<a href=/login>Log in</a></span><span>-<a href=/join>Join now</a></span></div>
    <div class="css-77ab"><h1 class="css-9">+Scientists map the floor of the lake</h1><div class="css-0">-Share this article</div>
    <p class="css-2">+With sound pulses from a small boat, a team has drawn the first complete map of the bottom of the lake, down to rocks of the size of a car.</p>
    <p class="css-2">+They found two drowned forests and the wreck of a steamer that sank in 1893.</p><div class="css-5">-Advertisement</div>
    <p class="css-2">+The map is to help with the protection of spawning grounds.</p></div><div class="css-8"><h4>-More stories</h4><p>-<a href=/m>Rare bird seen in the north</a></p></div></body>""",
    # German, with names in German
    """<body><div class="kopf">-<a href="/">Startseite</a> <a href="/w">Wirtschaft</a></div><div class="inhalt"><h1>+Neue Bahnstrecke wird im Herbst eröffnet</h1>
    <p>+Nach zehn Jahren Bauzeit soll die Strecke im Oktober in Betrieb gehen. Die Fahrt dauert dann nur noch eine Stunde.</p><p>+Anwohner befürchten mehr Lärm in der Nacht.</p></div>
    <div class="rand">-<a href="/1">Meistgelesen</a></div><div class="fuss">-Impressum Datenschutz</div></body>""",
    # definition list and quotation
    """<body><p>-<a href=..>Up</a> <a href=next.html>Next</a> <a href=prev.html>Previous</a></p><h2>+Terms used in sailing</h2>
    <dl><dt>+Halyard<dd>+A line by which a sail is hoisted and held up.<dt>+Sheet<dd>+A line that controls the angle of a sail to the wind.</dl>
    <blockquote>+He who knows the ropes needs no wind, as the old sailors used to say to the boys on their first voyage.</blockquote><address>-Webmaster, last changed 3 May 2001</address></body>""",
]


def pages() -> list[tuple[str, list[bool]]]:
    """Pages without their marks, and per block whether it is article."""
    from clipflow.llm import html

    out = []
    for page in MARKED:
        labels = [text[0] == "+" for _, text, _ in html.blocks(page)]
        out.append((re.sub(r"(^|>)(\s*)[+-](?=[\w<])", r"\1\2", page), labels))
    return out
