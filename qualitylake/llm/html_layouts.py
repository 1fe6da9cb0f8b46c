"""The labelled table of the page classifier: layouts of pages whose blocks are known to be main text or not.

In a layout m12 stands for twelve words of main text and x5 for five words of anything else, so a block's label
is what it is made of. Every layout is filled a few times with other lengths. Names of classes are missing,
meaningless or misleading in many layouts, as they are on the web."""

from __future__ import annotations

import random
import re

_NAV = "<ul><li><a href=a>x1</a></li><li><a href=b>x1</a></li><li><a href=c>x2</a></li><li><a href=d>x1</a></li></ul>"
_HEAD = "<head><title>x7</title><style>p{}</style></head>"

LAYOUTS = [
    # an article between semantic areas
    f"{_HEAD}<body><nav>{_NAV}</nav><div class=ad>x9</div><article><h1>m6</h1><p>m3<br>m40</p><p>m25</p><p>m2</p><p>m60</p></article><footer>x1 x9</footer></body>",
    f"{_HEAD}<body><nav>{_NAV}</nav><div class=ad>x4</div><article><h1>m11</h1><p>m22</p></article><footer>x14</footer></body>",
    f"<header><a href=/>x1</a><p>x8</p></header><main><h2>m2</h2><p>m2</p><ul><li>m1</li><li>m7</li><li>m3</li></ul><p>m50</p></main><aside><h3>x1</h3><p>x32</p><p><a href=q>x6</a></p></aside><footer><p>x20</p></footer>",
    "<article><header><h1>m5</h1><p>m9</p></header><p>m45</p><aside><p>x18</p></aside><p>m33</p><form><p>x14</p></form><div class=related><h3>x2</h3><a href=1>x4</a></div><section class=comments><h3>x2</h3><p>x44</p><p>x30</p></section></article>",
    "<nav><a href=1>x1</a> <a href=2>x1</a></nav><article><h1>m1</h1><p>m2</p><p>m6</p></article><footer>x6</footer>",
    "<main><article><h1>m8</h1><p>m30 <a href=1>m2</a> m20</p><ol><li><a href=2>m5</a></li><li><a href=3>m6</a></li></ol><blockquote>m28</blockquote><p>m1</p></article></main><p>x3</p><p><a href=4>x3</a></p>",
    "<article><p><a href=1>m2</a></p><p><a href=2>m3</a></p><p><a href=3>m4</a></p></article><p><a href=4>x2</a></p><p><a href=5>x3</a></p>",
    "<article><h1>m4</h1><figure><figcaption>m9</figcaption></figure><p>m70</p><table><tr><th>m1</th><th>m1</th></tr><tr><td>m2</td><td>m1</td></tr></table><p>m40</p><footer>x12</footer></article>",
    "<article><div class=header><h1>m6</h1><p>m4</p></div><div class=top><h2>m3</h2></div><p>m55</p><div class=share>x5</div><p>m30</p></article><div class=footer>x9</div>",
    # containers by name
    "<div id=cookie-notice>x11 <a href=p>x2</a></div><div id=content><h1>m4</h1><p>m38</p><p>m3</p><p>m29</p></div><div class=footer><a href=1>x1</a> <a href=2>x1</a> <a href=3>x1</a></div>",
    "<div class=menu>x3</div><div class=sidebar><p>x28</p><p>x16</p></div><div class=text><p>m26</p><p>m1</p><p>m44</p></div><div class=social>x8</div>",
    "<div class='layout with-sidebar'><div class=content-sidebar-wrap><div class=post><h2>m2</h2><p>m48</p><p>m4</p><p>m31</p></div></div><div class=sidebar><p>x24</p></div></div>",
    f"<div class=topbar>{_NAV}</div><div class=post-body><h1>m7</h1><p>m52</p><p>m5</p><p>m41</p></div><div id=comments><p>x13</p><p>x26</p><p>x39</p></div><div class=copyright>x7</div>",
    "<div class=banner>x12</div><div class=story><p>m34</p><div class=ad>x15</div><p>m36</p><p>m4</p></div><div class=newsletter><p>x19</p></div>",
    "<div class=notice>x34</div><div><h1>m5</h1><p>m61</p><h2>m3</h2><p>m20</p><p>m2</p><p>m47</p></div><div class=disclaimer>x41</div>",
    "<div class=page><div class=breadcrumb><a href=1>x1</a> x1 <a href=2>x1</a></div><h1>m6</h1><p>m24</p><ul><li>m6</li><li>m9</li></ul><p>m37</p><div class=popup>x22</div></div>",
    # containers without a name
    "<p><a href=1>x1</a> <a href=2>x1</a> <a href=3>x1</a></p><p>m42</p><p>m2</p><p>m39</p><p>m5</p><p>m30</p><p><a href=4>x9</a></p>",
    "<p><a href=1>x1</a> <a href=2>x1</a> <a href=3>x1</a> <a href=4>x1</a> <a href=5>x2</a> <a href=6>x1</a> <a href=7>x1</a> <a href=8>x1</a> <a href=9>x1</a> <a href=10>x2</a> <a href=11>x1</a> <a href=12>x1</a></p><p>m55</p><p>m30</p><p>m4</p><p>m25</p>",
    "<table><tr><td><a href=1>x1</a><br><a href=2>x2</a><br><a href=3>x1</a></td><td><p>m35</p><p>m28</p><p>m3</p><p>m31</p></td></tr><tr><td>x4</td></tr></table>",
    f"<div class=c1>{_NAV}</div><div class=c2><h1>m5</h1><div class=c3>m33</div><div class=c3>m21</div><div class=c3>m3</div><div class=c3>m58</div></div><div class=c4><a href=1>x2</a> <a href=2>x1</a></div><div class=c4>x4</div>",
    f"<div>{_NAV}</div><div><h1>m9</h1><p>m19</p><p>m80</p><p>m4 <a href=x>m1</a></p><p>m62</p></div><div><h3>x2</h3><ul><li><a href=1>x5</a></li><li><a href=2>x7</a></li><li><a href=3>x4</a></li></ul></div><div>x5</div>",
    "<div><span>x2</span></div><div><a href=1>x2</a></div><p>m100</p><p>m70</p><p>m3</p><p>m90</p><div>x3</div><div><a href=1>x1</a> <a href=2>x1</a></div>",
    "<p>x1</p><p>m65</p><p>m48</p><h2>m3</h2><p>m50</p><p>x3</p>",
    "<p>m46</p><p>m3</p><p>m17</p><p>m52</p><h3>m2</h3><p>m37</p>",
    "<h1>m4</h1><p>m31</p><p>m26</p><h2>x2</h2><p><a href=1>x6</a></p><p><a href=2>x8</a></p><p><a href=3>x7</a></p>",
    "<div><a href=1>x3</a></div><div><a href=2>x3</a></div><div>m29 <a href=3>m2</a> m12</div><div>m33</div><div><a href=4>x2</a></div><div><a href=5>x2</a></div>",
    "<ul><li><a href=1>x4</a> x1</li><li><a href=2>x5</a> x1</li><li><a href=3>x3</a> x1</li></ul><p>m40</p><p>m6</p><p>m44</p><ul><li><a href=4>x4</a></li><li><a href=5>x3</a></li></ul>",
    "<div class=css-1x><div class=css-2y><h1>m6</h1></div><div class=css-3z>m27</div><div class=css-3z>m5</div><div class=css-3z>m39</div></div><div class=css-4w><div>x1</div><div><a href=1>x5</a></div><div>x1</div><div><a href=2>x6</a></div></div>",
    # pages in a form, and pages without main text
    f"<form id=aspnet><div>{_NAV}</div><div><h1>m5</h1><p>m50</p><p>m34</p><p>m4</p><p>m28</p></div><div>x3</div></form>",
    "<form action=/><h1>m3</h1><p>m47</p><p>m2</p><p>m36</p><p><a href=1>x3</a></p></form>",
    f"<nav>{_NAV}</nav><form><p>x6</p><label>x1</label><label>x1</label></form><footer>x8</footer>",
    "<div><a href=1>x1</a> <a href=2>x1</a></div><div><a href=3>x2</a></div><p>x2</p><div><a href=4>x1</a></div>",
    "<div id=header>x3</div><form class=search>x2</form><article><h1>m7</h1><div class=comment-free>m42</div><p>m1</p></article><div class=comment-list><article><p>x36</p></article><article><p>x12</p></article></div>",
    "<article><h1>m3</h1><p>m3</p></article><div id=respond><p>x20</p></div><section class=comments><article><p>x48</p></article><article><p>x33</p></article></section><footer>x30</footer>",
    "<main><p>m90</p></main>",
    # very short ones
    "<article><p>m1</p><p>m1</p><p>m1</p></article>",
    "<article><p>m1</p><p>m2</p></article>",
    "<main><h2>m1</h2><p>m1</p><p>m1</p><p>m2</p></main>",
    "<article><p>m1</p></article>",
    "<div>x2</div><article><p>m2</p><h2>m1</h2><p>m1</p></article><div>x1</div><div>x2</div>",
    "<article><h1>m2</h1><p>m1</p><p>m1</p></article>",
    "<article><p>m1</p><aside><p>x1</p></aside><p>m2</p><div class=ad>x2</div><p>m1</p><form>x1</form></article>",
    "<nav>x1</nav><article><p>m2</p><p>m1</p><div class=share>x1</div></article><aside><h3>x1</h3><p>x1</p><p>x25</p></aside><footer>x1</footer>",
    "<div class=menu>x1</div><div class=banner>x2</div><article><h1>m1</h1><p>m1</p></article><section class=comments><h3>x2</h3><p>x2</p><p>x1</p><p>x22</p></section><footer>x2</footer>",
    "<article><h1>m2</h1><p>m1</p><p>m35</p><p>m1</p></article><aside><h3>x2</h3><p>x1</p></aside><footer><p>x1</p><p>x40</p></footer>",
    "<p>x1</p><p>x1</p><p>x2</p>",
    "<div>x1</div><p>x2</p>",
    "<aside><article><p>x25</p></article><article><p>x31</p></article></aside><article><h1>m8</h1><p>m25</p><p>m31</p></article>",
    # nothing behind the main text
    f"<nav>{_NAV}</nav><article><h1>m5</h1><p>m40</p><p>m3</p></article>",
    "<div class=ad>x7</div><article><h1>m3</h1><p>m30</p><p>m22</p><p>m2</p></article>",
    "<article><h1>m6</h1><p>m45</p><ul><li><a href=1>m4</a></li><li><a href=2>m5</a></li><li><a href=3>m3</a></li></ul></article>",
    f"<nav>{_NAV}</nav><main><p>m33</p><ul><li><a href=1>m2</a></li><li><a href=2>m6</a></li></ul></main>",
    "<article><h1>m4</h1><p>m28</p><pre>m9</pre></article>",
    "<article><p>m50</p><pre>m3</pre></article>",
    "<main><h1>m5</h1><p>m37</p><h2>m2</h2><pre>m20</pre><p>m4</p></main>",
    f"<div>{_NAV}</div><article><p>m26</p><p>m1</p></article>",
    "<div><h1>m1</h1><p>m4</p></div>",
    "<div><h1>m3</h1><p>m5</p></div>",
    "<body><h1>m2</h1><p>m6</p><p>m3</p></body>",
    "<p>m36</p><p>m2</p><p>m4</p><p>m41</p>",
    "<p>m55</p><p>m30</p><p>m3</p><p>m6</p><p>m28</p>",
]


#: Parts that stand before, inside and after the main text of mixed pages.
BEFORE = [
    "", f"<nav>{_NAV}</nav>", "<div class=ad>x9</div>", "<header><a href=/>x1</a><p>x6</p></header>", "<div id=cookie-notice>x14 <a href=p>x2</a></div>", "<div class=menu>x3</div>",
    "<p><a href=1>x1</a> <a href=2>x1</a> <a href=3>x1</a></p>", "<div class=banner>x20</div>", "<div><a href=1>x2</a></div>", "<div class=site-header>x5 <p>x7</p></div>", "<div class=header><p>x18</p></div>", "<div class=alert>x26</div>", "<div class=sidebar><p>x18</p></div>",
]
INSIDE = ["<p>m40</p>", "<p>m2</p>", "<p>m1</p>", "<h2>m3</h2>", "<p>m17</p>", "<ul><li>m1</li><li>m6</li></ul>", "<p>m20 <a href=1>m2</a> m5</p>", "<blockquote>m12</blockquote>", "<p>m5</p>", "<p>m70</p>", "<p>m4 <a href=1>m2</a> m2</p>", "<p>m1 <a href=1>m1</a> m9</p>", "<div class=header><h3>m4</h3></div>"]
WITHIN = ["", "", "<div class=ad>x8</div>", "<aside><p>x15</p></aside>", "<form><p>x6</p></form>", "<div class=share>x2</div>"]
AFTER = [
    "<footer>x8 <a href=1>x1</a></footer>", "<footer><p>x1</p><p>x24</p></footer>", "<aside><h3>x1</h3><p>x30</p></aside>", "<section class=comments><h3>x2</h3><p>x40</p><p>x3</p><p>x22</p></section>",
    "<div class=related><a href=1>x4</a></div>", "<form><p>x11</p></form>", "<p><a href=1>x3</a></p>", "<div class=disclaimer>x35</div>", "<div><a href=1>x1</a> <a href=2>x1</a></div>",
]
#: Containers of the main text; those without a name begin and end with a long block.
AROUND = [("<article>", "</article>"), ("<main>", "</main>"), ("<div class=article-body>", "</div>"), ("<div class=c1><p>m35</p>", "<p>m30</p></div>"), ("<p>m42</p>", "<p>m28</p>")]


def _mixed(r: random.Random) -> str:
    start, end = r.choice(AROUND)
    inside = "".join(r.choice(INSIDE) for _ in range(r.randrange(1, 10)))
    if "<p>" not in start:
        inside = "<h1>m5</h1>" * r.randrange(2) + inside + r.choice(WITHIN) + r.choice(INSIDE)
    return "".join(r.sample(BEFORE, r.randrange(1, 4))) + start + inside + end + "".join(r.sample(AFTER, r.randrange(1, 4)))


def filled_pages(times: int = 4, mixed: int = 600, seed: int = 3) -> list[str]:
    """Every layout `times` times and `mixed` pages of parts, lengths above two words scaled by chance; words of
    main text start with m."""
    out = []
    pages = [(layout, turn) for layout in LAYOUTS for turn in range(times)]
    pages += [(_mixed(random.Random(f"{seed}/mixed/{k}")), 1) for k in range(mixed)]
    for k, (layout, turn) in enumerate(pages):
        r = random.Random(f"{seed}/{k}")

        def words(m: re.Match, r: random.Random = r, turn: int = turn) -> str:
            n = int(m[2])
            if turn and n > 2:
                n = max(2, round(n * r.choice((0.5, 0.7, 1, 1.4, 2))))
            return " ".join(m[1] + "".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 8))) for _ in range(n))

        out.append(re.sub(r"\b([mx])(\d+)\b(?![^<]*>)", words, layout))
    return out
