import html as h

import pytest

from pastward.llm import html_text as H

FILL = "Some words of a paragraph that belongs to the article, and more of them."


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body class='has-sidebar'>{body}</body></html>"


@pytest.mark.parametrize("body, expected", [
    (f"<nav><a href=x>Home</a></nav><article><h1>Title</h1><p>{FILL}</p></article><footer>c</footer>", f"Title {FILL}"),
    (f"<div id='topMenu'><a>One two three</a></div><div><h1>Title</h1><p>{FILL}</p></div><div class='site-footer'>x y z</div>", f"Title {FILL}"),
    (f"<article><p>a <b>b</b>c&nbsp;&amp;&#233;\n d</p><div class=ad>Buy this now</div><p>{FILL}<br>e</article>", f"a bc &é d {FILL} e"),
    (f"<main><p>{FILL}</p><form>Name <input></form><aside>see also</aside><section id=comments><p>{FILL} I agree!</p></section></main>", FILL),
    (f"<script>var t='</p>';</script><style>p{{x}}</style><!-- {FILL} --><p>{FILL}</p><script>never closed", FILL),
    (f"<div class='cookie-notice' hidden>{FILL}</div><p>{FILL}</p>", FILL),
    ("", ""), ("<nav>only a menu here</nav>", ""),
])
def test_main_text(body, expected):
    assert H.main_text(page(body), {}) == expected


def test_best_stretch_is_the_greatest_sum():
    import itertools
    import random

    draw = random.Random(1)
    for _ in range(200):
        scores = [draw.randrange(-5, 6) for _ in range(draw.randrange(0, 12))]
        low, high = H.best_stretch(scores)
        most = max([0, *(sum(scores[a:b]) for a, b in itertools.combinations(range(len(scores) + 1), 2))])
        assert sum(scores[low:high]) == most


def test_learned_weights_and_query_rows(spark):
    rows = [(k, f"u{k}", page(f"<div><p>x y z</p></div><article><h1>Head {k}</h1><p>{h.escape(FILL)} {k} &lt;</p></article><div><p>q r</p></div>")) for k in range(30)]
    rows += [(30, None, None), (31, "u", ""), (None, "u", rows[0][2]), (3, "u3", rows[3][2]), (40, "long", page("<article>" + f"<p>{FILL}</p>" * 5000 + "</article>"))]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    weights = H.learn_weights(pages)
    assert weights["word h1"] > 0 > weights["tag div"]
    got = H.extracted(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    out = got.collect()
    assert len(out) == len(rows)
    for r in out:
        expected = f"Head {r['page_id'] or 0} {FILL} {r['page_id'] or 0} <" if (r["page_id"] or 0) < 30 else "" if r["page_id"] < 40 else " ".join([FILL] * 5000)
        assert (r["text"], r["n_chars"]) == (expected, len(expected))
    assert H.extracted(pages.limit(0)).collect() == []


@pytest.mark.parametrize("body, expected", [
    *[(f"<nav>Home</nav><div class='{name}'><article><p>{FILL}</p></article></div>", FILL) for name in ("site-content no-sidebar", "with-sidebar", "content widget", "social-science")],
    *[(f"<p>Not this</p><{mark}><h1>T</h1><p>{FILL}</p></{mark.split()[0]}>", f"T {FILL}") for mark in ("article class='post has-comments'", "main id='comments'", "article class='social-science'")],
    *[(f"<article><p>{FILL}</p><h2 id='{name}'>Head</h2><p id='{name}'>{FILL}</p></article>", f"{FILL} Head {FILL}") for name in ("related-work", "search", "notice", "share-price")],
    *[(f"<article><p>{FILL}</p><section id='{name}'><h2>Head</h2><p>a b</p></section></article>", f"{FILL} Head a b") for name in ("related-work", "search", "notice", "share-price", "discussion")],
    (f"<div class='page-widget'><p>{FILL}</p></div>", FILL),
    (f"<article><p>{FILL} <math><mi>x</mi></math></p></article>", f"{FILL} x"),
    (f"<main><article><p>{FILL}</p></article><div id='comments'><article class='comment-body'><p>{FILL} {FILL} {FILL}</p></article></div></main>", FILL),
    (f"<article><p>{FILL}</p><div class='share-buttons'>x</div><div class='related-posts'>y</div><div class=ad>Buy</div></article>", FILL),
])
def test_names_that_do_not_remove_an_article(body, expected):
    assert H.main_text(page(body), {}) == expected
