"""Content regions by smoothed text-to-tag ratio, corrected by marks."""

import random

import numpy as np
import pytest

from helixtab.llm import html_extract as H

SENTENCE = "Some words of a long enough paragraph, which goes on for a while. "
P = f"<p>{SENTENCE * 4}</p>"
TEXT = (SENTENCE * 4).strip()


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<body><form><article>{P}<p>short</p></article></form></body>", f"{TEXT}\nshort"),
        (f"<body><form><div>{P}{P}<p>end.</p></div></form></body>", f"{TEXT}\n{TEXT}\nend."),
        (f"<aside><article>{P}</article></aside>", TEXT),
        (f"<noscript><article>{P}</article></noscript>", TEXT),
        (f"<article>{P}</article><article class='comment'>{P}</article>", TEXT),
        (f"<article>{P}</article><form>{P}</form><aside>{P}</aside>", TEXT),
        ("<article><p>where <math><mi>x</mi></math> is large, <button>press</button> it</p><button>Buy</button></article>", "where x is large, press it"),
        ("<article><p>a<svg><text>no</text></svg>b <select><option>c</option></select>d</p></article>", "ab d"),
        (f"<main>{P}</main><section class='more-stories'><article><p>Card</p></article></section>", TEXT),
        (f"<article>{P}{P}</article><aside><article>{P}</article></aside>", f"{TEXT}\n{TEXT}"),
        (f"<article>{P}</article><article>{P}<p>two</p></article>", f"{TEXT}\n{TEXT}\ntwo"),
        (f"<ul><li><a>Home</a></li><li><a>About us</a></li></ul>{P}{P}<p>Copyright 2020 Example</p>", f"{TEXT}\n{TEXT}"),
        (f"<h1>Title</h1>{P}<p>So.</p>{P}<ul><li><a>An author, a title of some words, 2001</a></li><li><a>Another author, another title, 2002</a></li><li><a>A third one, a last title, 2003</a></li></ul><p>Bye.</p>",
         f"Title\n{TEXT}\nSo.\n{TEXT}\nAn author, a title of some words, 2001\nAnother author, another title, 2002\nA third one, a last title, 2003\nBye."),
        ("<p>one</p>", "one"), ("", ""), (None, ""), ("<script>x</script>", ""),
    ],
)
def test_probes(html, text):
    assert H.main_text(html) == text


def made_up(rng):
    """A page without article or main: menus, paragraphs of many lengths with inline tags, copyright."""
    words = lambda n: " ".join(rng.choice(("alpha", "beta", "gamma", "delta", "of", "the")) for _ in range(n))
    menu = lambda n: "<ul>" + "".join(f"<li><a href='#'>{words(rng.randrange(1, 4))}</a></li>" for _ in range(n)) + "</ul>"
    body = "".join(rng.choice((f"<p>{words(rng.randrange(1, 90))}</p>", f"<p>{words(9)} <b>{words(2)}</b> <a href='#'>{words(3)}</a></p>", f"<h2>{words(3)}</h2>", f"<div><a href='#'>{words(rng.randrange(1, 9))}</a></div>", menu(2))) for _ in range(rng.randrange(1, 14)))
    return f"<html><body>{menu(rng.randrange(0, 6))}<div>{body}</div>{menu(rng.randrange(0, 4))}<p>{rng.choice(('© 2020', 'Copyright notes', 'End'))}</p></body></html>"


def lines_of(html):
    parser = H.Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    parser.close_to(0)
    return parser.lines


def plain(lines):
    """Ratio, smoothing and two means with numpy; the region by positions."""
    ratio = np.array([len(x.text) / max(1, x.tags) for x in lines])
    kernel = np.exp(-(np.arange(-3, 4) ** 2) / 2)
    smooth = np.convolve(ratio, kernel)[3:-3] / np.convolve(np.ones(len(ratio)), kernel)[3:-3]
    low, high = smooth.min(), smooth.max()
    dense = np.ones(len(lines), bool)
    for _ in range(30):
        cut = (low + high) / 2
        dense = smooth > cut
        if dense.all() or not dense.any():
            return np.ones(len(lines), bool)
        new = smooth[~dense].mean(), smooth[dense].mean()
        if new == (low, high):
            break
        low, high = new
    return smooth > (low + high) / 2


def expected(lines):
    dense = plain(lines)
    short = [False, *(x.linked >= 0.9 and len(x.text.split()) <= 4 for x in lines), False]
    off = [(short[k + 1] and (short[k] or short[k + 2])) or (len(x.text) < 200 and x.text.lower().startswith(("©", "(c)", "copyright "))) for k, x in enumerate(lines)]
    at = np.flatnonzero(dense & ~np.array(off))
    return "\n".join(x.text for k, x in enumerate(lines) if (len(at) and at[0] <= k <= at[-1]) or not off[k])


def test_pages_without_article_equal_a_plain_version():
    """The threshold decides: taking every line as dense gives something else on most pages."""
    rng, changed = random.Random(11), 0
    for _ in range(200):
        html = made_up(rng)
        lines = lines_of(html)
        text = H.main_text(html)
        assert text == expected(lines)
        changed += text != "\n".join(x.text for x, c in zip(lines, H.content(lines, [True] * len(lines)), strict=True) if c)
    assert changed > 100


def test_the_threshold_decides_between_articles():
    """Teasers in articles of their own: the dense one is chosen."""
    rng, changed = random.Random(12), 0
    for _ in range(200):
        cards = "".join(f"<article><h3><a href='#'>{'Read ' * rng.randrange(1, 4)}</a></h3></article>" for _ in range(rng.randrange(0, 4)))
        html = f"<div>{cards}</div><article>{P * rng.randrange(3, 7)}</article>"
        assert H.main_text(html) == "\n".join([TEXT] * html.count("<p>"))
        lines = lines_of(html)
        changed += any(not c for c in H.content(lines, [d > 0 for d in plain(lines)])) and all(H.content(lines, [True] * len(lines)))
    assert changed > 100


def test_given_pages_by_the_plain_clusters(spark, sf):
    """Ratios, smoothing and threshold of every given page by the plain version choose the same lines."""
    for r in spark.read.parquet(f"{sf}/pages.parquet").select("html").collect():
        lines = lines_of(r["html"] or "")
        if lines:
            assert H.main_text(r["html"]) == "\n".join(x.text for x, c in zip(lines, H.content(lines, plain(lines).tolist()), strict=True) if c)


def test_table_edge_cases(spark):
    rows = [(None, "u", "<p>null id</p>"), (1, None, None), (2, "v", f"<article>{P}</article>"), (2, "v", f"<article>{P}</article>")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = sorted(map(tuple, H.extract(df).collect()), key=str)
    assert got == sorted([(None, "u", "null id", 7), (1, None, "", 0), (2, "v", TEXT, len(TEXT)), (2, "v", TEXT, len(TEXT))], key=str)
    assert H.extract(df.limit(0)).count() == 0
