"""The precision view of pages against a recursive brute force, on pages of known content, and on odd ones."""

import random

from pyspark.sql import functions as F

from factloom.operators import html as H

LONG = "This sentence is long enough to count as a paragraph of its own, number {}."


def text(page):
    return H.precise_text(H.Tree(page).root)


def test_main_text_without_boilerplate():
    body = "".join(f"<p>{LONG.format(i)} <a href='/{i}'>more</a></p>" for i in range(12))
    links = "".join(f"<li><a href='/t{i}'>A link to another story of this site, number {i}</a></li>" for i in range(15))
    page = f"""<html><head><title>T</title></head><body><nav><p>{LONG}</p></nav><div class='top ads'>Buy this product now, it is good for all of us.</div>
    <div><div><h1>Head</h1>{body}<table><tr><th>k</th><th>v</th></tr><tr><td>a</td><td>1</td></tr></table><h2>Nothing below</h2></div><div><ul>{links}</ul></div></div>
    <div id="related-stories"><p>{LONG.format("r")}</p></div><p style="display: none">{LONG.format("h")}</p><footer>{LONG.format("f")}</footer></body></html>"""
    want = ["Head", *[f"{LONG.format(i)} more" for i in range(12)], "k | v", "a | 1"]
    assert text(page).split("\n\n") == want


def test_text_right_in_a_holder_and_parts_of_an_article():
    assert text(f"<body><div>{LONG.format(1)}<br>{LONG.format(2)}</div><div><a href='x'>{LONG.format(3)}</a></div></body>") == f"{LONG.format(1)} {LONG.format(2)}"
    parts = "".join(f"<section><h2>Part {i}</h2>{f'<p>{LONG.format(i)}</p>' * n}</section>" for i, n in ((1, 1), (2, 1), (3, 1)))
    assert text(f"<body><article>{parts}</article></body>").split("\n\n") == [x for i in (1, 2, 3) for x in (f"Part {i}", LONG.format(i))]


def test_odd_pages(spark):
    assert [text(x) for x in ("", "   ", "<nav>a</nav>", "<a href='x'>only a link</a>", "<p>short</p>", "<div hidden>" + LONG + "</div>")] == [None] * 6
    deep = "<div>" * 30_000 + f"<p>{LONG}</p>" + "</div>" * 30_000
    assert text(deep) == LONG
    stairs = "".join(f"<div>{LONG.format(i)}" for i in range(20_000))  # every holder has text of its own
    assert 17_900 < text(f"<body>{stairs}").count("sentence is") < 20_000  # from where nine tenths are inside
    p = spark.createDataFrame([(1, None, None), (2, "", "u"), (3, f"<body><p>{LONG}</p></body>", None)], "page_id int, html string, url string")
    assert [r[0] for r in p.orderBy("page_id").select(H.html_document("html", "url")["precise"]).collect()] == [None, None, LONG]


def brute(page):
    """The same definition by recursion: every holder's sum is taken anew from the runs below it."""
    found, outer = H._runs(H.Tree(page).root)
    path = lambda h: (*path(outer[h]), h) if h else (0,)
    runs = [(t, n, path(h), k) for t, n, h, k in found]
    good = [3 * n <= len(t) and (k == "heading" or (k == "row" and " | " in t) or len(t) >= 40 or t.endswith(H.SENTENCE_ENDS)) for t, n, _, k in runs]
    value = [0 if g and k == "heading" else len(t) - 2 * n if g else -n for g, (t, n, _, k) in zip(good, runs, strict=True)]
    paths = {a[: i + 1] for _, _, a, _ in runs for i in range(len(a))}
    total = {p: sum(v for v, r in zip(value, runs, strict=True) if r[2][: len(p)] == p) for p in paths}
    most = max(total.values(), default=0)
    if most <= 0:
        return None
    main = sorted((p for p in paths if 10 * total[p] >= 9 * most), key=lambda p: (-len(p), -total[p], p))[0]
    inside = [r for r, g in zip(runs, good, strict=True) if g and r[2][: len(main)] == main]
    kept = [r[0] for i, r in enumerate(inside) if r[3] != "heading" or any(x[3] != "heading" for x in inside[i + 1 :])]
    return "\n\n".join(dict.fromkeys(kept)) or None


def test_equals_brute_force_on_random_trees():
    rng = random.Random(5)

    def tree(level):
        if level == 0 or rng.random() < 0.25:
            return " ".join(rng.choice(["one", "other", "words.", "ends", "here!"]) for _ in range(rng.randrange(1, 25)))
        name = rng.choice(["div", "section", "p", "a", "li", "ul", "h2", "span", "table", "tr", "td", "article", "nav"])
        extra = " class='share-bar'" if rng.random() < 0.05 else ""
        return f"<{name}{extra}>" + "".join(tree(level - 1) for _ in range(rng.randrange(1, 5))) + f"</{name}>"

    pages = [f"<body>{''.join(tree(5) for _ in range(3))}</body>" for _ in range(300)]
    assert [text(p) for p in pages] == [brute(p) for p in pages]
    assert sum(text(p) is not None for p in pages) > 200


def test_pages_of_the_test_tables(spark):
    p = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    ad = F.regexp_extract("html", "(?s)<div class=\"ad\">([^<]{12,})</div>", 1)
    first = F.regexp_extract("html", "(?s)</p><p>([^<&]{60,})</p>", 1)
    r = p.select(ad.alias("ad"), first.alias("first"), H.html_document("html", "url")["precise"].alias("t")).collect()
    assert r and all(x["t"] for x in r)
    assert not any(x["ad"] and x["ad"].split("\n")[0] in x["t"].split("\n\n") for x in r) and not any("©" in x["t"] for x in r)
    assert all(" ".join(x["first"].split()) in x["t"] for x in r if x["first"]) and any(x["first"] for x in r)


def test_blocks_have_labels_and_citations():
    d = H.parse_page("<body><article><table><tr><th>k</th><th>v</th></tr><tr><td>a</td><td>1</td></tr></table><blockquote cite='http://e.org'>Q</blockquote><blockquote>R</blockquote><a rel='author' href='/x'>Name</a><time datetime='2024-01-02'>then</time></article></body>", None)
    assert [(b["column_labels"], b["quote_citation"]) for b in d["blocks"]] == [(["k", "v"], None), (["k", "v"], None), (None, "http://e.org"), (None, None)]
    assert d["author"] == "Name" and d["published_at"] == "2024-01-02"
