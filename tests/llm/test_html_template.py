"""The template of a host: blocks and containers with equal occurrence vectors, against vectors written out in full."""

from collections import defaultdict

from detlake.llm import html_templates as H

NOTE = "<p>Thank you for reading the gazette.</p>"


def _page(i, extra=""):
    rows = "".join(f"<div class='step'><p>Share this part</p><p>Step {i}-{k}</p></div>" for k in range(i % 3))
    note = "<div class='sup'><p>Members saw it first.</p></div>" if i % 2 else ""
    return f"<body><div class='x'><article><h1>Title {i}</h1>{NOTE}<p>Body {i} in many words of its own.</p>{rows}{note}{extra}<p>Common to some.</p></article></div></body>"


def _frame(spark, rows):
    return spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(rows)], "page_id long, url string, html string")


def _texts(spark, rows):
    return {r.page_id: r.text for r in H.extract(_frame(spark, rows)).collect()}


def _brute(pages):
    """Blocks whose counts per page equal those of their container, behind enough different pages."""
    containers, texts = defaultdict(dict), defaultdict(dict)
    for i, page in enumerate(pages):
        found, tree = H.blocks(page)
        for role, _, off in tree:
            if not off:
                containers[role][i] = containers[role].get(i, 0) + 1
        for c, text in found:
            key = tree[c][0], text
            texts[key][i] = texts[key].get(i, 0) + 1
    valid = [k for k, v in texts.items() if v == containers[k[0]] and len({pages[i] for i in v}) >= H.PAGES and len(v) >= H.SUPPORT * len(pages)]
    return sorted(H._token(*k) for k in valid)


def test_template_equals_vectors_written_out(spark):
    pages = [_page(i, "<p>Only on page seven.</p>" if i == 7 else "") for i in range(60)]
    row = H.templates(_frame(spark, [(f"http://a.example/{i}", p) for i, p in enumerate(pages)]).selectExpr("url", "encode(html, 'utf-8') AS data")).first()
    assert row.template == _brute(pages) and len(row.template) == 4 and row.slot.endswith("/article")


def test_fixed_text_goes_and_all_else_stays(spark):
    got = _texts(spark, [(f"http://a.example/{i}", _page(i, "<p>Seven.</p>" if i == 7 else "")) for i in range(60)])
    assert got[7] == "Title 7\nBody 7 in many words of its own.\nStep 7-0\nSeven."
    assert got[6] == "Title 6\nBody 6 in many words of its own."
    # the same rows three times change nothing
    again = _texts(spark, [(f"http://a.example/{i}", _page(i, "<p>Seven.</p>" if i == 7 else "")) for i in range(60)] * 3)
    assert [again[i] for i in range(60)] == [got[i] for i in range(60)] and again[127] == got[7]


def test_copies_and_small_hosts_prove_no_template(spark):
    rows = [("http://copies.example/", _page(4))] * 40 + [(f"http://small.example/{i}", _page(i)) for i in range(5)]
    got = _texts(spark, rows)
    assert all("Thank you" in got[i] and "Common" in got[i] for i in range(45))


def test_an_article_in_sibling_containers_keeps_them_all(spark):
    page = "<body><div class='top'>Site name</div><div class='content'><div class='lead'><p>Lead {0} {1}</p></div><div class='text'><p>{2}</p></div><div class='end'><p>End {0} {1}</p></div></div></body>"
    rows = [(f"http://b.example/{i}", page.format(i, "few words " * 4, f"middle {i} " * 12)) for i in range(20)]
    got = _texts(spark, rows)
    for i in range(20):
        assert got[i] == "\n".join([f"Lead {i} " + " ".join(["few words"] * 4), " ".join([f"middle {i}"] * 12), f"End {i} " + " ".join(["few words"] * 4)])


def test_null_empty_and_template_only_pages(spark):
    rows = [(None, None), ("http://c.example/", ""), (None, "<p>No host</p>")] + [(f"http://c.example/{i}", f"<body><article><p>Sorry.</p><!-- {i} --></article></body>") for i in range(80)]
    got = _texts(spark, rows)
    assert got[0] == got[1] == "" and got[2] == "No host" and got[40] == "Sorry."
