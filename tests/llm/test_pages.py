import hashlib
import html
import random

import pytest

from boxwright.llm import html_extraction, warc

SCHEMA = "page_id bigint, url string, html string, extra int"


def extracted(spark, pages):
    rows = [(i, f"http://h/{i}", p, 0) for i, p in enumerate(pages)]
    return {r["page_id"]: r for r in html_extraction.extract(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_article_without_its_surroundings(spark):
    page = '<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href="/a">home</a></li><li><a href="/b">news</a></li></ul></nav><!-- ad --><div class="ad">buy this now</div><article><h1>A title</h1><p><b>First&nbsp;part &amp; more.<br><p>Second   part,\n of the text, goes on here for a while.</article><footer>&copy; someone</footer>'
    got = extracted(spark, [page, None, "", "plain words"])
    assert got[0]["text"] == "A title First part & more. Second part, of the text, goes on here for a while."
    assert got[0]["n_chars"] == len(got[0]["text"])
    assert got[1]["text"] == got[2]["text"] == ""
    assert html_extraction.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_held_out_accuracy():
    """Templates not used in training: the main text's words, found and true."""
    model = html_extraction.trained()
    right = wrong = missed = 0
    for page in html_extraction.training_pages(80, seed=99):
        nodes, events = html_extraction.parse(page)
        x, y = html_extraction.labelled(page)
        kept = html_extraction.decode(nodes, model.score(html_extraction.features(nodes)))
        said = html_extraction.text_of(events, kept).split()
        truth = html_extraction.text_of(events, _main(page, nodes)).split()
        a, b = list(said), list(truth)
        both = len(set(a) & set(b))
        right += both
        wrong += len(set(a) - set(b))
        missed += len(set(b) - set(a))
        assert len(x) == len(y)
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.97


def _main(page, nodes):
    import re

    marks = [m[1] for m in re.finditer(r'<[a-z][^>]*?(?:data-main="([01])")?>', page)]
    keep = [False] * len(nodes)
    for i, x in enumerate(nodes[1:], 1):
        own = marks[i - 1]
        keep[i] = own == "1" or (own is None and keep[x.parent])
    return keep


def test_no_element_is_kept_in_a_rejected_one():
    import numpy as np

    for page in html_extraction.training_pages(10, seed=5):
        nodes, _ = html_extraction.parse(page)
        kept = html_extraction.decode(nodes, np.random.default_rng(1).normal(size=len(nodes)))
        assert all(kept[x.parent] or not kept[i] for i, x in enumerate(nodes) if i)


def test_long_and_broken_pages(spark):
    long = "<article>" + "<p>word one, and two more.</p>" * 20_000 + "</article>"
    deep = "<div>" * 3000 + "text" + "</div>" * 2990
    got = extracted(spark, [long, deep, "<p <b <i", "<!-- never closed <p>x", "a < b and c > d &lt;i&gt;"])
    assert got[0]["n_chars"] == 20_000 * len("word one, and two more. ") - 1
    assert len(got) == 5


@pytest.fixture(scope="module")
def pages():
    r = random.Random(1)
    body = lambda n: "<p>" + " ".join(r.choice("alpha beta gamma é 日本".split()) for _ in range(n)) + "</p>"
    same, short = body(60), "<p>short</p>"
    out = [(i, f"http://h/{i}", body(r.randint(1, 300)), 0) for i in range(40)]
    out += [(100 + i, "http://h/x y", same, 0) for i in range(7)] + [(200 + i, None, short, 0) for i in range(3)] + [(300, "u", None, 0), (301, "u", "", 0), (302, "u", "\r\n\r\nWARC/1.1\r\n" * 40, 0), (303, "u", "z" * 300_000, 0)]
    return out


def test_archives_round_trip(spark, pages, tmp_path):
    df = spark.createDataFrame(pages, SCHEMA).repartition(3)
    path = f"file://{tmp_path}/archives"
    warc.write_archives(df, path)
    got = {r["page_id"]: r for r in warc.read_archives(spark, path, keep_payload=True).collect()}
    assert set(got) == {p[0] for p in pages}
    first = {}
    for i, _, h, _ in sorted(pages):
        b = (h or "").encode()
        first.setdefault(b, i)
        again = len(b) >= 100 and first[b] != i
        g = got[i]
        assert (g["payload_bytes"], g["payload_digest"]) == (len(b), hashlib.sha256(b).hexdigest())
        assert (g["record_type"], g["refers_to"]) == (("revisit", first[b]) if again else ("response", None))
        assert bytes(g["payload"]) == (b"" if again else b)
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_changed_archive_is_refused(spark, pages, tmp_path):
    record = warc.format_record("response", 1, "u", b"body", hashlib.sha256(b"body").hexdigest(), None)
    assert warc.parse_record(record)["payload"] == b"body"
    for bad in (record[:-1], record.replace(b"body", b"bodx"), record.replace(b"WARC/1.1", b"WARC/1.x"), record.replace(b"\r\n\r\nbody", b"\r\n\r\nbodybody")):
        with pytest.raises(ValueError):
            warc.parse_record(bad)
    with pytest.raises(ValueError):
        list(warc.frames(b"\x28\xb5\x2f\xfdxxxx"))


def test_entities_are_decoded():
    assert html_extraction.text_of([(0, "a &lt; b &#233;")], [True]) == "a < b é" == html.unescape("a &lt; b &#233;")


def test_equal_siblings_are_counted_on_long_pages():
    from boxwright.llm.html_extraction import features, parse

    def column(page):
        nodes = parse(page)[0]
        at = next(i for i, x in enumerate(nodes) if x.tag == "h1")
        return features(nodes)[at], len(nodes[nodes[at].parent].children)

    short, few = column("<body><h1>a</h1>" + "<p>b</p>" * 3 + "</body>")
    long, many = column("<body><h1>a</h1>" + "<p>b</p>" * 300 + "</body>")
    at = [i for i in range(len(short)) if short[i] == few and long[i] == many][0] + 1
    assert (few, many) == (4, 301) and short[at] == long[at] == 1.0


def test_broken_pages_take_time_as_their_length():
    import time

    for piece in ("<a ", '<a href="', "<a '\">", "<", "<!-", "<div></b>", "<b><p>x"):
        began = time.perf_counter()
        html_extraction.parse(piece * (400_000 // len(piece)) + ">")
        assert time.perf_counter() - began < 20, piece


def test_references_end_with_their_element():
    nodes, events = html_extraction.parse("<p>&<b>amp;</b> &lt; x</p>")
    assert html_extraction.text_of(events, [True] * len(nodes)) == "&amp; < x"


def test_archives_of_null_keys_and_odd_urls(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "PER_ARCHIVE", 5)
    urls = ["http://a/b c", "http://é/\n", None, "http://plain/%20"]
    rows = [(i if i % 7 else None, urls[i % 4], "same " * 40 if i % 2 else f"page {i}") for i in range(40)]
    path = f"file://{tmp_path}/archives"
    got = warc.round_trip(spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(2), path)
    back = sorted(((r["page_id"] or -1, r["url"] or "", r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got.collect()), key=str)
    kind = lambda i, h: ("revisit", 1) if i and i != 1 and len(h) > 99 else ("response", None)
    assert back == sorted(((i or -1, u or "", len(h), *kind(i, h)) for i, u, h in rows), key=str)
    assert spark.read.format("binaryFile").load(path).where("path like '%part-%'").count() >= 8
