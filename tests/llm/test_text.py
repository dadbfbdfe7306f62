"""Decontamination, extraction, tokens, scores, fingerprints and languages."""

import hashlib
import random
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sessionlab.llm import html_extract
from sessionlab.llm.context_tree import DEPTH, context_tree_scores
from sessionlab.llm.decontaminate import decontaminate, leaks
from sessionlab.llm.html_extract import Wrapper, bytes_of, extract, main_text, rules
from sessionlab.llm.language_id import language_id
from sessionlab.llm.piecewise import fingerprint_neighbours
from sessionlab.llm.queries import TOKENIZERS
from sessionlab.llm.sentencepieces import decode, encode, read_model
from sessionlab.llm.windows import document_key
from tests.llm.brute import context_tree

SF = "/root/testdata/sf0.001"
ODD = [(9001, None), (9002, ""), (9003, "é"), (9004, "X x\tx"), (9005, "12 34")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_leaks_of_planted_passages(spark):
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    items = [(i, [word() for _ in range(draw.randrange(15, 40))]) for i in range(20)] + [(99, ["too", "few"])]
    rows, want = [], set()
    for i in range(60):
        text = [word() for _ in range(draw.randrange(200))]
        item, words = items[i % 20]
        if i % 3 == 0:
            changed = list(words)
            for p in draw.sample(range(13), 2):
                changed[p] = "zzz"  # two misses in the first thirteen
            text[len(text) // 2 : len(text) // 2] = [w.upper() + "," for w in changed]
            want.add((i, item))
        elif i % 3 == 1:
            text += words[:7]  # too short to count
        rows.append((i, " ".join(text)))
    rows += [(100, None), (101, ""), (None, " ".join(items[0][1])), (0, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"item_id": F.lit(1), "seed": F.lit(2), "words": F.lit(3)})
    bench = spark.createDataFrame([*((i, " ".join(w)) for i, w in items), (50, None), (None, "x")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaks(docs, bench).collect()} == want
    kept = decontaminate(docs, bench)
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r[0] for r in rows} - {d for d, _ in want}
    assert leaks(docs.limit(0), bench).count() == 0 and leaks(docs, bench.limit(0)).count() == 0


PAGE = """<!doctype html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header><h2>Site</h2></header>
<nav><ul><li><a href=/a>A {i}</a><li><a href=/b>B</a></ul></nav><!-- x > y --><div class="ad">Buy {i}</div>
<{main}><h1>Head {i} &amp; more</h1><p>First   <b>bold<br>line</b> {i}&nbsp;&lt;x&gt;.<p>Second {i}</p>{extra}<div class="share">Share this</div><form><p>Mail</p><input name=q></form>
<section class="comments"><p>A reader {i}</p></section></{main}><aside>Side {i}</aside><footer>&copy; {i}</footer>"""


@pytest.mark.parametrize("main", ["article", "div class=body"])
def test_extraction(spark, main):
    rows = [(i, f"http://h.example/{i}", PAGE.format(i=i, main=main, extra="<p>Only here</p>" * (i % 2)).replace("</div class=body>", "</div>")) for i in range(8)]
    rows += [(100, "http://other.example/", None), (101, None, "<p>Just text &eacute;"), (102, "http://other.example/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "wrapper": F.lit(2)})
    got = {r.page_id: (r.text, r.n_chars) for r in extract(pages).collect()}
    for i in range(8):
        want = f"Head {i} & more\n\nFirst bold line {i} <x>.\n\nSecond {i}" + "\n\nOnly here" * (i % 2)
        assert got[i] == (want, len(want))
    assert got[100] == ("", 0) and got[101] == ("Just text é", 11) and got[102] == ("", 0)
    assert extract(pages.limit(0)).count() == 0


def extracted(spark, pages):
    rows = [(i, f"http://h.example/{i}", page) for i, page in enumerate(pages)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    return [got[i] for i in range(len(rows))]


def test_extraction_drops_nothing_by_its_share(spark):
    long, short = "word " * 60, "other " * 15
    pages = [f"<body><div class=post><h1>Head {i}</h1><p>Intro {i}</p><div class=entry><p>{long}{i}</p></div><div class=more><p>{short}{i}</p></div></div><p>Same" for i in range(4)]
    assert extracted(spark, pages) == [f"Head {i}\n\nIntro {i}\n\n{long}{i}\n\n{short}{i}" for i in range(4)]


def test_shared_text_is_what_all_pages_show(spark):
    """Places and labels that only some pages have are their own text, however many pages the host has."""
    pages = [f"<body><article id=post-{i} class='post-{i} entry'><h1>Head</h1><p>Text {i}</p><div>Signed</div></article>" for i in range(5)]
    pages[2] = pages[2].replace("<div>", "<table><tr><td>Cell</table><blockquote>Said</blockquote><div>")
    pages[3] = pages[3].replace("<div>", "<ul><li>Both</ul><div>")
    pages[4] = pages[4].replace("<div>", "<ul><li>Both</ul><div>")
    assert extracted(spark, pages) == ["Text 0", "Text 1", "Text 2\n\nCell\n\nSaid", "Text 3\n\nBoth", "Text 4\n\nBoth"]
    pages = [f"<div class=ad>Buy {i}</div><div id=p{i}><p>Only text</div>" for i in range(4)]  # one page, fetched four times
    assert extracted(spark, pages) == ["Only text"] * 4
    pages = [f"<div class=slug-{'abcd'[i]}><h1>Head {i}</h1><p>Text</div>" for i in range(3)]
    assert extracted(spark, pages) == [f"Head {i}\n\nText" for i in range(3)]


def test_what_a_host_sends_to_its_pages_is_bounded(spark, monkeypatch):
    """Page-specific labels and texts of a hot host stay out of its row; only what all pages show is in it."""
    pages = [f"<article id=post-{i} class=post-{i}><h1>Head</h1>" + "".join(f"<div id=d{i}-{j} class='only{i}-{j}'>Text {i} {j}</div>" for j in range(20)) + "</article>" for i in range(60)]
    rows = spark.createDataFrame([(1, page) for page in pages], "host long, html string")
    (found,) = rules(rows).collect()
    assert len(found.shared) == 1 and found.confirmed == [] and bytes_of(rules(rows)) == 48 and bytes_of(rules(rows.limit(0))) == 0
    want = ["\n\n".join(f"Text {i} {j}" for j in range(20)) for i in range(60)]
    assert extracted(spark, pages) == want
    monkeypatch.setattr(html_extract, "BROADCAST_BYTES", 0)
    assert extracted(spark, pages) == want


@pytest.mark.parametrize("page", [
    "<body class='has-sidebar'><p>Text {i}", "<div class='layout no-sidebar'><p>Text {i}</div>", "<div class='page sticky-header'><p>Text {i}</div>", "<article class='post comments-open'>Text {i}</article>",
    "<div style='overflow:hidden'>Text {i}</div>", "<div data-id='share-1' title='id=ad class=ad hidden'>Text {i}</div>", "<body class=share><article class=widget>Text {i}</article>",
    "<div class=widget><main>Text {i}</main></div>", "<div class=widget><div class=ad>Buy</div><article>Text {i}</article></div>", "<div class=widget>Text {i}</div>"])
def test_marks_leave_the_text(spark, page):
    assert extracted(spark, [page.format(i=i) for i in range(4)]) == [f"Text {i}" for i in range(4)]


def test_marks_are_confirmed_by_other_pages(spark):
    page = "<article>Text {i}</article><div class=related><article>Teaser {i}</article></div>"
    pages = [page.format(i=i) for i in range(4)] + ["<article><div class='big notice'>Main notice</div>Text 4</article>", "<article>Text 5<div hidden>No</div></article>"]
    assert extracted(spark, pages) == ["Text 0", "Text 1", "Text 2", "Text 3", "Main notice\n\nText 4", "Text 5"]


def test_extraction_builds_no_expression(monkeypatch):
    """The expression makes no row of the result, so none is inferred."""
    monkeypatch.setattr(html_extract, "merged", None)
    monkeypatch.setattr(html_extract, "folded", None)
    (rows,) = html_extract.shown([pa.RecordBatch.from_pydict({"host": [1, 1], "html": ["<p>a<p>b", "<p>a<ul><li>c</ul>"]})])
    assert rows.num_rows == 6 and main_text("<p>a<p>b") == "a\n\nb"


def test_wrapper_finds_repeats_and_options():
    first, second = (Wrapper.of(f"<body><div><h1>t</h1>{p}</div>") for p in ("<p>a<p>b", "<p>c<ul><li>d</ul>"))
    first.add(second)
    assert first.group.form() == "(body(div(h1#(),p#()+,ul(li#())?)))"
    assert main_text("<p>x", None) == "x"


def test_tokens_round_trip_and_agree_with_the_library(spark, docs):
    import sentencepiece

    path = f"{TOKENIZERS}/piece_bpe_32k.model"
    library, model = sentencepiece.SentencePieceProcessor(model_file=path), read_model(path)
    odd = [(9001, None), (9002, ""), (9003, "  hello  world\n\tx é𝔘<s>"), (9004, " " * 40 + "x"), (9005, "日本 ñ"), (9006, "x▁y")]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string")).withColumn("keep", F.lit(1))
    done = encode(table, model, ["doc_id", "text"])
    rows = done.collect()
    for r in rows:
        assert r.ids == library.encode(r.text or "") and r.n_tokens == len(r.ids)
        assert r.round_trip == ("▁" not in (r.text or ""))
    assert {r.doc_id: r.text for r in decode(done, model, ["doc_id"]).collect()} == {r.doc_id: (r.text or "").replace("▁", " ") for r in rows}
    assert encode(table.limit(0), model, ["doc_id"]).count() == 0


@pytest.mark.parametrize("block", [20_000, 1 << 24])
def test_context_trees(spark, docs, block):
    rows = [tuple(r) for r in docs.select("doc_id", "text").where("doc_id < 40").collect()] + ODD
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"block": F.lit(1), "key": F.lit(2)})
    want = context_tree(rows, DEPTH)
    got = context_tree_scores(table, block_bytes=block).collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], rel=1e-9) and r.score == pytest.approx(w[5], rel=1e-7)
    assert context_tree_scores(table.limit(0)).count() == 0


def test_fingerprints(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()] + ODD + [(None, "the last"), (9010, "twice " * 50), (9011, "twice " * 50)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"slab": F.lit(1), "late": F.lit(2)})
    got = {r.doc_id: r for r in fingerprint_neighbours(table).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    assert len(got) == len(rows)
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert got[9010].fingerprint == got[9011].fingerprint and got[9010].near_next == 1.0
    long = [got[i] for i, t in order if t and len(t) > 2000]
    assert sum(r.near_edited for r in long) / len(long) > 0.4 and sum(r.near_next for r in long) / len(long) < 0.2
    assert fingerprint_neighbours(table.limit(0)).count() == 0
    one = fingerprint_neighbours(spark.createDataFrame([(1, "alone")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"aloal").hexdigest()


def test_languages(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()] + [(i, t, "en") for i, t in ODD] + [(None, "the thing", "en"), (9100, "the thing", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"keep": F.lit(1), "score": F.lit(2)})
    got = language_id(table, per_language=20).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert by[9001].lang_pred == by[9002].lang_pred == by[9005].lang_pred == "und" and by[9001].score == 0
    held = [(by[i].lang_pred, lang) for i, t, lang in rows if i is not None and i < 9000 and by[i].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.9
    assert {r.lang_pred for r in language_id(table.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id(table.limit(0)).count() == 0


def test_most_rows_without_id(spark):
    """Two thirds of the rows share no doc_id: they come last, in the order of their texts' hashes, and the last one's next is the first."""
    rows = [(i, f"text {i} " * (i % 7 + 1)) for i in range(60)] + [(None, f"no id {i} " * (i % 5 + 1)) for i in range(120)] + [(2**62, "far"), (-5, "first of all " * 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tags = [r.tag for r in df.select(document_key()[1].alias("tag")).collect()]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, tags[i]))
    want = []
    for a, b in zip(order, order[1:] + order[:1]):
        half = len(rows[a][1]) // 2
        edited = rows[a][1][: len(rows[a][1]) - half] + rows[b][1][:half]
        want.append((rows[a][0], len(rows[a][1]), hashlib.sha256(edited.encode()).hexdigest()))
    key = lambda t: (t[0] is None, t[0] or 0, t[2])
    got = [(r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprint_neighbours(df).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_fixed_text_is_told_by_its_place_in_the_expression(spark):
    """One path, two places: the first paragraph is fixed, the one after the list is a slot that may hold the same word."""
    pages = [f"<div><h2>Open?</h2><p>Yes</p><ul><li>Shop {i}</ul><p>{'Yes' if i % 2 else f'No {i}'}</p></div>" for i in range(6)]
    assert extracted(spark, pages) == [f"Shop {i}\n\n{'Yes' if i % 2 else f'No {i}'}" for i in range(6)]
    pages = [page if i else page.replace("<p>Yes</p>", "<table><tr><td>Since 1900</table><p>Yes</p>") for i, page in enumerate(pages)]  # an optional group before the fixed place
    assert extracted(spark, pages) == ["Since 1900\n\nShop 0\n\nNo 0"] + [f"Shop {i}\n\n{'Yes' if i % 2 else f'No {i}'}" for i in range(1, 6)]


def joined(pages):
    first, *rest = (Wrapper.of(page) for page in pages)
    for other in rest:
        first.add(other)
    return first


def test_mismatches_become_options_and_repeats():
    assert joined(["<h1>a</h1><p>b", "<h1>a</h1><table></table><p>b"]).group.form() == "(h1#(),table()?,p#())"
    assert joined(["<div><p>a</div><div><ul></ul></div>", "<div><p>a</div><div><ul></ul></div><div><p>c</div>"]).group.form() == "(div(p#()),div(ul()?,p#()?)+)"
    assert joined(["<h2>a</h2><ul></ul><h2>b</h2><ul></ul><table></table>", "<h2>a</h2><ul></ul><table></table>"]).group.form() == "((h2#()?,ul()?)+,table())"


def places(page, expression):
    found, root = html_extract.blocks(page)
    html_extract.match(root, expression)
    return [(b[4].place, b[3]) for b in found]


def test_extraction_equals_a_plain_version(spark):
    """Small hosts of random pages: all trees aligned in order, each page matched, fixed text as what all pages show at a place."""
    draw = random.Random(8)
    tree = lambda depth: "".join(f"<{t}>{tree(depth - 1) if t == 'div' and depth else draw.choice('xyz')}</{t}>" for t in draw.choices(["p", "h2", "div", "ul"], k=draw.randrange(1, 4)))
    hosts = {}
    for host in "abcd":
        top, end = tree(1), tree(2)
        hosts[host] = [f"<div><p>{host}</div>{top}<section>{tree(2)}{i}</section>{end}" for i in range(6)] + [f"{top}<p>z"]
    rows = [(k, f"http://{host}/", page) for k, (host, page) in enumerate((h, p) for h in hosts for p in hosts[h])]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    k = 0
    for pages in hosts.values():
        one = joined(page for _, page in sorted((Wrapper.of(page).packed(), page) for page in pages)).group
        shown = [places(page, one) for page in pages]
        fixed = set.intersection(*map(set, shown))
        assert fixed
        for found in shown:
            assert got[k] == "\n\n".join(b[1] for b in found if b not in fixed)
            k += 1


def test_expressions_do_not_depend_on_how_rows_lie(spark, monkeypatch):
    """All different trees of a host are aligned, here two at a time in several rounds, to one expression that covers them."""
    monkeypatch.setattr(html_extract, "FAN", 2)
    tags = ["p", "ul", "table", "h2", "div"]
    pages = [f"<h1>t</h1><article>{''.join(f'<{t}>x</{t}>' for j, t in enumerate(tags) if i >> j & 1)}</article>" for i in range(32)]
    rows = spark.createDataFrame([(h, p) for h in (1, 2) for p in pages] + [(3, "<p>a")], "host long, html string")
    got = [{r.host: r.expression for r in html_extract.expressions(rows.repartition(n)).collect()} for n in (1, 7)]
    assert got[0] == got[1] and set(got[0]) == {1, 2, 3} and got[0][1] == got[0][2]
    assert html_extract.expressions(rows.limit(0)).count() == 0
    (h1, article) = Wrapper.unpacked(got[0][1]).group.groups
    assert (h1.label, h1.maybe, article.label, article.maybe) == ("h1", False, "article", False)
    assert set().union(*map(html_extract.labels, article.groups)) == set(tags)
    for page in pages:
        _, root = html_extract.blocks(page)
        assert all(item is not None for _, item in html_extract.assigned(root.groups[1].groups, article.groups))


def test_expressions_stay_bounded():
    """Labels of single pages, depth and width: the expression stays small, and no text is lost."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    pages = [f"<h1>t</h1><div class=list><p class={a}{b}>{a}{b}</p></div>" for a in letters for b in letters] + ["<div>" * 3000 + "deep", "".join(f"<p class={a}{b}>{a}<h2 class={b}{a}>{b}</h2>" for a in letters for b in letters)]
    one = joined(pages).group
    assert one.size() <= html_extract.WHOLE
    for page in pages:
        assert main_text(page, set(), None, one) == main_text(page)
