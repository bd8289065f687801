import random
import zlib

import numpy as np
import pytest
from llm.cases import SCHEMA, awkward_documents, with_clashing
from pyspark.sql import functions as F

import __spark_entry__ as entry
from credsieve.llm import blocks, langid, toxicity
from credsieve.llm.common import remainder

SYLLABLES = {
    "aa": "th er on an re he in ed nd ha".split(),
    "bb": "eau que ment é tion le la oi re aux".split(),
    "cc": "sch ung ch ie ei über keit ver ge zu".split(),
}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def labelled(n=240, seed=6):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        text = prose(rng, lang, rng.randint(3, 80))
        rows.append((i, text, lang, "s", len(text)))
    return rows


def test_languages_held_out(spark):
    rows = labelled()
    docs = with_clashing(spark, rows + [(1000, None, "aa", "s", 0), (1001, "12 !!", "aa", "s", 0), (1002, "", None, "s", 0)])
    held_out = remainder(F.col("doc_id"), 3) == 1
    model = langid.fit(docs.where(~held_out))
    found = langid.predict(docs.withColumn("held", held_out), model)
    assert found.count() == docs.count()
    got = {r.doc_id: r for r in found.collect()}
    held = [r for r in rows if got[r[0]].held]
    assert len(held) > 40
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.97 * len(held)
    for i in (1000, 1001, 1002):
        assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = langid.drop_unknown(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows}


def test_far_texts_are_rejected(spark):
    model = langid.fit(spark.createDataFrame(labelled(), SCHEMA))
    assert model.nearest("это другой алфавит и другие слова совсем")[2]
    assert not model.nearest("thernd hain")[2]


def test_texts_of_unlearnt_languages_are_rejected_at_any_length(spark):
    model = langid.fit(spark.createDataFrame(labelled(600), SCHEMA))
    rng = random.Random(10)
    scripts = ["абвгдежзиклмнопрстуфхцчшщыэюя", "αβγδεζηθικλμνξοπρστυφχψω", "的一是不了人我在有他这中大来上国个到说们"]
    for n in (5, 40, 400, 2000):
        for letters in scripts:
            text = " ".join("".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(n))
            assert model.nearest(text)[2], (n, letters, model.nearest(text))
    for lang in SYLLABLES:
        for n in (2, 3, 5, 40, 400, 2000):
            text = prose(rng, lang, n)
            assert model.nearest(text)[::2] == (lang, False), (n, model.nearest(text))


def test_repeated_labels_do_not_matter_for_one_text(spark):
    model = langid.fit(spark.createDataFrame(labelled(), SCHEMA))
    assert model.nearest("queaux tionle") == model.nearest("queaux tionle")


def test_no_labelled_text(spark):
    docs = spark.createDataFrame([(1, "abc", None, "s", 3)], SCHEMA)
    model = langid.fit(docs)
    assert langid.predict(docs, model).first().lang_pred == "und"
    assert langid.predict(spark.createDataFrame([], SCHEMA), model).count() == 0


def test_long_text_in_slices(monkeypatch):
    text = prose(random.Random(1), "cc", 500)
    whole = langid.ngram_counts(text)
    monkeypatch.setattr(langid, "BLOCK", 100)
    assert (langid.ngram_counts(text) == whole).all()


def test_pairs_are_learnt():
    """Toxic only where an insult meets a group: no additive weights can do that."""
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = [f"n{rng.randrange(60)}a" for _ in range(8)] + ["zap"] * insult + ["folk"] * group
        rows.append(toxicity.text_terms(" ".join(words)).astype(np.int64))
        labels.append(float(insult and group))
    model = toxicity.train(rows, np.array(labels), np.ones(600))
    assert model.score("zap folk nba") > 0.5
    assert max(model.score("zap nba"), model.score("folk nba"), model.score("nba")) < 0.3


def test_toxicity_held_out(spark):
    rng = random.Random(9)
    rows, marks = [], []
    for i in range(500):
        words = [f"{a}{b}" for a, b in zip(rng.choices(["ba", "do", "ki"], k=30), rng.choices(["lu", "me", "ta"], k=30))]
        toxic = rng.random() < 0.3
        if toxic:
            words[rng.randrange(30)] = "vequ" + rng.choice(["a", "ement", "ai", "eur", "iste"])
        rows.append((i, " ".join(words), "en", "s", 1))
        marks.append((i, 1, int(toxic)))
    docs = with_clashing(spark, rows + [(900, None, None, None, None), (None, "", "en", "s", 0)])
    labels = spark.createDataFrame(marks + [(None, 1, 1), (901, 1, None), (3, 1, marks[3][2])], "doc_id long, quality int, toxic int")
    held_out = remainder(F.col("doc_id"), 4) == 2
    found = toxicity.score(docs, toxicity.fit(docs, labels, ~held_out)).withColumn("held", held_out).collect()
    assert len(found) == 502 and all(0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held and r.doc_id is not None and r.doc_id < 500]
    truth = {m[0]: m[2] for m in marks}
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a", None, None, None)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, none, F.lit(True))
    assert toxicity.score(docs, model).first().score < 0.01
    assert toxicity.score(spark.createDataFrame([], SCHEMA), model).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<header class="site"><h1>Site</h1><a href=/>Home</a></header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></ul></nav>
<div class="cookie-notice">We use cookies to make this site work for you today.</div>
<article><header><h1>Title &amp; more</h1></header><p>First&nbsp;<b>para   graph</b> &lt;ok&gt;<br><p>Short.
<div class="ad">Buy now great things at low low prices</div><ul><li>one</li><li><a href="u">two</a></li></ul>
<aside>Related things</aside><p hidden>secret</p><section id="comments"><p>Nice article, thanks a lot for writing all of this.</p></section>
</article><form><p>sign up here to get news each week</p></form><footer>&copy; 2020</footer><p cut off"""


def test_page_blocks(spark):
    pages = spark.createDataFrame(
        [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "plain words without any tag that stand alone on this page"), (1, "u", PAGE)],
        "page_id long, url string, html string",
    ).withColumn("n_chars", F.lit("clash")).withColumn("_found", F.lit(1))
    rows = blocks.extract(pages).collect()
    got = {r.page_id: r for r in rows}
    assert len(rows) == 5
    assert got[1].text == "Title & more\nFirst para graph <ok>\nShort.\none\ntwo"
    assert got[1].n_chars == len(got[1].text)
    assert (got[2].text, got[2].n_chars, got[3].text) == ("", 0, "")
    assert got[4].text.startswith("plain words")
    assert blocks.extract(pages.limit(0)).count() == 0


def test_pages_that_mark_no_article():
    text = "This paragraph has no links and quite a lot of words, so that it must be the main text of the page. "
    page = f'<div id=menu><a href=1>Home</a> <a href=2>About</a></div><h1>A title</h1><p>{text}</p><p>{text}</p><div class=sidebar>{text}</div>'
    assert blocks.main_text(page, blocks.fitted_tree())[0] == f"A title\n{text.strip()}\n{text.strip()}"


def test_names_of_the_whole_page_set_nothing_aside():
    text = "The article of this page has quite a lot of words in a paragraph without any links."
    tree, article = blocks.fitted_tree(), f"<article><p>{text}</p></article>"
    comments = "<section id=comments><article><p>Nice article, thanks a lot for writing all of this.</p></article></section>"
    pages = [
        f"<html class=no-sidebar><body class='single has-sidebar comments-open'>{article}</body>",
        f"<article class='post comment-status-open'><p>{text}</p></article>",
        f"<main id=has-sidebar><p>{text}</p></main>",
        f"<div class='layout with-sidebar'>{article}<div class=sidebar><p>Other things that are not in it.</p></div></div>",
        f"<div class=with-sidebar><div class=comments-open><main><p>{text}</p></main></div></div>",
        f"<div class=with-sidebar>{article}{comments}</div>", f"<div>{article}</div>{comments}",
        f"<div class=with-sidebar><div class=comments-open>{article}</div></div>",
    ]
    assert [blocks.main_text(p, tree)[0] for p in pages] == [text] * len(pages)
    assert blocks.main_text(f"<div class=widget>{article}</div><div class=widget>{article}</div>", tree)[0] == f"{text}\n{text}"


def test_length_and_links_decide():
    tree = blocks.fitted_tree()
    long = "This last paragraph without any links has so many words that it can only be the main text of the page. "
    link, links = "<p><a href=1>More of this</a></p>", "<ul><li><a href=1>One</a><li><a href=2>Two things</a><li><a href=3>Three</a></ul>"
    card = "<article><h3><a href=4>Another story</a></h3><p>A teaser of it.</p></article>"
    for page in (
        f"<p>{long}</p>{link}<p>{long}</p>",  # last, after a paragraph that is a link
        f"{links}<p>{long}</p><p>{long}</p>{links}",
        f"<article><p>{long}</p>{links}<p>{long}</p></article>",
        f"<article><p>{long}</p>{link}{links}<p>{long}</p>{links}</article>",
    ):
        assert blocks.main_text(page, tree)[0] == f"{long.strip()}\n{long.strip()}"
    assert blocks.main_text(f"{links}<p>{long}</p>", tree)[0] == long.strip()
    assert blocks.main_text(f"<article>{links}<p>Short.</p>{link}</article>", tree)[0] == "Short.\nMore of this"
    got = blocks.main_text(f"{links}<div><p>{long}</p><p>{long}</p></div>{card}{card}{card}", tree)[0]
    assert got.startswith(f"{long.strip()}\n{long.strip()}") and "Another" not in got
    assert blocks.main_text(f"{card}<p>A short line beside it.</p>", tree)[0].endswith("A teaser of it.")


def test_every_neighbourhood():
    tree = blocks.fitted_tree()
    around = [(*b, *a) for b in ((0, 0.0), (1, 0.9), (5, 0.0), (90, 0.1)) for a in ((0, 0.0), (1, 0.9), (5, 0.0), (90, 0.1))]
    for n in around:
        for words in (2, 9, 40, 300):
            assert blocks.is_main(tree, (words, 0.1, *n, 1, 0, 0, 0)), (words, n)
            assert blocks.is_main(tree, (words, 0.95, *n, 1, 0, 0, 0)) == (0.9 not in n), (words, n)
            assert not blocks.is_main(tree, (words, 0.95, *n, 0, 0, 0, 0))
            for place in ((1, 0), (0, 1), (0, 0)):
                assert not blocks.is_main(tree, (words, 0.1, *n, *place, 1, 0))
        for words in (20, 40, 300):
            assert blocks.is_main(tree, (words, 0.1, *n, 0, 0, 0, 0)), (words, n)


def test_long_page_is_read_once():
    page = "<article>" + "<p>word <b>two</b> three" * 20_000 + "<a \"" * 2000
    assert blocks.main_text(page, blocks.fitted_tree())[1] >= 20_000


def test_awkward_documents(spark):
    docs = with_clashing(spark, awkward_documents())
    model = langid.fit(docs)
    assert langid.predict(docs, model).count() == docs.count()


LONG_TEXT = "The whole of the text is about a thing that takes some time to say. " * 4


@pytest.mark.parametrize(
    "page,text",
    [
        # a form around the page is a wrapper, one in it is none
        (f"<body><form id=aspnetForm><div><p>{LONG_TEXT}</p></div></form></body>", LONG_TEXT.strip()),
        (f"<body><p>{LONG_TEXT}</p><form><p>Your name and address please, and what you want to say</p></form></body>", LONG_TEXT.strip()),
        ("<nav><a href=1>Home</a><a>About</a></nav><h1>Title</h1><p>Short text.</p><footer>c 2020</footer>", "Title\nShort text."),
        ("hello world", "hello world"),
        # a link that holds blocks
        (f"<div>{LONG_TEXT}</div><a href=x><h3>A teaser of some other page here</h3><p>{LONG_TEXT}</p></a>", LONG_TEXT.strip()),
        # comments that only their heading names
        (f"<article><p>{LONG_TEXT}</p><section><h2>Comments</h2><div>{LONG_TEXT}</div></section></article>", LONG_TEXT.strip()),
        (f"<article><p>{LONG_TEXT}</p><h2>Comments on the law</h2><p>{LONG_TEXT}</p></article>", f"{LONG_TEXT.strip()}\nComments on the law\n{LONG_TEXT.strip()}"),
        # words of the article's own classes
        (f"<article><p>{LONG_TEXT}</p><p class='ad-hoc'>Said ad hoc.</p><p class=social>Social.</p><p class=legal>Legal.</p></article>", f"{LONG_TEXT.strip()}\nSaid ad hoc.\nSocial.\nLegal."),
        (f"<article><p>{LONG_TEXT}</p><div class='social'>Follow us</div><p class='ad'>Buy now</p></article>", LONG_TEXT.strip()),
        ("<ul><li><a>One</a></li><li><a>Two</a></li></ul>", ""),
        (None, ""),
    ],
)
def test_pages_of_all_kinds(page, text):
    assert blocks.main_text(page, blocks.fitted_tree())[0] == text


def slow_tree(rows, depth):
    """The same tree grown without arrays: the split of least impurity, the first of equal ones."""
    share = sum(r[-1] for r in rows) / len(rows)
    if depth == 0 or share in (0.0, 1.0):
        return int(share >= 0.5)

    def impurity(part):
        p = sum(r[-1] for r in part) / len(part)
        return len(part) * p * (1 - p)

    best = None
    for f in range(len(rows[0]) - 1):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:]):
            low, high = [r for r in rows if r[f] < (a + b) / 2], [r for r in rows if r[f] >= (a + b) / 2]
            cost = impurity(low) + impurity(high)
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, (a + b) / 2, low, high)
    if best is None:
        return int(share >= 0.5)
    return (best[1], best[2], slow_tree(best[3], depth - 1), slow_tree(best[4], depth - 1))


def test_tree_against_a_plain_version():
    assert slow_tree([tuple(map(float, r)) for r in blocks.LABELLED], blocks.DEPTH) == blocks.fitted_tree()


def test_registered_models_on_held_out_rows(spark):
    """op1, op5 and op8 over whole tables, judged on rows they have not learnt from."""
    folder = "/root/testdata/sf0.01"
    queries = entry.queries()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = queries["op8_language_id"](spark, folder).collect()
    assert len(found) == len(docs)
    judged = [r.lang_pred == docs[r.doc_id].lang for r in found if r.held_out and docs[r.doc_id].lang and r.lang_pred != "und"]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    assert len(judged) > 200 and sum(judged) / len(judged) > 0.97
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    scores = queries["op1_toxicity"](spark, folder).collect()
    assert len(scores) == len(docs) and all(r.predicted == int(r.score >= 0.3) for r in scores)
    held = [(r.score, toxic[r.doc_id]) for r in scores if r.held_out and toxic.get(r.doc_id) is not None]
    ones, zeros = [s for s, t in held if t], [s for s, t in held if not t]
    auc = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))
    assert auc > 0.93
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    tree = blocks.fitted_tree()
    got = {(r.page_id, r.text, r.n_chars) for r in queries["op5_html_extraction"](spark, folder).collect()}
    texts = {p.page_id: blocks.main_text(p.html, tree)[0] for p in pages}
    assert got == {(i, t, len(t)) for i, t in texts.items()} and sum(map(bool, texts.values())) > 0.9 * len(texts)
