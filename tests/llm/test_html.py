"""Pages without optional tags, with formulas, very long ones, and tables of pages without article elements."""

import numpy as np
import pytest

from tabloom.llm.common import read
from tabloom.llm.html_blocks import blocks_of
from tabloom.llm.html_extraction import main_texts, train


def texts(page):
    return [b.text for b in blocks_of(page)]


@pytest.mark.parametrize(
    "head",
    [
        "<head><title>t</title><meta charset=utf-8><body>", "<head><title>t</title>", "<HEAD><style>p{}</style><link rel=x href=y><Body class=a>",
        "<head><noscript><style>p{}</style></noscript><script>x</script></head><body>", "<head><noscript><img src=a>hidden<body>",
        "<head><template><p>hidden</p></template><body>",
    ],
)
def test_head_ends_where_the_page_begins(head):
    assert texts(f"<!doctype html><html>{head}<p>one two<p>three</html>") == ["one two", "three"]


def test_text_ends_head():
    assert texts("<html><head>\n <title>t</title>\n loose words <b>here</b><p>more") == ["loose words here", "more"]
    assert texts("<html><head><title>t</title><textarea>x</textarea>words") == ["words"]


def test_formulas_are_text():
    page = "<p>Energy is <math><semantics><mrow><mi>E</mi><mo>=</mo><mi>m</mi></mrow><annotation>E=m</annotation></semantics></math> here.</p>"
    assert texts(page) == ["Energy is E=m here."]


@pytest.fixture(scope="module")
def trained(spark):
    pages = read(spark, "/root/testdata/sf0.001", "pages")
    return train(pages, sample=100, laid_out=200), [r.html for r in pages.limit(20).collect()]


def test_labels_do_not_depend_on_the_other_pages_of_a_batch(trained):
    model, pages = trained
    cut = [blocks_of(p) for p in pages]
    for alone, together in zip([model.chances([b])[0] for b in cut], model.chances(cut), strict=True):
        np.testing.assert_allclose(alone, together, atol=1e-4)


def test_states_go_on_over_long_pages(trained):
    model, _ = trained
    paragraphs = [f"<p>Sentence number {k} of a very long story about rivers.</p>" for k in range(1300)]
    page = f"<nav><a href=x>Home</a></nav><article>{''.join(paragraphs)}</article><footer>Copyright</footer>"
    cut = blocks_of(page)
    model_input, _ = model._input([cut])
    assert model_input.shape[0] == len(cut) == 1302
    # One walk over all blocks, by a plain loop.
    hidden = []
    for side, x in (("f", model_input), ("b", model_input[::-1])):
        h, c, out = np.zeros(16), np.zeros(16), []
        for row in x:
            z = row @ model.p[side + "x"] + model.p[side + "c"] + h @ model.p[side + "h"]
            i, f, o = (1 / (1 + np.exp(-z[k * 16 : k * 16 + 16])) for k in range(3))
            c = f * c + i * np.tanh(z[48:])
            h = o * np.tanh(c)
            out.append(h)
        hidden.append(np.array(out if side == "f" else out[::-1]))
    wanted = 1 / (1 + np.exp(-(np.concatenate([*hidden, model_input], axis=1) @ model.p["out"] + model.p["bias"][0])))
    np.testing.assert_allclose(model.chances([cut])[0], wanted, atol=1e-3)
    # Places are those on the whole page.
    np.testing.assert_allclose(model_input[:, -4], np.arange(1302) / 1302, atol=1e-6)
    text = main_texts(model, [page, "<p>x", page])
    kept = "".join("1" if c >= 0.5 else "0" for c in wanted)
    assert text[0] == text[2] == " ".join(b.text for b, k in zip(cut, kept, strict=True) if k == "1")
    assert text[0] == " ".join(b.text for b in cut[1:-1])


def divs(page):
    """The given page with its article in a plain div."""
    return page.replace("<article>", '<div class="content">').replace("</article>", "</div>")


def test_pages_laid_out_in_divs_teach_no_boilerplate(spark):
    given = [r.html for r in read(spark, "/root/testdata/sf0.001", "pages").collect()]
    assert all(page.count("<article>") == 1 for page in given)
    wanted = [" ".join(b.text for b in blocks_of(p[p.index("<article>") : p.index("</article>")])) for p in given]
    table = [p if n % 4 == 0 else divs(p) for n, p in enumerate(given)]
    model = train(spark.createDataFrame([(p,) for p in table], "html string"))
    found = main_texts(model, table)
    assert sum(f == w for f, w in zip(found, wanted, strict=True)) >= 0.9 * len(wanted)
    # No page has an article: all is learnt from the layouts.
    found = main_texts(train(spark.createDataFrame([(divs(p),) for p in given], "html string")), [divs(p) for p in given])
    assert sum(f == w for f, w in zip(found, wanted, strict=True)) >= 0.9 * len(wanted)
