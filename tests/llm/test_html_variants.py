"""The main text of pages in shapes that the invented training pages don't copy."""

import pandas as pd
import pytest

from conftest import SF
from html_variants import VARIANTS, made
from inkledger.llm import html


@pytest.fixture(scope="module")
def pages():
    return pd.read_parquet(f"{SF}/pages.parquet").html.tolist()


@pytest.mark.parametrize("name", VARIANTS)
def test_exact_text(pages, name):
    both = [made(p, name) for p in pages]
    got = html.main_texts([page for page, _ in both], html.default_model())
    assert all(got)
    # A page of a heading and a few words in an element that is called promoted may be taken for an advert.
    assert sum(g == want for g, (_, want) in zip(got, both, strict=True)) >= 0.9 * len(pages)


def test_most_shapes_are_exact(pages):
    hits = [g == want for name in VARIANTS for g, (_, want) in zip(html.main_texts([made(p, name)[0] for p in pages], html.default_model()), (made(p, name) for p in pages), strict=True)]
    assert sum(hits) / len(hits) > 0.985


def test_what_the_contract_does_not_list_stays():
    model, text = html.default_model(), "A paragraph of some length, which goes on for a while. "
    source = f"<article><h1>Title of it</h1><p>{text * 4}</p><p>Let <math><mi>x</mi></math> be a number, and <svg><text>y</text></svg> too, as they say. {text * 3}</p></article>"
    assert "Let x be a number, and y too, as they say." in html.main_texts([source], model)[0]
    gone = source.replace("</article>", "<script>var a</script><style>p{}</style><textarea>form text</textarea></article>")
    assert html.main_texts([gone], model) == html.main_texts([source], model)


def test_a_fit_is_the_same_every_time():
    again = html.default_model.__wrapped__()
    first = html.default_model()
    assert (again.second.leaves == first.second.leaves).all() and (again.first.limits == first.first.limits).all()
