"""Pages whose end tags are left out, and elements that are text."""

import pytest

from veraframe.llm import html_extract


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<html><head><title>x</title><meta charset=a><body><p>One</p><p>Two</p>", "One\nTwo"),
        ("<head><title>x</title><script>a()</script><p>One</head>", "One"),
        ("<head><title>x</title><style>a</style>\nOne<p>Two", "One\nTwo"),
        ("<head><noscript><link rel=a></noscript><title>x</title></head><body>One", "One"),
        *[(f"<p>One</p><{x}><p>Two</p><p>Three</p>", "One\nTwo\nThree") for x in ("noscript", "svg", "object", "canvas", "iframe", "select", "template")],
        ("<p>One</p><svg><svg><path/></svg><text>not</text></svg><p>Two</p>", "One\nTwo"),
        ("<p>One</p><svg><p>Two</p><svg><text>not</text></svg><p>Three</p>", "One\nTwo\nThree"),
        ("<p>One</p><script>'<svg>'</script><svg><text>not</text></svg><p>Two</p>", "One\nTwo"),
        ("<p>One</p><select><option>not</select><iframe>not</iframe><template><p>not</p></template><p>Two</p>", "One\nTwo"),
        ("<p>As <math><mi>x</mi><mo>=</mo><mn>2</mn></math> says</p>", "As x=2 says"),
        ("<p>One</p><noscript><p>Two</p></noscript>", "One\nTwo"),
    ],
)
def test_nothing_else_is_cut(source, text):
    assert html_extract.extract([source], None) == [text]
