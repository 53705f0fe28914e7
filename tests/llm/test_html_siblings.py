"""Short parts of an article beside its body, and column names that differ by case."""

import pytest

from loomgraph.llm import html_text, langid, toxicity

LONG = "<p>long text here with many words in it, and more of them to come.</p>"
BODY = "\n\n".join(["long text here with many words in it, and more of them to come."] * 3)


@pytest.mark.parametrize(
    "html,want",
    [
        (f"<body><main><article>{LONG * 3}</article><article><p>short</p></article></main></body>", f"{BODY}\n\nshort"),
        (f"<body><div><h1>Title</h1><div class='body'>{LONG * 3}</div></div></body>", f"Title\n\n{BODY}"),
        (f"<body><h1>Title</h1><div>{LONG * 3}</div></body>", f"Title\n\n{BODY}"),
        (f"<body><div><h1>Title</h1><p>By A.</p><div>{LONG * 3}</div><p>End.</p></div></body>", f"Title\n\nBy A.\n\n{BODY}\n\nEnd."),
        # a menu beside the body, and divisions of the page itself, are no part of the article
        (f"<body><div><h1>Site</h1><ul><li><a href=a>One</a><li><a href=b>Two</a></ul><div>{LONG * 3}</div></div></body>", BODY),
        (f"<body><h1>Site</h1><div>{LONG * 3}</div><div>All rights reserved</div></body>", BODY),
    ],
)
def test_short_parts(html, want):
    assert html_text.main_text(html) == want


def test_names_by_case(spark, tmp_path):
    pages = spark.createDataFrame([(1, f"<p>{BODY}</p>", "x", 1)], "page_id long, html string, `Text` string, `N_Chars` int")
    out = html_text.extract(pages)
    assert [c.lower() for c in out.columns] == ["page_id", "text", "n_chars"] and out.first().text
    out.write.parquet(str(tmp_path / "pages"))
    docs = spark.createDataFrame([(1, "some text", "en", "s", 9, 0.5, "x", 3)], "doc_id long, text string, lang string, source string, n_chars long, `Score` double, `Lang_Pred` string, `Predicted` int")
    assert [c.lower() for c in toxicity.predict(docs, None).columns].count("score") == 1
    assert [c.lower() for c in langid.predict(docs, langid.fit(docs)).columns].count("score") == 1
