"""Articles whose parts are nested: nothing of them is lost, and nothing from around them comes in."""

from procspark.llm import html_extract
from tests.llm.test_pages_secrets_quality import PAGE

LONG = [f"Paragraph number {i}, which says something, and then says more of it." for i in range(20)]


def paragraphs(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


def check(inner, want):
    assert html_extract.main_text(PAGE % inner).split("\n") == want


def test_heading_and_lead_beside_the_body():
    for outer in ("article", 'div class="post"', "main"):
        close = outer.split()[0]
        check(f'<{outer}><h1>Title</h1><p>A lead.</p><div class="article-body">{paragraphs(LONG)}</div></{close}>', ["Title", "A lead.", *LONG])


def test_two_sections():
    short = ["The second section, with less.", "It ends here, after all."]
    for tag in ("section", "div"):
        check(f"<article><h1>T</h1><{tag}>{paragraphs(LONG)}</{tag}><{tag}><h2>S</h2>{paragraphs(short)}</{tag}></article>", ["T", *LONG, "S", *short])


def test_lists_and_tables():
    around = ["Before the list, a sentence.", "After the list, one more."]
    check(f"<article><p>{around[0]}</p><ul>{''.join(f'<li>{t}</li>' for t in LONG)}</ul><p>{around[1]}</p></article>", [around[0], *LONG, around[1]])
    check(f"<article><p>{around[0]}</p><table>{''.join(f'<tr><td>{t}</td></tr>' for t in LONG)}</table><p>{around[1]}</p></article>", [around[0], *LONG, around[1]])


def test_rejected_elements_and_links_inside_still_go():
    inner = f'<article><h1>T</h1><div>{paragraphs(LONG)}</div><div class="related"><p>More, of the same, here.</p></div><p><a href="/x">Only a link, to a page</a></p></article>'
    check(inner, ["T", *LONG])
