"""Long attributes, class names that only sound like menus, odd comments, deep and broken pages."""

import time
import tracemalloc

import pytest

from procspark.llm.html_extract import main_text

THREE = "".join(f"<p>Paragraph {i}, with a comma, and a full stop at the end.</p>" for i in range(3))
TEXT = "\n".join(f"Paragraph {i}, with a comma, and a full stop at the end." for i in range(3))


@pytest.mark.parametrize("size", [400, 4100, 300_000])
@pytest.mark.parametrize("quote", ['"', "'"])
def test_long_attribute_values(size, quote):
    assert main_text(f"<article><p data-x={quote}{'y' * size}> LEAKED, text.{quote}>x, y.</p>{THREE}</article>") == "x, y.\n" + TEXT


def test_names_that_say_what_stands_beside():
    nav = "<div class='menu'><p>Home, news, all of it.</p></div>"
    assert main_text(f"{nav}<div class='content has-sidebar'>{THREE}</div>") == TEXT
    assert main_text(f"<div class='site header-fixed'>{nav}<article>{THREE}</article></div>") == TEXT
    assert main_text(f"{nav}<article><header class='entry-header'><h1>Title</h1></header>{THREE}</article>") == "Title\n" + TEXT
    assert main_text(f"<article>{THREE}</article><div class='comments'><article class='comment'>{THREE * 5}</article></div>") == TEXT
    assert main_text(f"<article>{THREE}</article><div class='site-header'><p>A claim, a slogan, and more.</p></div>") == TEXT


def test_hidden_is_an_attribute_and_not_a_word():
    assert main_text(f"<article><p title='the hidden truth about'>Shown, of course.</p><p hidden>Not shown, no.</p>{THREE}</article>") == "Shown, of course.\n" + TEXT


def test_comments_and_cut_off_tags():
    assert main_text(f"<article><!-->{THREE}<!---><!-- no, <p>nothing</p> --></article>") == TEXT
    assert main_text(f"<article>{THREE}<p class=\"cut off") == TEXT
    assert main_text(f"<article>{THREE}<!-- never, closed. <p>x</p>") == TEXT
    assert main_text(f"<article><p class=it's>One, two.</p>{THREE}</article>") == "One, two.\n" + TEXT
    assert main_text(f"<article>{THREE}<p>3 < 4, and 5 > 4, it's so.</p></article>") == TEXT + "\n3 < 4, and 5 > 4, it's so."


@pytest.mark.parametrize("page", ["<div>" * 200_000 + "deep, text.", "<div>a, b." * 100_000, "<a<a" * 250_000, "<a x=\"" * 150_000, "<!x" * 300_000,
                                  "<div>" * 60_000 + "</section>" * 60_000 + "x, y."])
def test_hostile_megabytes_in_linear_time_and_memory(page):
    tracemalloc.start()
    start = time.time()
    main_text(page)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400 * len(page) and time.time() - start < 60
