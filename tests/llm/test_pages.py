"""Extraction on pages with comments, odd links and broken quotes."""

import pytest

from loglattice.llm.html_extraction import main_text

SENTENCE = "The river rose in the night, and by morning the lower road was closed. "
ARTICLE = [SENTENCE * 3 + f"Part {i}." for i in range(8)]
BODY = "".join(f"<p>{p}</p>" for p in ARTICLE)
EXPECTED = "\n\n".join(ARTICLE)
REMARK = "<p>I was there, and I saw it all with my own eyes, believe me or not. Number {}.</p>"


@pytest.mark.parametrize("remarks", [3, 10, 30, 80])
@pytest.mark.parametrize("mark", ['class="comments"', 'id="comments"', 'class="reader-comments wide"'])
@pytest.mark.parametrize("inside", [True, False])
def test_comments_go_whatever_their_share(remarks, mark, inside):
    thread = f"<section {mark}>{''.join(REMARK.format(i) for i in range(remarks))}</section>"
    page = f"<html><body><article>{BODY}{thread if inside else ''}</article>{'' if inside else thread}</body></html>"
    assert main_text(page) == EXPECTED


def test_wrappers_with_such_words_stay():
    for wrapper in ('<div class="post comments-open">', '<div id="page" class="site right-sidebar">'):
        assert main_text(f"<html><body>{wrapper}{BODY}</div></body></html>") == EXPECTED


def test_anchors_are_no_links():
    assert main_text(f'<body><article><a name="top">{BODY}</article></body>') == EXPECTED
    for end in ("</p>", ""):  # the link ends with its paragraph
        assert main_text(f'<body><article><p><a href="x">first{end}{BODY}</article></body>').endswith(EXPECTED)


@pytest.mark.parametrize("head", ['<a href="#s">Section</a>', '<a name="s">Section</a>'])
def test_linked_headings_stay(head):
    assert main_text(f"<body><article>{BODY}<h2>{head}</h2>{BODY}</article></body>") == f"{EXPECTED}\n\nSection\n\n{EXPECTED}"


def test_unclosed_quotes_end_with_the_tag():
    page = f'<body><article>{BODY}<p title="x>{SENTENCE}</p><p class="y" title="a > b">{SENTENCE}</p></article></body>'
    assert main_text(page) == f"{EXPECTED}\n\n{SENTENCE.strip()}\n\n{SENTENCE.strip()}"
