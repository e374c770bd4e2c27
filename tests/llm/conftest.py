"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

from __future__ import annotations

import random

import pytest

from tests.llm.helpers import write

WORDS = "the of and river stone light quiet engine sailor copper window garden métier straße 東京 привет winter letter orange doctor".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (str(r.randrange(50)) if r.random() < 0.5 else "") for _ in range(n))


def documents() -> list[tuple]:
    base, shared = prose(1, 120), prose(2, 80)
    near = base.split()
    near[60] = "changed"
    texts = [base, base, " ".join(near), base.upper(), "", None, "   \n\t ", "word", "one two three four", "One two THREE four", prose(3, 30), prose(3, 30)]
    texts += [prose(4, 300) + "\n" + shared, shared + " " + prose(5, 200), prose(6, 50) + shared + "é" + prose(7, 50), "ab" * 700, "z" * 150, shared + shared]
    texts += [prose(8, 4000), "line one here\nline one here\n\nline two # $ <b>\nline one here", "<|endoftext|> is plain text here", " no break space em", "🙂" * 300, "á" * 90]
    texts += [prose(20 + i, 40 + 7 * i) for i in range(20)] + [base] * 12
    rows = [(7 * i + 1000 * (i % 3 == 0), t, ("en", "de", "", None)[i % 4], ("web", "books", "web", None, "Code", "")[i % 6], len(t or ""), f"extra {i}", i) for i, t in enumerate(texts)]
    rows.append((rows[0][0], rows[0][1], *rows[0][2:]))  # a repeated row
    rows.append((rows[10][0], "another text under the id of one before it, five words and more", *rows[10][2:]))
    return rows


@pytest.fixture(scope="session")
def odd(tmp_path_factory):
    """A folder of tables with awkward rows."""
    root = tmp_path_factory.mktemp("odd")
    write(root, "documents", documents(), "doc_id long, text string, lang string, source string, n_chars long, score string, n_words int")
    write(root, "labels", [(r[0], 1, i % 2) for i, r in enumerate(documents())] + [(None, 1, 1), (20, 0, None), (20, 0, 7)], "doc_id long, quality int, toxic int")
    pages = [(1, "http://www.Example.com:80/A?b=C", "<p>one</p>"), (2, "https://example.com/a b", "<p>one</p>"), (3, None, None), (4, "", ""), (5, "http://[bad", "<p>ü 東</p>"), (6, "http://example.com/z", "<p>one</p>"), (7, "http://a.example.com/", "x" * 300_000), (7, "http://a.example.com/", "x" * 300_000), (8, "http://b.org/\r\nx", "body\r\n\r\nWARC/1.1\r\n\r\n")]
    write(root, "pages", [(*p, 0) for p in pages], "page_id long, url string, html string, key int")
    turns = [(1, 0, "system", "be brief"), (1, 1, "user", "hi \"you\" \\ ü"), (1, 2, "assistant", "yes"), (1, 3, "user", None), (1, 4, "assistant", None), (2, 0, "user", ""), (2, 1, "assistant", "a"), (2, 1, "assistant", "a"), (2, 1, "assistant", "b"), (3, 5, "assistant", "orphan"), (4, 0, "user", "alone"), (4, 0, "user", "again"), (None, 0, "user", "x"), (5, None, "user", "y"), (5, None, "assistant", "z"), (6, 0, None, "w")]
    write(root, "conversations", [(*t, "n") for t in turns], "conv_id long, turn long, role string, text string, name string")
    items = [(1, " ".join(prose(1, 120).split()[:40])), (2, "the of and river the THE river"), (3, None), (4, ""), (5, "nowhere-to-be-found xyzzy"), (6, "東京 привет straße #50 winter"), (7, prose(4, 60)), (7, prose(5, 30)), (None, "light")]
    write(root, "benchmark", [(*x, "extra") for x in items], "item_id long, text string, score string")
    return str(root)


@pytest.fixture(scope="session")
def nothing(tmp_path_factory):
    """The same tables without rows."""
    root = tmp_path_factory.mktemp("nothing")
    for name, schema in {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "pages": "page_id long, url string, html string", "conversations": "conv_id long, turn long, role string, text string", "benchmark": "item_id long, text string"}.items():
        write(root, name, [], schema)
    return str(root)
