"""Pages' texts against the standard library's parser, and the states that given pages don't reach."""

from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

from tessera.functions import html


class Plain(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skipped = [], None

    def handle_starttag(self, tag, attrs):
        self.skipped = tag if tag in html.RAW else self.skipped
        self.out.append("" if tag in html.INLINE else " ")

    def handle_endtag(self, tag):
        self.skipped = None if tag == self.skipped else self.skipped
        self.out.append("" if tag in html.INLINE else " ")

    def handle_data(self, data):
        if not self.skipped:
            self.out.append(data)


def plain(page):
    parser = Plain()
    parser.feed(page)
    parser.close()
    return " ".join("".join(parser.out).split())


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_all_pages_as_the_standard_library_reads_them(folder):
    pages = pq.read_table(f"/root/testdata/{folder}/pages.parquet", columns=["html"]).column("html").to_pylist()
    assert all(html.text_of(p) == plain(p) for p in pages) and sum(len(html.text_of(p)) for p in pages) > 10_000


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p title='a > b'>x</p>", "x"),
        ('<a href=x"y>z</a>', "z"),
        ("<a b = \"c > d\" e>f</a>", "f"),
        ("a<!-- b -- > c -->d", "ad"),
        ("a<!-->b<!--->c", "abc"),
        ("a<!--never ends", "a"),
        ("<script>if (a < b) '</p>'</script >x", "x"),
        ("<SCRIPT>y</ScRiPt><style>p{}</style>x", "x"),
        ("<script>never ends", ""),
        ("<title>1 &lt; 2 <b></title>x", "1 < 2 <b> x"),
        ("&#65;&#x42;&eacute;&nbsp;&amp;lt;&bogus;", "ABé &lt;&bogus;"),
        ("1 < 2 <3 & 4", "1 < 2 <3 & 4"),
        ("<b>a</b>b<p>c</p>d", "ab c d"),
        ("<!DOCTYPE html><?php x ?>a</ b>c", "ac"),
        ("a<b", "a"),
        ("a <em title=\"never ends>b", "a"),
        ("", ""),
        (None, None),
    ],
)
def test_states(page, text):
    assert html.text_of(page) == text


def test_long_pages_take_time_in_proportion():
    assert html.text_of("<p>" * 200_000 + "x" + "<" * 200_000) == "x" + "<" * 200_000
