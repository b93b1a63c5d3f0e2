"""Any text gives a well-formed numbering, and tag-free text survives."""

import random
from html.parser import HTMLParser

from pageloom.operators.htmltree import NodeColumns, number_page

PIECES = ["<p>", "</p>", "<div a=1>", "</div>", "<b", ">", "<!--", "-->", "<!x>", "<?y?>", "</", "<a href='q", "'", '"',
          "=", "&amp;", "&", "&#x41;", "<script>", "</script>", "<title>", "</title>", "<table>", "<tr>", "<td>",
          "</table>", "<noscript>", "</noscript>", "<li>", "<ul>", "</ul>", "<br/>", "<head>", "</head>", "<body>",
          "</body>", "<html>", "<svg/>", "text", " ", "\n", "<textarea>", "</textarea>", "<rt>", "<template>", "é", "\0"]


def check(columns):
    n = len(columns)
    assert columns.pre == list(range(n))
    for i in range(n):
        parent, last = columns.parent[i], columns.last[i]
        assert i <= last < n and -1 <= parent < i
        if i:
            assert parent >= 0, "one root"
            assert last <= columns.last[parent] and columns.kind[parent] == "element"
            assert columns.depth[i] == columns.depth[parent] + 1
        if columns.kind[i] != "element":
            assert last == i and columns.text[i] is not None
    assert len(columns.attr_offsets) == n + 1 and columns.attr_offsets[-1] == len(columns.attr_names)


def test_random_markup():
    rng = random.Random(3)
    for _ in range(20000):
        out = NodeColumns()
        number_page("".join(rng.choice(PIECES) for _ in range(rng.randrange(25))), out)
        check(out)


class Links(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found, self.text = [], []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.found.append(dict(attrs).get("href"))

    def handle_data(self, data):
        self.text.append(data)


def test_links_and_text_agree_with_the_standard_tokenizer():
    rng = random.Random(4)
    good = ["<p>", "</p>", '<a href="/x?a=1&amp;b">', "</a>", "<b>", "</b>", "t", " &lt; ", "é", "<br>", "<!--c-->",
            "<A HREF='/y'>", "<li class=q>", "<a href=/z>", "<div>", "</div>"]
    for _ in range(3000):
        source = "<body>" + "".join(rng.choice(good) for _ in range(rng.randrange(30))) + "</body>"
        out, other = NodeColumns(), Links()
        number_page(source, out)
        other.feed(source)
        other.close()
        attrs = [dict(zip(out.attr_names[a:b], out.attr_values[a:b])) for a, b in zip(out.attr_offsets, out.attr_offsets[1:])]
        assert [x.get("href") for x, t in zip(attrs, out.tag) if t == "a"] == other.found
        assert "".join(t for t, k in zip(out.text, out.kind) if k == "text") == "".join(other.text)
